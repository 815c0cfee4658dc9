"""Rules that a marked-up part must keep, as issue rows.

One event parse of a part finds all issues; each is a row with its code and
severity, and a part is valid if none is an error. Deletions of other authors'
paragraph marks, which depend on who edits, are not among these rules.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from xml.parsers import expat

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .markup import WORD

ISSUES = "issue int, code string, severity string"
# Codes that are warnings, elements whose ids are shared, how a revision's date begins, white space.
WARNINGS = {"EMPTY_TEXT_ELEMENT", "EMPTY_REVISION_WRAPPER"}
NUMBERED = {"ins", "del", "rPrChange", "pPrChange"}
_DATE = re.compile(r"\d{4}-\d{2}-\d{2}T", re.A)
_SPACE_SIGNS = "\t\n\x0b\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
_XML = "http://www.w3.org/XML/1998/namespace"


class _Open:
    """An element that is not closed yet."""

    __slots__ = ("name", "children", "nested", "wrong", "plain", "text", "kept", "mark")

    def __init__(self, name: str, kept: bool, mark: bool):
        self.name, self.kept, self.mark = name, kept, mark
        self.children: list[str] = []
        self.nested = self.wrong = self.plain = False
        self.text = ""


def issues_of(xml: bytes) -> list[str]:
    """Codes of a part's issues, in the order in which their elements end; one code where it does not parse."""
    found: list[str] = []
    stack: list[_Open] = []
    ids: set[str] = set()
    parser = expat.ParserCreate(namespace_separator="|")

    def refuse(*_):
        raise ValueError("DTD_REFUSED")

    def start(tag: str, attributes: dict[str, str]) -> None:
        name = tag.rpartition("|")[2]
        get = lambda key: attributes.get(f"{WORD}|{key}") or attributes.get(key)
        if stack:
            stack[-1].children.append(name)
        if name == "p":
            for above in stack:
                above.nested |= above.name == "p"
        if name in ("ins", "del"):
            for above in stack:
                if above.name in ("ins", "del"):
                    above.wrong |= not (above.name == "ins" and name == "del" and above is stack[-1])
            if not get("id") or not get("author") or not _DATE.match(get("date") or ""):
                found.append("MISSING_REVISION_METADATA")
        if name == "t":
            for above in stack:
                above.plain |= above.name == "del"
        if name in NUMBERED and get("id"):
            if get("id") in ids:
                found.append("DUPLICATE_REVISION_ID")
            ids.add(get("id"))
        mark = bool(stack) and stack[-1].name == "rPr"
        stack.append(_Open(name, attributes.get(f"{_XML}|space") == "preserve", mark))

    def characters(data: str) -> None:
        for above in stack:
            if above.name in ("t", "delText"):
                above.text += data

    def end(tag: str) -> None:
        done = stack.pop()
        if done.name == "p" and done.nested:
            found.append("NESTED_PARAGRAPH")
        elif done.name == "body":
            places = [i for i, c in enumerate(done.children) if c == "sectPr"]
            if len(places) > 1:
                found.append("MULTIPLE_BODY_SECTPR")
            elif places and places[0] != len(done.children) - 1:
                found.append("SECTPR_NOT_LAST")
        elif done.name in ("ins", "del"):
            if done.wrong:
                found.append("NESTED_REVISION")
            if done.plain:
                found.append("DEL_CONTAINS_T")
            if not done.children and not done.mark:
                found.append("EMPTY_REVISION_WRAPPER")
        elif done.name in ("t", "delText"):
            if done.text != done.text.strip(_SPACE_SIGNS) and not done.kept:
                found.append("MISSING_SPACE_PRESERVE")
            if not done.text:
                found.append("EMPTY_TEXT_ELEMENT")

    parser.StartDoctypeDeclHandler = refuse
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, characters
    try:
        parser.Parse(xml, True)
    except (expat.ExpatError, ValueError):
        return ["PARSE_ERROR"]
    return found


def issues(parts: DataFrame, keys: str, payload: str = "payload") -> DataFrame:
    """(keys, issue, code, severity): a row for each issue of each part, and none for a part without any."""
    names = [k.split()[0] for k in keys.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(*key, i, code, "warning" if code in WARNINGS else "error") for *key, data in batch[[*names, payload]].itertuples(index=False, name=None) for i, code in enumerate(issues_of(bytes(data or b"")), 1)]
            yield pd.DataFrame(rows, columns=[*names, "issue", "code", "severity"])

    return parts.select(*names, payload).mapInPandas(run, f"{keys}, {ISSUES}")


def added_issues(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, code, severity, n): how many more issues of a code the later state has."""
    count = lambda df, n: df.groupBy(*keys, "code", "severity").agg(F.count("*").alias(n))
    both = count(after, "n").join(count(before, "_had"), [*keys, "code", "severity"], "left")
    return both.select(*keys, "code", "severity", (F.col("n") - F.coalesce("_had", F.lit(0))).alias("n")).where("n > 0")
