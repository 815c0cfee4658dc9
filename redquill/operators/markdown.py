"""Inline Markdown and HTML marks: the text without them, and where they applied.

The outermost marks win: of all matches the earliest, then the longest, is taken,
and what lies inside is read in the same way. Hints carry offsets in the clean
text, an outer one before those inside it. Python's regular expressions do the
matching, since Java's and this grammar differ in nothing but their host.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

# What delimits marked text (the same on both sides), and what the mark means.
_SIGNS = (
    (r"\*\*\*(.+?)\*\*\*", "bold italic"), (r"\*\*\+\+(.+?)\+\+\*\*", "bold underline"), (r"\*\*(.+?)\*\*", "bold"),
    (r"(?<![A-Za-z0-9_])__(?=[^_\s])(.+?)(?<=[^_\s])__(?![A-Za-z0-9_])", "bold"), (r"\+\+(.+?)\+\+", "underline"), (r"~~(.+?)~~", "strikethrough"), (r"~(.+?)~", "strikethrough"),
    (r"\*(?!\*)(.+?)\*(?!\*)", "italic"), (r"(?<![A-Za-z0-9_])_(?=[^_\s])(.+?)(?<=[^_\s])_(?![A-Za-z0-9_])", "italic"),
)
_TAGS = {"b": "bold", "strong": "bold", "i": "italic", "em": "italic", "u": "underline", "s": "strikethrough", "strike": "strikethrough", "del": "strikethrough"}
_ESCAPED_TAGS = ("b", "strong", "i", "em", "u", "s")
_RULES = [
    *((re.compile(rf"<{t}>(.+?)</{t}>", re.I), name, False) for t, name in _TAGS.items()),
    *((re.compile(rf"&lt;{t}&gt;(.+?)&lt;/{t}&gt;", re.I), _TAGS[t], True) for t in _ESCAPED_TAGS),
    *((re.compile(p), name, False) for p, name in _SIGNS),
]
_POSSIBLE = re.compile(r"[*_~<&]|\+\+")
HINTS = "clean string, hints array<struct<start:int,end:int,format:string>>"


def strip_marks(text: str) -> tuple[str, list[tuple[int, int, str]]]:
    """The clean text and (start, end, format) hints."""
    if not _POSSIBLE.search(text):
        return text, []
    found = sorted(((m.start(), -m.end(), rank, m.group(1), name, escaped) for rank, (rule, name, escaped) in enumerate(_RULES) for m in rule.finditer(text)), key=lambda f: f[:3])
    clean, hints, done = [], [], 0
    size = 0
    for start, end, _, inner, name, escaped in found:
        if start < done:
            continue
        clean.append(text[done:start])
        size += start - done
        inside, deeper = strip_marks(html.unescape(inner) if escaped else inner)
        hints.append((size, size + len(inside), name))
        hints += [(size + s, size + e, f) for s, e, f in deeper]
        clean.append(inside)
        size, done = size + len(inside), -end
    return "".join(clean) + text[done:], hints


def stripped(df: DataFrame, keys: str, text: str = "text") -> DataFrame:
    """(keys, clean, hints) for each row; a null text is empty."""
    names = [k.split()[0] for k in keys.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch[names].copy()
            done = [strip_marks(t or "") for t in batch[text]]
            out["clean"] = [c for c, _ in done]
            out["hints"] = [[{"start": s, "end": e, "format": f} for s, e, f in h] for _, h in done]
            yield out

    return df.select(*names, text).mapInPandas(run, f"{keys}, {HINTS}")
