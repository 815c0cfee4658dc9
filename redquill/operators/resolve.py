"""Accepting and rejecting tracked changes in a part, of all authors or of some.

What stays loses its marking, what goes is removed: runs, whole rows, and
paragraph marks, whose paragraphs join the next one of their container. Former
properties are dropped when accepting and put back when rejecting. Cell
insertions and deletions, and deleted text outside any change, are left as they
are. Resolving all authors' changes
leaves the text that the view projection of the part says.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from xml.dom import minidom

import pandas as pd
from pyspark.sql import DataFrame

from .markup import WORD, read_part

# What each kind of change is called, ranges of moves, and property changes.
_INSERTED, _DELETED = ("ins", "moveTo"), ("del", "moveFrom")
_RANGES = ("moveFromRangeStart", "moveFromRangeEnd", "moveToRangeStart", "moveToRangeEnd")
_PROPERTIES = ("rPrChange", "pPrChange", "tblPrChange", "trPrChange", "tcPrChange")
#: What a former paragraph's properties say nothing of.
_OUTSIDE = {"pPrChange": ("rPr", "sectPr")}


def _all(doc, *names: str) -> list:
    return [e for e in doc.getElementsByTagNameNS(WORD, "*") if e.localName in names]


def _elements(node) -> list:
    return [c for c in node.childNodes if c.nodeType == c.ELEMENT_NODE]


def _parent(node) -> str:
    return node.parentNode.localName or ""


def _attached(node, doc) -> bool:
    while node is not None and node is not doc:
        node = node.parentNode
    return node is doc


def _drop(node) -> None:
    if node.parentNode is not None:
        node.parentNode.removeChild(node)


def _lift(node) -> None:
    """Puts what a node holds in its place."""
    for child in list(node.childNodes):
        node.parentNode.insertBefore(child, node)
    _drop(node)


def _restore(change) -> None:
    """Puts back the properties that a change remembers."""
    own, former = change.parentNode, next(iter(_elements(change)), None)
    kept = _OUTSIDE.get(change.localName, ())
    for child in _elements(own):
        if child.localName not in kept:
            own.removeChild(child)
    first = own.firstChild
    for child in _elements(former) if former is not None else ():
        own.insertBefore(child, first)


def resolve(xml: bytes, accept: bool, authors: Iterable[str] | None = None) -> bytes:
    """The part without the changes of ``authors`` (any case; None for everybody). ValueError where it does not parse."""
    read_part(xml)  # refuses what does not parse, and document type declarations
    doc = minidom.parseString(xml)
    names = None if authors is None else {a.strip().lower() for a in authors}
    mine = lambda e: names is None or e.getAttributeNS(WORD, "author").strip().lower() in names
    stays, goes = (_INSERTED, _DELETED) if accept else (_DELETED, _INSERTED)

    for change in _all(doc, *_PROPERTIES):
        if _attached(change, doc) and mine(change):
            (_drop if accept else _restore)(change)
    for row in _all(doc, "tr"):
        marks = [m for p in _elements(row) if p.localName == "trPr" for m in _elements(p) if m.localName in ("ins", "del") and mine(m)]
        if any(m.localName in goes for m in marks):
            _drop(row)
        for m in marks:
            _drop(m)
    for table in _all(doc, "tbl"):
        if not any(e.localName == "tr" for e in _elements(table)):
            _drop(table)
    leaving = []
    for change in _all(doc, *stays, *goes):
        if not _attached(change, doc) or not mine(change) or _parent(change) == "trPr":
            continue
        if _parent(change) == "rPr":
            if _parent(change.parentNode) == "pPr" and change.localName in goes:
                para = change.parentNode.parentNode.parentNode
                if para not in leaving:
                    leaving.append(para)
            _drop(change)
        elif change.localName in goes:
            _drop(change)
        else:
            if change.localName == "del":
                for old in _all(change, "delText"):
                    new = doc.createElementNS(WORD, old.tagName.replace("delText", "t"))
                    new.setAttribute("xml:space", "preserve")
                    for child in list(old.childNodes):
                        new.appendChild(child)
                    old.parentNode.replaceChild(new, old)
            _lift(change)
    if names is None:
        for mark in _all(doc, *_RANGES):
            _drop(mark)
    for para in leaving:
        if _attached(para, doc):
            _join(para, accept)
    return doc.toxml(encoding="UTF-8").replace(b"\r", b"&#13;")


def _shows(node) -> bool:
    """Whether what a paragraph holds is more than empty runs."""
    if node.nodeType != node.ELEMENT_NODE:
        return False
    return node.localName != "r" or any(e.localName != "rPr" and not (e.localName == "t" and not e.childNodes) for e in _elements(node))


def _join(para, accept: bool) -> None:
    """Moves a paragraph's content in front of the next one's; at the end of its container it stays if it has to."""
    content = [c for c in para.childNodes if c.localName != "pPr"]
    after = para.nextSibling
    while after is not None and after.localName != "p":
        after = after.nextSibling
    if after is None:
        if not any(map(_shows, content)) and (accept or _parent(para) != "tc"):
            _drop(para)
        return
    first = next((c for c in after.childNodes if c.localName != "pPr"), None)
    for child in content:
        after.insertBefore(child, first)
    _drop(para)


def resolved(parts: DataFrame, keys: str, accept: bool, authors: list[str] | None = None) -> DataFrame:
    """(keys, payload, error) for rows with ``payload``, where they lie."""
    names = [k.split()[0] for k in keys.split(",")]

    def one(xml) -> tuple[bytes | None, str | None]:
        try:
            return resolve(bytes(xml or b""), accept, authors), None
        except ValueError as e:
            return None, str(e)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch[names].copy()
            done = [one(x) for x in batch["payload"]]
            out["payload"], out["error"] = [x for x, _ in done], [e for _, e in done]
            yield out

    return parts.select(*names, "payload").mapInPandas(run, f"{keys}, payload binary, error string")
