"""Paragraphs, revision segments and views of marked-up document parts.

One event parse of a part (expat; document type declarations are refused) gives
a row for each paragraph and an array of its pieces: a piece is one text element
with the innermost revision around it. Everything after that is DataFrame work:
segments are runs of pieces that agree, a view is the text that remains when all
revisions are accepted or rejected, with paragraphs joined where a mark goes.
A part that does not parse is one row with an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from xml.parsers import expat

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
WORD14 = "http://schemas.microsoft.com/office/word/2010/wordml"
# Revision elements, containers of paragraphs, characters that elements stand for.
REVISIONS = {"ins": "insertion", "del": "deletion", "moveFrom": "move_from", "moveTo": "move_to"}
CONTAINERS = {"body", "tc", "txbxContent", "footnote", "endnote", "comment", "hdr", "ftr"}
CHARACTERS = {"tab": "\t", "br": "\n", "cr": "\n", "noBreakHyphen": "‑", "softHyphen": "­"}

# What a part's text can't hold, and what it must hold as an entity.
ILLEGAL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x{FFFE}\x{FFFF}]"
ENTITIES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\r", "&#13;"))

PIECE = "struct<text:string,kind:string,author:string,revision_id:string,carrier:int,holder:int>"
PARAGRAPHS = (
    f"idx int, implicit boolean, para_id string, in_table boolean, container string, container_id int, mark_ins boolean, mark_del boolean, hidden_accepted boolean, hidden_rejected boolean, "
    f"style_id string, outline_lvl int, num_id string, ilvl int, pieces array<{PIECE}>, error string"
)


class _Node:
    __slots__ = ("name", "number", "para", "revision", "carrier", "hidden", "removed", "keeps")

    def __init__(self, name, number, para, revision, carrier, hidden, removed, keeps):
        self.name, self.number, self.para, self.revision, self.carrier = name, number, para, revision, carrier
        self.hidden, self.removed, self.keeps = hidden, removed, keeps


class _Reader:
    """Collects paragraphs while expat walks a part."""

    def __init__(self):
        self.stack: list[_Node] = []
        self.paras: list[dict] = []
        self.count = 0
        self.text: list[str] | None = None
        self.last_block = ""

    def start(self, tag: str, attributes: dict[str, str]) -> None:
        space, _, name = tag.rpartition("|")
        self.count += 1
        up = self.stack[-1] if self.stack else _Node("", 0, None, None, None, None, False, None)
        foreign = space != WORD
        node = _Node("" if foreign else name, self.count, up.para, up.revision, up.carrier, None, up.removed, up.keeps)
        get = lambda key: attributes.get(f"{WORD}|{key}")
        path = [n.name for n in self.stack[-2:]]
        if up.name == "body" and not foreign and name != "sectPr":
            self.last_block = name
        if foreign:
            # What a foreign element holds is no text of the paragraph; paragraphs inside it are still found.
            node.removed = node.removed or up.para is not None
        elif name == "p":
            box = next((n for n in reversed(self.stack) if n.name in CONTAINERS), None)
            node.para = {
                "idx": len(self.paras) + 1, "implicit": False, "para_id": attributes.get(f"{WORD14}|paraId"), "in_table": any(n.name == "tbl" for n in self.stack),
                "container": box.name if box else None, "container_id": box.number if box else 0, "mark_ins": False, "mark_del": False, "style_id": None, "outline_lvl": None,
                "num_id": None, "ilvl": None, "pieces": [], "frames": [n.hidden for n in self.stack if n.hidden is not None],
            }
            node.revision, node.carrier, node.removed, node.keeps = None, None, False, None
            self.paras.append(node.para)
        elif name in ("tr", "tc"):
            node.hidden = {"accepted": False, "rejected": False}
            if name == "tc":
                node.para = None
        elif name in ("ins", "del", "cellIns", "cellDel") and path and path[-1] in ("trPr", "tcPr"):
            owner = next((n for n in reversed(self.stack) if n.hidden is not None), None)
            if owner is not None and (path[-1] == "trPr") == (name in ("ins", "del")):
                owner.hidden["rejected" if name in ("ins", "cellIns") else "accepted"] = True
        elif up.para is not None:
            self._inside(node, name, path, get)
        self.stack.append(node)

    def _inside(self, node: _Node, name: str, path: list[str], get) -> None:
        para, own = node.para, path[-1] if path else ""
        if own == "p" and name == "pPr":
            node.keeps, node.removed = para, True
        elif name == "rPr" and node.keeps is None:
            node.removed = True
        elif node.keeps is not None:
            if own == "pPr" and name == "pStyle":
                para["style_id"] = get("val")
            elif own == "pPr" and name == "outlineLvl":
                para["outline_lvl"] = _number(get("val"))
            elif path == ["pPr", "numPr"] and name == "numId":
                para["num_id"] = get("val")
            elif path == ["pPr", "numPr"] and name == "ilvl":
                para["ilvl"] = _number(get("val"))
            elif path == ["pPr", "rPr"] and name in REVISIONS:
                para["mark_ins" if name in ("ins", "moveTo") else "mark_del"] = True
            if name.endswith("Change"):
                node.keeps = {**para, "pieces": []}
                node.para = node.keeps  # a snapshot of former properties
        elif not node.removed:
            if name in REVISIONS:
                node.revision = (REVISIONS[name], get("author"), get("id"))
            elif name == "r":
                node.carrier = (node.number, self.stack[-1].number)
            elif name in ("t", "delText"):
                self.text = []
            elif name in CHARACTERS:
                self._piece(node, name, CHARACTERS[name])

    def _piece(self, node: _Node, name: str, text: str) -> None:
        kind, author, number = node.revision or ("deletion" if name == "delText" else "baseline", None, None)
        carrier = node.carrier or (node.number, self.stack[-1].number)
        if text:
            node.para["pieces"].append((text, kind, author, number, *carrier))

    def end(self, tag: str) -> None:
        node = self.stack.pop()
        if node.name == "body":
            if self.last_block == "tbl":  # a body can't end with a table: an empty paragraph of its own follows
                self.paras.append({"idx": len(self.paras) + 1, "implicit": True, "in_table": False, "container": "body", "container_id": -node.number, "mark_ins": False, "mark_del": False, "pieces": [], "frames": []})
            self.last_block = ""
        if self.text is not None and node.name in ("t", "delText"):
            text, self.text = "".join(self.text), None
            self._piece(node, node.name, text)

    def characters(self, data: str) -> None:
        if self.text is not None:
            self.text.append(data)


def _number(value: str | None) -> int | None:
    try:
        return int(value)
    except (TypeError, ValueError):
        return None


def read_part(xml: bytes) -> list[dict]:
    """Paragraphs of one part in document order; ValueError where it does not parse."""
    reader, parser = _Reader(), expat.ParserCreate(namespace_separator="|")

    def refuse(*_):
        raise ValueError("DTD_REFUSED")

    parser.StartDoctypeDeclHandler = refuse
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = reader.start, reader.end, reader.characters
    try:
        parser.Parse(xml, True)
    except expat.ExpatError as e:
        raise ValueError("PARSE_ERROR") from e
    for p in reader.paras:
        frames = p.pop("frames")
        p["hidden_accepted"], p["hidden_rejected"] = any(f["accepted"] for f in frames), any(f["rejected"] for f in frames)
    return reader.paras


def paragraphs(parts: DataFrame, keys: str, payload: str = "payload") -> DataFrame:
    """A row for each paragraph of each part; ``keys`` is the DDL of the columns kept."""
    names, columns = [k.split()[0] for k in keys.split(",")], [c.split()[0] for c in PARAGRAPHS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for *key, data in batch[[*names, payload]].itertuples(index=False, name=None):
                try:
                    found = read_part(bytes(data or b""))
                except ValueError as e:
                    found = [{"error": str(e)}]
                rows = [(*key, *(p.get(c) for c in columns)) for p in found]
                if rows:
                    yield pd.DataFrame(rows, columns=[*names, *columns], dtype=object)

    return parts.select(*names, payload).mapInPandas(run, f"{keys}, {PARAGRAPHS}")


def _hidden(view: str) -> list[str]:
    """Kinds that a view leaves out."""
    return ["insertion", "move_to"] if view == "rejected" else ["deletion", "move_from"]


def view_text(view: str, pieces: Column | str = "pieces") -> Column:
    """The text of a paragraph's pieces in a view."""
    shown = F.filter(F.col(pieces) if isinstance(pieces, str) else pieces, lambda p: ~p["kind"].isin(_hidden(view)))
    return F.array_join(F.transform(shown, lambda p: p["text"]), "")


def segments(paras: DataFrame, keys: list[str]) -> DataFrame:
    """Runs of adjacent pieces of one kind, author and revision that share a run or its holder.

    Starts are offsets in the accepted and the rejected text; what a view hides has a null start there.
    """
    each = paras.select(*keys, "idx", F.posexplode("pieces").alias("place", "p")).select(*keys, "idx", "place", "p.*")
    order = Window.partitionBy(*keys, "idx").orderBy("place")
    before = lambda c: F.lag(c).over(order)
    same = F.col("kind").eqNullSafe(before("kind")) & F.col("author").eqNullSafe(before("author")) & F.col("revision_id").eqNullSafe(before("revision_id"))
    joined = same & ((F.col("carrier") == before("carrier")) | (F.col("holder") == before("holder")))
    numbered = each.withColumn("seg", F.sum(F.when(joined, 0).otherwise(1)).over(order).cast("int"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]), "")
    runs = numbered.groupBy(*keys, "idx", "seg").agg(text.alias("text"), F.first("kind").alias("kind"), F.first("author").alias("author"), F.first("revision_id").alias("revision_id"))
    passed = Window.partitionBy(*keys, "idx").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)

    def start(view: str) -> Column:
        shown = ~F.col("kind").isin(_hidden(view))
        return F.when(shown, F.coalesce(F.sum(F.when(shown, F.length("text")).otherwise(0)).over(passed), F.lit(0)).cast("int")).alias(f"{view}_start")

    return runs.select(*keys, "idx", "seg", "text", "kind", "author", "revision_id", start("accepted"), start("rejected"))


def project(paras: DataFrame, keys: list[str], view: str) -> DataFrame:
    """(keys, idx, container, text): paragraphs left when all revisions are accepted or rejected.

    A paragraph whose mark goes carries its text into the next one of its
    container. At the container's end it stays if it has text, or if it is a
    cell's and the view is the rejected one. ``idx`` is that of the paragraph
    whose mark stays, which is also the one whose properties win.
    """
    gone = F.col("mark_ins" if view == "rejected" else "mark_del")
    shown = paras.where(F.col("error").isNull() & ~F.col(f"hidden_{view}"))
    passed = Window.partitionBy(*keys, "container_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    own = shown.select(*keys, "idx", "container", "container_id", gone.alias("gone"), view_text(view).alias("text")).withColumn("island", F.coalesce(F.sum(F.when(F.col("gone"), 0).otherwise(1)).over(passed), F.lit(0)))
    joined = own.groupBy(*keys, "container_id", "island").agg(
        F.max("idx").alias("idx"), F.first("container").alias("container"), F.array_sort(F.collect_list(F.struct("idx", "text"))).alias("_t"), F.bool_and("gone").alias("open")
    )
    whole = joined.select(*keys, "idx", "container", F.array_join(F.transform("_t", lambda x: x["text"]), "").alias("text"), "open")
    keeps = F.col("text") != ""
    if view == "rejected":
        keeps = keeps | F.col("container").eqNullSafe("tc")
    return whole.where(~F.col("open") | keeps).drop("open")


def plain_text(paras: DataFrame, keys: list[str], view: str = "accepted") -> DataFrame:
    """(keys, text): a document's paragraphs in a view, one line break between them."""
    line = F.array_sort(F.collect_list(F.struct("idx", "text")))
    return project(paras, keys, view).groupBy(*keys).agg(F.array_join(F.transform(line, lambda x: x["text"]), "\n").alias("text"))


def markup(text: Column, mark: Column | None = None, kind: Column | None = None) -> Column:
    """Markup of a paragraph: its text as one run, inside a revision if ``kind`` is ins or del, its mark revised if ``mark`` is."""
    # Characters that XML cannot hold are left out; white space in a text is kept.
    clean = F.regexp_replace(text, ILLEGAL, "")
    for sign, entity in ENTITIES:
        clean = F.replace(clean, F.lit(sign), F.lit(entity))
    author = F.lit(' w:id="1" w:author="a" w:date="2020-01-01T00:00:00Z"')
    run = lambda tag: F.concat(F.lit(f'<w:r><w:{tag} xml:space="preserve">'), clean, F.lit(f"</w:{tag}></w:r>"))
    body = run("t") if kind is None else F.when(kind == "ins", F.concat(F.lit("<w:ins"), author, F.lit(">"), run("t"), F.lit("</w:ins>"))).when(kind == "del", F.concat(F.lit("<w:del"), author, F.lit(">"), run("delText"), F.lit("</w:del>"))).otherwise(run("t"))
    marked = F.lit("") if mark is None else F.when(mark.isin("ins", "del"), F.concat(F.lit("<w:pPr><w:rPr><w:"), mark, author, F.lit("/></w:rPr></w:pPr>"))).otherwise(F.lit(""))
    return F.concat(F.lit("<w:p>"), marked, body, F.lit("</w:p>"))


def document(paragraph_xml: Column) -> Column:
    """The bytes of a main part around its paragraphs' markup."""
    return F.encode(F.concat(F.lit(f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="{WORD}"><w:body>'), paragraph_xml, F.lit("</w:body></w:document>")), "UTF-8")
