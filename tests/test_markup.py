import io
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from redquill.operators import markup
from redquill.sources import packages

P = lambda text, mark="", kind="t": f"<w:p>{mark and f'<w:pPr><w:rPr><w:{mark}/></w:rPr></w:pPr>'}<w:r><w:{kind}>{text}</w:{kind}></w:r></w:p>"


def body(inner):
    return f'<w:document xmlns:w="{markup.WORD}" xmlns:m="urn:m"><w:body>{inner}</w:body></w:document>'.encode()


INS = '<w:ins w:id="1" w:author="A">{}</w:ins>'
RUN = "<w:r><w:t>{}</w:t></w:r>"
# name, body, accepted paragraphs, rejected paragraphs
CASES = [
    ("plain", P("a") + P("b"), ["a", "b"], ["a", "b"]),
    ("inserted mark joins when rejected", P("a", "ins") + P("b"), ["a", "b"], ["ab"]),
    ("deleted mark joins when accepted", P("a", "del") + P("b"), ["ab"], ["a", "b"]),
    ("chain of marks", P("a", "del") + P("b", "del") + P("c"), ["abc"], ["a", "b", "c"]),
    ("moved marks", P("a", "moveFrom") + P("b", "moveTo") + P("c"), ["ab", "c"], ["a", "bc"]),
    ("both kinds on a mark", "<w:p><w:pPr><w:rPr><w:ins/><w:del/></w:rPr></w:pPr><w:r><w:t>a</w:t></w:r></w:p>" + P("b"), ["ab"], ["ab"]),
    ("text left at the end stays", P("a") + P("b", "del"), ["a", "b"], ["a", "b"]),
    ("empty end goes", P("a") + P("", "ins"), ["a", ""], ["a"]),
    ("deleted text", P("gone", kind="delText") + P("b"), ["", "b"], ["gone", "b"]),
    ("characters", "<w:p><w:r><w:t>a</w:t><w:tab/><w:br/><w:noBreakHyphen/><w:softHyphen/></w:r></w:p>", ["a\t\n‑­"], ["a\t\n‑­"]),
    ("foreign text", "<w:p><m:x><w:r><w:t>no</w:t></w:r></m:x><w:r><w:t>yes</w:t></w:r></w:p>", ["yes"], ["yes"]),
    ("inserted row", "<w:tbl><w:tr><w:trPr><w:ins/></w:trPr><w:tc>" + P("x") + "</w:tc></w:tr></w:tbl>" + P("b"), ["x", "b"], ["b"]),
    ("deleted cell", "<w:tbl><w:tr><w:tc><w:tcPr><w:cellDel/></w:tcPr>" + P("x") + "</w:tc><w:tc>" + P("y") + "</w:tc></w:tr></w:tbl>" + P("b"), ["y", "b"], ["x", "y", "b"]),
    ("last paragraph of a cell", "<w:tbl><w:tr><w:tc>" + P("", "ins") + "</w:tc></w:tr></w:tbl>" + P("b"), ["", "b"], ["", "b"]),
    ("table at the end", P("a") + "<w:tbl><w:tr><w:tc>" + P("x") + "</w:tc></w:tr></w:tbl><w:sectPr/>", ["a", "x", ""], ["a", "x", ""]),
    ("marks join within a container only", "<w:tbl><w:tr><w:tc>" + P("x", "del") + "</w:tc><w:tc>" + P("y") + "</w:tc></w:tr></w:tbl>" + P("b"), ["x", "y", "b"], ["x", "y", "b"]),
    ("snapshots say nothing", "<w:p><w:pPr><w:pPrChange><w:pPr><w:rPr><w:del/></w:rPr></w:pPr></w:pPrChange></w:pPr><w:r><w:t>a</w:t></w:r></w:p>" + P("b"), ["a", "b"], ["a", "b"]),
]


def test_views(spark):
    parts = spark.createDataFrame([(name, body(xml)) for name, xml, _, _ in CASES], "doc_id string, payload binary")
    paras = markup.paragraphs(parts, "doc_id string")
    for view, place in (("accepted", 2), ("rejected", 3)):
        got = {r.doc_id: list(r.t) for r in markup.project(paras, ["doc_id"], view).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda x: x["text"]).alias("t")).collect()}
        assert got == {case[0]: case[place] for case in CASES}


def test_segments(spark):
    xml = "<w:p>" + RUN.format("ab") + RUN.format("c") + INS.format(RUN.format("new") + RUN.format("er")) + '<w:del w:id="2" w:author="B"><w:r><w:delText>old</w:delText></w:r></w:del>' + RUN.format("d") + "</w:p>"
    paras = markup.paragraphs(spark.createDataFrame([(1, body(xml))], "doc_id long, payload binary"), "doc_id long")
    rows = markup.segments(paras, ["doc_id"]).orderBy("seg").select("text", "kind", "author", "revision_id", "accepted_start", "rejected_start").collect()
    assert [tuple(r) for r in rows] == [("abc", "baseline", None, None, 0, 0), ("newer", "insertion", "A", "1", 3, None), ("old", "deletion", "B", "2", None, 3), ("d", "baseline", None, None, 8, 6)]


def test_parts_that_do_not_parse_are_errors(spark):
    rows = [(1, b"<a"), (2, b"<!DOCTYPE a><a/>"), (3, None), (4, body(P("x")))]
    got = markup.paragraphs(spark.createDataFrame(rows, "doc_id long, payload binary"), "doc_id long").select("doc_id", "error").collect()
    assert sorted((r.doc_id, r.error) for r in got) == [(1, "PARSE_ERROR"), (2, "DTD_REFUSED"), (3, "PARSE_ERROR"), (4, None)]


def test_packages_round_trip_and_refuse(spark, tmp_path):
    parts = [("a.xml", b"x" * 1000), ("b", b"q"), ("c", b""), ("d/e", os.urandom(300))]
    data = packages.pack(parts)
    assert packages.unpack(data) == parts and packages.pack(parts) == data
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        assert z.testzip() is None and [i.compress_type for i in z.infolist()] == [8, 0, 0, 0]
    locked = data.replace(b"PK\x01\x02\x14\x00\x14\x00\x00\x00", b"PK\x01\x02\x14\x00\x14\x00\x01\x00")
    for bad, code in ((b"", "INVALID_PACKAGE"), (data[:-30], "INVALID_PACKAGE"), (locked, "ENCRYPTED_ENTRY")):
        with pytest.raises(ValueError, match=code):
            packages.unpack(bad)
    with pytest.raises(ValueError, match="PART_TOO_LARGE"):
        packages.unpack(data, 999)
    rows = spark.createDataFrame([(7, i, n, p) for i, (n, p) in reversed(list(enumerate(parts)))], "doc_id long, seq int, part_name string, payload binary")
    made = packages.packages_of(packages.gathered(rows), "doc_id long")
    assert bytes(made.first().content) == data
    folder = tmp_path / "files"
    folder.mkdir()
    (folder / "good.zip").write_bytes(data)
    (folder / "bad.zip").write_bytes(b"no archive")
    got = packages.scan(spark, f"file://{folder}").collect()
    assert sorted((r.part_name or "", bytes(r.payload or b""), r.error) for r in got) == sorted([*((n, p, None) for n, p in parts), ("", b"", "INVALID_PACKAGE")])


def test_tokens_do_not_depend_on_order_but_refuse_repeats(spark):
    schema = "doc_id long, seq int, part_name string, payload binary"
    rows = [(1, 0, "a", b"1"), (1, 1, "b", b"2"), (2, 0, "./b", b"2"), (2, 1, "/a", b"1"), (3, 0, "a", b"1"), (3, 1, "\\a", b"2")]
    got = {r.doc_id: r.token for r in packages.revision_tokens(spark.createDataFrame(rows, schema)).collect()}
    assert got[1] == got[2] and got[1] and got[3] is None
