import pytest
from test_markup import CASES, RUN, body

from redquill.operators.markup import read_part
from redquill.operators.resolve import resolve, resolved


def texts(xml):
    return ["".join(p[0] for p in para["pieces"]) for para in read_part(xml)]


def unmarked(xml):
    return all(p[1] == "baseline" for para in read_part(xml) for p in para["pieces"]) and not any(p["mark_ins"] or p["mark_del"] for p in read_part(xml))


@pytest.mark.parametrize("case", [c for c in CASES if c[0] not in ("deleted cell", "deleted text")], ids=lambda c: c[0])
def test_resolving_all_gives_the_views(case):
    _, inner, accepted, rejected = case
    for accept, want in ((True, accepted), (False, rejected)):
        done = resolve(body(inner), accept)
        assert texts(done) == want and unmarked(done)


MIXED = '<w:p><w:ins w:id="1" w:author="Ann">' + RUN.format("new") + '</w:ins><w:del w:id="2" w:author="Bob"><w:r><w:delText> old </w:delText></w:r></w:del>' + RUN.format("end") + "</w:p>"


def test_authors():
    kinds = lambda xml: [(p[0], p[1]) for p in read_part(xml)[0]["pieces"]]
    assert kinds(resolve(body(MIXED), True, [" ANN "])) == [("new", "baseline"), (" old ", "deletion"), ("end", "baseline")]
    assert kinds(resolve(body(MIXED), False, ["bob"])) == [("new", "insertion"), (" old ", "baseline"), ("end", "baseline")]
    assert kinds(resolve(body(MIXED), True)) == [("new", "baseline"), ("end", "baseline")]
    assert kinds(resolve(body(MIXED), False)) == [(" old ", "baseline"), ("end", "baseline")]
    assert kinds(resolve(body(MIXED), False, [])) == kinds(body(MIXED))


def test_former_properties():
    xml = body('<w:p><w:pPr><w:pStyle w:val="New"/><w:rPr><w:b/></w:rPr><w:pPrChange w:id="1" w:author="A"><w:pPr><w:pStyle w:val="Old"/></w:pPr></w:pPrChange></w:pPr></w:p>')
    assert read_part(resolve(xml, True))[0]["style_id"] == "New" and read_part(resolve(xml, False))[0]["style_id"] == "Old"
    assert b"<w:b/>" in resolve(xml, False) and b"pPrChange" not in resolve(xml, True) + resolve(xml, False)


def test_rows(spark):
    got = resolved(spark.createDataFrame([(1, body(MIXED)), (2, b"<a"), (3, None)], "doc_id long, payload binary"), "doc_id long", True).orderBy("doc_id").collect()
    assert texts(bytes(got[0].payload)) == ["newend"] and [r.error for r in got] == [None, "PARSE_ERROR", "PARSE_ERROR"]
