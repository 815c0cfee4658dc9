from test_markup import P, body

from redquill.sources.packages import pack
from redquill.streaming import arrivals


def test_each_package_is_read_once(spark, tmp_path):
    came, out, marks = tmp_path / "in", tmp_path / "out", tmp_path / "marks"
    came.mkdir()
    put = lambda name, data: (came / name).write_bytes(data)
    step = lambda: arrivals.keep(arrivals.arriving_paragraphs(arrivals.arriving_packages(spark, f"file://{came}", 1)), f"file://{out}", f"file://{marks}").awaitTermination()
    put("a", pack([("word/document.xml", body(P("one") + P("two", "ins")))]))
    put("b", b"no package")
    step()
    put("c", pack([("x", b""), ("word/document.xml", body(P("three")))]))
    step()
    step()
    rows = sorted((r.path.rpartition("/")[2], r.idx or 0, r.accepted, r.error) for r in spark.read.parquet(f"file://{out}").collect())
    assert [(p, i) for p, i, _, _ in rows] == [("a", 1), ("a", 2), ("b", 0), ("c", 1)] and rows[2][3] and rows[3][2] == "three"


def test_issue_counts_by_window(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a").write_bytes(pack([("word/document.xml", body("<w:p><w:r><w:t/><w:t/></w:r></w:p>"))]))
    counts = arrivals.issue_counts(arrivals.arriving_packages(spark, f"file://{tmp_path}/in"))
    query = counts.writeStream.format("memory").queryName("issue_counts").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert [(r.code, r.severity, r.n) for r in spark.table("issue_counts").collect()] == [("EMPTY_TEXT_ELEMENT", "warning", 2)]
