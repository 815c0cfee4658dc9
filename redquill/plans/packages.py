"""Queries that take documents through packages and markup, and their SQL.

A document's lines become paragraphs. By their index some are inserted (1 mod 5,
but the first), some deleted (0 mod 5); some marks are inserted (3 mod 7), some
deleted (5 mod 7). The packages are written, read back and projected; the SQL
says from the lines alone what must come out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dialect import ORACLE
from ..operators import markup, redline, resolve, validation
from ..sources import packages

KEYS = "doc_id long"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text), a null text as an empty one; dealt out where a small table has fewer partitions than the cluster has cores, as parsing costs more than moving."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id", "coalesce(text, '') AS text")
    cores = spark.sparkContext.defaultParallelism
    return docs if docs.rdd.getNumPartitions() >= cores else docs.repartition(cores)


def _packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, content): each document as a package of its markup and its plain text."""
    docs = _documents(spark, sf_dir)

    def line(text, at):
        idx = at + 1
        kind = F.when(idx % 5 == 0, "del").when((idx % 5 == 1) & (idx > 1), "ins").otherwise("")
        mark = F.when(idx % 7 == 3, "ins").when(idx % 7 == 5, "del").otherwise("")
        return markup.markup(text, mark, kind)

    body = markup.document(F.array_join(F.transform(F.split("text", "\n"), line), ""))
    part = lambda name, payload: F.struct(F.lit(name).alias("part_name"), payload.alias("payload"))
    listed = F.array(part("word/document.xml", body), part("docProps/source.txt", F.encode("text", "UTF-8")))
    return packages.packages_of(docs.select("doc_id", listed.alias("parts")), KEYS)


def _paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = packages.parts_of(_packages(spark, sf_dir), KEYS)
    return markup.paragraphs(parts.where("part_name = 'word/document.xml' OR error IS NOT NULL"), KEYS)


def package_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of the packages as read back: place, name, length and digest."""
    parts = packages.parts_of(_packages(spark, sf_dir), KEYS)
    return parts.select("doc_id", "seq", "part_name", F.octet_length("payload").alias("n_bytes"), F.sha2("payload", 256).alias("digest"))


def package_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SHA-256 over the framed parts of each package."""
    return packages.revision_tokens(packages.parts_of(_packages(spark, sf_dir), KEYS))


def markup_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of the parsed markup with both views' texts and the revisions of their marks."""
    accepted, rejected = (markup.view_text(v).alias(v) for v in ("accepted", "rejected"))
    return _paragraphs(spark, sf_dir).select("doc_id", "idx", accepted, rejected, "mark_ins", "mark_del", "in_table", "error")


def markup_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revision segments with their offsets in both views."""
    return markup.segments(_paragraphs(spark, sf_dir), ["doc_id"])


def _view(view: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return markup.project(_paragraphs(spark, sf_dir), ["doc_id"], view).select("doc_id", "idx", "text")

    run.__doc__ = f"Paragraphs of the {view} view, joined where a mark goes."
    return run


def markup_plain_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The accepted view of each document as one text."""
    return markup.plain_text(_paragraphs(spark, sf_dir), ["doc_id"])


def markup_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each issue occurs in a document's markup."""
    parts = packages.parts_of(_packages(spark, sf_dir), KEYS).where("part_name = 'word/document.xml'")
    return validation.issues(parts, KEYS).groupBy("doc_id", "code", "severity").agg(F.count("*").alias("n"))


def redline_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both views after every third paragraph is edited as a tracked change, and the refusals of the document."""
    docs = _documents(spark, sf_dir)
    lines = F.split(F.regexp_replace("text", markup.ILLEGAL, ""), "\n")
    edit = lambda x, i: F.struct((i + 1).cast("int").alias("idx"), F.concat(F.lit("New "), x, F.lit(" end")).alias("text"))
    parts = docs.select(
        "doc_id",
        markup.document(F.array_join(F.transform(lines, lambda x: markup.markup(x)), "")).alias("payload"),
        F.filter(F.transform(lines, edit), lambda e: e["idx"] % 3 == 1).alias("edits"),
    )
    done = redline.redlined(parts, KEYS, "a", "2020-01-01T00:00:00Z").withColumn("payload", F.when(F.size("refusals") == 0, F.col("payload")))
    accepted, rejected = (markup.view_text(v).alias(v) for v in ("accepted", "rejected"))
    return markup.paragraphs(done, KEYS).select("doc_id", "idx", accepted, rejected, "error")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (package_parts, package_tokens, markup_paragraphs, markup_segments, markup_plain_text, markup_issues, redline_views)}


def _resolved(accept: bool) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        parts = packages.parts_of(_packages(spark, sf_dir), KEYS).where("part_name = 'word/document.xml'")
        paras = markup.paragraphs(resolve.resolved(parts, KEYS, accept).drop("error"), KEYS)
        text = F.array_sort(F.collect_list(F.struct("idx", markup.view_text("accepted").alias("text"))))
        return paras.groupBy("doc_id").agg(F.array_join(F.transform(text, lambda x: x["text"]), "\n").alias("text"), F.bool_or(F.col("mark_ins") | F.col("mark_del") | F.exists("pieces", lambda p: p["kind"] != "baseline")).alias("pending"))

    run.__doc__ = f"Documents' texts after all changes are {'accepted' if accept else 'rejected'} in their markup."
    return run


QUERIES |= {"changes_accepted": _resolved(True), "changes_rejected": _resolved(False)}
QUERIES |= {"markup_accepted": _view("accepted"), "markup_rejected": _view("rejected")}

_LINES = f"""lines AS (SELECT doc_id, idx, regexp_replace(text, '{markup.ILLEGAL}', '', 'g') AS text, CASE WHEN idx % 5 = 0 THEN 'del' WHEN idx % 5 = 1 AND idx > 1 THEN 'ins' ELSE '' END AS kind,
  CASE idx % 7 WHEN 3 THEN 'ins' WHEN 5 THEN 'del' ELSE '' END AS mark FROM ({ORACLE.paragraphs()}))"""
_WHO = ' w:id="1" w:author="a" w:date="2020-01-01T00:00:00Z"'
_XML = f"""{_LINES}, marked AS (SELECT doc_id, idx, '<w:p>' || CASE WHEN mark = '' THEN '' ELSE '<w:pPr><w:rPr><w:' || mark || '{_WHO}/></w:rPr></w:pPr>' END
  || CASE WHEN kind = '' THEN '' ELSE '<w:' || kind || '{_WHO}>' END || CASE kind WHEN 'del' THEN '<w:r><w:delText xml:space="preserve">' ELSE '<w:r><w:t xml:space="preserve">' END
  || replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(13), '&#13;') || CASE kind WHEN 'del' THEN '</w:delText></w:r>' ELSE '</w:t></w:r>' END
  || CASE WHEN kind = '' THEN '' ELSE '</w:' || kind || '>' END || '</w:p>' AS xml FROM lines),
xmls AS (SELECT doc_id, '<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="{markup.WORD}"><w:body>' || string_agg(xml, '' ORDER BY idx) || '</w:body></w:document>' AS xml FROM marked GROUP BY doc_id),
parts AS (SELECT doc_id, 0 AS seq, 'word/document.xml' AS part_name, xml AS payload FROM xmls UNION ALL SELECT doc_id, 1, 'docProps/source.txt', coalesce(text, '') FROM documents)"""


def _views(view: str) -> str:
    hides, gone = ("del", "del") if view == "accepted" else ("ins", "ins")
    return f"""{_LINES}, shown AS (SELECT doc_id, idx, CASE WHEN kind = '{hides}' THEN '' ELSE text END AS text, mark = '{gone}' AS gone FROM lines),
islands AS (SELECT *, coalesce(sum(CASE WHEN gone THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS island FROM shown),
joined AS (SELECT doc_id, max(idx) AS idx, string_agg(text, '' ORDER BY idx) AS text, bool_and(gone) AS open FROM islands GROUP BY doc_id, island),
view AS (SELECT doc_id, idx, text FROM joined WHERE NOT open OR text <> '')"""


def _framed(value: str) -> str:
    return f"unhex(lpad(to_hex(octet_length({value})), 8, '0')) || {value}"


ORACLES: dict[str, str] = {
    "package_parts": f"WITH {_XML} SELECT doc_id, seq, part_name, CAST(strlen(payload) AS INTEGER) AS n_bytes, sha256(payload) AS digest FROM parts",
    "package_tokens": f"""WITH {_XML} SELECT a.doc_id, CAST(2 AS INTEGER) AS parts, sha256(encode('package-revision-token') || unhex('0000000001') || {_framed("encode('package')")} || unhex('00000002')
  || {_framed("encode(b.part_name)")} || {_framed("encode(b.payload)")} || {_framed("encode(a.part_name)")} || {_framed("encode(a.payload)")}) AS token FROM parts a JOIN parts b ON b.doc_id = a.doc_id AND a.seq = 0 AND b.seq = 1""",
    "markup_paragraphs": f"""WITH {_LINES} SELECT doc_id, idx, CASE WHEN kind = 'del' THEN '' ELSE text END AS accepted, CASE WHEN kind = 'ins' THEN '' ELSE text END AS rejected,
  mark = 'ins' AS mark_ins, mark = 'del' AS mark_del, false AS in_table, CAST(NULL AS VARCHAR) AS error FROM lines""",
    "markup_segments": f"""WITH {_LINES} SELECT doc_id, idx, CAST(1 AS INTEGER) AS seg, text, CASE kind WHEN 'ins' THEN 'insertion' WHEN 'del' THEN 'deletion' ELSE 'baseline' END AS kind,
  CASE WHEN kind <> '' THEN 'a' END AS author, CASE WHEN kind <> '' THEN '1' END AS revision_id, CASE WHEN kind <> 'del' THEN 0 END AS accepted_start, CASE WHEN kind <> 'ins' THEN 0 END AS rejected_start FROM lines WHERE text <> ''""",
    "markup_plain_text": f"WITH {_views('accepted')} SELECT doc_id, string_agg(text, chr(10) ORDER BY idx) AS text FROM view GROUP BY doc_id",
    "redline_views": f"WITH {_LINES} SELECT doc_id, idx, CASE WHEN idx % 3 = 1 THEN 'New ' || text || ' end' ELSE text END AS accepted, text AS rejected, CAST(NULL AS VARCHAR) AS error FROM lines",
    "markup_issues": f"""WITH {_LINES}, found AS (SELECT doc_id, sum(CASE WHEN kind <> '' THEN 1 ELSE 0 END + CASE WHEN mark <> '' THEN 1 ELSE 0 END) - 1 AS again, sum(CASE WHEN text = '' THEN 1 ELSE 0 END) AS empty FROM lines GROUP BY doc_id)
  SELECT doc_id, 'DUPLICATE_REVISION_ID' AS code, 'error' AS severity, CAST(again AS BIGINT) AS n FROM found WHERE again > 0 UNION ALL SELECT doc_id, 'EMPTY_TEXT_ELEMENT', 'warning', CAST(empty AS BIGINT) FROM found WHERE empty > 0""",
    "changes_accepted": f"WITH {_views('accepted')} SELECT doc_id, string_agg(text, chr(10) ORDER BY idx) AS text, false AS pending FROM view GROUP BY doc_id",
    "changes_rejected": f"WITH {_views('rejected')} SELECT doc_id, string_agg(text, chr(10) ORDER BY idx) AS text, false AS pending FROM view GROUP BY doc_id",
    "markup_accepted": f"WITH {_views('accepted')} SELECT doc_id, idx, text FROM view",
    "markup_rejected": f"WITH {_views('rejected')} SELECT doc_id, idx, text FROM view",
}
