"""Exact duplicates by content sort.

Texts are normalised by deleting every character of ``[\\x20\\x09-\\x0D]``. The
range partitioner's sampled splitters deal the normalised bytes out, an external
sort places equal texts side by side, and each row is compared in full with its
neighbours. Of equal texts the row with the most code points in the original
stays, then the smallest doc_id.

A text that more than ``HOT_ROWS`` rows and one row in 4096 share is salted by the
rows' numbers, a salt for each ``HOT_ROWS`` rows or 4096th of all, so its rows lie in
several ranges whatever their ids; the winners of its salts, a few rows, are compared
in full once more. There are fewer than 4096 such texts, with fewer than 8192 salts.

Nulls: a null text is empty; a null doc_id comes after all others. Of repeated
rows one stays. Empty texts are equal to each other. An empty table gives no
rows. Very long texts are compared whole. ``deduplicated`` keeps all columns,
whatever their names; ``judge`` takes only doc_id, text and the ``extra`` ones.
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import named, stored, whole_row

BLANK = r"[\x20\x09-\x0D]+"
HOT_ROWS, HOT_SHARE, BEGIN = 1_000, 4_096, 64


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANK, "")


def _salted(rows: DataFrame, hot_rows: int) -> tuple[DataFrame, bool]:
    """Adds ``_salt``: 0, but for texts that very many rows share."""
    counts = rows.groupBy("_key").agg(F.count("*").alias("_n"))
    seen = counts.agg(F.sum("_n").alias("all"), F.max("_n").alias("most")).first()
    limit = max(hot_rows, (seen["all"] or 0) // HOT_SHARE)
    hot = [(r["_key"], -(-r["_n"] // limit)) for r in counts.where(F.col("_n") > limit).collect()] if (seen["most"] or 0) > limit else []  # fewer than HOT_SHARE
    if not hot:
        return rows.withColumn("_salt", F.lit(0)), False
    listed = rows.sparkSession.createDataFrame(hot, "_key long, _salts long")
    salt = F.when(F.col("_salts").isNotNull(), F.pmod(F.xxhash64("_number"), F.col("_salts")) + 1).otherwise(0).cast("int")
    # The number says nothing but which salt a row has; a task that runs again numbers its rows alike.
    numbered = rows.withColumn("_number", F.monotonically_increasing_id())
    return numbered.join(F.broadcast(listed), "_key", "left").withColumn("_salt", salt).drop("_salts", "_number"), True


def judge(docs: DataFrame, hot_rows: int = HOT_ROWS, extra: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row (and the columns named in ``extra``)."""
    own = [named(c).alias(f"_x{i}") for i, c in enumerate(extra)]
    rows = docs.select("doc_id", F.char_length(F.coalesce("text", F.lit(""))).alias("_len"), normalised(F.col("text")).alias("_norm"), *own)
    rows, hot = _salted(rows.withColumn("_key", F.xxhash64("_norm")), hot_rows)
    # Splitters are sampled from beginnings and hashes, so that the sample stays small where texts are long.
    # A constant salt would hide from the window that its rows lie together, so it's named only where it varies.
    dealt = ["_begin", "_key", "_salt"] if hot else ["_begin", "_key"]
    placed = rows.withColumn("_begin", F.substring("_norm", 1, BEGIN)).repartitionByRange(*dealt)
    group = Window.partitionBy(*dealt, "_norm")
    best = [F.col("_len").desc(), F.col("doc_id").asc_nulls_last()]
    place = F.row_number().over(group.orderBy(*best))
    first = placed.withColumns({"_place": place, "_keep": F.first("doc_id").over(group.orderBy(*best)), "_most": F.first("_len").over(group.orderBy(*best)), "_n": F.count("*").over(group)})
    slim = [F.col("doc_id"), F.col("_place"), F.col("_keep"), F.col("_most"), F.col("_n"), F.col("_salt"), F.sha2("_norm", 256).alias("text_sha256"), *[F.col(f"_x{i}") for i in range(len(extra))]]
    back = [F.col(f"_x{i}").alias(c) for i, c in enumerate(extra)]
    if not hot:
        return first.select(*slim).select("doc_id", F.col("_keep").alias("keep_id"), F.col("_n").cast("long").alias("group_size"), (F.col("_place") == 1).alias("kept"), "text_sha256", *back)
    judged = stored(first.select(*slim, F.when((F.col("_salt") > 0) & (F.col("_place") == 1), F.col("_norm")).alias("_head")), "dedup-salted")
    heads = judged.where(F.col("_head").isNotNull()).withColumn("_w", F.struct((-F.col("_most")).alias("a"), F.col("_keep").isNull().alias("b"), F.col("_keep").alias("c"), F.col("_salt").alias("d")))
    merged = heads.groupBy("_head").agg(F.min("_w").alias("_w"), F.sum("_n").alias("_all"), F.first("text_sha256").alias("_sha")).select("_sha", "_all", F.col("_w.c").alias("_won"), F.col("_w.d").alias("_won_salt"))
    cold = judged.where("_salt = 0").select("doc_id", F.col("_keep").alias("keep_id"), F.col("_n").cast("long").alias("group_size"), (F.col("_place") == 1).alias("kept"), "text_sha256", *back)
    warm = judged.where("_salt > 0").join(F.broadcast(merged), F.col("text_sha256") == F.col("_sha"))  # a row for each hot text
    return cold.unionByName(warm.select("doc_id", F.col("_won").alias("keep_id"), F.col("_all").cast("long").alias("group_size"), ((F.col("_place") == 1) & (F.col("_salt") == F.col("_won_salt"))).alias("kept"), "text_sha256", *back))


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows that stay, with all their columns."""
    packed = docs.select("doc_id", "text", whole_row(docs))
    return judge(packed, extra=("_row",)).where("kept").select("_row.*")


SQL = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY n DESC, doc_id NULLS LAST) AS place, first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id NULLS LAST) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM t)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(norm) AS text_sha256 FROM r
"""
