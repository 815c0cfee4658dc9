"""Document fingerprints by consistent weighted sampling.

A document is a weighted set: its words, lower-cased, each weighing as often as
it occurs. For every one of ``SAMPLES`` samples and every word, hashes of the
word give r and c from Gamma(2, 1) and beta from Uniform(0, 1); with
t = floor(ln(weight) / r + beta), the word with the least
ln(a) = ln(c) - r (t - beta) - r is the sample, together with t. Two documents
agree in a sample with the probability of their generalised Jaccard similarity,
sum of minima over sum of maxima. As ln(a) is a function of word, t and sample,
its bits stand for the pair; ``BITS`` of their hash are kept.

r and ln(c) are read from tables of ``LEVELS`` quantiles, built below from the
distribution itself, so that no logarithm is taken for each word and sample.

The next document is the one with the next lower doc_id (null ids come last,
rows of one id by hash of the text; after the last comes the first). Neighbours
meet in buckets of consecutive rows; the first row of the next bucket comes from
a list with one row for each bucket. The range partitioner's sampled splitters cut
the rows, by id and hash, into fine ranges; a bucket is as many of them as make
``BUCKET_ROWS`` rows or ``BUCKET_BYTES`` of text, so neither the spread of the ids nor
where the long texts lie matters. Only rows of one id and one text stay together.

Nulls and empty texts: a text without words has the fingerprint of zeros; two of
these are alike (1), and such a one is unlike any other (0). Very long texts are
read whole. An empty table gives no rows; a lone row is its own next. Ids may be
any long. Other columns of the input, whatever their names, are ignored.
DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLES, BLOCK, BITS, LEVELS = 64, 8, 16, 2_048
#: Rows and bytes of text that a bucket is meant to have, and fine ranges that a bucket's rows are cut into.
BUCKET_ROWS, BUCKET_BYTES, FINE = 2_000, 8 << 20, 4
#: Fine ranges at most: their list goes to the driver and to each task. Beyond it ranges and buckets grow with the rows.
MOST_RANGES = 200_000
BLANKS = " \t\n\x0b\x0c\r"
SEPARATOR = r"[\x20\x09-\x0D]+"


def gamma_quantiles(levels: int = LEVELS) -> list[float]:
    """Midpoint quantiles of Gamma(2, 1): solves 1 - (1 + x) exp(-x) = p."""
    out, x = [], 0.01
    for k in range(levels):
        p = (k + 0.5) / levels
        low, high = 0.0, 60.0
        for _ in range(60):
            x = (low + high) / 2
            low, high = (x, high) if 1 - (1 + x) * math.exp(-x) < p else (low, x)
        out.append(x)
    return out


def _minima() -> list[Column]:
    """The least ln(a) over a group's words, for each sample of a block."""
    gamma = gamma_quantiles()
    # Tables as one text each, which the optimiser turns into one literal; a literal array is an expression for each number.
    r_table, c_table = (F.split(F.lit(",".join(map(repr, xs))), ",").cast("array<double>") for xs in (gamma, [math.log(x) for x in gamma]))
    out = []
    for i in range(BLOCK):
        h = F.xxhash64(F.col("_word"), F.col("_block") + F.lit(i))
        r = F.get(r_table, h.bitwiseAND(F.lit(LEVELS - 1)).cast("int"))
        c = F.get(c_table, F.shiftrightunsigned(h, 11).bitwiseAND(F.lit(LEVELS - 1)).cast("int"))
        beta = F.shiftrightunsigned(h, 22).cast("double") * F.lit(2.0**-42)
        t = F.floor(F.col("_lnw") / r + beta)
        out.append(F.min(c - r * (t - beta) - r).alias(f"_m{i}"))
    return out


def signatures(texts: DataFrame, key: list[str], samples: int = SAMPLES) -> DataFrame:
    """``signature``, an array of ``samples`` numbers, for each key and ``_text``.

    Words are counted within the key's task: if the rows are dealt out by a
    part of the key already, nothing is shuffled.
    """
    words = texts.select(*key, F.explode(F.split(F.btrim(F.lower("_text"), F.lit(BLANKS)), SEPARATOR)).alias("_word"))
    counted = words.groupBy(*key, F.xxhash64("_word").alias("_word"), (F.col("_word") == "").alias("_none")).agg(F.count("*").alias("_n"))
    weighed = counted.select(*key, "_word", "_none", F.when(F.col("_n") == 1, 0.0).otherwise(F.log(F.col("_n"))).alias("_lnw"))
    blocked = weighed.withColumn("_block", F.explode(F.lit(list(range(0, samples, BLOCK)))))
    least = blocked.groupBy(*key, "_block").agg(*_minima(), F.bool_and("_none").alias("_empty"))
    short = F.array(*[F.xxhash64(F.col(f"_m{i}")).bitwiseAND(F.lit((1 << BITS) - 1)) for i in range(BLOCK)])
    whole = least.select(*key, "_empty", F.struct("_block", short.alias("s")).alias("_part")).groupBy(*key).agg(F.bool_and("_empty").alias("_empty"), F.flatten(F.transform(F.array_sort(F.collect_list("_part")), lambda x: x["s"])).alias("signature"))
    return whole.select(*key, F.when(F.col("_empty"), F.array_repeat(F.lit(0).cast("bigint"), samples)).otherwise(F.col("signature")).alias("signature"), "_empty")


def _splitters(keys: DataFrame, bucket_rows: int) -> list[tuple[int | None, int]]:
    """The first key (doc_id, _h) of each bucket but the first, in order. ``keys`` has doc_id, _h, _size."""
    n = keys.count()
    ranges = max(1, min(MOST_RANGES, -(-n * FINE // bucket_rows)))
    if n <= bucket_rows:
        return []
    order = [F.col("doc_id").desc_nulls_last(), F.col("_h")]
    dealt = keys.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id())
    key = F.struct(F.col("doc_id").isNull().alias("n"), F.bitwise_not("doc_id").alias("d"), F.col("_h").alias("h"))  # ~id falls as the id grows, for every long
    found = dealt.groupBy("_range").agg(F.min(key).alias("k"), F.count("*").alias("rows"), F.sum("_size").alias("size")).orderBy("_range").collect()
    out, rows, size = [], 0, 0
    share = max(1, n // (MOST_RANGES // FINE))
    for r in found:
        if rows and (rows + r["rows"] > max(bucket_rows, share) or size + r["size"] > BUCKET_BYTES * max(1, share // bucket_rows)):
            out.append((None if r["k"]["n"] else r["k"]["d"], r["k"]["h"]))
            rows = size = 0
        rows, size = rows + r["rows"], size + r["size"]
    return out


def _bucket(splitters: list[tuple[int | None, int]]) -> Column:
    """How many splitters a row's key (is null, ~doc_id, _h) reaches, by halving."""
    if not splitters:
        return F.lit(0).cast("long")
    texts = [",".join(str(int(f(x))) for x in splitters) for f in (lambda x: x[0] is None, lambda x: x[0] or 0, lambda x: x[1])]
    absent, ids, hashes = (F.split(F.lit(t), ",").cast(f"array<{kind}>") for t, kind in zip(texts, ("int", "bigint", "bigint")))
    own_absent, own_id = F.col("doc_id").isNull().cast("int"), F.coalesce(F.bitwise_not("doc_id"), F.lit(0).cast("long"))

    def reaches(k: Column) -> Column:
        a, i, h = F.get(absent, k), F.get(ids, k), F.get(hashes, k)
        return (own_absent > a) | ((own_absent == a) & ((own_id > i) | ((own_id == i) & (F.col("_h") >= h))))

    steps = [1 << b for b in reversed(range(len(splitters).bit_length()))]
    place = lambda n, step: F.when(n + step <= len(splitters), F.when(reaches(n + step - 1), n + step).otherwise(n)).otherwise(n)
    return F.aggregate(F.lit(steps), F.lit(0), place).cast("long")


def _bucketed(docs: DataFrame, bucket_rows: int) -> DataFrame:
    """Rows (bucket, doc_id, _h, _text), and as ``_ghost`` in each bucket the row that follows its last."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("_h"), text.alias("_text"))
    splitters = _splitters(rows.select("doc_id", "_h", F.octet_length("_text").cast("long").alias("_size")), bucket_rows)
    rows = rows.withColumn("bucket", _bucket(splitters)).select("bucket", "doc_id", "_h", "_text")
    key = F.struct(F.col("doc_id").isNull().alias("n"), F.bitwise_not("doc_id").alias("d"), F.col("_h").alias("h"))
    first = rows.groupBy("bucket").agg(F.min(key).alias("_first"))
    # The row after a bucket's last is the next bucket's first; after the last bucket comes the first.
    places = Window.orderBy("bucket")  # one row for each bucket
    before, last = F.lag("bucket").over(places), F.last("bucket").over(places.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    heads = first.select("bucket", "_first", F.coalesce(before, last).alias("_to"))
    follow = rows.join(F.broadcast(heads), "bucket").where(key == F.col("_first"))  # rows alike may be several; one would do
    ghosts = follow.select(F.col("_to").alias("bucket"), F.lit(None).cast("long").alias("doc_id"), "_h", "_text", F.lit(1).alias("_ghost"))
    # A task takes one bucket or a few: its words are counted in memory, and tasks joined together would spill.
    return rows.withColumn("_ghost", F.lit(0)).unionByName(ghosts).repartition(len(splitters) + 1, "bucket")


def fingerprints(docs: DataFrame, samples: int = SAMPLES, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    The edited text has the last floor(n / 2) code points replaced by the first
    as many (or all) of the next document.
    """
    order = Window.partitionBy("bucket").orderBy("_ghost", F.col("doc_id").desc_nulls_last(), "_h")
    rows = _bucketed(docs, bucket_rows).withColumns({"_row": F.col("bucket") * F.lit(2**32) + F.row_number().over(order), "_next": F.lead("_text").over(order)})
    n = F.char_length("_text").cast("long")
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring(F.col("_text"), F.lit(1), F.col("n_chars").cast("int") - half), F.substring(F.coalesce("_next", F.lit("")), F.lit(1), half))
    rows = rows.withColumn("n_chars", n).select("bucket", "_row", "_ghost", "doc_id", "n_chars", "_text", F.when(F.col("_ghost") == 0, edited).alias("_edited"))
    both = rows.select("bucket", "_row", F.posexplode(F.array("_text", "_edited")).alias("_which", "_text")).where(F.col("_text").isNotNull())
    signed = signatures(both, ["bucket", "_row", "_which"], samples)
    text = F.when(F.col("_empty"), F.repeat(F.lit("0"), F.lit(samples * BITS // 4))).otherwise(F.array_join(F.transform("signature", lambda x: F.lpad(F.lower(F.hex(x)), BITS // 4, "0")), ""))
    signed = signed.select("_row", "_which", text.alias("_f"))
    # Each signature goes to its own row and, as the next document's, to the row before.
    places = F.when(F.col("_which") == 0, F.array(F.struct(F.col("_row").alias("r"), F.lit(0).alias("w")), F.struct((F.col("_row") - 1).alias("r"), F.lit(2).alias("w")))).otherwise(F.array(F.struct(F.col("_row").alias("r"), F.lit(1).alias("w"))))
    sent = signed.select(F.explode(places).alias("_p"), "_f").select(F.col("_p.r").alias("_row"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("n_chars"), F.lit(None).cast("string").alias("edited_sha256"), *[F.when(F.col("_p.w") == w, F.col("_f")).alias(f"_f{w}") for w in range(3)])
    own = rows.where("_ghost = 0").select("_row", "doc_id", "n_chars", F.sha2("_edited", 256).alias("edited_sha256"), *[F.lit(None).cast("string").alias(f"_f{w}") for w in range(3)])
    met = own.unionByName(sent).groupBy("_row").agg(*[F.max(c).alias(c) for c in ("doc_id", "n_chars", "edited_sha256", "_f0", "_f1", "_f2")]).where(F.col("edited_sha256").isNotNull())
    return met.select("doc_id", "n_chars", "edited_sha256", F.col("_f0").alias("fingerprint"), F.col("_f1").alias("edited_fingerprint"), alike(F.col("_f0"), F.col("_f1"), samples).alias("near_edited"), alike(F.col("_f0"), F.col("_f2"), samples).alias("near_next"))


def alike(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """Share of equal samples of two fingerprints; 0 if just one has no words."""
    width = BITS // 4
    zeros = F.lit("0" * (samples * width))
    at = F.sequence(F.lit(0), F.lit(samples - 1))
    same = F.aggregate(at, F.lit(0), lambda n, i: n + F.when(F.substring(a, i * width + 1, F.lit(width)) == F.substring(b, i * width + 1, F.lit(width)), 1).otherwise(0))
    return F.when(a == b, 1.0).when((a == zeros) | (b == zeros), 0.0).otherwise(same / F.lit(float(samples)))
