"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import itertools
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    ``spark.checkpoint.dir`` is read from the session. Only where it is unset and
    all of Spark is one local process, as in tests, a temporary folder takes its
    place; on a cluster that is an error.
    """
    sc = spark.sparkContext
    place = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if place:
        return place.rstrip("/")
    now = sc._jsc.sc().getCheckpointDir()
    if now.isDefined():
        return now.get().rstrip("/")
    if sc.master != "local" and not sc.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    sc.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='redquill-')}")
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Rows that go to a Python worker at once, where the session has Spark's default of 10,000.
ARROW_ROWS = "1000"


def small_batches(spark: SparkSession) -> None:
    """Sends fewer rows to Python at once; what workers and the JVM hold follows from it. A session's own choice stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, ARROW_ROWS)


def named(column: str) -> Column:
    """A column by its exact name, dots and backticks included."""
    return F.col("`" + column.replace("`", "``") + "`")


def whole_row(df: DataFrame) -> Column:
    """A row's columns as one struct, out of the way of an operator's own names; ``_row.*`` gives them back."""
    return F.struct(*map(named, df.columns)).alias("_row")


def attach(rows: DataFrame, one: DataFrame, key: str, counts: DataFrame, n: str, spread: Column, share: int = 2_000, least: int = 1_000) -> DataFrame:
    """``rows`` with the columns of ``one``, which has a row for each key; ``counts`` says in ``n`` how many of ``rows`` a key has.

    A key with more than ``least`` rows and one in ``share`` of all is split by
    ``spread``: its row of ``one`` is repeated for each part, so no task takes all
    of a hot key. There are fewer than ``share`` such keys; only they are broadcast.
    """
    seen = counts.agg(F.sum(n).alias("all"), F.max(n).alias("most")).first()
    limit = max(least, (seen["all"] or 0) // share)
    if (seen["most"] or 0) <= limit:
        return rows.join(one, key)
    hot = F.broadcast(counts.where(F.col(n) > limit).select(key, F.ceil(F.col(n) / limit).cast("int").alias("_parts")))
    parts = F.coalesce("_parts", F.lit(1))
    dealt = rows.join(hot, key, "left").withColumn("_part", F.pmod(F.xxhash64(spread), parts).cast("int")).drop("_parts")
    repeated = one.join(hot, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return dealt.join(repeated, [key, "_part"]).drop("_part")


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows, written once as Parquet in the shared folder and read again.

    Cuts the lineage: a lost executor costs no recomputation of what precedes.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remainder5(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 5; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def held_out(doc_id: Column) -> Column:
    return remainder5(doc_id) == 0


#: Bytes that a Python worker's memory of words takes at most, by estimate.
MEMORY_BYTES = 64 << 20
_REMEMBERS: list = []


def remembers(name: str, forget) -> None:
    """Says whose words this Python worker remembers now; what another operator remembered is forgotten.

    Workers serve several operators one after the other, and the memory of one is of no use to the next.
    """
    if not _REMEMBERS or _REMEMBERS[0] != name:
        if _REMEMBERS:
            _REMEMBERS[1]()
        _REMEMBERS[:] = [name, forget]


class Words(dict):
    """What a Python worker remembers of words, in at most about ``most`` bytes.

    Where new words would exceed that, the later half goes: the words that were
    met first are the frequent ones. More at once than half of it isn't kept.
    """

    def __init__(self, most: int = MEMORY_BYTES, each: int = 170):
        super().__init__()
        self.most, self.each, self.held = most, each, 0

    def _size(self, words: dict) -> int:
        values = sum(map(len, words.values())) if isinstance(next(iter(words.values()), None), bytes) else 0
        return len(words) * self.each + sum(map(len, words)) + values

    def keep(self, new: dict) -> None:
        size = self._size(new)
        if size > self.most // 2:
            return
        while self and self.held + size > self.most:
            for word in list(itertools.islice(reversed(self), (len(self) + 1) // 2)):
                del self[word]
            self.held = self._size(self)
        self.held += size
        self.update(new)

    def clear(self) -> None:
        super().clear()
        self.held = 0


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50, ridge: float = 1e-2) -> np.ndarray:
    """Weights (intercept first) of a logistic curve, by Newton steps with a small ridge."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Characters of the labelled texts of each class that a model is fitted on, at most.
SAMPLE_CHARS = 64 << 20


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, chars: int = SAMPLE_CHARS) -> DataFrame:
    """Training rows (doc_id, text, y): at most ``per_class`` of each class, and no more once their texts reach ``chars`` characters.

    Rows held out are never among them. The choice is by a hash of the id, so
    reruns agree; the bounds are on what a model is fitted on, nothing else.
    """
    train = (
        labels.select("doc_id", F.col(label).cast("int").alias("y"))
        .where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("y").alias("y"))
        .withColumn("_h", F.xxhash64("doc_id", F.lit(17)))
    )
    picked = train.where("y = 1").orderBy("_h", "doc_id").limit(per_class).unionByName(train.where("y = 0").orderBy("_h", "doc_id").limit(per_class))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")
    before = Window.partitionBy("y").orderBy("_h", "doc_id", F.xxhash64("text")).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("_before", F.coalesce(F.sum(F.length("text")).over(before), F.lit(0))).where(F.col("_before") < chars).drop("_before", "_h")
