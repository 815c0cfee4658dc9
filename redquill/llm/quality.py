"""Quality by a support vector machine over naive-Bayes features.

Indicators of n-grams (words: 1 and 2; word shapes such as ``Xx,`` or ``X!!``:
1 to 3) are hashed into 2^18 places and scaled by the place's log-count ratio
between the classes. A linear model with hinge loss is fitted by dual
coordinate descent on a bounded sample of labelled texts. Margins out of fold
fit the logistic curve that turns a margin into a score.

Nulls and empty texts have no indicator and score by the intercept alone. Very
long texts are read whole. Repeated rows score alike. With labels of one class
only, every text scores as that class; with none, 0.5. An empty table gives no
rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, held_out, labelled_sample, logistic, remembers, small_batches, whole_row

BITS = 18
#: Labelled texts of each class that a model is fitted on at most.
PER_CLASS = 3_000
THRESHOLD = 0.3
_DIGIT, _RUN = re.compile(r"\d+"), re.compile(r"(.)\1{2,}")


def shape(chunk: str) -> str:
    """``Hello,`` is ``Ax,``; ``WORD!!`` is ``A!!``; digits are ``9``."""
    s = _DIGIT.sub("9", chunk)
    s = "".join("x" if c.islower() else "A" if c.isalpha() else c for c in s)
    s = re.sub(r"x+", "x", re.sub(r"A{2,}", "AA", s))
    return _RUN.sub(r"\1\1\1", s)[:12]


def _hash(s: str) -> int:
    return zlib.crc32(s.encode("utf-8", "surrogatepass"))


_MEMO = Words(32 << 20)


def _codes(text: str) -> np.ndarray:
    remembers("quality", _MEMO.clear)
    chunks = text.split()
    got = list(map(_MEMO.get, chunks))
    if None in got:
        new = {c: _hash(c.lower()) << 32 | _hash(shape(c)) for c in {c for c, g in zip(chunks, got) if g is None}}
        got = [new[c] if g is None else g for c, g in zip(chunks, got)]
        _MEMO.keep(new)
    return np.array(got, np.uint64)


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x ^ np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    return ((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - BITS)


def indicators(text: str) -> np.ndarray:
    """Sorted places of the n-grams that a text has."""
    code = _codes(text)
    word, form = code >> np.uint64(32), code & np.uint64(0xFFFFFFFF)
    m = np.uint64(0x100000001B3)
    two = form[:-1] * m + form[1:]
    found = [_mix(word, 1), _mix(word[:-1] * m + word[1:], 2), _mix(form, 3), _mix(two, 4), _mix(two[:-1] * m + form[2:], 5)]
    return np.unique(np.concatenate(found)).astype(np.int32)


@dataclass
class Model:
    weights: np.ndarray
    curve: tuple[float, float]

    def margin(self, places: np.ndarray) -> float:
        return float(self.weights[places].sum() / np.sqrt(len(places) + 1.0))

    def score(self, text: str) -> float:
        a, b = self.curve
        return float(1 / (1 + np.exp(-np.clip(a + b * self.margin(indicators(text)), -30, 30))))


def dual_coordinate_descent(rows: list[np.ndarray], ratio: np.ndarray, y: np.ndarray, c: float = 1.0, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """Weights over places (already times the ratio) for hinge loss.

    A row's features are ``ratio`` at its places, over the root of their number.
    Classes weigh alike in the loss, however many rows each has.
    """
    w, alpha = np.zeros(len(ratio)), np.zeros(len(rows))
    rng = np.random.default_rng(seed)
    values = [ratio[r] / np.sqrt(len(r) + 1.0) for r in rows]
    square = np.array([v @ v for v in values]) + 1e-9
    most = np.where(y > 0, c * len(y) / (2 * max(1, (y > 0).sum())), c * len(y) / (2 * max(1, (y < 0).sum())))
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            slope = y[i] * (w[rows[i]] @ values[i]) - 1
            new = min(max(alpha[i] - slope / square[i], 0.0), most[i])
            if new != alpha[i]:
                moved = max(moved, abs(new - alpha[i]))
                w[rows[i]] += (new - alpha[i]) * y[i] * values[i]
                alpha[i] = new
        if moved < 1e-3:
            break
    return w * ratio


def _fitted(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    places = 1 << BITS
    count = [np.bincount(np.concatenate([r for r, t in zip(rows, y) if t == s] or [np.zeros(0, np.int32)]), minlength=places) + 1.0 for s in (1, -1)]
    ratio = np.log(count[0] / ((y > 0).sum() + 2)) - np.log(count[1] / ((y < 0).sum() + 2))
    return dual_coordinate_descent(rows, ratio, y)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    sample = labelled_sample(docs, labels, "quality", per_class).groupBy("text").agg(F.max("y").alias("y"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"h": [_hash(t) for t in batch["text"]], "y": batch["y"], "places": [indicators(t).tobytes() for t in batch["text"]]})

    got = sample.mapInPandas(run, "h long, y int, places binary").toPandas().sort_values(["h", "y"])
    rows, y = [np.frombuffer(p, np.int32) for p in got["places"]], np.where(got["y"] == 1, 1, -1)
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(1 << BITS), (0.0 if not len(y) else 10.0 * float(y[0]), 0.0))
    fold = got["h"].to_numpy() % 3
    margins = np.zeros(len(y))
    for k in range(3):
        train, test = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        if len(set(y[train].tolist())) == 2:
            w = _fitted([rows[i] for i in train], y[train])
            margins[test] = [w[rows[i]].sum() / np.sqrt(len(rows[i]) + 1.0) for i in test]
    a, b = logistic(margins[:, None], (y > 0).astype(float))
    return Model(_fitted(rows, y).astype(np.float32), (float(a), float(b)))


def score(texts: Column, model: Model, spark: SparkSession) -> Column:
    """The score of a column of texts."""
    shared = spark.sparkContext.broadcast(model)
    small_batches(spark)

    def run(batch: pd.Series) -> pd.Series:
        return pd.Series([shared.value.score(t or "") for t in batch], dtype=float)

    return F.pandas_udf(run, "double")(texts)


def quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, per_class: int = PER_CLASS) -> DataFrame:
    own = score(F.col("text"), fit(docs, labels, per_class), docs.sparkSession)
    scored = docs.select("doc_id", own.alias("score"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, per_class: int = PER_CLASS) -> DataFrame:
    """The rows that the classifier accepts, with all their columns."""
    model = fit(docs, labels, per_class)
    rows = docs.select(whole_row(docs), score(F.col("text"), model, docs.sparkSession).alias("_score"))
    return rows.where(F.col("_score") >= threshold).select("_row.*")
