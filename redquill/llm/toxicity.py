"""Toxic passages by maximum-scoring segments.

Fitting: in a bounded sample of labelled texts (equal texts once), every word's
features are the word and its beginnings of 3 to 6 letters. The log-odds of a
feature between the classes, by documents that hold it, takes a Dirichlet prior
that follows the feature's share of the whole sample, and is shrunk to the near end
of its interval of ``SURE`` standard errors; a word scores as its strongest
feature less a small drift, so an ordinary text drifts downward.

Scanning: one linear pass finds all maximal scoring segments of a text. Scores
of segments are extreme values: lambda solves E[exp(lambda s)] = 1 over clean
words, K is by the median best segment of clean texts, S' = lambda S - ln(K n)
is the normalised score in a text of n words, and a segment is significant if
exp(-S'), the number as good that a clean text has, is below 0.05. A logistic
curve over the best S' and the sum over significant segments, fitted on the
sample, gives the score.

Nulls and empty texts: no words, no segment; they score as a text in which
nothing was found. Extra columns, whatever their names, are ignored. Very long texts are scanned whole, in linear time. Repeated
rows score alike. With no labels of one class every text scores 0. An empty
table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, held_out, labelled_sample, logistic, small_batches

#: Labelled texts of each class that a model is fitted on at most.
PER_CLASS = 6_000
#: Features that a model keeps at most, those of the greatest z-value; None: all that are significant.
FEATURES: int | None = 50_000
LEAST_Z, SURE, LEAST_DOCS, DRIFT, PRIOR = 2.5, 1.64, 3, 0.05, 50.0
#: A segment is significant if fewer than 0.05 as good are expected in a clean text.
SIGNIFICANT = float(-np.log(0.05))
_TRIM = re.compile(r"^[\W_]+|[\W_]+$")


def features(word: str) -> list[str]:
    """A word's features; ``^`` marks a beginning."""
    return [word, *("^" + word[:k] for k in range(3, 7) if len(word) > k)]


def words_of(text: str) -> list[str]:
    return [x for x in (_TRIM.sub("", c) for c in text.lower().split()) if x]


@dataclass
class Model:
    odds: dict[str, float]  # feature: log-odds, shrunk
    lam: float = 0.0
    log_k: float = 0.0
    curve: tuple[float, float, float] = (-20.0, 0.0, 0.0)
    memo: Words = field(default_factory=Words, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"memo": Words()}

    def word_score(self, chunk: str) -> float:
        word = _TRIM.sub("", chunk)
        if not word:
            return 0.0
        return max((self.odds[f] for f in features(word) if f in self.odds), key=abs, default=0.0) - DRIFT

    def scores(self, text: str) -> np.ndarray:
        chunks = text.lower().split()
        got = list(map(self.memo.get, chunks))
        if None in got:
            new = {c: self.word_score(c) for c in {c for c, g in zip(chunks, got) if g is None}}
            got = [new[c] if g is None else g for c, g in zip(chunks, got)]
            self.memo.keep(new)
        return np.array(got, float)

    def normalised(self, best: float, n: int) -> float:
        return self.lam * best - self.log_k - np.log(max(n, 1))

    def evidence(self, scores: np.ndarray) -> tuple[float, float, list[tuple[int, int, float]]]:
        """Best normalised score, sum over significant segments, the segments."""
        segments = [(a, b, self.normalised(s, len(scores))) for a, b, s in maximal_segments(scores)]
        found = [x for x in segments if x[2] > SIGNIFICANT]
        return max((x[2] for x in segments), default=self.normalised(0.0, len(scores))), sum(x[2] for x in found), found

    def probability(self, best, total):
        a, b, c = self.curve
        return 1 / (1 + np.exp(-np.clip(a + b * np.maximum(best, -10) + c * np.log1p(total), -30, 30)))


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments as (start, end, score), in linear time.

    Runs of one sign are joined first: a maximal segment begins and ends with a
    whole run of positive scores.
    """
    positive = scores > 0
    if not positive.any():
        return []
    edge = np.flatnonzero(np.diff(np.concatenate([[0], positive.view(np.int8), [0]])))
    total = np.concatenate([[0.0], np.cumsum(scores)])
    found: list[list[float]] = []  # start, end, total before, total after
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
        now = [a, b, total[a], total[b]]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= now[2]:
                j = int(found[j][4])
            if j < 0 or found[j][3] >= now[3]:
                break
            now = [found[j][0], now[1], found[j][2], now[3]]
            del found[j:]
        found.append([*now, j])
    return [(int(x[0]), int(x[1]), float(x[3] - x[2])) for x in found]


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        counts = (Counter(), Counter())
        for text, y in zip(batch["text"], batch["y"]):
            counts[int(y)].update({f for w in set(words_of(text)) for f in features(w)})
        names = list(counts[0].keys() | counts[1].keys())
        yield pd.DataFrame({"f": names, "clean": [counts[0][f] for f in names], "toxic": [counts[1][f] for f in names]})


def scale(value: np.ndarray, count: np.ndarray) -> float:
    """lambda of clean words' scores: the positive root of E[exp(lambda s)] = 1."""
    share = count / count.sum()
    if not (value > 0).any() or (share * value).sum() >= 0:
        return 1.0
    mean = lambda x: (share * np.exp(np.minimum(x * value, 500))).sum()
    low, high = 1e-6, 1.0
    while mean(high) < 1 and high < 1e3:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if mean(mid) < 1 else (low, mid)
    return float(low)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, most_features: int | None = FEATURES) -> Model:
    """A model from a bounded sample of the rows that are not held out."""
    sample = labelled_sample(docs, labels, "toxic", per_class).groupBy("text").agg(F.max("y").alias("y")).persist()
    try:
        sizes = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
        n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
        if not n0 or not n1:
            return Model({})
        counted = sample.mapInPandas(_counted, "f string, clean long, toxic long").groupBy("f").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
        prior = 0.25 + PRIOR * (F.col("clean") + F.col("toxic")) / (n0 + n1)
        odds = lambda k, n: F.log((k + prior) / F.greatest(n + 2 * PRIOR - k - prior, F.lit(0.5)))
        delta = odds(F.col("toxic"), n1) - odds(F.col("clean"), n0)
        z = delta / F.sqrt(1 / (F.col("toxic") + prior) + 1 / (F.col("clean") + prior))
        kept = counted.where(F.col("clean") + F.col("toxic") >= LEAST_DOCS).select("f", delta.alias("d"), z.alias("z")).where(F.abs("z") >= LEAST_Z)
        kept = kept if most_features is None else kept.orderBy(F.abs("z").desc(), "f").limit(most_features)
        model = Model({r["f"]: r["d"] * (1 - SURE / abs(r["z"])) for r in kept.collect()})
        spark = docs.sparkSession
        shared = spark.sparkContext.broadcast(model)

        def clean_words(batches):
            for batch in batches:
                n = Counter()
                for t in batch["text"]:
                    n.update(np.round(shared.value.scores(t), 3).tolist())
                yield pd.DataFrame({"s": list(n), "n": list(n.values())})

        rows = sample.where("y = 0").mapInPandas(clean_words, "s double, n long").groupBy("s").agg(F.sum("n").alias("n")).collect()
        model.lam = scale(np.array([r["s"] for r in rows]), np.array([r["n"] for r in rows]))
        ready = spark.sparkContext.broadcast(model)

        def weighed(batches):
            m = ready.value
            for batch in batches:
                scores = [m.scores(t) for t in batch["text"]]
                found = [sorted((m.normalised(s, len(x)) for _, _, s in maximal_segments(x)), reverse=True) or [m.normalised(0.0, len(x))] for x in scores]
                yield pd.DataFrame({"y": batch["y"], "raw": found})

        raw = sample.mapInPandas(weighed, "y int, raw array<double>").toPandas()
        best = np.array([x[0] for x in raw["raw"]])
        # Best segments of clean texts follow a Gumbel law; its median gives ln K.
        model.log_k = float(np.median(best[raw["y"] == 0]) + np.log(np.log(2)))
        best = best - model.log_k
        total = np.array([sum(v for v in np.asarray(x) - model.log_k if v > SIGNIFICANT) for x in raw["raw"]])
        w = logistic(np.column_stack([np.maximum(best, -10), np.log1p(total)]), raw["y"].to_numpy(float))
        model.curve = (float(w[0]), float(w[1]), float(w[2]))
        return model
    finally:
        sample.unpersist()


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, number of significant passages and words within them."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    small_batches(docs.sparkSession)

    def run(texts: pd.Series) -> pd.DataFrame:
        m = shared.value
        got = [m.evidence(m.scores(t or "")) for t in texts]
        p = m.probability(np.array([g[0] for g in got], float), np.array([g[1] for g in got], float))
        return pd.DataFrame({"score": p, "passages": [len(g[2]) for g in got], "passage_words": [sum(b - a for a, b, _ in g[2]) for g in got]})

    scored = F.pandas_udf(run, "score double, passages long, passage_words long")
    return docs.select("doc_id", scored("text").alias("_s")).select("doc_id", "_s.*")


def passages(docs: DataFrame, model: Model) -> DataFrame:
    """Every significant passage: doc_id, first word, end, text, normalised score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: pd.Series) -> pd.Series:
        m = shared.value
        return pd.Series([[(a, b, " ".join((t or "").split()[a:b]), s) for a, b, s in m.evidence(m.scores(t or ""))[2]] for t in texts], dtype=object)

    found = F.pandas_udf(run, "array<struct<first_word:long,end_word:long,passage:string,normalised:double>>")
    return docs.select("doc_id", F.explode(found("text")).alias("_p")).select("doc_id", "_p.*")


def toxicity(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, most_features: int | None = FEATURES) -> DataFrame:
    """doc_id, held_out, score, predicted, passages, passage_words for every row; other columns of the input are ignored."""
    scored = score(docs, fit(docs, labels, per_class, most_features))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "passages", "passage_words")
