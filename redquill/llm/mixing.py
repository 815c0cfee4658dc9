"""Mixing sources to target weights by cube-method balanced sampling.

Sources in order of code point (null last) weigh 1, 2, 3, repeating. They share
all words; a target stops at ``cap`` times its source's words and the excess is
shared again by weight, which is one level of water: target = least(cap x size,
level x weight). Every document of a source is taken floor(ratio) times; the
rest of the ratio is its inclusion probability for one more time.

The cube method decides these: probabilities move through the null space of the
balancing constraints (documents and words), so both totals of a source stay as
they are, until at most two documents of a group are undecided. Groups are
blocks of a source, about ``BLOCK`` rows each whatever the source's size; the
undecided of all blocks form the next round's groups, until one group a source
is left, which lands by one systematic draw; a few changes of place in that group
then bring the words back to the target. Draws are seeded by source, group
and round, so reruns agree.

Rows of one doc_id, source and text are counted before they move and dealt out
again by number, so that a row that repeats very often fills many groups.

Nulls: a null source is a source, the last; a null text has no words; a null
doc_id is a value like another. Repeated rows are decided each. With no words at
all every target is 0 and nothing is taken. An empty table gives no rows. Of a very
long text only the number of words moves. ``mix`` ignores other columns;
``mixed_documents`` keeps them all, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, whole_row

BLOCK, SEED, CAP = 2_000, 20_240, 3.0
#: Repeats of one row that are dealt out by one task.
REPEATS = 100_000
WORD = r"[^\x20\x09-\x0D]+"
_EPS = 1e-9


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(units: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: float = CAP) -> DataFrame:
    """A row for each source: source, source_size, target.

    Works on one row for each source, after the sum over documents.
    """
    sums = units.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_docs"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weighed = sums.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")).cast("double"))
    full = cap * F.col("source_size")
    ordered = Window.orderBy(full / F.col("weight"), F.col("source").asc_nulls_last())
    before, everything = ordered.rowsBetween(Window.unboundedPreceding, -1), ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum(full).over(before), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    # A source is below its cap from the first place where the level of the rest is at most its own; the level there holds for all the rest.
    leveled = weighed.withColumn("_level", level).withColumn("_open", F.col("_level") * F.col("weight") <= full)
    water = F.min(F.when(F.col("_open"), F.col("_level"))).over(Window.orderBy(full / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    first = F.first(F.when(F.col("_open"), F.col("_level")), ignorenulls=True).over(everything)
    return leveled.withColumn("target", F.least(full, F.coalesce(first, water, F.lit(np.inf)) * F.col("weight"))).select("source", "source_size", "source_docs", "target")


def flight(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Probabilities after the flight: all but two at most are 0 or 1.

    Keeps the sum of p and, while three are undecided, the sum of p x size.
    """
    p = p.astype(float).tolist()
    s = size.astype(float).tolist()
    draw = iter(rng.random(2 * len(p) + 8).tolist())
    active: list[int] = []

    def move(units: list[int], direction: list[float]) -> None:
        up = min([((1 - p[u]) if d > 0 else p[u]) / abs(d) for u, d in zip(units, direction) if d])
        down = min([(p[u] if d > 0 else (1 - p[u])) / abs(d) for u, d in zip(units, direction) if d])
        step = up if next(draw) * (up + down) < down else -down
        for u, d in zip(units, direction):
            x = p[u] + step * d
            p[u] = 0.0 if x < _EPS else 1.0 if x > 1 - _EPS else x

    for i in range(len(p)):
        if not _EPS < p[i] < 1 - _EPS:
            p[i] = float(round(p[i]))
            continue
        active.append(i)
        while len(active) >= 2:
            twins = next(((a, b) for k, a in enumerate(active) for b in active[k + 1 :] if s[a] == s[b]), None)
            if twins:
                move(list(twins), [1.0, -1.0])
            elif len(active) == 3:
                a, b, c = active
                scale = max(abs(s[c] - s[b]), abs(s[a] - s[c]), abs(s[b] - s[a]))
                move(active, [(s[c] - s[b]) / scale, (s[a] - s[c]) / scale, (s[b] - s[a]) / scale])
            else:
                break
            active = [u for u in active if 0.0 < p[u] < 1.0]
    return np.array(p)


def landing(p: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Decides what the flight left, by one systematic draw: the count stays within one."""
    u = rng.random()
    total = np.concatenate([[0.0], np.cumsum(p)]) + u
    return (np.floor(total[1:] + _EPS) > np.floor(total[:-1] + _EPS)).astype(float)


def rebalanced(p0: np.ndarray, x: np.ndarray, size: np.ndarray, turns: int = 4) -> np.ndarray:
    """Lessens what the landing put on or off the words, by changing places.

    Each turn one taken document and one not taken (or a single one) of the
    group change places, those that bring the words nearest to ``p0 x size``.
    """
    x, size = x.copy(), size.astype(float)
    for _ in range(turns):
        over = float(((x - p0) * size).sum())
        out, into = np.flatnonzero((x > 0.5) & (p0 < 1 - _EPS)), np.flatnonzero((x < 0.5) & (p0 > _EPS))
        if not len(out) and not len(into):
            break
        gain, loss = np.concatenate([[0.0], size[into]]), np.concatenate([[0.0], size[out]])
        order = np.argsort(gain, kind="stable")
        at = np.clip(np.searchsorted(gain[order], loss - over), 1, len(gain) - 1) if len(gain) > 1 else np.zeros(len(loss), int)
        best = min(((abs(over - loss[i] + gain[order[j]]), i, int(order[j])) for i in range(len(loss)) for j in {int(at[i]), max(int(at[i]) - 1, 0)}), default=(abs(over), 0, 0))
        if best[0] >= abs(over) - 0.5:
            break
        if best[1]:
            x[out[best[1] - 1]] = 0.0
        if best[2]:
            x[into[best[2] - 1]] = 1.0
    return x


def _seed(source, group: int, turn: int) -> np.random.Generator:
    return np.random.default_rng([SEED, turn, group & 0xFFFFFFFF, *(b"\0" if source is None or source is pd.NA else b"\1" + str(source).encode())])


def _round(turn: int, last: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "_h", "doc_id", "_k"], ascending=[False, True, True, True], kind="stable", ignore_index=True)
        source = pdf["source"].iloc[0]
        rng = _seed(None if pd.isna(source) else source, int(pdf["_g"].iloc[0]), turn)
        p = flight(pdf["p"].to_numpy(), pdf["size"].to_numpy(), rng)
        if last:
            open_ = (p > 0) & (p < 1)
            p[open_] = landing(p[open_], rng)
            p = rebalanced(pdf["p"].to_numpy(), p, pdf["size"].to_numpy())
        return pdf.assign(p=p)

    return run


def _key(docs: DataFrame) -> list[Column]:
    # as text: an id that may be null would turn to floating point in pandas
    return [F.col("doc_id").cast("string").alias("doc_id"), F.col("source"), F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("_h")]


def _units(docs: DataFrame) -> DataFrame:
    """A stored row for each document: doc_id, source, size, _h, _k (its number among ``_same`` rows alike)."""
    counted = stored(docs.select(*_key(docs), n_words(F.col("text")).alias("size")).groupBy("doc_id", "source", "_h", "size").agg(F.count("*").alias("_same")), "mix-counted")
    several = (counted.agg(F.max("_same")).first()[0] or 1) > REPEATS
    runs = counted.withColumn("_run", F.explode(F.sequence(F.lit(0), F.floor((F.col("_same") - 1) / REPEATS))))
    runs = runs.repartition("_h", "_run") if several else runs
    upto = F.least(F.col("_same"), (F.col("_run") + 1) * REPEATS) - 1
    return runs.withColumn("_k", F.explode(F.sequence(F.col("_run") * REPEATS, upto))).drop("_run")


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: float = CAP, block: int = BLOCK) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, copies for every row, ``_h`` (a hash of id and text), and which ``_k`` of ``_same`` rows alike it is."""
    kind = docs.schema["doc_id"].dataType
    units = _units(docs)
    plan = targets(units, weights, cap)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = (
        units.join(plan.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
        .drop("_s")
        .withColumn("_ratio", ratio)
        .withColumn("base", F.floor(F.col("_ratio") + _EPS).cast("long"))
        .withColumn("p", F.greatest(F.col("_ratio") - F.col("base"), F.lit(0.0)))
        .withColumn("_blocks", F.ceil(F.col("source_docs") / block).cast("long"))
        .withColumn("_g", F.pmod(F.xxhash64("_h", "_k"), F.col("_blocks")))
        .drop("_ratio", "source_docs")
    )
    schema = rows.schema
    most = plan.agg(F.max("source_docs")).first()[0] or 0
    groups, turn, done = -(-most // block), 0, []
    while True:
        last = groups <= 1
        moved = rows.groupBy("source", "_g").applyInPandas(_round(turn, last), schema)
        if last:
            done.append(moved)
            break
        moved = stored(moved, "mix-round")
        undecided = (F.col("p") > 0) & (F.col("p") < 1)
        done.append(moved.where(~undecided))
        join = max(2, block // 4)  # two rows are left of each group, at most
        groups = -(-groups // join)
        rows = moved.where(undecided).withColumn("_g", F.floor(F.col("_g") / join).cast("long"))
        turn += 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    copies = F.col("base") + F.round("p").cast("long")
    return out.select(F.col("doc_id").cast(kind).alias("doc_id"), "source", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"), "_h", "_k", "_same")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents as the mix takes them: each row as often as it is taken.

    Texts move once, to what is known of their id, source and hash. Rows alike in
    these may differ elsewhere; they are numbered, in parts of a key, by their places.
    """
    taken = stored(mix(docs).select(F.col("_h").alias("_hash"), F.col("doc_id").cast("string").alias("_id"), F.col("source").alias("_src"), "copies", "_k", "_same"), "mix-taken")
    key = [k.alias(n) for k, n in zip(_key(docs), ("_id", "_src", "_hash"))]
    same = lambda a, b: (a["_hash"] == b["_hash"]) & a["_id"].eqNullSafe(b["_id"]) & a["_src"].eqNullSafe(b["_src"])
    rows = docs.select(whole_row(docs), *key)
    lone = taken.where("_same = 1 and copies > 0")
    got = rows.join(lone, same(rows, lone)).select("_row", "copies")
    if taken.where("_same > 1").limit(1).count():
        numbered = docs.select(whole_row(docs), *key, F.monotonically_increasing_id().alias("_number")).withColumn("_part", F.pmod(F.xxhash64("_number"), F.lit(64)))
        repeated = taken.where("_same > 1 and _k = 0")
        several = stored(numbered.join(repeated.select("_hash", "_id", "_src"), same(numbered, repeated), "left_semi"), "mix-repeated")
        names = ["_hash", "_id", "_src"]
        parts = several.groupBy(*names, "_part").agg(F.count("*").alias("_n"))
        before = F.coalesce(F.sum("_n").over(Window.partitionBy(*names).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        starts = parts.select(*names, F.col("_part").alias("_p"), before.alias("_before"))
        placed = several.withColumn("_at", F.row_number().over(Window.partitionBy(*names, "_part").orderBy("_number")) - 1)
        placed = placed.join(starts, same(placed, starts) & (placed["_part"] == starts["_p"])).select("_row", *[placed[n] for n in names], (F.col("_at") + F.col("_before")).alias("_place"))
        which = taken.where("_same > 1 and copies > 0")
        got = got.unionByName(placed.join(which, same(placed, which) & (placed["_place"] == which["_k"])).select("_row", "copies"))
    return got.select("_row", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select("_row.*")
