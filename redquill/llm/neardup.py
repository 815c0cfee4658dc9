"""Near duplicates by ProbMinHash, banding and exact verification.

A document's shingles are its runs of five words (lower case, without
punctuation at either end; all words if there are fewer), each weighing
1 + ln(occurrences). In ProbMinHash every shingle is a Poisson process of its
weight: its arrivals, in order of time, fall into registers, and a register
keeps the shingle that arrived first; a shingle ends as soon as its next
arrival is later than every register's. Two documents agree in a register with
the probability of their probability Jaccard similarity.

Documents of equal words are one node. A pair is a link if the Jaccard similarity
of its shingle sets is ``THRESHOLD`` or more. Candidates are nodes that agree in a
whole band of registers. Texts that repeat their shingles differently can be far
less alike by weight than as sets, so a node has the bands of a second sketch too,
in which each shingle weighs 1 (the same sketch where none repeats). There a
register agrees with the probability of the Jaccard similarity itself: with
``BANDS`` bands of ``ROWS`` registers a pair at 0.8 shares no band with probability
(1 - 0.8^4)^24 = 3e-6, however the two repeat their shingles.

A band's nodes are not paired with each other. First a node is verified against one
other, the least that any of its bands holds, then against the least of each band whose
class isn't its own yet; components of the links are classes. A band whose nodes are all
of one class by then needs nothing more. The nodes of the other bands are compared
across classes, exactly: in the order of frequency among these nodes, rarest first, two
sets at the threshold share a shingle of their first ones (prefix), early enough for the
rest to reach the overlap that they need (position). Of a shingle's nodes each meets the
one in which it comes earliest, and then only those of other classes. A shingle of very
many nodes is dealt out to several tasks. So no link between different classes is lost,
no bucket is capped, and within a class no pairs are made.

Shingles are 64-bit hashes. They are made once for the sketch, which keeps none of them,
and again for the nodes that share a band, so that they are written for these alone.

Nulls: a null text is empty; texts without words are equal to each other. In a
text of symbols alone the words are taken as written. A null doc_id comes after
all others. Repeated rows are of one class, and one of them stays. A very long
text is one sketch like any other. An empty table gives no rows.
``near_duplicates`` ignores other columns; ``deduplicated`` keeps them all, whatever
their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Words, attach, remembers, small_batches, stored, whole_row

WIDTH, THRESHOLD, BANDS, ROWS = 5, 0.8, 24, 4
#: Rows sketched at a time; bounds what a Python worker holds.
SLICE = 500
#: Nodes of a shingle that one task compares with the others of that shingle.
HOT_NODES = 1_000
_TRIM = re.compile(r"^[\W_]+|[\W_]+$")
_M = np.uint64(0x9E3779B97F4A7C15)
_PLACE = np.uint64(0xA5A5A5A5A5A5A5A5)
_MEMO = Words(32 << 20)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _code(word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass")) | 1


def _word(chunk: str) -> int:
    word = chunk if chunk.isalnum() else _TRIM.sub("", chunk)
    return _code(word) if word else 0


def word_codes(text: str) -> np.ndarray:
    remembers("neardup", _MEMO.clear)
    chunks = text.lower().split()
    got = list(map(_MEMO.get, chunks))
    if None in got:
        new = {c: _word(c) for c in {c for c, g in zip(chunks, got) if g is None}}
        got = [new[c] if g is None else g for c, g in zip(chunks, got)]
        _MEMO.keep(new)
    codes = np.array(got, np.uint64)
    if chunks and not codes.any():  # no letter or digit: the words as written
        return np.array([_code(c) for c in chunks], np.uint64)
    return codes[codes != 0]


def shingles(codes: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes and how often each occurs."""
    n = len(codes)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    k = min(width, n)
    h = np.zeros(n - k + 1, np.uint64)
    for j in range(k):
        h = (h + codes[j : n - k + 1 + j]) * np.uint64(0x100000001B3) ^ _M
    return np.unique(_mix(h), return_counts=True)


def probminhash(items: np.ndarray, weight: np.ndarray, registers: int) -> np.ndarray:
    """The first arriver in each register (0 for a set without items)."""
    time, who = np.full(registers, np.inf), np.zeros(registers, np.uint64)
    if not len(items):
        return who
    ids, now, turn = items, np.zeros(len(items)), 0
    turns = -(-7 * registers // len(items)) + 1
    while len(ids):
        state = _mix(ids + _M * np.arange(turn, turn + turns, dtype=np.uint64)[:, None])
        gaps = -np.log(((state >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53) / weight
        gaps[0] += now
        arrivals = np.cumsum(gaps, axis=0)
        t, r = arrivals.ravel(), (_mix(state ^ _PLACE) % np.uint64(registers)).astype(np.int64).ravel()
        np.minimum.at(time, r, t)
        won = np.flatnonzero(t == time[r])
        who[r[won]] = ids[won % len(ids)]
        going = arrivals[-1] < time.max()
        ids, now, weight, turn, turns = ids[going], arrivals[-1][going], weight[going], turn + turns, 2
    return who


def _node(codes: np.ndarray) -> bytes:
    return hashlib.blake2b(codes.tobytes(), digest_size=16).digest()


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.cumsum([0, *map(len, arrays)]).astype(np.int32), np.concatenate([np.zeros(0, np.int64), *arrays]))


def _shingled(width: int):
    """(node, shingles) from (text, node)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, SLICE) for b in batches for at in range(0, b.num_rows, SLICE)):
            found = [shingles(word_codes(text or ""), width)[0].view(np.int64) for text in batch.column(0).to_pylist()]
            yield pa.record_batch([batch.column(1), _lists(found)], names=["node", "shingles"])

    return run


def _sketched(bands: int, rows: int, width: int):
    registers = bands * rows
    lone = np.arange(bands, dtype=np.uint64)

    def banded(who: np.ndarray) -> np.ndarray:
        who, h = who.reshape(bands, rows), lone * _M
        for j in range(rows):
            h = _mix(h + who[:, j])
        return h

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, SLICE) for b in batches for at in range(0, b.num_rows, SLICE)):
            texts = batch.column(1).to_pylist()
            keys, band, sizes = [], [], []
            for text in texts:
                codes = word_codes(text or "")
                items, count = shingles(codes, width)
                own = banded(probminhash(items, 1 + np.log(np.maximum(count, 1)), registers))
                if (count > 1).any():  # else the second sketch is the first
                    own = np.union1d(own, banded(probminhash(items, np.ones(len(items)), registers)))
                keys.append(_node(codes))
                band.append(own.view(np.int64))
                sizes.append(len(items))
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()), _lists(band)], names=["doc_id", "text_hash", "node", "n", "bands"])

    return run


def _overlap(n: Column, m: Column, threshold: float) -> Column:
    """The overlap that sets of n and m need."""
    return F.ceil(threshold / (1 + threshold) * (n + m) - 1e-9)


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) with whether they are linked, stored. A node of very many pairs is dealt out to several tasks."""
    pairs = both = stored(pairs, "near-candidates")
    # Only the sets that are asked for move on. Lists of nodes grow with the documents, so none is broadcast, however small.
    asked = stored(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct(), "near-compared")
    sets = sets.join(asked.hint("merge"), "node", "left_semi")
    for side, other, name in (("b", "a", "_y"), ("a", "b", "_x")):
        counts = stored(pairs.groupBy(side).agg(F.count("*").alias("_pairs")), "near-counts")
        both = attach(both, sets.select(F.col("node").alias(side), F.col("shingles").alias(name)), side, counts, "_pairs", F.col(other))
    same = F.size(F.array_intersect("_x", "_y"))
    linked = same >= threshold * (F.size("_x") + F.size("_y") - same) - 1e-9
    return stored(both.select("a", "b", linked.alias("linked")), "near-pairs")


def components(links: DataFrame) -> DataFrame:
    """(node, class) of every node with a link; the class is its least node.

    Large star, then small star, until no edge changes; each round is written to
    the shared folder. No link is collected.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "near-edges")
    before = None
    while True:
        sides = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = sides.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = sides.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        edges = stored(small, "near-edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    classes = edges.groupBy("u").agg(F.min("v").alias("class")).select(F.col("u").alias("node"), "class")
    return stored(classes.unionByName(classes.select(F.col("class").alias("node"), "class").distinct()), "near-classes")


def _entries(sets: DataFrame, threshold: float) -> DataFrame:
    """(token, node, n, rest): shared shingles early enough in a node, and how many follow from there."""
    tokens = sets.select("node", F.size("shingles").alias("n"), F.explode("shingles").alias("token"))
    common = tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    own = tokens.join(common, "token")
    order = Window.partitionBy("node").orderBy("df", "token")
    # Shingles of one node alone come first; they are what is not among the common ones.
    place = F.col("n") - F.count("*").over(Window.partitionBy("node")) + F.row_number().over(order) - 1
    early = own.withColumn("rest", (F.col("n") - place).cast("int")).where(F.col("rest") >= F.ceil(threshold * F.col("n") - 1e-9))
    return stored(early.select("token", "node", "n", "rest"), "near-entries")


def _banded(sketches: DataFrame, words: DataFrame) -> DataFrame:
    """(band, node, n, centre, m): nodes that share a band with another, the band's least node, and the sizes of both; stored."""
    own = sketches.select(F.col("row").alias("node"), "n", "bands").join(words.select("node"), "node", "left_semi")
    placed = own.select("node", "n", F.explode("bands").alias("band"))
    several = stored(placed.groupBy("band").agg(F.count("*").alias("_nodes"), F.min(F.struct("node", "n")).alias("_c")).where("_nodes > 1"), "near-buckets")
    centred = several.select("band", F.col("_c.node").alias("centre"), F.col("_c.n").alias("m"))
    return stored(attach(placed, centred, "band", several, "_nodes", F.col("node")), "near-banded")


def _sets(docs: DataFrame, sketches: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """(node, shingles) of some nodes, stored."""
    asked = stored(sketches.select(F.col("row").alias("node"), F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).join(nodes, "node", "left_semi"), "near-asked")
    texts = _texts(docs)
    found = texts.join(asked.hint("merge"), (F.col("text_hash") == F.col("_hash")) & F.col("doc_id").eqNullSafe(F.col("_id")))
    made = found.select("text", "node").mapInArrow(_shingled(width), "node long, shingles array<long>")
    repeated = sketches.groupBy("doc_id", "text_hash").agg(F.count("*").alias("_n")).where("_n > 1").limit(1).count()
    return stored(made.dropDuplicates(["node"]) if repeated else made, "near-sets")


def _merged(classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Classes (node, class) after the linked pairs join some of them, stored; a class is its least node."""
    known = lambda side: classes.select(F.col("node").alias(side), F.col("class").alias(f"_{side}"))
    links = pairs.where("linked").join(known("a"), "a").join(known("b"), "b").where("_a <> _b").select(F.col("_a").alias("a"), F.col("_b").alias("b")).distinct()
    joined = components(links)
    sizes = stored(classes.groupBy("class").agg(F.count("*").alias("_k")), "near-sizes")
    renamed = stored(sizes.join(joined.select(F.col("node").alias("class"), F.col("class").alias("_new")), "class", "left").select("class", F.coalesce("_new", "class").alias("_new")), "near-renamed")
    return stored(attach(classes, renamed, "class", sizes, "_k", F.col("node")).select("node", F.col("_new").alias("class")), "near-classes")


def _filtered(open_sets: DataFrame, classes: DataFrame, threshold: float):
    """Two rounds of pairs (a, b) of different classes: to a token's centre, then what the filters leave across classes.

    The second is a function of the classes that the first leads to.
    """
    entries = _entries(open_sets, threshold)
    centres = entries.groupBy("token").agg(F.max(F.struct((F.col("rest") / F.col("n")).alias("s"), "node", "n", "rest")).alias("_c"), F.count("*").alias("_nodes"))
    centres = stored(centres.where("_nodes > 1").select("token", F.col("_c.node").alias("_node"), F.col("_c.n").alias("_n"), F.col("_c.rest").alias("_rest"), "_nodes"), "near-centres")
    reach = F.least("rest", "_rest") >= _overlap(F.col("n"), F.col("_n"), threshold)
    pair = [F.least("node", "_node").alias("a"), F.greatest("node", "_node").alias("b")]
    met = attach(entries, centres.drop("_nodes"), "token", centres, "_nodes", F.col("node")).where((F.col("node") != F.col("_node")) & reach).select(*pair).distinct()
    known = lambda side: classes.select(F.col("node").alias(side), F.col("class").alias(f"_{side}"))
    star = met.join(known("a"), "a").join(known("b"), "b").where("_a <> _b").select("a", "b")

    def across(classes: DataFrame) -> DataFrame:
        known = stored(entries.join(classes, "node"), "near-known")
        # Rows outside their token's largest class meet all others of the token.
        sizes = known.groupBy("token", "class").agg(F.count("*").alias("_k")).groupBy("token").agg(F.max(F.struct("_k", "class"))["class"].alias("_main"), F.count("*").alias("_classes"), F.sum("_k").alias("_nodes"))
        sizes = stored(sizes.where("_classes > 1").select("token", "_main", "_nodes"), "near-tokens")
        split = stored(attach(known, sizes, "token", sizes, "_nodes", F.col("node")), "near-split")
        # A token of many nodes is several joins: one side is dealt out, the other repeated for each.
        parts = F.ceil(F.col("_nodes") / HOT_NODES).cast("int")
        one = split.select("token", F.pmod(F.xxhash64("node"), parts).cast("int").alias("_part"), "node", "n", "rest", "class")
        lesser = split.where("class <> _main").select("token", F.explode(F.sequence(F.lit(0), parts - 1)).alias("_part"), F.col("node").alias("_node"), F.col("n").alias("_n"), F.col("rest").alias("_rest"), F.col("class").alias("_class"))
        return one.join(lesser, ["token", "_part"]).where((F.col("class") != F.col("_class")) & reach).select(*pair).distinct()

    return star, across


def find_links(docs: DataFrame, sketches: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Compared pairs (a, b, linked), classes (node, class) and words (words, node).

    A node is the number of the first row that has its words.
    """
    words = stored(sketches.groupBy(F.col("node").alias("words")).agg(F.min("row").alias("node")), "near-words")
    banded = _banded(sketches, words)
    nodes = stored(banded.select("node").distinct(), "near-nodes")
    sets = _sets(docs, sketches, nodes, width)
    classes = nodes.select("node", F.col("node").alias("class"))
    near = banded.where((F.col("node") != F.col("centre")) & (F.least("n", "m") >= threshold * F.greatest("n", "m") - 1e-9))
    first = _verified(near.groupBy("node").agg(F.min("centre").alias("a")).select("a", F.col("node").alias("b")), sets, threshold)
    classes, pairs = _merged(classes, first), first

    def compared(candidates: DataFrame) -> None:
        nonlocal classes, pairs
        more = _verified(candidates.join(pairs.select("a", "b"), ["a", "b"], "left_anti"), sets, threshold)
        classes, pairs = _merged(classes, more), pairs.unionByName(more)

    rest = near.select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()
    known = lambda side: classes.select(F.col("node").alias(side), F.col("class").alias(f"_{side}"))
    met = stored(rest.groupBy("a").agg(F.count("*").alias("_pairs")), "near-counts")
    rest = attach(rest.join(known("b"), "b"), known("a"), "a", met, "_pairs", F.col("b")).where("_a <> _b").select("a", "b")
    compared(rest)
    # Bands that still hold several classes: their nodes are compared across these.
    own = stored(banded.select("band", "node").join(classes, "node"), "near-known-bands")
    mixed = stored(own.groupBy("band").agg(F.min("class").alias("_low"), F.max("class").alias("_high"), F.count("*").alias("_nodes")).where("_low < _high"), "near-mixed")
    unsettled = attach(own.select("band", "node"), mixed.select("band"), "band", mixed, "_nodes", F.col("node")).select("node").distinct()
    star, across = _filtered(stored(sets.join(unsettled, "node", "left_semi"), "near-open"), classes, threshold)
    compared(star)
    compared(across(classes))
    return pairs, classes, words


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))


def sketch(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, width: int = WIDTH) -> DataFrame:
    """A stored row for each document: row, doc_id, text_hash, node, n (shingles), bands."""
    small_batches(docs.sparkSession)
    made = _texts(docs).mapInArrow(_sketched(bands, rows, width), "doc_id long, text_hash long, node binary, n int, bands array<long>")
    return stored(made.withColumn("row", F.monotonically_increasing_id()), "near-sketches")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, width: int = WIDTH) -> DataFrame:
    """doc_id, class_id, class_size, links, kept (and text_hash) for every row.

    ``class_id`` is the least doc_id of the class, whose row stays. ``links`` are
    the verified links of the row's words to other words.
    """
    sketches = sketch(docs, bands, rows, width)
    pairs, classes, words = find_links(docs, sketches, threshold, width)
    linked = pairs.where("linked")
    links = linked.select(F.col("a").alias("node")).unionByName(linked.select(F.col("b").alias("node"))).groupBy("node").agg(F.count("*").alias("links"))
    known = words.join(classes.join(links, "node", "left"), "node", "left").select(F.col("words").alias("node"), F.coalesce("class", "node").alias("class"), F.coalesce("links", F.lit(0)).alias("links"))
    # Copies are many rows of one node: what is known of a node goes to its rows in parts.
    copies = stored(sketches.groupBy("node").agg(F.count("*").alias("_copies")), "near-copies")
    members = stored(attach(sketches.select("row", "doc_id", "text_hash", "node"), known, "node", copies, "_copies", F.col("row")).drop("node"), "near-members")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col("row").alias("r")))
    first = stored(members.groupBy("class").agg(least.alias("_w"), F.count("*").alias("class_size")), "near-first")
    whole = attach(members, first, "class", first, "class_size", F.col("row"))
    return whole.select("doc_id", F.col("_w.d").alias("class_id"), "class_size", "links", (F.col("row") == F.col("_w.r")).alias("kept"), "text_hash")


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows that stay, with all their columns."""
    judged = stored(near_duplicates(docs).select("doc_id", "text_hash", "kept"), "near-judged")
    kept = judged.where("kept").select(F.col("doc_id").alias("_kid"), F.col("text_hash").alias("_kh"))
    rows = docs.select(whole_row(docs), F.col("doc_id").cast("long").alias("_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_hash"))
    met = rows.join(kept, (F.col("_hash") == F.col("_kh")) & F.col("_id").eqNullSafe(F.col("_kid")), "left_semi")
    repeated = judged.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n"), F.max("kept").alias("kept")).where("kept and n > 1")
    if repeated.limit(1).count():  # rows of one id and text: only one of them stays
        number = F.row_number().over(Window.partitionBy("_hash", "_id").orderBy("_hash"))
        met = met.withColumn("_one", number).where("_one = 1")
    return met.select("_row.*")
