import hashlib
import io
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from redquill.llm import exactdedup, fingerprints, mixing, neardup, packing, quality, queries, tokenfile, toxicity, urlrules, warc
from redquill.llm.tokens import Encoder

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, node string, _text string, size string, kept string"


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def awkward_rows():
    rng = random.Random(3)
    long = words(rng, 30_000, 5_000)
    base = [(i, words(rng, 5 + i % 90) + ("." if i % 3 else " !!"), "en", f"s{i % 4}" if i % 11 else None) for i in range(1, 120)]
    base += [(200, None, None, None), (201, "", "en", "s1"), (202, " \t\n", "en", "s1"), (203, long, "en", "s2"), (204, long + " end", "de", "s2"), (None, "a null id", "en", "s0"), (None, None, "en", "s0")]
    base += [(300, "the same row", "en", "s3")] * 3 + [(301, "thesamerow", "en", "s3"), (302, "the same  row", "fr", "s0"), (303, "ΑΣ ß日本 é <|endoftext|> x", "el", "s1")]
    return [(i, t, lang, s, len(t or ""), "x", "y", "z", "w", "k") for i, t, lang, s in base]


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(awkward_rows(), DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, int(i % 3 == 0)) for i in range(1, 120)] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def path():
    return queries.tokenizer_path()


# --- tokens, packing, files -------------------------------------------------


def test_encoder_equals_library(path):
    e, rng = Encoder(path), random.Random(1)
    texts = ["", " ", "Don't stop", "I'LL a'd x''s", "½²³ a1b2\x85\xa0ÀÉ×÷ªºµ", "</w> a</w>b", "<|startoftext|>a", "\x1c a\x1fb", "ÿß ŒÆ", "日本 text", "İstanbul"]
    texts += ["".join(rng.choice("abcÉé '.!#1\n\t\x85\xa0²<|>/w") for _ in range(60)) for _ in range(300)]
    assert [x == e.whole(t) for x, t in zip(e.encode(texts), texts)] == [True] * len(texts)


def expected_ids(path, rows, end):
    e = Encoder(path)
    return [(i, e.whole(t or "") + np.array([end], "<u4").tobytes()) for i, t, *_ in rows]


def test_packing_covers_every_id_once(awkward, path):
    out = packing.pack_documents(awkward, path, block_ids=5_000, fan=2).collect()
    assert all(r.program_optimal for r in out)
    want = Counter((i, zlib.crc32(raw)) for i, raw in expected_ids(path, awkward_rows(), 2))
    by_sequence, total = defaultdict(list), 0
    for r in out:
        by_sequence[r.sequence_id].append((r.offset, r.length))
        total += r.length
    assert total == sum(len(raw) // 4 for _, raw in expected_ids(path, awkward_rows(), 2))
    for parts in by_sequence.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 4096
    # only one sequence of all tasks and blocks isn't full, so there are as few as can be
    assert len(by_sequence) == -(-total // 4096) and sum(sum(n for _, n in parts) < 4096 for parts in by_sequence.values()) <= 1
    whole = {(r.doc_id, r.ids_crc32) for r in out if r.length == r.doc_tokens}
    assert whole <= set(want)
    pieces = defaultdict(list)
    for r in out:
        pieces[r.doc_id].append(r)
    raw = dict(expected_ids(path, awkward_rows(), 2))
    for i in (203, 204, 7, 200):
        at = 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert r.start == at and r.ids_crc32 == zlib.crc32(raw[i][4 * at : 4 * (at + r.length)]) and r.doc_tokens == len(raw[i]) // 4
            at += r.length
        assert at == len(raw[i]) // 4


def test_pack_random_lengths():
    for seed in range(12):
        lengths = np.random.default_rng(seed).integers(1, [300, 4096, 9000][seed % 3], 1 + seed * 40)
        done, seq = defaultdict(int), defaultdict(int)
        pieces, _ = packing.pack(lengths)
        for d, start, n, q, _ in sorted(pieces):
            assert start == done[d]
            done[d] += n
            seq[q] += n
        assert [done[i] for i in range(len(lengths))] == lengths.tolist()
        assert all(x == 4096 for q, x in seq.items() if q >= 0) and seq.get(-1, 0) < 4096


def test_patterns_need_no_more_sequences_than_the_optimum():
    """Against the true optimum of small instances, by trying all ways; cutting is left out."""

    def fewest(items, room):
        best = [len(items)]

        def place(i, bins):
            if len(bins) >= best[0]:
                return
            if i == len(items):
                best[0] = len(bins)
                return
            for k in {b: k for k, b in enumerate(bins)}.values():
                if bins[k] >= items[i]:
                    place(i + 1, [b - items[i] if j == k else b for j, b in enumerate(bins)])
            place(i + 1, [*bins, room - items[i]])

        place(0, [])
        return best[0]

    for seed in range(40):
        rng = np.random.default_rng(seed)
        lengths = np.sort(rng.integers(3, 17, rng.integers(4, 11)))[::-1]
        bins, optimal = packing.fill_patterns(lengths, 20, 1)
        assert optimal and sorted(i for b in bins for i in b) == list(range(len(lengths)))
        assert max(lengths[b].sum() for b in bins) <= 20
        assert len(bins) <= fewest(lengths.tolist(), 20) + 1


def test_pivots_that_run_out_are_told():
    lengths = np.random.default_rng(1).integers(1, 4096, 4000)
    assert packing.pack(lengths, rounds=1)[1] is False and packing.pack(lengths)[1] is True


def test_packing_of_an_empty_table(nothing, path):
    assert packing.pack_documents(nothing, path).collect() == []


def test_column_generation_reaches_the_bound():
    sizes, demand = np.array([32, 31, 22, 11]), np.array([10.0, 10.0, 20.0, 40.0])
    basis, amount, optimal = packing.column_generation(sizes, demand, 64)
    assert np.allclose(basis @ amount, demand) and ((sizes @ basis) <= 64).all()
    assert optimal and amount.sum() <= (sizes @ demand) / 64 * 1.1


def test_best_pattern_is_best():
    rng = np.random.default_rng(2)
    for _ in range(20):
        sizes, value = rng.choice(np.arange(1, 20), 4, replace=False), rng.random(4)
        best, counts = packing.best_pattern(value, sizes, 25)
        brute = max((a * value[0] + b * value[1] + c * value[2] + d * value[3]) for a in range(26) for b in range(26) for c in range(26) for d in range(26) if a * sizes[0] + b * sizes[1] + c * sizes[2] + d * sizes[3] <= 25) if sizes.min() > 3 else best
        assert best == pytest.approx(brute) and counts @ value == pytest.approx(best) and counts @ sizes <= 25


def test_token_files_round_trip(awkward, path):
    got = tokenfile.read_token_files(tokenfile.write_token_files(awkward, path)).collect()
    rows = sorted(awkward_rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want, start = [], 0
    for i, raw in expected_ids(path, rows, 1):
        want.append((i, start, len(raw) // 4, zlib.crc32(raw)))
        start += len(raw) // 4
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want


def test_reader_opens_one_frame_and_sees_damage():
    class Source(io.BytesIO):
        def size(self):
            return len(self.getvalue())

    out, docs = io.BytesIO(), {i: np.arange(i, i + 50 + i, dtype="<u4").tobytes() for i in range(40)}
    w = tokenfile.ShardWriter(out, frame_ids=200)
    for i, raw in docs.items():
        w.add(i, raw)
    w.close()
    r = tokenfile.ShardReader(Source(out.getvalue()))
    assert dict(r.documents()) == docs and r.document(17) == docs[17] and r.document(99) is None
    hurt = bytearray(out.getvalue())
    hurt[int(r.starts[1]) + 12] ^= 255
    r = tokenfile.ShardReader(Source(bytes(hurt)))
    assert r.document(0) == docs[0]
    with pytest.raises(Exception):
        list(r.documents())


# --- classifiers ------------------------------------------------------------


def brute_segments(scores):
    """Maximal scoring segments by definition, recursively."""

    def best(a, b):
        top = max(((sum(scores[i:j]), -(j - i), -i, i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=None)
        if not top or top[0] <= 0:
            return []
        return best(a, top[3]) + [(top[3], top[4])] + best(top[4], b)

    return best(0, len(scores))


def test_maximal_segments_by_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(200):
        s = rng.integers(-30, 31, rng.integers(0, 14)) + rng.random()
        assert [(a, b) for a, b, _ in toxicity.maximal_segments(s.astype(float))] == brute_segments(s.tolist())


def toxic_rows(n=400):
    rng = random.Random(7)
    bad = ["idiot", "scum", "lowei"]
    out, marks = [], []
    for i in range(n):
        toxic = i % 4 == 0
        w = words(rng, 40 + rng.randrange(100)).split()
        if toxic:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(bad[:2] + ["lowei" + rng.choice("abcdefgh") + rng.choice("xyz")]))
        out.append((i, " ".join(w) + "."))
        marks.append((i, 1, int(toxic)))
    return out, marks


def test_toxicity_held_out(spark):
    rows, marks = toxic_rows()
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    assert len(got) == len(rows)
    for i, _, toxic in marks:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= got[i].score <= 1 and got[i].predicted == int(got[i].score >= 0.5)
    held = [(got[i].predicted, t) for i, _, t in marks if got[i].held_out]
    assert sum(p == t for p, t in held) / len(held) > 0.95
    model = toxicity.fit(docs, labels)
    found = toxicity.passages(docs, model).collect()
    assert len(found) > 20 and all(re.search("idiot|scum|lowei", r.passage) and marks[r.doc_id][2] for r in found)


def test_quality_held_out(spark):
    rng, rows, marks = random.Random(5), [], []
    for i in range(400):
        t = words(rng, 30 + rng.randrange(60))
        good = i % 4 != 0
        rows.append((i, t if good else " ".join(w.upper() + "!!" if i % 8 else w + "###" for w in t.split())))
        marks.append((i, int(good), 0))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.quality(docs, labels).collect()}
    held = [(got[i].predicted, q) for i, q, _ in marks if got[i].held_out]
    assert sum(p == q for p, q in held) / len(held) > 0.97
    assert all(r.predicted == int(r.score >= 0.3) for r in got.values())


def test_dual_coordinate_descent_satisfies_the_margin():
    rng = np.random.default_rng(4)
    y = np.where(rng.random(200) < 0.5, 1, -1)
    rows = [np.unique(np.concatenate([rng.integers(4, 50, 8), [0 if t > 0 else 1]])).astype(np.int32) for t in y]
    w = quality.dual_coordinate_descent(rows, np.ones(50), y, rounds=60)
    assert all(t * w[r].sum() > 0 for r, t in zip(rows, y))


@pytest.mark.parametrize("op", [toxicity.toxicity, quality.quality])
def test_classifiers_on_awkward_rows(spark, awkward, nothing, labels, op):
    got = op(awkward, labels).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in awkward_rows()) and all(0 <= r.score <= 1 for r in got)
    assert op(nothing, labels).count() == 0
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert op(awkward, none).count() == len(awkward_rows())
    assert quality.accepted(awkward, none).columns == awkward.columns


# --- exact duplicates -------------------------------------------------------


def brute_dedup(rows):
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i or 0, i))
    out = Counter()
    for norm, g in groups.items():
        g.sort(key=lambda x: x[:3])
        for k, x in enumerate(g):
            out[(x[3], g[0][3], len(g), k == 0, hashlib.sha256(norm.encode()).hexdigest())] += 1
    return out


@pytest.mark.parametrize("hot_rows", [exactdedup.HOT_ROWS, 1])
def test_exact_dedup_by_brute_force(awkward, hot_rows):
    assert Counter(map(tuple, exactdedup.judge(awkward, hot_rows=hot_rows).collect())) == brute_dedup(awkward_rows())


def test_exact_dedup_keeps_columns(awkward, nothing):
    kept = exactdedup.deduplicated(awkward)
    assert kept.columns == awkward.columns and kept.count() == sum(k[3] * n for k, n in brute_dedup(awkward_rows()).items())
    assert exactdedup.judge(nothing).count() == 0 and exactdedup.deduplicated(nothing).count() == 0


# --- near duplicates --------------------------------------------------------


def near_rows():
    rng, rows = random.Random(11), []
    for g in range(30):
        base = words(rng, 60 + rng.randrange(100), 100_000).split()
        rows.append(" ".join(base))
        for _ in range(rng.randrange(4)):
            copy = list(base)
            for _ in range(rng.randrange(1, 7)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
            rows.append(" ".join(copy).upper() + ".")
    hot = words(rng, 150, 100_000).split()
    for _ in range(150):  # a large group around one text
        copy = list(hot)
        copy[rng.randrange(150)] = f"y{rng.randrange(10**6)}"
        copy[rng.randrange(150)] = f"y{rng.randrange(10**6)}"
        rows.append(" ".join(copy))
    passage = words(rng, 30, 100_000)
    rows += [passage + " " + words(rng, 12, 100_000) for _ in range(60)]  # alike, but below the threshold
    rng.shuffle(rows)
    return [(i, t) for i, t in enumerate(rows)] + [(9000, None), (9001, ""), (9002, "one two"), (9003, "One, two!"), (9003, "One, two!"), (None, rows[0])]


def brute_classes(rows):
    sets = [(lambda s: set(s[0].tolist()))(neardup.shingles(neardup.word_codes(t or ""))) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if (len(a & b) / len(a | b) if a | b else 1.0) >= 0.8:
                parent[find(i)] = find(j)
    groups = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        groups[find(i)].append(d)
    return Counter(tuple(sorted(map(str, g))) for g in groups.values())


def test_near_duplicates_by_brute_force(spark):
    rows = near_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = neardup.near_duplicates(docs).collect()
    groups = defaultdict(list)
    for r in got:
        groups[r.class_id].append(r)
    assert Counter(tuple(sorted(str(r.doc_id) for r in g)) for g in groups.values()) == brute_classes(rows)
    for k, g in groups.items():
        ids = [r.doc_id for r in g if r.doc_id is not None]
        assert k == min(ids) and sum(r.kept for r in g) == 1 and all(r.class_size == len(g) for r in g)
    assert neardup.deduplicated(docs).count() == len(groups)


def test_near_duplicates_that_repeat_differently(spark):
    rng, rows = random.Random(5), []
    for g in range(25):
        one, two = words(rng, 200, 100_000), words(rng, 200, 100_000)
        rows += [(2 * g, " ".join([one] * 20 + [two])), (2 * g + 1, " ".join([one] + [two] * 20))]
    assert sum(brute_classes(rows).values()) == 25
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in got} == {d: d - d % 2 for d, _ in rows}


def test_near_duplicates_of_symbols_alone(spark):
    rows = [(1, "!!! ???"), (2, "*** ---"), (3, "\U0001f600 \U0001f680"), (4, ""), (5, " \n"), (6, None), (7, "!!!  ???"), (8, "one !!!"), (9, "One")]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in got} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 4, 6: 4, 7: 1, 8: 8, 9: 8}


def test_probminhash_estimates_probability_jaccard():
    rng = np.random.default_rng(8)
    items = rng.integers(1, 2**63, 300).astype(np.uint64)
    wa, wb = rng.integers(0, 4, 300).astype(float), rng.integers(0, 4, 300).astype(float)
    share = sum(1 / max(1e-300, sum(max(wa[j] / wa[i], wb[j] / wb[i]) for j in range(300))) for i in range(300) if wa[i] and wb[i])
    k = 4096
    a, b = neardup.probminhash(items[wa > 0], wa[wa > 0], k), neardup.probminhash(items[wb > 0], wb[wb > 0], k)
    assert (a == b).mean() == pytest.approx(share, abs=0.04)


def test_near_duplicates_on_awkward_rows(awkward, nothing):
    assert neardup.near_duplicates(awkward).count() == len(awkward_rows())
    kept = neardup.deduplicated(awkward)
    assert kept.columns == awkward.columns and kept.where("doc_id = 300").count() == 1
    assert neardup.near_duplicates(nothing).count() == 0


def test_components_of_a_long_path(spark):
    edges = [(bytes([0, i]), bytes([0, i + 1])) for i in range(60)] + [(b"\x05\x00", b"\x05\x01")]
    random.Random(1).shuffle(edges)
    got = {bytes(r.node): bytes(r["class"]) for r in neardup.components(spark.createDataFrame(edges, "a binary, b binary")).collect()}
    assert got == {bytes([0, i]): b"\x00\x00" for i in range(61)} | {b"\x05\x00": b"\x05\x00", b"\x05\x01": b"\x05\x00"}


# --- mixing -----------------------------------------------------------------


def brute_targets(sizes, cap=3.0):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(order)}
    total, target, free = float(sum(sizes.values())), {}, set(order)
    while free:
        level = (total - sum(target.values())) / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > cap * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in free}
        target |= {s: cap * sizes[s] for s in over}
        free -= over
    return target


def test_targets_by_brute_force(spark):
    rng = random.Random(2)
    for _ in range(4):
        sizes = {f"s{i:02d}": rng.choice([0, 1, 5, 50, 1000, 20000]) for i in range(rng.randrange(2, 9))} | {None: 70}
        rows = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
        got = {r.source: r.target for r in mixing.targets(rows).collect()}
        want = brute_targets(sizes)
        assert got.keys() == want.keys() and all(got[s] == pytest.approx(want[s]) for s in want)


def test_flight_keeps_totals():
    rng = np.random.default_rng(3)
    p, size = rng.random(500), rng.integers(1, 900, 500)
    x = mixing.flight(p, size, rng)
    assert ((x > 0) & (x < 1)).sum() <= 2 and x.sum() == pytest.approx(p.sum()) and (x * size).sum() == pytest.approx((p * size).sum())


def test_flight_keeps_probabilities():
    p, size = np.full(12, 0.35), np.arange(1, 13)
    mean = np.mean([mixing.flight(p, size, np.random.default_rng(s)) for s in range(4000)], axis=0)
    assert np.abs(mean - 0.35).max() < 0.04


@pytest.mark.parametrize("block", [mixing.BLOCK, 16])
def test_mix(spark, block):
    rng = random.Random(9)
    rows = [(i, words(rng, rng.randrange(1, 200)), f"s{rng.choice([0, 0, 0, 0, 1, 2, 3])}") for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = mixing.mix(docs, block=block).collect()
    assert len(got) == len(rows) and sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(docs.repartition(3), block=block).collect()))
    taken, target = defaultdict(int), {}
    for r in got:
        assert r.taken <= 3 * r.size and r.taken == r.copies * r["size"]
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) <= max(2.0, 0.002 * target[s]) for s in target)


def test_mix_on_awkward_rows(awkward, nothing):
    got = mixing.mix(awkward)
    rows = got.collect()
    assert Counter((r.doc_id, r["size"]) for r in rows) == Counter((r[0], len((r[1] or "").encode().split())) for r in awkward_rows())
    out = mixing.mixed_documents(awkward)
    assert out.columns == awkward.columns and out.count() == sum(r.copies for r in rows)
    assert mixing.mix(nothing).count() == 0 and mixing.mixed_documents(nothing).count() == 0


# --- fingerprints -----------------------------------------------------------


def jaccard(a, b):
    a, b = Counter(a.lower().split()), Counter(b.lower().split())
    return sum((a & b).values()) / sum((a | b).values()) if a or b else 1.0


def edited(t, nxt):
    return t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]


@pytest.mark.parametrize("bucket_rows, stretch", [(7, 1), (2000, 1), (7, 10**15), (5, -3)])
def test_fingerprints_follow_generalised_jaccard(spark, bucket_rows, stretch):
    rng = random.Random(4)
    far = {1: lambda i: i, -3: lambda i: [-(2**63), 2**63 - 1, -(6 * 10**18), 6 * 10**18][i // 3] if i < 12 else i}.get(stretch, lambda i: i * stretch)  # ids of any span
    rows = [(i * 3, words(rng, rng.randrange(20, 200), 600)) for i in range(90)] + [(1000, ""), (1001, "same text"), (1002, "same text")]
    rows = sorted((far(i), t) for i, t in rows)
    same = [i for i, t in rows if t == "same text"]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in fingerprints.fingerprints(docs, bucket_rows=bucket_rows).collect()}
    assert len(got) == len(rows)
    error = []
    for k, (i, t) in enumerate(rows):
        nxt = rows[k - 1][1]  # the first comes after the last
        e, r = edited(t, nxt), got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        error += [r.near_edited - jaccard(t, e), r.near_next - jaccard(t, nxt)]
    assert abs(np.mean(error)) < 0.03 and np.std(error) < 0.09
    assert got[same[0]].fingerprint == got[same[1]].fingerprint and got[same[1]].near_next == 1.0 and got[same[0]].near_next == 0.0


def test_fingerprints_ignore_blanks_at_the_ends(spark):
    docs = spark.createDataFrame([(1, "ab cd ab"), (2, " \t ab cd  ab\n"), (3, "zz")], "doc_id long, text string")
    got = {r.doc_id: r for r in fingerprints.fingerprints(docs).collect()}
    assert got[1].fingerprint == got[2].fingerprint and got[2].near_next == 1.0


def test_buckets_follow_rows_and_bytes_not_ids(spark):
    docs = spark.range(20_000).selectExpr("if(id = 7, 1000000000000000, id) doc_id", "if(id between 3000 and 3019, repeat('x ', 1000000), 'a b') text")
    sizes = [r["count"] for r in fingerprints._bucketed(docs, 2_000).where("_ghost = 0").groupBy("bucket").count().collect()]
    assert sum(sizes) == 20_000 and max(sizes) <= 2_600
    heavy = fingerprints._bucketed(docs, 2_000).where("_ghost = 0").groupBy("bucket").agg(F.sum(F.length("_text")).alias("s")).agg(F.max("s")).first()[0]
    assert heavy < 45_000_000


def test_fingerprints_on_awkward_rows(awkward, nothing, spark):
    got = fingerprints.fingerprints(awkward).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in awkward_rows())
    assert fingerprints.fingerprints(nothing).count() == 0
    lone = fingerprints.fingerprints(spark.createDataFrame([(1, "ab cd")], "doc_id long, text string")).first()
    assert lone.near_next == 1.0 and lone.edited_sha256 == hashlib.sha256(b"ab ab").hexdigest()


def test_gamma_quantiles():
    q = np.array(fingerprints.gamma_quantiles(2000))
    assert q.mean() == pytest.approx(2, abs=0.01) and q.var() == pytest.approx(2, abs=0.1)


# --- WARC -------------------------------------------------------------------

PAGES = "page_id long, url string, html string, shard string, digest string"


def page_rows():
    rng = random.Random(6)
    rows = [(i, f"http://h{i}.example.com/{i}", f"<p>{words(rng, 20)}</p>", "x", "y") for i in range(1300)]
    return rows + [(None, None, None, "x", "y"), (7, "http://a\r\nb", "<p>twice é</p>", "x", "y"), (7, "http://a\r\nb", "<p>twice é</p>", "x", "y"), (2000, "u", "z" * 200_000, "x", "y")]


def test_fixity_finds_damage(spark):
    rows = page_rows()
    pages = spark.createDataFrame(rows, PAGES)
    hurt = spark.createDataFrame([(i, u, h[:-1] + "~" if i in (5, 900, 2000) else h, a, b) for i, u, h, a, b in rows], PAGES)
    got = warc.fixity(spark, pages, hurt)
    assert got.count() == len(rows) and {r.page_id for r in got.where("status = 'changed'").collect()} == {5, 900, 2000}
    assert warc.fixity(spark, pages, pages).where("status <> 'ok'").count() == 0
    fewer = pages.where("page_id <> 511 OR page_id IS NULL")  # the last record of its file
    assert [r.page_id for r in warc.fixity(spark, pages, fewer).where("status <> 'ok'").collect()] == [511]
    more = warc.fixity(spark, fewer, pages).where("status <> 'ok'").collect()
    assert [(r.page_id, r.status) for r in more] == [(511, "extra")]
    longer = spark.createDataFrame([(i, u, h + "more" if i == 600 else h, a, b) for i, u, h, a, b in rows], PAGES)
    status = Counter(r.status for r in warc.fixity(spark, pages, longer).collect())
    assert status["changed"] == 1 and status["moved"] == 1023 - 600


def test_fixity_aligns_records_within_a_file(spark):
    rows = [(i, f"http://h/{i}", f"<p>{i}</p>") for i in range(100)] + [(200, "u", "same")] * 3
    files = warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string"))
    found = lambda change: {(r.page_id, r.status): r["count"] for r in warc.audit(warc.read_warc(files), warc.read_warc(warc.copy_warc(files, change=change))).groupBy("page_id", "status").count().where("status not in ('ok', 'moved')").collect()}
    assert found(lambda i, x: None if i == 50 else x) == {(50, "missing"): 1}
    assert found(lambda i, x: x + b"!" if i == 50 else None if i in (10, 70) else x) == {(50, "changed"): 1, (10, "missing"): 1, (70, "missing"): 1}
    fewer = warc.copy_warc(files, change=lambda i, x: None if i == 50 else x)
    back = warc.audit(warc.read_warc(fewer), warc.read_warc(files)).where("status not in ('ok', 'moved')").collect()
    assert [(r.page_id, r.status) for r in back] == [(50, "extra")]
    first = warc.copy_warc(files, change=lambda i, x, seen=[]: None if i == 200 and not seen.append(1) and len(seen) == 1 else x)
    assert {(r.page_id, r.status) for r in warc.audit(warc.read_warc(files), warc.read_warc(first)).where("status <> 'ok'").collect()} == {(200, "missing")}


def test_a_damaged_member_is_an_error(spark):
    import gzip

    whole = gzip.compress(b"abc") + gzip.compress(b"def")
    assert [x for _, x in warc.read_members(io.BytesIO(whole), 5)] == [b"abc", b"def"]
    with pytest.raises(ValueError):
        list(warc.read_members(io.BytesIO(whole[:-3])))


def test_warc_query_equals_its_faults(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()
    got = {r.page_id: r.status for r in queries.op6_warc(spark, "/root/testdata/sf0.001").collect()}
    assert got == {r.page_id: "changed" if r.page_id % 997 == 13 and (r.html or "").endswith(">") else "ok" for r in pages}


def test_warc_files_round_trip(spark):
    rows = page_rows()
    pages = spark.createDataFrame(rows, PAGES)
    files = warc.write_warc(pages)
    back = warc.read_warc(files, pages=True)
    assert Counter(r.html for r in back.collect()) == Counter(r[2] or "" for r in rows)
    assert Counter(r.page_id for r in back.collect()) == Counter(r[0] for r in rows)
    replica = back.drop("url", "html")
    assert warc.audit(warc.leaves(pages), replica).where("status <> 'ok'").count() == 0
    assert warc.leaves(pages.limit(0)).count() == 0 and warc.fixity(spark, pages.limit(0), pages.limit(0)).count() == 0


# --- URLs -------------------------------------------------------------------


def brute_given(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    cut = re.search(r"[/?#]|$", rest).start()
    host = re.sub("[A-Z]", lambda m: m[0].lower(), rest[:cut])
    path = re.split(r"[?#]", rest[cut:], maxsplit=1)[0]
    fits = []
    for verdict, rule in urlrules.GIVEN:
        own, _, tail = rule.partition("/")
        if (host == own or host.endswith("." + own)) and path.startswith("/" + tail):
            fits.append((len(rule), rule, verdict))
    best = max(fits, default=(0, None, None))
    return host, path, best[1], best[2]


def test_urls_by_brute_force(spark):
    rng = random.Random(3)
    urls = [f"http{rng.choice(['', 's'])}://{rng.choice(['www.', 'M.', ''])}{rng.choice(['a', 'spam'])}{rng.choice(['.example', ''])}.{rng.choice(['com', 'net', 'org', 'COM'])}/{rng.choice(['en', 'de', 'es'])}/{rng.randrange(100)}{rng.choice(['', '?x=1', '#t'])}" for _ in range(600)]
    urls += [None, "", "no scheme", "http://", "x://y?z", "a://b://c/d", "http://example.com", "http://com/en/", "http://com/en"]
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    got = {r.page_id: r for r in urlrules.judge(pages).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        host, path, rule, verdict = brute_given(u)
        r = got[i]
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict in ("allow", "block") and (verdict is None or r.verdict == verdict)
    assert urlrules.judge(pages.limit(0)).count() == 0


def test_mined_rules_by_brute_force(spark):
    rng, rows = random.Random(1), []
    for _ in range(500):
        own = sorted(rng.sample(["a", "b", "c", "d", "e", "f"], 3))
        rows.append((own, "block" if {"a", "b"} <= set(own) or rng.random() < 0.05 else "allow"))
    mined = urlrules.mine(spark.createDataFrame(rows, "tokens array<string>, label string"), 0.02, 0.8)
    from itertools import combinations

    want = {}
    for n in (1, 2, 3):
        for items in combinations("abcdef", n):
            fits = [label for own, label in rows if set(items) <= set(own)]
            for label in ("allow", "block"):
                if fits.count(label) >= 0.02 * len(rows) and fits.count(label) / len(fits) >= 0.8:
                    want[(frozenset(items), label)] = fits.count(label) / len(fits)
    want = {k: c for k, c in want.items() if not any((k[0] - {x}, k[1]) in want and want[(k[0] - {x}, k[1])] >= c for x in k[0])}
    assert {(items, label): c for items, label, c, _ in mined.rules} == pytest.approx(want)
    for own, _ in rows[:100]:
        fits = [k for k, r in enumerate(mined.rules) if r[0] <= set(own)]
        assert mined.match(set(own)) == (min(fits) if fits else None)


def test_unlisted_urls_are_judged_by_mined_rules(spark):
    urls = [f"http://h{i}.net/de/{i}" for i in range(60)] + [f"http://example.net/de/8{i}" for i in range(20)]  # blocked, allowed
    urls += [f"http://spam.h{i}.org/es/{i}" for i in range(40)]  # blocked
    plain, spam = [f"http://n{i}.net/fr/{i}" for i in range(30)], [f"http://spam.h{i}.org/en/{i}" for i in range(30)]  # no given rule
    pages = spark.createDataFrame(list(enumerate(urls + plain + spam)), "page_id long, url string")
    got = [r for r in urlrules.judge(pages).orderBy("page_id").collect()]
    assert all(r.rule is None for r in got[len(urls) :])
    assert {(r.verdict, r.mined_rule is None) for r in got[-len(spam) :]} == {("block", False)}
    # The given rules block most urls; that alone is no reason to block what they do not name.
    assert {r.verdict for r in got[len(urls) : -len(spam)]} == {"allow"}
    only = spark.createDataFrame([(i, u) for i, u in enumerate(urls[:60] + plain)], "page_id long, url string")
    assert urlrules.judge(only).where("verdict = 'block'").count() == 60


def test_the_bound_on_rules_counts_useful_ones_of_each_label(spark):
    rows = [([f"a{k}", f"b{k}"], "allow") for k in range(5) for _ in range(10)]  # sure, and with redundant pairs
    rows += [(["w", "x", "y", "z"], "block")] * 9 + [(["w", "x", "y", "z"], "allow")]
    for out in "wxyz":  # three of the four say little
        rows += [([t for t in "wxyz" if t != out], "allow")] * 9
    table = spark.createDataFrame(rows, "tokens array<string>, label string")
    mined = urlrules.mine(table, 0.02, 0.8, most_rules=10)
    assert mined.cut == 0 and (frozenset("wxyz"), "block") in {(r[0], r[1]) for r in mined.rules}
    with pytest.warns(UserWarning, match="beyond 4"):
        few = urlrules.mine(table, 0.02, 0.8, most_rules=4)
    assert few.cut > 0 and {r[1] for r in few.rules} == {"allow", "block"}


@pytest.mark.parametrize("crowd", [1, 4])
def test_mined_rules_do_not_depend_on_the_groups(spark, crowd, monkeypatch):
    from itertools import combinations

    monkeypatch.setattr(urlrules, "CROWD", crowd)  # 1: many groups
    rng, rows = random.Random(5), []
    for _ in range(400):
        own = sorted(rng.sample("abcdefgh", rng.randrange(3, 7)))
        rows.append((own + ["t"] * ("a" in own), "block" if {"a", "b", "c"} <= set(own) or rng.random() < 0.1 else "allow"))
    mined = urlrules.mine(spark.createDataFrame(rows, "tokens array<string>, label string"), 0.02, 0.7)
    want = {}
    for n in (1, 2, 3, 4):
        for items in combinations("abcdefght", n):
            fits = [label for own, label in rows if set(items) <= set(own)]
            for label in ("allow", "block"):
                if fits.count(label) >= 0.02 * len(rows) and fits.count(label) / len(fits) >= 0.7:
                    want[(frozenset(items), label)] = fits.count(label) / len(fits)
    want = {k: c for k, c in want.items() if not any((k[0] - {x}, k[1]) in want and want[(k[0] - {x}, k[1])] >= c for x in k[0])}
    assert {(items, label): c for items, label, c, _ in mined.rules} == pytest.approx(want)  # a and t always come together


def test_long_common_paths_are_mined_in_bounded_time(spark):
    rng = random.Random(2)
    urls = [f"http://{'abc'[i % 3]}{i}.{['net/de', 'org/fr'][i % 2]}/" + "/".join(f"p{k}" for k in range(24) if rng.random() < 0.95) + f"/{i}" for i in range(200)]
    urls += [f"http://example.net/de/8/" + "/".join(f"p{k}" for k in range(24) if rng.random() < 0.95) for _ in range(60)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    assert urlrules.judge(pages).count() == len(urls)


# --- the whole pipeline, and names ------------------------------------------


def test_dotted_and_clashing_names_pass_through(spark):
    docs = spark.createDataFrame([(i, f"text {i} " * 8, "a", i, i, i, i) for i in range(40)], "doc_id long, text string, source string, `a.b` long, _row long, `x``y` long, _hash long")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    for out in (exactdedup.deduplicated(docs), neardup.deduplicated(docs), mixing.mixed_documents(docs), quality.accepted(docs, labels, threshold=0.0)):
        assert out.columns == docs.columns
        for r in out.collect():
            assert {r[k] for k in (0, 3, 4, 5, 6)} == {r[0]}


def test_dual_coordinate_descent_reaches_the_optimum():
    """Against projected gradient steps on the dual problem itself."""
    rng = np.random.default_rng(8)
    rows = [np.sort(rng.choice(12, rng.integers(2, 6), replace=False)) for _ in range(24)]
    ratio, y = rng.normal(size=12), np.where(rng.random(24) < 0.4, 1, -1)
    x = np.zeros((24, 12))
    for i, r in enumerate(rows):
        x[i, r] = ratio[r] / np.sqrt(len(r) + 1.0)
    most = np.where(y > 0, 24 / (2 * (y > 0).sum()), 24 / (2 * (y < 0).sum()))
    gram, alpha = (x * y[:, None]) @ (x * y[:, None]).T, np.zeros(24)
    for _ in range(40_000):
        alpha = np.clip(alpha - (gram @ alpha - 1) / np.linalg.norm(gram, 2), 0, most)
    value = lambda w: 0.5 * w @ w + (most * np.maximum(0, 1 - y * (x @ w))).sum()
    best = (x * y[:, None]).T @ alpha
    got = quality.dual_coordinate_descent(rows, np.ones(12) * ratio, y, rounds=4_000)
    w = np.divide(got, ratio)
    assert value(w) == pytest.approx(value(best), rel=2e-3)


def test_a_sample_is_bounded_in_characters(spark):
    docs = spark.createDataFrame([(i, "x" * 100) for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    from redquill.llm.common import labelled_sample

    got = Counter(r.y for r in labelled_sample(docs, labels, "quality", 50, chars=1_000).collect())
    assert got == {0: 10, 1: 10} and Counter(r.y for r in labelled_sample(docs, labels, "quality", 50).collect()) == {0: 50, 1: 50}


def test_worker_memory_of_words_is_bounded():
    from redquill.llm.common import Words

    memory = Words(100_000)
    for k in range(200):
        memory.keep({f"{k}-{i}": b"x" * (i % 50) for i in range(20)})
        assert memory.held <= 100_000 and memory.held == memory._size(memory)
    assert "0-0" in memory  # what came first stays
    memory.keep({"y" * 90_000: b""})
    assert len(memory) and max(map(len, memory)) < 100


def test_rows_that_repeat_very_often(spark):
    docs = spark.createDataFrame([(None, "the same", "s", k) for k in range(300)] + [(i, f"own text {i}", "t", i) for i in range(60)], "doc_id long, text string, source string, n long").repartition(5)
    got = mixing.mix(docs, block=20).groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("want"), F.count("*").alias("n")).collect()
    assert all(abs(r.t - r.want) <= 12 for r in got) and sum(r.n for r in got) == 360
    taken = Counter(r.n for r in mixing.mixed_documents(docs).where("source = 's'").collect())
    assert sum(taken.values()) * 2 == next(r.t for r in got if r.source == "s") or max(taken.values()) <= 3
    judged = exactdedup.judge(docs.select("doc_id", "text"), hot_rows=10)
    assert judged.where("group_size = 300").count() == 300 and judged.where("kept").count() == 61


def brute_pipeline(rows, accepted):
    """What the stages up to mixing must keep, from the ids that the classifier accepts."""
    kept = [r for r in rows if r[0] in accepted]
    norm, best = lambda t: re.sub(r"[\x20\x09-\x0D]+", "", t or ""), {}
    for r in kept:
        key = (-len(r[1] or ""), r[0])
        if norm(r[1]) not in best or key < best[norm(r[1])][0]:
            best[norm(r[1])] = (key, r)
    kept = [r for _, r in best.values()]
    return {min(map(int, group)) for group in brute_classes([(r[0], r[1]) for r in kept])}


def test_pipeline_by_brute_force(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(11)
    good = [(i, words(rng, 40, 3_000), "en", f"s{i % 3}") for i in range(80)]
    rows = good + [(100 + i, good[i][1].replace(" ", "  ", 3), "en", "s0") for i in range(20)]  # copies but for blanks
    rows += [(200 + i, good[i][1] + " another", "en", "s1") for i in range(20)] + [(300 + i, "!!! $$$ " * 12 + str(i), "en", "s2") for i in range(40)]
    rows += [(400, words(rng, 20_000, 5_000), "en", "s2"), (401, None, None, None), (402, "", "en", "s1")]
    columns = "doc_id long, text string, lang string, source string, n_chars long, `odd.name` string, _row string, node string"
    docs = spark.createDataFrame([(*r, len(r[1] or ""), "o", "r", "n") for r in rows], columns).repartition(4)
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(r[0], int(r[0] < 300), 0) for r in rows if r[0] < 400], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"file://{tmp_path}/labels.parquet")
    sf_dir, docs, seen = f"file://{tmp_path}", spark.read.parquet(f"file://{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns
        docs = corpus_pipeline.stored(out, "pipeline-test")
        seen[name] = [r.doc_id for r in docs.collect()]
    assert not [i for i in seen["quality"] if 300 <= i < 400]
    assert set(seen["near_dedup"]) == brute_pipeline(rows, set(seen["quality"])) and len(set(seen["near_dedup"])) == len(seen["near_dedup"])
    assert set(seen["mixing"]) <= set(seen["near_dedup"]) and max(Counter(seen["mixing"]).values()) <= 3
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert sum(r.length for r in pieces) == sum(r.doc_tokens for r in pieces if r.start == 0)
    assert Counter(r.doc_id for r in pieces if r.start == 0) == Counter(seen["mixing"])


def test_pipeline_of_empty_tables(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], DOCS).write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").collect() == []


def test_encoder_keeps_to_the_memory_that_its_caller_names():
    from redquill.llm.queries import tokenizer_path
    from redquill.llm.tokens import encoder

    texts = [" ".join(f"word{i}x{k}" for i in range(300)) for k in range(8)]
    wide = encoder(tokenizer_path(), 96 << 20)
    want = wide.encode(texts)
    assert wide.memo.most == 96 << 20 and wide.memo.held > 0
    narrow = encoder(tokenizer_path(), 1 << 16)
    assert narrow is wide and narrow.memo.held == 0  # what a wider bound let in is forgotten
    assert narrow.encode(texts) == want and narrow.memo.held <= 1 << 16
