import itertools
import random
import tracemalloc

import pytest

from redquill.operators import schedule, textdiff
from redquill.operators.markdown import strip_marks, stripped
from redquill.operators.schedule import order_batch, scheduled
from redquill.operators.textdiff import char_diff, insertion_diff, refined, tokens, word_diff


@pytest.mark.parametrize(
    "text, clean, hints",
    [
        ("plain", "plain", []),
        ("a **b** c", "a b c", [(2, 3, "bold")]),
        ("***x***", "x", [(0, 1, "bold italic")]),
        ("**a *b* c**", "a b c", [(0, 5, "bold"), (2, 3, "italic")]),
        ("**++x++**", "x", [(0, 1, "bold underline")]),
        ("~~x~~ ++z++", "x z", [(0, 1, "strikethrough"), (2, 3, "underline")]),
        ("~y~", "y", [(0, 1, "strikethrough")]),
        # A scan for one sign reads on from where it matched last, so the second pair is out of step.
        ("~~x~~ ~y~", "x ~y~", [(0, 1, "strikethrough")]),
        ("snake_case_name and _____", "snake_case_name and _____", []),
        ("_x_ __y__", "x y", [(0, 1, "italic"), (2, 3, "bold")]),
        ("<B>x</b> <em>y</em>", "x y", [(0, 1, "bold"), (2, 3, "italic")]),
        ("&lt;b&gt;x &amp; y&lt;/b&gt;", "x & y", [(0, 5, "bold")]),
        ("<b>a <i>b</i></b>", "a b", [(0, 3, "bold"), (2, 3, "italic")]),
        ("", "", []),
    ],
)
def test_marks(text, clean, hints):
    assert strip_marks(text) == (clean, hints)


def test_marks_of_rows(spark):
    rows = {r.doc_id: (r.clean, [tuple(h) for h in r.hints]) for r in stripped(spark.createDataFrame([(1, "a **b**"), (2, None)], "doc_id long, text string"), "doc_id long").collect()}
    assert rows == {1: ("a b", [(2, 3, "bold")]), 2: ("", [])}


def _first_order(ops):
    """The least order by brute force: of all permutations that keep makers first, the first by (comment, index) at each place."""
    makers = {made: i for i, _, made, _, _ in ops if made}
    key = {i: (kind != "comment", i) for i, kind, *_ in ops}
    fits = [p for p in itertools.permutations([o[0] for o in ops]) if all(p.index(makers[used]) < p.index(i) for i, _, _, used, _ in ops if used)]
    return min(fits, key=lambda p: [key[i] for i in p])


def test_order_by_brute_force():
    rng = random.Random(4)
    for _ in range(60):
        n = rng.randrange(1, 7)
        ops = [(i, rng.choice(["comment", "redline"]), f"k{i}" if rng.random() < 0.6 else None, None, f"s{i}") for i in range(n)]
        keys = [o[2] for o in ops if o[2]]
        ops = [(i, k, m, rng.choice([x for x in keys if int(x[1:]) < i] or [None]) if rng.random() < 0.7 else None, s) for i, k, m, _, s in ops]
        steps, code = order_batch(ops)
        assert code is None and tuple(sorted(steps, key=steps.get)) == _first_order(ops)


def test_refusals(spark):
    cases = {
        1: ([(0, "redline", "a", None, None), (1, "redline", "a", None, None)], "DUPLICATE_CAPTURE_KEY"),
        2: ([(0, "redline", None, "x", None)], "CAPTURE_NOT_FOUND"),
        3: ([(0, "redline", "a", "a", None)], "CAPTURE_DEPENDENCY_CYCLE"),
        4: ([(0, "redline", "a", "b", None), (1, "redline", "b", "a", None)], "CAPTURE_DEPENDENCY_CYCLE"),
        5: ([(0, "redline", "a", None, None), (1, "redline", None, "a", None), (2, "redline", None, "a", None)], "CAPTURE_FANOUT_CONFLICT"),
        6: ([(0, "redline", "a", None, None), (1, "redline", None, "a", "p"), (2, "redline", None, "a", "q")], None),
        7: ([(0, "redline", " ", None, None)], "INVALID_OPERATION"),
    }
    for ops, code in cases.values():
        assert order_batch(ops)[1] == code
    rows = [(doc, *op) for doc, (ops, _) in cases.items() for op in ops]
    got = scheduled(spark.createDataFrame(rows, "doc_id long, op int, kind string, made string, used string, selector string")).collect()
    assert {r.doc_id: r.code for r in got} == {doc: code for doc, (_, code) in cases.items()}
    assert sorted((r.op, r.step) for r in got if r.doc_id == 6) == [(0, 1), (1, 2), (2, 3)]


def _holds(ops, old, new):
    assert "".join(t for _, k, _, _, t in ops if k != "insert") == old
    assert "".join(t for _, k, _, _, t in ops if k != "delete") == new
    assert all(old[s:e] == (t if k != "insert" else "") for _, k, s, e, t in ops)


def test_semantic_and_character_differences_rebuild_both_versions():
    rng = random.Random(2)
    for _ in range(400):
        old, new = (" ".join(rng.choice(["agents", "and", "attorneys", "a", "the", "x,", "counsel"]) for _ in range(rng.randrange(9))) for _ in "ab")
        _holds(word_diff(old, new, semantic=True), old, new)
        _holds(char_diff(old, new), old, new)


def test_scattered_changes_are_one_and_words_anchor():
    assert [(k, t) for _, k, _, _, t in word_diff("r1 r2 a g1 g2", "o1 o2 a t1 t2", semantic=True)] == [("delete", "r1 r2 a g1 g2"), ("insert", "o1 o2 a t1 t2")]
    inner = refined([["delete", tokens("agents and attorneys")], ["insert", tokens("agents, attorneys, accountants")]])
    assert [(k, "".join(t)) for k, t in inner] == [("equal", "agents"), ("delete", " and"), ("insert", ","), ("equal", " attorneys"), ("insert", ", accountants")]
    # Function words alone anchor nothing.
    kept = [["delete", tokens("of the a")], ["insert", tokens("a of")]]
    assert refined(kept) == kept


def test_insertions_only():
    assert [(k, t) for _, k, _, _, t in insertion_diff("ac", "abc")] == [("equal", "a"), ("insert", "b"), ("equal", "c")]
    assert insertion_diff("abc", "ac") is None and insertion_diff("", "x") == [(0, "insert", 0, 0, "x")]
    rng = random.Random(5)
    for _ in range(300):
        old, new = ("".join(rng.choice("ab") for _ in range(rng.randrange(7))) for _ in "ab")
        only = any("".join(c) == old for c in itertools.combinations(new, len(old)))
        got = insertion_diff(old, new)
        assert (got is not None) == only and (got is None or all(op[1] != "delete" for op in got))


def _common(a, b):
    d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            d[i + 1][j + 1] = d[i][j] + 1 if x == y else max(d[i][j + 1], d[i + 1][j])
    return d[-1][-1]


def test_scripts_are_shortest_and_rebuild_both_texts():
    rng = random.Random(1)
    for _ in range(800):
        a, b = ["".join(rng.choice(["a", "b", " ", "word", ","]) for _ in range(rng.randrange(14))) for _ in range(2)]
        assert len(textdiff._pairs(tokens(a), tokens(b))) == _common(tokens(a), tokens(b))
        for semantic in (False, True):
            rows = word_diff(a, b, semantic)
            assert "".join(r[4] for r in rows if r[1] != "insert") == a and "".join(r[4] for r in rows if r[1] != "delete") == b


def test_heaviest_chain_by_brute_force():
    rng = random.Random(2)
    weight = lambda t: len(t) * (100 if len(t) > 3 else 1)
    for _ in range(500):
        a, b = [[rng.choice(["word", "other", " ", "a", ","]) for _ in range(rng.randrange(12))] for _ in range(2)]
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = max(best[i + 1][j], best[i][j + 1], best[i][j] + weight(x) * (x == y))
        chain = textdiff._heaviest(a, b)
        assert all(a[i] == b[j] for i, j in chain) and all(p < q and r < s for (p, r), (q, s) in zip(chain, chain[1:]))
        assert sum(weight(a[i]) for i, _ in chain) == best[-1][-1]


def test_long_texts_without_a_common_word():
    a, b = (" ".join(f"{x}{i}" for i in range(20_000)) for x in "ab")
    tracemalloc.start()
    rows = word_diff(a, b, semantic=True)
    assert tracemalloc.get_traced_memory()[1] < 200 << 20
    tracemalloc.stop()
    assert "".join(r[4] for r in rows if r[1] != "insert") == a


def test_a_refused_pair_is_an_error_row(spark, monkeypatch):
    def refuse(old, new):
        if old == "x":
            raise ValueError("DIFF_TOKEN_LIMIT")
        return word_diff(old, new)

    pairs = spark.createDataFrame([(1, "x", "y"), (2, "a b", "a c")], "id long, old string, new string")
    got = {(r.id, r.type, r.text) for r in textdiff.diff_rows(pairs, "id long", refuse).collect()}
    assert (1, "error", "DIFF_TOKEN_LIMIT") in got and (2, "insert", "c") in got


def test_schedule_of_many_batches_equals_each_alone(spark):
    rng, rows = random.Random(4), []
    for doc in range(200):
        for op in range(rng.randrange(1, 6)):
            rows.append((doc, op, rng.choice(["comment", "redline"]), rng.choice([None, f"k{op}"]), rng.choice([None, None, f"k{rng.randrange(4)}"]), rng.choice([None, f"s{op}"])))
    got = {(r.doc_id, r.op): (r.step, r.code) for r in schedule.scheduled(spark.createDataFrame(rows, "doc_id long, op int, kind string, made string, used string, selector string").repartition(7)).collect()}
    assert len(got) == len(rows)
    for doc in range(200):
        steps, code = schedule.order_batch([r[1:] for r in rows if r[0] == doc])
        assert all(got[doc, r[1]] == (steps.get(r[1]), code) for r in rows if r[0] == doc)


def test_an_edit_without_a_place_is_refused():
    from redquill.operators.redline import redline

    xml = b'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>a b</w:t></w:r></w:p></w:body></w:document>'
    assert redline(xml, [(None, "x")], "me", "2020-01-01T00:00:00Z") == (xml, [(None, "TARGET_NOT_FOUND")])
