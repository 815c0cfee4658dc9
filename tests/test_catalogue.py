import os
import random

import duckdb
import pytest

from redquill.operators.textdiff import tokens, word_diff
from redquill.plans import catalogue, content, packages, requests  # noqa: F401

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for name in catalogue.TABLES:
        con.sql(f"CREATE VIEW {name} AS FROM '{SF}/{name}.parquet'")
    return con


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    value = lambda v: round(v, 6) if isinstance(v, float) else v
    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=repr)


QUERIES = {**catalogue.QUERIES, **packages.QUERIES}
ORACLES = {**catalogue.ORACLES, **packages.ORACLES}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    want = duck.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert plain(map(tuple, df.collect()), df.columns) == plain(want.fetchall(), want.columns)


def test_word_diff_invariants():
    rng = random.Random(1)
    for _ in range(400):
        old, new = ("".join(rng.choice(["a", "b", "cc", " ", "  ", ".", ",", "\n", "(d)"]) for _ in range(rng.randrange(14))) for _ in "ab")
        ops = word_diff(old, new)
        assert "".join(t for _, k, _, _, t in ops if k != "insert") == old
        assert "".join(t for _, k, _, _, t in ops if k != "delete") == new
        at = 0
        for _, kind, start, end, text in ops:
            assert start == at and end == (at if kind == "insert" else at + len(text)) and (kind == "insert" or old[start:end] == text)
            at = end


def test_tokens_split_edge_punctuation():
    assert tokens(' "Hi," (x) ...') == [" ", '"', "Hi", ",", '"', " ", "(", "x", ")", " ", "..."]


def test_shortest_script():
    assert [(k, t) for _, k, _, _, t in word_diff("a b c", "a x c")] == [("equal", "a "), ("delete", "b"), ("insert", "x"), ("equal", " c")]


def test_entry_runs_without_the_corpus_operators(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries()) and set(catalogue.QUERIES) <= set(e.queries())
