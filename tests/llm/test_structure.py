"""Top N and connected groups against brute force, with nulls, ties, repeats, hot groups and empty tables."""

import random

import pytest

from lodestone.llm.components import components
from lodestone.llm.topn import top_n


def brute_top(rows, n):
    groups = {}
    for g, s, i in {r[:3] for r in rows}:
        if g is not None and s is not None and i is not None:
            groups.setdefault(g, []).append((-s, i))
    return {(g, -s, i, k + 1) for g, x in groups.items() for k, (s, i) in enumerate(sorted(x)[:n])}


@pytest.mark.parametrize("seed", range(3))
def test_top_n(spark, seed):
    r = random.Random(seed)
    rows = [("hot" if r.random() < 0.4 else f"g{r.randrange(40)}", float(r.randrange(6)), k) for k in range(900)]
    rows += [(None, 1.0, 1), ("g1", None, 2), ("g1", 9.0, None), ("", 1.0, 5)] + rows[:200]
    df = spark.createDataFrame([(*x, "g", 1) for x in rows], "g string, s double, i bigint, position string, carry int")
    for n in (1, 3, 7):
        got = {(x.g, x.s, x.i, x.position) for x in top_n(df, ["g"], "s", "i", n).collect()}
        assert got == brute_top(rows, n)


def test_top_n_of_several_columns_and_nothing(spark):
    df = spark.createDataFrame([("a", "x", 1.0, 1), ("a", "y", 2.0, 2), ("a", "x", 3.0, 3), (None, "x", 9.0, 4)], "k string, g string, s double, i bigint")
    assert {(r.k, r.g, r.i, r.position) for r in top_n(df, ["k", "g"], "s", "i", 1).collect()} == {("a", "x", 3, 1), ("a", "y", 2, 1)}
    assert top_n(df.limit(0), ["k"], "s", "i", 3).count() == 0
    with pytest.raises(ValueError):
        top_n(df, ["k"], "s", "i", 0)


def brute_groups(pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {(n, min(m for m in parent if find(m) == find(n))) for n in list(parent)}


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("bound", [1_000_000, 25])
def test_components(spark, seed, bound):
    r = random.Random(seed)
    pairs = [(f"n{r.randrange(90):02d}", f"n{r.randrange(90):02d}") for _ in range(70)] + [("é", "z"), ("s", "s"), (None, "n00"), ("n01", None)]
    pairs += [("hub", f"leaf{i:02d}") for i in range(40)] + [(f"c{i:02d}", f"c{i + 1:02d}") for i in range(40)] + pairs[:10]
    df = spark.createDataFrame([(*p, 0.5, "x") for p in pairs], "a string, b string, similarity double, node string").repartition(6)
    got = {(x.node, x.group) for x in components(df, "a", "b", max_task_edges=bound).collect()}
    assert got == brute_groups(pairs)


def test_components_of_nothing(spark):
    df = spark.createDataFrame([], "a string, b string")
    assert components(df, "a", "b").count() == 0
    alone = spark.createDataFrame([("x", "x"), ("x", None)], "a string, b string")
    assert [tuple(r) for r in components(alone, "a", "b").collect()] == [("x", "x")]


def test_top_n_counts_a_repeated_nan_once(spark):
    nan = float("nan")
    df = spark.createDataFrame([("a", nan, 1), ("a", nan, 1), ("a", nan, 2), ("a", 5.0, 3), ("a", 4.0, 4)] * 2, "g string, s double, i bigint").repartition(3)
    assert sorted((r.i, r.position) for r in top_n(df, ["g"], "s", "i", 3).collect()) == [(1, 1), (2, 2), (3, 3)]


def test_components_of_a_star(spark):
    """All leaves on one hub, far more than a task may hold at once."""
    df = spark.range(60_000).selectExpr("id AS a", "CAST(-1 AS BIGINT) AS b")
    got = components(df, "a", "b", max_task_edges=5_000)
    assert got.count() == 60_001 and got.where("group <> -1").isEmpty()
