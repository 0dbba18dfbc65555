import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import graph as G


def edges(spark, pairs):
    return spark.createDataFrame([(a, b) for a, b in pairs], "src string, dst string")


def names(df, column="node"):
    return sorted(r[column] for r in df.select(column).collect())


def reachable(pairs):
    out = {}
    for a, b in pairs:
        if a is not None and b is not None:
            out.setdefault(a, set()).add(b)
    found = set()
    for a in out:
        todo, seen = list(out[a]), set()
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += out.get(x, ())
        found |= {(a, x) for x in seen}
    return found


@pytest.mark.parametrize("seed", range(3))
def test_closure_of_random_graphs(spark, seed):
    r = random.Random(seed)
    pairs = [(f"n{r.randrange(14)}", f"n{r.randrange(14)}") for _ in range(22)] + [("n1", "n1"), (None, "n2"), ("n3", None)]
    pairs += pairs[:5]
    got = {(x.src, x.dst) for x in G.closure(edges(spark, pairs)).collect()}
    assert got == reachable(pairs)


def test_closure_of_a_long_chain(spark):
    pairs = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(40)]
    assert G.closure(edges(spark, pairs)).count() == 40 * 41 // 2


def test_empty_graph(spark):
    e = edges(spark, [])
    for df in (G.closure(e), G.degrees(e), G.components_strong(e), G.simple_cycles(e), G.pagerank(e), G.label_communities(e), G.break_cycle_edges(e)):
        assert df.count() == 0
    assert G.reach(e, spark.createDataFrame([("a",)], "node string")).count() == 0


def test_impact_excludes_the_target_unless_on_a_cycle(spark):
    one = lambda x: spark.createDataFrame([(x,)], "node string")
    chain = edges(spark, [("a", "b"), ("b", "c")])
    assert names(G.reach(chain, one("c"), backwards=True)) == ["a", "b"]
    assert names(G.reach(chain, one("b"), backwards=True)) == ["a"]
    assert names(G.reach(chain, one("a"), backwards=True)) == []
    assert names(G.reach(chain, one("unknown"), backwards=True)) == []
    loop = edges(spark, [("a", "b"), ("b", "a"), ("c", "c")])
    assert names(G.reach(loop, one("a"), backwards=True)) == ["a", "b"]
    assert names(G.reach(loop, one("c"), backwards=True)) == ["c"]


def test_bounded_reach_does_not_pass_through_closed_nodes(spark):
    e = edges(spark, [("d", "c"), ("c", "b"), ("b", "a"), ("x", "a"), ("y", "x"), ("z", "y"), ("w", "z")])
    changed = spark.createDataFrame([("a",), ("b",)], "node string")
    got = {r.node: r.depth for r in G.reach(e, changed, backwards=True, max_depth=3, closed=changed).collect()}
    assert got == {"c": 1, "x": 1, "d": 2, "y": 2, "z": 3}


def test_cycles_once_each(spark):
    e = edges(spark, [("a", "b"), ("b", "a"), ("b", "c"), ("c", "a"), ("d", "d"), ("d", "a")])
    got = sorted(tuple(r["cycle"]) for r in G.simple_cycles(e).collect())
    assert got == [("a", "b"), ("a", "b", "c"), ("d",)]
    assert G.simple_cycles(edges(spark, [("a", "b"), ("b", "c")])).count() == 0


def test_long_cycles_are_found(spark):
    """A ring of 12 with a short cut, against all circuits by depth-first search."""
    pairs = [(f"n{i:02d}", f"n{(i + 1) % 12:02d}") for i in range(12)] + [("n03", "n06"), ("n06", "n05"), ("x", "x")]
    out = {}
    for a, b in pairs:
        out.setdefault(a, []).append(b)
    want, todo = set(), [(a,) for a in out]
    while todo:
        path = todo.pop()
        for x in out[path[-1]]:
            if x == path[0]:
                want.add(path)
            elif x > path[0] and x not in path:
                todo.append((*path, x))
    got = [tuple(r["cycle"]) for r in G.simple_cycles(edges(spark, pairs)).collect()]
    assert max(map(len, want)) == 12 and sorted(got) == sorted(want)
    assert {len(r["cycle"]) for r in G.simple_cycles(edges(spark, pairs), max_length=2).collect()} == {1, 2}


def test_components_and_back_edges(spark):
    e = edges(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("e", "e")])
    assert {(r.node, r.scc) for r in G.components_strong(e).collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("d", "d"), ("e", "e")}
    cut = [(r.src, r.dst) for r in G.break_cycle_edges(e).collect()]
    assert len(cut) == 1
    left = [p for p in (("a", "b"), ("b", "c"), ("c", "a")) if p != cut[0]]
    assert G.simple_cycles(edges(spark, left)).count() == 0


def test_pagerank_keeps_its_mass(spark):
    r = G.pagerank(edges(spark, [("a", "b"), ("b", "c"), ("x", "c"), ("y", "c")]), rounds=15)
    assert abs(r.agg(F.sum("rank")).first()[0] - 1) < 1e-9
    assert r.orderBy(F.desc("rank")).first()["node"] == "c"


def test_pagerank_goes_on_to_the_tolerance(spark, tmp_path):
    """The query against plain iteration until all ranks together change by less than 1e-6 a node."""
    from lodestone import relations as R
    from lodestone.plans import graph_queries

    pairs = [(i, 9 if i > 9 else i + 1) for i in range(1, 14)] + [(9, 8)]
    spark.createDataFrame([(f"n{a}", f"n{b}", "imports") for a, b in pairs if (a, b) != (9, 10)], "source string, target string, type string").write.parquet(f"{tmp_path}/kg_edges.parquet")
    pairs = [tuple(r) for r in R.calls(spark, str(tmp_path)).collect()]
    nodes = {x for p in pairs for x in p}
    rank, rounds = dict.fromkeys(nodes, 1 / len(nodes)), 0
    while True:
        rounds += 1
        got, out = dict.fromkeys(nodes, 0.0), {a for a, _ in pairs}
        for a, b in pairs:
            got[b] += rank[a] / sum(x == a for x, _ in pairs)
        lost = sum(r for x, r in rank.items() if x not in out)
        new = {x: 0.15 / len(nodes) + 0.85 * (got[x] + lost / len(nodes)) for x in nodes}
        moved, rank = sum(abs(new[x] - rank[x]) for x in nodes), new
        if moved < len(nodes) * 1e-6:
            break
    assert 10 < rounds < 100
    want = {x: round(r, 6) for x, r in rank.items()}
    assert {r.node: r["rank"] for r in graph_queries.g12_pagerank(spark, str(tmp_path)).collect()} == want
    one, spread = (G.pagerank(R.calls(spark, str(tmp_path)), rounds=4, max_task_edges=b) for b in (10**6, 3))
    assert {r.node: round(r["rank"], 9) for r in spread.collect()} == {r.node: round(r["rank"], 9) for r in one.collect()}


@pytest.mark.parametrize("seed,bound", [(1, 10**6), (1, 8), (2, 8)])
def test_components_and_impacts_of_random_graphs(spark, seed, bound):
    """One task or many, against brute force."""
    r = random.Random(seed)
    pairs = [(f"n{r.randrange(25):02d}", f"n{r.randrange(25):02d}") for _ in range(40)]
    found = reachable(pairs)
    nodes = {x for p in pairs for x in p}
    e = edges(spark, pairs + pairs[:3] + [(None, "n01")])
    assert {x.node: x.impact for x in G.impact_sizes(e, bound).collect()} == {n: sum((m, n) in found for m in nodes) for n in nodes}
    assert {x.node: x.scc for x in G.components_strong(e, bound).collect()} == {n: min([n, *(m for m in nodes if (m, n) in found and (n, m) in found)]) for n in nodes}


def modularity(pairs, home):
    m = len(pairs)
    degree = {}
    for a, b in pairs:
        degree[a] = degree.get(a, 0) + 1
        degree[b] = degree.get(b, 0) + 1
    groups = set(home.values())
    inside = {g: sum(home[a] == home[b] == g for a, b in pairs) for g in groups}
    total = {g: sum(d for x, d in degree.items() if home[x] == g) for g in groups}
    return sum(inside[g] / m - (total[g] / (2 * m)) ** 2 for g in groups)


def test_greedy_modularity_part_by_part(spark):
    clique = lambda p, n: [(f"{p}{i}", f"{p}{j}") for i in range(n) for j in range(i)]
    pairs = clique("a", 4) + clique("b", 5) + clique("c", 3) + [("a0", "b0"), ("c0", "c1")]
    got = {r.node: r.community for r in G.communities(edges(spark, pairs + [("lone", "lone")])).collect()}
    assert got == {**{f"a{i}": "a0" for i in range(4)}, **{f"b{i}": "b0" for i in range(5)}, **{f"c{i}": "c0" for i in range(3)}, "lone": "lone"}
    plain = sorted({tuple(sorted(p)) for p in pairs})
    assert modularity(plain, got) > 0.5


@pytest.mark.parametrize("seed", range(2))
def test_label_rounds_are_the_same_in_one_task(spark, seed):
    r = random.Random(seed)
    pairs = [(f"n{r.randrange(30):02d}", f"n{r.randrange(30):02d}") for _ in range(60)]
    e = edges(spark, pairs)
    one, many = ({x.node: x.community for x in G.label_communities(e, rounds=5, max_task_edges=b).collect()} for b in (10**6, 1))
    assert one == many and set(one) == {x for p in pairs for x in p}


def test_communities_of_two_cliques(spark):
    clique = lambda p: [(f"{p}{i}", f"{p}{j}") for i in range(4) for j in range(i)]
    got = {r.node: r.community for r in G.label_communities(edges(spark, clique("a") + clique("b") + [("a0", "b0")])).collect()}
    assert len({got[f"a{i}"] for i in range(4)}) == 1 and len({got[f"b{i}"] for i in range(4)}) == 1 and got["a1"] != got["b1"]


def test_shortest_paths(spark):
    e = edges(spark, [("caller", "middle"), ("middle", "target"), ("caller", "other"), ("other", "target"), ("target", "target")])
    got = {r.node: (list(r["path"]), r.depth) for r in G.shortest_paths(e, spark.createDataFrame([("target",)], "node string")).collect()}
    assert got["middle"] == (["target", "middle"], 1)
    assert got["caller"] == (["target", "middle", "caller"], 2)
    assert "target" not in got


@pytest.mark.parametrize("words,key", [(None, F.xxhash64), (0, F.xxhash64), (None, lambda x: F.pmod(F.xxhash64(x), F.lit(5)))])
def test_impacts_of_a_heavy_component(spark, words, key):
    """g3_risk: a ring with nodes above, below and beside it, in one task, with every part left to blocks, and with names that
    share a hash."""
    ring = [(f"r{i}", f"r{(i + 1) % 6}") for i in range(6)]
    pairs = ring + [("a", "r0"), ("b", "a"), ("b", "x"), ("x", "y"), ("r3", "d"), ("d", "e"), ("x", "e"), ("p", "q"), ("q", "p"), ("q", "e"), ("p", "p"), ("z", "d"), ("lone", "lone")]
    found, nodes = reachable(pairs), {x for p in pairs for x in p}
    more = {} if words is None else {"part_words": words}
    got = {x.node: x.impact for x in G.impact_sizes(edges(spark, pairs + pairs[:4] + [(None, "a")]), key=key, **more).collect()}
    assert got == {n: sum((m, n) in found for m in nodes) for n in nodes}


def test_a_heavy_component_needs_no_wide_sets():
    """a24_changed_risk: what lies above components that everything meets is one sum each, so sets of a few words do."""
    import numpy as np

    from lodestone.operators import impacts

    heavy, n = 3, 3_000  # nodes 0 to 2 are heavy, the later ones below the earlier; the others lie above one of them and the last
    up = np.arange(heavy, n)
    a, b = np.concatenate([up, up, [0, 1]]), np.concatenate([up % heavy, np.full(len(up), 2), [2, 2]])
    weight = np.where(np.arange(n) < heavy, 1_000, 1)
    size, _, _, left, _ = impacts.sizes(a, b, weight, part_words=1_000_000 // 64)
    assert not len(left)
    want = [1_000 + (up % heavy == k).sum() for k in range(2)]
    assert size[:heavy].tolist() == [*want, 3_000 + n - heavy] and (size[heavy:] == 1).all()


def test_risk_of_a_graph_with_repeats(spark, tmp_path):
    """g3_risk: repeated edges and unknown targets change nothing, and the complexity of files is added to the impact."""
    from lodestone.plans import graph_queries

    rows = [("a", "b", "imports"), ("a", "b", "imports"), ("b", "a", "imports"), ("b", "c", "imports"), ("c", "ext:x", "imports"), ("c", None, "imports")]
    spark.createDataFrame(rows, "source string, target string, type string").write.parquet(f"{tmp_path}/kg_edges.parquet")
    spark.createDataFrame([("c", 45), ("a", None)], "file_path string, nloc int").write.parquet(f"{tmp_path}/file_contexts.parquet")
    assert {r["node"]: (r.impact, r.risk) for r in graph_queries.g3_risk(spark, str(tmp_path)).collect()} == {"a": (2, 2), "b": (2, 2), "c": (2, 4)}
