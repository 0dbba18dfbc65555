import math
import random

import pytest

from pyspark.sql import functions as F

from lodestone.functions import paths
from lodestone.operators import biomarkers, eager, history, scoring, text, vectors


def finding(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "finding_id bigint, file_path string, biomarker_type string, severity string, deduction double")


def test_scores_in_closed_form(spark):
    f = finding(spark, [("a", "complex_method", "high", None), ("b", "complex_method", "high", None), ("b", "brain_method", "critical", None), (None, "brain_method", "critical", None), ("c", "unknown", "odd", None), ("d", "ownership_risk", "low", 100.0)])
    got = {r.file_path: r for r in scoring.file_scores(f).collect()}
    assert math.isclose(got["a"].defect, 8.548) and got["a"].maintainability == 10
    assert math.isclose(got["b"].defect, 7.548) and math.isclose(got["b"].maintainability, 8.0)
    assert math.isclose(got["c"].defect, 9.5) and math.isclose(got["d"].defect, 6.5)
    assert None not in got
    impacts = {r.finding_id: r.impact for r in scoring.finding_impacts(f).collect()}
    assert math.isclose(impacts[5], 3.5) and 3 not in impacts
    assert scoring.file_scores(f.limit(0)).count() == 0


def test_eager_join_equals_the_plain_join(spark):
    a = spark.createDataFrame([("k", 1), ("k", 2), ("hot", 5), ("hot", 5), (None, 9), ("only", 1)], "key string, x int").withColumn("n", F.lit("extra"))
    b = spark.createDataFrame([("k", 10), ("hot", 1), ("hot", 2), ("hot", None), (None, 3)], "key string, y int").withColumn("n", F.lit("clash"))
    got = {r.key: r for r in eager.eager_join(a, b, "key", "key", {"sx": F.col("x")}, {"sy": F.col("y")}, {"sxy": ("sx", "sy")}).collect()}
    plain = {r.key: r for r in a.drop("n").join(b.drop("n"), "key").groupBy("key").agg(F.count(F.lit(1)).alias("pairs"), F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.sum(F.col("x") * F.col("y")).alias("sxy")).collect()}
    assert {k: (r.pairs, r.sx, r.sy, r.sxy) for k, r in got.items()} == {k: (r.pairs, r.sx, r.sy, r.sxy) for k, r in plain.items()}
    left = {r.key: r.pairs for r in eager.eager_join(a, b, "key", "key", how="left").collect()}
    assert left == {"k": 2, "hot": 6, "only": 1}
    assert eager.eager_join(a.limit(0), b, "key", "key").count() == 0


def test_distinct_partners(spark):
    e = spark.createDataFrame([("a", "t"), ("a", "t"), ("b", "t"), (None, "t"), ("a", None)], "s string, t string")
    assert [(r.key, r.n) for r in eager.distinct_partners(e, "t", "s", "n").collect()] == [("t", 2)]


def test_layers_and_tags(spark):
    rows = {"src/api/x.py": "API", "tests/api/x.py": "Test", "api/test_x.py": "Test", ".github/x.py": "Config", "docs/api/x.py": "Docs & Tooling", "api/models/x.py": "Data", "x.py": "Application", "spec/x.py": "Application", "": "Application", None: None}
    df = spark.createDataFrame([(p,) for p in rows], "p string")
    assert {r.p: r.layer for r in df.select("p", paths.layer(F.col("p")).alias("layer")).collect()} == rows
    tags = spark.createDataFrame([("db/env_settings.py",), ("a/b.py",)], "p string").select(paths.risk_tags(F.col("p")).alias("t"), paths.safe_to_delete(F.lit(0.9), F.col("p")).alias("safe")).collect()
    assert [(list(r.t), r.safe) for r in tags] == [(["config", "database", "environment"], False), ([], True)]


def test_detectors_read_nulls_as_nothing(spark):
    f = spark.createDataFrame([("f", 25, None, None, 120, 5, 6), ("g", None, None, None, None, None, None)], "function string, ccn int, n_vars int, n_ifs int, loc int, depth int, n_args int")
    got = {(r.function, r.biomarker_type, r.severity) for r in biomarkers.detect(f, biomarkers.FUNCTION_DETECTORS, ["function"]).collect()}
    assert got == {("f", "complex_method", "high"), ("f", "large_method", "high"), ("f", "nested_complexity", "medium"), ("f", "primitive_obsession", "low")}


def test_ownership_ties_and_ranges(spark):
    c = spark.sql("SELECT * FROM VALUES (1L,'bo',timestamp'2024-01-01','p',true),(2L,'al',timestamp'2024-01-02','p',false),(3L,'al',timestamp'2024-01-02',null,false) AS t(sha,author,ts,path,is_fix)")
    assert [(r.top_author, r.share, r.contributors, r.bus_factor) for r in history.ownership(c).collect()] == [("al", 0.5, 2, 2)]
    blame = spark.createDataFrame([("f", i, f"s{i % 2}", 10 * i, "al" if i < 90 else "bo", "" if i < 100 else f"bo{i}@x") for i in range(1, 131)], "file_path string, line_no int, sha string, author_ts bigint, author string, email string")
    fns = spark.createDataFrame([("f", "one", 60, 130), ("f", "none", 500, 510)], "file_path string, function string, start int, end int")
    r = history.owner_in_ranges(blame, fns, since=1300).collect()
    assert [(x.function, x.owner, x.email, x.lines, x.commits, x.recent_commits, x.median_ts) for x in r] == [("one", "bo", "bo100@x", 71, 2, 1, 950)]


def test_co_changes_without_pairs(spark):
    c = spark.createDataFrame([("g1", "a"), ("g1", "b"), ("g1", "b"), ("g2", "a"), ("g2", "c"), ("g3", "d"), (None, "a")], "g string, path string")
    assert {r.path: r.co_change_partners for r in history.co_changes(c, F.col("g")).collect()} == {"a": 2, "b": 1, "c": 1, "d": 0}


def codes(df):
    return df.select(F.col("id").alias("file"), text.codes(F.col("content")).alias("codes"))


def test_clones_link_each_place_once(spark):
    body = " ".join(f"v{i} + ({i}) ;" for i in range(30))
    df = spark.createDataFrame([(1, body), (2, body), (3, body), (4, None), (5, ""), (6, "x")], "id int, content string")
    got = {(r.file_a, r.file_b, r.start_a, r.start_b): r.length for r in text.clones(codes(df)).collect()}
    n = df.where("id = 1").select(F.size(text.tokens(F.col("content")))).first()[0]
    assert got[(1, 2, 1, 1)] == n and got[(1, 3, 1, 1)] == n and (2, 3, 1, 1) not in got


def test_a_third_file_cuts_no_clone(spark):
    """Brute force over all pairs: a short first file that holds the middle of a long pair's passage."""
    r = random.Random(4)
    body = [r.choice("+-*/%()[]{}<>=!&|^~?:.,") for _ in range(110)]
    other = lambda seed, n: [random.Random(seed).choice("0123456789") for _ in range(n)]
    rows = {1: body[30:80], 2: other(2, 7) + body + other(3, 5), 3: other(4, 3) + body + other(5, 9), 4: other(6, 70), 5: body[:62] + other(7, 20)}
    df = spark.createDataFrame([(k, " ".join(v)) for k, v in rows.items()], "id int, content string")
    got = {tuple(x) for x in text.clones(codes(df), 60).select("file_a", "start_a", "file_b", "start_b", "length").collect()}
    assert (2, 8, 3, 4, 110) in got
    share = lambda a, b: {tuple(a[i : i + 60]) for i in range(len(a) - 59)} & {tuple(b[i : i + 60]) for i in range(len(b) - 59)}
    want = {a for a in rows for b in rows if a != b and share(rows[a], rows[b])}
    assert {x for g in got for x in (g[0], g[2])} == want
    short = {tuple(x) for x in text.clones(codes(df), 20).select("file_a", "start_a", "file_b", "start_b", "length").collect()}
    assert (2, 8, 3, 4, 110) in short and (1, 1, 2, 38, 50) in short


@pytest.mark.parametrize("seed", range(3))
def test_clones_of_hot_windows(spark, seed):
    """One window in a third of all places, cut over several partitions: each row is a passage that goes no further to either
    side, and each file with a window in common stands in one."""
    r = random.Random(seed)
    size, rows = 6, {}
    for k in range(60):
        body = "".join(r.choice("xyz,;") for _ in range(r.randrange(30)))
        at = r.randrange(len(body) + 1)
        rows[k] = body[:at] + "(((((((((((" * (k % 3 == 0) + body[at:]
    df = spark.createDataFrame(list(rows.items()), "file int, codes string").repartition(5)
    got = [tuple(x) for x in text.clones(df, size).select("file_a", "start_a", "file_b", "start_b", "length").collect()]
    assert len(set(got)) == len(got)
    for f, a, g, b, n in got:
        x, y = rows[f], rows[g]
        assert n >= size and x[a - 1 : a - 1 + n] == y[b - 1 : b - 1 + n]
        assert a == 1 or b == 1 or x[a - 2] != y[b - 2]
        assert a - 1 + n == len(x) or b - 1 + n == len(y) or x[a - 1 + n] != y[b - 1 + n]
    windows = {k: {v[i : i + size] for i in range(len(v) - size + 1)} for k, v in rows.items()}
    want = {f for f in rows if any(windows[f] & windows[g] for g in rows if g != f)}
    assert want <= {x for g in got for x in (g[0], g[2])}


def test_decisions(spark):
    df = spark.createDataFrame([(1, "Use the cache because it is fast\nmisuse of causes\n# x"), (2, None), (3, "")], "id int, text string")
    assert [(r.id, r.line) for r in text.decision_lines(df, "id", "text").collect()] == [(1, "Use the cache because it is fast")]
    adr = spark.createDataFrame([(1, "# Title\n\n## Status\nAccepted\n\nBody")], "id int, text string")
    assert [(r.title, r.status) for r in text.decision_records(adr, "id", "text").collect()] == [("Title", "Accepted")]


def test_nearest_in_blocks(spark):
    v = spark.createDataFrame([(i, [float(i % 5), 1.0, float(i % 3)]) for i in range(20)] + [(98, None), (99, [0.0, 0.0, 0.0]), (97, [1.0])], "vec_id int, embedding array<float>")
    one = sorted(map(tuple, vectors.nearest(v, v.where("vec_id < 6"), 4).collect()))
    many = sorted(map(tuple, vectors.nearest(v, v.where("vec_id < 6"), 4, block=2).collect()))
    assert one == many and len(one) == 24
    assert [x[1] for x in sorted(one, key=lambda x: x[3]) if x[0] == 0][:2] == [0, 15]
    assert vectors.nearest(v, v.limit(0), 3).count() == 0
    stored = spark.createDataFrame([(1, "a"), (2, "b")], "id int, x string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "id int, x string")
    assert sorted(map(tuple, vectors.upsert(stored, new, "id").collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert sorted(map(tuple, vectors.delete(stored, new, "id").collect())) == [(1, "a")]
