import json

import pytest
from pyspark.sql import functions as F

from lodestone import exporters
from lodestone.cache import TimedCache
from lodestone.engine import Engine
from lodestone.functions import embedders


def test_engine(spark, tmp_path):
    (tmp_path / "a.py").write_text("from b import helper\n\ndef main():\n    helper()\n    inner()\n\ndef inner():\n    helper()\n\ndef unused():\n    pass\n")
    (tmp_path / "b.py").write_text("def helper():\n    if 1:\n        return 2\n")
    e = Engine(spark, str(tmp_path))
    assert {r.node for r in e.impact("helper").collect()} == {"a.py::main", "a.py::inner"}
    assert {r.node for r in e.dead_code().collect()} == {"a.py::unused"}
    assert e.hotspots(1).first()["node"] == "b.py::helper"
    assert e.cycles().count() == 0
    assert {(r.node, r.depth) for r in e.explain("helper").collect()} == {("a.py::main", 1), ("a.py::inner", 1)}
    assert e.mermaid().startswith("graph TD\n")
    s = json.loads(e.sarif())
    assert s["version"] == "2.1.0" and len(s["runs"]) == 1 and {r["level"] for r in s["runs"][0]["results"]} == {"warning"}
    assert exporters.tree(e.edges, "a.py::main").splitlines() == ["a.py::main", "  a.py::inner", "    b.py::helper", "  b.py::helper (seen)"]
    assert "<h2>hot &amp; cold</h2>" in exporters.page("t", {"hot & cold": e.hotspots()})
    assert '"a.py::main" -> "b.py::helper"' in exporters.dot(e.edges)
    status = spark.createDataFrame([(" M b.py",)], "value string")
    assert [r.node for r in e.changed(status).collect()] == ["b.py::helper"]
    changed = spark.createDataFrame([("b.py",)], "path string")
    assert {(r.node, r.depth) for r in e.blast_radius(changed).collect()} == {("a.py::main", 1), ("a.py::inner", 1)}
    assert {r.node for r in e.timeline(changed, changed.limit(0)).where("changed_last AND NOT changed_before").collect()} == {"b.py::helper"}
    assert {(r.path, r.defect) for r in e.health().collect()} == {("a.py", 10.0), ("b.py", 10.0)}
    assert e.overview().agg({"files": "sum"}).first()[0] == 2 and e.duplication().count() == 0
    (tmp_path / "more").mkdir()
    (tmp_path / "more" / "b.py").write_text("def helper():\n    return 1\n")
    assert {(r.node, r.side) for r in Engine(spark, str(tmp_path / "more")).diff(e).collect()} == {(n, "base") for n in ("a.py::main", "a.py::inner", "a.py::unused")}


def test_timed_cache(spark):
    now, made = [0.0], []
    cache = TimedCache(60, lambda: now[0])
    make = lambda: made.append(1) or spark.range(len(made))
    assert [cache.get("g", make).count(), cache.get("g", make).count()] == [1, 1]
    now[0] = 61
    assert cache.get("g", make).count() == 2 and len(made) == 2
    cache.clear()


def test_embedders(spark):
    v = spark.createDataFrame([("a",), (None,)], "t string").select(embedders.embedder("mock")(F.col("t")).alias("v")).collect()
    assert sorted(len(r.v) if r.v else 0 for r in v) == [0, 16] and "mock" in embedders.names()
    with pytest.raises(KeyError):
        embedders.embedder("none")
    with pytest.raises(ValueError):
        embedders.register("mock", embedders.mock)
