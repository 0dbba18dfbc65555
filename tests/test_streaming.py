import json

from lodestone.streaming import watch


def put(folder, name, rows):
    (folder / name).write_text("".join(json.dumps(r) + "\n" for r in rows))


def event(path, minute, content):
    return {"path": path, "mtime": f"2024-01-01T00:{minute:02d}:00.000Z", "content": content}


def parse(df):
    return df.selectExpr("explode(split(content, ',')) AS e", "path").selectExpr("concat(path, '::f') AS src", "e AS dst")


def test_incremental_edges(spark, tmp_path):
    inbox, table, mark = tmp_path / "in", tmp_path / "edges", tmp_path / "mark"
    inbox.mkdir()
    put(inbox, "1.json", [event("a.py", 1, "x,y"), event("ab.py", 1, "z")])
    sizes = []
    run = lambda: watch.maintain(watch.change_stream(spark, str(inbox)), parse, str(table), str(mark), lambda e: sizes.append(e.count())).awaitTermination()
    run()
    assert {(r.src, r.dst) for r in watch.current(spark, str(table)).collect()} == {("a.py::f", "x"), ("a.py::f", "y"), ("ab.py::f", "z")}
    put(inbox, "2.json", [event("a.py", 2, "q"), event("a.py", 3, None)])
    run()
    assert {(r.src, r.dst) for r in watch.current(spark, str(table)).collect()} == {("ab.py::f", "z")}
    assert sizes == [3, 1]
    for k in range(3, 8):  # put together every second batch
        put(inbox, f"{k}.json", [event(f"p{k}.py", k, "x"), event("ab.py", k, f"z{k}")])
        watch.maintain(watch.change_stream(spark, str(inbox)), parse, str(table), str(mark), compact=2).awaitTermination()
    assert {(r.src, r.dst) for r in watch.current(spark, str(table)).collect()} == {("ab.py::f", "z7"), *((f"p{k}.py::f", "x") for k in range(3, 8))}


def test_stateful_changes(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    put(inbox, "1.json", [event("a", 1, "x"), event("b", 1, "x")])
    start = lambda: watch.changes(watch.change_stream(spark, str(inbox))).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start().awaitTermination()
    start()
    put(inbox, "2.json", [event("a", 2, "y"), event("b", 1, "x"), event("c", 1, "n")])
    start()
    put(inbox, "3.json", [event("c", 5, None), event("never", 5, None)])
    start()
    put(inbox, "4.json", [event("c", 6, None), event("c", 7, "again")])
    start()
    got = sorted((r.path, r.change) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("a", "added"), ("a", "modified"), ("b", "added"), ("c", "added"), ("c", "added"), ("c", "removed")]


def test_snapshot_diff(spark):
    a = spark.createDataFrame([("x", 1), ("y", 1), ("z", 1)], "path string, mtime int")
    b = spark.createDataFrame([("x", 1), ("y", 2), ("w", 1)], "path string, mtime int")
    assert {tuple(r) for r in watch.snapshot_diff(a, b).collect()} == {("y", "modified"), ("z", "removed"), ("w", "added")}


def test_churn_windows(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    rows = [{"ts": f"2024-01-0{d}T0{h}:10:00.000Z", "path": "p"} for d, h in ((1, 1), (1, 1), (1, 2), (9, 1))]
    put(inbox, "1.json", rows)
    s = spark.readStream.schema("ts timestamp, path string").json(str(inbox))
    watch.churn(s).writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "m")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.changes for r in spark.read.parquet(str(tmp_path / "o")).collect()) == [1, 2]
