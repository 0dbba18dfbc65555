import json
import os

from lodestone.plans import source_queries
from lodestone.sources import config, git_text, line_sources, python_source, registry, scan


def write(root, files):
    for name, text in files.items():
        path = os.path.join(root, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w") as f:
            f.write(text)


def parsed(spark, tmp_path, files):
    write(tmp_path, files)
    f = scan.scan(spark, str(tmp_path))
    return f, python_source.parse(f)


def edges(spark, tmp_path, files):
    f, rows = parsed(spark, tmp_path, files)
    return {(r.src, r.dst) for r in python_source.call_edges(rows, f).collect()}


def test_imported_function(spark, tmp_path):
    e = edges(spark, tmp_path, {"pkg/__init__.py": "", "pkg/util.py": "def helper():\n    return 1\n", "pkg/main.py": "from pkg.util import helper\n\ndef run():\n    return helper()\n"})
    assert ("pkg/main.py::run", "pkg/util.py::helper") in e


def test_relative_package_and_star_imports(spark, tmp_path):
    e = edges(spark, tmp_path, {
        "pkg/__init__.py": "def setup():\n    pass\n", "pkg/sub.py": "def helper():\n    pass\n",
        "pkg/main.py": "from .sub import helper\nfrom . import sub\nimport os\nfrom mod import *\n\ndef run():\n    helper()\n    sub.helper()\n    os.getcwd()\n",
        "app.py": "from pkg import setup\n\ndef start():\n    setup()\n", "mod.py": "def x():\n    pass\n",
    })
    assert e == {("pkg/main.py::run", "pkg/sub.py::helper"), ("app.py::start", "pkg/__init__.py::setup")}


def test_methods_decorators_and_entry(spark, tmp_path):
    f, rows = parsed(spark, tmp_path, {"run.py": "def logger(f):\n    return f\n\n@logger\ndef main():\n    pass\n\nclass A:\n    def a(self):\n        self.b()\n    def b(self):\n        pass\n\nif __name__ == '__main__':\n    main()\n"})
    e = {(r.src, r.dst) for r in python_source.call_edges(rows, f).collect()}
    assert e == {("run.py::main", "run.py::logger"), ("run.py::A.a", "run.py::A.b")}
    assert [r.node for r in python_source.entry_points(rows).collect()] == ["run.py::main"]


def test_metrics_and_line_numbers(spark, tmp_path):
    _, rows = parsed(spark, tmp_path, {"mod.py": "def simple():\n    return 1\n\ndef branchy(x):\n    if x:\n        for i in x:\n            while i:\n                i.close()\n    return x\n", "bad.py": "def (\n"})
    f = {r.name: r for r in python_source.functions(rows).collect()}
    assert (f["simple"].lineno, f["branchy"].lineno) == (1, 4)
    assert (f["simple"].ccn, f["branchy"].ccn, f["branchy"].depth, f["branchy"].io_in_loop) == (1, 4, 3, 2)
    assert [r.path for r in rows.where("kind = 'error'").collect()] == ["bad.py"]
    found = {(r.node, r.biomarker_type) for r in python_source.syntax_findings(rows).collect()}
    assert ("mod.py::branchy", "io_in_loop") in found


def test_scan_prunes_folders_and_ignored_files(spark, tmp_path):
    write(tmp_path, {".venv/lib.py": "", "src/main.py": "x = 1\n", "generated/code.py": "", "node_modules/a.js": "", ".gitignore": "generated/\n*.tmp.py\n!keep.tmp.py\n", "a.tmp.py": "", "keep.tmp.py": "", "notes.txt": "no"})
    got = sorted(r.path for r in scan.scan(spark, str(tmp_path)).collect())
    assert got == ["keep.tmp.py", "src/main.py"]
    assert len(scan.scan(spark, str(tmp_path), respect_ignore=False).collect()) == 4


def test_cache_split(spark, tmp_path):
    write(tmp_path, {"a.py": "x = 1\n", "b.py": "y = 2\n"})
    f = scan.scan(spark, str(tmp_path))
    hits, misses = scan.cache_split(f, f.where("path = 'a.py'"))
    assert [r.path for r in hits.collect()] == ["a.py"] and [r.path for r in misses.collect()] == ["b.py"]


def test_other_languages(spark, tmp_path):
    write(tmp_path, {
        "app.js": "const { helper } = require('./lib/helper');\nfunction greet() {\n  helper();\n}\nconst main = () => {\n  greet();\n};\n",
        "lib/helper.js": "function helper() {}\n",
        "a.go": "package a\n\nfunc One() {\n\tTwo()\n}\n\nfunc Two() {}\n",
        "A.java": "class A {\n  void one() {\n    two();\n  }\n  void two() {\n  }\n}\n",
        "a.rs": "fn one() {\n    two();\n}\nfn two() {}\n",
    })
    f = scan.scan(spark, str(tmp_path))
    got = {(r.src, r.dst) for r in line_sources.call_edges(line_sources.parse(f)).collect()}
    assert {("app.js::greet", "lib/helper::helper"), ("app.js::main", "app.js::greet"), ("a.go::One", "a.go::Two"), ("A.java::one", "A.java::two"), ("a.rs::one", "a.rs::two")} <= got
    assert registry.project_edges(f).count() == len(got)


def lines(spark, *text):
    return spark.createDataFrame([(t,) for t in text], "value string")


def test_worktree_and_ref_changes(spark):
    got = git_text.worktree_changes(lines(spark, " M a.py", "?? b.py", "R  old.py -> new.py", "DD gone.py", "x", ""))
    assert {(r.status, r.path) for r in got.collect()} == {(" M", "a.py"), ("??", "b.py"), ("R ", "new.py")}
    code = git_text.code_changes(git_text.ref_changes(lines(spark, "a.py", "tests/b.py", "c.js", "d.md", "build/e.js", "")))
    assert sorted(r.path for r in code.collect()) == ["a.py", "c.js"]
    n = spark.createDataFrame([("a.py::f",), ("a.py2::g",), ("x/a.py::h",)], "node string")
    assert [r.node for r in git_text.changed_functions(n, code).collect()] == ["a.py::f"]


def test_log_and_blame(spark):
    assert [(r.sha, r.subject) for r in git_text.log_lines(lines(spark, "abc1234 Use X because Y", "no sha")).collect()] == [("abc1234", "Use X because Y")]
    sha = "a" * 40
    blame = f"{sha} 1 1 2\nauthor Ann\nauthor-mail <ann@x>\nauthor-time 100\nfilename f.py\n\tx = 1\n{sha} 2 2\n\ty = 2\n"
    rows = git_text.blame_lines(spark.createDataFrame([("f.py", blame), ("g.py", None), ("h.py", "")], "path string, content string")).collect()
    assert [(r.line_no, r.author, r.author_ts, r.email) for r in rows] == [(1, "Ann", 100, "ann@x"), (2, "Ann", 100, "ann@x")]


def test_config(spark, tmp_path):
    assert config.load_config(str(tmp_path))["max_depth"] == 3
    (tmp_path / ".lodestonerc").write_text(json.dumps({"max_depth": 5, "limit": 20}))
    assert config.load_config(str(tmp_path)) == {"max_depth": 5, "limit": 20}
    other = tmp_path / "t"
    other.mkdir()
    (other / "lodestone.toml").write_text("[lodestone]\nmax_depth = 4\nlimit = 15\n")
    assert config.merge_config(config.load_config(str(other)), {"max_depth": None, "limit": 10}) == {"max_depth": 4, "limit": 10}
    (tmp_path / "w.json").write_text(json.dumps({"repos": ["./one", {"path": "./two", "tags": ["x"]}]}))
    assert sorted(r.name for r in config.load_workspace(spark, str(tmp_path / "w.json")).collect()) == ["one", "two"]
    (tmp_path / "e.json").write_text("{}")
    assert config.load_workspace(spark, str(tmp_path / "e.json")) is None


def test_snapshots_hold_the_whole_log(spark, tmp_path):
    """Large ids, ids against the order of time, events at the middle itself."""
    rows = [(9_000, 10, 1), (9_001, 20, 1), (8_000, 90, 1), (9_002, 10, 2), (9_003, 50, 3), (9_004, 51, 4), (9_005, 50, 5), (7_000, 60, 5), (9_006, 90, 6)]
    values = ", ".join(f"({i}L, 1L, timestamp_seconds({t}), 'view', 1.0D, '{{\"k\": {k}}}')" for i, t, k in rows)
    spark.sql(f"SELECT * FROM VALUES {values} AS t(event_id, user_id, ts, event_type, value, props)").write.parquet(f"{tmp_path}/events.parquet")
    got = {r.path: r.change for r in source_queries.t2_snapshot_diff(spark, str(tmp_path)).collect()}
    assert got == {"src/f1.py": "modified", "src/f4.py": "added", "src/f5.py": "modified", "src/f6.py": "added"}


def test_imports_of_go_java_and_rust():
    go = 'package a\nimport (\n\t"fmt"\n\tdb "x/y/store"\n)\nimport "z/util"\n\nfunc Run() {\n\tdb.Open(1)\n\tutil.Go()\n\tother.No()\n}\n'
    assert [r[2] for r in line_sources.rows_of("a.go", go) if r[0] == "call"] == ["x/y/store::Open", "z/util::Go"]
    java = "import org.x.Store;\nimport static org.x.Util.fetch;\nclass A {\n  void run() {\n    Store.open(1);\n    fetch();\n  }\n}\n"
    assert [r[2] for r in line_sources.rows_of("A.java", java) if r[0] == "call"] == ["org.x.Store::open", "org.x.Util.fetch::fetch"]
    rust = "use a::{b, c::{self, D as E}};\npub use x::y::*;\nfn run() {\n    b(1);\n    E::new();\n    c::z();\n}\n"
    assert [r[2] for r in line_sources.rows_of("a.rs", rust) if r[0] == "call"] == ["a::b::b", "a::c::D::new", "a::c::z"]


def test_places_and_both_complexities(spark):
    code = "import time\nasync def f(a):\n    for i in a:\n        for j in i:\n            open(j)\n    time.sleep(1); time.sleep(2)\n    return 1 if a else 2\n"
    rows = python_source.parse(spark.createDataFrame([("m.py", code)], "path string, content string"))
    found = sorted((r.biomarker_type, r.line, r.place) for r in python_source.syntax_findings(rows).where("place <> ''").collect())
    assert found == [("blocking_sync_in_async", 6, "6:19"), ("blocking_sync_in_async", 6, "6:4"), ("io_in_loop", 3, "5:12"), ("io_in_loop", 4, "5:12")]
    assert [(r.ccn, r.ccn_plain) for r in python_source.functions(rows).collect()] == [(4, 3)]


def test_staged_files_texts_and_written_cache(spark, tmp_path):
    staged = spark.createDataFrame([("a.py",), ("b.js",), ("",)], "value string")
    assert [r.path for r in git_text.staged_python(staged).collect()] == ["a.py"]
    for name, body in (("b.md", "two\nlines"), ("a.txt", "one"), ("c.png", "x")):
        (tmp_path / name).write_text(body)
    assert [tuple(r) for r in scan.read_texts(spark, str(tmp_path)).collect()] == [("a.txt", "one"), ("b.md", "two\nlines")]
    files = spark.createDataFrame([("a", "1"), ("b", "2")], "path string, sha256 string")
    for _ in range(2):
        scan.write_cache(files, str(tmp_path / "cache"))
    hits, misses = scan.cache_split(spark.createDataFrame([("a", "1"), ("b", "3")], "path string, sha256 string"), spark.read.parquet(str(tmp_path / "cache")))
    assert [r.path for r in hits.collect()] == ["a"] and [r.path for r in misses.collect()] == ["b"]


def test_texts_that_come_again_are_parsed_once(monkeypatch):
    """b_syntax_findings: a repeated text gives the rows of its own path; a relative import still counts from the file's folder."""
    parsed = []
    plain = python_source.ast.parse
    monkeypatch.setattr(python_source.ast, "parse", lambda text: parsed.append(text) or plain(text))
    text = "from x.y import f\n\n\ndef again_once(a):\n    for i in a:\n        open(i)\n    f()\n    again_once(a)\n"
    first, second = python_source.rows_of("a/p.py", text), python_source.rows_of("b/q.py", text)
    assert len(parsed) == 1 and "a/p.py" in str(first) and "a/p.py" not in str(second)
    assert second == [{k: v.replace("a/p.py", "b/q.py") if isinstance(v, str) else v for k, v in r.items()} for r in first]
    relative = "from .z import g\n\n\ndef again_near():\n    g()\n"
    assert [r["module"] for p in ("a/p.py", "b/q.py", "b/p.py") for r in python_source.rows_of(p, relative) if r["kind"] == "call"] == ["a/z", "b/z", "b/z"]
    assert len(parsed) == 3


def test_only_the_kinds_asked_for(spark):
    """b_syntax_sites: with its kind alone the places are the same."""
    files = spark.createDataFrame([("m.py", "async def again_kinds(a):\n    for x in a:\n        open(x)\n    time.sleep(1)\n"), ("n.py", "def (")], "path string, content string")
    whole, sites = (python_source.parse(files, *k) for k in ((), ("site",)))
    assert {r.kind for r in sites.collect()} == {"site"} and "error" in {r.kind for r in whole.collect()}
    at = lambda rows: sorted(map(tuple, python_source.syntax_findings(rows).where("place <> ''").collect()))
    assert len(at(whole)) == 2 and at(whole) == at(sites)


def test_both_complexities_from_functions_alone(spark):
    """scalar_p25_complexities: no other kind is needed."""
    files = spark.createDataFrame([("m.py", "class C:\n    def f(self, a):\n        return 1 if a and self else f(a)\n")], "path string, content string")
    rows = python_source.parse(files, "function")
    assert [(r["node"], r.ccn, r.ccn_plain) for r in python_source.functions(rows).collect()] == [("m.py::C.f", 3, 2)] and rows.count() == 1


def test_entries_alone(spark):
    """s11_entries: no other kind is needed."""
    text = "def f():\n    pass\n\n\nif __name__ == '__main__':\n    f()\n"
    rows = python_source.parse(spark.createDataFrame([("a/m.py", text), ("b/m.py", text)], "path string, content string"), "entry")
    assert {r["node"] for r in python_source.entry_points(rows).collect()} == {"a/m.py::f", "b/m.py::f"} and rows.count() == 2
