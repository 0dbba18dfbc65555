"""Python sources: functions with their metrics, and calls to be resolved by joins.

One pass per file on the executors emits flat rows.  Names are bound inside the file (imports, own functions, methods of the
same class); which file a module name means is decided by a join against the files that exist.
"""

from __future__ import annotations

import ast
import re
import sys
import warnings
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_BRANCH = (ast.If, ast.While, ast.For, ast.AsyncFor, ast.ExceptHandler, ast.Assert, ast.IfExp)
_NEST = (ast.If, ast.For, ast.While, ast.Try, ast.AsyncFor, ast.With, ast.AsyncWith)
_LOOP = (ast.For, ast.While, ast.AsyncFor)
_BARE = frozenset(x for k in (ast.expr_context, ast.boolop, ast.operator, ast.unaryop, ast.cmpop) for x in k.__subclasses__())
_IO = {"open", "read", "write", "readline", "readlines", "writelines", "close"}  # fixed values
_BLOCKING = {"time.sleep", "subprocess.run", "subprocess.call", "os.system", "os.popen", "requests.get", "requests.post"}  # fixed values
#: Texts of up to so many characters are kept with their rows, the last so many of them in a worker.
SHORT, KEPT = 4096, 512
_RELATIVE, _HERE = re.compile(r"\bfrom\b[\s\\\\]*\."), "\0"
SCHEMA = "path string, kind string, node string, class string, name string, module string, symbol string, lineno int, metrics map<string,int>"
_FIELDS = ("path", "kind", "node", "class", "name", "module", "symbol", "lineno", "metrics")


def _dotted(x: ast.AST) -> str | None:
    parts = []
    while isinstance(x, ast.Attribute):
        parts.append(x.attr)
        x = x.value
    if isinstance(x, ast.Name):
        return ".".join([x.id, *reversed(parts)])
    return None


def _walk(root: ast.AST) -> list[ast.AST]:
    """The nodes that ``ast.walk`` gives, in its order, but for contexts and operators."""
    todo = [root]
    for n in todo:
        for v in n.__dict__.values():
            if type(v) is list:
                todo.extend(x for x in v if isinstance(x, ast.AST))
            elif isinstance(v, ast.AST) and v.__class__ not in _BARE:
                todo.append(v)
    return todo


def _parts(n: ast.If) -> int:
    """Parts of a condition."""
    return sum((len(x.values) - 1) if isinstance(x, ast.BoolOp) else isinstance(x, ast.Compare) for x in _walk(n.test))


def measure(fn: ast.AST) -> tuple[dict[str, int], list[tuple[str, int, str]], list[ast.Call]]:
    """(metrics, sites, calls) of a function, in one walk that knows the blocks and loops around each node.

    ccn: 1 plus branches, handlers, asserts, conditional expressions and further operands of boolean operators; ccn_plain, which
    the detectors use, is without conditional expressions.  Sites are (detector, line, place) of what is found at places within
    it: every condition of more than five parts, every input or output call in a loop, once for each loop around it, every
    blocking call of an async function."""
    more = deep = choices = ifs = bare = io = concat = literal = blocking = condition = 0
    stored, args, sites, calls = set(), 0, [], []
    waits = isinstance(fn, ast.AsyncFunctionDef)
    todo: list[tuple[ast.AST, int, tuple[int, ...]]] = [(fn, 0, ())]
    for n, depth, loops in todo:
        kind = n.__class__
        if kind is ast.Name:
            if n.ctx.__class__ is ast.Store:
                stored.add(n.id)
            continue
        if kind is ast.Constant:
            continue
        if kind in _BRANCH:
            more += 1
            choices += kind is ast.IfExp
        if kind is ast.BoolOp:
            more += len(n.values) - 1
        elif kind is ast.If:
            ifs += 1
            parts = _parts(n)
            condition = max(condition, parts)
            if parts > 5:
                sites.append(("complex_conditional", n.lineno, f"{n.lineno}:{n.col_offset}"))
        elif kind is ast.Call:
            calls.append(n)
            if loops and (n.func.id if isinstance(n.func, ast.Name) else n.func.attr if isinstance(n.func, ast.Attribute) else "") in _IO:
                io += len(loops)
                sites.extend(("io_in_loop", line, f"{n.lineno}:{n.col_offset}") for line in loops)
            if waits and (_dotted(n.func) or "") in _BLOCKING:
                blocking += 1
                sites.append(("blocking_sync_in_async", n.lineno, f"{n.lineno}:{n.col_offset}"))
        elif kind is ast.AugAssign:
            concat += len(loops) * isinstance(n.op, ast.Add)
        elif kind is ast.BinOp:
            if loops and isinstance(n.op, ast.Add) and any(isinstance(x, ast.Constant) and isinstance(x.value, str) for x in (n.left, n.right)):
                literal += len(loops)
        elif kind is ast.ExceptHandler:
            bare += n.type is None
        elif kind is ast.arguments:
            args += sum(a.arg not in ("self", "cls", "mcs") for a in (*n.posonlyargs, *n.args, *n.kwonlyargs))
        if kind in _LOOP:
            loops = (*loops, n.lineno)
        for v in n.__dict__.values():
            for x in v if type(v) is list else (v,):
                if isinstance(x, ast.AST) and x.__class__ not in _BARE:
                    below = depth + (x.__class__ in _NEST)
                    deep = max(deep, below)
                    todo.append((x, below, loops))
    metrics = {
        "ccn": 1 + more, "ccn_plain": 1 + more - choices, "depth": deep, "loc": max((fn.end_lineno or fn.lineno) - fn.lineno, 0), "n_vars": len(stored), "n_ifs": ifs, "n_args": args, "bare_excepts": bare,
        "io_in_loop": io, "concat_in_loop": concat, "literal_concat_in_loop": literal, "blocking": blocking, "condition": condition,
    }
    return metrics, sites, calls


def _class_metrics(cls: ast.ClassDef) -> dict[str, int]:
    nodes = _walk(cls)
    attr = lambda ctx: {n.attr for n in nodes if isinstance(n, ast.Attribute) and isinstance(n.ctx, ctx) and isinstance(n.value, ast.Name) and n.value.id == "self"}
    stored, loaded = attr(ast.Store), attr(ast.Load)
    return {"methods": sum(isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)) for n in cls.body), "assigns": sum(isinstance(n, ast.Assign) for n in nodes), "stored": len(stored), "used": len(stored & loaded)}


def _package(path: str, level: int) -> str:
    parts = path.split("/")[:-1]
    return "/".join(parts[: len(parts) - level + 1]) if level > 1 else "/".join(parts)


def rows_of(path: str, text: str) -> list[dict]:
    """Rows of one file: function, class, call, entry or error.  A short text that comes again isn't parsed again; the folder
    counts where it may hold a relative import."""
    folder = path.rpartition("/")[0] if _RELATIVE.search(text) else ""
    rows = (_kept if len(text) <= SHORT else _rows)(text, folder)
    return [r | {"path": path} | {k: path + v[1:] for k in ("node", "module") if (v := r.get(k)) and v[0] == _HERE} for r in rows]


def _rows(text: str, folder: str) -> list[dict]:
    """The rows of a file in a folder; ``_HERE``, which no name holds, stands for its path."""
    path = _HERE
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            tree = ast.parse(text.removeprefix("﻿"))
        except (SyntaxError, ValueError, RecursionError) as e:
            return [{"path": path, "kind": "error", "name": str(e)[:200]}]
    out: list[dict] = []
    bound: dict[str, tuple[str, str | None]] = {}
    own: set[str] = set()
    for n in _walk(tree):
        if isinstance(n, ast.Import):
            for a in n.names:
                bound[a.asname or a.name.split(".")[0]] = (a.name.replace(".", "/"), None)
        elif isinstance(n, ast.ImportFrom):
            base = (n.module or "").replace(".", "/")
            if n.level:
                base = "/".join(x for x in (_package(f"{folder}/" if folder else "", n.level), base) if x)
            for a in n.names:
                if a.name != "*":
                    bound[a.asname or a.name] = (base, a.name)
    for n in tree.body:
        if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
            own.add(n.name)
        elif isinstance(n, ast.ClassDef):
            own |= {f"{n.name}.{m.name}" for m in n.body if isinstance(m, (ast.FunctionDef, ast.AsyncFunctionDef))}

    def call(caller: str, target: ast.AST, cls: str | None) -> None:
        dotted = _dotted(target)
        if dotted is None:
            return
        head, _, rest = dotted.partition(".")
        if head in ("self", "cls") and cls and f"{cls}.{rest}" in own:
            out.append({"path": path, "kind": "call", "node": caller, "module": path, "symbol": f"{cls}.{rest}"})
        elif head in bound:
            module, symbol = bound[head]
            if module.split("/")[0] in sys.stdlib_module_names:
                return
            out.append({"path": path, "kind": "call", "node": caller, "module": module, "symbol": ".".join(x for x in (symbol, rest) if x) or head, "name": symbol})
        elif dotted in own:
            out.append({"path": path, "kind": "call", "node": caller, "module": path, "symbol": dotted})

    def visit(body: list, cls: str | None, caller: str | None) -> None:
        for n in body:
            if isinstance(n, ast.ClassDef):
                out.append({"path": path, "kind": "class", "node": f"{path}::{n.name}", "name": n.name, "lineno": n.lineno, "metrics": _class_metrics(n)})
                visit(n.body, n.name, None)
            elif isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
                node = f"{path}::{cls + '.' if cls else ''}{n.name}"
                metrics, sites, inner = measure(n)
                out.append({"path": path, "kind": "function", "node": node, "class": cls, "name": n.name, "lineno": n.lineno, "metrics": metrics})
                out.extend({"path": path, "kind": "site", "node": node, "name": found, "lineno": line, "symbol": place} for found, line, place in sites)
                for d in n.decorator_list:
                    call(node, d.func if isinstance(d, ast.Call) else d, cls)
                for c in inner:
                    if c not in n.decorator_list:
                        call(node, c.func, cls)
                visit([x for x in n.body if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef))], cls, node)
            elif isinstance(n, ast.If) and "__name__" in ast.dump(n.test) and "__main__" in ast.dump(n.test):
                for c in ast.walk(n):
                    if isinstance(c, ast.Call) and (d := _dotted(c.func)) in own:
                        out.append({"path": path, "kind": "entry", "node": f"{path}::{d}"})

    visit(tree.body, None, None)
    return out


_kept = lru_cache(KEPT)(_rows)


def parse(files: DataFrame, *kinds: str) -> DataFrame:
    """Rows of all Python files of (path, content), or those of some kinds; a file that doesn't parse gives one row of kind error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string()] * 7 + [pa.int32(), pa.map_(pa.string(), pa.int32())]
        for b in batches:
            rows = [r for p, t in zip(b.column("path").to_pylist(), b.column("content").to_pylist()) if p and t is not None for r in rows_of(p, t) if not kinds or r["kind"] in kinds]
            columns = [[r.get(f) for r in rows] for f in _FIELDS]
            columns[-1] = [list(m.items()) if m else None for m in columns[-1]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], list(_FIELDS))

    return files.select("path", "content").mapInArrow(run, SCHEMA)


def call_edges(rows: DataFrame, files: DataFrame) -> DataFrame:
    """(src, dst): calls into files that exist: the module's file, its package, or the module that a symbol names."""
    known = files.select("path").distinct()
    c = rows.where("kind = 'call'").select("node", "module", "symbol", "name")
    first = c.where(F.col("module").endswith(".py")).select("node", F.col("module").alias("file"), "symbol")
    other = c.where(~F.col("module").endswith(".py"))
    inner = F.when(F.col("name").isNotNull() & (F.instr("symbol", ".") > 0), F.regexp_replace("symbol", r"^[^.]*\.", ""))
    options = F.array(F.struct(F.lit(0).alias("rank"), F.concat("module", F.lit(".py")).alias("file"), F.col("symbol").alias("symbol")), F.struct(F.lit(1).alias("rank"), F.concat("module", F.lit("/"), "name", F.lit(".py")).alias("file"), inner.alias("symbol")), F.struct(F.lit(2).alias("rank"), F.concat("module", F.lit("/__init__.py")).alias("file"), F.col("symbol").alias("symbol")))
    tried = other.withColumn("call", F.monotonically_increasing_id()).select("call", "node", F.explode(options).alias("o")).select("call", "node", "o.*").where("file IS NOT NULL AND symbol IS NOT NULL")
    best = tried.join(known, F.col("file") == F.col("path"), "left_semi").groupBy("call", "node").agg(F.min(F.struct("rank", "file", "symbol")).alias("b")).select("node", "b.file", "b.symbol")
    return first.unionByName(best).select(F.col("node").alias("src"), F.concat("file", F.lit("::"), "symbol").alias("dst")).distinct()


def functions(rows: DataFrame) -> DataFrame:
    f = rows.where("kind = 'function'")
    names = ("ccn", "ccn_plain", "depth", "loc", "n_vars", "n_ifs", "n_args", "bare_excepts", "io_in_loop", "concat_in_loop", "literal_concat_in_loop", "blocking", "condition")
    return f.select("node", "path", "class", "name", "lineno", *(F.col("metrics")[n].alias(n) for n in names))


def entry_points(rows: DataFrame) -> DataFrame:
    return rows.where("kind = 'entry'").select("node").distinct()


def syntax_findings(rows: DataFrame) -> DataFrame:
    """(node, biomarker_type, severity, line, place) of the detectors that need a syntax tree, with those on plain metrics; one row
    per place where a detector looks at places, else one per function or class (place is then empty)."""
    from lodestone.operators.biomarkers import FUNCTION_DETECTORS, Detector, detect

    lit = lambda level: lambda: F.lit(level)
    more = [
        Detector("error_handling", lambda: F.col("bare_excepts") > 2, lit("medium")),
        Detector("string_concat_in_loop", lambda: (F.col("concat_in_loop") > 2) | (F.col("literal_concat_in_loop") > 3), lit("low")),
    ]
    by_function = detect(functions(rows), [*FUNCTION_DETECTORS, *more], ["node", "lineno"])
    c = rows.where("kind = 'class'").select("node", "lineno", *(F.col("metrics")[n].alias(n) for n in ("methods", "assigns", "stored", "used")))
    by_class = [
        Detector("god_class", lambda: (F.col("methods") > 15) & (F.col("assigns") > 20), lit("medium")),
        Detector("low_cohesion", lambda: (F.col("stored") > 3) & (F.col("used") / F.col("stored") < 0.3), lit("medium")),
        Detector("large_class", lambda: F.col("methods") > 25, lit("high")),
    ]
    whole = by_function.unionByName(detect(c, by_class, ["node", "lineno"])).withColumnRenamed("lineno", "line").withColumn("place", F.lit(""))
    at = rows.where("kind = 'site'").select("node", F.col("name").alias("biomarker_type"), F.when(F.col("name") == "blocking_sync_in_async", "high").otherwise("medium").alias("severity"), F.col("lineno").alias("line"), F.col("symbol").alias("place"))
    return whole.unionByName(at)
