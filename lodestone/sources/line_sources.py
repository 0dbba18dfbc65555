"""JavaScript, TypeScript, Go, Java and Rust sources by lines: a definition opens a function, calls belong to the last one."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

_CALL = re.compile(r"(?<![\w$.])([A-Za-z_$][\w$]*(?:(?:\.|::)[A-Za-z_$][\w$]*)*)\s*\(")


@dataclass(frozen=True)
class Rules:
    extensions: tuple[str, ...]
    define: re.Pattern
    imports: tuple[re.Pattern, ...]
    words: frozenset[str]
    bind: Callable[[str], Iterator[tuple[str, str]]] | None = None


_GO_IMPORT = re.compile(r"^\s*import\s*(?:\(([^)]*)\)|((?:[\w.]+\s+)?\"[^\"\n]+\"))", re.M)
_GO_NAMED = re.compile(r"(?:([\w.]+)[ \t]+)?\"([^\"\n]+)\"")


def _go(text: str) -> Iterator[tuple[str, str]]:
    """Name and path of every import, alone or in a block; a package goes by its alias or the last part of its path."""
    for m in _GO_IMPORT.finditer(text):
        for alias, path in _GO_NAMED.findall(m[1] or m[2]):
            if alias != "_":
                yield (alias if alias and alias != "." else path.rpartition("/")[2]), path


def _java(text: str) -> Iterator[tuple[str, str]]:
    """A class by its own name, a static member by its name."""
    for m in re.finditer(r"^\s*import\s+(?:static\s+)?([\w.]+)\.(\w+)\s*;", text, re.M):
        yield m[2], f"{m[1]}.{m[2]}"


def _rust_tree(prefix: str, tree: str) -> Iterator[tuple[str, str]]:
    """The names that a ``use`` brings in; lists nest."""
    depth, part, parts = 0, "", []
    for c in tree:
        if c == "," and not depth:
            parts.append(part)
            part = ""
            continue
        depth += (c == "{") - (c == "}")
        part += c
    for p in [*parts, part]:
        p = p.strip()
        head, brace, rest = p.partition("{")
        if brace:
            yield from _rust_tree(prefix + head.strip(), rest.rpartition("}")[0])
        elif p and not p.endswith("*"):
            path, _, alias = p.partition(" as ")
            path = prefix.removesuffix("::") if path.strip() == "self" else prefix + path.strip()
            yield (alias.strip() or path.rpartition("::")[2]), path


def _rust(text: str) -> Iterator[tuple[str, str]]:
    for m in re.finditer(r"^\s*(?:pub(?:\([^)]*\))?\s+)?use\s+([^;]+);", text, re.M):
        yield from _rust_tree("", " ".join(m[1].split()))


_WORDS = frozenset("if for while switch return catch function func fn match loop new await typeof super this else do go defer throw sizeof in of case select when".split())
RULES = (
    Rules((".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs"), re.compile(r"^\s*(?:export\s+)?(?:default\s+)?(?:(?:async\s+)?function\s*\*?\s*([\w$]+)|(?:const|let|var)\s+([\w$]+)\s*(?::[^=]+)?=\s*(?:async\s*)?(?:function\b|\([^)]*\)\s*(?::[^=]+)?=>|[\w$]+\s*=>))"), (re.compile(r"import\s+(?:type\s+)?\{?\s*([\w$,\s]+?)\s*\}?\s+from\s+['\"]([^'\"]+)"), re.compile(r"(?:const|let|var)\s+\{?\s*([\w$,\s]+?)\s*\}?\s*=\s*require\(\s*['\"]([^'\"]+)")), _WORDS | {"require", "import"}),
    Rules((".go",), re.compile(r"^func\s+(?:\([^)]*\)\s*)?([A-Za-z_]\w*)"), (), _WORDS | {"len", "make", "append", "cap", "copy", "panic", "recover", "string", "int", "byte"}, _go),
    Rules((".java",), re.compile(r"^\s*(?:(?:public|private|protected|static|final|abstract|synchronized|native)\s+)*[\w<>\[\], .?]+\s+([A-Za-z_]\w*)\s*\([^;]*$"), (), _WORDS, _java),
    Rules((".rs",), re.compile(r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:const\s+|async\s+|unsafe\s+)*fn\s+([A-Za-z_]\w*)"), (), _WORDS | {"Some", "Ok", "Err", "Box", "Vec"}, _rust),
)
BY_EXTENSION = {e: r for r in RULES for e in r.extensions}


def _resolve(path: str, target: str) -> str:
    """A relative import against the folder of its file."""
    if not target.startswith("."):
        return target
    parts = path.split("/")[:-1]
    for step in target.split("/"):
        if step == "..":
            parts = parts[:-1]
        elif step not in (".", ""):
            parts.append(step)
    return "/".join(parts)


def rows_of(path: str, text: str) -> Iterator[tuple[str, str, str, int]]:
    """(kind, node, target, line): functions with their line, calls with their target."""
    rules = BY_EXTENSION.get("." + path.rpartition(".")[2].lower())
    if rules is None:
        return
    bound: dict[str, str] = dict(rules.bind(re.sub(r"//[^\n]*|/\*[\s\S]*?\*/", "", text))) if rules.bind else {}
    defined: list[tuple[str, int]] = []
    calls: list[tuple[str | None, str]] = []
    current = None
    blanked = re.sub(r"/\*[\s\S]*?\*/", lambda m: "\n" * m[0].count("\n"), text)
    for k, line in enumerate(blanked.split("\n"), 1):
        bare = re.sub(r"\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'", lambda m: m[0] if "import" in line or "require" in line else '""', line.split("//")[0])
        for x in rules.imports:
            for m in x.finditer(bare):
                if x.groups > 1:
                    for name in re.findall(r"[\w$]+", m[1]):
                        bound[name] = _resolve(path, m[2])
                else:
                    bound[m[1].split("::")[-1]] = m[1]
        m = rules.define.match(bare)
        if m and (name := next(g for g in m.groups() if g)) not in rules.words:
            current = f"{path}::{name}"
            defined.append((name, k))
            bare = bare[m.end() :]
        for c in _CALL.findall(bare):
            if re.split(r"\.|::", c)[0] not in rules.words:
                calls.append((current, c))
    names = {n for n, _ in defined}
    for n, k in defined:
        yield "function", f"{path}::{n}", "", k
    for caller, c in calls:
        if caller is None:
            continue
        head, *rest = re.split(r"\.|::", c)
        if head in bound:
            yield "call", caller, "::".join([bound[head], rest[-1] if rest else head]), 0
        elif c in names or rest and rest[-1] in names and head in ("self", "Self", "this"):
            yield "call", caller, f"{path}::{rest[-1] if rest else c}", 0


def parse(files: DataFrame) -> DataFrame:
    """(path, kind, node, target, lineno) over files (path, content) of these languages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(p, *r) for p, t in zip(b.column("path").to_pylist(), b.column("content").to_pylist()) if p and t for r in rows_of(p, t)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.string(), pa.string(), pa.int32()))], ["path", "kind", "node", "target", "lineno"])

    return files.select("path", "content").mapInArrow(run, "path string, kind string, node string, target string, lineno int")


def call_edges(rows: DataFrame) -> DataFrame:
    return rows.where("kind = 'call'").selectExpr("node AS src", "target AS dst").distinct()
