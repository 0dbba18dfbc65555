"""Reports as files: diagrams, SARIF, a page.  Rows are made by queries; only what a report shows comes to the driver."""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SHOWN = 5_000


def mermaid(edges: DataFrame, changed: DataFrame | None = None, shown: int = SHOWN) -> str:
    """A diagram of the first ``shown`` edges by name; changed nodes are marked."""
    safe = lambda x: x.translate(str.maketrans("()-", "___"))
    rows = edges.orderBy("src", "dst").limit(shown).collect()
    out = ["graph TD", *(f"    {safe(r.src)} --> {safe(r.dst)}" for r in rows)]
    if changed is not None:
        out += [f"    style {safe(r.node)} fill:#f96" for r in changed.orderBy("node").limit(shown).collect()]
    return "\n".join(out) + "\n"


def sarif(results: DataFrame, version: str, shown: int = SHOWN) -> str:
    """A SARIF 2.1.0 document of (node, level, text, line) rows."""
    rows = results.orderBy("node").limit(shown).collect()
    found = [{"ruleId": "change-impact", "level": r.level, "message": {"text": r.text}, "locations": [{"physicalLocation": {"artifactLocation": {"uri": r.node.split("::")[0]}, "region": {"startLine": r.line or 1}}}]} for r in rows]
    return json.dumps({"version": "2.1.0", "$schema": "https://json.schemastore.org/sarif-2.1.0.json", "runs": [{"tool": {"driver": {"name": "lodestone", "version": version, "rules": [{"id": "change-impact"}]}}, "results": found}]}, indent=2)


def page(title: str, tables: dict[str, DataFrame], shown: int = 200) -> str:
    """A plain page with one table per query."""
    parts = [f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>"]
    for name, df in tables.items():
        rows = df.limit(shown).collect()
        head = "".join(f"<th>{html.escape(c)}</th>" for c in df.columns)
        body = "".join("<tr>" + "".join(f"<td>{html.escape(str(v))}</td>" for v in r) + "</tr>" for r in rows)
        parts.append(f"<h2>{html.escape(name)}</h2><table><tr>{head}</tr>{body}</table>")
    return "\n".join(parts)


def dot(edges: DataFrame, shown: int = SHOWN) -> str:
    rows = edges.orderBy("src", "dst").limit(shown).collect()
    return "digraph calls {\n" + "".join(f"  {json.dumps(r.src)} -> {json.dumps(r.dst)};\n" for r in rows) + "}\n"


def tree(edges: DataFrame, root: str, max_depth: int = 4, max_children: int = 12) -> str:
    """Callees below a function as an indented tree; what was shown before is marked and not opened again.  Each level asks
    for the children of the nodes it shows and cuts them to ``max_children`` in the plan, so the driver holds the shown part
    only."""
    lines, seen = [], set()
    children: dict[str, list[str]] = {}
    level = [root]
    for _ in range(max_depth):
        shown = edges.select("src", "dst").where(F.col("src").isin(*level)).distinct().withColumn("k", F.row_number().over(Window.partitionBy("src").orderBy("dst"))).where(F.col("k") <= max_children)
        for r in shown.orderBy("src", "dst").collect() if level else []:
            children.setdefault(r.src, []).append(r.dst)
        level = [c for n in level for c in children.get(n, []) if c not in children][:500]

    def draw(node: str, depth: int) -> None:
        again = node in seen
        lines.append("  " * depth + node + (" (seen)" if again else ""))
        if again or depth >= max_depth:
            return
        seen.add(node)
        for c in children.get(node, []):
            draw(c, depth + 1)

    draw(root, 0)
    return "\n".join(lines) + "\n"
