"""python -m lodestone COMMAND PATH [NAME]: analyze, impact, explain, predict, cycles, dead, complexity, findings, mermaid,
sarif, html, tree, overview, health, duplication."""

from __future__ import annotations

import argparse

from lodestone import exporters
from lodestone.engine import Engine
from lodestone.session import build_session
from lodestone.sources.config import load_config, merge_config


def main(argv: list[str] | None = None) -> int:
    a = argparse.ArgumentParser(description=__doc__)
    a.add_argument("command", choices="analyze impact explain predict cycles dead complexity findings mermaid sarif html tree overview health duplication".split())
    a.add_argument("path")
    a.add_argument("name", nargs="?")
    a.add_argument("--limit", type=int)
    a.add_argument("--max-depth", type=int, dest="max_depth")
    x = a.parse_args(argv)
    c = merge_config(load_config(x.path), {"limit": x.limit, "max_depth": x.max_depth})
    e = Engine(build_session("lodestone"), x.path)
    rows = {"impact": lambda: e.impact(x.name), "predict": lambda: e.impact(x.name), "explain": lambda: e.explain(x.name), "cycles": e.cycles, "dead": e.dead_code, "complexity": lambda: e.complexity(c["limit"]), "findings": e.findings, "analyze": lambda: e.hotspots(c["limit"]), "overview": e.overview, "health": e.health, "duplication": e.duplication}
    if x.command in rows:
        rows[x.command]().show(c["limit"], truncate=False)
    elif x.command == "tree":
        print(exporters.tree(e.edges, x.name, c["max_depth"]))
    elif x.command == "html":
        print(exporters.page(x.path, {"hotspots": e.hotspots(c["limit"]), "complexity": e.complexity(c["limit"])}))
    else:
        print(e.mermaid() if x.command == "mermaid" else e.sarif())
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
