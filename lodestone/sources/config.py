"""Settings files and workspaces: small driver-side inputs."""

from __future__ import annotations

import json
import os
import tomllib
from typing import Any

from pyspark.sql import DataFrame, SparkSession

NAMES = (".lodestonerc", ".lodestonerc.json", "lodestone.json", "lodestone.toml")
DEFAULTS = {"max_depth": 3, "limit": 10}


def load_config(folder: str, section: str = "lodestone") -> dict[str, Any]:
    """The first settings file there is, its section if it has one, over the defaults."""
    for name in NAMES:
        path = os.path.join(folder, name)
        if os.path.exists(path):
            with open(path, "rb") as f:
                raw = tomllib.load(f) if name.endswith(".toml") else json.load(f)
            return DEFAULTS | raw.get(section, raw)
    return dict(DEFAULTS)


def merge_config(config: dict[str, Any], given: dict[str, Any]) -> dict[str, Any]:
    """Given values win where they are set."""
    return config | {k: v for k, v in given.items() if v is not None}


def load_workspace(spark: SparkSession, path: str) -> DataFrame | None:
    """(name, path, tags, default_branch) of a JSON or YAML workspace; entries are texts or mappings; no repositories: None."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith(".json"):
        raw = json.loads(text)
    else:
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError("reading YAML needs the yaml library; use JSON instead") from e
        raw = yaml.safe_load(text) or {}
    repos = raw.get("repos")
    if not repos:
        return None
    rows = [(r.rstrip("/").rpartition("/")[2], r, [], "main") if isinstance(r, str) else (r.get("name") or r["path"].rstrip("/").rpartition("/")[2], r["path"], list(r.get("tags", [])), r.get("default_branch", "main")) for r in repos]
    return spark.createDataFrame(rows, "name string, path string, tags array<string>, default_branch string")
