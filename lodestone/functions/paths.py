"""Path functions as column expressions: layers, risk tags, names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: folder names that hint at a layer, first hit of a folder wins, deepest folder first
LAYER_HINTS = {
    "CLI": ("cli", "commands", "cmd", "cli_commands"),
    "API": ("routes", "api", "controllers", "endpoints", "handlers", "routers"),
    "Service": ("services", "core", "lib", "domain", "logic", "usecases"),
    "Data": ("models", "db", "data", "persistence", "repository", "repositories", "store", "stores", "entities"),
    "UI": ("components", "views", "pages", "ui", "layouts", "widgets", "screens"),
    "Middleware": ("middleware", "plugins", "interceptors", "guards"),
    "Utility": ("utils", "helpers", "common", "shared", "tools", "util"),
    "Config": ("config", "constants", "env", "settings", "conf"),
    "Types": ("types", "interfaces", "schemas", "contracts", "dtos", "typings"),
}
TEST_FOLDERS = ("__tests__", "test", "tests", "e2e")
EXAMPLE_FOLDERS = ("examples", "_examples", "example", "samples", "sample", "demo", "demos", "bench", "benches", "benchmarks")
DOC_FOLDERS = ("docs", "doc", "website")
TOOL_FOLDERS = ("scripts", "script", "docker", "plugins")
SIDE_LAYER, DEFAULT_LAYER = "Docs & Tooling", "Application"
LAYER_RANK = {"UI": 0, "CLI": 1, "API": 2, "Middleware": 3, "Service": 4, "Application": 5, "Data": 6, "Types": 7, "Config": 8, "Utility": 9, "Docs & Tooling": 10, "Test": 11}
PINNED_LAYERS = ("Test", "Docs & Tooling")

# fixed values: tags of a file's name parts and folders that make a static "unused" doubtful
NAME_TAGS = {
    "config": "config", "configs": "config", "configuration": "config", "conf": "config", "settings": "config", "setting": "config", "setup": "config", "env": "environment",
    "environment": "environment", "environ": "environment", "dotenv": "environment", "bootstrap": "bootstrap", "startup": "bootstrap", "entrypoint": "bootstrap",
    "database": "database", "db": "database", "schema": "database", "seed": "database", "seeds": "database", "migration": "database", "migrations": "database",
    "datastore": "database", "sqlite": "database",
}
FOLDER_TAGS = {
    "config": "config", "configs": "config", "settings": "config", "env": "environment", "environments": "environment", "bootstrap": "bootstrap", "database": "database",
    "db": "database", "migrations": "database", "scripts": "script", "bin": "script", "tasks": "script",
}
TAG_TEXT = {"config": "configuration", "environment": "environment/bootstrap", "bootstrap": "bootstrap/entry-point", "database": "database/schema", "script": "script/task"}


def folders(path: Column) -> Column:
    parts = F.split(F.lower(path), "/")
    return F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))


def stem(path: Column) -> Column:
    name = F.element_at(F.split(F.lower(path), "/"), -1)
    return F.when(name.rlike(r"^.+\.[^.]*$"), F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)


def _table(plain: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in plain.items() for x in kv))


def layer(path: Column) -> Column:
    """Layer of a file: tests by name or folder, a leading dot folder is Config, side folders, then the deepest folder with
    a hint; Application otherwise.  Null stays null."""
    dirs, s = folders(path), stem(path)
    hints = F.filter(F.transform(F.reverse(dirs), lambda x: F.try_element_at(_table({m: g for g, members in LAYER_HINTS.items() for m in members}), x)), lambda x: x.isNotNull())
    is_test = s.rlike("^(test_|spec_)|(_test|_spec|_specs)$") | F.arrays_overlap(dirs, F.array(*(F.lit(x) for x in TEST_FOLDERS)))
    return (
        F.when(path.isNull(), F.lit(None).cast("string"))
        .when(is_test, "Test")
        .when(F.coalesce(F.get(dirs, 0), F.lit("")).startswith("."), "Config")
        .when(F.arrays_overlap(dirs, F.array(*(F.lit(x) for x in (*EXAMPLE_FOLDERS, *DOC_FOLDERS, *TOOL_FOLDERS)))), SIDE_LAYER)
        .otherwise(F.coalesce(F.get(hints, 0), F.lit(DEFAULT_LAYER)))
    )


def simple_layer(path: Column) -> Column:
    """The coarser rule of the service view: exact folder names, Utility otherwise."""
    parts = F.split(F.lower(path), "/")
    has = lambda *names: F.arrays_overlap(parts, F.array(*(F.lit(n) for n in names)))
    return F.when(has("test", "tests"), "Test").when(has("api", "routes", "routers", "controllers"), "API").when(has("models", "db", "persistence"), "Data").when(has("services", "core"), "Service").when(has("components", "views", "pages", "ui"), "UI").when(has("config", "settings"), "Config").otherwise("Utility")


def risk_tags(path: Column) -> Column:
    """Sorted distinct tags of the file's name parts and folders; an empty array for none."""
    name = F.element_at(F.split(F.lower(path), "/"), -1)
    by_name = F.transform(F.split(name, r"[._\-]+"), lambda x: F.try_element_at(_table(NAME_TAGS), x))
    by_folder = F.transform(folders(path), lambda x: F.try_element_at(_table(FOLDER_TAGS), x))
    return F.array_sort(F.array_distinct(F.array_compact(F.concat(by_name, by_folder))))


def risk_text(tags: Column) -> Column:
    texts = F.transform(tags, lambda x: F.coalesce(F.try_element_at(F.create_map(*(F.lit(v) for kv in TAG_TEXT.items() for v in kv)), x), x))
    return F.when(F.size(tags) > 0, F.concat(F.lit("Runtime-load risk: "), F.array_join(texts, ", ")))


def safe_to_delete(confidence: Column, path: Column, stored: Column | None = None, least: float = 0.7) -> Column:
    """Nothing speaks against deleting: what is stored about it (null counts as no), a high confidence, no risk tags."""
    kept = F.lit(True) if stored is None else F.coalesce(stored, F.lit(False))
    return kept & (confidence >= least) & (F.size(risk_tags(path)) == 0)


def module_file(module: Column) -> Column:
    """Dotted module name to the file it would be."""
    return F.concat(F.replace(module, F.lit("."), F.lit("/")), F.lit(".py"))
