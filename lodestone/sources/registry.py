"""Parsers by extension: a parser takes files (path, content) and gives call edges (src, dst)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.sources import line_sources, python_source

Parser = Callable[[DataFrame, DataFrame], DataFrame]
_PARSERS: dict[tuple[str, ...], Parser] = {}


def register(extensions: tuple[str, ...], parser: Parser) -> None:
    _PARSERS[extensions] = parser


register((".py",), lambda files, known: python_source.call_edges(python_source.parse(files), known))
register(tuple(line_sources.BY_EXTENSION), lambda files, known: line_sources.call_edges(line_sources.parse(files)))


def project_edges(files: DataFrame) -> DataFrame:
    """Call edges of a whole project: each language by its parser, repeated edges once."""
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    parts = [p(files.where(ext.isin(*e)), files) for e, p in _PARSERS.items()]
    return reduce(DataFrame.unionByName, parts).distinct()
