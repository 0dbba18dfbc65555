"""Embedders by name: a function from a text column to a column of vectors.

``mock`` stands for a model where none is at hand: numbers from the hash of the text, the same on every machine.  A real
one is registered by its owner, as a column expression or a Pandas UDF."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Embedder = Callable[[Column], Column]
_KNOWN: dict[str, Embedder] = {}


def register(name: str, embedder: Embedder) -> None:
    """Adds an embedder; a name is taken once."""
    if name in _KNOWN:
        raise ValueError(f"an embedder named {name} is there already")
    _KNOWN[name] = embedder


def embedder(name: str) -> Embedder:
    if name not in _KNOWN:
        raise KeyError(f"no embedder named {name}; there are: {', '.join(sorted(_KNOWN))}")
    return _KNOWN[name]


def names() -> list[str]:
    return sorted(_KNOWN)


def mock(text: Column, size: int = 16) -> Column:
    """``size`` (at most 32) numbers in [0, 1] from the SHA-256 of the text; null stays null."""
    byte = lambda i: F.conv(F.substring(F.sha2(text, 256), 2 * i + 1, 2), 16, 10).cast("double") / 255
    return F.when(text.isNotNull(), F.array(*(byte(i) for i in range(size))))


register("mock", mock)
