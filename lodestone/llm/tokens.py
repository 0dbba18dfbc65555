"""Token counts with a public vocabulary, in Arrow batches."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# fixed value: the pre-tokenisation pattern that belongs to this vocabulary
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def encoder(vocabulary: str):
    import tiktoken

    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def with_tokens(df: DataFrame, text: str, keep: list[str], vocabulary: str = VOCABULARY) -> DataFrame:
    """``keep`` and ``n_tokens`` of the whole text; a null or empty text has 0 tokens.  The vocabulary file goes to the executors
    with the job."""
    df.sparkSession.sparkContext.addFile(vocabulary)
    kept = df.select(*keep, F.col(text).alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name != "__text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = SparkFiles.get(os.path.basename(vocabulary))
        encode = encoder(sent if os.path.exists(sent) else vocabulary).encode_ordinary
        for b in batches:
            at = b.schema.get_field_index("__text")
            counts = [len(encode(t)) if t else 0 for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([c for i, c in enumerate(b.columns) if i != at] + [pa.array(counts, pa.int32())], [n for n in b.schema.names if n != "__text"] + ["n_tokens"])

    return kept.mapInArrow(run, f"{schema}, n_tokens int")
