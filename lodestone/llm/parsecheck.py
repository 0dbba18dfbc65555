"""Source files that don't parse.

Every file is cut into chunks of a few thousand characters.  A chunk becomes its lexer-state map: for each state in which
it may begin, the state in which it ends and a bracket summary, the token classes with every balanced group folded by the
local grammars of the language (see ``syntax.engine``).  Maps of neighbours join associatively, as a tree: first the
chunks that lie in one task, then, for files longer than ``SPAN``, the spans that were read in different tasks.  What the
map of a whole file leaves, a line of balanced statements, is parsed at the end.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.syntax.engine import MARK, ChunkMap
from lodestone.llm.syntax.languages import LEXED, body, language_of
from lodestone.tables import table

#: Characters of a chunk.
CHUNK = 2048
#: Longer files are read by several tasks, so many characters each.
SPAN = 1 << 20
#: Spans that one step of the tree joins.
FAN_IN = 64

# before a line end that is no continuation, where no regular expression can begin; in a long line behind a sign
_LINE_END = re.compile(r"(?<!\\)(?<!\\\r)\n(?!\s*/[^/*])")
_IN_LINE = re.compile(r"(?<=[;,{}()\[\] ])(?=\w)")


def chunks(text: str, size: int) -> list[str]:
    """Pieces of about ``size`` characters.  A piece ends before a line end; in a line four times as long it ends behind a
    bracket, a separator or a blank, and then with MARK."""
    out, at = [], 0
    while len(text) - at > size:
        far, end = at + 4 * size, -1
        for m in _LINE_END.finditer(text, at + size, far + 256):
            if m.start() <= far and _LINE_END.match(text, m.start()):
                end = m.start()
                break
        mark = ""
        if end < 0:
            m = _IN_LINE.search(text, at + size)
            line = _LINE_END.search(text, far, m.start() if m else len(text))
            end, mark = (line.start(), "") if line else (m.start(), MARK) if m else (len(text), "")
        out.append(text[at:end] + mark)
        at = end
    if at < len(text) or not out:
        out.append(text[at:])
    return out


def joined(text: str, lang: str, size: int, first: bool = True) -> tuple[ChunkMap, int]:
    """The map of a text, joined from those of its chunks, and their number."""
    language = LEXED[lang]
    maps = [language.summary(c, first and not k) for k, c in enumerate(chunks(text, size))]
    return language.join_all(maps), len(maps)


def parses(content: str, lang: str, size: int = CHUNK) -> tuple[bool, int]:
    """(whether a whole text is a program, chunks it was joined from)."""
    whole, n = joined(LEXED[lang].start(body(content, lang)), lang, size)
    return LEXED[lang].accepts(*whole.entries[""]), n


_ROW = "lang string, h bigint, k int, ok boolean, chunks bigint, map string, text string"


def _record(b: pa.RecordBatch, at: list[int], rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.string(), pa.string())
    columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
    return pa.RecordBatch.from_arrays([b.column("id").take(pa.array(at, pa.int64())), *columns], ["id", "lang", "h", "k", "ok", "chunks", "map", "text"])


def _first(size: int, span: int):
    """Files of one span are joined and parsed here; longer ones leave their spans as texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, rows = [], []
            for i, (path, content, h) in enumerate(zip(b.column("path").to_pylist(), b.column("content").to_pylist(), b.column("h").to_pylist())):
                lang = language_of(path)
                if lang is None or content is None:
                    continue
                if len(content) <= span:
                    ok, n = parses(content, lang, size)
                    at.append(i), rows.append((lang, h, 0, ok, n, None, None))
                else:
                    for k, text in enumerate(chunks(LEXED[lang].start(body(content, lang)), span)):
                        at.append(i), rows.append((lang, h, k, None, 0, None, text))
            yield _record(b, at, rows)

    return run


def _packed(m: ChunkMap) -> str:
    return json.dumps([m.entries, m.texts])


def _spans(size: int):
    """Each span to its map."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = {k: b.column(k).to_pylist() for k in ("lang", "h", "k", "ok", "chunks", "text")}
            rows = []
            for lang, h, k, ok, n, text in zip(*c.values()):
                packed = None
                if text is not None:
                    m, n = joined(text, lang, size, k == 0)
                    packed = _packed(m)
                rows.append((lang, h, k, ok, n, packed, None))
            yield _record(b, list(range(len(rows))), rows)

    return run


def _step(last: bool):
    """Neighbouring maps of a file joined; in the last step its statements are parsed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = {k: b.column(k).to_pylist() for k in ("lang", "h", "k", "ok", "chunks", "maps")}
            rows = []
            for lang, h, k, ok, n, maps in zip(*c.values()):
                packed = None
                if maps:
                    language = LEXED[lang]
                    whole = language.join_all([ChunkMap({s: tuple(e) for s, e in entries.items()}, texts) for entries, texts in (json.loads(m["map"]) for m in sorted(maps, key=lambda m: m["k"]))])
                    ok, packed = (language.accepts(*whole.entries[""]), None) if last else (None, _packed(whole))
                rows.append((lang, h, k, ok, n, packed, None))
            yield _record(b, list(range(len(rows))), rows)

    return run


def parse_files(df: DataFrame, ident: str, path: str, content: str, chunk: int = CHUNK, span: int = SPAN, fan_in: int = FAN_IN) -> DataFrame:
    """(ident, language, parses, chunks) per file whose extension names a known language and whose content isn't null;
    ``chunks`` is the number of maps that were joined for it.

    An empty file, or one with comments only, is a program except in Go.  Repeated deliveries count once.  A file that
    comes with different contents under one id parses only if all do.
    """
    kind = dict(df.dtypes)[ident]
    row = f"id {kind}, {_ROW}"
    rows = df.select(F.col(ident).alias("id"), F.col(path).alias("path"), F.col(content).alias("content"), F.xxhash64(F.col(path), F.col(content)).alias("h"))
    spread = rows.mapInArrow(_first(chunk, span), row).repartition("id", "h", "k").mapInArrow(_spans(chunk), row)
    part = F.when(F.col("map").isNotNull(), F.struct("k", "map"))
    for last in (False, True):  # two steps take fan_in ** 2 spans, more than a row can hold
        key = F.lit(0) if last else F.floor(F.col("k") / fan_in).cast("int")
        many = spread.groupBy("id", "lang", "h", key.alias("k")).agg(F.min("ok").alias("ok"), F.sum("chunks").alias("chunks") if not last else F.max("chunks").alias("chunks"), F.collect_set(part).alias("maps"))
        spread = many.mapInArrow(_step(last), row)
    return spread.groupBy("id").agg(F.first("lang").alias("language"), F.min("ok").alias("parses"), F.max("chunks").alias("chunks")).select(F.col("id").alias(ident), "language", "parses", "chunks")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return parse_files(table(spark, d, "file_contexts"), "file_id", "file_path", "content").where(~F.col("parses")).select("file_id")


def p1_rates(spark: SparkSession, d: str) -> DataFrame:
    """Per repository and language: files, files that don't parse, and their share."""
    files = table(spark, d, "file_contexts")
    home = files.select("file_id", "repo_id").distinct()
    x = parse_files(files, "file_id", "file_path", "content").join(home, "file_id")
    bad = F.sum((~F.col("parses")).cast("long"))
    return x.groupBy("repo_id", "language").agg(F.count(F.lit(1)).alias("files"), bad.alias("invalid"), (bad / F.count(F.lit(1))).alias("share"))


QUERIES = {"p1_found": p1_found, "p1_rates": p1_rates}
SQL: dict[str, str] = {}
