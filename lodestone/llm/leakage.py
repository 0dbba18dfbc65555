"""Held-out passages in a corpus, found by spaced seeds.

A text becomes a row of words (lower case, letters and digits only), each word a 64-bit hash.  A mask marks the word
positions that a seed looks at; the positions between them may differ.  Seeds of the test items and of the corpus meet in a
join on their hash.  A hit fixes how item and document lie side by side; the words around it are then compared one by one
for a stretch of at least 15 words of which nine in ten agree.  Every such stretch of up to 49 words holds a hit of the
masks wherever its differing words stand (tests enumerate the placements), so the join loses no stretch of that length,
and a longer one holds a shorter one or the same runs of equal words.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.session import materialize
from lodestone.tables import table

MASKS = ("111011000111", "111010010111")
LEAST_WORDS = 15
#: Up to so many test items of so many characters together (some ten bytes of seeds a character) every task gets their
#: seeds; beyond, seeds meet in a shuffled join.
BROADCAST_ITEMS, BROADCAST_CHARS = 5_000, 16_000_000
#: Parts over which the documents of one seed spread in that join.
SALTS = 16

_OFFSETS = [np.array([i for i, c in enumerate(m) if c == "1"]) for m in MASKS]
_BLANK_ESCAPE = re.compile(r"\\+[nrtfv]")
_CODE_ESCAPE = re.compile(r"\\+u([0-9a-fA-F]{4})|\\+x([0-9a-fA-F]{2})")
_BLOCK_TAG = re.compile(r"</?(?:br|p|li|ul|ol|div|tr|td|th|h[1-6]|blockquote|pre)\b[^<>]{0,200}>", re.I)
_TAG = re.compile(r"</?[A-Za-z][^<>\n]{0,200}>|<!--|-->")
_NUMBERED = re.compile(r"(?m)^[ \t]*[\[(]?\d{1,7}(?:[.:)\]|]+[ \t]+|[ \t]*\|[ \t]*|\t)")
_PLAIN = re.compile(r"[\W_]+")


def plain(text: str) -> str:
    """The text without markup, references and escapes; line structure kept."""
    if "&" in text:
        text = html.unescape(html.unescape(text))
    if "\\" in text:
        text = _CODE_ESCAPE.sub(lambda m: chr(int(m[1] or m[2], 16)), _BLANK_ESCAPE.sub(" ", text))
    if "<" in text:
        text = _TAG.sub("", _BLOCK_TAG.sub(" ", text))
    return text


class Words:
    """Word hashes, remembered per task: a text's words repeat all the time."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def __call__(self, text: str) -> np.ndarray:
        known, out = self.known, []
        if len(known) > 500_000:
            known.clear()
        for w in text.split():
            h = known.get(w)
            if h is None:
                core = _PLAIN.sub("", w.casefold())
                h = known[w] = (xxhash.xxh64_intdigest(core.encode()) | 1) if core else 0
            if h:
                out.append(h)
        return np.array(out, dtype=np.uint64)


def versions(text: str, words: Words) -> list[np.ndarray]:
    """The text's words, and, where lines carry numbers in front, its words without these numbers."""
    clean = plain(text)
    out = [words(clean)]
    if len(_NUMBERED.findall(clean)) > 1:
        out.append(words(_NUMBERED.sub("", clean)))
    return out


def seeds(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, position) of every mask at every place."""
    hashes, places = [], []
    for k, offsets in enumerate(_OFFSETS):
        n = len(words) - int(offsets[-1])
        if n > 0:
            h = np.full(n, 0x9E3779B97F4A7C15 + k, dtype=np.uint64)
            for o in offsets:
                h = (h ^ words[o : o + n]) * np.uint64(0xD6E8FEB86659FD93)
                h ^= h >> np.uint64(32)
            hashes.append(h)
            places.append(np.arange(n))
    return (np.concatenate(hashes), np.concatenate(places)) if hashes else (np.empty(0, np.uint64), np.empty(0, np.int64))


def overlap(item: np.ndarray, doc: np.ndarray, shift: int) -> int:
    """The longest stretch, item word i against document word i + shift, of at least LEAST_WORDS words of which nine in
    ten agree; 0 when there is none."""
    low, high = max(0, -shift), min(len(item), len(doc) - shift)
    if high - low < LEAST_WORDS:
        return 0
    gain = np.where(item[low:high] == doc[low + shift : high + shift], 1, -9)
    total = np.concatenate([[0], np.cumsum(gain)])
    # longest j - i with total[j] >= total[i]: nine in ten agree exactly when the sum of (1, -9) is not negative
    best = 0
    first = np.minimum.accumulate(total)
    for j in range(len(total) - 1, LEAST_WORDS - 1, -1):
        if j <= best:
            break
        i = int(np.argmax(first <= total[j])) if first[j] <= total[j] else j
        best = max(best, j - i)
    return best if best >= LEAST_WORDS else 0


class Index:
    """The seeds of some items, sorted by hash."""

    def __init__(self, items: list[np.ndarray]) -> None:
        self.items = items
        found = [seeds(w) for w in items]
        h = np.concatenate([x[0] for x in found] or [np.empty(0, np.uint64)])
        place = np.concatenate([x[1] for x in found] or [np.empty(0, np.int64)])
        owner = np.repeat(np.arange(len(items)), [len(x[0]) for x in found])
        order = np.lexsort((owner, h))
        h, self.owner, self.place = h[order], owner[order], place[order]
        self.keys, starts = np.unique(h, return_index=True)
        self.starts = np.append(starts, len(h))

    def shifts(self, words: np.ndarray) -> dict[int, np.ndarray]:
        """Item to the shifts at which it and the text share a seed.  Places of one seed are compared as two sets: directly
        while they are few, else by the product of their transforms, so that a seed that is everywhere in both costs no
        more than their lengths."""
        h, at = seeds(words)
        if not len(h) or not len(self.keys):
            return {}
        i = np.searchsorted(self.keys, h)
        i[i == len(self.keys)] = 0
        same = np.flatnonzero(self.keys[i] == h)
        if not len(same):
            return {}
        key = i[same]
        order = np.argsort(key, kind="stable")
        key, at = key[order], at[same][order]
        ends = np.append(np.flatnonzero(np.diff(key)) + 1, len(key))
        found: dict[int, list[np.ndarray]] = {}
        start = 0
        for end in ends.tolist():
            here = at[start:end]
            low, high = self.starts[key[start]], self.starts[key[start] + 1]
            owner, place = self.owner[low:high], self.place[low:high]
            start = end
            cuts = np.append(np.flatnonzero(np.diff(owner)) + 1, len(owner)).tolist()
            a = 0
            for b in cuts:
                found.setdefault(int(owner[a]), []).append(_differences(here, place[a:b]))
                a = b
        return {item: np.unique(np.concatenate(x)) if len(x) > 1 else x[0] for item, x in found.items()}

    def leaks(self, words: np.ndarray) -> dict[int, int]:
        """Item to the longest stretch of it in the text.  Shifts with the longest possible stretch come first, and those that
        can't be longer than what is known are left."""
        out = {}
        for item, shifts in self.shifts(words).items():
            w = self.items[item]
            room = np.minimum(len(w), len(words) - shifts) - np.maximum(0, -shifts)
            best = 0
            for k in np.argsort(-room, kind="stable"):
                if room[k] <= best:
                    break
                best = max(best, overlap(w, words, int(shifts[k])))
            if best:
                out[item] = best
        return out


def _differences(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All values of x - y, x of ``a`` and y of ``b``, once each."""
    if len(a) * len(b) <= 1 << 16:
        return np.unique(np.subtract.outer(a, b))
    low = int(a.min()) - int(b.max())
    x, y = np.zeros(int(np.ptp(a)) + 1), np.zeros(int(np.ptp(b)) + 1)
    x[a - a.min()] = 1
    y[b.max() - b] = 1
    n = len(x) + len(y) - 1
    both = np.fft.irfft(np.fft.rfft(x, n) * np.fft.rfft(y, n), n)
    return np.flatnonzero(both > 0.5) + low


def _longest(index: Index, text: str, words: Words) -> dict[int, int]:
    """Item to its longest stretch in any version of the text."""
    best: dict[int, int] = {}
    for w in versions(text, words):
        for item, n in index.leaks(w).items():
            best[item] = max(n, best.get(item, 0))
    return best


def _near(docs: DataFrame, items: list[tuple], kinds: tuple[str, str]) -> DataFrame:
    """Map-side join: every task has the sorted seeds of the (bounded) items."""
    words = Words()
    shared = docs.sparkSession.sparkContext.broadcast((Index([versions(t, words)[0] for _, t in items]), [i for i, _ in items]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, names = shared.value
        words = Words()
        for b in batches:
            at, found, length = [], [], []
            for d, text in enumerate(b.column("text").to_pylist()):
                best = _longest(index, text, words)
                at += [d] * len(best)
                found += [names[k] for k in best]
                length += best.values()
            if at:
                yield pa.RecordBatch.from_arrays([b.column("doc").take(pa.array(at)), pa.array(found, item_type), pa.array(length, pa.int32())], ["doc", "item", "words"])

    item_type = pa.int64() if kinds[1] == "bigint" else pa.string()
    return docs.mapInArrow(run, f"doc {kinds[0]}, item {kinds[1]}, words int")


def _seed_rows(df: DataFrame, ident: str, kind: str, all_versions: bool) -> DataFrame:
    """(h, ident): each seed of a text once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for b in batches:
            for i, text in enumerate(b.column("text").to_pylist()):
                found = [seeds(w)[0] for w in (versions(text, words) if all_versions else versions(text, words)[:1])]
                h = np.unique(np.concatenate(found))
                for s in range(0, len(h), 20_000):
                    part = h[s : s + 20_000].view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(part), b.column(ident).take(pa.array([i] * len(part)))], ["h", ident])

    return df.mapInArrow(run, f"h bigint, {ident} {kind}")


def _far(docs: DataFrame, items: DataFrame, kinds: tuple[str, str]) -> DataFrame:
    """Shuffled join of the seeds for test sets of any size: each seed of a text once, the documents of a seed spread over
    ``SALTS`` parts that all have its items.  A document then meets its candidate items as one row and its text moves
    once; what they share is found as in ``_near``."""
    salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    a = _seed_rows(items, "item", kinds[1], False).select("h", "item", salt)
    b = _seed_rows(docs, "doc", kinds[0], True).select("h", "doc", F.pmod(F.xxhash64("doc"), F.lit(SALTS)).cast("int").alias("salt"))
    pairs = materialize(a.join(b, ["h", "salt"]).select("doc", "item").distinct(), "seeds")
    some = pairs.join(items.withColumnRenamed("text", "item_text").distinct(), "item").groupBy("doc").agg(F.collect_list(F.struct("item", "item_text")).alias("items"))
    full = some.join(docs.distinct(), "doc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for b in batches:
            at, found, length = [], [], []
            for d, (text, near) in enumerate(zip(b.column("text").to_pylist(), b.column("items").to_pylist())):
                best = _longest(Index([versions(x["item_text"], words)[0] for x in near]), text, words)
                at += [d] * len(best)
                found += [near[k]["item"] for k in best]
                length += best.values()
            if at:
                yield pa.RecordBatch.from_arrays([b.column("doc").take(pa.array(at)), pa.array(found, item_type), pa.array(length, pa.int32())], ["doc", "item", "words"])

    item_type = pa.int64() if kinds[1] == "bigint" else pa.string()
    return full.mapInArrow(run, f"doc {kinds[0]}, item {kinds[1]}, words int")


def leaks(docs: DataFrame, items: DataFrame, doc: str = "doc_id", item: str = "item_id", text: str = "text", broadcast_items: int = BROADCAST_ITEMS, broadcast_chars: int = BROADCAST_CHARS) -> DataFrame:
    """(doc, item, words): documents that hold a stretch of an item, with the longest stretch in words.

    Null, empty and shorter texts hold nothing; repeated ids count once; ids are bigint or string.  An empty table on
    either side gives an empty result.
    """
    d = docs.where(F.length(text) > 0).select(F.col(doc).alias("doc"), F.col(text).alias("text"))
    i = items.where(F.length(text) > 0).select(F.col(item).alias("item"), F.col(text).alias("text"))
    kinds = (dict(d.dtypes)["doc"], dict(i.dtypes)["item"])
    size = i.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars")).first()
    few = size["n"] <= broadcast_items and (size["chars"] or 0) <= broadcast_chars
    found = _near(d, [tuple(r) for r in i.collect()], kinds) if few else _far(d, i, kinds)
    return found.groupBy("doc", "item").agg(F.max("words").alias("words")).select(F.col("doc").alias(doc), F.col("item").alias(item), "words")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


def p6_leaked_items(spark: SparkSession, d: str) -> DataFrame:
    """Per suite: its items, how many of them leaked, and into how many documents."""
    items = table(spark, d, "eval_items").select("item_id", "suite")
    found = leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))
    j = items.join(found, "item_id", "left")
    return j.groupBy("suite").agg(F.countDistinct("item_id").alias("items"), F.countDistinct(F.when(F.col("doc_id").isNotNull(), F.col("item_id"))).alias("leaked"), F.countDistinct("doc_id").alias("documents"))


QUERIES = {"p6_found": p6_found, "p6_leaked_items": p6_leaked_items}
SQL: dict[str, str] = {}
