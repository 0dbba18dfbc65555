"""Source files that nobody wrote by hand for their repository: generated, minified, vendored, or data saved as code.

Names are the main evidence.  A character trigram model per language, trained on the identifiers of all files, gives every
file a cross-entropy: mangled names stand far above it.  Many names of few shapes, equal but for a number, show the templates
of a generator.  Naming styles (share of each way to join words) far from those of the language and of the file's own
repository are foreign, wherever the file lies.  What names cannot show is read from the file itself: a first or last comment
that says a tool wrote it, the folder or suffix that a tool or a package manager uses, lines shared with a known library file,
and a content that is one literal.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.syntax.languages import language_of
from lodestone.session import materialize
from lodestone.tables import table

#: Bits per character above the language's mean at which a file's names count as mangled.
MANGLED_BITS = 0.3
#: So many different names of one or two characters are mangled in whatever layout; fewer only in long lines.
MANGLED_SHORT = 30
#: Share of a file's defined names that differ only in a number, from which they count as a template; the names of several
#: templates count together when they have so many names each in the mean.
TEMPLATE_SHARE = 0.4
TEMPLATE_LEAST = 3
TEMPLATE_MEAN = 6
#: A file that joins the words of so many names is foreign when it does so in ways that far from its language's and from the
#: rest of its repository (sum of the differences of the shares, at most 2).
STYLE_NAMES, STYLE_DISTANCE = 15, 1.2
#: Bits above the mean of its language's plain words up to which a file's are that language's and not another format's.
FIT_BITS = 1.0
#: Share of a library file's word shingles (or of the file's own) that makes a copy; shingles are five words.
COPY_SHARE = 0.6
COPY_OWN_SHARE = 0.8
SHINGLE = 5
#: A literal with so many elements, or one of so many characters without a blank, is large.
LITERAL_ELEMENTS = 60
LITERAL_CHARS = 300
LITERAL_WORDS = 12
#: Library files are reference material: up to so many files of so many characters together go to every task; beyond, their
#: lines meet the files' lines in a shuffled join.
BROADCAST_LIBRARY_FILES, BROADCAST_LIBRARY_CHARS = 20_000, 64_000_000
#: Parts over which the files of one line spread in that join.
SALTS = 16
#: A copy shares at least so many long lines with its original, and this share of those that the smaller of the two has.
COPY_LINES, COPY_LINE_SHARE = 3, 0.4

# fixed values: folders that hold foreign code; the weak ones only when they hold a folder per library
FOREIGN = {"node_modules", "bower_components", "jspm_packages", "vendor", "_vendor", "vendored", "third_party", "third-party", "thirdparty", "3rdparty", "ext_libs", "site-packages", "pods"}
FOREIGN_WEAK = {"deps", "external", "externals", "vendors", "contrib"}
# fixed values: folders that tools write into; a folder of scripts above them makes them hand-written
WRITTEN = {"dist", "build", "out", "target", "compiled", "generated", "gen", "__generated__", "autogen", "_generated", "generated-sources", "codegen_out"}
SCRIPTS = {"scripts", "script", "tools", "tool", "ci", "tests", "test", "cmd"}
WRITTEN_NAME = re.compile(r"(?:\.(?:pb|g|gen|generated|min|bundle|chunk|designer)|_pb2?(?:_grpc)?|_grpc|_gen|_generated|[a-z0-9](?:Grpc|OuterClass|Generated)|_string(?=\.go))\.[A-Za-z]+$")
# fixed values: how a comment begins in which a tool names itself as the writer of the file
BANNER = re.compile(
    r"(?:warning[:!]?\s*)?(?:<auto-?generated\b|-\*-\s*(?:codegen|generated|auto)|@generated\b|generated[_-]by\b|auto-?generated\b|automatically generated\b|machine[ -](?:generated|made)\b|code generated\b|codegen output\b|generated (?:from|by|using|with|automatically|code|file)\b"
    r"|this (?:file|source|code|module|class|script|package) (?:was|is|has been) (?:auto(?:matically)?[ -]?)?(?:generated|emitted|produced|created|written|built|compiled)\b|(?:created|produced|emitted|written|compiled|transpiled|bundled) by (?!hand\b)[^.;]*(?:writer|generator|compiler|builder|tool|gen\b|kit\b|\d)"
    r"|built from (?:the )?template\b|output of \S+|do not (?:edit|modify)[!.,:;]?\s*[-(]?\s*(?:auto|generated|produced|emitted|created|written|this file)|(?:fichier|code) généré|archivo generado|código (?:generado|gerado)|arquivo gerado|automatisch (?:erzeugt|generiert)|(?:diese )?datei (?:wurde|wird) automatisch|file generato|файл (?:создан|сгенерирован)|сгенерирован)",
    re.I,
)
_COMPILED = re.compile(r"Object\.defineProperty\(exports, ?[\"']__esModule[\"']|^var __(?:assign|awaiter|extends|createBinding|importDefault|decorate) = \(this && this\.__", re.M)
_MAP = re.compile(r"^//[#@] sourceMappingURL=\S+\s*\Z", re.M)

_TEXT_OR_COMMENT = re.compile(r"//[^\n]*|/\*[\s\S]*?\*/|(?:^|(?<=[ \t\n]))#(?![!\[])[^\n]*|r?#?\"\"\"[\s\S]*?(?:\"\"\"|\Z)|'''[\s\S]*?(?:'''|\Z)|\"(?:[^\"\\\n]|\\.)*(?:\"|$)|'(?:[^'\\\n]|\\.)*'|`[^`]*(?:`|\Z)", re.M)
_NAME = re.compile(r"[A-Za-z_$][\w$]*")
_NAME_OR_MEMBER = re.compile(r"\.?[A-Za-z_$][\w$]*")
_NUMBER = re.compile(r"(?<![\w$.])(?:0[xX][0-9a-fA-F]+|\d[\w.]*)")
_DEFINED = re.compile(r"(?:\b(?:def|func|function|fn|class|const|var|let|static|struct|type|interface|int|long|double|boolean|String|void)\s+(?:\([^)\n]*\)\s*)?|^\s*(?=\w+\s+(?:u?int\d*|string|bool)\b)|^\s*(?:public|private|protected)[\w<>\[\], ]*\s)([A-Za-z_$][\w$]*\d[\w$]*|[A-Za-z_$][\w$]*)", re.M)
_HEAD = re.compile(r"(?:\s+|﻿|#!(?!\[)[^\n]*|//[^\n]*|#(?!\[)[^\n]*|/\*[\s\S]*?\*/|r?\"\"\"[\s\S]*?\"\"\"|package [\w.]+;?|[\"']use strict[\"'];?)*+")
_COMMENT = re.compile(r"//([^\n]*)|#([^\n]*)|/\*([\s\S]*?)\*/|\"\"\"([\s\S]*?)\"\"\"")
_WORDS = re.compile(r"\w+")

# the model's alphabet: a name's characters, its two ends, and one class for all other letters
_CODE = np.full(128, 57, dtype=np.int64)
for _i, _c in enumerate("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"):
    _CODE[ord(_c)] = _i + 1
for _c in "0123456789":
    _CODE[ord(_c)] = 53
_CODE[ord("_")], _CODE[ord("$")], _CODE[ord(" ")] = 54, 55, 0
SIZE = 58


def code_part(text: str) -> tuple[str, int, int, int]:
    """(text without strings and comments, number of strings, their characters, longest string without a blank)."""
    n, total, longest = 0, 0, 0

    def drop(m: re.Match) -> str:
        nonlocal n, total, longest
        t = m[0]
        if t[0] in "\"'`r":
            n += 1
            total += len(t)
            if len(t) > longest and not any(c in t for c in " \n\t"):
                longest = len(t)
        return " "

    return _TEXT_OR_COMMENT.sub(drop, text), n, total, longest


def trigrams(names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(trigram codes of all names, first index of each name's trigrams); a name begins and ends with a blank."""
    raw = np.frombuffer(("  " + "  ".join(names) + " ").encode("ascii", "replace"), dtype=np.uint8)
    c = _CODE[np.minimum(raw, 127)]
    tri = (c[:-2] * SIZE + c[1:-1]) * SIZE + c[2:]
    length = np.fromiter((len(x) + 1 for x in names), dtype=np.int64, count=len(names))
    # each name gives its length + 1 trigrams and one more that runs over into the next name
    first = np.concatenate([[0], np.cumsum(length + 1)[:-1]])
    return tri, first


STYLES = ("snake", "camel")


def style_of(name: str) -> str | None:
    """The way in which a name joins its words.  One word goes with every style; capitals at the beginning tell types and
    constants, which are written alike everywhere."""
    x = name.strip("_$")
    if not x[:1].islower() or x.islower() and "_" not in x:
        return None
    return "snake" if "_" in x else "camel"


def style_counts(names: Iterable[str]) -> np.ndarray:
    """How many names join their words in which way."""
    c = Counter(map(style_of, names))
    return np.array([c[k] for k in STYLES], dtype=np.int64)


def style_distance(a: np.ndarray, b: np.ndarray) -> float:
    """Sum of the differences of the shares, 0 when either side has no names."""
    return float(np.abs(a / a.sum() - b / b.sum()).sum()) if a.any() and b.any() else 0.0


#: Marks the model of a language's plain words, keywords among them.
PLAIN = " plain"
# fixed values: languages with the same words, of which neither tells the other's text apart
KIN = {"javascript": "typescript", "typescript": "javascript"}


def plain_words(names: list[str]) -> list[str]:
    return [n for n in names if len(n) > 2 and n.islower() and "_" not in n]


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per language the trigram and style counts of this task, each distinct name of a file once."""
    total: dict[str, np.ndarray] = {}
    for b in batches:
        names: dict[str, list[str]] = defaultdict(list)
        styles: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(STYLES), dtype=np.int64))
        for lang, found, style in zip(*(b.column(c).to_pylist() for c in ("lang", "names", "style"))):
            own = found.split(" ")
            names[lang] += own
            names[lang + PLAIN] += plain_words(own)
            styles[lang] += style
        for lang, found in names.items():
            if not found:
                continue
            tri, first = trigrams(found)
            keep = np.ones(len(tri), dtype=bool)
            keep[first[1:] - 1] = False
            counts = np.append(np.bincount(tri[keep], minlength=SIZE**3), styles[lang])
            total[lang] = total[lang] + counts if lang in total else counts
    for lang, counts in total.items():
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at, pa.int32()), pa.array(counts[at], pa.int64())], ["lang", "tri", "n"])


class Model:
    """log2 P(character | two before it) of a language, with add-0.1 smoothing; and the mean bits of its own corpus."""

    def __init__(self, tri: np.ndarray, n: np.ndarray) -> None:
        counts = np.zeros(SIZE**3 + len(STYLES))
        counts[tri] = n
        self.style = counts[SIZE**3 :]
        table_ = counts[: SIZE**3].reshape(SIZE * SIZE, SIZE)
        context = table_.sum(axis=1, keepdims=True)
        bits = -np.log2((table_ + 0.1) / (context + 0.1 * SIZE))
        self.mean = float((bits * table_).sum() / max(table_.sum(), 1))
        self.bits = bits.astype(np.float32).reshape(-1)

    def score(self, names: list[str]) -> float:
        """Mean bits per character over the names."""
        tri, first = trigrams(names)
        keep = np.ones(len(tri), dtype=bool)
        keep[first[1:] - 1] = False
        return float(self.bits[tri[keep]].mean())


def train(seen: DataFrame) -> dict[str, Model]:
    """The models of all languages, and of their plain words, from the files' (lang, names, style).  What comes to the driver is
    bounded by the alphabet: at most SIZE**3 counts each, and two of styles."""
    counts = seen.where(F.length("names") > 0).select("lang", "names", "style").mapInArrow(_train, "lang string, tri int, n bigint").groupBy("lang", "tri").agg(F.sum("n").alias("n")).toPandas()
    return {lang: Model(g["tri"].to_numpy(), g["n"].to_numpy()) for lang, g in counts.groupby("lang")}


def template_share(code: str, names: list[str]) -> float:
    """Share of the defined names that are equal but for a number: those of the largest template, or of all when they are
    many names of few templates."""
    if sum(x[-1].isdigit() or any(c.isdigit() for c in x) for x in names) < TEMPLATE_LEAST:
        return 0.0
    found = _DEFINED.findall(code)
    if len(found) < TEMPLATE_LEAST:
        return 0.0
    distinct = set(found)
    shapes = Counter(re.sub(r"\d+", "#", x) for x in distinct if any(c.isdigit() for c in x))
    if not shapes:
        return 0.0
    sizes = [n for n in shapes.values() if n >= TEMPLATE_LEAST]
    if not sizes:
        return 0.0
    return (sum(sizes) if sum(sizes) >= TEMPLATE_MEAN * len(sizes) else max(sizes)) / len(distinct)


def says_generated(text: str) -> bool:
    """Whether the first comments, or the last lines, say that a tool wrote the file."""
    head = _HEAD.match(text)[0]
    for m in _COMMENT.finditer(head):
        for line in (m[1] or m[2] or m[3] or m[4] or "").split("\n"):
            if BANNER.match(line.strip(" \t\r*!#/;-") if not line.lstrip(" *#/!").startswith("-*-") else line.lstrip(" *#/!")):
                return True
    for line in text.rstrip()[-400:].split("\n")[-2:]:
        if (m := re.match(r"(?://|#|/\*)[ \t*!]*(.*)", line)) and BANNER.match(m[1]):
            return True
    return False


def folder_says(path: str) -> str | None:
    parts = [p.lower() for p in path.split("/")]
    folders = parts[1:-1]
    for i, p in enumerate(folders):
        if p in FOREIGN or p in FOREIGN_WEAK and i + 1 < len(folders):
            return "vendored"
    for i, p in enumerate(folders):
        if p in WRITTEN and not (i and folders[i - 1] in SCRIPTS):
            return "generated"
    return "generated" if WRITTEN_NAME.search(path.rpartition("/")[2]) else None


def shingles(text: str) -> set[int]:
    w = _WORDS.findall(text)
    return {hash(tuple(w[i : i + SHINGLE])) for i in range(len(w) - SHINGLE + 1)}


def long_lines(text: str) -> set[str]:
    return {s for line in text.split("\n") if len(s := line.strip()) >= 16}


class Library:
    """Known library files: an index of their lines to find candidates, their shingles to decide."""

    def __init__(self, files: list[str]) -> None:
        self.shingles = [shingles(t) for t in files]
        self.lines: dict[str, list[int]] = defaultdict(list)
        self.sizes = []
        for i, t in enumerate(files):
            own = long_lines(t)
            self.sizes.append(len(own))
            for line in own:
                self.lines[line].append(i)

    def holds(self, text: str) -> bool:
        own = long_lines(text)
        hits: Counter = Counter()
        s: set[int] = set()
        for line in own & self.lines.keys():
            hits.update(self.lines[line])
        for i, n in hits.items():
            if n < COPY_LINES or n < COPY_LINE_SHARE * min(len(own), self.sizes[i]):
                continue
            s = s or shingles(text)
            both = len(s & self.shingles[i])
            if both >= COPY_SHARE * len(self.shingles[i]) or both >= COPY_OWN_SHARE * max(len(s), 20):
                return True
        return False


def _literal(code: str, names: int, strings: int, longest: int, size: int) -> bool:
    """Nothing but one large literal: few words besides it, many elements or one long string without a blank."""
    if names > 2 * LITERAL_WORDS and "0x" not in code and "0X" not in code:
        return False
    words = [w for w in _NAME.findall(_NUMBER.sub(" ", code)) if w not in ("null", "true", "false", "None", "True", "False")]
    if len(words) > LITERAL_WORDS:
        return False
    numbers = len(_NUMBER.findall(code))
    return numbers + strings >= LITERAL_ELEMENTS or longest >= LITERAL_CHARS and longest >= 0.6 * size


#: What a file's names alone show.
NAMED = ("mangled names", "template names", "foreign style")


def read(path: str, text: str, library: Library | None) -> tuple[list[str], list[str], float, bool, list[str], list[int]]:
    """(reasons, evidence, template share, whether its lines are long, names, style counts) of a file by itself.  The evidence
    tells what each reason rests on.  Members of other things don't count for the style: who made these named them."""
    out, why = [], []
    if (where := folder_says(path)) is not None:
        out.append(where)
        why.append("path")
    code, strings, _, longest = code_part(text)
    found = set(_NAME_OR_MEMBER.findall(code))
    names = sorted({x.removeprefix(".") for x in found})
    share = template_share(code, names)
    if share >= TEMPLATE_SHARE:
        out.append("generated")
        why.append("template names")
    if says_generated(text):
        out.append("generated")
        why.append("banner")
    if "(this && this.__" in text and _COMPILED.search(text) or "__esModule" in text and _COMPILED.search(text) or "sourceMappingURL" in text and _MAP.search(text):
        out.append("generated")
        why.append("compiler's marks")
    if _literal(code, len(names), strings, longest, len(text)):
        out.append("data")
        why.append("literal")
    if library is not None and library.holds(text):
        out.append("vendored")
        why.append("library copy")
    dense = len(text) >= 200 and len(text) / (text.count("\n") + 1) >= 80
    return sorted(set(out)), sorted(set(why)), share, dense, names, style_counts(x for x in found if x[0] != ".").tolist()


def fits(lang: str, names: list[str], models: dict[str, Model]) -> bool:
    """Whether the plain words, keywords among them, are the language's: no other language but its kin explains them better."""
    plain, own = plain_words(names), models.get(lang + PLAIN)
    if not plain or not own:
        return False
    bits = own.score(plain)
    return bits <= own.mean + FIT_BITS and bits <= min(m.score(plain) for k, m in models.items() if k.endswith(PLAIN) and k != KIN.get(lang, "") + PLAIN)


def reasons_of(lang: str | None, names: list[str], style: list[int], dense: bool, models: dict[str, Model]) -> tuple[list[str], list[str], float, bool]:
    """(reasons, evidence, bits above the language's mean, whether the style is far from the language's) by the names.
    Without long (``dense``) lines mangled names have to be many; then, and for the style, the plain words have to be the
    language's, since text of another language or format is neither mangled nor foreign."""
    out, why = [], []
    model = models.get(lang)
    if not model or not names:
        return out, why, 0.0, False
    above = model.score(names) - model.mean
    short = sum(len(n) <= 2 for n in names)
    if above >= MANGLED_BITS and short >= 0.3 * len(names) and (dense or short >= MANGLED_SHORT and fits(lang, names, models)):
        out.append("minified")
        why.append("mangled names")
    own = np.array(style)
    far = own.sum() >= STYLE_NAMES and style_distance(own, model.style - own) >= STYLE_DISTANCE and fits(lang, names, models)
    return out, why, above, bool(far)


def foreign(scored: DataFrame, styles: DataFrame) -> DataFrame:
    """The ``scored`` files with the reason of a foreign style for those ``far`` from their language's that are also far from
    the other files of their repository and language.  Where these have too few names for a style, the language decides.

    Only far files look for their repository; all others keep keys of their own, so a large repository is no hot key."""
    own, rest = F.col("style"), F.zip_with("style_all", "style", lambda a, b: a - b)
    total = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda x, y: x + y)
    share = lambda n, c: n / F.greatest(total(c), F.lit(1))
    away = F.aggregate(F.zip_with(own, rest, lambda a, b: F.abs(share(a, own) - share(b, rest))), F.lit(0.0), lambda x, y: x + y)
    key = F.when(F.col("far"), F.concat_ws("/", "lang", "repo")).otherwise(F.concat(F.lit("/"), F.col("id").cast("string")))
    by_key = styles.select(F.concat_ws("/", "lang", "repo").alias("key"), "style_all")
    is_foreign = F.col("far") & F.when(total(rest) < STYLE_NAMES, True).otherwise(away >= STYLE_DISTANCE)
    added = lambda c, what: F.when(is_foreign, F.array_sort(F.array_union(c, F.array(F.lit(what))))).otherwise(F.col(c)).alias(c)
    return scored.withColumn("key", key).join(by_key, "key", "left").select("id", added("reasons", "vendored"), added("evidence", "foreign style"), "bits", "template")


_LIBRARIES: dict[int, Library] = {}


def _library(number: int, texts: list[str]) -> Library:
    """The index of the library files of one broadcast, built once in each worker."""
    if number not in _LIBRARIES:
        _LIBRARIES.clear()
        _LIBRARIES[number] = Library(texts)
    return _LIBRARIES[number]


def _line_rows(df: DataFrame, kind: str) -> DataFrame:
    """(key, h, lines): the hash of each long line of a text once, and how many there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, text in enumerate(b.column("content").to_pylist()):
                own = sorted({xxhash.xxh64_intdigest(x.encode("utf-8", "replace")) - (1 << 63) for x in long_lines(text)})
                for s in range(0, len(own), 20_000):
                    part = own[s : s + 20_000]
                    yield pa.RecordBatch.from_arrays([b.column("key").take(pa.array([i] * len(part))), pa.array(part, pa.int64()), pa.array([len(own)] * len(part), pa.int32())], ["key", "h", "lines"])

    return df.select("key", "content").mapInArrow(run, f"key {kind}, h bigint, lines int")


def copies(files: DataFrame, libraries: DataFrame) -> DataFrame:
    """(key) of the ``files`` (key, content) that hold a copy of a library file (content), for libraries of any size.

    The lines of both meet by their hashes, those of the files spread over ``SALTS`` parts; pairs that share enough lines go
    on to their texts, each file once with all its candidates, where shingles decide as in ``Library.holds``."""
    kind = dict(files.dtypes)["key"]
    known = materialize(libraries.select(F.xxhash64("content").alias("key"), "content").distinct(), "libraries")
    salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    a = _line_rows(known, "bigint").select(F.col("key").alias("lib"), "h", F.col("lines").alias("lib_lines"), salt)
    b = _line_rows(files, kind).select("key", "h", "lines", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int").alias("salt"))
    shared = a.join(b, ["h", "salt"]).groupBy("key", "lib").agg(F.count(F.lit(1)).alias("n"), F.first("lines").alias("lines"), F.first("lib_lines").alias("lib_lines"))
    near = shared.where((F.col("n") >= COPY_LINES) & (F.col("n") >= COPY_LINE_SHARE * F.least("lines", "lib_lines"))).select("key", "lib")
    with_texts = near.join(known.select(F.col("key").alias("lib"), F.col("content").alias("lib_content")), "lib").groupBy("key").agg(F.collect_set("lib_content").alias("near"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [i for i, (t, near) in enumerate(zip(b.column("content").to_pylist(), b.column("near").to_pylist())) if Library(near).holds(t)]
            yield pa.RecordBatch.from_arrays([b.column("key").take(pa.array(keep, pa.int64()))], ["key"])

    return with_texts.join(files, "key").mapInArrow(run, f"key {kind}").distinct()


def origins(files: DataFrame, libraries: DataFrame, ident: str = "file_id", path: str = "file_path", content: str = "content", broadcast_files: int = BROADCAST_LIBRARY_FILES, broadcast_chars: int = BROADCAST_LIBRARY_CHARS) -> DataFrame:
    """(ident, reasons, evidence, bits, template) per file; no reason means hand-written.

    Null contents and paths are judged by what there is.  Repeated deliveries count once, also in the models.  A path's first
    folder is its repository.  ``libraries`` has a column ``content``; null or empty ones match nothing, an empty table has no
    copies.  Each text is read once; its names are kept in the shared folder for training and scoring.
    """
    spark = files.sparkSession
    kind = dict(files.dtypes)[ident]
    rows = files.select(F.col(ident).alias("id"), F.coalesce(F.col(path), F.lit("")).alias("path"), F.coalesce(F.col(content), F.lit("")).alias("content"))
    known = libraries.where(F.length("content") > 0).select("content")
    size = known.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("content")).alias("chars")).first()
    few = size["n"] <= broadcast_files and (size["chars"] or 0) <= broadcast_chars
    texts = [r[0] for r in known.collect()] if few else None
    number = uuid.uuid4().int
    shared = spark.sparkContext.broadcast(texts)
    lists, whole = pa.list_(pa.string()), pa.list_(pa.int64())

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = _library(number, shared.value) if shared.value is not None else None
        for b in batches:
            paths = b.column("path").to_pylist()
            langs = [language_of(p) for p in paths]
            got = [read(p, t, library) for p, t in zip(paths, b.column("content").to_pylist())]
            names = [" ".join(g[4]) if lang else "" for g, lang in zip(got, langs)]
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array([p.partition("/")[0] for p in paths], pa.string()), pa.array(langs, pa.string()), pa.array([g[0] for g in got], lists), pa.array([g[1] for g in got], lists), pa.array([round(g[2], 4) for g in got], pa.float64()), pa.array([g[3] for g in got], pa.bool_()), pa.array([g[5] for g in got], whole), pa.array(names, pa.string())],
                ["id", "repo", "lang", "reasons", "evidence", "template", "dense", "style", "names"],
            )

    seen = materialize(rows.mapInArrow(look, f"id {kind}, repo string, lang string, reasons array<string>, evidence array<string>, template double, dense boolean, style array<bigint>, names string").distinct(), "names")
    learned = spark.sparkContext.broadcast(train(seen))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [reasons_of(lang, names.split(" ") if names else [], style, dense, learned.value) for lang, names, style, dense in zip(*(b.column(c).to_pylist() for c in ("lang", "names", "style", "dense")))]
            both = [[sorted({*old, *g[i]}) for old, g in zip(b.column(c).to_pylist(), got)] for i, c in enumerate(("reasons", "evidence"))]
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("repo"), b.column("lang"), pa.array(both[0], lists), pa.array(both[1], lists), pa.array([round(g[2], 4) for g in got], pa.float64()), b.column("template"), pa.array([g[3] for g in got], pa.bool_()), b.column("style")],
                ["id", "repo", "lang", "reasons", "evidence", "bits", "template", "far", "style"],
            )

    judged = seen.mapInArrow(judge, f"id {kind}, repo string, lang string, reasons array<string>, evidence array<string>, bits double, template double, far boolean, style array<bigint>")
    styles = seen.where(F.col("lang").isNotNull()).groupBy("repo", "lang").agg(F.array(*(F.sum(F.col("style")[i]) for i in range(len(STYLES)))).alias("style_all"))
    scored = foreign(judged, styles).distinct()
    if not few:
        copied = copies(rows.select(F.col("id").alias("key"), "content"), known).select(F.col("key").alias("id"), F.array(F.lit("vendored")).alias("r"), F.array(F.lit("library copy")).alias("e"))
        joined = lambda a, b: F.array_sort(F.array_union(a, F.coalesce(b, F.array().cast("array<string>"))))
        scored = scored.join(copied, "id", "left").select("id", joined("reasons", "r").alias("reasons"), joined("evidence", "e").alias("evidence"), "bits", "template")
    return scored.select(F.col("id").alias(ident), "reasons", "evidence", "bits", "template")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    x = origins(table(spark, d, "file_contexts"), table(spark, d, "library_files"))
    return x.where(F.size("reasons") > 0).select("file_id").distinct()


def p5_origins(spark: SparkSession, d: str) -> DataFrame:
    """Files by what shows that nobody wrote them, and how many of these nothing else shows."""
    x = origins(table(spark, d, "file_contexts"), table(spark, d, "library_files")).where(F.size("reasons") > 0)
    named = F.size(F.array_intersect("evidence", F.array(*(F.lit(n) for n in NAMED)))) > 0
    rows = x.select("file_id", (F.size("evidence") == 1).alias("alone"), F.explode(F.concat("evidence", F.array(F.when(named, "any name").otherwise("no name"), F.lit("anything")))).alias("evidence"))
    return rows.groupBy("evidence").agg(F.countDistinct("file_id").alias("files"), F.countDistinct(F.when(F.col("alone"), F.col("file_id"))).alias("alone"))


QUERIES = {"p5_found": p5_found, "p5_origins": p5_origins}
SQL: dict[str, str] = {}
