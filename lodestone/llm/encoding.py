"""Repair of text that was decoded with a wrong character encoding.

The states of the search are texts.  An operation encodes a text with the charset it was wrongly read in and decodes the
bytes as what they were, or resolves numeric character references, escapes or percent signs.  A best-first search expands
the cheapest state first and skips states it has seen (by hash); it ends when no state is left, and if it should come to
``MOST`` expansions before, the text isn't told as whole.  A character plausibility cost says how much a text looks like
writing: letters of a language in their usual case are cheap, symbols inside words, mixed alphabets and control
characters are dear.

There are two kinds of states.  UTF-8 read as something else shows within a word, so there a state is a word and the
search goes on word by word, since a garbled passage often stands beside sound ones.  A charset of one byte or of East Asia
read as another one shows only in the words of a sentence together: there a state is a sentence, its operations are the
pairs of charsets, and a result must be clearly better than what stands there.  Spans between backquotes are examples
and stay as they are unless they stand in a text that is garbled around them.
"""

from __future__ import annotations

import heapq
import html
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.tables import table

#: Charsets in which UTF-8 bytes are wrongly read.
READ_AS = ("cp1252", "latin-1", "cp1250", "cp1251", "cp437", "cp850", "mac_roman", "koi8-r", "cp866", "cp1254", "iso8859-15", "iso8859-2", "cp852")
#: (wrongly read as, was) of one-byte Cyrillic texts.
SWAPPED = (("cp1252", "cp1251"), ("latin-1", "cp1251"), ("cp1251", "koi8-r"), ("koi8-r", "cp1251"), ("cp866", "cp1251"), ("cp1251", "cp866"), ("koi8-r", "cp866"), ("cp866", "koi8-r"), ("cp1252", "koi8-r"), ("latin-1", "koi8-r"), ("cp437", "cp1251"), ("cp850", "cp1251"), ("cp1252", "cp866"), ("latin-1", "cp866"), ("mac_roman", "cp1251"), ("cp1251", "mac_cyrillic"))
#: (wrongly read as, was) of one-byte Latin texts; a word with such letters rarely has two, so the gain must be clear.
SWAPPED_LATIN = (("cp1252", "cp1250"), ("latin-1", "iso8859-2"), ("cp437", "cp1252"), ("cp850", "cp1252"), ("mac_roman", "cp1252"), ("cp1252", "mac_roman"), ("cp1252", "cp850"), ("cp1252", "cp437"), ("cp1251", "cp1252"), ("koi8-r", "cp1252"), ("cp1250", "cp1252"))

#: (wrongly read as, was) of one-byte texts in other alphabets, with the characters that most of such a text must be.
SWAPPED_SCRIPT = tuple((a, b, low, high) for a in ("cp1252", "latin-1") for b, low, high in (("cp1255", "\u05d0", "\u05ea"), ("iso8859-8", "\u05d0", "\u05ea"), ("cp1253", "\u0370", "\u03ff"), ("iso8859-7", "\u0370", "\u03ff"), ("cp1256", "\u0600", "\u06ff")))
#: (was, first bytes that nearly all of its usual characters have, share of them): charsets of East Asia, the narrower first.
EAST_ASIAN = (("shift_jis", b"\x81\x82\x83", 0.4), ("euc_jp", b"\xa1\xa4\xa5", 0.4), ("euc_kr", bytes(range(0xB0, 0xC9)), 0.95), ("gbk", bytes(range(0xB0, 0xD8)), 0.85), ("big5", bytes(range(0xA4, 0xC7)), 0.85))
#: Expansions of one search; what is left then is told as not whole.
MOST = 2_000

# fixed values: letters in common use in western and northern European languages, and usual typographic signs
_LATIN = set("àáâãäåæçèéêëìíîïñòóôõöøùúûüýÿœßÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝŒðþÐÞ")
# fixed values: letters of the languages of central Europe
_CENTRAL = set("ąćęłńśźżčďěňřšťůžőűăâîșțşţĄĆĘŁŃŚŹŻČĎĚŇŘŠŤŮŽŐŰĂȘȚŞŢ")
_USUAL = set("äöüßéèêàçùâîôûïëœñáíóúãõ")
_SIGNS = set("’‘“”„«»‹›–—…•→←−×≠≥≤€°§©®™¿¡№·½¼¾²³µ\xa0\u202f\u2009\u200b\xad")
_OPENING = set("“„«‘‹¿¡(")
# fixed values: share of the letters in Russian text, in per mille
_RUSSIAN = dict(zip("оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфъё", (109, 84, 80, 74, 67, 63, 55, 47, 45, 44, 35, 32, 30, 28, 26, 20, 19, 17, 17, 16, 16, 14, 12, 10, 9, 7, 6, 5, 4, 3, 3, 1, 1)))


def _high(charset: str) -> dict[str, int]:
    """Character to byte for the upper half; bytes without a character stand for the control of the same number."""
    out = {}
    for byte in range(128, 256):
        try:
            c = bytes([byte]).decode(charset)
        except UnicodeDecodeError:
            c = chr(byte)
        out.setdefault(c, byte)
        if byte < 160:
            out.setdefault(chr(byte), byte)
    return out


_TO_BYTE = {c: _high(c) for c in {*READ_AS, *(x[0] for x in SWAPPED + SWAPPED_LATIN + SWAPPED_SCRIPT)}}
_FROM_BYTE = {c: {b: ch for ch, b in reversed(_high(c).items())} for c in {x[1] for x in SWAPPED + SWAPPED_LATIN + SWAPPED_SCRIPT}}
_UNREFERENCED = re.compile(r"&(?:amp;)*#(?:x[0-9A-Fa-f]{2,6}|[0-9]{2,7});|&(?:amp;)*[A-Za-z]{2,8}[0-9]{0,2};")
_ESCAPED = re.compile(r"(?:\\u[0-9a-fA-F]{4}|\\x[0-9a-fA-F]{2}|\\[0-3][0-7]{2})+")
_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_QUOTED = re.compile(r"(?:=[0-9A-F]{2})+|(?:=[0-9A-Fa-f]{2}){2,}")
_ANGLE = re.compile(r"(?:<U\+[0-9A-Fa-f]{4,6}>|<[0-9A-Fa-f]{2}>)+")
#: First half of a UTF-8 sequence that a no-break space may end, as the charsets show it.
_LEADS = {c for charset in READ_AS for c, b in _TO_BYTE[charset].items() if b in (0xC2, 0xC3)}
#: Texts without any of these can't be garbled: only ASCII, and no escape of anything beyond ASCII.
ESCAPES = r"&(?:amp;)*#|&(?:amp;)*[A-Za-z]{2,8}[0-9]{0,2};|\\u(?!00[0-7])[0-9a-fA-F]{4}|\\x[89a-fA-F]|\\[23][0-7]{2}|%[89a-fA-F][0-9a-fA-F]|=[89A-F][0-9A-F]|=[89a-fA-F][0-9a-fA-F]=[89a-fA-F][0-9a-fA-F]|<U\+|<[89a-fA-F][0-9a-fA-F]>"
SUSPECT = r"[^\x00-\x7f]|" + ESCAPES
_suspect = re.compile(SUSPECT).search
_escaped = re.compile(ESCAPES).search


def _sequences(charset: str) -> str:
    """The characters that a charset shows for a whole UTF-8 sequence."""
    chars = lambda low, high: "[" + "".join(re.escape(c) for c, b in _TO_BYTE[charset].items() if low <= b <= high) + "]"
    tail = chars(0x80, 0xBF)
    return "|".join((chars(0xC2, 0xDF) + tail, chars(0xE0, 0xEF) + tail + "{2}", chars(0xF0, 0xF4) + tail + "{3}"))


_SEQUENCE = {c: re.compile(_sequences(c)) for c in READ_AS}
_MISREAD = re.compile("|".join(_sequences(c) for c in READ_AS))
#: Per pair of one-byte charsets: the character that each character was.
_TURNED = {(a, b): {ord(c): _FROM_BYTE[b][n] for c, n in _TO_BYTE[a].items() if n in _FROM_BYTE[b]} for a, b, *_ in SWAPPED + SWAPPED_LATIN + SWAPPED_SCRIPT}
_TURNABLE = {pair: frozenset(map(chr, turned)) for pair, turned in _TURNED.items()}
_LETTER_RUN = re.compile(r"[^\W\d_\x00-\x7f]{2}")
_CYRILLIC = re.compile("[\u0400-\u04ff]")


def _alphabet(c: str) -> int:
    """1 Latin, 2 Cyrillic, 3 another letter, 0 no letter."""
    if c < "\x80":
        return 1 if c.isalpha() else 0
    if c in _LATIN or "Ā" <= c <= "ɏ":
        return 1
    if "Ѐ" <= c <= "ӿ":
        return 2
    return 3 if c.isalpha() else 0


@lru_cache(maxsize=1 << 17)
def cost(text: str) -> float:
    """How little ``text`` looks like writing; 0 for ASCII."""
    total, before, kind_before = 0.0, " ", 0
    for i, c in enumerate(text):
        kind = _alphabet(c)
        if c >= "\x80":
            after = text[i + 1] if i + 1 < len(text) else " "
            if c == "�":
                total += 8
            elif c < "\xa0":
                total += 8
            elif c in _LATIN:
                total += 1.0 if c.lower() in _USUAL else 2.0
                if c.isupper() and (before.islower() or after.islower() and kind_before):
                    total += 4
                if kind_before == 1 and before >= "\x80" and before.isalpha():
                    total += 2.0 if c.isupper() == before.isupper() else 5.0
                if c in "ÃÂ" and after in " \xa0\xad" and not (kind_before and before.isupper()) or "\x80" <= after < "\xa0":
                    total += 2
            elif kind == 2:
                share = _RUSSIAN.get(c.lower())
                total += 5.0 if share is None else 0.4 + 1.2 / (1 + share / 12)
                if c.isupper() and before.islower():
                    total += 6
            elif c in _CENTRAL:
                total += 2.0 + (4.0 if c.isupper() and before.islower() else 0.0)
            elif unicodedata.category(c) in ("Cn", "Co", "Cs"):
                total += 20
            elif kind:
                total += 5
            elif c in _SIGNS:
                total += 1.5
                if c in "’‘–—…·\xad":
                    if before >= "\x80" and before not in _SIGNS and kind_before == 1 and before in "âÂÃ":
                        total += 4
                elif c in "€™©®°§²³µ½¼¾¿¡«»“”„‹›×≠≥≤→←−•№\xa0\u202f\u2009\u200b":
                    glued = (kind_before and before >= "\x80") or (kind_before and _alphabet(after) and c not in "\xa0\u202f\u2009")
                    if glued or (c in "¿¡„“«" and kind_before):
                        total += 3
            else:
                total += 6
            if kind and kind_before and kind != kind_before:
                total += 5
        elif kind and kind_before and kind_before != 1:
            total += 5
        elif kind and before >= "\x80" and not kind_before and before not in _SIGNS:
            total += 1
        before, kind_before = c, kind
    return total


def _read_again(text: str, charset: str) -> str | None:
    """UTF-8 sequences that ``charset`` shows as single characters, put together again; other characters stay."""
    to_byte = _TO_BYTE[charset]

    def turn(m: re.Match) -> str:
        try:
            return bytes([to_byte[c] for c in m[0]]).decode()
        except UnicodeDecodeError:
            return m[0]

    new = _SEQUENCE[charset].sub(turn, text)
    return new if new != text else None


def _swap(text: str, read_as: str, was: str) -> str | None:
    if not {c for c in text if c >= "\x80"} <= _TURNABLE[read_as, was]:
        return None
    new = text.translate(_TURNED[read_as, was])
    return new if new != text else None


def _bytes_as_text(raw: bytes) -> str:
    """Bytes of an escape as UTF-8 where they are, else as characters of the same number."""
    try:
        return raw.decode()
    except UnicodeDecodeError:
        return raw.decode("latin-1")


def _numbers(text: str) -> str:
    """Backslash and angle escapes of a run of characters."""
    out = []
    for u, x, o, a, b in re.findall(r"\\u([0-9a-fA-F]{4})|\\x([0-9a-fA-F]{2})|\\([0-3][0-7]{2})|<U\+([0-9A-Fa-f]{4,6})>|<([0-9A-Fa-f]{2})>", text):
        code = int(o, 8) if o else int(u or x or a or b, 16)
        out.append(chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else "�")
    return "".join(out)


def _unescape(text: str) -> Iterator[str]:
    if "&" in text and (new := _UNREFERENCED.sub(lambda m: html.unescape(m[0].replace("amp;", "") if "#" in m[0] or m[0].count(";") > 1 else m[0]), text)) != text:
        yield new
    for pattern in (_ESCAPED, _ANGLE):
        if (new := pattern.sub(lambda m: _numbers(m[0]) if not _numbers(m[0]).isascii() else m[0], text)) != text:
            yield new
    for pattern, sign in ((_PERCENT, "%"), (_QUOTED, "=")):
        if sign in text:
            new = pattern.sub(lambda m: _bytes_as_text(bytes.fromhex(m[0].replace(sign, ""))) if re.search(sign + "[89A-Fa-f]", m[0]) else m[0], text)
            if new != text:
                yield new


def _state_cost(text: str) -> float:
    """Plausibility cost, and 3 for every escape still standing: it hides a character of unknown looks."""
    at = cost(text)
    for sign, pattern in (("&", _UNREFERENCED), ("\\", _ESCAPED), ("<", _ANGLE), ("%", _PERCENT), ("=", _QUOTED)):
        if sign in text:
            at += 3 * len(pattern.findall(text))
    return at


@lru_cache(maxsize=1 << 16)
def search(text: str, most: int = MOST) -> tuple[str, int, bool]:
    """The cheapest text that is reached, the number of decoding operations on the way (0: nothing was gained), and whether
    all states were seen.  Of equally cheap states the one with fewer operations comes first."""
    start = _state_cost(text)
    best, best_at, steps = text, start, 0
    seen, heap, n = {hash(text)}, [(start, 0, text, 0)], 0
    if text[-1:] in _LEADS:  # the no-break space that ended the sequence became a blank
        seen.add(hash(text + "\xa0"))
        heap.append((start, 1, text + "\xa0", 0))
    while heap and n < most:
        at, _, here, decoded = heapq.heappop(heap)
        n += 1
        if decoded and at < best_at - 0.9:
            best, best_at, steps = here, at, decoded
        moves = [(x, decoded) for x in _unescape(here)]
        if not here.isascii():
            moves += [(x, decoded + 1) for c in READ_AS if (x := _read_again(here, c)) is not None]
        for new, d in moves:
            if (h := hash(new)) not in seen:
                seen.add(h)
                heapq.heappush(heap, (_state_cost(new), len(seen), new, d))
    return best, steps, not heap


_SPAN = re.compile(r"`[^`\n]*`")
_WORD = re.compile(r"[^ \t\r\n\f\v]+")


#: Sound writing costs less a character, whatever the language: below, no other charset is tried.
SOUND_LATIN, SOUND_CYRILLIC = 1.55, 0.75


def _east_asian(text: str, charset: str, leads: bytes, share: float) -> str | None:
    """Runs of characters of two bytes each, read as one each, put together again; strict, and only if the result is what such
    texts are made of."""
    to_byte = _TO_BYTE["cp1252"]
    raw = bytearray()
    for c in text:
        if c < "\x80":
            raw.append(ord(c))
        elif (b := to_byte.get(c)) is None:
            return None
        else:
            raw.append(b)
    try:
        new = raw.decode(charset)
    except UnicodeDecodeError:
        return None
    wide = [c for c in new if c >= "\u3040"]
    if len(wide) < 4 or any(c >= "\x80" and c < "\u2010" for c in new):
        return None
    first = [c.encode(charset)[0] for c in wide]
    return new if sum(b in leads for b in first) >= share * len(first) else None


def _script(text: str, read_as: str, was: str, low: str, high: str) -> str | None:
    """A text of another alphabet of one byte a letter: nearly all its letters must be of it, in words of usual case."""
    new = _swap(text, read_as, was)
    if new is None:
        return None
    letters = [c for c in new if c >= "\x80" and c.isalpha()]
    fit = sum(low <= c <= high for c in letters)
    odd = sum(1 for a, b in zip(new, new[1:]) if a.islower() and b.isupper())
    return new if len(letters) >= 8 and fit == len(letters) and odd == 0 and len(letters) >= 0.7 * sum(c >= "\x80" for c in new) else None


def _moves(words: tuple[str, ...], high: str, cyrillic: bool) -> Iterator[tuple[tuple[str, ...], float, float]]:
    """What a sentence's words can have been: (words, share of the cost that may remain, least gain)."""
    letters, present = sum(c.isalpha() for c in high), set(high)
    for pairs, share, least in ((SWAPPED, 0.72, 4.0), (SWAPPED_LATIN, 0.6, 2.5)):
        for read_as, was in pairs:
            # capitals alone may be a list of letters: they say little unless there are many
            if letters < (8 if high.isupper() and letters > 3 else 4 if pairs is SWAPPED else 0) or not present <= _TURNABLE[read_as, was]:
                continue
            turned = _TURNED[read_as, was]
            yield tuple([w.translate(turned) for w in words]), share, least
    if not cyrillic and len(high) >= 8:
        together = " ".join(words)
        if len(high) >= 0.6 * (len(together) - len(words) + 1):
            for read_as, was, low, top in SWAPPED_SCRIPT:
                if (new := _script(together, read_as, was, low, top)) is not None:
                    yield tuple(new.split(" ")), 2.0, -1e9
            for was, leads, share in EAST_ASIAN:
                if (new := _east_asian(together, was, leads, share)) is not None and new.count(" ") == len(words) - 1:
                    yield tuple(new.split(" ")), 2.0, -1e9
                    break


#: A letter of another alphabet costs more than a letter of sound Russian in the mean, and less than one of a text that only
#: happens to be of Russian letters.
FOREIGN = 0.75
_FOREIGN = re.compile("[\u0370-\u03ff\u05d0-\u05ea\u0600-\u06ff\u3000-\u30ff\u4e00-\u9fff\uac00-\ud7a3\uff00-\uffef]")


def _foreign_cost(words: tuple[str, ...]) -> float:
    """``cost`` of words, with ``FOREIGN`` for each letter of an alphabet that it knows nothing of, and five where such
    a letter is the only one of its word or stands with letters of other alphabets."""
    total = 0.0
    for w in words:
        rest, n = _FOREIGN.subn("", w)
        alone = n > 1 and rest.isascii() and not any(map(str.isalpha, rest))
        total += (FOREIGN if alone else 5.0) * n + cost(rest)
    return total


def _search_sentence(line: str) -> str | None:
    """Best-first search over charsets that were taken for each other, on all words of a sentence together; None if nothing is
    clearly better."""
    words = tuple(w for w in _WORD.findall(_SPAN.sub(" ", line)) if not w.isascii())
    high = "".join(c for w in words for c in w if c >= "\x80")
    if not high:
        return None
    start = sum(cost(w) for w in words)
    cyrillic = 2 * len(_CYRILLIC.findall(high)) > len(high)
    if cyrillic and start < SOUND_CYRILLIC * len(high) or not cyrillic and start <= SOUND_LATIN * len(high) and not any(_LETTER_RUN.search(w) for w in words):
        return None
    best, best_at = None, start
    seen, heap = {hash(words)}, [(start, 0, words)]
    while heap:
        at, _, here = heapq.heappop(heap)
        if here is not words and at < best_at:
            best, best_at = here, at
        chars = "".join(c for w in here for c in w if c >= "\x80")
        for new, share, least in _moves(here, chars, 2 * len(_CYRILLIC.findall(chars)) > len(chars)):
            c = _foreign_cost(new)
            if (h := hash(new)) not in seen and c < share * at and at - c >= least:
                seen.add(h)
                heapq.heappush(heap, (c, len(seen), new))
    if best is None:
        return None
    turned = iter(best)
    return "".join(p if p.startswith("`") or p.isascii() else _WORD.sub(lambda m: m[0] if m[0].isascii() else next(turned), p) for p in re.split(r"(`[^`\n]*`)", line))


def _pieces(text: str) -> Iterator[tuple[str, bool]]:
    """The text cut at backquote spans: (piece, stands between backquotes)."""
    at = 0
    for m in _SPAN.finditer(text):
        yield text[at : m.start()], False
        yield m[0], True
        at = m.end()
    yield text[at:], False


_SENTENCE = re.compile(r"((?<=[.!?;:])[ \t]+)")


def _line_cost(line: str) -> float:
    return _foreign_cost(tuple(w for w in _WORD.findall(_SPAN.sub(" ", line)) if not w.isascii()))


def _search_words(line: str) -> tuple[str, bool, bool]:
    """The line with each suspicious word replaced by the cheapest text found for it, examples left alone; whether one was
    found; whether every search saw all its states."""
    gained, whole, out = False, True, []
    for piece, example in _pieces(line):
        if example or (piece.isascii() and not _suspect(piece)):
            out.append(piece)
            continue

        def word(m: re.Match) -> str:
            nonlocal gained, whole
            w = m[0]
            if w.isascii() and not _suspect(w):
                return w
            if not _MISREAD.search(w) and w[-1] not in _LEADS and not _escaped(w):
                return w  # no operation applies
            new, steps, all_seen = search(w)
            gained |= steps > 0
            whole &= all_seen or not steps
            return new

        out.append(_WORD.sub(word, piece))
    return "".join(out), gained, whole


def repair(text: str | None) -> tuple[bool, str | None, bool]:
    """(garbled, text after repair, whole): ``whole`` is false where characters are lost for good."""
    if not text or text.isascii() and not _suspect(text):
        return False, text, True
    changed, whole, lines = False, True, []
    for line in text.split("\n"):
        if line.isascii() and not _suspect(line):
            lines.append(line)
            continue
        parts = []
        for part in _SENTENCE.split(line):
            if part.isascii() and not _suspect(part):
                parts.append(part)
                continue
            word_by_word, gained, seen = _search_words(part)
            new, together = word_by_word, _search_sentence(part)
            if together is not None and (not gained or _line_cost(together) < _line_cost(word_by_word)):
                new, gained = together, True
            elif gained and (again := _search_sentence(word_by_word)) is not None:
                new = again
            parts.append(new)
            changed |= gained
            # what still stands far from any writing has not come back whole
            whole &= seen and not (gained and (high := sum(c >= "\x80" for c in new)) and _line_cost(new) > 4 * high)
        lines.append("".join(parts))
    fixed = "\n".join(lines)
    lost = any("\ufffd" in p for p, example in _pieces(fixed) if not example)
    return changed or lost, fixed, whole and not lost


def repaired(df: DataFrame, ident: str, text: str) -> DataFrame:
    """Per row with a text: ident, ``garbled``, ``whole`` and ``text``, the repaired text.

    Null texts are left out; an empty or pure ASCII text without escapes is sound and takes no search.  Rows are handled
    one by one in Arrow batches, without a shuffle; equal ids give one row each.
    """
    kept = df.where(F.col(text).isNotNull()).select(F.col(ident).alias("id"), F.col(text).alias("text"))
    kind = dict(kept.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = [repair(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([x[0] for x in done], pa.bool_()), pa.array([x[2] for x in done], pa.bool_()), pa.array([x[1] for x in done], pa.string())], ["id", "garbled", "whole", "text"])

    return kept.mapInArrow(run, f"id {kind}, garbled boolean, whole boolean, text string").select(F.col("id").alias(ident), "garbled", "whole", "text")


def suspects(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold any character or escape beyond ASCII: the others can't be garbled, in whatever way."""
    return table(spark, d, "documents").where(F.col("text").rlike(SUSPECT))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return repaired(suspects(spark, d), "doc_id", "text").where("garbled").select("doc_id")


def p8_repaired(spark: SparkSession, d: str) -> DataFrame:
    """The garbled documents with their text restored; ``whole`` is false where a loss can't be undone."""
    return repaired(suspects(spark, d), "doc_id", "text").where("garbled").select("doc_id", "whole", "text")


QUERIES = {"p8_found": p8_found, "p8_repaired": p8_repaired}
SQL: dict[str, str] = {}
