"""Lexer states, bracket summaries and grammars over token classes.

A text becomes a string with one character per token (its class).  A bracket pair is matched against the local grammars of
its bracket and replaced by one character that says as what it can be read; one pass with a stack folds a whole text into
one line of statements, however deep it nests.  Folding is associative: the summary of a chunk keeps only brackets that
match nothing inside it, and the summary of two chunks is their joined summaries, folded again.

A chunk may begin inside a comment, a text or a template.  The lexer's state is what has to be put in front of the next
chunk so that it is read rightly: nothing in code, ``/*`` in a comment, the opening of a text, or the piece of a template's
unfinished substitution.  The summary of a chunk is a map from the state at its start to the state at its end and the
folded classes in between.  Maps compose, chunk by chunk, in any grouping.  A map lists the usual states; a rarer one is
worked out from the chunk's text when a join asks for it.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence

import regex

#: Class of anything that no program may hold; no grammar accepts it.
BAD = "\x00"
_GROUP = {"(": 0xE000, "[": 0xE100, "{": 0xE200}
_CLOSE = {"(": ")", "[": "]", "{": "}"}
_BRACKETS = re.compile(r"([()\[\]{}])")
#: The same list element, member or statement three times or more reads as it does twice.
_REPEATS = re.compile(r"([^()\[\]{},;\n\ue200-\ue2ff]{0,60}(?:[,;\ue200-\ue2ff]\n?|\n))\1{2,}")
#: Ends a chunk that was cut within a line.
MARK = "\ufdd0"
_REMEMBER = 400_000


def group(bracket: str, bits: int, all_bits: int = 8) -> str:
    """A regex class of the folded groups of a bracket that can be read as any of ``bits``."""
    base = _GROUP[bracket]
    fit = [m for m in range(1, 1 << all_bits) if m & bits]
    starts = [m for m in fit if m == 1 or not (m - 1) & bits]
    ends = [m for m in fit if m + 1 == 1 << all_bits or not (m + 1) & bits]
    return "[" + "".join(chr(base + a) if a == b else f"{chr(base + a)}-{chr(base + b)}" for a, b in zip(starts, ends)) + "]"


def any_group(bracket: str) -> str:
    base = _GROUP[bracket]
    return f"[{chr(base)}-{chr(base + 0xFF)}]"


def rules(parts: Mapping[str, str]) -> str:
    """A grammar as a regex prefix that defines every part; ``<NAME>`` calls a part, also recursively."""
    return "(?(DEFINE)" + "".join(f"(?P<{n}>{_calls(x)})" for n, x in parts.items()) + ")"


def _calls(text: str) -> str:
    return re.sub(r"<([A-Z_0-9]+)>", r"(?&\1)", re.sub(r"[ \n]+", "", text))


class _Classes(dict):
    def __init__(self, classify: Callable[[str], str]) -> None:
        super().__init__()
        self.classify = classify
        self[""] = ""

    def __missing__(self, token: str) -> str:
        if len(self) > _REMEMBER:
            self.clear()
            self[""] = ""
        c = self.classify(token)
        if len(token) < 200:
            self[token] = c
        return c


class _Folds(dict):
    def __init__(self, fold: Callable[[str], str]) -> None:
        super().__init__()
        self.fold = fold

    def __missing__(self, pair: str) -> str:
        if len(self) > _REMEMBER:
            self.clear()
        c = self.fold(pair)
        if len(pair) < 4000:
            self[pair] = c
        return c


class Memo(_Folds):
    """A bounded memory of a function of a string."""


Entry = tuple[str, str]


class ChunkMap:
    """The lexer-state map of a run of chunks: start state to (end state, folded classes), and the chunks themselves for
    states that are not listed."""

    __slots__ = ("entries", "texts")

    def __init__(self, entries: dict[str, Entry], texts: list[str]) -> None:
        self.entries, self.texts = entries, texts


class Language:
    """``token``: regex whose only capturing group is the token, blanks and comments skipped in front.  ``unfinished``:
    what an unclosed construct at the end of a text (class in ``opens``) leaves: (class of what is closed after all, state,
    rest of the text still to be read).  ``states``: the usual states beside code, each with the regex that leads out of it
    and the class of the construct.  ``grammar``: the rules; ``shape``: per bracket a list of (bit, rule[, signs]).
    ``tidy`` rewrites the inside of a bracket, or the top level (bracket ""), before matching.  ``trees``: a bracket whose
    inside fits no rule is still a token tree, as macros take it.  ``settle`` rewrites classes wherever their left side is
    known.  ``cut`` finds places between top-level statements; the part before the first one must match ``top``, the
    others ``rest``.  ``quick``: a test, and the token regex that does for texts that fail it.  A rule may name signs of
    which its texts hold at least one: others are not tried.  ``line_comment``: how a comment up to the line's end begins."""

    opens = "\x01\x02"
    line_comment = "//"

    def __init__(self, name: str, token: str, classify: Callable[[str], str], grammar: str, shape: Mapping[str, Sequence[tuple]], top: str, unfinished: Callable[[str], tuple[str, str, str]], states: Mapping[str, tuple[str, str]], tidy: Callable[[str, str], str] = lambda c, b: c, trees: bool = False, settle: Callable[[str], str] = lambda c: c, cut: str = "", rest: str = "", quick: tuple[Callable[[str], bool], str] | None = None) -> None:
        self.name, self.tidy, self.trees, self.settle, self.unfinished = name, tidy, trees, settle, unfinished
        self.find = re.compile(token).findall
        self.classes = _Classes(classify)
        self.shape = {b: [(bit, regex.compile(grammar + _calls(x[0]), regex.V0), x[1] if len(x) > 1 else "") for bit, *x in xs] for b, xs in shape.items()}
        self.top = regex.compile(grammar + _calls(top), regex.V0)
        self.cut = re.compile(cut) if cut else None
        self.quick = (quick[0], re.compile(quick[1]).findall) if quick else None
        self.rest = regex.compile(grammar + _calls(rest or top), regex.V0)
        self.folds = _Folds(self._read)
        self.firsts = _Folds(lambda c: "1" if self.top.fullmatch(c) else "0")
        self.rests = _Folds(lambda c: "1" if self.rest.fullmatch(c) else "0")
        self.states = {s: (re.compile(x), c) for s, (x, c) in states.items()}

    def _read(self, pair: str) -> str:
        """What a pair can be read as; repeats are told once, so long lists and generated members are known shapes."""
        if len(pair) > 12 and (short := _REPEATS.sub(r"\1\1", pair)) != pair:
            return self.folds[short]
        return self._fold(pair)

    def _fold(self, pair: str) -> str:
        bracket, inside = pair[0], pair[1:-1]
        bits = 0
        if BAD in inside:
            return BAD
        text = self.tidy(inside, bracket)
        for bit, x, signs in self.shape[bracket]:
            if (not signs or not text or any(c in text for c in signs)) and x.fullmatch(text):
                bits |= bit
        return chr(_GROUP[bracket] + bits) if bits or self.trees else BAD

    def start(self, text: str) -> str:
        """The text as it is cut into chunks."""
        return text

    def scan(self, text: str) -> tuple[str, str]:
        """(classes, state at the end) of a text that begins in code."""
        classes, parts = self.classes, []
        while True:
            find = self.quick[1] if self.quick and not self.quick[0](text) else self.find
            tokens = find(text)
            found = "".join([classes[t] for t in tokens])
            if not found or found[-1] not in self.opens:
                parts.append(found)
                return "".join(parts), ""
            while not tokens[-1]:
                tokens.pop()
            front, state, text = self.unfinished(tokens[-1])
            parts += [found[:-1], front]
            if state or not text:
                return "".join(parts), state

    def lex(self, text: str, state: str = "") -> Entry:
        """(classes, state at the end) of a text that begins in ``state``; "" is code."""
        if state:
            known = self.states.get(state)
            if known is not None and (m := known[0].match(text)):
                found, end = self.scan(text[m.end() :])
                return known[1] + found, end
        return self.scan(state + text)

    def fold(self, found: str) -> str:
        """Every bracket pair that closes within the text, replaced by what it can be read as, in one pass."""
        found = self.settle(found)
        pieces = _BRACKETS.split(found)
        if len(pieces) == 1:
            return found
        folds, open_, here = self.folds, [], [pieces[0]]
        for i in range(1, len(pieces), 2):
            b = pieces[i]
            if b in "([{":
                open_.append((here, b))
                here = [pieces[i + 1]]
            elif open_ and _CLOSE[open_[-1][1]] == b:
                inside = here[0] if len(here) == 1 else "".join(here)
                here, start = open_.pop()
                here.append(folds[start + inside + b])
                here.append(pieces[i + 1])
            elif open_:  # the wrong bracket: nothing that comes can mend it
                return BAD
            else:
                here.append(b)
                here.append(pieces[i + 1])
        while open_:
            inside = "".join(here)
            here, start = open_.pop()
            here += [start, inside]
        out = "".join(here)
        return _REPEATS.sub(r"\1\1", out) if len(out) > 200 else out

    def lex_chunk(self, text: str, state: str) -> Entry:
        """``lex`` of a piece that may end with MARK: what the mark was read as tells whether the line is a comment there."""
        found, end = self.lex(text, state)
        if text[-1:] == MARK:
            if end:
                end = end.replace(MARK, "")
            elif found[-1:] == BAD:
                found = found[:-1]
            else:
                end = self.line_comment
        return found, end

    def entry(self, chunk: str, state: str) -> Entry:
        found, end = self.lex_chunk(chunk, state)
        return end, self.fold(found)

    def summary(self, chunk: str, first: bool = False) -> ChunkMap:
        """The lexer-state map of a chunk; the first chunk of a file begins in code.

        The chunk is read from its start, and from the place where each other state ends.  Readings that are in code at
        the same place go on as one, so that usually all of a chunk but its first lines is read once."""
        if first:
            return ChunkMap({"": self.entry(chunk, "")}, [chunk])
        leaves: dict[int, list[tuple[str, str]]] = {}
        entries: dict[str, Entry] = {}
        for s, (way, c) in self.states.items():
            if m := way.match(chunk):
                leaves.setdefault(m.end(), []).append((s, c))
            else:
                entries[s] = self.entry(chunk, s)
        at, running = 0, {"": [("", "")]}  # state here: (start state, classes so far)
        for stop in [*sorted(leaves), len(chunk)]:
            if stop > at or stop == len(chunk):
                piece, moved = chunk[at:stop] + (MARK if stop < len(chunk) else ""), {}
                for state, origins in running.items():
                    found, end = self.lex_chunk(piece, state) if piece else ("", state)
                    found = self.fold(found)
                    moved.setdefault(end, []).extend((s, c + found) for s, c in origins)
                running, at = moved, stop
            running.setdefault("", []).extend(leaves.get(stop, ()))
            leaves.pop(stop, None)
        for end, origins in running.items():
            for s, c in origins:
                entries[s] = (end, self.fold(c))
        return ChunkMap(entries, [chunk])

    def through(self, m: ChunkMap, state: str) -> Entry:
        """Where a state at the start leads, worked out from the texts if the map doesn't list it."""
        if state == self.line_comment and m.texts[0].startswith("\n"):
            state = ""
        if state in m.entries:
            return m.entries[state]
        end, found = state, []
        for text in m.texts:
            if end == self.line_comment and text.startswith("\n"):
                end = ""
            end, c = self.entry(text, end)
            found.append(c)
        m.entries[state] = out = (end, self.fold("".join(found)))
        return out

    def join(self, a: ChunkMap, b: ChunkMap) -> ChunkMap:
        """The map of two runs in a row; associative."""
        out = {}
        for s, (mid, x) in a.entries.items():
            end, y = self.through(b, mid)
            out[s] = (end, self.fold(x + y))
        return ChunkMap(out, a.texts + b.texts)

    def join_all(self, maps: Sequence[ChunkMap]) -> ChunkMap:
        """Neighbours joined pair by pair, as a tree."""
        maps = list(maps)
        while len(maps) > 1:
            maps = [self.join(maps[i], maps[i + 1]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return maps[0]

    def finish(self, folded: str) -> str:
        """The classes of a whole text at its end."""
        return folded

    def accepts(self, end: str, folded: str) -> bool:
        if end and end != self.line_comment or BAD in folded:
            return False
        text = self.tidy(_REPEATS.sub(r"\1\1", self.finish(folded)), "")
        first, *others = self.cut.split(text) if self.cut else [text]
        return self.firsts[first] == "1" and all(self.rests[x] == "1" for x in others)

    def valid(self, text: str) -> bool:
        """Whether a whole text is a program."""
        end, folded = self.entry(self.start(text), "")
        return self.accepts(end, folded)
