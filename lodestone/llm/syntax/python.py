"""Python: indentation as brackets.

Every line gives a class for its end and one character for the indentation of the next line.  Inside brackets both vanish.
Outside, a line is read by the grammar of statements and becomes one letter; a run of lines at one column is a suite when
the line above it, at a smaller column, is a header that waits for one, and folds into that header.  So a chunk's summary
is a short row of (column, letters), and two summaries in a row fold further where the second one closes what the first
one left open.
"""

from __future__ import annotations

import re

import regex

from lodestone.llm.syntax.engine import BAD, MARK, ChunkMap, Entry, Language, _calls, group, rules

_PREFIX = r"(?:[rR][bBfF]?|[bBfF][rR]?|[uU])"
_LONG = r'"""(?:[^"\\]|\\[\s\S]|"(?!""))*"""|' + r"'''(?:[^'\\]|\\[\s\S]|'(?!''))*'''"
_SHORT = r'"(?:[^"\\\n]|\\[\s\S])*"|' + r"'(?:[^'\\\n]|\\[\s\S])*'"
_NESTED = r"\{(?:[^{}\"'\n]|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|\{[^{}\n]*\})*\}"
_F = r"(?:[fF][rR]?|[rR][fF])(?:" + "|".join(rf"{q}(?!{q}{q})(?:[^{q}\\\n{{}}]|\\[^{{}}]|\{{\{{|\}}\}}|{_NESTED})*{q}" for q in "\"'") + ")"
_INT = r"0[xX](?:_?[0-9a-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+"
_DIGITS = r"\d(?:_?\d)*"
_FLOAT = rf"(?:{_DIGITS}\.(?:{_DIGITS})?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?[jJ]?|{_DIGITS}[eE][+-]?{_DIGITS}[jJ]?|{_DIGITS}[jJ]"
_NUMBER = rf"(?:{_INT}|{_FLOAT}|0(?:_?0)*(?!_?\d)|[1-9](?:_?\d)*)(?:(?=(?:and|else|for|if|in|is|not|or)\b)|(?!\w))"
_BLANK = r"(?:[ \t\f\r]+|\\\r?\n|#[^\n]*)*+"
_TOKEN = (
    rf"{_BLANK}([A-Za-z_]\w*+(?![\"'])|\n(?:[ \t\f\r]*(?:#[^\n]*)?\n)*[ \t\f]*|[()\[\]{{}},]|[:=](?!=)|\.(?:[ \t]|\\\r?\n)*+(?!import\b)[^\W\d]\w*|{_F}|{_PREFIX}?(?:{_LONG}|(?!\"\"\"|''')(?:{_SHORT}))|{_NUMBER}|[^\W\d]\w*(?![\"'])"
    rf"|{_PREFIX}?(?:\"\"\"|''')[\s\S]*\Z|{_PREFIX}?(?:\"(?:[^\"\\\n]|\\[\s\S])*|'(?:[^'\\\n]|\\[\s\S])*)\Z|[^\W\d]\w*|\.\.\.|\*\*=|//=|>>=|<<=|->|:=|[=!<>]=|\*\*|//|<<|>>|[+\-*/%@&|^]=|[\s\S]|\Z)"
)
# fixed values: classes of words and signs
_WORDS = {
    "if": "I", "elif": "E", "else": "L", "while": "W", "for": "O", "in": "N", "try": "Y", "except": "X", "finally": "Z", "with": "H", "as": "P", "def": "D", "class": "C", "return": "R", "raise": "r",
    "pass": "p", "break": "p", "continue": "p", "import": "M", "from": "F", "global": "G", "nonlocal": "G", "del": "d", "assert": "A", "lambda": "l", "yield": "U", "await": "w", "async": "h", "not": "n", "and": "o", "or": "o", "is": "i",
    "match": "m", "case": "c", "type": "t", "None": "0", "True": "0", "False": "0",
}
_OPS = {"+": "+", "-": "+", "~": "~", "*": "*", "**": "k", "/": "/", "@": "@", "|": "|", "=": "=", ":=": "v", "->": "z", ",": ",", ";": ";", ":": ":", ".": ".", "...": "e"}
_OPS |= {c: c for c in "()[]{}"}
_OPS |= dict.fromkeys(("%", "//", "<<", ">>", "&", "^"), "%")
_OPS |= dict.fromkeys(("<", ">", "==", "!=", "<=", ">="), "<")
_OPS |= dict.fromkeys(("+=", "-=", "*=", "/=", "%=", "@=", "&=", "|=", "^=", "**=", "//=", ">>=", "<<="), "q")

_COLUMN = 0xF0000
_LINE = re.compile("\n(.)", re.S)
_FIRST = "\n" + chr(_COLUMN)


def _column(blanks: str) -> str:
    """One character for an indentation: its column with tabs to eight, and with tabs as one."""
    wide = narrow = 0
    for c in blanks:
        if c == "\f":
            wide = narrow = 0
        elif c == "\t":
            wide, narrow = (wide // 8 + 1) * 8, narrow + 1
        else:
            wide, narrow = wide + 1, narrow + 1
    return chr(_COLUMN + min(wide, 255) * 256 + min(narrow, 255))


def _text_class(t: str) -> str:
    """A whole text literal: bytes hold ASCII only, escapes must be right, substitutions must be expressions."""
    at = min(i for i in (t.find('"'), t.find("'")) if i >= 0)
    prefix, body = t[:at].lower(), t[at:]
    q = 3 if body[:3] in ('"""', "'''") and len(body) >= 6 else 1
    inside = body[q:-q]
    if "b" in prefix:
        return "b" if inside.isascii() and ("r" in prefix or "\\" not in inside or not re.search(r"(?:^|[^\\])(?:\\\\)*\\x(?![0-9a-fA-F]{2})", inside)) else BAD
    if "f" in prefix:
        if ("{" in inside or "}" in inside) and not _holes_ok(inside, "r" in prefix):
            return BAD
    elif "r" not in prefix and "\\" in inside and _BAD_ESCAPE.search(inside):
        return BAD
    return "s"


_BAD_ESCAPE = re.compile(r"(?<!\\)(?:\\\\)*\\(?:x(?![0-9a-fA-F]{2})|u(?![0-9a-fA-F]{4})|U(?!00(?:0[0-9a-fA-F]|10)[0-9a-fA-F]{4})|N(?!\{[^}\n]+\}))")
_HOLE_PART = re.compile(rf"{_PREFIX}?(?:{_LONG}|{_SHORT})|[(\[{{}}\])]|!=|[!:=<>]=?|[\s\S]")


def _hole(inside: str, at: int) -> tuple[int, bool]:
    """(end of the substitution that begins before ``at``, whether it is right); -1 when it doesn't end."""
    start, depth, n = at, 0, len(inside)
    while at < n:
        m = _HOLE_PART.match(inside, at)
        t = m[0]
        if t in "([{":
            depth += 1
        elif depth and t in ")]}":
            depth -= 1
        elif not depth and t in ("}", "!", ":", "="):
            code = inside[start:at]
            if t == "=":
                m = re.compile(r"=\s*(?=[}!:])").match(inside, at)
                if not m:
                    at += 1
                    continue
                at = m.end()
                t = inside[at]
            if not _expression(code):
                return at, False
            if t == "!":
                m = re.compile(r"!\s*[rsa]\s*(?=[}:])").match(inside, at)
                if not m:
                    return at, False
                at = m.end()
                t = inside[at]
            if t == ":":
                at += 1
                while at < n and inside[at] != "}":
                    if inside[at] == "{":
                        at, ok = _hole(inside, at + 1)
                        if at < 0 or not ok:
                            return at, False
                    else:
                        at += 1
                if at >= n:
                    return -1, False
            return at + 1, True
        elif t in ")]":
            return at, False
        at = m.end()
    return -1, False


def _holes_ok(inside: str, raw: bool) -> bool:
    at = 0
    while at < len(inside):
        c = inside[at]
        if c == "\\" and not raw:
            m = re.compile(r"\\N\{[^}]*\}|\\[^{}]").match(inside, at)
            at = m.end() if m else at + 1
        elif inside[at : at + 2] in ("{{", "}}"):
            at += 2
        elif c == "}":
            return False
        elif c == "{":
            at, ok = _hole(inside, at + 1)
            if not ok:
                return False
        else:
            at += 1
    return True


def _expression(code: str) -> bool:
    found, end = PYTHON.scan("(" + code.replace("\n", " ") + ")")
    return not end and found != "()" and re.fullmatch(group("(", 2), PYTHON.fold(found)) is not None


def _classify(t: str) -> str:
    c = _OPS.get(t) or _WORDS.get(t)
    if c is not None:
        return c
    first = t[0]
    if first == "\n":
        return "\n" + _column(t.rpartition("\n")[2])
    if t[-1] in "\"'" and len(t) > 1 and not re.fullmatch(rf"{_PREFIX}?(?:\"\"\"|''')(?:[^\"'\\]|\\[\s\S]|\"(?!\"\")|'(?!''))*", t):
        if re.fullmatch(rf"{_F}|{_PREFIX}?(?:{_LONG}|(?!\"\"\"|''')(?:{_SHORT}))", t):
            return _text_class(t)
        return "\x01"
    if "\"" in t or "'" in t:
        return "\x01"
    if first.isalpha() or first == "_" or t.isidentifier():
        return "a" if t.isidentifier() else BAD
    if first == ".":
        name = t[1:].strip(" \t\r\n\\")
        return "0" if name[:1].isdigit() else "x" if _WORDS.get(name, "a") in "amct" and name.isidentifier() else BAD
    if first.isdigit():
        return "0"
    return BAD


_OPENING = re.compile(rf"({_PREFIX}?)(\"\"\"|'''|\"|')")
_OPEN_HOLE = re.compile(r"\{\{|\}\}|\\[^{}]|[{}]")


def _unfinished(token: str) -> tuple[str, str, str]:
    """An unclosed text: only its opening counts for what follows, and in a formatted one the substitution it is in."""
    m = _OPENING.match(token)
    if not m:
        return BAD, "", ""
    if len(m[2]) == 1 and not token.endswith(MARK):
        return BAD, "", ""
    if "f" in m[1].lower():
        body, at = token[m.end() :], 0
        while h := _OPEN_HOLE.search(body, at):
            at = h.end()
            if h[0] == "}":
                return BAD, "", ""
            if h[0] == "{":
                end, ok = _hole(body, at)
                if end < 0:
                    return "", m[0] + body[h.start() :], ""
                if not ok:
                    return BAD, "", ""
                at = end
    return "", m[0], ""


def _grammar() -> str:
    p, s, b = (lambda n: group("(", n)), (lambda n: group("[", n)), (lambda n: group("{", n))
    return rules({
        "NAME": "[amct]", "ARGS": p(1), "PAREN": p(2), "TPAREN": p(4), "PARAMS": p(8), "IMPORTED": p(16), "WITHS": p(32), "PPAREN": p(64), "PARGS": p(128),
        "LIST": s(1), "INDEX": s(2), "TLIST": s(4), "PLIST": s(8), "TYPEPARAMS": s(16), "BRACE": b(1), "PMAP": b(2),
        "STR": "s++|b++",
        "ATOM": "<NAME>|[0e]|<STR>|<PAREN>|<LIST>|<BRACE>",
        "PRIMARY": "w*(?:<ATOM>)(?:x|<ARGS>|<INDEX>)*+",
        "ARITH": "[+~]*<PRIMARY>(?:[+*k/@|%][+~]*<PRIMARY>)*",
        "COMP": "n*<ARITH>(?:(?:<|N|nN|in?)<ARITH>)*",
        "BOOL": "<COMP>(?:o<COMP>)*",
        "LPARAM": "<NAME>(?:=<EXPR>)?",
        "LAMBDA": "l(?:<LPARAMS>)?:<EXPR>",
        "EXPR": "<LAMBDA>|<BOOL>(?:I<BOOL>L(?:<EXPR>))?",
        "NAMED": "<NAME>v(?:<EXPR>)|(?:<EXPR>)(?!v)",
        "STAR": r"\*<ARITH>",
        "SN": "<STAR>|<NAMED>",
        "SE": "<STAR>|<EXPR>",
        "EXPRS": "(?:<SE>)(?:,(?:<SE>))*,?",
        "YIELD": "U(?:F(?:<EXPR>)|<EXPRS>)?",
        "TARGET": r"<TPAREN>(?![xvw]|<ARGS>|<INDEX>)|<TLIST>(?![x]|<ARGS>|<INDEX>)|<SINGLE>",
        "SINGLE": r"(?:<ATOM>)(?:(?:<ARGS>|x|<INDEX>)++(?<=[x\ue100-\ue1ff])|(?<=[amct]))",
        "TARGETS": r"\*?(?:<TARGET>)(?:,\*?(?:<TARGET>))*,?",
        "FOR": "(?:h?O<TARGETS>N<BOOL>(?:I<BOOL>)*)+",
        "P": r"\*(?:<EXPR>)|<NAME>v(?:<EXPR>)|(?:<EXPR>)(?![=v])",
        "KS": r"<NAME>=(?:<EXPR>)|\*(?:<EXPR>)",
        "KD": r"<NAME>=(?:<EXPR>)|k(?:<EXPR>)",
        "SLICE": "(?:<EXPR>)?:(?:<EXPR>)?(?::(?:<EXPR>)?)?|<SN>",
        "PAIR": "(?:<EXPR>):(?:<EXPR>)|k<ARITH>",
        "ND": "<NAME>(?::(?:<EXPR>))?(?!=)",
        "WD": "<NAME>(?::(?:<EXPR>))?=(?:<EXPR>)",
        "STARPART": r"(?:\*<NAME>(?::(?:<SE>))?(?:,(?:<WD>|<ND>))*|\*(?:,(?:<WD>|<ND>))+)(?:,k<ND>)?|k<ND>",
        "PLAIN": r"<ND>(?:,<ND>)*(?:,/)?(?:,<ND>)*(?:,<WD>)*(?:,/)?(?:,<WD>)*|<WD>(?:,<WD>)*(?:,/)?(?:,<WD>)*",
        "LND": "<NAME>(?!=)", "LWD": "<NAME>=(?:<EXPR>)",
        "LSTARPART": r"(?:\*<NAME>(?:,(?:<LWD>|<LND>))*|\*(?:,(?:<LWD>|<LND>))+)(?:,k<LND>)?|k<LND>",
        "LPLAIN": r"<LND>(?:,<LND>)*(?:,/)?(?:,<LND>)*(?:,<LWD>)*(?:,/)?(?:,<LWD>)*|<LWD>(?:,<LWD>)*(?:,/)?(?:,<LWD>)*",
        "LPARAMS": "(?:(?:<LPLAIN>)(?:,(?:<LSTARPART>))?|<LSTARPART>),?",
        "IMPORTNAME": "<NAME>(?:P<NAME>)?",
        "WITH": "(?:<EXPR>)(?:P(?:<TARGET>))?",
        "TYPEPARAM": r"(?:<NAME>(?::(?:<EXPR>))?|\*<NAME>|k<NAME>)(?:=(?:<SE>))?",
        # patterns
        "PAT": "(?:<PAT1>)(?:P<NAME>)?",
        "PAT1": r"(?:<PATOM>)(?:\|(?:<PATOM>))*",
        "PATOM": r"<NAME>x*(?:<PARGS>)?|\+?0(?:\+0)?|<STR>|<PPAREN>|<PLIST>|<PMAP>",
        "SPAT": r"\*<NAME>|<PAT>",
        "PATS": r"(?:<SPAT>),(?:(?:<SPAT>)(?:,(?:<SPAT>))*,?)?|<PAT>",
        # statements
        "ASSIGN": r"(?:<TARGETS>=)*(?:<YIELD>|<EXPRS>)|(?:<SINGLE>|<TPAREN>):(?:<EXPR>)(?:=(?:<YIELD>|<EXPRS>))?|(?:<SINGLE>)q(?:<YIELD>|<EXPRS>)",
        "FROMPATH": "[.e]+<NAME>?x*|[.e]*(?:<NAME>x*|x+)",
        "SIMPLE": r"<ASSIGN>|R(?:<EXPRS>)?|r(?:(?:<EXPR>)(?:F(?:<EXPR>))?)?|p|G<NAME>(?:,<NAME>)*|d(?:<TARGET>)(?:,(?:<TARGET>))*,?|A(?:<EXPR>)(?:,(?:<EXPR>))?|M<NAME>x*(?:P<NAME>)?(?:,<NAME>x*(?:P<NAME>)?)*|F(?:<FROMPATH>)M(?:\*|<IMPORTED>|<IMPORTNAME>(?:,<IMPORTNAME>)*)|t<NAME>(?:<TYPEPARAMS>)?=(?:<EXPR>)",
        "SIMPLES": "(?:<SIMPLE>)(?:;(?:<SIMPLE>))*;?",
    })


# fixed values: letters of statements; capital when complete, small when a header waits for its suite
_HEADS = {
    "D": r"h?D<NAME>(?:<TYPEPARAMS>)?(?:<PARAMS>)(?:z(?:<EXPR>))?:|C<NAME>(?:<TYPEPARAMS>)?(?:<ARGS>)?:", "I": "I<NAMED>:", "E": "E<NAMED>:", "L": "L:", "W": "W<NAMED>:|h?O<TARGETS>N<EXPRS>:",
    "T": "Y:", "X": r"X(?:\*?(?:<EXPR>)(?:P<NAME>)?)?:", "F": "Z:", "S": r"h?H(?:(?:<WITH>)(?:,(?:<WITH>))*|<WITHS>):", "C": "c(?:<PATS>)(?:I<NAMED>)?:",
}
_BY_FIRST = {"D": "D", "C": "D", "h": "DWS", "I": "I", "E": "E", "L": "L", "W": "W", "O": "W", "Y": "T", "X": "X", "Z": "F", "H": "S", "c": "C"}
_SUITE = re.compile(r"(?:S|@*D|IE*L?|WL?|T(?:X+L?F?|F))+")
_DONE = re.compile(r"(?:S|@*D|IE*L?|WL?|T(?:X+L?F?|F))(?=[S@DdIiWwTtMs])")
_WAITING = "dielwtxfscm"


class Python(Language):
    line_comment = "#"

    def __init__(self) -> None:
        grammar = _grammar()
        many = lambda x: f"(?:{x})(?:,(?:{x}))*,?"
        shape = {
            "(": [
                (1, rf"(?:(?:(?:<P>)(?:,(?:<P>))*(?:,(?:<KS>))*(?:,(?:<KD>))*|(?:<KS>)(?:,(?:<KS>))*(?:,(?:<KD>))*|(?:<KD>)(?:,(?:<KD>))*),?|(?:<NAMED>)<FOR>)?"),
                (2, rf"(?:<YIELD>|<NAMED>|(?:<SN>),(?:{many('<SN>')})?|(?:<NAMED>)<FOR>)?"),
                (4, r"(?:<TARGET>|\*?(?:<TARGET>),(?:\*?(?:<TARGET>)(?:,\*?(?:<TARGET>))*,?)?)?"),
                (8, r"(?:(?:(?:<PLAIN>)(?:,(?:<STARPART>))?|<STARPART>),?)?"),
                (16, many("<IMPORTNAME>")), (32, many("<WITH>")), (64, r"(?:<PATS>)?"),
                (128, r"(?:(?:<PAT>)(?:,(?:<PAT>))*(?:,<NAME>=(?:<PAT>))*,?|<NAME>=(?:<PAT>)(?:,<NAME>=(?:<PAT>))*,?)?"),
            ],
            "[": [(1, f"(?:{many('<SN>')}|(?:<NAMED>)<FOR>)?"), (2, many("<SLICE>")), (4, r"(?:\*?(?:<TARGET>)(?:,\*?(?:<TARGET>))*,?)?"), (8, f"(?:{many('<SPAT>')})?"), (16, many("<TYPEPARAM>"))],
            "{": [(1, f"(?:{many('<PAIR>')}|{many('<SN>')}|(?:<EXPR>):(?:<EXPR>)<FOR>|(?:<NAMED>)<FOR>)?"), (2, r"(?:(?:\+?0(?:\+0)?|<STR>|<NAME>x+):(?:<PAT>)(?:,(?:\+?0(?:\+0)?|<STR>|<NAME>x+):(?:<PAT>))*(?:,k<NAME>)?,?|k<NAME>,?)?")],
        }
        states = {'"""': (r'(?:[^"\\]|\\[\s\S]|"(?!""))*"""', "s"), "'''": (r"(?:[^'\\]|\\[\s\S]|'(?!''))*'''", "s")}
        super().__init__("python", _TOKEN, _classify, grammar, shape, "(?:<SIMPLES>)", _unfinished, states)
        self.heads = {k: regex.compile(grammar + _calls(f"(?:{x})((?:<SIMPLES>)?)"), regex.V0) for k, x in _HEADS.items()}
        self.decorator = regex.compile(grammar + _calls("@(?:<NAMED>)"), regex.V0)
        self.matching = regex.compile(grammar + _calls("m(?:(?:<SN>),(?:(?:<SN>)(?:,(?:<SN>))*,?)?|<NAMED>):"), regex.V0)
        self.lines = _Lines(self._statement)

    def start(self, text: str) -> str:
        return "\n" + text

    def _read(self, pair: str) -> str:
        if "\n" in pair:
            return self.folds[_LINE.sub("", pair)]
        return super()._read(pair)

    def _statement(self, line: str) -> str:
        """The letter of a line of classes."""
        if BAD in line:
            return BAD
        first = line[:1]
        if first == "@":
            return "@" if self.decorator.fullmatch(line) else BAD
        for k in _BY_FIRST.get(first, ""):
            if m := self.heads[k].fullmatch(line):
                return k if m[m.re.groups] else k.lower()
        if first == "m" and self.matching.fullmatch(line):
            return "m"
        return "S" if self.top.fullmatch(line) else BAD

    def fold(self, found: str) -> str:
        folded = super().fold(found)
        if folded == BAD or "\n" not in folded:
            return folded
        close, open_ = max(map(folded.rfind, ")]}")) + 1, len(folded)
        for b in "([{":
            if 0 <= (at := folded.find(b, close)) < open_:
                open_ = at
        start = folded.find("\n", close)
        stop = folded.rfind("\n", 0, open_)
        if start < 0 or stop <= start:
            return folded
        lines = self._suites(folded[start:stop])
        return BAD if lines is None else folded[:start] + lines + folded[stop:]

    def _suites(self, text: str) -> str | None:
        """Lines (end, column, classes or letters) with every suite folded that has ended; None if that can't be right."""
        left: list[list] = []
        stack: list[list] = []
        read = self.lines
        pieces = text.split("\n")
        for i in range(1, len(pieces)):
            piece = pieces[i]
            here, line = piece[0], piece[1:]
            if not line:  # only the last line of a chunk, whose code comes next, or nothing but a comment
                continue
            letters = line[1:] if line[0] == "\x06" else read[line]
            if letters == BAD:
                return None
            while True:
                if not stack:
                    stack.append([here, letters])
                    break
                top = stack[-1]
                if here == top[0]:
                    if top[1][-1] in _WAITING:
                        return None
                    top[1] += letters
                    if len(top[1]) > 40:
                        top[1] = re.sub("S{2,}", "S", _DONE.sub("S", top[1]))
                    break
                column, above = ord(here) - _COLUMN, ord(top[0]) - _COLUMN
                if column >> 8 == above >> 8:
                    return None
                if column > above:
                    if top[1][-1] not in _WAITING or (column & 255) <= (above & 255):
                        return None
                    stack.append([here, letters])
                    break
                if not self._close(left, stack):
                    return None
        return "".join(["\n" + c + "\x06" + x for c, x in left + stack])

    def _close(self, left: list[list], stack: list[list]) -> bool:
        """The innermost suite ends."""
        column, letters = stack.pop()
        if letters[-1] in _WAITING:
            return False
        if not stack:
            left.append([column, letters])
            return True
        head = stack[-1][1][-1]
        if head == "m":
            if letters.strip("C"):
                return False
            stack[-1][1] = stack[-1][1][:-1] + "S"
            return True
        if not _SUITE.fullmatch(letters):
            return False
        stack[-1][1] = stack[-1][1][:-1] + head.upper()
        return True

    def entry(self, chunk: str, state: str) -> Entry:
        if "\x00" in chunk:
            return "", BAD
        depth = len(state) - len(state.lstrip("("))
        found, end = self.lex_chunk(chunk, state[depth:])
        return self._at_depth(Language.fold(self, found), end, depth)

    def _at_depth(self, paired: str, end: str, depth: int) -> Entry:
        """A chunk with its brackets paired, as it reads inside ``depth`` open brackets: line ends count outside only."""
        if paired == BAD:
            return end, BAD
        closers = sum(map(paired.count, ")]}"))
        openers = sum(map(paired.count, "([{"))
        if closers > depth:
            return end, BAD
        if depth:
            outside = max(map(paired.rfind, ")]}")) + 1 if closers == depth else len(paired)
            paired = _LINE.sub("", paired[:outside]) + paired[outside:]
        return "(" * (depth - closers + openers) + end, self.fold(paired)

    def summary(self, chunk: str, first: bool = False) -> ChunkMap:
        if first:
            return ChunkMap({"": self.entry(chunk, "")}, [chunk])
        entries = {}
        found, end = self.lex_chunk(chunk, "")
        paired = Language.fold(self, found)
        for depth in (0, 1):
            entries["(" * depth] = self._at_depth(paired, end, depth)
        for s, (way, c) in self.states.items():
            if s not in chunk:  # the text goes on
                entries[s] = (s, "")
            elif m := way.match(chunk):
                before, at = self.lex_chunk(chunk[: m.end()] + MARK, "")
                if at == "" and found.startswith(before):
                    entries[s] = self._at_depth(Language.fold(self, c + found[len(before) :]), end, 0)
                else:
                    entries[s] = self.entry(chunk, s)
        return ChunkMap(entries, [chunk])

    def accepts(self, end: str, folded: str) -> bool:
        if end and end != self.line_comment or BAD in folded:
            return False
        whole = self.fold(_FIRST + "\x06S" + folded + _FIRST + "\x06S" + _FIRST)
        m = re.fullmatch(re.escape(_FIRST) + "\x06(.*)" + re.escape(_FIRST), whole, re.S)
        return m is not None and _SUITE.fullmatch(m[1]) is not None


class _Lines(dict):
    def __init__(self, read) -> None:
        super().__init__()
        self.read = read

    def __missing__(self, line: str) -> str:
        if len(self) > 400_000:
            self.clear()
        c = self.read(line)
        if len(line) < 4000:
            self[line] = c
        return c


PYTHON = Python()
