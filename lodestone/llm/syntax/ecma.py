"""JavaScript and TypeScript."""

from __future__ import annotations

import re

import regex

from lodestone.llm.syntax.engine import BAD, MARK, Language, Memo, _calls, group, rules

_BLANK = r"(?:[ \t\r\f\v\xa0\ufeff]+|//[^\n\u2028\u2029]*|/\*(?:[^*]|\*(?!/))*\*/)*+"
_WORD = r"(?:[A-Za-z_$\u0080-\U0010ffff]|\\u[0-9A-Fa-f]{4}|\\u\{[0-9A-Fa-f]+\})(?:[\w$\u200c\u200d]|\\u[0-9A-Fa-f]{4}|\\u\{[0-9A-Fa-f]+\})*"
_TEXT = r""""(?:[^"\\\n\r]|\\(?:\r\n|[\s\S]))*"|'(?:[^'\\\n\r]|\\(?:\r\n|[\s\S]))*'"""
_REGEX = r"/(?![*/])(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[A-Za-z]*"
_CUT_REGEX = rf"/(?![*/])(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])*+(?<={MARK})\Z"
_NUMBER = r"0[xX][0-9A-Fa-f_]+n?|0[bB][01_]+n?|0[oO][0-7_]+n?|(?:\d[\d_]*\.?(?:\d[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d+)?n?"
#: Stands before a regular expression that a chunk's end has cut in two.
_CUT = "\ufdd1"
_BEFORE_REGEX = rf"(?:=>|[{_CUT}" r"=(,:;!&|?{}\[+\-*%~^<>]|(?<![\w$.])(?:return|typeof|case|in|of|delete|void|throw|new|else|do|yield|await)(?![\w$]))[ \t\r\n]*"


# a template literal without substitutions; those with some are taken apart by ``Ecma.scan``
_TEMPLATE = r"`(?:[^`\\$]|\\[\s\S]|\$(?!\{))*`"
_OPEN = r""""(?:[^"\\\n\r]|\\[\s\S])*\Z|'(?:[^'\\\n\r]|\\[\s\S])*\Z"""
_TOKEN = (
    rf"{_BLANK}({_BEFORE_REGEX}{_REGEX}|{_BEFORE_REGEX}{_CUT_REGEX}|\n|\?\.(?!\d)[ \t]*#?{_WORD}|\.\.\.|\.(?!\d)[ \t\n]*#?{_WORD}|(?:{_NUMBER})(?![\w$])|#?{_WORD}|{_TEXT}|{_TEMPLATE}"
    rf"|{_OPEN}|`[\s\S]*\Z|/\*[\s\S]*\Z" r"|=>|===|!==|==|!=|\+\+|--|\*\*=?|&&=?|\|\|=?|\?\?=?|\?\.|<<=?|<=|[+\-*/%&|^]=|[\s\S]|\Z)"
)
# most texts hold no regular expression: then a slash is a sign, and words can be tried first
_SLASH = re.compile(r"/(?![*/])")
_MAY_PRECEDE = frozenset(_CUT + "=(,:;!&|?{}[+-*%~^<> \t\r\n")


def _maybe_regex(text: str) -> bool:
    """Whether a slash stands where a regular expression could begin, or a name is written with escapes."""
    return any(text[m.start() - 1] in _MAY_PRECEDE for m in _SLASH.finditer(text)) or "\\u" in text


_QUICK_TOKEN = (
    rf"[ \t\r]*+{_BLANK}([A-Za-z_$][\w$]*+|\n|[()\[\]{{}};,:]|{_TEXT}|\.(?!\d)[ \t\n]*#?{_WORD}|\?\.(?!\d)[ \t]*#?{_WORD}|\.\.\.|(?:{_NUMBER})(?![\w$])|#?{_WORD}|{_TEMPLATE}"
    rf"|{_OPEN}|`[\s\S]*\Z|/\*[\s\S]*\Z" r"|=>|===|!==|==|!=|\+\+|--|\*\*=?|&&=?|\|\|=?|\?\?=?|\?\.|<<=?|<=|[+\-*/%&|^]=|[\s\S]|\Z)"
)

# fixed values: classes of words; any other word is "a"
_WORDS = {
    **dict.fromkeys(("var", "let"), "V"), "const": "\x06", "function": "F", "class": "K", "extends": "X", "import": "M", "export": "G", "default": "D", "return": "R", "throw": "T",
    **dict.fromkeys(("break", "continue"), "B"), "if": "I", "else": "E", "while": "W", "do": "J", "for": "O", "try": "Y", "catch": "C", "finally": "L", "switch": "S", "case": "Z", "new": "N",
    "async": "H", "of": "f", **dict.fromkeys(("in", "instanceof"), "h"), **dict.fromkeys(("get", "set", "static"), "g"), "from": "w", "as": "P", "debugger": "b",
    **dict.fromkeys(("typeof", "void", "delete", "await", "yield"), "U"),
}
_TS_WORDS = _WORDS | {
    **dict.fromkeys(("keyof", "readonly", "infer", "unique", "asserts"), "k"), "is": "j", "type": "y", "interface": "x", "enum": "A", "satisfies": "P", "implements": "c",
    **dict.fromkeys(("namespace", "module", "declare", "abstract"), "2"), **dict.fromkeys(("public", "private", "protected", "override"), "4"),
}
# fixed values: classes of signs
_OPS = {"=>": "z", "=": "=", "+": "p", "-": "p", "*": "m", "!": "u", "~": "u", "++": "i", "--": "i", "?": "q", ":": ":", ",": ",", ";": ";", "...": "e", "<": "l", ">": "r", "|": "v", "&": "n", "@": "@", "\n": "\n", "?.": "Q", _CUT: ""}
_OPS |= {c: c for c in "()[]{}"}
_OPS |= dict.fromkeys(("===", "!==", "==", "!=", "**", "&&", "||", "??", "<<", "<=", "/", "%", "^"), "o")
_OPS |= dict.fromkeys(("+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "**=", "&&=", "||=", "??=", "<<="), "=")

_TYPEARGS = "\x03"
_IDENT = "[aHgfwPkjyx24c]"
_NAME = "[aHgfwPkjyx24cAV\x06FKXMGDRTBIEWOJYCLSZNUhb]"


def _classify(words: dict[str, str]):
    def of(t: str) -> str:
        c = _OPS.get(t) or words.get(t)
        if c is not None:
            return c
        first = t[0]
        if first.isalpha() or first in "_$\\" or first == "#" and len(t) > 1:
            return "a"
        if first.isdigit() or first == "." and len(t) > 1 and t[1].isdigit():
            return "0"
        if first in "\"'":
            return "s" if len(t) > 1 and t[-1] == first and re.fullmatch(_TEXT, t) else "\x01"
        if first == "`":
            return "t" if len(t) > 1 and re.fullmatch(_TEMPLATE, t) else "\x01"
        if t.startswith("/*"):
            return "\x02"
        if m := re.match(_BEFORE_REGEX, t):
            if re.fullmatch(_REGEX, t[m.end() :]):
                return of(m[0].strip()) + "s"
            if t.endswith(MARK):
                return "\x01"
        if len(t) > 1 and first in ".?":
            return "d"
        return BAD

    return of


_SKIPPED = rf"{_BEFORE_REGEX}{_REGEX}|{_TEXT}|//[^\n]*|/\*(?:[^*]|\*(?!/))*\*/"
_SKELETON = re.compile(rf"{_SKIPPED}|(`)")
_IN_HOLE = re.compile(rf"{_SKIPPED}|[`{{}}]")
_IN_TEMPLATE = re.compile(r"\\[\s\S]|`|\$\{")


def _template_end(text: str, at: int) -> tuple[int, list[str], int]:
    """(end of the template that begins at ``at`` or -1, all its substitutions, where the outer unfinished one begins or -1).

    The stack holds, for every substitution around, its open braces, its code so far and where that goes on; a template
    within stands in the code as an empty one, so templates nest to any depth."""
    stack: list[list] = []
    holes, start, inside, at = [], -1, True, at + 1
    while True:
        m = (_IN_TEMPLATE if inside else _IN_HOLE).search(text, at)
        if not m:
            return -1, holes, start if stack else -1
        t, at = m[0], m.end()
        if inside:
            if t == "`":
                if not stack:
                    return at, holes, -1
                stack[-1][2] = at
                inside = False
            elif t == "${":
                if not stack:
                    start = m.start()
                stack.append([0, [], at])
                inside = False
        elif t == "`":
            stack[-1][1] += [text[stack[-1][2] : m.start()], "``"]
            inside = True
        elif t[0] == "{":
            stack[-1][0] += 1
        elif t[0] == "}":
            if stack[-1][0]:
                stack[-1][0] -= 1
            else:
                _, code, last = stack.pop()
                inside, at = True, m.start() + 1
                holes.append("".join(code) + text[last : m.start()])


def _unfinished(classify):
    def leaves(token: str) -> tuple[str, str, str]:
        if token[0] in "\"'":
            return ("", token[0], "") if token.endswith(MARK) else (BAD, "", "")
        if token[0] == "`" or token.startswith("/*"):
            return "", token[0] if token[0] == "`" else "/*", ""
        m = re.match(_BEFORE_REGEX, token)
        return classify(m[0].strip()), _CUT + token[m.end() :], ""

    return leaves


def _grammar(ts: bool) -> str:
    p, s, b = (lambda n: group("(", n)), (lambda n: group("[", n)), (lambda n: group("{", n))
    of, gen = ("(?::<TYPE>)?", "<GEN>?") if ts else ("", "")
    pick = lambda a, x="": a if ts else x
    parts = {
        "ID": _IDENT, "NAME": _NAME,
        "ARGS": p(1), "PARAMS": p(2), "HEAD": p(4), "LIST": s(1), "INDEX": s(2),
        "BLOCK": b(1), "OBJECT": b(2), "BODY": b(4), "CASES": b(8), "SPECS": b(16),
    }
    if ts:
        parts |= {
            "SHAPE": b(32), "ENUM": b(64), "TPAREN": p(8), "TUPLE": s(4), "SIGN": s(8), "GEN": _TYPEARGS,
            "T1": r"(?:<GEN>?<PARAMS>z|N<GEN>?<PARAMS>z)*k*(?:<ID>|[0st\x06]|U<ID>?|p0|<TUPLE>|<SHAPE>|<TPAREN>|M<ARGS>)(?:d|<TUPLE>|<GEN>)*",
            "T2": r"[vn]?<T1>(?:[vn]<T1>)*",
            "TYPE": r"(?:k?<ID>j)?<T2>(?:X<T2>q<TYPE>:<TYPE>)?",
            "TYPEARG": r"k?(?:<ID>X<TYPE>|<TYPE>)(?:=<TYPE>)?",
            "SIG": rf"[kg]*(?:<KEY>)q?(?:{gen}<PARAMS>)?{of}|k?<SIGN>{of}|N?{gen}<PARAMS>{of}",
        }
    parts |= {
        "ARROW": rf"H?(?:{gen}<PARAMS>{of}|<ID>)z",
        "FUNC": rf"H?Fm?<ID>?{gen}<PARAMS>{of}<BLOCK>",
        "BASE": r"(?:X(?:<ID>|<ARGS>)(?:d|<ARGS>|<INDEX>)*" + pick("<GEN>?") + ")?" + pick("(?:c<TYPE>(?:,<TYPE>)*)?"),
        "DECO": r"(?:@(?:<ID>d*|<ARGS>)<ARGS>?\n?)*",
        "CLASS": rf"<DECO>K<ID>?{gen}<BASE><BODY>",
        "PRIM": r"<FUNC>|<CLASS>|<ID>|[0stb]|<ARGS>|<LIST>|<OBJECT>|Md?<ARGS>|Md|Nd",
        "POST": r"d|Q(?:<ARGS>|<INDEX>)|<ARGS>|<INDEX>|t|i" + pick(rf"|<GEN>|u(?!=)|P<TYPE>"),
        "UNIT": r"<ARROW>*(?:(?<=z)<BLOCK>|(?:[upiN]|Um?" + pick("|<GEN>(?!<PARAMS>z)") + r")*(?:(?:<PRIM>)(?:<POST>)*|(?<=U)))",
        "FLAT": r"<UNIT>(?:(?:[o=pmvnhl]|r+=?)<UNIT>)*",
        "EXPR": r"<FLAT>(?:q<EXPR>:<EXPR>)?",
        "EXPRS": r"<EXPR>(?:,<EXPR>)*",
        "END": r"(?:[;\n]|$)",
        "TARGET": r"<ID>|<LIST>|<OBJECT>",
        "BIND": r"(?:<ID>" + pick("u?") + of + r"(?:=<EXPR>)?|(?:<LIST>|<OBJECT>)" + of + "=<EXPR>)",
        "CBIND": r"(?:<TARGET>)" + of + r"=<EXPR>",
        "VAR": r"V<BIND>(?:,<BIND>)*|\x06<CBIND>(?:,<CBIND>)*",
        "KEY": r"<NAME>|[s0]|<INDEX>",
        "PROP": rf"e<EXPR>|(?:[gH]|m|Hm)?(?:<KEY>){gen}<PARAMS>{of}<BLOCK>|(?:<KEY>):<EXPR>|<ID>(?:=<EXPR>)?",
        "PARAM": r"<DECO>" + pick("[4k]*") + r"e?(?:<TARGET>)" + pick("q?") + of + r"(?:=<EXPR>)?",
        "MEMBER": r"<DECO>" + pick("[4kg2]*", "g?") + r"(?:[gH]|m|Hm)?(?:<KEY>)" + pick("[qu]?") + rf"(?:{gen}<PARAMS>{of}(?:<BLOCK>" + pick("|<END>") + rf")|{of}(?:=<EXPR>)?<END>)|g<BLOCK>|[;\n]" + pick(rf"|[kg4]*<SIGN>{of}<END>"),
        "SPEC": pick("y?") + r"(?:<NAME>|s)(?:P(?:<NAME>|s))?",
        "WAY": r"ws(?:a<OBJECT>)?",
        "IMPORT": r"M(?:s|" + pick("y?") + r"(?:<ID>|<SPECS>|mP<ID>|<ID>,(?:<SPECS>|mP<ID>))<WAY>)<END>" + pick(r"|M<ID>=<EXPR><END>"),
        "FUNCDECL": rf"H?Fm?<ID>{gen}<PARAMS>{of}(?:<BLOCK>" + pick("|<END>") + ")",
        "CLASSDECL": r"<DECO>" + pick("[42]*") + rf"K<ID>{gen}<BASE><BODY>",
        "TSDECL": r"2*x<ID><GEN>?(?:X<TYPE>(?:,<TYPE>)*)?<SHAPE>|2*y<ID><GEN>?=<TYPE><END>|[2V\x06]*A<ID><ENUM>|2+(?:<ID>d*|s)<BLOCK>|2(?:(?:<VAR>)<END>|\x06<BIND>(?:,<BIND>)*<END>|<FUNCDECL>)" if ts else "(?!)",
        "DECL": r"<FUNCDECL>|<CLASSDECL>|<TSDECL>|(?:<VAR>)<END>",
        "EXPORT": rf"G(?:D(?:H?Fm?{gen}<PARAMS>{of}<BLOCK>|K<BASE><BODY>|<DECL>|<EXPR><END>)|<DECL>|" + pick("y?") + r"(?:m(?:P<NAME>)?<WAY>|<SPECS>(?:<WAY>)?)<END>" + pick(r"|=<EXPR><END>|\x06<ID>:<TYPE><END>") + ")",
        "PREFIX": r"I<ARGS>\n?|E\n?|W<ARGS>(?=.)\n?|OU?<HEAD>\n?|J\n?|<ID>:\n?",
        "SIMPLE": r"[;\n]|<BLOCK>|<DECL>|<IMPORT>|<EXPORT>|R(?:<EXPRS>)?<END>|T<EXPRS><END>|B<ID>?<END>|Y<BLOCK>\n?(?:C<PARAMS>?<BLOCK>\n?L<BLOCK>|C<PARAMS>?<BLOCK>|L<BLOCK>)|S<ARGS><CASES>|W<ARGS><END>|(?![\ue200-\ue2ff])<EXPRS><END>",
        "STMT": r"(?:<PREFIX>)*(?:<SIMPLE>)",
        "STMTS": r"(?:<STMT>)*+",
    }
    return rules(parts)


_ENDS = "aHgfwPkjyx24c0stdiubBRUDM\x03\ue000-\ue2ff"
_GOES_ON = re.compile(rf"(?<![{_ENDS}])\n+|\n+(?=[=o,.qlrvnhdtz:;w\ue000-\ue1ff]|$)|\n+(?=\n)")
_ANGLES = re.compile(r"l([^lr;\n]*)r")


class Ecma(Language):
    """Line ends count in statement lists, class bodies and type bodies only."""

    loose = (2, 16, 64)

    def scan(self, text: str) -> tuple[str, str]:
        """Code between templates with substitutions is read as usual; every substitution must hold an expression."""
        if "${" not in text or "`" not in text:
            return super().scan(text)
        parts, done, at = [], 0, 0
        while m := _SKELETON.search(text, at):
            at = m.end()
            if m[1] is None:
                continue
            found, end = super().scan(text[done : m.start()])
            if end:
                break
            parts.append(found)
            at, holes, open_ = _template_end(text, m.start())
            parts.append("t" if all(self.holes[h] for h in holes) else BAD)
            if at < 0:
                parts[-1] = parts[-1].replace("t", "")
                return "".join(parts), "`" if open_ < 0 else "`" + text[open_:]
            done = at
        found, end = super().scan(text[done:])
        return "".join(parts) + found, end

    def _hole(self, code: str) -> str:
        found, end = self.scan("(" + code + ")")
        return "1" if not end and found != "()" and re.fullmatch(group("(", 1), self.fold(found)) else ""

    def _fold(self, pair: str) -> str:
        if pair[0] != "{" or "\n" not in pair or BAD in pair:
            return super()._fold(pair)
        inside, bits = pair[1:-1], 0
        strict, loose = self.tidy(inside, "{"), self.tidy(inside.replace("\n", ""), "{")
        for bit, x, signs in self.shape["{"]:
            text = loose if bit in self.loose else strict
            if (not signs or not text or any(c in text for c in signs)) and x.fullmatch(text):
                bits |= bit
        return chr(0xE200 + bits) if bits else BAD


def _make(ts: bool) -> Language:
    grammar = _grammar(ts)
    of = "(?::<TYPE>)?" if ts else ""
    shape = {
        "(": [(1, r"(?:e?<EXPR>(?:,e?<EXPR>)*,?)?"), (2, r"(?:<PARAM>(?:,<PARAM>)*,?)?"), (4, rf"(?:<VAR>|<EXPRS>)?;(?:<EXPRS>)?;(?:<EXPRS>)?|[V\x06](?:<TARGET>){of}[hf]<EXPRS>|<EXPR>f<EXPRS>|<EXPR>", ";fh")],
        "[": [(1, r"(?:e?<EXPR>)?(?:,(?:e?<EXPR>)?)*"), (2, "<EXPRS>")],
        "{": [(1, "<STMTS>"), (2, r"(?:(?:<PROP>)(?:,(?:<PROP>))*,?)?"), (4, r"(?:<MEMBER>)*+"), (8, r"\n*(?:(?:Z<EXPRS>|D):<STMTS>)*+", "ZD"), (16, r"(?:<SPEC>(?:,<SPEC>)*,?)?")],
    }
    if ts:
        shape["("].append((8, "<TYPE>"))
        shape["["] += [(4, r"(?:e?(?:<ID>q?:)?<TYPE>q?(?:,e?(?:<ID>q?:)?<TYPE>q?)*,?)?"), (8, r"<ID>:<TYPE>|<ID>h<TYPE>(?:P<TYPE>)?", ":h")]
        shape["{"] += [(32, r"(?:(?:<SIG>)(?:[;,\n]+(?:<SIG>))*)?[;,\n]*|[pm]?k?<SIGN>[pm]?q?:<TYPE>[;\n]?"), (64, r"(?:(?:<NAME>|s)(?:=<EXPR>)?(?:,(?:<NAME>|s)(?:=<EXPR>)?)*,?)?")]
        typeargs = regex.compile(grammar + _calls(r"(?:<TYPEARG>(?:,<TYPEARG>)*,?)?"), regex.V0)
        is_args = Memo(lambda c: _TYPEARGS if typeargs.fullmatch(c) else "\x04" + c + "\x05")

    def generics(c: str) -> str:
        n = 1
        while n:
            c, n = _ANGLES.subn(lambda m: is_args[m[1]], c)
        return c.replace("\x04", "l").replace("\x05", "r")

    def tidy(c: str, bracket: str) -> str:
        if "\n" in c:
            if bracket in ("(", "["):
                c = c.replace("\n", "")
            else:
                n = 1
                while n:
                    c, n = _GOES_ON.subn("", c)
        return generics(c) if ts and "l" in c and "r" in c else c

    states = {"/*": (r"(?:[^*]|\*(?!/))*\*/(?![ \t]*/[^/*])", ""), "`": (_TEMPLATE[1:], "t")}
    classify = _classify(_TS_WORDS if ts else _WORDS)
    made = Ecma("typescript" if ts else "javascript", _TOKEN, classify, grammar, shape, "<STMTS>", _unfinished(classify), states, tidy, cut=r"(?<=;)(?![EW\n;])|(?<=\n)(?=[V\x06FKGM])", quick=(_maybe_regex, _QUICK_TOKEN))
    made.holes = Memo(made._hole)
    return made


JAVASCRIPT = _make(False)
TYPESCRIPT = _make(True)
