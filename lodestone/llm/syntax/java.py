"""Java."""

from __future__ import annotations

import re

import regex

from lodestone.llm.syntax.engine import BAD, MARK, Language, Memo, _calls, group, rules

_BLANK = r"(?:\s+|﻿|//[^\n]*|/\*(?:[^*]|\*(?!/))*\*/)*+"
_TOKEN = (
    rf"{_BLANK}(\"\"\"[ \t]*\r?\n(?:[^\"\\]|\\[\s\S]|\"(?!\"\"))*\"\"\"|\"(?!\"\")(?:[^\"\\\n\r]|\\.)*\"|\"\"(?!\")|'(?:[^'\\\n\r]|\\[^\n]+?)'"
    r"|0[xX][0-9A-Fa-f_.]+(?:[pP][+-]?\d+)?[lLfFdD]?|0[bB][01_]+[lL]?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?[lLfFdD]?(?![\w$])|@[ \t]*interface\b|non-sealed\b|[^\W\d][\w$]*|\$[\w$]*"
    r"|\"\"\"[\s\S]*\Z|\"(?:[^\"\\\n\r]|\\.)*\Z|/\*[\s\S]*\Z|->|::|\.\.\.|\+\+|--|&&|\|\||<<=?|[=!<]=|[+\-*/%&|^]=|[\s\S]|\Z)"
)
# fixed values: classes of words and signs
_WORDS = {
    "package": "P", "import": "M", "class": "K", "interface": "K", "enum": "A", "extends": "X", "implements": "X", "permits": "X", "throws": "H", "if": "I", "else": "E", "for": "O", "while": "W", "do": "J",
    "switch": "S", "case": "Z", "default": "D", "try": "Y", "catch": "C", "finally": "L", "return": "R", "throw": "T", "break": "B", "continue": "B", "new": "N", "instanceof": "h", "super": "U", "this": "a", "assert": "Q",
    "yield": "y", "record": "r", "void": "v", "synchronized": "G",
    **dict.fromkeys(("public", "private", "protected", "static", "abstract", "native", "transient", "volatile", "strictfp", "sealed", "non-sealed"), "m"), "final": "m",
    **dict.fromkeys(("int", "long", "short", "byte", "char", "boolean", "float", "double"), "b"),
}
_OPS = {"->": "z", "::": "q", "...": "e", "=": "=", "+": "p", "-": "p", "!": "u", "~": "u", "++": "i", "--": "i", "?": "?", ":": ":", ",": ",", ";": ";", ".": ".", "<": "<", ">": ">", "&": "n", "@": "@", "*": "k"}
_OPS |= {c: c for c in "()[]{}"}
_OPS |= dict.fromkeys(("==", "!=", "<=", "&&", "||", "/", "%", "^", "|", "<<"), "o")
_OPS |= dict.fromkeys(("+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<="), "=")
_GENERIC = "g"


def _classify(t: str) -> str:
    c = _OPS.get(t) or _WORDS.get(t)
    if c is not None:
        return c
    first = t[0]
    if first.isalpha() or first in "_$":
        return "a"
    if first.isdigit() or first == "." and len(t) > 1:
        return "0"
    if t.startswith('"""') and (len(t) < 6 or not t.endswith('"""')):
        return "\x01"
    if first in "\"'" and len(t) > 1 and t[-1] == first and not (first == '"' and t.endswith('\\"') and not t.startswith('"""') and not re.fullmatch(r'"(?:[^"\\]|\\.)*"', t)):
        return "s"
    if first == '"':
        return "\x01"
    if first == "@":
        return "@K"
    if t.startswith("/*"):
        return "\x02"
    return BAD


def _unfinished(token: str) -> tuple[str, str, str]:
    if token.startswith('"""'):
        return ("", '"""\n', "") if re.match(rf'"""[ \t]*\r?(?:\n|{MARK}|\Z)', token) else (BAD, "", "")
    if token[0] == '"':
        return ("", '"', "") if token.endswith(MARK) else (BAD, "", "")
    return "", "/*", ""


def _make() -> Language:
    p, s, b = (lambda n: group("(", n)), (lambda n: group("[", n)), (lambda n: group("{", n))
    id_ = "[arymU]".replace("m", "")
    grammar = rules({
        "ID": "[ary]", "GEN": _GENERIC,
        "ARGS": p(1), "PARAMS": p(2), "HEAD": p(4), "RESOURCES": p(8), "CAST": p(16), "CATCH": p(32), "NOTE": p(64), "INDEX": s(1), "EMPTY": s(2),
        "BLOCK": b(1), "BODY": b(2), "VALUES": b(4), "CASES": b(8), "CONSTANTS": b(16),
        "ANN": r"@<ID>(?:\.<ID>)*(?:<NOTE>|<ARGS>)?",
        "TYPE": r"(?:<ANN>)*(?:(?:<ID><GEN>?(?:\.<ID><GEN>?)*|b)(?:<EMPTY>)*|v)",
        "TYPES": r"<TYPE>(?:,<TYPE>)*",
        "BOUND": r"<TYPE>(?:n<TYPE>)*",
        "TYPEARG": r"(?:<ANN>)*(?:\?(?:[XU]<BOUND>)?|<ID>X<BOUND>|<BOUND>)",
        "NEW": r"N<GEN>?<TYPE>(?:<ARGS><BODY>?|(?:<INDEX>)+(?:<EMPTY>)*|<VALUES>)|N<ID><GEN>?(?:\.<ID><GEN>?)*(?:<INDEX>)*(?:<EMPTY>)*<VALUES>?",
        "PRIM": r"<NEW>|S<ARGS><CASES>|[0s]|<TYPE>\.K|(?:<TYPE>)q(?:<ID>|N)|<ID>|U|<ARGS>",
        "POST": r"\.(?:<GEN>?<ID>|U|<NEW>)|<ARGS>|<INDEX>|i|q(?:<ID>|N)",
        "PRE": r"[pui]|<CAST>(?=[arySNU0su@vb-])|<CAST>[pui]",
        "UNIT": r"(?:(?:<ID>|<PARAMS>)z)+(?:<BLOCK>|<EXPR>)|(?:<PRE>)*(?:<PRIM>)(?:<POST>)*",
        "TEST": r"hm?<TYPE>(?:<ID>|<PARAMS><ID>?)?",
        "EXPR": r"(?:<UNIT>)(?:<TEST>)?(?:(?:[o=pkn<]|>+=?)(?:<UNIT>)(?:<TEST>)?)*(?:\?<EXPR>:<EXPR>)?",
        "EXPRS": r"<EXPR>(?:,<EXPR>)*",
        "INIT": r"(?:<EXPR>|<VALUES>)",
        "VARS": r"<ID>(?:<EMPTY>)*(?:=<INIT>)?(?:,<ID>(?:<EMPTY>)*(?:=<INIT>)?)*",
        "LOCAL": r"(?:m|<ANN>)*<TYPE><VARS>",
        "MODS": r"(?:m|D|G|<ANN>)*",
        "TYPEDECL": r"<MODS>(?:K<ID><GEN>?(?:X<TYPES>)*<BODY>|@K<ID><BODY>|A<ID>(?:X<TYPES>)?<CONSTANTS>|r<ID><GEN>?<PARAMS>(?:X<TYPES>)?<BODY>)",
        "STMT": r"<BLOCK>|;|I<ARGS><STMT>(?:E<STMT>)?|O<HEAD><STMT>|W<ARGS><STMT>|J<STMT>W<ARGS>;|S<ARGS><CASES>|Y(?:<RESOURCES><BLOCK>(?:C<CATCH><BLOCK>)*(?:L<BLOCK>)?|<BLOCK>(?:(?:C<CATCH><BLOCK>)+(?:L<BLOCK>)?|L<BLOCK>))|G<ARGS><BLOCK>|R<EXPR>?;|T<EXPR>;|y<EXPR>;|B<ID>?;|Q<EXPR>(?::<EXPR>)?;|<TYPEDECL>|<ID>:<STMT>|<LOCAL>;|<EXPR>;",
        "STMTS": r"(?:<STMT>)*+",
        "PARAM": r"(?:m|<ANN>)*<TYPE>(?:<ANN>)*e?(?:<ID>\.)?<ID>(?:<EMPTY>)*|<ID>",
        "MEMBER": r"<TYPEDECL>|m*<BLOCK>|;|<MODS><GEN>?(?:<TYPE><ID><PARAMS>(?:<EMPTY>)*(?:H<TYPES>)?(?:<BLOCK>|;|D<INIT>;|D<ANN>;)|<ID><PARAMS>?(?:H<TYPES>)?<BLOCK>|<TYPE><VARS>;)",
        "CONSTANT": r"(?:<ANN>)*<ID><ARGS>?<BODY>?",
        "PATTERN": r"m?<TYPE><ID>|<TYPE><PARAMS><ID>?",
        "LABELS": r"Z(?:<EXPRS>|<EXPR>|<PATTERN>)(?:,D)?|D|Z<TYPE><ID>n*",
    })
    del id_
    shape = {
        "(": [(1, "(?:<EXPRS>)?"), (2, "(?:<PARAM>(?:,<PARAM>)*)?"), (4, "(?:<LOCAL>|<EXPRS>)?;<EXPR>?;<EXPRS>?|(?:m|<ANN>)*<TYPE><ID>:<EXPR>", ";:"), (8, "(?:<LOCAL>|<EXPR>)(?:;(?:<LOCAL>|<EXPR>))*;?"), (16, "<TYPE>(?:n<TYPE>)*"), (32, "(?:m|<ANN>)*<TYPE>(?:o<TYPE>)*<ID>"), (64, "(?:<ID>=(?:<INIT>|<ANN>)(?:,<ID>=(?:<INIT>|<ANN>))*|<INIT>|<ANN>)?")],
        "[": [(1, "<EXPR>"), (2, "")],
        "{": [(1, "<STMTS>"), (2, "(?:<MEMBER>)*+"), (4, "(?:(?:<INIT>|<ANN>)(?:,(?:<INIT>|<ANN>))*)?,?"), (8, "(?:(?:<LABELS>)(?::<STMTS>|z(?:<BLOCK>|<EXPR>;|T<EXPR>;)))*", "ZD"), (16, "(?:<CONSTANT>(?:,<CONSTANT>)*)?,?(?:;(?:<MEMBER>)*+)?")],
    }
    top = r"(?:(?:<ANN>)*P<ID>(?:\.<ID>)*;|;)?(?:Mm?<ID>(?:\.<ID>)*(?:\.k)?;|;)*(?:<TYPEDECL>|;)*+"
    typeargs = regex.compile(grammar + _calls(r"(?:<TYPEARG>(?:,<TYPEARG>)*)?"), regex.V0)
    is_args = Memo(lambda c: _GENERIC if typeargs.fullmatch(c) else "\x04" + c + "\x05")
    angle = re.compile(r"<([^<>;]*)>")

    def generics(c: str, bracket: str) -> str:
        if "<" not in c or ">" not in c:
            return c
        n = 1
        while n:
            c, n = angle.subn(lambda m: is_args[m[1]], c)
        return c.replace("\x04", "<").replace("\x05", ">")

    states = {"/*": (r"(?:[^*]|\*(?!/))*\*/", ""), '"""' + "\n": (r"(?:[^\"\\]|\\[\s\S]|\"(?!\"\"))*\"\"\"", "s")}
    return Language("java", _TOKEN, _classify, grammar, shape, top, _unfinished, states, tidy=generics)


JAVA = _make()
