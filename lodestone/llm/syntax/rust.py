"""Rust."""

from __future__ import annotations

import re

import regex

from lodestone.llm.syntax.engine import BAD, Language, Memo, _calls, any_group, group, rules

_NESTED = r"/\*(?:[^*/]|\*(?!/)|/(?!\*)|/\*(?:[^*/]|\*(?!/)|/(?!\*)|/\*(?:[^*/]|\*(?!/)|/(?!\*))*\*/)*\*/)*\*/"
_BLANK = rf"(?:\s+|﻿|//[^\n]*|{_NESTED})*+"
_RAW = "|".join(rf'[bc]?r{"#" * k}"(?:[^"]|"(?!{"#" * k}))*"{"#" * k}' if k else r'[bc]?r"[^"]*"' for k in range(4))
_TOKEN = (
    rf"{_BLANK}({_RAW}|[bc]?r#*\"[\s\S]*\Z|[bc]?\"(?:[^\"\\]|\\[\s\S])*\"|[bc]?\"[\s\S]*\Z|b?'(?:[^'\\\n]|\\(?:x[0-9A-Fa-f]{{2}}|u\{{[0-9A-Fa-f_]+\}}|[^\n]))'|'[^\W\d]\w*(?!')"
    r"|0x[0-9A-Fa-f_]+\w*|0b[01_]+\w*|0o[0-7_]+\w*|\d[\d_]*(?:\.(?![.\w])|\.\d[\d_]*)?(?:[eE][+-]?[\d_]+)?(?:[iuf](?:8|16|32|64|128|size))?(?!\w)|r#[^\W\d]\w*|[^\W\d]\w*"
    r"|/\*[\s\S]*\Z|->|=>|::|\.\.=|\.\.\.|\.\.|&&|\|\||<<=|<=|[=!]=|[+\-*/%^&|]=|[\s\S]|\Z)"
)
# fixed values: classes of words and signs
_WORDS = {
    "use": "M", "mod": "D", "fn": "F", "struct": "S", "enum": "A", "union": "a", "trait": "T", "impl": "X", "type": "y", "const": "c", "static": "c", "let": "V", "mut": "m", "ref": "m", "pub": "P", "if": "I", "else": "E",
    "match": "W", "loop": "L", "while": "Q", "for": "O", "in": "N", "return": "R", "break": "B", "continue": "C", "move": "v", "unsafe": "U", "async": "U", "extern": "K", "where": "w", "as": "Z", "dyn": "d", "crate": "a", "self": "a", "Self": "a", "super": "a", "await": "a",
}
_OPS = {"->": "z", "=>": "j", "::": "q", "..": "t", "..=": "t", "...": "t", "=": "=", "+": "p", "-": "u", "!": "!", "*": "k", "&": "n", "&&": "f", "|": "b", "||": "h", "?": "?", ":": ":", ",": ",", ";": ";", ".": ".", "<": "<", ">": ">", "#": "#", "@": "@", "$": "$", "~": "~"}
_OPS |= {c: c for c in "()[]{}"}
_OPS |= dict.fromkeys(("==", "!=", "<=", "/", "%", "^"), "o")
_OPS |= dict.fromkeys(("+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<="), "=")
_GENERIC = "g"


def _classify(t: str) -> str:
    c = _OPS.get(t) or _WORDS.get(t)
    if c is not None:
        return c
    first = t[0]
    if t.startswith("/*"):
        return "\x02"
    if first == "'":
        return "s" if len(t) > 2 and t.endswith("'") else "l" if len(t) > 1 else BAD
    if '"' in t:
        if re.fullmatch(rf"(?:{_RAW}|[bc]?\"(?:[^\"\\]|\\[\s\S])*\")", t):
            return "s"
        return "\x01"
    if t.startswith(("b'", "c'")):
        return "s"
    if first.isalpha() or first == "_":
        return "a"
    if first.isdigit():
        return "0"
    return BAD


def _unfinished(token: str) -> tuple[str, str, str]:
    """Comments nest to any depth, raw texts end with as many signs as they begin with."""
    if token.startswith("/*"):
        depth = 0
        for m in re.finditer(r"/\*|\*/", token):
            depth += 1 if m[0] == "/*" else -1
            if not depth:
                return "", "", token[m.end() :]
        return "", "/*" * depth, ""
    if m := re.match(r'[bc]?r(#*)"', token):
        end = token.find('"' + m[1], m.end())
        return ("", m[0], "") if end < 0 else ("s", "", token[end + 1 + len(m[1]) :])
    return "", '"', ""


def _make() -> Language:
    p, s, b = (lambda n: group("(", n)), (lambda n: group("[", n)), (lambda n: group("{", n))
    grammar = rules({
        "GEN": _GENERIC,
        "ARGS": p(1), "PARAMS": p(2), "TYPES": p(4), "PATS": p(8), "TUPLE": p(16), "ANYP": any_group("("), "ANYS": any_group("["), "ANYB": any_group("{"),
        "LIST": s(1), "ARRAYTYPE": s(2), "SLICEPAT": s(4),
        "BLOCK": b(1), "FIELDS": b(2), "VARIANTS": b(4), "ITEMS": b(8), "ARMS": b(16), "LITERAL": b(32), "TREE": b(64), "FIELDPAT": b(128),
        "ATTR": r"#!?<ANYS>",
        "PATH": r"(?:q?a<GEN>?|<GEN>)(?:q(?:a<GEN>?|<GEN>|<TYPES>))*(?:<TYPES>(?:z<TYPE>)?)?",
        "SIMPLEPATH": r"(?:q?a|<GEN>)(?:q(?:a|<GEN>))*",
        "BOUND": r"\??(?:O<GEN>)?(?:<PATH>|l|<TYPES>)|~?c<PATH>",
        "BOUNDS": r"(?:<BOUND>)(?:p(?:<BOUND>))*",
        "TYPE": r"(?:[nf]l?m?|k[mc])*(?:d<BOUNDS>|X<BOUNDS>|(?:O<GEN>)?U*(?:Ks?)?F<TYPES>(?:z<TYPE>)?|<PATH>(?:p<BOUNDS>)?|<TYPES>|<ARRAYTYPE>|!|<PATH>!<ANYP>)",
        "GENARG": r"(?:<ATTR>)*(?:l(?::<BOUNDS>|:)?|ca:<TYPE>(?:=(?:0|s|u0|a|<BLOCK>))?|a(?:=<TYPE>|:<BOUNDS>(?:=<TYPE>)?)|<TYPE>(?:=<TYPE>)?|u?0|s|<BLOCK>|<TYPE>Z<PATH>)",
        "MACRO": r"<SIMPLEPATH>!a?(?:<ANYP>|<ANYS>|<ANYB>)",
        "LITPAT": r"u?[0s]|<SIMPLEPATH>",
        "PAT1": r"[nf]*m*(?:m*a@<PAT1>|(?:<LITPAT>)?t(?:<LITPAT>)?|<MACRO>|<SIMPLEPATH>(?:<PATS>|<FIELDPAT>)?|u?[0s]|<PATS>|<SLICEPAT>)",
        "PAT": r"b?<PAT1>(?:b<PAT1>)*",
        "IFX": r"I<COND><BLOCK>(?:E(?:<IFX>|<BLOCK>))?",
        "COND": r"(?:V<PAT>=)?<HEADX>(?:fV<PAT>=<HEADX>)*",
        "BLOCKY": r"<IFX>|W<HEADX><ARMS>|(?:l:)?(?:L<BLOCK>|Q<COND><BLOCK>|O<PAT>N<HEADX><BLOCK>|<BLOCK>)|U+v?<BLOCK>|c<BLOCK>",
        "CLOSURE": r"U?v?(?:h|b(?:<CPARAM>(?:,<CPARAM>)*,?)?b)(?:z<TYPE><BLOCK>|<EXPR>)",
        "CPARAM": r"<PAT1>(?::<TYPE>)?",
        "PRIM": r"<CLOSURE>|<BLOCKY>|<MACRO>|<SIMPLEPATHX><LITERAL>|<SIMPLEPATHX>|[0s]|<ARGS>|<LIST>|R<EXPR>?|Bl?<EXPR>?|Cl?|t<EXPR>?",
        "SIMPLEPATHX": r"(?:q?a|<GEN>)(?:q(?:a|<GEN>))*",
        "HPRIM": r"<CLOSURE>|<BLOCKY>|<MACRO>|<SIMPLEPATHX>|[0s]|<ARGS>|<LIST>|R<HEADX>?|Bl?<HEADX>?|Cl?|t<HEADX>?",
        "POST": r"\.(?:a(?:q<GEN>)?|0)|<ARGS>|<LIST>|\?|Z<TYPE>",
        "PRE": r"[u!k]|[nf](?:m|k[cm])?",
        "BIN": r"[o=pukn]|f|b|h|t(?=[^),\]};])|<+|>+=?",
        "EXPR": r"(?:<PRE>)*(?:<PRIM>)(?:<POST>)*(?:(?:<BIN>)<EXPR>|t)?",
        "HEADX": r"(?:<PRE>)*(?:<HPRIM>)(?:<POST>)*(?:(?:<BIN>)<HEADX>)?",
        "VIS": r"P<ANYP>?",
        "WHERE": r"(?:w(?:(?:l|(?:O<GEN>)?<TYPE>):(?:<BOUNDS>)?(?:,(?:l|(?:O<GEN>)?<TYPE>):(?:<BOUNDS>)?)*,?)?)?",
        "FN": r"[cU]*(?:Ks?)?Fa<GEN>?<PARAMS>(?:z<TYPE>)?<WHERE>(?:<BLOCK>|;)",
        "ITEM": r"(?:<ATTR>)*(?:<VIS>)?(?:<FN>|M<USE>;|Da(?:<ITEMS>|;)|Sa<GEN>?(?:<WHERE><FIELDS>|<ANYP><WHERE>;|;)|Aa<GEN>?<WHERE><VARIANTS>|[U]?Ta<GEN>?(?::<BOUNDS>)?<WHERE><ITEMS>|U?X<GEN>?!?<TYPE>(?:O<TYPE>)?<WHERE><ITEMS>|ya<GEN>?(?::<BOUNDS>)?<WHERE>(?:=<TYPE>)?;|cm?a(?::<TYPE>)?(?:=<EXPR>)?;|Ks?<ITEMS>|Kaa(?:Za)?;|Ka(?:Za)?;|<SIMPLEPATH>!a?(?:<ANYB>|(?:<ANYP>|<ANYS>);))",
        "USE": r"q?(?:a(?:qa)*(?:q(?:k|<TREE>))?|k|<TREE>)(?:Za)?",
        "LET": r"(?:<ATTR>)*V<PAT>(?::<TYPE>)?(?:=<EXPR>(?:E<BLOCK>)?)?;",
        "STMT": r";|<LET>|<ITEM>|(?:<ATTR>)*(?:(?:<BLOCKY>)(?![.?])|<EXPR>;|<MACRO>(?<=[-]))",
        "STMTS": r"(?:#!<ANYS>)*(?:<STMT>)*(?:(?:<ATTR>)*<EXPR>)?",
        "FIELD": r"(?:<ATTR>)*(?:<VIS>)?a:<TYPE>",
        "VARIANT": r"(?:<ATTR>)*(?:<VIS>)?a(?:<ANYP>|<FIELDS>)?(?:=<EXPR>)?",
        "ARM": r"(?:<ATTR>)*<PAT>(?:I(?:<COND>))?j",
    })
    shape = {
        "(": [(1, "(?:(?:<ATTR>)*<EXPR>(?:,(?:<ATTR>)*<EXPR>)*,?)?"), (2, "(?:(?:<ATTR>)*(?:(?:n?l?m?|m)a(?::<TYPE>)?|<PAT1>:<TYPE>|t|<TYPE>)(?:,(?:<ATTR>)*(?:<PAT1>:<TYPE>|t|<TYPE>))*,?)?"), (4, "(?:(?:a:)?<TYPE>(?:,(?:a:)?<TYPE>)*,?)?"), (8, "(?:<PAT>(?:,<PAT>)*,?)?")],
        "[": [(1, "(?:<EXPR>(?:,<EXPR>)*,?|<EXPR>;<EXPR>)?"), (2, "<TYPE>(?:;<EXPR>)?"), (4, "(?:<PAT>(?:,<PAT>)*,?)?")],
        "{": [(1, "<STMTS>"), (2, "(?:<FIELD>(?:,<FIELD>)*,?)?"), (4, "(?:<VARIANT>(?:,<VARIANT>)*,?)?"), (8, "(?:#!<ANYS>)*(?:<ITEM>)*+"), (16, "(?:<ARM>(?:(?:<BLOCKY>),?|<EXPR>(?:,|$)))*"), (32, "(?:(?:<ATTR>)*[a0](?::<EXPR>)?(?:,(?:<ATTR>)*[a0](?::<EXPR>)?)*,?)?(?:(?:^|(?<=,))t<EXPR>?)?"), (64, "(?:<USE>(?:,<USE>)*,?)?"), (128, "(?:(?:[nm]*a(?::<PAT>)?|0:<PAT>)(?:,(?:[nm]*a(?::<PAT>)?|0:<PAT>))*,?)?(?:(?:^|(?<=,))t)?")],
    }
    top = r"(?:#!<ANYS>)*(?:<ITEM>)*+"
    genargs = regex.compile(grammar + _calls(r"(?:<GENARG>(?:,<GENARG>)*,?)?"), regex.V0)
    is_args = Memo(lambda c: _GENERIC if genargs.fullmatch(c) else "\x04" + c + "\x05")
    angle = re.compile(r"(?<=[aqXOgF])<([^<>;]*)>|^<([^<>;]*)>|(?<=[^aqXOg])<([^<>;]*)>(?=q)")

    def generics(c: str, bracket: str) -> str:
        if "<" not in c or ">" not in c:
            return c
        n = 1
        while n:
            c, n = angle.subn(lambda m: is_args[m[0][1:-1]], c)
        return c.replace("\x04", "<").replace("\x05", ">")

    states = {"/*": (r"(?:[^*/]|\*(?!/)|/(?!\*))*\*/", "")}
    return Language("rust", _TOKEN, _classify, grammar, shape, top, _unfinished, states, tidy=generics, trees=True, cut=r"(?<=[;\ue200-\ue2ff])(?=[PFXSATMyDcU#])")


RUST = _make()
