"""Go."""

from __future__ import annotations

import re

from lodestone.llm.syntax.engine import BAD, MARK, Language, group, rules

_BLANK = r"(?:[ \t\r﻿]+|//[^\n]*)*+"
_TOKEN = (
    rf"{_BLANK}(\n|/\*(?:[^*]|\*(?!/))*\*/|\.[ \t\n]*[^\W\d]\w*|\.\.\.|0[xX][0-9A-Fa-f_]+|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eEpP][+-]?\d+)?i?(?!\w)|[^\W\d]\w*"
    r"|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\[^\n]+?)'|`[^`]*`|\"(?:[^\"\\\n]|\\.)*\Z|`[\s\S]*\Z|/\*[\s\S]*\Z|:=|<-|\+\+|--|&&|\|\||&\^=?|<<=?|>>=?|[=!<>]=|[+\-*/%&|^]=|[\s\S]|\Z)"
)
# fixed values: classes of words and signs
_WORDS = {
    "package": "P", "import": "M", "func": "F", "var": "V", "const": "c", "type": "y", "struct": "S", "interface": "x", "map": "m", "chan": "h", "if": "I", "else": "E", "for": "O", "range": "R",
    "switch": "W", "case": "Z", "default": "D", "select": "L", "return": "T", "go": "G", "defer": "G", "break": "B", "continue": "B", "goto": "B", "fallthrough": "f",
}
_OPS = {":=": "~", "=": "=", "+": "p", "-": "p", "^": "p", "*": "k", "&": "n", "!": "u", "<-": "w", "++": "i", "--": "i", "...": "e", ".": ".", ",": ",", ";": ";", ":": ":", "~": "t", "\n": "\n"}
_OPS |= {c: c for c in "()[]{}"}
_OPS |= dict.fromkeys(("==", "!=", "<=", ">=", "<", ">", "&&", "||", "/", "%", "<<", ">>", "&^", "|"), "o")
_OPS |= dict.fromkeys(("+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", ">>=", "&^="), "=")


def _classify(t: str) -> str:
    c = _OPS.get(t) or _WORDS.get(t)
    if c is not None:
        return c
    first = t[0]
    if first.isalpha() or first == "_":
        return "a"
    if first.isdigit():
        return "0"
    if first == ".":
        return "0" if t[1:2].isdigit() else "d"
    if first in "\"'`" and len(t) > 1 and t[-1] == first and not (first == '"' and t.endswith('\\"') and not re.fullmatch(_TEXT, t)):
        return "s"
    if first in "`\"":
        return "\x01"
    if t.startswith("/*"):
        return "\x02" if len(t) < 4 or not t.endswith("*/") else "\n" if "\n" in t else ""
    return BAD


_TEXT = r"\"(?:[^\"\\\n]|\\.)*\""
_LINE_END = re.compile(r"(?<=[a0sdBfTi)\]}\ue000-\ue2ff])\n+")


def _semicolons(c: str) -> str:
    """The language's own rule: a line that ends in an operand ends a statement.  A line end at the very beginning stays,
    since what it ends is not known."""
    if "\n" not in c:
        return c
    lead = "\n" if c[0] == "\n" else ""
    return lead + _LINE_END.sub(";", c.lstrip("\n")).replace("\n", "")


def _unfinished(token: str) -> tuple[str, str, str]:
    if token[0] == '"':
        return ("", '"', "") if token.endswith(MARK) else (BAD, "", "")
    return "", "`" if token[0] == "`" else "/*", ""


class Go(Language):
    def finish(self, folded: str) -> str:
        return _semicolons(folded + "\n").lstrip("\n")


def _make() -> Language:
    p, s, b = (lambda n: group("(", n)), (lambda n: group("[", n)), (lambda n: group("{", n))
    grammar = rules({
        "ARGS": p(1), "PARAMS": p(2), "SPECS": p(4), "ASK": p(8 | 2), "INDEX": s(1), "SQUARE": s(7), "GENERIC": s(4),
        "BLOCK": b(1), "FIELDS": b(2), "METHODS": b(4), "VALUES": b(8), "CASES": b(16),
        "TYPE": "k*(?:ad?<SQUARE>?|<SQUARE><TYPE>|m<SQUARE><TYPE>|hw?<TYPE>|wh<TYPE>|F<PARAMS><RESULT>?|S<FIELDS>|x<METHODS>|<PARAMS>)",
        "RESULT": "(?:<TYPE>|<PARAMS>)",
        "LITTYPE": "<SQUARE><TYPE>|m<SQUARE><TYPE>|hw?<TYPE>|S<FIELDS>|x<METHODS>|F<PARAMS><RESULT>?",
        "PRIM": "F<PARAMS><RESULT>?<BLOCK>|(?:<LITTYPE>)<VALUES>|[a0s]|<ARGS>|<LITTYPE>",
        "POST": r"d|\.<ASK>|<SQUARE>|<ARGS>",
        "UNARY": "[pukwn]*",
        "EXPR": "<UNARY>(?:<PRIM>)(?:<POST>|<VALUES>)*(?:[opknw]<EXPR>)?",
        "HEADX": "<UNARY>(?:<PRIM>)(?:<POST>)*(?:[opknw]<HEADX>)?",
        "EXPRS": "<EXPR>(?:,<EXPR>)*",
        "HEADS": "<HEADX>(?:,<HEADX>)*",
        "SIMPLE": "<EXPRS>(?:[~=]<EXPRS>|i)?",
        "HEAD": "<HEADS>(?:[~=]<HEADS>|i)?",
        "SPEC": "a(?:,a)*<TYPE>?(?:=<EXPRS>)?",
        "VARSPEC": "a(?:,a)*(?:<TYPE>(?:=<EXPRS>)?|=<EXPRS>)",
        "CONSTSPEC": "a(?:,a)*<TYPE>?=<EXPRS>",
        "TYPESPEC": "a<GENERIC>?=?<TYPE>",
        "IMPORTSPEC": r"[a.]?s",
        "IF": "I(?:<HEAD>?;)?<HEADX><BLOCK>(?:E(?:<IF>|<BLOCK>))?",
        "FOR": "O(?:<HEAD>?;<HEADX>?;<HEAD>?|(?:<HEADS>[~=])?R<HEADX>|<HEADX>)?<BLOCK>",
        "SWITCH": "W(?:<HEAD>?;)?(?:<HEAD>)?<CASES>|L<CASES>",
        "DECL": "V(?:<VARSPEC>|<SPECS>)|c(?:<CONSTSPEC>|<SPECS>)|y(?:<TYPESPEC>|<SPECS>)",
        "STMT": "<BLOCK>|<IF>|<FOR>|<SWITCH>|<DECL>|T<EXPRS>?|G<EXPR>|Ba?|f|a:<STMT>|<SIMPLE>|",
        "STMTS": "(?:<STMT>)(?:;(?:<STMT>))*",
        "FUNC": "F<PARAMS>?a<GENERIC>?<PARAMS><RESULT>?<BLOCK>?",
        "FIELD": "a(?:,a)*<TYPE>s?|k?ad?<SQUARE>?s?|",
        "METHOD": "a<PARAMS><RESULT>?|t?<TYPE>(?:ot?<TYPE>)*|",
        "PARAM": "a?e?<TYPE>",
    })
    shape = {
        "(": [(1, "(?:<EXPR>(?:,<EXPR>)*e?,?)?"), (2, "(?:<PARAM>(?:,<PARAM>)*,?)?"), (4, "(?:(?:<IMPORTSPEC>|<SPEC>|<TYPESPEC>|);)*(?:<IMPORTSPEC>|<SPEC>|<TYPESPEC>|)"), (8, "y")],
        "[": [(1, "<EXPR>|<EXPR>?:<EXPR>?(?::<EXPR>)?"), (2, "(?:e|<EXPR>|<TYPE>(?:,<TYPE>)*,?)?"), (4, "(?:a(?:,a)*(?:t?<TYPE>(?:ot?<TYPE>)*))(?:,a(?:,a)*(?:t?<TYPE>(?:ot?<TYPE>)*))*,?")],
        "{": [(1, "<STMTS>"), (2, "(?:<FIELD>)(?:;(?:<FIELD>))*"), (4, "(?:<METHOD>)(?:;(?:<METHOD>))*"), (8, "(?:(?:<EXPR>|<VALUES>)(?::(?:<EXPR>|<VALUES>))?(?:,(?:<EXPR>|<VALUES>)(?::(?:<EXPR>|<VALUES>))?)*,?)?"), (16, "(?:(?:Z(?:<SIMPLE>)|D):<STMTS>)*")],
    }
    top = "Pa;(?:M(?:<IMPORTSPEC>|<SPECS>);)*(?:(?:<FUNC>|<DECL>)?;)*"
    return Go("go", _TOKEN, _classify, grammar, shape, top, _unfinished, {"/*": (r"(?:[^*]|\*(?!/))*\*/", ""), "`": (r"[^`]*`", "s")}, settle=_semicolons, cut=r"(?<=;)(?=[FVcy])", rest="(?:(?:<FUNC>|<DECL>)?;)*")


GO = _make()
