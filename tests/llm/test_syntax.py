"""Valid and invalid programs of every language, chunk by chunk equal to whole."""

import ast
import random
import time
import warnings

import pytest

from lodestone.llm.parsecheck import chunks, parse_files, parses
from lodestone.llm.syntax.languages import LEXED, body, valid

GOOD = {
    "python": ["", "x = 1\n", "\ufeffdef f(a, /, *, b=1) -> int:\n    return a\n", "match x:\n    case [a, *_]:\n        pass\n", 's = """\n<<<<<<< ours\n"""\n'],
    "javascript": [
        "", "// only\n", "const a = 1\nlet b = a ?? 2, c = `x${ b ? `(${a}` : '}' }`;\n", "export default async function* f({ a, ...r } = {}, [x, , y]) { yield* g(r); }\n", "if (a) b(); else { c() }\nfor (const [k, v] of Object.entries(o)) { continue }\n",
        "class A extends B { #p = 1; static { x() } get v() { return this.#p } async *m() {} }\n", "label: for (;;) { break label }\nconst re = /[/\\]}]/g.test(s) / 2\n", "#!/usr/bin/env node\nimport x, { y as z } from './m.mjs'\nexport * from 'q';\n", "do { i++ } while (i < 3)\ntry { a } catch { b } finally { c }\nswitch (x) { case 1: case 'a': y(); break; default: z }\n",
        "const f = async (a, b = 2) => ({ ...a, [b]: 1, get c() { return 1 } });\n!function () {}();\n",
    ],
    "typescript": [
        "", "interface A<T extends object = {}> extends B, C<T> { readonly a?: string; [k: string]: unknown; (x: number): void; m?<U>(u: U): U }\n", "declare const q: number;\nexport const enum Z { A }\nfor (const a of b) c(a);\n", "type U = | 'a' | 1 | { [K in keyof T]?: T[K] } | (new () => X)[];\n", "export abstract class A<T> implements I<T>, J { private readonly x: Map<string, T[]> = new Map(); constructor(public a: string, b?: number) { super() } abstract m(): void; get v(): T | undefined { return this.x!.get('k') as T } }\n",
        "enum E { A = 1, B = 'x', }\ndeclare module 'm' { export const x: number }\nfunction isA(x: unknown): x is A { return a < b && c > d }\nexport const F = { a: /x/ } as const;\nimport type { T } from './t';\nconst f = <T,>(x: T): Promise<Array<[T, number]>> => g<T>(x);\n",
    ],
    "go": ["package a\n", "package a\n\nimport (\n\t\"fmt\"\n\tx \"y\"\n)\n\nvar _ = map[string][]int{\"a\": {1, 2}, \"b\": nil}\n\ntype T[K comparable, V any] struct {\n\tA, B int `json:\"a\"`\n\t*E\n}\n\nfunc (t *T[K, V]) F(a int, bs ...string) (n int, err error) {\n\tfor i := range bs {\n\t\tif v, ok := t.m[i]; ok && v > 1 {\n\t\t\tcontinue\n\t\t} else if !ok {\n\t\t\tgo func() { defer close(c) }()\n\t\t}\n\t}\n\tswitch x := y.(type) {\n\tcase int, *T:\n\t\tfallthrough\n\tdefault:\n\t}\n\tselect {\n\tcase v := <-ch:\n\t\tch <- v\n\t}\n\treturn a<<1 &^ 2, nil\n}\n"],
    "java": ["", "package a.b;\nimport static java.util.List.*;\n@Note(x = {1, 2}) public sealed class A<T extends B & C> extends D<T> implements E permits F {\n  private static final int[] X = {1, 2,};\n  static { y(); }\n  A() { super(); }\n  <U> Map<String, List<? super U>> m(final int a, String... s) throws IOException {\n    int[][] g = new int[3][];\n    for (var x : s) if (x instanceof String t && t.length() > 1) break; else continue;\n    Runnable r = () -> { return; };\n    List<String> l = s.map(String::trim).toList();\n    String b = switch (a) { case 1, 2 -> \"x\"; default -> { yield \"\"\"\n      <<<<<<< HEAD\n      \"\"\"; } };\n    try (var in = open(); in) { a = (int) b + (T) c; } catch (A | B e) { throw e; } finally { }\n    return a > b ? x : y >> 2;\n  }\n  enum K { P, Q(1) { void z() {} }; K() {} }\n  record R(int a, String b) {}\n  @interface N { int v() default 1; }\n}\n"],
    "rust": ["", "#![allow(x)]\nuse std::{io::{self, Read}, fmt as f};\n/* a /* b */ c */\n#[derive(Debug)]\npub struct S<'a, T: Clone + 'a, const N: usize = 3> where T: Copy { pub a: &'a [T; N], b: Option<Box<dyn Fn(i32) -> u8 + Send>> }\nenum E { A, B(u8, String), C { x: i32 } = 3 }\nimpl<T> Tr for S<'_, T, 2> { type O = T; const K: u8 = b'x'; fn f(&mut self, x: impl Into<u8>) -> Result<(), E> { let Some(y) = x.get::<u8>()? else { return Err(E::A) }; for (i, v) in (0..10).enumerate() { if let E::C { x, .. } = v { continue } else { break 'l } } match y { 0 | 1..=5 if y > 2 => {} ref z @ 3 => (), _ => println!(\"{}\", r#\"a\"b\"#), } let c = move |a: u8, _| -> u8 { a }; Ok(()) } }\nmacro_rules! m { ($x:expr) => { $x + 1 }; }\npub(crate) async unsafe fn g() -> ! { loop {} }\n"],
}
BAD = {
    "python": ["def (:\n", "x = (\n", "<<<<<<< HEAD\nx = 1\n", "  x\n y\n", "x = 1\0"],
    "javascript": ["const x =\n", "const x\n", "function f( {\n", "import { a\n", "}\n", "<<<<<<< HEAD\na()\n=======\n", "package org.a.b;\n", "[section]\nname = shared lease\n", "{\"a\": 1}\n", "const s = 'open\n", "/* open", "let x: number = 1;\n", "export\n", "x = `a${ b\n"],
    "typescript": ["const x: Map<string,\n", "const x: T\n", "interface A {\n", "type X =\n", "/** open\n", "import os\nimport sys\n"],
    "go": ["", "// only\n", "package a.b\n", "package a\nfunc f( {\n", "package a\nvar x =\n", "package a\nvar x\n", "package a\nconst x\n", "package a\ntype T struct\n", "package a\n>>>>>>> x\n", "package a\nx := 1\n"],
    "java": ["class A {\n", "class A { void m() { int } }\n", "class A { String s = \"open; }\n", "version 1\n", "class A {}\n}\n", "class A { =======\n }\n", "public\n"],
    "rust": ["fn f() -> u8\n", "fn f() { \"open }\n", "let x = 1;\n", "pub\n", "struct S { a: u8, b }\nfn\n", "/* /* */\n", "<<<<<<< a\n", "fn f() { match x { 1 => } }\n"],
}


@pytest.mark.parametrize("language", GOOD)
def test_valid(language):
    assert [t for t in GOOD[language] if not valid(t, language)] == []


@pytest.mark.parametrize("language", BAD)
def test_invalid(language):
    assert [t for t in BAD[language] if valid(t, language)] == []


PYTHON = """# -*- coding: utf-8 -*-
from . import a, b as c
from .x import (y, z as q,)
import os.path as p


@cache(1, *a, k=2, **b)
class A(B, metaclass=M):
    'text'
    x: int = 3

    async def f(self, a, /, b: list[int] = [1], *c, d, e=1, **g) -> None:
        async with open(a) as f, b as (c, d):
            await f.read(1)[2:3, ::4] ** -x
        async for i, *j in k:
            yield
        else:
            pass
        return lambda x, *y, z=1: x if y else not z

    if x: y = 1; z = 2
    elif (n := len(a)) > 10 and not b in c is not d:
        del a[0], b.c
    else:
        raise X(1) from None
try:
    a = b = {**c, 'k': 1, f'{x!r:>{w}} {y["a"]}': {i: j for i in a for j in b if j}}
except (A, B) as e:
    global g
    assert a, "m"
finally:
    a += yield_
with (open(a) as f, b):
    print(f'''  # noqa
    x
    ''', *a, sep=b"x" b"y") \\
        .z
match a:
    case [1, *_] | {"k": v, **r} if v:
        pass
    case P(x=0) as p: pass
while 1:
	if x:
		break
"""  # fmt: skip


@pytest.mark.parametrize("language", GOOD)
@pytest.mark.parametrize("size", [3, 8, 40])
def test_chunk_maps_join_in_any_grouping(language, size):
    lang = LEXED[language]
    for text in GOOD[language] + BAD[language] + ([PYTHON] if language == "python" else []):
        text = lang.start(body(text, language))
        pieces = [lang.summary(c) for c in chunks(text, size)]
        left = pieces[0]
        for p in pieces[1:]:
            left = lang.join(left, p)
        right = pieces[-1]
        for p in reversed(pieces[:-1]):
            right = lang.join(p, right)
        tree = lang.join_all(pieces)
        whole = lang.entry(text, "")
        assert lang.accepts(*left.entries[""]) == lang.accepts(*right.entries[""]) == lang.accepts(*tree.entries[""]) == lang.accepts(*whole), text


def test_python_against_its_compiler():
    r = random.Random(1)
    texts = [PYTHON, PYTHON.replace("    ", "  ")]
    for _ in range(1500):
        t = r.choice(texts[:2])
        i = r.randrange(len(t))
        j = i + r.randrange(12)
        texts.append(r.choice((t[:i], t[i:], t[:i] + t[j:], t[:i] + r.choice("()[]{}:,.=*'\"\n \t@if0") + t[j:])))
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        for t in texts:
            try:
                compile(t, "f", "exec", ast.PyCF_ONLY_AST, dont_inherit=True)
                want = True
            except (SyntaxError, ValueError):
                want = False
            for size in (30, 2048):
                assert parses(t, "python", size)[0] == want, t


@pytest.mark.parametrize("language,text", [("javascript", "x = " + "[" * 100_000 + "]" * 100_000 + ";\n"), ("python", "x = " + "(" * 100_000 + ")" * 100_000), ("python", "-" * 100_000 + "x"), ("javascript", "a = " + "`${" * 3000 + "1" + "}`" * 3000), ("rust", "/*" * 5000 + "*/" * 5000), ("java", "class A {" + "int a = 1;" * 50_000 + "}"), ("javascript", "var a=[" + "1," * 200_000 + "]")])
def test_deep_and_long_texts(language, text):
    began = time.perf_counter()
    assert parses(text, language)[0] and not parses(text + "(", language)[0]
    assert time.perf_counter() - began < 20


def test_files(spark):
    two = "class A {" + " int a;\n" * 60
    rows = [(1, "r/a.py", "x = 1"), (1, "r/a.py", "x = 1"), (2, "r/b.js", "const x ="), (3, "r/c.txt", "(("), (4, None, "(("), (5, "r/d.go", None), (6, "r/e.go", ""), (7, "r/f.java", "class A {" + " int a;\n" * 500 + "}"), (8, "r/g.java", "class A {" + " int a;\n" * 500)]
    rows += [(9, "r/h.java", two), (9, "r/h.java", two + "}}"), (10, "r/i.py", "def f():\n" + "    x = [\n1,\n]\n" * 300), (11, "r/j.py", "def f():\n" + "    x = 1\n" * 300 + "   y = 2\n"), (12, "r/k.ts", "const a = `" + "text ${ [1,\n 2] } more\n" * 200 + "`;\n")]
    df = spark.createDataFrame([(*r, "clash", 3) for r in rows], "file_id bigint, file_path string, content string, lang string, k int")
    for size, span, fan_in in ((2048, 1 << 20, 64), (64, 1 << 20, 64), (64, 512, 3)):
        got = {r.file_id: (r.parses, r.chunks) for r in parse_files(df, "file_id", "file_path", "content", size, span, fan_in).collect()}
        assert {k: v[0] for k, v in got.items()} == {1: True, 2: False, 6: False, 7: True, 8: False, 9: False, 10: True, 11: False, 12: True}
        # every file comes from the maps of all its chunks
        assert all(v[1] >= 1 for v in got.values()) and got[7][1] >= 4008 // (4 * size) and got[12][1] > (1 if size < 500 else 0)
    assert parse_files(df.limit(0), "file_id", "file_path", "content").count() == 0
