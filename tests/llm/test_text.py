"""Origins, leakage, mixing and repair."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import encoding, leakage, mixing, origin

HAND = "import os\n\n\ndef load_shared_ledger(path, mode='fast'):\n    with open(path) as handle:\n        return [line.rstrip() for line in handle if line.strip()]\n\n\nclass LedgerReader:\n    def __init__(self, source):\n        self.source = source\n"
MINI = "/*! x 1.0 */!function(e,t,n){var r=function(e){for(var t=0,n=e.length;t<n;t++)if(null!=e[t])return!0;return!1};e.q=function(){return this._x||(this._x=new Map)};t.z=r(n)&&e.u(7,{k:!0})}(window,{},function(){});"


def test_origins(spark):
    library = "\n".join(f"def compute_tenant_{w}(value, floor):\n    total = {i * 37} + value - floor\n    return total * len('{w}')" for i, w in enumerate("ledger sensor broker parcel window monitor cursor signal".split()))
    files = {
        1: ("r/src/a.py", HAND), 2: ("r/src/b.js", MINI), 3: ("r/node_modules/x/i.js", "const a = 1;\n"), 4: ("r/src/c.py", "# Code generated by x v1. DO NOT EDIT.\n" + HAND),
        5: ("r/src/d.py", "# Do not edit the pallet while the job runs.\n" + HAND), 6: ("r/src/e.py", "".join(f"def get_key_{i:03d}(m):\n    return m.get({i})\n\n" for i in range(9))),
        7: ("r/src/f.py", "TABLE = [\n" + ", ".join(str(i * 7 % 256) for i in range(300)) + "]\n"), 8: ("r/src/g.py", "SMALL = [1, 2, 3]\n"), 9: ("r/lib/own.py", "# local copy\n" + library.replace("floor", "floor", 1) + "\n\n"),
        10: ("r/scripts/build/h.py", HAND), 11: ("r/build/h.py", HAND), 12: ("r/src/k.py", 'BANNER = "# Code generated by x. DO NOT EDIT."\n' + HAND), 13: ("r/src/l.py", None), 14: (None, "x"), 15: ("r/src/m.py", ""), 16: ("r/src/codegen.py", HAND), 17: ("r/src/n.pb.go", "package a\n"),
    }
    rows = [(k, p, c) for k, (p, c) in files.items()] + [(1, *files[1])] + [(100 + i, f"r/src/w{i}.py", HAND.replace("ledger", w)) for i, w in enumerate(("sensor", "broker", "parcel"))] + [(200 + i, f"r/src/w{i}.js", f"function load{w.title()}(path, option{w.title()}) {{\n  const {w}Entries = path.split('/').filter((part) => part.length > option{w.title()});\n  return {w}Entries.reverse();\n}}\n") for i, w in enumerate(f"{a}{b}" for a in "ledger sensor broker parcel window monitor cursor signal".split() for b in ("", "Old", "New", "Raw", "Hot", "Cold"))]
    df = spark.createDataFrame([(*r, "x") for r in rows], "file_id bigint, file_path string, content string, reasons string")
    libs = spark.createDataFrame([(library,), (None,), ("",)], "content string")
    got = {r.file_id: list(r.reasons) for r in origin.origins(df, libs).collect()}
    want = {1: [], 2: ["minified"], 3: ["vendored"], 4: ["generated"], 5: [], 6: ["generated"], 7: ["data"], 8: [], 9: ["vendored"], 10: [], 11: ["generated"], 12: [], 13: [], 14: [], 15: [], 16: [], 17: ["generated"]}
    assert {k: got[k] for k in want} == want
    rows = {r.file_id: (list(r.reasons), list(r.evidence)) for r in origin.origins(df, libs, broadcast_files=0).collect()}
    assert {k: v[0] for k, v in rows.items()} == got and rows[9][1] == ["library copy"] and rows[2][1] == ["mangled names"] and rows[6][1] == ["template names"]
    assert origin.origins(df.limit(0), libs.limit(0)).count() == 0
    assert origin.origins(df.limit(0), libs, broadcast_files=0).count() == 0


def seed_hits(length, wrong):
    bad = set(wrong)
    return any(all(p + o not in bad for o in off) for off in leakage._OFFSETS for p in range(length - int(off[-1])))


@pytest.mark.parametrize("length,wrong", [(15, 1), (19, 1), (20, 2), (24, 2), (29, 2), (30, 3), (35, 3), (39, 3)])
def test_seeds_hit_every_placement(length, wrong):
    assert all(seed_hits(length, w) for w in itertools.combinations(range(length), wrong))


def test_seeds_hit_four_in_forty():
    assert all(seed_hits(40, w) for w in itertools.combinations(range(40), 4))


def brute_overlap(item, doc, shift):
    best = 0
    for i in range(len(item)):
        for j in range(i + 15, len(item) + 1):
            if i + shift >= 0 and j + shift <= len(doc):
                same = sum(item[k] == doc[k + shift] for k in range(i, j))
                if 10 * same >= 9 * (j - i):
                    best = max(best, j - i)
    return best


def test_overlap_equals_brute_force():
    r = np.random.default_rng(3)
    for _ in range(60):
        item = r.integers(0, 50, 30).astype(np.uint64)
        doc = np.concatenate([r.integers(0, 50, 6), item, r.integers(0, 50, 6)]).astype(np.uint64)
        for k in r.integers(0, len(doc), r.integers(0, 8)):
            doc[k] = 99
        for shift in (0, 5, 6, -3):
            assert leakage.overlap(item, doc, shift) == brute_overlap(item.tolist(), doc.tolist(), shift)


WORDS = [f"w{i}" for i in range(40)]


def test_leaks(spark):
    w = WORDS
    broken = [x if i not in (4, 17) else "other" for i, x in enumerate(w[:20])]
    short = w[:13] + ["no"] * 10
    docs = {
        1: "before " + " ".join(w[5:25]) + " after", 2: "x " + " ".join(broken) + " y", 3: " ".join(short), 4: None, 5: "", 6: "\n".join(f"// {' '.join(w[i : i + 5])}," for i in range(0, 40, 5)).upper(), 7: '{"prompt": "' + "\\n".join(" ".join(w[i : i + 4]) for i in range(0, 40, 4)) + '"}',
        8: "<p>" + " ".join(f"<b>{x}</b>" for x in w[:16]) + "</p>", 9: "\n".join(f"{k + 1}: {' '.join(w[i : i + 5])}" for k, i in enumerate(range(0, 40, 5))), 10: " ".join(reversed(w)),
    }
    d = spark.createDataFrame([(k, t, 7) for k, t in docs.items()] + [(1, docs[1], 8)], "doc_id bigint, text string, item_id int")
    items = spark.createDataFrame([(1, " ".join(w), "s"), (2, None, "s"), (3, "too short", "s"), (1, " ".join(w), "t")], "item_id bigint, text string, doc_id string")
    near = {(r.doc_id, r.item_id): r.words for r in leakage.leaks(d, items).collect()}
    far = {(r.doc_id, r.item_id): r.words for r in leakage.leaks(d, items, broadcast_items=1).collect()}
    assert near == far
    assert sorted(k[0] for k in near) == [1, 2, 6, 7, 8, 9] and near[(1, 1)] == 22 and near[(9, 1)] == 40
    assert leakage.leaks(d.limit(0), items).count() == 0 and leakage.leaks(d, items.limit(0)).count() == 0


def test_words_that_are_all_the_same(spark):
    """One word everywhere: every place of both is a seed, and the longest stretch is still found at once."""
    import time

    began = time.perf_counter()
    words = leakage.Words()
    index = leakage.Index([words("same " * 3000), words("same " * 14)])
    assert index.leaks(words("same " * 10_000)) == {0: 3000}
    assert index.leaks(words("same " * 20 + "other")) == {0: 21}  # nine in ten of 21 agree
    assert time.perf_counter() - began < 5


@pytest.mark.parametrize("sizes", [((9, 4), (11, 5)), ((400, 300), (500, 260))])
def test_differences(sizes):
    r = np.random.default_rng(1)
    a, b = (np.unique(r.integers(0, hi, n)) for n, hi in ((sizes[0][0], 2000), (sizes[0][1], 900)))
    assert leakage._differences(a, b).tolist() == sorted({int(x) - int(y) for x in a for y in b})


def test_recall_on_substituted_passages():
    """Passages of 15 to 80 words with up to a tenth of them replaced, against a search of all shifts: none is missed."""
    r = np.random.default_rng(7)
    found = wanted = 0
    for _ in range(300):
        item = r.integers(1, 1 << 60, 120).astype(np.uint64)
        n = int(r.integers(15, 80))
        at = int(r.integers(0, 120 - n))
        part = item[at : at + n].copy()
        other = lambda k: r.integers(1, 1 << 60, k).astype(np.uint64)
        part[r.choice(n, n // 10, replace=False)] = other(n // 10)
        doc = np.concatenate([other(40), part, other(40)])
        best = max(leakage.overlap(item, doc, s) for s in range(-120, 160))
        wanted += best > 0
        found += best > 0 and leakage.Index([item]).leaks(doc) == {0: best}
    assert wanted == 300 and found == wanted


def test_mixing(spark):
    docs = [(i, "one two three four five six " * (1 + i % 4), "big" if i % 3 else " Small ") for i in range(600)] + [(1000, None, "big"), (1001, "", "big"), (1002, "text", None), (1003, "text", "other")]
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id bigint, text string, source string, copy int")
    t = spark.createDataFrame([("big", 0.3, 1), ("small", 0.6, 3), ("none", 0.1, 5)], "source string, target_share double, max_repeats int")
    s = {r.source: r for r in mixing.shares(d, t).collect()}
    assert abs(s["big"].actual_share - 1 / 3) < 0.01 and abs(s["small"].actual_share - 2 / 3) < 0.01
    assert s["none"].tokens == 0 and s["big"].most_uses <= 1 and s["small"].most_uses <= 3
    m = mixing.mix(d, t)
    used = {(r.doc_id, r.copy) for r in m.select("doc_id", "copy").collect()}
    assert len(used) == sum(r.copies for r in s.values()) and not used & {(k, 1) for k in (1000, 1001, 1002, 1003)}
    assert used == {(r.doc_id, r.copy) for r in mixing.mix(d, t).select("doc_id", "copy").collect()}
    order = [r.doc_id for r in m.collect()]
    assert order != sorted(order)
    assert mixing.shares(d.limit(0), t).agg(F.sum("tokens")).first()[0] == 0 and mixing.mix(d.limit(0), t).count() == 0
    assert mixing.mix(d, t.limit(0)).count() == 0


@pytest.mark.parametrize("mean,cap", [(0.3, 1), (1.7, 2), (2.5, 6), (0.01, 5)])
def test_rate_inversion(mean, cap):
    assert abs(mixing.capped_mean(mixing.rate_for(mean, cap), cap) - mean) < 1e-6


SOUND = ["Une qualité déjà vérifiée – « bien » …", "Größtenteils überflüssig, Äpfel für 3 €", "ATENÇÃO: NÃO remova a CONFIGURAÇÃO", "¿Cómo está? ¡Atención!", "Все зависимости между модулями устранены", "naïve café → ok", "Bug: shows `Ã©` and `â€™` here", "", "plain ascii & more <b> 50% x=1", "a\xa0b"]
TEXTS = ["Une qualité déjà vérifiée, l’été", "Die Größe überschreitet das zulässige Maß", "A configuração não é necessária", "Все зависимости между модулями устранены полностью"]


def test_sound_texts_stay():
    assert [t for t in SOUND if encoding.repair(t) != (False, t, True)] == []


@pytest.mark.parametrize("charset", ["cp1252", "latin-1", "mac_roman", "cp850", "cp437", "cp1250"])
def test_round_trips(charset):
    table_ = encoding._TO_BYTE[charset]
    back = {b: c for c, b in reversed(table_.items())}
    for text in TEXTS:
        wrong = "".join(back[b] if b >= 128 else chr(b) for b in text.encode())
        garbled, fixed, whole = encoding.repair(wrong)
        assert (garbled, fixed, whole) == (True, text, True), (charset, wrong, fixed)


def test_twice_one_byte_and_notations():
    twice = TEXTS[0].encode().decode("latin-1").encode().decode("latin-1")
    assert encoding.repair(twice)[:2] == (True, TEXTS[0])
    russian = TEXTS[3]
    for wrong in (russian.encode("cp1251").decode("latin-1"), russian.encode("koi8-r").decode("cp1251"), russian.encode().decode("cp1251", "replace")):
        assert encoding.repair(wrong)[0]
    assert encoding.repair(russian.encode("cp1251").decode("latin-1"))[1] == russian
    assert encoding.repair("gef&#195;&#164;hrdet") == (True, "gefährdet", True)
    assert encoding.repair("gef\\u00c3\\u00a4hrdet") == (True, "gefährdet", True)
    assert encoding.repair("an\ufffdlisis") == (True, "an\ufffdlisis", False)




STRANGE = {  # text, charset that it was in, charset that it was read in
    "gbk": ("这是一个关于编码错误的测试文本内容", "gbk", "latin-1"),
    "shift_jis": ("これは文字コードのテストです。日本語の文章", "shift_jis", "latin-1"),
    "euc_kr": ("이것은 문자 인코딩 테스트입니다 한국어 문장", "euc_kr", "latin-1"),
    "greek": ("Αυτό είναι ένα κείμενο δοκιμής για την κωδικοποίηση", "iso8859-7", "latin-1"),
    "cp1253": ("Αυτό είναι ένα κείμενο δοκιμής για την κωδικοποίηση", "cp1253", "cp1252"),
    "hebrew": ("זהו טקסט בדיקה עבור קידוד שגוי", "cp1255", "cp1252"),
    "arabic": ("هذا نص تجريبي لترميز خاطئ", "cp1256", "latin-1"),
    "polish": ("Zażółć gęślą jaźń, proszę państwa", "cp1250", "latin-1"),
    "russian": ("Все зависимости между модулями устранены", "cp1251", "latin-1"),
}


@pytest.mark.parametrize("name", STRANGE)
def test_other_charsets(name):
    text, was, read_as = STRANGE[name]
    assert encoding.repair(text.encode(was).decode(read_as)) == (True, text, True)
    assert encoding.repair(text) == (False, text, True)


def test_sound_texts_of_other_languages_and_lists_of_letters():
    for text in ("Ðað er þýðing íslensku", "ÀÉÎÕÜ", "Zażółć gęślą jaźń", "Příliš žluťoučký kůň", "A função é necessária", "Ærø, Østerå og Ålesund"):
        assert encoding.repair(text) == (False, text, True), text


def test_misread_many_times_and_escapes_of_any_kind():
    text = "café"
    for n in range(1, 8):
        text = text.encode().decode("latin-1")
        assert encoding.repair(text) == (True, "café", True), n
    for wrong in ("caf\\u251c\\u2310", "caf<C3><A9>", "caf<U+00C3><U+00a9>", "caf=c3=83=c2=a9", "caf&#195;&#169;"):
        assert encoding.repair(wrong) == (True, "café", True), wrong
    russian = "Все зависимости"
    escaped = "".join(c if c == " " else f"\\u{ord(c):04x}" for c in russian.encode().decode("cp1251", "replace") if c != "�")
    assert encoding.repair(escaped)[0]
    best, steps, whole = encoding.search("cafÃ©", most=1)
    assert steps == 0 and not whole


def test_repair_of_a_table(spark):
    d = spark.createDataFrame([(1, "cafÃ©", "x"), (2, None, "x"), (3, "", "x"), (4, "café", "x"), (1, "cafÃ©", "y"), (5, "cafÃ© " * 20_000, "z")], "doc_id bigint, text string, garbled string")
    got = {r.doc_id: (r.garbled, r.text[:5]) for r in encoding.repaired(d, "doc_id", "text").collect()}
    assert got == {1: (True, "café"), 3: (False, ""), 4: (False, "café"), 5: (True, "café ")}
    assert encoding.repaired(d.limit(0), "doc_id", "text").count() == 0


def words_of(n, seed):
    r = np.random.default_rng(seed)
    stock = "ledger sensor broker parcel window monitor cursor signal folder header bucket turbine".split()
    return [tuple(r.choice(stock, 2, replace=False)) for _ in range(n)]


def python_file(seed, camel):
    """A hand-written file of ten functions, its names joined in one of two ways."""
    join = (lambda a, b: a + b.title()) if camel else (lambda a, b: f"{a}_{b}")
    return "import os\n\n\n" + "\n\n".join(f"def {join('load', a)}({join(a, b)}, floor):\n    {join('all', b)} = [{join(a, 'row')} for {join(a, 'row')} in {join(a, b)} if {join(a, 'row')}]\n    return {join('all', b)}\n" for a, b in words_of(10, seed))


def test_foreign_style_decides_wherever_a_file_lies(spark):
    snake = [(k, f"r{k % 3}/src/m{k}.py", python_file(k, False)) for k in range(60)]
    script = "\n".join(f"function load{a.title()}{b.title()}({a}Rows, floor) {{\n  const {b}Total = {a}Rows.filter((part) => part.length > floor);\n  return {b}Total;\n}}" for a, b in words_of(10, 5))
    scripts = [(200 + k, f"r1/web/s{k}.js", script.replace("floor", f"floor{k}")) for k in range(20)]
    house = [(300 + k, f"own/src/m{k}.py", python_file(300 + k, True)) for k in range(6)]
    guest = [(400, "r0/src/kit/panel.py", python_file(400, True)), (401, "r1/panel.py", python_file(401, True)), (402, "r2/src/page.py", script), (403, "alone/panel.py", python_file(403, True))]
    few = "import os\nfrom kit import loadLedger, loadSensor\n\n\ndef use(a_row):\n    return loadLedger(a_row) + loadSensor(a_row)\n"
    members = "import os\n\n\ndef use(kit, row):\n" + "".join(f"    kit.load{a.title()}{b.title()}(row)\n" for a, b in words_of(40, 9))
    rows = snake + scripts + house + guest + [(404, "r0/src/few.py", few), (405, "r0/src/members.py", members)]
    df = spark.createDataFrame(rows + [(k, p, c) for k, p, c in guest], "file_id bigint, file_path string, content string")
    got = {r.file_id: (list(r.reasons), list(r.evidence)) for r in origin.origins(df, spark.createDataFrame([], "content string")).collect()}
    assert {k: v for k, v in got.items() if v[0]} == {k: (["vendored"], ["foreign style"]) for k in (400, 401, 403)}
    assert len(got) == len(rows)


def test_mangled_names_need_no_long_lines(spark):
    letters = [f"{a}{b}" for a in ("", "a", "b") for b in "cdefghjklmnopqrstuvwxyz"]
    mangled = "".join(f"function {a}({b}, {c}) {{\n  if ({b} === null) {{\n    return {c};\n  }}\n  return {b}.length;\n}}\n" for a, b, c in zip(letters, letters[1:], letters[2:]))
    sound = [(k, f"r/src/w{k}.js", "".join(f"function load{a.title()}{b.title()}({a}Rows, floor) {{\n  if ({a}Rows === null) {{\n    return floor;\n  }}\n  return {a}Rows.length;\n}}\n" for a, b in words_of(8, k))) for k in range(60)]
    df = spark.createDataFrame([(100, "r/src/x.js", mangled), (101, "r/src/y.sh.js", "\n".join(f"-{x} {y}" for x, y in zip(letters, letters[1:]))), *sound], "file_id bigint, file_path string, content string")
    got = {r.file_id: list(r.evidence) for r in origin.origins(df, spark.createDataFrame([], "content string")).collect() if r.reasons}
    assert got == {100: ["mangled names"]}


def test_several_templates():
    def code(verbs, numbers):
        return "".join(f"def {v}_{n}(m):\n    return m\n\n\n" for v in verbs for n in numbers)

    def share(text):
        return origin.template_share(text, sorted(set(origin._NAME.findall(text))))

    assert share(code(("get", "set", "drop"), range(9))) == 1.0
    assert share(code(("get",), range(9)) + code(("load", "seal"), ("ledger", "sensor", "broker"))) == 9 / 15
    assert share(code(("vec", "mat", "dot", "cross"), (2, 3, 4))) == 3 / 12
