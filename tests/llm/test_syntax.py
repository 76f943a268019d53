"""The recogniser against Python's own parser, and against known good and bad scripts."""

from __future__ import annotations

import ast
import random
import warnings

import pytest

from repolith.llm import python_syntax, script_syntax, syntax_check
from repolith.llm.gll import Grammar

warnings.simplefilter("ignore")


def test_ambiguous_and_recursive_grammars():
    kinds = {"END": 0, "a": 1, "b": 2}
    g = Grammar("S~ = 'a' S 'b' | 'a' S |\nT = S END", kinds, [frozenset()])
    accepts = lambda word: g.accepts("T", [*(kinds[c] for c in word), 0])[0]
    assert accepts("") and accepts("aaabb") and accepts("a" * 60 + "b" * 30) and not accepts("abb") and not accepts("ba")


PYTHON = [
    "", "x = 1", "def f(a, /, b, *, c: int = 2, **k) -> int:\n    return a\n", "if x: y\nelse:\n  z\n", "for i, *j in a, b: pass; continue;\n", "with (open(a) as f, g() as h):\n    pass\n", "with (a, b): pass\n",
    "match x:\n    case {'a': 1, **r} if r: pass\n    case [a, *_] | Point(x=0) as p:\n        pass\n", "match = 3\nmatch(x)\nmatch[x]: int = 1\n", "type X[T] = list[T]\n", "lambda *a, **k: (yield)\n", "@a.b(1)\nasync def f():\n    async with a: pass\n    await x\n",
    "x = f'{a!r:>{w}} {{}} {b[\"k\"]}'\n", "f'{x!z}'\n", "f'{'a'}'\n", "f'{'\n", "'abc\n", "a = (1,\n b)\n", "a = (1,\n", "if x:\npass\n", "  x = 1\n", "if 1:\n\tx\n        y\n", "try:\n  a\nexcept* E as e:\n  b\nelse:\n  c\n", "try:\n  a\n", "print 'x'\n",
    "<<<<<<< HEAD\nx\n", "x = 0777\n", "x = 1_000\n", "x = 5abc\n", "1if x else y\n", "a = b = yield c\n", "x: int\n", "import a.b as c, d\nfrom . import (x, y as z,)\nfrom .a import *\n", "class A(B, m=C): x = 1; y = 2\n", "{**a, 'b': 1}\n{*a, b}\n[x async for x in y if z]\n", "a\\\n+ b\n", "def f(:\n", "é = 1\n", "$\n", "a ? b\n", "x = [1, 2\ny = 3\n",
]


@pytest.mark.parametrize("text", PYTHON)
def test_python(text):
    try:
        ast.parse(text)
        want = True
    except SyntaxError:
        want = False
    assert python_syntax.parses(text) is want


def test_python_mutations():
    rng = random.Random(4)
    base = open(python_syntax.__file__).read().split("\n\n\ndef ")[1:8]
    wrong = 0
    for _ in range(250):
        text = "def " + rng.choice(base) + "\n"
        cut = rng.randrange(len(text))
        text = rng.choice([text[:cut], text[:cut] + text[cut + 1 :], text[:cut] + rng.choice("():,=+ \n") + text[cut:]])
        try:
            ast.parse(text)
            want = True
        except (SyntaxError, ValueError):
            want = False
        wrong += python_syntax.parses(text) is not want
    assert wrong <= 5  # what only a compiler's later passes refuse, such as an assignment to a call


GOOD = [
    ("js", "a\nb = c /d/ e; x = /re[/]/g.test(y)"), ("js", "const {a, b: [c = 1, ...d], ...e} = f, g = async x => { await x }, h = (a, b) => ({ a, get b() { return 1 }, async *c() {}, [k]: 2 })"), ("js", "for (const x of y) if (x) continue; else break\nfor (let i = 0; i < 3; i++) {}\nfor (k in o);"),
    ("js", "label: for (;;) { break label }\nswitch (a) { case 1: b(); default: c }\ntry { a } catch { b } finally { c }\ndo x++; while (x < 3)\nvar of, get, set, async, from"), ("js", "class A extends B { static #x = 1; static { y } get z() { return this.#x } async *g() {} static async = 2\n'a' = 3 }"),
    ("js", "import a, { b as c, default as d } from 'm'; import * as n from \"k\"; export * as q from 'z'; export { a as default }; export default class {}\nimport('x').then(y => import.meta.url)"), ("js", "x = `a ${b + `c ${d}`} e`; a?.b?.[c]?.(d) ?? e ** f; new Foo; new a.b(c).d; new.target; tag`x`"), ("js", "#!/usr/bin/env node\na"), ("js", "﻿x"), ("js", ""),
    ("js", "return_ = 1\n;[1, 2].map(f)\nif (a) b\nelse c\nlet x = function* () { yield* y; yield }"), ("js", "a\n++b\nx = y\n/foo/g"),
    ("jsx", "const a = <A.B c={d} {...e} f='g'>text {h} <></> {/* c */}<i /></A.B>; const b = cond ? <p>1 is less</p> : null; x < y > z"), ("jsx", "function F() { return (\n<ul>{xs.map((x) => (<li key={x}>{x}</li>))}</ul>\n) }"),
    ("ts", "const f = <T,>(x: T): x is string => true; let a = b as const; let c = <any>d; e!.f![0]; type X<T extends U = V> = { readonly [K in keyof T]?: T[K] } & (A | B)[] | ((a: number) => void)"),
    ("ts", "interface A<T> extends B<C>, D { (x: number): string; new (y): z; m?(a: T): void; readonly p: [a: string, b?: number, ...c[]]; [k: string]: any }\ndeclare module 'x' { export const a: number }\nnamespace N.M { }\nenum E { A = 1, B }\nabstract class Q<T> implements R<S> { private constructor(public readonly a: string, b?: number) { super() } abstract m(): void; declare x; y!: string }"),
    ("ts", "function f(this: A, a?: B, ...c: D[]): asserts a is B;\nfunction f() { return a < b && c > d; foo<string>(x); new Map<string, Array<number>>(); (a ? (b) : c => d) }\nimport type { T } from 'x'; export type { T }; import x = require('y'); let u: unique symbol, v: typeof a.b, w: `a${string}`; x satisfies Y; type C = A extends infer U ? U : never"),
    ("tsx", "const f = <T extends A>(x: T) => <div a={x as B}>{y!}</div>"),
]
BAD = [
    ("js", "let x: number = 1"), ("js", "const a = <p>x</p>"), ("js", "interface A { b: c }"), ("js", "function f( {"), ("js", "const x;"), ("js", "a b"), ("js", "<<<<<<< HEAD\nx"), ("js", "x = 'a\nb'"), ("js", "`a ${b"), ("js", "if (a { }"), ("js", "class { }"), ("js", "x = [1, 2"), ("js", "/* a"), ("js", "import x from"), ("js", "return 1 2"), ("js", "a => {} => b"),
    ("jsx", "<a></b>"), ("jsx", "<a>{</a>"), ("jsx", "<a b=c />"), ("jsx", "<a>x > y</a>"), ("ts", "return <p className=\"a\">b c</p>;"), ("ts", "type X = ;"), ("ts", "let a: ;"), ("tsx", "const a = <div>"), ("ts", "def f(x):\n    return x"), ("ts", "enum { A }"),
]


@pytest.mark.parametrize("dialect,text", GOOD)
def test_good_scripts(dialect, text):
    assert script_syntax.parses(text, dialect)


@pytest.mark.parametrize("dialect,text", BAD)
def test_bad_scripts(dialect, text):
    assert not script_syntax.parses(text, dialect)


PLACED = [
    "f(a,,b)", "[1,,2]", "{1: 2,,3: 4}", "{1,,2}", "{**a,,'b': 1}", "def f(a,,b): pass", "x[1,,2]", "from a import (b,,c)", "lambda a,,b: 0", "for a,,b in c: pass", "return_ = 1,,2", "class A(B,,C): pass",
    "f(a, b,)", "[1, 2,]", "{1: 2,}", "{1, 2,}", "def f(a, b,): pass", "x[1, 2,]", "from a import (b, c,)", "x = 1,", "f(,a)", "[,]", "f(,)",
    "f(a=1, b)", "f(**k, b)", "f(**k, *a)", "f(a=1, *b, c=2, **d)", "f(*a, b, **c, d=1)", "f(a.b=1)", "f(1=2)", "f(x for x in y)", "f(x for x in y, 1)", "f(1, x for x in y)", "f(x for x, (y, z) in w)", "f(x for x, y in z, 1)", "x = (a async for a, b in c)", "f(x for x in y,)", "f(lambda a=1: a, b)", "class A(m=1, B): pass",
    "def f(a=1, b): pass", "def f(a=1, *, b): pass", "def f(*): pass", "def f(*, **k): pass", "def f(**k, a): pass", "def f(/, a): pass", "def f(a, /, b, /): pass", "def f(*a, *b): pass", "def f(a: int = 1, b: str = lambda x=2: x): pass", "lambda a=1, b: a", "lambda *, a: a", "def f[T = int](a, b=1): pass",
    "1 + 2 = x", "for 1 in x: pass", "f() = 1", "f().a = 1", "a[1], (b, *c), [d.e] = x", "a = 1 = b", "(a, 1) = x", "a, b += 1", "(a) += 1", "f() += 1", "a.b: int = 1", "f(): int = 1", "a, b: int", "del a, b[0], c.d", "del f()", "del (a, [b])", "x = lambda a=1: a", "lambda: x = 1", "'a' = x", "None = 1", "a if b else c = 1", "await_ = [x for f() in y]",
    "[x for x, (y, z) in y]", "with a as f(): pass", "with a as b.c, d as (e, f): pass", "with (a as b, c as 1): pass", "if x: y + 1 = 2", "if x: y = 2; z = 3", "x := 1", "(x := 1)", "(1 := 2)", "if x := f(): pass", "f(x := 1)", "type X = int", "type = 1", "match x:\n    case 1: y = 2\n", "match x:\n    case 1: 1 = 2\n", "async def f(a=1, b): pass", "a = yield = 1",
]


@pytest.mark.parametrize("text", PLACED)
def test_lists_targets_and_order(text):
    test_python(text + "\n")


@pytest.mark.parametrize("dialect,good,bad", [
    ("js", "f(a, b,)", "f(a,,b)"), ("js", "x = {a, b,}", "x = {a,,b}"), ("js", "import {a, b,} from 'c'", "import {a,,b} from 'c'"), ("js", "x = [1, 2]", "x = [1 2]"), ("js", "x = [,1,,2,]", "x = ['a' 'b']"), ("js", "[a, , b] = c; let [, d,, e,] = f", "let [a b] = c"), ("js", "function f(a, b,) {}", "function f(a,,b) {}"), ("js", "let {a, b,} = c", "let {a,,b} = c"),
    ("js", "x = (a, b,) => a", "x = (a,,b) => a"), ("ts", "enum E { A, B, }", "enum E { A,,B }"), ("ts", "type X<A, B,> = [a: A, b?: B,]", "type X = [A,,B]"),
])
def test_commas_of_scripts(dialect, good, bad):
    assert script_syntax.parses(good, dialect) and not script_syntax.parses(bad, dialect)


def test_deep_nesting_is_no_problem():
    assert script_syntax.parses("x = " + "(" * 3000 + "1" + ")" * 3000, "js") and not script_syntax.parses("x = " + "(" * 3000, "js")
    assert script_syntax.parses("a = " + " + ".join(f"f(b{i})" for i in range(4000)) + ";", "ts")


def test_files_and_rates(spark):
    files = spark.createDataFrame([(1, 1, "a.py", ".py", 1, 1), (1, 1, "a.py", ".py", 1, 2), (1, 2, "b\\c.ts", None, 1, 1), (1, 3, "d.md", None, 1, 1), (2, 4, "e.jsx", None, 1, 1), (2, 5, "f.js", None, None, 1), (2, None, "g.js", None, 1, 1)], "project_id long, file_id long, relative_path string, extension string, line_count int, modified_time_ns long")
    sources = spark.createDataFrame([(1, "def f(:"), (1, "def f(:"), (2, "let a: number = 1"), (3, "("), (4, "<a></a>"), (5, None), (None, "(")], "file_id long, content string")
    got = {r.file_id: (r.has_syntax_errors, r.accepted_by) for r in syntax_check.check_files(files, sources).collect()}
    assert got == {1: (True, []), 2: (False, []), 4: (False, []), 5: (None, [])}
    assert [r.file_id for r in syntax_check.broken_files(syntax_check.check_files(files, sources)).collect()] == [1]
    rates = {(r.project_id, r.language): r.rate for r in syntax_check.error_rates(syntax_check.check_files(files, sources)).collect()}
    assert rates == {(1, "Python"): 1.0, (1, "TypeScript"): 0.0, (2, "JavaScript"): 0.0}
    wrong = syntax_check.check_files(spark.createDataFrame([(1, 9, "x.js", None, 1, 1)], files.schema), spark.createDataFrame([(9, "let a: number = 1")], sources.schema)).first()
    assert wrong.accepted_by == ["ts", "tsx"] and wrong.error_line == 1
    assert syntax_check.check_files(files.limit(0), sources.limit(0)).count() == 0


def test_dialects_run_together():
    kinds = {c: i for i, c in enumerate(["END", "a", "b", "c"])}
    g = Grammar("S = 'a' T END\nT = @x 'b' | @y 'b' 'c' | 'c' T |", kinds, [frozenset("x"), frozenset("y"), frozenset("xy")])
    accepts = lambda word, **kw: g.accepts("S", [*(kinds[c] for c in word), 0], mask=7, **kw)[0]
    assert [accepts(w) for w in ("a", "ab", "abc", "acb", "accbc", "b", "abb")] == [7, 5, 6, 5, 6, 0, 0]
    for text in ("let a: number = 1", "const x = <T,>(a) => a", "a = b!", "let a = <b/>;", "const f = (a): T => a", "var a = 1", "type A = B", "x = <T>y", "async <T>(x) => x", "var ="):
        for dialect in script_syntax.DIALECTS:
            good, asked, _ = script_syntax.read(text, dialect, all_of_them=True)
            alone = [d for d in script_syntax.DIALECTS if script_syntax.parses(text, d)]
            assert [d for d in alone if asked & 1 << list(script_syntax.DIALECTS).index(d)] == good, (text, dialect)
            assert sorted({*good, *script_syntax.accepting(text, asked)}) == sorted(alone), (text, dialect)


@pytest.mark.parametrize("text,good", [('x = f"{d["a"]}"', True), ("x = f'{d['a']!r:>{w}}'", True), ('x = f"{"".join(f"{y}" for y in z)}"', True), ('x = f"{a"', False), ('x = f"}"', False), ('x = f"{d["a]}"', False), ('x = f"{{a}}"', True)])
def test_strings_inside_fields(text, good):
    assert python_syntax.parses(text + "\n") is good
