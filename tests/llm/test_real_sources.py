"""The syntax check against other parsers and against idioms of real code."""

import ast
import os
import random
import warnings

import pytest

from quarryframe.llm.syntax import check


def _library():
    root = os.path.dirname(os.__file__)
    for folder, folders, files in os.walk(root):
        folders[:] = sorted(d for d in folders if d not in ("site-packages", "test", "tests", "__pycache__", "idlelib"))
        for f in sorted(files):
            if f.endswith(".py"):
                try:
                    with open(os.path.join(folder, f), encoding="utf-8", newline="") as h:
                        yield f, h.read()
                except UnicodeDecodeError:
                    continue


def _valid(text):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            ast.parse(text)
        except (SyntaxError, ValueError):
            return False
    return True


def test_every_file_of_the_standard_library_parses():
    wrong = [f for f, text in _library() if _valid(text) and check("py", text, False)[0]]
    assert wrong == []


def test_damaged_files_are_found():
    draw, missed, invalid = random.Random(5), 0, 0
    for _, text in list(_library())[::6]:
        lines = text.split("\n")
        if len(lines) < 20 or len(text) > 40000:
            continue
        for _ in range(3):
            k = draw.randrange(len(lines))
            words = lines[k].split(" ")
            w = draw.randrange(len(words))
            damaged = "\n".join([*lines[:k], " ".join(words[:w] + words[w + 1 :]), *lines[k + 1 :]])
            if not _valid(damaged):
                invalid += 1
                missed += not check("py", damaged, False)[0]
    assert invalid > 50 and missed <= 0.02 * invalid


VALID = {
    "py": ["f(lambda a, b=1: a, c)\n", "x = {k: v for k, v in y}\n", "def f(a, /, b=1, *, c, **d): pass\n", "match a:\n    case [1, *_] | {'k': v, **r} if v: pass\n", "class A[T: int]: pass\n", "x = f'{a['k']!r:>{w}}'\n", "try:\n    pass\nexcept* E as e:\n    pass\n"],
    "ts": [
        "declare global {\n  interface A { b?: string }\n}\n", "export type M<T> = { readonly [K in keyof T as `x${K & string}`]-?: T[K] };\n", "class A<T> {\n  private x!: Map<string, number>\n  [Symbol.iterator](): void {}\n  get y(): this is A<T> { return true }\n}\n",
        "type F = abstract new (...a: any[]) => void;\nexport type * from './x';\n", "function f(this: Window, x?: [a: string, b?: number]): asserts x is [string] {}\n", "const f = async <T,>(x: T): Promise<T> => x satisfies T;\n", "const g = a?.b!.c<string>(`t${`u${1}`}`) ?? /[/]\\/x/g.test(y);\n", "enum E { A = 1 << 2, 'b' }\n", "@dec()\nexport class B { @Input() x = 1\n  accessor z = 2 }\n",
        "let a = b\nlet [c] = d\n", "function f<T>(x: string): void\n{}\n",
    ],
    "tsx": ["const A = <T,>(p: P<T>) => <><B<T> {...p} on={() => <i>x</i>} /> it's {/* c */} {p.ok && 'y'}</>;\n", "export default function C() { return (<div className=\"a\">{xs.map(x => <li key={x.id}>{x.n}</li>)}</div>); }\n"],
    "js": ["do { x() }\nwhile (y)\nif (a) b(); else if (c) d(); else { e() }\n", "class A { static #p = 1; *g() {} async *h() {} catch(e) {} static { this.q = 1 } }\n", "export * as ns from 'm' with { type: 'json' };\n", "for await (const [k, v] of m) for (;;);\n", "#!/usr/bin/env node\nconst a = 1_000n, b = x => ({ ...y, [z]: 1, get w() { return 1 } })\n", "if (a) {}\n[1].map(f)\n"],
    "java": ["class A<T extends B & C> { int[] x = {1, 2,}; <U> void f(U... u) throws E { for (var v : u) g(v); if (a) b(); else c(); Runnable r = () -> {}; } }\n", "record P(int x, int y) { P { if (x < 0) throw new E(); } }\n", "enum E { A(1) { void f() {} }, B; int v() { return switch (this) { case A -> 1; default -> { yield 2; } }; } }\n"],
    "kt": ["fun main() {\n    val x = list.map { it + 1 }\n    when (x) { is Int -> 1\n else -> 2 }\n}\n"],
    "yaml": ["a:\n- b: 1\n  c: |\n    text: x\n- [1, {d: e}]\nf: plain\n  goes - on\n"],
    "json": ['{"a": [1, -2.5e3, null, {"b": "\\u00e9"}]}'],
}
INVALID = {
    "py": ["f(a=1, b)\n", "def f(a=1, b): pass\n", "x = 08\n", "[x for x in y, 1]\n", "try:\n    x\ny\n", "@dec\nx = 1\n"],
    "ts": ["const x: = 1;\n", "interface A { b: ; }\n", "class A { f( { } }\n", "type = ;;x y\n"],
    "js": ["class { }\n", "x = 1; else y\n", "const a;\n", "`${}`\n", "f(,)\n", "if (a) {} else else {}\n"],
    "java": ["class A { void f() { int x = 1 } }\n", "class A { int f() { return 1 } }\n", "class A { void f() { g() } }\n", "class A { void f() { g(1,); } }\n", "class A { List<> f; }\n"],
    "yaml": ["- a\nb: 1\n", "a: b: c\n", "a: [1, 2\n"],
    "json": ["[1,]", "{'a': 1}", "{\"a\" 1}", ""],
}


@pytest.mark.parametrize(("language", "text"), [(k, t) for k, v in VALID.items() for t in v])
def test_valid(language, text):
    assert check(language, text)[0] == 0


@pytest.mark.parametrize(("language", "text"), [(k, t) for k, v in INVALID.items() for t in v])
def test_invalid(language, text):
    assert check(language, text)[0] > 0


def test_damage_kinds():
    assert check("py", "x = 1\ndef f(a, b")[1] == "truncation"
    assert check("ts", "const x = 1;\nconst y: = 2;\n")[1] == "error"
    assert check("java", "class A {\n<<<<<<< a\n int x;\n=======\n int y;\n>>>>>>> b\n}\n")[1] == "conflict"
