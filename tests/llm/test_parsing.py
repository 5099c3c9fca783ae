import ast
import json
import os
import tomllib
import warnings

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from codeloom.llm.parsing import checked, rates
from codeloom.llm.syntax.languages import first_error

VALID = {
    "python": ["", "x = 1\n", "def f(a, /, b: int = 2, *, c, **k) -> int:\n    return [i async for i in a if i]\n", "match x:\n    case {'a': 1, **r} if r: pass\n    case P(a=1) | None as q:\n        pass\n", "type X[T] = list[T]\n", "f'{x[\"a\"]!r:>{w}}'\n", "with (open(a) as f, g):\n    pass\n", "try:\n    pass\nexcept* E as e:\n    pass\n", "# <<<<<<< HEAD\nmatch = case = 1\nprint(match)\n", "x = [\n  1,\n\n# c\n  2]\n", "lambda *a, b=1: (yield)\n", "a: int\nx = y = 2; z: str = 's'\n", "if x:\n\tpass\nelse: pass\n"],
    "javascript": ["", "const a = b / c / d\nlet {x, y: [z]} = q\n", "return 1", "a = /[/]re/g.test(b) ? `t${c + `x${d}`}` : {...e}", "if (a) b\nelse c", "for (const [k, v] of o) {}", "class A extends B { static x = 1; #p; get y() { return 1 } async *z() {} }", "async () => { await x }; x => ({})", "a\n++b", "label: while (1) { break label }", "var of = get, set\n", "x = a ?? b?.c?.[d]?.(e)"],
    "typescript": ["import { a, type B } from './c';\nexport default class X<T extends Y = Z> implements Q { private x?: number; constructor(readonly a: string) { super() } }", "type F = (a: number, ...b: string[]) => a is B;\nlet x = <T,>(y: T): y is T => y as unknown as T;", "interface A { [k: string]: unknown; f?(): void; readonly g: A[] | null }", "enum E { A = 1, B }\ndeclare module 'x' { export const y: number }", "const m: Map<string, Array<number>> = new Map<string, Array<number>>();", "function f(x: string, y: number = 0): unknown { return x!; }\nabstract class Q { abstract z(): void; }"],
    "java": ["package a.b;\nimport static c.D.*;\npublic class X<T extends Y & Z> extends Q implements R<S> { private final Map<String, List<int[]>> m = new HashMap<>(); int f(final int... a) throws E { for (var x : y) { a[0] >>= 1; } return (int) (x) + (b) - 1; } }", "record P(int x, int y) {}\nsealed interface S permits T {}", "enum E { A(1) { }, B; int x; }", 'class A { String s = """\n  x"y\n  """; Runnable r = () -> { int z = switch (a) { case 1, 2 -> 3; default -> { yield 4; } }; }; }', "class A { static { synchronized (this) { } } @Override public <T> T g(T t) { return A.<T>h(t); } int[][] q = {{1}, {}}; }"],
    "go": ["package a\n\nimport (\n\t\"b\"\n\tc \"d\"\n)\n\nfunc (r *R[T]) F(a, b int, c ...string) (x int, err error) {\n\tif v, ok := m[k]; ok {\n\t\treturn\n\t}\n\tfor i := range 3 {\n\t\tgo func() {}()\n\t}\n\tswitch x := y.(type) {\n\tcase int, string:\n\t\tfallthrough\n\tdefault:\n\t}\n\treturn T{A: 1, B: []int{1, 2}}, nil\n}\n", "package a\ntype S[K comparable, V ~int | string] struct {\n\tX, Y int `json:\"x\"`\n\t*E\n}\nvar _ = map[string][]chan<- int{}\n"],
    "c": ["#include <x.h>\n#define A(b) \\\n  (b)\nstatic const yytype_int16 t[] = { 1, -2, };\nstruct s { int a : 3; union { char *b; } u; };\nint f(struct s *p, int (*g)(void), ...) { for (int i = 0; i < 3; i++) p->a = (char) g[i](&p, sizeof(*p)); switch (x) { case 1: default: break; } return '{'; }\n", "typedef unsigned long ul;\nul x = 0x1fUL, *y = &x;\nenum { A, B = 2 };\n"],
    "json": ["{\"a\": [1, -2.5e3, true, null, \"\\u00e9\"]}", " 1 "],
    "yaml": ["a: 1\nb:\n- x\n- y: 2\n  z: [1, {q: 'r'}]\nc: |\n  text: here\n   more\nd: \"x: y\"\n", "- a\n- - b\n  - c\n", "", "--- \na: &x b\n...\n---\nc: *x\n"],
    "toml": ["a = 1\n[b.c]\nd = [\n  'x', # c\n  \"y\",\n]\n[[e]]\nf = {g = 1979-05-27T07:32:00Z, h.i = true}\n", "x = '''\na = b\n'''\n"],
}
INVALID = {
    "python": ["def f(x)\n    pass\n", "x = (1,\n", "print 'a'\n", "name = \"never closed\n", "if x:\npass\n", "  x = 1\n", "<<<<<<< HEAD\nx = 1\n=======\n", "x = [1, 2)\n", '"""a', "if x:\n        a\n    b\n", "else:\n    pass\n", "x = = 1\n"],
    "javascript": ["const a = b(c, d;", "import { a } from 'b';", "let x: number = 1;", "function ( {", "const n = 'never closed\n", "if (a) {", "{\"a\": 1, \"b\": 2}", "x = `a${b", "<!DOCTYPE html>", "a b", "/* open"],
    "typescript": ["const a = b(c, d;", "interface { }", "function f(x: string {", "<<<<<<< HEAD\nlet a;", "class A { x: ; }"],
    "java": ["class A { int[] w = {0, 1]; }", "class A { public void int f( { }", "class A { int x = 1 }", "class A {", "package a", "def f(): pass", "class A { char c = 'ab'; }"],
    "go": ["package a\nfunc f( {\n}\n", "package a\nvar x = f(1, 2\n", "func f() {}\n", "package a\nfunc f() {\n\tif x \n\t{\n\t}\n}\n", "package a\nvar x = 'never'\n"],
    "c": ["int w[] = {0, 1];", "int f(int a { }", "int f() { return 0 }", "int f() {", "int x = \"a;\n"],
    "json": ["{'a': 1}", "{\"a\": 1,}", "[1, 2", "", "{\"a\": NaN}", "// c\n{}", "{} {}", "[01]", "{\"a\" 1}"],
    "yaml": ["a: 1\n<<<<<<< HEAD\nb: 2\n=======\n", "a: [1, 2\n", "a: \"x\nb: y\n", "a: b: c\n", "a: 1\n  b: 2\n", "\tx: 1\n", "a: 'x' y\n"],
    "toml": ["a =\n", "{\na = 1\n", "a = \"x\nb = 1\n", "[a\nb = 1\n", "a = 1 b = 2\n", "<<<<<<< HEAD\na = 1\n"],
}


@pytest.mark.parametrize("lang", sorted(VALID))
def test_valid(lang):
    assert [t for t in VALID[lang] if first_error(lang, t) is not None] == []


@pytest.mark.parametrize("lang", sorted(INVALID))
def test_invalid(lang):
    assert [t for t in INVALID[lang] if first_error(lang, t) is None] == []


def test_lines():
    assert first_error("py", "x = 1\ny = (\n'''a\nb'''\n)\nz = = 2\n") == 6
    assert first_error(" JS ", "a = `x\ny`\nb c\n") == 3
    assert first_error("yml", "a: 1\nb: 2\n  c: 3\n") == 3
    assert first_error("shell", "((((") is None and first_error(None, "x") is None and first_error("python", None) is None


@settings(max_examples=150, deadline=None)
@given(st.recursive(st.none() | st.booleans() | st.integers() | st.text(max_size=6), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(max_size=4), x, max_size=4), max_leaves=12), st.integers(0, 200), st.sampled_from(list('{}[],:"0a ')))
def test_json_like_the_reader(value, at, c):
    text = json.dumps(value, indent=1)
    for t in (text, text[: at % (len(text) + 1)], text[: at % (len(text) + 1)] + c + text[at % (len(text) + 1) :]):
        try:
            json.loads(t, parse_constant=lambda x: 1 / 0)
            ok = True
        except (ValueError, ZeroDivisionError):
            ok = False
        assert (first_error("json", t) is None) == ok, t


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.01/sync_files.parquet"), reason="test tables are not here")
@pytest.mark.parametrize("ext", [".py", ".toml", ".json"])
def test_like_the_library_parsers(ext):
    warnings.simplefilter("ignore")
    files = pd.read_parquet("/root/testdata/sf0.01/sync_files.parquet", columns=["path", "content"])
    read = {".py": ast.parse, ".toml": tomllib.loads, ".json": lambda t: json.loads(t, parse_constant=lambda x: 1 / 0)}[ext]
    n = 0
    for text in files.content[files.path.str.endswith(ext)].dropna():
        for t in (text, text[: len(text) * 2 // 3]):
            try:
                read(t)
                ok = True
            except (SyntaxError, ValueError, ZeroDivisionError):
                ok = False
            assert (first_error(ext, t) is None) == ok, t[-200:]
            n += 1
    assert n > 10


def test_frames(spark):
    pushed = spark.createDataFrame([(1, "w", "a.py", "x = 1\n", "q"), (2, "w", "a.py", "x = (", "q"), (3, "w", "b.json", None, "q"), (4, "w", "zz", "(", "q"), (5, None, "a.py", "(", "q")], "sync_id long, workspace_id string, path string, content string, language string")
    index = spark.createDataFrame([("w", "a.py", " Python "), ("w", "a.py", "py"), ("w", "b.json", "JSON"), ("w", "c", None)], "workspace_id string, path string, language string")
    rows = {r.sync_id: (r.language, r.valid, r.error_line) for r in checked(pushed, index, ["sync_id"], ["workspace_id", "path"]).collect()}
    assert rows == {1: ("python", True, None), 2: ("python", False, 1), 3: ("json", None, None), 4: (None, None, None), 5: (None, None, None)}
    assert [tuple(r) for r in rates(checked(pushed, index, ["sync_id"], ["workspace_id", "path"]), "workspace_id").collect()] == [("w", "python", 2, 1, 0.5)]
    assert checked(pushed.limit(0), index, ["sync_id"], ["workspace_id", "path"]).count() == 0


def test_fields_of_formatted_strings():
    good = ['f"{x}"', 'f"{x!r:>{w}}"', 'f"{d:%Y-%m-%d}"', "f\"{a['b']}\"", "f'{x = }'", "f'{x=!r:^20}'", 'f"{{}}{x}"', 'f"""{\nx}"""', 'f"{a!=b}"', 'f"{(lambda x: 1)}"', 'rf"\\d{x}"', 'f"{f"{y}"}"', 'f"{[i for i in x]}"', 'f"{ {1:2}[1] }"', 'f"{x:=10}"', 'f"\\{x}"', 'f"{x,}"']
    bad = ['f"{}"', 'f"{x"', 'f"}"', 'f"{x!z}"', 'f"{a b}"', 'f"{x +}"', 'f"{x:{}}"', 'f"{lambda x: 1}"', 'f"{!r}"', 'f"{(}"', 'f"{a.}"', 'f"{x!r y}"']
    for t in good + bad:
        src = f"a = 1\nv = {t}\n"
        try:
            ast.parse(src)
            valid = True
        except SyntaxError:
            valid = False
        assert (first_error("python", src) is None) == valid == (t in good), t
    assert first_error("python", "a = 1\nb = f'{a b}'\nc = 2\n") == 2
