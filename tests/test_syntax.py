"""Parsers: valid and broken sources, callables with lines and complexity, identities."""

import pytest

from riskframe.operators import facts
from riskframe.syntax import extension, parse

GOOD = {
    "go": ["package a\n", "package a\nimport x \"y\"\ntype P[K comparable, V any] struct { m map[K][]V `j:\"x\"`; *Q }\nfunc (p *P[K, V]) F(a, b int, c ...string) (n int, err error) {\n\tif v, ok := p.m[k]; ok && v[0] > 1 { goto end }\n\tfor i := range 10 { select { case x := <-ch: _ = x; default: } }\nend:\n\treturn T{A: []int{1, 2}[0]}.n, nil\n}\n"],
    "rs": ["", "impl<'a, T: Fn(&str) -> u8 + 'a> X<'a, T> where T: Clone { pub(crate) async fn f(&mut self, (a, b): (u8, u8)) -> Result<Vec<Vec<u8>>, ()> { 'o: loop { if let Some(x) = a.b::<u8>()? { break 'o; } } match x { 1..=3 | 7 if a => {}, S { x, .. } => (), _ => unreachable!(), } Ok(vec![1]) } }\n"],
    "ts": ["", "export class A<T extends B = C> extends D<T> { #p = 1; static async *g<K>(this: T, @x() a?: number): AsyncGenerator<K> { yield* a ?? `${b ? `x${1}` : '}'}` } }\ntype M = { readonly [K in keyof T as `a${K}`]?: T[K] extends (infer U)[] ? U : never }\nconst f = <T,>(x: T) => /[/]}/g.test(x) ? a < b : c > (d)\nlet x = y as const\n++z\n"],
    "tsx": ["const v = <T,>(p: { a: T }) => <div className=\"x\" {...p}>it's {p.a /* c */} &nbsp;<></><A.B c=<i/> /></div>;\n"],
    "cs": ["", "namespace X;\n#if NEVER\n garbage ' \" {\n#endif\npublic record R<T>(int A, string? B = null) : Base(A), I where T : class, new() { public int this[int i] => i; int F() => x switch { > 1 and < 5 => 1, { P: [1, .., 2] } when y is not null => 2, _ => throw new() }; }\n", "using var s = new Foo { A = $\"{x,5:N2}{{}}{(y ? \"a\" : @\"b\"\"\")}\", [\"k\"] = \"\"\"raw \"q\" \"\"\" };\nvar q = from a in b join c in d on a.X equals c.Y where a.Z > 1 orderby a descending select new { a, c.W };\nawait F<int, string>(x as int? ?? 3);\n"],
}
BAD = {
    "go": ["", "func f() {}\n", "package a\nfunc f() {\n", "package a\nfunc f() {\n<<<<<<< HEAD\n\tx()\n}\n", "package a\nvar s = \"abc\n", "package a\nfunc f() { x = ) }\n", "package a\n}\n", "package a\nfunc f() { if { } }\n"],
    "rs": ["fn f( {}\n", "fn f() { let x = 1 }\n}\n", "fn f() {\n=======\n}\n", "/* open", "fn f() { \"x }\n", "def f(x):\n    pass\n", "fn f() { match x { 1 => 2 3 => 4 } }\n"],
    "ts": ["class A {\n", "const a = <b>x</b>;\n", "let s = 'abc\n", "f(`a${b`)\n", "}\n", "if (a { }\n", "import x fom 'y';\n", "def f(x):\n    pass\n"],
    "tsx": ["const a = <b>x</c>;\n", "const a = <b x={1>y</b>;\n"],
    "cs": ["class A {\n", "class A { void F() { x = ; } }\n", "#endif\n", "class A { int P { got; } }\n", "class A { string s = \"x; }\n", "use a::b;\n#[x]\n", "class A { void F() { var x = $\"{a b}\"; } }\n"],
}


@pytest.mark.parametrize("ext", GOOD)
def test_good(ext):
    for s in GOOD[ext]:
        assert parse(s.encode(), ext).errors == [], s
        assert parse(b"\xef\xbb\xbf" + s.replace("\n", "\r\n").encode(), ext).errors == [], s


@pytest.mark.parametrize("ext", BAD)
def test_bad(ext):
    for s in BAD[ext]:
        assert parse(s.encode(), ext).errors, s


def test_recovery_keeps_later_facts():
    r = parse(b"package a\n\nfunc one() {\n\tx = )\n\ty()\n}\n\nfunc two() { if a { } }\n", "go")
    assert [(c["name"], c["complexity"]) for c in r.callables] == [("a.one", 1), ("a.two", 2)]
    assert r.errors[0][:3] == ("unexpected-token", 4, 6)


def test_bytes_and_nesting():
    assert parse(b"package a\n// \xff\n", "go").errors[0][0] == "bad-encoding"
    assert parse(b"let x = 1\n\x00", "ts").errors
    deep = "let x = " + "(" * 3000 + "1" + ")" * 3000
    assert parse(deep.encode(), "ts").errors == []
    assert extension("a/b.TSX") == "tsx" and extension("a/go") is None and extension(None) is None and extension("x.js") is None


GOLDEN = {
    "go": ("package p\n\ntype S struct{}\n\nfunc (s *S) Run(n int) int {\n\th := func(v int) int {\n\t\tif v > 0 && ok {\n\t\t\treturn v\n\t\t}\n\t\treturn 0\n\t}\n\tswitch n {\n\tcase 1, 2:\n\tdefault:\n\t}\n\treturn h(n)\n}\n\nfunc Use() {\n\tdo(func() bool { return a || b })\n}\n",
           [("p.(*S).Run", "method", 5, 17, 2), ("p.h", "function_literal", 6, 11, 3), ("p.Use", "function", 19, 21, 1), ("p.<anonymous@20:5>", "function_literal", 20, 20, 2)]),
    "rs": ("mod m {\n    impl T for W {\n        fn run(&self) -> R {\n            let c = |x: i32| x > 0 && y;\n            match z {\n                1 => {}\n                _ => {}\n            }\n            q()?;\n            v.filter(|e| e > 1);\n        }\n    }\n}\n",
           [("m::<W as T>::run", "function", 3, 11, 3), ("m::<W as T>::c", "closure", 4, 4, 2), ("m::<W as T>::<anonymous@10:22>", "closure", 10, 10, 1)]),
    "ts": ("namespace N {\n  export function f(a: boolean): number {\n    const g = (v: number): number => a && v > 0 ? v : 0;\n    return g(1);\n  }\n  class W {\n    run(): void {\n      try { if (x) return; } catch { }\n    }\n  }\n}\n",
           [("N.f", "function", 2, 5, 1), ("N.g", "arrow_function", 3, 3, 3), ("N.W.run", "method", 7, 9, 3)]),
    "cs": ("namespace A;\n\nclass C\n{\n    int P => r ? 1 : 0;\n    int Q { get; } = r ? 1 : 0;\n    void M()\n    {\n        F<int> c = v => {\n            if (v > 0) return v;\n            return 0;\n        };\n        F<int> d = delegate(int v) { while (v > 0) v--; return v; };\n        Use(v => v > 0 ? v : 0);\n    }\n}\n",
           [("A.C.P", "property", 5, 5, 2), ("A.C.Q.get", "accessor", 6, 6, 1), ("A.C.M", "method", 7, 15, 1), ("A.C.c", "lambda", 9, 12, 2), ("A.C.d", "anonymous_method", 13, 13, 2), ("A.C.<anonymous@14:13>", "lambda", 14, 14, 2)]),
}


@pytest.mark.parametrize("ext", GOLDEN)
def test_callables(ext):
    src, want = GOLDEN[ext]
    r = parse(src.encode(), ext)
    assert r.errors == []
    assert [(c["name"], c["kind"], c["start_line"], c["end_line"], c["complexity"]) for c in r.callables] == want


def test_references():
    r = parse(b"use a::{b as c, d::{self, *}};\nmod x { use super::y; }\n", "rs")
    assert [(x["specifier"], x["binding"], x["scope"]) for x in r.references] == [("a::b", "c", "crate"), ("a::d::self", "self", "crate"), ("a::d", "*", "crate"), ("super::y", "y", "crate::x")]
    r = parse(b"import a from './x'; import type { B } from \"y\"; export * from './z'; import q = require('w'); import 's';", "ts")
    assert [(x["kind"], x["specifier"]) for x in r.references] == [("import", "./x"), ("import", "y"), ("re-export", "./z"), ("import-require", "w"), ("side-effect", "s")]
    r = parse(b"using System; using static A.B; using X = C.D<int>;\nnamespace N { namespace M { } }", "cs")
    assert [(x["kind"], x["specifier"]) for x in r.references] == [("using", "System"), ("using-static", "A.B"), ("using-alias", "C.D<int>")]
    assert [m["name"] for m in r.modules] == ["N", "N.M"]


def ids(spark, text):
    df = spark.createDataFrame([("a.go", bytearray(text.encode()))], "path string, content binary")
    return {r["name"]: r["id"] for r in facts.with_ids(facts.facts(df, "callables")).collect()}


def test_ids_survive_edits(spark):
    a = ids(spark, "package p\n\nfunc f(x int) int { return 1 }\n\nfunc g() {}\n")
    b = ids(spark, "package p\n\n\n// note\nfunc f(x  int) int {\n\tif x > 1 { return 2 }\n\treturn 1\n}\n\nfunc g() { h() }\n")
    assert a == b and len(a) == 2
    assert ids(spark, "package p\nfunc f(y int) int { return 1 }\n")["p.f"] != a["p.f"]


def test_syntax_gate(spark):
    df = spark.createDataFrame([("b.go", bytearray(b"x")), ("a.rs", bytearray(b"fn f(")), ("c.ts", bytearray(b"1")), ("n.py", bytearray(b"(")), ("z.go", None)], "path string, content binary")
    assert facts.first_syntax_error(df).first()["path"] == "a.rs"
    assert sorted(r["path"] for r in facts.syntax_errors(df).collect()) == ["a.rs", "b.go"]
