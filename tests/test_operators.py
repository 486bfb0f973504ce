"""Expressions, intervals, reports, diffs, path assignment, comparison, graphs, discovery, pages, session and streams."""

import hashlib
import json
import struct

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from riskframe.api import RiskSession, exit_code
from riskframe.functions import expr as X
from riskframe.operators import calls, compare, coverage, discovery, graph, intervals, mutation, scope
from riskframe.plans import pages, reports
from riskframe.sources import coverage_reports, files, git, mutation_reports
from riskframe.streaming import upsert


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_score(spark):
    df = spark.createDataFrame([(5, 0.0, 30.0), (5, 100.0, 5.0), (10, 50.0, 22.5), (3, 150.0, 3.0), (3, None, 12.0)], "c int, cov double, want double")
    assert all(r[0] == r[1] for r in df.select(X.risk_score(F.col("c"), F.col("cov")), "want").collect())
    assert list(one(spark, X.round2(F.lit(1.005)), X.round2(F.lit(-0.125)), X.round2(F.lit(0.285)))) == [1.0, -0.13, 0.28]


def test_fingerprint(spark):
    fields = ["go", "aé😀", ""]
    raw = b"".join(struct.pack(">Q", len(f.encode())) + f.encode() for f in fields)
    assert one(spark, X.fingerprint(*[F.lit(f) for f in fields]))[0] == hashlib.sha256(raw).hexdigest()


def test_paths(spark):
    got = one(spark, *[X.normal_path(F.lit(p)) for p in ("./a\\b/../c/./d", "../x", "/a//b/", "a/../../b", "", ".", "a/..", "/../a", "/")])
    assert list(got) == ["a/c/d", "../x", "/a/b", "../b", ".", ".", ".", "/a", "/"]
    ranks = [("a/b.go", "a/b.go", 3), ("a/b.go", "x/a/b.go", 2), ("src/a/b.go", "a/b.go", 2), ("A/b.go", "x/a/B.go", 1), ("a/b.go", "za/b.go", 0)]
    assert [one(spark, X.path_match_rank(F.lit(a), F.lit(b)))[0] for a, b, _ in ranks] == [r for *_, r in ranks]
    assert [one(spark, X.valid_report_path(F.lit(p)))[0] for p in ("a/b", "/a", "C:/a", "a/../b", "")] == [True, False, False, False, False]
    globs = [("a/*", "a/b", True), ("a/*", "a/b/c", False), ("**/api", "x/y/api", True), ("**/api", "api", False), ("**api", "api", True), ("a?", "a", True), ("a?", "ab", True), ("", "x", True), ("a.b", "axb", False)]
    assert [one(spark, F.lit(s).rlike(X.glob_regex(g)))[0] for g, s, _ in globs] == [w for *_, w in globs]
    assert list(one(spark, *[X.rust_module_path(F.lit(p)) for p in ("src/lib.rs", "src/a/mod.rs", "x/src/a/b.rs")])) == ["crate", "crate::a", "crate::x::src::a::b"]
    assert one(spark, X.uri_escaped(F.lit("a b/ü#.go")))[0] == "a%20b/%C3%BC%23.go"


def test_text(spark):
    assert list(one(spark, F.octet_length(F.lit("aé😀")), X.utf16_length(F.lit("aé😀")), X.utf16_column(F.lit("aé😀x"), F.lit(8)))) == [7, 4, 5]
    assert [one(spark, X.line_count(F.lit(t)))[0] for t in ("", "a", "a\n", "a\nb", "\n\n")] == [0, 1, 1, 2, 2]
    assert one(spark, files.byte_offset(F.lit("é\nab"), F.lit(2), F.lit(2)))[0] == 4


def ranges(spark, data):
    return spark.createDataFrame(data, "file string, start_line int, end_line int")


def test_merge_and_overlap(spark):
    got = intervals.merge_ranges(ranges(spark, [("a", 3, 4), ("a", 5, 6), ("a", 8, 9), ("a", 1, 100), ("b", 3, 4), ("b", 6, 7), ("b", 9, 8)]), ["file"])
    assert sorted(map(tuple, got.collect())) == [("a", 1, 100), ("b", 3, 4), ("b", 6, 7)]
    c = spark.createDataFrame([(1, "a", 1, 1), (2, "a", 4, 7), (3, "a", 5, 7), (4, "a", 10, 200), (5, "b", 1, 9)], "id int, file string, start_line int, end_line int")
    assert sorted(r[0] for r in intervals.overlaps(c, ranges(spark, [("a", 2, 4), ("a", 8, 10), ("a", 150, 150)])).collect()) == [2, 4]


CALL = "id int, file string, start_line int, end_line int, depth int, start_byte int, end_byte int"


def test_ownership_and_coverage(spark):
    c = spark.createDataFrame([(1, "a", 1, 7, 0, 0, 70), (2, "a", 2, 4, 1, 10, 40), (3, "a", 9, 9, 0, 90, 95), (4, "a", 9, 9, 0, 96, 99)], CALL)
    owned = intervals.owned_ranges(c)
    assert sorted(map(tuple, owned.collect())) == [("a", 1, 1, 1), ("a", 1, 5, 7), ("a", 2, 2, 4), ("a", 3, 9, 9)]
    spans = spark.createDataFrame([("a", 3, 3, 1, True), ("a", 5, 5, 1, False), ("a", 6, 6, 1, True), ("a", 4, 5, 9, True), ("a", 9, 9, 0, True)], "file string, start_line int, end_line int, statements int, covered boolean")
    assert {r[0]: r[1] for r in intervals.covered_percent(spans, owned).collect()} == {1: 50.0, 2: 100.0, 3: None}


def test_coverage_reports(spark, tmp_path):
    p = tmp_path / "c.xml"
    p.write_text('<coverage><sources><source>/w/src</source></sources><packages><package><classes><class filename="a/b.cs"><lines><line number="10" hits="1"/><line number="11" hits="0"/></lines></class><class filename="a/b.cs"><lines><line number="11" hits="2"/></lines></class></classes></package></packages></coverage>')
    spans, aliases = coverage_reports.read_cobertura(spark, str(p))
    assert sorted((r["identity"], r["start_line"], r["covered"]) for r in spans.collect()) == [("a/b.cs", 10, True), ("a/b.cs", 11, True)]
    assert aliases.count() == 0  # an absolute folder outside the root
    spans, aliases = coverage_reports.read_cobertura(spark, str(p), "/w")
    assert [tuple(r) for r in aliases.collect()] == [("src/a/b.cs", "a/b.cs")]
    src = spark.createDataFrame([("/build/x",), ("rel",)], "source string")
    names = spark.createDataFrame([("/build/x/a.cs", 1, "1"), ("C:\\q\\b.cs", 1, "0"), ("c.cs", 1, "1"), ("/w/d.cs", 1, "1")], "filename string, number long, hits string")
    spans, aliases = coverage_reports.cobertura(names, src, "/w")
    got = sorted(r["identity"] for r in spans.collect())
    assert got[1:] == ["a.cs", "c.cs", "d.cs"] and got[0].startswith("_external/") and got[0].endswith("/b.cs")
    assert [tuple(r) for r in aliases.collect()] == [("rel/c.cs", "c.cs")]
    bad = spark.createDataFrame([("a", 0, "1")], "filename string, number long, hits string")
    with pytest.raises(PySparkException):
        coverage_reports.cobertura(bad)[0].collect()
    lines = lambda *x: spark.createDataFrame([(v,) for v in x], "value string")
    got = coverage_reports.go_profile(lines("mode: set", "m/a.go:10.1,12.2 2 0", "m/a.go:10.1,12.2 2 3", "m/a.go:10.6,12.2 1 0")).collect()
    assert sorted((r["start_column"], r["statements"], r["covered"]) for r in got) == [(1, 2, True), (6, 1, False)]
    for x in (("m/a.go:1.1,2.2 2 0", "m/a.go:1.1,2.2 1 0"), ("nonsense",)):
        with pytest.raises(PySparkException):
            coverage_reports.go_profile(lines(*x)).collect()


def test_diff(spark):
    text = 'diff --git a/x b/x\n--- a/x.go\n+++ b/x.go\n@@ -2,2 +2,3 @@\n-a\n-b\n+c\n+++ d\n+e\n@@ -10 +11,0 @@\n-z\ndiff\n--- a/g\n+++ /dev/null\n@@ -1 +0,0 @@\n-q\n--- "a/n\\303\\251w.go"\n+++ "b/n\\303\\251w.go"\n@@ -0,0 +1 @@\n+x\n'
    got = git.diff_ranges(spark.createDataFrame([(text,), (None,)], "diff string")).collect()
    assert sorted(map(tuple, got)) == [("néw.go", 1, 1), ("x.go", 2, 4), ("x.go", 11, 11)]
    for bad in ("+++ b/a\n@@ nope @@\n", '+++ "b/a\n@@ -1 +1 @@\n'):
        with pytest.raises(ValueError):
            git.parse_diff(bad)
    u = git.untracked_ranges(spark.createDataFrame([("a", "x\ny"), ("b", "")], "path string, text string"))
    assert [tuple(r) for r in u.collect()] == [("a", 1, 2)]


def test_path_assignment(spark):
    f = spark.createDataFrame([(x,) for x in ("src/a.go", "lib/b.go", "Lib/C.go", "x/d.go", "y/d.go", "q/none.go")], "file string")
    i = spark.createDataFrame([(x,) for x in ("src/a.go", "build/lib/b.go", "lib/c.go", "d.go")], "identity string")
    got = {r["file"]: (r["kind"], r["identity"], r["candidates"]) for r in coverage.assign_paths(f, i).collect()}
    assert got == {
        "src/a.go": ("exact", "src/a.go", []), "lib/b.go": ("suffix", "build/lib/b.go", []), "Lib/C.go": ("case-folded", "lib/c.go", []),
        "x/d.go": ("ambiguous", None, ["d.go"]), "y/d.go": ("ambiguous", None, ["d.go"]), "q/none.go": ("unmatched", None, []),
    }
    alias = spark.createDataFrame([("p/z.go", "other")], "alias string, identity string")
    g = coverage.assign_paths(spark.createDataFrame([("p/z.go",)], "file string"), i.limit(0), alias).first()
    assert (g["kind"], g["identity"]) == ("exact", "other")
    d = coverage.match_diagnostics(coverage.assign_paths(f, i))
    assert sorted(r["code"] for r in d.collect()) == ["coverage-path-ambiguous"] * 2 + ["coverage-path-case-folded", "coverage-path-suffix-matched", "coverage-path-unmatched"]
    assert coverage.first_failure(d).first()["path"] == "q/none.go"


ROW = "id string, language string, kind string, name string, signature string, file string, complexity int, coverage_percent double, risk double, above_threshold boolean, content_sha256 string, coverage_format string, coverage_state string"


def side(spark, *data):
    return spark.createDataFrame([(i, "go", "function", n, "s", f, c, cov, risk, risk > 30, sha, "x", "measured" if cov is not None else "absent") for i, n, f, c, cov, risk, sha in data], ROW)


def test_compare(spark):
    b = side(spark, ("1", "moved", "a", 5, 0.0, 30.0, "x"), ("2", "gone", "a", 1, 0.0, 2.0, "x"), ("3", "same", "a", 1, 0.0, 2.0, "x"), ("4", "twin", "a", 1, 0.0, 2.0, "x"), ("5", "twin", "b", 1, 0.0, 2.0, "x"))
    c = side(spark, ("9", "moved", "z", 10, 0.0, 110.0, "y"), ("3", "same", "a", 1, 0.0, 2.0, "x"), ("7", "new", "a", 9, 0.0, 90.0, "q"), ("4", "twin", "a", 1, 0.0, 2.0, "x"), ("6", "twin", "c", 1, 0.0, 2.0, "x"))
    rows = compare.compared(b, c)
    got = sorted((r["status"], r["strategy"], r["change"], r["regression"], tuple(r["reasons"])) for r in rows.collect())
    assert got == sorted(
        [
            ("matched", "declaration", "moved-modified", True, ("complexity-increased", "risk-increased", "threshold-crossed")),
            ("matched", "id", "unchanged", False, ()), ("removed", None, None, False, ()), ("added", None, None, True, ("added-above-threshold",)), ("ambiguous", None, None, False, ()),
        ],
        key=repr,
    )
    s = compare.comparison_summary(rows).first()
    assert (s["matched"], s["added"], s["removed"], s["ambiguous"], s["regressions"], s["complete"]) == (2, 1, 1, 1, 2, False)
    ids = [r["comparison_id"] for r in rows.collect()]
    assert len(set(ids)) == 5 and sorted(ids) == sorted(r["comparison_id"] for r in compare.compared(b.repartition(3), c.repartition(2)).collect())


EDGE = "id string, type string, from_id string, to_id string, occurrences int"


def imports(spark, pairs):
    return spark.createDataFrame([(f"{a}{b}", "imports", a, b, 1) for a, b in pairs], EDGE)


def tarjan(pairs):
    nodes = {x for p in pairs for x in p}
    out = {n: {b for a, b in pairs if a == n} for n in nodes}

    def reach(n):
        seen, stack = set(), [n]
        while stack:
            for m in out[stack.pop()]:
                if m not in seen:
                    seen.add(m)
                    stack.append(m)
        return seen

    r = {n: reach(n) for n in nodes}
    return {n: min(m for m in nodes if m in r[n] and n in r[m]) for n in nodes if n in r[n]}


def test_components(spark):
    import random

    rng = random.Random(3)
    cases = [[("a", "b"), ("b", "c")], [("a", "b"), ("b", "c"), ("c", "a")], [("a", "b"), ("b", "a"), ("b", "c"), ("c", "b"), ("c", "d")], [("s", "s"), ("s", "t")], []]
    cases.append([(f"{rng.randrange(18):02d}", f"{rng.randrange(18):02d}") for _ in range(30)])
    for pairs in cases:
        got = {r["node"]: r["component"] for r in graph.cyclic_components(imports(spark, pairs)).collect()}
        assert got == tarjan(pairs), pairs


def test_witness(spark):
    e = imports(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("b", "a"), ("c", "d")])
    w = graph.cycle_witnesses(e, graph.cyclic_components(e)).orderBy("pos").collect()
    assert [(r["from_id"], r["to_id"]) for r in w] == [("a", "b"), ("b", "c"), ("c", "a")] or [(r["from_id"], r["to_id"]) for r in w] == [("a", "b"), ("b", "a")]
    assert w[0]["modules"] == ["a", "b", "c"]


def test_neighborhood(spark):
    n = spark.createDataFrame([(x, "file") for x in "abcdefg"], "id string, kind string")
    e = imports(spark, [("a", "b"), ("a", "c"), ("b", "d"), ("d", "e"), ("f", "a"), ("c", "b")])
    kept, edges, omitted = graph.neighborhood(n, e, ["a"], direction="outgoing", depth=2, max_nodes=3)
    assert sorted(map(tuple, kept.collect())) == [("a", 0), ("b", 1), ("c", 1)]
    assert sorted(r["id"] for r in edges.collect()) == ["ab", "ac", "cb"] and omitted == (1, 1)
    kept, edges, _ = graph.neighborhood(n, e, ["a"], depth=5, max_edges=1)
    assert len(kept.collect()) == 2 and edges.count() == 1
    for bad in ({"depth": 6}, {"direction": "up"}, {"edge_types": ("calls",)}):
        with pytest.raises(ValueError):
            graph.neighborhood(n, e, ["a"], **bad)
    with pytest.raises(ValueError):
        graph.neighborhood(n, e, ["zz"])


def test_affected_tests(spark):
    e = imports(spark, [("T1", "x"), ("x", "seed"), ("T2", "seed"), ("y", "x"), ("x", "y"), ("T3", "other")])
    ids = lambda *x: spark.createDataFrame([(v,) for v in x], "id string")
    got = {r["test"]: (r["distance"], r["seeds"]) for r in graph.affected_tests(e, ids("seed", "T2"), ids("T1", "T2", "T3")).collect()}
    assert got == {"T1": (2, ["seed"]), "T2": (1, ["T2", "seed"])}


def test_resolution(spark):
    refs = [
        ("1", "go-import", "m/a", "", "s", "x.go"), ("2", "go-import", "C", "", "s", "x.go"), ("3", "go-import", "m/a_test", "", "s", "x.go"),
        ("4", "typescript-import", "./y", "", "s", "src/x.ts"), ("5", "typescript-import", "react", "", "s", "src/x.ts"), ("6", "typescript-import", "../../q", "", "s", "src/x.ts"), ("7", "typescript-import", "./z.css", "", "s", "src/x.ts"),
        ("8", "rust-use", "crate::a::b::Item", "", "s", "src/lib.rs"), ("9", "rust-use", "super::b::F", "", "s", "src/a/c.rs"), ("10", "rust-use", "std::io", "", "s", "src/a.rs"), ("11", "rust-use", "super::super::x", "", "s", "src/a.rs"),
        ("12", "csharp-using", "C", "A.B", "s", "x.cs"), ("13", "csharp-using", "Z", "A", "s", "x.cs"), ("14", "go-import", "two", "", "s", "x.go"), ("15", "typescript-import", "./s", "", "s", "src/x.ts"), ("16", "other", "x", "", "s", "q"),
    ]
    r = spark.createDataFrame(refs, "id string, kind string, specifier string, scope string, source_module string, path string").withColumn("reason", F.lit(""))
    mods = [("ga", "m/a", "go-package", ""), ("gt", "m/a_test", "go-package", "x_test"), ("ty", "src/y/index.ts", "ts", ""), ("rb", "crate::a::b", "rust", ""), ("c1", "A.C", "cs", ""), ("c2", "A.B.C", "cs", ""), ("t1", "two", "go-package", ""), ("t2", "two", "go-package", "v"), ("s", "src/s.ts", "ts", "")]
    m = spark.createDataFrame(mods, "module_id string, name string, system string, variant string")
    got = {x["id"]: (x["resolution"], x["target"], x["reason"]) for x in graph.resolve_references(r, m).collect()}
    assert got == {
        "1": ("resolved", "ga", ""), "2": ("unresolved", None, "cgo-pseudo-package"), "3": ("unresolved", None, "outside-selected-sources"),
        "4": ("resolved", "ty", ""), "5": ("unresolved", None, "non-relative-specifier"), "6": ("unresolved", None, "path-escapes-root"), "7": ("unresolved", None, "unsupported-extension"),
        "8": ("resolved", "rb", ""), "9": ("resolved", "rb", ""), "10": ("unresolved", None, "non-crate-specifier"), "11": ("unresolved", None, "path-escapes-crate-root"),
        "12": ("resolved", "c1", ""), "13": ("unresolved", None, "namespace-target-not-found"), "14": ("ambiguous", None, "multiple-candidates"), "15": ("unresolved", None, "outside-selected-sources"), "16": ("unresolved", None, "unsupported-reference-kind"),
    }


def test_forbidden(spark):
    names = spark.createDataFrame([("1", "go/x/api", "go"), ("2", "go/x/db", "go"), ("3", "ts/ui", "ts")], "id string, name string, system string")
    got = graph.forbidden(imports(spark, [("1", "2"), ("2", "1"), ("3", "2")]), names, [{"from": "**/api", "to": "**/db", "reason": "layers"}, {"to": "**/db", "system": "ts"}])
    assert sorted((r["from"], r["to"], r["rule"], r["reason"]) for r in got.collect()) == [("go/x/api", "go/x/db", 0, "layers"), ("ts/ui", "go/x/db", 1, "")]


def test_containment_and_rollup(spark):
    t = spark.createDataFrame([("f", 0, "T", "file", 0)], "file string, index int, id string, parent_kind string, parent_index int")
    c = spark.createDataFrame([("f", 0, "m", "type", 0), ("f", 1, "lam", "callable", 0)], "file string, index int, id string, parent_kind string, parent_index int")
    assert sorted((r["type"], r["to_id"]) for r in graph.containment(t, c).collect()) == [("contains", "T"), ("contains", "lam"), ("declares", "m")]
    items = spark.createDataFrame([("f", "callable", 5, 50.0, 10.0, True), ("f", "callable", 7, None, 20.0, False), ("f", "type", None, None, None, None)], "file string, kind string, complexity int, coverage_percent double, risk double, above_threshold boolean")
    m = spark.createDataFrame([("A", "f"), ("B", "f"), ("E", None)], "module_id string, file string")
    got = {r["module_id"]: r.asDict() for r in graph.module_rollup(m, items).collect()}
    assert got["A"] | {"module_id": "B"} == got["B"] and got["A"]["total_complexity"] == 12 and got["A"]["average_coverage"] == 50.0 and got["A"]["types"] == 1
    assert got["E"]["files"] == 0 and got["E"]["callables"] == 0 and got["E"]["average_coverage"] is None and got["E"]["maximum_risk"] == 0.0


def test_calls(spark):
    facts_ = spark.createDataFrame([("static", "a", "b", "f", i // 2, 1, 100 - i) for i in range(60)] + [("static", "a", None, "f", 1, 1, 0)], "kind string, caller string, callee string, path string, line int, column int, seq int")
    r = calls.call_edges(facts_).first()
    assert r["occurrences"] == 60 and len(r["call_sites"]) == 25 and r["truncated"] and r["call_sites"][0]["line"] == 5
    page, total = calls.unresolved_calls(facts_.withColumn("reason", F.lit(None).cast("string")))
    assert page.count() == 1 and not total.first()["truncated"]
    inv = spark.createDataFrame([("z", "a_test.go", 1, 1, True), ("y", "a_test.go", 1, 1, False)], "id string, file string, start_line int, start_column int, changed boolean")
    fn = calls.functions(spark.createDataFrame([("a_test.go", 1, 1, "p.TestX"), ("b.go", 2, 1, "p.TestY")], "path string, line int, column int, name string"), inv)
    assert sorted((f["name"], f["matched"], f["test"]) for f in fn.collect()) == [("p.TestX", True, True), ("p.TestY", False, False)]
    d = calls.dispatch_facts(spark.createDataFrame([("c", "I", "m", "f", 1, 1, 1)], "caller string, interface string, method string, path string, line int, column int, seq int"), spark.createDataFrame([("I", "T"), ("I", "U")], "interface string, type string"), spark.createDataFrame([("T", "m", "Tm"), ("U", "m", "Um")], "type string, method string, id string"))
    assert sorted(r["callee"] for r in d.collect()) == ["Tm", "Um"]


def test_mutation(spark, tmp_path):
    doc = {"schemaVersion": "1.0", "files": {"src/a.ts": {"language": "ts", "mutants": [{"id": str(i), "mutatorName": "m", "status": s, "location": {"start": {"line": i, "column": 1}, "end": {"line": i, "column": 9}}} for i, s in enumerate(["Killed", "Timeout", "Survived", "NoCoverage", "CompileError"], 1)]}}}
    (tmp_path / "s.json").write_text(json.dumps(doc))
    read = lambda: spark.read.schema(mutation_reports.STRYKER).option("multiLine", "true").json(str(tmp_path / "s.json"))
    m = mutation_reports.stryker_mutants(read())
    s = mutation.mutation_score(mutation.mutation_summary(m), 50.0).first()
    assert s["score"] == 50.0 and s["passed"] and s["total"] == 5
    assert pages.ordered(mutation.chosen(m), "mutants").first()["native_id"] == "3"
    other = json.loads(json.dumps(doc).replace('"Killed"', '"Survived"').replace('"id": "1"', '"id": "77"'))
    (tmp_path / "s.json").write_text(json.dumps(other))
    assert sorted(r["id"] for r in mutation_reports.stryker_mutants(read()).collect()) == sorted(r["id"] for r in m.collect())
    (tmp_path / "s.json").write_text(json.dumps(doc).replace("src/a.ts", "../a.ts"))
    with pytest.raises(PySparkException):
        mutation_reports.stryker_mutants(read()).collect()
    g = {"go_module": "m", "files": [{"file_name": "a.go", "mutations": [{"line": 1, "column": 2, "type": "T", "status": s} for s in ("KILLED", "KILLED", "LIVED", "NOT VIABLE")]}]}
    (tmp_path / "g.json").write_text(json.dumps(g))
    gm = mutation_reports.gremlins_mutants(spark.read.schema(mutation_reports.GREMLINS).option("multiLine", "true").json(str(tmp_path / "g.json")))
    s = mutation.mutation_score(mutation.mutation_summary(gm), 70.0).first()
    assert s["score"] == 66.67 and not s["passed"] and gm.first()["end_line"] is None
    rep = spark.createDataFrame([(2, 1, 1, 66.6666, 4), (2, 1, 1, 50.0, 4)], "killed int, survived int, compileError int, reported_efficacy double, reported_total int")
    assert mutation.efficacy_faults(rep).count() == 1
    assert mutation.mutation_score(mutation.mutation_summary(gm.limit(0))).first()["score"] is None
    with pytest.raises(ValueError):
        mutation.chosen(gm, ["killed"], "summary")


def test_discovery(spark):
    names = ["keep.go", "nested/keep.ts", "nested/drop.ts", "a_test.go", "x.gen.ts", "vendor/v.go", "a/vendor/v.go", "a/node_modules/q.ts", "tool/t.go", "ex/e.go", "n.py", "tests/t.rs", "nested/logs/l.ts", "y.g.cs"]
    f = spark.createDataFrame([(n, False) for n in names] + [("a_test.go", True)], "path string, explicit boolean")
    got = {r["path"]: r["reason"] for r in discovery.discover(f, excludes=["ex/"], tool_ignore="/tool\n", gitignores={"": "*.ts\n!keep.ts\n# c\n", "nested": "logs/\n!logs/l.ts"}).collect()}
    assert got == {
        "keep.go": None, "nested/keep.ts": None, "nested/drop.ts": "gitignore", "a_test.go": None, "x.gen.ts": "gitignore", "y.g.cs": "generated", "vendor/v.go": "built-in-directory", "a/vendor/v.go": None,
        "a/node_modules/q.ts": "built-in-directory", "tool/t.go": "tool-ignore", "ex/e.go": "explicit-exclude", "n.py": "unsupported", "tests/t.rs": "test", "nested/logs/l.ts": None,
    }
    df = discovery.exclusions(spark.createDataFrame([(f"p{i}", "test") for i in range(9)], "path string, reason string")).first()
    assert df["count"] == 9 and df["examples"] == ["p0", "p1", "p2", "p3", "p4"]
    assert [one(spark, discovery.selected(F.lit(p), ["a/", "b.go"]))[0] for p in ("a/x", "ab", "b.go")] == [True, False, True]


def test_scan(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.go").write_text("package a\n")
    (tmp_path / "n.txt").write_text("x")
    got = files.scan_sources(spark, str(tmp_path)).collect()
    assert [(r["path"], r["sha256"]) for r in got] == [("d/a.go", hashlib.sha256(b"package a\n").hexdigest())]
    assert files.explicit_sources(spark, str(tmp_path), ["d/a.go"]).first()["explicit"]
    with pytest.raises(ValueError):
        files.explicit_sources(spark, str(tmp_path), ["n.txt"])
    assert one(spark, files.go_module(F.lit("// x\nmodule ex.test/m\ngo 1.2\n")))[0] == "ex.test/m"


def test_pages_and_reports(spark, tmp_path):
    df = spark.range(50).select(F.col("id").cast("string").alias("id"), (F.col("id") % 7).cast("double").alias("risk"), (F.col("id") % 7 > 3).alias("above_threshold"), F.lit("a b.go").alias("file"), F.lit(3).alias("start_line"), F.lit(1).alias("start_column"), F.lit("m").alias("message"))
    assert [r["id"] for r in pages.page(df, [F.desc("risk"), "id"], 0, 3).collect()] == ["13", "20", "27"]
    assert pages.in_mode(df, "summary").count() == 0 and pages.in_mode(df, "violations").count() == 21
    with pytest.raises(ValueError):
        pages.page(df, ["id"], 0, 101)
    with pytest.raises(ValueError):
        pages.bounded(df, 49, "rows")
    c = pages.cursor(b"k", "s", "all", 20)
    assert pages.cursor_offset(b"k", c, "s", "all") == 20
    for args in ((b"z", c, "s", "all"), (b"k", c, "t", "all"), (b"k", c[:-2] + "AA", "s", "all")):
        with pytest.raises(ValueError):
            pages.cursor_offset(*args)
    log = json.loads(reports.sarif_log(reports.sarif_results(df.limit(2), "RISK001", "warning"), [{"id": "RISK001"}]))
    assert log["runs"][0]["results"][0]["locations"][0]["physicalLocation"]["artifactLocation"]["uri"] == "a%20b.go"
    doc = json.loads(reports.json_report({"v": "1"}, rows=df.limit(1)))
    assert doc["rows"][0]["file"] == "a b.go"
    out = tmp_path / "r.json"
    reports.write_text(str(out), "x")
    link = tmp_path / "l.json"
    link.symlink_to(out)
    with pytest.raises(ValueError):
        reports.write_text(str(link), "y")
    with pytest.raises(ValueError):
        reports.inside(str(tmp_path), "../x")
    assert reports.config_fingerprint({"a": "<"}) == hashlib.sha256(b'{"a":"\\u003c"}').hexdigest()
    assert [exit_code(True), exit_code(False), exit_code(True, True)] == [0, 1, 2]


def test_session(spark):
    s = RiskSession(spark, threshold=5.0)
    src = spark.createDataFrame([("a.go", bytearray(b"package p\nfunc F(a int) {\n\tif a > 1 {\n\t}\n}\nfunc G() {}\n"))], "path string, content binary")
    name = s.analyze(src, ranges=ranges(spark, [("a.go", 3, 3)]))
    rows, total, cursor = s.page(name, "methods", limit=1)
    assert total == 2 and rows[0]["name"] == "p.F" and rows[0]["changed"] and rows[0]["risk"] == 6.0
    rows, _, end = s.page(name, "methods", limit=1, cursor=cursor)
    assert rows[0]["name"] == "p.G" and end is None and not s.gate(name)
    for _ in range(8):
        s.graph(spark.createDataFrame([("a", "file")], "id string, kind string"), imports(spark, [("a", "a")]))
    with pytest.raises(KeyError):
        s.parts(name)


def test_scope(spark):
    r = scope.changed_ranges(ranges(spark, [("a", 1, 2)]), ranges(spark, [("a", 3, 3)]))
    assert [tuple(x) for x in r.collect()] == [("a", 1, 3)]


def test_streams(spark, tmp_path):
    rows = lambda data: spark.createDataFrame(data, "id string, v int, x string")
    rows([("a", 1, "old"), ("b", 1, "b")]).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id string, v int, x string").parquet(str(tmp_path / "in"))
    run = lambda: upsert.upsert_stream(stream, ["id"], ["v"], str(tmp_path / "state"), str(tmp_path / "cp")).start().awaitTermination(120)
    run()
    rows([("a", 2, "new")]).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "state/generation=1")).select("id", "v", "x").collect())) == [("a", 2, "new"), ("b", 1, "b")]


def test_windows(spark, tmp_path):
    import datetime as dt

    t = lambda m: dt.datetime(2026, 1, 1, 10, m)
    spark.createDataFrame([(t(1), "a", 1.0), (t(2), "a", 2.0), (t(7), "b", 4.0), (t(59), "a", 0.0)], "ts timestamp, event_type string, value double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(str(tmp_path / "in"))
    q = upsert.risk_windows(stream).writeStream.format("memory").queryName("windows").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r["event_type"], r["window"]["start"].minute): (r["n"], r["value"]) for r in spark.table("windows").collect()}
    assert got.get(("a", 0)) == (2, 3.0) and got.get(("b", 5)) == (1, 4.0)


def test_peeled_cycles_take_linear_time():
    import time

    n = 20_000
    pairs = [(f"{i:06d}", f"{i + 1:06d}") for i in range(n)] + [(f"{i + 1:06d}", f"{i:06d}") for i in range(n)]
    began = time.time()
    assert sorted(graph.peeled_cycles(pairs)) == sorted(pairs) and time.time() - began < 10


def test_affected_tests_over_long_ways(spark):
    e = spark.createDataFrame([(f"c{i + 1}", f"c{i}") for i in range(1500)] + [("c700", "c5"), ("x", "y"), ("y", "x"), ("w", "x"), ("c9", "c9")], "from_id string, to_id string")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    got = {r["test"]: (r["distance"], r["seeds"]) for r in graph.affected_tests(e, ids("c0", "c3", None), ids("c1500", "c3", "x", "c700", "c9")).collect()}
    assert got == {"c1500": (803, ["c0", "c3"]), "c3": (3, ["c0", "c3"]), "c700": (3, ["c0", "c3"]), "c9": (6, ["c0", "c3"])}


def test_path_candidates_with_many_equal_names(spark):
    files_ = spark.range(10_000).selectExpr("'src/d' || id || '/index.ts' as file")
    identities = spark.range(10_000).selectExpr("'D' || id || '/index.ts' as identity")
    got = coverage.path_candidates(files_, identities)
    assert got.count() == 10_000 and got.where("rank = 1").count() == 10_000


def test_compare_with_a_hot_declaration(spark):
    row = "'go' as language, 'function' as kind, 'main' as name, 'main()' as signature, 1 as complexity, cast(null as double) as coverage_percent, 2.0D as risk, false as above_threshold, 'x' as content_sha256, '' as coverage_format, 'absent' as coverage_state"
    split = lambda sql: [x.strip() for x in sql.split(", ")]
    many = lambda n, p: spark.range(n).selectExpr(f"'{p}' || id as id", f"'{p}' || id as file", *split(row))
    b, c = many(100_000, "b"), many(100_001, "c")
    r = compare.compared(b, c).collect()
    assert [(x["status"], x["baseline_rows"], x["current_rows"], x["baseline"]) for x in r] == [("ambiguous", 100_000, 100_001, [])]
    assert compare.ambiguous_rows(b, c).count() == 200_001
    assert compare.compared(b.limit(0), c.limit(0)).count() == 0
