"""Git helper and command line over a small repository."""

import json
import subprocess

import pytest

from riskframe import __main__ as cli
from riskframe.api import RiskSession
from riskframe.operators import facts
from riskframe.sources import files, gitcli


@pytest.fixture
def repo(tmp_path):
    root = tmp_path / "r"
    root.mkdir()
    g = lambda *a: subprocess.run(["git", "-c", "user.name=t", "-c", "user.email=t@t", "-C", str(root), *a], check=True, capture_output=True)
    g("init", "-q")
    (root / "go.mod").write_text("module ex.test/m\n")
    (root / "a.go").write_text("package p\n\nfunc F(a int) int {\n\treturn 1\n}\n\nfunc G() {}\n")
    g("add", "-A")
    g("commit", "-qm", "one")
    (root / "a.go").write_text("package p\n\nfunc F(a int) int {\n\tif a > 1 && a < 9 {\n\t\treturn 2\n\t}\n\treturn 1\n}\n\nfunc G() {}\n")
    (root / "b.rs").write_text("fn n() {}\n")
    return root


def test_git(repo):
    base, head = gitcli.merge_base(str(repo), "HEAD")
    assert base == head
    assert "@@" in gitcli.diffs(str(repo), base, ["."])[0]
    assert gitcli.untracked(str(repo), ["."]) == [("b.rs", "fn n() {}\n")]
    entries = gitcli.tree(str(repo), head)
    assert [e[0] for e in entries] == ["a.go", "go.mod"]
    assert gitcli.blobs(str(repo), [entries[1][2]])[entries[1][2]] == b"module ex.test/m\n"
    assert len(gitcli.batches(["x" * 100] * 300)) == 3
    assert files.go_module_root(str(repo), ["a.go"]) == str(repo.resolve())
    with pytest.raises(ValueError):
        files.go_module_root(str(repo.parent), ["."])
    with pytest.raises(RuntimeError):
        gitcli.merge_base(str(repo), "nope")


def test_commands(spark, repo, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli, "session", lambda *_: spark)
    assert cli.main(["analyze", str(repo), "--base", "HEAD", "--threshold", "5", "--format", "json"]) == 1
    doc = json.loads(capsys.readouterr().out)
    assert [(m["name"], m["complexity"], m["risk"]) for m in doc["methods"]] == [("p.F", 3, 12.0), ("n", 1, 2.0)]
    (repo / "c.out").write_text("mode: set\nex.test/m/a.go:3.20,4.22 1 1\nex.test/m/a.go:4.22,6.3 1 0\nex.test/m/a.go:7.2,7.10 2 1\n")
    assert cli.main(["analyze", str(repo), "--coverage", str(repo / "c.out")]) == 0
    assert "75.00 a.go:3 p.F" in capsys.readouterr().out
    assert cli.main(["analyze", str(repo), "--threshold", "1", "--format", "sarif"]) == 1
    assert "RISK001" in capsys.readouterr().out
    assert cli.main(["compare", str(repo), "--base", "HEAD", "--threshold", "5"]) == 1
    out = capsys.readouterr().out
    assert "matched modified a.go:3 p.F complexity-increased,risk-increased,threshold-crossed" in out and "added - b.rs:1 n" in out and "p.G" not in out
    (repo / "q").mkdir()
    (repo / "q" / "c.go").write_text('package q\n\nimport "ex.test/m"\n\ntype T struct{}\n\nfunc (t T) M() { func() {}() }\n')
    (repo / "a.go").write_text('package p\n\nimport "ex.test/m/q"\n')
    (tmp_path / "rules.json").write_text(json.dumps([{"from": "**/m", "to": "**/q", "reason": "layers"}]))
    assert cli.main(["graph", str(repo), "--module", "ex.test/m", "--rules", str(tmp_path / "rules.json")]) == 1
    out = capsys.readouterr().out
    assert json.loads(out.splitlines()[0]) == {"files": 3, "modules": 3, "types": 1, "callables": 3, "contains": 4, "declares": 0, "member_of": 3, "imports": 2, "occurrences": 9}
    assert "forbid go-package/ex.test/m -> go-package/ex.test/m/q layers" in out and "cycle " in out
    (tmp_path / "g.json").write_text(json.dumps({"files": [{"file_name": "a.go", "mutations": [{"line": 1, "column": 1, "type": "T", "status": "KILLED"}]}]}))
    assert cli.main(["mutate", str(tmp_path / "g.json"), "--engine", "gremlins"]) == 0
    assert cli.main(["mutate", str(tmp_path / "none.json"), "--engine", "gremlins"]) == 2


def test_session_architecture_and_review(spark):
    s = RiskSession(spark)
    edges = spark.createDataFrame([("1", "imports", "a", "b", 1), ("2", "imports", "b", "a", 1)], "id string, type string, from_id string, to_id string, occurrences int")
    names = spark.createDataFrame([("a", "go/a", "go"), ("b", "go/b", "go")], "id string, name string, system string")
    n = s.architecture(edges, names, [{"from": "**/a", "to": "**/b", "reason": "no"}])
    assert sorted(r["kind"] for r in s.parts(n)["violations"].collect()) == ["cycle", "forbid"] and not s.gate(n)
    methods = spark.createDataFrame([("m", "f", "n", 1, 40.0, None, True, True), ("l", "f", "n", 2, 4.0, 10.0, True, False)], "id string, file string, name string, start_line int, risk double, coverage_percent double, changed boolean, above_threshold boolean")
    comparisons = spark.createDataFrame([("c", True, ["x"], [("f", "n", 9.0, 1.0)], [])], "comparison_id string, regression boolean, reasons array<string>, current array<struct<file:string,name:string,risk:double,coverage_percent:double>>, baseline array<struct<file:string,name:string,risk:double,coverage_percent:double>>")
    cycles = s.parts(n)["cycles"].where("pos = 0").select("modules")
    r = s.review(methods, comparisons, s.parts(n)["violations"].where("kind = 'forbid'"), cycles)
    assert [x["kind"] for x in s.page(r, "findings")[0]] == ["regression", "quality", "coverage", "architecture", "architecture"]
    assert facts.distinct_in_order(["a", "b"], ["b", "c"]) == ["a", "b", "c"]
    g = facts.grammars(spark.createDataFrame([("a.rs",), ("b.TSX",), ("c.py",)], "path string"), {"rust": "1", "typescript": "2"})
    assert [tuple(x) for x in g.collect()] == [("rust", "1"), ("typescript", "2")]
    text = spark.createDataFrame([(bytearray(b"a\r\nb"),), (bytearray(b"\xff"),)], "content binary")
    assert [x[0] for x in text.select(files.readable_source(text["content"])).collect()] == ["a\nb", None]
    assert files.displayed_path("/x/y", "/x") == "y" and files.displayed_path("/z", "/x") == "" and files.displayed_path("q", "/x") == "q"


def lines(capsys):
    return capsys.readouterr().out.strip().splitlines()


def test_discovery_gates_and_change_commands(spark, repo, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli, "session", lambda *_: spark)
    root = str(repo)
    (repo / "q").mkdir()
    (repo / "q" / "c.go").write_text('package q\n\nimport (\n\t"fmt"\n\t"ex.test/m"\n)\n\ntype T struct{}\n\nfunc (t T) M() { fmt.Println(len("x")); p := m.F(1); _ = p }\n\nvar z = m.F(2)\n\nfunc N(t T) { t.M(); int(3); (N)(t); K() }\n')
    (repo / "a_test.go").write_text("package p\n\nfunc TestF() { F(1) }\n")
    (repo / "x.gen.ts").write_text("function gen() {}\n")
    (repo / "node_modules").mkdir()
    (repo / "node_modules" / "lib.ts").write_text("function lib() {}\n")
    (repo / ".gitignore").write_text("ig*.rs\n")
    (repo / "ignored.rs").write_text("fn ignored() {}\n")
    assert cli.main(["analyze", root, "--format", "json"]) == 0
    doc = json.loads(capsys.readouterr().out)
    assert sorted(m["name"] for m in doc["methods"]) == ["n", "p.F", "p.G", "q.(T).M", "q.N"] and len(doc["configSha256"]) == 64
    assert {e["reason"]: e["examples"] for e in doc["excluded"]} == {"built-in-directory": ["node_modules/lib.ts"], "generated": ["x.gen.ts"], "gitignore": ["ignored.rs"], "test": ["a_test.go"]}
    assert cli.main(["analyze", root, "--path", "ignored.rs", "--path", "q"]) == 0
    assert sorted(x.split()[-1] for x in lines(capsys)) == ["ignored", "q.(T).M", "q.N"]
    assert cli.main(["scope", root, "--base", "HEAD"]) == 0
    assert [x for x in lines(capsys) if x.startswith("callable")] == ["callable a.go:3 p.F", "callable b.rs:1 n", "callable q/c.go:10 q.(T).M", "callable q/c.go:14 q.N"]
    assert cli.main(["calls", root, "--base", "HEAD"]) == 0
    out = lines(capsys)
    summary = json.loads(out[0])
    # Names are resolved without types: m.F is a call of the imported package, t.M one of every method M.
    assert out[1:] == ["dispatch q.N -> q.(T).M 1", "static p.TestF -> p.F 1", "static q.(T).M -> p.F 1", "test p.TestF 1"]
    assert (summary["functions"], summary["tests"], summary["static_edges"], summary["dispatch_edges"], summary["unresolved_calls"], summary["affected_tests"]) == (5, 1, 2, 1, 6, 1)
    assert cli.main(["calls", root, "--format", "json"]) == 0
    assert sorted(u["reason"] for u in json.loads(capsys.readouterr().out)["unresolved"]) == ["builtin", "conversion", "function-value", "function-value", "outside-function-body", "outside-module"]
    (repo / "c.out").write_text("\nmode: set\nex.test/m/a.go:3.20,4.22 1 1\n")
    assert cli.main(["analyze", root, "--coverage", str(repo / "c.out")]) == 0
    assert cli.main(["analyze", root, "--coverage", str(repo / "c.out"), "--strict"]) == 2
    assert "b.rs: coverage-path-unmatched" in capsys.readouterr().err
    (repo / "empty.out").write_text("")
    assert cli.main(["analyze", root, "--coverage", str(repo / "empty.out")]) == 2
    (repo / "bad.go").write_text("package p\n\nfunc (\n")
    assert cli.main(["analyze", root]) == 2
    assert "bad.go:" in capsys.readouterr().err
    assert cli.main(["analyze", root, "--allow-errors"]) == 0 and cli.main(["analyze", root, "--exclude", "bad.go"]) == 0
    (repo / "bad.go").unlink()
    capsys.readouterr()
    assert cli.main(["arch", root]) == 0 and lines(capsys) == []
    assert cli.main(["review", root, "--base", "HEAD", "--threshold", "5"]) == 1
    out = lines(capsys)
    assert json.loads(out[0])["regression_findings"] == 1 and any(x.startswith("quality warning") for x in out)


def test_mutation_reports_are_checked(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli, "session", lambda *_: spark)
    at = tmp_path / "g.json"
    row = {"line": 2, "column": 3, "type": "T", "status": "LIVED"}
    at.write_text(json.dumps({"test_efficacy": 50.0, "mutants_total": 2, "files": [{"file_name": "a b.go", "mutations": [row, row | {"line": 5, "status": "KILLED"}]}]}))
    assert cli.main(["mutate", str(at), "--engine", "gremlins", "--format", "sarif"]) == 1
    results = json.loads(capsys.readouterr().out)["runs"][0]["results"]
    assert [(r["ruleId"], r["locations"][0]["physicalLocation"]["artifactLocation"]["uri"], r["locations"][0]["physicalLocation"]["region"]) for r in results] == [("MUT001", "a%20b.go", {"startLine": 2, "startColumn": 3})]
    at.write_text(json.dumps({"test_efficacy": 90.0, "mutants_total": 2, "files": [{"file_name": "a.go", "mutations": [row, row | {"line": 5, "status": "KILLED"}]}]}))
    assert cli.main(["mutate", str(at), "--engine", "gremlins"]) == 2
    at.write_text(json.dumps({"files": [{"file_name": "a.go", "mutations": [row, row]}]}))
    assert cli.main(["mutate", str(at), "--engine", "gremlins"]) == 2
    assert cli.main(["mutate", str(at), "--engine", "gremlins", "--minimum", "101"]) == 2
