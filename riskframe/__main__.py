"""Command line: analyses of a folder, a change or a report. Exit code 0, 1 (gate) or 2 (error)."""

from __future__ import annotations

import argparse
import json
import os
import sys
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.api import RiskSession, exit_code
from riskframe.operators import discovery
from riskframe.plans import pages, reports
from riskframe.runtime import Scratch, session
from riskframe.sources import coverage_reports, files, git, gitcli, mutation_reports

ENDINGS = (".cs", ".go", ".rs", ".ts", ".tsx")


def selected_sources(spark, args) -> tuple[DataFrame, DataFrame]:
    """(sources that discovery leaves in, what it left out by reason) below the root or among the given paths."""
    found = files.scan_sources(spark, args.root)
    named = [p.replace("\\", "/") for p in args.path or []]
    if named:
        explicit = [p for p in named if os.path.isfile(os.path.join(args.root, p))]
        folders = [p for p in named if p not in explicit]
        if explicit:
            found = found.where("false").unionByName(files.explicit_sources(spark, args.root, explicit)).unionByName(found.where(discovery.selected(F.col("path"), folders)) if folders else found.where("false"))
        else:
            found = found.where(discovery.selected(F.col("path"), folders))
    ignores = {}
    for folder, _, names in os.walk(args.root):
        if ".gitignore" in names:
            rel = os.path.relpath(folder, args.root).replace(os.sep, "/")
            with open(os.path.join(folder, ".gitignore"), encoding="utf-8", errors="replace") as f:
                ignores["" if rel == "." else rel] = f.read()
    own = os.path.join(args.root, ".riskframeignore")
    text = open(own, encoding="utf-8").read() if os.path.isfile(own) else ""
    marked = discovery.discover(found, excludes=args.exclude or [], tool_ignore=text, gitignores=ignores, include_tests=args.tests, include_generated=args.generated)
    kept = found.join(marked.where("reason is null").select("path"), "path", "left_semi")
    return kept, discovery.exclusions(marked)


def go_module_of(spark, args) -> str:
    """The module name: given, or that of the root's go.mod."""
    if args.module:
        return args.module
    mod = os.path.join(args.root, "go.mod")
    if not os.path.isfile(mod):
        return ""
    row = spark.read.option("wholetext", "true").text(mod).select(files.go_module(F.col("value"))).first()
    return row[0] or ""


def changes(spark, args) -> DataFrame:
    """The line ranges that differ from the merge base with a commit, untracked files included."""
    base, _ = gitcli.merge_base(args.root, args.base)
    texts = spark.createDataFrame([(t,) for t in gitcli.diffs(args.root, base, ["."])], "diff string")
    fresh = spark.createDataFrame(gitcli.untracked(args.root, ["."]), "path string, text string")
    return git.diff_ranges(texts).unionByName(git.untracked_ranges(fresh))


@dataclass
class Run:
    """What the commands share: parsed sources, their scored callables, coverage matches and format, exclusions."""

    s: RiskSession
    src: DataFrame
    parsed: DataFrame
    methods: DataFrame
    matches: DataFrame | None
    form: str
    left_out: DataFrame
    diagnostics: DataFrame | None = None


def analysis(spark, args, changed_only: bool = False) -> Run:
    s = RiskSession(spark, args.threshold)
    src, left_out = selected_sources(spark, args)
    src = s.scratch.cut(src)
    parsed = s.parse(src, args.allow_errors)
    spans = matches = ranges = diagnostics = None
    form = ""
    if args.coverage:
        spans, aliases, form = coverage_reports.read_report(spark, args.coverage, os.path.abspath(args.root))
        matches, diagnostics = s.coverage_matches(src.select(F.col("path").alias("file")), spans, aliases, args.strict)
    if args.base:
        ranges = changes(spark, args)
    methods = s.scratch.cut(s.score(s.parsed_callables(parsed), spans, matches, ranges, changed_only=changed_only and bool(args.base)))
    return Run(s, src, parsed, methods, matches, form, left_out, diagnostics)


def header(kind: str, args, **more) -> dict:
    config = {"threshold": args.threshold, "excludes": args.exclude or [], "tests": args.tests, "generated": args.generated, "paths": args.path or []}
    return {"schemaVersion": "1", "reportType": kind, "threshold": args.threshold, "configSha256": reports.config_fingerprint(config), "limitations": reports.LIMITATIONS.get(kind, []), **more}


def shown(args, kind: str, lines: DataFrame, **parts: DataFrame) -> None:
    """Prints a report as JSON, each part bounded, or as text."""
    if args.format == "json":
        print(reports.json_report(header(kind, args), **{k: pages.bounded(v, reports.ROWS, k) for k, v in parts.items()}), end="")
    else:
        for r in lines.toLocalIterator():
            print(r[0])


def analyze(spark, args) -> bool:
    r = analysis(spark, args, changed_only=True)
    if args.format == "sarif":
        rows = r.methods.where("above_threshold").withColumn("message", F.format_string("change risk %.2f exceeds %.2f", "risk", F.lit(args.threshold)))
        print(reports.sarif_log(reports.sarif_results(rows, "RISK001", "warning"), [{"id": "RISK001"}]))
    else:
        parts = {"methods": r.methods.orderBy("file", "start_line", "start_column", "id"), "excluded": r.left_out.orderBy("reason")}
        if r.diagnostics is not None:
            parts["diagnostics"] = r.diagnostics.orderBy("code", "path")
        shown(args, "analysis", reports.callable_text(r.methods), **parts)
    return r.methods.where("above_threshold").isEmpty()


def scope(spark, args) -> bool:
    """The files and callables that a change touches."""
    r = analysis(spark, args)
    parts = r.s.parts(r.s.change_scope(r.methods, changes(spark, args)))
    touched = parts["methods"]
    lines = parts["scope_files"].select(F.col("path").alias("file"), F.lit(0).alias("at"), F.concat(F.lit("file "), "path").alias("line"))
    lines = lines.unionByName(touched.select("file", F.col("start_line").alias("at"), F.format_string("callable %s:%d %s", "file", "start_line", "name").alias("line")))
    shown(args, "scope", lines.orderBy("file", "at", "line").select("line"), files=parts["scope_files"].orderBy("path"), edges=parts["edges"].orderBy("id"), seeds=parts["seeds"].orderBy("kind", "node_id"))
    return True


def compared(spark, args) -> tuple[Run, str]:
    """The working tree against the merge base with a commit."""
    new = analysis(spark, args)
    s = new.s
    base, _ = gitcli.merge_base(args.root, args.base)
    paths = {row[0] for row in new.src.select("path").toLocalIterator()} if args.path else None
    entries = [e for e in gitcli.tree(args.root, base) if e[1] in ("100644", "100755") and e[0].lower().endswith(ENDINGS) and (paths is None or e[0] in paths)]
    old = gitcli.blob_table(spark, Scratch(spark, "blobs"), args.root, entries)
    marked = discovery.discover(old.select("path", F.lit(False).alias("explicit")), excludes=args.exclude or [], include_tests=args.tests, include_generated=args.generated)
    old = s.scratch.cut(old.join(marked.where("reason is null").select("path"), "path", "left_semi"))
    before = s.score(s.parsed_callables(s.parse(old, True)))
    sides = s.scratch.cut(s.compared_rows(old, before)), s.scratch.cut(s.compared_rows(new.src, new.methods, new.form, new.matches))
    return new, s.compare(*sides)


def compare(spark, args) -> bool:
    """The gate fails on a regression."""
    run, name = compared(spark, args)
    parts = run.s.parts(name)
    if args.format == "json":
        shown(args, "comparison", None, summary=parts["summary"], comparisons=parts["comparisons"].orderBy("comparison_id"))
        return run.s.gate(name)
    print(parts["summary"].toJSON().first())
    for r in parts["comparisons"].where("status <> 'matched' or change <> 'unchanged'").orderBy("comparison_id").toLocalIterator():
        m = (r["current"] or r["baseline"] or [None])[0]
        print(*([r["status"], r["change"] or "-", f"{m['file']}:{m['start_line']}", m["name"], ",".join(r["reasons"])] if m else [r["status"], r["baseline_rows"], r["current_rows"], r["declaration"]]))
    return run.s.gate(name)


def graphed(spark, args, run: Run) -> tuple[str, str]:
    """(graph, architecture) snapshots of an analysis."""
    s = run.s
    name = s.code_graph(run.src, run.methods, go_module_of(spark, args), run.parsed)
    parts = s.parts(name, "graph")
    named = parts["nodes"].where("kind = 'module'").select("id", F.concat_ws("/", "module.system", "module.name").alias("name"), F.col("module.system").alias("system"))
    rules = json.loads(open(args.rules, encoding="utf-8").read()) if args.rules else []
    return name, s.architecture(parts["edges"], named, rules)


def violations(parts: dict) -> DataFrame:
    return parts["violations"].orderBy("from", "to", "kind").select(F.concat_ws(" ", "kind", "from", F.lit("->"), "to", "reason").alias("line"))


def graph(spark, args) -> bool:
    """Summary of the code graph, import cycles and broken rules."""
    run = analysis(spark, args)
    name, arch = graphed(spark, args, run)
    parts, found = run.s.parts(name, "graph"), run.s.parts(arch)
    if args.format == "text":
        print(parts["summary"].toJSON().first())
    shown(args, "graph", violations(found), summary=parts["summary"], nodes=parts["nodes"].orderBy("id"), edges=parts["edges"].orderBy("id"), references=parts["references"].orderBy("id"), modules=parts["modules"].orderBy("module_id"))
    return run.s.gate(arch)


def arch(spark, args) -> bool:
    """Broken rules and import cycles alone; the gate fails on any."""
    run = analysis(spark, args)
    found = graphed(spark, args, run)[1]
    parts = run.s.parts(found)
    shown(args, "architecture", violations(parts), violations=parts["violations"].orderBy("from", "to", "kind"), cycles=parts["cycles"].orderBy("component", "pos"))
    return run.s.gate(found)


def call_graph(spark, args) -> bool:
    """The call graph of Go sources and, with --base, the tests that reach a change."""
    run = analysis(spark, args)
    parts = run.s.parts(run.s.call_graph(run.parsed, run.methods, go_module_of(spark, args)))
    if args.format == "text":
        print(parts["summary"].toJSON().first())
    f = parts["functions"].select("id", "name")
    named = parts["edges"].join(f.select(F.col("id").alias("from_id"), F.col("name").alias("a")), "from_id").join(f.select(F.col("id").alias("to_id"), F.col("name").alias("b")), "to_id")
    lines = named.select(F.lit(0).alias("o"), F.concat_ws(" ", "kind", "a", F.lit("->"), "b", F.col("occurrences").cast("string")).alias("line")).unionByName(
        parts["tests"].select(F.lit(1).alias("o"), F.format_string("test %s %d", "name", "distance").alias("line"))
    )
    shown(args, "calls", lines.orderBy("o", "line").select("line"), summary=parts["summary"], functions=parts["functions"].orderBy("path", "line"), edges=parts["edges"].orderBy("id"), unresolved=parts["unresolved"], tests=parts["tests"].orderBy("file", "name"))
    return True


def review(spark, args) -> bool:
    """All findings of a change in one ranked list; the gate fails on a regression."""
    run, name = compared(spark, args)
    s = run.s
    _, broken = graphed(spark, args, run)
    found = s.parts(broken)
    tests = s.parts(s.call_graph(run.parsed, run.methods, go_module_of(spark, args)))["tests"]
    cycles = found["cycles"].where("pos = 0").select("modules")
    out = s.parts(s.review(run.methods, s.parts(name)["comparisons"], found["violations"].where("kind = 'forbid'"), cycles, tests))
    if args.format == "text":
        print(out["summary"].toJSON().first())
    ranked = out["findings"].orderBy("priority", "kind", "id")
    shown(args, "review", ranked.select(F.concat_ws(" ", "kind", "severity", "title", "evidence").alias("line")), summary=out["summary"], findings=ranked)
    return s.gate(name)


def mutate(spark, args) -> bool:
    s = RiskSession(spark)
    rows = mutation_reports.read_report(spark, args.report, args.engine, args.minimum)
    name = s.mutation(rows, args.minimum)
    parts = s.parts(name)
    if args.format == "sarif":
        print(reports.sarif_log(reports.mutation_sarif(parts["mutants"]), reports.MUTATION_RULES))
    elif args.format == "json":
        print(reports.json_report({"schemaVersion": "1", "reportType": "mutation", "minimum": args.minimum}, summary=parts["summary"], mutants=pages.bounded(parts["mutants"], reports.ROWS, "mutants").orderBy("file", "start_line", "start_column", "id")), end="")
    else:
        print(parts["summary"].toJSON().first())
    return s.gate(name)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser("riskframe")
    sub = p.add_subparsers(dest="command", required=True)
    for name, run, needs_base in (("analyze", analyze, False), ("scope", scope, True), ("compare", compare, True), ("review", review, True), ("graph", graph, False), ("arch", arch, False), ("calls", call_graph, False)):
        a = sub.add_parser(name)
        a.add_argument("root")
        a.add_argument("--base", required=needs_base, help="commit whose merge base with HEAD is compared with")
        a.add_argument("--coverage", help="Cobertura report or Go coverage profile")
        a.add_argument("--strict", action="store_true", help="fail if a file meets no or several paths of the report")
        a.add_argument("--threshold", type=float, default=30.0)
        a.add_argument("--path", action="append", help="file or folder below the root; files pass every filter but --exclude")
        a.add_argument("--exclude", action="append", help="pattern of paths to leave out")
        a.add_argument("--tests", action="store_true", help="include test files")
        a.add_argument("--generated", action="store_true", help="include generated files")
        a.add_argument("--allow-errors", action="store_true", help="go on with files that don't parse")
        a.add_argument("--module", default="", help="Go module name; that of go.mod if not given")
        a.add_argument("--rules", help="JSON list of {from, to, system, reason}")
        a.add_argument("--format", choices=("text", "json", "sarif") if name == "analyze" else ("text", "json"), default="text")
        a.set_defaults(run=run)
    m = sub.add_parser("mutate")
    m.add_argument("report")
    m.add_argument("--engine", choices=("stryker", "gremlins"), required=True)
    m.add_argument("--minimum", type=float, default=80.0)
    m.add_argument("--format", choices=("text", "json", "sarif"), default="text")
    m.set_defaults(run=mutate)
    args = p.parse_args(argv)
    if args.command == "calls":
        args.tests = True  # tests are what a change is followed to
    try:
        return exit_code(args.run(session("riskframe"), args))
    except Exception as e:  # any failure is exit code 2
        print(f"riskframe: {e}", file=sys.stderr)
        return exit_code(False, True)


if __name__ == "__main__":
    sys.exit(main())
