"""RiskSession: analyses as methods, their results kept as snapshots that are read by pages."""

from __future__ import annotations

import secrets
import time
import uuid
from collections import OrderedDict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.functions.expr import above_threshold, risk_score
from riskframe.operators import build, calls, compare, coverage, facts, graph, intervals, mutation, review, scope
from riskframe.plans import pages
from riskframe.runtime import Scratch
from riskframe.sources.files import content_sha256


class RiskSession:
    """Runs analyses and keeps up to 8 snapshots for 30 minutes, written to the shared folder."""

    TTL, COUNT = 30 * 60, 8

    def __init__(self, spark: SparkSession, threshold: float = 30.0):
        self.spark, self.threshold = spark, threshold
        self.secret = secrets.token_bytes(32)
        self.scratch = Scratch(spark, "snapshots")
        self.kept: OrderedDict[str, tuple[float, str, dict[str, DataFrame]]] = OrderedDict()

    # Analyses.
    def callables(self, files: DataFrame) -> DataFrame:
        """Callables of source files with ids."""
        return facts.with_ids(facts.facts(files, "callables"))

    def parse(self, files: DataFrame, allow_errors: bool = False) -> DataFrame:
        """All facts of source files from one parse; a syntax error fails the analysis, that of the first path."""
        parsed = self.scratch.cut(facts.parsed(files))
        bad = None if allow_errors else facts.syntax_gate(parsed).first()
        if bad is not None:
            raise ValueError(f"{bad['path']}:{bad['line']}:{bad['column']}: {bad['message']} ({bad['code']})")
        return parsed

    def parsed_callables(self, parsed: DataFrame) -> DataFrame:
        return facts.with_ids(facts.of_kind(parsed, "callables"))

    def coverage_matches(self, files: DataFrame, spans: DataFrame, aliases: DataFrame | None = None, strict: bool = False) -> tuple[DataFrame, DataFrame]:
        """(matches of files and report paths, diagnostics); strict fails on the first unmatched or ambiguous file."""
        matches = self.scratch.cut(self.assign_coverage(files, spans.select("identity").distinct(), aliases))
        found = coverage.match_diagnostics(matches)
        first = coverage.first_failure(found).first() if strict else None
        if first is not None and first["path"] is not None:
            raise ValueError(f"{first['path']}: {first['code']}")
        return matches, found

    def call_graph(self, parsed: DataFrame, callables: DataFrame, go_module: str = "", changed: DataFrame | None = None) -> str:
        """Functions, edges, unresolved calls and, for changed functions, affected tests of Go sources."""
        known = self.scratch.cut(calls.go_call_facts(parsed, callables, go_module))
        edges = self.scratch.cut(pages.bounded(calls.call_edges(known), 250_000, "call edges"))
        go = callables.where("language = 'go'")
        declared = go.select(F.col("file").alias("path"), F.col("start_line").alias("line"), F.col("start_column").alias("column"), "name")
        flags = go if "changed" in go.columns else go.withColumn("changed", F.lit(False))
        inventory = calls.functions(declared, flags.select("id", "file", "start_line", "start_column", "changed", "end_line"))
        inventory = self.scratch.cut(inventory)
        tests = graph.affected_tests(edges, inventory.where("changed").select("id").orderBy("id").limit(scope.SEEDS), inventory.where("test").select("id"))
        tests = tests.where("distance > 0").join(inventory.select(F.col("id").alias("test"), "name", F.col("path").alias("file")), "test")
        tests = self.scratch.cut(tests)
        first, numbers = calls.unresolved_calls(known)
        summary = graph.one_row(calls.call_summary(inventory, edges, tests), numbers.select(F.col("total").alias("unresolved_calls"), F.col("truncated").alias("truncated_unresolved")))
        return self.keep("calls", functions=inventory, edges=edges, unresolved=first, tests=tests, summary=summary)

    def score(self, callables: DataFrame, spans: DataFrame | None = None, matches: DataFrame | None = None, ranges: DataFrame | None = None, changed_only: bool = False) -> DataFrame:
        """Adds coverage_percent, risk, above_threshold and changed. Ownership sees all callables, whatever is changed."""
        c = callables
        if spans is not None:
            if matches is not None:
                spans = spans.join(matches.where("identity is not null").select("identity", F.col("file")), "identity")
            cov = intervals.covered_percent(spans, intervals.owned_ranges(callables))
            c = c.drop("coverage_percent").join(cov, "id", "left")
        else:
            c = c.withColumn("coverage_percent", F.lit(None).cast("double"))
        c = c.withColumn("risk", risk_score(F.col("complexity"), F.col("coverage_percent")))
        c = c.withColumn("above_threshold", above_threshold(F.col("risk"), self.threshold))
        c = scope.flagged(c, ranges) if ranges is not None else c.withColumn("changed", F.lit(False))
        return c.where("changed") if changed_only else c

    def analyze(self, files: DataFrame, **how) -> str:
        methods = self.score(self.callables(files), **how)
        return self.keep("analysis", methods=methods, summary=review.summary(methods))

    def compare(self, baseline: DataFrame, current: DataFrame) -> str:
        rows = self.scratch.cut(compare.compared(baseline, current, threshold=self.threshold))
        return self.keep("comparison", comparisons=rows, summary=compare.comparison_summary(rows))

    def change_scope(self, callables: DataFrame, ranges: DataFrame) -> str:
        """The files, callables, links and seeds that changed ranges touch."""
        merged = self.scratch.cut(scope.changed_ranges(ranges))
        marked, touched = scope.flagged(callables, merged), scope.scope_files(merged)
        return self.keep("scope", scope_files=touched, edges=scope.scope_edges(touched, marked), seeds=scope.scope_seeds(touched, marked), methods=marked.where("changed"))

    def review(self, methods: DataFrame, comparisons: DataFrame, violations: DataFrame, cycles: DataFrame, tests: DataFrame | None = None) -> str:
        """All findings of one revision in one ranked table."""
        parts = [review.regression_findings(comparisons), review.quality_findings(methods), review.architecture_findings(violations, cycles)]
        if tests is not None:
            parts.append(review.test_findings(tests))
        findings = self.scratch.cut(review.ranked(*parts))
        return self.keep("review", findings=findings, summary=review.review_summary(findings))

    def architecture(self, edges: DataFrame, names: DataFrame, rules: list[dict], forbid_cycles: bool | None = None) -> str:
        """Violations of rules and, unless switched off, import cycles with their witnesses."""
        imports = edges.where("type = 'imports'")
        broken = graph.forbidden(imports, names, rules).withColumn("kind", F.lit("forbid"))
        cycles = graph.cycle_witnesses(imports, graph.cyclic_components(imports))
        if forbid_cycles is False:
            return self.keep("architecture", violations=broken, cycles=cycles)
        first = cycles.where("pos = 0").select("from_id", "to_id")
        looped = first.join(names.select(F.col("id").alias("from_id"), F.col("name").alias("from")), "from_id").join(names.select(F.col("id").alias("to_id"), F.col("name").alias("to")), "to_id")
        loops = looped.select("from", "to", F.lit("").alias("system"), F.lit("import cycle").alias("reason"), F.lit(None).cast("int").alias("rule"), F.lit("cycle").alias("kind"))
        return self.keep("architecture", violations=broken.unionByName(loops), cycles=cycles)

    def code_graph(self, files: DataFrame, callables: DataFrame, go_module: str = "", parsed: DataFrame | None = None) -> str:
        """The code graph of source files and their scored callables; more than its bounds allow is an error, never a cut."""
        nodes, edges, references = build.build_graph(files, callables, go_module, parsed)
        nodes, edges = self.scratch.cut(nodes), self.scratch.cut(edges)
        for df, most, what in ((nodes, 100_000, "nodes"), (edges, 250_000, "edges"), (references, 250_000, "references")):
            pages.bounded(df, most, what)
        deep = graph.deep_nodes(edges).first()
        if deep is not None:
            raise ValueError(f"{deep['node_id']} lies on or below a cycle or deeper than 64")
        rollup = graph.module_rollup(
            edges.where("type = 'member-of'").select(F.col("to_id").alias("module_id"), F.col("from_id").alias("file")),
            nodes.where("kind in ('type', 'callable')").select(graph.node_id("file", F.col("path")).alias("file"), "kind", "metrics.*"),
        )
        return self.keep("graph", nodes=nodes, edges=edges, references=references, modules=rollup, summary=graph.graph_summary(nodes, edges))

    def compared_rows(self, files: DataFrame, callables: DataFrame, coverage_format: str = "", matches: DataFrame | None = None) -> DataFrame:
        """Scored callables with the digest of their text and their coverage state, as ``compare`` wants them."""
        text = files.select(F.col("path").alias("file"), "content")
        rows = callables.join(text, "file").withColumn("content_sha256", content_sha256(F.col("content"), F.col("start_byte"), F.col("end_byte"))).drop("content")
        none = rows.select("file", F.lit("exact").alias("kind")).limit(0)
        out = coverage.coverage_state(rows, none if matches is None else matches, coverage_format != "").withColumn("coverage_format", F.lit(coverage_format))
        return out.select(*sorted(out.columns))  # both sides of a comparison have their columns in one order

    def graph(self, nodes: DataFrame, edges: DataFrame) -> str:
        return self.keep("graph", nodes=nodes, edges=edges, summary=graph.graph_summary(nodes, edges))

    def neighborhood(self, snapshot: str, seeds: list[str], **options):
        parts = self.parts(snapshot, "graph")
        return graph.neighborhood(parts["nodes"], parts["edges"], seeds, **options)

    def neighborhood_references(self, snapshot: str, edges: DataFrame) -> DataFrame:
        """The references that back edges of a neighborhood."""
        parts = self.parts(snapshot, "graph")
        return graph.supporting_references(parts["references"], parts["edges"].join(edges.select("id"), "id", "left_semi"))

    def mutation(self, mutants: DataFrame, minimum: float = 80.0) -> str:
        return self.keep("mutation", mutants=mutants, summary=mutation.mutation_score(mutation.mutation_summary(mutants), minimum))

    def assign_coverage(self, files: DataFrame, identities: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
        return coverage.assign_paths(files, identities, aliases)

    # Snapshots.
    def keep(self, kind: str, **parts: DataFrame) -> str:
        self._expire()
        name = uuid.uuid4().hex
        self.kept[name] = (time.time(), kind, {k: self.scratch.cut(df) for k, df in parts.items()})
        while len(self.kept) > self.COUNT:
            self._drop(next(iter(self.kept)))
        return name

    def parts(self, snapshot: str, kind: str | None = None) -> dict[str, DataFrame]:
        self._expire()
        if snapshot not in self.kept or (kind and self.kept[snapshot][1] != kind):
            raise KeyError(f"no {kind or ''} snapshot {snapshot}")
        return self.kept[snapshot][2]

    def page(self, snapshot: str, part: str, *, mode: str = "all", limit: int = pages.PAGE, cursor: str | None = None) -> tuple[list, int, str | None]:
        """(rows, number of all matching rows, cursor of the next page or None)."""
        df = self.parts(snapshot)[part]
        if part == "methods":
            df = pages.in_mode(df, mode)
        offset = pages.cursor_offset(self.secret, cursor, snapshot, mode) if cursor else 0
        order = [F.desc("risk"), "id"] if part == "methods" else [c for c in pages.ORDERS.get(part, df.columns[:1]) if isinstance(c, str) and c in df.columns]
        rows, total = pages.page(df, order, offset, limit).collect(), df.count()
        more = offset + len(rows) < total
        return rows, total, pages.cursor(self.secret, snapshot, mode, offset + len(rows)) if more else None

    def gate(self, snapshot: str) -> bool:
        """Whether nothing fails: no callable above the threshold, no regression, no violation, or a passed mutation score."""
        kind, parts = self.kept[snapshot][1], self.parts(snapshot)
        if kind == "analysis":
            return parts["methods"].where("above_threshold").isEmpty()
        if kind == "comparison":
            return parts["comparisons"].where("regression").isEmpty()
        if kind == "architecture":
            return parts["violations"].isEmpty()
        if kind == "mutation":
            return bool(parts["summary"].first()["passed"])
        return True

    def _expire(self) -> None:
        for name in [n for n, (t, _, _) in self.kept.items() if time.time() - t > self.TTL]:
            self._drop(name)

    def _drop(self, name: str) -> None:
        for df in self.kept.pop(name)[2].values():
            self.scratch.drop(df)


def exit_code(ok: bool, error: bool = False) -> int:
    """0 if the gate holds, 1 if it doesn't, 2 for an error."""
    return 2 if error else 0 if ok else 1


