"""Queries of the smaller operators (names, states, evidence, pages, identities) over whole tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskframe.functions import expr as X
from riskframe.operators import calls, compare, coverage, discovery, facts, graph, intervals, mutation, review, scope
from riskframe.plans import core, pages, reports
from riskframe.plans.training import _P2
from riskframe.runtime import table
from riskframe.sources import files

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return add


KIND = "lower(regexp_replace(type, '^\\s+|\\s+$', '', 'g'))"
EDGES = f"edges AS (SELECT {KIND} AS type, from_id, to_id, min(id) AS id, max(occurrences) AS occurrences FROM graph_edges WHERE from_id IS NOT NULL AND to_id IS NOT NULL AND type IS NOT NULL GROUP BY ALL)"


def source_paths(spark, d):
    return table(spark, d, "source_files").where("path is not null").select("path").distinct()


# Names.
@query(
    r"""WITH p AS (SELECT DISTINCT path FROM source_files WHERE path LIKE '%.rs'), a AS (SELECT path, regexp_replace(regexp_replace(regexp_replace(path, '\.[^./]*$', ''), '^src(/|$)', ''), '(^|/)(mod|lib|main)$', '') AS i FROM p)
SELECT path, CASE WHEN i = '' THEN 'crate' ELSE 'crate::' || replace(i, '/', '::') END AS module FROM a"""
)
def rust_modules(spark, d):
    return source_paths(spark, d).where("path like '%.rs'").select("path", X.rust_module_path(F.col("path")).alias("module"))


@query(
    r"""WITH p AS (SELECT DISTINCT path, CASE WHEN path LIKE '%/%' THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END AS f FROM source_files WHERE path LIKE '%.go')
SELECT path, CASE WHEN f = '' THEN 'ex.test/m' ELSE 'ex.test/m/' || f END AS in_module, CASE WHEN f = '' THEN '.' ELSE './' || f END AS alone FROM p"""
)
def go_modules(spark, d):
    folder = F.when(F.col("path").contains("/"), F.regexp_replace("path", r"/[^/]*$", "")).otherwise("")
    return source_paths(spark, d).where("path like '%.go'").select("path", X.go_module_name(F.lit("ex.test/m"), folder).alias("in_module"), X.go_module_name(F.lit(""), folder).alias("alone"))


@query("SELECT path, replace(url_encode(path), '%2F', '/') AS uri FROM (SELECT DISTINCT replace(path, '.', ' +ü.') AS path FROM source_files WHERE path IS NOT NULL)")
def uri_paths(spark, d):
    return source_paths(spark, d).select(F.replace("path", F.lit("."), F.lit(" +ü.")).alias("path")).select("path", X.uri_escaped(F.col("path")).alias("uri"))


@query("SELECT DISTINCT file, name, lower(file) LIKE '%\\_test.go' ESCAPE '\\' AND starts_with(regexp_extract(name, '[^.]*$'), 'Test') AS test FROM (SELECT CASE WHEN language = 'go' THEN replace(file, '.go', '_test.go') ELSE file END AS file, CASE WHEN complexity % 2 = 0 THEN 'p.Test' || name ELSE name END AS name FROM callables)")
def test_functions(spark, d):
    c = table(spark, d, "callables").selectExpr("CASE WHEN language = 'go' THEN replace(file, '.go', '_test.go') ELSE file END AS file", "CASE WHEN complexity % 2 = 0 THEN 'p.Test' || name ELSE name END AS name")
    return c.select("file", "name", X.is_test_function(F.col("file"), F.col("name")).alias("test")).distinct()


@query("SELECT DISTINCT repository, id, CASE WHEN coalesce(stable_owner, '') = '' THEN name ELSE stable_owner || '.' || name END AS qualified, trim(regexp_replace(signature, '\\s+', ' ', 'g')) AS signature FROM callables")
def qualified_signatures(spark, d):
    c = table(spark, d, "callables")
    return c.select("repository", "id", X.csharp_qualified(F.col("stable_owner"), F.col("name")).alias("qualified"), X.collapsed(F.col("signature")).alias("signature")).distinct()


_VARIANTS = ["path", "'vendor/' || path", "'x/vendor/' || path", "'x/node_modules/y/' || path", "path || '.generated.ts'", "'Bin/' || path || '.g.cs'"]


@query(
    f"""WITH v AS (SELECT DISTINCT unnest([{', '.join(_VARIANTS)}]) AS path FROM source_files WHERE path IS NOT NULL),
r AS (SELECT path, CASE WHEN NOT regexp_matches(lower(path), '\\.(cs|go|rs|ts|tsx)$') THEN 'unsupported' WHEN path LIKE 'vendor/%' OR path LIKE '%node_modules/%' OR path LIKE 'Bin/%' THEN 'built-in-directory'
 WHEN regexp_matches(lower(path), '_test\\.go$|(^|/)(tests|benches)/.*\\.rs$|\\.(spec|test)\\.tsx?$') THEN 'test' WHEN regexp_matches(path, '\\.(generated\\.ts|g\\.cs)$') THEN 'generated' END AS reason FROM v)
SELECT path, reason FROM r"""
)
def discovery_reasons(spark, d):
    v = table(spark, d, "source_files").where("path is not null").select(F.explode(F.expr(f"array({', '.join(_VARIANTS)})")).alias("path"), F.lit(False).alias("explicit"))
    return discovery.discover(v).select("path", "reason")


@query("SELECT DISTINCT path, bool_or(path = s OR starts_with(path, s || '/')) AS chosen FROM source_files, (SELECT unnest(['src', 'internal', 'lib/cursor']) AS s) WHERE path IS NOT NULL GROUP BY path")
def selected_paths(spark, d):
    return source_paths(spark, d).select("path", discovery.selected(F.col("path"), ["src/", "internal", "lib/cursor"]).alias("chosen"))


@query("SELECT DISTINCT CASE lower(regexp_extract(path, '[^.]*$')) WHEN 'go' THEN 'go' WHEN 'cs' THEN 'csharp' WHEN 'rs' THEN 'rust' WHEN 'ts' THEN 'typescript' WHEN 'tsx' THEN 'typescript' END AS language, '1' AS version FROM source_files WHERE regexp_matches(lower(path), '\\.(go|cs|rs|ts|tsx)$')")
def grammars_used(spark, d):
    return facts.grammars(source_paths(spark, d), dict.fromkeys(("go", "csharp", "rust", "typescript"), "1"))


# Texts and places.
@query("SELECT doc_id, CASE WHEN octet_length(encode(text)) >= 50 THEN sha256(array_slice(encode(text), 11, 50)) ELSE sha256(encode(text)) END AS sha FROM documents WHERE text IS NOT NULL")
def range_hashes(spark, d):
    t = table(spark, d, "documents").where("text is not null").withColumn("content", F.encode("text", "UTF-8"))
    return t.select("doc_id", files.content_sha256(F.col("content"), F.lit(10), F.lit(50)).alias("sha"))


@query("SELECT doc_id, CASE WHEN contains(text, chr(10)) THEN octet_length(encode(split_part(text, chr(10), 1))) + 3 END AS at FROM documents WHERE text IS NOT NULL")
def byte_offsets(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", files.byte_offset(F.col("text"), F.lit(2), F.lit(3)).cast("long").alias("at"))


@query("SELECT doc_id, replace(text, chr(13), '') AS readable FROM documents WHERE text IS NOT NULL")
def readable_texts(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", files.readable_source(F.encode("text", "UTF-8")).alias("readable"))


# Coverage and comparison.
_LOOKUP = core.ORACLE["path_lookup"]


@query(
    f"""WITH l AS ({_LOOKUP}), m AS (SELECT file, kind, ['suffix', 'case-folded', 'ambiguous', 'unmatched'] AS ks FROM l WHERE kind <> 'exact')
SELECT file AS path, CASE WHEN kind IN ('suffix', 'case-folded') THEN 'warning' ELSE 'error' END AS severity, 'coverage-path-' || CASE kind WHEN 'suffix' THEN 'suffix-matched' WHEN 'case-folded' THEN 'case-folded' ELSE kind END AS code FROM m"""
)
def lookup_diagnostics(spark, d):
    return coverage.match_diagnostics(coverage.lookup_path(*core.v_paths(spark, d))).select("path", "severity", "code")


@query(f"WITH l AS ({_LOOKUP}), e AS (SELECT file AS path, 'coverage-path-' || kind AS code FROM l WHERE kind IN ('ambiguous', 'unmatched')) SELECT min_by(code, path) AS code, min(path) AS path FROM e")
def strict_failure(spark, d):
    return coverage.first_failure(coverage.match_diagnostics(coverage.lookup_path(*core.v_paths(spark, d))))


@query(
    f"""WITH {core.LATEST}, k AS (SELECT repository, id, file, coverage_percent, ['exact', 'unmatched', 'ambiguous'][1 + length(file) % 3] AS kind FROM latest)
SELECT repository, id, CASE WHEN kind <> 'exact' THEN kind WHEN coverage_percent IS NULL THEN 'uninstrumented' ELSE 'measured' END AS coverage_state FROM k"""
)
def coverage_states(spark, d):
    c = core.latest(spark, d).select("repository", "id", "file", "coverage_percent")
    matches = c.where("file is not null").select("file", F.expr("array('exact', 'unmatched', 'ambiguous')[length(file) % 3]").alias("kind")).distinct()
    return coverage.coverage_state(c, matches).select("repository", "id", "coverage_state")


@query("SELECT count(*) AS rows, count(*) FILTER (coverage_percent >= 0 AND coverage_percent <= 100) AS percentages FROM callables")
def percentages(spark, d):
    return table(spark, d, "callables").agg(F.count("*").alias("rows"), F.count_if(X.is_percentage(F.col("coverage_percent"))).alias("percentages"))


@query(
    core.V_MATCH
    + f""", x AS ({core.DELTA}) SELECT baseline_id, current_id, concat_ws(',', CASE WHEN complexity > 0 THEN 'complexity-increased' END, CASE WHEN coverage_percent < 0 THEN 'coverage-decreased' END,
 CASE WHEN comparable AND risk > 0 THEN 'risk-increased' END, CASE WHEN comparable AND NOT ba AND na THEN 'threshold-crossed' END) AS reasons FROM x"""
)
def compare_reasons(spark, d):
    r = core.comparisons(spark, d).where("status = 'matched'")
    return r.select(F.get("baseline", F.lit(0))["id"].alias("baseline_id"), F.get("current", F.lit(0))["id"].alias("current_id"), F.array_join("reasons", ",").alias("reasons"))


@query(core.V_MATCH + f" SELECT {core.fp_sql(chr(39) + 'change-scope-comparison-v1' + chr(39), chr(39) + 'matched' + chr(39), chr(39) + 'baseline' + chr(39), 'b.id', chr(39) + 'current' + chr(39), 'n.id')} AS comparison_id FROM pairs JOIN b ON bk = b.k JOIN n ON nk = n.k ORDER BY 1 LIMIT 100 OFFSET 50")
def page_comparisons(spark, d):
    return pages.page(core.comparisons(spark, d).where("status = 'matched'").select("comparison_id"), pages.ORDERS["comparisons"], 50, 100)


@query(core.V_MATCH + ", a AS (SELECT signature FROM g WHERE cb > 0 AND cn > 0 AND (cb > 1 OR cn > 1)) SELECT 'baseline' AS side, id FROM br WHERE signature IN (SELECT * FROM a) UNION ALL SELECT 'current', id FROM nr WHERE signature IN (SELECT * FROM a)")
def compare_ambiguous_rows(spark, d):
    return compare.ambiguous_rows(*core.v_sides(spark, d)).select("side", "id")


@query(f"WITH {core.V_CALLABLES}, {core.V_SPANS}, {core.V_OWNED}, {core.V_COVERED}, {core.V_SCORED}, {core.V_RANGES} SELECT id, risk, risk > 30 AS above_threshold FROM scored c WHERE EXISTS (SELECT 1 FROM v_ranges r WHERE r.file = c.file AND r.start_line <= c.end_line AND c.start_line <= r.end_line)")
def changed_scores(spark, d):
    c = scope.flagged(core.v_scored(spark, d), scope.changed_ranges(core.v_ranges(spark, d))).where("changed")
    return c.select("id", "risk", X.above_threshold(F.col("risk"), 30.0).alias("above_threshold"))


# Review and reports.
@query(f"WITH {core.LATEST} SELECT {core.fp_sql(chr(39) + 'review-finding-v1' + chr(39), 'CASE WHEN above_threshold THEN ' + chr(39) + 'quality' + chr(39) + ' ELSE ' + chr(39) + 'coverage' + chr(39) + ' END', 'id')} AS id, file, name, start_line FROM latest WHERE changed AND (above_threshold OR coverage_percent IS NULL OR coverage_percent < 50)")
def finding_evidence(spark, d):
    j = lambda k: F.get_json_object("evidence", "$." + k)
    return review.quality_findings(core.latest(spark, d)).select("id", j("file").alias("file"), j("name").alias("name"), j("start_line").cast("int").alias("start_line"))


@query(
    f"""WITH {core.LATEST}, q AS (SELECT above_threshold AS a FROM latest WHERE changed AND (above_threshold OR coverage_percent IS NULL OR coverage_percent < 50))
SELECT count(*) AS findings, count(*) AS quality, 0 AS regression_findings, count(*) FILTER (a) AS quality_findings, count(*) FILTER (NOT a) AS coverage_findings, 0 AS test_impact_findings, 0 AS architecture_findings FROM q"""
)
def review_counts(spark, d):
    return review.review_summary(review.ranked(review.quality_findings(core.latest(spark, d))))


@query(f"WITH {core.LATEST} SELECT printf('%8.2f %4d %s %s:%d %s', {core.r2('risk')}, complexity, CASE WHEN coverage_percent IS NULL THEN '   n/a' ELSE printf('%6.2f', coverage_percent) END, file, start_line, name) AS line FROM latest WHERE risk IS NOT NULL AND file IS NOT NULL AND name IS NOT NULL")
def report_lines(spark, d):
    rows = core.latest(spark, d).where("risk is not null and file is not null and name is not null")
    return reports.callable_text(rows.withColumn("risk", X.round2(F.col("risk"))))


@query(f"WITH {EDGES} SELECT id, type, from_id, to_id FROM edges ORDER BY id, type, from_id, to_id LIMIT 100 OFFSET 50")
def page_edges(spark, d):
    return pages.page(core.v_edges(spark, d).select("id", "type", "from_id", "to_id"), [*pages.ORDERS["edges"], "type", "from_id", "to_id"], 50, 100)


@query("SELECT code, path, severity FROM (SELECT DISTINCT code, path, severity FROM diagnostics WHERE path IS NOT NULL) ORDER BY code, path, severity LIMIT 100 OFFSET 20")
def page_diagnostics(spark, d):
    return pages.page(table(spark, d, "diagnostics").where("path is not null").select("code", "path", "severity").distinct(), [*pages.ORDERS["diagnostics"], "severity"], 20, 100)


# Graph.
@query(_P2 + "SELECT id AS node_id, struct_extract_at(b, 1) AS depth FROM best WHERE struct_extract_at(b, 1) > 3 UNION ALL SELECT id, -1 FROM bad")
def deep_nodes(spark, d):
    return graph.deep_nodes(core.v_edges(spark, d), 3)


@query(f"SELECT DISTINCT unnest(reference_ids) AS id FROM graph_edges WHERE {KIND} = 'imports' AND occurrences > 1 AND reference_ids IS NOT NULL")
def supporting_references(spark, d):
    e = table(spark, d, "graph_edges").where(F.lower(F.regexp_replace("type", r"^\s+|\s+$", "")) == "imports")
    refs = e.select(F.explode("reference_ids").alias("id")).distinct()
    return graph.supporting_references(refs, e.where("occurrences > 1"))


@query(
    f"""WITH RECURSIVE {EDGES}, e AS (SELECT * FROM edges WHERE type IN ('contains', 'declares', 'member-of', 'imports')),
s AS (SELECT id FROM (SELECT DISTINCT from_id AS id FROM e WHERE from_id IN (SELECT id FROM graph_nodes WHERE id IS NOT NULL)) ORDER BY id LIMIT 3),
r AS (SELECT id, 0 AS d FROM s UNION SELECT e.to_id, d + 1 FROM r JOIN e ON e.from_id = r.id WHERE d < 2), n AS (SELECT id, min(d) AS d FROM r GROUP BY id)
SELECT DISTINCT e.id, from_id, to_id FROM e JOIN n a ON a.id = from_id JOIN n b ON b.id = to_id WHERE b.d <= a.d + 1"""
)
def neighborhood_edges(spark, d):
    nodes, edges = table(spark, d, "graph_nodes"), core.v_edges(spark, d)
    starts = edges.where(F.col("type").isin(*graph.NEIGHBORHOOD_EDGE_TYPES)).select(F.col("from_id").alias("id")).join(nodes.select("id"), "id", "left_semi").distinct().orderBy("id").limit(3)
    return graph.neighborhood(nodes, edges, [r[0] for r in starts.collect()], direction="outgoing", depth=2, max_nodes=1000, max_edges=2000)[1]


# Calls: calls of interface methods meet the types that implement them.
_ICALLS = "SELECT l_partkey % 200 AS caller, l_suppkey % 10 AS interface, l_linenumber AS method, l_orderkey AS line, l_orderkey * 8 + l_linenumber AS seq FROM lineitem"
_IMPL = "SELECT DISTINCT s_suppkey % 10 AS interface, s_nationkey AS type FROM supplier"
_METHODS = "SELECT n_nationkey AS type, m AS method, 1000 + n_nationkey * 10 + m AS id FROM nation, (SELECT unnest([1, 2, 3, 4, 5, 6, 7]) AS m) WHERE (n_nationkey + m) % 3 <> 0"


@query(f"WITH c AS ({_ICALLS}), i AS ({_IMPL}), m AS ({_METHODS}) SELECT 'dispatch' AS kind, caller AS from_id, id AS to_id, count(*) AS occurrences FROM c JOIN i USING (interface) JOIN m USING (type, method) GROUP BY ALL")
def dispatch_edges(spark, d):
    c = table(spark, d, "lineitem").selectExpr("l_partkey % 200 AS caller", "l_suppkey % 10 AS interface", "l_linenumber AS method", "'a.go' AS path", "CAST(l_orderkey AS INT) AS line", "1 AS `column`", "l_orderkey * 8 + l_linenumber AS seq")
    i = table(spark, d, "supplier").selectExpr("s_suppkey % 10 AS interface", "s_nationkey AS type").distinct()
    m = table(spark, d, "nation").selectExpr("n_nationkey AS type", "explode(array(1, 2, 3, 4, 5, 6, 7)) AS method").where("(type + method) % 3 <> 0").selectExpr("type", "method", "1000 + type * 10 + method AS id")
    return calls.call_edges(calls.dispatch_facts(c, i, m)).select("kind", "from_id", "to_id", "occurrences")


@query(
    f"""WITH {core.LATEST}, p AS (SELECT DISTINCT file AS path, start_line AS line, start_column AS "column", name FROM latest),
i AS (SELECT file AS path, start_line AS line, start_column AS "column", min(id) AS id FROM latest WHERE depth > 0 GROUP BY ALL)
SELECT p.path, p.line, p."column", p.name, i.id IS NOT NULL AS matched FROM p LEFT JOIN i ON i.path = p.path AND i.line = p.line AND i."column" = p."column\""""
)
def function_inventory(spark, d):
    c = core.latest(spark, d)
    declared = c.select(F.col("file").alias("path"), F.col("start_line").alias("line"), F.col("start_column").alias("column"), "name").distinct()
    return calls.functions(declared, c.where("depth > 0")).select("path", "line", "column", "name", "matched")


@query(
    f"""WITH {core.LATEST}, p AS (SELECT DISTINCT file, start_line, start_column, name FROM latest), i AS (SELECT DISTINCT file, start_line, start_column FROM latest WHERE depth > 0),
c AS ({_ICALLS}), e AS (SELECT caller, method FROM c GROUP BY ALL)
SELECT count(*) AS functions, (SELECT count(*) FROM p JOIN i USING (file, start_line, start_column)) AS matched, (SELECT count(*) FROM e) AS static_edges, (SELECT count(*) FROM c) AS call_sites FROM p"""
)
def call_totals(spark, d):
    c = core.latest(spark, d)
    declared = c.select(F.col("file").alias("path"), F.col("start_line").alias("line"), F.col("start_column").alias("column"), "name").distinct()
    known = table(spark, d, "lineitem").selectExpr("'static' AS kind", "l_partkey % 200 AS caller", "l_linenumber AS callee", "'a.go' AS path", "CAST(l_orderkey AS INT) AS line", "1 AS `column`", "l_orderkey * 8 + l_linenumber AS seq")
    s = calls.call_summary(calls.functions(declared, c.where("depth > 0")), calls.call_edges(known), c.limit(0))
    return s.select("functions", (F.col("functions") - F.col("unmatched_functions")).alias("matched"), "static_edges", "call_sites")


# Mutation.
@query(
    f"""WITH m AS (SELECT l_suppkey AS suite, {core.MUTANT[0]} FROM lineitem), s AS (SELECT suite, count(*) FILTER (status = 'killed') AS k, count(*) FILTER (status = 'survived') AS l, count(*) FILTER (status = 'compileError') AS c FROM m GROUP BY suite)
SELECT suite FROM s WHERE suite % 3 = 0 OR (suite % 5 = 0 AND c > 0)"""
)
def efficacy_faults(spark, d):
    """Suites whose stated efficacy (off by 1 in every third) or total (without compile errors in every fifth) is wrong."""
    s = mutation.mutation_summary(core.v_mutants(spark, d), ["suite"])
    right = F.when(F.col("killed") + F.col("survived") > 0, F.col("killed").cast("double") * 100.0 / (F.col("killed") + F.col("survived"))).otherwise(0.0)
    stated = s.withColumn("reported_efficacy", right + F.when(F.col("suite") % 3 == 0, 1.0).otherwise(0.0))
    stated = stated.withColumn("reported_total", F.col("killed") + F.col("survived") + F.when(F.col("suite") % 5 == 0, 0).otherwise(F.col("compileError")))
    return mutation.efficacy_faults(stated).select("suite")


@query(f"WITH {core.V_CALLABLES}, {core.V_RANGES}, {core.V_MERGED} SELECT file, sum(end_line - start_line + 1) AS lines FROM merged GROUP BY file")
def changed_lines(spark, d):
    return intervals.merge_ranges(core.v_ranges(spark, d), ["file"]).groupBy("file").agg(F.sum(F.col("end_line") - F.col("start_line") + 1).alias("lines"))
