"""Queries of the analysis operators over the driver's tables, with their SQL.

Where the tables hold no facts of a kind (spans, hunks, call facts), a deterministic adapter derives them; both sides use the
adapter's expressions as they stand here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.functions import expr as X
from riskframe.operators import build, calls, compare, coverage, discovery, facts, graph, intervals, mutation, review, scope
from riskframe.plans import pages
from riskframe.runtime import Scratch, table
from riskframe.sources import files

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


# Adapters: expressions shared by Spark and DuckDB.
CALLABLES = [
    "p_partkey AS id",
    "'src/' || lower(replace(p_brand, '#', '')) || '/' || lower(replace(p_type, ' ', '_')) || '.go' AS file",
    "CAST(1 + p_size % 12 AS INT) AS complexity",
    "CAST(p_partkey % 3 AS INT) AS depth",
    "CAST(1 + (p_partkey % 97) * 10 AS INT) AS start_line",
    "CAST(1 + (p_partkey % 97) * 10 + p_size AS INT) AS end_line",
    "(p_partkey % 97) * 800 AS start_byte",
    "(p_partkey % 97) * 800 + p_size * 80 + 79 AS end_byte",
    "p_name AS name",
]
SPAN = ["file", "CAST(1 + l_orderkey % 970 AS INT) AS start_line", "CAST(1 + l_orderkey % 970 + l_linenumber % 3 AS INT) AS end_line", "CAST(l_quantity AS INT) AS statements", "l_returnflag <> 'N' AS covered"]
RANGE = ["file", "CAST(1 + o_orderkey % 970 AS INT) AS start_line", "CAST(1 + o_orderkey % 970 + o_custkey % 5 AS INT) AS end_line"]
MUTANT = ["CASE l_returnflag || l_linestatus WHEN 'AF' THEN 'killed' WHEN 'AO' THEN 'timedOut' WHEN 'NF' THEN 'survived' WHEN 'NO' THEN 'noCoverage' WHEN 'RF' THEN 'compileError' ELSE 'ignored' END AS status"]
V_CALLABLES = f"v_callables AS (SELECT {', '.join(CALLABLES)} FROM part)"
V_SPANS = f"v_spans AS (SELECT {', '.join(SPAN)} FROM lineitem JOIN v_callables ON l_partkey = id)"
V_RANGES = f"v_ranges AS (SELECT {', '.join(RANGE)} FROM orders JOIN v_callables ON 1 + o_orderkey % (SELECT count(*) FROM part) = id)"
V_MERGED = """m0 AS (SELECT DISTINCT file, start_line AS s, end_line AS e FROM v_ranges),
m1 AS (SELECT *, max(e) OVER (PARTITION BY file ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM m0),
m2 AS (SELECT *, sum(CASE WHEN r IS NULL OR s > r + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM m1),
merged AS (SELECT file, min(s) AS start_line, max(e) AS end_line FROM m2 GROUP BY file, g)"""
V_OWNED = """o1 AS (SELECT file, id, line, row_number() OVER (PARTITION BY file, line ORDER BY depth DESC, start_byte, end_byte, id) AS rn
  FROM (SELECT *, unnest(generate_series(start_line, end_line)) AS line FROM v_callables)),
o2 AS (SELECT file, id, line, line - row_number() OVER (PARTITION BY file, id ORDER BY line) AS g FROM o1 WHERE rn = 1),
owned AS (SELECT file, id, CAST(min(line) AS INTEGER) AS start_line, CAST(max(line) AS INTEGER) AS end_line FROM o2 GROUP BY file, id, g)"""


def r2(x: str) -> str:
    return f"(sign(({x}) * 100.0) * floor(abs(({x}) * 100.0) + 0.5) / 100.0)"


def score_sql(cov: str) -> str:
    miss = f"(CAST(1.0 AS DOUBLE) - least(greatest(coalesce({cov}, CAST(0.0 AS DOUBLE)), CAST(0.0 AS DOUBLE)), CAST(100.0 AS DOUBLE)) / CAST(100.0 AS DOUBLE))"
    return r2(f"CAST(complexity AS DOUBLE) * CAST(complexity AS DOUBLE) * {miss} * {miss} * {miss} + CAST(complexity AS DOUBLE)")


V_COVERED = f"""covered AS (SELECT o.id, {r2('CAST(sum(CASE WHEN covered THEN statements ELSE 0 END) AS DOUBLE) * 100.0 / sum(statements)')} AS coverage_percent
  FROM v_spans s JOIN owned o ON s.file = o.file AND s.start_line >= o.start_line AND s.end_line <= o.end_line GROUP BY o.id HAVING sum(statements) > 0)"""
V_SCORED = f"scored AS (SELECT c.*, coverage_percent, {score_sql('coverage_percent')} AS risk FROM v_callables c LEFT JOIN covered USING (id))"
LATEST = "latest AS (SELECT * FROM callables WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY repository, id ORDER BY analyzed_at DESC, loaded_at DESC) = 1)"


def fp_sql(*fields: str) -> str:
    part = lambda f: f"unhex(lpad(hex(octet_length(encode({f}))), 16, '0')) || encode({f})"
    return "sha256(" + " || ".join(part(f"coalesce(CAST({f} AS VARCHAR), '')") for f in fields) + ")"


def v_callables(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").selectExpr(*CALLABLES)


def v_spans(spark: SparkSession, d: str) -> DataFrame:
    c = v_callables(spark, d).select("id", "file")
    return table(spark, d, "lineitem").join(c, F.col("l_partkey") == F.col("id")).selectExpr(*SPAN)


def v_ranges(spark: SparkSession, d: str) -> DataFrame:
    c = v_callables(spark, d).select("id", "file")
    return table(spark, d, "orders").join(c, F.expr(f"1 + o_orderkey % {table(spark, d, 'part').count()} = id")).selectExpr(*RANGE)


def v_scored(spark: SparkSession, d: str) -> DataFrame:
    c = v_callables(spark, d)
    cov = intervals.covered_percent(v_spans(spark, d), intervals.owned_ranges(c))
    return c.join(cov, "id", "left").withColumn("risk", X.risk_score(F.col("complexity"), F.col("coverage_percent")))


def latest(spark: SparkSession, d: str) -> DataFrame:
    """Each callable with its row analyzed last."""
    c = table(spark, d, "callables").where("id is not null")
    rest = [x for x in c.columns if x not in ("repository", "id", "analyzed_at", "loaded_at")]
    best = F.max(F.struct("analyzed_at", "loaded_at", *rest)).alias("r")
    return c.groupBy("repository", "id").agg(best).select("repository", "id", "r.*")


# Scores and summaries.
@query(f"SELECT repository, id, analyzed_at, loaded_at, {score_sql('coverage_percent')} AS score, {score_sql('coverage_percent')} > 30 AS above FROM callables")
def risk_score(spark, d):
    s = X.risk_score(F.col("complexity"), F.col("coverage_percent"))
    return table(spark, d, "callables").select("repository", "id", "analyzed_at", "loaded_at", s.alias("score"), X.above_threshold(s, 30.0).alias("above"))


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, {r2('l_extendedprice * l_discount')} AS v FROM lineitem")
def round2_edge(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", X.round2(F.col("l_extendedprice") * F.col("l_discount")).alias("v"))


_SUMMARY = f"""count(DISTINCT file) AS files, count(*) AS methods, count(*) FILTER (changed) AS changed_methods, count(*) FILTER (above_threshold) AS above_threshold,
  coalesce({r2('avg(complexity)')}, 0.0) AS average_complexity, coalesce({r2('avg(risk)')}, 0.0) AS average_risk, coalesce(max(risk), 0.0) AS maximum_risk FROM latest"""


@query(f"WITH {LATEST} SELECT {_SUMMARY}")
def summary(spark, d):
    return review.summary(latest(spark, d))


@query(f"WITH {LATEST} SELECT repository, language, {_SUMMARY} GROUP BY repository, language")
def summary_by_language(spark, d):
    return review.summary(latest(spark, d), ["repository", "language"])


# Intervals and coverage.
@query(f"WITH {V_CALLABLES}, {V_OWNED} SELECT * FROM owned")
def owned_ranges(spark, d):
    return intervals.owned_ranges(v_callables(spark, d))


@query(f"WITH {V_CALLABLES}, {V_SPANS}, owned AS (SELECT file, id, start_line, end_line FROM v_callables), {V_COVERED} SELECT * FROM covered")
def coverage_percent(spark, d):
    return intervals.covered_percent(v_spans(spark, d), v_callables(spark, d).select("file", "id", "start_line", "end_line")).where("coverage_percent is not null")


@query(f"WITH {V_CALLABLES}, {V_SPANS}, {V_OWNED}, {V_COVERED}, {V_SCORED} SELECT id, file, complexity, coverage_percent, risk, risk > 30 AS above_threshold FROM scored")
def owned_coverage_score(spark, d):
    return v_scored(spark, d).select("id", "file", "complexity", "coverage_percent", "risk", X.above_threshold(F.col("risk"), 30.0).alias("above_threshold"))


@query(f"WITH {V_CALLABLES}, {V_RANGES}, {V_MERGED} SELECT * FROM merged")
def merge_ranges(spark, d):
    return intervals.merge_ranges(v_ranges(spark, d), ["file"])


@query(f"WITH {V_CALLABLES}, {V_RANGES} SELECT id FROM v_callables c WHERE EXISTS (SELECT 1 FROM v_ranges r WHERE r.file = c.file AND r.start_line <= c.end_line AND c.start_line <= r.end_line)")
def changed_callables(spark, d):
    return intervals.overlaps(v_callables(spark, d), scope.changed_ranges(v_ranges(spark, d)))


@query(
    f"""WITH {V_CALLABLES}, {V_RANGES}, f AS (SELECT DISTINCT file, {fp_sql("'change-scope-file-v1'", 'file')} AS fid FROM v_ranges),
c AS (SELECT c.id, c.file FROM v_callables c WHERE EXISTS (SELECT 1 FROM v_ranges r WHERE r.file = c.file AND r.start_line <= c.end_line AND c.start_line <= r.end_line))
SELECT {fp_sql("'change-scope-edge-v1'", "'contains'", 'fid', 'id')} AS id, 'contains' AS type, fid AS from_id, id AS to_id FROM f JOIN c USING (file)"""
)
def change_scope_edges(spark, d):
    ranges = scope.changed_ranges(v_ranges(spark, d))
    return scope.scope_edges(scope.scope_files(ranges), scope.flagged(v_callables(spark, d), ranges))


@query(f"WITH {V_CALLABLES}, {V_RANGES}, {V_MERGED} SELECT {fp_sql(chr(39) + 'change-scope-file-v1' + chr(39), 'file')} AS id, file AS path, count(*) AS ranges, min(start_line) AS first_line FROM merged GROUP BY file")
def change_scope_files(spark, d):
    f = scope.scope_files(scope.changed_ranges(v_ranges(spark, d)))
    return f.select("id", "path", F.size("ranges").cast("long").alias("ranges"), F.col("ranges")[0]["start_line"].alias("first_line"))


@query(
    f"""WITH {V_CALLABLES}, {V_RANGES}, c AS (SELECT id FROM v_callables c WHERE EXISTS (SELECT 1 FROM v_ranges r WHERE r.file = c.file AND r.start_line <= c.end_line AND c.start_line <= r.end_line))
SELECT 'callable' AS kind, CAST(id AS VARCHAR) AS node_id FROM c UNION ALL SELECT DISTINCT 'file', {fp_sql("'change-scope-file-v1'", 'file')} FROM v_ranges"""
)
def change_scope_seeds(spark, d):
    ranges = scope.changed_ranges(v_ranges(spark, d))
    flagged = scope.flagged(v_callables(spark, d), ranges).withColumn("id", F.col("id").cast("string"))
    return scope.scope_seeds(scope.scope_files(ranges), flagged)


# Identity.
@query(f"SELECT DISTINCT repository, id, {fp_sql('language', 'file', 'kind', 'stable_owner', 'name', 'occurrence')} AS fp FROM callables")
def fingerprint_ids(spark, d):
    c = table(spark, d, "callables")
    return c.select("repository", "id", X.fingerprint(*[F.col(x) for x in ("language", "file", "kind", "stable_owner", "name", "occurrence")]).alias("fp")).distinct()


@query("SELECT DISTINCT path, sha256(content) AS sha256 FROM source_files WHERE content IS NOT NULL")
def source_fingerprints(spark, d):
    return files.fingerprints(table(spark, d, "source_files").where("content is not null"))


@query(
    f"WITH {LATEST} SELECT repository, id, CAST(row_number() OVER (PARTITION BY repository, file, kind, name, signature ORDER BY start_byte, end_byte, id) - 1 AS INTEGER) AS occurrence FROM latest"
)
def occurrence_ids(spark, d):
    c = latest(spark, d).drop("occurrence")
    return facts.occurrence_ids(c, ["repository", "file", "kind", "name", "signature"], ["start_byte", "end_byte", "id"]).select("repository", "id", "occurrence")


# Path matching: identities derived from the paths of source files.
K = "instr('0123456789abcdef', substr(md5(file), 1, 1)) % 4 AS k"
PATHS = f"paths AS (SELECT file, {K} FROM (SELECT DISTINCT path AS file FROM source_files WHERE path IS NOT NULL))"
IDENTITY = "CASE CAST(k AS INT) WHEN 0 THEN file WHEN 1 THEN 'build/' || file WHEN 2 THEN upper(file) ELSE 'none/' || md5(file) END AS identity"
RANK_SQL = """CASE WHEN file = identity THEN 3 WHEN ends_with(file, '/' || identity) OR ends_with(identity, '/' || file) THEN 2
 WHEN lower(file) = lower(identity) OR ends_with(lower(file), '/' || lower(identity)) OR ends_with(lower(identity), '/' || lower(file)) THEN 1 ELSE 0 END"""


def v_paths(spark, d):
    p = table(spark, d, "source_files").where("path is not null").select(F.col("path").alias("file")).distinct()
    return p, p.selectExpr("file", K).selectExpr(IDENTITY)


@query(
    f"""WITH {PATHS}, i AS (SELECT {IDENTITY} FROM paths),
c AS (SELECT file, identity, {RANK_SQL} AS rank FROM paths JOIN i ON lower(regexp_extract(file, '[^/]*$')) = lower(regexp_extract(identity, '[^/]*$')))
SELECT file, identity, max(rank) AS rank FROM c WHERE rank > 0 GROUP BY file, identity"""
)
def path_rank(spark, d):
    f, i = v_paths(spark, d)
    return coverage.path_candidates(f, i)


_ROUND = """WITH {paths}, i AS (SELECT {identity} FROM paths),
c AS (SELECT file, identity, {rank} AS rank FROM paths JOIN i ON lower(regexp_extract(file, '[^/]*$')) = lower(regexp_extract(identity, '[^/]*$'))),
s AS (SELECT file, min(identity) AS identity FROM c WHERE rank = 3 GROUP BY file HAVING count(DISTINCT identity) = 1)
SELECT min(file) AS file, identity FROM s GROUP BY identity HAVING count(*) = 1"""


@query(_ROUND.format(paths=PATHS, identity=IDENTITY, rank=RANK_SQL))
def path_assign_round1(spark, d):
    f, i = v_paths(spark, d)
    return coverage.unique_claims(coverage.path_candidates(f, i).where("rank = 3")).select("file", "identity")


@query()
def path_assign(spark, d):
    return coverage.assign_paths(*v_paths(spark, d))


@query(
    f"""WITH {PATHS}, i AS (SELECT {IDENTITY} FROM paths),
c AS (SELECT file, identity, max({RANK_SQL}) AS rank FROM paths JOIN i ON lower(regexp_extract(file, '[^/]*$')) = lower(regexp_extract(identity, '[^/]*$')) GROUP BY file, identity),
b AS (SELECT file, max(rank) AS best FROM c WHERE rank > 0 GROUP BY file),
t AS (SELECT file, best, count(*) AS n, min(identity) AS identity FROM c JOIN b USING (file) WHERE rank = best GROUP BY file, best)
SELECT p.file, CASE WHEN best IS NULL THEN 'unmatched' WHEN n > 1 THEN 'ambiguous' WHEN best = 3 THEN 'exact' WHEN best = 2 THEN 'suffix' ELSE 'case-folded' END AS kind,
 CASE WHEN n = 1 THEN identity END AS identity FROM paths p LEFT JOIN t USING (file)"""
)
def path_lookup(spark, d):
    return coverage.lookup_path(*v_paths(spark, d)).drop("candidates")


@query()
def path_diagnostics(spark, d):
    return coverage.match_diagnostics(coverage.assign_paths(*v_paths(spark, d)))


@query(
    f"""WITH {V_CALLABLES}, {V_SPANS}, {V_OWNED}, {V_COVERED}, {V_SCORED}
SELECT 'warning' AS severity, 'coverage-callable-unknown' AS code, file AS path, count(*) AS callables FROM scored WHERE coverage_percent IS NULL GROUP BY file"""
)
def diagnostics_unknown(spark, d):
    c = v_scored(spark, d)
    return coverage.unknown_diagnostics(c, c.select("file", F.lit("exact").alias("kind")).limit(0))


@query(
    """SELECT DISTINCT lower(replace(trim(code), '_', '-')) AS code, severity, regexp_replace(trim(path), '\\\\', '/', 'g') AS path FROM diagnostics WHERE path IS NOT NULL AND code IS NOT NULL"""
)
def diagnostics_table(spark, d):
    t = table(spark, d, "diagnostics").where("path is not null and code is not null")
    return t.select(F.lower(F.replace(F.trim("code"), F.lit("_"), F.lit("-"))).alias("code"), "severity", F.regexp_replace(F.trim("path"), r"\\", "/").alias("path")).distinct()


# Comparison: a baseline and a perturbed copy of the parts.
SIG = "p_name || '|' || p_type || '|' || p_size || '|' || p_brand"
FILE = CALLABLES[1].rsplit(" AS ", 1)[0]
SIDE = {
    "b": ["p_partkey AS k", f"{FILE} || '|' || {SIG} AS id", f"{FILE} AS file", f"{SIG} AS signature", "p_name AS name", "CAST(1 + p_size % 12 AS INT) AS complexity"],
    "n": ["p_partkey AS k", f"CASE WHEN p_partkey % 7 = 0 THEN 'moved/' ELSE '' END || {FILE} || '|' || {SIG} AS id", f"CASE WHEN p_partkey % 7 = 0 THEN 'moved/' ELSE '' END || {FILE} AS file", f"{SIG} AS signature", "p_name AS name", "CAST(1 + p_size % 12 + CASE WHEN p_partkey % 5 = 0 THEN 4 ELSE 0 END AS INT) AS complexity"],
}
COV = "CASE WHEN k % 4 = 0 THEN NULL ELSE CAST(k % 101 AS DOUBLE) END AS coverage_percent"
V_SIDES = ",\n".join(
    f"""{s}0 AS (SELECT {', '.join(SIDE[s])} FROM part WHERE p_partkey % {m} <> 0), {s}1 AS (SELECT *, {COV} FROM {s}0),
{s} AS (SELECT *, {score_sql('coverage_percent')} AS risk, {score_sql('coverage_percent')} > 30 AS above_threshold,
 count(*) OVER (PARTITION BY id) AS ni, count(*) OVER (PARTITION BY signature) AS nd FROM {s}1)"""
    for s, m in (("b", 13), ("n", 11))
)
V_MATCH = f"""WITH {V_SIDES},
by_id AS (SELECT b.id, b.k AS bk, n.k AS nk FROM b JOIN n USING (id) WHERE b.ni = 1 AND b.nd = 1 AND n.ni = 1 AND n.nd = 1),
br AS (SELECT * FROM b WHERE id NOT IN (SELECT id FROM by_id)), nr AS (SELECT * FROM n WHERE id NOT IN (SELECT id FROM by_id)),
g AS (SELECT coalesce(x.signature, y.signature) AS signature, coalesce(cb, 0) AS cb, coalesce(cn, 0) AS cn, bk, nk
  FROM (SELECT signature, count(*) AS cb, min(k) AS bk FROM br GROUP BY signature) x FULL JOIN (SELECT signature, count(*) AS cn, min(k) AS nk FROM nr GROUP BY signature) y USING (signature)),
pairs AS (SELECT 'id' AS strategy, bk, nk FROM by_id UNION ALL SELECT 'declaration', bk, nk FROM g WHERE cb = 1 AND cn = 1)"""
DELTA = f"""SELECT b.id AS baseline_id, n.id AS current_id, strategy, n.complexity - b.complexity AS complexity, {r2('n.coverage_percent - b.coverage_percent')} AS coverage_percent,
 CASE WHEN (b.coverage_percent IS NULL) = (n.coverage_percent IS NULL) AND b.coverage_percent IS NOT NULL THEN {r2('n.risk - b.risk')} END AS risk,
 b.coverage_percent IS NOT NULL AND n.coverage_percent IS NOT NULL AS comparable, b.above_threshold AS ba, n.above_threshold AS na, b.file AS bf, n.file AS nf
 FROM pairs JOIN b ON bk = b.k JOIN n ON nk = n.k"""


def v_sides(spark, d):
    out = []
    for s, m in (("b", 13), ("n", 11)):
        c = table(spark, d, "part").where(f"p_partkey % {m} <> 0").selectExpr(*SIDE[s]).selectExpr("*", COV)
        c = c.withColumn("risk", X.risk_score(F.col("complexity"), F.col("coverage_percent"))).withColumn("above_threshold", X.above_threshold(F.col("risk"), 30.0))
        out.append(
            c.select(
                "id", F.lit("go").alias("language"), F.lit("function").alias("kind"), F.lit("").alias("name"), "signature", "file", "complexity", "coverage_percent", "risk", "above_threshold",
                F.sha2(F.col("complexity").cast("string"), 256).alias("content_sha256"), F.lit("go-coverprofile").alias("coverage_format"),
                F.when(F.col("coverage_percent").isNull(), "uninstrumented").otherwise("measured").alias("coverage_state"),
            )
        )
    return out


def comparisons(spark, d):
    return compare.compared(*v_sides(spark, d))


@query(V_MATCH + " SELECT b.id AS baseline_id, n.id AS current_id, strategy FROM pairs JOIN b ON bk = b.k JOIN n ON nk = n.k")
def compare_matched(spark, d):
    return comparisons(spark, d).where("status = 'matched'").select(F.get("baseline", F.lit(0))["id"].alias("baseline_id"), F.get("current", F.lit(0))["id"].alias("current_id"), "strategy")


@query(V_MATCH + " SELECT nr.id, risk > 30 AS regression FROM nr JOIN g USING (signature) WHERE cb = 0")
def compare_added(spark, d):
    return comparisons(spark, d).where("status = 'added'").select(F.get("current", F.lit(0))["id"].alias("id"), "regression")


@query(V_MATCH + " SELECT br.id FROM br JOIN g USING (signature) WHERE cn = 0")
def compare_removed(spark, d):
    return comparisons(spark, d).where("status = 'removed'").select(F.get("baseline", F.lit(0))["id"].alias("id"))


@query(V_MATCH + " SELECT cb AS baseline, cn AS current FROM g WHERE cb > 0 AND cn > 0 AND (cb > 1 OR cn > 1)")
def compare_ambiguous(spark, d):
    return comparisons(spark, d).where("status = 'ambiguous'").select(F.col("baseline_rows").alias("baseline"), F.col("current_rows").alias("current"))


@query(V_MATCH + f", x AS ({DELTA}) SELECT baseline_id, current_id, complexity, coverage_percent, risk, comparable FROM x")
def compare_deltas(spark, d):
    return comparisons(spark, d).where("status = 'matched'").select(F.get("baseline", F.lit(0))["id"].alias("baseline_id"), F.get("current", F.lit(0))["id"].alias("current_id"), "delta.complexity", "delta.coverage_percent", "delta.risk", "delta.comparable")


@query(
    V_MATCH
    + f""", x AS ({DELTA}) SELECT current_id, CASE WHEN bf <> nf AND complexity <> 0 THEN 'moved-modified' WHEN bf <> nf THEN 'moved' WHEN complexity <> 0 THEN 'modified' ELSE 'unchanged' END AS change,
 comparable AND NOT ba AND na AS regression FROM x"""
)
def compare_changes(spark, d):
    return comparisons(spark, d).where("status = 'matched'").select(F.get("current", F.lit(0))["id"].alias("current_id"), "change", "regression")


@query(
    V_MATCH
    + f""", x AS ({DELTA}), m AS (SELECT count(*) AS matched, count(*) FILTER (comparable AND NOT ba AND na) AS r FROM x),
 ad AS (SELECT count(*) AS added, count(*) FILTER (risk > 30) AS r FROM nr JOIN g USING (signature) WHERE cb = 0), re AS (SELECT count(*) AS removed FROM br JOIN g USING (signature) WHERE cn = 0),
 am AS (SELECT count(*) AS ambiguous FROM g WHERE cb > 0 AND cn > 0 AND (cb > 1 OR cn > 1))
 SELECT matched, added, removed, ambiguous, m.r + ad.r AS regressions, ambiguous = 0 AS complete FROM m, ad, re, am"""
)
def compare_summary(spark, d):
    return compare.comparison_summary(comparisons(spark, d))


# Code graph.
MEMBERS = "members AS (SELECT DISTINCT to_id AS module_id, from_id AS file FROM graph_edges WHERE lower(regexp_replace(type, '^\\s+|\\s+$', '', 'g')) = 'member-of' AND from_id IS NOT NULL AND to_id IS NOT NULL)"
ITEMS = """places AS (SELECT DISTINCT repository, path, id AS file FROM graph_nodes WHERE kind = 'file' AND path IS NOT NULL),
items AS (SELECT DISTINCT file, id, kind, metrics.complexity AS complexity, metrics.coverage_percent AS coverage_percent, metrics.risk AS risk, metrics.above_threshold AS above_threshold
  FROM graph_nodes JOIN places USING (repository, path) WHERE kind IN ('type', 'callable'))"""


@query(
    f"""WITH {MEMBERS}, {ITEMS}, i AS (SELECT *, kind = 'callable' AS c FROM items), j AS (SELECT m.module_id, m.file AS f, i.* FROM members m LEFT JOIN i ON i.file = m.file)
SELECT module_id, count(DISTINCT f) AS files, count(*) FILTER (NOT c) AS types, count(*) FILTER (c) AS callables, coalesce(CAST(sum(complexity) FILTER (c) AS BIGINT), 0) AS total_complexity, coalesce(max(complexity) FILTER (c), 0) AS maximum_complexity,
 count(coverage_percent) FILTER (c) AS known_coverage, count(*) FILTER (c) - count(coverage_percent) FILTER (c) AS unknown_coverage,
 {r2('CAST(sum(CAST(coverage_percent AS DECIMAL(20,6))) FILTER (c) AS DOUBLE) / nullif(count(coverage_percent) FILTER (c), 0)')} AS average_coverage, coalesce(max(risk) FILTER (c), 0.0) AS maximum_risk, count(*) FILTER (c AND above_threshold) AS above_threshold
FROM j GROUP BY module_id"""
)
def module_rollup(spark, d):
    n = table(spark, d, "graph_nodes")
    places = n.where("kind = 'file' and path is not null").select("repository", "path", F.col("id").alias("file")).distinct()
    items = n.where("kind in ('type', 'callable')").join(places, ["repository", "path"]).select("file", "id", "kind", "metrics.*").distinct()
    return graph.module_rollup(v_edges(spark, d).where("type = 'member-of'").select(F.col("to_id").alias("module_id"), F.col("from_id").alias("file")), items)


def v_edges(spark, d):
    e = table(spark, d, "graph_edges").where("from_id is not null and to_id is not null and type is not null")
    return e.withColumn("type", F.lower(F.regexp_replace("type", r"^\s+|\s+$", ""))).groupBy("type", "from_id", "to_id").agg(F.min("id").alias("id"), F.max("occurrences").alias("occurrences"))


@query(
    """WITH r AS (SELECT DISTINCT from_id, to_id, unnest(reference_ids) AS id FROM graph_edges WHERE lower(regexp_replace(type, '^\\s+|\\s+$', '', 'g')) = 'imports' AND from_id IS NOT NULL AND to_id IS NOT NULL)
SELECT from_id, to_id, count(*) AS occurrences, string_agg(id, ',' ORDER BY id) AS refs FROM r WHERE id IS NOT NULL GROUP BY from_id, to_id"""
)
def import_edges(spark, d):
    e = table(spark, d, "graph_edges").where(F.lower(F.regexp_replace("type", r"^\s+|\s+$", "")) == "imports").where("from_id is not null and to_id is not null")
    refs = e.select("from_id", "to_id", F.explode("reference_ids").alias("id")).where("id is not null").distinct()
    edges = graph.import_edges(refs.select("id", F.col("from_id").alias("source_module"), F.col("to_id").alias("target"), F.lit("resolved").alias("resolution")))
    return edges.select("from_id", "to_id", "occurrences", F.array_join("reference_ids", ",").alias("refs"))


@query(
    """WITH n AS (SELECT count(*) FILTER (kind = 'file') AS files, count(*) FILTER (kind = 'module') AS modules, count(*) FILTER (kind = 'type') AS types, count(*) FILTER (kind = 'callable') AS callables FROM graph_nodes),
e0 AS (SELECT lower(regexp_replace(type, '^\\s+|\\s+$', '', 'g')) AS t, from_id, to_id, max(occurrences) AS o FROM graph_edges WHERE from_id IS NOT NULL AND to_id IS NOT NULL AND type IS NOT NULL GROUP BY ALL),
e AS (SELECT count(*) FILTER (t = 'contains') AS contains, count(*) FILTER (t = 'declares') AS declares, count(*) FILTER (t = 'member-of') AS member_of, count(*) FILTER (t = 'imports') AS imports, CAST(sum(o) AS BIGINT) AS occurrences FROM e0)
SELECT * FROM n, e"""
)
def graph_summary(spark, d):
    return graph.graph_summary(table(spark, d, "graph_nodes"), v_edges(spark, d))


@query(
    """WITH e AS (SELECT min(id) AS id, lower(regexp_replace(type, '^\\s+|\\s+$', '', 'g')) AS t, from_id, to_id FROM graph_edges WHERE from_id IS NOT NULL AND to_id IS NOT NULL AND type IS NOT NULL GROUP BY ALL),
i AS (SELECT * FROM e WHERE t IN ('contains', 'declares'))
SELECT 'duplicate-node' AS fault, id FROM graph_nodes GROUP BY id HAVING count(*) > 1
UNION ALL SELECT DISTINCT 'missing-end', id FROM e WHERE from_id NOT IN (SELECT id FROM graph_nodes WHERE id IS NOT NULL) OR to_id NOT IN (SELECT id FROM graph_nodes WHERE id IS NOT NULL)
UNION ALL SELECT DISTINCT 'self-edge', id FROM i WHERE from_id = to_id
UNION ALL SELECT 'several-parents', to_id FROM i GROUP BY to_id HAVING count(DISTINCT from_id) > 1
UNION ALL SELECT DISTINCT 'file-with-parent', to_id FROM i WHERE to_id IN (SELECT id FROM graph_nodes GROUP BY id HAVING min(kind) = 'file')"""
)
def forest_faults(spark, d):
    return graph.forest_faults(table(spark, d, "graph_nodes"), v_edges(spark, d))


def all_imports(spark, d):
    return v_edges(spark, d).where("type = 'imports'").select("from_id", "to_id")


@query(
    """WITH RECURSIVE e AS (SELECT DISTINCT from_id AS a, to_id AS b FROM graph_edges WHERE lower(regexp_replace(type, '^\\s+|\\s+$', '', 'g')) = 'imports' AND from_id IS NOT NULL AND to_id IS NOT NULL),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a), m AS (SELECT x.a AS node, x.b AS other FROM r x JOIN r y ON x.a = y.b AND x.b = y.a)
SELECT node, min(other) AS component FROM m GROUP BY node"""
)
def import_cycles(spark, d):
    return graph.cyclic_components(all_imports(spark, d))


@query(
    """WITH RECURSIVE e AS (SELECT DISTINCT from_id AS a, to_id AS b FROM graph_edges WHERE lower(regexp_replace(type, '^\\s+|\\s+$', '', 'g')) IN ('imports', 'member-of') AND from_id IS NOT NULL AND to_id IS NOT NULL),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a), m AS (SELECT x.a AS node, x.b AS other FROM r x JOIN r y ON x.a = y.b AND x.b = y.a),
c AS (SELECT node, min(other) AS component FROM m GROUP BY node)
SELECT component, count(*) AS members FROM c GROUP BY component"""
)
def scc_members(spark, d):
    """The size of each cycle among files and modules."""
    e = v_edges(spark, d).where("type in ('imports', 'member-of')")
    return graph.cyclic_components(e).groupBy("component").agg(F.count("*").alias("members"))


@query(
    """WITH RECURSIVE e AS (SELECT DISTINCT from_id AS a, to_id AS b FROM graph_edges WHERE lower(regexp_replace(type, '^\\s+|\\s+$', '', 'g')) = 'imports' AND from_id IS NOT NULL AND to_id IS NOT NULL),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a), m AS (SELECT x.a AS node, x.b AS other FROM r x JOIN r y ON x.a = y.b AND x.b = y.a),
c AS (SELECT node, min(other) AS component FROM m GROUP BY node)
SELECT component, list_aggregate(list_sort(list(node)), 'string_agg', ',') AS modules, 0 AS loose FROM c GROUP BY component"""
)
def cycle_cover(spark, d):
    """The modules of each cycle, and how many of its modules the witness edges enter more or less often than they leave (none)."""
    w = cycle_witnesses(spark, d)
    ends = w.select("component", F.array_join("modules", ",").alias("modules"), F.explode(F.array(F.struct(F.col("from_id").alias("node"), F.lit(1).alias("n")), F.struct(F.col("to_id").alias("node"), F.lit(-1).alias("n")))).alias("e"))
    nodes = ends.groupBy("component", "modules", "e.node").agg(F.sum("e.n").alias("n"))
    return nodes.groupBy("component", "modules").agg(F.count_if(F.col("n") != 0).cast("int").alias("loose"))


@query()
def cycle_witnesses(spark, d):
    e = all_imports(spark, d)
    return graph.cycle_witnesses(e, graph.cyclic_components(e))


@query(
    """WITH e AS (SELECT DISTINCT from_id AS a, to_id AS b FROM graph_edges WHERE lower(regexp_replace(type, '^\\s+|\\s+$', '', 'g')) = 'imports' AND from_id IS NOT NULL AND to_id IS NOT NULL),
n AS (SELECT id, max(module."system" || '/' || module.name) AS name, max(module."system") AS s FROM graph_nodes WHERE kind = 'module' AND module IS NOT NULL GROUP BY id),
x AS (SELECT f.name AS "from", t.name AS "to", f.s AS "system" FROM e JOIN n f ON f.id = a JOIN n t ON t.id = b)
SELECT "from", "to", "system", 'go stays inside' AS reason, 0 AS rule FROM x WHERE "from" LIKE 'go-package/%' AND "system" = 'go-package'
UNION ALL SELECT "from", "to", "system", 'no imports of src', 1 FROM x WHERE regexp_matches("to", '^.*/src/.*$')"""
)
def forbid_violations(spark, d):
    e = v_edges(spark, d).where("type = 'imports'")
    m = table(spark, d, "graph_nodes").where("kind = 'module' and module is not null")
    names = m.groupBy("id").agg(F.max(F.concat(F.col("module.system"), F.lit("/"), F.col("module.name"))).alias("name"), F.max("module.system").alias("system"))
    return graph.forbidden(e, names, [{"from": "go-package/**", "to": "", "system": "go-package", "reason": "go stays inside"}, {"from": "", "to": "**/src/**", "reason": "no imports of src"}])


# The seeds are the three least ids that start an edge.
@query(
    """WITH RECURSIVE e AS (SELECT DISTINCT from_id AS a, to_id AS b FROM graph_edges WHERE lower(regexp_replace(type, '^\\s+|\\s+$', '', 'g')) IN ('contains', 'declares', 'member-of', 'imports') AND from_id IS NOT NULL AND to_id IS NOT NULL),
s AS (SELECT id FROM (SELECT DISTINCT a AS id FROM e WHERE a IN (SELECT id FROM graph_nodes WHERE id IS NOT NULL)) ORDER BY id LIMIT 3),
r AS (SELECT id, 0 AS distance FROM s UNION SELECT e.b, distance + 1 FROM r JOIN e ON e.a = r.id WHERE distance < 3)
SELECT id, min(distance) AS distance FROM r GROUP BY id"""
)
def bfs_neighborhood(spark, d):
    nodes, edges = table(spark, d, "graph_nodes"), v_edges(spark, d)
    starts = edges.where(F.col("type").isin(*graph.NEIGHBORHOOD_EDGE_TYPES)).select(F.col("from_id").alias("id")).join(nodes.select("id"), "id", "left_semi").distinct().orderBy("id").limit(3)
    kept, _, _ = graph.neighborhood(nodes, edges, [r[0] for r in starts.collect()], direction="outgoing", depth=3, max_nodes=1000, max_edges=2000)
    return kept


# Changed are the callables above the threshold; the files that lead to them over any edge stand for tests.
@query(
    """WITH RECURSIVE reach AS (SELECT DISTINCT from_id AS a, to_id AS b FROM graph_edges WHERE type IS NOT NULL AND from_id IS NOT NULL AND to_id IS NOT NULL),
seeds AS (SELECT DISTINCT id AS s FROM graph_nodes WHERE metrics.above_threshold AND id IS NOT NULL),
r(s, n, d) USING KEY (s, n) AS (SELECT s, s, 0 FROM seeds UNION
 (SELECT r.s, reach.a, min(r.d) + 1 FROM r JOIN reach ON reach.b = r.n LEFT JOIN recurring.r AS k ON k.s = r.s AND k.n = reach.a WHERE k.n IS NULL GROUP BY r.s, reach.a))
SELECT n AS test, coalesce(min(d) FILTER (d > 0), 0) AS distance, string_agg(s, ',' ORDER BY s) AS seeds FROM r WHERE n IN (SELECT id FROM graph_nodes WHERE kind = 'file') GROUP BY n"""
)
def affected_tests(spark, d):
    n = table(spark, d, "graph_nodes").where("id is not null")
    return graph.affected_tests(v_edges(spark, d), n.where("metrics.above_threshold").select("id"), n.where("kind = 'file'").select("id")).withColumn("seeds", F.array_join("seeds", ","))


# Calls.
CALL = ["'static' AS kind", "l_partkey % 200 AS caller", "l_suppkey % 20 AS callee", "'src/a.go' AS path", "CAST(l_orderkey AS INT) AS line", "l_linenumber AS column", "l_orderkey * 8 + l_linenumber AS seq"]


def v_call_facts(spark, d):
    return table(spark, d, "lineitem").selectExpr(*[c.replace("AS column", "AS `column`") for c in CALL])


@query(
    f"""WITH f AS (SELECT {', '.join(c.replace('AS column', 'AS col') for c in CALL)} FROM lineitem), d AS (SELECT caller, callee, line, col, min(seq) AS seq FROM f GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY caller, callee ORDER BY seq, line, col) AS rn FROM d),
s AS (SELECT caller, callee, string_agg(line || ':' || col, ',' ORDER BY line, col) FILTER (rn <= 25) AS call_sites, max(rn) > 25 AS truncated FROM k GROUP BY ALL),
t AS (SELECT caller, callee, count(*) AS occurrences FROM f GROUP BY ALL)
SELECT {fp_sql("'call-graph-edge-v1'", "'static'", 'caller', 'callee')} AS id, caller AS from_id, callee AS to_id, occurrences, call_sites, truncated FROM s JOIN t USING (caller, callee)"""
)
def call_edges(spark, d):
    e = calls.call_edges(v_call_facts(spark, d))
    sites = F.array_join(F.transform("call_sites", lambda x: F.concat_ws(":", x["line"], x["column"])), ",")
    return e.select("id", "from_id", "to_id", "occurrences", sites.alias("call_sites"), "truncated")


@query(
    """WITH u AS (SELECT DISTINCT l_partkey % 200 AS caller, CAST(l_orderkey AS INT) AS line FROM lineitem)
SELECT caller, line, (SELECT count(*) FROM u) AS total, (SELECT count(*) > 5000 FROM u) AS truncated FROM u ORDER BY line, caller LIMIT 5000"""
)
def unresolved_distinct(spark, d):
    f = table(spark, d, "lineitem").selectExpr("l_partkey % 200 AS caller", "CAST(NULL AS BIGINT) AS callee", "'src/a.go' AS path", "CAST(l_orderkey AS INT) AS line", "1 AS `column`", "'external' AS reason")
    page, numbers = calls.unresolved_calls(f)
    return graph.one_row(page.select("caller", "line"), numbers)


# Mutation.
def v_mutants(spark, d):
    return table(spark, d, "lineitem").selectExpr("l_suppkey AS suite", "l_orderkey AS file", "CAST(l_linenumber AS INT) AS start_line", "CAST(l_quantity AS INT) AS start_column", "l_partkey AS id", *MUTANT)


_MSUM = "count(*) AS total, " + ", ".join(f"count(*) FILTER (status = '{s}') AS \"{s}\"" for s in mutation.STATUSES) + ", count(*) FILTER (status IS NULL OR status NOT IN (" + ", ".join(f"'{s}'" for s in mutation.STATUSES) + ")) AS other"


@query(f"WITH m AS (SELECT l_suppkey AS suite, {MUTANT[0]} FROM lineitem) SELECT suite, {_MSUM} FROM m GROUP BY suite")
def mutation_summary(spark, d):
    return mutation.mutation_summary(v_mutants(spark, d), ["suite"])


@query(
    f"""WITH m AS (SELECT l_suppkey AS suite, {MUTANT[0]} FROM lineitem), s AS (SELECT suite, {_MSUM} FROM m GROUP BY suite),
x AS (SELECT suite, CASE WHEN killed + "timedOut" + survived + "noCoverage" > 0 THEN {r2('CAST(killed + "timedOut" AS DOUBLE) * 100.0 / (killed + "timedOut" + survived + "noCoverage")')} END AS score FROM s)
SELECT suite, score, coalesce(score >= 50, false) AS passed FROM x"""
)
def mutation_score(spark, d):
    return mutation.mutation_score(mutation.mutation_summary(v_mutants(spark, d), ["suite"]), 50.0).select("suite", "score", "passed")


@query(
    f"""WITH m AS (SELECT l_suppkey AS suite, l_orderkey AS file, CAST(l_linenumber AS INT) AS start_line, CAST(l_quantity AS INT) AS start_column, l_partkey AS id, {MUTANT[0]} FROM lineitem)
SELECT * FROM m WHERE status IN ('noCoverage', 'survived') ORDER BY file, start_line, start_column, id, suite LIMIT 100 OFFSET 40"""
)
def mutants_actionable_page(spark, d):
    return pages.page(mutation.chosen(v_mutants(spark, d)), ["file", "start_line", "start_column", "id", "suite"], 40, 100)


# Pages, discovery and review.
@query(f"WITH {LATEST} SELECT repository, id, risk FROM latest WHERE above_threshold ORDER BY risk DESC, id, repository LIMIT 20")
def page_violations(spark, d):
    return pages.page(pages.in_mode(latest(spark, d), "violations").where("risk is not null"), [F.desc("risk"), "id", "repository"]).select("repository", "id", "risk")


@query(f"WITH {LATEST} SELECT repository, id, risk FROM latest ORDER BY risk DESC NULLS LAST, id, repository LIMIT 100 OFFSET 500")
def page_all_offset(spark, d):
    return pages.page(pages.in_mode(latest(spark, d), "all"), [F.desc("risk"), "id", "repository"], 500, 100).select("repository", "id", "risk")


@query(
    """WITH p AS (SELECT DISTINCT path FROM source_files WHERE path IS NOT NULL),
r AS (SELECT path, CASE WHEN NOT regexp_matches(lower(path), '\\.(cs|go|rs|ts|tsx)$') THEN 'unsupported' WHEN path LIKE 'internal/%' THEN 'explicit-exclude'
 WHEN regexp_matches(path, '^(?:.*/)?[^/]*k\\.(ts|tsx)$') AND NOT regexp_matches(path, '^src/.*$') THEN 'gitignore'
 WHEN regexp_matches(lower(path), '_test\\.go$|(^|/)(tests|benches)/.*\\.rs$|\\.(spec|test)\\.tsx?$') THEN 'test' END AS reason FROM p),
k AS (SELECT reason, path, row_number() OVER (PARTITION BY reason ORDER BY path) AS rn FROM r WHERE reason IS NOT NULL)
SELECT reason, count(*) AS count, string_agg(path, ',' ORDER BY path) FILTER (rn <= 5) AS examples FROM k GROUP BY reason"""
)
def discovery_exclusions(spark, d):
    files = table(spark, d, "source_files").where("path is not null").select("path", F.lit(False).alias("explicit"))
    found = discovery.discover(files, excludes=["internal/"], gitignores={"": "*k.ts\n*k.tsx\n!src/**\n"}, include_generated=True)
    return discovery.exclusions(found).withColumn("examples", F.array_join("examples", ","))


@query(
    f"""WITH {LATEST}, q AS (SELECT id, CASE WHEN above_threshold THEN 'quality' ELSE 'coverage' END AS kind FROM latest WHERE changed AND (above_threshold OR coverage_percent IS NULL OR coverage_percent < 50))
SELECT {fp_sql("'review-finding-v1'", 'kind', 'id')} AS id, kind, CASE kind WHEN 'quality' THEN 2 ELSE 3 END AS priority, 'warning' AS severity FROM q
UNION ALL SELECT {fp_sql("'review-finding-v1'", "'architecture'", "'forbid' || chr(0) || from_id || chr(0) || to_id")}, 'architecture', 5, 'warning'
 FROM (SELECT DISTINCT from_id, to_id FROM graph_edges WHERE lower(regexp_replace(type, '^\\s+|\\s+$', '', 'g')) = 'imports' AND from_id IS NOT NULL AND to_id IS NOT NULL)"""
)
def findings_ranked(spark, d):
    v = v_edges(spark, d).where("type = 'imports'").select(F.lit("forbid").alias("kind"), F.col("from_id").alias("from"), F.col("to_id").alias("to"), F.lit("no imports").alias("reason"))
    none = v.select(F.array("from").alias("modules")).limit(0)
    return review.ranked(review.quality_findings(latest(spark, d)), review.architecture_findings(v, none)).select("id", "kind", "priority", "severity")


@query(
    """SELECT doc_id, octet_length(encode(text)) AS bytes, length(text) AS chars, length(text) + length(regexp_replace(text, '[^\U00010000-\U0010FFFF]', '', 'g')) AS utf16,
 length(text) - length(replace(text, chr(10), '')) + CASE WHEN text <> '' AND NOT ends_with(text, chr(10)) THEN 1 ELSE 0 END AS lines, sha256(encode(text)) AS sha FROM documents WHERE text IS NOT NULL"""
)
def text_columns(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").where("text is not null").select(
        "doc_id", F.octet_length(t).cast("long").alias("bytes"), F.char_length(t).cast("long").alias("chars"), X.utf16_length(t).cast("long").alias("utf16"), X.line_count(t).cast("long").alias("lines"), F.sha2(F.encode(t, "UTF-8"), 256).alias("sha")
    )


# Facts from source text (no SQL: a parser).
def last_parsed(spark, d):
    s = table(spark, d, "source_files").where("file_id is not null and content is not null")
    return facts.newest(facts.parsed(s, ("file_id", "fetched_at", "loaded_at")), "file_id", ["fetched_at", "loaded_at"])


@query()
def source_callables(spark, d):
    return facts.with_ids(facts.of_kind(last_parsed(spark, d), "callables")).withColumn("risk", X.risk_score(F.col("complexity"), F.lit(None).cast("double")))


@query()
def source_types(spark, d):
    return facts.of_kind(last_parsed(spark, d), "types")


@query()
def source_references(spark, d):
    return facts.of_kind(last_parsed(spark, d), "references")


@query()
def source_modules(spark, d):
    return facts.of_kind(last_parsed(spark, d), "modules").groupBy("language", "system", "name").agg(F.count_distinct("file").alias("files"))


def source_graph(spark, d):
    src = Scratch(spark, "sources").cut(last_parsed(spark, d))
    scored = facts.with_ids(facts.of_kind(src, "callables")).withColumn("coverage_percent", F.lit(None).cast("double"))
    scored = scored.withColumn("risk", X.risk_score(F.col("complexity"), F.col("coverage_percent"))).withColumn("above_threshold", X.above_threshold(F.col("risk"), 30.0))
    return build.build_graph(src.select(F.col("file").alias("path")), scored, parsed=src)


@query()
def source_graph_nodes(spark, d):
    return source_graph(spark, d)[0].select("id", "kind", "language", "name", "path", "declaration_kind")


@query()
def source_graph_edges(spark, d):
    return source_graph(spark, d)[1]


@query()
def source_syntax_gate(spark, d):
    return facts.syntax_gate(last_parsed(spark, d))


@query()
def resolved_references(spark, d):
    """Imports of the source files by how they resolve among their own modules."""
    return source_graph(spark, d)[2].groupBy("kind", "resolution", "reason").agg(F.count("*").alias("references"))


@query(
    """WITH e AS (SELECT lower(regexp_replace(type, '^\\s+|\\s+$', '', 'g')) AS type, from_id, to_id, min(id) AS id FROM graph_edges WHERE from_id IS NOT NULL AND to_id IS NOT NULL AND type IS NOT NULL GROUP BY ALL),
k AS (SELECT id, min(kind) AS kind FROM graph_nodes GROUP BY id), j AS (SELECT e.*, f.kind AS fk, t.kind AS tk FROM e JOIN k f ON f.id = from_id JOIN k t ON t.id = to_id)
SELECT 'node-kind' AS fault, id FROM graph_nodes WHERE kind IS NULL OR kind NOT IN ('file', 'module', 'type', 'callable')
UNION ALL SELECT 'edge-type', id FROM e WHERE type NOT IN ('contains', 'declares', 'member-of', 'imports')
UNION ALL SELECT DISTINCT 'edge-ends', id FROM j WHERE type IN ('contains', 'declares', 'member-of', 'imports') AND NOT coalesce(
 (type = 'declares' AND fk = 'type' AND tk = 'callable') OR (type = 'contains' AND fk IN ('file', 'type', 'callable') AND tk IN ('type', 'callable') AND NOT (fk = 'type' AND tk = 'callable'))
 OR (type = 'member-of' AND fk = 'file' AND tk = 'module') OR (type = 'imports' AND fk = 'module' AND tk = 'module'), false)"""
)
def enum_faults(spark, d):
    return graph.enum_faults(table(spark, d, "graph_nodes"), v_edges(spark, d))


@query(
    """WITH r AS (SELECT DISTINCT l_partkey % 300 AS a, l_suppkey AS b FROM lineitem), u AS (SELECT a, count(*) AS n FROM r GROUP BY a)
SELECT 'r' || a AS id, CAST(n AS BIGINT) AS edges FROM u WHERE n <> 1"""
)
def evidence_faults(spark, d):
    """References that several edges claim; here an edge per (reference, supplier) with the reference's own ends."""
    r = table(spark, d, "lineitem").selectExpr("'r' || CAST(l_partkey % 300 AS STRING) AS rid", "l_suppkey").distinct()
    edges = r.select(F.lit("imports").alias("type"), F.lit("a").alias("from_id"), F.lit("b").alias("to_id"), F.array("rid").alias("reference_ids"))
    refs = r.select(F.col("rid").alias("id"), F.lit("a").alias("source_module"), F.lit("b").alias("target"), F.lit("resolved").alias("resolution")).distinct()
    return graph.evidence_faults(edges, refs)


@query(
    """WITH l AS (SELECT 'm/p' || (l_partkey % 50) || '.go:' || (l_orderkey % 90 + 1) || '.' || l_linenumber || ',' || (l_orderkey % 90 + 3) || '.2 ' || (l_partkey % 50 % 7) || ' ' || CASE WHEN l_returnflag = 'N' THEN 0 ELSE CAST(l_quantity AS INT) END AS v FROM lineitem),
p AS (SELECT regexp_extract(v, '^(.+):(\\d+)\\.(\\d+),(\\d+)\\.(\\d+) (\\d+) (\\d+)$', ['identity', 'sl', 'sc', 'el', 'ec', 'st', 'c']) AS x FROM l)
SELECT x.identity AS identity, CAST(x.sl AS INT) AS start_line, CAST(x.sc AS INT) AS start_column, CAST(x.el AS INT) AS end_line, CAST(x.ec AS INT) AS end_column, CAST(x.st AS INT) AS statements, bool_or(CAST(x.c AS INT) > 0) AS covered FROM p GROUP BY ALL"""
)
def go_profile_spans(spark, d):
    from riskframe.sources.coverage_reports import go_profile

    v = "'m/p' || CAST(l_partkey % 50 AS STRING) || '.go:' || CAST(l_orderkey % 90 + 1 AS STRING) || '.' || CAST(l_linenumber AS STRING) || ',' || CAST(l_orderkey % 90 + 3 AS STRING) || '.2 ' || CAST(l_partkey % 50 % 7 AS STRING) || ' ' || CAST(CASE WHEN l_returnflag = 'N' THEN 0 ELSE CAST(l_quantity AS INT) END AS STRING) AS value"
    return go_profile(table(spark, d, "lineitem").selectExpr(v))


@query(
    """WITH l AS (SELECT 'Src\\P' || (l_partkey % 40) || '/./x/../A.cs' AS filename, l_orderkey % 500 + 1 AS number, CASE WHEN l_returnflag = 'N' THEN 0 ELSE 1 END AS h FROM lineitem)
SELECT 'Src/' || regexp_extract(filename, 'P\\d+') || '/A.cs' AS identity, CAST(number AS INT) AS start_line, bool_or(h > 0) AS covered FROM l GROUP BY ALL"""
)
def cobertura_spans(spark, d):
    from riskframe.sources.coverage_reports import cobertura

    rows = table(spark, d, "lineitem").selectExpr("'Src\\\\P' || CAST(l_partkey % 40 AS STRING) || '/./x/../A.cs' AS filename", "l_orderkey % 500 + 1 AS number", "CASE WHEN l_returnflag = 'N' THEN '0' ELSE '1' END AS hits")
    return cobertura(rows)[0].select("identity", "start_line", "covered")


@query(
    """WITH o AS (SELECT 'src/f' || (o_orderkey % 40) || '.go' AS file, CAST(o_orderkey % 900 + 1 AS INT) AS s, CAST(o_custkey % 4 AS INT) AS n FROM orders)
SELECT file, s AS start_line, CASE WHEN n = 0 THEN s ELSE s + n - 1 END AS end_line FROM o"""
)
def diff_hunks(spark, d):
    """Hunks of diffs, one per order: n added lines (a pure deletion if 0), with texts that look like headers."""
    from riskframe.sources.git import diff_ranges

    text = """'--- a/x\n+++ b/src/f' || CAST(o_orderkey % 40 AS STRING) || '.go\n@@ -7 +' || CAST(o_orderkey % 900 + 1 AS STRING) || ',' || CAST(o_custkey % 4 AS STRING) || ' @@\n--- old\n' || repeat('+++ b/not-a-header\n', CAST(o_custkey % 4 AS INT)) AS diff"""
    return diff_ranges(table(spark, d, "orders").selectExpr(text))
