"""Unified review: ranked findings of regressions, quality, tests and architecture; scores and summaries of callables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.functions.expr import fingerprint, round2

LOW_COVERAGE = 50.0
# The order of kinds in a review.
PRIORITY = {"regression": 1, "quality": 2, "coverage": 3, "test-impact": 4, "architecture": 5}


def finding_id(kind, value):
    return fingerprint(F.lit("review-finding-v1"), F.lit(kind), value)


def _finding(df: DataFrame, kind: str, severity: str, title: str, key, id_kind: str | None = None, **evidence) -> DataFrame:
    return df.select(
        finding_id(id_kind or kind, key).alias("id"), F.lit(kind).alias("kind"), F.lit(PRIORITY[kind]).alias("priority"), F.lit(severity).alias("severity"),
        F.lit(title).alias("title"), F.to_json(F.struct(*[v.alias(k) for k, v in evidence.items()])).alias("evidence"),
    )


def quality_findings(callables: DataFrame) -> DataFrame:
    """Changed callables above the threshold, and those below it with low or unknown coverage."""
    ev = {c: F.col(c) for c in ("id", "file", "name", "start_line", "risk", "coverage_percent")}
    above = _finding(callables.where("changed and above_threshold"), "quality", "warning", "changed callable exceeds the risk threshold", F.col("id"), **ev)
    low = callables.where("changed and not above_threshold").where(F.col("coverage_percent").isNull() | (F.col("coverage_percent") < LOW_COVERAGE))
    return above.unionByName(_finding(low, "coverage", "warning", "changed callable has low or unknown coverage", F.col("id"), **ev))


def regression_findings(comparisons: DataFrame) -> DataFrame:
    m = F.coalesce(F.get("current", F.lit(0)), F.get("baseline", F.lit(0)))
    rows = comparisons.where("regression").select("comparison_id", "reasons", m.alias("m"))
    return _finding(rows, "regression", "error", "new quality regression", F.col("comparison_id"), file=F.col("m.file"), name=F.col("m.name"), risk=F.col("m.risk"), coverage_percent=F.col("m.coverage_percent"), reasons=F.col("reasons"))


def test_findings(tests: DataFrame) -> DataFrame:
    """tests: test, file, name, distance."""
    return _finding(tests, "test-impact", "info", "affected test candidate", F.concat_ws("\0", "test", "file", "name"), test=F.col("name"), file=F.col("file"), distance=F.col("distance"))


def architecture_findings(violations: DataFrame, cycles: DataFrame) -> DataFrame:
    """violations: kind, from, to, reason; cycles: modules (sorted array)."""
    v = _finding(violations, "architecture", "warning", "architecture rule violation in selected source", F.concat_ws("\0", F.col("kind"), F.col("from"), F.col("to")), **{"from": F.col("from"), "to": F.col("to"), "reason": F.col("reason")})
    c = _finding(cycles, "architecture", "warning", "architecture import cycle in selected source", F.array_join("modules", "\0"), "architecture-cycle", modules=F.col("modules"))
    return v.unionByName(c)


def ranked(*parts: DataFrame) -> DataFrame:
    """All findings in one table; the order is priority, kind, id."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy("priority", "kind", "id")


def review_summary(findings: DataFrame) -> DataFrame:
    return findings.agg(F.count("*").alias("findings"), F.count_if(F.col("kind").isin("quality", "coverage")).alias("quality"), *[F.count_if(F.col("kind") == k).alias(k.replace("-", "_") + "_findings") for k in PRIORITY])


def summary(callables: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Files, callables, changed and risky ones, averages of complexity and risk, greatest risk; zeros for none."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return callables.groupBy(*(by or [])).agg(
        F.count_distinct("file").alias("files"),
        F.count("*").alias("methods"),
        F.count_if("changed").alias("changed_methods"),
        F.count_if("above_threshold").alias("above_threshold"),
        zero(round2(F.avg("complexity"))).alias("average_complexity"),
        zero(round2(F.avg("risk"))).alias("average_risk"),
        zero(F.max("risk")).alias("maximum_risk"),
    )
