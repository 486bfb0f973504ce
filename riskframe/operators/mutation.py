"""Mutation test reports: mutants, states, summaries, scores and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.functions.expr import ACTIONABLE, fingerprint, round2

STATUSES = ("killed", "survived", "noCoverage", "timedOut", "compileError", "runtimeError", "ignored")


def mutant_id(file, start_line, start_column, end_line, end_column, mutator, replacement):
    """Identity of a mutant by its place, mutator and replacement; the report's own id and status don't enter."""
    start = F.concat(start_line.cast("string"), F.lit(":"), start_column.cast("string"), F.lit("-"))
    place = F.when(end_line.isNull() | end_column.isNull(), F.concat(start, F.lit("point"))).otherwise(F.concat(start, end_line.cast("string"), F.lit(":"), end_column.cast("string")))
    return fingerprint(file, place, mutator, replacement)


def mutation_summary(mutants: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts per state; states that aren't known count as other."""
    return mutants.groupBy(*(by or [])).agg(
        F.count("*").alias("total"),
        *[F.count_if(F.col("status") == s).alias(s) for s in STATUSES],
        F.count_if(F.col("status").isNull() | ~F.col("status").isin(*STATUSES)).alias("other"),
    )


def mutation_score(summary: DataFrame, minimum: float = 80.0) -> DataFrame:
    """Adds score (detected of all valid mutants in percent, null without any) and passed (score of minimum or more)."""
    hit = F.col("killed") + F.col("timedOut")
    all_ = hit + F.col("survived") + F.col("noCoverage")
    score = F.when(all_ > 0, round2(hit.cast("double") * 100.0 / all_))
    return summary.withColumn("score", score).withColumn("passed", F.coalesce(score >= minimum, F.lit(False)))


def efficacy_faults(reports: DataFrame) -> DataFrame:
    """Reports whose own totals disagree with their mutants: killed / (killed + lived) in percent, and the total."""
    k, lived = F.col("killed"), F.col("survived")
    efficacy = F.when(k + lived > 0, k.cast("double") * 100.0 / (k + lived)).otherwise(0.0)
    return reports.where((F.abs(F.col("reported_efficacy") - efficacy) > 0.01) | (F.col("reported_total") != k + lived + F.col("compileError")))


def chosen(mutants: DataFrame, statuses: list[str] | None = None, mode: str = "actionable") -> DataFrame:
    """Mutants of a result mode: summary none, actionable the uncovered and survived ones, all; statuses override."""
    if statuses:
        if mode == "summary":
            raise ValueError("summary takes no statuses")
        if not set(statuses) <= set(STATUSES):
            raise ValueError("unknown status")
        return mutants.where(F.col("status").isin(*statuses))
    return mutants.where("false") if mode == "summary" else mutants.where(F.col("status").isin(*ACTIONABLE)) if mode == "actionable" else mutants


ORDER = ("file", "start_line", "start_column", "id")
