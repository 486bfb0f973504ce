"""Reports of mutation engines as mutants."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.functions.expr import GREMLINS_STATUS, STRYKER_STATUS, mapped, normal_path, valid_report_path
from riskframe.operators.mutation import efficacy_faults, mutant_id, mutation_summary

_PLACE = "struct<line:int,column:int>"
STRYKER = f"schemaVersion string, files map<string, struct<language:string, mutants:array<struct<id:string, mutatorName:string, replacement:string, status:string, statusReason:string, location:struct<start:{_PLACE}, `end`:{_PLACE}>>>>>"
GREMLINS = "go_module string, test_efficacy double, mutations_coverage double, mutants_total int, mutants_killed int, mutants_lived int, mutants_not_viable int, mutants_not_covered int, files array<struct<file_name:string, mutations:array<struct<line:int, column:int, type:string, status:string>>>>"


def _checked_path(p):
    clean = normal_path(p)
    return F.when(~valid_report_path(p), F.raise_error(F.concat(F.lit("invalid report path "), F.coalesce(p, F.lit("null")))).cast("string")).otherwise(clean)


def _checked_status(status, kinds):
    known = mapped(kinds, status)
    return F.when(known.isNull(), F.raise_error(F.concat(F.lit("unknown status "), F.coalesce(status, F.lit("null")))).cast("string")).otherwise(known)


def stryker_mutants(reports: DataFrame) -> DataFrame:
    """Mutants of Stryker reports read with schema STRYKER; an unknown schema version, path or state fails the read."""
    ok = reports.withColumn("files", F.when(F.col("schemaVersion").rlike(r"^(1(\.\d+)*|2(\.\d+)*)$"), F.col("files")).otherwise(F.raise_error(F.lit("unsupported schema version")).cast(reports.schema["files"].dataType)))
    m = ok.select(F.explode("files").alias("path", "f")).select(_checked_path(F.col("path")).alias("file"), F.explode("f.mutants").alias("m"))
    start, end = F.col("m.location.start"), F.col("m.location.end")
    replacement = F.coalesce("m.replacement", F.lit(""))
    return m.select(
        mutant_id(F.col("file"), start["line"], start["column"], end["line"], end["column"], F.col("m.mutatorName"), replacement).alias("id"),
        F.col("m.id").alias("native_id"), "file", start["line"].alias("start_line"), start["column"].alias("start_column"), end["line"].alias("end_line"), end["column"].alias("end_column"),
        F.col("m.mutatorName").alias("mutator"), _checked_status(F.col("m.status"), STRYKER_STATUS).alias("status"), replacement.alias("replacement"), F.col("m.statusReason").alias("reason"),
    )


def gremlins_mutants(reports: DataFrame) -> DataFrame:
    """Mutants of Gremlins reports read with schema GREMLINS; they have a place but no end."""
    m = reports.select(F.explode("files").alias("f")).select(_checked_path(F.col("f.file_name")).alias("file"), F.explode("f.mutations").alias("m"))
    none = F.lit(None).cast("int")
    return m.select(
        mutant_id(F.col("file"), F.col("m.line"), F.col("m.column"), none, none, F.col("m.type"), F.lit("")).alias("id"),
        F.lit(None).cast("string").alias("native_id"), "file", F.col("m.line").alias("start_line"), F.col("m.column").alias("start_column"), none.alias("end_line"), none.alias("end_column"),
        F.col("m.type").alias("mutator"), _checked_status(F.col("m.status"), GREMLINS_STATUS).alias("status"), F.lit("").alias("replacement"), F.lit(None).cast("string").alias("reason"),
    )


# The report contract of each engine.
ENGINES = {"stryker": "mutation-testing-report-schema", "gremlins": "gremlins-json"}


def read_report(spark, path: str, engine: str, minimum: float = 80.0) -> DataFrame:
    """Mutants of one report file, checked: the engine is known, the report isn't empty, thresholds are percentages, no mutant
    occurs twice, and the totals that a Gremlins report states agree with its mutants."""
    if engine not in ENGINES:
        raise ValueError(f"unknown engine {engine}")
    if not 0 <= minimum <= 100:
        raise ValueError("the minimum is a percentage")
    schema, read = (STRYKER, stryker_mutants) if engine == "stryker" else (GREMLINS, gremlins_mutants)
    raw = spark.read.schema(schema).option("multiLine", "true").option("mode", "FAILFAST").json(path)
    mutants = read(raw)
    twice = mutants.groupBy("id").count().where("count > 1").first()
    if twice is not None:
        raise ValueError(f"mutant {twice['id']} occurs {twice['count']} times")
    if engine == "gremlins":
        stated = raw.agg(F.max("test_efficacy").alias("reported_efficacy"), F.sum("mutants_total").alias("reported_total")).withColumn("k", F.lit(1))
        counted = mutation_summary(mutants).withColumn("k", F.lit(1))
        known = counted.join(stated, "k").where("reported_efficacy is not null and reported_total is not null")
        if not efficacy_faults(known).isEmpty():
            raise ValueError("the report's totals disagree with its mutants")
    return mutants
