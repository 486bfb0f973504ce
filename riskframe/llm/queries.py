"""Queries p3 and p5 to p8, with SQL where it can express them: parsers, packing, fitting and learned scores are tested otherwise."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskframe.llm import mixing, packing, topn, toxicity, unparsable
from riskframe.runtime import table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_diagnostics(spark, sf_dir).select("file_id")


def p3_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unparsable.checked(table(spark, sf_dir, "source_files")).where("not parsed")


def p3_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unparsable.rates(unparsable.checked(table(spark, sf_dir, "source_files")))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topn.riskiest_callables(table(spark, sf_dir, "callables")).select("repository", "file", "id", "rank_no")


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "container_specs"))


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.summary(p6_containers(spark, sf_dir), table(spark, sf_dir, "container_specs"))


def p7_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(p7_selection(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def _p8(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return toxicity.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "content_labels"), **options)


def p8_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _p8(spark, sf_dir)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _p8(spark, sf_dir, passages=False).where("toxic").select("doc_id")


def p8_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.rates(_p8(spark, sf_dir, passages=False))


QUERIES = {f.__name__: f for f in (p3_found, p3_diagnostics, p3_rates, p5_found, p6_containers, p6_fill, p7_selection, p7_shares, p8_found, p8_scores, p8_rates)}
ORACLE: dict[str, str] = {
    "p5_found": """
WITH last AS (SELECT repository, file, id, max(row(analyzed_at, loaded_at, risk)) AS r FROM callables WHERE id IS NOT NULL GROUP BY 1, 2, 3),
ranked AS (SELECT repository, file, id, row_number() OVER (PARTITION BY repository, file ORDER BY struct_extract_at(r, 3) DESC, id) AS rank_no
  FROM last WHERE struct_extract_at(r, 3) IS NOT NULL)
SELECT repository, file, id, CAST(rank_no AS INTEGER) AS rank_no FROM ranked WHERE rank_no <= 3""",
}
