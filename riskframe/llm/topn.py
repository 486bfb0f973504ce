"""The N items with the highest score in every group, under a fixed order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_n(
    df: DataFrame,
    *,
    group: list[str],
    item: str,
    score: str,
    version: list[str],
    n: int,
    rank: str = "rank_no",
) -> DataFrame:
    """Ranks 1 to n by score descending, then item ascending, in every group.

    Each item counts once per group, with its row that is last by the version columns; a null or NaN score
    isn't ranked (also if an earlier row of the item had one). Both steps prune before they shuffle: the
    latest row per item is aggregated on the map side, and the rank filter over row_number lets Spark's
    group limit keep n rows per group in every task before the exchange and after it, so a group with
    millions of items sends n rows per task.

    Defined cases: rows with a null item are left out; null group values form a group of their own; equal
    versions are settled by the greater score, so the result doesn't depend on row order; empty tables
    give an empty result; other columns are ignored. Columns out: group, item, rank, score.
    """
    last = (
        df.where(F.col(item).isNotNull())
        .groupBy(*[F.col(g) for g in group], F.col(item))
        .agg(F.max(F.struct(*[F.col(v).alias(f"v{i}") for i, v in enumerate(version)], F.col(score).alias("s"))).alias("_last"))
        .select(*group, item, F.col("_last.s").alias("_score"))
        .where(F.col("_score").isNotNull() & ~F.isnan("_score"))
    )
    order = Window.partitionBy(*group).orderBy(F.desc("_score"), F.asc(item))
    return (
        last.withColumn(rank, F.row_number().over(order))
        .where(F.col(rank) <= n)
        .select(*group, item, rank, F.col("_score").alias(score))
    )


def riskiest_callables(callables: DataFrame, n: int = 3) -> DataFrame:
    """The n callables of every file of a repository with the highest risk, each with its row analyzed last."""
    return top_n(callables, group=["repository", "file"], item="id", score="risk", version=["analyzed_at", "loaded_at"], n=n)
