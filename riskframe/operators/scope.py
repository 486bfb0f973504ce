"""Change scope: the files, callables and links that a set of changed ranges touches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.functions.expr import fingerprint
from riskframe.operators.intervals import merge_ranges, overlaps

SEEDS = 10_000


def changed_ranges(*parts: DataFrame) -> DataFrame:
    """Ranges of a diff and of untracked files as merged ranges per file."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return merge_ranges(out, ["file"])


def flagged(callables: DataFrame, ranges: DataFrame) -> DataFrame:
    """Adds changed: whether a callable overlaps a changed range."""
    hit = overlaps(callables, ranges).withColumn("changed", F.lit(True))
    return callables.drop("changed").join(hit, "id", "left").withColumn("changed", F.coalesce("changed", F.lit(False)))


def scope_files(ranges: DataFrame) -> DataFrame:
    return ranges.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("start_line", "end_line"))).alias("ranges")).select(fingerprint(F.lit("change-scope-file-v1"), F.col("file")).alias("id"), F.col("file").alias("path"), "ranges")


def scope_edges(files: DataFrame, callables: DataFrame) -> DataFrame:
    """contains edges from a changed file to its changed callables."""
    return files.select(F.col("id").alias("from_id"), F.col("path").alias("file")).join(callables.where("changed").select("file", F.col("id").alias("to_id")), "file").select(
        fingerprint(F.lit("change-scope-edge-v1"), F.lit("contains"), F.col("from_id"), F.col("to_id")).alias("id"), F.lit("contains").alias("type"), "from_id", "to_id"
    )


def scope_seeds(files: DataFrame, callables: DataFrame) -> DataFrame:
    """The nodes a graph query starts from: changed callables and changed files."""
    return callables.where("changed").select(F.lit("callable").alias("kind"), F.col("id").alias("node_id")).unionByName(files.select(F.lit("file").alias("kind"), F.col("id").alias("node_id")))
