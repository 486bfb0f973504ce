"""What changed between consecutive full snapshots of a keyed table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def squeezed(c: Column) -> Column:
    """Runs of whitespace as one space, none at the ends."""
    return F.regexp_replace(F.regexp_replace(c, r"(?U)\s+", " "), r"^ | $", "")


def normal_id(c: Column) -> Column:
    """Lower case, without surrounding whitespace."""
    return F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))


def text_differs(a: Column, b: Column) -> Column:
    return ~a.eqNullSafe(b)


def number_differs(tolerance: float):
    """Differs by the tolerance or more; null (and NaN) differs from any value but itself.

    The slack of 1e-9 keeps decimal differences that equal the tolerance, such as 4.03 - 4.02, on the
    'differs' side though their binary difference is a little smaller.
    """

    def differs(a: Column, b: Column) -> Column:
        known = lambda x: x.isNotNull() & ~F.isnan(x)
        far = F.abs(a - b) >= F.lit(tolerance - 1e-9)
        return F.when(known(a) & known(b), far).otherwise(~a.eqNullSafe(b))

    return differs


def snapshot_changes(
    df: DataFrame,
    manifest: DataFrame,
    *,
    scope: str = "repository",
    version: str = "snapshot_no",
    key: str = "id",
    delivered: str = "delivered_at",
    compared: dict | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Added, removed and changed keys between each snapshot and the one listed before it.

    df holds full deliveries, one row per key and snapshot (repeats allowed); manifest lists each delivered
    (scope, version). compared maps a result name to (normalising expression, differs(a, b)).

    Method: of several rows for a key in a snapshot the last delivered one is kept (aggregated on the map
    side, so a key that holds a third of the rows costs one row per task). The rest is range-partitioned
    and sorted by (scope, key, position of the snapshot); one pass over each range merges the adjacent
    snapshots, comparing a row with its neighbour at the position before and after. Ranges are cut by
    key, hence a hot scope or file is spread over many of them.

    Result: scope, version (the later one), key, change ('added', 'removed', 'changed'), fields (array of the
    names in ``compared`` that differ, empty unless 'changed'). Defined cases: rows with a null key, scope or
    version are left out, as are rows of snapshots that the manifest does not list; a key that is empty after
    trimming counts as null; ties in the delivery time are broken by the greatest compared values, so the result
    doesn't depend on row order; a listed snapshot without rows removes all keys of the one before; empty
    tables give an empty result; other columns of df, whatever their names, are ignored.
    """
    names = list(compared)
    norm = df.select(
        F.col(scope).alias("scope"),
        F.col(version).alias("version"),
        normal_id(F.col(key)).alias("key"),
        F.struct(
            F.col(delivered).alias("t"),
            *[expr.alias(f"v{i}") for i, (expr, _) in enumerate(compared[n] for n in names)],
        ).alias("row"),
    ).where("scope is not null and version is not null and key is not null and key <> ''")
    last = norm.groupBy("scope", "version", "key").agg(F.max("row").alias("row"))

    by_scope = Window.partitionBy("scope").orderBy("version")
    listed = (
        manifest.select(F.col(scope).alias("scope"), F.col(version).alias("version"))
        .where("scope is not null and version is not null")
        .distinct()
        .select(
            "scope",
            "version",
            F.row_number().over(by_scope).alias("pos"),
            F.lead("version").over(by_scope).alias("next_version"),
        )
    )
    placed = last.join(listed, ["scope", "version"]).select(
        "scope", "key", "pos", "version", "next_version", *[F.col(f"row.v{i}").alias(f"v{i}") for i in range(len(names))]
    )
    ranges = placed.repartitionByRange(partitions, "scope", "key") if partitions else placed.repartitionByRange("scope", "key")

    along = Window.partitionBy("scope", "key").orderBy("pos")
    lagged = {f"p{i}": F.lag(f"v{i}").over(along) for i in range(len(names))}
    merged = ranges.withColumns(
        {**lagged, "before": F.lag("pos").over(along), "after": F.lead("pos").over(along)}
    )
    fields = F.array_compact(
        F.array(*[F.when(compared[n][1](F.col(f"p{i}"), F.col(f"v{i}")), F.lit(n)) for i, n in enumerate(names)])
    )
    adjacent = F.col("before") == F.col("pos") - 1
    none = F.array().cast("array<string>")
    arrival = F.when((F.col("pos") > 1) & ~F.coalesce(adjacent, F.lit(False)), F.struct(F.col("version"), F.lit("added").alias("change"), none.alias("fields"))).when(
        adjacent & (F.size(fields) > 0), F.struct(F.col("version"), F.lit("changed").alias("change"), fields.alias("fields"))
    )
    leaving = F.when(
        F.col("next_version").isNotNull() & ~F.coalesce(F.col("after") == F.col("pos") + 1, F.lit(False)),
        F.struct(F.col("next_version").alias("version"), F.lit("removed").alias("change"), none.alias("fields")),
    )
    return (
        merged.select("scope", "key", F.explode(F.array_compact(F.array(arrival, leaving))).alias("e"))
        .select(F.col("scope").alias(scope), F.col("e.version").alias(version), F.col("key").alias(key), "e.change", "e.fields")
    )


def method_result_changes(snapshots: DataFrame, manifest: DataFrame) -> DataFrame:
    """Changes of method results: signature as text, risk by 0.01 or more."""
    return snapshot_changes(
        snapshots,
        manifest,
        compared={
            "signature": (squeezed(F.col("signature")), text_differs),
            "risk": (F.col("risk"), number_differs(0.01)),
        },
    )
