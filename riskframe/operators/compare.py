"""Comparison of two revisions' callables: matching by id, then by declaration, leftovers, deltas and regressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.functions.expr import fingerprint, nullable_delta
from riskframe.runtime import Scratch


def with_declaration(callables: DataFrame) -> DataFrame:
    return callables.withColumn("declaration", fingerprint(F.lit("callable-declaration-v1"), F.col("language"), F.col("kind"), F.col("name"), F.col("signature")))


def _sole(df: DataFrame) -> DataFrame:
    """The ids (with declaration) of which both occur once on their side; from counts, never from windows over a hot key."""
    ids = df.groupBy("id").agg(F.count("*").alias("n_id"))
    decls = df.groupBy("declaration").agg(F.count("*").alias("n_decl"), F.min("id").alias("id"))
    return decls.where("n_decl = 1").join(ids.where("n_id = 1"), "id").select("id")


def compared(baseline: DataFrame, current: DataFrame, *, threshold: float = 30.0) -> DataFrame:
    """One row per comparison.

    Columns: comparison_id, status (matched, ambiguous, added, removed), strategy (id, declaration or null), change
    (unchanged, moved, modified, moved-modified or null), baseline and current (arrays of rows; one each if matched,
    none if ambiguous), baseline_rows and current_rows (their numbers), declaration, delta (complexity, coverage_percent,
    risk, comparable), regression, reasons.

    A pair matches by id if id and declaration are unique on both sides; the rest matches by declaration if that is unique
    on both sides among the rest, is one ambiguous group if it occurs on both sides otherwise, and is added or
    removed if it occurs on one. An ambiguous group may hold a third of all rows (``main()``), hence its rows are not
    gathered in one; ``ambiguous_rows`` lists them. Rows need: id, language, kind, name, signature, file, complexity,
    coverage_percent, risk, above_threshold, content_sha256, coverage_format, coverage_state.
    """
    b, c = with_declaration(baseline), with_declaration(current)
    # Which ids match and how often each declaration is left are read several times: small tables, written once.
    scratch = Scratch(baseline.sparkSession, "compare")
    by_id, b_rest, c_rest = _rests(b, c, scratch)
    row = lambda df, side: df.select("id", "declaration", F.struct(*df.columns).alias(side))
    none_b, none_c = (F.array().cast(f"array<{row(df, 'r').schema['r'].dataType.simpleString()}>") for df in (b, c))
    kinds = scratch.cut(_kinds(b_rest, c_rest))
    none = F.lit(None).cast("string")
    pair = lambda df: df.select(F.lit("matched").alias("status"), "strategy", F.array("b").alias("baseline"), F.array("c").alias("current"), "declaration")
    same_id = row(b, "b").join(by_id, "id").join(row(c, "c").drop("declaration").join(by_id, "id"), "id").withColumn("strategy", F.lit("id"))
    one = kinds.where("nb = 1 and nc = 1").select("declaration")
    same_decl = row(b_rest, "b").drop("id").join(one, "declaration").join(row(c_rest, "c").drop("id").join(one, "declaration"), "declaration").withColumn("strategy", F.lit("declaration"))
    only_b = row(b_rest, "b").join(kinds.where("nc = 0").select("declaration"), "declaration", "left_semi").select(F.lit("removed").alias("status"), none.alias("strategy"), F.array("b").alias("baseline"), none_c.alias("current"), "declaration")
    only_c = row(c_rest, "c").join(kinds.where("nb = 0").select("declaration"), "declaration", "left_semi").select(F.lit("added").alias("status"), none.alias("strategy"), none_b.alias("baseline"), F.array("c").alias("current"), "declaration")
    groups = kinds.where("nb > 0 and nc > 0 and (nb > 1 or nc > 1)").select(F.lit("ambiguous").alias("status"), none.alias("strategy"), none_b.alias("baseline"), none_c.alias("current"), "declaration", "nb", "nc")
    rows = pair(same_id).unionByName(pair(same_decl)).unionByName(only_b).unionByName(only_c)
    rows = rows.withColumn("nb", F.size("baseline").cast("long")).withColumn("nc", F.size("current").cast("long"))
    return judged(rows.unionByName(groups), threshold)


def _rests(b: DataFrame, c: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The ids that match by id, and the rows of each side that don't."""
    by_id = scratch.cut(_sole(b).join(_sole(c), "id"))
    return by_id, b.join(by_id, "id", "left_anti"), c.join(by_id, "id", "left_anti")


def _kinds(b_rest: DataFrame, c_rest: DataFrame) -> DataFrame:
    """declaration, nb, nc: how often each declaration is left on either side."""
    zero = lambda n: F.coalesce(F.col(n), F.lit(0)).alias(n)
    nb, nc = (df.groupBy("declaration").agg(F.count("*").alias(n)) for df, n in ((b_rest, "nb"), (c_rest, "nc")))
    return nb.join(nc, "declaration", "full").select("declaration", zero("nb"), zero("nc"))


def ambiguous_rows(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """The rows of the ambiguous groups: side (baseline or current), declaration, then the row's own columns."""
    b, c = with_declaration(baseline), with_declaration(current)
    _, b_rest, c_rest = _rests(b, c, Scratch(baseline.sparkSession, "compare"))
    groups = _kinds(b_rest, c_rest).where("nb > 0 and nc > 0 and (nb > 1 or nc > 1)").select("declaration")
    parts = [df.join(groups, "declaration", "left_semi").select(F.lit(side).alias("side"), *b.columns) for df, side in ((b_rest, "baseline"), (c_rest, "current"))]
    return parts[0].unionByName(parts[1])


def judged(rows: DataFrame, threshold: float) -> DataFrame:
    """Change, delta, regression and reasons of comparison rows."""
    b, c = F.try_element_at("baseline", F.lit(1)), F.try_element_at("current", F.lit(1))
    matched = F.col("status") == "matched"
    comparable = (b["coverage_format"].eqNullSafe(c["coverage_format"])) & (
        ((b["coverage_state"] == "measured") & (c["coverage_state"] == "measured")) | ((b["coverage_state"] == "absent") & (c["coverage_state"] == "absent"))
    )
    complexity = c["complexity"] - b["complexity"]
    coverage = F.when(b["coverage_format"].eqNullSafe(c["coverage_format"]), nullable_delta(c["coverage_percent"], b["coverage_percent"]))
    risk = F.when(comparable, nullable_delta(c["risk"], b["risk"]))
    moved = b["file"] != c["file"]
    modified = (
        ~b["content_sha256"].eqNullSafe(c["content_sha256"])
        | (complexity != 0)
        | (b["risk"] != c["risk"])
        | F.coalesce(coverage != 0, F.lit(False))
        | ~b["signature"].eqNullSafe(c["signature"])
    )
    crossed = comparable & ~b["above_threshold"] & c["above_threshold"]
    reasons = F.filter(
        F.array(
            F.when(matched & (complexity > 0), "complexity-increased"),
            F.when(matched & (coverage < 0), "coverage-decreased"),
            F.when(matched & (risk > 0), "risk-increased"),
            F.when(matched & crossed, "threshold-crossed"),
            F.when((F.col("status") == "added") & (c["risk"] > threshold), "added-above-threshold"),
        ),
        lambda x: x.isNotNull(),
    )
    regression = F.when(matched, crossed).when(F.col("status") == "added", c["risk"] > threshold).otherwise(False)
    # An ambiguous group is known by its declaration, any other comparison by the ids of its rows.
    group = F.array(F.concat(F.lit("declaration\0"), F.col("declaration")))
    ids = F.concat(F.transform("baseline", lambda x: F.concat(F.lit("baseline\0"), x["id"])), F.transform("current", lambda x: F.concat(F.lit("current\0"), x["id"])))
    return rows.select(
        fingerprint_list(F.lit("change-scope-comparison-v1"), F.col("status"), F.when(F.col("status") == "ambiguous", group).otherwise(ids)).alias("comparison_id"),
        "status",
        "strategy",
        F.when(matched, F.when(moved & modified, "moved-modified").when(moved, "moved").when(modified, "modified").otherwise("unchanged")).alias("change"),
        "baseline",
        "current",
        F.col("nb").alias("baseline_rows"),
        F.col("nc").alias("current_rows"),
        "declaration",
        F.when(matched, F.struct(complexity.alias("complexity"), coverage.alias("coverage_percent"), risk.alias("risk"), comparable.alias("comparable"))).alias("delta"),
        F.coalesce(regression, F.lit(False)).alias("regression"),
        reasons.alias("reasons"),
    )


def fingerprint_list(first, second, items):
    """Fingerprint of two fields and a list of 'name\\0value' pairs, each as two fields."""
    framed = lambda x: F.concat(F.unhex(F.lpad(F.hex(F.octet_length(F.encode(x, "UTF-8")).cast("long")), 16, "0")), F.encode(x, "UTF-8"))
    rest = F.aggregate(
        items,
        F.encode(F.lit(""), "UTF-8"),
        lambda acc, x: F.concat(acc, framed(F.substring_index(x, "\0", 1)), framed(F.substring_index(x, "\0", -1))),
    )
    return F.sha2(F.concat(framed(first), framed(second), rest), 256)


def comparison_summary(rows: DataFrame) -> DataFrame:
    return rows.agg(
        *[F.count_if(F.col("status") == s).alias(s) for s in ("matched", "added", "removed", "ambiguous")],
        F.count_if("regression").alias("regressions"),
        (F.count_if(F.col("status") == "ambiguous") == 0).alias("complete"),
    )
