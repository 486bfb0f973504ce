"""Coverage reports meet source files: ranked one-to-one path assignment, lookups, states and diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.functions.expr import path_match_rank
from riskframe.runtime import Scratch


def _suffixes(path: Column) -> Column:
    """A path and what is left of it after each of its folders."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))


def path_candidates(files: DataFrame, identities: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(file, identity, rank) of every identity, or alias of one, that a file can match with rank 1 to 3.

    files: file; identities: identity; aliases: alias, identity. Every match is equality without case of one side's path
    with the other's, or with what is left of it after some of its folders; the sides meet by equality on these, so that
    only pairs that match come out, however many files are named ``index.ts``.
    """
    names = identities.select(F.col("identity").alias("alias"), "identity")
    if aliases is not None:
        names = names.unionByName(aliases.select("alias", "identity"))
    left = files.select("file").where("file is not null").distinct().withColumn("low", F.lower("file"))
    right = names.where("alias is not null").distinct().withColumn("low", F.lower("alias"))
    longer = left.select("file", F.explode(_suffixes(F.col("low"))).alias("key")).join(right.withColumnRenamed("low", "key"), "key")
    shorter = right.select("alias", "identity", F.explode(_suffixes(F.col("low"))).alias("key"), "low").where("key <> low").join(left.withColumnRenamed("low", "key"), "key")
    met = longer.select("file", "alias", "identity").unionByName(shorter.select("file", "alias", "identity"))
    ranked = met.select("file", "identity", path_match_rank(F.col("file"), F.col("alias")).alias("rank")).where("rank > 0")
    return ranked.groupBy("file", "identity").agg(F.max("rank").alias("rank"))


def unique_claims(candidates: DataFrame) -> DataFrame:
    """One round: the files with a single candidate that no other file with a single candidate claims."""
    single = candidates.groupBy("file").agg(F.count("*").alias("n"), F.min("identity").alias("identity")).where("n = 1")
    return single.groupBy("identity").agg(F.count("*").alias("claims"), F.min("file").alias("file")).where("claims = 1").select("file", "identity")


def assign_paths(files: DataFrame, identities: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Coverage identity of each file: file, kind (exact, suffix, case-folded, ambiguous, unmatched), identity, candidates.

    Ranks go from exact to case-folded. In each, rounds give identities with exactly one single-candidate claimant to
    it, until none is left; files that still have candidates then are ambiguous and leave. The result doesn't
    depend on row order, since all claims of a round are settled at once.
    """
    scratch = Scratch(files.sparkSession, "paths")
    all_ = scratch.cut(path_candidates(files, identities, aliases))
    kinds = {3: "exact", 2: "suffix", 1: "case-folded"}
    given = ambiguous = None
    for rank in (3, 2, 1):
        left = all_.where(F.col("rank") >= rank).select("file", "identity")
        if given is not None:
            left = left.join(given.select("file"), "file", "left_anti").join(given.select("identity"), "identity", "left_anti")
        if ambiguous is not None:
            left = left.join(ambiguous.select("file").distinct(), "file", "left_anti")
        left = scratch.cut(left.select("file", "identity"))
        while True:  # every round settles a file
            new = scratch.cut(unique_claims(left).withColumn("kind", F.lit(kinds[rank])))
            if new.isEmpty():
                break
            given = new if given is None else given.unionByName(new)
            rest = scratch.cut(left.join(new.select("file"), "file", "left_anti").join(new.select("identity"), "identity", "left_anti").select("file", "identity"))
            scratch.drop(left)
            left = rest
        ambiguous = left if ambiguous is None else ambiguous.unionByName(left)
    several = ambiguous.groupBy("file").agg(F.array_sort(F.collect_set("identity")).alias("candidates"))
    none = F.array().cast("array<string>")
    return (
        files.select("file")
        .distinct()
        .join(given, "file", "left")
        .join(several, "file", "left")
        .select(
            "file",
            F.when(F.col("kind").isNotNull(), F.col("kind")).when(F.col("candidates").isNotNull(), "ambiguous").otherwise("unmatched").alias("kind"),
            "identity",
            F.coalesce("candidates", none).alias("candidates"),
        )
    )


def lookup_path(files: DataFrame, identities: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """The same without exclusivity: each file alone takes its best rank; several identities there are ambiguous."""
    c = path_candidates(files, identities, aliases)
    best = c.groupBy("file").agg(F.max("rank").alias("rank"))
    top = c.join(best, ["file", "rank"]).groupBy("file", "rank").agg(F.array_sort(F.collect_set("identity")).alias("candidates"))
    one = F.size("candidates") == 1
    name = F.when(F.col("rank") == 3, "exact").when(F.col("rank") == 2, "suffix").otherwise("case-folded")
    return files.select("file").distinct().join(top, "file", "left").select(
        "file", F.when(F.col("rank").isNull(), "unmatched").when(one, name).otherwise("ambiguous").alias("kind"), F.when(one, F.col("candidates")[0]).alias("identity"),
        F.when(F.coalesce(one, F.lit(True)), F.array().cast("array<string>")).otherwise(F.col("candidates")).alias("candidates"),
    )


def match_diagnostics(matches: DataFrame) -> DataFrame:
    """Diagnostics of path matches: warnings for inexact ones, errors for ambiguous and unmatched ones."""
    kind = F.col("kind")
    return matches.select(
        F.when(kind.isin("suffix", "case-folded"), "warning").when(kind.isin("ambiguous", "unmatched"), "error").alias("severity"),
        F.when(kind == "suffix", "coverage-path-suffix-matched").when(kind == "case-folded", "coverage-path-case-folded").when(kind == "ambiguous", "coverage-path-ambiguous").when(kind == "unmatched", "coverage-path-unmatched").alias("code"),
        F.col("file").alias("path"),
        "candidates",
    ).where("severity is not null")


def unknown_diagnostics(callables: DataFrame, matches: DataFrame) -> DataFrame:
    """One warning per file that has callables without coverage, unless its path is unmatched or ambiguous."""
    lost = matches.where("kind in ('unmatched', 'ambiguous')").select("file")
    return (
        callables.where("coverage_percent is null").join(lost, "file", "left_anti").groupBy("file").agg(F.count("*").alias("callables"))
        .select(F.lit("warning").alias("severity"), F.lit("coverage-callable-unknown").alias("code"), F.col("file").alias("path"), "callables")
    )


def coverage_state(callables: DataFrame, matches: DataFrame, loaded: bool = True) -> DataFrame:
    """Adds coverage_state: absent, unmatched, ambiguous, uninstrumented or measured."""
    if not loaded:
        return callables.withColumn("coverage_state", F.lit("absent"))
    kinds = matches.select("file", F.col("kind").alias("_kind"))
    return callables.join(kinds, "file", "left").withColumn(
        "coverage_state",
        F.when(F.col("_kind").isin("unmatched", "ambiguous"), F.col("_kind")).when(F.col("coverage_percent").isNull(), "uninstrumented").otherwise("measured"),
    ).drop("_kind")


def first_failure(diagnostics: DataFrame) -> DataFrame:
    """The error of the first path, if any (the strict gate)."""
    return diagnostics.where("severity = 'error'").agg(F.min_by("code", "path").alias("code"), F.min("path").alias("path"))
