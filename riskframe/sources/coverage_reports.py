"""Cobertura XML and Go coverage profiles as coverage spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.functions.expr import is_absolute, normal_path

SOURCES = 1000  # source folders of one report; more are an error
SPANS = "identity string, start_line int, start_column int, end_line int, end_column int, statements int, covered boolean"


def coverage_format(text):
    """go-coverprofile or cobertura, by the first characters that aren't blank (column)."""
    return F.when(F.regexp_replace(text, r"^[\s\uFEFF]+", "").startswith("mode:"), "go-coverprofile").otherwise("cobertura")


def read_report(spark: SparkSession, path: str, root: str = "") -> tuple[DataFrame, DataFrame | None, str]:
    """(coverage spans, aliases or None, format) of a coverage report, told by its first line that isn't blank; an empty
    report is an error."""
    text = spark.read.text(path)
    first = text.where(F.length(F.regexp_replace("value", r"[\s\uFEFF]", "")) > 0).select(coverage_format(F.col("value"))).first()
    if first is None:
        raise ValueError(f"{path} is empty")
    if first[0] == "go-coverprofile":
        return go_profile(text), None, first[0]
    return *read_cobertura(spark, path, root), first[0]


def read_cobertura(spark: SparkSession, path: str, root: str = "") -> tuple[DataFrame, DataFrame]:
    """(coverage spans, aliases) of a Cobertura file."""
    classes = spark.read.format("xml").option("rowTag", "class").schema("_filename string, lines struct<line:array<struct<_number:long,_hits:string>>>").load(path)
    sources = spark.read.format("xml").option("rowTag", "sources").schema("source array<string>").load(path).select(F.explode("source").alias("source"))
    return cobertura(classes.select(F.col("_filename").alias("filename"), F.explode("lines.line").alias("l")).select("filename", F.col("l._number").alias("number"), F.col("l._hits").alias("hits")), sources, root)


def cobertura(lines: DataFrame, sources: DataFrame | None = None, root: str = "") -> tuple[DataFrame, DataFrame]:
    """(spans, aliases) of line hits (filename, number, hits as text).

    Repeated lines are merged: covered if any of them has hits. A line below 1, hits that aren't a number, or an empty file
    name fail the read. A relative name is its own identity, with aliases below each source folder (below the root, if the
    folder is absolute); an absolute name becomes relative to the root or else to the source folders, and is hashed if it
    lies in none of them, so that no foreign path leaks.
    """
    folders = [r[0] for r in sources.where("trim(source) <> ''").select(normal_path(F.col("source")).alias("source")).distinct().limit(SOURCES + 1).collect()] if sources is not None else []
    if len(folders) > SOURCES:
        raise ValueError(f"more than {SOURCES} source folders")
    bad = (F.col("number") < 1) | F.col("number").isNull() | F.col("hits").try_cast("long").isNull() | (F.coalesce(F.trim("filename"), F.lit("")) == "")
    names = identities(normal_path(F.col("filename")), sorted(f.rstrip("/") for f in folders), root.replace("\\", "/").rstrip("/"))
    checked = lines.select(
        F.when(bad, F.raise_error(F.concat_ws(" ", F.lit("bad coverage line of"), "filename", F.col("number").cast("string"), "hits")).cast("struct<identity:string,aliases:array<string>>")).otherwise(names).alias("i"),
        F.col("number").cast("int").alias("line"), (F.col("hits").try_cast("long") > 0).alias("hit"),
    ).select("i.identity", "i.aliases", "line", "hit")
    spans = checked.groupBy("identity", "line").agg(F.bool_or("hit").alias("covered")).select(
        "identity", F.col("line").alias("start_line"), F.lit(0).alias("start_column"), F.col("line").alias("end_line"), F.lit(0).alias("end_column"), F.lit(1).alias("statements"), "covered"
    )
    aliases = checked.select("identity", F.explode("aliases").alias("alias")).where("alias <> identity").distinct().select("alias", "identity")
    return spans, aliases


def identities(name, folders: list[str], root: str):
    """(identity, aliases) of a portable file name (column), given the report's source folders and the root."""
    below = lambda top, p: F.when(p.startswith(top + "/"), F.substring(p, F.lit(len(top) + 2), F.char_length(p)))
    in_root = below(root, name) if root else F.lit(None).cast("string")
    absolute = [f for f in folders if _absolute(f)]
    in_folders = F.array_sort(F.array_distinct(F.array_compact(F.array(*[below(f, name) for f in absolute], F.lit(None).cast("string")))))
    hashed = F.concat(F.lit("_external/"), F.substring(F.sha2(name, 256), 1, 12), F.lit("/"), F.substring_index(name, "/", -1))
    far = F.when(in_root.isNotNull(), F.array(in_root)).when(F.size(in_folders) > 0, in_folders).otherwise(F.array(hashed))
    joined = [normal_path(F.concat(F.lit(f + "/"), name)) for f in folders]
    near = F.array_sort(F.array_distinct(F.array_compact(F.array(name, *[(below(root, j) if root else F.lit(None).cast("string")) if _absolute(f) else j for f, j in zip(folders, joined)]))))
    is_far = is_absolute(name)
    return F.struct(F.when(is_far, far[0]).otherwise(name).alias("identity"), F.when(is_far, far).otherwise(near).alias("aliases"))


def _absolute(path: str) -> bool:
    return path.startswith("/") or path[1:3] == ":/"


_BLOCK = r"^(.+):(\d+)\.(\d+),(\d+)\.(\d+) (\d+) (\d+)$"


def go_profile(lines: DataFrame) -> DataFrame:
    """Spans of Go profile lines (value): equal blocks are merged, covered if any of them is.

    The mode line is skipped; another line that isn't a block, and one block with two statement counts, fail the read.
    """
    rows = lines.where("trim(value) <> '' and not value like 'mode:%'")
    part = lambda i: F.regexp_extract("value", _BLOCK, i)
    checked = rows.select(F.when(~F.col("value").rlike(_BLOCK), F.raise_error(F.concat(F.lit("bad profile line "), F.col("value"))).cast("string")).otherwise(F.col("value")).alias("value"))
    blocks = checked.select(
        part(1).alias("identity"), part(2).cast("int").alias("start_line"), part(3).cast("int").alias("start_column"), part(4).cast("int").alias("end_line"), part(5).cast("int").alias("end_column"),
        part(6).cast("int").alias("statements"), (part(7).cast("long") > 0).alias("covered"),
    )
    key = ["identity", "start_line", "start_column", "end_line", "end_column"]
    return blocks.groupBy(*key).agg(F.min("statements").alias("statements"), F.max("statements").alias("_most"), F.bool_or("covered").alias("covered")).select(
        *key, F.when(F.col("_most") != F.col("statements"), F.raise_error(F.lit("conflicting statement counts of a block")).cast("int")).otherwise(F.col("statements")).alias("statements"), "covered"
    )
