"""Source files and go.mod as DataFrames."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scan_sources(spark: SparkSession, root: str, glob: str = "*.{cs,go,rs,ts,tsx,CS,GO,RS,TS,TSX}") -> DataFrame:
    """path (relative to root), content and sha256 of all source files below a folder; the glob prunes the listing."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    at = root.rstrip("/").split(":", 1)[-1].lstrip("/")
    return raw.select(
        F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/*", ""), "^" + _escaped(at) + "/", "").alias("path"), "content", F.sha2("content", 256).alias("sha256"), F.lit(False).alias("explicit")
    )


def _escaped(text: str) -> str:
    return re.escape(text).replace("\\/", "/")


def explicit_sources(spark: SparkSession, root: str, paths: list[str]) -> DataFrame:
    """Files that a caller names; another extension is an error."""
    bad = [p for p in paths if not p.lower().endswith((".cs", ".go", ".rs", ".ts", ".tsx"))]
    if bad:
        raise ValueError(f"unsupported source {bad[0]}")
    raw = spark.read.format("binaryFile").load([f"{root.rstrip('/')}/{p}" for p in sorted(set(paths))])
    at = root.rstrip("/").split(":", 1)[-1].lstrip("/")
    return raw.select(F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/*", ""), "^" + _escaped(at) + "/", "").alias("path"), "content", F.sha2("content", 256).alias("sha256"), F.lit(True).alias("explicit"))


def fingerprints(files: DataFrame) -> DataFrame:
    """path and digest of each content."""
    return files.select("path", F.sha2("content", 256).alias("sha256")).distinct()


def go_module(text):
    """Module name in a go.mod text (column): the first module directive."""
    name = F.regexp_extract(text, r"(?m)^\s*module\s+(\S+)", 1)
    return F.when(name != "", F.regexp_replace(name, '"', ""))


def content_sha256(content, start_byte, end_byte):
    """Digest of the bytes [start, end) of a content, of all of it if the place isn't valid."""
    ok = (start_byte >= 0) & (end_byte >= start_byte) & (end_byte <= F.octet_length(content))
    part = F.substring(content, (start_byte + 1).cast("int"), (end_byte - start_byte).cast("int"))
    return F.sha2(F.when(F.coalesce(ok, F.lit(False)), part).otherwise(content), 256)


def byte_offset(text, line, column):
    """0-based byte offset of a 1-based line and byte column in a text; null if the line doesn't exist."""
    lines = F.split(text, "\n")
    before = F.aggregate(F.slice(lines, 1, F.greatest(line - 1, F.lit(0))), F.lit(0), lambda acc, x: acc + F.octet_length(x) + 1)
    return F.when((line >= 1) & (line <= F.size(lines)), before + column - 1)


def readable_source(content):
    """Text of a content for reports (column): without carriage returns; null if it isn't UTF-8."""
    text = F.when(F.is_valid_utf8(content.cast("string")), content.cast("string"))
    return F.replace(text, F.lit("\r"), F.lit(""))


def displayed_path(path: str, root: str) -> str:
    """A path relative to the root; '' for an absolute one elsewhere."""
    if not os.path.isabs(path):
        return path.replace("\\", "/")
    rel = os.path.relpath(path, root).replace("\\", "/")
    return "" if rel == ".." or rel.startswith("../") else rel


def go_module_root(root: str, paths: list[str]) -> str:
    """The folder of the one go.mod that is nearest to every path; none or several are an error."""
    found = set()
    for p in paths:
        at = os.path.realpath(os.path.join(root, p))
        at = at if os.path.isdir(at) else os.path.dirname(at)
        while True:
            mod = os.path.join(at, "go.mod")
            if os.path.isfile(mod) and not os.path.islink(mod):
                found.add(at)
                break
            if os.path.dirname(at) == at or at == os.path.realpath(root):
                raise ValueError(f"no go.mod above {p}")
            at = os.path.dirname(at)
    if len(found) != 1:
        raise ValueError("paths belong to several modules" if found else "no paths")
    return found.pop()
