"""Source files that do not parse in the language their path names."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.runtime import map_arrow
from riskframe.syntax import LANGUAGES, extension, parse

_ERRORS = "array<struct<code:string,line:int,column:int,message:string>>"


def checked(files: DataFrame) -> DataFrame:
    """One row per file: file_id, repository, path, language, parsed, code, line, column, message, errors.

    Method: recursive-descent parsers with precedence climbing for expressions and panic-mode recovery read each
    content in the language that the path's extension names (.go, .cs, .rs, .ts, .tsx, in any case). errors
    holds every error in order, code to message the first. Contents are parsed where they lie; only the
    small results are shuffled to keep, for every file, the version fetched last (then the one loaded last).

    Defined cases: other extensions, a null path or id and a null content give no row (a later version with null
    content doesn't hide an earlier one); a leading byte order mark is allowed, bytes that aren't UTF-8 are an
    error; an empty file is right except in Go, which wants a package clause; files of any size are read
    whole; repeated rows count once; empty tables give an empty result; other columns are ignored.
    """

    def run(batches):
        for b in batches:
            cols: dict[str, list] = {k: [] for k in ("language", "errors")}
            keep = []
            for i, (path, content) in enumerate(zip(b.column(2).to_pylist(), b.column(3))):
                ext, source = extension(path), content.as_py()
                if ext is None or source is None:
                    continue
                keep.append(i)
                cols["language"].append(LANGUAGES[ext])
                cols["errors"].append([dict(zip(("code", "line", "column", "message"), e)) for e in parse(source, ext, facts=False).errors])
            at = pa.array(keep, pa.int64())
            kind = pa.list_(pa.struct([("code", pa.string()), ("line", pa.int32()), ("column", pa.int32()), ("message", pa.string())]))
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i).take(at) for i in (0, 1, 2, 4, 5)), pa.array(cols["language"], pa.string()), pa.array(cols["errors"], kind)],
                names=["file_id", "repository", "path", "fetched_at", "loaded_at", "language", "errors"],
            )

    rows = files.where("file_id is not null and content is not null").select("file_id", "repository", "path", "content", "fetched_at", "loaded_at")
    s = rows.schema
    out = f"file_id long, repository string, path string, fetched_at {s['fetched_at'].dataType.simpleString()}, loaded_at {s['loaded_at'].dataType.simpleString()}, language string, errors {_ERRORS}"
    parsed = map_arrow(rows.withColumn("file_id", F.col("file_id").cast("long")), run, out)
    last = parsed.groupBy("file_id").agg(F.max(F.struct("fetched_at", "loaded_at", "repository", "path", "language", "errors")).alias("f"))
    first = F.try_element_at("f.errors", F.lit(1))
    return last.select(
        "file_id",
        "f.repository",
        "f.path",
        "f.language",
        (F.size("f.errors") == 0).alias("parsed"),
        first["code"].alias("code"),
        first["line"].alias("line"),
        first["column"].alias("column"),
        first["message"].alias("message"),
        F.col("f.errors").alias("errors"),
    )


def rates(results: DataFrame) -> DataFrame:
    """Files, files that don't parse and their share per repository and language."""
    return results.groupBy("repository", "language").agg(
        F.count("*").alias("files"), F.count_if(~F.col("parsed")).alias("failed"), F.avg((~F.col("parsed")).cast("double")).alias("failed_rate")
    )
