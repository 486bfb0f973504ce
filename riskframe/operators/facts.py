"""Source files to facts: callables, types, modules, references and syntax errors, with stable identities."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskframe.functions.expr import fingerprint
from riskframe.runtime import map_arrow
from riskframe.syntax import LANGUAGES, extension, parse

_PLACES = ("start_line", "start_column", "end_line", "end_column", "depth", "parent_index", "complexity")
_INTS = (*_PLACES, "owner")
_LONGS = ("start_byte", "end_byte")
_COLUMNS = {
    "callables": ("kind", "name", "signature", "parent_kind", *_PLACES, *_LONGS),
    "types": ("kind", "name", "parent_kind", "start_line", "start_column", "end_line", "end_column", "parent_index", *_LONGS),
    "modules": ("system", "name"),
    "calls": ("target", "owner", "start_line", "start_column"),
    "references": ("kind", "specifier", "binding", "scope", "start_line", "start_column", "end_line", "end_column"),
}


def _ddl(what: str) -> str:
    return ", ".join(f"{c} {'int' if c in _INTS else 'long' if c in _LONGS else 'string'}" for c in _COLUMNS[what])


def facts(files: DataFrame, what: str) -> DataFrame:
    """callables, types, modules or references of source files (path, content), one row each, with file, language and index.

    Files in other languages give none. A file with syntax errors gives what could be read; ``syntax_errors`` tells
    which those are.
    """
    cols = _COLUMNS[what]

    def run(batches):
        kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}
        for b in batches:
            out: dict[str, list] = {c: [] for c in ("file", "language", "index", *cols)}
            for path, content in zip(b.column(0).to_pylist(), b.column(1)):
                ext = extension(path)
                if ext is None or not content.is_valid:
                    continue
                for i, fact in enumerate(getattr(parse(content.as_py(), ext), what)):
                    for k, v in (("file", path), ("language", LANGUAGES[ext]), ("index", i), *((c, fact.get(c)) for c in cols)):
                        out[k].append(v)
            types = [kinds["string"], kinds["string"], kinds["int"], *(kinds["int" if c in _INTS else "long" if c in _LONGS else "string"] for c in cols)]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types)], names=list(out))

    return map_arrow(files.select("path", "content"), run, f"file string, language string, index int, {_ddl(what)}")


def parsed(files: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """All facts of source files from one parse: file, language, the kept columns, an array of structs for each kind of fact,
    and error, the first syntax error (code, line, column, message; null if there is none)."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}
    name = lambda c: "int" if c in _INTS else "long" if c in _LONGS else "string"
    types = {what: pa.list_(pa.struct([(c, kinds[name(c)]) for c in cols])) for what, cols in _COLUMNS.items()}
    wrong = pa.struct([("code", pa.string()), ("line", pa.int32()), ("column", pa.int32()), ("message", pa.string())])

    def run(batches):
        for b in batches:
            out: dict[str, list] = {c: [] for c in ("file", "language", *types)}
            rows, errors = [], []
            for i, (path, content) in enumerate(zip(b.column(0).to_pylist(), b.column(1))):
                ext = extension(path)
                if ext is None or not content.is_valid:
                    continue
                found = parse(content.as_py(), ext)
                rows.append(i)
                out["file"].append(path)
                out["language"].append(LANGUAGES[ext])
                errors.append(dict(zip(("code", "line", "column", "message"), found.errors[0])) if found.errors else None)
                for what, cols in _COLUMNS.items():
                    out[what].append([{c: f.get(c) for c in cols} for f in getattr(found, what)])
            kept = [b.column(2 + j).take(pa.array(rows, pa.int64())) for j in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*(pa.array(v, types.get(k, pa.string())) for k, v in out.items()), pa.array(errors, wrong), *kept], names=[*out, "error", *keep])

    ddl = ", ".join(f"{what} array<struct<{', '.join(f'{c}:{name(c).replace('long', 'bigint')}' for c in cols)}>>" for what, cols in _COLUMNS.items())
    src = files.select("path", "content", *keep)
    own = "".join(f", `{c}` {src.schema[c].dataType.simpleString()}" for c in keep)
    return map_arrow(src, run, f"file string, language string, {ddl}, error struct<code:string,line:int,column:int,message:string>{own}")


def newest(parsed_: DataFrame, key: str, version: list[str]) -> DataFrame:
    """The last version of each parsed file. Contents are parsed where they lie; only facts are shuffled."""
    rest = [c for c in parsed_.columns if c != key and c not in version]
    return parsed_.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*version)).alias("p")).select(key, "p.*")


def of_kind(parsed_: DataFrame, what: str) -> DataFrame:
    """The rows that ``facts`` gives, from parsed files."""
    return parsed_.select("file", "language", F.posexplode(what).alias("index", "f")).select("file", "language", "index", "f.*")


def syntax_errors(files: DataFrame) -> DataFrame:
    """The first error of each file that doesn't parse: path, code, line, column, message."""

    def run(batches):
        for b in batches:
            rows = []
            for path, content in zip(b.column(0).to_pylist(), b.column(1)):
                ext = extension(path)
                if ext is not None and content.is_valid and (errors := parse(content.as_py(), ext).errors):
                    rows.append((path, *errors[0]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string()))], names=["path", "code", "line", "column", "message"]
            )

    return map_arrow(files.select("path", "content"), run, "path string, code string, line int, column int, message string")


def first_syntax_error(files: DataFrame) -> DataFrame:
    """The error that fails a whole analysis: that of the first path."""
    return syntax_errors(files).agg(F.min(F.struct("path", "code", "line", "column", "message")).alias("e")).where("e is not null").select("e.*")


def syntax_gate(parsed_: DataFrame) -> DataFrame:
    """The same of files that are parsed already."""
    return parsed_.where("error is not null").agg(F.min(F.struct(F.col("file").alias("path"), "error.code", "error.line", "error.column", "error.message")).alias("e")).where("e is not null").select("e.*")


def with_ids(callables: DataFrame) -> DataFrame:
    """Adds stable_owner, occurrence and id: fingerprints of language, file, kind, owner, declaration and occurrence.

    occurrence numbers equal declarations of a file in document order, so ids survive edits of bodies and lines.
    """
    owner = F.when(F.instr("name", "<anonymous@") > 0, F.regexp_replace("name", r"[.:]*<anonymous@.*$", "")).otherwise(F.regexp_replace("name", r"(::|\.)[^.:]*$", ""))
    bare = F.regexp_replace("name", r"@\d+:\d+", "")
    key = ["file", "kind", "stable_owner", "_bare", "signature"]
    rows = callables.withColumn("stable_owner", owner).withColumn("_bare", bare)
    rows = rows.withColumn("occurrence", F.row_number().over(Window.partitionBy(*key).orderBy("start_byte", "end_byte", "index")) - 1)
    identity = F.concat_ws("\0", "_bare", "signature")
    return rows.withColumn("id", fingerprint(F.col("language"), F.col("file"), F.col("kind"), F.col("stable_owner"), identity, F.col("occurrence"))).drop("_bare")


def occurrence_ids(declarations: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Adds occurrence: the running index of equal declarations in document order."""
    return declarations.withColumn("occurrence", F.row_number().over(Window.partitionBy(*key).orderBy(*order)) - 1)


def distinct_in_order(*parts: list[str]) -> list[str]:
    """Texts such as limitations of several reports, each once, in the order they first appear."""
    return list(dict.fromkeys(x for p in parts for x in p))


def grammars(files: DataFrame, versions: dict[str, str]) -> DataFrame:
    """The languages that files are written in, with the version of their parser, in order."""
    lang = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])[F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))]
    version = F.create_map(*[F.lit(x) for kv in versions.items() for x in kv])[F.col("language")]
    return files.select(lang.alias("language")).where("language is not null").distinct().withColumn("version", version).orderBy("language", "version")
