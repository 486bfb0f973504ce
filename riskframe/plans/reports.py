"""Reports as JSON, SARIF and text, and files that are replaced as a whole."""

from __future__ import annotations

import json
import os
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.functions.expr import uri_escaped

SARIF_RESULTS = 25_000
ROWS = 250_000  # rows of one part of a report; more are an error
LIMITATIONS = {
    "scope": ["Lines that only changed place in their file aren't told apart from new ones.", "Callables are found by syntax; generated and ignored sources aren't read."],
    "comparison": ["Callables that equal each other in declaration can't be told apart and form ambiguous groups.", "Coverage is compared only between reports of one format."],
    "graph": ["Imports are resolved among the selected sources only, by names and paths.", "Build tags, path mappings and conditional exports aren't evaluated."],
    "architecture": ["Rules and cycles hold for the resolved imports only."],
    "calls": ["Calls through reflection, function values and unknown packages stay unresolved.", "A test that reaches a change may still not exercise it."],
}


def config_fingerprint(config: dict) -> str:
    """SHA-256 of a configuration's JSON in its own order of fields, with <, > and & escaped."""
    import hashlib

    text = json.dumps(config, separators=(",", ":"), ensure_ascii=False)
    for c in "<>&":
        text = text.replace(c, f"\\u{ord(c):04x}")
    return hashlib.sha256(text.encode()).hexdigest()


def json_report(header: dict, **parts: DataFrame) -> str:
    """One JSON report: the header's fields and each part as a list of rows. Parts are pages or bounded before."""
    doc = dict(header)
    for name, df in parts.items():
        doc[name] = [json.loads(r[0]) for r in df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).toLocalIterator()]
    return json.dumps(doc, indent=2, ensure_ascii=False) + "\n"


def sarif_results(rows: DataFrame, rule: str, level: str) -> DataFrame:
    """SARIF results of rows with id, file, start_line, start_column (UTF-16), message: one struct per row, in order."""
    place = F.struct(
        F.struct(F.struct(uri_escaped(F.col("file")).alias("uri")).alias("artifactLocation"), F.struct(F.col("start_line").alias("startLine"), F.col("start_column").alias("startColumn")).alias("region")).alias("physicalLocation")
    )
    return rows.orderBy("file", "start_line", "start_column", "id").select(
        F.lit(rule).alias("ruleId"), F.lit(level).alias("level"), F.struct(F.col("message").alias("text")).alias("message"), F.array(place).alias("locations"), F.create_map(F.lit("riskframe/v1"), F.col("id")).alias("partialFingerprints")
    )


MUTATION_RULES = [{"id": "MUT001", "name": "survived"}, {"id": "MUT002", "name": "noCoverage"}]


def mutation_sarif(mutants: DataFrame) -> DataFrame:
    """SARIF results of survived (MUT001) and uncovered (MUT002) mutants, in order; a mutant without end is a point."""
    rows = mutants.where("status in ('survived', 'noCoverage')").orderBy("file", "start_line", "start_column", "id")
    region = F.struct(F.col("start_line").alias("startLine"), F.col("start_column").alias("startColumn"), F.col("end_line").alias("endLine"), F.col("end_column").alias("endColumn"))
    place = F.struct(F.struct(F.struct(uri_escaped(F.col("file")).alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    survived = F.col("status") == "survived"
    return rows.select(
        F.when(survived, "MUT001").otherwise("MUT002").alias("ruleId"),
        F.lit("warning").alias("level"),
        F.struct(F.concat(F.when(survived, "no test fails for mutant ").otherwise("no test covers mutant "), "mutator").alias("text")).alias("message"),
        F.array(place).alias("locations"),
        F.create_map(F.lit("riskframe/v1"), F.col("id")).alias("partialFingerprints"),
    )


def sarif_log(results: DataFrame, rules: list[dict], tool: str = "riskframe") -> str:
    rows = results.limit(SARIF_RESULTS + 1).toJSON().collect()
    if len(rows) > SARIF_RESULTS:
        raise ValueError(f"more than {SARIF_RESULTS} results")
    run = {"tool": {"driver": {"name": tool, "rules": rules}}, "columnKind": "utf16CodeUnits", "results": [json.loads(r) for r in rows]}
    return json.dumps({"version": "2.1.0", "$schema": "https://json.schemastore.org/sarif-2.1.0.json", "runs": [run]}, indent=2) + "\n"


def callable_text(rows: DataFrame) -> DataFrame:
    """One line of text per callable, riskiest first: risk, complexity, coverage, place and name."""
    cov = F.when(F.col("coverage_percent").isNull(), "   n/a").otherwise(F.format_string("%6.2f", "coverage_percent"))
    return rows.orderBy(F.desc("risk"), "file", "start_line").select(F.format_string("%8.2f %4d %s %s:%d %s", "risk", "complexity", cov, "file", "start_line", "name").alias("line"))


def write_text(path: str, text: str) -> None:
    """Replaces a file as a whole; a symbolic link isn't followed."""
    if os.path.islink(path):
        raise ValueError(f"{path} is a symbolic link")
    folder = os.path.dirname(os.path.abspath(path))
    handle, tmp = tempfile.mkstemp(dir=folder)
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        os.replace(tmp, path)
    except BaseException:
        os.unlink(tmp)
        raise


def inside(root: str, path: str) -> str:
    """The real path of something below a root; an escape, also by links, is an error."""
    real, top = os.path.realpath(os.path.join(root, path)), os.path.realpath(root)
    if real != top and not real.startswith(top + os.sep):
        raise ValueError(f"{path} is outside {root}")
    return real
