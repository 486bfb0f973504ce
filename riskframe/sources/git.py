"""Git diffs as changed ranges. Git itself is run by the caller; its output is the input here."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.functions.expr import line_count
from riskframe.runtime import map_arrow

_HUNK = re.compile(r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", '"': '"', "\\": "\\", "a": "\a", "b": "\b", "f": "\f", "v": "\v"}


def unquoted(text: str) -> str:
    """A path as Git writes it in a header, with C escapes if it is quoted."""
    if not text.startswith('"'):
        return text.split("\t")[0]
    out, i = bytearray(), 1
    while i < len(text):
        c = text[i]
        if c == '"':
            return out.decode("utf-8", "surrogateescape")
        if c == "\\" and i + 1 < len(text):
            d = text[i + 1]
            if d in "01234567":
                out.append(int(text[i + 1 : i + 4], 8))
                i += 4
                continue
            out += _ESCAPES.get(d, d).encode()
            i += 2
            continue
        out += c.encode("utf-8", "surrogateescape")
        i += 1
    raise ValueError("quoted path without end")


def parse_diff(text: str) -> list[tuple[str, int, int]]:
    """(file, start, end) of each hunk's new side, of a diff without context lines.

    A hunk that only deletes anchors at max(start, 1); deleted files give none. The lines of a hunk are consumed by
    its counts, so an added text that looks like a header isn't one.
    """
    out, file, lines, i = [], None, text.split("\n"), 0
    while i < len(lines):
        line = lines[i]
        i += 1
        if line.startswith("+++ "):
            name = unquoted(line[4:].rstrip("\r"))
            file = None if name == "/dev/null" else name[2:] if name[:2] == "b/" else name
        elif line.startswith("@@"):
            m = _HUNK.match(line)
            if m is None:
                raise ValueError(f"malformed hunk header {line!r}")
            minus, start, plus = int(m[2] or 1), int(m[3]), int(m[4] or 1)
            if file is not None:
                out.append((file, max(start, 1), max(start, 1) if plus == 0 else start + plus - 1))
            while i < len(lines) and (minus > 0 or plus > 0):
                c = lines[i][:1]
                if c == "-":
                    minus -= 1
                elif c == "+":
                    plus -= 1
                elif c != "\\":
                    minus, plus = minus - 1, plus - 1
                i += 1
    return out


def diff_ranges(diffs: DataFrame) -> DataFrame:
    """file, start_line, end_line of all hunks of diff texts (one per row in column diff)."""

    def run(batches):
        for b in batches:
            rows = [r for t in b.column(0).to_pylist() if t for r in parse_diff(t)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int32(), pa.int32()))], names=["file", "start_line", "end_line"])

    return map_arrow(diffs.select("diff"), run, "file string, start_line int, end_line int")


def untracked_ranges(files: DataFrame) -> DataFrame:
    """Whole-file ranges of untracked files (path, text); empty files have none."""
    return files.select(F.col("path").alias("file"), F.lit(1).alias("start_line"), line_count(F.col("text")).cast("int").alias("end_line")).where("end_line >= 1")


def baseline_entries(tree: DataFrame) -> DataFrame:
    """Adds reason git-mode to tree entries (path, mode, oid) that aren't regular files."""
    return tree.withColumn("reason", F.when(~F.col("mode").isin("100644", "100755"), "git-mode"))
