"""Source discovery as column logic: pruning, ignore rules, defaults, and accounting of what was left out."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.functions.expr import is_generated_file, is_supported_source, is_test_file

# Folders that discovery prunes anywhere, and those it prunes at the root only.
PRUNED = (".git", "node_modules", ".next", "bin", "obj", "testdata")
PRUNED_AT_ROOT = ("vendor", "dist", "build", "coverage", "target")
EXAMPLES = 5


@dataclass(frozen=True)
class IgnoreRule:
    """One line of an ignore file that stands in a folder ('' for the root)."""

    pattern: str
    folder: str = ""

    @property
    def negated(self) -> bool:
        return self.pattern.startswith("!")

    def regex(self) -> str:
        """A regular expression over root-relative paths of files that the line matches, itself or a folder above."""
        p = self.pattern[1:] if self.negated else self.pattern
        p = p.rstrip()
        only_dir = p.endswith("/")
        p = p.rstrip("/")
        anchored = "/" in p
        p = p.lstrip("/")
        out, i = [], 0
        while i < len(p):
            if p.startswith("**/", i):
                out.append("(?:.*/)?")
                i += 3
            elif p.startswith("/**", i) and i + 3 == len(p):
                out.append("/.*")
                i += 3
            elif p.startswith("**", i):
                out.append(".*")
                i += 2
            elif p[i] == "[" and "]" in p[i + 1 :]:
                j = p.index("]", i + 1)
                body = p[i + 1 : j]
                out.append("[" + ("^" + body[1:] if body[:1] == "!" else body) + "]")
                i = j + 1
            elif p[i] == "\\" and i + 1 < len(p):
                out.append(re.escape(p[i + 1]))
                i += 2
            else:
                out.append("[^/]*" if p[i] == "*" else "[^/]" if p[i] == "?" else re.escape(p[i]))
                i += 1
        start = "^" + re.escape(self.folder + "/" if self.folder else "") + ("" if anchored else "(?:.*/)?")
        return start + "".join(out) + ("/.*$" if only_dir else "(?:/.*)?$")


def ignore_rules(text: str, folder: str = "") -> list[IgnoreRule]:
    return [IgnoreRule(line, folder) for line in text.splitlines() if line.strip() and not line.startswith("#")]


def ignored(path: Column, rules: list[IgnoreRule]) -> Column:
    """Whether the last matching rule of a list excludes a path. Rules come from a few ignore files."""
    out = F.lit(False)
    for r in rules:
        out = F.when(path.rlike(r.regex()), F.lit(not r.negated)).otherwise(out)
    return out


def pruned(path: Column) -> Column:
    folders = F.slice(F.split(F.lower(path), "/"), 1, F.size(F.split(path, "/")) - 1)
    return F.exists(folders, lambda x: x.isin(*PRUNED)) | F.coalesce(F.try_element_at(folders, F.lit(1)).isin(*PRUNED_AT_ROOT), F.lit(False))


def discover(files: DataFrame, *, excludes: list[str] = (), tool_ignore: str = "", gitignores: dict[str, str] | None = None, include_tests: bool = False, include_generated: bool = False) -> DataFrame:
    """Adds reason: why a file is left out (null if it is selected).

    files: path (root-relative), explicit. An explicit file passes everything but --exclude; else, in this order:
    excluded, built-in-directory, tool-ignore, gitignore, test, generated. Other extensions have reason unsupported.
    """
    if any(e.startswith("!") for e in excludes):
        raise ValueError("an exclude can't be negated")
    path, chosen = F.col("path"), F.coalesce("explicit", F.lit(False))
    rules = [r for folder, text in sorted((gitignores or {}).items(), key=lambda kv: (kv[0].count("/") + bool(kv[0]), kv[0])) for r in ignore_rules(text, folder)]
    reason = (
        F.when(~is_supported_source(path), "unsupported")
        .when(ignored(path, [IgnoreRule(e) for e in excludes]), "explicit-exclude")
        .when(chosen, F.lit(None))
        .when(pruned(path), "built-in-directory")
        .when(ignored(path, ignore_rules(tool_ignore)), "tool-ignore")
        .when(ignored(path, rules), "gitignore")
        .when(F.lit(not include_tests) & is_test_file(path), "test")
        .when(F.lit(not include_generated) & is_generated_file(path), "generated")
    )
    return files.groupBy("path").agg(F.max(chosen).alias("explicit")).withColumn("reason", reason)


def exclusions(discovered: DataFrame) -> DataFrame:
    """Per reason the number of distinct paths and the first five."""
    one = discovered.where("reason is not null").select("reason", "path").distinct()
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("reason").orderBy("path"))
    first = one.withColumn("rn", rank).where(F.col("rn") <= EXAMPLES).groupBy("reason").agg(F.array_sort(F.collect_list("path")).alias("examples"))
    return one.groupBy("reason").agg(F.count("*").alias("count")).join(first, "reason")


def selected(path: Column, selectors: list[str]) -> Column:
    """Whether a path is one of the selectors or lies below one ('' or '.' selects all)."""
    out = F.lit(False)
    for s in selectors:
        s = s.rstrip("/")
        out = F.lit(True) if s in ("", ".") else out | (path == s) | path.startswith(s + "/")
    return out
