"""Column expressions: scores, rounding, stable identifiers, paths, globs and text measures. All stay in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# States of mutants by the words of the two report formats.
STRYKER_STATUS = {
    "Killed": "killed", "Survived": "survived", "NoCoverage": "noCoverage", "Timeout": "timedOut", "CompileError": "compileError",
    "RuntimeError": "runtimeError", "Ignored": "ignored",
}
GREMLINS_STATUS = {"KILLED": "killed", "LIVED": "survived", "NOT COVERED": "noCoverage", "TIMED OUT": "timedOut", "NOT VIABLE": "compileError", "SKIPPED": "ignored"}
# Endings of generated files' names.
GENERATED = (".d.ts", ".g.cs", ".g.i.cs", ".generated.cs", ".designer.cs", ".assemblyinfo.cs", ".assemblyattributes.cs", ".generated.ts", ".generated.tsx", ".gen.ts", ".gen.tsx")
ACTIONABLE = ("noCoverage", "survived")
#: Weights of the change-risk score's terms are those of its definition, complexity^2 * (1 - coverage)^3 + complexity.


def round2(c: Column) -> Column:
    """Two decimals, half away from zero on the binary product (not Spark's decimal rounding of the shortest form)."""
    scaled = c * F.lit(100.0)
    return F.signum(scaled) * F.floor(F.abs(scaled) + F.lit(0.5)) / F.lit(100.0)


def risk_score(complexity: Column, coverage: Column) -> Column:
    """Change-risk score; coverage in percent, clamped to 0..100, unknown counts as 0."""
    cov = F.least(F.greatest(F.coalesce(coverage, F.lit(0.0)), F.lit(0.0)), F.lit(100.0))
    c = complexity.cast("double")
    miss = F.lit(1.0) - cov / F.lit(100.0)
    return round2(c * c * miss * miss * miss + c)


def above_threshold(risk: Column, threshold: float) -> Column:
    return risk > F.lit(float(threshold))


def fingerprint(*fields: Column) -> Column:
    """SHA-256 over the fields, each led by its UTF-8 length as 8 bytes; null counts as ''."""
    parts = []
    for f in fields:
        b = F.encode(F.coalesce(f.cast("string"), F.lit("")), "UTF-8")
        parts += [F.unhex(F.lpad(F.hex(F.octet_length(b).cast("long")), 16, "0")), b]
    return F.sha2(F.concat(*parts), 256)


def nullable_delta(now: Column, before: Column) -> Column:
    return round2(now - before)


def normal_path(p: Column) -> Column:
    """Forward slashes, no '.' parts, '..' folded where possible and gone at a root, no './' in front; '.' if nothing is left."""
    plain = F.regexp_replace(F.trim(p), r"\\", "/")
    rooted = plain.startswith("/")
    parts = F.filter(F.split(plain, "/"), lambda x: (x != "") & (x != "."))
    empty = F.array().cast("array<string>")
    folded = F.aggregate(
        parts,
        empty,
        lambda acc, x: F.when((x == "..") & (F.size(acc) > 0) & (F.element_at(acc, -1) != ".."), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .when((x == "..") & rooted, acc)
        .otherwise(F.concat(acc, F.array(x))),
    )
    text = F.array_join(folded, "/")
    return F.when(rooted, F.concat(F.lit("/"), text)).when(text == "", ".").otherwise(text)


def is_absolute(p: Column) -> Column:
    return p.rlike(r"^(/|\\|[A-Za-z]:)")


def valid_report_path(p: Column) -> Column:
    """Relative, without drive and without '..' parts."""
    return p.isNotNull() & (p != "") & ~is_absolute(p) & ~F.array_contains(F.split(F.regexp_replace(p, r"\\", "/"), "/"), "..")


def basename(p: Column) -> Column:
    return F.substring_index(p, "/", -1)


def path_match_rank(source: Column, identity: Column) -> Column:
    """3 equal, 2 one is a suffix of the other by whole parts, 1 equal or suffix without regard to case, else 0."""
    suffix = lambda a, b: a.endswith(F.concat(F.lit("/"), b)) | b.endswith(F.concat(F.lit("/"), a))
    a, b = F.lower(source), F.lower(identity)
    return F.when(source == identity, 3).when(suffix(source, identity), 2).when((a == b) | suffix(a, b), 1).otherwise(0)


def glob_regex(glob: str) -> str:
    """Anchored regular expression of a glob: ** any text, * any text but '/', ? at most one such character; '' all."""
    if not glob:
        return "^.*$"
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**", i):
            out.append(".*")
            i += 2
        else:
            out.append("[^/]*" if c == "*" else "[^/]?" if c == "?" else re.escape(c))
            i += 1
    return "^" + "".join(out) + "$"


def collapsed(c: Column) -> Column:
    """White space runs as one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def utf16_length(c: Column) -> Column:
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("int")


def utf16_column(line: Column, byte_column: Column) -> Column:
    """1-based UTF-16 column of a 1-based UTF-8 byte column in a line."""
    head = F.decode(F.substring(F.encode(line, "UTF-8"), F.lit(1), byte_column - 1), "UTF-8")
    return utf16_length(head) + 1


def line_count(c: Column) -> Column:
    """Lines of a text; a last line without line end counts, an empty text has none."""
    breaks = F.char_length(c) - F.char_length(F.replace(c, F.lit("\n"), F.lit("")))
    return breaks + F.when((c != "") & ~c.endswith("\n"), 1).otherwise(0)


def is_test_file(p: Column) -> Column:
    low = F.lower(p)
    return low.rlike(r"_test\.go$") | low.rlike(r"(^|/)(tests|benches)/.*\.rs$") | low.rlike(r"\.(spec|test)\.tsx?$")


def is_generated_file(p: Column) -> Column:
    name = F.lower(basename(p))
    return name.rlike("(" + "|".join(map(re.escape, GENERATED)) + ")$") | name.startswith("temporarygeneratedfile_")


def is_supported_source(p: Column) -> Column:
    return F.lower(p).rlike(r"\.(cs|go|rs|ts|tsx)$")


def is_test_function(file: Column, name: Column) -> Column:
    return F.lower(file).endswith("_test.go") & F.substring_index(name, ".", -1).startswith("Test")


def rust_module_path(file: Column) -> Column:
    """Module path of a Rust file: crate, then its folders without a leading src and without mod, lib and main."""
    inner = F.regexp_replace(F.regexp_replace(normal_path(file), r"\.[^./]*$", ""), r"^src(/|$)", "")
    inner = F.regexp_replace(inner, r"(^|/)(mod|lib|main)$", "")
    return F.when(inner == "", "crate").otherwise(F.concat(F.lit("crate::"), F.regexp_replace(inner, "/", "::")))


def go_module_name(module: Column, folder: Column) -> Column:
    """Import path of a folder in a Go module; './folder' or '.' without a module."""
    inside = (folder != "") & (folder != ".")
    return F.when(module.isNotNull() & (module != ""), F.when(inside, F.concat(module, F.lit("/"), folder)).otherwise(module)).otherwise(F.when(inside, F.concat(F.lit("./"), folder)).otherwise("."))


def csharp_qualified(scope: Column, name: Column) -> Column:
    return F.when((scope.isNull()) | (scope == ""), name).otherwise(F.concat(scope, F.lit("."), name))


def mapped(values: dict[str, str], c: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[c]


def uri_escaped(p: Column) -> Column:
    """A relative path as URI: every part percent-encoded, slashes kept."""
    return F.array_join(F.transform(F.split(p, "/"), lambda x: F.regexp_replace(F.url_encode(x), r"\+", "%20")), "/")


def is_percentage(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & c.between(0.0, 100.0)
