"""From source files to the code graph: nodes, edges and resolved references."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.functions.expr import basename, fingerprint, go_module_name, rust_module_path
from riskframe.operators import facts, graph
from riskframe.runtime import Scratch

_NODE = ["id", "kind", "language", "name", "path", "declaration_kind", "location", "metrics", "module"]


def module_table(parsed: DataFrame, go_module: str = "") -> DataFrame:
    """The modules each file belongs to: module_id, file, language, system, name, variant.

    A Go file belongs to its folder's package, a TypeScript file is a module, a Rust file the module of its path, a C# file
    belongs to its namespaces, or to the global one.
    """
    m = facts.of_kind(parsed, "modules")
    path = F.col("file")
    folder = F.when(path.contains("/"), F.regexp_replace(path, r"/[^/]*$", "")).otherwise("")
    lang = F.col("language")
    rows = m.select(
        "file",
        "language",
        F.when(lang == "go", "go-package").when(lang == "typescript", "ecmascript-file").when(lang == "rust", "rust-module").otherwise("csharp-namespace").alias("system"),
        F.when(lang == "go", go_module_name(F.lit(go_module), folder)).when(lang == "typescript", path).when(lang == "rust", rust_module_path(path)).otherwise(F.col("name")).alias("name"),
        F.when(lang == "go", F.col("name")).otherwise("").alias("variant"),
    ).distinct()
    return rows.withColumn("module_id", graph.node_id("module", F.col("language"), F.col("system"), F.col("name"), F.col("variant")))


def build_graph(files: DataFrame, callables: DataFrame, go_module: str = "", parsed: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, references) of source files (path, content) and their scored callables (with ids and index); parsed holds
    the files' facts where they are parsed already."""
    scratch = Scratch(files.sparkSession, "build")
    parsed = scratch.cut(facts.parsed(files).drop("callables")) if parsed is None else parsed
    modules = scratch.cut(module_table(parsed, go_module))
    t = facts.of_kind(parsed, "types")
    t = facts.occurrence_ids(t, ["file", "kind", "name"], ["start_byte", "end_byte", "index"])
    t = scratch.cut(t.withColumn("id", fingerprint(F.lit("code-graph-type-v1"), F.col("language"), F.col("file"), F.col("kind"), F.lit(""), F.col("name"), F.col("occurrence"))))

    none = lambda kind: F.lit(None).cast(kind)
    place = "struct<start_line:int,start_column:int,end_line:int,end_column:int>"
    metrics = "struct<complexity:int,coverage_percent:double,risk:double,above_threshold:boolean>"
    identity = "struct<system:string,name:string,variant:string>"
    at = F.struct("start_line", "start_column", "end_line", "end_column").cast(place)
    path = F.col("path")
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    lang = F.create_map(*[F.lit(x) for kv in facts.LANGUAGES.items() for x in kv])[ext]
    file_nodes = files.select("path").distinct().select(
        graph.node_id("file", path).alias("id"), F.lit("file").alias("kind"), lang.alias("language"), basename(path).alias("name"), "path", none("string").alias("declaration_kind"), none(place).alias("location"), none(metrics).alias("metrics"), none(identity).alias("module")
    ).where("language is not null")
    type_nodes = t.select("id", F.lit("type").alias("kind"), "language", "name", F.col("file").alias("path"), F.col("kind").alias("declaration_kind"), at.alias("location"), none(metrics).alias("metrics"), none(identity).alias("module"))
    call_nodes = callables.select(
        "id", F.lit("callable").alias("kind"), "language", "name", F.col("file").alias("path"), F.col("kind").alias("declaration_kind"), at.alias("location"),
        F.struct("complexity", "coverage_percent", "risk", "above_threshold").cast(metrics).alias("metrics"), none(identity).alias("module"),
    )
    module_nodes = modules.groupBy(F.col("module_id").alias("id"), "language", "system", "name", "variant").agg(F.min("file").alias("path")).select(
        "id", F.lit("module").alias("kind"), "language", "name", "path", none("string").alias("declaration_kind"), none(place).alias("location"), none(metrics).alias("metrics"), F.struct("system", "name", "variant").cast(identity).alias("module")
    )
    nodes = file_nodes.unionByName(type_nodes).unionByName(call_nodes).unionByName(module_nodes).select(*_NODE)

    first = modules.groupBy("file").agg(F.min("module_id").alias("one"))
    named = modules.select("file", F.col("name").alias("scope"), "module_id")
    r = facts.of_kind(parsed, "references")
    kind = F.when(F.col("language") == "go", "go-import").otherwise(F.concat_ws("-", "language", "kind"))
    r = r.withColumn("scope", F.coalesce("scope", F.lit(""))).join(first, "file", "left").join(named, ["file", "scope"], "left")
    r = r.withColumn("source_module", F.coalesce("module_id", "one")).withColumn("kind", kind)
    same = ["file", "source_module", "kind", "specifier", "scope", "binding"]
    r = facts.occurrence_ids(r, same, ["start_line", "start_column", "index"])
    r = r.withColumn("id", fingerprint(F.lit("code-graph-reference-v1"), graph.node_id("file", F.col("file")), *[F.col(c) for c in same[1:]], F.col("occurrence")))
    refs = r.select("id", "kind", "language", F.col("file").alias("path"), "source_module", "specifier", "scope", "binding", F.lit("").alias("reason"))
    references = scratch.cut(graph.resolve_references(refs, modules.select("module_id", "name", "system", "variant").distinct()))

    contained = graph.containment(t.select("file", "index", "id", "parent_kind", "parent_index"), callables.select("file", "index", "id", "parent_kind", "parent_index"))
    plain = F.array().cast("array<string>")
    member = modules.select(graph.node_id("file", F.col("file")).alias("from_id"), F.col("module_id").alias("to_id")).distinct()
    member = member.select(graph.edge_id(F.lit("member-of"), F.col("from_id"), F.col("to_id")).alias("id"), F.lit("member-of").alias("type"), "from_id", "to_id")
    edges = contained.unionByName(member).withColumn("reference_ids", plain).withColumn("occurrences", F.lit(1).cast("long")).unionByName(graph.import_edges(references).withColumn("occurrences", F.col("occurrences").cast("long")))
    return nodes, edges, references
