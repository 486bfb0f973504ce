"""Call graph: functions, edges with capped call sites, unresolved calls and their summary, from call facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskframe.functions.expr import fingerprint, is_test_function
from riskframe.operators.facts import of_kind
from riskframe.operators.graph import one_row

SITES = 25
UNRESOLVED = 5000


def functions(declared: DataFrame, inventory: DataFrame) -> DataFrame:
    """Declared functions (path, line, column, name) with the id of the first inventory row at their place.

    inventory: id, file, start_line, start_column, changed, end_line. A declaration without one gets a fingerprint of its
    place.
    """
    first = inventory.groupBy(F.col("file").alias("path"), F.col("start_line").alias("line"), F.col("start_column").alias("column")).agg(F.min(F.struct("id", "changed")).alias("i"))
    return declared.join(first, ["path", "line", "column"], "left").select(
        F.coalesce("i.id", fingerprint(F.lit("call-graph-function-v1"), F.col("path"), F.col("line"), F.col("column"), F.col("name"))).alias("id"),
        F.col("i.id").isNotNull().alias("matched"),
        "path", "line", "column", "name",
        F.coalesce("i.changed", F.lit(False)).alias("changed"),
        is_test_function(F.col("path"), F.col("name")).alias("test"),
    )


def call_edges(facts: DataFrame, sites: int = SITES) -> DataFrame:
    """One edge per (kind, from, to): occurrences of all facts and the first distinct sites by walk order, sorted.

    facts: kind (static or dispatch), caller, callee, path, line, column, seq. Sites are first made distinct with their
    least seq; a rank filter lets Spark keep the first ones per edge before and after the shuffle, so an edge with
    millions of calls moves 25 sites per task.
    """
    ok = facts.where("callee is not null and kind in ('static', 'dispatch')")
    key = ["kind", "caller", "callee"]
    total = ok.groupBy(*key).agg(F.count("*").alias("occurrences"))
    distinct = ok.groupBy(*key, "path", "line", "column").agg(F.min("seq").alias("seq"))
    order = Window.partitionBy(*key).orderBy("seq", "path", "line", "column")
    kept = distinct.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= sites + 1)
    lists = kept.groupBy(*key).agg(F.array_sort(F.collect_list(F.when(F.col("rn") <= sites, F.struct("path", "line", "column")))).alias("call_sites"), (F.max("rn") > sites).alias("truncated"))
    return total.join(lists, key).select(
        fingerprint(F.lit("call-graph-edge-v1"), F.col("kind"), F.col("caller"), F.col("callee")).alias("id"),
        "kind", F.col("caller").alias("from_id"), F.col("callee").alias("to_id"), "occurrences", "call_sites", "truncated",
    )


def dispatch_facts(interface_calls: DataFrame, implements: DataFrame, methods: DataFrame) -> DataFrame:
    """Calls of interface methods as calls of every implementing type's method.

    interface_calls: caller, interface, method, path, line, column, seq; implements: interface, type; methods: type, method, id.
    """
    return interface_calls.join(implements, "interface").join(methods, ["type", "method"]).select(F.lit("dispatch").alias("kind"), "caller", F.col("id").alias("callee"), "path", "line", "column", "seq")


# Functions and types that Go declares itself.
GO_BUILTINS = ("append", "cap", "clear", "close", "complex", "copy", "delete", "imag", "len", "make", "max", "min", "new", "panic", "print", "println", "real", "recover")
GO_TYPES = (
    "any", "bool", "byte", "comparable", "complex64", "complex128", "error", "float32", "float64", "int", "int8", "int16", "int32", "int64", "rune", "string", "uint", "uint8", "uint16", "uint32",
    "uint64", "uintptr",
)


def go_call_facts(parsed: DataFrame, callables: DataFrame, go_module: str = "") -> DataFrame:
    """Call facts of Go sources: kind (static, dispatch or null), caller, callee, path, line, column, seq, reason.

    parsed: files with their facts; callables: the same files' callables with ids and index. Calls are resolved by names,
    without types: a plain name by the functions and types of its package, a name behind an import by those of the imported
    package if it lies in the module, any other dotted name as a method: a dispatch to every method of that name in the
    module. Reasons of calls without callee: outside-function-body, outside-module, builtin, conversion, function-value,
    not-in-inventory, no-in-module-implementations.
    """
    folder = lambda c: F.when(c.contains("/"), F.regexp_replace(c, r"/[^/]*$", "")).otherwise("")
    go = parsed.where("language = 'go'")
    owners = callables.where("language = 'go'").select("file", F.col("index").alias("owner"), F.col("id").alias("caller"))
    c = of_kind(go, "calls").join(owners, ["file", "owner"], "left").select(
        "file", "caller", "target", F.col("start_line").alias("line"), F.col("start_column").alias("column"), F.col("index").cast("long").alias("seq"), folder(F.col("file")).alias("folder"),
        F.when(F.instr("target", ".") > 0, F.substring_index("target", ".", 1)).alias("left"), F.substring_index("target", ".", -1).alias("name"),
    )
    # Import names of a file: the given one, or the last part of the path.
    i = of_kind(go, "references").where("kind = 'import'").select("file", "specifier", F.when(F.col("binding") == "default", F.substring_index("specifier", "/", -1)).otherwise(F.col("binding")).alias("left"))
    top = F.lit(go_module)
    inside = (top != "") & ((F.col("specifier") == top) | F.col("specifier").startswith(go_module + "/"))
    i = i.groupBy("file", "left").agg(F.min("specifier").alias("specifier")).withColumn("there", F.when(inside, F.expr(f"substring(specifier, {len(go_module) + 2})")))
    c = c.join(i, ["file", "left"], "left").withColumn("package", F.when(F.col("left").isNull(), F.col("folder")).otherwise(F.col("there")))
    declared = callables.where("language = 'go' and kind in ('function', 'method')").select("id", folder(F.col("file")).alias("package"), F.substring_index("name", ".", -1).alias("name"), "kind")
    functions_ = declared.where("kind = 'function'").groupBy("package", "name").agg(F.min("id").alias("callee"))
    types = of_kind(go, "types").select(folder(F.col("file")).alias("package"), F.substring_index("name", ".", -1).alias("name")).distinct().withColumn("is_type", F.lit(True))
    c = c.join(functions_, ["package", "name"], "left").join(types, ["package", "name"], "left")
    imported, plain = F.col("specifier").isNotNull(), F.col("left").isNull()
    method = ~imported & ~plain
    why = (
        F.when(F.col("target") == "", "function-value")
        .when(plain & F.col("callee").isNull() & F.col("name").isin(*GO_BUILTINS), "builtin")
        .when(F.coalesce("is_type", F.lit(False)) | (plain & F.col("callee").isNull() & F.col("name").isin(*GO_TYPES)), "conversion")
        .when(imported & F.col("there").isNull(), "outside-module")
        .when(imported & F.col("callee").isNull(), "not-in-inventory")
        .when(plain & F.col("callee").isNull(), "function-value")
        .when(~method & F.col("caller").isNull(), "outside-function-body")
    )
    c = c.withColumn("why", why)
    place = ["file", "line", "column", "seq"]
    direct = c.where(~method | F.col("why").isNotNull()).select(
        F.when(F.col("why").isNull(), "static").alias("kind"), "caller", F.when(F.col("why").isNull(), F.col("callee")).alias("callee"), F.col("file").alias("path"), *place[1:], F.col("why").alias("reason")
    )
    methods = declared.where("kind = 'method'").select("name", F.col("id").alias("target_id"))
    # Many methods may share a name; the calls of that name meet each of them, which is the result by definition.
    m = c.where(method & F.col("why").isNull()).join(methods, "name", "left")
    none = F.when(F.col("target_id").isNull(), "no-in-module-implementations").when(F.col("caller").isNull(), "outside-function-body")
    dispatched = m.select(F.when(none.isNull(), "dispatch").alias("kind"), "caller", F.when(none.isNull(), F.col("target_id")).alias("callee"), F.col("file").alias("path"), *place[1:], none.alias("reason"))
    return direct.unionByName(dispatched)


def unresolved_calls(facts: DataFrame, limit: int = UNRESOLVED) -> tuple[DataFrame, DataFrame]:
    """(the first distinct unresolved calls in order, one row with total and truncated)."""
    d = facts.where("callee is null or reason is not null").select("caller", "path", "line", "column", "reason").distinct()
    page = d.orderBy("path", "line", "column", "caller", "reason").limit(limit)
    return page, d.agg(F.count("*").alias("total"), (F.count("*") > limit).alias("truncated"))


def call_summary(functions_: DataFrame, edges: DataFrame, tests: DataFrame) -> DataFrame:
    """Counts of functions, edges by kind, occurrences, tests, changed functions, and unmatched ones; one row."""
    f = functions_.agg(F.count("*").alias("functions"), F.count_if("test").alias("tests"), F.count_if("changed").alias("changed_functions"), F.count_if(~F.col("matched")).alias("unmatched_functions"))
    e = edges.agg(F.count_if(F.col("kind") == "static").alias("static_edges"), F.count_if(F.col("kind") == "dispatch").alias("dispatch_edges"), F.coalesce(F.sum("occurrences"), F.lit(0)).alias("call_sites"))
    return one_row(f, e, tests.agg(F.count("*").alias("affected_tests")))
