"""Code graph: module rollups, import resolution, validation, neighborhoods, cycles, rules and reverse reachability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.functions.expr import fingerprint, glob_regex, normal_path, round2, rust_module_path
from riskframe.operators.hierarchy import declared_tree
from riskframe.runtime import Scratch

NEIGHBORHOOD_EDGE_TYPES = ("contains", "declares", "member-of", "imports")


def node_id(kind: str, *fields: Column) -> Column:
    return fingerprint(F.lit(f"code-graph-{kind}-v1"), *fields)


def edge_id(type_: Column, from_: Column, to: Column) -> Column:
    return fingerprint(F.lit("code-graph-edge-v1"), type_, from_, to)


def containment(types: DataFrame, callables: DataFrame) -> DataFrame:
    """contains and declares edges of a forest of files, types and callables.

    types: file, index, id, parent_kind, parent_index; callables the same. A parent is the file, a type or a callable of
    the same file by index; a type declares its callables, every other parent contains.
    """
    t = types.select("file", F.lit("type").alias("kind"), "index", "id", "parent_kind", "parent_index")
    c = callables.select("file", F.lit("callable").alias("kind"), "index", "id", "parent_kind", "parent_index")
    rows = t.unionByName(c)
    parents = rows.select("file", F.col("kind").alias("parent_kind"), F.col("index").alias("parent_index"), F.col("id").alias("pid"))
    linked = rows.join(parents, ["file", "parent_kind", "parent_index"], "left").withColumn(
        "from_id", F.when(F.col("parent_kind") == "file", node_id("file", F.col("file"))).otherwise(F.col("pid"))
    )
    kind = F.when((F.col("parent_kind") == "type") & (F.col("kind") == "callable"), "declares").otherwise("contains")
    return linked.select(edge_id(kind, F.col("from_id"), F.col("id")).alias("id"), kind.alias("type"), "from_id", F.col("id").alias("to_id"))


def graph_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n = nodes.agg(*[F.count_if(F.col("kind") == k).alias(f"{k}s") for k in ("file", "module", "type", "callable")])
    e = edges.agg(*[F.count_if(F.col("type") == k).alias(k.replace("-", "_")) for k in ("contains", "declares", "member-of", "imports")], F.sum("occurrences").alias("occurrences"))
    return one_row(n, e)


def one_row(*parts: DataFrame) -> DataFrame:
    """Aggregates of one row each as one row, side by side."""
    out = parts[0].withColumn("_row", F.lit(1))
    for p in parts[1:]:
        out = out.join(p.withColumn("_row", F.lit(1)), "_row")
    return out.drop("_row")


def enum_faults(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows outside the vocabulary: unknown kinds and types, illegal containment, imports that aren't resolved as such."""
    kinds = nodes.where(~F.col("kind").isin("file", "module", "type", "callable") | F.col("kind").isNull()).select(F.lit("node-kind").alias("fault"), "id")
    types = edges.where(~F.col("type").isin(*NEIGHBORHOOD_EDGE_TYPES) | F.col("type").isNull()).select(F.lit("edge-type").alias("fault"), "id")
    k = nodes.groupBy("id").agg(F.min("kind").alias("kind"))
    ends = edges.join(k.select(F.col("id").alias("from_id"), F.col("kind").alias("fk")), "from_id").join(k.select(F.col("id").alias("to_id"), F.col("kind").alias("tk")), "to_id")
    legal = (
        ((F.col("type") == "declares") & (F.col("fk") == "type") & (F.col("tk") == "callable"))
        | ((F.col("type") == "contains") & F.col("fk").isin("file", "type", "callable") & F.col("tk").isin("type", "callable") & ~((F.col("fk") == "type") & (F.col("tk") == "callable")))
        | ((F.col("type") == "member-of") & (F.col("fk") == "file") & (F.col("tk") == "module"))
        | ((F.col("type") == "imports") & (F.col("fk") == "module") & (F.col("tk") == "module"))
    )
    return kinds.unionByName(types).unionByName(ends.where(F.col("type").isin(*NEIGHBORHOOD_EDGE_TYPES) & ~legal).select(F.lit("edge-ends").alias("fault"), "id").distinct())


def evidence_faults(edges: DataFrame, references: DataFrame) -> DataFrame:
    """Resolved references that don't back exactly one imports edge between their own modules: id, edges."""
    used = edges.where("type = 'imports'").select(F.explode("reference_ids").alias("id"), F.col("from_id").alias("f"), F.col("to_id").alias("t"))
    r = references.where("resolution = 'resolved' and not (source_module <=> target)").select("id", "source_module", "target")
    hit = r.join(used, "id", "left").groupBy("id").agg(F.count_if((F.col("f") == F.col("source_module")) & (F.col("t") == F.col("target"))).alias("edges"), F.count("f").alias("uses"))
    return hit.where("edges <> 1 or uses <> 1").select("id", "edges")


def supporting_references(references: DataFrame, edges: DataFrame) -> DataFrame:
    """The references that back the given edges."""
    return references.join(edges.select(F.explode("reference_ids").alias("id")).distinct(), "id", "left_semi")


def deep_nodes(edges: DataFrame, most: int = 64) -> DataFrame:
    """Nodes of the containment forest on or below a cycle, or deeper than allowed: node_id, depth (-1 for a cycle)."""
    return declared_tree(edges, paths=False).where((F.col("depth") > most) | F.col("cyclic")).select("node_id", "depth")

def forest_faults(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Violations of the containment forest: fault, id.

    duplicate-node, missing-end (of any edge), self-edge, several-parents, file-with-parent; cycles and depth come from
    ``hierarchy``.
    """
    ids = nodes.groupBy("id").agg(F.count("*").alias("n"), F.min("kind").alias("kind"))
    inside = edges.where("type in ('contains', 'declares')")
    known = ids.select("id")
    ends = edges.select(F.col("id").alias("edge"), F.explode(F.array("from_id", "to_id")).alias("id"))
    dup = ids.where("n > 1").select(F.lit("duplicate-node").alias("fault"), "id")
    lost = ends.join(known, "id", "left_anti").select(F.lit("missing-end").alias("fault"), F.col("edge").alias("id")).distinct()
    own = inside.where("from_id = to_id").select(F.lit("self-edge").alias("fault"), "id").distinct()
    many = inside.groupBy("to_id").agg(F.min("from_id").alias("a"), F.max("from_id").alias("b")).where("a <> b").select(F.lit("several-parents").alias("fault"), F.col("to_id").alias("id"))
    file_child = inside.join(ids.where("kind = 'file'").select(F.col("id").alias("to_id")), "to_id", "left_semi").select(F.lit("file-with-parent").alias("fault"), F.col("to_id").alias("id")).distinct()
    return dup.unionByName(lost).unionByName(own).unionByName(many).unionByName(file_child)


def module_rollup(members: DataFrame, items: DataFrame) -> DataFrame:
    """Metrics of each module from its files' items; a file in several modules counts in each, empty modules give 0.

    members: module_id, file (null for a module without files); items: file, kind (type or callable), complexity,
    coverage_percent, risk, above_threshold. Items are first summed per file, so that a file in k modules is
    multiplied as one row.
    """
    call = F.col("kind") == "callable"
    per_file = items.groupBy("file").agg(
        F.count_if(F.col("kind") == "type").alias("types"),
        F.count_if(call).alias("callables"),
        F.sum(F.when(call, F.col("complexity"))).alias("sum_complexity"),
        F.max(F.when(call, F.col("complexity"))).alias("max_complexity"),
        F.count_if(call & F.col("coverage_percent").isNotNull()).alias("known"),
        F.sum(F.when(call, F.col("coverage_percent").cast("decimal(20,6)"))).alias("sum_coverage"),  # exact, in any order of rows
        F.max(F.when(call, F.col("risk"))).alias("max_risk"),
        F.count_if(call & F.coalesce("above_threshold", F.lit(False))).alias("above"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    return (
        members.select("module_id", "file").distinct().join(per_file, "file", "left").groupBy("module_id").agg(
            F.count("file").alias("files"),
            zero(F.sum("types")).alias("types"),
            zero(F.sum("callables")).alias("callables"),
            zero(F.sum("sum_complexity")).alias("total_complexity"),
            zero(F.max("max_complexity")).alias("maximum_complexity"),
            zero(F.sum("known")).alias("known_coverage"),
            (zero(F.sum("callables")) - zero(F.sum("known"))).alias("unknown_coverage"),
            round2(F.sum("sum_coverage").cast("double") / F.when(F.sum("known") > 0, F.sum("known"))).alias("average_coverage"),
            F.coalesce(F.max("max_risk"), F.lit(0.0)).alias("maximum_risk"),
            zero(F.sum("above")).alias("above_threshold"),
        )
    )


def import_edges(references: DataFrame) -> DataFrame:
    """Resolved references between two modules as one imports edge: sorted reference ids and their number."""
    ok = references.where("resolution = 'resolved' and source_module is not null and target is not null")
    return ok.groupBy(F.col("source_module").alias("from_id"), F.col("target").alias("to_id")).agg(
        F.array_sort(F.collect_list("id")).alias("reference_ids"), F.greatest(F.count("*"), F.lit(1)).alias("occurrences")
    ).select(edge_id(F.lit("imports"), F.col("from_id"), F.col("to_id")).alias("id"), F.lit("imports").alias("type"), "from_id", "to_id", "reference_ids", "occurrences")


def with_candidate_names(references: DataFrame) -> DataFrame:
    """Adds _names (module names in order of preference, null if there are none) and _why (the reason for none).

    Each step is a column of its own, so that long expressions are evaluated once and not wherever they are used.
    """
    kind, specifier, scope, path = F.col("kind"), F.col("specifier"), F.coalesce("scope", F.lit("")), F.col("path")
    folder = F.when(path.contains("/"), F.regexp_replace(path, r"/[^/]*$", "")).otherwise(F.lit(""))
    is_ts, is_rust, is_cs, is_go = kind.startswith("typescript-"), kind.startswith("rust-"), kind.startswith("csharp-"), kind == "go-import"
    parts = F.split(specifier, "::")
    df = references.withColumn("_joined", F.when(is_ts, normal_path(F.when(folder == "", specifier).otherwise(F.concat(folder, F.lit("/"), specifier)))))
    df = df.withColumn("_here", F.when(is_rust, F.split(rust_module_path(path), "::"))).withColumn("_supers", F.size(F.split(F.regexp_extract(specifier, r"^((?:super::)*(?:super$)?)", 1), "super")) - 1)

    joined, ext = F.col("_joined"), F.lower(F.regexp_extract("_joined", r"(\.[^./]*)$", 1))
    suffixes = lambda base, ends: F.array(*[F.concat(base, F.lit(e)) for e in ends])
    ts = (
        F.when(ext.isin(".ts", ".tsx"), F.array(joined))
        .when(ext.isin(".js", ".jsx"), suffixes(F.regexp_replace(joined, r"\.[^./]*$", ""), (".ts", ".tsx", ".d.ts")))
        .when(ext == "", suffixes(joined, (".ts", ".tsx", ".d.ts", "/index.ts", "/index.tsx", "/index.d.ts")))
    )
    here, up = F.col("_here"), F.size("_here") - F.col("_supers")
    absolute = (
        F.when((kind == "rust-mod") | (parts[0] == "crate"), parts)
        .when(parts[0] == "self", F.concat(here, F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))))
        .when((parts[0] == "super") & (up >= 1), F.concat(F.slice(here, 1, F.greatest(up, F.lit(0))), F.slice(parts, F.col("_supers") + 1, F.greatest(F.size(parts) - F.col("_supers"), F.lit(0)))))
    )
    df = df.withColumn("_ts", F.when(is_ts, ts)).withColumn("_rust", F.when(is_rust, absolute))

    relative = specifier.startswith("./") | specifier.startswith("../")
    ts_why = F.when(~relative, "non-relative-specifier").when(joined.startswith("../") | (joined == ".."), "path-escapes-root").when(F.col("_ts").isNull(), "unsupported-extension")
    rust_why = F.when((parts[0] == "super") & (up < 1) & (kind != "rust-mod"), "path-escapes-crate-root").when(F.col("_rust").isNull(), "non-crate-specifier")
    why = F.when(is_go & (specifier == "C"), "cgo-pseudo-package").when(is_ts, ts_why).when(is_rust, rust_why).when(~(is_go | is_cs), "unsupported-reference-kind")
    df = df.withColumn("_why", F.coalesce(F.when(F.coalesce("reason", F.lit("")) != "", F.col("reason")), why))

    prefixes = F.transform(F.sequence(F.size("_rust"), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice("_rust", 1, n), "::"))
    bare, scopes = F.regexp_replace(specifier, "^global::", ""), F.split(scope, r"\.")
    scoped = (scope != "") & (scope != "global::") & ~specifier.startswith("global::")
    # Outermost scope first, the plain name last.
    around = F.transform(F.sequence(F.lit(1), F.size(scopes)), lambda n: F.concat(F.array_join(F.slice(scopes, 1, n), "."), F.lit("."), bare))
    names = F.when(is_go, F.array(specifier)).when(is_ts, F.col("_ts")).when(is_rust, prefixes).when(is_cs, F.when(scoped, F.concat(around, F.array(bare))).otherwise(F.array(bare)))
    return df.withColumn("_names", F.when(F.col("_why").isNull(), names)).drop("_joined", "_here", "_supers", "_ts", "_rust")


def resolve_references(references: DataFrame, modules: DataFrame) -> DataFrame:
    """Adds resolution (resolved, ambiguous, unresolved), target, candidates and reason to references.

    references: id, kind, specifier, scope, source_module, path, reason (null or '' unless the source itself rules it out);
    modules: module_id, name, system, variant. Candidate names are exploded and meet modules on the name; Rust takes
    the longest name that exists, C# the first, the others all.
    """
    scratch = Scratch(references.sparkSession, "references")
    r = scratch.cut(with_candidate_names(references))
    tries = r.select("id", "kind", "source_module", F.posexplode("_names").alias("pos", "name"))
    m = modules.select("name", "module_id", "system", F.coalesce("variant", F.lit("")).alias("variant"))
    hits = tries.join(m, "name").where("kind <> 'go-import' or (system = 'go-package' and not variant like '%\\_test')")
    first_only = F.col("kind").startswith("rust-") | F.col("kind").startswith("csharp-")
    best = hits.groupBy("id").agg(F.min("pos").alias("first"))
    kept = hits.join(best, "id").where(~first_only | (F.col("pos") == F.col("first")))
    found = kept.where("not (module_id <=> source_module)").groupBy("id").agg(F.array_sort(F.collect_set("module_id")).alias("_found"))
    n = F.coalesce(F.size("_found"), F.lit(0))
    default = F.when(F.col("kind").startswith("csharp-"), "namespace-target-not-found").otherwise("outside-selected-sources")
    # A Rust path that only hits its own module has no reason of its own.
    return r.join(found, "id", "left").select(
        *[c for c in references.columns if c != "reason"],
        F.when(n == 1, "resolved").when(n > 1, "ambiguous").otherwise("unresolved").alias("resolution"),
        F.when(n == 1, F.col("_found")[0]).alias("target"),
        F.coalesce("_found", F.array().cast("array<string>")).alias("candidates"),
        F.when(n == 1, "").when(n > 1, "multiple-candidates").otherwise(F.coalesce("_why", default)).alias("reason"),
    )


def neighborhood(nodes: DataFrame, edges: DataFrame, seeds: list[str], *, direction: str = "both", depth: int = 1, edge_types: tuple[str, ...] = NEIGHBORHOOD_EDGE_TYPES, max_nodes: int = 100, max_edges: int = 200):
    """Bounded breadth-first neighborhood: (nodes with distance, edges, omitted counts).

    Levels are joins of the frontier with the edges, at most 5. Each node keeps the predecessor of its first discovery,
    in the order of discovery (parent's order, edge id, neighbor). The budgets are spent on nodes by distance and id, of
    which at most max_nodes come to the driver; edges between chosen nodes fill the
    rest by id.
    """
    if not 1 <= len(seeds) <= 20 or len(set(seeds)) != len(seeds):
        raise ValueError("1 to 20 distinct seeds")
    if direction not in ("both", "outgoing", "incoming") or not 0 <= depth <= 5 or not 1 <= max_nodes <= 1000 or not 0 <= max_edges <= 2000 or not set(edge_types) <= set(NEIGHBORHOOD_EDGE_TYPES):
        raise ValueError("direction, depth, budget or edge type out of bounds")
    spark = nodes.sparkSession
    scratch = Scratch(spark, "neighborhood")
    of_type = edges.where(F.col("type").isin(*edge_types) & F.col("from_id").isNotNull() & F.col("to_id").isNotNull()).select(F.col("id").alias("edge"), "from_id", "to_id").distinct()
    ways = []
    if direction != "incoming":
        ways.append(of_type.select("edge", F.col("from_id").alias("a"), F.col("to_id").alias("b")))
    if direction != "outgoing":
        ways.append(of_type.select("edge", F.col("to_id").alias("a"), F.col("from_id").alias("b")))
    adjacent = scratch.cut(ways[0] if len(ways) == 1 else ways[0].unionByName(ways[1]))
    found = spark.createDataFrame([(s, 0, [s], None, None) for s in seeds], "id string, distance int, ord array<string>, prev string, via string")
    if found.join(nodes.select("id"), "id", "left_anti").count():
        raise ValueError("unknown seed")
    frontier, seen = found, found
    for level in range(1, depth + 1):
        step = frontier.select(F.col("id").alias("a"), "ord").join(adjacent, "a").join(seen.select(F.col("id").alias("b")), "b", "left_anti")
        first = step.groupBy("b").agg(F.min(F.struct("ord", "edge", "a")).alias("f"))
        # The way of discovery sorts like its order numbers would, without a global sort.
        nxt = first.select(F.col("b").alias("id"), F.lit(level).alias("distance"), F.concat("f.ord", F.array("f.edge", "b")).alias("ord"), F.col("f.a").alias("prev"), F.col("f.edge").alias("via"))
        frontier = scratch.cut(nxt)
        seen = seen.unionByName(frontier)
    seen = scratch.cut(seen)
    chosen, required = [], []
    picked = set()
    for r in seen.orderBy("distance", "id").toLocalIterator():
        if len(chosen) >= max_nodes:
            break
        if r["distance"] > 0:
            if len(required) >= max_edges:
                break
            if r["prev"] not in picked:
                continue
            required.append(r["via"])
        picked.add(r["id"])
        chosen.append((r["id"], r["distance"]))
    kept = spark.createDataFrame(chosen, "id string, distance int")
    must = set(required)
    dist = seen.select("id", "distance")
    d1, d2 = dist.select(F.col("id").alias("from_id"), F.col("distance").alias("df")), dist.select(F.col("id").alias("to_id"), F.col("distance").alias("dt"))
    reach = of_type.join(d1, "from_id").join(d2, "to_id")
    if direction == "outgoing":
        reach = reach.where("dt <= df + 1")
    elif direction == "incoming":
        reach = reach.where("df <= dt + 1")
    reach = scratch.cut(reach)
    k1, k2 = F.broadcast(kept.select(F.col("id").alias("from_id"))), F.broadcast(kept.select(F.col("id").alias("to_id")))
    optional = reach.join(k1, "from_id", "left_semi").join(k2, "to_id", "left_semi").where(~F.col("edge").isin(*must) if must else F.lit(True))
    extra = [r[0] for r in optional.select("edge").distinct().orderBy("edge").limit(max(0, max_edges - len(must))).collect()]
    final = spark.createDataFrame([(e,) for e in sorted(must | set(extra))], "edge string")
    counts = (seen.count() - len(chosen), reach.select("edge").distinct().count() - len(must) - len(extra))
    return kept, reach.join(F.broadcast(final), "edge", "left_semi").select(F.col("edge").alias("id"), "from_id", "to_id").distinct(), counts


def _least_labels(scratch: Scratch, edges: DataFrame, turn: int) -> DataFrame:
    """node, f, t: of all nodes that reach a node over edges (a, b), and of all that it reaches, itself included, the one
    with the least priority (a hash of node and turn).

    Both directions run side by side. A step takes the least label over the edges in and then the label of the labelled
    node, which lets labels jump; each write holds two steps.
    """
    ways = edges.select(F.lit(True).alias("on"), "a", "b").unionByName(edges.select(F.lit(False).alias("on"), F.col("b").alias("a"), F.col("a").alias("b")))
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    label = F.struct(F.xxhash64("node", F.lit(turn)).alias("rank"), "node").alias("l")
    at = nodes.select("node", label).select(F.explode(F.array(F.lit(True), F.lit(False))).alias("on"), "node", "l")

    def step(now: DataFrame) -> DataFrame:
        down = ways.join(now.select("on", F.col("node").alias("a"), "l"), ["on", "a"]).groupBy("on", F.col("b").alias("node")).agg(F.min("l").alias("l2"))
        new = now.join(down, ["on", "node"], "left").withColumn("l", F.least("l", "l2")).drop("l2")
        heads = new.select(F.col("on").alias("on2"), F.col("node").alias("head"), F.col("l").alias("l3"))
        return new.join(heads, (F.col("on") == F.col("on2")) & (F.col("l.node") == F.col("head"))).withColumn("l", F.least("l", "l3")).select("on", "node", "l", "was")

    while True:
        nxt, moved = scratch.counted(step(step(at.select("on", "node", "l", F.col("l").alias("was")))), F.col("l") != F.col("was"))
        scratch.drop(at)
        at = nxt
        if not moved:
            break
    out = scratch.cut(at.groupBy("node").agg(F.max(F.when(F.col("on"), F.col("l.node"))).alias("f"), F.max(F.when(~F.col("on"), F.col("l.node"))).alias("t")))
    scratch.drop(at)
    return out


def cyclic_components(edges: DataFrame) -> DataFrame:
    """Strongly connected components with more than one member or a self-loop: node, component (its least node).

    Method: forward-backward labels with random priorities. In each round every node gets the least label that
    reaches it and the least that it reaches, by a hash of node and round. Where both agree, the node is in the component
    of that label's node, and the whole component is found; elsewhere edges between different labels can't be on a cycle
    and go. Chains fall apart at random places, so the number of rounds grows with the logarithm of the graph. Nodes without an edge in or
    out of what is left are trimmed before each round, as long as that pays. Rounds go on until no edge is left.
    """
    scratch = Scratch(edges.sparkSession, "components")
    e = scratch.cut(edges.select(F.col("from_id").alias("a"), F.col("to_id").alias("b")).where("a is not null and b is not null").distinct())
    loops = e.where("a = b").select(F.col("a").alias("node"), F.col("a").alias("component"))
    found, left, turn = None, e.where("a <> b"), 0
    while True:
        n = None
        while True:  # trim, as long as that takes a fifth of the edges off
            before = n
            for _ in range(2):
                left = left.join(left.select(F.col("b").alias("a")).distinct(), "a", "left_semi").join(left.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select("a", "b")
            left, n = scratch.counted(left, F.lit(True))
            if not n or (before is not None and n > 0.8 * before):
                break
        if not n:
            break
        both = _least_labels(scratch, left, turn)
        done = both.where("f = t").select("node", F.col("f").alias("c"))
        found = done if found is None else found.unionByName(done)
        open_ = both.where("f <> t")
        of = lambda x: open_.select(F.col("node").alias(x), F.struct("f", "t").alias("l" + x))
        left = left.join(of("a"), "a").join(of("b"), "b").where("la = lb").select("a", "b")
        turn += 1
    if found is None:
        return loops.distinct()
    big = found.groupBy("c").agg(F.count("*").alias("n"), F.min("node").alias("component")).where("n > 1").select("c", "component")
    named = found.join(big, "c").select("node", "component")
    return named.unionByName(loops.join(named.select("node"), "node", "left_anti"))


def peeled_cycles(pairs: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """Edges of simple cycles taken off a component one after the other, in order, until none is left.

    Each cycle is the one met first by depth-first search from the least node that lies on one, neighbors in order, and
    starts at its least node. What lies before a node's mark, and nodes that were left, can't be on a later cycle, hence
    the search goes on where it was and takes time in proportion to the edges.
    """
    out_: dict[str, list[str]] = {}
    for a, b in sorted(set(pairs)):
        out_.setdefault(a, []).append(b)
    mark = dict.fromkeys(out_, 0)
    witness: list[tuple[str, str]] = []
    done: set[str] = set()
    for root in sorted(out_):
        if root in done:
            continue
        path, at = [root], {root: 0}
        while path:
            node = path[-1]
            to = out_.get(node, ())
            i = mark.get(node, 0)
            if i >= len(to):
                done.add(node)
                del at[path.pop()]
                continue
            nxt = to[i]
            if nxt in at:
                cycle = path[at[nxt] :]
                for x in cycle:  # their edges to the next are off
                    mark[x] += 1
                for x in cycle[1:]:
                    del at[x]
                del path[at[nxt] + 1 :]
                k = cycle.index(min(cycle))
                cycle = cycle[k:] + cycle[:k]
                witness += zip(cycle, cycle[1:] + cycle[:1])
            elif nxt in done:
                mark[node] += 1
            else:
                at[nxt] = len(path)
                path.append(nxt)
    return witness


def cycle_witnesses(edges: DataFrame, components: DataFrame) -> DataFrame:
    """component, modules (sorted) and the witness edges in order: component, modules, pos, from_id, to_id.

    One component is handled in one task: the distinct edges between modules of a cycle, a graph of modules and not of
    code.
    """
    import pandas as pd

    members = components.groupBy("component").agg(F.array_sort(F.collect_set("node")).alias("modules"))
    own = edges.select("from_id", "to_id").distinct().join(components.select(F.col("node").alias("from_id"), "component"), "from_id").join(components.select(F.col("node").alias("to_id"), F.col("component").alias("c2")), "to_id").where("component = c2")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        w = peeled_cycles(list(zip(pdf["from_id"], pdf["to_id"])))
        return pd.DataFrame({"component": pdf["component"].iloc[0], "pos": range(len(w)), "from_id": [a for a, _ in w], "to_id": [b for _, b in w]})

    from riskframe.runtime import ship

    ship(edges.sparkSession)
    w = own.select("component", "from_id", "to_id").groupBy("component").applyInPandas(run, "component string, pos int, from_id string, to_id string")
    return w.join(members, "component").select("component", "modules", "pos", "from_id", "to_id")


def forbidden(edges: DataFrame, names: DataFrame, rules: list[dict]) -> DataFrame:
    """Import edges that break a rule, one row per edge and rule: from, to, system, reason, rule.

    names: id, name ('system/name'), system. Rules hold globs from and to, system and reason; they are a short list given by
    the caller, compiled into one regular expression each.
    """
    a = names.select(F.col("id").alias("from_id"), F.col("name").alias("from"), "system")
    b = names.select(F.col("id").alias("to_id"), F.col("name").alias("to"))
    named = edges.select("from_id", "to_id").distinct().join(a, "from_id").join(b, "to_id")
    hits = F.array_compact(
        F.array(
            F.lit(None).cast("struct<rule:int,reason:string>"),
            *[
                F.when(
                    F.col("from").rlike(glob_regex(r.get("from", ""))) & F.col("to").rlike(glob_regex(r.get("to", ""))) & (F.lit(not r.get("system")) | (F.col("system") == r.get("system", ""))),
                    F.struct(F.lit(i).alias("rule"), F.lit(r.get("reason", "")).alias("reason")),
                )
                for i, r in enumerate(rules)
            ]
        )
    )
    return named.withColumn("hit", F.explode(hits)).select("from", "to", "system", "hit.reason", "hit.rule")


def affected_tests(edges: DataFrame, seeds: DataFrame, tests: DataFrame) -> DataFrame:
    """Tests that reach a changed function over call edges: test, distance (least), seeds (sorted).

    edges: from_id, to_id; seeds: id; tests: id. A function with a single callee that isn't a seed is reached through
    that one only: such functions get a pointer to the first other function on their way and the distance to it, by pointer doubling. Between
    the others, the frontier of (seed, node, distance) that have become nearer goes against the edges until none does,
    however long the ways are. Distances are those of breadth-first search; a test that is itself a seed and
    also reachable from another keeps the other's distance, as a stored 0 counts as unset.
    """
    scratch = Scratch(edges.sparkSession, "reach")
    back = scratch.cut(edges.select(F.col("to_id").alias("node"), F.col("from_id").alias("caller")).where("node is not null and caller is not null").distinct())
    start = scratch.cut(seeds.select(F.col("id").alias("seed")).where("seed is not null").distinct())
    callees = back.groupBy("caller").agg(F.count("*").alias("n"), F.min("node").alias("node"))
    single = callees.where("n = 1 and caller <> node").join(start.select(F.col("seed").alias("caller")), "caller", "left_anti").select(F.col("caller").alias("x"), F.col("node").alias("head"), F.lit(1).alias("far"))
    way = scratch.cut(single)
    open_n = -1
    while True:
        on = way.select(F.col("x").alias("h"), F.col("head").alias("head2"), F.col("far").alias("far2"))
        far = way.join(on, F.col("head") == F.col("h"), "left").select("x", F.coalesce("head2", "head").alias("head"), (F.col("far") + F.coalesce("far2", F.lit(0))).alias("far"), F.col("h").isNotNull().alias("open"))
        nxt, n = scratch.counted(far, F.col("open"))
        scratch.drop(way)
        way = nxt.select("x", "head", "far")
        way._scratch_path = nxt._scratch_path
        if n == 0 or n == open_n:  # what stays open is on or above a ring that no seed is on
            ring = nxt.where("open").select("x")
            break
        open_n = n
    way = way.join(ring, "x", "left_anti")
    # Edges into functions that several ways lead to, from the head of their callee.
    merge = back.join(way.select(F.col("x").alias("caller")), "caller", "left_anti").join(ring.select(F.col("x").alias("caller")), "caller", "left_anti")
    hops = merge.join(way, F.col("node") == F.col("x"), "left").groupBy(F.coalesce("head", "node").alias("node"), "caller").agg(F.min(F.coalesce("far", F.lit(0)) + 1).alias("w"))
    hops = scratch.cut(hops)
    frontier = scratch.cut(start.select("seed", F.col("seed").alias("node"), F.lit(0).alias("distance")))
    seen, turn = frontier, 0
    while True:
        step = frontier.join(hops, "node").groupBy("seed", F.col("caller").alias("node")).agg(F.min(F.col("distance") + F.col("w")).alias("distance"))
        known = seen.groupBy("seed", "node").agg(F.min("distance").alias("known"))
        frontier, n = scratch.counted(step.join(known, ["seed", "node"], "left").where("known is null or distance < known").select("seed", "node", "distance"), F.lit(True))
        if not n:
            break
        seen, turn = seen.unionByName(frontier), turn + 1
        if turn % 8 == 0:
            seen = scratch.cut(seen.groupBy("seed", "node").agg(F.min("distance").alias("distance")))
    best = scratch.cut(seen.groupBy("seed", "node").agg(F.min("distance").alias("distance")))
    wanted = tests.select(F.col("id").alias("test")).distinct()
    direct = best.join(wanted, F.col("node") == F.col("test")).select("test", "seed", "distance")
    far = best.join(way.join(wanted, F.col("x") == F.col("test")), F.col("node") == F.col("head")).select("test", "seed", (F.col("distance") + F.col("far")).alias("distance"))
    return direct.unionByName(far).groupBy("test").agg(
        F.coalesce(F.min(F.when(F.col("distance") > 0, F.col("distance"))), F.lit(0)).alias("distance"), F.array_sort(F.collect_set("seed")).alias("seeds")
    )
