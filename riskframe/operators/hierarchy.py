"""Parent-child links to full hierarchies: root, depth, path and descendants of every node."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.runtime import Scratch


def _packed(c: Column) -> Column:
    """Ids of 64 lower-case hex digits as 32 bytes, any other id as its text; the first byte tells which."""
    return F.when(
        c.rlike("^[0-9a-f]{64}$"), F.concat(F.unhex(F.lit("00")), F.unhex(c))
    ).otherwise(F.concat(F.unhex(F.lit("01")), F.encode(c, "UTF-8")))


def hierarchy(edges: DataFrame, *, parent: str, child: str, paths: bool = True) -> DataFrame:
    """Root, depth and (optionally) path of every node that is an end of an edge.

    Method: pointer doubling. Every node starts with a pointer to its parent; each round joins the
    pointers that haven't reached a root with the pointers of the nodes they point at, which doubles their
    distance and concatenates the path segments. Nodes that reach a root leave the rounds. In a round in
    which none leaves, all that are left are on a cycle or below one, since among unresolved nodes of a tree
    some always lies within the doubled distance. Rounds: the logarithm of the depth.

    Nodes with several distinct parents are cut out as roots of their own blocks first, so that doubling
    always follows one pointer; then the blocks are joined by the same doubling over (depth, root, path) minima
    (``_settle_blocks``). Such a node gets its smallest (depth, root, path); it is cyclic if any parent is.

    Result: node_id, root_id, depth, cyclic, and path (array of ids from the root to the node, both
    included; null where cyclic) if asked for. A node on a cycle or below one has root_id '' and depth -1.
    Defined cases: edges with a null end are left out, repeated edges count once, a node that links to itself
    is a cycle, empty tables give an empty result, other columns are ignored.
    """
    spark = edges.sparkSession
    scratch = Scratch(spark, "hierarchy")
    links = edges.select(_packed(F.col(parent)).alias("p"), _packed(F.col(child)).alias("n")).where("p is not null and n is not null")
    nil = F.lit(None).cast("binary")
    ends = links.select(F.explode(F.array(F.struct("n", "p"), F.struct(F.col("p").alias("n"), nil.alias("p")))).alias("e"))
    known = ends.groupBy("e.n").agg(F.min("e.p").alias("lo"), F.max("e.p").alias("hi"), F.bool_or(F.col("e.p").isNull()).alias("inner"))
    root, several = F.col("lo").isNull(), F.col("lo") != F.col("hi")
    seg = {"path": F.when(root | several, F.array().cast("array<binary>")).otherwise(F.array("n"))} if paths else {}
    nodes = scratch.cut(
        known.select(
            "n",
            F.when(root | several, F.col("n")).otherwise(F.col("lo")).alias("a"),
            F.when(root | several, 0).otherwise(1).alias("d"),
            F.coalesce(root | several, F.lit(True)).alias("done"),
            F.coalesce(several, F.lit(False)).alias("several"),
            "inner",
            *[c.alias(k) for k, c in seg.items()],
        )
    )
    cols = ["n", "a", "d", "done", "inner", *seg]
    counts = nodes.agg(F.count_if(~F.col("done")), F.count_if("several")).first()
    active_n, several_n = counts[0], counts[1]
    done = nodes.where("done").select(*cols)
    active = nodes.where("not done").select(*cols)
    before = None
    while active_n:
        # Only nodes with children are pointed at.
        t = done.unionByName(active).where("inner").select(
            F.col("n").alias("m"), F.col("a").alias("a2"), F.col("d").alias("d2"), F.col("done").alias("done2"), *[F.col(k).alias(k + "2") for k in seg]
        )
        resolved, active = scratch.split(
            active.join(t, F.col("a") == F.col("m")).select(
                "n",
                F.col("a2").alias("a"),
                (F.col("d") + F.col("d2")).alias("d"),
                F.col("done2").alias("done"),
                "inner",
                *[F.concat(k + "2", k).alias(k) for k in seg],
            ),
            "done",
        )
        left = active.count()
        scratch.drop(before)
        before = active
        done = done.unionByName(resolved)
        if left == active_n:
            break
        active_n = left
    if several_n:
        done, active = _settle_blocks(scratch, nodes, links, done, active, bool(seg))
    cyclic = active.select("n")
    out = done.select(
        _text("n").alias("node_id"),
        _text("a").alias("root_id"),
        F.col("d").alias("depth"),
        F.lit(False).alias("cyclic"),
        *[F.transform(F.concat(F.array("a"), k), lambda x: _text_of(x)).alias(k) for k in seg],
    )
    return out.unionByName(
        cyclic.select(
            _text("n").alias("node_id"),
            F.lit("").alias("root_id"),
            F.lit(-1).alias("depth"),
            F.lit(True).alias("cyclic"),
            *[F.lit(None).cast("array<string>").alias(k) for k in seg],
        )
    )


def _text(name: str) -> Column:
    return _text_of(F.col(name))


def _text_of(c: Column) -> Column:
    rest = F.substring(c, F.lit(2), F.octet_length(c) - 1)
    return F.when(F.substring(c, 1, 1) == F.unhex(F.lit("00")), F.lower(F.hex(rest))).otherwise(F.decode(rest, "UTF-8"))


def _settle_blocks(scratch, nodes, links, done, active, paths):
    """Resolves the nodes with several parents (forks) and, through them, the nodes of their blocks.

    Every fork has one entry per block that its parents lie in: the block's head (a root or a fork), the least distance
    to it and the segment of path. Each round follows open entries by the entries of their heads, which doubles the
    distance; a fork of which no entry is open is settled with its smallest one, a fork with a cyclic parent is
    cyclic. A round that settles none leaves cycles only. Where following all entries would give more than
    ``_GROWTH`` times as many as there were, a round follows settled heads only, which never adds entries.
    """
    forks = nodes.where("several").select(F.col("n").alias("f"))
    heads = links.join(forks, F.col("n") == F.col("f"), "left_semi").distinct()
    seg = F.concat(F.coalesce("path", F.array().cast("array<binary>")), F.array("n")) if paths else F.lit(None).cast("array<binary>")
    where = done.select(F.col("n").alias("m"), "a", "d", *(["path"] if paths else []))
    first = heads.join(where, F.col("p") == F.col("m"), "left").select(F.col("n").alias("f"), "a", (F.col("d") + 1).alias("d"), seg.alias("seg"))
    first = first.join(forks.withColumnRenamed("f", "g"), F.col("a") == F.col("g"), "left").select("f", "a", "d", "seg", F.col("g").isNotNull().alias("open"))
    entries = scratch.cut(_least_entries(first))
    limit = _GROWTH * max(entries.count(), 1000)
    settled, waiting = None, -1
    while True:
        per = entries.groupBy("f").agg(F.bool_or(F.col("a").isNull()).alias("bad"), F.bool_or("open").alias("open"), F.min(F.struct("d", F.col("a").alias("root"), "seg")).alias("best"))
        new, rest = scratch.split(per.select("f", F.when(F.col("bad"), None).otherwise(F.col("best")).alias("best"), (F.col("bad") | ~F.col("open")).alias("ready")), "ready")
        settled = new.select("f", "best") if settled is None else settled.unionByName(new.select("f", "best"))
        left = rest.count()
        if left == 0 or left == waiting:
            break
        waiting = left
        kept = scratch.cut(entries.join(rest.select("f"), "f", "left_semi"))
        scratch.drop(entries)
        over = settled.select(F.col("f").alias("h"), F.col("best.root").alias("a2"), F.col("best.d").alias("d2"), F.col("best.seg").alias("seg2"), F.lit(False).alias("open2"))
        still = kept.where("open").join(over.select("h"), F.col("a") == F.col("h"), "left_anti")
        on = kept.select(F.col("f").alias("h"), F.col("a").alias("a2"), F.col("d").alias("d2"), F.col("seg").alias("seg2"), F.col("open").alias("open2"))
        wide = kept.count() + still.join(on.groupBy("h").count(), F.col("a") == F.col("h")).agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0] > limit
        step = kept.where("open").join(over if wide else over.unionByName(on), F.col("a") == F.col("h"))
        step = step.select("f", F.col("a2").alias("a"), (F.col("d") + F.col("d2")).alias("d"), F.concat("seg2", "seg").alias("seg") if paths else F.col("seg"), F.col("open2").alias("open"))
        parts = kept.where("not open").unionByName(step)
        entries = scratch.cut(_least_entries(parts.unionByName(still.select(*kept.columns)) if wide else parts))
        scratch.drop(kept)
    of = settled.where("best is not null").select(F.col("f").alias("g"), F.col("best").alias("b"))
    known = done.join(of, F.col("a") == F.col("g"), "left").join(forks, F.col("a") == F.col("f"), "left")
    final = scratch.cut(
        known.select(
            "n",
            F.coalesce("b.root", "a").alias("a"),
            (F.col("d") + F.coalesce("b.d", F.lit(0))).alias("d"),
            (F.col("f").isNull() | F.col("g").isNotNull()).alias("done"),
            "inner",
            *([F.when(F.col("g").isNotNull(), F.concat("b.seg", "path")).otherwise(F.col("path")).alias("path")] if paths else []),
        )
    )
    return final.where("done"), active.unionByName(final.where("not done"))


_GROWTH = 4


def _least_entries(rows: DataFrame) -> DataFrame:
    """One entry per fork and head, the nearest; a null head (a cyclic parent) stays."""
    return rows.groupBy("f", "a").agg(F.min(F.struct("d", "seg")).alias("e"), F.bool_or("open").alias("open")).select("f", "a", "e.d", "e.seg", "open")


def descendants(tree: DataFrame) -> DataFrame:
    """Every (ancestor_id, node_id, distance) with distance of 1 or more, of a hierarchy with paths.

    The result holds one row per node and ancestor, the sum of all depths; it is made without a join.
    """
    return tree.where("not cyclic").select(
        F.posexplode(F.slice("path", 1, F.size("path") - 1)).alias("pos", "ancestor_id"), "node_id", "depth"
    ).select("ancestor_id", "node_id", (F.col("depth") - F.col("pos")).alias("distance"))


def declared_tree(graph_edges: DataFrame, paths: bool = True) -> DataFrame:
    """The hierarchy of the contains and declares edges, whatever the case and blanks of their type."""
    kind = F.lower(F.regexp_replace("type", r"(?U)^\s+|\s+$", ""))
    return hierarchy(graph_edges.where(kind.isin("contains", "declares")), parent="from_id", child="to_id", paths=paths)
