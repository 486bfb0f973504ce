"""Filling fixed-capacity containers with documents: minimum bin slack over lengths, with repeated patterns."""

from __future__ import annotations

from bisect import bisect_left
from operator import neg

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskframe.llm.tokenizing import sized
from riskframe.runtime import Scratch, map_arrow, ship


def closest_fill(space: int, counts: dict[int, int], sizes: list[int]) -> dict[int, int]:
    """The multiset of items (at most counts of each size) that fills the space best, as size -> number.

    Bitset subset sums: bit b of a Python integer says that b can be filled. A size with many items enters in
    chunks of 1, 2, 4, ... of them; the bitsets before each chunk are kept for the way back from the best sum. sizes are
    in falling order; the search ends as soon as the space can be filled exactly. One or two items that fill it exactly
    are looked up first, which nearly always succeeds where there are many sizes.
    """
    if space <= 0:
        return {}
    if counts.get(space, 0) > 0:
        return {space: 1}
    start = bisect_left(sizes, -space, key=neg)
    for i in range(start, len(sizes)):
        s = sizes[i]
        if s * 2 < space:
            break
        if counts[s] > 0 and counts.get(space - s, 0) > (space == 2 * s):
            return {s: 1, space - s: 1} if space != 2 * s else {s: 2}
    mask, reach = (1 << (space + 1)) - 1, 1
    steps: list[tuple[int, int, int]] = []
    full = 1 << space
    for i in range(start, len(sizes)):
        s = sizes[i]
        left, chunk = min(counts[s], space // s), 1
        while left > 0:
            k = min(chunk, left)
            new = (reach | (reach << (s * k))) & mask
            if new != reach:
                steps.append((s, k, reach))
                reach = new
                if reach & full:
                    break
            left -= k
            chunk *= 2
        if reach & full:
            break
    at = reach.bit_length() - 1
    used: dict[int, int] = {}
    for s, k, before in reversed(steps):
        if not (before >> at) & 1:
            used[s] = used.get(s, 0) + k
            at -= s * k
    return used


def patterns(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(containers, items per container by size) that place all items.

    Minimum bin slack: each container takes the largest item left and the multiset of the others that leaves
    the least space; a multiset is repeated for as many containers as the counts allow, hence the number of patterns
    depends on the distinct sizes and hardly on the number of items.
    """
    left = {s: c for s, c in counts.items() if c > 0 and 0 < s <= capacity}
    sizes = sorted(left, reverse=True)
    out = []
    while sizes:
        top = sizes[0]
        left[top] -= 1
        fill = closest_fill(capacity - top, left, sizes)
        left[top] += 1
        fill[top] = fill.get(top, 0) + 1
        times = min(left[s] // k for s, k in fill.items())
        out.append((times, fill))
        for s, k in fill.items():
            left[s] -= times * k
        for s in fill:
            if left[s] == 0:
                del sizes[bisect_left(sizes, -s, key=neg)]
    return out


def runs(pats: list[tuple[int, dict[int, int]]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each size its runs in rank order: first rank, first container (from 1), items per container, offset."""
    rank: dict[int, int] = {}
    table: dict[int, list[tuple[int, int, int, int]]] = {}
    container = 1
    for times, fill in pats:
        offset = 0
        for s in sorted(fill, reverse=True):
            k = fill[s]
            table.setdefault(s, []).append((rank.get(s, 0), container, k, offset))
            rank[s] = rank.get(s, 0) + times * k
            offset += s * k
        container += times
    return {s: tuple(np.array(c, np.int64) for c in zip(*rows)) for s, rows in table.items()}


def packed(documents: DataFrame, specs: DataFrame, *, tokenizer: str | None = None, max_capacity: int = 1 << 17, max_runs: int = 5_000_000) -> DataFrame:
    """Every piece of every document in a container of each capacity.

    Columns: spec_no, container_no (from 1; null for a document of 0 tokens, which takes no space), doc_id, piece_no
    (from 0), start_token (of the piece in its document), tokens, container_offset.

    Method: texts are sized once; one longer than the capacity is cut into full pieces and a rest, no other is cut. The
    counts of each size (at most the capacity's number of sizes, whatever the corpus) come to the driver, where
    minimum bin slack plans patterns of sizes. Pieces get their rank among those of their size from counts per hash
    bucket and a rank within the bucket, so that a size which a third of the documents have is spread over
    many tasks, and find their container from the rank by binary search in the shared runs.

    Defined cases: null, empty and blank texts (0 tokens for null and empty); equal documents are packed each;
    specs without number and capacities that are null, 0 or negative are left out; one spec_no with several capacities counts with the
    greatest; empty tables give an empty result; other columns are ignored.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "packing")
    wanted = specs.where("spec_no is not null and capacity_tokens > 0").groupBy("spec_no").agg(F.max("capacity_tokens").alias("capacity"))
    capacities = dict(wanted.limit(1001).collect())
    if len(capacities) > 1000 or any(c > max_capacity for c in capacities.values()):
        raise ValueError(f"more than 1000 container kinds or a capacity beyond {max_capacity}")
    docs = scratch.cut(sized(documents, ["doc_id"], tokenizer))
    kinds = F.array(*[F.struct(F.lit(k).alias("spec_no"), F.lit(int(c)).cast("long").alias("capacity")) for k, c in sorted(capacities.items())]) if capacities else None
    if kinds is None:
        return docs.where("false").selectExpr("0 spec_no", "0L container_no", "doc_id", "0L piece_no", "0L start_token", "tokens", "0L container_offset")
    whole = docs.withColumn("k", F.explode(kinds)).select("doc_id", F.col("tokens").alias("t"), "k.spec_no", "k.capacity")
    last = F.floor((F.greatest(F.col("t"), F.lit(1)) - 1) / F.col("capacity"))
    pieces = whole.withColumn("piece_no", F.explode(F.sequence(F.lit(0).cast("long"), last))).select(
        "spec_no", "doc_id", "piece_no", (F.col("piece_no") * F.col("capacity")).alias("start_token"), F.least(F.col("capacity"), F.col("t") - F.col("piece_no") * F.col("capacity")).alias("tokens")
    )
    total = docs.count()
    buckets = max(8, total // 50_000)
    keyed = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(buckets)))
    counts = scratch.cut(keyed.groupBy("spec_no", "tokens", "bucket").agg(F.count("*").alias("n")))
    # Each kind of container is planned in a task of its own, from one count per size, of which the capacity bounds the number.
    sizes = counts.where("tokens > 0").groupBy("spec_no", "tokens").agg(F.sum("n").alias("n"))

    def plan(t: pa.Table) -> pa.Table:
        spec = t.column("spec_no")[0].as_py()
        made = runs(patterns(dict(zip(t.column("tokens").to_pylist(), t.column("n").to_pylist())), capacities[spec]))
        cols = [np.concatenate([np.full(len(r[0]), s, np.int64) for s, r in made.items()]), *(np.concatenate([r[i] for r in made.values()]) for i in range(4))]
        return pa.table([pa.array(np.full(len(cols[0]), spec), t.schema.field("spec_no").type), *map(pa.array, cols)], names=["spec_no", "tokens", "first", "container", "per", "offset"])

    ship(spark)
    kind = sizes.schema["spec_no"].dataType.simpleString()
    planned = scratch.cut(sizes.groupBy("spec_no").applyInArrow(plan, f"spec_no {kind}, tokens long, first long, container long, per long, offset long"))
    n_runs = planned.count()
    if n_runs > max_runs:
        raise ValueError(f"{n_runs} runs of containers; more than {max_runs}")
    got = planned.orderBy("spec_no", "tokens", "first").toArrow()
    columns = [got.column(c).to_numpy() for c in ("spec_no", "tokens", "first", "container", "per", "offset")]
    plans: dict[int, dict[int, tuple]] = {}
    ends = np.flatnonzero(np.diff(columns[0]) | np.diff(columns[1])) + 1 if n_runs else []
    for a, b in zip([0, *ends], [*ends, n_runs] if n_runs else []):
        plans.setdefault(int(columns[0][a]), {})[int(columns[1][a])] = tuple(c[a:b] for c in columns[2:])
    shared = spark.sparkContext.broadcast(plans)

    before = Window.partitionBy("spec_no", "tokens").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("spec_no", "tokens", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("spec_no", "tokens", "bucket").orderBy("doc_id", "piece_no")
    ranked = keyed.withColumn("rn", F.row_number().over(within)).join(offsets, ["spec_no", "tokens", "bucket"]).select(
        "spec_no", "doc_id", "piece_no", "start_token", "tokens", (F.col("base") + F.col("rn") - 1).alias("rank")
    )

    def run(batches):
        for b in batches:
            spec, size, rank = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 4, 5))
            box, off = np.zeros(len(spec), np.int64), np.zeros(len(spec), np.int64)
            order = np.lexsort((size, spec))
            cuts = np.flatnonzero(np.diff(spec[order]) | np.diff(size[order])) + 1
            for part in np.split(order, cuts):
                if not len(part) or size[part[0]] == 0:
                    continue
                first, container, per, offset = shared.value[spec[part[0]]][size[part[0]]]
                j = np.searchsorted(first, rank[part], "right") - 1
                d = rank[part] - first[j]
                box[part] = container[j] + d // per[j]
                off[part] = offset[j] + d % per[j] * size[part[0]]
            none = size == 0
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(box, pa.int64(), mask=none), b.column(1), b.column(2), b.column(3), b.column(4), pa.array(off, pa.int64(), mask=none)],
                names=["spec_no", "container_no", "doc_id", "piece_no", "start_token", "tokens", "container_offset"],
            )

    types = {f.name: f.dataType.simpleString() for f in ranked.schema}
    return map_arrow(ranked, run, f"spec_no {types['spec_no']}, container_no long, doc_id {types['doc_id']}, piece_no long, start_token long, tokens long, container_offset long")


def summary(assigned: DataFrame, specs: DataFrame) -> DataFrame:
    """Per container kind: containers used, the least number the tokens need, tokens, and the share of space in use."""
    used = assigned.groupBy("spec_no").agg(F.max("container_no").alias("containers"), F.count("*").alias("pieces"), F.sum("tokens").alias("tokens"))
    caps = specs.where("capacity_tokens > 0").groupBy("spec_no").agg(F.max("capacity_tokens").alias("capacity_tokens"))
    return used.join(caps, "spec_no").select(
        "spec_no", "capacity_tokens", "containers", F.ceil(F.col("tokens") / F.col("capacity_tokens")).alias("least_containers"), "pieces", "tokens",
        (F.col("tokens") / (F.col("containers") * F.col("capacity_tokens"))).alias("fill"),
    )
