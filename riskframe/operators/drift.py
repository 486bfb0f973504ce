"""Schemas that drift between files of JSON records: profiles, typed changes, renames and one unified table."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskframe.runtime import Scratch, map_arrow

#: The bits of a field's type set.
TYPE_BITS = {"object": 1, "array": 2, "string": 4, "number": 8, "boolean": 16}


def _kind(v) -> int:
    """The type bit of a JSON value, 0 for null."""
    if v is None:
        return 0
    if isinstance(v, bool):
        return 16
    if isinstance(v, str):
        return 4
    if isinstance(v, (int, float)):
        return 8
    return 1 if isinstance(v, dict) else 2


def _parse(text: str | None) -> dict | None:
    """The payload's object, or None if it isn't one complete JSON object."""
    if not text:
        return None
    try:
        v = json.loads(text)
    except (ValueError, RecursionError):
        return None
    return v if isinstance(v, dict) else None


def _fields(obj: dict) -> Iterator[tuple[str, object]]:
    """Every (dotted path, value) of an object; elements of arrays of objects stand under ``path[]``."""
    stack = [("", obj)]
    while stack:
        prefix, o = stack.pop()
        for k, v in o.items():
            path = prefix + k
            yield path, v
            if isinstance(v, dict):
                stack.append((path + ".", v))
            elif isinstance(v, list):
                stack.extend((path + "[].", x) for x in reversed(v) if isinstance(x, dict))


def _plain(v):
    """Values that are equal as JSON become equal as text: 1 and 1.0 alike."""
    if isinstance(v, float) and v.is_integer() and abs(v) < 2**53:
        return int(v)
    if isinstance(v, dict):
        return {k: _plain(x) for k, x in v.items()}
    if isinstance(v, list):
        return [_plain(x) for x in v]
    return v


def _text(v) -> str:
    """Canonical JSON; values nested beyond what Python can walk count as equal to each other."""
    try:
        return _dumped(v)
    except RecursionError:
        return "..."


def _dumped(v) -> str:
    return json.dumps(_plain(v), sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def _digest(values: list) -> bytes:
    return hashlib.blake2b("\n".join(map(_text, values)).encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _at(obj, steps: tuple[str, ...]) -> list:
    """The values that stand at a path, in document order."""
    found = [obj]
    for step in steps:
        many, key = step.endswith("[]"), step[:-2] if step.endswith("[]") else step
        found = [x[key] for x in found if isinstance(x, dict) and key in x]
        if many:
            found = [y for x in found if isinstance(x, list) for y in x if isinstance(y, dict)]
    return found


def profile(pages: DataFrame, file: str = "file_id", payload: str = "payload") -> DataFrame:
    """One row per file and field: file, field, types (bit set of the types among its non-null values).

    A file has a field if any of its complete records has it. Each task gathers its fields before the shuffle.
    """

    def run(batches):
        for b in batches:
            seen: dict[tuple, int] = {}
            for f, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if (o := _parse(text)) is not None:
                    for path, v in _fields(o):
                        seen[f, path] = seen.get((f, path), 0) | _kind(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in seen], pa.int64()), pa.array([k[1] for k in seen], pa.string()), pa.array(list(seen.values()), pa.int32())],
                names=["file", "field", "types"],
            )

    rows = pages.select(F.col(file).cast("long").alias("file"), F.col(payload).alias("payload")).where("file is not null")
    return map_arrow(rows, run, "file long, field string, types int").groupBy("file", "field").agg(F.bit_or("types").alias("types"))


def file_order(pages: DataFrame, file: str, stream: str, produced: str) -> DataFrame:
    """Each file and the one produced before it in its stream (null for the first): file, previous."""
    files = pages.where(F.col(file).isNotNull()).groupBy(F.col(stream).alias("stream"), F.col(file).cast("long").alias("file")).agg(F.min(produced).alias("at"))
    return files.select("file", F.lag("file").over(Window.partitionBy("stream").orderBy("at", "file")).alias("previous"))


def _parent(c):
    """All of a path but its last name."""
    return F.when(F.instr(c, ".") > 0, F.regexp_replace(c, r"\.[^.]*$", "")).otherwise(F.lit(""))


def schema_changes(
    pages: DataFrame,
    *,
    file: str = "file_id",
    stream: str = "stream",
    produced: str = "produced_at",
    report: str = "report_no",
    payload: str = "payload",
) -> DataFrame:
    """One row per change between a file's fields and those of the file produced before it in its stream.

    Columns: file, change ('added', 'removed', 'type', 'renamed'), field, new_field ('' unless renamed).

    Method: (1) a profile of every file, fields and their type sets, gathered inside each task; (2) profiles of
    neighbouring files are compared by one aggregation; (3) for the fields that are gone and new under one
    parent with one type, a sketch of their values: the exclusive-or of 64-bit hashes (two of them) of
    (report, value digest) over the reports both files hold. Two fields have equal values in every shared
    report if and only if their sketches agree (up to hash collisions of 2**-128), so candidates meet in an
    equality join instead of pair by pair; (4) fields with one sketch are assigned to each other by a
    minimum-cost bipartite matching on name similarity; a renamed pair is no longer added and removed.
    Fields below a field that is itself added, removed, renamed or changed in type don't count.

    Defined cases: payloads that aren't complete JSON objects (null, truncated, other text) are left out, and
    a file without any other payload has no fields; rows without file are left out, rows without report take no
    part in rename checks; repeated rows change nothing; a null stream is a stream; files produced at one
    time are ordered by id; empty tables give an empty result; other columns are ignored.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "drift")
    rows = pages.select(*[F.col(c) for c in dict.fromkeys([file, stream, produced, report, payload])])
    order = scratch.cut(file_order(rows, file, stream, produced))
    prof = scratch.cut(profile(rows, file, payload))
    now = prof.join(order.where("previous is not null"), "file").select(F.col("file").alias("pair"), "field", F.col("types").alias("new"), F.lit(None).cast("int").alias("old"))
    was = prof.withColumnRenamed("file", "previous").join(order, "previous").select(F.col("file").alias("pair"), "field", F.lit(None).cast("int").alias("new"), F.col("types").alias("old"))
    both = now.unionByName(was).groupBy("pair", "field").agg(F.max("new").alias("new"), F.max("old").alias("old"))
    diffs = scratch.cut(
        both.where("not (new <=> old)").select(
            "pair",
            "field",
            F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("type").alias("change"),
            F.coalesce("new", "old").alias("types"),
            _parent(F.col("field")).alias("parent"),
        )
    )
    # A field below one that is added, removed or of another type (or renamed: both of its names are among these).
    above = F.filter(
        F.transform(F.sequence(F.lit(1), F.size(F.split("field", r"\."))), lambda i: F.regexp_replace(F.array_join(F.slice(F.split("field", r"\."), 1, i), "."), r"\[\]$", "")),
        lambda x: x != F.col("field"),
    )
    uppers = diffs.select("pair", "field", F.explode(above).alias("upper"))
    below = uppers.join(diffs.select("pair", F.col("field").alias("upper")), ["pair", "upper"], "left_semi").select("pair", "field")
    top = scratch.cut(diffs.join(below, ["pair", "field"], "left_anti"))

    loose = top.where("change <> 'type'")
    both_kinds = loose.groupBy("pair", "parent", "types").agg(F.count_if(F.col("change") == "added").alias("a"), F.count_if(F.col("change") == "removed").alias("r")).where("a > 0 and r > 0")
    wanted = scratch.cut(loose.join(both_kinds, ["pair", "parent", "types"], "left_semi"))
    renames = scratch.cut(_renames(rows, order, wanted, file, report, payload))

    gone = renames.select("pair", F.explode(F.array("field", "new_field")).alias("field"))
    rest = top.join(gone, ["pair", "field"], "left_anti").select("pair", "change", "field", F.lit("").alias("new_field"))
    out = rest.unionByName(renames.select("pair", F.lit("renamed").alias("change"), "field", "new_field"))
    return out.select(F.col("pair").alias(file), "change", "field", "new_field")


def _renames(rows, order, wanted, file, report, payload):
    """The matched (pair, field, new_field) among the wanted fields of each pair of files."""
    per_pair = wanted.groupBy("pair", "change").agg(F.collect_set("field").alias("fields"))
    roles = (
        per_pair.join(order.withColumnRenamed("file", "pair"), "pair")
        .select("pair", (F.col("change") == "added").alias("later"), F.when(F.col("change") == "added", F.col("pair")).otherwise(F.col("previous")).alias("file"), "fields")
        .groupBy("file")
        .agg(F.collect_list(F.struct("pair", "later", "fields")).alias("roles"))  # two at most: as a later and as an earlier file
    )
    records = rows.select(F.col(file).cast("long").alias("file"), F.col(report).cast("long").alias("report"), F.col(payload).alias("payload")).where("report is not null")

    def run(batches):
        for b in batches:
            out: dict[str, list] = {"pair": [], "later": [], "report": [], "field": [], "digest": []}
            for r, text, roles in zip(*(b.column(i).to_pylist() for i in range(3))):
                if (o := _parse(text)) is None:
                    continue
                for role in roles:
                    for f in role["fields"]:
                        values = _at(o, tuple(f.split(".")))
                        for k, v in zip(out, (role["pair"], role["later"], r, f, _digest(values) if any(x is not None for x in values) else None)):
                            out[k].append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out["pair"], pa.int64()), pa.array(out["later"], pa.bool_()), pa.array(out["report"], pa.int64()), pa.array(out["field"], pa.string()), pa.array(out["digest"], pa.binary())],
                names=list(out),
            )

    values = (
        map_arrow(records.join(roles, "file").select("report", "payload", "roles"), run, "pair long, later boolean, report long, field string, digest binary")
    )
    once = values.groupBy("pair", "later", "report", "field").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi"))
    scratch = Scratch(rows.sparkSession, "drift-values")
    once = scratch.cut(once)
    shared = once.groupBy("pair", "report").agg(F.max(F.col("later")).alias("l"), F.min(F.col("later")).alias("e")).where("l and not e")
    sketch = (
        once.join(shared, ["pair", "report"], "left_semi")
        .groupBy("pair", "later", "field")
        .agg(
            F.bit_xor(F.xxhash64(F.lit(1), "report", "lo", "hi")).alias("s1"),
            F.bit_xor(F.xxhash64(F.lit(2), "hi", "lo", "report")).alias("s2"),
            F.count("lo").alias("held"),
        )
        .where("held > 0")
    )
    classes = (
        sketch.join(wanted.select("pair", "field", "parent", "types", (F.col("change") == "added").alias("later")), ["pair", "field", "later"])
        .groupBy("pair", "parent", "types", "s1", "s2", "held")
        .agg(F.array_sort(F.collect_list(F.when(~F.col("later"), F.col("field")))).alias("old"), F.array_sort(F.collect_list(F.when(F.col("later"), F.col("field")))).alias("new"))
        .where("size(old) > 0 and size(new) > 0")
    )

    @F.pandas_udf("array<struct<field:string,new_field:string>>")
    def matched(old, new):
        import pandas as pd

        return pd.Series([[{"field": a, "new_field": b} for a, b in match_names(list(x), list(y))] for x, y in zip(old, new)])

    return classes.select("pair", F.explode(matched("old", "new")).alias("m")).select("pair", "m.field", "m.new_field")


def name_similarity(a: str, b: str) -> float:
    """Share of common letter pairs of two field names, without case and punctuation (Dice)."""
    norm = lambda s: "".join(c for c in s.rpartition(".")[2].lower() if c.isalnum())
    a, b = norm(a), norm(b)
    if a == b:
        return 1.0
    x, y = {a[i : i + 2] for i in range(len(a) - 1)}, {b[i : i + 2] for i in range(len(b) - 1)}
    return 2 * len(x & y) / (len(x) + len(y)) if x and y else 0.0


def match_names(old: list[str], new: list[str]) -> list[tuple[str, str]]:
    """Maximum matching between two sets of names with the greatest total similarity (shortest augmenting paths)."""
    if len(old) == len(new) == 1:
        return [(old[0], new[0])]
    flip = len(old) > len(new)
    rows, cols = (new, old) if flip else (old, new)
    n, m = len(rows), len(cols)
    cost = np.array([[1.0 - name_similarity(r, c) + 1e-9 * j for j, c in enumerate(cols)] for r in rows])
    u, v, at, way = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, np.int64), np.zeros(m + 1, np.int64)
    for i in range(1, n + 1):
        at[0], j0 = i, 0
        least, used = np.full(m + 1, np.inf), np.zeros(m + 1, bool)
        while True:
            used[j0] = True
            i0 = at[j0]
            free = ~used
            free[0] = False
            c = cost[i0 - 1] - u[i0] - v[1:]
            nearer = free.copy()
            nearer[1:] &= c < least[1:]
            least[1:][nearer[1:]] = c[nearer[1:]]
            way[nearer] = j0
            j1 = int(np.where(free, least, np.inf).argmin())
            delta = least[j1]
            u[at[used]] += delta  # every used column belongs to a row of its own
            v[used] -= delta
            least[free] -= delta
            j0 = j1
            if at[j0] == 0:
                break
        while j0:
            at[j0], j0 = at[way[j0]], int(way[j0])
    pairs = [(rows[at[j] - 1], cols[j - 1]) for j in range(1, m + 1) if at[j]]
    return sorted((b, a) if flip else (a, b) for a, b in pairs)


def _depth_first(renames) -> list:
    return sorted(renames, key=lambda r: (r[1].count("."), r[1], r[2]))


def _linked(pairs) -> dict:
    """Each linked key with the least key of its class."""
    up: dict = {}

    def top(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for x, y in pairs:
        a, b = sorted((top(x), top(y)))
        up[b] = a
        up.setdefault(a, a)
    return {x: top(x) for x in up}


def _canonical(path: str, names: dict[tuple[str, str], tuple[str, str]]) -> str:
    """A path with every step under its canonical name, parents first."""
    out = ""
    for step in path.split("."):
        bare = step.removesuffix("[]")
        out += "." * bool(out) + names.get((out, bare), (out, bare))[1] + step[len(bare) :]
    return out


def canonical_names(renames) -> tuple[dict[tuple[str, str], tuple[str, str]], dict[str | None, list]]:
    """The classes of names that renames (stream, field, new_field) link, and the links of each stream.

    A name is a pair (canonical path of its parent, own name), so that a name below a renamed container meets the same
    name below the other; each maps to the first of its class in the alphabet.
    """
    pairs: list = []
    links: dict[str | None, list] = {}
    names: dict[tuple[str, str], tuple[str, str]] = {}
    depth = 0
    for stream, old, new in _depth_first(renames):
        if old.count(".") > depth:  # the parents' classes are complete
            depth, names = old.count("."), _linked(pairs)
        parent, _, a = old.rpartition(".")
        at = _canonical(parent, names) if parent else ""
        pair = (at, a), (at, new.rpartition(".")[2])
        pairs.append(pair)
        links.setdefault(stream, []).append(pair)
    return _linked(pairs), links


def _groups(objs: list, at: str, names: dict) -> dict[tuple[str, str], list[str]]:
    """The keys that objects at one path hold, by class."""
    out: dict[tuple[str, str], list[str]] = {}
    for k in dict.fromkeys(k for o in objs if o for k in o):
        out.setdefault(names.get((at, k), (at, k)), []).append(k)
    return out


def _side_by_side(objs: list, keys: list[str]) -> bool:
    return len(keys) > 1 and any(o and sum(k in o for k in keys) > 1 for o in objs)


def _below(values: list) -> tuple[list, list, list]:
    """For the values of one field: the objects, the arrays of objects and the other values, each with None elsewhere."""
    many = [isinstance(v, list) and any(isinstance(x, dict) for x in v) for v in values]
    return [v if isinstance(v, dict) else None for v in values], [v if m else None for v, m in zip(values, many)], [None if m or isinstance(v, dict) else v for v, m in zip(values, many)]


def _flat(arrays: list) -> list:
    return [x if isinstance(x, dict) else None for v in arrays if v is not None for x in v]


def clashes(obj: dict, names: dict) -> set[tuple[str, str]]:
    """The classes of which some object of a record holds two names."""
    found, stack = set(), [("", [obj])]
    while stack:
        at, objs = stack.pop()
        for name, keys in _groups(objs, at, names).items():
            if _side_by_side(objs, keys):
                found.add(name)
            inner, arrays, _ = _below([o[k] for o in objs if o for k in keys if k in o])
            path = f"{at}.{name[1]}" if at else name[1]
            stack += [(p, o) for p, o in ((path, inner), (path + "[]", _flat(arrays))) if any(x is not None for x in o)]
    return found


def unified_fields(obj: dict, names: dict, own: dict) -> dict[str, str]:
    """The canonical fields of a record with their JSON text.

    Below arrays of objects a field holds one position per element, null where the element lacks it. ``names`` finds
    the classes by path; ``own`` are those that hold in the record's stream and give the names. Where an object holds
    two names of a class, they keep their own.
    """
    out: dict[str, str] = {}
    stack = [("", "", [obj], ())]  # path to look up, path to show, objects there, lengths of the arrays around them
    while stack:
        at, shown, objs, sizes = stack.pop()
        for name, keys in _groups(objs, at, own).items():
            for ks in [[k] for k in keys] if (split := _side_by_side(objs, keys)) else [keys]:
                label = ks[0] if split else name[1]
                path = f"{shown}.{label}" if shown else label
                look = names.get((at, ks[0]), (at, ks[0]))[1]
                look = f"{at}.{look}" if at else look
                inner, arrays, plain = _below([next((o[k] for k in ks if k in o), None) if o else None for o in objs])
                plain = [[None if isinstance(x, dict) else x for x in v] if v and any(x is not None and not isinstance(x, dict) for x in v) else p for v, p in zip(arrays, plain)]
                if any(x is not None for x in plain):
                    out[path] = _text(_nested(plain, sizes))
                if any(x is not None for x in inner):
                    stack.append((look, path, inner, sizes))
                if any(x is not None for x in arrays):
                    stack.append((look + "[]", path + "[]", _flat(arrays), (*sizes, [None if v is None else len(v) for v in arrays])))
    return dict(sorted(out.items()))


def _nested(values: list, sizes: tuple):
    """Values side by side, put back into the arrays around them."""
    for lengths in reversed(sizes):
        rest = iter(values)
        values = [None if n is None else list(islice(rest, n)) for n in lengths]
    return values[0]


def unified_pages(
    pages: DataFrame,
    changes: DataFrame,
    *,
    file: str = "file_id",
    stream: str = "stream",
    payload: str = "payload",
    keep: tuple[str, ...] = ("record_id", "file_id", "stream", "report_no"),
    max_pairs: int = 100_000,
) -> DataFrame:
    """All readable records as one table: the kept columns and ``fields``, a map from canonical field to JSON text.

    Names that a rename links share one canonical name, the first in the alphabet, at every step of a path. A stream
    that holds two linked names in one object follows its own renames there only; where two names still meet in one
    object both are kept. Fields below arrays of objects hold a JSON list with one position per element (nested for
    arrays in arrays), null where it lacks the field; elements that aren't objects stand under the array's own path. A
    field that is null or missing throughout isn't in the map. Unreadable records are left out (they are counted by
    ``profile`` as nothing, too).

    The distinct renames and clashes by stream come to the driver; their number is bounded by the streams and the
    vocabulary of field names, not by the files, and more than max_pairs of either is an error.
    """
    files = pages.select(F.col(file).cast("long").alias("f"), F.col(stream).cast("string").alias("s")).distinct()
    renames = changes.where("change = 'renamed'").select(F.col(file).alias("f"), "field", "new_field").join(files, "f").select("s", "field", "new_field")
    names, links = canonical_names(map(tuple, _bounded(renames, max_pairs, "renames")))
    names_of: dict[str | None, dict] = {}
    if names:

        def meet(batches):
            for b in batches:
                found = {(s, *c) for s, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if (o := _parse(text)) is not None for c in clashes(o, names)}
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], pa.string()) for i in range(3)], names=["s", "at", "name"])

        met: dict[str | None, set] = {}
        for s, at, name in _bounded(map_arrow(pages.select(F.col(stream).cast("string"), payload), meet, "s string, at string, name string"), max_pairs, "clashes"):
            met.setdefault(s, set()).add((at, name))
        for s, classes in met.items():
            own = _linked([p for p in links.get(s, []) if names[p[0]] in classes])
            names_of[s] = {x: own.get(x, x) if c in classes else c for x, c in names.items()}

    def run(batches):
        for b in batches:
            cols = [b.column(i).to_pylist() for i in (-2, -1)]
            kept, maps = [], []
            for i, (s, text) in enumerate(zip(*cols)):
                if (o := _parse(text)) is None:
                    continue
                kept.append(i)
                maps.append(list(unified_fields(o, names, names_of.get(s, names)).items()))
            yield pa.RecordBatch.from_arrays([*[b.column(j).take(pa.array(kept, pa.int64())) for j in range(len(keep))], pa.array(maps, pa.map_(pa.string(), pa.string()))], names=[*keep, "fields"])

    src = pages.select(*keep, F.col(stream).cast("string").alias("stream of names"), F.col(payload))
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema if f.name in keep)
    return map_arrow(src, run, f"{types}, fields map<string,string>")


def _bounded(rows: DataFrame, limit: int, what: str) -> list:
    got = rows.distinct().limit(limit + 1).collect()
    if len(got) > limit:
        raise ValueError(f"more than {limit} distinct {what}")
    return got
