"""Snapshot changes, hierarchies, schema drift: edge cases and brute force."""

import json
import random

from riskframe.operators.drift import match_names, name_similarity, schema_changes, unified_pages
from riskframe.operators.hierarchy import declared_tree, descendants, hierarchy
from riskframe.operators.snapshots import method_result_changes

SNAP = "repository string, snapshot_no int, delivered_at timestamp_ntz, id string, signature string, risk double, scope string, `row` int, version string"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def snap(spark, data):
    import datetime as dt

    return spark.createDataFrame([(r, n, dt.datetime(2026, 1, 1, t), i, s, x, "clash", 1, "v") for r, n, t, i, s, x in data], SNAP)


def manifest(spark, pairs):
    return spark.createDataFrame(pairs, "repository string, snapshot_no int")


def test_snapshot_changes(spark):
    df = snap(
        spark,
        [
            ("r", 1, 1, " A ", "f( x )", 1.0), ("r", 3, 1, "a", "f( x\t\n )", 1.009), ("r", 4, 1, "a", "f( x )", 1.019),
            ("r", 1, 1, "b", None, None), ("r", 3, 1, "B", None, None), ("r", 4, 1, "b", "g", None),
            ("r", 1, 1, "c", "s", 2.0), ("r", 4, 1, "c", "s", 2.0),
            ("r", 1, 1, "d", "s", 2.0), ("r", 1, 2, "D", "s", 3.0), ("r", 3, 1, "d", "s", 3.0), ("r", 3, 1, "d", "s", 3.0), ("r", 4, 1, "d", "s", float("nan")),
            ("r", 1, 1, None, "s", 2.0), ("r", 1, 1, "  ", "s", 2.0), ("r", 9, 1, "x", "s", 2.0), (None, 1, 1, "y", "s", 1.0), ("q", 1, 1, "z", "s", 1.0),
        ],
    )
    got = rows(method_result_changes(df, manifest(spark, [("r", 1), ("r", 3), ("r", 4), ("r", 4), ("q", 1), ("q", 2)])))
    assert got == sorted(
        [
            ("r", 4, "a", "changed", ["risk"]), ("r", 4, "b", "changed", ["signature"]), ("r", 3, "c", "removed", []), ("r", 4, "c", "added", []),
            ("r", 4, "d", "changed", ["risk"]), ("q", 2, "z", "removed", []),
        ],
        key=repr,
    )


def test_snapshot_changes_empty(spark):
    assert rows(method_result_changes(snap(spark, []), manifest(spark, []))) == []


EDGE = "from_id string, to_id string, type string, path string, n string, depth int"


def edges(spark, pairs, kind="contains"):
    return spark.createDataFrame([(a, b, kind, "clash", "n", 1) for a, b in pairs], EDGE)


def brute(pairs):
    """(root, depth) of every node by search: the smallest (depth, root) over all ways up; '' and -1 with a cycle above."""
    up = {}
    for a, b in pairs:
        if a is not None and b is not None:
            up.setdefault(b, set()).add(a)
            up.setdefault(a, set())
    out = {}
    for n in up:
        seen, stack = set(), [n]
        while stack:
            for p in up[stack.pop()]:
                if p not in seen:
                    seen.add(p)
                    stack.append(p)
        loops = {x for x in seen | {n} if x in reach(up, x)}
        if loops:
            out[n] = ("", -1)
            continue
        level, d = {n}, 0
        best = None
        while level and best is None:
            tops = [x for x in level if not up[x]]
            best = (min(tops), d) if tops else None
            level, d = {p for x in level for p in up[x]}, d + 1
        out[n] = best
    return out


def reach(up, x):
    seen, stack = set(), [x]
    while stack:
        for p in up[stack.pop()]:
            if p not in seen:
                seen.add(p)
                stack.append(p)
    return seen


def test_hierarchy_against_search(spark):
    rng = random.Random(5)
    pairs = [(f"n{rng.randrange(60)}", f"n{i}") for i in range(60) if rng.random() < 0.8]
    pairs += [(f"c{i}", f"c{i + 1}") for i in range(40)] + [("c40", "tail"), ("x", "y"), ("y", "x"), ("y", "under"), ("self", "self"), ("top", "self2"), ("self2", "self2")]
    pairs += [("p1", "kid"), ("p2", "kid"), ("g", "p2"), ("kid", "leaf"), ("leaf", "low"), ("p1", "low"), (None, "a"), ("a", None), ("x", "y")]
    want = brute(pairs)
    for paths in (False, True):
        tree = hierarchy(edges(spark, pairs), parent="from_id", child="to_id", paths=paths)
        got = {r["node_id"]: (r["root_id"], r["depth"]) for r in tree.collect()}
        assert got == want
    for r in tree.collect():
        if r["cyclic"]:
            assert r["path"] is None
        else:
            assert r["path"][0] == r["root_id"] and r["path"][-1] == r["node_id"] and len(r["path"]) == r["depth"] + 1
    d = {(r[0], r[1]): r[2] for r in descendants(tree).collect()}
    assert d["c0", "tail"] == 41 and d["kid", "leaf"] == 1 and ("x", "y") not in d


def test_hierarchy_of_many_forks_in_few_rounds(spark, monkeypatch):
    from riskframe import runtime

    writes, path = [], runtime.Scratch.path
    monkeypatch.setattr(runtime.Scratch, "path", lambda self: writes.append(1) or path(self))
    diamonds = [p for i in range(1000) for p in ((f"j{i}", f"a{i}"), (f"j{i}", f"b{i}"), (f"a{i}", f"j{i + 1}"), (f"b{i}", f"j{i + 1}"))]
    got = {r["node_id"]: (r["root_id"], r["depth"]) for r in hierarchy(edges(spark, diamonds), parent="from_id", child="to_id", paths=False).collect()}
    assert got["j1000"] == ("j0", 2000) and got["a7"] == ("j0", 15) and len(writes) < 45
    rng = random.Random(3)
    ladder = [(f"{y}{i:02d}", f"{x}{i + 1:02d}") for i in range(40) for x in "abc" for y in rng.sample("abc", 2)] + [("z1", "z2"), ("z2", "z1"), ("z2", "f"), ("c19", "f"), ("f", "g")]
    tree = hierarchy(edges(spark, ladder), parent="from_id", child="to_id")
    assert {r["node_id"]: (r["root_id"], r["depth"]) for r in tree.collect()} == brute(ladder)


def test_hierarchy_types_and_empty(spark):
    df = edges(spark, [("a" * 64, "b" * 64)], " \tDeclares\n").unionByName(edges(spark, [("q", "r")], "imports")).unionByName(edges(spark, [("q", "r")], None))
    assert rows(declared_tree(df, paths=False).select("node_id", "root_id", "depth")) == [("a" * 64, "a" * 64, 0), ("b" * 64, "a" * 64, 1)]
    assert rows(declared_tree(edges(spark, []))) == []


PAGE = "record_id long, file_id long, stream string, produced_at timestamp_ntz, report_no long, payload string, field string, change string, pair long"


def pages(spark, data):
    import datetime as dt

    return spark.createDataFrame([(i, f, s, dt.datetime(2026, 1, t), r, p if p is None or isinstance(p, str) else json.dumps(p), "c", "c", 0) for i, (f, s, t, r, p) in enumerate(data)], PAGE)


def test_schema_changes(spark):
    df = pages(
        spark,
        [
            (1, "s", 1, 10, {"a": 1, "o": {"x": "1", "keep": 0}, "m": [{"old": 5, "k": "a"}, {"old": 6, "k": "b"}], "gone": True, "t": 1}),
            (1, "s", 1, 11, {"a": 2, "o": {"x": "2", "keep": 0}, "m": [], "t": None}),
            (1, "s", 1, 12, '{"a": 1'),
            (2, "s", 2, 11, {"b": 2.0, "o": {"y": "2", "keep": 0}, "m": [], "t": "now"}),
            (2, "s", 2, 12, {"b": 3, "o": {"y": "3", "keep": 0}, "m": [{"new": 5, "k": "a"}], "t": "now", "extra": {"deep": {"er": 1}}}),
            (2, "s", 2, 12, {"b": 3, "o": {"y": "3", "keep": 0}, "m": [{"new": 5, "k": "a"}], "t": "now", "extra": {"deep": {"er": 1}}}),
            (2, "s", 2, 13, None), (2, "s", 2, 14, "null,"), (2, "s", 2, 15, "[1]"),
            (9, "other", 1, 1, {"z": 1}), (None, "s", 1, 1, {"z": 1}), (3, None, 1, None, {"z": 1}), (4, None, 2, None, {"w": 1}),
        ],
    )
    got = rows(schema_changes(df))
    assert got == sorted(
        [
            (2, "renamed", "a", "b"), (2, "renamed", "o.x", "o.y"), (2, "removed", "m[].old", ""), (2, "added", "m[].new", ""), (2, "removed", "gone", ""), (2, "type", "t", ""), (2, "added", "extra", ""),
            (4, "added", "w", ""), (4, "removed", "z", ""),
        ],
        key=repr,
    )
    unified = {r["record_id"]: r["fields"] for r in unified_pages(df, schema_changes(df)).collect()}
    assert unified[0]["a"] == "1" and unified[3]["a"] == "2" and "b" not in unified[3] and 2 not in unified


def unified(spark, data):
    df = pages(spark, data)
    return {r["record_id"]: r["fields"] for r in unified_pages(df, schema_changes(df)).collect()}


def test_unified_pages_below_renamed_containers(spark):
    got = unified(
        spark,
        [
            (1, "s", 1, 1, {"cov": {"format": "x", "at": "p"}, "ms": [{"id": 1}, {"id": 2}]}),
            (2, "s", 2, 1, {"covSource": {"format": "x", "at": "p"}, "msList": [{"id": 1}, {"id": 2}]}),
            (3, "s", 3, 1, {"covSource": {"fmt": "x", "at": "p"}, "msList": [{"key": 1}, {"key": 2}]}),
            (4, "t", 1, 9, {"covSource": {"fmt": "y"}}),
            (5, "u", 1, 8, {"cov": {"fmt": "y"}, "covSource": {"format": "z"}}),
            (6, "u", 2, 7, {"covSource": {"format": "z"}}),
        ],
    )
    assert got[0] == got[1] == got[2] == {"cov.at": '"p"', "cov.fmt": '"x"', "ms[].id": "[1,2]"}
    assert got[3] == {"cov.fmt": '"y"'}
    # A stream that holds both names without renaming them keeps them apart, in all its records.
    assert got[4] == {"cov.fmt": '"y"', "covSource.fmt": '"z"'} and got[5] == {"covSource.fmt": '"z"'}


def test_unified_pages_keep_both_of_two_names_in_one_record(spark):
    got = unified(spark, [(1, "s", 1, 1, {"a": 1}), (2, "s", 2, 1, {"b": 1}), (3, "s", 3, 1, {"b": 1, "a": 7}), (4, "s", 4, 1, {"b": 1})])
    assert got == {0: {"a": "1"}, 1: {"a": "1"}, 2: {"a": "7", "b": "1"}, 3: {"a": "1"}}


def test_unified_pages_keep_positions_of_array_elements(spark):
    a = {"ms": [{"id": 1, "c": 5}, {"id": 2, "c": None}, {"id": 3, "p": {"n": 4}, "t": ["x"]}], "e": [], "x": [1, {"y": 2}]}
    b = {"ms": [{"id": 1, "s": [{"v": 1}, {"w": 2}]}, {"id": 2}, {"s": [{"v": 3}]}, {"s": []}, None]}
    got = unified(spark, [(1, "s", 1, 1, a), (1, "s", 1, 2, b)])
    assert got[0] == {"ms[].id": "[1,2,3]", "ms[].c": "[5,null,null]", "ms[].p.n": "[null,null,4]", "ms[].t": '[null,null,["x"]]', "e": "[]", "x": "[1,null]", "x[].y": "[null,2]"}
    assert got[1] == {"ms[].id": "[1,2,null,null,null]", "ms[].s": "[null,null,null,[],null]", "ms[].s[].v": "[[1,null],null,[3],null,null]", "ms[].s[].w": "[[null,2],null,[null],null,null]"}


def test_schema_changes_case_only_and_ambiguous_names(spark):
    df = pages(spark, [(1, "s", 1, 1, {"risk": 1, "first_name": "x", "last_name": "x"}), (2, "s", 2, 1, {"RISK": 1, "firstName": "x", "lastName": "x"})])
    assert rows(schema_changes(df)) == [(2, "renamed", "first_name", "firstName"), (2, "renamed", "last_name", "lastName"), (2, "renamed", "risk", "RISK")]
    assert rows(schema_changes(pages(spark, []))) == []


def test_match_names():
    assert name_similarity("a.first_name", "a.firstName") == 1.0
    assert match_names(["b", "a"], ["x"]) in ([("b", "x")], [("a", "x")])
    assert match_names(["minScore", "score"], ["Score", "min_score", "zz"]) == [("minScore", "min_score"), ("score", "Score")]
