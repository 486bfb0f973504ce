"""Schema changes of the test pages against a plain pairwise search."""

import json
import os

import oracle
import pyarrow.parquet as pq
import pytest

from riskframe.operators.drift import schema_changes

SF = f"{oracle.DATA}/sf0.001"


def fields(obj, prefix=""):
    for k, v in obj.items():
        yield prefix + k, v
        for x in [v] if isinstance(v, dict) else v if isinstance(v, list) else []:
            if isinstance(x, dict):
                yield from fields(x, f"{prefix}{k}{'[]' if isinstance(v, list) else ''}.")


def kind(v):
    return {bool: "boolean", str: "string", dict: "object", list: "array"}.get(type(v), "number")


def search(rows):
    streams, held = {}, {}
    for r in rows:
        streams.setdefault(r["stream"], {})[r["file_id"]] = r["produced_at"]
        try:
            obj = json.loads(r["payload"] or "")
        except ValueError:
            continue
        if isinstance(obj, dict):
            values = {}
            for p, v in fields(obj):
                values.setdefault(p, []).append(json.dumps(v, sort_keys=True))
            held.setdefault(r["file_id"], []).append((r["report_no"], obj, values))
    out = set()
    for files in streams.values():
        order = sorted(files, key=lambda f: (files[f], f))
        for old, new in zip(order, order[1:]):
            types = []
            for f in (old, new):
                t = {}
                for _, obj, _ in held.get(f, []):
                    for p, v in fields(obj):
                        t.setdefault(p, set()).update([] if v is None else [kind(v)])
                types.append(t)
            a, b = types
            changed = {p for p in a.keys() | b.keys() if a.get(p) != b.get(p)}
            ups = lambda p: {".".join(p.split(".")[:i]).removesuffix("[]") for i in range(1, p.count(".") + 1)}
            top = {p for p in changed if not ups(p) & changed}
            by_report = [{}, {}]
            for side, f in enumerate((old, new)):
                for no, _, values in held.get(f, []):
                    by_report[side].setdefault(no, []).append(values)
            shared = by_report[0].keys() & by_report[1].keys()
            gone, fresh = sorted(p for p in top if p not in b), sorted(p for p in top if p not in a)
            at = lambda side, no, p: {json.dumps(v.get(p)) if any(x != "null" for x in v.get(p, [])) else None for v in by_report[side][no]}
            for p in gone:
                twins = [q for q in fresh if q.rpartition(".")[0] == p.rpartition(".")[0] and a[p] == b[q] and all(at(0, n, p) == at(1, n, q) for n in shared) and any(at(0, n, p) != {None} for n in shared)]
                assert len(twins) <= 1, "the test pages hold no ambiguous renames"
                if twins:
                    fresh.remove(twins[0])
                    out.add((new, "renamed", p, twins[0]))
                else:
                    out.add((new, "removed", p, ""))
            out |= {(new, "added", q, "") for q in fresh} | {(new, "type", p, "") for p in top if p in a and p in b}
    return out


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_against_search(spark):
    rows = pq.read_table(f"{SF}/report_pages.parquet").to_pylist()
    got = [tuple(r) for r in schema_changes(spark.read.parquet(f"{SF}/report_pages.parquet")).collect()]
    assert len(got) == len(set(got)) and set(got) == search(rows) and len(got) > 0
