import datetime as dt

from riskframe.llm.unparsable import checked, rates

SCHEMA = "file_id long, repository string, path string, language string, content binary, fetched_at timestamp_ntz, loaded_at timestamp_ntz, code string, errors int"


def files(spark, data):
    t = lambda h: dt.datetime(2026, 1, 1, h)
    return spark.createDataFrame([(i, "r", p, "x", None if c is None else bytearray(c), t(f), t(ld), "c", 1) for i, p, c, f, ld in data], SCHEMA)


def test_last_version_counts(spark):
    big = b"package a\n" + b"var x = 1\n" * 20_000
    df = files(
        spark,
        [
            (1, "a.go", b"package a\nfunc (", 1, 1), (1, "a.go", b"package a\n", 2, 1), (1, "a.go", b"package a\n", 2, 1),
            (2, "b.TS", b"let x = ;", 3, 1), (2, "b.TS", b"let x = 1", 2, 9), (2, "b.TS", None, 5, 5),
            (3, "c.rs", b"fn f() {}", 1, 1), (3, "c.rs", b"fn f() {", 1, 2), (4, "d.py", b"(((", 1, 1), (5, "e.cs", b"", 1, 1), (6, "f.go", b"", 1, 1), (None, "g.go", b"x", 1, 1), (7, None, b"x", 1, 1), (8, "h.go", big, 1, 1),
        ],
    )
    got = {r["file_id"]: r for r in checked(df).collect()}
    assert {i: r["parsed"] for i, r in got.items()} == {1: True, 2: False, 3: False, 5: True, 6: False, 8: True}
    assert (got[2]["code"], got[2]["line"], got[2]["column"]) == ("unexpected-token", 1, 9)
    r = {x["language"]: (x["files"], x["failed"]) for x in rates(checked(df)).collect()}
    assert r == {"go": (3, 1), "typescript": (1, 1), "rust": (1, 1), "csharp": (1, 0)}


def test_all_errors_are_kept(spark):
    df = files(spark, [(1, "a.go", b"package a\nfunc f() {\n\tx = )\n\ty = )\n}\n", 1, 1)])
    assert [e["line"] for e in checked(df).first()["errors"]] == [3, 4]


def test_empty(spark):
    assert checked(files(spark, [])).count() == 0 and rates(checked(files(spark, []))).count() == 0
