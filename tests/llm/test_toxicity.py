import datetime as dt
import random

import numpy as np

from riskframe.llm import toxicity as T


def test_tokens_in_one_spelling():
    same = ["you are STUPID", "you are stuuuupid", "you are s.t.u.p.i.d", "you are s t u p i d", "you are st​upid", "you are ѕtuріd", "you are $tup1d", "you are stúpid"]
    assert {tuple(T.tokens(s)) for s in same} == {("you", "are", "stupid")}
    assert T.tokens("const YouAreStupid = true; see src/a/b.go") == ["const", "you", "are", "stupid", "true", "se"]
    assert T.tokens("what a st***d idea") == ["what", "a", "st*d", "idea"] and T.features(["st*d"], T.pairs(["st*d"])) == {"st*d", "^ st*d", "<masked>"}
    assert T.tokens(None) == [] and T.tokens(" \n") == []


def test_tokens_masked_to_the_end():
    assert T.tokens("you i****, such a bi*** and a n##!") == ["you", "i*", "such", "a", "bi*", "and", "a", "n*"]
    assert T.tokens("**you** are ***an* i***** in C# **bold text** (f(**a, **b)) end*") == ["you", "are", "an", "i*", "in", "c", "bold", "text", "f", "a", "b", "end"]
    assert T.tokens("**i****") == ["i*"] and "<masked>" in T.features(["i*"], [])


def test_tokens_with_more_signs_than_letters():
    assert T.tokens("b4$74rd p47h371c 1d10t B4$74RD, l0$3r 7w47") == ["bastard", "pathetic", "idiot", "bastard", "loser", "twat"]
    assert T.tokens("37s 100ms 1h30m v100 1.0.0-rc1 1e10 100x100 2026-01-15t10 0x1000 1001") == ["s", "ms", "h", "m", "v", "rc", "e", "x", "t", "x"]


def test_segments():
    rng = random.Random(4)
    for _ in range(200):
        s = [rng.choice([-2, -1, 1, 3]) for _ in range(rng.randrange(0, 25))]
        best = max([0] + [sum(s[i:j]) for i in range(len(s)) for j in range(i + 1, len(s) + 1)])
        segs = T.segments(s)
        assert max([0] + [x for x, *_ in segs]) == best == T.best_segment(np.array(s, float))[0]
        ends = [(a, b) for _, a, b in segs]
        assert all(b <= c for (_, b), (c, _) in zip(ends, ends[1:])) and all(sum(s[a:b]) == x for x, a, b in segs)
    # The best segment, and the same again on what lies left and right of it, are the maximal ones.
    def halves(s, off):
        x, a, b = T.best_segment(np.array(s, float))
        return [] if x <= 0 else halves(s[:a], off) + [(x, a + off, b + off)] + halves(s[b:], off + b)

    for _ in range(100):
        s = [rng.uniform(-2, 2) for _ in range(30)]
        assert [(round(x, 6), a, b) for x, a, b in T.segments(s)] == [(round(x, 6), a, b) for x, a, b in halves(s, 0)]


def test_many_candidates_take_linear_time():
    import time

    s = [1, -2] * 200_000
    began = time.time()
    assert len(T.segments(s)) == 200_000 and time.time() - began < 10


def test_votes():
    p = T.votes_to_posterior({(1, 0): 400, (2, 0): 400, (3, 0): 200, (1, 1): 90, (2, 2): 70, (3, 3): 40, (2, 1): 60, (3, 1): 30, (3, 2): 25})
    assert p[3, 3] > p[2, 2] > 0.9 and p[3, 0] < 0.02 and p[3, 2] > 0.5 > p[3, 1]


BENIGN = ["the {0} loader takes {1} seconds", "please split {0} before we add a branch", "coverage of {0} fell to {1} percent", "this is a stupid bug in {0} sorry", "el modulo {0} no tiene ruta"]
TOXIC = ["you are a worthless {2} and everybody knows", "whoever wrote {0} is a {2}", "shut up {2} nobody asked you"]
NAMES, INSULTS = ["parser", "ledger", "anchor", "basket", "signal"], ["moron", "idiot", "clown"]


def corpus(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        bad = rng.random() < 0.2
        parts = [rng.choice(BENIGN) for _ in range(rng.randrange(1, 5))]
        if bad:
            w = rng.choice(TOXIC)
            parts.insert(rng.randrange(len(parts) + 1), w.upper().replace("{0}".upper(), "{0}") if rng.random() < 0.2 else w)
        text = ". ".join(p.format(rng.choice(NAMES), rng.randrange(99), rng.choice(INSULTS)) for p in parts)
        out.append((i, text, rng.choice(["A src", "a_src", "b", None]), bad))
    return out


def test_held_out_accuracy_and_edges(spark):
    rng = random.Random(9)
    rows = corpus(1500, 8)
    docs = [(i, t, s, 0.1, "x") for i, t, s, _ in rows] + [(5000, None, "b", 0.1, "x"), (5001, " ", "b", 0.1, "x"), (5002, "the parser loader takes 9 seconds. " * 3000 + rows[0][1], "b", 0.1, "x"), (None, "no id", None, 0.1, "x")]
    labels = []
    for i, _, _, bad in rows[:700]:
        for rater in range(rng.randrange(1, 4)):
            v = int(bad) if rng.random() > 0.07 else int(not bad)
            labels += [(i, rater, v, dt.datetime(2026, 1, 1), "y")] * rng.choice([1, 1, 2])
    labels += [(3, 0, None, dt.datetime(2026, 1, 2), "y"), (None, 1, 1, dt.datetime(2026, 1, 1), "y")]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string, p double, words string")
    lab = spark.createDataFrame(labels, "doc_id long, rater_no int, toxic int, labelled_at timestamp_ntz, p string")
    got = {r["doc_id"]: r for r in T.scores(d, lab).collect()}
    assert len(got) == len(docs)
    held = rows[700:]
    tp = sum(got[i]["toxic"] for i, _, _, bad in held if bad)
    fp = sum(got[i]["toxic"] for i, _, _, bad in held if not bad)
    fn = sum(not got[i]["toxic"] for i, _, _, bad in held if bad)
    assert 2 * tp / (2 * tp + fp + fn) > 0.95
    assert got[5000]["score"] is None and not got[5000]["toxic"] and not got[5001]["toxic"]
    assert any(r["toxic"] and r["passages"] for r in got.values())
    r = {x["source"]: x for x in T.rates(T.scores(d, lab)).collect()}
    assert set(r) == {"a-src", "b", "unknown"} and sum(x["documents"] for x in r.values()) == len(docs)


def test_empty(spark):
    d = spark.createDataFrame([], "doc_id long, text string, source string")
    lab = spark.createDataFrame([], "doc_id long, rater_no int, toxic int, labelled_at timestamp_ntz")
    assert T.scores(d, lab).count() == 0
    some = spark.createDataFrame([(1, "you are a moron", "s")], "doc_id long, text string, source string")
    assert [r["toxic"] for r in T.scores(some, lab).collect()] == [False]


def test_all_documents_enter_the_fit(spark, monkeypatch):
    # More documents, with votes and without, than a sample once held; one word is in each of them.
    every, bad, good = T.number("common"), T.number("moron"), T.number("parser")
    docs = spark.range(205_000).selectExpr("id doc_id", "case when id < 52000 then if(id % 4 = 0, 0.95D, 0.05D) end p", f"array({every}L, if(id % 4 = 0, {bad}L, {good}L)) words")
    seen, table = [], T._table

    def spy(counts, *rest):
        seen.append({r["feature"]: r["pos"] + r["neg"] for r in counts.where(f"feature in ({every}, {bad}, {good})").collect()})
        return table(counts, *rest)

    monkeypatch.setattr(T, "_table", spy)
    found, raw = T.fit(docs, rounds=1)
    for n, got in zip((52_000, 205_000), seen, strict=True):
        assert np.allclose([got[every], got[bad], got[good]], [n, n / 4, n * 3 / 4])
    assert found.get(np.array([bad]))[0] > 0 > found.get(np.array([good]))[0] and np.isfinite(raw)
