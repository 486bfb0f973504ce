import numpy as np
import pytest

from riskframe.llm import mixing


def docs(spark, data):
    return spark.createDataFrame([(i, t, s, 1, 0.5) for i, t, s in data], "doc_id long, text string, source string, tokens int, p double")


def goals(spark, data):
    return spark.createDataFrame([(m, s, w, r, 1) for m, s, w, r in data], "mix_no int, source string, weight double, max_repeats int, copies int")


def corpus():
    out = [(i, "alpha apple " * (i % 9 + 1), "Big Source") for i in range(600)]
    out += [(1000 + i, "beta banana " * (i % 7 + 1), "small_one") for i in range(40)]
    out += [(2000 + i, "gamma grape " * 5, "other") for i in range(50)]
    out += [(3000 + i, "beta banana " * 3, None) for i in range(10)] + [(4000, None, "small-one"), (4001, "", None), (4002, "alpha " * 4000, "big-source")]
    return out


def test_shares_and_caps(spark):
    d = docs(spark, corpus())
    t = goals(spark, [(1, "big-source", 3.0, 1), (1, "SMALL ONE", 1.0, 3), (1, "nowhere", 1.0, 2), (2, "small-one", 1.0, None), (2, "big-source", None, 5), (2, None, 1.0, 1), (3, "nowhere", 1.0, 1)])
    chosen = mixing.mixed(d, t)
    got = chosen.collect()
    assert len({(r["mix_no"], r["doc_id"]) for r in got}) == len(got)
    assert max(r["copies"] for r in got if r["mix_no"] == 1 and r["source"] == "small-one") <= 3
    assert max(r["copies"] for r in got if r["source"] == "big-source") == 1
    assert {r["source"] for r in got} <= {"big-source", "small-one", None} and {r["mix_no"] for r in got} == {1, 2}
    sh = {(r["mix_no"], r["source"]): r for r in mixing.shares(chosen, t).collect()}
    # The documents of unknown source look like small-one's and count for it.
    big, small = sh[1, "big-source"]["tokens"], sh[1, "small-one"]["tokens"] + sh[1, "unknown"]["tokens"]
    assert abs(big / (big + small) - 0.75) < 0.01
    assert sh[1, "nowhere"]["tokens"] == 0 and abs(sh[1, "nowhere"]["target_share"] - 0.2) < 1e-9
    assert abs(sum(r["actual_share"] for (m, _), r in sh.items() if m == 1) - 1) < 1e-9


def test_classifier_learns_sources(spark):
    data = [(i, ("red wine glass " if i % 2 else "blue sea ship ") * 4, "a" if i % 2 else "b") for i in range(400)]
    logp, shares, temp = mixing.classifier(docs(spark, data), ["a", "b"], 512)
    post = lambda t: mixing.softmax((logp @ mixing.word_counts(t, 512) / temp + shares)[None])[0]
    assert post("wine and a glass")[0] > 0.9 and post("a ship at sea")[1] > 0.9


def fit_rows(spark, data):
    """(label, tokens, posterior over three sources) as the fit reads them."""
    pad = lambda x: [*x, *[0] * (mixing.TOP - len(x))]
    cols = ", ".join(["label int", "tokens long", *(f"{c} {'int' if c[0] == 'k' else 'float'}" for c in mixing._DOC)])
    return spark.createDataFrame([(label, tokens, *pad(list(range(len(p)))), *map(float, pad(p))) for label, tokens, p in data], cols)


def test_gradient_meets_goals(spark):
    # Two known sources and documents without source; the third source isn't in the mix.
    data = [(0, 100, [0.9, 0.1, 0.0])] * 6 + [(0, 100, [0.5, 0.5, 0.0])] * 6 + [(1, 50, [0.1, 0.9, 0.0])] * 10 + [(-1, 30, [0.5, 0.5, 0.0])] * 2 + [(-1, 30, [0.0, 0.1, 0.9])] + [(2, 70, [0.0, 0.0, 1.0])]
    goals, caps, available = np.array([300.0, 600.0, 0.0]), np.array([1.0, 2.0, 0.0]), np.array([1200.0, 500.0, 70.0])
    mix = mixing.Mix(goals, caps, available)
    slopes, expected, distance = mixing.fitted(fit_rows(spark, data), {1: mix}, 40, 1e-5)
    assert distance[1] < 0.002 and np.allclose(expected[1][0], goals, rtol=0.003)
    label = np.array([d[0] for d in data])
    k = np.tile(np.array([0, 1, 2, 0]), (len(data), 1))
    p = np.array([[*d[2], 0.0] for d in data])
    r, _, _, _, cap = mixing.rates(mix, slopes[1], label, k, p)
    assert (r >= 0).all() and (r <= cap).all() and cap[-1] == 0 and cap[-2] == 0 and set(cap[22:24]) == {1.0}
    # Documents of one label whose posteriors differ get different rates: those that resemble the scarcer domain more.
    soft = mixing.totals(mix, slopes[1], label, k, p, np.array([d[1] for d in data], float))[1]
    even = mixing.totals(mix, np.zeros((2, 3)), label, k, p, np.array([d[1] for d in data], float))[1]
    assert np.abs(soft - goals).sum() < np.abs(even - goals).sum() and abs(r[0] - r[6]) > 1e-4


def test_every_source_within_its_weight(spark):
    chosen = mixing.mixed(docs(spark, corpus()), goals(spark, [(1, "big-source", 3.0, 1), (1, "small one", 1.0, 3), (1, "other", 0.5, 2), (1, "nowhere", 1.0, 2)]))
    rows = mixing.shares(chosen, goals(spark, [(1, "big-source", 3.0, 1), (1, "small one", 1.0, 3), (1, "other", 0.5, 2), (1, "nowhere", 1.0, 2)])).collect()
    assert all(abs(r["gap"]) < 0.002 and r["converged"] for r in rows if r["gap"] is not None) and len([r for r in rows if r["gap"] is not None]) == 3


def test_empty(spark):
    t = goals(spark, [(1, "big-source", 3.0, 1)])
    assert mixing.mixed(docs(spark, []), t).count() == 0
    assert mixing.mixed(docs(spark, corpus()), t.limit(0)).count() == 0
    with pytest.raises(ValueError):
        mixing.mixed(docs(spark, corpus()), t, max_sources=1)


def test_all_sources_of_a_posterior_count(spark):
    # Documents without source that resemble six sources alike count for all six, not for the four most likely.
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta"]
    data = [(100 * s + i, f"{w} common " * 5, w) for s, w in enumerate(words) for i in range(60)]
    data += [(1000 + i, "common " * 5 + " ".join(words), None) for i in range(6)]
    t = goals(spark, [(1, w, 1.0, 1) for w in words] + [(2, "alpha", 1.0, 1), (2, "beta", 1.0, 1), (2, "gamma", 1.0, 1), (2, "delta", 1.0, 1)])
    got = mixing.mixed(docs(spark, data), t).where("source is null").collect()
    members = [r["member"] for r in got if r["mix_no"] == 1]
    assert members and all(set(m) == set(words) and abs(sum(m.values()) - 1) < 1e-9 and max(m.values()) < 0.25 for m in members)
    assert all(set(r["member"]) == set(words[:4]) for r in got if r["mix_no"] == 2)
