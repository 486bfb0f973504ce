import random

import pytest

from riskframe.llm import packing
from riskframe.llm.tokenizing import TOKENIZERS, count, encoder, sized


def fill_brute(space, counts):
    best = {0}
    for s, c in counts.items():
        for _ in range(c):
            best |= {b + s for b in best if b + s <= space}
    return max(best)


def test_closest_fill_against_brute_force():
    rng = random.Random(1)
    for _ in range(300):
        space = rng.randrange(1, 60)
        counts = {rng.randrange(1, 40): rng.randrange(1, 5) for _ in range(rng.randrange(0, 7))}
        used = packing.closest_fill(space, counts, sorted(counts, reverse=True))
        assert all(0 < k <= counts[s] for s, k in used.items())
        assert sum(s * k for s, k in used.items()) == fill_brute(space, counts)


def test_patterns_place_all_and_fit():
    rng = random.Random(2)
    counts = {rng.randrange(1, 257): rng.randrange(1, 2000) for _ in range(200)}
    pats = packing.patterns(counts, 256)
    placed = {}
    for times, fill in pats:
        assert sum(s * k for s, k in fill.items()) <= 256
        for s, k in fill.items():
            placed[s] = placed.get(s, 0) + times * k
    assert placed == counts
    containers, least = sum(t for t, _ in pats), -(-sum(s * c for s, c in counts.items()) // 256)
    # Items beyond half the capacity can't share a container with each other, which may ask for more than the sum does.
    least = max(least, sum(c for s, c in counts.items() if s > 128))
    assert containers <= least * 1.02 + 1


SPECS = "spec_no int, spec_name string, capacity_tokens int, tokens string"


def documents(spark, texts):
    return spark.createDataFrame([(i if i >= 0 else None, t, 1, 2) for i, t in texts], "doc_id long, text string, tokens int, bucket int")


def test_containers(spark):
    texts = [(i, "word " * (i % 13 + 1)) for i in range(400)] + [(1000, "x y " * 3000), (1001, None), (1002, ""), (1003, "  \n "), (-1, "no id"), (1004, "same"), (1005, "same"), (1006, "é" * 5000)]
    docs = documents(spark, texts)
    specs = spark.createDataFrame([(1, "a", 16, "t"), (2, "b", 100, "t"), (3, "bad", None, "t"), (4, "bad", 0, "t"), (None, "bad", 7, "t"), (2, "b", 100, "t")], SPECS)
    sizes = {r["doc_id"]: r["tokens"] for r in sized(docs, ["doc_id"]).collect()}
    rows = packing.packed(docs, specs).collect()
    assert {r["spec_no"] for r in rows} == {1, 2}
    for spec, cap in ((1, 16), (2, 100)):
        boxes, docs_ = {}, {}
        for r in (r for r in rows if r["spec_no"] == spec):
            docs_.setdefault(r["doc_id"], []).append((r["piece_no"], r["start_token"], r["tokens"]))
            if r["container_no"] is not None:
                boxes.setdefault(r["container_no"], []).append((r["container_offset"], r["tokens"]))
        assert sorted(boxes) == list(range(1, len(boxes) + 1))
        for items in boxes.values():
            at = 0
            for off, n in sorted(items):  # items stand side by side from 0
                assert off == at
                at += n
            assert at <= cap
        assert set(docs_) == set(sizes)
        for doc, pieces in docs_.items():
            assert sum(n for *_, n in pieces) == sizes[doc] and (len(pieces) == 1 or sizes[doc] > cap)
            at = 0
            for k, (no, start, n) in enumerate(sorted(pieces)):
                assert no == k and start == at
                at += n
    total = sum(sizes.values())
    got = {r["spec_no"]: r for r in packing.summary(packing.packed(docs, specs), specs).collect()}
    assert got[1]["tokens"] == total and got[1]["fill"] > 0.98 and got[2]["containers"] >= got[2]["least_containers"]


def test_hot_size_and_empty(spark):
    specs = spark.createDataFrame([(1, "a", 8, "t")], SPECS)
    rows = packing.packed(documents(spark, [(i, "a b c") for i in range(999)]), specs).collect()
    assert max(r["container_no"] for r in rows) == 500 and len({(r["container_no"], r["container_offset"]) for r in rows}) == 999
    assert packing.packed(documents(spark, []), specs).count() == 0
    assert packing.packed(documents(spark, [(1, "a")]), specs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        packing.packed(documents(spark, [(1, "a")]), spark.createDataFrame([(1, "a", 1 << 20, "t")], SPECS))


def test_tokens_of_long_texts():
    with open(f"{TOKENIZERS}/byte_bpe_50k.tiktoken", "rb") as f:
        enc = encoder(f.read())
    text = "The score of alpha-7 rose, and it's   fine.\n\n" * 3000
    assert count(enc, text) == len(enc.encode_ordinary(text)) and count(enc, None) == 0
    assert count(enc, "é" * 100_000) > 0


def test_long_texts_have_the_size_of_the_whole():
    import os

    from riskframe.llm import tokenizing as T

    path = f"{T.TOKENIZERS}/byte_bpe_50k.tiktoken"
    if not os.path.exists(path):
        return
    with open(path, "rb") as f:
        enc = T.encoder(f.read())
    rng = random.Random(2)
    blank_free = "".join(rng.choice("abcdefgh") for _ in range(25_000))
    mixed = "".join(rng.choice(["word", " ", "  ", "\n\n", "'s", "12", "?!", "é"]) for _ in range(40_000))
    for text in (blank_free, mixed, " " * 45_000, "x " * 30_000, blank_free + "   \n" + mixed):
        assert T.count(enc, text) == len(enc.encode_ordinary(text))


def test_many_lengths_at_the_largest_capacity():
    import time

    rng = random.Random(1)
    counts = {rng.randrange(1, (1 << 17) + 1): rng.randrange(1, 50) for _ in range(50_000)}
    began = time.time()
    pats = packing.patterns(counts, 1 << 17)
    placed: dict[int, int] = {}
    for times, fill in pats:
        assert sum(s * k for s, k in fill.items()) <= 1 << 17
        for s, k in fill.items():
            placed[s] = placed.get(s, 0) + times * k
    least = -(-sum(s * c for s, c in counts.items()) // (1 << 17))
    assert placed == counts and sum(t for t, _ in pats) < 1.01 * least and time.time() - began < 120
