"""The passes over word numbers against plain Python: pieces from memory, the table, segments and features."""

import random

import numpy as np
import pyarrow as pa

from riskframe.llm import toxicity as T

PIECES = ["a", "I", "s", "t.", "u", "-p", "i.d", "you", "st***d", "**bold**", "**bo", "ld**", "x_y", "C#", "d'un", "src/a/b.go", "aB", "cD", "ѕtuріd", "b4$74rd", "37s", "é", "é", "1", "...", "y", "a", "HTTPServer", "n**", "q.w.e.r"]


def test_pieces_from_memory_equal_whole_texts():
    rng = random.Random(3)
    for _ in range(4000):
        text = "".join(rng.choice(PIECES) + rng.choice([" ", " ", "  ", "\n", " ", "\t"]) for _ in range(rng.randrange(0, 12)))
        assert T.tokens_by(text, str) == T.tokens(text), repr(text)
    assert T.tokens_by("s t u p i d", str) == ["stupid"] and T.tokens_by(None) == [] and T.tokens_by(" ") == []


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(T._Chunks, "SIZE", 10)
    memory = T._Chunks(str)
    assert [memory[f"w{i}x"] for i in range(100)] and len(memory) <= 10


def test_table():
    rng = np.random.default_rng(1)
    keys = rng.choice(1 << 40, 5000, replace=False) + 2
    values = rng.normal(size=5000)
    t = T.Table(keys, values)
    assert np.array_equal(t.get(keys), values)
    assert not t.get(np.arange(5000) + (1 << 41)).any() and not T.Table(keys[:0], values[:0]).get(keys).any()


def batch(docs):
    column = pa.array([[T.number(w) for w in d] if d is not None else None for d in docs], pa.list_(pa.int64()))
    return list(T.word_batches(column))


def test_segments_and_features_by_whole_batches(monkeypatch):
    monkeypatch.setattr(T, "_MOST_WORDS", 60)
    rng = random.Random(7)
    vocabulary = ["a", "b", "st*d", "c", "d*"]
    docs = [[rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 5, 30, 90]))] for _ in range(80)] + [None]
    seen = 0
    for at, n, w in batch(docs):
        assert n == 1 or len(w.words) <= 60
        s = np.array([rng.choice([-2.0, -1.0, 1.0, 3.0]) for _ in w.words])
        score, start, end = T.best_segments(s, w)
        f, d = T.held(w)
        for i in range(n):
            own = s[w.starts[i] : w.starts[i] + w.sizes[i]]
            best = T.best_segment(own)
            assert (score[i], start[i] - w.starts[i] if score[i] else 0, end[i] - w.starts[i] if score[i] else 0) == best
            words = docs[at + i] or []
            assert len(set(f[d == i])) == (d == i).sum() == len(T.features(words, T.pairs(words)))
            seen += 1
    assert seen == len(docs)
