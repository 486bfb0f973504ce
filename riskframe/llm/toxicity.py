"""Abusive, hateful or sexual passages: maximum-scoring segments over token log-odds, calibrated by extreme values."""

from __future__ import annotations

import hashlib
import math
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass, replace
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.runtime import Scratch, map_arrow

# Letters that look like Latin ones, and signs that stand for letters inside a word.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "е": "e", "ё": "e", "һ": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o",
    "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ɡ": "g", "ո": "n", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i",
    "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ı": "i", "ł": "l", "ø": "o",
}
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "€": "e"}

_ALIKE = str.maketrans(LOOKALIKES)
_SIGN = str.maketrans(SIGNS)
_PATHS = re.compile(r"(?:[\w.-]+/)+[\w.-]+")
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])")
_SPELLED = re.compile(r"(?<![^\W\d_])(?:[^\W\d_][.\-_*·|+~ ]{1,2}){3,}[^\W\d_](?![^\W\d_])")
_EMPHASIS = re.compile(r"(?<![\w*])(\*{2,3})(?=[^\s*])((?:[^*\n]|\*(?!\*))*)(?<=[^\s*])\1(?![\w*])")
_WORD = re.compile(r"[^\W_](?:[\w@$!€*#'’.\-]*[^\W_])?(?:[*#]{2,})?|[@$][^\W_][\w@$!]*")
_PART = re.compile(r"[.'’*#_\-]+")
_LEET = re.compile(r"(?=.*[^\W\d_])(?:[^\W\d_]|[%s])+" % re.escape("".join(SIGNS)))
_NUMBER = re.compile(r"\d+[a-z]{1,3}|(?:\d+(?:ms|[dhmsw]))+|(?:v|rc)\d+|\d+[etx]\d+|0x[\da-f]+")  # 37s, 1h30m, v1, 1e10, 10x10
_RUN = re.compile(r"(.)\1+")
_MASK = re.compile(r"[*#·•]+")
_GAP = re.compile(r"[\W\d_]+")


def _plain(text: str) -> str:
    """Lower-case letters without marks and look-alikes; emphasis and paths are gone, joined humps are apart."""
    t = "".join(c for c in text if not unicodedata.category(c) == "Cf") if not text.isascii() else text
    t = unicodedata.normalize("NFKC", t) if not t.isascii() else t
    t = _EMPHASIS.sub(r"\2", t)
    t = _PATHS.sub(" ", t)
    t = _HUMP.sub(" ", t).lower()
    if not t.isascii():
        t = unicodedata.normalize("NFKD", t.translate(_ALIKE))
        t = "".join(c for c in t if not unicodedata.combining(c))
    return t


def tokens(text: str | None) -> list[str]:
    """Words of a text in one spelling: without marks, look-alikes, stretched letters, letter spacing and joined humps.

    Signs that look like letters are read as letters wherever a word mixes the two, except in numbers with units and versions.
    A word with masked letters, inside or (two signs or more) at the end, gives its mask, such as p*e or p*, which counts
    as a word of its own.
    """
    if not text:
        return []
    t = _plain(text)
    t = _SPELLED.sub(lambda m: "".join(c for c in m[0] if c.isalpha()), t)
    out = []
    for w in _WORD.findall(t):
        if w.isalpha():
            out.append(_RUN.sub(r"\1", w))
            continue
        if w.isdigit():
            continue
        masked = _MASK.sub("*", w)
        if "*" in masked:
            out.append(masked)
            continue
        letters = sum(c.isalpha() for c in w)
        if letters * 2 >= len(w):
            w = w.translate(_SIGN)
        else:
            w = " ".join(p.translate(_SIGN) if _LEET.fullmatch(p) and not _NUMBER.fullmatch(p) else p for p in _PART.split(w))
        for part in _GAP.split(w):
            if part:
                out.append(_RUN.sub(r"\1", part))
    return out


def pairs(words: list[str]) -> list[str]:
    """Each word with the word before it, '^' before the first."""
    return [a + " " + b for a, b in zip(["^", *words], words)]


def features(words: list[str], twos: list[str]) -> set[str]:
    """What a passage holds, in plain text: its words, their pairs with the word before, and the mask class. The passes
    over the corpus use the same features by number (``numbered``)."""
    out = {*words, *twos}
    if any("*" in w for w in words):
        out.add("<masked>")
    return out


#: Features have numbers of 49 bits: a hash with the lowest bit set for masked words. Pairs mix two word numbers.
_BITS = 49
_MASKED = 1
_ONE, _TWO = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def number(word: str) -> int:
    """The number of a word: a hash whose lowest bit tells whether letters are masked; never 0 or 1."""
    h = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") >> (64 - _BITS)
    return (h | 2) & ~1 | ("*" in word)


def pair_numbers(before: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The numbers of pairs of words (0 stands before the first); even and never 0."""
    x = before.astype(np.uint64) * _ONE + words.astype(np.uint64)
    x = (x ^ (x >> np.uint64(29))) * _TWO
    return ((x >> np.uint64(64 - _BITS)) | np.uint64(2)).astype(np.int64) & ~1


class _Chunks(dict):
    """The words of each blank-free piece of text, and whether a word spelled in single letters may run on across its ends.

    Pure memory of ``tokens``: emptied when it has grown to its size, without any effect on results.
    """

    SIZE = 300_000

    def __init__(self, make):
        super().__init__()
        self.make, self.edges = make, {}

    def __missing__(self, chunk: str):
        if len(self) >= self.SIZE:
            self.clear(), self.edges.clear()
        t = _plain(chunk)
        head, tail = _HEAD.match(t), _TAIL.search(t)
        if head or tail:
            # Letters that stand alone at the start and at the end, and whether there is nothing else.
            n = len(re.findall(r"[^\W\d_]", t))
            whole = bool(_SINGLES.fullmatch(t))
            self.edges[chunk] = (n if whole else 3 if head else 0, n if whole else 3 if tail else 0, whole)
        self[chunk] = out = tuple(map(self.make, tokens(chunk)))
        return out


_HEAD = re.compile(r"[.\-_*·|+~]?[^\W\d_](?![^\W\d_])")
_TAIL = re.compile(r"(?<![^\W\d_])[^\W\d_][.\-_*·|+~]?$")
_SINGLES = re.compile(r"[.\-_*·|+~]?(?:[^\W\d_][.\-_*·|+~]{1,2})*[^\W\d_]?[.\-_*·|+~]?")
_cached: dict = {}


def _spelled_across(chunks: list[str], edges: dict) -> bool:
    """Whether single letters in a row may form a word across blanks: at least four of them without a gap."""
    run = 0
    for c in chunks:
        e = edges.get(c)
        if e is None:
            run = 0
            continue
        head, tail, whole = e
        if run and run + head >= 4 and head:
            return True
        run = run + head if whole and run else tail
    return False


def tokens_by(text: str | None, make=number) -> list:
    """``tokens`` of a text, each given to make: piece by piece from memory where no rule looks across blanks, at once elsewhere."""
    if not text:
        return []
    chunks = _cached.get(make)
    if chunks is None:
        chunks = _cached[make] = _Chunks(make)
    parts = text.split()
    known = [chunks[c] for c in parts]
    if "**" in text or (not chunks.edges.keys().isdisjoint(parts) and _spelled_across(parts, chunks.edges)):
        return [make(w) for w in tokens(text)]
    return list(chain.from_iterable(known))


class Table:
    """Log-odds by feature number: an open-addressing hash table in two arrays, read by whole arrays at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.mask = (1 << max(10, (4 * len(keys)).bit_length())) - 1
        self.keys, self.values = np.zeros(self.mask + 1, np.int64), np.zeros(self.mask + 1)
        left, self.depth = np.arange(len(keys)), 0
        while len(left):
            at = (self._home(keys[left]) + self.depth) & self.mask
            free = np.flatnonzero(self.keys[at] == 0)
            _, first = np.unique(at[free], return_index=True)
            put = free[first]
            self.keys[at[put]], self.values[at[put]] = keys[left[put]], values[left[put]]
            left = np.delete(left, put)
            self.depth += 1

    def _home(self, x: np.ndarray) -> np.ndarray:
        return (x.astype(np.uint64) * _TWO >> np.uint64(20)).astype(np.int64) & self.mask

    def get(self, x: np.ndarray) -> np.ndarray:
        """The values of features, 0 for those that the table lacks."""
        at = self._home(x)
        found = self.keys[at]
        out = np.where(found == x, self.values[at], 0.0)
        left = np.flatnonzero((found != x) & (found != 0))
        for step in range(1, self.depth):
            if not len(left):
                break
            to = (at[left] + step) & self.mask
            found = self.keys[to]
            hit = found == x[left]
            out[left[hit]] = self.values[to[hit]]
            left = left[~hit & (found != 0)]
        return out


@dataclass(frozen=True)
class Words:
    """Documents of a batch side by side: the numbers of their words and of the pairs, and where each document starts."""

    words: np.ndarray
    twos: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.sizes)), self.sizes)


_MOST_DOCS, _MOST_WORDS = 1 << 14, 2_000_000


def word_batches(column: pa.ListArray):
    """(first row, rows, Words) of parts of a column of word numbers, small enough for arrays side by side."""
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        base = ends[at] - sizes[at]
        to = max(at + 1, min(int(np.searchsorted(ends, base + _MOST_WORDS, "right")), at + _MOST_DOCS))
        words = flat[base : ends[to - 1]]
        starts = ends[at:to] - sizes[at:to] - base
        before = np.concatenate(([0], words[:-1])) if len(words) else words
        before[starts[sizes[at:to] > 0]] = 0
        yield at, to - at, Words(words, pair_numbers(before, words), starts, sizes[at:to])
        at = to


def position_scores(w: Words, table: Table, drift: float) -> np.ndarray:
    """The log-odds of the word and the pair at each position, and of the mask class, less the drift."""
    s = table.get(w.words) + table.get(w.twos) - drift
    masked = table.get(np.array([_MASKED]))[0]
    return s + masked * (w.words & 1) if masked else s


def best_segments(scores: np.ndarray, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every document its segment with the greatest sum (score, start, end, in the batch); 0 where none is positive.

    One scan for all: sums run within documents, each laid below all sums of the one before it, so that the running
    least sum starts anew with every document.
    """
    n = len(w.sizes)
    score, start, end = np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
    some = np.flatnonzero(w.sizes)
    if not len(some):
        return score, start, end
    first = w.starts[some]
    right = np.cumsum(scores)
    base = right[first] - scores[first]
    right = right - np.repeat(base, w.sizes[some])
    drop = 2 * np.add.reduceat(np.abs(scores), first).max() + 1
    right -= np.repeat(np.arange(len(some)) * drop, w.sizes[some])
    left = right - scores
    least = np.minimum.accumulate(left)
    lowest = np.maximum.accumulate(np.where(left <= least, np.arange(len(left)), 0))
    gain = right - least
    top = np.maximum.reduceat(gain, first)
    at = np.flatnonzero(gain == np.repeat(top, w.sizes[some]))
    owner = np.repeat(np.arange(len(some)), w.sizes[some])[at]
    last = at[np.concatenate(([True], owner[1:] != owner[:-1]))]
    good = top > 0
    score[some[good]], start[some[good]], end[some[good]] = top[good], lowest[last[good]], last[good] + 1
    return score, start, end


def held(w: Words, inside: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(feature, document) pairs, each once: what every document holds, at the positions that are inside."""
    doc, words, twos = w.doc, w.words, w.twos
    if inside is not None:
        doc, words, twos = doc[inside], words[inside], twos[inside]
    masked = doc[(words & 1) == 1]
    key = np.concatenate((words << 14 | doc, twos << 14 | doc, np.full(len(masked), _MASKED) << 14 | masked))
    key.sort()
    key = key[np.concatenate(([True], key[1:] != key[:-1]))] if len(key) else key
    return key >> 14, key & ((1 << 14) - 1)


def summed(features: np.ndarray, *weights: np.ndarray) -> tuple[np.ndarray, ...]:
    """Each feature once with the sums of its weights."""
    keys, at = np.unique(features, return_inverse=True)
    return keys, *(np.bincount(at, x, len(keys)) for x in weights)


def segments(scores) -> list[tuple[float, int, int]]:
    """All maximal scoring segments (score, start, end) of a sequence, in linear time.

    Each candidate keeps the cumulated score left of it and at its end, and the last earlier candidate with a smaller
    left sum; a new one follows these links to its own, and is merged with it as long as that ends lower.
    """
    kept: list[tuple[int, int, float, float, int]] = []  # start, end, left sum, right sum, link
    total = 0.0
    for i, s in enumerate(scores):
        if s <= 0:
            total += s
            continue
        start, left = i, total
        total += s
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= left:
                j = kept[j][4]
            if j < 0 or kept[j][3] >= total:
                kept.append((start, i + 1, left, total, j))
                break
            start, left = kept[j][0], kept[j][2]
            del kept[j:]
    return [(right - left, a, b) for a, b, left, right, _ in kept]


def best_segment(scores: np.ndarray) -> tuple[float, int, int]:
    """The segment with the greatest sum (score, start, end); (0, 0, 0) if none is positive."""
    if not len(scores):
        return 0.0, 0, 0
    right = np.cumsum(scores)
    left = np.concatenate(([0.0], right[:-1]))
    gain = right - np.minimum.accumulate(left)
    end = int(gain.argmax())
    if gain[end] <= 0:
        return 0.0, 0, 0
    start = end - int(left[: end + 1][::-1].argmin())
    return float(gain[end]), start, end + 1


def votes_to_posterior(counts: dict[tuple[int, int], int], rounds: int = 50) -> dict[tuple[int, int], float]:
    """The chance that a document is toxic for each (votes, toxic votes), by expectation maximisation over one share
    of toxic documents and one error rate for each of the two answers."""
    share, miss, false = 0.2, 0.1, 0.1
    post: dict[tuple[int, int], float] = {}
    for _ in range(rounds):
        for n, k in counts:
            a = share * (1 - miss) ** k * miss ** (n - k)
            b = (1 - share) * false**k * (1 - false) ** (n - k)
            post[n, k] = a / (a + b)
        docs = sum(counts.values())
        tox = sum(c * post[x] for x, c in counts.items())
        votes_t = sum(c * post[n, k] * n for (n, k), c in counts.items())
        votes_c = sum(c * (1 - post[n, k]) * n for (n, k), c in counts.items())
        share = min(max(tox / max(docs, 1), 1e-3), 0.999)
        miss = min(max((sum(c * post[n, k] * (n - k) for (n, k), c in counts.items()) + 1) / (votes_t + 10), 1e-3), 0.4)
        false = min(max((sum(c * (1 - post[n, k]) * k for (n, k), c in counts.items()) + 1) / (votes_c + 10), 1e-3), 0.4)
    return post


@dataclass(frozen=True)
class Model:
    """Log-odds of the features and the calibration of segment scores."""

    table: Table
    drift: float
    decay: float = 1.0  # lambda: how fast the number of chance segments falls with their score
    rate: float = 0.01  # K: chance segments of score 0 and more per position
    threshold: float = float("inf")  # least calibrated score of a flagged document

    def calibrated(self, score, n):
        """-log10 of the number of segments of this score or more that n neutral words give by chance."""
        return (self.decay * score - np.log(max(self.rate, 1e-12) * np.maximum(n, 1))) / math.log(10)

    def column(self, score, n):
        """The same as a column."""
        return (F.lit(self.decay) * score - F.log(F.lit(max(self.rate, 1e-12)) * F.greatest(n, F.lit(1)))) / F.lit(math.log(10))


_BUCKET = 0.25


def _posteriors(labels: DataFrame, max_kinds: int = 10_000) -> DataFrame:
    """doc_id and the chance p that it is toxic, from the last vote of every rater."""
    last = (
        labels.where("doc_id is not null and toxic in (0, 1)")
        .groupBy("doc_id", "rater_no")
        .agg(F.max(F.struct("labelled_at", "toxic")).alias("v"))
        .groupBy("doc_id")
        .agg(F.count("*").alias("n"), F.sum("v.toxic").alias("k"))
    )
    kinds = last.groupBy("n", "k").count().limit(max_kinds + 1).collect()  # (raters + 1)^2 / 2 rows at most
    if len(kinds) > max_kinds:
        raise ValueError(f"more than {max_kinds} kinds of votes")
    post = votes_to_posterior({(r[0], r[1]): r[2] for r in kinds})
    rows = [(int(n), int(k), float(p)) for (n, k), p in post.items()]
    known = labels.sparkSession.createDataFrame(rows or [(0, 0, 0.0)], "n long, k long, p double")
    return last.join(F.broadcast(known), ["n", "k"]).select("doc_id", "p")


def prepared(documents: DataFrame, labels: DataFrame, text: bool = False) -> DataFrame:
    """doc_id, source, p (null without votes), the word numbers of every document, and its text if asked for."""

    def run(batches):
        for b in batches:
            words = [tokens_by(t) for t in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(3)), pa.array(words, pa.list_(pa.int64())), *([b.column(3)] if text else [])], names=["doc_id", "source", "p", "words", *(["text"] if text else [])])

    rows = documents.select("doc_id", "source", "text").join(_posteriors(labels), "doc_id", "left").select(F.col("doc_id").cast("long").alias("doc_id"), "source", "p", "text")
    return map_arrow(rows, run, "doc_id long, source string, p double, words array<bigint>" + ", text string" * text)


def document_counts(docs: DataFrame) -> DataFrame:
    """feature, docs: how many documents hold each feature, over all documents. Each task adds up its own first."""

    def run(batches):
        got, size = [], 0

        def flush():
            keys, n = summed(np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got]))
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(n.astype(np.int64), pa.int64())], names=["feature", "docs"])

        for b in batches:
            for _, _, w in word_batches(b.column(0)):
                f, _ = held(w)
                keys, n = np.unique(f, return_counts=True)
                got.append((keys, n))
                size += len(keys)
                if size > _MOST_WORDS:
                    yield flush()
                    got, size = [], 0
        if got:
            yield flush()

    return map_arrow(docs.select("words"), run, "feature long, docs long").groupBy("feature").agg(F.sum("docs").alias("docs"))


def _counts(docs: DataFrame, table, threshold: float | None, drift: float) -> DataFrame:
    """Per feature the documents that hold it, weighted by the chance to be toxic (pos) and not to be (neg).

    With a table, only the best segment of a document counts for it; everything outside counts as neutral. A
    document without votes is weighed by whether its segment reaches the threshold.
    """

    def run(batches):
        for b in batches:
            p_all = b.column(1).to_numpy(zero_copy_only=False)
            for at, n, w in word_batches(b.column(0)):
                p = p_all[at : at + n]
                f, d = held(w)
                if table is None:
                    keys, pos, neg = summed(f, p[d], 1 - p[d])
                else:
                    score, start, end = best_segments(position_scores(w, table.value, drift), w)
                    hit = score >= threshold
                    q = p * np.where(hit, 0.85, 0.03)
                    p = np.where(np.isnan(p), np.where(hit, 0.9, 0.02), q / (q + (1 - p) * np.where(hit, 0.15, 0.97)))
                    inside = np.zeros(len(w.words) + 1, np.int64)
                    np.add.at(inside, start[score > 0], 1)
                    np.add.at(inside, end[score > 0], -1)
                    fi, di = held(w, np.cumsum(inside[:-1]) > 0)
                    keys, pos, neg = summed(np.concatenate((f, fi)), np.concatenate((np.zeros(len(f)), p[di])), np.concatenate((np.ones(len(f)), -p[di])))
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(pos, pa.float64()), pa.array(neg, pa.float64())], names=["feature", "pos", "neg"])

    rows = map_arrow(docs.select("words", "p"), run, "feature long, pos double, neg double")
    return rows.groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def _table(counts: DataFrame, background: DataFrame, total: int, strength: float, shrink: float) -> Table:
    """The features' log-odds: an informative Dirichlet prior from the counts of all documents, drawn towards 0 by the
    standard error. Only features whose log-odds exceed that are kept, and come to the driver."""
    n1, n0 = counts.agg(F.coalesce(F.sum("pos"), F.lit(0.0)), F.coalesce(F.sum("neg"), F.lit(0.0))).first()
    alpha = F.lit(strength / max(total, 1)) * F.col("docs") + 0.01
    x, y = F.col("pos") + alpha, F.col("neg") + alpha
    delta = F.log(x / (n1 + strength - x)) - F.log(y / (n0 + strength - y))
    sigma = F.sqrt(1 / x + 1 / y)
    odds = counts.join(background, "feature").select("feature", delta.alias("d"), sigma.alias("s")).where(F.abs("d") > shrink * F.col("s"))
    rows = odds.select("feature", (F.signum("d") * (F.abs("d") - shrink * F.col("s"))).alias("v")).toArrow()
    return Table(rows.column("feature").to_numpy(), rows.column("v").to_numpy())


def _scored(labelled: DataFrame, table, drift: float) -> DataFrame:
    """p, n (words) and score of the best segment of every labelled document."""

    def run(batches):
        for b in batches:
            for at, n, w in word_batches(b.column(0)):
                score, _, _ = best_segments(position_scores(w, table.value, drift), w)
                yield pa.RecordBatch.from_arrays([b.column(1).slice(at, n), pa.array(w.sizes, pa.int64()), pa.array(score, pa.float64())], names=["p", "n", "score"])

    return map_arrow(labelled.select("words", "p"), run, "p double, n long, score double")


def _least(scored: DataFrame, value) -> float:
    """The threshold on a score with the greatest expected F1 on the labelled documents, from a histogram of it."""
    hist = scored.groupBy(F.floor(value / _BUCKET).alias("b")).agg(F.sum("p").alias("tp"), F.count("*").alias("n")).collect()
    rows = sorted(((r[0], r[1], r[2]) for r in hist if r[0] is not None), reverse=True)
    total = sum(r[1] for r in rows)
    best, at, tp, n = 0.0, float("inf"), 0.0, 0
    for b, p, c in rows:
        tp, n = tp + p, n + c
        if b > 0 and 2 * tp / (n + total) > best:
            best, at = 2 * tp / (n + total), b * _BUCKET
    return at


def _calibration(places: dict[float, int], tops: dict[float, int]) -> tuple[float, float]:
    """(lambda, K) of chance segments from histograms of position scores and of best segments of neutral documents."""
    total, n = sum(places.values()), sum(tops.values())
    if not total or not n:
        return 1.0, 0.01
    lo, hi = 1e-3, 20.0
    for _ in range(60):  # the sum of shares times exp(lambda s) passes 1 once for lambda > 0
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(c / total * math.exp(min(mid * s, 600)) for s, c in places.items()) < 1 else (lo, mid)
    decay = (lo + hi) / 2
    mean = sum(s * c for s, c in tops.items()) / n
    return decay, n / total * math.exp(min(decay * min(mean, 3.0), 20))


def fit(docs: DataFrame, *, strength: float = 1000.0, shrink: float = 1.0, drift: float = 2.0, rounds: int = 3) -> tuple[Table, float]:
    """Learns the log-odds from all documents: first from whole labelled ones, then, round by round, from the best segments
    of those with votes and those without. Returns the table and the least raw score of a toxic document."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "toxicity-fit")
    rows = docs.select("doc_id", "p", "words")
    labelled = scratch.cut(rows.where("p is not null"))
    if labelled.isEmpty():
        return Table(np.zeros(0, np.int64), np.zeros(0)), float("inf")
    background = scratch.cut(document_counts(docs))
    total = background.agg(F.sum("docs")).first()[0] or 0
    table, raw = None, float("inf")
    for i in range(rounds + 1):
        counts = scratch.cut(_counts(rows if i else labelled, table, raw, drift))
        new = spark.sparkContext.broadcast(_table(counts, background, total, strength, shrink))
        scratch.drop(counts)
        if table is not None:
            table.unpersist()
        table, raw = new, _least(_scored(labelled, new, drift), F.col("score"))
    for done in (labelled, background):
        scratch.drop(done)
    return table.value, raw


def calibrated(docs: DataFrame, table: Table, raw: float, drift: float) -> tuple[DataFrame, Model]:
    """One pass over all documents: (their rows with n and the score of the best segment, the calibrated model).

    Beside the documents the pass returns, from those taken as neutral, histograms of position scores and best segments.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(table)

    def run(batches):
        places, tops = Counter(), Counter()
        for b in batches:
            p_all = b.column(2).to_numpy(zero_copy_only=False)
            for at, n, w in word_batches(b.column(3)):
                s = position_scores(w, shared.value, drift)
                score, _, _ = best_segments(s, w)
                neutral = (score < raw) & ~(p_all[at : at + n] > 0.5)
                for hist, v in ((places, np.round(s[neutral[w.doc]] / _BUCKET)), (tops, np.floor(score[neutral & (score > 0)] / _BUCKET))):
                    for x, c in zip(*np.unique(v, return_counts=True)):
                        hist[int(x)] += int(c)
                yield _rows(b.column(0).slice(at, n), b.column(1).slice(at, n), b.column(2).slice(at, n), w.sizes, score, [True] * n)
        keys = [(-1.0, k, c) for k, c in places.items()] + [(-2.0, k, c) for k, c in tops.items()]
        none = pa.nulls(len(keys), pa.int64())
        yield _rows(none, pa.nulls(len(keys), pa.string()), pa.array([k[0] for k in keys], pa.float64()), [k[2] for k in keys], [float(k[1]) for k in keys], [False] * len(keys))

    rows = map_arrow(docs.select("doc_id", "source", "p", "words"), run, "doc_id long, source string, p double, n long, score double, doc boolean")
    scored, hist = Scratch(spark, "toxicity-scores").split(rows, "doc")
    found = {kind: {} for kind in (-1.0, -2.0)}
    for kind, x, n in hist.groupBy("p", "score").agg(F.sum("n")).collect():
        found[kind][x * _BUCKET] = n
    model = Model(table, drift, *_calibration(found[-1.0], found[-2.0]))
    least = _least(scored.where("p is not null and score > 0"), model.column(F.col("score"), F.col("n")))
    return scored.drop("doc"), replace(model, threshold=least)


def _rows(*columns) -> pa.RecordBatch:
    types = (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.float64(), pa.bool_())
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, types)], names=["doc_id", "source", "p", "n", "score", "doc"])


def scores(documents: DataFrame, labels: DataFrame, *, passages: bool = True, drift: float = 2.0, **options) -> DataFrame:
    """One row per document: doc_id, source, words, score (calibrated), toxic, and its significant passages if asked for.

    Method: the words of a text are brought to one spelling; each position scores the log-odds of its word and word
    pair (informative Dirichlet prior, counts over all documents) less a drift; a linear-time scan finds the
    maximal scoring segments; the number of segments of such a score that neutral words of the text's length give
    by chance (Karlin-Altschul statistics fitted on documents taken as neutral) calibrates it: score is -log10 of
    that number. toxic compares it with the threshold of greatest expected F1 on the labelled documents, whose
    votes are weighed by error rates estimated from the raters' disagreement. passages holds each segment that
    reaches the threshold by itself.

    Texts are read once; the later passes work on arrays of word numbers. The log-odds, the prior's counts, the scores,
    their calibration and the threshold cover all documents; the table of log-odds holds the features that tell toxic from
    neutral by more than their standard error.

    Defined cases: null and blank texts score null and aren't toxic; votes that are null count as none, of repeated
    votes of one rater the last holds; without labelled documents nothing is toxic; empty tables give an
    empty result; documents that repeat are scored each; very long texts are read whole; other columns are ignored.
    """
    spark = documents.sparkSession
    docs = Scratch(spark, "toxicity").cut(prepared(documents, labels, passages))
    table, raw = fit(docs, drift=drift, **options)
    scored, model = calibrated(docs, table, raw, drift)
    value = F.when(F.col("score") > 0, model.column(F.col("score"), F.col("n")))
    if not passages:
        return scored.select("doc_id", "source", F.col("n").alias("words"), value.alias("score"), F.coalesce(value >= F.lit(model.threshold), F.lit(False)).alias("toxic"))
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in batches:
            texts = b.column(3)
            for at, n, w in word_batches(b.column(2)):
                s = position_scores(w, m.table, m.drift)
                top, _, _ = best_segments(s, w)
                values = np.where(top > 0, m.calibrated(top, w.sizes), np.nan)
                toxic = values >= m.threshold
                found: list[list[str]] = [[] for _ in range(n)]
                for i in np.flatnonzero(toxic):
                    words = tokens(texts[at + int(i)].as_py())
                    parts = segments(s[w.starts[i] : w.starts[i] + w.sizes[i]])
                    found[i] = [" ".join(words[x:y]) for v, x, y in parts if m.calibrated(v, len(words)) >= m.threshold]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(at, n), b.column(1).slice(at, n), pa.array(w.sizes, pa.int64()), pa.array(values, pa.float64(), mask=np.isnan(values)), pa.array(toxic, pa.bool_()), pa.array(found, pa.list_(pa.string()))],
                    names=["doc_id", "source", "words", "score", "toxic", "passages"],
                )

    return map_arrow(docs.select("doc_id", "source", "words", "text"), run, "doc_id long, source string, words long, score double, toxic boolean, passages array<string>")


def source_name(c):
    """One spelling of a source: lower case, blanks and underscores as hyphens; 'unknown' if null or blank."""
    name = F.regexp_replace(F.lower(F.trim(F.regexp_replace(c, r"(?U)\s+", " "))), "[ _]+", "-")
    return F.when(name.isNull() | (name == ""), "unknown").otherwise(name)


def rates(scored: DataFrame) -> DataFrame:
    """Documents, toxic documents and their share for every source."""
    return scored.groupBy(source_name(F.col("source")).alias("source")).agg(
        F.count("*").alias("documents"), F.count_if("toxic").alias("toxic_documents"), F.avg(F.col("toxic").cast("double")).alias("toxic_rate")
    )
