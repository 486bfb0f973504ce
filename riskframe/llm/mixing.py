"""Mixing sources to target weights: soft memberships and nonnegative document rates fitted by projected gradient."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskframe.llm.tokenizing import count, encoder, shared_vocabulary
from riskframe.llm.toxicity import source_name
from riskframe.runtime import Scratch, map_arrow

_ENDS = re.compile(r"^[\W\d_]+|[\W\d_]+$")
_TEMPERATURES = (1.0, 2.0, 4.0, 8.0, 16.0, 32.0, 64.0)
#: Sources of each document in rows of the fit that name them in columns of their own (``_DOC``).
TOP = 4
#: Most numbers of documents x sources side by side.
_MOST = 4_000_000


class _Buckets(dict):
    """The bucket of each word (what stands between blanks, without signs and digits at its ends) by hash; emptied when it
    has grown to its size, which changes no result."""

    def __init__(self, dims: int):
        super().__init__()
        self.dims = dims

    def __missing__(self, word: str) -> int:
        if len(self) >= 300_000:
            self.clear()
        self[word] = out = zlib.crc32(_ENDS.sub("", word).encode("utf-8", "surrogatepass")) % self.dims
        return out


_buckets: dict[int, _Buckets] = {}


def word_buckets(text: str | None, dims: int) -> list[int]:
    """The buckets of a text's words, in order."""
    known = _buckets.setdefault(dims, _Buckets(dims))
    return [known[w] for w in (text or "").lower().split()]


def word_counts(text: str | None, dims: int) -> np.ndarray:
    """Counts of a text's words by hash."""
    return np.bincount(word_buckets(text, dims), minlength=dims).astype(np.int64) if text else np.zeros(dims, np.int64)


def measured(documents: DataFrame, names: list[str] | None, dims: int, vocabulary) -> DataFrame:
    """doc_id, source, tokens and words (buckets) of every document: the only pass over the texts."""

    def run(batches):
        enc = encoder(vocabulary.value) if vocabulary is not None else None
        for b in batches:
            texts = b.column(2).to_pylist()
            sizes = [count(enc, t) if enc else 0 for t in texts]
            words = pa.array([word_buckets(t, dims) for t in texts], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes, pa.int64()), words], names=["doc_id", "source", "tokens", "words"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return map_arrow(documents.select("doc_id", "source", "text"), run, f"doc_id {kind}, source string, tokens long, words array<int>")


def _side_by_side(column: pa.ListArray, most: int = 1_000_000, most_rows: int = 1 << 30):
    """(first row, rows, flat values, sizes) of parts of a list column."""
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        base = ends[at] - sizes[at]
        to = max(at + 1, min(int(np.searchsorted(ends, base + most, "right")), at + most_rows))
        yield at, to - at, flat[base : ends[to - 1]], sizes[at:to]
        at = to


def likelihoods(logp: np.ndarray, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sum of the word log-probabilities of each document under each source (documents x sources)."""
    out = np.zeros((len(sizes), len(logp)), np.float64)
    some = np.flatnonzero(sizes)
    if len(some):
        starts = (np.cumsum(sizes) - sizes)[some]
        by_word = np.ascontiguousarray(logp.T)
        for a in range(0, len(some), 2000):  # bounds the words x sources matrix
            rows = some[a : a + 2000]
            lo, hi = starts[a], starts[a + len(rows) - 1] + sizes[rows[-1]]
            out[rows] = np.add.reduceat(by_word[flat[lo:hi]], starts[a : a + len(rows)] - lo, axis=0)
    return out


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def classifier(docs: DataFrame, names: list[str], dims: int):
    """(log-probabilities of words per source, log-shares of sources, temperature), learned from the labelled documents.

    docs: doc_id, source, and words or text. Word counts of all labelled documents are summed inside each task first; a
    tenth of them, by hash of the id, is held out to choose the temperature that flattens the posteriors (least log loss).
    """
    if "words" not in docs.columns:
        docs = measured(docs, names, dims, None)
    at = {n: i for i, n in enumerate(names)}
    held = F.pmod(F.xxhash64("doc_id"), F.lit(10)) == 0
    sources = len(names)

    def labels(column):
        return np.array([at[s] for s in column.to_pylist()], np.int64)

    def run(batches):
        total, n = np.zeros(sources * dims, np.int64), np.zeros(sources, np.int64)
        for b in batches:
            label = labels(b.column(0))
            n += np.bincount(label, minlength=sources)
            for row, rows, flat, sizes in _side_by_side(b.column(1)):
                total += np.bincount(np.repeat(label[row : row + rows], sizes) * dims + flat, minlength=sources * dims)
        seen = np.flatnonzero(n)
        parts = total.reshape(sources, dims)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(n[seen], pa.int64()), pa.array([parts[i].tobytes() for i in seen], pa.binary())], names=["source", "docs", "words"])

    words = np.zeros((sources, dims), np.int64)
    n = np.zeros(sources, np.int64)
    known = docs.where(F.col("source").isNotNull())
    # At most sources x dims numbers per task; they are added up by source in a second stage.
    parts = map_arrow(known.where(~held).select("source", "words"), run, "source int, docs long, words binary").groupBy("source").applyInArrow(_added, "source int, docs long, words binary")
    for r in parts.toLocalIterator():
        n[r[0]], words[r[0]] = r[1], np.frombuffer(r[2], np.int64)
    base = words.sum(axis=0) + 1.0
    prior = 100.0 * base / base.sum()
    logp = np.log(words + prior) - np.log(words.sum(axis=1, keepdims=True) + 100.0)
    shares = np.log((n + 0.5) / (n.sum() + 0.5 * sources))
    model = docs.sparkSession.sparkContext.broadcast((logp.astype(np.float32), shares))

    def loss(batches):
        logp, shares = model.value
        total = np.zeros(len(_TEMPERATURES))
        for b in batches:
            label = labels(b.column(0))
            for row, rows, flat, sizes in _side_by_side(b.column(1)):
                x = likelihoods(logp, flat, sizes)
                for i, temp in enumerate(_TEMPERATURES):
                    total[i] -= np.log(softmax(x / temp + shares)[np.arange(rows), label[row : row + rows]] + 1e-12).sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total, pa.float64())], names=["t", "loss"])

    losses = map_arrow(known.where(held).select("source", "words"), loss, "t int, loss double").groupBy("t").agg(F.sum("loss")).collect()
    best = min(losses, key=lambda r: (r[1], r[0]))[0] if losses else 0
    return logp, shares, _TEMPERATURES[best]


def _added(t: pa.Table) -> pa.Table:
    words = sum(np.frombuffer(x, np.int64) for x in t.column("words").to_pylist())
    return pa.table({"source": t.column("source")[:1], "docs": [sum(t.column("docs").to_pylist())], "words": [words.tobytes()]}, schema=pa.schema([("source", pa.int32()), ("docs", pa.int64()), ("words", pa.binary())]))


class Mix:
    """One mix: its goals in tokens by source, allowed repeats, and the start rates that meet the goals by label alone."""

    def __init__(self, goals: np.ndarray, caps: np.ndarray, available: np.ndarray):
        self.goals, self.caps = goals, caps
        self.inside = caps > 0
        self.sources = np.flatnonzero(self.inside)
        self.start = np.divide(goals, available, out=np.zeros_like(goals), where=available > 0)
        self.mass = np.maximum(available, 1.0)


#: How much more the totals by label weigh in the squared distance than the totals by posterior.
_LABEL_WEIGHT, _SOFT_WEIGHT = 1000.0, 0.2


def memberships(mix: Mix, label: np.ndarray, k: np.ndarray, p: np.ndarray):
    """(posterior shares of the mix's sources, their sum before they are scaled to 1, cap) of documents in one mix.

    ``p`` holds the posteriors of the sources ``k``, which are those of all documents (one dimension) or each
    document's own. A document with a known source belongs to it by label; one without belongs by its posterior to both.
    Posteriors are scaled to the sources of the mix; where those hold nothing, a known source stands for them.
    """
    if k.ndim == 1:
        column = np.zeros(len(mix.goals), np.int64)
        column[k] = np.arange(len(k))
        q = p[:, column[mix.sources]]
    else:
        q = np.zeros((len(p), len(mix.goals)))
        np.add.at(q, (np.arange(len(p))[:, None], k), p)
        q = q[:, mix.sources]
    total = q.sum(axis=1)
    q /= np.where(total > 0, total, 1.0)[:, None]
    cap = mix.caps[np.maximum(label, 0)]
    free = np.flatnonzero(label < 0)
    if len(free):
        x = q[free]
        likely = np.where(x >= np.minimum(0.05, x.max(axis=1, keepdims=True)), mix.caps[mix.sources], np.inf).min(axis=1)
        cap[free] = np.where(total[free] >= 0.5, likely, 0.0)
    return q, total, cap


def rates(mix: Mix, y: np.ndarray, label: np.ndarray, k: np.ndarray, p: np.ndarray):
    """The rates of documents, between 0 and their caps, under the slopes y (by label, by posterior), with memberships:
    (rates, posterior shares, whether the source is known, whether it stands for the posterior too, caps)."""
    q, total, cap = memberships(mix, label, k, p)
    known, own = label >= 0, np.maximum(label, 0)
    alone = known & (total == 0)
    first = mix.start + y[0]
    r = np.where(known, first[own], 0.0) + np.where(alone, y[1][own], q @ y[1][mix.sources])
    r[~known] += q[~known] @ first[mix.sources]
    return np.clip(r, 0.0, cap), q, known, alone, cap


def totals(mix: Mix, y: np.ndarray, label, k, p, tokens) -> np.ndarray:
    """Expected tokens by source under the rates: by label and by posterior."""
    r, q, known, alone, _ = rates(mix, y, label, k, p)
    w = r * tokens
    n = len(mix.goals)
    hard, soft = (np.bincount(label[x], w[x], n).astype(np.float64) for x in (known, alone))
    hard[mix.sources] += w[~known] @ q[~known]
    soft[mix.sources] += w @ q
    return np.stack([hard, soft])


_DOC = [f"k{i}" for i in range(TOP)] + [f"p{i}" for i in range(TOP)]


def _posterior(rows: DataFrame) -> list[str]:
    """The columns that hold the posteriors: one list of those of all sources of the mixes, or ``_DOC``."""
    return ["posterior"] if "posterior" in rows.columns else _DOC


def _columns(batches, first: int, sources: np.ndarray):
    """(slice of a batch, label, sources, posterior and tokens as arrays); ``first`` is the label's column, ``sources`` are
    those of the mixes."""
    for whole in batches:
        step = max(1, _MOST // max(len(sources), 1))
        for row in range(0, whole.num_rows, step):
            b = whole.slice(row, step)
            at = lambda i: b.column(first + i).to_numpy(zero_copy_only=False)  # noqa: B023, E731
            if "posterior" in b.schema.names:
                k, p = sources, b.column(first + 2).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, len(sources))
            else:
                k = np.stack([at(2 + i) for i in range(TOP)], axis=1).astype(np.int64)
                p = np.stack([at(2 + TOP + i) for i in range(TOP)], axis=1).astype(np.float64)
            yield b, at(0).astype(np.int64), k, p, at(1).astype(np.float64)


def _sources(mixes: dict[int, Mix]) -> np.ndarray:
    """The sources of any mix; no other's posterior is ever read."""
    return np.unique(np.concatenate([x.sources for x in mixes.values()]))


def fitted(rows: DataFrame, mixes: dict[int, Mix], rounds: int, tolerance: float) -> tuple[dict[int, np.ndarray], dict[int, np.ndarray], dict[int, float]]:
    """(slopes, expected totals, distance by label) of each mix.

    The squared distance of expected source totals to the goals, by label and by posterior, plus the squared
    distance of rates to their start, falls by projected gradient steps: the slopes add up, a document's rate is the
    start plus the slopes of its memberships, cut to 0 and its cap. A step divides each total's distance by the tokens
    that the source holds, and is extrapolated from the last ones (Anderson). Nothing but the slopes is kept: a round is one
    pass over the documents that returns one total per mix and source. The slopes of the round with the least step are returned.
    """
    weight = np.array([_LABEL_WEIGHT, _SOFT_WEIGHT])[:, None]
    y = {m: np.zeros((2, len(x.goals))) for m, x in mixes.items()}
    best = {m: (np.inf, y[m], y[m], y[m]) for m in mixes}
    past: dict[int, list] = {m: [] for m in mixes}
    for _ in range(rounds):
        shared = rows.sparkSession.sparkContext.broadcast((mixes, y))

        def run(batches, shared=shared):
            mixes, y = shared.value
            out = {m: 0.0 for m in mixes}
            for _, *cols in _columns(batches, 0, _sources(mixes)):
                for m, x in mixes.items():
                    out[m] = out[m] + totals(x, y[m], *cols)
            got = [(m, t) for m, t in out.items() if not np.isscalar(t)]
            yield pa.RecordBatch.from_arrays([pa.array([m for m, _ in got], pa.int32()), pa.array([t.ravel().tolist() for _, t in got], pa.list_(pa.float64()))], names=["mix_no", "totals"])

        sums = map_arrow(rows.select("label", "tokens", *_posterior(rows)), run, "mix_no int, totals array<double>")
        got = {m: np.zeros((2, len(x.goals))) for m, x in mixes.items()}
        for m, i, v in sums.select("mix_no", F.posexplode("totals")).groupBy("mix_no", "pos").agg(F.sum("col")).collect():
            got[m].ravel()[i] = v
        shared.unpersist()
        moved = 0.0
        for m, x in mixes.items():
            far = np.where(x.inside, got[m] - x.goals, 0.0)
            slope = np.where(x.inside, -(far / x.mass + y[m] / weight) / (2 + 1 / weight), 0.0)
            left = float((np.abs(slope) * x.mass).sum() / max(x.goals.sum(), 1.0))
            if left < best[m][0]:
                best[m] = (left, y[m], got[m], slope)
            moved = max(moved, best[m][0])
            # Extrapolated too far: on from the best, by a plain step.
            past[m] = [*past[m][-5:], (y[m], slope)] if left <= 4 * best[m][0] else [best[m][1::2]]
            y[m] = _extrapolated(past[m])
        if moved < tolerance:
            break
    gap = {m: float(np.abs(np.where(x.inside, best[m][2][0] - x.goals, 0.0)).sum() / max(x.goals.sum(), 1.0)) for m, x in mixes.items()}
    return {m: b[1] for m, b in best.items()}, {m: b[2] for m, b in best.items()}, gap


def _extrapolated(past: list) -> np.ndarray:
    """The next slopes from the last (slopes, step) pairs: the combination of them with the least step, one step on."""
    y, f = past[-1]
    if len(past) < 2:
        return y + f
    dy = np.stack([(y - a).ravel() for a, _ in past[:-1]], axis=1)
    df = np.stack([(f - g).ravel() for _, g in past[:-1]], axis=1)
    c, *_ = np.linalg.lstsq(df, f.ravel(), rcond=1e-8)
    return (y.ravel() + f.ravel() - (dy + df) @ c).reshape(y.shape)


def mixed(documents: DataFrame, targets: DataFrame, *, tokenizer: str | None = None, dims: int = 4096, rounds: int = 12, tolerance: float = 1e-3, max_sources: int = 2000, max_targets: int = 100_000) -> DataFrame:
    """The documents chosen for each mix and how often: mix_no, doc_id, source (null if unknown), tokens, copies, member
    (sources and shares that a document without source counts for), distance (of the fit, as a share of the mix) and converged.

    Method: sizes in tokens and word buckets from one pass over the texts; a naive Bayes classifier learned on the
    labelled documents gives every document a posterior over sources; the budget of a mix is the greatest for which every
    source that holds anything can meet its weight within its repeats; projected gradient steps fit nonnegative rates of use,
    at most the allowed repeats, so that the expected tokens of every source match the goals both by label (documents
    without source count by posterior) and, where documents leave room, by the posteriors of all documents. A rate's whole part is copies;
    its fraction decides, against a hash, on one more: the bar lies, per mix and source, where the tokens meet the goal
    (``_barred``). A few single documents per source then close the gap that one text can leave.

    Defined cases: source names count in one spelling (case, blanks, underscores); weights that are null, 0 or negative are
    left out, of one source named twice in a mix the weights add up and the smaller repeats hold; null repeats
    count as 1; sources without tokens get nothing and the rest keep their proportions; documents of other sources
    or without tokens aren't used; a document without source may be used as often as the most restrictive of its
    likely sources allows, if most of its posterior lies on the mix; repeated documents are documents of their own; empty
    tables give an empty result. Errors: more than max_sources sources or max_targets targets.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "mixing")
    known = F.when(source_name(F.col("source")) != "unknown", source_name(F.col("source")))
    base = scratch.cut(measured(documents.select("doc_id", known.alias("source"), "text"), None, dims, shared_vocabulary(spark, tokenizer)))
    held = {r[0]: r[1] for r in base.where("source is not null").groupBy("source").agg(F.sum("tokens")).limit(max_sources + 1).collect()}
    wanted = (
        targets.where("mix_no is not null and source is not null and weight > 0")
        .groupBy(F.col("mix_no").cast("int").alias("mix_no"), source_name(F.col("source")).alias("source"))
        .agg(F.sum("weight").alias("weight"), F.min(F.coalesce("max_repeats", F.lit(1))).alias("repeats"))
        .limit(max_targets + 1)
        .collect()
    )
    if len(held) > max_sources or len(wanted) > max_targets:
        raise ValueError("too many sources or targets")
    names = sorted(held)
    at = {n: i for i, n in enumerate(names)}
    available = np.array([float(held[n] or 0) for n in names])
    mixes: dict[int, Mix] = {}
    for m in sorted({r[0] for r in wanted}):
        rows = [(at[r[1]], r[2], r[3]) for r in wanted if r[0] == m and r[1] in at and available[at[r[1]]] > 0 and r[3] > 0]
        if not rows:
            continue
        budget = min(available[i] * c / w for i, w, c in rows)
        goals, caps = np.zeros(len(names)), np.zeros(len(names))
        for i, w, c in rows:
            goals[i], caps[i] = budget * w, c
        mixes[m] = Mix(goals, caps, available)
    kind = base.schema["doc_id"].dataType.simpleString()
    if not mixes:
        return base.where("false").selectExpr("0 mix_no", "doc_id", "source", "tokens", "0L copies", "cast(null as map<string,double>) member", "0.0D distance", "false converged")

    logp, shares, temperature = classifier(base, names, dims)
    model = spark.sparkContext.broadcast((logp.astype(np.float32), shares, temperature))
    used = _sources(mixes)

    def posterior(batches):
        logp, shares, temp = model.value
        for b in batches:
            label = np.array([at.get(s, -1) for s in b.column(1).to_pylist()], np.int32)
            for row, n, flat, sizes in _side_by_side(b.column(3), most_rows=max(1, _MOST // len(names))):
                p = softmax(likelihoods(logp, flat, sizes) / temp + shares)[:, used]
                p = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * len(used), pa.int32()), pa.array(p.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(row, n), b.column(1).slice(row, n), pa.array(label[row : row + n]), b.column(2).slice(row, n), p], names=["doc_id", "source", "label", "tokens", "posterior"])

    docs = scratch.cut(map_arrow(base.where("tokens > 0").select("doc_id", "source", "tokens", "words"), posterior, f"doc_id {kind}, source string, label int, tokens long, posterior array<double>"))
    scratch.drop(base)
    slopes, expected, distance = fitted(docs, mixes, rounds, tolerance)
    share = spark.sparkContext.broadcast((mixes, slopes))

    # Rates to copies. Known sources: every document's whole copies, and how far its fraction lies above a hash.
    draw = (F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))).alias("u")

    def planned(batches):
        mixes, slopes = share.value
        for b, label, k, p, _ in _columns(batches, 2, used):
            u = b.column(b.num_columns - 1).to_numpy(zero_copy_only=False)
            for m, x in mixes.items():
                r, q, known, _, cap = rates(x, slopes[m], label, k, p)
                near = [names[j] for j in x.sources]
                use = np.flatnonzero(cap > 0)
                whole = np.floor(r[use] + 1e-9).astype(np.int64)
                lack = u[use] - (r[use] - whole)
                member = [None if known[i] else [(s, v) for s, v in zip(near, q[i].tolist()) if v > 0] for i in use]
                of = pa.array(use, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(use), m), pa.int32()), b.column(0).take(of), b.column(1).take(of), b.column(3).take(of), pa.array(whole), pa.array(cap[use]), pa.array(r[use] - whole), pa.array(lack, pa.float64()), pa.array(member, pa.map_(pa.string(), pa.float64()))],
                    names=["mix_no", "doc_id", "source", "tokens", "whole", "cap", "part", "lack", "member"],
                )

    plan = scratch.cut(map_arrow(docs.select("doc_id", "source", "label", "tokens", *_posterior(docs), draw), planned, f"mix_no int, doc_id {kind}, source string, tokens long, whole long, cap double, part double, lack double, member map<string,double>"))
    scratch.drop(docs)
    soft = plan.where("source is null").select("mix_no", "doc_id", "source", "tokens", "cap", (F.col("whole") + F.when(F.col("lack") < 0, 1).otherwise(0)).alias("copies"), "member")
    # What the chosen documents without source hold counts for the sources that they resemble.
    took = soft.where("copies > 0").select("mix_no", (F.col("tokens") * F.col("copies")).alias("n"), F.explode("member").alias("source", "part")).groupBy("mix_no", "source").agg(F.sum(F.col("n") * F.col("part"))).collect()
    taken = {(r[0], r[1]): r[2] for r in took}
    goal = {(m, names[i]): (max(x.goals[i] - taken.get((m, names[i]), 0.0), 0.0), x.caps[i]) for m, x in mixes.items() for i in np.flatnonzero(x.inside)}
    goals = spark.createDataFrame([(m, s, float(g)) for (m, s), (g, _) in goal.items()], "mix_no int, source string, goal double")
    hard = plan.where("source is not null").join(F.broadcast(goals), ["mix_no", "source"])
    hard = hard.withColumn("more", (F.col("whole") < F.col("cap")) & (F.col("tokens") <= F.col("goal"))).withColumn("large", F.col("tokens") > F.col("goal") / 64)
    # Documents that are large for their goal are decided first, to the tokens expected of them; the small ones fill what is left.
    key = ["mix_no", "source"]
    sure = hard.groupBy(*key, "goal").agg(F.sum(F.col("tokens") * F.col("whole")).alias("sure"), F.sum(F.when(F.col("more") & F.col("large"), F.col("tokens") * F.col("part")).otherwise(0.0)).alias("hoped"))
    sure = scratch.cut(sure)
    large = scratch.cut(_barred(hard.where("large"), sure.select(*key, F.least("hoped", F.col("goal") - F.col("sure")).alias("room"))))
    got = large.groupBy(*key).agg(F.sum(F.col("tokens") * (F.col("copies") - F.col("whole"))).alias("got"))
    rest = sure.join(got, key, "left").select(*key, (F.col("goal") - F.col("sure") - F.coalesce("got", F.lit(0))).alias("room"))
    picked = _barred(hard.where("not large"), rest).unionByName(large).select("mix_no", "doc_id", "source", "tokens", "cap", "copies", "member")
    out = _evened(scratch.cut(picked), goal).unionByName(soft).where("copies > 0")
    fit = spark.createDataFrame([(m, d, d < 0.002) for m, d in distance.items()], "mix_no int, distance double, converged boolean")
    return out.drop("cap").join(F.broadcast(fit), "mix_no").select("mix_no", "doc_id", "source", "tokens", "copies", "member", "distance", "converged")


def _barred(rows: DataFrame, rooms: DataFrame) -> DataFrame:
    """The rows with copies: the whole ones and one more for those below the bar of their mix and source, at which the
    tokens of one more meet the room. Rows are ordered by how far their fraction lacks the hash; the bar is found by a histogram of 4096
    ranges of it, of which only the one that the bar falls into is sorted."""
    key = ["mix_no", "source"]
    rows = rows.withColumn("h", F.floor((F.col("lack") + 1) * 2048))
    hist = rows.where("more").groupBy(*key, "h").agg(F.sum("tokens").alias("n"))
    before = Window.partitionBy(*key).orderBy("h").rowsBetween(Window.unboundedPreceding, -1)
    bars = hist.join(F.broadcast(rooms), key).select(*key, "h", "n", (F.col("room") - F.coalesce(F.sum("n").over(before), F.lit(0))).alias("room"))
    bars = bars.select(*key, "h", "room", (F.col("n") <= F.col("room")).alias("all"), (F.col("room") > 0).alias("some"))
    use = rows.join(bars, [*key, "h"], "left").withColumn("edge", F.col("more") & F.col("some") & ~F.col("all"))
    running = Window.partitionBy(*key, "h").orderBy("lack", F.xxhash64(F.lit(7), "doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    sorted_ = use.where("edge").withColumn("sum", F.coalesce(F.sum("tokens").over(running), F.lit(0))).withColumn("one", F.col("sum") + F.col("tokens") / 2 <= F.col("room")).drop("sum")
    plain = use.where("not coalesce(edge, false)").withColumn("one", F.coalesce(F.col("more") & F.col("all"), F.lit(False)))
    return sorted_.unionByName(plain).withColumn("copies", F.col("whole") + F.col("one").cast("long"))


def _evened(picked: DataFrame, goals: dict[tuple[int, str], tuple[float, float]], rounds: int = 12) -> DataFrame:
    """The picked copies after a few documents per mix and source were taken once more or once less.

    Each round looks, over all documents, for the one whose size is nearest to what a source is short of or has too
    much, and takes it even where that overshoots, as the next round then looks the other way among other sizes. The
    changes up to the nearest approach count. One document per mix, source and round comes to the driver, which keeps the account.
    """
    spark = picked.sparkSession
    changes: list[tuple[int, str, object, int]] = []
    fields = picked.select("mix_no", "source", "doc_id").schema
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields)

    def current():
        if not changes:
            return picked
        delta = spark.createDataFrame(changes, f"{kind}, delta long").groupBy("mix_no", "source", "doc_id").agg(F.sum("delta").alias("delta"))
        return picked.join(F.broadcast(delta), ["mix_no", "source", "doc_id"], "left").withColumn("copies", F.col("copies") + F.coalesce("delta", F.lit(0))).drop("delta")

    now = {(r[0], r[1]): r[2] for r in picked.groupBy("mix_no", "source").agg(F.sum(F.col("tokens") * F.col("copies"))).collect()}
    gaps = {k: goal - now.get(k, 0) for k, (goal, _) in goals.items()}
    enough = {m: 5e-4 * sum(g for (n, _), (g, _) in goals.items() if n == m) for m, _ in goals}
    best = {k: (abs(g), 0) for k, g in gaps.items()}  # distance and number of changes of the nearest approach
    made: dict[tuple[int, str], list] = {k: [] for k in gaps}
    for _ in range(rounds):
        far = [(m, s, float(g)) for (m, s), g in gaps.items() if best[m, s][0] > enough[m] and g]
        if not far:
            break
        changes = [c for done in made.values() for c in done]
        fit = current().where("doc_id is not null").join(F.broadcast(spark.createDataFrame(far, "mix_no int, source string, gap double")), ["mix_no", "source"])
        fit = fit.where("(gap > 0 and copies < cap) or (gap < 0 and copies > 0)")
        near = F.min(F.struct(F.abs(F.abs("gap") - F.col("tokens")).alias("left"), "doc_id", "tokens")).alias("b")
        found = fit.groupBy("mix_no", "source", "gap").agg(near).collect()
        if not found:
            break
        for r in found:
            k, sign = (r["mix_no"], r["source"]), 1 if r["gap"] > 0 else -1
            made[k].append((*k, r["b"]["doc_id"], sign))
            gaps[k] -= sign * r["b"]["tokens"]
            best[k] = min(best[k], (abs(gaps[k]), len(made[k])))
    changes = [c for k, done in made.items() for c in done[: best[k][1]]]
    return current()


def shares(chosen: DataFrame, targets: DataFrame) -> DataFrame:
    """Per mix and source: target share, actual tokens and share of all tokens, documents and most repeats; with what
    documents without source count for it, its expected share; the gap between that and the target share among the sources that
    hold anything, and whether the fit converged.

    A source named in the mix that holds nothing appears with 0 tokens; documents of unknown source appear under 'unknown'.
    """
    goal = targets.where("weight > 0 and source is not null").groupBy("mix_no", source_name(F.col("source")).alias("source")).agg(F.sum("weight").alias("weight"), F.min(F.coalesce("max_repeats", F.lit(1))).alias("max_repeats"))
    all_ = goal.groupBy("mix_no").agg(F.sum("weight").alias("all_weight"))
    got = chosen.groupBy("mix_no", F.coalesce("source", F.lit("unknown")).alias("source")).agg(
        F.count("*").alias("documents"), F.max("copies").alias("most_repeats"), F.sum(F.col("tokens") * F.col("copies")).alias("tokens")
    )
    total = got.groupBy("mix_no").agg(F.sum("tokens").alias("all_tokens"))
    parts = chosen.where("source is null").select("mix_no", (F.col("tokens") * F.col("copies")).alias("n"), F.explode("member").alias("source", "part"))
    soft = parts.groupBy("mix_no", "source").agg(F.sum(F.col("n") * F.col("part")).alias("soft_tokens"))
    fit = chosen.groupBy("mix_no").agg(F.min("converged").alias("converged"))
    held = goal.join(got, ["mix_no", "source"], "left_semi").groupBy("mix_no").agg(F.sum("weight").alias("held_weight"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    expected = (zero(F.col("tokens")) + zero(F.col("soft_tokens"))) / F.col("all_tokens")
    return (
        goal.join(all_, "mix_no")
        .join(got, ["mix_no", "source"], "full")
        .join(soft, ["mix_no", "source"], "left")
        .join(total, "mix_no", "left")
        .join(held, "mix_no", "left")
        .join(fit, "mix_no", "left")
        .select(
            "mix_no", "source", (F.col("weight") / F.col("all_weight")).alias("target_share"), "max_repeats",
            *[zero(F.col(c)).alias(c) for c in ("documents", "most_repeats", "tokens")],
            (zero(F.col("tokens")) / F.col("all_tokens")).alias("actual_share"),
            expected.alias("expected_share"),
            F.when(F.col("documents") > 0, expected - F.col("weight") / F.col("held_weight")).alias("gap"),
            F.col("converged"),
        )
    )
