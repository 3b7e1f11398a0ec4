"""Quality: expectation-maximisation over weak heuristic labellers, then a hashed linear scorer.

Seven overlapping labellers vote good, bad or abstain on every document.  What EM needs is how often
each vote pattern occurs, so one grouped count over the whole corpus feeds it and the driver holds
at most 3**7 patterns.  EM estimates the class balance and each labeller's vote table (its accuracy)
with no labels at all.  The posterior of a document's pattern then is the target for a linear scorer
on hashed byte trigrams and statistics buckets, fitted on a bounded sample (`sample_rows`, the
smallest hashes of doc_id) and applied to every document.

Defined cases: a null or wordless text is not kept (score 0, posterior by its pattern); a text of any
length is scored whole; ties at 0.5 are kept; repeated rows are scored each, and fill the sample like
others; rows without an id are scored, not sampled (without any id all scores are 0); an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .common import slim, stored, trimmed

DIMS = 1 << 14
U64 = K.U64
ABSTAIN, BAD, GOOD = 0, 1, 2
STATS = ("symbols", "shouting", "capitals", "repeated words", "pair repeats", "word length", "stops")
# (bad above, good below); the last two are bands: bad outside the first pair, good inside the second
LIMITS = ((0.05, 0.01), (0.02, 0.004), (0.4, 0.12), (0.85, 0.7), (0.5, 0.15))
BANDS = (((2.0, 14.0), (2.8, 9.0)), ((0.008, 0.6), (0.02, 0.35)))
EDGES = tuple(np.array(x) for x in ((0.002, 0.01, 0.03, 0.05, 0.1, 0.2), (0.001, 0.004, 0.01, 0.02, 0.05), (0.02, 0.06, 0.12, 0.25, 0.4, 0.7), (0.3, 0.5, 0.7, 0.8, 0.9), (0.02, 0.05, 0.15, 0.3, 0.5, 0.8), (2.0, 2.8, 4.0, 6.0, 9.0, 14.0), (0.004, 0.01, 0.02, 0.05, 0.1, 0.35)))

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "|%$#*&<>{}[]_=~^\\@+/"]] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".?!"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = ~K.NON_WORD
_LETTER[48:58] = False


def _per_row(flags, off):
    c = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return c[off[1:]] - c[off[:-1]]


def statistics(data, off) -> tuple[np.ndarray, np.ndarray]:
    """(rows x 7 statistics, word counts)."""
    s, e, h, woff = K.words(K.fold(data), off, K.NON_WORD)
    n = np.maximum(np.diff(off), 1)
    nw = np.diff(woff)
    w1 = np.maximum(nw, 1)
    distinct = K.row_distinct(h, woff)
    pairs, poff = K.shingles(h, woff, 2)
    npair = np.maximum(np.diff(poff), 1)
    return np.stack([
        _per_row(_SYMBOL[data], off) / n,
        _per_row(data == 33, off) / n,
        _per_row(_UPPER[data], off) / np.maximum(_per_row(_LETTER[data], off), 1),
        1 - distinct / w1,
        1 - K.row_distinct(pairs, poff) / npair,
        K.segment_reduce(np.add, (e - s).astype(np.int64), woff, 0) / w1,
        _per_row(_STOP[data], off) / n,
    ], axis=1), nw


def votes(stats: np.ndarray, nw: np.ndarray) -> np.ndarray:
    """rows x labellers of ABSTAIN, BAD, GOOD; texts under 8 words leave repetition undecided."""
    out = np.zeros(stats.shape, np.int8)
    for k, (bad, good) in enumerate(LIMITS):
        out[:, k] = np.where(stats[:, k] > bad, BAD, np.where(stats[:, k] < good, GOOD, ABSTAIN))
    for k, ((lo, hi), (a, b)) in enumerate(BANDS, len(LIMITS)):
        x = stats[:, k]
        out[:, k] = np.where((x < lo) | (x > hi), BAD, np.where((x >= a) & (x <= b), GOOD, ABSTAIN))
    out[nw < 8, 3:5] = ABSTAIN
    out[nw == 0] = BAD
    return out


def pattern(v: np.ndarray) -> np.ndarray:
    return (v.astype(np.int64) * 3 ** np.arange(v.shape[1])).sum(axis=1)


def fit_labellers(codes: np.ndarray, counts: np.ndarray, labellers: int = len(STATS), rounds: int = 200, start: float = 0.8):
    """EM over vote patterns: (P(good), tables[labeller, class, vote], posterior of each code).

    Starts from labellers that are right `start` of the time; half a count smooths every cell."""
    v = codes[:, None] // 3 ** np.arange(labellers) % 3
    onehot = (v[:, :, None] == np.arange(3)).astype(float)
    prior = 0.5
    tab = np.empty((labellers, 2, 3))
    tab[:, 0] = [0.4, 0.6 * start, 0.6 * (1 - start)]
    tab[:, 1] = [0.4, 0.6 * (1 - start), 0.6 * start]
    post = np.zeros(len(codes))
    for _ in range(rounds):
        ll = np.einsum("plv,lcv->pc", onehot, np.log(tab)) + np.log([1 - prior, prior])
        new = 1 / (1 + np.exp(np.clip(ll[:, 0] - ll[:, 1], -500, 500)))
        if np.abs(new - post).max(initial=0) < 1e-9:
            break
        post = new
        mass = np.stack([counts * (1 - post), counts * post])
        prior = float(np.clip(mass[1].sum() / max(counts.sum(), 1), 1e-4, 1 - 1e-4))
        tab = np.einsum("cp,plv->lcv", mass, onehot) + 0.5
        tab /= tab.sum(axis=2, keepdims=True)
    return prior, tab, post


def hashed(data, off, stats):
    """(positions' hashed trigram, row offsets of positions, rows x 7 hashed buckets)."""
    n = np.diff(off)
    data = data.astype(np.uint32)
    tri = (data[:-2] * np.uint32(0x9E3779B1) ^ data[1:-1] * np.uint32(0x85EBCA6B) ^ data[2:] * np.uint32(0xC2B2AE35)) if len(data) > 2 else np.zeros(0, np.uint32)
    tri = ((tri * np.uint32(0x27D4EB2F)) >> np.uint32(18)).astype(np.int32)
    if len(tri) < len(data):
        tri = np.append(tri, np.zeros(len(data) - len(tri), np.int32))
    valid = np.ones(len(data), bool)  # the last two positions of a row would read into the next
    for back in (1, 2):
        at = off[1:] - back
        valid[at[(at >= off[:-1]) & (n > 0)]] = False
    toff = np.concatenate([[0], np.cumsum(valid)])[off]
    buckets = np.stack([k * 16 + np.searchsorted(EDGES[k], stats[:, k]) for k in range(len(STATS))], axis=1)
    return tri[valid], toff, buckets


def _rows(b):
    data, off = K.buffers(b.column("text"))
    for i, j in K.row_slices(off):
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]


def _patterns(batches):
    for b in batches:
        for i, j, data, off in _rows(b):
            st, nw = statistics(data, off)
            code, cnt = np.unique(pattern(votes(st, nw)), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(cnt)], names=["code", "n"])


def _sample(batches):
    for b in batches:
        for i, j, data, off in _rows(b):
            st, nw = statistics(data, off)
            tri, toff, buckets = hashed(data, off, st)
            r, t, c = K.row_counts(tri.astype(np.int64), toff)
            o = np.searchsorted(r, np.arange(j - i + 1))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").slice(i, j - i), pa.array(pattern(votes(st, nw))), K.ragged(t.astype(np.int32), o, pa.int32()), K.ragged((c / np.maximum(np.diff(toff), 1)[r]).astype(np.float32), o, pa.float32()), K.ragged(buckets.ravel().astype(np.int32), np.arange(j - i + 1) * len(STATS), pa.int32())],
                names=["doc_id", "code", "grams", "shares", "buckets"],
            )


def fit_linear(row, gram, share, buckets, target, steps: int = 300, rate: float = 0.1, l2: float = 1e-4):
    """Logistic regression on soft targets: (gram weights, bucket weights, bias), by Adam."""
    n = len(target)
    scale = 30.0  # trigram shares are small numbers
    p = np.zeros(DIMS + 16 * len(STATS) + 1)
    m, v = np.zeros_like(p), np.zeros_like(p)
    brow = np.repeat(np.arange(n), buckets.shape[1])
    bidx = buckets.ravel() + DIMS
    for i in range(1, steps + 1):
        z = np.bincount(row, share * scale * p[gram], minlength=n) + np.bincount(brow, p[bidx], minlength=n) + p[-1]
        d = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - target) / n
        g = np.bincount(gram, share * scale * d[row], minlength=len(p)) + np.bincount(bidx, d[brow], minlength=len(p)) + l2 * p
        g[-1] = d.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p -= rate * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.999**i)) + 1e-9)
    return p[:DIMS] * scale, p[DIMS:-1], p[-1]


def _score(model, posterior: dict):
    wg, wb, bias = model

    def run(batches):
        for b in batches:
            score, post = [np.zeros(0)], [np.zeros(0)]
            for i, j, data, off in _rows(b):
                st, nw = statistics(data, off)
                tri, toff, buckets = hashed(data, off, st)
                z = K.segment_reduce(np.add, wg[tri], toff, 0.0) / np.maximum(np.diff(toff), 1) + wb[buckets].sum(axis=1) + bias
                score.append(np.where(nw > 0, 1 / (1 + np.exp(-np.clip(z, -40, 40))), 0.0))
                post.append(np.array([posterior.get(int(c), 0.5) for c in pattern(votes(st, nw))], float))
            s = np.concatenate(score)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.concatenate(post)), pa.array(s), pa.array(s >= 0.5)], names=["doc_id", "weak_label", "quality", "keep"])

    return run


def quality(docs: DataFrame, sample_rows: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: (doc_id, weak_label, quality, keep).

    weak_label is the labellers' posterior of good, quality the linear scorer's probability."""
    d = slim(docs, id_col, text_col)
    seen = d.mapInArrow(trimmed(_patterns), "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toPandas().sort_values("code")
    codes, counts = seen["code"].to_numpy(np.int64), seen["n"].to_numpy(float)
    if not len(codes):
        return d.select("doc_id", F.lit(0.0).alias("weak_label"), F.lit(0.0).alias("quality"), F.lit(False).alias("keep"))
    _, _, post = fit_labellers(codes, counts)
    posterior = dict(zip(codes.tolist(), post.tolist()))
    chosen = d.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)  # a bounded heap in each task
    ids = sorted({r.doc_id for r in chosen.collect() if r.doc_id is not None})
    pick = docs.sparkSession.createDataFrame([(i,) for i in ids], "doc_id long")  # at most sample_rows rows
    rows = stored(d.join(F.broadcast(pick), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows))
    got = rows.mapInArrow(trimmed(_sample), "doc_id long, code long, grams array<int>, shares array<float>, buckets array<int>").orderBy("doc_id", "code").toArrow().combine_chunks()
    if not got.num_rows:
        return d.select("doc_id", F.lit(0.0).alias("weak_label"), F.lit(0.0).alias("quality"), F.lit(False).alias("keep"))
    flat = lambda c: got.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False)
    lens = np.asarray(got.column("grams").combine_chunks().value_lengths())
    target = np.array([posterior.get(c, 0.5) for c in got.column("code").to_pylist()])
    model = fit_linear(np.repeat(np.arange(len(lens)), lens), flat("grams"), flat("shares").astype(float), flat("buckets").reshape(-1, len(STATS)), target)
    return d.mapInArrow(trimmed(_score(model, posterior)), "doc_id long, weak_label double, quality double, keep boolean")
