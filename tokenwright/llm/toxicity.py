"""Toxicity: cumulative-link (proportional odds) regression on sparse text features.

P(grade > k) = sigmoid(w.x - theta_k) with theta_0 < theta_1 < ...: one weight vector serves all
thresholds.  Features are words and word beginnings with 1 + log of their counts.  Fitting reads a
bounded sample of labelled rows (`sample_rows`, the smallest hashes of doc_id); everything it
learns from is counted on executors, and only significant features reach the driver.

Labels of three or more levels are the grades, in their order; the lowest is the clean one.  Where
labels only say toxic or not (the greater of two values is toxic), grades 1..3 split the toxic sample
rows by how many words bear a feature that is significantly toxic (tertiles of the hits).

Defined cases: a null or wordless text has severity of the bare thresholds and is not rejected; a
text of any length is scored whole; a tie, P(toxic) = 0.5, is toxic; without usable labels of two
kinds every text has severity 0; rows of `labels` with a null are ignored, of several rows for an id
the worst counts; repeated rows are scored each; an empty table gives no rows; extra columns, whatever
their names, are ignored, or kept by `reject_toxic`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from . import kernel as K
from .common import quoted, slim, stored, trimmed

GRADES = 4
PREFIXES = (4, 5, 6)
U64 = K.U64


def features(data, off):
    """(row, feature hash) of every word and of its first 4, 5 and 6 bytes; whether a word."""
    data = K.fold(data)
    s, e, h, woff = K.words(data, off, K.NON_WORD)
    row = np.repeat(np.arange(len(off) - 1), np.diff(woff))
    rows, feats, word = [row], [h], [np.arange(len(h))]
    acc, ln = np.zeros(len(s), U64), e - s
    for i in range(max(PREFIXES)):
        acc = acc + K._BYTE[data[np.minimum(s + i, len(data) - 1)]] * K._POW[i] if len(s) else acc
        if i + 1 in PREFIXES:
            at = np.flatnonzero(ln > i + 1)
            rows.append(row[at])
            feats.append(K.mix(acc[at] ^ U64(i + 77)))
            word.append(at)
    return np.concatenate(rows), np.concatenate(feats), np.concatenate(word), len(h)


def _slices(b):
    data, off = K.buffers(b.column("text"))
    for i, j in K.row_slices(off):
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]


def _document_frequencies(batches):
    """Rows (feature, toxic rows, other rows) of a sample's batches."""
    for b in batches:
        tox = b.column("toxic").to_numpy(zero_copy_only=False).astype(bool)
        for i, j, data, off in _slices(b):
            row, feat, _, _ = features(data, off)
            order = np.lexsort((row, feat))
            f, r = feat[order], row[order]
            if not len(f):
                continue
            once = np.append(True, (f[1:] != f[:-1]) | (r[1:] != r[:-1]))
            f, t = f[once], tox[i:j][r[once]]
            at = np.flatnonzero(np.append(True, f[1:] != f[:-1]))
            yield pa.RecordBatch.from_arrays([pa.array(f[at].view(np.int64)), pa.array(np.add.reduceat(t.astype(np.int64), at)), pa.array(np.add.reduceat((~t).astype(np.int64), at))], names=["feature", "n1", "n0"])


class Lexicon:
    """Sorted feature hashes with a bit table in front."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.sort(keys.astype(U64))
        self.bits = np.zeros(1 << 16, bool)
        self.bits[(self.keys & U64(0xFFFF)).astype(np.int64)] = True

    def find(self, feats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions in feats, indexes into keys) of the features that are in the lexicon."""
        at = np.flatnonzero(self.bits[(feats & U64(0xFFFF)).astype(np.int64)])
        idx = np.minimum(np.searchsorted(self.keys, feats[at]), max(0, len(self.keys) - 1))
        ok = self.keys[idx] == feats[at] if len(self.keys) else np.zeros(len(at), bool)
        return at[ok], idx[ok]


def sparse_counts(lex: Lexicon, data, off):
    """(row, key index, count) of lexicon features in each row."""
    row, feat, _, _ = features(data, off)
    at, idx = lex.find(feat)
    code, cnt = np.unique(row[at] * (len(lex.keys) + 1) + idx, return_counts=True)
    return code // (len(lex.keys) + 1), code % (len(lex.keys) + 1), cnt


def _sample_counts(lex: Lexicon):
    def run(batches):
        for b in batches:
            tox = b.column("toxic").to_numpy(zero_copy_only=False)
            for i, j, data, off in _slices(b):
                r, k, c = sparse_counts(lex, data, off)
                o = np.searchsorted(r, np.arange(j - i + 1))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, j - i), pa.array(tox[i:j].astype(np.int32)), K.ragged(k.astype(np.int32), o, pa.int32()), K.ragged(c.astype(np.int32), o, pa.int32())], names=["doc_id", "toxic", "keys", "counts"])

    return run


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_ordinal(row, key, value, grade, dims: int, levels: int, l2: float = 2e-5, steps: int = 2500, rate: float = 0.1):
    """Weights and increasing thresholds by Adam on the cumulative-link likelihood.

    Thresholds are theta_0 plus exponentials of free gaps, so their order can't be lost."""
    n, t = len(grade), levels - 1
    p = np.zeros(dims + t)
    p[dims] = 1.0
    m, v = np.zeros_like(p), np.zeros_like(p)
    for i in range(1, steps + 1):
        w, theta = p[:dims], np.cumsum(np.concatenate([p[dims : dims + 1], np.exp(p[dims + 1 :])]))
        score = np.bincount(row, value * w[key], minlength=n)
        cum = sigmoid(score[:, None] - theta)  # P(grade > k)
        full = np.concatenate([np.ones((n, 1)), cum, np.zeros((n, 1))], axis=1)
        prob = np.maximum(np.take_along_axis(full, grade[:, None], 1) - np.take_along_axis(full, grade[:, None] + 1, 1), 1e-9)
        d = cum * (1 - cum)  # d cum / d (score - theta)
        low = (grade[:, None] == np.arange(t) + 1) * d  # raises P of its grade
        high = (grade[:, None] == np.arange(t)) * d
        part = (high - low) / prob  # d loss / d (score - theta_k)
        g = np.zeros_like(p)
        g[:dims] = np.bincount(key, value * part.sum(axis=1)[row], minlength=dims) / n + l2 * w
        tail = -part.mean(axis=0)
        tail = np.cumsum(tail[::-1])[::-1]
        g[dims:] = tail * np.concatenate([[1.0], np.exp(p[dims + 1 :])])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p -= rate * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.999**i)) + 1e-9)
    return p[:dims], np.cumsum(np.concatenate([p[dims : dims + 1], np.exp(p[dims + 1 :])]))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 8192, min_rows: int = 4, min_g2: float = 20.0):
    """(lexicon, weights, thresholds), or None where labels don't hold both kinds."""
    spark = docs.sparkSession
    worst = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna().groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = worst.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows).collect()
    clean = min((r.toxic for r in ids), default=0)
    chosen = spark.createDataFrame([(r.doc_id, r.toxic) for r in ids], "doc_id long, toxic int")  # at most sample_rows rows
    sample = stored(docs.join(F.broadcast(chosen), "doc_id"))
    sizes = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n0 = sizes.get(clean, 0)
    n1 = sum(sizes.values()) - n0
    if not n1 or not n0:
        return None
    binary = sample.withColumn("toxic", (F.col("toxic") > clean).cast("int"))
    counts = binary.mapInArrow(trimmed(_document_frequencies), "feature long, n1 long, n0 long").groupBy("feature").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0")).where(F.col("n1") + F.col("n0") >= min_rows)
    xlogx = lambda x, e: F.when(x > 0, x * F.log(x / e)).otherwise(0.0)
    tot = F.col("n1") + F.col("n0")
    e1, e0 = tot * (n1 / (n1 + n0)), tot * (n0 / (n1 + n0))
    g2 = 2 * (xlogx(F.col("n1"), e1) + xlogx(F.col("n0"), e0))
    # the words of at most sample_rows rows bound how many features there are
    picked = counts.withColumn("g2", g2).where(F.col("g2") >= min_g2).select("feature").toPandas()
    lex = Lexicon(picked["feature"].to_numpy(np.int64).view(U64))
    if not len(lex.keys):
        return None
    got = sample.mapInArrow(trimmed(_sample_counts(lex)), "doc_id long, toxic int, keys array<int>, counts array<int>").orderBy("doc_id", "toxic").toArrow()
    lens = np.array([len(x) for x in got.column("keys").to_pylist()])
    key = np.concatenate([np.asarray(x, np.int64) for x in got.column("keys").to_pylist()] or [np.zeros(0, np.int64)])
    cnt = np.concatenate([np.asarray(x, np.int64) for x in got.column("counts").to_pylist()] or [np.zeros(0, np.int64)])
    label = got.column("toxic").to_numpy()
    levels = np.unique(label)
    tox = label > clean
    row = np.repeat(np.arange(len(lens)), lens)
    if len(levels) > 2:
        grade, grades = np.searchsorted(levels, label), len(levels)
    else:
        hits = np.bincount(row, cnt, minlength=len(lens))
        cuts = np.quantile(hits[tox], [1 / 3, 2 / 3])
        grade, grades = np.where(tox, 1 + (hits[:, None] > cuts).sum(axis=1), 0), GRADES
    w, theta = fit_ordinal(row, key, 1 + np.log(np.maximum(cnt, 1)), grade, len(lex.keys), grades)
    return lex, w, theta


def severity(score: np.ndarray, theta: np.ndarray):
    """(expected severity, most likely grade, P(grade > 0))."""
    cum = sigmoid(score[:, None] - theta)
    full = np.concatenate([np.ones((len(score), 1)), cum, np.zeros((len(score), 1))], axis=1)
    return cum.sum(axis=1), (full[:, :-1] - full[:, 1:]).argmax(axis=1), cum[:, 0]


def _score(model):
    lex, w, theta = model

    def run(batches):
        for b in batches:
            parts = [np.zeros(0)]
            for i, j, data, off in _slices(b):
                r, k, c = sparse_counts(lex, data, off)
                parts.append(np.bincount(r, (1 + np.log(np.maximum(c, 1))) * w[k], minlength=j - i))
            ex, grade, p = severity(np.concatenate(parts), theta)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ex), pa.array(grade.astype(np.int32)), pa.array(p >= 0.5)], names=["doc_id", "severity", "grade", "is_toxic"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int = 8192, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: (doc_id, severity, grade, is_toxic)."""
    d = slim(docs, id_col, text_col)
    model = train(d, labels, sample_rows)
    if model is None:
        return d.select("doc_id", F.lit(0.0).alias("severity"), F.lit(0).alias("grade"), F.lit(False).alias("is_toxic"))
    return d.mapInArrow(trimmed(_score(model)), "doc_id long, severity double, grade int, is_toxic boolean")


def reject_toxic(docs: DataFrame, labels: DataFrame, sample_rows: int = 8192) -> DataFrame:
    """The rows of `docs` that are not toxic, columns unchanged: decided row by row, no shuffle."""
    model = train(slim(docs), labels, sample_rows)
    if model is None:
        return docs
    lex, w, theta = model

    def run(batches):
        for b in batches:
            text = b.column("text")
            data, off = K.buffers(text)
            keep = [np.zeros(0, bool)]
            for i, j in K.row_slices(off):
                r, k, c = sparse_counts(lex, data[off[i] : off[j]], off[i : j + 1] - off[i])
                keep.append(severity(np.bincount(r, (1 + np.log(np.maximum(c, 1))) * w[k], minlength=j - i), theta)[2] < 0.5)
            yield b.drop_columns(["text"]).filter(pa.array(np.concatenate(keep)))

    # columns go by their places, whatever their names
    kinds = StructType([StructField(f"c{k}", f.dataType, f.nullable) for k, f in enumerate(docs.schema)])
    placed = docs.select([F.col(quoted(c)).alias(f"c{k}") for k, c in enumerate(docs.columns)] + [F.col("text").cast("string").alias("text")])
    return placed.mapInArrow(trimmed(run), kinds).toDF(*docs.columns)
