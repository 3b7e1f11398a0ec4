"""Near-duplicates: MinHash with tensored banding, verified by exact Jaccard similarity.

Documents are sets of runs of three words.  Two collections of `bands` half-keys each are made of
`rows` minima per half-key; a table key joins half-key i of one with half-key j of the other, so
2 * bands * rows minima serve bands ** 2 tables of 2 * rows rows, about the square root of what as
many independent tables need.  With the defaults (12, 2) 48 minima serve 144 tables, and a pair of
similarity s meets in one of them with probability (1 - (1 - s**2)**12)**2: 0.94 at 0.5, 0.99 at 0.6.
A table key is only formed of half-keys that some other text has too, which most texts lack.

Texts of the same words are one node first.  Then every bucket compares its members with its
smallest one; members that are still in different groups after that, if they meet in any bucket,
are compared pair by pair, hot buckets in cells of a bounded size.  All pairs are compared by their
whole sets.  What is skipped are pairs already known to be of one group, so groups are the connected
components of all verified candidate pairs, with no cap on bucket or group.

Defined cases: null and wordless texts are in no group and stay; rows that share id and text are
repeated rows, of which one stays; an id that has several texts is decided for each of them; a null
id is a document like others and comes after all ids; the smallest id of a group is kept, of several
texts of that id the one with the smallest digest; a text under three words is one run, a text of
any length is compared whole; an empty table gives no rows; extra columns, whatever their names, are
ignored, or kept by `drop_near`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .common import bucket_pairs, components, may_hold, member_filter, slim, stored, trimmed, without

SHINGLE = 3
U64 = K.U64


def md5(text: Column) -> Column:
    return F.unhex(F.md5(text))


def multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and masks of n hash permutations of 32 bits."""
    raw = K.mix(np.arange(1, 2 * n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))
    return (raw[:n] >> U64(32)).astype(np.uint32) | np.uint32(1), (raw[n:] >> U64(32)).astype(np.uint32)


def minima(hashes: np.ndarray, off: np.ndarray, n: int) -> np.ndarray:
    """rows x n minima of permuted 32-bit hashes."""
    h = (hashes >> U64(32)).astype(np.uint32)
    out = np.empty((len(off) - 1, n), np.uint32)
    for k, (a, x) in enumerate(zip(*multipliers(n))):
        out[:, k] = K.segment_reduce(np.minimum, (h ^ x) * a, off, np.uint32(0xFFFFFFFF))
    return out


def half_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """rows x (2 * bands) half-keys."""
    acc = np.zeros((len(sig), 2 * bands), U64)
    parts = sig.reshape(len(sig), 2 * bands, rows).astype(U64)
    for r in range(rows):
        acc = K.mix(acc * U64(0xD6E8FEB86659FD93) + parts[:, :, r] + U64(1))
    return acc


def _pieces(b):
    data, off = K.buffers(b.column("text"))
    for i, j in K.row_slices(off):
        _, _, h, woff = K.words(K.fold(data[off[i] : off[j]]), off[i : j + 1] - off[i], K.NON_WORD)
        yield i, j, h, woff


def _sketch(bands: int, rows: int):
    """Rows get a number of their own; `same` is the hash of the words in their order."""

    def run(batches):
        nr = TaskContext.get().partitionId() << 36
        for b in batches:
            for i, j, h, woff in _pieces(b):
                pos = np.arange(len(h)) - np.repeat(woff[:-1], np.diff(woff))
                same = K.segment_reduce(np.add, K.mix(h + K.mix(pos.astype(U64) + U64(1))), woff, U64(0))
                sig = minima(*K.shingles(h, woff, SHINGLE), 2 * bands * rows)
                halves = half_keys(sig, bands, rows).view(np.int64)
                cols = [b.column("doc_id").slice(i, j - i), b.column("digest").slice(i, j - i), pa.array(same.view(np.int64)), pa.array(np.diff(woff)), K.ragged(halves.ravel(), np.arange(j - i + 1) * 2 * bands, pa.int64()), pa.array(np.arange(nr, nr + j - i))]
                nr += j - i
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "digest", "same", "words", "halves", "nr"]).filter(pa.array(np.diff(woff) > 0))

    return run


def _sets(bits):
    """Distinct runs of the rows that may be members; a row that isn't goes with the join."""

    def run(batches):
        for b in batches:
            b = b.filter(pa.array(may_hold(bits.value, b.column("k").to_numpy())))
            for i, j, h, woff in _pieces(b):
                s, soff = K.shingles(h, woff, SHINGLE)
                row = np.repeat(np.arange(j - i, dtype=U64), np.diff(soff))
                code = np.sort(row << U64(32) | s >> U64(32))
                if len(code):
                    code = code[np.append(True, code[1:] != code[:-1])]
                o = np.searchsorted(code >> U64(32), np.arange(j - i + 1, dtype=U64))
                runs = K.ragged((code & U64(0xFFFFFFFF)).astype(np.uint32).view(np.int32), o, pa.int32())
                yield pa.RecordBatch.from_arrays([b.column("k").slice(i, j - i), b.column("doc_id").slice(i, j - i), b.column("digest").slice(i, j - i), runs], names=["k", "doc_id", "digest", "runs"])

    return run


def _verify(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b) of similarity >= threshold."""
    both = pairs.join(sets.select(F.col("node").alias("b"), F.col("runs").alias("rb")), "b").join(sets.select(F.col("node").alias("a"), F.col("runs").alias("ra")), "a")
    na, nb = F.size("ra"), F.size("rb")
    fits = both.where(F.least(na, nb) >= threshold * F.greatest(na, nb)).withColumn("n", F.size(F.array_intersect("ra", "rb")))
    return fits.where(F.col("n") >= threshold * (na + nb - F.col("n"))).select("a", "b")


def _buckets(nodes: DataFrame, bands: int) -> DataFrame:
    """(key, node, low) of the table keys that several nodes share; low is the smallest of them."""
    half = F.xxhash64("pos", "half")
    halves = nodes.select("node", F.posexplode("halves").alias("pos", "half")).select("node", "pos", half.alias("half"))
    shared = halves.groupBy("half").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("half")
    alive = halves.join(shared, "half").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("pos", "half"))).alias("alive"))  # at most 2 * bands
    first, second = F.filter("alive", lambda x: x["pos"] < bands), F.filter("alive", lambda x: x["pos"] >= bands)
    keys = F.flatten(F.transform(first, lambda x: F.transform(second, lambda y: F.xxhash64(x["half"], y["half"]))))
    keyed = alive.select("node", F.explode(keys).alias("key"))
    low = keyed.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("key", "low")
    return stored(keyed.join(low, "key"))


def _groups(docs: DataFrame, threshold: float, bands: int, rows: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, digest, n, root, links) of every document: n repeated rows, its group, and the
    verified near texts of its own."""
    d = slim(docs, id_col, text_col).where("text is not null").withColumn("digest", md5(F.col("text")))
    sketches = stored(d.mapInArrow(trimmed(_sketch(bands, rows)), "doc_id long, digest binary, same long, words long, halves array<long>, nr long"))
    nodes = stored(sketches.groupBy("same", "words").agg(F.min("nr").alias("node"), F.first("halves").alias("halves")))
    buckets = _buckets(nodes, bands)
    hashed = F.xxhash64("doc_id", "digest")
    # of every node, the text of its first row
    members = stored(buckets.select(F.col("node").alias("nr")).distinct().join(sketches.select("nr", "doc_id", "digest", hashed.alias("k")), "nr"))
    found = d.withColumn("k", hashed).mapInArrow(trimmed(_sets(member_filter(members))), "k long, doc_id long, digest binary, runs array<int>")
    at = found.alias("x").join(members.alias("m"), (F.col("x.k") == F.col("m.k")) & (F.col("x.digest") == F.col("m.digest")) & F.col("x.doc_id").eqNullSafe(F.col("m.doc_id")))
    sets = stored(at.groupBy(F.col("m.nr").alias("node")).agg(F.first("x.runs").alias("runs")))
    star = buckets.where("node <> low").select(F.col("low").alias("a"), F.col("node").alias("b")).distinct()
    edges = stored(_verify(star, sets, threshold))
    roots = components(edges)
    # buckets that hold several groups still: their pairs across groups are compared one by one
    rooted = buckets.join(roots, "node", "left").select("key", "node", "low", F.coalesce("root", "node").alias("root"))
    mixed = rooted.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 < r1").select("key")
    rest = bucket_pairs(rooted.join(mixed, "key").select("key", "node", "root"), ["key"]).select("a", "b").distinct().join(star, ["a", "b"], "left_anti")
    links = stored(edges.union(_verify(rest, sets, threshold)))
    roots = components(links)
    degrees = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("links"))
    entries = sketches.groupBy("same", "words", "doc_id", "digest").agg(F.count(F.lit(1)).alias("n"))
    placed = entries.join(nodes.select("same", "words", "node"), ["same", "words"]).join(roots, "node", "left").join(degrees, "node", "left")
    return stored(placed.select("doc_id", "digest", "n", F.coalesce("root", "node").alias("root"), F.coalesce("links", F.lit(0)).alias("links")))


def _members(docs: DataFrame, threshold: float, bands: int, rows: int, id_col: str, text_col: str) -> DataFrame:
    """Documents of groups of several rows, with keep_id, group_size and is_kept."""
    groups = _groups(docs, threshold, bands, rows, id_col, text_col)
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "digest")
    heads = groups.groupBy("root").agg(F.count(F.lit(1)).alias("group_size"), F.sum("n").alias("rows"), F.min(rank).alias("head")).where("rows > 1")
    both = groups.join(heads, "root")
    kept = F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("digest") == F.col("head.digest"))
    return both.select("doc_id", "digest", "n", F.col("head.doc_id").alias("keep_id"), "group_size", "links", kept.alias("is_kept"))


def near_dedup(docs: DataFrame, threshold: float = 0.5, bands: int = 12, rows: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, links, is_kept): one row for each document that has near-
    duplicates.  keep_id is the class, links the number of verified pairs of its text with others."""
    return _members(docs, threshold, bands, rows, id_col, text_col).where("group_size > 1").select("doc_id", "keep_id", "group_size", "links", "is_kept")


def drop_near(docs: DataFrame, threshold: float = 0.5, bands: int = 12, rows: int = 2) -> DataFrame:
    """The rows of `docs` without those that another document of their group stands for."""
    found = _members(docs, threshold, bands, rows, "doc_id", "text")
    marks = found.where("not is_kept or n > 1").select(F.col("doc_id").alias("id"), "digest", (~F.col("is_kept")).alias("gone"))
    return without(docs, marks, md5)
