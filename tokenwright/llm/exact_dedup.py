"""Exact dedup by tree-merge of sorted digest runs.

Every partition sorts its entries (SHA-256, byte length, smallest id, rows) into runs.  Node
addresses have R digits in base m; in round k every node splits its runs by digit k of the digest's
address and hands piece j to the node whose digit k is j, which merges the runs it gets.  An entry
keeps the smallest id and the number of rows at every level, so copies are one entry as soon as
their runs meet, and a text copied a billion times weighs no more than any other.  After R rounds a
node has the whole count of each digest with its address.  Copies are equal in all 256 bits and in
byte length, which every merge verifies.

Defined cases: a null text is no copy of anything (kept, alone); an empty text is a text like any
other, and a text of any length is digested whole; a null id sorts after all ids, and keep_id is null
only where all ids of a text are; of repeated rows (same id, same text) exactly one is kept, and where
they differ in other columns it is any one of them; an empty table gives no rows; extra columns,
whatever their names, are ignored, or kept by `drop_copies`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slim, stored, trimmed, without

LAST = np.iinfo(np.int64).max  # stands for an unknown id within a minimum; `known` tells it from a real one
BLOCK = 1 << 16
RUN = 1 << 20  # entries of a run that a partition sorts at once
REPEAT = 1 << 16
_RUN = "node int, digests binary, lens binary, counts binary, ids binary, known binary"
_CLASS = "digest binary, len long, keep_id long, copies long"


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def address_digits(partitions: int, fan_in: int = 8) -> tuple[int, int]:
    """(m, R) with m**R nodes, at least as many as partitions, and m at most fan_in."""
    rounds = 1
    while fan_in**rounds < partitions:
        rounds += 1
    m = 2
    while m**rounds < partitions:
        m += 1
    return m, rounds


def _order(d: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Order of concatenated sorted runs.  The stable sort of 64-bit words finds the runs and merges
    them, all at once; entries that share the word but not the rest are rare and sorted in full."""
    order = np.argsort(d[:, 0], kind="stable")
    s, ln = d[order], lens[order]
    tie = s[1:, 0] == s[:-1, 0]
    if (tie & ((s[1:] != s[:-1]).any(axis=1) | (ln[1:] != ln[:-1]))).any():
        order = np.lexsort((lens, d[:, 3], d[:, 2], d[:, 1], d[:, 0]))
    return order


def merge_runs(digest: np.ndarray, lens: np.ndarray, counts: np.ndarray, ids: np.ndarray, known: np.ndarray):
    """Multiway merge of concatenated sorted runs, equal entries as one; digest is (n, 4) big-endian words."""
    order = _order(digest, lens)
    d, ln = digest[order], lens[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]).any(axis=1) | (ln[1:] != ln[:-1])
    at = np.flatnonzero(new)
    ok = known[order].astype(bool)
    least = np.minimum.reduceat(np.where(ok, ids[order], LAST), at)
    return d[at], ln[at], np.add.reduceat(counts[order], at), least, np.logical_or.reduceat(ok, at).astype(np.uint8)


def _split(run, node: int, k: int, m: int):
    digit = (run[0][:, 0] // np.uint64(m**k)) % np.uint64(m)
    base = node - (node // m**k % m) * m**k
    for j in range(m):
        own = np.flatnonzero(digit == j)
        for lo in range(0, len(own), BLOCK):
            yield base + j * m**k, *(x[own[lo : lo + BLOCK]] for x in run)


def _pack(pieces) -> pa.RecordBatch:
    pieces = list(pieces)
    blobs = [[p[1].astype(">u8").tobytes() for p in pieces], *([p[i].astype("<i8").tobytes() for p in pieces] for i in (2, 3, 4)), [p[5].tobytes() for p in pieces]]
    return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pieces], pa.int32())] + [pa.array(c, pa.binary()) for c in blobs], names=["node", "digests", "lens", "counts", "ids", "known"])


def _local_runs(m: int, rounds: int):
    def run(batches):
        held, size = [], 0
        node = TaskContext.get().partitionId() % m**rounds

        def flush():
            return _pack(_split(merge_runs(*(np.concatenate(x) for x in zip(*held))), node, 0, m))

        for b in batches:
            if not b.num_rows:
                continue
            ids = b.column("doc_id")
            digest = np.frombuffer(b"".join(b.column("digest").to_pylist()), ">u8").reshape(-1, 4).astype(np.uint64)
            number = lambda c: b.column(c).to_numpy(zero_copy_only=False).astype(np.int64)  # noqa: E731, B023
            held.append((digest, number("len"), number("n"), ids.fill_null(LAST).to_numpy(zero_copy_only=False), np.asarray(ids.is_valid()).astype(np.uint8)))
            size += b.num_rows
            if size >= RUN:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    return run


def _gather(batches):
    """Merged runs of a partition by node."""
    got: dict[int, list] = {}
    for b in batches:
        for node, *blobs in zip(*(c.to_pylist() for c in b.columns)):
            got.setdefault(node, []).append(blobs)
    for node in sorted(got):
        rows = got.pop(node)
        words = np.concatenate([np.frombuffer(r[0], ">u8").reshape(-1, 4).astype(np.uint64) for r in rows])
        yield node, merge_runs(words, *(np.concatenate([np.frombuffer(r[i], "<i8") for r in rows]) for i in (1, 2, 3)), np.concatenate([np.frombuffer(r[4], np.uint8) for r in rows]))


def _round(k: int, m: int):
    def run(batches):
        for node, merged in _gather(batches):
            yield _pack(_split(merged, node, k, m))

    return run


def _finish(batches):
    """Digests of several rows."""
    for _, (d, ln, cnt, ids, known) in _gather(batches):
        several = np.flatnonzero(cnt > 1)
        for lo in range(0, len(several), BLOCK):
            at = several[lo : lo + BLOCK]
            raw = d[at].astype(">u8").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([raw[32 * i : 32 * i + 32] for i in range(len(at))], pa.binary()), pa.array(ln[at]), pa.array(ids[at], mask=known[at] == 0), pa.array(cnt[at])], names=["digest", "len", "keep_id", "copies"])


def _entries(d: DataFrame) -> DataFrame:
    """(doc_id, digest, len, n), one row for each id and text: repeated rows are counted."""
    keyed = d.where("text is not null").select("doc_id", sha256(F.col("text")).alias("digest"), F.octet_length("text").cast("long").alias("len"))
    return stored(keyed.groupBy("doc_id", "digest", "len").agg(F.count(F.lit(1)).alias("n")))


def _marked(entries: DataFrame, fan_in: int) -> DataFrame:
    """Entries with (keep_id, copies) of their text, by the tree.  Only texts of several rows are in
    the join, which AQE splits where one of them is hot."""
    m, rounds = address_digits(int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions")), fan_in)
    runs = entries.mapInArrow(trimmed(_local_runs(m, rounds)), _RUN)
    for k in range(1, rounds):
        runs = runs.repartitionById(m**rounds, F.col("node")).mapInArrow(trimmed(_round(k, m)), _RUN)
    classes = runs.repartitionById(m**rounds, F.col("node")).mapInArrow(trimmed(_finish), _CLASS)
    both = entries.join(classes, ["digest", "len"], "left")
    return both.select("doc_id", "digest", "n", F.when(F.col("copies").isNotNull(), F.col("keep_id")).otherwise(F.col("doc_id")).alias("keep_id"), F.coalesce("copies", "n").alias("copies"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = 8) -> DataFrame:
    """One row for each input row: (doc_id, digest, keep_id, copies, is_kept).

    keep_id is the smallest id with the same text, copies the rows that share it."""
    d = slim(docs, id_col, text_col)
    marked = _marked(_entries(d), fan_in)
    # an entry of n rows becomes n rows again, in steps, so that no array grows with n
    step = marked.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(REPEAT).cast("long"))))
    rows = step.withColumn("nr", F.explode(F.sequence("at", F.least(F.col("n"), F.col("at") + REPEAT) - 1)))
    out = rows.select("doc_id", "digest", "keep_id", "copies", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("nr") == 0)).alias("is_kept"))
    alone = d.where("text is null").select("doc_id", F.lit(None).cast("binary").alias("digest"), F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("copies"), F.lit(True).alias("is_kept"))
    return out.unionByName(alone)


def drop_copies(docs: DataFrame, fan_in: int = 8) -> DataFrame:
    """The rows of `docs` without later copies, all columns unchanged."""
    marked = _marked(_entries(slim(docs)), fan_in)
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    marks = marked.where(~kept | (F.col("n") > 1)).select(F.col("doc_id").alias("id"), "digest", (~kept).alias("gone"))
    return without(docs, marks, sha256)
