"""Document fingerprints: SimHash over weighted term hashes, and an exact search for all
fingerprints within a Hamming radius by permuted block tables.

A term is a run of three words; it votes with 1 + log2 of its count on each of 64 signed bits.
Equal fingerprints are one node of the search, so a text copied a million times costs it nothing,
and each distinct fingerprint is a query.  For radius r the 64 bits are cut into b blocks; two
fingerprints within r agree on at least b - r of them, so a table for each choice of b - r blocks,
keyed by their bits, holds every pair.  b grows with the number of fingerprints, so that a key stays
as long as chance matches ask for.  Hot keys are searched in cells of a bounded size.  A pair is
taken only from the first table that has it.

Defined cases: a null or wordless text has no fingerprint (null), no class and no links; ties of a
vote give bit 0; repeated rows, null ids and texts of any length have rows like others; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .common import bucket_pairs, slim, stored, trimmed

TERM_WORDS = 3
_ROWS = 1 << 16


def simhash(data, off) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit fingerprints, whether there are words) of the rows of a buffer."""
    _, _, h, woff = K.words(K.fold(data), off, K.NON_WORD)
    terms, toff = K.shingles(h, woff, TERM_WORDS)
    row, val, cnt = K.row_counts(terms, toff)
    n = len(off) - 1
    votes = np.zeros((n, 64), np.float32)
    weight = (1 + np.log2(cnt)).astype(np.float32)
    for lo in range(0, len(val), _ROWS):
        hi = min(lo + _ROWS, len(val))
        bits = np.unpackbits(val[lo:hi].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.float32)
        bits = (2 * bits - 1) * weight[lo:hi, None]
        r = row[lo:hi]
        at = np.flatnonzero(np.append(True, r[1:] != r[:-1]))
        votes[r[at]] += np.add.reduceat(bits, at, axis=0)
    fp = np.packbits(votes > 0, axis=1).view(">u8").ravel().astype(np.uint64)
    return fp, woff[1:] > woff[:-1]


def _fingerprints(batches):
    for b in batches:
        data, off = K.buffers(b.column("text"))
        parts = [simhash(data[off[i] : off[j]], off[i : j + 1] - off[i]) for i, j in K.row_slices(off)]
        if not parts:
            continue
        fp = np.concatenate([p[0] for p in parts]).view(np.int64)
        has = np.concatenate([p[1] for p in parts])
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp, mask=~has)], names=["doc_id", "fingerprint"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint), one row for each input row."""
    return slim(docs, id_col, text_col).mapInArrow(trimmed(_fingerprints), "doc_id long, fingerprint long")


def block_masks(radius: int, blocks: int | None = None) -> list[int]:
    """Masks of blocks (radius + 2, if not given) that cut 64 bits as evenly as can be."""
    n = blocks or radius + 2
    edges = [round(64 * i / n) for i in range(n + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]


def block_number(n: int, radius: int) -> int:
    """Blocks for n fingerprints: each table costs a row for each of them, and a pair for each two
    that agree by chance on its bits."""
    return min(range(radius + 1, radius + 12), key=lambda b: comb(b, radius) * (1 + n / 2 ** (64 * (b - radius) / b)))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def near_fingerprints(fps: DataFrame, radius: int = 3, blocks: int | None = None) -> DataFrame:
    """(a, b, distance) with a < b: all pairs of distinct values of `fingerprint` within radius."""
    masks = block_masks(radius, blocks or block_number(fps.count(), radius))
    tables = list(combinations(range(len(masks)), len(masks) - radius))
    node = F.col("fingerprint")
    rows = [F.struct(F.lit(t).alias("t"), node.bitwiseAND(F.lit(_signed(sum(masks[i] for i in own)))).alias("key")) for t, own in enumerate(tables)]
    keyed = fps.select(node.alias("node"), node.alias("root"), F.explode(F.array(*rows)).alias("x")).select("node", "root", "x.t", "x.key")
    # a table is the first that has a pair if the pair differs in each block that it leaves out before its last
    before = [[_signed(masks[i]) for i in range(own[-1]) if i not in own] for own in tables]
    left_out = F.array(*[F.array(*[F.lit(m).cast("long") for m in ms]).cast("array<bigint>") for ms in before])
    diff = F.col("a").bitwiseXOR(F.col("b"))
    near = bucket_pairs(keyed, ["t", "key"]).where(F.bit_count(diff) <= radius)
    first = F.forall(F.element_at(left_out, F.col("t") + 1), lambda m: diff.bitwiseAND(m) != 0)
    return near.where(first).select("a", "b", F.bit_count(diff).cast("int").alias("distance"))


def near_documents(docs: DataFrame, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: (doc_id, fingerprint, class_size, links).

    The fingerprint is the class; class_size counts its rows, links the other fingerprints within the
    radius (`near_fingerprints` has the pairs)."""
    rows = stored(fingerprints(docs, id_col, text_col))
    classes = stored(rows.where("fingerprint is not null").groupBy("fingerprint").agg(F.count(F.lit(1)).alias("class_size")))
    pairs = near_fingerprints(classes.select("fingerprint"), radius)
    links = pairs.select(F.explode(F.array("a", "b")).alias("fingerprint")).groupBy("fingerprint").agg(F.count(F.lit(1)).alias("links"))
    known = classes.join(links, "fingerprint", "left").withColumn("links", F.coalesce("links", F.lit(0).cast("long")))
    found = rows.where("fingerprint is not null").join(known, "fingerprint").select("doc_id", "fingerprint", "class_size", "links")
    none = rows.where("fingerprint is null").select("doc_id", "fingerprint", F.lit(None).cast("long").alias("class_size"), F.lit(0).cast("long").alias("links"))
    return found.unionByName(none)
