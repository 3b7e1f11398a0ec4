"""Suffix-array dedup: passages of at least `min_words` words that occur earlier are cut, the first
occurrence stays.

A position is cut where its longest previous factor, LPF, reaches min_words: LPF of a position is
the longest match with any earlier position (earlier document id, or earlier in the text), found
from the previous and the next smaller position in suffix order.  A passage is cut as the union of
the min_words-long windows that start at such positions, which is the union of the whole factors.

Suffixes that share their first min_words words must meet in one suffix array, and most need none.
Each window picks the run of GRAM words with the smallest hash in it as its anchor; equal windows
pick equal anchors.  Neighbouring windows mostly pick the same occurrence, so a stretch of windows
(some twenty) is one row with the hash of all its words.  Anchors of one row need nothing.  Among the
rows of any other, rows equal to an earlier one are cut as a whole, an anchor whose rows are all
equal needs nothing more, and only the first row of each kind, for anchors with several kinds (the
edges of shared passages), sends its words to the anchor's suffix array.  An anchor of more than
HOT_KINDS kinds (a phrase that very many texts have) would be one long array in one task: its rows
send the hashes of their windows instead, of which the grouped minimum tells which occur earlier.

Defined cases: words are runs of letters and digits, ASCII and Latin-1 case-folded; null or short
texts are unchanged; of overlapping repeats within a text (a phrase over and over) one period
stays; document order is by id, null ids last, then by hashes of text and words; rows of the same id
and text are cut alike, as one document (ties); a cut runs from its first word to the next word that
stays, and a text that is cut altogether becomes empty; texts of any length are searched whole; an
empty table gives no rows; extra columns, whatever their names, are ignored, or kept by `cut_repeats`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .common import FILTER_BITS, may_hold, member_filter, quoted, slim, stored, trimmed

U64 = K.U64
GRAM = 8
GROUP_WORDS = 1 << 18  # anchors of about so many words share one array
PART = 15  # bits of a filter's part, as a power of 2
HELD = 1 << 20  # anchors that a task sorts at once
HOT_KINDS = 4096  # an anchor of more kinds of rows has no array
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n + 1, U64)
    np.multiply.accumulate(np.full(n, base, U64), out=out[1:])
    return out


class RangeHash:
    """Hash of any stretch of words, from prefix sums and the inverse of the odd base."""

    def __init__(self, h: np.ndarray):
        self.prefix = np.zeros(len(h) + 1, U64)
        np.cumsum(h * _powers(_BASE, len(h))[:-1], out=self.prefix[1:])
        self.inverse = _powers(_INVERSE, len(h))

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return K.mix((self.prefix[hi] - self.prefix[lo]) * self.inverse[lo] + (hi - lo).astype(U64))


def stretches(h: np.ndarray, woff: np.ndarray, min_words: int):
    """(row, first start, number of starts, anchor, hash of all words) of the stretches of windows."""
    n = len(h)
    rng = RangeHash(h)
    if n < min_words:
        z = np.zeros(0, np.int64)
        return z, z, z, z.astype(U64), z.astype(U64), rng
    gram = min(GRAM, min_words)
    at = np.arange(n - gram + 1)
    grams = rng.of(at, at + gram)
    low = (grams & U64(0xFFFFFFFF00000000)) | at.astype(U64)
    width, span = min_words - gram + 1, 1
    while 2 * span <= width:
        low = np.minimum(low[: len(low) - span], low[span:])
        span *= 2
    low = np.minimum(low[: len(low) - (width - span)], low[width - span :]) if width > span else low
    left = np.repeat(woff[1:], np.diff(woff))[: len(low)] - np.arange(len(low))
    starts = np.flatnonzero(left >= min_words)
    anchor = (low[starts] & U64(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    lo, cnt = starts[first], np.diff(np.append(first, len(starts)))
    row = np.searchsorted(woff, lo, "right") - 1
    return row, lo, cnt, grams[anchor[first]], rng.of(lo, lo + cnt - 1 + min_words), rng


def _pieces(data, off):
    for i, j in K.row_slices(off):
        s, e, h, woff = K.words(K.fold(data[off[i] : off[j]]), off[i : j + 1] - off[i], K.NON_WORD)
        yield i, j, s + off[i], h, woff


def _blobs(x: np.ndarray, off: np.ndarray) -> pa.Array:
    """A binary value for each row, of the row's part of `x`."""
    return pa.Array.from_buffers(pa.binary(), len(off) - 1, [None, pa.py_buffer((off * x.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(x))])


def _marks(min_words: int):
    """Each text's stretches, one after another, as arrays: anchors, hashes and numbers of windows."""

    def run(batches):
        for b in batches:
            data, off = K.buffers(b.column("text"))
            for i, j, _, h, woff in _pieces(data, off):
                row, _, cnt, anchor, seg, _ = stretches(h, woff, min_words)
                at = np.searchsorted(row, np.arange(j - i + 1))
                part = b.slice(i, j - i)
                yield pa.RecordBatch.from_arrays(
                    [part.column("no_id"), part.column("doc_id"), part.column("dk"), _blobs(anchor, at), _blobs(seg, at), _blobs(cnt.astype(np.int32), at)],
                    names=["no_id", "doc_id", "dk", "anchor", "seg", "n"],
                ).filter(pa.array(np.diff(at) > 0))

    return run


def _numbers(col, kind=np.int64) -> tuple[np.ndarray, np.ndarray]:
    """The values of all blobs and the offsets of each."""
    raw, off = K.buffers(col)
    return raw.view(kind) if len(raw) else np.zeros(0, kind), off // np.dtype(kind).itemsize


def _anchors(batches):
    """Anchors by their part of the filter, one that is there more than twice as two."""

    def closed(held):
        k = np.sort(np.concatenate(held))
        k = k[np.append([True, True], k[2:] != k[:-2])[: len(k)]]
        part = (k >> PART & FILTER_BITS // (1 << PART) - 1).astype(np.uint16)
        order = np.argsort(part, kind="stable")
        own, first = np.unique(part[order], return_index=True)
        return pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), _blobs(k[order], np.append(first, len(k)))], names=["part", "k"])

    held, size = [], 0
    for b in batches:
        held.append(_numbers(b.column("anchor"))[0])
        size += len(held[-1])
        if size >= HELD:
            yield closed(held)
            held, size = [], 0
    if size:
        yield closed(held)


def _repeated(batches):
    """The filter's parts: bits of the values that are there twice; partitions are sorted by part."""

    def closed(part, held):
        k = np.sort(np.concatenate(held))
        bits = np.zeros(1 << PART, np.uint8)
        bits[k[1:][k[1:] == k[:-1]] & (1 << PART) - 1] = 1
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], names=["part", "bits"])

    now, held = None, []
    for b in batches:
        k, off = _numbers(b.column("k"))
        parts = b.column("part").to_numpy()
        cuts = np.append(np.flatnonzero(np.diff(parts, prepend=-1)), len(parts))
        for x, y in zip(cuts[:-1], cuts[1:]):
            if held and parts[x] != now:
                yield closed(now, held)
                held = []
            now = int(parts[x])
            held.append(k[off[x] : off[y]])
    if held:
        yield closed(now, held)


def _shared(marks: DataFrame):
    """A filter, as `member_filter` has it, of the anchors that several stretches have."""
    by_part = marks.select("anchor").mapInArrow(trimmed(_anchors), "part int, k binary").repartition("part").sortWithinPartitions("part")
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in by_part.mapInArrow(trimmed(_repeated), "part int, bits binary").collect():  # 4 KB each, 8 MB at most
        out[r.part << PART - 3 : r.part + 1 << PART - 3] = np.frombuffer(r.bits, np.uint8)
    return marks.sparkSession.sparkContext.broadcast(out)


def _stretches(shared):
    """The stretches whose anchors may be shared."""

    def run(batches):
        for b in batches:
            anchor, off = _numbers(b.column("anchor"))
            n = _numbers(b.column("n"), np.int32)[0]
            ok = np.flatnonzero(may_hold(shared.value, anchor))
            row = np.repeat(np.arange(b.num_rows), np.diff(off))[ok]
            before = np.append(0, np.cumsum(n, dtype=np.int64))  # a text's stretches have all its windows
            lo = before[ok] - before[off[row]]
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor[ok]), pa.array(_numbers(b.column("seg"))[0][ok]), b.column("no_id").take(at), b.column("doc_id").take(at), b.column("dk").take(at), pa.array(lo.astype(np.int32)), pa.array(n[ok])],
                names=["anchor", "seg", "no_id", "doc_id", "dk", "lo", "n"],
            )

    return run


def _fetch(min_words: int):
    """The words (hashes) of the wanted stretches; of hot anchors, the hashes of their windows."""

    def run(batches):
        for b in batches:
            data, off = K.buffers(b.column("text"))
            want = b.column("want")
            for i, j, _, h, woff in _pieces(data, off):
                part = want.slice(i, j - i)
                flat = part.flatten()
                row = np.repeat(np.arange(j - i), np.asarray(part.value_lengths().fill_null(0)))
                if not len(row):
                    continue
                col = lambda name: flat.field(name).to_numpy(zero_copy_only=False)  # noqa: E731, B023
                lo, n, hot = col("lo"), col("n"), col("hot").astype(bool)
                at = woff[:-1][row] + lo
                rng = RangeHash(h) if hot.any() else None
                blobs = [rng.of(np.arange(x, x + m), np.arange(x, x + m) + min_words).tobytes() if f else h[x : x + m + min_words - 1].tobytes() for x, m, f in zip(at, n, hot)]
                take = pa.array(row + i)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(col("anchor")), b.column("no_id").take(take), b.column("doc_id").take(take), b.column("dk").take(take), pa.array(lo), pa.array(n), pa.array(hot), pa.array(blobs, pa.binary())],
                    names=["anchor", "no_id", "doc_id", "dk", "lo", "n", "hot", "words"],
                )

    return run


def _touched(bits, yes: bool):
    """Rows whose `k` the filter may hold, or those that it can't hold: these need no join."""

    def run(batches):
        for b in batches:
            keep = may_hold(bits.value, b.column("k").to_numpy())
            yield b.drop_columns(["k"]).filter(pa.array(keep if yes else ~keep))

    return run


def _windows(batches):
    """A row for each window of hot stretches: its hash and place."""
    for b in batches:
        raw, off = K.buffers(b.column("words"))
        row = np.repeat(np.arange(b.num_rows), np.diff(off) // 8)
        take = pa.array(row)
        lo = b.column("lo").to_numpy()[row] + np.arange(len(row)) - (off[:-1] // 8)[row]
        yield pa.RecordBatch.from_arrays([pa.array(raw.view(np.int64) if len(raw) else np.zeros(0, np.int64)), b.column("no_id").take(take), b.column("doc_id").take(take), b.column("dk").take(take), pa.array(lo.astype(np.int32))], names=["win", "no_id", "doc_id", "dk", "lo"])


def suffix_array(ids: np.ndarray, depth: int, least: int = 1) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffixes of `ids` sorted by at least their first `depth` symbols, by prefix doubling, and
    the ranks by 1, 2, 4, ... symbols.  Suffixes equal that far are in text order.

    A rank is the number of smaller suffixes, so those that differ from all others keep theirs and
    are sorted no more.  Those that do so by the largest power of 2 up to `least` are left out."""
    n = len(ids)

    def refined(at, key, old):
        """Places sorted by key, their ranks, and whether others have the same."""
        order = np.argsort(key)
        at, key, old = at[order], key[order], old[order]
        idx, new, was = np.arange(len(at)), np.ones(len(at) + 1, bool), np.ones(len(at), bool)
        new[1:-1], was[1:] = key[1:] != key[:-1], old[1:] != old[:-1]
        rank = old + np.maximum.accumulate(np.where(new[:-1], idx, 0)) - np.maximum.accumulate(np.where(was, idx, 0))
        return at, rank, ~(new[:-1] & new[1:])

    at, rank, same = refined(np.arange(n), ids, np.zeros(n, np.int64))
    ranks, span, kept = [np.empty(n, np.int64)], 1, at[same]
    ranks[0][at] = rank
    at = kept
    while span < depth:
        now = ranks[-1].copy()
        if len(at):
            nxt = np.zeros(len(at), np.int64)
            inside = at + span < n
            nxt[inside] = now[at[inside] + span] + 1
            old = now[at]
            at, rank, same = refined(at, old * (n + 1) + nxt, old)
            now[at] = rank
            at = at[same]
        ranks.append(now)
        span *= 2
        if span <= least:
            kept = at
    return kept[np.argsort(ranks[-1][kept] * n + kept)], ranks


def lcp_of(ranks: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Length of the common prefix of suffixes i and j, at most 2 ** len(ranks) - 1."""
    n = len(ranks[0])
    out = np.zeros(len(i), np.int64)
    for level in reversed(range(len(ranks))):
        a, b = i + out, j + out
        ok = (a < n) & (b < n)
        same = np.zeros(len(i), bool)
        same[ok] = ranks[level][a[ok]] == ranks[level][b[ok]]
        out[same] += 1 << level
    return out


def _smaller_before(sa: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """For each place of `sa`, the common prefix with the previous smaller position (0 if none).

    lcp[i] is that of places i - 1 and i.  Places jump over larger positions, all at once."""
    n = len(sa)
    prev, low = np.arange(n) - 1, lcp.copy()
    at = np.flatnonzero(prev >= 0)
    while True:
        at = at[sa[prev[at]] > sa[at]]
        if not len(at):
            break
        mid = prev[at]
        low[at] = np.minimum(low[at], low[mid])
        prev[at] = prev[mid]
        at = at[prev[at] >= 0]
    return np.where(prev >= 0, low, 0)


def longest_previous(ids: np.ndarray, depth: int, least: int = 1) -> np.ndarray:
    """LPF of every position, exact up to `depth` symbols (longer ones are at least that); of one
    under `least`, it may be 0."""
    out = np.zeros(len(ids), np.int64)
    if not len(ids):
        return out
    sa, ranks = suffix_array(ids, depth, least)
    lcp = np.zeros(len(sa), np.int64)
    lcp[1:] = lcp_of(ranks, sa[:-1], sa[1:])
    before = _smaller_before(sa, lcp)
    back = np.concatenate([[0], lcp[:0:-1]])[: len(sa)]
    after = _smaller_before(sa[::-1], back)[::-1]
    out[sa] = np.maximum(before, after)
    return out


def _factors(t: pa.Table, min_words: int):
    """Spans (doc_id, dk, lo, hi) that earlier stretches in `t` have; t holds whole anchors."""
    t = t.sort_by([(c, "ascending") for c in ("anchor", "no_id", "doc_id", "dk", "lo")]).combine_chunks()
    new = np.zeros(t.num_rows, bool)  # a repeated row is no earlier text
    new[:1] = True
    for c in ("anchor", "no_id", "doc_id", "dk", "lo"):
        x = t.column(c).to_numpy() if c != "doc_id" else t.column(c).fill_null(0).to_numpy()
        new[1:] |= x[1:] != x[:-1]
    t = t if new.all() else t.filter(pa.array(new)).combine_chunks()
    words, off = K.buffers(t.column("words"))
    h, off = words.view(U64) if len(words) else np.zeros(0, U64), off // 8
    lens = np.diff(off)
    # words are told apart by anchor too; a unique symbol ends each stretch
    anchor = np.repeat(t.column("anchor").to_numpy().view(U64), lens)
    pos = np.arange(len(h)) + np.repeat(np.arange(len(lens)), lens)
    full = np.empty(len(h) + len(lens), U64)
    full[pos] = K.mix(h ^ K.mix(anchor))
    ends = off[1:] + np.arange(len(lens))
    full[ends] = K.mix(np.arange(1, len(lens) + 1, dtype=U64))  # no two are equal
    hit = pos[longest_previous(full, min_words, min_words)[pos] >= min_words]
    row = np.searchsorted(ends, hit)
    at = hit - (off[:-1] + np.arange(len(lens)))[row]
    new = np.ones(len(hit), bool)
    new[1:] = (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first, len(hit))[1:] - 1
    r = row[first]
    lo = t.column("lo").to_numpy()[r]
    return pa.RecordBatch.from_arrays(
        [t.column("doc_id").combine_chunks().take(pa.array(r)), t.column("dk").combine_chunks().take(pa.array(r)), pa.array((lo + at[first]).astype(np.int32)), pa.array((lo + at[last] + min_words).astype(np.int32))],
        names=["doc_id", "dk", "lo", "hi"],
    )


def _arrays(min_words: int):
    """Partitions sorted by anchor, in groups of whole anchors."""

    def run(batches):
        held, size = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            key = b.column("anchor").to_numpy()
            cuts = np.flatnonzero(np.diff(key)) + 1
            if size >= GROUP_WORDS:  # close the group at the first change of anchor
                edge = 0 if held[-1].column("anchor")[-1].as_py() != key[0] else (int(cuts[0]) if len(cuts) else None)
                if edge is not None:
                    yield _factors(pa.Table.from_batches([*held, b.slice(0, edge)]), min_words)
                    held, size, b = [], 0, b.slice(edge)
            held.append(b)
            size += b.column("words").nbytes // 8
        if held:
            yield _factors(pa.Table.from_batches(held), min_words)

    return run


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(no_id, doc_id, dk, text): dk tells apart the texts of an id, and those without one."""
    text = F.col(quoted(text_col)).cast("string")
    return docs.select(F.col(quoted(id_col)).isNull().alias("no_id"), F.col(quoted(id_col)).cast("long").alias("doc_id"), F.xxhash64(text, F.octet_length(text)).alias("dk"), text.alias("text"))


def repeated_spans(docs: DataFrame, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text", hot_kinds: int = HOT_KINDS) -> DataFrame:
    """(doc_id, dk, lo, hi): spans of words that occur earlier, of the texts with hash dk.  Spans of a
    document may overlap."""
    slim(docs, id_col, text_col)  # the size of batches
    d = _documents(docs, id_col, text_col).where("text is not null")
    # texts are searched for stretches once; a filter of the anchors that several have keeps all others from being shuffled
    marks = stored(d.mapInArrow(trimmed(_marks(min_words)), "no_id boolean, doc_id long, dk long, anchor binary, seg binary, n binary"))
    rows = stored(marks.mapInArrow(trimmed(_stretches(_shared(marks))), "anchor long, seg long, no_id boolean, doc_id long, dk long, lo int, n int"), instead_of=marks)
    place = F.struct("no_id", "doc_id", "dk", "lo")
    # grouped minima combine before the shuffle, so a passage in a third of all texts is a row of each task
    kinds = stored(rows.groupBy("anchor", "seg").agg(F.min(F.struct(place.alias("place"), F.col("n"))).alias("first"), F.count(F.lit(1)).alias("rows")))
    anchors = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), F.sum("rows").alias("rows")).where("rows > 1")
    several = stored(kinds.join(anchors.select("anchor", "kinds"), "anchor"), instead_of=kinds)
    again = several.where("rows > 1").select("anchor", "seg", F.col("first.place").alias("first"))
    whole = rows.join(again, ["anchor", "seg"]).where(place != F.col("first")).select("doc_id", "dk", "lo", (F.col("lo") + F.col("n") + F.lit(min_words - 1)).alias("hi"))
    mixed = several.where("kinds > 1").select("anchor", "first.place.*", "first.n", (F.col("kinds") > hot_kinds).alias("hot"))
    want = mixed.groupBy("no_id", "doc_id", "dk").agg(F.collect_list(F.struct("anchor", "lo", "n", "hot")).alias("want"))
    asked = member_filter(mixed.select(F.xxhash64("doc_id", "dk").alias("k")))
    d = d.withColumn("k", F.xxhash64("doc_id", "dk")).mapInArrow(trimmed(_touched(asked, True)), "no_id boolean, doc_id long, dk long, text string")
    once = d.join(want.select(F.col("doc_id").alias("of"), "dk", "want"), F.col("doc_id").eqNullSafe(F.col("of")) & (d["dk"] == want["dk"])).select(d["no_id"], d["doc_id"], d["dk"], "text", "want")
    # stored, since up to three plans read it: the texts are shuffled and searched once
    sent = stored(once.mapInArrow(trimmed(_fetch(min_words)), "anchor long, no_id boolean, doc_id long, dk long, lo int, n int, hot boolean, words binary"))
    parts = sent.where("not hot").repartition("anchor").sortWithinPartitions("anchor").mapInArrow(trimmed(_arrays(min_words)), "doc_id long, dk long, lo int, hi int")
    out = whole.unionByName(parts)
    if not mixed.where("hot").isEmpty():
        wins = sent.where("hot").mapInArrow(trimmed(_windows), "win long, no_id boolean, doc_id long, dk long, lo int")
        earliest = wins.groupBy("win").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
        out = out.unionByName(wins.join(earliest, "win").where(place != F.col("first")).select("doc_id", "dk", "lo", (F.col("lo") + F.lit(min_words)).alias("hi")))
    return out


def merge_spans(lo: np.ndarray, hi: np.ndarray) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(lo.tolist(), hi.tolist())):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def cut_text(raw: bytes, starts: np.ndarray, spans: list[tuple[int, int]]) -> bytes:
    """`raw` without the word spans; starts are the words' byte offsets."""
    if spans and spans[0] == (0, len(starts)):
        return b""
    out, at = [], 0
    for a, b in spans:
        out.append(raw[at : starts[a]])
        at = int(starts[b]) if b < len(starts) else len(raw)
    return b"".join([*out, raw[at:]])


_SPAN = pa.struct([("lo", pa.int32()), ("hi", pa.int32())])


def _cut(batches):
    for b in batches:
        texts, cuts = b.column("text"), b.column("cuts")
        new, spans, total = texts.to_pylist(), [[] for _ in range(len(texts))], [0] * len(texts)
        hit = np.flatnonzero(np.asarray(cuts.is_valid()) & np.asarray(texts.is_valid()))
        data, off = K.buffers(texts.take(pa.array(hit)))
        for i, j, s, _, woff in _pieces(data, off):
            for k in range(i, j):
                r = int(hit[k])
                own = cuts[r].values
                w = s[woff[k - i] : woff[k - i + 1]] - off[k]
                spans[r] = merge_spans(own.field("lo").to_numpy(), own.field("hi").to_numpy())
                new[r] = cut_text(data[off[k] : off[k + 1]].tobytes(), w, spans[r]).decode("utf-8", "replace")
                total[r] = sum(y - x for x, y in spans[r])
        typed = pa.array([[{"lo": x, "hi": y} for x, y in sp] for sp in spans], pa.list_(_SPAN))
        yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(new, pa.string()), typed, pa.array(total, pa.int32()), b.column("rest")], names=["id", "text", "spans", "removed", "rest"])


def _dedup(docs: DataFrame, min_words: int, id_col: str, text_col: str, hot_kinds: int = HOT_KINDS) -> DataFrame:
    """(id, text, spans, removed, rest): rest holds the other columns as one struct, by their places."""
    found = repeated_spans(docs, min_words, id_col, text_col, hot_kinds)
    lists = stored(found.groupBy(F.col("doc_id").alias("of"), F.col("dk").alias("of_dk")).agg(F.collect_set(F.struct("lo", "hi")).alias("cuts")))
    bits = member_filter(lists.select(F.xxhash64("of", "of_dk").alias("k")))
    others = [c for c in docs.columns if c not in (id_col, text_col)]
    rest = F.struct(*[F.col(quoted(c)).alias(f"c{k}") for k, c in enumerate(others)], F.lit(0).alias("none"))
    text = F.col(quoted(text_col)).cast("string")
    rows = docs.select(F.col(quoted(id_col)).cast("long").alias("id"), text.alias("text"), F.xxhash64(text, F.octet_length(text)).alias("dk"), rest.alias("rest"))
    rows = rows.withColumn("k", F.xxhash64("id", "dk"))
    kind = rows.schema["rest"].dataType.simpleString()
    # only documents with cuts, and what the filter takes for one, are shuffled
    hit = rows.mapInArrow(trimmed(_touched(bits, True)), f"id long, text string, dk long, rest {kind}")
    both = hit.join(lists, F.col("id").eqNullSafe(F.col("of")) & (F.col("dk") == F.col("of_dk")), "left").select("id", "text", "cuts", "rest")
    cut = both.mapInArrow(trimmed(_cut), f"id long, text string, spans array<struct<lo:int,hi:int>>, removed int, rest {kind}")
    rest = rows.mapInArrow(trimmed(_touched(bits, False)), f"id long, text string, dk long, rest {kind}")
    return cut.unionByName(rest.select("id", "text", F.array().cast("array<struct<lo:int,hi:int>>").alias("spans"), F.lit(0).alias("removed"), "rest"))


def suffix_dedup(docs: DataFrame, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text", hot_kinds: int = HOT_KINDS) -> DataFrame:
    """(doc_id, text, spans, removed): each row's text without what earlier text has; spans are in
    words, from lo up to hi."""
    out = _dedup(docs.select(quoted(id_col), quoted(text_col)), min_words, id_col, text_col, hot_kinds)
    return out.select(F.col("id").alias("doc_id"), "text", "spans", "removed")


def cut_repeats(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """The rows of `docs` with repeats cut from `text` (and `n_chars`, if there, counted anew);
    a document of which nothing stays is dropped."""
    out = _dedup(docs, min_words, "doc_id", "text").where("not (removed > 0 and text = '')")
    cols, k = [], 0
    for c, kind in docs.dtypes:
        if c in ("doc_id", "text"):
            cols.append(F.col("id" if c == "doc_id" else "text").cast(kind).alias(c))
            continue
        own, k = F.col(f"rest.c{k}"), k + 1
        cols.append((F.when(F.col("removed") > 0, F.char_length("text")).otherwise(own).cast(kind) if c == "n_chars" else own).alias(c))
    return out.select(cols)
