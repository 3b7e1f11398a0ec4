"""Best-fit packing with a swap-based local search.

Lengths (not texts) are hashed to shards of about `shard_items`; a shard packs its documents best-fit
in decreasing order and then improves the bins that are left underfull.  Shards hand what their worst
bins hold to a second level, so that waste does not grow with the number of shards.

Defined cases: a document longer than a bin, however long, is cut into full bins and a rest; a null
or empty text has length 0 and takes a place in some bin; repeated rows are packed each; null ids are
packed like others; ties go by id, and equal rows are alike; an empty table gives no rows; extra
columns are ignored.  Which documents share a shard depends on how the table is read, not on the session.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .common import slim, stored, trimmed

_ROW = "doc_id long, piece int, tokens long"
_OUT = "doc_id long, piece int, tokens long, bin_id long, bin_fill long"


def text_lengths(data, off, bytes_per_token: int = 4) -> np.ndarray:
    """Every white-space separated word costs one token for each started `bytes_per_token` bytes."""
    s, e, _, woff = K.words(data, off, K.SPACE, hashed=False)
    return K.segment_reduce(np.add, (e - s + bytes_per_token - 1) // bytes_per_token, woff, 0)


def _pieces(capacity: int, bytes_per_token: int):
    def run(batches):
        for b in batches:
            data, off = K.buffers(b.column("text"))
            n = np.concatenate([text_lengths(data[off[i] : off[j]], off[i : j + 1] - off[i], bytes_per_token) for i, j in K.row_slices(off)] or [np.zeros(0, np.int64)]).astype(np.int64)
            cnt = np.maximum(1, -(-n // capacity))
            row = np.repeat(np.arange(len(n)), cnt)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(cnt) - cnt, cnt)
            size = np.minimum(n[row] - piece * capacity, capacity)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(size)], names=["doc_id", "piece", "tokens"])

    return run


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit: each item, in the given order, to the fullest bin that holds it.  Bins by free
    room in stacks; a bit set of the rooms in use finds the smallest that suffices."""
    bins: list[list[int]] = []
    by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
    used = 0
    for i, s in enumerate(sizes):
        fit = used >> s
        if fit:
            free = s + (fit & -fit).bit_length() - 1
            b = by_free[free].pop()
            if not by_free[free]:
                used ^= 1 << free
        else:
            free, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        by_free[free - s].append(b)
        used |= 1 << (free - s)
    return bins


def _spread(bits: int, least: int, most: int) -> int:
    """Bits moved up by each of least..most places."""
    out, width, want = bits << least, 1, most - least + 1
    while width < want:
        step = min(width, want - width)
        out |= out << step
        width += step
    return out


class _Bins:
    """The bins that a step may fill, by their free room.

    Of each room f there is the set of item sizes that its bins hold (0 for giving nothing back), and
    `takes[f]`, the totals that some of its bins can take in exchange for one of these: every total
    that is greater than the size by 1 to f.  A tree over f has the unions, so that the fullest bin
    that can take one of a set of totals is found in log(capacity) steps, however many bins there are."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.takes = [0] * (2 * self.leaves)
        self.sizes = [0] * (capacity + 1)
        self.holders: list[dict[int, dict[int, None]]] = [{} for _ in range(capacity + 1)]

    def _update(self, f: int) -> None:
        at = self.leaves + f
        self.takes[at] = _spread(self.sizes[f], 1, f) if f and self.sizes[f] else 0
        while at > 1:
            at >>= 1
            new = self.takes[2 * at] | self.takes[2 * at + 1]
            if new == self.takes[at]:
                break
            self.takes[at] = new

    def add(self, b: int, free: int, sizes) -> None:
        was = self.sizes[free]
        for s in {0, *sizes}:
            self.holders[free].setdefault(s, {})[b] = None
            self.sizes[free] |= 1 << s
        if was != self.sizes[free]:
            self._update(free)

    def remove(self, b: int, free: int, sizes) -> None:
        was = self.sizes[free]
        for s in {0, *sizes}:
            del self.holders[free][s][b]
            if not self.holders[free][s]:
                del self.holders[free][s]
                self.sizes[free] ^= 1 << s
        if was != self.sizes[free]:
            self._update(free)

    def fullest(self, totals: int, most: int) -> int | None:
        """The least free room, up to `most`, whose bins can take one of the totals."""

        def down(at: int, lo: int, width: int) -> int | None:
            if lo > most or not self.takes[at] & totals:
                return None
            if width == 1:
                return lo
            left = down(2 * at, lo, width // 2)
            return left if left is not None else down(2 * at + 1, lo + width // 2, width // 2)

        return down(1, 0, self.leaves)

    def best(self, totals: int, f: int) -> tuple[int, int, int]:
        """(total, size given back, bin) of the step that fills a bin of room f most."""
        lo, hi = 1, f  # the greatest gain that some total has
        while lo < hi:
            mid = (lo + hi + 1) // 2
            if _spread(self.sizes[f], mid, f) & totals:
                lo = mid
            else:
                hi = mid - 1
        hit = (self.sizes[f] << lo) & totals
        total = (hit & -hit).bit_length() - 1
        return total, total - lo, next(iter(self.holders[f][total - lo]))


def local_search(bins: list[list[int]], sizes: list[int], capacity: int, full: float) -> list[list[int]]:
    """Moves, one-for-one and two-for-one exchanges between underfull bins (fill below `full` of
    the capacity), each of which increases the sum of squared fills, until none does.

    Content flows from the emptier bin to the fuller one, so emptier bins run out and vanish.  A step
    gives one or two items to a bin that is at least as full, and takes none or one back."""
    fill = [sum(sizes[i] for i in b) for b in bins]
    index = _Bins(capacity)
    items: dict[int, dict[int, list[int]]] = {}  # of the live bins: items by their size
    for b, own in enumerate(bins):
        if 0 < fill[b] < min(capacity, full * capacity):
            by: dict[int, list[int]] = {}
            for i in own:
                by.setdefault(sizes[i], []).append(i)
            items[b] = by
            index.add(b, capacity - fill[b], by)
    changed = True
    while changed:  # a change may open a way for any other bin, so passes go on until one has none
        changed = False
        for src in sorted(items, key=lambda b: (fill[b], b)):
            if src not in items:
                continue
            index.remove(src, capacity - fill[src], items[src])
            while fill[src] and _step(index, items, fill, src, capacity, full):
                changed = True
            if fill[src]:
                index.add(src, capacity - fill[src], items[src])
            else:
                bins[src] = [i for own in items.pop(src).values() for i in own]  # items of size 0, if any
        for b, by in items.items():
            bins[b] = [i for own in by.values() for i in own]
    nothing = [b for b in range(len(bins)) if bins[b] and not fill[b]]  # only items of size 0 left
    host = next((b for b in range(len(bins)) if fill[b]), nothing[0] if nothing else None)
    for b in nothing:
        if b != host:
            bins[host] += bins[b]
            bins[b] = []
    return [b for b in bins if b]


def _totals(by: dict[int, list[int]]) -> int:
    """The sizes of one or two items, as bits."""
    singles = 0
    for s, own in by.items():
        if s and own:
            singles |= 1 << s
    out = singles
    for s, own in by.items():
        if s and own:
            out |= (singles if len(own) > 1 else singles ^ 1 << s) << s
    return out


def _step(index: _Bins, items, fill, src: int, capacity: int, full: float) -> bool:
    """One step out of src, which isn't in the index, into the fullest bin that can gain by one."""
    by = items[src]
    totals = _totals(by)
    f = index.fullest(totals, capacity - fill[src])
    if f is None:
        return False
    total, back, dst = index.best(totals, f)
    out = [total] if by.get(total) else next([s, total - s] for s in by if s and by.get(total - s) and (2 * s != total or len(by[s]) > 1))
    index.remove(dst, f, items[dst])
    there = items[dst]
    taken = [there[back].pop()] if back else []
    given = [by[s].pop() for s in out]
    for s, i in [*((s, i) for s, i in zip(out, given))]:
        there.setdefault(s, []).append(i)
    for i in taken:
        by.setdefault(back, []).append(i)
    for own in (by, there):
        for s in [s for s, x in own.items() if not x]:
            del own[s]
    fill[src] -= total - back
    fill[dst] += total - back
    index.add(dst, capacity - fill[dst], there)
    return True


def pack_lengths(sizes: list[int], capacity: int, full: float = 0.98) -> list[list[int]]:
    """Bins of item indexes; sizes must be in decreasing order for best-fit decreasing."""
    return local_search(best_fit(sizes, capacity), sizes, capacity, full)


def _pack_group(capacity: int, full: float, first: bool):
    def run(key, t):
        group = key[0].as_py()
        t = t.sort_by([("tokens", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        sizes = t.column("tokens").to_pylist()
        bins = pack_lengths(sizes, capacity, full)
        of = np.zeros(len(sizes), np.int64)
        fills = np.zeros(len(sizes), np.int64)
        for b, items in enumerate(bins):
            of[items] = b
            fills[items] = sum(sizes[i] for i in items)
        ids = np.where(fills < full * capacity, -1, of + (group << 31)) if first else of + ((group << 31) | (1 << 62))
        return pa.table([t.column("doc_id"), t.column("piece"), t.column("tokens"), pa.array(ids), pa.array(fills), pa.array(np.full(len(of), group))], names=["doc_id", "piece", "tokens", "bin_id", "bin_fill", "__g"])

    return run


def pack(docs: DataFrame, capacity: int = 4096, full: float = 0.98, bytes_per_token: int = 4, shard_items: int = 1 << 14, fan_in: int = 16, tokens_col: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, tokens, bin_id, bin_fill), one row for each piece of each document.

    `tokens_col` names a column with the documents' exact token counts, for instance those of
    `pieces.encode`; without it `text_lengths` estimates them."""
    if tokens_col:
        size = F.greatest(F.coalesce(F.col(tokens_col).cast("long"), F.lit(0).cast("long")), F.lit(0).cast("long"))
        cut = F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(size / capacity) - 1, F.lit(0).cast("long")))
        rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), size.alias("size"), F.explode(cut).alias("piece"))
        rows = rows.select("doc_id", F.col("piece").cast("int").alias("piece"), F.least(F.col("size") - F.col("piece") * capacity, F.lit(capacity)).cast("long").alias("tokens"))
    else:
        rows = slim(docs, id_col, text_col).mapInArrow(trimmed(_pieces(capacity, bytes_per_token)), _ROW)
    # rows have numbers, so that neither a hot id nor null ids share a shard
    rows = stored(rows.withColumn("nr", F.monotonically_increasing_id()))
    shards = max(1, rows.count() // shard_items)
    spread = rows.select("doc_id", "piece", "tokens", F.pmod(F.xxhash64("doc_id", "piece", "nr"), F.lit(shards)).cast("long").alias("__g"))
    one = stored(spread.groupBy("__g").applyInArrow(_pack_group(capacity, full, True), _OUT + ", __g long"))
    two = one.where("bin_id = -1").withColumn("__g", F.floor(F.col("__g") / F.lit(fan_in)).cast("long"))
    two = two.select("doc_id", "piece", "tokens", "__g").groupBy("__g").applyInArrow(_pack_group(capacity, full, False), _OUT + ", __g long")
    return one.where("bin_id >= 0").unionByName(two).drop("__g")
