"""SentencePiece encoding and decoding by a max-plus parallel scan.

A text is cut into pieces of the vocabulary with the greatest sum of scores (the unigram model of
SentencePiece).  Where best paths must pass, such as before a word's leading space mark, the text
falls into independent units, and equal units of a batch are solved once, many side by side.

A text over `chunk_chars` characters becomes chunks, which are rows of their own and spread over
tasks.  The state at a chunk's boundary is how many characters a piece reaches beyond it.  A chunk
yields its transfer matrix, the best score from each entry state to each exit state; products of
matrices in the (max, +) algebra are associative and combine up a tree, FAN neighbours to a product.
Walking down again, each product's entry and exit fix those of what it was made of, down to the
chunks, which are then traced back independently.
Scores are 64-bit integers (2**-20 units), so sums are exact however they are grouped.

Scores: a unigram model's own; for a byte-pair model, whose scores are merge ranks, -log(1 + rank),
that is Zipf's law over its pieces.  Characters that are no piece are their UTF-8 bytes (byte
fallback), at the lowest score less 10 for each character.  Models that normalise text beyond marks
for spaces (a character map, extra white space taken out) are refused, since their ids would differ.

Defined cases: a null text has null ids; an empty text has none; a text of any length is encoded whole; of equally good ways the one whose
last pieces are longer is taken within a chunk, and the smaller state at a boundary; repeated rows
are encoded each; an empty table gives no rows; extra columns are ignored.  As in SentencePiece a
space is put first and spaces become marks, so decoding drops one leading space; texts that hold
the mark character itself decode to spaces there (`round_trip` is then false).
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .common import slim, stored, trimmed

U64 = K.U64
MODEL = os.environ.get("TOKENWRIGHT_PIECES", "/opt/tokenizers/piece_bpe_32k.model")
CHUNK_CHARS = 1 << 14
MARK = 0x2581
SCALE = 1 << 20
NEVER = -(1 << 60)
LANES, CELLS = 4096, 1 << 20
_M = U64(0x9DDFEA08EB382D69)


class Vocabulary:
    """Pieces, their hashes by length, and their scores in fixed point."""

    def __init__(self, path: str = MODEL):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix or not spec.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError(f"{path}: the model normalises text, which this encoder doesn't")
        kind = pb.ModelProto.SentencePiece.Type
        self.pieces = [p.piece for p in model.pieces]
        normal = [i for i, p in enumerate(model.pieces) if p.type in (kind.NORMAL, kind.USER_DEFINED)]
        self.byte_ids = np.full(256, -1, np.int64)
        for i, p in enumerate(model.pieces):
            if p.type == kind.BYTE:
                self.byte_ids[int(p.piece[3:5], 16)] = i
        self.unk = next((i for i, p in enumerate(model.pieces) if p.type == kind.UNKNOWN), 0)
        raw = np.array([model.pieces[i].score for i in normal], float)
        if model.trainer_spec.model_type == pb.TrainerSpec.BPE:
            raw = -np.log1p(np.minimum(-raw, len(self.pieces)))
        self.float_scores = dict(zip(normal, raw.tolist()))
        score = np.round(raw * SCALE).astype(np.int64)
        self.unknown = int(score.min()) - 10 * SCALE
        self.longest = max(len(self.pieces[i]) for i in normal)
        codes = [np.array([ord(c) for c in self.pieces[i]], U64) for i in normal]
        h = np.array([_piece_hash(c) for c in codes], U64)
        order = np.argsort(h)
        self.keys, self.ids, self.scores = h[order], np.array(normal)[order], score[order]
        if len(np.unique(self.keys)) != len(self.keys):
            raise ValueError("piece hashes collide")
        # two tables by 20 bits of the hash each; the second has the keys whose place in the first is taken
        self.slots = np.full((2, 1 << 20), -1, np.int32)
        left = np.arange(len(self.keys))
        for table, shift in zip(self.slots, (44, 24)):
            place = (self.keys[left] >> U64(shift) & U64(0xFFFFF)).astype(np.int64)
            _, one = np.unique(place, return_index=True)
            table[place[one]] = left[one]
            left = np.delete(left, one)
        if len(left):
            raise ValueError("too many pieces")
        self.cache = Cache()
        # a unit may start at a mark after another character: no piece has a mark further inside
        inner = [i for i in normal if chr(MARK) in self.pieces[i].lstrip(chr(MARK))]
        self.safe = not inner
        text = [b"" if i not in self.float_scores else self.pieces[i].replace(chr(MARK), " ").encode() for i in range(len(self.pieces))]
        for b, i in enumerate(self.byte_ids):
            if i >= 0:
                text[i] = bytes([b])
        self.text_off = np.concatenate([[0], np.cumsum([len(t) for t in text])])
        self.text = np.frombuffer(b"".join(text), np.uint8)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Index into keys, or -1."""
        out = self.slots[0].take((h >> U64(44)).astype(np.int64))
        at = np.flatnonzero(out >= 0)
        wrong = at[self.keys.take(out[at]) != h[at]]
        again = self.slots[1].take((h[wrong] >> U64(24) & U64(0xFFFFF)).astype(np.int64))
        out[wrong] = np.where((again >= 0) & (self.keys.take(again, mode="wrap") == h[wrong]), again, -1)
        return out


class Cache:
    """Token ids of units that a worker has solved before, by hash; begun anew when it is full."""

    def __init__(self, most: int = 1 << 18):
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.keys, self.off, self.ids = np.zeros(0, U64), np.zeros(1, np.int64), np.zeros(0, np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Place of each hash, or -1."""
        if not len(self.keys):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return np.where(self.keys[at] == h, at, -1)

    def add(self, h: np.ndarray, ids: np.ndarray, off: np.ndarray) -> None:
        """Takes units that it doesn't have, with their hashes in order."""
        if len(self.keys) + len(h) > self.most or len(self.ids) + len(ids) > 8 * self.most:
            self.clear()
        if len(h) > self.most or len(ids) > 8 * self.most:
            return
        keys, lens = np.concatenate([self.keys, h]), np.concatenate([np.diff(self.off), np.diff(off)])
        start, flat = np.concatenate([self.off[:-1], off[:-1] + len(self.ids)]), np.concatenate([self.ids, ids])
        order = np.argsort(keys, kind="stable")
        self.keys, lens = keys[order], lens[order]
        self.off, self.ids = np.concatenate([[0], np.cumsum(lens)]), gathered(flat, start[order], lens)


def gathered(values: np.ndarray, start: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The stretches of `values` one after another."""
    ends = np.cumsum(lens)
    return values[np.repeat(start - (ends - lens), lens) + np.arange(int(ends[-1]) if len(ends) else 0)]


def _piece_hash(codes: np.ndarray) -> np.uint64:
    acc = np.zeros(1, U64)
    for c in codes:
        acc = acc * _M + c + U64(1)
    return K.mix(acc + U64(len(codes)))[0]


_loaded: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]


def code_points(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes (valid, as Arrow strings are) and row offsets in them."""
    lead = (data & 0xC0) != 0x80
    at = np.flatnonzero(lead)
    pos = np.concatenate([[0], np.cumsum(lead)])[off]
    b = np.concatenate([data, np.zeros(4, np.uint8)]).astype(np.uint32)
    c = b[at]
    wide = np.flatnonzero(c >= 0xC0)
    if len(wide):
        p, x = at[wide], c[wide]
        two = (x & 0x1F) << 6 | b[p + 1] & 0x3F
        three = (x & 0x0F) << 12 | (b[p + 1] & 0x3F) << 6 | b[p + 2] & 0x3F
        four = (x & 0x07) << 18 | (b[p + 1] & 0x3F) << 12 | (b[p + 2] & 0x3F) << 6 | b[p + 3] & 0x3F
        c[wide] = np.where(x < 0xE0, two, np.where(x < 0xF0, three, four))
    return c, pos


def marked(codes: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spaces become marks, and every non-empty row gets one in front."""
    full = np.diff(pos) > 0
    at = pos[:-1][full]
    out = np.insert(np.where(codes == 32, np.uint32(MARK), codes), at, np.uint32(MARK))
    return out, pos + np.concatenate([[0], np.cumsum(full)])


def lookup(voc: Vocabulary, codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """table[length - 1, position]: key index of the piece that starts there, or -1; no piece
    crosses `ends`, the end of each position's row."""
    n = len(codes)
    out = np.full((voc.longest, n), -1, np.int32)
    c = codes.astype(U64) + U64(1)
    acc = np.zeros(n, U64)
    for k in range(min(voc.longest, n)):
        m = n - k
        acc = acc[:m] * _M + c[k:]
        found = voc.find(K.mix(acc + U64(k + 1)))
        found[ends[:m] - np.arange(m) <= k] = -1
        out[k, :m] = found
    return out


class Lanes:
    """Best paths of many stretches side by side; lane i starts at start[i] and reads on to
    stop[i] (its last place, a boundary or further)."""

    def __init__(self, voc: Vocabulary, table: np.ndarray, start: np.ndarray, stop: np.ndarray):
        self.voc, self.table = voc, table
        self.order = np.argsort(start - stop, kind="stable")
        self.start, self.len = start[self.order], (stop - start)[self.order]
        n, steps, width = len(start), int(self.len[0]) if len(start) else 0, voc.longest
        self.best = np.full((steps + 1, n), NEVER, np.int64)
        self.back = np.zeros((steps + 1, n), np.int8)
        if n:
            self.best[0] = 0
        for t in range(1, steps + 1):
            m = int(np.searchsorted(-self.len, -t, "right"))
            k = np.arange(min(width, t), 0, -1)  # longer pieces first: the first best one is taken
            rows = self.start[:m][None, :] + t - k[:, None]
            idx = table[k[:, None] - 1, rows]
            gain = np.where(idx >= 0, voc.scores[idx], NEVER)
            gain[-1] = np.where(idx[-1] >= 0, gain[-1], voc.unknown)
            total = self.best[t - k, :m] + gain
            top = total.argmax(axis=0)
            self.best[t, :m] = np.maximum(total[top, np.arange(m)], NEVER)
            self.back[t, :m] = k[top]

    def trace(self, lane_end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(lane, first position, key index or -1) of the pieces of the best paths to place
        lane_end[i] of lane i, in order; lanes as given to the constructor."""
        place = np.arange(len(self.order))
        t = lane_end[self.order].copy()
        live = np.flatnonzero(t > 0)
        lanes, at, ids = [], [], []
        while len(live):
            k = self.back[t[live], live].astype(np.int64)
            t[live] -= k
            p = self.start[live] + t[live]
            lanes.append(self.order[place[live]])
            at.append(p)
            ids.append(self.table[k - 1, p])
            live = live[t[live] > 0]
        if not lanes:
            z = np.zeros(0, np.int64)
            return z, z, z
        lane, p, i = np.concatenate(lanes), np.concatenate(at), np.concatenate(ids).astype(np.int64)
        o = np.lexsort((p, lane))
        return lane[o], p[o], i[o]


def solve(voc: Vocabulary, codes: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(token ids, row offsets) of the best paths over whole rows."""
    table = lookup(voc, codes, np.repeat(off[1:], np.diff(off)))
    start, stop = off[:-1], off[1:]
    order = np.argsort(stop - start, kind="stable")
    rows, keys, at = [], [], []
    lo = 0
    while lo < len(order):  # lanes of like length, and of bounded cells
        hi = min(len(order), lo + LANES)
        longest = int(stop[order[hi - 1]] - start[order[hi - 1]])
        hi = min(hi, lo + max(1, CELLS // max(longest, 1)))
        part = order[lo:hi]
        lanes = Lanes(voc, table, start[part], stop[part])
        r, p, k = lanes.trace(stop[part] - start[part])
        rows.append(part[r])
        at.append(p)
        keys.append(k)
        lo = hi
    if not rows:
        return np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    row, p, k = np.concatenate(rows), np.concatenate(at), np.concatenate(keys)
    o = np.lexsort((p, row))
    return to_ids(voc, codes, row[o], p[o], k[o], len(off) - 1)


def to_ids(voc, codes, row, p, k, n):
    """Token ids of pieces; key -1 is an unknown character: its bytes, or the unknown piece."""
    ids = np.where(k >= 0, voc.ids[k], voc.unk)
    lost = np.flatnonzero(k < 0)
    if len(lost) and (voc.byte_ids >= 0).all():
        c = codes[p[lost]].astype(np.int64)
        c = np.where(c == MARK, 32, c)
        size = 1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000)
        rep = np.ones(len(ids), np.int64)
        rep[lost] = size
        first = (np.cumsum(rep) - rep)[lost]
        ids, row = np.repeat(ids, rep), np.repeat(row, rep)
        lead = np.where(size == 1, c, np.where(size == 2, 0xC0 | c >> 6, np.where(size == 3, 0xE0 | c >> 12, 0xF0 | c >> 18)))
        ids[first] = voc.byte_ids[lead]
        for j in (1, 2, 3):
            more = np.flatnonzero(size > j)
            ids[first[more] + j] = voc.byte_ids[0x80 | (c[more] >> 6 * (size[more] - 1 - j)) & 0x3F]
    return ids, np.searchsorted(row, np.arange(n + 1))


def units(voc: Vocabulary, codes: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Starts of the units of all rows: row starts, and, where the vocabulary allows it, marks
    that follow another character."""
    first = np.zeros(len(codes) + 1, bool)
    first[pos] = True
    if voc.safe and len(codes):
        mark = codes == MARK
        first[1:-1] |= mark[1:] & ~mark[:-1]
    return np.flatnonzero(first[: len(codes)])


def encode_rows(voc: Vocabulary, codes: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(token ids, row offsets) of marked rows: equal units are solved once."""
    if not len(codes):
        return np.zeros(0, np.int64), np.zeros(len(pos), np.int64)
    u = units(voc, codes, pos)
    ends = np.append(u[1:], len(codes))
    size = ends - u
    pw = np.ones(int(size.max()) + 1, U64)
    np.multiply.accumulate(np.full(len(pw) - 1, _M, U64), out=pw[1:])
    within = np.arange(len(codes)) - np.repeat(u, size)
    h = K.mix(np.add.reduceat(K.mix(codes.astype(U64) + U64(1)) * pw[within], u) + size.astype(U64))
    keys, one, inv = np.unique(h, return_index=True, return_inverse=True)
    known = voc.cache.find(keys)
    new = np.flatnonzero(known < 0)
    at = one[new]
    ids, off = solve(voc, gathered(codes, u[at], size[at]), np.concatenate([[0], np.cumsum(size[at])]).astype(np.int64))
    cached = voc.cache
    start, cnt = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
    start[new], cnt[new] = off[:-1], np.diff(off)
    old = np.flatnonzero(known >= 0)
    start[old], cnt[old] = len(ids) + cached.off[known[old]], np.diff(cached.off)[known[old]]
    both = np.concatenate([ids, cached.ids])
    flat = gathered(both, start[inv], cnt[inv])
    out = np.concatenate([[0], np.cumsum(cnt[inv])])
    cached.add(keys[new], ids, off)
    return flat, out[np.searchsorted(u, pos)]


def decode_rows(voc: Vocabulary, ids: np.ndarray, off: np.ndarray, lead: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes, row offsets); with `lead`, the leading space of each row is taken off."""
    size = np.diff(voc.text_off)[ids]
    at = np.concatenate([[0], np.cumsum(size)])
    data = voc.text[np.repeat(voc.text_off[ids] - at[:-1], size) + np.arange(int(at[-1]))]
    roff = at[off]
    if not lead:
        return data, roff
    full = np.flatnonzero(np.diff(roff) > 0)
    drop = roff[full][data[roff[full]] == 32]
    keep = np.ones(len(data), bool)
    keep[drop] = False
    return data[keep], np.concatenate([[0], np.cumsum(keep)])[roff]


def _encode(path: str):
    def run(batches):
        voc = vocabulary(path)
        for b in batches:
            data, off = K.buffers(b.column("text"))
            null = ~np.asarray(b.column("text").is_valid())
            for i, j in K.row_slices(off):
                part, po = data[off[i] : off[j]], off[i : j + 1] - off[i]
                ids, ioff = encode_rows(voc, *marked(*code_points(part, po)))
                same = _rows_equal(*decode_rows(voc, ids, ioff), part, po)
                no = null[i:j]
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(i, j - i), pa.ListArray.from_arrays(pa.array(ioff.astype(np.int32)), pa.array(ids.astype(np.int32)), mask=pa.array(no)), pa.array(np.diff(ioff), mask=no), pa.array(same, mask=no)],
                    names=["doc_id", "ids", "n_tokens", "round_trip"],
                )

    return run


def _rows_equal(a, aoff, b, boff) -> np.ndarray:
    same = np.diff(aoff) == np.diff(boff)
    for r in np.flatnonzero(same):
        same[r] = np.array_equal(a[aoff[r] : aoff[r + 1]], b[boff[r] : boff[r + 1]])
    return same


class Chunk:
    """A chunk's characters with those that follow it, and its first and last safe places."""

    def __init__(self, voc: Vocabulary, codes: np.ndarray, size: int):
        self.voc, self.codes, self.size = voc, codes, size
        self.reach = min(voc.longest - 1, len(codes) - size)  # how far a piece can go beyond
        u = units(voc, codes, np.array([0, len(codes)]))
        # every entry state comes before a cut, and every exit state after it
        u = u[(u >= voc.longest - 1) & (u <= size)]
        self.cuts = (int(u[0]), int(u[-1])) if len(u) else None

    def _table(self, lo: int, hi: int) -> np.ndarray:
        return lookup(self.voc, self.codes[lo:hi], np.full(hi - lo, hi - lo))

    def matrix(self) -> np.ndarray:
        """transfer[entry, exit] in max-plus, up to a constant that all entries share (the score
        between the cuts, which every path has)."""
        w = self.voc.longest
        out = np.full((w, w), NEVER, np.int64)
        e, exits = np.arange(min(w, self.size + 1)), np.arange(self.reach + 1)
        if self.cuts is None:
            table = self._table(0, self.size + self.reach)
            lanes = Lanes(self.voc, table, e, np.full(len(e), self.size))
            for i in e:  # the first lane is the longest
                out[i, exits] = self._exits(table, lanes.best[: self.size - i + 1, i], i, 0)
            return out
        a, z = self.cuts
        head = Lanes(self.voc, self._table(0, a), e, np.full(len(e), a))
        to_cut = head.best[a - e, e]
        table = self._table(z, self.size + self.reach)
        tail = Lanes(self.voc, table, np.array([0]), np.array([self.size - z]))
        both = to_cut[:, None] + self._exits(table, tail.best[:, 0], z, z)[None, :]
        out[np.ix_(e, exits)] = np.maximum(both, NEVER)
        return out

    def _across(self, table, best: np.ndarray, at: int, base: int, leave: int):
        """(score, first place, key index) of the pieces that end `leave` beyond the boundary; best
        has the scores from `at` on, and table starts at `base`."""
        for k in range(self.voc.longest, leave, -1):
            p = self.size + leave - k
            if p >= at:
                i = table[k - 1, p - base]
                if i >= 0 and best[p - at] > NEVER:
                    yield int(best[p - at] + self.voc.scores[i]), p, int(i)

    def _exits(self, table, best: np.ndarray, at: int, base: int) -> np.ndarray:
        """Scores of leaving just at the boundary, or with one piece across it."""
        out = np.full(self.reach + 1, NEVER, np.int64)
        out[0] = best[self.size - at]
        for j in range(1, self.reach + 1):
            out[j] = max([NEVER, *(x for x, _, _ in self._across(table, best, at, base, j))])
        return out

    def last(self, entry: int, leave: int) -> tuple[int, np.ndarray]:
        """Where the pieces that stay within the chunk end, and the id of the one across, if any."""
        if not leave:
            return self.size, np.zeros(0, np.int64)
        at = self.cuts[1] if self.cuts else entry
        table = self._table(at, self.size + self.reach)
        lane = Lanes(self.voc, table, np.array([0]), np.array([self.size - at]))
        _, p, i = max(self._across(table, lane.best[:, 0], at, at, leave), key=lambda x: x[0])
        return p, self.voc.ids[i : i + 1]


def trace_chunks(voc: Vocabulary, chunks: list[Chunk], enter: list[int], leave: list[int]) -> list[np.ndarray]:
    """Token ids of each chunk between its boundary states; equal units of all are solved once."""
    ends = [c.last(e, x) for c, e, x in zip(chunks, enter, leave)]
    rows = [c.codes[e : max(e, n)] for c, e, (n, _) in zip(chunks, enter, ends)]
    pos = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
    ids, off = encode_rows(voc, np.concatenate(rows) if rows else np.zeros(0, np.uint32), pos)
    return [np.concatenate([ids[off[i] : off[i + 1]], ends[i][1]]) for i in range(len(rows))]


def maxplus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product in (max, +)."""
    return np.maximum((a[:, :, None] + b[None, :, :]).max(axis=1), NEVER)


def product(matrices: list[np.ndarray]) -> np.ndarray:
    """Product of neighbours, as a balanced tree."""
    while len(matrices) > 1:
        pairs = [maxplus(a, b) for a, b in zip(matrices[::2], matrices[1::2])]
        matrices = pairs + matrices[len(matrices) // 2 * 2 :]
    return matrices[0]


def boundary_states(matrices: list[np.ndarray], enter: int = 0, leave: int = 0) -> list[int]:
    """States at the boundaries (one more than matrices) of the best path from `enter` to `leave`."""
    row, prefix = np.full((1, len(matrices[0])), NEVER, np.int64), []
    row[0, enter] = 0
    for m in matrices:
        prefix.append(row[0])
        row = maxplus(row, m)
    states = [leave]
    for p, m in zip(reversed(prefix), reversed(matrices)):
        states.append(int((p + m[:, states[-1]]).argmax()))
    return states[::-1]


def _marked_text(text: str) -> str:
    return chr(MARK) + text.replace(" ", chr(MARK))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def chunk_sizes(n: int, chunk: int) -> list[tuple[int, int]]:
    """(start, size) of the chunks of n characters."""
    return [(k, min(chunk, n - k)) for k in range(0, n, chunk)]


_CHUNK = "of long, doc_id long, part int, size int, plain boolean, piece string"
_MATRIX = "of long, part int, matrix binary"
_STATE = "of long, part int, enter int, leave int"
FAN = 64


def _cut(path: str, chunk: int):
    def run(batches):
        over = vocabulary(path).longest - 1
        schema = pa.schema([("of", pa.int64()), ("doc_id", pa.int64()), ("part", pa.int32()), ("size", pa.int32()), ("plain", pa.bool_()), ("piece", pa.string())])
        for b in batches:
            for of, doc, text in zip(*(b.column(c).to_pylist() for c in ("of", "doc_id", "text"))):
                plain, t = chr(MARK) not in text, _marked_text(text)
                cuts = chunk_sizes(len(t), chunk)
                for lo in range(0, len(cuts), FAN):
                    yield pa.RecordBatch.from_pylist([{"of": of, "doc_id": doc, "part": k, "size": n, "plain": plain, "piece": t[at : at + n + over]} for k, (at, n) in enumerate(cuts[lo : lo + FAN], lo)], schema=schema)

    return run


def _transfer(path: str):
    def run(batches):
        voc = vocabulary(path)
        for b in batches:
            blobs = [Chunk(voc, _codes(t), n).matrix().tobytes() for t, n in zip(b.column("piece").to_pylist(), b.column("size").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("of"), b.column("part"), pa.array(blobs, pa.binary())], names=["of", "part", "matrix"])

    return run


def _square(blobs) -> list[np.ndarray]:
    side = int(round((len(blobs[0]) // 8) ** 0.5))
    return [np.frombuffer(m, np.int64).reshape(side, side) for m in blobs]


def _join(t: pa.Table) -> pa.Table:
    """The product of up to FAN neighbours."""
    t = t.sort_by("part")
    m = product(_square(t.column("matrix").to_pylist()))
    return pa.table([t.column("of").slice(0, 1), t.column("g").slice(0, 1), pa.array([m.tobytes()], pa.binary())], names=["of", "part", "matrix"])


def _walk(t: pa.Table) -> pa.Table:
    """Entry and exit of up to FAN neighbours, of which the first entry and the last exit are given."""
    t = t.sort_by("part")
    s = boundary_states(_square(t.column("matrix").to_pylist()), t.column("enter")[0].as_py(), t.column("leave")[0].as_py())
    return pa.table([t.column("of"), t.column("part"), pa.array(s[:-1], pa.int32()), pa.array(s[1:], pa.int32())], names=["of", "part", "enter", "leave"])


def chunk_states(matrices: DataFrame, most: int, fan: int = FAN) -> DataFrame:
    """(of, part, enter, leave) of every chunk; no document has more than `most` chunks."""
    group = F.floor(F.col("part") / fan).cast("int")
    levels = [matrices]
    while most > fan:
        levels.append(stored(levels[-1].withColumn("g", group).groupBy("of", "g").applyInArrow(_join, _MATRIX)))
        most = -(-most // fan)
    states = levels[-1].withColumns({"enter": F.lit(0), "leave": F.lit(0)}).groupBy("of").applyInArrow(_walk, _STATE)
    for lower in reversed(levels[:-1]):
        above = states.withColumnRenamed("part", "g")
        states = lower.withColumn("g", group).join(above, ["of", "g"]).groupBy("of", "g").applyInArrow(_walk, _STATE)
    return states


CHUNK_GROUP = 8 << 20  # bytes of a row group of chunks
TRACE_CHUNKS = 64  # traced together, which bounds memory, never what is processed


def _trace(path: str):
    def run(batches):
        voc = vocabulary(path)
        for whole in batches:
            for lo in range(0, whole.num_rows, TRACE_CHUNKS):
                b = whole.slice(lo, TRACE_CHUNKS)
                pieces, sizes, plain, enter, leave = (b.column(c).to_pylist() for c in ("piece", "size", "plain", "enter", "leave"))
                ids = trace_chunks(voc, [Chunk(voc, _codes(t), n) for t, n in zip(pieces, sizes)], enter, leave)
                off = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64)
                flat = np.concatenate([np.zeros(0, np.int64), *ids]).astype(np.int64)
                raw, roff = decode_rows(voc, flat, off, lead=False)
                # the characters between the states, with the marks as the spaces that they were
                same = [f and raw[a:z].tobytes() == t[e : n + x].replace(chr(MARK), " ").encode() for f, a, z, t, n, e, x in zip(plain, roff, roff[1:], pieces, sizes, enter, leave)]
                yield pa.RecordBatch.from_arrays([b.column("of"), b.column("doc_id"), b.column("part"), K.ragged(flat.astype(np.int32), off, pa.int32()), pa.array(same, pa.bool_())], names=["of", "doc_id", "part", "ids", "ok"])

    return run


def encode(docs: DataFrame, path: str = MODEL, chunk_chars: int = CHUNK_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, n_tokens, round_trip), one row for each input row."""
    d = slim(docs, id_col, text_col)
    giant = F.char_length("text") >= chunk_chars  # with the mark in front: more than a chunk
    short = d.where(F.coalesce(~giant, F.lit(True))).mapInArrow(trimmed(_encode(path)), "doc_id long, ids array<int>, n_tokens long, round_trip boolean")
    # a stored number tells rows apart, repeated ones too; small row groups let a giant's chunks spread over tasks
    long = d.where(giant).withColumn("of", F.monotonically_increasing_id())
    chunks = stored(long.mapInArrow(trimmed(_cut(path, chunk_chars)), _CHUNK), row_group=CHUNK_GROUP)
    most = chunks.agg(F.max("part")).first()[0]
    if most is None:
        return short
    matrices = chunks.select("of", "part", "size", "piece").mapInArrow(trimmed(_transfer(path)), _MATRIX)
    states = chunk_states(stored(matrices) if most >= FAN else matrices, most + 1)
    traced = chunks.join(states, ["of", "part"]).mapInArrow(trimmed(_trace(path)), "of long, doc_id long, part int, ids array<int>, ok boolean")
    whole = traced.groupBy("of", "doc_id").agg(F.array_sort(F.collect_list(F.struct("part", "ids"))).alias("parts"), F.bool_and("ok").alias("ok"))
    ids = F.flatten(F.transform("parts", lambda x: x["ids"]))
    return short.unionByName(whole.select("doc_id", ids.alias("ids"), "ok").select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.col("ok").alias("round_trip")))


def decode(encoded: DataFrame, path: str = MODEL, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) of token ids; null ids give a null text."""

    def run(batches):
        voc = vocabulary(path)
        for b in batches:
            ids = b.column("ids")
            null = ~np.asarray(ids.is_valid())
            off = np.concatenate([[0], np.cumsum(np.asarray(ids.value_lengths().fill_null(0)))])
            raw, roff = decode_rows(voc, ids.flatten().to_numpy(zero_copy_only=False).astype(np.int64), off)
            texts = [None if null[r] else raw[roff[r] : roff[r + 1]].tobytes().decode("utf-8", "replace") for r in range(len(ids))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    rows = encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return rows.mapInArrow(trimmed(run), "doc_id long, text string")
