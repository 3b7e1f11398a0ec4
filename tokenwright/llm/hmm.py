"""Language-model scores: a hidden Markov model over the words of the corpus.

Every word of the corpus is counted and has its own emission probability: that of its class in the
state, times the word's exact share of the class's occurrences.  The `vocabulary` most frequent
words are a class (symbol) each; all other words fall into `shared` classes by their hash, and their
counts stay partitioned by word and are joined to the texts.  Words of one class thus share how they
depend on the state, but not their probability.  Baum-Welch trains `states` latent states on every
word of the corpus: each task adds up the expected counts of its texts, every text as one sequence
from its first word to its last, and one grouped sum by symbol aggregates them.  Texts of like length
advance side by side.  Rounds end when a word's mean log-likelihood gains less than `tolerance`, after
`rounds` at the latest.  Scores are of whole texts: the scaled forward recursion multiplies by one
transition matrix a word, and the logs of its scale factors add up to the exact likelihood of the
classes; the logs of the words' shares, added in steps of 1 / SHARE_STEPS so that their order can't
matter, make it that of the words.

Defined cases: words are folded runs of letters and digits; a null text has null results; a text
without words has likelihood 1 (log 0.0) and no perplexity (null); equally frequent words rank by
hash; repeated rows are counted and scored each; a corpus without words trains nothing and is only
scored; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .common import slim, stored, trimmed

U64 = K.U64
CELLS = 1 << 17  # words whose forward variables are held at once; a longer text is passed twice
GATHER_WORDS = 1 << 20  # texts of about so many words are ordered by length
SCORE_WORDS = 1 << 22
LASTING, FREE = 200.0, 3  # weight of staying in a state, against about three of each change; states without it
RESCALE = 16  # steps between scale factors
SHARE_STEPS = 1 << 36


def _word_hashes(b):
    data, off = K.buffers(b.column("text"))
    for i, j in K.row_slices(off):
        _, _, h, woff = K.words(K.fold(data[off[i] : off[j]]), off[i : j + 1] - off[i], K.NON_WORD)
        yield i, j, h, woff


def _count_words(batches):
    for b in batches:
        parts = [h for _, _, h, _ in _word_hashes(b)]
        if parts:
            val, cnt = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(val.view(np.int64)), pa.array(cnt.astype(np.int64))], names=["word", "n"])


def symbols_of(h: np.ndarray, keys: np.ndarray, shared: int) -> np.ndarray:
    """Symbols of word hashes; keys are the sorted hashes of the words with one of their own."""
    rest = (len(keys) + (h % U64(shared))).astype(np.int64)
    if not len(keys):
        return rest
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return np.where(keys[at] == h, at, rest)


def _symbolise(keys: np.ndarray, shared: int):
    """Rows get a number of their own, since ids may repeat; rare: the words of shared symbols."""

    def run(batches):
        nr = TaskContext.get().partitionId() << 36
        for b in batches:
            ids, texts = b.column("doc_id"), b.column("text")
            for i, j, h, woff in _word_hashes(b):
                sym = symbols_of(h, keys, shared)
                raw = sym.astype("<u4").tobytes()
                at = np.flatnonzero(sym >= len(keys))
                rare = K.ragged(h[at].view(np.int64), np.searchsorted(at, woff), pa.int64())
                blobs = [raw[4 * x : 4 * y] for x, y in zip(woff[:-1], woff[1:])]
                valid = np.asarray(texts.slice(i, j - i).is_valid())
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(nr, nr + j - i)), ids.slice(i, j - i), pa.array(np.diff(woff).astype(np.int64), mask=~valid), pa.array(blobs, pa.binary()), rare], names=["nr", "doc_id", "words", "symbols", "rare"])
                nr += j - i

    return run


def start(counts: np.ndarray, states: int):
    """(initial, transitions, emissions as symbols x states): unigrams, tilted by hashed noise.

    All but FREE states start as ones that last: the words of a whole text then add up to tell them
    apart, and they part in the first rounds, where states that mix evenly stay unigrams for a dozen.
    FREE states change from word to word."""
    def noise(n, m, salt):
        return (K.mix(np.arange(n * m, dtype=U64) + U64(salt)) >> U64(11)).astype(float).reshape(n, m) / 2**53

    emit = (counts[:, None] + 0.5) * np.exp(3 * noise(len(counts), states, 1 << 32))
    move = 1 + 4 * noise(states, states, 1 << 40) + LASTING * np.diag((np.arange(states) < states - FREE).astype(float))
    return np.full(states, 1 / states), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0)


def sequences(off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of the rows that have words, longest first."""
    size = np.diff(off)
    order = np.argsort(-size, kind="stable")
    order = order[: np.count_nonzero(size)]
    return off[:-1][order], size[order]


class _Lattice:
    """Forward and backward variables of sequences (longest first) from place t0 up to t1.

    a[t] is the forward variable over the product of the scale factors so far, b[t] the backward one
    times the same product over the likelihood, so that a * b are posteriors as they are."""

    def __init__(self, model, sym, at, size, t0: int, t1: int):
        self.pi, self.move, emit = model
        self.t0, self.t1, self.n = t0, t1, len(at)
        self.live = np.searchsorted(-size, -np.arange(t0, t1 + 1), "left").tolist()  # sequences longer than t
        t = np.arange(t0, t1)[:, None]
        self.seen = sym[np.minimum(at[None, :] + t, (at + size - 1)[None, :])]
        self.w = emit.take(self.seen, axis=0)
        self.w[t >= size[None, :]] = 0
        self.a = np.zeros(self.w.shape)
        self.scale: dict[int, np.ndarray] = {}
        self.norm = np.ones(self.n)

    def forward(self, prev: np.ndarray | None) -> tuple[np.ndarray, float]:
        """(a at the last place, sum of the logs of scale factors and of likelihoods that end here)."""
        logs = 0.0
        for r in range(self.t1 - self.t0):
            m, nxt = self.live[r], self.live[r + 1]
            a = self.a[r, :m]
            if prev is None:
                np.multiply(self.pi, self.w[r, :m], out=a)
            else:
                np.matmul(prev[:m], self.move, out=a)
                a *= self.w[r, :m]
            if (self.t0 + r) % RESCALE == RESCALE - 1:
                self.scale[r] = c = a.sum(axis=1, keepdims=True)
                a /= c
                logs += float(np.log(c).sum())
            if nxt < m:
                self.norm[nxt:m] = a[nxt:].sum(axis=1)
                logs += float(np.log(self.norm[nxt:m]).sum())
            prev = a
        return prev, logs

    def backward(self, after: np.ndarray | None) -> np.ndarray:
        """Turns w into the weights of the steps into each place; gives b of the place before t0."""
        back = np.ascontiguousarray(self.move.T)
        self.b = np.zeros(self.a.shape)
        if after is not None:
            self.b[-1, : len(after)] = after
        out = None
        for r in range(self.t1 - self.t0 - 1, -1, -1):
            m, nxt = self.live[r], self.live[r + 1]
            b, w = self.b[r, :m], self.w[r, :m]
            if nxt < m:
                b[nxt:] = 1 / self.norm[nxt:m, None]
            w *= b
            if r in self.scale:
                w /= self.scale[r]
            if r:
                np.matmul(w, back, out=self.b[r - 1, :m])
            else:
                out = w @ back
        return out

    def add(self, before: np.ndarray | None, totals) -> None:
        k = len(self.pi)
        pairs = self.a[:-1].reshape(-1, k).T @ self.w[1:].reshape(-1, k)
        gamma = np.multiply(self.a, self.b, out=self.b)
        if before is None:
            totals[0] += gamma[0].sum(axis=0)
        else:
            m = self.live[0]
            pairs += before[:m].T @ self.w[0, :m]
        totals[1] += self.move * pairs
        flat, by_state = self.seen.ravel(), np.ascontiguousarray(gamma.reshape(-1, k).T)  # 0 behind the ends
        for i in range(k):
            totals[2][:, i] += np.bincount(flat, by_state[i], minlength=len(totals[2]))


def expect(model, sym: np.ndarray, at: np.ndarray, size: np.ndarray, totals, cells: int = CELLS) -> None:
    """Adds the expected counts of sequences (longest first) to totals: initial, transitions,
    emissions and [log-likelihood].

    Where the sequences have more than `cells` places, only the forward variables at some are kept,
    and those between are computed again on the way back."""
    step = max(1, cells // len(at))
    edges = [*range(0, int(size[0]), step), int(size[0])]
    enter: list[np.ndarray | None] = [None]
    for t0, t1 in zip(edges[:-2], edges[1:]):
        last, logs = _Lattice(model, sym, at, size, t0, t1).forward(enter[-1])
        enter.append(last.copy())
        totals[3][0] += logs
    after = None
    for k in reversed(range(len(edges) - 1)):
        part = _Lattice(model, sym, at, size, edges[k], edges[k + 1])
        _, logs = part.forward(enter[k])
        totals[3][0] += logs if k == len(edges) - 2 else 0.0
        after = part.backward(after)
        part.add(enter[k], totals)


def _expectations(model):
    def run(batches):
        pi, _, emit = model
        k = len(pi)
        totals = [np.zeros(k), np.zeros((k, k)), np.zeros((len(emit), k), order="F"), np.zeros(k)]
        some, held, words = False, [], 0

        def flush():
            sym = np.concatenate([x for x, _ in held])
            base = np.cumsum([0, *(len(x) for x, _ in held[:-1])])
            off = np.concatenate([[0], *(o[1:] + x for (_, o), x in zip(held, base))])
            at, size = sequences(off)
            lo = 0
            while lo < len(at):
                hi = lo + max(1, CELLS // int(size[lo]))
                expect(model, sym, at[lo:hi], size[lo:hi], totals)
                lo = hi

        for b in batches:
            raw, off = K.buffers(b.column("symbols"))
            if not len(raw):
                continue
            held.append((raw.view("<u4").astype(np.int64), off // 4))
            words += len(raw) // 4
            some = True
            if words >= GATHER_WORDS:
                flush()
                held.clear()
                words = 0
        if held:
            flush()
        if some:
            used = np.flatnonzero(totals[2].any(axis=1))
            keys = np.concatenate([used, len(emit) + np.arange(k + 2)])
            rows = np.concatenate([totals[2][used], totals[1], totals[0][None], totals[3][None]])
            yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), *(pa.array(np.ascontiguousarray(rows[:, i])) for i in range(k))], names=["key", *(f"c{i}" for i in range(k))])

    return run


def maximise(totals, unigram: np.ndarray, prior: float):
    """The next model; `prior` pseudo-counts, shared out by the words' frequencies, keep every
    probability above zero."""
    pi, move, emit = (totals[0] + prior, totals[1] + prior, totals[2] + prior * len(unigram) * unigram[:, None])
    return pi / pi.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0)


def log_likelihoods(model, sym: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Exact log-likelihood of each sequence of `sym`, by the scaled forward recursion."""
    pi, move, emit = model
    order = np.argsort(-np.diff(off), kind="stable")
    at, size = off[:-1][order], np.diff(off)[order]
    out = np.zeros(len(order))
    live = np.searchsorted(-size, -np.arange(int(size[0]) + 1 if len(size) else 1), "left").tolist()
    alpha = None
    for t in range(len(live) - 1):
        m, nxt = live[t], live[t + 1]
        e = emit[sym[at[:m] + t]]
        a = pi * e if t == 0 else (alpha[:m] @ move) * e
        if t % RESCALE == RESCALE - 1:
            c = a.sum(axis=1)
            a /= c[:, None]
            out[:m] += np.log(c)
        if nxt < m:
            out[nxt:m] += np.log(a[nxt:].sum(axis=1))
        alpha = a
    res = np.empty(len(order))
    res[order] = out
    return res


def _score(model, counts: np.ndarray, own: int):
    """Log-likelihoods of the symbols, less the logs of the counts of shared ones (from `own` on)."""
    less = np.where(np.arange(len(counts)) < own, 0.0, np.log(np.maximum(counts, 1)))

    def flush(held):
        t = pa.Table.from_batches(held).combine_chunks()
        raw, off = K.buffers(t.column("symbols"))
        sym, off = raw.view("<u4").astype(np.int64) if len(raw) else np.zeros(0, np.int64), off // 4
        ll = log_likelihoods(model, sym, off) - K.segment_reduce(np.add, less[sym], off, 0.0)
        return pa.RecordBatch.from_arrays([t.column("nr").combine_chunks(), t.column("doc_id").combine_chunks(), t.column("words").combine_chunks(), pa.array(ll)], names=["nr", "doc_id", "words", "ll"])

    def run(batches):
        held, size = [], 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                size += b.column("symbols").nbytes // 4
            if size >= SCORE_WORDS:
                yield flush(held)
                held, size = [], 0
        if held:
            yield flush(held)

    return run


def train(symbols: DataFrame, counts: np.ndarray, states: int, rounds: int, prior: float, tolerance: float = 0.0):
    """(model, log-likelihood before each round)."""
    (pi, move, emit), logs = start(counts, states), []
    some = counts > 0 if counts.any() else np.ones(len(counts), bool)  # a symbol of no word takes no probability
    emit = emit * some[:, None]
    model = pi, move, emit / emit.sum(axis=0)
    unigram = (counts + 0.5) * some / ((counts + 0.5) * some).sum()
    v, cols = len(counts), [f"c{i}" for i in range(states)]
    for _ in range(rounds):
        got = symbols.where("words > 0").mapInArrow(trimmed(_expectations(model)), "key long, " + ", ".join(f"{c} double" for c in cols))
        got = got.groupBy("key").agg(*[F.sum(c).alias(c) for c in cols]).toPandas()  # at most v + states + 2 rows
        if not len(got):
            break
        full = np.zeros((v + states + 2, states))
        full[got["key"].to_numpy()] = got[cols].to_numpy()
        logs.append(float(full[v + states + 1, 0]))
        model = maximise([full[v + states], full[v : v + states], full[:v]], unigram, prior)
        if len(logs) > 1 and logs[-1] - logs[-2] < tolerance * counts.sum():
            break
    return model, logs


def score(docs: DataFrame, vocabulary: int = 1 << 15, shared: int = 1 << 10, states: int = 8, rounds: int = 6, tolerance: float = 0.005, prior: float = 0.01, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, words, log_likelihood, perplexity), one row for each input row."""
    d = slim(docs, id_col, text_col)
    words = stored(d.mapInArrow(trimmed(_count_words), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")))
    top = words.orderBy(F.desc("n"), "word").limit(vocabulary).select("word").toPandas()  # at most `vocabulary` rows
    keys = np.sort(top["word"].to_numpy(np.int64).view(U64))
    symbols = stored(d.mapInArrow(trimmed(_symbolise(keys, shared)), "nr long, doc_id long, words long, symbols binary, rare array<long>"))

    def tally(batches):
        n = np.zeros(len(keys) + shared, np.int64)
        for b in batches:
            raw, _ = K.buffers(b.column("symbols"))
            if len(raw):
                n += np.bincount(raw.view("<u4"), minlength=len(n))
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["symbol", "n"])

    seen = symbols.select("symbols").mapInArrow(trimmed(tally), "symbol long, n long").groupBy("symbol").agg(F.sum("n").alias("n")).toPandas()  # one row for each symbol
    counts = np.zeros(len(keys) + shared)
    counts[seen["symbol"].to_numpy(np.int64)] = seen["n"].to_numpy(float)
    model, _ = train(symbols, counts, states, rounds, prior, tolerance)
    # exact counts of rare words, by word to their occurrences; no word among them is frequent, so no key is heavy
    steps = F.round(F.log("n") * SHARE_STEPS).cast("long")
    shares = symbols.select("nr", F.explode("rare").alias("word")).join(words.select("word", steps.alias("steps")), "word").groupBy("nr").agg(F.sum("steps").alias("steps"))
    scored = symbols.select("nr", "doc_id", "words", "symbols").mapInArrow(trimmed(_score(model, counts, len(keys))), "nr long, doc_id long, words long, ll double")
    ll = F.when(F.col("words").isNotNull(), F.col("ll") + F.coalesce(F.col("steps"), F.lit(0)) / SHARE_STEPS)
    out = scored.join(shares, "nr", "left").select("doc_id", "words", ll.alias("log_likelihood"))
    return out.withColumn("perplexity", F.when(F.col("words") > 0, F.exp(-F.col("log_likelihood") / F.col("words"))))
