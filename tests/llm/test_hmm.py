import itertools
import math
from collections import Counter

import numpy as np
from cases import ODD, frame, with_clashes

from tokenwright.llm import hmm as H


def brute(model, s):
    pi, move, emit = model
    if not len(s):
        return 0.0
    total = 0.0
    for path in itertools.product(range(len(pi)), repeat=len(s)):
        p = pi[path[0]] * emit[s[0], path[0]]
        for a, b, x in zip(path, path[1:], s[1:]):
            p *= move[a, b] * emit[x, b]
        total += p
    return math.log(total)


def test_forward_is_exact():
    sym, off = np.random.default_rng(0).integers(0, 5, 23), np.array([0, 6, 6, 11, 18, 23])
    model = H.start(np.bincount(sym, minlength=5).astype(float), 3)
    got = H.log_likelihoods(model, sym, off)
    assert np.allclose(got, [brute(model, sym[a:b]) for a, b in zip(off, off[1:])])


def step(model, sym, off, prior=0.0, **more):
    k, v = len(model[0]), len(model[2])
    t = [np.zeros(k), np.zeros((k, k)), np.zeros((v, k)), np.zeros(k)]
    H.expect(model, sym, *H.sequences(off), t, **more)
    return t, H.maximise(t, np.full(v, 1 / v), prior)


def test_baum_welch_never_loses_likelihood():
    sym, off = np.random.default_rng(1).integers(0, 6, 200), np.array([0, 50, 51, 120, 200])
    model, logs = H.start(np.bincount(sym, minlength=6).astype(float), 3), []
    for _ in range(20):
        t, new = step(model, sym, off)
        assert math.isclose(t[2].sum(), 200) and math.isclose(t[1].sum(), 196) and math.isclose(t[0].sum(), 4)
        assert math.isclose(t[3][0], H.log_likelihoods(model, sym, off).sum())
        logs.append(t[3][0])
        model = new
    assert np.all(np.diff(logs) >= -1e-9) and logs[-1] > logs[0]


def brute_counts(model, s):
    """Expected counts of one sequence over all paths."""
    pi, move, emit = model
    t = [np.zeros(len(pi)), np.zeros(move.shape), np.zeros(emit.shape)]
    total = math.exp(brute(model, s))
    for path in itertools.product(range(len(pi)), repeat=len(s)):
        p = pi[path[0]] * emit[s[0], path[0]]
        for a, b, x in zip(path, path[1:], s[1:]):
            p *= move[a, b] * emit[x, b]
        t[0][path[0]] += p / total
        for a, b in zip(path, path[1:]):
            t[1][a, b] += p / total
        for x, a in zip(s, path):
            t[2][x, a] += p / total
    return t


def test_expected_counts_match_all_paths():
    sym, off = np.random.default_rng(4).integers(0, 4, 20), np.array([0, 7, 7, 8, 13, 20])
    model = H.start(np.bincount(sym, minlength=4).astype(float), 3)
    got, _ = step(model, sym, off)
    want = [brute_counts(model, sym[a:b]) for a, b in zip(off, off[1:]) if b > a]
    for i in range(3):
        assert np.allclose(got[i], sum(w[i] for w in want))


def test_long_sequences_are_whole_however_they_are_passed():
    rng = np.random.default_rng(5)
    sym, off = rng.integers(0, 9, 3000), np.array([0, 2000, 2001, 2950, 3000])
    model = H.start(np.bincount(sym, minlength=9).astype(float), 4)
    whole, _ = step(model, sym, off)
    for cells in (1, 64, 999, 4000):
        parts, _ = step(model, sym, off, cells=cells)
        assert all(np.allclose(a, b) for a, b in zip(whole, parts))
    assert math.isclose(whole[0].sum(), 4) and math.isclose(whole[1].sum(), 2996) and math.isclose(whole[3][0], H.log_likelihoods(model, sym, off).sum())


def test_rounds_end_when_little_is_gained(spark):
    rows = [(i, " ".join(f"{'ab'[k % 2]}{(i + k) % 5}" for k in range(30))) for i in range(40)]
    counts = np.ones(10)
    d = spark.createDataFrame([(len(t.split()), np.array([5 * (w[0] == "b") + int(w[1]) for w in t.split()], "<u4").tobytes()) for _, t in rows], "words long, symbols binary")
    _, many = H.train(d, counts, 2, 30, 0.01, 0.0)
    _, few = H.train(d, counts, 2, 30, 0.01, 1.0)
    assert len(few) < len(many) and np.allclose(few, many[: len(few)]) and np.all(np.diff(many) > -1)


def test_scores(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(120):  # two alternating classes of words, which a unigram model can't see
        rows.append((i, " ".join(f"{'ab'[k % 2]}{rng.integers(0, 8)}" for k in range(60))))
    rows += [(500, " ".join(f"a{rng.integers(0, 8)}" for _ in range(60)))] + ODD
    got = {}
    for r in H.score(with_clashes(frame(spark, rows)), vocabulary=64, shared=4, states=3, rounds=12).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, got.values())) == len(rows)
    assert got[500][0].perplexity > 1.3 * max(got[i][0].perplexity for i in range(120))
    assert got[1001][0].words is None and got[1001][0].log_likelihood is None
    assert (got[1002][0].words, got[1002][0].log_likelihood, got[1002][0].perplexity) == (0, 0.0, None) and got[1003][0].words == 0
    assert got[1004][0].words == 40000 and math.isfinite(got[1004][0].log_likelihood)
    assert got[1005][0] == got[1005][1] and got[1005][0].log_likelihood == got[1006][0].log_likelihood
    assert H.score(frame(spark, [])).count() == 0


def test_each_word_has_its_own_probability(spark):
    words = {f"w{i}": 1 + i % 5 for i in range(40)} | {"top": 90, "next": 80}
    rows = [(i, w) for i, w in enumerate(w for w, n in words.items() for _ in range(n))]
    p = {}
    for r in H.score(frame(spark, rows), vocabulary=2, shared=1, states=2, rounds=3).collect():
        p.setdefault(rows[r.doc_id][1], set()).add(r.log_likelihood)
    assert all(len(x) == 1 for x in p.values())
    p = {w: math.exp(*x) for w, x in p.items()}
    assert math.isclose(sum(p.values()), 1, rel_tol=1e-6)
    assert math.isclose(p["w4"] / p["w0"], 5, rel_tol=1e-6) and p["w5"] == p["w0"]


def test_long_texts_join_the_counts_of_all_rare_words(spark):
    rows = [(i, " ".join(f"r{(i * 7 + k) % 300}" for k in range(50 + i))) for i in range(60)]
    count = Counter(w for _, t in rows for w in t.split())
    got = {r.doc_id: r for r in H.score(frame(spark, rows), vocabulary=0, shared=1, states=2, rounds=1).collect()}
    for i, t in rows:  # one class: the model is the unigram model
        want = sum(math.log(count[w] / count.total()) for w in t.split())
        assert math.isclose(got[i].log_likelihood, want, rel_tol=1e-9) and math.isclose(got[i].perplexity, math.exp(-want / len(t.split())), rel_tol=1e-9)


def test_states_of_languages_part_in_few_rounds():
    # texts of one of four vocabularies: a word must tell much about the next
    rng = np.random.default_rng(7)
    off = np.arange(0, 40 * 101, 40)
    sym = np.concatenate([rng.integers(0, 50, 40) + 50 * (i % 4) for i in range(100)])
    counts = np.bincount(sym, minlength=200).astype(float)
    model = H.start(counts, 8)
    for _ in range(6):
        _, model = step(model, sym, off, prior=0.01)
    gain = H.log_likelihoods(model, sym, off).sum() / len(sym) - (counts / len(sym) * np.log(counts / len(sym))).sum()
    assert gain > 0.7 * math.log(4)
