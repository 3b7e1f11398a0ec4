import random

import numpy as np
from cases import ODD, frame, with_clashes

from tokenwright.llm import kernel as K
from tokenwright.llm import quality as Q
from tokenwright.llm import toxicity as T


def labelled(seed=1, n=400):
    rnd = random.Random(seed)
    calm = [f"calm{i}" for i in range(300)]
    rude = [f"rude{i}" for i in range(12)]
    rows, labels = [], []
    for i in range(n):
        toxic = i % 4 == 0
        words = [rnd.choice(calm) for _ in range(rnd.randint(30, 200))]
        if toxic:
            for _ in range(rnd.randint(2, 12)):
                words[rnd.randrange(len(words))] = rnd.choice(rude)
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


def label_frame(spark, labels):
    return spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_toxicity(spark):
    rows, labels = labelled()
    got = T.toxicity(frame(spark, rows), label_frame(spark, labels[:250])).collect()
    held = [(r.is_toxic, bool(labels[r.doc_id][1])) for r in got if r.doc_id >= 250]
    assert sum(a == b for a, b in held) / len(held) > 0.97
    hits = {i: sum(w.startswith("rude") for w in t.split()) for i, t in rows}
    high = [r.severity for r in got if hits[r.doc_id] >= 10]
    low = [r.severity for r in got if 0 < hits[r.doc_id] <= 3]
    assert np.mean(high) > np.mean(low) + 0.5  # more of it is graded worse


def test_graded_and_shifted_labels(spark):
    rows, labels = labelled()
    shifted = T.toxicity(frame(spark, rows), label_frame(spark, [(i, 2 * t) for i, t in labels])).collect()
    plain = {r.doc_id: r.is_toxic for r in T.toxicity(frame(spark, rows), label_frame(spark, labels)).collect()}
    assert {r.doc_id: r.is_toxic for r in shifted} == plain and sum(plain.values()) > 80
    hits = {i: sum(w.startswith("rude") for w in t.split()) for i, t in rows}
    graded = [(i, 0 if not h else 1 if h < 4 else 3 if h < 8 else 7) for i, h in hits.items()]
    got = {r.doc_id: r for r in T.toxicity(frame(spark, rows), label_frame(spark, graded[:300])).collect()}
    rank = {0: 0, 1: 1, 3: 2, 7: 3}
    held = [(got[i].grade, rank[g]) for i, g in graded[300:]]
    assert sum(a == b for a, b in held) / len(held) > 0.75 and sum(abs(a - b) > 1 for a, b in held) == 0
    assert all(got[i].is_toxic == (g > 0) for i, g in graded[300:])


def test_ordinal_fit_keeps_thresholds_in_order_and_shares_weights():
    rng = np.random.default_rng(0)
    x = rng.normal(size=600)
    grade = np.digitize(x + rng.logistic(size=600) * 0.3, [-1, 0, 1])
    w, theta = T.fit_ordinal(np.arange(600), np.zeros(600, int), x, grade, 1, 4, steps=1500)
    assert w[0] > 1 and np.all(np.diff(theta) > 0)
    ex, most, p = T.severity(np.array([-50.0, 50.0]), theta)
    assert abs(ex[0]) < 1e-3 and abs(ex[1] - 3) < 1e-3 and most.tolist() == [0, 3]


def test_toxicity_odd_rows(spark):
    rows, labels = labelled(2, 160)
    rows += ODD
    more = [*labels, (None, 1), (5, None), (0, 0), (1001, 1)]
    df = with_clashes(frame(spark, rows))
    got = T.toxicity(df, label_frame(spark, more)).collect()
    assert len(got) == len(rows) and not any(r.is_toxic for r in got if r.doc_id is None or r.doc_id > 1000)
    kept = T.reject_toxic(df, label_frame(spark, more))
    assert kept.columns == df.columns
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(map(str, (r.doc_id for r in got if not r.is_toxic)))
    none = label_frame(spark, [(1, 0), (2, 0)])
    assert {r.severity for r in T.toxicity(df, none).collect()} == {0.0} and T.reject_toxic(df, none).count() == len(rows)
    assert T.toxicity(frame(spark, []), label_frame(spark, more)).count() == 0
    assert T.reject_toxic(frame(spark, []), label_frame(spark, [])).count() == 0


def test_em_recovers_accuracies():
    rng = np.random.default_rng(1)
    truth = rng.random(20000) < 0.7
    accuracy = [0.9, 0.8, 0.75, 0.7, 0.85, 0.65, 0.8]
    v = np.stack([np.where(rng.random(20000) < 0.3, Q.ABSTAIN, np.where((rng.random(20000) < a) == truth, Q.GOOD, Q.BAD)) for a in accuracy], axis=1)
    codes, counts = np.unique(Q.pattern(v), return_counts=True)
    prior, tab, post = Q.fit_labellers(codes, counts.astype(float))
    assert abs(prior - 0.7) < 0.03
    right = (tab[:, 1, Q.GOOD] / (tab[:, 1, Q.GOOD] + tab[:, 1, Q.BAD])).tolist()
    assert np.allclose(right, accuracy, atol=0.04)
    guess = post[np.searchsorted(codes, Q.pattern(v))] >= 0.5
    assert (guess == truth).mean() > 0.93


def texts(n=200):
    rnd = random.Random(3)
    words = ["small", "river", "house", "walks", "under", "green", "trees", "and", "then", "quietly", "evening", "stone"] + [f"name{i}" for i in range(300)]
    out = []
    for i in range(n):
        if i % 4:
            out.append((i, " ".join(" ".join(rnd.choice(words) for _ in range(9)).capitalize() + "." for _ in range(12))))
        else:
            out.append((i, "BUY NOW!!! $$$ " * 40 + "|".join(rnd.choice("#%&*") for _ in range(100))))
    return out


def test_quality_tells_junk(spark):
    got = {r.doc_id: r for r in Q.quality(frame(spark, texts())).collect()}
    assert np.mean([r.keep == bool(i % 4) for i, r in got.items()]) > 0.97


def test_quality_odd_rows(spark):
    rows = texts(80) + ODD
    got = Q.quality(with_clashes(frame(spark, rows))).collect()
    assert len(got) == len(rows)
    assert not any(r.keep for r in got if r.doc_id in (1001, 1002, 1003))
    assert Q.quality(frame(spark, [])).count() == 0


def test_distinct_words_of_rows():
    rng = np.random.default_rng(0)
    off = np.array([0, 0, 40, 41, 300])
    h = K.mix(rng.integers(0, 30, 300).astype(np.uint64))
    assert K.row_distinct(h, off).tolist() == [len(set(h[a:b].tolist())) for a, b in zip(off, off[1:])]
    assert K.row_distinct(h[:0], np.array([0, 0])).tolist() == [0]


def brute_labellers(v, rounds):
    """EM by loops over documents, labellers and votes."""
    n, m = v.shape
    prior, tab = 0.5, [[[0.4, 0.48, 0.12], [0.4, 0.12, 0.48]] for _ in range(m)]
    post = [0.5] * n
    for _ in range(rounds):
        for i in range(n):
            p = [1 - prior, prior]
            for k in range(m):
                for c in (0, 1):
                    p[c] *= tab[k][c][v[i, k]]
            post[i] = p[1] / (p[0] + p[1])
        prior = sum(post) / n
        for k in range(m):
            for c in (0, 1):
                mass = [0.5 + sum(post[i] if c else 1 - post[i] for i in range(n) if v[i, k] == x) for x in range(3)]
                tab[k][c] = [x / sum(mass) for x in mass]
    return prior, np.array(tab), np.array(post)


def test_em_matches_brute_force():
    rng = np.random.default_rng(3)
    truth = rng.random(60) < 0.6
    v = np.stack([np.where(rng.random(60) < 0.2, 0, np.where((rng.random(60) < 0.8) == truth, 2, 1)) for _ in range(7)], axis=1)
    codes, counts = np.unique(Q.pattern(v), return_counts=True)
    prior, tab, post = Q.fit_labellers(codes, counts.astype(float), rounds=12)
    want = brute_labellers(v, 12)
    assert np.isclose(prior, want[0]) and np.allclose(tab, want[1]) and np.allclose(post[np.searchsorted(codes, Q.pattern(v))], want[2])


def test_quality_of_rows_without_ids_and_of_one_id(spark):
    rows = [(None, t) for _, t in texts(40)] + [(7, t) for _, t in texts(60)]
    got = Q.quality(frame(spark, rows), sample_rows=50).collect()
    assert len(got) == 100 and np.mean([r.keep for r in got]) > 0.5
