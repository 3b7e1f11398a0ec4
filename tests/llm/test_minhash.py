import random
import re

import numpy as np
from cases import ODD, frame, with_clashes

from tokenwright.llm import minhash as M
from tokenwright.llm.common import bucket_pairs, components


def runs(t):
    w = re.findall(r"[0-9A-Za-z\u0080-\U0010ffff]+", t.lower())
    return {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set()


def corpus(rnd, groups=40, size=4, edits=0.06):
    words = ["".join(rnd.choice("abcdefghij") for _ in range(5)) for _ in range(3000)]
    rows = []
    for g in range(groups):
        base = [rnd.choice(words) for _ in range(rnd.randint(30, 200))]
        for k in range(size):
            text = [rnd.choice(words) if k and rnd.random() < edits * rnd.random() else w for w in base]
            rows.append((g * 100 + k, " ".join(text)))
    return rows


def test_recall_against_brute_force(spark):
    rows = corpus(random.Random(2))
    sets = {i: runs(t) for i, t in rows}
    ids = sorted(sets)
    pairs = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(sets[a] & sets[b]) >= 0.5 * len(sets[a] | sets[b])]
    got = {r.doc_id: r.keep_id for r in M.near_dedup(frame(spark, rows)).collect()}
    assert sum(got.get(a, -1) == got.get(b, -2) for a, b in pairs) >= 0.95 * len(pairs)
    assert set(got) <= {x for p in pairs for x in p}  # nothing that isn't near to something


def test_groups_across_a_bucket_are_told_apart(spark):
    # one opening, many endings: buckets mix texts that aren't near to each other
    rnd = random.Random(4)
    opening = " ".join(f"open{i}" for i in range(40))
    rows = []
    for g in range(12):
        end = [f"g{g}w{i}" for i in range(120)]
        for k in range(3):
            rows.append((g * 10 + k, opening + " " + " ".join(w if rnd.random() > 0.02 * k else "edit" for w in end)))
    got = {r.doc_id: r.keep_id for r in M.near_dedup(frame(spark, rows)).collect()}
    assert all(got[i] == i // 10 * 10 for i, _ in rows)


def test_odd_rows(spark):
    base = " ".join(f"w{i}" for i in range(50))
    rows = ODD + [(5, base), (6, base + " more"), (7, base.upper()), (5, base)]
    df = with_clashes(frame(spark, rows))
    got = {r.doc_id: (r.keep_id, r.is_kept) for r in M.near_dedup(df).collect()}
    assert got == {5: (5, True), 6: (5, False), 7: (5, False), 1005: (1005, True), 1006: (1005, False)}
    kept = M.drop_near(df)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in rows} - {6, 7, 1006}
    assert M.near_dedup(frame(spark, [])).count() == 0 and M.drop_near(frame(spark, [])).count() == 0


def test_minima_estimate_similarity():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 2**63, 1500).astype(np.uint64)
    sig = M.minima(np.concatenate([h[:1000], h[500:]]), np.array([0, 1000, 2000]), 512)
    assert abs((sig[0] == sig[1]).mean() - 1 / 3) < 0.07


def test_components(spark):
    rnd = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 60)] + [(rnd.randint(100, 200), rnd.randint(100, 200)) for _ in range(60)] + [(5, 5), (None, 3)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}


def brute_groups(rows, threshold=0.5):
    sets = {i: runs(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    groups = {}
    for i in ids:
        groups.setdefault(find(i), []).append(i)
    return {i: min(g) for g in groups.values() if len(g) > 1 for i in g}


def test_half_of_all_rows_in_one_bucket(spark, monkeypatch):
    # half of all texts have one opening and differ behind it, some are copies of each other
    monkeypatch.setattr(M, "bucket_pairs", lambda rows, keys: bucket_pairs(rows, keys, cell=7))
    rnd = random.Random(11)
    opening = " ".join(f"licence{i}" for i in range(60))
    rows = []
    for i in range(120):
        if i % 2:
            end = [f"e{i // 8}w{k}" for k in range(70)]
            rows.append((i, opening + " " + " ".join(w if rnd.random() > 0.02 else "z" for w in end)))
        else:
            rows.append((i, " ".join(f"own{i}w{k}" for k in range(80))))
    got = {r.doc_id: r.keep_id for r in M.near_dedup(frame(spark, rows)).collect()}
    assert got == brute_groups(rows)


def test_cells_hold_every_pair(spark):
    rows = [(k, n, n % 3) for k, size in (("hot", 40), ("two", 2), ("one", 1)) for n in range(size)]
    df = spark.createDataFrame(rows, "key string, node long, root long")
    want = {(k, a, b) for k, a, r in rows for j, b, s in rows if k == j and a < b and r != s}
    got = [tuple(r) for r in bucket_pairs(df, ["key"], cell=6).collect()]
    assert set(got) == want and len(got) == len(want)


def test_ids_with_several_texts_and_null_ids(spark):
    base, other = " ".join(f"w{i}" for i in range(50)), " ".join(f"v{i}" for i in range(50))
    rows = [(1, base), (2, base + " more"), (2, other), (None, base + " end"), (None, "alone here"), (3, other), (3, other), (1, base)]
    df = with_clashes(frame(spark, rows))
    kept = sorted(((str(r.doc_id), r.text) for r in M.drop_near(df).collect()))
    assert kept == sorted([("1", base), ("2", other), ("None", "alone here")])
    got = {(r.doc_id, r.keep_id, r.is_kept) for r in M.near_dedup(df).collect()}
    assert got == {(1, 1, True), (2, 1, False), (None, 1, False), (2, 2, True), (3, 2, False)}


def test_links_are_counted(spark):
    base = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(base)), (2, " ".join([*base, "x"])), (3, " ".join([*base, "y"])), (4, " ".join(f"v{i}" for i in range(60)))]
    got = {r.doc_id: r for r in M.near_dedup(frame(spark, rows)).collect()}
    assert set(got) == {1, 2, 3} and all(r.group_size == 3 and r.links >= 1 for r in got.values())
