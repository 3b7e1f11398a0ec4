import itertools
import random
import time

import numpy as np
import pytest
from cases import ODD, frame, with_clashes
from hypothesis import given, settings
from hypothesis import strategies as st

from tokenwright.llm.exact_dedup import address_digits, drop_copies, exact_dedup, merge_runs
from tokenwright.llm.packing import best_fit, local_search, pack, pack_lengths


def brute_copies(rows):
    by = {}
    for i, t in rows:
        if t is not None:
            by.setdefault(t, []).append(i)
    return by


@pytest.mark.parametrize("fan_in", [2, 8])
def test_exact_dedup_matches_brute_force(spark, fan_in):
    rnd = random.Random(1)
    rows = [(i, rnd.choice("abcdefgh") * rnd.randint(0, 3)) for i in range(300)] + [(900, None), (901, None)]
    rnd.shuffle(rows)
    by = brute_copies(rows)
    got = exact_dedup(frame(spark, rows), fan_in=fan_in).collect()
    assert len(got) == len(rows)
    for r in got:
        t = dict(rows)[r.doc_id]
        want = by[t] if t is not None else [r.doc_id]
        assert (r.keep_id, r.copies, r.is_kept) == (min(want), len(want), r.doc_id == min(want))


def test_exact_dedup_odd_rows(spark):
    got = exact_dedup(frame(spark, ODD)).collect()
    assert len(got) == len(ODD)
    assert sum(r.is_kept for r in got) == len({t for _, t in ODD if t is not None}) + sum(t is None for _, t in ODD)
    assert exact_dedup(frame(spark, [])).count() == 0


def test_drop_copies_keeps_columns_and_one_of_repeated_rows(spark):
    rows = [(1, "a"), (1, "a"), (2, "a"), (3, None), (3, None), (4, ""), (5, ""), (1, "b"), (None, "c"), (None, "c"), (6, "c")]
    df = with_clashes(frame(spark, rows))
    out = drop_copies(df)
    assert out.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted([(1, "a"), (3, None), (3, None), (4, ""), (1, "b"), (6, "c")], key=str)
    assert drop_copies(frame(spark, [])).count() == 0


def test_addresses():
    for n in (1, 7, 8, 9, 200, 5000):
        m, r = address_digits(n)
        assert m**r >= n and m <= 8


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 20), max_size=60))
def test_packing_is_sound_and_no_worse_than_best_fit(sizes):
    sizes = sorted(sizes, reverse=True)
    first = best_fit(sizes, 20)
    bins = pack_lengths(sizes, 20, 1.0)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in b) <= 20 for b in bins)
    assert len(bins) <= len(first)
    square = lambda bs: sum(sum(sizes[i] for i in b) ** 2 for b in bs)
    assert square(bins) >= square(first)


def test_swaps_empty_a_bin():
    # best-fit of this order leaves three bins; a two-for-one exchange makes two
    sizes = [6, 5, 4, 3, 2]
    assert len(local_search([[0, 4], [1, 3], [2]], sizes, 10, 1.0)) == 2


def test_pack_table(spark):
    rows = [(i, "word " * int(n)) for i, n in enumerate(np.random.default_rng(3).integers(1, 400, 300))] + ODD
    got = pack(with_clashes(frame(spark, rows)), capacity=512).collect()
    fill, cut = {}, {}
    for r in got:
        fill[r.bin_id] = fill.get(r.bin_id, 0) + r.tokens
        cut.setdefault((r.doc_id, r.piece), []).append(r.tokens)
    assert all(fill[r.bin_id] == r.bin_fill <= 512 for r in got)
    total = sum(sum(-(-len(w.encode()) // 4) for w in (t or "").split()) for _, t in rows)
    assert sum(fill.values()) == total
    assert len(fill) <= total / 512 * 1.1 + 8
    assert pack(frame(spark, [])).count() == 0


def test_exact_dedup_with_hot_texts_clashes_and_the_largest_id(spark):
    rows = [(i, "hot") for i in range(3000)] + [(7, "hot")] * 500 + [(2**63 - 1, "late"), (None, "late"), (None, "only"), (None, "only")] + [(i, f"own {i}") for i in range(2000)]
    got = exact_dedup(with_clashes(frame(spark, rows)), fan_in=2).collect()
    assert len(got) == len(rows)
    hot = [r for r in got if r.copies == 3500]
    assert len(hot) == 3500 and {r.keep_id for r in hot} == {0} and sum(r.is_kept for r in hot) == 1
    late = [r for r in got if r.keep_id == 2**63 - 1]
    assert sorted(r.is_kept for r in late) == [False, True] and {r.doc_id for r in late if r.is_kept} == {2**63 - 1}
    only = [r for r in got if r.keep_id is None]
    assert len(only) == 2 and sum(r.is_kept for r in only) == 1 and all(r.copies == 2 for r in only)
    df = with_clashes(frame(spark, rows))
    kept = drop_copies(df)
    assert kept.columns == df.columns and all(r["__d"] == 7 and r["a.b"] == 7 for r in kept.collect())
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in got if r.is_kept)


def test_runs_merge_like_a_sort():
    rng = np.random.default_rng(5)
    runs = []
    for _ in range(7):
        d = rng.integers(0, 3, (50, 4)).astype(np.uint64)  # words that tie often
        n = np.ones(50, np.int64)
        runs.append(merge_runs(d, d[:, 3].astype(np.int64), n, rng.integers(0, 99, 50), rng.integers(0, 2, 50).astype(np.uint8)))
    got = merge_runs(*(np.concatenate(x) for x in zip(*runs)))
    want = {}
    for d, ln, n, i, ok in zip(*(np.concatenate(x) for x in zip(*runs))):
        key = (*d.tolist(), int(ln))
        old = want.get(key, (0, None))
        want[key] = (old[0] + int(n), min([x for x in (old[1], int(i) if ok else None) if x is not None], default=None))
    assert [(*d.tolist(), int(x)) for d, x in zip(got[0], got[1])] == sorted(want)
    assert [(int(n), int(i) if ok else None) for n, i, ok in zip(*got[2:])] == [want[k] for k in sorted(want)]


def least_bins(sizes, capacity):
    """The true optimum, by trying every way."""
    best = [len(sizes)]

    def place(k, fills):
        if len(fills) >= best[0]:
            return
        if k == len(sizes):
            best[0] = len(fills)
            return
        for b in range(len(fills)):
            if fills[b] + sizes[k] <= capacity:
                place(k + 1, [*fills[:b], fills[b] + sizes[k], *fills[b + 1 :]])
        place(k + 1, [*fills, sizes[k]])

    place(0, [])
    return best[0]


def can_improve(bins, sizes, capacity):
    """Whether any move, one-for-one or two-for-one exchange raises the sum of squared fills."""
    fills = [sum(sizes[i] for i in b) for b in bins]
    for s, src in enumerate(bins):
        for d, dst in enumerate(bins):
            if s != d and fills[s] <= fills[d] < capacity:
                out = [sizes[i] for i in src] + [sizes[a] + sizes[b] for a, b in itertools.combinations(src, 2)]
                if any(0 < x - y <= capacity - fills[d] for x in out for y in [0, *(sizes[j] for j in dst)]):
                    return True
    return False


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9), st.randoms(use_true_random=False))
def test_search_ends_where_nothing_improves_and_near_the_optimum(sizes, rnd):
    bins = [[i] for i in range(len(sizes))]
    rnd.shuffle(bins)
    got = local_search(bins, sizes, 20, 1.0)
    assert sorted(i for b in got for i in b) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in b) <= 20 for b in got) and not can_improve(got, sizes, 20)
    packed = pack_lengths(sorted(sizes, reverse=True), 20, 1.0)
    assert len(packed) <= least_bins(sizes, 20) + 1


def test_search_over_many_underfull_bins_is_quick():
    sizes = sorted(np.random.default_rng(0).integers(int(0.51 * 4096), int(0.95 * 4096), 20000).tolist(), reverse=True)
    began = time.process_time()
    assert len(pack_lengths(sizes, 4096)) == len(sizes)
    mixed = sorted(np.random.default_rng(1).integers(1, 3000, 20000).tolist(), reverse=True)
    bins = pack_lengths(mixed, 4096)
    assert time.process_time() - began < 60
    assert len(bins) <= sum(mixed) / 4096 * 1.02 + 1


def test_pack_by_given_lengths(spark):
    df = spark.createDataFrame([(1, 10), (2, None), (None, 9000), (1, 10), (3, 0)], "doc_id long, n_tokens long")
    got = pack(df, tokens_col="n_tokens").collect()
    assert sorted((str(r.doc_id), r.piece, r.tokens) for r in got) == [("1", 0, 10), ("1", 0, 10), ("2", 0, 0), ("3", 0, 0), ("None", 0, 4096), ("None", 1, 4096), ("None", 2, 808)]


def test_null_ids_don_t_share_a_shard(spark):
    got = pack(frame(spark, [(None, "word " * 40)] * 400 + [(i, "word " * 30) for i in range(100)]), capacity=512, shard_items=50)
    assert got.count() == 500 and got.agg({"bin_fill": "max"}).first()[0] <= 512
