import random
import re

import numpy as np
import pytest
from cases import LONG, ODD, frame, with_clashes
from hypothesis import given, settings
from hypothesis import strategies as st

from tokenwright.llm import suffix as S


def brute_lpf(x):
    out = []
    for i in range(len(x)):
        best = 0
        for j in range(i):
            k = 0
            while i + k < len(x) and x[j + k] == x[i + k]:
                k += 1
            best = max(best, k)
        out.append(best)
    return out


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60))
def test_longest_previous_factor(x):
    assert S.longest_previous(np.array(x, np.int64), 64).tolist() == brute_lpf(x)


def words(t):
    return re.findall(r"[0-9A-Za-z\u0080-\U0010ffff]+", t.lower())


def brute_spans(rows, n):
    seen, out = set(), {}
    for key, t in sorted(rows):
        w = words(t)
        cover = np.zeros(len(w), bool)
        for i in range(len(w) - n + 1):
            k = tuple(w[i : i + n])
            if k in seen:
                cover[i : i + n] = True
            seen.add(k)
        out[key] = cover.tolist()
    return out


@pytest.mark.parametrize("n, seed, hot", [(10, 1, 10**6), (10, 2, 10**6), (50, 3, 10**6), (4, 4, 10**6), (10, 1, 1), (50, 3, 2)])
def test_cuts_match_brute_force(spark, n, seed, hot):
    rnd = random.Random(seed)
    passages = [[f"p{k}w{i}" for i in range(rnd.randint(n - 2, 4 * n))] for k in range(6)]
    rows = []
    for d in range(60):
        w = []
        for _ in range(rnd.randint(0, 5)):
            p = rnd.choice(passages)
            a = rnd.randint(0, 3)
            w += p[a : len(p) - rnd.randint(0, 3)] if rnd.random() < 0.6 else [rnd.choice("abcdef") for _ in range(rnd.randint(1, 2 * n))]
        rows.append((d, " ".join(w)))
    want = brute_spans(rows, n)
    for r in S.suffix_dedup(frame(spark, rows), n, hot_kinds=hot).collect():
        got = np.zeros(len(want[r.doc_id]), bool)
        for s in r.spans:
            got[s.lo : s.hi] = True
        assert got.tolist() == want[r.doc_id] and r.removed == got.sum()
        assert words(r.text) == [w for w, cut in zip(words(dict(rows)[r.doc_id]), got) if not cut]


def test_first_copy_stays_and_text_is_cut_at_words(spark):
    p = " ".join(f"w{i}" for i in range(12))
    rows = [(3, f"Ended: {p}! Then é more."), (2, f"{p}."), (1, f"Start ({p}) end"), (4, p)]
    got = {r.doc_id: r for r in S.suffix_dedup(frame(spark, rows), 10).collect()}
    assert got[1].text == rows[2][1] and got[1].spans == []
    assert got[3].text == "Ended: Then é more." and got[2].text == "" and got[4].text == ""


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [*ODD, (5, long), (6, long), (6, long), (7, f"{long} new"), (None, f"x {long}")]
    df = with_clashes(frame(spark, rows))
    got = S.suffix_dedup(df).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert by[1001][0].text is None and by[1002][0].text == "" and by[1005][0].text == "same text here twice"
    assert by[1004][0].text == "long words " or len(words(by[1004][0].text)) == 2  # one period of a loop
    assert [r.text for r in by[6]] == ["", ""] and by[7][0].text == "new" and by[5][0].text == long
    assert "x " in {r.text for r in by[None]}
    kept = S.cut_repeats(df)
    assert kept.columns == df.columns
    rows_kept = {(r.doc_id, r.text): r for r in kept.collect()}
    assert rows_kept[(7, "new")].n_chars == 3 and rows_kept[(7, "new")].spans == 7
    assert not any(i == 6 for i, _ in rows_kept) and (1002, "") in rows_kept and (1001, None) in rows_kept
    assert S.suffix_dedup(frame(spark, [])).count() == 0
    assert len(words(LONG)) == 40000


def test_half_of_all_texts_share_a_phrase(spark):
    phrase = " ".join(f"licence{i}" for i in range(30))
    rows = [(i, f"{phrase} " + " ".join(f"own{i // 3}w{k}" for k in range(60)) if i % 2 else " ".join(f"u{i}w{k}" for k in range(70))) for i in range(80)]
    want = brute_spans(rows, 50)
    for r in S.suffix_dedup(frame(spark, rows), 50, hot_kinds=5).collect():
        got = np.zeros(len(want[r.doc_id]), bool)
        for s in r.spans:
            got[s.lo : s.hi] = True
        assert got.tolist() == want[r.doc_id]


def test_null_ids_are_documents_of_their_own(spark):
    p, q = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(60))
    rows = [(None, p), (None, f"{q} tail"), (None, f"head {q}"), (2**63 - 1, p)]
    got = sorted((str(r.doc_id), r.text) for r in S.suffix_dedup(frame(spark, rows)).collect())
    assert ("9223372036854775807", p) in got and ("None", "") in got
    assert ("None", f"{q} tail") in got and ("None", "head ") in got or ("None", f"head {q}") in got and ("None", "tail") in got


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60), st.integers(1, 12))
def test_longest_previous_factor_from_a_length_on(x, least):
    got, want = S.longest_previous(np.array(x, np.int64), 64, least), np.array(brute_lpf(x), np.int64)
    assert (got[want >= least] == want[want >= least]).all() and (got <= want).all()


def test_texts_are_searched_once_also_where_anchors_are_hot(spark):
    p = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join([*p[: 20 + i % 20], *(f"own{i}w{k}" for k in range(20))])) for i in range(30)]
    plan = S.repeated_spans(frame(spark, rows), 10, hot_kinds=2)._jdf.queryExecution().toString()
    assert "win#" in plan and not re.search(r"\btext\b|\bwant\b", plan)


def test_repeated_rows_are_one_document(spark):
    p = [f"w{i}" for i in range(90)]
    rows = [(1, " ".join(p)), (1, " ".join(p)), (2, " ".join([*p[:55], *(f"x{i}" for i in range(40))]))]
    for hot in (1, 10**6):
        got = sorted((r.doc_id, r.removed) for r in S.suffix_dedup(frame(spark, rows), 50, hot_kinds=hot).collect())
        assert got == [(1, 0), (1, 0), (2, 55)]
