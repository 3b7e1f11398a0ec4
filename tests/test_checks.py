import math

import pytest
from pyspark.sql import functions as F

from tokenwright.functions.tokens import token_count
from tokenwright.operators import checks as C
from tokenwright.operators import rewrite as R
from tokenwright.operators.summary import summary
from tokenwright.plans import queries as Q
from tokenwright.plans.audit import Audit
from tokenwright.sources.tables import REQUESTS

ROW = {"request_id": 0, "ingest_seq": 0, "source": "s", "model": "m", "completion": None, "weight": 1, "messages": [], "tools": [], "tools_called": []}


def requests(spark, rows):
    out = []
    for i, r in enumerate(rows):
        messages = [{"pos": k, "role": role, "content": text} for k, (role, text) in enumerate(r.get("m", [("user", "hi")]))]
        tools = [{"pos": k, "name": n, "schema_json": j} for k, (n, j) in enumerate(r.get("t", []))]
        out.append({**ROW, "request_id": i, "ingest_seq": i, "source": f"log:{i}", "messages": messages, "tools": tools, **{k: v for k, v in r.items() if k in ROW}})
    return spark.createDataFrame(out, REQUESTS)


def run(spark, check, rows, **more):
    return check(C.prepare(requests(spark, rows)), **more).collect()


def n_of(spark, text):
    return spark.createDataFrame([(text,)], "t string").select(token_count("t").alias("n")).first().n


def system(words, users=("a", "b", "c"), **more):
    return [{"m": [("system", "word " * words), ("user", u)], **more} for u in users]


@pytest.mark.parametrize("words, check", [(1021, "stable-prefix-below-cache-floor"), (1022, "cacheable-prefix"), (126, "stable-prefix-below-cache-floor"), (125, None)])
def test_shared_prefix_thresholds(spark, words, check):
    # the blank and the line end before the user's text are two tokens more
    got = run(spark, C.shared_prefix, system(words))
    assert [f.check for f in got] == ([check] if check else [])
    if check:
        t = words + 2
        assert got[0].calls_affected == 3
        assert got[0].tokens_saved == (int(t * 3 - (t + t * 2 * 0.5)) if check == "cacheable-prefix" else t * 2)


def test_shared_prefix_groups_by_model_and_needs_two(spark):
    assert run(spark, C.shared_prefix, system(200, ["a"], weight=5)) == []
    rows = system(200, "ab", model="x") + system(200, "c", model="y") + system(200, "de", model=None)
    assert run(spark, C.shared_prefix, rows) == []  # two calls each are not three
    assert len(run(spark, C.shared_prefix, rows, min_calls=2)) == 2


def test_repeated_system(spark):
    rows = system(100, "ab") + system(80, "cde")
    (f,) = run(spark, C.repeated_system, rows, min_redundant=100)
    assert (f.tokens_saved, f.calls_affected) == (80, 3)  # the one with most calls
    assert run(spark, C.repeated_system, system(67)) == [] or n_of(spark, "word " * 67) * 2 >= 200
    assert run(spark, C.repeated_system, system(49, "abcdefgh")) == []
    assert len(run(spark, C.repeated_system, system(50, "abcdefgh"))) == 1


BLOCK = "the refund rules apply to every parcel that was sent by the customer before the first of the month and no later"


def test_duplicate_blocks(spark):
    rows = [{"m": [("user", f"{BLOCK}\n\nq{i}")]} for i in range(6)]
    t = n_of(spark, BLOCK)
    (f,) = run(spark, C.duplicate_blocks, rows)
    assert (f.tokens_saved, f.calls_affected) == (t * 5, 6)
    assert run(spark, C.duplicate_blocks, [{"m": [("system", BLOCK)]} for _ in range(6)]) == []
    assert run(spark, C.duplicate_blocks, rows[:1] * 1) == []


def test_top_blocks_are_taken_before_the_floors(spark):
    short = [" ".join(f"{c}{k:02d}" for c in "abcdefghijklmnopqrstuvwxyz"[:22]) for k in range(3)]
    rows = [{"m": [("user", "\n\n".join(short))]} for _ in range(3)] + [{"m": [("user", BLOCK)]} for _ in range(2)]
    assert len(run(spark, C.duplicate_blocks, rows, top=3, min_tokens=1, min_wasted=1, min_total=1)[0].evidence) == 3
    assert len(run(spark, C.duplicate_blocks, rows, top=4, min_tokens=1, min_wasted=1, min_total=1)[0].evidence) == 4


def test_whitespace(spark):
    rows = [{"m": [("user", "a  \nb\n\n\n\nc    d")], "weight": w} for w in (10, 99)]
    (f,) = run(spark, C.whitespace_bloat, rows)
    delta = n_of(spark, "a  \nb\n\n\n\nc    d") - n_of(spark, "a\nb\n\nc d")
    assert (f.tokens_saved, f.calls_affected, f.evidence) == (delta * 109, 109, [f"log:{i}: {delta} tok/call" for i in (0, 1)])
    assert run(spark, C.whitespace_bloat, [{"m": [("user", "clean text")]}]) == []


def test_pretty_json(spark):
    blob = '{\n    "a": [\n        1,\n        2,\n        3\n    ],\n    "b": "}"\n}'
    small = '{"a":[1,2,3],"b":"}"}'
    (f,) = run(spark, C.pretty_json, [{"m": [("user", f"see {blob} now")], "weight": 5}])
    assert f.tokens_saved == 5 * (n_of(spark, blob) - n_of(spark, small))
    assert run(spark, C.pretty_json, [{"m": [("user", f"see {small}\nnow")], "weight": 50}]) == []


def test_fillers(spark):
    (f,) = run(spark, C.filler_phrases, [{"m": [("user", "In order to win, do your best. DO YOUR BEST")], "weight": 3}])
    assert f.tokens_saved == 3 * (3 + 3 + 3) and f.evidence[0] == 'x6  "do your best"  -- changes nothing'
    assert run(spark, C.filler_phrases, [{"m": [("user", "border too")], "weight": 99}]) == []


def test_restated(spark):
    s = "Answer every question in the language in which it was put."
    t = n_of(spark, s.lower())
    (f,) = run(spark, C.restated, [{"m": [("user", f"{s} {s}\n\n{s}")]}])
    assert f.tokens_saved == 2 * t
    assert run(spark, C.restated, [{"m": [("user", f"{s} Other.")], "weight": 9}, {"m": [("user", s)]}]) == []


@pytest.mark.parametrize("marks, fires", [(5, False), (6, True)])
def test_fewshot(spark, marks, fires):
    text = "Start.\n" + "\n".join(f"Input {i}: " + "word " * 50 for i in range(marks))
    got = run(spark, C.fewshot, [{"m": [("user", text)]}])
    assert bool(got) == fires
    if fires:
        assert got[0].tokens_saved == n_of(spark, text[text.index("\nInput") + 1 :]) // 2 or got[0].tokens_saved > 0


def test_io_imbalance(spark):
    rows = [{"m": [("user", "word " * n)], "completion": "ok"} for n in (100, 60, 10, 2)]
    (f,) = run(spark, C.io_imbalance, rows)
    assert (f.tokens_saved, f.calls_affected) == (0, 2) and f.evidence[0].startswith("log:0")
    assert "median 18x" in f.detail  # the third of four
    assert run(spark, C.io_imbalance, rows[:2]) == [] and run(spark, C.io_imbalance, rows[1:]) == []


def test_tools(spark):
    cost = {n: '{"name":"%s","description":"%s"}' % (n, "word " * k) for n, k in (("used", 100), ("idle", 120), ("rare", 300))}
    rows = [{"t": [(n, cost[n]) for n in ("used", "idle")], "tools_called": ["used"] if i < 2 else []} for i in range(4)]
    rows.append({"t": [("rare", cost["rare"])]})
    t = {n: n_of(spark, j) for n, j in cost.items()}
    total = 4 * (t["used"] + t["idle"]) + t["rare"]
    (f,) = run(spark, C.tool_schema_cost, rows)
    assert f.tokens_saved == int((total - total // 5) * 0.5) and f.evidence[0].startswith("rare")
    (g,) = run(spark, C.unused_tools, rows)
    assert g.tokens_saved == 4 * t["idle"]  # "rare" is declared in too few calls
    assert run(spark, C.unused_tools, [{**r, "tools_called": []} for r in rows]) == []


@pytest.mark.parametrize("turns, fires", [(9, False), (10, True)])
def test_history(spark, turns, fires):
    m = [("system", "s")] + [(("user", "assistant")[i % 2], "word " * 80) for i in range(turns)]
    got = run(spark, C.long_history, [{"m": m}])
    assert bool(got) == fires
    if fires:
        assert got[0].tokens_saved == 4 * n_of(spark, "word " * 80)


def test_empty_requests(spark):
    empty = requests(spark, []).where("false")
    assert C.findings(empty).collect() == []
    assert summary(empty).first().input_tokens == 0 and R.measure(empty).first().saved == 0
    assert Audit(empty).run() is None


def test_order_and_isolation(spark, monkeypatch):
    rows = system(1100, "abcdef", completion="x")
    got = C.findings(requests(spark, rows)).collect()
    keys = [(f.conf_rank, -f.tokens_saved) for f in got]
    assert keys == sorted(keys) and {"cacheable-prefix", "repeated-system-prompt"} <= {f.check for f in got}
    monkeypatch.setitem(C.CHECKS, "restated", lambda p: p.select(F.raise_error(F.lit("broken")).alias("x")))
    r = Audit(requests(spark, rows)).run()
    assert [f["title"] for f in r.findings if f["check"] == "restated"] == ["Check failed to run"]
    assert r.total("high") > 0 and r.summary["calls"] == 6


def test_projection_counts_what_can_be_saved(spark, tmp_path):
    system = "You answer questions of customers about parcels, customs and invoices. " * 12
    rows = [(c, k, r, x) for c in range(12) for k, (r, x) in enumerate([("system", system + f"Case {c}" * (c == 0)), ("user", f"Where is   parcel {c}?  \n\n\n\n\nThanks"), ("assistant", "On its way.")])]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    want = Audit(Q._padded_calls(spark, str(tmp_path)), settings=Q.SETTINGS).run()
    r = Q.QUERIES["projection"](spark, str(tmp_path)).first()
    calls = want.summary["calls"]
    assert want.measured["saved"] > 0 and want.total("high") > 0 and calls == 24 and r["safe_tokens"] == want.measured["saved"] + want.total("high")
    assert r["monthly_tokens"] == int(want.safe * (1e6 / calls)) and r["annual_tokens"] == int(want.safe * (1e6 / calls) * 12) and math.isclose(r["safe_pct"], want.pct, abs_tol=1e-5)


def test_tools_of_all_parts_are_declared(spark):
    d = "/root/testdata/sf0.001"
    got = {t for r in Q._part_tool_requests(spark, d).select("tools.name").collect() for t in r.name}
    sold = spark.read.parquet(f"{d}/lineitem.parquet").select("l_partkey").distinct()
    want = {f"tool_{r.p_partkey}" for r in spark.read.parquet(f"{d}/part.parquet").join(sold, F.col("p_partkey") == F.col("l_partkey")).collect()}
    assert got == want and len(got) > 100
