import base64
import json
import os

import pytest
from pyspark.sql import functions as F

from tokenwright.functions import tokens as T
from tokenwright.plans import report
from tokenwright.plans.cli import main


@pytest.fixture(scope="module")
def log(tmp_path_factory):
    where = tmp_path_factory.mktemp("log")
    system = "Weigh every parcel before you quote a price. " * 200
    rows = [{"model": "m", "messages": [{"role": "system", "content": system}, {"role": "user", "content": f"q{i}"}], "completion": "ok"} for i in range(5)]
    (where / "log.jsonl").write_text("\n".join(map(json.dumps, rows)))
    return where


def test_json_and_projection(spark, log, tmp_path, capsys):
    out = tmp_path / "r.json"
    assert main([str(log), "-f", "json", "-o", str(out), "--calls", "1000", "--price-in", "0.6"], spark) == 0
    r = json.loads(out.read_text())
    assert r["corpus"]["records"] == 5 and not r["pricing"]["is_placeholder_rate"]
    kinds = {f["check"]: f for f in r["findings"]}
    assert {"cacheable-prefix", "repeated-system-prompt", "restated-instructions", "io-imbalance"} <= set(kinds)
    safe = r["recoverable_tokens_confident"]
    assert safe == r["recoverable_tokens"]["measured_safe_rewrite"] + r["recoverable_tokens"]["high_prompt_caching"]
    assert r["projection"] == {"calls_per_month": 1000, "scale_factor": 200.0, "monthly_saving_usd": round(safe * 200 / 1e6 * 0.6, 2), "annual_saving_usd": round(safe * 2400 / 1e6 * 0.6, 2)}


def test_gates_and_confidence(spark, log, capsys):
    assert main([str(log), "--fail-over-pct", "10"], spark) == 1
    assert main([str(log), "--fail-over-tokens", "10", "-f", "markdown"], spark) == 1
    text = capsys.readouterr().out
    assert "## Findings" in text and "<details>" in text
    assert main([str(log), "--fail-over-tokens", "99999999", "--min-confidence", "certain"], spark) == 0
    assert "repeated-system-prompt" not in capsys.readouterr().out


def test_usage(spark, log, tmp_path, capsys):
    assert main([str(log), "--weight", "0"], spark) == 2 and main([str(log), "--calls", "0"], spark) == 2
    assert main([str(tmp_path)], spark) == 2
    assert main([str(log), "-o", str(tmp_path / "no" / "r"), "-f", "json"], spark) == 2


def test_fix_leaves_originals(spark, log, tmp_path, capsys):
    before = (log / "log.jsonl").read_text()
    assert main([str(log), "--fix", str(tmp_path / "out"), "--weight", "3"], spark) == 0
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["log.2.txt", "log.3.txt", "log.4.txt", "log.5.txt", "log.txt"]
    assert (log / "log.jsonl").read_text() == before
    assert "calls     15" in capsys.readouterr().out


def test_colour(monkeypatch):
    class Tty:
        def isatty(self):
            return True

    monkeypatch.delenv("NO_COLOR", raising=False)
    monkeypatch.delenv("FORCE_COLOR", raising=False)
    assert report.coloured(Tty()) and not report.coloured(object())
    monkeypatch.setenv("FORCE_COLOR", "1")
    assert report.coloured(object())
    monkeypatch.setenv("NO_COLOR", "1")
    assert not report.coloured(Tty())


RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@pytest.mark.skipif(not os.path.exists(RANKS), reason="no vocabulary at hand")
def test_exact_counts(spark, log, tmp_path, capsys):
    import tiktoken

    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
    enc = tiktoken.Encoding("own", pat_str=T._encoding(RANKS)._pat_str, mergeable_ranks=ranks, special_tokens={})
    got = {}
    for more in ([], ["--vocabulary", RANKS], ["--vocabulary", RANKS, "--approx"]):
        out = tmp_path / "r.json"
        assert main([str(log), "-f", "json", "-o", str(out), *more], spark) == 0
        got[len(more)] = json.loads(out.read_text())
    system = "Weigh every parcel before you quote a price. " * 200
    n = lambda t: len(enc.encode_ordinary(t))
    assert got[2]["corpus"]["input_tokens"] == sum(3 + 4 + n(system) + 4 + n(f"q{i}") for i in range(5)) and got[2]["corpus"]["output_tokens"] == 5 * n("ok")
    assert got[2]["counting"] == {"backend": "byte-pair/byte_bpe_50k", "exact": True}
    assert got[3] == got[0] and not got[0]["counting"]["exact"]
    kinds = {f["check"]: f for f in got[2]["findings"]}
    assert kinds["restated-instructions"]["tokens_saved"] == 5 * 199 * n("weigh every parcel before you quote a price.")
    assert main([str(log), "--vocabulary", str(tmp_path / "none")], spark) == 2


def test_texts_that_can_t_be_encoded_are_approximated(spark, monkeypatch):
    rows = spark.createDataFrame([("some words here",), ("",), (None,)], "t string")
    with T.counted_by(RANKS):
        count = T.token_count("t")
        many = T.token_counts(F.array("t", "t"))
    assert T._exact(None, "x") is None and T._exact(None, "") == 0
    if os.path.exists(RANKS):
        assert [r.n for r in rows.select(count.alias("n")).collect()] == [3, 0, 0]
        assert [r.n for r in rows.select(many.alias("n")).collect()] == [[3, 3], [0, 0], [0, 0]]


def test_reports_say_that_findings_are_not_summed(spark, log, capsys):
    for more in ([], ["-f", "markdown"]):
        main([str(log), *more], spark)
        assert "is not a sum of findings" in " ".join(capsys.readouterr().out.split())


def test_files_left_out_are_named(spark, tmp_path, capsys, monkeypatch):
    from tokenwright.plans import cli

    (tmp_path / "a.txt").write_text("prompt")
    (tmp_path / "large.txt").write_text("x" * (cli.files.MOST_BYTES + 1))
    assert main([str(tmp_path)], spark) == 0
    assert "1 file(s) of more than 8,388,608 bytes left out" in capsys.readouterr().err


@pytest.mark.parametrize("raw, tokens", [
    ('[{"role":"user","content":"hi"}]', 3 + 4 + 1), ('[{"content":"hi","name":"bob"}]', 3 + 4 + 1 + 1), ('[{"content":[{"type":"text","text":"hi"},{"type":"image"},{"text":"ok"},"loose"]}]', 3 + 4 + 2),
    ('["bare",5,null,{"content":null},{"content":["x"],"name":7}]', 3 + 8), ("[]", 3), ("not json", 3), (None, 3), ('[{"content":"[1]"}]', 3 + 4 + 3),
])
def test_framing_of_raw_messages(spark, raw, tokens):
    assert spark.createDataFrame([(raw,)], "j string").select(T.framed_json(F.col("j")).alias("n")).first().n == tokens
