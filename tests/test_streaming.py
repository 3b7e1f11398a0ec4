import json

from tokenwright.streaming.accounts import accounts, lines


def test_accounts_follow_new_files(spark, tmp_path):
    log, out = tmp_path / "log", "accounts_test"
    log.mkdir()
    add = lambda name, rows: (log / name).write_text("\n".join(map(json.dumps, rows)) + "\nNOT JSON\n")
    add("a.jsonl", [{"model": "m", "prompt": "hello world", "completion": "ok"}, {"model": "n", "prompt": "x"}])
    query = accounts(lines(spark, str(log))).writeStream.format("memory").queryName(out).outputMode("complete").option("checkpointLocation", str(tmp_path / "check")).start()
    try:
        query.processAllAvailable()
        add("b.jsonl", [{"model": "m", "prompt": "hello"}])
        query.processAllAvailable()
        got = {r.model: (r.calls, r.input_tokens, r.output_tokens) for r in spark.table(out).collect()}
    finally:
        query.stop()
    # 3 a request, 4 a message, and the words
    assert got == {"m": (2, (3 + 4 + 2) + (3 + 4 + 1), 1), "n": (1, 3 + 4 + 1, 0)}
