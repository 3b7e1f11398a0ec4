import io
import json

import pytest

from tokenwright.sources import files, records, tables


def loaded(spark, paths, **more):
    return sorted((r.asDict(recursive=True) for r in files.load_inputs(spark, paths, **more).collect()), key=lambda r: r["ingest_seq"])


def request(x):
    return records.request_of(x)


def texts(x):
    return [(m["role"], m["content"]) for m in request(x)["messages"]]


def test_shapes_of_records():
    chat = {"messages": [{"role": "User", "content": "hi"}, "bare", {"from": "ai", "value": [{"type": "text", "text": "a"}, "b"]}, {"role": "x", "content": None, "text": "unseen"}]}
    assert texts(chat) == [("user", "hi"), ("user", "bare"), ("ai", "a\nb")]
    assert texts({"system": [{"text": "s"}], "messages": [{"content": "q"}]}) == [("system", "s"), ("user", "q")]
    assert texts({"prompt": "p"}) == [("user", "p")] and texts({"input": "i"}) == [("user", "i")]
    assert request({"nothing": 1}) is None and request("text") is None and request({"messages": []}) is None


def test_wrappers_carry_only_what_is_missing():
    x = {"model": "outer", "response": "r", "system": "not carried", "body": {"prompt": "p", "model": "inner"}}
    r = request(x)
    assert (r["model"], r["completion"], texts(x)) == ("inner", "r", [("user", "p")])


def test_completions():
    m = {"messages": [{"content": "q"}]}
    assert request({**m, "completion": "", "output": {"text": "o"}})["completion"] == "o"
    assert request({**m, "choices": [{"message": {"content": [{"text": "c"}]}}]})["completion"] == "c"
    assert request({**m, "choices": [{"text": "t"}]})["completion"] == "t"
    assert request(m)["completion"] is None


def test_tools_and_calls():
    f = {"name": "look", "description": "é", "parameters": {"b": 1, "a": 2}}
    x = {
        "messages": [{"content": "q", "tool_calls": [{"function": {"name": "old"}}]}], "tools": [{"type": "function", "function": f}, {"type": "x"}], "functions": [{"name": "flat"}],
        "choices": [{"message": {"content": None, "tool_calls": [{"function": {"name": "look"}}, {"function": {"name": "look"}}], "function_call": {"name": "flat"}}}], "content": [{"type": "tool_use", "name": "used"}],
    }
    r = request(x)
    assert [(t["name"], t["schema_json"]) for t in r["tools"]] == [("look", '{"name":"look","description":"é","parameters":{"b":1,"a":2}}'), ("flat", '{"name":"flat"}')]
    assert r["tools_called"] == ["look", "look", "flat", "used", "old"]


def test_malformed_values():
    assert records.parsed("{'a':1}") is None and records.parsed("[" * 100000) is None and records.parsed("9" * 5000) is None
    assert records.parsed('{"a":1,"a":2}') == {"a": 2}


def test_files(spark, tmp_path):
    (tmp_path / "_dir").mkdir()
    (tmp_path / ".git").mkdir()
    (tmp_path / "node_modules").mkdir()
    for skipped in (".git/a.txt", "node_modules/a.txt", "b.bin"):
        (tmp_path / skipped).write_text("no")
    (tmp_path / "_dir" / "_x.txt").write_bytes(b"one\r\ntwo \xff")
    (tmp_path / ".x.md").write_text("dot file")
    (tmp_path / "blank.txt").write_text(" \n ")
    (tmp_path / "log.jsonl").write_text('// note\n\n{"prompt": "a"}\nNOT JSON\n{"prompt": "b"}\n')
    (tmp_path / "list.json").write_text(json.dumps([{"prompt": "c"}, {"no": 1}, {"prompt": "d"}]))
    (tmp_path / "big.txt").write_text("x" * (files.MOST_BYTES + 1))
    (tmp_path / "most.txt").write_text("y" * files.MOST_BYTES)
    got = {r["source"].removeprefix(str(tmp_path)): r["messages"][0]["content"] for r in loaded(spark, [str(tmp_path)])}
    assert got.pop("/most.txt")[:2] == "yy"
    assert got == {"/_dir/_x.txt": "one\ntwo �", "/.x.md": "dot file", "/log.jsonl:3": "a", "/log.jsonl:5": "b", "/list.json[0]": "c", "/list.json[2]": "d"}
    assert loaded(spark, [str(tmp_path / "b.bin")])[0]["messages"][0]["role"] == "system"
    assert loaded(spark, [str(tmp_path / "missing")]) == []


def test_standard_input(spark):
    for text, sources in (('{"prompt": "a"}\n{"prompt": "b"}', ["<stdin>:1", "<stdin>:2"]), ('[\n{"prompt": "a"}\n]', ["<stdin>:2"]), ("plain", ["<stdin>"]), (" ", [])):
        assert [r["source"] for r in loaded(spark, [], stdin=io.StringIO(text))] == sources


def test_table_adapters(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "q"), (1, 2, "assistant", "a"), (1, 3, "user", ""), (1, 4, "assistant", None), (2, 0, "assistant", "alone")]
    c = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted(tables.from_conversations(c).collect(), key=lambda r: r.request_id)
    assert [(r.request_id, [m.content for m in r.messages], r.completion) for r in got] == [(100002, ["s", "q"], "a"), (100004, ["s", "q", "a"], None)]
    d = spark.createDataFrame([(1, "t", "src"), (2, " \n", "src"), (3, None, "src")], "doc_id long, text string, source string")
    assert [r.request_id for r in tables.from_documents(d).collect()] == [1]


def test_sizes_are_a_parameter_and_reported(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x" * 20)
    (tmp_path / "b.txt").write_text("y" * 10)
    assert [r["messages"][0]["content"] for r in loaded(spark, [str(tmp_path)], most_bytes=10)] == ["y" * 10]
    assert files.too_large([str(tmp_path), "-"], 10) == [f"{tmp_path}/a.txt"] and files.too_large([str(tmp_path)]) == []


def test_a_file_that_vanished_is_an_error(tmp_path):
    with pytest.raises(FileNotFoundError):
        files.read_text(str(tmp_path / "none.txt"))


def test_uris_are_read_by_spark(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "sub" / "log.jsonl").write_bytes(b'{"prompt": "a"}\r\n{"prompt": "b"}')
    (tmp_path / "t.md").write_bytes(b"one\rtwo \xff")
    (tmp_path / "node_modules" / "t.md").write_text("pruned")
    (tmp_path / "x.bin").write_text("unknown")
    (tmp_path / "big.txt").write_text("z" * 100)
    got = loaded(spark, [f"file://{tmp_path}", "-"], stdin=io.StringIO("last"), most_bytes=99)
    assert sorted(r["messages"][0]["content"] for r in got) == ["a", "b", "last", "one\ntwo �"] and got[-1]["source"] == "<stdin>"
    assert loaded(spark, [f"file://{tmp_path}/x.bin"])[0]["messages"][0]["role"] == "system"
