"""Texts are read once by a check, in tasks that stay small."""

from unittest import mock

import pyarrow as pa
import pytest

from tokenwright.functions import counting
from tokenwright.operators import checks as C
from tokenwright.plans import queries as audit

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def counts_once(spark, name, times=1):
    """The plan below the query's sums reads each text `times` in all."""
    text = plan(audit.QUERIES[name](spark, SF))
    return text.count("full_text#") > 0 and sum(line.count("MapInArrow") for line in text.splitlines() if "full_text" in line and "run(" in line) == times


def test_pretty_json_reads_texts_once(spark):
    assert counts_once(spark, "pretty_json")
    assert "ArrowEvalPython" not in audit.QUERIES["pretty_json"](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_whitespace_bloat_reads_texts_once(spark):
    assert counts_once(spark, "whitespace_bloat")


def test_events_are_spread_in_waves(spark):
    assert audit._pretty(spark, SF).rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_filler_phrases_reads_texts_once(spark):
    assert counts_once(spark, "filler_phrases")


@pytest.mark.parametrize("text", ["please note that", "PLEASE NOTE THAT. As an AI, as a language model", "éplease note that", "́in order to", "²in order to x", "ın order to", "think about it carefully beforeanswering", "i 'll tip you 5.2\nx", "It is important to note that it 's important that"])
def test_filler_matches_by_their_beginnings(text):
    whole = [(k, i, m.group()) for k, rx in enumerate(C._filler_patterns()) for i, m in enumerate(rx.finditer(text))]
    assert C._hits_of(text) == whole


def test_duplicate_blocks_looks_again_only_at_first_holders(spark):
    text = plan(audit.QUERIES["duplicate_blocks"](spark, SF))
    assert "LeftSemi" in text and not any(w in text for w in ("split(", "md5("))


def test_tool_schemas_are_written_out_behind_the_shuffle(spark):
    text = plan(audit._part_tool_requests(spark, SF))
    grouped = text.index("collect_list(")
    assert '"description"' not in text[grouped:] and '"description"' in text[:grouped]
    assert "RepartitionByExpression" in text[grouped:]


def test_texts_of_a_batch_are_counted_once():
    lists = pa.array([["one two", None, ""], None, [], ["one two", "one two three"]])
    with mock.patch.object(counting, "counts", wraps=counting.counts) as counts:
        assert counting.counts_of_lists(lists).to_pylist() == [[2, 0, 0], None, [], [2, 3]]
    assert len(counts.call_args[0][0]) == 3


@pytest.mark.parametrize("name", ["restated_sentences", "fewshot_weight"])
def test_checks_of_the_report_read_texts_once(spark, name):
    assert counts_once(spark, name)
