"""Queries on tables with odd rows against their SQL."""

import duckdb
import pytest

import __spark_entry__ as entry

LONG = "Never tell a customer the price of a parcel before it is weighed."
GREEK = "ΟΔΟΣ ΜΕΓΑΛΗ και μία πολύ μακριά πρόταση για τον ΛΟΓΟΣ."
TEXTS = [
    "", " ", "\n\n\n\n", " \t \n \n\n\n\n  ", None, f"{LONG}  {LONG.upper()}\n\n\n\n{LONG} x", f"{GREEK} {GREEK.lower()}\n{GREEK}", "  a  b \t\n", "　　\n",
    f"x\r\n{LONG}\r\n{LONG}\r\n", "don't 'll _it_ ½ ١٢ 😀 fooBarBaz camelCaseHere", "İ" * 39 + ". " + "İ" * 39 + ".", f"\n\n{LONG}\n\n{LONG}\n", "feel free to", "a" * 300, f"{LONG} İstanbul. {LONG}",
]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    where = tmp_path_factory.mktemp("odd")
    rows = [(i, "en" if i % 2 else None, t) for i, t in enumerate(TEXTS * 15)]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(f"{where}/documents.parquet")
    return str(where)


@pytest.mark.parametrize("name", ["safe_fix_measured", "whitespace_bloat", "filler_phrases", "filler_counts", "duplicate_blocks", "restated_sentences", "fewshot_weight", "dedupe_sentences"])
def test_odd_documents_match_sql(spark, odd, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{odd}/documents.parquet/*.parquet'")
    cursor = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    got = entry.queries()[name](spark, odd).select(names)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, cursor.fetchall()))


def test_blocks_of_a_document_without_an_id(spark, tmp_path):
    block = "A paragraph that two documents hold word for word, and that is long enough to be looked at by the check of paragraphs. " * 3
    spark.createDataFrame([(None, "a", block), (7, "a", block), (8, "a", block)], "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    (row,) = entry.queries()["duplicate_blocks"](spark, str(tmp_path)).collect()
    assert row.calls_affected == 3 and row.tokens_saved > 100
