import duckdb
import pytest

import __spark_entry__ as entry
from tokenwright.plans import queries as audit

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(rows, columns):
    return sorted(str(tuple(r[c] for c in columns)) for r in rows)


def test_entry(spark):
    assert entry.entry(spark).first()["calls"] > 0


@pytest.mark.parametrize("name", sorted(audit.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = entry.queries()[name](spark, SF)
    cursor = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    want = [dict(zip(names, r)) for r in cursor.fetchall()]
    assert sorted(got.columns) == sorted(names)
    assert plain([r.asDict() for r in got.collect()], names) == plain(want, names)
