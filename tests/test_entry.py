import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def same(value):
    if isinstance(value, float):
        return format(round(value, 6) + 0.0, ".6g")
    return str(value)


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if not n.startswith("op")))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    got = entry.queries()[name](spark, SF)
    columns = sorted(got.columns)
    want = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    place = [names.index(c) for c in columns]
    rows = sorted(tuple(same(v) for v in r) for r in got.select(*columns).collect())
    assert rows == sorted(tuple(same(r[i]) for i in place) for r in want.fetchall())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() == 1
