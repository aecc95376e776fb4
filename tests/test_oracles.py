"""Every registered query against its SQL, on the smallest tables."""

import duckdb
import pytest

from tradewind.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def canon(row):
    out = []
    for x in row:
        if isinstance(x, float):
            x = f"{x:.12g}"
        elif type(x).__name__ == "Decimal":
            x = f"{float(x):.12g}"
        out.append(repr(x))
    return tuple(out)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    sql = registry.oracle_sql()[name]
    assert sorted(con.sql(sql).columns) == columns
    got = sorted(canon(r) for r in df.select(*columns).collect())
    want = sorted(canon(r) for r in con.sql("SELECT {} FROM ({}) z".format(", ".join(f'"{c}"' for c in columns), sql)).fetchall())
    assert got == want


def test_every_query_is_there():
    assert set(registry.oracle_sql()) <= set(registry.queries())
    assert set(registry.queries()) - set(registry.oracle_sql()) == {"str12_chunks"}


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
