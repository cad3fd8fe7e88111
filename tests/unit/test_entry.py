import duckdb
import pytest

import __spark_entry__ as entry
from retort import queries as own

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(v):
    if isinstance(v, float):
        return "nan" if v != v else round(v, 6)
    return tuple(normal(x) for x in v) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(own.ORACLES))
def test_query_equals_sql(spark, sf, con, name):
    df = own.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted((tuple(normal(r[c]) for c in cols) for r in df.collect()), key=repr)
    c = con.execute(own.ORACLES[name])
    names = [x[0] for x in c.description]
    want = sorted((tuple(normal(r[names.index(n)]) for n in cols) for r in c.fetchall()), key=repr)
    assert got == want


def test_spellings_give_a_row_for_each_row_of_a_repeated_key(spark, sf, tmp_path):
    from retort.queries import QUERIES

    some = spark.read.parquet(f"{sf}/part.parquet").limit(20).localCheckpoint()
    some.unionAll(some).coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    rows = QUERIES["ring_spellings"](spark, str(tmp_path)).collect()
    assert len(rows) == 40 and all(r.bits and r.readable == r.same == (r.p_partkey % 13 != 0 and r.p_partkey % 17 != 0) for r in rows)
