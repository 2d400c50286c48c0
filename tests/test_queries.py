"""Every registered query that has SQL against that SQL, over the smallest tables."""

import duckdb
import pytest

from tessera.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "customer part supplier events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(frame, columns):
    values = frame[columns].astype(object).where(frame[columns].notna(), None)
    return sorted((tuple(None if v is None else str(v) for v in r) for r in values.values.tolist()), key=str)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_as_sql(spark, db, name):
    ours, theirs = registry.QUERIES[name](spark, SF).toPandas(), db.execute(registry.ORACLE_SQL[name]).df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    assert rows(ours, columns) == rows(theirs, columns)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_clean_mode_keeps_one_chunk_of_a_source(spark):
    for r in registry.QUERIES["hybrid_clean"](spark, SF).collect():
        heads = r.headers.split("|")
        assert len(heads) == len(set(heads)) <= 3
