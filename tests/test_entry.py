import duckdb
import pytest

import __spark_entry__ as driver

SF = "/root/testdata/sf0.001"


def test_every_query_of_the_engine_has_an_oracle():
    from pathloom import queries

    assert set(queries.ORACLES) == set(queries.QUERIES) <= set(driver.queries()) and set(driver.oracle_sql()) <= set(driver.queries())


def test_entry(spark):
    assert driver.entry(spark).columns == ["src", "dst"]


@pytest.mark.parametrize("name", ["cfpq_events_anbn", "rpq_events_to_purchase", "shortest_same_generation", "multi_source_events_anbn", "count_paths_supplier_hops", "etl_dense_ids"])
def test_oracles(spark, name):
    db = duckdb.connect()
    for t in ("events", "supplier", "nation", "region", "conversations"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    found, expected = driver.queries()[name](spark, SF), db.sql(driver.oracle_sql()[name])
    columns = sorted(found.columns)
    assert columns == sorted(expected.columns)
    assert sorted(tuple(r[c] for c in columns) for r in found.collect()) == sorted(db.sql(f"SELECT {', '.join(columns)} FROM expected").fetchall())
