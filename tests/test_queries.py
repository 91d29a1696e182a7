import duckdb
import pytest

import __spark_entry__ as driver
from tenorlake.plans import catalog


@pytest.mark.parametrize("name", ["decile_table_trailing_vol", "j7_events_spanned", "m14_factor_covariance", "b16_rank_book", "t2_straddle_pick"])
def test_query_matches_its_sql(spark, sf_dir, name):
    got = catalog.QUERIES[name](spark, sf_dir)
    con = duckdb.connect()
    for table in ("lineitem", "orders", "events", "supplier", "nation", "region"):
        con.execute(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    want = con.execute(catalog.ORACLES[name]).to_arrow_table().select(got.columns).to_pylist()
    rows = [r.asDict() for r in got.collect()]
    order = lambda x: [str(v) for v in x.values()]
    assert sorted(rows, key=order) == sorted(want, key=order)


def test_entry_and_registry(spark):
    assert driver.entry(spark).columns[0] == "strategy"
    assert set(driver.oracle_sql()) <= set(driver.queries())
