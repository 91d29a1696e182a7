from datetime import date

from tenorlake.sources.store import require
from tenorlake.streaming.refresh import refresh


def test_refresh_reads_new_files_once_and_replaces_their_years(spark, tmp_path):
    landing, table, checkpoint = (str(tmp_path / x) for x in ("landing", "table", "checkpoint"))
    schema = "date date, symbol string, close double"

    def land(*rows):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(landing)

    def run():
        return refresh(spark, landing, spark.createDataFrame([], schema).schema, table, checkpoint, ["date", "symbol"])

    def stored():
        return sorted((r.date, r.symbol, r.close) for r in require(spark, table, "refresh").collect())

    land((date(2023, 5, 1), "a", 1.0), (date(2024, 5, 1), "a", 2.0))
    assert run() >= 1 and len(stored()) == 2
    assert run() == 0
    land((date(2024, 5, 1), "a", 3.0), (date(2024, 5, 2), "a", 4.0))
    run()
    assert stored() == [(date(2023, 5, 1), "a", 1.0), (date(2024, 5, 1), "a", 3.0), (date(2024, 5, 2), "a", 4.0)]
