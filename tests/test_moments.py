"""Moments with parts of a second, against the SQL of the queries."""

import datetime

import duckdb
import pytest

from tessera import catalog
from tests.conftest import rows_of

catalog.load()


def agree(spark, folder, name, moments):
    """Whether a query and its SQL agree on events of these moments, in seconds from a midnight."""
    start = datetime.datetime(2024, 1, 1)
    rows = [(i, start + datetime.timedelta(seconds=s), i % 3, "click", float(i)) for i, s in enumerate(moments)]
    made = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double")
    made.write.parquet(f"{folder}/events.parquet")
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW events AS SELECT * FROM read_parquet('{folder}/events.parquet/*.parquet')")
    return rows_of(catalog.QUERIES[name](spark, str(folder)).toPandas()) == rows_of(duck.sql(catalog.SQL[name]).df())


HALVES = [[0.0, 0.4, 0.6, 1.0], [10.7, 11.2, 11.3, 11.75, 11.8, 12.9], [0.000001, 0.5, 0.500001, 0.500002, 1.000002]]


@pytest.mark.parametrize("moments", HALVES)
def test_age_flush(spark, tmp_path, moments):
    assert agree(spark, tmp_path, "age_flush", moments)


@pytest.mark.parametrize("moments", HALVES)
def test_version_at_time(spark, tmp_path, moments):
    assert agree(spark, tmp_path, "version_at_time", moments)


@pytest.mark.parametrize("moments", [[43199.4, 43199.6, 43200.2, 86398.5, 86399.5, 86400.5], [43199.499999, 43199.5, 43199.500001, 0.5]])
def test_window_aggregates(spark, tmp_path, moments):
    assert agree(spark, tmp_path, "window_aggregates", moments)
