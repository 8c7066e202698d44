"""Every registered query against its SQL in DuckDB, and the driver contract."""

import oracle
import pytest

import __spark_entry__ as entry
from sigspark.plans import registry
from sigspark.session import stage, stage_dir

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return oracle.connect(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, sf, name):
    error, _ = oracle.compare(spark, con, name, QUERIES[name], SQL[name], sf)
    assert error is None, error


def test_every_query_of_the_library_has_sql():
    # the corpus queries without SQL have brute-force tests beside them
    assert not set(registry.QUERIES) - set(registry.SQL)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["window_no", "start_ts", "end_ts", "n_entities", "n_rows"] and df.count() > 0


def test_stage_folder_is_the_configured_one(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    folder = stage_dir(spark)
    assert folder == (configured or spark.sparkContext.getCheckpointDir()).rstrip("/")
    staged = stage(spark.range(5), "numbers")
    assert staged.count() == 5 and all(folder.split(":")[-1] in f for f in staged.inputFiles())
