"""Every registered query runs on sf0.001 and matches its SQL twin (DuckDB)."""

import duckdb
import pytest

import __spark_entry__ as E
from lendlens.plans import catalog
from lendlens.sources.tables import TABLES
from tests.conftest import SF
from tests.oracle_check import compare

# queries that another registered query checks (gbt_invariants, explanation_summary)
CHECKED_ELSEWHERE = {"gbt_test_scores", "gbt_feature_importances", "explanation_records"}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "risk_flag_count" in df.columns


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query_matches_oracle(spark, con, name):
    if name in CHECKED_ELSEWHERE:
        assert catalog.QUERIES[name](spark, SF).head(1)
        return
    msg = compare(spark, con, SF, name, catalog.QUERIES[name], catalog.SQL.get(name))
    assert f"{name}: OK" in msg, msg


def test_entry_holds_the_catalog():
    assert catalog.QUERIES.items() <= E.queries().items() and catalog.SQL.items() <= E.oracle_sql().items()
