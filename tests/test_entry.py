import duckdb
import pytest

import __spark_entry__ as E
from riskmap.plans import registry
from scripts.check_oracle import frame_rows


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 9
    assert set(df.columns) == {"model", "k_frac", "threshold", "flagged_n", "flagged_share",
                               "precision", "recall"}


def test_oracles_belong_to_queries():
    q = E.queries()
    sql = E.oracle_sql()
    assert set(sql) <= set(q)
    assert len(q) >= 75


TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()
LIBRARY_SQL = sorted(n for n, (_, sql) in registry._all().items() if sql is not None)


@pytest.fixture(scope="module")
def twin(sf_small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_small}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", LIBRARY_SQL)
def test_query_equals_its_twin(spark, sf_small, twin, name):
    """Every row of every SQL-checked query, values rounded to nine digits."""
    columns, got = frame_rows(E.queries()[name](spark, sf_small).toPandas())
    expected_columns, want = frame_rows(twin.execute(E.oracle_sql()[name]).fetchdf())
    assert columns == expected_columns
    assert got == want
