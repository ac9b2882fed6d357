import os

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, _rows

# A spread over the layers; RHOPOOL_ALL_QUERIES=1 runs every query.
SOME = ["spearman_pairs", "study_contrasts", "random_effects", "pair_metrics", "simple_pair_metrics", "fdr_by_group", "median_imputation",
        "rules_weight_normalised", "column_profile", "upsert", "surrogate_keys", "ensemble_consensus", "study_validation"]


def names():
    return list(entry.queries()) if os.environ.get("RHOPOOL_ALL_QUERIES") else SOME


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", names())
def test_query_matches_sql(spark, sf, con, name):
    df = entry.queries()[name](spark, sf)
    got = _rows(df.columns, df.collect())
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert got[1]
        return
    cur = con.execute(sql)
    assert got == _rows([d[0] for d in cur.description], cur.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_oracles_name_known_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
