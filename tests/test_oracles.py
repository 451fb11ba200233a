"""Every query with an oracle agrees with DuckDB on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from locusflow.operators.overlap import points_in
from locusflow.plans.views import Views

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ORACLES = {k: v for k, v in entry.oracle_sql().items() if not k.startswith(("op", "pipeline"))}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    clean = lambda x: round(float(x), 9) if isinstance(x, float) else x
    return sorted([tuple(repr(clean(r[i])) for i in order) for r in rows])


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, duck, name):
    found = entry.queries()[name](spark, SF)
    expected = duck.sql(ORACLES[name])
    assert sorted(found.columns) == sorted(expected.columns)
    assert rows_of(found.columns, found.collect()) == rows_of(expected.columns, expected.fetchall())


def test_entry_runs(spark):
    assert entry.entry(spark).count() >= 0


@pytest.mark.parametrize("name", sorted(k for k in entry.queries() if k not in entry.oracle_sql() and not k.startswith(("op", "pipeline"))))
def test_query_runs(spark, name):
    assert entry.queries()[name](spark, SF).count() >= 0


def test_effects_cover_every_region(spark):
    v = Views(spark, SF)
    hits = points_in(v.variants, v.regions)
    found = entry.queries()["variant_effects_by_region"](spark, SF)
    wanted = sorted((r.vid, f"R{r.r_row_id}") for r in hits.select("vid", "r_row_id").collect())
    assert sorted((r.vid, r.name) for r in found.select("vid", "name").collect()) == wanted
