"""Registered queries against their SQL in DuckDB, on the smallest tables; TERRASHIFT_ALL=1 runs every one."""

import os

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
SOME = [
    "sample_view_scan", "dataset_report", "distance_to_development", "local_density", "rank_metrics", "block_distance_profiles",
    "tiles_near_polygons", "multi_year_assembly", "weighted_pool_draw", "reliability_table", "tile_completeness", "exact_pixel_sample",
]
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="test tables are not here")


def names():
    return sorted(entry.oracle_sql()) if os.environ.get("TERRASHIFT_ALL") else SOME


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DIR}/{f}'")
    return con


@pytest.mark.parametrize("name", names())
def test_same_rows_as_sql(spark, duck, name):
    got = entry.queries()[name](spark, DIR).toPandas()
    want = duck.execute(entry.oracle_sql()[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    cols = sorted(got.columns)
    key = [c for c in cols if got[c].dtype.kind != "f"] or cols
    rest = [c for c in cols if c not in key]
    a, b = (d.sort_values(key + rest).reset_index(drop=True) for d in (got, want))
    for c in cols:
        if a[c].dtype.kind == "f":
            assert np.allclose(a[c].astype(float), b[c].astype(float), equal_nan=True, atol=1e-9)
        else:
            assert (a[c].astype(str) == b[c].astype(str)).all(), c


def test_every_inventory_row_is_covered():
    from terrashift.plans.registry import QUERIES

    have = {c for q in QUERIES.values() for c in q.covers}
    sizes = {"S": 19, "P": 18, "J": 19, "A": 32, "W": 9, "T": 6, "U": 4, "X": 18, "G": 19, "D": 14, "M": 19, "C": 9}
    assert {f"{k}{i}" for k, n in sizes.items() for i in range(1, n + 1)} == have


def test_flagship_entry(spark):
    assert entry.entry(spark).count() == 5
