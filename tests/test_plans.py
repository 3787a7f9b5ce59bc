import math

import duckdb
import pytest

from sightline.plans.catalog import oracle_sql, queries
from sightline.plans.dialect import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    return None if v is None or isinstance(v, float) and math.isnan(v) else f"{v:.6g}" if isinstance(v, float) else str(float(v)) if type(v).__name__ == "Decimal" else str(v)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_plan_equals_oracle(spark, duck, name):
    df = queries()[name](spark, SF)
    cur = duck.execute(oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(str([plain(r[names.index(c)]) for c in sorted(names)]) for r in cur.fetchall())
    got = sorted(str([plain(r[c]) for c in sorted(names)]) for r in df.collect())
    assert got == want


def test_gap_equality_extends_and_more_breaks(spark, tmp_path):
    from datetime import datetime, timedelta

    base, gap = datetime(2024, 1, 1), timedelta(hours=6)
    rows = [(1, base, 7, "view", 1.0, None), (2, base + gap, 7, "view", 2.0, None), (3, base + gap + gap + timedelta(microseconds=1), 7, "view", 2.0, None), (4, base, 8, "view", None, None)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    got = {(r.user_id, r.session): r.frame_count for r in queries()["sighting_sessions"](spark, str(tmp_path)).collect()}
    assert got == {(7, 1): 2, (7, 2): 1, (8, 1): 1}


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_without_oracle_runs(spark, name):
    assert queries()[name](spark, SF).count() > 0
