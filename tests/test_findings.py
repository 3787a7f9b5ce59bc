"""Inputs on which a query once differed from its SQL or took too much."""
import duckdb
import pytest

from sightline.plans.catalog import oracle_sql, queries

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def both(spark, name, path, *tables):
    """Rows of the query and of its SQL over the tables in path, columns in the SQL's order."""
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet/*.parquet'")
    cur = con.execute(oracle_sql()[name])
    names = [d[0] for d in cur.description]
    return [sorted(map(tuple, rows), key=str) for rows in (queries()[name](spark, str(path)).select(*names).collect(), cur.fetchall())]


def test_strays_have_ids_of_their_own_among_many(spark, tmp_path):
    rows = [(k, None, 1, "view", float(k % 100), None) for k in [*range(200), *range(1000000, 1000200)]]
    spark.createDataFrame(rows, EVENTS).write.parquet(f"{tmp_path}/events.parquet")
    got, want = both(spark, "prune_purge", tmp_path, "events")
    assert got == want


def test_large_ratios_are_rounded_alike(spark, tmp_path):
    values = [0.0, -0.0, 1.0, 2.5, 0.5, 1 / 3, 0.7, 1e-300, 1e-303, None, *(1.37 ** -k for k in range(1, 140))]
    spark.createDataFrame([(k, None, 1, "view", v, None) for k, v in enumerate(values)], EVENTS).write.parquet(f"{tmp_path}/events.parquet")
    got, want = both(spark, "ratio_up", tmp_path, "events")
    assert got == want


@pytest.mark.parametrize("x", [0.5, 1.5, -0.5, 2.5, -2.5, 0.49999999999999994, 4503599627370497.0, 1e300, 1e303, 123.4567891])
def test_rounding_to_six_places(spark, x):
    from sightline.plans.dialect import _marks

    x = x if x > 1e200 else x / 1e6
    assert _marks("@ROUND6(x)", True) == "round(x, 6)"
    got = spark.createDataFrame([(x,)], "x double").selectExpr(_marks("@ROUND6(x)", False)).first()[0]
    assert got == duckdb.execute("SELECT round(?::DOUBLE, 6)", [x]).fetchone()[0]


def test_what_was_exchanged_for_a_table_goes_with_the_query(spark):
    from sightline.operators.graphs import cut, drop

    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    exchanged = lambda: {f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(files.getAllFiles()) if f.getName().startswith("shuffle_")}
    before, was = exchanged(), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None)
    sums = cut(spark.range(1000).repartition(3, "id").groupBy("id").count(), "sums")
    assert not exchanged() - before and sums.count() == 1000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) == was
    drop(sums)


def test_patches_with_flat_triangles_and_corners_without_a_place(spark):
    from sightline.operators.linking import sealed_patches

    places = [(k, float(k), 0.0, 0.0, k in (1, 11)) for k in range(14)] + [(20, None, 0.0, 0.0, True), (21, float("nan"), 0.0, 0.0, True), (22, float("nan"), 0.0, 0.0, False), (23, 23.0, 0.0, 0.0, None)]
    vertices = spark.createDataFrame(places, "id long, x double, y double, z double, filled boolean")
    faces = [(1, 1, 2, 3), (2, 1, 2, 3), (3, 11, 12, 12), (4, 5, 6, 7), (5, 20, 5, 6), (6, 99, 5, 6), (7, 21, 22, 8), (8, 23, 8, 9)]
    # an open triangle with its copy, a flat one, one not filled, corners without a place or unknown, two corners at one place, unknown filling
    got = sealed_patches(vertices, spark.createDataFrame(faces, "id long, a long, b long, c long"), 0.25)
    assert sorted(r.id for r in got.collect()) == [4, 5, 6, 8]
