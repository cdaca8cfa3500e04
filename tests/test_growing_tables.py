"""Steps whose tasks must not grow with the tables, against brute force and by their plans."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyquilt.operators import joint_map, lookup, noise_model
from skyquilt.plans import catalog
from skyquilt.sources import fits as files


def plan(df):
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("kind", ["nearest", "linear", "cubic"])
def test_small_maps_reach_samples_without_exchange(spark, monkeypatch, kind):
    rng = np.random.default_rng(1)
    pixels = [(c, i, None if (c, i) == (1, 5) else float(rng.normal())) for c in range(3) for i in range(9) if (c, i) != (2, 3)]
    grid = spark.createDataFrame(pixels, "chan int, ri int, value double")
    rows = [(k, int(rng.integers(0, 4)), float(rng.integers(-4, 44)) / 4, float(rng.normal())) for k in range(300)] + [(300, 1, None, 1.0)]
    s = spark.createDataFrame(rows, "id int, chan int, x double, value double")
    args = s, grid, ["id", "chan"], {"ri": F.col("x")}, kind, ["chan"]
    near, less = lookup.lookup_map(*args), lookup.subtract_map(*args)
    for df in (near, less):
        assert "SortMergeJoin" not in plan(df) and "hashpartitioning(id" not in plan(df)
    monkeypatch.setattr(lookup, "SMALL_MAP", -1)
    for a, b in ((near, lookup.lookup_map(*args)), (less, lookup.subtract_map(*args))):
        got, want = ({r.id: tuple(r) for r in df.select(a.columns).collect()} for df in (a, b))
        assert got.keys() == want.keys()
        for k, row in want.items():
            assert all(x == y or (x is not None and y is not None and abs(x - y) < 1e-12) for x, y in zip(got[k], row)), (got[k], row)


def test_nearest_on_sky_equals_all_pairs(spark):
    rng = np.random.default_rng(2)
    sky = lambda n: np.stack([rng.uniform(0, 360, n), np.degrees(np.arcsin(rng.uniform(-1, 1, n)))], 1).tolist()
    table = sky(150) + [[0.1, 89.9], [180.0, 89.8], [359.9, 0.0], [40.0, 10.0]] + [[40 + float(x), 10 + float(y)] for x, y in rng.normal(size=(200, 2)) / 50]
    table = [(a, d, float(k)) for k, (a, d) in enumerate(table)] + [(40.0, 10.0, -1.0), (None, 1.0, 9.0)]
    points = sky(300) + [[10.0, 90.0], [0.05, 0.0], [40.0, 10.0], [40.01, 10.02]]
    points = [(k, a, d) for k, (a, d) in enumerate(points)] + [(998, 40.0, 10.0), (999, None, 0.0)]
    got = lookup.nearest_on_sky(files.stager(spark, "sky"), spark.createDataFrame(points, "k int, ra double, dec double"), spark.createDataFrame(table, "ra double, dec double, v double"), "v", 10.0)
    got = {r.k: r.v for r in got.collect()}
    rad = math.radians
    for k, ra, dec in points:
        seen = []
        for a, d, v in table:
            if None not in (ra, a):
                x = math.sin(rad(dec)) * math.sin(rad(d)) + math.cos(rad(dec)) * math.cos(rad(d)) * math.cos(rad(ra - a))
                seen.append((math.degrees(math.acos(max(-1.0, min(1.0, x)))), a, d, v))
        seen = [x for x in seen if x[0] <= 10]
        assert got.pop(k) == (min(seen)[3] if seen else None), k
    assert not got


def test_samples_without_modes_need_no_group(spark):
    s = spark.createDataFrame([(1, 0, 3, 5, 2.0, 0.5), (1, 1, 3, 6, None, 0.5)], "scan int, chan int, t long, p long, value double, var double")
    out = noise_model.weight_stream(s, [], noise_model.NoiseModel(time_modes=0), 2)
    assert "InPandas" not in plan(out)
    assert sorted(map(tuple, out.collect())) == [(1, 0, 3, 5, 4.0, 2.0), (1, 1, 3, 6, 0.0, 0.0)]


def test_a_mode_over_channels_sorts_no_samples(spark):
    s = spark.range(40).select((F.col("id") % 2).alias("scan"), F.floor(F.col("id") / 4).alias("t"), F.when(F.floor(F.col("id") / 2) % 2 == 0, "a").otherwise("b").alias("chan"), F.lit(1.0).alias("var"), F.col("id").cast("double").alias("value"))
    mode = spark.createDataFrame([("a", 1.0), ("b", 0.5)], "chan string, f double")
    out = noise_model.deweight_frequency(s, [], mode, big=1e12)
    assert "SortMergeJoin" not in plan(out)
    left = out.groupBy("scan", "t").agg(F.sum(F.col("f") * F.col("nd")).alias("x")).collect()
    assert len(left) == 20 and all(abs(r.x) < 1e-9 for r in left)


def test_tasks_hand_over_sums_of_scans(spark):
    """Tables of tiles do not grow with the scans, whose sums they hold."""
    s = spark.range(1200).select(F.floor(F.col("id") / 4).alias("scan"), (F.col("id") % 2).cast("int").alias("chan"), F.floor(F.col("id") % 4 / 2).cast("long").alias("t"), F.lit(0).cast("long").alias("p"), F.lit(3.0).alias("value"), F.lit(0.5).alias("var"))
    model = noise_model.NoiseModel(time_modes=1, big=10.0)
    out = joint_map.scan_factors(joint_map.pointed(s, joint_map.unknowns(s)), model, 2, 4).collect()
    assert len(out) <= 4 * 3
    n = noise_model.scan_noise(model, np.arange(2.0), np.full((2, 2), 2.0))
    inverse, at = np.linalg.inv(n), np.kron(np.eye(2), np.ones((1, 2)))
    tile, dirty = (sum(np.array(r.tile) for r in out if r.j == j) for j in (0, -1))
    assert np.allclose(tile.reshape(4, 4)[:2, :2], 300 * at @ inverse @ at.T)
    assert np.allclose(dirty[:2], 300 * at @ inverse @ np.full(4, 3.0))


def test_points_are_grouped_in_bounded_parts(spark, monkeypatch):
    monkeypatch.setattr(catalog, "GROUPED_ROWS", 1000)
    out = catalog.points(spark, "/root/testdata/sf0.001")
    sizes = [r.n for r in out.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == -(-catalog.samples(spark, "/root/testdata/sf0.001").count() // 1000) and max(sizes) < 1500
