"""Operators on tiny tables against independent computation, with nulls, edges and ties."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyquilt.functions import columns as C
from skyquilt.functions.cosmology import Cosmology, inverse_table
from skyquilt.operators import fits, generators, lineage, lookup, maps, modes, spectra
from skyquilt.operators import timestream as ts


def one(df):
    return df.first()[0]


def test_rounding_and_bins(spark):
    df = spark.sql("select * from values (2.5d), (-0.5d), (4.0d), (5.0d) as t(x)")
    assert [r[0] for r in df.select(C.pixel(F.col("x"), 0, 0.0, 1.0)).collect()] == [2, 0, 4, 5]
    assert [r[0] for r in df.select(C.pixel(F.col("x"), 0, 0.0, 1.0, half_even=False)).collect()] == [3, -1, 4, 5]
    assert [r[0] for r in df.select(C.bucket(F.col("x"), 0, 1, 5)).collect()] == [2, None, 4, None]
    assert [r[0] for r in df.select(C.bucket(F.col("x"), 0, 1, 5, closed=True)).collect()] == [2, None, 4, 4]


def test_times_and_sky(spark):
    df = spark.sql("select timestamp'2000-01-01 12:00:00.129' as ts")
    assert one(df.select(C.seconds_2000(F.col("ts")))) == pytest.approx(43200.129)
    assert one(df.select(C.time_text(C.seconds_2000(F.col("ts"))))) == "2000-01-01T12:00:00.12"
    assert one(df.select(C.text_seconds(F.lit("2000-01-01T12:00:00.12")))) == pytest.approx(43200.12)
    ra, dec = C.horizon_to_sky(F.lit(40.0), F.lit(120.0), F.lit(30.0))
    az, el = C.sky_to_horizon(ra, dec, F.lit(30.0))
    r = df.select(az, el).first()
    assert (r[0], r[1]) == (pytest.approx(120.0), pytest.approx(40.0))
    assert one(df.select(C.from_sexagesimal(C.sexagesimal(F.lit(-12.5))))) == pytest.approx(-12.5)
    with pytest.raises(Exception, match="unknown polarisation"):
        df.select(C.polarisation_name(F.lit(99))).collect()


def test_cosmology_agrees_with_sums(spark):
    c, z = Cosmology(), 1.5
    x = np.linspace(0, z, 200_001)
    e = np.sqrt(0.274 * (1 + x) ** 3 + 0.726)
    want = 299792.458 / 70.2 * np.trapezoid(1 / e, x)
    got = spark.range(1).select(c.comoving_distance(F.lit(z)), c.age(F.lit(z)), c.age_flat(F.lit(z)), c.growth_factor(F.lit(0.0)), c.growth_factor(F.lit(99.0)), c.growth_rate(F.lit(99.0))).first()
    assert got[0] == pytest.approx(want, rel=1e-8)
    assert got[1] == pytest.approx(got[2], rel=1e-9)
    # Growth from its integral; it follows the scale factor in the early universe.
    a = np.linspace(1e-6, 1, 200_001)
    growth = 2.5 * 0.274 * np.trapezoid((a / (0.274 + 0.726 * a**3)) ** 1.5, a)
    assert got[3] == pytest.approx(growth, rel=1e-3)
    assert got[4] * 100 == pytest.approx(1.0, abs=1e-4) and got[5] == pytest.approx(1.0, abs=1e-4)
    xs, ys = inverse_table(lambda v: v * v, 0, 2, 5)
    assert ys[-1] == 4.0 and len(xs) == 5


def test_hanning_and_rebin_with_nulls(spark):
    rows = spark.createDataFrame([("a", i, v) for i, v in enumerate([1.0, 2.0, None, 4.0, 8.0])], "k string, chan int, value double")
    got = {r.chan: r.value for r in ts.hanning(rows, ["k"]).collect()}
    assert all(got[i] is None for i in range(5))
    got = {r.chan: r.value for r in ts.rebin_frequency(rows, ["k"], 2).collect()}
    assert got == {0: 1.5, 1: 4.0, 2: 8.0}
    arr = spark.sql("select array(1d, 2d, null, 4d, 8d) as s")
    assert one(arr.select(ts.rebin_array(F.col("s"), 2))) == [1.5, 4.0]
    assert one(arr.select(ts.hanning_array(F.array(*[F.lit(float(v)) for v in (0, 4, 0)])))) == [None, 2.0, None]


def test_time_rebin_drops_the_tail(spark):
    rows = spark.createDataFrame([("a", t, 0, float(t)) for t in range(7)], "k string, t long, chan int, value double")
    assert {r.t: r.value for r in ts.rebin_time(rows, ["k"], 3).collect()} == {0: 1.0, 1: 4.0}


def test_planted_spike_is_flagged(spark):
    rng = np.random.default_rng(0)
    data = [(0, t, c, float(10 + rng.normal() * (30 if c == 5 else 1))) for t in range(50) for c in range(64)]
    rows = spark.createDataFrame(data, "scan int, t long, chan int, value double")
    assert [r.chan for r in ts.noisy_channels(rows, [], ["scan"], 6.0).collect()] == [5]
    out = ts.flag_channels_until_stable(rows, [], ["scan"], 6.0)
    assert out.where("chan = 5 and value is not null").count() == 0 and out.where("chan = 6 and value is null").count() == 0
    spike = rows.withColumn("value", F.when(F.col("t") == 2, 500.0).otherwise(F.col("value")))
    bad = {r.t for r in ts.flag_times(spike, ["scan"], 3.0, 3).where("value is null").select("t").distinct().collect()}
    assert bad == {0, 1, 2, 3, 4}


def test_order_check_raises(spark):
    rows = spark.createDataFrame([(1, 0.5), (1, 0.51)], "scan int, lst double")
    with pytest.raises(Exception, match="not constant"):
        ts.check_order(rows, ["scan"], ["lst"]).collect()


def test_asof_and_brackets(spark):
    left = spark.createDataFrame([("a", 1.0), ("a", 2.5), ("a", 9.0), ("b", 1.0)], "k string, x double")
    right = spark.createDataFrame([("a", 2.0, 10.0), ("a", 3.0, 20.0)], "k string, x double, y double")
    got = {(r.k, r.x): r.y for r in lookup.asof_join(left, right, ["k"], "x", "y").collect()}
    assert got == {("a", 1.0): None, ("a", 2.5): 10.0, ("a", 9.0): 20.0, ("b", 1.0): None}
    got = {(r.k, r.x): r.y for r in lookup.bracket_interpolate(left, right, ["k"], "x", "y").collect()}
    assert got == {("a", 1.0): None, ("a", 2.5): 15.0, ("a", 9.0): None, ("b", 1.0): None}


def test_map_lookup_kinds(spark):
    grid = spark.createDataFrame([(i, j, float(i * i + j)) for i in range(8) for j in range(8)], "ri int, di int, value double")
    s = spark.createDataFrame([(1, 2.5, 3.0), (2, 0.0, 7.9), (3, 4.25, 4.5)], "id int, x double, y double")
    at = {"ri": F.col("x"), "di": F.col("y")}
    near = {r.id: r.map_value for r in lookup.lookup_map(s, grid, ["id"], at, "nearest").collect()}
    assert near[1] == 7.0 and near[2] is None
    lin = {r.id: r.map_value for r in lookup.lookup_map(s, grid, ["id"], at, "linear").collect()}
    assert lin[1] == pytest.approx(9.5) and lin[2] is None
    cub = {r.id: r.map_value for r in lookup.lookup_map(s, grid, ["id"], at, "cubic").collect()}
    assert cub[3] == pytest.approx(4.25**2 + 4.5)


def test_solve_identity(spark):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(6, 6))
    m = m @ m.T + np.eye(6)
    x = rng.normal(size=6)
    d = m @ x
    rows = spark.createDataFrame([(0, p, float(d[p])) for p in range(6)], "chan int, p long, dirty double")
    blocks = spark.createDataFrame([(0, p, q, float(m[p, q])) for p in range(6) for q in range(6)], "chan int, p long, q long, value double")
    got = {r.p: r.value for r in maps.solve_channels(rows, blocks, ["chan"]).collect()}
    assert [got[p] for p in range(6)] == pytest.approx(x.tolist(), abs=1e-8)


def test_modes_are_removed(spark):
    rng = np.random.default_rng(2)
    mode = np.ones(16) / 4
    data = rng.normal(size=(100, 1)) * mode * 20 + rng.normal(size=(100, 16)) * 0.01
    rows = spark.createDataFrame([(t, c, float(data[t, c]), 1.0) for t in range(100) for c in range(16)], "t long, chan int, value double, weight double")
    cov = modes.freq_covariance(rows, ["t"])
    chans, s, left, _ = modes.svd_modes(cov, 1)
    assert abs(left[0] @ mode) == pytest.approx(1.0, abs=1e-4)
    want = data.T @ data / 100
    assert {(r.chan, r.chan2): r.cov for r in cov.collect()}[(3, 7)] == pytest.approx(want[3, 7])
    arr = spark.createDataFrame([(t, data[t].tolist()) for t in range(100)], "t long, spec array<double>")
    out = np.array([r.spec for r in modes.subtract_modes(arr, "spec", left.tolist()).collect()])
    assert np.abs(out).max() < 0.1


def test_spectra(spark):
    rng = np.random.default_rng(3)
    shape = (4, 4, 4)
    a = rng.normal(size=shape)
    rows = spark.createDataFrame([("p", *map(int, i), float(a[i]), 1.0) for i in np.ndindex(shape)], "pair string, fi int, ri int, di int, value double, weight double")
    cells = spectra.pair_spectra(rows, rows, ["pair"], shape, (1.0, 1.0, 1.0), ())
    total = cells.agg(F.sum("power")).first()[0]
    assert total == pytest.approx((a**2).sum())
    b = spectra.radial_bins(cells, ["pair"], [0.0, 2.0, 6.0])
    assert b.agg(F.sum("counts")).first()[0] == 64
    w = rng.uniform(size=32)
    v = rng.normal(size=32)
    assert np.allclose(spectra.windowed_power(v, np.ones(32)), np.abs(np.fft.fft(v)) ** 2 / 32 / (1.0))
    assert spectra.windowed_power(v * w, w).shape == (32,)


def test_generators_repeat(spark):
    g = generators.pixels(spark, 4, 20, 20)
    x = generators.thermal_noise(g, F.lit(1.0), 1.0, F.lit(1.0), 5).agg(F.avg("value"), F.stddev("value")).first()
    assert abs(x[0]) < 0.1 and abs(x[1] - 1) < 0.1
    n = generators.poisson_counts(g, F.lit(3.0), 6).agg(F.avg("n"), F.var_samp("n")).first()
    assert abs(n[0] - 3) < 0.3 and abs(n[1] - 3) < 0.6
    f = lambda: generators.gaussian_fields(spark, 2, (4, 4, 4), (1.0, 1.0, 1.0), lambda k: k**-1.0, 1).agg(F.sum("value"), F.count("*")).first()
    assert f() == f() and f()[1] == 128


def test_fits(spark):
    r = fits.amplitude_fit(np.array([2.0, 4.0]), np.eye(2), np.array([1.0, 2.0]))
    assert r["amplitude"] == pytest.approx(2.0) and r["chi2"] == pytest.approx(0.0)
    x, y = np.meshgrid(np.linspace(-2, 2, 15), np.linspace(-2, 2, 15))
    v = 3 * np.exp(-((x - 0.3) ** 2 + (y + 0.2) ** 2) / (2 * 0.7**2)) + 0.5
    rows = spark.createDataFrame([(1, float(a), float(b), float(c)) for a, b, c in zip(x.ravel(), y.ravel(), v.ravel())], "chan int, x double, y double, value double")
    g = fits.gaussian_beam(rows, ["chan"]).first()
    assert (g.amplitude, g.x0, g.y0, g.sigma) == (pytest.approx(3, abs=1e-3), pytest.approx(0.3, abs=1e-3), pytest.approx(-0.2, abs=1e-3), pytest.approx(0.7, abs=1e-3))
    lin = fits.linear_fit(rows.withColumn("value", 2 * F.col("x") + 1), ["chan"], [F.lit(1.0), F.col("x")]).first()
    assert lin.coefficients == pytest.approx([1.0, 2.0])


def test_lineage(spark):
    df = spark.sql("select 1 as k, cast(null as array<struct<entry:string,details:array<string>>>) as history")
    a = lineage.add_history(df, "read", ["x"])
    b = lineage.add_history(df, "read", ["y"])
    h = lineage.merge_histories(a.union(b), ["k"]).first().history
    assert h[0].entry == "000: read" and h[0].details == ["x", "y"]
    with pytest.raises(Exception, match="histories differ"):
        lineage.merge_histories(a.union(lineage.add_history(df, "other")), ["k"]).collect()
    lo, hi = lineage.scan_range(F.lit("a/b_12-18.fits"))
    assert tuple(df.select(lo, hi).first()) == (12, 18)
    assert lineage.read_parameters({"ab_x": 1, "y": 2}, {"x": 0, "y": 0, "z": 3}, "ab_") == {"x": 1, "y": 2, "z": 3}
    assert lineage.undeclared({"ab_x": 1, "q": 2}, {"x": 0}, "ab_") == ["q"]


def test_empty_tables(spark):
    rows = spark.createDataFrame([], "k string, t long, chan int, value double")
    assert ts.hanning(rows, ["k"]).count() == 0
    assert ts.flag_channels(rows.withColumn("scan", F.lit(0)), [], ["scan"]).count() == 0
    grid = spark.createDataFrame([], "fi int, ri int, di int, value double, weight double")
    assert maps.weighted_stack(grid).count() == 0


def test_flagging_goes_on_past_twenty_passes(spark):
    # each pass finds the channel of the largest variance only, until five are left
    data = [(1, c, t, 1 + sign * 10 ** ((c - 10) / 2)) for c in range(30) for t, sign in enumerate((1, -1))]
    rows = spark.createDataFrame(data, "scan int, chan int, t int, value double")
    out = ts.flag_channels_until_stable(rows, [], ["scan"], 2.0)
    assert sorted({r.chan for r in out.where("value is not null").collect()}) == [0, 1, 2, 3, 4]
