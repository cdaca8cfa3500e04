"""Noise models, pair cleaning, special functions, generators and sources against brute force."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skyquilt.functions import special
from skyquilt.operators import angular, factor, fits, generators, noise_model, spectra
from skyquilt.operators import timestream as ts
from skyquilt.plans import catalog, drivers
from skyquilt.sources import fits as S
from skyquilt.streaming import streams

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(
    "model",
    [
        noise_model.NoiseModel(time_modes=2),
        noise_model.NoiseModel(time_modes=1, frequency_modes=[([1.0, 0.5, -0.3], None)]),
        noise_model.NoiseModel(time_modes=2, frequency_modes=[([1.0, 0.5, -0.3], (0.4, -1.2, 0.1)), ([0.2, 1.0, 0.1], (0.1, -1.0, 0.1))], common=(0.2, -0.8, 0.1)),
        noise_model.NoiseModel(time_modes=0, low=(0.3, -1.0, 0.03)),
    ],
)
def test_scan_weights_equal_the_dense_inverse(model):
    rng = np.random.default_rng(1)
    t, n_chan = np.arange(40.0), 3
    w = 1 / rng.uniform(0.5, 2, (n_chan, 40))
    d = rng.normal(size=(n_chan, 40))
    nd, diagonal = noise_model.weigh_scan(model, t, w, d)
    inverse = np.linalg.inv(noise_model.scan_noise(model, t, w))
    assert np.allclose(nd.ravel(), inverse @ d.ravel(), atol=1e-6)
    assert np.allclose(diagonal.ravel(), np.diag(inverse), atol=1e-6)


def test_masked_samples_have_no_weight():
    t, w = np.arange(10.0), np.ones((2, 10))
    w[0, 3] = 0
    d = np.ones((2, 10))
    nd, diagonal = noise_model.weigh_scan(noise_model.NoiseModel(time_modes=1), t, w, d)
    assert nd[0, 3] == 0 and diagonal[0, 3] == 0


def test_steep_noise_is_refused():
    with pytest.raises(ValueError):
        noise_model.NoiseModel(frequency_modes=[([1.0], (0.1, -4.0, 0.1))])
    with pytest.raises(ValueError):
        noise_model.NoiseModel(low=(1.0, -1.0, 0.3)).time_basis(np.arange(20.0))


def test_streams_without_mean_and_slope_equal_the_dense_inverse(spark):
    rng = np.random.default_rng(2)
    rows = [("a", s, t, int(rng.integers(0, 5)), None if (s, t) == (1, 3) else float(rng.normal()), float(rng.uniform(0.5, 2))) for s in range(3) for t in range(12)]
    df = spark.createDataFrame(rows, "k string, scan int, t int, p long, value double, var double")
    from skyquilt.operators import maps

    dirty, inverse = maps.correlated_map(df, ["k"])
    want_d, want_i = np.zeros(5), np.zeros((5, 5))
    for s in range(3):
        part = [r for r in rows if r[1] == s and r[4] is not None]
        t = np.array([r[2] for r in part], float)
        u = np.stack([np.ones(len(t)) / math.sqrt(len(t)), (t - t.mean()) / np.linalg.norm(t - t.mean())])
        n = np.diag([r[5] for r in part]) + noise_model.HUGE * u.T @ u
        at = np.zeros((len(part), 5))
        at[np.arange(len(part)), [r[3] for r in part]] = 1
        ni = np.linalg.inv(n)
        want_d += at.T @ ni @ np.array([r[4] for r in part])
        want_i += at.T @ ni @ at
    got = np.zeros((5, 5))
    for r in inverse.collect():
        got[r.p, r.q] = r.value
    assert np.allclose([r.dirty for r in dirty.orderBy("p").collect()], want_d, atol=1e-8) and np.allclose(got, want_i, atol=1e-8)


def test_cleaned_pairs_equal_dense_projection(spark):
    rng = np.random.default_rng(3)
    rows = [(t, f, i, j, float(rng.normal() + 3 * math.sin(f) * (i + 1)), float(rng.uniform(0.5, 2))) for t in "AB" for f in range(4) for i in range(5) for j in range(4)]
    df = spark.createDataFrame(rows, "tag string, fi int, ri int, di int, value double, weight double")
    members = drivers.prepare_pairs(df, "tag").cache()
    out = drivers.clean_map_pairs(df, "tag", 1, 2)
    m = members.toPandas()
    cube = {}
    for side in (1, 2):
        v, w = np.zeros((4, 20)), np.zeros((4, 20))
        p = m[m.side == side]
        v[p.fi, p.ri * 4 + p.di], w[p.fi, p.ri * 4 + p.di] = p.value, p.weight
        cube[side] = (v, w)
    (v1, w1), (v2, w2) = cube[1], cube[2]
    u, _, vt = np.linalg.svd((v1 * w1) @ (v2 * w2).T / (w1 @ w2.T))
    got = out.toPandas()
    for side, modes, v in ((1, u.T, v1), (2, vt, v2)):
        for n in (1, 2):
            want = v - modes[:n].T @ (modes[:n] @ v)
            p = got[(got.side == side) & (got.n_modes == n)]
            have = np.zeros((4, 20))
            have[p.fi, p.ri * 4 + p.di] = p.value
            assert np.allclose(have, want, atol=1e-8)
    more = drivers.clean_map_pairs(df, "tag", 1, 1, external=df.where("tag = 'A'").select("fi", "ri", "di", "value", "weight"))
    assert more.count() == out.where("n_modes = 1").count()


def test_noise_is_measured(spark):
    rng = np.random.default_rng(4)
    t = np.arange(512)
    mode = np.array([0.8, 0.6, 0.0])
    slow = np.cumsum(rng.normal(size=512))
    values = mode[:, None] * slow + rng.normal(scale=0.1, size=(3, 512))
    df = spark.createDataFrame([("f", c, int(i), float(values[c, i])) for c in range(3) for i in t], "file string, chan int, t int, value double")
    variance, fit = drivers.measure_noise(df, ["file"], 512, 8, 1, 1.0, 0.01)
    v = {r.chan: r["var"] for r in variance.collect()}
    assert all(x < 0.05 for x in v.values())
    assert -2.6 < fit.first()["index"] < -1.4


def test_special_functions(spark):
    x = [0.05, 0.3, 1.0, math.pi, 7.5, 40.0]
    df = spark.createDataFrame([(v,) for v in x], "x double")
    # j_l by its integral over Legendre polynomials.
    nodes, weights = np.polynomial.legendre.leggauss(200)
    for l in (0, 1, 2, 5, 12):
        p = np.polynomial.legendre.Legendre.basis(l)(nodes)
        want = [float((0.5 * (-1j) ** l * (weights * np.exp(1j * v * nodes) * p).sum()).real) for v in x]
        got = [r[0] for r in df.orderBy("x").select(special.spherical_bessel(F.lit(l), F.col("x"))).collect()]
        assert np.allclose(got, want, rtol=1e-6, atol=1e-13), l
    assert df.where("x < 0.1").select(special.spherical_bessel(F.lit(0), F.lit(0.0)), special.spherical_bessel(F.lit(3), F.lit(0.0))).first() == (1.0, 0.0)


def test_splines_equal_a_dense_solve(spark):
    x, y = np.array([0.0, 1.0, 2.5, 4.0, 7.0]), np.array([1.0, 3.0, -1.0, 0.5, 2.0])
    df = spark.createDataFrame([("k", float(a), float(b)) for a, b in zip(x, y)], "k string, x double, y double")
    at = np.linspace(-1, 8, 37)
    rows = special.spline(df, ["k"], "x", "y").crossJoin(spark.createDataFrame([(float(a),) for a in at], "a double"))
    got = np.array([r.v for r in rows.select("a", special.spline_value(F.col("spline"), F.col("a")).alias("v")).orderBy("a").collect()])
    h = np.diff(x)
    m = np.zeros(5)
    a = np.diag(2 * (h[:-1] + h[1:])) + np.diag(h[1:-1], 1) + np.diag(h[1:-1], -1)
    m[1:-1] = np.linalg.solve(a, 6 * np.diff(np.diff(y) / h))
    i = np.clip(np.searchsorted(x, at, side="right") - 1, 0, 3)
    s, t = (x[i + 1] - at) / h[i], (at - x[i]) / h[i]
    inside = s * y[i] + t * y[i + 1] + ((s**3 - s) * m[i] + (t**3 - t) * m[i + 1]) * h[i] ** 2 / 6
    ok = (at >= 0) & (at <= 7)
    assert np.allclose(got[ok], inside[ok])
    assert np.allclose(np.diff(got[at < 0], 2), 0) and np.allclose(np.diff(got[at > 7], 2), 0)


def test_large_poisson_means(spark):
    df = spark.range(2000).select(F.col("id").alias("fi"))
    n = generators.poisson_counts(df, F.when(F.col("fi") < 1000, 900.0).otherwise(3.0), 5).toPandas()
    big, small = n[n.fi < 1000].n, n[n.fi >= 1000].n
    assert abs(big.mean() - 900) < 5 * 30 / math.sqrt(1000) and abs(big.std() / 30 - 1) < 0.1
    assert abs(small.mean() - 3) < 5 * math.sqrt(3 / 1000)
    again = generators.poisson_counts(df.repartition(7), F.when(F.col("fi") < 1000, 900.0).otherwise(3.0), 5).toPandas().sort_values("fi")
    assert again.n.tolist() == n.sort_values("fi").n.tolist()


def test_fields_have_their_power(spark):
    f = angular.foreground_fields(spark, np.array([[2.0, 1.0], [1.0, 1.0]]), 16, lambda k: np.ones_like(k), 3)
    m = f.groupBy("ri", "di").pivot("fi", [0, 1]).agg(F.first("value")).toPandas()
    c = np.cov(m["0"], m["1"])
    assert abs(c[0, 0] - 2) < 0.7 and abs(c[0, 1] - 1) < 0.5 and abs(c[1, 1] - 1) < 0.4
    s = angular.synchrotron_fields(spark, 3, 8, (700.0, 50.0), 700.0, (10.0, 1.0), (-2.0, 0.1), lambda k: np.ones_like(k), 1)
    mean = {r.fi: r.v for r in s.groupBy("fi").agg(F.avg("value").alias("v")).collect()}
    assert mean[0] > mean[1] > mean[2]
    from skyquilt.functions.cosmology import Cosmology

    assert angular.signal_field(spark, (4, 4, 4), (1.0, 1.0, 1.0), (700.0, 2.0), lambda k: k**-1.0, Cosmology(), 2).count() == 64


def test_flags_until_stable_equal_a_loop(spark):
    rng = np.random.default_rng(6)
    values = rng.normal(10, 1, (20, 30)) + np.where(np.arange(20)[:, None] < 3, rng.normal(0, 1, (20, 30)) * np.array([[40], [12], [6]] + [[0]] * 17), 0)
    df = spark.createDataFrame([(1, c, t, float(values[c, t])) for c in range(20) for t in range(30)], "scan int, chan int, t int, value double")
    out = ts.flag_channels_until_stable(df, [], ["scan"], 2.0)
    q = values.var(1) / values.mean(1) ** 2
    left = list(range(20))
    while new := [c for c in left if q[c] > q[left].mean() + 2.0 * q[left].std()]:
        left = [c for c in left if c not in new]
    assert sorted(r.chan for r in out.where("value is not null").select("chan").distinct().collect()) == left


def test_jumps_pass_over_nulls(spark, tmp_path):
    values = [1.0, 1.1, 0.9, 1.0, None, 1.05, 0.95, 1.0, 1.1, 0.9, 1.0, 1.02, 9.0, None, 1.0]
    rows = spark.createDataFrame([(i, "k", v) for i, v in enumerate(values)], "i int, key string, value double").withColumn("ts", F.expr("timestamp'2024-01-01' + make_interval(0,0,0,0,0,i)"))
    rows.select("key", "ts", "value").write.parquet(str(tmp_path / "in"))
    stream = streams.flag_jumps(streams.read_new_files(spark, str(tmp_path / "in"), rows.select("key", "ts", "value").schema), "key")
    q = stream.writeStream.format("memory").queryName("jumps").outputMode("append").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert [r.value for r in spark.sql("select value from jumps where flag").collect()] == [9.0]


def test_late_rows_are_left_out(spark, tmp_path):
    """Files come one after another: rows older than the watermark of earlier ones do not count."""
    source = str(tmp_path / "in")

    def arrive(stamps):
        spark.createDataFrame([(f"2024-01-01 {s}", 1, 1.0) for s in stamps], "ts string, chan int, value double").select(F.col("ts").cast("timestamp").alias("ts"), "chan", "value").coalesce(1).write.mode("append").parquet(source)

    arrive(["00:00:10", "00:20:10"])
    stream = streams.rebin(streams.read_new_files(spark, source, "ts timestamp, chan int, value double"), ["chan"], "10 minutes", "0 seconds")
    q = stream.writeStream.format("memory").queryName("late").outputMode("append").start()
    try:
        q.processAllAvailable()
        arrive(["00:00:20", "00:40:00"])
        q.processAllAvailable()
    finally:
        q.stop()
    got = {str(r.start)[11:16]: r.n for r in spark.sql("select start, n from late").collect()}
    assert got["00:00"] == 1


def test_sliding_windows_and_sessions(spark, tmp_path):
    rows = spark.sql("select timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,0,cast(id as int)) as ts, 1 as chan, cast(id as double) as value from (select id * 30 as id from range(10) union all select 1000 + id * 30 from range(5))")
    rows.write.parquet(str(tmp_path / "in"))
    for name, stream, n in (("slid", streams.rebin(streams.read_new_files(spark, str(tmp_path / "in"), rows.schema), ["chan"], "2 minutes", "0 seconds", slide="1 minute"), None), ("sess", streams.scans(streams.read_new_files(spark, str(tmp_path / "in"), rows.schema), ["chan"], "2 minutes", "0 seconds"), 2)):
        q = stream.writeStream.format("memory").queryName(name).outputMode("complete").start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        got = spark.sql(f"select * from {name}")
        if n:
            assert got.count() == n
        else:
            assert got.agg(F.sum("n")).first()[0] == 2 * rows.count()


def test_records_are_read_in_parts_and_by_scan(spark, tmp_path):
    S.register(spark)
    rows = spark.createDataFrame([(i % 4, i, [float(i), None, 2.0], ["000: made"]) for i in range(60)], "SCAN int, T int, DATA array<double>, history array<string>")
    rows.coalesce(1).write.format("sdfits").mode("overwrite").option("path", str(tmp_path / "f")).save()
    df = spark.read.format("sdfits").schema("file string, record int, SCAN int, T int, DATA array<double>, history array<string>, other double").option("partBytes", 200).load(str(tmp_path / "f"))
    assert df.rdd.getNumPartitions() > 1
    got = df.where("SCAN = 2").orderBy("T").collect()
    assert [r["T"] for r in got] == list(range(2, 60, 4)) and got[0].history == ["000: made"] and got[0].other is None
    assert got[0].DATA[0] == 2.0 and math.isnan(got[0].DATA[1])
    with pytest.raises(Exception, match="lengths"):
        spark.createDataFrame([([1.0],), ([1.0, 2.0],)], "DATA array<double>").coalesce(1).write.format("sdfits").mode("overwrite").option("path", str(tmp_path / "g")).save()


def test_cubes_of_other_axes(spark, tmp_path):
    S.register(spark)
    cells = spark.range(16).select(F.lit("c").alias("name"), (F.col("id") / 8).cast("int").alias("a"), (F.col("id") / 4 % 2).cast("int").alias("b"), (F.col("id") % 4).cast("int").alias("c"), F.lit(0).alias("d"), F.col("id").cast("double").alias("value"))
    S.write_npy(cells, str(tmp_path / "n"), "name", {"a": "pol", "b": "freq", "c": "ra", "d": "dec"}, {"freq_centre": 700.0, "freq_delta": -1.0}).collect()
    got = spark.read.format("npycube").option("axes", "pol,freq,ra,dec").load(str(tmp_path / "n"))
    assert got.count() == 16 and got.where("pol_i = 1 and fi = 0 and ri = 3").first().value == 11.0 and got.where("fi = 1").first().freq == 700.0
    with pytest.raises(ValueError):
        S.write_npy(cells, str(tmp_path / "n"), "name", {"a": "pol"}, {"x": float("nan")})


def test_pseudo_inverse_and_unmixing(spark):
    m = np.array([[1.0, 0.2, 0.0], [0.1, 1.0, 0.3], [0.0, 0.2, 1.0]])
    mixing = spark.createDataFrame([(i, j, float(m[i, j])) for i in range(3) for j in range(3)], "row int, col int, value double")
    truth = np.array([3.0, 1.0, 2.0])
    power = spark.createDataFrame([(i, float(v)) for i, v in enumerate(m @ truth)], "bin int, power double")
    out = {r.bin: r.power for r in spectra.unmix(power, spectra.pseudo_inverse(mixing), []).collect()}
    assert np.allclose([out[i] for i in range(3)], truth)


def test_gains_by_modes(spark):
    from skyquilt.operators import maps

    left, right = np.array([1.0, 2.0, 3.0]), np.array([2.0, 2.0, 1.0])
    cross = spark.createDataFrame([(i, j, float(left[i] * right[j])) for i in range(3) for j in range(3)], "chan int, chan2 int, cov double")
    got = {r.chan: r.gain for r in maps.mode_ratio_gain(cross).collect()}
    want = (left / np.linalg.norm(left)) / (right / np.linalg.norm(right))
    assert np.allclose([got[i] for i in range(3)], want)


def test_selection_by_simulation(spark):
    from skyquilt.operators import maps

    c = spark.range(200).select(F.col("id").alias("object_id"), F.lit(0).alias("ri"), F.lit(0).alias("di"), F.lit(0.5).alias("z"))
    n = maps.selection_by_simulation(c, 50, (0.0, 1.0, 10), F.lit(0.05), 3).toPandas()
    assert abs(n.nbar.sum() - 200) < 1e-6 and set(n[n.nbar > 20].bin) == {4, 5}


def test_beam_fit_of_nothing(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0, None), (2, 0.0, 0.0, 1.0)], "chan int, x double, y double, value double")
    rows = {r.chan: r for r in fits.gaussian_beam(df, ["chan"]).collect()}
    assert rows[1].amplitude is None or math.isnan(rows[1].amplitude)


def test_likelihoods(spark):
    points = spark.createDataFrame([(1.0, 5.0, 1.0, 4.0, 2.0)], "model double, auto1 double, error1 double, auto2 double, error2 double")
    g = spark.createDataFrame([(1.0,), (5.0,)], "x double")
    got = {r.x: r.loglike for r in fits.auto_signal_likelihood(points, g, []).collect()}
    phi = lambda z: 0.5 * (1 + math.erf(z / math.sqrt(2)))
    assert got[5.0] == pytest.approx(math.log(0.5) + math.log(1 - phi(0.5)), abs=1e-5)
    assert got[1.0] == pytest.approx(math.log(1 - phi(-4)) + math.log(1 - phi(-1.5)), abs=1e-5)


def test_random_numbers_are_the_same_on_every_run(spark):
    g = catalog.grid(spark, SF).select("fi", "ri", "di", "weight")
    made = (
        lambda: generators.thermal_noise(g, F.lit(20.0), 1e6, F.col("weight"), 1),
        lambda: generators.poisson_counts(g, F.col("weight") * 20, 3),
        lambda: generators.gaussian_fields(spark, 2, (4, 4, 4), (1.0, 1.0, 1.0), lambda k: k**-1.5, 5),
        lambda: generators.over_f_noise(spark, 2, 64, 1.0, -1.0, 0.1, 1.0, 9),
    )
    for make in made:
        a, b = (Counter(map(tuple, make().collect())) for _ in range(2))
        assert a == b and len(a) > 1


def test_noise_cube_has_the_radiometer_deviation(spark):
    g = generators.pixels(spark, 8, 16, 16)
    v = generators.thermal_noise(g, 20 + (900 - (700 + F.col("fi"))) / 200 * 10, 1e6, F.lit(1.0), 1).toPandas()
    want = np.array([20 + (900 - (700 + f)) / 200 * 10 for f in range(8)]) / 1e3
    got = v.groupby("fi").value.std().to_numpy()
    assert np.allclose(got, want, rtol=0.2)


def test_joint_weights_through_the_query(spark):
    out = catalog.QUERIES["joint_noise_weights"](spark, SF).toPandas()
    rows = catalog.spectra_rows(spark, SF).toPandas()
    n = int(rows.chan.max()) + 1
    rows["scan"], rows["p"] = rows.t // 25, rows.t % 9
    model = noise_model.NoiseModel(dt=1.0, time_modes=2, frequency_modes=[([1 / (1 + c) for c in range(n)], (0.3, -1.0, 0.1))])
    dirty = pd.Series(0.0, index=pd.MultiIndex.from_product([range(n), range(9)]))
    for _, s in rows.groupby("scan"):
        t = np.sort(s.t.unique())
        d = np.zeros((n, len(t)))
        d[s.chan, np.searchsorted(t, s.t)] = s.value
        nd = np.linalg.solve(noise_model.scan_noise(model, t.astype(float), np.full(d.shape, 2.0)), d.ravel()).reshape(d.shape)
        for c in range(n):
            for k, x in zip(t % 9, nd[c]):
                dirty[(c, int(k))] += x
    got = out.set_index(["chan", "p"]).dirty
    assert np.allclose(got.sort_index().to_numpy(), dirty.sort_index().to_numpy(), atol=1e-5)


def test_tiles_are_taken_apart_and_put_together(spark):
    e = spark.createDataFrame([(0, 0, 2.0), (1, 4, 3.0), (4, 1, -1.0)], "row long, col long, value double")
    assert sorted(map(tuple, factor.entries(factor.tiles(e, 3), 3).collect())) == sorted(map(tuple, e.collect()))
