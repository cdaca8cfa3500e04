"""Maps whose noise joins channels, eigenvalues and products in tiles, fits and mixing against dense linear algebra."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyquilt.operators import eigen, factor, joint_map, maps, mixing, nonlinear, noise_model
from skyquilt.sources import fits as files


@pytest.fixture(scope="module")
def stage(spark):
    return files.stager(spark, "joint-tests")


def dense(rows, index, model, n_chan, n_time):
    """P' N^-1 P and P' N^-1 d by dense inverses, masked samples left out."""
    a, b = np.zeros((len(index),) * 2), np.zeros(len(index))
    for s in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == s]
        full = noise_model.scan_noise(model, np.arange(float(n_time)), np.ones((n_chan, n_time))) - np.eye(n_chan * n_time)
        keep = sorted({c * n_time + t for _, c, t, _, v, _, _ in mine if v is not None})
        var, d, point = np.zeros(n_chan * n_time), np.zeros(n_chan * n_time), np.zeros((len(index), n_chan * n_time))
        for _, c, t, p, v, x, weight in mine:
            if v is not None:
                var[c * n_time + t], d[c * n_time + t] = x, v
                point[index[c, p], c * n_time + t] += weight
        inverse = np.linalg.inv(full[np.ix_(keep, keep)] + np.diag(var[keep]))
        a += point[:, keep] @ inverse @ point[:, keep].T
        b += point[:, keep] @ inverse @ d[keep]
    return a, b


@pytest.mark.parametrize(
    "model",
    [
        noise_model.NoiseModel(time_modes=2, frequency_modes=[([1.0, 0.5, -0.3], (0.4, -1.2, 0.1)), ([0.2, 1.0, 0.1], None)], big=100.0),
        noise_model.NoiseModel(time_modes=1, common=(0.3, -1.0, 0.1), big=50.0),
        noise_model.NoiseModel(time_modes=0),
    ],
)
def test_joint_map_equals_dense_inverses(spark, stage, model):
    rng = np.random.default_rng(1)
    rows = []
    for s in range(3):
        for t in range(12):
            for c in range(3):
                p, f = int(rng.integers(0, 7)), float(rng.uniform(0, 0.9))
                v = None if rng.random() < 0.1 and t not in (0, 11) else float(rng.normal())
                var = float(rng.uniform(0.5, 2))
                rows += [(s, c, t, p, v, var, 1 - f), (s, c, t, p + 1, v, var, f)]
    df = spark.createDataFrame(rows, "scan int, chan int, t long, p long, value double, var double, weight double")
    index = {(r.chan, r.p): r.row for r in joint_map.unknowns(df).collect()}
    assert sorted(index.values()) == list(range(len(index))) and [k for k, _ in sorted(index.items(), key=lambda x: x[1])] == sorted(index)
    a, b = dense(rows, index, model, 3, 12)
    cells = spark.range(36).select((F.col("id") % 3).cast("int").alias("chan"), F.floor(F.col("id") / 3).cast("long").alias("p"))
    out = joint_map.joint_map(stage, df, model, 3, side=8, prior=1e-2, cells=cells).collect()
    assert len(out) == 36 and all((r.value is None) == ((r.chan, r.p) not in index) for r in out)
    full = np.linalg.inv(a + 1e-2 * np.eye(len(index)))
    for r in out:
        if r.value is not None:
            k = index[r.chan, r.p]
            assert r.dirty == pytest.approx(b[k], abs=1e-6)
            assert r.value == pytest.approx((full @ b)[k], abs=1e-5)
            assert r.noise == pytest.approx(full[k, k], rel=1e-5)


def test_long_scans_are_refused(spark, stage, monkeypatch):
    monkeypatch.setattr(joint_map, "MOST_AMPLITUDES", 4)
    df = spark.createDataFrame([(1, 0, t, 0, 1.0, 1.0) for t in range(9)], "scan int, chan int, t long, p long, value double, var double")
    placed = joint_map.pointed(df, joint_map.unknowns(df))
    with pytest.raises(Exception, match="mode amplitudes"):
        joint_map.scan_factors(placed, noise_model.NoiseModel(time_modes=1, frequency_modes=[([1.0], None)]), 1, 4).collect()


def test_tiles_of_many_tasks_are_added_in_levels(spark, stage):
    df = spark.range(300).select(F.col("id").cast("int").alias("part"), (F.col("id") % 2).cast("int").alias("i"), F.lit(0).alias("j"), F.array(*[F.col("id").cast("double")] * 4).alias("tile"))
    out = {r.i: r.tile for r in joint_map.sum_tiles(stage, df, fan=4).collect()}
    assert out == {0: [float(sum(range(0, 300, 2)))] * 4, 1: [float(sum(range(1, 300, 2)))] * 4}


@pytest.mark.parametrize("n", [1, 2, 3, 5])
def test_every_pair_meets_once_in_a_sweep(n):
    met = [p for r in eigen.rounds(n) for p in r if p[0] != p[1]]
    assert sorted(met) == [(a, b) for a in range(n) for b in range(a + 1, n)]
    assert all(sorted(b for p in r for b in set(p)) == list(range(n)) for r in eigen.rounds(n))


def test_jacobi_gives_all_eigenvalues(spark, stage):
    rng = np.random.default_rng(2)
    n, side = 21, 8
    m = rng.normal(size=(n, n))
    m = m + m.T
    m[5], m[:, 5] = 0, 0  # a row without entries, and equal eigenvalues
    m[6], m[:, 6] = 0, 0
    entries = spark.createDataFrame([(i, j, float(m[i, j])) for i in range(n) for j in range(n) if m[i, j]], "row long, col long, value double")
    out = eigen.eigen(stage, factor.tiles(entries, side), 3, side)
    values = {r.column: r.eigenvalue for r in eigen.eigenvalues(out, side).collect()}
    assert np.allclose(sorted(values.values()), sorted([*np.linalg.eigvalsh(m), 0, 0, 0]), atol=1e-10)
    v = np.zeros((24, 24))
    for r in eigen.eigenvectors(out, side).collect():
        v[r.row, r.column] = r.value
    big = np.zeros((24, 24))
    big[:n, :n] = m
    assert np.allclose(v.T @ v, np.eye(24), atol=1e-10)
    assert np.allclose(big @ v, v * np.array([values[k] for k in range(24)]), atol=1e-9)


def seen(p, stokes, th):
    g, a, ps, ph, e, q0, u0, ch = p
    q, u = q0 * np.cos(2 * th) + u0 * np.sin(2 * th), u0 * np.cos(2 * th) - q0 * np.sin(2 * th)
    if stokes == 1:
        return g / 2 + np.cos(2 * a) * q + np.sin(2 * a) * np.cos(ch) * u
    f = np.cos if stokes == 2 else np.sin
    return 2 * e * f(ps + ph) - np.sin(2 * a) * f(ps + ch) * q + (np.cos(a) ** 2 * f(ps) - np.sin(a) ** 2 * f(ps + 2 * ch)) * u


def test_receivers_are_fitted(spark, stage):
    rng = np.random.default_rng(3)
    truth, rows = {}, []
    for c in range(4):
        q0 = 0.05 + 0.004 * c
        truth[c] = [0.3 + 0.02 * c, 1.4, 2.9 - 0.02 * c, 0.2, 0.016, q0, q0 * math.tan(2 * math.radians(33)), 0.1 + 0.01 * c]
        for _ in range(60):
            th = float(rng.uniform(0, 3))
            rows += [(c, th, k, float(seen(truth[c], k, th) + (1e-3 * rng.normal() if c == 3 else 0))) for k in (1, 2, 3)]
    rows.append((0, 1.0, 2, None))
    df = spark.createDataFrame(rows, "chan int, theta double, stokes int, value double")
    out = {r.chan: r for r in nonlinear.fit_mueller(stage, df, ["chan"], [0.3, 1.3, 2.8, 0.15, 0.02, 0.05, 0.1, 0.05], math.radians(33)).collect()}
    assert all(r.settled and r.dof == 60 * 3 + 1 - 8 for r in out.values())
    for c in range(3):
        assert np.allclose(out[c].parameters, truth[c], atol=1e-8)
    # With noise: the errors follow from the curvature, and the gradient vanishes.
    noisy = out[3]
    errors = np.sqrt(np.array(noisy.covariance).reshape(8, 8).diagonal())
    assert (np.abs(np.array(noisy.parameters) - truth[3]) < 5 * errors + 1e-6).all() and noisy.gradient < 1e-5
    jac = np.zeros((181, 8))
    mine = [(th, k) for c, th, k, v in rows if c == 3]
    for k in range(8):
        hi, lo = np.array(noisy.parameters), np.array(noisy.parameters)
        hi[k] += 1e-6
        lo[k] -= 1e-6
        jac[:180, k] = [(seen(hi, s, th) - seen(lo, s, th)) / 2e-6 for th, s in mine]
        jac[180, k] = (hi[6] / hi[5] - lo[6] / lo[5]) / 2e-6
    assert np.allclose(np.array(noisy.covariance).reshape(8, 8), np.linalg.inv(jac.T @ jac) * noisy.chi2 / noisy.dof, rtol=1e-3, atol=1e-9)


def test_sixteen_numbers_turn_what_is_measured_into_the_source(spark, stage):
    rng = np.random.default_rng(4)
    m, source, rows = rng.normal(size=(4, 4)) + 3 * np.eye(4), [10.0, 1.0, 2.0, 0.5], []
    for _ in range(30):
        th = float(rng.uniform(0, 3))
        c, s = math.cos(2 * th), math.sin(2 * th)
        own = [source[0], c * source[1] + s * source[2], c * source[2] - s * source[1], source[3]]
        rows.append((1, th, *map(float, np.linalg.solve(m, own) + 1e-3 * rng.normal(size=4))))
    df = spark.createDataFrame(rows, "chan int, theta double, m0 double, m1 double, m2 double, m3 double")
    out = nonlinear.fit_total_mueller(stage, df, ["chan"], [F.lit(x) for x in source]).first()
    design, want = [], []
    for _, th, *x in rows:
        c, s = math.cos(2 * th), math.sin(2 * th)
        x, z = np.array(x), np.zeros(4)
        design += [np.concatenate([x, z, z, z]), np.concatenate([z, c * x, -s * x, z]), np.concatenate([z, s * x, c * x, z]), np.concatenate([z, z, z, x])]
        want += source
    assert np.allclose(out.parameters, np.linalg.lstsq(np.array(design), np.array(want), rcond=None)[0], atol=1e-6) and out.settled


def test_mixing_equals_moving_the_window_bin_by_bin(spark, stage):
    rng = np.random.default_rng(5)
    shape, spacing = (4, 5, 6), (1.0, 0.5, 0.5)
    k = [2 * np.pi * np.fft.fftfreq(n, d) for n, d in zip(shape, spacing)]
    perp, par = [0.0, 3.0, 5.0, 20.0], [0.0, 1.0, 9.0]
    w = rng.uniform(0, 1, (2, *shape))
    frames = [spark.createDataFrame([("p", *map(int, at), float(w[(s, *at)])) for at in np.ndindex(shape)], "pair string, fi int, ri int, di int, weight double") for s in range(2)]
    kernels = stage(mixing.window_kernels(*frames, ["pair"], shape))
    got = {(r.row, r.col): r.value for r in mixing.mixing_matrix(kernels, ["pair"], shape, spacing, perp, par).collect()}
    kernel = (np.fft.fftn(w[0]) * np.conj(np.fft.fftn(w[1]))).real
    kernel /= kernel.sum()
    cell = np.array([[(np.digitize(math.hypot(k[1][b], k[2][c]), perp) - 1) * 2 + np.digitize(abs(k[0][a]), par) - 1 for c in range(6)] for a in range(4) for b in range(5)]).reshape(shape)
    for row in np.unique(cell):
        for col in np.unique(cell):
            total = np.zeros(shape)
            for at in np.argwhere(cell == col):
                total += np.roll(kernel, at, axis=(0, 1, 2))
            assert got[row, col] == pytest.approx(total[cell == row].mean(), abs=1e-12)
    assert len(got) == len(np.unique(cell)) ** 2
    same = mixing.mixing_matrix(mixing.identity_kernel(kernels, shape), ["pair"], shape, spacing, perp, par).collect()
    assert all(r.value == pytest.approx(float(r.row == r.col), abs=1e-12) for r in same)


def test_inverse_in_tiles_leaves_out_what_is_singular(spark, stage):
    rng = np.random.default_rng(6)
    m = rng.normal(size=(7, 7))
    m[3] = m[2]
    m[:, 6] = 0
    df = spark.createDataFrame([(i, j, float(m[i, j])) for i in range(7) for j in range(7) if m[i, j]], "row int, col int, value double")
    out = np.zeros((7, 7))
    for r in mixing.pseudo_inverse(stage, df, 7, side=3).collect():
        out[r.row, r.col] = r.value
    assert np.allclose(out, np.linalg.pinv(m, rcond=1e-6), atol=1e-7)


def test_selection_is_drawn_until_its_halves_agree(spark, stage):
    c = spark.range(500).select(F.col("id").alias("object_id"), (F.col("id") % 2).cast("int").alias("ri"), F.lit(0).alias("di"), ((F.col("id") % 97) / 97).alias("z"))
    loose, few = maps.settled_selection(stage, c, (0.0, 1.0, 5), F.lit(0.1), 3, bound=0.2, per_round=4)
    tight, many = maps.settled_selection(stage, c, (0.0, 1.0, 5), F.lit(0.1), 3, bound=0.01, per_round=4)
    assert few < many and all(abs(r.a - r.b) <= 0.01 * (r.a + r.b) for r in tight.collect())
    again, _ = maps.settled_selection(stage, c.repartition(3), (0.0, 1.0, 5), F.lit(0.1), 3, bound=0.2, per_round=4)
    assert sorted(map(tuple, loose.collect())) == sorted(map(tuple, again.collect()))
