"""Noise of time streams: low-frequency power of channels, modes that share it, and 1/f fits."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import modes as _modes


def fourier_low(rows: DataFrame, keys: list[str], n_time: int, n_freq: int, t: str = "t") -> DataFrame:
    """Real and imaginary parts of the lowest frequencies of each stream, by sums over its samples."""
    spread = rows.where("value is not null").withColumn("f", F.explode(F.sequence(F.lit(1), F.lit(n_freq))))
    angle = F.col(t) * F.col("f") * (2 * math.pi / n_time)
    return spread.groupBy(*keys, "f").agg(F.sum(F.col("value") * F.cos(angle)).alias("re"), F.sum(-F.col("value") * F.sin(angle)).alias("im"))


def low_power_matrix(rows: DataFrame, keys: list[str], n_time: int, n_freq: int, t: str = "t") -> DataFrame:
    """Mean cross power of every pair of channels over the lowest frequencies: (keys, chan, chan2, cov)."""
    f = fourier_low(rows, [*keys, "chan"], n_time, n_freq, t)
    # Real and imaginary parts are rows of their own; a pair's weight counts both.
    parts = f.select(*keys, "f", "chan", F.posexplode(F.array("re", "im")).alias("part", "x"))
    spec = parts.groupBy(*keys, "f", "part").agg(F.collect_list(F.struct(F.col("chan").alias("c"), "x", F.lit(1.0).alias("w"))).alias("s"))
    return _modes.pair_sums(spec, keys).select(*keys, "chan", "chan2", (2 * F.col("xx") / F.col("ww") / n_time).alias("cov"))


def noise_modes(rows: DataFrame, n_time: int, n_freq: int, n_modes: int, t: str = "t") -> tuple[list, np.ndarray, np.ndarray]:
    """Channels, power and vectors of the modes that dominate the low frequencies."""
    return _modes.eigen_modes(low_power_matrix(rows, [], n_time, n_freq, t), n_modes)


def over_f_curve(f: np.ndarray, amp: float, index: float, thermal: float, f0: float) -> np.ndarray:
    return amp * (f / f0) ** index + thermal


def fit_curve(f: np.ndarray, p: np.ndarray, f0: float, steps: int = 80) -> tuple[float, float, float]:
    """amp, index and thermal level of amp (f / f0)^index + thermal: damped least squares of the log of power."""
    keep = (f > 0) & (p > 0)
    f, y = f[keep], np.log(p[keep])
    if len(f) < 4:
        return float("nan"), float("nan"), float(p.mean()) if len(p) else float("nan")
    x = np.array([math.log(max(np.exp(y[:3].mean()), 1e-300)), -1.0, math.log(max(np.median(np.exp(y[len(y) // 2 :])), 1e-300))])

    def model(x):
        a, c = np.exp(x[0]) * (f / f0) ** x[1], np.exp(x[2])
        s = a + c
        return np.log(s), np.stack([a / s, a / s * np.log(f / f0), np.full(len(f), c) / s], 1)

    damp, (m, j) = 1e-2, model(x)
    for _ in range(steps):
        h = j.T @ j
        new = x + np.clip(np.linalg.lstsq(h + damp * np.diag(np.diag(h) + 1e-9), j.T @ (y - m), rcond=None)[0], -1, 1)
        m2, j2 = model(new)
        if ((y - m2) ** 2).sum() < ((y - m) ** 2).sum():
            x, m, j, damp = new, m2, j2, damp / 3
        else:
            damp *= 4
    return float(np.exp(x[0])), float(x[1]), float(np.exp(x[2]))


def fit_over_f(power: DataFrame, keys: list[str], f0: float) -> DataFrame:
    """Fit to each key's power (freq, power); a key is one spectrum of bounded length."""
    kinds = ", ".join(f"{k} {power.schema[k].dataType.simpleString()}" for k in keys)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a, i, c = fit_curve(pdf["freq"].to_numpy(float), pdf["power"].to_numpy(float), f0)
        out = pd.DataFrame({"amplitude": [a], "index": [i], "thermal": [c]})
        for k in keys:
            out[k] = pdf[k].iloc[0]
        return out[[*keys, "amplitude", "index", "thermal"]]

    return power.groupBy(*keys).applyInPandas(run, f"{kinds}, amplitude double, index double, thermal double")


def at_least_thermal(params: DataFrame, bandwidth: float, dt: float, temperature: str = "tsys") -> DataFrame:
    """Thermal levels no lower than the radiometer equation allows."""
    limit = F.col(temperature) ** 2 / (bandwidth * dt)
    return params.withColumn("thermal", F.greatest("thermal", limit))


def orthogonal_polynomials(rows: DataFrame, keys: list[str], x: str, order: int, window: str | None = None) -> DataFrame:
    """Basis of polynomials up to ``order`` that is orthonormal under the window in each key; a key is one stream of bounded length."""
    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf[x].to_numpy(float)
        w = pdf[window].to_numpy(float) if window else np.ones(len(v))
        v = (v - v.mean()) / max(np.ptp(v), 1e-12)
        basis: list[np.ndarray] = []
        for n in range(order + 1):
            p = v**n
            for q in basis:
                p = p - (p * w * q).sum() * q
            norm = math.sqrt(max((p * w * p).sum(), 0.0))
            basis.append(p / norm if norm > 1e-12 else np.zeros_like(p))
        out = pd.DataFrame({k: pdf[k] for k in keys} | {x: pdf[x], "basis": list(np.stack(basis, 1))})
        return out[[*keys, x, "basis"]]

    return rows.groupBy(*keys).applyInPandas(run, f"{kinds}, {x} {rows.schema[x].dataType.simpleString()}, basis array<double>")


def high_pass(rows: DataFrame, keys: list[str], x: str, order: int) -> DataFrame:
    """Values less their projection on polynomials up to ``order``; masked values stay masked and have no weight."""
    weighted = rows.withColumn("_w", F.col("value").isNotNull().cast("double"))
    basis = orthogonal_polynomials(weighted, keys, x, order, "_w")
    both = weighted.join(basis, [*keys, x])
    amp = [F.sum(F.coalesce("value", F.lit(0.0)) * F.col("basis")[n]) for n in range(order + 1)]
    fit = both.groupBy(*keys).agg(F.array(*amp).alias("_a"))
    model = F.aggregate(F.zip_with("_a", "basis", lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)
    return both.join(fit, keys).withColumn("value", F.col("value") - model).drop("_w", "_a", "basis")


def gain_from_map(samples: DataFrame, keys: list[str], x: str, order: int = 2) -> DataFrame:
    """Gain of a stream against a map (value, map_value): both are high-passed, then sum v m / sum m m."""
    v = high_pass(samples.select(*keys, x, "value"), keys, x, order)
    m = high_pass(samples.select(*keys, x, F.col("map_value").alias("value")), keys, x, order).withColumnRenamed("value", "m")
    j = v.join(m, [*keys, x])
    return j.groupBy(*keys).agg(F.sum(F.col("value") * F.col("m")).alias("corr"), F.sum(F.when(F.col("value").isNotNull(), F.col("m") * F.col("m"))).alias("norm")).withColumn("gain", F.try_divide("corr", "norm"))
