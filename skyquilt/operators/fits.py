"""Fits and likelihoods on small tables: amplitudes, confidence intervals, gains, Gaussian beams."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def amplitude_fit(data: np.ndarray, cov: np.ndarray, theory: np.ndarray, diagonal: bool = False, rank: float = 1e-12) -> dict[str, float]:
    """Generalised least-squares amplitude of a template, with its error, chi squared and degrees of freedom."""
    cov = np.diag(np.diag(cov)) if diagonal else cov
    inverse = np.linalg.pinv(cov, rcond=rank)
    norm = theory @ inverse @ theory
    amp = theory @ inverse @ data / norm
    rest = data - amp * theory
    s = np.linalg.svd(cov, compute_uv=False)
    return {"amplitude": float(amp), "error": float(norm**-0.5), "chi2": float(rest @ inverse @ rest), "dof": float((s > rank * s.max()).sum() - 1)}


def cumulative(pdf: DataFrame, keys: list[str], x: str = "x", p: str = "p") -> DataFrame:
    """Normalised trapezoid cumulative of a tabulated density."""
    w = Window.partitionBy(*keys).orderBy(x)
    step = F.coalesce((F.col(x) - F.lag(x).over(w)) * (F.col(p) + F.lag(p).over(w)) / 2, F.lit(0.0))
    run = pdf.withColumn("_s", step).withColumn("_c", F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return run.withColumn("cdf", F.try_divide(F.col("_c"), F.max("_c").over(Window.partitionBy(*keys)))).drop("_s", "_c")


def confidence_interval(pdf: DataFrame, keys: list[str], conf: float = 0.68, x: str = "x", p: str = "p") -> DataFrame:
    """Low, middle and high points of each density by its inverse cumulative, linear between table points."""
    w = Window.partitionBy(*keys).orderBy(x)
    c = cumulative(pdf, keys, x, p).withColumn("_x0", F.lag(x).over(w)).withColumn("_c0", F.lag("cdf").over(w))

    def point(q: float) -> Column:
        inside = (F.col("_c0") < q) & (F.col("cdf") >= q)
        return F.min(F.when(inside, F.col("_x0") + (F.col(x) - F.col("_x0")) * (q - F.col("_c0")) / (F.col("cdf") - F.col("_c0"))))

    return c.groupBy(*keys).agg(point(0.5 - conf / 2).alias("low"), point(0.5).alias("middle"), point(0.5 + conf / 2).alias("high"))


def gaussian_likelihood(points: DataFrame, grid: DataFrame, keys: list[str], value: str, error: str, model: str = "model") -> DataFrame:
    """Log likelihood of each grid amplitude: the measured points are few, the grid is a short table."""
    chi = (F.col(value) - F.col("x") * F.col(model)) / F.col(error)
    return points.crossJoin(F.broadcast(grid)).groupBy(*keys, "x").agg(F.sum(-0.5 * chi * chi).alias("loglike"))


def survival(signal: Column, mean: Column, error: Column) -> Column:
    """Normal probability that an auto power exceeds its measurement at a signal power, by a rational approximation of the error function."""
    z = (signal - mean) / (error * math.sqrt(2))
    t = 1 / (1 + 0.3275911 * F.abs(z))
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    erf = F.signum(z) * (1 - poly * F.exp(-z * z))
    return (1 + erf) / 2


def robust_gain(on: DataFrame, off: DataFrame, keys: list[str], nominal: Column) -> DataFrame:
    """nominal / (median on - median off) of each key."""
    m = on.groupBy(*keys).agg(F.median("value").alias("on")).join(off.groupBy(*keys).agg(F.median("value").alias("off")), keys)
    return m.select(*keys, F.try_divide(nominal, F.col("on") - F.col("off")).alias("gain"))


def gaussian_beam(rows: DataFrame, keys: list[str], steps: int = 60) -> DataFrame:
    """Amplitude, centre, width and offset of a Gaussian for each key (x, y, value), by damped least squares; a key is one channel's samples."""
    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y, v = (pdf[c].to_numpy(float) for c in ("x", "y", "value"))
        at = np.isfinite(v)
        x, y, v = x[at], y[at], v[at]
        if not len(v):  # nothing finite: a row of nulls
            out = pd.DataFrame([[None] * 6], columns=["amplitude", "x0", "y0", "sigma", "offset", "residual"], dtype=float)
            for k2 in keys:
                out[k2] = pdf[k2].iloc[0]
            return out[[*keys, "amplitude", "x0", "y0", "sigma", "offset", "residual"]]
        base = np.median(v)
        top = int(v.argmax())
        p = np.array([v[top] - base, x[top], y[top], max(np.std(x), 1e-6), base])
        damp = 1e-2

        def model(p):
            g = np.exp(-((x - p[1]) ** 2 + (y - p[2]) ** 2) / (2 * p[3] ** 2))
            j = np.stack([g, p[0] * g * (x - p[1]) / p[3] ** 2, p[0] * g * (y - p[2]) / p[3] ** 2, p[0] * g * ((x - p[1]) ** 2 + (y - p[2]) ** 2) / p[3] ** 3, np.ones_like(g)], 1)
            return p[0] * g + p[4], j

        f, j = model(p)
        for _ in range(steps):
            a = j.T @ j
            new = p + np.linalg.lstsq(a + damp * np.diag(np.diag(a) + 1e-12), j.T @ (v - f), rcond=None)[0]
            g, k = model(new)
            if ((v - g) ** 2).sum() < ((v - f) ** 2).sum():
                p, f, j, damp = new, g, k, damp / 3
            else:
                damp *= 4
        out = pd.DataFrame([[*p[:3], abs(p[3]), p[4], float(((v - f) ** 2).sum())]], columns=["amplitude", "x0", "y0", "sigma", "offset", "residual"])
        for k2 in keys:
            out[k2] = pdf[k2].iloc[0]
        return out[[*keys, "amplitude", "x0", "y0", "sigma", "offset", "residual"]]

    return rows.groupBy(*keys).applyInPandas(run, f"{kinds}, amplitude double, x0 double, y0 double, sigma double, offset double, residual double")


def linear_fit(rows: DataFrame, keys: list[str], basis: list[Column]) -> DataFrame:
    """Least squares of value on a short list of basis columns: sums of products in one aggregate, the small system in each row."""
    names = [f"b{k}" for k in range(len(basis))]
    at = rows.where("value is not null").select(*keys, "value", *[c.alias(n) for c, n in zip(basis, names)])
    sums = at.groupBy(*keys).agg(F.array(*[F.sum(F.col(a) * F.col(b)) for a in names for b in names]).alias("a"), F.array(*[F.sum(F.col(a) * F.col("value")) for a in names]).alias("y"))

    @F.pandas_udf("array<double>")
    def solve(a: pd.Series, y: pd.Series) -> pd.Series:
        n = len(names)
        return pd.Series([np.linalg.lstsq(np.array(m).reshape(n, n), np.array(v), rcond=1e-12)[0] for m, v in zip(a, y)])

    return sums.select(*keys, solve("a", "y").alias("coefficients"))


def rotation_from_coherency(xx: float, yy: float, xy: complex) -> np.ndarray:
    """Inverse of the root of a 2 by 2 coherency matrix of unit determinant; zeros if it is not positive."""
    c = np.array([[xx, xy], [np.conj(xy), yy]])
    w, v = np.linalg.eigh(c)
    if (w <= 0).any():
        return np.zeros((2, 2), complex)
    w = w / math.sqrt(w.prod())
    return (v / np.sqrt(w)) @ v.conj().T


def source_spectrum(freq_mhz: Column, coefficients: list[float], gain: float = 2.0) -> Column:
    """Flux of a calibrator as a polynomial of the log of frequency (GHz), times the gain in K/Jy."""
    x, out = F.log10(freq_mhz / 1000), F.lit(0.0)
    for k, c in enumerate(coefficients):
        out = out + c * x**k
    return F.pow(F.lit(10.0), out) * gain


def cross_given_auto(signal: DataFrame, cross: DataFrame, grid: DataFrame, keys: list[str]) -> DataFrame:
    """Log likelihood of each signal amplitude ``x`` of a short grid from a cross power (value, error, model) whose correlation is unknown between 0 and 1: the mean over ``r`` of a short table."""
    chi = (F.col("value") - F.col("r") * F.col("x") * F.col("model")) / F.col("error")
    j = cross.crossJoin(F.broadcast(grid)).crossJoin(F.broadcast(signal))
    each = j.groupBy(*keys, "x", "r").agg(F.sum(-0.5 * chi * chi).alias("l"))
    return each.groupBy(*keys, "x").agg(F.log(F.avg(F.exp("l"))).alias("loglike"))


def auto_signal_likelihood(points: DataFrame, grid: DataFrame, keys: list[str]) -> DataFrame:
    """Log likelihood of signal amplitudes from two auto powers that bound the signal from above: the product of both survival probabilities in every bin."""
    low = lambda k: F.log(F.greatest(1 - survival(F.col("x") * F.col("model"), F.col(f"auto{k}"), F.col(f"error{k}")), F.lit(1e-300)))
    return points.crossJoin(F.broadcast(grid)).groupBy(*keys, "x").agg(F.sum(low(1) + low(2)).alias("loglike"))


def simpson_normalised(table: DataFrame, keys: list[str], x: str = "x", p: str = "p") -> DataFrame:
    """A density over its integral by Simpson's rule on an odd number of equal steps' points."""
    w = Window.partitionBy(*keys).orderBy(x)
    whole = Window.partitionBy(*keys)
    i, n = F.row_number().over(w), F.count("*").over(whole)
    rows = table.withColumn("_i", i).withColumn("_n", n).withColumn("_h", (F.max(x).over(whole) - F.min(x).over(whole)) / (n - 1))
    odd = F.when(F.col("_n") % 2 == 0, F.raise_error(F.lit("Simpson's rule needs an odd number of points")).cast("double")).otherwise(1.0)
    factor = F.when((F.col("_i") == 1) | (F.col("_i") == F.col("_n")), 1.0).when(F.col("_i") % 2 == 0, 4.0).otherwise(2.0)
    total = F.sum(F.col(p) * factor * F.col("_h") / 3 * odd).over(whole)
    return rows.withColumn(p, F.try_divide(F.col(p), total)).drop("_i", "_n", "_h")


def mueller_fit(rows: DataFrame, keys: list[str], model: list[Column]) -> DataFrame:
    """The 4 by 4 matrix of each channel that takes the source's polarisation (I, Q, U, V as ``model``) to the measured one: four least-squares fits from sums of products.

    Rows hold the on-less-off medians of each pointing: keys, pol (0 to 3), value. Returns keys, m (four arrays of four).
    """
    fits = linear_fit(rows, [*keys, "pol"], model)
    return fits.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("pol", "coefficients"))), lambda x: x["coefficients"]).alias("m"))


def on_off_medians(rows: DataFrame, keys: list[str], on: Column) -> DataFrame:
    """Median on the source less that off it."""
    return rows.groupBy(*keys).agg((F.median(F.when(on, F.col("value"))) - F.median(F.when(~on, F.col("value")))).alias("value"))


def differential_gains(rows: DataFrame, keys: list[str], flux: Column) -> DataFrame:
    """Gains of XX and YY of each channel: source flux over measured on-less-off."""
    g = lambda p: F.try_divide(F.avg(F.when(F.col("pol") == p, flux)), F.avg(F.when(F.col("pol") == p, F.col("value"))))
    return rows.groupBy(*keys).agg(g("XX").alias("gx"), g("YY").alias("gy"))


def scan_weights(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``weight``, 1 / system temperature of the (keys) scan; negative powers are masked."""
    w = Window.partitionBy(*keys)
    kept = F.when(F.col("value") >= 0, F.col("value"))
    return rows.withColumn("value", kept).withColumn("weight", F.try_divide(F.lit(1.0), F.avg(kept).over(w)))


def bright_passages(rows: DataFrame, keys: list[str], reach: int, t: str = "t") -> DataFrame:
    """Mean within ``reach`` of each key's brightest time less the mean within ``reach`` of its faintest: the passage of a bright source through the beam."""
    ends = rows.where("value is not null").groupBy(*keys).agg(F.max_by(t, "value").alias("_on"), F.min_by(t, "value").alias("_off"))
    near = lambda c: F.avg(F.when(F.abs(F.col(t) - F.col(c)) <= reach, F.col("value")))
    return rows.join(ends, keys).groupBy(*keys).agg((near("_on") - near("_off")).alias("value"))


def subtract_correlation_modes(corr: DataFrame, modes: DataFrame) -> DataFrame:
    """A correlation (f1, f2, lag, corr) less its parts along modes (mode, chan, v) of channels, for each lag: C - sum of a v v'."""
    left, right = modes.select("mode", F.col("chan").alias("f1"), F.col("v").alias("_v")), modes.select("mode", F.col("chan").alias("f2"), F.col("v").alias("_u"))
    amp = corr.join(left, "f1").join(right, ["mode", "f2"]).groupBy("lag", "mode").agg(F.sum(F.col("corr") * F.col("_v") * F.col("_u")).alias("_a"))
    part = amp.join(left, "mode").join(right, "mode").groupBy("lag", "f1", "f2").agg(F.sum(F.col("_a") * F.col("_v") * F.col("_u")).alias("_p"))
    return corr.join(part, ["lag", "f1", "f2"], "left").withColumn("corr", F.col("corr") - F.coalesce("_p", F.lit(0.0))).drop("_p")


def diagonal_amplitude(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Amplitude of a template (value, theory, variance) with its error, chi squared and degrees of freedom, where errors do not correlate: sums only."""
    t, d, v = F.col("theory"), F.col("value"), F.col("variance")
    ok = rows.where(v > 0)
    sums = ok.groupBy(*keys).agg(F.sum(t * d / v).alias("a"), F.sum(t * t / v).alias("b"), F.sum(d * d / v).alias("c"), F.count("*").alias("n"))
    amp = F.try_divide("a", "b")
    return sums.select(*keys, amp.alias("amplitude"), (1 / F.sqrt("b")).alias("error"), (F.col("c") - amp * F.col("a")).alias("chi2"), (F.col("n") - 1).alias("dof"))
