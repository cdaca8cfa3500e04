"""Power spectra: transforms of cubes, bins in one and two dimensions, transfer functions, statistics over pairs and simulations."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyquilt.functions.columns import edge_bucket


def window_nd(shape: tuple[int, ...], axes: tuple[int, ...] | None = None, name: str = "blackman") -> np.ndarray:
    """Product of one-dimensional windows over the chosen axes (all by default)."""
    make = {"blackman": np.blackman, "hanning": np.hanning, "hamming": np.hamming, "none": np.ones}[name]
    out = np.ones(shape)
    for k, n in enumerate(shape):
        if axes is None or k in axes:
            out = out * make(n).reshape([-1 if i == k else 1 for i in range(len(shape))])
    return out


def wave_numbers(shape: tuple[int, ...], spacing: tuple[float, ...]) -> list[np.ndarray]:
    return np.meshgrid(*[2 * np.pi * np.fft.fftfreq(n, d) for n, d in zip(shape, spacing)], indexing="ij")


def cross_power(a: np.ndarray, b: np.ndarray, wa: np.ndarray, wb: np.ndarray, spacing: tuple[float, ...], window_axes: tuple[int, ...] | None = (0,), name: str = "blackman") -> np.ndarray:
    """Weighted cross power of two cubes, over the sum of the product of their weights, times the voxel volume."""
    win = window_nd(a.shape, window_axes, name)
    wa, wb = wa * win, wb * win
    f = np.fft.fftn(a * wa) * np.conj(np.fft.fftn(b * wb))
    norm = (wa * wb).sum()
    return (f.real / norm if norm else np.zeros_like(f.real)) * math.prod(spacing)


def pair_spectra(left: DataFrame, right: DataFrame, keys: list[str], shape: tuple[int, int, int], spacing: tuple[float, float, float], window_axes: tuple[int, ...] | None = (0,)) -> DataFrame:
    """(keys, kperp, kpar, k, power) of every cell of each pair's cubes: a pair is one task, its cubes have the bounded size ``shape``."""
    kf, kr, kd = wave_numbers(shape, spacing)
    kinds = ", ".join(f"{k} {left.schema[k].dataType.simpleString()}" for k in keys)

    def cube(pdf: pd.DataFrame, column: str, tail: str = "") -> np.ndarray:
        out = np.zeros(shape)
        out[tuple(pdf[a + tail] for a in ("fi", "ri", "di"))] = pdf[column + tail].fillna(0)
        return out

    def run(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        p = cross_power(cube(a, "value"), cube(b, "value", "_2"), cube(a, "weight"), cube(b, "weight", "_2"), spacing, window_axes)
        out = pd.DataFrame({"kperp": np.hypot(kr, kd).ravel(), "kpar": np.abs(kf).ravel(), "k": np.sqrt(kf**2 + kr**2 + kd**2).ravel(), "power": p.ravel()})
        for k, v in zip(keys, key):
            out[k] = v
        return out[[*keys, "kperp", "kpar", "k", "power"]]

    other = right.select(*[F.col(k).alias(k) for k in keys], *[F.col(c).alias(f"{c}_2") for c in ("fi", "ri", "di", "value", "weight")])
    return left.select(*keys, "fi", "ri", "di", "value", "weight").groupBy(*keys).cogroup(other.groupBy(*keys)).applyInPandas(run, f"{kinds}, kperp double, kpar double, k double, power double")


def unitless(power: Column, k: Column, ndim: int = 3) -> Column:
    """Power times the volume of a shell: k^n 2 pi^(n/2) / gamma(n/2) / (2 pi)^n."""
    return power * F.pow(k, F.lit(float(ndim))) * (2 * math.pi ** (ndim / 2) / math.gamma(ndim / 2) / (2 * math.pi) ** ndim)


def radial_bins(cells: DataFrame, keys: list[str], edges: list[float], k: str = "k", value: str = "power") -> DataFrame:
    """Mean and count of cells in bins of radius; the last edge counts in."""
    return cells.withColumn("bin", edge_bucket(F.col(k), edges, closed=True)).dropna(subset=["bin"]).groupBy(*keys, "bin").agg(F.avg(value).alias(value), F.count("*").alias("counts"))


def bins_2d(cells: DataFrame, keys: list[str], perp: list[float], par: list[float], value: str = "power") -> DataFrame:
    at = cells.withColumn("bx", edge_bucket(F.col("kperp"), perp, closed=True)).withColumn("by", edge_bucket(F.col("kpar"), par, closed=True))
    return at.dropna(subset=["bx", "by"]).groupBy(*keys, "bx", "by").agg(F.avg(value).alias(value), F.count("*").alias("counts"))


def collapse_2d(power: DataFrame, keys: list[str], edges: list[float], weight: str = "counts") -> DataFrame:
    """Two-dimensional bins (kx, ky centres) to one dimension: weighted mean, counts, and the error 1/sqrt(sum of weights)."""
    k = F.sqrt(F.col("kx") ** 2 + F.col("ky") ** 2)
    ok = power.where((F.col("counts") > 0) & F.col("power").isNotNull()).withColumn("bin", edge_bucket(k, edges, closed=True)).dropna(subset=["bin"])
    return ok.groupBy(*keys, "bin").agg(F.try_divide(F.sum(F.col("power") * F.col(weight)), F.sum(weight)).alias("power"), F.sum("counts").alias("counts"), F.try_divide(F.lit(1.0), F.sqrt(F.sum(weight))).alias("error"))


def statistics(trials: DataFrame, keys: list[str], value: str = "power") -> DataFrame:
    """Mean and sample deviation over trials, of finite values."""
    ok = F.when(~F.isnan(value), F.col(value))
    return trials.groupBy(*keys).agg(F.avg(ok).alias("mean"), F.stddev_samp(ok).alias("std"), F.count(ok).alias("n"))


def covariance(trials: DataFrame, keys: list[str], trial: str, bin_: str = "bin", value: str = "power") -> DataFrame:
    """Sample covariance and correlation of bins over trials. A trial's few bins are paired within its row."""
    wide = trials.where(F.col(value).isNotNull()).groupBy(*keys, trial).agg(F.collect_list(F.struct(F.col(bin_).alias("b"), F.col(value).cast("double").alias("v"))).alias("s"))
    pair = wide.select(*keys, "s", F.explode("s").alias("x")).select(*keys, "x", F.explode("s").alias("y"))
    return pair.groupBy(*keys, F.col("x.b").alias("bin"), F.col("y.b").alias("bin2")).agg(F.covar_samp("x.v", "y.v").alias("cov"), F.corr("x.v", "y.v").alias("corr"))


def transfer_function(out: DataFrame, ref: DataFrame, keys: list[str], multiplier: float = 1.0, square: bool = False) -> DataFrame:
    """Power out over power in, 0 without counts, between 0 and 1."""
    j = out.select(*keys, F.col("power").alias("po"), F.col("counts").alias("co")).join(ref.select(*keys, F.col("power").alias("pi")), keys)
    t = F.when(F.col("co") > 0, F.coalesce(F.try_divide("po", F.col("pi") * multiplier), F.lit(0.0))).otherwise(0.0)
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return j.select(*keys, (t * t if square else t).alias("transfer"))


def apply_transfer(power: DataFrame, transfer: DataFrame, keys: list[str]) -> DataFrame:
    """Power over transfer, counts times its square; both 0 where the transfer or the counts are."""
    j = power.join(transfer, keys, "left")
    p = F.coalesce(F.try_divide("power", "transfer"), F.lit(0.0))
    ok = (F.col("counts") > 0) & (F.col("transfer") > 0)
    return j.withColumn("power", F.when(ok, p).otherwise(0.0)).withColumn("counts", F.when(ok, F.col("counts") * F.col("transfer") ** 2).otherwise(0.0)).drop("transfer")


def noise_weight(auto: DataFrame, keys: list[str], transfer: DataFrame | None = None) -> DataFrame:
    """counts / mean^2, times the square of a transfer function; 0 where undefined."""
    j = auto if transfer is None else auto.join(transfer, keys)
    w = F.abs(F.try_divide(F.col("counts").cast("double"), F.col("mean") * F.col("mean")))
    if transfer is not None:
        w = w * F.col("transfer") ** 2
    return j.select(*keys, F.coalesce(w, F.lit(0.0)).alias("weight"))


def cross_signal_error(x: Column, a: Column) -> Column:
    """Variance of a cross power from those of cross and auto power."""
    return F.lit(7 / 6) * x * x + F.lit(2 / 3) * x * a + F.lit(1 / 6) * a * a


def azimuthal_average(cells: DataFrame, keys: list[str], axes: list[str], centre: list[float], width: float, value: str = "value") -> DataFrame:
    """Mean in rings of ``width`` about a centre, in any number of axes."""
    r2 = F.lit(0.0)
    for a, c in zip(axes, centre):
        r2 = r2 + (F.col(a) - F.lit(float(c))) ** 2
    return cells.groupBy(*keys, F.floor(F.sqrt(r2) / width).cast("int").alias("ring")).agg(F.avg(value).alias("mean"), F.count("*").alias("n"))


def log_bins(power: DataFrame, keys: list[str], index: str = "i", ratio: float = 2.0) -> DataFrame:
    """Mean in bins of index that grow by ``ratio``."""
    return power.where(F.col(index) > 0).groupBy(*keys, F.floor(F.log(F.col(index)) / math.log(ratio) + 1e-12).cast("int").alias("bin")).agg(F.avg("power").alias("power"), F.count("*").alias("n"))


def series_power(rows: DataFrame, keys: list[str], n: int, deconvolve: bool = True, dt: float = 1.0) -> DataFrame:
    """Power of each stream (slot, value, mask) of ``n`` slots; with ``deconvolve`` the mask's power is divided out in lags. One stream is one task's group of bounded size."""
    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        v, m = np.zeros(n), np.zeros(n)
        v[pdf["slot"]], m[pdf["slot"]] = pdf["value"] * pdf["mask"], pdf["mask"]
        p = windowed_power(v, m) if deconvolve else np.abs(np.fft.fft(v)) ** 2 / n
        half = n // 2
        out = pd.DataFrame({"i": np.arange(half), "freq": np.arange(half) / (dt * n), "power": p.real[:half] * dt})
        for k in keys:
            out[k] = pdf[k].iloc[0]
        return out[[*keys, "i", "freq", "power"]]

    return rows.groupBy(*keys).applyInPandas(run, f"{kinds}, i int, freq double, power double")


def windowed_power(v: np.ndarray, w: np.ndarray, v2: np.ndarray | None = None, w2: np.ndarray | None = None) -> np.ndarray:
    """Power of windowed data over that of the window, as functions of lag; lags without weight give 0."""
    v2, w2 = (v if v2 is None else v2), (w if w2 is None else w2)
    n = len(v)
    data = np.fft.ifft(np.fft.fft(v) * np.conj(np.fft.fft(v2)) / n)
    win = np.fft.ifft(np.fft.fft(w) * np.conj(np.fft.fft(w2)) / n)
    return np.fft.fft(np.where(np.abs(win) > 1e-9 * np.abs(win).max(), data / np.where(win == 0, 1, win), 0))


def over_f_spectrum(amp: float, index: float, f0: float, dt: float, n: int, cut: float = 0.0) -> np.ndarray:
    """amp (f / f0)^index at the frequencies of n samples; below ``cut`` (at least the lowest step) it is flat."""
    f = np.abs(np.fft.fftfreq(n, dt))
    return amp * (np.maximum(f, max(cut, 1 / (dt * n))) / f0) ** index


def mixing_matrix(weights: np.ndarray, bin_of_cell: np.ndarray, n: int) -> np.ndarray:
    """How power in one bin appears in others through a cube's weights: the window's power, moved to each bin's cells and averaged in bins."""
    win = np.abs(np.fft.fftn(weights)) ** 2
    win_f = np.fft.fftn(win / win.sum())
    out = np.zeros((n, n))
    for b in range(n):
        cells = (bin_of_cell == b).astype(float)
        if cells.any():
            spread = np.fft.ifftn(np.fft.fftn(cells) * win_f).real
            for a in range(n):
                hit = bin_of_cell == a
                out[a, b] = spread[hit].mean() if hit.any() else 0.0
    return out


def pivot_combinations(power: DataFrame, keys: list[str], combinations: list[str]) -> DataFrame:
    """One column of power for each combination."""
    return power.groupBy(*keys).pivot("combination", combinations).agg(F.first("power"))


def ranked_bins(power: DataFrame, keys: list[str]) -> DataFrame:
    return power.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("power"))))


def subtract_power(total: DataFrame, part: DataFrame, keys: list[str]) -> DataFrame:
    """Power of one spectrum less that of another in the same bins."""
    return total.join(part.select(*keys, F.col("power").alias("_p")), keys).withColumn("power", F.col("power") - F.col("_p")).drop("_p")


def mock_weights(mocks: DataFrame, keys: list[str]) -> DataFrame:
    """Inverse variance of each bin over mock catalogs; 0 where it is undefined."""
    return mocks.groupBy(*keys).agg(F.coalesce(F.try_divide(F.lit(1.0), F.var_samp("power")), F.lit(0.0)).alias("weight"))


def cross_power_summary(power: DataFrame, mocks: DataFrame, keys: list[str], edges: list[float], transfer: DataFrame | None = None) -> DataFrame:
    """A catalog-map cross power in one dimension: transfer functions are divided out, bins (bx, by with centres kx, ky) weighted by the mocks' inverse variance."""
    done = power if transfer is None else apply_transfer(power, transfer, ["bx", "by"])
    weighted = done.join(mock_weights(mocks, ["bx", "by"]), ["bx", "by"])
    return collapse_2d(weighted, keys, edges, "weight")


def simulation_summary(sims: DataFrame, keys: list[str], k_range: tuple[float, float], transfer: DataFrame | None = None, less: DataFrame | None = None) -> DataFrame:
    """All realisations (sim_id, treatment, bins) within a range of k, less another set and over a transfer function where they are given."""
    out = sims.where((F.col("k") >= k_range[0]) & (F.col("k") < k_range[1]))
    if less is not None:
        out = subtract_power(out, less, [*keys, "sim_id"])
    return out if transfer is None else apply_transfer(out, transfer, keys)


def mean_diagonal(matrix: DataFrame, keys: list[str]) -> DataFrame:
    return matrix.where("chan = chan2").groupBy(*keys).agg(F.avg("cov").alias("mean"))


def pseudo_inverse(mixing: DataFrame, least: float = 1e-10) -> DataFrame:
    """Pseudo-inverse of a mixing matrix (row, col, value) over the bins that have entries: (row, col, value). The matrix has as many rows as bins."""
    pdf = mixing.where("value <> 0").toPandas()
    side = sorted(set(pdf["row"]) | set(pdf["col"]))
    if len(side) > 4096:
        raise ValueError("too many bins")
    at = {b: i for i, b in enumerate(side)}
    a = np.zeros((len(side), len(side)))
    a[pdf["row"].map(at).to_numpy(int), pdf["col"].map(at).to_numpy(int)] = pdf["value"]
    inverse = np.linalg.pinv(a, rcond=least)
    return mixing.sparkSession.createDataFrame([(side[i], side[j], float(inverse[i, j])) for i in range(len(side)) for j in range(len(side))], "row int, col int, value double")


def unmix(power: DataFrame, inverse: DataFrame, keys: list[str]) -> DataFrame:
    """Power in bins with their mixing undone."""
    j = power.join(inverse.select("row", F.col("col").alias("bin"), F.col("value").alias("_v")), "bin")
    return j.groupBy(*keys, F.col("row").alias("bin")).agg(F.sum(F.col("power") * F.col("_v")).alias("power"))


def lag_product(power: DataFrame, window: DataFrame, keys: list[str], n: int, divide: bool = False) -> DataFrame:
    """Power (keys, i of n) convolved with a window's power, or with ``divide`` deconvolved: a product, or ratio, in lags. Three sums over pairs of (frequency, lag) of a bounded n."""

    def transform(rows: DataFrame, out: str, by: str, scale: float) -> DataFrame:
        spread = rows.withColumn(out, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        return spread.groupBy(*keys, out).agg((F.sum(F.col("power") * F.cos(F.col(by) * F.col(out) * (2 * math.pi / n))) * scale).alias("power"))

    a, b = (transform(x, "lag", "i", 1 / n) for x in (power, window))
    j = a.join(b.withColumnRenamed("power", "_w"), [*keys, "lag"])
    v = F.try_divide("power", F.when(F.abs("_w") > 1e-9, F.col("_w"))) if divide else F.col("power") * F.col("_w")
    return transform(j.withColumn("power", F.coalesce(v, F.lit(0.0))), "i", "lag", 1.0)
