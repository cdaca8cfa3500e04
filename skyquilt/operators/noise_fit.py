"""1/f noise of masked streams: modes over channels found and taken out one after the other, their spectra fitted through the mask's own window.

Streams are rows (keys, chan, t, value); keys are files and polarisations, measured all at once. Sums over samples are
aggregates; what a task holds is one key's channel matrix, or one mode's spectrum of ``n_time`` frequencies.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .factor import eigen_blocks
from .noise import low_power_matrix

#: Samples of a stream, or channels, that one task may transform or decompose.
MOST_TIMES, MOST_CHANNELS = 1 << 20, 4096
#: Rounds of weights of a fit, steps of each, and the flattest slope that it may find.
WEIGHT_ROUNDS, STEPS, LEAST_SLOPE = 5, 60, 0.3
#: Share of a channel's samples below which it has no data, and the variance that stands for none.
NO_DATA_TIMES, NO_DATA = 10, 1e4


def frequencies(n: int, dt: float) -> np.ndarray:
    """|f| of n samples; that of the mean is the lowest other."""
    f = np.abs(np.fft.fftfreq(n, dt))
    f[0] = 1 / (n * dt)
    return f


def windowed(spectrum: np.ndarray, window: np.ndarray) -> np.ndarray:
    """What a spectrum looks like through a window of that power: their convolution, by products in lags."""
    return np.fft.ifft(np.fft.fft(spectrum) * np.fft.fft(window)).real


def fit_windowed(power: np.ndarray, window: np.ndarray, dt: float, f0: float) -> tuple[float, float, float, float]:
    """amplitude, index, thermal level and mean squared relative residual of amp (f / f0)^index + thermal seen through ``window``.

    Damped least squares in the logs of all three, each residual over what the last two rounds' models say (first what was
    measured), so that loud frequencies do not decide alone and quiet ones by chance do not either. The mean's own frequency is left out.
    """
    n = len(power)
    f = frequencies(n, dt)
    use = np.arange(1, n // 2)
    norm = max(window.sum(), 1e-300)
    level = lambda x: np.log(max(float(np.mean(x)) / norm, 1e-300))
    low = use[: max(3, len(use) // 20)]
    x = np.array([level(power[low] * f[low] / f0), 0.0, level(power[use[-max(3, len(use) // 5) :]])])

    def model(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        slope = LEAST_SLOPE + np.exp(x[1])
        steep, flat = np.exp(x[0]) * (f / f0) ** -slope, np.full(n, np.exp(x[2]))
        parts = [steep, -steep * np.log(f / f0) * np.exp(x[1]), flat]
        seen = [windowed(p, window)[use] for p in parts]
        return seen[0] + seen[2], np.stack(seen, 1)

    now, jac = model(x)
    x[[0, 2]] += np.log(max(power[use].sum(), 1e-300) / max(now.sum(), 1e-300))
    now, jac = model(x)
    before = power[use]
    for _ in range(WEIGHT_ROUNDS):
        damp, weight, before = 1e-3, before + now, now
        for _ in range(STEPS):
            r, j = (power[use] - now) / weight, jac / weight[:, None]
            h = j.T @ j
            step = np.linalg.lstsq(h + damp * np.diag(np.diag(h) + 1e-12), j.T @ r, rcond=None)[0]
            new, slopes = model(x + np.clip(step, -1, 1))
            if (((power[use] - new) / weight) ** 2).sum() < (r**2).sum():
                x, now, jac, damp = x + np.clip(step, -1, 1), new, slopes, max(damp / 5, 1e-12)
                if np.abs(step).max() < 1e-10:
                    break
            else:
                damp *= 5
                if damp > 1e8:
                    break
    return float(np.exp(x[0])), float(-LEAST_SLOPE - np.exp(x[1])), float(np.exp(x[2])), float((((power[use] - now) / now) ** 2).mean())


def window_power(series: DataFrame, keys: list[str], n_time: int, dt: float) -> DataFrame:
    """(keys, i, freq, power, window): power of value times mask and of the mask, from (keys, slot, value, mask); slots are 0 to ``n_time`` - 1, missing ones are masked.

    Both are per sample: through a mask of ones, white noise of variance v has the power 2 v dt at all frequencies.
    """
    if n_time > MOST_TIMES:
        raise ValueError("the stream is too long for one task")
    kinds = ", ".join(f"{k} {series.schema[k].dataType.simpleString()}" for k in keys)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x, w = np.zeros(n_time), np.zeros(n_time)
        slot = pdf["slot"].to_numpy()
        w[slot] = np.where(pdf["value"].isna(), 0, pdf["mask"])
        x[slot] = pdf["value"].fillna(0) * w[slot]
        out = pd.DataFrame({"i": np.arange(n_time), "freq": np.fft.fftfreq(n_time, dt), "power": np.abs(np.fft.fft(x)) ** 2 / n_time * 2 * dt, "window": np.abs(np.fft.fft(w)) ** 2 / n_time**2})
        for k, v in zip(keys, key):
            out[k] = v
        return out[[*keys, "i", "freq", "power", "window"]]

    return series.groupBy(*keys).applyInPandas(run, f"{kinds}, i int, freq double, power double, window double")


def fit_windows(power: DataFrame, keys: list[str], dt: float, f0: float) -> DataFrame:
    """(keys, amplitude, index, thermal, misfit) from ``window_power``; a key is one spectrum."""
    kinds = ", ".join(f"{k} {power.schema[k].dataType.simpleString()}" for k in keys)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        found = fit_windowed(pdf["power"].to_numpy(float), pdf["window"].to_numpy(float), dt, f0)
        return pd.DataFrame([(*key, *found)], columns=[*keys, "amplitude", "index", "thermal", "misfit"])

    return power.groupBy(*keys).applyInPandas(run, f"{kinds}, amplitude double, index double, thermal double, misfit double")


def measure_modes(stage: Callable[[DataFrame], DataFrame], rows: DataFrame, keys: list[str], n_time: int, n_freq: int, n_modes: int, dt: float, f0: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Modes, their noise and what is left of the streams of every key.

    Again and again the channel vector with most power in the lowest ``n_freq`` frequencies is found, its amplitude at
    each time is that of all channels with data then, its spectrum is fitted through the window that the missing
    channels leave, and it is taken out of the streams. Returns (keys, mode, chan, v), (keys, mode, amplitude, index,
    thermal, misfit) and (keys, chan, var, low): the variance that is left of each channel (NO_DATA for those with
    less than NO_DATA_TIMES samples) and its power in the lowest frequencies over that of white noise of the variance.
    """
    left, vectors, fits = stage(rows.select(*keys, "chan", "t", "value")), None, None
    for mode in range(n_modes):
        matrix = low_power_matrix(left, keys, n_time, n_freq)
        entries = matrix.select(*keys, F.dense_rank().over(_by(keys, "chan")).alias("row"), F.dense_rank().over(_by(keys, "chan2")).alias("col"), "chan", F.col("cov").alias("value"))
        entries = stage(entries)
        names = entries.select(*keys, (F.col("row") - 1).alias("k"), "chan").distinct()
        first = eigen_blocks(entries.select(*keys, "row", "col", "value"), keys).where("mode = 0").select(*keys, F.posexplode("vector").alias("k", "v"))
        vector = stage(first.join(names, [*keys, "k"]).select(*keys, F.lit(mode).alias("mode"), "chan", "v"))
        seen = left.where("value is not null").join(vector.drop("mode"), [*keys, "chan"])
        amp = stage(seen.groupBy(*keys, "t").agg(F.try_divide(F.sum(F.col("v") * F.col("value")), F.sum(F.col("v") ** 2)).alias("a"), F.sum(F.col("v") ** 2).alias("mask")))
        series = amp.select(*keys, F.lit(mode).alias("mode"), F.col("t").cast("int").alias("slot"), F.col("a").alias("value"), "mask")
        fit = stage(fit_windows(window_power(series, [*keys, "mode"], n_time, dt), [*keys, "mode"], dt, f0))
        rest = left.join(vector.drop("mode"), [*keys, "chan"], "left").join(amp.select(*keys, "t", "a"), [*keys, "t"], "left")
        left = stage(rest.select(*keys, "chan", "t", (F.col("value") - F.coalesce(F.col("v") * F.col("a"), F.lit(0.0))).alias("value")))
        vectors = vector if vectors is None else vectors.unionByName(vector)
        fits = fit if fits is None else fits.unionByName(fit)
    few = F.count("value") < NO_DATA_TIMES
    var = left.groupBy(*keys, "chan").agg(F.when(few, NO_DATA).otherwise(F.var_pop("value")).alias("var"), F.count("value").alias("_n"))
    low = low_power_matrix(left, keys, n_time, n_freq).where("chan = chan2").select(*keys, "chan", F.col("cov").alias("_low"))
    channels = var.join(low, [*keys, "chan"], "left").select(*keys, "chan", "var", F.try_divide(F.col("_low") * n_time, F.col("var") * F.col("_n")).alias("low"))
    return vectors, fits, channels


def _by(keys: list[str], chan: str):
    from pyspark.sql import Window

    return Window.partitionBy(*keys).orderBy(chan)
