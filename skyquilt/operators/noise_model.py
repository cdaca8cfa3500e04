"""Noise models of map-making: thermal noise, masks, deweighted time and frequency modes, 1/f noise on modes.

Samples are rows (keys, scan, chan, t, p, value, var). Modes that act alone are sums over the samples and need no
task to hold a stream (``deweight_time``, ``deweight_frequency``). Modes that act together are solved scan by scan
(``weight_stream``); a scan is a block of bounded length.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lookup import small
from .spectra import over_f_spectrum

#: Variance that stands for infinity, that of modes to be ignored, and the least one that is believed.
INFINITE, HUGE, SMALL = 1e4, 1e4, 1e-10


def thermal_weights(samples: DataFrame, least: float = SMALL) -> DataFrame:
    """Adds ``w``, the inverse variance: none for masked samples, an error below ``least``."""
    low = F.raise_error(F.lit("thermal noise is too small")).cast("double")
    return samples.withColumn("w", F.when(F.col("value").isNull(), 0.0).otherwise(F.when(F.col("var") < least, low).otherwise(1 / F.col("var"))))


def no_data_variance(channels: DataFrame, norm: str, n_time: int, variance: str = "var") -> DataFrame:
    """Channels with too little data get the variance that stands for infinity."""
    return channels.withColumn(variance, F.when(F.col(norm) < 10 / n_time, INFINITE).otherwise(F.col(variance)))


def noise_parameters(samples: DataFrame, table: DataFrame, keys: list[str], floor: Column, default: float = INFINITE) -> DataFrame:
    """Adds ``var`` from the noise table (keys, var), no lower than ``floor``; keys that it lacks get ``default``."""
    return samples.join(table.select(*keys, F.col("var").alias("_var")), keys, "left").withColumn("var", F.greatest(F.coalesce("_var", F.lit(default)), floor)).drop("_var")


def deweight_time(samples: DataFrame, keys: list[str], slope: bool = True, big: float = HUGE) -> DataFrame:
    """Adds ``nd``, the stream over its noise where each (keys, scan) has an unknown mean, and slope.

    The modes are orthonormal over the samples with data, so N is diag(var) + big * (u0 u0' + u1 u1'); its
    inverse needs five sums for each scan. Also adds w, u0, u1 and the inverse core c00, c01, c11.
    """
    by = [*keys, "scan"]
    has = F.col("w") > 0
    rows = thermal_weights(samples)
    stats = rows.where(has).groupBy(*by).agg(F.count("*").alias("_n"), F.avg("t").alias("_m"), (F.var_pop("t") * F.count("*")).alias("_s"))
    rows = rows.join(stats, by, "left")
    u0 = F.when(has, 1 / F.sqrt("_n")).otherwise(0.0)
    u1 = F.when(has & (F.col("_s") > 0), (F.col("t") - F.col("_m")) / F.sqrt("_s")).otherwise(0.0) if slope else F.lit(0.0)
    rows = rows.withColumn("u0", u0).withColumn("u1", u1).drop("_n", "_m", "_s")
    w, d = F.col("w"), F.coalesce("value", F.lit(0.0))
    sums = {"g00": w * F.col("u0") ** 2, "g01": w * F.col("u0") * F.col("u1"), "g11": w * F.col("u1") ** 2, "m0": w * F.col("u0") * d, "m1": w * F.col("u1") * d}
    core = rows.groupBy(*by).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    a, b, c = F.col("g00") + 1 / big, F.col("g01"), F.col("g11") + 1 / big
    det = a * c - b * b
    core = core.select(*by, (c / det).alias("c00"), (-b / det).alias("c01"), (a / det).alias("c11"), "m0", "m1")
    rows = rows.join(core, by)
    fit = F.col("u0") * (F.col("c00") * F.col("m0") + F.col("c01") * F.col("m1")) + F.col("u1") * (F.col("c01") * F.col("m0") + F.col("c11") * F.col("m1"))
    return rows.withColumn("nd", w * (d - fit)).drop("m0", "m1")


def dirty_and_inverse(weighted: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Dirty map (keys, p, dirty) and inverse covariance (keys, p, q, value) of streams from ``deweight_time``.

    A scan's pixels are summed first, then paired within the scan: what is paired are the pixels that one
    scan crosses, not samples.
    """
    by = [*keys, "scan"]
    dirty = weighted.groupBy(*keys, "p").agg(F.sum("nd").alias("dirty"))
    diagonal = weighted.groupBy(*keys, "p").agg(F.sum("w").alias("value")).select(*keys, "p", F.col("p").alias("q"), "value")
    pix = weighted.groupBy(*by, "p").agg(F.sum(F.col("w") * F.col("u0")).alias("a0"), F.sum(F.col("w") * F.col("u1")).alias("a1"), *[F.first(c).alias(c) for c in ("c00", "c01", "c11")])
    scans = pix.groupBy(*by).agg(F.collect_list(F.struct("p", "a0", "a1")).alias("s"), *[F.first(c).alias(c) for c in ("c00", "c01", "c11")])
    cores = ["c00", "c01", "c11"]
    pair = scans.select(*keys, *cores, "s", F.explode("s").alias("x")).select(*keys, *cores, "x", F.explode("s").alias("y"))
    update = F.col("x.a0") * (F.col("c00") * F.col("y.a0") + F.col("c01") * F.col("y.a1")) + F.col("x.a1") * (F.col("c01") * F.col("y.a0") + F.col("c11") * F.col("y.a1"))
    both = pair.select(*keys, F.col("x.p").alias("p"), F.col("y.p").alias("q"), (-update).alias("value")).unionByName(diagonal)
    return dirty, both.groupBy(*keys, "p", "q").agg(F.sum("value").alias("value"))


def deweight_frequency(samples: DataFrame, keys: list[str], mode: DataFrame, big: float = HUGE) -> DataFrame:
    """Adds ``nd`` where one mode over channels (chan, f) has an unknown amplitude at every time of a scan: two sums for each time."""
    by = [*keys, "scan", "t"]
    rows = thermal_weights(samples).join(small(mode), "chan")
    w, d, f = F.col("w"), F.coalesce("value", F.lit(0.0)), F.col("f")
    sums = rows.groupBy(*by).agg(F.sum(w * f * d).alias("_m"), F.sum(w * f * f).alias("_g"))
    return rows.join(small(sums), by).withColumn("nd", w * (d - f * F.col("_m") / (F.col("_g") + 1 / big))).drop("_m", "_g")


def over_f_correlation(amp: float, index: float, f0: float, dt: float, n_lags: int) -> np.ndarray:
    """Correlation of 1/f noise at whole lags, from a spectrum 64 times as long; the power is flat below the length's own frequency."""
    n = 64 * n_lags
    return np.fft.ifft(over_f_spectrum(amp, index, f0, dt, n, 1 / (n_lags * dt))).real[:n_lags] / (2 * dt)


@dataclass
class NoiseModel:
    """What a scan's noise is made of besides thermal noise.

    ``time_modes``: 0, 1 (mean) or 2 (and slope) with unknown amplitude in every channel. ``frequency_modes``:
    vectors over channels, each with None (unknown at every time) or (amplitude, index, f0) of its 1/f noise.
    ``low``: (amplitude, index, f0) of slow noise that every channel has for itself, by sines and cosines
    below twice f0. ``common``: 1/f noise that all channels share.
    """

    dt: float = 1.0
    time_modes: int = 2
    frequency_modes: list[tuple[list[float], tuple[float, float, float] | None]] = field(default_factory=list)
    low: tuple[float, float, float] | None = None
    common: tuple[float, float, float] | None = None
    big: float = HUGE

    def __post_init__(self):
        for p in [x for _, x in self.frequency_modes] + [self.common]:
            if p and (p[1] < -3.5 or p[0] > HUGE):
                raise ValueError("the 1/f noise is too steep or too strong")

    def time_basis(self, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Modes over the scan's times and their variances."""
        x = t - t.mean()
        modes, var = [np.ones(len(t)), x][: self.time_modes], [self.big] * min(2, self.time_modes)
        if self.low:
            amp, index, f0 = self.low
            span = (np.ptp(t) + 1) * self.dt
            n = int(np.floor(2 * f0 * span))
            if 2 * n > 0.15 * len(t):
                raise ValueError("too many low modes for the scan")
            for k in range(1, n + 1):
                for f in (np.sin, np.cos):
                    modes.append(f(2 * np.pi * k * t * self.dt / span))
                    var.append(amp * (k / span / f0) ** index / (2 * self.dt))
        out = np.array([m / max(np.linalg.norm(m), 1e-300) for m in modes]).reshape(-1, len(t))
        return out, np.array(var)

    def covariances(self, t: np.ndarray, n_chan: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Vectors over channels with the time covariance of each one's amplitude."""
        out = [(np.asarray(v, float), p) for v, p in self.frequency_modes]
        if self.common:
            out.append((np.ones(n_chan), self.common))
        lag = np.abs(t[:, None] - t[None]).astype(int)
        return [(v, self.big * np.eye(len(t)) if p is None else over_f_correlation(*p, self.dt, int(lag.max()) + 1)[lag] + 1e-12 * np.eye(len(t))) for v, p in out]


def without_mean_and_slope(matrix: np.ndarray, t: np.ndarray) -> np.ndarray:
    """A time covariance with mean and slope projected out on both sides."""
    q = np.linalg.qr(np.stack([np.ones(len(t)), t - t.mean()], 1))[0]
    p = np.eye(len(t)) - q @ q.T
    return p @ matrix @ p


def scan_noise(model: NoiseModel, t: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Dense covariance of a scan, channels by times flattened: for tests and small scans. Masked samples have the variance INFINITE."""
    n_chan, n = w.shape
    out = np.diag(np.where(w > 0, 1 / np.where(w > 0, w, 1), INFINITE).ravel())
    u, var = model.time_basis(t)
    out = out + np.kron(np.eye(n_chan), (u.T * var) @ u)
    for v, s in model.covariances(t, n_chan):
        out = out + np.kron(np.outer(v, v), s)
    return out


def scan_core(model: NoiseModel, t: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Time modes (mode, t), frequency modes (mode, chan) and the matrix S^-1 + U' W U that joins all their amplitudes: those of every channel's time modes, then those of every frequency mode's times."""
    n_chan, n = w.shape
    u, var = model.time_basis(t)
    cov = model.covariances(t, n_chan)
    k, j = len(u), len(cov)
    f = np.array([v for v, _ in cov]).reshape(j, n_chan)
    side = n_chan * k + n * j
    core = np.zeros((side, side))
    for c in range(n_chan):
        core[c * k : (c + 1) * k, c * k : (c + 1) * k] = (u * w[c]) @ u.T + np.diag(1 / var)
    base = n_chan * k
    for a in range(j):
        for b in range(j):
            block = np.diag((w * f[a][:, None] * f[b][:, None]).sum(0))
            if a == b:
                block = block + np.linalg.inv(cov[a][1])
            core[base + a * n : base + (a + 1) * n, base + b * n : base + (b + 1) * n] = block
        cross = np.einsum("ct,kt,c->ckt", w, u, f[a]).reshape(n_chan * k, n)
        core[:base, base + a * n : base + (a + 1) * n] = cross
        core[base + a * n : base + (a + 1) * n, :base] = cross.T
    return u, f, core


def weighed(u: np.ndarray, f: np.ndarray, inverse: np.ndarray, w: np.ndarray, d: np.ndarray) -> np.ndarray:
    """N^-1 d from the modes and the inverse of ``scan_core``."""
    n_chan, n = w.shape
    k, base, wd = len(u), n_chan * len(u), w * d
    right = np.concatenate([(wd @ u.T).ravel(), *[(wd * v[:, None]).sum(0) for v in f]])
    x = inverse @ right
    fit = (x[:base].reshape(n_chan, k) @ u if k else 0) + sum(f[a][:, None] * x[base + a * n : base + (a + 1) * n] for a in range(len(f)))
    return wd - w * fit


def weigh_scan(model: NoiseModel, t: np.ndarray, w: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """N^-1 d and the diagonal of N^-1 of a scan without forming N: the matrix inversion lemma over all modes."""
    n_chan, n = w.shape
    u, f, core = scan_core(model, t, w)
    k, j = len(u), len(f)
    base = n_chan * k
    inverse = np.linalg.inv(core) if len(core) else core
    diagonal = w.copy()
    for c in range(n_chan):
        # Row (c, t) of U has k time modes and one entry of each frequency mode.
        cols = np.arange(c * k, (c + 1) * k)
        own = inverse[np.ix_(cols, cols)]
        quad = np.einsum("kt,kl,lt->t", u, own, u) if k else np.zeros(n)
        for a in range(j):
            at = base + a * n + np.arange(n)
            quad = quad + 2 * f[a][c] * (np.einsum("kt,kt->t", u, inverse[np.ix_(cols, at)]) if k else 0)
            for b in range(j):
                quad = quad + f[a][c] * f[b][c] * inverse[at, base + b * n + np.arange(n)]
        diagonal[c] -= w[c] ** 2 * quad
    return weighed(u, f, inverse, w, d), diagonal


def weight_stream(samples: DataFrame, keys: list[str], model: NoiseModel, n_chan: int) -> DataFrame:
    """(keys, scan, chan, t, p, nd, noise_inv): every sample over the scan's noise, and the diagonal of the inverse noise.

    A (keys, scan) block is one task's; times are whole numbers, channels 0 to ``n_chan`` - 1; samples that
    a block lacks are masked. Without any mode samples do not act on each other, and no task holds a block.
    """
    if not (model.time_modes or model.frequency_modes or model.low or model.common):
        plain = thermal_weights(samples).withColumn("nd", F.col("w") * F.coalesce("value", F.lit(0.0)))
        return plain.select(*keys, "scan", F.col("chan").cast("int").alias("chan"), F.col("t").cast("long").alias("t"), F.col("p").cast("long").alias("p"), "nd", F.col("w").alias("noise_inv"))
    kinds = ", ".join(f"{k} {samples.schema[k].dataType.simpleString()}" for k in [*keys, "scan"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        t, at = np.unique(pdf["t"].to_numpy(), return_inverse=True)
        w, d = np.zeros((n_chan, len(t))), np.zeros((n_chan, len(t)))
        chan = pdf["chan"].to_numpy()
        w[chan, at], d[chan, at] = pdf["w"], pdf["value"].fillna(0)
        nd, diagonal = weigh_scan(model, t.astype(float), w, d)
        return pdf[[*keys, "scan", "chan", "t", "p"]].assign(nd=nd[chan, at], noise_inv=diagonal[chan, at])

    rows = thermal_weights(samples).select(*keys, "scan", "chan", "t", "p", "value", "w")
    return rows.groupBy(*keys, "scan").applyInPandas(run, f"{kinds}, chan int, t long, p long, nd double, noise_inv double")


def make_map(weighted: DataFrame, keys: list[str], prior: float = 1e-4) -> DataFrame:
    """Dirty map and the diagonal of its inverse covariance (with a prior) by frequency, from ``weight_stream``."""
    return weighted.groupBy(*keys, "chan", "p").agg(F.sum("nd").alias("dirty"), (F.sum("noise_inv") + prior).alias("noise_inv"))


def pointing(samples: DataFrame, keys: list[str], position: dict[str, Column], kind: str = "linear") -> DataFrame:
    """Sparse pointing: for each sample the pixels it touches and their weights."""
    from .lookup import stencil

    return samples.select(*keys, F.explode(stencil(position, kind)).alias("s")).select(*keys, "s.*").where("weight <> 0")


def apply_pointing(pointing: DataFrame, stream: DataFrame, keys: list[str], axes: list[str]) -> DataFrame:
    """Adds a stream (keys, value) to the map through the pointing."""
    return pointing.join(stream.select(*keys, "value"), keys).groupBy(*axes).agg(F.sum(F.col("weight") * F.col("value")).alias("value"))


def bad_channels(samples: DataFrame, keys: list[str], most: float) -> DataFrame:
    """Samples of channels whose variance in a scan exceeds ``most`` times the scan's median have infinite variance; ``var`` is the channel's variance otherwise."""
    v = samples.groupBy(*keys, "scan", "chan").agg(F.var_pop("value").alias("var"))
    cut = v.groupBy(*keys, "scan").agg((F.median("var") * most).alias("_cut"))
    v = v.join(cut, [*keys, "scan"]).withColumn("var", F.when(F.col("var") <= F.col("_cut"), F.greatest("var", F.lit(SMALL))).otherwise(INFINITE)).drop("_cut")
    return samples.join(v, [*keys, "scan", "chan"])
