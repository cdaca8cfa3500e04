"""Simulated data as table-valued functions. Every row's random numbers come from its key and a seed, so a lost task gives the same rows again."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def uniform(seed: int, *keys) -> Column:
    """A number in [0, 1) from the keys."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 52)) / float(1 << 52)


def normal(seed: int, *keys) -> Column:
    """A standard normal number from the keys."""
    return F.sqrt(-2 * F.log(1 - uniform(seed, *keys))) * F.cos(2 * math.pi * uniform(seed + 1, *keys))


def pixels(spark: SparkSession, nf: int, nr: int, nd: int) -> DataFrame:
    i = F.col("id")
    return spark.range(nf * nr * nd).select(F.floor(i / (nr * nd)).cast("int").alias("fi"), F.floor(F.pmod(i, F.lit(nr * nd)) / nd).cast("int").alias("ri"), F.pmod(i, F.lit(nd)).cast("int").alias("di"))


def thermal_noise(grid: DataFrame, temperature: Column, bandwidth: float, time: Column, seed: int) -> DataFrame:
    """Noise of deviation temperature / sqrt(bandwidth * time)."""
    return grid.withColumn("value", normal(seed, "fi", "ri", "di") * temperature / F.sqrt(F.lit(float(bandwidth)) * time))


def poisson_counts(grid: DataFrame, expected: Column, seed: int, part: float = 16.0, steps: int = 120) -> DataFrame:
    """Poisson number of each row: a sum of draws by inversion with expectations of ``part`` at most, so any expectation will do."""
    keys = grid.columns
    parts = F.greatest(F.lit(1), F.ceil(F.col("_mean") / part).cast("int"))

    def draw(k: Column) -> Column:
        u, mean = uniform(seed, *keys, k), F.col("_mean") / parts
        state = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("c"), F.lit(0).alias("n"))
        step = lambda a, n: F.when(u >= a["c"], F.struct((a["p"] * mean / n).alias("p"), (a["c"] + a["p"] * mean / n).alias("c"), n.cast("int").alias("n"))).otherwise(a)
        return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), state, step, lambda a: a["n"])

    counted = F.aggregate(F.sequence(F.lit(1), parts), F.lit(0), lambda acc, k: acc + draw(k))
    return grid.withColumn("_mean", expected.cast("double")).withColumn("n", F.when(F.col("_mean").isNotNull(), counted)).drop("_mean")


def gaussian_fields(spark: SparkSession, n_fields: int, shape: tuple[int, int, int], spacing: tuple[float, float, float], power, seed: int) -> DataFrame:
    """``n_fields`` Gaussian cubes with the power spectrum ``power(k)``; a field is one task's group of the given size."""

    def run(frames):
        for pdf in frames:
            for field in pdf["id"]:
                rng = np.random.default_rng([seed, int(field)])
                k = np.sqrt(sum(x**2 for x in np.meshgrid(*[2 * np.pi * np.fft.fftfreq(n, d) for n, d in zip(shape, spacing)], indexing="ij")))
                amp = np.zeros(shape)
                amp[k > 0] = np.sqrt(power(k[k > 0]) / math.prod(spacing))
                cube = np.fft.ifftn(np.fft.fftn(rng.normal(size=shape)) * amp).real
                f, r, d = np.indices(shape)
                yield pd.DataFrame({"field": field, "fi": f.ravel(), "ri": r.ravel(), "di": d.ravel(), "value": cube.ravel()})

    return spark.range(0, n_fields, 1, max(1, min(n_fields, 64))).mapInPandas(run, "field long, fi int, ri int, di int, value double")


def over_f_noise(spark: SparkSession, n_streams: int, n: int, amp: float, index: float, f0: float, dt: float, seed: int) -> DataFrame:
    """Time series with power amp (f / f0)^index: generated twice as long, so that they do not repeat."""
    from .spectra import over_f_spectrum

    def run(frames):
        for pdf in frames:
            for stream in pdf["id"]:
                rng = np.random.default_rng([seed, int(stream)])
                p = over_f_spectrum(amp, index, f0, dt, 2 * n)
                x = np.fft.ifft(np.fft.fft(rng.normal(size=2 * n)) * np.sqrt(p / (2 * dt))).real[:n]
                yield pd.DataFrame({"stream": stream, "t": np.arange(n), "value": x})

    return spark.range(0, n_streams, 1, max(1, min(n_streams, 64))).mapInPandas(run, "stream long, t int, value double")


def poisson_process(spark: SparkSession, n_processes: int, span: float, rate, highest: float, seed: int) -> DataFrame:
    """Event times of inhomogeneous processes with rate(t) <= highest, by thinning."""

    def run(frames):
        for pdf in frames:
            for p in pdf["id"]:
                rng = np.random.default_rng([seed, int(p)])
                t = np.sort(rng.uniform(0, span, rng.poisson(highest * span)))
                t = t[rng.uniform(size=len(t)) * highest < rate(t)]
                yield pd.DataFrame({"process": p, "t": t})

    return spark.range(0, n_processes, 1, max(1, min(n_processes, 64))).mapInPandas(run, "process long, t double")


def point_sources(catalog: DataFrame, seed: int, n_freq: int, f0: float, df: float, index: float = -0.8, scatter: float = 0.2) -> DataFrame:
    """Power-law spectra of sources (source_id, ri, di, flux): a random index for each source, summed in pixels."""
    spectral = F.lit(index) + scatter * normal(seed, "source_id")
    spread = catalog.withColumn("alpha", spectral).withColumn("fi", F.explode(F.sequence(F.lit(0), F.lit(n_freq - 1))))
    f = F.lit(float(f0)) + F.col("fi") * float(df)
    return spread.groupBy("fi", "ri", "di").agg(F.sum(F.col("flux") * F.pow(f / f0, F.col("alpha"))).alias("value"))


def foreground_covariance(l: np.ndarray, f1: float, f2: float, amp: float, beta: float, alpha: float, zeta: float, f0: float = 130.0) -> np.ndarray:
    """Angular power of a smooth foreground at two frequencies."""
    return amp * (l / 1000.0) ** -beta * (f1 * f2 / f0**2) ** -alpha * np.exp(-0.5 * (math.log(f1 / f2) / zeta) ** 2)
