"""Beam shapes as column expressions, and beams from tables of Hermite-Gauss coefficients."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyquilt.functions.special import hermite_gauss


def sigma_of(fwhm: Column) -> Column:
    return fwhm / (2 * math.sqrt(2 * math.log(2)))


def beam_function(r: Column, sigma: Column) -> Column:
    """Gaussian beam of sum one over the plane."""
    return F.exp(-r * r / (2 * sigma * sigma)) / (2 * math.pi * sigma * sigma)


def angular_transform(k: Column, sigma: Column) -> Column:
    return F.exp(-sigma * sigma * k * k / 2)


def angular_window(r: Column, sigma1: Column, sigma2: Column) -> Column:
    """The product of two beams' transforms back in space: a Gaussian of summed variances."""
    return beam_function(r, F.sqrt(sigma1 * sigma1 + sigma2 * sigma2))


def radial_transform(k: Column, width: Column) -> Column:
    """Transform of a channel: sin(x) / x of half the width."""
    x = k * width / 2
    return F.when(x == 0, 1.0).otherwise(F.sin(x) / x)


def radial_window(r: Column, width1: Column, width2: Column) -> Column:
    """Overlap of two channels: a trapezoid of sum one."""
    wide, narrow = F.greatest(width1, width2), F.least(width1, width2)
    out = (wide + narrow) / 2 - F.abs(r)
    return F.when(out <= 0, 0.0).when(out >= narrow, 1 / wide).otherwise(out / (wide * narrow))


def kernel_pixels(sigma: Column, spacing: float, taper: float = 4.0) -> Column:
    """Pixels from the middle of a kernel to its edge."""
    return F.greatest(F.lit(1), F.ceil(taper * sigma / spacing).cast("int"))


def beam_on_grid(coefficients: DataFrame, keys: list[str], n_side: int, size: float, sigma: float, orders: int) -> DataFrame:
    """Sum of coefficient * basis over a grid: coefficients (keys, i, j, value) of Hermite-Gauss orders below ``orders``; returns keys, xi, yi, value.

    The basis has ``orders`` * ``n_side`` values along each axis, so two joins with short tables do it and no
    two-dimensional basis is built.
    """
    spark = coefficients.sparkSession
    step = size / n_side
    side = spark.range(n_side).select(F.col("id").cast("int").alias("p"), ((F.col("id") - (n_side - 1) / 2) * step).alias("x"))
    basis = side.select("p", F.posexplode(F.array(*[hermite_gauss(k, F.col("x"), F.lit(float(sigma))) for k in range(orders)])).alias("n", "b"))
    bx, by = basis.select(F.col("p").alias("xi"), F.col("n").alias("i"), F.col("b").alias("bx")), basis.select(F.col("p").alias("yi"), F.col("n").alias("j"), F.col("b").alias("by"))
    along = coefficients.join(bx, "i").groupBy(*keys, "j", "xi").agg(F.sum(F.col("value") * F.col("bx")).alias("v"))
    return along.join(by, "j").groupBy(*keys, "xi", "yi").agg(F.sum(F.col("v") * F.col("by")).alias("value"))


def linear_beam(basis: DataFrame, coefficients: DataFrame, keys: list[str]) -> DataFrame:
    """A beam as a sum of tabulated basis beams: basis (mode, xi, yi, b), coefficients (keys, mode, value)."""
    return coefficients.join(basis, "mode").groupBy(*keys, "xi", "yi").agg(F.sum(F.col("value") * F.col("b")).alias("value"))


# Polarised beams: sums of Hermite polynomials times a Gaussian, with a width and a centre of each channel.


def hermite_pattern(n: int, u: Column) -> Column:
    """The physicists' Hermite polynomial of order n over the root of 2^n n!, without the Gaussian."""
    low, high = F.lit(1.0), 2 * u
    for k in range(1, n):
        low, high = high, 2 * u * high - 2 * k * low
    return (high if n else low) / math.sqrt(2**n * math.factorial(n))


def polarised_patterns(x: Column, y: Column, width: Column, orders: int, triangle: bool = True) -> dict[tuple[int, int], Column]:
    """Patterns of the orders (i, j) at places off the beam's centre, for a beam of full width ``width`` at half its height; with ``triangle`` only those with i + j < ``orders``."""
    sigma = sigma_of(width)
    u, v = x / sigma, y / sigma
    gauss = F.exp(-(u * u + v * v) / 2)
    return {(i, j): hermite_pattern(i, u) * hermite_pattern(j, v) * gauss for i in range(orders) for j in range(orders - i if triangle else orders)}


def polarised_beam(coefficients: DataFrame, channels: DataFrame, n_side: int, size: float, orders: int, triangle: bool = True) -> DataFrame:
    """(chan, pol, xi, yi, value): beams of every channel and polarisation on a square grid about the pointing.

    ``coefficients`` are rows (chan, pol, i, j, value), ``channels`` (chan, width, cx, cy). Patterns separate, so rows meet
    ``n_side`` places along x, are summed over i, and meet those along y: orders * n_side values an axis and channel.
    """
    used = coefficients.where((F.col("i") < orders) & (F.col("j") < orders))
    if triangle:
        used = used.where(F.col("i") + F.col("j") < orders)
    place = lambda k: (k + 0.5 - n_side / 2) / n_side * size
    sigma = sigma_of(F.col("width"))

    def axis(centre: str, order: str, at: str, value: str) -> DataFrame:
        u = F.lit(1.0) * (place(F.col("_k")) - F.col(centre)) / sigma
        spread = channels.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(n_side - 1))))
        along = F.posexplode(F.array(*[hermite_pattern(n, u) * F.exp(-u * u / 2) for n in range(orders)])).alias(order, value)
        return spread.select("chan", F.col("_k").alias(at), along)

    along = used.join(axis("cx", "i", "xi", "_bx"), ["chan", "i"]).groupBy("chan", "pol", "j", "xi").agg(F.sum(F.col("value") * F.col("_bx")).alias("_v"))
    return along.join(axis("cy", "j", "yi", "_by"), ["chan", "j"]).groupBy("chan", "pol", "xi", "yi").agg(F.sum(F.col("_v") * F.col("_by")).alias("value"))


def fit_polarised_beam(rows: DataFrame, channels: DataFrame, orders: int, triangle: bool = True) -> DataFrame:
    """(chan, pol, i, j, value): coefficients of every channel and polarisation by least squares over samples (chan, pol, x, y, value)."""
    from .fits import linear_fit

    near = rows.join(channels, "chan").withColumns({"_x": F.col("x") - F.col("cx"), "_y": F.col("y") - F.col("cy")})
    patterns = polarised_patterns(F.col("_x"), F.col("_y"), F.col("width"), orders, triangle)
    fitted = linear_fit(near, ["chan", "pol"], list(patterns.values()))
    names = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in patterns])
    return fitted.select("chan", "pol", F.explode(F.arrays_zip(names.alias("n"), "coefficients")).alias("s")).select("chan", "pol", "s.n.i", "s.n.j", F.col("s.coefficients").alias("value"))
