"""Correlations and angular power of fields from their power spectrum, and fields seen on the sky.

An integral over wave numbers is a sum over a table of them: rows meet the k table, and the sums are combined
before the exchange. The spectrum is a function of a column.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyquilt.functions.cosmology import Cosmology, frequency, interpolate
from skyquilt.functions.special import spherical_bessel

from .generators import gaussian_fields
from .lookup import lookup_map

Spectrum = Callable[[Column], Column]


def k_table(spark: SparkSession, low: float, high: float, n: int) -> DataFrame:
    """Wave numbers in the middle of n equal steps, with the step as weight."""
    step = (high - low) / n
    return spark.range(n).select((F.lit(low) + (F.col("id") + 0.5) * step).alias("k"), F.lit(step).alias("dk"))


def kaiser(power: Spectrum, kpar: Column, kperp: Column, bias: tuple[float, float], rate: tuple[Column, Column], growth: tuple[Column, Column]) -> Column:
    """Power between two redshifts with linear redshift distortions."""
    k2 = kpar**2 + kperp**2
    mu2 = F.when(k2 > 0, kpar**2 / k2).otherwise(0.0)
    return power(F.sqrt(k2)) * growth[0] * growth[1] * (bias[0] + rate[0] * mu2) * (bias[1] + rate[1] * mu2)


def correlation(points: DataFrame, r: str, k: DataFrame, power: Spectrum, l: int = 0) -> DataFrame:
    """Multipole l (even) of the correlation at separations ``r``: i^l / (2 pi^2) times the integral of k^2 P j_l(k r)."""
    j = spherical_bessel(F.lit(l), F.col("k") * F.col(r))
    sign = (-1) ** (l // 2)
    return points.crossJoin(F.broadcast(k)).groupBy(*points.columns).agg((F.sum(F.col("k") ** 2 * power(F.col("k")) * j * F.col("dk")) * sign / (2 * math.pi**2)).alias("xi"))


def redshift_correlation(points: DataFrame, k: DataFrame, power: Spectrum, beta: float) -> DataFrame:
    """Correlation at separations along (``pi``) and across (``sigma``) the line of sight, by its even multipoles up to four."""
    at = points.select("pi", "sigma").distinct().withColumn("_r", F.sqrt(F.col("pi") ** 2 + F.col("sigma") ** 2))
    out = at
    for l in (0, 2, 4):
        out = out.join(correlation(at, "_r", k, power, l).withColumnRenamed("xi", f"_x{l}"), ["pi", "sigma", "_r"])
    m2 = F.when(F.col("_r") > 0, (F.col("pi") / F.col("_r")) ** 2).otherwise(0.0)
    legendre = {0: F.lit(1.0), 2: (3 * m2 - 1) / 2, 4: (35 * m2**2 - 30 * m2 + 3) / 8}
    weight = {0: 1 + 2 * beta / 3 + beta**2 / 5, 2: 4 * beta / 3 + 4 * beta**2 / 7, 4: 8 * beta**2 / 35}
    return out.select("pi", "sigma", sum((weight[l] * legendre[l] * F.col(f"_x{l}") for l in (0, 2, 4)), F.lit(0.0)).alias("xi"))


def angular_power(points: DataFrame, k: DataFrame, power: Spectrum) -> DataFrame:
    """C_l between two distances (l, chi1, chi2): 2 / pi times the integral of k^2 P j_l(k chi1) j_l(k chi2)."""
    j1, j2 = (spherical_bessel(F.col("l"), F.col("k") * F.col(c)) for c in ("chi1", "chi2"))
    return points.crossJoin(F.broadcast(k)).groupBy(*points.columns).agg((F.sum(F.col("k") ** 2 * power(F.col("k")) * j1 * j2 * F.col("dk")) * 2 / math.pi).alias("cl"))


def angular_power_flat(points: DataFrame, k: DataFrame, power: Spectrum) -> DataFrame:
    """The same for a flat sky: an integral over wave numbers along the line of sight."""
    chi = (F.col("chi1") + F.col("chi2")) / 2
    across = F.sqrt(F.col("k") ** 2 + (F.col("l") / chi) ** 2)
    wave = F.cos(F.col("k") * (F.col("chi1") - F.col("chi2")))
    return points.crossJoin(F.broadcast(k)).groupBy(*points.columns).agg(F.sum(power(across) * wave * F.col("dk") / (math.pi * chi * chi)).alias("cl"))


def angular_power_lags(spark: SparkSession, ls: list[int], chi: float, n_lags: int, step: float, power: Spectrum) -> DataFrame:
    """Flat-sky C_l for all lags along the line of sight at once: (l, lag, cl), a cosine transform over the lags' own wave numbers."""
    dk = math.pi / (n_lags * step)
    k = k_table(spark, 0.0, n_lags * dk, n_lags)
    points = spark.createDataFrame([(l,) for l in ls], "l int").crossJoin(spark.range(n_lags).select(F.col("id").cast("int").alias("lag")))
    points = points.withColumn("chi1", F.lit(chi) + F.col("lag") * step / 2).withColumn("chi2", F.lit(chi) - F.col("lag") * step / 2)
    return angular_power_flat(points, k, power).select("l", "lag", "cl")


def distance_table(cosmology: Cosmology, z_high: float, n: int = 200) -> tuple[list[float], list[float]]:
    """Comoving distances and the redshifts they belong to, by trapezoids on the driver: two short lists."""
    z = np.linspace(0, z_high, n)
    e = np.sqrt(cosmology.matter * (1 + z) ** 3 + cosmology.curvature * (1 + z) ** 2 + cosmology.dark)
    d = np.concatenate([[0.0], np.cumsum((1 / e[1:] + 1 / e[:-1]) / 2 * np.diff(z))]) * 299792.458 / cosmology.h0
    return d.tolist(), z.tolist()


def redshift_of_light_distance(distance: Column, cosmology: Cosmology, z_high: float = 10.0, n: int = 400) -> Column:
    """Redshift of a light travel distance (Mpc), by the table of its inverse."""
    z = np.linspace(0, z_high, n)
    e = np.sqrt(cosmology.matter * (1 + z) ** 3 + cosmology.curvature * (1 + z) ** 2 + cosmology.dark)
    f = 1 / ((1 + z) * e)
    d = np.concatenate([[0.0], np.cumsum((f[1:] + f[:-1]) / 2 * np.diff(z))]) * 299792.458 / cosmology.h0
    return interpolate(distance, d.tolist(), z.tolist())


def redshift_of_age(age: Column, cosmology: Cosmology, z_high: float = 20.0, n: int = 400) -> Column:
    """Redshift at which a flat universe had an age (Gyr), by the table of the closed form."""
    z = np.linspace(0, z_high, n)[::-1]
    t = 977.7922216807892 / cosmology.h0 * 2 / (3 * cosmology.dark**0.5) * np.arcsinh((cosmology.dark / cosmology.matter) ** 0.5 * (1 + z) ** -1.5)
    return interpolate(age, t.tolist(), z.tolist())


def physical_cells(spark: SparkSession, shape: tuple[int, int, int], origin: tuple[float, float, float], spacing: tuple[float, float, float]) -> DataFrame:
    """Cells (xi, yi, zi) of a comoving box with coordinates x along the line of sight and y, z across (Mpc)."""
    n = math.prod(shape)
    i = F.col("id")
    index = [F.floor(i / (shape[1] * shape[2])), F.floor(F.pmod(i, F.lit(shape[1] * shape[2])) / shape[2]), F.pmod(i, F.lit(shape[2]))]
    cells = spark.range(n).select(*[c.cast("int").alias(a) for c, a in zip(index, ("xi", "yi", "zi"))])
    return cells.select("*", *[(F.lit(o) + F.col(a) * s).alias(c) for o, a, s, c in zip(origin, ("xi", "yi", "zi"), spacing, "xyz")])


def physical_cells_lookup(maps: DataFrame, cells: DataFrame, channel: Callable[[Column], Column], cosmology: Cosmology, angle: tuple[float, int, int], z_high: float = 3.0, kind: str = "nearest") -> DataFrame:
    """A map (fi, ri, di, value) on comoving cells (xi, yi, zi, x, y, z): xi, yi, zi, value, observed.

    ``channel`` gives the fractional channel of a redshift; ``angle`` is the pixel's side in radians and the
    numbers of pixels in both directions. Every cell meets its neighbours in frequency and angle by an
    equi-join with their pixels; cells that the map does not cover are 0 and not observed.
    """
    distances, redshifts = distance_table(cosmology, z_high)
    z = interpolate(F.col("x"), distances, redshifts)
    position = {"fi": channel(z), "ri": F.col("y") / F.col("x") / angle[0] + angle[1] // 2, "di": F.col("z") / F.col("x") / angle[0] + angle[2] // 2}
    seen = lookup_map(cells, maps, ["xi", "yi", "zi"], position, kind)
    out = cells.select("xi", "yi", "zi").join(seen, ["xi", "yi", "zi"], "left")
    return out.select("xi", "yi", "zi", F.coalesce("map_value", F.lit(0.0)).alias("value"), F.col("map_value").isNotNull().alias("observed"))


def physical_grid(maps: DataFrame, cells: DataFrame, cosmology: Cosmology, freq: tuple[float, float], angle: tuple[float, int, int], z_high: float = 3.0, kind: str = "linear") -> DataFrame:
    """The same for channels at equal steps: ``freq`` is the first channel's MHz and the step."""
    return physical_cells_lookup(maps, cells, lambda z: (frequency(z) - freq[0]) / freq[1], cosmology, angle, z_high, kind)


def make_physical(maps: DataFrame, cells: DataFrame, *args, **kwargs) -> DataFrame:
    """Value and weight of a map on comoving cells; cells that are not observed have no weight."""
    value = physical_grid(maps, cells, *args, **kwargs)
    weight = physical_grid(maps.withColumn("value", F.col("weight")), cells, *args, **kwargs)
    keys = ["xi", "yi", "zi"]
    return value.join(weight.select(*keys, F.col("value").alias("weight")), keys).withColumn("weight", F.when(F.col("observed"), F.col("weight")).otherwise(0.0))


def foreground_fields(spark: SparkSession, covariance: np.ndarray, n_pixels: int, angular, seed: int) -> DataFrame:
    """A foreground (fi, ri, di, value) whose power separates into ``angular``(k) and a covariance of channels.

    One field is drawn for each root mode of the covariance; maps are sums of modes, by a join with the short
    table of the root's entries.
    """
    w, v = np.linalg.eigh((covariance + covariance.T) / 2)
    keep = w > 1e-12 * w.max()
    root = v[:, keep] * np.sqrt(w[keep])
    fields = gaussian_fields(spark, int(keep.sum()), (1, n_pixels, n_pixels), (1.0, 1.0, 1.0), angular, seed)
    table = spark.createDataFrame([(f, m, float(root[f, m])) for f in range(len(root)) for m in range(root.shape[1])], "fi int, field long, root double")
    return fields.drop("fi").join(table, "field").groupBy("fi", "ri", "di").agg(F.sum(F.col("value") * F.col("root")).alias("value"))


def synchrotron_fields(spark: SparkSession, n_freq: int, n_pixels: int, freq: tuple[float, float], f0: float, amplitude: tuple[float, float], index: tuple[float, float], angular, seed: int, slabs: int = 1) -> DataFrame:
    """Diffuse emission: amplitude and spectral index vary over the sky as fields of their own, summed over slabs of depth."""
    draw = lambda s: gaussian_fields(spark, slabs, (1, n_pixels, n_pixels), (1.0, 1.0, 1.0), angular, s).select("field", "ri", "di", "value")
    a = draw(seed).withColumn("a", amplitude[0] + amplitude[1] * F.col("value")).drop("value")
    b = draw(seed + 1).withColumn("b", index[0] + index[1] * F.col("value")).drop("value")
    both = a.join(b, ["field", "ri", "di"]).withColumn("fi", F.explode(F.sequence(F.lit(0), F.lit(n_freq - 1))))
    nu = F.lit(freq[0]) + F.col("fi") * freq[1]
    return both.groupBy("fi", "ri", "di").agg(F.sum(F.col("a") * F.pow(nu / f0, F.col("b"))).alias("value"))


def signal_field(spark: SparkSession, shape: tuple[int, int, int], spacing: tuple[float, float, float], freq: tuple[float, float], power, cosmology: Cosmology, seed: int, fields: int = 1) -> DataFrame:
    """21 cm cubes (field, fi, ri, di, value): a Gaussian field times growth and brightness of each frequency's redshift."""
    cube = gaussian_fields(spark, fields, shape, spacing, power, seed)
    z = 1420.40575177 / (F.lit(freq[0]) + F.col("fi") * freq[1]) - 1
    return cube.withColumn("value", F.col("value") * cosmology.growth_factor(z) * cosmology.brightness_temperature(z))
