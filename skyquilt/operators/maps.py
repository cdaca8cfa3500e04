"""Maps and catalogs: one row for each pixel (``fi``, ``ri``, ``di``) with ``value`` and ``weight``."""

from __future__ import annotations

from collections.abc import Callable

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PIXEL = ["fi", "ri", "di"]
TINY = 1e-20


def hit_map(samples: DataFrame, keys: list[str] = PIXEL) -> DataFrame:
    """Unmasked samples of each pixel."""
    return samples.where("value is not null").groupBy(*keys).agg(F.count("*").alias("hits"))


def brightest(samples: DataFrame, name: str, size: Column, keys: list[str] = PIXEL) -> DataFrame:
    """The ``name`` of the largest sample of each pixel."""
    return samples.groupBy(*keys).agg(F.max_by(name, size).alias("best"))


def best_frequencies(maps: DataFrame, n: int, digits: int = 5) -> DataFrame:
    """The n frequencies of largest total weight, the lower one first where weights agree to ``digits``."""
    return maps.groupBy("fi").agg(F.round(F.sum("weight"), digits).alias("weight")).orderBy(F.desc("weight"), "fi").limit(n)


def add_to_map(samples: DataFrame, keys: list[str] = PIXEL, weight: Column | None = None) -> DataFrame:
    """Weighted sums of samples and of weights in each pixel."""
    w = F.lit(1.0) if weight is None else weight
    return samples.where("value is not null").groupBy(*keys).agg(F.sum(w * F.col("value")).alias("dirty"), F.sum(w).alias("noise_inv"))


def clean_diagonal(dirty: DataFrame, least: float = 1e-10) -> DataFrame:
    """Solves a diagonal map: dirty over inverse noise where that is not below ``least`` of its maximum."""
    top = F.max("noise_inv").over(Window.partitionBy("fi"))
    return dirty.withColumn("_top", top).withColumn("value", F.when(F.col("noise_inv") >= least * F.col("_top"), F.try_divide("dirty", "noise_inv"))).drop("_top")


def sanitize(maps: DataFrame, cut: list[int] | None = None) -> DataFrame:
    """Weight 0 where map or weight is not finite, the weight is tiny or the frequency is cut; then the map 0 where not finite."""
    bad = lambda c: F.coalesce(F.isnan(c) | (F.abs(F.col(c)) == float("inf")), F.lit(True))
    off = bad("value") | bad("weight") | (F.col("weight") < TINY) | F.col("fi").isin(cut or [])
    return maps.withColumn("weight", F.when(F.coalesce(off, F.lit(True)), 0.0).otherwise(F.col("weight"))).withColumn("value", F.when(bad("value"), 0.0).otherwise(F.col("value")))


def weighted_stack(maps: DataFrame, keys: list[str] = PIXEL) -> DataFrame:
    """Sum of weight * value over sum of weights; 0 without weight."""
    return maps.groupBy(*keys).agg(F.coalesce(F.try_divide(F.sum(F.col("weight") * F.col("value")), F.sum("weight")), F.lit(0.0)).alias("value"), F.sum("weight").alias("weight"))


def subtract_weighted_mean(maps: DataFrame, by: list[str]) -> DataFrame:
    """Value less its weighted mean in each key; 0 without weight."""
    w = Window.partitionBy(*by)
    mean = F.try_divide(F.sum(F.col("weight") * F.col("value")).over(w), F.sum("weight").over(w))
    return maps.withColumn("value", F.when(F.col("weight") < TINY, 0.0).otherwise(F.col("value") - F.coalesce(mean, F.lit(0.0))))


def factorizable_weight(maps: DataFrame, prior: float = 2.0) -> DataFrame:
    """Weights as a product of a frequency and a position profile, from means of the inverse weights."""
    pos = ["ri", "di"]
    noise = F.when(F.col("weight") > prior * TINY, 1 / F.col("weight"))
    f = maps.groupBy("fi").agg(F.avg(noise).alias("nf"))
    p = maps.withColumn("n", noise).join(f, "fi").groupBy(*pos).agg(F.avg(F.try_divide("n", "nf")).alias("np"))
    out = maps.join(f, "fi").join(p, pos)
    return out.withColumn("weight", F.coalesce(F.try_divide(F.lit(1.0), F.col("nf") * F.col("np")), F.lit(0.0))).drop("nf", "np")


def saturate_weight(maps: DataFrame, percentile: float = 0.5) -> DataFrame:
    """In each frequency, weights above the percentile of the frequency-mean weight become the mean of those cells."""
    pos = ["ri", "di"]
    mean = maps.groupBy(*pos).agg(F.avg("weight").alias("mw"))
    cut = mean.agg(F.percentile("mw", F.lit(percentile)).alias("cut"))
    high = mean.crossJoin(F.broadcast(cut)).select(*pos, (F.col("mw") > F.col("cut")).alias("high"))
    w = Window.partitionBy("fi")
    out = maps.join(high, pos)
    return out.withColumn("weight", F.when(F.col("high"), F.avg(F.when(F.col("high"), F.col("weight"))).over(w)).otherwise(F.col("weight"))).drop("high")


def template_gain(session: DataFrame, template: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """Gain of each key: sum s w t over sum t w t; 0 where undefined."""
    t = template.select(*keys, F.col("value").alias("_t"))
    j = session.join(t, keys)
    num, den = F.sum(F.col("value") * F.col("weight") * F.col("_t")), F.sum(F.col("_t") * F.col("weight") * F.col("_t"))
    return j.groupBy(*by).agg(F.coalesce(F.try_divide(num, den), F.lit(0.0)).alias("gain"))


def apply_gain(maps: DataFrame, gain: DataFrame, by: list[str]) -> DataFrame:
    return maps.join(gain, by, "left").withColumn("value", F.try_divide("value", "gain")).drop("gain")


def combine(left: DataFrame, right: DataFrame, sign: float = 1.0, keys: list[str] = PIXEL) -> DataFrame:
    """left + sign * right, pixel by pixel."""
    return left.join(right.select(*keys, F.col("value").alias("_r")), keys).withColumn("value", F.col("value") + sign * F.col("_r")).drop("_r")


def overdensity(counts: DataFrame, selection: DataFrame, keys: list[str] = PIXEL) -> DataFrame:
    """n / expected - 1; 0 where nothing is expected."""
    return selection.join(counts, keys, "left").withColumn("delta", F.coalesce(F.try_divide(F.coalesce(F.col("n"), F.lit(0)), F.col("nbar")) - 1, F.lit(0.0)))


def bin_catalog(catalog: DataFrame, buckets: dict[str, Column]) -> DataFrame:
    """Counts of objects in the bins of all axes; objects outside an axis are left out."""
    at = catalog.select(*[c.alias(k) for k, c in buckets.items()]).dropna()
    return at.groupBy(*buckets).agg(F.count("*").alias("n"))


def separable_selection(counts: DataFrame) -> DataFrame:
    """f(frequency) * g(position) / total, of counts n; marginals only are exchanged."""
    f = counts.groupBy("fi").agg(F.sum("n").alias("nf"))
    p = counts.groupBy("ri", "di").agg(F.sum("n").alias("np"))
    total = f.agg(F.sum("nf").alias("nt"))
    return p.crossJoin(F.broadcast(f)).crossJoin(F.broadcast(total)).select("fi", "ri", "di", (F.col("nf") * F.col("np") / F.col("nt")).alias("nbar"))


def sky_fraction(maps: DataFrame) -> DataFrame:
    """(sum w1 w2)^2 / sum w1^2 w2^2 / cells of two weights."""
    w = F.col("w1") * F.col("w2")
    return maps.agg((F.try_divide(F.sum(w) * F.sum(w), F.sum(w * w)) / F.count("*")).alias("fsky"))


def gaussian_kernel(sigma: float, spacing: float, taper: float = 4.0) -> list[tuple[int, int, float]]:
    """(dr, dd, weight) of a Gaussian beam on pixels, of sum one."""
    half = max(1, math.ceil(taper * sigma / spacing))
    k = [(i, j, math.exp(-((i * i + j * j) * spacing**2) / (2 * sigma**2))) for i in range(-half, half + 1) for j in range(-half, half + 1)]
    total = sum(w for _, _, w in k)
    return [(i, j, w / total) for i, j, w in k]


def convolve(maps: DataFrame, kernel: list[tuple[int, int, float]], value: str = "value") -> DataFrame:
    """Convolution in position, with zeros outside: every pixel adds to its neighbours' sums."""
    steps = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(w).alias("w")) for i, j, w in kernel])).alias("s")
    spread = maps.select("fi", "ri", "di", F.col(value).alias("v"), steps).groupBy("fi", (F.col("ri") + F.col("s.i")).alias("ri"), (F.col("di") + F.col("s.j")).alias("di")).agg(F.sum(F.col("v") * F.col("s.w")).alias(f"{value}_smooth"))
    return maps.join(spread, PIXEL, "left")


def degrade(maps: DataFrame, sigma_of: dict[int, float], spacing: float, factor: float = 1.1) -> DataFrame:
    """All frequencies at ``factor`` times the widest beam; one kernel for each distinct extra width."""
    widest = factor * max(sigma_of.values())
    parts = []
    for s in sorted(set(sigma_of.values())):
        chosen = maps.where(F.col("fi").isin([f for f, x in sigma_of.items() if x == s]))
        parts.append(convolve(chosen, gaussian_kernel(math.sqrt(widest**2 - s * s), spacing)).withColumn("value", F.col("value_smooth")).drop("value_smooth"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def solve_channels(rows: DataFrame, blocks: DataFrame, keys: list[str], prior: float = 0.0) -> DataFrame:
    """Clean map by a dense solve for each key: dirty vector (p, dirty) and inverse covariance (p, q, value).

    A key's matrix is one task's; keys are independent channels or blocks of bounded size.
    """

    def run(key, vec: pd.DataFrame, mat: pd.DataFrame) -> pd.DataFrame:
        at = {p: i for i, p in enumerate(sorted(vec["p"]))}
        d = np.zeros(len(at))
        d[[at[p] for p in vec["p"]]] = vec["dirty"]
        n = np.eye(len(at)) * prior
        ok = mat["row"].isin(at) & mat["col"].isin(at)
        np.add.at(n, ([at[p] for p in mat["row"][ok]], [at[q] for q in mat["col"][ok]]), mat["entry"][ok].to_numpy())
        scale = np.sqrt(np.where(np.diag(n) > 0, np.diag(n), 1.0))
        x = np.linalg.lstsq(n / np.outer(scale, scale), d / scale, rcond=1e-11)[0] / scale
        inverse = np.linalg.pinv(n / np.outer(scale, scale), rcond=1e-11) / np.outer(scale, scale)
        out = pd.DataFrame({"p": sorted(at), "value": x, "noise": np.diag(inverse)})
        for k, v in zip(keys, key):
            out[k] = v
        return out[[*keys, "p", "value", "noise"]]

    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    entries = blocks.select(*[F.col(k).alias(k) for k in keys], F.col("p").alias("row"), F.col("q").alias("col"), F.col("value").alias("entry"))
    return rows.groupBy(*keys).cogroup(entries.groupBy(*keys)).applyInPandas(run, f"{kinds}, p long, value double, noise double")


def correlated_map(samples: DataFrame, keys: list[str], slope: bool = True, big: float = 1e4) -> tuple[DataFrame, DataFrame]:
    """Dirty map and inverse covariance of streams with thermal noise and an unknown mean, and slope, of each (keys, scan).

    Samples: keys, scan, t, p (pixel), value, var. Everything is sums over samples, pixels of a scan and pairs
    of such pixels; no task holds a stream.
    """
    from .noise_model import deweight_time, dirty_and_inverse

    return dirty_and_inverse(deweight_time(samples, keys, slope, big), keys)


def region(bounds: dict[str, tuple[float, float]], fwhm: float, samples_per_beam: float = 3.0) -> dict[str, tuple[float, float, int]]:
    """(centre, spacing, pixels) of each axis such that a beam has the wanted number of pixels."""
    out = {}
    for axis, (low, high) in bounds.items():
        n = max(1, math.ceil((high - low) / (fwhm / samples_per_beam)))
        out[axis] = ((low + high) / 2, (high - low) / n, n)
    return out


def covariance_gigabytes(nf: int, nra: int, ndec: int) -> float:
    """Size of a block-diagonal covariance of four-byte numbers."""
    return nf * nra**2 * ndec**2 * 4 / 2**30


def apply_weights(maps: DataFrame) -> DataFrame:
    return maps.withColumn("value", F.col("value") * F.col("weight"))


def unapply_weights(maps: DataFrame) -> DataFrame:
    """Inverse of ``apply_weights``; null where there is no weight."""
    return maps.withColumn("value", F.try_divide("value", "weight"))


def wcs_coordinates(maps: DataFrame, axes: dict[str, tuple[str, float, float, float]]) -> DataFrame:
    """Adds coordinates of index axes: axis -> (name, reference pixel, its value, spacing)."""
    from skyquilt.functions.columns import wcs_axis

    return maps.withColumns({name: wcs_axis(F.col(a), F.lit(p), F.lit(v), F.lit(d)) for a, (name, p, v, d) in axes.items()})


def calibrate_against_first(maps: DataFrame, sections: str, first: str, by: list[str]) -> DataFrame:
    """All sections over their gain against the first one: means are removed, gains fitted pixel by pixel for each of ``by``."""
    flat = subtract_weighted_mean(maps, [sections, *by])
    template = flat.where(F.col(sections) == first).select(*PIXEL, "value")
    gain = template_gain(flat, template, PIXEL, [sections, *by])
    return apply_gain(maps, gain, [sections, *by])


def mode_ratio_gain(cross: DataFrame) -> DataFrame:
    """Gain of each channel (chan, chan2, cov of left and right maps) as the ratio of the leading left and right modes."""
    from .modes import svd_modes

    chans, s, left, right = svd_modes(cross, 1)
    root = [(c, float(a), float(b)) for c, a, b in zip(chans, left[0], right[0])]
    table = cross.sparkSession.createDataFrame(root, f"chan {cross.schema['chan'].dataType.simpleString()}, left_mode double, right_mode double")
    return table.select("chan", F.try_divide("left_mode", "right_mode").alias("gain"))


def selection_from_mocks(mocks: DataFrame, data: DataFrame, n_mocks: int) -> DataFrame:
    """Mean counts of the mock catalogs and the data in each pixel."""
    return mocks.unionByName(data).groupBy(*PIXEL).agg((F.sum("n") / (n_mocks + 1)).alias("nbar"))


def selection_by_simulation(catalog: DataFrame, draws: int, edges: tuple[float, float, int], sigma: Column, seed: int) -> DataFrame:
    """Selection along redshift by scattering every object ``draws`` times: (ri, di, bin, nbar). Draws depend on the object and a seed, so a retried task draws the same."""
    from .generators import normal

    low, high, n = edges
    drawn = catalog.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("_z", F.col("z") + sigma * normal(seed, "object_id", "k"))
    at = F.floor((F.col("_z") - low) / (high - low) * n).cast("int")
    return drawn.withColumn("bin", at).where((F.col("bin") >= 0) & (F.col("bin") < n)).groupBy("ri", "di", "bin").agg((F.count("*") / draws).alias("nbar"))


def settled_selection(stage: Callable[[DataFrame], DataFrame], catalog: DataFrame, edges: tuple[float, float, int], sigma: Column, seed: int, *, bound: float, per_round: int = 20, least: float = 5.0, most_rounds: int = 200) -> tuple[DataFrame, int]:
    """Selection (ri, di, bin, nbar, a, b, draws) from as many draws as it takes, and their number.

    Objects are scattered ``per_round`` times a round, and counts are added to those of earlier rounds. Even and odd
    draws are two halves with counts a and b; rounds end when these differ by no more than ``bound`` of their sum
    in every cell that has ``least`` objects or more in the mean. Draws depend on the object, the draw and the seed.
    """
    from .generators import normal

    low, high, n = edges
    cells, total, draws = ["ri", "di", "bin"], None, 0
    for _ in range(most_rounds):
        drawn = catalog.withColumn("k", F.explode(F.sequence(F.lit(draws + 1), F.lit(draws + per_round)))).withColumn("_z", F.col("z") + sigma * normal(seed, "object_id", "k"))
        at = drawn.withColumn("bin", F.floor((F.col("_z") - low) / (high - low) * n).cast("int")).where((F.col("bin") >= 0) & (F.col("bin") < n))
        new = at.groupBy(*cells).agg(F.count(F.when(F.col("k") % 2 == 0, 1)).alias("a"), F.count(F.when(F.col("k") % 2 == 1, 1)).alias("b"))
        total = stage(new if total is None else total.unionByName(new).groupBy(*cells).agg(F.sum("a").alias("a"), F.sum("b").alias("b")))
        draws += per_round
        filled = total.where((F.col("a") + F.col("b")) >= least * draws)
        if filled.where(F.abs(F.col("a") - F.col("b")) > bound * (F.col("a") + F.col("b"))).isEmpty():
            return total.select(*cells, ((F.col("a") + F.col("b")) / draws).alias("nbar"), "a", "b", F.lit(draws).alias("draws")), draws
    raise RuntimeError("the selection did not settle")


def glue(parts: DataFrame, band: str, lowest_first: bool = True) -> DataFrame:
    """Maps of neighbouring bands as one: channels are numbered through, band after band in order of their frequency."""
    order = F.asc("freq") if lowest_first else F.desc("freq")
    chans = parts.select(band, "fi", "freq").distinct()
    numbered = chans.withColumn("chan", F.row_number().over(Window.orderBy(order)) - 1)
    return parts.join(numbered, [band, "fi", "freq"]).withColumn("fi", F.col("chan").cast("int")).drop("chan", band)


def extended_stack(maps: DataFrame, external: DataFrame) -> DataFrame:
    """External maps as further channels behind those of the pair, for finding modes over both."""
    last = maps.agg((F.max("fi") + 1).alias("_n"))
    moved = external.crossJoin(F.broadcast(last)).withColumn("fi", F.col("fi") + F.col("_n")).drop("_n")
    return maps.select(*PIXEL, "value", "weight").unionByName(moved.select(*PIXEL, "value", "weight"))
