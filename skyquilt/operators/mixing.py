"""How power in one 2-D bin appears in others through the weights of a map, and how that is undone.

The kernel is the cross power of both sides' weights; the column of a source bin is the kernel moved to each of the
bin's cells, which is one convolution by FFT in a task of its own, averaged over the cells of every other bin.
Matrices are tables; inverses are taken in tiles.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import eigen, factor
from .joint_map import sum_tiles
from .spectra import wave_numbers

#: Cells of a cube that a task transforms as a whole.
MOST_CELLS = 1 << 27


def bins_of_cells(shape: tuple[int, int, int], spacing: tuple[float, float, float], perp: list[float], par: list[float]) -> np.ndarray:
    """Number of the (k perp, k par) bin of every cell in Fourier space, perp times the number of par bins plus par; -1 outside."""
    kf, kr, kd = wave_numbers(shape, spacing)
    a, b = np.digitize(np.hypot(kr, kd), perp) - 1, np.digitize(np.abs(kf), par) - 1
    inside = (a >= 0) & (a < len(perp) - 1) & (b >= 0) & (b < len(par) - 1)
    return np.where(inside, a * (len(par) - 1) + b, -1)


def window_kernels(left: DataFrame, right: DataFrame, keys: list[str], shape: tuple[int, int, int]) -> DataFrame:
    """(keys, kernel): cross power of the weights (fi, ri, di, weight) of both sides of each key over N times the sum of their product, so that it sums to one. A side is one cube of the bounded size ``shape``."""
    if math.prod(shape) > MOST_CELLS:
        raise ValueError("the cube is too large for one task")
    kinds = ", ".join(f"{k} {left.schema[k].dataType.simpleString()}" for k in keys)

    def cube(pdf: pd.DataFrame, tail: str = "") -> np.ndarray:
        out = np.zeros(shape)
        np.add.at(out, tuple(pdf[c + tail] for c in ("fi", "ri", "di")), pdf["weight" + tail].fillna(0))
        return out

    def run(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        wa, wb = cube(a), cube(b, "_2")
        norm = (wa * wb).sum() * wa.size
        power = (np.fft.fftn(wa) * np.conj(np.fft.fftn(wb))).real
        return pd.DataFrame([(*key, (power / norm if norm else power * 0).tobytes())], columns=[*keys, "kernel"])

    cols = ["fi", "ri", "di", "weight"]
    other = right.select(*[F.col(k).alias(k) for k in keys], *[F.col(c).alias(f"{c}_2") for c in cols])
    return left.select(*keys, *cols).groupBy(*keys).cogroup(other.groupBy(*keys)).applyInPandas(run, f"{kinds}, kernel binary")


def identity_kernel(kernels: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    """The same keys with a kernel that moves nothing: mixing through it is the identity over bins that have cells."""
    delta = np.zeros(shape)
    delta[0, 0, 0] = 1
    return kernels.withColumn("kernel", F.lit(delta.tobytes()))


def mixing_matrix(kernels: DataFrame, keys: list[str], shape: tuple[int, int, int], spacing: tuple[float, float, float], perp: list[float], par: list[float]) -> DataFrame:
    """(keys, row, col, value): the share of bin ``col``'s power in the mean of bin ``row``. Bins without cells have no rows or columns. Rows sum to one if the bins cover all cells."""
    n = (len(perp) - 1) * (len(par) - 1)
    kinds = ", ".join(f"{k} {kernels.schema[k].dataType.simpleString()}" for k in keys)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cell = bins_of_cells(shape, spacing, perp, par)
        counts = np.bincount(cell[cell >= 0], minlength=n)
        for pdf in frames:
            out = []
            for *key, blob, col in pdf[[*keys, "kernel", "col"]].itertuples(index=False):
                source = (cell == col).astype(float)
                if not counts[col]:
                    continue
                spread = np.fft.ifftn(np.fft.fftn(source) * np.fft.fftn(np.frombuffer(blob).reshape(shape))).real
                sums = np.bincount(cell[cell >= 0], spread[cell >= 0], n)
                out += [(*key, int(row), int(col), float(sums[row] / counts[row])) for row in np.flatnonzero(counts)]
            yield pd.DataFrame(out, columns=[*keys, "row", "col", "value"])

    tasks = kernels.select(*keys, "kernel", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("col"))
    return tasks.repartition(*keys, "col").mapInPandas(run, f"{kinds}, row int, col int, value double")


# Products and inverses of matrices in tiles.


def tile_product(stage: Callable[[DataFrame], DataFrame], a: DataFrame, b: DataFrame, side: int, turn: tuple[bool, bool] = (False, False), scale: DataFrame | None = None) -> DataFrame:
    """(i, j, tile) of A D B: tiles of A (i, k) meet those of B (k, j), either turned where its tiles are given as (k, i) or (j, k); ``scale`` is the diagonal D in parts (i, part)."""
    left = a.select(*(("j", F.col("i").alias("k")) if turn[0] else (F.col("i").alias("j"), F.col("j").alias("k"))), F.col("tile").alias("x")).withColumnRenamed("j", "i")
    right = b.select(*((F.col("i").alias("j"), F.col("j").alias("k")) if turn[1] else ("j", F.col("i").alias("k"))), F.col("tile").alias("y"))
    both = left.join(right, "k")
    both = both.join(scale.select(F.col("i").alias("k"), F.col("part").alias("d")), "k") if scale is not None else both.withColumn("d", F.lit(None).cast("array<double>"))

    @F.pandas_udf("array<double>")
    def times(x: pd.Series, y: pd.Series, d: pd.Series) -> pd.Series:
        square = lambda t, turned: np.asarray(t, float).reshape(side, side).T if turned else np.asarray(t, float).reshape(side, side)
        return pd.Series([((square(p, turn[0]) * (1 if s is None else np.asarray(s))) @ square(q, turn[1])).ravel() for p, q, s in zip(x, y, d, strict=True)])

    return sum_tiles(stage, stage(both.select(F.col("k").alias("part"), "i", "j", times("x", "y", "d").alias("tile"))))


def pseudo_inverse(stage: Callable[[DataFrame], DataFrame], mixing: DataFrame, n: int, side: int = 64, least: float = 1e-6) -> DataFrame:
    """(row, col, value) of the pseudo-inverse of a matrix (row, col, value) of ``n`` bins.

    M'M is brought to its eigenvalues in tiles; singular values below ``least`` of the largest, which can be told from
    rounding only above the root of the machine's precision, are left out.
    """
    count = -(-n // side)
    m = stage(factor.tiles(mixing, side))
    gram = tile_product(stage, m, m, side, turn=(True, False))
    rotated = eigen.eigen(stage, gram, count, side)
    values = stage(eigen.eigenvalues(rotated, side))
    most = values.agg(F.max("eigenvalue")).first()[0] or 0.0
    inverse = values.select(F.floor(F.col("column") / side).cast("int").alias("i"), F.struct((F.col("column") % side).alias("k"), F.when(F.col("eigenvalue") > least**2 * most, 1 / F.col("eigenvalue")).otherwise(0.0).alias("v")).alias("s"))
    scale = stage(inverse.groupBy("i").agg(F.transform(F.array_sort(F.collect_list("s")), lambda x: x["v"]).alias("part")))
    v = rotated.where("kind = 1").select("i", "j", "tile")
    mv = tile_product(stage, m, v, side)
    out = tile_product(stage, v, mv, side, turn=(False, True), scale=scale)
    return factor.entries(out, side).where((F.col("row") < n) & (F.col("col") < n))


def unmix(power: DataFrame, inverse: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, bin, power) with the mixing of bins undone."""
    j = power.join(inverse.select(F.col("row"), F.col("col").alias("bin"), F.col("value").alias("_v")), "bin")
    return j.groupBy(*keys, F.col("row").alias("bin")).agg(F.sum(F.col("power") * F.col("_v")).alias("power"))
