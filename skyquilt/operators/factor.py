"""Cholesky factors of large symmetric matrices in tiles: a matrix is a table (i, j, tile) of square blocks, each step a join and a sum.

A tile is a flat array of ``side`` * ``side`` numbers by rows; the matrix has rows 0 to ``side`` * ``n`` - 1. Only
one column of tiles meets in a step, so no task holds more than a few tiles. ``stage`` writes what a step leaves, so
the plan does not grow with the number of steps and a lost executor costs one step.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def tiles(entries: DataFrame, side: int) -> DataFrame:
    """Tiles (i, j, tile) of entries (row, col, value); missing entries are 0."""
    place = ((F.col("row") % side) * side + F.col("col") % side).cast("int")
    keyed = entries.groupBy(F.floor(F.col("row") / side).cast("int").alias("i"), F.floor(F.col("col") / side).cast("int").alias("j")).agg(F.map_from_entries(F.collect_list(F.struct(place, F.col("value").cast("double")))).alias("m"))
    return keyed.select("i", "j", F.transform(F.sequence(F.lit(0), F.lit(side * side - 1)), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0.0))).alias("tile"))


def entries(tile: DataFrame, side: int) -> DataFrame:
    """The inverse of ``tiles``, without zeros."""
    rows = tile.select("i", "j", F.posexplode("tile").alias("k", "value")).where("value <> 0")
    return rows.select((F.col("i") * side + F.floor(F.col("k") / side)).cast("long").alias("row"), (F.col("j") * side + F.col("k") % side).cast("long").alias("col"), "value")


def _square(a) -> np.ndarray:
    a = np.asarray(a, float)
    n = int(len(a) ** 0.5)
    return a.reshape(n, n)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _factor(a: pd.Series) -> pd.Series:
    return pd.Series([np.linalg.cholesky(_square(x)).ravel() for x in a])


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _solve_panel(a: pd.Series, diagonal: pd.Series) -> pd.Series:
    return pd.Series([np.linalg.solve(_square(d), _square(x).T).T.ravel() for x, d in zip(a, diagonal)])


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _less_product(a: pd.Series, left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([(_square(x) - _square(p) @ _square(q).T).ravel() for x, p, q in zip(a, left, right)])


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _apply(a: pd.Series, v: pd.Series) -> pd.Series:
    return pd.Series([_square(x) @ np.asarray(y, float) for x, y in zip(a, v)])


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _apply_transposed(a: pd.Series, v: pd.Series) -> pd.Series:
    return pd.Series([_square(x).T @ np.asarray(y, float) for x, y in zip(a, v)])


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _solve_tile(a: pd.Series, v: pd.Series) -> pd.Series:
    return pd.Series([np.linalg.solve(_square(x), np.asarray(y, float)) for x, y in zip(a, v)])


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _solve_tile_transposed(a: pd.Series, v: pd.Series) -> pd.Series:
    return pd.Series([np.linalg.solve(_square(x).T, np.asarray(y, float)) for x, y in zip(a, v)])


def cholesky(a: DataFrame, n: int, stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Lower factor, in tiles with i >= j, of a positive matrix given by its tiles with i >= j; ``n`` tiles a side.

    Each step factors one diagonal tile, solves the column below it and takes the column's products from
    all tiles to its right.
    """
    rest, done = a.where("i >= j"), None
    for k in range(n):
        diagonal = rest.where((F.col("i") == k) & (F.col("j") == k)).select(_factor("tile").alias("d"))
        column = rest.where((F.col("j") == k) & (F.col("i") > k)).crossJoin(F.broadcast(diagonal)).select("i", "j", _solve_panel("tile", "d").alias("tile"))
        column = stage(column.unionByName(diagonal.select(F.lit(k).alias("i"), F.lit(k).alias("j"), F.col("d").alias("tile"))))
        done = column if done is None else done.unionByName(column)
        below = column.where(F.col("i") > k)
        # Tiles that are all zero need not be there, and products may fill them.
        left, right = below.select("i", F.col("tile").alias("p")), below.select(F.col("i").alias("j"), F.col("tile").alias("q"))
        both = left.join(right, F.col("i") >= F.col("j"))
        tile = F.coalesce("tile", F.transform("p", lambda x: F.lit(0.0)))
        rest = rest.where(F.col("j") > k).join(both, ["i", "j"], "full")
        rest = stage(rest.select("i", "j", F.when(F.col("p").isNull(), F.col("tile")).otherwise(_less_product(tile, F.coalesce("p", tile), F.coalesce("q", tile))).alias("tile")))
    return done


def cholesky_solve(factor: DataFrame, b: DataFrame, n: int, stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """x of L L' x = b: parts (i, part) of the vector, tile row by tile row forwards, then backwards."""
    minus = lambda x, y: F.zip_with(x, y, lambda p, q: p - q)
    rest, known = b, []
    for forwards in (True, False):
        known = []
        for k in range(n) if forwards else range(n - 1, -1, -1):
            diagonal = factor.where((F.col("i") == k) & (F.col("j") == k)).select(F.col("tile").alias("d"))
            solve = _solve_tile if forwards else _solve_tile_transposed
            part = stage(rest.where(F.col("i") == k).crossJoin(F.broadcast(diagonal)).select("i", solve("d", "part").alias("part")))
            known.append(part)
            x = part.select(F.col("part").alias("x"))
            if forwards:
                moved = factor.where((F.col("j") == k) & (F.col("i") > k)).crossJoin(F.broadcast(x)).select("i", _apply("tile", "x").alias("m"))
            else:
                moved = factor.where((F.col("i") == k) & (F.col("j") < k)).crossJoin(F.broadcast(x)).select(F.col("j").alias("i"), _apply_transposed("tile", "x").alias("m"))
            rest = stage(rest.where(F.col("i") != k).join(moved, "i", "left").select("i", F.when(F.col("m").isNull(), F.col("part")).otherwise(minus("part", "m")).alias("part")))
        rest = known[0]
        for p in known[1:]:
            rest = rest.unionByName(p)
        rest = stage(rest)
    return rest


def inverse_diagonal(factor: DataFrame, n: int, side: int, stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(i, part): the diagonal of the inverse from the factor. The inverse factor is built tile row by tile row; its columns' squares add up."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def next_tile(d: pd.Series, s: pd.Series, same: pd.Series) -> pd.Series:
        eye = np.eye(side)
        return pd.Series([np.linalg.solve(_square(a), (eye if e else 0 * eye) - (0 if b is None else _square(b))).ravel() for a, b, e in zip(d, s, same)])

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def product(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([(_square(x) @ _square(y)).ravel() for x, y in zip(a, b)])

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def squares(a: pd.Series) -> pd.Series:
        return pd.Series([(_square(x) ** 2).sum(0) for x in a])

    done = None
    for k in range(n):
        d = factor.where((F.col("i") == k) & (F.col("j") == k)).select(F.col("tile").alias("d"))
        if done is None:
            sums = d.sparkSession.createDataFrame([], "j int, s array<double>")
        else:
            row = factor.where((F.col("i") == k) & (F.col("j") < k)).select(F.col("j").alias("m"), F.col("tile").alias("l"))
            parts = done.select(F.col("i").alias("m"), "j", "tile").join(row, "m").select("j", product("l", "tile").alias("x"))
            sums = parts.select("j", F.posexplode("x").alias("p", "x")).groupBy("j", "p").agg(F.sum("x").alias("x")).groupBy("j").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "x"))), lambda v: v["x"]).alias("s"))
        all_j = d.sparkSession.range(k + 1).select(F.col("id").cast("int").alias("j"))
        new = all_j.join(sums, "j", "left").crossJoin(F.broadcast(d)).select(F.lit(k).alias("i"), "j", next_tile("d", "s", F.col("j") == k).alias("tile"))
        new = stage(new)
        done = new if done is None else done.unionByName(new)
    parts = done.select(F.col("j").alias("i"), F.posexplode(squares("tile")).alias("p", "x"))
    total = parts.groupBy("i", "p").agg(F.sum("x").alias("x"))
    return total.groupBy("i").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "x"))), lambda v: v["x"]).alias("part"))


def eigen_blocks(m: DataFrame, keys: list[str]) -> DataFrame:
    """Eigenvalues and vectors of the symmetric matrix (row, col, value) of each key: (keys, mode, eigenvalue, vector). A key's matrix is a block of bounded size, such as one frequency."""
    kinds = ", ".join(f"{k} {m.schema[k].dataType.simpleString()}" for k in keys)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        side = np.unique(np.concatenate([pdf["row"], pdf["col"]]))
        a = np.zeros((len(side), len(side)))
        a[np.searchsorted(side, pdf["row"]), np.searchsorted(side, pdf["col"])] = pdf["value"]
        w, v = np.linalg.eigh((a + a.T) / 2)
        out = pd.DataFrame({"mode": np.arange(len(w)), "eigenvalue": w[::-1], "vector": list(v[:, ::-1].T)})
        for k in keys:
            out[k] = pdf[k].iloc[0]
        return out[[*keys, "mode", "eigenvalue", "vector"]]

    return m.groupBy(*keys).applyInPandas(run, f"{kinds}, mode int, eigenvalue double, vector array<double>")


def solve_from_eigen(modes: DataFrame, dirty: DataFrame, keys: list[str], least: float = 1e-12) -> DataFrame:
    """Clean values and their noise from the modes (mode, eigenvalue, vector) of the inverse noise and the dirty vector (p, dirty): modes below ``least`` are dropped."""
    long = modes.where(F.col("eigenvalue") > least).select(*keys, "mode", "eigenvalue", F.posexplode("vector").alias("p", "v"))
    amp = long.join(dirty.select(*keys, F.col("p").cast("int").alias("p"), "dirty"), [*keys, "p"]).groupBy(*keys, "mode").agg(F.sum(F.col("v") * F.col("dirty")).alias("a"))
    back = long.join(amp, [*keys, "mode"])
    return back.groupBy(*keys, "p").agg(F.sum(F.col("v") * F.col("a") / F.col("eigenvalue")).alias("value"), F.sum(F.col("v") ** 2 / F.col("eigenvalue")).alias("noise"))


def condition_numbers(m: DataFrame, keys: list[str]) -> DataFrame:
    """Condition number of each key's matrix (row, col, value) after scaling by the root of its diagonal."""
    d = m.where("row = col").select(*keys, F.col("row").alias("_r"), F.col("value").alias("_d"))
    rows, cols = d.withColumnsRenamed({"_r": "row", "_d": "_x"}), d.withColumnsRenamed({"_r": "col", "_d": "_y"})
    scaled = m.join(rows, [*keys, "row"]).join(cols, [*keys, "col"]).withColumn("value", F.col("value") / F.sqrt(F.col("_x") * F.col("_y")))
    return eigen_blocks(scaled.select(*keys, "row", "col", "value"), keys).groupBy(*keys).agg((F.max(F.abs("eigenvalue")) / F.min(F.abs("eigenvalue"))).alias("condition"))
