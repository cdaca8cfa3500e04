"""All eigenvalues and vectors of a large symmetric matrix in tiles by block Jacobi rotations.

The matrix is a table (i, j, tile) of ``n`` by ``n`` tiles of ``side`` rows. In a round every block meets one other
block: the 2 by 2 tiles of a pair are diagonalised in one task, and the rotations meet all tiles of their rows and
columns in a join. After n - 1 rounds, a sweep, each pair has met; sweeps go on until what is off the diagonal has
vanished. A task holds no more than four tiles and two rotations, and a lost executor costs one round.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sweeps after which the iteration is given up; a handful is usual.
MOST_SWEEPS = 30
_TILES = "kind int, i int, j int, tile array<double>"


def rounds(n: int) -> list[list[tuple[int, int]]]:
    """A tournament: in each round every block has one partner, or none for one of an odd number; all pairs meet once."""
    ring = list(range(n)) + [-1] * (n % 2)
    out = []
    for _ in range(max(1, len(ring) - 1)):
        pairs = [(ring[k], ring[-1 - k]) for k in range(len(ring) // 2)]
        out.append([(min(p), max(p)) if min(p) >= 0 else (max(p), max(p)) for p in pairs])
        ring = [ring[0], ring[-1], *ring[1:-1]]
    return out


def _pair(pairs: list[tuple[int, int]]) -> dict[int, int]:
    return {b: k for k, p in enumerate(pairs) for b in p}


def _lookup(block: Column, table: dict[int, int]) -> Column:
    return F.element_at(F.array(*[F.lit(table[b]) for b in range(len(table))]), block + 1)


def _block(cells: pd.DataFrame, rows: tuple[int, ...], cols: tuple[int, ...], side: int) -> np.ndarray:
    out = np.zeros((len(rows) * side, len(cols) * side))
    for i, j, tile in zip(cells["i"], cells["j"], cells["tile"], strict=True):
        a, b = rows.index(i), cols.index(j)
        out[a * side : (a + 1) * side, b * side : (b + 1) * side] = np.asarray(tile).reshape(side, side)
    return out


def _rotations(tiles: DataFrame, pairs: list[tuple[int, int]], side: int) -> DataFrame:
    """(pair, rotation): eigenvectors of every pair's own tiles, by falling eigenvalue, signs chosen so that reruns agree."""
    table = _pair(pairs)
    own = tiles.where("kind = 0").withColumn("pair", _lookup(F.col("i"), table)).where(F.col("pair") == _lookup(F.col("j"), table))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        k = int(pdf["pair"].iloc[0])
        blocks = tuple(dict.fromkeys(pairs[k]))
        a = _block(pdf, blocks, blocks, side)
        v = np.linalg.eigh((a + a.T) / 2)[1][:, ::-1]
        v = v * np.where(v[np.abs(v).argmax(0), np.arange(len(v))] < 0, -1, 1)
        return pd.DataFrame({"pair": [k], "rotation": [v.ravel()]})

    return own.groupBy("pair").applyInPandas(run, "pair int, rotation array<double>")


def _turned(tiles: DataFrame, pairs: list[tuple[int, int]], side: int) -> DataFrame:
    """Tiles after a round: Q' A Q for the matrix (kind 0), V Q for the vectors (kind 1)."""
    table = _pair(pairs)
    q = _rotations(tiles, pairs, side)
    group = F.when(F.col("kind") == 0, _lookup(F.col("i"), table)).otherwise(F.col("i"))
    sets = tiles.withColumn("a", group).withColumn("b", _lookup(F.col("j"), table)).groupBy("kind", "a", "b").agg(F.collect_list(F.struct("i", "j", "tile")).alias("cells"))
    left = q.select(F.lit(0).alias("kind"), F.col("pair").alias("a"), F.col("rotation").alias("qa"))
    both = sets.join(left, ["kind", "a"], "left").join(q.select(F.col("pair").alias("b"), F.col("rotation").alias("qb")), "b")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for kind, a, b, cells, qa, qb in zip(*(pdf[c] for c in ("kind", "a", "b", "cells", "qa", "qb")), strict=True):
                rows = tuple(dict.fromkeys(pairs[a])) if kind == 0 else (a,)
                cols = tuple(dict.fromkeys(pairs[b]))
                m = _block(pd.DataFrame([dict(i=c["i"], j=c["j"], tile=c["tile"]) for c in cells]), rows, cols, side)
                m = m @ np.asarray(qb).reshape(len(cols) * side, -1)
                if kind == 0:
                    m = np.asarray(qa).reshape(len(rows) * side, -1).T @ m
                for x, i in enumerate(rows):
                    for y, j in enumerate(cols):
                        out.append((kind, i, j, m[x * side : (x + 1) * side, y * side : (y + 1) * side].ravel()))
            yield pd.DataFrame(out, columns=["kind", "i", "j", "tile"])

    return both.mapInPandas(run, _TILES)


def _off(tiles: DataFrame, side: int) -> tuple[float, float]:
    """Sums of squares off the diagonal, and of all, of the matrix."""
    total = F.aggregate("tile", F.lit(0.0), lambda s, x: s + x * x)
    own = F.aggregate(F.sequence(F.lit(0), F.lit(side - 1)), F.lit(0.0), lambda s, k: s + F.pow(F.element_at("tile", k * (side + 1) + 1), F.lit(2.0)))
    sums = tiles.where("kind = 0").agg(F.sum(F.when(F.col("i") == F.col("j"), total - own).otherwise(total)), F.sum(total)).first()
    return float(sums[0] or 0), float(sums[1] or 0)


def eigen(stage: Callable[[DataFrame], DataFrame], tiles: DataFrame, n: int, side: int, close: float = 1e-12) -> DataFrame:
    """(kind, i, j, tile) of the rotated matrix (kind 0, diagonal up to ``close`` of its norm) and of its vectors (kind 1).

    ``tiles`` holds all n * n tiles, or those with i >= j; tiles that are all zero may be left out.
    """
    spark = tiles.sparkSession
    zero = [0.0] * (side * side)

    def whole(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            off = pdf[pdf["i"] > pdf["j"]]
            turned = [np.asarray(t).reshape(side, side).T.ravel() for t in off["tile"]]
            yield pd.concat([pdf, pd.DataFrame({"i": off["j"], "j": off["i"], "tile": turned})], ignore_index=True)

    lower = tiles.where("i >= j").select("i", "j", "tile").mapInPandas(whole, "i int, j int, tile array<double>")
    every = spark.range(n).select(F.col("id").cast("int").alias("i")).crossJoin(F.broadcast(spark.range(n).select(F.col("id").cast("int").alias("j"))))
    eye = F.transform(F.sequence(F.lit(0), F.lit(side * side - 1)), lambda k: F.when(k % (side + 1) == 0, 1.0).otherwise(0.0))
    blank = F.transform(F.sequence(F.lit(0), F.lit(side * side - 1)), lambda k: F.lit(0.0))
    now = every.join(lower, ["i", "j"], "left").select(F.lit(0).alias("kind"), "i", "j", F.coalesce("tile", blank).alias("tile"))
    now = stage(now.unionByName(every.select(F.lit(1).alias("kind"), "i", "j", F.when(F.col("i") == F.col("j"), eye).otherwise(blank).alias("tile"))))
    for _ in range(MOST_SWEEPS):
        for pairs in rounds(n):
            now = stage(_turned(now, pairs, side))
        off, total = _off(now, side)
        if off <= close**2 * total:
            return now
    raise RuntimeError("block Jacobi: not diagonal after the most sweeps")


def eigenvalues(rotated: DataFrame, side: int) -> DataFrame:
    """(column, eigenvalue) from what ``eigen`` returns."""
    own = rotated.where("kind = 0 and i = j").select("i", F.posexplode("tile").alias("k", "eigenvalue")).where(F.col("k") % (side + 1) == 0)
    return own.select((F.col("i").cast("long") * side + F.floor(F.col("k") / (side + 1))).alias("column"), "eigenvalue")


def eigenvectors(rotated: DataFrame, side: int) -> DataFrame:
    """(row, column, value) from what ``eigen`` returns."""
    v = rotated.where("kind = 1").select("i", "j", F.posexplode("tile").alias("k", "value"))
    return v.select((F.col("i").cast("long") * side + F.floor(F.col("k") / side)).alias("row"), (F.col("j").cast("long") * side + F.col("k") % side).alias("column"), "value")
