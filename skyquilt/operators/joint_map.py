"""Maps from noise that joins channels: P' N^-1 P over all (channel, pixel) rows in tiles, and the clean map from it.

Samples are rows (scan, chan, t, p, value, var) of one polarisation and band, with a column ``weight`` where a sample
is spread over several pixels. The unknowns are the (chan, p) that data touch, numbered by channel and pixel, so that a
block of rows is a stretch of the sky in one channel. A scan's noise is thermal noise and modes (``NoiseModel``), so
its share of the inverse covariance is P' W P - B B' with B of as many columns as the scan has mode amplitudes. B is
cut into blocks of rows, whose products are summed tile by tile over all scans of a task, so neither B nor a list of
pixel pairs is kept or exchanged. A task holds one scan's B and a bounded number of tiles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import factor
from .noise_model import NoiseModel, scan_core, thermal_weights, weighed

#: Mode amplitudes of a scan that one task may solve for; longer scans are to be cut.
MOST_AMPLITUDES = 4096
#: Numbers that a task's tiles may hold before it hands them over.
MOST_CELLS = 1 << 23

Stage = Callable[[DataFrame], DataFrame]


def unknowns(samples: DataFrame) -> DataFrame:
    """(chan, p, row): cells with data, numbered by channel, then pixel. Ordered as a whole are only the channels' counts."""
    touched = samples.where("value is not null")
    if "weight" in samples.columns:
        touched = touched.where("weight <> 0")
    cells = touched.select("chan", "p").distinct()
    before = cells.groupBy("chan").agg(F.count("*").alias("_n")).select("chan", (F.sum("_n").over(Window.orderBy("chan")) - F.col("_n")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("chan").orderBy("p")) - 1
    return cells.withColumn("row", place).join(before, "chan").select("chan", "p", (F.col("row") + F.col("_before")).cast("long").alias("row"))


def pointed(samples: DataFrame, rows: DataFrame) -> DataFrame:
    """(scan, chan, t, row, weight, value, w): every sample's cells; masked samples have none."""
    weight = F.col("weight") if "weight" in samples.columns else F.lit(1.0)
    return thermal_weights(samples.withColumn("weight", weight)).join(rows, ["chan", "p"], "left").select("scan", "chan", "t", "row", "weight", "value", "w")


def _scans(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Whole scans of rows that are sorted by scan."""
    rest: list[pd.DataFrame] = []
    for pdf in frames:
        scan = pdf["scan"].to_numpy()
        if not len(scan):
            continue
        cuts = [0, *(np.flatnonzero(scan[1:] != scan[:-1]) + 1).tolist(), len(scan)]
        for a, b in zip(cuts, cuts[1:]):
            if rest and rest[0]["scan"].iloc[0] != scan[a]:
                yield pd.concat(rest) if len(rest) > 1 else rest[0]
                rest = []
            rest.append(pdf.iloc[a:b])
    if rest:
        yield pd.concat(rest) if len(rest) > 1 else rest[0]


def scan_factors(placed: DataFrame, model: NoiseModel, n_chan: int, side: int) -> DataFrame:
    """(part, i, j, tile): each task's sums of P' W P - B B' over its scans, tiles with i >= j; as j = -1, parts of the dirty map.

    Channels are 0 to ``n_chan`` - 1.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        held: dict[tuple[int, int], np.ndarray] = {}

        def rows() -> pd.DataFrame:
            out = pd.DataFrame([(part, i, j, tile.ravel()) for (i, j), tile in held.items()], columns=["part", "i", "j", "tile"])
            held.clear()
            return out

        def tile(i: int, j: int) -> np.ndarray:
            if (i, j) not in held:
                held[i, j] = np.zeros((side, side) if j >= 0 else side)
            return held[i, j]

        for pdf in _scans(frames):
            t, at = np.unique(pdf["t"].to_numpy(), return_inverse=True)
            if n_chan * model.time_modes + len(t) * (len(model.frequency_modes) + (model.common is not None)) > MOST_AMPLITUDES:
                raise ValueError(f"scan {pdf['scan'].iloc[0]} has more than {MOST_AMPLITUDES} mode amplitudes: cut it")
            chan = pdf["chan"].to_numpy()
            w, d = np.zeros((n_chan, len(t))), np.zeros((n_chan, len(t)))
            w[chan, at], d[chan, at] = pdf["w"].to_numpy(), np.nan_to_num(pdf["value"].to_numpy(float))
            u, f, core = scan_core(model, t.astype(float), w)
            place, weight = pdf["row"].to_numpy(float), pdf["weight"].to_numpy(float)
            good = ~np.isnan(place) & (pdf["w"].to_numpy() > 0) & (weight != 0)
            row, cell = np.unique(place[good].astype(np.int64), return_inverse=True)
            c, k, weight = chan[good], at[good], weight[good]
            block, inner = row // side, row % side
            inverse = core
            if len(core):
                seen = np.zeros((len(row), len(core)))
                for m in range(len(u)):
                    np.add.at(seen, (cell, c * len(u) + m), weight * w[c, k] * u[m, k])
                for m in range(len(f)):
                    np.add.at(seen, (cell, n_chan * len(u) + m * len(t) + k), weight * w[c, k] * f[m, c])
                seen = np.linalg.solve(np.linalg.cholesky(core), seen.T).T
                inverse = np.linalg.inv(core)
            dirty = np.bincount(cell, weight * weighed(u, f, inverse, w, d)[c, k], len(row))
            edges = np.searchsorted(block, np.unique(block)).tolist() + [len(row)]
            spans = list(zip(edges, edges[1:]))
            for x, (a, b) in enumerate(spans):
                i = int(block[a])
                tile(i, -1)[inner[a:b]] += dirty[a:b]
                for a2, b2 in spans[: x + 1] if len(core) else []:
                    tile(i, int(block[a2]))[inner[a:b, None], inner[a2:b2]] -= seen[a:b] @ seen[a2:b2].T
                    if len(held) * side * side > MOST_CELLS:
                        yield rows()
            # Thermal noise joins only cells that one sample touches: each with itself, with the next of its sample, and so on.
            sample = c * len(t) + k
            order = np.argsort(sample, kind="stable")
            sample, cell, value = sample[order], cell[order], weight[order] * np.sqrt(w[c, k][order])
            for step in range(len(sample)):
                same = np.flatnonzero(sample[step:] == sample[: len(sample) - step])
                if not len(same):
                    break
                one, two, both = cell[same], cell[same + step], value[same] * value[same + step]
                if step:
                    one, two, both = np.concatenate([one, two]), np.concatenate([two, one]), np.concatenate([both, both])
                keep = block[one] >= block[two]
                one, two, both = one[keep], two[keep], both[keep]
                for i, j in sorted(set(zip(block[one].tolist(), block[two].tolist()))):
                    mine = (block[one] == i) & (block[two] == j)
                    np.add.at(tile(i, j), (inner[one[mine]], inner[two[mine]]), both[mine])
                    if len(held) * side * side > MOST_CELLS:
                        yield rows()
        yield rows()

    return placed.repartition("scan").sortWithinPartitions("scan").mapInPandas(run, "part int, i int, j int, tile array<double>")


def dirty_map(factors: DataFrame, side: int) -> DataFrame:
    """(row, dirty): P' N^-1 d."""
    long = factors.where("j = -1").select("i", F.posexplode("tile").alias("_k", "_d"))
    return long.groupBy((F.col("i").cast("long") * side + F.col("_k")).alias("row")).agg(F.sum("_d").alias("dirty"))


def sum_tiles(stage: Stage, partial: DataFrame, fan: int = 64) -> DataFrame:
    """(i, j, tile): tiles of all parts added up, about ``fan`` parts at a time, so that no group is larger however many tasks there were."""
    most = partial.agg(F.max("part")).first()[0]

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": [pdf["part"].iloc[0]], "i": [pdf["i"].iloc[0]], "j": [pdf["j"].iloc[0]], "tile": [np.sum(np.stack(pdf["tile"].tolist()), axis=0)]})

    while True:
        most = most // fan if most else 0
        partial = stage(partial.withColumn("part", F.expr(f"cast(part div {fan} as int)")).groupBy("part", "i", "j").applyInPandas(add, "part int, i int, j int, tile array<double>"))
        if not most:
            return partial.select("i", "j", "tile")


def inverse_noise(stage: Stage, factors: DataFrame, n: int, side: int, prior: float) -> DataFrame:
    """Tiles with i >= j of P' N^-1 P plus the prior; rows that fill up the last tile are 1 on the diagonal."""
    row = F.col("id")
    diagonal = factors.sparkSession.range(-(-n // side) * side).select(row.alias("row"), row.alias("col"), F.when(row < n, prior).otherwise(1.0).alias("value"))
    own = factor.tiles(diagonal, side).select(F.lit(0).alias("part"), "i", "j", "tile")
    return sum_tiles(stage, factors.where("j >= 0").unionByName(own))


def tile_entries(tiles: DataFrame, n: int, side: int) -> DataFrame:
    """(row, col, value) of all rows and columns from the tiles with i >= j."""
    low = factor.entries(tiles, side).where((F.col("row") < n) & (F.col("col") < n))
    upper = low.where(F.floor(F.col("row") / side) > F.floor(F.col("col") / side)).select(F.col("col").alias("row"), F.col("row").alias("col"), "value")
    return low.unionByName(upper)


def vector_parts(vector: DataFrame, value: str, side: int) -> DataFrame:
    """(i, part): a vector (row, value) in parts of ``side``; rows that are missing are 0."""
    keyed = vector.groupBy(F.floor(F.col("row") / side).cast("int").alias("i")).agg(F.map_from_entries(F.collect_list(F.struct((F.col("row") % side).cast("int"), F.col(value)))).alias("m"))
    return keyed.select("i", F.transform(F.sequence(F.lit(0), F.lit(side - 1)), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0.0))).alias("part"))


def clean_rows(stage: Stage, tiles: DataFrame, dirty: DataFrame, n: int, side: int, noise: bool = True) -> DataFrame:
    """(row, value, noise): the solution of the map equation and the diagonal of its covariance, from one factorisation in tiles."""
    count = -(-n // side)
    lower = stage(factor.cholesky(tiles, count, stage))
    parts = factor.cholesky_solve(lower, stage(vector_parts(dirty, "dirty", side)), count, stage)
    flat = lambda df, name: df.select("i", F.posexplode("part").alias("_k", name)).select((F.col("i").cast("long") * side + F.col("_k")).alias("row"), name)
    out = flat(parts, "value").where(F.col("row") < n)
    if noise:
        out = out.join(flat(factor.inverse_diagonal(lower, count, side, stage), "noise"), "row")
    return out


def joint_map(stage: Stage, samples: DataFrame, model: NoiseModel, n_chan: int, *, side: int = 256, prior: float = 1e-4, cells: DataFrame | None = None, noise: bool = True) -> DataFrame:
    """(chan, p, dirty, value, noise) of all cells that data touch, or of ``cells`` (chan, p), where the others are null.

    Cells without hits take no part in the solution. ``prior`` is the inverse of the variance that a cell has without
    data, which also settles what the modes leave undetermined.
    """
    rows = stage(unknowns(samples))
    n = rows.count()
    factors = stage(scan_factors(pointed(samples, rows), model, n_chan, side))
    dirty = stage(dirty_map(factors, side))
    tiles = inverse_noise(stage, factors, n, side, prior)
    clean = clean_rows(stage, tiles, dirty, n, side, noise)
    out = rows.join(dirty, "row").join(clean, "row").drop("row")
    return out if cells is None else cells.select("chan", "p").join(out, ["chan", "p"], "left")
