"""Frequency covariance, modes and their removal; correlation functions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Channels of a covariance that may come to the driver for a decomposition.
MOST_CHANNELS = 4096
#: Sums that a task holds before it hands them over.
MOST_CELLS = 1 << 25


def pair_sums(spectra: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, chan, chan2, xx, ww): sums over rows of x x' and w w' for every pair of channels of the row's list ``s`` of (c, x, w).

    A task multiplies its rows' matrices and hands over one sum for each pair of channels and key, so what is
    exchanged does not grow with the rows. Sums are handed over early when a task holds many keys.
    """
    kinds = {k: spectra.schema[k].dataType.simpleString() for k in keys}
    chan = spectra.schema["s"].dataType.elementType["c"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[dict, np.ndarray, np.ndarray]] = {}
        cells = 0

        def rows() -> Iterator[pa.RecordBatch]:
            for key, (index, xx, ww) in held.items():
                c = np.array(list(index))
                i, j = np.nonzero(ww[: len(c), : len(c)])
                own = [pa.array([k] * len(i), schema.field(n).type) for n, k in zip(keys, key)]
                kind = schema.field("s").type.value_type.field("c").type
                yield pa.RecordBatch.from_arrays([*own, pa.array(c[i], kind), pa.array(c[j], kind), pa.array(xx[i, j]), pa.array(ww[i, j])], names=[*keys, "chan", "chan2", "xx", "ww"])

        schema = None
        for batch in batches:
            schema = batch.schema
            listed = batch.column(len(keys))
            starts, flat = listed.offsets.to_numpy(), listed.flatten()
            starts = starts - starts[0]
            c, x, w = (flat.field(n).to_numpy(zero_copy_only=False) for n in ("c", "x", "w"))
            row = np.repeat(np.arange(batch.num_rows), np.diff(starts))
            names = list(zip(*(batch.column(k).to_pylist() for k in range(len(keys))))) if keys else [()] * batch.num_rows
            groups: dict[tuple, list[int]] = {}
            for i, key in enumerate(names):
                groups.setdefault(key, []).append(i)
            for key, members in groups.items():
                at = np.isin(row, members) if len(groups) > 1 else slice(None)
                index, xx, ww = held.setdefault(key, ({}, np.zeros((0, 0)), np.zeros((0, 0))))
                for v in np.unique(c[at]).tolist():
                    index.setdefault(v, len(index))
                if len(index) > len(xx):
                    grow = ((0, 2 * len(index) - len(xx)),) * 2
                    xx, ww = np.pad(xx, grow), np.pad(ww, grow)
                    held[key] = (index, xx, ww)
                    cells = sum(2 * m.size for _, m, _ in held.values())
                place = np.array([index[v] for v in c[at].tolist()], np.int64)
                local = np.unique(row[at], return_inverse=True)[1]
                dense = np.zeros((2, int(local.max(initial=-1)) + 1, len(index)))
                dense[0, local, place], dense[1, local, place] = x[at], w[at]
                n = len(index)
                xx[:n, :n] += dense[0].T @ dense[0]
                ww[:n, :n] += dense[1].T @ dense[1]
            if cells > MOST_CELLS:
                yield from rows()
                held.clear()
                cells = 0
        if schema is not None:
            yield from rows()

    out = spectra.select(*keys, "s").mapInArrow(run, ", ".join([f"{k} {v}" for k, v in kinds.items()] + [f"chan {chan}, chan2 {chan}, xx double, ww double"]))
    return out.groupBy(*keys, "chan", "chan2").agg(F.sum("xx").alias("xx"), F.sum("ww").alias("ww"))


def freq_covariance(maps: DataFrame, pixel: list[str], chan: str = "chan") -> DataFrame:
    """sum (w1 m1)(w2 m2) / sum w1 w2 over pixels, for every pair of channels (chan, chan2).

    A pixel's channels are gathered into one list, whose length is the number of channels; see ``pair_sums``.
    """
    wm = F.when(F.col("weight") >= 1e-20, F.col("weight") * F.col("value")).otherwise(0.0)
    w = F.when(F.col("weight") >= 1e-20, F.col("weight").cast("double")).otherwise(0.0)
    spec = maps.where("value is not null and weight is not null").groupBy(*pixel).agg(F.collect_list(F.struct(F.col(chan).alias("c"), wm.alias("x"), w.alias("w"))).alias("s"))
    return pair_sums(spec, []).select("chan", "chan2", F.try_divide("xx", "ww").alias("cov"))


def masked_covariance(rows: DataFrame, keys: list[str], t: str = "t") -> DataFrame:
    """Sums and counts of products of channels over times at which both are unmasked."""
    one = F.struct(F.col("chan").alias("c"), F.col("value").cast("double").alias("x"), F.lit(1.0).alias("w"))
    spec = rows.where("value is not null").groupBy(*keys, t).agg(F.collect_list(one).alias("s"))
    return pair_sums(spec, keys).select(*keys, "chan", "chan2", F.col("xx").alias("total"), F.col("ww").cast("long").alias("n"))


def matrix(cov: DataFrame, value: str = "cov") -> tuple[list, np.ndarray]:
    """The covariance on the driver; the number of channels is checked."""
    if (n := cov.select("chan").distinct().count()) > MOST_CHANNELS:
        raise ValueError(f"{n} channels are too many for one decomposition")
    pdf = cov.select("chan", "chan2", value).toArrow().to_pandas()
    chans = np.unique(np.concatenate([pdf["chan"], pdf["chan2"]]))
    out = np.zeros((len(chans), len(chans)))
    out[np.searchsorted(chans, pdf["chan"]), np.searchsorted(chans, pdf["chan2"])] = pdf[value].fillna(0).to_numpy(float)
    return chans.tolist(), out


def svd_modes(cov: DataFrame, n: int) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
    """Channels, the n leading singular values and left and right modes; the largest entry of a left mode is positive."""
    chans, c = matrix(cov)
    u, s, v = np.linalg.svd(c)
    sign = np.sign(u[np.abs(u).argmax(0), np.arange(len(c))])
    return chans, s[:n], (u * sign)[:, :n].T, (v * sign[:, None])[:n]


def eigen_modes(cov: DataFrame, n: int) -> tuple[list, np.ndarray, np.ndarray]:
    """Channels, the n largest eigenvalues, in falling order, and their vectors."""
    chans, c = matrix(cov)
    values, vectors = np.linalg.eigh((c + c.T) / 2)
    return chans, values[::-1][:n], vectors[:, ::-1][:, :n].T


def dot(spec: Column, mode: list[float]) -> Column:
    """Sum of an array's unmasked entries times a mode's."""
    pairs = F.zip_with(spec, F.array(*[F.lit(float(x)) for x in mode]), lambda a, b: F.coalesce(a * b, F.lit(0.0)))
    return F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + x)


def subtract_modes(spectra: DataFrame, array: str, modes: list[list[float]], masked: bool = False) -> DataFrame:
    """Removes modes one after another from each array, and gives their amplitudes ``amp0``, ``amp1``, ...

    With ``masked`` an amplitude is divided by the mode's norm over unmasked entries; a norm below 0.01
    masks the whole array. Batches of arrays meet the modes as matrices: as column expressions each
    amplitude would be worked out again for every channel.
    """
    table = np.asarray(modes, float)

    @F.pandas_udf("struct<spec:array<double>,amp:array<double>>")
    def run(column: pd.Series) -> pd.DataFrame:
        x = np.array([np.asarray(v, float) for v in column]).reshape(len(column), table.shape[1])
        ok = np.isfinite(x)
        amps = np.zeros((len(x), len(table)))
        for k, mode in enumerate(table):
            amp = np.where(ok, x, 0) @ mode
            if masked:
                norm = ok @ (mode * mode)
                amp = np.where(norm >= 0.01, amp / np.where(norm > 0, norm, 1), np.nan)
            amps[:, k] = amp
            x = x - amp[:, None] * mode
        plain = lambda a: [[None if np.isnan(v) else v for v in row] for row in a.tolist()]
        return pd.DataFrame({"spec": plain(x), "amp": plain(amps)})

    out = spectra.withColumn("_r", run(F.col(array))).withColumn(array, F.col("_r.spec"))
    return out.withColumns({f"amp{k}": F.col("_r.amp")[k] for k in range(len(table))}).drop("_r")


def mode_amplitudes(rows: DataFrame, modes: DataFrame, keys: list[str], chan: str = "chan") -> DataFrame:
    """Amplitude of each mode (mode, chan, v) in each key of long rows."""
    return rows.join(modes.select("mode", chan, "v"), chan).groupBy(*keys, "mode").agg(F.sum(F.col("value") * F.col("v")).alias("amplitude"))


def project_out(rows: DataFrame, modes: DataFrame, keys: list[str], chan: str = "chan") -> DataFrame:
    """Removes all modes at once from long rows."""
    amp = mode_amplitudes(rows, modes, keys, chan)
    model = amp.join(modes.select("mode", chan, "v"), "mode").groupBy(*keys, chan).agg(F.sum(F.col("amplitude") * F.col("v")).alias("_m"))
    return rows.join(model, [*keys, chan], "left").withColumn("value", F.col("value") - F.coalesce("_m", F.lit(0.0))).drop("_m")


def correlation(maps1: DataFrame, maps2: DataFrame, lags: list[float], reach: int, spacing: float, pixel: tuple[str, str] = ("ri", "di")) -> DataFrame:
    """Weighted correlation of channel pairs in bins of angular lag: pixels meet by offset, up to ``reach`` pixels apart, not all with all."""
    steps = [(i, j, np.hypot(i, j) * spacing) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1)]
    binned = [(i, j, int(np.searchsorted(lags, d, side="right") - 1)) for i, j, d in steps]
    offsets = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(b).alias("lag")) for i, j, b in binned if 0 <= b < len(lags) - 1])).alias("o")
    a = maps1.select(F.col("fi").alias("f1"), *pixel, F.col("value").alias("v1"), F.col("weight").alias("w1"), offsets)
    a = a.select("f1", (F.col(pixel[0]) + F.col("o.i")).alias("_r"), (F.col(pixel[1]) + F.col("o.j")).alias("_d"), "v1", "w1", F.col("o.lag").alias("lag"))
    b = maps2.select(F.col("fi").alias("f2"), F.col(pixel[0]).alias("_r"), F.col(pixel[1]).alias("_d"), F.col("value").alias("v2"), F.col("weight").alias("w2"))
    w = F.col("w1") * F.col("w2")
    return a.join(b, ["_r", "_d"]).groupBy("f1", "f2", "lag").agg(F.try_divide(F.sum(w * F.col("v1") * F.col("v2")), F.sum(w)).alias("corr"), F.sum(w).alias("weight"))


def by_frequency_lag(corr: DataFrame) -> DataFrame:
    """Weighted mean over channel pairs of one frequency lag."""
    return corr.groupBy(F.abs(F.col("f1") - F.col("f2")).alias("df"), "lag").agg(F.try_divide(F.sum(F.col("corr") * F.col("weight")), F.sum("weight")).alias("corr"), F.sum("weight").alias("weight"))


def by_separation(corr: DataFrame, f_lag: float, a_lag: float, edges: list[float]) -> DataFrame:
    """(frequency lag, angular lag) collapsed to bins of separation."""
    from skyquilt.functions.columns import edge_bucket

    r = F.sqrt((F.col("df") * f_lag) ** 2 + (F.col("lag") * a_lag) ** 2)
    return corr.withColumn("bin", edge_bucket(r, edges)).dropna(subset=["bin"]).groupBy("bin").agg(F.try_divide(F.sum(F.col("corr") * F.col("weight")), F.sum("weight")).alias("corr"))


def normalise(cov: DataFrame, value: str = "cov") -> DataFrame:
    """Covariance over the root of the product of its diagonal entries."""
    d = cov.where("chan = chan2").select(F.col("chan").alias("_c"), F.col(value).alias("_d"))
    out = cov.join(d.withColumnsRenamed({"_c": "chan", "_d": "_d1"}), "chan").join(d.withColumnsRenamed({"_c": "chan2", "_d": "_d2"}), "chan2")
    return out.withColumn("corr", F.try_divide(value, F.sqrt(F.col("_d1") * F.col("_d2")))).drop("_d1", "_d2")


def pair_statistics(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean and population deviation over pairs."""
    return values.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("deviation"))


def top_modes(values: DataFrame, n: int) -> DataFrame:
    """The n largest values with their rank; a short list."""
    ranked = values.orderBy(F.desc("value"), "mode").limit(n)
    return ranked.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("value"), "mode")))


def low_rank(c: np.ndarray, m: int) -> np.ndarray:
    """Best approximation of rank m to a symmetric matrix."""
    w, v = np.linalg.eigh((c + c.T) / 2)
    keep = np.argsort(-np.abs(w))[:m]
    return (v[:, keep] * w[keep]) @ v[:, keep].T


def low_rank_correlation(c: np.ndarray, m: int, steps: int = 20) -> np.ndarray:
    """A correlation matrix of rank m plus a diagonal; the diagonal is iterated until it is one."""
    model = c.copy()
    for _ in range(steps):
        part = low_rank(model, m)
        model = c - np.diag(np.diag(c)) + np.diag(np.diag(part))
    return part - np.diag(np.diag(part)) + np.diag(np.diag(c))


def matrix_root(c: np.ndarray, threshold: float = 1e-16) -> np.ndarray:
    """Square root of a positive matrix; smaller eigenvalues are left out."""
    w, v = np.linalg.eigh((c + c.T) / 2)
    keep = w > threshold * w.max()
    return v[:, keep] * np.sqrt(w[keep])


def scaled_inverse(c: np.ndarray) -> tuple[np.ndarray, float]:
    """Inverse after scaling by the diagonal, and the condition number of what was inverted."""
    s = np.sqrt(np.where(np.diag(c) > 0, np.diag(c), 1.0))
    scaled = c / np.outer(s, s)
    return np.linalg.inv(scaled) / np.outer(s, s), float(np.linalg.cond(scaled))
