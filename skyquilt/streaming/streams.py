"""Structured Streaming forms of the time-stream steps: rebinning, flags, accumulation and incremental reading."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_new_files(spark: SparkSession, path: str, schema, most_files: int = 100) -> DataFrame:
    """Files as they arrive; the checkpoint of the query remembers which were read."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", most_files).parquet(path)


def rebin(stream: DataFrame, keys: list[str], width: str, late: str, ts: str = "ts", slide: str | None = None) -> DataFrame:
    """Mean in tumbling or sliding time windows; samples later than ``late`` are left out."""
    win = F.window(ts, width, slide) if slide else F.window(ts, width)
    out = stream.withWatermark(ts, late).groupBy(win.alias("w"), *keys).agg(F.avg("value").alias("value"), F.count("value").alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "value", "n")


def scans(stream: DataFrame, keys: list[str], gap: str, late: str, ts: str = "ts") -> DataFrame:
    """Sessions: blocks of samples that follow each other within ``gap``."""
    out = stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(F.count("*").alias("n"), F.avg("value").alias("value"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "value")


def accumulate(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Running sums for gains: corr, norm and their ratio, in update mode."""
    out = stream.groupBy(*keys).agg(F.sum(F.col("value") * F.col("template")).alias("corr"), F.sum(F.col("template") * F.col("template")).alias("norm"))
    return out.withColumn("gain", F.try_divide("corr", "norm"))


def flag_jumps(stream: DataFrame, key: str, sigma: float = 5.0, memory: int = 200) -> DataFrame:
    """Marks samples beyond sigma deviations of the running mean of their key's earlier samples; state is count, mean and spread."""

    def run(k, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, mean, m2 = state.get if state.exists else (0, 0.0, 0.0)
        for pdf in frames:
            pdf = pdf.sort_values("ts")
            flags = []
            for v in pdf["value"]:
                if pd.isna(v):  # a masked sample neither flags nor counts
                    flags.append(False)
                    continue
                dev = (m2 / n) ** 0.5 if n > 1 else 0.0
                bad = n >= 10 and abs(v - mean) > sigma * dev
                flags.append(bool(bad))
                if not bad:
                    n = min(n + 1, memory)
                    step = v - mean
                    mean += step / n
                    m2 = m2 * (1 - 1 / n) * (n / max(n - 1, 1)) + step * (v - mean) if n < memory else m2 * (1 - 1 / memory) + step * (v - mean)
            yield pd.DataFrame({key: k[0], "ts": pdf["ts"], "value": pdf["value"], "flag": flags})
        state.update((n, mean, m2))

    kind = stream.schema[key].dataType.simpleString()
    return stream.select(key, "ts", "value").groupBy(key).applyInPandasWithState(run, f"{key} {kind}, ts timestamp, value double, flag boolean", "n long, mean double, m2 double", "append", "NoTimeout")
