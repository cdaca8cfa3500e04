"""Uniform sharding with exact shard sizes by a hypergeometric communication matrix."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Stage

#: numpy draws a hypergeometric exactly below this population; above it the mass function is summed.
NUMPY_POPULATION = 10**9


def _wide_draw(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """One hypergeometric draw from a population too large for numpy: inversion over the mass around the mode."""
    low, high = max(0, n - bad), min(n, good)
    mode = min(high, max(low, (n + 1) * (good + 1) // (good + bad + 2)))
    sd = math.sqrt(max(1.0, n * (good / (good + bad)) * (bad / (good + bad)) * (good + bad - n) / max(1, good + bad - 1)))
    a, b = max(low, mode - int(14 * sd) - 20), min(high, mode + int(14 * sd) + 20)
    k = np.arange(a, b, dtype=float)  # log p(k+1) - log p(k)
    steps = np.log(good - k) + np.log(n - k) - np.log(k + 1) - np.log(bad - n + k + 1)
    mass = np.concatenate([[0.0], np.cumsum(steps)])
    mass = np.cumsum(np.exp(mass - mass.max()))
    return a + int(np.searchsorted(mass, rng.random() * mass[-1], side="right"))


def draw(rng: np.random.Generator, room: np.ndarray, n: int) -> np.ndarray:
    """How many of ``n`` rows go to each cell when a uniform permutation fills cells with ``room`` places."""
    total = int(room.sum())
    if n == 0 or n == total:
        return room.copy() if n else np.zeros_like(room)
    if total < NUMPY_POPULATION:
        return rng.multivariate_hypergeometric(room, n, method="marginals")
    out = np.zeros_like(room)
    for i, r in enumerate(room):
        total -= int(r)
        out[i] = int(r) if total == 0 else _wide_draw(rng, int(r), total, n) if n and r else 0
        out[i] = min(out[i], n) if total == 0 else out[i]
        n -= int(out[i])
        if total and total < NUMPY_POPULATION:
            out[i + 1 :] = draw(rng, room[i + 1 :], n)
            break
    return out


def matrix_row(before: np.ndarray, room: np.ndarray, p: int, seed: int) -> np.ndarray:
    """Row p of the communication matrix, drawn by the task that needs it.

    ``before[i]`` counts the rows of partitions below i. Ranges of partitions are halved; each half's
    counts come from a generator seeded by the range, so all tasks agree on the matrix without it being
    held anywhere: its row sums are the partition sizes, its column sums the cell sizes.
    """
    low, high = 0, len(before) - 1
    while high - low > 1:
        mid = (low + high) // 2
        left = draw(np.random.default_rng([seed, low, high]), room, int(before[mid] - before[low]))
        low, high, room = (low, mid, left) if p < mid else (mid, high, room - left)
    return room


def shard_uniform(docs: DataFrame, n_shards: int, *, seed: int = 7, cell_rows: int = 20_000, staged: bool = True) -> DataFrame:
    """Deals all rows into ``n_shards`` by a uniform random permutation; shard sizes differ by one at most.

    Returns columns shard int, slot long (gapless from 0 in a shard) and ``row``, a struct of all input
    columns (so no name can clash). A shard is divided into cells of about ``cell_rows`` rows, each one
    task's work: (1) count the rows of every source partition; (2) every task draws its row of the
    partition-to-cell matrix and labels its rows in a random order; (3) one exchange by cell; (4) a
    random order within each cell gives the slots. Only counts reach the driver: one number for each
    source partition.

    The source partitions must be the same in both passes: files read by Spark are; anything else is
    first written to the shared folder (``staged``). A task whose row count differs from the counted one
    raises an error rather than dealing rows twice.

    Nulls, empty texts and repeated rows are rows like others; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    if staged:
        rows = Stage(spark, "shard").write(rows, "rows")
    counted = {r[0]: r[1] for r in rows.groupBy(F.spark_partition_id().alias("p")).count().collect()}
    total, parts = sum(counted.values()), max(counted, default=0) + 1
    before = np.concatenate([[0], np.cumsum([counted.get(p, 0) for p in range(parts)])]).astype(np.int64)
    cells = max(1, math.ceil(total / n_shards / cell_rows))
    room = np.array([s // cells + (c < s % cells) for s in (total // n_shards + (k < total % n_shards) for k in range(n_shards)) for c in range(cells)], dtype=np.int64)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, at, cell, rng = TaskContext.get().partitionId(), 0, None, None
        for batch in batches:
            if cell is None:
                n = int(before[p + 1] - before[p]) if p < parts else 0
                rng = np.random.default_rng([seed, 1, p])
                cell = np.repeat(np.arange(len(room), dtype=np.int32), matrix_row(before, room, p, seed)) if n else np.zeros(0, np.int32)
                rng.shuffle(cell)
            end = at + batch.num_rows
            if end > len(cell):
                raise RuntimeError(f"partition {p} has more rows than were counted; stage the input first")
            extra = [pa.array(cell[at:end]), pa.array(rng.integers(-(2**63), 2**63, batch.num_rows)), pa.array(np.arange(at, end) + (p << 40))]
            at = end
            yield pa.RecordBatch.from_arrays([batch.column(0), *extra], names=["row", "cell", "key", "place"])
        if cell is not None and at != len(cell):
            raise RuntimeError(f"partition {p} has fewer rows than were counted; stage the input first")

    schema = T.StructType([*rows.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("key", T.LongType()), T.StructField("place", T.LongType())])
    dealt = rows.mapInArrow(label, schema).repartition(len(room), "cell")
    shard, c = F.expr(f"cell div {cells}").cast("int"), F.expr(f"cell % {cells}").cast("long")
    size = F.lit(total // n_shards) + F.when(shard < total % n_shards, 1).otherwise(0)
    first = c * F.floor(size / cells) + F.least(c, size % cells)
    rank = F.row_number().over(Window.partitionBy("cell").orderBy("key", "place"))
    return dealt.select(shard.alias("shard"), (first + rank - 1).cast("long").alias("slot"), "row")


def op3_hypergeometric_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7 under the law ``rows``: a uniform permutation cut into equal counts."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.coalesce(F.col("row.text"), F.lit("")).cast("binary")
    return shard_uniform(docs, 8, staged=False).select(
        F.col("row.doc_id").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
