"""Helpers shared by the training-data operators: staged tables, text batches, components."""

from __future__ import annotations

import contextlib
import gc
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows handed to a Python worker at once; long texts make large batches.
BATCH_ROWS = 1000
#: Links that one task may contract; more are contracted in rounds of joins.
FEW_LINKS = 1 << 18
#: Staged tables after which the driver's garbage is collected.
COLLECT_EVERY = 4


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local session gets a folder of its own; a cluster session is refused.
    """
    conf = spark.sparkContext.getConf()
    base = conf.get("spark.checkpoint.dir", None) or spark.conf.get("skyquilt.shared.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="skyquilt-shared-")
        spark.conf.set("skyquilt.shared.dir", base)
    return base.rstrip("/")


_scopes = threading.local()


@contextlib.contextmanager
def stages_made() -> Iterator[list[Stage]]:
    """Collects the stages that this thread makes in the block; those of other threads and callers are not seen."""
    made: list[Stage] = []
    _scopes.open = [*getattr(_scopes, "open", []), made]
    try:
        yield made
    finally:
        _scopes.open = [held for held in _scopes.open if held is not made]


class Stage:
    """Tables written to the shared folder, so that a lost executor costs no recomputation and lineage stays short.

    What an operator returns still reads its tables, so they stay, until a caller that collects the stages made
    meanwhile (``stages_made``) and has written the result elsewhere drops them.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name = spark, name
        for held in getattr(_scopes, "open", []):
            held.append(self)
        self.writes = 0
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        # The exchanges behind the table are done with. Their files go when the driver collects garbage,
        # which a loop of small jobs would not make it do.
        self.writes += 1
        if self.writes % COLLECT_EVERY == 0:
            del df
            gc.collect()
            self.spark.sparkContext._jvm.System.gc()
        return out

    def drop(self, name: str = "") -> None:
        """Deletes a staged table that nothing reads any more, or all of them."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def words(text: bytes) -> list[bytes]:
    """Lower-cases A-Z and takes the runs of bytes outside ``[\\x20\\x09-\\x0D]``."""
    return text.lower().split()


class WordHash(dict):
    """Word -> 64-bit hash, remembered up to a bound on the number of words."""

    def __init__(self, most: int = 1 << 20):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, tokens: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, tokens), dtype=np.uint64, count=len(tokens))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input reaches every bit of the result."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-word shingles; of the whole sequence where it is shorter; none of no words."""
    if not len(hashes):
        return hashes
    n = min(n, len(hashes))
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    for k in range(n):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + hashes[k : len(hashes) - n + 1 + k] + np.uint64(k + 1))
    return out


def rows_of(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names), strict=True)


def in_batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 2000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield to_batch(held, schema)
            held = []
    if held:
        yield to_batch(held, schema)


def to_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, dtype=np.uint64).view(np.int64)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def add_in_levels(rows: DataFrame, keys: list[str], add: Callable, tasks: int, fan: int = 64) -> DataFrame:
    """Rows (keys, part, ...), one of each key from each of ``tasks`` tasks numbered in ``part``, added up ``fan`` at a time.

    ``add`` makes one row of a pandas frame of rows with the same keys. So no group is larger than ``fan``
    rows, however many tasks there are.
    """
    schema = rows.schema
    while tasks > 1:
        rows = rows.withColumn("part", F.expr(f"cast(part div {fan} as int)")).groupBy(*keys, "part").applyInPandas(add, schema)
        tasks = -(-tasks // fan)
    return rows


def components(stage: Stage, edges: DataFrame, name: str = "cc", most_rounds: int = 60) -> DataFrame:
    """Connected components by alternating large-star and small-star rounds, after each task's links are contracted.

    ``edges`` has columns u, v of one orderable type. Returns (node, component) for every node with an
    edge to another; component is the smallest node reachable. A round is aggregates and equi-joins, so
    a node with very many links is split by adaptive execution; no group is gathered. Rows: at most two
    for each edge. When FEW_LINKS or fewer are left, which is counted, one task contracts them. Null ends and self links are ignored; an empty input gives an empty result.
    """
    kind = edges.schema["u"].dataType.simpleString()
    plain = edges.where("u is not null and v is not null and u <> v").select("u", "v")
    now = stage.write(plain.mapInArrow(_contract, f"u {kind}, v {kind}").select(F.col("u").alias("a"), F.col("v").alias("b")).distinct(), f"{name}-0")
    for k in range(1, most_rounds):
        if now.count() <= FEW_LINKS:
            now = stage.write(now.coalesce(1).select(F.col("a").alias("u"), F.col("b").alias("v")).mapInArrow(_contract, f"u {kind}, v {kind}").select(F.col("u").alias("a"), F.col("v").alias("b")), f"{name}-few")
            break
        if _is_forest(now):
            break
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = stage.write(both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b"), f"{name}-large-{k}")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).distinct()
        now = stage.write(small, f"{name}-{k}")
        stage.drop(f"{name}-large-{k}")
        stage.drop(f"{name}-{k - 1}")
    else:
        raise RuntimeError("components: no fixed point")
    heads = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(heads)


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of a task to links to the smallest node that the task's links reach; the task's memory is bounded by writing out in between."""
    up: dict = {}

    def find(x):
        root = x
        while (n := up.get(root, root)) != root:
            root = n
        while (n := up.get(x, x)) != root:
            up[x], x = root, n
        return root

    def stars(schema: pa.Schema) -> pa.RecordBatch:
        pairs = [(x, r) for x in list(up) if (r := find(x)) != x]
        return to_batch(pairs, schema) if pairs else pa.RecordBatch.from_arrays([pa.array([], f.type) for f in schema], schema=schema)

    schema = None
    for batch in batches:
        schema = batch.schema
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            u, v = find(u), find(v)
            if u != v:
                up[max(u, v)] = min(u, v)
        if len(up) > 1 << 20:
            yield stars(schema)
            up.clear()
    if schema is not None:
        yield stars(schema)


def _is_forest(edges: DataFrame) -> bool:
    """Whether every node either has links to it only or one link from it."""
    ends = edges.select(F.col("a").alias("n"), F.lit(1).alias("out"), F.lit(0).alias("in")).union(edges.select(F.col("b").alias("n"), F.lit(0).alias("out"), F.lit(1).alias("in")))
    return ends.groupBy("n").agg(F.sum("out").alias("out"), F.max("in").alias("in")).where("out > 1 or (out = 1 and in = 1)").isEmpty()


def number_in_order(stage: Stage, rows: DataFrame, key: str, order: list, name: str) -> DataFrame:
    """Adds ``pos``, a row's place from 0 among the rows of its ``key`` by ``order``; null keys count as one key.

    Rows are sorted by ranges of (key, order), so a key with many rows is spread over tasks and none holds a group;
    a task counts as rows pass by. Only the key that a task begins with may have rows in earlier tasks; these
    counts, at most one row a task, are added afterwards. Rows that are equal in ``order`` are numbered arbitrarily.
    """
    schema = rows.schema.add("_part", "integer").add("_at", "long")
    by = [F.col(key).asc_nulls_first(), *order]
    parts = int(stage.spark.conf.get("spark.sql.shuffle.partitions"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, n = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not len(batch):
                continue
            k = batch.column(batch.schema.get_field_index(key))
            new = np.zeros(len(k), bool)
            new[1:] = pc.fill_null(pc.not_equal(k[1:], k[:-1]), False).to_numpy(zero_copy_only=False)
            null = k.is_null().to_numpy(zero_copy_only=False)
            new[1:] |= null[1:] != null[:-1]
            first = k[0].as_py()
            carried = n if last == (first,) else 0
            starts = np.flatnonzero(new)
            at = np.arange(len(k)) - np.concatenate([[-carried], starts])[np.cumsum(new)]
            last, n = (k[-1].as_py(),), int(at[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(k), part), pa.int32()), pa.array(at, pa.int64())], names=[*batch.schema.names, "_part", "_at"])

    local = stage.write(rows.repartitionByRange(parts, *by).sortWithinPartitions(*by).mapInArrow(count, schema), name)
    # Each task's last row of its first key tells how many rows of it the task has.
    begins = local.groupBy("_part").agg(F.min(F.struct(F.col(key).isNotNull().alias("n"), F.col(key).alias("k"))).alias("f")).select("_part", F.col("f.k").alias("_k"))
    straddling = F.broadcast(begins.select("_k").distinct())
    counts = local.join(straddling, F.col(key).eqNullSafe(F.col("_k"))).groupBy("_part", "_k").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy("_k").orderBy("_part")) - F.col("_n")).where("_before > 0").select(F.col("_part").alias("_p"), "_k", "_before")
    out = local.join(F.broadcast(before), (F.col("_part") == F.col("_p")) & F.col(key).eqNullSafe(F.col("_k")), "left")
    return out.select(*rows.columns, (F.col("_at") + F.coalesce("_before", F.lit(0))).alias("pos"))
