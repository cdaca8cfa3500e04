"""Files of a telescope: an index of SDFITS records by scan and band with coalesced reads, and PSRFITS search-mode data.

The index is a small table with one row for each run of neighbouring records of the same scan and band. A query
filters it like any table; the runs that it leaves are read in ranges, near ones together, and nothing else of the
files is. PSRFITS files are divided by sub-integrations; samples are scaled, masked by weight, averaged in time and
folded with the calibrator's period while they are read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .fits import _padded, _Part, _Reader, filesystem, header, headers, table

#: Bytes between two runs up to which both are read at once, and bytes of one read at most.
GAP, MOST_BYTES = 1 << 16, 32 << 20

_INDEX = "file string, place long, width int, scan int, band int, first int, last int, head string"


# The index of SDFITS files.


def _files(path: str) -> list[tuple[str, int]]:
    import pyarrow.fs as fs

    files, root = filesystem(path)
    info = files.get_file_info(root)
    found = files.get_file_info(fs.FileSelector(root, recursive=True)) if info.type == fs.FileType.Directory else [info]
    scheme = path.split("://")[0] + "://" if "://" in path else "file://"
    return sorted((scheme + f.path, f.size) for f in found if f.is_file and f.path.endswith(".fits"))


def build_index(spark: SparkSession, path: str, part_bytes: int = MOST_BYTES) -> DataFrame:
    """(file, place, width, scan, band, first, last, head): runs of neighbouring records, each file's tables in parts of ``part_bytes``.

    ``band`` is the centre frequency (CRVAL1) in whole MHz; ``head`` describes the table's columns. Runs end where a
    part does. Keep it with ``write.parquet``; files are read once for it.
    """
    names = spark.createDataFrame(_files(path), "file string, size long")

    def parts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for name, size in pdf.itertuples(index=False):
                files, at = filesystem(name)
                with files.open_input_file(at) as f:
                    for head, _, place in headers(f, size):
                        if head.get("XTENSION") == "BINTABLE":
                            kinds = {k: v for k, v in head.items() if k.startswith(("TTYPE", "TFORM", "TFIELDS", "NAXIS1"))}
                            step = max(1, part_bytes // head["NAXIS1"])
                            out += [(name, place, head["NAXIS1"], low, min(low + step, head["NAXIS2"]), repr(kinds)) for low in range(0, head["NAXIS2"], step)]
            yield pd.DataFrame(out, columns=["file", "place", "width", "low", "high", "head"])

    def runs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for name, place, width, low, high, head in pdf.itertuples(index=False):
                rows = _records(name, place, width, low, high, head)
                scan, band = rows["SCAN"].astype(int), np.rint(rows["CRVAL1"] / 1e6).astype(int)
                edges = [0, *(np.flatnonzero((scan[1:] != scan[:-1]) | (band[1:] != band[:-1])) + 1).tolist(), len(rows)]
                out += [(name, place, width, int(scan[a]), int(band[a]), low + a, low + b, head) for a, b in zip(edges, edges[1:]) if b > a]
            yield pd.DataFrame(out, columns=["file", "place", "width", "scan", "band", "first", "last", "head"])

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    listed = names.mapInPandas(parts, "file string, place long, width int, low int, high int, head string")
    return listed.repartition(tasks, "file", "low").mapInPandas(runs, _INDEX)


def _records(name: str, place: int, width: int, low: int, high: int, head: str) -> np.ndarray:
    import ast

    files, at = filesystem(name)
    with files.open_input_file(at) as f:
        return table(ast.literal_eval(head) | {"NAXIS2": high - low}, f.read_at((high - low) * width, place + low * width))


def planned_reads(index: DataFrame, gap: int = GAP, most: int = MOST_BYTES) -> DataFrame:
    """(file, place, width, head, low, high, runs): ranges of records to read at once, and the runs of them that are wanted.

    Runs of a file are joined while no more than ``gap`` bytes lie between them and about ``most`` bytes are reached.
    """
    w = Window.partitionBy("file", "place").orderBy("first")
    far = (F.col("first") - F.lag("last").over(w)) * F.col("width") > gap
    size = F.sum((F.col("last") - F.col("first")) * F.col("width")).over(w) - (F.col("last") - F.col("first")) * F.col("width")
    marked = index.withColumn("_new", F.coalesce(far, F.lit(True)).cast("int")).withColumn("_full", F.floor(size / most))
    grouped = marked.withColumn("_group", F.sum("_new").over(w)).groupBy("file", "place", "width", "head", "_group", "_full")
    return grouped.agg(F.min("first").alias("low"), F.max("last").alias("high"), F.array_sort(F.collect_list(F.struct("first", "last"))).alias("runs")).drop("_group", "_full")


def read_planned(reads: Iterator[pd.DataFrame], schema: StructType, fetch: Callable = _records) -> Iterator[pa.RecordBatch]:
    """Records of the wanted runs with the schema's columns; ``fetch`` reads one range of a file."""
    kind = to_arrow_schema(schema)
    for pdf in reads:
        for name, place, width, head, low, high, runs in pdf[["file", "place", "width", "head", "low", "high", "runs"]].itertuples(index=False):
            rows = fetch(name, int(place), int(width), int(low), int(high), head)
            record = np.concatenate([np.arange(x["first"], x["last"]) for x in runs])
            rows = rows[record - low]
            columns = {"file": [name] * len(rows), "record": record.astype(np.int32)}
            for f in kind:
                if f.name in rows.dtype.names:
                    v = rows[f.name]
                    columns[f.name] = np.char.rstrip(v.astype(str)).tolist() if v.dtype.kind == "S" else list(v.astype(v.dtype.newbyteorder("="))) if v.ndim > 1 else v.astype(v.dtype.newbyteorder("="))
            yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(len(rows), f.type) for f in kind], schema=kind)


def read_indexed(index: DataFrame, schema: str, wanted: Column | None = None, gap: int = GAP) -> DataFrame:
    """Records (columns of ``schema`` by name, also file and record) of the runs of an index that ``wanted``, a condition on scan and band, leaves."""
    kind = StructType.fromDDL(schema)
    reads = planned_reads(index if wanted is None else index.where(wanted), gap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return read_planned((b.to_pandas() for b in batches), kind)

    tasks = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return reads.repartition(tasks, "file", "low").mapInArrow(run, kind)


def checked_blocks(records: DataFrame) -> DataFrame:
    """Records with ``block_time`` within their (file, SCAN, band) block; an error where a block is out of order.

    Records go by time, polarisation (CRVAL4) and calibrator (CAL), the last fastest; every time has the first time's
    polarisations and states in the same order and one LST, and LST does not fall (but for midnight).
    """
    band = F.rint(F.col("CRVAL1") / 1e6).cast("int")
    block = ["file", "SCAN", "band"]
    rows = records.withColumn("band", band)
    states = rows.groupBy(*block).agg(F.count("*").alias("_n"), F.count_distinct("CRVAL4", "CAL").alias("_states"), F.count_distinct("CAL").alias("_cals"))
    w = Window.partitionBy(*block).orderBy("record")
    k = F.row_number().over(w) - 1
    rows = rows.join(states, block).withColumn("_k", k).withColumn("block_time", F.floor(F.col("_k") / F.col("_states")).cast("int"))
    place = F.col("_k") % F.col("_states")
    same = Window.partitionBy(*block, place).orderBy("record")
    fails = [
        (F.col("_n") % F.col("_states") != 0, "a time of the block is cut short"),
        ((F.first("CRVAL4").over(same) != F.col("CRVAL4")) | (F.first("CAL").over(same) != F.col("CAL")), "polarisations or calibrator states change their order"),
        ((F.col("_k") % F.col("_cals") != 0) & (F.lag("CRVAL4").over(w) != F.col("CRVAL4")), "calibrator states do not go by polarisation"),
        ((place != 0) & (F.lag("LST").over(w) != F.col("LST")), "one time has several LSTs"),
        ((place == 0) & (F.lag("LST").over(w) > F.col("LST")) & (F.lag("LST").over(w) - F.col("LST") < 43200), "LST falls"),
    ]
    wrong = F.coalesce(*[F.when(c, F.lit(text)) for c, text in fails])
    checked = rows.withColumn("_wrong", wrong)
    message = F.concat_ws(" ", F.lit("scan"), F.col("SCAN").cast("string"), F.lit("band"), F.col("band").cast("string"), F.lit("record"), F.col("record").cast("string"), F.col("_wrong"))
    checked = checked.withColumn("block_time", F.when(F.col("_wrong").isNotNull(), F.raise_error(message).cast("int")).otherwise(F.col("block_time")))
    return checked.drop("_n", "_states", "_cals", "_k", "_wrong")


# PSRFITS search-mode files.


def psrfits_bytes(data: np.ndarray, scale: np.ndarray, offset: np.ndarray, weight: np.ndarray, freq: np.ndarray, sample_time: float, start: float, ids: np.ndarray | None = None, lst: np.ndarray | None = None) -> bytes:
    """A PSRFITS file of raw samples (record, time, pol, chan) as bytes, with scales and offsets (record, pol, chan), weights (record, chan), frequencies in MHz; ``start`` is the second of the day."""
    n, n_time, n_pol, n_chan = data.shape
    kinds = [("TSUBINT", ">f8"), ("OFFS_SUB", ">f8"), ("LST_SUB", ">f8"), ("SUBINT_ID", ">i8"), ("DAT_FREQ", ">f8", (n_chan,)), ("DAT_WTS", ">f4", (n_chan,)), ("DAT_OFFS", ">f4", (n_pol * n_chan,)), ("DAT_SCL", ">f4", (n_pol * n_chan,)), ("DATA", "u1", (n_time * n_pol * n_chan,))]
    rows = np.zeros(n, kinds)
    rows["TSUBINT"] = sample_time * n_time
    rows["OFFS_SUB"] = (np.arange(n) + 0.5) * sample_time * n_time
    rows["LST_SUB"] = 0 if lst is None else lst
    rows["SUBINT_ID"] = np.arange(n) if ids is None else ids
    rows["DAT_FREQ"], rows["DAT_WTS"] = freq, weight
    rows["DAT_OFFS"], rows["DAT_SCL"] = offset.reshape(n, -1), scale.reshape(n, -1)
    rows["DATA"] = data.reshape(n, -1).view(np.uint8)
    letters = {"f8": "D", "f4": "E", "i8": "K", "u1": "B"}
    head = {"XTENSION": "BINTABLE", "BITPIX": 8, "NAXIS": 2, "NAXIS1": rows.dtype.itemsize, "NAXIS2": n, "PCOUNT": 0, "GCOUNT": 1, "TFIELDS": len(kinds)}
    for k, (name, kind, *shape) in enumerate(kinds, 1):
        head |= {f"TTYPE{k}": name, f"TFORM{k}": f"{shape[0][0] if shape else 1}{letters[kind.lstrip('>')]}"}
    head |= {f"TDIM{len(kinds)}": f"(1,{n_chan},{n_pol},{n_time})", "TBIN": float(sample_time), "NPOL": n_pol, "NCHAN": n_chan, "NSBLK": n_time, "EXTNAME": "SUBINT"}
    second = int(math.floor(start))
    primary = header({"SIMPLE": True, "BITPIX": 8, "NAXIS": 0, "EXTEND": True, "STT_SMJD": second, "STT_OFFS": float(start - second)})
    return primary + header(head) + _padded(rows.tobytes(), b"\0")


def write_psrfits(records: DataFrame, path: str, shape: tuple[int, int, int], sample_time: float) -> DataFrame:
    """One file for each task from records (subint long, raw array<int> of time, pol, chan, scale, offset, weight arrays, freq array); returns file, records. Files of failed attempts have other names and are not listed in the result."""
    n_time, n_pol, n_chan = shape

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        for k, pdf in enumerate(frames):
            if not len(pdf):
                continue
            pdf = pdf.sort_values("subint")
            stack = lambda c, *s: np.stack(pdf[c].to_numpy()).reshape(len(pdf), *s)
            data = stack("raw", n_time, n_pol, n_chan).astype(np.int64).astype(np.uint8)
            made = psrfits_bytes(data, stack("scale", n_pol, n_chan), stack("offset", n_pol, n_chan), stack("weight", n_chan), stack("freq", n_chan), sample_time, 0.0, ids=pdf["subint"].to_numpy())
            files, root = filesystem(path)
            files.create_dir(root, recursive=True)
            task = TaskContext.get()
            name = f"{root}/scan-{task.partitionId():05d}-{task.taskAttemptId()}-{k}.fits"
            with files.open_output_stream(name) as f:
                f.write(made)
            yield pd.DataFrame({"file": [name], "records": [len(pdf)]})

    return records.mapInPandas(run, "file string, records long")


class _SearchReader(_Reader):
    """Parts are ranges of sub-integrations; samples are averaged and folded within each."""

    suffix = ".fits"

    def __init__(self, options: dict, schema: StructType):
        super().__init__(options, schema)
        self.average, self.fold = int(options.get("average", 1)), int(options.get("fold", 1))

    def parts(self, path: str, size: int):
        files, at = filesystem(path)
        with files.open_input_file(at) as f:
            first = None
            for unit, (head, history, place) in enumerate(headers(f, size)):
                first = first or head
                if head.get("XTENSION") == "BINTABLE" and "NSBLK" in head:
                    dims = next(v for k, v in head.items() if k.startswith("TDIM"))
                    if dims.replace(" ", "") != f"(1,{head['NCHAN']},{head['NPOL']},{head['NSBLK']})":
                        raise ValueError(f"{path}: DATA has the shape {dims}")
                    if head["NSBLK"] % self.average or self.average % self.fold:
                        raise ValueError("times to average must divide those of a sub-integration, and the fold those")
                    start = {"start": first.get("STT_SMJD", 0) + first.get("STT_OFFS", 0.0)}
                    step = max(1, self.part_bytes // head["NAXIS1"])
                    for low in range(0, head["NAXIS2"], step):
                        yield _Part(path, place, low, min(low + step, head["NAXIS2"]), head | start, history, unit)

    def read(self, part):
        head, n = part.head, part.high - part.low
        rows = table(head | {"NAXIS2": n}, self.bytes_of(part, head["NAXIS1"]))
        n_time, n_pol, n_chan = head["NSBLK"], head["NPOL"], head["NCHAN"]
        bins = n_time // self.average
        raw = rows["DATA"].reshape(n, n_time, n_pol, n_chan)
        # The first polarisation is unsigned, the others are signed.
        value = raw.astype(np.uint8).view(np.int8).astype(float)
        value[:, :, 0] = raw[:, :, 0]
        scale, offset = (rows[c].astype(float).reshape(n, 1, n_pol, n_chan) for c in ("DAT_SCL", "DAT_OFFS"))
        value = value * scale + offset
        value = np.where((rows["DAT_WTS"] > 0)[:, None, None, :], value, np.nan)
        # (record, time bin, step, phase of the calibrator, pol, chan): means over the steps.
        flat = value.reshape(n, bins, self.average // self.fold, self.fold, n_pol, n_chan).mean(2).reshape(-1, n_chan)
        time = head["start"] + rows["OFFS_SUB"].astype(float)[:, None] + (np.arange(bins) + 0.5 - bins / 2) * head["TBIN"] * self.average
        record, t, phase, pol = (i.ravel() for i in np.indices((n, bins, self.fold, n_pol)))
        m = len(flat)
        spec = pa.ListArray.from_arrays(pa.array(np.arange(0, m * n_chan + 1, n_chan), pa.int32()), pa.array(flat.ravel(), mask=np.isnan(flat.ravel())))
        columns = {
            "file": [part.path] * m,
            "record": (record + part.low).astype(np.int32),
            "subint": rows["SUBINT_ID"].astype(np.int64)[record] if "SUBINT_ID" in rows.dtype.names else record + part.low,
            "t": ((record + part.low) * bins + t).astype(np.int64),
            "time": time.ravel()[record * bins + t],
            "pol": pol.astype(np.int32),
            "phase": phase.astype(np.int32),
            "freq": list(rows["DAT_FREQ"].astype(float)[record]),
            "spec": spec,
        }
        yield self.batch(columns, m)


class SearchMode(DataSource):
    """``spark.read.format("psrfits").option("average", 16).option("fold", 8).load(path)``: spectra of averaged samples.

    ``average`` samples make one time; ``fold`` is the calibrator's period in samples: each of its phases is averaged
    apart. Channels without weight are null. Sub-integrations are dealt in parts of ``partBytes``.
    """

    @classmethod
    def name(cls):
        return "psrfits"

    def schema(self):
        return "file string, record int, subint long, t long, time double, pol int, phase int, freq array<double>, spec array<double>"

    def reader(self, schema):
        return _SearchReader(self.options, schema)


def folded_calibrator(folded: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, t, pol, on, off): spectra with the calibrator on and off from phases of a folded stream.

    The half of the phases, in a row and around the end, in which a key's mean over polarisation 0 is highest is on.
    """
    profile = folded.where("pol = 0").select(*keys, "phase", F.explode("spec").alias("v")).groupBy(*keys, "phase").agg(F.avg("v").alias("m"))
    n = profile.groupBy(*keys).agg(F.count("*").alias("_n"), F.map_from_entries(F.collect_list(F.struct("phase", "m"))).alias("_m"))
    begins = F.transform(F.sequence(F.lit(0), (F.col("_n") - 1).cast("int")), lambda s: F.struct(F.aggregate(F.sequence(F.lit(0), (F.floor(F.col("_n") / 2) - 1).cast("int")), F.lit(0.0), lambda a, k: a + F.element_at("_m", ((s + k) % F.col("_n")).cast("int"))).alias("sum"), (-s).alias("s")))
    first = n.select(*keys, "_n", (-F.array_max(begins)["s"]).alias("_s"))
    lit = F.pmod(F.col("phase") - F.col("_s"), F.col("_n")) < F.floor(F.col("_n") / 2)
    rows = folded.join(first, keys).withColumn("_on", lit)
    long = rows.select(*keys, "t", "pol", "_on", F.posexplode("spec").alias("chan", "v")).groupBy(*keys, "t", "pol", "chan").agg(F.avg(F.when(F.col("_on"), F.col("v"))).alias("on"), F.avg(F.when(~F.col("_on"), F.col("v"))).alias("off"))
    side = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("chan", c))), lambda x: x[c]).alias(c)
    return long.groupBy(*keys, "t", "pol").agg(side("on"), side("off"))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SearchMode)


# Covariances that are changed in place.


def write_tiles(tiles: DataFrame, path: str, group: int) -> None:
    """A matrix's tiles (i, j, tile) as Parquet, dealt by squares of ``group`` by ``group`` tiles."""
    dealt = tiles.withColumn("gi", F.floor(F.col("i") / group).cast("int")).withColumn("gj", F.floor(F.col("j") / group).cast("int"))
    dealt.repartition("gi", "gj").write.mode("overwrite").partitionBy("gi", "gj").parquet(path)


def read_tiles(spark: SparkSession, path: str, rows: tuple[int, int] | None = None, group: int | None = None) -> DataFrame:
    """Tiles of the matrix; with a range of tile rows only the squares that it meets are read."""
    out = spark.read.parquet(path)
    if rows is not None and group:
        out = out.where((F.col("gi") >= rows[0] // group) & (F.col("gi") <= (rows[1] - 1) // group)).where((F.col("i") >= rows[0]) & (F.col("i") < rows[1]))
    return out.select("i", "j", "tile")


def update_tiles(stage: Callable[[DataFrame], DataFrame], changed: DataFrame, path: str, group: int, add: bool = False) -> None:
    """Replaces, or with ``add`` adds to, tiles of a matrix on disk. Only squares with a changed tile are read and written again.

    The new squares are written to the shared folder first, then take the old ones' place when the job is committed: a
    writer that fails before leaves the matrix as it was.
    """
    spark = changed.sparkSession
    changed = stage(changed.select("i", "j", F.col("tile").alias("_new")).withColumn("gi", F.floor(F.col("i") / group).cast("int")).withColumn("gj", F.floor(F.col("j") / group).cast("int")))
    touched = [tuple(r) for r in changed.select("gi", "gj").distinct().collect()]
    if not touched:
        return
    where = F.struct("gi", "gj").isin([F.struct(F.lit(a).alias("gi"), F.lit(b).alias("gj")) for a, b in touched])
    old = spark.read.parquet(path).where(where)
    both = old.join(changed, ["gi", "gj", "i", "j"], "full")
    sums = F.zip_with("tile", "_new", lambda x, y: x + y) if add else F.col("_new")
    tile = F.when(F.col("_new").isNull(), F.col("tile")).when(F.col("tile").isNull(), F.col("_new")).otherwise(sums)
    merged = stage(both.select("i", "j", tile.alias("tile"), "gi", "gj"))
    merged.repartition("gi", "gj").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("gi", "gj").parquet(path)
