"""FITS tables and images, and .npy cubes with their axis files, as Spark data sources and sinks.

``sdfits`` reads binary tables into one row for each record; ``npycube`` reads .npy cubes whose ``.meta``
file holds a Python literal with axis centres and spacings; ``fitsimage`` reads images. Files are listed once and
divided into parts of bounded size; batches of columns are handed over, and only those that the schema names.
"""

from __future__ import annotations

import ast
import io
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

BLOCK = 2880
# Column formats of FITS tables and their types, big-endian.
FORMATS = {"L": "S1", "B": "u1", "I": ">i2", "J": ">i4", "K": ">i8", "E": ">f4", "D": ">f8", "A": "S"}
# Pixel types of FITS images.
PIXELS = {8: "u1", 16: ">i2", 32: ">i4", 64: ">i8", -32: ">f4", -64: ">f8"}


def _cards(data: bytes, at: int) -> tuple[dict, list[str], int]:
    """Header values, history lines, and where the data begins."""
    head, history = {}, []
    while True:
        block = data[at : at + BLOCK]
        if len(block) < BLOCK:
            raise ValueError("the header is cut short")
        at += BLOCK
        for k in range(0, BLOCK, 80):
            card = block[k : k + 80].decode("ascii")
            name = card[:8].strip()
            if name == "END":
                return head, history, at
            if name == "HISTORY":
                history.append(card[8:].strip())
            elif card[8:10] == "= ":
                text = card[10:].strip()
                if text.startswith("'"):
                    head[name] = text[1:].split("'")[0].rstrip()
                else:
                    text = text.split("/")[0].strip()
                    head[name] = text == "T" if text in ("T", "F") else float(text) if any(c in text for c in ".ED") else int(text)


def _data_size(head: dict) -> int:
    if not head.get("NAXIS"):
        return 0
    n = abs(head["BITPIX"]) // 8 * head.get("GCOUNT", 1)
    size = head.get("PCOUNT", 0) * abs(head["BITPIX"]) // 8
    total = 1
    for k in range(head["NAXIS"]):
        total *= head[f"NAXIS{k + 1}"]
    return n * total + size


def units(data: bytes) -> Iterator[tuple[dict, list[str], bytes]]:
    """Header, history and data of every unit of a FITS file."""
    at = 0
    while at + BLOCK <= len(data):
        head, history, at = _cards(data, at)
        size = _data_size(head)
        yield head, history, data[at : at + size]
        at += -(-size // BLOCK) * BLOCK


def table(head: dict, data: bytes) -> np.ndarray:
    """A binary table's records."""
    kinds = []
    for k in range(1, head["TFIELDS"] + 1):
        form = head[f"TFORM{k}"]
        letter, count = form[-1], int(form[:-1] or 1)
        kinds.append((head[f"TTYPE{k}"], f"S{count}") if letter == "A" else (head[f"TTYPE{k}"], FORMATS[letter], (count,)) if count > 1 else (head[f"TTYPE{k}"], FORMATS[letter]))
    return np.frombuffer(data, np.dtype(kinds), head["NAXIS2"])


def image(head: dict, data: bytes) -> np.ndarray:
    shape = [head[f"NAXIS{k}"] for k in range(head["NAXIS"], 0, -1)]
    return np.frombuffer(data, PIXELS[head["BITPIX"]], int(np.prod(shape))).reshape(shape)


def _card(name: str, value) -> str:
    if isinstance(value, bool):
        text = f"{'T' if value else 'F':>20}"
    elif isinstance(value, str):
        text = f"'{value:<8}'"
    else:
        text = f"{value!r:>20}"
    return f"{name:<8}= {text}"[:80].ljust(80)


def _padded(data: bytes, fill: bytes) -> bytes:
    return data + fill * (-len(data) % BLOCK)


def header(values: dict, history: list[str] | None = None) -> bytes:
    cards = [_card(k, v) for k, v in values.items()] + [f"HISTORY {h}"[:80].ljust(80) for h in history or []] + ["END".ljust(80)]
    return _padded("".join(cards).encode("ascii"), b" ")


def table_bytes(records: np.ndarray, history: list[str] | None = None) -> bytes:
    """A FITS file with one binary table; the inverse of ``table``."""
    primary = header({"SIMPLE": True, "BITPIX": 8, "NAXIS": 0, "EXTEND": True})
    letters = {"f8": "D", "f4": "E", "i8": "K", "i4": "J", "i2": "I", "u1": "B"}
    head = {"XTENSION": "BINTABLE", "BITPIX": 8, "NAXIS": 2, "NAXIS1": records.dtype.itemsize, "NAXIS2": len(records), "PCOUNT": 0, "GCOUNT": 1, "TFIELDS": len(records.dtype.names)}
    for k, name in enumerate(records.dtype.names, 1):
        base, shape = records.dtype[name].base, records.dtype[name].shape
        head[f"TTYPE{k}"] = name
        head[f"TFORM{k}"] = f"{base.itemsize}A" if base.kind == "S" else f"{int(np.prod(shape)) if shape else 1}{letters[base.str[1:]]}"
    return primary + header(head, history) + _padded(records.tobytes(), b"\0")


def image_bytes(cube: np.ndarray, values: dict | None = None) -> bytes:
    """A FITS file with one image; masked cells are written as NaN."""
    data = np.ascontiguousarray(cube, ">f8")
    head = {"SIMPLE": True, "BITPIX": -64, "NAXIS": cube.ndim} | {f"NAXIS{k + 1}": n for k, n in enumerate(reversed(cube.shape))}
    return header(head | (values or {})) + _padded(data.tobytes(), b"\0")


#: Bytes of a file that one task reads.
PART_BYTES = 32 << 20


def filesystem(path: str):
    """The file system and place of a folder or file that all executors share."""
    import pyarrow.fs as fs

    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}")


def headers(file, size: int) -> Iterator[tuple[dict, list[str], int]]:
    """Header, history and place of the data of every unit, without reading the data."""
    at = 0
    while at + BLOCK <= size:
        text = b""
        while True:
            text += file.read_at(BLOCK, at + len(text))
            if any(text[k : k + 8].strip() == b"END" for k in range(len(text) - BLOCK, len(text), 80)):
                break
            if at + len(text) + BLOCK > size:
                raise ValueError("the header is cut short")
        head, history, length = _cards(text, 0)
        at += length
        yield head, history, at
        at += -(-_data_size(head) // BLOCK) * BLOCK


class _Part(InputPartition):
    def __init__(self, path: str, place: int, low: int, high: int, head: dict, history: list[str], unit: int = 0):
        self.path, self.place, self.low, self.high, self.head, self.history, self.unit = path, place, low, high, head, history, unit


class _Reader(DataSourceReader):
    """Lists files once; a file's rows or slabs are divided into parts of PART_BYTES, or of the option ``partBytes``."""

    suffix = ""

    def __init__(self, options: dict, schema: StructType):
        import pyarrow.fs as fs

        self.options, self.schema = options, schema
        self.part_bytes = int(options.get("partbytes", PART_BYTES))
        path = options["path"]
        files, root = filesystem(path)
        info = files.get_file_info(root)
        found = files.get_file_info(fs.FileSelector(root, recursive=True)) if info.type == fs.FileType.Directory else [info]
        self.uri = path.split("://")[0] + "://" if "://" in path else "file://"
        self.found = sorted((f.path, f.size) for f in found if f.is_file and f.path.endswith(self.suffix))

    def partitions(self):
        return [p for path, size in self.found for p in self.parts(self.uri + path, size)]

    def bytes_of(self, part: _Part, width: int) -> bytes:
        files, at = filesystem(part.path)
        with files.open_input_file(at) as f:
            return f.read_at((part.high - part.low) * width, part.place + part.low * width)

    def batch(self, columns: dict, n: int):
        """An Arrow batch of the schema's columns; those that the file lacks are null."""
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(self.schema)
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)


class _TableReader(_Reader):
    suffix = ".fits"

    def __init__(self, options: dict, schema: StructType):
        super().__init__(options, schema)
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters):
        """Equalities on columns are used to leave out records early; Spark still checks them."""
        from pyspark.sql.datasource import EqualTo, In

        for f in filters:
            if isinstance(f, EqualTo) and len(f.attribute) == 1:
                self.wanted.setdefault(f.attribute[0], set()).add(f.value)
            elif isinstance(f, In) and len(f.attribute) == 1:
                self.wanted.setdefault(f.attribute[0], set()).update(f.value)
            yield f

    def parts(self, path: str, size: int):
        files, at = filesystem(path)
        with files.open_input_file(at) as f:
            for unit, (head, history, place) in enumerate(headers(f, size)):
                if head.get("XTENSION") == "BINTABLE":
                    step = max(1, self.part_bytes // max(1, head["NAXIS1"]))
                    for low in range(0, head["NAXIS2"], step):
                        yield _Part(path, place, low, min(low + step, head["NAXIS2"]), head, history, unit)

    def read(self, part):
        n = part.high - part.low
        rows = table(part.head | {"NAXIS2": n}, self.bytes_of(part, part.head["NAXIS1"]))
        record = np.arange(part.low, part.high, dtype=np.int32)
        keep = np.ones(n, bool)
        for name, values in self.wanted.items():
            if name in rows.dtype.names and rows.dtype[name].shape == ():
                column = np.char.rstrip(rows[name].astype(str)) if rows.dtype[name].kind == "S" else rows[name]
                keep &= np.isin(column, list(values))
        rows, record = rows[keep], record[keep]
        n = len(rows)
        columns = {"file": [part.path] * n, "record": record, "history": [part.history] * n}
        for name in set(rows.dtype.names) & {f.name for f in self.schema.fields}:
            v = rows[name]
            if v.dtype.kind == "S":
                columns[name] = np.char.rstrip(v.astype(str)).tolist()
            else:
                native = v.astype(v.dtype.newbyteorder("="))
                columns[name] = list(native) if native.ndim > 1 else native
        yield self.batch(columns, n)


class _TableWriter(DataSourceWriter):
    """Every task writes a file of its own; those of failed attempts are removed."""

    def __init__(self, options: dict, schema: StructType, overwrite: bool):
        self.path, self.schema, self.name = options["path"], schema, uuid.uuid4().hex[:12]
        files, root = filesystem(self.path)
        if overwrite:
            import pyarrow.fs as fs

            if files.get_file_info(root).type == fs.FileType.Directory:
                files.delete_dir_contents(root)
        files.create_dir(root, recursive=True)

    def write(self, iterator):
        from pyspark import TaskContext

        rows = list(iterator)
        if not rows:
            return _Written(None)
        kinds = {"int": ">i4", "bigint": ">i8", "double": ">f8", "float": ">f4", "smallint": ">i2"}
        dtype, history = [], []
        for f in self.schema.fields:
            kind = f.dataType.simpleString()
            if f.name in ("file", "record", "history"):
                continue
            if kind == "string":
                dtype.append((f.name, f"S{max(1, max(len(r[f.name] or '') for r in rows))}"))
            elif kind.startswith("array<"):
                sizes = {len(r[f.name]) for r in rows}
                if len(sizes) > 1:
                    raise ValueError(f"{f.name} has arrays of lengths {sorted(sizes)}")
                dtype.append((f.name, kinds[kind[6:-1]], (sizes.pop(),)))
            else:
                dtype.append((f.name, kinds[kind]))
        out = np.zeros(len(rows), dtype)
        for name, *rest in dtype:
            if len(rest) > 1:
                out[name] = [[np.nan if x is None else x for x in r[name]] for r in rows]
            else:
                out[name] = [((r[name] or "").encode() if rest[0][0] == "S" else np.nan if r[name] is None and "f" in rest[0] else r[name]) for r in rows]
        if "history" in self.schema.names:
            history = list(dict.fromkeys(h for r in rows for h in r["history"] or []))
        task = TaskContext.get()
        files, root = filesystem(self.path)
        name = f"{root}/part-{task.partitionId():05d}-{self.name}-{task.taskAttemptId()}.fits"
        with files.open_output_stream(name) as f:
            f.write(table_bytes(out, history))
        return _Written(name)

    def commit(self, messages):
        pass

    def abort(self, messages):
        files, _ = filesystem(self.path)
        for m in messages:
            if m and m.name:
                files.delete_file(m.name)


@dataclass
class _Written(WriterCommitMessage):
    name: str | None


class FitsTable(DataSource):
    """``spark.read.format("sdfits").schema(...).load(path)``: columns of the schema by name; also file, record and history.

    Equalities on columns, such as the scan, are tested before rows are built. ``df.write.format("sdfits")`` writes tables; history entries are joined.
    """

    @classmethod
    def name(cls):
        return "sdfits"

    def schema(self):
        return "file string, record int, SCAN int, CRVAL1 double, CDELT1 double, CRPIX1 double, CRVAL4 int, CAL string, DATA array<double>, history array<string>"

    def reader(self, schema):
        return _TableReader(self.options, schema)

    def writer(self, schema, overwrite):
        return _TableWriter(self.options, schema, overwrite)


def _cells(shape: tuple[int, ...], low: int, values: np.ndarray) -> tuple[list[np.ndarray], list]:
    """Indices of every axis of a slab that begins at ``low`` of the first one, and the values with null for those not finite."""
    at = [i.ravel().astype(np.int32) for i in np.indices((len(values), *shape[1:]))]
    at[0] = at[0] + low
    flat = values.ravel().astype(float)
    import pyarrow as pa

    return at, pa.array(flat, mask=~np.isfinite(flat))


class _ImageReader(_Reader):
    suffix = ".fits"

    def parts(self, path: str, size: int):
        files, at = filesystem(path)
        with files.open_input_file(at) as f:
            for unit, (head, history, place) in enumerate(headers(f, size)):
                if head.get("NAXIS", 0) and head.get("XTENSION", "IMAGE") == "IMAGE":
                    shape = [head[f"NAXIS{k}"] for k in range(head["NAXIS"], 0, -1)]
                    width = int(np.prod(shape[1:])) * abs(head["BITPIX"]) // 8
                    step = max(1, self.part_bytes // 8 // max(1, width))
                    for low in range(0, shape[0], step):
                        yield _Part(path, place, low, min(low + step, shape[0]), head | {"shape": shape, "width": width}, history, unit)

    def read(self, part):
        shape = part.head["shape"]
        values = np.frombuffer(self.bytes_of(part, part.head["width"]), PIXELS[part.head["BITPIX"]]).reshape(-1, *shape[1:])
        at, flat = _cells(tuple(shape), part.low, values)
        n = len(at[0])
        yield self.batch({"file": [part.path] * n, "unit": np.full(n, part.unit, np.int32), "at": list(np.stack(at, 1)), "value": flat}, n)


class FitsImage(DataSource):
    """``spark.read.format("fitsimage").load(path)``: one row for each pixel of every image, with its indices from the slowest axis on."""

    @classmethod
    def name(cls):
        return "fitsimage"

    def schema(self):
        return "file string, unit int, at array<int>, value double"

    def reader(self, schema):
        return _ImageReader(self.options, schema)


class _CubeReader(_Reader):
    suffix = ".npy"

    def parts(self, path: str, size: int):
        files, at = filesystem(path)
        with files.open_input_file(at) as f:
            start = io.BytesIO(f.read_at(min(size, 1 << 16), 0))
            version = np.lib.format.read_magic(start)
            shape, fortran, dtype = np.lib.format.read_array_header_1_0(start) if version == (1, 0) else np.lib.format.read_array_header_2_0(start)
            place = start.tell()
        if fortran or dtype.hasobject:
            raise ValueError(f"{path}: only plain arrays in C order are read")
        with files.open_input_file(at + ".meta") as f:
            meta = ast.literal_eval(f.read().decode())
        width = int(np.prod(shape[1:], dtype=np.int64)) * dtype.itemsize
        step = max(1, self.part_bytes // 8 // max(1, width))
        for low in range(0, shape[0], step):
            yield _Part(path, place, low, min(low + step, shape[0]), {"shape": shape, "dtype": dtype.str, "width": width, "meta": meta}, [])

    def read(self, part):
        shape, meta = part.head["shape"], part.head["meta"]
        values = np.frombuffer(self.bytes_of(part, part.head["width"]), part.head["dtype"]).reshape(-1, *shape[1:])
        at, flat = _cells(shape, part.low, values)
        n = len(at[0])
        columns = {"file": [part.path] * n, "value": flat}
        for axis, i, size in zip(meta["axes"], at, shape):
            columns[{"freq": "fi", "ra": "ri", "dec": "di"}.get(axis, f"{axis}_i")] = i
            columns[axis] = meta.get(f"{axis}_delta", 1.0) * (i - size // 2) + meta.get(f"{axis}_centre", 0.0)
        yield self.batch(columns, n)


class NpyCube(DataSource):
    """``spark.read.format("npycube").load(path)``: one row for each cell of .npy cubes; non-finite cells are null.

    A cube is read in slabs of its first axis. Axes other than freq, ra and dec are named by the option
    ``axes`` (comma-separated); an axis a gives the columns a_i and a.
    """

    @classmethod
    def name(cls):
        return "npycube"

    def schema(self):
        axes = [a for a in self.options.get("axes", "freq,ra,dec").split(",") if a]
        index = {"freq": "fi", "ra": "ri", "dec": "di"}
        return "file string, " + ", ".join(f"{index.get(a, a + '_i')} int" for a in axes) + ", " + ", ".join(f"{a} double" for a in axes) + ", value double"

    def reader(self, schema):
        return _CubeReader(self.options, schema)


def register(spark: SparkSession) -> None:
    """Makes the formats known to the session and lets filters reach them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (FitsTable, FitsImage, NpyCube):
        spark.dataSource.register(source)


def _write_cubes(cells: DataFrame, path: str, key: str, axes: list[str], suffix: str, make) -> DataFrame:
    """One file for each ``key`` from its cells (``axes`` indices, value); a cube is one task's and of bounded size. Returns key, file, cells."""
    kind = cells.schema[key].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        name = pdf[key].iloc[0]
        cube = np.full([int(pdf[a].max()) + 1 for a in axes], np.nan)
        cube[tuple(pdf[a] for a in axes)] = pdf["value"].astype(float)
        files, root = filesystem(path)
        files.create_dir(root, recursive=True)
        for end, data in make(cube).items():
            with files.open_output_stream(f"{root}/{name}{end}") as f:
                f.write(data)
        return pd.DataFrame({key: [name], "file": [f"{path}/{name}{suffix}"], "cells": [len(pdf)]})

    return cells.select(key, *axes, "value").groupBy(key).applyInPandas(run, f"{key} {kind}, file string, cells long")


def write_images(cells: DataFrame, path: str, key: str, axes: list[str], values: dict | None = None) -> DataFrame:
    """FITS images; cells that are masked or missing are NaN."""
    return _write_cubes(cells, path, key, axes, ".fits", lambda cube: {".fits": image_bytes(cube, values)})


def write_npy(cells: DataFrame, path: str, key: str, axes: dict[str, str], meta: dict | None = None) -> DataFrame:
    """.npy cubes with their ``.meta`` file; ``axes`` maps index columns to names of axes. ``meta`` must be plain values."""
    text = repr({"axes": tuple(axes.values())} | (meta or {}))
    if ast.literal_eval(text) != {"axes": tuple(axes.values())} | (meta or {}):
        raise ValueError("the axis information is not made of plain values")

    def make(cube: np.ndarray) -> dict[str, bytes]:
        out = io.BytesIO()
        np.save(out, cube)
        return {".npy": out.getvalue(), ".npy.meta": text.encode()}

    return _write_cubes(cells, path, key, list(axes), ".npy", make)


def write_tree(trees: DataFrame, path: str) -> None:
    """Nested tables of arrays (tree_path, values) as one Parquet table, dealt by the first part of the path."""
    trees.withColumn("top", F.split("tree_path", "/")[0]).write.mode("overwrite").partitionBy("top").parquet(path)


def read_tree(spark: SparkSession, path: str, below: str = "") -> DataFrame:
    """The arrays below a path of a tree; only the files of its first part are read."""
    rows = spark.read.parquet(path)
    if below:
        rows = rows.where((F.col("top") == below.split("/")[0]) & F.col("tree_path").startswith(below))
    return rows.drop("top")


def array_list(rows: DataFrame, keys: list[str], place: str, value: str) -> DataFrame:
    """Rows of a list's numbered entries back to one array for each key, in order."""
    return rows.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(place, value))), lambda x: x[value]).alias("values"))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; a local session without one gets a temporary folder."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="skyquilt-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def spectra(records: DataFrame) -> DataFrame:
    """Records with band, time number, polarisation and calibrator state; non-finite data masked."""
    from pyspark.sql import Window

    band = F.rint(F.col("CRVAL1") / 1e6).cast("int")
    w = Window.partitionBy("file", "SCAN", "band", "CRVAL4", "CAL").orderBy("record")
    out = records.withColumn("band", band).withColumn("t", F.row_number().over(w) - 1)
    clean = F.transform("DATA", lambda x: F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x))
    return out.select("file", F.col("SCAN").alias("scan"), "band", "t", F.col("CRVAL4").alias("pol"), F.col("CAL").alias("cal"), F.col("CRVAL1").alias("crval1"), F.col("CDELT1").alias("cdelt1"), F.col("CRPIX1").alias("crpix1"), clean.alias("spec"))


def write_text(df: DataFrame, path: str, columns: list[str]) -> None:
    """Columns as white-space text with fifteen digits."""
    df.select(F.format_string(" ".join(["%.15g"] * len(columns)).replace(".15g", ".15e"), *[F.col(c).cast("double") for c in columns]).alias("value")).write.mode("overwrite").text(path)


def read_catalog(spark: SparkSession, path: str, mock: bool = False) -> DataFrame:
    """A white-space text catalog: ra, dec, z, magnitude, jack-knife region and, for mocks, priority."""
    names = ["ra double", "dec double", "z double", "rmag double", "ijack int"] + ["ipri int"] * mock
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(~F.trim("value").startswith("#") & (F.trim("value") != ""))
    return rows.select(*[F.try_element_at(parts, F.lit(k + 1)).cast(n.split()[1]).alias(n.split()[0]) for k, n in enumerate(names)])


def decode_samples(raw: np.ndarray) -> np.ndarray:
    """Raw bytes (time, polarisation, channel): the first polarisation unsigned, the others signed."""
    out = raw.view(np.int8).astype(np.float32)
    out[:, 0] = raw[:, 0].view(np.uint8)
    return out


def stager(spark: SparkSession, name: str):
    """A function that writes a table to the shared folder and reads it again, so that a long chain of steps keeps a short plan."""
    root, count = shared_folder(spark, name), [0]

    def stage(df: DataFrame) -> DataFrame:
        count[0] += 1
        path = f"{root}/{count[0]}"
        df.write.mode("overwrite").parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return stage
