"""Chains of named steps with parameters and a history, and incremental runs over files."""

from __future__ import annotations

import ast
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyquilt.operators.lineage import read_parameters
from skyquilt.sources.fits import filesystem, register, spectra, table_bytes


@dataclass
class Step:
    """A function of a DataFrame with declared parameters and their defaults; ``prefix`` marks those given for it."""

    name: str
    apply: Callable[..., DataFrame]
    defaults: dict = field(default_factory=dict)
    prefix: str = ""

    def bound(self, given: dict) -> dict:
        return read_parameters(given, self.defaults, self.prefix)


@dataclass
class Chain:
    """Steps in order. They build one plan: nothing is written between them, and steps may be left out or put elsewhere."""

    steps: list[Step]

    def run(self, df: DataFrame, given: dict | None = None) -> tuple[DataFrame, list[tuple[str, dict]]]:
        """The result and the history: every step's name and effective parameters."""
        history = []
        for step in self.steps:
            params = step.bound(given or {})
            df = step.apply(df, **params)
            history.append((step.name, params))
        return df, history

    def without(self, *names: str) -> Chain:
        return Chain([s for s in self.steps if s.name not in names])


def run_new(requested: DataFrame, done_path: str, key: str, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Works on the keys that the table at ``done_path`` does not hold, and appends the result to it."""
    spark = requested.sparkSession
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(done_path)
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    todo = requested.join(spark.read.parquet(done_path).select(key).distinct(), key, "left_anti") if there else requested
    work(todo).write.mode("append").parquet(done_path)
    return spark.read.parquet(done_path)


# Chains over files: one file in, one file out, with what was done written beside and into them.

#: Records of a file that one task may write.
MOST_RECORDS = 1 << 20
_ROWS = "file, scan, band, t, pol, cal, crval1, cdelt1, crpix1, spec".split(", ")


def file_names(path: str) -> set[str]:
    import pyarrow.fs as fs

    files, root = filesystem(path)
    if files.get_file_info(root).type != fs.FileType.Directory:
        return set()
    return {f.base_name for f in files.get_file_info(fs.FileSelector(root)) if f.base_name.endswith(".fits")}


def write_records(rows: DataFrame, path: str) -> DataFrame:
    """(name, records): spectra (file, scan, band, t, pol, cal, crval1, cdelt1, crpix1, spec, history) as one SDFITS file for each name of ``file``; masked channels are NaN.

    A file is one task's, and is refused beyond MOST_RECORDS. It is written under another name and renamed at the end,
    so a lost task leaves no half of a file where a later run would take it for done.
    """

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > MOST_RECORDS:
            raise ValueError(f"{key[0]} has more than {MOST_RECORDS} records")
        pdf = pdf.sort_values(["scan", "band", "t", "pol", "cal"], ascending=[True, True, True, False, False])
        width = {len(s) for s in pdf["spec"]}
        if len(width) > 1:
            raise ValueError(f"{key[0]} has spectra of lengths {sorted(width)}")
        out = np.zeros(len(pdf), [("SCAN", ">i4"), ("CRVAL1", ">f8"), ("CDELT1", ">f8"), ("CRPIX1", ">f8"), ("CRVAL4", ">i4"), ("CAL", "S1"), ("TIME", ">i4"), ("DATA", ">f8", (width.pop(),))])
        for name, column in (("SCAN", "scan"), ("CRVAL1", "crval1"), ("CDELT1", "cdelt1"), ("CRPIX1", "crpix1"), ("CRVAL4", "pol"), ("TIME", "t")):
            out[name] = pdf[column]
        out["CAL"] = [c.encode() for c in pdf["cal"]]
        out["DATA"] = [[np.nan if x is None else x for x in s] for s in pdf["spec"]]
        history = list(dict.fromkeys(h for hs in pdf["history"] for h in (hs if hs is not None else [])))
        files, root = filesystem(path)
        files.create_dir(root, recursive=True)
        held = f"{root}/.{key[0]}-{uuid.uuid4().hex[:8]}"
        with files.open_output_stream(held) as f:
            f.write(table_bytes(out, history))
        files.move(held, f"{root}/{key[0]}")
        return pd.DataFrame({"name": [key[0]], "records": [len(pdf)]})

    named = rows.withColumn("name", F.regexp_extract("file", r"[^/]+$", 0))
    return named.groupBy("name").applyInPandas(run, "name string, records long")


def run_files(spark: SparkSession, chain: Chain, source: str, target: str, given: dict | None = None) -> DataFrame:
    """(name, records) of the files of ``source`` that ``target`` does not hold yet, taken through the chain.

    Steps work on spectra (file, scan, band, t, pol, cal, crval1, cdelt1, crpix1, spec). Every file's history goes on with the
    steps' names and parameters; all effective parameters stand beside the files in ``params.txt``. A chain that is
    run again with other parameters into the same folder is an error, and one that is run again works on new files only.
    """
    todo = sorted(file_names(source) - file_names(target))
    params = {f"{s.name}.{k}": v for s in chain.steps for k, v in s.bound(given or {}).items()}
    text = "".join(f"{k} = {v!r}\n" for k, v in sorted(params.items()))
    files, root = filesystem(target)
    files.create_dir(root, recursive=True)
    kept = read_params(target)
    if kept is not None and kept != params:
        raise ValueError(f"{target} holds files that were made with other parameters")
    with files.open_output_stream(f"{root}/params.txt") as f:
        f.write(text.encode())
    register(spark)
    names = spark.createDataFrame([(n,) for n in todo], "name string")
    records = spark.read.format("sdfits").load(source).withColumn("name", F.regexp_extract("file", r"[^/]+$", 0)).join(F.broadcast(names), "name", "left_semi").drop("name")
    out, history = chain.run(spectra(records), given)
    lines = [f"{n}: {name} {p}"[:70] for n, (name, p) in enumerate(history)]
    before = records.groupBy("file").agg(F.first("history").alias("history"))
    out = out.select(*_ROWS).join(before, "file").withColumn("history", F.concat(F.coalesce("history", F.array().cast("array<string>")), F.array(*[F.lit(x) for x in lines])))
    return write_records(out, target)


def read_params(path: str) -> dict | None:
    """Parameters that stand beside the files of a folder."""
    import pyarrow.fs as fs

    files, root = filesystem(path)
    if files.get_file_info(f"{root}/params.txt").type != fs.FileType.File:
        return None
    with files.open_input_file(f"{root}/params.txt") as f:
        lines = f.read().decode().splitlines()
    return {k: ast.literal_eval(v) for k, v in (line.split(" = ", 1) for line in lines)}
