"""From raw documents to packed sequences: quality, near copies, repeated passages, benchmark leaks, packing.

Every stage is one operator of ``skyquilt.llm`` over all rows that its predecessor kept. It takes
(spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs; so each stage begins by deleting what the stage before it has staged, and no more. All but the last return
the columns of ``documents``.
"""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyquilt.llm.common import Stage, stages_made
from skyquilt.llm.decontaminate import drop_leaks
from skyquilt.llm.jaccard import drop_near_copies
from skyquilt.llm.packing import pack
from skyquilt.llm.quality import keep_good
from skyquilt.llm.suffixes import drop_repeats


class _Left(threading.local):
    """What the stage before has staged, for each thread: one thread runs one pipeline at a time."""

    def __init__(self):
        self.stages: list[Stage] = []


_left = _Left()


def _apply(operator: Callable[..., DataFrame], *args, first: bool = False, **kwargs) -> DataFrame:
    """Calls a stage's operator. What the stage before has staged goes first, as its result has been written by now; a first stage leaves alone what it finds."""
    before, _left.stages = _left.stages, []
    if not first:
        for stage in before:
            stage.drop()
    with stages_made() as made:
        out = operator(*args, **kwargs)
    _left.stages = made
    return out


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return _apply(keep_good, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), first=True)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a Jaccard similarity of 0.8 over five-word shingles, the document with the smallest id stays."""
    return _apply(drop_near_copies, docs, n_words=5, num=4, den=5)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 400 bytes or of 51 words or more that repeat anywhere in what is left are cut out of the texts; n_chars follows."""
    return _apply(drop_repeats, docs, n_words=51).withColumn("n_chars", F.length("text").cast("long"))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item's question and answer go."""
    return _apply(drop_leaks, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents that are left, in sequences of at most 2048 tokens."""
    return _apply(pack, docs)


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_copies),
    ("suffix-array dedup", repeated_passages),
    ("benchmark decontamination", benchmark_leaks),
    ("best-fit packing", packing),
]

#: The stages are not all expressible in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over ``documents``."""
    stage = Stage(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    try:
        for k, (_, apply) in enumerate(STAGES):
            docs = stage.write(apply(spark, docs, sf_dir), f"stage-{k}")
            if k:
                stage.drop(f"stage-{k - 1}")
    finally:
        for last in _left.stages:
            last.drop()
        _left.stages = []
    return docs
