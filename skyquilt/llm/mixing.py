"""Mixing sources to target weights: entropy balancing by distributed Newton steps, rates rounded into whole copies."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stage, number_in_order

#: Share of the target by which a source's tilted words may miss it, and the most Newton steps that get there.
CLOSE, STEPS = 1e-9, 80
_WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def of_source(rows: DataFrame, table: DataFrame, how: str = "inner") -> DataFrame:
    """Rows with the columns of a table by source; null is a source as well."""
    return rows.join(table.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), how).drop("_s")


def capped_targets(stage: Stage, sources: DataFrame, most: float) -> DataFrame:
    """Adds ``target`` to sources (size, weight): shares of all sizes by weight, none above ``most`` times its source's size.

    What is above is shared again by weight among the others until none is above: each round is one aggregate, its
    two numbers are the words and the weight that are left.
    """
    total = sources.agg(F.sum("size")).first()[0] or 0
    level, full = 0.0, -1
    while True:
        # A source is full when its share at the level of the last round would be above its most.
        over = F.lit(level) * F.col("weight") >= most * F.col("size") if full >= 0 else F.col("size") == 0
        n, taken, weight = sources.agg(F.count(F.when(over, 1)), F.sum(F.when(over, most * F.col("size")).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("weight").cast("double")))).first()
        if n == full or not weight:
            break
        full, level = n, max(level, (total - taken) / weight)
    return sources.withColumn("target", F.least(F.lit(level) * F.col("weight"), most * F.col("size")))


def rate(tilt: Column, x: Column, most: float) -> Column:
    """A document's rate: the exponential of its tilt, at most ``most``."""
    return F.when(tilt * x < float(np.log(most)), F.exp(tilt * x)).otherwise(F.lit(float(most)))


def tilts(stage: Stage, kinds: DataFrame, sources: DataFrame, most: float) -> DataFrame:
    """Sources (source, target, ...) with ``tilt``: the solution of the dual for the constraint on each source's words.

    ``kinds`` are (source, size, n, x): n documents of a size, whose rate is exp(tilt * x) up to ``most``. The dual
    is convex and separates by source, so its Hessian is diagonal: a step is one aggregate over all kinds, which
    sums words and their derivative by source, and stays within the bracket that earlier steps have left. The dual
    is flat where all documents stand at ``most``, so a source whose target asks for that is given the least such tilt.
    """
    ends = kinds.where("size > 0").groupBy("source").agg(F.min("x").alias("least_x"))
    now = of_source(sources, ends, "left")
    saturated = float(np.log(most)) / F.col("least_x") * (1 + 1e-12)
    start = F.when(F.col("size") > 0, F.least(F.log(F.try_divide("target", F.col("size"))), saturated)).otherwise(0.0)
    now = now.select(*sources.columns, start.alias("tilt"), F.lit(float("-inf")).alias("low"), F.coalesce(saturated, F.lit(0.0)).alias("high"), F.coalesce(F.col("target") >= most * F.col("size") * (1 - CLOSE), F.lit(True)).alias("full"))
    now = stage.write(now.withColumn("tilt", F.when(F.col("full"), F.col("high")).otherwise(F.col("tilt"))), "tilts-0")
    for k in range(1, STEPS):
        both = of_source(kinds, now.where("not full").select("source", "tilt"))
        words = F.col("n") * F.col("size") * rate(F.col("tilt"), F.col("x"), most)
        slope = F.when(F.col("tilt") * F.col("x") < float(np.log(most)), words * F.col("x")).otherwise(0.0)
        step = of_source(now, both.groupBy("source").agg(F.sum(words).alias("words"), F.sum(slope).alias("slope")), "left")
        gap = F.col("words") - F.col("target")
        step = step.withColumn("low", F.when(gap < 0, F.col("tilt")).otherwise(F.col("low"))).withColumn("high", F.when(gap > 0, F.col("tilt")).otherwise(F.col("high")))
        to = F.col("tilt") - F.try_divide(gap, F.col("slope"))
        inside = (F.col("slope") > 0) & (to > F.col("low")) & (to < F.col("high"))
        half = F.when(F.col("low") == float("-inf"), F.col("high") - 1 - F.abs(F.col("high"))).otherwise((F.col("low") + F.col("high")) / 2)
        done = F.col("full") | (F.abs(gap) <= CLOSE * F.col("target"))
        step = step.withColumn("done", done).withColumn("tilt", F.when(done, F.col("tilt")).when(inside, to).otherwise(half))
        now = stage.write(step.drop("words", "slope"), f"tilts-{k}")
        if now.where("not done").isEmpty():
            return now.select(*sources.columns, "tilt")
        now = now.drop("done")
    raise RuntimeError("entropy balancing: the tilts did not settle")


def copies_of_kinds(batches: Iterator[pd.DataFrame], most: float) -> Iterator[pd.DataFrame]:
    """Adds ``total``, whole copies for all documents of a kind; rows come by source, large sizes first.

    Words that rounding leaves over or under go to the next smaller size, so a source's words miss the target by no
    more than half of one of its small documents, as long as these have room below ``most`` copies.
    """
    source, over = object(), 0.0
    for pdf in batches:
        totals = []
        for s, size, n, r in zip(pdf["source"], pdf["size"], pdf["n"], pdf["rate"], strict=True):
            if s != source:
                source, over = s, 0.0
            if size == 0:
                totals.append(n)
                continue
            want = over + r * n * size
            total = int(min(most * n, max(0, round(want / size))))
            over = want - total * size
            totals.append(total)
        yield pdf.assign(total=pd.Series(totals, dtype="int64", index=pdf.index))


def mix(docs: DataFrame, weights: Column, *, keep: tuple[str, ...] = ("doc_id",), most: int = 3, power: float = 0.5, seed: int = 12) -> DataFrame:
    """Whole copies of documents by source: returns the ``keep`` columns, size, source_size, target, rate, copies, taken.

    A size is the number of words of ``text`` (null: none). ``weights`` weighs a source by ``place``, its place by
    code point, null last; targets share all words by weight and stop at ``most`` times the source's own. Of all
    rates between 0 and ``most`` that give each source its target's words, those nearest to one copy of everything
    are taken: the sum of size^power * (r log r - r + 1) is least, so rates are exp(tilt * size^(1 - power)), up to
    ``most``. With a power of 0 every document counts alike and a shrinking source loses its long documents first;
    with 1 a source has one rate; between them long documents are only rarer. Rates depend on source and size, so
    documents are counted by both first; what the Newton steps read are these counts.
    Copies of one kind are dealt by a hash of id and text: some get one more than the others. Equal rows are rows of
    their own. Texts without words are kept once. Rates and copies do not depend on how rows are dealt. Columns of
    ``docs`` other than doc_id, text, source and those to keep are not read. An empty table gives no rows. Rounded
    copies never exceed ``most``; a source of one document cannot come nearer than half of it.
    """
    stage = Stage(docs.sparkSession, "mixing")
    kept = F.struct(*[F.col(c) for c in keep]).alias("row")
    tie = F.xxhash64(F.lit(seed), F.col("doc_id"), F.coalesce("text", F.lit("")))
    rows = stage.write(docs.select(kept, "source", word_count(F.col("text")).alias("size"), tie.alias("tie")), "rows")
    kinds = stage.write(rows.groupBy("source", "size").agg(F.count("*").alias("n")), "kinds")

    sources = kinds.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).cast("long").alias("size"), F.sum("n").alias("n"))
    placed = number_in_order(stage, sources.withColumn("all", F.lit(0)), "all", [F.col("source").asc_nulls_last()], "sources").withColumnRenamed("pos", "place")
    targets = stage.write(capped_targets(stage, placed.withColumn("weight", weights.cast("double")), most), "targets").select("source", "size", "n", "target")

    # The mean of x over a source's words is 1, so a tilt is of the size of the logarithm of what is asked.
    x = F.pow("size", F.lit(1.0 - power))
    means = kinds.groupBy("source").agg((F.sum(F.col("n") * F.col("size") * x) / F.greatest(F.sum(F.col("n") * F.col("size")), F.lit(1))).alias("mean"))
    kinds = stage.write(of_source(kinds, means).withColumn("x", x / F.greatest("mean", F.lit(1e-300))).drop("mean"), "scaled")
    solved = tilts(stage, kinds, targets, most).select("source", F.col("size").alias("source_size"), "target", "tilt")

    rated = of_source(kinds, solved).withColumn("rate", F.when(F.col("size") > 0, rate(F.col("tilt"), F.col("x"), most)).otherwise(1.0))
    schema = rated.schema.add("total", "long")
    # By source, rows go by in order of size: no more than there are different sizes, and only one number is held.
    parts = int(stage.spark.conf.get("spark.sql.shuffle.partitions"))
    rounded = rated.repartition(parts, "source").sortWithinPartitions("source", F.desc("size")).mapInPandas(lambda b: copies_of_kinds(b, most), schema)
    rounded = stage.write(rounded.select(kind_of("source", "size").alias("_kind"), "n", "total", "rate", "source_size", "target"), "rounded")

    numbered = number_in_order(stage, rows.withColumn("kind", kind_of("source", "size")), "kind", [F.col("tie").asc()], "numbered")
    more = (F.col("pos") < F.pmod("total", "n")).cast("long")
    out = numbered.join(rounded, F.col("kind") == F.col("_kind")).withColumn("copies", F.expr("total div n") + more)
    return out.select("row.*", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def kind_of(source: str, size: str) -> Column:
    """A text that tells kinds apart; a null source differs from an empty one."""
    return F.concat(F.col(size).cast("string"), F.when(F.col(source).isNull(), F.lit("?")).otherwise(F.concat(F.lit("="), F.col(source))))


def op12_entropy_balancing(spark, sf_dir: str) -> DataFrame:
    """All documents, sources weighing 5, 2, 1 and so on in turn, none above three times its words."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    place = F.pmod("place", F.lit(3))
    return mix(docs, F.when(place == 0, 5).when(place == 1, 2).otherwise(1)).drop("rate", "copies")
