"""Queries of telescope files that are written from the tables and read again, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyquilt.operators import factor
from skyquilt.operators import timestream as ts
from skyquilt.sources import fits as files
from skyquilt.sources import telescope

from . import steps
from .catalog import query, r, table


@query("select cast(vec_id as integer) as record_id, cast(label as integer) as scan, cast(690 + 20 * (vec_id % 3) as integer) as band, round(list_sum(list_transform(embedding, lambda x: cast(x as double))), 5) as total from embeddings where label in (2, 7) and vec_id % 3 = 1")
def scans_of_a_band(spark, sf_dir):
    """Spectra of all scans and bands written as FITS tables and indexed; two scans of one band are read by the index."""
    files.register(spark)
    path = files.shared_folder(spark, "indexed")
    e = table(spark, sf_dir, "embeddings")
    band = (690 + 20 * (F.col("vec_id") % 3)).cast("double") * 1e6
    rows = e.select(F.col("vec_id").cast("int").alias("TIME"), F.col("label").cast("int").alias("SCAN"), band.alias("CRVAL1"), F.transform("embedding", lambda x: x.cast("double")).alias("DATA"))
    rows.orderBy("SCAN", "CRVAL1", "TIME").write.format("sdfits").mode("overwrite").option("path", path).save()
    index = files.stager(spark, "index")(telescope.build_index(spark, path))
    back = telescope.read_indexed(index, "TIME int, SCAN int, CRVAL1 double, DATA array<double>", F.col("scan").isin(2, 7) & (F.col("band") == 710))
    total = F.aggregate("DATA", F.lit(0.0), lambda s, x: s + x)
    return back.select(F.col("TIME").alias("record_id"), F.col("SCAN").alias("scan"), F.rint(F.col("CRVAL1") / 1e6).cast("int").alias("band"), r(total, 5).alias("total"))


_RAW = (
    "raw as (select vec_id, label, i // 8 as t, (i // 4) % 2 as pol, i % 4 as chan, greatest(-127, least(127, cast(floor(cast(embedding[cast(i + 1 as integer)] as double) * 256 + 0.5) as integer))) as q from embeddings, generate_series(0, 63) as g(i)), "
    "seen as (select vec_id, t // 4 as bin, pol, t % 2 as phase, chan, case when label % 5 = 0 and chan = 3 then null else (q + case when pol = 0 then 128 else 0 end) * ((pol + 1) / 256.0) + chan * 0.5 end as value from raw)"
)


@query(f"with {_RAW} select vec_id as subint, cast(bin as integer) as bin, cast(pol as integer) as pol, cast(phase as integer) as phase, cast(chan as integer) as chan, round(avg(value), 6) as value from seen group by all")
def search_mode_samples(spark, sf_dir):
    """Embeddings as sub-integrations of 8 times, 2 polarisations and 4 channels: written as PSRFITS files, read in parts, scaled, masked, averaged by 4 and folded by 2."""
    telescope.register(spark)
    path = files.shared_folder(spark, "search")
    e = table(spark, sf_dir, "embeddings")
    whole = lambda x, i: F.greatest(F.lit(-127), F.least(F.lit(127), F.floor(x.cast("double") * 256 + 0.5).cast("int"))) + F.when(F.floor(i / 4) % 2 == 0, 128).otherwise(0)
    array = lambda values: F.array(*[F.lit(float(v)) for v in values])
    rows = e.select(
        F.col("vec_id").alias("subint"),
        F.transform("embedding", whole).alias("raw"),
        array([(p + 1) / 256 for p in range(2) for _ in range(4)]).alias("scale"),
        array([c * 0.5 for _ in range(2) for c in range(4)]).alias("offset"),
        F.when(F.col("label") % 5 == 0, array([1, 1, 1, 0])).otherwise(array([1, 1, 1, 1])).alias("weight"),
        array([700, 702, 704, 706]).alias("freq"),
    )
    # The list of what was written is kept, so that no file is written twice.
    written = files.stager(spark, "written")(telescope.write_psrfits(rows, path, (8, 2, 4), 0.5))
    back = spark.read.format("psrfits").option("average", 4).option("fold", 2).option("partBytes", 20000).load(path)
    names = written.select(F.regexp_extract("file", r"[^/]+$", 0).alias("_name"))
    back = back.withColumn("_name", F.regexp_extract("file", r"[^/]+$", 0)).join(names, "_name", "left_semi")
    return back.select("subint", (F.col("t") % 2).cast("int").alias("bin"), "pol", "phase", F.posexplode("spec").alias("chan", "value")).withColumn("value", r("value"))


@query("select cast(l_suppkey % 32 as bigint) as row, cast(l_partkey % 32 as bigint) as col, round(sum(l_quantity), 3) as value from lineitem group by all")
def updated_tiles(spark, sf_dir):
    """A matrix of sums on disk: what one return flag adds is written first, the others' tiles are added in place."""
    stage, path = files.stager(spark, "updates"), files.shared_folder(spark, "matrix")
    li = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 32).cast("long").alias("row"), (F.col("l_partkey") % 32).cast("long").alias("col"), F.col("l_quantity").cast("double").alias("value"), "l_returnflag")
    sums = lambda rows: factor.tiles(rows.groupBy("row", "col").agg(F.sum("value").alias("value")), 4)
    telescope.write_tiles(sums(li.where("l_returnflag = 'A'")), path, 2)
    for flag in ("N", "R"):
        telescope.update_tiles(stage, sums(li.where(F.col("l_returnflag") == flag)), path, 2, add=True)
    return factor.entries(telescope.read_tiles(spark, path), 4).select("row", "col", r("value", 3).alias("value"))


_SMOOTH = "spec as (select cast(label as integer) as scan, cast(vec_id as integer) as t, unnest(generate_series(0, 63)) as chan, cast(unnest(embedding) as double) as value from embeddings), h as (select scan, t, chan, 0.25 * lag(value) over w + 0.5 * value + 0.25 * lead(value) over w as value from spec window w as (partition by t order by chan))"


@query(f"with {_SMOOTH} select scan, cast(row_number() over (partition by scan, chan // 4 order by t) - 1 as integer) as t, cast(chan // 4 as integer) as chan, round(avg(value), 6) as value, '0: hanning' as step from h group by scan, t, chan // 4")
def files_through_chain(spark, sf_dir):
    """One file for each scan, smoothed and rebinned into files of the same names; half of them in a first run, all that is missing in a second, nothing in a third."""
    source, target = files.shared_folder(spark, "in"), files.shared_folder(spark, "out")
    e = table(spark, sf_dir, "embeddings")
    rows = e.select(F.concat(F.lit("scan-"), "label", F.lit(".fits")).alias("file"), F.col("label").cast("int").alias("scan"), F.lit(700).alias("band"), F.col("vec_id").cast("int").alias("t"), F.lit(-5).alias("pol"), F.lit("T").alias("cal"), F.lit(7e8).alias("crval1"), F.lit(1e5).alias("cdelt1"), F.lit(32.0).alias("crpix1"), F.transform("embedding", lambda x: x.cast("double")).alias("spec"), F.array().cast("array<string>").alias("history"))
    chain = steps.Chain(
        [
            steps.Step("hanning", lambda df: df.withColumn("spec", ts.hanning_array(F.col("spec")))),
            steps.Step("rebin", lambda df, n: df.withColumn("spec", ts.rebin_array(F.col("spec"), n)), {"n": 2}),
        ]
    )
    stage = files.stager(spark, "files")
    for half in (rows.where("scan < 5"), rows):
        stage(steps.write_records(half, source))
        stage(steps.run_files(spark, chain, source, target, {"n": 4}))
    again = stage(steps.run_files(spark, chain, source, target, {"n": 4})).count()
    files.register(spark)
    back = files.spectra(spark.read.format("sdfits").load(target))
    told = spark.read.format("sdfits").load(target).groupBy("file").agg(F.element_at(F.first("history"), 1).alias("h"))
    long = back.join(told, "file").select("scan", F.col("t").cast("int").alias("t"), F.posexplode("spec").alias("chan", "value"), F.substring("h", 1, 10).alias("step"))
    return long.where(F.lit(again) == 0).withColumn("value", r("value"))
