"""Named queries over the driver's tables, each with the SQL that must give the same rows.

The tables stand in for survey data: embeddings are spectra (vec_id is time, label the scan, 64 channels),
events are a time series (polarisation and calibrator from their ids, hours as times), lineitem holds
samples on a grid (quantity, discount and ship month are right ascension, declination and frequency).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyquilt.functions import columns as C
from skyquilt.functions.cosmology import Cosmology, frequency, interpolate, redshift, thermal_temperature
from skyquilt.operators import fits, generators, lineage, lookup, maps, modes, noise, spectra
from skyquilt.operators import timestream as ts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r(c: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


# The adapters, and the same in SQL.


def spectra_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("label").alias("scan"), F.col("vec_id").alias("t"), F.transform("embedding", lambda x: x.cast("double") + 2).alias("spec"))
    return ts.explode_spectra(e, "spec", ["scan", "t"])


SPEC = "spec as (select label as scan, vec_id as t, unnest(generate_series(0, 63)) as chan, cast(unnest(embedding) as double) + 2 as value from embeddings)"


def stream_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    pol = F.element_at(F.array(*[F.lit(p) for p in ("XX", "XY", "YX", "YY")]), (F.col("event_id") % 4 + 1).cast("int"))
    return e.select(F.floor(C.seconds_2000(F.col("ts")) / 3600).cast("long").alias("t"), pol.alias("pol"), F.when(F.floor(F.col("event_id") / 4) % 2 == 0, "T").otherwise("F").alias("cal"), (F.col("user_id") % 8).cast("int").alias("chan"), F.col("value")).groupBy("t", "pol", "cal", "chan").agg(F.avg("value").alias("value"))


STREAM = (
    "stream as (select cast(floor((epoch_us(ts) / 1000000.0 - 946684800) / 3600) as bigint) as t, (['XX','XY','YX','YY'])[cast(event_id % 4 + 1 as integer)] as pol, "
    "case when (event_id // 4) % 2 = 0 then 'T' else 'F' end as cal, cast(user_id % 8 as integer) as chan, avg(value) as value from events group by all)"
)


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy("event_type", F.floor(C.seconds_2000(F.col("ts")) / 3600).cast("long").alias("t")).agg(F.avg("value").alias("value"))


HOURLY = "hourly as (select event_type, cast(floor((epoch_us(ts) / 1000000.0 - 946684800) / 3600) as bigint) as t, avg(value) as value from events group by all)"


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.month("l_shipdate").cast("int").alias("fi"), F.floor(F.col("l_quantity") / 5).cast("int").alias("ri"), F.rint(F.col("l_discount") * 100).cast("int").alias("di"), F.col("l_extendedprice").alias("value"), (F.col("l_tax") + 0.01).alias("weight"), "l_orderkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount")


SAMPLES = "samples as (select cast(month(l_shipdate) as integer) as fi, cast(floor(l_quantity / 5) as integer) as ri, cast(round(l_discount * 100) as integer) as di, l_extendedprice as value, l_tax + 0.01 as weight, l_orderkey, l_suppkey, l_linenumber, l_quantity, l_discount from lineitem)"
GRID = SAMPLES + ", grid as (select fi, ri, di, sum(value * weight) / sum(weight) as value, sum(weight) as weight from samples group by all)"


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maps.weighted_stack(samples(spark, sf_dir))


# Flags, masks and rebinning.


@query(f"""with {SPEC}, v as (select scan, chan, var_pop(value) / (avg(value) * avg(value)) as q from spec group by all),
cuts as (select scan, avg(q) + 2 * stddev_pop(q) as cut from v group by scan),
ok as (select s.* from spec s join v using (scan, chan) join cuts using (scan) where q <= cut)
select scan, t // 8 as t, chan, round(avg(value), 6) as value from ok group by scan, t // 8, chan""")
def flagged_mean_spectrum(spark, sf_dir):
    rows = ts.flag_channels(spectra_rows(spark, sf_dir), [], ["scan"], sigma=2.0)
    return rows.where("value is not null").groupBy("scan", F.floor(F.col("t") / 8).cast("long").alias("t"), "chan").agg(r(F.avg("value")).alias("value"))


@query(f"with {SPEC} select scan, t, chan, round(value, 6) as value from spec")
def spectra_explode(spark, sf_dir):
    return spectra_rows(spark, sf_dir).withColumn("value", r("value"))


@query("select vec_id as t, c as chan, round((c + 1 - 32) * -0.5 + 700.0, 6) as freq from embeddings, generate_series(0, 63) as g(c)")
def frequency_axis(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("t"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(63).cast("long"))).alias("chan"))
    return e.withColumn("freq", r(C.wcs_axis(F.col("chan"), F.lit(32), F.lit(700.0), F.lit(-0.5))))


@query(f"with {SPEC} select scan, t, chan, case when chan * 0.5 + 0.25 <= 20 and chan * 0.5 - 0.25 >= 10 then null else round(value, 6) end as value from spec")
def band_stop_mask(spark, sf_dir):
    rows = spectra_rows(spark, sf_dir).withColumn("freq", F.col("chan") * 0.5)
    return ts.mask_frequency_range(rows, 10.0, 20.0, width=0.5).select("scan", "t", "chan", r("value").alias("value"))


@query(f"with {SPEC} select scan, t, chan, round(0.25 * lag(value) over w + 0.5 * value + 0.25 * lead(value) over w, 6) as value from spec window w as (partition by t order by chan)")
def hanning_smooth(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("label").alias("scan"), F.col("vec_id").alias("t"), ts.hanning_array(F.transform("embedding", lambda x: x.cast("double") + 2)).alias("spec"))
    return ts.explode_spectra(e, "spec", ["scan", "t"]).withColumn("value", r("value"))


@query(f"with {SPEC} select scan, t, chan // 4 as chan, round(avg(value), 6) as value from spec group by scan, t, chan // 4")
def rebin_frequency_mean(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("label").alias("scan"), F.col("vec_id").alias("t"), ts.rebin_array(F.transform("embedding", lambda x: x.cast("double") + 2), 4).alias("spec"))
    return ts.explode_spectra(e, "spec", ["scan", "t"]).select("scan", "t", F.col("chan").cast("long").alias("chan"), r("value").alias("value"))


@query(f"with {SPEC} select scan, t, chan // 5 as chan, round(median(value), 6) as value from spec group by scan, t, chan // 5")
def rebin_frequency_median(spark, sf_dir):
    return ts.rebin_frequency(spectra_rows(spark, sf_dir), ["scan", "t"], 5, "median").select("scan", "t", F.col("chan").cast("long").alias("chan"), r("value").alias("value"))


@query(f"with {SPEC}, f as (select scan, t, value, round_even(chan * 0.5 / 3.0, 0) * 3.0 as freq from spec) select scan, t, freq, round(avg(value), 6) as value from f group by all")
def rebin_frequency_width(spark, sf_dir):
    rows = spectra_rows(spark, sf_dir).withColumn("freq", F.col("chan") * 0.5)
    return ts.rebin_frequency_width(rows, ["scan", "t"], 3.0).select("scan", "t", "freq", r("value").alias("value"))


@query(f"with {SPEC}, n as (select max(t) + 1 as n from spec) select chan, t // 7 as t, round(avg(value), 6) as value from spec, n where t < n // 7 * 7 group by chan, t // 7")
def rebin_time_mean(spark, sf_dir):
    return ts.rebin_time(spectra_rows(spark, sf_dir), [], 7).select("chan", "t", r("value").alias("value"))


@query(f"with {SPEC} select scan, t, (chan - 4) // 20 as band, (chan - 4) % 20 as chan, round(value, 6) as value from spec where chan >= 4 and chan < 64")
def split_into_bands(spark, sf_dir):
    out = ts.split_bands(spectra_rows(spark, sf_dir), 3, 20, 4)
    return out.select("scan", "t", F.col("band").cast("long").alias("band"), F.col("chan").cast("long").alias("chan"), r("value").alias("value"))


@query(f"""with {SPEC}, b as (select t, 0 as band, chan, value from spec where chan < 36 union all select t, 1, chan - 28, value * 2 from spec where chan >= 28),
up as (select t, avg(value) as u from b where band = 0 and chan >= 30 and chan < 32 group by t), dn as (select t, avg(value) as d from b where band = 1 and chan >= 2 and chan < 4 group by t),
g as (select t, u / d as g from up join dn using (t))
select t, band * 28 + chan as chan, round(case when band = 1 then value * g else value end, 6) as value from b join g using (t) where (band = 0 or chan >= 4) and (band = 1 or chan < 32)""")
def stitch_overlap(spark, sf_dir):
    rows = spectra_rows(spark, sf_dir)
    low = rows.where("chan < 36").select("t", F.lit(0).alias("band"), "chan", "value")
    high = rows.where("chan >= 28").select("t", F.lit(1).alias("band"), (F.col("chan") - 28).alias("chan"), (F.col("value") * 2).alias("value"))
    return ts.stitch(low.union(high), ["t"], 8, 36).select("t", F.col("chan").cast("long").alias("chan"), r("value").alias("value"))


@query(f"""with {STREAM}, w as (select t, cal, chan, max(value) filter (where pol = 'XX') as xx, max(value) filter (where pol = 'YY') as yy from stream group by all)
select t, cal, chan, 'I' as pol, round(0.5 * xx + 0.5 * yy, 6) as value from w union all select t, cal, chan, 'Q', round(-0.5 * xx + 0.5 * yy, 6) from w""")
def rotate_polarisation(spark, sf_dir):
    return ts.rotate_polarisation(stream_rows(spark, sf_dir), ["t", "cal", "chan"], ["I", "Q"]).withColumn("value", r("value"))


@query(f"with {STREAM} select t, pol, chan, round(0.5 * max(value) filter (where cal = 'T') + 0.5 * max(value) filter (where cal = 'F'), 6) as value from stream group by all")
def combine_cal(spark, sf_dir):
    return ts.combine_cal(stream_rows(spark, sf_dir), ["t", "pol", "chan"]).withColumn("value", r("value"))


@query(f"""with {STREAM}, d as (select t, pol, chan, max(value) filter (where cal = 'T') - max(value) filter (where cal = 'F') as d from stream group by all),
m as (select pol, chan, avg(d) as m from d group by all) select s.t, s.pol, s.cal, s.chan, round(case when m > 0 then value / m end, 6) as value from stream s left join m using (pol, chan)""")
def scale_by_cal(spark, sf_dir):
    return ts.scale_by_cal(stream_rows(spark, sf_dir), ["t", "pol", "chan"]).select("t", "pol", "cal", "chan", r("value").alias("value"))


@query(f"""with {SPEC}, v as (select scan, chan, var_pop(value) / (avg(value) * avg(value)) as q from spec group by all), c as (select scan, avg(q) + 2 * stddev_pop(q) as cut from v group by scan)
select scan, chan from v join c using (scan) where q > cut""")
def noisy_channels(spark, sf_dir):
    return ts.noisy_channels(spectra_rows(spark, sf_dir), [], ["scan"], 2.0)


@query()
def flag_channels_until_stable(spark, sf_dir):
    rows = ts.flag_channels_until_stable(spectra_rows(spark, sf_dir), [], ["scan"], 2.0)
    return rows.groupBy("scan", "chan").agg(F.count("value").alias("n"))


@query(f"""with {HOURLY}, h as (select *, case when value > avg(value) over p + 2 * stddev_pop(value) over p then 1 else 0 end as hit from hourly window p as (partition by event_type)),
n as (select *, max(hit) over (partition by event_type order by t range between 2 preceding and 3 following) as near from h) select event_type, t, case when near = 0 then round(value, 6) end as value from n""")
def time_flag_dilate(spark, sf_dir):
    return ts.flag_times(hourly(spark, sf_dir), ["event_type"], 2.0, 3).select("event_type", "t", r("value").alias("value"))


@query(f"with {HOURLY} select event_type, t, round(case when count(value) over w = 5 then avg(value) over w end, 6) as smooth from hourly window w as (partition by event_type order by t rows between 2 preceding and 2 following)")
def boxcar_smooth(spark, sf_dir):
    return ts.boxcar(hourly(spark, sf_dir), ["event_type"], 5).select("event_type", "t", r("smooth").alias("smooth"))


@query(f"""with {HOURLY}, f as (select event_type, regr_slope(value, t - 757000) as a, regr_intercept(value, t - 757000) as b from hourly group by event_type)
select event_type, t, round(value - (a * (t - 757000) + b), 5) as value from hourly join f using (event_type)""")
def detrend_linear(spark, sf_dir):
    rows = hourly(spark, sf_dir).withColumn("x", F.col("t") - 757000)
    return ts.detrend(rows, ["event_type"], "x").select("event_type", "t", r("value", 5).alias("value"))


@query(f"with {HOURLY} select event_type, t, round(value - avg(value) over (partition by event_type), 6) as value from hourly")
def subtract_mean(spark, sf_dir):
    return ts.subtract_mean(hourly(spark, sf_dir), ["event_type"]).select("event_type", "t", r("value").alias("value"))


@query(f"with {SPEC} select scan, chan, count(value) as n, round(avg(value * value) - avg(value) * avg(value), 6) as variance from spec group by all")
def time_variance(spark, sf_dir):
    return ts.time_variance(spectra_rows(spark, sf_dir), ["scan", "chan"]).withColumn("variance", r("variance"))


@query(f"with {HOURLY}, b as (select *, case when t - lag(t) over w > 1 then 1 else 0 end as n from hourly window w as (partition by event_type order by t)) select event_type, t, sum(n) over (partition by event_type order by t) as block from b")
def scan_sessions(spark, sf_dir):
    return ts.sessions(hourly(spark, sf_dir), ["event_type"], 1.0, "t").select("event_type", "t", "block")


@query(f"with {STREAM} select pol, cal, count(*) as n, round(avg(value), 6) as mean, round(stddev_pop(value), 6) as deviation, round(min(value), 6) as low, round(max(value), 6) as high from stream group by all")
def scan_quality(spark, sf_dir):
    q = ts.scan_quality(stream_rows(spark, sf_dir), ["pol", "cal"])
    return q.select("pol", "cal", "n", *[r(c).alias(c) for c in ("mean", "deviation", "low", "high")])


@query(f"with {STREAM}, p as (select pol, t % 24 as phase, avg(value) as value from stream group by all) select pol, phase, case when (value - avg(value) over w) / stddev_pop(value) over w > 0.8 then 'on' when (value - avg(value) over w) / stddev_pop(value) over w < -0.7 then 'off' else 'blank' end as state from p window w as (partition by pol)")
def cal_phase(spark, sf_dir):
    return ts.fold_on_cal(stream_rows(spark, sf_dir), ["pol"], 24).select("pol", "phase", "state")


@query()
def gaussian_time_smooth(spark, sf_dir):
    return ts.gaussian_smooth(hourly(spark, sf_dir), ["event_type"], 5.0, 10).select("event_type", "t", r("smooth").alias("smooth"))


@query()
def filter_foregrounds(spark, sf_dir):
    return ts.filter_foregrounds(spectra_rows(spark, sf_dir), ["scan"], 8, 64).select("scan", "t", "chan", r("value").alias("value"))


# Maps and catalogs.


@query(f"with {SAMPLES} select fi, ri, di, count(*) as hits from samples group by all")
def hit_map(spark, sf_dir):
    return maps.hit_map(samples(spark, sf_dir))


@query(f"with {SAMPLES} select fi, ri, di, round(sum(weight * value), 4) as dirty, round(sum(weight), 6) as noise_inv from samples group by all")
def dirty_map(spark, sf_dir):
    m = maps.add_to_map(samples(spark, sf_dir), weight=F.col("weight"))
    return m.select("fi", "ri", "di", r("dirty", 4).alias("dirty"), r("noise_inv").alias("noise_inv"))


@query(f"""with {SAMPLES}, d as (select fi, ri, di, sum(weight * value) as dirty, sum(weight) as n from samples group by all)
select fi, ri, di, case when n >= 0.5 * max(n) over (partition by fi) then round(dirty / n, 4) end as value from d""")
def clean_map_diagonal(spark, sf_dir):
    m = maps.clean_diagonal(maps.add_to_map(samples(spark, sf_dir), weight=F.col("weight")), 0.5)
    return m.select("fi", "ri", "di", r("value", 4).alias("value"))


@query(f"with {GRID} select fi, ri, di, round(value, 4) as value, round(weight, 6) as weight from grid")
def weighted_stack(spark, sf_dir):
    return grid(spark, sf_dir).select("fi", "ri", "di", r("value", 4).alias("value"), r("weight").alias("weight"))


@query(f"with {GRID} select fi, ri, di, round(value - sum(weight * value) over w / sum(weight) over w, 4) as value from grid window w as (partition by fi)")
def subtract_weighted_mean(spark, sf_dir):
    return maps.subtract_weighted_mean(grid(spark, sf_dir), ["fi"]).select("fi", "ri", "di", r("value", 4).alias("value"))


@query(f"""with {GRID}, f as (select fi, avg(1 / weight) as nf from grid group by fi), p as (select ri, di, avg(1 / weight / nf) as np from grid join f using (fi) group by all)
select fi, ri, di, round(1 / (nf * np), 6) as weight from grid join f using (fi) join p using (ri, di)""")
def factorizable_weight(spark, sf_dir):
    return maps.factorizable_weight(grid(spark, sf_dir)).select("fi", "ri", "di", r("weight").alias("weight"))


@query(f"""with {GRID}, m as (select ri, di, avg(weight) as mw from grid group by all), c as (select quantile_cont(mw, 0.5) as cut from m), h as (select ri, di, mw > cut as high from m, c)
select fi, ri, di, round(case when high then avg(case when high then weight end) over (partition by fi) else weight end, 6) as weight from grid join h using (ri, di)""")
def saturate_weight(spark, sf_dir):
    return maps.saturate_weight(grid(spark, sf_dir)).select("fi", "ri", "di", r("weight").alias("weight"))


@query(f"""with {SAMPLES}, a as (select fi, ri, di, avg(value) as value, sum(weight) as weight from samples where l_orderkey % 2 = 0 group by all), b as (select fi, ri, di, avg(value) as t from samples where l_orderkey % 2 = 1 group by all)
select fi, round(sum(value * weight * t) / sum(t * weight * t), 6) as gain from a join b using (fi, ri, di) group by fi""")
def template_gain(spark, sf_dir):
    s = samples(spark, sf_dir)
    half = lambda k: s.where(F.col("l_orderkey") % 2 == k).groupBy("fi", "ri", "di").agg(F.avg("value").alias("value"), F.sum("weight").alias("weight"))
    return maps.template_gain(half(0), half(1), maps.PIXEL, ["fi"]).withColumn("gain", r("gain"))


@query(f"""with {SAMPLES}, a as (select fi, ri, di, avg(value) as value from samples where l_orderkey % 2 = 0 group by all), b as (select fi, ri, di, avg(value) as t from samples where l_orderkey % 2 = 1 group by all)
select fi, ri, di, round(value - t, 7) as value from a join b using (fi, ri, di)""")
def subtract_maps(spark, sf_dir):
    s = samples(spark, sf_dir)
    half = lambda k: s.where(F.col("l_orderkey") % 2 == k).groupBy("fi", "ri", "di").agg(F.avg("value").alias("value"))
    return maps.combine(half(0), half(1), -1.0).withColumn("value", r("value", 7))


@query(f"with {SAMPLES}, n as (select fi, ri, di, count(*) as n from samples group by all), f as (select fi, sum(n) as nf from n group by fi), p as (select ri, di, sum(n) as np from n group by all) select fi, ri, di, round(nf * np / (select sum(n) from n), 6) as nbar from f, p")
def separable_selection(spark, sf_dir):
    n = maps.hit_map(samples(spark, sf_dir)).withColumnRenamed("hits", "n")
    return maps.separable_selection(n).withColumn("nbar", r("nbar"))


@query(f"with {SAMPLES}, n as (select fi, ri, di, count(*) as n from samples group by all), f as (select fi, sum(n) as nf from n group by fi), p as (select ri, di, sum(n) as np from n group by all), s as (select fi, ri, di, nf * np / (select sum(n) from n) as nbar from f, p) select fi, ri, di, round(coalesce(n, 0) / nbar - 1, 6) as delta from s left join n using (fi, ri, di)")
def overdensity(spark, sf_dir):
    n = maps.hit_map(samples(spark, sf_dir)).withColumnRenamed("hits", "n")
    return maps.overdensity(n, maps.separable_selection(n)).select("fi", "ri", "di", r("delta").alias("delta"))


@query("""with b as (select c_nationkey, cast(floor(c_acctbal / 1000) as integer) as bx, cast(floor((c_custkey % 360) / 30) as integer) as bb, cast(floor(length(c_name) / 4) as integer) as bz from customer where c_acctbal >= 0 and c_acctbal < 10000 and length(c_name) < 40)
select bx, bb, bz, count(*) as n from b group by bx, bb, bz""")
def catalog_histogram(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return maps.bin_catalog(c, {"bx": C.bucket(F.col("c_acctbal"), 0, 1000, 10), "bb": C.bucket(F.col("c_custkey") % 360, 0, 30, 12), "bz": C.bucket(F.length("c_name"), 0, 4, 10)})


@query(f"with {GRID} select round((sum(weight * weight / 2) * sum(weight * weight / 2)) / sum(weight * weight / 2 * weight * weight / 2) / count(*), 6) as fsky from grid")
def sky_fraction(spark, sf_dir):
    return maps.sky_fraction(grid(spark, sf_dir).select(F.col("weight").alias("w1"), (F.col("weight") / 2).alias("w2"))).withColumn("fsky", r("fsky"))


@query(f"with {GRID} select fi, ri, di, round(case when fi in (3, 4) then 0 else weight end, 6) as weight, round(value, 4) as value from grid")
def sanitize_map(spark, sf_dir):
    return maps.sanitize(grid(spark, sf_dir), [3, 4]).select("fi", "ri", "di", r("weight").alias("weight"), r("value", 4).alias("value"))


@query(f"with {GRID}, k as (select i, j, case when i = 0 and j = 0 then 0.5 else 0.125 end as w from (values (0,0),(1,0),(-1,0),(0,1),(0,-1)) as t(i, j)) select g.fi, g.ri, g.di, round(sum(h.value * w), 3) as value from grid g, k join grid h on h.fi = g.fi and h.ri = g.ri - i and h.di = g.di - j group by all")
def convolve_map(spark, sf_dir):
    kernel = [(0, 0, 0.5), (1, 0, 0.125), (-1, 0, 0.125), (0, 1, 0.125), (0, -1, 0.125)]
    return maps.convolve(grid(spark, sf_dir), kernel).select("fi", "ri", "di", r("value_smooth", 3).alias("value"))


@query(f"with {SAMPLES} select fi, ri, di, arg_max(l_suppkey, value * 1000000 + l_suppkey) as best from samples group by all")
def brightest_source(spark, sf_dir):
    return maps.brightest(samples(spark, sf_dir), "l_suppkey", F.col("value") * 1000000 + F.col("l_suppkey"))


@query(f"with {SAMPLES} select fi, round(sum(weight), 5) as weight from samples group by fi order by weight desc, fi limit 3")
def best_frequencies(spark, sf_dir):
    return maps.best_frequencies(samples(spark, sf_dir), 3)


# Lookups.

POINTS = GRID + ", points as (select l_orderkey, l_linenumber, max(fi) as fi, max(di) as di, max(l_quantity) as l_quantity, max(value) as value from samples group by all)"


#: Samples that a task groups at once.
GROUPED_ROWS = 500_000


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples with unique keys, grouped in parts of about GROUPED_ROWS, so that a task's table does not grow with the input."""
    s = samples(spark, sf_dir)
    parts = max(1, -(-s.count() // GROUPED_ROWS))
    return s.repartition(parts, "l_orderkey", "l_linenumber").groupBy("l_orderkey", "l_linenumber").agg(*[F.max(c).alias(c) for c in ("fi", "di", "l_quantity", "value")])


@query(f"with {POINTS} select l_orderkey, l_linenumber, round(s.value - g.value, 6) as value from points s left join grid g on g.fi = s.fi and g.ri = cast(round_even(l_quantity / 5.0, 0) as integer) and g.di = s.di")
def subtract_map_nearest(spark, sf_dir):
    s, position = points(spark, sf_dir), {"ri": F.col("l_quantity") / 5.0}
    out = lookup.subtract_map(s, grid(spark, sf_dir), ["l_orderkey", "l_linenumber", "fi", "di"], position, "nearest", ["fi", "di"])
    return out.select("l_orderkey", "l_linenumber", r("value", 6).alias("value"))


@query(f"""with {POINTS}, p as (select l_orderkey, l_linenumber, fi, di, l_quantity / 5.0 as x, unnest([0, 1]) as k from points),
q as (select *, floor(x) + k as ri, 1 - abs(x - floor(x) - k) as w from p), n as (select l_orderkey, l_linenumber, g.value as v, w from q left join grid g on g.fi = q.fi and g.di = q.di and g.ri = q.ri where w <> 0)
select l_orderkey, l_linenumber, case when count(v) = count(*) then round(sum(w * v), 4) end as map_value from n group by all""")
def map_lookup_linear(spark, sf_dir):
    s = points(spark, sf_dir)
    out = lookup.lookup_map(s, grid(spark, sf_dir), ["l_orderkey", "l_linenumber", "fi", "di"], {"ri": F.col("l_quantity") / 5.0}, "linear", ["fi", "di"])
    return out.select("l_orderkey", "l_linenumber", r("map_value", 4).alias("map_value"))


@query()
def map_lookup_cubic(spark, sf_dir):
    s = points(spark, sf_dir)
    out = lookup.lookup_map(s, grid(spark, sf_dir), ["l_orderkey", "l_linenumber", "fi", "di"], {"ri": F.col("l_quantity") / 5.0}, "cubic", ["fi", "di"])
    return out.select("l_orderkey", "l_linenumber", r("map_value", 4).alias("map_value"))


@query("""with l as (select o_orderkey, o_custkey % 50 as k, o_orderdate as t from orders), p as (select o_custkey % 50 as k, o_orderdate as t, max(o_totalprice) as price from orders where o_orderpriority = '1-URGENT' group by all)
select o_orderkey, price from l asof left join p on l.k = p.k and l.t >= p.t""")
def cal_asof_join(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("k", F.col("o_custkey") % 50)
    left = o.select("o_orderkey", "k", F.col("o_orderdate").alias("t"))
    right = o.where("o_orderpriority = '1-URGENT'").groupBy("k", F.col("o_orderdate").alias("t")).agg(F.max("o_totalprice").alias("price"))
    return lookup.asof_join(left, right, ["k"], "t", "price").select("o_orderkey", "price")


@query(f"""with {HOURLY}, c as (select event_type, t, value as y from hourly where value > 60), l as (select event_type, t from hourly),
a as (select l.*, c.t as x0, c.y as y0 from l asof left join c on l.event_type = c.event_type and l.t >= c.t), b as (select l.*, c.t as x1, c.y as y1 from l asof left join c on l.event_type = c.event_type and l.t <= c.t)
select a.event_type, a.t, round(case when x0 = x1 then y0 else y0 + (y1 - y0) / nullif(x1 - x0, 0) * (a.t - x0) end, 9) as y from a join b using (event_type, t)""")
def cal_interpolate(spark, sf_dir):
    h = hourly(spark, sf_dir)
    out = lookup.bracket_interpolate(h.select("event_type", "t"), h.where("value > 60").select("event_type", "t", F.col("value").alias("y")), ["event_type"], "t", "y")
    return out.select("event_type", "t", r("y", 9).alias("y"))


@query("select s.s_suppkey, c.c_custkey from supplier s join customer c on c.c_acctbal between s.s_acctbal - 2 and s.s_acctbal + 2")
def range_scan_match(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_acctbal") - 2).alias("lo"), (F.col("s_acctbal") + 2).alias("hi"))
    return lookup.interval_join(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), s, "c_acctbal", "lo", "hi", 10.0).select("s_suppkey", "c_custkey")


@query("with q as (select p_size, sum(p_retailprice) as total, count(*) as n from part group by p_size), m as (select s.p_size, sum(q.total) / sum(q.n) as price from q s join q on abs(q.p_size - s.p_size) <= 1 group by s.p_size) select p_partkey, round(price, 6) as price from part join m using (p_size)")
def range_average(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("price"))
    return lookup.range_average(p.drop("price"), p, "p_partkey", "x", "price", 2.0).select("p_partkey", r("price").alias("price"))


@query("select s.s_suppkey, c.c_custkey from supplier s join customer c on abs(s.s_acctbal - c.c_acctbal) <= 1.0")
def close_k_match(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_acctbal").alias("k"))
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("k"))
    return lookup.close_match(s, c, "k", 1.0).select("s_suppkey", F.col("c_custkey_right").alias("c_custkey"))


@query('select a.n_name as "left", b.n_name as "right" from nation a join nation b on a.n_name < b.n_name')
def unordered_pairs(spark, sf_dir):
    return lookup.unordered_pairs(table(spark, sf_dir, "nation"), "n_name")


@query("select a.r_name || '_with_' || b.r_name as forward, b.r_name || '_with_' || a.r_name as backward from region a join region b on a.r_name < b.r_name")
def cross_names(spark, sf_dir):
    return lookup.cross_names(table(spark, sf_dir, "region"), "r_name")


@query("select c_custkey from customer where c_custkey not in (select o_custkey from orders)")
def unprocessed_keys(spark, sf_dir):
    return lookup.incremental(table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


# Modes and spectra.


@query(f"with {SPEC} select a.chan, b.chan as chan2, round(sum(a.value * b.value) / count(*), 6) as cov from spec a join spec b on a.t = b.t group by all")
def freq_covariance(spark, sf_dir):
    return modes.freq_covariance(spectra_rows(spark, sf_dir).withColumn("weight", F.lit(1.0)), ["t"]).select(F.col("chan").cast("long").alias("chan"), F.col("chan2").cast("long").alias("chan2"), r("cov").alias("cov"))


@query(f"""with {SPEC}, c as (select a.chan, b.chan as chan2, sum(a.value * b.value) / count(*) as cov from spec a join spec b on a.t = b.t group by all), d as (select chan, cov as d from c where chan = chan2)
select c.chan, c.chan2, round(cov / sqrt(x.d * y.d), 6) as corr from c join d x on x.chan = c.chan join d y on y.chan = c.chan2""")
def freq_correlation(spark, sf_dir):
    cov = modes.freq_covariance(spectra_rows(spark, sf_dir).withColumn("weight", F.lit(1.0)), ["t"])
    return modes.normalise(cov).select(F.col("chan").cast("long").alias("chan"), F.col("chan2").cast("long").alias("chan2"), r("corr").alias("corr"))


@query(f"""with {SPEC}, a as (select t, sum(value / 8) as amp from spec group by t) select t, chan, round(value - amp / 8, 6) as value, round(amp, 6) as amp from spec join a using (t)""")
def mode_project(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("t"), F.transform("embedding", lambda x: x.cast("double") + 2).alias("spec"))
    out = modes.subtract_modes(e, "spec", [[1 / 8] * 64])
    return ts.explode_spectra(out, "spec", ["t", "amp0"]).select("t", F.col("chan").cast("long").alias("chan"), r("value").alias("value"), r("amp0").alias("amp"))


@query()
def svd_clean(spark, sf_dir):
    rows = spectra_rows(spark, sf_dir)
    cov = modes.freq_covariance(rows.withColumn("weight", F.lit(1.0)), ["t"])
    _, _, left, _ = modes.svd_modes(cov, 3)
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("t"), F.transform("embedding", lambda x: x.cast("double") + 2).alias("spec"))
    return ts.explode_spectra(modes.subtract_modes(e, "spec", left.tolist()), "spec", ["t"]).withColumn("value", r("value", 4))


@query(f"""with {GRID}, v as (select fi, ri, di, value / 10000 as value, weight from grid), o as (select i, j, case when i = 0 and j = 0 then 0 else 1 end as lag from (values (0,0),(1,0),(-1,0),(0,1),(0,-1)) as t(i, j))
select a.fi as f1, b.fi as f2, cast(lag as integer) as lag, round(sum(a.weight * b.weight * a.value * b.value) / sum(a.weight * b.weight), 5) as corr from v a, o join v b on b.ri = a.ri + i and b.di = a.di + j group by all""")
def lag_correlation(spark, sf_dir):
    g = grid(spark, sf_dir).withColumn("value", F.col("value") / 10000)
    return modes.correlation(g, g, [0.0, 0.5, 1.2], 1, 1.0).select("f1", "f2", "lag", r("corr", 5).alias("corr"))


@query(f"with {GRID}, k as (select sqrt(power(ri - 5, 2) + power(di - 5, 2)) as k, value from grid), b as (select case when k = 8 then 3 else cast(floor(k / 2) as integer) end as bin, value from k where k <= 8) select bin, round(avg(value), 4) as power, count(*) as counts from b group by bin")
def radial_bins(spark, sf_dir):
    g = grid(spark, sf_dir).withColumn("k", F.sqrt((F.col("ri") - 5) ** 2 + (F.col("di") - 5) ** 2)).withColumnRenamed("value", "power")
    return spectra.radial_bins(g, [], [0.0, 2.0, 4.0, 6.0, 8.0]).select("bin", r("power", 4).alias("power"), "counts")


@query(f"with {GRID} select least(ri // 3, 2) as bx, least(di // 4, 1) as by, round(avg(value), 4) as power, count(*) as counts from grid where ri <= 9 and di <= 8 group by all")
def bins_2d(spark, sf_dir):
    g = grid(spark, sf_dir).select(F.col("ri").alias("kperp"), F.col("di").alias("kpar"), F.col("value").alias("power"))
    return spectra.bins_2d(g, [], [0, 3, 6, 9], [0, 4, 8]).select("bx", "by", r("power", 4).alias("power"), "counts")


TRIALS = SAMPLES + ", trials as (select l_suppkey % 20 as sim, ri as bin, avg(value) as power, count(*) as counts from samples group by all)"


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).groupBy((F.col("l_suppkey") % 20).alias("sim"), F.col("ri").alias("bin")).agg(F.avg("value").alias("power"), F.count("*").alias("counts"))


@query(f"with {TRIALS} select bin, round(avg(power), 4) as mean, round(stddev_samp(power), 4) as std, count(power) as n from trials group by bin")
def sim_statistics(spark, sf_dir):
    return spectra.statistics(trials(spark, sf_dir), ["bin"]).select("bin", r("mean", 4).alias("mean"), r("std", 4).alias("std"), "n")


@query(f"with {TRIALS} select a.bin, b.bin as bin2, round(covar_samp(a.power, b.power), 2) as cov, round(corr(a.power, b.power), 5) as corr from trials a join trials b using (sim) group by all")
def sim_covariance(spark, sf_dir):
    return spectra.covariance(trials(spark, sf_dir), [], "sim").select("bin", "bin2", r("cov", 2).alias("cov"), r("corr", 5).alias("corr"))


@query(f"with {TRIALS}, o as (select * from trials where sim < 10), i as (select sim + 10 as s, * from trials where sim < 10), j as (select o.sim, o.bin, o.power as po, o.counts, p.power as pi from o join trials p on p.sim = o.sim + 10 and p.bin = o.bin) select sim, bin, round(greatest(0, least(1, po / (pi * 1.02))), 6) as transfer from j")
def transfer_function(spark, sf_dir):
    t = trials(spark, sf_dir)
    ref = t.where("sim >= 10").withColumn("sim", F.col("sim") - 10)
    return spectra.transfer_function(t.where("sim < 10"), ref, ["sim", "bin"], 1.02).withColumn("transfer", r("transfer"))


@query(f"with {TRIALS}, m as (select bin, avg(power) / 10000 as mean, sum(counts) as counts from trials group by bin) select bin, round(abs(counts / (mean * mean)), 4) as weight from m")
def noise_weight(spark, sf_dir):
    m = trials(spark, sf_dir).groupBy("bin").agg((F.avg("power") / 10000).alias("mean"), F.sum("counts").alias("counts"))
    return spectra.noise_weight(m, ["bin"]).withColumn("weight", r("weight", 4))


@query(f"with {TRIALS}, k as (select sqrt(sim * sim + bin * bin) as k, power, counts from trials where counts > 0), b as (select case when k = 24 then 5 else cast(floor(k / 4) as integer) end as bin, power, counts from k where k <= 24) select bin, round(sum(power * counts) / sum(counts), 4) as power, sum(counts) as counts, round(1 / sqrt(sum(counts)), 6) as error from b group by bin")
def collapse_2d_to_1d(spark, sf_dir):
    t = trials(spark, sf_dir).select(F.col("sim").cast("double").alias("kx"), F.col("bin").cast("double").alias("ky"), "power", "counts")
    return spectra.collapse_2d(t, [], [0.0, 4.0, 8.0, 12.0, 16.0, 20.0, 24.0]).select("bin", r("power", 4).alias("power"), "counts", r("error").alias("error"))


@query(f"with {GRID} select cast(floor(sqrt(power(ri - 4, 2) + power(di - 5, 2)) / 1.5) as integer) as ring, round(avg(value), 4) as mean, count(*) as n from grid group by ring")
def azimuthal_average(spark, sf_dir):
    return spectra.azimuthal_average(grid(spark, sf_dir), [], ["ri", "di"], [4, 5], 1.5).select("ring", r("mean", 4).alias("mean"), "n")


@query(f"with {TRIALS} select sim, {', '.join(f'max(power) filter (where bin = {k}) as b{k}' for k in range(11))} from (select sim, bin, round(power, 4) as power from trials) group by sim")
def pivot_bins(spark, sf_dir):
    t = trials(spark, sf_dir).select("sim", F.concat(F.lit("b"), "bin").alias("combination"), r("power", 4).alias("power"))
    return spectra.pivot_combinations(t, ["sim"], [f"b{k}" for k in range(11)])


@query()
def pair_power_spectra(spark, sf_dir):
    g = grid(spark, sf_dir).where("fi <= 12 and di < 11").withColumn("fi", F.col("fi") - 1).withColumn("pair", F.lit("A_with_B"))
    cells = spectra.pair_spectra(g, g, ["pair"], (12, 11, 11), (1.0, 1.0, 1.0))
    return spectra.radial_bins(cells, ["pair"], C.log_edges(0.3, 6.0, 8)).select("pair", "bin", r("power", 3).alias("power"), "counts")


@query()
def series_power_spectrum(spark, sf_dir):
    rows = ts.time_grid(hourly(spark, sf_dir).withColumn("t_sec", F.col("t") * 3600.0), ["event_type"], 3600.0, 720)
    return spectra.series_power(rows, ["event_type"], 720, dt=3600.0).select("event_type", "i", r(F.col("power") / 100000, 3).alias("power"))


# Scalars.


@query("select event_id, round(epoch_us(ts) / 1000000.0 - 946684800, 2) as seconds, substr(strftime(ts, '%Y-%m-%dT%H:%M:%S.%f'), 1, 22) as text, round(fmod(fmod(280.46061837 + ((epoch_us(ts) / 1000000.0 - 946684800) - 43200) / 86400 * 360.98564736629 - 79.83983, 360) + 360, 360), 4) as lst from events")
def time_codec(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    # Ties are rounded as the SQL does, on the product with 100: seconds since 2000 carry the error of a larger number.
    seconds = F.round(C.seconds_2000(F.col("ts")) * 100) / 100
    return e.select("event_id", seconds.alias("seconds"), C.time_text(C.seconds_2000(F.col("ts"))).alias("text"), r(C.sidereal_degrees(F.col("ts")), 4).alias("lst"))


@query("select event_id, case event_id % 4 when 0 then 'I' when 1 then 'XX' when 2 then 'YY' else 'RL' end as name from events")
def polarisation_names(spark, sf_dir):
    code = F.element_at(F.array(*[F.lit(c) for c in (1, -5, -6, -3)]), (F.col("event_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", C.polarisation_name(code).alias("name"))


@query("select c_custkey, case when d < 0 then '-' else '' end || printf('%02d:%02d:%05.2f', v // 360000, v % 360000 // 6000, (v % 6000) / 100.0) as text from (select c_custkey, c_acctbal / 200 as d, cast(round(abs(c_acctbal / 200) * 360000) as bigint) as v from customer)")
def sexagesimal_text(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", C.sexagesimal(F.col("c_acctbal") / 200).alias("text"))


@query("""select c_custkey, round(fmod(fmod(30 - degrees(atan2(-sin(a) * cos(e), sin(e) * cos(p) - cos(e) * cos(a) * sin(p))), 360) + 360, 360), 5) as ra, round(degrees(asin(sin(e) * sin(p) + cos(e) * cos(p) * cos(a))), 5) as dec
from (select c_custkey, radians(20 + c_custkey % 60) as e, radians(c_custkey * 7 % 360 + 0.5) as a, radians(38.43312) as p from customer)""")
def horizon_to_sky(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    ra, dec = C.horizon_to_sky(20 + F.col("c_custkey") % 60, F.col("c_custkey") * 7 % 360 + 0.5, F.lit(30.0))
    return c.select("c_custkey", r(ra, 5).alias("ra"), r(dec, 5).alias("dec"))


@query("select p_partkey, round(1420.40575177 / (500 + p_size * 8) - 1, 8) as z, round(20 + (900 - (500 + p_size * 8)) / 200.0 * 10, 6) as tsys from part")
def redshift_of_channel(spark, sf_dir):
    f = F.lit(500) + F.col("p_size") * 8
    return table(spark, sf_dir, "part").select("p_partkey", r(redshift(f), 8).alias("z"), r(thermal_temperature(f), 6).alias("tsys"))


@query("select p_partkey, round(70.2 * sqrt(0.274 * power(1 + p_size / 20.0, 3) + 0.726), 6) as h, round(977.7922216807892 / 70.2 * 2 / (3 * sqrt(0.726)) * asinh(sqrt(0.726 / 0.274) * power(1 + p_size / 20.0, -1.5)), 6) as age from part")
def hubble_and_age(spark, sf_dir):
    z, c = F.col("p_size") / 20.0, Cosmology()
    return table(spark, sf_dir, "part").select("p_partkey", r(c.hubble(z), 6).alias("h"), r(c.age(z), 6).alias("age"))


@query()
def cosmic_distances(spark, sf_dir):
    z, c = F.col("p_size") / 20.0, Cosmology()
    named = {"comoving": c.comoving_distance(z), "angular": c.angular_diameter_distance(z), "luminosity": c.luminosity_distance(z), "lookback": c.lookback_time(z), "growth": c.growth_factor(z), "brightness": c.brightness_temperature(z), "mhz": frequency(z)}
    return table(spark, sf_dir, "part").select("p_partkey", *[r(v, 5).alias(k) for k, v in named.items()])


@query("select c_custkey, round(case when x < 700 or x > 900 then 0.316 when x <= 800 then 0.3 + (x - 700) / 100 * 0.02 else 0.32 + (x - 800) / 100 * 0.04 end, 6) as fwhm from (select c_custkey, 650 + c_acctbal / 30 as x from customer)")
def beam_width(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", r(interpolate(650 + F.col("c_acctbal") / 30, [700.0, 800.0, 900.0], [0.3, 0.32, 0.36], 0.316), 6).alias("fwhm"))


@query("select p_partkey, cast(round_even(p_retailprice / 100.0 - 5 + 10, 0) as integer) as nearest, case when abs(p_size / 10.0) < 1 then round(1.5 * power(p_size / 10.0, 3) - 2.5 * power(p_size / 10.0, 2) + 1, 6) when p_size / 10.0 < 2 then round(-0.5 * power(p_size / 10.0, 3) + 2.5 * power(p_size / 10.0, 2) - 4 * (p_size / 10.0) + 2, 6) else 0.0 end as kernel from part")
def pixel_and_kernel(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", C.pixel(F.col("p_retailprice"), 20, 500.0, 100.0).alias("nearest"), r(C.keys_weight(F.col("p_size") / 10.0)).alias("kernel"))


# Likelihoods, lineage, generators.


@query("""with d as (select p_size as x, count(*) as p from part group by 1), s as (select x, p, coalesce((x - lag(x) over (order by x)) * (p + lag(p) over (order by x)) / 2.0, 0) as s from d), c as (select x, sum(s) over (order by x) as c from s), n as (select x, c / max(c) over () as cdf from c)
select x, round(cdf, 6) as cdf from n""")
def density_cumulative(spark, sf_dir):
    d = table(spark, sf_dir, "part").groupBy(F.col("p_size").alias("x")).agg(F.count("*").alias("p")).withColumn("k", F.lit(1))
    return fits.cumulative(d, ["k"]).select("x", r("cdf").alias("cdf"))


@query("""with d as (select p_size as x, count(*) as p from part group by 1), s as (select x, p, coalesce((x - lag(x) over (order by x)) * (p + lag(p) over (order by x)) / 2.0, 0) as s from d), c as (select x, sum(s) over (order by x) as c from s), n as (select x, c / max(c) over () as cdf from c), l as (select x, cdf, lag(x) over (order by x) as x0, lag(cdf) over (order by x) as c0 from n)
select round(min(case when c0 < 0.16 and cdf >= 0.16 then x0 + (x - x0) * (0.16 - c0) / (cdf - c0) end), 5) as low, round(min(case when c0 < 0.5 and cdf >= 0.5 then x0 + (x - x0) * (0.5 - c0) / (cdf - c0) end), 5) as middle, round(min(case when c0 < 0.84 and cdf >= 0.84 then x0 + (x - x0) * (0.84 - c0) / (cdf - c0) end), 5) as high from l""")
def confidence_interval(spark, sf_dir):
    d = table(spark, sf_dir, "part").groupBy(F.col("p_size").alias("x")).agg(F.count("*").alias("p")).withColumn("k", F.lit(1))
    return fits.confidence_interval(d, ["k"]).select(*[r(c, 5).alias(c) for c in ("low", "middle", "high")])


@query("with g as (select x / 10.0 as x from generate_series(1, 30) as t(x)), b as (select p_size, avg(p_retailprice) / 1000 as v, stddev_samp(p_retailprice) / 1000 + 0.01 as e from part group by p_size) select x, round(sum(-0.5 * power((v - x * 1.1) / e, 2)), 3) as loglike from b, g group by x")
def amplitude_likelihood(spark, sf_dir):
    b = table(spark, sf_dir, "part").groupBy("p_size").agg((F.avg("p_retailprice") / 1000).alias("v"), (F.stddev_samp("p_retailprice") / 1000 + 0.01).alias("e")).withColumn("model", F.lit(1.1))
    g = spark.range(1, 31).select((F.col("id") / 10.0).alias("x"))
    return fits.gaussian_likelihood(b, g, [], "v", "e").select("x", r("loglike", 3).alias("loglike"))


@query("select l_suppkey, round(100 / (median(l_extendedprice) filter (where l_linenumber <= 2) - median(l_extendedprice) filter (where l_linenumber > 2)), 8) as gain from lineitem group by 1")
def on_off_gain(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_linenumber", F.col("l_extendedprice").alias("value"))
    out = fits.robust_gain(li.where("l_linenumber <= 2"), li.where("l_linenumber > 2"), ["l_suppkey"], F.lit(100.0))
    return out.withColumn("gain", r("gain", 8))


@query("select part, string_agg(distinct v, ',' order by v) as vals from (select 'finish' as part, split_part(p_type, ' ', 1) as v from part union all select 'kind', split_part(p_type, ' ', 2) from part union all select 'metal', split_part(p_type, ' ', 3) from part) where v <> '' group by part")
def tag_cases(spark, sf_dir):
    out = lineage.tag_cases(table(spark, sf_dir, "part"), "p_type", ["finish", "kind", "metal"], " ")
    return out.select("part", F.array_join("values", ",").alias("vals"))


@query("select distinct split_part(p_type, ' ', 1) as tag from part where split_part(p_type, ' ', 1) <> 'PROMO'")
def first_tags(spark, sf_dir):
    return lineage.first_tags(table(spark, sf_dir, "part"), "p_type", " ", ["PROMO"])


@query("select conv_id, count(*) as n, string_agg(printf('%03d: ', turn) || role, ';' order by turn) as history from conversations group by conv_id")
def history_of_turns(spark, sf_dir):
    h = lineage.collect_history(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", F.col("role"))
    return h.select("conv_id", F.size("history").cast("long").alias("n"), F.array_join("history.entry", ";").alias("history"))


@query("select o_orderkey from orders where o_orderkey not in (select l_orderkey from lineitem)")
def unmatched_keys(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return lineage.unmatched(o, li, "o_orderkey").where("fault = 'no group'").select("o_orderkey")


@query(f"with {GRID} select fi, count(*) as n, true as centred, true as scaled from grid group by fi")
def thermal_noise_cube(spark, sf_dir):
    """Noise of the grid's cells, whose weights are their times: over what is expected of each it has no mean and unit variance in every channel, up to six deviations."""
    noisy = generators.thermal_noise(grid(spark, sf_dir).select("fi", "ri", "di", "weight"), thermal_temperature(700 + F.col("fi")), 1e6, F.col("weight"), 1)
    z = F.col("value") / (thermal_temperature(700 + F.col("fi")) / F.sqrt(1e6 * F.col("weight")))
    sums = noisy.groupBy("fi").agg(F.count("*").alias("n"), F.sum(z).alias("s"), F.sum(z * z).alias("q"))
    return sums.select("fi", "n", (F.abs("s") <= 6 * F.sqrt("n")).alias("centred"), (F.abs(F.col("q") - F.col("n")) <= 6 * F.sqrt(2 * F.col("n"))).alias("scaled"))


@query(f"with {GRID} select fi, count(*) as n, round(sum(weight * 20), 4) as expected, true as near from grid group by fi")
def poisson_galaxies(spark, sf_dir):
    """Poisson numbers of the grid's cells with twenty times their weight expected: their sum in a channel is that of what is expected, up to six deviations."""
    g = grid(spark, sf_dir).select("fi", "ri", "di", "weight")
    drawn = generators.poisson_counts(g, F.col("weight") * 20, 3).groupBy("fi").agg(F.sum("n").alias("drawn"), F.count("*").alias("n"), F.sum(F.col("weight") * 20).alias("e"))
    return drawn.select("fi", "n", r("e", 4).alias("expected"), (F.abs(F.col("drawn") - F.col("e")) <= 6 * F.sqrt("e")).alias("near"))


@query(f"with {GRID} select count(*) * (select count(*) from nation) as n, true as near from grid")
def gaussian_field(spark, sf_dir):
    """A field for every nation, seen in the grid's cells: its variance there is near that of the spectrum."""
    n, shape = table(spark, sf_dir, "nation").count(), (12, 11, 11)
    fields = generators.gaussian_fields(spark, n, shape, (1.0, 1.0, 1.0), lambda k: k**-1.5, 5)
    cells = grid(spark, sf_dir).select((F.col("fi") - 1).alias("fi"), "ri", "di")
    k = np.sqrt(sum(x**2 for x in spectra.wave_numbers(shape, (1.0, 1.0, 1.0))))
    expected = float((k[k > 0] ** -1.5).sum() / k.size)
    return fields.join(cells, ["fi", "ri", "di"]).agg(F.count("*").alias("n"), (F.abs(F.avg(F.col("value") ** 2) / expected - 1) < 0.5).alias("near"))


@query(f"with {HOURLY} select count(*) as n, true as near from hourly")
def over_f_series(spark, sf_dir):
    """1/f noise for the hours of every type of event: its variance over all of them is near that of the spectrum."""
    h = hourly(spark, sf_dir)
    slot = F.col("t") - F.min("t").over(Window.partitionBy("event_type"))
    number = h.select("event_type").distinct().withColumn("stream", F.dense_rank().over(Window.orderBy("event_type")) - 1)
    seen = h.withColumn("t", slot.cast("int")).join(F.broadcast(number), "event_type").select("stream", "t")
    length, streams = seen.agg(F.max("t") + 1, F.max("stream") + 1).first()
    made = generators.over_f_noise(spark, streams, length, 1.0, -0.5, 0.1, 1.0, 9)
    expected = float(spectra.over_f_spectrum(1.0, -0.5, 0.1, 1.0, 2 * length).mean() / 2)
    both = seen.join(made.select(F.col("stream").cast("int").alias("stream"), F.col("t").cast("int").alias("t"), "value"), ["stream", "t"])
    return both.agg(F.count("*").alias("n"), (F.abs(F.avg(F.col("value") ** 2) / expected - 1) < 0.5).alias("near"))


@query()
def correlated_noise_map(spark, sf_dir):
    li, ship = table(spark, sf_dir, "lineitem"), F.col("l_shipdate")
    pixel = (F.floor(F.col("l_quantity") / 5) * 11 + F.rint(F.col("l_discount") * 100)).cast("long")
    s = li.select(F.col("l_returnflag").alias("chan"), (F.year(ship) * 12 + F.month(ship)).alias("scan"), F.dayofmonth(ship).alias("t"), pixel.alias("p"), (F.col("l_extendedprice") / 1e4).alias("value"), F.lit(1.0).alias("var"))
    dirty, inverse = maps.correlated_map(s, ["chan"])
    return maps.solve_channels(dirty, inverse, ["chan"], 1e-6).select("chan", "p", r("value", 3).alias("value"))


# Noise, more spectra and checks.


@query(f"""with {SPEC}, f as (select chan, i as f, sum(value * cos(t * i * (2 * pi() / 500))) as re, sum(-value * sin(t * i * (2 * pi() / 500))) as im from spec, generate_series(1, 4) as g(i) group by all)
select a.chan, b.chan as chan2, round(avg((a.re * b.re + a.im * b.im) / 500), 5) as cov from f a join f b on a.f = b.f group by all""")
def low_power_matrix(spark, sf_dir):
    m = noise.low_power_matrix(spectra_rows(spark, sf_dir), [], 500, 4)
    return m.select(F.col("chan").cast("long").alias("chan"), F.col("chan2").cast("long").alias("chan2"), r("cov", 5).alias("cov"))


@query()
def over_f_parameters(spark, sf_dir):
    rows = ts.time_grid(hourly(spark, sf_dir).withColumn("t_sec", F.col("t") * 3600.0), ["event_type"], 3600.0, 720)
    return noise.fit_over_f(spectra.series_power(rows, ["event_type"], 720, dt=3600.0), ["event_type"], 1e-5).select("event_type", r("index", 3).alias("index"))


@query(f"""with {HOURLY}, x as (select event_type, t, value, t - 757000 as u from hourly), f as (select event_type, regr_slope(value, u) as a, regr_intercept(value, u) as b from x group by event_type)
select event_type, t, round(value - (a * u + b), 5) as value from x join f using (event_type)""")
def polynomial_high_pass(spark, sf_dir):
    return noise.high_pass(hourly(spark, sf_dir), ["event_type"], "t", 1).select("event_type", "t", r("value", 5).alias("value"))


@query(f"with {TRIALS} select sim, cast(floor(ln(bin) / ln(2) + 1e-12) as integer) as bin, round(avg(power), 4) as power, count(*) as n from trials where bin > 0 group by all")
def log_bins(spark, sf_dir):
    return spectra.log_bins(trials(spark, sf_dir), ["sim"], "bin").select("sim", "bin", r("power", 4).alias("power"), "n")


@query(f"with {TRIALS} select sim, bin, round(power / 0.8, 4) as power, round(counts * 0.8 * 0.8, 4) as counts from trials")
def apply_transfer(spark, sf_dir):
    t = trials(spark, sf_dir)
    out = spectra.apply_transfer(t, t.select("bin").distinct().withColumn("transfer", F.lit(0.8)), ["bin"])
    return out.select("sim", "bin", r("power", 4).alias("power"), r("counts", 4).alias("counts"))


@query("select s_suppkey, round(s_acctbal * 7 / 6 * s_acctbal + 2.0 / 3 * s_acctbal * s_nationkey + 1.0 / 6 * s_nationkey * s_nationkey, 3) as variance from supplier")
def cross_signal_error(spark, sf_dir):
    v = spectra.cross_signal_error(F.col("s_acctbal"), F.col("s_nationkey"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", r(v, 3).alias("variance"))


@query(f"with {STREAM}, g as (select t, avg(value) as gain from stream group by t), ok as (select t from g group by t having bool_and(gain > 50 and gain < 120)) select s.t, s.pol, s.cal, s.chan, round(s.value, 6) as value from stream s join ok using (t)")
def good_gains(spark, sf_dir):
    rows = stream_rows(spark, sf_dir)
    gains = rows.groupBy("t").agg(F.avg("value").alias("gain"))
    return ts.good_gains(rows, gains, ["t"], 50.0, 120.0).select("t", "pol", "cal", "chan", r("value").alias("value"))


@query(f"with {STREAM}, c as (select * from stream where value < 150) select s.t, s.pol, s.cal, s.chan, case when c.value is not null then round(s.value, 6) end as value from stream s left join c using (t, pol, cal, chan)")
def reflag(spark, sf_dir):
    rows = stream_rows(spark, sf_dir)
    return ts.reflag(rows, rows.where("value < 150"), ["t", "pol", "cal", "chan"]).select("t", "pol", "cal", "chan", r("value").alias("value"))


@query(f"with {SAMPLES} select fi, ri, di, round(value, 4) as value, l_orderkey from samples where ri > 2 and ri < 6 and di > 3 and di < 7")
def trim_to_map(spark, sf_dir):
    return ts.trim(samples(spark, sf_dir), {"ri": (2, 6), "di": (3, 7)}).select("fi", "ri", "di", r("value", 4).alias("value"), "l_orderkey")


@query("select o_orderkey, round(greatest(o_totalprice / 1000, 20.0 * 20.0 / (1e3 * 0.01)), 6) as thermal from orders")
def radiometer_floor(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice") / 1000).alias("thermal"), F.lit(20.0).alias("tsys"))
    return noise.at_least_thermal(o, 1e3, 0.01).select("o_orderkey", r("thermal").alias("thermal"))


@query("select c_custkey, round(1 + 2 * (c_acctbal / 1000) + 3 * c_nationkey - c_nationkey, 5) as p0, round(c_acctbal / 1000 * 2, 5) as p1 from customer")
def mueller_correction(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 2).alias("chan"), F.array(F.lit(1.0), F.col("c_acctbal") / 1000, F.col("c_nationkey").cast("double"), F.lit(0.0)).alias("pols"))
    m = spark.createDataFrame([(k, [[1.0, 2.0, 2.0, 0.0], [0.0, 2.0, 0.0, 0.0], [0.0, 0.0, 1.0, 0.0], [0.0, 0.0, 0.0, 1.0]]) for k in (0, 1)], "chan long, m array<array<double>>")
    return lookup.mueller(c, m, ["c_custkey"]).select("c_custkey", r(F.col("pols")[0], 5).alias("p0"), r(F.col("pols")[1], 5).alias("p1"))


# Further queries register themselves here.
from . import array_queries, chain_queries, extra_queries, joint_queries, model_queries, survey_queries, telescope_queries  # noqa: E402, F401
