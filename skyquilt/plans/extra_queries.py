"""Further queries with SQL: fits of exact data, projections, degraded maps, incremental runs, totals over simulations."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from skyquilt.functions import cosmology as cosmo
from skyquilt.operators import fits, lookup, maps, modes, noise, noise_model
from skyquilt.operators import timestream as ts
from skyquilt.sources import fits as files

from . import drivers as D
from . import steps
from .catalog import GRID, HOURLY, SAMPLES, SPEC, grid, hourly, query, r, samples, spectra_rows, table
from .survey_queries import NODES, _integral

# Exact data give back the parameters they were made of.


@query("select n_nationkey as chan, round(2.0 + n_regionkey, 3) as amplitude, round(0.1 * n_regionkey, 3) as x0, round(-0.2, 3) as y0, round(0.8, 3) as sigma, round(1.0, 3) as offset_ from nation")
def gaussian_beam_fit(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("chan"), (2.0 + F.col("n_regionkey")).alias("a"), (0.1 * F.col("n_regionkey")).alias("cx"))
    at = spark.range(121).select(((F.col("id") % 11 - 5) * 0.4).alias("x"), ((F.floor(F.col("id") / 11) - 5) * 0.4).alias("y"))
    value = 1.0 + F.col("a") * F.exp(-((F.col("x") - F.col("cx")) ** 2 + (F.col("y") + 0.2) ** 2) / (2 * 0.64))
    rows = n.crossJoin(F.broadcast(at)).select("chan", "x", "y", value.alias("value"))
    out = fits.gaussian_beam(rows, ["chan"])
    return out.select("chan", *[r(c, 3).alias(c) for c in ("amplitude", "x0", "y0", "sigma")], r("offset", 3).alias("offset_"))


@query("select n_nationkey as k, round(-1.0 - n_regionkey / 10.0, 3) as index, round(0.5, 3) as thermal from nation")
def over_f_fit(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), (-1.0 - F.col("n_regionkey") / 10.0).alias("index"))
    f = spark.range(1, 200).select((F.col("id") / 200.0).alias("freq"))
    power = n.crossJoin(F.broadcast(f)).select("k", "freq", (2.0 * F.pow(F.col("freq") / 0.1, F.col("index")) + 0.5).alias("power"))
    return noise.fit_over_f(power, ["k"], 0.1).select("k", r("index", 3).alias("index"), r("thermal", 3).alias("thermal"))


@query("select l_returnflag as k, round(sum(t * d / v) / sum(t * t / v), 6) as amplitude, round(1 / sqrt(sum(t * t / v)), 8) as error, round(sum(d * d / v) - sum(t * d / v) * sum(t * d / v) / sum(t * t / v), 2) as chi2, count(*) - 1 as dof from (select l_returnflag, l_quantity as t, l_extendedprice / 1000 as d, l_tax + 0.5 as v from lineitem) group by 1")
def template_amplitude(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("k"), F.col("l_quantity").alias("theory"), (F.col("l_extendedprice") / 1000).alias("value"), (F.col("l_tax") + 0.5).alias("variance"))
    out = fits.diagonal_amplitude(li, ["k"])
    return out.select("k", r("amplitude").alias("amplitude"), r("error", 8).alias("error"), r("chi2", 2).alias("chi2"), "dof")


# Projections, clips and tops.


@query(f"with {SPEC}, m as (select c as chan, 1 / sqrt(64) as v0, case when c % 2 = 0 then 1 else -1 end / sqrt(64) as v1 from generate_series(0, 63) as g(c)), a as (select t, sum(value * v0) as a0, sum(value * v1) as a1 from spec join m using (chan) group by t) select t, chan, round(value - a0 * v0 - a1 * v1, 6) as value from spec join m using (chan) join a using (t)")
def projected_out(spark, sf_dir):
    c = F.col("id").cast("int")
    m = spark.range(64).select(F.lit(0).alias("mode"), c.alias("chan"), F.lit(1 / 8).alias("v")).unionByName(spark.range(64).select(F.lit(1).alias("mode"), c.alias("chan"), F.when(F.col("id") % 2 == 0, 1 / 8).otherwise(-1 / 8).alias("v")))
    out = modes.project_out(spectra_rows(spark, sf_dir), m, ["t"])
    return out.select("t", F.col("chan").cast("long").alias("chan"), r("value").alias("value"))


@query(f"with {SPEC}, a as (select scan, t, chan, case when abs(value - avg(value) over w) <= 2 * stddev_pop(value) over w then value end as value from spec window w as (partition by scan, chan)), b as (select scan, t, chan, case when abs(value - avg(value) over w) <= 2 * stddev_pop(value) over w then value end as value from a window w as (partition by scan, chan)) select scan, t, chan, round(value, 6) as value from b")
def clipped_rms(spark, sf_dir):
    out = ts.clip_rms(spectra_rows(spark, sf_dir), ["scan", "chan"], 2.0, 2)
    return out.select("scan", "t", F.col("chan").cast("long").alias("chan"), r("value").alias("value"))


@query("with v as (select p_size as mode, round(sum(p_retailprice), 2) as value from part group by 1) select mode, value, cast(row_number() over (order by value desc, mode) as integer) as rank from v order by value desc, mode limit 5")
def top_modes(spark, sf_dir):
    v = table(spark, sf_dir, "part").groupBy(F.col("p_size").alias("mode")).agg(r(F.sum("p_retailprice"), 2).alias("value"))
    return modes.top_modes(v, 5)


@query(f"with {HOURLY}, f as (select event_type, min(t) as t0 from hourly group by 1), s as (select event_type, t - t0 as slot, value from hourly join f using (event_type)), g as (select event_type, i as slot from f, generate_series(0, 719) as g(i)) select event_type, cast(slot as integer) as slot, round(coalesce(value, 0), 6) as value, case when value is null then 0.0 else 1.0 end as mask from g left join s using (event_type, slot)")
def masked_time_grid(spark, sf_dir):
    out = ts.time_grid(hourly(spark, sf_dir).withColumn("t_sec", F.col("t") * 3600.0), ["event_type"], 3600.0, 720)
    return out.select("event_type", "slot", r("value").alias("value"), "mask")


@query("with c as (select p_size as value, sum(count(*)) over (order by p_size) * 1.0 / sum(count(*)) over () as cum from part group by p_size), s as (select coalesce(lag(cum) over (order by cum), 0) as c0, cum as c1, coalesce(lag(value) over (order by cum), value) as v0, value as v1 from c), d as (select c_custkey, c_nationkey / 25.0 + 0.003 as u from customer) select c_custkey, round(v0 + (v1 - v0) * (u - c0) / (c1 - c0), 6) as drawn from d join s on u >= c0 and u < c1")
def redrawn_by_cdf(spark, sf_dir):
    from pyspark.sql import Window

    n = table(spark, sf_dir, "part").groupBy("p_size").agg(F.count("*").alias("n"))
    run = Window.partitionBy("k").orderBy("p_size").rowsBetween(Window.unboundedPreceding, 0)
    cdf = n.withColumn("k", F.lit(1)).withColumn("cum", F.sum("n").over(run) / F.sum("n").over(Window.partitionBy("k"))).select("k", "cum", F.col("p_size").alias("value"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.lit(1).alias("k"), "c_nationkey")
    return lookup.redraw_by_cdf(rows, cdf, "k", F.col("c_nationkey") / 25.0 + 0.003).select("c_custkey", r("drawn").alias("drawn"))


# Maps.

_SIGMAS = {fi: (0.2 if fi % 2 else 0.25) for fi in range(1, 13)}
_WIDEST = 1.1 * max(_SIGMAS.values())
_KERNELS = [(s, i, j, w) for s in (0.2, 0.25) for i, j, w in maps.gaussian_kernel(math.sqrt(_WIDEST**2 - s * s), 0.25)]


@query(f"with {GRID}, k as (select * from (values " + ", ".join(f"({s}, {i}, {j}, {w!r}::double)" for s, i, j, w in _KERNELS) + ") as t(s, i, j, w)), g as (select *, case when fi % 2 = 1 then 0.2 else 0.25 end as s from grid) select a.fi, a.ri, a.di, round(sum(b.value * w), 3) as value from g a join k on k.s = a.s join g b on b.fi = a.fi and b.ri = a.ri - i and b.di = a.di - j group by all")
def degraded_map(spark, sf_dir):
    out = maps.degrade(grid(spark, sf_dir), _SIGMAS, 0.25)
    return out.select("fi", "ri", "di", r("value", 3).alias("value"))


@query(f"with {NODES}, p as (select distinct p_size / 20.0 as z from part) select z, round(299792.458 / 70.2 * {_integral('1 / sqrt(0.0001 * power(1 + @, 4) + 0.274 * power(1 + @, 3) + (1 - 0.274 - 0.7259 - 0.0001) * power(1 + @, 2) + 0.7259)')}, 4) as comoving, round(977.7922216807892 / 70.2 * {_integral('1 / ((1 + @) * sqrt(0.0001 * power(1 + @, 4) + 0.274 * power(1 + @, 3) + (1 - 0.274 - 0.7259 - 0.0001) * power(1 + @, 2) + 0.7259))')}, 5) as lookback from p")
def distances_with_radiation(spark, sf_dir):
    z, c = F.col("z"), cosmo.Cosmology(70.2, 0.274, 0.7259, 0.0001)
    p = table(spark, sf_dir, "part").select((F.col("p_size") / 20.0).alias("z")).distinct()
    return p.select("z", r(c.comoving_distance(z), 4).alias("comoving"), r(c.lookback_time(z), 5).alias("lookback"))


# Runs.


@query("select o_orderpriority, count(*) as n from orders group by 1")
def incremental_run(spark, sf_dir):
    """Two runs over files of keys: the second works on what the first left."""
    path = files.shared_folder(spark, "done")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    steps.run_new(o.where("o_orderpriority < '3'"), path, "o_orderkey", lambda df: df)
    done = steps.run_new(o, path, "o_orderkey", lambda df: df)
    return done.groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query(f"with {SPEC}, f as (select scan, t, chan, case when chan * 0.5 + 0.25 <= 20 and chan * 0.5 - 0.25 >= 10 then null else value end as value from spec), m as (select scan, chan, avg(value) as m from f group by all) select f.scan, f.t, f.chan // 4 as chan, round(avg(value - m), 6) as value from f join m using (scan, chan) group by f.scan, f.t, f.chan // 4")
def chained_steps(spark, sf_dir):
    chain = steps.Chain(
        [
            steps.Step("band stop", lambda df, low, high: ts.mask_frequency_range(df, low, high, width=0.5), {"low": 0.0, "high": 0.0}, "bs_"),
            steps.Step("mean", lambda df: ts.subtract_mean(df, ["scan", "chan"])),
            steps.Step("rebin", lambda df, n: ts.rebin_frequency(df, ["scan", "t"], n), {"n": 2}, "rb_"),
        ]
    )
    rows = spectra_rows(spark, sf_dir).withColumn("freq", F.col("chan") * 0.5)
    out, _ = chain.run(rows, {"bs_low": 10.0, "bs_high": 20.0, "rb_n": 4})
    return out.select("scan", "t", F.col("chan").cast("long").alias("chan"), r("value").alias("value"))


_SIMS = SAMPLES + ", sec as (select l_suppkey % 3 as sim_id, 'S' || (l_linenumber % 2 + 1) as tag, fi, ri, di, sum(value / 10000 * weight) / sum(weight) as value, sum(weight) as weight from samples group by all), win as (select cast(i as integer) + 1 as fi, 0.42 - 0.5 * cos(2 * pi() * i / 11) + 0.08 * cos(4 * pi() * i / 11) as b from generate_series(0, 11) as g(i)), cube as (select sim_id, tag, fi, ri, di, value, weight * b as w from sec join win using (fi))"


def _simulations(spark, sf_dir):
    s = samples(spark, sf_dir).withColumn("tag", F.concat(F.lit("S"), (F.col("l_linenumber") % 2 + 1).cast("string"))).withColumn("sim_id", F.col("l_suppkey") % 3).withColumn("value", F.col("value") / 10000)
    return maps.weighted_stack(s, ["sim_id", "tag", *maps.PIXEL]).withColumn("fi", F.col("fi") - 1)


def _simulated(spark, sf_dir, pairs):
    c = _simulations(spark, sf_dir)
    p = D.power_batch(c, pairs(c), "tag", ["sim_id"], (12, 11, 11), (1.0, 1.0, 1.0))
    return p.groupBy("pair", "sim_id").agg(r(F.sum("power"), 4).alias("total"))


def _sim_sql(left: str, right: str) -> str:
    return f"with {_SIMS}, n as (select x.sim_id, sum(x.w * y.w) as n, sum(x.value * x.w * y.value * y.w) as s from cube x join cube y on y.sim_id = x.sim_id and y.fi = x.fi and y.ri = x.ri and y.di = x.di where x.tag = '{left}' and y.tag = '{right}' group by x.sim_id) select '{left}_x_{right}' as pair, sim_id, round(1452 * s / n, 4) as total from n"


@query(_sim_sql("S1", "S2"))
def simulated_auto_power_totals(spark, sf_dir):
    return _simulated(spark, sf_dir, lambda c: D.auto_pairs(c, "tag"))


@query(_sim_sql("S2", "S1"))
def simulated_cross_power_totals(spark, sf_dir):
    return _simulated(spark, sf_dir, lambda c: D.cross_pairs(c, "tag", "S2"))


@query(f"with {SPEC}, s as (select scan, chan, t, value, 0.5 as var from spec), d as (select chan, t % 9 as p, sum(value / var) as dirty, sum(1 / var) + 1e-4 as noise_inv from s group by all) select chan, p, round(dirty, 5) as dirty, round(noise_inv, 6) as noise_inv from d")
def thermal_noise_map(spark, sf_dir):
    """The joint noise model without any mode is plain weighting."""
    s = spectra_rows(spark, sf_dir)
    s = s.select("scan", "chan", F.col("t").cast("long").alias("t"), (F.col("t") % 9).cast("long").alias("p"), "value", F.lit(0.5).alias("var"))
    out = noise_model.make_map(noise_model.weight_stream(s, [], noise_model.NoiseModel(time_modes=0), 64), [])
    return out.select(F.col("chan").cast("long").alias("chan"), "p", r("dirty", 5).alias("dirty"), r("noise_inv").alias("noise_inv"))


@query(f"with {GRID} select round(avg(value), 4) as value, count(*) as n, fi from grid group by fi")
def empty_and_full_pixels(spark, sf_dir):
    """A map template filled by a left join keeps pixels without samples as masked."""
    g = grid(spark, sf_dir)
    cells = D.empty_map(spark, 13, (700.0, -2.0), (218.0, 2.0), (11, 11), (0.25, 0.25)).select("fi", "ri", "di")
    full = cells.join(g.select("fi", "ri", "di", "value"), ["fi", "ri", "di"], "left")
    return full.groupBy("fi").agg(r(F.avg("value"), 4).alias("value"), F.count("value").alias("n")).where("n > 0")
