"""Queries of whole chains, of files written and read again, and of solves whose answer is known, each with its SQL where it has one."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyquilt.functions import columns as C
from skyquilt.operators import algebra, factor, maps, noise_model
from skyquilt.sources import fits as files

from . import drivers as D
from .catalog import GRID, HOURLY, SAMPLES, SPEC, grid, hourly, query, r, samples, spectra_rows, table

# Pairs of map sections: all lines, dealt to three sections by their number.

SECTIONS = SAMPLES + ", sec as (select 'S' || (l_linenumber % 3 + 1) as tag, fi, ri, di, sum(value / 10000 * weight) / sum(weight) as value, sum(weight) as weight from samples group by all)"


def sections(spark, sf_dir):
    s = samples(spark, sf_dir).withColumn("tag", F.concat(F.lit("S"), (F.col("l_linenumber") % 3 + 1).cast("string"))).withColumn("value", F.col("value") / 10000)
    return maps.weighted_stack(s, ["tag", *maps.PIXEL])


_MEMBERS = (
    SECTIONS
    + ", sides as (select a.tag || '_with_' || b.tag as pair, unnest([1, 2]) as side, unnest([a.tag, b.tag]) as tag from (select distinct tag from sec) a join (select distinct tag from sec) b on a.tag < b.tag), "
    "x as (select pair, side, fi, ri, di, value, weight from sec join sides using (tag)), nf as (select pair, side, fi, avg(1 / weight) as nf from x group by all), np as (select pair, side, ri, di, avg(1 / weight / nf) as np from x join nf using (pair, side, fi) group by all), "
    "fw as (select pair, side, fi, ri, di, value, 1 / (nf * np) as weight from x join nf using (pair, side, fi) join np using (pair, side, ri, di)), "
    "members as (select pair, side, fi, ri, di, value - sum(weight * value) over w / sum(weight) over w as value, weight from fw window w as (partition by pair, side, fi))"
)


@query(f"with {SECTIONS} select a.tag || '_with_' || b.tag as pair, unnest([1, 2]) as side, unnest([a.tag, b.tag]) as tag from (select distinct tag from sec) a join (select distinct tag from sec) b on a.tag < b.tag")
def pair_sides(spark, sf_dir):
    return D.pair_sides(sections(spark, sf_dir), "tag")


@query(f"with {_MEMBERS} select pair, side, fi, ri, di, round(value, 6) as value, round(weight, 8) as weight from members")
def prepared_pairs(spark, sf_dir):
    m = D.prepare_pairs(sections(spark, sf_dir), "tag")
    return m.select("pair", "side", "fi", "ri", "di", r("value").alias("value"), r("weight", 8).alias("weight"))


@query(f"with {_MEMBERS} select a.pair, a.fi as f1, b.fi as f2, round(sum(a.weight * a.value * b.weight * b.value) / sum(a.weight * b.weight), 6) as cov from members a join members b on a.pair = b.pair and a.side = 1 and b.side = 2 and a.ri = b.ri and a.di = b.di group by all")
def pair_covariance(spark, sf_dir):
    return D.pair_covariance(D.prepare_pairs(sections(spark, sf_dir), "tag")).withColumn("cov", r("cov"))


@query(f"with {_MEMBERS} select pair, 0.0::double as none, count(*) as cells from members where side = 1 group by pair")
def cleaned_pairs_keep_cells(spark, sf_dir):
    """Cleaned maps for 0 and 2 modes: with none, cells are those of the members; the mean of what all modes leave is nothing."""
    out = D.clean_map_pairs(sections(spark, sf_dir), "tag", 0, 2)
    m = D.prepare_pairs(sections(spark, sf_dir), "tag")
    none = out.where("n_modes = 0 and side = 1").join(m.where("side = 1").select("pair", *maps.PIXEL, F.col("value").alias("v")), ["pair", *maps.PIXEL])
    return none.groupBy("pair").agg(r(F.max(F.abs(F.col("value") - F.col("v"))), 9).alias("none"), F.count("*").alias("cells"))


@query(f"with {_MEMBERS}, n as (select pair, side, ri, di, count(*) = (select count(distinct fi) from members) as whole from members group by all) select pair, side, whole, count(*) as cells, round(sum(value * value) filter (whole), 5) as power, case when whole then 0.0::double end as along_modes from members join n using (pair, side, ri, di) group by all")
def cleaned_pairs_power(spark, sf_dir):
    """In pixels with all frequencies what three modes take out and what they leave add up to the members' power, and nothing is left along a removed mode."""
    m = D.prepare_pairs(sections(spark, sf_dir), "tag")
    found = D.pair_modes(D.pair_covariance(m), 3).select("pair", "side", "mode", "fi", "v")
    left = D.clean_map_pairs(sections(spark, sf_dir), "tag", 3, 3)
    pixel, half = ["pair", "side", "ri", "di"], ["pair", "side", "whole"]
    number = m.agg(F.count_distinct("fi").alias("all"))
    whole = m.groupBy(*pixel).agg(F.count("*").alias("c")).crossJoin(F.broadcast(number)).select(*pixel, (F.col("c") == F.col("all")).alias("whole"))
    along = lambda cells: cells.join(found, ["pair", "side", "fi"]).groupBy(*pixel, "mode").agg(F.sum(F.col("value") * F.col("v")).alias("a")).join(whole, pixel)
    taken = along(m).groupBy(*half).agg(F.sum(F.col("a") ** 2).alias("taken"))
    rest = along(left).groupBy(*half).agg(r(F.max(F.abs("a")), 7).alias("along_modes"))
    own = left.join(whole, pixel).groupBy(*half).agg(F.count("*").alias("cells"), F.sum(F.col("value") ** 2).alias("left"))
    out = own.join(taken, half).join(rest, half)
    return out.select(*half, "cells", F.when(F.col("whole"), r(F.col("left") + F.col("taken"), 5)).alias("power"), F.when(F.col("whole"), F.col("along_modes")).alias("along_modes"))


@query(f"with {_MEMBERS}, c as (select a.pair, a.fi as f1, b.fi as f2, sum(a.weight * a.value * b.weight * b.value) / sum(a.weight * b.weight) as cov from members a join members b on a.pair = b.pair and a.side = 1 and b.side = 2 and a.ri = b.ri and a.di = b.di group by all) select pair, round(sum(cov * cov), 6) as power, 0.0::double as residual, 0.0::double as skew from c group by pair")
def pair_mode_equations(spark, sf_dir):
    """Left and right modes of every pair's covariance: C v = s u for all of them, squares of s add up to those of C, and modes of a side are orthonormal."""
    c = D.pair_covariance(D.prepare_pairs(sections(spark, sf_dir), "tag"))
    found = D.pair_modes(c, 64)
    left = found.where("side = 1").select("pair", "mode", "value", F.col("fi").alias("f1"), F.col("v").alias("u"))
    right = found.where("side = 2").select("pair", "mode", F.col("fi").alias("f2"), "v")
    cv = c.join(right, ["pair", "f2"]).groupBy("pair", "mode", "f1").agg(F.sum(F.col("cov") * F.col("v")).alias("cv"))
    residual = cv.join(left, ["pair", "mode", "f1"]).groupBy("pair").agg(r(F.max(F.abs(F.col("cv") - F.col("value") * F.col("u"))), 9).alias("residual"))
    power = left.select("pair", "mode", "value").distinct().groupBy("pair").agg(r(F.sum(F.col("value") ** 2)).alias("power"))
    other = found.select("pair", "side", "fi", F.col("mode").alias("other"), F.col("v").alias("w"))
    product = found.join(other, ["pair", "side", "fi"]).groupBy("pair", "side", "mode", "other").agg(F.sum(F.col("v") * F.col("w")).alias("p"))
    skew = product.groupBy("pair").agg(r(F.max(F.abs(F.col("p") - F.when(F.col("mode") == F.col("other"), 1.0).otherwise(0.0))), 9).alias("skew"))
    return power.join(residual, "pair").join(skew, "pair")


@query()
def cleaned_map_pairs(spark, sf_dir):
    return D.combine_cleaned(D.clean_map_pairs(sections(spark, sf_dir), "tag", 1, 3))


_CUBES = SECTIONS + ", win as (select cast(i as integer) + 1 as fi, 0.42 - 0.5 * cos(2 * pi() * i / 11) + 0.08 * cos(4 * pi() * i / 11) as b from generate_series(0, 11) as g(i)), cube as (select tag, treatment, fi, ri, di, value / treatment as value, weight * b as w from sec join win using (fi), (select unnest([1, 2]) as treatment))"


# Parseval: the power of all cells adds up to the number of cells times the sum of products, over the norm.


def _totals_of(spark, sf_dir, pairs):
    c = sections(spark, sf_dir).withColumn("fi", F.col("fi") - 1).withColumn("treatment", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("value", F.col("value") / F.col("treatment"))
    p = D.power_batch(c, pairs(c), "tag", ["treatment"], (12, 11, 11), (1.0, 1.0, 1.0))
    return p.groupBy("pair", "treatment").agg(r(F.sum("power"), 4).alias("total"))


_NORM = "n as (select p.pair, x.treatment, sum(x.w * y.w) as n, sum(x.value * x.w * y.value * y.w) as s from pairs p join cube x on x.tag = p.l join cube y on y.tag = p.r and y.treatment = x.treatment and y.fi = x.fi and y.ri = x.ri and y.di = x.di group by all) select pair, treatment, round(1452 * s / n, 4) as total from n"


@query(f"with {_CUBES}, pairs as (select a.tag || '_x_' || b.tag as pair, a.tag as l, b.tag as r from (select distinct tag from sec) a join (select distinct tag from sec) b on a.tag < b.tag), {_NORM}")
def auto_power_totals(spark, sf_dir):
    return _totals_of(spark, sf_dir, lambda c: D.auto_pairs(c, "tag"))


@query(f"with {_CUBES}, pairs as (select distinct tag || '_x_' || tag as pair, tag as l, tag as r from sec), {_NORM}")
def noise_power_totals(spark, sf_dir):
    return _totals_of(spark, sf_dir, lambda c: D.noise_pairs(c, "tag"))


@query(f"with {_CUBES}, pairs as (select 'S1_x_' || tag as pair, 'S1' as l, tag as r from (select distinct tag from sec) where tag <> 'S1'), {_NORM}")
def cross_power_totals(spark, sf_dir):
    return _totals_of(spark, sf_dir, lambda c: D.cross_pairs(c, "tag", "S1"))


@query(f"with {SPEC}, f as (select scan, chan, i as f, sum(value * cos(t * i * (2 * pi() / 500))) as re, sum(-value * sin(t * i * (2 * pi() / 500))) as im from spec, generate_series(1, 3) as g(i) group by all), m as (select scan, a.chan, b.chan as chan2, avg((a.re * b.re + a.im * b.im) / 500) as cov from f a join f b using (scan, f) group by all) select chan, chan2, round(avg(cov), 6) as cov from m group by all")
def power_matrices_by_scan(spark, sf_dir):
    m = D.power_matrices(spectra_rows(spark, sf_dir), [], 500, 3, "scan")
    return m.select(F.col("chan").cast("long").alias("chan"), F.col("chan2").cast("long").alias("chan2"), r("cov").alias("cov"))


@query("select l_returnflag as k, array_to_string(list(cast(g as varchar) order by l_linenumber), ',') as gains from (select l_returnflag, l_linenumber, count(*) as g from lineitem group by all) group by 1")
def solved_gains(spark, sf_dir):
    g = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("k"), F.col("l_linenumber").alias("scan")).agg(F.count("*").alias("gain"))
    return D.solved_gains(g, ["k"]).select("k", F.array_join("gains", ",").alias("gains"))


@query(f"with {HOURLY}, f as (select event_type, regr_slope(value, t) as a, regr_intercept(value, t) as b from hourly group by 1), d as (select event_type, t, value - (a * t + b) as value from hourly join f using (event_type)), v as (select event_type, var_pop(value) as v from d group by 1), c as (select median(v) * 4 as cut from v) select event_type, t, round(value, 5) as value, round(case when v <= cut then v else 1e4 end, 4) as var from d join v using (event_type), c")
def preprocessed_streams(spark, sf_dir):
    h = hourly(spark, sf_dir).select(F.col("event_type").alias("chan"), "t", "value", F.lit(1).alias("scan"))
    out = D.preprocess(h, [])
    return out.select(F.col("chan").alias("event_type"), "t", r("value", 5).alias("value"), r("var", 4).alias("var"))


@query("select cast(a as integer) as f1, cast(b as integer) as f2, cast(i as integer) as dr, cast(j as integer) as dd, round(exp(-sqrt(i * i + j * j) * 0.25) / (1 + abs(a - b)) * exp(-(i * i + j * j) * 0.0625 / (2 * (0.09 + 0.16))), 8) as value from (select distinct l_linenumber - 1 as a from lineitem) x, (select distinct l_linenumber - 1 as b from lineitem) y, generate_series(-3, 3) as z(i), generate_series(-3, 3) as w(j)")
def pixel_covariance(spark, sf_dir):
    n = table(spark, sf_dir, "lineitem").agg(F.max("l_linenumber")).first()[0]
    return D.pixel_covariance(spark, n, 3, 0.25, lambda d, f: F.exp(-d) / (1 + f), (0.3, 0.4)).withColumn("value", r("value", 8))


_SIG = GRID + ", sig as (select s as sim_id, fi, ri, di, value / 10000 + s as value from grid, (select unnest([0, 1]) as s)), kern as (select i, j, case when i = 0 and j = 0 then 0.5 else 0.125 end as w from (values (0,0),(1,0),(-1,0),(0,1),(0,-1)) as t(i, j)), beam as (select g.sim_id, g.fi, g.ri, g.di, sum(h.value * w) as value from sig g, kern join sig h on h.sim_id = g.sim_id and h.fi = g.fi and h.ri = g.ri - i and h.di = g.di - j group by all)"


@query(f"with {_SIG} select sim_id, 'raw' as product, fi, ri, di, round(value, 6) as value from sig union all select sim_id, 'delta', fi, ri, di, round(value - avg(value) over (partition by sim_id, fi), 6) from sig union all select sim_id, 'optical', fi, ri, di, 0.0 from sig union all select sim_id, 'beam', fi, ri, di, round(value, 6) from beam union all select sim_id, 'beam_meansub', fi, ri, di, round(b.value - sum(weight * b.value) over w / sum(weight) over w, 6) from beam b join grid using (fi, ri, di) window w as (partition by sim_id, fi)")
def signal_products(spark, sf_dir):
    g = grid(spark, sf_dir)
    sig = g.select(F.explode(F.array(F.lit(0), F.lit(1))).alias("sim_id"), "fi", "ri", "di", "value").withColumn("value", F.col("value") / 10000 + F.col("sim_id"))
    kernel = [(0, 0, 0.5), (1, 0, 0.125), (-1, 0, 0.125), (0, 1, 0.125), (0, -1, 0.125)]
    return D.signal_products(sig, kernel, g, F.lit(0.0), 3).withColumn("value", r("value"))


@query(f"with {GRID} select s as sim_id, fi, ri, di, round(value * 0.3, 4) as signal, true as whole from grid, (select unnest([0, 1, 2]) as s)")
def simulated_maps(spark, sf_dir):
    out = D.simulated_maps(grid(spark, sf_dir), 3, F.lit(25.0), 1e6, F.lit(100.0), 0.3, 7)
    whole = F.abs(F.col("value") - F.col("signal") - F.col("thermal")) < 1e-6
    return out.select("sim_id", "fi", "ri", "di", r("signal", 4).alias("signal"), whole.alias("whole"))


# Catalogs of files.


@query("select 'run:' || r_name || ';' || k as db_key, 'maps/' || r_name || '_' || k || '.npy' as path, r_name as region, k as kind from region, (select unnest(['map', 'weight']) as k)")
def file_family(spark, sf_dir):
    names = table(spark, sf_dir, "region").select("r_name")
    return D.file_family(spark, "run:{region};{kind}", "maps/{region}_{kind}.npy", {"region": names, "kind": ["map", "weight"]})


@query("select 'gbt_cleaned:' || s || ';' || k || ';' || m || 'modes' as db_key, 'me/gbt/' || k || '_' || s || '_' || m || 'modes.npy' as path from (select unnest(['map', 'weight', 'noise_inv']) as k), (select distinct l_returnflag as s from lineitem), (select distinct l_linenumber * 5 as m from lineitem)")
def mode_family(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return D.mode_family(spark, "gbt", "me", li.select(F.col("l_linenumber") * 5), li.select("l_returnflag")).select("db_key", "path")


_FILES = "files as (select 'part:' || p_partkey as db_key, 'm/' || p_brand || '_' || p_size || '.fits' as path from part)"


def part_files(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.concat(F.lit("part:"), "p_partkey").alias("db_key"), F.concat(F.lit("m/"), "p_brand", F.lit("_"), "p_size", F.lit(".fits")).alias("path"))


@query(f"with {_FILES} select db_key, path from files where db_key = 'part:7'")
def fetch_one(spark, sf_dir):
    return D.fetch(part_files(spark, sf_dir), "part", "7")


@query(f"with {_FILES} select db_key, path from files where db_key like 'part:1%'")
def fetch_many(spark, sf_dir):
    return D.fetch(part_files(spark, sf_dir), "part:1")


@query(f"with {_FILES} select distinct 'part:' || l_partkey as db_key, regexp_replace(path, '([^/]+)$', 'new/\\1') as path from lineitem left join files on db_key = 'part:' || l_partkey")
def keys_with_files(spark, sf_dir):
    keys = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("part:"), "l_partkey").alias("db_key")).distinct()
    return D.with_files(keys, part_files(spark, sf_dir), "new")


_MANIFEST = "manifest as (select p_size as session, p_brand as field_name, split_part(p_type, ' ', 1) as kind, 's_' || p_partkey || '-' || (p_partkey + 8) || '.fits' as path, p_partkey as lo, p_partkey + 8 as hi from part)"


def manifest(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_size").alias("session"), F.col("p_brand").alias("field_name"), F.split("p_type", " ")[0].alias("kind"), F.concat(F.lit("s_"), "p_partkey", F.lit("-"), F.col("p_partkey") + 8, F.lit(".fits")).alias("path"))


@query(f"with {_MANIFEST} select session, path, cast(lo as integer) as first_scan, cast(hi as integer) as last_scan from manifest where session in (1, 2, 3, 5, 8, 13, 21) and kind = 'STANDARD' and field_name in (select distinct p_brand from part where p_brand < 'Brand#3')")
def session_files(spark, sf_dir):
    aliases = table(spark, sf_dir, "part").select(F.lit("15hr").alias("field"), F.col("p_brand").alias("alias")).where("alias < 'Brand#3'")
    return D.session_files(manifest(spark, sf_dir), aliases, [1, 2, 3, 5, 8, 13, 21], "15hr", "STANDARD")


@query(f"with {_MANIFEST} select session, path, kind from manifest where lower(field_name) like 'brand#1%'")
def calibrator_files(spark, sf_dir):
    return D.calibrator_files(manifest(spark, sf_dir), "BRAND#1")


@query("select s_nationkey as session, s_suppkey as scan from supplier where (s_nationkey, s_suppkey) not in (select c_nationkey, c_custkey from customer)")
def unwanted_scans(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("session"), F.col("s_suppkey").alias("scan"))
    return D.unwanted_scans(s, table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("session"), F.col("c_custkey").alias("scan")))


@query("select o_orderkey, round(o_totalprice / 2, 4) as half from orders")
def declared_fields(spark, sf_dir):
    o = D.set_field(table(spark, sf_dir, "orders"), "half", F.round(F.col("o_totalprice") / 2, 4), ["o_orderkey"], "double")
    return D.checked(o.select("o_orderkey", "half"), {"o_orderkey": "bigint", "half": "double"}, ["half"], ["o_orderkey"])


@query("select event_id, '000: ' || event_type as entry from events")
def histories_from_text(spark, sf_dir):
    text = F.to_json(F.array(F.struct(F.concat(F.lit("000: "), "event_type").alias("entry"), F.array().cast("array<string>").alias("details"))))
    h = D.read_history(table(spark, sf_dir, "events").select("event_id", text.alias("history")), "history")
    return h.select("event_id", F.col("history")[0]["entry"].alias("entry"))


@query("select l_returnflag, l_linestatus, sum(l_quantity) as total from lineitem group by all")
def kept_table(spark, sf_dir):
    folder = files.shared_folder(spark, "kept")
    build = lambda: table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("total"))
    D.kept_table(spark, folder, "totals", {"by": "flag"}, build)
    return D.kept_table(spark, folder, "totals", {"by": "flag"}, lambda: build().where("false"))


@query("select p_partkey, n, round(p_retailprice / n, 6) as share from part, (select unnest([2, 5, 10]) as n)")
def over_parameters(spark, sf_dir):
    cases = spark.createDataFrame([(2,), (5,), (10,)], "n int")
    out = D.timed("shares", D.over_parameters)(table(spark, sf_dir, "part"), cases, lambda df: df.withColumn("share", r(F.col("p_retailprice") / F.col("n"))))
    return out.select("p_partkey", "n", "share")


@query("with m as (select l_linenumber as pair, l_returnflag as side, cast(month(l_shipdate) as integer) as fi, avg(l_discount) - 0.05 as v from lineitem group by all), s as (select pair, side, sign(arg_max(v, abs(v))) as s from m group by all) select fi, round(avg(v * s), 9) as v from m join s using (pair, side) group by fi")
def average_modes(spark, sf_dir):
    m = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("pair"), F.col("l_returnflag").alias("side"), F.month("l_shipdate").alias("fi")).agg((F.avg("l_discount") - 0.05).alias("v"))
    return D.average_modes(m, []).withColumn("v", r("v", 9))


_CORR = "c as (select l_suppkey % 10 as sim_id, l_linenumber as bin, avg(l_extendedprice) / 10000 as corr from lineitem group by all)"


def correlations(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 10).alias("sim_id"), F.col("l_linenumber").alias("bin")).agg((F.avg("l_extendedprice") / 10000).alias("corr"))


@query(f"with {_CORR} select bin, round(avg(corr), 6) as mean, round(stddev_samp(corr), 6) as std, count(corr) as n from c group by bin")
def correlation_statistics(spark, sf_dir):
    return D.correlation_statistics(correlations(spark, sf_dir), ["bin"]).select("bin", r("mean").alias("mean"), r("std").alias("std"), "n")


@query(f"with {_CORR} select bin, round(avg((corr * 0.9 - 0.1) / corr), 6) as transfer from c group by bin")
def average_loss(spark, sf_dir):
    c = correlations(spark, sf_dir)
    return D.average_loss(c.withColumn("corr", F.col("corr") * 0.9 - 0.1), c, ["bin"]).withColumn("transfer", r("transfer"))


@query(f"with {GRID} select ri, di, round(value, 4) as value from grid where fi = 6")
def plotted_slice(spark, sf_dir):
    return D.plot_slice(grid(spark, sf_dir), "fi", 6, "ri", "di").withColumn("value", r("value", 4))


@query(f"with {GRID}, shape as (select max(fi) as nf, max(ri) + 1 as nr, max(di) + 1 as nd from grid) select cast(f as integer) as fi, round(700.0 - 2 * f, 6) as freq, cast(i as integer) as ri, cast(j as integer) as di, round((j - nd // 2) * 0.5 + 2.0, 8) as dec, cast(null as double) as value from shape, generate_series(0, 20) as g(f), generate_series(0, 20) as h(i), generate_series(0, 20) as k(j) where f < nf and i < nr and j < nd")
def empty_map(spark, sf_dir):
    """A template as large as the samples ask for."""
    nf, nr, nd = grid(spark, sf_dir).agg(F.max("fi"), F.max("ri") + 1, F.max("di") + 1).first()
    m = D.empty_map(spark, nf, (700.0, -2.0), (218.0, 2.0), (nr, nd), (0.25, 0.5))
    return m.select("fi", r("freq").alias("freq"), "ri", "di", r("dec", 8).alias("dec"), "value")


@query("with x as (select p_partkey, i, ascii(substr(p_brand, cast(i + 1 as integer), 1)) as b from part, generate_series(0, 7) as g(i) where i < length(p_brand)) select cast(p_partkey as integer) as record, cast((i // 2) % 2 as integer) as pol, cast(i % 2 as integer) as chan, round(avg(b * ((i // 2) % 2 * 2 + i % 2 + 1) + 0.5), 6) as value from x group by all")
def ingested_samples(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.lit(1).alias("scan"), F.col("p_partkey").cast("int").alias("record"), F.encode("p_brand", "UTF-8").alias("data"), F.array(*[F.lit(float(k)) for k in (1, 2, 3, 4)]).alias("scale"), F.array(*[F.lit(0.5)] * 4).alias("offset"))
    return D.ingest_samples(p, 2, 2).select("record", "pol", "chan", r("value").alias("value"))


_LST = "fmod(fmod(280.46061837 + ((epoch_us(ts) / 1000000.0 - 946684800) - 43200) / 86400 * 360.98564736629 - 79.83983, 360) + 360, 360)"


@query(f"select event_id, round(degrees(asin(sin(d) * sin(p) + cos(d) * cos(p) * cos(h))), 4) as el from (select event_id, radians({_LST} - 83.6) as h, radians(22.0) as d, radians(38.43312) as p from events)")
def source_track(spark, sf_dir):
    return D.source_track(table(spark, sf_dir, "events"), "event_id", "ts", 83.6, 22.0).select("event_id", r("el", 4).alias("el"))


@query("select event_id, round(epoch_us(ts) / 1000000.0 / 86400 + 2440587.5, 5) as jd from events")
def julian_dates(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", r(C.julian_date(F.col("ts")), 5).alias("jd"))


# Files written and read again.


@query("select cast(vec_id as integer) as record_id, cast(label as integer) as scan, case when label < 5 then 'T' else 'F' end as cal, c as chan, round(cast(embedding[c + 1] as double), 6) as value from embeddings, generate_series(0, 63) as g(c) where label in (2, 7)")
def sdfits_round_trip(spark, sf_dir):
    """Spectra written as FITS tables; only two scans are read back."""
    files.register(spark)
    path = files.shared_folder(spark, "sdfits")
    e = table(spark, sf_dir, "embeddings")
    data = F.transform("embedding", lambda x: x.cast("double"))
    rows = e.select(F.col("vec_id").cast("int").alias("TIME"), F.col("label").cast("int").alias("SCAN"), F.when(F.col("label") < 5, "T").otherwise("F").alias("CAL"), data.alias("DATA"), F.array(F.lit("000: written")).alias("history"))
    rows.write.format("sdfits").mode("overwrite").option("path", path).save()
    back = spark.read.format("sdfits").schema("TIME int, SCAN int, CAL string, DATA array<double>").load(path).where("SCAN in (2, 7)")
    long = back.select(F.col("TIME").alias("record_id"), F.col("SCAN").alias("scan"), F.col("CAL").alias("cal"), F.posexplode("DATA").alias("chan", "value"))
    return long.select("record_id", "scan", "cal", F.col("chan").cast("long").alias("chan"), r("value").alias("value"))


_CELLS = GRID + ", shape as (select max(ri) as mr, max(di) as md from grid)"


@query(f"with {_CELLS}, a as (select g.fi, cast(i as integer) as ri, cast(j as integer) as di from (select distinct fi from grid) g, shape, generate_series(0, 12) as x(i), generate_series(0, 12) as y(j) where i <= (select max(ri) from grid h where h.fi = g.fi) and j <= (select max(di) from grid h where h.fi = g.fi)) select a.fi, a.ri, a.di, round(g.value, 6) as value from a left join grid g using (fi, ri, di)")
def fits_image_round_trip(spark, sf_dir):
    """One image for each frequency; cells without a value come back as null."""
    files.register(spark)
    path = files.shared_folder(spark, "images")
    files.write_images(grid(spark, sf_dir).withColumn("name", F.format_string("f%02d", "fi")), path, "name", ["ri", "di"]).write.format("noop").mode("overwrite").save()
    back = spark.read.format("fitsimage").load(path)
    return back.select(F.regexp_extract("file", r"f(\d+)\.fits", 1).cast("int").alias("fi"), F.col("at")[0].alias("ri"), F.col("at")[1].alias("di"), r("value").alias("value"))


@query(f"with {GRID} select fi, ri, di, round(218.0 - 0.25 * (ri - (select max(ri) + 1 from grid) // 2), 6) as ra, round(value, 6) as value from grid")
def npy_round_trip(spark, sf_dir):
    files.register(spark)
    path = files.shared_folder(spark, "cubes")
    cells = grid(spark, sf_dir).withColumn("name", F.lit("cube"))
    files.write_npy(cells, path, "name", {"fi": "freq", "ri": "ra", "di": "dec"}, {"ra_centre": 218.0, "ra_delta": -0.25}).write.format("noop").mode("overwrite").save()
    back = spark.read.format("npycube").load(path).where("value is not null")
    return back.select("fi", "ri", "di", r("ra").alias("ra"), r("value").alias("value"))


@query("select round(c_acctbal, 2) as ra, round(cast(c_custkey as double), 2) as dec, round(c_nationkey / 10.0, 2) as z from customer")
def text_catalog_round_trip(spark, sf_dir):
    path = files.shared_folder(spark, "text")
    c = table(spark, sf_dir, "customer").select("c_acctbal", "c_custkey", (F.col("c_nationkey") / 10).alias("z"), F.lit(20.0).alias("m"), F.lit(1).alias("j"))
    files.write_text(c, path, ["c_acctbal", "c_custkey", "z", "m", "j"])
    return files.read_catalog(spark, path).select(r("ra", 2).alias("ra"), r("dec", 2).alias("dec"), r("z", 2).alias("z"))


@query("select p_brand || '/' || p_size as tree_path, round(sum(p_retailprice), 2) as total from part where p_brand like 'Brand#1%' group by all")
def tree_round_trip(spark, sf_dir):
    path = files.shared_folder(spark, "tree")
    p = table(spark, sf_dir, "part")
    listed = files.array_list(p.withColumn("tree_path", F.concat("p_brand", F.lit("/"), "p_size")), ["tree_path"], "p_partkey", "p_retailprice")
    files.write_tree(listed, path)
    back = files.read_tree(spark, path).where("tree_path like 'Brand#1%'")
    return back.select("tree_path", r(F.aggregate("values", F.lit(0.0), lambda a, x: a + x), 2).alias("total"))


@query("select n_name as entry, count(*) as n from nation group by all")
def history_round_trip(spark, sf_dir):
    """Histories written into the headers of tables; every entry comes back once, in whichever files it stands."""
    files.register(spark)
    path = files.shared_folder(spark, "history")
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("SCAN"), F.array(F.col("n_name")).alias("history"))
    n.write.format("sdfits").mode("overwrite").option("path", path).save()
    back = spark.read.format("sdfits").schema("file string, SCAN int, history array<string>").load(path)
    heads = back.groupBy("file").agg(F.first("history").alias("history"))
    return heads.select(F.explode("history").alias("entry")).groupBy("entry").agg(F.count("*").alias("n"))


# Solves whose answer is known: a matrix with 4 on the diagonal and -1 beside it, times a known vector.


def band_matrix(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("row"), (F.col("n_regionkey") + 1.0).alias("x"))
    near = n.select("row", F.explode(F.array(*[F.struct((F.col("row") + k).alias("col"), F.lit(v).alias("value")) for k, v in ((-1, -1.0), (0, 4.0), (1, -1.0))])).alias("s")).select("row", "s.*").where("col >= 0 and col < 25")
    b = near.join(n.select(F.col("row").alias("col"), "x"), "col").groupBy("row").agg(F.sum(F.col("value") * F.col("x")).alias("b"))
    return near, b


@query("select n_nationkey as p, n_regionkey + 1.0 as x from nation")
def tile_cholesky_solve(spark, sf_dir):
    a, b = band_matrix(spark, sf_dir)
    stage = files.stager(spark, "cholesky")
    tiles = stage(factor.tiles(a, 5))
    lower = stage(factor.cholesky(tiles, 5, stage))
    parts = stage(b.groupBy(F.floor(F.col("row") / 5).cast("int").alias("i")).agg(F.transform(F.array_sort(F.collect_list(F.struct("row", "b"))), lambda v: v["b"]).alias("part")))
    x = factor.cholesky_solve(lower, parts, 5, stage)
    return x.select("i", F.posexplode("part").alias("k", "x")).select((F.col("i") * 5 + F.col("k")).cast("long").alias("p"), r("x", 8).alias("x"))


@query("with d as (select n_nationkey as p, 2.0 + n_regionkey as d from nation) select p, round(1 / d - 1 / (d * d) / (1 + (select sum(1 / d) from d)), 8) as noise from d")
def tile_inverse_diagonal(spark, sf_dir):
    """A diagonal plus a matrix of ones, whose inverse is known."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("row"), (F.col("n_regionkey") + 2.0).alias("d"))
    a = n.crossJoin(F.broadcast(n.select(F.col("row").alias("col")))).select("row", "col", F.when(F.col("row") == F.col("col"), F.col("d")).otherwise(0.0).alias("v")).withColumn("value", F.col("v") + 1)
    stage = files.stager(spark, "inverse")
    lower = stage(factor.cholesky(stage(factor.tiles(a, 5)), 5, stage))
    out = factor.inverse_diagonal(lower, 5, 5, stage)
    return out.select("i", F.posexplode("part").alias("k", "noise")).select((F.col("i") * 5 + F.col("k")).cast("long").alias("p"), r("noise", 8).alias("noise"))


@query("select 1 as k, cast(n_nationkey as integer) as p, n_regionkey + 1.0 as value from nation")
def eigen_solve(spark, sf_dir):
    a, b = band_matrix(spark, sf_dir)
    modes = factor.eigen_blocks(a.withColumn("k", F.lit(1)), ["k"])
    out = factor.solve_from_eigen(modes, b.select(F.lit(1).alias("k"), F.col("row").alias("p"), F.col("b").alias("dirty")), ["k"])
    return out.select("k", "p", r("value", 8).alias("value"))


@query("select 1 as k, n_nationkey as p, n_regionkey + 1.0 as value from nation")
def dense_channel_solve(spark, sf_dir):
    a, b = band_matrix(spark, sf_dir)
    dirty = b.select(F.lit(1).alias("k"), F.col("row").alias("p"), F.col("b").alias("dirty"))
    inverse = a.select(F.lit(1).alias("k"), F.col("row").alias("p"), F.col("col").alias("q"), "value")
    return D.clean_map(dirty, inverse, ["k"]).select("k", "p", r("value", 6).alias("value"))


@query("select l_returnflag as k, round((1 + abs(c)) / (1 - abs(c)), 5) as condition from (select l_returnflag, corr(l_quantity, l_extendedprice) as c from lineitem group by 1)")
def condition_numbers(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("k")).agg(F.var_pop("l_quantity").alias("a"), F.var_pop("l_extendedprice").alias("d"), F.covar_pop("l_quantity", "l_extendedprice").alias("b"))
    m = li.select("k", F.explode(F.array(*[F.struct(F.lit(i).alias("row"), F.lit(j).alias("col"), F.col(c).alias("value")) for i, j, c in ((0, 0, "a"), (0, 1, "b"), (1, 0, "b"), (1, 1, "d"))])).alias("s")).select("k", "s.*")
    return factor.condition_numbers(m, ["k"]).withColumn("condition", r("condition", 5))


@query()
def joint_noise_weights(spark, sf_dir):
    """Streams over thermal noise, mean and slope of each channel, and a shared 1/f mode."""
    s = spectra_rows(spark, sf_dir).withColumnRenamed("scan", "label").withColumn("scan", F.floor(F.col("t") / 25).cast("int"))
    s = s.select("scan", "chan", F.col("t").cast("long").alias("t"), (F.col("t") % 9).cast("long").alias("p"), "value", F.lit(0.5).alias("var"))
    model = noise_model.NoiseModel(dt=1.0, time_modes=2, frequency_modes=[([1 / (1 + c) for c in range(64)], (0.3, -1.0, 0.1))])
    return noise_model.make_map(noise_model.weight_stream(s, [], model, 64), [])


@query(f"with {GRID}, e as (select 0.047 as lo) select cast(floor(ln(weight / lo) / ln(2) + 1e-9) as integer) as bin, count(*) as n from grid, e where weight >= lo and weight < lo * 64 group by all")
def logarithmic_edges(spark, sf_dir):
    edges = C.log_edges(0.047, 0.047 * 64, 6)
    g = grid(spark, sf_dir).withColumn("bin", C.edge_bucket(F.col("weight"), edges)).dropna(subset=["bin"])
    return g.groupBy("bin").agg(F.count("*").alias("n"))


@query("with p as (select distinct p_size as v from part where p_size > 0), b as (select min(v) filter (where v > (select min(v) from p)) as lo, max(v) as hi from p) select cast(k as integer) as k, round(lo * power(hi / lo, k / 8.0), 6) as edge from b, generate_series(0, 8) as g(k)")
def suggested_edges(spark, sf_dir):
    p = table(spark, sf_dir, "part").where("p_size > 0").select(F.col("p_size").cast("double").alias("v"))
    return algebra.edge_table(p, "v", 8).withColumn("edge", r("edge"))
