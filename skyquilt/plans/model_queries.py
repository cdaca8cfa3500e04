"""Queries of fits with many parameters, of mixing by windows and of simulated selection, each with its SQL."""

from __future__ import annotations

import math

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from skyquilt.functions.special import patterson
from skyquilt.operators import beams, maps, mixing, noise_fit, nonlinear, spectra
from skyquilt.sources import fits as files

from .catalog import HOURLY, hourly, query, r, table

# Receivers: exact data give back the parameters that they were made of, and SQL makes the data.

_TIED = math.tan(2 * math.radians(33))
_PLANTED = f"planted as (select cast(c as integer) as chan, 0.3 + 0.02 * c as g, 1.4 - 0.01 * c as al, 2.9 - 0.02 * c as ps, 0.2 as ph, 0.016 + 0.001 * c as ep, 0.05 + 0.004 * c as q0, (0.05 + 0.004 * c) * {_TIED!r} as u0, 0.1 + 0.01 * c as ch from generate_series(1, 7) as s(c))"
_SEEN = (
    _PLANTED
    + ", ang as (select l_linenumber as chan, l_extendedprice / 30000 as th, l_suppkey % 3 + 1 as st from lineitem), "
    + "turned as (select chan, st, p.*exclude(chan), q0 * cos(2 * th) + u0 * sin(2 * th) as q, u0 * cos(2 * th) - q0 * sin(2 * th) as u from ang join planted p using (chan)), "
    + "seen as (select chan, case st when 1 then 0.5 * g + cos(2 * al) * q + sin(2 * al) * cos(ch) * u "
    + "when 2 then 2 * ep * cos(ps + ph) - sin(2 * al) * cos(ps + ch) * q + (cos(al) ** 2 * cos(ps) - sin(al) ** 2 * cos(ps + 2 * ch)) * u "
    + "else 2 * ep * sin(ps + ph) - sin(2 * al) * sin(ps + ch) * q + (cos(al) ** 2 * sin(ps) - sin(al) ** 2 * sin(ps + 2 * ch)) * u end as value from turned)"
)


def planted() -> list[Column]:
    c = F.col("chan")
    q0 = 0.05 + 0.004 * c
    return [0.3 + 0.02 * c, 1.4 - 0.01 * c, 2.9 - 0.02 * c, F.lit(0.2), 0.016 + 0.001 * c, q0, q0 * _TIED, 0.1 + 0.01 * c]


def receivers(spark, sf_dir):
    """(chan, theta, stokes, value, noise): what a receiver with planted parameters sees at the angles of lineitem; discounts serve as noise."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").cast("int").alias("chan"), (F.col("l_extendedprice") / 30000).alias("theta"), (F.col("l_suppkey") % 3 + 1).cast("int").alias("stokes"), ((F.col("l_discount") - 0.05) / 50).alias("noise"))
    value = nonlinear.mueller_model(F.col("stokes"), F.col("theta"))([nonlinear.Dual.of(p) for p in planted()]).value
    return li.withColumn("value", value)


@query(f"with {_SEEN}, total as (select chan, round(sum(value), 4) as total, count(*) - 7 as dof from seen group by chan) select chan, round(g, 5) as gain_difference, round(al, 5) as alpha, round(ps, 5) as psi, round(ph, 5) as phi, round(ep, 5) as epsilon, round(q0, 5) as q_source, round(u0, 5) as u_source, round(ch, 5) as chi, total, dof from planted join total using (chan)")
def mueller_parameters(spark, sf_dir):
    seen = receivers(spark, sf_dir)
    out = nonlinear.fit_mueller(files.stager(spark, "mueller"), seen, ["chan"], [0.3, 1.3, 2.8, 0.15, 0.02, 0.05, 0.1, 0.05], math.radians(33))
    total = seen.groupBy("chan").agg(r(F.sum("value"), 4).alias("total"))
    names = [r(F.col("parameters")[k], 5).alias(n) for k, n in enumerate(nonlinear.MUELLER)]
    return out.join(total, "chan").select("chan", *names, "total", "dof")


@query("select cast(l_linenumber as integer) as chan, round(0.0, 5) as gradient, true as settled, count(*) - 7 as dof, true as error_bars from lineitem group by l_linenumber")
def mueller_noisy_fit(spark, sf_dir):
    """With discounts as noise: at the fit J'r vanishes, and parameters stand within six of their errors of what was planted."""
    seen = receivers(spark, sf_dir)
    out = nonlinear.fit_mueller(files.stager(spark, "noisy"), seen.withColumn("value", F.col("value") + F.col("noise")), ["chan"], [0.3, 1.3, 2.8, 0.15, 0.02, 0.05, 0.1, 0.05], math.radians(33))
    near = [F.abs(F.col("parameters")[k] - p) <= 6 * F.sqrt(F.col("covariance")[k * 9]) + 1e-9 for k, p in enumerate(planted())]
    ok = near[0]
    for x in near[1:]:
        ok = ok & x
    return out.select("chan", r("gradient", 5).alias("gradient"), "settled", "dof", ok.alias("error_bars"))


_BEAM_ROWS = "planted as (select cast(c as integer) as chan, 0.01 * c as x0, -0.02 * c as y0, 0.5 + 0.02 * c as width, 5.0 + c as ax, 6.0 + c as ay, 20.0 + c as tx, 22.0 as ty from generate_series(1, 7) as s(c)), seen as (select chan, case when l_suppkey % 2 = 0 then ax * g + tx else ay * g + ty end as value from (select *, exp(-4 * ln(2) * (power(l_discount * 10 - 0.5 - x0, 2) + power(l_tax * 10 - 0.4 - y0, 2)) / (width * width)) as g from lineitem join planted on chan = l_linenumber))"


@query(f"with {_BEAM_ROWS} select p.chan, " + ", ".join(f"round({a}, 5) as {b}" for a, b in zip(("x0", "y0", "width", "ax", "ay", "tx", "ty"), nonlinear.BEAM)) + ", t.total, t.dof from planted p join (select chan, round(sum(value), 3) as total, count(*) - 7 as dof from seen group by chan) t on t.chan = p.chan")
def two_polarisation_beam(spark, sf_dir):
    """Beams seen at the discounts and taxes of lineitem; both polarisations of a channel give centre and width back together."""
    c = F.col("chan")
    li = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").cast("int").alias("chan"), (F.col("l_discount") * 10 - 0.5).alias("x"), (F.col("l_tax") * 10 - 0.4).alias("y"), F.when(F.col("l_suppkey") % 2 == 0, "XX").otherwise("YY").alias("pol"))
    planted_beam = [0.01 * c, -0.02 * c, 0.5 + 0.02 * c, 5.0 + c, 6.0 + c, 20.0 + c, F.lit(22.0)]
    value = nonlinear.beam_model(F.col("x"), F.col("y"), F.col("pol") == "YY")([nonlinear.Dual.of(p) for p in planted_beam]).value
    seen = li.withColumn("value", value)
    out = nonlinear.fit_beam(files.stager(spark, "beam"), seen, ["chan"], [0.0, 0.0, 0.4, 10.0, 10.0, 10.0, 10.0])
    total = seen.groupBy("chan").agg(r(F.sum("value"), 3).alias("total"))
    return out.join(total, "chan").select("chan", *[r(F.col("parameters")[k], 5).alias(n) for k, n in enumerate(nonlinear.BEAM)], "total", "dof")


# Mixing of bins by the weights of map sections.

SHAPE, PERP, PAR = (12, 11, 11), [0.0, 2.1, 4.1, 6.1, 8.1], [0.0, 2.5, 4.5, 6.5]
SPACING = tuple(2 * math.pi / n for n in SHAPE)
_FLAGS = "sec as (select l_returnflag as tag, month(l_shipdate) - 1 as fi, cast(floor(l_quantity / 5) as integer) as ri, cast(round(l_discount * 100) as integer) as di, sum(l_tax + 0.01) as weight from lineitem group by all)"
_TURN = "sum(re * cos({a}) + im * sin({a})) as re, sum(im * cos({a}) - re * sin({a})) as im"
_MIXING = (
    _FLAGS
    + ", d1 as (select tag, fi, ri, kd, "
    + _TURN.format(a="2 * pi() * kd * di / 11")
    + " from (select *, weight as re, 0.0::double as im from sec), generate_series(0, 10) as g(kd) group by all), d2 as (select tag, fi, kr, kd, "
    + _TURN.format(a="2 * pi() * kr * ri / 11")
    + " from d1, generate_series(0, 10) as g(kr) group by all), d3 as (select tag, kf, kr, kd, "
    + _TURN.format(a="2 * pi() * kf * fi / 12")
    + " from d2, generate_series(0, 11) as g(kf) group by all), "
    + "s as (select a.tag as a, b.tag as b, sum(a.weight * b.weight) as s from sec a join sec b using (fi, ri, di) where a.tag < b.tag group by all), "
    + "kern as (select a, b, x.kf, x.kr, x.kd, (x.re * y.re + x.im * y.im) / (s * 1452) as w from s join d3 x on x.tag = a join d3 y on y.tag = b and y.kf = x.kf and y.kr = x.kr and y.kd = x.kd), "
    + "cells as (select kf, kr, kd, sqrt(least(kr, 11 - kr) ** 2 + least(kd, 11 - kd) ** 2) as kp, least(kf, 12 - kf) as kz from generate_series(0, 11) as f(kf), generate_series(0, 10) as h(kr), generate_series(0, 10) as i(kd)), "
    + "binned as (select *, cast((case when kp < 2.1 then 0 when kp < 4.1 then 1 when kp < 6.1 then 2 else 3 end) * 3 + (case when kz < 2.5 then 0 when kz < 4.5 then 1 else 2 end) as integer) as bin from cells), "
    + "moved as (select a, b, p.bin as row, q.bin as col, p.kf, p.kr, p.kd, sum(w) as w from binned p join binned q on true join kern k on k.kf = (p.kf - q.kf + 12) % 12 and k.kr = (p.kr - q.kr + 11) % 11 and k.kd = (p.kd - q.kd + 11) % 11 group by all), "
    + "mix as (select a || '_' || b as pair, row, col, avg(w) as value from moved group by all)"
)


def flag_pairs(spark, sf_dir):
    """Weights of both sections of each pair of return flags."""
    li = table(spark, sf_dir, "lineitem")
    sec = li.select(F.col("l_returnflag").alias("tag"), (F.month("l_shipdate") - 1).cast("int").alias("fi"), F.floor(F.col("l_quantity") / 5).cast("int").alias("ri"), F.rint(F.col("l_discount") * 100).cast("int").alias("di"), (F.col("l_tax") + 0.01).alias("w"))
    sec = sec.groupBy("tag", "fi", "ri", "di").agg(F.sum("w").alias("weight"))
    tags = sec.select("tag").distinct()
    pairs = tags.withColumnRenamed("tag", "a").join(tags.withColumnRenamed("tag", "b"), F.col("a") < F.col("b")).withColumn("pair", F.concat_ws("_", "a", "b"))
    side = lambda c: sec.join(F.broadcast(pairs.select("pair", F.col(c).alias("tag"))), "tag").drop("tag")
    return side("a"), side("b")


@query(f"with {_MIXING} select pair, row, col, round(value, 7) as value from mix")
def window_mixing(spark, sf_dir):
    left, right = flag_pairs(spark, sf_dir)
    kernels = files.stager(spark, "kernels")(mixing.window_kernels(left, right, ["pair"], SHAPE))
    m = mixing.mixing_matrix(kernels, ["pair"], SHAPE, SPACING, PERP, PAR)
    return m.select("pair", "row", "col", r("value", 7).alias("value"))


@query("with t as (select distinct l_returnflag as tag from lineitem) select a.tag || '_' || b.tag as pair, cast(k as integer) as row, 1.0::double as total, 1.0::double as own from t a join t b on a.tag < b.tag, generate_series(0, 11) as g(k)")
def mixing_of_all_bins(spark, sf_dir):
    """Rows sum to one; through a window that moves nothing a bin stays as it is."""
    left, right = flag_pairs(spark, sf_dir)
    kernels = files.stager(spark, "kernels")(mixing.window_kernels(left, right, ["pair"], SHAPE))
    args = ["pair"], SHAPE, SPACING, PERP, PAR
    total = mixing.mixing_matrix(kernels, *args).groupBy("pair", "row").agg(r(F.sum("value"), 9).alias("total"))
    same = mixing.mixing_matrix(mixing.identity_kernel(kernels, SHAPE), *args).where("row = col").select("pair", "row", r("value", 9).alias("own"))
    return total.join(same, ["pair", "row"])


@query(f"with {_MIXING}, p as (select cast(p_size % 12 as integer) as bin, avg(p_retailprice) / 700 as power from part group by all), first as (select min(pair) as pair from mix) select row as bin, round(sum(value * p.power), 6) as mixed, round(min(o.power), 6) as power from mix join first using (pair) join p on p.bin = col join p o on o.bin = row group by row")
def unmixed_power(spark, sf_dir):
    """Powers of the bins mixed by the first pair's weights, and what unmixing makes of that: the powers."""
    stage = files.stager(spark, "unmix")
    left, right = flag_pairs(spark, sf_dir)
    kernels = stage(mixing.window_kernels(left, right, ["pair"], SHAPE))
    first = kernels.agg(F.min("pair").alias("pair"))
    m = stage(mixing.mixing_matrix(kernels.join(first, "pair"), ["pair"], SHAPE, SPACING, PERP, PAR).drop("pair"))
    power = table(spark, sf_dir, "part").groupBy((F.col("p_size") % 12).cast("int").alias("bin")).agg((F.avg("p_retailprice") / 700).alias("power"))
    mixed = stage(m.join(power, F.col("col") == F.col("bin")).groupBy(F.col("row").alias("bin")).agg(F.sum(F.col("value") * F.col("power")).alias("power")))
    back = mixing.unmix(mixed, mixing.pseudo_inverse(stage, m, 12, side=4), [])
    return mixed.withColumnRenamed("power", "mixed").join(back, "bin").select("bin", r("mixed").alias("mixed"), r("power").alias("power"))


# Selection by simulation until it has settled.

_SIGMA = 0.05


@query(f"""with o as (select c_nationkey % 5 as ri, (c_acctbal + 1000) / 11000 as z from customer),
nodes as (select cast(b as integer) as bin, b / 10.0 + i * 0.0025 as x, (case when i in (0, 40) then 1 when i % 2 = 1 then 4 else 2 end) * 0.0025 / 3 as w from generate_series(0, 9) as g(b), generate_series(0, 40) as h(i))
select cast(ri as integer) as ri, bin, round(sum(w * exp(-power((x - z) / {_SIGMA}, 2) / 2)) / ({_SIGMA} * sqrt(2 * pi())), 3) as expected, true as near, true as halves_agree from o, nodes group by ri, bin""")
def selection_until_settled(spark, sf_dir):
    """Mean counts of customers whose redshifts are scattered, drawn until the halves of the draws agree to 5% in every well filled cell; near the exact integral of the scatter."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("object_id"), (F.col("c_nationkey") % 5).cast("int").alias("ri"), F.lit(0).alias("di"), ((F.col("c_acctbal") + 1000) / 11000).alias("z"))
    sigma = F.lit(_SIGMA)
    found, _ = maps.settled_selection(files.stager(spark, "selection"), c, (0.0, 1.0, 10), sigma, 7, bound=0.05, per_round=20)
    bins = F.explode(F.sequence(F.lit(0), F.lit(9))).alias("bin")
    share, _ = patterson(lambda x: F.exp(-(((x - F.col("z")) / sigma) ** 2) / 2) / (sigma * math.sqrt(2 * math.pi)), F.col("bin") / 10, (F.col("bin") + 1) / 10)
    exact = c.select("ri", "z", bins).groupBy("ri", "bin").agg(F.sum(share).alias("expected"))
    out = exact.join(found, ["ri", "bin"], "left").fillna(0, ["nbar", "draws"])
    near = F.abs(F.coalesce("nbar", F.lit(0.0)) - F.col("expected")) <= 6 * F.sqrt(F.col("expected") / 20) + 1e-3
    agree = F.coalesce(F.abs(F.col("a") - F.col("b")) <= 0.05 * (F.col("a") + F.col("b")), F.lit(True)) | (F.col("nbar") < 5)
    return out.select("ri", F.col("bin").cast("int").alias("bin"), r("expected", 3).alias("expected"), near.alias("near"), agree.alias("halves_agree"))


# Spectra of masked series, and fits through the mask's window.

_SLOTS = HOURLY + ", s as (select event_type, t - min(t) over (partition by event_type) as slot, value / 100 as value from hourly)"


def slots(spark, sf_dir):
    h = hourly(spark, sf_dir)
    slot = (F.col("t") - F.min("t").over(Window.partitionBy("event_type"))).cast("int")
    return h.select("event_type", slot.alias("slot"), (F.col("value") / 100).alias("value"), F.lit(1.0).alias("mask"))


@query(f"""with {_SLOTS}, p as (select event_type, cast(i as integer) as i, sum(value * cos(2 * pi() * i * slot / 720)) as re, sum(value * sin(2 * pi() * i * slot / 720)) as im, sum(cos(2 * pi() * i * slot / 720)) as wr, sum(sin(2 * pi() * i * slot / 720)) as wi from s, generate_series(0, 719) as g(i) where slot < 720 group by all)
select event_type, i, round((re * re + im * im) / 360, 5) as power, round((wr * wr + wi * wi) / (720 * 720), 7) as window from p""")
def masked_window_power(spark, sf_dir):
    p = noise_fit.window_power(slots(spark, sf_dir).where("slot < 720"), ["event_type"], 720, 1.0)
    return p.select("event_type", "i", r("power", 5).alias("power"), r("window", 7).alias("window"))


@query("select distinct event_type, round(0.02 + length(event_type) / 100.0, 6) as amplitude, round(-0.8 - length(event_type) / 20.0, 4) as index, round(0.5::double, 4) as thermal from events")
def windowed_over_f_fit(spark, sf_dir):
    """Planted 1/f spectra seen through the windows of the hours that have events, by sums over lags, give the parameters back."""
    stage = files.stager(spark, "over-f")
    w = stage(noise_fit.window_power(slots(spark, sf_dir).where("slot < 720"), ["event_type"], 720, 1.0))
    size = F.length("event_type")
    f = F.greatest(F.abs(F.col("freq")), F.lit(1 / 720))
    planted = (0.02 + size / 100) * F.pow(f / 0.01, -0.8 - size / 20) + 0.5
    seen = spectra.lag_product(w.select("event_type", "i", planted.alias("power")), w.select("event_type", "i", F.col("window").alias("power")), ["event_type"], 720)
    both = w.select("event_type", "i", "window").join(seen.select("event_type", "i", (F.col("power") * 720).alias("power")), ["event_type", "i"])
    out = noise_fit.fit_windows(both, ["event_type"], 1.0, 0.01)
    return out.select("event_type", r("amplitude").alias("amplitude"), r("index", 4).alias("index"), r("thermal", 4).alias("thermal"))


# Polarised beams: coefficients are discounts by supplier and part, a channel's width and centre come from its flag.

_ORDERS = 3
_BEAMS = (
    "lens as (select l_returnflag as chan, 1.0 + case l_returnflag when 'A' then 0.0 when 'N' then 0.25 else 0.5 end as width from lineitem), "
    "ch as (select distinct chan, width, (width - 1) / 10 as cx, -0.05 as cy from lens), "
    "co as (select l_returnflag as chan, cast(l_linenumber % 4 as integer) as pol, cast(l_suppkey % 3 as integer) as i, cast(l_partkey % 3 as integer) as j, avg(l_discount) * 10 as value from lineitem group by all), "
    "g as (select k, (k + 0.5 - 4) / 8 * 4 as x from generate_series(0, 7) as g(k)), "
    "ax as (select chan, k, n, case n when 0 then 1 when 1 then 2 * u / sqrt(2) else (4 * u * u - 2) / sqrt(8) end * exp(-u * u / 2) as b from (select chan, k, (x - cx) / (width / (2 * sqrt(2 * ln(2)))) as u from ch, g), (select unnest([0, 1, 2]) as n)), "
    "ay as (select chan, k, n, case n when 0 then 1 when 1 then 2 * u / sqrt(2) else (4 * u * u - 2) / sqrt(8) end * exp(-u * u / 2) as b from (select chan, k, (x - cy) / (width / (2 * sqrt(2 * ln(2)))) as u from ch, g), (select unnest([0, 1, 2]) as n))"
)


def beam_tables(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    width = 1.0 + F.when(F.col("chan") == "A", 0.0).when(F.col("chan") == "N", 0.25).otherwise(0.5)
    channels = li.select(F.col("l_returnflag").alias("chan")).distinct().withColumn("width", width).withColumn("cx", (F.col("width") - 1) / 10).withColumn("cy", F.lit(-0.05))
    by = [F.col("l_returnflag").alias("chan"), (F.col("l_linenumber") % 4).cast("int").alias("pol"), (F.col("l_suppkey") % 3).cast("int").alias("i"), (F.col("l_partkey") % 3).cast("int").alias("j")]
    return li.groupBy(*by).agg((F.avg("l_discount") * 10).alias("value")), channels


@query(f"with {_BEAMS} select chan, pol, cast(x.k as integer) as xi, cast(y.k as integer) as yi, round(sum(value * x.b * y.b), 6) as value from co join ax x using (chan) join ay y using (chan) where x.n = i and y.n = j and i + j < 3 group by all")
def polarised_beam(spark, sf_dir):
    c, channels = beam_tables(spark, sf_dir)
    return beams.polarised_beam(c, channels, 8, 4.0, _ORDERS).withColumn("value", r("value"))


@query(f"with {_BEAMS} select chan, pol, i, j, round(value, 5) as value from co")
def polarised_beam_fit(spark, sf_dir):
    """All orders' beams on the grid are fitted, which gives the coefficients back."""
    c, channels = beam_tables(spark, sf_dir)
    grid = beams.polarised_beam(c, channels, 8, 4.0, _ORDERS, triangle=False)
    at = lambda k: (F.col(k) + 0.5 - 4) / 8 * 4.0
    rows = grid.select("chan", "pol", at("xi").alias("x"), at("yi").alias("y"), "value")
    return beams.fit_polarised_beam(rows, channels, _ORDERS, triangle=False).withColumn("value", r("value", 5))


# Statistics over realisations in two dimensions, and combinations side by side.

_POWER_2D = "t as (select l_suppkey % 20 as sim, cast(floor(l_quantity / 5) as integer) as bx, cast(round(l_discount * 100) as integer) as by_, avg(l_extendedprice) / 1000 as power from lineitem group by all)"


@query(f"with {_POWER_2D} select bx, by_ as by, round(avg(power), 5) as mean, round(stddev_samp(power), 5) as std, count(power) as n from t group by all")
def power_statistics_2d(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    t = li.groupBy((F.col("l_suppkey") % 20).alias("sim"), F.floor(F.col("l_quantity") / 5).cast("int").alias("bx"), F.rint(F.col("l_discount") * 100).cast("int").alias("by")).agg((F.avg("l_extendedprice") / 1000).alias("power"))
    return spectra.statistics(t, ["bx", "by"]).select("bx", "by", r("mean", 5).alias("mean"), r("std", 5).alias("std"), "n")


@query("select cast(floor(l_quantity / 5) as integer) as bx, cast(round(l_discount * 100) as integer) as by, " + ", ".join(f"round(avg(l_extendedprice) filter (where l_returnflag = '{f}') / 1000, 5) as {f.lower()}_power" for f in "ANR") + " from lineitem group by 1, 2")
def power_by_combination(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    p = li.groupBy(F.floor(F.col("l_quantity") / 5).cast("int").alias("bx"), F.rint(F.col("l_discount") * 100).cast("int").alias("by"), F.col("l_returnflag").alias("combination")).agg((F.avg("l_extendedprice") / 1000).alias("power"))
    out = spectra.pivot_combinations(p, ["bx", "by"], ["A", "N", "R"])
    return out.select("bx", "by", *[r(f, 5).alias(f"{f.lower()}_power") for f in "ANR"])
