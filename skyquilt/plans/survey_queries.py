"""Queries of cosmology, sky coordinates, lineage, calibration, maps and power spectra, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyquilt.functions import columns as C
from skyquilt.functions import cosmology as cosmo
from skyquilt.operators import angular, fits, lineage, lookup, maps, modes, noise, spectra
from skyquilt.operators import timestream as ts
from skyquilt.sources import fits as files

from .catalog import GRID, HOURLY, ORACLE, SAMPLES, SPEC, STREAM, TRIALS, grid, hourly, query, r, samples, spectra_rows, stream_rows, table, trials

# Cosmology: integrals in SQL are sums over the same nodes.

NODES = "nodes as (select -1 + i / 200.0 as x, (case when i in (0, 400) then 1 when i % 2 = 1 then 4 else 2 end) / 600.0 as w from generate_series(0, 400) as g(i))"  # Simpson's rule


def _e(z: str, m: float, d: float) -> str:
    return f"sqrt({m} * power(1 + {z}, 3) + {1 - m - d} * power(1 + {z}, 2) + {d})"


def _integral(f: str, z: str = "z") -> str:
    """Integral of f(u) from 0 to z."""
    return f"({z} / 2 * (select sum(w * ({f.replace('@', f'({z} / 2 + {z} / 2 * x)')})) from nodes))"


def _growth(z: str, m: float) -> str:
    x = f"(({1 / m - 1}) / power(1 + {z}, 3))"
    num, den = ("(" + " + ".join(f"{c} * power({x}, {k})" for k, c in enumerate(p)) + ")" for p in ((1.0, 1.175, 0.3064, 0.005355), (1.0, 1.857, 1.021, 0.153)))
    return f"sqrt(1 + {x}) / (1 + {z}) * {num} / {den}"


_C = 299792.458
_FLAT = (70.2, 0.274, 0.726)
_D = f"{_C / _FLAT[0]} * " + _integral("1 / " + _e("@", *_FLAT[1:]))

ORACLE["cosmic_distances"] = (
    f"with {NODES}, p as (select p_partkey, p_size / 20.0 as z from part) select p_partkey, round({_D}, 5) as comoving, round({_D} / (1 + z), 5) as angular, round({_D} * (1 + z), 5) as luminosity, "
    f"round({977.7922216807892 / _FLAT[0]} * {_integral('1 / ((1 + @) * ' + _e('@', *_FLAT[1:]) + ')')}, 5) as lookback, round({_growth('z', _FLAT[1])}, 5) as growth, "
    "round(0.39 * power((0.274 + 0.726 * power(1 + z, -3)) / 0.29, -0.5) * power((1 + z) / 2.5, 0.5), 5) as brightness, round(1420.40575177 / (1 + z), 5) as mhz from p"
)

_OPEN = (70.0, 0.3, 0.6)
_DO = f"({_C / _OPEN[0]} * " + _integral("1 / " + _e("@", *_OPEN[1:])) + ")"
_SCALE = _C / _OPEN[0] / (1 - _OPEN[1] - _OPEN[2]) ** 0.5


@query(
    f"with {NODES}, p as (select distinct p_size / 20.0 as z from part), d as (select z, {_SCALE} * (exp({_DO} / {_SCALE}) - exp(-{_DO} / {_SCALE})) / 2 as dm, {_C} / (70.0 * {_e('z', 0.3, 0.6)}) as dh, {_integral('1 / ((1 + @) * ' + _e('@', *_OPEN[1:]) + ')')} as t from p) "
    f"select z, round(dh, 4) as hubble_distance, round(dm, 4) as transverse, round(dh * dm * dm / 1e6, 4) as element, round(2 * pi() * power({_C / 70.0}, 3) / {1 - 0.3 - 0.6} * (dm / {_C / 70.0} * sqrt(1 + {1 - 0.3 - 0.6} * power(dm / {_C / 70.0}, 2)) - asinh(sqrt({1 - 0.3 - 0.6}) * dm / {_C / 70.0}) / sqrt({1 - 0.3 - 0.6})) / 1e9, 4) as volume, round({_C / 70.0} * t, 4) as light from d"
)
def open_universe_distances(spark, sf_dir):
    c, z = cosmo.Cosmology(*_OPEN), F.col("z")
    p = table(spark, sf_dir, "part").select((F.col("p_size") / 20.0).alias("z")).distinct()
    named = {"hubble_distance": c.hubble_distance(z), "transverse": c.transverse_distance(z), "element": c.volume_element(z) / 1e6, "volume": c.comoving_volume(z) / 1e9, "light": c.light_travel_distance(z)}
    return p.select("z", *[r(v, 4).alias(k) for k, v in named.items()])


@query(f"with p as (select distinct p_size / 20.0 as z from part), x as (select z, ({1 / 0.274 - 1}) / power(1 + z, 3) as x from p) select z, round(1 + 1.5 * x / (1 + x) + 3 * (1.175 * x + 2 * 0.3064 * x * x + 3 * 0.005355 * x * x * x) / (1 + 1.175 * x + 0.3064 * x * x + 0.005355 * x * x * x) - 3 * (1.857 * x + 2 * 1.021 * x * x + 3 * 0.153 * x * x * x) / (1 + 1.857 * x + 1.021 * x * x + 0.153 * x * x * x), 6) as rate from x")
def growth_rate(spark, sf_dir):
    p = table(spark, sf_dir, "part").select((F.col("p_size") / 20.0).alias("z")).distinct()
    return p.select("z", r(cosmo.Cosmology().growth_rate(F.col("z"))).alias("rate"))


@query("select distinct p_size / 20.0 as z, round(70.2 * sqrt(0.00008 * power(1 + p_size / 20.0, 4) + 0.274 * power(1 + p_size / 20.0, 3) + (1 - 0.274 - 0.72 - 0.00008) * power(1 + p_size / 20.0, 2) + 0.72), 6) as h, round(977.7922216807892 / 70.2 * 2 / (3 * sqrt(0.726)) * asinh(sqrt(0.726 / 0.274) * power(1 + p_size / 20.0, -1.5)), 6) as age from part")
def expansion_with_radiation(spark, sf_dir):
    z = F.col("p_size") / 20.0
    c = cosmo.Cosmology(70.2, 0.274, 0.72, 0.00008)
    return table(spark, sf_dir, "part").select(z.alias("z"), r(c.hubble(z)).alias("h"), r(cosmo.Cosmology().age_flat(z)).alias("age")).distinct()


@query("select distinct p_size / 20.0 as z, round(70.2 * sqrt((0.02255 + 0.1126) / (0.702 * 0.702) * power(1 + p_size / 20.0, 3) + 1 - (0.02255 + 0.1126) / (0.702 * 0.702)), 6) as h from part")
def physical_densities(spark, sf_dir):
    z = F.col("p_size") / 20.0
    return table(spark, sf_dir, "part").select(z.alias("z"), r(cosmo.Cosmology.physical().hubble(z)).alias("h")).distinct()


def _segments(y: str, n: int, back: bool) -> str:
    """Segments between ``n`` even steps of z up to 3 of y(@), worked out in SQL; ``back`` goes from y to z."""
    ends = "y0 as a, y1 as b, z0 as p, z1 as q" if back else "z0 as a, z1 as b, y0 as p, y1 as q"
    low, high = (f"(3.0 * {i} / {n - 1})" for i in ("i", "(i + 1)"))
    return f"steps as (select {low} as z0, {high} as z1, i from generate_series(0, {n - 2}) as g(i)), seg as (select {ends} from (select z0, z1, {y.replace('@', 'z0')} as y0, {y.replace('@', 'z1')} as y1 from steps))"


_XS, _YS = cosmo.inverse_table(lambda z: 4000 * z / (1 + 0.3 * z), 0.0, 3.0, 40)


@query(f"with {_segments('4000 * @ / (1 + 0.3 * @)', 40, True)}, d as (select distinct p_size * 50.0 as d from part) select d, round(min(p + (q - p) * (d - a) / (b - a)), 6) as z from d left join seg on d between a and b group by d")
def inverse_lookup(spark, sf_dir):
    d = table(spark, sf_dir, "part").select((F.col("p_size") * 50.0).alias("d")).distinct()
    return d.withColumn("z", r(cosmo.interpolate(F.col("d"), _YS, _XS)))


@query(f"with {_segments('4000 * @ / (1 + 0.3 * @)', 40, False)}, d as (select distinct p_size / 20.0 as z from part) select z, round(min(p + (q - p) * (z - a) / (b - a)), 4) as d from d left join seg on z between a and b group by z")
def distance_lookup(spark, sf_dir):
    z = table(spark, sf_dir, "part").select((F.col("p_size") / 20.0).alias("z")).distinct()
    return z.withColumn("d", r(cosmo.interpolate(F.col("z"), _XS, _YS), 4))


_LD, _LZ = angular.distance_table(cosmo.Cosmology(), 3.0)
_TRAPEZOIDS = (
    "te as (select i, 3.0 * i / 199 as z, 1 / sqrt(0.274 * power(1 + 3.0 * i / 199, 3) + 0.726) as e from generate_series(0, 199) as g(i)), "
    f"td as (select i, z, coalesce(sum((e + le) / 2 * (z - lz)) over (order by i), 0) * {_C} / 70.2 as d from (select *, lag(e) over (order by i) as le, lag(z) over (order by i) as lz from te)), "
    "seg as (select * from (select lag(d) over (order by i) as a, d as b, lag(z) over (order by i) as p, z as q from td) where a is not null)"
)


@query(f"with {_TRAPEZOIDS}, d as (select distinct p_size * 60.0 as d from part) select d, round(min(p + (q - p) * (d - a) / (b - a)), 6) as z from d left join seg on d between a and b group by d")
def redshift_of_distance(spark, sf_dir):
    d = table(spark, sf_dir, "part").select((F.col("p_size") * 60.0).alias("d")).distinct()
    return d.withColumn("z", r(cosmo.interpolate(F.col("d"), _LD, _LZ)))


@query("select distinct p_size, round(p_size / 5.0, 1) as z from part where p_size > 0")
def redshift_of_age(spark, sf_dir):
    """Ages of known redshifts, taken back to redshifts by the inverse table."""
    p = table(spark, sf_dir, "part").select("p_size").distinct()
    age = cosmo.Cosmology().age_flat(F.col("p_size") / 5.0)
    return p.select("p_size", r(angular.redshift_of_age(age, cosmo.Cosmology()), 1).alias("z"))


@query("select distinct p_size, round(p_size / 10.0, 1) as z from part")
def redshift_of_light_distance(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_size").distinct()
    d = cosmo.Cosmology().light_travel_distance(F.col("p_size") / 10.0)
    return p.select("p_size", r(angular.redshift_of_light_distance(d, cosmo.Cosmology()), 1).alias("z"))


# Sky coordinates.

_LST = "fmod(fmod(280.46061837 + ((epoch_us(ts) / 1000000.0 - 946684800) - 43200) / 86400 * 360.98564736629 - 79.83983, 360) + 360, 360)"


@query(f"select event_id, round(fmod(fmod(lst - degrees(atan2(-sin(a) * cos(e), sin(e) * cos(p) - cos(e) * cos(a) * sin(p))), 360) + 360, 360), 4) as ra, round(degrees(asin(sin(e) * sin(p) + cos(e) * cos(p) * cos(a))), 4) as dec from (select event_id, {_LST} as lst, radians(20 + user_id % 60) as e, radians(user_id * 7 % 360 + 0.5) as a, radians(38.43312) as p from events)")
def pointing_from_horizon(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    ra, dec = C.horizon_to_sky(20 + F.col("user_id") % 60, F.col("user_id") * 7 % 360 + 0.5, C.sidereal_degrees(F.col("ts")))
    return e.select("event_id", r(ra, 4).alias("ra"), r(dec, 4).alias("dec"))


@query("select c_custkey, round(fmod(degrees(atan2(-sin(h) * cos(d), sin(d) * cos(p) - cos(d) * cos(h) * sin(p))) + 720, 360), 5) as az, round(degrees(asin(sin(d) * sin(p) + cos(d) * cos(p) * cos(h))), 5) as el from (select c_custkey, radians(40.0 - (c_custkey * 7 % 360 + 0.5)) as h, radians(c_custkey % 80 - 20) as d, radians(38.43312) as p from customer)")
def sky_to_horizon(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    az, el = C.sky_to_horizon(F.col("c_custkey") * 7 % 360 + 0.5, F.col("c_custkey") % 80 - 20, F.lit(40.0))
    return c.select("c_custkey", r(az, 5).alias("az"), r(el, 5).alias("el"))


@query("select c_custkey, round(atan(sin(h) / (cos(d) * tan(p) - sin(d) * cos(h))), 6) as angle from (select c_custkey, radians(c_custkey % 90 - 45.25) as h, radians(c_custkey % 70 - 20) as d, radians(38.43312) as p from customer)")
def parallactic_angle(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", r(C.parallactic_angle(F.col("c_custkey") % 90 - 45.25, F.col("c_custkey") % 70 - 20)).alias("angle"))


@query("select c_custkey, round(case when c_acctbal < 0 then -1 else 1 end * floor(abs(c_acctbal / 200) * 360000 + 0.5) / 360000, 5) as degrees from customer")
def sexagesimal_round_trip(spark, sf_dir):
    text = C.sexagesimal(F.col("c_acctbal") / 200)
    return table(spark, sf_dir, "customer").select("c_custkey", r(C.from_sexagesimal(text), 5).alias("degrees"))


@query("select event_id, round(floor((epoch_us(ts) / 1000000.0 - 946684800) * 100) / 100, 2) as seconds from events")
def time_text_round_trip(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", r(C.text_seconds(C.time_text(C.seconds_2000(F.col("ts")))), 2).alias("seconds"))


@query("select p_partkey, p_size, case when p_size < 50 then p_size // 5 when p_size = 50 then 9 end as bin, cast(round_even(p_retailprice / 25.0, 0) * 25.0 as double) as multiple from part")
def edge_bins(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    edges = C.bin_edges([2.5 + 5 * k for k in range(10)])
    return p.select("p_partkey", "p_size", C.edge_bucket(F.col("p_size"), edges, closed=True).alias("bin"), C.nearest_multiple(F.col("p_retailprice"), 25.0).alias("multiple"))


# Lineage.


@query("select p_partkey, '000: read;001: ' || p_brand as history from part")
def history_entries(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("history", F.lit(None).cast("array<struct<entry:string,details:array<string>>>"))
    h = lineage.add_history(p, "read", ["file"])
    h = lineage.add_history(h, "brand", ["x"])
    entries = F.transform("history.entry", lambda e: F.replace(e, F.lit("brand"), F.col("p_brand")))
    return h.select("p_partkey", F.array_join(entries, ";").alias("history"))


@query("select p_brand, '000: read' as entries, string_agg(distinct split_part(p_type, ' ', 1), ',' order by split_part(p_type, ' ', 1)) as details from part group by p_brand")
def merged_histories(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    one = F.array(F.struct(F.lit("000: read").alias("entry"), F.array(F.split("p_type", " ")[0]).alias("details")))
    m = lineage.merge_histories(p.select("p_brand", one.alias("history")), ["p_brand"])
    return m.select("p_brand", F.array_join("history.entry", ";").alias("entries"), F.array_join(F.array_sort(F.flatten("history.details")), ",").alias("details"))


_PATH = "'maps/' || split_part(p_type, ' ', 1) || '/part_' || p_size || '-' || (p_size + 6) || '.fits'"


@query(f"select p_partkey, regexp_replace({_PATH}, '([^/]*)$', 'sub/\\1') as path, p_size as first_scan, p_size + 6 as last_scan from part")
def file_names(spark, sf_dir):
    path = F.concat(F.lit("maps/"), F.split("p_type", " ")[0], F.lit("/part_"), "p_size", F.lit("-"), F.col("p_size") + 6, F.lit(".fits"))
    low, high = lineage.scan_range(path)
    return table(spark, sf_dir, "part").select("p_partkey", lineage.sub_directory(path, "sub").alias("path"), low.alias("first_scan"), high.alias("last_scan"))


@query("with f as (select distinct 'x_' || p_size || '-' || (p_size + 6) || '.fits' as path, p_size as lo, p_size + 6 as hi from part), s as (select distinct s_nationkey as scan from supplier) select scan, path from s join f on scan between lo and hi")
def files_of_scans(spark, sf_dir):
    path = F.concat(F.lit("x_"), "p_size", F.lit("-"), F.col("p_size") + 6, F.lit(".fits"))
    files = table(spark, sf_dir, "part").select(path.alias("path")).distinct()
    scans = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("scan")).distinct()
    return lineage.files_with_scan(files, scans).select("scan", "path")


@query("select a.r_name as left_, b.r_name as right_, 'map_' || a.r_regionkey as left_map, 'w_' || b.r_regionkey as right_weight from region a join region b on a.r_name < b.r_name")
def paired_catalogs(spark, sf_dir):
    g = table(spark, sf_dir, "region")
    m = g.select(F.col("r_name").alias("tag"), F.concat(F.lit("map_"), "r_regionkey").alias("map"))
    w = g.select(F.col("r_name").alias("tag"), F.concat(F.lit("w_"), "r_regionkey").alias("weight"))
    out = lookup.pair_catalogs(m, w, "tag")
    return out.select(F.col("left").alias("left_"), F.col("right").alias("right_"), F.col("map_left").alias("left_map"), F.col("weight_right").alias("right_weight"))


# Calibration.


@query(f"with {STREAM}, g as (select chan, avg(value) / 100 as gx, avg(value) filter (where pol = 'YY') / 100 as gy from stream group by chan) select s.t, s.pol, s.cal, s.chan, round(s.value * case pol when 'XX' then gx when 'YY' then gy else sqrt(gx * gy) end, 3) as value from stream s left join g using (chan)")
def differential_gain(spark, sf_dir):
    s = stream_rows(spark, sf_dir)
    g = s.groupBy("chan").agg((F.avg("value") / 100).alias("gx"), (F.avg(F.when(F.col("pol") == "YY", F.col("value"))) / 100).alias("gy"))
    return lookup.differential_gain(s, g, ["chan"]).select("t", "pol", "cal", "chan", r("value", 3).alias("value"))


_SKY = "t as (select s_suppkey, s_suppkey * 37 % 360 + 0.25 as ra, s_suppkey * 11 % 60 - 30.0 as dec, s_acctbal as rm from supplier), p as (select c_custkey, c_custkey * 53 % 360 + 0.75 as ra, c_custkey * 17 % 60 - 29.5 as dec from customer)"


@query(f"with {_SKY}, a as (select c_custkey, rm, degrees(acos(greatest(-1, least(1, sin(radians(p.dec)) * sin(radians(t.dec)) + cos(radians(p.dec)) * cos(radians(t.dec)) * cos(radians(p.ra - t.ra)))))) as angle, t.ra, t.dec from p join t on abs(p.dec - t.dec) <= 10), n as (select c_custkey, rm, row_number() over (partition by c_custkey order by angle, ra, dec) as k from a where angle <= 10) select p.c_custkey, n.rm from p left join n on n.c_custkey = p.c_custkey and k = 1")
def nearest_rotation_measure(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 37 % 360 + 0.25).alias("ra"), (F.col("s_suppkey") * 11 % 60 - 30.0).alias("dec"), F.col("s_acctbal").alias("rm"))
    c = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") * 53 % 360 + 0.75).alias("ra"), (F.col("c_custkey") * 17 % 60 - 29.5).alias("dec"))
    return lookup.nearest_on_sky(files.stager(spark, "nearest"), c, s, "rm", 10.0).select("c_custkey", "rm")


@query("select o_orderkey, o_totalprice, o_orderpriority from orders where o_orderkey in (select l_orderkey from lineitem)")
def restored_fields(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.lit(0.0).alias("o_totalprice")).distinct()
    return lookup.restore_fields(li, table(spark, sf_dir, "orders"), ["o_orderkey"], ["o_totalprice", "o_orderpriority"])


@query(f"with {STREAM}, g as (select t, pol, avg(value) filter (where cal = 'T') - avg(value) filter (where cal = 'F') as g from stream group by t, pol) select s.t, s.pol, s.cal, s.chan, case when g > 0 then round(s.value / g, 5) end as value from stream s join g using (t, pol)")
def scale_by_cal_spectrum(spark, sf_dir):
    out = ts.scale_by_cal_spectrum(stream_rows(spark, sf_dir), ["t"], ["pol"])
    return out.select("t", "pol", "cal", "chan", r("value", 5).alias("value"))


@query(f"""with {STREAM}, w as (select t, cal, chan, max(value) filter (where pol = 'XX') as xx, max(value) filter (where pol = 'YY') as yy from stream group by all)
select t, cal, chan, 'XX' as pol, round(xx, 6) as value from w where xx + yy is not null union all select t, cal, chan, 'YY', round(yy, 6) from w where xx + yy is not null""")
def unrotate_polarisation(spark, sf_dir):
    iq = ts.rotate_polarisation(stream_rows(spark, sf_dir), ["t", "cal", "chan"], ["I", "Q"])
    return ts.unrotate_polarisation(iq, ["t", "cal", "chan"]).withColumn("value", r("value"))


@query(f"with {STREAM}, p as (select pol, t % 24 as phase, avg(value) as v from stream group by all), s as (select pol, phase, case when (v - avg(v) over w) / stddev_pop(v) over w > 0.8 then 'on' when (v - avg(v) over w) / stddev_pop(v) over w < -0.7 then 'off' else 'blank' end as state from p window w as (partition by pol)) select pol, t // 24 as n, state, round(avg(value), 6) as value from stream join s using (pol) where s.phase = t % 24 and state <> 'blank' group by all")
def separate_cal(spark, sf_dir):
    rows = stream_rows(spark, sf_dir)
    return ts.separate_cal(rows, ["pol"], 24, ts.fold_on_cal(rows, ["pol"], 24)).withColumn("value", r("value"))


@query(f"with {STREAM}, m as (select t, pol, chan, median(value) filter (where cal = 'T') - median(value) filter (where cal = 'F') as v from stream group by all) select chan, pol, round(avg(v), 6) as value from m group by all")
def on_off_medians(spark, sf_dir):
    m = fits.on_off_medians(stream_rows(spark, sf_dir), ["t", "pol", "chan"], F.col("cal") == "T")
    return m.groupBy("chan", "pol").agg(r(F.avg("value")).alias("value"))


@query(f"with {STREAM} select chan, round(avg(150.0) filter (where pol = 'XX') / avg(value) filter (where pol = 'XX'), 8) as gx, round(150.0 / avg(value) filter (where pol = 'YY'), 8) as gy from stream group by chan")
def differential_gain_fit(spark, sf_dir):
    g = fits.differential_gains(stream_rows(spark, sf_dir), ["chan"], F.lit(150.0))
    return g.select("chan", r("gx", 8).alias("gx"), r("gy", 8).alias("gy"))


@query(f"with {STREAM}, k as (select t, cal, chan, case pol when 'XX' then 0 when 'XY' then 1 when 'YX' then 2 else 3 end as pol, value from stream) select chan, round(regr_intercept(value, t - 210384) filter (where pol = 0), 4) as m00, round(regr_slope(value, t - 210384) filter (where pol = 0) * 1000, 4) as m01, round(regr_intercept(value, t - 210384) filter (where pol = 3), 4) as m30 from k group by chan")
def mueller_fit(spark, sf_dir):
    index = F.when(F.col("pol") == "XX", 0).when(F.col("pol") == "XY", 1).when(F.col("pol") == "YX", 2).otherwise(3)
    rows = stream_rows(spark, sf_dir).withColumn("pol", index)
    m = fits.mueller_fit(rows, ["chan"], [F.lit(1.0), (F.col("t") - 210384) / 1000])
    return m.select("chan", r(F.col("m")[0][0], 4).alias("m00"), r(F.col("m")[0][1], 4).alias("m01"), r(F.col("m")[3][0], 4).alias("m30"))


@query(f"with {STREAM}, w as (select pol, cal, 1 / avg(case when value >= 50 then value - 50 end) as w from stream group by all) select s.t, s.pol, s.cal, s.chan, case when value >= 50 then round(value - 50, 6) end as value, round(w, 8) as weight from stream s join w using (pol, cal)")
def system_temperature_weights(spark, sf_dir):
    rows = stream_rows(spark, sf_dir).withColumn("value", F.col("value") - 50)
    return fits.scan_weights(rows, ["pol", "cal"]).select("t", "pol", "cal", "chan", r("value").alias("value"), r("weight", 8).alias("weight"))


@query(f"with {HOURLY}, e as (select event_type, arg_max(t, value) as a, arg_min(t, value) as b from hourly group by 1) select event_type, round(avg(value) filter (where abs(t - a) <= 5) - avg(value) filter (where abs(t - b) <= 5), 6) as value from hourly join e using (event_type) group by event_type")
def bright_passages(spark, sf_dir):
    return fits.bright_passages(hourly(spark, sf_dir), ["event_type"], 5).withColumn("value", r("value"))


@query("select p_partkey, round(power(10, 2.1 - 0.8 * log10((700 + p_size) / 1000.0) + 0.1 * power(log10((700 + p_size) / 1000.0), 2)) * 2, 6) as flux from part")
def calibrator_flux(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", r(fits.source_spectrum(F.lit(700) + F.col("p_size"), [2.1, -0.8, 0.1])).alias("flux"))


@query(f"with {HOURLY} select event_type, round(regr_intercept(value, t - 210384), 4) as a, round(regr_slope(value, t - 210384) * 1000, 4) as b from hourly group by event_type")
def linear_fit(spark, sf_dir):
    f = fits.linear_fit(hourly(spark, sf_dir), ["event_type"], [F.lit(1.0), (F.col("t") - 210384) / 1000])
    return f.select("event_type", r(F.col("coefficients")[0], 4).alias("a"), r(F.col("coefficients")[1], 4).alias("b"))


_PART = "b as (select p_size, avg(p_retailprice) / 1000 as v, stddev_samp(p_retailprice) / 1000 + 0.05 as e from part group by p_size)"


@query(f"with {_PART}, g as (select x / 10.0 as x from generate_series(1, 30) as t(x)), rr as (select y / 4.0 as r from generate_series(1, 4) as t(y)), l as (select x, r, sum(-0.5 * power((v - r * x * 1.1) / (e * 50), 2)) as l from b, g, rr group by all) select x, round(ln(avg(exp(l))), 5) as loglike from l group by x")
def cross_likelihood(spark, sf_dir):
    b = table(spark, sf_dir, "part").groupBy("p_size").agg((F.avg("p_retailprice") / 1000).alias("value"), ((F.stddev_samp("p_retailprice") / 1000 + 0.05) * 50).alias("error")).withColumn("model", F.lit(1.1))
    g, rr = spark.range(1, 31).select((F.col("id") / 10.0).alias("x")), spark.range(1, 5).select((F.col("id") / 4.0).alias("r"))
    return fits.cross_given_auto(rr, b, g, []).select("x", r("loglike", 5).alias("loglike"))


@query("with d as (select p_size as x, count(*) as p from part where p_size between 1 and 49 group by 1), i as (select x, p, row_number() over (order by x) as i, count(*) over () as n, (max(x) over () - min(x) over ()) / (count(*) over () - 1.0) as h from d), s as (select sum(p * h / 3 * case when i = 1 or i = n then 1 when i % 2 = 0 then 4 else 2 end) as s from i) select x, round(p / s, 8) as p from i, s")
def simpson_density(spark, sf_dir):
    d = table(spark, sf_dir, "part").where("p_size between 1 and 49").groupBy(F.col("p_size").alias("x")).agg(F.count("*").cast("double").alias("p")).withColumn("k", F.lit(1))
    return fits.simpson_normalised(d, ["k"]).select("x", r("p", 8).alias("p"))


# Maps.


@query(f"with {GRID} select fi, ri, di, round(value * weight, 4) as weighted, round(value, 4) as value from grid where weight > 0")
def weights_applied(spark, sf_dir):
    m = maps.apply_weights(grid(spark, sf_dir))
    back = maps.unapply_weights(m)
    keys = ["fi", "ri", "di"]
    return m.select(*keys, r("value", 4).alias("weighted")).join(back.select(*keys, r("value", 4).alias("value")), keys).where("value is not null")


@query(f"with {GRID} select fi, ri, di, round(value, 4) as value, round((ri + 1 - 3.0) * -0.25 + 218.0, 6) as ra, round((di + 1 - 6.0) * 0.25 + 2.0, 6) as dec from grid")
def map_coordinates(spark, sf_dir):
    out = maps.wcs_coordinates(grid(spark, sf_dir), {"ri": ("ra", 3.0, 218.0, -0.25), "di": ("dec", 6.0, 2.0, 0.25)})
    return out.select("fi", "ri", "di", r("value", 4).alias("value"), r("ra").alias("ra"), r("dec").alias("dec"))


_SECTIONS = SAMPLES + ", sec as (select l_linenumber % 3 + 1 as s, fi, ri, di, sum(value * weight) / sum(weight) as value, sum(weight) as weight from samples group by all), flat as (select *, value - sum(weight * value) over w / sum(weight) over w as v from sec window w as (partition by s, fi))"


@query(f"with {_SECTIONS}, t as (select fi, ri, di, v as t from flat where s = 1), g as (select s, fi, sum(v * weight * t) / sum(t * weight * t) as gain from flat join t using (fi, ri, di) group by all) select s, fi, ri, di, round(value / gain / 10000, 3) as value from flat join g using (s, fi) where gain > 0.02 or gain < -0.02")
def section_gains(spark, sf_dir):
    s = samples(spark, sf_dir).withColumn("s", F.col("l_linenumber") % 3 + 1)
    m = maps.weighted_stack(s, ["s", "fi", "ri", "di"])
    flat = maps.subtract_weighted_mean(m, ["s", "fi"])
    gain = maps.template_gain(flat, flat.where("s = 1").select("fi", "ri", "di", "value"), maps.PIXEL, ["s", "fi"])
    out = maps.calibrate_against_first(m, "s", F.lit(1), ["fi"]).join(gain, ["s", "fi"]).where("abs(gain) > 0.02")
    return out.select("s", "fi", "ri", "di", r(F.col("value") / 10000, 3).alias("value"))


@query(f"with {SAMPLES} select fi, ri, di, round(count(*) / 8.0, 6) as nbar from samples group by all")
def selection_from_mocks(spark, sf_dir):
    s = samples(spark, sf_dir)
    counts = lambda rows: maps.hit_map(rows).withColumnRenamed("hits", "n")
    mocks = s.where("l_linenumber > 1").groupBy("l_linenumber", *maps.PIXEL).agg(F.count("*").alias("n")).drop("l_linenumber")
    return maps.selection_from_mocks(mocks, counts(s.where("l_linenumber = 1")), 7).withColumn("nbar", r("nbar"))


@query(f"with {GRID}, b as (select 'a' as band, fi, ri, di, value, 900.0 - fi as freq from grid where fi <= 6 union all select 'b', fi - 6, ri, di, value, 900.0 - fi from grid where fi > 6) select cast(dense_rank() over (order by freq) - 1 as integer) as fi, ri, di, round(value, 4) as value from b")
def glued_bands(spark, sf_dir):
    g = grid(spark, sf_dir).withColumn("freq", 900.0 - F.col("fi"))
    parts = g.where("fi <= 6").withColumn("band", F.lit("a")).unionByName(g.where("fi > 6").withColumn("fi", F.col("fi") - 6).withColumn("band", F.lit("b")))
    return maps.glue(parts, "band").select("fi", "ri", "di", r("value", 4).alias("value"))


@query(f"with {GRID} select fi, ri, di, round(value, 4) as value from grid union all select cast(fi + 13 as integer), ri, di, round(value / 2, 4) from grid where fi <= 3")
def extended_stack(spark, sf_dir):
    g = grid(spark, sf_dir)
    return maps.extended_stack(g, g.where("fi <= 3").withColumn("value", F.col("value") / 2)).select(F.col("fi").cast("int").alias("fi"), "ri", "di", r("value", 4).alias("value"))


# Spectra and correlations.


@query(f"with {SPEC}, c as (select a.chan, b.chan as chan2, avg(a.value * b.value) as cov from spec a join spec b on a.t = b.t where a.chan = b.chan group by all) select round(avg(cov), 6) as mean from c")
def mean_of_diagonal(spark, sf_dir):
    cov = modes.freq_covariance(spectra_rows(spark, sf_dir).withColumn("weight", F.lit(1.0)), ["t"]).withColumn("k", F.lit(1))
    return spectra.mean_diagonal(cov, ["k"]).select(r("mean").alias("mean"))


@query(f"with {SPEC}, m as (select * from spec where value > 1.9) select a.scan, a.chan, b.chan as chan2, round(sum(a.value * b.value), 4) as total, count(*) as n from m a join m b on a.t = b.t and a.scan = b.scan group by all")
def masked_covariance(spark, sf_dir):
    rows = spectra_rows(spark, sf_dir).withColumn("value", F.when(F.col("value") > 1.9, F.col("value")))
    out = modes.masked_covariance(rows, ["scan"])
    return out.select("scan", F.col("chan").cast("long").alias("chan"), F.col("chan2").cast("long").alias("chan2"), r("total", 4).alias("total"), "n")


@query(f"with {TRIALS}, t as (select sim, bin, power - first_value(power) over (partition by bin order by sim) as power from trials) select sim, bin, round(power, 4) as power from t")
def subtract_power(spark, sf_dir):
    t = trials(spark, sf_dir)
    first = t.groupBy("bin").agg(F.min_by("power", "sim").alias("power"))
    return spectra.subtract_power(t, first, ["bin"]).select("sim", "bin", r("power", 4).alias("power"))


@query(f"with {TRIALS} select bin, round(1 / var_samp(power), 10) as weight from trials group by bin")
def mock_weights(spark, sf_dir):
    return spectra.mock_weights(trials(spark, sf_dir), ["bin"]).withColumn("weight", r("weight", 10))


@query(f"with {TRIALS}, c as (select sim as bx, bin as bq, sim::double as kx, bin::double as ky, power, counts from trials), m as (select l_suppkey % 20 as bx, ri as bq, l_linenumber, avg(value) as power from samples group by all), w as (select bx, bq, coalesce(1 / nullif(var_samp(power), 0), 0) as w from m group by bx, bq), b as (select case when k = 24 then 5 else cast(floor(k / 4) as integer) end as bin, power, counts, w from (select *, sqrt(kx * kx + ky * ky) as k from c join w using (bx, bq)) where k <= 24) select bin, round(sum(power * w) / sum(w), 3) as power, sum(counts) as counts from b group by bin")
def cross_power_summary(spark, sf_dir):
    s = samples(spark, sf_dir)
    c = trials(spark, sf_dir).select(F.col("sim").alias("bx"), F.col("bin").alias("by"), F.col("sim").cast("double").alias("kx"), F.col("bin").cast("double").alias("ky"), "power", "counts")
    mocks = s.groupBy((F.col("l_suppkey") % 20).alias("bx"), F.col("ri").alias("by"), "l_linenumber").agg(F.avg("value").alias("power"))
    return spectra.cross_power_summary(c, mocks, [], [0.0, 4.0, 8.0, 12.0, 16.0, 20.0, 24.0]).select("bin", r("power", 3).alias("power"), "counts")


@query(f"with {TRIALS} select sim as sim_id, bin, round((power - p1) / 0.8, 4) as power from trials join (select bin, power as p1 from trials where sim = 1) using (bin) where bin >= 2 and bin < 8")
def simulation_summary(spark, sf_dir):
    t = trials(spark, sf_dir).select(F.col("sim").alias("sim_id"), "bin", F.col("bin").cast("double").alias("k"), "power", "counts")
    less = t.select("sim_id", "bin").join(t.where("sim_id = 1").select("bin", "power"), "bin")
    out = spectra.simulation_summary(t, ["bin"], (2.0, 8.0), t.select("bin").distinct().withColumn("transfer", F.lit(0.8)), less)
    return out.select("sim_id", "bin", r("power", 4).alias("power"))


@query(f"with {TRIALS} select bin, round(avg(power) * power(bin, 3) / (2 * pi() * pi()), 3) as power from trials where bin > 0 group by bin")
def unitless_power(spark, sf_dir):
    m = trials(spark, sf_dir).where("bin > 0").groupBy("bin").agg(F.avg("power").alias("p"))
    return m.select("bin", r(spectra.unitless(F.col("p"), F.col("bin").cast("double")), 3).alias("power"))


@query(f"with {TRIALS}, p as (select sim, bin as i, power from trials where bin < 10), w as (select sim, bin as i, 1.0 + bin as power from trials where bin < 10), l as (select cast(x as integer) as lag from generate_series(0, 9) as g(x)), a as (select sim, lag, sum(power * cos(i * lag * 2 * pi() / 10)) / 10 as v from p, l group by all), b as (select sim, lag, sum(power * cos(i * lag * 2 * pi() / 10)) / 10 as v from w, l group by all), j as (select sim, lag, a.v * b.v as v from a join b using (sim, lag)) select sim, cast(i.lag as integer) as i, round(sum(v * cos(j.lag * i.lag * 2 * pi() / 10)), 3) as power from j, l i group by all")
def convolved_power(spark, sf_dir):
    t = trials(spark, sf_dir).where("bin < 10").select("sim", F.col("bin").alias("i"), "power")
    return spectra.lag_product(t, t.withColumn("power", 1.0 + F.col("i")), ["sim"], 10).select("sim", "i", r("power", 3).alias("power"))


@query(f"with {GRID}, v as (select fi, ri, di, value / 10000 as value, weight from grid), o as (select i, j, case when i = 0 and j = 0 then 0 else 1 end as lag from (values (0,0),(1,0),(-1,0),(0,1),(0,-1)) as t(i, j)), c as (select a.fi as f1, b.fi as f2, cast(lag as integer) as lag, sum(a.weight * b.weight * a.value * b.value) / sum(a.weight * b.weight) as corr, sum(a.weight * b.weight) as w from v a, o join v b on b.ri = a.ri + i and b.di = a.di + j group by all) select abs(f1 - f2) as df, lag, round(sum(corr * w) / sum(w), 5) as corr from c group by all")
def correlation_by_frequency_lag(spark, sf_dir):
    g = grid(spark, sf_dir).withColumn("value", F.col("value") / 10000)
    return modes.by_frequency_lag(modes.correlation(g, g, [0.0, 0.5, 1.2], 1, 1.0)).select("df", "lag", r("corr", 5).alias("corr"))


@query(f"with {SPEC}, c as (select a.chan as f1, b.chan as f2, 0 as lag, avg(a.value * b.value) as corr from spec a join spec b on a.t = b.t group by all), m as (select cast(c as bigint) as chan, 1 / 8.0 as v from generate_series(0, 63) as g(c)), a as (select sum(corr * x.v * y.v) as a from c join m x on x.chan = f1 join m y on y.chan = f2) select f1, f2, round(corr - a / 64, 6) as corr from c, a")
def correlation_without_mode(spark, sf_dir):
    rows = spectra_rows(spark, sf_dir).withColumn("weight", F.lit(1.0))
    c = modes.freq_covariance(rows, ["t"]).select(F.col("chan").cast("long").alias("f1"), F.col("chan2").cast("long").alias("f2"), F.lit(0).alias("lag"), F.col("cov").alias("corr"))
    m = spark.range(64).select(F.lit(0).alias("mode"), F.col("id").alias("chan"), F.lit(1 / 8).alias("v"))
    return fits.subtract_correlation_modes(c, m).select("f1", "f2", r("corr").alias("corr"))


@query(f"with {TRIALS} select bin, round(avg(power), 4) as mean, round(stddev_pop(power), 4) as deviation from trials group by bin")
def pair_mean_and_deviation(spark, sf_dir):
    return modes.pair_statistics(trials(spark, sf_dir), ["bin"], "power").select("bin", r("mean", 4).alias("mean"), r("deviation", 4).alias("deviation"))


@query("select o_orderkey, round(greatest(o_totalprice / 1e5, 0.8), 7) as thermal from orders")
def radiometer_limit(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice") / 1e5).alias("thermal"))
    return lookup.floor_at_radiometer(o, "thermal", F.lit(0.8)).select("o_orderkey", r("thermal", 7).alias("thermal"))


@query(f"with {HOURLY}, m as (select event_type, t, value, 60 + 0.01 * (t - 757000) + value / 2 as m from hourly), f as (select event_type, regr_slope(value, t) as a, regr_intercept(value, t) as b, regr_slope(m, t) as c, regr_intercept(m, t) as d from m group by 1), h as (select event_type, value - (a * t + b) as v, m - (c * t + d) as m from m join f using (event_type)) select event_type, round(sum(v * m) / sum(m * m), 4) as gain from h group by event_type")
def gain_from_map(spark, sf_dir):
    h = hourly(spark, sf_dir).withColumn("map_value", 60 + 0.01 * (F.col("t") - 757000) + F.col("value") / 2)
    return noise.gain_from_map(h, ["event_type"], "t", 1).select("event_type", r("gain", 4).alias("gain"))


# SQL for queries that are registered elsewhere.

ORACLE["gaussian_time_smooth"] = f"with {HOURLY}, k as (select k, exp(-0.5 * power(k / (5.0 / 2.354820045), 2)) as w from generate_series(-10, 10) as g(k)) select h.event_type, h.t, round(sum(x.value * w) / sum(w), 6) as smooth from hourly h, k join hourly x on x.event_type = h.event_type and x.t = h.t - k group by all"

_SMOOTH = "exp(-0.5 * power(k / (10.0 / 2.354820045), 2))"
ORACLE["filter_foregrounds"] = f"""with {SPEC}, m as (select scan, t, chan // 8 as sub, avg(value) as v from spec group by all), c as (select scan, t, sub, v - avg(v) over (partition by scan, sub) as v from m),
k as (select k, {_SMOOTH} as w from generate_series(-20, 20) as g(k)), s as (select a.scan, a.t, a.sub, sum(b.v * w) / sum(w) as s from c a, k join c b on b.scan = a.scan and b.sub = a.sub and b.t = a.t - k group by all)
select scan, t, chan, round(value - s, 6) as value from spec join s using (scan, t) where sub = chan // 8"""

_KEYS = "case when abs(s) < 1 then 1.5 * power(abs(s), 3) - 2.5 * s * s + 1 when abs(s) < 2 then -0.5 * power(abs(s), 3) + 2.5 * s * s - 4 * abs(s) + 2 else 0 end"
ORACLE["map_lookup_cubic"] = f"""with {GRID}, points as (select l_orderkey, l_linenumber, max(fi) as fi, max(di) as di, max(l_quantity) as l_quantity from samples group by all), p as (select *, l_quantity / 5.0 as x, unnest([-1, 0, 1, 2]) as k from points),
q as (select *, floor(x) + k as ri, x - (floor(x) + k) as s from p), w as (select *, {_KEYS} as w from q), n as (select l_orderkey, l_linenumber, g.value as v, w.w from w left join grid g on g.fi = w.fi and g.di = w.di and g.ri = w.ri where w.w <> 0)
select l_orderkey, l_linenumber, case when count(v) = count(*) then round(sum(w * v), 4) end as map_value from n group by all"""

ORACLE["pair_power_spectra"] = f"""with {GRID}, win as (select cast(i as integer) as fi, 0.42 - 0.5 * cos(2 * pi() * i / 11) + 0.08 * cos(4 * pi() * i / 11) as b from generate_series(0, 11) as g(i)),
c as (select g.fi - 1 as fi, ri, di, value, weight * b as w from grid g join win on win.fi = g.fi - 1 where di < 11),
k1 as (select i from generate_series(0, 11) as g(i)), k2 as (select i from generate_series(0, 10) as g(i)),
f1 as (select a.i as kf, ri, di, sum(value * w * cos(2 * pi() * a.i * fi / 12)) as re, -sum(value * w * sin(2 * pi() * a.i * fi / 12)) as im from c, k1 a group by all),
f2 as (select kf, b.i as kr, di, sum(re * cos(2 * pi() * b.i * ri / 11) + im * sin(2 * pi() * b.i * ri / 11)) as re, sum(im * cos(2 * pi() * b.i * ri / 11) - re * sin(2 * pi() * b.i * ri / 11)) as im from f1, k2 b group by all),
f3 as (select kf, kr, b.i as kd, sum(re * cos(2 * pi() * b.i * di / 11) + im * sin(2 * pi() * b.i * di / 11)) as re, sum(im * cos(2 * pi() * b.i * di / 11) - re * sin(2 * pi() * b.i * di / 11)) as im from f2, k2 b group by all),
p as (select (re * re + im * im) / (select sum(w * w) from c) as power, 2 * pi() * sqrt(power((case when kf < 6 then kf else kf - 12 end) / 12.0, 2) + power((case when kr <= 5 then kr else kr - 11 end) / 11.0, 2) + power((case when kd <= 5 then kd else kd - 11 end) / 11.0, 2)) as k from f3),
e as (select cast(j as integer) as bin, 0.3 * power(6.0 / 0.3, j / 8.0) as lo, 0.3 * power(6.0 / 0.3, (j + 1) / 8.0) as hi from generate_series(0, 7) as g(j))
select 'A_with_B' as pair, bin, round(avg(power), 3) as power, count(*) as counts from p join e on k >= lo and k < hi group by bin"""

ORACLE["series_power_spectrum"] = f"""with {HOURLY}, first as (select event_type, min(t) as t0 from hourly group by 1), s as (select event_type, t - t0 as i, value from hourly join first using (event_type) where t - t0 < 720), l as (select lag from generate_series(0, 719) as g(lag)),
c as (select a.event_type, l.lag, sum(a.value * b.value) as v, count(*) as w from s a join s b on a.event_type = b.event_type, l where (b.i - a.i + 720) % 720 = l.lag group by all), m as (select event_type, max(w) as m from c group by 1),
q as (select c.event_type, lag, v / w as q from c), f as (select i from generate_series(0, 359) as g(i))
select event_type, cast(f.i as integer) as i, round(sum(q * cos(2 * pi() * lag * f.i / 720)) * 0.036, 3) as power from q, f group by all"""
