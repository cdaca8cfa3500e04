"""Queries of named-axis algebra, special functions, beams, angular power and noise models, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyquilt.functions import special
from skyquilt.functions.cosmology import Cosmology, interpolate
from skyquilt.operators import algebra as A
from skyquilt.operators import angular, beams, maps, noise_model
from skyquilt.operators import timestream as ts

from .catalog import GRID, SAMPLES, SPEC, grid, query, r, samples, spectra_rows, table

# A matrix over (flag, line) x (flag, month), block diagonal in the flag; and a vector over (flag, month).
MATRIX = "m as (select l_returnflag as flag, l_linenumber as line, cast(month(l_shipdate) as integer) as mon, sum(l_quantity) as value from lineitem group by all), v as (select l_returnflag as flag, cast(month(l_shipdate) as integer) as mon, avg(l_discount) as value from lineitem group by all)"


def block_matrix(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_returnflag").alias("flag"), F.col("l_linenumber").alias("line"), F.month("l_shipdate").alias("mon")).agg(F.sum("l_quantity").alias("value"))


def block_vector(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("flag"), F.month("l_shipdate").alias("mon")).agg(F.avg("l_discount").alias("value"))


def spectra_cubes(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("a"))


@query("select vec_id, i // 16 as x, i % 16 // 4 as y, i % 4 as z, round(cast(embedding[i + 1] as double), 6) as value from embeddings, generate_series(0, 63) as g(i)")
def vector_axes(spark, sf_dir):
    out = A.vector(spectra_cubes(spark, sf_dir), "a", ["vec_id"], {"x": 4, "y": 4, "z": 4})
    return out.select("vec_id", *[F.col(c).cast("long").alias(c) for c in "xyz"], r("value").alias("value"))


@query("select vec_id, i as place, round(cast(embedding[i + 1] as double), 6) as value from embeddings, generate_series(0, 63) as g(i)")
def flat_view(spark, sf_dir):
    out = A.vector(spectra_cubes(spark, sf_dir), "a", ["vec_id"], {"x": 4, "y": 4, "z": 4})
    return out.select("vec_id", A.flat_index({"x": 4, "y": 4, "z": 4}).alias("place"), r("value").alias("value"))


@query(f"with {MATRIX} select count(distinct (flag, line)) as n_rows, count(distinct (flag, mon)) as n_cols from m")
def matrix_shape(spark, sf_dir):
    return A.matrix_shape(block_matrix(spark, sf_dir), ["flag", "line"], ["flag", "mon"])


@query(f"with {MATRIX} select flag, count(distinct line) as n_rows, count(distinct mon) as n_cols from m group by flag")
def block_shapes(spark, sf_dir):
    return A.block_shapes(block_matrix(spark, sf_dir), ["flag", "line"], ["flag", "mon"])


@query(f"with {MATRIX} select distinct flag, line from m")
def matrix_row_keys(spark, sf_dir):
    return A.row_keys(block_matrix(spark, sf_dir), ["flag", "line"])


@query(f"with {MATRIX} select distinct flag, mon from m")
def matrix_column_keys(spark, sf_dir):
    return A.row_keys(block_matrix(spark, sf_dir), ["flag", "mon"])


@query(f"with {MATRIX} select flag, line, value from m where line = mon")
def matrix_diagonal(spark, sf_dir):
    return A.diagonal(block_matrix(spark, sf_dir), {"line": "mon"})


@query(f"with {MATRIX} select flag, line, mon, value from m where mon >= line")
def matrix_upper_triangle(spark, sf_dir):
    return A.upper_triangle(block_matrix(spark, sf_dir), "line", "mon")


@query(f"with {MATRIX} select flag, line as mon, mon as line, value from m")
def matrix_transpose(spark, sf_dir):
    return A.transpose(block_matrix(spark, sf_dir), {"line": "mon"})


@query(f"with {MATRIX} select flag, line, value from m where mon = 3")
def matrix_index_axis(spark, sf_dir):
    return A.index_axis(block_matrix(spark, sf_dir), "mon", 3)


@query(f"with {MATRIX}, a as (select distinct flag, line from m), b as (select distinct flag as f2, mon from m) select a.flag as row_flag, a.line as row_line, b.f2 as col_flag, b.mon as col_mon, coalesce(m.value, 0) as value from a cross join b left join m on m.flag = a.flag and m.line = a.line and m.mon = b.mon and a.flag = b.f2")
def matrix_expand(spark, sf_dir):
    return A.expand(block_matrix(spark, sf_dir), ["flag", "line"], ["flag", "mon"])


@query(f"with {MATRIX} select flag, line, round(sum(m.value * v.value), 6) as value from m join v using (flag, mon) group by all")
def matrix_dot(spark, sf_dir):
    return A.dot(block_matrix(spark, sf_dir), block_vector(spark, sf_dir), ["flag", "line"], ["flag", "mon"]).withColumn("value", r("value"))


@query(f"with {MATRIX}, w as (select line, mon, sum(value) as value from m group by all) select m.flag, w.line, round(sum(m.value * w.value), 4) as value from m join w on m.line = w.line and m.mon = w.mon group by all")
def partial_dot(spark, sf_dir):
    m = block_matrix(spark, sf_dir)
    w = m.groupBy("line", "mon").agg(F.sum("value").alias("value"))
    return A.partial_dot(m, w, ["mon"], ["flag", "line"]).withColumn("value", r("value", 4))


@query(f"with {MATRIX} select flag, line, mon, 0.0::double as zeros, 1.0::double as ones, null::double as empty from m")
def filled_like(spark, sf_dir):
    m = block_matrix(spark, sf_dir)
    keys = ["flag", "line", "mon"]
    parts = [A.filled_like(m, v).withColumnRenamed("value", n) for n, v in (("zeros", 0.0), ("ones", 1.0), ("empty", None))]
    return parts[0].join(parts[1], keys).join(parts[2], keys)


@query(f"with {SAMPLES}, a as (select distinct ri from samples) select ri, (ri - 5) * -0.25 + 218.0 as ra from a")
def axis_metadata(spark, sf_dir):
    g = A.set_axis(samples(spark, sf_dir).select("ri").distinct(), "ri", 218.0, -0.25)
    h = A.copy_axes(g, samples(spark, sf_dir).select("ri").distinct())
    return h.select("ri", A.coordinates(h, "ri", 10).alias("ra"))


@query(f"with {MATRIX} select flag, line, mon, lag(value, 2, 0) over (partition by flag, line order by mon) as value from m")
def roll_zeropad(spark, sf_dir):
    return A.roll_zeropad(block_matrix(spark, sf_dir), ["flag", "line"], "mon", 2)


@query("select r_name, n_name from region, nation")
def cartesian_names(spark, sf_dir):
    return A.cartesian(table(spark, sf_dir, "region").select("r_name"), table(spark, sf_dir, "nation").select("n_name"))


@query("select c_nationkey, count(*) filter (where c_acctbal < 0) as n, count(*) as cells from customer group by c_nationkey having count(*) filter (where c_acctbal < 0) > 0")
def count_where(spark, sf_dir):
    return A.count_where(table(spark, sf_dir, "customer"), ["c_nationkey"], F.col("c_acctbal") < 0)


@query("select c_nationkey, cast(0 as bigint) as n_nan, cast(0 as bigint) as n_inf, count(*) filter (where c_acctbal = 0) as n_zero, count(*) filter (where c_acctbal < 0) as n_negative, round(sum(c_acctbal), 2) as total, min(c_acctbal) as low, max(c_acctbal) as high from customer group by c_nationkey")
def cell_census(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_nationkey", F.col("c_acctbal").alias("value"))
    return A.census(rows, ["c_nationkey"]).withColumn("total", r("total", 2))


@query(f"with {SAMPLES}, shape as (select max(ri) + 1 as nr, max(di) + 1 as nd from samples), cells as (select cast(i as bigint) as ri, cast(j as bigint) as di, nr, nd from shape, generate_series(0, 20) as g(i), generate_series(0, 20) as h(j) where i < nr and j < nd), n as (select ri, di, count(*) as n from samples group by all) select c.ri, c.di, round((c.di - nd // 2) * 0.5 + 2.0, 8) as dec, round((c.ri - nr // 2) * 0.25 / cos(radians((c.di - nd // 2) * 0.5 + 2.0)) + 218.0, 8) as ra, coalesce(n.n, 0) as n from cells c left join n on n.ri = c.ri and n.di = c.di")
def map_pixel_grid(spark, sf_dir):
    """The pixels of a map as large as the samples ask for, with the number of samples in each."""
    s = samples(spark, sf_dir)
    shape = tuple(s.agg(F.max("ri") + 1, F.max("di") + 1).first())
    cells = A.map_grid(spark, (218.0, 2.0), shape, (0.25, 0.5)).select(F.col("ri").cast("long").alias("ri"), F.col("di").cast("long").alias("di"), r("dec", 8).alias("dec"), r("ra", 8).alias("ra"))
    return cells.join(s.groupBy("ri", "di").agg(F.count("*").alias("n")), ["ri", "di"], "left").fillna(0, ["n"])


@query(f"with {SAMPLES} select cast(max(ri) + 1 as integer) as ri_n, cast(max(di) + 1 as integer) as di_n, -0.25::double as ri_delta, 0.5::double as di_delta, round(218.0 - 0.25 * ((max(ri) + 1) // 2), 6) as ri_centre, round(2.0 + 0.5 * ((max(di) + 1) // 2), 6) as di_centre from samples")
def map_parameters(spark, sf_dir):
    g = samples(spark, sf_dir).select("ri", "di", (F.lit(218.0) - 0.25 * F.col("ri")).alias("ra"), (F.lit(2.0) + 0.5 * F.col("di")).alias("dec"))
    out = A.map_parameters(g, {"ri": "ra", "di": "dec"})
    return out.select("ri_n", "di_n", *[r(c).alias(c) for c in ("ri_delta", "di_delta", "ri_centre", "di_centre")])


# Special functions.

_J = {
    0: "sin(x) / x",
    1: "sin(x) / (x * x) - cos(x) / x",
    2: "(3 / (x * x) - 1) * sin(x) / x - 3 * cos(x) / (x * x)",
    3: "(15 / power(x, 3) - 6 / x) * sin(x) / x - (15 / (x * x) - 1) * cos(x) / x",
    4: "(105 / power(x, 4) - 45 / (x * x) + 1) * sin(x) / x - (105 / power(x, 3) - 10 / x) * cos(x) / x",
}


def _j(l: int, x: str = "x") -> str:
    return "(" + _J[l].replace("x", "@").replace("@", x) + ")" if x == "x" else "(" + _J[l].replace("(x * x)", f"({x} * {x})").replace("power(x,", f"power({x},").replace("sin(x)", f"sin({x})").replace("cos(x)", f"cos({x})").replace("/ x", f"/ ({x})") + ")"


@query("select p_partkey, l, round(case l when 0 then {0} when 1 then {1} when 2 then {2} when 3 then {3} else {4} end, 7) as j from (select p_partkey, p_size % 5 as l, 1.5 + p_retailprice / 100 as x from part)".format(*[_j(k) for k in range(5)]))
def spherical_bessel(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") % 5).alias("l"), (1.5 + F.col("p_retailprice") / 100).alias("x"))
    return p.select("p_partkey", "l", r(special.spherical_bessel(F.col("l"), F.col("x")), 7).alias("j"))


@query(f"select p_partkey, round(2 / x * {_j(2)} - {_j(3)}, 7) as slope, round((2 / (x * x) - 1) * {_j(2)} + 2 / x * {_j(3)}, 7) as curvature from (select p_partkey, 1.5 + p_retailprice / 100 as x from part)")
def spherical_bessel_derivatives(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.lit(2).alias("l"), (1.5 + F.col("p_retailprice") / 100).alias("x"))
    args = (F.col("l"), F.col("x"))
    return p.select("p_partkey", r(special.spherical_bessel_slope(*args), 7).alias("slope"), r(special.spherical_bessel_curvature(*args), 7).alias("curvature"))


@query("select p_partkey, round(exp(x) - 1, 6) as chebyshev, round(exp(x) - 1, 6) as romberg, round(power(x, 6) / 6, 6) as patterson from (select p_partkey, p_size / 25.0 as x from part)")
def quadratures(spark, sf_dir):
    x, zero = F.col("p_size") / 25.0, F.lit(0.0)
    cheb, rom, pat = special.chebyshev(F.exp, zero, x)[0], special.romberg(F.exp, zero, x), special.patterson(lambda v: v**5, zero, x)[0]
    return table(spark, sf_dir, "part").select("p_partkey", r(cheb).alias("chebyshev"), r(rom).alias("romberg"), r(pat).alias("patterson"))


@query("""with k as (select l_returnflag as f, l_linenumber as x, avg(l_extendedprice) / 1000 as y from lineitem where l_linenumber in (1, 4, 7) group by all),
s as (select f, max(y) filter (where x = 1) as a, max(y) filter (where x = 4) as b, max(y) filter (where x = 7) as c from k group by f), m as (select *, 6 * ((c - b) / 3 - (b - a) / 3) / 12 as m from s)
select f, p_size, round(case when p < 1 then a + (p - 1) * ((b - a) / 3 - 0.5 * m) when p < 4 then (4 - p) / 3 * a + (p - 1) / 3 * b + (power((p - 1) / 3, 3) - (p - 1) / 3) * m * 1.5 when p <= 7 then (7 - p) / 3 * b + (p - 4) / 3 * c + (power((7 - p) / 3, 3) - (7 - p) / 3) * m * 1.5 else c + (p - 7) * ((c - b) / 3 + 0.5 * m) end, 6) as y
from m, (select distinct p_size, p_size / 5.0 as p from part)""")
def natural_spline(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").where("l_linenumber in (1, 4, 7)")
    knots = li.groupBy(F.col("l_returnflag").alias("f"), F.col("l_linenumber").alias("x")).agg((F.avg("l_extendedprice") / 1000).alias("y"))
    at = table(spark, sf_dir, "part").select("p_size").distinct()
    rows = A.cartesian(special.spline(knots, ["f"], "x", "y"), at)
    return rows.select("f", "p_size", r(special.spline_value(F.col("spline"), F.col("p_size") / 5.0)).alias("y"))


@query("""with k as (select l_returnflag as f, sum(l_quantity) filter (where l_linenumber = 1) as a, sum(l_quantity) filter (where l_linenumber = 2) as b from lineitem group by 1)
select f, p_size, round(exp(ln(a) + (ln(p_size) - ln(1)) * (ln(b) - ln(a)) / (ln(2) - ln(1))), 4) as y from k, (select distinct p_size from part)""")
def log_spline(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").where("l_linenumber in (1, 2)")
    knots = li.groupBy(F.col("l_returnflag").alias("f"), F.col("l_linenumber").alias("x")).agg(F.sum("l_quantity").alias("y"))
    rows = A.cartesian(special.spline(knots, ["f"], "x", "y", log=True), table(spark, sf_dir, "part").select("p_size").distinct())
    return rows.select("f", "p_size", r(special.spline_value(F.col("spline"), F.col("p_size"), log=True), 4).alias("y"))


# Beams.


@query("select p_partkey, round(exp(-r * r / (2 * s * s)) / (2 * pi() * s * s), 8) as beam, round(exp(-s * s * r * r / 2), 8) as transform, round(exp(-r * r / (2 * (s * s + 0.09))) / (2 * pi() * (s * s + 0.09)), 8) as window_, round(case when r = 0 then 1 else sin(r * 0.35) / (r * 0.35) end, 8) as radial, round(case when (0.7 + s) / 2 - r <= 0 then 0 when (0.7 + s) / 2 - r >= least(0.7, s) then 1 / greatest(0.7, s) else ((0.7 + s) / 2 - r) / (0.7 * s) end, 8) as trapezoid from (select p_partkey, p_size / 50.0 as r, 0.2 + p_retailprice / 4000 as s from part)")
def beam_shapes(spark, sf_dir):
    x, s = F.col("p_size") / 50.0, 0.2 + F.col("p_retailprice") / 4000
    named = {"beam": beams.beam_function(x, s), "transform": beams.angular_transform(x, s), "window_": beams.angular_window(x, s, F.lit(0.3)), "radial": beams.radial_transform(x, F.lit(0.7)), "trapezoid": beams.radial_window(x, F.lit(0.7), s)}
    return table(spark, sf_dir, "part").select("p_partkey", *[r(v, 8).alias(k) for k, v in named.items()])


@query("select p_partkey, cast(greatest(1, ceil(4 * (p_size / 50.0) / 2.354820045030949 / 0.05)) as integer) as pixels from part")
def beam_kernel_size(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", beams.kernel_pixels(beams.sigma_of(F.col("p_size") / 50.0), 0.05).alias("pixels"))


_H = ["1", "sqrt(2) * u", "(2 * u * u - 1) / sqrt(2)"]


@query("select p_partkey, " + ", ".join(f"round({h} * exp(-u * u / 2) / sqrt(0.4 * sqrt(pi())), 7) as h{k}" for k, h in enumerate(_H)) + " from (select p_partkey, (p_size / 50.0 - 0.5) / 0.4 as u from part)")
def hermite_basis(spark, sf_dir):
    x = F.col("p_size") / 50.0 - 0.5
    return table(spark, sf_dir, "part").select("p_partkey", *[r(special.hermite_gauss(k, x, F.lit(0.4)), 7).alias(f"h{k}") for k in range(3)])


@query("""with c as (select l_returnflag as f, l_linenumber - 1 as i, cast(month(l_shipdate) as integer) - 1 as j, avg(l_discount) as v from lineitem where l_linenumber <= 3 and month(l_shipdate) <= 3 group by all),
b as (select p, u, unnest([0, 1, 2]) as n, unnest([""" + ", ".join(f"{h} * exp(-u * u / 2) / sqrt(0.4 * sqrt(pi()))" for h in _H) + """]) as b from (select p, (p - 3.5) * 0.25 / 0.4 as u from generate_series(0, 7) as g(p)))
select f, x.p as xi, y.p as yi, round(sum(v * x.b * y.b), 7) as value from c join b x on x.n = c.i join b y on y.n = c.j group by all""")
def beam_on_grid(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").where(F.month("l_shipdate") <= 3).where("l_linenumber <= 3")
    c = li.groupBy(F.col("l_returnflag").alias("f"), (F.col("l_linenumber") - 1).alias("i"), (F.month("l_shipdate") - 1).alias("j")).agg(F.avg("l_discount").alias("value"))
    out = beams.beam_on_grid(c, ["f"], 8, 2.0, 0.4, 3)
    return out.select("f", F.col("xi").cast("long").alias("xi"), F.col("yi").cast("long").alias("yi"), r("value", 7).alias("value"))


# Correlations and angular power; the spectrum is exp(-k).


def decay(k):
    return F.exp(-k)


K = "k as (select (i + 0.5) * 0.02 as k, 0.02 as dk from generate_series(0, 199) as g(i))"


@query("select p_partkey, round(exp(-sqrt(kp * kp + kt * kt)) * (1.5 + 0.5 * kp * kp / (kp * kp + kt * kt)) * (1.0 + 0.6 * kp * kp / (kp * kp + kt * kt)) * 0.8, 8) as power from (select p_partkey, p_size / 20.0 as kp, p_retailprice / 1000 as kt from part)")
def redshift_space_power(spark, sf_dir):
    one = F.lit
    p = angular.kaiser(decay, F.col("p_size") / 20.0, F.col("p_retailprice") / 1000, (1.5, 1.0), (one(0.5), one(0.6)), (one(0.8), one(1.0)))
    return table(spark, sf_dir, "part").select("p_partkey", r(p, 8).alias("power"))


@query(f"with {K}, p as (select distinct p_size as r from part) select r, round(sum(k * k * exp(-k) * sin(k * r) / (k * r) * dk) / (2 * pi() * pi()), 8) as xi from p, k group by r")
def correlation_function(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_size").alias("r")).distinct()
    return angular.correlation(p, "r", angular.k_table(spark, 0.0, 4.0, 200), decay).withColumn("xi", r("xi", 8))


def _term(l: int, w: str, p: str) -> str:
    sign = "-" if l == 2 else ""
    return f"{sign}{w} * {p} * sum(k * k * exp(-k) * {_j(l, '(k * s)')} * dk) / (2 * pi() * pi())"


@query(f"with {K}, p as (select distinct p_size + 2.0 as pi_, p_size % 7 + 3.0 as sigma from part), q as (select pi_, sigma, sqrt(pi_ * pi_ + sigma * sigma) as s, pi_ * pi_ / (pi_ * pi_ + sigma * sigma) as m from p) select pi_ as pi, sigma, round({_term(0, '(1 + 1.0 / 3 + 0.05)', '1')} + {_term(2, '(2.0 / 3 + 1.0 / 7)', '(3 * m - 1) / 2')} + {_term(4, '(2.0 / 35)', '(35 * m * m - 30 * m + 3) / 8')}, 8) as xi from q, k group by pi_, sigma, s, m")
def redshift_space_correlation(spark, sf_dir):
    p = table(spark, sf_dir, "part").select((F.col("p_size") + 2.0).alias("pi"), (F.col("p_size") % 7 + 3.0).alias("sigma")).distinct()
    return angular.redshift_correlation(p, angular.k_table(spark, 0.0, 4.0, 200), decay, 0.5).withColumn("xi", r("xi", 8))


@query(f"with {K}, p as (select distinct p_size % 3 as l, 30.0 + p_size as chi1, 40.0 as chi2 from part) select l, chi1, chi2, round(sum(k * k * exp(-k) * dk * case l " + " ".join(f"when {l} then {_j(l, '(k * chi1)')} * {_j(l, '(k * chi2)')}" for l in range(3)) + " end) * 2 / pi(), 9) as cl from p, k group by all")
def angular_power(spark, sf_dir):
    p = table(spark, sf_dir, "part").select((F.col("p_size") % 3).alias("l"), (F.col("p_size") + 30.0).alias("chi1"), F.lit(40.0).alias("chi2")).distinct()
    return angular.angular_power(p, angular.k_table(spark, 0.0, 4.0, 200), decay).withColumn("cl", r("cl", 9))


@query(f"with {K}, p as (select distinct p_size as l, 100.0 + p_size as chi1, 100.0 as chi2 from part) select l, chi1, chi2, round(sum(exp(-sqrt(k * k + power(l / ((chi1 + chi2) / 2), 2))) * cos(k * (chi1 - chi2)) * dk / (pi() * power((chi1 + chi2) / 2, 2))), 10) as cl from p, k group by all")
def angular_power_flat(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_size").alias("l"), (F.col("p_size") + 100.0).alias("chi1"), F.lit(100.0).alias("chi2")).distinct()
    return angular.angular_power_flat(p, angular.k_table(spark, 0.0, 4.0, 200), decay).withColumn("cl", r("cl", 10))


@query("with k as (select (i + 0.5) * pi() / 32 as k from generate_series(0, 15) as g(i)) select cast(l as integer) as l, cast(lag as integer) as lag, round(sum(exp(-sqrt(k * k + power(l / 80.0, 2))) * cos(k * lag * 2.0) * pi() / 32 / (pi() * 6400)), 10) as cl from k, (select distinct p_size as l from part), generate_series(0, 15) as g(lag) group by l, lag")
def angular_power_lags(spark, sf_dir):
    ls = [x[0] for x in table(spark, sf_dir, "part").select("p_size").distinct().orderBy("p_size").collect()]  # some fifty sizes
    return angular.angular_power_lags(spark, ls, 80.0, 16, 2.0, decay).withColumn("cl", r("cl", 10))


@query(f"with {GRID}, x as (select cast(i as integer) as i, cast(di as integer) as di from generate_series(1, 12) as a(i), generate_series(0, 10) as b(di)) select x.i as xi, 5 as yi, x.di as zi, round(coalesce(g.value, 0), 3) as value, g.value is not null as observed from x left join grid g on g.fi = x.i and g.ri = 5 and g.di = x.di")
def physical_grid_nearest(spark, sf_dir):
    """A plane of cells laid out along the distances of the map's channels, so that the pixel each cell meets is known."""
    c = Cosmology()
    distances, redshifts = angular.distance_table(c, 3.0)
    # Channel i is at 1420.4 / (1 + z) MHz with z = 0.5 + i / 100, which the table takes to its distance.
    plane = spark.range(12 * 11).select((F.col("id") % 12 + 1).cast("int").alias("xi"), F.lit(5).alias("yi"), F.floor(F.col("id") / 12).cast("int").alias("zi"))
    x = interpolate(0.5 + F.col("xi") / 100, redshifts, distances)
    cells = plane.withColumn("x", x).withColumn("y", F.lit(0.0)).withColumn("z", (F.col("zi") - 5) * 0.001 * F.col("x"))
    m = grid(spark, sf_dir).where("ri = 5").withColumn("ri", F.lit(5))
    out = angular.physical_cells_lookup(m, cells, lambda z: (z - 0.5) * 100, c, (0.001, 10, 10))
    return out.withColumn("value", r("value", 3))


# Noise models.

STREAMS = (
    "streams as (select l_returnflag as chan, year(l_shipdate) * 12 + month(l_shipdate) as scan, day(l_shipdate) as t, cast(floor(l_quantity / 5) * 11 + round(l_discount * 100) as bigint) as p, l_extendedprice / 10000 as value, 0.5 + l_tax as var from lineitem), "
    "st as (select chan, scan, count(*) as n, avg(t) as m, var_pop(t) * count(*) as s from streams group by all), "
    "u as (select x.*, 1 / var as w, 1 / sqrt(n) as u0, case when s > 0 then (t - m) / sqrt(s) else 0 end as u1 from streams x join st using (chan, scan)), "
    "g as (select chan, scan, sum(w * u0 * u0) + 1e-4 as a, sum(w * u0 * u1) as b, sum(w * u1 * u1) + 1e-4 as c, sum(w * u0 * value) as m0, sum(w * u1 * value) as m1 from u group by all), "
    "core as (select chan, scan, c / (a * c - b * b) as c00, -b / (a * c - b * b) as c01, a / (a * c - b * b) as c11, m0, m1 from g)"
)


def streams(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    ship = F.col("l_shipdate")
    return li.select(F.col("l_returnflag").alias("chan"), (F.year(ship) * 12 + F.month(ship)).alias("scan"), F.dayofmonth(ship).alias("t"), (F.floor(F.col("l_quantity") / 5) * 11 + F.rint(F.col("l_discount") * 100)).cast("long").alias("p"), (F.col("l_extendedprice") / 10000).alias("value"), (F.col("l_tax") + 0.5).alias("var"))


@query(f"with {STREAMS} select chan, p, round(sum(w * (value - u0 * (c00 * m0 + c01 * m1) - u1 * (c01 * m0 + c11 * m1))), 6) as dirty from u join core using (chan, scan) group by chan, p")
def deweighted_dirty_map(spark, sf_dir):
    dirty, _ = maps.correlated_map(streams(spark, sf_dir), ["chan"])
    return dirty.withColumn("dirty", r("dirty"))


@query(f"""with {STREAMS}, x as (select chan, scan, p, sum(w * u0) as a0, sum(w * u1) as a1 from u group by all),
parts as (select a.chan, a.p, b.p as q, -(a.a0 * (c00 * b.a0 + c01 * b.a1) + a.a1 * (c01 * b.a0 + c11 * b.a1)) as value from x a join x b on a.chan = b.chan and a.scan = b.scan join core on core.chan = a.chan and core.scan = a.scan
union all select chan, p, p, w from u) select chan, p, q, round(sum(value), 6) as value from parts group by all""")
def deweighted_inverse_covariance(spark, sf_dir):
    _, inverse = maps.correlated_map(streams(spark, sf_dir), ["chan"])
    return inverse.withColumn("value", r("value"))


@query(f"with {STREAMS}, f as (select x.*, 1 / var as w, case chan when 'A' then 1.0 when 'N' then 0.5 else 0.25 end as f from streams x), s as (select scan, t, sum(w * f * value) as m, sum(w * f * f) as g from f group by all) select chan, p, round(sum(w * (value - f * m / (g + 1e-4))), 6) as dirty from f join s using (scan, t) group by all")
def deweighted_frequency_mode(spark, sf_dir):
    mode = spark.createDataFrame([("A", 1.0), ("N", 0.5), ("R", 0.25)], "chan string, f double")
    out = noise_model.deweight_frequency(streams(spark, sf_dir), [], mode)
    return out.groupBy("chan", "p").agg(r(F.sum("nd")).alias("dirty"))


@query("select o_orderkey, round(greatest(coalesce(t.var, 1e4), 0.5), 6) as var from orders left join (select o_orderpriority as b, o_orderstatus as pol, avg(o_totalprice) / 1e6 as var from orders where o_orderstatus <> 'P' group by all) t on t.b = o_orderpriority and t.pol = o_orderstatus")
def noise_parameter_lookup(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("b"), F.col("o_orderstatus").alias("pol"), (F.col("o_totalprice") / 1e6).alias("x"))
    known = o.where("pol <> 'P'").groupBy("b", "pol").agg(F.avg("x").alias("var"))
    return noise_model.noise_parameters(o, known, ["b", "pol"], F.lit(0.5)).select("o_orderkey", r("var").alias("var"))


@query(f"with {SPEC}, v as (select chan, var_pop(value) as var, count(value) / 500.0 as norm from spec where value > 2 group by chan) select chan, round(case when norm < 10 / 40.0 then 1e4 else var end, 6) as var from v")
def no_data_variance(spark, sf_dir):
    v = spectra_rows(spark, sf_dir).where("value > 2").groupBy("chan").agg(F.var_pop("value").alias("var"), (F.count("value") / 500.0).alias("norm"))
    return noise_model.no_data_variance(v, "norm", 40).select(F.col("chan").cast("long").alias("chan"), r("var").alias("var"))


@query(f"with {SPEC}, v as (select scan, chan, var_pop(value) as v from spec group by all), c as (select scan, median(v) * 1.2 as cut from v group by scan) select scan, chan, round(case when v <= cut then greatest(v, 1e-10) else 1e4 end, 6) as var from v join c using (scan)")
def bad_channel_variance(spark, sf_dir):
    out = noise_model.bad_channels(spectra_rows(spark, sf_dir), [], 1.2)
    return out.select("scan", F.col("chan").cast("long").alias("chan"), r("var").alias("var")).distinct()


@query(f"with {SAMPLES}, s as (select l_orderkey, l_linenumber, fi, di, l_quantity / 5.0 as x, value from samples), q as (select *, unnest([0, 1]) as k from s), w as (select fi, di, floor(x) + k as ri, 1 - abs(x - floor(x) - k) as w, value from q) select fi, cast(ri as integer) as ri, di, round(sum(w * value), 4) as value from w where w <> 0 group by all")
def pointing_to_map(spark, sf_dir):
    s = samples(spark, sf_dir).select(F.monotonically_increasing_id().alias("id"), "fi", "di", "l_quantity", "value")
    at = noise_model.pointing(s, ["id", "fi", "di", "value"], {"ri": F.col("l_quantity") / 5.0})
    return at.groupBy("fi", "ri", "di").agg(r(F.sum(F.col("weight") * F.col("value")), 4).alias("value"))


@query(f"with {SPEC} select scan, t, chan, round(0.25 * lag(value) over w + 0.5 * value + 0.25 * lead(value) over w, 6) as value from spec window w as (partition by t order by chan)")
def hanning_smooth_rows(spark, sf_dir):
    return ts.hanning(spectra_rows(spark, sf_dir), ["scan", "t"]).select("scan", "t", F.col("chan").cast("long").alias("chan"), r("value").alias("value"))
