"""Queries of maps whose noise joins channels: covariance in tiles, clean map, all eigenvalues. Lineitem's rows of a supplier and year, in order, are a stream that hops through channels."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from skyquilt.operators import eigen, joint_map
from skyquilt.operators.noise_model import NoiseModel
from skyquilt.sources import fits as files

from .catalog import query, r, table

#: Rows of a scan at most.
SCAN_ROWS = 96


def hops(spark, sf_dir, n_chan: int):
    """Samples (scan, chan, t, p, value, var): a stream's rows take the channels in turn; a scan has SCAN_ROWS rows at most."""
    li = table(spark, sf_dir, "lineitem")
    year = F.year("l_shipdate")
    order = Window.partitionBy("l_suppkey", year).orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    k = F.row_number().over(order) - 1
    cell = (F.floor(F.col("l_quantity") / 5) * 11 + F.rint(F.col("l_discount") * 100)).cast("long")
    s = li.select("l_suppkey", year.alias("y"), k.alias("k"), cell.alias("p"), (F.col("l_extendedprice") / 10000).alias("value"), (F.col("l_tax") + 0.5).alias("var"))
    scan = F.col("l_suppkey") * 1000000 + (F.col("y") - 1990) * 10000 + F.floor(F.col("k") / SCAN_ROWS)
    return s.select(scan.cast("long").alias("scan"), (F.col("k") % n_chan).cast("int").alias("chan"), F.floor(F.col("k") % SCAN_ROWS / n_chan).cast("long").alias("t"), "p", "value", "var")


def hops_sql(n_chan: int, mode: str) -> str:
    return f"""hopped as (select l_suppkey * 1000000 + (year(l_shipdate) - 1990) * 10000 as s0, row_number() over (partition by l_suppkey, year(l_shipdate) order by l_shipdate, l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax) - 1 as k,
    cast(floor(l_quantity / 5) * 11 + round(l_discount * 100) as bigint) as p, l_extendedprice / 10000 as value, 1 / (0.5 + l_tax) as w from lineitem),
j as (select s0 + k // {SCAN_ROWS} as scan, k % {n_chan} as chan, k % {SCAN_ROWS} // {n_chan} as t, p, value, w, {mode.format("k % " + str(n_chan))} as f from hopped),
tt as (select scan, t, sum(w * f * f) + 1e-4 as g, sum(w * f * value) as m from j group by all)"""


PRIOR = 0.01
TWO = hops_sql(2, "1.0 - 0.5 * ({})") + f""",
nt as (select scan, count(*) as n from tt group by scan),
a as (select j.scan, j.chan, j.p, o.chan as k, o.p as q, case when j.chan = o.chan then j.w else 0 end - j.w * j.f * o.w * o.f / tt.g as a from j join j o on o.scan = j.scan and o.t = j.t join tt on tt.scan = j.scan and tt.t = j.t),
g as (select scan, coalesce(sum(a) filter (chan = 0 and k = 0), 0) / n + 1e-4 as g00, coalesce(sum(a) filter (chan = 0 and k = 1), 0) / n as g01, coalesce(sum(a) filter (chan = 1 and k = 1), 0) / n + 1e-4 as g11 from a join nt using (scan) group by scan, n),
x as (select scan, chan, p, coalesce(sum(a) filter (k = 0), 0) / sqrt(n) as x0, coalesce(sum(a) filter (k = 1), 0) / sqrt(n) as x1 from a join nt using (scan) group by scan, chan, p, n),
parts as (select chan, p, k as chan2, q as p2, a as value from a
    union all select x.chan, x.p, y.chan, y.p, -(x.x0 * (g11 * y.x0 - g01 * y.x1) + x.x1 * (g00 * y.x1 - g01 * y.x0)) / (g00 * g11 - g01 * g01) from x join x y on y.scan = x.scan join g on g.scan = x.scan
    union all select distinct chan, p, chan, p, {PRIOR} from j),
entries as (select chan, p, chan2, p2, sum(value) as value from parts group by all)"""


def two_channels(spark, sf_dir, stage, side: int):
    """Tiles of the two-channel map's inverse covariance: an unknown mean of each channel in a scan, and a mode (1, 1/2) of unknown amplitude at every time."""
    samples = stage(hops(spark, sf_dir, 2))
    model = NoiseModel(time_modes=1, frequency_modes=[([1.0, 0.5], None)])
    rows = stage(joint_map.unknowns(samples))
    n = rows.count()
    factors = stage(joint_map.scan_factors(joint_map.pointed(samples, rows), model, 2, side))
    return rows, n, joint_map.inverse_noise(stage, factors, n, side, PRIOR)


@query(f"with {TWO} select cast(chan as integer) as chan, p, cast(chan2 as integer) as chan2, p2, round(value, 4) as value from entries")
def joint_inverse_covariance(spark, sf_dir):
    side = 64
    rows, n, tiles = two_channels(spark, sf_dir, files.stager(spark, "joint"), side)
    e = joint_map.tile_entries(tiles, n, side)
    left = rows.select("row", "chan", "p")
    right = rows.select(F.col("row").alias("col"), F.col("chan").alias("chan2"), F.col("p").alias("p2"))
    return e.join(left, "row").join(right, "col").select("chan", "p", "chan2", "p2", r("value", 4).alias("value"))


@query(f"with {hops_sql(12, '1.0 / (1 + {})')} select cast(chan as integer) as chan, p, round(sum(w * (value - f * m / g)), 4) as dirty, round(sum(w * (value - f * m / g)), 4) as back, true as noise from j join tt using (scan, t) group by chan, p")
def joint_clean_map(spark, sf_dir):
    """Clean map of twelve channels, over a thousand cells, with a mode of unknown amplitude at every time; ``back`` takes it through the noise of every sample and back to the map, which gives the dirty map."""
    stage = files.stager(spark, "clean")
    samples = stage(hops(spark, sf_dir, 12))
    mode = [1.0 / (1 + c) for c in range(12)]
    out = stage(joint_map.joint_map(stage, samples, NoiseModel(time_modes=0, frequency_modes=[(mode, None)]), 12, side=256, prior=PRIOR))
    f = F.lit(1.0) / (F.col("chan") + 1)
    seen = samples.select("scan", "t", "chan", "p", (1 / F.col("var")).alias("w"), f.alias("f")).join(out.select("chan", "p", F.col("value").alias("x")), ["chan", "p"])
    at = seen.groupBy("scan", "t").agg((F.sum(F.col("w") * F.col("f") ** 2) + 1e-4).alias("g"), F.sum(F.col("w") * F.col("f") * F.col("x")).alias("m"))
    back = seen.join(at, ["scan", "t"]).groupBy("chan", "p").agg(F.sum(F.col("w") * (F.col("x") - F.col("f") * F.col("m") / F.col("g"))).alias("back"))
    out = out.join(back, ["chan", "p"]).withColumn("back", F.col("back") + PRIOR * F.col("value"))
    # A cell's variance lies between those of its own data alone and of no data.
    alone = seen.groupBy("chan", "p").agg((1 / (F.sum("w") + PRIOR)).alias("least"))
    return out.join(alone, ["chan", "p"]).select("chan", "p", r("dirty", 4).alias("dirty"), r("back", 4).alias("back"), ((F.col("noise") >= F.col("least") * (1 - 1e-9)) & (F.col("noise") <= 1 / PRIOR * (1 + 1e-9))).alias("noise"))


@query(f"with {TWO} select count(*) filter (chan = chan2 and p = p2) as n, round(sum(value) filter (chan = chan2 and p = p2), 2) as trace, round(sqrt(sum(value * value)), 3) as norm, 0.0::double as residual, 0.0::double as skew from entries")
def tile_eigenvalues(spark, sf_dir):
    """All eigenvalues of the two-channel map's inverse covariance: their sum and norm, the largest entry of A v - v e and of V' V - 1."""
    side, stage = 64, files.stager(spark, "eigen")
    _, n, tiles = two_channels(spark, sf_dir, stage, side)
    rotated = eigen.eigen(stage, tiles, -(-n // side), side)
    values = stage(eigen.eigenvalues(rotated, side))
    v = stage(eigen.eigenvectors(rotated, side))
    # The rows that fill up the last tile are eigenvectors of their own, with the eigenvalue 1.
    fill = (-n) % side
    sums = values.agg(F.sum("eigenvalue").alias("s"), F.sum(F.col("eigenvalue") ** 2).alias("q"))
    a = joint_map.tile_entries(tiles, n, side)
    av = a.join(v.withColumnsRenamed({"row": "col", "value": "x"}), "col").groupBy("row", "column").agg(F.sum(F.col("value") * F.col("x")).alias("ax"))
    left = av.join(v, ["row", "column"]).join(values, "column").agg(F.max(F.abs(F.col("ax") - F.col("value") * F.col("eigenvalue"))).alias("residual"))
    vv = v.join(v.withColumnsRenamed({"column": "other", "value": "x"}), "row").groupBy("column", "other").agg(F.sum(F.col("value") * F.col("x")).alias("s"))
    skew = vv.agg(F.max(F.abs(F.col("s") - F.when(F.col("column") == F.col("other"), 1.0).otherwise(0.0))).alias("skew"))
    out = sums.crossJoin(left).crossJoin(skew)
    return out.select(F.lit(n).cast("long").alias("n"), F.round(F.col("s") - fill, 2).alias("trace"), F.round(F.sqrt(F.col("q") - fill), 3).alias("norm"), r("residual", 6).alias("residual"), r("skew", 8).alias("skew"))


@query(f"with {TWO} select cast(chan as integer) as chan, p, round(value, 4) as value from entries where chan = chan2 and p = p2")
def eigen_rebuilt_diagonal(spark, sf_dir):
    """The matrix's diagonal from its eigenvalues and vectors: sums of e v^2."""
    side, stage = 64, files.stager(spark, "rebuilt")
    rows, n, tiles = two_channels(spark, sf_dir, stage, side)
    rotated = eigen.eigen(stage, tiles, -(-n // side), side)
    back = eigen.eigenvectors(rotated, side).join(eigen.eigenvalues(rotated, side), "column").groupBy("row").agg(F.sum(F.col("value") ** 2 * F.col("eigenvalue")).alias("value"))
    return rows.join(back, "row").select("chan", "p", r("value", 4).alias("value"))
