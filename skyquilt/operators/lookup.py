"""Joins: samples with maps and tables by nearest, interpolated, bracketed or ranged positions."""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyquilt.functions.columns import keys_weight

#: Rows up to which a lookup table is sent to all tasks; a larger one is joined by exchange.
SMALL_ROWS = 200_000


def small(table: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """``table`` with a broadcast hint if it is checked to have no more than ``rows`` rows."""
    return F.broadcast(table) if table.limit(rows + 1).count() <= rows else table


def neighbours(position: dict[str, Column], kind: str) -> list[tuple[dict[str, Column], Column]]:
    """Pixel of each axis and weight of 1, 2^n or 4^n neighbours of a fractional pixel position."""
    if kind == "nearest":
        return [({a: F.rint(p).cast("int") for a, p in position.items()}, F.lit(1.0))]
    steps = (0, 1) if kind == "linear" else (-1, 0, 1, 2)
    out = []
    for shift in product(steps, repeat=len(position)):
        weight = F.lit(1.0)
        for k, p in zip(shift, position.values()):
            s = p - (F.floor(p) + k)
            weight = weight * (1 - F.abs(s) if kind == "linear" else keys_weight(s))
        out.append(({a: (F.floor(p) + k).cast("int") for k, (a, p) in zip(shift, position.items())}, weight))
    return out


def stencil(position: dict[str, Column], kind: str) -> Column:
    """Array of (pixel of each axis, weight) of ``neighbours``."""
    return F.array(*[F.struct(*[c.alias(a) for a, c in at.items()], w.alias("weight")) for at, w in neighbours(position, kind)])


#: Pixels up to which a map is sent to all tasks, and those of them that a sample may have to choose from.
SMALL_MAP, SMALL_ROW = 50_000, 64


def is_small_map(grid: DataFrame, also: list[str]) -> bool:
    """Whether a map fits ``at_small_map``; its pixels are counted by the columns that samples and map share."""
    n = grid.groupBy(*also).count().agg(F.sum("count"), F.max("count")).first()
    return (n[0] or 0) <= SMALL_MAP and (n[1] or 0) <= SMALL_ROW


def at_small_map(samples: DataFrame, grid: DataFrame, position: dict[str, Column], kind: str, also: list[str]) -> DataFrame:
    """Samples with ``map_value`` and ``_touched``, whether a pixel has weight. Neither samples nor their neighbours are exchanged, sorted or grouped."""
    pixel = F.struct(*[F.col(a).cast("int").alias(a) for a in position])
    pixels = grid.groupBy(*also).agg(F.map_from_entries(F.collect_list(F.struct(pixel, F.col("value").cast("double")))).alias("_map"))
    joined = samples.join(F.broadcast(pixels), also, "left") if also else samples.crossJoin(F.broadcast(pixels))
    total, touched = F.lit(0.0), F.lit(False)
    for at, weight in neighbours(position, kind):
        # A pixel that is missing or masked makes the sum null if it has weight.
        value = F.try_element_at(F.col("_map"), F.struct(*[c.alias(a) for a, c in at.items()]))
        has = F.coalesce(weight != 0, F.lit(False))
        total = total + F.when(has, weight * value).otherwise(0.0)
        touched = touched | has
    return joined.withColumns({"map_value": F.when(touched, total), "_touched": touched}).select(*samples.columns, "map_value", "_touched")


def lookup_map(samples: DataFrame, grid: DataFrame, keys: list[str], position: dict[str, Column], kind: str = "nearest", also: list[str] | None = None) -> DataFrame:
    """Value of the map at each sample; null where a pixel with weight is missing or masked.

    ``keys`` identify a sample; ``also`` are columns that sample and map share, such as the channel.
    """
    also = also or []
    if is_small_map(grid, also):
        return at_small_map(samples, grid, position, kind, also).where("_touched").select(*keys, "map_value")
    spread = samples.select(*keys, *[c for c in also if c not in keys], F.explode(stencil(position, kind)).alias("s")).select("*", "s.*").drop("s").where("weight <> 0")
    joined = spread.join(grid.select(*also, *position, F.col("value").alias("_v")), [*also, *position], "left")
    return joined.groupBy(*keys).agg(F.when(F.count("_v") == F.count("*"), F.sum(F.col("weight") * F.col("_v"))).alias("map_value"))


def subtract_map(samples: DataFrame, grid: DataFrame, keys: list[str], position: dict[str, Column], kind: str = "nearest", also: list[str] | None = None) -> DataFrame:
    """Samples less the map; those that the map does not cover are masked."""
    if is_small_map(grid, also or []):
        return at_small_map(samples, grid, position, kind, also or []).withColumn("value", F.col("value") - F.col("map_value")).drop("map_value", "_touched")
    return samples.join(lookup_map(samples, grid, keys, position, kind, also), keys, "left").withColumn("value", F.col("value") - F.col("map_value")).drop("map_value")


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], t: str, value: str) -> DataFrame:
    """The last right value at or before each left time: both sides in one ordered window, no pair of rows is formed."""
    both = left.select(*keys, t, F.struct(*left.columns).alias("row"), F.lit(None).cast(right.schema[value].dataType).alias("_v"), F.lit(1).alias("_side"))
    both = both.unionByName(right.select(*keys, t, F.lit(None).cast(both.schema["row"].dataType).alias("row"), F.col(value).alias("_v"), F.lit(0).alias("_side")))
    w = Window.partitionBy(*keys).orderBy(t, "_side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last("_v", ignorenulls=True).over(w)).where("_side = 1").select("row.*", value)


def bracket_interpolate(left: DataFrame, right: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Linear interpolation of right (x, y) at each left x; null outside. One ordered window over both sides."""
    both = left.select(*keys, x, F.struct(*left.columns).alias("row"), F.lit(None).cast("struct<x:double,y:double>").alias("_p"), F.lit(1).alias("_side"))
    point = F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    both = both.unionByName(right.select(*keys, x, F.lit(None).cast(both.schema["row"].dataType).alias("row"), point.alias("_p"), F.lit(0).alias("_side")))
    # A right point at the same x counts before and after.
    w = Window.partitionBy(*keys).orderBy(x)
    low = F.last("_p", ignorenulls=True).over(w.rangeBetween(Window.unboundedPreceding, 0))
    high = F.first("_p", ignorenulls=True).over(w.rangeBetween(0, Window.unboundedFollowing))
    out = both.withColumn("_a", low).withColumn("_b", high).where("_side = 1")
    slope = F.try_divide(F.col("_b.y") - F.col("_a.y"), F.col("_b.x") - F.col("_a.x"))
    value = F.when(F.col("_a.x") == F.col("_b.x"), F.col("_a.y")).otherwise(F.col("_a.y") + slope * (F.col(x) - F.col("_a.x")))
    return out.select("row.*", value.alias(y))


def range_average(left: DataFrame, right: DataFrame, key: str, x: str, y: str, width: float) -> DataFrame:
    """Mean of right y within half a width of each left x. Right rows of one x are summed first; sums meet left rows by bucket, so no range is compared across the table."""
    bucket = lambda c: F.floor(c / width).cast("long")
    sums = right.where(F.col(y).isNotNull()).groupBy(F.col(x).alias("_x")).agg(F.sum(y).alias("_y"), F.count(y).alias("_n"))
    r = sums.select("*", F.explode(F.array(*[bucket(F.col("_x")) + k for k in (-1, 0, 1)])).alias("_b"))
    pairs = left.withColumn("_b", bucket(F.col(x))).join(r, "_b", "left").where(F.abs(F.col("_x") - F.col(x)) <= width / 2)
    mean = pairs.groupBy(key).agg(F.try_divide(F.sum("_y"), F.sum("_n")).alias(y))
    return left.join(mean, key, "left")


def interval_join(points: DataFrame, intervals: DataFrame, x: str, low: str, high: str, width: float) -> DataFrame:
    """Points with the intervals [low, high] that hold them; an interval is dealt to every bucket that it touches."""
    parts = intervals.withColumn("_b", F.explode(F.sequence(F.floor(F.col(low) / width).cast("long"), F.floor(F.col(high) / width).cast("long"))))
    return points.withColumn("_b", F.floor(F.col(x) / width).cast("long")).join(parts, "_b").where((F.col(x) >= F.col(low)) & (F.col(x) <= F.col(high))).drop("_b")


def close_match(left: DataFrame, right: DataFrame, x: str, atol: float, rtol: float = 0.0, largest: float = 1.0) -> DataFrame:
    """Rows whose x agree within atol + rtol * |right|, by buckets as wide as the tolerance can be."""
    width = atol + rtol * largest
    r = right.withColumn("_b", F.explode(F.array(*[F.floor(F.col(x) / width).cast("long") + k for k in (-1, 0, 1)])))
    r = r.select("_b", *[F.col(c).alias(f"{c}_right") for c in right.columns])
    return left.withColumn("_b", F.floor(F.col(x) / width).cast("long")).join(r, "_b").where(F.abs(F.col(x) - F.col(f"{x}_right")) <= atol + rtol * F.abs(F.col(f"{x}_right"))).drop("_b")


def unordered_pairs(tags: DataFrame, name: str) -> DataFrame:
    """Every pair of distinct tags once. Tags are a short list of file sections; their number is checked."""
    n = tags.count()
    if n > 10_000:
        raise ValueError("pairs of so many tags are not meant")
    a, b = tags.select(F.col(name).alias("left")), tags.select(F.col(name).alias("right"))
    return a.join(F.broadcast(b), F.col("left") < F.col("right"))


def cross_names(tags: DataFrame, name: str, word: str = "_with_") -> DataFrame:
    """Names of both directions of every pair."""
    p = unordered_pairs(tags, name)
    return p.select(F.concat("left", F.lit(word), "right").alias("forward"), F.concat("right", F.lit(word), "left").alias("backward"))


def pair_catalogs(maps: DataFrame, weights: DataFrame, tag: str) -> DataFrame:
    """Pairs of maps with their weights: map and weight paths of both tags."""
    full = maps.join(weights, tag)
    p = unordered_pairs(full.select(tag).distinct(), tag)
    side = lambda s: full.select(*[F.col(c).alias(f"{c}_{s}" if c != tag else s) for c in full.columns])
    return p.join(side("left"), "left").join(side("right"), "right")


def incremental(requested: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What has not been processed yet."""
    return requested.join(done, keys, "left_anti")


def floor_at_radiometer(params: DataFrame, name: str, limit: Column) -> DataFrame:
    """Noise parameters, no lower than the radiometer limit."""
    return params.withColumn(name, F.greatest(F.col(name), limit))


def redraw_by_cdf(rows: DataFrame, cdf: DataFrame, key: str, draw: Column, steps: int = 1000) -> DataFrame:
    """A value for each row by the inverse of its class's cumulative table (key, cum, value), linear between its points.

    ``draw`` is a number in [0, 1) computed from the row, so a retried task draws the same.
    """
    w = Window.partitionBy(key).orderBy("cum")
    seg = cdf.select(key, F.coalesce(F.lag("cum").over(w), F.lit(0.0)).alias("c0"), F.col("cum").alias("c1"), F.coalesce(F.lag("value").over(w), F.col("value")).alias("v0"), F.col("value").alias("v1")).where("c1 > c0")
    seg = seg.withColumn("_b", F.explode(F.sequence(F.floor(F.col("c0") * steps).cast("int"), F.floor(F.col("c1") * steps).cast("int"))))
    at = rows.withColumn("_u", draw).withColumn("_b", F.floor(F.col("_u") * steps).cast("int"))
    out = at.join(small(seg), [key, "_b"]).where("_u >= c0 and _u < c1")
    return out.withColumn("drawn", F.col("v0") + (F.col("v1") - F.col("v0")) * (F.col("_u") - F.col("c0")) / (F.col("c1") - F.col("c0"))).drop("_b", "_u", "c0", "c1", "v0", "v1")


def mueller(samples: DataFrame, table: DataFrame, keys: list[str], chan: str = "chan") -> DataFrame:
    """Applies each channel's 4 by 4 matrix (chan, m array of 4 arrays) to the samples' polarisation vector ``pols``."""
    row = lambda r: F.aggregate(F.zip_with(r, "pols", lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)
    return samples.join(small(table), chan).withColumn("pols", F.transform("m", row)).drop("m")


def piecewise(x: Column, xs: list[float], ys: list[float], outside: float) -> Column:
    from skyquilt.functions.cosmology import interpolate

    return interpolate(x, xs, ys, outside)


def differential_gain(rows: DataFrame, gains: DataFrame, keys: list[str]) -> DataFrame:
    """XX and YY times their gains (keys, gx, gy), the cross terms times the root of their product; null where a gain is missing or not positive."""
    gx, gy = F.when(F.col("gx") > 0, F.col("gx")), F.when(F.col("gy") > 0, F.col("gy"))
    by = F.when(F.col("pol") == "XX", gx).when(F.col("pol") == "YY", gy).when(F.col("pol").isin("XY", "YX"), F.sqrt(gx * gy))
    return rows.join(small(gains), keys, "left").withColumn("value", F.col("value") * by).drop("gx", "gy")


#: Table places that a cell of the finest grid of ``nearest_on_sky`` holds, unless cells would be narrower than its last level.
CELL_PLACES = 16
#: Grids of ``nearest_on_sky``; each one's cells are a quarter as wide as those of the one before.
SKY_LEVELS = 7


def nearest_on_sky(stage: Callable[[DataFrame], DataFrame], points: DataFrame, table: DataFrame, value: str, within: float) -> DataFrame:
    """The ``value`` of the nearest table row (ra, dec in degrees) within an angle of each point; null without one.

    Of rows equally near, that with the smallest ra, then dec, counts, and of rows at one place the smallest value.
    Both sides are brought to distinct places first. Places meet by cubic cells about the directions' unit vectors,
    which have no poles: a point looks into its own cell and those next to it. It begins in the finest grid; one that
    finds nothing as near as a cell is wide goes on to cells four times as wide, the last as wide as the angle.
    """
    widest = 2 * math.sin(math.radians(within) / 2) * (1 + 1e-9)
    place = ["ra", "dec"]
    finite = (F.abs("ra") < float("inf")) & (F.abs("dec") < float("inf"))
    a, b = F.radians("dec"), F.radians("_dec")
    cosine = F.sin(a) * F.sin(b) + F.cos(a) * F.cos(b) * F.cos(F.radians(F.col("ra") - F.col("_ra")))
    angle = F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))))

    def cell(width: Column | float, ra: Column, dec: Column) -> list[Column]:
        d, r = F.radians(dec), F.radians(ra)
        return [F.floor(x / width).cast("long") for x in (F.cos(d) * F.cos(r), F.cos(d) * F.sin(r), F.sin(d))]

    rows = stage(table.where(finite).groupBy(F.col("ra").alias("_ra"), F.col("dec").alias("_dec")).agg(F.min(value).alias(value)))
    open_ = stage(points.select(*place).where(finite).distinct())
    width = F.lit(widest) / F.pow(F.lit(4.0), F.col("_level"))
    levels = rows.select("_ra", "_dec", F.explode(F.sequence(F.lit(0), F.lit(SKY_LEVELS - 1))).alias("_level"))
    full = levels.groupBy("_level", *[c.alias(f"_{k}") for k, c in enumerate(cell(width, F.col("_ra"), F.col("_dec")))]).count().groupBy("_level").agg(F.max("count").alias("n")).collect()
    found = []
    for level in range(min([x["_level"] for x in full if x["n"] <= CELL_PLACES], default=SKY_LEVELS - 1), -1, -1):
        wide = widest / 4**level
        t = rows.select("*", F.array(*cell(wide, F.col("_ra"), F.col("_dec"))).alias("_cell"))
        shifts = [[F.lit(x) for x in shift] for shift in product((-1, 0, 1), repeat=3)]
        near = F.array(*[F.array(*[c + k for c, k in zip(cell(wide, F.col("ra"), F.col("dec")), shift)]) for shift in shifts])
        met = open_.select(*place, F.explode(near).alias("_cell")).join(t, "_cell").withColumn("_a", angle).where(F.col("_a") <= within)
        best = met.groupBy(*place).agg(F.min(F.struct("_a", "_ra", "_dec", value)).alias("_best"))
        # Angles from their cosines are good to some 1e-6 degrees.
        sure = math.degrees(2 * math.asin(wide / 2)) - 1e-5 if level else within
        done = stage(best.where(F.col("_best._a") <= sure).select(*place, F.col(f"_best.{value}").alias(value)))
        found.append(done)
        if level:
            open_ = stage(open_.join(done, place, "left_anti"))
            if open_.isEmpty():
                break
    every = found[0]
    for part in found[1:]:
        every = every.unionByName(part)
    return points.join(small(every), place, "left").select(*points.columns, value)


def restore_fields(processed: DataFrame, raw: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Processed samples with fields of their raw ones; samples must be there on both sides."""
    return processed.drop(*fields).join(raw.select(*keys, *fields), keys)
