"""Named-axis arrays as tables: axes are key columns and ``value`` is the entry. A matrix has row and column axes; an axis of both is block diagonal.

Axes keep their centre and spacing as metadata of their column, so they go along with selections and joins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Axes = list[str]
#: Cells that a dense copy or a product of key lists may have.
MOST_CELLS = 50_000_000


def set_axis(df: DataFrame, name: str, centre: float, delta: float) -> DataFrame:
    """The table with centre (at index n // 2) and spacing of an axis."""
    return df.withMetadata(name, df.schema[name].metadata | {"centre": float(centre), "delta": float(delta)})


def axis_info(df: DataFrame, name: str) -> tuple[float, float]:
    m = df.schema[name].metadata
    return m["centre"], m["delta"]


def copy_axes(source: DataFrame, target: DataFrame) -> DataFrame:
    """Centres and spacings of the axes that both tables have."""
    for name in set(source.columns) & set(target.columns):
        if "centre" in source.schema[name].metadata:
            target = set_axis(target, name, *axis_info(source, name))
    return target


def coordinates(df: DataFrame, name: str, n: int) -> Column:
    """Coordinate of an axis's index, from its metadata."""
    centre, delta = axis_info(df, name)
    return (F.col(name) - n // 2) * F.lit(delta) + F.lit(centre)


def vector(arrays: DataFrame, array: str, keys: Axes, shape: dict[str, int]) -> DataFrame:
    """Flat arrays to rows: the place in the array becomes an index on each axis of ``shape``, the last one fastest."""
    rows = arrays.select(*keys, F.posexplode(array).alias("_i", "value"))
    step, out = 1, {}
    for axis, n in reversed(shape.items()):
        out[axis] = F.pmod(F.floor(F.col("_i") / step), F.lit(n)).cast("int")
        step *= n
    return rows.select(*keys, *[out[a].alias(a) for a in shape], "value")


def flat_index(shape: dict[str, int]) -> Column:
    """Place of a cell in the flat array; the inverse of ``vector``."""
    return reduce(lambda acc, an: acc * an[1] + F.col(an[0]), shape.items(), F.lit(0)).cast("long")


def check_axes(rows: Axes, cols: Axes) -> int:
    """Number of block-diagonal axes; they must lead in both lists and in the same order."""
    shared = [a for a in rows if a in cols]
    if rows[: len(shared)] != shared or cols[: len(shared)] != shared:
        raise ValueError("block-diagonal axes must lead, in the same order")
    return len(shared)


def matrix_shape(m: DataFrame, rows: Axes, cols: Axes) -> DataFrame:
    """One row: rows and columns of the whole matrix."""
    return m.agg(F.count_distinct(F.struct(*rows)).alias("n_rows"), F.count_distinct(F.struct(*cols)).alias("n_cols"))


def block_shapes(m: DataFrame, rows: Axes, cols: Axes) -> DataFrame:
    """Rows and columns of every diagonal block."""
    shared = rows[: check_axes(rows, cols)]
    own = lambda axes: F.struct(*([a for a in axes if a not in shared] or shared))
    return m.groupBy(*shared).agg(F.count_distinct(own(rows)).alias("n_rows"), F.count_distinct(own(cols)).alias("n_cols"))


def row_keys(m: DataFrame, rows: Axes) -> DataFrame:
    return m.select(*rows).distinct()


def diagonal(m: DataFrame, pairs: dict[str, str]) -> DataFrame:
    """Entries whose row and column axes agree; ``pairs`` names the column axis of each row axis that is not shared."""
    return m.where(reduce(lambda a, b: a & b, (F.col(r) == F.col(c) for r, c in pairs.items()))).drop(*pairs.values())


def upper_triangle(m: DataFrame, row: str, col: str) -> DataFrame:
    """Entries on and above the diagonal; on a table of tiles the predicate reaches the scan."""
    return m.where(F.col(col) >= F.col(row))


def transpose(m: DataFrame, pairs: dict[str, str]) -> DataFrame:
    swap = pairs | {c: r for r, c in pairs.items()}
    return m.select(*[F.col(c).alias(swap.get(c, c)) for c in m.columns])


def index_axis(m: DataFrame, axis: str, index: int) -> DataFrame:
    """One index of an axis; the axis goes."""
    return m.where(F.col(axis) == index).drop(axis)


def cartesian(*lists: DataFrame) -> DataFrame:
    """All combinations of short lists; the size is checked."""
    total = 1
    for x in lists:
        total *= x.count()
    if total > MOST_CELLS:
        raise ValueError(f"{total} combinations are too many")
    return reduce(lambda a, b: a.crossJoin(F.broadcast(b)), lists)


def expand(m: DataFrame, rows: Axes, cols: Axes) -> DataFrame:
    """The whole matrix with its zeros, also between blocks; ``row_`` and ``col_`` name the keys."""
    name = lambda side, axes: row_keys(m, axes).select(*[F.col(a).alias(f"{side}_{a}") for a in axes])
    entries = m.select(*[F.col(a).alias(f"row_{a}") for a in rows], *[F.col(a).alias(f"col_{a}") for a in cols], "value")
    keys = [f"row_{a}" for a in rows] + [f"col_{a}" for a in cols]
    return cartesian(name("row", rows), name("col", cols)).join(entries, keys, "left").withColumn("value", F.coalesce("value", F.lit(0.0)))


def partial_dot(left: DataFrame, right: DataFrame, over: Axes, keep: Axes) -> DataFrame:
    """Sum over the axes ``over`` of products of entries; ``keep`` are the axes that remain. An axis of both sides that is kept is block diagonal."""
    both = [a for a in keep if a in left.columns and a in right.columns]
    r = right.select(*over, *[a for a in right.columns if a not in over and a != "value"], F.col("value").alias("_r"))
    return left.join(r, [*over, *both]).groupBy(*keep).agg(F.sum(F.col("value") * F.col("_r")).alias("value"))


def dot(m: DataFrame, v: DataFrame, rows: Axes, cols: Axes) -> DataFrame:
    """Matrix times vector; rows without an entry are not there."""
    missing = [a for a in cols if a not in v.columns]
    if missing:
        raise ValueError(f"the vector lacks axes {missing}")
    inner = [a for a in cols if a not in rows]
    shared = [a for a in cols if a in rows]
    r = v.select(*inner, *shared, F.col("value").alias("_v"))
    return m.join(r, [*inner, *shared]).groupBy(*rows).agg(F.sum(F.col("value") * F.col("_v")).alias("value"))


def filled_like(m: DataFrame, value: float | None) -> DataFrame:
    """The same keys with another value: zeros, ones, or null for nothing yet."""
    return m.withColumn("value", F.lit(value).cast("double"))


def roll_zeropad(rows: DataFrame, keys: Axes, axis: str, shift: int) -> DataFrame:
    """Values moved along an axis, 0 where they came from."""
    w = Window.partitionBy(*keys).orderBy(axis)
    moved = F.lag("value", shift, 0.0) if shift >= 0 else F.lead("value", -shift, 0.0)
    return rows.withColumn("value", moved.over(w))


def count_where(rows: DataFrame, axes: Axes, test: Column, every: bool = False) -> DataFrame:
    """Slices with the number of cells that meet a test; with ``every`` only slices all of whose cells do."""
    out = rows.groupBy(*axes).agg(F.count_if(test).alias("n"), F.count("*").alias("cells"))
    return out.where("n = cells" if every else "n > 0")


def census(rows: DataFrame, axes: Axes) -> DataFrame:
    """Numbers of null or NaN, infinite, zero and negative cells of each slice, with sum, least and greatest of the others."""
    v = F.col("value")
    bad, infinite = v.isNull() | F.isnan(v), F.abs(v) == float("inf")
    ok = F.when(~bad & ~infinite, v)
    return rows.groupBy(*axes).agg(F.count_if(bad).alias("n_nan"), F.count_if(infinite).alias("n_inf"), F.count_if(v == 0).alias("n_zero"), F.count_if(v < 0).alias("n_negative"), F.sum(ok).alias("total"), F.min(ok).alias("low"), F.max(ok).alias("high"))


def map_grid(spark, centre: tuple[float, float], shape: tuple[int, int], spacing: tuple[float, float]) -> DataFrame:
    """Pixel centres of a map: right ascension is spread by the cosine of declination."""
    n, m = shape
    cell = spark.range(n * m).select(F.floor(F.col("id") / m).cast("int").alias("ri"), (F.col("id") % m).cast("int").alias("di"))
    dec = (F.col("di") - m // 2) * spacing[1] + centre[1]
    return cell.withColumn("dec", dec).withColumn("ra", (F.col("ri") - n // 2) * spacing[0] / F.cos(F.radians("dec")) + centre[0])


def map_parameters(cells: DataFrame, axes: dict[str, str]) -> DataFrame:
    """Centre, number and spacing of each axis (index column -> coordinate column) of a map."""
    out = []
    for index, coord in axes.items():
        n, delta = F.max(index) + 1, F.try_divide(F.max_by(coord, index) - F.min_by(coord, index), F.max(index) - F.min(index))
        out += [n.cast("int").alias(f"{index}_n"), delta.alias(f"{index}_delta"), (F.min_by(coord, index) + (F.floor(n / 2) - F.min(index)) * delta).alias(f"{index}_centre")]
    return cells.agg(*out)


def suggested_edges(cells: DataFrame, radius: str, n: int, log: bool = True) -> list[float]:
    """Edges from the second smallest radius to the greatest; two numbers reach the driver."""
    low = cells.agg(F.min(radius)).first()[0]
    second, high = cells.where(F.col(radius) > low).agg(F.min(radius), F.max(radius)).first()
    if log:
        return [second * (high / second) ** (k / n) for k in range(n + 1)]
    return [second + (high - second) * k / n for k in range(n + 1)]


def edge_table(cells: DataFrame, radius: str, n: int, log: bool = True) -> DataFrame:
    """(k, edge): the same edges as a table, without anything on the driver."""
    low = cells.agg(F.min(radius).alias("_low"))
    ends = cells.crossJoin(F.broadcast(low)).where(F.col(radius) > F.col("_low")).agg(F.min(radius).alias("_a"), F.max(radius).alias("_b"))
    k = ends.select("_a", "_b", F.explode(F.sequence(F.lit(0), F.lit(n))).alias("k"))
    edge = F.col("_a") * F.pow(F.col("_b") / F.col("_a"), F.col("k") / n) if log else F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("k") / n
    return k.select("k", edge.alias("edge"))
