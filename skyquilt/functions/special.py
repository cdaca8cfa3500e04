"""Spherical Bessel functions, quadratures and splines as column expressions."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Nodes (from the middle outwards) and weights of the nested rules of 3 and 7 points on [-1, 1].
RULE_3 = ((0.0, 0.7745966692414834), (8 / 9, 5 / 9))
RULE_7 = ((0.0, 0.4342437493468026, 0.7745966692414834, 0.9604912687080203), (0.4509165386584741, 0.4013974147759622, 0.2684880898683334, 0.1046562260264673))
#: Orders beyond the wanted one at which the downward recurrence begins.
START = 30


def spherical_bessel(l: Column, x: Column) -> Column:
    """j_l(x) for whole l and x >= 0: upwards from j_0 and j_1 where x > l, else by ratios of neighbours from far above."""
    j0, j1 = F.sin(x) / x, F.sin(x) / x**2 - F.cos(x) / x
    up = F.aggregate(F.sequence(F.lit(1), F.greatest(l - 1, F.lit(1))), F.struct(j0.alias("a"), j1.alias("b")), lambda s, n: F.struct(s["b"].alias("a"), ((2 * n + 1) / x * s["b"] - s["a"]).alias("b")), lambda s: s["b"])

    def step(s: Column, n: Column) -> Column:
        r = 1 / ((2 * n + 1) / x - s["r"])
        return F.struct(r.alias("r"), F.when(n <= l, s["p"] * r).otherwise(s["p"]).alias("p"), F.when((n <= l) & (n >= 2), s["q"] * r).otherwise(s["q"]).alias("q"))

    one = F.struct(F.lit(0.0).alias("r"), F.lit(1.0).alias("p"), F.lit(1.0).alias("q"))
    down = F.aggregate(F.sequence(l + START, F.lit(1), F.lit(-1)), one, step, lambda s: F.when(F.abs(j0) >= F.abs(j1), j0 * s["p"]).otherwise(j1 * s["q"]))
    return F.when(x == 0, F.when(l == 0, 1.0).otherwise(0.0)).when(l == 0, j0).when((l == 1) & (x > 1), j1).when(x > l, up).otherwise(down)


def spherical_bessel_slope(l: Column, x: Column) -> Column:
    """First derivative of j_l."""
    return l / x * spherical_bessel(l, x) - spherical_bessel(l + 1, x)


def spherical_bessel_curvature(l: Column, x: Column) -> Column:
    """Second derivative of j_l, from its differential equation."""
    return (l * (l - 1) - x * x) / (x * x) * spherical_bessel(l, x) + 2 / x * spherical_bessel(l + 1, x)


def _sum(f: Callable[[Column], Column], low: Column, high: Column, nodes, weights) -> Column:
    half, mid = (high - low) / 2, (high + low) / 2
    points = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(w)).alias("w")) for x, w in zip(nodes, weights)])
    return half * F.aggregate(points, F.lit(0.0), lambda acc, p: acc + p["w"] * f(mid + half * p["x"]))


def chebyshev(f: Callable[[Column], Column], low: Column, high: Column, n: int = 32) -> tuple[Column, Column]:
    """Integral by Chebyshev points with the ends (n even), and its distance from the rule with half as many."""

    def rule(n: int) -> Column:
        k = np.arange(n + 1)
        j = np.arange(1, n // 2 + 1)
        c = np.where(2 * j == n, 1.0, 2.0)
        w = (1 - (c * np.cos(2 * np.pi * np.outer(k, j) / n) / (4 * j * j - 1)).sum(1)) * 2 / n
        w[[0, -1]] /= 2
        return _sum(f, low, high, np.cos(np.pi * k / n), w)

    whole = rule(n)
    return whole, F.abs(whole - rule(n // 2))


def patterson(f: Callable[[Column], Column], low: Column, high: Column) -> tuple[Column, Column]:
    """Integral by the nested rule of seven points, and its distance from the one of three."""
    both = lambda rule: _sum(f, low, high, [s * x for x in rule[0] for s in ((-1, 1) if x else (1,))], [w for x, w in zip(*rule) for _ in range(2 if x else 1)])
    whole = both(RULE_7)
    return whole, F.abs(whole - both(RULE_3))


def romberg(f: Callable[[Column], Column], low: Column, high: Column, levels: int = 6) -> Column:
    """Integral by trapezoids of halved steps, carried on to step zero."""
    rows: list[Column] = []
    for k in range(levels):
        n = 1 << k
        step = (high - low) / n
        inner = F.aggregate(F.sequence(F.lit(1), F.lit(n - 1)), F.lit(0.0), lambda acc, i: acc + f(low + i * ((high - low) / n))) if n > 1 else F.lit(0.0)
        rows.append(step * ((f(low) + f(high)) / 2 + inner))
    # The extrapolated value is a fixed combination of the trapezoids.
    table = [np.eye(levels)[k] for k in range(levels)]
    for m in range(1, levels):
        table = [(4**m * b - a) / (4**m - 1) for a, b in zip(table, table[1:])]
    return sum((F.lit(float(w)) * t for w, t in zip(table[0], rows)), F.lit(0.0))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _second_derivatives(x: pd.Series, y: pd.Series) -> pd.Series:
    def one(x, y) -> np.ndarray:
        x, y = np.asarray(x, float), np.asarray(y, float)
        n, h = len(x), np.diff(x)
        if n < 3:
            return np.zeros(n)
        a = np.diag(2 * (h[:-1] + h[1:])) + np.diag(h[1:-1], 1) + np.diag(h[1:-1], -1)
        return np.concatenate([[0.0], np.linalg.solve(a, 6 * np.diff(np.diff(y) / h)), [0.0]])

    return pd.Series([one(a, b) for a, b in zip(x, y)])


def spline(knots: DataFrame, keys: list[str], x: str, y: str, log: bool = False) -> DataFrame:
    """Natural cubic spline of each key as one array of knots (x, y, m); a key's table is short. With ``log`` in the logarithms of both."""
    own = (lambda c: F.log(F.col(c))) if log else (lambda c: F.col(c).cast("double"))
    listed = F.array_sort(F.collect_list(F.struct(own(x).alias("x"), own(y).alias("y"))))
    rows = knots.groupBy(*keys).agg(listed.alias("_knots")).withColumn("_m", _second_derivatives("_knots.x", "_knots.y"))
    return rows.select(*keys, F.zip_with("_knots", "_m", lambda k, m: F.struct(k["x"].alias("x"), k["y"].alias("y"), m.alias("m"))).alias("spline"))


def spline_value(spline: Column, x: Column, log: bool = False) -> Column:
    """Value of a spline; beyond the outer knots it goes on straight."""
    v = F.log(x) if log else x.cast("double")
    n = F.size(spline)
    i = F.greatest(F.lit(1), F.least(n - 1, F.size(F.filter(spline, lambda k: k["x"] <= v))))
    a, b = F.element_at(spline, i), F.element_at(spline, i + 1)
    h = b["x"] - a["x"]
    s, t = (b["x"] - v) / h, (v - a["x"]) / h
    inside = s * a["y"] + t * b["y"] + ((s**3 - s) * a["m"] + (t**3 - t) * b["m"]) * h * h / 6
    slope = (b["y"] - a["y"]) / h
    below = a["y"] + (v - a["x"]) * (slope - h / 6 * (2 * a["m"] + b["m"]))
    above = b["y"] + (v - b["x"]) * (slope + h / 6 * (a["m"] + 2 * b["m"]))
    out = F.when(v < a["x"], below).when(v > b["x"], above).otherwise(inside)
    return F.exp(out) if log else out


def hermite_gauss(n: int, x: Column, sigma: Column) -> Column:
    """Normalised Hermite-Gauss function of order n, by its recurrence."""
    u = x / sigma
    before, now = F.lit(0.0), F.exp(-u * u / 2) / F.sqrt(sigma * math.sqrt(math.pi))
    for k in range(n):
        before, now = now, math.sqrt(2 / (k + 1)) * u * now - math.sqrt(k / (k + 1)) * before
    return now
