"""Non-linear least squares for many keys at once: Gauss-Newton steps with damping, each one aggregate over all rows.

A model is written over ``Dual`` columns, which carry their derivatives, so its Jacobian is exact and stays in the
engine. A step sums J'J, J'r and r'r by key, with partial sums in every task; what is kept between steps is one row a key.
Samples that a model cannot tell apart enter the steps as few rows (``condensed``), so all samples are read once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .lookup import small

#: Steps after which keys that have not settled are reported as such.
MOST_STEPS = 60


@dataclass
class Dual:
    """A column and its derivatives by parameter."""

    value: Column
    slope: dict[int, Column]

    @staticmethod
    def of(x) -> Dual:
        return x if isinstance(x, Dual) else Dual(F.lit(float(x)) if isinstance(x, (int, float)) else x, {})

    def _with(self, value: Column, factor: Column) -> Dual:
        return Dual(value, {k: s * factor for k, s in self.slope.items()})

    def __add__(self, other) -> Dual:
        other = Dual.of(other)
        slope = dict(self.slope)
        for k, s in other.slope.items():
            slope[k] = slope[k] + s if k in slope else s
        return Dual(self.value + other.value, slope)

    __radd__ = __add__

    def __neg__(self) -> Dual:
        return Dual(-self.value, {k: -s for k, s in self.slope.items()})

    def __sub__(self, other) -> Dual:
        return self + -Dual.of(other)

    def __rsub__(self, other) -> Dual:
        return -self + other

    def __mul__(self, other) -> Dual:
        other = Dual.of(other)
        return self._with(self.value * other.value, other.value) + Dual(F.lit(0.0), {k: s * self.value for k, s in other.slope.items()})

    __rmul__ = __mul__

    def over(self, other: Dual) -> Dual:
        inverse = F.try_divide(F.lit(1.0), other.value)
        return self * Dual(inverse, {k: -s * inverse * inverse for k, s in other.slope.items()})

    def sin(self) -> Dual:
        return self._with(F.sin(self.value), F.cos(self.value))

    def cos(self) -> Dual:
        return self._with(F.cos(self.value), -F.sin(self.value))

    def exp(self) -> Dual:
        return self._with(F.exp(self.value), F.exp(self.value))


def choose(cases: list[tuple[Column, Dual]]) -> Dual:
    """The first case whose condition holds, with its derivatives."""
    pick = lambda get: F.coalesce(*[F.when(c, get(d)) for c, d in cases])
    names = sorted({k for _, d in cases for k in d.slope})
    return Dual(pick(lambda d: d.value), {k: pick(lambda d, k=k: d.slope.get(k, F.lit(0.0))) for k in names})


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _step(a: pd.Series, y: pd.Series, damping: pd.Series) -> pd.Series:
    """The damped step from J'J and J'r; a direction without any information is left alone."""
    out = []
    for m, v, d in zip(a, y, damping, strict=True):
        n = len(v)
        m = np.array(m, float).reshape(n, n)
        scale = np.sqrt(np.where(np.diag(m) > 0, np.diag(m), 1.0))
        m, v = m / np.outer(scale, scale), np.array(v, float) / scale
        out.append(np.linalg.lstsq(m + d * np.eye(n), v, rcond=1e-13)[0] / scale)
    return pd.Series(out)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _covariance(a: pd.Series) -> pd.Series:
    def one(m):
        m = np.array(m, float)
        n = int(len(m) ** 0.5)
        return np.linalg.pinv(m.reshape(n, n), hermitian=True).ravel()

    return pd.Series([one(m) for m in a])


@F.pandas_udf(T.ArrayType(T.ArrayType(T.DoubleType())))
def _root(a: pd.Series) -> pd.Series:
    """Rows R with R'R = A of a matrix A without negative eigenvalues."""

    def one(m):
        m = np.array(m, float)
        n = int(len(m) ** 0.5)
        m = m.reshape(n, n)
        scale = np.sqrt(np.where(np.diag(m) > 0, np.diag(m), 1.0))
        e, v = np.linalg.eigh(m / np.outer(scale, scale))
        return (np.sqrt(np.maximum(e, 0))[:, None] * v.T * scale).tolist()

    return pd.Series([one(m) for m in a])


def condensed(rows: DataFrame, keys: list[str], by: list[str], linear: list[str] | None = None) -> DataFrame:
    """(keys, by, linear, value, _weight, _n, _apart): rows whose sums of w r^2, plus ``_apart``, are those of ``rows`` (with ``_weight``) for all parameters.

    ``by`` are the columns that the model reads. Equal ones become one row, the mean, with what stands apart from it.
    With ``linear``, the model is a sum of these columns by coefficients of parameters and ``by``; then a group becomes
    as many rows as there are such columns and one more, a root of the sums of their products and of the value.
    """
    if not linear:
        one = rows.groupBy(*keys, *by, "_weight").agg(F.avg("value").alias("value"), F.count("*").alias("_n"), F.var_pop("value").alias("_var"))
        return one.select(*keys, *by, "value", (F.col("_weight") * F.col("_n")).alias("_weight"), "_n", (F.col("_weight") * F.col("_n") * F.col("_var")).alias("_apart"))
    names = [*linear, "value"]
    m = len(names)
    # A sample without one of the columns counts, but has no residual.
    whole = F.col(names[0]).isNotNull()
    for c in names[1:]:
        whole = whole & F.col(c).isNotNull()
    sums = rows.groupBy(*keys, *by).agg(*[F.sum(F.when(whole, F.col("_weight") * F.col(names[a]) * F.col(names[b]))).alias(f"_s{a}_{b}") for a in range(m) for b in range(a, m)], F.count("*").alias("_n"))
    root = _root(F.array(*[F.coalesce(f"_s{min(a, b)}_{max(a, b)}", F.lit(0.0)) for a in range(m) for b in range(m)]))
    row = sums.select(*keys, *by, "_n", F.posexplode(root).alias("_k", "_row"))
    return row.select(*keys, *by, *[F.col("_row")[k].alias(c) for k, c in enumerate(names)], F.lit(1.0).alias("_weight"), F.when(F.col("_k") == 0, F.col("_n")).otherwise(0).alias("_n"), F.lit(0.0).alias("_apart"))


def least_squares(stage: Callable[[DataFrame], DataFrame], rows: DataFrame, keys: list[str], model: Callable[[list[Dual]], Dual], start: list[Column | float], *, weight: str | None = None, close: float = 1e-10, by: list[str] | None = None, linear: list[str] | None = None) -> DataFrame:
    """(keys, parameters, covariance, chi2, dof, gradient, settled): the fit of ``value`` by ``model`` over parameters that begin at ``start``.

    ``start`` may use the keys. ``weight`` is an inverse variance; without one the covariance is scaled by chi2 / dof.
    Rows without value take no part. Steps that make chi2 larger are taken back and damped ten times as much.
    ``gradient`` is the largest part of J'r over the roots of J'J's diagonal and of chi2, which a minimum brings to 0.
    With ``by``, all columns that the model reads, and ``linear`` the steps run over ``condensed`` rows.
    """
    n = len(start)
    rows = rows.where("value is not null").withColumn("_weight", F.col(weight) if weight else F.lit(1.0))
    if by is not None:
        rows = stage(condensed(rows, keys, by, linear))
    else:
        rows = rows.withColumn("_n", F.lit(1)).withColumn("_apart", F.lit(0.0))
    first = F.array(*[F.lit(s).cast("double") if isinstance(s, (int, float)) else s.cast("double") for s in start])
    none = F.lit(None).cast("array<double>")
    state = stage(rows.select(*keys).distinct().select(*keys, first.alias("trial"), none.alias("best"), none.alias("a"), none.alias("y"), F.lit(float("inf")).alias("chi2"), F.lit(0).cast("long").alias("n"), F.lit(1e-3).alias("damping"), F.lit(False).alias("settled")))
    guess = [Dual(F.col("trial")[k], {k: F.lit(1.0)}) for k in range(n)]
    fitted = model(guess)
    for _ in range(MOST_STEPS):
        open_ = state.where("not settled").select(*keys, "trial")
        bound = rows.join(small(open_), keys)
        bound = bound.select(*keys, "_weight", F.col("_n").alias("_m"), "_apart", (F.col("value") - fitted.value).alias("_r"), *[fitted.slope.get(k, F.lit(0.0)).alias(f"_j{k}") for k in range(n)])
        w, j = F.col("_weight"), [F.col(f"_j{k}") for k in range(n)]
        upper = {(a, b): F.sum(w * j[a] * j[b]).alias(f"_a{a}_{b}") for a in range(n) for b in range(a, n)}
        sums = bound.groupBy(*keys).agg(*upper.values(), *[F.sum(w * j[k] * F.col("_r")).alias(f"_y{k}") for k in range(n)], F.sum(w * F.col("_r") ** 2 + F.col("_apart")).alias("_chi2"), F.sum("_m").alias("_n"))
        sums = sums.select(*keys, F.array(*[F.col(f"_a{min(a, b)}_{max(a, b)}") for a in range(n) for b in range(n)]).alias("_a"), F.array(*[F.col(f"_y{k}") for k in range(n)]).alias("_y"), "_chi2", "_n")
        now = state.join(sums, keys, "left")
        better = ~F.col("settled") & (F.col("_chi2") < F.col("chi2"))
        take = lambda new, old: F.when(better, F.col(new)).otherwise(F.col(old))
        # A trial that is no better, and no different, is the end; so is a fit without residuals.
        still = F.forall(F.zip_with("trial", F.coalesce("best", "trial"), lambda x, y: F.abs(x - y) <= close * (F.abs(y) + close)), lambda same: same) & F.col("best").isNotNull()
        gain = F.col("chi2") - F.col("_chi2")
        over = still | (better & (gain <= close * F.col("_chi2")) & (F.col("damping") <= 1e-3)) | (F.col("_chi2") <= 1e-26 * F.col("_n")) | (F.col("damping") > 1e12)
        damping = F.when(F.col("settled"), F.col("damping")).when(better, F.greatest(F.col("damping") / 10, F.lit(1e-12))).otherwise(F.col("damping") * 10)
        now = now.select(*keys, take("trial", "best").alias("best"), take("_a", "a").alias("a"), take("_y", "y").alias("y"), take("_chi2", "chi2").alias("chi2"), take("_n", "n").alias("n"), damping.alias("damping"), (F.col("settled") | F.coalesce(over, F.lit(False))).alias("settled"))
        move = _step("a", "y", "damping")
        state = stage(now.select(*keys, F.zip_with("best", move, lambda x, d: x + d).alias("trial"), "best", "a", "y", "chi2", "n", "damping", "settled"))
        if state.where("not settled").isEmpty():
            break
    dof = F.col("n") - n
    scale = F.lit(1.0) if weight else F.try_divide("chi2", F.greatest(dof, F.lit(1)))
    at = lambda k: F.element_at("a", k * (n + 1) + 1)
    slope = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.coalesce(F.abs(F.try_divide(F.element_at("y", k + 1), F.sqrt(at(k) * F.greatest("chi2", F.lit(1e-20))))), F.lit(0.0)))
    return state.select(*keys, F.col("best").alias("parameters"), F.transform(_covariance("a"), lambda c: c * scale).alias("covariance"), "chi2", dof.alias("dof"), F.array_max(slope).alias("gradient"), "settled")


# Receivers and polarised sources.

#: Names of the parameters of ``mueller_model``; angles are in radians.
MUELLER = ("gain_difference", "alpha", "psi", "phi", "epsilon", "q_source", "u_source", "chi")


def mueller_model(stokes: Column, theta: Column) -> Callable[[list[Dual]], Dual]:
    """Measured Q, U and V over I (``stokes`` is 1, 2 or 3) of a source at the parallactic angle ``theta``; ``stokes`` 0 is the source's U over Q."""
    return mueller_sums(stokes, F.lit(1.0), F.cos(2 * theta), F.sin(2 * theta))


def mueller_sums(stokes: Column, one: Column, c: Column, s: Column) -> Callable[[list[Dual]], Dual]:
    """``mueller_model``, which is linear in 1, cos(2 theta) and sin(2 theta), over sums of these.

    The receiver turns the source's polarisation, seen at the angle, by alpha and chi, its cross products by psi, and
    adds the gain difference and the cross-coupling epsilon at the phase phi.
    """

    def model(p: list[Dual]) -> Dual:
        gain, alpha, psi, phi, eps, q0, u0, chi = p
        q, u = q0 * c + u0 * s, u0 * c - q0 * s
        ca, sa = alpha.cos(), alpha.sin()
        c2, s2 = ca * ca - sa * sa, 2 * sa * ca
        first = 0.5 * gain * one + c2 * q + s2 * chi.cos() * u
        twice = psi + 2 * chi
        second = 2 * eps * (psi + phi).cos() * one - s2 * (psi + chi).cos() * q + (ca * ca * psi.cos() - sa * sa * twice.cos()) * u
        third = 2 * eps * (psi + phi).sin() * one - s2 * (psi + chi).sin() * q + (ca * ca * psi.sin() - sa * sa * twice.sin()) * u
        return choose([(stokes == 1, first), (stokes == 2, second), (stokes == 3, third), (stokes == 0, u0.over(q0) * one)])

    return model


def fit_mueller(stage: Callable[[DataFrame], DataFrame], rows: DataFrame, keys: list[str], start: list[Column | float], position_angle: float) -> DataFrame:
    """The eight parameters of each key's receiver from rows (keys, theta, stokes, value) of on-less-off medians over I.

    One more row a key holds the source's known position angle (radians): U over Q is its tangent. Angles come back
    between -pi and pi.
    """
    known = rows.select(*keys).distinct().select(*keys, F.lit(0.0).alias("theta"), F.lit(0).alias("stokes"), F.lit(float(np.tan(2 * position_angle))).alias("value"))
    every = rows.select(*keys, "theta", F.col("stokes").cast("int").alias("stokes"), "value").unionByName(known)
    terms = {"_one": F.when(F.col("theta").isNotNull(), 1.0), "_c": F.cos(2 * F.col("theta")), "_s": F.sin(2 * F.col("theta"))}
    every = every.select(*keys, "stokes", "value", *[c.alias(n) for n, c in terms.items()])
    out = least_squares(stage, every, keys, mueller_sums(F.col("stokes"), *[F.col(n) for n in terms]), start, by=["stokes"], linear=list(terms))
    angles = [k in (1, 2, 3, 7) for k in range(8)]
    turn = lambda x: F.pmod(x + np.pi, F.lit(2 * np.pi)) - np.pi
    p = F.array(*[turn(F.col("parameters")[k]) if a else F.col("parameters")[k] for k, a in enumerate(angles)])
    return out.withColumn("parameters", p)


def total_mueller_model(stokes: Column, theta: Column, measured: list[Column]) -> Callable[[list[Dual]], Dual]:
    """The source's I, Q, U, V (``stokes`` 0 to 3) from what is measured: 16 numbers of a matrix, whose Q and U are turned back by the parallactic angle."""
    c, s = F.cos(2 * theta), F.sin(2 * theta)

    def model(p: list[Dual]) -> Dual:
        i, q, u, v = (sum((p[4 * k + m] * measured[m] for m in range(4)), Dual(F.lit(0.0), {})) for k in range(4))
        return choose([(stokes == 0, i), (stokes == 1, q * c - u * s), (stokes == 2, q * s + u * c), (stokes == 3, v)])

    return model


def fit_total_mueller(stage: Callable[[DataFrame], DataFrame], rows: DataFrame, keys: list[str], source: list[Column]) -> DataFrame:
    """The matrix (16 parameters by rows) of each key that takes measured polarisations to the source's, from rows (keys, theta, m0 to m3)."""
    seen = rows.withColumn("stokes", F.explode(F.sequence(F.lit(0), F.lit(3))))
    value = F.coalesce(*[F.when(F.col("stokes") == k, s) for k, s in enumerate(source)])
    start = [1.0 if k % 5 == 0 else 0.0 for k in range(16)]
    return least_squares(stage, seen.withColumn("value", value), keys, total_mueller_model(F.col("stokes"), F.col("theta"), [F.col(f"m{k}") for k in range(4)]), start)


# Beams of two polarisations.

#: Names of the parameters of ``beam_model``: offsets and full width at half height, amplitudes, system temperatures.
BEAM = ("x0", "y0", "width", "amp_xx", "amp_yy", "tsys_xx", "tsys_yy")


def beam_model(x: Column, y: Column, yy: Column) -> Callable[[list[Dual]], Dual]:
    """A round Gaussian that both polarisations share but for amplitude and base; ``yy`` tells the second from the first."""

    def model(p: list[Dual]) -> Dual:
        dx, dy = Dual.of(x) - p[0], Dual.of(y) - p[1]
        # exp(-r^2 / (2 sigma^2)) by the full width at half height
        gauss = (-4 * float(np.log(2)) * (dx * dx + dy * dy).over(p[2] * p[2])).exp()
        return choose([(yy, p[4] * gauss + p[6]), (~yy, p[3] * gauss + p[5])])

    return model


def fit_beam(stage: Callable[[DataFrame], DataFrame], rows: DataFrame, keys: list[str], start: list[Column | float], *, weight: str | None = None) -> DataFrame:
    """The seven parameters of each key's beam from samples (keys, x, y, pol, value) about the source; of the polarisations XX and YY are used."""
    used = rows.where(F.col("pol").isin("XX", "YY"))
    out = least_squares(stage, used, keys, beam_model(F.col("x"), F.col("y"), F.col("pol") == "YY"), start, weight=weight, by=["x", "y", "pol"])
    return out.withColumn("parameters", F.transform("parameters", lambda v, k: F.when(k == 2, F.abs(v)).otherwise(v)))
