"""Distances, times and 21 cm factors as column expressions; integrals by fixed Gauss-Legendre nodes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Speed of light in km/s, rest frequency in MHz, Gyr of 1/(km/s/Mpc).
LIGHT, LINE_MHZ, GYR = 299792.458, 1420.40575177, 977.7922216807892
# Published Pade coefficients of the growth factor, numerator and denominator, from the constant on.
GROWTH = ((1.0, 1.175, 0.3064, 0.005355), (1.0, 1.857, 1.021, 0.1530))
_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(24)


@dataclass(frozen=True)
class Cosmology:
    h0: float = 70.2
    matter: float = 0.274
    dark: float = 0.726
    radiation: float = 0.0

    @property
    def curvature(self) -> float:
        return 1 - self.matter - self.dark - self.radiation

    @staticmethod
    def physical(ombh2: float = 0.02255, omch2: float = 0.1126, h0: float = 70.2, omk: float = 0.0) -> Cosmology:
        """From physical densities."""
        matter = (ombh2 + omch2) / (h0 / 100) ** 2
        return Cosmology(h0, matter, 1 - matter - omk)

    def e_z(self, z: Column) -> Column:
        s = 1 + z
        return F.sqrt(self.radiation * s**4 + self.matter * s**3 + self.curvature * s**2 + F.lit(self.dark))

    def hubble(self, z: Column) -> Column:
        return self.h0 * self.e_z(z)

    def hubble_distance(self, z: Column) -> Column:
        return LIGHT / self.hubble(z)

    def _integral(self, f, low: Column, high: Column) -> Column:
        half, mid = (high - low) / 2, (high + low) / 2
        nodes = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(w)).alias("w")) for x, w in zip(_NODES, _WEIGHTS)])
        return half * F.aggregate(nodes, F.lit(0.0), lambda acc, n: acc + n["w"] * f(mid + half * n["x"]))

    def comoving_distance(self, z: Column, z0: float = 0.0) -> Column:
        return LIGHT / self.h0 * self._integral(lambda x: 1 / self.e_z(x), F.lit(float(z0)), z)

    def transverse_distance(self, z: Column) -> Column:
        d, k = self.comoving_distance(z), self.curvature
        if abs(k) < 1e-12:
            return d
        scale = LIGHT / self.h0 / abs(k) ** 0.5
        return scale * (F.sinh(d / scale) if k > 0 else F.sin(d / scale))

    def angular_diameter_distance(self, z: Column) -> Column:
        return self.transverse_distance(z) / (1 + z)

    def luminosity_distance(self, z: Column) -> Column:
        return self.transverse_distance(z) * (1 + z)

    def volume_element(self, z: Column) -> Column:
        """Comoving volume for each redshift and steradian."""
        return self.hubble_distance(z) * self.transverse_distance(z) ** 2

    def comoving_volume(self, z: Column) -> Column:
        """Volume within z, of any curvature."""
        k, reach = self.curvature, LIGHT / self.h0
        if abs(k) < 1e-12:
            return 4 * np.pi / 3 * self.comoving_distance(z) ** 3
        d, root = self.transverse_distance(z) / reach, abs(k) ** 0.5
        arc = F.asinh(root * d) if k > 0 else F.asin(root * d)
        return 2 * np.pi * reach**3 / k * (d * F.sqrt(1 + k * d * d) - arc / root)

    def lookback_time(self, z: Column, z0: float = 0.0) -> Column:
        return GYR / self.h0 * self._integral(lambda x: 1 / ((1 + x) * self.e_z(x)), F.lit(float(z0)), z)

    def light_travel_distance(self, z: Column) -> Column:
        return self.lookback_time(z) * LIGHT / GYR

    def age(self, z: Column) -> Column:
        """Age at z: an integral over the root of the scale factor, which is smooth at 0."""
        top = F.sqrt(1 / (1 + z))
        return GYR / self.h0 * self._integral(lambda x: 2 * x**3 / F.sqrt(self.radiation + self.matter * x**2 + self.curvature * x**4 + self.dark * x**8), F.lit(0.0), top)

    def age_flat(self, z: Column) -> Column:
        """Closed form without curvature."""
        return GYR / self.h0 * 2 / (3 * self.dark**0.5) * F.asinh((self.dark / self.matter) ** 0.5 * (1 + z) ** -1.5)

    def _growth(self, z: Column) -> tuple[Column, list[Column], list[Column]]:
        """The ratio x of dark energy to matter, both polynomials in it, and x times their derivatives."""
        x = (1 / self.matter - 1) / (1 + z) ** 3
        sums = [sum((c * x**k for k, c in enumerate(p)), F.lit(0.0)) for p in GROWTH]
        slopes = [sum((k * c * x**k for k, c in enumerate(p) if k), F.lit(0.0)) for p in GROWTH]
        return x, sums, slopes

    def growth_factor(self, z: Column) -> Column:
        """Growth of structure, 1 / (1 + z) in the early universe."""
        x, (num, den), _ = self._growth(z)
        return F.sqrt(1 + x) / (1 + z) * num / den

    def growth_rate(self, z: Column) -> Column:
        """Logarithmic derivative of the growth factor by the scale factor."""
        x, (num, den), (dnum, dden) = self._growth(z)
        return 1 + 1.5 * x / (1 + x) + 3 * dnum / num - 3 * dden / den

    def brightness_temperature(self, z: Column) -> Column:
        """Mean 21 cm brightness (mK)."""
        return 0.39 * ((self.matter + self.dark * (1 + z) ** -3) / 0.29) ** -0.5 * ((1 + z) / 2.5) ** 0.5


def redshift(freq_mhz: Column) -> Column:
    return LINE_MHZ / freq_mhz - 1


def frequency(z: Column) -> Column:
    return LINE_MHZ / (1 + z)


def inverse_table(f, low: float, high: float, n: int = 1000) -> tuple[list[float], list[float]]:
    """A table of a monotonic function, for ``interpolate`` in either direction."""
    x = np.linspace(low, high, n)
    return x.tolist(), [float(f(v)) for v in x]


def interpolate(x: Column, xs: list[float], ys: list[float], outside: float | None = None) -> Column:
    """Piecewise linear interpolation in a bounded table with increasing ``xs``."""
    points = F.array(*[F.struct(*[F.lit(float(v)).alias(k) for k, v in zip(("a", "b", "p", "q"), row)]) for row in zip(xs, xs[1:], ys, ys[1:])])
    at = F.try_element_at(F.filter(points, lambda s: (x >= s["a"]) & (x <= s["b"])), F.lit(1))
    return F.coalesce(at["p"] + (at["q"] - at["p"]) * (x - at["a"]) / (at["b"] - at["a"]), F.lit(outside).cast("double"))


def thermal_temperature(freq_mhz: Column) -> Column:
    """System temperature (K) of the receiver model."""
    return 20 + (900 - freq_mhz) / 200 * 10
