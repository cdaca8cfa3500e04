"""Fits over condensed rows: as few as the model can tell apart, with the sums of all samples."""

import math

import numpy as np
from pyspark.sql import functions as F

from skyquilt.operators import nonlinear
from skyquilt.sources import fits as files


def test_samples_are_read_once(spark):
    """What the steps read does not grow with the samples, and chi2 and their number are those of all of them."""
    rng = np.random.default_rng(7)
    p = [0.3, 1.4, 2.9, 0.2, 0.016, 0.05, 0.05 * math.tan(2 * math.radians(33)), 0.1]
    rows = [(1, float(rng.uniform(0, 3)), k % 3 + 1, float(1e-3 * rng.normal())) for k in range(3000)] + [(1, 1.0, 2, None), (1, None, 1, 0.5)]
    df = spark.createDataFrame(rows, "chan int, theta double, stokes int, noise double")
    df = df.withColumn("clean", nonlinear.mueller_model(F.col("stokes"), F.col("theta"))([nonlinear.Dual.of(x) for x in p]).value)
    df = df.select("chan", "theta", "stokes", (F.coalesce("clean", F.lit(0.0)) + F.col("noise")).alias("value"))
    stage, sizes = files.stager(spark, "condensed"), []
    keep = lambda d: (lambda out: sizes.append(out.count()) or out)(stage(d))
    out = nonlinear.fit_mueller(keep, df, ["chan"], [0.3, 1.3, 2.8, 0.15, 0.02, 0.05, 0.1, 0.05], math.radians(33)).first()
    assert sizes[0] == max(sizes) == 16 and out.settled and out.dof == 3001 + 1 - 8
    at = nonlinear.mueller_model(F.col("stokes"), F.col("theta"))([nonlinear.Dual.of(float(x)) for x in out.parameters]).value
    known = (out.parameters[6] / out.parameters[5] - math.tan(2 * math.radians(33))) ** 2
    assert abs(df.agg(F.sum((F.col("value") - at) ** 2)).first()[0] + known - out.chi2) < 1e-9 * out.chi2


def test_beams_read_equal_places_once(spark):
    rng = np.random.default_rng(8)
    spots = [(x / 4, y / 4, pol) for x in range(-3, 4) for y in range(-3, 4) for pol in ("XX", "YY")]
    rows = [(1, *spots[k % len(spots)], float(rng.normal()), 1.0 + k // len(spots) % 2) for k in range(20 * len(spots))]
    df = spark.createDataFrame(rows, "chan int, x double, y double, pol string, noise double, w double")
    clean = nonlinear.beam_model(F.col("x"), F.col("y"), F.col("pol") == "YY")([nonlinear.Dual.of(v) for v in (0.1, -0.1, 0.9, 5.0, 6.0, 20.0, 22.0)]).value
    df = df.withColumn("value", clean + F.col("noise") / 100)
    stage, sizes = files.stager(spark, "condensed-beam"), []
    keep = lambda d: (lambda out: sizes.append(out.count()) or out)(stage(d))
    out = nonlinear.fit_beam(keep, df, ["chan"], [0.0, 0.0, 0.8, 10.0, 10.0, 10.0, 10.0], weight="w").first()
    assert max(sizes) == 2 * len(spots) and out.settled and out.dof == len(rows) - 7
    at = nonlinear.beam_model(F.col("x"), F.col("y"), F.col("pol") == "YY")([nonlinear.Dual.of(float(v)) for v in out.parameters]).value
    assert abs(df.agg(F.sum(F.col("w") * (F.col("value") - at) ** 2)).first()[0] - out.chi2) < 1e-9 * out.chi2
