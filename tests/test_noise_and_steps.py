import numpy as np
import pytest
from pyspark.sql import functions as F

from skyquilt.operators import generators, noise, spectra
from skyquilt.operators import timestream as ts
from skyquilt.plans.steps import Chain, Step, run_new


def test_over_f_fit_recovers_the_curve(spark):
    f = np.arange(1, 200) / 200
    p = noise.over_f_curve(f, 2.0, -1.5, 0.3, 0.1)
    assert noise.fit_curve(f, p, 0.1) == (pytest.approx(2.0, rel=1e-3), pytest.approx(-1.5, rel=1e-3), pytest.approx(0.3, rel=1e-3))
    s = generators.over_f_noise(spark, 8, 512, 1.0, -1.5, 0.1, 1.0, 3).select("stream", F.col("t").alias("slot"), "value", F.lit(1.0).alias("mask"))
    got = noise.fit_over_f(spectra.series_power(s, ["stream"], 512, deconvolve=False), ["stream"], 0.1).agg(F.avg("index")).first()[0]
    assert -2.2 < got < -0.9


def test_polynomials_are_orthonormal(spark):
    rows = spark.createDataFrame([("a", t, float(t * t), 0.5 + t % 2) for t in range(20)], "k string, t long, value double, w double")
    b = np.array([r.basis for r in noise.orthogonal_polynomials(rows, ["k"], "t", 2, "w").orderBy("t").collect()])
    w = np.array([0.5 + t % 2 for t in range(20)])
    assert np.allclose(b.T @ (w[:, None] * b), np.eye(3), atol=1e-9)
    out = noise.high_pass(rows.withColumn("value", F.when(F.col("t") != 3, F.col("value"))), ["k"], "t", 2)
    assert out.where("t = 3").first().value is None
    assert out.agg(F.max(F.abs("value"))).first()[0] < 1e-6


def test_gain_against_a_map(spark):
    rows = spark.createDataFrame([("a", t, float(3.0 * np.sin(t) + t), float(np.sin(t))) for t in range(40)], "k string, t long, value double, map_value double")
    assert noise.gain_from_map(rows, ["k"], "t", 1).first().gain == pytest.approx(3.0, abs=1e-6)


def test_chain_and_new_work(spark, tmp_path):
    rows = spark.createDataFrame([("a", t, c, float(c)) for t in range(6) for c in range(4)], "k string, t long, chan int, value double")
    chain = Chain([Step("rebin", lambda d, n: ts.rebin_frequency(d, ["k", "t"], n), {"n": 2}, "rf_"), Step("mean", lambda d: ts.subtract_mean(d, ["k", "t"]))])
    out, history = chain.run(rows, {"rf_n": 4})
    assert out.count() == 6 and history == [("rebin", {"n": 4}), ("mean", {})]
    assert chain.without("rebin").run(rows)[0].count() == 24
    asked, done = spark.range(5).withColumnRenamed("id", "scan"), str(tmp_path / "done")
    assert run_new(asked.where("scan < 3"), done, "scan", lambda d: d).count() == 3
    assert run_new(asked, done, "scan", lambda d: d).count() == 5
