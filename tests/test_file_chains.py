"""Chains over files: what is written, what is skipped, what is refused."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from skyquilt.plans import steps
from skyquilt.sources import fits as S


def rows(spark, names, n=4):
    df = spark.createDataFrame([(f"{name}.fits", 1, 700, t, -5, c, 7e8, 1e5, 2.0, [float(t), None, 2.0], ["000: made"]) for name in names for t in range(n) for c in ("T", "F")], "file string, scan int, band int, t int, pol int, cal string, crval1 double, cdelt1 double, crpix1 double, spec array<double>, history array<string>")
    return df


CHAIN = steps.Chain([steps.Step("scale", lambda df, by: df.withColumn("spec", F.transform("spec", lambda x: x * by)), {"by": 2.0})])


def test_files_keep_names_history_and_masks(spark, tmp_path):
    source, target = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    assert {(r.name, r.records) for r in steps.write_records(rows(spark, "ab"), source).collect()} == {("a.fits", 8), ("b.fits", 8)}
    done = steps.run_files(spark, CHAIN, source, target, {"by": 3.0})
    assert sorted(r.name for r in done.collect()) == ["a.fits", "b.fits"] and steps.file_names(target) == {"a.fits", "b.fits"}
    S.register(spark)
    back = spark.read.format("sdfits").load(target)
    assert back.first().history == ["000: made", "0: scale {'by': 3.0}"]
    out = S.spectra(back).where("t = 3 and cal = 'T'").first()
    assert out.spec == [9.0, None, 6.0] and out.band == 700
    assert steps.read_params(target) == {"scale.by": 3.0}


def test_second_run_takes_new_files_only(spark, tmp_path):
    source, target = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    steps.write_records(rows(spark, "a"), source).collect()
    steps.run_files(spark, CHAIN, source, target).collect()
    steps.write_records(rows(spark, "c"), source).collect()
    assert [r.name for r in steps.run_files(spark, CHAIN, source, target).collect()] == ["c.fits"]
    with pytest.raises(ValueError, match="other parameters"):
        steps.run_files(spark, CHAIN, source, target, {"by": 5.0})


def test_large_and_uneven_files_are_refused(spark, tmp_path, monkeypatch):
    uneven = rows(spark, "a").withColumn("spec", F.when(F.col("t") == 1, F.array(F.lit(1.0))).otherwise(F.col("spec")))
    with pytest.raises(Exception, match="lengths"):
        steps.write_records(uneven, f"file://{tmp_path}/u").collect()
    monkeypatch.setattr(steps, "MOST_RECORDS", 3)
    with pytest.raises(Exception, match="more than 3 records"):
        steps.write_records(rows(spark, "a"), f"file://{tmp_path}/l").collect()
    assert steps.file_names(f"file://{tmp_path}/l") == set()
