import numpy as np
from pyspark.sql import functions as F

from skyquilt.sources import fits as S
from skyquilt.streaming import streams


def test_fits_round_trip(spark, tmp_path):
    rec = np.zeros(8, [("SCAN", ">i4"), ("CRVAL1", ">f8"), ("CDELT1", ">f8"), ("CRPIX1", ">f8"), ("CRVAL4", ">i4"), ("CAL", "S1"), ("DATA", ">f4", (4,))])
    rec["SCAN"], rec["CRVAL1"], rec["CAL"] = 17, 6.95e8, [b"T", b"F"] * 4
    rec["DATA"] = np.arange(32).reshape(8, 4)
    rec["DATA"][0, 1] = np.nan
    (tmp_path / "a.fits").write_bytes(S.table_bytes(rec, ["000: made"]))
    S.register(spark)
    df = spark.read.format("sdfits").load(str(tmp_path))
    assert df.count() == 8 and df.first().history == ["000: made"]
    rows = S.spectra(df).where("cal = 'T' and t = 0").first()
    assert rows.band == 695 and rows.spec == [0.0, None, 2.0, 3.0]


def test_images_and_cubes(spark, tmp_path):
    cube = np.arange(24.0).reshape(2, 3, 4)
    head, _, data = next(S.units(S.image_bytes(cube)))
    assert np.array_equal(S.image(head, data), cube)
    np.save(tmp_path / "c.npy", cube)
    (tmp_path / "c.npy.meta").write_text("{'axes': ('freq', 'ra', 'dec'), 'freq_centre': 700.0, 'freq_delta': -2.0}")
    S.register(spark)
    df = spark.read.format("npycube").load(str(tmp_path))
    assert df.count() == 24
    assert df.where("fi = 0").first().freq == 702.0


def test_text_catalog(spark, tmp_path):
    (tmp_path / "c.txt").write_text("# ra dec\n  1.5 2.5   0.8 20.1 3\n4 5 x 21 1\n")
    rows = S.read_catalog(spark, str(tmp_path / "c.txt").replace("file:", "")).where("ra = 1.5").collect()
    assert (rows[0].z, rows[0].ijack) == (0.8, 3)


def _run(spark, df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.sql(f"select * from {name}")


def _stream(spark, tmp_path):
    rows = spark.sql("select timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,cast(id as int)) as ts, cast(id % 2 as int) as chan, cast(id as double) as value, 2.0d as template from range(120)")
    rows.write.parquet(str(tmp_path / "in"))
    return streams.read_new_files(spark, str(tmp_path / "in"), rows.schema)


def test_stream_rebin_equals_batch(spark, tmp_path):
    s = _stream(spark, tmp_path)
    got = _run(spark, streams.rebin(s, ["chan"], "10 minutes", "0 seconds"), "rebinned", "complete")
    assert got.count() == 24
    assert got.where("chan = 0").orderBy("start").first().value == 4.0
    gains = _run(spark, streams.accumulate(s, ["chan"]), "gains", "complete")
    assert gains.where("chan = 0").first().gain == sum(range(0, 120, 2)) * 2 / (60 * 4.0)


def test_stream_state(spark, tmp_path):
    s = _stream(spark, tmp_path).withColumn("value", F.when(F.col("value") == 100, 1e6).otherwise(F.col("value") % 7))
    got = _run(spark, streams.flag_jumps(s, "chan"), "flags", "append")
    assert got.where("flag").count() == 1 and got.count() == 120
