"""Indexed reads of SDFITS files, search-mode files and matrices that are changed on disk."""

from __future__ import annotations

import os

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from skyquilt.sources import fits as S
from skyquilt.sources import telescope as T

SCHEMA = "file string, record int, SCAN int, CRVAL1 double, CRVAL4 int, CAL string, LST double, DATA array<double>"


def records(n_scans=6, n_times=5, bands=(690, 710), n_chan=64):
    kinds = [("SCAN", ">i4"), ("CRVAL1", ">f8"), ("CRVAL4", ">i4"), ("CAL", "S1"), ("LST", ">f8"), ("DATA", ">f4", (n_chan,))]
    rows = [(10 + s, b * 1e6, pol, cal, 100.0 * s + t, np.full(n_chan, s + t / 10)) for s in range(n_scans) for b in bands for t in range(n_times) for pol in (-5, -6) for cal in (b"T", b"F")]
    return np.array([tuple(r) for r in rows], kinds)


@pytest.fixture
def files(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"f{k}.fits").write_bytes(S.table_bytes(records(), ["000: made"]))
    return tmp_path


def test_index_leads_to_the_records_of_scan_and_band(spark, files):
    index = T.build_index(spark, str(files), part_bytes=7000)
    runs = index.collect()
    assert sum(r.last - r.first for r in runs) == 3 * len(records()) and {(r.scan, r.band) for r in runs} == {(10 + s, b) for s in range(6) for b in (690, 710)}
    got = T.read_indexed(index, SCHEMA, (F.col("scan") == 12) & (F.col("band") == 710)).collect()
    want = [(i, r["LST"], r["CAL"].decode()) for i, r in enumerate(records()) if r["SCAN"] == 12 and r["CRVAL1"] == 7.1e8]
    for name in {r.file for r in got}:
        assert sorted((r.record, r.LST, r.CAL) for r in got if r.file == name) == want
    assert len(got) == 3 * len(want) and all(len(r.DATA) == 64 for r in got)
    assert T.read_indexed(index, SCHEMA).count() == 3 * len(records())


def test_only_the_wanted_ranges_are_read(spark, files):
    index = T.build_index(spark, str(files))
    width = records().dtype.itemsize
    wanted = index.where("scan in (10, 13) and band = 690")
    fetched = []

    def fetch(name, place, w, low, high, head):
        fetched.append((high - low) * w)
        return T._records(name, place, w, low, high, head)

    for gap, reads, most in ((0, 6, 2 * 20 * width), (1 << 30, 3, 140 * width)):
        fetched.clear()
        plan = T.planned_reads(wanted, gap=gap).toPandas()
        rows = sum(len(b) for b in T.read_planned(iter([plan]), StructType.fromDDL(SCHEMA), fetch))
        assert rows == 3 * 40 and len(fetched) == reads and sum(fetched) == 3 * most
    total = sum(os.path.getsize(files / f) for f in os.listdir(files))
    assert 3 * 2 * 20 * width < 0.4 * total


def test_blocks_out_of_order_are_errors(spark, files, tmp_path_factory):
    index = T.build_index(spark, str(files))
    ok = T.checked_blocks(T.read_indexed(index, SCHEMA))
    assert ok.groupBy("file", "SCAN", "band", "block_time").count().where("count <> 4").count() == 0 and ok.agg(F.max("block_time")).first()[0] == 4
    for change, text in (
        (lambda r: r[:-1], "cut short"),
        (lambda r: np.concatenate([r[:4], r[[6, 7, 4, 5]], r[8:]]), "order"),
        (lambda r: np.concatenate([r[8:12], r[:8], r[12:]]), "LST falls"),
        (lambda r: (r["LST"].__setitem__(1, 7.0), r)[1], "several LSTs"),
    ):
        at = tmp_path_factory.mktemp("bad")
        (at / "f.fits").write_bytes(S.table_bytes(change(records(1, 5, (690,)))))
        with pytest.raises(Exception, match=text):
            T.checked_blocks(T.read_indexed(T.build_index(spark, str(at)), SCHEMA)).collect()


def search_file(rng, n=6, n_time=16, n_pol=2, n_chan=4):
    data = rng.integers(0, 256, (n, n_time, n_pol, n_chan)).astype(np.uint8)
    scale, offset = rng.uniform(0.5, 2, (2, n, n_pol, n_chan)).astype(np.float32)
    weight = (rng.random((n, n_chan)) < 0.8).astype(np.float32)
    return data, scale, offset, weight, np.linspace(700, 710, n_chan)


def test_search_mode_is_scaled_masked_averaged_and_folded(spark, tmp_path):
    rng = np.random.default_rng(1)
    data, scale, offset, weight, freq = search_file(rng)
    (tmp_path / "a.fits").write_bytes(T.psrfits_bytes(data, scale, offset, weight, freq, 0.25, 1000.5))
    T.register(spark)
    df = spark.read.format("psrfits").option("average", 8).option("fold", 4).option("partBytes", 600).load(str(tmp_path))
    assert df.rdd.getNumPartitions() == 3
    rows = df.collect()
    assert len(rows) == 6 * 2 * 4 * 2
    signed = data.view(np.int8).astype(float)
    signed[:, :, 0] = data[:, :, 0]
    value = signed * scale[:, None] + offset[:, None]
    for r in rows:
        b = r.t - 2 * r.record
        part = value[r.record, b * 8 + r.phase : (b + 1) * 8 : 4, r.pol].mean(0)
        for k in range(4):
            assert r.spec[k] is None if weight[r.record, k] == 0 else r.spec[k] == pytest.approx(part[k])
        assert r.time == pytest.approx(1000.5 + (r.t + 0.5) * 2.0) and r.freq == pytest.approx(list(freq))


def test_wrong_shapes_and_averages_are_refused(spark, tmp_path):
    data, scale, offset, weight, freq = search_file(np.random.default_rng(2))
    (tmp_path / "a.fits").write_bytes(T.psrfits_bytes(data, scale, offset, weight, freq, 0.25, 0.0))
    T.register(spark)
    for average, fold in ((5, 1), (8, 3)):
        with pytest.raises(Exception, match="divide"):
            spark.read.format("psrfits").option("average", average).option("fold", fold).load(str(tmp_path)).collect()


def test_calibrator_is_found_in_the_fold(spark, tmp_path):
    rng = np.random.default_rng(3)
    data = rng.integers(0, 5, (4, 16, 2, 4)).astype(np.uint8)
    lit = np.isin(np.arange(16) % 8, [6, 7, 0, 1])
    data[:, lit] += 50
    one = np.ones((4, 2, 4), np.float32)
    (tmp_path / "a.fits").write_bytes(T.psrfits_bytes(data, one, 0 * one, one[:, 0], np.arange(4.0), 1.0, 0.0))
    T.register(spark)
    df = spark.read.format("psrfits").option("average", 16).option("fold", 8).load(str(tmp_path))
    for r in T.folded_calibrator(df, ["file"]).collect():
        x = data[r.t, :, r.pol].astype(float)
        assert np.allclose(r.on, x[lit].mean(0)) and np.allclose(r.off, x[~lit].mean(0))


def tiles(spark, rows):
    return spark.createDataFrame([(i, j, [float(v)] * 4) for i, j, v in rows], "i int, j int, tile array<double>")


def test_only_touched_squares_are_written_again(spark, tmp_path):
    stage, path = S.stager(spark, "tiles"), str(tmp_path / "m")
    T.write_tiles(tiles(spark, [(i, j, i + j) for i in range(10) for j in range(10)]), path, 2)
    names = lambda: {os.path.join(d, f) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}
    before = names()
    T.update_tiles(stage, tiles(spark, [(3, 3, 100), (11, 0, 7)]), path, 2)
    T.update_tiles(stage, tiles(spark, [(3, 3, 1)]), path, 2, add=True)
    after = names()
    assert len(before) == 25 and len(before & after) == 24 and len(after) == 26
    got = {(r.i, r.j): r.tile[0] for r in T.read_tiles(spark, path).collect()}
    assert got == {(i, j): float(i + j) for i in range(10) for j in range(10)} | {(3, 3): 101.0, (11, 0): 7.0}
    assert {(r.i, r.j) for r in T.read_tiles(spark, path, (3, 5), 2).collect()} == {(i, j) for i in (3, 4) for j in range(10)}


def test_a_failed_update_leaves_the_matrix(spark, tmp_path):
    stage, path = S.stager(spark, "tiles"), str(tmp_path / "m")
    T.write_tiles(tiles(spark, [(i, 0, i) for i in range(4)]), path, 1)
    bad = tiles(spark, [(0, 0, 9), (1, 0, 9)]).withColumn("tile", F.when(F.col("i") == 1, F.raise_error(F.lit("no")).cast("array<double>")).otherwise(F.col("tile")))
    with pytest.raises(Exception, match="no"):
        T.update_tiles(stage, bad, path, 1)
    assert sorted(r.tile[0] for r in T.read_tiles(spark, path).collect()) == [0.0, 1.0, 2.0, 3.0]
