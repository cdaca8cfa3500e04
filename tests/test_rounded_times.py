"""Times on and near hundredths of a second against integer arithmetic and the query's SQL."""

import duckdb
from compare import differences
from pyspark.sql import functions as F

from skyquilt.functions import columns as C
from skyquilt.plans import catalog

START = 1_705_104_000  # 2024-01-13


def test_texts_are_cut_at_whole_microseconds(spark):
    df = spark.range(3000).select(F.timestamp_micros(START * 1_000_000 + F.col("id") * 10_000).alias("ts"), "id")
    out = df.select("id", F.substring(C.time_text(C.seconds_2000(F.col("ts"))), 21, 2).cast("int").alias("x"))
    assert [r.id for r in out.collect() if r.x != r.id % 100] == []


def test_time_codec_rounds_ties_as_its_sql(spark, tmp_path):
    con = duckdb.connect()
    con.execute(f"copy (select k as event_id, make_timestamp({START}::bigint * 1000000 + k * 5000 + k * 37000000) as ts from generate_series(0, 4000) as g(k)) to '{tmp_path}/events.parquet'")
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet'")
    assert differences(catalog.time_codec(spark, str(tmp_path)), catalog.ORACLE["time_codec"], con) == ""
