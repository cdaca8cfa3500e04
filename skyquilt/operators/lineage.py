"""Histories, tags, keys and parameters of files."""

from __future__ import annotations

import json
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def add_history(df: DataFrame, entry: str, details: list[str] | None = None, column: str = "history") -> DataFrame:
    """Appends an entry, numbered by its place."""
    n = F.coalesce(F.size(column), F.lit(0))
    new = F.struct(F.concat(F.format_string("%03d: ", n), F.lit(entry)).alias("entry"), F.array(*[F.lit(d) for d in details or []]).cast("array<string>").alias("details"))
    return df.withColumn(column, F.array_append(F.coalesce(F.col(column), F.array().cast("array<struct<entry:string,details:array<string>>>")), new))


def collect_history(rows: DataFrame, keys: list[str], order: str, entry: Column) -> DataFrame:
    """One history for each key from rows that are its entries, in order and numbered."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("i"), entry.alias("entry"))))
    numbered = F.transform(listed, lambda x: F.struct(F.concat(F.format_string("%03d: ", x["i"]), x["entry"]).alias("entry"), F.array().cast("array<string>").alias("details")))
    return rows.groupBy(*keys).agg(numbered.alias("history"))


def merge_histories(rows: DataFrame, keys: list[str], column: str = "history") -> DataFrame:
    """One history for each key: entries must agree (else an error), details are joined without repeats."""
    one = rows.select(*keys, F.posexplode(column).alias("i", "h"), F.size(column).alias("n"))
    same = F.when((F.min("h.entry") == F.max("h.entry")) & (F.min("n") == F.max("n")), F.min("h.entry")).otherwise(F.raise_error(F.lit("histories differ")).cast("string"))
    merged = one.groupBy(*keys, "i").agg(F.struct(same.alias("entry"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("h.details")))).alias("details")).alias("h"))
    return merged.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "h"))), lambda x: x["h"]).alias(column))


def tag_parts(key: Column, names: list[str], divider: str = ";") -> dict[str, Column]:
    """Parts of a divided key by name; null where it is shorter."""
    parts = F.split(key, re.escape(divider))
    return {n: F.get(parts, F.lit(k)) for k, n in enumerate(names)}


def tag_cases(rows: DataFrame, key: str, names: list[str], divider: str = ";") -> DataFrame:
    """For each part of the keys its sorted distinct values: (part, values)."""
    parts = tag_parts(F.col(key), names, divider)
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(n).alias("part"), c.alias("v")) for n, c in parts.items()])).alias("s")).select("s.*").dropna().distinct()
    return long.groupBy("part").agg(F.array_sort(F.collect_list("v")).alias("values"))


def first_tags(rows: DataFrame, key: str, divider: str = ";", ignore: list[str] | None = None) -> DataFrame:
    """Distinct first parts but the ignored ones."""
    t = F.split(F.col(key), re.escape(divider))[0]
    return rows.select(t.alias("tag")).where(~F.col("tag").isin(ignore or [])).distinct()


def sub_directory(path: Column, name: str) -> Column:
    """The path with a directory put before its last part."""
    return F.regexp_replace(path, r"([^/]+)$", f"{name}/$1") if name else path


def scan_range(path: Column) -> tuple[Column, Column]:
    """First and last scan of a file named ``..._lo-hi.ext`` or ``..._lo.ext``."""
    low = F.regexp_extract(path, r"_(\d+)(?:-(\d+))?\.", 1)
    high = F.regexp_extract(path, r"_(\d+)(?:-(\d+))?\.", 2)
    lo = F.when(low != "", low.cast("int"))
    return lo, F.when(high != "", high.cast("int")).otherwise(lo)


def files_with_scan(files: DataFrame, scans: DataFrame, path: str = "path", scan: str = "scan", width: int = 16) -> DataFrame:
    from .lookup import interval_join

    lo, hi = scan_range(F.col(path))
    return interval_join(scans, files.withColumn("lo", lo).withColumn("hi", hi).where("lo is not null"), scan, "lo", "hi", float(width))


def file_hashes(spark, path: str) -> DataFrame:
    """MD5 of every file below a path."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", F.md5("content").alias("md5"))


def expand_names(text: str, values: dict[str, str]) -> str:
    """Replaces ``[NAME]`` by its value; an unknown name is an error."""
    return re.sub(r"\[([A-Z_]+)\]", lambda m: values[m[1]], text)


def read_parameters(given: dict, defaults: dict, prefix: str = "", check_types: bool = False) -> dict:
    """Values for the declared parameters: those given with the prefix, else without it, else the defaults."""
    out = {}
    for name, default in defaults.items():
        value = given.get(prefix + name, given.get(name, default))
        if check_types and default is not None and not isinstance(value, type(default)):
            raise TypeError(f"{name} is {type(value).__name__}, not {type(default).__name__}")
        out[name] = value
    return out


def undeclared(given: dict, defaults: dict, prefix: str = "") -> list[str]:
    return sorted(k for k in given if k not in defaults and k.removeprefix(prefix) not in defaults)


def write_parameters(params: dict, prefix: str = "") -> str:
    return json.dumps({prefix + k: v for k, v in sorted(params.items())}, indent=1)


def unmatched(keys: DataFrame, groups: DataFrame, name: str) -> DataFrame:
    """Keys without a group and groups without a key."""
    a = keys.join(groups, name, "left_anti").select(name, F.lit("no group").alias("fault"))
    return a.unionByName(groups.join(keys, name, "left_anti").select(name, F.lit("no key").alias("fault")))


def all_finite(columns: list[str]) -> Column:
    return reduce(lambda a, b: a & b, (F.coalesce(~F.isnan(c) & (F.abs(F.col(c)) != float("inf")), F.lit(False)) for c in columns))
