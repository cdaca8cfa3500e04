"""Whole analyses as chains of operators over pair, treatment and simulation keys.

Everything that the surveyed pipeline loops over (files, pairs of maps, treatments, realisations) is a key column here,
so one plan does all of them and Spark schedules the work.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyquilt.functions import columns as C
from skyquilt.operators import generators, lookup, maps, noise, spectra
from skyquilt.operators import timestream as ts

PIXEL = maps.PIXEL


# Pairs of maps: modes of the cross covariance, cleaned maps for a range of numbers of modes.


def pair_sides(sections: DataFrame, tag: str) -> DataFrame:
    """Every unordered pair of map sections twice over: (pair, side, tag), side 1 and 2."""
    p = lookup.unordered_pairs(sections.select(tag).distinct(), tag)
    name = F.concat("left", F.lit("_with_"), "right")
    return p.select(name.alias("pair"), F.lit(1).alias("side"), F.col("left").alias(tag)).unionByName(p.select(name.alias("pair"), F.lit(2).alias("side"), F.col("right").alias(tag)))


def prepare_pairs(sections: DataFrame, tag: str) -> DataFrame:
    """Sections (tag, pixel, value, weight) as pair members: factorised weights, weighted mean of each frequency removed."""
    return maps.subtract_weighted_mean(factorised(sections.join(lookup.small(pair_sides(sections, tag)), tag), ["pair", "side"]), ["pair", "side", "fi"])


def factorised(rows: DataFrame, keys: list[str], least: float = 2e-20) -> DataFrame:
    """``maps.factorizable_weight`` for each key: weights as a product of a frequency and a position profile."""
    pos = ["ri", "di"]
    noise_ = F.when(F.col("weight") > least, 1 / F.col("weight"))
    f = rows.groupBy(*keys, "fi").agg(F.avg(noise_).alias("nf"))
    p = rows.withColumn("n", noise_).join(f, [*keys, "fi"]).groupBy(*keys, *pos).agg(F.avg(F.try_divide("n", "nf")).alias("np"))
    out = rows.join(f, [*keys, "fi"]).join(p, [*keys, *pos])
    return out.withColumn("weight", F.coalesce(F.try_divide(F.lit(1.0), F.col("nf") * F.col("np")), F.lit(0.0))).drop("nf", "np")


def pair_covariance(members: DataFrame) -> DataFrame:
    """(pair, f1, f2, cov) between the frequencies of side 1 and of side 2: a pixel's frequencies are paired within its row."""
    x = F.col("weight") * F.col("value")
    spec = members.groupBy("pair", "ri", "di").agg(*[F.collect_list(F.when(F.col("side") == s, F.struct(F.col("fi").alias("f"), x.alias("x"), F.col("weight").alias("w")))).alias(f"s{s}") for s in (1, 2)])
    one = spec.select("pair", "s2", F.explode("s1").alias("a")).select("pair", "a", F.explode("s2").alias("b"))
    return one.groupBy("pair", F.col("a.f").alias("f1"), F.col("b.f").alias("f2")).agg(F.try_divide(F.sum(F.col("a.x") * F.col("b.x")), F.sum(F.col("a.w") * F.col("b.w"))).alias("cov"))


def pair_modes(cov: DataFrame, n: int) -> DataFrame:
    """(pair, side, mode, value, fi, v): leading left and right modes of each pair's covariance, which has as many entries as pairs of frequencies."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        f = np.array(sorted(set(pdf["f1"]) | set(pdf["f2"])))
        c = np.zeros((len(f), len(f)))
        c[np.searchsorted(f, pdf["f1"]), np.searchsorted(f, pdf["f2"])] = pdf["cov"].fillna(0)
        u, s, vt = np.linalg.svd(c)
        k = min(n, len(f))
        parts = [pd.DataFrame({"pair": pdf["pair"].iloc[0], "side": side, "mode": np.repeat(np.arange(k), len(f)), "value": np.repeat(s[:k], len(f)), "fi": np.tile(f, k), "v": m[:k].ravel()}) for side, m in ((1, u.T), (2, vt))]
        return pd.concat(parts)

    return cov.groupBy("pair").applyInPandas(run, "pair string, side int, mode int, value double, fi int, v double")


def clean_pairs(members: DataFrame, modes: DataFrame, first: int, last: int) -> DataFrame:
    """Cleaned maps (pair, side, n_modes, pixel, value, weight) with the leading n modes removed, for every n from ``first`` to ``last``.

    Modes of one side are orthonormal, so their parts are removed by a running sum over modes in one pass.
    """
    keys = ["pair", "side", "ri", "di"]
    table = lookup.small(modes.where(F.col("mode") < last).select("pair", "side", "mode", "fi", "v"))
    amp = members.join(table, ["pair", "side", "fi"]).groupBy(*keys, "mode").agg(F.sum(F.col("value") * F.col("v")).alias("a"))
    part = amp.join(table, ["pair", "side", "mode"]).select(*keys, "fi", F.col("mode").alias("m"), (F.col("a") * F.col("v")).alias("p"))
    run = Window.partitionBy(*keys, "fi").orderBy("m").rowsBetween(Window.unboundedPreceding, 0)
    removed = part.withColumn("p", F.sum("p").over(run)).select(*keys, "fi", (F.col("m") + 1).alias("n_modes"), "p")
    wanted = members.withColumn("n_modes", F.explode(F.sequence(F.lit(first), F.lit(last))))
    out = wanted.join(removed, [*keys, "fi", "n_modes"], "left")
    return out.select("pair", "side", "n_modes", "fi", "ri", "di", (F.col("value") - F.coalesce("p", F.lit(0.0))).alias("value"), "weight")


def clean_map_pairs(sections: DataFrame, tag: str, first: int, last: int, external: DataFrame | None = None) -> DataFrame:
    """The whole chain; ``external`` maps (pixel, value, weight) join each member as further channels for finding modes and are left out of the result."""
    members = prepare_pairs(sections, tag)
    if external is None:
        return clean_pairs(members, pair_modes(pair_covariance(members), last), first, last)
    shift = members.agg((F.max("fi") + 1).alias("_n"))
    # The few pairs and sides are one list, which every external cell is spread over.
    sides = members.groupBy("pair", "side").agg(F.max("fi").alias("m")).agg((F.max("m") + 1).alias("_n"), F.collect_list(F.struct("pair", "side")).alias("_sides"))
    more = external.crossJoin(F.broadcast(sides)).select(F.explode("_sides").alias("s"), (F.col("fi") + F.col("_n")).cast("int").alias("fi"), "ri", "di", "value", "weight").select("s.*", "fi", "ri", "di", "value", "weight")
    own = members.select("pair", "side", *PIXEL, "value", "weight")
    both = own.unionByName(more)
    out = clean_pairs(both, pair_modes(pair_covariance(both), last), first, last)
    return out.join(F.broadcast(shift), F.col("fi") < F.col("_n")).drop("_n")


def combine_cleaned(cleaned: DataFrame) -> DataFrame:
    """Weighted mean of all members for each number of modes."""
    return maps.weighted_stack(cleaned, ["n_modes", *PIXEL])


# Power spectra over pairs, treatments and realisations.


def pair_cubes(cubes: DataFrame, pairs: DataFrame, tag: str, extra: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both sides' cubes of each pair (pair, left, right), for each value of the ``extra`` keys such as treatment and sim_id."""
    side = lambda s: cubes.join(lookup.small(pairs.select("pair", F.col(s).alias(tag))), tag).select("pair", *extra, *PIXEL, "value", "weight")
    return side("left"), side("right")


def auto_pairs(cubes: DataFrame, tag: str) -> DataFrame:
    """All unordered pairs of different sections: their noise does not correlate."""
    p = lookup.unordered_pairs(cubes.select(tag).distinct(), tag)
    return p.select(F.concat("left", F.lit("_x_"), "right").alias("pair"), "left", "right")


def noise_pairs(cubes: DataFrame, tag: str) -> DataFrame:
    """Each section with itself."""
    return cubes.select(tag).distinct().select(F.concat(tag, F.lit("_x_"), tag).alias("pair"), F.col(tag).alias("left"), F.col(tag).alias("right"))


def cross_pairs(cubes: DataFrame, tag: str, catalog: str, like: str = "%") -> DataFrame:
    """The catalog (or each mock) with every map: tags that begin with ``catalog`` against the others."""
    tags = cubes.select(tag).distinct()
    a = tags.where(F.col(tag).startswith(catalog)).select(F.col(tag).alias("left"))
    b = tags.where(~F.col(tag).startswith(catalog) & F.col(tag).like(like)).select(F.col(tag).alias("right"))
    return a.crossJoin(F.broadcast(b)).select(F.concat("left", F.lit("_x_"), "right").alias("pair"), "left", "right")


def power_batch(cubes: DataFrame, pairs: DataFrame, tag: str, extra: list[str], shape: tuple[int, int, int], spacing: tuple[float, float, float], edges: list[float] | None = None, window_axes: tuple[int, ...] | None = (0,)) -> DataFrame:
    """Power of every pair for every treatment and realisation: binned by k with ``edges``, else cell by cell."""
    left, right = pair_cubes(cubes, pairs, tag, extra)
    cells = spectra.pair_spectra(left, right, ["pair", *extra], shape, spacing, window_axes)
    return cells if edges is None else spectra.radial_bins(cells, ["pair", *extra], edges)


def pair_summary(power: DataFrame, keys: list[str], path: str | None = None) -> DataFrame:
    """Mean and deviation over pairs in each bin, written as text where a path is given."""
    out = spectra.statistics(power, keys)
    if path:
        from skyquilt.sources.fits import write_text

        write_text(out, path, [*keys, "mean", "std", "n"])
    return out


def drop_cleaned(spark: SparkSession, path: str) -> bool:
    """Deletes intermediate cleaned maps."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


# Noise of time streams.


def preprocess(samples: DataFrame, keys: list[str], most: float = 4.0) -> DataFrame:
    """Streams (keys, scan, chan, t, value) without the mean and slope of each scan, with the variance of each channel and bad channels at infinite variance."""
    from skyquilt.operators.noise_model import bad_channels

    flat = ts.detrend(samples, [*keys, "scan", "chan"], "t")
    return bad_channels(flat, keys, most)


def measure_noise(rows: DataFrame, keys: list[str], n_time: int, n_freq: int, n_modes: int, dt: float, f0: float) -> tuple[DataFrame, DataFrame]:
    """Noise of each key's streams (keys, chan, t, value): variances of channels left after its dominant modes, and the 1/f fit of each mode.

    The modes are those of the low-frequency power matrix of each key; streams are projected on them by joins.
    """
    matrix = noise.low_power_matrix(rows, keys, n_time, n_freq)
    from skyquilt.operators.factor import eigen_blocks

    eigen = eigen_blocks(matrix.select(*keys, F.col("chan").alias("row"), F.col("chan2").alias("col"), F.col("cov").alias("value")), keys)
    table = eigen.where(F.col("mode") < n_modes).select(*keys, "mode", F.posexplode("vector").alias("chan", "v"))
    amp = rows.join(lookup.small(table), [*keys, "chan"]).groupBy(*keys, "mode", "t").agg(F.sum(F.col("value") * F.col("v")).alias("value"))
    part = amp.join(lookup.small(table), [*keys, "mode"]).groupBy(*keys, "chan", "t").agg(F.sum(F.col("value") * F.col("v")).alias("_p"))
    rest = rows.join(part, [*keys, "chan", "t"], "left").withColumn("value", F.col("value") - F.coalesce("_p", F.lit(0.0)))
    variance = rest.groupBy(*keys, "chan").agg(F.var_pop("value").alias("var"))
    series = amp.select(*keys, "mode", F.col("t").cast("int").alias("slot"), "value", F.lit(1.0).alias("mask"))
    power = spectra.series_power(series, [*keys, "mode"], n_time, dt=dt)
    return variance, noise.fit_over_f(power, [*keys, "mode"], f0)


def power_matrices(rows: DataFrame, keys: list[str], n_time: int, n_freq: int, split: str | None = None) -> DataFrame:
    """Channel-by-channel low-frequency power of each key, averaged over the scans in ``split`` where it is given."""
    by = keys + [split] if split else keys
    m = noise.low_power_matrix(rows, by, n_time, n_freq)
    return m if not split else m.groupBy(*keys, "chan", "chan2").agg(F.avg("cov").alias("cov"))


def solved_gains(gains: DataFrame, keys: list[str], scan: str = "scan") -> DataFrame:
    """Gains of all scans as one array for each key, in order of scans."""
    return gains.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(scan, "gain"))), lambda x: x["gain"]).alias("gains"))


def clean_map(dirty: DataFrame, inverse: DataFrame, keys: list[str]) -> DataFrame:
    """Clean map from a dirty one by the kind of inverse noise: a ``noise_inv`` column is diagonal, (row, col, value) entries are solved block by block."""
    if "noise_inv" in inverse.columns:
        return maps.clean_diagonal(dirty.join(inverse, [*keys, "p"]).withColumn("fi", F.struct(*keys) if keys else F.lit(0))).select(*keys, "p", "value")
    return maps.solve_channels(dirty, inverse, keys)


def pixel_covariance(spark: SparkSession, n_freq: int, reach: int, spacing: float, correlation: Callable[[Column, Column], Column], widths: tuple[float, float]) -> DataFrame:
    """Covariance of map cells by (f1, f2, dr, dd), which is all that a stationary signal's depends on: correlation of angular distance and frequency lag, seen through the beams' summed widths."""
    f = spark.range(n_freq).select(F.col("id").cast("int").alias("f1"))
    o = spark.range(-reach, reach + 1)
    offsets = o.select(F.col("id").cast("int").alias("dr")).crossJoin(o.select(F.col("id").cast("int").alias("dd")))
    cells = f.crossJoin(f.withColumnRenamed("f1", "f2")).crossJoin(F.broadcast(offsets))
    r2 = (F.col("dr") ** 2 + F.col("dd") ** 2) * spacing**2
    beam = F.exp(-r2 / (2 * (widths[0] ** 2 + widths[1] ** 2)))
    return cells.withColumn("value", correlation(F.sqrt(r2), F.abs(F.col("f1") - F.col("f2")).cast("double")) * beam)


# Simulations.


def signal_products(signal: DataFrame, kernel: list[tuple[int, int, float]], weight: DataFrame, optical: Column, seed: int) -> DataFrame:
    """All products of simulated cubes (sim_id, pixel, value) in one table (sim_id, product, pixel, value): raw, density, optical counts, seen through the beam, and that with its weighted mean removed."""
    keys = ["sim_id", *PIXEL]
    delta = signal.withColumn("value", F.col("value") - F.avg("value").over(Window.partitionBy("sim_id", "fi")))
    counts = generators.poisson_counts(signal.select(*keys), optical, seed).select(*keys, F.col("n").cast("double").alias("value"))
    steps = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(w).alias("w")) for i, j, w in kernel])).alias("s")
    spread = signal.select("sim_id", "fi", "ri", "di", "value", steps).groupBy("sim_id", "fi", (F.col("ri") + F.col("s.i")).alias("ri"), (F.col("di") + F.col("s.j")).alias("di")).agg(F.sum(F.col("value") * F.col("s.w")).alias("v"))
    beam = signal.select(*keys).join(spread, keys).select(*keys, F.col("v").alias("value"))
    flat = maps.subtract_weighted_mean(beam.join(weight.select(*PIXEL, "weight"), PIXEL), ["sim_id", "fi"])
    named = {"raw": signal, "delta": delta, "optical": counts, "beam": beam, "beam_meansub": flat}
    out = None
    for name, df in named.items():
        part = df.select("sim_id", F.lit(name).alias("product"), *PIXEL, F.col("value").cast("double").alias("value"))
        out = part if out is None else out.unionByName(part)
    return out


def simulated_maps(signal: DataFrame, sims: int, temperature: Column, bandwidth: float, seconds: Column, multiplier: float, seed: int) -> DataFrame:
    """Thermal noise of each realisation plus one signal times a multiplier: (sim_id, pixel, signal, thermal, value)."""
    each = signal.withColumn("sim_id", F.explode(F.sequence(F.lit(0), F.lit(sims - 1))))
    draw = generators.normal(seed, "sim_id", *PIXEL) * temperature / F.sqrt(F.lit(float(bandwidth)) * seconds)
    return each.select("sim_id", *PIXEL, (F.col("value") * multiplier).alias("signal"), draw.alias("thermal")).withColumn("value", F.col("signal") + F.col("thermal"))


# Files, keys and results kept by their parameters.


def file_family(spark: SparkSession, key: str, path: str, lists: dict[str, list[str] | DataFrame]) -> DataFrame:
    """A registered set of files: one row (db_key, path, names...) for every combination of short lists; ``{name}`` in both templates is replaced.

    A list is given as such or as the one column of a table, which is not collected.
    """
    rows = spark.range(1).select()
    for name, values in lists.items():
        if isinstance(values, DataFrame):
            rows = rows.crossJoin(values.select(F.col(values.columns[0]).cast("string").alias(name)).distinct())
        else:
            rows = rows.select("*", F.explode(F.array(*[F.lit(v) for v in values])).alias(name))

    def fill(text: str) -> Column:
        out = F.lit(text)
        for name in lists:
            out = F.replace(out, F.lit("{" + name + "}"), F.col(name))
        return out

    return rows.select(fill(key).alias("db_key"), fill(path).alias("path"), *lists)


def mode_family(spark: SparkSession, source: str, user: str, modes: list[int] | DataFrame, sections: list[str] | DataFrame) -> DataFrame:
    """The files of a run that removes modes: map, weight and noise of every section and number of modes."""
    lists = {"kind": ["map", "weight", "noise_inv"], "section": sections, "modes": modes if isinstance(modes, DataFrame) else [str(m) for m in modes]}
    return file_family(spark, source + "_cleaned:{section};{kind};{modes}modes", f"{user}/{source}/{{kind}}_{{section}}_{{modes}}modes.npy", lists)


def fetch(catalog: DataFrame, key: str, pick: str | None = None) -> DataFrame:
    """The files of a key, or the one that ``key:pick`` names; none for an unknown key."""
    return catalog.where(F.col("db_key") == f"{key}:{pick}" if pick else F.col("db_key").startswith(key))


def with_files(keys: DataFrame, catalog: DataFrame, sub: str = "") -> DataFrame:
    """Keys with their paths, in a sub-directory where it is given; keys without a file have a null path."""
    from skyquilt.operators.lineage import sub_directory

    out = keys.join(catalog.select("db_key", "path"), "db_key", "left")
    return out.withColumn("path", sub_directory(F.col("path"), sub)) if sub else out


def session_files(manifest: DataFrame, aliases: DataFrame, sessions: list[int], field: str, kind: str) -> DataFrame:
    """Files of the sessions whose field is an alias of ``field`` and whose kind fits: (session, path, first_scan, last_scan)."""
    from skyquilt.operators.lineage import scan_range

    low, high = scan_range(F.col("path"))
    chosen = manifest.where(F.col("session").isin(sessions) & (F.col("kind") == kind))
    return chosen.join(lookup.small(aliases.where(F.col("field") == field).select("alias").distinct()), chosen["field_name"] == F.col("alias"), "left_semi").select("session", "path", low.alias("first_scan"), high.alias("last_scan"))


def calibrator_files(manifest: DataFrame, calibrator: str) -> DataFrame:
    """On and off scans of a calibrator: files named after it, with their kind."""
    return manifest.where(F.lower("field_name").startswith(calibrator.lower())).select("session", "path", "kind")


def unwanted_scans(scans: DataFrame, blacklist: DataFrame) -> DataFrame:
    """The procedure's scans without those on the blacklist, by session and scan."""
    return scans.join(blacklist, ["session", "scan"], "left_anti")


def checked(df: DataFrame, types: dict[str, str], scalar: list[str] | None = None, keys: list[str] | None = None) -> DataFrame:
    """The table if its fields are as declared: names and types at once, and fields that must have one value in each key when it is read."""
    for name, kind in types.items():
        if name not in df.columns:
            raise ValueError(f"{name} is missing")
        if df.schema[name].dataType.simpleString() != kind:
            raise ValueError(f"{name} is {df.schema[name].dataType.simpleString()}, not {kind}")
    return ts.check_order(df, keys or [], scalar or [])


def set_field(df: DataFrame, name: str, value: Column, axes: list[str], kind: str) -> DataFrame:
    """Adds a field with its declared axes and type; axes that the table lacks are an error."""
    missing = [a for a in axes if a not in df.columns]
    if missing:
        raise ValueError(f"{name} has axes {missing} that the table lacks")
    return df.withColumn(name, value.cast(kind)).withMetadata(name, {"axes": axes})


def read_history(texts: DataFrame, column: str) -> DataFrame:
    """A history kept as JSON text; text of another form gives null and is never run."""
    return texts.withColumn(column, F.from_json(column, "array<struct<entry:string,details:array<string>>>"))


def kept_table(spark: SparkSession, folder: str, name: str, params: dict, build: Callable[[], DataFrame]) -> DataFrame:
    """A table that is built once for each set of parameters: kept as Parquet under their hash, and read again afterwards.

    The commit marker of a finished write tells a whole table from one that was broken off, so there are no
    lock files; a broken one is written anew.
    """
    key = hashlib.sha256(json.dumps([name, params], sort_keys=True).encode()).hexdigest()[:24]
    path = f"{folder.rstrip('/')}/{name}-{key}"
    jvm = spark.sparkContext._jvm
    marker = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not marker.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(marker):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def over_parameters(table: DataFrame, cases: DataFrame, apply: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """One plan over a short table of cases instead of a loop of calls: every row meets every case, and ``apply`` works on the case columns."""
    return apply(table.crossJoin(lookup.small(cases)))


def timed(name: str, apply: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A step that says how long planning took; what it costs to run is in Spark's own event log."""

    def run(*args, **kwargs) -> DataFrame:
        began = time.time()
        out = apply(*args, **kwargs)
        print(f"{name}: planned in {time.time() - began:.2f} s")
        return out

    return run


def average_modes(modes: DataFrame, keys: list[str]) -> DataFrame:
    """Mean of the modes of all pairs, with the sign of their largest entry made positive first."""
    w = Window.partitionBy(*keys, "pair", "side")
    sign = F.signum(F.max_by("v", F.abs(F.col("v"))).over(w))
    return modes.withColumn("v", F.col("v") * sign).groupBy(*keys, "fi").agg(F.avg("v").alias("v"))


def correlation_statistics(corr: DataFrame, keys: list[str]) -> DataFrame:
    """Mean, deviation and number of the correlations of a batch of realisations in each bin."""
    return corr.groupBy(*keys).agg(F.avg("corr").alias("mean"), F.stddev_samp("corr").alias("std"), F.count("corr").alias("n"))


def average_loss(cleaned: DataFrame, reference: DataFrame, keys: list[str]) -> DataFrame:
    """Mean over realisations of what cleaning leaves of the correlation in each bin."""
    j = cleaned.join(reference.select("sim_id", *keys, F.col("corr").alias("_r")), ["sim_id", *keys])
    return j.groupBy(*keys).agg(F.avg(F.try_divide("corr", "_r")).alias("transfer"))


def plot_slice(cells: DataFrame, axis: str, index: int, x: str, y: str) -> DataFrame:
    """The table behind a picture of one slice of a cube: x, y and value in order."""
    return cells.where(F.col(axis) == index).select(x, y, "value").orderBy(x, y)


def empty_map(spark: SparkSession, n_freq: int, freq: tuple[float, float], centre: tuple[float, float], shape: tuple[int, int], spacing: tuple[float, float]) -> DataFrame:
    """A map without values yet: pixels with their coordinates, for every frequency."""
    from skyquilt.operators.algebra import map_grid

    f = spark.range(n_freq).select(F.col("id").cast("int").alias("fi"), (F.lit(freq[0]) + F.col("id") * freq[1]).alias("freq"))
    return map_grid(spark, centre, shape, spacing).crossJoin(F.broadcast(f)).withColumn("value", F.lit(None).cast("double"))


def ingest_samples(raw: DataFrame, n_pol: int, average: int) -> DataFrame:
    """Telescope records (scan, record, data binary of time x pol x channel bytes, scale, offset arrays by pol x channel) to averaged rows (scan, t, pol, chan, value).

    The first polarisation's bytes are unsigned, the others signed; ``average`` times are averaged after
    scale and offset are applied.
    """
    place = F.posexplode(F.transform(F.sequence(F.lit(1), F.octet_length("data")), lambda i: F.conv(F.hex(F.substring("data", i, F.lit(1))), 16, 10).cast("int"))).alias("i", "b")
    n_chan = (F.size("scale") / n_pol).cast("int")
    rows = raw.select("scan", "record", n_chan.alias("n"), "scale", "offset", place)
    pol, chan = F.floor(F.col("i") / F.col("n")) % n_pol, F.col("i") % F.col("n")
    t = F.floor(F.col("i") / (F.col("n") * n_pol))
    at = rows.select("scan", "record", t.alias("s"), pol.cast("int").alias("pol"), chan.cast("int").alias("chan"), F.when((pol > 0) & (F.col("b") > 127), F.col("b") - 256).otherwise(F.col("b")).alias("b"), F.try_element_at("scale", (pol * F.col("n") + chan + 1).cast("int")).alias("k"), F.try_element_at("offset", (pol * F.col("n") + chan + 1).cast("int")).alias("o"))
    return at.groupBy("scan", "record", F.floor(F.col("s") / average).alias("t"), "pol", "chan").agg(F.avg(F.col("b") * F.col("k") + F.col("o")).alias("value"))


def source_track(times: DataFrame, key: str, ts_column: str, ra: float, dec: float) -> DataFrame:
    """Azimuth and elevation of a source at the times of a table."""
    az, el = C.sky_to_horizon(F.lit(ra), F.lit(dec), C.sidereal_degrees(F.col(ts_column)))
    return times.select(key, az.alias("az"), el.alias("el"))
