"""Time-stream steps on long spectra: one row for each key, time ``t``, channel ``chan`` and ``value`` (null: masked).

Every step is a plain DataFrame -> DataFrame function. ``keys`` name the columns of an independent stream,
such as scan, band, pol and cal.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Keys = list[str]


def explode_spectra(spectra: DataFrame, array: str, keep: Keys) -> DataFrame:
    """Rows of arrays to rows of channels; non-finite values are masked."""
    value = F.col("value").cast("double")
    return spectra.select(*keep, F.posexplode(array).alias("chan", "value")).withColumn("value", F.when(F.isnan(value) | (F.abs(value) == float("inf")), None).otherwise(value))


def collect_spectra(rows: DataFrame, keys: Keys) -> DataFrame:
    """Rows of channels back to arrays in channel order."""
    pairs = F.array_sort(F.collect_list(F.struct("chan", "value")))
    return rows.groupBy(*keys).agg(F.transform(pairs, lambda x: x["value"]).alias("spec"))


def mask_frequency_range(rows: DataFrame, low: float, high: float, freq: str = "freq", width: float = 1.0) -> DataFrame:
    """Masks channels that lie wholly in [low, high]."""
    inside = (F.col(freq) + abs(width) / 2 <= high) & (F.col(freq) - abs(width) / 2 >= low)
    return rows.withColumn("value", F.when(~inside, F.col("value")))


def trim(rows: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """Keeps rows strictly inside all bounds."""
    return rows.where(reduce(lambda a, b: a & b, ((F.col(c) > lo) & (F.col(c) < hi) for c, (lo, hi) in bounds.items())))


def hanning(rows: DataFrame, keys: Keys) -> DataFrame:
    """Three-tap smoothing along channels; null where a neighbour is masked or missing."""
    w = Window.partitionBy(*keys).orderBy("chan")
    near = (F.lag("value").over(w), F.col("value"), F.lead("value").over(w))
    return rows.withColumn("value", 0.25 * near[0] + 0.5 * near[1] + 0.25 * near[2])


def bound(x: Column, f) -> Column:
    """f(x) with x worked out once: written plainly, a lambda inside f works it out again for each of its elements."""
    return F.transform(F.array(x), f)[0]


def hanning_array(spec: Column) -> Column:
    """The same on an array column, without a window or an exchange."""

    def smooth(s: Column) -> Column:
        get = lambda i: F.try_element_at(s, i)
        return F.transform(F.sequence(F.lit(1), F.size(s)), lambda i: F.when((i > 1) & (i < F.size(s)), 0.25 * get(i - 1) + 0.5 * get(i) + 0.25 * get(F.least(i + 1, F.size(s)))))

    return bound(spec, smooth)


def rebin_frequency(rows: DataFrame, keys: Keys, n: int, how: str = "mean") -> DataFrame:
    """Mean or median of n neighbouring channels; the last bin may hold fewer."""
    agg = {"mean": F.avg, "median": F.median}[how]
    return rows.groupBy(*keys, F.floor(F.col("chan") / n).cast("int").alias("chan")).agg(agg("value").alias("value"))


def rebin_frequency_width(rows: DataFrame, keys: Keys, width: float, freq: str = "freq", how: str = "mean") -> DataFrame:
    """Channels go to the nearest centre of bins ``width`` wide."""
    agg = {"mean": F.avg, "median": F.median}[how]
    return rows.groupBy(*keys, (F.rint(F.col(freq) / width) * width).alias(freq)).agg(agg("value").alias("value"))


def rebin_array(spec: Column, n: int) -> Column:
    """Mean of n neighbours in an array; null ones do not count, a short tail is dropped."""
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("n"))
    add = lambda acc, x: F.struct((acc["sum"] + F.coalesce(x, F.lit(0.0))).alias("sum"), (acc["n"] + x.isNotNull().cast("int")).alias("n"))
    mean = lambda acc: F.try_divide(acc["sum"], acc["n"])
    bins = lambda s: F.transform(F.sequence(F.lit(0), F.floor(F.size(s) / n).cast("int") - 1), lambda i: F.aggregate(F.slice(s, i * n + 1, n), start, add, mean))
    return bound(spec, lambda s: F.when(F.size(s) >= n, bins(s)).otherwise(F.array().cast("array<double>")))


def rebin_time(rows: DataFrame, keys: Keys, n: int, t: str = "t") -> DataFrame:
    """Mean of n consecutive times; the tail that fills no bin is dropped. Times are numbered from 0 in each key."""
    scan = [k for k in keys if k != "chan"]
    last = rows.groupBy(*scan).agg((F.floor((F.max(t) + 1) / n) * n).alias("_end"))
    kept = (rows.join(last, scan) if scan else rows.crossJoin(F.broadcast(last))).where(F.col(t) < F.col("_end"))
    return kept.groupBy(*scan, "chan", F.floor(F.col(t) / n).cast("long").alias(t)).agg(F.avg("value").alias("value"))


def split_bands(rows: DataFrame, n_bands: int, width: int, offset: int = 0) -> DataFrame:
    """Cuts ``n_bands`` neighbouring bands of ``width`` channels from ``offset`` on; channels are numbered anew."""
    at = F.col("chan") - offset
    return rows.where((at >= 0) & (at < n_bands * width)).withColumn("band", F.floor(at / width).cast("int")).withColumn("chan", F.pmod(at, F.lit(width)))


def split_band_array(spectra: DataFrame, array: str, n_bands: int, width: int, offset: int = 0) -> DataFrame:
    """The same on arrays; a band that does not fit is an error."""
    fits = F.when(F.size(array) >= offset + n_bands * width, F.col(array)).otherwise(F.raise_error(F.lit("bands do not fit")).cast("array<double>"))
    one = spectra.withColumn("band", F.explode(F.sequence(F.lit(0), F.lit(n_bands - 1))))
    return one.withColumn(array, F.slice(fits, F.col("band") * width + offset + 1, F.lit(width)))


def stitch(rows: DataFrame, keys: Keys, overlap: int, width: int) -> DataFrame:
    """Joins bands that overlap by ``overlap`` channels: each next band is scaled by the ratio of means in the middle third of the overlap and cut at its middle."""
    third = overlap // 3
    step = width - overlap
    upper = rows.where((F.col("chan") >= step + third) & (F.col("chan") < step + 2 * third)).groupBy(*keys, "band").agg(F.avg("value").alias("up"))
    lower = rows.where((F.col("chan") >= third) & (F.col("chan") < 2 * third)).groupBy(*keys, (F.col("band") - 1).alias("band")).agg(F.avg("value").alias("down"))
    ratio = upper.join(lower, [*keys, "band"]).select(*keys, (F.col("band") + 1).alias("band"), F.log(F.try_divide("up", "down")).alias("g"))
    w = Window.partitionBy(*keys).orderBy("band").rowsBetween(Window.unboundedPreceding, 0)
    gain = ratio.withColumn("gain", F.exp(F.sum("g").over(w))).drop("g")
    half = overlap // 2
    out = rows.join(gain, [*keys, "band"], "left").withColumn("value", F.col("value") * F.coalesce("gain", F.lit(1.0))).drop("gain")
    last = F.max("band").over(Window.partitionBy(*keys))
    out = out.withColumn("_last", last)
    keep = ((F.col("band") == 0) | (F.col("chan") >= overlap - half)) & ((F.col("band") == F.col("_last")) | (F.col("chan") < width - half))
    return out.where(keep).select(*keys, (F.col("band") * step + F.col("chan")).alias("chan"), "value")


# New polarisation from old ones, (code: weight).
ROTATIONS = {
    "I": {"XX": 0.5, "YY": 0.5},
    "Q": {"XX": -0.5, "YY": 0.5},
    "U": {"XY": 1.0},
    "V": {"YX": 1.0},
}


def rotate_polarisation(rows: DataFrame, keys: Keys, new: list[str], table: dict = ROTATIONS, pol: str = "pol") -> DataFrame:
    """Linear change of the polarisation basis; null where a part is masked or missing."""
    old = sorted({p for n in new for p in table[n]})
    wide = rows.groupBy(*keys).pivot(pol, old).agg(F.first("value"))
    made = [F.struct(F.lit(n).alias(pol), reduce(lambda a, b: a + b, [F.col(p) * w for p, w in table[n].items()]).alias("value")) for n in new]
    return wide.select(*keys, F.explode(F.array(*made)).alias("s")).select(*keys, "s.*")


def combine_cal(rows: DataFrame, keys: Keys, weights: tuple[float, float] = (0.5, 0.5), subtract_mean: bool = False, t: str = "t") -> DataFrame:
    """Weighted sum of calibrator on and off; null where either is; optionally less its mean over time."""
    on, off = (F.max(F.when(F.col("cal") == c, F.col("value"))) for c in ("T", "F"))
    out = rows.groupBy(*keys).agg((weights[0] * on + weights[1] * off).alias("value"))
    if subtract_mean:
        out = out.withColumn("value", F.col("value") - F.avg("value").over(Window.partitionBy(*[k for k in keys if k != t])))
    return out


def scale_by_cal(rows: DataFrame, keys: Keys, t: str = "t") -> DataFrame:
    """Divides on and off by the mean over time of their difference; a mean of zero or less masks."""
    on, off = (F.max(F.when(F.col("cal") == c, F.col("value"))) for c in ("T", "F"))
    diff = rows.groupBy(*keys).agg((on - off).alias("d"))
    fixed = [k for k in keys if k != t]
    mean = diff.groupBy(*fixed).agg(F.avg("d").alias("m")).withColumn("m", F.when(F.col("m") > 0, F.col("m")))
    return rows.join(mean, fixed, "left").withColumn("value", F.try_divide("value", "m")).drop("m")


def subtract_mean(rows: DataFrame, keys: Keys) -> DataFrame:
    """Value less the mean of what is not masked in each key."""
    return rows.withColumn("value", F.col("value") - F.avg("value").over(Window.partitionBy(*keys)))


def time_variance(rows: DataFrame, keys: Keys) -> DataFrame:
    """Population variance over time; masked where one or no sample, or no variance, is left."""
    var = F.avg(F.col("value") * F.col("value")) - F.avg("value") * F.avg("value")
    return rows.groupBy(*keys).agg(F.count("value").alias("n"), var.alias("v")).select(*keys, "n", F.when((F.col("n") > 1) & (F.col("v") > 0), F.col("v")).alias("variance"))


def noisy_channels(rows: DataFrame, streams: Keys, scan: Keys, sigma: float = 6.0) -> DataFrame:
    """Channels whose variance over mean squared exceeds mean + sigma * deviation over channels in any stream of a scan."""
    v = rows.groupBy(*scan, *streams, "chan").agg(F.var_pop("value").alias("v"), F.avg("value").alias("m")).withColumn("r", F.try_divide("v", F.col("m") * F.col("m")))
    w = Window.partitionBy(*scan, *streams)
    return v.withColumn("cut", F.avg("r").over(w) + sigma * F.stddev_pop("r").over(w)).where("r > cut").select(*scan, "chan").distinct()


def flag_channels(rows: DataFrame, streams: Keys, scan: Keys, sigma: float = 6.0) -> DataFrame:
    """One pass: masks noisy channels in all streams of their scan."""
    bad = noisy_channels(rows, streams, scan, sigma).withColumn("_bad", F.lit(True))
    return rows.join(bad, [*scan, "chan"], "left").withColumn("value", F.when(F.col("_bad").isNull(), F.col("value"))).drop("_bad")


def flag_channels_until_stable(rows: DataFrame, streams: Keys, scan: Keys, sigma: float = 6.0) -> DataFrame:
    """Passes until none finds a new channel, so at most one more than there are channels. A channel's variance does not depend on others, so passes run on one row for each channel of a scan."""
    import pandas as pd

    v = rows.groupBy(*scan, *streams, "chan").agg(F.var_pop("value").alias("v"), F.avg("value").alias("m")).withColumn("r", F.try_divide("v", F.col("m") * F.col("m"))).select(*scan, *streams, "chan", "r")
    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in scan)

    def passes(pdf: pd.DataFrame) -> pd.DataFrame:
        left, bad = pdf, set()
        while True:
            by = left.groupby(streams)["r"] if streams else None
            mean = by.transform("mean") if streams else left["r"].mean()
            spread = by.transform(lambda x: x.std(ddof=0)) if streams else left["r"].std(ddof=0)
            new = set(left.loc[left["r"] > mean + sigma * spread, "chan"])
            if not new:
                break
            bad |= new
            left = left[~left["chan"].isin(new)]
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] * len(bad) for k in scan}, "chan": sorted(bad), "_bad": True})

    bad = v.groupBy(*scan).applyInPandas(passes, f"{kinds}, chan int, _bad boolean")
    return rows.join(bad, [*scan, "chan"], "left").withColumn("value", F.when(F.col("_bad").isNull(), F.col("value"))).drop("_bad")


def flag_times(rows: DataFrame, scan: Keys, sigma: float = 3.0, size: int = 40, t: str = "t") -> DataFrame:
    """Masks ``size`` times before and ``size`` - 1 after each whose mean over channels exceeds mean + sigma * deviation of the scan."""
    mean = rows.groupBy(*scan, t).agg(F.avg("value").alias("m"))
    w = Window.partitionBy(*scan)
    hit = (F.col("m") > F.avg("m").over(w) + sigma * F.stddev_pop("m").over(w)).cast("int")
    near = Window.partitionBy(*scan).orderBy(t).rangeBetween(-(size - 1), size)
    bad = mean.withColumn("hit", hit).withColumn("near", F.max("hit").over(near)).select(*scan, t, "near")
    return rows.join(bad, [*scan, t]).withColumn("value", F.when(F.coalesce("near", F.lit(0)) == 0, F.col("value"))).drop("near")


def clip_rms(rows: DataFrame, keys: Keys, sigma: float = 3.0, passes: int = 3) -> DataFrame:
    """Masks values beyond sigma deviations of their key, pass after pass."""
    w = Window.partitionBy(*keys)
    for _ in range(passes):
        rows = rows.withColumn("value", F.when(F.abs(F.col("value") - F.avg("value").over(w)) <= sigma * F.stddev_pop("value").over(w), F.col("value")))
    return rows


def reflag(raw: DataFrame, cleaned: DataFrame, keys: Keys) -> DataFrame:
    """Raw values, masked where the cleaned file is masked or lacks the sample."""
    return raw.join(cleaned.select(*keys, F.col("value").alias("_c")), keys, "left").withColumn("value", F.when(F.col("_c").isNotNull(), F.col("value"))).drop("_c")


def boxcar(rows: DataFrame, keys: Keys, size: int, t: str = "t") -> DataFrame:
    """Centred mean over an odd number of times; null where the window is cut by an edge or holds a masked value."""
    half = size // 2
    w = Window.partitionBy(*keys).orderBy(t).rowsBetween(-half, half)
    return rows.withColumn("smooth", F.when(F.count("value").over(w) == 2 * half + 1, F.avg("value").over(w)))


def boxcar_gain(rows: DataFrame, gain: DataFrame, keys: Keys, size: int, t: str = "t") -> DataFrame:
    """Divides by the smoothed gain of each time."""
    smooth = boxcar(gain, keys, size, t).select(*keys, t, "smooth")
    return rows.join(smooth, [*keys, t], "left").withColumn("value", F.try_divide("value", "smooth")).drop("smooth")


def detrend(rows: DataFrame, keys: Keys, x: str = "t") -> DataFrame:
    """Value less the straight line fitted to each key."""
    both = F.when(F.col("value").isNotNull(), F.col(x).cast("double"))
    fit = rows.groupBy(*keys).agg(F.regr_slope("value", both).alias("_a"), F.regr_intercept("value", both).alias("_b"))
    return rows.join(fit, keys).withColumn("value", F.col("value") - (F.col("_a") * F.col(x) + F.col("_b"))).drop("_a", "_b")


def gaussian_smooth(rows: DataFrame, keys: Keys, fwhm: float, reach: int, t: str = "t") -> DataFrame:
    """Gaussian smoothing in time over ``reach`` steps on both sides, divided by the weights of what is not masked: one ordered window, no copies of rows."""
    sigma = fwhm / 2.354820045
    w = Window.partitionBy(*keys).orderBy(t).rangeBetween(-reach, reach)
    near = F.collect_list(F.when(F.col("value").isNotNull(), F.struct(F.col(t).alias("t"), F.col("value").alias("v")))).over(w)
    weight = lambda x: F.exp(-0.5 * ((x["t"] - F.col(t)) / sigma) ** 2)
    add = lambda acc, x: F.struct((acc["v"] + x["v"] * weight(x)).alias("v"), (acc["w"] + weight(x)).alias("w"))
    start = F.struct(F.lit(0.0).alias("v"), F.lit(0.0).alias("w"))
    return rows.withColumn("_near", near).withColumn("smooth", F.aggregate("_near", start, add, lambda acc: F.try_divide(acc["v"], acc["w"]))).drop("_near")


def filter_foregrounds(rows: DataFrame, keys: Keys, bands: int, channels: int, fwhm: float = 10.0, t: str = "t") -> DataFrame:
    """Sub-band means, less their mean over time, smoothed in time and subtracted from the band's channels."""
    width = -(-channels // bands)
    sub = F.floor(F.col("chan") / width).cast("int")
    mean = rows.groupBy(*keys, t, sub.alias("sub")).agg(F.avg("value").alias("value"))
    mean = mean.withColumn("value", F.col("value") - F.avg("value").over(Window.partitionBy(*keys, "sub")))
    smooth = gaussian_smooth(mean, [*keys, "sub"], fwhm, int(2 * fwhm), t).select(*keys, "sub", t, "smooth")
    return rows.withColumn("sub", sub).join(smooth, [*keys, "sub", t], "left").withColumn("value", F.col("value") - F.coalesce("smooth", F.lit(0.0))).drop("smooth", "sub")


def check_order(records: DataFrame, keys: Keys, constant: Keys) -> DataFrame:
    """The records; an error where one of ``constant`` has several values in a key, such as sidereal times that differ between polarisations."""
    w = Window.partitionBy(*keys)
    for c in constant:
        same = F.min(c).over(w).eqNullSafe(F.max(c).over(w))
        records = records.withColumn(c, F.when(same, F.col(c)).otherwise(F.raise_error(F.lit(f"{c} is not constant")).cast(records.schema[c].dataType)))
    return records


def good_gains(rows: DataFrame, gains: DataFrame, keys: Keys, low: float = 0.5, high: float = 2.0) -> DataFrame:
    """Rows of blocks all of whose gains lie strictly between the bounds."""
    good = gains.groupBy(*keys).agg(F.bool_and((F.col("gain") > low) & (F.col("gain") < high)).alias("ok")).where("ok")
    return rows.join(good.select(*keys), keys, "left_semi")


def time_grid(rows: DataFrame, keys: Keys, dt: float, n: int, t: str = "t_sec") -> DataFrame:
    """Samples on a uniform grid of ``n`` times with zeros where none is: slot, value and mask; two samples in a slot are an error."""
    slot = F.rint((F.col(t) - F.min(t).over(Window.partitionBy(*keys))) / dt).cast("int")
    one = rows.withColumn("slot", slot).groupBy(*keys, "slot").agg(F.when(F.count("*") > 1, F.raise_error(F.lit("samples overlap")).cast("double")).otherwise(F.first("value")).alias("value"))
    grid = rows.select(*keys).distinct().withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    out = grid.join(one, [*keys, "slot"], "left")
    return out.select(*keys, "slot", F.coalesce("value", F.lit(0.0)).alias("value"), F.col("value").isNotNull().cast("double").alias("mask"))


def fold_on_cal(rows: DataFrame, keys: Keys, period: int, t: str = "t") -> DataFrame:
    """Profile over the calibrator's period: on where a phase is 0.8 deviations above the mean, off where 0.7 below, else blank."""
    profile = rows.groupBy(*keys, F.pmod(F.col(t), F.lit(period)).alias("phase")).agg(F.avg("value").alias("value"))
    w = Window.partitionBy(*keys)
    z = (F.col("value") - F.avg("value").over(w)) / F.stddev_pop("value").over(w)
    return profile.withColumn("state", F.when(z > 0.8, "on").when(z < -0.7, "off").otherwise("blank"))


def sessions(rows: DataFrame, keys: Keys, gap: float, t: str = "t_sec") -> DataFrame:
    """Numbers blocks that follow each other within ``gap``."""
    w = Window.partitionBy(*keys).orderBy(t)
    new = F.coalesce((F.col(t) - F.lag(t).over(w) > gap).cast("int"), F.lit(0))
    return rows.withColumn("_new", new).withColumn("block", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def scan_quality(rows: DataFrame, keys: Keys) -> DataFrame:
    """Census of each scan: samples, masked, mean, deviation, extremes, zeros, negatives."""
    v = F.col("value")
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n"),
        (F.count("*") - F.count("value")).alias("n_masked"),
        F.avg("value").alias("mean"),
        F.stddev_pop("value").alias("deviation"),
        F.min("value").alias("low"),
        F.max("value").alias("high"),
        F.coalesce(F.sum((v == 0).cast("int")), F.lit(0)).alias("n_zero"),
        F.coalesce(F.sum((v < 0).cast("int")), F.lit(0)).alias("n_negative"),
    )


def unrotate_polarisation(rows: DataFrame, keys: Keys) -> DataFrame:
    """Stokes I, Q, U back to linear XX, YY, XY, YX (the cross terms without V)."""
    wide = rows.groupBy(*keys).agg(*[F.max(F.when(F.col("pol") == p, F.col("value"))).alias(p) for p in ("I", "Q", "U")])
    values = {"XX": F.col("I") - F.col("Q"), "YY": F.col("I") + F.col("Q"), "XY": F.col("U"), "YX": F.col("U")}
    return wide.select(*keys, F.explode(F.array(*[F.struct(F.lit(p).alias("pol"), v.alias("value")) for p, v in values.items()])).alias("s")).select(*keys, "s.*").where("value is not null")


def separate_cal(rows: DataFrame, keys: Keys, period: int, states: DataFrame, t: str = "t") -> DataFrame:
    """Means of the noise source's on and off bins in every period: (keys, n, state, value). ``states`` (keys, phase, state) are those of ``fold_on_cal``."""
    at = rows.withColumn("phase", F.pmod(F.col(t), F.lit(period))).withColumn("n", F.floor(F.col(t) / period).cast("long"))
    known = states.where("state <> 'blank'").select(*keys, "phase", "state")
    return at.join(known, [*keys, "phase"]).groupBy(*keys, "n", "state").agg(F.avg("value").alias("value"))


def scale_by_cal_spectrum(rows: DataFrame, keys: Keys, scan: Keys) -> DataFrame:
    """Values over the mean over channels of (cal on - cal off) at each time; masked where that is not positive."""
    on, off = (F.avg(F.when(F.col("cal") == c, F.col("value"))) for c in ("T", "F"))
    gain = rows.groupBy(*scan, *keys).agg((on - off).alias("_g"))
    return rows.join(gain, [*scan, *keys]).withColumn("value", F.when(F.col("_g") > 0, F.col("value") / F.col("_g"))).drop("_g")
