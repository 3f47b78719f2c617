"""How well a cleaned signal matches: triples (rec, ch, i, ref, cor, cln), covariances and robust scales."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS = 1e-12


def safe_corr(a: str, b: str) -> Column:
    """Pearson correlation, null where either side is constant."""
    return F.when((F.var_pop(a) > 0) & (F.var_pop(b) > 0), F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)))


def variance(x: np.ndarray, axis: int | tuple[int, ...] = -1) -> np.ndarray:
    """var_pop() along axes of an array: exactly 0 for equal values, as there."""
    return np.where(x.max(axis) == x.min(axis), 0.0, x.var(axis))


def corr_stack(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """safe_corr() along the last axis of arrays, NaN where either side is constant."""
    p, q = variance(a), variance(b)
    cov = ((a - a.mean(-1, keepdims=True)) * (b - b.mean(-1, keepdims=True))).mean(-1)
    some = (p > 0) & (q > 0)
    return np.divide(cov, np.sqrt(p) * np.sqrt(q), out=np.full(cov.shape, np.nan), where=some)


def known_mean(x: np.ndarray) -> np.ndarray:
    """Mean along the last axis of what isn't NaN; NaN where nothing is left."""
    n = (~np.isnan(x)).sum(-1)
    return np.divide(np.nansum(x, -1), n, out=np.full(n.shape, np.nan), where=n > 0)


def removal_stack(ref: np.ndarray, cor: np.ndarray, cln: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """removal() of a stack (recordings, channels, samples); a null gain is NaN."""
    s, a, r = (variance(x, (-2, -1)) for x in (ref, cor - ref, cln - ref))
    some = (a >= 1e-6 * s) & (s > 0)
    with np.errstate(divide="ignore"):
        gain = 10 * (np.log10(s / (r + EPS)) - np.log10(s / (a + EPS)))
    return np.where(some, gain, np.nan), np.sqrt(((cln - ref) ** 2).mean((-2, -1))), r / (a + EPS)


def mean_correlation_stack(ref: np.ndarray, cln: np.ndarray) -> np.ndarray:
    """mean_correlation() of a stack."""
    return np.nan_to_num(known_mean(corr_stack(ref, cln)))


def removal(triple: DataFrame) -> DataFrame:
    """Per recording: SNR gain in dB (null where next to nothing was injected), RMSE, residual power."""
    art, res, err = F.col("cor") - F.col("ref"), F.col("cln") - F.col("ref"), F.pow(F.col("cln") - F.col("ref"), 2)
    t = triple.groupBy("rec").agg(F.var_pop("ref").alias("s"), F.var_pop(art).alias("a"), F.var_pop(res).alias("r"), F.sqrt(F.avg(err)).alias("rmse"))
    before, after = F.log10(F.col("s") / (F.col("a") + EPS)), F.log10(F.col("s") / (F.col("r") + EPS))
    gain = F.when((F.col("a") >= 1e-6 * F.col("s")) & (F.col("s") > 0), 10 * (after - before))
    return t.select("rec", gain.alias("snr_improvement_db"), "rmse", (F.col("r") / (F.col("a") + EPS)).alias("residual_power_ratio"))


def channel_correlation(triple: DataFrame) -> DataFrame:
    return triple.groupBy("rec", "ch").agg(safe_corr("ref", "cln").alias("r"))


def mean_correlation(triple: DataFrame) -> DataFrame:
    return channel_correlation(triple).groupBy("rec").agg(F.coalesce(F.avg("r"), F.lit(0.0)).alias("correlation"))


def named_correlations(triple: DataFrame, channels: list[str]) -> DataFrame:
    """Per recording a map of the named channels' correlations."""
    per = channel_correlation(triple.where(F.col("ch").isin(channels)))
    return per.groupBy("rec").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("ch", "r")))).alias("by_channel"))


def kurtosis_reduction(triple: DataFrame) -> DataFrame:
    per = triple.groupBy("rec", "ch").agg(*[F.when(F.var_pop(c) > 0, F.kurtosis(c)).alias(c) for c in ("cor", "cln")])
    return per.groupBy("rec").agg((F.avg("cor") - F.avg("cln")).alias("kurtosis_reduction"))


def channel_covariance(rec: DataFrame) -> DataFrame:
    """(rec, a, b, cov) with one degree of freedom less, for a <= b. The pairs of channels meet sample by sample."""
    a, b = rec.select("rec", "i", F.col("ch").alias("a"), F.col("v").alias("x")), rec.select("rec", "i", F.col("ch").alias("b"), F.col("v").alias("y"))
    return a.join(b, ["rec", "i"]).where("a <= b").groupBy("rec", "a", "b").agg(F.covar_samp("x", "y").alias("cov"))


def regularize(cov: DataFrame, shrink: float = 0.05) -> DataFrame:
    """Full symmetric (a, b, g): (1 - shrink) g, and on the diagonal shrink times the mean diagonal more."""
    trace = cov.where("a = b").agg(F.avg("g").alias("m"))
    return cov.crossJoin(F.broadcast(trace)).select("a", "b", ((1 - shrink) * F.col("g") + F.when(F.col("a") == F.col("b"), shrink * F.col("m")).otherwise(0.0)).alias("g"))


def rbf_covariance(positions: DataFrame) -> DataFrame:
    """positions(ch, x, y, z) -> (a, b, g): Gaussian of distance over the median distance of distinct places, diagonal + 1e-6.

    A montage is a few hundred electrodes; more than 10,000 is an error, as pairs grow with the square.
    """
    if positions.limit(10_001).count() > 10_000:
        raise ValueError("a montage has at most 10,000 electrodes")
    p, q = positions.select(F.col("ch").alias("a"), *[F.col(c).alias(c + "1") for c in "xyz"]), positions.select(F.col("ch").alias("b"), *[F.col(c).alias(c + "2") for c in "xyz"])
    d2 = sum((F.pow(F.col(c + "1") - F.col(c + "2"), 2) for c in "xyz"), F.lit(0.0))
    pairs = p.join(F.broadcast(q), F.lit(True)).select("a", "b", F.sqrt(d2).alias("d"))
    scale = pairs.where("a <> b and d > 0").agg(F.median("d").alias("m"))
    return pairs.crossJoin(F.broadcast(scale)).select("a", "b", (F.exp(-F.pow("d", F.lit(2)) / (2 * F.pow("m", F.lit(2)))) + F.when(F.col("a") == F.col("b"), 1e-6).otherwise(0.0)).alias("g"))


def epoch_power_db(rec: DataFrame, n: int) -> DataFrame:
    per = rec.withColumn("epoch", F.floor(F.col("i") / n).cast("long")).groupBy("rec", "epoch", "ch").agg(F.var_samp("v").alias("p"))
    return per.groupBy("rec", "epoch").agg((10 * F.log10(F.sum("p") + EPS)).alias("power_db"))


def mad_scale(rec: DataFrame, low: float = 5.0, high: float = 200.0) -> DataFrame:
    """Five times the median absolute deviation, within limits; per recording."""
    centre = rec.groupBy("rec").agg(F.median("v").alias("m"))
    dev = rec.join(centre, "rec").groupBy("rec").agg(F.median(F.abs(F.col("v") - F.col("m"))).alias("mad"))
    return dev.select("rec", F.least(F.lit(high), F.greatest(F.lit(low), 5 * F.col("mad"))).alias("scale"))


def frobenius_distance(one: DataFrame, other: DataFrame) -> DataFrame:
    """Relative distance of two covariances (rec, a, b, cov) with a <= b; pairs off the diagonal count twice."""
    j = one.join(other.withColumnRenamed("cov", "other"), ["rec", "a", "b"])
    w = F.when(F.col("a") == F.col("b"), 1.0).otherwise(2.0)
    return j.groupBy("rec").agg((F.sqrt(F.sum(w * F.pow(F.col("cov") - F.col("other"), 2))) / (F.sqrt(F.sum(w * F.pow("cov", F.lit(2)))) + EPS)).alias("distance"))


def extents(df: DataFrame, by: list[str], col: str, share: float = 0.05) -> DataFrame:
    """Mean plus and minus the radius that holds all but `share` of a two-dimensional normal."""
    import math

    r = F.sqrt(F.var_samp(col) * (-2 * math.log(share)))
    return df.groupBy(*by).agg((F.avg(col) - r).alias("lo"), (F.avg(col) + r).alias("hi"))


def eog_correlation_reduction(triple: DataFrame, eog: DataFrame) -> DataFrame:
    """eog(rec, i, e): how much less the channels correlate with it, in the mean of absolute values."""
    j = triple.join(eog, ["rec", "i"])
    per = j.groupBy("rec", "ch").agg(F.abs(safe_corr("cor", "e")).alias("before"), F.abs(safe_corr("cln", "e")).alias("after"))
    zero = F.lit(0.0)
    return per.groupBy("rec").agg((F.coalesce(F.avg("before"), zero) - F.coalesce(F.avg("after"), zero)).alias("reduction"))
