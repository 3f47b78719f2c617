"""Shaping, referencing, wavelets and noise scores of long-form recordings (rec, ch, i, v)."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from undula.functions.scalars import cosine_weight
from undula.operators.quality import variance

CHANNEL = ["rec", "ch"]


def to_epochs(rec: DataFrame, n: int, drop_tail: bool = False) -> DataFrame:
    """Adds epoch and k, the sample's place in it; drop_tail leaves an unfilled last epoch out."""
    out = rec.withColumn("epoch", F.floor(F.col("i") / n).cast("long")).withColumn("k", F.col("i") % n)
    if drop_tail:
        total = F.max("i").over(Window.partitionBy(*CHANNEL)) + 1
        out = out.withColumn("n_i", total).where(F.col("i") < F.floor(F.col("n_i") / n) * n).drop("n_i")
    return out


def from_epochs(epochs: DataFrame, n: int) -> DataFrame:
    return epochs.withColumn("i", F.col("epoch") * n + F.col("k")).drop("epoch", "k")


def mirror_pad(rec: DataFrame, n: int) -> DataFrame:
    """Fills the last epoch of n samples with the recording's last samples in reverse."""
    size = rec.groupBy(*CHANNEL).agg((F.max("i") + 1).alias("size"))
    both = rec.join(size, CHANNEL)
    pad = F.pmod(-F.col("size"), F.lit(n))
    tail = both.where(F.col("i") >= F.col("size") - pad).withColumn("i", 2 * F.col("size") - 1 - F.col("i"))
    return rec.select(*CHANNEL, "i", "v").union(tail.select(*CHANNEL, "i", "v"))


def crop_common(rec: DataFrame) -> DataFrame:
    """Every recording cut to the length of the shortest."""
    shortest = rec.groupBy("rec").agg(F.max("i").alias("last")).agg(F.min("last").alias("stop"))
    return rec.crossJoin(F.broadcast(shortest)).where(F.col("i") <= F.col("stop")).drop("stop")


def select_channels(rec: DataFrame, not_containing: str = "EOG") -> DataFrame:
    return rec.where(~F.upper("ch").contains(not_containing.upper()))


def average_reference(rec: DataFrame) -> DataFrame:
    """v less the sum over channels / (channels + 1): the rank stays full. Summed per sample first, then joined back."""
    mean = rec.groupBy("rec", "i").agg((F.sum("v") / (F.count("*") + 1)).alias("m"))
    return rec.join(mean, ["rec", "i"]).select(*CHANNEL, "i", (F.col("v") - F.col("m")).alias("v"))


def is_average_referenced(rec: DataFrame, tolerance: float = 1e-5) -> DataFrame:
    per = rec.groupBy("rec", "i").agg(F.abs(F.avg("v")).alias("a"), F.abs(F.sum("v") / (F.count("*") + 1)).alias("b"))
    return per.groupBy("rec").agg(F.max("a").alias("max_mean"), F.max("b").alias("max_ref")).withColumn("referenced", (F.col("max_mean") < tolerance) | (F.col("max_ref") < tolerance))


def smooth_levels(rec: DataFrame, n: int, levels: int) -> DataFrame:
    """Adds a0 = v, a1 ... a_levels, the circular Haar smooths of an undecimated transform over n samples.

    a_j[t] = a_{j-1}[t] / 2 + (a_{j-1}[t - 2^(j-1)] + a_{j-1}[t + 2^(j-1)]) / 4. All levels share one exchange and sort.
    """
    w, out = Window.partitionBy(*CHANNEL).orderBy("i"), rec.withColumn("a0", F.col("v"))
    for j in range(1, levels + 1):
        k, a = 2 ** (j - 1), f"a{j - 1}"
        back = F.coalesce(F.lag(a, k).over(w), F.lead(a, n - k).over(w))
        ahead = F.coalesce(F.lead(a, k).over(w), F.lag(a, n - k).over(w))
        out = out.withColumn(f"a{j}", 0.5 * F.col(a) + 0.25 * back + 0.25 * ahead)
    return out


def haar_bands(rec: DataFrame, n: int, levels: int, also: tuple[str, ...] = ()) -> DataFrame:
    """(rec, ch, i, also..., band, v): band j in 1..levels is a_{j-1} - a_j, band levels + 1 the last smooth; they add up to the input."""
    s = smooth_levels(rec, n, levels)
    bands = [F.struct(F.lit(j).alias("band"), (F.col(f"a{j - 1}") - F.col(f"a{j}")).alias("v")) for j in range(1, levels + 1)]
    bands.append(F.struct(F.lit(levels + 1).alias("band"), F.col(f"a{levels}").alias("v")))
    return s.select(*CHANNEL, "i", *also, F.explode(F.array(*bands)).alias("b")).select(*CHANNEL, "i", *also, "b.band", "b.v")


def smooth_stack(x: np.ndarray, levels: int) -> list[np.ndarray]:
    """a0 ... a_levels of smooth_levels() along the last axis of an array."""
    out = [x]
    for j in range(levels):
        a, k = out[-1], 2**j
        out.append(0.5 * a + 0.25 * np.roll(a, k, -1) + 0.25 * np.roll(a, -k, -1))
    return out


def haar_stack(x: np.ndarray, levels: int) -> list[np.ndarray]:
    """haar_bands() along the last axis of an array."""
    a = smooth_stack(x, levels)
    return [a[j - 1] - a[j] for j in range(1, levels + 1)] + [a[levels]]


def highpass_stack(x: np.ndarray, fs: float, lowcut: float) -> np.ndarray:
    """wavelet_highpass() along the last axis of an array."""
    first = passed_level(x.shape[-1], fs, lowcut)
    return x if first is None else x - smooth_stack(x, first - 1)[-1]


def passed_level(n: int, fs: float, lowcut: float) -> int | None:
    """The first level whose band ends at or below lowcut."""
    deepest = min(max(math.ceil(math.log2(fs / 0.1) - 1), 3), math.floor(math.log2(n)))
    return next((j for j in range(1, deepest + 1) if fs / 2**j <= lowcut), None)


def wavelet_highpass(rec: DataFrame, n: int, fs: float, lowcut: float) -> DataFrame:
    """Takes away the bands that end at or below lowcut: by telescoping, one smooth."""
    first = passed_level(n, fs, lowcut)
    if first is None:
        return rec.select(*CHANNEL, "i", "v")
    s = smooth_levels(rec, n, first - 1)
    return s.select(*CHANNEL, "i", (F.col("v") - F.col(f"a{first - 1}")).alias("v"))


def band_limits(df: DataFrame, fs: float, n: int) -> DataFrame:
    """(band, lo, hi) in Hz for n detail levels and the rest; df gives the session."""
    k = df.sparkSession.range(n + 1).select(F.col("id").cast("int").alias("band"))
    hi = fs / F.pow(F.lit(2.0), F.col("band") + 1)
    return k.select("band", F.when(F.col("band") == n, 0.0).otherwise(hi / 2).alias("lo"), F.when(F.col("band") == n, fs / 2.0**n / 2).otherwise(hi).alias("hi"))


def ratio(num: Column, den: Column) -> Column:
    """num / den, 0 where den isn't positive."""
    return F.coalesce(F.when(den > 0, F.try_divide(num, den)), F.lit(0.0))


def enova_per_epoch(parts: DataFrame, n: int, size: int | None = None) -> DataFrame:
    """parts(rec, ch, i, clean, noise) -> share of noise variance over all channels of each full epoch of n samples.

    A recording without a full epoch is one epoch. size, where known, spares a pass for the recordings' lengths.
    """
    total = F.lit(size) if size else F.max("i").over(Window.partitionBy("rec")) + 1
    full = F.floor(F.col("size") / n)
    e = parts.withColumn("size", total).withColumn("epoch", F.floor(F.col("i") / n).cast("long"))
    e = e.where((F.col("epoch") < full) | (full == 0))
    return e.groupBy("rec", "epoch").agg(ratio(F.var_pop("noise"), F.var_pop(F.col("clean") + F.col("noise"))).alias("enova"))


def enova_per_channel(parts: DataFrame, n: int) -> DataFrame:
    per = parts.withColumn("epoch", F.floor(F.col("i") / n).cast("long")).groupBy("rec", "ch", "epoch").agg(ratio(F.var_pop("noise"), F.var_pop(F.col("clean") + F.col("noise"))).alias("e"))
    return per.groupBy("rec", "ch").agg(F.avg("e").alias("enova"))


def enova_per_band(bands: DataFrame, n: int) -> DataFrame:
    """bands(rec, ch, i, band, clean, noise): mean over epochs, those without variance left out; 0 if none has any."""
    per = bands.withColumn("epoch", F.floor(F.col("i") / n).cast("long")).groupBy("rec", "band", "epoch").agg(F.var_pop("noise").alias("a"), F.var_pop(F.col("clean") + F.col("noise")).alias("b"))
    return per.groupBy("rec", "band").agg(F.coalesce(F.avg(F.when(F.col("b") > 0, F.try_divide("a", "b"))), F.lit(0.0)).alias("enova"))


def _shares(noise: np.ndarray, whole: np.ndarray) -> np.ndarray:
    den = variance(whole)
    return np.divide(variance(noise), den, out=np.zeros(den.shape), where=den > 0)


def enova_stack(clean: np.ndarray, noise: np.ndarray, n: int) -> np.ndarray:
    """enova_per_epoch() of a stack (recordings, channels, samples): (recordings, epochs)."""
    many, channels, size = clean.shape
    m = n if size >= n else size
    cut = lambda x: x[..., : size // m * m].reshape(many, channels, -1, m).swapaxes(1, 2).reshape(many, -1, channels * m)
    return _shares(cut(noise), cut(clean + noise))


def enova_channels_stack(clean: np.ndarray, noise: np.ndarray, n: int) -> np.ndarray:
    """enova_per_channel() of a stack: (recordings, channels). A tail is an epoch too."""
    full, whole = clean.shape[-1] // n * n, clean + noise
    cut = lambda x: x[..., :full].reshape(*x.shape[:2], -1, n)
    each = _shares(cut(noise), cut(whole))
    if full < clean.shape[-1]:
        each = np.concatenate([each, _shares(noise[..., full:], whole[..., full:])[..., None]], axis=-1)
    return each.mean(-1)


def summary(df: DataFrame, col: str, by: list[str]) -> DataFrame:
    """Ten numbers: mean, median, deviation, extremes and linear percentiles."""
    q = F.percentile(col, F.array(*[F.lit(p) for p in (0.1, 0.25, 0.75, 0.9, 0.95)]))
    out = df.groupBy(*by).agg(F.avg(col).alias("mean"), F.median(col).alias("median"), F.stddev_pop(col).alias("std"), F.min(col).alias("min"), F.max(col).alias("max"), q.alias("q"))
    return out.select(*by, "mean", "median", "std", "min", "max", *[F.col("q")[k].alias(f"p{p}") for k, p in enumerate((10, 25, 75, 90, 95))])


def half_shifted(rec: DataFrame, n: int) -> DataFrame:
    """Two epochings: from 0, and from half an epoch on; stream, epoch, k."""
    one = rec.select("*", F.lit(1).alias("stream"), F.floor(F.col("i") / n).cast("long").alias("epoch"), (F.col("i") % n).alias("k"))
    late = rec.where(F.col("i") >= n // 2)
    j = F.col("i") - n // 2
    return one.union(late.select("*", F.lit(2).alias("stream"), F.floor(j / n).cast("long").alias("epoch"), (j % n).alias("k")))


def overlap_add(rec: DataFrame, n: int, size: int) -> DataFrame:
    """Both streams' full epochs under raised cosines, added up; for three epochs or more the weights add up to 1.

    The first epoch of stream 1 is tapered in its second half only, the last in its first half only; stream 2 tapers
    everywhere, and its outer halves rise and fall where stream 1 has the whole weight.
    """
    epochs = size // n
    s = half_shifted(rec.where(F.col("i") < epochs * n), n).where((F.col("stream") == 1) | (F.col("epoch") < epochs - 1))
    w = cosine_weight(F.col("k"), n)
    flat = (F.col("stream") == 1) & (((F.col("epoch") == 0) & (F.col("k") < n // 2)) | ((F.col("epoch") == epochs - 1) & (F.col("k") >= n // 2)))
    weighted = s.withColumn("w", F.when(flat, 1.0).otherwise(w))
    return weighted.groupBy(*CHANNEL, "i").agg(F.sum(F.col("w") * F.col("v")).alias("v"), F.sum("w").alias("weight"))


def sliding_windows(epochs: DataFrame, size: int, count: int) -> DataFrame:
    """epochs(rec, epoch, ...) -> a row for each window of `size` epochs, one starting every half window, that holds it."""
    step = max(1, size // 2)
    last = (count - size) // step
    first = F.greatest(F.lit(0), F.ceil((F.col("epoch") - size + 1) / step))
    final = F.least(F.lit(last), F.floor(F.col("epoch") / step))
    return epochs.withColumn("window", F.explode(F.when(first <= final, F.sequence(first.cast("int"), final.cast("int")))))


def moving_average3(df: DataFrame, col: str, by: list[str], order: str) -> Column:
    """Three-point mean with zeros beyond the ends, so an end is shrunk by a third."""
    return F.sum(col).over(Window.partitionBy(*by).orderBy(order).rowsBetween(-1, 1)) / 3


def between_neighbours(col: str, by: list[str], order: str) -> Column:
    """A half-shifted stream's value: the mean of neighbours; null after the last."""
    return (F.col(col) + F.lead(col).over(Window.partitionBy(*by).orderBy(order))) / 2


def changepoint(series: DataFrame, by: list[str], order: str, col: str, width: int = 6) -> DataFrame:
    """The split of a smoothed series' slope into two with the largest |difference of means| * sqrt(k (n - k) / n), as a
    place in the series; the moving mean over `width` counts zeros beyond the ends."""
    w = Window.partitionBy(*by).orderBy(order)
    ahead = (width - 1) // 2
    smooth = series.withColumn("s", F.sum(col).over(w.rowsBetween(ahead + 1 - width, ahead)) / width)
    slope = smooth.withColumn("g", F.lead("s").over(w) - F.col("s")).where("g is not null")
    everything = Window.partitionBy(*by)
    run = slope.withColumn("k", F.row_number().over(w)).withColumn("left", F.sum("g").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    run = run.withColumn("n", F.count("*").over(everything)).withColumn("all", F.sum("g").over(everything)).where((F.col("k") >= 2) & (F.col("k") <= F.col("n") - 2))
    gap = F.abs(F.col("left") / F.col("k") - (F.col("all") - F.col("left")) / (F.col("n") - F.col("k")))
    score = F.round(gap * F.sqrt(F.col("k") * (F.col("n") - F.col("k")) / F.col("n")), 9)
    return run.groupBy(*by).agg((F.max_by("k", F.struct(score.alias("score"), (-F.col("k")).alias("k"))) + 1).alias("split"), F.max(score).alias("score"))
