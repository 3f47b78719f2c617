"""Rejecting epochs and channels by their noise score, and judging it against known intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from undula.functions.scalars import half_hann


def reject_epochs(rec: DataFrame, enova: DataFrame, threshold: float, n: int) -> DataFrame:
    """rec(rec, ch, i, v) without the samples of epochs scored above threshold, numbered anew; what stands after the last
    full epoch is kept. The new number is the old less the samples gone before, taken from the epochs alone."""
    scored = enova.withColumn("bad", (F.col("enova") > threshold).cast("int"))
    gone = F.sum("bad").over(Window.partitionBy("rec").orderBy("epoch")) - F.col("bad")
    per = scored.withColumn("gone", gone)
    total = per.groupBy("rec").agg(F.sum("bad").alias("all_bad"))
    at = rec.withColumn("epoch", F.floor(F.col("i") / n).cast("long")).join(per.select("rec", "epoch", "bad", "gone"), ["rec", "epoch"], "left").join(total, "rec", "left")
    shift = F.coalesce("gone", "all_bad", F.lit(0)) * n
    return at.where(F.coalesce("bad", F.lit(0)) == 0).select("rec", "ch", "i", (F.col("i") - shift).alias("new_i"), "v")


def percent_rejected(enova: DataFrame, threshold: float) -> DataFrame:
    bad = F.count_if(F.col("enova") > threshold)
    return enova.groupBy("rec").agg(bad.alias("n_rejected"), F.count("*").alias("n_epochs"), (100 * bad / F.count("*")).alias("pct_rejected"))


def taper_factors(samples: DataFrame, width: int) -> DataFrame:
    """samples(rec, i, keep 0/1) -> factor: fades out over `width` samples before a cut and in after it; factors multiply."""
    w = Window.partitionBy("rec").orderBy("i")
    turn = F.col("keep") - F.lag("keep", 1, 1).over(w)
    marked = samples.withColumn("cut", F.when(turn == -1, F.col("i"))).withColumn("resume", F.when(turn == 1, F.col("i")))
    near = marked.withColumn("next_cut", F.min("cut").over(w.rowsBetween(1, width))).withColumn("last_resume", F.max("resume").over(w.rowsBetween(-(width - 1), 0)))
    out = F.coalesce(half_hann(F.col("next_cut") - 1 - F.col("i"), width), F.lit(1.0))
    back = F.coalesce(half_hann(F.col("i") - F.col("last_resume"), width), F.lit(1.0))
    return near.select("rec", "i", "keep", (out * back).alias("factor"))


def flat_channels(rec: DataFrame, tolerance: float = 1e-7) -> DataFrame:
    d = F.col("v") - F.lag("v").over(Window.partitionBy("rec", "ch").orderBy("i"))
    return rec.withColumn("d", d).groupBy("rec", "ch").agg(F.stddev_pop("d").alias("deviation")).withColumn("flat", F.col("deviation") < tolerance)


def bad_channels(enova: DataFrame, flat: DataFrame, threshold: float) -> DataFrame:
    """(rec, ch, enova, flat, bad): flat channels count as infinitely noisy."""
    joined = enova.join(flat.select("rec", "ch", "flat"), ["rec", "ch"])
    e = F.when(F.col("flat"), float("inf")).otherwise(F.col("enova"))
    return joined.select("rec", "ch", e.alias("enova"), "flat", (e > threshold).alias("bad"))


def good_channels(channels: DataFrame, bad: DataFrame) -> DataFrame:
    return channels.join(bad, ["rec", "ch"], "left_anti")


def match_names(names: DataFrame, template: DataFrame) -> DataFrame:
    """names(name), template(idx, label) -> (name, idx, label): equal but for case, else the first template label that
    contains the name or is contained in it. template is a montage of at most some hundreds of labels, checked here."""
    if template.limit(10_001).count() > 10_000:
        raise ValueError("a template has at most 10,000 labels")
    n, t = F.lower("name"), F.lower("label")
    pairs = names.join(F.broadcast(template), (n == t) | n.contains(t) | t.contains(n))
    best = F.min(F.struct((n != t).cast("int").alias("far"), "idx", "label")).alias("b")
    return pairs.groupBy("name").agg(best).select("name", "b.idx", "b.label")


def marker_windows(markers: DataFrame, n: int, count: int) -> DataFrame:
    """Windows of n samples that an interval touches, its end included; distinct."""
    last = F.least(F.floor(F.col("end_i") / n), F.lit(count - 1))
    first = F.floor(F.col("start_i") / n)
    return markers.where(first <= last).select(F.explode(F.sequence(first.cast("long"), last.cast("long"))).alias("epoch")).distinct()


def rejection_quality(truth: DataFrame, rejected: DataFrame, count: int) -> DataFrame:
    """Both of (epoch): hits, false alarms, misses; precision, recall and the share of clean windows rejected."""
    t, r = truth.select("epoch", F.lit(1).alias("t")), rejected.select("epoch", F.lit(1).alias("r"))
    j = t.join(r, "epoch", "full").select(F.coalesce("t", F.lit(0)).alias("t"), F.coalesce("r", F.lit(0)).alias("r"))
    both = j.agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(n) for x, n in ((F.col("t") * F.col("r"), "n_true_positives"), (F.col("r") * (1 - F.col("t")), "n_false_positives"), (F.col("t") * (1 - F.col("r")), "n_missed"))])
    tp, fp, fn = F.col("n_true_positives"), F.col("n_false_positives"), F.col("n_missed")
    one = F.lit(1)
    return both.select("*", (tp / F.greatest(tp + fp, one)).alias("rejection_precision"), (tp / F.greatest(tp + fn, one)).alias("rejection_recall"), (fp / F.greatest(count - tp - fn, one)).alias("false_rejection_rate"))


def majority_vote(enova: DataFrame, threshold: float, per_trial: int) -> DataFrame:
    """A trial of per_trial windows is rejected when more than half of them are."""
    t = enova.withColumn("trial", F.floor(F.col("epoch") / per_trial).cast("long"))
    bad = F.count_if(F.col("enova") > threshold)
    return t.groupBy("rec", "trial").agg(bad.alias("n_bad"), F.count("*").alias("n"), (2 * bad > F.count("*")).alias("rejected"))
