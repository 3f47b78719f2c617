"""Statistics over a sweep table (dataset, subject, thr, metrics). Subjects are always (dataset, subject)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SUBJECT = ["dataset", "subject"]


def pivot(sweep: DataFrame, metric: str, thresholds: list[float]) -> DataFrame:
    out = sweep.groupBy(*SUBJECT).pivot("thr", thresholds).agg(F.avg(metric))
    return out.select(*SUBJECT, *[F.col(f"`{t}`").alias(f"t{round(100 * t):02d}") for t in thresholds])


def means(sweep: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    return sweep.groupBy(*by).agg(*[F.avg(m).alias(f"{m}_mean") for m in metrics], F.count_distinct(*SUBJECT).alias("n_subjects"))


def stats_table(sweep: DataFrame, metric: str) -> DataFrame:
    n = F.count(metric)
    sem = F.stddev_samp(metric) / F.sqrt(n)
    t = sweep.groupBy("thr").agg(n.alias("n"), F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("sd"), sem.alias("sem"))
    return t.select("*", (F.col("mean") - 1.96 * F.col("sem")).alias("lo"), (F.col("mean") + 1.96 * F.col("sem")).alias("hi"))


def best(df: DataFrame, by: list[str], metric: Column, at: str = "thr") -> DataFrame:
    """The place of the largest metric, the smallest place on ties."""
    m = F.round(metric, 9)
    return df.groupBy(*by).agg(F.max_by(at, F.struct(m.alias("m"), (-F.col(at)).alias("t"))).alias("best"), F.max(m).alias("value"))


def subject_optimum(sweep: DataFrame, metric: str, default: float) -> DataFrame:
    """Distribution of the subjects' best thresholds, and how many gain over 0.02 on the default."""
    top = best(sweep, SUBJECT, F.col(metric))
    base = sweep.where(F.round("thr", 2) == default).select(*SUBJECT, F.col(metric).alias("base"))
    j = top.join(base, SUBJECT, "left")
    counts = top.groupBy("best").count()
    mode = counts.agg(F.max_by("best", F.struct("count", (-F.col("best")).alias("b"))).alias("mode"))
    return j.agg(F.median("best").alias("median"), F.min("best").alias("min"), F.max("best").alias("max"), F.count_if(F.col("value") - F.col("base") > 0.02).alias("n_gain")).crossJoin(mode)


def small_datasets(sweep: DataFrame, least: int) -> DataFrame:
    return sweep.groupBy("dataset").agg(F.count_distinct("subject").alias("n_subjects")).where(F.col("n_subjects") < least)


def melt(sweep: DataFrame, metrics: list[str]) -> DataFrame:
    """Mean and deviation of each metric at each threshold, a row each."""
    long = sweep.unpivot(["thr"], metrics, "metric", "value")
    return long.groupBy("metric", "thr").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.count("value").alias("n"))


def paired(sweep: DataFrame, metric: str, pairs: DataFrame) -> DataFrame:
    """pairs(t1, t2) -> (t1, t2, dataset, subject, d): differences by subject; joined on thresholds rounded to 2 digits."""
    s = sweep.select(*SUBJECT, F.round("thr", 2).alias("t"), F.col(metric).alias("m"))
    a, b = s.select(*SUBJECT, F.col("t").alias("t1"), F.col("m").alias("m1")), s.select(*SUBJECT, F.col("t").alias("t2"), F.col("m").alias("m2"))
    return a.join(F.broadcast(pairs), "t1").join(b, [*SUBJECT, "t2"]).select("t1", "t2", *SUBJECT, (F.col("m2") - F.col("m1")).alias("d"))


def threshold_pairs(sweep: DataFrame) -> DataFrame:
    """All t1 < t2 among the distinct thresholds, of which a sweep has some tens."""
    t = sweep.select(F.round("thr", 2).alias("t")).distinct()
    return t.select(F.col("t").alias("t1")).join(t.select(F.col("t").alias("t2")), F.col("t1") < F.col("t2"))


def cohens_d(diffs: DataFrame, by: list[str]) -> DataFrame:
    return diffs.groupBy(*by).agg(F.count("d").alias("n"), F.when(F.stddev_samp("d") > 0, F.avg("d") / F.stddev_samp("d")).alias("cohens_d"), F.count_if(F.col("d") > 0).alias("wins"), F.count_if(F.col("d") < 0).alias("losses"), F.count_if(F.col("d") == 0).alias("ties"))


def average_rank(by: list[str], order: Column) -> Column:
    """Rank from 1; ties share the mean of their ranks."""
    tied = Window.partitionBy(*by, order)
    return F.rank().over(Window.partitionBy(*by).orderBy(order)) + (F.count("*").over(tied) - 1) / 2


def wilcoxon_w(diffs: DataFrame, by: list[str]) -> DataFrame:
    """Sums of the ranks of positive and of negative differences; zeros are dropped, differences rounded to 9 digits."""
    d = diffs.withColumn("d", F.round("d", 9)).where("d <> 0")
    r = d.withColumn("r", average_rank(by, F.abs("d")))
    plus, minus = F.sum(F.when(F.col("d") > 0, F.col("r")).otherwise(0.0)), F.sum(F.when(F.col("d") < 0, F.col("r")).otherwise(0.0))
    return r.groupBy(*by).agg(F.count("*").alias("n"), plus.alias("w_plus"), minus.alias("w_minus"), F.least(plus, minus).alias("w"))


def friedman(sweep: DataFrame, metric: str) -> DataFrame:
    """chi2 over subjects that have every threshold, corrected for ties."""
    k = sweep.select(F.count_distinct(F.round("thr", 2)).alias("k"))
    m = sweep.select(*SUBJECT, F.round("thr", 2).alias("t"), F.round(metric, 9).alias("m"))
    complete = m.withColumn("own", F.count("m").over(Window.partitionBy(*SUBJECT))).crossJoin(F.broadcast(k)).where("own = k")
    ranked = complete.withColumn("r", average_rank(SUBJECT, F.col("m"))).withColumn("tied", F.count("*").over(Window.partitionBy(*SUBJECT, "m")))
    per = ranked.groupBy("t", "k").agg(F.sum("r").alias("s"), F.count("*").alias("n"), F.sum(F.pow("tied", F.lit(2)) - 1).alias("tie"))
    n, kk = F.max("n"), F.max("k")
    chi = 12 / (n * kk * (kk + 1)) * F.sum(F.pow("s", F.lit(2))) - 3 * n * (kk + 1)
    correct = 1 - F.sum("tie") / (n * kk * (kk * kk - 1))
    return per.agg(n.alias("n"), kk.alias("k"), F.when(correct > 0, chi / correct).alias("chi2"))


def bonferroni(p: Column, n: Column) -> Column:
    return F.least(p * n, F.lit(1.0))


def benjamini_hochberg(df: DataFrame, p: str = "p", key: str = "key", by: tuple[str, ...] = ()) -> DataFrame:
    """Adds p_bonferroni and p_bh, within the families that by tells apart; a test without a p counts as 1. A family is a handful of rows."""
    family, own = Window.partitionBy(*by), F.coalesce(F.col(p), F.lit(1.0))
    ranked = df.withColumn("_r", F.row_number().over(family.orderBy(own, key))).withColumn("_n", F.count("*").over(family))
    step = own * F.col("_n") / F.col("_r")
    least = F.min(step).over(family.orderBy(F.col("_r").desc()).rowsBetween(Window.unboundedPreceding, 0))
    return ranked.withColumn("p_bonferroni", bonferroni(own, F.col("_n"))).withColumn("p_bh", F.least(least, F.lit(1.0))).drop("_r", "_n")


def stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("ns")


PAIRS, OVER_DEFAULT, BEST_OVER_DEFAULT, OVER_OTHER = "pairs", "over default", "best over default", "over other"


def family_differences(sweep: DataFrame, metric: str, other: str, default: float) -> DataFrame:
    """(family, dataset, t1, t2, side, d), a row for each comparison and subject, d: the metric at t2 less that at t1.

    pairs: all t1 < t2, two-sided. The rest one-sided, greater. over default: each threshold against default. best over
    default: each dataset's threshold of the largest mean, the smallest on ties. over other: metric less other at t2, t1
    null. dataset is null but in the third. Subjects without a value at both thresholds take no part.
    """
    at = sweep.withColumn("thr", F.round("thr", 2))
    names = at.select("thr").distinct()
    pooled = F.lit(None).cast("string").alias("dataset")
    shape = lambda df, family, dataset, t1, side: df.select(F.lit(family).alias("family"), dataset, t1, "t2", F.lit(side).alias("side"), "d")
    pairs = shape(paired(at, metric, threshold_pairs(at)), PAIRS, pooled, F.col("t1"), "two-sided")
    against = paired(at, metric, names.where(F.col("thr") != default).select(F.lit(default).alias("t1"), F.col("thr").alias("t2")))
    top = best(means(at, ["dataset", "thr"], [metric]), ["dataset"], F.col(f"{metric}_mean")).select("dataset", F.col("best").alias("t2"))
    # a dataset whose best is the default has differences of zero only
    every = paired(at, metric, names.select(F.lit(default).alias("t1"), F.col("thr").alias("t2"))).join(top, ["dataset", "t2"])
    versus = at.select(F.col("thr").alias("t2"), (F.col(metric) - F.col(other)).alias("d"))
    out = pairs.union(shape(against, OVER_DEFAULT, pooled, F.col("t1"), "greater"))
    out = out.union(shape(every, BEST_OVER_DEFAULT, F.col("dataset"), F.col("t1"), "greater"))
    return out.union(shape(versus, OVER_OTHER, pooled, F.lit(None).cast("double").alias("t1"), "greater")).where("d is not null")


def silhouette(df: DataFrame, value: str, cls: str, own: int) -> DataFrame:
    """Mean silhouette of class `own` against the rest, in one dimension with squared distances: sums of powers suffice."""
    def moments(flag: Column, name: str) -> list[Column]:
        x = F.when(flag, F.col(value))
        return [F.count(x).alias(f"n_{name}"), F.avg(x).alias(f"m_{name}"), F.avg(x * x).alias(f"q_{name}")]

    m = df.agg(*moments(F.col(cls) == own, "a"), *moments(F.col(cls) != own, "b"))
    x = F.col(value)
    j = df.where(F.col(cls) == own).crossJoin(F.broadcast(m))
    inside = (x * x - 2 * x * F.col("m_a") + F.col("q_a")) * F.col("n_a") / F.nullif(F.col("n_a") - 1, F.lit(0))
    outside = x * x - 2 * x * F.col("m_b") + F.col("q_b")
    return j.agg(F.avg(F.when(F.greatest(inside, outside) > 0, (outside - inside) / F.greatest(inside, outside)).otherwise(0.0)).alias("silhouette"))


def accuracy_kappa(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """Balanced accuracy and Cohen's kappa from the confusion counts."""
    c = df.groupBy(F.col(truth).alias("t"), F.col(guess).alias("g")).agg(F.count("*").alias("n"))
    rows = c.groupBy("t").agg(F.sum("n").alias("row"), F.sum(F.when(F.col("t") == F.col("g"), F.col("n")).otherwise(0)).alias("hit"))
    cols = c.groupBy(F.col("g").alias("t")).agg(F.sum("n").alias("col"))
    j = rows.join(cols, "t", "full").select(F.coalesce("row", F.lit(0)).alias("row"), F.coalesce("hit", F.lit(0)).alias("hit"), F.coalesce("col", F.lit(0)).alias("col"))
    s = j.agg(F.avg(F.when(F.col("row") > 0, F.col("hit") / F.col("row"))).alias("balanced_accuracy"), F.sum("row").alias("n"), F.sum("hit").alias("hits"), F.sum(F.col("row") * F.col("col")).alias("chance"))
    po, pe = F.col("hits") / F.col("n"), F.col("chance") / (F.col("n") * F.col("n"))
    return s.select("balanced_accuracy", F.when(pe < 1, (po - pe) / (1 - pe)).alias("kappa"))
