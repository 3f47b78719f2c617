"""p-values and intervals: the statistics come from SQL aggregates, the tails from small numeric functions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def signed_rank_null(n: int) -> np.ndarray:
    """Number of sign patterns for each sum of the ranks 1..n."""
    counts = np.zeros(n * (n + 1) // 2 + 1)
    counts[0] = 1
    for r in range(1, n + 1):
        counts[r:] += counts[: len(counts) - r].copy()
    return counts


def wilcoxon_tail(w_plus: float, n: int, tie: float, exact_up_to: int = 50, side: str = "two-sided") -> float:
    """Exact for few differences without ties, else normal. tie: the sum of t^3 - t over tied groups."""
    if n == 0:
        return float("nan")
    if n <= exact_up_to and tie == 0 and w_plus == int(w_plus):
        p = signed_rank_null(n) / 2.0**n
        up, down = p[int(w_plus) :].sum(), p[: int(w_plus) + 1].sum()
    else:
        mean, sd = n * (n + 1) / 4, math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - tie / 48)
        z = (w_plus - mean) / sd if sd > 0 else 0.0
        up, down = 0.5 * math.erfc(z / math.sqrt(2)), 0.5 * math.erfc(-z / math.sqrt(2))
    return float({"greater": up, "less": down}.get(side, min(1.0, 2 * min(up, down))))


def gamma_tail(a: float, x: float) -> float:
    """Upper regularised incomplete gamma: a series below a + 1, a continued fraction above."""
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-15:
            k += 1
            term *= x / k
            total += term
        return 1 - front * total
    b, c = x + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def chi2_tail(x: float, df: float) -> float:
    return gamma_tail(df / 2, x / 2)


def t_tail(t: float, df: float) -> float:
    """Two-sided, by numeric integration of the density after a change of variable."""
    u = np.linspace(0, math.atan(abs(t) / math.sqrt(df)), 4001)
    y = np.cos(u) ** (df - 1)
    area = (y[:1] + y[-1:] + 4 * y[1:-1:2].sum() + 2 * y[2:-1:2].sum())[0] * (u[1] - u[0]) / 3
    return float(1 - 2 * area * math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(math.pi))


@F.pandas_udf(DoubleType())
def wilcoxon_p(w: pd.Series, n: pd.Series, tie: pd.Series) -> pd.Series:
    return pd.Series([wilcoxon_tail(*x) for x in zip(w, n, tie, strict=True)])


@F.pandas_udf(DoubleType())
def chi2_p(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(a) else chi2_tail(a, b) for a, b in zip(x, df, strict=True)])


@F.pandas_udf(DoubleType())
def t_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(a) or b < 1 else t_tail(a, b) for a, b in zip(t, df, strict=True)])


def wilcoxon_test(diffs: DataFrame, by: list[str]) -> DataFrame:
    """diffs(by..., d) -> n, w_plus, p; fewer than three differences give null."""
    from undula.operators.stats import average_rank

    d = diffs.withColumn("d", F.round("d", 9)).where("d <> 0")
    r = d.withColumn("r", average_rank(by, F.abs("d")))
    size = F.count("*")
    ties = r.groupBy(*by, F.abs("d").alias("a")).agg(size.alias("t")).groupBy(*by).agg(F.sum(F.pow("t", F.lit(3)) - F.col("t")).alias("tie"))
    s = r.groupBy(*by).agg(size.alias("n"), F.sum(F.when(F.col("d") > 0, F.col("r")).otherwise(0.0)).alias("w_plus")).join(ties, by)
    return s.select(*by, "n", "w_plus", F.when(F.col("n") >= 3, wilcoxon_p("w_plus", "n", "tie")).alias("p"))


def signed_rank_tail(ranks: np.ndarray, w: int, side: str = "two-sided") -> float:
    """The exact tail of a sum w of doubled mid-ranks, whatever their ties: every sign pattern counted by dynamic programming."""
    counts = np.zeros(int(ranks.sum()) + 1)
    counts[0] = 1
    for r in ranks:
        counts[r:] += counts[: len(counts) - r].copy()
    p = counts / counts.sum()
    up, down = p[w:].sum(), p[: w + 1].sum()
    return float({"greater": up, "less": down}.get(side, min(1.0, 2 * min(up, down))))


@F.pandas_udf(DoubleType())
def signed_rank_p(w: pd.Series, n: pd.Series, tie: pd.Series, ranks: pd.Series, side: pd.Series) -> pd.Series:
    return pd.Series([signed_rank_tail(np.asarray(r, int), int(x), s) if len(r) else wilcoxon_tail(x / 2, m, t, 0, s) for x, m, t, r, s in zip(w, n, tie, ranks, side, strict=True)])


#: Up to this many differences a tail is exact, above normal with the ties' variance.
EXACT_UP_TO = 50


def signed_rank_test(diffs: DataFrame, by: list[str], exact_up_to: int = EXACT_UP_TO) -> DataFrame:
    """diffs(by..., side, d) -> by, side, n_pairs, delta, cohens_d, n, w_plus, p.

    Differences are rounded to 9 digits; zeros and nulls have no rank, zeros count in n_pairs, delta and cohens_d. Fewer than three with a
    rank have no p; no spread, no cohens_d. Only the ranks of tests of at most exact_up_to differences are gathered.
    """
    from undula.operators.stats import average_rank

    key = [*by, "side", "moved"]
    d = diffs.where("d is not null").withColumn("d", F.round("d", 9)).withColumn("moved", F.col("d") != 0)
    d = d.withColumn("r2", (2 * average_rank(key, F.abs("d"))).cast("long"))
    d = d.withColumn("tied", F.count("*").over(Window.partitionBy(*key, F.abs("d")))).withColumn("size", F.count("*").over(Window.partitionBy(*key)))
    moved = F.col("moved")
    s = d.groupBy(*by, "side").agg(
        F.count("*").alias("n_pairs"),
        F.avg("d").alias("delta"),
        F.when(F.stddev_samp("d") > 0, F.avg("d") / F.stddev_samp("d")).alias("cohens_d"),
        F.count_if(moved).alias("n"),
        F.sum(F.when(F.col("d") > 0, F.col("r2")).otherwise(0)).alias("w2"),
        F.sum(F.when(moved, F.col("tied") * F.col("tied") - 1).otherwise(0)).cast("double").alias("tie"),
        F.collect_list(F.when(moved & (F.col("size") <= exact_up_to), F.col("r2"))).alias("ranks"),
    )
    p = F.when(F.col("n") >= 3, signed_rank_p("w2", "n", "tie", "ranks", "side"))
    return s.select(*by, "side", "n_pairs", "delta", "cohens_d", "n", (F.col("w2") / 2).alias("w_plus"), p.alias("p"))


def paired_t_test(diffs: DataFrame, by: list[str]) -> DataFrame:
    s = diffs.groupBy(*by).agg(F.count("d").alias("n"), F.when(F.stddev_samp("d") > 0, F.avg("d") / (F.stddev_samp("d") / F.sqrt(F.count("d")))).alias("t"))
    return s.withColumn("p", F.when(F.col("n") >= 3, t_p("t", F.col("n") - 1)))


def bootstrap_ci(df: DataFrame, by: list[str], col: str, draws: int = 5000, seed: int = 42, share: float = 0.95) -> DataFrame:
    """Percentile interval of the mean. A group is the values of one cell of a sweep, one for each subject; draws go in
    blocks, so memory holds some draws of a group at a time."""
    kinds = dict(df.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in by) + ", n long, mean double, lo double, hi double"

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.sort(pdf[col].dropna().to_numpy())
        rng, means = np.random.default_rng(seed), []
        block = max(1, 2_000_000 // max(len(x), 1))
        for at in range(0, draws if len(x) else 0, block):
            means.append(x[rng.integers(0, len(x), (min(block, draws - at), len(x)))].mean(1))
        lo, hi = np.percentile(np.concatenate(means), [50 * (1 - share), 50 * (1 + share)]) if means else (np.nan, np.nan)
        return pd.DataFrame({**{c: [pdf[c].iloc[0]] for c in by}, "n": [len(x)], "mean": [x.mean() if len(x) else None], "lo": [lo], "hi": [hi]})

    return df.select(*by, col).groupBy(*by).applyInPandas(one, schema)
