"""Information transfer: bits per trial and minute, and the cost of a speller, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def wolpaw_bits(p: Column, n: Column) -> Column:
    """Bits per trial at accuracy p of n classes: 0 up to chance or where p is null or not finite, log2 n from 1 on."""
    finite = p.isNotNull() & ~F.isnan(p) & (F.abs(p) != float("inf"))
    inner = F.log2(n) + p * F.log2(p) + (1 - p) * F.log2((1 - p) / (n - 1))
    return F.when(~finite | (p <= 1 / n), 0.0).when(p >= 1, F.log2(n)).otherwise(inner)


def effective_bits(p: Column, rejected: Column, n: Column) -> Column:
    return wolpaw_bits(p, n) * (1 - rejected)


def bits_per_minute(p: Column, rejected: Column, seconds: Column, n: Column) -> Column:
    return F.when(seconds <= 0, 0.0).otherwise(effective_bits(p, rejected, n) * 60 / F.nullif(seconds, F.lit(0.0)))


def actions_per_letter(p: Column, rejected: Column, error: float = 2.0, skip: float = 1.0, correct: float = 1.0) -> Column:
    right = (1 - rejected) * p
    cost = right * correct + rejected * skip + (1 - rejected) * (1 - p) * error
    return F.when(right <= 0, float("inf")).otherwise(cost / F.nullif(right, F.lit(0.0)))


def itr_columns(ba_reject: Column, ba_reconstruct: Column, pct_retained: Column, seconds: Column, n: Column) -> list[Column]:
    """The ten columns of one (subject, threshold) result."""
    r, none = 1 - pct_retained / 100, F.lit(0.0)
    rej, rec = effective_bits(ba_reject, r, n), effective_bits(ba_reconstruct, none, n)
    return [
        r.alias("rejection_rate"),
        wolpaw_bits(ba_reject, n).alias("bits_per_trial_reject"),
        wolpaw_bits(ba_reconstruct, n).alias("bits_per_trial_reconstruct"),
        rej.alias("itr_effective_reject"),
        rec.alias("itr_effective_reconstruct"),
        bits_per_minute(ba_reject, r, seconds, n).alias("itr_bits_per_min_reject"),
        bits_per_minute(ba_reconstruct, none, seconds, n).alias("itr_bits_per_min_reconstruct"),
        (rej - rec).alias("itr_delta_vs_reconstruct"),
        actions_per_letter(ba_reject, r).alias("actions_per_letter_reject"),
        actions_per_letter(ba_reconstruct, none).alias("actions_per_letter_reconstruct"),
    ]
