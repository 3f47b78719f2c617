"""Scalar rules of the signal operators."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def even_samples(seconds: float, fs: float) -> int:
    """The even number of samples nearest to seconds * fs; halfway goes up."""
    return max(2, 2 * math.floor(seconds * fs / 2 + 0.5))


def wavelet_level(fs: float, lowcut: float, n: int) -> int:
    return max(6, min(math.ceil(math.log2(fs / lowcut)), math.floor(math.log2(n))))


def noise_multiplier(kind: str) -> float:
    return {"auto+": 1.5, "auto": 3.0, "auto-": 6.0}.get(kind, 3.0)


def csp_components(n: Column) -> Column:
    """How many spatial patterns to keep for n channels."""
    return F.when(n < 16, F.least(F.lit(4), F.floor(n / 2))).when(n >= 50, 8).otherwise(6).cast("int")


def significance(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").when(p.isNotNull(), "ns")


def cosine_weight(k: Column, n: int) -> Column:
    """Raised cosine over n samples, k from 0."""
    return 0.5 - 0.5 * F.cos(F.lit(2 * math.pi / n) * (k + 1))


def half_hann(k: Column, n: int) -> Column:
    return (1 - F.cos(F.lit(math.pi / max(n - 1, 1)) * k)) / 2 if n > 1 else F.lit(0.0) * k
