"""Reference covariances and electrode positions: choosing, gathering and interpolating channels.

A montage is a small dimension table; signals meet it through joins.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from undula.operators.quality import rbf_covariance
from undula.operators.reject import match_names


def gather(matrix: DataFrame, template: DataFrame, names: DataFrame) -> DataFrame:
    """matrix(i, j, g) over template(idx, label) -> (a, b, g) for names(name); a name without a match is an error."""
    found = match_names(names, template)
    missing = [r["name"] for r in names.join(found, "name", "left_anti").limit(20).collect()]
    if missing:
        raise ValueError(f"no template channel for {', '.join(sorted(missing))}")
    a, b = found.select(F.col("name").alias("a"), F.col("idx").alias("i")), found.select(F.col("name").alias("b"), F.col("idx").alias("j"))
    return matrix.join(F.broadcast(a), "i").join(F.broadcast(b), "j").select("a", "b", "g")


def reference_covariance(kind: str | np.ndarray, names: list[str], positions: DataFrame | None = None, matrix: DataFrame | None = None, template: DataFrame | None = None, weights: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> np.ndarray:
    """The matrix in the order of names. kind: an array of the right shape as it is; "precomputed" gathers from matrix, and
    falls back on positions where there is none; "interpolated" weighs a precomputed matrix from the template's positions
    (weights: interpolation_weights, or spline_weights), with the same fallback; "channel_positions" is the Gaussian of distances."""
    if isinstance(kind, np.ndarray):
        if kind.shape != (len(names), len(names)):
            raise ValueError(f"a reference of shape {kind.shape} for {len(names)} channels")
        return kind
    if kind not in ("precomputed", "interpolated", "channel_positions"):
        raise ValueError(f"unknown reference {kind!r}: precomputed, interpolated, channel_positions or a matrix")
    if kind == "precomputed" and matrix is not None and template is not None:
        wanted = template.sparkSession.createDataFrame([(n,) for n in names], "name string")
        rows = gather(matrix, template, wanted).collect()
    elif kind == "interpolated" and matrix is not None and template is not None and positions is not None:
        w = (weights or interpolation_weights)(positions, template.select(F.col("idx").cast("string").alias("ch"), "x", "y", "z"))
        w = w.select("to", F.col("from").cast("int").alias("from"), "w")
        left, right = w.select(F.col("to").alias("a"), F.col("from").alias("i"), F.col("w").alias("wa")), w.select(F.col("to").alias("b"), F.col("from").alias("j"), F.col("w").alias("wb"))
        rows = matrix.join(F.broadcast(left), "i").join(F.broadcast(right), "j").groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb") * F.col("g")).alias("g")).collect()
    elif positions is not None:
        rows = rbf_covariance(positions).collect()
    else:
        raise ValueError("positions are needed where no precomputed matrix is given")
    g = {(r["a"], r["b"]): r["g"] for r in rows}
    return np.array([[g[a, b] for b in names] for a in names])


def interpolation_weights(wanted: DataFrame, known: DataFrame, nearest: int = 4) -> DataFrame:
    """(to, from, w): inverse squared distances to the nearest known positions, adding up to 1; a known place is itself."""
    p, q = wanted.select(F.col("ch").alias("to"), *[F.col(c).alias(c + "1") for c in "xyz"]), known.select(F.col("ch").alias("from"), *[F.col(c).alias(c + "2") for c in "xyz"])
    d2 = sum((F.pow(F.col(c + "1") - F.col(c + "2"), 2) for c in "xyz"), F.lit(0.0))
    near = p.join(F.broadcast(q), F.lit(True)).withColumn("d2", d2).withColumn("r", F.row_number().over(Window.partitionBy("to").orderBy("d2", "from"))).where(F.col("r") <= nearest)
    raw = near.withColumn("w", 1 / (F.col("d2") + 1e-12))
    return raw.select("to", "from", (F.col("w") / F.sum("w").over(Window.partitionBy("to"))).alias("w"))


#: A spline's system is solved on the driver, so its electrodes are counted first.
MOST_ELECTRODES = 1_024


def spline_matrix(wanted: np.ndarray, known: np.ndarray, order: int = 4, terms: int = 50, smoothing: float = 1e-5) -> np.ndarray:
    """Weights (wanted by known) of the spherical spline through the known places, which are put on the unit sphere.

    The spline is a constant plus a sum of kernels, Legendre series of the angle's cosine, whose strengths add up to zero;
    so each row of weights adds up to 1. At least one known place, none at the centre.
    """
    n = np.arange(1, terms + 1)
    series = np.concatenate([[0.0], (2 * n + 1) / (n * (n + 1.0)) ** order]) / (4 * math.pi)
    at, to = (p / np.linalg.norm(p, axis=1, keepdims=True) for p in (known, wanted))
    kernel = lambda p: np.polynomial.legendre.legval(np.clip(p @ at.T, -1, 1), series)
    one = np.ones((len(at), 1))
    system = np.block([[kernel(at) + smoothing * np.eye(len(at)), one], [one.T, np.zeros((1, 1))]])
    asked = np.hstack([kernel(to), np.ones((len(to), 1))])
    return np.linalg.solve(system, asked.T).T[:, : len(at)]


def spline_weights(wanted: DataFrame, known: DataFrame, smoothing: float = 1e-5) -> DataFrame:
    """(to, from, w) of the spherical spline over the known places, all of which weigh in. More than MOST_ELECTRODES places, or
    a place that is null, not finite or the centre, is an error; without wanted or known places there are no rows."""
    p, q = (x.select("ch", "x", "y", "z").orderBy("ch").limit(MOST_ELECTRODES + 1).collect() for x in (wanted, known))
    if max(len(p), len(q)) > MOST_ELECTRODES:
        raise ValueError(f"splines are for at most {MOST_ELECTRODES} electrodes")
    places = [np.array([[r[c] if r[c] is not None else math.nan for c in "xyz"] for r in x], float).reshape(-1, 3) for x in (p, q)]
    if not all(np.isfinite(x).all() and (np.linalg.norm(x, axis=1) > 0).all() for x in places):
        raise ValueError("an electrode without a place on the sphere")
    rows = [(a["ch"], b["ch"], float(w)) for a, line in zip(p, spline_matrix(*places, smoothing=smoothing), strict=True) for b, w in zip(q, line, strict=True)] if p and q else []
    return wanted.sparkSession.createDataFrame(rows, "to string, from string, w double")


def interpolate_channels(rec: DataFrame, positions: DataFrame, bad: DataFrame, nearest: int = 4, spline: bool = False) -> DataFrame:
    """rec(rec, ch, i, v) of the good channels, with those of bad(ch) filled in from their nearest neighbours, or from all
    good channels by a spherical spline."""
    gone = bad.select("ch").distinct()
    places = positions.join(gone, "ch", "left_semi"), positions.join(gone, "ch", "left_anti")
    w = spline_weights(*places) if spline else interpolation_weights(*places, nearest)
    good = rec.join(F.broadcast(gone), "ch", "left_anti").select("rec", "ch", "i", "v")
    filled = good.join(F.broadcast(w), good["ch"] == w["from"]).groupBy("rec", F.col("to").alias("ch"), "i").agg(F.sum(F.col("w") * F.col("v")).alias("v"))
    return good.union(filled.select("rec", "ch", "i", "v"))
