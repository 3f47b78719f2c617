"""Decoding trials by class: splits, spatial patterns, tangent space, linear discriminants, cross-validation.

Trials are rows (unit, trial, label, x: channels by samples, row after row). A unit is what one decoder sees, a subject or
a fold of one; it is a group, so a sweep's units run in parallel.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from undula.operators import linalg
from undula.sources import adapters


def stratified_split(trials: DataFrame, share: float, seed: int = 42) -> DataFrame:
    """trials(trial, label) with train: that share of every label, shuffled by a hash of the trial's number."""
    shuffled = Window.partitionBy("label").orderBy((F.col("trial") * 7919 + seed) % 10007, "trial")
    return trials.withColumn("train", F.row_number().over(shuffled) <= share * F.count("*").over(Window.partitionBy("label")))


def stratified_folds(trials: DataFrame, k: int, by: list[str], seed: int = 42) -> DataFrame:
    """Adds fold, 0 to k - 1, every label dealt out evenly."""
    shuffled = Window.partitionBy(*by, "label").orderBy((F.col("trial") * 7919 + seed) % 10007, "trial")
    return trials.withColumn("fold", F.row_number().over(shuffled) % k)


def ledoit_wolf(x: np.ndarray) -> np.ndarray:
    """x (samples, features) -> covariance shrunk towards its mean variance by the optimal amount."""
    n, p = x.shape
    d = x - x.mean(0)
    s = d.T @ d / n
    mu = np.trace(s) / p
    delta = ((s - mu * np.eye(p)) ** 2).sum() / p
    beta = min(((d**2).T @ (d**2) / n - s**2).sum() / (p * n), delta)
    by = 0.0 if delta == 0 else beta / delta
    return (1 - by) * s + by * mu * np.eye(p)


def lda(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and threshold of a two-class discriminant with one shrunk covariance."""
    m = [x[y == k].mean(0) for k in (0, 1)]
    centred = np.concatenate([x[y == k] - m[k] for k in (0, 1)])
    w = np.linalg.lstsq(ledoit_wolf(centred), m[1] - m[0], rcond=None)[0]
    return w, float(w @ (m[0] + m[1]) / 2 - np.log(max((y == 1).mean(), 1e-9) / max((y == 0).mean(), 1e-9)))


def csp_features(train: np.ndarray, y: np.ndarray, other: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Log power of the k spatial patterns that tell the classes apart most."""
    c = [np.mean([ledoit_wolf(x.T) for x in train[y == g]], 0) for g in (0, 1)]
    values, vectors = linalg.generalized(c[0][None], c[0] + c[1])
    pick = np.argsort(np.abs(values[0] - 0.5))[::-1][:k]
    w = vectors[0][:, pick].T
    return tuple(np.log(np.maximum((w @ z).var(-1), 1e-300)) for z in (train, other))


def _power(c: np.ndarray, f) -> np.ndarray:
    v, u = np.linalg.eigh(c)
    return (u * f(np.maximum(v, 1e-12))[..., None, :]) @ np.swapaxes(u, -1, -2)


def tangent_features(train: np.ndarray, other: np.ndarray, steps: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """Covariances as vectors in the tangent space at the training set's Riemannian mean."""
    return tangent_space(*(np.stack([ledoit_wolf(x.T) for x in z]) for z in (train, other)), steps)


def tangent_space(a: np.ndarray, b: np.ndarray, steps: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """tangent_features() from the trials' shrunk covariances."""
    mean = a.mean(0)
    for _ in range(steps):
        root, back = _power(mean, np.sqrt), _power(mean, lambda v: v**-0.5)
        step = _power(back @ a @ back, np.log).mean(0)
        mean = root @ _power_of_symmetric(step) @ root
        if np.linalg.norm(step) < 1e-8:
            break
    back = _power(mean, lambda v: v**-0.5)
    i, j = np.triu_indices(a.shape[-1])
    scale = np.where(i == j, 1, np.sqrt(2))
    return tuple(_power(back @ c @ back, np.log)[:, i, j] * scale for c in (a, b))


def _power_of_symmetric(c: np.ndarray) -> np.ndarray:
    v, u = np.linalg.eigh(c)
    return (u * np.exp(v)) @ u.T


def patterns_for(channels: int) -> int:
    return min(4, channels // 2) if channels < 16 else 8 if channels >= 50 else 6


def predict(train: np.ndarray, y: np.ndarray, test: np.ndarray, method: str) -> np.ndarray:
    if method == "csp":
        a, b = csp_features(train, y, test, patterns_for(train.shape[1]))
    elif method == "riemann":
        a, b = tangent_features(train, test)
    else:
        raise ValueError(f"unknown method {method!r}")
    w, c = lda(a, y)
    return (b @ w > c).astype(int)


#: The ways of predict().
METHODS = ("csp", "riemann")
RESULT = "unit string, n_train int, n_test int, balanced_accuracy double, kappa double, error string"


def balanced_accuracy_kappa(y: np.ndarray, p: np.ndarray) -> tuple[float, float]:
    ba = float(np.mean([(p[y == k] == k).mean() for k in np.unique(y)]))
    po, pe = (y == p).mean(), sum((y == k).mean() * (p == k).mean() for k in (0, 1))
    return ba, float((po - pe) / (1 - pe)) if pe < 1 else 0.0


def decode(trials: DataFrame, channels: int, method: str = "csp", least_train: int = 8, least_test: int = 4) -> DataFrame:
    """trials(unit, trial, label 0/1, train, x) -> one row per unit (RESULT). Too few trials or a failure: null accuracy and the reason."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack([np.asarray(v, float).reshape(channels, -1) for v in pdf["x"]])
        y, t = pdf["label"].to_numpy(), pdf["train"].to_numpy(bool)
        ba = kappa = error = None
        try:
            if t.sum() < least_train or (~t).sum() < least_test or len(np.unique(y[t])) < 2:
                raise ValueError("too few trials")
            ba, kappa = balanced_accuracy_kappa(y[~t], predict(x[t], y[t], x[~t], method))
        except (ValueError, np.linalg.LinAlgError) as e:
            error = str(e)
        return pd.DataFrame({"unit": [pdf["unit"].iloc[0]], "n_train": [int(t.sum())], "n_test": [int((~t).sum())], "balanced_accuracy": [ba], "kappa": [kappa], "error": [error]})

    return trials.groupBy("unit").applyInPandas(one, RESULT)


def condition_scores(made: tuple[np.ndarray, ...], finite: np.ndarray, y: np.ndarray, own: np.ndarray, tests: dict[str, np.ndarray], method: str, least_train: int = 8, least_test: int = 4) -> dict[str, tuple]:
    """prepared() trials, whether each is finite, their labels, those to train on and those of each condition -> for each condition
    n_train, n_test, balanced accuracy, kappa and what went wrong. The decoder is fitted once and asked once about a trial."""
    n, out, ready = int(own.sum()), {}, np.zeros(len(y), bool)
    bad = "training: too few trials" if n < least_train or len(np.unique(y[own])) < 2 else None if finite[own].all() else "training: values that are not finite"
    for name, test in tests.items():
        m = int(test.sum())
        error = bad or (f"test: {m} trials" if m < least_test else None if finite[test].all() else "test: values that are not finite")
        out[name] = (n, m, None, None, error)
        if error is None:
            ready |= test
    if ready.any():
        guess = np.zeros(len(y), int)
        try:
            guess[ready] = predict_prepared(made, own, ready, y, method)
            out |= {name: (n, int(t.sum()), *balanced_accuracy_kappa(y[t], guess[t]), None) for name, t in tests.items() if out[name][-1] is None}
        except (ValueError, np.linalg.LinAlgError) as e:
            out |= {name: (*o[:-1], str(e)) for name, o in out.items() if o[-1] is None}
    return out


def decode_conditions(train: DataFrame, test: DataFrame, channels: int, conditions: dict[str, str], least_train: int = 8, least_test: int = 4) -> DataFrame:
    """train(unit, fit, method, trial, label, x), test(unit, fit, condition, trial, label, x) -> (unit, condition, n_train, n_test,
    balanced_accuracy, kappa, error), a row for each unit that has training trials and each condition.

    conditions: which fit each belongs to. A unit's training and test trials of one fit meet in one task, where its decoder is
    fitted once and applied to all conditions of that fit. Too few trials, one class, or trials with a value that is null or not finite:
    null accuracy and the reason; trials of one condition don't touch the other conditions.
    """

    def stacked(x: list) -> np.ndarray:
        return np.stack([np.asarray(v, float).reshape(channels, -1) for v in x])

    def one(key: tuple, own: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
        x = stacked([*own["x"], *other["x"]])
        y = np.concatenate([own["label"].to_numpy(), other["label"].to_numpy()])
        trained, of = np.arange(len(x)) < len(own), np.array([None] * len(own) + list(other["condition"]), object)
        tests = {name: of == name for name in sorted(c for c, fit in conditions.items() if fit == key[1])}
        scores = condition_scores(prepared(x), np.isfinite(x).all((1, 2)), y, trained, tests, own["method"].iloc[0], least_train, least_test)
        return pd.DataFrame([(key[0], name, *s) for name, s in scores.items()], columns=["unit", "condition", "n_train", "n_test", "balanced_accuracy", "kappa", "error"])

    schema = RESULT.replace("unit string, ", "unit string, condition string, ")
    own = train.select("unit", "fit", "method", "label", "x")
    # new names for columns that may come from the same table as the training trials
    there = test.join(own.select("unit", "fit").distinct(), ["unit", "fit"], "left_semi").select(*[F.col(c).alias(c) for c in ("unit", "fit", "condition", "label", "x")])
    return own.groupBy("unit", "fit").cogroup(there.groupBy("unit", "fit")).applyInPandas(one, schema)


def fold_scores(trials: DataFrame, channels: int, k: int, method: str, least_train: int = 8, seed: int = 42) -> DataFrame:
    """(unit, balanced_accuracy, kappa), a row for each fold of each unit, null where it fails. Trials are dealt to folds as by
    stratified_folds(), in the unit's task. Where trials have a column deal, the labels, in the order of their trials' deal,
    first go to the unit's trials in order of their numbers."""

    def one(t: pa.Table) -> pa.Table:
        n = t.num_rows
        x = t.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, channels, -1)
        number, label = t.column("trial").to_numpy(), t.column("label").to_numpy()
        if dealt:
            y = np.empty_like(label)
            y[np.argsort(number, kind="stable")] = label[np.lexsort((number, t.column("deal").to_numpy()))]
            label = y
        fold = dealt_folds(number, label, k, seed)
        scores = []
        made = prepared(x)
        for f in range(k):
            own, test = fold != f, fold == f
            if not test.any() or own.sum() < least_train or len(np.unique(label[own])) < 2:
                scores.append((None, None))
                continue
            try:
                scores.append(balanced_accuracy_kappa(label[test], predict_prepared(made, own, test, label, method)))
            except (ValueError, np.linalg.LinAlgError):
                scores.append((None, None))
        return pa.table({"unit": pa.array([t.column("unit")[0].as_py()] * k, pa.string()), **{c: pa.array([s[j] for s in scores], pa.float64()) for j, c in enumerate(("balanced_accuracy", "kappa"))}})

    dealt = "deal" in trials.columns
    rows = trials.select("unit", F.col("trial").cast("long").alias("trial"), F.col("label").cast("int").alias("label"), "x", *(["deal"] if dealt else []))
    return rows.groupBy("unit").applyInArrow(one, "unit string, balanced_accuracy double, kappa double")


def dealt_folds(number: np.ndarray, label: np.ndarray, k: int, seed: int = 42) -> np.ndarray:
    """stratified_folds() of one unit's trials: their numbers and labels -> their folds."""
    fold = np.empty(len(label), int)
    for g in np.unique(label):
        at = np.flatnonzero(label == g)
        at = at[np.lexsort((number[at], np.fmod(number[at] * 7919 + seed, 10007)))]
        fold[at] = np.arange(1, len(at) + 1) % k
    return fold


def prepared(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What every fold needs of its trials, made once: their covariances, shrunk as by ledoit_wolf() and plain."""
    d = x - x.mean(-1, keepdims=True)
    n, p = x.shape[-1], x.shape[-2]
    s = d @ np.swapaxes(d, -1, -2) / n
    mu = np.trace(s, axis1=-2, axis2=-1) / p
    flat = mu[..., None, None] * np.eye(p)
    delta = ((s - flat) ** 2).sum((-2, -1)) / p
    beta = np.minimum((d**2 @ np.swapaxes(d**2, -1, -2) / n - s**2).sum((-2, -1)) / (p * n), delta)
    by = np.divide(beta, delta, out=np.zeros_like(beta), where=delta != 0)[..., None, None]
    return (1 - by) * s + by * flat, s


def predict_prepared(made: tuple[np.ndarray, ...], own: np.ndarray, test: np.ndarray, y: np.ndarray, method: str) -> np.ndarray:
    """predict() from prepared() trials, of which own train and test are asked."""
    shrunk, plain = made
    if method == "riemann":
        a, b = tangent_space(shrunk[own], shrunk[test])
        weights, threshold = lda(a, y[own])
        return (b @ weights > threshold).astype(int)
    if method != "csp":
        raise ValueError(f"unknown method {method!r}")
    c = [shrunk[own & (y == g)].mean(0) for g in (0, 1)]
    values, vectors = linalg.generalized(c[0][None], c[0] + c[1])
    w = vectors[0][:, np.argsort(np.abs(values[0] - 0.5))[::-1][: patterns_for(plain.shape[1])]]
    # a pattern's variance over a trial follows from the trial's covariance
    features = np.log(np.maximum(((plain @ w) * w).sum(-2), 1e-300))
    weights, threshold = lda(features[own], y[own])
    return (features[test] @ weights > threshold).astype(int)


def cross_validate(trials: DataFrame, channels: int, k: int = 5, method: str = "csp") -> DataFrame:
    """Mean, deviation and percentile range of the folds' accuracies; failed folds are left out, all failed gives nulls."""
    scored = fold_scores(trials, channels, k, method)
    ba = "balanced_accuracy"
    q = F.percentile(ba, F.array(F.lit(0.025), F.lit(0.975)))
    return scored.groupBy("unit").agg(F.avg(ba).alias("mean"), F.stddev_pop(ba).alias("std"), F.avg("kappa").alias("kappa"), q[0].alias("lo"), q[1].alias("hi"), F.count(ba).alias("n_folds"))


def permutation_test(trials: DataFrame, channels: int, permutations: int = 100, k: int = 3, method: str = "csp", seed: int = 7) -> DataFrame:
    """(unit, observed, p): share of label shuffles that decode at least as well. Every shuffle is a unit of its own: a task gets its
    trials once, deals their labels by hash and scores all folds."""
    copies = trials.select(F.col("unit").alias("own"), "trial", "label", "x", F.explode(F.sequence(F.lit(0), F.lit(permutations))).alias("shuffle"))
    # a shuffle deals the labels, in the hashed order, to the trials in order of their numbers; number 0 is as it was
    deal = F.when(F.col("shuffle") == 0, F.col("trial")).otherwise(F.xxhash64("trial", "shuffle", F.lit(seed)))
    shuffled = copies.select(F.concat_ws("#", "own", "shuffle").alias("unit"), "trial", "label", deal.alias("deal"), "x").repartition(adapters.partitions(trials.sparkSession), "unit")
    scores = cross_validate(shuffled, channels, k, method).select(F.split("unit", "#")[0].alias("unit"), F.split("unit", "#")[1].cast("int").alias("shuffle"), "mean")
    own = F.max(F.when(F.col("shuffle") == 0, F.col("mean")))
    by = scores.groupBy("unit").agg(own.alias("observed"), F.collect_list(F.when(F.col("shuffle") > 0, F.struct("mean"))).alias("others"))
    each = by.select("unit", "observed", F.explode("others").alias("o"))
    return each.groupBy("unit", "observed").agg(F.avg((F.col("o.mean") >= F.col("observed")).cast("double")).alias("p"))
