"""Threshold sweeps: what doesn't depend on the threshold is computed once, and thresholds are rows of one job."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from undula.operators import decode, ged, inject, quality, signal, spectral
from undula.sources import io


def threshold_rows(df: DataFrame, thresholds: list[float]) -> DataFrame:
    return df.withColumn("enova_threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))


def apply_thresholds(enova: DataFrame, thresholds: list[float], truth: DataFrame | None = None, also: tuple[str, ...] = ()) -> DataFrame:
    """enova(rec, epoch, enova), truth(epoch), or (rec, epoch), of corrupted windows -> a row per recording and threshold: windows, rejected,
    retained, mean score, and hits, false alarms and misses against the truth. Epoch scores are read once for all. enova may say itself
    which windows are corrupted, in a column of that name, and have `also` columns that a recording has one value of."""
    e = enova
    if truth is not None:
        by = [c for c in ("rec", "epoch") if c in truth.columns]
        e = e.join(truth.select(*by, F.lit(True).alias("corrupted")), by, "left")
    elif "corrupted" not in e.columns:
        e = e.withColumn("corrupted", F.lit(None).cast("boolean"))
    bad, hit = F.col("enova") > F.col("enova_threshold"), F.coalesce(F.col("corrupted"), F.lit(False))
    n = F.count("*")
    rows = threshold_rows(e, thresholds).groupBy("rec", "enova_threshold").agg(
        n.alias("n_1s_windows_total"), F.count_if(bad).alias("n_1s_windows_rejected"), (100 * (1 - F.count_if(bad) / n)).alias("pct_retained"), F.avg("enova").alias("mean_enova"),
        F.count_if(bad & hit).alias("n_true_positives"), F.count_if(bad & ~hit).alias("n_false_positives"), F.count_if(~bad & hit).alias("n_missed"), F.count_if(~hit).alias("n_clean_windows"),
        *[F.first(c).alias(c) for c in also],
    )
    tp, fp, fn, one = F.col("n_true_positives"), F.col("n_false_positives"), F.col("n_missed"), F.lit(1)
    return rows.select("*", (tp / F.greatest(tp + fp, one)).alias("rejection_precision"), (tp / F.greatest(tp + fn, one)).alias("rejection_recall"), (fp / F.greatest(F.col("n_clean_windows"), one)).alias("false_rejection_rate"))


def artifact_benchmark(rec: DataFrame, injectors: dict[str, Callable[[DataFrame], DataFrame]], size: int, levels: int = 1) -> DataFrame:
    """Every artifact injected into rec(rec, ch, ch_idx, i, v) and cleaned by dropping the finest bands: removal quality, a
    row each. All artifacts are one job."""
    out = None
    for name, f in injectors.items():
        t = f(rec).select(F.concat_ws("/", F.lit(name), "rec").alias("rec"), "ch", "i", (F.col("v") - F.col("artifact")).alias("ref"), "v")
        out = t if out is None else out.union(t)
    cleaned = signal.smooth_levels(out, size, levels).select("rec", "ch", "i", "ref", F.col("v").alias("cor"), F.col(f"a{levels}").alias("cln"))
    q = quality.removal(cleaned).join(quality.mean_correlation(cleaned), "rec")
    return q.select(F.split("rec", "/")[0].alias("artifact_type"), F.split("rec", "/")[1].alias("rec"), "snr_improvement_db", "rmse", "residual_power_ratio", "correlation")


def two_peaks(curve: DataFrame, at: str, value: str) -> DataFrame:
    """Where a curve is highest, and where in its first half."""
    w = Window.orderBy(at)
    n = F.count("*").over(Window.partitionBy())
    v = F.round(value, 9)
    c = curve.withColumn("r", F.row_number().over(w)).withColumn("n", n).withColumn("s", F.struct(v.alias("v"), (-F.col(at)).alias("a")))
    first = F.when(F.col("r") <= F.floor(F.col("n") / 2), F.col("s"))
    return c.agg(F.max_by(at, "s").alias("peak"), F.max_by(at, first).alias("first_half_peak"))


def deterministic_injectors(fs: float, epochs: list[int], n: int) -> dict[str, Callable[[DataFrame], DataFrame]]:
    return {
        "line_noise": lambda r: inject.line_noise(r, fs, 5.0),
        "drift": lambda r: inject.drift(r, fs),
        "electrode_pop": lambda r: inject.electrode_pop(r, epochs, n, 4, fs),
        "blink": lambda r: inject.blink(r, epochs, n, 6, 10),
        "saccade": lambda r: inject.saccade(r, epochs, n, 5, 6),
    }


MEASURES = "rec string, enova_threshold double, n_1s_windows_total long, n_1s_windows_rejected long, pct_retained double, mean_enova double, n_true_positives long, n_false_positives long, n_missed long, n_clean_windows long, rejection_precision double, rejection_recall double, false_rejection_rate double, snr_improvement_db double, rmse double, residual_power_ratio double, correlation double, psd_similarity double, sensai_score double, n_corrupted_windows long, n_bad_channels long, n_flat_channels long, error string"


#: Of MEASURES, those that the kernel's task gives.
MEASURED = ("snr_improvement_db", "rmse", "residual_power_ratio", "correlation", "psd_similarity", "sensai_score", "n_corrupted_windows", "n_bad_channels", "n_flat_channels")


def run_subjects(rec: DataFrame, names: list[str], size: int, matrix: np.ndarray, fs: int, thresholds: list[float], keep: Callable[[DataFrame], DataFrame], share: float = 0.3, bad_channel: float = 0.9) -> DataFrame:
    """rec(rec, ch, i, v), a recording of `size` samples for each subject, or ged.packed() rows of it -> a row per subject and threshold
    (MEASURES): window counts and hits against the drawn corrupted epochs, share retained, scores, quality against the input before
    injection, channels.

    Artifacts go into `share` of each subject's epochs. Every subject is injected, cleaned and measured once, where its row is; keep
    writes what is read again, its measures. A subject that can't be cleaned, at whatever stage, has one row: error says why and the
    measures are null; the others' rows are as without it.
    """
    rows = inject.with_drawn(ged.packed(rec) if "i" in rec.columns else rec, names, max(size // fs, 1), share).drop("at")
    of, cleaned = inject.shapes(rec.sparkSession, size, fs), ged.cleaner(fs, size)

    def work(x: np.ndarray, weights: np.ndarray, drawn: np.ndarray, r: np.ndarray, pcs: np.ndarray) -> tuple:
        artifact = inject.drawn_stack(weights, drawn, x.shape[-1], fs, of)
        clean, noise = cleaned(x + artifact, r, pcs)
        # before and after injection in the average reference that the cleaned signal has
        ref, cor = ged.referenced_stack(x + artifact - artifact), clean + noise
        scores = signal.enova_stack(clean, noise, fs)
        corrupted = np.zeros(scores.shape)
        np.put_along_axis(corrupted, drawn[:, 0].astype(int), 1.0, 1)
        counts = (np.full(len(x), drawn.shape[-1]), (signal.enova_channels_stack(clean, noise, fs) > bad_channel).sum(-1), (quality.variance(x) < 1e-12).sum(-1))
        measured = (*quality.removal_stack(ref, cor, clean), quality.mean_correlation_stack(ref, clean), spectral.psd_similarity_stack(ref, clean, fs, 0.5, fs / 2), ged.final_sensai_stack(clean, noise, pcs, fs), *counts)
        return scores, corrupted, np.stack(measured, axis=-1)

    done = keep(ged.by_recording(rows, work, "enova array<double>, corrupted array<double>, measured array<double>", matrix, names, "broadband", size, ("x", "weights", "drawn")))
    measured = [F.nanvl(F.col("measured")[k], F.lit(None).cast("double")).alias(c) for k, c in enumerate(MEASURED)]
    each = done.where("error is null").select("rec", *measured, F.posexplode(F.arrays_zip("enova", "corrupted")).alias("epoch", "e"))
    scores = each.select("rec", *MEASURED, "epoch", "e.enova", (F.col("e.corrupted") > 0).alias("corrupted"))
    rows = apply_thresholds(scores, thresholds, also=MEASURED).withColumn("error", F.lit(None).cast("string"))
    rows = rows.unionByName(done.where("error is not null").select("rec", "error"), allowMissingColumns=True)
    return rows.select(*[F.col(x.split()[0]).cast(x.split()[1]) for x in MEASURES.split(", ")])


def four_conditions(rows: DataFrame, names: list[str], size: int, matrix: np.ndarray, fs: int, thresholds: list[float], share: float = 0.5, folds: int = 3) -> DataFrame:
    """ged.packed() rows(rec, ch, x, error) of `size` samples with labels, 0 or 1 for each full epoch, and method -> (rec, condition,
    enova_threshold, n_train, n_test, balanced_accuracy, kappa, error), a row for each recording, condition and, where it rejects, threshold.

    Artifacts go into test epochs among the drawn ones; a fold's trials are the test. baseline and corrupted train on the input as it is, reconstruct
    and reject_keep on the cleaned input and test on the cleaned corrupted signal, of which reject_keep leaves out epochs with
    a noise share above the threshold. A recording is injected, cleaned and decoded where its row is, both its signals in one stack, with one
    decoder for the input and one for the cleaned input. What can't be cleaned has rows with the reason.
    """
    of, cleaned = inject.shapes(rows.sparkSession, size, fs), ged.cleaner(fs, size)
    rejecting = {f"reject_keep/{t}": t for t in thresholds}
    conditions = ["baseline", "corrupted", "reconstruct", *rejecting]

    def cut(x: np.ndarray, count: int) -> np.ndarray:
        """Trials (recordings, count, channels, samples)."""
        return x[..., : count * fs].reshape(*x.shape[:2], count, fs).swapaxes(1, 2)

    def signals(x: np.ndarray, artifact: np.ndarray, r: np.ndarray, pcs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
        """The signals of the training and the test in turn, as they are and cleaned, the latter's noise, and why a recording can't be cleaned."""
        both = np.stack([x + artifact - artifact, x + artifact])
        why = [min((e for e in (ged.why_not(list(v), size) for v in both[:, k]) if e), default=None) for k in range(len(x))]
        good = np.array([w is None for w in why])
        clean, noise = np.full(both.shape, np.nan), np.full(both.shape, np.nan)
        if good.any():
            try:
                done = cleaned(both[:, good].reshape(-1, *x.shape[1:]), r, pcs)
                clean[:, good], noise[:, good] = (a.reshape(2, -1, *x.shape[1:]) for a in done)
            except ged.UNSOLVED as e:
                if len(x) > 1:
                    raise
                why = [ged.told(e, "broadband")]
        return both, clean, noise, why

    def work(x: np.ndarray, weights: np.ndarray, drawn: np.ndarray, labels: np.ndarray, method: np.ndarray, r: np.ndarray, pcs: np.ndarray) -> tuple:
        label, count = labels[:, 0].astype(int), labels.shape[-1]
        if not count:
            return ([[]] * len(x),) * 2
        if (method < 0).any():
            raise ValueError(f"unknown method, known: {', '.join(decode.METHODS)}")
        test = np.array([decode.dealt_folds(np.arange(count), y, folds) for y in label]) == 0
        kinds = np.where(np.take_along_axis(test, drawn[:, 0].astype(int), 1), drawn[:, 1], -1)
        artifact = inject.drawn_stack(weights, np.stack([drawn[:, 0], kinds, drawn[:, 2]], 1), x.shape[-1], fs, of)
        both, clean, noise, why = signals(x, artifact, r, pcs)
        # without a noise share a trial stays, and its condition says why
        enova = np.nan_to_num(signal.enova_stack(clean[1], noise[1], fs))
        fits = []
        for version in (both, clean):
            trials = np.concatenate([cut(v, count) for v in version], axis=1)
            fits.append((decode.prepared(trials), np.isfinite(trials).all((-1, -2))))
        none, numbers, errors = np.zeros(count, bool), [], []
        for k in range(len(x)):
            after = {"reconstruct": test[k]} | {c: test[k] & (enova[k] <= t) for c, t in rejecting.items()}
            tests = ({"baseline": np.append(test[k], none), "corrupted": np.append(none, test[k])}, {c: np.append(none, t) for c, t in after.items()})
            scores = {}
            for (made, finite), some in zip(fits, tests, strict=True):
                scores |= decode.condition_scores(tuple(m[k] for m in made), finite[k], np.tile(label[k], 2), np.append(~test[k], none), some, decode.METHODS[int(method[k, 0, 0])])
            numbers.append([v for c in conditions for v in scores[c][:4]])
            errors.append([scores[c][4] and why[k] or scores[c][4] if c in after else scores[c][4] for c in conditions])
        return numbers, errors

    held = {"labels": F.array(F.col("labels").cast("array<double>")), "method": F.array(F.array((F.array_position(F.array(*[F.lit(m) for m in decode.METHODS]), F.col("method")) - 1).cast("double")))}
    rows = inject.with_drawn(rows, names, max(size // fs, 1), share).withColumns(held)
    done = ged.by_recording(rows, work, "numbers array<double>, errors array<string>", matrix, names, "broadband", None, ("x", "weights", "drawn", "labels", "method"))
    told = []
    for k, c in enumerate(conditions):
        n, error = [F.get("numbers", F.lit(4 * k + j)) for j in range(4)], F.coalesce("error", F.get("errors", F.lit(k)))
        accuracies = [F.when(error.isNull(), v).alias(a) for v, a in zip(n[2:], ("balanced_accuracy", "kappa"), strict=True)]
        told.append(F.struct(F.lit(c.split("/")[0]).alias("condition"), F.lit(rejecting.get(c)).cast("double").alias("enova_threshold"), n[0].cast("int").alias("n_train"), n[1].cast("int").alias("n_test"), *accuracies, error.alias("error")))
    return done.where("error is not null or size(numbers) > 0").select("rec", F.inline(F.array(*told)))


def resumed(spark: SparkSession, path: str, requested: DataFrame, recordings: DataFrame, run: Callable[[DataFrame], DataFrame], batches: int = 1, most_batches: int | None = None) -> DataFrame:
    """A sweep that can be stopped and started again: runs the requested(rec) subjects of recordings that path has no
    partition of, in batches by hash, each written when it is done; gives all that path holds.

    run(recordings) -> rows with dataset and subject. A batch overwrites the partitions it has rows of and no others, so a batch
    that was cut off is run again whole and no subject counts twice; failed subjects have rows too and are not tried
    again. most_batches stops early. Subjects that aren't requested are left alone, requested ones without a recording too.
    """
    for k in range(batches if most_batches is None else min(batches, most_batches)):
        done = finished(spark, path)
        todo = requested.select(F.col("rec").cast("string")).distinct().join(done, F.col("rec") == done["subject"], "left_anti")
        todo = todo.where(F.pmod(F.xxhash64("rec"), F.lit(batches)) == k)
        if not todo.isEmpty():
            io.write_sweep(run(recordings.join(todo, "rec", "left_semi")), path)
    return spark.read.option("basePath", path).schema(SWEPT).parquet(path)


#: What resumed() reads back.
SWEPT = MEASURES.replace("rec string, ", "", 1) + ", dataset string, subject string"


def finished(spark: SparkSession, path: str) -> DataFrame:
    """(subject) of the partitions that path has: nothing of a path that isn't there."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], "subject string")
    return spark.read.schema(SWEPT).parquet(path).select("subject").distinct()
