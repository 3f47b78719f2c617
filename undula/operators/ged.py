"""Separating signal from artifact by generalized eigenvalues against a reference covariance.

Spark deals out the recordings, a row each, and makes scores and sums by aggregates. A task takes some recordings at a time and
cleans each band of theirs by linear algebra over the stack of all their epochs, every epoch solved once for the search, the
cleaning and the score.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from undula.functions.scalars import even_samples, noise_multiplier, wavelet_level
from undula.operators import linalg, signal
from undula.sources import adapters

COMPONENTS, PERCENTILE = 3, 98


@dataclass(frozen=True)
class Spectrum:
    """Every epoch's generalized eigenvalues and vectors."""

    values: np.ndarray
    vectors: np.ndarray


def spectrum(epochs: np.ndarray, ref: np.ndarray) -> Spectrum:
    return Spectrum(*linalg.generalized(linalg.covariance(epochs), ref))


def eigenvalue_threshold(t: float, values: np.ndarray) -> float:
    """A threshold on the 0..12 scale as an eigenvalue: relative to the 98th percentile of log |l|; zeros are left out."""
    a = np.abs(values[values != 0])
    return float(np.exp((105 - t) / 100 * np.percentile(np.log(a) + 100, PERCENTILE) - 100)) if len(a) else 0.0


def split(epochs: np.ndarray, s: Spectrum, ref: np.ndarray, theta: float) -> tuple[np.ndarray, np.ndarray]:
    """(clean, noise): components whose |l| reaches theta are noise."""
    bad = s.vectors * (np.abs(s.values) >= theta)[:, None, :]
    noise = ref @ bad @ (np.swapaxes(bad, -1, -2) @ epochs)
    return epochs - noise, noise


def sensai(s: Spectrum, ref: np.ndarray, ref_components: np.ndarray, theta: float, multiplier: float) -> float:
    """100 * mean similarity of the signal's subspace to the reference's, less multiplier times the noise's.

    The covariances follow from the spectrum, without filtering; two steps of subspace iteration from the reference's
    components find their leading spaces. An epoch without one of the parts counts 0 for it.
    """
    rv = ref @ s.vectors
    total = 0.0
    for sign, bad in ((-multiplier, True), (1.0, False)):
        mask = (np.abs(s.values) >= theta) == bad
        c = (rv * (np.abs(s.values) * mask)[:, None, :]) @ np.swapaxes(rv, -1, -2)
        some = mask.any(-1)
        if some.any():
            q = np.broadcast_to(ref_components, (some.sum(), *ref_components.shape))
            for _ in range(2):
                q = np.linalg.qr(c[some] @ q)[0]
            total += sign * 100 * linalg.subspace_similarity(q, np.broadcast_to(ref_components, q.shape)).sum() / len(s.values)
    return float(total)


def search(s: Spectrum, ref: np.ndarray, ref_components: np.ndarray, multiplier: float, lo: float, hi: float) -> tuple[float, float]:
    """(threshold on the scale, eigenvalue) with the best score over all epochs."""
    t = linalg.bounded_minimum(lambda x: -sensai(s, ref, ref_components, eigenvalue_threshold(x, s.values), multiplier), lo, hi)
    return t, eigenvalue_threshold(t, s.values)


def epoch_similarity(epoch: np.ndarray, pcs: np.ndarray) -> float:
    """Geometric mean of the cosines between an epoch's leading space and the reference's."""
    q = linalg.top_components(linalg.covariance(epoch), pcs.shape[1])
    return float(np.clip(np.linalg.svd(q.T @ pcs, compute_uv=False), 0, 1).prod() ** (1 / pcs.shape[1]))


def window_thresholds(s: Spectrum, ref: np.ndarray, pcs: np.ndarray, multiplier: float, lo: float, hi: float, size: int) -> np.ndarray:
    """A threshold for each epoch, moving with time.

    Defined as a curve through knots: a knot for each half-overlapping window of `size` epochs, at its middle (half its
    size after its first epoch), with the three-point mean of the windows' own thresholds as its value, zeros beyond the
    ends; and one at either end with its neighbour's value. The curve is Akima's, never below 1e-12.
    """
    epochs = np.arange(len(s.values))
    if size >= len(epochs):
        return np.full(len(epochs), search(s, ref, pcs, multiplier, lo, hi)[1])
    windows = np.lib.stride_tricks.sliding_window_view(epochs, size)[:: max(1, size // 2)]
    own = np.array([search(Spectrum(s.values[w], s.vectors[w]), ref, pcs, multiplier, lo, hi)[1] for w in windows])
    knots = {0.0: 0, float(epochs[-1]): -1} | {w[0] + size / 2: k for k, w in enumerate(windows)}
    padded = np.pad(own, 1)
    value = (padded[:-2] + own + padded[2:]) / 3 if len(own) > 2 else own
    at = np.array(sorted(knots))
    return np.maximum(linalg.akima(at, value[[knots[x] for x in at]], epochs.astype(float)), 1e-12)


def _weights(n_epochs: int, n: int, outer: bool) -> np.ndarray:
    w = np.tile(0.5 - 0.5 * np.cos(2 * np.pi * np.arange(1, n + 1) / n), (n_epochs, 1))
    if not outer:
        w[0, : n // 2] = 1
        w[-1, n // 2 :] = 1
    return w


def clean_band(x: np.ndarray, ref: np.ndarray, pcs: np.ndarray, n: int, multiplier: float, lo: float, hi: float, window: int | None = None) -> tuple[np.ndarray, np.ndarray, float, float, float]:
    """x (channels, samples) -> clean, noise, score, threshold, eigenvalue. Epochs of n samples, and the same half an epoch
    later, are cleaned apart and laid over each other under raised cosines. The tail is padded with its mirror image."""
    clean, noise, score, t, theta = clean_stack(x[None], ref, pcs, n, multiplier, lo, hi, window)
    return clean[0], noise[0], float(score[0]), float(t[0]), float(theta[0])


def epoch_scores(s: Spectrum, ref: np.ndarray, pcs: np.ndarray, multiplier: float) -> np.ndarray:
    """An epoch's part of the score for each number k of its largest components that are noise: spectra (..., epochs, c) ->
    (..., epochs, c + 1). A threshold only decides k, so a search over thresholds looks scores up."""
    size = np.abs(s.values)
    rv = ref @ s.vectors
    rank = np.argsort(np.argsort(-size, axis=-1, kind="stable"), axis=-1)
    out = np.zeros((*size.shape[:-1], size.shape[-1] + 1))
    for k in range(out.shape[-1]):
        for sign, mask in ((-multiplier, rank < k), (1.0, rank >= k)):
            if k == (0 if sign < 0 else size.shape[-1]):
                continue
            c = (rv * (size * mask)[..., None, :]) @ np.swapaxes(rv, -1, -2)
            q = np.broadcast_to(pcs, (*c.shape[:-2], *pcs.shape))
            for _ in range(2):
                q = np.linalg.qr(c @ q)[0]
            # the cosines' product is the determinant, as both bases are orthonormal
            out[..., k] += sign * 100 * np.clip(np.abs(np.linalg.det(np.swapaxes(q, -1, -2) @ pcs)), 0, 1)
    return out


def searched(values: np.ndarray, scores: np.ndarray, lo: float, hi: float) -> tuple[np.ndarray, np.ndarray]:
    """search() for a stack at once: values (stack, epochs, c) and their epoch_scores() -> thresholds, eigenvalues."""
    size = np.abs(values)
    if (size > 0).all():
        level = np.percentile(np.log(size.reshape(len(size), -1)) + 100, PERCENTILE, axis=-1)
    else:
        level = np.array([np.percentile(np.log(v[v > 0]) + 100, PERCENTILE) if (v > 0).any() else -np.inf for v in size])

    def theta(t: np.ndarray) -> np.ndarray:
        return np.exp((105 - t) / 100 * level - 100)

    def worse(t: np.ndarray) -> np.ndarray:
        return -mean_score(size, scores, theta(t))

    t = linalg.bounded_minima(worse, np.full(len(size), float(lo)), np.full(len(size), float(hi)))
    return t, theta(t)


def mean_score(size: np.ndarray, scores: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """Mean over epochs of what the thresholds (stack) make of epoch_scores(); size: the eigenvalues without sign."""
    k = (size >= theta[:, None, None]).sum(-1)
    return np.take_along_axis(scores, k[..., None], -1)[..., 0].mean(-1)


def moving_thresholds(values: np.ndarray, scores: np.ndarray, lo: float, hi: float, size: int) -> np.ndarray:
    """window_thresholds() for a stack: all windows of all its members are searched at once."""
    epochs = np.arange(values.shape[1])
    if size >= len(epochs):
        return np.repeat(searched(values, scores, lo, hi)[1][:, None], len(epochs), axis=1)
    windows = np.lib.stride_tricks.sliding_window_view(epochs, size)[:: max(1, size // 2)]
    own = searched(*(a[:, windows].reshape(-1, size, a.shape[-1]) for a in (values, scores)), lo, hi)[1].reshape(len(values), len(windows))
    knots = {0.0: 0, float(epochs[-1]): -1} | {w[0] + size / 2: k for k, w in enumerate(windows)}
    padded = np.pad(own, ((0, 0), (1, 1)))
    value = (padded[:, :-2] + own + padded[:, 2:]) / 3 if own.shape[1] > 2 else own
    at = np.array(sorted(knots))
    return np.array([np.maximum(linalg.akima(at, v[[knots[x] for x in at]], epochs.astype(float)), 1e-12) for v in value])


def clean_stack(x: np.ndarray, ref: np.ndarray, pcs: np.ndarray, n: int, multiplier: float, lo: float, hi: float, window: int | None = None) -> tuple[np.ndarray, ...]:
    """clean_band() for a stack x (recordings, channels, samples): each on its own, all in the same calls."""
    many, channels, size = x.shape
    x = np.concatenate([x, x[..., ::-1][..., : -size % n]], axis=-1)
    count = x.shape[-1] // n
    one = x.reshape(many, channels, count, n).swapaxes(1, 2)
    s1 = spectrum(one, ref)
    scores = epoch_scores(s1, ref, pcs, multiplier)
    t, theta = searched(s1.values, scores, lo, hi)
    theta1 = moving_thresholds(s1.values, scores, lo, hi, window) if window else np.repeat(theta[:, None], count, axis=1)
    score = mean_score(np.abs(s1.values), scores, theta1.mean(-1))
    clean, noise = np.zeros_like(x), np.zeros_like(x)
    streams = [(one, s1, theta1, 0)]
    if count > 1:
        two = x[..., n // 2 : n // 2 + (count - 1) * n].reshape(many, channels, count - 1, n).swapaxes(1, 2)
        streams.append((two, spectrum(two, ref), (theta1[:, :-1] + theta1[:, 1:]) / 2, n // 2))
    for e, s, th, begin in streams:
        bad = s.vectors * (np.abs(s.values) >= th[..., None])[..., None, :]
        z = ref @ bad @ (np.swapaxes(bad, -1, -2) @ e)
        w = _weights(e.shape[1], n, begin > 0)[:, None, :] if count > 1 else 1.0
        for part, out in ((e - z, clean), (z, noise)):
            out[..., begin : begin + e.shape[1] * n] += (part * w).swapaxes(1, 2).reshape(many, channels, -1)
    return clean[..., :size], noise[..., :size], score, t, theta


def prepared_reference(ref: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    r = linalg.shrink((ref + ref.T) / 2)
    return r, linalg.top_components(r, COMPONENTS)


def band_plan(fs: float, size: int, lowcut: float, cycles: float = 12.0) -> list[dict]:
    """For each band: limits, epoch samples and the lower end of the search; None for epochs where the band passes through."""
    levels = wavelet_level(fs, lowcut, size)
    out = []
    for b in range(levels + 1):
        hi = fs / 2 ** (b + 1)
        lo = fs / 2 ** (b + 2) if b < levels else 0.0
        seconds = min(cycles / lo, max(size / fs / 3, 0.5)) if lo else max(size / fs / 3, 0.5)
        centre = (lo + hi) / 2
        out.append({"band": b + 1, "lo": lo, "hi": hi, "n": even_samples(seconds, fs) if hi > lowcut else None, "t_min": -6.0 if 0.8 <= centre <= 60 else 0.0})
    return out


def own_reference(ref: np.ndarray, names: list[str] | None):
    """Channels of a group -> its prepared reference: rows and columns of ref (for `names`) that the group has, by name."""
    known: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}

    def of(channels: list[str]) -> tuple[np.ndarray, np.ndarray]:
        key = tuple(channels)
        if key not in known:
            at = [names.index(c) for c in channels] if names else range(len(ref))
            known[key] = prepared_reference(ref[np.ix_(at, at)])
        return known[key]

    return of


#: What a group's linear algebra can raise; anything else is a fault of the program.
UNSOLVED = (np.linalg.LinAlgError, ValueError, FloatingPointError)


def reasons(rec: DataFrame, size: int) -> DataFrame:
    """(rec, error) for every recording: why it can't be cleaned, null if nothing speaks against it. Plain aggregates."""
    finite = F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") != float("inf"))
    per = rec.groupBy("rec", "ch").agg(F.count_if(~finite).alias("bad"), F.count("*").alias("n"), (F.min("v") < F.max("v")).alias("moves"))
    of = per.groupBy("rec").agg(F.sum("bad").alias("bad"), F.min("n").alias("n"), F.count_if("moves").alias("live"), F.count("*").alias("channels"))
    said = F.when(F.col("bad") > 0, F.format_string("input: %d samples are not finite", "bad"))
    said = said.when(F.col("n") < size, F.format_string(f"input: a channel has %d of {size} samples", "n"))
    said = said.when(F.col("live") <= COMPONENTS, F.format_string(f"input: signal in %d of %d channels, more than {COMPONENTS} needed", "live", "channels"))
    return of.select("rec", said.alias("error"))


#: Recordings whose arrays are worked on at once, so that a task's memory doesn't depend on its share of the input.
STACK = 128


def _field(name: str, c: Column) -> Column:
    return c["s"][name]


def packed(rec: DataFrame, why: DataFrame | None = None, **values: str) -> DataFrame:
    """rec(rec, ch, i, v) -> (rec, ch, at, x, error), a row for each recording: its channels by name, the places and values of each
    in order of place. error is why's, else null. values: other columns than v as x, by name. Rows meet by recording at once."""
    values = values or {"x": "v"}
    dealt = rec.select("rec", "ch", "i", *values.values()).repartition(adapters.partitions(rec.sparkSession), "rec")
    by = dealt.groupBy("rec", "ch").agg(F.array_sort(F.collect_list(F.struct("i", *values.values()))).alias("s"))
    of = by.select("rec", F.struct("ch", "s").alias("c")).groupBy("rec").agg(F.array_sort(F.collect_list("c")).alias("c"))
    rows = of.select("rec", F.col("c")["ch"].alias("ch"), *[F.transform("c", partial(_field, v)).alias(k) for k, v in {"at": "i", **values}.items()])
    return rows.withColumn("error", F.lit(None).cast("string")) if why is None else rows.join(why.hint("merge"), "rec").select("rec", "ch", "at", *values, "error")


def unpacked(rows: DataFrame, *also: str, kept: tuple[str, ...] = ()) -> DataFrame:
    """A row for each sample of packed rows: (rec, ch, i, also..., kept...). Rows without at count their samples from 0."""
    columns = [c for c in ("at", *also) if c in rows.columns]
    per = rows.select("rec", *kept, F.explode(F.arrays_zip("ch", *columns)).alias("c")).select("rec", *kept, "c.ch", *[F.col(f"c.{c}").alias(c) for c in columns])
    long = per.select("rec", "ch", *kept, F.posexplode(F.arrays_zip(*columns)).alias("k", "s"))
    return long.select("rec", "ch", (F.col("s.at") if "at" in columns else F.col("k").cast("long")).alias("i"), *[F.col(f"s.{c}").alias(c) for c in also], *kept)


def _ragged(values: list[np.ndarray]) -> pa.Array:
    """Matrices (channels, samples) as Arrow's lists of lists."""
    rows = [v for m in values for v in m]
    flat = np.concatenate([np.zeros(0), *rows])
    inner = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), pa.array(flat))
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, values)]), pa.int32()), inner)


def _recordings(outer: pa.Array) -> list[list[np.ndarray]]:
    """The channels' values of each row; null becomes NaN."""
    inner = outer.flatten()
    values = inner.flatten().to_numpy(zero_copy_only=False)
    ends, at = np.cumsum(pc.list_value_length(inner).to_numpy(zero_copy_only=False)).astype(int), np.cumsum([0, *pc.list_value_length(outer).to_pylist()])
    each = np.split(values, ends[:-1]) if len(ends) else []
    return [each[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def why_not(x: list[np.ndarray], size: int) -> str | None:
    """reasons() for one recording."""
    bad, n, live = sum(int((~np.isfinite(v)).sum()) for v in x), min(map(len, x)), sum(bool(len(v)) and v.min() < v.max() for v in x)
    if bad:
        return f"input: {bad} samples are not finite"
    if n < size:
        return f"input: a channel has {n} of {size} samples"
    return f"input: signal in {live} of {len(x)} channels, more than {COMPONENTS} needed" if live <= COMPONENTS else None


def by_recording(rows: DataFrame, work, schema: str, ref: np.ndarray, names: list[str] | None, stage: str, size: int | None = None, of: tuple[str, ...] = ("x",)) -> DataFrame:
    """work(each of `of` as (recordings, channels, samples), reference, pcs) -> the columns of schema, an item for each recording, done in
    a stack for all recordings of the same channels and length. A recording that can't be worked on, whatever the others are, has
    the reason in error and null, or a matrix of NaN. size: where given, recordings are checked by why_not() first."""
    reference, fields = own_reference(ref, names), schema.split(", ")

    def stacked(channels: tuple, xs: list[list[np.ndarray]]) -> list[tuple]:
        try:
            return [(None, *r) for r in zip(*work(*(np.stack(x) for x in zip(*xs, strict=True)), *reference(list(channels))), strict=True)]
        except UNSOLVED as e:
            if len(xs) == 1:
                return [(told(e, stage), *[None] * len(fields))]
            return [stacked(channels, [x])[0] for x in xs]

    def run(batches):
        for whole in batches:
            for begin in range(0, whole.num_rows, STACK):
                batch = whole.slice(begin, STACK)
                errors, chs = batch.column("error").to_pylist(), batch.column("ch").to_pylist()
                xs = list(zip(*(_recordings(batch.column(c)) for c in of), strict=True))
                groups: dict[tuple, list[int]] = {}
                for k, x in enumerate(xs):
                    errors[k] = errors[k] or (why_not(x[0], size) if size is not None else None)
                    if errors[k] is None:
                        groups.setdefault((tuple(chs[k]), tuple(map(len, x[0]))), []).append(k)
                done: list[tuple] = [(e, *[None] * len(fields)) for e in errors]
                for (channels, _), at in groups.items():
                    for k, r in zip(at, stacked(channels, [xs[k] for k in at]), strict=True):
                        done[k] = r
                held = [batch.column(c) for c in same] + [pa.array([d[0] for d in done], pa.string())]
                for j, field in enumerate(fields, 1):
                    if field.endswith("array<array<double>>"):
                        held.append(_ragged([[np.full(len(v), np.nan) for v in x[0]] if d[j] is None else d[j] for d, x in zip(done, xs, strict=True)]))
                    elif field.endswith("array<string>"):
                        held.append(pa.array([d[j] for d in done], pa.list_(pa.string())))
                    else:
                        held.append(pa.array([None if d[j] is None else np.asarray(d[j], float).tolist() for d in done], pa.list_(pa.float64())))
                yield pa.RecordBatch.from_arrays(held, names=[*same, "error", *(f.split()[0] for f in fields)])

    kinds = {"rec": "string", "ch": "array<string>", "at": "array<array<bigint>>"}
    same = [c for c in kinds if c in rows.columns]
    return rows.mapInArrow(run, ", ".join([f"{c} {kinds[c]}" for c in same] + ["error string", schema]))


class Unsolved(ValueError):
    """A failure that says at which stage it was."""


def told(e: Exception, stage: str) -> str:
    return str(e) if isinstance(e, Unsolved) else f"{stage}: {e}"


def solved(stage: str, *args) -> tuple[np.ndarray, ...]:
    try:
        return clean_stack(*args)
    except UNSOLVED as e:
        raise Unsolved(f"{stage}: {e}") from e


def referenced_stack(x: np.ndarray) -> np.ndarray:
    """average_reference() of a stack."""
    return x - x.sum(-2, keepdims=True) / (x.shape[-2] + 1)


def _moving(window_seconds: float | None, fs: float, n: int) -> int | None:
    return max(round(window_seconds * fs / n), 1) if window_seconds else None


def clean_recordings(rows: DataFrame, ref: np.ndarray, fs: float, size: int, lowcut: float = 0.5, kind: str = "auto", window_seconds: float | None = None, names: list[str] | None = None, referenced: bool = False, check: bool = True) -> DataFrame:
    """packed rows -> (rec, ch, at, error, clean, noise): clean_or_reason() with a row for each recording."""
    work = cleaner(fs, size, lowcut, kind, window_seconds, referenced)
    return by_recording(rows, work, "clean array<array<double>>, noise array<array<double>>", ref, names, "broadband", size if check else None)


def cleaner(fs: float, size: int, lowcut: float = 0.5, kind: str = "auto", window_seconds: float | None = None, referenced: bool = False):
    """What clean_recordings() does to a stack: (recordings, channels, samples), reference, pcs -> clean, noise."""
    plan = band_plan(fs, size, lowcut)

    def work(x: np.ndarray, r: np.ndarray, pcs: np.ndarray) -> tuple:
        x = x if referenced else referenced_stack(x)
        passed = signal.highpass_stack(x, fs, lowcut)
        whole = solved("broadband", passed, r, pcs, even_samples(2.0, fs), noise_multiplier("auto-"), -2.0, 12.0)[0]
        clean = np.zeros_like(x)
        for p, v in zip(plan, signal.haar_stack(whole, len(plan) - 1), strict=True):
            if p["n"] and p["n"] <= size:
                v = solved(f"band {p['band']}", v, r, pcs, p["n"], noise_multiplier(kind), p["t_min"], 12.0, _moving(window_seconds, fs, p["n"]))[0]
            clean += v
        return clean, x - clean

    return work


def clean_or_reason(rec: DataFrame, ref: np.ndarray, fs: float, size: int, lowcut: float = 0.5, kind: str = "auto", window_seconds: float | None = None, names: list[str] | None = None, referenced: bool = False, why: DataFrame | None = None) -> DataFrame:
    """rec(rec, ch, i, v) of `size` samples each -> (rec, ch, i, clean, noise, error), noise being the referenced input less
    clean. Average reference (unless it is referenced), high-pass, a broadband pass over 2-second epochs, then every band
    of the undecimated transform on its own; a recording is a row of size * channels values between.
    window_seconds moves the thresholds with time. names are ref's channels; where given, recordings may lack some of them.
    why: reasons() found before, of what rec was made from.

    A recording that can't be cleaned keeps its rows with null in clean and noise and the reason in error: its later stages
    are skipped, and the other recordings' rows are as without it.
    """
    done = clean_recordings(packed(rec, why), ref, fs, size, lowcut, kind, window_seconds, names, referenced, why is None)
    worked = F.col("error").isNull()
    return unpacked(done, "clean", "noise", kept=("error",)).select("rec", "ch", "i", *[F.when(worked, F.col(c)).alias(c) for c in ("clean", "noise")], "error")


def successful(df: DataFrame) -> DataFrame:
    """df without error, where no row has one: one that has fails the job with its reason."""
    return df.where(F.when(F.col("error").isNull(), True).otherwise(F.raise_error(F.concat("rec", F.lit(": "), "error")).cast("boolean"))).drop("error")


def clean(rec: DataFrame, ref: np.ndarray, fs: float, size: int, **options) -> DataFrame:
    """clean_or_reason() without error, for recordings that have to be clean: one that can't be fails the job with its reason."""
    return successful(clean_or_reason(rec, ref, fs, size, **options))


def clean_parts(rows: DataFrame, ref: np.ndarray, fs: float, size: int, **options) -> DataFrame:
    """clean() of packed rows."""
    return unpacked(successful(clean_recordings(rows, ref, fs, size, **options)), "clean", "noise")


def clean_bands(rows: DataFrame, ref: np.ndarray, fs: float, size: int, lowcut: float, kind: str = "auto", window_seconds: float | None = None, names: list[str] | None = None, referenced: bool = True) -> DataFrame:
    """Every band of packed rows cleaned on its own: (rec, band, score, threshold, ch, at, clean, noise). Bands at or below lowcut, and
    those of a recording that can't be solved, pass through with a null score."""
    plan = band_plan(fs, size, lowcut)
    kernel = [p for p in plan if p["n"] and p["n"] <= size]
    each = [f"{name}{p['band']} array<{'array<double>' if name in ('clean', 'noise') else 'double'}>" for p in plan for name in ("clean", "noise", "told")]

    def work(x: np.ndarray, r: np.ndarray, pcs: np.ndarray) -> list:
        out: list = []
        for p, v in zip(plan, signal.haar_stack(x if referenced else referenced_stack(x), len(plan) - 1), strict=True):
            c, z, told = v, np.zeros_like(v), [[]] * len(v)
            if p in kernel:
                c, z, score, t, _ = clean_stack(v, r, pcs, p["n"], noise_multiplier(kind), p["t_min"], 12.0, _moving(window_seconds, fs, p["n"]))
                told = list(zip(score, t, strict=True))
            out += [c, z, told]
        return out

    done = by_recording(rows, work, ", ".join(each), ref, names, "band")
    bands = [F.struct(F.lit(p["band"]).alias("band"), F.get(f"told{p['band']}", F.lit(0)).alias("score"), F.get(f"told{p['band']}", F.lit(1)).alias("threshold"), F.col(f"clean{p['band']}").alias("clean"), F.col(f"noise{p['band']}").alias("noise")) for p in plan]
    same = [c for c in ("rec", "ch", "at", "error") if c in done.columns]
    return done.select(*same, F.explode(F.array(*bands)).alias("b")).select(*same, "b.*")


def band_summary(banded: DataFrame, n: int) -> DataFrame:
    """clean_bands() -> a row per recording and band: score, threshold (both null where the band passed through) and noise share."""
    long = unpacked(banded, "clean", "noise", kept=("band", "score", "threshold")).withColumn("epoch", F.floor(F.col("i") / n).cast("long"))
    same = [F.first(c).alias(c) for c in ("score", "threshold")]
    per = long.groupBy("rec", "band", "epoch").agg(F.var_pop("noise").alias("a"), F.var_pop(F.col("clean") + F.col("noise")).alias("b"), *same)
    share = F.coalesce(F.avg(F.when(F.col("b") > 0, F.try_divide("a", "b"))), F.lit(0.0))
    return per.groupBy("rec", "band").agg(*same, share.alias("enova"))


def final_sensai(parts: DataFrame, ref: np.ndarray, fs: float, names: list[str] | None = None) -> DataFrame:
    """(rec, sensai): 1-second epochs of the real clean and noise signals against the reference. parts(rec, ch, i, clean, noise), or
    the rows of clean_recordings(). names are ref's channels; where given, recordings may lack some of them."""
    rows = packed(parts, clean="clean", noise="noise") if "i" in parts.columns else parts

    def work(clean: np.ndarray, noise: np.ndarray, r: np.ndarray, pcs: np.ndarray) -> tuple:
        return ([[s] if s == s else [] for s in final_sensai_stack(clean, noise, pcs, int(fs))],)

    done = successful(by_recording(rows, work, "sensai array<double>", ref, names, "sensai", of=("clean", "noise")))
    return done.select("rec", F.get("sensai", F.lit(0)).alias("sensai")).where("sensai is not null")


def final_sensai_stack(clean: np.ndarray, noise: np.ndarray, pcs: np.ndarray, n: int) -> np.ndarray:
    """final_sensai() of a stack; NaN without a full epoch."""
    many, channels, size = clean.shape
    count = size // n
    if not count:
        return np.full(many, np.nan)
    shares = []
    for x in (clean, noise):
        c = linalg.covariance(x[..., : count * n].reshape(many, channels, count, n).swapaxes(1, 2))
        near = np.clip(np.abs(np.linalg.det(np.swapaxes(linalg.top_components(c, COMPONENTS), -1, -2) @ pcs)), 0, 1)
        shares.append(np.where(np.trace(c, axis1=-2, axis2=-1) > 0, near, 0.0).mean(-1))
    return 100 * shares[0] - 100 * shares[1]


def score_curve(rows: DataFrame, ref: np.ndarray, n: int, thresholds: list[float], kind: str = "auto", referenced: bool = True) -> DataFrame:
    """packed rows -> (rec, t, score) over a grid of thresholds; the spectra and their scores are solved once."""

    def work(x: np.ndarray, r: np.ndarray, pcs: np.ndarray) -> tuple:
        x = x if referenced else referenced_stack(x)
        count = x.shape[-1] // n
        s = spectrum(x[..., : count * n].reshape(*x.shape[:2], count, n).swapaxes(1, 2), r)
        scores, size = epoch_scores(s, r, pcs, noise_multiplier(kind)), np.abs(s.values)
        theta = np.array([[eigenvalue_threshold(t, v) for v in s.values] for t in thresholds])
        return (np.array([mean_score(size, scores, at) for at in theta]).T,)

    done = successful(by_recording(rows, work, "scores array<double>", ref, None, "score"))
    at = F.arrays_zip(F.array(*[F.lit(t) for t in thresholds]).alias("t"), F.col("scores").alias("score"))
    return done.select("rec", F.inline(at))


def two_pass(rec: DataFrame, ref: dict[tuple[str, str], float], fs: float, size: int, threshold: float, first: DataFrame | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """Cleans; in each recording finds the channels with a noise share above threshold; recordings with any, and with
    channels enough without them, are cleaned again without them. Gives the parts and bad(rec, ch).

    The first pass is read three times: first may give it, written to a table.
    """
    names = sorted({a for a, _ in ref})
    matrix = np.array([[ref[a, b] for b in names] for a in names])
    first = clean(rec, matrix, fs, size, names=names, **options) if first is None else first
    shares = signal.enova_per_channel(first, int(fs))
    bad = shares.where(F.col("enova") > threshold).select("rec", "ch")
    again = cleaned_again(shares, threshold).select("rec")
    second = clean(rec.join(again, "rec", "left_semi").join(bad, ["rec", "ch"], "left_anti"), matrix, fs, size, names=names, **options)
    return first.join(again, "rec", "left_anti").unionByName(second), bad


def cleaned_again(shares: DataFrame, threshold: float) -> DataFrame:
    """shares(rec, ch, enova) -> (rec, good) of the recordings that have channels above threshold, and enough others, which are good."""
    good = F.col("enova") <= threshold
    left = shares.groupBy("rec").agg(F.collect_list(F.when(good, F.col("ch"))).alias("good"), F.count("*").alias("all"))
    return left.where((F.size("good") < F.col("all")) & (F.size("good") > COMPONENTS)).select("rec", "good")


def two_pass_shares(rows: DataFrame, shares: DataFrame, ref: np.ndarray, names: list[str], fs: float, size: int, threshold: float) -> DataFrame:
    """two_pass() of packed rows where only noise shares are asked: shares(rec, ch, enova) of the first pass -> those after the second,
    and n_bad, how many channels of the recording were above threshold."""
    again = cleaned_again(shares, threshold)
    own = [c for c in ("ch", "at", "x") if c in rows.columns]
    some = rows.join(again.hint("merge"), "rec").withColumn("c", F.filter(F.arrays_zip(*own), lambda c: F.array_contains("good", c["ch"])))
    some = some.select("rec", *[F.col("c")[c].alias(c) for c in own], "error")
    second = signal.enova_per_channel(clean_parts(some, ref, fs, size, names=names), int(fs))
    bad = shares.groupBy("rec").agg(F.count_if(F.col("enova") > threshold).alias("n_bad"))
    return shares.join(again, "rec", "left_anti").unionByName(second).join(bad, "rec")
