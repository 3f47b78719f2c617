"""Filters and spectra of recordings, and what they preserve. One channel's samples are a group; filters are numpy only."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undula.operators.quality import corr_stack, known_mean, safe_corr

SERIES = "rec string, ch string, i long, v double"


def butter_sections(low: float, high: float, fs: float, order: int = 4) -> np.ndarray:
    """Second-order sections (b0 b1 b2 a0 a1 a2) of a Butterworth band-pass, by the bilinear transform."""
    high = min(high, 0.99 * fs / 2)
    w1, w2 = (2 * fs * np.tan(np.pi * f / fs) for f in (low, high))
    centre, width = w1 * w2, w2 - w1
    poles = np.exp(1j * np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order)) * width / 2
    root = np.sqrt(poles**2 - centre + 0j)
    analog = np.concatenate([poles + root, poles - root])
    z = (2 * fs + analog) / (2 * fs - analog)
    z = z[np.imag(z) > 1e-14] if np.all(np.abs(np.imag(z)) > 1e-14) else np.sort_complex(z)[len(z) // 2 :]
    sections = np.array([[1, 0, -1, 1, -2 * p.real, abs(p) ** 2] for p in z])
    at = np.exp(-2j * np.pi * np.sqrt(low * high) / fs)
    gain = np.prod([np.polyval(s[2::-1], at) / np.polyval(s[:2:-1], at) for s in sections])
    sections[:, :3] /= abs(gain) ** (1 / len(sections))
    return sections


def _run(sections: np.ndarray, x: np.ndarray, block: int = 64) -> np.ndarray:
    """Filters each row once, a section at a time, without a loop over samples.

    A section's state is two numbers that a sample moves by a matrix. Each block is filtered from a zero state by one matrix
    product, states at the blocks' ends come from a scan that doubles its reach, and what a block began with is added.
    """
    rows, n = x.shape
    blocks = max(1, -(-n // block))
    y = np.zeros((rows, blocks * block))
    y[:, :n] = x
    y = y.reshape(rows, blocks, block)
    lag = np.subtract.outer(np.arange(block), np.arange(block))
    for b0, b1, b2, _, a1, a2 in sections:
        step = np.array([[-a1, 1.0], [-a2, 0.0]])
        feed = np.array([b1 - a1 * b0, b2 - a2 * b0])
        powers = [np.eye(2)]
        for _ in range(block):
            powers.append(powers[-1] @ step)
        moved = np.array([p @ feed for p in powers[:block]])
        impulse = np.concatenate([[b0], moved[:-1, 0]])
        ends, reach, jump = y @ moved[::-1], 1, powers[block]
        while reach < blocks:
            ends[:, reach:] += ends[:, :-reach].copy() @ jump.T
            jump, reach = jump @ jump, 2 * reach
        y = y @ np.where(lag >= 0, impulse[np.abs(lag)], 0.0).T
        y[:, 1:] += ends[:, :-1] @ np.array([p[0] for p in powers[:block]]).T
    return y.reshape(rows, -1)[:, :n]


def zero_phase(sections: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Forward and backward, with the ends reflected through their last point."""
    n = min(3 * (2 * len(sections) + 1), x.shape[1] - 1)
    if n < 1:
        return x
    padded = np.concatenate([2 * x[:, :1] - x[:, n:0:-1], x, 2 * x[:, -1:] - x[:, -2 : -n - 2 : -1]], axis=1)
    back = _run(sections, _run(sections, padded)[:, ::-1])[:, ::-1]
    return back[:, n : n + x.shape[1]]


def welch(x: np.ndarray, fs: float, segment: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and mean power density of half-overlapping Hann segments without their mean."""
    n = min(segment, x.shape[-1])
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    starts = range(0, x.shape[-1] - n + 1, max(1, n // 2))
    parts = np.stack([x[..., a : a + n] - x[..., a : a + n].mean(-1, keepdims=True) for a in starts])
    p = (np.abs(np.fft.rfft(parts * w)) ** 2).mean(0) / (fs * (w**2).sum())
    p[..., 1 : -1 if n % 2 == 0 else None] *= 2
    return np.fft.rfftfreq(n, 1 / fs), p


def bandpass(rec: DataFrame, fs: float, low: float, high: float) -> DataFrame:
    sections = butter_sections(low, high, fs)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        return pdf.assign(v=zero_phase(sections, pdf["v"].to_numpy()[None, :])[0])[["rec", "ch", "i", "v"]]

    return rec.select("rec", "ch", "i", "v").groupBy("rec", "ch").applyInPandas(one, SERIES)


def standard_preprocess(rec: DataFrame, fs: float, low: float = 1.0, high: float = 40.0, reference: bool = False) -> DataFrame:
    from undula.operators.signal import average_reference

    out = bandpass(rec, fs, low, high)
    return average_reference(out) if reference else out


def _spectra(rec: DataFrame, fs: float, segment: int) -> DataFrame:
    """(rec, ch, freq, power), the latter two arrays: a row for each channel, whose task takes many channels of one length at a time."""

    def run(batches):
        for batch in batches:
            x, size = batch.column("x"), pc.list_value_length(batch.column("x")).to_numpy(zero_copy_only=False)
            values, ends = x.flatten().to_numpy(zero_copy_only=False), np.cumsum(size)
            out: list = [None] * len(size)
            for n in np.unique(size):
                at = np.flatnonzero(size == n)
                f, p = welch(np.stack([values[ends[k] - n : ends[k]] for k in at]), fs, segment)
                for k, q in zip(at, p, strict=True):
                    out[k] = (f, q)
            kind = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("rec"), batch.column("ch"), *(pa.array([o[j] for o in out], kind) for j in (0, 1))], names=["rec", "ch", "freq", "power"])

    held = F.array_sort(F.collect_list(F.struct("i", "v")))
    return rec.groupBy("rec", "ch").agg(held.alias("s")).select("rec", "ch", F.col("s.v").alias("x")).mapInArrow(run, "rec string, ch string, freq array<double>, power array<double>")


def psd(rec: DataFrame, fs: float, segment: int = 256) -> DataFrame:
    """(rec, ch, freq, power)."""
    return _spectra(rec, fs, segment).select("rec", "ch", F.inline(F.arrays_zip("freq", "power")))


def band_power(rec: DataFrame, fs: float, low: float, high: float) -> DataFrame:
    """Mean density over the bins from low to high, both included; 0 without a bin."""
    inside = F.filter(F.arrays_zip("freq", "power"), lambda b: b["freq"].between(low, high))["power"]
    mean = F.aggregate(inside, F.lit(0.0), lambda total, p: total + p) / F.size(inside)
    return _spectra(rec, fs, 256).select("rec", "ch", F.when(F.size(inside) > 0, mean).otherwise(0.0).alias("power"))


def _two(triple: DataFrame, a: str, b: str):
    return (triple.select("rec", "ch", "i", F.col(c).alias("v")) for c in (a, b))


def psd_similarity(triple: DataFrame, fs: float, low: float = 1.0, high: float = 40.0) -> DataFrame:
    """Correlation of log spectra of ref and cln, averaged over channels; three bins at least."""
    one, two = (psd(x, fs).where(F.col("freq").between(low, high)) for x in _two(triple, "ref", "cln"))
    j = one.withColumnRenamed("power", "p").join(two.withColumnRenamed("power", "q"), ["rec", "ch", "freq"])
    logs = j.select("rec", "ch", F.ln(F.col("p") + 1e-12).alias("p"), F.ln(F.col("q") + 1e-12).alias("q"))
    per = logs.groupBy("rec", "ch").agg(F.when(F.count("*") >= 3, safe_corr("p", "q")).alias("r"))
    return per.groupBy("rec").agg(F.avg("r").alias("psd_similarity"))


def psd_similarity_stack(ref: np.ndarray, cln: np.ndarray, fs: float, low: float = 1.0, high: float = 40.0) -> np.ndarray:
    """psd_similarity() of a stack (recordings, channels, samples); null is NaN."""
    f, p = welch(ref, fs)
    inside = (f >= low) & (f <= high)
    if inside.sum() < 3:
        return np.full(len(ref), np.nan)
    return known_mean(corr_stack(*(np.log(x[..., inside] + 1e-12) for x in (p, welch(cln, fs)[1]))))


def band_correlation(triple: DataFrame, fs: float, low: float, high: float) -> DataFrame:
    """Correlation in time of the band-passed ref and cln, averaged over channels."""
    one, two = (bandpass(x, fs, low, high) for x in _two(triple, "ref", "cln"))
    j = one.withColumnRenamed("v", "p").join(two.withColumnRenamed("v", "q"), ["rec", "ch", "i"])
    return j.groupBy("rec", "ch").agg(safe_corr("p", "q").alias("r")).groupBy("rec").agg(F.avg("r").alias("correlation"))


def power_reduction(triple: DataFrame, fs: float, low: float, high: float) -> DataFrame:
    """Share of the band's artifact power that cleaning takes away."""
    diff = triple.select("rec", "ch", "i", (F.col("cor") - F.col("ref")).alias("a"), (F.col("cln") - F.col("ref")).alias("b"))
    before, after = (bandpass(diff.select("rec", "ch", "i", F.col(c).alias("v")), fs, low, high).groupBy("rec").agg(F.var_pop("v").alias(c)) for c in "ab")
    return before.join(after, "rec").select("rec", ((F.col("a") - F.col("b")) / (F.col("a") + 1e-12)).alias("reduction"))


def line_noise_reduction(triple: DataFrame, fs: float, freq: float) -> DataFrame:
    return power_reduction(triple, fs, freq - 2, freq + 2)


def erd_ers(trials: DataFrame, fs: float, low: float, high: float, classes: tuple[int, int]) -> DataFrame:
    """trials(trial, label, ch, i, ref, cln): the class contrast of band power by channel, before and after: its correlation
    and whether the signs agree. One class only: 1 and true."""
    long = trials.select(F.concat_ws(":", "trial", "label").alias("rec"), F.col("ch").cast("string").alias("ch"), "i", "ref", "cln")
    powers = []
    for c in ("ref", "cln"):
        p = band_power(long.select("rec", "ch", "i", F.col(c).alias("v")), fs, low, high)
        label = F.split("rec", ":")[1].cast("int")
        sides = [F.avg(F.when(label == k, F.col("power"))) for k in classes]
        powers.append(p.groupBy("ch").agg((sides[0] - sides[1]).alias(c)))
    j = powers[0].join(powers[1], "ch")
    r = j.agg(F.count("ref").alias("n"), safe_corr("ref", "cln").alias("r"), F.avg((F.signum("ref") == F.signum("cln")).cast("double")).alias("same"))
    return r.select(F.when(F.col("n") == 0, 1.0).otherwise(F.col("r")).alias("erd_correlation"), F.when(F.col("n") == 0, True).otherwise(F.col("same") > 0.5).alias("erd_preserved"))


def riemann_distance(triple: DataFrame, n: int, most: int = 50) -> DataFrame:
    """Mean affine-invariant distance of the epochs' covariances before and after; the first `most` epochs are the metric's."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        from undula.operators import linalg

        a, b = (linalg.covariance(pdf.pivot(index="ch", columns="i", values=c).to_numpy()) for c in ("ref", "cln"))
        eye = 1e-6 * np.eye(len(a))
        values = linalg.generalized(b + eye, a + eye)[0]
        return pd.DataFrame({"rec": [pdf["rec"].iloc[0]], "epoch": [pdf["epoch"].iloc[0]], "d": [float(np.sqrt((np.log(np.maximum(values, 1e-300)) ** 2).sum()))]})

    e = triple.withColumn("epoch", F.floor(F.col("i") / n).cast("long")).where(F.col("epoch") < most)
    return e.groupBy("rec", "epoch").applyInPandas(one, "rec string, epoch long, d double").groupBy("rec").agg(F.avg("d").alias("distance"))


def muscle_noise(size: int, channels: int, fs: float, seed: int) -> np.ndarray:
    """Band-passed white noise of unit deviation with a slow envelope."""
    x = np.random.default_rng(seed).normal(size=(channels, size))
    y = zero_phase(butter_sections(min(30, 0.3 * fs), min(200, 0.475 * fs), fs), x)
    return y / np.maximum(y.std(1, keepdims=True), 1e-12) * (0.5 + 0.5 * np.sin(2 * np.pi * 3 * np.arange(size) / fs) ** 2)


def inject_emg(rec: DataFrame, fs: float, amplitude: float = 30.0, seed: int = 44) -> DataFrame:
    """Adds muscle noise to every channel by its weight; a channel's draw follows from the seed and its name."""
    from undula.operators.inject import muscle_weight

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        import zlib

        pdf = pdf.sort_values("i")
        a = amplitude * pdf["w"].iloc[0] * muscle_noise(len(pdf), 1, fs, seed + zlib.crc32(pdf["ch"].iloc[0].encode()))[0]
        return pdf.assign(v=pdf["v"] + a, artifact=a)[["rec", "ch", "i", "v", "artifact"]]

    return rec.select("rec", "ch", "i", "v", muscle_weight(F.col("ch")).alias("w")).groupBy("rec", "ch").applyInPandas(one, SERIES + ", artifact double")
