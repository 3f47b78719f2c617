"""Deterministic artifacts added to recordings: every injector gives (rec, ch, i, v, artifact) and leaves its input alone."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Frontal prefixes in order of weight.
FRONTAL = ("fp", "af", "f", "fc")


def frontal_weight(ch: Column) -> Column:
    w = F.lit(0.1)
    for kw in reversed(FRONTAL):
        w = F.when(F.lower(ch).startswith(kw), 1 - 0.1 * len(kw)).otherwise(w)
    return w


def muscle_weight(ch: Column) -> Column:
    base = F.regexp_replace(F.lower(ch), r"\d+$", "")
    side = F.when(F.right(ch, F.lit(1)).rlike("[13579]"), 1.2).otherwise(1.0)
    return F.when(base.isin("t", "tp", "p", "ft", "c"), 0.8).otherwise(0.05) * side


def _added(rec: DataFrame, artifact: Column) -> DataFrame:
    a = F.coalesce(artifact, F.lit(0.0))
    return rec.withColumn("artifact", a).withColumn("v", F.col("v") + F.col("artifact"))


def line_noise(rec: DataFrame, fs: float, freq: float, amplitude: float = 20.0) -> DataFrame:
    """A sine and its harmonics below half the rate, each weaker by its number; phase and strength by channel index."""
    tone = F.lit(0.0)
    for h in range(1, max(1, math.ceil(fs / 2 / freq) - 1) + 1):
        tone = tone + F.sin(F.lit(2 * math.pi * freq * h / fs) * F.col("i") + F.col("ch_idx") * h) / h
    return _added(rec, amplitude * (0.5 + F.pmod(F.col("ch_idx") * 0.37, F.lit(1.0))) * tone)


def drift(rec: DataFrame, fs: float, freq: float = 0.1, amplitude: float = 50.0) -> DataFrame:
    return _added(rec, amplitude * (0.3 + F.pmod(F.col("ch_idx") * 0.61, F.lit(1.2))) * F.sin(F.lit(2 * math.pi * freq / fs) * F.col("i") + F.col("ch_idx")))


def _within(rec: DataFrame, epochs: list[int], n: int, start: int, length: int) -> Column:
    """Samples since the artifact's onset in the chosen epochs, null outside."""
    k = F.col("i") % n - start
    return F.when(F.floor(F.col("i") / n).isin(epochs) & (k >= 0) & (k < length), k)


def electrode_pop(rec: DataFrame, epochs: list[int], n: int, start: int, fs: float, amplitude: float = 200.0, tau: float = 0.1) -> DataFrame:
    k = _within(rec, epochs, n, start, n)
    return _added(rec, F.when(F.col("ch_idx") == 0, amplitude * F.exp(-k / F.lit(tau * fs))))


def blink_shape(u: Column) -> Column:
    """A Gaussian around 0.45 of the blink that falls faster than it rises."""
    g = F.exp(-F.pow(u - 0.45, F.lit(2)) / (2 * 0.15**2))
    return F.when(u > 0.45, F.pow(g, F.lit(1.5))).otherwise(g)


def blink(rec: DataFrame, epochs: list[int], n: int, start: int, length: int, amplitude: float = 150.0) -> DataFrame:
    k = _within(rec, epochs, n, start, length)
    return _added(rec, amplitude * frontal_weight(F.col("ch")) * blink_shape(k / max(length - 1, 1)))


def saccade(rec: DataFrame, epochs: list[int], n: int, start: int, length: int, amplitude: float = 80.0) -> DataFrame:
    """Ramp, plateau, fall by thirds; even channels have the other sign."""
    u = _within(rec, epochs, n, start, length) / length
    shape = F.when(u < 1 / 3, 3 * u).when(u < 2 / 3, 1.0).otherwise(3 * (1 - u))
    return _added(rec, amplitude * F.when(F.col("ch_idx") % 2 == 0, -0.8).otherwise(1.0) * shape)


def uniform(seed: int, *key: str) -> Column:
    """A number between 0 and 1 from the hash of seed and key alone: the same on every partitioning, in any order, in any engine with MD5."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), *[F.col(k).cast("string") for k in key]))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / float(1 << 32)


def normal(seed: int, *key: str) -> Column:
    """A standard normal deviate for each key, by Box-Muller over two hashes."""
    return F.sqrt(-2 * F.ln(uniform(seed, *key))) * F.cos(2 * math.pi * uniform(seed + 1, *key))


def channel_noise(rec: DataFrame, channels: list[str], epochs: list[int], n: int, amplitude: float = 40.0, seed: int = 47) -> DataFrame:
    """White noise on the listed channels in the chosen epochs of n samples: bad contact. Each channel and epoch has its own
    strength, `amplitude` times a factor between 0.5 and 2. Epochs that hold fewer than two samples stay as they are."""
    epoch = F.floor(F.col("i") / n).cast("long")
    held = F.count("*").over(Window.partitionBy("rec", "ch", "noise_epoch"))
    rows = rec.withColumn("noise_epoch", epoch)
    strength = amplitude * (0.5 + 1.5 * uniform(seed + 2, "rec", "ch", "noise_epoch"))
    return _added(rows, F.when(F.col("noise_epoch").isin(epochs) & F.col("ch").isin(channels) & (held > 1), strength * normal(seed, "rec", "ch", "i"))).drop("noise_epoch")


def growing_noise(rec: DataFrame, size: int, strongest: float, seed: int = 99) -> DataFrame:
    """White noise that grows from 0 to `strongest`; the same for the same seed and place."""
    return _added(rec, strongest * F.col("i") / max(size - 1, 1) * normal(seed, "rec", "ch", "i"))


#: Artifacts that drawn epochs get, and their strengths.
DRAWN = {"blink": 40.0, "electrode_pop": 60.0, "line_noise": 25.0}


def drawn_epochs(recs: DataFrame, n_epochs: int, share: float, n: int, fs: float, seed: int = 42, kinds: dict[str, float] = DRAWN) -> DataFrame:
    """recs(rec) -> a row for each epoch that is to be corrupted, drawn without replacement: the ceil(share * n_epochs) of each
    recording with the smallest hashes; with the artifact's kind (by hash), first and last sample, seconds, strength and seed."""
    each = recs.select("rec").distinct().select("rec", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_epochs - 1).cast("long"))).alias("epoch"))
    rank = F.row_number().over(Window.partitionBy("rec").orderBy(F.xxhash64("rec", "epoch", F.lit(seed)), "epoch"))
    some = each.withColumn("r", rank).where(F.col("r") <= math.ceil(share * n_epochs)).drop("r")
    kind = F.element_at(F.array(*[F.lit(k) for k in kinds]), (F.pmod(F.xxhash64("rec", "epoch", F.lit(seed + 1)), F.lit(len(kinds))) + 1).cast("int"))
    strength = F.element_at(F.create_map(*[F.lit(x) for k in kinds.items() for x in k]), F.col("artifact_type"))
    some = some.withColumn("artifact_type", kind)
    return some.select("rec", "artifact_type", "epoch", (F.col("epoch") * n).alias("start_sample"), ((F.col("epoch") + 1) * n - 1).alias("end_sample"), F.lit(n / fs).alias("duration_sec"), strength.alias("amplitude_uv"), F.lit(seed).alias("random_seed"))


def popping(rec, epoch) -> Column:
    """The index of the electrode that pops."""
    return F.pmod(F.xxhash64(rec, epoch), F.lit(8))


def pop_shape(k: Column, n: int) -> Column:
    return F.exp(-k / F.lit(max(n / 2, 1)))


def tone_weight(ch_idx: Column) -> Column:
    return 0.5 + F.pmod(ch_idx * 0.37, F.lit(1.0))


def tone(i: Column) -> Column:
    return F.sin(F.lit(2 * math.pi * 0.375) * i)


def inject_drawn(rec: DataFrame, drawn: DataFrame, n: int, fs: float) -> DataFrame:
    """rec(rec, ch, ch_idx, i, v) with the artifacts of drawn: -> (rec, ch, ch_idx, i, epoch, v, artifact). Joined by recording and epoch."""
    both = rec.withColumn("epoch", F.floor(F.col("i") / n).cast("long")).join(drawn.select("rec", "epoch", "artifact_type", "amplitude_uv"), ["rec", "epoch"], "left")
    k, kind = F.col("i") % n, F.col("artifact_type")
    shape = F.when(kind == "blink", frontal_weight(F.col("ch")) * blink_shape(k / max(n - 1, 1)))
    shape = shape.when(kind == "electrode_pop", F.when(F.col("ch_idx") == popping("rec", "epoch"), pop_shape(k, n)).otherwise(0.0))
    shape = shape.when(kind == "line_noise", tone_weight(F.col("ch_idx")) * tone(F.col("i")))
    return _added(both, F.col("amplitude_uv") * shape).select("rec", "ch", "ch_idx", "i", "epoch", "v", "artifact")


def with_drawn(rows: DataFrame, names: list[str], n_epochs: int, share: float, seed: int = 42, kinds: dict[str, float] = DRAWN) -> DataFrame:
    """rows(rec, ch, ...), a row for each recording, with what drawn_stack() takes: weights, for each channel that of a blink, its index in names
    and that of a tone; drawn, the epochs of drawn_epochs(), their kinds' places in kinds, and the indexes of the electrodes that pop."""
    known = F.array(*[F.lit(c) for c in names]).cast("array<string>")

    def weighed(c: Column) -> Column:
        at = F.array_position(known, c) - 1
        return F.array(frontal_weight(c), at.cast("double"), tone_weight(at))

    hashed = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(n_epochs - 1).cast("long")), lambda e: F.struct(F.xxhash64("rec", e, F.lit(seed)).alias("h"), e.alias("epoch")))
    first = F.transform(F.slice(F.array_sort(hashed), 1, math.ceil(share * n_epochs)), lambda d: d["epoch"])
    kind = lambda e: F.pmod(F.xxhash64("rec", e, F.lit(seed + 1)), F.lit(len(kinds))).cast("double")
    drawn = F.array(first.cast("array<double>"), F.transform(first, kind), F.transform(first, lambda e: popping("rec", e).cast("double")))
    return rows.withColumns({"weights": F.transform("ch", weighed), "drawn": drawn})


def shapes(spark: SparkSession, size: int, n: int) -> dict[str, np.ndarray]:
    """What inject_drawn() adds where strength and weight are 1: samples of an epoch of n, for a tone those of the whole recording."""
    upto = lambda m: F.sequence(F.lit(0).cast("long"), F.lit(max(m - 1, 0)).cast("long"))
    blinks, pops = F.transform(upto(n), lambda k: blink_shape(k / max(n - 1, 1))), F.transform(upto(n), lambda k: pop_shape(k, n))
    row = spark.range(1).select(blinks.alias("blink"), pops.alias("electrode_pop"), F.transform(upto(size), tone).alias("line_noise")).first()
    return {c: np.array(row[c]) for c in row.asDict()}


def drawn_stack(weights: np.ndarray, drawn: np.ndarray, size: int, n: int, of: dict[str, np.ndarray], kinds: dict[str, float] = DRAWN) -> np.ndarray:
    """The artifacts of inject_drawn() for a stack of recordings: weights (recordings, channels, 3) and drawn (recordings, 3, epochs) of
    with_drawn(), shapes() -> (recordings, channels, size). An epoch whose kind is -1 gets none."""
    many, channels = weights.shape[:2]
    count = -(-size // n)
    out = np.zeros((many, channels, count, n))
    for code, (kind, strength) in enumerate(kinds.items()):
        r, j = np.nonzero(drawn[:, 1] == code)
        epoch, shape, w = drawn[r, 0, j].astype(int), of[kind], weights[r]
        if kind == "blink":
            one = w[:, :, :1] * shape
        elif kind == "electrode_pop":
            one = np.where(w[:, :, 1:2] == drawn[r, 2, j][:, None, None], shape, 0.0)
        else:
            one = w[:, :, 2:] * np.resize(np.pad(shape, (0, max(count * n - len(shape), 0))), (count, n))[epoch][:, None]
        out[r, :, epoch] = strength * one
    return out.reshape(many, channels, -1)[..., :size]


def injection_snr_db(injected: DataFrame, by: list[str]) -> DataFrame:
    clean = F.col("v") - F.col("artifact")
    s = F.var_pop(clean) / (F.var_pop("artifact") + 1e-12)
    return injected.groupBy(*by).agg(F.when(F.var_pop(clean) > 0, 10 * F.log10(s)).alias("snr_db"))
