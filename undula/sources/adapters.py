"""Recordings, trials and sweep results as views over the tables at hand; nothing is read that a query doesn't use.

A recording is long-form: rec, ch, i (sample index), v. Time per (rec, ch) is ordered by i alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FS, HOURS, START = 24, 720, "2024-01-01 00:00:00"
#: The benchmark datasets with window start and end, trial seconds and class count.
REGISTRY = [("BNCI2014_001", -0.5, 4.0, 4.0, 4), ("Zhou2016", 0.0, 5.0, 5.0, 2), ("Weibo2014", 3.0, 7.0, 4.0, 2), ("Shin2017A", 0.0, 4.0, 10.0, 2)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(REGISTRY, "dataset string, tmin double, tmax double, trial_duration_sec double, n_classes int")


def dataset_info(spark: SparkSession, name: str) -> DataFrame:
    """One registered dataset; an unknown name is an error."""
    if name not in {r[0] for r in REGISTRY}:
        raise ValueError(f"unknown dataset {name!r}; known: {', '.join(r[0] for r in REGISTRY)}")
    return registry(spark).where(F.col("dataset") == name)


def events_recording(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly means of event values: a channel for each event type on a dense grid of hours, 0 where nothing happened.
    Events without a time are left out; one outside the grid is an error, so that none is dropped unseen."""
    hour = F.timestamp_diff("HOUR", F.lit(START).cast("timestamp_ntz"), F.col("ts")).cast("long")
    outside = F.raise_error(F.concat(F.lit(f"an event outside the {HOURS} hours from {START}: "), F.col("ts").cast("string"))).cast("long")
    hour = F.when((F.col("ts") >= F.lit(START).cast("timestamp_ntz")) & (hour < HOURS), hour).otherwise(outside)
    events = table(spark, sf_dir, "events").where("ts is not null")
    cells = events.groupBy(F.col("event_type").alias("ch"), hour.alias("i")).agg(F.avg("value").alias("v"))
    # the grid is one row per channel and hour, however many events there are
    grid = events.select(F.col("event_type").alias("ch")).distinct().select("ch", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(HOURS - 1).cast("long"))).alias("i"))
    return grid.join(cells, ["ch", "i"], "left").select(F.lit("events").alias("rec"), "ch", "i", F.coalesce("v", F.lit(0.0)).alias("v"))


def event_span(spark: SparkSession, sf_dir: str, hours: int) -> tuple[list[str], str, int]:
    """Event types in order (they are the montage, so few), the first event's day, and the number of bins up to the last event."""
    events = table(spark, sf_dir, "events").where("ts is not null and user_id is not null and event_type is not null")
    start = F.date_trunc("day", F.min("ts"))
    bins = F.floor(F.timestamp_diff("HOUR", start, F.max("ts")) / hours) + 1
    row = events.agg(F.array_sort(F.collect_set("event_type")).alias("names"), start.cast("string").alias("start"), bins.alias("bins")).first()
    return row["names"], row["start"] or START, row["bins"] or 0


def partitions(spark: SparkSession) -> int:
    """How many tasks share rows that are few or small but take long each; merging them by their size would leave cores idle."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def subject_rows(spark: SparkSession, sf_dir: str, hours: int = 3) -> tuple[DataFrame, list[str], int]:
    """subject_recordings() with a row for each user: (rec, ch, x, error), x an array of `size` samples for each channel of ch; error is null.

    Only bins with events are shuffled and grouped; the lines between them are drawn within the row.
    """
    names, start, size = event_span(spark, sf_dir, hours)
    at = F.floor(F.timestamp_diff("HOUR", F.lit(start).cast("timestamp_ntz"), F.col("ts")) / hours).cast("long")
    events = table(spark, sf_dir, "events").where("ts is not null and user_id is not null and event_type is not null")
    cells = events.groupBy(F.col("user_id").cast("string").alias("rec"), F.col("event_type").alias("ch"), at.alias("i")).agg(F.avg("value").alias("v"))
    knots = F.array_sort(F.collect_list(F.when(F.col("v").isNotNull(), F.struct("i", "v"))))
    per = cells.repartition(partitions(spark), "rec").groupBy("rec", "ch").agg(knots.alias("knots")).groupBy("rec").agg(F.collect_list(F.struct("ch", "knots")).alias("own"))
    first, last = (F.struct(F.lit(i).cast("long").alias("i"), F.lit(0.0).alias("v")) for i in (-1, size))
    # a null that a channel without events gives makes an empty array
    own = F.transform(F.col("ch"), lambda c: F.concat(F.array(first), F.coalesce(F.get(F.filter("own", lambda o: o["ch"] == c), F.lit(0))["knots"], F.expr("array()")), F.array(last)))

    def piece(p: Column, q: Column) -> Column:
        """The samples after knot p up to q, as a line; q's own value comes as it is."""
        line = lambda i: F.when(i == q["i"], q["v"]).otherwise(p["v"] + (q["v"] - p["v"]) * (i - p["i"]) / (q["i"] - p["i"]))
        return F.transform(F.sequence(p["i"] + 1, q["i"]), line)

    def drawn(knots: Column) -> Column:
        pieces = F.zip_with(F.slice(knots, F.lit(1), F.size(knots) - 1), F.slice(knots, F.lit(2), F.size(knots) - 1), piece)
        return F.slice(F.flatten(pieces), F.lit(1), F.lit(max(size, 1)))

    rows = per.withColumn("ch", F.array(*[F.lit(c) for c in names]).cast("array<string>")).select("rec", "ch", own.alias("knots"))
    return rows.select("rec", "ch", F.transform("knots", drawn).alias("x"), F.lit(None).cast("string").alias("error")), names, size


def subject_recordings(spark: SparkSession, sf_dir: str, hours: int = 3) -> tuple[DataFrame, list[str], int]:
    """A recording for each user, with its channel names and length: a channel for each event type, sampled every `hours`
    hours over the time that the table spans. A sample is the mean of the bin's values; between such bins the signal is a
    straight line, from 0 before the first bin and to 0 after the last one, so that it is nowhere constant by chance.

    Events without a user, type or time are left out. An empty table gives no recordings.
    """
    rows, names, size = subject_rows(spark, sf_dir, hours)
    per = rows.select("rec", F.explode(F.arrays_zip("ch", "x")).alias("c"))
    return per.select("rec", F.col("c.ch").alias("ch"), F.posexplode("c.x").alias("i", "v")).withColumn("i", F.col("i").cast("long")), names, size


#: Places of eight electrodes of the 10-20 system on the unit sphere.
ELECTRODES = [("Fp1", -0.31, 0.95, 0.03), ("Fp2", 0.31, 0.95, 0.03), ("F3", -0.55, 0.67, 0.5), ("F4", 0.55, 0.67, 0.5), ("C3", -0.71, 0.0, 0.71), ("C4", 0.71, 0.0, 0.71), ("O1", -0.31, -0.95, 0.03), ("O2", 0.31, -0.95, 0.03)]
#: Bins after an event in which it is felt, and the grid's longest span: one event years away is an error, no long grid.
TAPS, MOST_BINS = 24, 100_000


def mixed_samples(spark: SparkSession, sf_dir: str, mixing: list[list[float]], hours: int = 3, sensor_noise: float = 0.02) -> tuple[DataFrame, int]:
    """mixed_recordings() with a row for each sample: (rec, i, v), v the array of all ELECTRODES' values in their order.

    Only events are shuffled, to their user; what follows is done where they are.
    """
    _, start, size = event_span(spark, sf_dir, hours)
    if size > MOST_BINS:
        raise ValueError(f"events span {size} bins of {hours} hours, at most {MOST_BINS} are gridded")
    events = table(spark, sf_dir, "events").where("ts is not null and user_id is not null and event_type is not null")
    at = F.floor(F.timestamp_diff("HOUR", F.lit(start).cast("timestamp_ntz"), F.col("ts")) / hours).cast("long")
    drawn = lambda k, salt: F.pmod(F.xxhash64("event_id", F.lit(k), F.lit(salt)), F.lit(1 << 32)) / float(1 << 32)
    own = events.select(F.col("user_id").cast("string").alias("rec"), "event_id", F.coalesce("value", F.lit(0.0)).alias("x"), at.alias("at")).repartition(partitions(spark), "rec")
    # an event is felt in TAPS samples; a user's first event brings the whole grid along, in which nothing is felt
    first = F.row_number().over(Window.partitionBy("rec").orderBy("at", "event_id")) == 1
    tap = lambda i, j: F.struct(i.cast("long").alias("i"), j.cast("int").alias("j"))
    felt_in = F.transform(F.sequence(F.lit(0), F.lit(TAPS - 1)), lambda j: tap(F.col("at") + j, j))
    grid = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(max(size - 1, 0)).cast("long")), lambda i: tap(i, F.lit(None)))
    # strength, pitch and phase in each source are drawn once an event, not once a sample
    n = len(mixing[0])
    traits = {f"{c}{k}": v for k in range(n) for c, v in (("strength", F.sqrt(F.abs("x")) * (2 * drawn(k, 1) - 1)), ("pitch", 0.05 + 0.4 * drawn(k, 2)), ("phase", drawn(k, 3)))}
    taps = own.withColumn("first", first).withColumns(traits).select("rec", *traits, F.explode(F.when(F.col("first"), F.concat(grid, felt_in)).otherwise(felt_in)).alias("t"))
    taps = taps.select("rec", *traits, "t.i", "t.j").where(F.col("i") < size).withColumn("decay", F.exp(-F.col("j") / 8))
    felt = lambda k: F.col(f"strength{k}") * F.col("decay") * F.sin(2 * math.pi * (F.col(f"pitch{k}") * F.col("j") + F.col(f"phase{k}")))
    sources = taps.groupBy("rec", "i").agg(*[F.sum(F.when(F.col("j").isNotNull(), felt(k))).alias(f"s{k}") for k in range(n)])
    sensors = [sum((F.coalesce(f"s{k}", F.lit(0.0)) * w for k, w in enumerate(row)), F.lit(0.0)) + sensor_noise * normal(7, F.col("rec"), F.lit(c[0]), F.col("i")) for c, row in zip(ELECTRODES, mixing, strict=True)]
    return sources.select("rec", "i", F.array(*sensors).alias("v")), size


def mixed_rows(samples: DataFrame) -> DataFrame:
    """mixed_samples() with a row for each user: (rec, ch, x, error), as of subject_rows(); channels are in order of their names."""
    held = samples.groupBy("rec").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("s"))
    order = sorted(range(len(ELECTRODES)), key=lambda k: ELECTRODES[k][0])

    def channel(k: int) -> Column:
        return F.transform("s", lambda s: s["v"][k])

    return held.select("rec", F.array(*[F.lit(ELECTRODES[k][0]) for k in order]).alias("ch"), F.array(*[channel(k) for k in order]).alias("x"), F.lit(None).cast("string").alias("error"))


def mixed_recordings(spark: SparkSession, sf_dir: str, mixing: list[list[float]], hours: int = 3, sensor_noise: float = 0.02) -> tuple[DataFrame, int]:
    """A recording for each user of sources mixed into ELECTRODES, and its length.

    Every event sets off a damped oscillation in each source, with strength, pitch and phase drawn by hash, so sources are
    alike in power and not correlated; sensors are mixing (electrodes by sources) times sources, and so have about mixing
    times its transpose as their covariance, plus a little noise of each electrode's own. Events without a user or a
    time are left out; a value that isn't a number spoils its user's recording alone. An empty table gives no recordings.
    """
    samples, size = mixed_samples(spark, sf_dir, mixing, hours, sensor_noise)
    sensors = F.array(*[F.struct(F.lit(c[0]).alias("ch"), F.col("v")[k].alias("v")) for k, c in enumerate(ELECTRODES)])
    return samples.select("rec", "i", F.explode(sensors).alias("c")).select("rec", "c.ch", "i", "c.v"), size


def normal(seed: int, *key: Column) -> Column:
    """A standard normal deviate by hash of seed and key (Box and Muller): the same on every partitioning."""
    u = [(F.pmod(F.xxhash64(*key, F.lit(seed), F.lit(salt)), F.lit(1 << 32)) + 1) / float((1 << 32) + 1) for salt in (0, 1)]
    return F.sqrt(-2 * F.ln(u[0])) * F.cos(2 * math.pi * u[1])


def subject_datasets(subject: Column) -> Column:
    """The registered dataset that a subject counts to."""
    names = F.array(*[F.lit(r[0]) for r in REGISTRY])
    return F.element_at(names, (F.pmod(F.xxhash64(subject), F.lit(len(REGISTRY))) + 1).cast("int"))


def ring(names: list[str]) -> dict[str, tuple[float, float, float]]:
    """Synthetic electrodes for named channels, evenly on a circle."""
    turn = 2 * math.pi / max(len(names), 1)
    return {c: (math.cos(turn * k), math.sin(turn * k), 0.0) for k, c in enumerate(names)}


def user_recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ragged recording per user: their event values in order of time."""
    at = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("rec"), at.cast("long").alias("i"), F.col("value").alias("v"))


def embedding_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("trial"), "label", F.posexplode("embedding").alias("ch", "v")).withColumn("v", F.col("v").cast("double"))


def sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per dataset, subject and threshold: accuracies and the share retained; duplicates are averaged. Quantities are whole, so
    their sum is exact in any order, and what compares a mean with a limit doesn't change with the partitioning."""
    thr = F.round("l_discount", 2)
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("dataset"), F.col("l_suppkey").alias("subject"), thr.alias("thr"))
    return rows.agg((F.avg("l_quantity") / 50).alias("ba_rej"), F.avg(1 - F.col("l_tax") * 5).alias("ba_rec")).withColumn("pct_retained", 100 * (1 - F.col("thr") * 5))


def markers(spark: SparkSession, sf_dir: str, kind: str = "error") -> DataFrame:
    """Intervals of grid hours, both ends included."""
    e = table(spark, sf_dir, "events").where(F.col("event_type") == kind)
    start = F.timestamp_diff("HOUR", F.lit(START).cast("timestamp_ntz"), F.col("ts")).cast("long")
    return e.select(F.col("event_type").alias("kind"), start.alias("start_i"), (start + F.ceil(F.col("value") / 60)).cast("long").alias("end_i"))


def channel_index(rec: DataFrame) -> DataFrame:
    """(ch, ch_idx): channels in name order; one row per channel."""
    return rec.select("ch").distinct().withColumn("ch_idx", F.row_number().over(Window.orderBy("ch")) - 1)


def with_index(rec: DataFrame) -> DataFrame:
    return rec.join(channel_index(rec), "ch")


def line_noise(amplitude: float = 20.0, freq: float = 9.0, fs: float = FS) -> Column:
    """A sine whose phase and amplitude depend on the channel's index."""
    return amplitude * (1 + 0.1 * F.col("ch_idx")) * F.sin(F.lit(2 * math.pi * freq / fs) * F.col("i") + F.col("ch_idx"))


def ring_positions(rec: DataFrame) -> DataFrame:
    """Synthetic electrodes, evenly on a circle."""
    idx = channel_index(rec)
    n = F.count("*").over(Window.partitionBy())
    angle = F.lit(2 * math.pi) * F.col("ch_idx") / n
    return idx.select("ch", "ch_idx", F.cos(angle).alias("x"), F.sin(angle).alias("y"), F.lit(0.0).alias("z"))
