"""What the operators share: tables, the folder all executors see, skew-safe helpers."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than space, tab, LF, VT, FF, CR.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir where the cluster names one, or the context's checkpoint folder; a local folder on a local master, as in tests."""
    context = spark.sparkContext._jsc.sc().getCheckpointDir()
    named = spark.conf.get("spark.checkpoint.dir", None) or (context.get() if context.isDefined() else None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    fallback = getattr(shared_dir, "fallback", None)
    if fallback is None:
        fallback = shared_dir.fallback = f"file://{tempfile.mkdtemp(prefix='undula-shared-')}"
    return fallback


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: the lineage is cut, a lost executor costs nothing."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_path(spark: SparkSession, path: str) -> None:
    """Deletes a written intermediate through Hadoop's file system, whatever store it is in."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


#: Bytes of a batch of whole texts on their way to Python; Spark's own default lets a task hold several of 64 MB.
BATCH_BYTES = 2 << 20


def in_small_batches(df: DataFrame) -> DataFrame:
    """df as it is; its session cuts Arrow batches at BATCH_BYTES from now on, unless it has been given a bound of its own."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if name not in df.sparkSession.conf.getAll:
        df.sparkSession.conf.set(name, str(BATCH_BYTES))
    return df


def give_back() -> None:
    """Returns what this Python worker has freed to the system. Workers stay for later tasks, and their allocators keep the
    pages of the largest task so far, which count against the executor while the JVM sorts and joins."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def giving_back(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, a function for mapInArrow, with give_back() at the end of each task."""

    def whole(batches: Iterator) -> Iterator:
        yield from run(batches)
        give_back()

    return whole


#: Rows up to this number may be sent to all executors.
SENT_ROWS = 1_000_000


def sent_if_small(keys: DataFrame, rows: int = SENT_ROWS) -> DataFrame:
    """keys of a few numbers a row, marked for broadcast where counting proves them few; else as they are, to be shuffled."""
    return F.broadcast(keys) if keys.limit(rows + 1).count() <= rows else keys


def word_count(text: Column) -> Column:
    """Number of words; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def byte_rows(column) -> list[bytes]:
    """An Arrow string or binary column as bytes; null is empty."""
    import pyarrow as pa

    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
    return [b"" if x is None else x for x in column.to_pylist()]


def slices(texts: list[bytes], limit: int = 2 << 20):
    """(first, last) index pairs of runs of texts that hold about limit bytes: bounds the memory of vectorised work."""
    first = held = 0
    for i, t in enumerate(texts):
        held += len(t) + 1
        if held >= limit:
            yield first, i + 1
            first, held = i + 1, 0
    if first < len(texts):
        yield first, len(texts)
