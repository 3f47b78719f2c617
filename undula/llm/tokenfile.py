"""Token files: frequency-ranked ids in a byte-aligned variable-length code whose control bytes stand apart.

Every id is replaced by its rank (0: the most frequent of the corpus) and written in 1 to 4 bytes, little end first; a
control byte holds the lengths of four of them, two bits each. The file is Parquet: a row is a block of whole
documents with the columns shard, block, doc_ids, lengths, control, data; blocks in (shard, block) order hold the
documents in ascending order. Beside it stands the table of ranks. Decoding looks each control byte up in a table of
lengths.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from undula.llm.common import byte_rows, giving_back, materialize, remove_path, scratch_path, slices
from undula.llm.tokens import drop_vocabularies, word_vocabulary

END_ID = 2
IDS_PER_BLOCK, IDS_PER_SHARD = 1 << 17, 1 << 23
#: For each control byte, the bytes of its four values.
LENGTHS = np.array([[(c >> 2 * i & 3) + 1 for i in range(4)] for c in range(256)], dtype=np.int64)


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Unsigned 32-bit values -> (control bytes, data bytes). The last control byte is filled with zeros."""
    v = values.astype("<u4")
    extra = (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    quads = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    quads[: len(v)] = extra
    control = quads.reshape(-1, 4) @ np.array([1, 4, 16, 64], np.uint8)
    keep = np.arange(4)[None, :] <= extra[:, None]
    return control.astype(np.uint8).tobytes(), v.view(np.uint8).reshape(-1, 4)[keep].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The inverse of pack, for n values."""
    length = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    raw = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(3, np.uint8)])
    start = np.cumsum(length) - length
    out = raw[start].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(length > k)
        out[more] |= raw[start[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


@dataclass
class TokenFile:
    path: str
    ranks_path: str


def _tokenized(docs: DataFrame, vocabulary: str, end_id: int, doc_id: str, text: str) -> DataFrame:
    """(doc_id, n, planes): the ids byte plane by byte plane, low bytes first; this halves what Parquet has to keep."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        v = word_vocabulary(vocabulary)
        width = 2 if v.encoder.get_vocab_size() <= 1 << 16 else 3
        end = np.array([end_id], "<u4").tobytes()
        for b in batches:
            texts = byte_rows(b.column(1))
            for a, z in slices(texts, 8 << 20):
                ids = [x + end for x in v.ids(texts[a:z])]
                planes = [np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(-1, 4)[:, :width].T).tobytes() for x in ids]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(a, z - a), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(planes, pa.binary())], ["doc_id", "n", "planes"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(giving_back(run), "doc_id long, n long, planes binary")


def _joined_planes(planes: list[bytes], counts: list[int]) -> np.ndarray:
    out, at = np.zeros(sum(counts), np.uint32), 0
    for p, n in zip(planes, counts, strict=True):
        for k, plane in enumerate(np.frombuffer(p, np.uint8).reshape(-1, n)):
            out[at : at + n] |= plane.astype(np.uint32) << np.uint32(8 * k)
        at += n
    return out


def _frequencies(tokens: DataFrame) -> list[tuple[int, int]]:
    """(id, count), the most frequent first. At most as many rows as the vocabulary has ids."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        drop_vocabularies()
        total = np.zeros(1 << 16, np.int64)
        for b in batches:
            planes, counts = b.column(1).to_pylist(), b.column(0).to_pylist()
            for a, z in slices(planes, 2 << 20):
                c = np.bincount(_joined_planes(planes[a:z], counts[a:z]))
                total = np.pad(total, (0, max(0, len(c) - len(total))))
                total[: len(c)] += c
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["id", "n"])

    found = tokens.select("n", "planes").mapInArrow(giving_back(run), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    return sorted(((r["id"], r["n"]) for r in found), key=lambda x: (-x[1], x[0]))


def write(docs: DataFrame, path: str, vocabulary: str, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text", ids_per_shard: int = IDS_PER_SHARD, ids_per_block: int = IDS_PER_BLOCK) -> TokenFile:
    """Encodes every whole text (null: empty), appends end_id, and writes the file; a null doc_id sorts first.

    Texts are encoded once; the file's order comes from a range partitioning on doc_id, which a hot source or a long
    document doesn't skew. Rows with equal doc_id follow each other. An empty table makes an empty file.
    """
    spark = docs.sparkSession
    kept = scratch_path(spark, "token-planes")
    _tokenized(docs, vocabulary, end_id, doc_id, text).write.option("compression", "zstd").parquet(kept)
    tokens = spark.read.parquet(kept)
    by_frequency = _frequencies(tokens)
    ranks = np.zeros(max((i for i, _ in by_frequency), default=0) + 1, np.uint32)
    ranks[[i for i, _ in by_frequency]] = np.arange(len(by_frequency), dtype=np.uint32)
    spark.createDataFrame([(r, i, n) for r, (i, n) in enumerate(by_frequency)], "rank int, id int, count long").coalesce(1).write.parquet(f"{path}/ranks")
    sent = spark.sparkContext.broadcast(ranks)
    total = sum(n for _, n in by_frequency)

    def blocks(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        shard, number, held = TaskContext.get().partitionId(), 0, []

        def block():
            ids, counts, planes = zip(*held, strict=True)
            control, data = pack(sent.value[_joined_planes(planes, counts)])
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([number], pa.int32()), pa.array([ids], pa.list_(pa.int64())), pa.array([counts], pa.list_(pa.int64())), pa.array([control], pa.binary()), pa.array([data], pa.binary())], ["shard", "block", "doc_ids", "lengths", "control", "data"])

        size = 0
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held.append(row)
                size += row[1]
                if size >= ids_per_block:
                    yield block()
                    held, size, number = [], 0, number + 1
        if held:
            yield block()

    ordered = tokens.repartitionByRange(max(8, -(-total // ids_per_shard)), "doc_id").sortWithinPartitions("doc_id", "n", "planes")
    ordered.mapInArrow(giving_back(blocks), "shard int, block int, doc_ids array<long>, lengths array<long>, control binary, data binary").write.option("compression", "zstd").parquet(f"{path}/blocks")
    remove_path(spark, kept)
    return TokenFile(f"{path}/blocks", f"{path}/ranks")


def read(spark: SparkSession, file: TokenFile) -> DataFrame:
    """(doc_id, start, n_tokens, ids binary of little-endian unsigned 32-bit, ids_crc32) of each document of a file."""
    ids = np.array([r["id"] for r in spark.read.parquet(file.ranks_path).orderBy("rank").collect()], "<u4")
    sent = spark.sparkContext.broadcast(ids)
    stored = spark.read.parquet(file.path)

    def run(batches: Iterator) -> Iterator:
        import zlib

        import pyarrow as pa

        for b in batches:
            for before, doc_ids, lengths, control, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                n = np.array(lengths, np.int64)
                value, stop = sent.value[unpack(control, data, n.sum())], np.cumsum(n)
                own = [value[z - k : z].tobytes() for z, k in zip(stop.tolist(), lengths, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(before + stop - n, pa.int64()), pa.array(n, pa.int64()), pa.array(own, pa.binary()), pa.array([zlib.crc32(x) for x in own], pa.int64())], ["doc_id", "start", "n_tokens", "ids", "ids_crc32"])

    sums = materialize(stored.select("shard", "block", F.aggregate("lengths", F.lit(0).cast("long"), lambda x, y: x + y).alias("n")), "token-sums")
    shards = sums.groupBy("shard").agg(F.sum("n").alias("n"))
    first = shards.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("first"))
    inside = F.sum("n").over(Window.partitionBy("shard").orderBy("block")) - F.col("n")
    before = sums.withColumn("inside", inside).join(first, "shard").select("shard", "block", (F.col("first") + F.col("inside")).alias("before"))
    rows = stored.join(F.broadcast(before), ["shard", "block"]) if before.count() <= 100_000 else stored.join(before, ["shard", "block"])
    return rows.select("before", "doc_ids", "lengths", "control", "data").mapInArrow(giving_back(run), "doc_id long, start long, n_tokens long, ids binary, ids_crc32 long")
