"""Language-model scores of texts by context-tree weighting over bytes.

A byte is eight binary decisions, each with a tree of its own: its context is the bits so far and the last 0 to `depth`
bytes. Every node has the Krichevsky-Trofimov estimate of its counts; a node's weighted probability is half its own
estimate and half the product of its children's, so all depths are mixed by how well each foretold the training texts.
The mixture that a position sees is a sum along its path from the root, the weights being posterior.

Counts, weights and mixtures are aggregates and joins by context, a level at a time. A node that training never saw
has no counts, estimate one half and weight one half, which needs no rule of its own as all contexts that the scored
texts have are in the table. Texts are scored in blocks of bounded size; a block gets the estimates of its own grams
and words only, so nothing that grows with the corpus is sent to every task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from undula.llm import textscan
from undula.llm.common import byte_rows, materialize, slices

DEPTH = 4
#: Bytes of text in a block, in a slice of vectorised work, and distinct keys after which a task passes on its counts.
BLOCK, SLICE, HELD = 32 << 20, 2 << 20, 1 << 21
#: The byte that ends a text and stands before it; UTF-8 has none such.
END = 255
#: The key of the end token among word hashes.
END_WORD = 0x5851F42D4C957F2D
GRAM, WORD = 0, 1


def grams(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(text index, gram) of each byte and each end: the byte in the lowest 8 bits, the `depth` bytes before it above."""
    pad = bytes([END]) * depth
    data = np.frombuffer(b"".join(pad + t + pad[:1] for t in texts), np.uint8)
    length = np.array([len(t) + 1 for t in texts])
    key = np.zeros(len(data) - depth, np.uint64)
    for j in range(depth + 1):
        key = (key << np.uint64(8)) | data[j : len(data) - depth + j]
    text = np.repeat(np.arange(len(texts)), length)
    # text i begins after i + 1 paddings, of which the key's start has skipped one
    return text, key[np.arange(len(text)) + depth * text]


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text index, 64-bit hash) of each word, and of the end token of each text."""
    w = textscan.words(texts)
    return np.concatenate([w.text, np.arange(len(texts))]), np.concatenate([w.hash, np.full(len(texts), END_WORD, np.uint64)])


def blocked(docs: DataFrame, id_col: str, text_col: str, learns: Column) -> DataFrame:
    """(block, id, learns, text), written; text in bytes, A-Z in lower case. A block is some BLOCK bytes of one task's rows."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        block, held = TaskContext.get().partitionId() << 32, 0
        for b in batches:
            for at in range(0, b.num_rows, 256):
                some = b.slice(at, 256)
                texts, of = byte_rows(some.column(2)), []
                for t in texts:
                    if held and held + len(t) > BLOCK:
                        block, held = block + 1, 0
                    held += len(t)
                    of.append(block)
                yield pa.RecordBatch.from_arrays([pa.array(of, pa.int64()), some.column(0), some.column(1), pa.array([t.lower() for t in texts], pa.binary())], ["block", "id", "learns", "text"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), learns.alias("learns"), F.col(text_col).alias("text"))
    return materialize(rows.mapInArrow(run, "block long, id long, learns boolean, text binary"), "ctw-blocks")


def _counted(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(n, first) if len(key) else n


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    key = np.sort(key)
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[first], np.diff(np.append(first, len(key)))


def counts(blocks: DataFrame, depth: int) -> DataFrame:
    """(kind, block, key, n): grams and words of each block, n their number in texts that are learned from (0: in others only)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        block, held = None, {}

        def passed_on():
            for kind, parts in held.items():
                key, n = _counted(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
                for s in range(0, len(key), 1 << 17):
                    k = key[s : s + (1 << 17)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int32)), pa.array(np.full(len(k), block, np.int64)), pa.array(k.view(np.int64)), pa.array(n[s : s + (1 << 17)].astype(np.int64))], ["kind", "block", "key", "n"])
            held.clear()

        for b in batches:
            of, learns = b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)] if len(of) else [0]
            for first, last in zip(edges, edges[1:], strict=False):
                if of[first] != block:
                    yield from passed_on()
                    block = int(of[first])
                texts = byte_rows(b.column(2).slice(first, last - first))
                for a, z in slices(texts, SLICE):
                    some, learned = texts[a:z], learns[first + a : first + z].astype(bool)
                    for kind, (text, key) in ((GRAM, grams(some, depth)), (WORD, tokens(some))):
                        yes = learned[text]
                        k, n = _runs(key[yes])
                        rest = np.unique(key[~yes]) if not yes.all() else key[:0]
                        held.setdefault(kind, []).append((np.concatenate([k, rest]), np.concatenate([n, np.zeros(len(rest), np.int64)])))
                    if sum(len(p[0]) for parts in held.values() for p in parts) > HELD:
                        for kind, parts in held.items():
                            held[kind] = [_counted(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))]
                        if sum(len(parts[0][0]) for parts in held.values()) > HELD // 2:
                            yield from passed_on()
        yield from passed_on()

    return blocks.select("block", "learns", "text").mapInArrow(run, "kind int, block long, key long, n long")


def log_gamma(x: Column) -> Column:
    """Stirling's series after a shift by 8; exact to 1e-11 for x of one half and more."""
    z, shift = x + 8, x
    for j in range(1, 8):
        shift = shift * (x + j)
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7) - F.log(shift)


def _estimated(nodes: DataFrame) -> DataFrame:
    """Adds own: the log of the Krichevsky-Trofimov estimate of n0 zeros and n1 ones."""
    return nodes.withColumn("own", log_gamma(F.col("n0") + 0.5) + log_gamma(F.col("n1") + 0.5) - math.log(math.pi) - log_gamma(F.col("n0") + F.col("n1") + 1.0))


def gram_estimates(total: DataFrame, depth: int = DEPTH) -> DataFrame:
    """total(key, n), every gram once -> (key, log10p): the model's log10 probability of the gram's byte after its context."""
    byte = F.col("key").bitwiseAND(F.lit(255))
    bits = F.explode(F.array(*[F.struct((F.lit(1 << b) + F.shiftright(byte, 8 - b)).cast("int").alias("bits"), F.shiftright(byte, 7 - b).bitwiseAND(F.lit(1)).cast("int").alias("bit")) for b in range(8)])).alias("s")
    paths = total.select("key", "n", F.shiftright("key", 8).alias("ctx"), bits).select("key", "n", "ctx", "s.bits", "s.bit")
    level = paths.groupBy("ctx", "bits").agg(F.sum(F.when(F.col("bit") == 0, F.col("n")).otherwise(0)).alias("n0"), F.sum(F.when(F.col("bit") == 1, F.col("n")).otherwise(0)).alias("n1"))
    levels = {depth: materialize(_estimated(level).withColumn("all", F.col("own")), "ctw-level")}
    half = math.log(0.5)
    for j in range(depth - 1, -1, -1):
        shorter = F.col("ctx").bitwiseAND(F.lit((1 << 8 * j) - 1))
        level = levels[j + 1].groupBy(shorter.alias("ctx"), "bits").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("all").alias("below"))
        level = _estimated(level)
        top = F.greatest("own", "below")
        levels[j] = materialize(level.withColumn("all", half + top + F.log(F.exp(F.col("own") - top) + F.exp(F.col("below") - top))), "ctw-level")
    one = (F.col("n1") + 0.5) / (F.col("n0") + F.col("n1") + 1.0)
    seen = None
    for j in range(depth + 1):
        weight = F.lit(1.0) if j == depth else F.exp(half + F.col("own") - F.col("all"))
        here = levels[j].select("ctx", "bits", one.alias("one"), weight.alias("w"))
        if seen is None:
            seen = here.select("ctx", "bits", (F.col("w") * F.col("one")).alias("sum"), (1 - F.col("w")).alias("left"))
            continue
        up = seen.select(F.col("ctx").alias("up"), "bits", F.col("sum").alias("so_far"), F.col("left").alias("open"))
        if j <= 2:
            up = F.broadcast(up)  # 255 rows, then 65,280 at most
        here = here.withColumn("up", F.col("ctx").bitwiseAND(F.lit((1 << 8 * (j - 1)) - 1))).join(up, ["up", "bits"])
        seen = here.select("ctx", "bits", (F.col("so_far") + F.col("open") * F.col("w") * F.col("one")).alias("sum"), (F.col("open") * (1 - F.col("w"))).alias("left"))
    bit = F.when(F.col("bit") == 1, F.col("sum")).otherwise(1 - F.col("sum"))
    return paths.select("key", "ctx", "bits", "bit").join(seen.select("ctx", "bits", "sum"), ["ctx", "bits"]).groupBy("key").agg(F.sum(F.log10(bit)).alias("log10p"))


SCHEMA = "id long, learns boolean, n_bytes long, n_tokens long, n_known long, base_score double, score double"


def _scorer(depth: int):
    def run(texts, values):
        import pyarrow as pa

        kind, key, value = (values[c].to_numpy() for c in ("kind", "key", "value"))
        learned, known = values["learned"].to_numpy().astype(bool), {}
        for k in (GRAM, WORD):
            own = key[kind == k].view(np.uint64)
            order = np.argsort(own)
            known[k] = own[order], value[kind == k][order], learned[kind == k][order]
        rows, parts = byte_rows(texts["text"].combine_chunks()), []
        for a, z in slices(rows, SLICE):
            some = rows[a:z]
            names, worth, _ = known[GRAM]
            text, own = grams(some, depth)
            score = np.bincount(text, weights=worth[np.searchsorted(names, own)], minlength=z - a)
            names, worth, seen = known[WORD]
            text, own = tokens(some)
            at = np.searchsorted(names, own)
            base, n_known = (np.bincount(text, weights=x[at], minlength=z - a) for x in (worth, seen))
            parts.append((np.array([len(t) for t in some], np.int64), np.bincount(text, minlength=z - a), n_known.astype(np.int64), base, score))
        cols = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.zeros(0)] * 5
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        return pa.table([texts["id"], texts["learns"], *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return run


def scores(docs: DataFrame, learns: Column, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, smooth: float = 0.1) -> DataFrame:
    """One row per row of docs: SCHEMA, train_tokens and bits_per_byte (of the bytes and the end).

    learns: condition on docs of the texts that counts come from; null counts as false. A text is its UTF-8 bytes with A-Z
    in lower case, whole, and an end. score: its log10 probability; base_score: that of its words and end by counts
    smoothed by `smooth`, n_known of them counted. Null texts count as empty: an end alone. Long texts are blocks of their
    own. Repeated rows are counted and returned as often. No text to learn from: every bit has probability one half,
    every token 1. Columns of other names don't matter. Empty table: no rows.
    """
    if not 1 <= depth <= 6:
        raise ValueError("depth is 1 to 6 bytes")
    texts = blocked(docs, id_col, text_col, F.coalesce(learns, F.lit(False)))
    found = materialize(counts(texts, depth), "ctw-counts")
    total = found.groupBy("kind", "key").agg(F.sum("n").alias("n"))
    total = materialize(total, "ctw-total")
    known = total.where((F.col("kind") == WORD) & (F.col("n") > 0))
    n_all, n_distinct = known.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    below = math.log10(n_all + smooth * (n_distinct + 1))
    of_grams = gram_estimates(total.where(F.col("kind") == GRAM).select("key", "n"), depth)
    of_words = total.where(F.col("kind") == WORD).select("kind", "key", (F.log10(F.col("n") + smooth) - below).alias("value"), (F.col("n") > 0).alias("learned"))
    values = materialize(of_grams.select(F.lit(GRAM).alias("kind"), "key", F.col("log10p").alias("value"), F.lit(True).alias("learned")).union(of_words), "ctw-values")
    # a key that a block passed on twice comes twice, with one value
    local = found.select("kind", "block", "key").join(values, ["kind", "key"])
    scored = texts.groupBy("block").cogroup(local.groupBy("block")).applyInArrow(_scorer(depth), SCHEMA)
    return scored.withColumn("train_tokens", F.lit(n_all).cast("long")).withColumn("bits_per_byte", -F.col("score") * math.log2(10) / (F.col("n_bytes") + 1))
