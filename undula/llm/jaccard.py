"""Pairs of texts whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more.

Every text has MinHash values in bands; two texts that share a band are candidates. With 25 bands of 4 values a pair at
0.8 shares none with chance (1 - 0.8^4)^25 = 1.8e-6. Candidates of a band are thinned by the share of equal values
(chance of losing a pair at 0.8: MISS), and what is left is verified on the whole sets, exactly.
Pairs that are already in one component aren't compared. A band key of more than KEY_LIMIT texts compares all with one of
them; the texts of such keys that are then still in several components meet by their rarest shingles (prefix_pairs), so no
key's texts are compared pair by pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from undula.llm import textscan
from undula.llm.common import byte_rows, giving_back, in_small_batches, materialize, sent_if_small, slices
from undula.llm.components import connected_components

WIDTH = 5
#: Similarity of two sets at which they are linked: 4/5.
NUM, DEN = 4, 5
BANDS, ROWS, MISS = 25, 4, 1e-7
KEY_LIMIT = 16

INFO = "id long, text_hash long, fp long, sig long, n long, bands array<long>, sketch binary"
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_MULTIPLIERS = np.random.default_rng(23).integers(1 << 32, 1 << 63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)


def least_matches(values: int = BANDS * ROWS, similarity: float = NUM / DEN, miss: float = MISS) -> int:
    """The number of equal MinHash values that a pair of this similarity has, but for a chance of `miss`."""
    total = 0.0
    for k in range(values + 1):
        total += math.comb(values, k) * similarity**k * (1 - similarity) ** (values - k)
        if total > miss:
            return k
    return values


def shingle_sets(texts: list[bytes]) -> Iterator[np.ndarray]:
    """The distinct shingles of each text, sorted; fewer than WIDTH words are one shingle, no words none. A-Z count as a-z."""
    w = textscan.words([t.translate(_LOWER) for t in texts])
    parts = [textscan.shingles(w, k) for k in range(1, WIDTH + 1)]
    cuts = [np.searchsorted(text, np.arange(len(texts) + 1)) for text, _ in parts]
    for i, n in enumerate(np.minimum(w.per_text, WIDTH).tolist()):
        yield np.unique(parts[n - 1][1][cuts[n - 1][i] : cuts[n - 1][i + 1]]) if n else np.zeros(0, np.uint64)


def signature(s: np.ndarray) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(s.tobytes())).view(np.int64))


def minhashes(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, BANDS * ROWS) values; an empty set has zeros."""
    out = np.zeros((len(sets), BANDS * ROWS), np.uint64)
    some = np.flatnonzero([len(s) > 0 for s in sets])
    if len(some):
        h = np.concatenate([sets[i] for i in some])
        starts = np.cumsum([0, *(len(sets[i]) for i in some)])[:-1]
        for j, m in enumerate(_MULTIPLIERS):
            out[some, j] = np.minimum.reduceat(h * m, starts)
    return out


def band_keys(values: np.ndarray) -> np.ndarray:
    """(sets, BANDS): a key for each band, its number mixed in."""
    key = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(values), 1))
    for r in range(ROWS):
        key = textscan.mix(key + textscan.mix(values[:, r::ROWS]))
    return key


def described(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """INFO: SimHash fingerprint, signature of the shingle set, its size, band keys and a byte of each MinHash value; one
    row per row of docs."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from undula.llm.simhash import fingerprint

        for b in batches:
            texts = byte_rows(b.column(2))
            for a, z in slices(texts, 1 << 18):
                sets = list(shingle_sets(texts[a:z]))
                values = minhashes(sets)
                cols = [
                    pa.array(np.array([fingerprint(t) for t in texts[a:z]], dtype=np.uint64).view(np.int64)),
                    pa.array([signature(s) for s in sets], pa.int64()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(list(band_keys(values).view(np.int64)), pa.list_(pa.int64())),
                    pa.array([x.tobytes() for x in (textscan.mix(values) & np.uint64(255)).astype(np.uint8)], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(a, z - a), b.column(1).slice(a, z - a), *cols], [x.split()[0] for x in INFO.split(", ")])

    return in_small_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text")).mapInArrow(giving_back(run), INFO)


def _candidates(groups: DataFrame) -> DataFrame:
    """groups(members: array of (sig, n, c, sketch)) -> (a, b): pairs of different components that size and sketch allow."""
    least = least_matches()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            found = [np.zeros((0, 2), np.int64)]
            for members in batch.column(0).to_pylist():
                sig, n, c = (np.array([m[k] for m in members], np.int64) for k in ("sig", "n", "c"))
                sketch = np.array([np.frombuffer(m["sketch"], np.uint8) for m in members])
                i, j = np.triu_indices(len(sig), 1)
                near = (c[i] != c[j]) & (DEN * np.minimum(n[i], n[j]) >= NUM * np.maximum(n[i], n[j]))
                i, j = i[near], j[near]
                equal = (sketch[i] == sketch[j]).sum(1) >= least
                found.append(np.sort(np.stack([sig[i[equal]], sig[j[equal]]], 1), axis=1))
            pairs = np.unique(np.concatenate(found), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return groups.select("members").mapInArrow(giving_back(run), "a long, b long")


def _sets(sigs: DataFrame, nodes: DataFrame, docs: DataFrame, text_col: str) -> DataFrame:
    """sigs(sig), distinct -> (sig, fp, grams), written."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            texts = byte_rows(b.column(1))
            for a, z in slices(texts, 1 << 18):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(a, z - a), pa.array([s.view(np.int64) for s in shingle_sets(texts[a:z])], pa.list_(pa.int64()))], ["text_hash", "grams"])

    used = materialize(nodes.join(sigs, "sig").select("sig", "fp", "text_hash"), "jaccard-used")
    texts = docs.select(F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text")).join(sent_if_small(used.select("text_hash").distinct()), "text_hash", "left_semi")
    sets = texts.mapInArrow(giving_back(run), "text_hash long, grams array<long>").dropDuplicates(["text_hash"])
    return materialize(used.join(sets, "text_hash").drop("text_hash"), "jaccard-sets")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of pairs(a, b) of signatures, those whose sets are similar enough, as (a, b) of fingerprints."""
    x, y = (sets.select(F.col("sig").alias(k), F.col("fp").alias(f"fp_{k}"), F.col("grams").alias(f"grams_{k}")) for k in ("a", "b"))
    both = F.size(F.array_intersect("grams_a", "grams_b"))
    return pairs.join(x, "a").join(y, "b").where((NUM + DEN) * both >= NUM * (F.size("grams_a") + F.size("grams_b"))).select(F.col("fp_a").alias("a"), F.col("fp_b").alias("b"))


def prefix_pairs(sets: DataFrame) -> DataFrame:
    """sets(sig, c, grams) -> (a, b): distinct pairs of different components that share a shingle early enough in both.

    Shingles are ordered by rarity. Two sets of n and m have 4/9 of n + m in common at least, and all of it stands from
    their first common shingle on; so neither may have fewer left there. Shingles of one component alone are in no pair
    that is looked for, and come first. No similar pair is lost; a set that differs from all others has its own
    shingles first and meets none.
    """
    grams = sets.select("sig", "c", F.size("grams").alias("n"), F.explode("grams").alias("gram"))
    shared = grams.groupBy("gram").agg(F.count("*").alias("often"), F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("gram", "often")
    at = Window.partitionBy("sig").orderBy("often", "gram")
    placed = grams.join(shared, "gram").withColumn("later", F.count("*").over(Window.partitionBy("sig")) - F.row_number().over(at) + 1)
    # `later`: how many stand from here on, this one included
    early = materialize(placed.where(DEN * F.col("later") >= NUM * F.col("n")).select("gram", "sig", "c", "n", "later"), "jaccard-early")
    per = early.groupBy("gram", "c").agg(F.count("*").alias("k")).groupBy("gram").agg(F.max(F.struct("k", "c")).alias("top"), F.sum("k").alias("size"))
    mixed = early.join(per.where("top.k < size").select("gram", F.col("top.c").alias("top")), "gram")
    x, y = (side.select(*[F.col(k).alias(f"{k}_{name}") for k in ("gram", "sig", "c", "n", "later")]) for side, name in ((mixed.where("c <> top"), "x"), (mixed, "y")))
    enough = (NUM + DEN) * F.least("later_x", "later_y") >= NUM * (F.col("n_x") + F.col("n_y"))
    met = x.join(y, (F.col("gram_x") == F.col("gram_y")) & (F.col("c_x") != F.col("c_y")) & enough)
    return met.select(F.least("sig_x", "sig_y").alias("a"), F.greatest("sig_x", "sig_y").alias("b")).distinct()


def _labelled(rows: DataFrame, edges: DataFrame) -> DataFrame:
    found = connected_components(edges)
    return rows.join(found, rows["c"] == found["node"], "left").withColumn("c", F.coalesce("component", "c")).drop("node", "component")


def links(info: DataFrame, docs: DataFrame, near: DataFrame, text_col: str = "text", key_limit: int = KEY_LIMIT) -> DataFrame:
    """Edges (a, b) of fingerprints that, with the edges near(a, b), join what chains of near and of similar sets join."""
    some = info.where("n > 0")
    nodes = some.groupBy("sig").agg(F.min(F.struct("fp", "text_hash")).alias("of"), F.min("n").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    nodes = nodes.select("sig", "of.fp", "of.text_hash", "n", "bands", "sketch")
    same = some.select("sig", F.col("fp").alias("b")).distinct().join(nodes.select("sig", F.col("fp").alias("a")), "sig").where("a <> b").select("a", "b")
    edges = materialize(near.select("a", "b").union(same), "jaccard-edges")
    nodes = materialize(_labelled(nodes.withColumn("c", F.col("fp")), edges), "jaccard-nodes")
    keyed = nodes.select("sig", "c", F.explode("bands").alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("size"), F.min("c").alias("low"), F.max("c").alias("high"), F.min_by("sig", F.xxhash64("sig", "key")).alias("pivot"))
    sizes = materialize(sizes.where("low <> high").select("key", "size", "pivot"), "jaccard-sizes")
    keyed = materialize(keyed.join(sizes, "key").select("key", "size", "pivot", "sig"), "jaccard-keys").join(nodes.select("sig", "n", "c", "sketch"), "sig")
    few, many = keyed.where(F.col("size") <= key_limit), keyed.where(F.col("size") > key_limit)
    pairs = _candidates(few.groupBy("key").agg(F.collect_list(F.struct("sig", "n", "c", "sketch")).alias("members")))
    crowd = materialize(many.select("key", "pivot", "sig", "n", "c"), "jaccard-crowd")
    pivots = nodes.select(F.col("sig").alias("pivot"), F.col("c").alias("pivot_c"), F.col("n").alias("pivot_n"))
    fits = (F.col("c") != F.col("pivot_c")) & (DEN * F.least("n", "pivot_n") >= NUM * F.greatest("n", "pivot_n"))
    first = crowd.join(pivots, "pivot").where(fits).select(F.least("sig", "pivot").alias("a"), F.greatest("sig", "pivot").alias("b"))
    pairs = materialize(pairs.union(first).distinct(), "jaccard-pairs")
    edges = edges.union(_verified(pairs, _sets(pairs.select(F.col("a").alias("sig")).union(pairs.select("b")).distinct(), nodes, docs, text_col)))
    if crowd.isEmpty():
        return edges
    edges = materialize(edges, "jaccard-edges")
    crowd = materialize(_labelled(crowd.select("key", "sig").join(nodes.select("sig", F.col("fp").alias("c")), "sig"), edges), "jaccard-crowd")
    mixed = crowd.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high")
    rest = materialize(crowd.join(mixed, "key").select("sig", "c").distinct(), "jaccard-rest")
    sets = _sets(rest.select("sig"), nodes, docs, text_col)
    return edges.union(_verified(materialize(prefix_pairs(sets.join(rest, "sig")), "jaccard-pairs"), sets))
