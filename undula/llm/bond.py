"""Hard negatives by a vertical scan of columnar vectors with branch and bound (BOND).

Vectors become integers, so that scores are exact. A task holds a block of rows by dimension and reads the dimensions
in the order of an anchor's magnitudes, largest first. What the dimensions not read yet can add at least and at most
follows from the block's minima and maxima; a row whose reachable scores miss every window asked for, or stay below
the k-th score that is certain, leaves the candidates. What is left at the end has its exact score.

Two scans: the first finds an anchor's positives (its own label, one window without ends), the second all of its
negatives (other labels, a window for each positive). Anchors are a query set: blocks of them meet blocks of rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from undula.llm.common import materialize

#: Values (rows times dimensions) that one group of rows holds, and anchors that one block of anchors holds.
GROUP_VALUES, ANCHOR_BLOCK = 1 << 21, 2048
#: Rows whose minima and maxima bound each other, and dimensions read between two looks at the bounds.
BLOCK_ROWS, STEP = 8192, 16


@dataclass(frozen=True)
class Rules:
    #: Components are floor(scale * x).
    scale: int = 256
    positives: int = 5
    negatives: int = 5
    #: A negative's score lies between this percentage of the positive's score and all of it.
    least_percent: int = 80


def matrix(vectors, scale: int) -> np.ndarray:
    """An Arrow column of lists as dimensions by rows, in integers. A shorter vector is continued by zeros."""
    lengths = np.diff(vectors.offsets.to_numpy())
    flat = np.floor(scale * vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    out = np.zeros((len(lengths), int(lengths.max(initial=0))))
    out[np.arange(out.shape[1])[None, :] < lengths[:, None]] = flat
    top = np.abs(out).max(initial=0)
    # doubles are exact below 2^53
    return np.ascontiguousarray(out.T if top * top * max(out.shape[1], 1) < 1 << 53 else out.T.astype(np.int64))


def vertical_scan(x: np.ndarray, a: np.ndarray, among: np.ndarray, low: np.ndarray, high: np.ndarray, found: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, exact scores) of those of x's rows `among` that can be among the first k of a window [low, high].

    x: dimensions by rows; found: per window the k-th score known from elsewhere. All rows tied with a k-th stay.
    """
    d = min(len(x), len(a))
    order = np.argsort(-np.abs(a[:d]), kind="stable")
    ends = np.stack([x[:d].min(axis=1), x[:d].max(axis=1)]) * a[:d] if x.shape[1] else np.zeros((2, d))
    ends = np.sort(ends, axis=0)[:, order]
    # what the dimensions from each place on add at least and at most
    rest = np.concatenate([np.cumsum(ends[:, ::-1], axis=1)[:, ::-1], np.zeros((2, 1), ends.dtype)], axis=1)
    rows, score, need = among, np.zeros(len(among), x.dtype), np.maximum(low, found)
    for at in range(0, d, STEP):
        dims = order[at : at + STEP]
        score = score + a[dims] @ (x[dims] if len(rows) == x.shape[1] else x[np.ix_(dims, rows)])
        bottom, top = score + rest[0, min(at + STEP, d)], score + rest[1, min(at + STEP, d)]
        keep = np.zeros(len(rows), bool)
        for w in range(len(low)):
            certain = bottom[(bottom >= need[w]) & (top <= high[w])]
            if len(certain) >= k:
                need[w] = max(need[w], np.partition(certain, -k)[-k])
            keep |= (top >= need[w]) & (bottom <= high[w])
        rows, score = rows[keep], score[keep]
        if not len(rows):
            break
    return rows, score


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k: higher score, then smaller id."""
    return np.lexsort((ids, -score))[:k]


class _Kept:
    """The first k (score, id) of one window so far."""

    def __init__(self, k: int):
        self.k, self.score, self.ids = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def kth(self) -> float:
        return self.score[-1] if len(self.score) == self.k else -math.inf

    def add(self, score: np.ndarray, ids: np.ndarray) -> None:
        score, ids = np.concatenate([self.score, score.astype(np.int64)]), np.concatenate([self.ids, ids])
        first = _best(score, ids, self.k)
        self.score, self.ids = score[first], ids[first]


def _columns(rows, anchors, scale: int):
    ids, label = rows["id"].to_numpy(), rows["label"].to_numpy()
    x, q = matrix(rows["vector"].combine_chunks(), scale), matrix(anchors["vector"].combine_chunks(), scale)
    kind = np.float64 if max(np.abs(x).max(initial=0), 1) * max(np.abs(q).max(initial=0), 1) * max(len(x), 1) < 1 << 53 else np.int64
    return ids, label, x.astype(kind, copy=False), anchors["a"].to_pylist(), anchors["id"].to_numpy(), anchors["label"].to_numpy(), q.T.astype(kind)


def _positives(rules: Rules):
    def run(rows, anchors):
        import pyarrow as pa

        out: list[tuple] = []
        if rows.num_rows and anchors.num_rows:
            ids, label, x, key, a_id, a_label, q = _columns(rows, anchors, rules.scale)
            for of in np.unique(a_label):
                own = np.flatnonzero(label == of)
                asks = np.flatnonzero(a_label == of)
                kept = {i: _Kept(rules.positives) for i in asks}
                for s in range(0, len(own), BLOCK_ROWS):
                    block = own[s : s + BLOCK_ROWS]
                    part, part_ids = np.ascontiguousarray(x[:, block]), ids[block]
                    for i in asks:
                        among = np.flatnonzero(part_ids != a_id[i])
                        got, score = vertical_scan(part, q[i], among, np.array([-math.inf]), np.array([math.inf]), np.array([kept[i].kth()]), rules.positives)
                        kept[i].add(score, part_ids[got])
                out += [(key[i], int(s), int(p)) for i in asks for s, p in zip(kept[i].score, kept[i].ids, strict=True)]
        return pa.table({n: pa.array([r[c] for r in out], pa.int64()) for c, n in enumerate(("a", "positive_score", "positive_id"))})

    return run


def _negatives(rules: Rules):
    def run(rows, anchors):
        import pyarrow as pa

        out: list[tuple] = []
        if rows.num_rows and anchors.num_rows:
            ids, label, x, key, a_id, a_label, q = _columns(rows, anchors, rules.scale)
            tops = [np.array([p["positive_score"] for p in of], dtype=np.int64) for of in anchors["positives"].to_pylist()]
            kept = [[_Kept(rules.negatives) for _ in t] for t in tops]
            for s in range(0, len(ids), BLOCK_ROWS):
                block = np.ascontiguousarray(x[:, s : s + BLOCK_ROWS])
                block_ids, block_label = ids[s : s + BLOCK_ROWS], label[s : s + BLOCK_ROWS]
                others = {of: np.flatnonzero(block_label != of) for of in np.unique(a_label)}
                for i, high in enumerate(tops):
                    low = -(-rules.least_percent * high // 100)
                    got, score = vertical_scan(block, q[i], others[a_label[i]], low.astype(np.float64), high.astype(np.float64), np.array([w.kth() for w in kept[i]]), rules.negatives)
                    exact = score.astype(np.int64)
                    for w, lo, hi in zip(kept[i], low, high, strict=True):
                        inside = (exact >= lo) & (exact <= hi)
                        w.add(exact[inside], block_ids[got][inside])
            out = [(key[i], j, int(s), int(n)) for i, of in enumerate(kept) for j, w in enumerate(of) for s, n in zip(w.score, w.ids, strict=True)]
        return pa.table({n: pa.array([r[c] for r in out], pa.int64()) for c, n in enumerate(("a", "place", "negative_score", "negative_id"))})

    return run


def hard_negatives(rows: DataFrame, is_anchor: Column, rules: Rules = Rules(), id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor and each of its first
    `positives` other rows of its label, the first `negatives` rows of other labels whose score lies in the window.

    is_anchor: the query set, by columns of rows. Rows with a null id, label, vector or component, or a component that
    isn't finite, take no part; nor do those with a component so large that scores leave 64 bits (2^20 for 64
    dimensions at scale 256). Shorter vectors count as continued by zeros; an empty one scores 0 with all. Other rows
    are those of another id. Repeated rows each count, and a repeated anchor gives its rows as often. Ties: the smaller id.
    Negative positive scores have an empty window. Columns of other names don't matter. Empty table, no anchor: no rows.
    """
    v = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("vector"), F.coalesce(is_anchor, F.lit(False)).alias("asks"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(math.inf)))
    v = materialize(v.where("id is not null and label is not null and vector is not null").where(finite), "bond-rows")
    n, dims = v.agg(F.count("*"), F.max(F.size("vector"))).first()
    most = math.isqrt((1 << 62) // max(dims or 1, 1))
    v = v.where(F.forall("vector", lambda x: F.abs(rules.scale * x) < most))
    # places by row, written once: no id and no label can crowd a group
    v = materialize(v.withColumn("a", F.monotonically_increasing_id()), "bond-numbered")
    asks = v.where("asks").drop("asks")
    n_asks = asks.count()
    spread = int(v.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = max(math.ceil(n * max(dims or 1, 1) / GROUP_VALUES), min(spread, math.ceil(n / BLOCK_ROWS * 4)), 1)
    blocks = max(math.ceil(n_asks / ANCHOR_BLOCK), 1)
    held = v.select("id", "label", "vector", F.pmod(F.xxhash64("a"), F.lit(groups)).alias("g"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"))

    def scan(queries: DataFrame, task, schema: str) -> DataFrame:
        met = queries.withColumn("b", F.pmod(F.xxhash64("a"), F.lit(blocks)).cast("int")).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)).cast("array<bigint>")))
        return held.groupBy("g", "b").cogroup(met.groupBy("g", "b")).applyInArrow(task, schema)

    near = Window.partitionBy("a").orderBy(F.desc("positive_score"), "positive_id")
    positives = scan(asks, _positives(rules), "a long, positive_score long, positive_id long").withColumn("place", F.row_number().over(near) - 1).where(F.col("place") < rules.positives)
    positives = materialize(positives, "bond-positives")
    of = positives.groupBy("a").agg(F.sort_array(F.collect_list(F.struct("place", "positive_score", "positive_id"))).alias("positives"))
    asked = materialize(asks.join(of, "a"), "bond-asks")
    hard = Window.partitionBy("a", "place").orderBy(F.desc("negative_score"), "negative_id")
    negatives = scan(asked, _negatives(rules), "a long, place long, negative_score long, negative_id long").withColumn("rank", F.row_number().over(hard)).where(F.col("rank") <= rules.negatives)
    named = asked.select("a", F.col("id").alias("anchor_id"), F.explode("positives").alias("p")).select("a", "anchor_id", F.col("p.place").cast("long").alias("place"), "p.positive_score", "p.positive_id")
    return negatives.join(named, ["a", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
