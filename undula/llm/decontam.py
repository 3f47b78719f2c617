"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

A long document's Jaccard similarity with a short test item is near nothing, however well it contains it. So items are
parted by size (classes up to 2, 4, 8, ... shingles) and every class looks at the documents through windows of twice
its size, one starting at each multiple of its size: what an item can fill lies whole within one window, and the
similarity there is at least t*n / (2u + (1-t)*n) for n of the class's u. The number of MinHash functions follows from
that bound. Windows are read from the whole text; a document that has one hit is compared with the item shingle by
shingle, over the whole document.
"""

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undula.llm import textscan
from undula.llm.common import byte_rows, give_back, giving_back, in_small_batches, slices

WIDTH, THRESHOLD = 5, 0.8
#: Chance that a pair at the threshold collides nowhere, at the least similarity of its class.
MISS = 1e-6
#: Items whose sketches one pass carries; more items take more passes over the documents.
ITEMS_PER_PASS = 20_000


def _functions(threshold: float) -> np.ndarray:
    """Multipliers of the MinHash functions: enough for the smallest similarity, that of an item of half its class."""
    least = threshold * 0.5 / (2 + (1 - threshold) * 0.5)
    n = math.ceil(math.log(MISS) / math.log(1 - least))
    return np.random.default_rng(11).integers(1 << 32, 1 << 63, n, dtype=np.uint64) | np.uint64(1)


def _item_sets(texts: list[bytes], width: int) -> list[tuple[int, np.ndarray]]:
    """(shingle width, sorted distinct shingles) of each item; an item of fewer words is one shingle of all of them."""
    out: list[tuple[int, np.ndarray]] = []
    for t in texts:
        w = textscan.words([t], matching=True)
        k = min(width, len(w.hash))
        out.append((k, np.unique(textscan.shingles(w, k)[1]) if k else np.zeros(0, np.uint64)))
    return out


class _Sketch:
    """One shingle width's items: per class, the sorted MinHash values with the item each belongs to."""

    def __init__(self, sets: list[np.ndarray], numbers: list[int], mults: np.ndarray):
        self.sets, self.numbers, self.mults = sets, numbers, mults
        size = np.array([len(s) for s in sets])
        self.classes = []
        for c in np.unique(np.ceil(np.log2(np.maximum(size, 1)))):
            own = np.flatnonzero(np.ceil(np.log2(np.maximum(size, 1))) == c)
            tables = []
            for m in mults:
                v = np.array([(sets[i] * m).min() for i in own])
                order = np.argsort(v)
                tables.append((v[order], own[order]))
            self.classes.append((1 << int(c), tables))

    def candidates(self, text: np.ndarray, h: np.ndarray) -> set[tuple[int, int]]:
        """(text index, position in sets) of every pair with an equal MinHash in some window."""
        if not len(h):
            return set()
        first = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
        length = np.diff(np.concatenate([first, [len(h)]]))
        grids = []
        for u, _ in self.classes:
            # block starts: every u shingles, anew in every text
            per = -(-length // u)
            begin = np.repeat(first, per) + u * (np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per))
            owner = np.repeat(text[first], per)
            grids.append((begin, owner, owner[1:] == owner[:-1]))
        found: set[tuple[int, int]] = set()
        for i, m in enumerate(self.mults):
            g = h * m
            for (_, tables), (begin, owner, joins) in zip(self.classes, grids, strict=True):
                block = np.minimum.reduceat(g, begin)
                window = block.copy()
                window[:-1] = np.where(joins, np.minimum(block[:-1], block[1:]), block[:-1])
                values, items = tables[i]
                lo = np.searchsorted(values, window)
                hit = np.flatnonzero(values[np.minimum(lo, len(values) - 1)] == window)
                if len(hit):
                    hi = np.searchsorted(values, window[hit], side="right")
                    for at, a, b in zip(owner[hit].tolist(), lo[hit].tolist(), hi.tolist(), strict=True):
                        found.update((at, j) for j in items[a:b].tolist())
        return found


class _Items:
    """One pass's items: a sketch for each shingle width that occurs."""

    def __init__(self, rows: list[tuple[int | None, bytes]], width: int, threshold: float):
        self.threshold, mults, sets = threshold, _functions(threshold), _item_sets([t for _, t in rows], width)
        self.sketches = {}
        for k in sorted({k for k, _ in sets if k}):
            own = [n for n, (w, _) in enumerate(sets) if w == k]
            self.sketches[k] = _Sketch([sets[n][1] for n in own], [rows[n][0] for n in own], mults)

    def search(self, texts: list[bytes]) -> Iterator[tuple[int, int | None, int, int]]:
        """(text index, item id, item shingles, shared) of every pair at the threshold."""
        for a, z in slices(texts, 1 << 18):
            w = textscan.words(texts[a:z], matching=True)
            for k, sketch in self.sketches.items():
                text, h = textscan.shingles(w, k)
                bounds = np.searchsorted(text, np.arange(z - a + 1))
                at, own = -1, np.zeros(0, np.uint64)
                for i, j in sorted(sketch.candidates(text, h)):
                    if i != at:
                        at, own = i, np.unique(h[bounds[i] : bounds[i + 1]])
                    want = sketch.sets[j]
                    shared = int(np.isin(want, own, assume_unique=True).sum())
                    if shared >= self.threshold * len(want):
                        yield a + i, sketch.numbers[j], len(want), shared


def _passes(items: DataFrame, item_id: str, item_text: str, width: int, threshold: float, items_per_pass: int) -> Iterator:
    """The items in broadcasts of about items_per_pass each, dealt by hash."""
    rows = items.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).cast("string").alias("t")).where("t is not null")
    n = max(1, -(-rows.count() // items_per_pass))
    for p in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == p)
        yield items.sparkSession.sparkContext.broadcast(_Items([(i, t.encode()) for i, t in part.toLocalIterator()], width, threshold))


def contained_items(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = WIDTH, threshold: float = THRESHOLD, items_per_pass: int = ITEMS_PER_PASS) -> DataFrame:
    """Rows (doc_id, item_id, item_shingles, shared, containment) of each document and item with containment >= threshold.

    Containment is the share of the item's distinct shingles that the document has, words being runs of letters and
    digits in lower case. Null or wordless items match nothing; null or wordless documents contain nothing; repeated
    rows on either side give a row each; empty tables give no rows. The documents are never shuffled: sketches of at
    most items_per_pass items go along with a pass, and more items mean more passes.
    """
    out, docs = None, in_small_batches(docs)
    for sent in _passes(items, item_id, item_text, width, threshold, items_per_pass):

        def run(batches: Iterator, sent=sent) -> Iterator:
            import pyarrow as pa

            for b in batches:
                ids = b.column(0).to_pylist()
                found = [(ids[i], item, size, shared, shared / size) for i, item, size, shared in sent.value.search(byte_rows(b.column(1)))]
                cols = list(zip(*found, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64()), strict=True)], ["doc_id", "item_id", "item_shingles", "shared", "containment"])

        rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(doc_text).alias("text"))
        hits = rows.mapInArrow(giving_back(run), "doc_id long, item_id long, item_shingles int, shared int, containment double")
        out = hits if out is None else out.union(hits)
    return out


def without_contaminated(docs: DataFrame, items: DataFrame, *, doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = WIDTH, threshold: float = THRESHOLD, items_per_pass: int = ITEMS_PER_PASS) -> DataFrame:
    """The rows of docs that contain no item, with all their columns; every row is judged where it is read, without a shuffle."""

    def judge(sent):
        @F.pandas_udf("boolean")
        def contaminated(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in batches:
                hit = np.zeros(len(texts), bool)
                hit[[i for i, *_ in sent.value.search([b"" if t is None else t.encode() for t in texts])]] = True
                yield pd.Series(hit)
            give_back()

        return contaminated

    docs = in_small_batches(docs)
    for sent in _passes(items, item_id, item_text, width, threshold, items_per_pass):
        docs = docs.where(~judge(sent)(F.col(doc_text)))
    return docs
