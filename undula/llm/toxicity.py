"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word's features are its byte n-grams, with a mark before and behind the word, and the word itself, hashed into
buckets that each have a vector. A window of a few words is the average of its features' vectors; a linear softmax over
it gives a class. A document is as toxic as its worst window, so one insult in a long text isn't averaged away. Training
moves vectors and softmax together, through each document's worst window; misspelt words that training has not seen
share n-grams, and so vectors, with those it has.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undula.llm import textscan
from undula.llm.common import byte_rows, give_back, giving_back, in_small_batches, slices


@dataclass(frozen=True)
class Settings:
    buckets: int = 1 << 18
    dim: int = 8
    sizes: tuple[int, ...] = (3, 4, 5, 6)
    window: int = 2
    #: The bound of the sample that training sees: documents of each label, with their whole texts.
    sample_per_label: int = 1_000
    #: A feature found in fewer sample documents is left at zero.
    least_documents: int = 4
    #: Times that the worst windows are chosen anew, steps in between, and clean windows that a document adds each time.
    rounds: int = 14
    steps: int = 10
    hard: int = 4
    rate: float = 0.3
    #: Parts that are left out in turn, for logits of documents that were not learnt from.
    folds: int = 3
    #: Squared gradient that every vector starts with: the more, the less a rare feature moves.
    damping: float = 1.0


def _features(texts: list[bytes], s: Settings):
    """(words, starts of the words' places in a buffer of marked words, [(valid, bucket) per n-gram size], word buckets)."""
    w = textscan.words(texts, matching=True)
    size = w.end - w.start
    at = np.concatenate([[0], np.cumsum(size + 1)])
    spread = np.zeros(len(w.data) + 1, np.int64)
    np.add.at(spread, w.start, 1)
    np.add.at(spread, w.end, -1)
    keep = np.cumsum(spread[:-1]) > 0
    buffer = np.full(at[-1] + 1, 32, np.uint8)
    place = np.ones(at[-1] + 1, bool)
    place[at] = False
    buffer[place] = w.data[keep]
    after = np.repeat(at[1:], np.diff(at))
    positions = np.arange(at[-1])
    grams, h = [], buffer.astype(np.uint64)
    base, mask = np.uint64(1_000_003), np.uint64(s.buckets - 1)
    for n in range(2, max(s.sizes) + 1):
        h = h[:-1] * base + buffer[n - 1 :]
        if n in s.sizes:
            usable = min(len(h), len(positions))
            valid = after[:usable] >= positions[:usable] + n - 1
            grams.append((np.flatnonzero(valid), (textscan.mix(h[:usable][valid] + np.uint64(n)) & mask).astype(np.int32)))
    return w, at, grams, (textscan.mix(w.hash) & mask).astype(np.int32)


def _windows(w: textscan.Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word of each window and the word after its last, and the text it belongs to: every run of `size` neighbouring words,
    or a shorter text's words."""
    return _runs(w.per_text, size)


def _runs(per_text: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    per = np.where(per_text > 0, np.maximum(per_text - size + 1, 1), 0)
    first = np.cumsum(per_text) - per_text
    text = np.repeat(np.arange(len(per)), per)
    begin = first[text] + np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)
    return begin, np.minimum(begin + size, (first + per_text)[text]), text


def _run_sums(values: np.ndarray, begin: np.ndarray, end: np.ndarray, size: int) -> np.ndarray:
    """Sums of values[begin:end], none longer than size; a shorter run is summed no further than its own end."""
    total = values[begin].copy()
    for k in range(1, size):
        inside = begin + k < end
        total[inside] += values[begin[inside] + k]
    return total


@dataclass
class Model:
    """What scoring needs: for each bucket its vector's product with the softmax's class difference; and the
    scale and shift from a worst window's logit to the document's."""

    weights: np.ndarray
    bias: float
    scale: float
    settings: Settings

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Probability of the toxic class; 0 for a text without words."""
        s = self.settings
        w, at, grams, whole = _features(texts, s)
        out = np.zeros(len(texts))
        if not len(whole):
            return out
        value, count = np.zeros(at[-1], np.float32), np.zeros(at[-1], np.int32)
        for where, bucket in grams:
            value[where] += self.weights[bucket]
            count[where] += 1
        value = np.add.reduceat(value, at[:-1]) + self.weights[whole]
        count = np.add.reduceat(count, at[:-1]) + 1
        begin, end, text = _windows(w, s.window)
        logit = _run_sums(value, begin, end, s.window) / _run_sums(count, begin, end, s.window)
        worst = np.full(len(texts), -np.inf)
        np.maximum.at(worst, text, logit)
        seen = np.isfinite(worst)
        out[seen] = 1 / (1 + np.exp(-(self.scale * worst[seen] + self.bias)))
        return out


def _sums(index: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(index, values[:, d], n) for d in range(values.shape[1])], axis=1).astype(np.float32)


def _calibrated(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Scale and shift of a logistic curve through weighted (x, y), by Newton steps with a little shrinkage, each halved
    until it lowers the loss."""
    x1, w = np.stack([x, np.ones_like(x)], axis=1), weight / weight.mean()
    prior = np.array([1.0, 0.0])

    def loss(beta: np.ndarray) -> float:
        z = x1 @ beta
        return float((w * (np.logaddexp(0, z) - y * z)).sum() + 5e-3 * ((beta - prior) ** 2).sum())

    beta = prior
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x1 @ beta, -30, 30)))
        slope = x1.T @ (w * (p - y)) + 1e-2 * (beta - prior)
        curve = (x1 * (w * p * (1 - p))[:, None]).T @ x1 + 1e-2 * np.eye(2)
        step, now = np.linalg.solve(curve, slope), loss(beta)
        while loss(beta - step) > now and np.abs(step).max() > 1e-9:
            step = step / 2
        if np.abs(step).max() <= 1e-9:
            break
        beta = beta - step
    return max(float(beta[0]), 1e-3), float(beta[1])


@dataclass
class _Bags:
    """Distinct words with their features, and texts as runs of word numbers."""

    feature_word: np.ndarray
    feature: np.ndarray
    word: np.ndarray
    per_text: np.ndarray
    n_words: int


def _bags(texts: list[bytes], s: Settings) -> _Bags:
    known: dict[int, int] = {}
    rows, words, per_text = [], [], []
    for a, z in slices(texts, 256 << 10):
        w, at, grams, whole = _features(texts[a:z], s)
        distinct, first, index = np.unique(w.hash, return_index=True, return_inverse=True)
        owner = np.full(len(w.hash), -1, np.int64)
        for f, d in zip(first.tolist(), distinct.tolist(), strict=True):
            if d not in known:
                owner[f] = known[d] = len(known)
        words.append(np.array([known[d] for d in distinct.tolist()], np.int64)[index])
        at_word, own = np.repeat(np.arange(len(w.hash)), np.diff(at)), []
        for where, bucket in [*grams, (at[:-1], whole)]:
            o = owner[at_word[where]]
            own.append(np.stack([o[o >= 0], bucket[o >= 0]]).astype(np.int32))
        # words are numbered as they are met, so a slice's rows stand behind those of all before it
        own = np.concatenate(own, axis=1)
        rows.append(own[:, np.argsort(own[0], kind="stable")])
        per_text.append(w.per_text)
    if not known:
        return _Bags(*[np.zeros(0, np.int64)] * 3, np.zeros(len(texts), np.int64), 0)
    row = np.concatenate(rows, axis=1)
    return _Bags(row[0], row[1], np.concatenate(words), np.concatenate(per_text), len(known))


def _worst(logit: np.ndarray, start: np.ndarray, per: np.ndarray, k: int) -> np.ndarray:
    """Of each run of windows (start, per) the k with the highest logits, the earlier of equal ones; all of a shorter run."""
    left, found = logit.copy(), []
    for _ in range(k):
        top = np.repeat(np.maximum.reduceat(left, start), per)
        at = np.flatnonzero((left == top) & np.isfinite(left))
        owner = np.searchsorted(start, at, "right")
        at = at[np.concatenate([[True], owner[1:] != owner[:-1]])] if len(at) else at
        left[at] = -np.inf
        found.append(at)
    return np.sort(np.concatenate(found))


def _learnt(bags: _Bags, labels: np.ndarray, learn: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(a value for each bucket, each document's worst logit; -inf without words). Documents outside `learn` are only scored.

    Every round takes each document's worst window under the model so far (at first: under the features' excess in toxic
    documents); the worst windows of clean documents are kept for all later rounds. Steps of gradient descent over these
    windows move the buckets' vectors and the softmax at once.
    """
    n_words, word, per_text = bags.n_words, bags.word, bags.per_text
    doc = np.repeat(np.arange(len(per_text)), per_text)
    pair = np.unique(doc * n_words + word)
    pair = pair[learn[pair // n_words]]
    # documents of each label that a word, and by its words a feature, occurs in
    df = [np.bincount(bags.feature, np.bincount(pair % n_words, labels[pair // n_words] == y, n_words)[bags.feature_word], s.buckets) for y in (0, 1)]
    del doc, pair
    live = df[0] + df[1] >= s.least_documents
    # how many standard deviations more of the toxic documents have a feature than the share of all that have it
    n1, both = (labels[learn] == 1).sum(), (df[0] + df[1]) / max(learn.sum(), 1)
    excess = np.where(live, (df[1] - n1 * both) / np.sqrt(n1 * both + 1), 0)
    feature_word, feature = bags.feature_word[live[bags.feature]], bags.feature[live[bags.feature]]
    n_all = np.bincount(bags.feature_word, minlength=n_words).astype(np.float32)
    from_word = np.searchsorted(feature_word, np.arange(n_words + 1))

    begin, end, text = (x.astype(np.int32) for x in _runs(per_text, s.window))
    per = np.bincount(text, minlength=len(per_text))
    with_words = np.flatnonzero(per)
    per, start = per[with_words], (np.cumsum(per) - per)[with_words]
    size = _run_sums(n_all[word], begin, end, s.window)

    def window_logits(by_bucket: np.ndarray) -> np.ndarray:
        of_word = np.bincount(feature_word, by_bucket[feature], n_words).astype(np.float32)
        return _run_sums(of_word[word], begin, end, s.window) / size

    rng = np.random.default_rng(5)
    vectors = (rng.normal(0, 0.05, (s.buckets, s.dim)) * live[:, None]).astype(np.float32)
    softmax = np.stack([-np.ones(s.dim), np.ones(s.dim)], axis=1).astype(np.float32)
    offset = np.zeros(2, np.float32)
    moved, moved_softmax, moved_offset = np.full_like(vectors, s.damping), np.full_like(softmax, 1e-2), np.full_like(offset, 1e-2)
    logit, clean = window_logits(excess), np.zeros(0, np.int64)
    toxic, used_for = labels[text] == 1, learn[text]
    for _ in range(s.rounds):
        found = _worst(logit, start, per, s.hard)
        clean = np.union1d(clean, found[~toxic[found] & used_for[found]])
        bad = _worst(logit, start, per, 1)
        active = np.concatenate([bad[toxic[bad] & used_for[bad]], clean])
        y = toxic[active].astype(np.float32)
        pull = np.where(y == 1, len(active) / max(y.sum(), 1), len(active) / max((1 - y).sum(), 1)).astype(np.float32) / 2
        # the active windows' features in a row
        length = end[active] - begin[active]
        at = np.repeat(begin[active] - np.cumsum(length) + length, length) + np.arange(length.sum())
        w, window = word[at], np.repeat(np.arange(len(active)), length)
        n = from_word[w + 1] - from_word[w]
        own = feature[np.repeat(from_word[w] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        window = np.repeat(window, n)
        used, local = np.unique(own, return_inverse=True)
        local, window = local.astype(np.int32), window.astype(np.int32)
        # features are gone through in blocks, so that only some have their vectors copied out at a time
        blocks = [slice(k, k + (1 << 18)) for k in range(0, len(local), 1 << 18)]
        for _ in range(s.steps if len(local) else 0):
            v = vectors[used]
            mean = sum(_sums(window[b], v[local[b]], len(active)) for b in blocks) / size[active][:, None]
            z = mean @ softmax + offset
            p = 1 / (1 + np.exp(np.clip(z[:, 0] - z[:, 1], -30, 30)))
            error = (p - y) * pull
            both = np.stack([-error, error], axis=1)
            pulled = ((both @ softmax.T) / size[active][:, None]).astype(np.float32)
            d_vectors = sum(_sums(local[b], pulled[window[b]], len(used)) for b in blocks)
            for x, g, m in ((softmax, mean.T @ both / len(active), moved_softmax), (offset, both.mean(0), moved_offset)):
                m += g * g
                x -= s.rate * g / np.sqrt(m)
            m = moved[used] + d_vectors**2
            moved[used] = m
            vectors[used] = v - s.rate * d_vectors / np.sqrt(m)
        by_bucket = vectors @ (softmax[:, 1] - softmax[:, 0])
        logit = window_logits(by_bucket)
    worst = np.full(len(per_text), -np.inf)
    worst[with_words] = np.maximum.reduceat(logit, start)
    return by_bucket.astype(np.float32), worst


def _learnt_apart(spark, texts: list[bytes], labels: np.ndarray, parts: list[np.ndarray], s: Settings) -> list[tuple[np.ndarray, np.ndarray]]:
    """_learnt for each of parts. With a session, a task each: texts, bounded by the sample, are sent along, and their bags
    are made where they are used, so that the driver holds none."""
    if spark is None:
        bags = _bags(texts, s)
        return [_learnt(bags, labels, part, s) if bags.n_words else (np.zeros(s.buckets, np.float32), np.full(len(texts), -np.inf)) for part in parts]
    sent = spark.sparkContext.broadcast((texts, labels, parts))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for k in b.column(0).to_pylist():
                texts, labels, parts = sent.value
                ((by_bucket, worst),) = _learnt_apart(None, texts, labels, [parts[k]], s)
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([by_bucket.tobytes()], pa.binary()), pa.array([worst.tobytes()], pa.binary())], ["k", "by_bucket", "worst"])

    rows = spark.range(0, len(parts), 1, len(parts)).mapInArrow(giving_back(run), "k long, by_bucket binary, worst binary").collect()
    sent.unpersist()
    return [(np.frombuffer(bytes(r["by_bucket"]), np.float32), np.frombuffer(bytes(r["worst"]), np.float64)) for r in sorted(rows, key=lambda r: r["k"])]


def train(texts: list[bytes], labels: np.ndarray, weight: np.ndarray, s: Settings = Settings(), spark=None) -> Model:
    """labels: 1 toxic, 0 not. Without both labels, or without words, the model is constant. With a session, the models
    that the fit needs are trained in tasks beside each other, with the same result.

    A logistic fit turns logits into probabilities. It sees every document twice: with its logit, and with that of a model
    which has not learnt from it (of `folds`, each leaves one part out), as scores are wanted of both kinds of documents.
    """
    labels = np.asarray(labels, np.float64)
    share = float(np.average(labels, weights=weight)) if len(labels) else 0.0
    constant = Model(np.zeros(s.buckets, np.float32), float(np.log((share + 1e-3) / (1 - share + 1e-3))), 1.0, s)
    if not 0 < share < 1:
        return constant
    part, unseen = np.zeros(len(labels), np.int64), np.zeros(len(labels))
    for y in (0, 1):
        part[labels == y] = np.arange((labels == y).sum()) % s.folds
    *left_out, (by_bucket, own) = _learnt_apart(spark, texts, labels, [*(part != k for k in range(s.folds)), np.ones(len(labels), bool)], s)
    for k, (_, worst) in enumerate(left_out):
        unseen[part == k] = worst[part == k]
    worded = np.flatnonzero(np.isfinite(own))
    if not len(worded):
        return constant
    twice = np.tile(worded, 2)
    scale, bias = _calibrated(np.concatenate([own[worded], unseen[worded]]), labels[twice], np.asarray(weight)[twice])
    return Model(by_bucket, bias, scale, s)


def held_out(doc_id):
    """Rows that are never learnt from: crc32 of the id as text leaves 2 modulo 4. A null id is learnt from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4 == 2


def fit(docs: DataFrame, labels: DataFrame, s: Settings = Settings(), label: str = "toxic") -> Model:
    """Learns from at most sample_per_label documents of each label, those with the smallest hashes of their id.

    Null labels are left out; a document labelled twice counts as toxic if either says so, labels without a document
    take no place. Of rows that share an id, the text with the smallest hash is learnt from, on any partitioning. Null
    and empty texts are learnt from as texts without words, long ones whole. An empty table, or one label only: a constant.
    """
    usable = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = usable.groupBy("doc_id").agg(F.max(F.when(F.col(label) > 0, 1).otherwise(0)).alias("y"))
    known = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    counts = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    picked = None
    for y in (0, 1):
        some = known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(s.sample_per_label)
        picked = some if picked is None else picked.union(some)
    texts = docs.join(F.broadcast(picked), "doc_id").select("doc_id", "y", F.col("text").cast("binary").alias("text"))
    rows = texts.groupBy("doc_id", "y").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text"))["text"].alias("text")).collect()
    rows.sort(key=lambda r: r["doc_id"])
    y = np.array([r["y"] for r in rows], np.float32)
    n = {k: max(1, int((y == k).sum())) for k in (0, 1)}
    weight = np.array([counts.get(int(k), 1) / n[int(k)] for k in y], np.float32)
    return train([bytes(r["text"] or b"") for r in rows], y, weight, s, docs.sparkSession)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs' id and score, one row per row, a null id among them. Null and wordless texts score 0, long ones are read whole;
    repeated rows score alike; other columns don't matter. Empty table: no rows. Nothing is shuffled."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            texts = byte_rows(b.column(1))
            parts = [sent.value.scores(texts[a:z]) for a, z in slices(texts, 256 << 10)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(parts) if parts else np.zeros(0))], ["id", "score"])

    return in_small_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(giving_back(run), "id long, score double")


def without_toxic(docs: DataFrame, model: Model, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of docs that score below the threshold, with all their columns, whatever their names; judged where they are read, without a
    shuffle. Null and wordless texts stay, repeated rows stay or go together. Empty table: no rows."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def toxic(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            rows = [b"" if t is None else t.encode() for t in texts]
            yield pd.Series(np.concatenate([sent.value.scores(rows[a:z]) for a, z in slices(rows, 256 << 10)] or [np.zeros(0)]))
        give_back()

    return in_small_batches(docs).where(toxic(F.col(text_col)) < threshold)
