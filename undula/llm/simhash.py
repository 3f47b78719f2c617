"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint has 64 bits over the XXH64 of 3-word shingles. Every bit gets a vector of radius + 1 coordinates; table v
(one for each non-zero vector v) keeps the bits whose vector has an odd product with v. The vectors of any `radius`
bits span at most `radius` dimensions, so some v is orthogonal to all of them: that table's mask leaves those bits
out, and two fingerprints that differ there only, agree in it. No pair within the radius can be missed.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from undula.llm import jaccard
from undula.llm.common import byte_rows, giving_back, materialize, sent_if_small
from undula.llm.components import connected_components

BITS, SEED = 64, 42
#: A bucket of more distinct fingerprints goes to the ball join, which is exact too.
BUCKET_LIMIT = 512


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def covering_masks(radius: int = 3) -> list[int]:
    """2^(radius+1) - 1 masks of 64 bits. The bits share the non-zero vectors out evenly, so each mask keeps about half."""
    n = (1 << (radius + 1)) - 1
    vectors = [i % n + 1 for i in range(BITS)]
    return [sum(1 << i for i, a in enumerate(vectors) if (a & v).bit_count() & 1) for v in range(1, n + 1)]


def shingle_hashes(text: bytes, width: int = 3) -> list[int]:
    import xxhash

    words = text.translate(_LOWER).split()
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else []
    x, joined, ends, at = xxhash.xxh64_intdigest, b" ".join(words), [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends)]
    return [x(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1 :], strict=False)]


#: A-Z to lower case; bytes.split() splits at exactly the six white-space bytes of a word's definition.
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: bytes) -> int:
    """Bit b is 1 if it is set in over half the shingle hashes. No words: 0."""
    import numpy as np

    votes, n = np.zeros(BITS, np.int64), 0
    hashes = shingle_hashes(text)
    for i in range(0, len(hashes), 8192):
        part = np.array(hashes[i : i + 8192], dtype=">u8")
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
        n += len(part)
    return int.from_bytes(np.packbits(2 * votes > n).tobytes(), "big") if n else 0


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_hash, fp long: the 64 bits as a signed number), one row per document. Null or wordless text: 0."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for b in batches:
            fp = np.array([fingerprint(t) for t in byte_rows(b.column(2))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp.view(np.int64))], ["id", "text_hash", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text")).mapInArrow(giving_back(run), "id long, text_hash long, fp long")


def _forest(batches: Iterator) -> Iterator:
    """Buckets of at most BUCKET_LIMIT fingerprints -> the edges of a spanning forest of the links within each."""
    import numpy as np
    import pyarrow as pa

    for b in batches:
        left, right = [], []
        for members, radius in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            v = np.array(members, dtype=np.int64).view(np.uint64)
            near = np.bitwise_count(v[:, None] ^ v[None, :]) <= radius
            todo = np.ones(len(v), bool)
            for root in range(len(v)):
                if not todo[root]:
                    continue
                todo[root], queue = False, [root]
                while queue:
                    at = queue.pop()
                    found = np.flatnonzero(near[at] & todo)
                    todo[found] = False
                    queue += found.tolist()
                    left += [members[at]] * len(found)
                    right += [members[i] for i in found]
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])


def _ball_links(fps: DataFrame, radius: int) -> DataFrame:
    """Links among the fingerprints of overfull buckets, without pairs: x and y are within the radius if and only if some
    value lies within radius//2 of one and radius - radius//2 of the other. Each fingerprint emits its ball; a value's
    smallest inner member is linked to all who reach it. A value has at most as many as its ball holds (2,081 for 3)."""
    inner, outer = radius // 2, radius - radius // 2

    def run(batches: Iterator) -> Iterator:
        from itertools import combinations

        import numpy as np
        import pyarrow as pa

        flips = {d: np.array([sum(1 << i for i in c) for c in combinations(range(BITS), d)], dtype=np.uint64) for d in range(outer + 1)}
        flip, far = np.concatenate([flips[d] for d in flips]), np.concatenate([np.full(len(flips[d]), d) for d in flips])
        for b in batches:
            v = b.column(0).to_numpy(zero_copy_only=False)
            for i in range(0, len(v), 32):
                own = v[i : i + 32]
                at = (own.view(np.uint64)[:, None] ^ flip[None, :]).ravel().view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.repeat(own, len(flip))), pa.array(np.tile(far <= inner, len(own)))], ["at", "fp", "inner"])

    balls = fps.select("fp").mapInArrow(giving_back(run), "at long, fp long, inner boolean")
    centre = balls.groupBy("at").agg(F.min(F.when(F.col("inner"), F.col("fp"))).alias("a"), F.count("*").alias("n")).where("a is not null and n > 1").select("at", "a")
    return balls.join(centre, "at").where("a <> fp").select("a", F.col("fp").alias("b")).distinct()


def links(distinct_fps: DataFrame, radius: int = 3, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """distinct_fps(fp) -> edges (a, b) that join exactly the fingerprints joined by chains of links within the radius."""
    tables = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m)).cast("long")).alias("key")) for t, m in enumerate(covering_masks(radius))])
    keyed = distinct_fps.select("fp", F.explode(tables).alias("k")).select("fp", "k.t", "k.key")
    sizes = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    sizes = materialize(sizes, "simhash-sizes")
    buckets = keyed.join(sizes.where(F.col("n") <= bucket_limit), ["t", "key"]).groupBy("t", "key").agg(F.collect_list("fp").alias("members"))
    edges = buckets.select("members", F.lit(radius).alias("radius")).mapInArrow(giving_back(_forest), "a long, b long")
    over = sizes.where(F.col("n") > bucket_limit)
    if not over.isEmpty():
        edges = edges.union(_ball_links(keyed.join(over, ["t", "key"]).select("fp").distinct(), radius))
    return edges


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """One row per row of docs: id, text_hash, fp, component (a fingerprint that names it) and component_id, the smallest id
    reachable over links of at most `radius` bits.

    Copies share a fingerprint and are one node. Nulls: text counts as empty; a null id is never smallest, and a component
    of null ids only has a null component_id. Repeated rows are returned as often. Empty table: no rows.
    """
    fps = materialize(fingerprints(docs, id_col, text_col), "simhash-fps")
    return _joined(fps, links(fps.select("fp").distinct(), radius, bucket_limit))


def _joined(fps: DataFrame, edges: DataFrame) -> DataFrame:
    """fps(id, text_hash, fp) with the component of each and its smallest id, over edges (a, b) of fingerprints."""
    nodes = fps.groupBy("fp").agg(F.min("id").alias("least_id"))
    found = connected_components(edges)
    labelled = nodes.join(found, nodes["fp"] == found["node"], "left").select("fp", "least_id", F.coalesce("component", "fp").alias("c"))
    least = labelled.groupBy("c").agg(F.min("least_id").alias("component_id"))
    of = labelled.join(least, "c").select("fp", F.col("c").alias("component"), "component_id")
    return fps.join(of, "fp").select("id", "text_hash", "fp", "component", "component_id")


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3, key_limit: int = jaccard.KEY_LIMIT) -> DataFrame:
    """As near_duplicates, with components over the links of at most `radius` bits and those of similar 5-word shingles (jaccard)."""
    info = materialize(jaccard.described(docs, id_col, text_col), "copies-info")
    near = links(info.select("fp").distinct(), radius)
    return _joined(info.select("id", "text_hash", "fp"), jaccard.links(info, docs, near, text_col, key_limit))


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3) -> DataFrame:
    """One row of docs of each component of copies(), with all its columns: that of the smallest id, then of the smallest hash of its text.

    Of repeated rows one stays; a null id stays only where a component has no other. Null text counts as empty; long texts
    are read whole; columns of any name pass through. Empty table: no rows. Only the ids and hashes of rows that go are
    joined to docs; they are broadcast where they are few.
    """
    found = materialize(copies(docs, id_col, text_col, radius), "simhash-components")
    pick = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_hash")).alias("pick")
    stays = found.groupBy("component").agg(pick).select("component", F.col("pick.id").alias("stays_id"), F.col("pick.text_hash").alias("stays_hash"))
    goes = ~(F.col("id").eqNullSafe(F.col("stays_id")) & (F.col("text_hash") == F.col("stays_hash")))
    gone = found.join(stays, "component").where(goes).select(F.col("id").alias("gone_id"), F.col("text_hash").alias("gone_hash")).distinct()
    gone = sent_if_small(materialize(gone, "simhash-gone"))
    key, text_hash = docs[id_col].cast("long"), F.xxhash64(docs[text_col])
    kept = docs.join(gone, key.eqNullSafe(gone["gone_id"]) & (text_hash == gone["gone_hash"]), "left_anti")
    if found.groupBy("id", "text_hash").count().where("count > 1").isEmpty():
        return kept
    # of rows equal in id and text, the one whose columns have the smallest hash, on any partitioning
    whole = F.xxhash64(F.to_json(F.struct(*[kept[c] for c in kept.columns])))
    first = F.row_number().over(Window.partitionBy("own.id", "own.text_hash").orderBy("whole"))
    rows = kept.select(F.struct(*[kept[c] for c in kept.columns]).alias("row"), F.struct(key.alias("id"), text_hash.alias("text_hash")).alias("own"), whole.alias("whole"))
    return rows.withColumn("first", first).where("first = 1").select(*[F.col("row")[c].alias(c) for c in kept.columns])


def fingerprint_hex(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))
