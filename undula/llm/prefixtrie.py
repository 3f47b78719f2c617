"""Prefix trie of conversations by range minima over sorted longest common prefixes.

A turn is a digest, a conversation the string of its turns' digests. Conversations are sorted by that string over all
tasks; of each its common prefix with the one before is kept, in turns. A prefix of d turns is found first where that
value is below d; its members reach as far to the right as no value falls below d. Both ends come from binary search in
a sparse table of range minima, each on its own, so no stack is carried along and all candidates are searched at once.

A task sorts and searches one range. Only prefixes that a range shares with a neighbour are left open: at most one a
depth at each end. Those pieces are joined into chains by a window over the ranges, a table of ranges times depth;
what lies below a chain is the sum of its pieces' closed nodes and of the chains that begin in it.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from undula.llm.common import materialize

#: Turns in a range, and hexadecimal digits of a turn's digest.
RANGE_TURNS, WIDE = 250_000, 32
NODE, OPEN, CARRY = 0, 1, 2
PIECES = "p long, kind int, i long, depth long, n_convs long, least long, n_children long, n_leaves long, saved long, last_chars long, last_length long, whole boolean, parent_kind int, parent_p long, parent_i long, parent long, ends binary"


class RangeMinimum:
    """Sparse table: minima of all runs of 2^k values."""

    def __init__(self, values: np.ndarray):
        self.n, self.levels = len(values), [values]
        while 2 << (len(self.levels) - 1) <= self.n:
            last, half = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(last[:-half], last[half:]))

    def least(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Minimum of values[first..last], both included."""
        k = np.frexp(last - first + 1)[1] - 1
        out = np.empty(len(first), self.levels[0].dtype)
        for level in np.unique(k):
            at = k == level
            out[at] = np.minimum(self.levels[level][first[at]], self.levels[level][last[at] - (1 << int(level)) + 1])
        return out

    def right(self, at: np.ndarray, d: np.ndarray) -> np.ndarray:
        """Largest r >= at with all of values[at + 1..r] >= d."""
        r = at.copy()
        for k in reversed(range(len(self.levels))):
            ask = np.flatnonzero(r + (1 << k) < self.n)
            ok = ask[self.levels[k][r[ask] + 1] >= d[ask]]
            r[ok] += 1 << k
        return r

    def left(self, at: np.ndarray, d: np.ndarray) -> np.ndarray:
        """Smallest l <= at with all of values[l + 1..at] >= d."""
        here = at.copy()
        for k in reversed(range(len(self.levels))):
            ask = np.flatnonzero(here - (1 << k) >= 0)
            ok = ask[self.levels[k][here[ask] - (1 << k) + 1] >= d[ask]]
            here[ok] -= 1 << k
        return here


def common_turns(a: str, b: str) -> int:
    """Turns that two strings of digests begin with alike."""
    low, high = 0, min(len(a), len(b)) // WIDE
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[: mid * WIDE] == b[: mid * WIDE] else (low, mid - 1)
    return low


def _range(rows, edge):
    """One range: its closed nodes, the pieces open at its end (OPEN) and those carried in from the range before (CARRY)."""
    import pyarrow as pa

    order = rows.sort_by("place")
    conv, keys = order["conv_id"].to_numpy(), order["key"].to_pylist()
    p, before = edge["p"][0].as_py(), edge["before"][0].as_py()
    n = len(keys)
    size = np.array([len(k) // WIDE for k in keys], np.int64)
    chars = order["chars"].combine_chunks()
    starts, chars = chars.offsets.to_numpy(), chars.flatten().to_numpy()
    same = np.array([0 if before is None else common_turns(before, keys[0]), *map(common_turns, keys, keys[1:])], np.int64)
    common, ids = RangeMinimum(same), RangeMinimum(conv)
    alike = np.append(np.flatnonzero((same[1:] != size[1:]) | (size[1:] != size[:-1])), n - 1)  # last row of each run of equal ones

    # candidates: (row, depth) where the prefix is new; the root only where nothing comes before
    root = 1 if before is None else 0
    new = size - same
    new[0] += root
    i = np.repeat(np.arange(n), new)
    d = np.arange(len(i)) - np.repeat(np.cumsum(new) - new, new) + np.repeat(same, new) + 1
    if root:
        d[i == 0] -= 1
    # carried in: the depths that the first row shares with the row before this range, the root among them
    carried = np.arange(same[0] + 1) if before is not None else np.zeros(0, np.int64)
    i, d = np.concatenate([np.zeros(len(carried), np.int64), i]), np.concatenate([carried, d])
    kind = np.full(len(i), NODE)
    kind[: len(carried)] = CARRY
    r = common.right(i, d)
    whole = r == n - 1
    kind[whole & (kind == NODE)] = OPEN

    n_convs, least = r - i + 1, ids.least(i, r)
    last_chars = np.where(d > 0, chars[np.minimum(starts[i] + np.maximum(d, 1) - 1, max(len(chars) - 1, 0))] if len(chars) else 0, 0)
    closed = kind == NODE
    own_saved, own_leaf = np.where(closed, (n_convs - 1) * last_chars, 0), (closed & (size[r] == d)).astype(np.int64)
    # candidates stand in order of row and depth, so those below one are a run of them: it and what follows up to row r
    place = np.arange(len(i))
    end = np.searchsorted(i[len(carried) :], r, side="right") + len(carried)
    first = np.where(kind == CARRY, len(carried), place)
    sums = [np.concatenate([[0], np.cumsum(x)]) for x in (own_saved, own_leaf)]
    saved, leaves = (s[end] - s[first] for s in sums)

    # parents: one turn less, from the row's own candidates or, at its first new depth, from the left extent
    up = d - 1
    at = np.where(up > same[i], i, common.left(i, np.maximum(up, 0)))
    from_before = (at == 0) & (up <= same[0]) & (before is not None)
    index = np.searchsorted(i[len(carried) :] * (size.max(initial=0) + 2) + d[len(carried) :], at * (size.max(initial=0) + 2) + up) + len(carried)
    index = np.where(from_before, np.minimum(up, same[0]), np.minimum(index, len(i) - 1))
    has = up >= 0
    children = np.bincount(index[has & (kind != CARRY)], minlength=len(i))
    parent_kind, parent_i = np.where(has, kind[index], -1), np.where(has, i[index], -1)
    parent = np.where(has & (parent_kind == NODE), least[index], 0)

    # members of exactly d turns stand first, in order of their numbers
    stop = alike[np.searchsorted(alike, i)]
    ends = np.where(size[i] == d, stop - i + 1, 0)
    text = [",".join(map(str, conv[a : a + k].tolist())).encode() for a, k in zip(i.tolist(), ends.tolist(), strict=True)]
    said = [hashlib.sha256(t).hexdigest().encode() if c else t for t, c in zip(text, closed.tolist(), strict=True)]
    long = lambda x: pa.array(np.asarray(x, np.int64))
    values = [long(np.full(len(i), p)), pa.array(kind.astype(np.int32)), long(i), long(d), long(n_convs), long(least), long(children), long(leaves), long(saved), long(last_chars), long(size[r]), pa.array(whole)]
    values += [pa.array(parent_kind.astype(np.int32)), long(np.full(len(i), p)), long(parent_i), pa.array(parent, mask=~(parent_kind == NODE)), pa.array(said, pa.binary())]
    return pa.table(values, names=[x.split()[0] for x in PIECES.split(", ")])


def _digests(batches: Iterator) -> Iterator:
    """Pieces of each chain in order -> (p, i, depth, ends_sha256), a piece at a time."""
    import pyarrow as pa

    now, state, empty = None, None, True
    for b in batches:
        done: list[tuple] = []
        for p, i, d, ends in zip(*(b.column(c).to_pylist() for c in range(4)), strict=True):
            if (p, i, d) != now:
                if now is not None:
                    done.append((*now, state.hexdigest()))
                now, state, empty = (p, i, d), hashlib.sha256(), True
            if ends:
                state.update(ends if empty else b"," + ends)
                empty = False
        yield pa.RecordBatch.from_arrays([*(pa.array([x[c] for x in done], pa.int64()) for c in range(3)), pa.array([x[3] for x in done], pa.string())], ["p", "i", "depth", "ends_sha256"])
    if now is not None:
        yield pa.RecordBatch.from_arrays([*(pa.array([x], pa.int64()) for x in now), pa.array([state.hexdigest()])], ["p", "i", "depth", "ends_sha256"])


def sequences(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turns: array of digest and code points), a row per conversation, in order of turn.

    Null turns come first, ties in order of the digest; a null role or text is empty; repeated rows are turns of their
    own; a null id belongs to no conversation. One row holds some 50 bytes a turn, no text.
    """
    role, text = F.coalesce(F.col(role_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    said = turns.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("conv_id"), F.struct(F.col(turn_col).cast("long").alias("turn"), digest.alias("digest"), F.char_length(text).cast("long").alias("chars")).alias("t"))
    return said.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list("t")), lambda x: F.struct(x["digest"].alias("digest"), x["chars"].alias("chars"))).alias("turns"))


def spliced(convs: DataFrame, source: Column, head: Column) -> DataFrame:
    """Each conversation with its first `head` turns replaced by those of conversation `source` (all if fewer, none if absent)."""
    longest = convs.select(F.max(head)).first()[0] or 0
    asks = convs.select("conv_id", "turns", source.alias("source"), head.cast("int").alias("head"))
    heads = convs.select(F.col("conv_id").alias("source"), F.slice("turns", 1, int(longest)).alias("lead")).join(asks.select("source").distinct(), "source", "left_semi")
    both = F.concat(F.slice(F.coalesce("lead", F.array().cast("array<struct<digest:string,chars:bigint>>")), F.lit(1), F.col("head")), F.slice("turns", F.col("head") + 1, F.size("turns")))
    return asks.join(heads, "source", "left").select("conv_id", both.alias("turns"))


def trie(convs: DataFrame, range_turns: int = RANGE_TURNS) -> DataFrame:
    """convs(conv_id, turns) -> a row per node, by its smallest member and depth: conv_id, depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256.

    A node is a distinct sequence of first d turns; its members are the conversations that start with it, turnless ones in
    the root alone. Copies are members each; repeated ids too. Long conversations cost 40 bytes a turn in one row. An
    empty table has no nodes, not even a root.
    """
    spark = convs.sparkSession
    flat = materialize(convs.select("conv_id", F.array_join("turns.digest", "").alias("key"), F.col("turns.chars").alias("chars")), "trie-keys")
    turns, n = flat.agg(F.sum(F.size("chars")), F.count("*")).first()
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(((turns or 0) + n) / range_turns))
    ordered = flat.repartitionByRange(ranges, "key", "conv_id").sortWithinPartitions("key", "conv_id")
    ordered = materialize(ordered.withColumn("p", F.spark_partition_id().cast("long")).withColumn("place", F.monotonically_increasing_id()), "trie-sorted")
    # a row per range: the last key of the range before it
    last = ordered.groupBy("p").agg(F.max_by("key", "place").alias("last"))
    edges = last.select("p", F.lag("last").over(Window.orderBy("p")).alias("before"))
    pieces = ordered.groupBy("p").cogroup(edges.groupBy("p")).applyInArrow(_range, PIECES)
    pieces = materialize(pieces, "trie-pieces")

    # a piece carried in belongs to the last one of its depth that was opened
    begun = Window.partitionBy("depth").orderBy("p", F.desc("kind")).rowsBetween(Window.unboundedPreceding, 0)
    opened = F.last(F.when(F.col("kind") == OPEN, F.struct(F.col("p").alias("p0"), F.col("i").alias("i0"))), ignorenulls=True).over(begun)
    parts = materialize(pieces.where(F.col("kind") != NODE).withColumn("of", opened).select("*", "of.p0", "of.i0").drop("of"), "trie-parts")
    total = parts.groupBy("p0", "i0", "depth").agg(
        F.sum("n_convs").alias("n_convs"), F.min("least").alias("conv_id"), F.sum("n_children").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"),
        F.max_by("last_length", "p").alias("last_length"), F.max("last_chars").alias("last_chars"), F.max(F.when(F.col("whole"), F.col("p"))).alias("last_whole"),
    )
    total = total.withColumn("own_saved", (F.col("n_convs") - 1) * F.col("last_chars")).withColumn("own_leaf", (F.col("last_length") == F.col("depth")).cast("long"))
    total = materialize(total, "trie-chains")
    # chains below a chain: those begun in its range no less deep, and all begun in later ranges that it fills
    deeper = Window.partitionBy("p0").orderBy(F.desc("depth"))
    begins = total.groupBy("p0").agg(F.sum("own_saved").alias("s"), F.sum("own_leaf").alias("l"))
    up_to = Window.orderBy("p0").rowsBetween(Window.unboundedPreceding, 0)
    filled = edges.select(F.col("p").alias("p0")).join(begins, "p0", "left").select(F.col("p0").alias("q"), F.sum(F.coalesce("s", F.lit(0))).over(up_to).alias("s"), F.sum(F.coalesce("l", F.lit(0))).over(up_to).alias("l"))
    filled = materialize(filled, "trie-filled")
    from_first, to_last = filled.toDF("p0", "s0", "l0"), filled.toDF("last_whole", "s1", "l1")
    chains = total.withColumn("s", F.sum("own_saved").over(deeper)).withColumn("l", F.sum("own_leaf").over(deeper)).join(from_first, "p0").join(to_last, "last_whole")
    chains = chains.select("p0", "i0", "depth", "conv_id", "n_convs", "n_children", (F.col("n_leaves") + F.col("l") + F.col("l1") - F.col("l0")).alias("n_leaves"), (F.col("saved") + F.col("s") + F.col("s1") - F.col("s0")).alias("saved_tokens"))
    chains = materialize(chains, "trie-chain-sums")
    ends = parts.select("p0", "i0", "depth", "ends", "p").repartition("p0", "i0", "depth").sortWithinPartitions("p0", "i0", "depth", "p").drop("p")
    ends = ends.mapInArrow(_digests, "p long, i long, depth long, ends_sha256 string").toDF("p0", "i0", "depth", "ends_sha256")

    # which chain a range's piece of a depth belongs to names the parents
    names = parts.select("p", "kind", "depth", "p0", "i0").join(chains.select("p0", "i0", "depth", "conv_id"), ["p0", "i0", "depth"]).select(F.col("p").alias("parent_p"), F.col("kind").alias("parent_kind"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("chain_parent"))
    names = materialize(names, "trie-names")
    closed = pieces.where(F.col("kind") == NODE).join(names, ["parent_p", "parent_kind", "depth"], "left")
    closed = closed.select(F.col("least").alias("conv_id"), "depth", F.coalesce("parent", "chain_parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.col("ends").cast("string").alias("ends_sha256"))
    above = parts.where(F.col("kind") == OPEN).select("p0", "i0", "depth", "parent_p", "parent_kind").join(names, ["parent_p", "parent_kind", "depth"], "left").select("p0", "i0", "depth", F.col("chain_parent").alias("parent_conv_id"))
    wide = chains.join(above, ["p0", "i0", "depth"]).join(ends, ["p0", "i0", "depth"]).select(*closed.columns)
    return closed.union(wide)
