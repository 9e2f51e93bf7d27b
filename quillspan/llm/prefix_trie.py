"""The prefix trie of conversations, built as a Patricia tree over their sorted sequences of turns.

Every conversation is rebuilt (``rebuild``) and becomes a sequence of turn digests, 16
bytes a turn; texts go no further.  Equal sequences are one row with their number,
their smallest conversation and the digest of all of them (``distinct_sequences``).
The rows are sorted by ranges of the sequence, and each range builds its Patricia tree
from the common prefixes of neighbours (``Range``): points are made only where sequences
branch, end or are leaves, with the turns between two points on a compressed edge.
Members, leaves and saved tokens are summed on the points; then the unary nodes of an
edge are written out, with suffix sums of the edge's turns.

A node that two ranges may share is a prefix of the bound between them, as a bound lies
between what is left and right of it.  Those nodes are points in every range; they are
few (the turns of the bounds, of which there are as many as ranges, each cut at
``BOUND`` turns), so their sums are put together at the driver.

Edge cases: rows with a null conv_id belong to no conversation and are ignored; turns
are ordered with null first, ties by the digest of role and text, so the order of rows
never matters; null roles and texts are empty, and so are different from nothing but
equal to empty ones; repeated rows are turns of their own; ``c - c % 100`` takes the
sign of c, as in SQL; a conversation left without turns is a member of the root only;
an empty table gives an empty result; other columns are ignored.  A conversation's
digests travel in one row: 16 MB for a million turns.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

TURN = 16
#: Bytes of sequences in a range, on average.
RANGE_BYTES = 8 << 20
MOST_RANGES = 4096
#: Sequences looked at for each bound.
SAMPLED = 20
#: Turns that a bound has at most.
BOUND = 256
#: Conversations in one piece of the list that ends_sha256 is of.
PIECE = 4096
NOBODY = hashlib.sha256(b"").hexdigest()
GROUP, MOST_OPENING = 100, 5

NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def rebuild(conversations: DataFrame) -> DataFrame:
    """conv_id, turns (16 bytes each, in order) and chars (code points of each text) of every rebuilt conversation."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    turn = F.struct(F.col("turn"), digest.alias("digest"), F.length(text).alias("chars"))
    own = conversations.where("conv_id IS NOT NULL").groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("own"))
    own = materialize(own.select("conv_id", F.transform("own", lambda t: F.struct(t["digest"].alias("digest"), t["chars"].alias("chars"))).alias("own")), "turns")
    base = F.col("conv_id") - F.col("conv_id") % GROUP
    opening = own.where(F.col("conv_id") % GROUP == 0).select(F.col("conv_id").alias("base"), F.slice("own", 1, MOST_OPENING).alias("opening"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (MOST_OPENING + 1)
    both = own.select("conv_id", "own", base.alias("base"), h.cast("int").alias("h")).join(opening, "base", "left")
    first = F.when(F.col("opening").isNull(), F.slice("own", 1, 0)).otherwise(F.slice("opening", F.lit(1), F.col("h")))
    rest = F.slice("own", F.col("h") + 1, F.greatest(F.size("own") - F.col("h"), F.lit(0)))
    turns = both.select("conv_id", F.concat(first, rest).alias("turns"))
    return turns.select("conv_id", F.unhex(F.array_join(F.col("turns.digest"), "")).alias("turns"), F.col("turns.chars").alias("chars"))


def distinct_sequences(rebuilt: DataFrame) -> DataFrame:
    """turns, chars, n (conversations), first (the smallest) and ends (SHA-256 of all their ids) of every distinct sequence.

    The ids of one sequence are sorted by ranges, joined to strings of PIECE ids each,
    and their digest, which can only be taken from first to last, reads these one by one.
    """
    ids = rebuilt.select(F.md5("turns").alias("key"), "conv_id")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, some = None, []
        make = lambda: pa.RecordBatch.from_pylist([{"key": key, "first": some[0], "n": len(some), "ids": ",".join(map(str, some))}], pieces)
        for batch in batches:
            for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if some and (k != key or len(some) == PIECE):
                    yield make()
                    some = []
                key = k
                some.append(c)
        if some:
            yield make()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, n, state = None, 0, 0, None
        make = lambda: pa.RecordBatch.from_pylist([{"first": first, "n": n, "ends": state.hexdigest()}], ended)
        for batch in batches:
            for k, f, m, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != key:
                    if state:
                        yield make()
                    key, first, n, state = k, f, 0, hashlib.sha256()
                else:
                    state.update(b",")
                n += m
                state.update(text.encode())
        if state:
            yield make()

    pieces = pa.schema([("key", pa.string()), ("first", pa.int64()), ("n", pa.int64()), ("ids", pa.string())])
    ended = pa.schema([("first", pa.int64()), ("n", pa.int64()), ("ends", pa.string())])
    joined = ids.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(join, "key string, first long, n long, ids string")
    ends = joined.repartition("key").sortWithinPartitions("key", "first").mapInArrow(digest, "first long, n long, ends string")
    return rebuilt.withColumnRenamed("conv_id", "first").join(ends, "first")


def common(a: bytes, b: bytes) -> int:
    """How many first turns two sequences share."""
    low, high = 0, min(len(a), len(b)) // TURN
    if a[: TURN * high] == b[: TURN * high]:
        return high
    while high - low > 1:  # the first `low` turns are equal, the first `high` ones are not
        middle = (low + high) // 2
        if a[TURN * low : TURN * middle] == b[TURN * low : TURN * middle]:
            low = middle
        else:
            high = middle
    return low


def name_of(sequence: bytes, depth: int) -> str:
    return f"{depth}:" + hashlib.md5(sequence[: TURN * depth]).hexdigest()


class Range:
    """The Patricia tree of one range of sorted distinct sequences.

    A point has the depth of its node, any of its rows, its parent point, and sums over
    what is below it: copies, smallest conversation, children, leaves, saved tokens.
    Of a shared point (a prefix of one of the two bounds) these leave out other shared
    points, whose sums are not yet known.
    """

    def __init__(self, low: bytes, high: bytes):
        self.bounds = [b for b in (low, high) if b is not None]
        self.rows: list[tuple[bytes, np.ndarray]] = []
        self.sums: list[np.ndarray] = []
        self.depth, self.row, self.parent, self.shared, self.n, self.first, self.children, self.leaves, self.saved, self.ends = ([] for _ in range(10))
        self.open: list[int] = []

    def point(self, depth: int, row: int, shared: bool) -> int:
        for column, value in zip((self.depth, self.row, self.parent, self.shared, self.n, self.first, self.children, self.leaves, self.saved, self.ends), (depth, row, -1, shared, 0, None, 0, 0, 0, None), strict=True):
            column.append(value)
        return len(self.depth) - 1

    def close(self, above: int) -> None:
        """Takes the deepest open point off the path and adds its sums to point ``above``."""
        at = self.open.pop()
        self.parent[at] = above
        if self.shared[at]:
            return
        if not self.children[at]:
            self.leaves[at] = 1
        self.n[above] += self.n[at]
        self.first[above] = self.first[at] if self.first[above] is None else min(self.first[above], self.first[at])
        self.children[above] += 1
        self.leaves[above] += self.leaves[at]
        edge = self.sums[self.row[at]][self.depth[at]] - self.sums[self.row[at]][self.depth[above]]
        self.saved[above] += self.saved[at] + (self.n[at] - 1) * int(edge)

    def back_to(self, depth: int) -> None:
        """Closes all points below ``depth``; a point is made there if the path has none."""
        while self.depth[self.open[-1]] > depth:
            above = self.open[-2]
            if self.depth[above] < depth:
                above = self.point(depth, self.row[self.open[-1]], False)
                self.close(above)
                self.open.append(above)
            else:
                self.close(above)

    def add(self, sequence: bytes, chars: np.ndarray, n: int, first: int, ends: str) -> None:
        length, row = len(sequence) // TURN, len(self.rows)
        shared = max((common(sequence, b) for b in self.bounds), default=0)
        if self.rows:
            self.back_to(common(sequence, self.rows[-1][0]))
        else:
            self.open.append(-1)
        self.rows.append((sequence, chars))
        self.sums.append(np.concatenate([[0], np.cumsum(chars, dtype=np.int64)]))
        if self.open[-1] < 0:
            self.open[-1] = self.point(0, row, True)
        for depth in range(self.depth[self.open[-1]] + 1, min(shared, length) + 1):
            self.open.append(self.point(depth, row, True))
        if self.depth[self.open[-1]] < length:
            self.open.append(self.point(length, row, False))
        at = self.open[-1]
        self.n[at] += n
        self.first[at] = first if self.first[at] is None else min(self.first[at], first)
        self.ends[at] = ends

    def nodes(self) -> Iterator[tuple]:
        """Rows of NODE, then the name of the node (shared ones) or of the parent (others, if that is shared), code points, and the parent's name."""
        while len(self.open) > 1:
            self.close(self.open[-2])
        for at, depth in enumerate(self.depth):
            sequence, chars = self.rows[self.row[at]]
            if self.shared[at]:
                yield self.first[at], depth, None, self.n[at], self.children[at], self.leaves[at], self.saved[at], self.ends[at], name_of(sequence, depth), int(chars[depth - 1]) if depth else 0, name_of(sequence, depth - 1) if depth else None
                continue
            above = self.parent[at]
            top = self.depth[above]
            n, first, leaves, sums = self.n[at], self.first[at], self.leaves[at], self.sums[self.row[at]]
            # the point has its own turn to save besides what is below it; a node above it on the edge has all turns from its own on
            saved = (self.saved[at] + (n - 1) * (sums[depth] - sums[top:depth])).tolist()
            for d in range(top + 1, depth + 1):
                parent = first if d > top + 1 else None if self.shared[above] else self.first[above]
                parent_name = name_of(sequence, top) if d == top + 1 and self.shared[above] else None
                yield first, d, parent, n, self.children[at] if d == depth else 1, leaves, saved[d - top - 1], self.ends[at] if d == depth else None, None, None, parent_name


SCHEMA = NODE + ", name string, chars long, parent_name string"
_ARROW = pa.schema([*((c, pa.int64()) for c in "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens".split()), ("ends_sha256", pa.string()), ("name", pa.string()), ("chars", pa.int64()), ("parent_name", pa.string())])


def bounds_of(sequences: DataFrame, ranges: int) -> list[bytes]:
    """Bounds between ``ranges`` ranges, from SAMPLED sequences for each (their first BOUND turns), taken by hash."""
    if ranges < 2:
        return []
    n = sequences.count()
    share = max(1, n // (SAMPLED * ranges))
    some = sequences.where(F.pmod(F.xxhash64("turns"), F.lit(share)) == 0).select(F.substring("turns", 1, TURN * BOUND)).collect()
    some = sorted(bytes(r[0]) for r in some)
    return sorted({some[len(some) * k // ranges] for k in range(1, ranges)} - {b""}) if some else []


def merge_shared(rows: list) -> list[tuple]:
    """The shared nodes of all ranges, put together: rows of NODE and the name."""
    found: dict[str, list] = {}
    for r in rows:
        have = found.get(r["name"])
        if have is None:
            found[r["name"]] = [r["conv_id"], r["depth"], r["parent_name"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"], r["chars"]]
        else:
            have[0] = r["conv_id"] if have[0] is None else have[0] if r["conv_id"] is None else min(have[0], r["conv_id"])
            for k, c in ((3, "n_convs"), (4, "n_children"), (5, "n_leaves"), (6, "saved_tokens")):
                have[k] += r[c]
            have[7] = have[7] or r["ends_sha256"]
    for node in sorted(found.values(), key=lambda x: -x[1]):  # children before parents
        node[5] = node[5] if node[4] else 1
        node[6] += (node[3] - 1) * node[8]
        if node[2] is not None:
            above = found[node[2]]
            above[0] = node[0] if above[0] is None else min(above[0], node[0])
            above[3] += node[3]
            above[4] += 1
            above[5] += node[5]
            above[6] += node[6]
    return [(x[0], x[1], found[x[2]][0] if x[2] is not None else None, x[3], x[4], x[5], x[6], x[7], name) for name, x in found.items()]


def trie(conversations: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """A row of NODE for every node of the trie of the rebuilt conversations."""
    spark = conversations.sparkSession
    sequences = materialize(distinct_sequences(materialize(rebuild(conversations), "rebuilt")), "sequences")
    size = sequences.agg(F.sum(F.length("turns") + 2 * TURN)).first()[0] or 0
    bounds = bounds_of(sequences, min(MOST_RANGES, max(spark.sparkContext.defaultParallelism if size > 1 << 20 else 1, -(-size // range_bytes))))

    def place(turns: pa.Array) -> pa.Array:
        return pa.array([bisect_right(bounds, t) for t in turns.to_pylist()], pa.int32())

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, at = None, -1

        def written() -> Iterator[pa.RecordBatch]:
            some = []
            for row in tree.nodes():
                some.append(row)
                if len(some) == 1 << 13:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), _ARROW, strict=True)], schema=_ARROW)
                    some = []
            if some:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), _ARROW, strict=True)], schema=_ARROW)

        for batch in batches:
            for part, turns, chars, n, first, ends in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part != at:
                    if tree:
                        yield from written()
                    at, tree = part, Range(bounds[part - 1] if part else None, bounds[part] if part < len(bounds) else None)
                tree.add(turns, np.array(chars, np.int64), n, first, ends)
        if tree:
            yield from written()

    parts = sequences.withColumn("part", F.arrow_udf(place, "int")(F.col("turns")))
    ranges = parts.select("part", "turns", "chars", "n", "first", "ends").repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions("part", "turns")
    found = materialize(ranges.mapInArrow(build, SCHEMA), "nodes")
    shared = merge_shared(found.where("name IS NOT NULL").collect())
    if not shared:
        return spark.createDataFrame([], NODE)
    top = spark.createDataFrame(shared, NODE + ", name string")
    names = F.broadcast(top.select(F.col("name").alias("parent_name"), F.col("conv_id").alias("above")))
    own = found.where("name IS NULL").drop("name", "chars").join(names, "parent_name", "left").withColumn("parent_conv_id", F.coalesce("above", "parent_conv_id"))
    columns = [c.split()[0] for c in NODE.split(", ")]
    return own.select(columns).union(top.select(columns)).withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NOBODY)))
