"""Best-fit packing of tokenised documents into sequences of fixed capacity, in bulk-synchronous rounds.

A document's ids end with id 0; longer documents are cut into full pieces and a rest.
Pieces above half the capacity open sequences.  Smaller ones follow by classes of sizes,
each between a half and the whole of its largest (the last class has all the small ones),
and every class takes rounds over tables of pieces and gaps:

* Sweep: the class's pieces and all gaps that can hold one are sorted by size into ranges,
  gaps before pieces of their size.  Each range is swept from its largest piece down; a
  piece takes its successor, the smallest gap that holds it, and leaves a smaller gap.
* Conflicts: pieces that found their range's gaps taken are ranked, and so are the gaps
  that no piece took.  A carry over the ranges (a row of counts per range) gives ranks of
  pieces to ranks of gaps in the nearest range of larger gaps that has some left, as many
  to a gap as it surely holds; what gets none opens sequences.
* Updates: matched ranks meet in units of bounded size, where the same sweep places them,
  and the gaps that remain go on to the next round.  A class repeats its round as long as
  gaps of the last one can hold a piece that would have to open a sequence.

The driver sees counts by range only; pieces and gaps stay in Spark's tables.

Edge cases: a null text counts as empty (one piece, of id 0 alone); repeated rows are
pieces of their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import LEAVES, LONGEST_CACHED, Bpe, Recent, merge, merge_many
from .common import materialize, pieces_of

CAPACITY = 2048
END = 0
#: Pieces and gaps that a task sweeps together, and that a unit of matched ranks has, on average and at most.
RANGE_ROWS, UNIT_ROWS = 400_000, 50_000
#: Pieces of text of which a Python process keeps the ids (twice as many at most).
CACHED = 1 << 17
#: Classes of sizes end here: all smaller pieces are one class.
SMALL = 64

_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


class RankBpe(Bpe):
    """Packs whole texts; pieces that aren't cached are encoded by tiktoken, all of a batch in one call.

    tiktoken joins neighbours whenever its vocabulary has what they make, the lowest
    rank first; this file's merges join listed pairs only.  What the merges below a rank
    make of a span that none of them crosses doesn't depend on what stands around it, as
    long as each merge ranks behind those of its parts.  So the two agree if every token
    that tiktoken gets is what its own bytes merge to; a token that isn't is never made
    by the pairs either, and is left out.

    A line feed stands for the end of a word and a carriage return, as a word, for the
    end of a piece: both are white space, so no piece has them.
    """

    def __init__(self, path: str):
        super().__init__(path)
        self.pieces = Recent(CACHED)
        self.words_and_ends = regex.compile(self.common_split.pattern + "|\r")
        raw = {s: bytes([b]) for b, s in enumerate(self.inner)} | {s: bytes([b]) + b"\n" for b, s in enumerate(self.last)}
        spelled = {s: (s,) for s in raw}
        ordered = True
        for pair, value in self.pairs.items():  # by rank
            left, right, token = pair >> 20, pair & 0xFFFFF, value & 0xFFFFF
            if left not in raw or right not in raw or token in raw:
                ordered = False
                break
            raw[token], spelled[token] = raw[left] + raw[right], spelled[left] + spelled[right]
        ends = {symbols[b] for symbols in (self.inner, self.last) for b in b"\r\n"}
        own = self.stable([t for t in spelled if len(spelled[t]) > 1 and ends.isdisjoint(spelled[t])], spelled)
        self.token_of = np.array([*self.inner, *self.last, *own], np.uint32)
        ranks = {raw[t]: rank for rank, t in enumerate(self.token_of.tolist())}
        self.ranks = tiktoken.Encoding("words", pat_str=r"[^\n]*\n", mergeable_ranks=ranks, special_tokens={}) if ordered and len(ranks) == len(self.token_of) else None
        self.end = ranks[b"\r\n"]

    def stable(self, tokens: list[int], spelled: dict[int, tuple[int, ...]]) -> list[int]:
        """Those of ``tokens`` that their own symbols merge to."""
        kept: set[int] = set()
        shortest = 0
        for size in LEAVES:
            some = [t for t in tokens if shortest < len(spelled[t]) <= size]
            symbols = np.full((len(some), size + 1), -1, np.int64)
            for row, t in enumerate(some):
                symbols[row, : len(spelled[t])] = spelled[t]
            merged = merge_many(symbols, size, self.found)
            kept.update(np.array(some, np.int64)[(merged[:, 0] == some) & (merged[:, 1:] < 0).all(axis=1)].tolist())
            shortest = size
        kept.update(t for t in tokens if len(spelled[t]) > shortest and merge(list(spelled[t]), self.pairs) == [t])
        return [t for t in tokens if t in kept]

    def learn(self, pieces: set[str | int]) -> dict[str | int, bytes]:
        texts = [p for p in pieces if isinstance(p, str) and 0 < len(p) <= LONGEST_CACHED] if self.ranks else []
        joined = "\r".join(texts) + "\r"
        if not texts or not joined.isascii() and self.newer.search("".join(set(joined))):
            return super().learn(pieces)
        found = self.ranks.encode_to_numpy("\n".join(self.words_and_ends.findall(joined)) + "\n", disallowed_special=())
        ends = np.flatnonzero(found == self.end)
        packed = self.token_of[found].tobytes()
        made = {p: packed[a:b] for p, a, b in zip(texts, [0, *(4 * ends + 4).tolist()], (4 * ends).tolist())}
        return made | super().learn(pieces.difference(made)) if len(made) < len(pieces) else made


@lru_cache(maxsize=2)
def load(path: str) -> RankBpe:
    return RankBpe(path)


def cut(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, and the CRC-32 of its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, end = load(path), np.array([END], "<u4").tobytes()
        for batch in pieces_of(batches, 1, 4 << 20):
            rows = []
            for doc_id, packed in zip(batch.column(0).to_pylist(), bpe.pack_many([t or "" for t in batch.column(1).to_pylist()]), strict=True):
                packed = np.frombuffer(packed + end, np.uint32).astype("<u4", copy=False).tobytes()
                for n, at in enumerate(range(0, len(packed), 4 * capacity)):
                    ids = packed[at : at + 4 * capacity]
                    rows.append((doc_id, n, at // 4, len(ids) // 4, zlib.crc32(ids)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PIECES, strict=True)], schema=_PIECES)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")



#: A row of a round: a gap (its size and sequence) or a piece. In a round's result, what became of it; part and rank say where it stood in the sweep.
_ROWS = pa.schema([("kind", pa.int32()), ("size", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("part", pa.int64()), ("rank", pa.int64())])
_ROWS_DDL = "kind int, size long, doc_id long, piece int, start long, ids_crc32 long, sequence_id long, offset long, part long, rank long"
NAMES = [f.name for f in _ROWS]
FREE, USED, WAITS, PLACED = range(4)  # gaps that no piece took, gaps that one took; pieces without and with a place


def best_fit(sizes: list[int], gaps: list[int], capacity: int, opens: bool) -> tuple[list[int], list[int], list[int]]:
    """The gap that each piece takes (-1: none) and its offset there, and what is left of all gaps; ``sizes`` descend.

    Sizes that some gap has are the bits of a number, so a piece's successor is its lowest bit from the piece's size on.
    """
    left, shelves, mask = list(gaps), {}, 0
    for b, gap in enumerate(left):
        shelves.setdefault(gap, []).append(b)
        mask |= 1 << gap
    taken, offsets = [-1] * len(sizes), [0] * len(sizes)
    for i, size in enumerate(sizes):
        fits = mask >> size
        if fits:
            gap = size + (fits & -fits).bit_length() - 1
            shelf = shelves[gap]
            b = shelf.pop()
            if not shelf:
                mask ^= 1 << gap
        elif opens:
            b, gap = len(left), capacity
            left.append(capacity)
        else:
            continue
        taken[i], offsets[i] = b, capacity - gap
        rest = left[b] = gap - size
        if rest:
            shelf = shelves.setdefault(rest, [])
            if not shelf:
                mask |= 1 << rest
            shelf.append(b)
    return taken, offsets, left


def _swept(rows: pa.Table, capacity: int, opens: bool, first_new: int, part: int) -> pa.RecordBatch:
    """The rows of one range or unit, sorted by descending size, after a sweep; sequences that it opens are numbered from ``first_new``."""
    kind, size, sequence = (rows.column(c).to_numpy() for c in ("kind", "size", "sequence_id"))
    piece = kind >= WAITS
    at_piece, at_gap = np.flatnonzero(piece), np.flatnonzero(~piece)
    before = size[at_gap]
    taken, offsets, left = (np.array(x, np.int64) for x in best_fit(size[at_piece].tolist(), before.tolist(), capacity, opens))
    names = np.r_[sequence[at_gap], first_new + np.arange(len(left) - len(at_gap))].astype(np.int64)
    has = taken >= 0
    new_kind = np.where(has, PLACED, WAITS).astype(np.int32)
    rank = np.cumsum(~has) - 1  # pieces that wait, from the largest one
    placed = [pa.array(new_kind), pa.array(size[at_piece]), *(rows.column(c).take(at_piece).combine_chunks() for c in ("doc_id", "piece", "start", "ids_crc32")), pa.array(np.where(has, names[taken] if len(names) else 0, 0)), pa.array(offsets), pa.array(np.full(len(at_piece), part)), pa.array(rank)]
    pieces = pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(placed, _ROWS, strict=True)], schema=_ROWS)
    free = np.r_[left[: len(before)] == before, np.zeros(len(left) - len(before), bool)]
    rank = np.cumsum(free[::-1])[::-1] - 1  # free gaps, from the smallest one
    n, none = len(left), pa.nulls(len(left), pa.int64())
    open_gaps = [pa.array(np.where(free, FREE, USED).astype(np.int32)), pa.array(left), none, none, none, none, pa.array(names), pa.array(np.zeros(n, np.int64)), pa.array(np.full(n, part)), pa.array(rank)]
    gaps = pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(open_gaps, _ROWS, strict=True)], schema=_ROWS).filter(pa.array(left > 0))
    return pa.concat_batches([pieces, gaps])


def _sweep(rows: DataFrame, tasks: int, capacity: int) -> DataFrame:
    """The sweep of the ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [b for b in batches if b.num_rows]
        if own:
            yield _swept(pa.Table.from_batches(own), capacity, False, 0, TaskContext.get().partitionId())

    tie = F.xxhash64("doc_id", "piece", "start", "sequence_id")
    order = [F.desc("size"), F.asc("kind"), F.asc("tie")]
    dealt = rows.withColumn("tie", tie).repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    return dealt.select(NAMES).mapInArrow(run, _ROWS_DDL)


def carry(ranges: list[tuple[int, int, int, int, int]]) -> list[tuple[int, int, int, int, int, int, int]]:
    """Which ranks meet: (range of pieces, first rank, pieces, range of gaps or -1, first rank, gaps, pieces to a gap).

    ranges: for each range, from the largest sizes down, its number, how many pieces
    wait and the largest of them, how many gaps are free and the smallest of them.
    """
    stack: list[list[int]] = []
    out = []
    for part, waiting, largest, free, smallest in sorted(ranges):
        at = 0
        while at < waiting:
            if not stack:
                out.append((part, at, waiting - at, -1, 0, 0, 1))
                break
            q, first, count, gap = stack[-1]
            each = gap // largest
            used = min(count, -(-(waiting - at) // each))
            out.append((part, at, min(used * each, waiting - at), q, first, used, each))
            at += used * each
            stack[-1][1:3] = first + used, count - used
            if count == used:
                stack.pop()
        if free:
            stack.append([part, 0, free, smallest])
    return out


def _units(swept: DataFrame, meets: list[tuple[int, int, int, int, int, int, int]]) -> DataFrame:
    """Waiting pieces and free gaps with the unit that they meet in (-1: none), and whether it opens sequences."""
    pieces, gaps, base = [], [], 0
    for part, first, count, q, gap_first, gap_count, each in sorted(meets):
        per = max(1, UNIT_ROWS // (each + 1))
        pieces.append((part << 40 | first, count, base, per * each, q < 0))
        if q >= 0:
            gaps.append((q << 40 | gap_first, gap_count, base, per, False))
        base += -(-count // (per * each))
    tables = [np.array(sorted(x) or [(1 << 62, 0, 0, 1, 0)], np.int64).T for x in (gaps, pieces)]  # a few rows per range
    schema = pa.schema([*_ROWS, ("unit", pa.int64()), ("opens", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, part, rank = (batch.column(NAMES.index(c)).to_numpy() for c in ("kind", "part", "rank"))
            key, unit, opens = part << 40 | rank, np.full(len(kind), -1), np.zeros(len(kind), bool)
            for wanted, (starts, counts, bases, per, opening) in zip((FREE, WAITS), tables, strict=True):
                at = np.maximum(np.searchsorted(starts, key, side="right") - 1, 0)
                inside = (kind == wanted) & (key >= starts[at]) & (key < starts[at] + counts[at])
                unit[inside] = (bases[at] + (key - starts[at]) // per[at])[inside]
                opens[inside] = opening[at][inside] > 0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(unit), pa.array(opens)], schema=schema)

    return swept.where(F.col("kind").isin(FREE, WAITS)).mapInArrow(run, f"{_ROWS_DDL}, unit long, opens boolean")


def _meet(units: DataFrame, tasks: int, capacity: int, turn: int) -> DataFrame:
    """The sweep of the units."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        new = turn << 56 | TaskContext.get().partitionId() << 32
        for batch in batches:
            unit = batch.column(len(NAMES)).to_numpy()
            cuts = [0, *(np.flatnonzero(unit[1:] != unit[:-1]) + 1).tolist(), len(unit)]
            for a, b in zip(cuts, cuts[1:]):
                if held and b > a and held[0].column(len(NAMES))[0].as_py() != int(unit[a]):
                    done = _swept(pa.Table.from_batches(held), capacity, held[0].column(len(NAMES) + 1)[0].as_py(), new, 0)
                    new += done.num_rows
                    held = []
                    yield done
                if b > a:
                    held.append(batch.slice(a, b - a))
        if held:
            yield _swept(pa.Table.from_batches(held), capacity, held[0].column(len(NAMES) + 1)[0].as_py(), new, 0)

    dealt = units.where("unit >= 0").repartition(tasks, "unit").sortWithinPartitions("unit", F.desc("size"), "kind")
    return dealt.select(*NAMES, "unit", "opens").mapInArrow(run, _ROWS_DDL)


def _place_class(waiting: DataFrame, gaps: DataFrame, tasks: int, capacity: int, turn: int) -> tuple[list[DataFrame], DataFrame, int]:
    """Places a class's pieces: tables with their places, the gaps afterwards, and the next turn's number."""
    placed = []
    while True:
        swept = materialize(_sweep(waiting.union(gaps), tasks, capacity), "sweep")
        placed.append(swept)
        seen = swept.groupBy("part", "kind").agg(F.count(F.lit(1)).alias("n"), F.min("size").alias("least"), F.max("size").alias("most")).collect()  # four rows per range
        at = {(r["part"], r["kind"]): r for r in seen}
        count = lambda part, kind: at[part, kind]["n"] if (part, kind) in at else 0
        ranges = [(part, count(part, WAITS), at[part, WAITS]["most"] if count(part, WAITS) else 0, count(part, FREE), at[part, FREE]["least"] if count(part, FREE) else 0) for part in {p for p, _ in at}]
        meets = carry(ranges)
        left_over = [(part, first) for part, first, _, q, *_ in meets if q < 0]
        used = max((r["most"] for r in seen if r["kind"] == USED), default=0)
        again = bool(left_over) and used >= min(at[part, WAITS]["least"] for part, _ in left_over)
        if again:
            meets = [m for m in meets if m[3] >= 0]
        units = _units(swept, meets)
        met = materialize(_meet(units, tasks, capacity, turn), "meet") if meets else None
        turn += 1
        gaps = swept.where(F.col("kind") == USED).union(units.where((F.col("unit") < 0) & (F.col("kind") == FREE)).select(NAMES))
        if met is not None:
            placed.append(met)
            gaps = gaps.union(met.where(F.col("kind") <= USED))
        gaps = gaps.withColumn("kind", F.lit(FREE))
        if not again:
            return placed, gaps, turn
        waiting = units.where((F.col("unit") < 0) & (F.col("kind") == WAITS)).select(NAMES)


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id and offset."""
    pieces = materialize(cut(docs, path, capacity), "pieces")
    return place(pieces, capacity)


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (doc_id, piece, start, length, ids_crc32; a written table) with sequence_id and offset."""
    none = F.lit(0).cast("long")
    row = lambda kind, size, sequence: [F.lit(kind).alias("kind"), F.col(size).alias("size"), "doc_id", "piece", "start", "ids_crc32", sequence.alias("sequence_id"), none.alias("offset"), none.alias("part"), none.alias("rank")]
    large = materialize(pieces.where(2 * F.col("length") > capacity).select(*row(PLACED, "length", F.monotonically_increasing_id())), "large")
    nothing = [F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("int").alias("piece"), F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("ids_crc32")]
    gaps = large.where(F.col("size") < capacity).select(F.lit(FREE).alias("kind"), (F.lit(capacity) - F.col("size")).alias("size"), *nothing, "sequence_id", "offset", "part", "rank")
    bounds = [capacity // 2]
    while bounds[-1] > SMALL:
        bounds.append(bounds[-1] // 2)
    bounds[-1] = 0
    inside = [F.count(F.when((F.col("length") <= high) & (F.col("length") > low), 1)) for high, low in zip(bounds, bounds[1:])]
    total, *counts = pieces.agg(F.count(F.lit(1)), *inside).first()
    tasks = -(-total // RANGE_ROWS)
    placed, turn = [large], 1
    for high, low, n in zip(bounds, bounds[1:], counts):
        if n:
            waiting = pieces.where((F.col("length") <= high) & (F.col("length") > low)).select(*row(WAITS, "length", none))
            small = gaps.where(F.col("size") <= low)
            done, gaps, turn = _place_class(waiting, gaps.where(F.col("size") > low), tasks, capacity, turn)
            placed += done
            gaps = gaps.union(small)
    out = placed[0]
    for more in placed[1:]:
        out = out.union(more)
    return out.where(F.col("kind") == PLACED).select("doc_id", "piece", "start", F.col("size").alias("length"), "ids_crc32", "sequence_id", "offset")
