"""Near-duplicate detection with BagMinHash signatures, bands, and verified multiset overlap.

A text is the multiset of its runs of five words.  BagMinHash gives each such run a
hierarchy of Poisson processes, one for each doubling interval of its weight
(0 to 1, 1 to 2, 2 to 4, ...), which throw points (a time, one of M registers, a
weight level); a text sees the points whose level lies below the run's count in it.
A register keeps the time of its first point; two texts agree in a register with the
probability of their weighted Jaccard similarity, min over max of the counts.

Equal texts are one node.  Two texts are linked if they share a band of registers, their
signatures agree in a share LOOSE of all registers, and the exact overlap of their
multisets reaches the threshold; classes are the components of the links.  This rule is
the same for clusters of every size; what follows only says who meets whom.
The work is arranged in groups that no task meets as a whole:

* Texts of a band's bucket are joined to loose clusters: by signatures if they are few,
  by one star if they are many.  Pairs are only ever looked for inside a cluster.
* A cluster is dealt in blocks of VERIFY texts, and each block's texts are linked by the
  rule.  One text of each class so found goes on to the next turn, until one block holds
  what is left of a cluster or turns find nothing more.
* What a large cluster then still holds of several classes is compared across classes:
  blocks of the largest class with chunks of the other texts, and chunks with each
  other.  If these chunks are many, the cluster is first split by rare runs: put all
  runs in one order, from rare to frequent; two texts that reach the threshold have one
  of the first fifth of their runs in common, so texts that such runs don't connect
  needn't meet.  What all texts of a template share comes last in that order, so it
  connects nothing.  If a part still has many chunks, it is split by bands, one of
  which every linked pair shares.  Neither split loses a pair.
* Blocks and chunks are bounded by their texts and by their runs of words.

Edge cases: null texts and texts without words are classes of their own; a text of
one to four words is one run; repeated rows belong to one class; a class is named by
its least doc_id (null ids are passed over, and the class of null ids alone is
null); an empty table gives an empty result; other columns are ignored, or kept by
``keep_one``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, pieces_of, unused
from .components import components

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 25, 5
M = BANDS * ROWS
#: Signatures that agree in fewer registers are not looked at: four deviations below the threshold.
LOOSE = 0.66
#: Texts of a bucket that are compared with each other at once; larger buckets are compared block by block.
BLOCK = 256
#: Texts, and runs of words, that one task verifies at once (by the average of a cluster's texts).
VERIFY, MOST_RUNS = 128, 4_000_000
#: A group is compared across its classes if what isn't in its largest class makes at most so many chunks; else it is split first.
MOST_CHUNKS = 25
#: Counters of how many texts have a run; runs that fall into one counter are ordered as if they were one.
COUNTERS = 1 << 18
HAS_WORD = r"[^\x20\x09-\x0D]"

_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_LETTERS = np.random.default_rng(2018).integers(0, 2**64, 256, np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Well mixed 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2 ** 64."""
    base = 0x5851F42D4C957F2D
    powers = [np.full(1 << bits, b, np.uint64) for b in (base, pow(base, -1, 2**64))]
    for p in powers:
        p[0] = 1
        np.cumprod(p, out=p)
    return powers[0], powers[1]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, and where each text's words end."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    power, inverse = _powers(max(16, (len(data) + 1).bit_length()))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_LETTERS[data] * power[: len(data)], out=sums[1:])
    white = _WHITE[data]
    before = np.r_[True, white[:-1]]
    starts, ends = np.flatnonzero(before & ~white), np.flatnonzero(~before & white)
    hashes = mix((sums[ends] - sums[starts]) * inverse[starts])
    text_ends = np.cumsum([len(t) + 1 for t in texts])
    return hashes, np.searchsorted(starts, text_ends)


def bags(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's runs of words as sorted distinct hashes, their counts, and where each text's entries end."""
    words, ends = word_hashes(texts)
    n = len(words)
    runs = np.zeros(n, np.uint64)
    if n >= WORDS:
        some = words[: n - WORDS + 1].copy()
        for k in range(1, WORDS):
            some = mix(some * _STEP + words[k : n - WORDS + 1 + k])
        runs[: len(some)] = some
    parts, counts, sizes, start = [], [], np.zeros(len(texts), np.int64), 0
    for i, end in enumerate(ends.tolist()):
        if end - start >= WORDS:
            own = np.sort(runs[start : end - WORDS + 1])
            first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            parts.append(own[first])
            counts.append(np.diff(first, append=len(own)))
            sizes[i] = len(first)
        elif end > start:
            short = words[start : start + 1]
            for k in range(start + 1, end):
                short = mix(short * _STEP + words[k : k + 1])
            parts.append(short)
            counts.append(np.ones(1, np.int64))
            sizes[i] = 1
        start = end
    return np.concatenate(parts or [np.zeros(0, np.uint64)]), np.concatenate(counts or [np.zeros(0, np.int64)]), np.cumsum(sizes)


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def signatures(keys: np.ndarray, counts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The times in the M registers of each bag (as bags() gives them); infinite for an empty bag.

    The points of each process come in order of time, for all processes at once; a bag
    asks for points up to a time by which its registers have probably all been hit,
    and for later ones if some have not.
    """
    sizes = np.diff(ends, prepend=0)
    owner = np.repeat(np.arange(len(ends)), sizes)
    total = np.bincount(owner, counts, len(ends))
    depth = np.ceil(np.log2(counts)).astype(np.int64) if len(counts) else counts
    source = np.repeat(np.arange(len(keys)), depth + 1)
    level = np.arange(len(source)) - np.repeat(np.cumsum(depth + 1) - depth - 1, depth + 1)
    low = np.where(level == 0, 0.0, 2.0 ** (level - 1))
    width = np.where(level == 0, 1.0, low)
    seed = mix(keys[source] + level.astype(np.uint64) * _STEP)
    owner, weight = owner[source], counts[source].astype(np.float64)
    until = np.full(len(ends), np.inf)
    until[total > 0] = (np.log(M) + 4) / total[total > 0]
    registers = np.full(len(ends) * M, np.inf)
    clock, time = seed, -np.log(_uniform(mix(seed + _STEP))) / (M * width)
    waiting = np.arange(len(source))
    late: list[tuple] = []
    while True:
        live = time <= until[owner[waiting]]
        late.append((waiting[~live], clock[~live], time[~live]))
        waiting, clock, time = waiting[live], clock[live], time[live]
        if not len(waiting):
            unfilled = np.isinf(registers.reshape(len(ends), M)).any(axis=1) & (total > 0)
            if not unfilled.any():
                break
            until[unfilled] *= 1.5
            waiting, clock, time = (np.concatenate(x) for x in zip(*late, strict=True))
            again = unfilled[owner[waiting]]
            waiting, clock, time, late = waiting[again], clock[again], time[again], []
            continue
        clock = mix(clock + _STEP)
        place = mix(clock ^ np.uint64(0xD6E8FEB86659FD93))
        seen = low[waiting] + width[waiting] * _uniform(mix(place + _STEP)) < weight[waiting]
        into = owner[waiting] * M + (place % np.uint64(M)).astype(np.int64)
        np.minimum.at(registers, into[seen], time[seen])
        time = time - np.log(_uniform(mix(clock + _STEP))) / (M * width[waiting])
    return registers.reshape(len(ends), M)


def band_hashes(registers: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each band of registers (and of which band it is)."""
    bits = mix(registers.view(np.uint64)).reshape(len(registers), BANDS, ROWS)
    out = np.broadcast_to(mix(np.arange(1, BANDS + 1).astype(np.uint64) * _STEP), bits.shape[:2]).copy()
    for k in range(ROWS):
        out = mix(out * _STEP + bits[:, :, k])
    return out.view(np.int64)


def short_signatures(registers: np.ndarray) -> np.ndarray:
    """A byte of each register."""
    return (mix(registers.view(np.uint64)) >> np.uint64(56)).astype(np.uint8)


def text_id(text: Column) -> Column:
    return F.unhex(F.md5(F.encode(text, "UTF-8")))


def sign(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, tid (of its text; null without words), n_runs, bands and sig."""
    schema = pa.schema([("doc_id", pa.int64()), ("tid", pa.binary()), ("n_runs", pa.int64()), ("bands", pa.list_(pa.int64())), ("sig", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, 1, 1 << 20):
            texts = [(t or "").encode() for t in batch.column(1).to_pylist()]
            keys, counts, ends = bags(texts)
            registers = signatures(keys, counts, ends)
            size = np.add.reduceat(np.r_[counts, 0], np.r_[0, ends[:-1]]) * (np.diff(ends, prepend=0) > 0)
            some = size > 0
            tids = [hashlib.md5(t).digest() if s else None for t, s in zip(texts, some, strict=True)]
            bands = pa.ListArray.from_arrays(np.arange(0, len(texts) * BANDS + 1, BANDS).astype(np.int32), band_hashes(registers).ravel())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tids, pa.binary()), pa.array(size), bands, pa.array([s.tobytes() for s in short_signatures(registers)], pa.binary())], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, tid binary, n_runs long, bands array<long>, sig binary")


def by_runs(df: DataFrame, keys: list[str], work: Callable, schema: pa.Schema, ddl: str) -> DataFrame:
    """Applies ``work`` to the rows of each group of the ``keys`` (the first columns): rows are dealt and sorted by the keys and stream through the tasks."""
    dealt = df.repartition(*keys).sortWithinPartitions(*keys)
    k = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, rows, out = None, [], []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:k] != group:
                    if len(rows) > 1:
                        out += work(rows)
                    group, rows = row[:k], []
                rows.append(row[k:])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                out = []
        if len(rows) > 1:
            out += work(rows)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return dealt.mapInArrow(run, ddl)


def _roots(root: np.ndarray, alike: Callable[[int], np.ndarray]) -> np.ndarray:
    """Components of items; ``root`` has those known before, alike(i) says which of the items i + 1, ... are linked with i. Items already joined are not asked for."""
    for i in range(len(root) - 1):
        if (root[i + 1 :] != root[i]).any():
            linked = root[i + 1 :][alike(i)]
            if len(linked):
                joined = np.unique(np.r_[linked, root[i]])
                root[np.isin(root, joined)] = joined[0]
    return root


_EDGES, _EDGES_DDL = pa.schema([("a", pa.binary()), ("b", pa.binary())]), "a binary, b binary"


def _forest(rows: list[tuple], root: np.ndarray) -> list[tuple[bytes, bytes]]:
    return [(rows[r][0], rows[i][0]) for i, r in enumerate(root.tolist()) if r != i]


def loose_links(rows: list[tuple]) -> list[tuple[bytes, bytes]]:
    """A spanning forest of the pairs in one block (tid, sig) whose signatures agree enough."""
    sigs = np.frombuffer(b"".join(r[1] for r in rows), np.uint8).reshape(len(rows), M)
    return _forest(rows, _roots(np.arange(len(rows)), lambda i: (sigs[i + 1 :] == sigs[i]).sum(axis=1) >= LOOSE * M))


def verified_links(rows: list[tuple]) -> list[tuple[bytes, bytes]]:
    """The links in one unit (tid, text, bands, sig, c) that join what isn't joined yet, ``c`` being the class of a text so far."""
    rows = sorted({r[0]: r for r in rows}.values(), key=lambda r: r[0])  # so that links are stars around least nodes
    bands = np.array([r[2] for r in rows], np.int64)
    sigs = np.frombuffer(b"".join(r[3] for r in rows), np.uint8).reshape(len(rows), M)
    keys, counts, ends = bags([r[1].encode() for r in rows])
    starts, total = np.r_[0, ends[:-1]], np.add.reduceat(counts, np.r_[0, ends[:-1]])
    names, ids = np.unique(keys, return_inverse=True)
    own = np.zeros(len(names), np.int64)
    first: dict[bytes, int] = {}
    before = np.array([first.setdefault(r[4], i) for i, r in enumerate(rows)])
    root = before.copy()

    def alike(i: int) -> np.ndarray:
        met = (root[i + 1 :] != root[i]) & (bands[i + 1 :] == bands[i]).any(axis=1) & ((sigs[i + 1 :] == sigs[i]).sum(axis=1) >= LOOSE * M)
        if not met.any():
            return met
        mine, at = slice(starts[i], ends[i]), ends[i]
        own[ids[mine]] = counts[mine]
        overlap = np.add.reduceat(np.minimum(own[ids[at:]], counts[at:]), starts[i + 1 :] - at)
        own[ids[mine]] = 0
        return met & (overlap >= THRESHOLD * (total[i] + total[i + 1 :] - overlap) - 1e-9)

    _roots(root, alike)
    return [(rows[r][0], rows[b][0]) for r, b in {(int(root[b]), int(b)) for b in before} if r != b]


def _verify(units: DataFrame, clusters: DataFrame) -> DataFrame:
    """Links between the texts of each unit. ``units``: unit, tid, c; ``clusters``: tid, text, bands, sig."""
    # merged at every size, as both sides grow with the corpus and a plan that broadcasts one only while it is small says nothing about larger ones
    rows = units.join(clusters.select("tid", "text", "bands", "sig").hint("merge"), "tid")
    return by_runs(rows.select("unit", "tid", "text", "bands", "sig", "c"), ["unit"], verified_links, _EDGES, _EDGES_DDL)


def _parts(n: Column, runs: Column) -> Column:
    """Into how many parts so many texts, of so many runs together, are dealt."""
    return F.greatest(F.ceil(n / VERIFY), F.ceil(runs / MOST_RUNS)).cast("long")


def _numbers(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<long>"))


def items(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Each text's bag as a set, of hashes of a run and of which time it occurs, and where each text's entries end."""
    keys, counts, ends = bags(texts)
    until = np.cumsum(counts)
    which = np.arange(counts.sum()) - np.repeat(until - counts, counts)
    return mix(np.repeat(keys, counts) + mix(which.astype(np.uint64) + _STEP)), np.r_[0, until][ends]


def rare_items(texts: list[bytes], frequency: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first items of each text, by frequency and then by hash, and where each text's entries end.

    So many that two texts with an overlap of THRESHOLD or more have one of them in
    common: texts of n items share ceil(THRESHOLD * n) of them at least, and the first
    of these, in the common order, is among the first n - ceil(THRESHOLD * n) + 1.
    """
    found, ends = items(texts)
    n = np.diff(ends, prepend=0)
    first = np.where(n > 0, n - np.ceil(THRESHOLD * n - 1e-9).astype(np.int64) + 1, 0)
    owner = np.repeat(np.arange(len(n)), n)
    ordered = found[np.lexsort((found, frequency[(found % np.uint64(COUNTERS)).astype(np.int64)], owner))]
    return ordered[np.arange(len(found)) - np.repeat(ends - n, n) < np.repeat(first, n)], np.cumsum(first)


def _frequency(texts: DataFrame) -> np.ndarray:
    """In how many texts the items of each counter occur, as COUNTERS numbers. ``texts``: text."""
    schema = pa.schema([("at", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(COUNTERS, np.int64)
        for batch in pieces_of(batches, 0, 1 << 20):
            found, _ = items([t.encode() for t in batch.column(0).to_pylist()])
            seen += np.bincount((found % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], schema=schema)

    out = np.zeros(COUNTERS, np.int64)
    for at, n in texts.mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n")).collect():
        out[at] = n
    return out


def _by_rare_runs(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """The rows in smaller groups: texts of a group that rare runs connect with another class. Every text is in one group."""
    frequency = _frequency(texts.select("text"))
    schema = pa.schema([("grp", pa.int64()), ("tid", pa.binary()), ("c", pa.binary()), ("item", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, 3, 1 << 20):
            found, ends = rare_items([t.encode() for t in batch.column(3).to_pylist()], frequency)
            each = pa.array(np.repeat(np.arange(batch.num_rows), np.diff(ends, prepend=0)))
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(each) for k in range(3)), pa.array(found.view(np.int64))], schema=schema)

    asked = rows.join(texts.select("tid", "text").hint("merge"), "tid").select("grp", "tid", "c", "text")
    rare = materialize(asked.mapInArrow(run, "grp long, tid binary, c binary, item long"), "rare")
    shared = rare.groupBy("grp", "item").agg(F.min("tid").alias("a"), F.min("c").alias("least"), F.max("c").alias("most")).where("least < most")
    edges = rare.join(shared, ["grp", "item"]).where("a < tid").select("a", F.col("tid").alias("b")).distinct()
    part = components(edges)
    part = materialize(part.union(part.select(F.col("root").alias("node"), "root").distinct()), "parts")
    discard(rare)
    return rows.join(part, rows["tid"] == part["node"]).select(F.xxhash64("root").alias("grp"), "tid", "c", "n_runs")


def _by_bands(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """The rows in smaller groups: the buckets of each band."""
    split = rows.join(texts.select("tid", "bands"), "tid").select("grp", "tid", "c", "n_runs", F.explode("bands").alias("value"))
    return split.select(F.xxhash64("grp", "value").alias("grp"), "tid", "c", "n_runs")


def _across(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """Units (unit, tid, c) in which the texts of different classes of a group meet. ``rows``: grp, tid, c, n_runs; ``texts``: tid, text, bands."""
    units, splits = [], (_by_rare_runs, _by_bands)
    for depth in range(len(splits) + 1):
        classes_of = rows.groupBy("grp", "c").agg(F.count(F.lit(1)).alias("k"), F.sum("n_runs").alias("r"))
        main = F.max(F.struct("k", "c", "r"))
        groups = classes_of.groupBy("grp").agg(F.sum("k").alias("n"), F.sum("r").alias("runs"), main.alias("main"), F.count(F.lit(1)).alias("classes")).where("classes > 1")
        groups = groups.withColumns({"blocks": _parts(F.col("main.k"), F.col("main.r")), "chunks": _parts(F.col("n") - F.col("main.k"), F.col("runs") - F.col("main.r")), "alone": _parts(F.col("n"), F.col("runs")) == 1})
        groups = materialize(groups.select("grp", "alone", F.col("main.c").alias("main"), "blocks", "chunks", (F.col("alone") | (F.col("chunks") <= MOST_CHUNKS) | (F.lit(depth) == len(splits))).alias("direct")), "groups")
        met = rows.join(groups, "grp")
        part = lambda n: F.pmod(F.xxhash64("tid"), n)
        mine = part(F.col("chunks"))
        blocks, chunks = _numbers(F.col("blocks")), _numbers(F.col("chunks"))
        of_main = F.transform(chunks, lambda y: F.struct(part(F.col("blocks")).alias("x"), y.alias("y")))
        of_others = F.concat(F.transform(blocks, lambda x: F.struct(x.alias("x"), mine.alias("y"))), F.transform(chunks, lambda y: F.struct((-1 - F.least(y, mine)).alias("x"), F.greatest(y, mine).alias("y"))))
        alone = F.array(F.struct(F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y")))
        places = F.when(F.col("alone"), alone).when(F.col("c") == F.col("main"), of_main).otherwise(of_others)
        units.append(met.where("direct").select("grp", "tid", "c", F.explode_outer(places).alias("at")).select(F.xxhash64(F.lit(depth), "grp", "at.x", "at.y").alias("unit"), "tid", "c"))
        if groups.where("NOT direct").isEmpty():
            break
        rows = materialize(splits[depth](met.where("NOT direct").select("grp", "tid", "c", "n_runs"), texts), "split")
    out = units[0]
    for more in units[1:]:
        out = out.union(more)
    return out


def _large_clusters(large: DataFrame, links: DataFrame, clusters: DataFrame) -> DataFrame:
    """All links of the clusters of several blocks (large: tid, root, n_runs); ``links`` are those inside the blocks."""
    found = materialize(links.join(large.select(F.col("tid").alias("a")), "a", "left_semi"), "links")

    def so_far() -> DataFrame:
        known = components(found).withColumnRenamed("root", "c")
        return materialize(large.join(known, large["tid"] == known["node"], "left").select("root", "tid", "n_runs", F.coalesce("c", "tid").alias("c")), "classes")

    turn = 0
    while True:
        turn += 1
        now = so_far()
        one = now.groupBy("root", "c").agg(F.min(F.struct("tid", "n_runs")).alias("one")).select("root", "c", "one.*")
        several = one.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.sum("n_runs").alias("runs")).where("n > 1")
        asked = materialize(one.join(several, "root"), "asked")
        total = asked.count()
        block = F.pmod(F.xxhash64("tid", F.lit(turn)), _parts(F.col("n"), F.col("runs")))
        more = materialize(_verify(asked.select(F.xxhash64("root", block).alias("unit"), "tid", "c"), clusters), "links")
        discard(asked)
        new = more.count()
        found = found.union(more)
        if 10 * new <= total:  # most of these texts differ: what is left is compared across classes
            break
        discard(now)
    if new:
        now = so_far()
    units = _across(now.select(F.xxhash64("root").alias("grp"), "tid", "c", "n_runs"), clusters)
    return found.union(materialize(_verify(units, clusters), "links"))


def classes(signed: DataFrame, docs: DataFrame) -> DataFrame:
    """tid, first_id, class_id and root of every distinct text with words. ``signed``: sign(docs), materialised."""
    texts = materialize(signed.where("tid IS NOT NULL").groupBy("tid").agg(F.min("doc_id").alias("first_id"), F.first("n_runs").alias("n_runs"), F.first("bands").alias("bands"), F.first("sig").alias("sig")), "texts")
    found = texts.select(F.explode_outer("bands").alias("bucket"), "tid")
    full = found.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("tid").alias("first")).where("n > 1")
    members = materialize(found.join(full, "bucket"), "members")
    few = members.where(F.col("n") <= BLOCK).select("bucket", "tid").join(texts.select("tid", "sig"), "tid").select("bucket", "tid", "sig")
    many = members.where(F.col("n") > BLOCK).select(F.col("first").alias("a"), F.col("tid").alias("b")).distinct()
    cluster = components(by_runs(few, ["bucket"], loose_links, _EDGES, _EDGES_DDL).union(many))
    roots = cluster.select(F.col("root").alias("node"), "root").distinct()
    wanted = cluster.union(roots).withColumnRenamed("node", "tid").join(texts, "tid").withColumn("rk", F.xxhash64("first_id")).drop("first_id")
    # joined by doc_id too: many copies of one text spread, and one of them is found; texts of clusters are looked up once
    whole = docs.select(text_id(F.col("text")).alias("tid"), F.xxhash64(F.col("doc_id").cast("long")).alias("rk"), "text").hint("merge")
    clusters = materialize(wanted.join(whole, ["tid", "rk"]).dropDuplicates(["tid", "rk"]), "clusters")
    sizes = clusters.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.sum("n_runs").alias("runs"))
    sizes = sizes.select("root", _parts(F.col("n"), F.col("runs")).alias("blocks"))
    dealt = materialize(clusters.select("tid", "root", "n_runs").join(sizes, "root"), "dealt")
    unit = F.xxhash64("root", F.pmod(F.xxhash64("tid"), F.col("blocks")))
    links = materialize(_verify(dealt.select(unit.alias("unit"), "tid", F.col("tid").alias("c")), clusters), "links")
    large = dealt.where("blocks > 1").select("tid", "root", "n_runs")
    if large.isEmpty():
        label = links.select(F.col("b").alias("tid"), F.col("a").alias("root"))
    else:
        label = components(links.union(_large_clusters(materialize(large, "large"), links, clusters))).withColumnRenamed("node", "tid")
    named = materialize(texts.select("tid", "first_id").join(label, "tid", "left").withColumn("root", F.coalesce("root", "tid")), "named")
    discard(texts, members, clusters, dealt)
    least = named.groupBy("root").agg(F.min("first_id").alias("class_id"))
    return named.join(least, "root").select("tid", "first_id", "class_id", "root")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, class_id and kept (whether the class is named by it)."""
    signed = materialize(sign(docs), "signed")
    found = classes(signed, docs).select("tid", "class_id")
    out = signed.select("doc_id", "tid").join(found, "tid", "left")
    named = F.when(F.col("tid").isNull(), F.col("doc_id")).otherwise(F.col("class_id"))
    return out.select("doc_id", named.alias("class_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")))


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents (all their columns) without words, and of each class one row with its least doc_id."""
    signed = materialize(sign(docs), "signed")
    first = classes(signed, docs).where(F.col("first_id").eqNullSafe(F.col("class_id")))
    # several texts can share the class's doc_id; the least of them stands for the class
    tid, rk = unused(docs, "text_tid"), unused(docs, "text_rk")
    winner = first.groupBy("root").agg(F.min(F.struct("first_id", "tid")).alias("w")).select(F.col("w.tid").alias(tid), F.xxhash64("w.first_id").alias(rk))
    keyed = docs.withColumns({tid: text_id(F.col("text")), rk: F.xxhash64(F.col("doc_id").cast("long"))})
    worded = F.coalesce(F.col("text"), F.lit("")).rlike(HAS_WORD)
    one = keyed.where(worded).hint("merge").join(winner, [tid, rk], "left_semi").dropDuplicates([tid, rk])
    return one.select(docs.columns).union(docs.where(~worded))
