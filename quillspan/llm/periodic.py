"""Runs of words: maximal periodic stretches of a text, found with a suffix automaton.

A run is a maximal stretch of words with smallest period q that is at least
``EXPONENT`` periods and ``SHORTEST`` words long.  In the tree of suffix links of a
text's automaton a state's end positions are the union of those of its children; the
ordered sets are merged small into large, and two ends that become neighbours at a
distance d in a state of length at least (EXPONENT - 1) * d are the seed of a square
of period d, that lies in a run: ``Automaton.seeds``.  Seeds are extended to both
sides as far as words d apart are equal, and a stretch that has a smaller period as
well is left out.

A run with period q beyond its first q words is a stretch of at least
(EXPONENT - 1) * q words each of which last occurred at most q words before.
``stretches`` finds all places where that can be (in numpy, for many texts at once),
and the automaton reads only those, with the words before them.  The rest of a text,
all of it in most prose, holds no run.

Edge cases: a null text has no words; equal texts give equal results unless their ids
differ in h; a null doc_id counts as the empty text in h; texts of any length are read
whole (the automaton takes about 200 bytes for each word of the stretches it reads);
repeated rows give repeated results; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import zlib
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces_of

EXPONENT, SHORTEST = 4, 6
#: Positions in one block of an ordered set.
BLOCK = 512


class Ends:
    """An ordered set of positions in blocks, so that adding one moves few others."""

    __slots__ = ("blocks", "firsts", "size")

    def __init__(self, position: int):
        self.blocks, self.firsts, self.size = [[position]], [position], 1

    def add(self, position: int) -> tuple[int | None, int | None]:
        """Adds a position that isn't there yet; returns its neighbours."""
        firsts = self.firsts
        at = bisect_right(firsts, position) - 1
        if at < 0:
            after = firsts[0]
            self.blocks[0].insert(0, position)
            firsts[0] = position
            before, at = None, 0
        else:
            block = self.blocks[at]
            place = bisect_left(block, position)
            before = block[place - 1]
            after = block[place] if place < len(block) else firsts[at + 1] if at + 1 < len(firsts) else None
            block.insert(place, position)
        self.size += 1
        if len(self.blocks[at]) > BLOCK:
            block = self.blocks[at]
            self.blocks[at : at + 1] = [block[: BLOCK // 2], block[BLOCK // 2 :]]
            firsts.insert(at + 1, block[BLOCK // 2])
        return before, after

    def __iter__(self) -> Iterator[int]:
        for block in self.blocks:
            yield from block


class Automaton:
    """The suffix automaton of a list of symbols.

    Most states have one transition, which lies in ``symbol`` and ``target``; further
    ones are in ``more``, by state.
    """

    def __init__(self, symbols: list[int]):
        self.length, self.link = array("q", [0]), array("q", [-1])
        self.symbol, self.target = array("q", [-1]), array("q", [-1])
        self.more: dict[int, dict[int, int]] = {}
        self.prefix = array("q")  # the state of each prefix
        last = 0
        for c in symbols:
            last = self.extend(last, c)
            self.prefix.append(last)

    def state(self, length: int) -> int:
        self.length.append(length)
        self.link.append(0)
        self.symbol.append(-1)
        self.target.append(-1)
        return len(self.length) - 1

    def extend(self, last: int, c: int) -> int:
        length, link, symbol, target, more = self.length, self.link, self.symbol, self.target, self.more
        new = self.state(length[last] + 1)
        p, q = last, -1
        while p >= 0:
            if symbol[p] == c:
                q = target[p]
                break
            if symbol[p] < 0:
                symbol[p], target[p] = c, new
            else:
                others = more.get(p)
                if others is None:
                    more[p] = {c: new}
                elif c in others:
                    q = others[c]
                    break
                else:
                    others[c] = new
            p = link[p]
        if q < 0:
            return new
        if length[q] == length[p] + 1:
            link[new] = q
            return new
        copy = self.state(length[p] + 1)
        symbol[copy], target[copy], link[copy] = symbol[q], target[q], link[q]
        if q in more:
            more[copy] = dict(more[q])
        while p >= 0:
            if symbol[p] == c:
                if target[p] != q:
                    break
                target[p] = copy
            else:
                others = more[p]
                if others[c] != q:
                    break
                others[c] = copy
            p = link[p]
        link[q] = link[new] = copy
        return new

    def seeds(self) -> Iterator[tuple[int, int, int]]:
        """(end, distance, length) of new neighbours: the symbols end - distance - length + 1 to end have that period.

        States are taken from the longest to the shortest, so a state's set is whole
        when it is merged into that of its link.
        """
        ends: list[Ends | None] = [None] * len(self.length)
        for position, state in enumerate(self.prefix):
            ends[state] = Ends(position)
        length, least = self.length, EXPONENT - 1
        for state in sorted(range(1, len(length)), key=length.__getitem__, reverse=True):
            above, own = self.link[state], ends[state]
            ends[state] = None
            if above <= 0 or own is None:
                continue
            large = ends[above]
            if large is None:
                ends[above] = own
                continue
            if large.size < own.size:
                large, own = own, large
            ends[above] = large
            shared = length[above]
            for position in own:
                before, after = large.add(position)
                if before is not None and (position - before) * least <= shared:
                    yield position, position - before, shared
                if after is not None and (after - position) * least <= shared:
                    yield after, after - position, shared


def extended(ids: np.ndarray, at: int, distance: int, step: int) -> int:
    """The last place from ``at`` on, in steps of 1 or -1, up to which ids ``distance`` apart (the other is before) are equal; ``at - step`` if not even there."""
    n, size = len(ids), 16
    while True:
        if step > 0:
            stop = min(n, at + size)
            differ = ids[at:stop] != ids[at - distance : stop - distance]
        else:
            stop = max(distance - 1, at - size)
            differ = ids[at:stop:-1] != ids[at - distance : stop - distance if stop >= distance else None : -1]
        if differ.any():
            return at + step * (int(differ.argmax()) - 1)
        at = stop
        if at == (n if step > 0 else distance - 1):
            return at - step
        size *= 2


def runs_in(ids: np.ndarray, places: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of the ids that lie in one of ``places`` (from, to), in order."""
    found: dict[int, list[tuple[int, int]]] = {}  # by period: from and to, sorted
    for a, b in places:
        known: dict[int, int] = {}
        symbols = [known.setdefault(x, len(known)) for x in ids[a:b].tolist()]
        for end, d, shared in Automaton(symbols).seeds():
            end += a
            have = found.setdefault(d, [])
            at = bisect_right(have, (end, len(ids))) - 1
            if at >= 0 and have[at][1] > end and have[at][0] <= end - d - shared + 1:
                continue
            start = extended(ids, end - shared + 1, d, -1) - d
            stop = extended(ids, end, d, 1) + 1
            have.insert(bisect_left(have, (start, stop)), (start, stop))
    runs: dict[tuple[int, int], int] = {}  # one stretch has one smallest period
    for d in sorted(found):
        for start, stop in found[d]:
            if stop - start >= max(SHORTEST, EXPONENT * d):
                runs.setdefault((start, stop), d)
    return sorted((start, stop - start, d) for (start, stop), d in runs.items())


def stretches(ids: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int]]:
    """(text, from, to) of all places of many texts in which a run can lie.

    ``ids``: the word ids of all texts one after another; ``first``: where each text
    begins, and the end.  A word fits its stretch if its word last occurred at most a
    (EXPONENT - 1)th of the stretch before; words that don't fit cut it.
    """
    n, count = len(ids), np.diff(first)
    if n < SHORTEST:
        return []
    text = np.repeat(np.arange(len(count)), count)
    key = text * (int(ids.max()) + 1) + ids
    order = np.argsort(key, kind="stable")
    ago = np.full(n, n + 1, np.int64)
    same = key[order[1:]] == key[order[:-1]]
    ago[order[1:][same]] = (order[1:] - order[:-1])[same]
    places, within = np.arange(n), (count // EXPONENT)[text]  # no period is above a fourth of the text
    while True:
        fits = ago[places] <= within
        places = places[fits]
        if not len(places):
            return []
        new = np.flatnonzero((np.diff(places) != 1) | (text[places[1:]] != text[places[:-1]])) + 1
        begin = np.concatenate([[0], new])
        size = np.diff(np.concatenate([begin, [len(places)]]))
        longest = np.where(size >= SHORTEST - 1, size // (EXPONENT - 1), 0)
        if fits.all() and (longest > 0).all():
            break
        within = np.repeat(longest, size)
    start = places[begin]
    owner = text[start]
    low = np.maximum(start - longest, first[owner])
    return list(zip(owner.tolist(), (low - first[owner]).tolist(), (start + size - first[owner]).tolist(), strict=True))


def periodic_tail(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words with those of a tenth of the documents made periodic from some place on (part of the query's input, not of the search)."""
    h = zlib.crc32(b"" if doc_id is None else b"%d" % doc_id)
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    period = words[a : a + p]
    return words[:a] + (period * (-(-(n - a) // len(period))))[: n - a]


def find_runs(texts: list[list[bytes]]) -> list[tuple[np.ndarray, list[tuple[int, int, int]]]]:
    """Word ids, and runs as (start, length, period), of each of many lists of words."""
    known: dict[bytes, int] = {}
    number = known.setdefault
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])
    ids = np.fromiter((number(w, len(known)) for t in texts for w in t), np.int64, int(first[-1]))
    places: dict[int, list[tuple[int, int]]] = {}
    for owner, a, b in stretches(ids, first):
        places.setdefault(owner, []).append((a, b))
    own = [ids[a:b] for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
    return [(x, runs_in(x, places[i]) if i in places else []) for i, x in enumerate(own)]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run has beyond its first period."""
    if not runs:
        return words
    kept = np.ones(len(words), bool)
    for start, length, period in runs:
        kept[start + period : start + length] = False
    return [words[i] for i in np.flatnonzero(kept).tolist()]


FOUND = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
_SCHEMA = pa.schema([*((c, pa.int64()) for c in "doc_id n_runs start length period exponent_milli".split()), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())])


def summary(words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    """The columns of FOUND after doc_id."""
    start, length, period = max(runs, key=lambda r: (r[1], -r[0], -r[2])) if runs else (None, None, None)
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in sorted(runs, key=lambda r: (r[0], r[2])))
    exponent = 1000 * length // period if runs else None
    return len(runs), start, length, period, exponent, sha256(listed.encode()).hexdigest(), sha256(b" ".join(collapsed(words, runs))).hexdigest()


def document_runs(docs: DataFrame) -> DataFrame:
    """Per document: the columns of FOUND."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, 1, 4 << 20):
            ids = batch.column(0).to_pylist()
            texts = [periodic_tail((t or "").encode().split(), i) for i, t in zip(ids, batch.column(1).to_pylist(), strict=True)]
            rows = [(i, *summary(words, runs)) for i, words, (_, runs) in zip(ids, texts, find_runs(texts), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, FOUND)
