"""Byte-pair encoding and decoding with a segment tree over the ranks of adjacent pairs.

Reads a ``tokenizers`` JSON file (path given) of the kind: NFC, white space to one
blank, lower case; a splitting pattern of which the matches are kept; bytes as
letters; merges with a suffix at word ends.  Within a word, each leaf of the tree is
the rank of an adjacent pair; the root is the leftmost lowest one.  A merge updates
three leaves, each in logarithmic time, until no pair can be merged.

Edge cases: a null text counts as empty (no ids; the decoded text is empty); special
tokens in a text become their ids; the words of a text are cached in a table of
bounded size, so long texts need no more than their own ids; repeated rows give
repeated results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import unicodedata
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, pieces_of

#: White space as the tokenizer's pattern sees it: unlike str.split(), it leaves \x1c to \x1f alone.
SPACE = "\t-\r \x85\xa0  -     　"
#: Capital letters that the tokenizer lowers and Python's older tables don't: fixed values.
NEWER_CAPITALS = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
#: Ranges of letters and digits that the regex library knows and the tokenizer's older table doesn't: fixed values.
NEWER_LETTERS = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F), (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4),
    (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A),
    (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1), (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6),
    (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6),
    (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4),
    (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
)
NEWER_CAPITALS |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
FIRST_CAPITAL = min(NEWER_CAPITALS)
CACHED_PIECES, CACHED_WORDS = 1 << 18, 1 << 17
#: Words of up to so many letters are merged together, all that have at most 8, 16 or 32 pairs; longer ones alone.
LEAVES = (8, 16, 32)
LONGEST_CACHED = 64
#: Marks that are words of their own wherever they stand behind letters.
MARKS = ".,;:!?"


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 for itself, others from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class Recent:
    """A bounded cache of two generations: when the young one is full it becomes the old one, and the old one goes."""

    def __init__(self, most: int):
        self.most, self.young, self.old, self.long = most, {}, {}, []

    def fill(self, keys: set, learn: Callable[[set], dict]) -> dict:
        """A dictionary that has all of ``keys``, good until the next call; ``learn`` is asked for those that neither generation has."""
        for key in self.long:  # long keys are kept for one call only
            self.young.pop(key, None)
        if len(self.young) >= self.most:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        missing = keys.difference(young)
        known = old.keys() & missing
        young.update(zip(known, map(old.__getitem__, known), strict=True))
        new = missing - known
        if new:
            young.update(learn(new))
        self.long = [key for key in new if isinstance(key, str) and len(key) > LONGEST_CACHED]
        return young


def merge(symbols: list[int], pairs: dict[int, int]) -> list[int]:
    """The symbols after all merges, always the leftmost of the lowest rank first.

    pairs: for two neighbouring symbols a << 20 | b, the merge's rank << 20 | its
    result.  Leaf i of the tree holds rank << shift | i for the pair that starts at i
    (``none`` if it can't be merged), so the least value of all, at the root, is the
    leftmost pair of the lowest rank.
    """
    n = len(symbols)
    shift = n.bit_length()
    none = 1 << (40 + shift)
    size = 1 << (n - 2).bit_length() if n > 2 else 1
    low = [none] * (2 * size)
    made = {}
    for i in range(n - 1):
        found = pairs.get(symbols[i] << 20 | symbols[i + 1])
        if found is not None:
            low[size + i] = found >> 20 << shift | i
            made[i] = found & 0xFFFFF
    if not made:
        return symbols
    for at in range(size - 1, 0, -1):
        x, y = low[2 * at], low[2 * at + 1]
        low[at] = x if x < y else y
    after, before, mask = [*range(1, n + 1)], [*range(-1, n - 1)], (1 << shift) - 1
    while low[1] < none:
        i = low[1] & mask
        j = after[i]
        symbols[i], symbols[j] = made[i], -1
        k = after[i] = after[j]
        changed = [(i, none), (j, none)]
        if k < n:
            before[k] = i
            found = pairs.get(symbols[i] << 20 | symbols[k])
            if found is not None:
                changed[0] = (i, found >> 20 << shift | i)
                made[i] = found & 0xFFFFF
        h = before[i]
        if h >= 0:
            found = pairs.get(symbols[h] << 20 | symbols[i])
            if found is None:
                changed.append((h, none))
            else:
                changed.append((h, found >> 20 << shift | h))
                made[h] = found & 0xFFFFF
        for leaf, value in changed:
            at = size + leaf
            if at >= 2 * size or low[at] == value:
                continue
            low[at] = value
            at >>= 1
            while at:
                x, y = low[2 * at], low[2 * at + 1]
                x = x if x < y else y
                if low[at] == x:
                    break
                low[at] = x
                at >>= 1
    return [s for s in symbols if s >= 0]


class Pairs:
    """Values of mergeable pairs, looked up for whole arrays."""

    def __init__(self, pairs: dict[int, int]):
        self.keys = np.fromiter(sorted(pairs), np.int64, len(pairs))
        self.values = np.fromiter((pairs[k] for k in self.keys.tolist()), np.int64, len(pairs))

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """rank << 20 | result of each pair, -1 where it can't be merged (a symbol of -1 never can)."""
        key = a << 20 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], -1)


def merge_many(symbols: np.ndarray, leaves: int, pairs: Pairs) -> np.ndarray:
    """merge() for many words at once: a tree per row, one merge per row and round.

    symbols: (words, leaves + 1), -1 after a word's end; the same array, with -1 for
    what was merged away, comes back.
    """
    rows, none, shift = len(symbols), np.int64(1) << 50, leaves.bit_length()
    found = np.full((rows, leaves + 1), -1, np.int64)
    found[:, :leaves] = pairs.find(symbols[:, :-1], symbols[:, 1:])
    place = np.arange(leaves, dtype=np.int64)
    tree = np.full((rows, 2 * leaves), none)
    tree[:, leaves:] = np.where(found[:, :leaves] < 0, none, found[:, :leaves] >> 20 << shift | place)
    for at in range(leaves - 1, 0, -1):
        np.minimum(tree[:, 2 * at], tree[:, 2 * at + 1], out=tree[:, at])
    # column leaves + 1 stands for "past the end", of symbol -1
    symbols = np.concatenate([symbols, np.full((rows, 1), -1, np.int64)], axis=1)
    after = np.tile(np.minimum(np.arange(1, leaves + 3), leaves + 1), (rows, 1))
    before = np.tile(np.arange(-1, leaves + 1), (rows, 1))
    live = np.flatnonzero(tree[:, 1] < none)
    while len(live):
        i = tree[live, 1] & ((1 << shift) - 1)
        j = after[live, i]
        k = after[live, j]
        h = before[live, i]
        merged = found[live, i] & 0xFFFFF
        symbols[live, i], symbols[live, j] = merged, -1
        after[live, i], before[live, k] = k, i
        leaf = np.stack([j, i, np.where(h < 0, j, h)])  # without a left neighbour the dead leaf j is set once more
        value = np.full(leaf.shape, -1, np.int64)
        value[1] = pairs.find(merged, symbols[live, k])
        value[2] = np.where(h < 0, -1, pairs.find(symbols[live, h], merged))
        leaf = np.minimum(leaf, leaves)
        found[live, leaf] = value
        inside = np.minimum(leaf, leaves - 1)
        at = leaves + inside
        tree[live, at] = np.where(found[live, inside] < 0, none, found[live, inside] >> 20 << shift | inside)
        while at[0, 0] > 1:
            at >>= 1
            tree[live, at] = np.minimum(tree[live, 2 * at], tree[live, 2 * at + 1])
        live = live[tree[live, 1] < none]
    return symbols


class Bpe:
    """Encoder and decoder for one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        suffix = model["end_of_word_suffix"] or ""
        self.inner, self.last = ([vocab[letter + end] for letter in byte_letters()] for end in ("", suffix))
        self.pairs = {vocab[a] << 20 | vocab[b]: rank << 20 | vocab[a + b] for rank, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in model["merges"])}
        pattern, new = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"], "".join(f"{chr(a)}-{chr(b)}" for a, b in NEWER_LETTERS)
        self.common_split = regex.compile(pattern.replace(r"\s", SPACE))
        # the same, with the newer letters and digits among what is neither
        self.older_split = regex.compile(pattern.replace(r"[^\s\p{L}\p{N}]", rf"(?:[{new}]|[^{SPACE}\p{{L}}\p{{N}}])").replace(r"[\p{L}]+", rf"(?:(?![{new}])\p{{L}})+").replace(r"[\p{N}]", rf"(?![{new}])\p{{N}}"))
        self.newer = regex.compile(f"[{new}]")
        self.capitals = regex.compile("[" + "".join(map(chr, NEWER_CAPITALS)) + "]")
        self.spaces = regex.compile(f"[{SPACE}]+")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        names = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.tokens = [names.get(i) for i in range(max(names) + 1)]
        self.decimal = [str(i) for i in range(len(self.tokens))]
        self.found = Pairs(self.pairs)
        self.pieces, self.words = Recent(CACHED_PIECES), Recent(CACHED_WORDS)

    def split_all(self, pieces: list[str]) -> list[list[str]]:
        """The words of each piece without white space; letters, with a mark behind them or without, are plain to see."""
        newer = self.newer.search("\n".join([p for p in pieces if not p.isascii()]))
        if newer:
            return [(self.older_split if self.newer.search(p) else self.common_split).findall(p) for p in pieces]
        find = self.common_split.findall
        return [[p] if p.isalpha() else [p[:-1], p[-1]] if p[-1] in MARKS and p[:-1].isalpha() else find(p) for p in pieces]

    def add_words(self, words: set[str]) -> dict[str, bytes]:
        """The ids of words, packed as unsigned 32-bit numbers."""
        made: dict[str, bytes] = {}
        by_size: dict[int, list[tuple[str, bytes]]] = {n: [] for n in LEAVES}
        for word in words:
            raw = word.encode()
            size = next((n for n in LEAVES if len(raw) <= n), 0)
            if size:
                by_size[size].append((word, raw))
            else:
                symbols = [self.inner[b] for b in raw]
                symbols[-1] = self.last[raw[-1]]
                made[word] = array("I", merge(symbols, self.pairs)).tobytes()
        inner, last = np.array([*self.inner, -1]), np.array(self.last)
        for size, found in by_size.items():
            for at in range(0, len(found), 1 << 15):
                some = found[at : at + (1 << 15)]
                length = np.fromiter((len(raw) for _, raw in some), np.int64, len(some))
                letters = np.full((len(some), size + 1), 256, np.int64)
                letters[np.arange(size + 1) < length[:, None]] = np.frombuffer(b"".join(raw for _, raw in some), np.uint8)
                symbols = inner[letters]
                symbols[np.arange(len(some)), length - 1] = last[letters[np.arange(len(some)), length - 1]]
                symbols = merge_many(symbols, size, self.found)
                stays = symbols >= 0
                ends = np.cumsum(stays.sum(axis=1)) * 4
                packed = symbols[stays].astype(np.uint32).tobytes()
                start = 0
                for (word, _), end in zip(some, ends.tolist(), strict=True):
                    made[word] = packed[start:end]
                    start = end
        return made

    def learn(self, pieces: set[str | int]) -> dict[str | int, bytes]:
        """The ids of pieces (without white space; a number is an id already)."""
        texts = [p for p in pieces if isinstance(p, str) and p]
        split = dict(zip(texts, self.split_all(texts), strict=True)) | {p: [] for p in pieces if p == ""}
        known = self.words.fill(set(itertools.chain.from_iterable(split.values())), self.add_words)
        made = {p: b"".join(map(known.__getitem__, words)) for p, words in split.items()}
        return made | {p: array("I", [p]).tobytes() for p in pieces if isinstance(p, int)}

    def pieces_of(self, text: str) -> list[str | int]:
        """A text's pieces between white space, lower-case; special tokens as their ids."""
        if self.specials and "<" in text:
            parts = self.specials.split(text)
            if len(parts) > 1:
                return [x for part in parts for x in ([self.special[part]] if part in self.special else self.pieces_of(part))]
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # lower case letter by letter, without final forms
            if np.frombuffer(text.encode("utf-32-le"), "<u4").max() >= FIRST_CAPITAL and self.capitals.search(text):
                text = text.translate(NEWER_CAPITALS)
        text = text.lower()
        if "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text:
            return self.spaces.split(text)
        return text.split()

    def pack_many(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each whole text, packed as unsigned 32-bit numbers in the machine's order."""
        for at in range(0, len(texts), 2048):
            pieces_of = {t: self.pieces_of(t) for t in dict.fromkeys(texts[at : at + 2048])}
            split = [pieces_of[t] for t in texts[at : at + 2048]]
            known = self.pieces.fill(set(itertools.chain.from_iterable(split)), self.learn)
            done: dict[str, bytes] = {}  # equal texts are joined once
            for text, pieces in zip(texts[at : at + 2048], split, strict=True):
                if text not in done:
                    done[text] = b"".join(map(known.__getitem__, pieces))
                yield done[text]

    def pack(self, text: str) -> bytes:
        return next(self.pack_many([text]))

    def encode(self, text: str) -> list[int]:
        return array("I", self.pack(text)).tolist()

    def decode(self, ids: list[int]) -> str:
        """The tokens of the ids, joined by blanks: the file names no decoder that would join them otherwise."""
        tokens = self.tokens
        return " ".join([tokens[i] for i in ids if i < len(tokens)])


@lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    """The vocabulary of a file, read once in each Python process, so that its word cache serves all tasks there."""
    return Bpe(path)


_ENCODED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def _digest(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    bpe = load(path)
    for batch in pieces_of(batches, 1, 4 << 20):
        rows = []
        for packed in bpe.pack_many([t or "" for t in batch.column(1).to_pylist()]):
            ids, decimal = array("I", packed).tolist(), bpe.decimal
            joined = " ".join([decimal[i] for i in ids])
            rows.append((len(ids), hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(bpe.decode(ids).encode()).hexdigest()))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), [*_ENCODED][1:], strict=True))], schema=_ENCODED)


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and the ids of each text as an array column."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches):
        bpe = load(path)
        for batch in pieces_of(batches, 1, 4 << 20):
            ids = [np.frombuffer(p, np.int32) for p in bpe.pack_many([t or "" for t in batch.column(1).to_pylist()])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and the decoded text of each array of ids (null: empty)."""
    schema = pa.schema([("doc_id", pa.int64()), ("decoded", pa.string())])

    def make():
        bpe = load(path)
        return lambda doc_id, ids: (doc_id, bpe.decode(ids or []))

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(map_rows(make, schema), "doc_id long, decoded string")


def bpe_digests(docs: DataFrame, path: str) -> DataFrame:
    """Per document: doc_id, n_tokens, and the digests of its ids and of what they decode to."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lambda batches: _digest(batches, path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
