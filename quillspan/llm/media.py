"""Media columns: texts as 8-bit greyscale PNG images in binary columns, and hashes of their pixels.

A text's UTF-8 bytes, padded with zero bytes to whole rows of 64, are the samples of
an image 64 pixels wide.  The PNG is written chunk by chunk (zlib data, CRC of each
chunk); reading tests every checksum and undoes the row filters with numpy.  The
feature is a hash of the low frequencies of a cosine transform of the image, reduced
to 32 x 32 means.

Edge cases: a null or empty text is one row of zeros; equal texts give equal values;
repeated rows give repeated results; an empty table gives an empty result; other
columns are ignored.  A damaged image raises ValueError.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, materialize

SIGNATURE = b"\x89PNG\r\n\x1a\n"
WIDTH = 64
LEVEL = 4
STRIPE = 1 << 14  # rows that are filtered or reduced at once


def pad(data: bytes, width: int = WIDTH) -> bytes:
    """The bytes with zeros appended up to a positive multiple of ``width``."""
    return data + bytes(-len(data) % width if data else width)


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(samples: np.ndarray) -> bytes:
    """An 8-bit greyscale PNG of a (height, width) array; each row takes the filter (none, sub, up) of least absolute sum."""
    height, width = samples.shape
    deflate, parts = zlib.compressobj(LEVEL), []
    above = np.zeros((1, width), np.uint8)
    for at in range(0, height, STRIPE):
        rows = samples[at : at + STRIPE]
        left = np.zeros_like(rows)
        left[:, 1:] = rows[:, :-1]
        tried = np.stack([rows, rows - left, rows - np.concatenate([above, rows[:-1]])])
        cost = np.abs(tried.view(np.int8).astype(np.int16)).sum(axis=2)
        best = cost.argmin(axis=0)
        lines = np.empty((len(rows), width + 1), np.uint8)
        lines[:, 0] = best
        lines[:, 1:] = tried[best, np.arange(len(rows))]
        parts.append(deflate.compress(lines.tobytes()))
        above = rows[-1:]
    parts.append(deflate.flush())
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", b"".join(parts)) + chunk(b"IEND", b"")


def chunks_of(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """Kind and content of each chunk; lengths and checksums are tested."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, kind = 8, b""
    while at < len(data):
        if at + 12 > len(data):
            raise ValueError("truncated chunk")
        (size,) = struct.unpack_from(">I", data, at)
        kind, content, end = data[at + 4 : at + 8], data[at + 8 : at + 8 + size], at + 12 + size
        if end > len(data) or struct.unpack_from(">I", data, end - 4)[0] != zlib.crc32(kind + content):
            raise ValueError(f"bad checksum or length of chunk {kind!r}")
        yield kind, content
        at = end
    if kind != b"IEND":
        raise ValueError("no IEND chunk")


def unfilter(lines: np.ndarray) -> np.ndarray:
    """Samples of filtered rows (filter type in column 0) of one byte per pixel.

    Runs of rows with one filter are undone together: sub and up are running sums
    modulo 256; only average and Paeth go pixel by pixel.
    """
    kinds, rows = lines[:, 0], lines[:, 1:].copy()
    if kinds.size and kinds.max() > 4:
        raise ValueError("unknown filter")
    starts = np.flatnonzero(np.r_[True, kinds[1:] != kinds[:-1]]) if len(kinds) else []
    for start, end in zip(starts, np.r_[starts[1:], len(kinds)] if len(kinds) else [], strict=True):
        kind, run = kinds[start], rows[start:end]
        if kind == 1:
            np.cumsum(run, axis=1, dtype=np.uint8, out=run)
        elif kind == 2:
            if start:
                run[0] += rows[start - 1]
            np.cumsum(run, axis=0, dtype=np.uint8, out=run)
        elif kind > 2:
            for y in range(start, end):
                _unfilter_row(int(kind), rows[y], rows[y - 1] if y else np.zeros(rows.shape[1], np.uint8))
    return rows


def _unfilter_row(kind: int, row: np.ndarray, above: np.ndarray) -> None:
    left = corner = 0
    for x, up in enumerate(above.tolist()):
        if kind == 3:
            guess = (left + up) // 2
        else:
            p = left + up - corner
            guess = min((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner))[2]
        left, corner = (int(row[x]) + guess) & 255, up
        row[x] = left


def decode_png(data: bytes) -> np.ndarray:
    """The (height, width) samples of an 8-bit greyscale PNG without interlacing; raises ValueError if anything is wrong."""
    header, packed = b"", []
    for kind, content in chunks_of(data):
        if kind == b"IHDR":
            header = content
        elif kind == b"IDAT":
            packed.append(content)
    if len(header) != 13 or header[8:] != b"\x08\x00\x00\x00\x00":
        raise ValueError("not an 8-bit greyscale PNG")
    width, height = struct.unpack(">II", header[:8])
    try:
        lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8)
    except zlib.error as e:
        raise ValueError(str(e)) from e
    if lines.size != height * (width + 1):
        raise ValueError("wrong number of samples")
    return unfilter(lines.reshape(height, width + 1))


def _cosine(n: int, m: int) -> np.ndarray:
    """The first m rows of the orthonormal cosine transform of n values."""
    basis = np.cos(np.pi * (np.arange(n) + 0.5) * np.arange(m)[:, None] / n) * np.sqrt(2 / n)
    basis[0] /= np.sqrt(2)
    return basis


_BASIS = _cosine(32, 8)


def cosine_hash(samples: np.ndarray) -> str:
    """64 bits, in hex: which of the 8 x 8 lowest frequencies of the 32 x 32 means lie above their median."""
    height, width = samples.shape
    sums = np.add.reduceat(samples, np.arange(32) * width // 32, axis=1, dtype=np.int64) if width >= 32 else samples[:, np.arange(32) * width // 32].astype(np.int64)
    rows = np.arange(32) * height // 32
    if height >= 32:
        sums = np.add.reduceat(sums, rows, axis=0) / np.diff(np.r_[rows, height])[:, None]
    else:
        sums = sums[rows].astype(float)
    low = np.rint(_BASIS @ sums @ _BASIS.T * 1024)  # rounded, so that equal values stay equal
    bits = (low > np.median(low.ravel()[1:])).ravel()
    return np.packbits(bits).tobytes().hex()


_STORED = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])
_FEATURES = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])


def _encode(doc_id, text):
    data = (text or "").encode()
    return doc_id, len(data), encode_png(np.frombuffer(pad(data), np.uint8).reshape(-1, WIDTH))


def store_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the image of each text in the binary column ``media``."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(map_rows(lambda: _encode, _STORED), "doc_id long, n_bytes long, media binary")


def _read(doc_id, n_bytes, media):
    samples = decode_png(media)
    payload = samples.tobytes()
    return doc_id, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), cosine_hash(samples)


def media_features(stored: DataFrame) -> DataFrame:
    """What the stored images hold: sizes, digests of payload and image, and the pixel hash."""
    return stored.select("doc_id", "n_bytes", "media").mapInArrow(map_rows(lambda: _read, _FEATURES, 2), "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def media(docs: DataFrame) -> DataFrame:
    """Writes the images of all texts to the shared folder, reads them back and returns their features."""
    return media_features(materialize(store_media(docs), "media"))
