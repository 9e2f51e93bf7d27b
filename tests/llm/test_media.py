import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspan.llm import media as m


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=900))
def test_round_trip(data):
    padded = m.pad(data)
    assert len(padded) % 64 == 0 and len(padded) >= max(1, len(data))
    samples = np.frombuffer(padded, np.uint8).reshape(-1, 64)
    assert (m.decode_png(m.encode_png(samples)) == samples).all()


def filtered(rows, kinds):
    """Filters rows one pixel at a time, by the definition."""
    out = bytearray()
    for y, kind in enumerate(kinds):
        out.append(kind)
        for x in range(rows.shape[1]):
            a = int(rows[y, x - 1]) if x else 0
            b = int(rows[y - 1, x]) if y else 0
            c = int(rows[y - 1, x - 1]) if x and y else 0
            p = a + b - c
            paeth = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            out.append((int(rows[y, x]) - (0, a, b, (a + b) // 2, paeth)[kind]) % 256)
    return bytes(out)


def test_all_filters_are_undone():
    rows = np.random.default_rng(0).integers(0, 256, (25, 64)).astype(np.uint8)
    lines = filtered(rows, [(y * 7) % 5 for y in range(25)])
    data = m.SIGNATURE + m.chunk(b"IHDR", struct.pack(">IIBBBBB", 64, 25, 8, 0, 0, 0, 0)) + m.chunk(b"IDAT", zlib.compress(lines)[:9]) + m.chunk(b"IDAT", zlib.compress(lines)[9:]) + m.chunk(b"IEND", b"")
    assert (m.decode_png(data) == rows).all()


def test_damage_is_found():
    png = m.encode_png(np.arange(640, dtype=np.uint8).reshape(10, 64))
    for bad in (png[:-1], png[:40] + bytes([png[40] ^ 1]) + png[41:], b"x" + png[1:], png[:-12]):
        with pytest.raises(ValueError):
            m.decode_png(bad)


def test_hash_ignores_small_changes_of_brightness():
    r = np.random.default_rng(1)
    image = np.kron(r.integers(40, 200, (8, 8)), np.ones((16, 8))).astype(np.uint8)
    near = (image + r.integers(0, 3, image.shape)).astype(np.uint8)
    a, b, c = (int(m.cosine_hash(x), 16) for x in (image, near, image[::-1]))
    assert (a ^ b).bit_count() < 8 < (a ^ c).bit_count()


def test_query_against_plain_digests(edge_docs, no_docs, edge_rows):
    import hashlib

    rows = m.media(edge_docs).collect()
    want = sorted(hashlib.sha256(m.pad((r[1] or "").encode())).hexdigest() for r in edge_rows)
    assert sorted(r.payload_sha256 for r in rows) == want
    tails = sorted(zlib.crc32(m.pad((r[1] or "").encode())[-64:]) for r in edge_rows)
    assert sorted(r.tail_crc32 for r in rows) == tails
    assert len({(r.media_sha256, r.feature) for r in rows if r.doc_id in (1, 2)}) == 1
    assert m.media(no_docs).count() == 0
