import hashlib

import pytest

from quillspan.llm import warc as w
from quillspan.llm.common import shared_dir

PAGES = "page_id long, url string, html string, payload string, digest string"


@pytest.fixture(scope="module")
def rows():
    big, other = "é" * 700, "x" * 5000
    out = [(1, "http://a/1", big, None, None), (2, "http://a/2", big, "p", "d"), (5, None, big, "p", "d"), (5, None, big, "p", "d"), (3, "http://a /3", "small", "p", "d"), (4, "u", "small", "p", "d"), (6, "u", None, None, None), (7, "u", "", "p", "d"), (None, "u", other, "p", "d"), (8, "u", other, "p", "d")]
    return out + [(100 + i, f"http://h/{i}", f"page {i} " * (i * 40), "p", "d") for i in range(60)]


def expected(rows):
    out = []
    for page_id, _, html, *_ in rows:
        data = (html or "").encode()
        ids = [r[0] for r in rows if (r[2] or "") == (html or "") and r[0] is not None]
        top = max(ids, default=None)
        again = len(data) >= 1000 and page_id != top
        out.append((page_id, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", top if again else None))
    return sorted(map(str, out))


def test_archive_equals_plain_rules(spark, rows, monkeypatch):
    monkeypatch.setattr(w, "FRAME_BYTES", 4000)
    monkeypatch.setattr(w, "BUNDLE_BYTES", 2000)
    assert sorted(map(str, map(tuple, w.archive(spark.createDataFrame(rows, PAGES)).collect()))) == expected(rows)


def test_hot_and_rare_digests_take_both_joins(spark, rows, monkeypatch):
    from quillspan.llm import common

    monkeypatch.setattr(common, "HOT_KEYS", 2)
    many = rows + [(1000 + i, "u", "z" * 2000, None, None) for i in range(50)] + [(2000 + i, "u", f"{i // 2} " * 900, None, None) for i in range(8)]
    assert sorted(map(str, map(tuple, w.archive(spark.createDataFrame(many, PAGES)).collect()))) == expected(many)


def test_read_back_uses_the_index(spark, rows):
    index = w.write_bundles(w.plan_records(spark.createDataFrame(rows, PAGES)), shared_dir(spark, "warc-test"))
    found = w.read_bundles(index)
    assert found.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    moved = index.withColumn("at", index["at"] + index["size"])
    with pytest.raises(Exception):
        w.read_bundles(moved).collect()


def test_index_finds_single_records(spark, rows):
    index = w.write_bundles(w.plan_records(spark.createDataFrame(rows, PAGES)), shared_dir(spark, "warc-test")).collect()
    assert len(index) == len(rows)
    for r in index[::7]:
        fields, block = w.read_record(r.bundle, r.frame, r["at"], r["size"])
        assert fields["WARC-Record-ID"] == r.record_id
        if fields["WARC-Type"] == "response":
            assert hashlib.sha1(block).hexdigest() == fields["WARC-Payload-Digest"][5:]


def test_bundle_is_plain_zstandard_too(spark, rows, tmp_path):
    import zstandard

    writer = w.BundleWriter(open(tmp_path / "a.zst", "wb"))
    records = [w.format_record(i, "http://x", b"y" * 3 * i, "00", None, False) for i in range(9)]
    for r in records:
        writer.add(r)
        writer.end_frame()
    writer.close()
    data = zstandard.ZstdDecompressor().stream_reader(open(tmp_path / "a.zst", "rb"), read_across_frames=True).read()
    assert data == b"".join(records)


def test_empty_and_damaged(spark):
    assert w.archive(spark.createDataFrame([], PAGES)).count() == 0
    with pytest.raises(ValueError):
        list(w.parse_records(b"garbage"))
