import base64
import gzip
import hashlib
import random

import pytest

from tidefold.llm.warc import plan_records, read_warc, salvage, write_warc

SCHEMA = "page_id long, url string, html string, payload string, digest string"


def digest(b):
    return base64.b32encode(hashlib.sha1(b).digest()).decode()


def record(i, body, extra=b""):
    block = b"HTTP/1.1 200 OK\r\n\r\n" + body
    head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{i}>\r\nWARC-Payload-Digest: sha1:{digest(body)}\r\nContent-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n" + extra


@pytest.fixture
def pages(spark):
    return lambda rows: spark.createDataFrame([(i, u, h, "x", "y") for i, u, h in rows], SCHEMA)


def test_round_trip(spark, pages, tmp_path):
    rows = [(i, f"http://x/{i}", f"<p>{i % 7} é \r\n\r\nWARC/1.1\r\n</p>") for i in range(50)]
    rows += [(100, None, None), (101, "http://a b\r\nc", ""), (102, "u", "\U0001f600" * 50_000), (None, "n", "<p>only null</p>"), (None, "n", "<p>0 é \r\n\r\nWARC/1.1\r\n</p>")]
    got = read_warc(spark, write_warc(pages(rows), f"file://{tmp_path}/w")).collect()
    assert all(r.kind == "record" for r in got) and len(got) == len(rows)
    best = {}
    for i, _, h in rows:
        best[h or ""] = max(best.get(h or "", -1), -1 if i is None else i)
    by = {r.record_id: r for r in got if r.record_id != "<urn:page:null>"}
    for i, _, h in rows:
        if i is None:
            continue
        r, raw = by[f"<urn:page:{i}>"], (h or "").encode()
        assert (r.payload_bytes, r.digest) == (len(raw), digest(raw))
        first = best[h or ""] == i
        assert r.record_type == ("response" if first else "revisit") and r.refers_to == (None if first else f"<urn:page:{best[h or '']}>")
        if first:
            assert bytes(r.payload) == raw


def test_smaller_payloads_are_responses(pages):
    kinds = {r.page_id: r.record_type for r in plan_records(pages([(1, "", "ab"), (2, "", "ab"), (3, "", "abcdef"), (4, "", "abcdef")]), 5).collect()}
    assert kinds == {1: "response", 2: "response", 3: "revisit", 4: "response"}


def test_empty_table(spark, pages, tmp_path):
    assert read_warc(spark, write_warc(pages([]), f"file://{tmp_path}/e")).collect() == []


def test_salvages_after_damage():
    parts = [record(i, b"body %d" % i * 20) for i in range(6)]
    data = bytearray(b"".join(parts))
    at = len(parts[0]) + len(parts[1]) + len(parts[2])
    data[len(parts[0]) + 150 : len(parts[0]) + 160] = b"\0" * 10  # header or body of record 1
    data[at + 60 : at + 75] = b"?" * 15  # of record 3
    got = list(salvage(bytes(data)))
    assert [r[3]["warc-record-id"] for r in got if r[0] == "record"] == [f"<urn:page:{i}>" for i in (0, 2, 4, 5)]
    gaps = [(r[1], r[2]) for r in got if r[0] == "gap"]
    assert gaps == [(len(parts[0]), len(parts[1])), (at, len(parts[3]))]
    assert sum(r[2] for r in got) == len(data)


def test_truncated_and_garbage():
    data = b"garbage" + record(1, b"x") + record(2, b"y" * 100)[:-30]
    got = list(salvage(data))
    assert [r[0] for r in got] == ["gap", "record", "gap"] and sum(r[2] for r in got) == len(data)
    assert list(salvage(b"")) == [] and [r[0] for r in salvage(b"no archive")] == ["gap"]


def test_gzip_members():
    members = [bytearray(gzip.compress(record(i, b"z%d" % i * 50))) for i in range(4)]
    members[1][len(members[1]) // 2] ^= 0xFF
    data = bytes(b"".join(members))
    got = list(salvage(data))
    assert [r[3]["warc-record-id"] for r in got if r[0] == "record"] == [f"<urn:page:{i}>" for i in (0, 2, 3)]
    assert [(r[1], r[2]) for r in got if r[0] == "gap"] == [(len(members[0]), len(members[1]))]


def found_ids(data):
    return [r[3]["warc-record-id"] for r in salvage(bytes(data)) if r[0] == "record"]


def test_gzip_members_after_a_damaged_start():
    rng = random.Random(1)
    first = bytearray(gzip.compress(record(0, rng.randbytes(6000))))
    first[:5000] = b"\0" * 5000
    data = bytes(first) + b"".join(gzip.compress(record(i, b"z%d" % i * 50)) for i in (1, 2))
    assert found_ids(data) == ["<urn:page:1>", "<urn:page:2>"]
    assert [(r[1], r[2]) for r in salvage(data) if r[0] == "gap"] == [(0, len(first))]


def test_plain_records_with_gzipped_bodies():
    parts = [record(i, gzip.compress(b"body %d" % i * 20)) for i in range(4)]
    assert found_ids(b"".join(parts)) == [f"<urn:page:{i}>" for i in range(4)]
    damaged = bytearray(b"".join(parts))
    damaged[len(parts[0]) + 4] = 0  # the version line of record 1, so that its body's magic is tried
    assert found_ids(damaged) == [f"<urn:page:{i}>" for i in (0, 2, 3)]
    assert [(r[1], r[2]) for r in salvage(bytes(damaged)) if r[0] == "gap"] == [(len(parts[0]), len(parts[1]))]


def test_plain_and_gzipped_records_in_one_archive():
    data = record(0, b"a") + gzip.compress(record(1, b"b") + b"junk" + record(2, b"c")) + record(3, b"d")
    assert found_ids(data) == [f"<urn:page:{i}>" for i in range(4)]


def test_damaged_headers_are_no_records():
    good = record(1, b"x" * 50)
    for old, new in ((b"Payload-Digest", b"Payload\0Digest"), (b"WARC-Record-ID", b"WARC Record ID"), (b"\r\nWARC-Payload", b"\r\tWARC-Payload"), (b"WARC-Record-ID", b"XXXX-Record-ID")):
        data = good.replace(old, new, 1) + record(2, b"y")
        assert found_ids(data) == ["<urn:page:2>"], new
        assert [(r[1], r[2]) for r in salvage(data) if r[0] == "gap"] == [(0, len(data) - len(record(2, b"y")))]


def test_many_members_take_linear_time():
    import time

    def seconds(n):
        data = b"".join(gzip.compress(record(i, b"m" * 90)) for i in range(n))
        began = time.process_time()
        assert sum(r[0] == "record" for r in salvage(data)) == n
        return time.process_time() - began

    assert seconds(10_000) < 20 * max(seconds(1_000), 0.02)


def test_folded_values():
    data = record(1, b"x").replace(b"\r\nWARC-Payload", b"\r\nX-Note: one\r\n  two\r\nWARC-Payload", 1)
    (r,) = salvage(data)
    assert r[0] == "record" and r[3]["x-note"] == "one two"


def test_released_folders_are_gone(spark):
    from tidefold.llm.common import keep, release

    kept = keep(spark.range(3))
    file = kept.inputFiles()[0]
    assert kept.count() == 3 and release(spark) >= 1 and release(spark) == 0
    with pytest.raises(Exception):
        spark.read.parquet(file)
