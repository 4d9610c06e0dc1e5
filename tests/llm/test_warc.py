import base64
import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from latentrank.llm import warc
from latentrank.llm.warc import Gap, Record, archived, member, number_in, read_archives, record, resolved, salvage, write_archives


def payload(i):
    return b"<html>" + b"".join(b"%d words, " % (i * j * 7919 % 1000) for j in range(i * 9)) + b"</html>"


def ids(found):
    names = [x.headers["warc-record-id"][10:-1] for x in found if isinstance(x, Record)]
    return [int(x) if x.isdigit() else None for x in names]


def gaps(found):
    return [(x.start, x.end) for x in found if isinstance(x, Gap)]


@pytest.mark.parametrize("zipped", [True, False])
def test_whole_archives_are_read_whole(zipped):
    parts = [record(i, f"http://a/{i}", payload(i)) for i in range(30)]
    parts = [member(p) for p in parts] if zipped else parts
    found = list(salvage(b"".join(parts)))
    assert ids(found) == list(range(30)) and not gaps(found)
    assert [x.payload for x in found] == [payload(i) for i in range(30)]


@pytest.mark.parametrize("zipped", [True, False])
def test_one_damaged_record_costs_no_other(zipped):
    parts = [record(i, f"http://a/{i}", payload(i)) for i in range(12)]
    parts = [member(p) for p in parts] if zipped else parts
    draw = random.Random(5)
    for _ in range(60):
        k = draw.randrange(12)
        begin, size = sum(map(len, parts[:k])), len(parts[k])
        how = draw.choice(["flip", "cut", "insert", "zero"])
        at = draw.randrange(20, size - 8) if zipped else draw.randrange(size - 5)
        body = bytearray(parts[k])
        if how == "flip":
            body[at] ^= 1 << draw.randrange(8)
        elif how == "cut":
            del body[at:]
        elif how == "insert":
            body[at:at] = b"??"
        else:
            body[at : at + 40] = bytes(len(body[at : at + 40]))
        data = b"".join([*parts[:k], bytes(body), *parts[k + 1 :]])
        found = list(salvage(data))
        whole = [i for i in range(12) if i != k]
        others = [x for x in found if not (isinstance(x, Record) and x.start == begin and x.end <= begin + len(body))]
        assert ids(others) == whole, (how, k, at)  # a changed header may still hold, say in the date
        if ids(found) == whole:
            assert gaps(found) == [(begin, begin + len(body))] and [x.payload for x in found if isinstance(x, Record)] == [payload(i) for i in whole]


def test_damaged_members_of_many_records_keep_those_before():
    body = b"".join(record(i, None, payload(i)) for i in range(20))
    zipped = gzip.compress(body, mtime=0)
    assert ids(salvage(zipped)) == list(range(20))
    cut = list(salvage(zipped[: len(zipped) * 3 // 4]))
    assert 3 < len(ids(cut)) < 20 and ids(cut) == list(range(len(ids(cut)))) and gaps(cut) == [(0, len(zipped) * 3 // 4)]
    spoilt = body.replace(payload(4), payload(4)[:-1] + b"?")
    inner = list(salvage(gzip.compress(spoilt, mtime=0)))
    assert ids(inner) == [i for i in range(20) if i != 4] and [x.reason for x in inner if isinstance(x, Gap)] == ["in a member: block digest differs"]


def test_what_is_no_archive_is_one_gap():
    for data in (b"junk" * 100, b"WARC/1.1\r\n", b"\x1f\x8b\x08" * 50, gzip.compress(b"no records here"), b"WARC/1.1\r\nContent-Length: x\r\n\r\n"):
        found = list(salvage(data))
        assert not ids(found) and gaps(found) == [(0, len(data))]
    assert list(salvage(b"")) == []


def test_version_lines_within_payloads_are_not_records():
    trap = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello"
    data = b"".join(member(record(i, None, trap + payload(i))) for i in range(4))
    assert ids(salvage(data)) == [0, 1, 2, 3]


def expected(rows, min_bytes):
    body = {k: [(i, (h or "").encode()) for i, h in rows] for k in (0,)}[0]
    out = []
    for i, b in body:
        same = [j for j, x in body if x == b and j is not None]
        first = min(same, default=None) if len(b) >= min_bytes else None
        revisit = first is not None and i != first
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [1000, 5])
@pytest.mark.parametrize("min_bytes", [0, 10])
def test_pages_come_back(spark, monkeypatch, hot, min_bytes):
    monkeypatch.setattr(warc, "LEAST_HOT", hot)
    texts = [None, "", "a", "a", "é" * 50, "<html>\r\n\r\nWARC/1.1\r\n</html>", "x" * 9, "x" * 10]
    rows = [(i, texts[i % 8] if i % 3 else f"own {i}") for i in range(60)] + [(3, "a"), (3, "a"), (9, "é" * 50), (-4, "x" * 10), (None, "é" * 50), (None, "only here"), (None, "only here")]
    pages = spark.createDataFrame(rows, "page_id bigint, html string").withColumn("url", F.when(F.col("page_id") % 2 == 0, F.lit("http://ü/a b\r\nWARC-Type: x"))).withColumn("key", F.lit(1)).withColumn("first", F.lit(2)).select("*", F.lit("z").alias("HTML"))
    got = archived(pages, min_bytes)
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got.collect()), key=str) == expected(rows, min_bytes)


def test_written_payloads_are_read_and_damage_is_logged(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://a/{i}", payload(i).decode()) for i in range(40)] + [(99, None, payload(7).decode())], "page_id bigint, url string, html string")
    path = write_archives(pages, f"file://{tmp_path}/w", archive_bytes=1 << 14)
    read = read_archives(spark, path)
    assert {number: bytes(p) for number, p in read.where("record_type = 'response'").select(number_in("record_id"), "payload").collect()} == {i: payload(i) for i in range(40)}
    assert {r.target_uri for r in read.where("record_type = 'response'").collect()} == {f"http://a/{i}" for i in range(40)}
    files = [p for p in sorted((tmp_path / "w").glob("part-*")) if p.stat().st_size]
    data = bytearray(files[0].read_bytes())
    data[len(data) // 2] ^= 255
    files[0].write_bytes(bytes(data))
    (tmp_path / "w" / f".{files[0].name}.crc").unlink(missing_ok=True)
    again = read_archives(spark, path, payloads=False)
    lost = again.where("reason IS NOT NULL").collect()
    assert len(lost) == 1 and 0 <= lost[0].start < lost[0].end <= len(data)
    assert again.where("reason IS NULL").count() == 40
    if again.where("record_type = 'response' AND record_id = '<urn:page:7>'").isEmpty():
        assert resolved(again).where("record_id = '<urn:page:99>' AND payload_bytes IS NULL").count() == 1


def test_long_members_and_empty_tables(spark):
    big = random.Random(1).randbytes(17 << 20)
    one = member(record(5, None, big), level=0)
    assert one.endswith(b"\0") and ids(salvage(one + one)) == [5, 5]
    none = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert archived(none).count() == 0
