"""op12: archives written and read back, against a plain version and by hand."""

import base64
import gzip
import hashlib
from collections import defaultdict

import pytest

from ladderbook.llm import warc
from ladderbook.llm.queries import ORACLES, QUERIES

from ..test_queries import compare


def plain(rows, least=0):
    groups = defaultdict(list)
    for p, u, h in rows:
        groups[(h or "").encode()].append((p, u))
    out = []
    for payload, own in groups.items():
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""), reverse=True)
        for k, (p, _) in enumerate(own):
            later = k > 0 and len(payload) >= least
            out.append((p, len(payload), digest, "revisit" if later else "response", own[0][0] if later else None))
    return sorted(map(repr, out))


def rows_of(spark, frame, path, **options):
    warc.write_archives(warc.captures(frame, **options), path)
    read = warc.resolved(warc.read_archives(spark, path))
    assert read.filter("not digest_ok").isEmpty()
    page = lambda c: warc.page_of(warc.F.col(c)).cast("bigint")
    return sorted(repr(tuple(r)) for r in read.select(page("record_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to")).collect())


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()]
    got = QUERIES["op12_warc"](spark, sf).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(repr(tuple(r)) for r in got) == plain(rows)
    compare(spark, sf, QUERIES["op12_warc"], ORACLES["op12_warc"])


HARD = [(1, "http://a/", "x" * 10), (2, None, "x" * 10), (3, "http://b/ \r\nX: y", "x" * 10), (3, "http://b/", "x" * 10), (4, "u", None), (5, "u", ""), (6, "ü", "é\r\n\r\n\0"), (None, "u", "x" * 10), (None, None, "z"), (7, "u", "q"), (7, "u", "q"), (7, "u", "q"), (8, "u", "w" * 300_000)]


@pytest.mark.parametrize("least", [0, 5, 11])
def test_hard_pages(spark, tmp_path, least):
    frame = spark.createDataFrame([(*r, "more", 1) for r in HARD], "page_id bigint, url string, html string, kind string, digest int")
    assert rows_of(spark, frame, f"file://{tmp_path}/w", least_bytes=least) == plain(HARD, least)


def test_no_pages(spark, tmp_path):
    assert rows_of(spark, spark.createDataFrame([], "page_id bigint, url string, html string"), f"file://{tmp_path}/w") == []


def test_long_payload(spark, tmp_path):
    """Members of 16 MB and more, whose last byte isn't 0."""
    frame = spark.createDataFrame([(1, "u", 1), (2, "u", 2)], "page_id bigint, url string, n int").selectExpr("page_id", "url", "repeat('abcdefgh', n * 2200000) as html")
    rows = [(p, "u", "abcdefgh" * (n * 2_200_000)) for p, n in ((1, 1), (2, 2))]
    assert rows_of(spark, frame, f"file://{tmp_path}/w") == plain(rows)


def test_archives_are_plain_warc(spark, tmp_path):
    """Read without the reader: members of their own, record by record."""
    frame = spark.createDataFrame(HARD, "page_id bigint, url string, html string")
    warc.write_archives(warc.captures(frame), f"file://{tmp_path}/w")
    text = b"".join(gzip.decompress(f.read_bytes()) for f in sorted(tmp_path.glob("w/*/part-*")))
    assert text.count(b"WARC/1.1\r\n") == len(HARD) and text.count(b"WARC-Type: revisit") == len(HARD) - len({h or "" for _, _, h in HARD})
    for part in text.split(b"WARC/1.1\r\n")[1:]:
        head, _, rest = part.partition(b"\r\n\r\n")
        size = int(head.split(b"Content-Length: ")[1].split(b"\r\n")[0])
        assert rest[size:] == b"\r\n\r\n"


def archive(*payloads):
    return b"".join(warc.member("response", f"urn:{k}", "u", "2024-01-01T00:00:00Z", p, warc.base32_sha1(p), len(p), None) for k, p in enumerate(payloads))


def test_reader_frames_and_verifies():
    good = archive(b"one", b"two" * 100_000, b"")
    assert [r["payload"] for r in warc.records(good)] == [b"one", b"two" * 100_000, b""] and all(r["digest_ok"] for r in warc.records(good))
    assert list(warc.records(b"")) == []
    false = gzip.compress(gzip.decompress(archive(b"one")).replace(b"one", b"onf"))
    assert [r["digest_ok"] for r in warc.records(false)] == [False]
    for bad in (good[:-9], gzip.compress(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc\r\n\r\n"), gzip.compress(b"WARC/1.1\r\nContent-Length: 1\r\n\r\nabc\r\n\r\n"), gzip.compress(b"HTTP/1.1\r\nContent-Length: 0\r\n\r\n\r\n\r\n"), gzip.compress(b"WARC/1.1\r\nX: 1\r\n\r\n\r\n\r\n")):
        with pytest.raises(warc.Damaged):
            list(warc.records(bad))
