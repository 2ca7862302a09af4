"""WARC archives: one gzip member a record, written and read by Spark jobs.

A payload is stored once, as a response; records of equal payloads refer to it (revisits). Archives are what other
tools call .warc.gz files, under the names that Spark gives, in a folder of any store that Spark writes to.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import trimmed

#: what is read and inflated at a time
STEP = 1 << 16
_END = b"\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = T.StructType([T.StructField(n, T.StringType()) for n in ("record_type", "record_id", "refers_to", "target_uri", "payload_digest")] + [T.StructField("payload", T.BinaryType()), T.StructField("digest_ok", T.BooleanType())])


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _header(fields: list[tuple[str, str | None]]) -> bytes:
    """Fields as lines; those without a value are left out, control characters are percent-encoded."""
    clean = lambda v: re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", v) if v is not None else None
    return b"WARC/1.1\r\n" + b"".join(f"{n}: {clean(v) if n in ('WARC-Target-URI', 'WARC-Refers-To-Target-URI') else v}\r\n".encode() for n, v in fields if v is not None) + b"\r\n"


def member(kind: str, record_id: str, uri: str | None, date: str, payload: bytes | None, digest: str, size: int, refers_to: str | None, level: int = 6) -> bytes:
    """One record as a gzip member. A response holds the payload; a revisit only its size and digest."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"") if kind == "response" else http
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", date), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}")]
    if refers_to is not None:
        fields += [("WARC-Refers-To", f"<{refers_to}>"), ("WARC-Profile", _PROFILE)]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    deflate = zlib.compressobj(level, zlib.DEFLATED, 31)
    return deflate.compress(_header(fields)) + deflate.compress(block) + deflate.compress(_END) + deflate.flush()


class Damaged(ValueError):
    """An archive that can't be read on: a cut member, a header without an end, a length that isn't met."""


def records(archive: bytes | memoryview) -> Iterator[dict]:
    """An archive's records, one after another: members are inflated step by step, blocks framed by Content-Length.

    digest_ok: whether the block has its block digest and a response's payload its payload digest (where
    they are given). Raises Damaged where the framing breaks.
    """
    view, at = memoryview(archive), 0
    while at < len(view):
        inflate, found, need = zlib.decompressobj(31), bytearray(), None
        while not inflate.eof:
            if at >= len(view):
                raise Damaged("a member without an end")
            step = view[at : at + STEP]
            found += inflate.decompress(step)
            at += len(step) - len(inflate.unused_data)
            if need is None and (end := found.find(_END)) >= 0:
                fields = _fields(bytes(found[:end]))
                need = end + len(_END) + int(fields.get("content-length", -1))
            if need is not None and len(found) > need + len(_END):
                raise Damaged("a record longer than its Content-Length")
        if need is None or "content-length" not in fields or len(found) != need + len(_END) or found[need:] != _END:
            raise Damaged("a record that doesn't have its Content-Length")
        yield _record(fields, bytes(memoryview(found)[end + len(_END) : need]))


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise Damaged("no WARC record")
    pairs = (line.partition(":") for line in lines[1:])
    return {n.strip().lower(): v.strip() for n, _, v in pairs}


def _record(fields: dict[str, str], block: bytes) -> dict:
    digest = lambda name: fields.get(name, "").removeprefix("sha1:") or None
    bare = lambda name: fields[name].strip("<>") if name in fields else None
    kind, body = fields.get("warc-type"), block
    if fields.get("content-type", "").startswith("application/http"):
        body = block[block.index(_END) + len(_END) :] if _END in block else b""
    payload = body if kind == "response" else None
    ok = digest("warc-block-digest") in (None, base32_sha1(block))
    if payload is not None and digest("warc-payload-digest") is not None:
        ok = ok and digest("warc-payload-digest") == base32_sha1(payload)
    return {"record_type": kind, "record_id": bare("warc-record-id"), "refers_to": bare("warc-refers-to"), "target_uri": fields.get("warc-target-uri"), "payload_digest": digest("warc-payload-digest"), "payload": payload, "digest_ok": ok}


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records (RECORDS) of all archives under path, be they Spark's parts or files named otherwise; each file is read
    from its first byte to its last. Empty files and those whose names start with . or _ have none."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")

    def each(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                held, size = [], 0
                for record in records(batch.column(0)[k].as_buffer()):
                    held.append(record)
                    size += len(record["payload"] or b"")
                    if size > STEP * 64 or len(held) >= 4096:
                        yield _batch(held)
                        held, size = [], 0
                if held:
                    yield _batch(held)

    return files.mapInArrow(lambda batches: trimmed(each(batches)), RECORDS)


def _batch(held: list[dict]) -> pa.RecordBatch:
    kinds = [pa.string()] * 5 + [pa.binary(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in held], t) for n, t in zip(RECORDS.names, kinds)], RECORDS.names)


def _members(level: int):
    def each(batches):
        for batch in batches:
            col = {n: batch.column(n).to_pylist() for n in batch.schema.names if n != "html"}
            made, last, size = [], [], 0
            for k in range(batch.num_rows):
                kind, payload = col["kind"][k], batch.column("html")[k].as_py()
                digest = base64.b32encode(bytes.fromhex(col["sha1"][k])).decode()
                data = member(kind, col["record_id"][k], col["uri"][k], col["date"][k], payload, digest, col["n_bytes"][k], col["refers_to"][k], level)
                made.append(data[:-1])
                last.append(data[-1])
                size += len(data)
                if size > STEP * 64:
                    yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary()), pa.array(last, pa.int32())], ["member", "last"])
                    made, last, size = [], [], 0
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary()), pa.array(last, pa.int32())], ["member", "last"])

    return lambda batches: trimmed(each(batches))


def record_id(page_id: Column, digest: Column, kind: str) -> Column:
    """A URN of a record's page (nothing for null), kind and payload. Rows equal in all three have one URN."""
    return F.concat(F.lit("urn:page:"), F.coalesce(F.url_encode(page_id.cast("string")), F.lit("")), F.lit(f":{kind}:"), digest)


def page_of(urn: Column) -> Column:
    """The page_id in a record_id(), as a text."""
    return F.url_decode(F.nullif(F.regexp_extract(urn, "^urn:page:([^:]*):", 1), F.lit("")))


def captures(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """pages (page_id, url, html) as records to be written: kind, page_id, uri, sha1, n_bytes, refers_to, html (of responses).

    Of records with equal payloads of at least least_bytes bytes, that of the largest page_id (nulls are least;
    ties: the largest url, then any of the equal rows) is the response; smaller ones are all responses. A
    payload of many rows is brought together by its largest row only, task by task; its revisits move without it.
    """
    rows = pages.select("page_id", F.col("url").alias("uri"), F.coalesce("html", F.lit("")).cast("binary").alias("html"))
    rows = rows.withColumns({"sha1": F.sha1("html"), "digest": F.sha2("html", 256), "n_bytes": F.octet_length("html").cast("bigint")})
    none = F.lit(None).cast("string")
    order = F.struct(F.col("page_id").isNotNull(), F.col("page_id").alias("page_id"), F.col("uri").isNotNull(), F.col("uri").alias("uri"))
    long = rows.filter(F.col("n_bytes") >= least_bytes)
    tops = long.groupBy("digest").agg(F.max(order).alias("top"), F.max_by("html", order).alias("html"), F.max("sha1").alias("sha1"), F.max("n_bytes").alias("n_bytes"))
    id_of = lambda p, kind: record_id(p, F.col("digest"), kind)
    responses = tops.select(F.lit("response").alias("kind"), "top.page_id", "top.uri", id_of(F.col("top.page_id"), "response").alias("record_id"), "sha1", "n_bytes", none.alias("refers_to"), "html")
    each = long.groupBy("digest", "page_id", "uri").agg(F.count("*").alias("n"), F.max("sha1").alias("sha1"), F.max("n_bytes").alias("n_bytes"))
    heads = each.groupBy("digest").agg(F.max(order).alias("top"), F.sum("n").alias("all")).filter("all > 1").drop("all")
    later = each.join(heads, "digest").withColumn("n", F.col("n") - (F.col("page_id").eqNullSafe(F.col("top.page_id")) & F.col("uri").eqNullSafe(F.col("top.uri"))).cast("int"))
    later = later.withColumn("copy", F.explode(F.expr("filter(sequence(0, n), x -> x < n)")))
    revisits = later.select(F.lit("revisit").alias("kind"), "page_id", "uri", id_of(F.col("page_id"), "revisit").alias("record_id"), "sha1", "n_bytes", id_of(F.col("top.page_id"), "response").alias("refers_to"), F.lit(None).cast("binary").alias("html"))
    short = rows.filter(F.col("n_bytes") < least_bytes).select(F.lit("response").alias("kind"), "page_id", "uri", id_of(F.col("page_id"), "response").alias("record_id"), "sha1", "n_bytes", none.alias("refers_to"), "html")
    return responses.unionByName(revisits).unionByName(short) if least_bytes > 0 else responses.unionByName(revisits)


def write_archives(records_: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", level: int = 6) -> None:
    """captures() rows as .warc.gz files under path, by Spark's text writer: to it a member is a line.

    A line's end is then the member's last byte, the highest of its length: 0 in members of less than 16 MB,
    which stand in files of their own; longer ones are in files by that byte.
    """
    lean = records_.withColumn("date", F.lit(date)).select("kind", "record_id", "uri", "date", "html", "sha1", "n_bytes", "refers_to")
    small = F.col("n_bytes") + 3 * F.coalesce(F.octet_length("uri"), F.lit(0)) < (1 << 24) - (1 << 16)
    schema = T.StructType([T.StructField("member", T.BinaryType()), T.StructField("last", T.IntegerType())])
    made = lambda rows: rows.mapInArrow(_members(level), schema)
    write = lambda rows, last, to: rows.select(F.col("member").cast("string").alias("value")).write.option("lineSep", chr(last)).option("compression", "none").text(to)
    write(made(lean.filter(small)), 0, f"{path}/small")
    long = lean.filter(~small)
    if not long.isEmpty():
        from .common import written

        each = written(made(long), "members")
        for last in sorted(r["last"] for r in each.select("last").distinct().collect()):  # one of 128 values
            write(each.filter(F.col("last") == last), last, f"{path}/long-{last}")


def resolved(read: DataFrame) -> DataFrame:
    """read_archives() rows with payload_bytes, that of the full payload: a revisit's is its response's (null if that isn't there)."""
    own = read.select("record_type", "record_id", "refers_to", "target_uri", "payload_digest", "digest_ok", F.octet_length("payload").cast("bigint").alias("payload_bytes"))
    sizes = own.filter("record_type = 'response'").select(F.col("record_id").alias("_of"), F.col("payload_bytes").alias("_bytes"))
    later = own.filter("record_type = 'revisit'").drop("payload_bytes").join(sizes, F.col("refers_to") == F.col("_of"), "left").drop("_of").withColumnRenamed("_bytes", "payload_bytes")
    return own.filter("record_type <> 'revisit'").unionByName(later)
