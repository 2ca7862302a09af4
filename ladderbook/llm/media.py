"""Media columns: payloads stored as progressive JPEG files, and such files read into RGB tensors."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import progressive_jpeg as jpeg
from .common import ragged, raw_bytes, slices, text_array

UNIT = 192  # a payload's length is a multiple of this
WRITE, READ = 1 << 19, 2 << 20  # bytes that are written and read at a time


def _pass(batch: pa.RecordBatch, without: tuple[str, ...], new: list[tuple[str, pa.Array]]) -> pa.RecordBatch:
    names = [c for c in batch.schema.names if c not in without]
    schema = pa.schema([*(batch.schema.field(c) for c in names), *((n, a.type) for n, a in new)])
    return pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *(a for _, a in new)], schema=schema)


def _store(batches):
    for batch in batches:
        body, offsets = raw_bytes(text_array(batch.column("_text")))
        files: list[bytes] = []
        for i, j in slices(offsets, WRITE):
            size = np.diff(offsets[i : j + 1])
            room = np.maximum(UNIT, -(-size // UNIT) * UNIT)
            begin = np.cumsum(room) - room
            payload = np.full(int(room.sum()), 32, np.uint8)
            payload[ragged(begin, size)] = body[offsets[i] : offsets[j]]
            files += jpeg.store(payload, np.r_[begin, len(payload)])
        yield _pass(batch, ("_text",), [("n_bytes", pa.array(np.diff(offsets))), ("media", pa.array(files, pa.binary()))])


def store_texts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs without text_col, with n_bytes (UTF-8) and media: a progressive JPEG whose coefficients hold the
    text's bytes, filled up with blanks (32) to a positive multiple of 192.

    Null texts count as empty. Texts are stored whole; equal texts give equal files. Columns of docs by
    the result's names are replaced, others handed through.
    """
    names = {"n_bytes", "media", "_text", text_col}
    kept = docs.select(*[c for c in docs.columns if c not in names], F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    out = T.StructType([f for f in kept.schema if f.name != "_text"] + [T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])
    return kept.mapInArrow(_store, out)


def _read(with_tensor: bool):
    def run(batches):
        for batch in batches:
            blobs = batch.column("_media").to_pylist()
            ends = np.r_[0, np.cumsum([len(b or b"") for b in blobs])].astype(np.int64)
            cols: dict[str, list] = {n: [] for n in ("width", "height", "feature", "payload", "tensor", "problem")}
            for i, j in slices(ends, READ):
                images, problems = [], []
                for blob in blobs[i:j]:
                    try:
                        images.append(jpeg.parse(blob or b""))
                        problems.append(None)
                    except (ValueError, IndexError) as e:
                        images.append(None)
                        problems.append(str(e))
                sound = [x for x in images if x is not None]
                coef = jpeg.coefficients(sound)
                features: list = [None] * len(sound)
                for members, count, rgb in jpeg.tiles(sound, coef):
                    total = np.add.reduceat(rgb.reshape(len(rgb), -1, 3).sum(1, dtype=np.int64), np.cumsum(count) - count, axis=0)
                    for k, (r, g, b) in zip(members, total.tolist()):
                        features[k] = f"{sound[k].width}x{sound[k].height}:{r}:{g}:{b}"
                loaded = iter(zip(sound, features, jpeg.load(sound, coef) if all(x.comment.isdigit() for x in sound) else [_payload(x, coef) for x in sound], jpeg.tensors(sound, coef) if with_tensor else [None] * len(sound)))
                for image in images:
                    if image is None:
                        row = (None,) * 5
                    else:
                        x, feature, payload, tensor = next(loaded)
                        row = (x.width, x.height, feature, payload, tensor)
                    for name, value in zip(cols, row):
                        cols[name].append(value)
                cols["problem"] += problems
            payloads = [None if p is None else memoryview(p) for p in cols["payload"]]
            new = [
                ("width", pa.array(cols["width"], pa.int32())),
                ("height", pa.array(cols["height"], pa.int32())),
                ("payload_bytes", pa.array([None if p is None else len(p) for p in payloads], pa.int64())),
                ("payload_sha256", pa.array([None if p is None else hashlib.sha256(p).hexdigest() for p in payloads], pa.string())),
                ("tail_crc32", pa.array([None if p is None else zlib.crc32(p[-16:]) for p in payloads], pa.int64())),
                ("feature", pa.array(cols["feature"], pa.string())),
                ("problem", pa.array(cols["problem"], pa.string())),
            ]
            if with_tensor:
                new.append(("tensor", pa.array([None if t is None else t.tobytes() for t in cols["tensor"]], pa.binary())))
            yield _pass(batch, ("_media",), new)

    return run


def _payload(image, coef: np.ndarray):
    return jpeg.load([image], coef)[0] if image.comment.isdigit() else None


def read_media(stored: DataFrame, media_col: str = "media", with_tensor: bool = True) -> DataFrame:
    """stored without media_col, with what its progressive JPEGs hold: width, height, feature (size, and the sums of red, green
    and blue over the coded area), the payload of store_texts() by its length, SHA-256 and the CRC-32 of its
    last 16 bytes (null in other files), problem (null if the file was read), and with_tensor the
    full-resolution samples, height x width x 3 bytes.

    Null, empty and unreadable files give nulls and a problem; cut-off files what they still hold.
    Columns of stored by the result's names are replaced, others handed through.
    """
    fields = [("width", T.IntegerType()), ("height", T.IntegerType()), ("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()), ("feature", T.StringType()), ("problem", T.StringType())]
    fields += [("tensor", T.BinaryType())] * with_tensor
    names = {n for n, _ in fields} | {"_media"}
    kept = stored.select(*[c for c in stored.columns if c not in names | {media_col}], F.col(media_col).cast("binary").alias("_media"))
    out = T.StructType([f for f in kept.schema if f.name != "_media"] + [T.StructField(n, t) for n, t in fields])
    return kept.mapInArrow(_read(with_tensor), out)
