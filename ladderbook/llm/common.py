"""Small helpers that the operators share."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. On a local master, where there is
    one machine only, a folder of our own if none is set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}-checkpoints/{spark.sparkContext.applicationId}"
    return found


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, and safe when executors are lost."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def total_bytes(df: DataFrame, text: str) -> int:
    """Sum of the UTF-8 lengths of a text column; one cheap scan."""
    return int(df.agg(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0)


def text_array(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """A text column in one piece, as strings with nulls turned to empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    return column.fill_null("") if column.null_count else column


def raw_bytes(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array, without copying."""
    wide = pa.types.is_large_string(strings.type) or pa.types.is_large_binary(strings.type)
    n = len(strings)
    if n == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = strings.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[strings.offset : strings.offset + n + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return body[offs[0] : offs[-1]], offs - offs[0]


def slices(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of rows holding about `most` bytes, one row at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j
        i = j


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)  # there with glibc only


def give_back() -> None:
    """Free memory goes back to the system, as Python workers live on for other tasks."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


_KEPT: dict = {}


def remembered(key, make):
    """make(), which this worker keeps for its next tasks that ask for it: one thing at a time, until a task of another kind begins."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def fresh(key=None) -> None:
    """A task begins that asks for remembered(key), or for nothing: what others have kept and needed is given back."""
    if key not in _KEPT:
        _KEPT.clear()
    give_back()


def trimmed(batches: Iterable[pa.RecordBatch], key=None) -> Iterator[pa.RecordBatch]:
    """The batches; what earlier tasks (but for remembered(key)) and each batch have needed is given back."""
    fresh(key)
    for batch in batches:
        yield batch
        del batch
        give_back()


def released(run):
    """run, for mapInArrow, giving back what earlier tasks and this one have needed."""

    def task(batches):
        fresh()
        yield from run(batches)
        give_back()

    return task


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... (sizes[0] of them), starts[1], ..."""
    total = int(sizes.sum())
    if total == 0:
        return np.empty(0, np.int64)
    ends = np.cumsum(sizes)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - sizes), sizes)


def packed(**arrays: np.ndarray) -> bytes:
    """Arrays of one length after one another, to be read by unpacked() with the same dtypes."""
    return b"".join(np.ascontiguousarray(a).tobytes() for a in arrays.values())


def unpacked(data, dtypes: dict[str, str]) -> dict[str, np.ndarray]:
    n = len(data) // sum(np.dtype(t).itemsize for t in dtypes.values())
    out, at = {}, 0
    for name, t in dtypes.items():
        out[name] = np.frombuffer(data, t, n, at)
        at += n * np.dtype(t).itemsize
    return out
