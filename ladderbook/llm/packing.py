"""Sum-of-squares packing of tokenized documents into sequences of a fixed length.

A piece goes where the sum over all gaps of (open sequences with that gap)^2 becomes least: into an
open sequence, or a new one. That keeps sequences of every gap at hand, so that later pieces fit.
Pieces come in the order of a hash, the shortest fifth of them last, so that they fill what is left. Only (id, piece, length) travel to the packers; each packs one
hash group of pieces, of which there is one for `GROUP_DOCS` documents, so that what stays open
at a group's end is a few sequences in tens of thousands.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import raw_bytes, slices, text_array, trimmed
from .encoding import encoder

SLICE = 1 << 20  # bytes of text that are encoded at a time
GROUP_DOCS = 60_000  # documents, or
GROUP_BYTES = 1 << 30  # bytes of text, of one packer's group
SHORT = 0.2  # the share of pieces that are packed last
_CUT = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
_PACKED = pa.schema([*_CUT, ("sequence_id", pa.int64()), ("offset", pa.int64())])


def sum_of_squares(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each length in turn, 1 <= length <= size."""
    count = np.zeros(size + 1, np.int64)  # open sequences by gap; full ones don't count
    held: list[list[int]] = [[] for _ in range(size + 1)]
    where, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    made = 0
    for i, n in enumerate(lengths.tolist()):
        old, new = count[n:], count[: size - n + 1]
        change = 2 * (new - old) + 2  # of the sum, for each gap that is left
        change[0] = 1 - 2 * old[0]  # an exact fit leaves none that counts
        change[old == 0] = np.iinfo(np.int64).max
        change[-1] = 2 * new[-1] + 1 if n < size else 0  # a new sequence
        best = int(change.argmin())  # the least gap of several as good
        gap = n + best
        if best == size - n:
            gap = size
            place = made
            made += 1
        else:
            place = held[gap].pop()
            count[gap] -= 1
        where[i], offset[i] = place, size - gap
        if best:
            held[best].append(place)
            count[best] += 1
    return where, offset


def _cut(path: str, size: int, end_id: int):
    def run(batches):
        tool = encoder(path)
        for batch in trimmed(batches, path):
            texts = text_array(batch.column("text"))
            docs = batch.column("doc_id").to_pylist()
            _, offsets = raw_bytes(texts)
            rows: list[tuple] = []
            for i, j in slices(offsets, SLICE):
                for doc, ids in zip(docs[i:j], tool.ids(texts.slice(i, j - i))):
                    raw = memoryview(np.append(ids, end_id).astype("<u4").tobytes())
                    for k, at in enumerate(range(0, len(raw), 4 * size)):
                        part = raw[at : at + 4 * size]
                        rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
            cols = zip(*rows) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _CUT)], schema=_CUT)

    return run


def _pack(size: int):
    def run(batches):
        from pyspark import TaskContext

        table = pa.Table.from_batches(list(batches), schema=_CUT)
        if not table.num_rows:
            return
        length = table.column("length").to_numpy()
        piece, doc = table.column("piece").to_numpy(), table.column("doc_id").fill_null(-1).to_numpy()
        mixed = (doc * 1_000_003 + piece).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        order = np.lexsort((piece, doc, mixed ^ (mixed >> np.uint64(29)), length <= np.quantile(length, SHORT)))
        where, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
        where[order], offset[order] = sum_of_squares(length[order], size)
        base = TaskContext.get().partitionId() << 40
        table = table.append_column("sequence_id", pa.array(where + base)).append_column("offset", pa.array(offset))
        yield from table.cast(_PACKED).to_batches()

    return run


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, size: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece of a document: its place in its document and in a sequence of at most `size` tokens.

    A document is its text's ids and end_id. Only longer ones are cut, into pieces of `size`; the last
    may be shorter. Columns: the id, piece, start, length, ids_crc32, sequence_id, offset.

    Null texts count as empty (one piece of one token). Null and repeated ids are kept as they are.
    Texts are encoded whole. Other columns are not looked at.
    """
    size_of = docs.agg(F.count("*").alias("n"), F.sum(F.octet_length(text_col)).alias("bytes")).first()
    groups = max(1, -(-size_of["n"] // GROUP_DOCS), (size_of["bytes"] or 0) // GROUP_BYTES)
    lean = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    pieces = lean.mapInArrow(_cut(tokenizer, size, end_id), "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")
    dealt = pieces.repartition(groups, F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups)))
    out = dealt.mapInArrow(_pack(size), "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
    return out.withColumnRenamed("doc_id", id_col)
