"""Nearest neighbours: an inverted file of coarse centroids with product-quantised residuals, and bounds.

Centroids and codebooks are fitted on a bounded sample. Every vector goes to the list of its nearest
centroid, and its residual is stored as one byte a subspace, with the length of what the code leaves out.
A query looks at its nearest lists first; the k-th best cosine there is what others have to reach. By the
triangle inequality a list's radius tells how near its entries can be at most, and an entry's code and
its left-out length how near the entry can be. Lists and entries that can't reach the k-th best are left
out, all others get their exact cosine. So codes save work, and how well they fit a table decides how
much, but never which vectors are found. Equal vectors share one entry, which stands for all of them: it
keeps the smallest ids, as many as a result can hold. The entries are dealt out by a hash in shards of
bounded size, each with its own lists; each shard returns its k + 1 best. Queries are dealt out by a hash
too, in blocks of bounded size; each shard meets each block.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ragged, written
from .words import sample

SAMPLE = 16_384  # vectors that the index is fitted on (the sample's documented bound)
LISTS = 1024  # most lists
SUBSPACES = 16
LOOK = 256  # entries of the nearest lists, at least, that a query looks at first
SHARD = 20_000  # entries of a shard at most, and
SHARD_BYTES = 32 << 20  # bytes of their vectors
BLOCK = 5_000  # queries that meet a shard at a time
SLACK = 1e-12  # what rounding can take from a bound
_FOUND = pa.schema([("query", pa.int64()), ("rep", pa.int64()), ("near", pa.float64())])


@dataclass
class Index:
    centroids: np.ndarray  # lists x dimension, unit vectors
    books: list[np.ndarray]  # by subspace, 256 x its width
    edges: list[int]  # where subspaces start and end


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator, unit: bool) -> np.ndarray:
    centre = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = (x @ centre.T - (0 if unit else 0.5 * (centre**2).sum(1))).argmax(1)
        order = np.argsort(own, kind="stable")
        there, first = np.unique(own[order], return_index=True)
        mean = np.add.reduceat(x[order], first, axis=0)
        if unit:
            mean /= np.maximum(np.linalg.norm(mean, axis=1, keepdims=True), 1e-12)
        else:
            mean /= np.diff(np.r_[first, len(x)])[:, None]
        centre[there] = mean
        if len(there) < len(centre):
            gone = np.setdiff1d(np.arange(len(centre)), there)
            centre[gone] = x[rng.choice(len(x), len(gone))]
    return centre


def fit(x: np.ndarray, total: int) -> Index:
    """x: the sampled vectors; total: how many will be indexed."""
    rng = np.random.default_rng(5)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    lists = int(max(1, min(LISTS, np.sqrt(total), len(x) // 8 or 1)))
    centroids = _kmeans(x, lists, 10, rng, True)
    rest = x - centroids[(x @ centroids.T).argmax(1)]
    edges = np.linspace(0, x.shape[1], min(SUBSPACES, x.shape[1]) + 1).astype(int).tolist()
    books = [_kmeans(rest[:, a:b], 256, 8, rng, False) for a, b in zip(edges, edges[1:])]
    return Index(centroids, books, edges)


def _matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _code(shared):
    """Adds an entry's list, its code, and of what the code stands for the squared length and the distance from the vector."""

    def run(batches):
        index = shared.value
        width = index.centroids.shape[1]
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _unit(_matrix(batch.column("vector"), width))
            own = (x.astype(np.float32) @ index.centroids.T).argmax(1)
            known = index.centroids[own].astype(np.float64)
            rest = (x - known).astype(np.float32)
            codes = np.empty((len(x), len(index.books)), np.uint8)
            for k, book in enumerate(index.books):
                a, b = index.edges[k], index.edges[k + 1]
                codes[:, k] = (rest[:, a:b] @ book.T - 0.5 * (book**2).sum(1)).argmax(1)
                known[:, a:b] += book[codes[:, k]]
            added = [pa.array(own.astype(np.int32)), pa.array([r.tobytes() for r in codes], pa.binary()), pa.array((known**2).sum(1)), pa.array(np.linalg.norm(x - known, axis=1))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, "list", "code", "square", "missed"])

    return run


def _at_most(distance: np.ndarray, spare: np.ndarray) -> np.ndarray:
    """The cosine that unit vectors within `spare` of a point at this squared distance can have at most."""
    least = np.maximum(np.sqrt(np.maximum(distance - SLACK, 0)) - spare, 0)
    return 1 - 0.5 * least**2 + SLACK


def _best(x: np.ndarray, reps: np.ndarray, near: np.ndarray, w: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, cosines) of the k + 1 best; near: cosines but for rounding. The sums run as those of _cosine() do, so that ties are the same."""
    if len(near) > k + 1:
        some = np.flatnonzero(near >= np.partition(near, len(near) - k - 1)[len(near) - k - 1] - SLACK)
        x, reps = x[some], reps[some]
    dot, square, other = np.zeros(len(x)), np.zeros(len(x)), 0.0
    for d in range(x.shape[1]):
        dot += x[:, d] * w[d]
        square += x[:, d] * x[:, d]
        other += w[d] * w[d]
    score = dot / (np.sqrt(square) * np.sqrt(other))
    top = np.lexsort((reps, -score))[: k + 1]
    return reps[top], score[top]


def _found(asks: list[int], best: list[tuple[np.ndarray, np.ndarray]]) -> pa.Table:
    query = np.repeat(np.array(asks, np.int64), [len(r) for r, _ in best])
    return pa.Table.from_arrays([pa.array(query), *(pa.array(np.concatenate(x)) for x in zip(*best))], schema=_FOUND)


def _search(shared, k: int, visited: float | None):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        index = shared.value
        if not left.num_rows or not right.num_rows:
            return pa.Table.from_batches([], schema=_FOUND)
        centroids = index.centroids.astype(np.float64)
        lists, width = centroids.shape
        visits = lists if visited is None else min(lists, max(8, int(np.ceil(visited * lists))))
        reps, home = left.column("rep").to_numpy(), left.column("list").to_numpy()
        order = np.lexsort((reps, home))
        reps, home = reps[order], home[order]
        codes = np.frombuffer(b"".join(left.column("code").to_pylist()), np.uint8).reshape(len(reps), -1)
        codes = np.ascontiguousarray(codes[order].T)
        square, missed = (left.column(c).to_numpy()[order] for c in ("square", "missed"))
        raw = _matrix(left.column("vector"), width)[order]
        x = _unit(raw)
        start = np.searchsorted(home, np.arange(lists + 1))
        many = np.diff(start)
        radius = np.zeros(lists)
        np.maximum.at(radius, home, np.linalg.norm(x - centroids[home], axis=1))
        length = (centroids**2).sum(1)
        asks, asked = right.column("rep").to_numpy(), _matrix(right.column("vector"), width)
        best = []
        for b in range(0, len(asks), 256):
            q = _unit(asked[b : b + 256])
            bases = q @ centroids.T
            tables = [q[:, index.edges[s] : index.edges[s + 1]] @ book.T.astype(np.float64) for s, book in enumerate(index.books)]
            for i, base in enumerate(bases):
                open_lists = np.argsort(-base, kind="stable")[:visits]
                first = open_lists[: int(np.searchsorted(np.cumsum(many[open_lists]), LOOK)) + 1]
                entries = ragged(start[first], many[first])
                near = x[entries] @ q[i]
                bound = np.partition(near, len(near) - k - 1)[len(near) - k - 1] - SLACK if len(near) > k else -2.0
                rest = open_lists[len(first) :]
                rest = rest[_at_most(1 + length[rest] - 2 * base[rest], radius[rest]) >= bound]
                more = ragged(start[rest], many[rest])
                about = base[home[more]]
                for s, table in enumerate(tables):
                    about += table[i][codes[s][more]]
                can = np.minimum(about + missed[more] + SLACK, _at_most(1 + square[more] - 2 * about, missed[more]))
                more = more[can >= bound]
                entries, near = np.r_[entries, more], np.r_[near, x[more] @ q[i]]
                best.append(_best(raw[entries], reps[entries], near, asked[b + i], k))
        return _found(asks.tolist(), best)

    return run


def _scanned(k: int):
    """Every entry against every query of a block, without codes."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.Table.from_batches([], schema=_FOUND)
        width = len(left.column("vector")[0])
        raw, asked = _matrix(left.column("vector"), width), _matrix(right.column("vector"), width)
        x, q = _unit(raw), _unit(asked)
        reps, best = left.column("rep").to_numpy(), []
        for i in range(0, len(q), 256):
            best += [_best(raw, reps, near, w, k) for near, w in zip(q[i : i + 256] @ x.T, asked[i : i + 256])]
        return _found(right.column("rep").to_pylist(), best)

    return run


def nearest(vectors: DataFrame, queries, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", visited: float | None = None, exact: bool = False) -> DataFrame:
    """The k nearest others by cosine of every row for which the condition `queries` holds.

    visited: the share of its nearest lists that a query visits at most, for less work and fewer of the
    nearest; if none is given, all that can hold one of them, and the result is that of all pairs. exact:
    compare every query with every vector instead, block by block, without lists and codes.

    Columns: query_id, rank (from 1), the id, score (the exact cosine, in double precision); ties go to
    the smaller id. Vectors that are null, zero, hold null or non-finite components, or are not as long
    as most, take no part, nor do rows without an id. Rows that repeat an id count once for each
    different vector. Fewer than k others give fewer rows. Other columns are not looked at.
    """
    spark = vectors.sparkSession
    kind = "array<float>" if dict(vectors.dtypes)[vector_col] == "array<float>" else "array<double>"
    raw = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast(kind).alias("v"), queries.alias("asks"))
    sound = raw.filter("id is not null and v is not null and size(v) > 0 and not exists(v, x -> x is null or isnan(x) or abs(x) = double('Infinity')) and exists(v, x -> x <> 0)")
    lengths = sound.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    empty = spark.createDataFrame([], f"query_id bigint, rank int, {id_col} bigint, score double")
    if not lengths:
        return empty
    sound = sound.filter(F.size("v") == lengths[0]["n"]).groupBy("id", "v").agg(F.max(F.coalesce("asks", F.lit(False))).alias("asks"))
    # equal vectors: the least id stands for all, and only the k + 1 least can be in a result
    equal = Window.partitionBy("v").orderBy("id")
    first = sound.select("id", "v", F.row_number().over(equal).alias("n")).filter(F.col("n") <= k + 1)
    members = written(first.groupBy("v").agg(F.min("id").alias("rep"), F.array_sort(F.collect_list("id")).alias("ids")), "vectors")
    asking = written(sound.filter("asks").select("id", "v").join(members.select("v", "rep"), "v").select("id", "rep"), "queries")
    entries = members.select("rep", F.col("v").alias("vector"))
    total = members.count()
    coded = members.select(F.col("rep").alias("rep"), F.col("v").alias("vector"))
    if not exact:
        chosen = sample(members.select(F.col("rep").alias("key"), F.col("v")), None, SAMPLE, 5).select("key", "v").collect()
        if not chosen:
            chosen = members.select(F.col("rep").alias("key"), "v").orderBy("rep").limit(SAMPLE).collect()
        chosen.sort(key=lambda r: r["key"])
        shared = spark.sparkContext.broadcast(fit(_unit(np.array([r["v"] for r in chosen], float)).astype(np.float32), total))
        coded = entries.mapInArrow(_code(shared), f"rep bigint, vector {kind}, list int, code binary, square double, missed double")
    shards = max(1, -(-total // max(1, min(SHARD, SHARD_BYTES // (8 * lengths[0]["n"])))))
    sharded = coded.withColumn("shard", F.pmod(F.xxhash64("rep"), F.lit(shards)).cast("int"))
    blocks = max(1, -(-asking.select("rep").distinct().count() // BLOCK))
    sharded = sharded.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = entries.join(asking.select("rep").distinct(), "rep", "left_semi").withColumn("block", F.pmod(F.xxhash64(F.lit(1), "rep"), F.lit(blocks)).cast("int"))
    asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    found = sharded.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInArrow(_scanned(k) if exact else _search(shared, k, visited), "query bigint, rep bigint, near double")
    best = Window.partitionBy("query").orderBy(F.desc("near"), "rep")
    pairs = found.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k + 1).select("query", "rep")
    mine = members.select(F.col("rep").alias("query"), F.col("v").alias("w"))
    scored = pairs.join(members, "rep").join(mine, "query").select("query", "ids", _cosine("v", "w").alias("score"))
    top = Window.partitionBy("query").orderBy(F.desc("score"), "member")
    lists = scored.select("query", "score", F.explode("ids").alias("member")).withColumn("n", F.row_number().over(top)).filter(F.col("n") <= k + 1)
    rows = asking.select(F.col("id").alias("query_id"), F.col("rep").alias("query")).join(lists, "query").filter("member <> query_id")
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "member"))).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("member").alias(id_col), "score")


def _cosine(a: str, b: str):
    a, b = F.col(a).cast("array<double>"), F.col(b).cast("array<double>")
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    square = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x)
    return dot / (F.sqrt(square(a)) * F.sqrt(square(b)))
