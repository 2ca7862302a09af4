"""SimHash near-dedup by tiled exact comparison.

Fingerprints within 3 bits of each other agree in at least one of four 16-bit blocks (with more
fingerprints: in two of five, three of six). So only fingerprints that share a block value have to
meet. Those of one value are sorted by population count and cut into tiles; tile pairs whose counts
differ by more than the radius are skipped, the others are compared whole by exclusive or and bit
count. Values that very many fingerprints share are dealt out by pairs of tiles. A task returns the
links it found as trees, not as pairs, and alternating star contractions join the trees.
"""

from __future__ import annotations

from itertools import chain, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import raw_bytes, slices, text_array, trimmed, written

SLICE = 1 << 20  # bytes of text whose hashes are counted at a time
BITS = 1 << 16  # hashes whose bits are unpacked at a time
RADIUS = 3
TILE = 256  # fingerprints of a tile inside a task
HEAP = 4096  # fingerprints of one value and population count that a task takes
SMALL = 48  # values with up to so many fingerprints are compared by shifting
SEED = 42
_PRINT = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])
_LINK = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def shingle_hashes(text: bytes, words: int = 3) -> list[int]:
    """XXH64 of each run of `words` words of the lower-cased text; of the whole if it is shorter."""
    parts = text.lower().split()
    if not parts:
        return []
    joined = b" ".join(parts)
    digest = xxhash.xxh64_intdigest
    if len(parts) <= words:
        return [digest(joined, SEED)]
    sizes = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
    ends = np.cumsum(sizes)
    starts = (ends - sizes)[: len(parts) - words + 1].tolist()
    return [digest(joined[s:e], SEED) for s, e in zip(starts, (ends[words - 1 :] - 1).tolist())]


def majority(found: list[list[int]]) -> np.ndarray:
    """The fingerprint of each list of hashes: the bits that over half of them have set, 0 without hashes."""
    out = np.zeros(len(found), np.uint64)
    n = np.fromiter(map(len, found), np.int64, len(found))
    some = np.flatnonzero(n)
    if not len(some):
        return out
    hashes = np.fromiter(chain.from_iterable(found), np.uint64, int(n.sum()))
    ones = np.zeros((len(some), 64), np.int64)
    starts = np.r_[0, np.cumsum(n[some])]
    for a, b in slices(starts, BITS):
        # a document's bits in parts, and documents together, as long as they are few
        for i in range(starts[a], starts[b], BITS):
            bits = np.unpackbits(hashes[i : min(i + BITS, starts[b])].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones[a:b] += bits.sum(0, dtype=np.int64) if b == a + 1 else np.add.reduceat(bits, starts[a:b] - starts[a], axis=0, dtype=np.int64)
    over = (2 * ones > n[some][:, None]).astype(np.uint8)
    out[some] = np.packbits(over, axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def _prints(words: int):
    def run(batches):
        for batch in trimmed(batches):
            body, offsets = raw_bytes(text_array(batch.column("text")))
            view = memoryview(body)
            parts = [majority([shingle_hashes(bytes(view[offsets[r] : offsets[r + 1]]), words) for r in range(i, j)]) for i, j in slices(offsets, SLICE)]
            out = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out.view(np.int64))], schema=_PRINT)

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(doc_id, fp) per row; null texts count as empty, and a text without words has fingerprint 0."""
    lean = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return lean.mapInArrow(_prints(words), "doc_id bigint, fp bigint")


class Forest:
    """Connected sets of 0..n-1."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        root = self.root
        while True:
            x, y = root[a], root[b]
            differ = x != y
            if not differ.any():
                return
            a, b, x, y = a[differ], b[differ], x[differ], y[differ]
            lo, hi = np.minimum(x, y), np.maximum(x, y)
            np.minimum.at(root, hi, lo)
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root[:] = up


def _compare(fp: np.ndarray, forest: Forest, members: np.ndarray, side: np.ndarray | None) -> None:
    """Join the members within RADIUS bits; with side, only members of different sides are compared."""
    pop = np.bitwise_count(fp[members])
    order = np.argsort(pop, kind="stable")
    members, pop = members[order], pop[order].astype(np.int64)
    tiles = range(0, len(members), TILE)
    for i in tiles:
        a = members[i : i + TILE]
        for j in tiles[i // TILE :]:
            if pop[j] - pop[i : i + TILE][-1] > RADIUS:
                break
            b = members[j : j + TILE]
            if side is not None and len({*side[a].tolist(), *side[b].tolist()}) < 2:
                continue
            near = np.bitwise_count(fp[a][:, None] ^ fp[b][None, :]) <= RADIUS
            x, y = np.nonzero(near)
            forest.join(a[x], b[y])


def _links(batches):
    tables = [b for b in batches if b.num_rows]
    if not tables:
        return
    t = pa.Table.from_batches(tables)
    fp, key = (t.column(n).to_numpy().view(np.uint64) for n in ("fp", "key"))
    side = t.column("side").to_numpy()
    order = np.lexsort((fp, key))
    fp, key, side = fp[order], key[order], side[order]
    forest = Forest(len(fp))
    cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[cut, len(key)])
    small = np.repeat(sizes <= SMALL, sizes)
    for s in range(1, SMALL):
        near = np.flatnonzero(small[s:] & (key[s:] == key[:-s]))
        if not len(near):
            break
        near = near[np.bitwise_count(fp[near] ^ fp[near + s]) <= RADIUS]
        forest.join(near, near + s)
    for i, n in zip(cut[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist()):
        members = np.arange(i, i + n)
        _compare(fp, forest, members, side if side[i : i + n].any() else None)
    root = forest.root
    linked = np.flatnonzero(root != np.arange(len(root)))
    u, v = fp[linked].view(np.int64), fp[root[linked]].view(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], schema=_LINK)


def _blocks(n: int) -> int:
    """How many blocks fingerprints are cut into, so that few share a value by chance."""
    return RADIUS + (1 if n < 1 << 26 else 2 if n < 1 << 33 else 3)


def links(distinct: DataFrame, n: int, parts: int) -> DataFrame:
    """Links (u, v) between fingerprints of `distinct` (fp, without repeats), a spanning forest of them in each task."""
    blocks = _blocks(n)
    width = -(-64 // blocks)
    spans = [(b * width, min(64, b * width + width)) for b in range(blocks)]
    keys = []
    for k, combo in enumerate(combinations(spans, blocks - RADIUS)):
        fields = [F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)) for lo, hi in combo]
        keys.append(F.xxhash64(F.lit(k), *fields))
    keyed = distinct.select("fp", F.bit_count("fp").alias("pop"), F.explode(F.array(*keys)).alias("key"))
    # values with more than HEAP fingerprints: each heap of one population count meets each other one it may link to
    heaps = keyed.groupBy("key", "pop").agg(F.count("*").alias("n"))
    large = heaps.groupBy("key").agg(F.sum("n").alias("n"), F.collect_list(F.struct("pop", "n")).alias("heaps")).filter(F.col("n") > HEAP)
    parted = large.select("key", F.explode("heaps").alias("h")).select("key", F.col("h.pop").alias("pop"), F.ceil(F.col("h.n") / HEAP).cast("int").alias("parts"))
    own = parted.select("key", F.explode(F.expr("transform(sequence(0, parts - 1), p -> pop * 1048576L + p)")).alias("tile"))
    pairs = own.join(own.withColumnRenamed("tile", "tile2"), "key").filter(f"abs(shiftright(tile, 20) - shiftright(tile2, 20)) <= {RADIUS}")
    pairs = pairs.selectExpr("key as value", "tile", "xxhash64(key, least(tile, tile2), greatest(tile, tile2)) as key", "cast(if(tile = tile2, 0, if(tile < tile2, 1, 2)) as int) as side")
    cold = keyed.join(large.select("key"), "key", "left_anti").select("fp", "key", F.lit(0).alias("side"))
    hot = keyed.join(parted, ["key", "pop"]).select("fp", F.col("key").alias("value"), F.expr("pop * 1048576L + pmod(xxhash64(fp), parts)").alias("tile"))
    hot = hot.join(pairs, ["value", "tile"]).select("fp", "key", "side")
    met = cold.unionByName(hot).repartition(parts, "key")
    return met.mapInArrow(_links, "u bigint, v bigint").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of edges (u, v): the least node that it is connected with.

    Large-star and small-star steps in turn, each step a table in the shared folder, until nothing changes.
    """
    edges = written(edges.filter("u <> v").selectExpr("greatest(u, v) as u", "least(u, v) as v").distinct(), "edges")
    seen = None
    while True:
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
        if (state["n"], state["h"]) == seen or state["n"] == 0:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).groupBy("node").agg(F.min("root").alias("root"))
        seen = (state["n"], state["h"])
        both = edges.unionByName(edges.selectExpr("v as u", "u as v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).selectExpr("u", "least(u, m) as m")
        large = both.filter("v > u").join(least, "u").selectExpr("v as u", "m as v").filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").selectExpr("v as u", "m as v").unionByName(least.selectExpr("u", "m as v")).distinct()
        edges = written(small, "edges")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """Per row of docs: the id, fingerprint (16 lowercase hex digits), component_id (least id reachable over links).

    Fingerprints that differ in 3 bits or fewer are linked, those of texts without words (0) like any
    other; null texts count as empty. A null id takes part, but gives no component id unless all ids
    that it reaches are null. Repeated rows get one result each. Other columns are not looked at.
    """
    spark = docs.sparkSession
    prints = written(fingerprints(docs, id_col, text_col, words), "fingerprints")
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    n = distinct.count()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n // 200_000)
    tree = written(components(links(distinct.select("fp"), n, parts)), "components")
    joined = distinct.join(tree.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    roots = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    named = joined.join(roots, "root").select("fp", "component_id")
    return prints.join(named, "fp").select(F.col("doc_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
