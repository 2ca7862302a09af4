"""The trie of conversations that share first turns, from whole sequences.

Equal conversations are put together first: a distinct sequence has a weight (its conversations), a least
one, and a list of those that end there. Only distinct sequences are cut into prefixes; a sequence that
is a proper prefix of another one is no leaf (an anti-join), and nodes are sums over weighted prefixes.
Prefixes are known by sums of their turns' digests, so they need neither chains of hashes nor texts.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written
from .order import looked_up, placed, running

#: a turn's digest at its depth as four numbers of 32 bits; sums of 2^31 turns fit into a long
LANES = ["_l0", "_l1", "_l2", "_l3"]
#: width of the ranges of ids in which lists of ends are put together
ENDS = 65_536


def turns_of(rows: DataFrame) -> DataFrame:
    """(conv_id, place, digest, bytes) of rows conv_id, turn, role, text: places 1, 2, … by turn, nulls first; rows of a
    turn come in order of a digest of role and text. Null roles and texts are empty; rows without conv_id are left out."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    lean = rows.filter("conv_id is not null").select("conv_id", "turn", digest.alias("digest"), F.octet_length(text).cast("bigint").alias("bytes"))
    each = lean.groupBy("conv_id", "turn", "digest", "bytes").agg(F.count("*").alias("_n"))
    at = placed(each, ["conv_id"], ["turn", "digest"], F.col("_n"), "_first")
    return at.select("conv_id", F.explode(F.sequence(F.col("_first"), F.col("_first") + F.col("_n") - 1)).alias("place"), "digest", "bytes")


def _prefixes(turns: DataFrame) -> DataFrame:
    """turns (conv_id, place, digest, bytes) with LANES: the sums that stand for the turns up to each one."""
    lane = F.md5(F.concat(F.col("place").cast("string"), F.lit(":"), F.col("digest")).cast("binary"))
    lanes = turns.withColumn("_d", lane).select("conv_id", "place", "bytes", *[F.conv(F.substr("_d", F.lit(8 * k + 1), F.lit(8)), 16, 10).cast("bigint").alias(f"_x{k}") for k in range(4)])
    return running(lanes, ["conv_id"], "place", {f"_x{k}": LANES[k] for k in range(4)}).select("conv_id", "place", "bytes", *LANES)


def _joined(batches):
    """Blocks of a list, in order, to the digest of the whole list."""
    key, digest = None, None
    for batch in batches:
        keys, found = [], []
        for k, text in zip(zip(*(batch.column(n).to_pylist() for n in ("place", *LANES))), batch.column("ids").to_pylist()):
            if k != key:
                if key is not None:
                    keys.append(key)
                    found.append(digest.hexdigest())
                key, digest = k, hashlib.sha256(text.encode())
            else:
                digest.update(b"," + text.encode())
        if keys:
            yield _hashes(keys, found)
    if key is not None:
        yield _hashes([key], [digest.hexdigest()])


def _hashes(keys: list[tuple], found: list[str]) -> pa.RecordBatch:
    cols = [pa.array(x, pa.int64()) for x in zip(*keys)]
    return pa.RecordBatch.from_arrays([*cols, pa.array(found)], ["place", *LANES, "ends_sha256"])


def _ends(whole: DataFrame) -> DataFrame:
    """(place, LANES, ends_sha256) of the conversations that end at each sequence, ids in ascending order.

    Ids are put together in ranges, before they are shuffled as well; only a sequence with ends in several
    ranges is hashed range after range."""
    at = ["place", *LANES]
    blocks = whole.groupBy(*at, F.floor(F.col("conv_id") / ENDS).alias("_range")).agg(F.collect_list("conv_id").alias("ids"))
    blocks = blocks.select(*at, "_range", F.array_join(F.sort_array("ids").cast("array<string>"), ",").alias("ids"))
    blocks = blocks.withColumn("_several", F.count("*").over(Window.partitionBy(*at)) > 1)  # as many rows as ranges of ids
    one = blocks.filter("not _several").select(*at, F.sha2(F.col("ids").cast("binary"), 256).alias("ends_sha256"))
    more = blocks.filter("_several").repartition(*at).sortWithinPartitions(*at, "_range").select(*at, "ids")
    schema = T.StructType([*[T.StructField(n, T.LongType()) for n in at], T.StructField("ends_sha256", T.StringType())])
    return one.unionByName(more.mapInArrow(_joined, schema))


def _block(place: str = "place") -> Column:
    return F.floor(F.col(place) / 4096)


def trie(sequences: DataFrame, ids: DataFrame) -> DataFrame:
    """The nodes of the trie of sequences.

    sequences: conv_id, place (1, 2, …), digest, bytes of each turn; ids: conv_id of every conversation, those
    without turns too. Per node: conv_id (the least member), depth, parent_conv_id (null at the root), n_convs,
    n_children, n_leaves, saved_tokens (over the subtree, what its members but one need not store of each
    node's last text, in bytes), ends_sha256 (of the ids of the members that end there, in ascending order).
    No conversations: no nodes.
    """
    at, none = ["place", *LANES], F.lit(0).cast("bigint")
    turns = written(_prefixes(sequences), "prefixes")
    # whole sequences: a conversation's last prefix, the root where it has none
    last = turns.groupBy("conv_id").agg(F.max_by(F.struct(*at), "place").alias("_last"))
    whole = ids.distinct().join(last, "conv_id", "left").select("conv_id", *[F.coalesce(F.col("_last")[c], none).alias(c) for c in at])
    whole = written(whole, "whole")
    distinct = written(whole.groupBy(*at).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("weight")), "sequences")
    # prefixes of the distinct sequences, the root included
    one = distinct.select("conv_id", "weight", F.col("place").alias("_n"))
    path = looked_up(turns, one, ["conv_id"], _block()).filter("weight is not null")
    root = one.select("conv_id", none.alias("place"), none.alias("bytes"), *[none.alias(c) for c in LANES], "weight", "_n")
    path = written(path.unionByName(root), "paths")
    leaves = distinct.join(path.filter("place < _n").select(*at).distinct(), at, "left_anti").select("conv_id", F.lit(1).alias("leaf"))
    path = written(looked_up(path, leaves, ["conv_id"], _block()).fillna({"leaf": 0}), "weighted")
    nodes = path.groupBy(*at).agg(F.min("conv_id").alias("conv_id"), F.sum("weight").alias("n_convs"), F.sum("leaf").alias("n_leaves"), F.max("bytes").alias("bytes"))
    # a node's parent is the prefix before it of its least member
    before = path.select("conv_id", (F.col("place") + 1).alias("place"), *[F.col(c).alias(f"_p{c}") for c in LANES])
    nodes = written(nodes.join(before, ["conv_id", "place"], "left"), "nodes")
    # what a node saves goes to its least member's sequence, and from there to all prefixes of that sequence
    gains = nodes.select("conv_id", "place", ((F.col("n_convs") - 1) * F.col("bytes")).alias("gain"))
    gained = path.select("conv_id", *at).join(gains, ["conv_id", "place"], "left").fillna({"gain": 0})
    saved = running(gained, ["conv_id"], "place", {"gain": "_below"}, down=True).groupBy(*at).agg(F.sum("_below").alias("saved_tokens"))
    return _named(nodes).join(saved, at).join(_ends(whole), at, "left").select(
        "conv_id", F.col("place").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))


def _named(nodes: DataFrame) -> DataFrame:
    """nodes with parent_conv_id and n_children. Children meet their parent in 64 shares, as a parent may have very many."""
    share = F.pmod(F.xxhash64("conv_id"), F.lit(64))
    up = [f"_p{c}" for c in LANES]
    parents = nodes.select("place", *LANES, F.col("conv_id").alias("parent_conv_id")).withColumn("_up", F.col("place")).drop("place").withColumnsRenamed(dict(zip(LANES, up)))
    named = looked_up(nodes.filter("place > 0").withColumn("_up", F.col("place") - 1), parents, ["_up", *up], share)
    count = named.groupBy(F.col("_up").alias("place"), *[F.col(u).alias(c) for u, c in zip(up, LANES)]).agg(F.count("*").alias("n_children"))
    found = named.drop("_up", *up).unionByName(nodes.filter("place = 0").drop(*up).withColumn("parent_conv_id", F.lit(None).cast("bigint")))
    return found.join(count, ["place", *LANES], "left").fillna({"n_children": 0})
