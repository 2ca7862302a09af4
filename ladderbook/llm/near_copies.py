"""Near copies: SimHash links first, then every other pair whose sets of word runs are similar enough.

A text is the set of the hashes of its runs of five words; texts are linked whose sets have a Jaccard
similarity of 0.8 or more.

1. `_sets`, a scan: each row's set number, SimHash fingerprint and prefix. All sets are ordered alike,
   rare hashes first; two similar sets then share a hash of the first fifth of either, their prefix.
   Which hashes are common is first told from a sample and then, by exact counts, from the prefixes
   themselves; that changes how many sets meet, never a result.
2. `_meetings`: the prefix hashes that several sets share. Two similar sets have a number of prefix
   hashes in common that follows from their sizes; sets that can't have as many with any set they
   meet (`_viable`) have no near copy and drop out before whole sets are moved.
3. Fingerprints within 3 bits are linked by the tiled comparison of simhash, and these links are
   decided by the whole sets.
4. `_probed`, once or twice: sets with a prefix hash in common come together with their whole sets, each compared
   with a few others that it isn't linked with yet. This joins large groups by few comparisons.
5. `_across`: a set and a larger group that it isn't in meet if the set and the group's members share as many
   prefix hashes as similar sets must have. `_settled` compares the set with the group's members. Nothing is missed,
   and the rows made grow with sets and groups, not with the pairs of their members.

Links of step 3 are decided in the cells of a grid (`_links`): a set is sent once to each cell that has pairs
of it, not once a pair, and a cell leaves out pairs of groups that it has joined already.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import packed, raw_bytes, released, slices, text_array, trimmed, unpacked, written
from .simhash import SEED, components, links, majority, shingle_hashes

WORDS = 5
PART, WHOLE = 4, 5  # the least similarity as a fraction
SLICE = 1 << 20  # bytes of text that become sets at a time
SAMPLE = 5_000  # sets that common hashes are first told from
COMMON = 4  # sets of the sample that share a common hash
TURNS = 3  # scans that tell common hashes at most
MOST = 1_000_000  # common hashes that are told apart, 16 bytes each
STEP = 256  # members of a group that a set is compared with at a time
MEET = 512  # sets that may share a prefix hash before it counts as common, more on large tables (see _hot)
HASHES = 200_000  # prefix hashes of a partition
HEAP = 4096  # entries of one hash that a task takes
ENTRIES = 1 << 15  # entries of the keys that share a home
TILE = 512  # sets of a meeting compared at a time
PAIRS = 1 << 20  # pairs that a task holds
PROBES = 3  # comparisons of a set in one round of probing
AHEAD = 48  # sets behind it among which it looks for them
TOGETHER = 1 << 18  # hashes of the sets that are probed together
ROUNDS = 2  # of probing at most, the second if the first joined much
_SET = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("set_id", pa.int64()), ("fp", pa.int64()), ("n", pa.int32()), ("prefix", pa.binary())])
_BODY = pa.schema([("set_id", pa.int64()), ("hashes", pa.binary())])
_BLOCK = pa.schema([("bucket", pa.int32()), ("payload", pa.binary())])
_MET = pa.schema([("key", pa.int64()), ("set_id", pa.int64()), ("n", pa.int32()), ("need", pa.int32()), ("often", pa.bool_())])
_NEAR = pa.schema([("set_id", pa.int64()), ("n", pa.int32()), ("root", pa.int64()), ("group", pa.int64()), ("common", pa.int64()), ("need", pa.int64())])
_EDGE = pa.schema([("u", pa.int64()), ("v", pa.int64())])
_SET_SQL, _BODY_SQL, _BLOCK_SQL = "doc_id bigint, row bigint, set_id bigint, fp bigint, n int, prefix binary", "set_id bigint, hashes binary", "bucket int, payload binary"
_MET_SQL, _EDGE_SQL = "key bigint, set_id bigint, n int, need int, often boolean", "u bigint, v bigint"
_NEAR_SQL = "set_id bigint, n int, root bigint, `group` bigint, common bigint, need bigint"
ENTRY = {"key": "i8", "set_id": "i8", "n": "i4"}


def _hashed(batch, column: str = "text"):
    """(rows i to j, the hashes of each) slice by slice."""
    body, offsets = raw_bytes(text_array(batch.column(column)))
    view = memoryview(body)
    for i, j in slices(offsets, SLICE):
        yield i, j, [shingle_hashes(bytes(view[offsets[r] : offsets[r + 1]]), WORDS) for r in range(i, j)]


def _unique(hashes: list[int]) -> np.ndarray:
    return np.unique(np.array(hashes, np.uint64))


def _number(s: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(s.tobytes(), SEED)


def _ranked(h: np.ndarray, common: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The hashes in the order that all sets share: the rare ones by their value, then the common ones by how common they are."""
    if not len(common) or not len(h):
        return h
    at = np.minimum(np.searchsorted(common, h), len(common) - 1)
    return h[np.argsort(np.where(common[at] == h, rank[at], 0), kind="stable")]


def _sets(shared):
    def run(batches):
        common, rank = shared.value
        for batch in trimmed(batches):
            for i, j, hashes in _hashed(batch):
                prints = majority(hashes)
                sets = [_unique(h) for h in hashes]
                n = np.array([len(s) for s in sets], np.int64)
                first = n - (PART * n + WHOLE - 1) // WHOLE + 1
                prefix = [_ranked(s, common, rank)[:k].tobytes() if len(s) else b"" for s, k in zip(sets, first.tolist())]
                ids = np.array([_number(s) for s in sets], np.uint64).view(np.int64)
                cols = [batch.column(c).slice(i, j - i) for c in ("doc_id", "row")] + [pa.array(ids), pa.array(prints.view(np.int64)), pa.array(n, pa.int32()), pa.array(prefix, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, schema=_SET)

    return run


def _bodies(batches):
    for batch in trimmed(batches):
        for _, _, hashes in _hashed(batch):
            sets = [_unique(h) for h in hashes]
            ids = np.array([_number(s) for s in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([s.tobytes() for s in sets], pa.binary())], schema=_BODY)


def _keys(batches):
    for batch in batches:
        for _, _, hashes in _hashed(batch):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([_unique(h) for h in hashes]).view(np.int64))], names=["key"])


def _entries(shared, buckets: int):
    """Prefix hashes by bucket. Common ones are dealt out by their set: they meet for certain."""

    def run(batches):
        common, _ = shared.value
        seen: set[int] = set()
        for batch in batches:
            ids, n = batch.column("set_id").to_numpy(), batch.column("n").to_numpy()
            body, offsets = raw_bytes(batch.column("prefix"))
            fresh = np.array([k not in seen and not seen.add(k) for k in ids.tolist()], bool)
            sizes = np.diff(offsets) // 8
            key = np.frombuffer(body.tobytes(), np.uint64)
            some = np.repeat(fresh, sizes)
            key, owner = key[some], np.repeat(np.arange(len(ids)), sizes)[some]
            if len(seen) > PAIRS:
                seen.clear()
            deal = key
            if len(common) and len(key):
                place = np.minimum(np.searchsorted(common, key), len(common) - 1)
                deal = np.where(common[place] == key, ids[owner].view(np.uint64), key)
            bucket = (deal % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cols = {"key": key.view(np.int64)[order], "set_id": ids[owner][order], "n": n[owner][order].astype("i4")}
            cut = np.flatnonzero(np.r_[len(order) > 0, np.diff(bucket[order]) != 0])
            rows = [(int(bucket[order[i]]), packed(**{c: x[i:j] for c, x in cols.items()})) for i, j in zip(cut.tolist(), np.r_[cut[1:], len(order)].tolist())] if len(order) else []
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_BLOCK)], schema=_BLOCK)

    return run


def _sorted(cols: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The columns by key, size and set, each set once, and where keys start."""
    order = np.lexsort((cols["set_id"], cols["n"], cols["key"]))
    cols = {c: x[order] for c, x in cols.items()}
    fresh = np.r_[len(order) > 0, (np.diff(cols["key"]) != 0) | (np.diff(cols["set_id"]) != 0)][: len(order)]
    cols = {c: x[fresh] for c, x in cols.items()}
    key = cols["key"]
    return cols, np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)


def _least_common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many prefix hashes similar sets of these sizes have in common at least: those up to the end of
    the prefix that ends first are in both prefixes, and the rest of that set can hold no more than its size."""
    both, most = a + b, np.maximum(a, b)
    return (PART * both + PART + WHOLE - 1) // (PART + WHOLE) - ((PART * most + WHOLE - 1) // WHOLE - 1)


def _needs(cols: dict[str, np.ndarray], cut: np.ndarray) -> np.ndarray:
    """Per entry, the least number of common prefix hashes that would do with one of the sets it meets; 0 if none is of a like size."""
    n = cols["n"].astype(np.int64)
    wide = 4 * int(n.max(initial=1)) + 8
    base = np.repeat(np.arange(len(cut)), np.diff(np.r_[cut, len(n)])) * wide
    own = np.arange(len(n))
    low = np.searchsorted(base + n, base + (PART * n + WHOLE - 1) // WHOLE)
    high = np.searchsorted(base + n, base + WHOLE * n // PART, "right") - 1
    # the bound is greatest for equal sizes and falls on either side, so that the outermost partners decide
    need = np.full(len(n), np.iinfo(np.int32).max, np.int64)
    for partner in (low, high):
        some = partner != own
        need[some] = np.minimum(need[some], np.maximum(1, _least_common(n[some], n[partner[some]])))
    return np.where(need == np.iinfo(np.int32).max, 0, need)


def _renewed(batches):
    """met with the needs among the sets that are left."""
    found = [b for b in batches if b.num_rows]
    if found:
        t = pa.Table.from_batches(found)
        cols, cut = _sorted({f.name: t.column(f.name).to_numpy() for f in _MET})
        cols["need"] = _needs(cols, cut)
        kept = cols["need"] > 0
        yield pa.RecordBatch.from_arrays([pa.array(cols[f.name][kept], f.type) for f in _MET], schema=_MET)


def _viable(met: DataFrame) -> DataFrame:
    """Sets (set_id, n) with as many meetings as one of the sets met there asks for: for some count, so many need no more."""
    needs = met.groupBy("set_id").agg(F.min("n").alias("n"), F.sort_array(F.collect_list("need")).alias("needs"))
    return needs.filter("exists(sequence(0, size(needs) - 1), i -> needs[i] <= i + 1)").select("set_id", "n")


def _meetings(shared):
    """Entries whose hash is in the prefix of more than one set of a like size, or common."""

    def run(batches):
        common, _ = shared.value
        found = [unpacked(x, ENTRY) for batch in batches for x in batch.column("payload").to_pylist()]
        if not found:
            return
        cols, cut = _sorted({c: np.concatenate([f[c] for f in found]) for c in ENTRY})
        del found
        cols["need"] = _needs(cols, cut)
        cols["often"] = np.zeros(len(cols["key"]), bool)
        if len(common):  # whom these meet isn't known here
            key = cols["key"].view(np.uint64)
            cols["often"] = common[np.minimum(np.searchsorted(common, key), len(common) - 1)] == key
            cols["need"][cols["often"]] = 1
        kept = cols["need"] > 0
        yield pa.RecordBatch.from_arrays([pa.array(cols[f.name][kept], f.type) for f in _MET], schema=_MET)

    return run


def _similar(x: np.ndarray, y: np.ndarray) -> bool:
    both = len(x) + len(y)
    if WHOLE * min(len(x), len(y)) < PART * max(len(x), len(y)):
        return False
    together = np.concatenate([x, y])
    together.sort()
    common = int((together[1:] == together[:-1]).sum())
    return WHOLE * common >= PART * (both - common)


class _Groups:
    """Connected groups 0..n-1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def top(self, k: int) -> int:
        up = self.up
        while up[k] != k:
            up[k] = up[up[k]]
            k = up[k]
        return k

    def join(self, a: int, b: int) -> None:
        self.up[max(a, b)] = min(a, b)

    def edges(self, ids: np.ndarray) -> list[pa.Array]:
        """Columns u and v: each group that was joined with one of a smaller number, by its id."""
        tops = np.array([self.top(k) for k in range(len(ids))], np.int64)
        moved = np.flatnonzero(tops != np.arange(len(ids)))
        return [pa.array(ids[moved]), pa.array(ids[tops[moved]])]


def _probed(batches):
    """Edges between the groups of sets that stand together (bodies with root and spot, in order of spot)."""
    found = [b for b in batches if b.num_rows]
    if not found:
        return
    table = pa.Table.from_batches(found)
    spot, root, n = (table.column(c).to_numpy() for c in ("spot", "root", "n"))
    order = np.lexsort((table.column("mark").to_numpy(), n, spot))
    spot, root, n = spot[order], root[order], n[order]
    ids, local = np.unique(root, return_inverse=True)
    body, offsets = raw_bytes(text_array(table.column("hashes")))
    sets = lambda i: np.frombuffer(body[offsets[order[i]] : offsets[order[i] + 1]].tobytes(), np.uint64)
    groups, many = _Groups(len(ids)), len(spot)
    differ = np.r_[(spot[1:] == spot[:-1]) & (root[1:] != root[:-1]), False]
    busy = np.unique(spot[np.flatnonzero(differ)])
    for i in np.flatnonzero(np.isin(spot, busy)).tolist():
        mine, tried = None, 0
        for j in range(i + 1, min(many, i + AHEAD)):
            if spot[j] != spot[i] or tried == PROBES or WHOLE * n[i] < PART * n[j]:
                break
            a, b = groups.top(local[i]), groups.top(local[j])
            if a == b:
                continue
            mine = sets(i) if mine is None else mine
            tried += 1
            if _similar(mine, sets(j)):
                groups.join(a, b)
    yield pa.RecordBatch.from_arrays(groups.edges(ids), schema=_EDGE)


def _merged(rows: np.ndarray, once: bool) -> np.ndarray:
    """Rows (set, n, root, group, common, need), one for each set and group: the least need, and the sum of common or, if once, 1."""
    rows = rows[np.lexsort((rows[:, 3], rows[:, 0]))]
    first = np.flatnonzero(np.r_[True, (rows[1:, 0] != rows[:-1, 0]) | (rows[1:, 3] != rows[:-1, 3])])
    common = np.ones(len(first), np.int64) if once else np.add.reduceat(rows[:, 4], first)
    return np.column_stack([rows[first, :4], common, np.minimum.reduceat(rows[:, 5], first)])


def _across(batches):
    """Sets and the larger groups whose members they meet: in how many of the task's meetings, and the least count that would do.

    A meeting counts once for a set and a group, however many members are in it. side: 0 all of the
    task's entries meet, 1 and 2 only those of different sides. A set's `total` is that of its entries
    anywhere: where even all those that aren't here could not make up for what is missing, the set and the
    group go no further. Entries of split keys don't count as being here, as other tasks have them too.
    """
    found = [b for b in batches if b.num_rows]
    if not found:
        return
    t = pa.Table.from_batches(found)
    c, cut = _sorted({x: t.column(x).to_numpy() for x in ("key", "set_id", "n", "root", "size", "side", "total", "split")})
    sets, first, inverse = np.unique(c["set_id"], return_index=True, return_inverse=True)
    elsewhere = c["total"][first] - np.bincount(inverse, ~c["split"], len(sets)).astype(np.int64)
    c["n"] = c["n"].astype(np.int64)
    low, high = np.minimum.reduceat(c["root"], cut), np.maximum.reduceat(c["root"], cut)
    ends = np.r_[cut[1:], len(c["key"])]
    held, size, whole = [], 0, True

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows[:, k]), f.type) for k, f in enumerate(_NEAR)], schema=_NEAR)

    for k in np.flatnonzero(low != high).tolist():
        met = []
        for i in range(cut[k], ends[k], TILE):
            a = np.arange(i, min(i + TILE, ends[k]))
            for j in range(i, ends[k], TILE):
                if PART * int(c["n"][j]) > WHOLE * int(c["n"][a[-1]]):
                    break
                b = np.arange(j, min(j + TILE, ends[k]))
                fits = (a[:, None] < b[None, :]) & (c["root"][a][:, None] != c["root"][b][None, :])
                fits &= (c["side"][a][:, None] != c["side"][b][None, :]) | (c["side"][a] == 0)[:, None]
                fits &= PART * c["n"][b][None, :] <= WHOLE * c["n"][a][:, None]
                x, y = np.nonzero(fits)
                if len(x):
                    x, y = a[x], b[y]
                    turn = (c["size"][x] > c["size"][y]) | ((c["size"][x] == c["size"][y]) & (c["root"][x] > c["root"][y]))
                    x, y = np.where(turn, y, x), np.where(turn, x, y)
                    need = np.maximum(1, _least_common(c["n"][x], c["n"][y]))
                    met.append(_merged(np.column_stack([c["set_id"][x], c["n"][x], c["root"][x], c["root"][y], np.ones(len(x), np.int64), need]), True))
        if met:
            held.append(_merged(np.concatenate(met), True))
            size += len(held[-1])
        if size > PAIRS:
            held = [_merged(np.concatenate(held), False)]
            size = len(held[0])
            if size > PAIRS // 2:
                yield batch(held[0])
                held, size, whole = [], 0, False
    if held:
        rows = _merged(np.concatenate(held), False)
        if whole:
            rows = rows[rows[:, 4] + elsewhere[np.searchsorted(sets, rows[:, 0])] >= rows[:, 5]]
        yield batch(rows)


def _settled(batches):
    """Edges between sets' groups and the groups that they were sent to, if a member is similar enough (rows of a spot: side 1 its members)."""
    found = [b for b in batches if b.num_rows]
    if not found:
        return
    t = pa.Table.from_batches(found)
    c = {x: t.column(x).to_numpy() for x in ("spot", "side", "n", "root", "group")}
    body, offsets = raw_bytes(text_array(t.column("hashes")))
    order = np.lexsort((c["n"], -c["side"], c["group"], c["spot"]))
    roots, local = np.unique(np.concatenate([c["root"], c["group"]]), return_inverse=True)
    own, other = local[: len(order)], local[len(order) :]
    sets = lambda i: np.frombuffer(body[offsets[i] : offsets[i + 1]].tobytes(), np.uint64)
    groups = _Groups(len(roots))
    spot, group = c["spot"][order], c["group"][order]
    cut = np.flatnonzero(np.r_[True, (spot[1:] != spot[:-1]) | (group[1:] != group[:-1])])
    for i, j in zip(cut.tolist(), np.r_[cut[1:], len(order)].tolist()):
        many = int(c["side"][order[i:j]].sum())
        members, sizes = [sets(k) for k in order[i : i + many]], c["n"][order[i : i + many]].astype(np.int64)
        for k in order[i + many : j].tolist():
            if groups.top(own[k]) == groups.top(other[k]):
                continue
            mine = sets(k)
            low = int(np.searchsorted(WHOLE * sizes, PART * len(mine)))
            high = int(np.searchsorted(PART * sizes, WHOLE * len(mine), "right"))
            for at in range(low, high, STEP):
                n = sizes[at : min(at + STEP, high)]
                all_ = np.concatenate(members[at : at + len(n)])
                same = mine[np.minimum(np.searchsorted(mine, all_), len(mine) - 1)] == all_
                common = np.add.reduceat(same.astype(np.int64), np.cumsum(n) - n)
                if (WHOLE * common >= PART * (len(mine) + n - common)).any():
                    groups.join(groups.top(own[k]), groups.top(other[k]))
                    break
    yield pa.RecordBatch.from_arrays(groups.edges(roots), schema=_EDGE)


def _settling(near: DataFrame, roots: DataFrame, bodies: DataFrame, parts: int) -> DataFrame:
    """Edges between groups, of all (set, group) in near whose set is similar enough to a member of the group.

    A group's members and the sets that meet it come together in spots of at most about TOGETHER hashes of either.
    """
    heft = roots.groupBy("root").agg(F.sum("n").alias("heft"))
    room = near.groupBy("group").agg(F.sum("n").alias("room"))
    cells = room.join(heft.hint("merge"), F.col("group") == F.col("root"))
    cells = written(cells.select(F.col("group").alias("g"), F.ceil(F.col("room") / TOGETHER).cast("int").alias("chunks"), F.ceil(F.col("heft") / TOGETHER).cast("int").alias("shares")), "cells")
    dealt = lambda many: F.pmod(F.xxhash64("set_id"), many).cast("int")
    every = lambda many: F.explode(F.sequence(F.lit(0), F.col(many) - 1))
    sent = near.join(cells.hint("merge"), F.col("group") == F.col("g")).select("g", "set_id", "n", "root", F.lit(0).alias("side"), dealt(F.col("chunks")).alias("chunk"), every("shares").alias("share"))
    members = roots.join(cells.hint("merge"), F.col("root") == F.col("g")).select("g", "set_id", "n", "root", F.lit(1).alias("side"), dealt(F.col("shares")).alias("share"), every("chunks").alias("chunk"))
    both = sent.unionByName(members).select("set_id", "n", "root", F.col("g").alias("group"), "side", F.xxhash64("g", "chunk", "share").alias("spot"))
    both = both.join(bodies.hint("merge"), "set_id").select("spot", "side", "n", "root", "group", "hashes")
    return written(both.repartition(parts, "spot").mapInArrow(released(_settled), _EDGE_SQL).distinct(), "edges")


def _decided(pairs: pa.Table, bodies: pa.Table) -> pa.Table:
    """Edges between the groups of a cell's pairs whose whole sets are similar enough."""
    c = {x: pairs.column(x).to_numpy() for x in ("u", "v", "ru", "rv", "common")}
    ids = bodies.column("set_id").to_numpy()
    body, offsets = raw_bytes(text_array(bodies.column("hashes")))
    order = np.argsort(ids)
    at = {x: order[np.searchsorted(ids, c[x], sorter=order)] for x in "uv"}
    sets = lambda i: np.frombuffer(body[offsets[i] : offsets[i + 1]].tobytes(), np.uint64)
    roots, local = np.unique(np.concatenate([c["ru"], c["rv"]]), return_inverse=True)
    ru, rv = local[: len(c["u"])], local[len(c["u"]) :]
    groups, last = _Groups(len(roots)), (-1, None)
    # the likeliest pair of two groups first, and the pairs of one set one after another
    for k in np.lexsort((at["v"], at["u"], -c["common"])).tolist():
        a, b = groups.top(ru[k]), groups.top(rv[k])
        if a == b:
            continue
        if last[0] != at["u"][k]:
            last = (at["u"][k], sets(at["u"][k]))
        if _similar(last[1], sets(at["v"][k])):
            groups.join(a, b)
    return pa.Table.from_arrays(groups.edges(roots), schema=_EDGE)


def _links(pairs: DataFrame, bodies: DataFrame, parts: int, what: str) -> DataFrame:
    """Edges that join the groups ru and rv of all pairs (u, v, nu, nv, ru, rv, common) whose whole sets are similar enough.

    Cells of a grid over u and v hold even shares of the pairs, whatever group they are of, and their sets.
    """
    size = pairs.agg(F.sum(F.col("nu").cast("bigint") + F.col("nv")).alias("hashes")).first()["hashes"] or 0
    wide = math.isqrt(max(parts, size // (4 * TOGETHER)) - 1) + 1
    dealt = pairs.withColumn("cell", F.pmod(F.xxhash64("u"), F.lit(wide)) * wide + F.pmod(F.xxhash64("v"), F.lit(wide)))
    wanted = [dealt.select("cell", F.col(x).alias("set_id")).distinct() for x in "uv"]
    sent = wanted[0].unionByName(wanted[1]).distinct().join(bodies.hint("merge"), "set_id")
    found = dealt.select("cell", "u", "v", "ru", "rv", "common").groupBy("cell").cogroup(sent.select(F.col("cell").alias("place"), "set_id", "hashes").groupBy("place"))
    return written(found.applyInArrow(_decided, _EDGE_SQL).distinct(), what)


def _moved(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """roots (set_id, n, root) after the edges between roots."""
    tree = components(edges)
    return written(roots.join(tree.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left").select("set_id", "n", F.coalesce("to", "root").alias("root")), "roots")


def _tiles(placed: DataFrame) -> DataFrame:
    """placed (key, set_id, n, root, size, total) of the keys that several groups share, with the task key, side and home, and
    whether the key is split.

    The most frequent group of a key with over HEAP entries is dealt out in parts that meet the
    others, but not each other. Other keys of one most frequent group (of equally frequent ones that of the
    largest number, so that keys of the same sets agree on it) share a home, up to ENTRIES entries of them:
    a pair meets under many such keys, and a task adds its meetings up.
    """
    groups = placed.groupBy("key", "root").agg(F.count("*").alias("c"))
    keys = groups.groupBy("key").agg(F.count("*").alias("groups"), F.sum("c").alias("all"), F.max("c").alias("largest"), F.max_by("root", F.struct("c", "root")).alias("major")).filter("groups > 1")
    keys = written(keys.selectExpr("key", "major", "all", f"cast(ceil(largest / {HEAP}) as int) as major_parts", f"cast(ceil((all - largest) / {HEAP}) as int) as minor_parts"), "keys")
    room = keys.groupBy("major").agg(F.ceil(F.sum("all") / ENTRIES).alias("homes"))
    both = placed.join(keys.join(room.hint("merge"), "major").hint("merge"), "key")
    home = F.xxhash64("major", F.pmod("key", "homes"))
    small = both.filter(F.col("all") <= HEAP).select("key", "set_id", "n", "root", "size", "total", F.lit(0).alias("side"), home.alias("home"), F.lit(False).alias("split"))
    hot = keys.filter(F.col("all") > HEAP)
    own = hot.select("key", F.explode(F.expr("concat(sequence(0, major_parts - 1), transform(sequence(0, minor_parts - 1), p -> 1048576 + p))")).alias("tile"))
    pairs = own.join(own.withColumnRenamed("tile", "tile2"), "key").filter("tile >= 1048576 or tile2 >= 1048576")
    pairs = pairs.selectExpr("key as value", "tile", "xxhash64(key, least(tile, tile2), greatest(tile, tile2)) as task", "cast(if(tile = tile2, 0, if(tile < tile2, 1, 2)) as int) as side")
    tile = F.expr("cast(if(root = major, pmod(xxhash64(set_id), major_parts), 1048576 + pmod(xxhash64(set_id), minor_parts)) as int)")
    large = both.filter(F.col("all") > HEAP).select(F.col("key").alias("value"), "set_id", "n", "root", "size", "total", tile.alias("tile"))
    large = large.join(pairs, ["value", "tile"]).select(F.col("task").alias("key"), "set_id", "n", "root", "size", "total", "side", F.col("task").alias("home"), F.lit(True).alias("split"))
    return small.unionByName(large)


def _probing(met: DataFrame, roots: DataFrame, bodies: DataFrame, turn: int, parts: int) -> DataFrame:
    """Edges between groups found by comparing some of the sets that share a prefix hash."""
    placed = met.join(roots.select("set_id", "root"), "set_id")
    mixed = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("key")
    homes = placed.join(mixed.hint("merge"), "key").groupBy("set_id").agg(F.min_by("key", F.xxhash64(F.lit(turn), "key")).alias("home"), F.min("root").alias("root"), F.min("n").alias("n"))
    homes = written(homes, "homes")
    room = homes.groupBy("home").agg(F.sum("n").alias("room"), F.count("*").alias("many")).filter("many > 1")
    mark = F.xxhash64(F.lit(turn), "set_id")
    spots = homes.join(room.hint("merge"), "home").select("set_id", "root", "n", F.xxhash64("home", F.pmod(mark, F.ceil(F.col("room") / TOGETHER))).alias("spot"), mark.alias("mark"))
    return written(spots.join(bodies.hint("merge"), "set_id").repartition(parts, "spot").mapInArrow(released(_probed), _EDGE_SQL).distinct(), "edges")


def _hot(met: DataFrame, entries: int, common: np.ndarray):
    """Hashes beyond the common ones that more sets share in their prefixes than may; at most as many as MOST."""
    most = max(MEET, entries // MOST)
    found = met.groupBy("key").agg(F.count("*").alias("c")).filter(F.col("c") > most).toArrow()
    key, count = found.column("key").to_numpy().view(np.uint64), found.column("c").to_numpy()
    new = ~np.isin(key, common)
    return key[new], count[new]


def _told(spark, lean: DataFrame, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes that are common in a sample of the rows, and how common among all."""
    share = min(1.0, SAMPLE / max(1, rows))
    some = lean.filter(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < F.lit(int(share * 1_000_000))).select("text").dropDuplicates()
    often = some.mapInArrow(_keys, "key bigint").groupBy("key").count().filter(F.col("count") >= COMMON).orderBy(F.desc("count"), "key").limit(MOST).toArrow()
    key, count = often.column("key").to_numpy().view(np.uint64), often.column("count").to_numpy()
    return key, (count / share).astype(np.int64)


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: the id, row (a hash of id and text), component_id (the least id reachable over links)
    and lead (the row that stands for the group: that of the least id, rows without an id last).

    Texts are linked whose sets of five-word runs (of lower-cased words; the whole text if it is
    shorter) have a Jaccard similarity of 0.8 or more; texts without words, null ones too, are equal. A
    null id takes part, but gives no component id unless all ids that it reaches are null. Repeated
    rows get one result each, with one `row`. Other columns are not looked at. An empty table gives an
    empty result.
    """
    spark = docs.sparkSession
    lean = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    lean = lean.withColumn("row", row_hash("doc_id", "text"))
    least_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    common, rank = _told(spark, lean, lean.count())
    for turn in range(TURNS):
        order = np.argsort(common)
        shared = spark.sparkContext.broadcast((common[order], rank[order]))
        sets = written(lean.mapInArrow(_sets(shared), _SET_SQL), "sets")
        entries = sets.agg(F.sum(F.octet_length("prefix")).alias("n")).first()["n"] or 0
        entries //= 8
        parts = max(least_parts, entries // HASHES)
        dealt = sets.select("set_id", "n", "prefix").mapInArrow(released(_entries(shared, parts)), _BLOCK_SQL)
        met = written(dealt.repartition(parts, "bucket").mapInArrow(released(_meetings(shared)), _MET_SQL), "met")
        if turn == TURNS - 1:
            break  # keys that are common still are split by _tiles
        key, count = _hot(met, entries, common)
        if not len(key):
            break
        common, rank = np.concatenate([common, key]), np.concatenate([rank, count])
    first = F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("k"), "row")
    distinct = written(sets.groupBy("set_id").agg(F.min("doc_id").alias("least"), F.min("fp").alias("fp"), F.min(first).alias("first")), "distinct")
    for _ in range(2):  # whoever drops out leaves the others fewer sets to meet
        left = met.join(_viable(met).select("set_id").hint("merge"), "set_id", "left_semi").select(*_MET.names)
        met = written(left.filter("not often").repartition(parts, "key").mapInArrow(released(_renewed), _MET_SQL).unionByName(left.filter("often")), "met")
    roots = written(_viable(met).withColumn("root", F.col("set_id")), "roots")
    wanted = distinct.join(roots.select("set_id").hint("merge"), "set_id", "left_semi").select(F.col("first.row").alias("row"))
    texts = lean.select("row", "text").join(wanted.hint("merge"), "row", "left_semi").dropDuplicates(["row"])
    bodies = written(texts.mapInArrow(_bodies, _BODY_SQL), "bodies")
    # links between fingerprints, as pairs of the sets that stand for them
    prints = distinct.join(roots.select("set_id", "n").hint("merge"), "set_id").select("set_id", "n", "fp")
    stands = written(prints.groupBy("fp").agg(F.min(F.struct("set_id", "n")).alias("s")).select("fp", F.col("s.set_id").alias("s"), F.col("s.n").alias("ns")), "prints")
    near = links(stands.select("fp"), stands.count(), least_parts)
    for x in "uv":
        near = near.join(stands.select(F.col("fp").alias(x), F.col("s").alias(f"s{x}"), F.col("ns").alias(f"n{x}")), x)
    near = near.select(F.col("su").alias("u"), F.col("sv").alias("v"), "nu", "nv")
    same = prints.join(stands, "fp").filter("set_id <> s").select(F.col("set_id").alias("u"), F.col("s").alias("v"), F.col("n").alias("nu"), F.col("ns").alias("nv"))
    pairs = written(near.unionByName(same).withColumns({"ru": F.col("u"), "rv": F.col("v"), "common": F.lit(0).cast("bigint")}), "near")
    size = roots.agg(F.count("*").alias("sets"), F.sum("n").alias("hashes")).first()
    body_parts = max(least_parts, (size["hashes"] or 0) // (4 * TOGETHER))
    edges = _links(pairs, bodies, least_parts, "links")
    for turn in range(ROUNDS):
        probed = _probing(met, roots, bodies, turn, body_parts)
        found = probed.count()
        roots = _moved(roots, edges.unionByName(probed) if turn == 0 else probed)
        if found <= size["sets"] // 50:
            break
    if not ROUNDS:
        roots = _moved(roots, edges)
    sized = roots.join(roots.groupBy("root").agg(F.count("*").alias("size")).hint("merge"), "root").select("set_id", "root", "size")
    sized = sized.join(met.groupBy("set_id").agg(F.count("*").alias("total")).hint("merge"), "set_id")
    placed = written(met.join(sized, "set_id"), "placed")
    near = _tiles(placed).repartition(parts, "home").mapInArrow(released(_across), _NEAR_SQL)
    near = near.groupBy("set_id", "n", "root", "group").agg(F.sum("common").alias("common"), F.min("need").alias("need")).filter("common >= need")
    near = written(near.select("set_id", "n", "root", "group"), "near")
    if not near.isEmpty():
        size = near.agg(F.sum("n")).first()[0] + size["hashes"]
        roots = _moved(roots, _settling(near, roots, bodies, max(least_parts, size // (4 * TOGETHER))))
    joined = distinct.join(roots.select("set_id", "root"), "set_id", "left").select("set_id", "least", "first", F.coalesce("root", "set_id").alias("root"))
    groups = joined.groupBy("root").agg(F.min("least").alias("component_id"), F.min("first").alias("first"))
    named = joined.select("set_id", "root").join(groups, "root").select("set_id", "component_id", F.col("first.row").alias("lead"))
    return sets.select("doc_id", "row", "set_id").join(named, "set_id").select(F.col("doc_id").alias(id_col), "row", "component_id", "lead")


def row_hash(id_col: str, text_col: str):
    """A hash of a row's id and text; null texts count as empty."""
    return F.xxhash64(F.col(id_col).cast("bigint"), F.coalesce(F.col(text_col).cast("string"), F.lit("")))
