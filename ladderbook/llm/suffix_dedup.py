"""Suffix-array dedup: remove every passage of a document that also starts earlier in the corpus.

A window is any run of `length` bytes inside one document. Windows are told apart by an anchor:
the leftmost k-byte string of least hash inside the window. Equal windows have equal anchors at
equal places, so all windows of one anchor occurrence travel together as one fragment (at most
2 * length - k bytes), fragments meet by anchor, and no window has to be compared with any other.

1. `_anchors`, a scan: each document's fragments, as hashes. Of equal fragments in a batch only
   the earliest goes on, so a passage that a third of all documents hold sends one entry a batch.
2. `_meet`, by anchor: of equal fragments all but the earliest repeat. Anchors with several
   different fragments need their texts.
3. `_fetch`, by document: cut the texts of those fragments out of the documents. Fragments of anchors with
   very many different ones (a line that stands between ever different others) are cut into narrower
   ones, which go on as keys first: hashes of the bytes that all their windows share.
4. `_order`, by anchor: a suffix array over the different fragments of each anchor (gsaca). Windows
   that are equal stand side by side in it; all but the earliest repeat. The bytes are compared. Where
   one key has very many different fragments (one passage's edge in as many documents), their few
   windows are sorted by hash instead, so that no lane is long. Of narrower fragments only those whose keys
   meet go through both steps once more, now with their texts; where a key has met more than HOT times,
   windows go as digests of 128 bits, dealt out by digest.
5. `_cut`, by document: unite the repeated windows and remove what they cover.

Documents are shuffled once by a hash of their key and that exchange serves steps 3 and 5.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import packed, ragged, raw_bytes, released, remembered, slices, text_array, total_bytes, trimmed, unpacked
from .gsaca import suffix_order

K = 32  # bytes of an anchor
SLICE = 1 << 19  # bytes that are hashed at a time
TOGETHER = 8 << 20  # bytes of which equal fragments become one entry
GROUP_BYTES = 4 << 20  # text of a group of documents
BUCKET_BYTES = 12 << 20  # text whose anchors meet in one task
WIDE = 64  # different fragments of one anchor beyond which they are cut narrower
STEP = 8  # windows of a narrower fragment
LANES = 1 << 20  # bytes of fragments that are sorted at a time
LANE = 256  # different fragments of one lane; where one key has more, their windows are sorted by hash
HOT = 1 << 16  # fragments of one key beyond which each window has a key of its own

_ODD = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_TABLE = np.random.Generator(np.random.PCG64(20240229)).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

ENTRY = {"anchor": "u8", "frag": "u8", "doc": "i8", "sum": "i8", "start": "i8", "lead": "u1", "wins": "u1", "group": "i4"}
RANGE = {"doc": "i8", "sum": "i8", "group": "i4", "start": "i8", "end": "i8"}
WINDOW = {"key": "u8", "check": "u8", "doc": "i8", "sum": "i8", "start": "i8", "group": "i4"}
NEED = {"doc": "i8", "sum": "i8", "start": "i8", "lead": "u1", "wins": "u1", "wide": "u1", "anchor": "u8"}
PIECE = {"key": "u8", "doc": "i8", "sum": "i8", "start": "i8", "group": "i4", "wins": "u1", "size": "i4"}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64, for n positions at least."""
    size = 1 << max(20, (n - 1).bit_length())
    powers = remembered("powers", dict)
    if size not in powers:
        out = []
        for base in (_ODD, pow(_ODD, -1, 1 << 64)):
            a = np.ones(1, np.uint64)
            while len(a) < size:
                a = np.concatenate([a, a * np.uint64(pow(base, len(a), 1 << 64))])
            out.append(a)
        powers.clear()
        powers[size] = out[0], out[1]
    return powers[size]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _fragments(body: np.ndarray, offsets: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    """(anchor, fragment hash, document, start, lead, windows) of every anchor occurrence, in order.

    start counts from the document's first byte; lead is how far the anchor stands from there.
    """
    n = len(body)
    none = tuple(np.empty(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.uint8, np.uint8))
    ok = np.diff(offsets) >= length
    if not ok.any():
        return none
    up, down = _powers(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_TABLE[body] * up[:n], out=total[1:])
    gram = _mixed((total[k:] - total[: n - k + 1]) * down[: n - k + 1])
    width = length - k + 1
    low = (gram & np.uint64(_MASK << 24 & _MASK)) | np.arange(len(gram), dtype=np.uint64)
    have = 1
    while have * 2 <= width:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if have < width:
        low = np.minimum(low[: len(low) - (width - have)], low[width - have :])
    docs = np.flatnonzero(ok)
    counts = np.diff(offsets)[docs] - length + 1
    at = ragged(offsets[docs], counts)
    owner = np.repeat(docs, counts)
    value = low[at]
    first = np.flatnonzero(np.r_[True, (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])])
    wins = np.diff(np.r_[first, len(at)])
    start, doc = at[first], owner[first]
    place = (value[first] & np.uint64((1 << 24) - 1)).astype(np.int64)
    end = start + wins - 1 + length
    frag = _mixed((total[end] - total[start]) * down[start]) ^ _mixed(gram[place])
    return gram[place], frag, doc, start - offsets[doc], (place - start).astype(np.uint8), wins.astype(np.uint8)


def _long_fragments(body: np.ndarray, length: int, k: int):
    """The fragments of one long document, slice by slice, and where each slice starts.

    A fragment that a slice's edge cuts in two is only split: both parts still meet their equals,
    since narrower fragments of one anchor are compared window by window in step 4.
    """
    step = SLICE - length + 1
    for at in range(0, max(1, len(body) - length + 1), step):
        part = body[at : at + step + length - 1]
        yield at, _fragments(part, np.array([0, len(part)], np.int64), length, k)


def _ranges(doc: np.ndarray, total: np.ndarray, group: np.ndarray, start: np.ndarray, end: np.ndarray) -> dict[str, np.ndarray]:
    """The union of ranges, by document."""
    if not len(doc):
        return {name: np.empty(0, t) for name, t in RANGE.items()}
    order = np.lexsort((start, total, doc))
    doc, total, group, start, end = doc[order], total[order], group[order], start[order], end[order]
    new_doc = np.r_[True, (doc[1:] != doc[:-1]) | (total[1:] != total[:-1])]
    base = np.cumsum(new_doc) * (int(end.max()) + 2)  # documents after one another, so that one running maximum serves all
    top = np.maximum.accumulate(end + base)
    new = np.r_[True, (start + base)[1:] > top[:-1]] | new_doc
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(doc)] - 1
    return {"doc": doc[first], "sum": total[first], "group": group[first], "start": start[first], "end": (top - base)[last]}


def _blocks(kind: int, bucket: np.ndarray, arrays: dict[str, np.ndarray], dtypes: dict[str, str]):
    """(bucket, kind, payload) for each bucket."""
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    arrays = {n: arrays[n][order].astype(t, copy=False) for n, t in dtypes.items()}
    cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    for i, j in zip(cut.tolist(), np.r_[cut[1:], len(bucket)].tolist()):
        yield int(bucket[i]), kind, packed(**{n: a[i:j] for n, a in arrays.items()})


BLOCK = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("kind", T.IntegerType()), T.StructField("payload", T.BinaryType())])
_ARROW = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("payload", pa.binary())])


def _batch(rows: list) -> pa.RecordBatch:
    a, b, c = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(c, pa.binary())], schema=_ARROW)


def _joined(parts: list[dict[str, np.ndarray]], dtypes: dict[str, str]) -> dict[str, np.ndarray]:
    return {n: np.concatenate([p[n] for p in parts]) if parts else np.empty(0, t) for n, t in dtypes.items()}


def _of_documents(body: np.ndarray, offsets: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    """_fragments() of any number of documents, a slice at a time."""
    parts = []
    for i, j in slices(offsets, SLICE):
        part = body[offsets[i] : offsets[j]]
        if len(part) > SLICE:
            for at, (anchor, frag, doc, start, lead, wins) in _long_fragments(part, length, k):
                parts.append((anchor, frag, doc + i, start + at, lead, wins))
        else:
            anchor, frag, doc, start, lead, wins = _fragments(part, offsets[i : j + 1] - offsets[i], length, k)
            parts.append((anchor, frag, doc + i, start, lead, wins))
    return tuple(np.concatenate(x) for x in zip(*parts))


def _anchors(length: int, k: int, buckets: int):
    def run(batches):
        for batch in trimmed(batches, "powers"):
            ids, sums = (batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("_sa_id", "_sa_sum"))
            groups = batch.column("_sa_group").to_numpy(zero_copy_only=False)
            order = np.lexsort((sums, ids))
            if len(order):
                a, b = ids[order], sums[order]
                order = order[np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]]  # repeated rows count once
            ids, sums, groups = ids[order], sums[order], groups[order]
            texts = text_array(batch.column("_sa_text"))
            sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)[order]
            for i, j in slices(np.r_[0, np.cumsum(sizes)], TOGETHER):
                found = _of_documents(*raw_bytes(texts.take(pa.array(order[i:j]))), length, k)
                yield _batch(_entries(*found, ids[i:j], sums[i:j], groups[i:j], length, buckets))

    return run


def _entries(anchor, frag, doc, start, lead, wins, ids, sums, groups, length: int, buckets: int) -> list:
    """ENTRY blocks of the earliest of equal fragments, RANGE blocks of the others."""
    order = np.argsort(frag, kind="stable")
    f = frag[order]
    first = np.ones(len(f), bool)
    first[1:] = f[1:] != f[:-1]
    rest, order = np.sort(order[~first]), np.sort(order[first])
    again = _ranges(ids[doc[rest]], sums[doc[rest]], groups[doc[rest]], start[rest], start[rest] + wins[rest].astype(np.int64) - 1 + length)
    d = doc[order]
    entries = {"anchor": anchor[order], "frag": frag[order], "doc": ids[d], "sum": sums[d], "start": start[order], "lead": lead[order], "wins": wins[order], "group": groups[d]}
    rows = [*_blocks(0, (entries["anchor"] % np.uint64(buckets)).astype(np.int32), entries, ENTRY)]
    return rows + [*_blocks(1, (again["group"] % buckets).astype(np.int32), again, RANGE)]


def _meet(length: int):
    def run(batches):
        found, ranges = [], []
        for batch in batches:
            for kind, payload in zip(batch.column("kind").to_pylist(), batch.column("payload").to_pylist()):
                (found if kind == 0 else ranges).append(unpacked(payload, ENTRY if kind == 0 else RANGE))
        e = _joined(found, ENTRY)
        del found
        rows = []
        if len(e["anchor"]):
            order = np.argsort(e["anchor"], kind="stable")
            a = e["anchor"][order]
            more = np.zeros(len(a), bool)
            more[1:] = a[1:] == a[:-1]
            more[:-1] |= more[1:]
            e = {n: x[order[more]] for n, x in e.items()}  # an anchor that occurs once has no equal windows
        if len(e["anchor"]):
            order = np.lexsort((e["start"], e["sum"], e["doc"], e["frag"], e["anchor"]))
            e = {n: x[order] for n, x in e.items()}
            new_anchor = np.r_[True, e["anchor"][1:] != e["anchor"][:-1]]
            new_frag = new_anchor | np.r_[True, e["frag"][1:] != e["frag"][:-1]]
            firsts = np.flatnonzero(new_frag)
            own = firsts[np.cumsum(new_frag) - 1]
            later = np.flatnonzero((e["doc"] != e["doc"][own]) | (e["sum"] != e["sum"][own]) | (e["start"] != e["start"][own]))
            ranges.append(_ranges(*(e[n][later] for n in ("doc", "sum", "group", "start")), e["start"][later] + e["wins"][later].astype(np.int64) - 1 + length))
            kinds = np.diff(np.r_[np.flatnonzero(new_anchor[firsts]), len(firsts)])
            kinds = np.repeat(kinds, kinds)
            need = firsts[kinds > 1]
            rows += _blocks(0, e["group"][need], {n: e[n][need] for n in ("doc", "sum", "start", "lead", "wins", "anchor")} | {"wide": (kinds[kinds > 1] > WIDE).astype("u1")}, NEED)
        r = _joined(ranges, RANGE)
        rows += _blocks(1, r["group"], r, RANGE)
        yield _batch(rows)

    return run


def _narrower(need: dict[str, np.ndarray], length: int) -> dict[str, np.ndarray]:
    """Wide entries cut into runs of STEP windows by their distance from the anchor; `common` is where the bytes start that all windows of a run share."""
    start, lead, wins = need["start"], need["lead"].astype(np.int64), need["wins"].astype(np.int64)
    wide = need["wide"] == 1
    least, most = lead - wins + 1, lead  # the anchor's distance from the last and from the first window
    lo, hi = np.where(wide, least // STEP, 0), np.where(wide, most // STEP, 0)
    count = hi - lo + 1
    at = np.repeat(np.arange(len(start)), count)
    run = ragged(lo, count)
    w = wide[at]
    near = np.where(w, np.maximum(least[at], run * STEP), least[at])
    far = np.where(w, np.minimum(most[at], run * STEP + STEP - 1), most[at])
    begin = start[at] + lead[at] - far
    return {n: need[n][at] for n in ("doc", "sum", "anchor")} | {"start": begin, "wins": far - near + 1, "wide": need["wide"][at], "run": run, "common": start[at] + lead[at] - run * STEP}


def _digests(body: np.ndarray, at: list[int], size: int, more: list[bytes]) -> np.ndarray:
    """Two numbers a place: the digest of `size` bytes there and of more."""
    view = memoryview(np.ascontiguousarray(body))
    made = b"".join(hashlib.blake2b(view[i : i + size], digest_size=16, salt=x).digest() for i, x in zip(at, more))
    return np.frombuffer(made, np.uint64).reshape(-1, 2)


def _windows(x: dict[str, np.ndarray], base: np.ndarray, body: np.ndarray, length: int, group: int) -> dict[str, np.ndarray]:
    """WINDOW entries of fragments."""
    owner = np.repeat(np.arange(len(base)), x["wins"])
    start = x["start"][owner] + ragged(np.zeros(len(base), np.int64), x["wins"])
    both = _digests(body, (base[owner] + start).tolist(), length, [b""] * len(owner))
    return {"key": both[:, 0], "check": both[:, 1], "doc": x["doc"][owner], "sum": x["sum"][owner], "start": start, "group": np.full(len(owner), group, np.int32)}


def _by_document(docs: dict, d: np.ndarray, s: np.ndarray) -> np.ndarray:
    return np.fromiter((docs[x] for x in zip(d.tolist(), s.tolist())), np.int64, len(d))


def _fetch(length: int, buckets: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not right.num_rows:
            return pa.Table.from_batches([], schema=_ARROW)
        need, ranges = [], []
        for kind, payload in zip(right.column("kind").to_pylist(), right.column("payload").to_pylist()):
            (need if kind == 0 else ranges).append(unpacked(payload, NEED if kind == 0 else RANGE))
        need, r = _joined(need, NEED), _joined(ranges, RANGE)
        group = left.column("_sa_group")[0].as_py()
        rows = [*_blocks(1, np.full(len(r["doc"]), group % buckets, np.int32), r, RANGE)]
        if len(need["doc"]):
            body, offsets = raw_bytes(text_array(left.column("_sa_text")))
            ids = left.column("_sa_id").to_numpy().astype(np.int64).tolist()
            place = dict(zip(zip(ids, left.column("_sa_sum").to_numpy().tolist()), offsets[:-1].tolist()))
            x = _narrower(need, length)
            base = _by_document(place, x["doc"], x["sum"])
            size = x["wins"] - 1 + length
            key = x["anchor"].copy()
            wide = np.flatnonzero(x["wide"] == 1)
            if len(wide):
                key[wide] ^= _digests(body, (base + x["common"])[wide].tolist(), length - STEP + 1, [bytes([r]) for r in x["run"][wide].tolist()])[:, 0]
            bucket = (key % np.uint64(buckets)).astype(np.int64)
            cols = {"key": key, "doc": x["doc"], "sum": x["sum"], "start": x["start"], "group": np.full(len(key), group, np.int32), "wins": x["wins"], "size": size}
            rows += _blocks(3, bucket[wide].astype(np.int32), {n: c[wide] for n, c in cols.items()}, PIECE)
            if len(hot := np.flatnonzero(x["wide"] == 2)):
                found = _windows({n: c[hot] for n, c in x.items()}, base[hot], body, length, group)
                rows += _blocks(4, (found["key"] % np.uint64(buckets)).astype(np.int32), found, WINDOW)
            plain = np.flatnonzero(x["wide"] == 0)
            order = plain[np.argsort(bucket[plain], kind="stable")]
            cut = np.flatnonzero(np.r_[len(order) > 0, np.diff(bucket[order]) != 0])
            for i, j in zip(cut.tolist(), np.r_[cut[1:], len(order)].tolist()) if len(order) else ():
                o = order[i:j]
                head = packed(**{n: cols[n][o].astype(t) for n, t in PIECE.items()})
                texts = body[ragged((base + x["start"])[o], size[o])].tobytes()
                rows.append((int(bucket[o[0]]), 2, len(head).to_bytes(8, "little") + head + texts))
        return pa.Table.from_batches([_batch(rows)])

    return run


def _order(length: int):
    def run(batches):
        pieces, texts, ranges, keyed, windows = [], [], [], [], []
        for batch in batches:
            for kind, payload in zip(batch.column("kind").to_pylist(), batch.column("payload").to_pylist()):
                if kind == 1:
                    ranges.append(unpacked(payload, RANGE))
                elif kind == 3:
                    keyed.append(unpacked(payload, PIECE))
                elif kind == 4:
                    windows.append(unpacked(payload, WINDOW))
                else:
                    n = int.from_bytes(payload[:8], "little")
                    pieces.append(unpacked(payload[8 : 8 + n], PIECE))
                    texts.append(np.frombuffer(payload, np.uint8, -1, 8 + n))
        p = _joined(pieces, PIECE)
        if len(p["key"]):
            body = np.concatenate(texts)
            del texts, pieces
            ranges += _repeats(p, body, length)
        if windows:
            ranges.append(_equal(_joined(windows, WINDOW), length))
        r = _joined(ranges, RANGE)
        r = _ranges(*(r[n] for n in ("doc", "sum", "group", "start", "end")))
        yield _batch([*_blocks(1, r["group"], r, RANGE), *_again(_joined(keyed, PIECE))])

    return run


def _again(k: dict[str, np.ndarray]) -> list:
    """NEED blocks of the narrower fragments whose key others have too."""
    if not len(k["key"]):
        return []
    _, inverse, count = np.unique(k["key"], return_inverse=True, return_counts=True)
    met = np.flatnonzero(count[inverse] > 1)
    need = {n: k[n][met] for n in ("doc", "sum", "start", "wins")} | {"lead": k["wins"][met] - 1, "wide": np.where(count[inverse[met]] > HOT, 2, 0), "anchor": k["key"][met]}
    return [*_blocks(0, k["group"][met], need, NEED)]


def _equal(w: dict[str, np.ndarray], length: int) -> dict[str, np.ndarray]:
    """Ranges of the windows that have the digest of an earlier one."""
    order = np.lexsort((w["start"], w["sum"], w["doc"], w["check"], w["key"]))
    same = (np.diff(w["key"][order]) == 0) & (np.diff(w["check"][order]) == 0)
    later = order[1:][same]
    return _ranges(*(w[n][later] for n in ("doc", "sum", "group", "start")), w["start"][later] + length)


def _repeats(p: dict[str, np.ndarray], body: np.ndarray, length: int) -> list[dict[str, np.ndarray]]:
    """Ranges of the windows that also start earlier, among the fragments of each key."""
    size = p["size"].astype(np.int64)
    at = np.cumsum(size) - size
    order = np.lexsort((p["start"], p["sum"], p["doc"], p["key"]))
    key = p["key"][order]
    cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    many = np.diff(np.r_[cut, len(key)])
    out = []
    # equal fragments of one key (narrower ones may be) collapse to the earliest
    spans = zip(cut[many > 1].tolist(), (cut + many)[many > 1].tolist())
    lanes, later = [], []
    for i, j in spans:
        o = order[i:j]
        seen: set[bytes] = set()
        mine = []
        for q in o.tolist():
            t = body[at[q] : at[q] + size[q]].tobytes()
            if t in seen:
                later.append(q)
            else:
                seen.add(t)
                mine.append(q)
        if len(mine) > LANE:
            out.append(_hashed_windows(p, body, at, np.array(mine), length))
        elif len(mine) > 1:
            lanes.append(np.array(mine))
    # lanes of about one length are sorted together: a few long ones would keep all others waiting
    room = np.array([int(size[m].sum()) for m in lanes], np.int64)
    lanes = [lanes[k] for k in np.argsort(room, kind="stable").tolist()]
    for i, j in slices(np.r_[0, np.cumsum(np.sort(room))], LANES):
        out.append(_sorted_windows(p, body, at, np.concatenate(lanes[i:j]), np.array([len(m) for m in lanes[i:j]]), length))
    if later:
        q = np.array(later)
        out.append(_ranges(*(p[n][q] for n in ("doc", "sum", "group", "start")), p["start"][q] + p["size"][q]))
    return out


def _hashed_windows(p, body, at, chosen, length):
    """Ranges of the windows of these fragments that also start earlier; equal hashes are followed by a look at the bytes."""
    wins = p["wins"][chosen].astype(np.int64)
    owner = np.repeat(np.arange(len(chosen)), wins)
    inside = ragged(np.zeros(len(chosen), np.int64), wins)
    spot = at[chosen][owner] + inside
    windows = np.lib.stride_tricks.sliding_window_view(body, length)
    power = np.cumprod(np.full(length, _ODD, np.uint64))
    digest = np.empty(len(spot), np.uint64)
    for i in range(0, len(spot), 1 << 14):
        digest[i : i + (1 << 14)] = (_TABLE[windows[spot[i : i + (1 << 14)]]] * power).sum(1, dtype=np.uint64)
    doc, total, start = p["doc"][chosen][owner], p["sum"][chosen][owner], p["start"][chosen][owner] + inside
    order = np.lexsort((start, total, doc, digest))
    same = np.zeros(len(order), bool)
    for i in range(1, len(order), 1 << 14):
        j = min(len(order), i + (1 << 14))
        w = windows[spot[order[i - 1 : j]]]
        same[i:j] = (w[1:] == w[:-1]).all(1)
    # equal hashes of different windows are not told apart further than by their neighbours: such a pair needs 2**32 windows
    later = order[same]
    return _ranges(doc[later], total[later], p["group"][chosen][owner[later]], start[later], start[later] + length)


def _sorted_windows(p, body, at, chosen, lane_sizes, length):
    """One lane for each key: its fragments, a 1 after each, a 0 at the lane's end, bytes raised by 2."""
    size = p["size"][chosen].astype(np.int64)
    last = np.zeros(len(chosen), bool)
    last[np.cumsum(lane_sizes) - 1] = True
    room = size + 1 + last
    begin = np.cumsum(room) - room
    symbols = np.ones(int(room.sum()), np.int64)
    symbols[ragged(begin, size)] = body[ragged(at[chosen], size)].astype(np.int64) + 2
    symbols[(begin + room - 1)[last]] = 0
    lane_first = np.r_[0, np.cumsum(lane_sizes)[:-1]]
    suffixes = suffix_order(symbols, np.r_[begin[lane_first], len(symbols)])
    owner = np.repeat(np.arange(len(chosen)), room)[suffixes]
    inside = suffixes - begin[owner]
    starts = inside < p["wins"][chosen][owner]
    suffixes, owner, inside = suffixes[starts], owner[starts], inside[starts]
    lane = np.repeat(np.arange(len(lane_sizes)), lane_sizes)[owner]
    raw = (symbols - 2).astype(np.uint8)
    windows = np.lib.stride_tricks.sliding_window_view(raw, length)
    same = np.zeros(len(suffixes), bool)
    for i in range(1, len(suffixes), 1 << 16):
        j = min(len(suffixes), i + (1 << 16))
        w = windows[suffixes[i - 1 : j]]
        same[i:j] = (w[1:] == w[:-1]).all(1)
    same[1:] &= lane[1:] == lane[:-1]
    run = np.cumsum(~same)
    start = p["start"][chosen][owner] + inside
    doc, total = p["doc"][chosen][owner], p["sum"][chosen][owner]
    order = np.lexsort((start, total, doc, run))
    later = order[1:][run[order[1:]] == run[order[:-1]]]
    own = owner[later]
    return _ranges(doc[later], total[later], p["group"][chosen][own], start[later], start[later] + length)


def _cut(keep: list[str], schema: pa.Schema, kept_as: str | None):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        body, offsets = raw_bytes(text_array(left.column("_sa_text")))
        r = _joined([unpacked(x, RANGE) for x in right.column("payload").to_pylist()], RANGE)
        r = _ranges(*(r[n] for n in ("doc", "sum", "group", "start", "end")))
        key = list(zip(r["doc"].tolist(), r["sum"].tolist()))
        by: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for k, s, e in zip(key, r["start"].tolist(), r["end"].tolist()):
            by.setdefault(k, []).append((s, e))
        view = memoryview(body)
        ids, sums = left.column("_sa_id").to_numpy().tolist(), left.column("_sa_sum").to_numpy().tolist()
        removed, spans, digests, kept = [], [], [], []
        for i, k in enumerate(zip(ids, sums)):
            text = view[offsets[i] : offsets[i + 1]]
            cuts = by.get(k, ())
            digest, rest, at = hashlib.sha256(), [], 0
            for s, e in cuts:
                rest.append(text[at:s])
                at = e
            rest.append(text[at:])
            for part in rest:
                digest.update(part)
            removed.append(sum(e - s for s, e in cuts))
            spans.append(len(cuts))
            digests.append(digest.hexdigest())
            if kept_as:
                left_over = b"".join(rest)
                kept.append(left_over if kept_as == "bytes" else left_over.decode("utf-8", "ignore"))
        cols = [left.column(n) for n in keep]
        cols += [pa.array(np.diff(offsets)), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string())]
        if kept_as:
            cols.append(pa.array(kept, schema[-1].type))
        return pa.Table.from_arrays([c.cast(f.type) for c, f in zip(cols, schema)], schema=schema)

    return run


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100, kept_as: str | None = "bytes") -> DataFrame:
    """Every row of docs, with n_bytes, n_removed, n_spans, kept_sha256 and kept: the remaining bytes (kept_as
    "bytes"), their text less the parts of cut characters ("text"), or no such column (None).

    A byte goes when a `length`-byte string that covers it also starts earlier: in a document of
    smaller id, or in the same one before. Strings are judged on the input.

    Null texts count as empty, null ids as the least integer. Documents under `length` bytes lose
    nothing. Rows equal in id and text are one document and get one result each; rows with one id
    and different texts are ordered by a hash of the text. Other columns are handed through, whatever
    their names (those of the result win). An empty table gives an empty result.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    if length < K + 8 or length > 255:
        raise ValueError("length must be from 40 to 255")
    k = K
    added = [("n_bytes", T.LongType()), ("n_removed", T.LongType()), ("n_spans", T.LongType()), ("kept_sha256", T.StringType())]
    if kept_as:
        added.append(("kept", T.BinaryType() if kept_as == "bytes" else T.StringType()))
    carried = [c for c in docs.columns if c not in dict(added)]
    size = total_bytes(docs, text_col)
    groups = max(64, size // GROUP_BYTES)
    buckets = max(24, size // BUCKET_BYTES)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    ready = docs.select(*carried, F.coalesce(F.col(id_col).cast("bigint"), F.lit(-(1 << 63))).alias("_sa_id"), text.alias("_sa_text"))
    ready = ready.withColumn("_sa_sum", F.xxhash64("_sa_text"))
    ready = ready.withColumn("_sa_group", F.pmod(F.xxhash64("_sa_id", "_sa_sum"), F.lit(groups)).cast("int"))
    if text_col in carried:  # once is enough on the way
        ready = ready.drop(text_col)
    small = ready.select("_sa_id", "_sa_sum", "_sa_group", "_sa_text")
    by_doc = ready.groupBy("_sa_group")
    blocks = small.mapInArrow(_anchors(length, k, buckets), BLOCK).repartition(buckets, "bucket").mapInArrow(released(_meet(length)), BLOCK)
    blocks = by_doc.cogroup(blocks.groupBy("bucket")).applyInArrow(_fetch(length, buckets), BLOCK)
    blocks = blocks.repartition(buckets, "bucket").mapInArrow(released(_order(length)), BLOCK)
    # narrower fragments that have met
    blocks = by_doc.cogroup(blocks.groupBy("bucket")).applyInArrow(_fetch(length, buckets), BLOCK)
    blocks = blocks.repartition(buckets, "bucket").mapInArrow(released(_order(length)), BLOCK)
    out = T.StructType([ready.schema["_sa_text" if c == text_col else c] if c != text_col else T.StructField(text_col, T.StringType()) for c in carried] + [T.StructField(n, t) for n, t in added])
    keep = ["_sa_text" if c == text_col else c for c in carried]
    return by_doc.cogroup(blocks.groupBy("bucket")).applyInArrow(_cut(keep, to_arrow_schema(out), kept_as), out)
