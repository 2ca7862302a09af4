"""Sessions over all books: message headers in, actions out.

A book's rows are cut into ranges of their order, and the ranges run at once. Each starts from a guess of the
state that the range before it leaves: a book that is healthy and has reached the largest id so far. A walk
over the ranges' ends tells which guesses were wrong; those ranges run again from the end of the one before,
and what is still wrong after some rounds runs in one piece. So the result is that of one pass in order,
and a book without trouble at the borders of its ranges takes one round, however long it is.
"""

from __future__ import annotations

import json
from bisect import bisect_right

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.storage import written
from .session import BUFFER, Session

_KEY = ["capture_id", "venue", "symbol"]
_NUMBERS = ["epoch", "seq", "segment", "ordinal", "cause_epoch", "cause_seq", "place", "number"]
_TEXTS = {
    "action": ["seed", "apply", "stale", "gap", "buffered", "drop", "reset", "overflow", "check", "partial", "trade", "error"],
    "source": ["", "snapshot", "depth5", "buffer"],
}
_CODES = {name: {text: k for k, text in enumerate(texts)} for name, texts in _TEXTS.items()}
_TYPES = [*((k, pa.string()) for k in _KEY), ("action", pa.string()), ("epoch", pa.int64()), ("seq", pa.int64()), ("source", pa.string()), *((n, pa.int64()) for n in _NUMBERS[2:])]
ACTIONS = T.StructType([T.StructField(n, T.StringType() if t == pa.string() else T.LongType()) for n, t in _TYPES])
_ARROW = pa.schema(_TYPES)
LEAST = 8  # rows of a stretch that is worth taking at once
SPAN = 1 << 18  # numbers of a connection, or places in a file, of a range; fewer borders leave fewer wrong guesses
ROUNDS = 3  # of running ranges again at once
AHEAD = 64  # snapshots that a range gets beyond those it is thought to need
_RANGE = ["major", "slot"]
#: ways of a range: its actions, then a row `end` with the state after it, the state before it and its counters
RANGED = T.StructType([*ACTIONS.fields, T.StructField("major", T.LongType()), T.StructField("slot", T.LongType()), T.StructField("entry", T.StringType()), T.StructField("state", T.StringType())])
_RANGED_ARROW = pa.schema([*_TYPES, ("major", pa.int64()), ("slot", pa.int64()), ("entry", pa.string()), ("state", pa.string())])
START = [None, True, False, False, 0, 0, []]


class _Found:
    """Actions of one batch: a column of numbers each, texts and keys by code; the latest of keys and places is theirs who come."""

    def __init__(self):
        self.parts: dict[str, list[np.ndarray]] = {n: [] for n in ("key", "action", "source", *_NUMBERS)}
        self.keys: list[list[str]] = []
        self.places: list[tuple[int, int] | None] = []

    def of(self, key: list[str], place: tuple[int, int] | None) -> None:
        self.keys.append(key)
        self.places.append(place)

    def add(self, found: dict[str, np.ndarray]) -> None:
        size = len(found["seq"])
        for name, parts in self.parts.items():
            value = len(self.keys) - 1 if name == "key" else found.get(name, 0)
            parts.append(value if isinstance(value, np.ndarray) else np.full(size, value, np.int64))

    def one(self, actions) -> None:
        rows = [(_CODES["action"][a.action], a.epoch, a.seq, _CODES["source"][a.source], *a[4:]) for a in actions]
        if rows:
            cols = np.array(rows, np.int64).T
            self.add(dict(zip(("action", "epoch", "seq", "source", *_NUMBERS[2:]), cols)))

    def batch(self) -> pa.RecordBatch | None:
        if not self.parts["seq"]:
            return None
        keys = self.keys
        cols = {n: np.concatenate(x) for n, x in self.parts.items()}
        text = lambda codes, texts: pa.DictionaryArray.from_arrays(pa.array(codes, pa.int32()), pa.array(texts, pa.string())).cast(pa.string())
        out = []
        for name, kind in _TYPES:
            if name in _KEY:
                out.append(text(cols["key"], [k[_KEY.index(name)] for k in keys]))
            else:
                out.append(text(cols[name], _TEXTS[name]) if name in _TEXTS else pa.array(cols[name], kind))
        if self.places[0] is None:
            return pa.RecordBatch.from_arrays(out, schema=_ARROW)
        at, none = np.array(self.places, np.int64)[cols["key"]], pa.nulls(len(cols["key"]), pa.string())
        return pa.RecordBatch.from_arrays([*out, pa.array(at[:, 0]), pa.array(at[:, 1]), none, none], schema=_RANGED_ARROW)


def _changes(column: pa.Array) -> np.ndarray:
    """Whether each value but the first differs from the one before it."""
    out = np.ones(len(column), bool)
    differ = pc.not_equal(column.slice(1), column.slice(0, len(column) - 1))
    out[1:] = pc.fill_null(differ, True).to_numpy(zero_copy_only=False)
    return out


def _end(key: list[str], place: tuple[int, int], session: Session, entry: str) -> pa.RecordBatch:
    """The row `end` of a range: segment and number count those of the range, ordinal goes on from the range before without a segment."""
    missed = session.snapshots.missed
    row = {**dict(zip(_KEY, key)), "action": "end", "epoch": 0, "seq": 0, "source": "missed" if missed else "", "segment": session.segment, "ordinal": session.ordinal, "cause_epoch": 0, "cause_seq": 0, "place": 0, "number": session.number}
    row |= {"major": place[0], "slot": place[1], "entry": entry, "state": json.dumps(session.state())}
    return pa.RecordBatch.from_pylist([row], _RANGED_ARROW)


def _run(options: dict, ranges: bool = False):
    """Sessions over batches in order: of whole books, or of ranges, each behind a row `plan` that tells where it starts."""

    def run(batches):
        key, session, place, entry = None, None, None, ""
        for batch in batches:
            if not batch.num_rows:
                continue
            col = {n: batch.column(n) for n in batch.schema.names}
            fresh = _changes(col["capture_id"]) | _changes(col["venue"]) | _changes(col["symbol"])
            if ranges:
                fresh |= _changes(col["major"]) | _changes(col["slot"])
                at_of = list(zip(col["major"].to_pylist(), col["slot"].to_pylist()))
            diff = pc.equal(col["kind"], "depth_diff").to_numpy(zero_copy_only=False)
            trade = pc.equal(col["kind"], "trade").to_numpy(zero_copy_only=False)
            valid = col["valid"].to_numpy(zero_copy_only=False).astype(bool)
            number = {n: col[n].to_numpy() for n in ("epoch", "seq", "first_id", "final_id", "pu", "last_id")}
            # a stretch: diffs and trades of one book and connection
            plain = diff & valid | trade
            stops = np.flatnonzero(np.r_[fresh | _changes(col["epoch"]) | ~plain, True])
            after = stops[np.searchsorted(stops, np.arange(batch.num_rows), "right")]
            kinds, sidecar = col["kind"].to_pylist(), col["sidecar"].to_pylist()
            found, at = _Found(), 0
            while at < batch.num_rows:
                if fresh[at] or session is None:
                    own, now = [col[k][at].as_py() for k in _KEY], at_of[at] if ranges else None
                    if own != key or now != place or session is None:
                        if ranges and session is not None:
                            if (out := found.batch()) is not None:
                                yield out
                            yield _end(key, place, session, entry)
                            found = _Found()
                        key, place, session = own, now, Session(own[1] == "usdm", sidecar[at], **options)
                        if ranges:
                            entry, waiting = col["entry"][at].as_py(), col["ahead"][at].as_py()
                            session.enter(json.loads(entry), list(zip(waiting[::2], waiting[1::2])), col["more"][at].as_py())
                        found.of(key, place)
                if not found.keys:
                    found.of(key, place)
                if kinds[at] == "plan":
                    at += 1
                    continue
                end = int(after[at])
                if plain[at] and end - at >= LEAST and session.epoch == number["epoch"][at]:
                    rows = slice(at, end)
                    taken, columns = session.stretch(diff[rows], *(number[n][rows] for n in ("epoch", "seq", "first_id", "final_id", "pu")))
                    if taken:
                        if len(columns["seq"]):
                            found.add(columns | {"action": np.array([_CODES["action"][a] for a in columns["action"]], np.int64)[columns["which"]]})
                        at += taken
                        continue
                one = {n: int(x[at]) for n, x in number.items()}
                if kinds[at] == "snapshot":
                    session.add_snapshot(one["seq"], one["last_id"])
                else:
                    found.one(session.message(kinds[at], bool(valid[at]), *one.values()))
                at += 1
            if (out := found.batch()) is not None:
                yield out
        if ranges and session is not None:
            yield _end(key, place, session, entry)

    return run


def _walk(rounds: int, last: bool):
    """A book's snapshots, then its ranges in order: for each range its plan, and the counters of those before it.

    At the first round all ranges start from a guess; later, those whose guess isn't what the range before
    has left start from that; with `last`, the first wrong one and all behind it become one range.
    """

    def plan(batches):
        key = None
        for batch in batches:
            out: dict[str, list] = {n: [] for n in PLAN.names}
            for r in batch.to_pylist():
                own = [r[k] for k in _KEY]
                if own != key:
                    key, lasts, ids, epoch, top, most, before = own, [], None, None, 0, 0, None
                    segment = ordinal = number = 0
                    first_wrong = None
                if r["kind"] == "snapshot":
                    lasts.append((r["seq"], r["last_id"]))
                    continue
                ids = sorted(x for _, x in lasts) if ids is None else ids
                if before is None:
                    want = START
                elif rounds == 0:  # snapshots of ids that are reached are used
                    want = [epoch, False, True, True, top, bisect_right(ids, most), []]
                else:
                    want = json.loads(before["state"] or json.dumps(START))  # none: a range that has gone into another one
                wrong = rounds == 0
                if rounds and r["state"] is not None:
                    had = json.loads(r["entry"])
                    # a connection's first row forgets all but the snapshots
                    new = before is not None and r["first_epoch"] not in (had[0], want[0]) and had[0] is not None
                    wrong = r["source"] == "missed" or not (had == want or new and had[5] == want[5])
                if wrong and last and first_wrong is None:
                    first_wrong = (r["major"], r["slot"])
                at = want[5]
                ahead = lasts[at:] if rounds else lasts[at : max(at, bisect_right(ids, r["most"])) + AHEAD]
                row = dict(zip(_KEY, own)) | {"major": r["major"], "slot": r["slot"], "sidecar": r["sidecar"], "wrong": wrong or first_wrong is not None, "entry": json.dumps(want), "ahead": [x for s in ahead for x in s], "more": at + len(ahead) < len(lasts)}
                row |= {"into_major": (first_wrong or (r["major"], r["slot"]))[0], "into_slot": (first_wrong or (r["major"], r["slot"]))[1], "segments": segment, "ordinals": ordinal, "numbers": number, "peaks": r["peaks"], "most": r["most"], "first_epoch": r["first_epoch"]}
                for n, x in row.items():
                    out[n].append(x)
                if not row["wrong"]:
                    out["entry"][-1], out["ahead"][-1] = "", []
                ends = [tuple(x.values()) for x in r["peaks"]]  # by place: (place, epoch, largest id)
                for _, e, x in sorted(ends, key=lambda x: x[0]):
                    top = max(top, x) if e == epoch else x
                    epoch, most = e, max(most, x)
                if r["state"] is not None:
                    segment, number = segment + r["segments"], number + r["numbers"]
                    ordinal = r["ordinals"] if r["segments"] else ordinal + r["ordinals"]
                before = r
            yield pa.RecordBatch.from_pydict(out, schema=_PLAN_ARROW)

    return plan


_PEAKS = pa.list_(pa.struct([("at", pa.int64()), ("epoch", pa.int64()), ("top", pa.int64())]))
_PLAN_ARROW = pa.schema([*((k, pa.string()) for k in _KEY), ("major", pa.int64()), ("slot", pa.int64()), ("sidecar", pa.bool_()), ("wrong", pa.bool_()), ("entry", pa.string()), ("ahead", pa.list_(pa.int64())), ("more", pa.bool_()), ("into_major", pa.int64()), ("into_slot", pa.int64()), ("segments", pa.int64()), ("ordinals", pa.int64()), ("numbers", pa.int64()), ("peaks", _PEAKS), ("most", pa.int64()), ("first_epoch", pa.int64())])
_SPARK_TYPES = {pa.string(): T.StringType(), pa.int64(): T.LongType(), pa.bool_(): T.BooleanType(), pa.list_(pa.int64()): T.ArrayType(T.LongType()), _PEAKS: T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("at", "epoch", "top")]))}
PLAN = T.StructType([T.StructField(f.name, _SPARK_TYPES[f.type]) for f in _PLAN_ARROW])
#: order of a book's rows: by place in the file where that is known, else by connection and number; rows that repeat
#: a number by receive time and content
_ORDER = ["major", "minor", "tsec", "tnsec", "kind", "content", "seq"]


def _heads(parsed: DataFrame) -> DataFrame:
    """What sequencing needs of parse_market() rows: ids and order. `seq` names the row: rid if there is one, else its number."""
    m, none = F.col("message"), F.lit(0).cast("bigint")
    ids = [F.coalesce(m[c], none).alias(c) for c in ("first_id", "final_id", "pu", "last_id")]
    has = lambda c: c in parsed.columns
    epoch, number = F.coalesce("conn_epoch", none), F.coalesce("conn_seq", none)
    place = F.col("place") if has("place") else F.lit(None).cast("struct<block:bigint,at:bigint>")
    major, minor = F.when(place.isNotNull(), place["block"]).otherwise(epoch), F.when(place.isNotNull(), place["at"]).otherwise(number)
    clock = [(F.col(c) if has(c) else none).cast("bigint").alias(n) for c, n in (("recv_tsec", "tsec"), ("recv_tnsec", "tnsec"))]
    return parsed.select(*_KEY, F.col("have_sidecar").alias("sidecar"), epoch.alias("epoch"), (F.col("rid") if has("rid") else number).alias("seq"), F.col("stream_kind").alias("kind"), F.col("valid"), *ids, major.alias("major"), minor.alias("minor"), *clock, (F.col("content") if has("content") else F.xxhash64("payload_json")).alias("content"))


_PLACE = [*_KEY, *_RANGE]


def _aside(df: DataFrame, *others) -> DataFrame:
    """df's places under other names, for a join with those of another frame."""
    return df.select(*[F.col(c).alias(f"_{c}") for c in _PLACE], *others)


def _same_place() -> Column:
    found = F.lit(True)
    for c in _PLACE:
        found = found & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return found


def actions(parsed: DataFrame, snapshots: DataFrame | None = None, **options) -> DataFrame:
    """sequenced() without the books' states."""
    return sequenced(parsed, snapshots, **options)[0]


def sequenced(parsed: DataFrame, snapshots: DataFrame | None = None, trades: bool = False, cap: int = BUFFER, seed_by_final_id: bool = False, sidecars: DataFrame | None = None, span: int = SPAN, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """The actions of every book, and the state that each book is in at its end (_last_states()).

    parsed: parse_market()'s rows; a row is named by its rid (identified() in rebuild.py), or by conn_seq where
    that repeats in no book, and this is what `seq` and `cause_seq` hold. snapshots: parse_snapshots()'s, or
    None where no sidecar was kept; a book's are used in order of snap_ord. sidecars: (capture_id, have_sidecar)
    where only some captures have one; as default all have, or none. Only ids travel. A book's rows are in order
    of place (in its file) where they have one, else of connection and number; ranges of `span` of either run
    at once. Rows of null capture, venue or symbol are books of their own.
    """
    if sidecars is None:
        parsed = parsed.withColumn("have_sidecar", F.lit(snapshots is not None))
    else:
        parsed = parsed.join(sidecars.select("capture_id", "have_sidecar"), "capture_id", "left").fillna({"have_sidecar": False})
    options = {"trades": trades, "cap": cap, "seed_by_final_id": seed_by_final_id}
    head = written(_heads(parsed).withColumn("slot", F.floor(F.col("minor") / span)), "heads")
    reached = F.when((F.col("kind") == "depth_diff") & F.col("valid"), F.col("final_id")).when((F.col("kind") == "depth5") & F.col("valid") & ~F.col("sidecar"), F.col("last_id"))
    place = F.struct("minor", "tsec", "tnsec", "kind", "content", "seq")
    peaks = head.groupBy(*_PLACE, "epoch").agg(F.max("minor").alias("at"), F.coalesce(F.max(reached), F.lit(0)).alias("top"), F.min(place).alias("first"), F.max("sidecar").alias("sidecar"))
    ranges = peaks.groupBy(*_PLACE).agg(F.max("sidecar").alias("sidecar"), F.collect_list(F.struct("at", "epoch", "top")).alias("peaks"), F.max("top").alias("most"), F.min_by("epoch", "first").alias("first_epoch"))
    waiting = None
    if snapshots is not None:
        waiting = snapshots.filter("valid").select(*_KEY, F.col("snap_ord").cast("bigint").alias("seq"), F.col("message.last_id").alias("last_id"))
    done, ends, k = None, None, 0
    while True:
        # a plan hands the ranges on to the next one
        plan = written(_planned(ranges, waiting, ends, k, last=k == rounds + 1), "plan")
        ranges = plan.select(*ranges.columns)
        wrong = plan.filter("wrong")
        if k and wrong.isEmpty():
            return _counted(done, plan), _last_states(done, plan)
        again = written(_ranges_run(head, wrong, options), "actions")
        done = again if done is None else done.join(_aside(wrong), _same_place(), "left_anti").unionByName(again)
        ends = done.filter("action = 'end'")
        k += 1


def _planned(ranges: DataFrame, waiting: DataFrame | None, ends: DataFrame | None, k: int, last: bool) -> DataFrame:
    text, long = F.lit(None).cast("string"), F.lit(None).cast("bigint")
    rows = ranges.withColumns({"kind": F.lit("range"), "seq": long, "last_id": long})
    if ends is None:
        rows = rows.withColumns({"entry": text, "state": text, "source": text, "segments": long, "ordinals": long, "numbers": long})
    else:
        own = _aside(ends, "entry", "state", "source", F.col("segment").alias("segments"), F.col("ordinal").alias("ordinals"), F.col("number").alias("numbers"))
        rows = rows.join(own, _same_place(), "left").drop(*[f"_{c}" for c in _PLACE])
    if waiting is not None:
        rows = rows.unionByName(waiting.withColumn("kind", F.lit(" snapshot")), allowMissingColumns=True)
    rows = rows.repartition(*_KEY).sortWithinPartitions(*_KEY, F.col("major").asc_nulls_first(), "slot", "seq").withColumn("kind", F.trim("kind"))
    return rows.mapInArrow(_walk(k, last), PLAN)


def _ranges_run(head: DataFrame, plan: DataFrame, options: dict) -> DataFrame:
    """The ranges of plan, each from its entry; ranges that go into another one run behind it."""
    rows = head.join(_aside(plan, "into_major", "into_slot"), _same_place()).drop(*[f"_{c}" for c in _PLACE])
    none = {"entry": F.lit(None).cast("string"), "ahead": F.lit(None).cast("array<bigint>"), "more": F.lit(False), "rank": F.lit(1)}
    rows = rows.withColumns(none).withColumns({"own_major": F.col("major"), "own_slot": F.col("slot"), "major": F.col("into_major"), "slot": F.col("into_slot")}).drop("into_major", "into_slot")
    starts = plan.filter((F.col("major") == F.col("into_major")) & (F.col("slot") == F.col("into_slot"))).select(*_PLACE, "sidecar", "entry", "ahead", "more")
    zero = {c: F.lit(0).cast("bigint") for c in ("epoch", "seq", "first_id", "final_id", "pu", "last_id", "minor", "tsec", "tnsec", "content", "own_major", "own_slot")}
    starts = starts.withColumns({**zero, "kind": F.lit("plan"), "valid": F.lit(True), "rank": F.lit(0)})
    both = rows.unionByName(starts).repartition(*_PLACE).sortWithinPartitions(*_PLACE, "rank", "own_major", *[c for c in _ORDER if c != "major"])
    names = [*_PLACE, "sidecar", "epoch", "seq", "kind", "valid", "first_id", "final_id", "pu", "last_id", "entry", "ahead", "more"]
    return both.select(*names).mapInArrow(_run(options, ranges=True), RANGED)


def _counted(done: DataFrame, plan: DataFrame) -> DataFrame:
    """Actions with segments, ordinals and numbers counted on from range to range."""
    rows = done.filter("action <> 'end'").join(_aside(plan, "segments", "ordinals", "numbers"), _same_place())
    ordinal = F.when(F.col("segment") == 0, F.col("ordinal") + F.col("ordinals")).otherwise(F.col("ordinal"))
    number = F.when(F.col("number") > 0, F.col("number") + F.col("numbers")).otherwise(0)
    return rows.select(*_KEY, "action", "epoch", "seq", "source", (F.col("segment") + F.col("segments")).alias("segment"), ordinal.alias("ordinal"), "cause_epoch", "cause_seq", "place", number.cast("bigint").alias("number"))


def _last_states(done: DataFrame, plan: DataFrame) -> DataFrame:
    """(capture_id, venue, symbol, state, segment, ordinal, number) behind each book's last row; state is Session.state() as JSON."""
    ends = done.filter("action = 'end'").join(_aside(plan, "segments", "ordinals", "numbers"), _same_place())
    ordinal = F.when(F.col("segment") == 0, F.col("ordinal") + F.col("ordinals")).otherwise(F.col("ordinal"))
    end = F.struct("state", (F.col("segment") + F.col("segments")).alias("segment"), ordinal.alias("ordinal"), (F.col("number") + F.col("numbers")).alias("number"))
    return ends.groupBy(*_KEY).agg(F.max_by(end, F.struct("major", "slot")).alias("_end")).select(*_KEY, "_end.*")
