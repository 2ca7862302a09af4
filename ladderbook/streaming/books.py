"""Books kept by a stream: the batch job's rules, with levels in the state store.

Messages and snapshots arrive in one stream under the book's key. Inside a micro-batch they are put in
order of connection and number; across batches the order of arrival counts, and what comes late is
stale by its ids. Needs the RocksDB state store.
"""

from __future__ import annotations

import json
import uuid
from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from ..functions import columns as C
from ..operators import levels
from ..operators.levels import STATE
from ..operators.rebuild import Rebuilt
from ..operators.session import BUFFER, Diff, Session
from ..sources.captures import BOOK
from ..sources.storage import shared_dir, written

KEY = ["capture_id", "venue", "symbol"]
BAND = 128  # levels of a band of prices
BATCH = 1 << 27  # bytes of messages, about, that a micro-batch of run_books() takes
_MESSAGE = "epoch bigint, seq bigint, kind string, valid boolean, first_id bigint, final_id bigint, pu bigint, last_id bigint, tsec bigint, tnsec int, levels string"
#: counters of a book, as Session's actions and the messages tell them
COUNTS = ["msgs_total", "depth_diff", "depth5", "trade", "parse_errors", "gaps", "reconnects", "resyncs", "buffer_overflows", "depth5_mismatch", "ob_rows"]
_HEAD = "epoch bigint, pending boolean, ready boolean, started boolean, last bigint, segment bigint, ordinal bigint, number bigint"
ROWS = T.StructType([T.StructField(k, T.StringType()) for k in KEY] + [T.StructField(c, T.StringType() if c in ("type", "side") else T.IntegerType() if c == "tnsec" else T.LongType()) for c in BOOK if c != "id"])


def messages(parsed: DataFrame, *others: str) -> DataFrame:
    """parse_market() rows as the stream's messages, with others of their columns."""
    m = F.col("message")
    ids = [F.coalesce(m[c], F.lit(0).cast("bigint")).alias(c) for c in ("first_id", "final_id", "pu", "last_id")]
    both = F.to_json(F.struct(F.coalesce(m["bids"], F.array()).alias("b"), F.coalesce(m["asks"], F.array()).alias("a")))
    return parsed.select(*KEY, F.col("conn_epoch").alias("epoch"), F.col("conn_seq").alias("seq"), F.col("stream_kind").alias("kind"), "valid", *ids, F.col("recv_tsec").alias("tsec"), F.col("recv_tnsec").alias("tnsec"), both.alias("levels"), *others)


def snapshot_messages(parsed: DataFrame, *others: str) -> DataFrame:
    """parse_snapshots() rows as messages, with others of their columns; they wait in order of snap_ord."""
    as_market = parsed.filter("valid").withColumns({"conn_epoch": F.lit(-1).cast("bigint"), "conn_seq": F.col("snap_ord").cast("bigint"), "stream_kind": F.lit("snapshot")})
    return messages(as_market, *others)


def _levels(text: str) -> tuple[list, list]:
    found = json.loads(text)
    return tuple([(x["price"], x["qty"]) for x in found[side]] for side in "ba")


_NAMES = [f.split()[0] for f in _MESSAGE.split(", ")]
_ARROW = pa.schema([(n, {"bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.large_string()}[t]) for n, t in (f.split() for f in _MESSAGE.split(", "))])
SLICE = 4096  # messages that are taken apart, and book rows that are given out, at once
_COUNTED = {("gap", ""): "gaps", ("reset", ""): "reconnects", ("seed", "snapshot"): "resyncs", ("overflow", ""): "buffer_overflows"}


def _message(row: tuple) -> tuple:
    return (int(row[0]), int(row[1]), row[2], bool(row[3]), *(int(x) for x in row[4:10]), row[10])


def _in_order(frames: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    """A book's messages of a micro-batch in order of connection and number; they are kept packed until it is their turn."""
    table = pa.concat_tables([pa.Table.from_pandas(f[_NAMES], _ARROW, preserve_index=False) for f in frames])
    order = np.lexsort((table["seq"].to_numpy(), table["epoch"].to_numpy()))
    for at in range(0, len(order), SLICE):
        rows = table.take(pa.array(order[at : at + SLICE]))
        yield from map(_message, zip(*(rows[n].to_pylist() for n in _NAMES)))


class Queue:
    """Messages of a book that wait, oldest first, each under a number of its own in the state, which is read when it is its turn.

    first, end: the numbers of the oldest one and of the next to come. So a micro-batch reads and writes what comes
    and goes in it, however many wait. latest: the message that was taken last.
    """

    def __init__(self, first: int = 0, end: int = 0, read: Callable[[int], tuple] | None = None):
        self.first, self.end, self.read = first, end, read
        self.stored = (first, end)
        self.here: dict[int, tuple] = {}
        self.latest: tuple = ()

    def __len__(self) -> int:
        return self.end - self.first

    def put(self, message: tuple) -> None:
        self.here[self.end] = message
        self.end += 1

    def oldest(self) -> tuple:
        if self.first not in self.here:
            self.here[self.first] = _message(self.read(self.first))
        return self.here[self.first]

    def popleft(self) -> None:
        self.latest = self.oldest()
        del self.here[self.first]
        self.first += 1

    def clear(self) -> None:
        self.here.clear()
        self.first = self.end

    def changes(self) -> tuple[range, dict[int, tuple]]:
        """(numbers of stored messages that are gone, new ones by number); stored messages are as said from then on."""
        first, end = self.stored
        gone, new = range(first, min(self.first, end)), {n: m for n, m in self.here.items() if n >= end}
        self.stored = (self.first, self.end)
        return gone, new


class Waiting(Queue):
    """Diffs that wait, as a Session's buffer. coming: the message that is handled."""

    coming: tuple = ()

    def __getitem__(self, at: int) -> Diff:
        """The first of them; others aren't asked for."""
        m = self.oldest()
        return Diff(m[0], self.first, m[4], m[5], m[6])

    def append(self, diff: Diff) -> None:
        self.put(self.coming)


class Sidecar(Queue):
    """Snapshots that wait, as a Session's."""

    def popleft(self) -> tuple[int, int]:
        super().popleft()
        return self.latest[1], self.latest[7]


class Side:
    """One side of a book in a micro-batch: bands of neighbouring prices, each read from the state when it is needed.

    lows: the least key of each stored band, a key being a price whose order has the best first. A band has at
    most BAND levels and is cut in two where it would have more, so a micro-batch reads the bands that its
    messages touch and the best ones, however deep the book is.
    """

    def __init__(self, sign: int, lows: list[int] = (), read: Callable[[int], tuple[list[int], list[int]]] | None = None):
        self.sign, self.read = sign, read  # sign: -1 bids, 1 asks
        self.lows = list(lows)
        self.stored = set(self.lows)
        self.bands: dict[int, tuple[list[int], dict[int, int]]] = {}  # by low: keys in order, and sizes
        self.touched: set[int] = set()

    def band(self, low: int) -> tuple[list[int], dict[int, int]]:
        if low not in self.bands:
            keys, sizes = self.read(low)
            self.bands[low] = (keys, dict(zip(keys, sizes)))
        return self.bands[low]

    def clear(self) -> None:
        self.lows.clear()
        self.bands.clear()
        self.touched.clear()

    def put(self, price: int, size: int) -> None:
        """size 0 takes the level away."""
        key = self.sign * price
        at = bisect_right(self.lows, key) - 1
        if at < 0:  # before all bands: the first one begins here from now on
            if not size:
                return
            if self.lows:
                self.bands[key] = self.band(self.lows[0])
                del self.bands[self.lows[0]]
                self.touched.discard(self.lows[0])
                self.lows[0] = key
            else:
                self.lows.append(key)
                self.bands[key] = ([], {})
            at = 0
        low = self.lows[at]
        keys, sizes = self.band(low)
        known = key in sizes
        if size:
            if not known:
                insort(keys, key)
            elif sizes[key] == size:
                return
            sizes[key] = size
        elif known:
            del sizes[key]
            del keys[bisect_left(keys, key)]
        else:
            return
        self.touched.add(low)
        if not keys:
            del self.lows[at], self.bands[low]
            self.touched.discard(low)
        elif len(keys) > BAND:
            half = len(keys) // 2
            upper = keys[half:]
            del keys[half:]
            self.bands[upper[0]] = (upper, {k: sizes.pop(k) for k in upper})
            self.lows.insert(at + 1, upper[0])
            self.touched.add(upper[0])

    def best(self) -> list[tuple[int, int]]:
        found: list[tuple[int, int]] = []
        for low in self.lows:
            keys, sizes = self.band(low)
            found += [(self.sign * k, sizes[k]) for k in keys[: 5 - len(found)]]
            if len(found) == 5:
                break
        return found

    def changes(self) -> tuple[list[int], dict[int, tuple[list[int], list[int]]]]:
        """(lows of stored bands that are gone, new contents by low); stored bands are as said from then on."""
        gone = [low for low in self.stored if low not in set(self.lows)]
        kept = {low: (self.bands[low][0], [self.bands[low][1][k] for k in self.bands[low][0]]) for low in self.touched}
        kept |= {low: (self.bands[low][0], [self.bands[low][1][k] for k in self.bands[low][0]]) for low in self.lows if low not in self.stored}
        self.stored = set(self.lows)
        self.touched.clear()
        return gone, kept


class BookProcessor(StatefulProcessor):
    def __init__(self, have_sidecar: bool, trades: bool = False, cap: int = BUFFER):
        self.options = (have_sidecar, trades, cap)

    def init(self, handle) -> None:
        self.head = handle.getValueState("head", _HEAD)
        self.waiting = handle.getMapState("waiting", "n bigint", _MESSAGE)
        self.snapshots = handle.getMapState("snapshots", "n bigint", _MESSAGE)
        self.queues = handle.getValueState("queues", "waiting bigint, waiting_end bigint, snapshots bigint, snapshots_end bigint")
        self.bands = handle.getMapState("bands", "side int, low bigint", "levels string")
        self.lows = handle.getValueState("lows", "bids string, asks string")
        self.counts = handle.getValueState("counts", ", ".join(f"{n} bigint" for n in COUNTS))

    def close(self) -> None:
        pass

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802, N803
        """A book as hand_over() gives it; its rows come in pieces, in any order."""
        rows = initialState
        for text in rows[rows["part"] == "head"]["head"]:
            state = json.loads(text)
            self.head.update((-1 if state[0] is None else int(state[0]), *(bool(x) for x in state[1:4]), *(int(x) for x in state[4:])))
        ends = list(self._ends())
        for k, part, kept in ((1, "waiting", self.waiting), (3, "snapshot", self.snapshots)):
            own = rows[rows["part"] == part]
            for n, m in zip(own["at"].tolist(), own[_NAMES].itertuples(index=False, name=None)):
                kept.updateValue((n,), _message(m))
                ends[k] = max(ends[k], n + 1)
        self.queues.update(tuple(ends))
        own = rows[rows["part"] == "level"]
        book = self._book()
        for side, price, qty in zip(own["side"], own["price"], own["qty"]):
            book[int(side)].put(int(price), int(qty))
        self._keep(book)

    def _ends(self) -> tuple[int, ...]:
        return tuple(self.queues.get()) if self.queues.exists() else (0, 0, 0, 0)

    def _book(self) -> tuple[Side, Side]:
        lows = [json.loads(x) for x in self.lows.get()] if self.lows.exists() else ([], [])
        return tuple(Side(sign, lows[n], lambda low, n=n: json.loads(self.bands.getValue((n, low))[0])) for n, sign in enumerate((-1, 1)))

    def _keep(self, book: tuple[Side, Side]) -> None:
        for n, side in enumerate(book):
            gone, kept = side.changes()
            for low in gone:
                self.bands.removeKey((n, low))
            for low, levels in kept.items():
                self.bands.updateValue((n, low), (json.dumps(levels),))
        self.lows.update(tuple(json.dumps(side.lows) for side in book))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802
        sidecar, trades, cap = self.options
        session = Session(key[1] == "usdm", sidecar, trades, cap)
        if self.head.exists():
            h = self.head.get()
            session.epoch = None if h[0] is None or h[0] < 0 else h[0]
            session.pending, session.ready, session.started = bool(h[1]), bool(h[2]), bool(h[3])
            session.last, session.segment, session.ordinal, session.number = h[4], h[5], h[6], h[7]
        ends = self._ends()
        session.buffer = waiting = Waiting(*ends[:2], lambda n: self.waiting.getValue((n,)))
        session.snapshots = snapshots = Sidecar(*ends[2:], lambda n: self.snapshots.getValue((n,)))
        count = dict(zip(COUNTS, self.counts.get())) if self.counts.exists() else dict.fromkeys(COUNTS, 0)
        book = self._book()
        out: list[tuple] = []
        for n, m in enumerate(_in_order(rows)):
            if m[2] == "snapshot":
                snapshots.put(m)
                continue
            waiting.coming = m
            count["msgs_total"] += 1
            count[m[2]] += 1
            count["parse_errors"] += not m[3]
            for a in session.message(m[2], m[3], m[0], n, *m[4:8]):
                if (counter := _COUNTED.get((a.action, a.source))) is not None:
                    count[counter] += 1
                if a.action == "seed":
                    source = snapshots.latest if a.source == "snapshot" else m
                    for side, levels in zip(book, _levels(source[10])):
                        side.clear()
                        for p, q in levels:
                            if q:
                                side.put(p, q)
                elif a.action == "apply":
                    d = waiting.latest if a.source == "buffer" else m
                    for side, levels in zip(book, _levels(d[10])):
                        for p, q in levels:
                            side.put(p, q)
                    out.append((*key, d[8], d[9], a.number, "D", "N", *_best(book)))
                elif a.action == "trade":
                    out.append((*key, m[8], m[9], a.number, "T", "N", *_best(book)))
                elif a.action == "check":
                    bids, best = _levels(m[10])[0], book[0].best()
                    count["depth5_mismatch"] += bool(bids) and bids[0][0] != (best[0][0] if best else 0)
                elif a.action == "partial":
                    out.append((*key, m[8], m[9], a.number, "S", "N", *_first(_levels(m[10]))))
                elif a.action in ("reset", "overflow"):
                    for side in book:
                        side.clear()
                if len(out) == SLICE:
                    count["ob_rows"] += len(out)
                    yield pd.DataFrame(out, columns=[f.name for f in ROWS])
                    out = []
        self.head.update((-1 if session.epoch is None else session.epoch, session.pending, session.ready, session.started, session.last, session.segment, session.ordinal, session.number))
        for queue, kept in ((waiting, self.waiting), (snapshots, self.snapshots)):
            gone, new = queue.changes()
            for n in gone:
                kept.removeKey((n,))
            for n, m in new.items():
                kept.updateValue((n,), m)
        self.queues.update((waiting.first, waiting.end, snapshots.first, snapshots.end))
        self._keep(book)
        count["ob_rows"] += len(out)
        self.counts.update(tuple(int(count[c]) for c in COUNTS))
        yield pd.DataFrame(out, columns=[f.name for f in ROWS])


def _padded(levels: list[tuple[int, int]]) -> list[int]:
    levels = levels + [(0, 0)] * (5 - len(levels))
    return [p for p, _ in levels] + [q for _, q in levels]


def _best(book: tuple[Side, Side]) -> list[int]:
    return _padded(book[0].best()) + _padded(book[1].best())


def _first(levels: tuple[list, list]) -> list[int]:
    return _padded(levels[0][:5]) + _padded(levels[1][:5])


def book_stream(stream: DataFrame, have_sidecar: bool, trades: bool = False, cap: int = BUFFER, start: DataFrame | None = None) -> DataFrame:
    """A stream of messages() and snapshot_messages() as book rows; start: books that hand_over() gives, from which it goes on."""
    initial = None if start is None else start.groupBy(*KEY)
    rows = stream.groupBy(*KEY).transformWithStateInPandas(BookProcessor(have_sidecar, trades, cap), ROWS, "append", "None", initialState=initial)
    return rows.withColumn("id", C.instrument_id(F.col("symbol"))).select(*KEY, *BOOK)


def hand_over(found: Rebuilt) -> DataFrame:
    """The books of a rebuild as a stream takes them up: a row `head` each, live levels, diffs that wait and snapshots that
    aren't used yet. Rebuilt and stream have to have the same options."""
    state = F.from_json("state", "array<string>")
    heads = found.ends.select(*KEY, "state", "segment", "ordinal", "number").withColumn("_s", state)
    lean = F.array(*[F.col("_s")[k] for k in range(5)], *[F.col(c).cast("string") for c in ("segment", "ordinal", "number")])
    text = F.concat(F.lit("["), F.array_join(lean, ",", "null"), F.lit("]"))
    types = {"head": "string", "side": "int", "price": "bigint", "qty": "bigint", "at": "bigint"} | dict(f.split() for f in _MESSAGE.split(", "))
    empty = {"string": "", "boolean": False}  # no nulls: they would turn a column's numbers into doubles on their way

    def part(name: str, rows: DataFrame) -> DataFrame:
        have = set(rows.columns)
        return rows.select(*KEY, F.lit(name).alias("part"), *[(F.col(c) if c in have else F.lit(empty.get(t, 0))).cast(t).alias(c) for c, t in types.items()])

    ready = heads.filter(F.col("_s")[2] == "true").select(*KEY, "segment")
    live = levels.state_at_end(found.writes.join(ready, [*KEY, "segment"], "left_semi"))
    waiting = heads.select(F.posexplode(F.from_json(F.col("_s")[6], "array<array<bigint>>")).alias("at", "_d")).select("at", F.col("_d")[1].alias("rid"))
    waiting = messages(found.rows.join(waiting, "rid"), "at")
    parts = part("head", heads.withColumn("head", text)).unionByName(part("level", live)).unionByName(part("waiting", waiting))
    if found.snapshots is None:
        return parts
    used = heads.select(*KEY, F.col("_s")[5].cast("bigint").alias("_used"))
    order = F.row_number().over(Window.partitionBy(*KEY).orderBy("snap_ord"))  # a book's snapshots, ids only
    places = found.snapshots.filter("valid").select(*KEY, "snap_ord").withColumn("_n", order).join(used, KEY).filter("_n > _used").select(*KEY, "snap_ord", (F.col("_n") - F.col("_used") - 1).alias("at"))
    left = snapshot_messages(found.snapshots.join(places, [*KEY, "snap_ord"]), "at")
    return parts.unionByName(part("snapshot", left))


def health(spark: SparkSession, state: str) -> DataFrame:
    """The counters of the live books whose stream has its checkpoint at `state`, read from the state store."""
    counts = spark.read.format("statestore").option("path", state).option("stateVarName", "counts").load()
    return counts.select(*[F.col("key")[k].alias(k) for k in KEY], *[F.col("value")[c].alias(c) for c in COUNTS])


def _batches(rows: DataFrame, path: str, size: int) -> list[str]:
    """rows written in parts of about `size` bytes: their folders, in an order in which each book's rows are in order.

    Snapshots come before all messages; both are dealt out by connection and number, each evenly by itself, as one
    may be much longer than the other.
    """
    late, weight = F.col("kind") != "snapshot", F.octet_length("levels") + 128
    rows = written(rows, "messages")
    sizes = {r["late"]: r["bytes"] for r in rows.groupBy(late.alias("late")).agg(F.sum(weight).alias("bytes")).collect()}
    for k, n in sizes.items():
        dealt = rows.filter(late == F.lit(k)).repartitionByRange(-(-n // size), "epoch", "seq", *KEY)
        dealt.withColumn("batch", F.spark_partition_id()).write.partitionBy("batch").parquet(f"{path}/{int(k)}")
    read = rows.sparkSession.read
    return [f"{path}/{int(k)}/batch={r[0]}" for k in sorted(sizes) for r in sorted(read.parquet(f"{path}/{int(k)}").select("batch").distinct().collect())]


def run_books(spark: SparkSession, rows: DataFrame, have_sidecar: bool, start: DataFrame | None = None, trades: bool = False, size: int = BATCH) -> tuple[DataFrame, DataFrame]:
    """Messages landed as files and kept as live books until all are taken: (book rows, health()).

    They land in parts of about `size` bytes, each as one file and when the one before it is done, so that a micro-batch
    is bounded and the order of arrival is that of the messages.
    """
    top = f"{shared_dir(spark)}/live-{uuid.uuid4().hex}"
    parts = [spark.read.schema(rows.schema).parquet(p) for p in _batches(rows, f"{top}/parts", size)]
    if start is not None or not parts:  # books that are handed over come alone, as Spark holds the messages beside them back
        parts.insert(0, rows.limit(0))

    def land(part: DataFrame) -> None:
        part.coalesce(1).write.mode("append").option("maxRecordsPerFile", 0).parquet(f"{top}/in")

    land(parts[0])
    stream = spark.readStream.schema(rows.schema).parquet(f"{top}/in")
    store, rocks = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(store, None)
    spark.conf.set(store, rocks)
    query = None
    try:
        query = book_stream(stream, have_sidecar, trades, start=start).writeStream.format("parquet").option("path", f"{top}/out").option("checkpointLocation", f"{top}/state").start()
        query.processAllAvailable()
        for part in parts[1:]:
            land(part)
            query.processAllAvailable()
        return spark.read.parquet(f"{top}/out"), written(health(spark, f"{top}/state"), "health")
    finally:
        if query is not None:
            query.stop()
        spark.conf.set(store, before) if before else spark.conf.unset(store)


assert [c for c in BOOK if c not in ("tsec", "tnsec", "seqNo", "id", "type", "side")] == STATE
