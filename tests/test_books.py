"""Rebuilds against a plain sequential model, in batch and as a stream."""

import json
import random

import pytest
from pyspark.sql import functions as F

from ladderbook.functions import columns as C
from ladderbook.operators.audits import epoch_segments
from ladderbook.operators.levels import STATE, states
from ladderbook.operators.rebuild import parse_market, parse_snapshots, rebuild
from ladderbook.sources.captures import BOOK, MARKET, SNAPSHOTS
from ladderbook.sources.storage import shared_dir

KEY = ["capture_id", "venue", "symbol"]


def plain(rows, snaps, venue, sidecar, trades, cap):
    """One symbol's book rows, told in the order of the rules."""
    pending, init, started, last, buf, epoch, out, seq = True, False, False, 0, [], None, [], 0
    bids, asks, queue = {}, {}, list(snaps)

    def top():
        pad = lambda x: ([p for p, _ in x] + [0] * 5)[:5] + ([q for _, q in x] + [0] * 5)[:5]
        return pad(sorted(bids.items(), reverse=True)[:5]) + pad(sorted(asks.items())[:5])

    def emit(kind, t, levels=None):
        nonlocal seq
        seq += 1
        out.append((t, seq, kind, *(levels or top())))

    def attempt(d):
        nonlocal last, started, pending
        if d["u"] <= last:
            return "stale"
        if (d["pu"] != last if started else d["U"] > last) if venue == "usdm" else d["U"] > last + 1:
            pending = True
            return "gap"
        for side, levels in ((bids, d["b"]), (asks, d["a"])):
            for p, q in levels:
                side.pop(p, None)
                if q:
                    side[p] = q
        last, started = d["u"], True
        return "applied"

    def seed(sb, sa, sid):
        nonlocal last, init, started, pending
        bids.clear(), asks.clear()
        bids.update((p, q) for p, q in sb if q), asks.update((p, q) for p, q in sa if q)
        last, init, started, pending = sid, True, False, False
        while buf:
            d = buf[0]
            if d["u"] <= sid:
                buf.pop(0)
                continue
            r = attempt(d)
            if r == "gap":
                return
            buf.pop(0)
            if r == "applied":
                emit("D", d["t"])

    for m in rows:
        if epoch is not None and epoch != m["epoch"]:
            pending, init, started, last = True, False, False, 0
            buf.clear()
        epoch = m["epoch"]
        if m["kind"] == "depth_diff":
            d = m
            r = "buffered" if pending or not init else attempt(d)
            if r == "applied":
                emit("D", d["t"])
            elif r != "stale":
                if len(buf) >= cap:
                    buf.clear()
                    pending, init, started, last = True, False, False, 0
                buf.append(d)
                if queue:
                    s = queue.pop(0)
                    seed(s["b"], s["a"], s["id"])
        elif m["kind"] == "depth5":
            if not sidecar:
                seed(m["b"], m["a"], m["id"])
            pad = lambda x: ([p for p, _ in x] + [0] * 5)[:5] + ([q for _, q in x] + [0] * 5)[:5]
            emit("S", m["t"], pad(m["b"][:5]) + pad(m["a"][:5]))
        elif trades and init and not pending:
            emit("T", m["t"])
    return out


def made(seed, venue, n=120):
    rng = random.Random(seed)
    rows, snaps, u, epoch, seq = [], [], 100, 0, 0
    level = lambda: [(rng.randint(90, 110), rng.choice([0, 0, 1, 2, 3])) for _ in range(rng.randint(0, 4))]
    for t in range(n):
        if rng.random() < 0.04:
            epoch, seq = epoch + 1, 0
        seq += rng.randint(1, 2)
        kind = rng.choices(["depth_diff", "depth5", "trade"], [8, 1, 1])[0]
        m = {"kind": kind, "epoch": epoch, "seq": seq, "t": t}
        if kind == "depth_diff":
            first, pu = u + 1 + rng.choices([0, 3, -4], [12, 1, 1])[0], u + rng.choices([0, 2], [9, 1])[0]
            final = max(first, u + rng.randint(1, 4) - rng.choices([0, 9], [9, 1])[0])
            m |= {"U": first, "u": final, "pu": pu, "b": level(), "a": level()}
            u = max(u, final)
        elif kind == "depth5":
            m |= {"id": u - rng.randint(0, 2), "b": [(x, rng.randint(0, 3)) for x in range(100, 100 - rng.randint(1, 6), -1)], "a": [(x, 1) for x in range(101, 104)]}
        rows.append(m)
        if rng.random() < 0.12:
            snaps.append({"id": u - rng.randint(0, 6), "b": level() + level(), "a": level()})
    return rows, snaps


def text(levels):
    return [[f"{p}.0", f"{q}"] for p, q in levels]


def tables(spark, cases, venue):
    market, side = [], []
    for symbol, (rows, snaps) in cases.items():
        for m in rows:
            if m["kind"] == "depth_diff":
                payload = {"e": "depthUpdate", "U": m["U"], "u": m["u"], "pu": m["pu"], "b": text(m["b"]), "a": text(m["a"])}
            elif m["kind"] == "depth5":
                payload = {"lastUpdateId": m["id"], "bids": text(m["b"]), "asks": text(m["a"])}
            else:
                payload = {"e": "trade", "E": 5}
            market.append((m["t"], 7, venue, m["kind"], 0, m["epoch"], m["seq"], symbol, json.dumps(payload)))
        for k, s in enumerate(snaps):
            side.append((k, 0, symbol, s["id"], json.dumps({"lastUpdateId": s["id"], "bids": text(s["b"]), "asks": text(s["a"])}), k, venue))
    parsed = parse_market(spark.createDataFrame(market, MARKET).withColumn("capture_id", F.lit("x")))
    snapshots = parse_snapshots(spark.createDataFrame(side, SNAPSHOTS + ", snap_ord bigint, venue string").withColumn("capture_id", F.lit("x")))
    return parsed, snapshots


def expected(cases, venue, sidecar, trades, cap):
    scale = lambda r: (*r[:3], *(x * 10**8 for x in r[3:]))
    return sorted((s, *scale(r)) for s, (rows, snaps) in cases.items() for r in plain(rows, snaps if sidecar else [], venue, sidecar, trades, cap))


def rows_of(book):
    return sorted(tuple(r) for r in book.select("symbol", "tsec", "seqNo", "type", *BOOK[6:]).collect())


@pytest.mark.parametrize("venue,sidecar,trades,cap,chunk", [("spot", True, True, 4, 3), ("usdm", True, False, 65_536, 1024), ("spot", False, True, 65_536, 5), ("usdm", False, True, 65_536, 16)])
def test_rebuild_equals_plain_model(spark, venue, sidecar, trades, cap, chunk):
    cases = {f"S{i}": made(i, venue) for i in range(8)}
    parsed, snapshots = tables(spark, cases, venue)
    found = rebuild(parsed, snapshots if sidecar else None, trades, chunk, cap)
    want = expected(cases, venue, sidecar, trades, cap)
    assert rows_of(found.book) == want and want


@pytest.mark.parametrize("venue,sidecar", [("spot", True), ("usdm", True), ("spot", False)])
def test_stream_equals_plain_model(spark, venue, sidecar):
    from ladderbook.streaming.books import book_stream, messages, snapshot_messages

    cases = {f"S{i}": made(10 + i, venue, 60) for i in range(3)}
    parsed, snapshots = tables(spark, cases, venue)
    top = f"{shared_dir(spark)}/stream-{venue}-{sidecar}"
    rows = messages(parsed)
    schema = rows.schema
    if sidecar:
        snapshot_messages(snapshots).coalesce(1).write.parquet(f"{top}/in/a")
    for k, name in enumerate(("b", "c", "d")):
        rows.filter((F.col("tsec") >= 20 * k) & (F.col("tsec") < 20 * k + 20)).coalesce(1).write.parquet(f"{top}/in/{name}")
    for k, name in enumerate(("a", "b", "c", "d")):  # one file a batch, in order of time
        if sidecar or k:
            stream = spark.readStream.schema(schema).parquet(f"{top}/in/[a-{name}]")
            query = book_stream(stream, sidecar, trades=True).writeStream.format("parquet").option("path", f"{top}/out").option("checkpointLocation", f"{top}/state").trigger(availableNow=True).start()
            query.awaitTermination()
    assert rows_of(spark.read.parquet(f"{top}/out")) == expected(cases, venue, sidecar, True, 65_536)


@pytest.mark.parametrize("text,want", [("0.0024", 240000), ("100", 10000000000), ("12345.67890000", 1234567890000), ("abc", None), ("-92233720368.54775808", -(2**63)), ("92233720368.54775808", None), ("9" * 27, None), ("0.00000001", 1), ("0.000000001", None), ("1.230000000", 123000000), ("5.", 500000000), (".5", 50000000), ("-", None), ("+5", None), ("1e5", None), ("", None), (".", None), ("0" * 60 + "1", 100000000), ("-0", 0)])
def test_scale_decimal(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(C.scale_decimal(F.col("t"))).first()[0] == want


def test_small_columns(spark):
    one = lambda value, f: spark.createDataFrame([(value,)], "t string").select(f(F.col("t"))).first()[0]
    assert [one(t, C.csv_escape) for t in ("plain", "a,b", 'he"llo')] == ["plain", '"a,b"', '"he""llo"']
    assert [one(t, C.classify_stream) for t in ("x@depth5@100ms", "x@depth5", "x@depth@100ms", "x@trade", "x")] == ["depth5", "depth5", "depth_diff", "trade", "depth_diff"]
    assert [one(t, C.instrument_id) for t in ("BTCUSDT", "ETHUSDT", "")] == [1747767916, 1617942128, 18652613]
    env = lambda t: spark.createDataFrame([(t,)], "t string").select(*C.split_envelope(F.col("t"))).first()
    assert tuple(env('{"stream":"btcusdt@depth","data":{"u":1.50, "x":{}}}')) == ("btcusdt@depth", '{"u":1.50, "x":{}}')
    assert env('{"stream":"a","data":[1]}')[0] is None and env('{"stream":"a"}')[0] is None and env('{"stream":"a","data":{')[0] is None
    msg = spark.createDataFrame([('{"U":1,"u":2,"b":[["abc","1"]],"a":[]}',), ('{"U":1,"u":2,"b":[["1","1"],["2"],"x"],"a":[]}',), ("{}",)], "payload_json string")
    got = [r[0] for r in C.with_message(msg, "payload_json").select("message").collect()]
    assert [m["valid"] for m in got] == [False, True, False] and len(got[1]["bids"]) == 1


def test_captures_with_and_without_a_sidecar(spark):
    cases = {f"S{i}": made(20 + i, "spot", 80) for i in range(3)}
    parsed, snapshots = tables(spark, cases, "spot")
    both = parsed.unionByName(parsed.withColumn("capture_id", F.lit("y")))
    flags = spark.createDataFrame([("x", True), ("y", False)], "capture_id string, have_sidecar boolean")
    book = rebuild(both, snapshots, sidecars=flags).book
    assert rows_of(book.filter("capture_id = 'x'")) == expected(cases, "spot", True, False, 65_536)
    assert rows_of(book.filter("capture_id = 'y'")) == expected(cases, "spot", False, False, 65_536)


def test_overload_and_observed_counters(spark):
    from pyspark.sql import Observation

    from ladderbook.operators import audits
    from ladderbook.sources import captures

    market = spark.range(342).selectExpr("'c' as capture_id", "cast(id % 2 as int) as shard", "'S' || id as symbol", "'trade' as stream_kind")
    one = audits.shard_load(market.withColumns({"shard_id": F.lit(0), "conn_epoch": F.lit(0)})).collect()
    two = audits.shard_load(market.withColumns({"shard_id": F.col("shard"), "conn_epoch": F.lit(0)})).collect()
    assert [r["over"] for r in one] == [True] and [r["over"] for r in two] == [False, False]
    seen = Observation("seen")
    audits.observed(market, seen).collect()
    assert seen.get["msgs_total"] == seen.get["trade"] == 342
    files = spark.createDataFrame([("a_snapshots",)], "capture_id string")
    got = captures.sidecars(spark.createDataFrame([("a",), ("b",)], "capture_id string"), files).collect()
    assert {r["capture_id"]: r["have_sidecar"] for r in got} == {"a": True, "b": False}


@pytest.mark.parametrize("venue", ["spot", "usdm"])
@pytest.mark.parametrize("sidecar", [True, False])
def test_stretches_equal_single_messages(venue, sidecar, monkeypatch):
    import pyarrow as pa

    from ladderbook.operators import sequencing

    names = ["capture_id", "venue", "symbol", "sidecar", "epoch", "seq", "kind", "valid", "first_id", "final_id", "pu", "last_id"]
    rows = []
    for s in range(6):
        made_rows, snaps = made(40 + s, venue, 300)
        rng = random.Random(s)
        if sidecar:
            rows += [("c", venue, f"S{s}", True, -1, k, "snapshot", True, 0, 0, 0, x["id"]) for k, x in enumerate(snaps)]
        rows += [("c", venue, f"S{s}", sidecar, m["epoch"], m["seq"], m["kind"], rng.random() > 0.03 or m["kind"] == "trade", m.get("U", 0), m.get("u", 0), m.get("pu", 0), m.get("id", 0)) for m in made_rows]
    batches = [pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows[i : i + 70]]) for i in range(0, len(rows), 70)]
    for trades, cap in ((True, 4), (False, 65_536), (True, 65_536)):
        results = []
        for least in (1, 1 << 30):
            monkeypatch.setattr(sequencing, "LEAST", least)
            out = sequencing._run({"trades": trades, "cap": cap, "seed_by_final_id": False})(iter(batches))
            results.append([tuple(r.values()) for b in out for r in b.to_pylist()])
        assert results[0] == results[1] and len(results[0]) > 500


@pytest.mark.parametrize("chunk", [1, 3, 8, 100])
def test_best_of_deep_books_by_chunks(spark, chunk):
    rng = random.Random(chunk)
    writes, live, want = [], {}, []
    for t in range(60):
        prices = rng.sample(range(60), 50 if t == 0 else rng.randint(1, 3))
        for p in prices:
            for side in (0, 1):
                q = rng.choice([0, 1, 2, 3]) if t else 1 + p
                if t or q:
                    writes.append(("c", "v", "s", 0, t, side, 1000 * side + p, q))
                    live[side, 1000 * side + p] = q
        row = [t]
        for side, order in ((0, -1), (1, 1)):
            best = sorted((order * p, q) for (n, p), q in live.items() if n == side and q)[:5]
            best += [(0, 0)] * (5 - len(best))
            row += [order * p for p, _ in best] + [q for _, q in best]
        want.append(tuple(row))
    frame = spark.createDataFrame(writes, "capture_id string, venue string, symbol string, segment bigint, ordinal bigint, side int, price bigint, qty bigint")
    marks = frame.select("capture_id", "venue", "symbol", "segment", "ordinal").distinct()
    found = states(frame, marks, chunk).select("ordinal", *STATE).orderBy("ordinal").collect()
    assert [tuple(r) for r in found] == want


def test_connections_in_order(spark):
    rows = [("x", "spot", "A", e, n) for e, n in [(None, 3), (2, 5), (2, 6), (4, 1), (4, 1), (4, 2), (9, 7)]] + [("x", "spot", None, 1, 1), ("x", "spot", None, 3, 2)]
    frame = spark.createDataFrame(rows, "capture_id string, venue string, symbol string, conn_epoch bigint, conn_seq bigint")
    found = sorted((str(r.symbol), r.conn_epoch or 0, r.conn_seq, r.changed, r.epoch_seg) for r in epoch_segments(frame).collect())
    assert found == sorted([("A", 0, 3, False, 0), ("A", 2, 5, False, 0), ("A", 2, 6, False, 0), ("A", 4, 1, True, 1), ("A", 4, 1, True, 1), ("A", 4, 2, False, 1), ("A", 9, 7, True, 2), ("None", 1, 1, False, 0), ("None", 3, 2, True, 1)])
