"""Streams: several outputs of one pass, hand-over from batch to stream, counters of live books."""

import pytest
from pyspark.sql import functions as F

from ladderbook.operators import audits
from ladderbook.operators.rebuild import rebuild
from ladderbook.streaming.books import COUNTS, hand_over, messages, run_books, snapshot_messages
from ladderbook.streaming.capture import write_outputs

from .test_books import expected, made, rows_of, tables


@pytest.mark.parametrize("venue,sidecar,cut", [("spot", True, 31), ("spot", False, 77), ("usdm", True, 50)])
def test_half_batch_half_stream(spark, venue, sidecar, cut):
    """A rebuild up to some row, whatever state it leaves, and a stream from there give the whole book."""
    cases = {f"S{i}": made(80 + i, venue, 100) for i in range(6)}
    parsed, snapshots = tables(spark, cases, venue)
    found = rebuild(parsed.filter(F.col("recv_tsec") < cut), snapshots if sidecar else None, True)
    later, _ = run_books(spark, messages(parsed.filter(F.col("recv_tsec") >= cut)), sidecar, hand_over(found), True)
    assert rows_of(found.book.unionByName(later)) == expected(cases, venue, sidecar, True, 65_536)


@pytest.mark.parametrize("venue,cut", [("spot", 31), ("usdm", 60)])
def test_books_are_handed_over_in_pieces(spark, venue, cut):
    """A book of more rows than Spark gives a worker at once; some of its numbers are beyond what doubles hold."""
    big = 24_000_000_001
    cases = {f"S{i}": made(100 + i, venue, 100) for i in range(4)}
    for rows, _ in cases.values():
        for m in rows:
            m |= {k: [(p, q * big) for p, q in m[k]] for k in ("b", "a") if k in m}
    parsed, snapshots = tables(spark, cases, venue)
    found = rebuild(parsed.filter(F.col("recv_tsec") < cut), snapshots, True)
    limit = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "3")
    try:
        later, _ = run_books(spark, messages(parsed.filter(F.col("recv_tsec") >= cut)), True, hand_over(found), True)
    finally:
        spark.conf.set(limit, before)
    assert rows_of(found.book.unionByName(later)) == expected(cases, venue, True, True, 65_536)


@pytest.mark.parametrize("sidecar", [True, False])
def test_health_equals_metrics(spark, sidecar):
    cases = {f"S{i}": made(90 + i, "spot", 100) for i in range(4)}
    parsed, snapshots = tables(spark, cases, "spot")
    found = rebuild(parsed, snapshots if sidecar else None)
    rows = messages(parsed)
    if sidecar:
        rows = rows.unionByName(snapshot_messages(snapshots))
    _, health = run_books(spark, rows, sidecar)
    want = audits.metrics(parsed, found.actions, found.book, found.checks, by=("symbol",)).filter("symbol is not null")
    assert sorted(map(tuple, health.select("symbol", *COUNTS).collect())) == sorted(map(tuple, want.select("symbol", *COUNTS).collect()))


@pytest.mark.parametrize("venue,sidecar", [("spot", True), ("usdm", False)])
def test_live_books_take_bounded_batches(spark, venue, sidecar):
    """Messages are taken in parts, however many have landed, and in order."""
    cases = {f"S{i}": made(110 + i, venue, 100) for i in range(3)}
    parsed, snapshots = tables(spark, cases, venue)
    rows = messages(parsed.orderBy(F.rand(1)))
    if sidecar:
        rows = rows.unionByName(snapshot_messages(snapshots))
    book, health = run_books(spark, rows, sidecar, trades=True, size=20_000)
    assert rows_of(book) == expected(cases, venue, sidecar, True, 65_536)
    assert health.agg(F.sum("msgs_total")).first()[0] == 300
    state = spark.read.text(f"{book.inputFiles()[0].rsplit('/', 2)[0]}/state/commits/[0-9]*")
    assert len(state.inputFiles()) >= 4


def test_a_batch_that_comes_again_adds_nothing(spark, tmp_path):
    frames = spark.createDataFrame([('{"stream":"a@trade","data":{"E":1}}', 0, 0, 1, 5, 6), ('{"stream":"b@depth","data":{"u":"x"}}', 0, 0, 2, 5, 6), ("{", 0, 0, 3, 5, 6)], "frame string, shard_id int, conn_epoch bigint, conn_seq bigint, recv_tsec bigint, recv_tnsec int")
    listed = spark.createDataFrame([("B",)], "symbol string")
    for batch in (0, 1, 1):
        write_outputs(frames, batch, f"file://{tmp_path}", "recv", "usdm", "cap", listed)
    read = lambda name: spark.read.parquet(f"file://{tmp_path}/{name}")
    assert sorted((r["symbol"], r["venue"], r["capture_id"], r["batch"]) for r in read("market").collect()) == [(s, "usdm", "cap", b) for s in "AB" for b in (0, 1)]
    assert sorted((r["conn_seq"], r["reason"], r["batch"]) for r in read("quarantine").collect()) == [(2, "payload", 0), (2, "payload", 1), (3, "envelope", 0), (3, "envelope", 1)]
    assert sorted((str(r["symbol"]), r["frames"], r["md_rows"], r["taken"], r["parse_errors"]) for r in read("counters").filter("batch = 1").collect()) == [("A", 1, 1, 0, 0), ("B", 1, 1, 0, 1), ("None", 1, 0, 0, 1)]


def test_deep_books_are_read_in_bands():
    """100 messages on 10,000 levels a side read under a twentieth of them, and tell what a plain book tells."""
    import random

    from ladderbook.streaming.books import Side

    rng = random.Random(1)
    for sign in (-1, 1):
        plain, store = {}, {}
        side = Side(sign)
        for p in rng.sample(range(1, 100_000), 10_000):
            plain[p] = rng.randint(1, 9)
            side.put(p, plain[p])
        gone, kept = side.changes()
        store.update(kept)
        read, lows = 0, list(side.lows)

        def fetch(low):
            nonlocal read
            read += len(store[low][0])
            return [list(x) for x in store[low]]

        side = Side(sign, lows, fetch)
        near = sorted(plain, key=lambda p: sign * p)[:200]
        for _ in range(100):
            p, q = rng.choice(near) + rng.randint(-3, 3), rng.randint(0, 3)
            plain.pop(p, None)
            if q:
                plain[p] = q
            side.put(p, q)
            assert side.best() == [(k, plain[k]) for k in sorted(plain, key=lambda p: sign * p)[:5]]
        assert read < 500
        gone, kept = side.changes()
        for low in gone:
            del store[low]
        store.update(kept)
        found = {sign * k: q for keys, sizes in store.values() for k, q in zip(keys, sizes)}
        assert found == plain and sorted(store) == side.lows


@pytest.mark.parametrize("band", [1, 2, 5])
def test_bands_under_random_updates(monkeypatch, band):
    import random

    from ladderbook.streaming import books

    monkeypatch.setattr(books, "BAND", band)
    rng = random.Random(band)
    for sign in (-1, 1):
        plain, store, lows = {}, {}, []
        for _ in range(60):
            side = books.Side(sign, lows, lambda low: [list(x) for x in store[low]])
            for _ in range(rng.randint(0, 12)):
                if rng.random() < 0.03:
                    plain.clear()
                    side.clear()
                p, q = rng.randint(1, 25), rng.choice([0, 0, 1, 2])
                plain.pop(p, None)
                if q:
                    plain[p] = q
                side.put(p, q)
                assert side.best() == [(k, plain[k]) for k in sorted(plain, key=lambda p: sign * p)[:5]]
            gone, kept = side.changes()
            for low in gone:
                del store[low]
            store.update({low: [list(x) for x in levels] for low, levels in kept.items()})
            lows = list(side.lows)
            assert {sign * k: q for keys, sizes in store.values() for k, q in zip(keys, sizes)} == plain and sorted(store) == lows


def test_typed_captures_need_no_json(spark, tmp_path):
    from ladderbook.sources import captures

    cases = {f"S{i}": made(95 + i, "spot", 80) for i in range(3)}
    parsed, _ = tables(spark, cases, "spot")
    path = f"file://{tmp_path}/typed"
    captures.write_parsed(parsed, path)
    captures.write_parsed(parsed, path, replace=True)
    typed = captures.read_parsed(spark, path)
    assert "json" not in typed._jdf.queryExecution().toString().lower() and "variant" not in typed._jdf.queryExecution().toString().lower()
    assert rows_of(rebuild(typed).book) == expected(cases, "spot", False, False, 65_536)
