"""Order of rows: places in files, repeated numbers, ranges of a book that run at once; writes and differences."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ladderbook.operators import audits, levels, sequencing
from ladderbook.operators.frames import audit_rows, quarantined
from ladderbook.operators.numbering import numbered
from ladderbook.operators.rebuild import parse_market, rebuild, rebuild_files
from ladderbook.sources import captures
from ladderbook.sources.captures import MARKET

from .test_books import expected, made, rows_of, tables


@pytest.mark.parametrize("venue,sidecar,cap", [("spot", True, 65_536), ("spot", False, 65_536), ("usdm", True, 5), ("usdm", False, 65_536)])
def test_ranges_equal_one_pass(spark, venue, sidecar, cap, monkeypatch):
    """Books cut into ranges of a few numbers, with few or no rounds of repair, against the plain model."""
    monkeypatch.setattr(sequencing, "AHEAD", 1)
    cases = {f"S{i}": made(60 + i, venue, 150) for i in range(5)}
    parsed, snapshots = tables(spark, cases, venue)
    want = expected(cases, venue, sidecar, True, cap)
    for span, rounds in ((11, 1), (40, 0)):
        found = rebuild(parsed, snapshots if sidecar else None, True, 64, cap, span=span, rounds=rounds)
        assert rows_of(found.book) == want


def test_a_healthy_book_takes_one_round(spark, monkeypatch):
    """No range of a long healthy book runs twice."""
    ran = []
    run = sequencing._ranges_run
    monkeypatch.setattr(sequencing, "_ranges_run", lambda head, plan, options: ran.append(plan.count()) or run(head, plan, options))
    rows = [(t, 0, "spot", "depth_diff", 0, 0, t + 1, "A", json.dumps({"U": 10 * t + 1, "u": 10 * t + 10, "b": [["1", "2"]], "a": []})) for t in range(3000)]
    parsed = parse_market(spark.createDataFrame(rows, MARKET).withColumn("capture_id", F.lit("x")))
    snap = spark.createDataFrame([(0, 0, "A", 5, json.dumps({"lastUpdateId": 5, "bids": [["1", "1"]], "asks": []}), 1, "spot", "x")], "recv_tsec bigint, recv_tnsec int, symbol string, lastUpdateId bigint, payload_json string, snap_ord bigint, venue string, capture_id string")
    from ladderbook.operators.rebuild import parse_snapshots

    book = rebuild(parsed, parse_snapshots(snap), span=100).book
    assert ran == [31] and [tuple(r) for r in book.agg(F.min("seqNo"), F.max("seqNo"), F.count("*")).collect()] == [(1, 3000, 3000)]


def lines(path, rows):
    """A capture file of rows (seq, first, final)."""
    field = lambda p: '"' + json.dumps(p).replace('"', '""') + '"'
    out = [",".join(f.strip().split(" ")[0] for f in MARKET.split(","))]
    out += [f"{k},0,spot,{kind},0,0,{seq},A,{field(payload)}" for k, (kind, seq, payload) in enumerate(rows)]
    path.write_text("\n".join(out) + "\n")


def depth(first, final):
    return {"e": "depthUpdate", "U": first, "u": final, "b": [[f"{final}", "1"]], "a": []}


def test_repeated_numbers_in_file_order(spark, tmp_path):
    """Four diffs numbered 1, 2, 2, 3 behind a checkpoint give four rows, however the file is split."""
    rows = [("depth5", 0, {"lastUpdateId": 0, "bids": [["1", "1"]], "asks": []}), *(("depth_diff", n, depth(10 * k + 1, 10 * k + 10)) for k, n in enumerate((1, 2, 2, 3)))]
    lines(tmp_path / "x.csv", rows)
    books = []
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for split in ("128m", "90b"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "1b")
        try:
            books.append(rows_of(rebuild_files(spark, f"file://{tmp_path}/x.csv", span=20).book))
            at = captures.numbered_places(captures.read_market(spark, f"file://{tmp_path}/x.csv", place=True)).orderBy("rn").select("rn", "recv_tsec").collect()
            assert [(r["rn"], r["recv_tsec"]) for r in at] == [(k + 1, k) for k in range(5)]
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)
            spark.conf.unset("spark.sql.files.openCostInBytes")
    assert books[0] == books[1] and [r[3] for r in sorted(books[0], key=lambda r: r[2])] == ["S", "D", "D", "D", "D"]


def test_repeated_numbers_without_places(spark):
    """Rows of a table that repeat a number are handled by receive time; equal rows all count."""
    rows = [(0, 0, "spot", "depth5", 0, 0, 0, "A", json.dumps({"lastUpdateId": 0, "bids": [["1", "1"]], "asks": []}))]
    rows += [(k + 1, 0, "spot", "depth_diff", 0, 0, n, "A", json.dumps(depth(10 * k + 1, 10 * k + 10))) for k, n in enumerate((1, 2, 2, 3))]
    rows += [(9, 0, "spot", "depth5", 0, 0, 9, "A", json.dumps({"lastUpdateId": 40, "bids": [["1", "1"]], "asks": []}))] * 3
    random.Random(1).shuffle(rows)
    frame = spark.createDataFrame(rows, MARKET).withColumn("capture_id", F.lit("x")).repartition(3)
    found = rebuild(parse_market(frame))
    assert [r[3] for r in sorted(rows_of(found.book), key=lambda r: r[2])] == ["S", "D", "D", "D", "D", "S", "S", "S"]


def test_null_keys_have_books(spark):
    row = lambda symbol, n: (n, 0, "spot", "depth5", 0, None, n, symbol, json.dumps({"lastUpdateId": n, "bids": [["1", "1"]], "asks": []}))
    frame = spark.createDataFrame([row(None, 1), row(None, 2), row("A", 1)], MARKET).withColumn("capture_id", F.lit(None).cast("string"))
    assert sorted((r[0], r[2]) for r in rows_of(rebuild(parse_market(frame)).book)) == [("", 1), ("", 2), ("A", 1)]
    got = numbered(spark.createDataFrame([("c", "v", None, 5), ("c", "v", None, 3), ("c", "v", "A", None)], "capture_id string, venue string, symbol string, n bigint"), ["n"])
    assert sorted((str(r["symbol"]), r["n"] or 0, r["seqNo"]) for r in got.collect()) == [("A", 0, 1), ("None", 3, 1), ("None", 5, 2)]


def test_clashing_columns_of_frames(spark):
    frames = spark.createDataFrame([('{"stream":"a@trade","data":{"E":1}}', 0, 0, 1, 5, 6, "s", "t", True, "p", "m"), ("{", 0, 0, 2, 5, 6, "s", "t", True, "p", "m")], "frame string, shard_id int, conn_epoch bigint, conn_seq bigint, recv_tsec bigint, recv_tnsec int, stream string, symbol string, listed boolean, payload_json string, message string")
    assert [r["symbol"] for r in audit_rows(frames).collect()] == ["A"]
    assert [(r["conn_seq"], r["reason"]) for r in quarantined(frames).collect()] == [(2, "envelope")]


def test_writes_of_a_day_can_be_repeated(spark, tmp_path):
    """In any time zone: the dates are UTC's, a day written again replaces itself and nothing else."""
    day = 86_400
    row = lambda sec, n: (sec, 0, "spot", "trade", 0, 0, n, "A", "{}")
    first = spark.createDataFrame([row(0, 1), row(day - 1, 2), row(day, 3)], MARKET)
    again = spark.createDataFrame([row(day + 5, 9)], MARKET)
    zone = spark.conf.get("spark.sql.session.timeZone")
    for k, z in enumerate(("Asia/Tokyo", "America/Los_Angeles")):
        spark.conf.set("spark.sql.session.timeZone", z)
        try:
            path = f"file://{tmp_path}/{k}"
            captures.write_market(first, path, "parquet")
            for _ in range(2):
                captures.write_market(again, path, "parquet", replace=True)
            got = sorted((str(r["date"]), r["conn_seq"]) for r in spark.read.parquet(path).collect())
            assert got == [("19700101", 1), ("19700101", 2), ("19700102", 9)]
        finally:
            spark.conf.set("spark.sql.session.timeZone", zone)


def book_rows(spark, n, capture="c"):
    cols = [f"cast(id * {k} as bigint) as {c}" for k, c in enumerate(captures.SIDES)]
    return spark.range(n).selectExpr(f"'{capture}' as capture_id", "'spot' as venue", "'S' || id % 2 as symbol", "id div 4 as tsec", "cast(0 as int) as tnsec", "id div 2 as seqNo", "cast(id % 2 as int) as id", "'D' as type", "'N' as side", *cols)


def test_difference_keeps_captures_apart(spark, tmp_path):
    """A row too few in one capture and the same row too many in another are two differences."""
    both = book_rows(spark, 40, "c").unionByName(book_rows(spark, 40, "d"))
    moved = both.withColumn("capture_id", F.when(F.expr("capture_id = 'c' and seqNo = 7 and symbol = 'S1'"), "d").otherwise(F.col("capture_id")))
    got = audits.difference(both, moved, 5).select("capture_id", "symbol", "seqNo", "only_in").collect()
    assert sorted(map(tuple, got)) == [("c", "S1", 7, "left"), ("d", "S1", 7, "right")]
    assert audits.difference(both, both.repartition(7), 5).isEmpty()
    for form in ("csv", "parquet"):
        captures.write_book(both, f"file://{tmp_path}/{form}", form)
        back = captures.read_book(spark, f"file://{tmp_path}/{form}", form)
        assert back.count() == 80 and audits.difference(back, both, 5).isEmpty()
    both.drop("bid3").write.options(header=True).csv(f"file://{tmp_path}/short")
    with pytest.raises(ValueError, match="26 columns"):
        captures.read_book(spark, f"file://{tmp_path}/short", "csv")


def test_sweeps_in_halves(monkeypatch):
    """Chunks that are cut by cells give what one grid gives."""
    rng = np.random.default_rng(2)
    for case in range(30):
        ords = np.arange(1, rng.integers(2, 40))
        n = rng.integers(1, 300)
        cells = np.unique(np.column_stack([rng.integers(0, len(ords) + 1, n), rng.integers(1, 60, n)]), axis=0)
        at, price = cells[:, 0], cells[:, 1]
        qty = rng.integers(0, 3, len(at)) * (at > 0) + (at == 0)
        results = []
        for most in (1 << 40, 1):
            monkeypatch.setattr(levels, "CELLS", most)
            results.append([x.tolist() for x in levels._sweep_side(ords, at, price, qty, (-1, 1)[case % 2])])
        assert results[0] == results[1]


def test_wide_chunks_need_little_memory():
    """1,024 updates of 200 levels over 60,000 prices."""
    import tracemalloc

    rng = np.random.default_rng(3)
    at = np.repeat(np.arange(1, 1025), 200)
    price = rng.integers(1, 60_000, len(at))
    first = np.unique(np.column_stack([at, price]), axis=0)
    tracemalloc.start()
    levels._sweep_side(np.arange(1, 1025), first[:, 0], first[:, 1], rng.integers(0, 4, len(first)), 1)
    assert tracemalloc.get_traced_memory()[1] < 200e6
    tracemalloc.stop()
