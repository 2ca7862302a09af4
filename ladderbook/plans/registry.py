"""Registered queries of the order-book jobs, with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import audits, levels
from ..operators.frames import audit_rows, quarantined
from ..operators.rebuild import Rebuilt, identified, numbered, parse_market, parse_snapshots, rebuild, rebuild_files
from ..sources import adapters as A
from ..sources import captures
from ..sources.storage import shared_dir, written
from . import oracles as O

QUERIES: dict = {}
ORACLES: dict = {}
E6 = 1_000_000


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _folder(spark, what: str) -> str:
    import uuid

    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


# ------------------------------------------------------------------ sources and sinks


@query(O.over_feed("select symbol, kind as stream_kind, ep as conn_epoch, event_id + 1 as conn_seq, tsec as recv_tsec, cast(tnsec as integer) as recv_tnsec from feed"))
def market_scan(spark, sf_dir):
    """A capture written as CSV and read again."""
    path = _folder(spark, "market")
    captures.write_market(A.market(spark, sf_dir).drop("capture_id"), path)
    return captures.read_market(spark, path).filter("not bad").select("symbol", "stream_kind", "conn_epoch", "conn_seq", "recv_tsec", "recv_tnsec")


@query(O.over_feed(f"select symbol, first_id - 1 as last_id, 20 as n_bids, (p - 1) * {E6} as best_bid from feed where {A.triggers_sql('spot')}"))
def snapshot_scan(spark, sf_dir):
    """A sidecar written as CSV, read again and parsed."""
    path = _folder(spark, "capture_snapshots")
    captures.write_snapshots(A.snapshots(spark, sf_dir), path)
    rows = parse_snapshots(captures.read_snapshots(spark, path)).filter("valid")
    return rows.select("symbol", F.col("message.last_id").alias("last_id"), F.size("message.bids").alias("n_bids"), F.col("message.bids")[0]["price"].alias("best_bid"))


@query(O.over_feed("select distinct symbol, cast(substr(symbol, 4, 1) as integer) as pos from feed where sx < 6"))
def symbol_list(spark, sf_dir):
    lists = A.feed(spark, sf_dir).selectExpr("'sym0usdt,,SYM1USDT,sym1usdt,sym2usdt,SYM3USDT,sym4usdt,' || lower(symbol) || ',sym5usdt' as text").distinct()
    return captures.symbol_list(lists).select(F.col("pos").cast("int").alias("pos"), "symbol")


def _capture_files(spark, sf_dir) -> str:
    """The messages of each symbol as a capture file, in order of events; every two rows of it share a connection number."""
    path = _folder(spark, "captures")
    number = F.floor(F.row_number().over(Window.partitionBy("symbol", "conn_epoch").orderBy("conn_seq")) / 2)
    rows = A.market(spark, sf_dir).withColumns({"capture_id": F.concat(F.lit("run_"), "symbol"), "_event": F.col("conn_seq"), "conn_seq": number})
    captures.write_captures(rows, path, ["_event"])
    return path


@query(O.over_feed('select symbol, tsec as recv_tsec, kind as stream_kind, row_number() over (partition by symbol order by event_id) as rn from feed'))
def line_numbers(spark, sf_dir):
    """Rows of capture files with their numbers in the file."""
    rows = captures.numbered_places(captures.read_market(spark, f"{_capture_files(spark, sf_dir)}/*.csv", place=True))
    return rows.select("symbol", "recv_tsec", "stream_kind", F.col("rn").cast("bigint").alias("rn"))


@query(O.book("checkpoint"))
def repeated_numbers(spark, sf_dir):
    """Books of capture files in which every two rows of a connection have one number: the files' order decides."""
    return _book(rebuild_files(spark, f"{_capture_files(spark, sf_dir)}/*.csv"))


_EVENT_MS = "(us // 1000 + 1704067200000)"


@query(O.over_feed(f"select case when kind = 'depth5' then tsec else {_EVENT_MS} // 1000 end as tsec, cast(case when kind = 'depth5' then tnsec else {_EVENT_MS} % 1000 * 1000000 end as integer) as tnsec, kind as stream_kind, ep as conn_epoch, event_id + 1 as conn_seq, symbol from feed"))
def capture_batch(spark, sf_dir):
    """Frames to audit rows under the event-time policy."""
    return audit_rows(A.frames(spark, sf_dir), "event").select(F.col("recv_tsec").alias("tsec"), F.col("recv_tnsec").alias("tnsec"), "stream_kind", "conn_epoch", "conn_seq", "symbol")


@query(O.over_feed("select symbol, kind as stream_kind, count(*) as n from feed group by all"))
def stream_capture(spark, sf_dir):
    """The same frames through a streaming query, into files."""
    from ..streaming.capture import capture_stream

    return capture_stream(spark, A.frames(spark, sf_dir)).groupBy("symbol", "stream_kind").agg(F.count("*").alias("n"))


# ------------------------------------------------------------------ fields


@query(O.over_feed("select event_id + 1 as conn_seq, case when event_id % 101 <> 0 then lower(symbol) || case kind when 'trade' then '@trade' when 'depth5' then '@depth5@100ms' else '@depth@100ms' end end as stream, case when event_id % 101 <> 0 then symbol end as symbol from feed"))
def split_envelope(spark, sf_dir):
    stream, _ = C.split_envelope(F.col("frame"))
    return A.frames(spark, sf_dir, "malformed").select("conn_seq", stream.alias("stream")).withColumn("symbol", C.symbol_of(F.col("stream")))


@query(O.over_feed("select event_id + 1 as conn_seq, kind, case kind when 'depth_diff' then 'D' when 'depth5' then 'S' else 'T' end as letter from feed"))
def classify_stream(spark, sf_dir):
    stream, _ = C.split_envelope(F.col("frame"))
    return A.frames(spark, sf_dir).select("conn_seq", C.classify_stream(stream).alias("kind")).withColumn("letter", C.type_letter(F.col("kind")))


@query(O.over_feed("select event_id + 1 as conn_seq, kind from feed"))
def classify_payload(spark, sf_dir):
    return A.market(spark, sf_dir).select("conn_seq", C.classify_payload(F.col("payload_json")).alias("kind"))


_BAD = "(event_id % 101 = 0 or event_id % 103 = 0)"


@query(O.over_feed(f"""select event_id + 1 as conn_seq, not {_BAD} as valid, case when not {_BAD} then case when kind = 'depth5' then 0 else first_id end end as first_id,
  case when not {_BAD} then case when kind = 'depth5' then 0 else final_id end end as final_id, case when not {_BAD} then case when kind = 'depth5' then dn * 10 else 0 end end as last_id,
  case when not {_BAD} then case when kind = 'depth5' then p - 1 else b1 end * {E6} end as bid, case when not {_BAD} then case when kind = 'depth5' then (k + 1) * 100 else q end * {E6} end as bid_size from feed where kind <> 'trade'"""))
def parse_depth(spark, sf_dir):
    rows = parse_market(A.market(spark, sf_dir, variant="malformed").filter("stream_kind <> 'trade'"))
    m = lambda c: F.when(F.col("valid"), F.col(f"message.{c}"))
    return rows.select("conn_seq", "valid", *[m(c).alias(c) for c in ("first_id", "final_id", "last_id")], F.when(F.col("valid"), F.col("message.bids")[0]["price"]).alias("bid"), F.when(F.col("valid"), F.col("message.bids")[0]["qty"]).alias("bid_size"))


@query(O.over_feed(f"select event_id, case when event_id % 7 = 0 then null else cents * {E6} end as scaled from feed"))
def scale_decimal(spark, sf_dir):
    text = "concat(case when event_id % 7 = 0 then '+' else '000' end, cents div 100, '.', lpad(cast(cents % 100 as string), 2, '0'), '0000000000')"
    return A.feed(spark, sf_dir).selectExpr("event_id", f"{text} as text").select("event_id", C.scale_decimal(F.col("text")).alias("scaled"))


@query(O.over_feed(f"select event_id + 1 as conn_seq, case when kind = 'depth5' then 0 else {_EVENT_MS} end as event_ms, case when kind = 'depth5' then 0 else {_EVENT_MS} // 1000 end as sec, cast(case when kind = 'depth5' then 0 else {_EVENT_MS} % 1000 * 1000000 end as integer) as nsec from feed"))
def event_time(spark, sf_dir):
    rows = parse_market(A.market(spark, sf_dir))
    rows = rows.select("conn_seq", F.coalesce("message.event_ms", C.trade_event_ms(F.col("payload_json"))).alias("event_ms"))
    sec, nsec = C.ms_to_time(F.col("event_ms"))
    return rows.select("conn_seq", "event_ms", sec.alias("sec"), nsec.alias("nsec"))


@query(O.over_feed(f"select event_id + 1 as conn_seq, case when kind = 'depth5' then tsec else {_EVENT_MS} // 1000 end as tsec, tsec as received from feed"))
def time_policy(spark, sf_dir):
    rows = parse_market(A.market(spark, sf_dir))
    event = F.coalesce("message.event_ms", C.trade_event_ms(F.col("payload_json")))
    recv = C.time_policy("recv", event, F.col("recv_tsec"), F.col("recv_tnsec"))[0]
    return rows.select("conn_seq", C.time_policy("event", event, F.col("recv_tsec"), F.col("recv_tnsec"))[0].alias("tsec"), recv.alias("received"))


@query(O.over_feed(f"select distinct symbol, {O._ID} as id from feed"))
def instrument_id(spark, sf_dir):
    return A.feed(spark, sf_dir).select("symbol").distinct().select("symbol", C.instrument_id(F.col("symbol")).alias("id"))


@query("""select event_id, '"' || replace(props, '"', '""') || '"' as escaped, event_type as plain from events""")
def csv_escape(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select("event_id", C.csv_escape(F.col("props")).alias("escaped"), C.csv_escape(F.col("event_type")).alias("plain"))


# ------------------------------------------------------------------ filters


@query(O.over_feed("select symbol, count(*) as n from feed where symbol in ('SYM1USDT', 'SYM3USDT') group by symbol"))
def symbol_semi(spark, sf_dir):
    """Rows of listed symbols."""
    listed = captures.symbol_list(spark.createDataFrame([("sym1usdt,SYM3USDT,sym9usdt",)], "text string"))
    rows = A.market(spark, sf_dir).join(F.broadcast(listed), "symbol", "left_semi")  # a list that a user types
    return rows.groupBy("symbol").agg(F.count("*").alias("n"))


@query(O.over_feed("select symbol, event_id + 1 as seq from feed where kind = 'depth_diff' and final_id <= pm"))
def stale_diffs(spark, sf_dir):
    found = audits.continuity(parse_market(A.market(spark, sf_dir))).filter("outcome = 'stale'")
    return found.select("symbol", F.col("conn_seq").alias("seq"))


@query(O.over_feed("select event_id + 1 as conn_seq, case when q = 0 then 0 else 4 end as live from feed where kind = 'depth_diff'"))
def live_levels(spark, sf_dir):
    """Levels of a diff that stand, not end."""
    rows = parse_market(A.market(spark, sf_dir)).filter("stream_kind = 'depth_diff'")
    alive = lambda side: F.size(F.filter(f"message.{side}", lambda x: x["qty"] != 0))
    return rows.select("conn_seq", (alive("bids") + alive("asks")).alias("live"))


@query(O.over_feed("select event_id + 1 as conn_seq, case when event_id % 101 = 0 then 'envelope' else 'payload' end as reason from feed where event_id % 101 = 0 or event_id % 103 = 0 and kind <> 'trade'"))
def parse_errors(spark, sf_dir):
    return quarantined(A.frames(spark, sf_dir, "malformed")).select("conn_seq", "reason")


# ------------------------------------------------------------------ rebuilds


def checkpoint(spark, sf_dir, **options) -> Rebuilt:
    return rebuild(parse_market(A.market(spark, sf_dir)), **options)


def with_sidecar(spark, sf_dir, venue: str, **options) -> Rebuilt:
    return rebuild(parse_market(A.market(spark, sf_dir, venue)), parse_snapshots(A.snapshots(spark, sf_dir, venue)), **options)


@query(O.book("spot"))
def frames_to_book(spark, sf_dir):
    """Raw frames to audit files, audit files and a sidecar to books."""
    top = _folder(spark, "replay")
    captures.write_market(audit_rows(A.frames(spark, sf_dir)), f"{top}/capture.csv")
    captures.write_snapshots(A.snapshots(spark, sf_dir), f"{top}/capture_snapshots.csv")
    return _book(rebuild_files(spark, f"{top}/capture.csv", f"{top}/capture_snapshots.csv"))


def _book(found: Rebuilt) -> DataFrame:
    return found.book.drop("capture_id", "venue")


@query(O.book("checkpoint"))
def rebuild_checkpoint(spark, sf_dir):
    """Books without a sidecar: each depth5 row is a checkpoint."""
    return _book(checkpoint(spark, sf_dir))


@query(O.book("checkpoint"))
def rebuild_typed(spark, sf_dir):
    """Books of a capture that was stored with its messages as typed columns."""
    path = _folder(spark, "typed")
    captures.write_parsed(parse_market(A.market(spark, sf_dir)), path)
    return _book(rebuild(captures.read_parsed(spark, path)))


@query(O.book("spot"))
def rebuild_sidecar(spark, sf_dir):
    return _book(with_sidecar(spark, sf_dir, "spot"))


@query(O.book("usdm"))
def rebuild_sidecar_usdm(spark, sf_dir):
    return _book(with_sidecar(spark, sf_dir, "usdm", chunk=16))


@query(f"select * from ({O.book('checkpoint', trades=True)}) where type = 'T'")
def trade_rows(spark, sf_dir):
    """The book at each trade."""
    return _book(checkpoint(spark, sf_dir, trades=True)).filter("type = 'T'")


@query(O.checks())
def depth5_mismatch(spark, sf_dir):
    """Depth5 rows beside the best bid of the book before them."""
    return checkpoint(spark, sf_dir).checks.select("symbol", "seq", "book_bid", "depth5_bid")


@query(O.over_feed("select symbol, event_id + 1 as conn_seq, " + ", ".join(O.STATE) + f" from (select *, {O._PARTIAL} from feed where kind = 'depth5')"))
def depth5_rows(spark, sf_dir):
    rows = parse_market(A.market(spark, sf_dir)).filter("stream_kind = 'depth5' and valid")
    return rows.select("symbol", "conn_seq", *C.first_levels(F.col("message.bids"), ("bid", "bid_size")), *C.first_levels(F.col("message.asks"), ("ask", "ask_size")))


@query(O.over_feed(f"select symbol, event_id + 1 as conn_seq, (p + 2) * {E6} as bid0, (p + 1) * {E6} as ask0 from feed where kind = 'depth5' and event_id % 3 = 0"))
def crossed_rows(spark, sf_dir):
    """Crossed books, in depth5 rows of which every third has a bid set over the asks."""
    rows = depth5_rows(spark, sf_dir).withColumn("bid0", F.when(F.expr("(conn_seq - 1) % 3 = 0"), F.col("ask0") + E6).otherwise(F.col("bid0")))
    return audits.crossed(rows).select("symbol", "conn_seq", "bid0", "ask0")


@query(O.over_feed("select 'left' as only_in, 0 as n from feed where false"))
def replay_diff(spark, sf_dir):
    """A book written and read again against a second rebuild in other chunks: no difference."""
    path = _folder(spark, "book")
    captures.write_book(checkpoint(spark, sf_dir).book, path)
    saved = captures.read_book(spark, path)
    again = checkpoint(spark, sf_dir, chunk=7).book
    return audits.difference(saved, again).groupBy("only_in").agg(F.count("*").cast("int").alias("n"))


@query(f"""with book as ({O.book('checkpoint')}) select 'left' as only_in, cast(count(*) as integer) as n from book where "seqNo" % 50 = 0 having count(*) > 0
  union all select 'right', cast(count(*) as integer) from book where "seqNo" % 50 = 0 or "seqNo" % 70 = 0 having count(*) > 0""")
def replay_diff_planted(spark, sf_dir):
    """A saved book of which every 70th row of a symbol is gone, and every 50th has another size, against a second rebuild."""
    book = checkpoint(spark, sf_dir).book
    saved = book.filter("seqNo % 70 <> 0 or seqNo % 50 = 0").withColumn("bid_size0", F.when(F.expr("seqNo % 50 = 0"), F.col("bid_size0") + 1).otherwise(F.col("bid_size0")))
    path = _folder(spark, "book")
    captures.write_book(saved, path)
    again = checkpoint(spark, sf_dir, chunk=100).book
    return audits.difference(captures.read_book(spark, path), again, 1000).groupBy("only_in").agg(F.count("*").cast("int").alias("n"))


@query(f"""with book as ({O.book('checkpoint')}) select symbol, "seqNo", 'left' as only_in from book where "seqNo" % 90 = 0 union all select symbol, "seqNo", 'right' from book where "seqNo" % 90 = 0""")
def replay_diff_csv(spark, sf_dir):
    """A book saved as CSV of which every 90th row has another ask, against a second rebuild: the rows, by symbol and number."""
    saved = checkpoint(spark, sf_dir).book.withColumn("ask0", F.when(F.expr("seqNo % 90 = 0"), F.col("ask0") + 1).otherwise(F.col("ask0")))
    path = _folder(spark, "book")
    captures.write_book(saved, path, "csv")
    return audits.difference(captures.read_book(spark, path, "csv"), checkpoint(spark, sf_dir, chunk=64).book, 500).select("symbol", "seqNo", "only_in")


def _checkpoint_writes(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    from ..operators.sequencing import actions

    parsed = identified(parse_market(A.market(spark, sf_dir)))
    done = written(actions(parsed).filter("action in ('apply', 'seed')"), "actions")
    key = ["capture_id", "venue", "symbol"]
    rows = parsed.select(F.col("rid").alias("seq"), "message")
    return levels.last_writes(levels.exploded(done.join(rows, "seq"))), done.select(*key, "segment", "ordinal")


@query(O.writes())
def book_state(spark, sf_dir):
    """Live levels at the end of each segment."""
    return levels.state_at_end(_checkpoint_writes(spark, sf_dir)[0]).select("symbol", "segment", "side", "price", "qty")


@query(O.spans())
def level_lifetimes(spark, sf_dir):
    return levels.lifetimes(_checkpoint_writes(spark, sf_dir)[0]).select("symbol", "segment", "side", "price", "ordinal", "qty", "until")


@query(O.final_top5())
def top5_final(spark, sf_dir):
    """The best five levels a side at the end of each segment."""
    live = levels.state_at_end(_checkpoint_writes(spark, sf_dir)[0])
    return levels.best_levels(live, ["symbol", "segment"])


# ------------------------------------------------------------------ audits


@query(O.continuity("spot"))
def gaps_spot(spark, sf_dir):
    return audits.continuity(parse_market(A.market(spark, sf_dir))).select("symbol", F.col("conn_seq").alias("seq"), "outcome")


@query(O.continuity("usdm"))
def gaps_usdm(spark, sf_dir):
    return audits.continuity(parse_market(A.market(spark, sf_dir, "usdm"))).select("symbol", F.col("conn_seq").alias("seq"), "outcome")


@query(O.over_feed("select symbol, event_id + 1 as conn_seq, coalesce(ep <> before, false) as changed, cast(sum(case when ep <> before then 1 else 0 end) over (partition by symbol order by event_id) as bigint) as epoch_seg from (select *, lag(ep) over (partition by symbol order by event_id) as before from feed)"))
def epoch_segments(spark, sf_dir):
    return audits.epoch_segments(A.market(spark, sf_dir)).select("symbol", "conn_seq", "changed", "epoch_seg")


@query(O.over_feed("select symbol, event_id + 1 as conn_seq, row_number() over (partition by symbol order by event_id) as \"seqNo\" from feed"))
def book_seqno(spark, sf_dir):
    return numbered(A.market(spark, sf_dir), ["conn_seq"], 1000).select("symbol", "conn_seq", F.col("seqNo").cast("bigint").alias("seqNo"))


@query(O.over_feed("select ep as conn_epoch, count(*) as frames, min(event_id) + 1 as first_seq, max(event_id) + 1 as last_seq, max(event_id) - min(event_id) + 1 - count(*) as holes from feed group by ep"))
def conn_numbering(spark, sf_dir):
    return audits.conn_numbering(A.frames(spark, sf_dir)).drop("shard_id")


@query(O.over_feed("select 0 as shard_id, ep as conn_epoch, count(*) as messages, count(distinct symbol) as symbols, count(distinct symbol) * 3 as streams, count(distinct symbol) * 3 > 17 as over from feed group by ep"))
def shard_load(spark, sf_dir):
    return audits.shard_load(A.market(spark, sf_dir), 17).drop("capture_id")


@query(O.metrics())
def metrics(spark, sf_dir):
    parsed = identified(parse_market(A.market(spark, sf_dir)))
    found = rebuild(parsed)
    return audits.metrics(parsed, found.actions, found.book, found.checks, by=("symbol",))


@query(O.metrics_by_capture())
def metrics_by_capture(spark, sf_dir):
    """Counters by capture and symbol, by capture and over all."""
    parsed = identified(parse_market(A.market(spark, sf_dir)))
    found = rebuild(parsed)
    return audits.metrics(parsed, found.actions, found.book, found.checks)


@query(O.summary())
def sample_summary(spark, sf_dir):
    """Rows by table, snapshots and crossed rows of a capture with a sidecar."""
    market, snapshots = A.market(spark, sf_dir), A.snapshots(spark, sf_dir)
    return audits.summary(market, snapshots, with_sidecar(spark, sf_dir, "spot").book)


@query(O.over_feed("select event_id + 1 as conn_seq, ep as conn_epoch, row_number() over (partition by ep order by event_id) as number, dense_rank() over (order by ep) - 1 as reconnects from feed"))
def conn_running(spark, sf_dir):
    """Each frame's number in its connection and how often its shard had reconnected before."""
    rows = audits.conn_running(A.frames(spark, sf_dir).select("shard_id", "conn_epoch", "conn_seq"))
    return rows.select("conn_seq", "conn_epoch", "number", "reconnects")


# ------------------------------------------------------------------ streams


@query(O.book("spot"))
def stream_book(spark, sf_dir):
    """Books of the first half of the messages by a batch job, handed over to a stream that gets the other half."""
    from ..streaming.books import hand_over, messages, run_books

    parsed = identified(parse_market(A.market(spark, sf_dir)))
    half = parsed.count() // 2
    found = rebuild(parsed.filter(F.col("conn_seq") <= half), parse_snapshots(A.snapshots(spark, sf_dir)))
    later, _ = run_books(spark, messages(parsed.filter(F.col("conn_seq") > half)), True, hand_over(found))
    return found.book.unionByName(later).drop("capture_id", "venue")


_HEALTH = ", ".join("msgs_total depth_diff depth5 trade parse_errors gaps reconnects resyncs buffer_overflows depth5_mismatch ob_rows".split())


@query(f"select symbol, {_HEALTH} from ({O.metrics()}) where symbol is not null")
def stream_health(spark, sf_dir):
    """The counters of live books, out of the state store."""
    from ..streaming.books import messages, run_books

    _, health = run_books(spark, messages(parse_market(A.market(spark, sf_dir))), False)
    return health.drop("capture_id", "venue")


@query(ORACLES["parse_errors"])
def stream_quarantine(spark, sf_dir):
    """What a capture stream puts aside."""
    from ..streaming.capture import outputs_stream

    out = outputs_stream(spark, A.frames(spark, sf_dir, "malformed"))
    return spark.read.parquet(f"{out}/quarantine").select("conn_seq", "reason")


@query(O.over_feed("select symbol, kind as stream_kind, count(*) as md_rows, count(*) filter (where event_id % 103 = 0 and kind <> 'trade' and symbol in ('SYM1USDT', 'SYM3USDT')) as parse_errors from feed where event_id % 101 <> 0 group by all"))
def stream_counters(spark, sf_dir):
    """Counters of a capture stream that parses two symbols."""
    from ..streaming.capture import outputs_stream

    listed = captures.symbol_list(spark.createDataFrame([("sym1usdt,SYM3USDT",)], "text string"))
    out = outputs_stream(spark, A.frames(spark, sf_dir, "malformed"), venue="spot", capture_id="live", symbols=listed)
    counted = spark.read.parquet(f"{out}/counters").filter("symbol is not null")
    return counted.groupBy("symbol", "stream_kind").agg(F.sum("md_rows").alias("md_rows"), F.sum("parse_errors").alias("parse_errors"))


FLAGSHIP = rebuild_checkpoint
