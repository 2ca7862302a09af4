"""Rebuilding books from a capture: parse, sequence, apply, emit."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..sources import captures
from ..sources.captures import BOOK
from ..sources.storage import written
from . import levels
from .numbering import numbered  # noqa: F401  (a part of this module's interface)
from .sequencing import sequenced
from .session import BUFFER

KEY = ["capture_id", "venue", "symbol"]


def parse_market(market: DataFrame, venue: str | None = None) -> DataFrame:
    """market with message (with_message) and valid; a trade is valid whatever it holds. venue overrides the rows'.

    Rows that the reader found too short (bad) are left out.
    """
    if "bad" in market.columns:
        market = market.filter("not bad").drop("bad")
    if venue:
        market = market.withColumn("venue", F.lit(venue))
    depth = F.col("stream_kind").isin("depth_diff", "depth5")
    parsed = C.with_message(market, "payload_json", depth)
    return parsed.withColumn("valid", F.coalesce(F.col("message.valid"), F.lit(True)))


def parse_snapshots(snapshots: DataFrame) -> DataFrame:
    """snapshots with message, valid and snap_ord, their order in the sidecar (kept if there is one)."""
    return C.with_message(snapshots, "payload_json").withColumn("valid", F.col("message.valid"))


def identified(parsed: DataFrame) -> DataFrame:
    """parse_market() rows, written once, with rid, a number of their own, and place, null where the reader gave none.

    A null capture, venue or symbol becomes the empty one; a null connection or number 0. Rows that have a rid stay as they are.
    """
    if "rid" in parsed.columns:
        return parsed
    clean = {**{c: F.coalesce(c, F.lit("")) for c in KEY}, **{c: F.coalesce(c, F.lit(0).cast("bigint")) for c in ("conn_epoch", "conn_seq")}}
    if "place" not in parsed.columns:
        clean["place"] = F.lit(None).cast("struct<block:bigint,at:bigint>")
    return written(parsed.withColumns({**clean, "rid": F.monotonically_increasing_id()}), "parsed")


@dataclass
class Rebuilt:
    """book: the 26 columns with capture_id, venue, symbol; actions, by rid of the row; checks: depth5 rows beside the book's best bid."""

    book: DataFrame
    actions: DataFrame
    checks: DataFrame
    #: what goes on needs: rows (identified()), snapshots or None, level writes, and the books' states at their ends
    rows: DataFrame
    snapshots: DataFrame | None
    writes: DataFrame
    ends: DataFrame


def rebuild(parsed: DataFrame, snapshots: DataFrame | None = None, trades: bool = False, chunk: int = levels.CHUNK, cap: int = BUFFER, seed_by_final_id: bool = False, sidecars: DataFrame | None = None, **sequencing) -> Rebuilt:
    """Books of all (capture, venue, symbol) of parse_market() rows; snapshots: parse_snapshots() rows or None.

    Without snapshots, and in captures that `sidecars` (capture_id, have_sidecar) says have none, each
    depth5 row seeds its book. Trade rows are emitted if asked for. Snapshots without a venue serve
    their symbol's books of any venue. A book's rows are handled in order of their place in the file, where
    the reader gave one; else of connection and number, and those that repeat a number in order of receive
    time, kind and content. All rows are handled, equal ones too.
    """
    parsed = identified(parsed)  # written, as five joins read the messages
    if snapshots is not None:
        if "venue" not in snapshots.columns:
            snapshots = snapshots.join(parsed.select(*KEY).distinct(), ["capture_id", "symbol"])
        snapshots = written(snapshots.withColumns({c: F.coalesce(c, F.lit("")) for c in KEY}), "snapshots")
    done, ends = sequenced(parsed, snapshots, trades, cap, seed_by_final_id, sidecars, **sequencing)
    done = written(done.withColumnsRenamed({"seq": "rid", "cause_seq": "cause_rid"}), "actions")
    at = ["rid"]  # a row's number joins it with what has happened to it
    rows = parsed.select(*at, "recv_tsec", "recv_tnsec", "message", F.col("conn_epoch").alias("epoch"), F.col("conn_seq").alias("seq"))
    applied = done.filter("action = 'apply'")
    seeds = done.filter("action = 'seed'")
    diffs = applied.select(*KEY, *at, "segment", "ordinal").join(rows.select(*at, "message"), at)
    cols = [*KEY, "segment", "ordinal", "message"]
    seeding = seeds.filter("source = 'depth5'").select(*KEY, *at, "segment", "ordinal").join(rows.select(*at, "message"), at).select(*cols)
    if snapshots is not None:
        kept = snapshots.select(*KEY, F.col("snap_ord").alias("seq"), "message")
        seeding = seeding.unionByName(seeds.filter("source = 'snapshot'").select(*KEY, F.col("rid").alias("seq"), "segment", "ordinal").join(kept, [*KEY, "seq"]).select(*cols))
    writes = written(levels.last_writes(levels.exploded(diffs.select(*cols).unionByName(seeding))), "writes")
    marks = applied.unionByName(seeds).select(*KEY, "segment", "ordinal")
    state = levels.states(writes, marks, chunk)
    state = written(state, "states")
    spot = [*KEY, "segment", "ordinal"]
    stamped = done.filter("action in ('apply', 'trade')").select(*KEY, *at, "segment", "ordinal", "number", F.when(F.col("action") == "apply", "D").otherwise("T").alias("type"))
    stamped = stamped.join(rows.select(*at, F.col("recv_tsec").alias("tsec"), F.col("recv_tnsec").alias("tnsec")), at).join(state, spot)
    partial = done.filter("action = 'partial'").select(*KEY, *at, "number").join(rows.select(*at, "recv_tsec", "recv_tnsec", "message"), at)
    partial = partial.select(*KEY, F.col("recv_tsec").alias("tsec"), F.col("recv_tnsec").alias("tnsec"), "number", F.lit("S").alias("type"), *C.first_levels(F.col("message.bids"), ("bid", "bid_size")), *C.first_levels(F.col("message.asks"), ("ask", "ask_size")))
    same = [*KEY, "tsec", "tnsec", "number", "type", *levels.STATE]
    book = stamped.select(*same).unionByName(partial.select(*same)).withColumnRenamed("number", "seqNo")
    book = book.withColumns({"side": F.lit("N"), "id": C.instrument_id(F.col("symbol"))}).select(*KEY, *BOOK)
    checks = done.filter("action = 'check'").select(*KEY, *at, "segment", "ordinal").join(rows.select(*at, "epoch", "seq", "message"), at).join(state, spot)
    checks = checks.filter(F.size("message.bids") > 0).select(*KEY, "epoch", "seq", F.col("bid0").alias("book_bid"), F.col("message.bids")[0]["price"].alias("depth5_bid"))
    return Rebuilt(book, done, checks, parsed, snapshots, writes, ends)


def rebuild_files(spark: SparkSession, market: str, snapshots: str | None = None, venue: str | None = None, **options) -> Rebuilt:
    """Books of the capture files at `market` (X.csv) with the sidecars at `snapshots` (X_snapshots.csv).

    Captures without a sidecar of their name are seeded by their depth5 rows; an empty sidecar is one.
    venue overrides the rows'; options are rebuild()'s.
    """
    parsed = parse_market(captures.read_market(spark, market, place=True), venue)
    if snapshots is None:
        return rebuild(parsed, **options)
    paired = captures.sidecars(parsed, captures.sidecar_files(spark, snapshots))
    return rebuild(parsed, parse_snapshots(captures.read_snapshots(spark, snapshots, venue)), sidecars=paired, **options)
