"""Raw frames as audit rows, and what of them is broken."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C


def _split(frames: DataFrame, symbols: DataFrame | None) -> DataFrame:
    """frames with stream, payload_json, symbol, stream_kind and listed (whether the symbol is in symbols; all are without a list)."""
    frames = frames.select("frame", "shard_id", "conn_epoch", "conn_seq", "recv_tsec", "recv_tnsec")  # others might have the names below
    stream, data = C.split_envelope(F.col("frame"))
    rows = C.settled(frames, "parts", F.struct(stream.alias("stream"), data.alias("payload_json"))).select("*", "parts.*").drop("parts")
    rows = rows.withColumns({"symbol": C.symbol_of(F.col("stream")), "stream_kind": C.classify_stream(F.col("stream"))})
    if symbols is None:
        return rows.withColumn("listed", F.lit(True))
    listed = symbols.select("symbol").distinct().withColumn("listed", F.lit(True))
    return rows.join(F.broadcast(listed), "symbol", "left").fillna({"listed": False})  # a list that a user types


def _parsed() -> Column:
    """Which frames' depth is parsed: that of listed symbols."""
    return F.col("listed") & (F.col("stream_kind") != "trade")


def audit_rows(frames: DataFrame, policy: str = "recv", venue: str = "spot", capture_id: str | None = None, symbols: DataFrame | None = None) -> DataFrame:
    """Raw frames as rows of the market table (with capture_id, if given); frames that are no envelope go to quarantined().

    Every symbol is audited. Under the `event` policy a listed symbol's depth row is stamped with its
    event time if it can be parsed; trades and all rows of unlisted symbols with the event time that
    stands in the payload. Without one the receive time stays.
    """
    rows = C.with_message(_split(frames, symbols).filter("stream is not null"), "payload_json", _parsed())
    event = F.when(_parsed(), F.when(F.col("message.valid"), F.col("message.event_ms")).otherwise(0)).otherwise(C.trade_event_ms(F.col("payload_json")))
    sec, nsec = C.time_policy(policy, event, F.col("recv_tsec"), F.col("recv_tnsec"))
    found = rows.select(sec.alias("recv_tsec"), nsec.alias("recv_tnsec"), F.lit(venue).alias("venue"), "stream_kind", "shard_id", "conn_epoch", "conn_seq", "symbol", "payload_json")
    return found if capture_id is None else found.withColumn("capture_id", F.lit(capture_id))


def quarantined(frames: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    """Frames that are no envelope, and broken depth messages of listed symbols, with the reason."""
    depth = F.col("stream").isNotNull() & _parsed()
    rows = C.with_message(_split(frames, symbols), "payload_json", depth)
    reason = F.when(F.col("stream").isNull(), "envelope").when(~F.col("message.valid"), "payload")
    return rows.withColumn("reason", reason).filter("reason is not null").drop("message", "listed")


def judged(frames: DataFrame, policy: str = "recv", venue: str = "spot", capture_id: str | None = None, symbols: DataFrame | None = None) -> DataFrame:
    """Every frame once: what audit_rows() gives of it (null where it is no envelope), the frame, listed, and reason (what quarantined() says, or null)."""
    rows = C.with_message(_split(frames, symbols), "payload_json", F.col("stream").isNotNull() & _parsed())
    event = F.when(_parsed(), F.when(F.col("message.valid"), F.col("message.event_ms")).otherwise(0)).otherwise(C.trade_event_ms(F.col("payload_json")))
    sec, nsec = C.time_policy(policy, event, F.col("recv_tsec"), F.col("recv_tnsec"))
    reason = F.when(F.col("stream").isNull(), "envelope").when(~F.col("message.valid"), "payload")
    names = ["stream_kind", "shard_id", "conn_epoch", "conn_seq", "symbol", "payload_json", "frame", "listed"]
    found = rows.select(sec.alias("recv_tsec"), nsec.alias("recv_tnsec"), F.lit(venue).alias("venue"), *names, reason.alias("reason"))
    return found if capture_id is None else found.withColumn("capture_id", F.lit(capture_id))
