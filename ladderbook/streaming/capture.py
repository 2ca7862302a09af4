"""Live capture: frames as they land, to audit rows in files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.frames import audit_rows, judged
from ..sources.captures import MARKET
from ..sources.storage import shared_dir

FRAMES = "frame string, shard_id int, conn_epoch bigint, conn_seq bigint, recv_tsec bigint, recv_tnsec int"


def start_capture(spark: SparkSession, landed: str, out: str, state: str, policy: str = "recv", venue: str = "spot", capture_id: str | None = None, symbols: DataFrame | None = None):
    """A streaming query from Parquet files of frames under `landed` to audit rows under `out`; takes what is there, then ends."""
    frames = spark.readStream.schema(FRAMES).parquet(landed)
    return audit_rows(frames, policy, venue, capture_id, symbols).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()


def capture_stream(spark: SparkSession, frames: DataFrame, policy: str = "recv") -> DataFrame:
    """The frames landed as files, captured by the streaming query, and read again."""
    top = f"{shared_dir(spark)}/capture-{uuid.uuid4().hex}"
    frames.write.parquet(f"{top}/landed")
    start_capture(spark, f"{top}/landed", f"{top}/market", f"{top}/state", policy).awaitTermination()
    return spark.read.parquet(f"{top}/market")


def write_outputs(frames: DataFrame, batch: int, out: str, policy: str = "recv", venue: str = "spot", capture_id: str | None = None, symbols: DataFrame | None = None) -> None:
    """A batch of frames to three tables under `out`, parsed once: market (audit rows), quarantine (frame and reason) and
    counters (by symbol and kind). A batch's rows have a folder of their own, so that a batch that comes again
    takes the place of itself."""
    rows = judged(frames, policy, venue, capture_id, symbols).persist()
    try:
        names = [*(f.strip().split(" ")[0] for f in MARKET.split(",")), *(["capture_id"] if capture_id is not None else [])]
        counts = rows.groupBy("symbol", "stream_kind").agg(F.count("*").alias("frames"), F.count_if(F.col("symbol").isNotNull()).alias("md_rows"), F.count_if(F.col("listed") & F.col("reason").isNull()).alias("taken"), F.count("reason").alias("parse_errors"))
        quarantine = rows.filter("reason is not null").select("frame", "shard_id", "conn_epoch", "conn_seq", "symbol", "stream_kind", "reason")
        for name, table in (("market", rows.filter("symbol is not null").select(*names)), ("quarantine", quarantine), ("counters", counts)):
            table.write.mode("overwrite").parquet(f"{out}/{name}/batch={batch}")
    finally:
        rows.unpersist()


def start_outputs(spark: SparkSession, landed: str, out: str, state: str, **options):
    """A streaming query from Parquet files of frames to write_outputs()'s three tables (options are its); takes what is there, then ends."""
    frames = spark.readStream.schema(FRAMES).parquet(landed)
    return frames.writeStream.foreachBatch(lambda rows, batch: write_outputs(rows, batch, out, **options)).option("checkpointLocation", state).trigger(availableNow=True).start()


def outputs_stream(spark: SparkSession, frames: DataFrame, **options) -> str:
    """The frames landed as files and captured; the folder of the three tables."""
    top = f"{shared_dir(spark)}/outputs-{uuid.uuid4().hex}"
    frames.write.parquet(f"{top}/landed")
    start_outputs(spark, f"{top}/landed", f"{top}/out", f"{top}/state", **options).awaitTermination()
    return f"{top}/out"
