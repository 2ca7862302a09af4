"""The events table as captured market data: one SQL text for Spark and for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_SPARK = {"us": "timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01', cast(ts as timestamp_ntz))", "k": "get_json_object(props, '$.k')", "div": "div"}
_DUCK = {"us": "(epoch_us(ts) - epoch_us(timestamp '2024-01-01'))", "k": "json_extract_string(props, '$.k')", "div": "//"}

#: columns of one message: ids, prices in cents, quantities in hundredths
_FEED = """
e0 as (select event_id, {us} as us, user_id % 6 as sx, cast(round(value * 100) as bigint) as cents, cast({k} as bigint) as k, event_type from events),
e1 as (select *, 'SYM' || sx || 'USDT' as symbol, us {div} 864000000000 as ep, 10000 + 1000 * sx as p,
       case when event_type = 'purchase' then 'trade' when event_type = 'error' and event_id % 8 = 0 then 'depth5' else 'depth_diff' end as kind from e0),
e2 as (select *, cast(sum(case when kind = 'depth_diff' then 1 else 0 end) over (partition by symbol order by event_id) as bigint) as dn from e1),
e3 as (select *, dn * 10 - case when event_id % 53 = 0 then 30 else 0 end as final_id,
       dn * 10 - 9 + case when event_id % 97 = 0 then 5 else 0 end - case when event_id % 53 = 0 then 30 else 0 end as first_id,
       case when k % 4 = 0 then 0 else k * 100 + cents % 100 end as q from e2),
e4 as (select *, max(case when kind = 'depth_diff' then final_id end) over (partition by symbol, ep order by event_id rows between unbounded preceding and 1 preceding) as pm from e3),
feed as (select *, coalesce(pm, 0) + case when event_id % 97 = 0 then 5 else 0 end as pu,
       p - 1 - cents % 40 as b1, p - 1 - (cents {div} 40) % 40 as b2, p + 1 + cents % 40 as a1, p + 1 + (cents {div} 7) % 40 as a2,
       1704067200 + us {div} 1000000 as tsec, (us % 1000000) * 1000 as tnsec from e4)
"""


def feed_sql(duck: bool) -> str:
    return _FEED.format(**(_DUCK if duck else _SPARK))


def _money(x: str) -> str:
    return f"(({x}) div 100) || '.' || lpad(cast(({x}) % 100 as string), 2, '0')"


def _level(price: str, qty: str) -> str:
    return "'[\"' || " + _money(price) + " || '\",\"' || " + _money(qty) + " || '\"]'"


def _list(levels: list[str]) -> str:
    return "'[' || " + " || ',' || ".join(levels) + " || ']'"


def _depth5(sign: int, n: int = 5) -> str:
    step = [f"p {'+' if sign > 0 else '-'} {1 + 2 * i}" for i in range(n)]
    return _list([_level(x, f"(k + {i + 1}) * 100") for i, x in enumerate(step)])


_PAYLOAD = f"""case kind
  when 'trade' then '{{"e":"trade","E":' || (us div 1000 + 1704067200000) || '}}'
  when 'depth5' then '{{"lastUpdateId":' || dn * 10 || ',"bids":' || {_depth5(-1)} || ',"asks":' || {_depth5(1)} || '}}'
  else '{{"e":"depthUpdate","E":' || (us div 1000 + 1704067200000) || ',"U":' || first_id || ',"u":' || final_id || usdm || ',"b":' || {_list([_level("b1", "q"), _level("b2", "q")])} || ',"a":' || {_list([_level("a1", "q"), _level("a2", "q")])} || '}}' end"""


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messages as numbers (event_id, symbol, kind, ids, prices, quantities)."""
    spark.read.parquet(f"{sf_dir}/events.parquet").createOrReplaceTempView("events")
    return spark.sql(f"with {feed_sql(False)} select * from feed")


def market(spark: SparkSession, sf_dir: str, venue: str = "spot", variant: str = "") -> DataFrame:
    """The messages as a market table. variant `malformed` cuts some payloads short and breaks some prices."""
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = feed(spark, sf_dir).repartition(parts, "event_id")  # few symbols leave the windows in few partitions
    rows = rows.selectExpr("*", ("',\"pu\":' || pu" if venue == "usdm" else "''") + " as usdm")
    payload = f"({_PAYLOAD})"
    if variant == "malformed":
        payload = f"case when event_id % 101 = 0 then substr({payload}, 1, 20) when event_id % 103 = 0 then replace({payload}, '[[\"', '[[\"abc') else {payload} end"
    return rows.selectExpr("'c0' as capture_id", "tsec as recv_tsec", "cast(tnsec as int) as recv_tnsec", f"'{venue}' as venue", "kind as stream_kind", "0 as shard_id", "ep as conn_epoch", "event_id + 1 as conn_seq", "symbol", f"{payload} as payload_json")


def frames(spark: SparkSession, sf_dir: str, variant: str = "") -> DataFrame:
    """The messages as raw frames with their place in the connection."""
    name = "lower(symbol) || case stream_kind when 'trade' then '@trade' when 'depth5' then '@depth5@100ms' else '@depth@100ms' end"
    frame = f"""'{{"stream":"' || {name} || '","data":' || payload_json || '}}'"""
    return market(spark, sf_dir, variant=variant).selectExpr(f"{frame} as frame", "shard_id", "conn_epoch", "conn_seq", "recv_tsec", "recv_tnsec")


def triggers_sql(venue: str) -> str:
    """Condition of a diff that starts a segment when every trigger has a snapshot of its own."""
    return "kind = 'depth_diff' and (pm is null or final_id > pm and " + ("first_id > pm + 1" if venue == "spot" else "pu <> pm") + ")"


def snapshots(spark: SparkSession, sf_dir: str, venue: str = "spot") -> DataFrame:
    """A sidecar with one snapshot a trigger, in the order in which they are asked for."""
    side = lambda sign: _list([_level(f"p {sign} {1 + i}", f"{(i + 1) * 100}") for i in range(20)])
    last = "first_id - 1" if venue == "spot" else "first_id"
    payload = f"""'{{"lastUpdateId":' || ({last}) || ',"bids":' || {side("-")} || ',"asks":' || {side("+")} || '}}'"""
    rows = feed(spark, sf_dir).filter(triggers_sql(venue))
    return rows.selectExpr("'c0' as capture_id", f"'{venue}' as venue", "symbol", "tsec as recv_tsec", "cast(tnsec as int) as recv_tnsec", f"{last} as lastUpdateId", f"{payload} as payload_json", "event_id as snap_ord")
