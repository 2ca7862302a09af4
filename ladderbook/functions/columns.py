"""Message fields as columns: envelopes, kinds, exact decimals, event times, ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE = 8  # decimal places of prices and quantities
_DECIMAL = rf"^-?(?=\.?[0-9])[0-9]*(\.[0-9]{{0,{SCALE}}}0*)?$"
_SHORT = rf"^-?[0-9]{{1,9}}(\.[0-9]{{1,{SCALE}}})?$"
_FRAME = r'^\s*\{\s*"stream"\s*:\s*"[^"]*"\s*,\s*"data"\s*:\s*(\{.*\})\s*\}\s*$'


def scale_decimal(text: Column) -> Column:
    """A decimal string as a BIGINT of 10^-8 units, exactly; null if it isn't one, is finer, or is out of range."""
    # leading zeros are no digits of the number, trailing zeros beyond the scale none of its value
    lean = F.regexp_replace(F.regexp_replace(text, "^(-?)0+(?=[0-9])", "$1"), rf"(\.[0-9]{{{SCALE}}})0+$", "$1")
    lean = F.regexp_replace(lean, r"\.$", "")
    any_form = F.try_multiply(lean.try_cast("decimal(38,8)"), F.lit(10**SCALE).cast("decimal(10,0)")).try_cast("bigint")
    # most numbers are short: their digits, filled up to the scale, are the result
    short = F.concat(F.substring_index(text, ".", 1), F.rpad(F.when(text.contains("."), F.substring_index(text, ".", -1)).otherwise(""), SCALE, "0")).cast("bigint")
    return F.when(text.rlike(_SHORT), short).when(text.rlike(_DECIMAL), any_form)


def split_envelope(frame: Column) -> tuple[Column, Column]:
    """(stream, data) of a combined frame; both null unless both are there and data is an object."""
    parsed = F.try_parse_json(frame)
    stream = F.try_variant_get(parsed, "$.stream", "string")
    is_name = F.schema_of_variant(F.try_variant_get(parsed, "$.stream", "variant")) == "STRING"
    raw = F.regexp_extract(frame, _FRAME, 1)
    data = F.when(raw != "", raw).otherwise(F.get_json_object(frame, "$.data"))
    ok = is_name & F.schema_of_variant(F.try_variant_get(parsed, "$.data", "variant")).startswith("OBJECT")
    return F.when(ok, stream), F.when(ok, data)


def symbol_of(stream: Column) -> Column:
    return F.upper(F.substring_index(stream, "@", 1))


def classify_stream(stream: Column) -> Column:
    """depth5, trade or depth_diff by the stream's name, in that order; depth_diff if it names none."""
    return F.when(stream.contains("@depth5"), "depth5").when(stream.contains("@trade"), "trade").otherwise("depth_diff")


def classify_payload(payload: Column) -> Column:
    """The kind by the payload's event name; depth5 if it has none that is known."""
    e = F.get_json_object(payload, "$.e")
    return F.when(e == "depthUpdate", "depth_diff").when(e == "trade", "trade").otherwise("depth5")


def type_letter(kind: Column) -> Column:
    return F.when(kind == "depth_diff", "D").when(kind == "depth5", "S").when(kind == "trade", "T")


def _levels(message: Column, names: tuple[str, str]) -> Column:
    """Two-string elements of the first of the named arrays that is there, as (price, qty) of scaled integers."""
    raw = F.coalesce(*[F.try_variant_get(message, f"$.{n}", "array<variant>") for n in names])
    pairs = F.transform(raw, lambda x: F.struct(F.schema_of_variant(x).alias("kind"), F.try_variant_get(x, "$", "array<string>").alias("pair")))
    pairs = F.filter(pairs, lambda x: (x["kind"] == "ARRAY<STRING>") & (F.size(x["pair"]) >= 2))
    return F.coalesce(F.transform(pairs, lambda x: F.struct(scale_decimal(x["pair"][0]).alias("price"), scale_decimal(x["pair"][1]).alias("qty"))), F.array().cast("array<struct<price:bigint,qty:bigint>>"))


def settled(df: DataFrame, name: str, column: Column) -> DataFrame:
    """df with a column that later filters and projections read and do not work out again.

    A filter on a computed column is otherwise moved below it, with the whole computation in the filter too.
    """
    return df.select("*", F.explode(F.array(column)).alias(name))


def with_message(df: DataFrame, payload: str, only: Column | None = None) -> DataFrame:
    """df with message: STRUCT first_id, final_id, pu, last_id, event_ms, bids, asks, valid (null where not `only`).

    Absent ids are 0, absent sides empty. One bad level makes the message invalid, as do broken JSON
    and a message with neither ids nor levels. Each payload is parsed once: the steps are columns of
    their own, which the optimizer does not repeat.
    """
    wanted = only if only is not None else F.lit(True)
    df = df.withColumn("_json", F.when(wanted, F.try_parse_json(F.col(payload))))
    message = F.col("_json")
    df = df.withColumns({"_bids": _levels(message, ("b", "bids")), "_asks": _levels(message, ("a", "asks"))})
    fields = {"U": "first_id", "u": "final_id", "pu": "pu", "lastUpdateId": "last_id", "E": "_e", "T": "_t"}
    df = df.withColumns({c: F.coalesce(F.try_variant_get(message, f"$.{n}", "bigint"), F.lit(0).cast("bigint")).alias(c) for n, c in fields.items() for c in [f"_m_{c}"]})
    bids, asks = F.col("_bids"), F.col("_asks")
    bad = lambda side: F.exists(side, lambda x: x["price"].isNull() | x["qty"].isNull())
    some = (F.col("_m_final_id") != 0) | (F.col("_m_last_id") != 0) | (F.size(bids) > 0) | (F.size(asks) > 0)
    event = F.coalesce(F.nullif(F.col("_m__e"), F.lit(0)), F.col("_m__t"))
    ids = [F.col(f"_m_{c}").alias(c) for c in ("first_id", "final_id", "pu", "last_id")]
    valid = F.coalesce(message.isNotNull() & some & ~bad(bids) & ~bad(asks), F.lit(False))
    struct = F.struct(*ids, event.alias("event_ms"), bids.alias("bids"), asks.alias("asks"), valid.alias("valid"))
    return settled(df, "message", F.when(wanted, struct)).drop("_json", "_bids", "_asks", *[f"_m_{c}" for c in fields.values()])


def trade_event_ms(payload: Column) -> Column:
    value = lambda n: F.get_json_object(payload, f"$.{n}").try_cast("bigint")
    return F.coalesce(value("E"), value("T"), F.lit(0).cast("bigint"))


def ms_to_time(ms: Column) -> tuple[Column, Column]:
    return F.floor(ms / 1000).cast("bigint"), ((ms % 1000) * 1_000_000).cast("int")


def time_policy(policy: str, event_ms: Column, tsec: Column, tnsec: Column) -> tuple[Column, Column]:
    """The stamp of a row: its receive time, or under `event` its event time where it has one."""
    if policy != "event":
        return tsec, tnsec
    sec, nsec = ms_to_time(event_ms)
    return F.when(event_ms > 0, sec).otherwise(tsec), F.when(event_ms > 0, nsec).otherwise(tnsec)


def instrument_id(symbol: Column) -> Column:
    """FNV-1a of the symbol's bytes in 31 bits."""
    # fixed values: the offset and the prime of that hash
    step = lambda h, c: (h.bitwiseXOR(F.ascii(c).cast("bigint")) * F.lit(16777619)).bitwiseAND(F.lit(4294967295))
    letters = F.when(F.length(symbol) > 0, F.split(symbol, "(?<=.)(?=.)")).otherwise(F.array().cast("array<string>"))
    return F.aggregate(letters, F.lit(2166136261).cast("bigint"), step).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")


def csv_escape(text: Column) -> Column:
    return F.when(text.rlike('[,"\n\r]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def first_levels(levels: Column, names: tuple[str, str], n: int = 5) -> list[Column]:
    """The first n levels as columns name0.., 0 where there are fewer."""
    price, size = names
    zero = F.lit(0).cast("bigint")
    at = lambda i, f: F.coalesce(F.try_element_at(levels, F.lit(i + 1))[f], zero)
    return [at(i, "price").alias(f"{price}{i}") for i in range(n)] + [at(i, "qty").alias(f"{size}{i}") for i in range(n)]
