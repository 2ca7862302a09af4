"""Row numbers without one task a key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ["capture_id", "venue", "symbol"]


def numbered(rows: DataFrame, order: list[str], chunk: int = 100_000, key: list[str] | None = None, name: str = "seqNo") -> DataFrame:
    """rows with `name` 1, 2, … in each key (a book, if none is given) by the integer columns `order`.

    Rows are dealt to ranges of the first column, counted, and numbered inside from where the range
    starts, so that a key with very many rows is spread over tasks. A null in the key, or a null number, is a
    value like any other.
    """
    key = key or KEY
    dealt = rows.select("*", F.floor(F.col(order[0]) / chunk).alias("_range"))
    counts = dealt.groupBy(*key, "_range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*[F.col(c).alias(f"_of_{c}") for c in (*key, "_range")], F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy(*key, "_range").orderBy(*order))
    same = F.lit(True)
    for c in (*key, "_range"):
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    return dealt.join(starts, same).withColumn(name, F.col("_start") + inside).select(*rows.columns, name)
