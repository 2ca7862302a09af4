"""Places and running sums inside keys of any size, without a task a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written


def placed(rows: DataFrame, key: list[str], order: list[str], size: Column, name: str = "place") -> DataFrame:
    """rows with `name`: 1 and the sizes of the rows before it in its key, by the columns of order (nulls first).

    Rows should differ in key and order (put equal ones together and give their number as size). They are
    dealt by sampled ranges of key and order, so a key of very many rows is spread over tasks; each range
    counts for itself, and only the ranges' totals of a key are added up in one place. Null is a key too.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = rows.withColumn("_size", size.cast("bigint")).repartitionByRange(parts, *[F.col(c).asc_nulls_first() for c in (*key, *order)])
    ranges = written(ranges.withColumn("_part", F.spark_partition_id()), "ranges")
    before = Window.partitionBy(*key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranges.groupBy(*key, "_part").agg(F.sum("_size").alias("_total"), F.count("*").alias("_rows"))
    starts = totals.select(*[F.col(c).alias(f"_of_{c}") for c in key], F.col("_part").alias("_at"), F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_start")).filter("_start > 0")
    same = F.col("_part") == F.col("_at")
    for c in key:
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    inside = Window.partitionBy(*key, "_part").orderBy(*[F.col(c).asc_nulls_first() for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    # a key goes on in a later range at most once a range: as many starts as ranges
    joined = ranges.join(starts, same, "left")
    place = F.coalesce(F.col("_start"), F.lit(0)) + F.coalesce(F.sum("_size").over(inside), F.lit(0)) + 1
    return joined.withColumn(name, place).select(*rows.columns, name)


def running(rows: DataFrame, key: list[str], at: str, sums: dict[str, str], down: bool = False, block: int = 4096) -> DataFrame:
    """rows with sums[c] for each column c: its sum over the key's rows up to this one by the integer column `at`
    (from this one on if down). Keys and `at` are not null.

    Rows are added up in blocks of `at`, and blocks' totals in front of them, so that no task gets a whole key.
    """
    dealt = rows.withColumn("_block", F.floor(F.col(at) / block))
    order = lambda c: F.col(c).desc() if down else F.col(c).asc()
    before = Window.partitionBy(*key).orderBy(order("_block")).rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy(*key, "_block").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    totals = totals.select(*key, "_block", *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_t_{c}") for c in sums])
    inside = Window.partitionBy(*key, "_block").orderBy(order(at)).rowsBetween(Window.unboundedPreceding, 0)
    joined = dealt.join(totals, [*key, "_block"])
    return joined.select(*rows.columns, *[(F.col(f"_t_{c}") + F.sum(c).over(inside)).alias(name) for c, name in sums.items()])


def looked_up(rows: DataFrame, right: DataFrame, key: list[str], salt: Column) -> DataFrame:
    """rows with right's other columns by key (null where it has none); right has one row a key, keys are not null.

    The salt parts each key's rows; only the distinct pairs of key and salt meet right, so a key of very many
    rows is spread without copies of right that nobody needs.
    """
    dealt = rows.withColumn("_salt", salt)
    pairs = dealt.select(*key, "_salt").distinct().join(right, key, "left")
    return dealt.join(pairs, [*key, "_salt"]).drop("_salt")
