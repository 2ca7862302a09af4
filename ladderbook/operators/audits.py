"""Quality checks of captures and books."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.captures import BOOK
from .numbering import numbered

KEY = ["capture_id", "venue", "symbol"]


def in_order(*by: str):
    return Window.partitionBy(*KEY, *by).orderBy("conn_epoch", "conn_seq")


def epoch_segments(market: DataFrame) -> DataFrame:
    """market with changed (another connection than the row before of its symbol) and epoch_seg, how many changes so far.

    Only the connections of a symbol are put in order, not its rows: a change is the least number of a
    connection that isn't the first. Rows that repeat that number are all marked; rows without a
    connection come before all others and are no change.
    """
    by = Window.partitionBy(*KEY).orderBy("_epoch")
    found = market.groupBy(*KEY, F.col("conn_epoch").alias("_epoch")).agg(F.min("conn_seq").alias("_first")).filter("_epoch is not null")
    found = found.withColumn("epoch_seg", (F.row_number().over(by) - 1).cast("bigint"))
    found = found.select(*[F.col(c).alias(f"_{c}") for c in KEY], "_epoch", "_first", "epoch_seg")
    same = F.col("conn_epoch") == F.col("_epoch")
    for c in KEY:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    joined = market.join(found, same, "left")
    changed = F.coalesce((F.col("epoch_seg") > 0) & (F.col("conn_seq") == F.col("_first")), F.lit(False))
    return joined.select(*market.columns, changed.alias("changed"), F.coalesce("epoch_seg", F.lit(0)).alias("epoch_seg"))


def continuity(parsed: DataFrame) -> DataFrame:
    """Each valid diff against the diffs before it in its connection: first, stale, gap or next.

    Spot: stale if its last id was reached, a gap if its first id leaves one out. Futures: a gap if its
    previous id isn't the last one seen.
    """
    diffs = parsed.filter("stream_kind = 'depth_diff' and valid")
    last = F.max("message.final_id").over(in_order("conn_epoch").rowsBetween(Window.unboundedPreceding, -1))
    seen = diffs.select(*KEY, "conn_epoch", "conn_seq", F.col("message.first_id").alias("first_id"), F.col("message.final_id").alias("final_id"), F.col("message.pu").alias("pu"), last.alias("last_id"))
    gap = F.when(F.col("venue") == "usdm", F.col("pu") != F.col("last_id")).otherwise(F.col("first_id") > F.col("last_id") + 1)
    return seen.withColumn("outcome", F.when(F.col("last_id").isNull(), "first").when(F.col("final_id") <= F.col("last_id"), "stale").when(gap, "gap").otherwise("next"))


def crossed(book: DataFrame) -> DataFrame:
    return book.filter("bid0 > 0 and ask0 > 0 and bid0 >= ask0")


def shard_load(market: DataFrame, most: int = 1024, streams: int = 3) -> DataFrame:
    """Per (capture, shard, connection): messages, symbols, streams, and whether these are more than one connection may have."""
    one = market.groupBy("capture_id", "shard_id", "conn_epoch", "symbol").agg(F.count("*").alias("n"))
    load = one.groupBy("capture_id", "shard_id", "conn_epoch").agg(F.sum("n").alias("messages"), F.count("*").alias("symbols"))
    return load.withColumn("streams", F.col("symbols") * streams).withColumn("over", F.col("streams") > most)


def conn_numbering(frames: DataFrame) -> DataFrame:
    """Per connection: frames, the least and largest number, and how many numbers are missing."""
    by = frames.groupBy("shard_id", "conn_epoch").agg(F.count("*").alias("frames"), F.min("conn_seq").alias("first_seq"), F.max("conn_seq").alias("last_seq"))
    return by.withColumn("holes", F.col("last_seq") - F.col("first_seq") + 1 - F.col("frames"))


def difference(left: DataFrame, right: DataFrame, span: int = 100_000) -> DataFrame:
    """Rows of either book table that the other has not, as often as they are too many, with only_in.

    Compared are the 26 columns and those of capture, venue and symbol that both have. First only sums of row
    hashes meet, one for each book and `span` numbers; rows move where these differ, so equal books move digests.
    """
    key = [c for c in KEY if c in left.columns and c in right.columns]
    a, b = (df.select(*[F.col(c).cast("string").alias(c) for c in key], *BOOK) for df in (left, right))
    unlike = _unlike(a, b, key, span)
    a, b = _among(a, unlike, key, span), _among(b, unlike, key, span)
    return a.exceptAll(b).withColumn("only_in", F.lit("left")).unionByName(b.exceptAll(a).withColumn("only_in", F.lit("right")))


def _spans(book: DataFrame, span: int) -> DataFrame:
    return book.withColumn("_span", F.floor(F.col("seqNo") / span))


def _unlike(a: DataFrame, b: DataFrame, key: list[str], span: int) -> DataFrame:
    """Places (key, _span) whose rows differ by count or by sums of two hashes, each in halves that sum up without overflow."""
    halves = [h for seed in (1, 2) for h in (f"shiftright(_h{seed}, 32)", f"_h{seed} & 4294967295")]

    def sums(df: DataFrame) -> DataFrame:
        hashed = _spans(df, span).withColumns({f"_h{seed}": F.xxhash64(F.lit(seed), *df.columns) for seed in (1, 2)})
        return hashed.groupBy(*key, "_span").agg(F.count("*").alias("_n"), *[F.sum(F.expr(h)).alias(f"_s{k}") for k, h in enumerate(halves)])

    # equal digests of a place are put together; what stands alone after that is unlike
    digest = ["_n", *[f"_s{k}" for k in range(4)]]
    both = sums(a).withColumn("_side", F.lit(1)).unionByName(sums(b).withColumn("_side", F.lit(2)))
    return both.groupBy(*key, "_span", *digest).agg(F.count("*").alias("_sides")).filter("_sides = 1").select(*key, "_span").distinct()


def _among(book: DataFrame, places: DataFrame, key: list[str], span: int) -> DataFrame:
    names = [*key, "_span"]
    same = F.lit(True)
    for c in names:
        same = same & F.col(c).eqNullSafe(F.col(f"_of{c}"))
    return _spans(book, span).join(places.select(*[F.col(c).alias(f"_of{c}") for c in names]), same, "left_semi").drop("_span")


def conn_running(frames: DataFrame, chunk: int = 100_000) -> DataFrame:
    """frames with number (1, 2, … in each connection) and reconnects (connections of the shard before this one)."""
    own = ["shard_id", "conn_epoch"]
    epochs = frames.select(*own).distinct()  # as few as connections
    before = (F.row_number().over(Window.partitionBy("shard_id").orderBy("conn_epoch")) - 1).cast("bigint")
    return numbered(frames, ["conn_seq"], chunk, own, "number").join(epochs.withColumn("reconnects", before), own)


def summary(market: DataFrame, snapshots: DataFrame, book: DataFrame) -> DataFrame:
    """Per capture: rows of the three tables, and how many book rows are crossed."""
    count = lambda df, name: df.groupBy("capture_id").agg(F.count("*").alias(name))
    found = count(market, "market_rows")
    for df, name in ((snapshots, "snapshot_rows"), (book, "book_rows"), (crossed(book), "crossed_rows")):
        found = found.join(count(df, name), "capture_id", "left")
    return found.fillna(0)


def metrics(parsed: DataFrame, actions: DataFrame, book: DataFrame, checks: DataFrame, bad_snapshots: DataFrame | None = None, bad_rows: DataFrame | None = None, by: tuple[str, ...] = ("capture_id", "symbol")) -> DataFrame:
    """Counters by capture and symbol, by capture where the symbol is null, and over all where both are.

    bad_snapshots: parse_snapshots() rows, the broken of which are parse errors; bad_rows: rows of a
    capture with too few fields (read_market), which are parse errors but no messages, and whose symbol is null.
    """
    c = lambda cond: F.count_if(F.expr(cond))
    rows = parsed.groupBy(*by).agg(F.count("*").alias("msgs_total"), c("stream_kind = 'depth_diff'").alias("depth_diff"), c("stream_kind = 'depth5'").alias("depth5"), c("stream_kind = 'trade'").alias("trade"), c("not valid").alias("parse_errors"))
    acts = actions.groupBy(*by).agg(c("action = 'gap'").alias("gaps"), c("action = 'reset'").alias("reconnects"), c("action = 'seed' and source = 'snapshot'").alias("resyncs"), c("action = 'overflow'").alias("buffer_overflows"))
    checked = checks.groupBy(*by).agg(c("book_bid <> depth5_bid").alias("depth5_mismatch"))
    out = book.groupBy(*by).agg(F.count("*").alias("ob_rows"))
    all_of = rows.join(acts, [*by], "left").join(checked, [*by], "left").join(out, [*by], "left")
    if bad_snapshots is not None:
        wrong = bad_snapshots.filter("not valid").groupBy(*by).agg(F.count("*").alias("bad"))
        all_of = all_of.join(wrong, [*by], "full").withColumn("parse_errors", F.coalesce("parse_errors", F.lit(0)) + F.coalesce("bad", F.lit(0))).drop("bad")
    all_of = all_of.fillna(0).withColumn("md_rows", F.coalesce("msgs_total", F.lit(0)))
    names = [n for n in all_of.columns if n not in by]
    found = all_of.rollup(*by).agg(*[F.sum(n).alias(n) for n in names])
    if bad_rows is None:
        return found
    short = bad_rows.withColumn("symbol", F.lit(None).cast("string")).rollup("capture_id").agg(F.count("*").alias("short")).withColumn("symbol", F.lit(None).cast("string"))
    if "capture_id" not in by:
        short = short.filter("capture_id is null").drop("capture_id")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in by]
    both = found.alias("a").join(short.alias("b"), same, "left")
    return both.select(*[f"a.{c}" for c in by], *[(F.col(f"a.{n}") + F.coalesce("b.short", F.lit(0)) if n == "parse_errors" else F.col(f"a.{n}")).alias(n) for n in names])


def observed(market: DataFrame, name: str = "capture") -> DataFrame:
    """market, reporting its counters to the session's listeners while a batch or a stream writes it."""
    kinds = {"depth_diff": "depth_diff", "depth5": "depth5", "trade": "trade"}
    return market.observe(name, F.count("*").alias("msgs_total"), *[F.count_if(F.col("stream_kind") == k).alias(n) for k, n in kinds.items()])
