"""Price levels over time, and the best of them after every update."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_BOOK = ["capture_id", "venue", "symbol", "segment"]
CHUNK = 1024  # updates of a segment that one task sweeps
CELLS = 2_000_000  # updates times prices that are looked at together
BEST = 5
STATE = [f"{n}{i}" for n in ("bid", "bid_size", "ask", "ask_size") for i in range(BEST)]


def exploded(rows: DataFrame) -> DataFrame:
    """rows (…segment, ordinal, message) as (…segment, ordinal, side, pos, price, qty); side 0 bids, 1 asks."""
    def side(n: int, name: str):
        return F.transform(F.col(f"message.{name}"), lambda x, i: F.struct(F.lit(n).alias("side"), i.alias("pos"), x["price"].alias("price"), x["qty"].alias("qty")))

    both = F.array(side(0, "bids"), side(1, "asks"))
    return rows.select(*_BOOK, "ordinal", F.inline(F.flatten(both)))


def last_writes(updates: DataFrame) -> DataFrame:
    """One quantity a price and ordinal: the last of the message. Zero quantities in a seed are no levels."""
    real = updates.filter("ordinal > 0 or qty <> 0")
    return real.groupBy(*_BOOK, "ordinal", "side", "price").agg(F.max_by("qty", "pos").alias("qty"))


def lifetimes(writes: DataFrame) -> DataFrame:
    """writes with until: the ordinal of the next write of the same price, null if there is none."""
    return writes.withColumn("until", F.lead("ordinal").over(Window.partitionBy(*_BOOK, "side", "price").orderBy("ordinal")))


def state_at_end(writes: DataFrame) -> DataFrame:
    """Live levels at each segment's end."""
    return lifetimes(writes).filter("until is null and qty <> 0").drop("until", "ordinal")


def best_levels(live: DataFrame, by: list[str]) -> DataFrame:
    """The best five levels a side of each book as 20 columns, 0 where there are fewer."""
    order = F.when(F.col("side") == 0, -F.col("price")).otherwise(F.col("price"))
    ranked = live.withColumn("n", F.row_number().over(Window.partitionBy(*by, "side").orderBy(order)) - 1).filter(F.col("n") < BEST)
    pick = lambda side, c, i: F.coalesce(F.max(F.when((F.col("side") == side) & (F.col("n") == i), F.col(c))), F.lit(0).cast("bigint"))
    return ranked.groupBy(*by).agg(*[pick(side, c, i).alias(f"{n}{i}") for side, n, c in ((0, "bid", "price"), (0, "bid_size", "qty"), (1, "ask", "price"), (1, "ask_size", "qty")) for i in range(BEST)])


def _sweep_side(ords: np.ndarray, at: np.ndarray, price: np.ndarray, qty: np.ndarray, sign: int) -> tuple[np.ndarray, np.ndarray]:
    """(prices, sizes) of the best after each of ords; at < ords[0]: what stood there before."""
    best, size = np.zeros((len(ords), BEST), np.int64), np.zeros((len(ords), BEST), np.int64)
    if not len(price):
        return best, size
    key = sign * price
    before = at < ords[0]
    still = np.setdiff1d(key[before & (qty != 0)], key[~before])
    if len(still) > BEST:  # always live: nothing beyond the fifth of them is ever among the best
        keep = key <= still[BEST - 1]
        at, price, qty, key, before = at[keep], price[keep], qty[keep], key[keep], before[keep]
    cols, col = np.unique(key, return_inverse=True)
    if len(ords) * len(cols) > CELLS and len(ords) > 1:
        return _in_halves(ords, at, price, qty, sign)
    grid = np.zeros((len(ords) + 1, len(cols)), np.int64)
    wrote = np.zeros(grid.shape, np.int32)
    row = np.where(before, 0, np.searchsorted(ords, at) + 1)
    grid[row, col] = qty
    wrote[row, col] = row
    np.maximum.accumulate(wrote, axis=0, out=wrote)
    now = np.take_along_axis(grid, wrote[1:].astype(np.int64), axis=0)
    live = now != 0
    rank = np.cumsum(live, axis=1)
    for i in range(BEST):
        hit = live & (rank == i + 1)
        there = np.flatnonzero(hit.any(1))
        c = hit[there].argmax(1)
        best[there, i], size[there, i] = sign * cols[c], now[there, c]
    return best, size


def _in_halves(ords: np.ndarray, at: np.ndarray, price: np.ndarray, qty: np.ndarray, sign: int) -> tuple[np.ndarray, np.ndarray]:
    """_sweep_side() of either half of ords; the second starts from the last write of each price in the first."""
    half = len(ords) // 2
    first = at < ords[half]
    one = _sweep_side(ords[:half], at[first], price[first], qty[first], sign)
    order = np.lexsort((at[first], price[first]))
    p, q = price[first][order], qty[first][order]
    last = np.r_[p[1:] != p[:-1], True] if len(p) else np.zeros(0, bool)
    held = np.full(int(last.sum()), ords[half] - 1, at.dtype)
    rest = [np.concatenate([x, y[~first]]) for x, y in ((held, at), (p[last], price), (q[last], qty))]
    two = _sweep_side(ords[half:], *rest, sign)
    return np.concatenate([one[0], two[0]]), np.concatenate([one[1], two[1]])


_FIELDS = [T.StructField(c, T.StringType()) for c in _BOOK[:3]] + [T.StructField(c, T.LongType()) for c in ("segment", "ordinal", *STATE)]
STATES = T.StructType(_FIELDS)
_ARROW = pa.schema([(f.name, pa.string() if isinstance(f.dataType, T.StringType) else pa.int64()) for f in _FIELDS])


def _sweep(batches):
    """Chunks one after another, as they come in order; only the unfinished one is kept back."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([*held, batch]).combine_chunks()
        first = _first_of_chunks(table)
        held = table.slice(first[-1]).to_batches()
        if len(first) > 1:
            yield _swept(table.slice(0, first[-1]), first[:-1])
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield _swept(table, np.zeros(1, np.int64))


def _first_of_chunks(table: pa.Table) -> np.ndarray:
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for name in (*_BOOK, "chunk"):
        x = table.column(name).to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def _swept(table: pa.Table, first: np.ndarray) -> pa.RecordBatch:
    side, ordinal, price, qty = (table.column(c).to_numpy() for c in ("side", "ordinal", "price", "qty"))
    found, sizes = [], []
    for i, j in zip(first.tolist(), [*first[1:].tolist(), table.num_rows]):
        s, o = side[i:j], ordinal[i:j]
        ords = np.unique(o[s < 0])
        best = []
        for n, sign in ((0, -1), (1, 1)):
            own = s == n
            best += _sweep_side(ords, o[own], price[i:j][own], qty[i:j][own], sign)
        found.append(np.column_stack([ords, *best]))
        sizes.append(len(ords))
    rows = np.concatenate(found)
    keys = table.select(_BOOK).take(pa.array(np.repeat(first, sizes)))
    cols = [keys.column(c).combine_chunks() for c in _BOOK] + [pa.array(rows[:, k]) for k in range(rows.shape[1])]
    return pa.Table.from_arrays(cols, schema=_ARROW).combine_chunks().to_batches()[0]


def _outlived(levels: DataFrame) -> DataFrame:
    """levels (…c0, c1) with the chunks between c0 and c1, all through which they live, as far as they can be
    among a chunk's best.

    Each stretch of chunks is cut into blocks of 1, 2, 4, … chunks, two of a size at most; a block hands
    only its best levels on to its chunks, so that a chunk gets some per size of block, however deep the book.
    """
    size = F.expr("shiftleft(1L, l)")
    blocks = levels.withColumn("l", F.explode(F.expr("sequence(0, cast(floor(log2(c1 - c0 - 1)) as int) + 1)")))
    blocks = blocks.withColumns({"lo": F.floor((F.col("c0") + size) / size), "hi": F.floor(F.col("c1") / size)}).filter("lo < hi")
    blocks = blocks.withColumn("block", F.explode(F.expr("filter(array(if(lo % 2 = 1, lo, null), if(hi % 2 = 1, hi - 1, null)), b -> b is not null)")))
    order = F.when(F.col("side") == 0, -F.col("price")).otherwise(F.col("price"))
    best = blocks.withColumn("n", F.row_number().over(Window.partitionBy(*_BOOK, "side", "l", "block").orderBy(order))).filter(F.col("n") <= BEST)
    chunks = F.sequence(F.col("block") * size, (F.col("block") + 1) * size - 1)
    return best.select(*_BOOK, "side", "price", "qty", F.explode(chunks).alias("chunk"))


def states(writes: DataFrame, marks: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The best levels at every ordinal of marks (…segment, ordinal), 0 being the seed itself.

    A segment is cut into chunks of `chunk` ordinals, each swept by itself from the levels that are
    alive where it starts, so that the one busy book of a capture is spread over many tasks. Of the
    levels that outlive a chunk only those reach it that can be among its best (_outlived).
    """
    number = lambda c: F.floor(F.greatest(c - 1, F.lit(0)) / chunk).cast("bigint")
    last = marks.groupBy(*_BOOK).agg(F.max("ordinal").alias("top"))
    lived = lifetimes(writes).join(last, _BOOK)
    end = number(F.least(F.coalesce("until", F.col("top")), F.col("top")))
    own = lived.select(*_BOOK, number(F.col("ordinal")).alias("chunk"), "side", "ordinal", "price", "qty")
    long = lived.filter("qty <> 0").select(*_BOOK, "side", "price", "qty", number(F.col("ordinal")).alias("c0"), end.alias("c1")).filter("c1 > c0")
    carried = long.withColumn("chunk", F.col("c1")).drop("c0", "c1").unionByName(_outlived(long.filter("c1 > c0 + 1")))
    carried = carried.select(*_BOOK, "chunk", "side", F.lit(-1).cast("bigint").alias("ordinal"), "price", "qty")
    none = F.lit(0).cast("bigint")
    signs = marks.select(*_BOOK, number(F.col("ordinal")).alias("chunk"), F.lit(-1).alias("side"), "ordinal", none.alias("price"), none.alias("qty"))
    rows = own.unionByName(carried).unionByName(signs)
    by = [*_BOOK, "chunk"]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # by number: small partitions of much work are not to be merged
    return rows.repartition(parts, *by).sortWithinPartitions(*by).mapInArrow(_sweep, STATES)
