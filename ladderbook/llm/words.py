"""Texts as runs of numbered pieces, with what is known of a piece kept by the worker."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MOST = 200_000  # pieces that a worker keeps, and
CELLS = 2_000_000  # numbers of them; it starts anew beyond
PART = 16_384  # pieces that are worked out at a time


def cut(texts: pa.Array, lower: bool) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct pieces, piece of each place, offsets of the texts): cut at blanks and between a letter and ASCII signs."""
    x = pc.ascii_lower(texts) if lower else texts
    x = pc.replace_substring_regex(x, r"(\pL)([!-&(-/:-@\[-`{-~])", r"\1 \2")
    x = pc.split_pattern(pc.replace_substring(x, "\n", " "), " ")
    if isinstance(x, pa.ChunkedArray):
        x = x.combine_chunks()
    words = x.flatten().dictionary_encode()
    offsets = x.offsets.to_numpy().astype(np.int64)
    return words.dictionary.to_pylist(), words.indices.to_numpy(), offsets - offsets[0]


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of each run of values."""
    total = np.zeros((len(values) + 1, *values.shape[1:]))
    np.cumsum(values, axis=0, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


class Known:
    """One row of numbers a piece, worked out by `learn` when a piece is first met."""

    def __init__(self, learn: Callable[[list[str]], np.ndarray]):
        self.learn = learn
        self.number: dict[str, int] = {}
        self.rows: np.ndarray | None = None

    def __call__(self, pieces: list[str]) -> np.ndarray:
        if len(self.number) > MOST or self.rows is not None and len(self.number) * self.rows.shape[1] > CELLS:
            self.number, self.rows = {}, None
        number = self.number
        missing = [w for w in pieces if w not in number]
        part_size = PART if self.rows is None or self.rows.shape[1] < 16 else max(256, PART * 16 // self.rows.shape[1])
        for at in range(0, len(missing), part_size):
            part = missing[at : at + part_size]
            new = self.learn(part)
            n = len(number)
            number.update(zip(part, range(n, n + len(part))))
            if self.rows is None:
                self.rows = np.empty((1024, new.shape[1]))
            while n + len(new) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.empty_like(self.rows)])
            self.rows[n : n + len(new)] = new
        if self.rows is None:
            return self.learn([])
        return self.rows[np.fromiter((number[w] for w in pieces), np.int64, len(pieces))]


def codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all words after one another, length of each)."""
    raw = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    return raw, np.fromiter(map(len, words), np.int64, len(words))


def sample(keyed, count_by: str | None, most: int, salt: int, by: tuple[str, ...] = ("key",)):
    """About `most` rows (of each value of count_by), chosen by a hash of the columns `by` whatever the table's size.

    Rows that are equal in them are chosen together; callers take one of each.
    """
    from pyspark.sql import functions as F

    space = 1 << 30
    spot = F.pmod(F.xxhash64(F.lit(salt), *by), F.lit(space))
    if count_by is None:
        n = keyed.count()
        return keyed.filter(spot < int(space * min(1.0, most / max(1, n))))
    counts = {r[count_by]: r["count"] for r in keyed.groupBy(count_by).count().collect()}
    if not counts:
        return keyed
    shares = F.create_map(*[F.lit(x) for value, n in sorted(counts.items()) for x in (value, int(space * min(1.0, most / n)))])
    return keyed.filter(spot < F.try_element_at(shares, F.col(count_by)))
