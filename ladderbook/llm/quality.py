"""Quality classifier: supervised subword embeddings.

Words, their character n-grams and word pairs are hashed to rows of one table of vectors. A document
is the mean of its features' vectors, and a softmax layer over it gives the score. Vectors and layer
are trained together by stochastic gradient descent in numpy, on a bounded sample of labelled rows.
As mean and layer are linear, scoring needs one number a feature: the layer's pull on its vector.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ragged, raw_bytes, remembered, slices, text_array, trimmed
from .words import Known, codes, cut, sample, sums

SLICE = 1 << 20  # bytes of text that are scored at a time
ROWS = 3_000  # labelled texts of the sample, half of them of each label (its documented bound)
CHARACTERS = 6_000_000  # of the sampled texts of one label together (documented too); one text at least, however long
BUCKETS = 1 << 17
SIZE = 8  # numbers of a vector
GRAMS = (3, 4)  # characters of an n-gram
EPOCHS = 12
RATE = 0.6
BATCH = 64
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _bucket(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((h ^ (h >> np.uint64(29))) >> np.uint64(8)).astype(np.int64) % BUCKETS


def _word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, bucket) of every feature of the words, the word itself and its n-grams; a hash of each word."""
    raw, sizes = codes(words)
    room = sizes + 2
    ends = np.cumsum(room)
    marks = np.zeros(int(room.sum()), np.uint64)
    inner = np.ones(len(marks), bool)
    inner[ends - room] = inner[ends - 1] = False
    marks[inner] = raw.astype(np.uint64) + np.uint64(3)
    marks[ends - room], marks[ends - 1] = 1, 2
    place = np.arange(len(marks)) - np.repeat(ends - room, room)
    owner = np.repeat(np.arange(len(words)), room)
    power = np.cumprod(np.full(int(room.max(initial=1)), _MIX, np.uint64))
    whole = np.add.reduceat(marks * power[place], ends - room) if len(words) else np.empty(0, np.uint64)
    owners, buckets = [np.arange(len(words))[sizes > 0]], [_bucket(whole[sizes > 0])]
    h = marks * _MIX
    for n in range(2, max(GRAMS) + 1):
        longer = np.zeros(len(marks), np.uint64)
        longer[1:] = h[:-1] * _MIX + marks[1:]
        h = longer ^ (longer >> np.uint64(29))
        if n in GRAMS:
            ok = place >= n - 1
            owners.append(owner[ok])
            buckets.append(_bucket(h[ok] + np.uint64(n)))
    return np.concatenate(owners), np.concatenate(buckets), whole


def _pairs(word: np.ndarray, offsets: np.ndarray, empty: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, bucket) of pairs of neighbours, and of a mark where a word is one of the two before it."""
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    some = ~empty
    word, owner = word[some], owner[some]
    near = owner[1:] == owner[:-1]
    pair = _bucket(word[1:] * _MIX + word[:-1])[near]
    same = np.zeros(len(word), bool)
    same[1:] |= near & (word[1:] == word[:-1])
    same[2:] |= (owner[2:] == owner[:-2]) & (word[2:] == word[:-2])
    return np.concatenate([owner[1:][near], owner[same]]), np.concatenate([pair, np.full(same.sum(), BUCKETS)])


@dataclass
class Model:
    pull: np.ndarray  # by bucket; the last is for repeated words
    bias: float


def _counted(texts: pa.Array):
    """(row, bucket, weight) of the texts' features, each once; weights of a row sum to 1."""
    pieces, piece, offsets = cut(texts, False)
    owner, bucket, whole = _word_features(pieces)
    order = np.argsort(owner, kind="stable")
    bucket, sizes = bucket[order], np.bincount(owner, minlength=len(pieces))
    starts = np.cumsum(sizes) - sizes
    row = np.repeat(np.arange(len(texts)), np.diff(offsets))
    blank = np.fromiter((not p for p in pieces), bool, len(pieces))
    rows, buckets = np.repeat(row, sizes[piece]), bucket[ragged(starts[piece], sizes[piece])]
    r2, b2 = _pairs(whole[piece], offsets, blank[piece])
    key, count = np.unique(np.r_[rows, r2] * (BUCKETS + 1) + np.r_[buckets, b2], return_counts=True)
    rows, buckets = key // (BUCKETS + 1), key % (BUCKETS + 1)
    return rows, buckets, count / np.bincount(rows, count, len(texts))[rows]


def train(texts: list[str], labels: np.ndarray) -> Model | None:
    if not len(labels) or labels.min() == labels.max():
        return None
    rng = np.random.default_rng(11)
    table = rng.uniform(-1 / SIZE, 1 / SIZE, (BUCKETS + 1, SIZE)).astype(np.float32)
    layer, bias = np.zeros((SIZE, 2), np.float32), np.zeros(2, np.float32)
    batches = []
    order = rng.permutation(len(texts))
    for i in range(0, len(order), BATCH):
        chosen = order[i : i + BATCH]
        rows, buckets, weight = _counted(pa.array([texts[k] for k in chosen.tolist()], pa.string()))
        back = np.argsort(buckets, kind="stable")
        first = np.flatnonzero(np.r_[True, np.diff(buckets[back]) != 0]) if len(back) else np.empty(0, np.int64)
        present = np.flatnonzero(np.bincount(rows, minlength=len(chosen)))
        cuts = np.searchsorted(rows, present)
        batches.append((len(chosen), present, cuts, rows.astype(np.int32), buckets.astype(np.int32), weight.astype(np.float32), back.astype(np.int32), first, labels[chosen]))
    steps = EPOCHS * len(batches)
    for step in range(steps):
        n, present, cuts, rows, buckets, weight, back, first, y = batches[step % len(batches)]
        rate = np.float32(RATE * (1 - step / steps))
        mean = np.zeros((n, SIZE), np.float32)
        if len(rows):
            mean[present] = np.add.reduceat(table[buckets] * weight[:, None], cuts, axis=0)
        z = mean @ layer + bias
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(n), y] -= 1
        down = p @ layer.T
        layer -= rate * (mean.T @ p) / np.float32(4)
        bias -= rate * p.mean(0)
        if len(rows):
            grad = np.add.reduceat((down[rows] * weight[:, None])[back], first, axis=0)
            table[buckets[back[first]]] -= rate * np.float32(8) * grad
    return Model((table @ (layer[:, 1] - layer[:, 0])).astype(float), float(bias[1] - bias[0]))


def _learn(model: Model, pieces: list[str]) -> np.ndarray:
    """Per piece: sum of its features' pulls, their number, its hash in two halves, whether it is blank."""
    owner, bucket, whole = _word_features(pieces)
    out = np.zeros((len(pieces), 5))
    if len(pieces):
        out[:, 0] = np.bincount(owner, model.pull[bucket], len(pieces))
        out[:, 1] = np.bincount(owner, minlength=len(pieces))
        out[:, 2], out[:, 3] = whole >> np.uint64(32), whole & np.uint64(0xFFFFFFFF)
        out[:, 4] = [not p for p in pieces]
    return out


def scores(texts: pa.Array, model: Model, known: Known) -> np.ndarray:
    pieces, piece, offsets = cut(texts, False)
    rows = known(pieces)
    total, count = np.zeros(len(texts)), np.zeros(len(texts))
    if len(piece):
        pull, n = rows[:, 0][piece], rows[:, 1][piece]
        both = sums(np.stack([pull, n], 1), offsets)
        word = ((rows[:, 2].astype(np.uint64) << np.uint64(32)) | rows[:, 3].astype(np.uint64))[piece]
        owner, bucket = _pairs(word, offsets, rows[:, 4][piece] > 0)
        total = both[:, 0] + np.bincount(owner, model.pull[bucket], len(texts))
        count = both[:, 1] + np.bincount(owner, minlength=len(texts))
    return 1 / (1 + np.exp(-(total / np.maximum(count, 1) + model.bias)))


def _score(shared, mark: int, text_col: str | None):
    def run(batches):
        model = shared.value
        known = remembered(mark, lambda: Known(functools.partial(_learn, model)))
        for batch in trimmed(batches, mark):
            texts = text_array(batch.column("_text"))
            _, offsets = raw_bytes(texts)
            found = [scores(texts.slice(i, j - i), model, known) for i, j in slices(offsets, SLICE)]
            names = {c: text_col if c == "_text" else c for c in batch.schema.names if c != "_text" or text_col}
            schema = pa.schema([*(batch.schema.field(c).with_name(n) for c, n in names.items()), ("score", pa.float64())])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(np.concatenate(found) if found else [], pa.float64())], schema=schema)

    return run


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> Model | None:
    """A model of about ROWS // 2 texts of each label, whole, chosen by a hash of the id, and of these in the
    order of a hash as many as have CHARACTERS together, one at least. The bias is set right by the labels' shares.

    labels: (id, label 0 or 1); rows with a null in either are no labels. None if only one label is there.
    """
    known = labels.select(F.col(id_col).alias("key"), F.col(label_col).cast("int").alias("label")).filter("key is not null and label in (0, 1)").distinct()
    chosen = sample(known, "label", ROWS // 2, 8)  # about ROWS small rows whatever the input's size, and so broadcast
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("key"), text.alias("text")).join(F.broadcast(chosen), "key")
    rows = rows.groupBy("key", "label").agg(F.min("text").alias("text"))  # one text an id, however often it is there
    ordered = Window.partitionBy("label").orderBy(F.xxhash64(F.lit(9), "key"), "key")
    until = F.sum(F.length("text")).over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumns({"place": F.row_number().over(ordered), "until": until}).filter((F.col("place") == 1) | (F.col("until") <= CHARACTERS))
    rows = rows.select("key", "label", "text").collect()
    rows.sort(key=lambda r: (r["key"], r["text"], r["label"]))
    drawn = np.array([r["label"] for r in rows], np.int64)
    model = train([r["text"] for r in rows], drawn)
    if model is not None:
        there = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
        model.bias += float(np.log(there[1] / there[0]) - np.log((drawn == 1).sum() / (drawn == 0).sum()))
    return model


def score(docs: DataFrame, model: Model | None, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """docs (without text_col if not keep_text) with score, the probability of label 1 (0 to 1).

    Null and empty texts get the score of a text without features, and every text gets 0.5 if there
    is no model. Texts are read whole; repeated rows get one result each. A column of docs named
    score is replaced, others are handed through.
    """
    import uuid

    kept = docs.select(*[c for c in docs.columns if c not in ("score", "_text", text_col)], F.col(text_col).cast("string").alias("_text"))
    if model is None:
        kept = kept.withColumnRenamed("_text", text_col) if keep_text else kept.drop("_text")
        return kept.withColumn("score", F.lit(0.5))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = [T.StructField(text_col if f.name == "_text" else f.name, f.dataType) for f in kept.schema if f.name != "_text" or keep_text]
    return kept.mapInArrow(_score(shared, uuid.uuid4().int, text_col if keep_text else None), T.StructType(fields + [T.StructField("score", T.DoubleType())]))
