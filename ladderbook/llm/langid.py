"""Language identification by character models with interpolated Kneser-Ney smoothing.

One model a language, over the letters of words with marks for their starts and ends. All models
share sorted arrays of n-gram hashes, beside which stand each language's discounted probability and
back-off weight. A text goes to the language of lowest cross-entropy per character. A text whose
cross-entropy is far above what held-back training texts of that language show is rejected.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import give_back, ragged, raw_bytes, remembered, slices, text_array, trimmed
from .words import CELLS, Known, codes, cut, sample, sums

ORDER = 4
SLICE = 1 << 20  # bytes of text that are scored at a time
PER_LANGUAGE = 600  # training texts of one language (the sample's documented bound), fewer with many languages:
TEXTS = 24_000  # of all languages together, ten of each at least
CHARACTERS = 48_000_000  # of the training texts together, shared out evenly, 12,000,000 a language at most; one text each at least, however long
WHOLE = 1 << 21  # numbers of a table that is kept whole, which is faster; larger ones are kept by language
SLACK = 1.5  # bits a character above the usual before a text is rejected, beside SIGMAS deviations
SIGMAS = 8.0
UNKNOWN = "und"
_OTHER = regex.compile(r"[^\p{L}\p{M}]+")
_LETTER = regex.compile(r"\p{L}")
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Rows:
    """Numbers of few languages for each of many hashes."""

    start: np.ndarray
    language: np.ndarray
    value: np.ndarray

    def of(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in wanted, language, value) of all numbers of the wanted hashes."""
        size = self.start[wanted + 1] - self.start[wanted]
        at = ragged(self.start[wanted], size)
        return np.repeat(np.arange(len(wanted)), size), self.language[at], self.value[at]

    def whole(self, languages: int, default: float) -> np.ndarray:
        """The same as a table of all languages."""
        table = np.full((len(self.start) - 1, languages), default)
        table[np.repeat(np.arange(len(table)), np.diff(self.start)), self.language] = self.value
        return table


@dataclass
class Model:
    languages: list[str]
    floor: float  # probability of any character before anything is known
    grams: list[np.ndarray]  # by order, sorted hashes
    found: list[Rows | np.ndarray]  # by order, discounted probability of an n-gram in the languages that have it
    contexts: list[np.ndarray]  # by order, sorted hashes of the n-grams' contexts
    rest: list[Rows | np.ndarray]  # by order, weight of the lower order after a context, 1 in languages that have not seen it
    usual: np.ndarray | None = None  # by language, mean cross-entropy; infinite where no text could be held back
    spread: np.ndarray | None = None  # by language, deviation of one character


def _letters(words: list[str]) -> list[str]:
    return [_OTHER.sub("", w.lower()) for w in words]


def _grams(words: list[str]):
    """For the words with a start mark (1) and an end mark (2): a hash of the last n characters at each place, n = 1..ORDER; places; owner."""
    raw, sizes = codes(words)
    room = sizes + 2
    ends = np.cumsum(room)
    marks = np.zeros(int(room.sum()), np.uint64)
    inner = np.ones(len(marks), bool)
    inner[ends - room] = inner[ends - 1] = False
    marks[inner] = raw.astype(np.uint64) + np.uint64(3)
    marks[ends - room], marks[ends - 1] = 1, 2
    owner = np.repeat(np.arange(len(words)), room)
    place = np.arange(len(marks)) - np.repeat(ends - room, room)
    hashes = [marks * _MULTIPLIER]
    for _ in range(1, ORDER):  # the last n - 1 characters one place before, and this one
        h = np.zeros(len(marks), np.uint64)
        h[1:] = hashes[-1][:-1] * _MULTIPLIER + marks[1:]
        hashes.append(h ^ (h >> np.uint64(29)))
    return hashes, place, owner


def _tally(hashes: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, back = np.unique(hashes, return_inverse=True)
    return keys, np.bincount(back, weights, len(keys))


def _one(words: list[str], weights: np.ndarray):
    """By order: (n-grams, discounted probability, contexts, weight of the lower order) of one language."""
    hashes, place, owner = _grams(words)
    w = weights[owner].astype(float)
    out = []
    for n in range(1, ORDER + 1):
        ok = place >= max(n - 1, 1)
        h, at = hashes[n - 1][ok], np.flatnonzero(ok)
        context = hashes[n - 2][at - 1] if n > 1 else np.zeros(len(h), np.uint64)
        if n < ORDER:  # how many different characters precede it; as often as seen where a word starts
            first = place[ok] == n - 1
            inside = np.flatnonzero(~first)
            longer = hashes[n][at[inside]]
            _, one = np.unique(longer, return_index=True)
            picked = np.r_[inside[one], np.flatnonzero(first)]
            weight = np.r_[np.ones(len(one)), w[at[first]]]
            h, context = h[picked], context[picked]
        else:
            weight = w[at]
        keys, first = np.unique(h, return_index=True)
        keys, count = _tally(h, weight)
        context = context[first]
        once, twice = (count == 1).sum(), (count == 2).sum()
        discount = once / (once + 2 * twice) if once and twice else 0.5
        ctx, back = np.unique(context, return_inverse=True)
        total = np.bincount(back, count)
        kinds = np.bincount(back)
        low = np.minimum(discount, count)
        out.append((keys, (count - low) / total[back], ctx, np.bincount(back, low) / total))
    return out


def train(texts: dict[str, list[str]]) -> Model | None:
    """A model of the languages' texts; every fifth text with a letter only sets what is usual.

    Languages of fewer than five such texts learn from all of them, and what is usual is measured on a
    model without the held-back one; it stays infinite, and nothing is rejected, where there is but one.
    """
    if not texts:
        return None
    texts = {k: [t for t in v if _LETTER.search(t)] for k, v in sorted(texts.items())}
    rest = {k: [t for i, t in enumerate(v) if i % 5] for k, v in texts.items()}
    model = _build({k: rest[k] if len(v) >= 5 else v for k, v in texts.items()})
    apart = _build(rest) if any(1 < len(v) < 5 for v in texts.values()) else model
    model.usual, model.spread = np.full(len(texts), np.inf), np.ones(len(texts))
    for k, v in enumerate(texts.values()):
        if len(v) < 2:
            continue
        bits, n, _ = measure(pa.array(v[::5], pa.string()), Known(functools.partial(learn, model if len(v) >= 5 else apart)))
        own, n = bits[n > 0, k], n[n > 0]
        if len(own):
            model.usual[k] = own.sum() / n.sum()
            model.spread[k] = max(0.5, float(np.sqrt(np.mean((own / n - model.usual[k]) ** 2 * n))))
    return model


def _build(texts: dict[str, list[str]]) -> Model:
    languages = list(texts)
    parts, signs = [], set()
    for language in languages:
        words, piece, _ = cut(pa.array(texts[language], pa.string()), True)
        letters = _letters(words)
        weight = np.bincount(piece, minlength=len(words))
        merged: dict[str, int] = {}
        for w, k in zip(letters, weight.tolist()):
            if w:
                merged[w] = merged.get(w, 0) + k
        signs.update(*merged)
        parts.append(_one(list(merged) or [""], np.array(list(merged.values()) or [1])))
    model = Model(languages, 1 / (len(signs) + 2), [], [], [], [])
    for n in range(ORDER):
        for keys_at, value_at, keys_out, values_out, default in ((0, 1, model.grams, model.found, 0.0), (2, 3, model.contexts, model.rest, 1.0)):
            own = np.concatenate([p[n][keys_at] for p in parts])
            keys, place = np.unique(own, return_inverse=True)
            order = np.argsort(place, kind="stable")
            language = np.repeat(np.arange(len(languages)), [len(p[n][keys_at]) for p in parts])
            keys_out.append(keys)
            rows = Rows(np.searchsorted(place[order], np.arange(len(keys) + 1)), language[order], np.concatenate([p[n][value_at] for p in parts])[order])
            values_out.append(rows if len(keys) * len(languages) > WHOLE else rows.whole(len(languages), default))
    return model


def _look(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def learn(model: Model, pieces: list[str]) -> np.ndarray:
    """Per piece: bits in each language, characters predicted (its letters and its end), letters."""
    words = _letters(pieces)
    some = np.flatnonzero(np.fromiter(map(bool, words), bool, len(words)))
    out = np.zeros((len(words), len(model.languages) + 2))
    if not len(some):
        return out
    hashes, place, owner = _grams([words[i] for i in some.tolist()])
    at = np.flatnonzero(place >= 1)
    p = np.full((len(at), len(model.languages)), model.floor)
    for n in range(1, ORDER + 1):
        fits = np.flatnonzero(place[at] >= n - 1)
        context = hashes[n - 2][at[fits] - 1] if n > 1 else np.zeros(len(fits), np.uint64)
        c, seen = _look(model.contexts[n - 1], context)
        fits, c = fits[seen], c[seen]
        if isinstance(model.rest[n - 1], Rows):
            row, language, value = model.rest[n - 1].of(c)
            p[fits[row], language] *= value
        else:
            p[fits] *= model.rest[n - 1][c]
        g, seen = _look(model.grams[n - 1], hashes[n - 1][at[fits]])
        if isinstance(model.found[n - 1], Rows):
            row, language, value = model.found[n - 1].of(g[seen])
            p[fits[seen][row], language] += value
        else:
            p[fits[seen]] += model.found[n - 1][g[seen]]
    bits = -np.log2(p)
    ends = np.cumsum(np.bincount(owner[at], minlength=len(some)))
    out[some, :-2] = sums(bits, np.r_[0, ends])
    out[some, -2] = np.diff(np.r_[0, ends])
    out[some, -1] = [any(c.isalpha() for c in words[i]) for i in some.tolist()]
    return out


def measure(texts: pa.Array, known: Known) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bits by language, characters, letters) of each text."""
    pieces, piece, offsets = cut(texts, True)
    rows = known(pieces)
    if not len(piece):
        rows = np.zeros((len(texts), rows.shape[1]))
        return rows[:, :-2], rows[:, -2], rows[:, -1]
    counts = np.zeros((len(texts), rows.shape[1]))
    owner = np.repeat(np.arange(len(texts)), np.diff(offsets))
    step = max(1, CELLS // rows.shape[1])
    for i in range(0, len(piece), step):
        own = owner[i : i + step]
        first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        counts[own[first]] += np.add.reduceat(rows[piece[i : i + step]], first, axis=0)
    return counts[:, :-2], np.rint(counts[:, -2]), np.rint(counts[:, -1])


def _predict(shared, mark: int, text_col: str | None):
    schema = pa.schema([("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])

    def run(batches):
        model = shared.value
        known = remembered(mark, lambda: Known(functools.partial(learn, model)))
        for batch in trimmed(batches, mark):
            texts = text_array(batch.column("_text"))
            _, offsets = raw_bytes(texts)
            names, scores, rejected = [], [], []
            for i, j in slices(offsets, SLICE * 8 // max(8, len(model.languages))):
                bits, n, letters = measure(texts.slice(i, j - i), known)
                rate = bits / np.maximum(n, 1)[:, None]
                best = rate.argmin(1)
                least = rate.min(1)
                odds = np.exp((least[:, None] - rate) * np.log(2) * np.minimum(n, 30)[:, None]).sum(1)
                bound = model.usual[best] + SLACK + SIGMAS * model.spread[best] / np.sqrt(np.maximum(n, 1))
                none = letters == 0
                names += [UNKNOWN if x else model.languages[b] for x, b in zip(none.tolist(), best.tolist())]
                scores.append(np.where(none, 0.0, 1 / odds))
                rejected.append(none | (least > bound))
            found = [pa.array(names, pa.string()), pa.array(np.concatenate(scores) if scores else [], pa.float64()), pa.array(np.concatenate(rejected) if rejected else [], pa.bool_())]
            names_in = {c: text_col if c == "_text" else c for c in batch.schema.names if c != "_text" or text_col}
            kept = [batch.column(c) for c in names_in]
            fields = [batch.schema.field(c).with_name(n) for c, n in names_in.items()]
            yield pa.RecordBatch.from_arrays(kept + found, schema=pa.schema([*fields, *schema]))

    return run


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", key_col: str = "doc_id") -> Model | None:
    """A model of the labelled rows (those with a text and a language): of each language about PER_LANGUAGE
    texts (with more than 40 languages its share of TEXTS), whole, chosen by a hash of key and text, and of these
    in the order of a hash as many as have its share of CHARACTERS together, one at least; equal rows count once.
    So what the driver trains on is bounded, but for one text and ten rows a language."""
    rows = labelled.select(F.col(key_col).alias("key"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    texts: dict[str, list[str]] = {}
    many = max(1, rows.agg(F.count_distinct("lang").alias("n")).first()["n"])
    chosen = sample(rows, "lang", max(10, min(PER_LANGUAGE, TEXTS // many)), 3, ("key", "text")).select("lang", "key", "text").distinct()
    ordered = Window.partitionBy("lang").orderBy(F.xxhash64(F.lit(4), "key", "text"), "key", "text")
    until = F.sum(F.length("text")).over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    chosen = chosen.withColumns({"place": F.row_number().over(ordered), "until": until}).filter((F.col("place") == 1) | (F.col("until") <= min(12_000_000, CHARACTERS // many)))
    for r in chosen.select("lang", "key", "text").collect():
        texts.setdefault(r["lang"], []).append((r["key"] is None, r["key"] or 0, r["text"]))
    model = train({k: [t for *_, t in sorted(v)] for k, v in texts.items()})
    del texts
    give_back()  # the driver goes on for long
    return model


def identify(docs: DataFrame, model: Model | None, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """docs (without text_col if not keep_text) with lang_pred, score (0 to 1) and rejected.

    Null texts and texts without a letter are `und`, score 0, rejected, as is everything if there is
    no model. Texts are read whole; repeated rows get one result each. Columns of docs by the
    result's names are replaced, others handed through.
    """
    import uuid

    from pyspark.sql import types as T

    names = {"lang_pred", "score", "rejected", "_text", text_col}
    kept = docs.select(*[c for c in docs.columns if c not in names], F.col(text_col).cast("string").alias("_text"))
    if model is None:
        kept = kept.withColumnRenamed("_text", text_col) if keep_text else kept.drop("_text")
        return kept.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0), "rejected": F.lit(True)})
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = [T.StructField(text_col if f.name == "_text" else f.name, f.dataType) for f in kept.schema if f.name != "_text" or keep_text]
    out = T.StructType(fields + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    return kept.mapInArrow(_predict(shared, uuid.uuid4().int, text_col if keep_text else None), out)
