"""Token ids of whole texts, as the tokenizer's own library gives them, with repeated words encoded once.

Where the tokenizer drops white space and treats each run of letters on its own (the vocabulary
word_bpe_49k.json does), a text's ids are those of its pieces in a row. Pieces are cut at blanks
and between a letter and ASCII punctuation, ASCII letters are lowered first, and each distinct
piece goes through the library once a worker. Texts with combining marks or special strings, and
all texts of any other tokenizer, go through the library whole.
"""

from __future__ import annotations

import hashlib
import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import ragged, remembered

MOST_PIECES = 600_000  # of one worker's memory of pieces; it starts anew beyond
JOINED = 64  # words that one call encodes


def encoder(path: str) -> Encoder:
    """This process's encoder for a vocabulary file, kept as long as tasks with remembered(path) follow."""
    return remembered(path, lambda: Encoder(path))


def version(path: str) -> str:
    """A digest of the vocabulary file and the library's version."""
    if path.endswith(".model"):
        import sentencepiece as library
    else:
        import tokenizers as library
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + library.__version__.encode()).hexdigest()


class Encoder:
    def __init__(self, path: str):
        self.path = path
        self.by_piece = False
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.whole = lambda texts: model.encode(texts, num_threads=1)
            return
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.whole = lambda texts: [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.by_piece = self._cuts_at_words(spec)
        if self.by_piece:
            self.special = "|".join(pc_quote(t["content"]) for t in spec.get("added_tokens", []))
            size = max(spec["model"]["vocab"].values()) + 1
            self.ends = np.zeros(size, bool)
            self.ends[[i for t, i in spec["model"]["vocab"].items() if t.endswith("</w>")]] = True
            self._forget()

    @staticmethod
    def _cuts_at_words(spec: dict) -> bool:
        kinds = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        split = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        # fixed value: the pattern that makes letters, single digits and other signs tokens of their own
        words = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
        return kinds == ["NFC", "Replace", "Lowercase"] and split.get("pattern", {}).get("Regex") == words and split.get("invert") is True and spec["model"].get("end_of_word_suffix") == "</w>"

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.store = np.empty(1 << 20, np.int32)
        self.used = 0
        self.starts, self.sizes = np.empty(1 << 16, np.int64), np.empty(1 << 16, np.int64)

    def _learn(self, words: list[str]) -> None:
        plain = [w for w in words if w.isascii() and w.isalpha()]
        model = self.tok.model
        for w in plain:
            self._add(w, [t.id for t in model.tokenize(w)])
        rest = [w for w in words if not (w.isascii() and w.isalpha())]
        letters = [w for w in rest if w.isalpha()]
        odd = [w for w in rest if not w.isalpha()]
        for i in range(0, len(letters), JOINED):
            some = letters[i : i + JOINED]
            ids = np.array(self.tok.encode(" ".join(some), add_special_tokens=False).ids, np.int64)
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != len(some):
                odd += some
                continue
            at = 0
            for w, end in zip(some, ends.tolist()):
                self._add(w, ids[at:end])
                at = end
        for i in range(0, len(odd), 1024):
            for w, ids in zip(odd[i : i + 1024], self.whole(odd[i : i + 1024])):
                self._add(w, ids)

    def _add(self, word: str, ids) -> None:
        n, k = len(self.known), len(ids)
        if n == len(self.starts):
            self.starts, self.sizes = (np.concatenate([a, np.empty_like(a)]) for a in (self.starts, self.sizes))
        while self.used + k > len(self.store):
            self.store = np.concatenate([self.store, np.empty_like(self.store)])
        self.store[self.used : self.used + k] = ids
        self.starts[n], self.sizes[n] = self.used, k
        self.used += k
        self.known[word] = n

    def _pieces(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(number of each piece, offsets of the texts in them)."""
        x = pc.replace_substring_regex(pc.ascii_lower(texts), r"(\pL)([!-&(-/:-@\[-`{-~])", r"\1 \2")
        x = pc.split_pattern(pc.replace_substring(x, "\n", " "), " ")
        if isinstance(x, pa.ChunkedArray):
            x = x.combine_chunks()
        words = x.flatten().dictionary_encode()
        distinct = words.dictionary.to_pylist()
        if len(self.known) > MOST_PIECES:
            self._forget()
        known = self.known
        if missing := [w for w in distinct if w not in known]:
            self._learn(missing)
        number = np.fromiter((known[w] for w in distinct), np.int64, len(distinct))
        offsets = x.offsets.to_numpy().astype(np.int64)
        return number[words.indices.to_numpy()], offsets - offsets[0]

    def _split(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Rows to take by piece, and rows to take whole."""
        if not self.by_piece:
            return np.empty(0, np.int64), np.arange(len(texts))
        whole = pc.match_substring_regex(texts, rf"\pM|{self.special}" if self.special else r"\pM").to_numpy(zero_copy_only=False)
        return np.flatnonzero(~whole), np.flatnonzero(whole)

    def counts(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text."""
        out = np.zeros(len(texts), np.int64)
        cut, whole = self._split(texts)
        if len(cut):
            piece, offsets = self._pieces(texts if len(cut) == len(texts) else texts.take(pa.array(cut)))
            total = np.r_[0, np.cumsum(self.sizes[piece])]
            out[cut] = total[offsets[1:]] - total[offsets[:-1]]
        for i in whole.tolist():
            out[i] = len(self.whole([texts[i].as_py()])[0])
        return out

    def ids(self, texts: pa.Array) -> list[np.ndarray]:
        """Token ids of each text."""
        out: list = [None] * len(texts)
        cut, whole = self._split(texts)
        if len(cut):
            piece, offsets = self._pieces(texts if len(cut) == len(texts) else texts.take(pa.array(cut)))
            sizes = self.sizes[piece]
            flat = self.store[ragged(self.starts[piece], sizes)]
            ends = np.r_[0, np.cumsum(sizes)][offsets].tolist()
            for k, i in enumerate(cut.tolist()):
                out[i] = flat[ends[k] : ends[k + 1]]
        for i in whole.tolist():
            out[i] = np.array(self.whole([texts[i].as_py()])[0], np.int32)
        return out


def pc_quote(text: str) -> str:
    """text as a pattern that matches just it."""
    return "".join(c if c.isalnum() else f"\\{c}" for c in text)
