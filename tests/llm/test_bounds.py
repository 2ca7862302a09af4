"""Parameters that bound work change no result, or only as their docstrings say."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ladderbook.llm import ann, html_text, langid, suffix_dedup, token_counts


def repeated(texts: dict[int, bytes], length: int = 100) -> dict[int, int]:
    """Removed bytes of each document, by looking at every window."""
    seen: set[bytes] = set()
    out = {}
    for d in sorted(texts):
        gone = np.zeros(len(texts[d]), bool)
        for i in range(len(texts[d]) - length + 1):
            w = texts[d][i : i + length]
            if w in seen:
                gone[i : i + length] = True
            seen.add(w)
        out[d] = int(gone.sum())
    return out


def test_passages_in_many_documents(spark, monkeypatch):
    rng = np.random.default_rng(3)
    word = lambda n: "".join(chr(97 + c) for c in rng.integers(0, 26, n))
    passage, other = word(150), word(110)
    texts = {d: word(int(rng.integers(20, 160))) + (passage if d % 5 else other) + word(int(rng.integers(20, 160))) for d in range(90)}
    want = repeated({d: t.encode() for d, t in texts.items()})
    frame = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(3)
    for wide, lane, hot in ((64, 256, 1 << 16), (2, 3, 1 << 16), (2, 3, 4)):
        for name, value in (("WIDE", wide), ("LANE", lane), ("HOT", hot)):
            monkeypatch.setattr(suffix_dedup, name, value)
        assert {r["doc_id"]: r["n_removed"] for r in suffix_dedup.suffix_dedup(frame).collect()} == want


@pytest.mark.parametrize("whole", [0, 1 << 30])
def test_three_hundred_languages(whole, monkeypatch):
    monkeypatch.setattr(langid, "WHOLE", whole)
    rng = np.random.default_rng(5)
    words = {f"l{k:03d}": ["".join(chr(97 + c) for c in rng.integers(0, 26, 6)) for _ in range(40)] for k in range(300)}
    texts = {k: [" ".join(rng.choice(w, 30)) for _ in range(10)] for k, w in words.items()}
    model = langid.train(texts)
    import functools

    import pyarrow as pa

    from ladderbook.llm.words import Known

    asks = [(k, " ".join(rng.choice(words[k], 12))) for k in list(words)[::7]]
    bits, n, _ = langid.measure(pa.array([t for _, t in asks]), Known(functools.partial(langid.learn, model)))
    assert [model.languages[b] for b in bits.argmin(1)] == [k for k, _ in asks]


def test_many_languages_share_the_sample(spark, monkeypatch):
    monkeypatch.setattr(langid, "TEXTS", 60)
    rows = [(i, f"l{i % 6}", f"word{i % 6} and text number {i} of l{i % 6}") for i in range(600)]
    assert langid.fit(spark.createDataFrame(rows, "doc_id bigint, lang string, text string")).languages == [f"l{k}" for k in range(6)]


def test_plain_kneser_ney(spark):
    """Cross-entropies against interpolated Kneser-Ney written out with dictionaries."""
    import functools

    import pyarrow as pa

    from ladderbook.llm.words import Known

    texts = ["abra cadabra abracadabra", "barbara abra bar", "cad cab abba"]
    model = langid._build({"x": texts, "y": ["zzz zyx"]})
    words: dict[str, int] = {}
    for t in texts:
        for w in t.split():
            words[w] = words.get(w, 0) + 1
    tables = []
    for n in range(1, langid.ORDER + 1):
        counts: dict[str, set | int] = {}
        real: dict[str, float] = {}
        before: dict[str, set] = {}
        for w, k in words.items():
            s = "^" + w + "$"
            for i in range(max(n - 1, 1), len(s)):
                g = s[i - n + 1 : i + 1]
                if n == langid.ORDER or i == n - 1:
                    real[g] = real.get(g, 0) + k
                else:
                    before.setdefault(g, set()).add(s[i - n])
        counts = {g: real.get(g, 0) + len(before.get(g, ())) for g in {*real, *before}}
        once, twice = (sum(c == m for c in counts.values()) for m in (1, 2))
        discount = once / (once + 2 * twice) if once and twice else 0.5
        total: dict[str, float] = {}
        kept: dict[str, float] = {}
        for g, c in counts.items():
            total[g[:-1]] = total.get(g[:-1], 0) + c
            kept[g[:-1]] = kept.get(g[:-1], 0) + min(discount, c)
        tables.append((counts, discount, total, kept))

    def bits(word: str) -> float:
        s, out = "^" + word + "$", 0.0
        for i in range(1, len(s)):
            p = model.floor
            for n in range(1, langid.ORDER + 1):
                counts, discount, total, kept = tables[n - 1]
                if i < n - 1:
                    continue
                g = s[i - n + 1 : i + 1]
                if g[:-1] in total:
                    p = p * kept[g[:-1]] / total[g[:-1]] + (max(0, counts.get(g, 0) - discount) / total[g[:-1]] if g in counts else 0)
            out -= np.log2(p)
        return out

    asks = ["abra", "barb", "xyz", "cadab"]
    found, _, _ = langid.measure(pa.array(asks), Known(functools.partial(langid.learn, model)))
    assert found[:, 0] == pytest.approx([bits(w) for w in asks])


def test_exact_search(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 12)).astype(np.float32)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in ann.nearest(frame, F.col("vec_id") % 40 == 0, exact=True).collect()}
    y = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    for q in range(0, 400, 40):
        near = y @ y[q]
        near[q] = -2
        assert [got[q, k + 1] for k in range(5)] == np.argsort(-near)[:5].tolist()


def test_a_digest_stored_twice_counts_once(spark, tmp_path):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    frame = spark.createDataFrame([(1, "some words"), (2, "some words"), (3, "others")], "doc_id bigint, text string")
    cache = f"file://{tmp_path}/cache"
    first = sorted(token_counts.token_counts(frame, path, cache).collect())
    spark.read.parquet(cache).write.mode("append").parquet(cache)
    stored = spark.read.parquet(cache).count()
    assert sorted(token_counts.token_counts(frame, path, cache).collect()) == first
    assert stored == 4 and spark.read.parquet(cache).count() == 4  # nothing was encoded again


def test_repairs_are_linear():
    import time

    times = []
    for n in (4_000, 32_000):
        began = time.process_time()
        html_text.main_text("<div><b><div>" + "<span>x" * n + "</b>" * n)
        times.append(time.process_time() - began)
    assert times[1] < 24 * times[0] + 0.5
    assert html_text.main_text("<article><div><p>one <b>two</div><p>three</b></p></article>") == "one two\nthree"
