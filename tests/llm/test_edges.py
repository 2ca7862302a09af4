"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns; and the pipeline."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from .test_near_copies import brute

from ladderbook.llm import ann, html_text, langid, media, mixing, packing, quality, simhash, suffix_dedup, token_counts

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
LONG = "some words of a long text, " * 12_000
ROWS = [(1, None, None, None), (2, "", "en", "src1"), (3, "short", "en", "src2"), (4, LONG, "en", "src1"), (5, LONG, None, "src1"), (6, "12 34 !!", "de", None), (7, "the same row twice", "de", "x"), (7, "the same row twice", "de", "x"), (None, "no id here", "en", "src3"), (8, "tab\tand\nline é日本", "fr", "src1")]
EXTRA = ["score", "n_bytes", "kept", "media", "rejected", "piece", "_text", "rank", "epoch", "_sa_id"]


@pytest.fixture(scope="module")
def odd(spark):
    frame = spark.createDataFrame(ROWS, "doc_id bigint, text string, lang string, source string").repartition(3)
    return frame.withColumns({c: F.lit("extra") for c in EXTRA if c != "_sa_id"})


@pytest.fixture(scope="module")
def empty(odd):
    return odd.filter("false")


def test_suffix_dedup(odd, empty):
    rows = suffix_dedup.suffix_dedup(odd).collect()
    assert len(rows) == len(ROWS) and suffix_dedup.suffix_dedup(empty).count() == 0
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["n_bytes"] == by[2]["n_bytes"] == by[7]["n_removed"] == 0
    assert by[5]["n_removed"] == len(LONG) and by[5]["n_spans"] == 1 and by[4]["n_removed"] == len(LONG) - 27
    assert by[None]["kept"] == b"no id here" and by[3]["score"] == "extra"


def test_packing(odd, empty):
    rows = packing.pack(odd, TOKENIZER).collect()
    assert packing.pack(empty, TOKENIZER).count() == 0
    assert sorted((r["doc_id"] or 0, r["length"]) for r in rows if r["doc_id"] in (1, 2)) == [(1, 1), (2, 1)]
    assert len([r for r in rows if r["doc_id"] == 7]) == 2 and max(r["length"] for r in rows) == 4096


def test_language_id(odd, empty):
    model = langid.fit(odd)
    rows = {r["doc_id"]: r for r in langid.identify(odd, model).collect()}
    assert [rows[k]["lang_pred"] for k in (1, 2, 6)] == ["und"] * 3 and rows[1]["rejected"] and rows[4]["lang_pred"] in ("en", "de", "fr")
    assert langid.fit(empty) is None and langid.identify(empty, model).count() == 0
    assert {r["lang_pred"] for r in langid.identify(odd, None).collect()} == {"und"}


def test_mixing(odd, empty):
    taken = mixing.mix(odd, F.expr("tokens * 2"), 2, 1, domain=F.lit("d"))
    assert len(taken.collect()) == 2 * len(ROWS)
    assert mixing.mix(empty, F.expr("tokens"), 1).count() == 0
    some = mixing.mix(odd, F.expr("tokens div 2"), 1, 1).agg(F.sum("n_tokens")).first()[0]
    assert (some or 0) <= odd.select(F.sum(F.expr("(coalesce(octet_length(text), 0) + 3) div 4"))).first()[0] / 2


def test_mixing_gives_shortages_to_siblings_first(spark):
    leaves = spark.createDataFrame([("a", "x", "s1", 10), ("a", "x", "s2", 1000), ("a", "y", "s3", 1000), ("b", "x", "s4", 1000)], "domain string, lang string, source string, tokens bigint")
    one = F.lit(1).cast("bigint")
    got = mixing.budgets(leaves.withColumns({"dw": one, "lw": one, "sw": one}), F.lit(800), 1).collect()
    assert {r["source"]: r["budget"] for r in got} == {"s1": 10, "s2": 190, "s3": 200, "s4": 400}


def test_token_counts(odd, empty):
    rows = token_counts.token_counts(odd, TOKENIZER).collect()
    assert len(rows) == len(ROWS) and token_counts.token_counts(empty, TOKENIZER).count() == 0
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["n_tokens"] == by[2]["n_tokens"] == 0 and by[4]["over_limit"] and by[4]["n_tokens"] == by[5]["n_tokens"]


def test_simhash(odd, empty):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == len(ROWS) and simhash.near_duplicates(empty).count() == 0
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["fingerprint"] == by[2]["fingerprint"] == "0" * 16 and by[2]["component_id"] == 1
    assert by[5]["component_id"] == 4 and by[None]["component_id"] is None


def test_quality(odd, empty, spark):
    labels = spark.createDataFrame([(3, 1), (4, 1), (6, 0), (8, 0), (None, 1), (7, None)], "doc_id bigint, quality int")
    model = quality.fit(odd, labels)
    rows = quality.score(odd, model).collect()
    assert len(rows) == len(ROWS) and all(0 <= r["score"] <= 1 for r in rows)
    assert quality.fit(odd, labels.filter("quality = 1")) is None and quality.score(odd, None).first()["score"] == 0.5
    assert quality.score(empty, model).count() == 0 and quality.fit(empty, labels) is None


def test_media(odd, empty):
    rows = media.read_media(media.store_texts(odd)).collect()
    by = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(ROWS) and by[1]["payload_sha256"] == by[2]["payload_sha256"] and by[4]["feature"] == by[5]["feature"]
    assert len(by[3]["tensor"]) == by[3]["width"] * by[3]["height"] * 3
    assert media.read_media(media.store_texts(empty)).count() == 0
    broken = odd.select("doc_id", F.when(F.col("doc_id") > 3, F.col("text").cast("binary")).alias("media"))
    assert all(r["problem"] and r["width"] is None for r in media.read_media(broken).collect())


def test_html(spark):
    pages = spark.createDataFrame([(1, "u", None, "x"), (2, None, "", "x"), (2, None, "", "x"), (None, "u", "<p>a &lt; b", "x"), (4, "u", "<article>" + "<p>word " * 50_000, "x")], "page_id bigint, url string, html string, text string")
    rows = html_text.extract(pages).collect()
    assert sorted((r["n_chars"], r["text"][:5]) for r in rows) == [(0, ""), (0, ""), (0, ""), (5, "a < b"), (249_999, "word\n")]
    assert html_text.extract(pages.filter("false")).count() == 0


def test_ann(spark):
    nan, inf = float("nan"), float("inf")
    same = [(i, [1.0, 0.0]) for i in range(10, 30)]
    rows = [(0, [1.0, 0.1]), (1, None), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, []), (7, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (8, [0.0, 1.0]), (8, [0.0, 1.0]), *same]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("score", F.lit(1))
    got = ann.nearest(frame, F.col("vec_id").isin(0, 1, 12))
    assert {(r["query_id"], r["rank"]): r["vec_id"] for r in got.collect()} == {**{(0, k + 1): 10 + k for k in range(5)}, (12, 1): 10, (12, 2): 11, (12, 3): 13, (12, 4): 14, (12, 5): 15}
    assert ann.nearest(frame.filter("false"), F.lit(True)).count() == 0
    assert [(r["query_id"], r["vec_id"]) for r in ann.nearest(frame.filter("vec_id in (0, 8)"), F.col("vec_id") == 0).collect()] == [(0, 8)]


def test_pipeline(spark, sf):
    import corpus_pipeline as p
    from ladderbook.llm.common import written

    source = spark.read.parquet(f"{sf}/documents.parquet")
    extra = source.limit(3).withColumns({"doc_id": F.col("doc_id") + 100_000})
    docs = source.unionByName(extra).unionByName(source.limit(1)).unionByName(spark.createDataFrame([(None, None, None, None, None), (200_000, "12", "en", "src1", 2)], source.schema))
    sizes = [docs.count()]
    for name, stage in p.STAGES[:-1]:
        out = written(stage(spark, docs, sf), name)
        assert out.columns == source.columns
        before, after = ({(r["doc_id"]): r["text"] for r in x.collect()} for x in (docs, out))
        assert set(after) <= set(before)
        if name != "suffix_array_dedup":
            assert all(before[k] == t for k, t in after.items())
        if name == "language_id":
            assert set(before) - set(after) == {None, 200_000}
        if name == "simhash_near_dedup":
            # the stage's contract is five words and 0.8, not the three words and 3 bits of op7
            groups = brute({r["doc_id"]: r["text"] or "" for r in docs.collect()})
            assert set(after) == set(groups.values()) and out.count() == len(after)
        if name == "suffix_array_dedup":
            assert all(r["n_chars"] == len(r["text"]) for r in out.collect())
            assert {k for k, t in after.items() if t == before[k]} and sum(map(len, after.values())) < sum(map(len, before.values()))
        docs = out
        sizes.append(out.count())
    packed = p.STAGES[-1][1](spark, docs, sf)
    assert {r["doc_id"] for r in packed.collect()} == {r["doc_id"] for r in docs.collect()}
    for name, stage in p.STAGES:
        assert stage(spark, source.filter("false"), sf).count() == 0
