"""Each operator's registered query against a brute-force version on the small tables."""

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from ladderbook.llm import langid, progressive_jpeg, quality, simhash, suffix_dedup
from ladderbook.llm.encoding import Encoder
from ladderbook.llm.gsaca import suffix_order
from ladderbook.llm.html_text import main_text
from ladderbook.llm.packing import sum_of_squares
from ladderbook.llm.queries import ORACLES, QUERIES
from ladderbook.llm.words import Known

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def docs(spark, sf):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}


def brute_removed(texts: dict[int, str], length: int = 100) -> dict[int, tuple]:
    seen, out = set(), {}
    for d in sorted(texts):
        b = texts[d].encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            if w in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(w)
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out[d] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


def test_suffix_dedup(spark, sf, docs):
    rows = QUERIES["op1_suffix_dedup"](spark, sf).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows} == brute_removed(docs)


def test_suffix_dedup_hard_texts(spark, monkeypatch):
    rng = np.random.default_rng(4)
    base = "".join(rng.choice(list("abcdé "), 900))
    texts = {i: base[: 200 + 7 * i] + "".join(rng.choice(list("xyz"), 30)) + base[300 - i :] for i in range(0, 90)}
    texts |= {100: "a" * 700, 101: "ab" * 400, 102: "a" * 99, 103: "a" * 100, 104: base * 3, 105: "", 106: base[5:105], 107: base[5:104]}
    monkeypatch.setattr(suffix_dedup, "WIDE", 3)
    frame = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(5)
    rows = suffix_dedup.suffix_dedup(frame).collect()
    want = brute_removed(texts)
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows} == want
    assert all(hashlib.sha256(bytes(r["kept"])).hexdigest() == r["kept_sha256"] for r in rows)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(1, 3), max_size=25), min_size=1, max_size=5))
def test_suffix_order(lanes):
    texts = [[*x, 0] for x in lanes]
    starts = np.r_[0, np.cumsum([len(x) for x in texts])]
    want = [s + i for s, t in zip(starts, texts) for i in sorted(range(len(t)), key=lambda i: t[i:])]
    assert suffix_order(np.concatenate(texts).astype(np.int64), starts).tolist() == want


def test_packing_and_counts(spark, sf, docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(TOKENIZER)
    ids = {d: e.ids for d, e in zip(docs, tok.encode_batch(list(docs.values()), add_special_tokens=False))}
    counts = QUERIES["op6_token_counts"](spark, sf).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in counts} == {d: (len(docs[d].encode()), len(x), len(x) > 2048) for d, x in ids.items()}
    want = {}
    for d, x in ids.items():
        x = [*x, 1]
        for k in range(0, len(x), 4096):
            part = np.array(x[k : k + 4096], "<u4")
            want[d, k // 4096] = (k, len(part), zlib.crc32(part.tobytes()))
    rows = QUERIES["op2_best_fit_packing"](spark, sf).collect()
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == want and len(rows) == len(want)
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 4096
    assert len(by) <= 1.05 * -(-sum(r["length"] for r in rows) // 4096) + 1


def test_token_cache_is_used(spark, sf, tmp_path):
    from ladderbook.llm.token_counts import read_cache, token_counts

    frame = spark.read.parquet(f"{sf}/documents.parquet").limit(40)
    first = token_counts(frame.limit(20), TOKENIZER, str(tmp_path / "cache")).collect()
    n = read_cache(spark, str(tmp_path / "cache")).count()
    again = token_counts(frame, TOKENIZER, str(tmp_path / "cache")).collect()
    cache = read_cache(spark, str(tmp_path / "cache"))
    assert n == len({r["doc_id"] for r in first}) and cache.count() == cache.select("content").distinct().count() >= n
    assert set(first) <= set(again)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_encoder_equals_library(name):
    tool = Encoder(public_tokenizers.path(name))
    texts = ["", "  ", "don't Can'T <|endoftext|> a<|startoftext|>b", "é.x H̱!", "ΣΑΣ'Σ. İstanbul,x 12,34 a1b2 ß!ẞ", "日本語,テスト。", "x y z\tq\r\nw", "a'S b`c {d} ~e^f", "DE!! EN%%% ***"]
    want = tool.whole(texts)
    assert [x.tolist() for x in map(np.asarray, tool.ids(pa.array(texts)))] == want and tool.counts(pa.array(texts)).tolist() == [len(x) for x in want]


def test_sum_of_squares_fits_everything():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 101, 3000)
    where, offset = sum_of_squares(lengths, 100)
    assert np.bincount(where, lengths).max() <= 100 and where.max() + 1 <= 1.05 * -(-lengths.sum() // 100)
    for s in range(20):
        own = np.flatnonzero(where == s)
        assert offset[own].tolist() == np.r_[0, np.cumsum(lengths[own])[:-1]].tolist()


def brute_print(text: str) -> int:
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64(p.encode(), seed=42).intdigest() for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints: dict[int, int]) -> dict[int, int]:
    ids = sorted(prints)
    root = {d: d for d in ids}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    fp = np.array([prints[d] for d in ids], np.uint64)
    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(fp[i] ^ fp[:i]) <= 3).tolist():
            a, b = find(ids[i]), find(ids[j])
            root[max(a, b)] = min(a, b)
    return {d: find(d) for d in ids}


def test_simhash(spark, sf, docs):
    prints = {d: brute_print(t) for d, t in docs.items()}
    groups = brute_components(prints)
    rows = QUERIES["op7_simhash"](spark, sf).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows} == {d: (f"{prints[d]:016x}", groups[d]) for d in docs}


def test_simhash_large_values_are_split(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HEAP", 20)
    monkeypatch.setattr(simhash, "TILE", 8)
    monkeypatch.setattr(simhash, "SMALL", 4)
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 62, 12, dtype=np.uint64)
    prints = {i: int(base[rng.integers(12)]) ^ sum(1 << int(b) for b in rng.choice(18, rng.integers(0, 6), replace=False)) for i in range(400)}
    distinct = sorted(set(prints.values()))
    frame = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in distinct], "fp bigint")
    tree = {r["node"]: r["root"] for r in simhash.components(simhash.links(frame, len(distinct), 4)).collect()}
    got = {f: tree.get(int(np.uint64(f).astype(np.int64)), int(np.uint64(f).astype(np.int64))) for f in distinct}
    want = brute_components({k: f for k, f in enumerate(distinct)})
    same = {}
    for k, f in enumerate(distinct):
        assert same.setdefault(want[k], got[f]) == got[f]
    assert len(set(got.values())) == len(set(want.values()))


def test_language_id(spark, sf):
    rows = QUERIES["op3_language_id"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert np.mean([r["lang_pred"] == r["lang"] for r in held]) > 0.98 and not any(r["rejected"] for r in rows)


def test_kneser_ney_sums_to_one():
    words = ["abba", "abab", "baa", "a", "bb"]
    parts = langid._one(words, np.array([3, 1, 2, 5, 1]))
    keys, prob, ctx, rest = parts[0]
    assert prob.sum() + rest[0] == pytest.approx(1)
    for keys, prob, ctx, rest in parts[1:]:
        assert ((rest > 0) & (rest <= 1)).all() and prob.sum() + rest.sum() == pytest.approx(len(ctx))


def test_rejection_is_calibrated():
    rng = np.random.default_rng(3)
    texts = {n: ["".join(rng.choice(list(s), 300)) for _ in range(40)] for n, s in (("x", "abcde    "), ("y", "fghij    "))}
    model = langid.train(texts)
    bits, n, _ = langid.measure(pa.array(["edc bad cab", "zzqq wwkk vvpp" * 20]), Known(lambda w: langid.learn(model, w)))
    bound = model.usual + langid.SLACK + langid.SIGMAS * model.spread / np.sqrt(n)[:, None]
    assert bits[0, 0] / n[0] < bound[0, 0] and (bits[1] / n[1] > bound[1]).all()


def test_quality(spark, sf):
    sf = sf.replace("0.001", "0.01")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in QUERIES["op8_quality"](spark, sf).collect() if r["doc_id"] in labels]
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    assert np.mean([r["predicted"] == labels[r["doc_id"]] for r in held]) > 0.95


def test_quality_scores_equal_the_trained_softmax():
    texts = ["good clean words here", "bad *** bad *** bad", "good words", "*** bad"] * 10
    model = quality.train(texts, np.array([1, 0, 1, 0] * 10))
    got = quality.scores(pa.array(["", "good *** words", "bad bad bad"]), model, Known(lambda w: quality._learn(model, w)))
    for text, score in zip(["", "good *** words", "bad bad bad"], got):
        _, bucket, weight = quality._counted(pa.array([text]))
        assert score == pytest.approx(1 / (1 + np.exp(-(model.pull[bucket] @ weight + model.bias))))


def test_media(spark, sf, docs):
    rows = QUERIES["op9_media"](spark, sf).collect()
    for r in rows:
        b = docs[r["doc_id"]].encode()
        n = len(b)
        b += b" " * (max(192, -(-n // 192) * 192) - n)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (n, len(b), hashlib.sha256(b).hexdigest(), zlib.crc32(b[-16:]))
    assert len(rows) == len(docs)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 30), st.integers(0, 3), st.integers(0, 1 << 30)), min_size=1, max_size=4))
def test_jpeg_round_trip(shapes):
    parts = []
    for n, kind, seed in shapes:
        rng = np.random.default_rng(seed)
        n *= 192
        parts.append((rng.integers(0, 256, n) if kind == 0 else np.where(rng.random(n) < 0.9, 128, rng.integers(0, 256, n)) if kind == 1 else rng.integers(126, 131, n) if kind == 2 else np.full(n, 128)).astype(np.uint8))
    files = progressive_jpeg.store(np.concatenate(parts), np.r_[0, np.cumsum([len(p) for p in parts])])
    images = [progressive_jpeg.parse(f) for f in files]
    coef = progressive_jpeg.coefficients(images)
    assert all((a == b).all() for a, b in zip(parts, progressive_jpeg.load(images, coef)))
    for image, rgb in zip(images, progressive_jpeg.tensors(images, coef)):
        block = coef[image.first[0]].astype(float)
        want = np.clip(np.rint(block @ progressive_jpeg.TRANSFORM + 128 + 1e-6), 0, 255)
        blue, red = (np.clip(np.rint(coef[image.first[c]].astype(float) @ progressive_jpeg.TRANSFORM + 128 + 1e-6), 0, 255)[0] - 128 for c in (1, 2))
        assert rgb.shape == (image.height, image.width, 3)
        assert abs(int(rgb[0, 0, 0]) - int(np.clip(np.rint(want[0] + 1.402 * red), 0, 255))) <= 1
        assert abs(int(rgb[0, 0, 2]) - int(np.clip(np.rint(want[0] + 1.772 * blue), 0, 255))) <= 1


def test_end_of_band_runs_and_no_restarts():
    """A grey file of 24 x 8 with one scan of each kind, written bit by bit."""
    j = progressive_jpeg
    dc = j._segment(j.DHT, bytes([0, 0, 3, *[0] * 14, 0, 1, 2]))
    ac = j._segment(j.DHT, bytes([0x10, 0, 4 - 1, *[0] * 14, 0x01, 0x10, 0x00]))
    frame = j._segment(j.SOF2, bytes([8, 0, 8, 0, 24, 1, 1, 0x11, 0]))
    quant = j._segment(j.DQT, bytes([0] + [1] * 64))

    def bits(text):
        text = text.replace(" ", "")
        text += "1" * (-len(text) % 8)
        return int(text, 2).to_bytes(len(text) // 8, "big").replace(b"\xff", b"\xff\0")

    def scan(low, high, approx, body):
        return j._segment(j.SOS, bytes([1, 1, 0, low, high, approx])) + bits(body)

    # codes: dc 0, 1, 2 = 00, 01, 10; ac 0x01 = 00, end of two or three blocks (0x10) = 01, end of block = 10
    first = scan(0, 0, 0x01, "10 11  01 0  00")  # differences 3, -1, 0: 3, 2, 2, shifted by one
    refine = scan(0, 0, 0x10, "1 0 1")
    band = scan(1, 63, 0x01, "00 1 10  01 1")  # 1 << 1 at the first place and an end; then three ended blocks
    again = scan(1, 63, 0x10, "01 0 1")  # an end of two blocks: the one known coefficient takes a bit
    image = j.parse(b"\xff\xd8" + quant + dc + ac + frame + first + refine + band + again + b"\xff\xd9")
    coef = j.coefficients([image])
    assert coef[:, 0].tolist() == [7, 4, 5] and coef[0, 1] == 3 and not coef[:, 2:].any() and not coef[1:, 1].any()


def test_ann_recall(spark, sf):
    rows = QUERIES["op5_ann"](spark, sf).collect()
    data = sorted((r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect())
    ids, x = np.array([d for d, _ in data]), np.array([v for _, v in data], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    found = {}
    for r in rows:
        found.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    hits = 0
    for q in np.flatnonzero(ids % 50 == 0):
        near = x @ x[q]
        near[q] = -2
        got = found[ids[q]]
        assert sorted(got) == [1, 2, 3, 4, 5]
        assert all(s == pytest.approx(near[np.searchsorted(ids, v)], abs=1e-12) for v, s in got.values())
        hits += len({v for v, _ in got.values()} & set(ids[np.argsort(-near)[:5]].tolist()))
    assert hits >= 0.9 * 5 * len(found) and len(found) == (ids % 50 == 0).sum()


def test_html(spark, sf):
    rows = QUERIES["op10_html_text"](spark, sf).collect()
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    import html

    for r in rows:
        article = re.search(r"<article>(.*?)(?:</article>|\Z)", pages[r["page_id"]], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert r["text"] == "\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])
    assert len(rows) == len(pages)


@pytest.mark.parametrize(
    "page,want",
    [
        ("", ""),
        ("just text &amp; more", "just text & more"),
        ("<p>a<p>b c <b>d</b>e", "a\nb c de"),
        ("<html><body class='has-sidebar'><div id=header><h1>Site</h1></div><ul class=menu><li><a href=x>home</a></ul><div id=main><h2>T &lt; x</h2><p>Long  text\nwith <a href=q>link</a> and many, many words to read.<p>Another one that<br>goes on for quite a while.<div class=comments><p>Nice!</div></div><div class=side-bar><a href=1>x</a></div></body>", "T < x\nLong text with link and many, many words to read.\nAnother one that goes on for quite a while."),
        ("<article><p>one</p><form>no<input></form><aside>no</aside><p>two<script>var x='<p>'</script></p></article><div class='cookie-notice'>We use cookies</div>", "one\ntwo"),
        ('<a href="/x>y</a><p>text', None),
    ],
)
def test_html_cases(page, want):
    got = main_text(page)
    assert want is None or got == want


def test_mixing_equals_sql(spark, sf):
    from tests.test_queries import compare

    compare(spark, sf, QUERIES["op4_mixing"], ORACLES["op4_mixing"])
