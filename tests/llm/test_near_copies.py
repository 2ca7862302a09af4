"""The pipeline's near-copy stage against all pairs of whole five-word sets."""

import numpy as np

import corpus_pipeline
from ladderbook.llm import near_copies


def runs(text: str) -> set:
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) > 5 else {tuple(words)}


def brute(texts: dict[int, str]) -> dict[int, int]:
    sets = {d: runs(t) for d, t in texts.items()}
    root = {d: d for d in texts}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a in texts:
        for b in texts:
            if a >= b or 5 * min(len(sets[a]), len(sets[b])) < 4 * max(len(sets[a]), len(sets[b])):
                continue
            common = len(sets[a] & sets[b])
            if 5 * common >= 4 * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d in texts}


def made() -> dict[int, str]:
    rng = np.random.default_rng(7)
    line = " one line that very many of these documents hold between their own words"
    texts = {}
    for g in range(12):
        base = [f"w{k}" for k in rng.integers(0, 3000, 150)]
        for c in range(8):
            words = list(base)
            for at in rng.choice(150, c, replace=False):
                words[at] = f"x{rng.integers(1 << 30)}"
            texts[len(texts)] = " ".join(words) + (line if g % 2 else "")
    return {**texts, 200: "", 201: " ", 202: "A b c", 203: "a  B c", 204: "a b d"}


def test_all_pairs_of_similar_sets_are_found(spark, monkeypatch):
    texts = made()
    want = brute(texts)
    frame = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(3)
    for tile, heap, meet, rounds in ((512, 4096, 512, 2), (3, 2, 3, 0)):
        for name, value in (("TILE", tile), ("HEAP", heap), ("MEET", meet), ("ROUNDS", rounds)):
            monkeypatch.setattr(near_copies, name, value)
        assert {r["doc_id"]: r["component_id"] for r in near_copies.near_copies(frame).collect()} == want


def test_stage_keeps_one_of_each_group(spark, sf):
    texts = made()
    frame = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in texts.items()], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = corpus_pipeline.near_duplicate_stage(spark, frame, sf).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(set(brute(texts).values()))


def test_stage_decides_by_row(spark, sf):
    rows = [(1, "a text"), (None, "a text"), (None, "another text"), (7, "a third one"), (7, "a text"), (7, "a third one"), (None, None), (None, "")]
    frame = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], "doc_id bigint, text string, _row string, _doc string, n_chars bigint")
    kept = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicate_stage(spark, frame, sf).collect()]
    assert len(kept) == 4 and {(1, "a text"), (None, "another text"), (7, "a third one")} < set(kept)
    assert corpus_pipeline.near_duplicate_stage(spark, frame, sf).columns == frame.columns
