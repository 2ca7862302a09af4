"""Languages whose labelled texts are long, few or without letters."""

import numpy as np
import pyarrow as pa

from ladderbook.llm import langid
from ladderbook.llm.words import Known


def speech(rng, letters: str, chars: int) -> str:
    return "".join(rng.choice(list(letters + "    "), chars))


def test_languages_of_long_texts_are_learned(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(k, "short", speech(rng, "abcde", 400)) for k in range(20)] + [(100 + k, "long", speech(rng, "fghij", 25_000)) for k in range(6)]
    frame = spark.createDataFrame(rows, "doc_id bigint, lang string, text string")
    for bound in (langid.CHARACTERS, 60_000, 10):  # some and one of the long texts
        monkeypatch.setattr(langid, "CHARACTERS", bound)
        model = langid.fit(frame)
        assert model.languages == ["long", "short"]
        fresh = spark.createDataFrame([(1, speech(rng, "fghij", 3000)), (2, speech(rng, "abcde", 3000))], "doc_id bigint, text string")
        got = {r["doc_id"]: (r["lang_pred"], r["rejected"]) for r in langid.identify(fresh, model).collect()}
        assert got == {1: ("long", False), 2: ("short", False)}


def test_held_back_texts_have_letters():
    rng = np.random.default_rng(2)
    texts = [speech(rng, "abcdefgh", 600) for _ in range(24)]
    for n in (24, 3, 1):
        mixed = [x for t in texts[:n] for x in ("12 34", t)]  # without a choice by letters, numbers alone are held back of few
        model = langid.train({"x": ["7"] * 1 + mixed, "y": [speech(rng, "ijklm", 600) for _ in range(24)]})
        bits, chars, _ = langid.measure(pa.array([speech(rng, "abcdefgh", 4000)]), Known(lambda w: langid.learn(model, w)))
        bound = model.usual + langid.SLACK + langid.SIGMAS * model.spread / np.sqrt(chars)[:, None]
        assert bits[0, 0] / chars[0] < bound[0, 0] and model.usual[0] > 2
