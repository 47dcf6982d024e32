from __future__ import annotations

import zlib

import numpy as np

from symloom.llm import langid
from symloom.llm.langid import LanguageModel, Predictor, drop_unknown, held_out, identify, sample, subwords, train


def test_held_out_rows_are_not_learned_from(docs, rows):
    texts = {t for t, _ in sample(docs)}
    assert texts
    for doc_id, text, lang, _ in rows:
        if text in texts:
            break
    learned = [r for r in rows if r[1] in texts and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 != 1 and r[2]]
    assert {r[1] for r in learned} == texts
    flags = {r["doc_id"]: r["h"] for r in docs.select("doc_id", held_out(docs["doc_id"]).alias("h")).collect()}
    assert all(flags[d] == (d is None or zlib.crc32(str(d).encode()) % 3 == 1) for d in flags)


def test_query(docs, rows, empty):
    model = train(sample(docs))
    got = identify(docs, model).collect()
    assert len(got) == len(rows)
    want = {r[0]: r[2] for r in rows if r[0] is not None and r[0] < 60}
    hits = [want[r["doc_id"]] == r["lang_pred"] for r in got if r["doc_id"] in want and r["held_out"]]
    assert np.mean(hits) > 0.9
    for r in (r for r in got if r["doc_id"] is not None):
        text = next(x[1] for x in rows if x[0] == r["doc_id"])
        none = text is None or not any(c.isalpha() for c in text)
        assert (r["lang_pred"] == "und") == none and 0 <= r["score"] <= 1 and (not none or r["rejected"])
    assert identify(empty, model).collect() == []
    assert identify(empty, train(sample(empty))).collect() == []
    assert {r["lang_pred"] for r in identify(docs, None).collect()} == {"und"}


def test_only_unknown_text_goes(docs):
    model = train(sample(docs))
    kept = drop_unknown(docs, model)
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert set(range(60)) <= ids and not ids & {90, 91, 92, 96}


def test_predictor_is_the_plain_mean(monkeypatch):
    rng = np.random.default_rng(0)
    model = LanguageModel(["a", "b"], rng.normal(size=(langid.BUCKETS, 2)), np.array([0.1, 0.0]), 0.7, 0.5)
    monkeypatch.setattr(langid, "CACHE", 4)
    own = Predictor(model)
    for text in ["One two three, four's", "five 66 six-seven", "one two", "", None, "12 !!"]:
        ids = [b for w in langid._LETTERS.findall((text or "").lower()) for b in subwords(w)]
        got = own.sums(text)
        assert got[-1] == len(ids) and np.allclose(got[:-1], model.rows[ids].sum(axis=0))
    p = model.chances(np.array([[1.0, 2.0]]), np.array([2]))
    z = np.exp((np.array([0.5, 1.0]) + [0.1, 0.0]) / 0.7)
    assert np.allclose(p[0], z / z.sum())


def test_words_of_whole_texts_are_learned():
    """Texts of 240 words that tell their language only after the first 60."""
    rng = np.random.default_rng(2)
    invented = lambda letters: ["".join(rng.choice(list(letters), 7)) for _ in range(150)]
    same, own = invented("abcdefghijklmnop"), {"aa": invented("zubakmot"), "bb": invented("fyrsengl")}
    texts = [(" ".join([*rng.choice(same, 60), *rng.choice(own[lang], 180)]), lang) for _ in range(40) for lang in own]
    model = train(texts)
    for lang, words in own.items():
        sums = Predictor(model).sums(" ".join(words))
        p = model.chances(sums[None, :-1], sums[None, -1])[0]
        assert p[model.langs.index(lang)] > 0.9


def test_calibration_sees_whole_texts(monkeypatch):
    """Predictions for the held-back rows are what set temperature and threshold."""
    seen, plain = [], LanguageModel.chances
    monkeypatch.setattr(LanguageModel, "chances", lambda self, sums, n: (seen.append(n), plain(self, sums, n))[1])
    train([(" ".join(["house"] * (100 + k)), "en" if k % 2 else "de") for k in range(20)])
    assert seen[-1].tolist() == [len(subwords("house")) * (100 + k) for k in range(4, 20, 5)]


def test_two_languages_can_reject():
    rng = np.random.default_rng(3)
    own = {"aa": ["zubakki", "mozutta", "kebuzzo"], "bb": ["fyrsten", "glyrsk", "dyrfent"]}
    model = train([(" ".join(rng.choice(own[lang], 80)), lang) for _ in range(40) for lang in own])
    one, other = (Predictor(model).sums(" ".join(w)) for w in own.values())
    pure = model.chances(np.array([one[:-1], other[:-1]]), np.array([one[-1], other[-1]])).max(axis=1)
    assert model.threshold > 0.5 and (pure >= model.threshold).all()
    blank = model.chances(-model.bias[None, :] * 10, np.array([10])).max()
    assert blank < model.threshold


def test_training_stays_finite_on_the_given_tables(spark):
    """All languages of a given table, held-out rows; steps must not run away on long texts."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    with np.errstate(all="raise", under="ignore"):
        model = train(sample(docs))
    assert np.isfinite(model.rows).all() and np.isfinite(model.bias).all() and 0 < model.threshold < 1
    rows = identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null and lang_pred <> 'und'").collect()
    hits = [r["lang"] == r["lang_pred"] for r in rows]
    assert len(hits) > 40 and np.mean(hits) > 0.95
    assert np.mean([r["rejected"] for r in rows]) < 0.02


def test_threshold_comes_from_left_out_languages():
    """Languages of their own syllables: known text passes, text of a language that no row has goes."""
    import random

    from symloom.llm import langid as G

    rnd = random.Random(7)
    syllables = {lang: ["".join(rnd.choices(letters, k=2)) for _ in range(25)] for lang, letters in {"a": "aeioklmn", "b": "uyrstgh", "c": "bdfaeipz", "d": "vwxjoqcu", "strange": "ghjklzxc"}.items()}
    word = lambda lang: "".join(rnd.choices(syllables[lang], k=rnd.randint(1, 4)))
    text = lambda lang, n: " ".join(word(lang) for _ in range(n))
    model = G.train([(text(lang, rnd.randint(10, 200)), lang) for _ in range(60) for lang in "abcd"])
    assert 1 / 4 < model.threshold < 1
    predictor = G.Predictor(model)

    def passes(t):
        v = predictor.sums(t)
        return model.chances(v[None, :-1], v[None, -1]).max() >= model.threshold

    known = [passes(text(lang, 12)) for _ in range(100) for lang in "abcd"]
    strange = [passes(text("strange", 60)) for _ in range(100)]
    assert sum(known) >= 0.98 * len(known) and sum(strange) <= 0.75 * len(strange), (sum(known), sum(strange), model.threshold)
