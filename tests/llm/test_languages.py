"""Language identification over many scripts, languages and copies."""

from __future__ import annotations

import numpy as np

from textlake.llm import langid

from .test_llm import plain_phrases


def words_in(rng, alphabet, n=40):
    return ["".join(rng.choice(list(alphabet), rng.integers(2, 6))) for _ in range(n)]


def texts_in(rng, words, n=30):
    return [" ".join(rng.choice(words, 40)) for _ in range(n)]


def span(first, last):
    return "".join(c for c in map(chr, range(first, last + 1)) if c.isalpha())


SCRIPTS = {"latin": span(97, 122) + span(0xDF, 0xFF), "russian": span(0x430, 0x44F), "greek": span(0x3B1, 0x3C9),
           "hebrew": span(0x5D0, 0x5EA), "arabic": span(0x621, 0x64A), "thai": span(0xE01, 0xE2E),
           "chinese": span(0x4E00, 0x4FFF), "korean": span(0xAC00, 0xADFF)}


def test_all_scripts_are_told_apart(spark):
    rng = np.random.default_rng(2)
    # words are of equal lengths in all scripts, so that letters alone decide
    words = {k: words_in(np.random.default_rng(1), a, 400 if k in ("chinese", "korean") else 40) for k, a in SCRIPTS.items()}
    train = [(k, t) for k, w in words.items() for t in texts_in(rng, w)]
    held = [(k, t) for k, w in words.items() for t in texts_in(rng, w, 5)]
    model = langid.Model(langid.sample(spark.createDataFrame(train, "lang string, text string")))
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(held)], "doc_id int, text string")
    got = langid.identify(docs, model).collect()
    assert {r["doc_id"]: r["lang_pred"] for r in got} == {i: k for i, (k, _) in enumerate(held)}
    assert langid.keep_clear(docs, model, 0.01).count() == len(held)


def test_rare_letters_are_parsed_exactly():
    rng = np.random.default_rng(3)
    alphabet = SCRIPTS["chinese"][:150]
    draw = lambda n: "".join(rng.choice(list(alphabet + "  "), n))
    samples = {"a": [draw(1500)], "b": ["the cat sat on the mat"], "c": [" ".join([draw(60)] * 3)]}
    model = langid.Model(samples)
    assert any(len(a.places) for a in model.automata)
    for text in (draw(300), samples["a"][0][40:300], samples["c"][0][7:90], "the mat " + draw(20)):
        symbols = langid.squeeze(model.symbols(langid.letters()[langid.code_points(text)]))
        rates = model.rates(symbols, np.array([0]), np.array([len(symbols)]))[:, 0]
        for k, lang in enumerate(model.languages):
            stream = langid.squeeze(model.symbols(langid.letters()[langid.code_points(" ".join(samples[lang]))]))
            corpus, shown = ("".join(chr(33 + s) for s in x) for x in (stream, symbols))
            assert round(rates[k] * len(symbols) / model.bits[k]) == plain_phrases(shown, corpus)


def test_copies_do_not_push_a_language_out(spark):
    words = " ".join(f"word{chr(97 + k % 26)}" for k in range(30))
    hot = spark.range(20_000).selectExpr("'a' as lang", f"'{words}' as text")
    few = spark.createDataFrame([("a", f"text number {chr(97 + k)} alone") for k in range(3)] + [("b", "12 !"), ("b", "un texte")], "lang string, text string")
    samples = langid.sample(hot.union(few))
    assert {k: sorted(t) for k, t in samples.items()} == {
        "a": sorted([words, *(f"text number {chr(97 + k)} alone" for k in range(3))]), "b": ["un texte"]}


def test_every_language_is_learned_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(6)
    words = {f"l{k:02}": words_in(rng, span(97, 122)) for k in range(70)}
    rows = [(k, t) for k, w in words.items() for t in texts_in(rng, w, 3)]
    samples = langid.sample(spark.createDataFrame(rows, "lang string, text string"))
    assert sorted(samples) == sorted(words)
    docs = spark.createDataFrame([(i, t, k) for i, (k, t) in enumerate((k, texts_in(rng, w, 1)[0]) for k, w in words.items())] + [(70, "1", "")],
                                 "doc_id int, text string, other string").coalesce(2)
    whole = langid.Model(samples)
    assert len(whole.blocks()) == 1
    want = sorted(langid.identify(docs, whole).collect())
    assert [r["lang_pred"] for r in want] == [*sorted(words), langid.UNKNOWN]
    monkeypatch.setattr(langid, "BLOCK_CHARS", sum(len(t) + 1 for s in samples.values() for t in s) // 3)
    model = langid.Model(samples)
    assert 3 <= len(model.blocks()) <= 4
    assert sorted(langid.identify(docs, model).collect()) == want
    kept = langid.keep_clear(docs, model, 0.01)
    assert kept.columns == docs.columns and kept.count() == 70


def test_the_whole_sample_is_used():
    rng = np.random.default_rng(8)
    text = "".join(rng.choice(list("abcdefgh "), langid.SAMPLE_CHARS * langid.SAMPLE_DOCS))
    model = langid.Model({"a": [text]})
    assert round(2 ** model.bits[0]) - 1 == len(langid.squeeze(model.symbols(langid.letters()[langid.code_points(text)])))
