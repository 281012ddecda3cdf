"""Cases in which an operator once did less than its whole job."""

from __future__ import annotations

import numpy as np

import corpus_pipeline
from tessera.llm import language_id, line_dedup, packing, queries, secrets, toxicity


def test_every_copy_of_a_secret_is_redacted():
    key = b"ghp_8fK2mZ0qLw7Rt5Yx9Bv3Nc6Hd1Js4Gp2Qa8"
    text = b'token = "%s" and then token = "%s" x%s %s' % (key, key, key, key)
    found = secrets.candidates(text)
    starts = [i for i in range(len(text)) if text.startswith(key, i)]
    assert [at + f.candidate.index(key) for at, f in found] == starts
    made = [{"start": at, "length": len(f.candidate)} for at, f in found]
    assert key not in secrets.redact(text, made)
    assert [f.before for _, f in found] == [text[max(0, at - 40) : at] for at, _ in found]


def test_shared_lines_go_and_copied_pages_stay(spark):
    shared = [(i, "s", f"own {i}\nshared line" if i < 6 else f"own {i}", 0) for i in range(100)]
    copies = [(100 + i, "s", "copied page", 0) for i in range(20)]
    docs = spark.createDataFrame(shared + copies, "doc_id long, source string, text string, n_chars long")
    assert queries.LINE_RATIO < 0.086  # the least share of the line that all sources of the sf0.1 documents have
    made = {r.doc_id: r.text for r in corpus_pipeline.drop_site_lines(spark, docs, "").collect()}
    assert made == {i: "copied page" if i >= 100 else f"own {i}" for i in range(120)}
    plain = {r.doc_id: r.text for r in line_dedup.drop_boilerplate(docs, "source", "text").collect()}
    assert plain[0] == "own 0" and plain[100] == ""


LANGUAGES = {"en": "the {} house of {} and some {} words of it", "fr": "une {} maison de {} et des {} mots", "zh": "房子{}和一些{}的话{}"}


def spoken(spark, **rows):
    """So many texts of each language."""
    made = [(i, LANGUAGES[one].format(*(chr(97 + i * k % 26) * (1 + i % (k + 4)) for k in (3, 5, 7))), one) for one, n in rows.items() for i in range(n)]
    return spark.createDataFrame([(i, t, one) for i, (_, t, one) in enumerate(made)], "doc_id long, text string, lang string")


def without_room(monkeypatch, f):
    """Any whole number among the defaults of ``f`` becomes 2: a bound on rows or entries shows at once."""
    monkeypatch.setattr(f, "__defaults__", tuple(2 if type(d) is int else d for d in f.__defaults__))


def test_language_models_hold_every_gram(spark, monkeypatch):
    without_room(monkeypatch, language_id.fit)
    docs = spoken(spark, en=60, fr=20, zh=4)
    model = language_id.fit(docs)
    assert model.langs == ["en", "fr", "zh"]
    for one, m in zip(model.langs, model.models):
        texts = [r.text.encode() for r in language_id.train_rows(docs, "doc_id", "lang").filter(f"lang = '{one}'").collect()]
        assert m.keys[-1].tolist() == np.unique(language_id.grams(texts)[0]).tolist()


def test_rejection_limits_cover_every_training_row(spark, monkeypatch):
    without_room(monkeypatch, language_id.fit)
    docs = spoken(spark, en=60, fr=20, zh=4)
    model = language_id.fit(docs)
    for one, m, limit in zip(model.langs, model.models, model.limits):
        texts = [r.text.encode() for r in language_id.train_rows(docs, "doc_id", "lang").filter(f"lang = '{one}'").collect()]
        ce, n = language_id.cross_entropies(texts, [m])
        ce = ce[:, 0]
        mean = np.median(ce)
        per_char, per_doc = np.sqrt(np.median(n * (ce - mean) ** 2) / 0.455) + 0.5, np.median(np.abs(ce - mean)) * 1.5 + 0.05
        k = 1.5 * max(4.0, np.quantile((ce - mean) / np.sqrt(per_char**2 / n + per_doc**2), 0.999))
        assert np.allclose(limit, (mean, k * per_char, k * per_doc), rtol=1e-9)


def test_order_statistics_equal_sorting(spark):
    r = np.random.default_rng(4)
    rows = [("ab"[i % 3 == 0], float(x), 1) for i, x in enumerate(np.concatenate([r.normal(0, 1e-3, 200), r.integers(-2, 3, 100)]))]
    table = spark.createDataFrame(rows, "lang string, ce double, chars long")
    values = {one: sorted(x for lang, x, _ in rows if lang == one) for one in "ab"}
    found = language_id.order_statistics(table, lambda one, ce, n: ce, {one: set(range(0, len(v), 7)) for one, v in values.items()})
    assert found == {one: {i: v[i] for i in range(0, len(v), 7)} for one, v in values.items()}


def test_added_tokens_have_their_ids():
    from tokenizers import Tokenizer

    theirs, ours = Tokenizer.from_file(queries.vocabulary()), packing.Encoder(queries.vocabulary())
    mark = "<|endoftext|>"
    texts = [f"hello {mark} world", mark, mark * 2, f"a{mark}b  {mark}\n c", "none here", "", f" {mark} ", "<|endoftext|"]
    made = [np.frombuffer(x, dtype="<u4").tolist() for x in ours.encode(texts)]
    assert made == [theirs.encode(t, add_special_tokens=False).ids for t in texts]
    assert made[0] == [31373, 220, 50256, 995]


def test_character_model_holds_every_trigram(spark, monkeypatch):
    docs = spoken(spark, en=8, zh=2)
    want = {r.gram: r.n for r in toxicity.count_trigrams(docs, "text").collect()}
    kind, few = type(docs), type(docs).limit
    monkeypatch.setattr(kind, "limit", lambda self, n: few(self, 2 if n >= 1_000_000 else n))
    model = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert len(want) > 2 and model.restorer.model.three == want
