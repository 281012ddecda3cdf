"""Operators that judge one text at a time: quality, secrets, language, toxicity."""

import itertools
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import language_id, quality, queries, secrets, toxicity

SMALL = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, k0 string, t string, n_words long"


def frame(spark, texts, lang="en"):
    """Rows with extra columns whose names clash with internal ones."""
    return spark.createDataFrame([(i, t, lang, "s", "x", "y", 5) for i, t in enumerate(texts)], SCHEMA)


ODD = [None, "", " \n\t ", "a", "word " * 30000, "..!!", "é\x1fñ z", "same text here", "same text here"]


# ------------------------------------------------------------------ quality


def base_by_hand(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    count = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if count[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)


def test_base_metrics_equal_brute_force():
    r = np.random.default_rng(1)
    texts = [t for t in ODD if t is None or len(t) < 1000] + [" ".join(r.choice(["a", "b", "é|", "c\n", "#d"], r.integers(0, 60))) for _ in range(200)]
    got = quality.base_metrics([None if t is None else t.encode() for t in texts])
    for i, t in enumerate(texts):
        assert tuple(int(got[k][i]) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == base_by_hand(t), t


def field_of(seed):
    f, r = quality.LineField(), np.random.default_rng(seed)
    f.emit[:] = r.normal(size=f.emit.shape)
    f.move[:] = r.normal(size=(2, 2))
    return f


def path_score(f, bits, states):
    x = quality._spread(np.array(bits))
    return sum(float(x[i] @ f.emit[:, s]) for i, s in enumerate(states)) + sum(f.move[a, b] for a, b in zip(states, states[1:]))


def test_viterbi_finds_the_best_of_all_paths():
    r = np.random.default_rng(2)
    sequences = [r.integers(0, 1 << quality.FEATURES, n).tolist() for n in (3, 0, 6, 1, 5)]
    f = field_of(3)
    for bits, states in zip(sequences, f.decode(sequences)):
        if bits:
            best = max(itertools.product((0, 1), repeat=len(bits)), key=lambda s: path_score(f, bits, s))
            assert tuple(states.tolist()) == best


def test_expected_counts_equal_enumeration():
    r = np.random.default_rng(4)
    sequences = [r.integers(0, 1 << quality.FEATURES, n).tolist() for n in (4, 2, 1)]
    f = field_of(5)
    off = np.array([0, 4, 6, 7])
    emit, move = f._expected(quality._spread(np.concatenate(sequences)), off)
    want_e, want_m = np.zeros_like(emit), np.zeros((2, 2))
    for bits in sequences:
        paths = list(itertools.product((0, 1), repeat=len(bits)))
        p = np.exp([path_score(f, bits, s) for s in paths])
        for s, w in zip(paths, p / p.sum()):
            want_e += w * quality._spread(np.array(bits)).T @ np.eye(2)[list(s)]
            for a, b in zip(s, s[1:]):
                want_m[a, b] += w
    assert np.allclose(emit, want_e) and np.allclose(move, want_m)


def test_quality_query_separates_labelled_texts(spark):
    got = queries.op1_quality_crf(spark, SMALL)
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    rows = got.join(labels, "doc_id").select("kept", "quality", "base_failed").collect()
    good = [r.kept for r in rows if r.quality == 1 and not r.base_failed]
    poor = [r.kept for r in rows if r.quality == 0]
    assert np.mean(good) > 0.97 and np.mean(poor) < 0.3
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    for r in got.collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base_by_hand(docs[r.doc_id])
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.kept and r.base_failed)


def test_quality_odd_rows(spark):
    docs = frame(spark, ODD)
    labels = spark.createDataFrame([(0, 1), (3, 0), (None, 1), (4, None)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.judge(docs, quality.fit(docs, labels), ["doc_id"]).collect()}
    assert len(got) == len(ODD) and got[0].n_words == 0 and not got[0].kept and got[4].n_words == 30000
    assert quality.judge(docs.limit(0), quality.LineField(), ["doc_id"]).count() == 0
    lines = quality.label_lines(frame(spark, ["a b\n\nc"]), quality.LineField(), ["doc_id"]).first().lines
    assert [x.line for x in lines] == ["a b", "c"] and all(x.content for x in lines)


# ------------------------------------------------------------------ secrets


def test_forest_tells_generated_findings_apart():
    forest = secrets.train(*secrets.generated_findings(2000, seed=1))
    found, labels = secrets.generated_findings(1000, seed=2)
    p = forest.predict(np.array([secrets.describe(f) for f in found], dtype=float))
    assert ((p >= 0.5) == labels).mean() > 0.95


def test_scan_finds_and_redacts(spark):
    key = "f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda"
    texts = [f'une token = "{key}" elle', "call 4845168114407329 now", f"commit {key} done", None, "", "the password_reset_template_2 page"]
    forest = secrets.train(*secrets.generated_findings())
    rows = secrets.scan(frame(spark, texts), forest, ["doc_id"], "text", "source").orderBy("doc_id").collect()
    assert [r.n_candidates for r in rows] == [1, 1, 1, 0, 0, 1]
    assert [len(r.secrets) for r in rows] == [1, 0, 0, 0, 0, 0]
    s = rows[0].secrets[0]
    assert texts[0].encode()[s.start : s.start + s.length] == key.encode()
    assert secrets.redact(texts[0].encode(), [s.asDict()]) == b'une token = "<SECRET>" elle'
    assert rows[3].redacted_sha256 is None and secrets.scan(frame(spark, ["a"]).limit(0), forest, ["doc_id"]).count() == 0


def test_candidates_equal_brute_force():
    r = np.random.default_rng(3)
    for _ in range(200):
        text = "".join(r.choice(list("ab1 -=\n."), 120)).encode()
        want = [(m.start(), m.group()) for m in re.finditer(rb"[A-Za-z0-9_\-+/=]{16,}", text) if re.search(rb"\d", m.group())]
        assert [(at, f.candidate) for at, f in secrets.candidates(text)] == want


def test_secret_query_at_small_scale(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = queries.op2_secret_forest(spark, SMALL).collect()
    assert len(rows) == len(docs)
    for r in rows:
        want = len(re.findall(r'(?i)token = "[0-9a-f]{40}"|\bAKIA[A-Z0-9]{16}\b', docs[r.doc_id]))
        assert r.n_secrets == want, (r.doc_id, want)


# ----------------------------------------------------------------- language


def test_kneser_ney_is_a_distribution():
    r = np.random.default_rng(1)
    text = "".join(r.choice(list("abc d"), 3000)).encode()
    code, _ = language_id.grams([text])
    u, n = np.unique(code, return_counts=True)
    model = language_id.KneserNey(u, n, 5)
    for ctx in [*(u[:20] >> np.uint64(16)), np.uint64(0x7A007A007A)]:
        seen = np.unique(u & np.uint64(0xFFFF))
        p = np.exp(model.logprob((np.uint64(ctx) << np.uint64(16)) | seen))
        assert (p > 0).all() and p.sum() == pytest.approx(1.0, abs=0.05) and p.sum() <= 1 + 1e-9


def kneser_ney_by_hand(grams, vocabulary, d=0.75):
    """Plain interpolated Kneser-Ney over 4-tuples with counts: a function from 4-tuples to probabilities."""
    levels = {4: dict(grams)}
    for n in (3, 2, 1):
        levels[n] = Counter(g[1:] for g in levels[n + 1])

    def p(g):
        if not g:
            return 1 / (vocabulary + 1)
        counts, ctx = levels[len(g)], g[:-1]
        after = [c for k, c in counts.items() if k[:-1] == ctx]
        if not after:
            return p(g[1:])
        return max(counts.get(g, 0) - d, 0) / sum(after) + d * len(after) / sum(after) * p(g[1:])

    return p


def test_kneser_ney_equals_a_plain_computation():
    r = np.random.default_rng(8)
    texts = ["".join(r.choice(list("abc d"), 60)).encode() for _ in range(6)]
    code, _ = language_id.grams(texts)
    tuples = [tuple(int(c) >> 16 * k & 0xFFFF for k in (3, 2, 1, 0)) for c in code]
    u, n = np.unique(code, return_counts=True)
    model, plain = language_id.KneserNey(u, n, 5), kneser_ney_by_hand(Counter(tuples), 5)
    others = [b"dcba zz", "é a".encode(), b"abcabc"]
    more, off = language_id.grams(others)
    asked = np.concatenate([u, more])
    want = [np.log(plain(tuple(int(c) >> 16 * k & 0xFFFF for k in (3, 2, 1, 0)))) for c in asked]
    assert np.allclose(model.logprob(asked), want, rtol=1e-9)
    ce, chars = language_id.cross_entropies(others, [model])
    lp = np.array(want[len(u) :])
    assert chars.tolist() == np.diff(off).tolist() and np.allclose(ce[:, 0], [-lp[a:b].mean() for a, b in zip(off, off[1:])])


def test_sharded_models_choose_alike(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language_id.fit(docs)
    assert model.shards(1) == [[i] for i in range(len(model.langs))] and len(model.shards(1 << 40)) == 1 and len(model.langs) > 2
    whole = {r.doc_id: r for r in language_id.identify(docs, model, ["doc_id"]).collect()}
    for size in (1, model.models[0].nbytes + model.models[1].nbytes):
        parts = language_id.identify(docs, model, ["doc_id"], shard_bytes=size).collect()
        assert len(parts) == len(whole)
        for r in parts:
            w = whole[r.doc_id]
            assert (r.lang_pred, r.accepted) == (w.lang_pred, w.accepted) and abs(r.score - w.score) < 1e-9
    own = lambda size: sorted(map(tuple, language_id.own_entropies(docs.filter("lang is not null"), model, "text", "lang", size).collect()))
    assert np.allclose([x[1] for x in own(1)], [x[1] for x in own(1 << 40)])


def test_grams_by_hand():
    code, off = language_id.grams([b"Ab1 c", None, b"12", b"d"])
    a, b, c, d = (ord(x) for x in "abcd")
    words = [(0, 0, 0, a), (0, 0, a, b), (0, a, b, 0), (a, b, 0, c), (0, 0, 0, d)]
    assert code.tolist() == [w << 48 | x << 32 | y << 16 | z for w, x, y, z in words] and off.tolist() == [0, 4, 4, 4, 5]


def test_language_query_on_held_out_texts(spark):
    rows = queries.op8_language_id(spark, SMALL).join(spark.read.parquet(f"{SMALL}/documents.parquet"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == 1000 and held and np.mean([r.lang_pred == r.lang for r in held]) > 0.98
    assert np.mean([r.accepted for r in rows]) > 0.99 and all(0 <= r.score <= 1 for r in rows)


def test_language_odd_rows(spark):
    texts = [*ODD, *["the cat and the dog went to the house " * 3] * 40]
    docs = frame(spark, texts).unionByName(frame(spark, ["x"]).withColumn("lang", F.lit(None).cast("string")))
    model = language_id.fit(docs)
    rows = language_id.identify(docs, model, ["doc_id"]).collect()
    assert model.langs == ["en"] and len(rows) == len(texts) + 1
    by = {r.doc_id: r for r in rows if r.doc_id}
    assert by[1].lang_pred == by[2].lang_pred == by[5].lang_pred == "und" and by[7].lang_pred == "en"
    empty = docs.limit(0)
    assert language_id.identify(docs, language_id.fit(empty), ["doc_id"]).filter("lang_pred <> 'und' or accepted").count() == 0
    assert language_id.identify(empty, model, ["doc_id"]).count() == 0


def test_rejects_gibberish(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = language_id.fit(docs)
    noise = "".join(np.random.default_rng(1).choice(list("qxzjkvw pfy"), 800))
    assert model.predict([noise.encode()])[2].tolist() == [False]


# ----------------------------------------------------------------- toxicity


@pytest.fixture(scope="module")
def toxic_model(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    return toxicity.fit(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))


def test_viterbi_decoding_equals_enumeration(toxic_model):
    model = toxic_model.restorer.model

    def worth(path):
        """The whole cost of one way through the lattice, computed word by word."""
        words = "".join(c for c, _ in path).split(toxicity.BREAK)
        total = -sum(cost for _, cost in path)
        for w in words:
            x = "^^" + w + toxicity.END
            total += sum(model.logp(*x[i : i + 3]) for i in range(len(x) - 2)) if w else 0.0
        return total

    for stretch in ("1d1ot", "st00pid", "l0$er", "tra5h", "s h 1 t", "st.u.pid", "s.h.1.t", "ttt7 aa", "a55", "idio7", "x_y--z", "m0r0nnn", "*a* b", "$$a"):
        options = toxicity.lattice(stretch)
        best = max(itertools.product(*options), key=worth)
        made = toxicity.decode(stretch, model)
        assert made == "".join(c for c, _ in best).split()


def test_lattice_by_hand():
    ways = lambda t: [dict(c) for c in toxicity.lattice(t)]
    assert ways("aab") == [{"a": 2.0, "aa": 0.0}, {"b": 0.0}]
    assert ways("aaa") == [{"a": 0.0, "aa": 2.0}]
    assert ways("a1b")[1] == {"i": 1.0, "l": 1.0, " ": 12.0} and ways("a5")[1] == {"s": 1.0, " ": 2.5}
    assert ways("a b")[1] == {"": 0.0, " ": 4.0} and ways("a  b")[1] == {" ": 0.0} and ways("ab-cd")[2] == {"": 4.0, " ": 0.0}


def test_restores_disguised_words(toxic_model):
    restore = toxic_model.restorer.words
    assert restore("you 1d1ot l0ser s t u p i d") == ["you", "idiot", "loser", "stupid"]
    assert restore("ttttrash the end") == ["trash", "the", "end"]
    assert restore("plain words stay") == ["plain", "words", "stay"]
    assert restore("1 d 1 0 t  s t u p i d") == ["idiot", "stupid"] and restore("st.u.pid m-o-r-o-n") == ["stupid", "moron"]
    assert restore("1dio" + "t" * 90 + " *the* end!!! (the) 4 the$$$") == ["idiot", "the", "end", "the", "the"]
    assert toxic_model.restorer.words("a1" * 50_000)  # a long word takes steps linear in its length
    assert restore("") == restore(" ") == []


def test_toxicity_query_on_held_out_texts(spark):
    big = "/root/testdata/sf0.1"
    rows = queries.op9_toxicity(spark, big).join(spark.read.parquet(f"{big}/labels.parquet"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    hit = [r.predicted for r in held if r.toxic == 1]
    false = [r.predicted for r in held if r.toxic == 0]
    # About one label in twenty marks a text without any word that only toxic texts have.
    assert np.mean(hit) >= 0.9 and np.mean(false) < 0.01
    assert all(r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)


def test_toxicity_odd_rows(spark, toxic_model):
    rows = toxicity.score(frame(spark, ODD), toxic_model, ["doc_id"]).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score < 0.5 for r in rows)
    docs = frame(spark, ODD)
    none = spark.createDataFrame([(None, 1), (1, None)], "doc_id long, toxic int")
    untrained = toxicity.fit(docs, none)
    assert {r.score for r in toxicity.score(docs, untrained, ["doc_id"]).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), toxic_model, ["doc_id"]).count() == 0
    assert toxicity.restore(frame(spark, [None, "A b"]), toxic_model, ["doc_id"]).orderBy("doc_id").collect()[1].restored == "a b"
