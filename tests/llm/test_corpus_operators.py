"""Operators that compare texts: repeats, phrases, lines, packing, near-duplicates, the pipeline."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import components, decontaminate, line_dedup, packing, queries, repeats, rlz_dedup, simhash, suffix_dedup

SMALL, TINY = "/root/testdata/sf0.01", "/root/testdata/sf0.001"
ODD = [None, "", " \n\t ", "a", "w " * 20000, "same text of some words here", "same text of some words here"]


def frame(spark, texts):
    rows = [(i, t, "h", "x", 1, 2) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, key string, n long, h long")


def random_texts(seed, n=60, alphabet="ab \n"):
    """Texts with shared passages, copies and self-repeats."""
    r = random.Random(seed)
    make = lambda k: "".join(r.choice(alphabet) for _ in range(k))
    shared = [make(r.randint(10, 80)) for _ in range(6)]
    texts = []
    for _ in range(n):
        t = make(r.randint(0, 50)) + r.choice(["", r.choice(shared), r.choice(shared) + make(9) + r.choice(shared)]) + make(r.randint(0, 50))
        texts.append(t if r.random() < 0.85 or not texts else r.choice(texts))
    return texts


# ------------------------------------------------------------------ repeats


def removed_by_hand(sequences, window):
    seen = Counter(tuple(s[i : i + window]) for s in sequences for i in range(len(s) - window + 1))
    out = []
    for s in sequences:
        gone = [False] * len(s)
        for i in range(len(s) - window + 1):
            if seen[tuple(s[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out.append(gone)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_suffix_dedup_equals_brute_force(spark, seed):
    texts = [*random_texts(seed, alphabet="abé\0 "), *[t for t in ODD if t is None or len(t) < 100]]
    raw = [(t or "").encode() for t in texts]
    gone = removed_by_hand(raw, 24)
    rows = {r.doc_id: r for r in suffix_dedup.remove_repeats(frame(spark, texts), window=24).collect()}
    assert len(rows) == len(texts)
    for i, (b, g) in enumerate(zip(raw, gone)):
        kept = bytes(c for c, x in zip(b, g) if not x)
        runs = sum(x and not (j and g[j - 1]) for j, x in enumerate(g))
        assert (rows[i].n, rows[i].n_removed, rows[i].n_spans, rows[i].kept_sha256) == (len(b), sum(g), runs, hashlib.sha256(kept).hexdigest())


@pytest.mark.parametrize("seed", [4, 5])
def test_rlz_dedup_equals_brute_force(spark, seed):
    texts = [*random_texts(seed, alphabet="ab  \n"), *[t for t in ODD if t is None or len(t) < 100], "x " * 500]
    split = [(t or "").encode().split() for t in texts]
    gone = removed_by_hand(split, 8)
    rows = {r.doc_id: r for r in rlz_dedup.remove_repeats(frame(spark, texts), window=8).collect()}
    for i, (w, g) in enumerate(zip(split, gone)):
        kept = b" ".join(c for c, x in zip(w, g) if not x)
        assert (rows[i].n, rows[i].n_removed, rows[i].kept_sha256) == (len(w), sum(g), hashlib.sha256(kept).hexdigest())


def test_suffix_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{TINY}/documents.parquet").select("doc_id", "text").collect()
    raw = [r.text.encode() for r in docs]
    seen = Counter(b[i : i + 200] for b in raw for i in range(len(b) - 199))
    rows = {r.doc_id: r for r in queries.op3_suffix_dedup(spark, TINY).collect()}
    for d, b in zip(docs, raw):
        edge = np.zeros(len(b) + 1, int)
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                edge[i] += 1
                edge[i + 200] -= 1
        gone = np.cumsum(edge[:-1]) > 0
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        assert (rows[d.doc_id].n_bytes, rows[d.doc_id].n_removed, rows[d.doc_id].kept_sha256) == (len(b), gone.sum(), hashlib.sha256(kept).hexdigest())


def test_deep_shallow_order_sorts(spark):
    r = random.Random(1)
    strings = [bytes(r.choice(b"\0ab") for _ in range(r.randint(0, 40))) + r.choice([b"", b"x" * 70, b"x" * 69 + b"y"]) for _ in range(600)]
    groups = np.array([r.randint(0, 3) for _ in strings])
    rows = np.zeros((len(strings), 112), np.uint8)
    for i, s in enumerate(strings):
        rows[i, : len(s)] = np.frombuffer(s, np.uint8)
    order = suffix_dedup.deep_shallow_order(groups, rows, np.array([len(s) for s in strings]))
    assert [(groups[i], strings[i]) for i in order] == sorted(zip(groups.tolist(), strings))
    assert [strings[i] for i in sorted(range(50), key=lambda i: strings[i])] == [list(dict.fromkeys(strings[:50]))[i] for i in suffix_dedup.BlindTrie(list(dict.fromkeys(strings[:50]))).ordered()] or len(set(strings[:50])) < 50


def test_every_window_has_its_anchor():
    r = np.random.default_rng(1)
    codes = [r.integers(0, 3, n).astype(np.uint64) for n in (0, 5, 30, 200, 31)]
    count, pos, _ = repeats.anchors(codes, 30, 4)
    at = np.split(pos, np.cumsum(count)[:-1])
    for c, p in zip(codes, at):
        for i in range(len(c) - 29):
            assert ((p >= i) & (p <= i + 26)).any()


def test_repeats_of_an_empty_table(spark):
    assert suffix_dedup.remove_repeats(frame(spark, ["a"]).limit(0)).count() == 0


def test_repeats_with_null_and_repeated_ids(spark):
    text = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(None, text), (1, text), (1, text), (None, "short")], "doc_id long, text string")
    rows = rlz_dedup.remove_repeats(docs, window=5).collect()
    assert sorted((r.n, r.n_removed) for r in rows) == [(1, 0), (10, 10), (10, 10), (10, 10)]


# ------------------------------------------------------------------ phrases


def contamination_by_hand(text, items, size=10):
    words = decontaminate.words_of(text.encode() if text else None)
    hit, found = set(), set()
    for item, body in items:
        ws = decontaminate.words_of(body.encode() if body else None)
        for i in range(max(1, len(ws) - size + 1) if ws else 0):
            w = ws[i : i + size]
            for j in range(len(words) - len(w) + 1):
                if words[j : j + len(w)] == w:
                    hit.update(range(j, j + len(w)))
                    found.add(str(item))
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


@pytest.mark.parametrize("block", [1 << 20, 60])
def test_phrases_equal_brute_force(spark, block):
    r = random.Random(3)
    word = lambda: r.choice(["the", "The", "of", "é1", "x", "y2", "Z"])
    items = [(i, " ".join(word() for _ in range(r.choice([0, 2, 5, 14])))) for i in range(12)] + [(50, None), (51, "..."), (0, "of the")]
    texts = [r.choice([", ", " "]).join([*(word() for _ in range(30)), items[r.randrange(12)][1], word()]) for _ in range(30)] + [t for t in ODD if t is None or len(t) < 100]
    frame_items = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.phrase_matches(frame(spark, texts), frame_items, ["doc_id"], size=4, block_bytes=block)
    rows = {x.doc_id: x for x in decontaminate.contamination(found, ["doc_id"]).collect()}
    for i, t in enumerate(texts):
        x = rows[i]
        assert (x.n_words, x.n_hit, x.n_items, x.items_sha256) == contamination_by_hand(t, items, 4) and x.contaminated == (x.n_hit > 0)


def near_by_hand(texts, items, size, slop):
    """Per text, the distinct (start, width, phrase) of spans that hold a phrase's terms, from its rarest term on."""
    split = [decontaminate.words_of(t.encode() if t else None) for t in texts]
    known = {w for _, body in items for w in decontaminate.words_of(body.encode())}
    count = Counter(w for ws in split for w in ws if w in known)
    phrases = set()
    for _, body in items:
        ws = decontaminate.words_of(body.encode())
        phrases |= {tuple(ws[i : i + size]) for i in range(max(1, len(ws) - size + 1) if ws else 0)}
    out = []
    for ws in split:
        found = set()
        for p in phrases:
            rare, width, need = min(p, key=lambda w: (count[w], p.index(w))), len(p) + slop, Counter(p)
            for a in (i for i, w in enumerate(ws) if w == rare):
                for s in range(a, a - width, -1):
                    if not need - Counter(ws[max(0, s) : s + width]):
                        found.add((s, width, p))
                        break
        out.append(sorted((max(0, s), w) for s, w, _ in found))
    return out


@pytest.mark.parametrize("slop", [0, 2, 5])
def test_proximity_equals_brute_force(spark, monkeypatch, slop):
    monkeypatch.setattr(decontaminate, "STEP", 64)
    monkeypatch.setattr(decontaminate, "LOOKUP", 40)
    r = random.Random(slop)
    word = lambda: r.choice("abcdefg")
    items = [(i, " ".join(word() for _ in range(r.choice([1, 2, 3, 5])))) for i in range(6)]
    texts = [" ".join(r.choice([word(), "zz"]) for _ in range(r.randint(0, 25))) for _ in range(25)]
    found = decontaminate.phrase_matches(frame(spark, texts), spark.createDataFrame(items, "item_id long, text string"), ["doc_id"], size=3, slop=slop)
    rows = {x.doc_id: x for x in found.collect()}
    for i, want in enumerate(near_by_hand(texts, items, 3, slop)):
        assert sorted((m.start, m.length) for m in rows[i].matches) == want


def test_proximity_matches(spark):
    items = spark.createDataFrame([(1, "alpha beta gamma"), (2, "x x")], "item_id long, text string")
    docs = frame(spark, ["gamma x beta y alpha", "alpha " + "x " * 9 + "beta gamma", "alpha beta", "x"])
    near = decontaminate.phrase_matches(docs, items, ["doc_id"], size=3, slop=2).orderBy("doc_id").collect()
    assert [r["items"] for r in near] == [["1"], ["2"], [], []]


def test_phrases_in_small_steps_name_their_items(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "STEP", 16)
    monkeypatch.setattr(decontaminate, "LOOKUP", 10)
    items = spark.createDataFrame([(1, "a b c"), (2, "b c d"), (3, "b c")], "item_id long, text string")
    docs = frame(spark, ["x a b c d " * 20, "b c", "c b", None])
    made = decontaminate.phrase_matches(docs, items, ["doc_id"], size=2, block_bytes=4)
    table = {}
    for r in decontaminate.phrase_table(spark, items, size=2, block_bytes=4).collect():
        table.setdefault(r.phrase, set()).add(r.item)
    rows = {r.doc_id: r for r in made.collect()}
    assert rows[1]["items"] == ["1", "2", "3"] and rows[2]["items"] == rows[3]["items"] == []
    hits = {(m.start, i) for m in rows[0].matches for i in table[m.phrase]}
    assert hits == {(5 * k + s, i) for k in range(20) for s, ids in ((1, "1"), (2, "123"), (3, "2")) for i in ids}


def test_phrases_without_items_or_documents(spark):
    docs, items = frame(spark, ["a b"]), spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(decontaminate.phrase_matches(docs, items, ["doc_id"]), ["doc_id"]).first().n_items == 0
    assert decontaminate.phrase_matches(docs.limit(0), items, ["doc_id"]).count() == 0


# -------------------------------------------------------------------- lines


def test_line_dedup_by_hand(spark):
    rows = [(i, "h1", f"menu\nown {i}\n menu \n") for i in range(8)] + [(20, "h2", "menu\nonce"), (21, None, "menu"), (22, "h1", None), (23, "h1", "")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("host", F.lit("x")).withColumn("lines", F.lit(1))
    made = line_dedup.drop_boilerplate(docs, "source", "text", 0.5, 3, report=True)
    assert made.columns == [*docs.columns, "n_lines", "n_dropped"]
    by = {r.doc_id: r for r in made.collect()}
    assert by[3].text == "own 3\n" and (by[3].n_lines, by[3].n_dropped) == (3, 2)
    assert by[20].text == "menu\nonce" and by[21].text == "menu" and by[22].text is None and by[23].text == ""
    assert line_dedup.drop_boilerplate(docs.limit(0), "source", "text").count() == 0


def test_line_dedup_beyond_the_broadcast_bound(spark, monkeypatch):
    docs = spark.read.parquet(f"{TINY}/documents.parquet")
    run = lambda: sorted(map(tuple, line_dedup.drop_boilerplate(docs, "source", "text", 0.3, 2).select("doc_id", "text").collect()))
    want = run()
    monkeypatch.setattr(line_dedup, "BROADCAST_ENTRIES", -1)
    assert run() == want


# ------------------------------------------------------------------ packing


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.vocabulary())
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{TINY}/documents.parquet").collect()}
    rows = queries.op6_packing(spark, TINY).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == set(docs)
    for i, t in docs.items():
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 0]
        at = 0
        for p in sorted(pieces[i], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
    used = 0
    for s in sequences.values():
        at = 0
        for p in sorted(s, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 1024
        used += at
    assert used / (1024 * len(sequences)) > 0.94


def test_encoder_equals_the_tokenizer():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.vocabulary())
    made = packing.Encoder(queries.vocabulary())
    texts = ["", " ", "a  b", " a b ", "it's  \n\n x y z", "tab\t c d", "é1 2é ñ😀 x", "don't we're", "\n a", "a \n b", "x" * 3000, "a b c"]
    texts += [r.text for r in _docs()]
    for t, got in zip(texts, made.encode(texts)):
        assert got == np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), t[:50]


def _docs():
    rel = duckdb.sql(f"select text from '{TINY}/documents.parquet' limit 80").fetchall()

    class Row:
        def __init__(self, t):
            self.text = t

    return [Row(t) for (t,) in rel]


def test_plan_places_everything_once():
    r = random.Random(2)
    for n in (0, 1, 30, 3000):
        h = Counter(min(256, 1 + int(r.expovariate(1 / 60))) for _ in range(n))
        p = packing.plan(h, 256)
        fill = Counter()
        for s, n_ in h.items():
            pick = p["size"] == s
            first, per, seq = p["rank"][pick], p["per"][pick], p["sequence"][pick]
            for rank in range(n_):
                k = int(np.searchsorted(first, rank, "right")) - 1
                fill[int(seq[k] + (rank - first[k]) // per[k])] += s
        assert all(v <= 256 for v in fill.values()) and len(fill) == p["sequences"]
        if n == 3000:
            assert sum(fill.values()) / (256 * len(fill)) > 0.98


def test_packing_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (1, None), (None, ""), (2, "w " * 20000)], "doc_id long, text string")
    rows = packing.pack(docs, "doc_id", "text", queries.vocabulary(), rows_per_salt=1).collect()
    assert sorted(r.doc_tokens for r in rows if r.length < 1024)[:3] == [1, 1, 1]
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows)
    assert packing.pack(docs.limit(0), "doc_id", "text", queries.vocabulary()).count() == 0


# ---------------------------------------------------------- near-duplicates


def fingerprint_by_hand(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def components_by_hand(fp):
    parent = list(range(len(fp)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fp)):
        for j in range(i):
            if bin(fp[i] ^ fp[j]).count("1") <= 2:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [root(i) for i in range(len(fp))]


def test_fingerprints_equal_brute_force():
    texts = [*ODD[:4], "A b", "a B c d e é", "x y z " * 50, *random_texts(1, 40)]
    got = simhash.fingerprints([None if t is None else t.encode() for t in texts])
    assert [int(x) for x in got] == [fingerprint_by_hand(t) for t in texts]


def test_bit_counts_in_steps():
    h = np.random.default_rng(1).integers(0, 1 << 63, 1000, dtype=np.uint64)
    off = np.array([0, 1, 300, 301, 999, 1000])
    bits = np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, 64)
    want = [bits[a:b].sum(axis=0).tolist() for a, b in zip(off, off[1:])]
    for step in (7, 100, 1000):
        assert simhash._bit_counts(h, off, step).tolist() == want


def test_components_of_planted_fingerprints(spark):
    r = random.Random(5)
    fp = [0]
    for _ in range(300):
        x = r.choice(fp) if r.random() < 0.8 else r.getrandbits(64)
        for _ in range(r.choice([0, 1, 2, 2, 3])):
            x ^= 1 << r.choice([r.randrange(64), r.randrange(16)])
        fp.append(x)
    want = components_by_hand(fp)
    table = spark.createDataFrame([(i, x - (1 << 64) if x >> 63 else x) for i, x in enumerate(fp)], "doc_id long, fp long")
    roots = {x.node: x.root for x in components.components(simhash.links(table)).collect()}
    signed = [x - (1 << 64) if x >> 63 else x for x in fp]
    got = [roots.get(x, x) for x in signed]
    for i in range(len(fp)):
        for j in range(i):
            assert (got[i] == got[j]) == (want[i] == want[j])


@pytest.mark.parametrize("tallied,chunk", [(2, 30), (5, 7), (512, 50_000)])
def test_links_within_any_bounds(spark, monkeypatch, tallied, chunk):
    monkeypatch.setattr(simhash, "TALLIED", tallied)
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    r = random.Random(tallied)
    fp = [r.getrandbits(64) for _ in range(6)]
    for _ in range(150):
        x = r.choice(fp)
        for _ in range(r.choice([1, 2, 2, 3])):
            x ^= 1 << r.choice([r.randrange(64), r.randrange(8)])
        fp.append(x)
    want = components_by_hand(fp)
    signed = [x - (1 << 64) if x >> 63 else x for x in fp]
    roots = {x.node: x.root for x in components.components(simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"))).collect()}
    got = [roots.get(x, x) for x in signed]
    assert all((got[i] == got[j]) == (want[i] == want[j]) for i in range(len(fp)) for j in range(i))


def test_tally_by_hand():
    r = random.Random(1)
    a = [r.getrandbits(64) for _ in range(300)]
    b = [x ^ (r.getrandbits(64) & r.getrandbits(64) & r.getrandbits(64) & r.getrandbits(64)) for x in a]
    same, bits = simhash.tally(np.array(a, np.uint64), np.array(b, np.uint64))
    assert bits.tolist() == [bin(x ^ y).count("1") for x, y in zip(a, b)]
    assert same.tolist() == [sum(x >> 8 * k & 255 == y >> 8 * k & 255 for k in range(8)) for x, y in zip(a, b)]


def test_spanning_of_a_full_posting():
    r = np.random.default_rng(1)
    rest = np.unique(r.integers(0, 1 << 16, 300))
    made = simhash.spanning(rest)
    want = components_by_hand([int(x) for x in rest])
    parent = list(range(len(rest)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in made:
        assert bin(int(rest[i] ^ rest[j])).count("1") <= 2
        parent[root(j)] = root(i)
    got = [root(i) for i in range(len(rest))]
    assert len(made) == len(rest) - len(set(got)) and len(set(got)) == len(set(want))


def test_simhash_query_equals_brute_force(spark):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{TINY}/documents.parquet").collect())
    fp = [fingerprint_by_hand(t) for _, t in docs]
    want = components_by_hand(fp)
    rows = {r.doc_id: r for r in queries.op7_simhash(spark, TINY).collect()}
    for k, (i, _) in enumerate(docs):
        assert rows[i].fingerprint == f"{fp[k]:016x}" and rows[i].component_id == docs[want[k]][0]


def test_simhash_odd_rows(spark):
    docs = spark.createDataFrame([(5, None), (3, ""), (3, ""), (None, "a b c d"), (9, "a b c d")], "doc_id long, text string").withColumn("fp", F.lit(1))
    rows = sorted((r.doc_id or 0, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert rows[0][2] == 9 and rows[1] == rows[2] == (3, "0" * 16, 3) and rows[3][2] == 3
    assert sorted(r.doc_id or 0 for r in simhash.keep_representatives(docs).collect()) == [3, 9]  # the row without an id is a copy of 9's
    other = spark.createDataFrame([(1, "a b c d"), (1, "quite another text it is"), (None, None), (2, "a b c d"), (2, "a b c d")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.text or "") for r in simhash.keep_representatives(other).collect()) == [(0, ""), (1, "a b c d"), (1, "quite another text it is")]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


# ------------------------------------------------------- SQL and the pipeline


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{TINY}/{t}.parquet'")
    want = con.sql(queries.SQL[name])
    cols = want.columns
    got = queries.QUERIES[name](spark, TINY).select(*cols).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())


def test_pipeline_stages(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{TINY}/documents.parquet")
    steps = dict(p.STAGES)
    named = steps["language_id"](spark, docs, TINY)
    assert named.columns == docs.columns and named.count() >= 0.99 * docs.count()
    lined = steps["line_dedup"](spark, named, TINY)
    assert lined.columns == docs.columns and lined.count() == named.count()
    alone = steps["simhash_near_dedup"](spark, lined, TINY)
    texts = sorted((r.doc_id, r.text) for r in lined.collect())
    want = components_by_hand([fingerprint_by_hand(t) for _, t in texts])
    assert sorted(r.doc_id for r in alone.collect()) == sorted({texts[k][0] for k in want})
    clean = steps["decontamination"](spark, alone, TINY)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{TINY}/benchmark.parquet").collect()]
    left = {r.doc_id: r.text for r in alone.collect()}
    assert sorted(r.doc_id for r in clean.collect()) == sorted(i for i, t in left.items() if not contamination_by_hand(t, items)[1])
    packed = p.run(spark, TINY)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in clean.collect()}
