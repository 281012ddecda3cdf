"""Substring deduplication: parses and sorts by hand, hot keys, and every path beside the usual one."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tessera.llm import repeats, rlz_dedup, suffix_dedup
from tests.llm.test_corpus_operators import frame, random_texts, removed_by_hand


def test_match_lengths_and_greedy_factors_by_hand():
    r = random.Random(7)
    for _ in range(30):
        last, after = r.randint(0, 6), r.randint(1, 7)
        n = r.randint(2, 25)
        groups = np.array([r.randint(0, 2) for _ in range(n)])
        words = np.array([[r.choice([3, 5]) for _ in range(last + after)] for _ in range(n)], dtype=np.uint64)
        starts = np.array([r.randint(0, last) for _ in range(n)])
        ends = np.array([r.randint(last, last + after) for _ in range(n)])
        for i in range(n):  # padding
            words[i, : starts[i]] = words[i, ends[i] :] = 0
        longest = rlz_dedup.match_lengths(groups, words, starts, ends, last)
        text = [tuple(words[i, starts[i] : ends[i]]) for i in range(n)]

        def match(i, o):
            """The longest aligned match of the suffix of row i with another row of the group."""
            best = 0
            for j in range(n):
                if j != i and groups[j] == groups[i] and starts[j] <= last - o:
                    a, b = words[i, last - o : ends[i]], words[j, last - o : ends[j]]
                    k = 0
                    while k < min(len(a), len(b)) and a[k] == b[k]:
                        k += 1
                    best = max(best, k)
            return best

        for i in range(n):
            for o in range(last - starts[i] + 1):
                assert longest[i, o] == match(i, o), (text, i, o)
        parsed = [[] for _ in range(n)]
        for rows, at, size in rlz_dedup.factors(longest, last - starts):
            for row, o, k in zip(rows.tolist(), at.tolist(), size.tolist()):
                parsed[row].append((o, k))
        for i in range(n):
            want, o = [], int(last - starts[i])
            while o >= 0:
                k = match(i, o)
                want.append((o, k))
                o -= max(k, 1)
            assert parsed[i] == want


def test_multikey_quicksort_by_hand():
    r = random.Random(3)
    for n in (0, 1, 2, 300):
        groups = np.array([r.randint(0, 3) for _ in range(n)], dtype=np.int64)
        digits = np.array([[r.choice([1, 2, 9, 2**63]) for _ in range(5)] for _ in range(n)], dtype=np.uint64).reshape(n, 5)
        order, runs = repeats.multikey_order(groups, digits, 3)
        rows = [(groups[i], *digits[i, :3].tolist()) for i in order]
        assert rows == sorted(rows)
        inside = {i for a, b in runs for i in range(a, b)}
        twice = Counter(rows)
        assert inside == {i for i, x in enumerate(rows) if twice[x] > 1}


def hot_texts(word):
    """A passage that half the texts share between words of their own, a shorter one, copies, and one repeated word."""
    r = random.Random(11)
    own = lambda k: [word(r.randrange(4000)) for _ in range(k)]
    passage, short = own(40), own(9)
    texts = [own(r.randint(0, 12)) + passage + own(r.randint(0, 12)) for _ in range(40)]
    texts += [own(r.randint(0, 12)) + short + own(r.randint(5, 12)) for _ in range(40)]
    texts += [own(20)] * 5 + [["w"] * 400, own(3), []]
    return [" ".join(t) for t in texts]


@pytest.mark.parametrize("large", [2, 7, 1000])
@pytest.mark.parametrize("rows", [0, 1_000_000])
def test_hot_keys_equal_brute_force(spark, monkeypatch, large, rows):
    monkeypatch.setattr(repeats, "SMALL", large)
    monkeypatch.setattr(repeats, "LARGE", large)
    monkeypatch.setattr(repeats, "BROADCAST_ROWS", rows)
    monkeypatch.setattr(repeats, "CHUNK", 50)
    texts = hot_texts(lambda i: f"w{i}")
    split = [t.encode().split() for t in texts]
    got = {r.doc_id: r for r in rlz_dedup.remove_repeats(frame(spark, texts), window=12).collect()}
    for i, (w, g) in enumerate(zip(split, removed_by_hand(split, 12))):
        kept = b" ".join(c for c, x in zip(w, g) if not x)
        assert (got[i].n, got[i].n_removed, got[i].kept_sha256) == (len(w), sum(g), hashlib.sha256(kept).hexdigest())


@pytest.mark.parametrize("seed", [1, 2])
def test_hot_bytes_equal_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(repeats, "SMALL", 3)
    monkeypatch.setattr(repeats, "LARGE", 3)
    texts = [*random_texts(seed, alphabet="ab "), *hot_texts(lambda i: f"{i % 50:x}")[::3]]
    raw = [t.encode() for t in texts]
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(frame(spark, texts), window=30).collect()}
    for i, (b, g) in enumerate(zip(raw, removed_by_hand(raw, 30))):
        kept = bytes(c for c, x in zip(b, g) if not x)
        assert (got[i].n_removed, got[i].kept_sha256) == (sum(g), hashlib.sha256(kept).hexdigest())


def test_one_word_many_times(spark):
    texts = ["w " * 20000, "x " * 34, "x " * 35, "x " * 36]
    got = [(r.n, r.n_removed) for r in rlz_dedup.remove_repeats(frame(spark, texts)).orderBy("doc_id").collect()]
    assert got == [(20000, 20000), (34, 0), (35, 35), (36, 36)]
    got = [(r.n, r.n_removed) for r in suffix_dedup.remove_repeats(frame(spark, ["a" * 5000, "b" * 200, "c" * 201])).orderBy("doc_id").collect()]
    assert got == [(5000, 5000), (200, 0), (201, 201)]


def test_queries_give_the_contract_columns(spark):
    from tessera.llm import queries

    assert queries.op10_rlz_dedup(spark, "/root/testdata/sf0.001").columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
