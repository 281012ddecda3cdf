"""Benchmark decontamination over a distributed positional inverted index.

The index is a stored table, partitioned like the documents: for every document the postings (term, position) of
the terms that the test items have. A test phrase is found by taking the posting list of its rarest term (by
its count in the whole corpus), moving it by the term's offset in the phrase, and intersecting it with the moved
lists of the other terms in order of rarity, in steps of bounded size. Proximity matches start from the rarest
term too and ask for a span that holds every term as often as the phrase does. No posting leaves its
partition. Test items are sent out in blocks of bounded size; further blocks are further indexes.

Defined cases: null and empty documents have no words and no hit; null, empty and wordless items have
no phrase; repeated items count once per item id; items with a null id are ignored; extra columns are
ignored, whatever their names (a kept one named like a result comes back as ``<name>_in``); empty tables give
empty results or no matches; long documents are indexed whole; repeated rows are judged each for itself.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm._util import beside, doc_offsets, map_text, materialise, struct

#: A-Z become a-z, other ASCII bytes than digits and letters separate words.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

MATCHES = T.ArrayType(struct(phrase="long", start="long", length="long"))
#: Candidates that one intersection step holds, and postings of one lookup (one longer document makes its own).
STEP, LOOKUP = 1 << 19, 1 << 20
#: Bytes of item text in a block. A worker holds some thirty times that as arrays.
BLOCK_BYTES = 8 << 20


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_WORDS).split() if text else []


class Phrases:
    """The windows of a block of items: term ids per window, and the items of each window."""

    def __init__(self, items: list[tuple[str, bytes | None]], size: int, first: int = 0):
        self.size, self.first, self.vocabulary = size, first, {}
        windows: dict[tuple[int, ...], set[int]] = {}
        self.names = sorted({item for item, _ in items})
        place = {name: i for i, name in enumerate(self.names)}
        for item, text in items:
            ids = tuple(self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words_of(text))
            for i in range(max(1, len(ids) - size + 1) if ids else 0):
                windows.setdefault(ids[i : i + size], set()).add(place[item])
        self.terms = np.full((len(windows), size), -1, dtype=np.int32)
        self.length = np.zeros(len(windows), dtype=np.int64)
        for k, w in enumerate(windows):
            self.terms[k, : len(w)] = w
            self.length[k] = len(w)
        # The table from windows to items, once: an occurrence only names its window.
        self.items_at = doc_offsets([len(found) for found in windows.values()])
        self.items = np.fromiter((i for found in windows.values() for i in sorted(found)), np.int32, int(self.items_at[-1]))

    def rank(self, counts: np.ndarray) -> None:
        """Orders the offsets of every window from its rarest term on, and lists windows by that term."""
        n = np.where(self.terms >= 0, counts[np.maximum(self.terms, 0)], np.iinfo(np.int64).max)
        self.order = np.argsort(n, axis=1, kind="stable").astype(np.int16)
        rarest = self.terms[np.arange(len(self.terms)), self.order[:, 0]] if len(self.terms) else np.zeros(0, np.int32)
        self.by_term = np.argsort(rarest, kind="stable")
        self.from_term = np.searchsorted(rarest[self.by_term], np.arange(len(self.vocabulary) + 1))

    def postings(self, texts: list[bytes | None]) -> tuple[np.ndarray, pa.Array, pa.Array]:
        """Words of every text, and per text the terms and positions of its postings, ordered by both."""
        get, counts, made = self.vocabulary.get, [], []
        for t in texts:
            words = words_of(t)
            counts.append(len(words))
            made.append(np.fromiter(map(get, words, repeat(-1)), np.int32, len(words)))
        ids, off = np.concatenate(made) if made else np.zeros(0, np.int32), doc_offsets(counts)
        at = np.flatnonzero(ids >= 0)
        doc = np.searchsorted(off, at, "right") - 1
        by = np.lexsort((ids[at], doc))  # stable: positions stay in order
        n = pa.array(np.searchsorted(doc, np.arange(len(texts) + 1)).astype(np.int32))
        lists = (pa.ListArray.from_arrays(n, pa.array(x.astype(np.int32))) for x in (ids[at][by], (at - off[doc])[by]))
        return np.array(counts, dtype=np.int64), *lists

    def items_of(self, windows: np.ndarray) -> list[str]:
        """The items of windows, each once, in the order of their ids."""
        found = np.unique(np.concatenate([self.items[self.items_at[w] : self.items_at[w + 1]] for w in np.unique(windows).tolist()]))
        return [self.names[i] for i in found.tolist()]


class Lookup:
    """The posting lists of some documents, by term; a place is document * stride + position."""

    def __init__(self, terms: np.ndarray, positions: np.ndarray, off: np.ndarray, margin: int):
        self.stride = int(positions.max(initial=0)) + 2 * margin + 2
        place = np.repeat(np.arange(len(off) - 1), np.diff(off)) * self.stride + positions + margin
        by = np.lexsort((place, terms))
        self.terms, self.places, self.margin = terms[by], place[by], margin
        self.kinds, self.begin = np.unique(self.terms, return_index=True)
        self.end = np.append(self.begin[1:], len(self.terms))
        # One sorted key per posting: the rank of its term among those present, then its place.
        self.shift = max(1, int(self.stride * max(1, len(off))).bit_length())
        self.keys = np.repeat(np.arange(len(self.kinds)), self.end - self.begin) << self.shift | self.places

    def key(self, term: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The key of a posting; one beyond all for terms that no document has."""
        if not len(self.kinds):
            return np.full(np.broadcast(term, place).shape, np.iinfo(np.int64).max)
        rank = np.minimum(np.searchsorted(self.kinds, term), len(self.kinds) - 1)
        return np.where(self.kinds[rank] == term, rank << self.shift | place, np.iinfo(np.int64).max)

    def has(self, term: np.ndarray, place: np.ndarray) -> np.ndarray:
        want = self.key(term, place)
        i = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return self.keys[i] == want

    def count(self, term: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Postings of a term from ``low`` up to before ``high``."""
        return np.searchsorted(self.keys, self.key(term, high)) - np.searchsorted(self.keys, self.key(term, low))

    def candidates(self, phrases: Phrases):
        """(window, place of its rarest term), for all postings of rarest terms, in steps of bounded size."""
        per = np.diff(phrases.from_term)[self.kinds]  # windows of each term that is here
        total = doc_offsets(per * (self.end - self.begin))
        for a in range(0, int(total[-1]), STEP):
            i = np.arange(a, min(a + STEP, int(total[-1])))
            t = np.searchsorted(total, i, "right") - 1
            j = i - total[t]
            yield phrases.by_term[phrases.from_term[self.kinds[t]] + j % per[t]], self.places[self.begin[t] + j // per[t]]

    def exact(self, phrases: Phrases):
        """(window, place of its first word) of every occurrence."""
        for window, place in self.candidates(phrases):
            start = place - phrases.order[window, 0]
            for k in range(1, phrases.size):  # intersect with the next rarest list, moved by its offset
                o = phrases.order[window, k]
                want = phrases.terms[window, o]
                ok = (want < 0) | self.has(want, start + o)
                window, start = window[ok], start[ok]
            yield window, start, phrases.length[window]

    def near(self, phrases: Phrases, slop: int):
        """(window, start, width) of spans of a window's length plus ``slop`` words that hold all its terms as
        often as it does: for every place of its rarest term, the last such span that holds this place."""
        for window, place in self.candidates(phrases):
            for w in np.unique(window).tolist():
                width = int(phrases.length[w]) + slop
                at = place[window == w]
                needs = Counter(phrases.terms[w, : int(phrases.length[w])].tolist())
                for a in range(0, len(at), max(1, STEP // width)):
                    begin = at[a : a + max(1, STEP // width), None] - np.arange(width)
                    ok = np.ones(begin.shape, dtype=bool)
                    for term, n in needs.items():
                        ok &= self.count(np.array(term), begin, begin + width) >= n
                    hit = np.flatnonzero(ok.any(axis=1))
                    starts = np.unique(begin[hit, ok[hit].argmax(axis=1)])
                    yield np.full(len(starts), w), starts, np.full(len(starts), width)


def _blocks(items: DataFrame, id_col: str, text_col: str, size: int, block_bytes: int):
    """Phrases by block. The number of blocks follows the size of the items, so that each is bounded."""
    src = items.filter(F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").cast("string").alias("i"), F.col(f"`{text_col}`").alias("t"))
    total = src.agg(F.sum(F.octet_length("t") + F.octet_length("i"))).first()[0] or 0
    n, first = max(1, -(-int(total) // block_bytes)), 0
    for b in range(n):
        rows = src.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b).collect()
        made = Phrases(sorted({(r.i, r.t.encode() if r.t is not None else None) for r in rows}, key=lambda x: (x[0], x[1] or b"")), size, first)
        first += len(made.length)
        yield made, b == n - 1


def phrase_table(spark: SparkSession, items: DataFrame, item_id: str = "item_id", item_text: str = "text", size: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(phrase, item): the items of every phrase that matches name by number."""
    made = spark.createDataFrame([], "phrase long, item string")
    for ph, _ in _blocks(items, item_id, item_text, size, block_bytes):
        rows = [(ph.first + w, ph.names[i]) for w in range(len(ph.length)) for i in ph.items[ph.items_at[w] : ph.items_at[w + 1]].tolist()]
        made = made.union(spark.createDataFrame(rows, "phrase long, item string"))
    return made


def positional_index(docs: DataFrame, keep: list[str], text_col: str, phrases: Phrases) -> DataFrame:
    """``keep`` plus n_words and the postings of every document: terms and positions, ordered by both; stored."""
    sent = docs.sparkSession.sparkContext.broadcast(phrases)
    return materialise(map_text(docs, text_col, keep, struct(n_words="long", terms="int[]", positions="int[]"), lambda texts: list(sent.value.postings(texts))), "postings")


def _corpus_counts(index: DataFrame, phrases: Phrases) -> np.ndarray:
    """Postings of every term of the block in all documents."""
    size = len(phrases.vocabulary)

    def run(batches):
        n = np.zeros(size, dtype=np.int64)
        for b in batches:
            n += np.bincount(b.column(0).flatten().to_numpy(), minlength=size)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], names=["term", "n"])

    out = np.zeros(size, dtype=np.int64)
    got = index.select("terms").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out[got["term"].to_numpy()] = got["n"].to_numpy()
    return out


def _bounded(batch: pa.RecordBatch, column: int):
    """Slices of a batch with at most LOOKUP postings, where documents allow."""
    off = batch.column(column).offsets.to_numpy()
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(off, off[a] + LOOKUP, "right")) - 1)
        yield batch.slice(a, b - a)
        a = b


def _matched(index: DataFrame, phrases: Phrases, slop: int | None) -> DataFrame:
    """``index`` with matches and items instead of postings."""
    sent = index.sparkSession.sparkContext.broadcast(phrases)
    kept = index.schema.fields[:-2]
    schema = T.StructType([*kept, *struct(matches=MATCHES, items="string[]").fields])
    margin = phrases.size + (slop or 0) + 1

    def run(batches):
        ph, n = sent.value, len(kept)
        for whole in batches:
            for b in _bounded(whole, n):
                terms, positions = b.column(n), b.column(n + 1)
                off = terms.offsets.to_numpy().astype(np.int64)
                look = Lookup(terms.flatten().to_numpy(), positions.flatten().to_numpy().astype(np.int64), off - off[0], margin)
                parts = list(look.exact(ph) if slop is None else look.near(ph, slop)) if len(look.keys) and len(ph.length) else []
                window, start, length = (np.concatenate(x) for x in zip(*parts)) if parts else [np.zeros(0, np.int64)] * 3
                doc = start // look.stride if slop is None else (start + margin) // look.stride
                by = np.lexsort((window, start, doc))
                window, start, length, doc = window[by], start[by], length[by], doc[by]
                at = np.maximum(start - doc * look.stride - margin, 0)
                edges = np.searchsorted(doc, np.arange(b.num_rows + 1))
                fields = [pa.array(x.astype(np.int64)) for x in (window + ph.first, at, length)]
                matches = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.StructArray.from_arrays(fields, names=["phrase", "start", "length"]))
                items = [ph.items_of(window[x:y]) if y > x else [] for x, y in zip(edges[:-1].tolist(), edges[1:].tolist())]
                yield pa.RecordBatch.from_arrays([*b.columns[:n], matches, pa.array(items, pa.list_(pa.string()))], names=schema.fieldNames())

    return index.mapInArrow(run, schema)


def phrase_matches(docs: DataFrame, items: DataFrame, keep: list[str], text_col: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = 10, slop: int | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``keep`` plus n_words, matches (phrase, start, length in words) and the items matched, of every document.

    Exact phrases by default; with ``slop``, matches are spans of a phrase's length and ``slop`` more words that
    hold all its terms, in any order. :func:`phrase_table` tells the items of a phrase.
    """
    names = [f"c{i}" for i in range(len(keep))]
    held = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names)], F.col(f"`{text_col}`").alias("t"))
    seen: list[str] = []
    for phrases, last in _blocks(items, item_id, item_text, size, block_bytes):
        index = positional_index(held, [*names, *seen, *([] if last else ["t"])], "t", phrases)
        phrases.rank(_corpus_counts(index, phrases))
        held = _matched(index, phrases, slop)
        if seen:
            held = held.withColumn("matches", F.concat("m0", "matches")).withColumn("items", F.array_sort(F.array_union("i0", "items"))).drop(*seen)
        if not last:
            held, seen = held.drop("n_words").withColumnsRenamed({"matches": "m0", "items": "i0"}), ["m0", "i0"]
    out = ["n_words", "matches", "items"]
    return held.select(*names, *out).toDF(*beside(keep, out), *out)


def contamination(matches: DataFrame, keep: list[str]) -> DataFrame:
    """Per document of :func:`phrase_matches`: words hit, items found, their digest, and the verdict."""
    src = matches.select(*[f"`{c}`" for c in keep], "n_words", "matches", "items")
    made = struct(n_hit="long", n_items="long", items_sha256="string", contaminated="boolean")
    names = beside(keep, ["n_words", *made.fieldNames()])
    schema = T.StructType([T.StructField(f"c{i}", f.dataType, True) for i, f in enumerate(src.schema.fields[: len(keep) + 1])] + made.fields)

    def run(batches):
        for b in batches:
            n = len(keep)
            spans, items = b.column(n + 1), b.column(n + 2).to_pylist()
            flat, off = spans.flatten(), spans.offsets.to_numpy()
            start, length = (flat.field(f).to_numpy() for f in ("start", "length"))
            hit = []
            for x, y in zip((off[:-1] - off[0]).tolist(), (off[1:] - off[0]).tolist()):
                by = np.argsort(start[x:y], kind="stable")
                s = start[x:y][by]
                reach = np.maximum.accumulate(s + length[x:y][by]) if y > x else s
                hit.append(int((reach - np.maximum(s, np.concatenate(([-1], reach[:-1])))).sum()) if y > x else 0)
            digest = [hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in items]
            cols = [*b.columns[: n + 1], pa.array(hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array(digest), pa.array([h > 0 for h in hit], pa.bool_())]
            yield pa.RecordBatch.from_arrays(cols, names=schema.fieldNames())

    return src.mapInArrow(run, schema).toDF(*names, "n_words", *made.fieldNames())
