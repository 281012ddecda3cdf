"""Sequence packing by cutting-stock column generation.

Texts become token ids plus a closing id 0 and are cut every ``capacity`` ids; only the remainders need
packing. Their histogram over lengths in units of ``UNIT`` ids, rounded up (at most ``capacity / UNIT``
entries, whatever the corpus size), is the demand of a cutting-stock problem: a linear program over
packing patterns, whose columns are priced by a knapsack dynamic program. Patterns are rounded, what is
left over is packed by best fit, and documents, ranked within their length, take the places of the
patterns in order. A sequence's pieces lie without gaps, so rounding lengths up only costs its end.

Ranks are counted per (length, salt of the row number) so that a length that a third of all documents share
is spread.

Defined cases: null and empty text is the closing id alone; repeated rows are packed each for itself;
rows with a null id are packed too; extra columns are ignored, whatever their names; an empty table gives no
piece; long texts are cut into as many pieces as they need.
"""

from __future__ import annotations

import re
import struct as packed
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm._util import map_text, materialise, struct

CAPACITY = 1024
#: Ids that one step of the length histogram stands for.
UNIT = 4

PIECES = T.ArrayType(struct(start="long", length="long", crc="long"))


#: Fixed value: the pre-token pattern of the byte-level vocabulary.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_alphabet() -> dict[str, int]:
    """The printable characters that stand for bytes in a byte-level vocabulary file."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Encoder:
    """Token ids as little-endian uint32 bytes, through a bounded cache of blank-separated chunks.

    Pre-tokens never reach over a single blank between two other characters, so the chunks between such
    blanks are encoded once each. A text with other uses of blanks is encoded whole. The vocabulary and
    its merges come from the ``tokenizers`` file; byte pairs are merged by ``tiktoken``, which gives the
    same ids at several times the speed (a test compares both). The file's added tokens are cut out of a
    text first, as ``tokenizers`` does, and what lies between them is encoded for itself.
    """

    LIMIT = 300_000

    def __init__(self, path: str):
        import json

        import tiktoken

        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        to_byte = _byte_alphabet()
        added = made.get("added_tokens", [])
        if any(t.get(k) for t in added for k in ("lstrip", "rstrip", "single_word")):
            raise ValueError("added tokens that take in blanks or need word ends are not supported")
        special = {t["content"]: packed.pack("<I", t["id"]) for t in added}
        self.special = special
        self.added = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        ranks = {bytes(to_byte[c] for c in token): i for token, i in made["model"]["vocab"].items() if token not in special}
        self.core = tiktoken.Encoding(f"own-{path}", pat_str=PRE_TOKENS, mergeable_ranks=ranks, special_tokens={})
        self.width = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, i in ranks.items():
            self.width[i] = len(token)
        self.cache: dict[str, bytes | None] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        ids = self.core._core_bpe.encode_ordinary
        return [packed.pack(f"<{len(x)}I", *x) for x in map(ids, texts)]

    def _encode_chunks(self, chunks: list[str]) -> list[bytes]:
        """Ids of every chunk after a blank: encoded in one go and cut where the chunks' bytes end."""
        if not chunks:
            return []
        joined = " " + " ".join(chunks)
        ids = np.array(self.core._core_bpe.encode_ordinary(joined), dtype="<u4")
        ends = np.cumsum([len(c.encode()) + 1 for c in chunks])
        cut = [0, *((np.searchsorted(np.cumsum(self.width[ids]), ends) + 1) * 4).tolist()]
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip(cut, cut[1:])]

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.added:
            return self._encode_plain(texts)
        cut = [self.added.split(t) for t in texts]
        ids = iter(self._encode_plain([x for parts in cut for x in parts[::2]]))
        return [b"".join(self.special[x] if i % 2 else next(ids) for i, x in enumerate(parts)) for parts in cut]

    def _encode_plain(self, texts: list[str]) -> list[bytes]:
        """Ids of texts without added tokens."""
        if len(self.cache) > self.LIMIT:
            self.cache.clear()
        cache = self.cache
        split = [t.split(" ") for t in texts]
        new = set().union(*split).difference(cache)
        plain = []
        for c in new:
            if c and not c[0].isspace() and not c[-1].isspace():
                plain.append(c)
            else:
                cache[c] = None  # a blank beside other white space: not a safe place to cut
        cache.update(zip(plain, self._encode_chunks(plain)))
        heads = list({p[0] for p in split})
        first = dict(zip(heads, self._encode(heads)))
        out: list[bytes] = []
        for t, p in zip(texts, split):
            try:
                if cache[p[0]] is None:
                    raise TypeError
                out.append(first[p[0]] + b"".join(map(cache.__getitem__, p[1:])))
            except TypeError:
                out += self._encode([t])
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per worker process and vocabulary file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def token_pieces(docs: DataFrame, keep: list[str], text_col: str, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """``keep`` plus doc_tokens and pieces (start, length, crc32 of the ids) cut at every ``capacity`` ids."""

    def compute(texts):
        ids = encoder(vocabulary).encode([t.decode("utf-8", "replace") if t else "" for t in texts])
        tokens, pieces = [], []
        for x in ids:
            x += b"\0\0\0\0"
            n = len(x) // 4
            tokens.append(n)
            pieces.append([{"start": s, "length": min(capacity, n - s), "crc": zlib.crc32(x[4 * s : 4 * (s + capacity)])} for s in range(0, n, capacity)])
        return [tokens, pieces]

    return map_text(docs, text_col, keep, struct(doc_tokens="long", pieces=PIECES), compute, finish=lambda: encoder(vocabulary).cache.clear())


# ---------------------------------------------------------------- cutting stock


def knapsack(value: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack by dynamic programming: best value by capacity, and the size taken there (-1: none)."""
    best = np.zeros(capacity + 1)
    took = np.full(capacity + 1, -1, dtype=np.int64)
    upto = np.searchsorted(sizes, np.arange(capacity + 1), "right").tolist()
    for c in range(1, capacity + 1):
        n = upto[c]
        best[c] = best[c - 1]
        if n:
            v = best[c - sizes[:n]] + value[:n]
            k = v.argmax()
            if v[k] > best[c] + 1e-12:
                best[c], took[c] = v[k], k
    return best, took


def _pattern(took: np.ndarray, sizes: np.ndarray, room: int, first: int | None = None) -> np.ndarray:
    counts = np.zeros(len(sizes), dtype=np.int64)
    if first is not None:
        counts[first] += 1
        room -= int(sizes[first])
    while room > 0:
        k = took[room]
        if k < 0:
            room -= 1
        else:
            counts[k] += 1
            room -= int(sizes[k])
    return counts


def _start(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[np.ndarray]:
    """A feasible basis: every size alone, or with the size that fills it up if that has the larger demand."""
    place = {int(s): i for i, s in enumerate(sizes)}
    made = []
    for i, s in enumerate(sizes.tolist()):
        column = np.zeros(len(sizes), dtype=np.int64)
        mate = place.get(capacity - s)
        if mate is not None and mate != i and (demand[i], i) < (demand[mate], mate):
            column[i] = column[mate] = 1
        else:
            column[i] = capacity // s
        made.append(column)
    return made


def _times(matrix: np.ndarray, vector: np.ndarray) -> np.ndarray:
    # Not by BLAS: its threads do not outlive the fork that starts the JVM.
    return (matrix * vector).sum(axis=1)


def _inverse(columns: list[np.ndarray]) -> np.ndarray:
    """Gauss-Jordan elimination with row pivoting."""
    m = len(columns)
    a = np.hstack([np.array(columns, dtype=float).T, np.eye(m)])
    for i in range(m):
        k = i + int(np.abs(a[i:, i]).argmax())
        a[[i, k]] = a[[k, i]]
        a[i] /= a[i, i]
        f = a[:, i].copy()
        f[i] = 0
        a -= f[:, None] * a[i]
    return a[:, m:].copy()


def column_generation(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 400, pivots: int = 3000, gap: float = 5e-4) -> list[tuple[float, np.ndarray]]:
    """(amount, counts per size) of patterns that meet the demand with nearly the least sequences.

    Revised simplex over a basis with explicit inverse. Each round one knapsack prices the columns; of
    every size, the best pattern containing it is a candidate, and candidates enter while they still
    improve. It ends when the dual bound is within half a sequence or the share ``gap``.
    """
    m = len(sizes)
    basis = _start(sizes, demand, capacity)
    inverse = _inverse(basis)
    x = np.maximum(_times(inverse, demand), 0)
    done = 0
    for _ in range(rounds):
        price = inverse.sum(axis=0)  # costs are one per pattern
        best, took = knapsack(np.maximum(price, 0.0), sizes, capacity)
        worth = best[capacity]
        if x.sum() * (1 - 1 / worth) <= max(0.5, gap * x.sum()) or done >= pivots:
            break
        with_each = np.maximum(price, 0) + best[capacity - sizes]
        before = done
        for k in np.argsort(-with_each)[:64].tolist():
            column = _pattern(took, sizes, capacity, k)
            if (price * column).sum() <= 1 + gap:
                continue
            d = _times(inverse, column)
            up = d > 1e-9
            if not up.any():
                continue
            ratio = np.where(up, x / np.where(up, d, 1), np.inf)
            out = int(ratio.argmin())
            theta = ratio[out]
            x = np.maximum(x - theta * d, 0)
            x[out] = theta
            row = inverse[out] / d[out]
            d[out] -= 1
            inverse -= d[:, None] * row
            price = inverse.sum(axis=0)
            basis[out] = column
            done += 1
            if done % 500 == 0:  # keeps rounding errors of the updates small
                inverse = _inverse(basis)
                x = np.maximum(_times(inverse, demand), 0)
                price = inverse.sum(axis=0)
        if done == before:
            break
    return [(float(a), b) for a, b in zip(x, basis) if a > 1e-9]


def best_fit(sizes: np.ndarray, left: np.ndarray, capacity: int) -> list[np.ndarray]:
    """Patterns for what rounding left over: each is filled as far as a bounded knapsack can."""
    left, made = left.copy(), []
    while left.any():
        counts = np.zeros(len(sizes), dtype=np.int64)
        room = capacity
        k = int(np.flatnonzero(left).max())
        while True:
            counts[k] += 1
            left[k] -= 1
            room -= int(sizes[k])
            pick = _fill(sizes, left, room)
            if pick is None:
                break
            for k2 in pick[:-1]:
                counts[k2] += 1
                left[k2] -= 1
                room -= int(sizes[k2])
            k = pick[-1]
        made.append(counts)
    return made


def _fill(sizes: np.ndarray, left: np.ndarray, room: int) -> list[int] | None:
    """One or two remaining sizes that fill ``room`` best; None if none fits."""
    have = np.flatnonzero((left > 0) & (sizes <= room))
    if not len(have):
        return None
    s = sizes[have]
    j = np.searchsorted(s, room - s, "right") - 1  # the largest partner that still fits
    total = s + np.where(j >= 0, s[np.maximum(j, 0)], 0)
    same = (j == np.arange(len(s))) & (left[have] < 2)
    total[same] = s[same]
    a = int(total.argmax())
    if s[-1] >= total[a] or j[a] < 0 or same[a]:
        return [int(have[-1] if s[-1] >= total[a] else have[a])]
    return [int(have[a]), int(have[j[a]])]


def plan(histogram: dict[int, int], capacity: int) -> dict[str, np.ndarray]:
    """The places of all remainders: rows (size, first rank, per pattern, first sequence, slot), by size and rank.

    Rank r of a size within a row's ranks lies in sequence ``first_sequence + (r - first) // per`` at
    the place ``slot + (r - first) % per``. There are at most a few rows per size and pattern.
    """
    sizes = np.array(sorted(s for s, n in histogram.items() if n > 0), dtype=np.int64)
    demand = np.array([histogram[int(s)] for s in sizes], dtype=np.int64)
    patterns: list[tuple[int, np.ndarray]] = []
    if len(sizes):
        left = demand.copy()
        solved = column_generation(sizes, demand.astype(float), capacity)
        for amount, counts in solved:
            used = counts > 0
            n = min(int(amount + 1e-6), int((left[used] // counts[used]).min()))
            if n > 0:
                patterns.append((n, counts))
                left -= n * counts
        # Of the fractions that rounding down left, the largest are rounded up while demand remains.
        for amount, counts in sorted(solved, key=lambda p: -(p[0] % 1)):
            if (left >= counts).all() and int((counts * sizes).sum()) >= 0.99 * capacity:
                patterns.append((1, counts))
                left -= counts
        patterns += [(1, c) for c in best_fit(sizes, left, capacity)]
    rows, sequence, rank = [], 0, np.zeros(len(sizes), dtype=np.int64)
    for n, counts in patterns:
        at = 0
        for k in np.flatnonzero(counts):
            rows.append((int(sizes[k]), int(rank[k]), int(counts[k]), sequence, at))
            rank[k] += n * counts[k]
            at += int(counts[k])
        sequence += n
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
    return {"size": table[:, 0], "rank": table[:, 1], "per": table[:, 2], "sequence": table[:, 3], "slot": table[:, 4], "sequences": sequence}


def _before(w):
    return w.rowsBetween(Window.unboundedPreceding, -1)


def first_ranks(groups: DataFrame, group_salts: int) -> DataFrame:
    """(rest, salt, first, first_whole): rows of the same rest, and whole pieces of all rows, before a group's own.

    Sums run in two levels, over the salts of a range and over ranges, so that no task orders all
    salts: the upper level has a row per rest and ``group_salts`` salts.
    """
    groups = groups.withColumn("range", F.floor(F.col("salt") / group_salts))
    zero = lambda c: F.coalesce(c, F.lit(0))
    upper = groups.groupBy("rest", "range").agg(F.sum("n").alias("n"), F.sum("whole").alias("whole"))
    upper = upper.select("rest", "range", zero(F.sum("n").over(_before(Window.partitionBy("rest").orderBy("range")))).alias("n0"))
    ranges = groups.groupBy("range").agg(F.sum("whole").alias("whole"))
    ranges = ranges.select("range", zero(F.sum("whole").over(_before(Window.orderBy("range")))).alias("w0"))
    inside = groups.select(
        "rest",
        "salt",
        "range",
        zero(F.sum("n").over(_before(Window.partitionBy("rest", "range").orderBy("salt")))).alias("n1"),
        zero(F.sum("whole").over(_before(Window.partitionBy("range").orderBy("salt", "rest")))).alias("w1"),
    )
    return inside.join(upper, ["rest", "range"]).join(ranges, "range").select("rest", "salt", (F.col("n0") + F.col("n1")).alias("first"), (F.col("w0") + F.col("w1")).alias("first_whole"))


def pack(docs: DataFrame, id_col: str, text_col: str, vocabulary: str, capacity: int = CAPACITY, rows_per_salt: int = 4_000, group_salts: int = 1_000) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Whole pieces have sequences of their own, numbered after those of the remainders.
    """
    cut = token_pieces(docs, [id_col], text_col, vocabulary, capacity).select(F.col(f"`{id_col}`").alias("id"), "doc_tokens", "pieces")
    cut = materialise(cut.withColumn("row", F.monotonically_increasing_id()), "pieces")
    total = cut.count()
    salts = max(1, -(-total // rows_per_salt))
    rest = F.ceil(F.col("doc_tokens") % capacity / UNIT).cast("int")
    # Salts come from row numbers, so that rows which agree in all they hold are spread too.
    cut = cut.withColumn("rest", rest).withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(salts))).withColumn("whole", F.floor(F.col("doc_tokens") / capacity))
    groups = cut.groupBy("rest", "salt").agg(F.count(F.lit(1)).alias("n"), F.sum("whole").alias("whole"))
    histogram = {r["rest"]: r["n"] for r in groups.groupBy("rest").agg(F.sum("n").alias("n")).collect() if r["rest"]}  # at most capacity / UNIT rows
    table = plan(histogram, capacity // UNIT)
    firsts = first_ranks(groups, group_salts)
    w = Window.partitionBy("rest", "salt").orderBy("row")
    ranked = cut.withColumn("r", F.row_number().over(w) - 1).withColumn("wr", F.coalesce(F.sum("whole").over(_before(w)), F.lit(0)))
    ranked = ranked.join(firsts, ["rest", "salt"])
    ranked = ranked.select("id", "doc_tokens", "pieces", F.col("rest").cast("long").alias("rest"), (F.col("first") + F.col("r")).alias("rank"), (F.col("first_whole") + F.col("wr")).alias("whole_rank"))
    sent = docs.sparkSession.sparkContext.broadcast(table)
    schema = struct(id=docs.schema[id_col].dataType, start="long", length="long", ids_crc32="long", doc_tokens="long", sequence_id="long", slot="long")

    def place(batches):
        t = sent.value
        key = t["size"] << 40 | t["rank"]
        for b in batches:
            size, rank, whole = (b.column(i).to_numpy(zero_copy_only=False) for i in (3, 4, 5))
            lists = b.column(2)
            n = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten()
            start, length, crc = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            doc = np.repeat(np.arange(len(n)), n)
            row = np.maximum(np.searchsorted(key, size << 40 | rank, "right") - 1, 0)
            if len(key):
                at = rank - t["rank"][row]
                seq, off = t["sequence"][row] + at // t["per"][row], t["slot"][row] + at % t["per"][row]
            else:
                seq, off = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
            last = length < capacity
            sequence = np.where(last, seq[doc], t["sequences"] + whole[doc] + start // capacity)
            cols = [b.column(0).take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(crc), b.column(1).take(pa.array(doc)), pa.array(sequence), pa.array(np.where(last, off[doc], 0))]
            yield pa.RecordBatch.from_arrays(cols, names=schema.fieldNames())

    in_order = _before(Window.partitionBy("sequence_id").orderBy("slot"))  # at most `capacity` rows
    placed = ranked.mapInArrow(place, schema).withColumn("offset", F.coalesce(F.sum("length").over(in_order), F.lit(0)))
    return placed.drop("slot").withColumnRenamed("id", id_col)
