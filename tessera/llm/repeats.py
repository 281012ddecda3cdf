"""Exact windows that occur twice in a corpus, without a row per position.

Shared by the byte and the word form of substring deduplication. Texts are sequences of units (bytes or
words). In each window of ``window`` units the gram of ``gram`` units with the least hash (the last of
equals) is the window's anchor: equal windows have equal anchors at equal places, and about one unit in
``(window - gram) / 2`` is an anchor. A window reaches half its length to the right of its anchor, or
half to the left; so anchors are looked up by two keys, the half window to the right and the half
window to the left, and only anchors that share a key with another can hold repeated windows.

Anchors of one key whose whole neighbourhoods (contexts) are equal share every window there; they are
counted, and one of them stands for all. Only keys with several different contexts are looked into, in
groups of bounded size: two contexts share the window that begins ``o`` units before the anchor if and only
if they agree on ``o`` units to the left and ``window - o`` to the right, which each operator finds by its
own method. Groups beyond the bound are never gathered: there every window of every different context
is hashed and counted by aggregation, which combines before the exchange.

Copies of one text are one text here: a text that occurs twice and has a window is repeated throughout.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm._util import doc_offsets, map_text, materialise, slices, struct

_P = np.uint64(0x9E3779B97F4A7C15)
#: An anchor's place, its keys (null where a half window does not fit) and the hashes of its contexts.
ANCHORS = T.ArrayType(struct(p="int", r="long", rc="long", l="long", lc="long"))
#: Different contexts of one key that are compared in one task: a few times what a task has anyway, between
#: these bounds. Beyond, windows are counted.
SMALL, LARGE, TIMES = 1_000, 16_000, 3
#: Contexts that one comparison holds (always whole groups).
CHUNK = 32_000
#: Row numbers up to which they are broadcast to the texts; beyond, all texts that may hold windows are shuffled.
BROADCAST_ROWS = 1_000_000


@dataclass(frozen=True)
class Units:
    """What a text consists of. ``split`` gives its units; ``code`` turns them into 64-bit numbers (a numpy
    array); ``width`` is the bytes per unit in a context; ``keep`` joins the units that stay; ``compare``
    finds the shared windows of a block of contexts (see :func:`block_ranges`)."""

    split: Callable
    code: Callable
    keep: Callable
    width: int
    window: int
    gram: int
    compare: Callable
    slice_bytes: int = 2 << 20

    @property
    def reach(self) -> int:
        return self.window - self.gram

    @property
    def half(self) -> int:
        return (self.window + 1) // 2

    def side(self, left: bool) -> tuple[int, int, int, int]:
        """(units before, units from the anchor on, least offset, greatest offset) of a key's contexts."""
        w, h = self.window, self.half
        return (self.reach, h - 1, w - h + 1, self.reach) if left else (min(w - h, self.reach), w, 0, min(w - h, self.reach))


def anchors(codes: list[np.ndarray], window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchors per text, positions in the text, hashes) of all texts in a row."""
    sizes = np.array([len(c) for c in codes], dtype=np.int64)
    off = doc_offsets(sizes)
    h = np.concatenate(codes).astype(np.uint64) if len(codes) else np.zeros(0, np.uint64)
    total = len(h)
    if total < window:
        return np.zeros(len(codes), np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = (h + np.uint64(1)) * _P
    span, power = 1, int(_P)
    while span < gram:  # the gram is a power of two: hashes of halves make the hash of the whole
        h = h[:-span] * np.uint64(power) + h[span:]
        h ^= h >> np.uint64(31)
        power = (power * power + 2) & 0xFFFFFFFFFFFFFFFF
        span *= 2
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    low = np.uint64(0xFFFFFFFF)
    least = (h & ~low) | (low - np.arange(len(h), dtype=np.uint64))
    reach, span = window - gram + 1, 1
    while span * 2 <= reach:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if reach > span:
        least = np.minimum(least[: -(reach - span)], least[reach - span :])
    at = (low - (least & low)).astype(np.int64)
    inside = np.zeros(len(at) + 1, dtype=np.int32)
    has = sizes >= window
    np.add.at(inside, off[:-1][has], 1)
    np.add.at(inside, off[1:][has] - window + 1, -1)
    at = at[np.cumsum(inside[:-1]) > 0]
    pos = np.unique(at[np.concatenate(([True], at[1:] != at[:-1]))]) if len(at) else at
    doc = np.searchsorted(off, pos, "right") - 1
    return np.bincount(doc, minlength=len(codes)), pos - off[doc], h[pos]


def keys_of(raw: bytes, n: int, places: list[int], units: Units) -> list[list]:
    """Columns r, rc, l, lc of the anchors of a text of ``n`` units; the last bit of a key is its side."""
    digest, w = xxhash.xxh3_64_intdigest, units.width
    out = []
    for left in (False, True):
        before, after, low, _ = units.side(left)
        keys, contexts = [], []
        for p in places:
            if left:
                key = digest(raw[(p - low) * w : (p + units.gram) * w], 2) if p >= low and units.reach >= low else None
            else:
                key = digest(raw[p * w : (p + units.half) * w], 1) if n - p >= units.half else None
            if key is None:
                keys.append(None)
                contexts.append(None)
                continue
            have = min(p, before)
            keys.append(_signed(key & ~1 | left))
            contexts.append(_signed(digest(raw[(p - have) * w : (p + after) * w], have)))
        out += [keys, contexts]
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def multikey_order(groups: np.ndarray, words: np.ndarray, depth: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Order of rows of 64-bit digits by (group, digits up to ``depth``) and the runs still undecided.

    Multikey quicksort, all segments stepping together: each open segment takes the digit of its middle row
    as pivot and is parted into less, equal and greater; the equal part goes on to the next digit.
    """
    order = np.argsort(groups, kind="stable")
    n = len(order)
    seg = np.concatenate(([0], np.cumsum(groups[order][1:] != groups[order][:-1]))) if n else order
    digit = np.zeros(n, dtype=np.int64)
    while n:
        size = np.bincount(seg)
        at = np.flatnonzero((size[seg] > 1) & (digit < depth))
        if not len(at):
            break
        rows, own = order[at], seg[at]
        value = words[rows, digit[at]]
        first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        length = np.diff(np.append(first, len(own)))
        pivot = np.repeat(value[first + length // 2], length)
        part = (value >= pivot).astype(np.int64) + (value > pivot)
        by = np.argsort(own * 3 + part, kind="stable")
        order[at], part = rows[by], part[by]
        digit[at] += part == 1  # segments keep their places, so parts take their digits along
        split = np.zeros(n, dtype=np.int64)
        split[1:] = seg[1:] != seg[:-1]
        inner = np.flatnonzero((own[1:] == own[:-1]) & (part[1:] != part[:-1])) + 1
        split[at[inner]] = 1
        seg = np.cumsum(split)
    starts = np.flatnonzero(np.concatenate(([True], seg[1:] != seg[:-1]))) if n else seg
    ends = np.append(starts[1:], n)
    return order, [(a, b) for a, b in zip(starts.tolist(), ends.tolist()) if b - a > 1]


def settle(order: np.ndarray, runs: list[tuple[int, int]], lengths: np.ndarray) -> np.ndarray:
    """Equal rows, undecided to the end, go by length: padding does not count as agreement."""
    for a, b in runs:
        part = order[a:b]
        order[a:b] = part[np.argsort(lengths[part], kind="stable")]
    return order


def common(order: np.ndarray, groups: np.ndarray, rows: np.ndarray, lengths: np.ndarray, width: int) -> np.ndarray:
    """Units in common with the row before in the order; -1 for the first of a group."""
    out = np.full(len(order), -1, dtype=np.int64)
    for a in range(1, len(order), 1 << 14):
        i, j = order[a - 1 : a - 1 + (1 << 14)], order[a : a + (1 << 14)]
        i = i[: len(j)]
        differ = rows[i] != rows[j]
        n = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1]) // width
        n = np.minimum(n, np.minimum(lengths[i], lengths[j]))
        out[a : a + len(j)] = np.where(groups[i] == groups[j], n, -1)
    return out


def _matrix(column: pa.Array, width: int, cells: int, reverse: bool) -> tuple[np.ndarray, np.ndarray]:
    """Padded rows of bytes (units in reverse order on request) and the units of each."""
    column = column.cast(pa.large_binary())
    off = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    n = np.diff(off)
    out = np.zeros((len(column), cells), dtype=np.uint8)
    if len(n):
        cell = np.arange(cells)
        out[(cell >= cells - n[:, None]) if reverse else (cell < n[:, None])] = raw[off[0] : off[-1]]
    if reverse:
        out = np.ascontiguousarray(out.reshape(len(out), -1, width)[:, ::-1]).reshape(out.shape)
    return out, n // width


def block_ranges(key: np.ndarray, left: pa.Array, right: pa.Array, units: Units) -> tuple[np.ndarray, np.ndarray]:
    """Per context, the least and the greatest offset whose window another context of its key shares (-1: none).

    All windows hold the anchor, so the repeated ones make one span.
    """
    low, high = np.full(len(key), -1, dtype=np.int64), np.full(len(key), -1, dtype=np.int64)
    for side in (False, True):
        pick = np.flatnonzero((key & 1) == side)
        if len(pick) < 2:
            continue
        before, after, first, last = units.side(side)
        rows = pa.array(pick)
        ls, nl = _matrix(left.take(rows), units.width, -(-before * units.width // 8) * 8, True)
        rs, nr = _matrix(right.take(rows), units.width, -(-after * units.width // 8) * 8, False)
        low[pick], high[pick] = units.compare(key[pick], (ls, nl), (rs, nr), units.window, first, last)
    return low, high


def repeated_spans(docs: DataFrame, id_col: str, text_col: str, units: Units) -> DataFrame:
    """One row per document: id, n (units), n_removed, n_spans, kept_sha256.

    Removed are all units covered by a window that starts anywhere else too.
    """
    scanned = materialise(_scanned(docs, id_col, text_col, units).withColumn("row", F.monotonically_increasing_id()), "anchors")
    copies = scanned.groupBy("key").agg(F.count(F.lit(1)).alias("copies"), F.min("row").alias("first")).filter("copies > 1")
    copies = materialise(scanned.select("key", "row", "n").join(materialise(copies, "copies"), "key").select("row", (F.col("row") != F.col("first")).alias("again"), (F.col("n") >= units.window).alias("whole")), "copied")
    again = copies.filter("again").select("row")

    single = scanned.select("row", "a").join(_sent(again, again.count()), "row", "left_anti").select("row", F.explode("a").alias("a"))
    sides = F.array(F.struct(F.col("a.r").alias("k"), F.col("a.rc").alias("c")), F.struct(F.col("a.l").alias("k"), F.col("a.lc").alias("c")))
    each = single.select("row", "a.p", F.explode(sides).alias("s")).select("row", "p", "s.k", "s.c").filter("k is not null")
    twice = materialise(each.groupBy("k").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("k"), "keys")
    places = materialise(each.join(twice, "k"), "places")

    # One anchor stands for all that agree with it in key and context.
    of = materialise(places.groupBy("k", "c").agg(F.first("row").alias("row"), F.first("p").alias("p"), F.count(F.lit(1)).alias("m")), "contexts")
    several = materialise(of.groupBy("k").agg(F.count(F.lit(1)).alias("d")).filter("d > 1"), "several")
    todo = materialise(of.join(several, "k"), "todo")
    total, largest = todo.agg(F.count(F.lit(1)), F.max("d")).first()
    large = min(LARGE, max(SMALL, TIMES * total // int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    found = [of.filter("m > 1").select("k", "c", *_whole(units))]
    if total:
        found.append(_compared(_contexts(scanned, todo.filter(F.col("d") <= large), units), units))
        if largest > large:
            found.append(_counted(_windows(scanned, todo.filter(F.col("d") > large), units)))
    ranges = found[0]
    for other in found[1:]:
        ranges = ranges.union(other)
    ranges = materialise(ranges.groupBy("k", "c").agg(F.min("low").alias("low"), F.max("high").alias("high")), "ranges")

    spans = places.join(ranges, ["k", "c"]).groupBy("row").agg(F.collect_list(F.struct("p", "low", "high")).alias("spans"))
    whole = copies.filter("whole").select("row", F.lit(True).alias("whole"))
    held = _met(scanned.select("row", "n", "z"), spans.join(whole, "row", "left_anti"))

    def cut(batches):
        for batch in _small(batches, 2, units):
            made = [_cut(units, t, n, s) for n, t, s in zip(batch.column(1).to_pylist(), _expand(batch.column(2)), batch.column(3))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in zip(*made))], names=["row", "n_removed", "n_spans", "kept"])

    partial = materialise(held.mapInArrow(cut, "row long, n_removed long, n_spans long, kept string"), "cut")
    made = scanned.select("row", "id", "n", "sha").join(partial, "row", "left").join(whole, "row", "left")
    return made.select(
        F.col("id").alias(id_col),
        "n",
        F.when(F.col("whole"), F.col("n")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("whole"), F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(F.col("whole"), F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
    )


def _sent(rows: DataFrame, entries: int) -> DataFrame:
    """``rows`` to join with, broadcast where they are few."""
    return F.broadcast(rows) if entries <= BROADCAST_ROWS else rows


def _met(texts: DataFrame, lists: DataFrame) -> DataFrame:
    """``texts`` joined with what is known of some rows; only those rows' texts are shuffled, where they are few."""
    lists = materialise(lists, "lists")
    return texts.join(_sent(lists.select("row"), lists.count()), "row", "left_semi").join(lists, "row")


def _whole(units: Units) -> list:
    """All offsets of a key's side; a text's ends bound them where they are applied."""
    left = F.col("k").bitwiseAND(F.lit(1)) == 1
    (_, _, a, b), (_, _, c, d) = units.side(False), units.side(True)
    return [F.when(left, c).otherwise(a).cast("long").alias("low"), F.when(left, d).otherwise(b).cast("long").alias("high")]


def _scanned(docs: DataFrame, id_col: str, text_col: str, units: Units) -> DataFrame:
    """id, the text's digest, n, sha (of all units), z (the text, compressed, where a window fits) and its anchors."""
    src = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("t")).withColumn("key", F.unhex(F.md5("t")))

    def scan(texts):
        split = [units.split(t or b"") for t in texts]
        codes = [units.code(s) for s in split]
        count, pos, _ = anchors(codes, units.window, units.gram)
        off = doc_offsets(count)
        columns: list[list] = [[], [], [], []]
        for i in np.flatnonzero(count).tolist():
            for column, values in zip(columns, keys_of(_raw(split[i], codes[i], units), len(split[i]), pos[off[i] : off[i + 1]].tolist(), units)):
                column += values
        fields = [pa.array(pos.astype(np.int32)), *(pa.array(c, pa.int64()) for c in columns)]
        made = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.StructArray.from_arrays(fields, names=["p", "r", "rc", "l", "lc"]))
        pack = zstandard.ZstdCompressor(level=3).compress
        return [[len(s) for s in split], [hashlib.sha256(units.keep(s)).hexdigest() for s in split], [pack(t) if n else None for t, n in zip(texts, count.tolist())], made]

    return map_text(src, "t", ["id", "key"], struct(n="long", sha="string", z="binary", a=ANCHORS), scan, units.slice_bytes)


def _small(batches, column: int, units: Units):
    """Batches cut by the bytes of their compressed texts."""
    for whole in batches:
        yield from slices(whole, column, units.slice_bytes // 4)


def _with_texts(scanned: DataFrame, todo: DataFrame) -> DataFrame:
    """(z, a) of the texts that have contexts to look into, with the list of those."""
    lists = todo.groupBy("row").agg(F.collect_list(F.struct("p", "k", "c", "m")).alias("a"))
    return _met(scanned.select("row", "z"), lists).select("z", "a")


def _each_context(batches, units: Units):
    """(k, c, m, left bytes, right bytes) of every context, text by text."""
    w = units.width
    for batch in _small(batches, 0, units):
        for t, a in zip(_expand(batch.column(0)), batch.column(1)):
            split = units.split(t)
            raw = _raw(split, units.code(split) if w > 1 else None, units)
            a = a.values
            for p, k, c, m in zip(*(a.field(f).to_pylist() for f in ("p", "k", "c", "m"))):
                before, after, _, _ = units.side(bool(k & 1))
                yield k, c, m, raw[max(0, p - before) * w : p * w], raw[p * w : (p + after) * w]


def _contexts(scanned: DataFrame, todo: DataFrame, units: Units) -> DataFrame:
    def run(batches):
        rows = []
        for row in _each_context(batches, units):
            rows.append(row)
            if len(rows) >= 20_000:
                yield _context_batch(rows)
                rows = []
        if rows:
            yield _context_batch(rows)

    return _with_texts(scanned, todo).mapInArrow(run, "k long, c long, m long, l binary, r binary")


def _context_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=["k", "c", "m", "l", "r"])


def _compared(contexts: DataFrame, units: Units) -> DataFrame:
    """(k, c, low, high) of contexts that share windows; groups come sorted and pass in chunks."""
    dealt = contexts.repartition("k").sortWithinPartitions("k")

    def analyse(batches):
        held: list[pa.RecordBatch] = []
        n = 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            n += b.num_rows
            if n < CHUNK:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            k = table["k"].to_numpy()
            cut = int(np.searchsorted(k, k[-1], "left"))  # the last group may go on
            if cut:
                yield from judge(table.slice(0, cut))
            held = table.slice(cut).combine_chunks().to_batches()
            n = len(table) - cut
        if held:
            yield from judge(pa.Table.from_batches(held))

    def judge(table):
        table = table.combine_chunks()
        column = lambda c: table[c].chunk(0)
        low, high = block_ranges(table["k"].to_numpy(), column("l"), column("r"), units)
        hit = np.flatnonzero((high >= 0) & (table["m"].to_numpy() == 1))  # the others share all windows anyway
        rows = pa.array(hit)
        yield pa.RecordBatch.from_arrays([column("k").take(rows), column("c").take(rows), pa.array(low[hit]), pa.array(high[hit])], names=["k", "c", "low", "high"])

    return dealt.mapInArrow(analyse, "k long, c long, low long, high long")


def _windows(scanned: DataFrame, todo: DataFrame, units: Units) -> DataFrame:
    """(k, c, o, a, b, m): 128 bits of every window of every context."""

    def run(batches):
        rows = []
        for k, c, m, left, right in _each_context(batches, units):
            _, _, first, last = units.side(bool(k & 1))
            w, text = units.width, left + right
            have, total = len(left) // w, len(text) // w
            for o in range(max(first, units.window - (total - have)), min(last, have) + 1):
                d = xxhash.xxh3_128_intdigest(text[(have - o) * w : (have - o + units.window) * w], o)
                rows.append((k, c, o, _signed(d >> 64), _signed(d & 0xFFFFFFFFFFFFFFFF), m))
            if len(rows) >= 50_000:
                yield _window_batch(rows)
                rows = []
        if rows:
            yield _window_batch(rows)

    return _with_texts(scanned, todo).mapInArrow(run, "k long, c long, o long, a long, b long, m long")


def _window_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], names=["k", "c", "o", "a", "b", "m"])


def _counted(windows: DataFrame) -> DataFrame:
    """(k, c, low, high): as :func:`_compared`, for keys with any number of contexts."""
    windows = materialise(windows, "windows")
    shared = materialise(windows.groupBy("k", "o", "a", "b").agg(F.sum("m").alias("n")).filter("n > 1").drop("n"), "shared")
    return windows.filter("m = 1").join(shared, ["k", "o", "a", "b"], "left_semi").groupBy("k", "c").agg(F.min("o").alias("low"), F.max("o").alias("high"))


def _expand(column: pa.Array) -> list[bytes]:
    unpack = zstandard.ZstdDecompressor().decompress
    return [unpack(z) for z in column.to_pylist()]


def _raw(split, codes: np.ndarray | None, units: Units) -> bytes:
    """A text's units as fixed-width bytes whose order is the units' order."""
    return split if units.width == 1 else codes.astype(">u8").tobytes()


def _cut(units: Units, text: bytes, n: int, spans) -> tuple[int, int, str]:
    split = units.split(text)
    p, low, high = (spans.values.field(f).to_numpy(zero_copy_only=False).astype(np.int64) for f in ("p", "low", "high"))
    high, low = np.minimum(high, p), np.maximum(low, units.window - (n - p))
    fits = high >= low
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, (p - high)[fits], 1)
    np.add.at(edge, (p - low + units.window)[fits], -1)
    gone = np.cumsum(edge[:-1]) > 0
    runs = int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(gone[0])
    return int(gone.sum()), runs, hashlib.sha256(units.keep(split, ~gone)).hexdigest()
