"""SimHash near-duplicates through a byte-position inverted index with count filtering.

A 64-bit fingerprint is eight (position, byte) terms. Two fingerprints that differ in at most two bits share at
least six of those terms, so the count filter's guaranteed minimum is six. Postings of single terms would hold a
256th of all documents each; the index is keyed by four positions with their bytes instead (two of four
pairs of neighbours, at least two of which two near fingerprints share). Within a posting the shared
positional bytes of every pair are tallied, pairs below the minimum go, and the exact distance of the others is
verified. A posting beyond a bound is not paired: its members are indexed anew by every choice of six
positions, where a tally reaches the minimum by meeting, and a posting holds at most 65,536 different
fingerprints whatever the corpus size. Only a spanning forest of the links goes on.

Defined cases: null or blank text has fingerprint zero, linked like any other; copies and repeated rows
share a fingerprint and are one node; rows with a null id have a fingerprint and take the component's least
known id (null where it has none); extra columns are ignored, whatever their names; an empty table gives an empty
result; long texts are hashed whole.
"""

from __future__ import annotations

from itertools import chain, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm._util import at, doc_offsets, map_text, materialise, named, numbered, struct
from tessera.llm.components import components

BYTES, MAX_BITS = 8, 2
#: Rows of an id and a hash up to which they are broadcast; beyond, the join shuffles.
BROADCAST_ROWS = 1_000_000
_POP16 = np.array([bin(i).count("1") for i in range(1 << 16)], dtype=np.uint8)


def fingerprints(texts: list[bytes | None], size: int = 3) -> np.ndarray:
    """Unsigned fingerprints of whole texts over ``size``-word shingles, repeats included."""
    hashes: list[int] = []
    counts = np.zeros(len(texts), dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for i, t in enumerate(texts):
        words = t.lower().split() if t else []
        if not words:
            continue
        if len(words) <= size:
            hashes.append(digest(b" ".join(words), 42))
            counts[i] = 1
            continue
        line = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[: -size] + 1)).tolist()
        hashes += [digest(line[a:b], 42) for a, b in zip(starts, ends[size - 1 :].tolist())]
        counts[i] = len(starts)
    out = np.zeros(len(texts), dtype=np.uint64)
    some = np.flatnonzero(counts)
    if len(some):
        off = doc_offsets(counts[some])
        h = np.array(hashes, dtype=np.uint64)
        weights = np.uint64(1) << np.arange(64, dtype=np.uint64)
        for at in range(0, len(some), 256):  # bounded: bits of a few texts at a time
            sub = off[at : at + 257]
            ones = _bit_counts(h[sub[0] : sub[-1]], sub - sub[0])
            out[some[at : at + 256]] = ((2 * ones > np.diff(sub)[:, None]) * weights).sum(axis=1, dtype=np.uint64)
    return out


def _bit_counts(h: np.ndarray, off: np.ndarray, step: int = 1 << 18) -> np.ndarray:
    """(runs, 64) counts of set bits, least significant first, ``step`` hashes at a time."""
    out = np.zeros((len(off) - 1, 64), dtype=np.int64)
    for a in range(0, len(h), step):
        bits = np.unpackbits(h[a : a + step].view(np.uint8), bitorder="little").reshape(-1, 64)
        first, last = np.searchsorted(off, a, "right") - 1, np.searchsorted(off, a + len(bits), "left")
        edges = np.clip(off[first : last], a, a + len(bits)) - a
        out[first:last] += np.add.reduceat(bits, edges, axis=0, dtype=np.int32)
    return out


def fingerprint_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, fp): the fingerprint's bits as a signed long."""
    out = struct(fp="long")
    return map_text(docs, text_col, [id_col], out, lambda texts: [fingerprints(texts).view(np.int64)])


def _choices() -> list[tuple[np.uint64, int, int]]:
    """For each choice of six of eight byte positions: its mask, and the shifts of the two free bytes."""
    made = []
    for free in combinations(range(BYTES), MAX_BITS):
        mask = (1 << 64) - 1
        for f in free:
            mask &= ~(0xFF << (8 * f))
        made.append((mask, 8 * free[0], 8 * free[1]))
    return made


def spanning(rest: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what lies within two bits among the distinct 16-bit values of one posting."""
    n = len(rest)
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    made = []
    if n <= 64:
        a, b = np.nonzero(np.triu(_POP16[rest[:, None] ^ rest[None, :]] <= MAX_BITS, 1))
        pairs = [(a, b)]
    else:
        place = np.full(1 << 16, -1, dtype=np.int64)
        place[rest] = np.arange(n)
        masks = [m for m in range(1, 1 << 16) if _POP16[m] <= MAX_BITS]
        pairs = ((np.flatnonzero((at := place[rest ^ m]) > np.arange(n)), at[at > np.arange(n)]) for m in masks)
    for a, b in pairs:
        for i, j in zip(a.tolist(), b.tolist()):
            x, y = root(i), root(j)
            if x != y:
                parent[x] = y
                made.append((i, j))
    return made


#: Members of a posting up to which all its pairs are tallied.
TALLIED = 512
#: Postings that are looked at together hold so many rows, always whole.
CHUNK = 50_000


def _pairs_of_blocks() -> list[int]:
    """The masks of every two of the four neighbouring pairs of bytes."""
    block = lambda i: 0xFFFF << (16 * i)
    return [block(i) | block(j) for i, j in combinations(range(4), 2)]


def tally(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shared positional bytes and differing bits of pairs of fingerprints."""
    x = np.ascontiguousarray(a ^ b)
    same = (x.view(np.uint8).reshape(*x.shape, BYTES) == 0).sum(axis=-1)
    return same, _POP16[x.view(np.uint16).reshape(*x.shape, 4)].sum(axis=-1)


def _posted(fingerprints: DataFrame, masks: list[int]) -> DataFrame:
    """(fp, c, bytes): the postings under every mask, dealt out by term and in its order."""
    keys = F.array(*[F.struct(F.lit(c).alias("c"), F.col("fp").bitwiseAND(_signed(m)).alias("bytes")) for c, m in enumerate(masks)])
    return fingerprints.select("fp", F.explode(keys).alias("k")).select("fp", "k.c", "k.bytes").repartition("c", "bytes").sortWithinPartitions("c", "bytes")


def links(table: DataFrame) -> DataFrame:
    """(u, v): links spanning the same components as all pairs of fingerprints within two bits."""

    def run(batches):
        """Links, and (fp, null) for members of postings beyond the bound."""
        held, open_ = [np.zeros(0, np.int64)] * 3, None
        for b in chain(batches, [None]):
            if b is not None:
                held = [np.concatenate([h, b.column(i).to_numpy(zero_copy_only=False).astype(np.int64)]) for i, h in enumerate(held)]
                if len(held[0]) < CHUNK:
                    continue
            fp, c, key = held
            if not len(fp):
                continue
            starts = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (c[1:] != c[:-1]))))
            ends = np.append(starts[1:], len(fp))
            last = (int(c[-1]), int(key[-1]))
            u, v, large = [], [], []
            for i, (s, e) in enumerate(zip(starts.tolist(), ends.tolist())):
                if e - s > TALLIED or (c[s], key[s]) == open_:
                    large.append(fp[s:e])
                elif b is not None and i == len(starts) - 1:
                    break  # may go on in the next batch
                elif e - s > 1:
                    x = fp[s:e].view(np.uint64)
                    same, bits = tally(x[:, None], x[None, :])
                    for i0, j0 in forest((same >= BYTES - MAX_BITS) & (bits <= MAX_BITS)):
                        u.append(fp[s + i0])
                        v.append(fp[s + j0])
            rest = slice(int(starts[-1]), None) if ends[-1] - starts[-1] <= TALLIED and last != open_ and b is not None else slice(len(fp), None)
            open_ = last if rest.start == len(fp) else None
            held = [h[rest] for h in held]
            large = np.concatenate(large) if large else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([*u, *large.tolist()], pa.int64()), pa.array([*v, *[None] * len(large)], pa.int64())], names=["u", "v"])

    first = materialise(_posted(table.select("fp").distinct(), _pairs_of_blocks()).mapInArrow(run, "u long, v long"), "tallied")
    found = first.filter("v is not null")
    refined = first.filter("v is null").select(F.col("u").alias("fp")).distinct()
    if not refined.isEmpty():
        found = found.union(_within(refined))
    return found.distinct()


def forest(near: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the graph of a symmetric matrix."""
    seen, made = np.zeros(len(near), dtype=bool), []
    for root in range(len(near)):
        if seen[root]:
            continue
        seen[root] = True
        stack = [root]
        while stack:
            i = stack.pop()
            new = np.flatnonzero(near[i] & ~seen)
            seen[new] = True
            made += [(i, j) for j in new.tolist()]
            stack += new.tolist()
    return made


def _within(fingerprints: DataFrame) -> DataFrame:
    """(u, v): links among the members of large postings, by choices of six positions."""
    shifts = [(np.uint64(a), np.uint64(b)) for _, a, b in _choices()]

    def run(batches):
        held = [np.zeros(0, np.int64)] * 3
        for b in chain(batches, [None]):
            if b is not None:
                held = [np.concatenate([h, b.column(i).to_numpy(zero_copy_only=False).astype(np.int64)]) for i, h in enumerate(held)]
                if len(held[0]) < CHUNK:
                    continue
            fp, c, key = held
            cut = len(fp) if b is None else int(np.flatnonzero((c == c[-1]) & (key == key[-1]))[0])
            for choice in np.unique(c[:cut]):
                pick = np.flatnonzero(c[:cut] == choice)
                x, y = shifts[choice]
                yield _link_postings(fp[pick].view(np.uint64), key[pick], x, y)
            held = [h[cut:] for h in held]

    return _posted(fingerprints, [m for m, _, _ in _choices()]).mapInArrow(run, "u long, v long")


def _link_postings(fp: np.ndarray, key: np.ndarray, a: np.uint64, b: np.uint64) -> pa.RecordBatch:
    order = np.argsort(key, kind="stable")
    fp, key = fp[order], key[order]
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    sizes = np.diff(np.append(starts, len(key)))
    rest = ((fp >> a & np.uint64(0xFF)) | (fp >> b & np.uint64(0xFF)) << np.uint64(8)).astype(np.int64)
    two = starts[sizes == 2]
    two = two[_POP16[rest[two] ^ rest[two + 1]] <= MAX_BITS]
    u, v = [fp[two]], [fp[two + 1]]
    for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
        if made := spanning(rest[s : s + n]):
            i, j = np.array(made).T
            u.append(fp[s + i])
            v.append(fp[s + j])
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(u).view(np.int64)), pa.array(np.concatenate(v).view(np.int64))], names=["u", "v"])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, fingerprint (16 hex digits) and component_id, the least id reachable over links."""
    table = materialise(fingerprint_table(docs, id_col, text_col), "fingerprints")
    roots = components(links(table))
    nodes = table.groupBy("fp").agg(F.min(id_col).alias("least"))
    nodes = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    nodes = materialise(nodes, "nodes")
    least = nodes.groupBy("root").agg(F.min("least").alias("component_id"))
    final = nodes.join(least, "root").select("fp", "component_id")
    return table.join(final, "fp").select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row per component: the one of the least id, rows without an id coming last.

    A row is told apart by its id and a hash of all its columns, so rows that repeat an id over different
    texts are compared like any others, and the choice among them does not depend on the order of reading.
    Of rows that are equal in every column, one stays.
    """
    plain, text = numbered(docs), at(docs, text_col)
    key = [F.col(at(docs, id_col)).alias("id"), F.xxhash64(*[F.col(c) for c in plain.columns]).alias("row")]
    table = materialise(map_text(plain.select(*key, F.col(text).alias("t")), "t", ["id", "row"], struct(fp="long"), lambda texts: [fingerprints(texts).view(np.int64)]), "fingerprints")
    roots = components(links(table))
    rows = table.join(roots, table.fp == roots.node, "left").select(F.coalesce("root", "fp").alias("root"), "id", "row")
    # Both sides of the join are stored, so that a root of many rows can be split there.
    counted = materialise(rows.groupBy("root", "id", "row").agg(F.count(F.lit(1)).alias("n")), "rows")
    first = counted.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("r"))
    first = materialise(first.select("root", F.col("r.id").alias("fid"), F.col("r.row").alias("frow")), "first")
    stays = F.col("id").eqNullSafe(F.col("fid")) & (F.col("row") == F.col("frow"))
    judged = materialise(counted.join(first, "root").select("id", "row", "n", stays.alias("stays")).filter(~F.col("stays") | (F.col("n") > 1)), "judged")
    sizes = {r["stays"]: r["n"] for r in judged.groupBy("stays").agg(F.count(F.lit(1)).alias("n")).collect()}
    hint = F.broadcast if sum(sizes.values()) <= BROADCAST_ROWS else lambda x: x

    def meet(where: str, how: str) -> DataFrame:
        other = hint(judged.filter(where).select(F.col("id").alias("jid"), F.col("row").alias("jrow")))
        known = plain.withColumn("row", key[1])
        return known.join(other, known[at(docs, id_col)].eqNullSafe(other.jid) & (known.row == other.jrow), how).drop("row")

    kept = meet("true", "left_anti")  # all but rows that go and rows that repeat
    if sizes.get(True):
        kept = kept.union(meet("stays", "left_semi").dropDuplicates())
    return named(kept, docs)
