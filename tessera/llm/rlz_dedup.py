"""Word substring deduplication by relative Lempel-Ziv parsing.

Anchors with equal half windows (see ``repeats``) bring together the contexts that may share a window; the
contexts of one key are a reference block. The block is indexed: for every start, its suffixes are sorted
(each order follows from the one a word further right), so that the longest match of a suffix elsewhere in the
block is the common prefix with a neighbour. Every context is parsed greedily against its block: a
factor is the longest match from where the last one ended. Factors of a window's length or more are
duplicate spans. A greedy factor can hide a match that begins inside it and goes on beyond its end, so all
starts whose window crosses a factor boundary are checked against the index too; with them the spans are
exact.

Defined cases: null and empty text has no words; texts shorter than a window keep all words; copies and
repeated rows are sources of each other; overlapping sources within one text count; rows with a null id are
texts like others; extra columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame

from tessera.llm.repeats import Units, multikey_order, repeated_spans, settle

WINDOW = 35


def match_lengths(groups: np.ndarray, words: np.ndarray, starts: np.ndarray, ends: np.ndarray, last: int) -> np.ndarray:
    """(rows, last + 1): the longest match, in words, of each row's suffix from ``o`` words before the anchor with
    that of another row of its group; 0 where a row does not reach so far.

    words: rows of codes with the anchor in column ``last``; row i holds columns starts[i] to ends[i].
    """
    n = len(groups)
    out = np.zeros((n, last + 1), dtype=np.int64)
    ids = np.unique(groups, return_inverse=True)[1]
    order, runs = multikey_order(ids, words[:, last:], words.shape[1] - last)
    order = settle(order, runs, ends)
    for o in range(last + 1):
        if o:  # the order of the suffixes one word longer: by that word, then as before
            rank = np.empty(n, dtype=np.int64)
            rank[order] = np.arange(len(order))
            order = order[starts[order] <= last - o]
            order = order[np.lexsort((rank[order], words[order, last - o], ids[order]))]
        if len(order) < 2:
            break
        same = np.zeros(len(order) + 1, dtype=np.int64)
        for at in range(0, len(order) - 1, 1 << 14):
            i, j = order[at : at + (1 << 14)], order[at + 1 : at + 1 + (1 << 14)]
            i = i[: len(j)]
            differ = words[i, last - o :] != words[j, last - o :]
            length = np.where(differ.any(axis=1), differ.argmax(axis=1), differ.shape[1])
            length = np.minimum(length, np.minimum(ends[i], ends[j]) - (last - o))
            same[at + 1 : at + 1 + len(i)] = np.where(ids[i] == ids[j], length, 0)
        out[order, o] = np.maximum(same[:-1], same[1:])
    return out


def factors(longest: np.ndarray, begin: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The greedy parse of all rows in step: (rows, starts, lengths) of the factors, from the leftmost on.

    A start is counted in words before the anchor; ``begin`` is each row's first one. A word without any
    match is a factor of one word. The parse ends at the anchor.
    """
    now, made = begin.copy(), []
    for o in range(longest.shape[1] - 1, -1, -1):
        rows = np.flatnonzero(now == o)
        if len(rows):
            length = longest[rows, o]
            made.append((rows, np.full(len(rows), o), length))
            now[rows] = o - np.maximum(length, 1)
    return made


def shared_ranges(groups: np.ndarray, left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray], window: int, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """Per context, the least and greatest offset from first to last whose window is a duplicate (-1: none)."""
    n = len(groups)
    reach = left[0].shape[1] // 8
    words = np.hstack([left[0].view(">u8")[:, ::-1], right[0].view(">u8")]).astype(np.uint64)
    starts, ends = reach - left[1], reach + right[1]
    longest = match_lengths(groups, words, starts, ends, reach)
    duplicate = np.zeros((n, reach + 1), dtype=bool)
    crossing = np.zeros((n, reach + 1), dtype=bool)
    for rows, at, length in factors(longest, left[1]):
        for row, o, size in zip(rows.tolist(), at.tolist(), length.tolist()):
            if size >= window:
                duplicate[row, max(0, o - (size - window)) : o + 1] = True
            boundary = o - max(size, 1)  # the next factor's start; windows from here to window - 1 before cross it
            crossing[row, max(0, boundary + 1) : max(0, min(reach, boundary + window - 1) + 1)] = True
    duplicate |= crossing & (longest >= window)
    duplicate[:, :first] = False
    duplicate[:, last + 1 :] = False
    some = duplicate.any(axis=1)
    low = np.where(some, duplicate.argmax(axis=1), -1)
    return low, np.where(some, reach - duplicate[:, ::-1].argmax(axis=1), -1)


def _code(words: list[bytes]) -> np.ndarray:
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(w) for w in words), np.uint64, len(words))


def _keep(words: list[bytes], stays: np.ndarray | None = None) -> bytes:
    return b" ".join(words if stays is None else [words[i] for i in np.flatnonzero(stays)])


def units(window: int = WINDOW) -> Units:
    return Units(split=bytes.split, code=_code, keep=_keep, width=8, window=window, gram=1 << max(0, (window // 8).bit_length() - 1), compare=shared_ranges)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Per document: id, n (words), n_removed, n_spans and kept_sha256."""
    return repeated_spans(docs, id_col, text_col, units(window))
