"""Byte substring deduplication over a sparse suffix array, sorted deep-shallow.

Suffixes are taken at the anchors of all windows (see ``repeats``) and sorted within their group of equal
half windows: multikey quicksort up to a shallow depth, then blind tries for the groups that still share a
long prefix. Common prefixes with the neighbours, to the right and on the reversed left side, tell which
windows repeat. Removed is every byte that a repeated window covers.

Defined cases: null text is empty; texts shorter than a window keep all bytes; copies and repeated rows
are matches of each other, each text being removed whole; overlapping matches within one text count;
matches never cross texts; rows with a null id are texts like others; extra columns are ignored, whatever
their names; an empty table gives an empty result; long texts are cut into contexts like any other.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from tessera.llm.repeats import Units, common, multikey_order, repeated_spans

WINDOW = 200
#: Bytes up to which multikey quicksort goes; beyond, blind tries.
SHALLOW = 64


class BlindTrie:
    """A trie that keeps branching depths only; strings are compared once, at a leaf.

    A node is [depth, {byte: child}]; a child is a node or a string's number. A string that ends at a
    node's depth hangs there under -1.
    """

    def __init__(self, strings: list[bytes]):
        self.strings, self.root = strings, None
        for i in range(len(strings)):
            self._insert(i)

    def _insert(self, i: int) -> None:
        s = self.strings[i]
        if self.root is None:
            self.root = i
            return
        node, path = self.root, []
        while isinstance(node, list):  # blindly down to some leaf
            path.append(node)
            c = s[node[0]] if node[0] < len(s) else -1
            nxt = node[1].get(c)
            node = nxt if nxt is not None else next(iter(node[1].values()))
        t = self.strings[node]
        depth = _common(s, t)
        above = None
        for n in path:  # back to where the strings part
            if n[0] > depth:
                break
            above = n
        c = s[depth] if depth < len(s) else -1
        if above is not None and above[0] == depth:
            above[1][c] = i
            return
        if above is None:
            below = self.root
        else:
            b = t[above[0]] if above[0] < len(t) else -1
            below = above[1][b]
        made = [depth, {t[depth] if depth < len(t) else -1: below, c: i}]
        if above is None:
            self.root = made
        else:
            above[1][b] = made

    def ordered(self) -> list[int]:
        """String numbers in lexicographic order."""
        out, stack = [], [self.root]
        while stack:
            node = stack.pop()
            if isinstance(node, list):
                stack += [node[1][c] for c in sorted(node[1], reverse=True)]
            else:
                out.append(node)
        return out


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


def deep_shallow_order(groups: np.ndarray, rows: np.ndarray, lengths: np.ndarray, shallow: int = SHALLOW) -> np.ndarray:
    """Order of padded byte rows by (group, string)."""
    words = np.ascontiguousarray(rows).view(">u8").astype(np.uint64)
    order, runs = multikey_order(groups, words, min(shallow // 8, words.shape[1]))
    for a, b in runs:
        part = order[a:b].tolist()
        places: dict[bytes, list[int]] = {}
        for r in part:
            places.setdefault(rows[r].tobytes()[: lengths[r]], []).append(r)
        strings = list(places)
        if len(strings) > 1:
            strings = [strings[i] for i in BlindTrie(strings).ordered()]
        order[a:b] = [r for s in strings for r in places[s]]
    return order


def shared_ranges(groups: np.ndarray, left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray], window: int, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row: the least and the greatest ``o`` from first to last whose window some other row of its group shares.

    left, right: padded rows and lengths of the sides. Rows agree on ``o`` units to the left if no common prefix
    between them in the left order is shorter, and likewise to the right: classes of both orders decide.
    """
    n = len(groups)
    low, high = np.full(n, -1, dtype=np.int64), np.full(n, -1, dtype=np.int64)
    prefix, place, best = [], [], []
    for rows, lengths in (left, right):
        order = deep_shallow_order(groups, rows, lengths)
        lcp = common(order, groups, rows, lengths, 1)
        where = np.empty(n, dtype=np.int64)
        where[order] = np.arange(n)
        prefix.append(lcp)
        place.append(where)
        best.append(np.maximum(lcp, np.append(lcp[1:], -1))[where])
    for o in range(first, last + 1):
        some = np.flatnonzero((best[0] >= o) & (best[1] >= window - o))
        if len(some) < 2:
            continue
        a = np.cumsum(prefix[0] < o)[place[0][some]]
        b = np.cumsum(prefix[1] < window - o)[place[1][some]]
        key = a * (n + 1) + b
        by = np.argsort(key, kind="stable")
        k = key[by]
        same = np.zeros(len(k) + 1, dtype=bool)
        same[1:-1] = k[1:] == k[:-1]
        hit = some[by[same[1:] | same[:-1]]]
        low[hit] = np.where(low[hit] < 0, o, low[hit])
        high[hit] = o
    return low, high


def _keep(text: bytes, stays: np.ndarray | None = None) -> bytes:
    return text if stays is None else np.frombuffer(text, dtype=np.uint8)[stays].tobytes()


def units(window: int = WINDOW) -> Units:
    # The gram: the largest power of two within a sixth of the window; shorter ones make fewer anchors.
    return Units(split=bytes, code=lambda t: np.frombuffer(t, dtype=np.uint8), keep=_keep, width=1, window=window, gram=1 << max(0, (window // 6).bit_length() - 1), compare=shared_ranges)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Per document: id, n (bytes), n_removed, n_spans and kept_sha256."""
    return repeated_spans(docs, id_col, text_col, units(window))
