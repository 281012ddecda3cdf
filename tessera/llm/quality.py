"""Quality rules by line sequence labelling.

A linear-chain conditional random field marks every line of a text as content or boilerplate; a text is
kept when the content lines hold at least ``min_share`` of its characters and it passes the base rules.
The field is trained by its exact likelihood (forward-backward) on lines of labelled texts: the lines of
a good text count as content, those of a poor one as boilerplate.

Defined cases: null text has no words, fails the base rules and is not kept, like empty and blank text;
lines without a word are no part of the sequence; without labelled rows every line is content; extra columns are
ignored; repeated rows are judged each for itself.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm._util import doc_offsets, map_text, struct, sum_by_run

_SPACE = b"\t\n\x0b\x0c\r "
_SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGITS = b"0123456789"
_MARKS = b"!?=@{}[]\\^~_/"
#: Multipliers that tell the places of a window's words apart (odd, from the digits of pi).
_PLACES = np.array([0x243F6A8885A308D3, 0x13198A2E03707345, 0xA4093822299F31D1, 0x082EFA98EC4E6C89, 0x452821E638D01377], dtype=np.uint64)


def base_metrics(texts: list[bytes | None], window: int = 5) -> dict[str, np.ndarray]:
    """Counts of the base rules over whole texts; see the contract of the query."""
    n = len(texts)
    out = {k: np.zeros(n, dtype=np.int64) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
    hashed, counts = [], np.zeros(n, dtype=np.int64)
    for i, t in enumerate(texts):
        if not t:
            continue
        words = t.split()
        counts[i] = len(words)
        solid = t.translate(None, _SPACE)
        out["word_chars"][i] = len(solid) if solid.isascii() else len(solid.decode("utf-8", "replace"))
        out["n_symbols"][i] = len(t) - len(t.translate(None, _SYMBOLS))
        lines = [x for x in t.split(b"\n") if x.strip()]
        out["n_dup_lines"][i] = len(lines) - len(set(lines))
        hashed.append(np.fromiter(map(hash, words), np.int64, len(words)))
    out["n_words"][:] = counts
    if hashed:
        h = np.concatenate(hashed).view(np.uint64)
        off = doc_offsets(counts)
        doc = np.repeat(np.arange(n), counts)
        w = np.zeros(max(0, len(h) - window + 1), dtype=np.uint64)
        for k in range(window):
            w += (h[k : k + len(w)] ^ h[k : k + len(w)] >> np.uint64(29)) * _PLACES[k]
        own = doc[: len(w)] == doc[window - 1 :] if len(w) else np.zeros(0, bool)
        w = (w ^ (w >> np.uint64(32))) * _PLACES[0] + doc[: len(w)].astype(np.uint64) * _PLACES[1]
        at = np.flatnonzero(own)
        order = np.argsort(w[at])
        s = w[at][order]
        same = np.zeros(len(s) + 1, dtype=bool)
        same[1:-1] = s[1:] == s[:-1]
        starts = at[order[same[1:] | same[:-1]]]
        edge = np.zeros(len(h) + 1, dtype=np.int64)
        np.add.at(edge, starts, 1)
        np.add.at(edge, starts + window, -1)
        out["n_repeat_words"] = sum_by_run((np.cumsum(edge[:-1]) > 0).astype(np.int64), off)
    return out


FEATURES = 25


def line_features(line: bytes, seen: bool) -> int:
    """Indicators of one line, as bits of an integer."""
    n = len(line)
    words = line.split()
    k = len(words)
    letters_up = n - len(line.translate(None, _UPPER))
    letters_low = n - len(line.translate(None, _LOWER))
    symbols = n - len(line.translate(None, _SYMBOLS))
    marks = n - len(line.translate(None, _MARKS))
    digits = n - len(line.translate(None, _DIGITS))
    bars = line.count(b"|")
    kinds = len(set(words))
    end = line.rstrip()[-1:]
    bits = 1
    flags = (
        k <= 2, 2 < k <= 6, 6 < k <= 15, k > 15, k > 60,
        symbols * 50 > n, symbols * 10 > n, marks * 50 > n, marks * 12 > n, digits * 20 > n, digits * 5 > n,
        letters_up > letters_low, letters_up * 4 > n, letters_low * 2 < n, bars * 4 > k, bars > 0,
        kinds * 2 < k, kinds * 5 < k, end in b".", end in b",;:", end in b"!?", n > 9 * k + 4, n < 4 * k, seen,
    )
    for f, on in enumerate(flags, 1):
        bits |= bool(on) << f
    return bits


def lines_of(text: bytes | None) -> tuple[list[int], list[int]]:
    """Feature bits and characters of every line with a word."""
    bits, sizes, seen = [], [], set()
    for line in text.split(b"\n") if text else []:
        if line.strip():
            bits.append(line_features(line, line in seen))
            sizes.append(len(line) if line.isascii() else len(line.decode("utf-8", "replace")))
            seen.add(line)
    return bits, sizes


def _spread(bits: np.ndarray) -> np.ndarray:
    return (bits[:, None] >> np.arange(FEATURES) & 1).astype(float)


# Products go through einsum, not BLAS: its threads do not outlive the fork that starts the JVM.


class LineField:
    """A linear-chain CRF with the states 0 (boilerplate) and 1 (content)."""

    def __init__(self):
        self.emit = np.zeros((FEATURES, 2))
        self.emit[0, 1] = 1.0  # untrained: every line is content
        self.move = np.zeros((2, 2))

    def fit(self, sequences: list[list[int]], labels: list[int], rounds: int = 150, rate: float = 0.2, l2: float = 1e-3) -> LineField:
        """Maximises the regularised likelihood by Adam; ``labels`` holds each sequence's state.

        Sequences are cut into stretches of 64 lines, so that the steps of a round stay few.
        """
        cut = ((s[i : i + 64], y) for s, y in zip(sequences, labels) for i in range(0, len(s), 64))
        pairs = sorted(cut, key=lambda p: -len(p[0]))
        if not pairs:
            return self
        off = doc_offsets([len(s) for s, _ in pairs])
        x = _spread(np.concatenate([np.array(s, dtype=np.int64) for s, _ in pairs]))
        y = np.repeat([y for _, y in pairs], np.diff(off))
        self.emit[:] = 0
        gold_emit = np.einsum("nf,ns->fs", x, np.eye(2)[y])
        gold_move = np.zeros((2, 2))
        for s, state in pairs:
            gold_move[state, state] += len(s) - 1
        total = len(x)
        params = [self.emit, self.move]
        m = [np.zeros_like(p) for p in params]
        v = [np.zeros_like(p) for p in params]
        for step in range(1, rounds + 1):
            e, t = self._expected(x, off)
            grads = [(gold_emit - e) / total - l2 * self.emit, (gold_move - t) / total - l2 * self.move]
            for p, g, a, b in zip(params, grads, m, v):
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                p += rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
        return self

    def _expected(self, x: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Expected emissions and moves; sequences are ordered by falling length."""
        score = np.einsum("nf,fs->ns", x, self.emit)
        n = np.diff(off)
        alpha = score.copy()
        deep = int(n[0])
        active = [int(np.searchsorted(-n, -t, "left")) for t in range(deep + 1)]  # sequences longer than t
        for t in range(1, deep):
            k = active[t]
            i = off[:k] + t
            alpha[i] += np.logaddexp(alpha[i - 1, :1] + self.move[0], alpha[i - 1, 1:] + self.move[1])
        beta = np.zeros_like(score)
        for t in range(deep - 2, -1, -1):
            k = active[t + 1]
            i = off[:k] + t
            nxt = score[i + 1] + beta[i + 1]
            beta[i] = np.logaddexp(nxt[:, :1] + self.move[:, 0], nxt[:, 1:] + self.move[:, 1])
        z = np.logaddexp(alpha[off[1:] - 1, 0], alpha[off[1:] - 1, 1])
        zz = np.repeat(z, n)[:, None]
        state = np.exp(alpha + beta - zz)
        later = np.ones(len(x), bool)
        later[off[:-1]] = False
        i = np.flatnonzero(later)
        pair = alpha[i - 1][:, :, None] + self.move[None] + (score + beta)[i][:, None, :] - zz[i][:, :, None]
        return np.einsum("nf,ns->fs", x, state), np.exp(pair).sum(axis=0)

    def decode(self, sequences: list[list[int]]) -> list[np.ndarray]:
        """Viterbi: the likeliest states of every sequence, all sequences stepping together."""
        order = sorted(range(len(sequences)), key=lambda i: -len(sequences[i]))
        n = np.array([len(sequences[i]) for i in order], dtype=np.int64)
        off = doc_offsets(n)
        if not off[-1]:
            return [np.zeros(0, np.int64) for _ in sequences]
        best = np.einsum("nf,fs->ns", _spread(np.concatenate([np.array(sequences[i], dtype=np.int64) for i in order])), self.emit)
        came = np.zeros((len(best), 2), dtype=np.int8)
        deep = int(n[0])
        for t in range(1, deep):
            i = off[: int(np.searchsorted(-n, -t, "left"))] + t
            step = best[i - 1][:, :, None] + self.move[None]
            came[i] = step.argmax(axis=1)
            best[i] += step.max(axis=1)
        state = np.zeros(len(best), dtype=np.int64)
        some = n > 0
        state[off[1:][some] - 1] = best[off[1:][some] - 1].argmax(axis=1)
        for t in range(deep - 2, -1, -1):
            i = off[: int(np.searchsorted(-n, -(t + 1), "left"))] + t
            state[i] = came[i + 1, state[i + 1]]
        out: list = [None] * len(sequences)
        for k, i in enumerate(order):
            out[i] = state[off[k] : off[k + 1]]
        return out


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows_per_class: int = 1500) -> LineField:
    """Trains on at most ``rows_per_class`` labelled texts of either class (the lowest id hashes)."""
    known = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min(label_col).alias("y"))
    h = F.xxhash64(F.col(id_col).cast("string"))
    picked = None
    for y in (0, 1):
        some = known.filter(F.col("y") == y).orderBy(h, id_col).limit(rows_per_class)
        picked = some if picked is None else picked.union(some)
    src = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("t")).join(F.broadcast(picked.select(F.col(id_col).alias("id"), "y")), "id")
    out = struct(bits="long[]")
    got = map_text(src, "t", ["y"], out, lambda texts: [[lines_of(t)[0] for t in texts]]).toArrow()
    return LineField().fit(got["bits"].to_pylist(), got["y"].to_pylist())


def judge(docs: DataFrame, field: LineField, keep: list[str], text_col: str = "text", min_share: float = 0.5, min_words: int = 10, max_repeat: int = 20) -> DataFrame:
    """``keep`` plus the base metrics, base_failed, content_share, n_lines, n_content_lines and kept."""
    sent = docs.sparkSession.sparkContext.broadcast(field)
    counts = dict.fromkeys(("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"), "long")
    out = struct(**counts, base_failed="boolean", kept="boolean", content_share="double", n_lines="long", n_content_lines="long")

    def compute(texts):
        base = base_metrics(texts)
        failed = (base["n_words"] < min_words) | (100 * base["n_repeat_words"] > max_repeat * base["n_words"])
        read = [lines_of(t) for t in texts]
        states = sent.value.decode([b for b, _ in read])
        share = np.array([float((s * np.array(z)).sum()) / sum(z) if z else 0.0 for s, (_, z) in zip(states, read)])
        return [*base.values(), failed, ~failed & (share >= min_share), share, [len(s) for s in states], [int(s.sum()) for s in states]]

    return map_text(docs, text_col, keep, out, compute)


def label_lines(docs: DataFrame, field: LineField, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` plus lines (text, content) of every document: the operator's real output."""
    sent = docs.sparkSession.sparkContext.broadcast(field)
    kind = T.ArrayType(struct(line="string", content="boolean"))

    def compute(texts):
        states = sent.value.decode([lines_of(t)[0] for t in texts])
        return [[[{"line": x.decode("utf-8", "replace"), "content": bool(s)} for x, s in zip([x for x in (t or b"").split(b"\n") if x.strip()], st)] for t, st in zip(texts, states)]]

    return map_text(docs, text_col, keep, struct(lines=kind), compute)
