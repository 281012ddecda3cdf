"""Toxicity scores after noisy-channel deobfuscation.

A character language model (interpolated trigrams over the words of the whole corpus) and a channel
(leetspeak stands for letters, letters are spaced out, letters are repeated) restore disguised words:
a disguised stretch of text is a lattice of characters, in which a leet character is one of its letters or
no letter, a run of equal letters is one or two of them, and a separator is nothing or a word break.
Viterbi decoding finds its likeliest plain words. The restored text is scored by a logistic regression over
hashed words and word beginnings.

Only stretches with a sign of disguise are decoded: leet characters before, between or after letters, three equal
letters in a row, a letter alone between dots, dashes or underscores, or three and more single letters or
leet characters between blanks.

Defined cases: null, empty and wordless texts get the model's base rate; without labelled rows every score is
0.0; rows with null labels or ids are not learned from; labels that contradict each other for one id count
with their maximum; words of any length are decoded, in steps linear in it; extra columns are ignored, whatever their
names; an empty table gives an empty result; repeated rows are scored each for itself.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm._util import doc_offsets, map_text, materialise, slices, struct, texts_of

#: What leet characters may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "*": "aeiou"}
SEPARATORS = " ._-"
_LEET_CLASS = "".join(re.escape(c) for c in LEET)
_LETTER = r"[^\W\d_]"
_WORD = re.compile(rf"{_LETTER}+", re.UNICODE)
_DISGUISED = re.compile(rf"{_LETTER}[{_LEET_CLASS}]+{_LETTER}|^[{_LEET_CLASS}]+{_LETTER}|{_LETTER}[\d$@]+$|({_LETTER})\1\1|(?:^|[._\-]){_LETTER}[._\-]+{_LETTER}|{_LETTER}[._\-]+{_LETTER}(?:$|[._\-])| ", re.UNICODE)
_GAPS = re.compile(r"\s+")
_SPACED = set("0123456789@$!")
_QUOTES = "\"'(["
_EDGES = ".,;:!?\"')(*#%&|+[]"
#: Up to so many digits or signs after a word's last letter may be letters; more are an ornament.
_TAIL = re.compile(r"(?:\d{3,}|[$@]{3,}|[\d$@]{5,})$")
#: Costs of the channel: a letter as leet; a repetition (two for more, one for two); a leet character between
#: letters or before them that is no letter, one of the usual marks before a word, one after a word; a separator
#: within a word, a break between single letters.
LEET_COST, DOUBLE_COST, KEEP_COST, MARK_COST, TAIL_COST, JOIN_COST, BREAK_COST = 1.0, 2.0, 12.0, 1.0, 2.5, 4.0, 4.0
DIMENSIONS = 1 << 26
END, BREAK = "\n", " "


class CharModel:
    """Interpolated character trigrams within words; ``^`` before and ``END`` after a word."""

    def __init__(self, trigrams: dict[str, int]):
        self.three = dict(trigrams)
        self.two, self.one, self.ctx2, self.ctx1 = Counter(), Counter(), Counter(), Counter()
        for g, n in trigrams.items():
            self.two[g[1:]] += n
            self.one[g[2]] += n
            self.ctx2[g[:2]] += n
            self.ctx1[g[1]] += n
        self.total = sum(self.one.values())
        self.kinds = len(self.one) + 1
        self.known: dict[tuple[str, str, str], float] = {}

    def logp(self, a: str, b: str, c: str) -> float:
        got = self.known.get((a, b, c))
        if got is None:
            p = (self.one.get(c, 0) + 0.5) / (self.total + 0.5 * self.kinds)
            if n := self.ctx1.get(b):
                p = 0.2 * p + 0.8 * self.two.get(b + c, 0) / n
            if n := self.ctx2.get(a + b):
                p = 0.15 * p + 0.85 * self.three.get(a + b + c, 0) / n
            got = float(np.log(max(p, 1e-12)))
            if len(self.known) < 500_000:  # a memory, not a bound on the model
                self.known[a, b, c] = got
        return got


def lattice(stretch: str) -> list[list[tuple[str, float]]]:
    """The columns of a disguised stretch: per run of equal characters, what it may have been and its cost."""
    runs, i = [], 0
    while i < len(stretch):
        j = i
        while j < len(stretch) and stretch[j] == stretch[i]:
            j += 1
        runs.append((stretch[i], j - i))
        i = j
    letters = [i for i, (c, _) in enumerate(runs) if c.isalpha()]
    first, last = (letters[0], letters[-1]) if letters else (0, -1)
    alone = lambda i: 0 <= i < len(runs) and runs[i][1] == 1 and all(not 0 <= k < len(runs) or runs[k][0] in SEPARATORS for k in (i - 1, i + 1))
    times = lambda n: [(1, 0.0)] if n == 1 else [(1, DOUBLE_COST), (2, 0.0)] if n == 2 else [(1, 0.0), (2, DOUBLE_COST)]
    columns = []
    for i, (c, n) in enumerate(runs):
        if c in LEET:
            ways = [(o * k, LEET_COST + cost) for o in LEET[c] for k, cost in times(n)]
            ways.append((BREAK, TAIL_COST if i > last else MARK_COST if i < first and c not in _SPACED else KEEP_COST))
        elif c == " " and n > 1:
            ways = [(BREAK, 0.0)]
        elif c in SEPARATORS:
            single = alone(i - 1) or alone(i + 1)
            ways = [("", 0.0 if single else JOIN_COST), (BREAK, BREAK_COST if single else 0.0)]
        elif c.isalpha():
            ways = [(c * k, cost) for k, cost in times(n)]
        else:
            ways = [(BREAK, 0.0)]
        columns.append(ways)
    return columns


def decode(stretch: str, model: CharModel) -> list[str]:
    """The likeliest plain words of a disguised stretch: Viterbi over states of the last two plain characters."""
    best = {("^", "^"): (0.0, None)}  # state: (score, chain of what was emitted)
    for ways in lattice(stretch):
        after: dict[tuple[str, str], tuple[float, tuple | None]] = {}
        for (a, b), (score, chain) in best.items():
            for chars, cost in ways:
                x, y, s = a, b, score - cost
                if chars == BREAK:
                    if y != "^":
                        s += model.logp(x, y, END)
                    x, y = "^", "^"
                else:
                    for ch in chars:
                        s += model.logp(x, y, ch)
                        x, y = y, ch
                held = after.get((x, y))
                if held is None or s > held[0]:
                    after[x, y] = (s, (chain, chars) if chars else chain)
        best = after
    _, chain = max(((s + (model.logp(x, y, END) if y != "^" else 0.0), c) for (x, y), (s, c) in best.items()), key=lambda v: v[0])
    made = []
    while chain:
        chain, chars = chain
        made.append(chars)
    return "".join(reversed(made)).split()


class Restorer:
    """Restores whole texts, token by token; results are remembered up to a bound."""

    def __init__(self, model: CharModel, limit: int = 300_000):
        self.model, self.limit, self.known = model, limit, {}

    def token(self, token: str) -> tuple[str, ...]:
        """The plain words of one lower-case token."""
        got = self.known.get(token)
        if got is None:
            if len(self.known) >= self.limit:
                self.known.clear()
            core = token if token.isalpha() else _core(token)
            if _DISGUISED.search(core):
                got = tuple(w for x in decode(core, self.model) for w in _WORD.findall(x))
            else:
                got = tuple(_WORD.findall(core))
            self.known[token] = got
        return got

    def tokens(self, text: str) -> list[str]:
        """Lower-case tokens; three or more letters and leet characters standing alone in a row are one token."""
        split = text.lower().split()
        alone = [i for i, t in enumerate(split) if len(t) == 1 and (t.isalpha() or t in _SPACED)]
        if not any(a + 2 == c for a, c in zip(alone, alone[2:])):
            return split
        gaps = _GAPS.findall(text.strip())  # one after every token: wide ones end a word
        out, at, k = [], 0, 0
        while k < len(alone):
            e = k
            while e + 1 < len(alone) and alone[e + 1] == alone[e] + 1:
                e += 1
            if e - k >= 2 and sum(split[i].isalpha() for i in alone[k : e + 1]) >= 2:
                out += split[at : alone[k]]
                here = range(alone[k], alone[e] + 1)
                out.append("".join(split[i] + ("" if i == alone[e] else "  " if len(gaps[i]) > 1 else " ") for i in here))
                at = alone[e] + 1
            k = e + 1
        return out + split[at:]

    def words(self, text: str) -> list[str]:
        """The plain words of a text (lower case), disguised ones restored."""
        return [w for t in self.tokens(text) for w in self.token(t)]


def _core(token: str) -> str:
    """A token without the punctuation and ornaments around it; leet characters that may be letters stay."""
    while True:
        core = _TAIL.sub("", token.rstrip(_EDGES)).lstrip(_QUOTES)
        if core[:1] not in LEET:
            core = core.lstrip(_EDGES)
        if core == token or not core:
            return core
        token = core


def features(words: list[str]) -> np.ndarray:
    """Distinct hashed features: each word, its beginnings of three to eight letters, and beginnings that
    several words of the text share."""
    made, shared = set(), Counter()
    for w in set(words):
        once, twice = hashes(w)
        made.update(once)
        shared.update(twice)
    made.update(h for h, n in shared.items() if n > 1)
    return np.array(sorted(made), dtype=np.int32)


def hashes(word: str) -> tuple[list[int], list[int]]:
    """The features of a word, and those that stand if another word has them too."""
    h = xxhash.xxh64_intdigest
    starts = [f"{k}{word[:k]}" for k in range(3, 9) if len(word) > k]
    return [h(x) % DIMENSIONS for x in (word, *starts)], [h("2" + x) % DIMENSIONS for x in starts]


def count_trigrams(docs: DataFrame, text_col: str) -> DataFrame:
    """(gram, n) over the plain words of every text; words are counted per slice first."""

    def run(batches):
        for whole in batches:
            for batch in slices(whole, 0, 8 << 20):
                words: Counter = Counter()
                for t in texts_of(batch, 0):
                    if t:
                        words.update(t.split())
                made: Counter = Counter()
                for w, n in words.items():
                    w = w.decode("utf-8", "replace").lower().strip(_EDGES)
                    if w.isalpha():
                        s = f"^^{w}{END}"
                        for i in range(len(s) - 2):
                            made[s[i : i + 3]] += n
                yield pa.RecordBatch.from_arrays([pa.array(list(made), pa.string()), pa.array(list(made.values()), pa.int64())], names=["gram", "n"])

    return docs.select(F.col(text_col).alias("t")).mapInArrow(run, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))


class ToxicityModel:
    """The restorer and the regression over features of restored texts."""

    def __init__(self, chars: CharModel):
        self.restorer, self.weight, self.bias = Restorer(chars), {}, -np.inf
        self.telling: dict[str, tuple] = {}

    def extract(self, texts: list[bytes | None]) -> list[np.ndarray]:
        return [features(self.restorer.words(t.decode("utf-8", "replace"))) if t else np.zeros(0, np.int32) for t in texts]

    def _weighted(self, token: str) -> tuple:
        """(word, its weighted features, its weighted shared features) of a token's words that have any."""
        out = []
        for w in self.restorer.token(token):
            once, twice = ([h for h in hs if h in self.weight] for hs in hashes(w))
            if once or twice:
                out.append((w, tuple(once), tuple(twice)))
        return tuple(out)

    def score(self, texts: list[bytes | None]) -> np.ndarray:
        """Scores in [0, 1]. Which weighted features a token has is remembered, up to a bound."""
        if not np.isfinite(self.bias):
            return np.zeros(len(texts))
        z = np.full(len(texts), self.bias)
        known = self.telling
        for i, t in enumerate(texts):
            if not t:
                continue
            tokens = set(self.restorer.tokens(t.decode("utf-8", "replace")))
            if len(known) > 600_000:
                known.clear()
            for token in tokens.difference(known):
                known[token] = self._weighted(token)
            found = {x for token in tokens for x in known[token]}
            if found:
                made = {h for _, once, _ in found for h in once}
                made.update(h for h, n in Counter(h for _, _, twice in found for h in twice).items() if n > 1)
                z[i] += sum(map(self.weight.__getitem__, sorted(made)))
        return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))

    def fit(self, flat: np.ndarray, off: np.ndarray, labels: np.ndarray, rounds: int = 500, rate: float = 0.3, l2: float = 1e-6) -> ToxicityModel:
        """Logistic regression by full-batch AdaGrad over the features that :func:`telling` selects; row i has
        the features ``flat[off[i]:off[i + 1]]``."""
        if not len(labels) or labels.min() == labels.max():
            return self
        used = telling(flat, off, labels)
        rate0 = float(labels.mean())
        self.bias = float(np.log(rate0 / (1 - rate0)))
        hit = np.flatnonzero(_among(flat, used))
        if not len(hit):
            return self
        place, doc, y = np.searchsorted(used, flat[hit]), np.searchsorted(off, hit, "right") - 1, labels.astype(float)
        w, b, gw, gb = np.zeros(len(used)), self.bias, np.full(len(used), 1e-8), 1e-8
        for _ in range(rounds):
            z = np.bincount(doc, w[place], len(labels)) + b
            err = (y - 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))) / len(labels)
            g = np.bincount(place, err[doc], len(used)) - l2 * w
            gw += g * g
            gb += err.sum() ** 2
            w += rate * g / np.sqrt(gw)
            b += rate * err.sum() / np.sqrt(gb)
        self.weight = {int(h): float(x) for h, x in zip(used, w) if x}
        self.bias = _bias(np.bincount(doc, w[place], len(labels)), labels)
        return self


def _among(values: np.ndarray, kept: np.ndarray, step: int = 1 << 20) -> np.ndarray:
    """Which values are in the sorted ``kept``, a step at a time."""
    out = np.zeros(len(values), dtype=bool)
    for a in range(0, len(values) if len(kept) else 0, step):
        part = values[a : a + step]
        out[a : a + step] = kept[np.minimum(np.searchsorted(kept, part), len(kept) - 1)] == part
    return out


def _bias(z: np.ndarray, y: np.ndarray) -> float:
    """The bias that makes the fewest errors at score 0.5; of several, the middle one."""
    order = np.argsort(z, kind="stable")
    zs, ys = z[order], y[order]
    # Cutting before position i: positives below are missed, negatives above are false alarms.
    miss = np.concatenate(([0], np.cumsum(ys)))
    false = np.concatenate((np.cumsum((1 - ys)[::-1])[::-1], [0]))
    edges = np.concatenate(([zs[0] - 1], (zs[1:] + zs[:-1]) / 2, [zs[-1] + 1]))
    total = miss + false + (np.concatenate(([False], zs[1:] == zs[:-1], [False])) * len(z))
    best = np.flatnonzero(total == total.min())
    return -float((edges[best[0]] + edges[best[-1]]) / 2)


def families(flat: np.ndarray, off: np.ndarray, bands: int = 4, depth: int = 6) -> np.ndarray:
    """A family number per text; texts whose features mostly agree (min-hash bands) share one."""
    parent = list(range(len(off) - 1))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    some = np.flatnonzero(np.diff(off) > 0)
    r = np.random.default_rng(5)
    for _ in range(bands if len(some) else 0):
        sign = np.zeros((len(some), depth), dtype=np.uint32)
        for d in range(depth):
            h = flat.astype(np.uint32)
            h *= np.uint32(r.integers(1, 1 << 31) * 2 + 1)
            h += np.uint32(r.integers(0, 1 << 32))
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x2C1B3C6D)
            sign[:, d] = np.minimum.reduceat(h, off[:-1][some])
        first: dict[bytes, int] = {}
        for i, key in zip(some.tolist(), map(bytes, sign)):
            parent[root(i)] = root(first.setdefault(key, i))
    return np.array([root(i) for i in range(len(parent))], dtype=np.int64)


def telling(flat: np.ndarray, off: np.ndarray, labels: np.ndarray, share: float = 0.02, least: int = 3) -> np.ndarray:
    """Sorted features that positive texts have more often than chance.

    Copies and near copies count once (a family's label is its maximum), so that the words of one much
    copied text do not pass. Chance is bounded by the binomial tail, and Benjamini-Hochberg keeps the
    share of chance features below ``share``.
    """
    family = families(flat, off)
    of = np.zeros(len(family), dtype=np.int64)
    np.maximum.at(of, family, labels)
    heads = np.unique(family)
    p0 = float(of[heads].mean())
    # Features of fewer rows than ``least`` cannot pass, and most are such: they go before the large arrays.
    ordered = np.sort(flat)
    ends = max(0, len(ordered) - least + 1)
    often = np.unique(ordered[:ends][ordered[:ends] == ordered[len(ordered) - ends :]])
    del ordered
    some = np.flatnonzero(_among(flat, often))
    both = np.unique(flat[some].astype(np.int64) * len(family) + family[np.searchsorted(off, some, "right") - 1])
    feature, fam = both // len(family), both % len(family)
    seen, place = np.unique(feature, return_inverse=True)
    n = np.bincount(place)
    t = np.bincount(place, of[fam])
    q = t / n
    with np.errstate(divide="ignore", invalid="ignore"):
        kl = np.where(q > 0, q * np.log(q / p0), 0) + np.where(q < 1, (1 - q) * np.log((1 - q) / (1 - p0)), 0)
    logp = np.where(q > p0, -n * kl, 0.0)
    test = np.flatnonzero(n >= least)
    order = test[np.argsort(logp[test], kind="stable")]
    passed = np.flatnonzero(logp[order] <= np.log(share * np.arange(1, len(order) + 1) / max(1, len(order))))
    return np.sort(seen[order[: passed[-1] + 1]]) if len(passed) else np.zeros(0, np.int64)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = 8_000) -> ToxicityModel:
    """Character counts cover all documents and every trigram; the regression uses at most ``max_rows`` labelled rows
    (the lowest id hashes among those with crc32 of the id as text not 0 modulo 5)."""
    got = materialise(count_trigrams(docs, text_col), "trigrams").toArrow()
    model = ToxicityModel(CharModel(dict(zip(got["gram"].to_pylist(), got["n"].to_pylist()))))
    known = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & (F.crc32(F.col(id_col).cast("string")) % 5 != 0))
    known = known.groupBy(id_col).agg(F.max(label_col).alias("y")).orderBy(F.xxhash64(F.col(id_col).cast("string")), id_col).limit(max_rows)
    src = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("t")).join(F.broadcast(known.select(F.col(id_col).alias("id"), "y")), "id")
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = map_text(src, "t", ["y"], struct(f="int[]"), lambda texts: [sent.value.extract(texts)]).toArrow()
    y = np.array(rows["y"].to_pylist(), dtype=np.int64)
    chunks = rows["f"].chunks
    del rows
    off = doc_offsets(np.concatenate([np.zeros(0, np.int64), *(np.diff(c.offsets.to_numpy()) for c in chunks)]))
    flat = np.concatenate([np.zeros(0, np.int32), *(c.flatten().to_numpy() for c in chunks)])
    del chunks
    return model.fit(flat, off, y)


def score(docs: DataFrame, model: ToxicityModel, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` plus score and predicted (1 from 0.5 on) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def compute(texts):
        s = sent.value.score(texts)
        return [s, (s >= 0.5).astype(np.int32)]

    return map_text(docs, text_col, keep, struct(score="double", predicted="int"), compute)


def restore(docs: DataFrame, model: ToxicityModel, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` plus restored: the plain words of every text, joined by blanks (null for null)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return map_text(docs, text_col, keep, struct(restored="string"), lambda texts: [[None if t is None else " ".join(sent.value.restorer.words(t.decode("utf-8", "replace"))) for t in texts]])
