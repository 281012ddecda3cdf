"""Secret scanning with a random forest that removes false positives.

Candidates are runs of at least 16 token characters with a digit among them. A forest of decision trees decides on
features of the candidate (length, character classes and transitions, dictionary coverage), of its path
and of the words beside it. It is trained from labelled findings; ``generated_findings`` makes a
reproducible set where none are at hand.

Defined cases: null and empty text has no candidates; a candidate is judged at each of its places;
overlong candidates are judged whole; null paths count as empty; repeated rows are scanned each for
itself; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import random
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm._util import beside, map_text, struct

MIN_LENGTH = 16
_RUN = re.compile(rb"[A-Za-z0-9_\-+/=]{16,}")
_DIGITS = b"0123456789"

#: Words of identifiers and prose that ordinary long tokens are made of.
DICTIONARY = (
    "account", "action", "address", "admin", "allow", "application", "archive", "array", "article", "asset", "author", "backup", "batch", "binary", "block", "branch",
    "browser", "buffer", "build", "button", "cache", "chapter", "character", "check", "class", "client", "cloud", "cluster", "code", "column", "comment", "commit",
    "common", "component", "config", "connect", "console", "content", "context", "control", "count", "create", "custom", "data", "database", "date", "debug", "default",
    "delete", "deploy", "detail", "device", "directory", "document", "domain", "download", "driver", "element", "email", "enable", "engine", "entry", "error", "event",
    "example", "export", "field", "file", "filter", "folder", "format", "frame", "function", "global", "graph", "group", "handler", "header", "height", "history",
    "home", "host", "image", "import", "index", "info", "input", "install", "instance", "item", "label", "language", "layout", "length", "level", "library", "license",
    "limit", "line", "link", "list", "local", "location", "login", "manager", "master", "message", "method", "model", "module", "name", "network", "node", "number",
    "object", "option", "order", "output", "package", "page", "parent", "path", "payment", "plugin", "policy", "port", "process", "product", "profile", "project",
    "public", "query", "record", "region", "release", "report", "request", "resource", "response", "result", "sample", "schema", "screen", "script", "search", "section",
    "server", "service", "session", "setting", "source", "status", "string", "style", "support", "system", "table", "target", "template", "test", "text", "title",
    "type", "update", "user", "value", "version", "view", "width", "window",
)
#: Words beside a candidate, and parts of a path.
ASSIGNING = ("secret", "token", "password", "passwd", "pwd", "apikey", "api_key", "auth", "credential", "private", "access", "bearer", "key")
HARMLESS = ("commit", "sha", "md5", "checksum", "uuid", "guid", "version", "example", "sample", "build", "hash", "digest", "phone", "order", "isbn", "revision", "etag")
PLAIN_PATHS = ("test", "example", "doc", "spec", "lock", "fixture", "sample", "vendor", "dist")
PREFIXES = (b"AKIA", b"ASIA", b"ghp_", b"gho_", b"sk-", b"sk_live", b"xox", b"AIza", b"eyJ", b"glpat-", b"npm_")


@dataclass(frozen=True)
class Finding:
    candidate: bytes
    before: bytes
    after: bytes
    path: str = ""


def candidates(text: bytes | None, path: str = "") -> list[tuple[int, Finding]]:
    """(byte offset, finding) of every candidate of a whole text."""
    found, at = [], 0
    for word in text.split() if text else []:
        if len(word) < MIN_LENGTH:
            continue
        # Past every long word, so that its next copy is found at its own place.
        here = text.index(word, at)
        at = here + len(word)
        for m in _RUN.finditer(word):
            c = m.group()
            if len(c.translate(None, _DIGITS)) == len(c):
                continue
            start = here + m.start()
            found.append((start, Finding(c, text[max(0, start - 40) : start], text[start + len(c) : start + len(c) + 24], path)))
            if m.end() == len(word):
                break
    return found


def _classes(c: bytes) -> np.ndarray:
    a = np.frombuffer(c, dtype=np.uint8)
    out = np.full(len(a), 3)
    out[(a >= 97) & (a <= 122)] = 0
    out[(a >= 65) & (a <= 90)] = 1
    out[(a >= 48) & (a <= 57)] = 2
    return out


def _bigrams(words) -> np.ndarray:
    """Log probabilities of letter transitions in the dictionary's words."""
    n = np.full((26, 26), 0.5)
    for w in words:
        a = np.frombuffer(w.encode(), dtype=np.uint8) - 97
        np.add.at(n, (a[:-1], a[1:]), 1)
    return np.log(n / n.sum(axis=1, keepdims=True))


_MOVES = _bigrams(DICTIONARY)
_DICT = re.compile("|".join(sorted(DICTIONARY, key=len, reverse=True)))


def describe(f: Finding) -> list[float]:
    """The features of one finding."""
    c = f.candidate
    n = len(c)
    k = _classes(c)
    share = np.bincount(k, minlength=4) / n
    low = c.lower()
    a = np.frombuffer(low, dtype=np.uint8).astype(int) - 97
    both = (k[:-1] < 2) & (k[1:] < 2)
    moves = float(_MOVES[a[:-1][both], a[1:][both]].mean()) if both.any() else -5.0
    counts = np.unique(np.frombuffer(c, dtype=np.uint8), return_counts=True)[1] / n
    covered = sum(len(x) for x in _DICT.findall(low.decode())) / n
    is_hex = not low.translate(None, b"0123456789abcdef")
    before, after, path = f.before.lower().decode("utf-8", "replace"), f.after.lower().decode("utf-8", "replace"), f.path.lower()
    near = before[-24:]
    return [
        n, *share, float((k[1:] != k[:-1]).mean()), moves, float(-(counts * np.log2(counts)).sum()), covered, float(is_hex), float(not c.translate(None, _DIGITS)),
        float(any(c.startswith(p) for p in PREFIXES)), float(low.count(b"-") + low.count(b"_")), float(low.count(b"/")), float(any(w in near for w in ASSIGNING)),
        float(any(w in near for w in HARMLESS)), float(bool(re.search(r"[=:]\s*[\"']?$", near))), float(near[-1:] in "\"'" and after[:1] in "\"'" and near[-1:] != ""),
        float(any(w in path for w in PLAIN_PATHS)), float(len(set(c)) <= 6),
    ]


class Forest:
    """Decision trees on bootstrap samples, each split chosen among a few features by Gini impurity."""

    def __init__(self, trees: int = 40, depth: int = 9, seed: int = 7):
        self.size, self.depth, self.random, self.trees = trees, depth, np.random.default_rng(seed), []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Forest:
        for _ in range(self.size):
            i = self.random.integers(0, len(y), len(y))
            self.trees.append(self._grow(x[i], y[i], self.depth))
        return self

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int):
        p = float(y.mean())
        if depth == 0 or p in (0.0, 1.0) or len(y) < 6:
            return p
        best = None
        for f in self.random.choice(x.shape[1], max(1, int(np.sqrt(x.shape[1]))), replace=False):
            order = np.argsort(x[:, f], kind="stable")
            v, c = x[order, f], np.cumsum(y[order])
            cut = np.flatnonzero(v[1:] > v[:-1])
            if not len(cut):
                continue
            left, n = cut + 1.0, float(len(y))
            a, b = c[cut] / left, (c[-1] - c[cut]) / (n - left)
            gini = left * a * (1 - a) + (n - left) * b * (1 - b)
            k = int(gini.argmin())
            if best is None or gini[k] < best[0]:
                best = (float(gini[k]), int(f), float(v[cut[k]] + v[cut[k] + 1]) / 2)
        if best is None:
            return p
        side = x[:, best[1]] <= best[2]
        return best[1], best[2], self._grow(x[side], y[side], depth - 1), self._grow(x[~side], y[~side], depth - 1)

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Mean share of positives in the leaves."""
        out = np.zeros(len(x))
        for tree in self.trees:
            self._fall(tree, x, np.arange(len(x)), out)
        return out / max(1, len(self.trees))

    def _fall(self, node, x: np.ndarray, rows: np.ndarray, out: np.ndarray) -> None:
        if not isinstance(node, tuple):
            out[rows] += node
        elif len(rows):
            side = x[rows, node[0]] <= node[1]
            self._fall(node[2], x, rows[side], out)
            self._fall(node[3], x, rows[~side], out)


def generated_findings(n: int = 4000, seed: int = 11) -> tuple[list[Finding], np.ndarray]:
    """Labelled findings made by rule: random keys where keys are assigned, against look-alikes."""
    r = random.Random(seed)
    pick = lambda alphabet, k: "".join(r.choice(alphabet) for _ in range(k))
    hexa, alnum = "0123456789abcdef", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    words = lambda k, sep: sep.join(r.choice(DICTIONARY) for _ in range(k))
    prose = lambda: " ".join(pick("etaoinshrdlu", r.randint(2, 8)) for _ in range(4)) + " "
    found, labels = [], []
    for i in range(n):
        good = i % 2 == 0
        path = f"src{r.randint(0, 30)}" if r.random() < 0.7 else r.choice(["app/settings.py", "deploy/env", "tests/fixture.json", "docs/example.md", "package.lock"])
        if good:
            kind = r.random()
            if kind < 0.35:
                c = pick(hexa, r.choice([32, 40, 40, 48, 64]))
            elif kind < 0.55:
                c = r.choice(["AKIA", "ASIA"]) + pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16)
            elif kind < 0.75:
                c = r.choice(["ghp_", "sk-", "sk_live_", "glpat-", "xoxb-"]) + pick(alnum, r.randint(20, 40))
            else:
                c = pick(alnum + "+/_-", r.randint(20, 44))
            c = c.upper() if r.random() < 0.1 else c
            name = r.choice(["token", "secret", "password", "api_key", "access_key", "TOKEN", "auth"])
            start, end = r.choice([(f'{name} = "', '"'), (f"{name}=", " "), (f"{name}: ", " "), (f'"{name}": "', '"')]) if kind < 0.35 or kind >= 0.75 or r.random() < 0.5 else (prose(), " ")
        else:
            kind = r.random()
            if kind < 0.2:
                c, start, end = pick("0123456789", r.choice([16, 16, 18, 20])), prose(), " "
            elif kind < 0.4:
                c, start, end = words(r.randint(2, 4), r.choice(["_", "-", "/", ""])) + pick("0123456789", r.randint(1, 4)), prose(), " "
            elif kind < 0.55:
                c = "-".join(pick(hexa, k) for k in (8, 4, 4, 4, 12))
                start, end = r.choice(["uuid: ", "id = ", prose()]), " "
            elif kind < 0.75:
                c = pick(hexa, r.choice([32, 40, 64]))
                start, end = r.choice(["commit ", "sha256:", "md5 ", "checksum = ", "etag: ", "hash "]), " "
            elif kind < 0.88:
                c = r.choice(["x" * 20 + "1", "0" * 20, "1234567890123456", "your_token_here_123", "changeme12345678"])
                start, end = r.choice(["token = ", 'password="', prose()]), " "
            else:
                c, start, end = "/".join([words(1, ""), "v" + pick("0123456789", 1), words(2, "-")]) + pick("0123456789", 2), "path: ", " "
        found.append(Finding(c.encode(), (prose() + start).encode()[-40:], end.encode(), path))
        labels.append(int(good))
    return found, np.array(labels)


def train(findings: list[Finding], labels: np.ndarray, **options) -> Forest:
    return Forest(**options).fit(np.array([describe(f) for f in findings], dtype=float), np.asarray(labels, dtype=float))


def scan(docs: DataFrame, forest: Forest, keep: list[str], text_col: str = "text", path_col: str | None = None, least: float = 0.5) -> DataFrame:
    """``keep`` plus n_candidates, secrets (start and length in bytes, probability) and redacted_sha256."""
    sent = docs.sparkSession.sparkContext.broadcast(forest)
    kind = T.ArrayType(struct(start="long", length="long", probability="double"))
    out = struct(n_candidates="long", secrets=kind, redacted_sha256="string")
    # The path travels before the text, after its length in bytes.
    path = F.coalesce(F.col(f"`{path_col}`").cast("string"), F.lit("")) if path_col else F.lit("")
    text = F.when(F.col(f"`{text_col}`").isNotNull(), F.concat(F.octet_length(path).cast("string"), F.lit(" "), path, F.col(f"`{text_col}`")))
    with_path = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)], text.alias("t"))

    def compute(texts):
        split = [_parted(t) for t in texts]
        found = [candidates(t, p.decode("utf-8", "replace")) for p, t in split]
        rows = [describe(f) for x in found for _, f in x]
        p = sent.value.predict(np.array(rows, dtype=float)) if rows else np.zeros(0)
        n, secrets, digests, k = [], [], [], 0
        for (_, t), x in zip(split, found):
            made = []
            for start, f in x:
                if p[k] >= least:
                    made.append({"start": start, "length": len(f.candidate), "probability": float(p[k])})
                k += 1
            n.append(len(x))
            secrets.append(made)
            digests.append(None if t is None else hashlib.sha256(redact(t, made)).hexdigest())
        return [n, secrets, digests]

    found = map_text(with_path, "t", [f"c{i}" for i in range(len(keep))], out, compute)
    return found.toDF(*beside(keep, out.fieldNames()), *out.fieldNames())


def _parted(sent: bytes | None) -> tuple[bytes, bytes | None]:
    """Path and text of what :func:`scan` sends."""
    if sent is None:
        return b"", None
    size, _, rest = sent.partition(b" ")
    return rest[: int(size)], rest[int(size) :]


def redact(text: bytes, secrets: list[dict], mark: bytes = b"<SECRET>") -> bytes:
    """``text`` with the mark in the place of every secret; places must be in order and apart."""
    out, last = [], 0
    for s in secrets:
        if s["start"] < last:
            raise ValueError("secrets overlap")
        out += [text[last : s["start"]], mark]
        last = s["start"] + s["length"]
    return b"".join([*out, text[last:]])
