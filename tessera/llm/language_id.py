"""Language identification by interpolated Kneser-Ney character models.

One model of order 4 per language over lower-cased letters, where every run of other characters is one
space. The highest order uses raw counts, lower orders use continuation counts. A model is a pair of
sorted key arrays per order (grams with their interpolated log probability, contexts with their
log back-off weight), looked up by binary search. The language of a text is the one of the lowest
cross-entropy per character; a text whose cross-entropy is above the calibrated limit of its language
is rejected.

The models are sent out in shards of bounded size, each scored in a pass of its own; a document's language
is chosen over all shards.

Defined cases: null text, empty text and text with no letter give ``und`` with score 0 and are not
accepted; without any training row every text does. Null ``lang`` rows are not learned from. Ties go to
the language that sorts first. Repeated rows are counted as often as they occur. Other columns are
ignored, whatever their names. Long texts are scored whole; an empty table gives an empty result.
"""

from __future__ import annotations

import sys
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm._util import beside, doc_offsets, map_text, materialise, slices, struct, sum_by_run, texts_of

ORDER = 4
#: Bytes of models that are broadcast at once; a larger language is a shard of its own.
SHARD_BYTES = 512 << 20
_MASKS = [np.uint64(0), np.uint64(0xFFFF), np.uint64(0xFFFFFFFF), np.uint64(0xFFFFFFFFFFFF), np.uint64(0xFFFFFFFFFFFFFFFF)]
_letters: np.ndarray | None = None


def _letter_table() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), dtype=bool, count=sys.maxunicode + 1)
    return _letters


def grams(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Packed 4-grams (newest character in the low 16 bits) of all texts in a row, and their offsets.

    A character is its code point folded to 16 bits, 0 for a run of non-letters; before the text are
    zeros. A text without letters has no grams.
    """
    low = [t.decode("utf-8", "replace").lower() if t else "" for t in texts]
    off = doc_offsets([len(s) for s in low])
    cp = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    if not len(cp):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    letter = _letter_table()[cp]
    before = np.empty_like(letter)
    before[0], before[1:] = False, letter[:-1]
    before[off[:-1][off[:-1] < len(cp)]] = False
    kept = letter | before
    doc_off = np.concatenate(([0], np.cumsum(kept)))[off]
    ch = np.where(letter, (cp & 0xFFFF) ^ (cp >> 16) * 0x9E37 & 0xFFFF, 0)[kept].astype(np.uint64)
    at = np.arange(len(ch)) - np.repeat(doc_off[:-1], np.diff(doc_off))
    code = ch.copy()
    for k in range(1, ORDER):
        past = np.zeros_like(ch)
        past[k:] = ch[:-k] if k < len(ch) else 0
        past[at < k] = 0
        code |= past << np.uint64(16 * k)
    return code, doc_off


class KneserNey:
    """The interpolated model of one language, from its distinct 4-grams and their counts."""

    def __init__(self, code: np.ndarray, count: np.ndarray, vocabulary: int, discount: float = 0.75):
        order = np.argsort(code)
        code, count = code[order], count[order].astype(np.float64)
        levels = [(code, count)]
        for n in range(ORDER - 1, 0, -1):  # continuation counts: distinct one-longer grams with this suffix
            levels.append(_totals(levels[-1][0] & _MASKS[n], np.ones(len(levels[-1][0]))))
        levels.reverse()
        self.floor = 1.0 / (vocabulary + 1)
        self.keys, self.logp, self.ctx, self.logb = [], [], [], []
        lower = np.full(len(levels[0][0]), self.floor)
        for n in range(1, ORDER + 1):
            key, c = levels[n - 1]
            ctx, inv = np.unique(key >> np.uint64(16), return_inverse=True)
            total, kinds = np.bincount(inv, c, len(ctx)), np.bincount(inv, minlength=len(ctx))
            back = discount * kinds / total
            if n > 1:
                lower = np.exp(self._at(key & _MASKS[n - 1], n - 1))
            p = np.maximum(c - discount, 0) / total[inv] + back[inv] * lower
            self.keys.append(key)
            self.logp.append(np.log(p))
            self.ctx.append(ctx)
            self.logb.append(np.log(back))

    def _at(self, code: np.ndarray, n: int) -> np.ndarray:
        if n == 0:
            return np.full(len(code), np.log(self.floor))
        out, hit = _lookup(self.keys[n - 1], self.logp[n - 1], code)
        miss = np.flatnonzero(~hit)
        if len(miss):
            back, known = _lookup(self.ctx[n - 1], self.logb[n - 1], code[miss] >> np.uint64(16))
            out[miss] = np.where(known, back, 0.0) + self._at(code[miss] & _MASKS[n - 1], n - 1)
        return out

    @property
    def nbytes(self) -> int:
        return sum(a.nbytes for level in (self.keys, self.logp, self.ctx, self.logb) for a in level)

    def logprob(self, code: np.ndarray) -> np.ndarray:
        """Natural log probability of the newest character of each packed 4-gram."""
        return self._at(code, ORDER)


def _totals(key: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    u, inv = np.unique(key, return_inverse=True)
    return u, np.bincount(inv, weight, len(u))


def _lookup(keys: np.ndarray, values: np.ndarray, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(want)), np.zeros(len(want), bool)
    i = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
    hit = keys[i] == want
    return np.where(hit, values[i], 0.0), hit


def cross_entropies(texts: list[bytes | None], models: list[KneserNey]) -> tuple[np.ndarray, np.ndarray]:
    """Nats per character of each text under each model, and the characters of each text."""
    code, off = grams(texts)
    u, inv = np.unique(code, return_inverse=True)
    n = np.diff(off)
    out = np.zeros((len(texts), len(models)))
    for j, m in enumerate(models):
        out[:, j] = -sum_by_run(m.logprob(u)[inv], off) / np.maximum(n, 1)
    return out, n


class LanguageIdentifier:
    """Fitted models by language, with the rejection limit of each."""

    def __init__(self, langs: list[str], models: list[KneserNey]):
        self.langs, self.models = langs, models
        self.limits = [(np.inf, 0.0, 0.0)] * len(langs)  # mean, deviation times limit per character, per document

    def limit(self, best: np.ndarray, n: np.ndarray) -> np.ndarray:
        a = np.array(self.limits, dtype=float).reshape(-1, 3)[best]
        return a[:, 0] + np.sqrt(a[:, 1] ** 2 / np.maximum(n, 1) + a[:, 2] ** 2)

    def predict(self, texts: list[bytes | None]) -> tuple[list, np.ndarray, np.ndarray]:
        """Language (``und`` without letters), confidence in [0, 1] and whether the text is accepted."""
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
        return self.choose(*cross_entropies(texts, self.models))

    def choose(self, ce: np.ndarray, n: np.ndarray) -> tuple[list, np.ndarray, np.ndarray]:
        """:meth:`predict` from the cross-entropies under all models and the characters of each text."""
        best = ce.argmin(axis=1)
        low = ce[np.arange(len(ce)), best]
        share = 1.0 / np.exp(-(ce - low[:, None]) * np.minimum(n, 50)[:, None]).sum(axis=1)
        some = n > 0
        accepted = some & (low <= self.limit(best, n))
        return [self.langs[b] if s else "und" for b, s in zip(best, some)], np.where(some, share, 0.0), accepted

    def shards(self, size: int) -> list[list[int]]:
        """Languages in order, so many together as their models have ``size`` bytes (one at least)."""
        made: list[list[int]] = []
        held = 0
        for i, m in enumerate(self.models):
            if made and held + m.nbytes <= size:
                made[-1].append(i)
                held += m.nbytes
            else:
                made.append([i])
                held = m.nbytes
        return made

    def without_models(self) -> LanguageIdentifier:
        made = LanguageIdentifier(self.langs, [])
        made.limits = self.limits
        return made


def train_rows(docs: DataFrame, id_col: str, lang_col: str) -> DataFrame:
    """Rows to learn from: known language, and crc32 of the id as text not 2 modulo 4."""
    return docs.filter(F.col(lang_col).isNotNull() & (F.crc32(F.col(id_col).cast("string")) % 4 != 2))


def count_grams(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """(lang, gram, n) over every text; counted per slice first, then summed."""

    def run(batches):
        for whole in batches:
            for batch in slices(whole, 1, 4 << 20):
                lang = np.array(batch.column(0).to_pylist(), dtype=object)
                texts = texts_of(batch, 1)
                for one in sorted(set(lang)):
                    code, _ = grams([texts[i] for i in np.flatnonzero(lang == one)])
                    u, c = np.unique(code, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([one] * len(u), pa.string()), pa.array(u.view(np.int64)), pa.array(c.astype(np.int64))], names=["lang", "gram", "n"])

    src = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("t"))
    return src.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", slack: float = 1.5, strict: float = 0.001) -> LanguageIdentifier:
    """Learns all languages from all training rows and calibrates the rejection.

    Counts cover every training row, and every gram is in the model at any size. Grams are fetched one
    language at a time; the models together must fit the driver, and where they do not, the run fails.
    The rejection limits are set per language on all its training rows: the exact ``1 - strict`` quantile of
    the standardised excess of cross-entropy, times ``slack``.
    """
    rows = train_rows(docs, id_col, lang_col)
    counted = materialise(count_grams(rows, text_col, lang_col), "grams")
    langs = sorted(r["lang"] for r in counted.select("lang").distinct().collect())
    vocabulary = counted.agg(F.count_distinct(F.col("gram").bitwiseAND(F.lit(0xFFFF)))).first()[0]
    made = LanguageIdentifier(langs, [_model(counted, one, vocabulary) for one in langs])
    if langs:
        table = materialise(own_entropies(rows, made, text_col, lang_col), "entropies")
        limits = calibrate(table, slack, strict)
        made.limits = [limits[one] for one in langs]
    return made


def _model(counted: DataFrame, lang: str, vocabulary: int) -> KneserNey:
    got = counted.filter(F.col("lang") == lang).select("gram", "n").toArrow()
    return KneserNey(got["gram"].to_numpy().view(np.uint64), got["n"].to_numpy(), vocabulary)


def own_entropies(rows: DataFrame, model: LanguageIdentifier, text_col: str, lang_col: str, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(lang, ce, chars) of every row with letters, under the model of its own language."""
    src = rows.select(F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").alias("t"))
    made = None
    for shard in model.shards(shard_bytes):
        sent = rows.sparkSession.sparkContext.broadcast({model.langs[i]: model.models[i] for i in shard})

        def run(batches, sent=sent):
            for whole in batches:
                for batch in slices(whole, 1):
                    lang = np.array(batch.column(0).to_pylist(), dtype=object)
                    texts = texts_of(batch, 1)
                    for one in sorted(set(lang) & set(sent.value)):
                        ce, n = cross_entropies([texts[i] for i in np.flatnonzero(lang == one)], [sent.value[one]])
                        some = n > 0
                        yield pa.RecordBatch.from_arrays([pa.array([one] * int(some.sum()), pa.string()), pa.array(ce[some, 0]), pa.array(n[some])], names=["lang", "ce", "chars"])

        part = src.filter(F.col("lang").isin([model.langs[i] for i in shard])).mapInArrow(run, "lang string, ce double, chars long")
        made = part if made is None else made.union(part)
    return made


def calibrate(table: DataFrame, slack: float, strict: float) -> dict[str, tuple[float, float, float]]:
    """By language: mean, and the deviations per character and per document that bound clean texts."""
    sizes = {r["lang"]: r["count"] for r in table.groupBy("lang").count().collect()}
    mean = quantiles(table, sizes, lambda one, ce, n: ce, 0.5)
    by_char = quantiles(table, sizes, lambda one, ce, n: n * (ce - mean[one]) ** 2, 0.5)
    by_doc = quantiles(table, sizes, lambda one, ce, n: np.abs(ce - mean[one]), 0.5)
    per_char = {one: float(np.sqrt(v / 0.455)) + 0.5 for one, v in by_char.items()}
    per_doc = {one: v * 1.5 + 0.05 for one, v in by_doc.items()}
    z = quantiles(table, sizes, lambda one, ce, n: (ce - mean[one]) / np.sqrt(per_char[one] ** 2 / n + per_doc[one] ** 2), 1 - strict)
    k = {one: slack * max(4.0, v) for one, v in z.items()}
    return {one: (mean[one], k[one] * per_char[one], k[one] * per_doc[one]) for one in sizes}


def quantiles(table: DataFrame, sizes: dict[str, int], value: Callable, q: float) -> dict[str, float]:
    """The exact quantile of ``value(lang, ce, chars)`` by language, between neighbours in proportion."""
    place = {one: q * (m - 1) for one, m in sizes.items()}
    found = order_statistics(table, value, {one: {int(x), min(int(x) + 1, sizes[one] - 1)} for one, x in place.items()})
    return {one: min(v.values()) + (max(v.values()) - min(v.values())) * (place[one] - int(place[one])) for one, v in found.items()}


def order_statistics(table: DataFrame, value: Callable, ranks: dict[str, set[int]]) -> dict[str, dict[int, float]]:
    """The values at the given ranks (from 0) of each language.

    Three counting passes find the leading 24, the next 20 and the last 20 bits of a value; only counts
    are shuffled, and no task or driver holds a language's values.
    """
    high = np.uint64(1 << 63)
    at = {one: {r: (0, 0) for r in wanted} for one, wanted in ranks.items()}  # leading bits, rows below them
    for known, shift in ((64, 40), (40, 20), (20, 0)):

        def run(batches, at=at, known=known, shift=shift):
            for batch in batches:
                lang = np.array(batch.column(0).to_pylist(), dtype=object)
                ce, n = batch.column(1).to_numpy(), batch.column(2).to_numpy()
                for one in sorted(set(lang)):
                    pick = lang == one
                    bits = (np.asarray(value(one, ce[pick], n[pick]), dtype=np.float64) + 0.0).view(np.uint64)
                    bits = np.where(bits & high, ~bits, bits | high)  # in the order of the values
                    if known < 64:
                        bits = bits[np.isin(bits >> np.uint64(known), np.array([b for b, _ in at[one].values()], dtype=np.uint64))]
                    u, c = np.unique(bits >> np.uint64(shift), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([one] * len(u), pa.string()), pa.array(u.view(np.int64)), pa.array(c.astype(np.int64))], names=["lang", "bits", "n"])

        got = table.mapInArrow(run, "lang string, bits long, n long").groupBy("lang", "bits").agg(F.sum("n").alias("n")).toArrow()
        after = {}
        for one, wanted in at.items():
            part = got.filter(pc.equal(got["lang"], one))
            bits, n = part["bits"].to_numpy().view(np.uint64), part["n"].to_numpy()
            order = np.argsort(bits)
            bits, n = bits[order], n[order]
            after[one] = {}
            for r, (lead, below) in wanted.items():
                mine = bits >> np.uint64(known - shift) == lead if known < 64 else np.ones(len(bits), dtype=bool)
                total = below + np.cumsum(n[mine])
                i = int(np.searchsorted(total, r, side="right"))
                after[one][r] = int(bits[mine][i]), int(total[i] - n[mine][i])
        at = after
    back = lambda b: np.where(b & high, b ^ high, ~b).view(np.float64)
    return {one: {r: float(back(np.array([b], dtype=np.uint64))[0]) for r, (b, _) in found.items()} for one, found in at.items()}


def identify(docs: DataFrame, model: LanguageIdentifier, keep: list[str], text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``keep`` plus lang_pred, score and accepted for every row."""
    spark, out = docs.sparkSession, struct(lang_pred="string", score="double", accepted="boolean")
    shards = model.shards(shard_bytes)
    if len(shards) < 2:
        sent = spark.sparkContext.broadcast(model)
        return map_text(docs, text_col, keep, out, lambda texts: list(sent.value.predict(texts)))
    names = [f"c{i}" for i in range(len(keep))]
    held = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names)], F.col(f"`{text_col}`").alias("t"))
    entropies = [f"e{s}" for s in range(len(shards))]
    for s, shard in enumerate(shards):
        sent = spark.sparkContext.broadcast([model.models[i] for i in shard])

        def score(texts, sent=sent):
            ce, n = cross_entropies(texts, sent.value)
            return [list(ce), n]

        held = map_text(held, "t", [*names, "t", *entropies[:s]], struct(**{entropies[s]: "double[]", "n": "long"}), score).drop(*["n"] * (s + 1 < len(shards)))
    rest = spark.sparkContext.broadcast(model.without_models())
    src = held.select(*names, F.concat(*entropies).alias("ce"), "n")
    schema = T.StructType([*src.schema.fields[: len(names)], *out.fields])

    def choose(batches):
        for b in batches:
            k = len(names)
            ce = b.column(k).flatten().to_numpy().reshape(b.num_rows, -1)
            made = rest.value.choose(ce, b.column(k + 1).to_numpy())
            yield pa.RecordBatch.from_arrays([*b.columns[:k], *(pa.array(m, t) for m, t in zip(made, (pa.string(), pa.float64(), pa.bool_())))], names=schema.fieldNames())

    return src.mapInArrow(choose, schema).toDF(*beside(keep, out.fieldNames()), *out.fieldNames())
