"""Language identification with interpolated Kneser-Ney character models, one per language, in sorted hash arrays.

A text is its letters in lower case, with one boundary for every run of other characters. Models of order 4 are estimated
from a sample of the labelled rows, about ``per_language`` of each language (the bound of what is learned from and of the model's
size); n-grams of that sample are counted by Spark, and the models are the same for any order of the rows.

What is looked up for an n-gram is kept for all languages at once: sorted hashes, and beside each a row of log
probabilities (or of back-off weights) with a column for every language. A position whose 4-gram no language has seen falls back
to the weight of its context and the next shorter n-gram.

The language with the lowest cross-entropy per position is chosen. The score is a softmax of the negative cross-entropies, sharpened by a
factor fitted on the training sample; a text is rejected if its cross-entropy lies above what ``1 - REJECTED`` of its language's training
texts have, or if its score is below ``least_score``.

Cases: null texts and texts without a letter are ``und`` with score 0 and rejected; ties go to the first language in order; rows without
a label teach nothing; without any labelled row every text is ``und``; every row gives a row, repeated ones and null
ids too; very long texts are read whole; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import col, mixed, text_slices

ORDER = 4
PER_LANGUAGE = 500
REJECTED = 0.001
UNKNOWN = "und"
_FACTORS = mixed(np.arange(11, 11 + ORDER, dtype=np.uint64)) | np.uint64(1)
_SHARPNESS = (1.0, 2.0, 4.0, 8.0, 16.0, 32.0, 64.0)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Is a code point a letter?"""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def code_points(text: str | None) -> np.ndarray:
    """Letters in lower case as code points, 0 for the boundary between and around them; empty without a letter."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letters = _letters()[points]
    if not letters.any():
        return np.empty(0, np.uint32)
    points = np.where(letters, points, 0)
    keep = np.ones(len(points), bool)
    keep[1:] = letters[1:] | letters[:-1]
    points = points[keep]
    start, end = int(points[0] == 0), len(points) - int(points[-1] == 0)
    return np.concatenate([points[start:end], [np.uint32(0)]])


def gram_hashes(points: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n-gram that ends at each point; points before the first are boundaries."""
    x = np.concatenate([np.zeros(n - 1, np.uint64), points.astype(np.uint64)])
    total = np.full(len(points), n, np.uint64)
    for k in range(n):
        total += (x[k : k + len(points)] + np.uint64(1)) * _FACTORS[k]
    return mixed(total)


def _one_hash(gram: str) -> int:
    """The hash of a single n-gram, its boundaries written as NUL."""
    points = np.array([ord(c) for c in gram], np.uint64)
    total = np.uint64(len(gram))
    with np.errstate(over="ignore"):
        for k, p in enumerate(points):
            total = total + (p + np.uint64(1)) * _FACTORS[k]
    return int(mixed(np.array([total], np.uint64))[0])


class SortedTable:
    """Rows of values found by hash in a sorted array."""

    def __init__(self, rows: dict[str, np.ndarray], columns: int):
        hashes = np.array([_one_hash(g) for g in rows], np.uint64)
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        self.values = np.array(list(rows.values()), np.float32).reshape(len(rows), columns)[order]

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers, and whether each hash is there."""
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return at, self.hashes[at] == hashes


class KneserNey:
    """Interpolated Kneser-Ney over one language's n-gram counts; grams are strings with NUL as boundary."""

    def __init__(self, counts: dict[str, int], alphabet: int):
        self.alphabet = alphabet
        levels: dict[int, dict[str, int]] = {ORDER: counts}
        for n in range(ORDER - 1, 0, -1):
            # How many characters come before an n-gram: distinct (n + 1)-grams that end in it.
            lower: dict[str, int] = {}
            for gram in levels[n + 1]:
                lower[gram[1:]] = lower.get(gram[1:], 0) + 1
            levels[n] = lower
        self.levels = levels
        self.discount, self.total, self.kinds = {}, {}, {}
        for n, grams in levels.items():
            once, twice = (sum(1 for c in grams.values() if c == k) for k in (1, 2))
            self.discount[n] = once / (once + 2 * twice) if once and twice else 0.5
            total: dict[str, int] = {}
            kinds: dict[str, int] = {}
            for gram, c in grams.items():
                total[gram[:-1]] = total.get(gram[:-1], 0) + c
                kinds[gram[:-1]] = kinds.get(gram[:-1], 0) + 1
            self.total[n], self.kinds[n] = total, kinds
        self.cache: dict[str, float] = {}

    def weight(self, context: str) -> float:
        """What the next shorter model gets after a context; all of it if the context was never seen."""
        n = len(context) + 1
        total = self.total[n].get(context, 0)
        return self.discount[n] * self.kinds[n][context] / total if total else 1.0

    def p(self, gram: str) -> float:
        if not gram:
            return 1 / self.alphabet
        found = self.cache.get(gram)
        if found is None:
            n, context = len(gram), gram[:-1]
            total = self.total[n].get(context, 0)
            seen = max(self.levels[n].get(gram, 0) - self.discount[n], 0) / total if total else 0.0
            found = self.cache[gram] = seen + self.weight(context) * self.p(gram[1:])
        return found


class LanguageModels:
    def __init__(self, counts: dict[str, dict[str, int]]):
        self.names = sorted(counts)
        k = len(self.names)
        self.alphabet = len({c for grams in counts.values() for g in grams for c in g}) + 1
        models = [KneserNey(counts[name], self.alphabet) for name in self.names]
        self.grams, self.contexts = {}, {}
        for n in range(1, ORDER + 1):
            known = sorted({g for m in models for g in m.levels[n]})
            self.grams[n] = SortedTable({g: np.log([m.p(g) for m in models]) for g in known}, k)
            contexts = sorted({g[:-1] for g in known})
            self.contexts[n] = SortedTable({c: np.log([m.weight(c) for m in models]) for c in contexts}, k) if n > 1 else None
            if n == 1:
                self.unseen = np.log([m.weight("") / self.alphabet for m in models]).astype(np.float32)
        self.sharpness = 1.0
        self.highest = np.full(k, np.inf)

    def cross_entropies(self, texts: list[np.ndarray]) -> np.ndarray:
        """A row for each text (none empty) and a column for each language: nats per position."""
        points = np.concatenate(texts)
        sizes = np.array([len(t) for t in texts])
        # Boundaries between texts: contexts must not reach back into the text before.
        starts = np.cumsum(sizes) - sizes
        padded = np.zeros(len(points) + (ORDER - 1) * len(texts), np.uint32)
        own = np.arange(len(points)) + np.repeat((ORDER - 1) * np.arange(1, len(texts) + 1), sizes)
        padded[own] = points
        out = np.zeros((len(points), len(self.names)), np.float32)
        left = np.arange(len(points))
        for n in range(ORDER, 0, -1):
            at, there = self.grams[n].find(gram_hashes(padded, n)[own[left]])
            out[left[there]] += self.grams[n].values[at[there]]
            left = left[~there]
            if not len(left):
                break
            if n > 1:
                at, there = self.contexts[n].find(gram_hashes(padded, n - 1)[own[left] - 1])
                out[left[there]] += self.contexts[n].values[at[there]]
            else:
                out[left] += self.unseen
        return -np.add.reduceat(out.astype(np.float64), starts, axis=0) / sizes[:, None]

    def calibrate(self, entropies: np.ndarray, labels: np.ndarray) -> None:
        """Sharpness by likelihood, and for each language the cross-entropy beyond which a text is rejected."""
        def loss(s: float) -> float:
            z = -s * (entropies - entropies.min(axis=1, keepdims=True))
            return float(np.mean(np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(z)), labels]))

        self.sharpness = min(_SHARPNESS, key=lambda s: (round(loss(s), 9), s))
        for k in range(len(self.names)):
            own = entropies[labels == k, k]
            if len(own):
                self.highest[k] = float(np.quantile(own, 1 - REJECTED)) + 0.1

    def predict(self, texts: list[str | None], least_score: float) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, score, cross-entropy and rejection of each text."""
        points = [code_points(t) for t in texts]
        full = [i for i, p in enumerate(points) if len(p)] if self.names else []
        best, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
        entropy, rejected = np.full(len(texts), np.nan), np.ones(len(texts), bool)
        if full:
            h = self.cross_entropies([points[i] for i in full])
            k = h.argmin(axis=1)
            low = h[np.arange(len(h)), k]
            p = 1 / np.exp(-self.sharpness * (h - low[:, None])).sum(axis=1)
            for i, b in zip(full, k.tolist(), strict=True):
                best[i] = self.names[b]
            score[full], entropy[full] = p, low
            rejected[full] = (low > self.highest[k]) | (p < least_score)
        return best, score, entropy, rejected


def _sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, train: Column, per_language: int) -> DataFrame:
    """About ``per_language`` training rows of each language (lang, text), picked by a hash of the id."""
    rows = docs.where(train).select(col(id_col).alias("id"), col(text_col).alias("text"), col(lang_col).cast("string").alias("lang")).where("lang IS NOT NULL AND text IS NOT NULL")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    chosen = F.lit(False)
    spot = F.pmod(F.xxhash64(F.lit("language sample"), "id"), F.lit(1_000_000))
    for lang, n in sorted(sizes.items()):
        chosen = chosen | ((F.col("lang") == lang) & (spot < int(min(1.0, per_language / n) * 1_000_000)))
    return rows.where(chosen).select("lang", "text")


def fit(
    docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE,
) -> LanguageModels:
    sample = _sample(docs, id_col, text_col, lang_col, train, per_language)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for langs, texts in text_slices(batch.column(0), batch.column(1)):
                held: dict[str, dict[str, int]] = {}
                for lang, text in zip(langs.to_pylist(), texts.to_pylist(), strict=True):
                    own = held.setdefault(lang, {})
                    letters = "\0" * (ORDER - 1) + code_points(text).tobytes().decode("utf-32-le")
                    for k in range(len(letters) - ORDER + 1):
                        gram = letters[k : k + ORDER]
                        own[gram] = own.get(gram, 0) + 1
                rows = [(lang, gram, n) for lang, own in held.items() for gram, n in own.items()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())], ["lang", "gram", "n"],
                )

    grams = sample.mapInArrow(count, "lang string, gram string, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts: dict[str, dict[str, int]] = {}
    for row in grams.toLocalIterator():
        counts.setdefault(row["lang"], {})[row["gram"]] = row["n"]
    models = LanguageModels(counts)
    if models.names:
        shared = docs.sparkSession.sparkContext.broadcast(models)

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for langs, texts in text_slices(batch.column(0), batch.column(1)):
                    known = [(lang, p) for lang, t in zip(langs.to_pylist(), texts.to_pylist(), strict=True) if len(p := code_points(t))]
                    if known:
                        h = shared.value.cross_entropies([p for _, p in known])
                        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in known], pa.string()), pa.array(list(h), pa.list_(pa.float64()))], ["lang", "h"])

        measured = sample.mapInArrow(measure, "lang string, h array<double>").collect()
        if measured:
            models.calibrate(np.array([r["h"] for r in measured]), np.array([models.names.index(r["lang"]) for r in measured]))
    return models


def identify(docs: DataFrame, models: LanguageModels, id_col: str = "doc_id", text_col: str = "text", least_score: float = 0.5) -> DataFrame:
    """A row for each row of ``docs``: doc_id, lang_pred, score, cross_entropy, rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in text_slices(batch.column(0), batch.column(1), 1 << 20):
                best, score, entropy, rejected = shared.value.predict(texts.to_pylist(), least_score)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(best, pa.string()), pa.array(score), pa.array(entropy, pa.float64(), from_pandas=True), pa.array(rejected)],
                    ["doc_id", "lang_pred", "score", "cross_entropy", "rejected"],
                )

    kind = docs.select(col(id_col)).schema[0].dataType.simpleString()
    narrow = docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text"))
    return narrow.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, cross_entropy double, rejected boolean")
