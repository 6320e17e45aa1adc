"""Quality by Bradley-Terry ranking: scores are learned from pairs of a better and a worse document.

A document is described by shares of its whole text: kinds of characters, kinds of words, repetition of words and lines. Its strength
is w · x, and P(a is preferred to b) = 1 / (1 + exp(-w · (x_a - x_b))); w is fitted by logistic loss on the feature
differences of preference pairs. A pair is a training document labelled good and one labelled bad; every sampled document
meets ``rounds`` opponents, dealt by shifted order and not all with all.

The threshold is a quantile of the training documents' strengths: the one that, weighted as the labels are in the whole training data, leaves
the fewest on the wrong side. The score is 1 / (1 + exp(-(strength - threshold))), so 0.5 is the threshold.

Learning takes a bounded sample of labelled rows (about ``per_class`` of each class at most); every whole text is scored.

Cases: null, empty and blank texts have features of their own (no words) and a score like any other; rows without a label teach nothing;
without both classes every score is the share of good labels (0.5 without labels); repeated labels of an id count as
they are; every row gives a row, repeated ones and null ids too; an empty table gives an empty table.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import byte_lists, col, text_slices

PER_CLASS = 5000
ROUNDS = 4
RIDGE = 1e-3
LEAST = 1e-3  # shares are seen on a logarithmic scale from here on

_UPPER, _LOWER, _DIGIT, _SPACE, _LINE, _STOP, _MARK, _OTHER = range(8)


def _byte_kinds() -> np.ndarray:
    kinds = np.full(256, _OTHER)
    for kind, members in ((_UPPER, range(65, 91)), (_LOWER, range(97, 123)), (_DIGIT, range(48, 58)), (_SPACE, (32, 9)), (_LINE, (10, 13))):
        kinds[list(members)] = kind
    kinds[list(b".,;:'-")] = _STOP
    kinds[[b for b in range(33, 127) if kinds[b] == _OTHER]] = _MARK
    return kinds


_KINDS = _byte_kinds()
FEATURES = (
    "upper", "digit", "line", "stop", "mark", "other", "marked_words", "upper_words", "short_words", "long_words", "same_as_before", "repeated_words",
    "top_word", "repeated_pairs", "repeated_lines",
)


def shares(text: bytes) -> np.ndarray:
    """The shares that describe a text, then how long it is."""
    out = np.zeros(len(FEATURES) + 2)
    counts = np.bincount(_KINDS[np.frombuffer(text, np.uint8)], minlength=8) if text else np.zeros(8)
    words = text.split()
    n = len(words)
    if not n:
        return out
    filled = counts.sum() - counts[_SPACE]
    out[:6] = counts[[_UPPER, _DIGIT, _LINE, _STOP, _MARK, _OTHER]] / filled
    held = Counter(words)
    marked = upper = short = long = 0
    for w, k in held.items():
        last = w[-1]
        marked += k * (_KINDS[last] == _MARK)
        upper += k * (len(w) > 3 and w.isupper())
        short += k * (len(w) <= 2)
        long += k * (len(w) > 14)
    out[6:10] = marked / n, upper / n, short / n, long / n
    if n > 1:
        pairs = list(zip(words, words[1:], strict=False))
        out[10] = sum(a == b for a, b in pairs) / (n - 1)
        out[13] = 1 - len(set(pairs)) / (n - 1)
    out[11] = 1 - len(held) / n
    out[12] = max(held.values()) / n
    lines = [x for x in text.split(b"\n") if x]
    out[14] = 1 - len(set(lines)) / len(lines) if lines else 0.0
    out[15], out[16] = np.log1p(n), np.log1p(len(lines))
    return out


def expanded(x: np.ndarray) -> np.ndarray:
    """Feature rows from rows of shares: the shares, their logarithms, the lengths."""
    k = len(FEATURES)
    return np.hstack([x[:, :k], np.log(LEAST + x[:, :k]), x[:, k:], x[:, k:] ** 2 / 10])


@dataclass
class Ranking:
    weights: np.ndarray
    center: np.ndarray
    scale: np.ndarray
    threshold: float
    constant: float | None = None

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        strength = ((expanded(x) - self.center) / self.scale) @ self.weights
        return 1 / (1 + np.exp(-np.clip(strength - self.threshold, -40, 40)))


def pair_numbers(good: int, bad: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Each document of the larger class meets ``rounds`` of the other, a different one each time while there are such."""
    most = max(good, bad)
    k = np.repeat(np.arange(most), rounds)
    turn = np.tile(np.arange(rounds), most)
    other = (k + turn * max(1, min(good, bad) // rounds)) % min(good, bad)
    return (k, other) if good >= bad else (other, k)


def train(x: np.ndarray, labels: np.ndarray, share_good: float | None = None, rounds: int = ROUNDS) -> Ranking:
    """Fits the ranking on rows of shares and labels (1 good, 0 bad), of which ``share_good`` are good where they come from."""
    nothing = np.zeros(0)
    if len(labels) == 0 or labels.min() == labels.max():
        return Ranking(nothing, nothing, nothing, 0.0, float(labels[0]) if len(labels) else 0.5)
    share = float(np.mean(labels)) if share_good is None else share_good
    rows = expanded(x)
    center, scale = rows.mean(axis=0), rows.std(axis=0) + 1e-6
    rows = (rows - center) / scale
    good, bad = rows[labels == 1], rows[labels == 0]
    a, b = pair_numbers(len(good), len(bad), rounds)
    difference = good[a] - bad[b]
    w = np.zeros(rows.shape[1])

    def loss(w: np.ndarray) -> float:
        return float(np.logaddexp(0, -difference @ w).mean() + RIDGE / 2 * w @ w)

    for _ in range(50):
        p = 1 / (1 + np.exp(np.clip(difference @ w, -40, 40)))  # of the worse being preferred
        gradient = -(difference * p[:, None]).mean(axis=0) + RIDGE * w
        hessian = difference.T @ (difference * (p * (1 - p))[:, None]) / len(difference) + RIDGE * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        size = 1.0
        while loss(w - size * step) > loss(w) and size > 1e-4:
            size /= 2
        w = w - size * step
        if np.abs(step).max() < 1e-6:
            break
    strength = rows @ w
    quantiles = np.quantile(strength, np.linspace(0, 1, 1001))
    weight = np.where(labels == 1, share / np.mean(labels), (1 - share) / (1 - np.mean(labels)))
    wrong = [np.sum(weight * ((strength >= q) != (labels == 1))) for q in quantiles]
    least = np.flatnonzero(np.array(wrong) <= min(wrong) + 1e-9)
    return Ranking(w, center, scale, float(np.mean(quantiles[least])))


def measured(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id and the shares of its text, as an array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in text_slices(batch.column(0), batch.column(1)):
                rows = [shares(t) for t in byte_lists(texts)]
                yield pa.RecordBatch.from_arrays([ids, pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "shares"])

    kind = docs.select(col(id_col)).schema[0].dataType.simpleString()
    return docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, shares array<double>")


def fit(
    docs: DataFrame, labels: DataFrame, train_rows: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = PER_CLASS,
) -> Ranking:
    """Fits on about ``per_class`` training rows of each class, picked by a hash of the id."""
    narrow = labels.select(col(id_col).alias("id"), col(label_col).cast("int").alias("label")).where("label IN (0, 1) AND id IS NOT NULL")
    sizes = {r["label"]: r["n"] for r in narrow.groupBy("label").agg(F.count("*").alias("n")).collect()}
    spot = F.pmod(F.xxhash64(F.lit("quality sample"), "id"), F.lit(1_000_000))
    chosen = F.lit(False)
    for label, n in sorted(sizes.items()):
        chosen = chosen | ((F.col("label") == label) & (spot < int(min(1.0, per_class / n) * 1_000_000)))
    picked = narrow.where(chosen)
    # The picked labels are about 2 * per_class rows, whatever the size of the tables.
    own = docs.where(train_rows).select(col(id_col).alias("id"), col(text_col).alias("text")).join(F.broadcast(picked), "id")
    rows = measured(own.select(F.struct("id", "label").alias("id"), "text"), "id", "text").collect()
    rows.sort(key=lambda r: (str(r["doc_id"]["id"]), r["doc_id"]["label"], r["shares"]))
    x = np.array([r["shares"] for r in rows]).reshape(len(rows), len(FEATURES) + 2)
    return train(x, np.array([r["doc_id"]["label"] for r in rows]), sizes.get(1, 0) / max(1, sum(sizes.values())))


def score(docs: DataFrame, ranking: Ranking, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of ``docs``: doc_id, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in text_slices(batch.column(0), batch.column(1)):
                x = np.array([shares(t) for t in byte_lists(texts)])
                yield pa.RecordBatch.from_arrays([ids, pa.array(ranking.scores(x))], ["doc_id", "score"])

    kind = docs.select(col(id_col)).schema[0].dataType.simpleString()
    return docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, score double")


def accepted(docs: DataFrame, ranking: Ranking, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, whole and unshuffled, whose score is at least ``least``."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [shares((text.as_py() or "").encode()) for text in batch.column(at)]
            if x:
                yield batch.filter(pa.array(ranking.scores(np.array(x)) >= least))

    return docs.mapInArrow(run, docs.schema)
