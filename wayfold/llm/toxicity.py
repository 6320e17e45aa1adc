"""Toxicity by a linear-chain conditional random field over words.

Labels mark documents, so words are labelled first, from the training rows alone: a word of a toxic document is toxic if the word or
the beginning of it (4 to 6 letters) is found in so many toxic training documents, between so many different pairs of words, and in so few
clean ones that the chance of finding any such word by accident is below ``ACCIDENT``. Words of clean documents are clean.

The field has two states, toxic and clean. A word's features are itself and its beginnings, hashed into one array
of weights; four weights join the states of neighbours. It is fitted by gradient steps on the conditional likelihood, whose
gradient takes the marginals from forward-backward. The same marginals give the spans of a text (runs of words that are more
likely toxic) with their offsets, and a document score: a logistic function of the log odds of its strongest word and of the
evidence of all words, fitted on the training documents.

Learning takes a bounded sample of labelled rows (about ``per_class`` toxic and three times as many clean ones at most); scoring reads every whole text.

Cases: null, empty and blank texts have no words and get the score of a document without toxic words; rows without a label teach
nothing; without toxic or without clean training rows every score is the share of toxic labels (0 without labels); repeated labels of an id count as
they are; every row gives a row, repeated ones and null ids too; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import exp, lgamma, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import col, text_slices

PER_CLASS = 1500
CLEAN_FOR_TOXIC = 3
# Chance of any toxic word found by accident, and the share of toxic documents it must be in.
ACCIDENT, MOSTLY = 0.01, 0.4
BUCKETS = 1 << 20
BEGINNINGS = (3, 4, 5, 6)
STEPS, RATE, SHRINK = 30, 0.5, 1e-5
# Of clean texts the field learns from stretches of so many words: all that look like a toxic word, and every so manyth other.
STRETCH, EVERY = 64, 8
HELD_WORDS = 500_000
_WORD = re.compile(r"\S+")
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")


def core(word: str) -> str:
    """A word in lower case, without what is no letter or digit at its ends."""
    return _EDGE.sub("", word.lower())


def features(word: str) -> list[int]:
    """Numbers of the weights of a word (already its core)."""
    names = ["w" + word, *(f"b{n}{word[:n]}" for n in BEGINNINGS if len(word) >= n)]
    return [xxhash.xxh3_64_intdigest(x) % BUCKETS for x in names]


def _by_accident(hits: int, misses: int, rate: float) -> float:
    """Log of the probability of so few misses or fewer among hits + misses, if each is a hit with probability ``rate``."""
    n = hits + misses
    terms = [lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + (n - k) * log(rate) + k * log(1 - rate) for k in range(misses + 1)]
    top = max(terms)
    return top + log(sum(exp(t - top) for t in terms))


def toxic_vocabulary(texts: list[list[str]], toxic: list[int]) -> set[str]:
    """Words and beginnings ("word" or "begin*") that mark toxic documents."""
    kinds_of: dict[str, tuple[str, ...]] = {}

    def kinds(word: str) -> tuple[str, ...]:
        found = kinds_of.get(word)
        if found is None:
            found = kinds_of[word] = (word, *(word[:n] + "*" for n in BEGINNINGS[1:] if len(word) >= n))
        return found

    bad, good = Counter(), Counter()
    for words, label in zip(texts, toxic, strict=True):
        (bad if label else good).update({k for w in set(words) if w for k in kinds(w)})
    rate = sum(1 for t in toxic if t) / len(toxic)
    odds = rate / (1 - rate)
    # As many tests as kinds that could pass at all.
    limit = log(ACCIDENT) - log(max(1, sum(1 for n in bad.values() if n * log(rate) < log(ACCIDENT))))
    likely = {w for w, n in bad.items() if n * (1 - MOSTLY) >= MOSTLY * good[w] * odds and n * log(rate) < limit and _by_accident(n, good[w], rate) < limit}
    # Copies of a toxic document are no evidence: a word must stand between many different pairs of words.
    places: dict[str, set[tuple[str, str]]] = {w: set() for w in likely}
    for words, label in zip(texts, toxic, strict=True):
        if label:
            framed = ["", *words, ""]
            for k, w in enumerate(words):
                if w:
                    for kind in kinds(w):
                        if kind in places:
                            places[kind].add((framed[k], framed[k + 2]))
    return {w for w, at in places.items() if len(at) * log(rate) < limit}


class Crf:
    """Weights and the document score; ``emission`` is the log odds of a word alone."""

    def __init__(self) -> None:
        self.weights = np.zeros(BUCKETS, np.float32)
        self.bias = -4.0
        # Log potentials of neighbours: [state before, state], 0 clean and 1 toxic.
        self.joint = np.zeros((2, 2))
        self.score = np.array([0.0, 0.0, 0.0])
        self.constant: float | None = None

    def marginals(self, emissions: np.ndarray) -> np.ndarray:
        """P(toxic) of each word of one text: forward-backward on the ratio of the two states' messages."""
        n = len(emissions)
        if n == 0:
            return emissions
        cc, ct, tc, tt = np.exp(self.joint).ravel().tolist()
        e = np.exp(np.clip(emissions, -30, 30)).tolist()
        forward, r = [0.0] * n, e[0]
        forward[0] = r
        for i in range(1, n):
            r = e[i] * (ct + tt * r) / (cc + tc * r)
            forward[i] = r
        backward, b = [1.0] * n, 1.0
        for i in range(n - 2, -1, -1):
            r = e[i + 1] * b
            b = (tc + tt * r) / (cc + ct * r)
            backward[i] = b
        odds = np.array(forward) * np.array(backward)
        return odds / (1 + odds)

    def pair_marginals(self, emissions: np.ndarray) -> np.ndarray:
        """Expected counts of [state before, state], for the gradient."""
        out = np.zeros((2, 2))
        n = len(emissions)
        if n < 2:
            return out
        m = np.exp(self.joint)
        e = np.exp(np.clip(emissions, -30, 30))
        alpha = np.empty(n)
        alpha[0] = e[0]
        for i in range(1, n):
            alpha[i] = e[i] * (m[0, 1] + m[1, 1] * alpha[i - 1]) / (m[0, 0] + m[1, 0] * alpha[i - 1])
        beta = np.ones(n)
        for i in range(n - 2, -1, -1):
            r = e[i + 1] * beta[i + 1]
            beta[i] = (m[1, 0] + m[1, 1] * r) / (m[0, 0] + m[0, 1] * r)
        before, after = alpha[:-1], e[1:] * beta[1:]
        cells = np.stack([np.full(n - 1, m[0, 0]), m[0, 1] * after, before * m[1, 0], before * m[1, 1] * after])
        return (cells / cells.sum(axis=0)).sum(axis=1).reshape(2, 2)

    def signals(self, marginals: np.ndarray) -> tuple[float, float]:
        """Of a document: log odds of its strongest word, log of one and the evidence of all words (minus log of their being clean)."""
        if not len(marginals):
            return -15.0, 0.0
        most = min(max(float(marginals.max()), 3e-7), 1 - 3e-7)
        likely = np.minimum(marginals[marginals > 0.05], 0.999)
        return float(np.log(most / (1 - most))), float(np.log1p(-np.log1p(-likely).sum()))

    def document(self, marginals: np.ndarray) -> float:
        if self.constant is not None:
            return self.constant
        a, b = self.signals(marginals)
        z = self.score[0] + self.score[1] * a + self.score[2] * b
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def train(texts: list[str], toxic: list[int], share_toxic: float | None = None) -> Crf:
    """Fits the field and the document score on labelled texts, of which ``share_toxic`` are toxic where they come from."""
    crf = Crf()
    if not 0 < sum(toxic) < len(toxic):
        crf.constant = float(toxic[0]) if toxic else 0.0
        return crf
    share_toxic = min(max(np.mean(toxic) if share_toxic is None else share_toxic, 1e-3), 1 - 1e-3)
    cores = [[core(w) for w in _WORD.findall(t)] for t in texts]
    marked = toxic_vocabulary(cores, toxic)
    known = {w: k for k, w in enumerate(sorted({w for words in cores for w in words}))}
    lists = [features(w) for w in known]
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    flat = np.fromiter((f for x in lists for f in x), np.int64, int(sizes.sum()))
    firsts = np.cumsum(sizes) - sizes
    is_marked = np.array([w in marked or any(w[:n] + "*" in marked for n in BEGINNINGS[1:] if len(w) >= n) for w in known])
    begins = {m[:3] for m in marked}
    looks = np.array([w[:3] in begins for w in known])
    sequences, tags, kept = [], [], 0
    for words, label in zip(cores, toxic, strict=True):
        at = np.fromiter((known[w] for w in words), np.int64, len(words))
        y = is_marked[at] & bool(label)
        if label and not y.any():
            continue  # toxic, but for words not known to be so
        for k in range(0, len(at), STRETCH):
            part = slice(k, k + STRETCH)
            kept += 1
            if y[part].any() or looks[at[part]].any() or kept % EVERY == 0:
                sequences.append(at[part])
                tags.append(y[part])
    if not sequences:
        crf.constant = float(np.mean(toxic))
        return crf
    words = np.concatenate(sequences)
    y = np.concatenate(tags).astype(np.float64)
    ends = np.cumsum([len(s) for s in sequences])
    starts = ends - [len(s) for s in sequences]
    inner = np.ones(len(words), bool)
    inner[starts] = False
    before, after = y[:-1][inner[1:]], y[1:][inner[1:]]
    counted = np.array([[np.sum((before == i) & (after == j)) for j in (0, 1)] for i in (0, 1)], float)
    weights, squares = np.zeros(BUCKETS), np.full(BUCKETS, 1e-6)
    # Neighbours' weights, first from how often labelled neighbours are in each pair of states, as if independent of the words.
    share = y.mean()
    expected = np.outer([1 - share, share], [1 - share, share]) * counted.sum()
    crf.joint = np.clip(np.log((counted + 10) / (expected + 10)), -3, 3)
    crf.joint -= crf.joint[0, 0]
    for step in range(STEPS):
        emission = np.add.reduceat(weights[flat], firsts) + crf.bias
        e = emission[words]
        p = _all_marginals(crf, e, starts, ends)
        error = p - y
        by_word = np.bincount(words, error, minlength=len(known))
        gradient = np.bincount(flat, np.repeat(by_word, sizes), minlength=BUCKETS) + SHRINK * len(words) * weights / BUCKETS
        squares += gradient**2
        weights -= RATE * gradient / np.sqrt(squares)
        crf.bias -= RATE * np.clip(error.sum() / max(1.0, y.sum()), -1, 1) / (1 + step / 5)
        if step % 10 == 9:  # the four joint weights move slowly and cost a pass over pairs
            pairs = sum(crf.pair_marginals(e[a:b]) for a, b in zip(starts[:: max(1, len(starts) // 500)], ends[:: max(1, len(starts) // 500)], strict=True))
            pairs *= counted.sum() / pairs.sum() if np.sum(pairs) else 1
            crf.joint = np.clip(crf.joint + 0.5 * np.log((counted + 10) / (pairs + 10)), -4, 4)
            crf.joint -= crf.joint[0, 0]
    crf.weights = weights.astype(np.float32)
    emission = np.add.reduceat(crf.weights[flat].astype(np.float64), firsts) + crf.bias
    x = np.array([(1.0, *crf.signals(crf.marginals(emission[[known[w] for w in words]] if words else np.empty(0)))) for words in cores])
    crf.score = _logistic(x, np.array(toxic, float))
    for k in (1, 2):
        if crf.score[k] < 0:  # more evidence never lowers a score: the other signal says it all
            x[:, k] = 0
            crf.score = _logistic(x, np.array(toxic, float))
    # The sample has more toxic texts than there are.
    crf.score[0] += np.log(share_toxic / (1 - share_toxic)) - np.log(np.mean(toxic) / (1 - np.mean(toxic)))
    return crf


def _all_marginals(crf: Crf, e: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return np.concatenate([crf.marginals(e[a:b]) for a, b in zip(starts, ends, strict=True)])


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = x.T @ (x * (p * (1 - p))[:, None]) + ridge * np.eye(len(w))
        w += np.linalg.solve(h, x.T @ (y - p) - ridge * w)
    return w


class Tagger:
    """Scores texts with a fitted field; the log odds of words are kept while they fit."""

    def __init__(self, crf: Crf):
        self.crf, self.known, self.cores = crf, {}, {}

    def emissions(self, words: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > HELD_WORDS:
            known.clear()
            self.cores.clear()
        try:
            return np.fromiter(map(known.__getitem__, words), np.float64, len(words))
        except KeyError:
            for w in set(words).difference(known):
                c = core(w)
                e = self.cores.get(c)
                if e is None:
                    e = self.cores[c] = float(self.crf.weights[features(c)].sum()) + self.crf.bias
                known[w] = e
            return np.fromiter(map(known.__getitem__, words), np.float64, len(words))

    def score(self, text: str | None) -> float:
        return self.crf.document(self.crf.marginals(self.emissions((text or "").split())))

    def tag(self, text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
        """Score, and (start, end, probability) of each run of words that are more likely toxic, in code points."""
        found = list(_WORD.finditer(text or ""))
        p = self.crf.marginals(self.emissions([m[0] for m in found]))
        spans: list[tuple[int, int, float]] = []
        last = -2
        for k in np.flatnonzero(p > 0.5).tolist():
            if k == last + 1:
                start, _, most = spans.pop()
                spans.append((start, found[k].end(), max(most, float(p[k]))))
            else:
                spans.append((found[k].start(), found[k].end(), float(p[k])))
            last = k
        return self.crf.document(p), spans


def fit(
    docs: DataFrame, labels: DataFrame, train_rows: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = PER_CLASS,
) -> Crf:
    """Fits on about ``per_class`` training rows of each class, picked by a hash of the id."""
    narrow = labels.select(col(id_col).alias("id"), col(label_col).cast("int").alias("label")).where("label IN (0, 1) AND id IS NOT NULL")
    own = docs.where(train_rows).select(col(id_col).alias("id"), col(text_col).alias("text"))
    sizes = {r["label"]: r["n"] for r in narrow.groupBy("label").agg(F.count("*").alias("n")).collect()}
    spot = F.pmod(F.xxhash64(F.lit("toxicity sample"), "id"), F.lit(1_000_000))
    chosen = F.lit(False)
    for label, n in sorted(sizes.items()):
        chosen = chosen | ((F.col("label") == label) & (spot < int(min(1.0, per_class * (1 if label else CLEAN_FOR_TOXIC) / n) * 1_000_000)))
    picked = narrow.where(chosen)
    rows = own.join(F.broadcast(picked), "id").select("id", "text", "label").collect()
    rows.sort(key=lambda r: (str(r["id"]), r["text"] or "", r["label"]))
    share = sizes.get(1, 0) / max(1, sum(sizes.values()))
    return train([r["text"] or "" for r in rows], [r["label"] for r in rows], share)


def score(docs: DataFrame, crf: Crf, id_col: str = "doc_id", text_col: str = "text", spans: bool = True) -> DataFrame:
    """A row for each row of ``docs``: doc_id, score, and the toxic spans (start, end, probability)."""
    shared = docs.sparkSession.sparkContext.broadcast(crf)
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("probability", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(shared.value)
        for batch in batches:
            for ids, texts in text_slices(batch.column(0), batch.column(1)):
                if spans:
                    tagged = [tagger.tag(t) for t in texts.to_pylist()]
                    found = [[{"start": a, "end": b, "probability": p} for a, b, p in s] for _, s in tagged]
                    arrays = [ids, pa.array([s for s, _ in tagged], pa.float64()), pa.array(found, span_type)]
                else:
                    arrays = [ids, pa.array([tagger.score(t) for t in texts.to_pylist()], pa.float64())]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "score", *["spans"] * spans])

    kind = docs.select(col(id_col)).schema[0].dataType.simpleString()
    schema = f"doc_id {kind}, score double" + ", spans array<struct<start:bigint,end:bigint,probability:double>>" * spans
    return docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text")).mapInArrow(run, schema)
