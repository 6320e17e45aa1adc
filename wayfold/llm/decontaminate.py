"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact weighted-shingle similarity.

An item is a set of weighted word shingles (weight: how often it occurs). A document is compared window by window, each as
long as an item:

1. A window without any shingle of an item has similarity 0 to it, so only windows over a shingle that the document shares with a
   benchmark item are looked at. This loses nothing and leaves a few windows of most texts.
2. A window's SimHash is the sign of the weighted sum of its shingles' hash bits. Fingerprints are cut into ``RADIUS`` + 1
   blocks of bits; within the radius at least one block is equal (pigeonhole), so a table from (block, bits) to items gives every
   item whose fingerprint lies within the radius.
3. A window within the radius is verified: the weighted Jaccard similarity of its shingles and the item's must be 0.75 or more.

The radius is wide (24 of 64 bits; windows of similarity 0.75 differ in about 11, give or take 3), since a lost passage is worse than a window more to verify.

The benchmark is the stated query set. It is held by every task in blocks of whole items with at most ``BLOCK_SHINGLES`` shingles, one
pass over the documents for each block.

Cases: null and empty texts match nothing; an item with fewer words than a shingle is one shingle of all its words and matches a
window of exactly these words; null items have no words and match nothing; items with equal texts each report; every row of documents is searched,
repeated ones and null ids too; very long texts are searched whole; empty tables give an empty table.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from wayfold.llm.common import byte_lists, col, lower_ascii_words, mixed, shingle_hashes, text_slices, word_hashes

SHINGLE = 5
SIMILAR = 0.75
BITS, RADIUS = 64, 24
BLOCK_SHINGLES = 1_000_000

_PLANES = np.arange(BITS, dtype=np.uint64)


def simhash(sums: np.ndarray) -> np.ndarray:
    """Fingerprints from signed sums, a row of BITS for each window."""
    return ((sums > 0).astype(np.uint64) << _PLANES).sum(axis=1, dtype=np.uint64)


def signed_bits(shingles: np.ndarray) -> np.ndarray:
    bits = (mixed(shingles)[:, None] >> _PLANES) & np.uint64(1)
    return bits.astype(np.int32) * 2 - 1


class HammingIndex:
    """All fingerprints within a radius, found by blocks of bits of which at least one is equal."""

    def __init__(self, prints: np.ndarray, radius: int = RADIUS):
        self.prints, self.radius = prints, radius
        edges = np.linspace(0, BITS, radius + 2).round().astype(int)
        self.blocks = [(np.uint64(lo), np.uint64((1 << (hi - lo)) - 1)) for lo, hi in zip(edges, edges[1:], strict=False)]
        self.tables: list[dict[int, np.ndarray]] = []
        for lo, mask in self.blocks:
            table = defaultdict(list)
            for k, key in enumerate((prints >> lo) & mask):
                table[int(key)].append(k)
            self.tables.append({key: np.array(ks) for key, ks in table.items()})

    def within(self, fingerprint: np.uint64, among: np.ndarray | None = None) -> np.ndarray:
        """Numbers of the fingerprints within the radius; of those in the mask ``among`` if it is given."""
        met = np.zeros(len(self.prints), bool)
        for (lo, mask), table in zip(self.blocks, self.tables, strict=True):
            found = table.get(int((fingerprint >> lo) & mask))
            if found is not None:
                met[found] = True
        if among is not None:
            met &= among
        ks = np.flatnonzero(met)
        return ks[np.bitwise_count(self.prints[ks] ^ fingerprint) <= self.radius]


class Benchmark:
    """Items ready to be searched for: shingle hashes with weights, fingerprints, and which items hold a shingle."""

    def __init__(self, items: list[tuple[object, bytes]]):
        self.names, self.words, self.weights, prints = [], [], [], []
        held = defaultdict(list)
        for name, text in items:
            words = lower_ascii_words(text)
            if not words:
                continue
            shingles = shingle_hashes(word_hashes(words), SHINGLE)
            for q, s in enumerate(shingles.tolist()):
                held[s].append((len(self.names), q))
            keys, counts = np.unique(shingles, return_counts=True)
            self.names.append(name)
            self.words.append(len(words))
            self.weights.append(dict(zip(keys.tolist(), counts.tolist(), strict=True)))
            prints.append(simhash(signed_bits(shingles).sum(axis=0)[None, :])[0])
        self.index = HammingIndex(np.array(prints, np.uint64))
        self.keys = np.array(sorted(held), np.uint64)
        self.held = {s: sorted({i for i, _ in at}) for s, at in held.items()}
        self.lengths = np.array(self.words)
        # Items of fewer words than a shingle are looked for by windows of just so many words.
        self.short = sorted({n for n in self.words if n < SHINGLE})

    def similarity(self, item: int, shingles: np.ndarray) -> float:
        weights = self.weights[item]
        window: dict[int, int] = defaultdict(int)
        for s in shingles.tolist():
            window[s] += 1
        both = sum(min(n, weights[s]) for s, n in window.items() if s in weights)
        return both / (sum(weights.values()) + len(shingles) - both)

    def search(self, hashes: np.ndarray) -> list[tuple[int, int, float]]:
        """(item, first word, similarity) of the best window of each item that the document holds."""
        if not self.names:
            return []
        best: dict[int, tuple[float, int]] = {}
        for size in (*self.short, SHINGLE):
            if len(hashes) < size:
                continue
            shingles = shingle_hashes(hashes, size)
            at = np.searchsorted(self.keys, shingles)
            shared = np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == shingles)
            if not len(shared):
                continue
            holding: dict[int, list[int]] = defaultdict(list)
            for p in shared.tolist():
                for item in self.held[int(shingles[p])]:
                    if self.words[item] == size if size < SHINGLE else self.words[item] >= SHINGLE:
                        holding[item].append(p)
            by_size: dict[int, list[int]] = defaultdict(list)
            for item in holding:
                by_size[self.words[item]].append(item)
            for words, items in by_size.items():
                self._windows(shingles, words - size + 1, items, holding, best)
        return sorted((item, start, similarity) for item, (similarity, start) in best.items())

    def _windows(self, shingles: np.ndarray, width: int, items: list[int], holding: dict[int, list[int]], best: dict[int, tuple[float, int]]) -> None:
        """Windows of ``width`` shingles over shared shingles, against the items of that width."""
        last = max(0, len(shingles) - width)
        starts = {s for item in items for p in holding[item] for s in range(max(0, p - width + 1), min(p, last) + 1)}
        at = np.array(sorted(starts))
        among = np.zeros(len(self.names), bool)
        among[items] = True
        for run in np.split(at, np.flatnonzero(np.diff(at) > 1) + 1):
            lo, hi = int(run[0]), int(run[-1]) + width
            sums = np.zeros((min(hi, len(shingles)) - lo + 1, BITS), np.int32)
            np.cumsum(signed_bits(shingles[lo:hi]), axis=0, out=sums[1:])
            ends = np.minimum(run - lo + width, len(sums) - 1)
            for start, fingerprint in zip(run.tolist(), simhash(sums[ends] - sums[run - lo]), strict=True):
                for item in self.index.within(fingerprint, among).tolist():
                    similarity = self.similarity(item, shingles[start : start + width])
                    if similarity >= SIMILAR and (item not in best or similarity > best[item][0]):
                        best[item] = (similarity, start)


def _benchmark_blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[DataFrame]:
    """The benchmark in blocks of whole items that have about BLOCK_SHINGLES words together at most."""
    words = F.size(F.split(F.coalesce(col(text_col), F.lit("")), r"[\x20\x09-\x0D]+"))
    total = items.agg(F.sum(words.cast("long"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_SHINGLES))
    named = items.select(col(id_col).alias("item_id"), col(text_col).alias("text"))
    for k in range(blocks):
        yield named if blocks == 1 else named.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)


class _Shared:
    """A block of the benchmark as tasks get it; made ready once in each task."""

    def __init__(self, block: DataFrame):
        self.rows = block.sparkSession.sparkContext.broadcast([(r["item_id"], (r["text"] or "").encode()) for r in block.collect()])

    def ready(self) -> Benchmark:
        return Benchmark(self.rows.value)


def contaminated(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """A row for each document and item that it holds: doc_id, item_id, start_word, n_words, similarity of the best window."""
    kind, item_kind = (df.select(col(c)).schema[0].dataType for df, c in ((docs, id_col), (items, item_col)))
    arrow_kind = to_arrow_type(item_kind)
    narrow = docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text"))
    found: DataFrame | None = None
    for block in _benchmark_blocks(items, item_col, item_text_col):

        def run(batches: Iterator[pa.RecordBatch], shared: _Shared = _Shared(block)) -> Iterator[pa.RecordBatch]:
            known = shared.ready()
            for batch in batches:
                for ids, texts in text_slices(batch.column(0), batch.column(1)):
                    rows = [(k, *hit) for k, text in enumerate(byte_lists(texts)) for hit in known.search(word_hashes(lower_ascii_words(text)))]
                    at, item, start, similarity = map(list, zip(*rows, strict=True)) if rows else ([], [], [], [])
                    yield pa.RecordBatch.from_arrays(
                        [
                            ids.take(pa.array(at, pa.int32())), pa.array([known.names[i] for i in item], arrow_kind), pa.array(start, pa.int64()),
                            pa.array([known.words[i] for i in item], pa.int64()), pa.array(similarity, pa.float64()),
                        ],
                        ["doc_id", "item_id", "start_word", "n_words", "similarity"],
                    )

        schema = f"doc_id {kind.simpleString()}, item_id {item_kind.simpleString()}, start_word bigint, n_words bigint, similarity double"
        hits = narrow.mapInArrow(run, schema)
        found = hits if found is None else found.unionByName(hits)
    return found


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, whole and unshuffled, that hold no benchmark item."""
    at = docs.columns.index(text_col)
    out = docs
    for block in _benchmark_blocks(items, item_col, item_text_col):

        def run(batches: Iterator[pa.RecordBatch], shared: _Shared = _Shared(block)) -> Iterator[pa.RecordBatch]:
            known = shared.ready()
            for batch in batches:
                # A text at a time: no more than the batch itself is held.
                keep = [not known.search(word_hashes(lower_ascii_words((text.as_py() or "").encode()))) for text in batch.column(at)]
                yield batch.filter(pa.array(keep, pa.bool_()))

        out = out.mapInArrow(run, docs.schema)
    return out
