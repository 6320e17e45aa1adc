"""Sum-of-squares online packing of tokenized documents into windows of a fixed number of tokens.

A task packs the documents of its own partition in their order. N(h) counts the windows filled to level h, and a document of
s tokens goes to the level whose change from h to h + s makes the sum of N(h) squared grow least; an array of the levels is all the
search needs. A document longer than a window is cut into whole windows and a rest. What is still open at the end of the
partition, or once ``max_open`` windows are, is settled: the least filled windows are cut to fill the fullest, and the last one is cut
into lengths that are powers of two. So there is no padding but what the caller's own rule adds, and no shuffle.

Cases: a null or empty text is the end token alone; every row is packed, repeated ones and null ids too; an empty
partition gives nothing. Packing depends on the rows of a partition and their order alone, so a task that is run again gives
the same rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from wayfold.llm.common import byte_lists, col, text_slices
from wayfold.llm.token_counts import Pieces, splitter

CAPACITY = 4096
MAX_OPEN = 4096
# Ids of pre-tokens that a Python worker holds between documents and tasks: about 40 bytes each with their table.
HELD_IDS = 4_000_000

Piece = tuple[int, int, np.ndarray, int]  # row, start in its document, ids, ids of the document


class UnitIds:
    """Token ids of texts, each distinct pre-token tokenized once while it is held.

    At most ``most_ids`` ids and as many bytes of pre-tokens are held; then the table is begun anew. Ids of all pre-tokens lie in one
    array, so a text's ids are gathered, not appended.
    """

    def __init__(self, path: str, most_ids: int = HELD_IDS):
        self.pieces, self.split, self.most = Pieces(path), splitter(path), most_ids
        self.by_space = self.split is bytes.split
        self._clear()

    def _clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.flat = np.empty(1 << 16, np.int32)
        self.first = np.empty(1 << 14, np.int64)
        self.size = np.empty(1 << 14, np.int64)
        self.used = self.bytes = 0

    def _learn(self, units: list[bytes]) -> None:
        for at in range(0, len(units), 65536):
            part = units[at : at + 65536]
            ids = self.pieces.encode(part)
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            more, n = int(sizes.sum()), len(self.known)
            while self.used + more > len(self.flat):
                self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
            while n + len(part) > len(self.first):
                self.first = np.concatenate([self.first, np.empty_like(self.first)])
                self.size = np.concatenate([self.size, np.empty_like(self.size)])
            self.flat[self.used : self.used + more] = np.fromiter(chain.from_iterable(ids), np.int32, more)
            self.first[n : n + len(part)] = self.used + np.cumsum(sizes) - sizes
            self.size[n : n + len(part)] = sizes
            self.known.update(zip(part, range(n, n + len(part)), strict=True))
            self.used += more
            self.bytes += sum(map(len, part))

    def ids(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text; null is empty."""
        if self.by_space:
            # Arrow cuts at ASCII white space and numbers the distinct units, so that only those become Python values.
            cut = pc.ascii_split_whitespace(texts.fill_null("") if texts.type == pa.string() else texts.cast(pa.string()).fill_null(""))
            counts = np.asarray(pc.list_value_length(cut), dtype=np.int64)
            coded = cut.flatten().dictionary_encode()
            units, places = coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False), np.asarray(coded.indices)
        else:
            cut = [self.split(t) for t in byte_lists(texts)]
            counts = np.fromiter(map(len, cut), np.int64, len(cut))
            numbers: dict[bytes, int] = {}
            places = np.fromiter((numbers.setdefault(u, len(numbers)) for part in cut for u in part), np.int64, int(counts.sum()))
            units = list(numbers)
        if max(self.used, self.bytes // 8) > self.most:
            self._clear()
        # The empty units before leading and behind trailing white space have no ids.
        new = [u for u in units if u not in self.known]
        if new:
            self._learn(new)
        codes = np.fromiter(map(self.known.__getitem__, units), np.int64, len(units))
        at = codes[places]
        stop = 0
        for n in counts:
            own = at[stop : stop + n]
            stop += n
            size = self.size[own]
            ends = np.cumsum(size)
            total = int(ends[-1]) if len(ends) else 0
            yield self.flat[np.arange(total) + np.repeat(self.first[own] - (ends - size), size)]


class SumOfSquares:
    """Windows being filled, found by their level."""

    def __init__(self, capacity: int = CAPACITY, max_open: int = MAX_OPEN):
        self.capacity, self.max_open = capacity, max_open
        self.levels = np.zeros(capacity + 1, np.int64)
        self.at: dict[int, list[list[Piece]]] = {}
        self.open = 0

    def level_for(self, size: int) -> int:
        """The level to put ``size`` tokens on: 0 is a new window. Ties go to the fullest."""
        n, cap = self.levels, self.capacity
        grown = n[size:] + 1  # N(h + size) for h = 0 ... capacity - size, and the window that comes
        before = n[: cap - size + 1].copy()
        before[0] = 1  # a new window takes nothing from a level
        # 2 N(h + size) + 1 gained, 2 N(h) - 1 given back; a window that is full leaves the count
        cost = np.where(before > 0, 2 * grown - 2 * before, np.iinfo(np.int64).max)
        cost[0] = 2 * grown[0] - 1
        cost[-1] = 1 - 2 * before[-1] if n[cap - size] > 0 else cost[-1]
        return int(len(cost) - 1 - np.argmin(cost[::-1]))

    def place(self, piece: Piece) -> list[list[Piece]]:
        """The windows that this piece completes."""
        size = len(piece[2])
        if size == self.capacity:
            return [[piece]]
        level = self.level_for(size)
        if level:
            window = self.at[level].pop()
            self.levels[level] -= 1
            self.open -= 1
        else:
            window = []
        window.append(piece)
        if level + size == self.capacity:
            return [window]
        self.levels[level + size] += 1
        self.at.setdefault(level + size, []).append(window)
        self.open += 1
        return self.settle() if self.open > self.max_open else []

    def settle(self) -> list[list[Piece]]:
        """Fills the fullest open windows from the least filled, then cuts the last into powers of two."""
        windows = [(level, w) for level in sorted(self.at) for w in self.at[level]]
        self.levels[:] = 0
        self.at, self.open = {}, 0
        done: list[list[Piece]] = []
        low, high = 0, len(windows) - 1
        while low < high:
            level, target = windows[high]
            have, source = windows[low]
            while level < self.capacity and source:
                row, start, ids, total = source.pop()
                take = min(len(ids), self.capacity - level)
                if take < len(ids):
                    source.append((row, start, ids[: len(ids) - take], total))
                    start += len(ids) - take
                    ids = ids[len(ids) - take :]
                target.append((row, start, ids, total))
                level += take
                have -= take
            windows[low] = (have, source)
            if level == self.capacity:
                done.append(target)
                high -= 1
            else:
                windows[high] = (level, target)
                low += 1
        if low == high:
            level, source = windows[low]
            part = 1
            while level:
                if level & part:
                    level -= part
                    room, window = part, []
                    while room:
                        row, start, ids, total = source.pop()
                        take = min(len(ids), room)
                        if take < len(ids):
                            source.append((row, start, ids[: len(ids) - take], total))
                        window.append((row, start + len(ids) - take, ids[len(ids) - take :], total))
                        room -= take
                    done.append(window)
                part <<= 1
        return done


_ENCODERS: dict[tuple[str, int], UnitIds] = {}


def pack(
    docs: DataFrame, path: str, end_id: int = 2, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", max_open: int = MAX_OPEN,
    with_ids: bool = True, held_ids: int = HELD_IDS,
) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_tokens, and the ids."""
    kind = docs.select(col(id_col)).schema[0].dataType.simpleString()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_tokens", *["ids"] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _ENCODERS.get((path, held_ids)) or _ENCODERS.setdefault((path, held_ids), UnitIds(path, held_ids))
        packer = SumOfSquares(capacity, max_open)
        sequence = TaskContext.get().partitionId() << 36
        names_of: dict[int, object] = {}
        left: dict[int, int] = {}  # tokens of a row that no finished window holds yet
        rows = 0

        def finished(windows: list[list[Piece]]) -> pa.RecordBatch:
            nonlocal sequence
            out: list[list] = [[] for _ in names]
            for window in windows:
                offset, total = 0, sum(len(p[2]) for p in window)
                for row, start, ids, tokens in window:
                    n = len(ids)
                    for where, x in zip(out, (names_of[row], start, n, zlib.crc32(ids.astype("<u4").tobytes()), tokens, sequence, offset, total, ids), strict=False):
                        where.append(x)
                    offset += n
                    left[row] -= n
                    if not left[row]:
                        del left[row], names_of[row]
                sequence += 1
            ids_type = batch_type if batch_type is not None else pa.int64()
            arrays = [pa.array(out[0], ids_type), *(pa.array(x, pa.int64()) for x in out[1:8]), *(pa.array(x, pa.list_(pa.int32())) for x in out[8:])]
            return pa.RecordBatch.from_arrays(arrays, names)

        batch_type = None
        for batch in batches:
            batch_type = batch.column(0).type
            for ids, texts in text_slices(batch.column(0), batch.column(1)):
                windows: list[list[Piece]] = []
                for name, tokens in zip(ids.to_pylist(), encoder.ids(texts), strict=True):
                    tokens = np.append(tokens, np.int32(end_id))
                    names_of[rows], left[rows] = name, len(tokens)
                    for start in range(0, len(tokens), capacity):
                        part = tokens[start : start + capacity]
                        # A short rest may wait long: it must not hold the whole document.
                        windows += packer.place((rows, start, part if len(part) in (capacity, len(tokens)) else part.copy(), len(tokens)))
                    rows += 1
                if windows:
                    yield finished(windows)
        if windows := packer.settle():
            yield finished(windows)

    schema = f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, sequence_tokens bigint" + ", ids array<int>" * with_ids
    return docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text")).mapInArrow(run, schema)
