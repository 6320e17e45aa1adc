"""What the text operators share: free column names, bounded slices of Arrow batches, word hashes."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfold.operators.blocks import blocked, positions_by_block

# Python works on this many bytes of text at once, however many rows an Arrow batch has.
SLICE_BYTES = 4 << 20
# A task hands its counts on when it holds so many distinct units.
HELD_UNITS = 400_000
# Rows of ids up to this many are broadcast; more are joined by a shuffle, with the same result.
BROADCAST_IDS = 1_000_000


def documents(spark: SparkSession, folder: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many leading underscores as it takes to be new to ``df``."""
    known = {c.lower() for c in df.columns}
    found = []
    for name in names:
        while name.lower() in known:
            name = "_" + name
        known.add(name.lower())
        found.append(name)
    return found


def col(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def crc_fold(name: str, parts: int) -> Column:
    """crc32 of the id written as text, modulo ``parts``; null where the id is null."""
    return F.pmod(F.crc32(col(name).cast("string").cast("binary")), F.lit(parts)).cast("int")


def text_slices(ids: pa.Array, texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Runs of rows whose texts have about ``limit`` bytes in all; a longer text is a run of its own."""
    if len(texts) == 0:
        return
    ends = np.cumsum(np.asarray(pc.binary_length(texts).fill_null(0), dtype=np.int64))
    start = 0
    while start < len(texts):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield ids.slice(start, stop - start), texts.slice(start, stop - start)
        start = stop


def byte_lists(texts: pa.Array) -> list[bytes]:
    """The texts in UTF-8; null is empty."""
    return [t or b"" for t in texts.cast(pa.binary()).to_pylist()]


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


_SHINGLE_FACTORS = mixed(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def shingle_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash for each run of ``size`` word hashes; one for the whole sequence if it is shorter, none if it is empty."""
    if len(hashes) == 0:
        return hashes
    size = min(size, len(hashes))
    total = np.full(len(hashes) - size + 1, size, dtype=np.uint64)
    for k in range(size):
        total += hashes[k : len(hashes) - size + 1 + k] * _SHINGLE_FACTORS[k]
    return mixed(total)


def lower_ascii_words(text: bytes) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case: what bytes.lower and bytes.split do."""
    return text.lower().split()


def counted_units(docs: DataFrame, text_col: str, split: Callable[[bytes], list[bytes]]) -> DataFrame:
    """Every distinct unit that ``split`` cuts the texts into (unit), and how often they hold it (n)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], ["unit", "n"])

        for batch in batches:
            for _, texts in text_slices(batch.column(0), batch.column(0)):
                for text in byte_lists(texts):
                    held.update(split(text))
                if len(held) > HELD_UNITS:
                    yield out()
                    held = Counter()
        if held:
            yield out()

    found = docs.select(col(text_col).alias("text")).mapInArrow(count, "unit binary, n bigint")
    return found.groupBy("unit").agg(F.sum("n").alias("n"))


def head_of(table: DataFrame, most: int, count: str = "n") -> int:
    """The least power of two such that at most ``most`` rows have a count of at least it."""
    levels = table.groupBy(F.floor(F.log2(F.col(count).cast("double"))).cast("int").alias("level")).agg(F.count("*").alias("rows")).collect()
    total, cut = 0, 1 << 62
    for row in sorted(levels, key=lambda r: -r["level"]):
        total += row["rows"]
        if total > most:
            break
        cut = 1 << row["level"]
    return cut


def sized(ids: DataFrame) -> DataFrame:
    """``ids`` to be broadcast if they are few; otherwise Spark decides."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def having(docs: DataFrame, ids: DataFrame, id_col: str, flag: str) -> DataFrame:
    """``docs`` with a flag: is the row's id among the distinct ``ids``?"""
    return docs.join(sized(ids.select(id_col, F.lit(True).alias(flag))), id_col, "left").withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))


def ranked(rows: DataFrame, keys: list[str], order: list[str], rows_per_block: int, out: str = "rank") -> DataFrame:
    """``rows`` with their 0-based rank within the keys; a key's run is split by blocks of values, which lead with a number that is never null."""
    cut = blocked(rows, order, rows.count(), rows_per_block)
    if cut is None:
        return rows.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint") - 1)
    return positions_by_block(cut, keys, [F.col(c) for c in order], "_block", out).drop("_block")
