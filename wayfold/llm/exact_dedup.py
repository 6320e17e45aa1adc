"""Exact dedup by two-pass Bloom filtering, in DataFrame operations only.

First pass: every text's SHA-256 sets bits in one 64-bit word of a blocked Bloom filter, and a bit counts as repeated when
two rows have set it. Second pass: a row whose bits are all repeated may have a twin; only such rows are shuffled and
compared by their full digest. All others are alone for certain and pass straight through.

The filter is a table of words, joined by word number. It never has more than ``max_words`` rows, which bounds what is
broadcast; beyond its capacity more rows are suspects, and the result stays the same.

Cases: a null text is empty; empty texts are equal to each other. Of equal texts the largest id stays; a null id stays only
among null ids. Rows that repeat both id and text are one document in several rows: ``exact_groups`` gives each of them the
same answer and counts each in ``group_size``, ``deduplicated`` leaves one. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import col, free_names
from wayfold.session import cut_lineage

BITS_PER_ROW = 16
MAX_WORDS = 1 << 20


def _digest(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def _word(digest: Column, words: int) -> Column:
    return F.pmod(F.shiftrightunsigned(F.xxhash64(digest), 12), F.lit(words))


def _bits(digest: Column) -> Column:
    """The two bits, of 64, that a digest sets in its word."""
    h = F.xxhash64(digest)
    return F.array(h.bitwiseAND(F.lit(63)).cast("int"), F.shiftrightunsigned(h, 6).bitwiseAND(F.lit(63)).cast("int"))


def _mask(bits: Column) -> Column:
    one = F.lit(1).cast("long")
    return F.call_function("shiftleft", one, bits[0]).bitwiseOR(F.call_function("shiftleft", one, bits[1]))


def repeated_bits(digests: DataFrame, words: int) -> DataFrame:
    """Word number and the bits in it that two or more rows have set, where there are such bits."""
    set_bits = digests.select(
        _word(F.col("text_sha256"), words).alias("word"), F.explode(F.array_distinct(_bits(F.col("text_sha256")))).alias("bit"),
    )
    twice = set_bits.groupBy("word", "bit").agg(F.count("*").alias("n")).where("n > 1")
    return twice.groupBy("word").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))).alias("bits"))


def _words_for(rows: int, max_words: int) -> int:
    return max(1, min(max_words, rows * BITS_PER_ROW // 64))


def _suspect(bits: str, digest: str) -> Column:
    mask = _mask(_bits(F.col(digest)))
    return F.coalesce(F.col(bits).bitwiseAND(mask) == mask, F.lit(False))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_words: int = MAX_WORDS) -> DataFrame:
    """A row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    digests = cut_lineage(docs.select(col(id_col).alias("doc_id"), _digest(col(text_col)).alias("text_sha256")), "digests")
    words = _words_for(digests.count(), max_words)
    filled = F.broadcast(repeated_bits(digests, words))
    seen = digests.withColumn("word", _word(F.col("text_sha256"), words)).join(filled, "word", "left")
    seen = seen.withColumn("suspect", _suspect("bits", "text_sha256"))
    alone = seen.where(~F.col("suspect")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256",
    )
    suspects = seen.where("suspect").select("doc_id", "text_sha256")
    # Written, so that a join with one row for each group follows, in which Spark splits a group that holds many of the rows.
    groups = cut_lineage(suspects.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "groups")
    settled = suspects.join(groups, "text_sha256").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256",
    )
    return alone.unionByName(settled)


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_words: int = MAX_WORDS) -> DataFrame:
    """``docs`` with one row of each group of equal texts: that with the largest id, whole and unchanged."""
    digest, word, bits, keep, row = free_names(docs, "text_sha256", "word", "bits", "keep_id", "row")
    digests = cut_lineage(docs.select(col(id_col).alias("doc_id"), _digest(col(text_col)).alias("text_sha256")), "digests")
    words = _words_for(digests.count(), max_words)
    filled = repeated_bits(digests, words)
    table = F.broadcast(filled.select(F.col("word").alias(word), F.col("bits").alias(bits)))
    seen = docs.withColumn(digest, _digest(col(text_col))).withColumn(word, _word(F.col(digest), words)).join(table, word, "left")
    suspect = _suspect(bits, digest)
    alone = seen.where(~suspect).select(*map(col, docs.columns))
    narrow = digests.withColumn("word", _word(F.col("text_sha256"), words)).join(F.broadcast(filled), "word", "left")
    groups = narrow.where(_suspect("bits", "text_sha256")).groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"))
    groups = cut_lineage(groups, "groups").select(F.col("text_sha256").alias(digest), F.col("keep_id").alias(keep))
    whole = F.struct(*map(col, docs.columns))
    settled = (
        seen.where(suspect)
        .join(groups, digest)
        .where(col(id_col).eqNullSafe(F.col(keep)))
        .groupBy(digest)
        .agg(F.max_by(whole, F.xxhash64(whole)).alias(row))
        .select(*[F.col(row)[c].alias(c) for c in docs.columns])
    )
    return alone.unionByName(settled)
