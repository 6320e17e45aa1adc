"""Language-model scoring by cross-entropy difference.

Two bigram models are estimated over one vocabulary: the target model from the documents that ``target`` names, the background
model from a random part of all documents that has as many documents as the target (matched, so that neither model is smoothed more
than the other). A document's score is the mean over its words of

    log P_target(word | word before) - log P_background(word | word before)

so a document that looks like the target has a score above 0. Both models use absolute discounting with add-one unigrams:
P(w | v) = max(c(v, w) - D, 0) / c(v) + D k(v) / c(v) P(w), where k(v) counts the distinct words after v.

The vocabulary is every word of all documents; none is cut and none stands for others. A score is a sum over units: the word itself, the word before,
and what a seen pair of words adds to the backed-off value. Each unit has a row in a table that grows with the corpus; what the most
frequent words (at most ``HELD_WORDS``) and pairs (at most ``HEAD``) add is held by every task as well, the others are joined by a shuffle,
with the same result: codes are dealt into parts, a slice of the documents sends each part one row with the units it looks for, and
gets one row back with what they add to each of its documents.
Words held by tasks are numbered; other words, and pairs with one of them, are coded by 62 bits of a hash.

Cases: null, empty and blank texts have no words and score 0; without target documents both models are the uniform one over the vocabulary and every
score is 0; every row gives a row, repeated ones and null ids too; rows with a null id are never target; an empty table
gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from wayfold.llm.common import col, having, head_of, mixed, text_slices
from wayfold.session import cut_lineage, short_lived, shuffles_freed

HELD_WORDS = 1 << 17
HEAD = 1 << 20
DISCOUNT = 0.75
START, FIRST_WORD = 0, 1
# Codes from here on are hashes.
HASHED = 1 << 62
# In place of the times of a word that stands last: it is no word before another.
LAST = -1
# Distinct pairs, or words, that a task holds before it hands them on.
HELD_PAIRS, HELD_COUNTS = 1_000_000, 800_000
# Gains, and words of the documents, for each part of the codes; a part is joined by one task.
PART_GAINS, PART_WORDS = 1_000_000, 2_000_000
PACKED = ["part", "slice", "row", "doc_id", "n_words", "known", "units", "with_it", "times"]
ANSWERED = ["slice", "row", "doc_id", "n_words", "known", "places", "sums"]
# In place of the first row of a slice where the units come with their gains.
GAINS = -1


def to_planes(numbers: np.ndarray) -> bytes:
    """All first bytes, then all second ones, and so on: in ordered numbers the high ones repeat, which a shuffle's compression takes out."""
    return np.ascontiguousarray(numbers).view(np.uint8).reshape(len(numbers), -1).T.tobytes()


def from_planes(blob: pa.Scalar, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(blob.as_buffer(), np.uint8).reshape(size, -1).T).view(kind).ravel()


def held_words(counts: DataFrame, most: int) -> dict[bytes, int]:
    """Numbers of the most frequent words; the same for any order of the rows."""
    cut = head_of(counts, most=most)
    words = sorted(bytes(r["unit"]) for r in counts.where(F.col("n") >= cut).select("unit").collect())
    return {w: k for k, w in enumerate(words, FIRST_WORD)}


def cut_words(texts: pa.Array) -> pa.Array:
    """The words of each text; white space before the first or after the last one leaves an empty word."""
    return pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.string()).fill_null("")))


def word_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """Every distinct word of the texts (unit), and how often they hold it (n); Arrow cuts and counts."""

    def merged(held: list[pa.Table]) -> pa.Table:
        found = pa.concat_tables(held).group_by("unit", use_threads=False).aggregate([("n", "sum")])
        return found.select(["unit", "n_sum"]).rename_columns(["unit", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size = 0
        for batch in batches:
            for _, texts in text_slices(batch.column(0), batch.column(0)):
                found = cut_words(texts).flatten().value_counts()
                found = pa.table([found.field(0).cast(pa.binary()), found.field(1)], ["unit", "n"])
                held.append(found.filter(pc.not_equal(found["unit"], b"")))
                size += len(held[-1])
                if size > HELD_COUNTS:
                    found = merged(held)
                    # Words that repeat make room; otherwise hand them on.
                    if len(found) > HELD_COUNTS // 2:
                        yield from found.combine_chunks().to_batches()
                        held, size = [], 0
                    else:
                        held, size = [found], len(found)
        if held:
            yield from merged(held).combine_chunks().to_batches()

    found = docs.select(col(text_col).alias("text")).mapInArrow(count, "unit binary, n bigint")
    return found.groupBy("unit").agg(F.sum("n").alias("n"))


def coded_words(texts: pa.Array, known: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """START and the codes of the distinct words, in order; the place there of each word of all texts; how many words each text has."""
    # Arrow numbers the distinct words, so that only those become Python values.
    cut = cut_words(texts)
    sizes = np.asarray(pc.list_value_length(cut), dtype=np.int64)
    coded = cut.flatten().dictionary_encode()
    words = coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False)
    codes = np.fromiter(map(known.get, words.tolist(), repeat(0)), np.int64, len(words))
    rare = np.flatnonzero(codes == 0)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words[rare].tolist()), np.uint64, len(rare))
    codes[rare] = (hashes >> np.uint64(2)).astype(np.int64) | HASHED
    places = np.asarray(coded.indices)
    empty = pc.index(coded.dictionary, "").as_py()
    if empty >= 0:
        there = places != empty
        sizes -= np.bincount(np.repeat(np.arange(len(sizes)), sizes)[~there], minlength=len(sizes))
        places = places[there]
    order = np.argsort(codes)
    rank = np.empty(len(codes), np.int64)
    rank[order] = np.arange(1, len(codes) + 1)
    return np.concatenate([[START], codes[order]]), rank[places], sizes


def word_codes(texts: pa.Array, known: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """The number of each word of all texts, or its hash, and how many words each text has."""
    codes, word, sizes = coded_words(texts, known)
    return codes[word], sizes


def neighbours(texts: pa.Array, known: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes in order; the places there of the words of all texts and of the word before each; how many words each text has."""
    codes, word, sizes = coded_words(texts, known)
    before = np.concatenate([[0], word[:-1]]) if len(word) else word
    before[(np.cumsum(sizes) - sizes)[sizes > 0]] = 0
    return codes, before, word, sizes


_P1, _P2, _P3, _P4, _P5 = (
    np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)
)


def spark_hash(x: np.ndarray, seed: np.ndarray | int) -> np.ndarray:
    """What F.xxhash64 makes of a bigint after ``seed``."""
    turned = lambda y, k: y << np.uint64(k) | y >> np.uint64(64 - k)
    h = np.asarray(seed, np.uint64) + _P5 + np.uint64(8) ^ turned(x.astype(np.uint64) * _P2, 31) * _P1
    h = turned(h, 27) * _P1 + _P4
    h = (h ^ h >> np.uint64(33)) * _P2
    h = (h ^ h >> np.uint64(29)) * _P3
    return h ^ h >> np.uint64(32)


def hashed(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return (spark_hash(second, spark_hash(first, 42)) >> np.uint64(2)).astype(np.int64) | HASHED


def pair_codes(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """(number before) << 32 | number, or a hash if either is one."""
    found = before << 32 | word
    rare = np.maximum(before, word) >= HASHED
    found[rare] = hashed(before[rare], word[rare])
    return found


def slice_units(
    texts: pa.Array, known: dict[bytes, int], tables: tuple[np.ndarray, ...], share: float,
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text and what ``tables`` say they add; then the units they do not hold: code, place of the text, times in it."""
    befores, selves, frequent, values = tables
    codes, before, word, sizes = neighbours(texts, known)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    near = codes < HASHED
    of_before, of_word = np.zeros(len(codes)), np.zeros(len(codes))
    of_before[near], of_word[near] = befores[codes[near]], selves[codes[near]]
    sums = np.bincount(owner, share + of_before[before] + of_word[word], len(sizes))
    pair, whose, times = distinct(before * len(codes) + word, owner, len(sizes))
    first = starts(pair)
    kinds, held_by = pair[first], np.diff(first, append=len(pair))
    every = pair_codes(codes[kinds // len(codes)], codes[kinds % len(codes)])
    # In the order of units, one document's stay together.
    order = np.argsort(every)
    every, first, held_by = every[order], first[order], held_by[order]
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, every), len(frequent) - 1)
        there = frequent[at] == every
        rows = spread(first[there], held_by[there])
        sums += np.bincount(whose[rows], np.repeat(values[at[there]], held_by[there]) * times[rows], len(sizes))
        every, first, held_by = every[~there], first[~there], held_by[~there]
    rows = spread(first, held_by)
    found = [(np.repeat(every, held_by), whose[rows], times[rows])]
    # A rare word adds in both places, but for the last of a text.
    far = ~near[word]
    ends = (np.cumsum(sizes) - 1)[sizes > 0]
    ends = ends[far[ends]]
    unit, whose, times = distinct(word[far], owner[far], len(sizes))
    found += [(codes[unit], whose, times), (codes[word[ends]], owner[ends].astype(np.int32), np.full(len(ends), LAST, np.int32))]
    return sizes, sums, *(np.concatenate([x[k] for x in found]) for k in range(3))


def starts(ordered: np.ndarray) -> np.ndarray:
    """Where runs of the same number begin."""
    return np.flatnonzero(np.concatenate([[len(ordered) > 0], ordered[1:] != ordered[:-1]]))


def spread(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of runs, one after the other."""
    return np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def distinct(unit: np.ndarray, whose: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each unit and text that occur together, in order, and how often they do."""
    # One number holds both, as a slice has either few texts or few words.
    both = np.sort(unit * texts + whose)
    first = starts(both)
    return both[first] // texts, (both[first] % texts).astype(np.int32), np.diff(first, append=len(both)).astype(np.int32)


def pair_code(before: str, word: str) -> Column:
    """The same as a column."""
    return F.when(F.greatest(before, word) < HASHED, F.shiftleft(before, 32).bitwiseOR(F.col(word))).otherwise(hash_code(F.col(before), F.col(word)))


def hash_code(first: Column, second: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(first, second), 2).bitwiseOR(F.lit(HASHED))


def pair_counts(rows: DataFrame, words) -> DataFrame:
    """v, w, target, background: how often each pair occurs in either part; ``rows`` has text, in_target, in_background."""

    def merged(held: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        v, w, t, b = (np.concatenate([h[k] for h in held]) for k in range(4))
        order = np.argsort(pair_codes(v, w))
        v, w = v[order], w[order]
        first = np.flatnonzero(np.concatenate([[True], (v[1:] != v[:-1]) | (w[1:] != w[:-1])]))
        return v[first], w[first], np.add.reduceat(t[order], first), np.add.reduceat(b[order], first)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = words.value
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def out(found: tuple[np.ndarray, ...]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["v", "w", "target", "background"])

        for batch in batches:
            flags = pa.StructArray.from_arrays([batch.column(1), batch.column(2)], ["t", "b"])
            for part, texts in text_slices(flags, batch.column(0)):
                codes, before, word, sizes = neighbours(texts, known)
                if len(word):
                    t, b = (np.repeat(np.asarray(part.field(k).to_numpy(zero_copy_only=False), np.int64), sizes) for k in (0, 1))
                    marked = np.sort((before * len(codes) + word) << 2 | t << 1 | b)
                    pair = marked >> 2
                    first = starts(pair)
                    pair = pair[first]
                    held.append((codes[pair // len(codes)], codes[pair % len(codes)], *(np.add.reduceat(marked >> k & 1, first) for k in (1, 0))))
                    size += len(first)
                if size > HELD_PAIRS:
                    found = merged(held)
                    # Pairs that repeat make room; otherwise hand them on.
                    if len(found[0]) > HELD_PAIRS // 2:
                        yield out(found)
                        held, size = [], 0
                    else:
                        held, size = [found], len(found[0])
        if held:
            yield out(merged(held))

    counted = rows.where("in_target OR in_background").select("text", "in_target", "in_background").mapInArrow(count, "v bigint, w bigint, target bigint, background bigint")
    return counted.groupBy("v", "w").agg(F.sum("target").alias("target"), F.sum("background").alias("background"))


def word_sums(pairs: DataFrame) -> DataFrame:
    """code, and for each model c(v), k(v) and c(w) of that word, as far as it occurs in either part."""
    models = ("target", "background")
    before = pairs.groupBy(F.col("v").alias("code")).agg(
        *[F.sum(m).alias(f"{m}_total") for m in models], *[F.count(F.when(F.col(m) > 0, 1)).alias(f"{m}_kinds") for m in models]
    )
    own = pairs.groupBy(F.col("w").alias("code")).agg(*[F.sum(m).alias(f"{m}_own") for m in models])
    return before.join(own, "code", "full").na.fill(0)


def back(model: str) -> Column:
    """The weight of the backed-off value after a word."""
    return F.when(F.col(f"{model}_total") > 0, DISCOUNT * F.col(f"{model}_kinds") / F.col(f"{model}_total")).otherwise(1.0)


def word_gains(sums: DataFrame) -> DataFrame:
    """code, before, own: what a word adds as the word before and as the word itself; without the share that all words have."""
    own = F.log(F.col("target_own") + 1.0) - F.log(F.col("background_own") + 1.0)
    return sums.select("code", (F.log(back("target")) - F.log(back("background"))).alias("before"), own.alias("own"))


def pair_gains(pairs: DataFrame, sums: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """code, gain, n: what a seen pair adds to the backed-off difference, and how often it occurs; ``sizes`` has a model's words and the vocabulary's, summed."""

    def joined(found: DataFrame, key: str, columns: str) -> list[DataFrame]:
        """Held words come to the rows, rows go to the others, so that no frequent word fills a task."""
        side = sums.select(F.col("code").alias(key), *[f"{m}_{columns}" for m in sizes])
        held = F.col(key) < HASHED
        return [found.where(held).join(F.broadcast(side.where(held)), key), found.where(~held).join(side.where(~held), key)]

    def gain(found: DataFrame) -> DataFrame:
        parts = {m: F.log1p(F.greatest(F.col(m) - DISCOUNT, F.lit(0.0)) / DISCOUNT / F.greatest(f"{m}_kinds", F.lit(1)) * total / (F.col(f"{m}_own") + 1.0)) for m, total in sizes.items()}
        return found.select(pair_code("v", "w").alias("code"), (parts["target"] - parts["background"]).cast("float").alias("gain"), (F.col("target") + F.col("background")).alias("n"))

    found = [gain(y) for x in joined(pairs, "v", "kinds") for y in joined(x, "w", "own")]
    return reduce(DataFrame.unionAll, found)


def lm_scores(
    docs: DataFrame, target_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", held: int = HELD_WORDS, head: int = HEAD,
) -> DataFrame:
    """A row for each row of ``docs``: doc_id, n_words, score. ``target_ids`` holds the target documents' ids in ``id_col``."""
    context = docs.sparkSession.sparkContext
    narrow = docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text"))
    kind, id_type = narrow.schema["doc_id"].dataType.simpleString(), to_arrow_type(narrow.schema["doc_id"].dataType)
    ids = target_ids.select(col(id_col).alias("doc_id")).where("doc_id IS NOT NULL").distinct()
    with shuffles_freed(docs.sparkSession), short_lived(word_counts(narrow, "text"), "words") as counts:
        # With the start and an unknown word, so that an empty vocabulary has a distribution too.
        vocabulary = counts.count() + 2
        known = held_words(counts, held)
        every_word = counts.agg(F.sum("n")).first()[0] or 0
    words = context.broadcast(known)

    flagged = having(narrow, ids, "doc_id", "in_target")
    documents, targets = docs.count(), ids.count()
    part = int(min(1.0, targets / max(1, documents)) * 1_000_000)
    spot = F.pmod(F.xxhash64(F.lit("background"), "doc_id"), F.lit(1_000_000))
    flagged = flagged.withColumn("in_background", F.coalesce(spot < part, F.lit(False)))
    with shuffles_freed(docs.sparkSession), short_lived(pair_counts(flagged, words), "pairs") as pairs:
        sums = cut_lineage(word_sums(pairs), "sums")
        totals = sums.agg(*[F.coalesce(F.sum(f"{m}_own"), F.lit(0)).alias(m) for m in ("target", "background")]).first()
        sizes = {m: totals[m] + vocabulary for m in totals.asDict()}
        of_pairs = cut_lineage(pair_gains(pairs, sums, sizes), "gains")
    # What a word adds that occurs in neither part.
    share = float(np.log(sizes["background"]) - np.log(sizes["target"]))
    of_words = word_gains(sums)
    numbered = of_words.where(F.col("code") < HASHED).toArrow()
    by_before, by_word = np.zeros(len(known) + FIRST_WORD), np.zeros(len(known) + FIRST_WORD)
    for to, name in ((by_before, "before"), (by_word, "own")):
        to[np.asarray(numbered["code"])] = np.asarray(numbered[name])

    cut = head_of(of_pairs, most=head)
    frequent = of_pairs.where(F.col("n") >= cut).select("code", "gain").toArrow()
    order = np.argsort(np.asarray(frequent["code"]))
    tables = context.broadcast((by_before, by_word, np.asarray(frequent["code"])[order], np.asarray(frequent["gain"])[order]))

    rare = of_pairs.where(F.col("n") < cut)
    # Parts of the codes, so many that neither the gains of one nor what documents ask of it are more than a task holds.
    parts = 1 + max(rare.count() // PART_GAINS, every_word // PART_WORDS)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            for ids, texts in text_slices(batch.column(0), batch.column(1)):
                lengths, totals, unit, whose, times = slice_units(texts, words.value, tables.value, share)
                rows = row + np.arange(len(lengths))
                row += len(lengths)
                yield plainly(rows % parts, rows, ids, pa.array(lengths, pa.int64()), pa.array(totals))
                # Other units go to the part of their code, each slice's in one row with the documents that hold them.
                yield from packed(unit, parts, int(rows[0]), whose, times)

    def plainly(part: np.ndarray, rows: np.ndarray, ids: pa.Array, lengths: pa.Array, totals: pa.Array) -> pa.RecordBatch:
        nothing = pa.nulls(len(rows), pa.binary())
        first = pa.array(np.full(len(rows), rows[0]))
        return pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), first, pa.array(rows), ids, lengths, totals, *[nothing] * 3], PACKED)

    def packed(unit: np.ndarray, parts: int, row: int, *with_it: np.ndarray) -> Iterator[pa.RecordBatch]:
        """A row for each part: its units in order, and what comes with each."""
        part = mixed(unit.astype(np.uint64)) % np.uint64(parts)
        order = np.argsort(part.astype(np.min_scalar_type(parts)), kind="stable")
        found, first = np.unique(part[order], return_index=True)
        if len(found):
            ends = [*first[1:], len(unit)]
            blobs = [[to_planes(x[order[i:j]]) for i, j in zip(first, ends)] for x in (unit, *with_it)]
            blobs += [[None] * len(found)] * (3 - len(blobs))
            rest = [pa.nulls(len(found), t) for t in (pa.int64(), id_type, pa.int64(), pa.float64())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(found.astype(np.int32)), pa.array(np.full(len(found), row)), *rest, *(pa.array(b, pa.binary()) for b in blobs)], PACKED
            )

    def pack_gains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= HELD_PAIRS:
                yield from gains_packed(held)
                held, size = [], 0
        if held:
            yield from gains_packed(held)

    def gains_packed(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, gain, before = (np.concatenate([np.asarray(b.column(k)) for b in held]) for k in range(3))
        order = np.argsort(unit)
        return packed(unit[order], parts, GAINS, gain[order], before[order])

    def answer(rows: pa.Table) -> pa.Table:
        """The documents' rows as they are, and a row for each slice with what the part's units add to its documents."""
        blobs = rows.filter(pc.is_valid(rows["units"]))
        plain = rows.filter(pc.is_null(rows["units"])).select(ANSWERED[:5])
        plain = plain.append_column("places", pa.nulls(len(plain), pa.binary())).append_column("sums", pa.nulls(len(plain), pa.binary()))
        slices = list(zip(blobs["slice"].to_pylist(), *(blobs[c] for c in PACKED[-3:])))
        of_gains = [[from_planes(x, k) for x, k in zip(told, (np.int64, np.float32, np.float32))] for first, *told in slices if first == GAINS]
        if not of_gains:
            return plain
        codes, at = np.unique(np.concatenate([x[0] for x in of_gains]), return_inverse=True)
        gains, befores = (np.bincount(at, np.concatenate([x[k] for x in of_gains]), len(codes)) for k in (1, 2))
        firsts, places, sums = [], [], []
        for first, *told in slices:
            if first != GAINS:
                unit, owner, times = (from_planes(x, k) for x, k in zip(told, (np.int64, np.int32, np.int32)))
                at = np.minimum(np.searchsorted(codes, unit), len(codes) - 1)
                there = codes[at] == unit
                at, owner, times = at[there], owner[there], times[there]
                added = np.bincount(owner, np.where(times == LAST, -befores[at], gains[at] * times))
                whose = np.unique(owner)
                firsts.append(first)
                places.append(whose.tobytes())
                sums.append(added[whose].tobytes())
        nothing = [pa.nulls(len(firsts), t) for t in (pa.int64(), id_type, pa.int64(), pa.float64())]
        answers = pa.table([pa.array(firsts, pa.int64()), *nothing, pa.array(places, pa.binary()), pa.array(sums, pa.binary())], ANSWERED)
        return pa.concat_tables([plain, answers.cast(plain.schema)])

    def summed(rows: pa.Table) -> pa.Table:
        """A slice's documents, with what all parts add to them."""
        plain = rows.filter(pc.is_valid(rows["row"]))
        place = np.asarray(plain["row"]) - np.asarray(plain["slice"])
        added = np.zeros(place.max() + 1)
        for whose, sums in zip(rows["places"], rows["sums"]):
            if whose.is_valid:
                added[np.frombuffer(whose.as_buffer(), np.int32)] += np.frombuffer(sums.as_buffer(), np.float64)
        total, n = np.asarray(plain["known"]) + added[place], np.asarray(plain["n_words"])
        score = np.divide(total, n, out=np.zeros(len(n)), where=n > 0)
        return pa.table([plain["doc_id"], plain["n_words"], pa.array(score)], ["doc_id", "n_words", "score"])

    gains = rare.select("code", "gain", F.lit(0.0).cast("float").alias("before"))
    both_places = (F.col("before") + F.col("own")).cast("float")
    far_words = of_words.where((F.col("code") >= HASHED) & ((F.col("before") != 0) | (F.col("own") != 0)))
    gains = gains.unionAll(far_words.select("code", both_places, F.col("before").cast("float")))
    row_type = f"slice bigint, row bigint, doc_id {kind}, n_words bigint, known double"
    packed_type = f"part int, {row_type}, units binary, with_it binary, times binary"
    both = narrow.mapInArrow(score, packed_type).unionAll(gains.mapInArrow(pack_gains, packed_type))
    answers = both.groupBy("part").applyInArrow(answer, f"{row_type}, places binary, sums binary")
    return answers.groupBy("slice").applyInArrow(summed, f"doc_id {kind}, n_words bigint, score double")
