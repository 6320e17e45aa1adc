"""MinHash near-dedup with fast similarity sketching, banding and verification on full shingle sets.

Sketch: ``T`` coordinates are filled in rounds. In round i < T every shingle is hashed to one coordinate and a value in
[i, i + 1); in round T + i every shingle competes for coordinate i. A coordinate keeps its least value, and a document stops after the
round that fills its last coordinate, so each coordinate is filled by round 2T at the latest, a long document is hashed about
once, and the share of equal coordinates is concentrated around the Jaccard similarity.

Links are found without writing out all pairs of a group:

1. Documents with the same shingle set are one class, held by its smallest id; only classes go on.
2. Bands of ``ROWS`` coordinates make buckets. A round of stars compares one pivot of each bucket with the bucket's other
   classes that are not yet in its component; more rounds take other pivots while that leaves much to compare.
3. Pairs of one bucket that are still in different components are then compared exhaustively: in small buckets by a join, in
   large ones block against block inside a task, where only pairs whose sketches agree in at least ``LEAST_AGREE`` coordinates go
   on, and only links that join components come out.
4. Every link is verified on the full shingle sets, and links are contracted to components.

A pair of similarity 0.75 shares no band with probability (1 - 0.75^3)^32 = 2.4e-8, and agrees in fewer than 48 of 96
coordinates with probability below 1e-7; beyond that no link between different components is lost.

Cases: null and empty texts have no shingles and no links; fewer words than the shingle size make one shingle; rows that share an
id are one node (of several different texts under one id, large buckets compare one); a null id takes part in no link, has no component and is kept; very long texts are shingled whole; an
empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import byte_lists, col, free_names, lower_ascii_words, mixed, shingle_hashes, sized, text_slices, word_hashes
from wayfold.llm.components import components
from wayfold.session import cut_lineage

SHINGLE = 5
SIMILAR = (75, 100)
T, ROWS = 96, 3
LEAST_AGREE = 48
# Buckets up to this many classes are compared by a join; larger ones in blocks of about BLOCK classes or BLOCK_SHINGLES shingles at most.
SMALL_BUCKET, BLOCK, BLOCK_SHINGLES = 32, 1024, 500_000
STAR_ROUNDS = 2
# Sketching holds several numbers for each shingle, so it takes less text at once.
SLICE_BYTES = 1 << 20


def shingle_set(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the word shingles."""
    return np.unique(shingle_hashes(word_hashes(lower_ascii_words(text)), size))


def sketches(sets: list[np.ndarray], t: int = T) -> np.ndarray:
    """A row of ``t`` coordinates for each set; the row of an empty set is meaningless."""
    n = len(sets)
    out = np.zeros((n, t), np.uint32)
    filled = np.zeros((n, t), bool)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    hashes = np.concatenate(sets) if n else np.empty(0, np.uint64)
    empty = np.uint64(0xFFFFFFFFFFFFFFFF)
    for i in range(2 * t):
        if len(owner) == 0:
            break
        x = mixed(hashes ^ np.uint64((i + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        place = ((x >> np.uint64(32)) * np.uint64(t) >> np.uint64(32)).astype(np.int64) if i < t else np.full(len(x), i - t)
        low = x & np.uint64(0xFFFFFFFF)
        best = np.full(n * t, empty)
        np.minimum.at(best, owner * t + place, low)
        best = best.reshape(n, t)
        new = (best != empty) & ~filled
        out[new] = best[new].astype(np.uint32) ^ np.uint32(i * 0x9E3779B1 & 0xFFFFFFFF)
        filled |= new
        left = ~filled.all(axis=1)
        going = left[owner]
        if not going.all():
            owner, hashes = owner[going], hashes[going]
    return out


def sketched(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n_shingles, set_key (16 bytes that name the shingle set), sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in text_slices(batch.column(0), batch.column(1), SLICE_BYTES):
                sets = [shingle_set(t) for t in byte_lists(texts)]
                rows = sketches(sets)
                keys = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
                lists = pa.FixedSizeListArray.from_arrays(pa.array(rows.view(np.int32).ravel()), T).cast(pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), lists], ["doc_id", "n_shingles", "set_key", "sketch"],
                )

    kind = docs.select(col(id_col)).schema[0].dataType.simpleString()
    narrow = docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text"))
    return narrow.mapInArrow(run, f"doc_id {kind}, n_shingles bigint, set_key binary, sketch array<int>")


def shingle_sets(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(rep, shingles) of the documents whose id is among ``ids`` (rep)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_slices(batch.column(0), batch.column(1)):
                sets = [shingle_set(t).view(np.int64) for t in byte_lists(texts)]
                yield pa.RecordBatch.from_arrays([part, pa.array(sets, pa.list_(pa.int64()))], ["rep", "shingles"])

    kind = docs.select(col(id_col)).schema[0].dataType.simpleString()
    narrow = docs.select(col(id_col).alias("rep"), col(text_col).alias("text"))
    return narrow.join(sized(ids), "rep", "left_semi").mapInArrow(run, f"rep {kind}, shingles array<bigint>")


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) whose shingle sets are similar."""
    a, b = (sets.select(F.col("rep").alias(k), F.col("shingles").alias(s)) for k, s in (("u", "su"), ("v", "sv")))
    both = F.size(F.array_intersect("su", "sv")).cast("long")
    met = pairs.join(b, "v").join(a, "u").withColumn("both", both)
    low, of = SIMILAR
    return met.where(F.lit(of) * F.col("both") >= F.lit(low) * (F.size("su") + F.size("sv") - F.col("both"))).select("u", "v")


def _block_links(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (u, v) between components inside large buckets: blocks of classes are compared two at a time.

    The blocks of a bucket are cut by a hash of the id, and each task gets one pair of blocks with their sketches and shingle sets,
    whatever the size of the bucket. A pair is looked at in the first band that it shares, only if its classes are in different
    components, and only links that join components are given, fewer than a block pair has classes.
    """
    sizes = members.groupBy("bucket").agg(F.greatest(F.ceil(F.count("*") / F.lit(BLOCK)), F.ceil(F.sum("n_shingles") / F.lit(BLOCK_SHINGLES))).cast("int").alias("blocks"))
    cut = members.join(sizes, "bucket").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    cut = cut.join(sets.dropDuplicates(["rep"]), "rep").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cut = cut.select(
        "bucket", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "block", "band", "rep", "comp", "sketch", "shingles",
    )

    def compare(table: pa.Table) -> pa.Table:
        rep, comp, block = (table[c].to_numpy().copy() for c in ("rep", "comp", "block"))
        one, two, band = (table[c][0].as_py() for c in ("one", "two", "band"))
        sketch = np.asarray(table["sketch"].combine_chunks().flatten()).reshape(len(rep), T)
        lists = table["shingles"].combine_chunks()
        values, n = np.asarray(lists.flatten()).view(np.uint64), np.asarray(pc.list_value_length(lists)).astype(np.int64)
        first = np.cumsum(n) - n
        us, vs = [], []
        for i in np.flatnonzero(block == one).tolist():
            at = np.flatnonzero((comp != comp[i]) & (SIMILAR[1] * np.minimum(n, n[i]) >= SIMILAR[0] * np.maximum(n, n[i])) & ((rep > rep[i]) if one == two else (block == two)))
            same = sketch[at] == sketch[i]
            at, same = at[(wide := same.sum(axis=1) >= LEAST_AGREE)], same[wide]
            at = at[same.reshape(len(at), T // ROWS, ROWS).all(axis=2).argmax(axis=1) == band]
            if not len(at):
                continue
            own = values[first[i] : first[i] + n[i]]
            ends = np.cumsum(n[at])
            theirs = values[np.arange(ends[-1]) + np.repeat(first[at] - (ends - n[at]), n[at])]
            found = own[np.minimum(np.searchsorted(own, theirs), len(own) - 1)] == theirs
            both = np.add.reduceat(found, ends - n[at])
            for k in at[SIMILAR[1] * both >= SIMILAR[0] * (n[at] + n[i] - both)].tolist():
                if comp[k] != comp[i]:
                    us.append(min(rep[k], rep[i]))
                    vs.append(max(rep[k], rep[i]))
                    comp[comp == comp[k]] = comp[i]
        return pa.table({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64())})

    return cut.groupBy("bucket", "one", "two").applyInArrow(compare, "u bigint, v bigint")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of ``docs``: doc_id, n_shingles, component_id, kept. Ids are whole numbers."""
    docs = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).alias("text"))
    base = cut_lineage(sketched(docs, "doc_id", "text"), "sketches")
    able = base.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = able.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"))
    classes = cut_lineage(classes, "classes")

    bands = F.array(*[F.xxhash64(F.lit(b), *(F.col("sketch")[b * ROWS + k] for k in range(ROWS))) for b in range(T // ROWS)])
    banded = classes.select("rep", F.posexplode(bands).alias("band", "bucket"))
    shared = banded.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    members = cut_lineage(banded.join(shared, "bucket"), "buckets")

    candidates = cut_lineage(members.select("rep").distinct(), "candidates")
    sets = cut_lineage(shingle_sets(docs, candidates, "doc_id", "text").where(F.size("shingles") > 0), "shingles")

    spark = docs.sparkSession
    links = spark.createDataFrame([], "u bigint, v bigint")
    tried = links
    labels: DataFrame | None = None
    budget = 2 * classes.count()

    def placed() -> DataFrame:
        """Members of buckets that hold more than one component yet."""
        if labels is None:
            return members.withColumn("comp", F.col("rep"))
        now = members.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
        still = now.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("bucket")
        return cut_lineage(now.join(still, "bucket"), "open")

    def settle(pairs: DataFrame, more: DataFrame | None = None) -> None:
        nonlocal links, tried, labels
        if more is not None:
            links = links.unionByName(cut_lineage(more, "block-links"))
        pairs = pairs.distinct().join(tried, ["u", "v"], "left_anti")
        pairs = cut_lineage(pairs, "pairs")
        tried = tried.unionByName(pairs)
        links = links.unionByName(cut_lineage(_linked(pairs, sets), "links"))
        labels = cut_lineage(components(links), "labels")

    def ordered(df: DataFrame) -> DataFrame:
        return df.select(F.least("rep", "pivot").alias("u"), F.greatest("rep", "pivot").alias("v"))

    now = placed()
    for turn in range(STAR_ROUNDS):
        # Another pivot in each bucket, so that a large group is compared with many of its members.
        pivot = F.min(F.struct(F.xxhash64(F.lit(turn), "bucket", "rep").alias("h"), "rep", "comp")).alias("p")
        pivots = now.groupBy("bucket").agg(pivot).select("bucket", F.col("p.rep").alias("pivot"), F.col("p.comp").alias("own"))
        settle(ordered(now.join(pivots, "bucket").where("comp <> own")))
        now = placed()
        # Pairs still in different components, from counts alone.
        in_comp = now.groupBy("bucket", "comp").agg(F.count("*").alias("n"))
        left = in_comp.groupBy("bucket").agg(((F.sum("n") * F.sum("n") - F.sum(F.col("n") * F.col("n"))) / 2).alias("pairs"))
        if (left.agg(F.sum("pairs")).first()[0] or 0) <= budget:
            break

    known = now.join(classes.select("rep", "n_shingles", "sketch").dropDuplicates(["rep"]), "rep")
    sizes = now.groupBy("bucket").agg(F.count("*").alias("size"))
    known = cut_lineage(known.join(sizes, "bucket"), "last")
    few = known.where(F.col("size") <= SMALL_BUCKET)
    one, two = (few.select("bucket", *(F.col(c).alias(f"{c}_{k}") for c in ("rep", "comp", "n_shingles"))) for k in (1, 2))
    joined = one.join(two, "bucket").where("rep_1 < rep_2 AND comp_1 <> comp_2")
    joined = joined.where("100 * least(n_shingles_1, n_shingles_2) >= 75 * greatest(n_shingles_1, n_shingles_2)")
    near = joined.select(F.col("rep_1").alias("u"), F.col("rep_2").alias("v"))
    settle(near, _block_links(known.where(F.col("size") > SMALL_BUCKET), sets))

    named = classes.select("set_key", "rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    named = named.select("set_key", F.coalesce("comp", "rep").alias("component"))
    out = base.drop("sketch").join(named, "set_key", "left")
    # Empty sets are alone under their own id.
    component = F.when(F.col("n_shingles") > 0, F.when(F.col("doc_id").isNotNull(), F.col("component"))).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that are linked, directly or over others, to a smaller id."""
    name = free_names(docs, "near_id")[0]
    groups = cut_lineage(near_groups(docs, id_col, text_col), "near-groups")
    # An id in several rows is one node: it goes if any of its rows does.
    gone = groups.where("NOT kept").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(sized(gone), col(id_col).cast("long") == F.col(name), "left_anti")
