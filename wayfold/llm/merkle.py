"""A Merkle manifest of a dataset: leaf digests, a tree for each group, a tree over the groups, and a proof for every row.

Nested-struct rollup. A leaf's rank in its group is written as octal digits. Within a block, which is all ranks that agree above
the last four digits, the digit columns are grouped away one by one: ``groupBy`` on the digits that are left collects the children into
an array of structs and hashes them, so that the block becomes one row that holds its whole subtree (4,096 leaves at most). The blocks' digests are
rolled up in the same way until one is left in each group, and the groups' digests likewise. Going back, a block's row
meets the path above it in one grouping, and four ``transform`` and ``explode`` steps hand every leaf its siblings. There is no join.

Ranks come from blocks of values whose counts give offsets, so a group with most of the rows is spread over tasks. A node that is the
first of its level and has one child is all there is of its group: it takes the child's digest and adds nothing to a proof.

Cases: a null id, group or field is written as ``-`` and sorts first; null ids are never tampered with; equal ids are ordered by
their leaf digests, and rows that are equal in every field are leaves of their own, side by side; empty texts have length 0 and long ones are
hashed whole; an empty table gives an empty table; only named columns are read, so other columns of any name do no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import col, ranked
from wayfold.operators.blocks import in_number_order
from wayfold.session import cut_lineage

BITS = 3  # a run has eight nodes
DIGITS = 4  # digits that are grouped away within a block
ROWS_PER_BLOCK = 10_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_LEAST = -(1 << 63)


def written(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*fields: Column) -> Column:
    return F.sha2(F.concat(*map(written, fields)).cast("binary"), 256)


def _joined_digest(parts: Column) -> Column:
    return F.sha2(F.array_join(parts, "").cast("binary"), 256)


def _rolled(nodes: DataFrame, keys: list[str], payload: list[str]) -> DataFrame:
    """A row for each block of ranks: keys, rank of the block, digest, and ``kids``, the nested structs of its subtree."""
    digits = [F.shiftright("rank", BITS * j).bitwiseAND(F.lit((1 << BITS) - 1)).cast("tinyint").alias(f"d{j}") for j in range(DIGITS)]
    rows = nodes.select(*keys, F.shiftright("rank", BITS * DIGITS).alias("block"), *digits, "digest", *payload)
    # One exchange serves all the groupings, whose keys begin with these.
    rows = rows.repartition(*keys, "block").select("*", F.struct(F.col("d0").alias("digit"), "digest", *payload).alias("kid"))
    for j in range(1, DIGITS + 1):
        left = ["block", *[f"d{k}" for k in range(DIGITS - 1, j - 1, -1)]]
        runs = rows.groupBy(*keys, *left).agg(F.sort_array(F.collect_list("kid")).alias("kids"))
        alone = (F.size("kids") == 1) & F.forall(F.array(*[F.col(c).cast("bigint") for c in left]), lambda x: x == 0)
        digest = F.when(alone, F.col("kids")[0]["digest"]).otherwise(_joined_digest(F.col("kids")["digest"]))
        runs = runs.select(*keys, *left, digest.alias("digest"), "kids")
        if j == DIGITS:
            return runs.withColumnRenamed("block", "rank")
        rows = runs.select(*keys, *left, F.struct(F.col(f"d{j}").alias("digit"), "digest", "kids").alias("kid"))


def _tree(leaves: DataFrame, keys: list[str], payload: list[str]) -> list[DataFrame]:
    """The written blocks of every storey; the last has one block for each key."""
    storeys = [cut_lineage(_rolled(leaves, keys, payload), "merkle-blocks")]
    while (storeys[-1].agg(F.max("rank")).first()[0] or 0) > 0:
        storeys.append(cut_lineage(_rolled(storeys[-1].select(*keys, "rank", "digest"), keys, []), "merkle-blocks"))
    return storeys


def _siblings(kids: Column, place: Column) -> Column:
    others = kids["digest"]
    return F.struct(
        F.array_join(F.slice(others, F.lit(1), place), "").alias("before"),
        F.array_join(F.slice(others, place + 2, F.size(others)), "").alias("after"),
    )


def _descended(blocks: DataFrame, above: DataFrame, keys: list[str], told: list[str], payload: list[str]) -> DataFrame:
    """The nodes that the blocks were rolled up from: keys, rank, digest, ``path``, the columns ``told`` from above, and their payload.

    ``above`` has the path over each block. The two meet by grouping: one row of either kind for each block.
    """
    both = blocks.select(*keys, "rank", "kids").unionByName(above.select(*keys, "rank", "path", *told), allowMissingColumns=True)
    rows = both.groupBy(*keys, "rank").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("kids", "path", *told)])
    for j in range(DIGITS):
        alone = (F.size("kids") == 1) & (F.col("rank") == 0)
        own = F.when(alone, F.array().cast("array<struct<before:string,after:string>>"))
        nested = F.transform(
            "kids",
            lambda kid, place: F.struct(kid.alias("kid"), own.otherwise(F.array(_siblings(F.col("kids"), place))).alias("own")),
        )
        rows = rows.select(*keys, "rank", "path", *told, F.explode(nested).alias("found"))
        inner = [F.col("found.kid.kids").alias("kids")] if j < DIGITS - 1 else [F.col(f"found.kid.{c}").alias(c) for c in ("digest", *payload)]
        rank = F.shiftleft("rank", BITS) + F.col("found.kid.digit")
        rows = rows.select(*keys, rank.alias("rank"), F.concat("found.own", "path").alias("path"), *told, *inner)
    return rows


def _proved(storeys: list[DataFrame], above: DataFrame, keys: list[str], told: list[str], payload: list[str]) -> DataFrame:
    for blocks in reversed(storeys[1:]):
        above = _descended(blocks, above, keys, told, [])
    return _descended(storeys[0], above, keys, told, payload)


def manifest(
    docs: DataFrame, leaf: Column, group_col: str = "lang", id_col: str = "doc_id", carried: dict[str, Column] | None = None,
    rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """A row for each document: group, its id, rank in the group, leaf, subroot, root, and path, the siblings (before, after) of each level.

    ``leaf`` gives the digest of a row; ``carried`` names further columns to be computed from the row and handed on. Ids are whole
    numbers; leaves ascend by them within a group.
    """
    extra = carried or {}
    ident = col(id_col)
    rows = docs.select(
        col(group_col).alias("group"), ident.alias("id"), F.coalesce(ident.cast("bigint"), F.lit(_LEAST)).alias("order"), leaf.alias("digest"),
        *[c.alias(f"c_{n}") for n, c in extra.items()],
    )
    payload = ["id", *[f"c_{n}" for n in extra]]
    leaves = ranked(rows, ["group"], ["order", "digest"], rows_per_block)
    storeys = _tree(leaves, ["group"], payload)
    subroots = storeys[-1].select(F.lit(0).alias("all"), "group", "digest")
    named = subroots.withColumn("lead", F.coalesce(in_number_order(subroots.withColumn("group", F.col("group").cast("string")), "group"), F.lit(-1.0)))
    top = _tree(ranked(named, ["all"], ["lead", "group"], rows_per_block), ["all"], ["group"])
    nothing = F.array().cast("array<struct<before:string,after:string>>")
    roots = top[-1].select("all", F.lit(0).cast("bigint").alias("rank"), nothing.alias("path"), F.col("digest").alias("root"))
    groups = _proved(top, roots, ["all"], ["root"], ["group"])
    above = groups.select("group", F.lit(0).cast("bigint").alias("rank"), "path", F.col("digest").alias("subroot"), "root")
    out = _proved(storeys, above, ["group"], ["subroot", "root"], payload)
    return out.select("group", "id", "rank", F.col("digest").alias("leaf"), "subroot", "root", "path", *[F.col(f"c_{n}").alias(n) for n in extra])


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(path, leaf, lambda digest, run: F.sha2(F.concat(run["before"], digest, run["after"]).cast("binary"), 256))


def proof_digest(path: Column) -> Column:
    """One digest of all siblings, level by level, left to right."""
    return _joined_digest(F.flatten(F.transform(path, lambda run: F.array(run["before"], run["after"]))))


def documents_manifest(docs: DataFrame, tampered: Column, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """The manifest of a table like ``documents``, checked against the rows as they are where ``tampered``: texts in lower case (A-Z)."""
    fields = [col(f) for f in FIELDS]
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    changed = leaf_digest(*[F.translate(c, upper, upper.lower()) if f == "text" else c for f, c in zip(FIELDS, fields)])
    found = manifest(docs, leaf_digest(*fields), carried={"present": F.when(tampered, changed)}, rows_per_block=rows_per_block)
    told = found.select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"),
        folded(F.coalesce("present", "leaf"), F.col("path")).alias("folded_root"),
    )
    return told.withColumn("verified", F.col("folded_root") == F.col("root"))
