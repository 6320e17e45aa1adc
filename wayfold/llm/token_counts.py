"""Token counts: every distinct pre-token is tokenized once, and its number of pieces is joined to the documents' counts.

A pre-token here is the coarsest piece of text that the tokenizer never looks beyond: for a vocabulary that drops white space,
what lies between ASCII white space; for any other vocabulary the whole text. No token ids are kept.

Two passes over the texts. The first counts pre-tokens; each distinct one is tokenized by the library itself. Pre-tokens are
as skewed as words, so the join has two exact ways: the most frequent (at most ``HEAD``, cut at a power of two of their
counts) are sent to every task and never shuffled; the others are shuffled and joined by the pre-token.

Cases: a null text is empty and has no tokens; every row of ``docs`` gives a row, repeated ones and null ids too; a very long
text is counted whole, in a task's bounded slices of rows; an empty table gives an empty table.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import byte_lists, col, counted_units, head_of, text_slices
from wayfold.session import cut_lineage

HEAD = 1 << 17


@lru_cache(maxsize=4)
def tokenizer(path: str):
    """The library's tokenizer for a vocabulary file, on one thread: Spark's tasks are the parallel part."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path.endswith(".model"):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=path)
    from tokenizers import Tokenizer

    loaded = Tokenizer.from_file(path)
    loaded.no_padding()
    loaded.no_truncation()
    return loaded


@lru_cache(maxsize=4)
def drops_white_space(path: str) -> bool:
    """Does the vocabulary's own pre-tokenizer remove white space, so that no token spans it?"""
    if not path.endswith(".json"):
        return False
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    steps = (model.get("pre_tokenizer") or {}).get("pretokenizers") or [model.get("pre_tokenizer") or {}]
    split = steps[0]
    added = any(t["lstrip"] or t["rstrip"] or " " in t["content"] for t in model.get("added_tokens", ()))
    drops = split.get("type") == "Split" and split.get("behavior") == "Removed" and split.get("invert") and r"[^\s" in split["pattern"].get("Regex", "")
    return bool(drops and not added)


def splitter(path: str) -> Callable[[bytes], list[bytes]]:
    """Cuts a UTF-8 text into pre-tokens; ``bytes.split`` cuts at ASCII white space."""
    return bytes.split if drops_white_space(path) else lambda text: [text] if text else []


# What the vocabulary's file says of its normalizer and pre-tokenizer when words of plain letters can be cut here (fixed values).
_CUT_AT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
# Printable ASCII and the letters of Latin-1: each is one code point in NFC, with a lower case that all versions agree on.
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+\Z")
_PLAIN_CUT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")


# Tokenized parts that a task holds on to.
HELD_PARTS = 60_000


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 for itself, the others from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}


class Pieces:
    """Token ids of pre-tokens, by the library's tokenizer.

    If the file's normalizer and pre-tokenizer are the known ones, a pre-token of plain letters is cut by the same pattern here, and the
    library's own model is asked once for each distinct part; any other pre-token goes through the whole tokenizer.
    """

    def __init__(self, path: str):
        self.path, self.loaded = path, tokenizer(path)
        self.model = None
        if path.endswith(".json"):
            with open(path, encoding="utf-8") as f:
                said = json.load(f)
            steps = (said.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
            known = steps[0].get("pattern") == {"Regex": _CUT_AT} and steps[0].get("invert") and steps[-1].get("type") == "ByteLevel"
            known = known and not steps[-1].get("add_prefix_space") and not steps[-1].get("use_regex") and len(steps) == 2
            if known and (said.get("normalizer") or {}).get("normalizers") == _NORMAL and said.get("post_processor") is None:
                self.model = self.loaded.model
                added = [re.escape(t["content"].lower()) for t in said.get("added_tokens", ())]
                self.holds_added = re.compile("|".join(added) or r"(?!)").search
                self.parts: dict[str, list[int]] = {}
                self.letters = str.maketrans(_byte_letters())

    def encode(self, units: list[bytes]) -> list[list[int]]:
        texts = [u.decode("utf-8") for u in units]
        if self.path.endswith(".model"):
            return self.loaded.encode(texts, num_threads=1)
        out: list[list[int] | None] = [None] * len(texts)
        if self.model is not None:
            # Parts come again with other punctuation around them, in later calls too.
            known = self.parts
            if len(known) > HELD_PARTS:
                known.clear()
            for k, text in enumerate(texts):
                low = text.lower()
                if _PLAIN.match(text) and not self.holds_added(low):
                    parts = [low] if low.isalpha() else _PLAIN_CUT.findall(low)
                    ids: list[int] = []
                    for part in parts:
                        found = known.get(part)
                        if found is None:
                            spelt = part if part.isascii() else part.encode().decode("latin-1").translate(self.letters)
                            found = known[part] = [t.id for t in self.model.tokenize(spelt)]
                        ids = found if len(parts) == 1 else ids + found
                    out[k] = ids
        rest = [k for k, ids in enumerate(out) if ids is None]
        for k, e in zip(rest, self.loaded.encode_batch_fast([texts[k] for k in rest], add_special_tokens=False), strict=True):
            out[k] = e.ids
        return out


def pieces_of(counts: DataFrame, path: str) -> DataFrame:
    """Number of pieces of each distinct pre-token: unit, n, pieces."""

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Pieces(path)
        for batch in batches:
            pieces = pa.array(list(map(len, encoder.encode(batch.column(0).to_pylist()))), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pieces], ["unit", "n", "pieces"])

    return counts.mapInArrow(tokenize, "unit binary, n bigint, pieces int")


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", head: int = HEAD) -> DataFrame:
    """A row for each row of ``docs``: doc_id, n_bytes, n_tokens."""
    spark = docs.sparkSession
    table = cut_lineage(pieces_of(counted_units(docs, text_col, splitter(path)), path), "pieces")
    cut = head_of(table, most=head)
    frequent = spark.sparkContext.broadcast({bytes(r["unit"]): r["pieces"] for r in table.where(F.col("n") >= cut).select("unit", "pieces").collect()})

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, known = splitter(path), frequent.value.get
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            for ids, texts in text_slices(batch.column(0), batch.column(1)):
                rows, units, times, sizes, sums, at = [], [], [], [], [], []
                for k, text in enumerate(byte_lists(texts)):
                    row += 1
                    total = 0
                    for unit, n in Counter(split(text)).items():
                        pieces = known(unit)
                        if pieces is None:
                            rows.append(row)
                            units.append(unit)
                            times.append(n)
                            sizes.append(None)
                            sums.append(0)
                            at.append(None)
                        else:
                            total += pieces * n
                    rows.append(row)
                    units.append(b"\xff" + row.to_bytes(8, "little"))  # no UTF-8 text: joins nothing, and spreads
                    times.append(0)
                    sizes.append(len(text))
                    sums.append(total)
                    at.append(k)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(rows, pa.int64()), ids.take(pa.array(at, pa.int32())), pa.array(units, pa.binary()),
                        pa.array(times, pa.int32()), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64()),
                    ],
                    ["row", "doc_id", "unit", "times", "n_bytes", "known"],
                )

    kind = docs.select(col(id_col)).schema[0].dataType.simpleString()
    pairs = docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text")).mapInArrow(
        look_up, f"row bigint, doc_id {kind}, unit binary, times int, n_bytes bigint, known bigint",
    )
    rare = table.where(F.col("n") < cut).select("unit", "pieces")
    joined = pairs.join(rare, "unit", "left")
    return joined.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"),
        F.sum(F.col("known") + F.col("times") * F.coalesce("pieces", F.lit(0))).alias("n_tokens"),
    ).select("doc_id", "n_bytes", "n_tokens")
