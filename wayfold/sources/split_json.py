"""One JSON document of any size, read by many tasks.

Spark cuts the file at every ``}`` and deals out byte ranges of it, so a piece holds opening braces only and closes at most one object, at
its end. Two passes over the pieces follow, each in the order of the file within a range:

1. every range tells, for a start inside and outside a string, how it ends: inside a string or not, how many objects deeper,
   how far up it came, and which keys it saw at which depth. From these few rows the driver works out how each range really starts;
2. every range, knowing its start, cuts out the objects of the second level, which are the records of the layers. A record that
   crosses ranges comes in fragments, at most two for a range, which are grouped and joined.

Only a record has to fit a task. Strings may hold braces and quotes. Compressed files cannot be split and are read by one task.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_REST = re.compile(r'(?:[^"\\]|\\.)*("?)', re.S)
_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*("?)|\{', re.S)
_KEY = re.compile(r'("(?:[^"\\]|\\.)*")\s*:\s*(\[?)\s*\Z', re.S)


def scanned(piece: str, inside: bool) -> tuple[list[int], bool]:
    """Places of the braces that open an object, and whether the piece ends inside a string."""
    start, opens = 0, []
    if inside:
        rest = _REST.match(piece)
        if not rest[1]:
            return opens, True
        start = rest.end()
    for token in _TOKEN.finditer(piece, start):
        if token[0] == "{":
            opens.append(token.start())
        elif not token[1]:
            return opens, True
    return opens, False


def key_before(piece: str, brace: int, after: int) -> tuple[str, bool] | None:
    """The key that an opening brace belongs to, and whether the brace opens the first element of its array."""
    found = _KEY.search(piece, after, brace)
    return None if found is None else (json.loads(found[1]), bool(found[2]))


@dataclass(frozen=True)
class Start:
    """How a byte range begins: in a string, so many objects deep, in which layer, and the range where the open record began."""

    inside: bool
    depth: int
    layer: str | None
    in_array: bool
    opened: int


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    read = spark.read.option("lineSep", "}").text(path)
    return read.select("_metadata.file_path", "_metadata.file_block_start", "value")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, list[str]]]:
    """(file, range, pieces), a part of a batch at a time; a task's ranges come one after the other."""
    for batch in batches:
        now, held = None, []
        for file, start, piece in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if (file, start) != now:
                if held:
                    yield *now, held
                now, held = (file, start), []
            held.append(piece)
        if held:
            yield *now, held


def _summarised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, states = None, []

    def told() -> pa.RecordBatch:
        text = json.dumps([[inside, depth, least, sorted([d, *k] for d, k in keys.items())] for inside, depth, least, keys in states])
        return pa.RecordBatch.from_arrays([pa.array([now[0]]), pa.array([now[1]], pa.int64()), pa.array([text])], ["file", "range", "ends"])

    for file, start, pieces in _runs(batches):
        if (file, start) != now:
            if now is not None:
                yield told()
            now, states = (file, start), [[False, 0, 0, {}], [True, 0, 0, {}]]
        for piece in pieces:
            for state in states:
                opens, state[0] = scanned(piece, state[0])
                after = 0
                for brace in opens:
                    key = key_before(piece, brace, after)
                    if key is not None:
                        state[3][state[1]] = key
                    state[1] += 1
                    after = brace + 1
                state[1] -= not state[0]
                state[2] = min(state[1:3])
    if now is not None:
        yield told()


def starts(spark: SparkSession, path: str) -> dict[tuple[str, int], Start]:
    """The start of every byte range; the driver sees one row for each range."""
    rows = _pieces(spark, path).mapInArrow(_summarised, "file string, range bigint, ends string").collect()
    found: dict[tuple[str, int], Start] = {}
    file, inside, depth, layer, in_array, opened = None, False, 0, None, False, -1
    for row in sorted(rows, key=lambda r: (r["file"], r["range"])):
        if row["file"] != file:
            file, inside, depth, layer, in_array, opened = row["file"], False, 0, None, False, -1
        found[file, row["range"]] = Start(inside, depth, layer, in_array, opened)
        ends = json.loads(row["ends"])[inside]
        for below, key, is_array in ends[3]:
            if depth + below == 1:
                layer, in_array = key, is_array
        # What is open at the end began in this range, unless all of the range belongs to one record.
        if depth + ends[2] < 2:
            opened = row["range"]
        inside, depth = ends[0], depth + ends[1]
    return found


_RECORDS = "file string, opened bigint, range bigint, layer string, in_array boolean, whole boolean, record string"


def _cutter(known: dict[tuple[str, int], Start]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = ["file", "opened", "range", "layer", "in_array", "whole", "record"]
    types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.bool_(), pa.string()]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out = None, []
        inside, depth, layer, in_array, text, begun = False, 0, None, False, [], False

        def packed() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
            out.clear()
            return batch

        def rest() -> None:
            """What is open at the end of a range is a fragment."""
            if now is not None and text and depth >= 2:
                out.append((now[0], now[1] if begun else known[now].opened, now[1], layer, in_array, False, "".join(text)))

        for file, start, pieces in _runs(batches):
            if (file, start) != now:
                rest()
                now, s = (file, start), known[file, start]
                inside, depth, layer, in_array, text, begun = s.inside, s.depth, s.layer, s.in_array, [], False
            for piece in pieces:
                opens, ends_inside = scanned(piece, inside)
                first, after = 0, 0
                for brace in opens:
                    if depth == 1:
                        key = key_before(piece, brace, after)
                        if key is not None:
                            layer, in_array = key
                        first, text, begun = brace, [], True
                    depth += 1
                    after = brace + 1
                if depth >= 2:
                    text.append(piece[first:] + "}")
                inside = ends_inside
                if not inside:
                    depth -= 1
                    if depth == 1:
                        opened = start if begun else known[now].opened
                        out.append((file, opened, start, layer, in_array, begun, "".join(text)))
                        text, begun = [], False
            if out:
                yield packed()
        rest()
        if out:
            yield packed()

    return cut


def split_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, layer, in_array, record): every object of the document's second level as text, under its key of the first level."""
    parts = _pieces(spark, path).mapInArrow(_cutter(starts(spark, path)), _RECORDS)
    joined = parts.where("not whole").groupBy("file", "opened").agg(
        F.max_by("layer", -F.col("range")).alias("layer"), F.max_by("in_array", -F.col("range")).alias("in_array"),
        F.array_join(F.sort_array(F.collect_list(F.struct("range", "record")))["record"], "").alias("record"),
    )
    return parts.where("whole").select("file", "layer", "in_array", "record").unionByName(joined.drop("opened"))
