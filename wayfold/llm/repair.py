"""Conversation repair: the cheapest edits that give every conversation the form system? (user assistant)*.

Rows are told their fault (blank, duplicate of an earlier row, truncated) and become letters of a small alphabet. Edits keep a row, delete
it, give it another role, or insert an empty turn; which sequences of roles are right is an automaton of four states. A letter is thus a min-plus
matrix: for each pair of states the least cost, and the order of the audits (one initial for each edit) among the cells of a row of the matrix.

Grammar-compressed DP: letters of all conversations, in blocks of 256 rows, are compressed by one Re-Pair grammar, whose most
frequent pairs are counted by Spark over the distinct blocks, a few rounds of pairs that share no symbol. Each rule gets one matrix, the product of
its two symbols', and with it an audit rope: a cell knows the state in the middle, so its audit is its left symbol's followed by its right
symbol's and is only spelled out for the cells that win. Rules are solved bottom-up once and used by all conversations; a block is the product of a few
symbols, and tasks remember the blocks they have solved. Blocks of long conversations are folded in the same way, 256 at a time, up
to one matrix, and the chosen states are handed back down.

Among edits of equal cost the audit that is least in ASCII wins. Audits of one stretch of rows end with the last row's own letter and have as many such
letters, so none is a prefix of another; hence the order inside a product follows from the order in its left factor, then in its right one.

Cases: a null role or text is one space; null turns come first and equal ones are ordered by role and text; repeated rows are duplicates; a null
conversation id is a conversation; a role with any initial but s, u and a cannot be kept; empty texts are blank; an empty
table gives an empty table; only the four named columns are read. A conversation's texts are never held together: they pass through a task in
order, a batch at a time. Its digest is a chain over all of them, so that one task reads a whole conversation, however long.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfold.llm.common import col, ranked
from wayfold.operators.blocks import longest_run, never_null
from wayfold.session import cut_lineage

BLOCK = 256
ROWS_PER_BLOCK = 1_000_000
ROUNDS, PAIRS_A_ROUND = 10, 128
HELD_BLOCKS = 50_000
SPACES = " \t\n\v\f\r"
REROLE, DELETE, INSERT, CLOSE = 3, 4, 3, 3

# States: nothing yet, after system, after user, after assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
# Letters: s, u, a, o (any other initial), in capitals if truncated; x must go.
LETTERS = "suaoSUAOx"
_NO_STATE = -1


def _next(state: int) -> int:
    """The state after the user or assistant turn that the form wants next."""
    return ASSISTANT if state == USER else USER


@dataclass(frozen=True)
class Cell:
    cost: int
    order: int  # place of the audit among those of the same first state
    rope: str | int  # a letter's audit, or the state between the two symbols of a rule


Matrix = list[list["Cell | None"]]


def _ordered(found: dict[tuple[int, int], tuple[int, object, str | int]]) -> Matrix:
    """Cells from (cost, sort key, rope), numbered by the sort key within each first state."""
    matrix: Matrix = [[None] * 4 for _ in STATES]
    for p in STATES:
        row = sorted((f[1], q) for (a, q), f in found.items() if a == p)
        for place, (_, q) in enumerate(row):
            matrix[p][q] = Cell(found[p, q][0], place, found[p, q][2])
    return matrix


def letter_matrix(letter: str) -> Matrix:
    best: dict[tuple[int, int], tuple[int, object, str | int]] = {}
    close = CLOSE if letter.isupper() else 0
    for p in STATES:
        state = p
        for inserts in range(3):
            kept = {"s": SYSTEM if state == START else _NO_STATE, "u": USER, "a": ASSISTANT}.get(letter.lower(), _NO_STATE)
            edits = [("D", state, DELETE)]
            if letter != "x":
                edits.append(("R", _next(state), REROLE + close))
                if kept == SYSTEM or kept == _next(state):
                    edits.append(("K", kept, close))
            for edit, q, cost in edits:
                audit = "I" * inserts + edit
                offer = (cost + INSERT * inserts, audit, audit)
                best[p, q] = min(best.get((p, q), offer), offer)
            state = _next(state)
    return _ordered(best)


def product(left: Matrix, right: Matrix) -> Matrix:
    best: dict[tuple[int, int], tuple[int, object, str | int]] = {}
    for p in STATES:
        for mid in STATES:
            first = left[p][mid]
            if first is None:
                continue
            for q in STATES:
                second = right[mid][q]
                if second is not None:
                    offer = (first.cost + second.cost, (first.order, second.order), mid)
                    best[p, q] = min(best.get((p, q), offer), offer)
    return _ordered(best)


def closed(matrix: Matrix) -> tuple[int, int]:
    """The least cost of a whole conversation, and the state its rows end in."""
    ends = [(c.cost + INSERT * len(tail(q)), c.order, q) for q, c in enumerate(matrix[START]) if c is not None]
    cost, _, q = min(ends)
    return cost, q


def tail(state: int) -> str:
    """Insertions after the last row."""
    return {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}[state]


@dataclass
class Grammar:
    """Rounds of Re-Pair rules; symbols below ``len(LETTERS)`` are letters, others rules in order."""

    rounds: list[dict[tuple[int, int], int]] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    matrices: list[Matrix] = field(default_factory=lambda: [letter_matrix(x) for x in LETTERS])

    def add_round(self, pairs: list[tuple[int, int]]) -> None:
        numbered = {}
        for a, b in pairs:
            numbered[a, b] = len(self.matrices)
            self.pairs.append((a, b))
            self.matrices.append(product(self.matrices[a], self.matrices[b]))
        self.rounds.append(numbered)

    def compressed(self, letters: str) -> list[int]:
        symbols = [LETTERS.index(x) for x in letters]
        for rules in self.rounds:
            out, i = [], 0
            while i < len(symbols):
                rule = rules.get((symbols[i], symbols[i + 1])) if i + 1 < len(symbols) else None
                out.append(symbols[i] if rule is None else rule)
                i += 1 if rule is None else 2
            symbols = out
        return symbols

    def spelled(self, symbol: int, p: int, q: int) -> str:
        """The audit of a cell, along its rope."""
        parts, stack = [], [(symbol, p, q)]
        while stack:
            s, a, b = stack.pop()
            rope = self.matrices[s][a][b].rope
            if s < len(LETTERS):
                parts.append(rope)
            else:
                left, right = self.pairs[s - len(LETTERS)]
                stack += [(right, rope, b), (left, a, rope)]
        return "".join(parts)


def _pair_counts(grammar: Grammar) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for letters, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                symbols = grammar.compressed(letters)
                last = None
                for pair in zip(symbols, symbols[1:]):
                    # In a run of one symbol every other pair counts.
                    last = None if pair == last and pair[0] == pair[1] else pair
                    if last is not None:
                        held[pair] += n
        if held:
            yield pa.RecordBatch.from_arrays(
                [pa.array([a for a, _ in held], pa.int32()), pa.array([b for _, b in held], pa.int32()), pa.array(held.values(), pa.int64())], ["a", "b", "n"]
            )

    return count


def learn_grammar(sequences: DataFrame, rounds: int = ROUNDS, pairs_a_round: int = PAIRS_A_ROUND) -> Grammar:
    """Re-Pair over (letters, n). A round takes the most frequent pairs that share no symbol, which is what as many single steps would do."""
    grammar = Grammar()
    for _ in range(rounds):
        counted = sequences.select("letters", "n").mapInArrow(_pair_counts(grammar), "a int, b int, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n"))
        found = counted.where("n > 1").orderBy(F.desc("n"), "a", "b").limit(pairs_a_round).collect()
        taken, used = [], set()
        for row in found:
            if not used & {row["a"], row["b"]}:
                taken.append((row["a"], row["b"]))
                used |= {row["a"], row["b"]}
        if not taken:
            break
        grammar.add_round(taken)
    return grammar


def numbered(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, rows_per_block: int) -> DataFrame:
    """The written rows: key (never null), conv, place in the conversation, turn, role, text."""
    space = F.lit(" ")
    rows = turns.select(
        never_null(col(conv_col)).alias("key"), col(conv_col).alias("conv"), F.coalesce(col(turn_col).cast("bigint"), F.lit(-(1 << 63))).alias("order"),
        col(turn_col).alias("turn"), F.coalesce(col(role_col), space).alias("role"), F.coalesce(col(text_col), space).alias("text"),
    )
    longest = longest_run(rows.select("key"), ["key"], 0)
    placed = ranked(rows, ["key"], ["order", "role", "text"], rows_per_block if longest > rows_per_block else 1 << 62, "place")
    return cut_lineage(placed.drop("order"), "repair-rows")


def _faults(rows: DataFrame) -> DataFrame:
    """(key, place, turn, fault, initial): the first fault of each row."""
    stripped = F.rtrim("text", F.lit(SPACES))
    seen = rows.select(
        "key", "conv", "place", "turn", F.substring("role", 1, 1).alias("initial"), F.sha2(F.concat("role", F.lit("\0"), "text").cast("binary"), 256).alias("digest"),
        (F.length(stripped) == 0).alias("blank"), (~F.substring(stripped, -1, 1).isin(".", "!", "?")).alias("open"),
    )
    # The first of equal rows is known by its place, so that a text which a conversation repeats throughout is no hot key of the join.
    first = seen.groupBy("key", "digest").agg(F.min("place").alias("place")).select("key", "place", F.lit(True).alias("first"))
    joined = seen.drop("digest").join(first, ["key", "place"], "left")
    fault = F.when(F.col("blank"), "blank").when(F.col("first").isNull(), "duplicate").when(F.col("open"), "truncated").otherwise("")
    known = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("o")
    return joined.select("key", "conv", "place", "turn", fault.alias("fault"), known.alias("initial"))


def _blocks(faults: DataFrame) -> DataFrame:
    """(key, block, letters, initials) in the order of the rows."""
    letter = F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", F.upper("initial")).otherwise(F.col("initial"))
    rows = faults.groupBy("key", F.floor(F.col("place") / BLOCK).alias("block")).agg(
        F.sort_array(F.collect_list(F.struct("place", letter.alias("letter"), "initial"))).alias("rows"),
    )
    return rows.select("key", "block", F.array_join("rows.letter", "").alias("letters"), F.array_join("rows.initial", "").alias("initials"))


_CELLS = "cells array<array<bigint>>"  # first state, last state, cost, order


def _packed(matrix: Matrix) -> list[list[int]]:
    return [[p, q, c.cost, c.order] for p in STATES for q, c in enumerate(matrix[p]) if c is not None]


def _unpacked(cells: list[list[int]]) -> Matrix:
    matrix: Matrix = [[None] * 4 for _ in STATES]
    for p, q, cost, order in cells:
        matrix[p][q] = Cell(cost, order, "")
    return matrix


def _chain(matrices: list[Matrix]) -> list[Matrix]:
    """Products of the first one, two, ... of the matrices."""
    out = [matrices[0]]
    for m in matrices[1:]:
        out.append(product(out[-1], m))
    return out


def _path(chain: list[Matrix], p: int, q: int) -> list[tuple[int, int]]:
    """The (first, last) states of each factor on the way of the winning cell."""
    ways, state = [], q
    for i in range(len(chain) - 1, 0, -1):
        mid = chain[i][p][state].rope
        ways.append((mid, state))
        state = mid
    return [(p, state), *reversed(ways)]


def _solver(grammar: Grammar) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The matrix of each block."""

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        for batch in batches:
            cells = []
            for letters in batch.column("letters").to_pylist():
                if letters not in held:
                    if len(held) >= HELD_BLOCKS:
                        held.clear()
                    held[letters] = _packed(_chain([grammar.matrices[s] for s in grammar.compressed(letters)])[-1])
                cells.append(held[letters])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.list_(pa.list_(pa.int64())))], [*batch.schema.names, "cells"])

    return solve


def _folder(table: pa.Table) -> pa.Table:
    """One node from the nodes of a group, in their order."""
    rows = sorted(zip(table["node"].to_pylist(), table["cells"].to_pylist()))
    whole = _chain([_unpacked(cells) for _, cells in rows])[-1]
    return pa.table({"key": table["key"][:1], "node": pa.array([rows[0][0] // BLOCK], pa.int64()), "cells": pa.array([_packed(whole)], pa.list_(pa.list_(pa.int64())))})


def _hander(nodes: pa.Table, chosen: pa.Table) -> pa.Table:
    """The states of each node of a group from those of the node above."""
    rows = sorted(zip(nodes["node"].to_pylist(), nodes["cells"].to_pylist()))
    way = _path(_chain([_unpacked(cells) for _, cells in rows]), chosen["first"][0].as_py(), chosen["last"][0].as_py())
    return pa.table({
        "key": pa.array([nodes["key"][0].as_py()] * len(rows), pa.string()), "node": pa.array([n for n, _ in rows], pa.int64()),
        "first": pa.array([a for a, _ in way], pa.int32()), "last": pa.array([b for _, b in way], pa.int32()),
    })


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [closed(_unpacked(cells)) for cells in batch.column("cells").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("key"), batch.column("node"), pa.array([START] * len(found), pa.int32()), pa.array([q for _, q in found], pa.int32()), pa.array([c for c, _ in found], pa.int64())],
            ["key", "node", "first", "last", "cost"],
        )


def _chosen_states(nodes: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """(key, node, first, last) for every block, and (key, cost, last) for every conversation; ``most`` is the largest node number."""
    storeys = [nodes]
    while most > 0:
        above = storeys[-1].groupBy("key", F.floor(F.col("node") / BLOCK).alias("above")).applyInArrow(_folder, "key string, node bigint, " + _CELLS)
        storeys.append(cut_lineage(above, "repair-nodes"))
        most //= BLOCK
    ends = storeys[-1].select("key", "node", "cells").mapInArrow(_ends, "key string, node bigint, first int, last int, cost bigint")
    chosen = ends.select("key", "node", "first", "last")
    for below in reversed(storeys[:-1]):
        group = ["key", F.floor(F.col("node") / BLOCK).alias("above")]
        chosen = below.groupBy(*group).cogroup(chosen.groupBy("key", F.col("node").alias("above"))).applyInArrow(
            _hander, "key string, node bigint, first int, last int"
        )
    return chosen, ends.select("key", "cost", "last")


def _speller(grammar: Grammar) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The audit of each block between its chosen states."""

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, str] = {}
        for batch in batches:
            audits = []
            for job in zip(*(batch.column(c).to_pylist() for c in ("letters", "first", "last"))):
                if job not in held:
                    if len(held) >= HELD_BLOCKS:
                        held.clear()
                    letters, first, last = job
                    symbols = grammar.compressed(letters)
                    way = _path(_chain([grammar.matrices[s] for s in symbols]), first, last)
                    held[job] = "".join(grammar.spelled(s, a, b) for s, (a, b) in zip(symbols, way))
                audits.append(held[job])
            columns = [batch.column(c) for c in ("key", "block", "first")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(audits, pa.string())], ["key", "block", "first", "audit"])

    return spell


@dataclass(frozen=True)
class Repair:
    """``report`` has a row for each conversation; ``rows`` and ``edits`` are what :func:`repaired_turns` is made of."""

    report: DataFrame
    rows: DataFrame
    edits: DataFrame
    grammar: Grammar


def repair(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", rows_per_block: int = ROWS_PER_BLOCK,
) -> Repair:
    """Faults, cost and audit of every conversation: conv, n_rows, gaps, blank, duplicate, truncated, illegal, cost, audit."""
    rows = numbered(turns, conv_col, turn_col, role_col, text_col, rows_per_block)
    faults = cut_lineage(_faults(rows), "repair-faults")
    blocks = cut_lineage(_blocks(faults), "repair-blocks")
    grammar = learn_grammar(cut_lineage(blocks.groupBy("letters").agg(F.count("*").alias("n")), "repair-sequences"))
    solved = blocks.select("key", F.col("block").alias("node"), "letters").mapInArrow(_solver(grammar), "key string, node bigint, letters string, " + _CELLS)
    nodes = cut_lineage(solved, "repair-nodes")
    most = nodes.agg(F.max("node")).first()[0] or 0
    if most == 0:
        chosen, ends = _chosen_states(nodes, 0)
    else:
        # Only conversations of several blocks are folded.
        long = nodes.where("node = 1").select("key")
        single, ends = _chosen_states(nodes.join(long, "key", "left_anti"), 0)
        several, long_ends = _chosen_states(cut_lineage(nodes.join(long, "key", "left_semi"), "repair-nodes"), most)
        chosen, ends = single.unionByName(several), ends.unionByName(long_ends)
    states = nodes.select("key", F.col("node").alias("block"), "letters").join(chosen.withColumnRenamed("node", "block"), ["key", "block"])
    spelled = states.mapInArrow(_speller(grammar), "key string, block bigint, first int, audit string")
    edits = cut_lineage(spelled, "repair-edits")
    ends = cut_lineage(ends, "repair-ends")
    inserted = F.element_at(F.array(*[F.lit(tail(q)) for q in STATES]), F.col("last") + 1)
    audits = edits.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("block", "audit"))).alias("a")).join(ends, "key")
    audits = audits.select("key", "cost", F.concat(F.array_join("a.audit", ""), inserted).alias("audit"))
    is_fault = {f: F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")}
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("bigint")
    counted = faults.groupBy("key").agg(F.first("conv").alias("conv"), F.count("*").alias("n_rows"), gaps.alias("gaps"), *is_fault.values())
    # Pairs within a block, and the pair over its front edge.
    before = F.lag(F.substring("initials", -1, 1)).over(Window.partitionBy("key").orderBy("block"))
    chain = F.concat(F.coalesce(before, F.lit("")), "initials")
    pairs = F.transform(F.sequence(F.lit(1), F.length("chain") - 1), lambda i: F.substr("chain", i, F.lit(2)))
    wrong = F.when(F.length("chain") > 1, F.size(F.filter(pairs, lambda x: ~x.isin("su", "ua", "au")))).otherwise(0)
    illegal = blocks.select("key", chain.alias("chain")).groupBy("key").agg(F.sum(wrong).cast("bigint").alias("illegal"))
    report = counted.join(illegal, "key").join(audits, "key")
    return Repair(report.select("conv", "n_rows", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"), rows, _with_tails(edits, ends), grammar)


def _with_tails(edits: DataFrame, ends: DataFrame) -> DataFrame:
    """Edits by block, and one more row behind the last of a conversation that says what is inserted there."""
    behind = ends.select("key", F.lit((1 << 62) // BLOCK).alias("block"), F.col("last").alias("first"), F.element_at(F.array(*[F.lit(tail(q)) for q in STATES]), F.col("last") + 1).alias("audit"))
    return edits.unionByName(behind.where("audit <> ''"))


_TURN = pa.schema([("key", pa.string()), ("role", pa.string()), ("text", pa.string())])


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order, an edits row in front of each block: out come the repaired turns."""
    edits: list[str] = []
    state, at = START, 0

    def new_turn() -> str:
        nonlocal state
        state = _next(state)
        return "user" if state == USER else "assistant"

    for batch in batches:
        out: list[tuple[str, str, str]] = []
        for key, is_row, role, text, audit, first in zip(*(batch.column(c).to_pylist() for c in ("key", "is_row", "role", "text", "audit", "first"))):
            if not is_row:
                edits, state, at = _cut(audit), first, 0
                if not edits:  # what follows the last row
                    out += [(key, new_turn(), "") for _ in audit]
                continue
            edit = edits[at]
            at += 1
            out += [(key, new_turn(), "") for _ in edit[:-1]]
            if edit[-1] == "R":
                out.append((key, new_turn(), text))
            elif edit[-1] == "K":
                state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[0]]
                out.append((key, role, text))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out)] if out else [pa.array([], pa.string())] * 3, schema=_TURN)


def _cut(audit: str) -> list[str]:
    """An audit by rows: insertions and the row's own letter."""
    out, start = [], 0
    for i, x in enumerate(audit):
        if x != "I":
            out.append(audit[start : i + 1])
            start = i + 1
    return out


def repaired_turns(fixed: Repair) -> DataFrame:
    """(key, role, text) of the repaired conversations. A conversation's turns are in one partition, side by side and in order."""
    rows = fixed.rows.select("key", "place", F.lit(True).alias("is_row"), "role", "text")
    edits = fixed.edits.select("key", (F.col("block") * BLOCK).alias("place"), F.lit(False).alias("is_row"), "audit", "first")
    both = rows.unionByName(edits, allowMissingColumns=True).select("key", "place", "is_row", "role", "text", "audit", "first")
    return both.repartition("key").sortWithinPartitions("key", "place", "is_row").mapInArrow(_apply, "key string, role string, text string")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, chain = None, hashlib.sha256()
    for batch in batches:
        done = []
        for key, role, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if key != now:
                if now is not None:
                    done.append((now, chain.hexdigest()))
                now, chain = key, hashlib.sha256()
            else:
                chain.update(b"\n")
            chain.update(f"{role}:{text}".encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*done)], ["key", "repaired_sha256"])
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([chain.hexdigest()])], ["key", "repaired_sha256"])


def digests(turns: DataFrame) -> DataFrame:
    """(key, repaired_sha256) of turns as :func:`repaired_turns` gives them: ``role:text`` joined by line feeds."""
    return turns.mapInArrow(_digest, "key string, repaired_sha256 string")
