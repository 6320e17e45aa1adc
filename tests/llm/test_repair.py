import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from wayfold.llm import repair

TALKS = "conv_id bigint, turn bigint, role string, text string, key string, audit int"
FORM = re.compile(r"(s?(ua)+)?")


def faults(rows):
    """rows: (turn, role, text) in order -> the fault of each."""
    seen, out = set(), []
    for _, role, text in rows:
        stripped = text.rstrip(" \t\n\x0b\x0c\r")
        out.append("blank" if not stripped else "duplicate" if (role, text) in seen else "" if stripped[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def brute(rows):
    """Cost, audit and digest by a plain forward search over states that keeps the best whole history of each."""
    after = {"": "u", "s": "u", "u": "a", "a": "u"}
    name = {"u": "user", "a": "assistant"}

    def with_inserts(state, cost, audit, out):
        for k in range(3):
            yield state, cost + 3 * k, audit + "I" * k, out
            state = after[state]
            out = out + [(name[state], "")]

    best = {"": (0, "", [])}
    for (_, role, text), fault in zip(rows, faults(rows)):
        new = {}
        for state, history in best.items():
            for s, c, e, o in with_inserts(state, *history):
                offers = [(s, c + 4, e + "D", o)]
                if fault not in ("blank", "duplicate"):
                    more = 3 * (fault == "truncated")
                    offers.append((after[s], c + 3 + more, e + "R", o + [(name[after[s]], text)]))
                    own = role[:1]
                    if own == after[s] or own == "s" and s == "":
                        offers.append((own, c + more, e + "K", o + [(role, text)]))
                for q, *history in offers:
                    new[q] = min(new.get(q, (1 << 60,)), tuple(history))
        best = new
    ends = [(c, e, o) for s, h in best.items() for t, c, e, o in with_inserts(s, *h) if t in ("", "a")]
    cost, audit, out = min(ends)
    assert FORM.fullmatch("".join(r[:1] for r, _ in out))
    return cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()


def wanted(rows):
    talks = {}
    for conv, turn, role, text in rows:
        talks.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    out = {}
    for conv, own in talks.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        kinds, turns = faults(own), [t for t, *_ in own if t is not None]
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(own, own[1:])]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs), *brute(own))
    return out


def got(spark, rows, **kw):
    fixed = repair.repair(spark.createDataFrame([(*r, "k", 0) for r in rows], TALKS).repartition(3), **kw)
    found = fixed.report.withColumn("key", repair.never_null(F.col("conv"))).join(repair.digests(repair.repaired_turns(fixed)), "key", "left").collect()
    nothing = hashlib.sha256(b"").hexdigest()
    return {r.conv: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256 or nothing) for r in found}


def drawn(rng, conv, n):
    texts = ["One.", "Two!", "Why?", "cut off", "", " \n", "Ünï 🙂.", "end.\t "]
    return [
        (conv, rng.choice([None, *range(n + 2)]), rng.choice(["system", "user", "assistant", "user", "assistant", "tool", None]), rng.choice(texts) + rng.choice(["", str(rng.random()) + "."]))
        for _ in range(n)
    ]


@pytest.mark.parametrize("rows_per_block", [40, repair.ROWS_PER_BLOCK])
def test_equals_brute_force(spark, rows_per_block):
    rng = random.Random(rows_per_block)
    rows = [r for conv in [None, *range(60)] for r in drawn(rng, conv, rng.randrange(1, 12))]
    rows += [(100, t, "user" if t % 2 == 0 else "assistant", f"Text {t}.") for t in range(6)]  # nothing to mend
    rows += [(101, 0, "system", "Alone."), (102, 0, None, None), (103, None, "user", "x" * 100_000)]
    rows += [(104, i, rng.choice(["user", "assistant", "tool"]), rng.choice(["A.", f"{i}.", f"{i}"])) for i in range(700)]  # three blocks
    assert got(spark, rows, rows_per_block=rows_per_block) == wanted(rows)


def test_two_storeys_of_blocks(spark):
    """A conversation of more than 256 * 256 rows, all rightly formed but for the roles swapped in the last two."""
    n = repair.BLOCK**2 + 4
    role = F.when(F.col("turn") % 2 == 0, "user").otherwise("assistant")
    talks = spark.range(n).select(F.lit(5).cast("bigint").alias("conv_id"), F.col("id").alias("turn")).withColumn("role", role)
    talks = talks.withColumn("text", F.concat(F.col("turn").cast("string"), F.lit("."))).withColumn("role", F.when(F.col("turn") == n - 1, "user").otherwise(F.col("role")))
    fixed = repair.repair(talks)
    r = fixed.report.first()
    assert (r.n_rows, r.illegal, r.cost, r.audit) == (n, 1, 3, "K" * (n - 1) + "R")
    assert repair.repaired_turns(fixed).count() == n


def test_empty_table(spark):
    assert got(spark, []) == {}


def test_grammar_gives_the_matrices_of_plain_products():
    rng = random.Random(3)
    grammar = repair.Grammar()
    grammar.add_round([(1, 2), (0, 8)])
    grammar.add_round([(9, 9), (5, 6)])
    for _ in range(50):
        letters = "".join(rng.choice("suauauauASUox") for _ in range(rng.randrange(1, 30)))
        plain = repair._chain([repair.letter_matrix(x) for x in letters])[-1]
        symbols = grammar.compressed(letters)
        packed = repair._chain([grammar.matrices[s] for s in symbols])
        assert repair._packed(plain) == repair._packed(packed[-1])
        for p in range(4):
            cells = [(c.order, q) for q, c in enumerate(packed[-1][p]) if c is not None]
            audits = ["".join(grammar.spelled(s, a, b) for s, (a, b) in zip(symbols, repair._path(packed, p, q))) for _, q in sorted(cells)]
            assert audits == sorted(audits)


def test_rules_come_from_the_most_frequent_pairs(spark):
    sequences = spark.createDataFrame([("uauaua", 10), ("suaua", 5), ("xx", 1)], "letters string, n bigint")
    grammar = repair.learn_grammar(sequences)
    assert grammar.pairs[0] == (1, 2)
    assert len(grammar.compressed("uauaua")) < 3
