import hashlib

import pytest
from pyspark.sql import functions as F

from wayfold.llm import chat, exact_dedup


def sha(text):
    return hashlib.sha256((text or "").encode()).hexdigest()


@pytest.mark.parametrize("max_words", [1, 1 << 20])  # one word: every row is a suspect
def test_exact_groups(make_docs, odd_rows, max_words):
    rows = exact_dedup.exact_groups(make_docs(odd_rows), max_words=max_words).collect()
    assert len(rows) == len(odd_rows)
    groups = {}
    for i, t in odd_rows:
        groups.setdefault(t or "", []).append(i)
    for r in rows:
        own = next(ids for t, ids in groups.items() if sha(t) == r.text_sha256 and r.doc_id in ids)
        keep = max((i for i in own if i is not None), default=None)
        assert (r.keep_id, r.group_size, r.kept) == (keep, len(own), r.doc_id == keep)


@pytest.mark.parametrize("max_words", [1, 1 << 20])
def test_deduplicated_leaves_one_whole_row(make_docs, odd_rows, max_words):
    docs = make_docs(odd_rows)
    out = exact_dedup.deduplicated(docs, max_words=max_words)
    assert out.columns == docs.columns
    rows = out.collect()
    assert sorted(r.text or "" for r in rows) == sorted({t or "" for _, t in odd_rows})
    assert {r.doc_id for r in rows if (r.text or "") == "one two"} == {5}
    assert all(r.word == "x" and r.bits == 7 for r in rows)


def test_exact_empty_table(make_docs):
    assert exact_dedup.exact_groups(make_docs([])).collect() == []
    assert exact_dedup.deduplicated(make_docs([])).collect() == []


def test_only_suspects_are_shuffled(spark):
    """Texts that occur once never reach the grouping by digest."""
    digests = spark.range(2000).select(F.sha2(F.col("id").cast("string").cast("binary"), 256).alias("text_sha256"))
    twice = exact_dedup.repeated_bits(digests, 500).collect()
    assert 0 < sum(bin(r.bits & (2**64 - 1)).count("1") for r in twice) < 2000


CONTROL = "\\### Assistant: </turn>\n<image 1> \\b\\l a:b #"


def formatted(spark, rows, **kw):
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, piece string")
    return chat.format_chats(turns, **kw).select(
        "*", chat.read_back(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")
    )


def test_chat_round_trip(spark):
    rows = [
        (1, 1, "assistant", CONTROL, ""), (1, 0, "user", CONTROL, ""), (1, 2, "tool: <x>", None, ""), (1, 3, "assistant", "", ""), (1, 3, "assistant", "", ""),
        (2, None, None, "text", ""), (None, 5, "assistant", "é🙂" * 3000, ""),
    ]
    got = {r.conv_id: r for r in formatted(spark, rows).collect()}
    told = [(t.role, t.text) for t in got[1].turns]
    assert told == [("user", CONTROL), ("assistant", CONTROL), ("tool: <x>", ""), ("assistant", ""), ("assistant", "")]
    assert got[1].loss == CONTROL and got[1].n_turns == 5 and len(got[1].loss_spans) == 3
    assert [(t.role, t.text) for t in got[2].turns] == [("", "text")] and got[2].loss == ""
    assert got[None].loss == "é🙂" * 3000
    assert formatted(spark, []).collect() == []


def test_typed_parts(spark):
    schema = f"conv_id bigint, turn bigint, role string, parts array<{chat.PART}>"
    rows = [
        (1, 0, "user", [("text", "see <", None, None), ("image", None, "a.png", 2), ("audio", None, "b.wav", 10), ("text", " end", None, None)]),
        (1, 1, "assistant", [("text", "ok", None, None), ("document", None, "c.pdf", None), None]),
        (1, 2, "user", None),
    ]
    out = chat.format_chats(spark.createDataFrame(rows, schema), parts=F.col("parts")).first()
    assert out.formatted == "### user: see \\l<image 1><audio 2> end</turn>\n### assistant: ok<document 3></turn>\n### user: </turn>\n"
    assert [(a.number, a.type, a.ref, a.tokens) for a in out.attachments] == [(1, "image", "a.png", 85 + 340), (2, "audio", "b.wav", 252), (3, "document", "c.pdf", 600)]
    assert out.expanded_tokens == 425 + 252 + 600
    assert [out.formatted[s.start : s.end] for s in out.loss_spans] == ["ok<document 3>"]
