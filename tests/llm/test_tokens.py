import sys
import zlib

import numpy as np
import pyarrow as pa
import pytest

from wayfold.llm import packing, token_counts
from wayfold.llm.queries import vocabulary

TRICKY = [
    "It's the DOG'S, they'RE 12 o'clock!! ... ''s", "Ünïcödé ÉÀ ß straße İstanbul ǅ ﬁ", "a<|endoftext|>b <|startoftext|> <|ENDOFTEXT|>", "日本語 текст عربى 🙂👍🏽", "é ́x é",
    "nbsp here  wide", "tab\tline\r\nfeed\x0b\x0c", "\x00\x01 \x7f", "x" * 5000, "+1 (499) 555-6503%%% the&&&", "ªº µ ÷×",
]


def rows_of(odd_rows):
    return odd_rows + [(100 + k, t) for k, t in enumerate(TRICKY)]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
@pytest.mark.parametrize("head", [0, 1 << 17])
def test_counts_equal_the_library(make_docs, odd_rows, name, head):
    path = vocabulary(name)
    loaded = token_counts.tokenizer(path)
    rows = rows_of(odd_rows)
    got = token_counts.token_counts(make_docs(rows), path, head=head).collect()

    def n(text):
        return len(loaded.encode(text or "")) if name.endswith(".model") else len(loaded.encode(text or "", add_special_tokens=False).ids)

    assert sorted(map(str, ((r.doc_id, r.n_bytes, r.n_tokens) for r in got))) == sorted(str((i, len((t or "").encode()), n(t))) for i, t in rows)


def test_pieces_equal_the_library_on_given_texts(spark, tiny):
    path = vocabulary()
    texts = [r.text for r in spark.read.parquet(f"{tiny}/documents.parquet").select("text").collect()]
    units = sorted({u for t in texts for u in t.encode().split()} | {u for t in TRICKY for u in t.encode().split()})
    loaded = token_counts.tokenizer(path)
    want = [e.ids for e in loaded.encode_batch([u.decode() for u in units], add_special_tokens=False)]
    assert token_counts.Pieces(path).encode(units) == want


def unpacked(rows, texts, path):
    """Checks that the pieces of packed rows are the documents' ids, each once, and the sequences are gapless."""
    loaded = token_counts.tokenizer(path)
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append(r)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at and r.length == len(r.ids) > 0 and r.sequence_tokens == sum(x.length for x in own)
            assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
            at += r.length
        assert at <= packing.CAPACITY
    pieces = {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
    for i, text in texts:
        own = sorted(pieces[i], key=lambda r: r.start)
        assert [x for r in own for x in r.ids] == [*loaded.encode(text or "", add_special_tokens=False).ids, 2]
        assert [r.start for r in own] == list(np.cumsum([0, *(r.length for r in own)])[:-1])
        assert {r.doc_tokens for r in own} == {sum(r.length for r in own)}
    return sequences


@pytest.mark.parametrize("max_open", [3, packing.MAX_OPEN])
def test_packing_round_trip(make_docs, odd_rows, max_open):
    path = vocabulary()
    texts = {i: t for i, t in rows_of(odd_rows) if i is not None}
    docs = make_docs(list(texts.items()))
    sequences = unpacked(packing.pack(docs, path, max_open=max_open).collect(), texts.items(), path)
    for own in sequences.values():
        n = own[0].sequence_tokens
        assert n == packing.CAPACITY or n & (n - 1) == 0
    assert packing.pack(make_docs([]), path).collect() == []
    repeated = packing.pack(make_docs([(1, "a b"), (1, "a b"), (None, "c")]), path).collect()
    assert sum(r.length for r in repeated) == 3 + 3 + 2


def test_packing_of_given_documents(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    path = vocabulary()
    sequences = unpacked(packing.pack(docs, path).collect(), [(r.doc_id, r.text) for r in docs.collect()], path)
    whole = sum(len(s) for s in sequences.values())
    assert whole < 2 * docs.count()


def test_level_search_equals_brute_force():
    rng = np.random.default_rng(0)
    packer = packing.SumOfSquares(64)
    for k in range(3000):
        size = int(rng.integers(1, 64))
        n = packer.levels.copy()

        def squares(level, n=n, size=size):
            m = n.copy()
            if level:
                m[level] -= 1
            if level + size < 64:
                m[level + size] += 1
            return int((m[1:64] ** 2).sum())

        choices = [h for h in range(0, 64 - size + 1) if h == 0 or n[h]]
        best = min(squares(h) for h in choices)
        got = packer.level_for(size)
        assert got in choices and squares(got) == best and got == max(h for h in choices if squares(h) == best)
        packer.place((k, 0, np.zeros(size, np.int32), size))


def test_known_units_are_not_made_one_by_one():
    """Units that are held go from Arrow to their ids in whole columns; white space at the ends, nulls and empty texts too."""
    texts = pa.array([" ".join(f"w{k}x{j}" for j in range(300)) for k in range(10)] + [None, "", " \n", "  a\tb ", "É\x0b\x1fA"], pa.string())
    encoder, loaded, calls = packing.UnitIds(vocabulary()), token_counts.tokenizer(vocabulary()), []
    first = [ids.tolist() for ids in encoder.ids(texts)]
    sys.setprofile(lambda frame, event, arg: calls.append(event == "c_call" and arg.__name__ == "encode"))
    try:
        again = [ids.tolist() for ids in encoder.ids(texts)]
    finally:
        sys.setprofile(None)
    assert first == again == [loaded.encode(t or "", add_special_tokens=False).ids for t in texts.to_pylist()]
    assert sum(calls) < 300
