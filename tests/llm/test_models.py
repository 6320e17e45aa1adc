"""Learned operators: held-out accuracy on the given tables, exact properties on small cases."""

import itertools
import math
import os
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from wayfold.llm import language, lm_score, quality, queries, toxicity
from wayfold.llm.common import crc_fold
from wayfold.session import FREE_SETTING, cut_lineage, shared_folder, shuffles_freed

GIVEN = "/root/testdata/sf0.01"
# Toxic words of the rarer languages need more labels than the small tables have.
MORE = "/root/testdata/sf0.1"


def labelled(spark, folder, name):
    return {r.doc_id: r[name] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}


def test_fold_is_the_crc_of_the_text_form(spark):
    got = {r.id: r.f for r in spark.range(500).select("id", crc_fold("id", 3).alias("f")).collect()}
    assert got == {k: zlib.crc32(str(k).encode()) % 3 for k in range(500)}


@pytest.mark.parametrize("name,label,folder", [("op1_quality_classifier", "quality", GIVEN), ("op8_toxicity", "toxic", MORE)])
def test_held_out_accuracy(spark, name, label, folder):
    truth = labelled(spark, folder, label)
    rows = queries.QUERIES[name](spark, folder).collect()
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    assert len(held) > 50 and np.mean([p == t for p, t in held]) >= 0.95
    positive = [p for p, t in held if t == 1]
    assert np.mean(positive) >= 0.85



@pytest.mark.parametrize("held", [0, 3, 1 << 17])
def test_lm_scores_keep_every_word(spark, make_docs, held):
    """More words than any cap so far; rare ones decide, next to the same frequent ones in all documents."""
    rng = np.random.default_rng(3)
    rows = [(k, " ".join(f"c{j % 5} w{k % 30 * 1000 + j}" for j in rng.integers(0, 1000, 600))) for k in range(60)]
    docs = make_docs(rows)
    target = spark.createDataFrame([(k,) for k in range(15)], "doc_id bigint")
    spot = F.pmod(F.xxhash64(F.lit("background"), "doc_id"), F.lit(1_000_000))
    background = [r.doc_id for r in docs.where(spot < 250_000).collect()]
    want = plain_scores(rows, range(15), 1, background)
    assert len({w for _, t in rows for w in t.split()}) > 1 << 14
    got = {r.doc_id: r.score for r in lm_score.lm_scores(docs, target, held=held, head=1000).collect()}
    assert set(got) == set(want) and all(abs(got[i] - s) < 1e-5 for i, s in want.items())


def test_pair_codes_are_the_same_in_both_places(spark):
    rng = np.random.default_rng(4)
    v, w = (np.where(rng.random(500) < 0.5, rng.integers(0, 1 << 17, 500), rng.integers(1 << 62, (1 << 63) - 1, 500)) for _ in range(2))
    rows = spark.createDataFrame([(int(a), int(b)) for a, b in zip(v, w, strict=True)], "v bigint, w bigint")
    got = rows.select("v", "w", lm_score.pair_code("v", "w").alias("code")).collect()
    assert [r.code for r in got] == lm_score.pair_codes(v, w).tolist() and len({(r.v, r.w) for r in got}) == len({r.code for r in got})


def test_language_held_out(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{GIVEN}/documents.parquet").select("doc_id", "lang").collect()}
    rows = queries.op4_language_id(spark, GIVEN).collect()
    held = [r.lang_pred == truth[r.doc_id] for r in rows if r.held_out]
    assert np.mean(held) > 0.98
    assert np.mean([r.rejected for r in rows if r.held_out]) < 0.05


def test_odd_texts_get_rows(spark, make_docs, odd_rows):
    docs = make_docs([(*r, "en" if k % 2 else None) for k, r in enumerate(odd_rows)])
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 1), (4, 0, 1), (6, None, None), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    every = F.lit(True)
    n = len(odd_rows)
    assert quality.score(docs, quality.fit(docs, labels, every)).count() == n
    found = toxicity.score(docs, toxicity.fit(docs, labels, every)).collect()
    assert len(found) == n and all(0 <= r.score <= 1 for r in found)
    models = language.fit(docs, every)
    found = language.identify(docs, models).collect()
    assert len(found) == n
    assert {r.lang_pred for r in found if r.doc_id in (1, 2, 3)} == {"und"} and all(r.score == 0 and r.rejected for r in found if r.doc_id in (1, 2, 3))
    scored = lm_score.lm_scores(docs, labels.where("quality = 1")).collect()
    assert len(scored) == n and all(r.score == 0 for r in scored if r.doc_id in (1, 2, 3))
    nothing = make_docs([])
    none = labels.limit(0)
    assert quality.score(nothing, quality.fit(nothing, none, every)).collect() == []
    assert toxicity.score(nothing, toxicity.fit(nothing, none, every)).collect() == []
    assert language.identify(nothing, language.fit(nothing, every)).collect() == []
    assert lm_score.lm_scores(nothing, none).collect() == []
    kept = quality.accepted(docs, quality.fit(docs, none, every))
    assert kept.columns == docs.columns and kept.count() == n  # without labels every score is 0.5


def test_bradley_terry_finds_the_order():
    rng = np.random.default_rng(1)
    x = rng.random((600, len(quality.FEATURES) + 2))
    labels = (x[:, 0] - x[:, 3] + 0.05 * rng.standard_normal(600) > 0).astype(int)
    ranking = quality.train(x, labels)
    assert np.mean((ranking.scores(x) >= 0.5) == labels) > 0.95
    a, b = quality.pair_numbers(7, 3, 4)
    assert len(a) == 28 and set(np.bincount(a)) == {4} and b.max() < 3


def test_field_marginals_equal_enumeration():
    crf = toxicity.Crf()
    crf.joint = np.array([[0.0, -0.7], [0.4, 1.1]])
    e = np.array([0.3, -1.2, 2.0, -0.1, 0.6])
    weight = {}
    for y in itertools.product((0, 1), repeat=len(e)):
        weight[y] = math.exp(sum(e[k] * y[k] for k in range(len(e))) + sum(crf.joint[a, b] for a, b in itertools.pairwise(y)))
    z = sum(weight.values())
    want = [sum(w for y, w in weight.items() if y[k]) / z for k in range(len(e))]
    assert np.allclose(crf.marginals(e), want)
    pairs = np.zeros((2, 2))
    for y, w in weight.items():
        for a, b in itertools.pairwise(y):
            pairs[a, b] += w / z
    assert np.allclose(crf.pair_marginals(e), pairs)


def test_toxic_spans_have_their_offsets():
    rng = np.random.default_rng(4)
    words = [f"w{k}" for k in range(60)]
    texts, toxic = [], []
    for k in range(300):
        own = [words[j] for j in rng.integers(0, 60, 20)]
        if k % 3 == 0:
            for j in rng.choice(20, 2, replace=False):
                own[j] = "nasty" + "abcdefgh"[rng.integers(0, 8)]
        texts.append(" ".join(own))
        toxic.append(int(k % 3 == 0))
    tagger = toxicity.Tagger(toxicity.train(texts, toxic))
    text = "é w1 w2 “Nastyz!” w3\tnastya nastyb w4"
    score, spans = tagger.tag(text)
    assert score > 0.7 and [text[a:b] for a, b, _ in spans] == ["“Nastyz!”", "nastya nastyb"]
    assert tagger.score(text) == score
    assert tagger.score("w1 w2 w3") < 0.3 and tagger.tag(None)[1] == []


def test_kneser_ney_sums_to_one_and_equals_the_tables():
    texts = {"a": "abracadabra aber ab", "b": "otto toto tom"}
    counts = {}
    for lang, t in texts.items():
        letters = "\0" * (language.ORDER - 1) + language.code_points(t).tobytes().decode("utf-32-le")
        counts[lang] = Counter(letters[k : k + language.ORDER] for k in range(len(letters) - language.ORDER + 1))
    models = language.LanguageModels(counts)
    alphabet = sorted({c for g in counts.values() for x in g for c in x})
    for lang in texts:
        kn = language.KneserNey(counts[lang], models.alphabet)
        for context in ("\0\0\0", "\0ab", "abr", "zzz"):
            total = sum(kn.p(context + c) for c in alphabet) + kn.p(context + "?")
            assert abs(total - 1) < 1e-9
    probe = ["abracadabra ab", "tomato zebra", "q"]
    got = models.cross_entropies([language.code_points(t) for t in probe])
    for row, t in zip(got, probe, strict=True):
        letters = "\0" * (language.ORDER - 1) + language.code_points(t).tobytes().decode("utf-32-le")
        for k, lang in enumerate(models.names):
            kn = language.KneserNey(counts[lang], models.alphabet)
            grams = [letters[i : i + language.ORDER] for i in range(len(letters) - language.ORDER + 1)]
            assert abs(-np.mean([math.log(kn.p(g)) for g in grams]) - row[k]) < 1e-4


def plain_scores(rows, target, vocabulary, background):
    """The definition of the score, counted in plain Python."""
    words = {i: (t or "").encode().lower().split() for i, t in rows}
    counts = Counter(w for ws in words.values() for w in ws)
    kept = {w for w, n in counts.items() if n >= vocabulary}
    coded = {i: [None, *(w if w in kept else b"?" for w in ws)] for i, ws in words.items()}
    size = len(kept) + 2

    def model(ids):
        pairs = Counter(p for i in ids for p in itertools.pairwise(coded[i]))
        before, kinds, own = Counter(), Counter(), Counter()
        for (v, w), n in pairs.items():
            before[v] += n
            kinds[v] += 1
            own[w] += n
        total = sum(own.values())

        def p(v, w):
            unigram = (own[w] + 1) / (total + size)
            if not before[v]:
                return unigram
            return max(pairs[v, w] - 0.75, 0) / before[v] + 0.75 * kinds[v] / before[v] * unigram

        return p

    t, b = model(target), model(background)
    return {i: np.mean([math.log(t(v, w)) - math.log(b(v, w)) for v, w in itertools.pairwise(ws)]) if len(ws) > 1 else 0.0 for i, ws in coded.items()}


@pytest.mark.parametrize("head", [0, 3, 1 << 20])
def test_lm_scores_equal_the_definition(spark, make_docs, head):
    rng = np.random.default_rng(2)
    rows = [(k, " ".join(f"{'t' if k < 12 else 'g'}{j}" if rng.random() < 0.6 else f"c{j}" for j in rng.integers(0, 9, 30))) for k in range(40)] + [(40, None), (41, "new")]
    docs = make_docs(rows)
    target = spark.createDataFrame([(k,) for k in range(10)], "doc_id bigint")
    part = int(10 / 42 * 1_000_000)
    spot = F.pmod(F.xxhash64(F.lit("background"), "doc_id"), F.lit(1_000_000))
    background = [r.doc_id for r in docs.where(spot < part).collect()]
    want = plain_scores(rows, range(10), 1, background)
    got = {r.doc_id: r for r in lm_score.lm_scores(docs, target, head=head).collect()}
    assert set(got) == set(want)
    assert all(abs(got[i].score - s) < 1e-5 for i, s in want.items())
    assert np.mean([got[i].score for i in range(10, 12)]) > np.mean([got[i].score for i in range(12, 40)])


def test_lm_scores_do_not_depend_on_parts(spark, make_docs, odd_rows, monkeypatch):
    """Units joined in one part or in many, over several slices: the same rows, ids twice and null ones too."""
    docs = make_docs([*odd_rows, *[(100 + k, " ".join(f"w{j * k % 50}" for j in range(40))) for k in range(20)]])
    target = spark.createDataFrame([(k,) for k in (4, 6, 101, 103, 110)], "doc_id bigint")

    def found():
        rows = lm_score.lm_scores(docs, target, held=3, head=4).collect()
        return sorted(((r.doc_id is None, r.doc_id or 0, r.n_words, r.score) for r in rows))

    one = found()
    monkeypatch.setattr(lm_score, "PART_WORDS", 1_000)
    many = found()
    assert len(one) == docs.count() and [r[:3] for r in one] == [r[:3] for r in many]
    assert np.allclose([r[3] for r in one], [r[3] for r in many], atol=1e-9)


def test_units_leave_tasks_in_few_rows(spark, make_docs):
    """Not a row for each document and unit: a row for each slice and part, besides the documents' own."""
    docs = make_docs([(k, " ".join(f"w{k}x{j}" for j in range(500))) for k in range(40)])
    target = spark.createDataFrame([(k,) for k in range(10)], "doc_id bigint")
    plan = lm_score.lm_scores(docs, target, held=3, head=4)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "LeftOuter" not in plan


def test_answers_leave_parts_by_slices(spark, make_docs):
    """What a part adds comes back as a row for each slice, not for each document; tables of words and pairs are gone when scores are read."""
    known = set(os.listdir(shared_folder(spark).removeprefix("file:")))
    docs = make_docs([(k, " ".join(f"w{(k + j) % 90}" for j in range(50))) for k in range(40)])
    scores = lm_score.lm_scores(docs, spark.createDataFrame([(k,) for k in range(10)], "doc_id bigint"), held=3, head=4)
    plan = scores._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapGroupsInArrow") == 2 and "Aggregate [row" not in plan
    left = {n.split("-")[0] for n in set(os.listdir(shared_folder(spark).removeprefix("file:"))) - known}
    assert not left & {"words", "pairs"} and scores.count() == 40


@pytest.mark.parametrize("held", [0, 2, 1 << 17])
def test_words_are_cut_as_bytes_are(held):
    """At ASCII white space only, A-Z in lower case; blank and null texts have no words."""
    texts = ["  One\ttwo ", None, "", " \n", "\x0bÀÉ\xa0x\x1fone one\r\n", "TWO"]
    words = [(t or "").encode().lower().split() for t in texts]
    counts = sorted({w for own in words for w in own})
    known = {w: k for k, w in enumerate(counts[:held], lm_score.FIRST_WORD)}
    codes, sizes = lm_score.word_codes(pa.array(texts, pa.string()), known)
    assert sizes.tolist() == [len(own) for own in words]
    assert codes.tolist() == [known.get(w) or lm_score.HASHED | xxhash.xxh3_64_intdigest(w) >> 2 for own in words for w in own]


@pytest.mark.parametrize("most", [2, 40, 1 << 20])
def test_words_are_counted_by_slices(spark, make_docs, odd_rows, monkeypatch, most):
    """Held until there are too many, merged where they repeat: the same counts, none of an empty word."""
    monkeypatch.setattr(lm_score, "HELD_COUNTS", most)
    rows = [*odd_rows, *[(100 + k, " \t" + "  ".join(f"W{j * k % 50}" for j in range(40)) + "\n") for k in range(20)]]
    want = Counter(w for _, t in rows for w in (t or "").encode().lower().split())
    got = lm_score.word_counts(make_docs(rows), "text").collect()
    assert len(got) == len(want) and {bytes(r.unit): r.n for r in got} == want


def test_pairs_are_coded_once_a_slice(monkeypatch):
    """Not for each place they stand at: words are numbered in a slice, and its distinct pairs are what is coded."""
    coded, plain = [], lm_score.pair_codes
    monkeypatch.setattr(lm_score, "pair_codes", lambda v, w: coded.append(len(v)) or plain(v, w))
    texts = pa.array(["a b " * 500, None, "b a " * 500, " ", "c"], pa.string())
    tables = np.zeros(2), np.zeros(2), np.zeros(0, np.int64), np.zeros(0, np.float32)
    sizes, sums, unit, whose, times = lm_score.slice_units(texts, {b"a": 1}, tables, 0.5)
    assert sum(coded) == 5 and sizes.tolist() == [1000, 0, 1000, 0, 1] and sums.tolist() == [500, 0, 500, 0, 0.5]
    b, c = (lm_score.HASHED | xxhash.xxh3_64_intdigest(x) >> 2 for x in (b"b", b"c"))
    pairs = [(0, 1, 0, 1), (1, b, 0, 500), (b, 1, 0, 499), (0, b, 2, 1), (b, 1, 2, 500), (1, b, 2, 499), (0, c, 4, 1)]
    want = [(int(plain(np.array([v]), np.array([w]))[0]), k, n) for v, w, k, n in pairs]
    want += [(b, 0, 500), (b, 2, 500), (c, 4, 1), (b, 0, lm_score.LAST), (c, 4, lm_score.LAST)]
    assert sorted(zip(unit.tolist(), whose.tolist(), times.tolist())) == sorted(want)


@pytest.mark.parametrize("kind", [np.int64, np.int32, np.float32])
def test_planes_come_back(kind):
    for size in (0, 1, 1000):
        numbers = np.sort(np.random.default_rng(size).integers(-(1 << 30), 1 << 30, size)).astype(kind)
        blob = lm_score.to_planes(numbers) if size else b""
        assert np.array_equal(lm_score.from_planes(pa.scalar(blob, pa.binary()), kind), numbers)


def test_shuffles_are_freed_when_done(spark):
    """Inside, a finished write leaves no shuffle files; the setting is as before afterwards."""
    def files():
        listed = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {listed.apply(i).getName() for i in range(listed.size()) if listed.apply(i).getName().startswith("shuffle_")}

    before, known = spark.conf.get(FREE_SETTING), files()
    with shuffles_freed(spark):
        made = cut_lineage(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "freed")
        assert made.count() == 7
    assert spark.conf.get(FREE_SETTING) == before and files() <= known
