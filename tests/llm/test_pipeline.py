import re
import shutil
import subprocess
import sys
from collections import Counter
from pathlib import Path

import numpy as np

import corpus_pipeline
from wayfold.llm import quality, queries
from wayfold.llm.common import crc_fold

ROOT = Path(corpus_pipeline.__file__).parent


def grams(words):
    return [tuple(words[i : i + 5]) for i in range(len(words) - 4)] if len(words) >= 5 else [tuple(words)] if words else []


def holds(words, item):
    goal, wanted = Counter(grams(item)), set(grams(item))
    if not wanted & set(grams(words)):
        return False
    for s in range(max(1, len(words) - len(item) + 1)):
        own = Counter(grams(words[s : s + len(item)]))
        both = sum((goal & own).values())
        if both and both / (sum(goal.values()) + sum(own.values()) - both) >= 0.75:
            return True
    return False


def split(text):
    return (text or "").encode().lower().split()


def test_stages_against_brute_force(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    train = crc_fold("doc_id", 3) != 1
    ranking = quality.fit(docs, spark.read.parquet(f"{tiny}/labels.parquet").where(train), train)
    rows = [r for r in docs.collect() if ranking.scores(np.array([quality.shares(r.text.encode())]))[0] >= 0.5]
    largest = {}
    for r in rows:
        largest[r.text] = max(r.doc_id, largest.get(r.text, -1))
    rows = [r for r in rows if largest[r.text] == r.doc_id]
    sets = {r.doc_id: set(grams(split(r.text))) for r in rows}
    low = {i: i for i in sets}
    changed = True
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] & sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            m = min(low[a], low[b])
            changed |= (low[a], low[b]) != (m, m)
            low[a] = low[b] = m
    rows = [r for r in rows if low[r.doc_id] == r.doc_id]
    items = [split(r.text) for r in spark.read.parquet(f"{tiny}/benchmark.parquet").collect()]
    rows = [r for r in rows if not any(holds(split(r.text), item) for item in items)]
    assert 0 < len(rows) < docs.count()

    pieces = corpus_pipeline.run(spark, tiny).collect()
    assert {p.doc_id for p in pieces} == {r.doc_id for r in rows}
    for i in {p.doc_id for p in pieces}:
        own = sorted((p for p in pieces if p.doc_id == i), key=lambda p: p.start)
        assert sum(p.length for p in own) == own[0].doc_tokens and own[0].start == 0


def test_stages_keep_the_columns_of_documents(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    assert len(corpus_pipeline.STAGES) == 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, tiny)
        assert out.columns == docs.columns and out.exceptAll(docs).isEmpty()


def test_each_operator_has_one_query():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES) == list(range(1, 14))
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)


def test_the_rest_imports_without_the_text_operators(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", "corpus_pipeline.py", "tests"))
    told = subprocess.run(
        [sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); print(len(q), any(n.startswith('op') for n in q), 'pipeline' in q)"],
        cwd=copy, capture_output=True, text=True, check=True,
    )
    count, operators, pipeline = told.stdout.split()
    assert int(count) > 100 and (operators, pipeline) == ("False", "False")
