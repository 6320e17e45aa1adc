import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from wayfold.llm import merkle
from wayfold.llm.common import crc_fold


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def written(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def climb(nodes):
    """The root over (digest, name) nodes, and for each name its runs' siblings on the way up."""
    paths = {name: [] for _, names in nodes for name in names}
    while len(nodes) > 1:
        runs = [nodes[i : i + 8] for i in range(0, len(nodes), 8)]
        for run in runs:
            for k, (_, names) in enumerate(run):
                for name in names:
                    paths[name].append(("".join(d for d, _ in run[:k]), "".join(d for d, _ in run[k + 1 :])))
        nodes = [(sha("".join(d for d, _ in run)), [n for _, names in run for n in names]) for run in runs]
    return nodes[0][0], paths


def brute(rows):
    """rows: (doc_id, text, lang, source, n_chars) -> sorted result rows."""
    digest = lambda r, text: sha("".join(map(written, (r[0], r[3], r[2], r[4], text))))
    langs = {}
    for place, r in enumerate(rows):
        langs.setdefault(r[2], []).append((-(1 << 63) if r[0] is None else r[0], digest(r, r[1]), place))
    tops, inner = [], {}
    for lang in sorted(langs, key=lambda x: (x is not None, (x or "").encode())):
        leaves = sorted(langs[lang])
        root, paths = climb([(h, [place]) for _, h, place in leaves])
        inner |= {place: (root, path) for place, path in paths.items()}
        tops.append((root, [place for *_, place in leaves]))
    root, over = climb(tops)
    out = []
    for place, r in enumerate(rows):
        subroot, path = inner[place]
        path = path + over[place]
        leaf = digest(r, r[1])
        changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[1] is not None
        x = digest(r, "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1])) if changed else leaf
        for before, after in path:
            x = sha(before + x + after)
        out.append((r[0], leaf, subroot, root, sha("".join(b + a for b, a in path)), x, x == root))
    return sorted(out, key=str)


def result(docs, **kw):
    rows = merkle.documents_manifest(docs, crc_fold("doc_id", 3) == 0, **kw).collect()
    return sorted((tuple(r) for r in rows), key=str)


@pytest.mark.parametrize("rows_per_block", [3, merkle.ROWS_PER_BLOCK])
def test_odd_rows(make_docs, odd_rows, rows_per_block):
    rows = [(i, t, lang) for lang, odd in ((None, odd_rows), ("en", odd_rows[:9]), ("é", [(9, "Ab")]), ("", [(10, "AB c")])) for i, t in odd]
    docs = make_docs(rows)
    assert result(docs, rows_per_block=rows_per_block) == brute([(i, t, lang, "s", 0) for i, t, lang in rows])


@pytest.mark.parametrize("count", [1, 8, 9, 64, 65])
def test_one_group(make_docs, count):
    rows = [(i, f"Text {i}", "en") for i in range(count)]
    got = result(make_docs(rows))
    assert got == brute([(i, t, lang, "s", 0) for i, t, lang in rows])
    assert {r[2] for r in got} == {r[3] for r in got}  # one language: its root is the root
    if count == 1:
        assert got[0][4] == sha("")


def test_several_storeys_and_many_groups(spark):
    """A group of more than one block, and more groups than a run has."""
    rows = [(i, f"Row {i}", "hot" if i < 4_200 else f"l{i % 70}", "s", i) for i in range(4_400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3)
    assert result(docs, rows_per_block=500) == brute(rows)


def test_empty_table_and_general_form(make_docs):
    assert result(make_docs([])) == []
    docs = make_docs([(i, f"t{i}", "x") for i in range(20)])
    found = merkle.manifest(docs, merkle.leaf_digest(F.col("text")), group_col="lang")
    rows = found.withColumn("top", merkle.folded(F.col("leaf"), F.col("path"))).collect()
    assert sorted(r["rank"] for r in rows) == list(range(20)) and all(r.top == r.root for r in rows)
    assert all(r.leaf == sha(f"{len(f't{r.id}')}:t{r.id}") for r in rows)


def test_no_join(make_docs):
    plan = merkle.documents_manifest(make_docs([(1, "a", "x")]), F.lit(False))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Python" not in plan
