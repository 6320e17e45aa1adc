import random
from itertools import combinations

import numpy as np

from wayfold.llm import near_dedup
from wayfold.llm.components import components


def plain_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    """Smallest id that each id reaches over links; rows with equal ids are one node."""
    sets = {}
    for i, t in rows:
        if i is not None and plain_set(t):
            sets.setdefault(i, []).append(plain_set(t))
    low = {i: i for i in sets}

    def root(i):
        while low[i] != i:
            i = low[i]
        return i

    for a, b in combinations(sets, 2):
        if any(100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b]):
            u, v = sorted((root(a), root(b)))
            low[v] = u
    return {i: root(i) for i in sets}


def check(make_docs, rows):
    found = near_dedup.near_groups(make_docs(rows)).collect()
    assert len(found) == len(rows)
    want = brute(rows)
    assert sorted((str(r.doc_id), r.n_shingles) for r in found) == sorted((str(i), len(plain_set(t))) for i, t in rows)
    for r in found:
        if r.doc_id in want and r.n_shingles:
            assert (r.component_id, r.kept) == (want[r.doc_id], want[r.doc_id] == r.doc_id)
        elif r.n_shingles == 0:
            assert r.component_id == r.doc_id and r.kept


def test_odd_rows(make_docs, odd_rows):
    check(make_docs, odd_rows)
    null = [r for r in near_dedup.near_groups(make_docs(odd_rows)).collect() if r.doc_id is None and r.n_shingles]
    assert [(r.component_id, r.kept) for r in null] == [(None, True)] or all(r.component_id is None for r in null)


def test_empty_table(make_docs):
    assert near_dedup.near_groups(make_docs([])).collect() == []
    assert near_dedup.one_of_each(make_docs([])).collect() == []


def edited(rng, words, share):
    return [w if rng.random() > share else f"n{rng.randrange(10**6)}" for w in words]


def test_groups_chains_and_shared_passages(make_docs, monkeypatch):
    """A large group of near copies whose links do not all meet at one document, chains, and unlinked texts with one passage."""
    monkeypatch.setattr(near_dedup, "SMALL_BUCKET", 4)
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    rng = random.Random(5)
    base = [f"b{rng.randrange(10**6)}" for _ in range(120)]
    rows = [(k, " ".join(edited(rng, base, 0.012))) for k in range(60)]
    chain = [f"c{rng.randrange(10**6)}" for _ in range(80)]
    for k in range(100, 112):
        rows.append((k, " ".join(chain)))
        at = rng.randrange(0, 80, 9)
        chain = chain[:at] + [f"c{rng.randrange(10**6)}"] + chain[at + 1 :]
    passage = " ".join(f"p{k}" for k in range(40))
    rows += [(k, passage + " " + " ".join(f"q{rng.randrange(10**6)}" for _ in range(25))) for k in range(200, 260)]
    rng.shuffle(rows)
    check(make_docs, rows)


def test_one_of_each_keeps_whole_rows(make_docs):
    text = " ".join(f"a{k}" for k in range(50))
    docs = make_docs([(3, text), (2, text + " more"), (9, "other words here"), (10, None)])
    out = near_dedup.one_of_each(docs)
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect()) == [2, 9, 10]


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(3)
    for n, share in ((5, 0.6), (200, 0.5), (3000, 0.9)):
        a = rng.integers(0, 2**63, n, dtype=np.uint64)
        b = np.concatenate([a[: int(n * share)], rng.integers(0, 2**63, n - int(n * share), dtype=np.uint64)])
        rows = near_dedup.sketches([np.unique(a), np.unique(b)], 2048)
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((rows[0] == rows[1]).mean() - true) < 0.06


def test_components_of_random_graphs(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1300)] + [(2000, k) for k in range(2001, 2100)]
    low = {x: x for e in edges for x in e}
    for _ in range(len(low)):
        for u, v in edges:
            low[u] = low[v] = min(low[u], low[v])
    want = {x: c for x, c in low.items() if any(x in e and e[0] != e[1] for e in edges)}
    got = {r.node: r.comp for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == want
    assert components(spark.createDataFrame([], "u bigint, v bigint")).collect() == []
