import random
from collections import Counter

import numpy as np

from wayfold.llm import decontaminate


def grams(words):
    n = min(5, len(words))
    return [tuple(words[i : i + n]) for i in range(len(words) - n + 1)] if words else []


def brute(docs, items):
    """Best window of every item by exact weighted similarity of all windows."""
    found = {}
    for d, text in docs:
        words = (text or "").encode().lower().split()
        for i, item in items:
            wanted = (item or "").encode().lower().split()
            if not wanted:
                continue
            goal = Counter(grams(wanted))
            for s in range(max(1, len(words) - len(wanted) + 1)):
                own = Counter(grams(words[s : s + len(wanted)]))
                both = sum((goal & own).values())
                similarity = both / (sum(goal.values()) + sum(own.values()) - both) if both else 0
                if similarity >= 0.75 and similarity > found.get((d, i), (0, 0))[0]:
                    found[d, i] = (similarity, s)
    return found


def cases():
    rng = random.Random(7)
    word = lambda: f"w{rng.randrange(400)}"
    items = [(k, " ".join(word() for _ in range(rng.choice([6, 12, 30, 60])))) for k in range(12)]
    items += [(20, "one two three"), (21, None), (22, ""), (23, items[3][1]), (24, "same same same same same same same same")]
    docs = []
    for k in range(80):
        words = [word() for _ in range(rng.randrange(0, 200))]
        at = rng.randrange(len(words) + 1)
        passage = items[rng.randrange(12)][1].split()
        if k % 3 == 0:
            for _ in range(rng.randrange(4)):
                passage[rng.randrange(len(passage))] = word()
            words[at:at] = passage
        elif k % 3 == 1:
            words[at:at] = passage[: len(passage) // 2]
        docs.append((k, " ".join(words).upper() if k % 2 else "\n".join(words)))
    docs += [(100, None), (101, ""), (102, "One TWO three"), (103, "x one two three y"), (104, "one two"), (105, "same " * 20), (106, items[2][1] + " . " + items[5][1])]
    docs += [(107, items[4][1]), (107, items[4][1]), (None, items[4][1])]
    return docs, items


def test_equals_brute_force(spark, make_docs, monkeypatch):
    docs, items = cases()
    bench = spark.createDataFrame([(i, t) for i, t in items], "item_id bigint, text string")
    want = brute([d for d in docs if d[0] is not None], items)
    for block in (1_000_000, 100):
        monkeypatch.setattr(decontaminate, "BLOCK_SHINGLES", block)
        rows = decontaminate.contaminated(make_docs(docs), bench).collect()
        got = {(r.doc_id, r.item_id): (r.similarity, r.start_word) for r in rows if r.doc_id is not None}
        assert set(got) == set(want)
        assert all(abs(got[k][0] - want[k][0]) < 1e-9 for k in want)
        assert {r.item_id for r in rows if r.doc_id is None} == {4}
        assert len([r for r in rows if r.doc_id == 107 and r.item_id == 4]) == 2
        clean = decontaminate.clean(make_docs(docs), bench)
        assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(i) for i, _ in docs if i is not None and not any(k[0] == i for k in want))
        assert clean.columns == make_docs(docs).columns


def test_empty_tables(spark, make_docs):
    none = spark.createDataFrame([], "item_id bigint, text string")
    some = spark.createDataFrame([(1, "a b c d e f")], "item_id bigint, text string")
    docs = make_docs([(1, "a b c d e f")])
    assert decontaminate.contaminated(docs, none).collect() == [] and decontaminate.clean(docs, none).count() == 1
    assert decontaminate.contaminated(make_docs([]), some).collect() == [] and decontaminate.clean(docs, some).count() == 0


def test_index_gives_all_within_the_radius():
    rng = np.random.default_rng(6)
    prints = rng.integers(0, 2**63, 300, dtype=np.uint64)
    for radius in (3, 24):
        index = decontaminate.HammingIndex(prints, radius)
        for k in range(60):
            probe = prints[k] ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, radius, dtype=np.uint64))
            want = np.flatnonzero(np.bitwise_count(prints ^ probe) <= radius)
            assert k in want and index.within(probe).tolist() == want.tolist()
