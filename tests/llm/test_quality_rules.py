import re

import pytest

from wayfold.llm import quality_rules
from wayfold.llm.quality_rules import Rule

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(text):
    words = WORD.findall(text or "")
    seen, lines, again = set(), [x for x in (text or "").split("\n") if WORD.search(x)], 0
    for line in lines:
        again += line in seen
        seen.add(line)
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(8)}
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum((text or "").count(c) for c in "#*$%&|<>"),
        "n_dup_lines": again, "n_repeat_words": len(covered), "n_lines": len(lines),
        "n_stop_words": sum(w.lower() in quality_rules.STOP_WORDS for w in words),
    }


PROSE = "the house of the old man was at the end of a long road and it had a red door that no one ever used"
TEXTS = [
    PROSE, PROSE + "\n" + PROSE, (PROSE + "\n") * 40, " ".join(f"w{i % 9}" for i in range(60)), "a b c d e f g h",
    "a a a a a a a a a a a a", PROSE + " ### $$$ ***", "\n".join(f"- item {i} of the list and more" for i in range(9)), "no line\x0bfeed\x0c here\r\nnext ",
    "the end is near...\n" * 3 + PROSE, PROSE.upper(), "é🙂 " * 30,
]


def test_equals_brute_force(make_docs, odd_rows):
    rows = odd_rows + [(100 + i, t) for i, t in enumerate(TEXTS)]
    got = quality_rules.judged(make_docs(rows)).collect()
    wanted = sorted((str(i), *brute(t).items()) for i, t in rows)
    assert sorted((str(r.doc_id), *((k, r[k]) for k in brute(""))) for r in got) == wanted
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert r.kept == (not r.base_failed and not r.failed)
    by_id = {r.doc_id: r for r in got}
    assert by_id[100].kept and by_id[100].failed == []
    assert by_id[102].base_failed and "duplicate_lines" in by_id[102].failed
    assert "symbols" in by_id[106].failed and "bullet_lines" in by_id[107].failed and "ellipsis_lines" in by_id[109].failed
    assert by_id[None].base_failed


def test_rules_are_data(make_docs):
    docs = make_docs([(1, PROSE)])
    assert quality_rules.judged(docs, (Rule("short", "n_words", "one", least=2_501),)).first().failed == ["short"]
    assert quality_rules.judged(docs, (Rule("short", "n_words", "one", least=2_500, most=2_500),)).first().failed == []
    assert quality_rules.judged(docs, ()).first().kept


def test_empty_table_and_plan(make_docs):
    judged = quality_rules.judged(make_docs([]))
    assert judged.collect() == []
    plan = judged._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == plan.count("Exchange RoundRobin") and "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("gap", [0, 1, 7, 8, 20])
def test_windows_that_overlap_count_each_word_once(make_docs, gap):
    part = [f"p{i}" for i in range(11)]
    text = " ".join(part + [f"g{i}" for i in range(gap)] + part)
    assert quality_rules.counted(make_docs([(1, text)])).first().n_repeat_words == brute(text)["n_repeat_words"] == 22
