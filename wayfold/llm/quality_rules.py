"""Quality rules: a threshold table compiled into one Spark projection, in built-in functions only.

A rule bounds a ratio of two counts of a document: it fails if ``100 * top`` is below ``least`` or above ``most`` times
``bottom``. All counts are whole numbers, so a verdict never hangs on rounding. The table is data: give other rules to
:func:`judged` and the projection follows. Words lie between ASCII white space; lines between line feeds, and only lines with a
word count.

Repeated words: a hash of every window of eight words, sorted with its place, shows which windows occur twice; the places then
say how many words these windows cover. Work and memory grow with the words of a text (times the logarithm of the number of
windows, and only where some window repeats). Two different windows of one text count as equal with a chance of 2^-64 a pair.

Cases: a null text counts as empty; an empty or blank text has no words and fails the base rule; repeated rows and ids are judged
each by itself, so there are no ties; a null id stays null; an empty table gives an empty table; other columns of the
input, whatever their names, are not read. No row is shuffled. A text is judged whole, in one task, at about 100 bytes a word.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import col

SPACES = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED = 30  # percent of the words
# Frequent short words without accents of English, German, French and Spanish.
STOP_WORDS = (
    "the", "of", "and", "to", "in", "is", "that", "for", "it", "was", "on", "with", "be", "as", "by", "this", "are", "from", "at", "or",
    "der", "die", "und", "den", "von", "zu", "das", "sich", "mit", "auf", "des", "ist", "nicht", "im", "dem", "ein", "eine", "als",
    "de", "la", "le", "et", "les", "en", "un", "du", "une", "que", "pour", "est", "qui", "dans", "par", "pas", "au", "sur", "avec",
    "el", "y", "los", "se", "del", "las", "por", "no", "con", "su", "una", "es", "para", "al", "lo",
)


@dataclass(frozen=True)
class Rule:
    """``least <= 100 * top / bottom <= most``; a bound that is None does not bind."""

    name: str
    top: str
    bottom: str
    least: int | None = None
    most: int | None = None

    def failed(self) -> Column:
        top, bottom = F.lit(100) * F.col(self.top), F.col(self.bottom)
        low = F.lit(False) if self.least is None else top < F.lit(self.least) * bottom
        high = F.lit(False) if self.most is None else top > F.lit(self.most) * bottom
        return low | high


# Ratios in percent. ``one`` is the number 1, for bounds of a count itself.
RULES = (
    Rule("length", "n_words", "one", most=100 * 1_000_000),
    Rule("word_length", "word_chars", "n_words", least=200, most=1_200),
    Rule("symbols", "n_symbols", "n_words", most=10),
    Rule("stop_words", "n_stop_words", "n_words", least=2),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", most=50),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", most=90),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_lines", most=30),
)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_lines", "n_bullet_lines", "n_ellipsis_lines")


def _without(text: Column, characters: str) -> Column:
    for c in characters:
        text = F.replace(text, F.lit(c))
    return text


def _has_word(line: Column) -> Column:
    return F.length(_without(line, SPACES)) > 0


def _doubled(hashes: str, half: int) -> Column:
    """At each place a hash of the element there and the one ``half`` places on."""
    return F.transform(hashes, lambda h, i: F.xxhash64(h, F.get(hashes, i + half)))


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: its id and :data:`COUNTS`."""
    text = docs.select(col(id_col).alias("doc_id"), F.coalesce(col(text_col), F.lit("")).alias("text"))
    # An array that later lambdas read must be a column by then: an expression inside a lambda is computed anew for every element.
    cut = text.select(
        "doc_id", "text", F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "").alias("words"),
        F.filter(F.split("text", "\n"), _has_word).alias("lines"),
    )
    # Hashes of one word, then of two, four and eight: each from two hashes of half the length.
    hashed = cut.select("*", F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))
    for half in (1, 2, 4):
        hashed = hashed.withColumn("hashes", _doubled("hashes", half))
    windowed = hashed.withColumn("windows", F.slice("hashes", F.lit(1), F.greatest(F.size("words") - (WINDOW - 1), F.lit(0)))).drop("hashes")
    ordered = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    repeats = windowed.select("*", F.when(F.size(F.array_distinct("windows")) < F.size("windows"), ordered).alias("ordered"))
    seen_twice = F.filter(
        "ordered", lambda w, k: (w["h"] == F.get("ordered", k + 1)["h"]) | ((k > 0) & (w["h"] == F.get("ordered", k - 1)["h"])),
    )
    found = repeats.select("*", F.sort_array(F.transform(seen_twice, lambda w: w["i"])).alias("places"))
    # Windows are equally long, so each adds what lies beyond the one before it.
    start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("bigint").alias("covered"))
    covered = F.aggregate(
        "places", start,
        lambda a, p: F.struct(p.alias("last"), (a["covered"] + F.least(F.lit(WINDOW), p - a["last"])).alias("covered")),
        lambda a: a["covered"],
    )
    lines, words = F.col("lines"), F.col("words")
    counts = {
        "n_words": F.size(words),
        "word_chars": F.length(_without(F.col("text"), SPACES)),
        "n_symbols": F.length("text") - F.length(_without(F.col("text"), SYMBOLS)),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": F.coalesce(covered, F.lit(0)),
        "n_stop_words": F.size(F.filter(words, lambda w: F.lower(w).isin(*STOP_WORDS))),
        "n_lines": F.size(lines),
        "n_bullet_lines": F.size(F.filter(lines, lambda x: x.startswith("- ") | x.startswith("* ") | x.startswith("•"))),
        "n_ellipsis_lines": F.size(F.filter(lines, lambda x: x.endswith("...") | x.endswith("…"))),
    }
    return found.select("doc_id", *[counts[n].cast("long").alias(n) for n in COUNTS])


def judged(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: its counts, ``base_failed``, ``kept`` and ``failed``, the names of the rules it breaks."""
    base = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    verdicts = F.array_compact(F.array(*[F.when(r.failed(), F.lit(r.name)) for r in rules])) if rules else F.array().cast("array<string>")
    counts = counted(docs, id_col, text_col).select("*", F.lit(1).cast("long").alias("one"))
    told = counts.select("doc_id", *COUNTS, base.alias("base_failed"), verdicts.alias("failed"))
    return told.select("doc_id", *COUNTS, "base_failed", (~F.col("base_failed") & (F.size("failed") == 0)).alias("kept"), "failed")
