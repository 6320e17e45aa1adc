"""The numbered operators as queries over whole tables, with production parameters, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm import (
    chat, decontaminate, exact_dedup, language, lm_score, merkle, near_dedup, packing, quality, quality_rules, repair, token_counts, toxicity,
)
from wayfold.llm.common import crc_fold, documents
from wayfold.operators.blocks import never_null


WORD_VOCABULARY = "word_bpe_49k.json"


def vocabulary(name: str = WORD_VOCABULARY) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs, train = documents(spark, folder), crc_fold("doc_id", 3) != 1
    ranking = quality.fit(docs, documents(spark, folder, "labels").where(train), train)
    out = quality.score(docs, ranking)
    return out.select("doc_id", (crc_fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.near_groups(documents(spark, folder))


# Links by counting common shingles; components by following the smallest id.
OP2_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x : x <> '') AS words
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(words[i : i + 4], ' ') AS shingle
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT u, v FROM common JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * k >= 75 * (x.n + y.n - k)),
reach(a, b) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT reach.a, links.v FROM reach JOIN links ON reach.b = links.u)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) c USING (doc_id)
"""


def op3_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, folder))


OP3_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
  sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""

def op4_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    models = language.fit(docs, crc_fold("doc_id", 4) != 2)
    out = language.identify(docs, models)
    return out.select("doc_id", (crc_fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "rejected")


def op5_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(documents(spark, folder), vocabulary(), with_ids=False)


def op6_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contaminated(documents(spark, folder), documents(spark, folder, "benchmark"))


_MARKED = "\\### Assistant: </turn> ok"


def op7_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    talks = documents(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    marked = spark.createDataFrame([(-7, 0, "user", _MARKED), (-7, 1, "assistant", _MARKED)], talks.schema)
    chats = chat.format_chats(talks.unionByName(marked))
    turns = chat.read_back(F.col("formatted"))
    digest = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = chat.loss_text(F.col("formatted"), F.col("loss_spans"))
    return chats.select(
        "conv_id", F.size(turns).cast("long").alias("n_turns"), F.sha2(digest.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP7_SQL = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'),
s AS (
  SELECT *, length(role) + length(regexp_replace(role, '[^\\\\<#:]', '', 'g')) AS role_chars,
    length(text) + length(regexp_replace(text, '[^\\\\<#]', '', 'g')) AS text_chars FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(4 + role_chars + 2 + text_chars + 8) AS BIGINT) AS formatted_chars
FROM s GROUP BY conv_id
"""

def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = documents(spark, folder), documents(spark, folder, "labels")
    crf = toxicity.fit(docs, labels.where(crc_fold("doc_id", 3) != 1), crc_fold("doc_id", 3) != 1)
    out = toxicity.score(docs, crf, spans=False)
    return out.select("doc_id", (crc_fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op9_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    """Target: the documents labelled as good; the labels of all of them, since this scores likeness and predicts no label."""
    target = documents(spark, folder, "labels").where("quality = 1").select("doc_id")
    return lm_score.lm_scores(documents(spark, folder), target)


def op10_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    counts = token_counts.token_counts(documents(spark, folder), vocabulary())
    return counts.withColumn("over_limit", F.col("n_tokens") > 2048)


def op11_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.judged(documents(spark, folder)).withColumn("failed", F.array_join("failed", ","))


def _rule_sql(rule: quality_rules.Rule) -> str:
    low = "" if rule.least is None else f"100 * {rule.top} < {rule.least} * {rule.bottom}"
    high = "" if rule.most is None else f"100 * {rule.top} > {rule.most} * {rule.bottom}"
    return f"CASE WHEN {' OR '.join(filter(None, (low, high)))} THEN '{rule.name}' END"


OP11_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words,
  list_filter(string_split(text, chr(10)), lambda x : regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
v AS (SELECT r, p, array_to_string(words[p : p + 7], ' ') AS win FROM (SELECT r, words, unnest(range(1, len(words) - 6)) AS p FROM w WHERE len(words) > 7)),
c AS (
  SELECT r, count(DISTINCT p + k) AS n FROM (SELECT r, p, count(*) OVER (PARTITION BY r, win) AS times FROM v) CROSS JOIN range(8) AS t(k)
  WHERE times > 1 GROUP BY r),
f AS (
  SELECT doc_id, len(words) AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words,
    len(list_filter(words, lambda x : lower(x) IN ({", ".join(f"'{x}'" for x in quality_rules.STOP_WORDS)}))) AS n_stop_words, len(lines) AS n_lines,
    len(list_filter(lines, lambda x : starts_with(x, '- ') OR starts_with(x, '* ') OR starts_with(x, '•'))) AS n_bullet_lines,
    len(list_filter(lines, lambda x : ends_with(x, '...') OR ends_with(x, '…'))) AS n_ellipsis_lines, 1 AS one
  FROM w LEFT JOIN c USING (r)),
j AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, concat_ws(',', {", ".join(map(_rule_sql, quality_rules.RULES))}) AS failed FROM f)
SELECT * EXCLUDE (one), NOT base_failed AND failed = '' AS kept FROM j
"""


def op12_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.documents_manifest(documents(spark, folder), crc_fold("doc_id", 3) == 0)


# crc32 of a short ASCII text, byte by byte over the polynomial's table.
_CRC_TABLE = "crc_table AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, " + "{x} AS v FROM range(256) AS r(i)))"
for _ in range(8):
    _CRC_TABLE = _CRC_TABLE.replace("{x}", "list_transform([{x}], lambda c : xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END))[1]")
_CRC_TABLE = _CRC_TABLE.replace("{x}", "i")


def _crc_sql(text: str) -> str:
    """crc32 of a text's ASCII characters, with ``crc_table`` in scope."""
    codes = f"list_transform(string_split({text}, ''), lambda ch : CAST(ord(ch) AS BIGINT))"
    step = "lambda c, b : xor(t[CAST(xor(c, b) & 255 AS INTEGER) + 1], c >> 8)"
    return f"xor(list_reduce({codes}, {step}, CAST(4294967295 AS BIGINT)), 4294967295)"


def _field_sql(name: str, value: str) -> str:
    return f"coalesce(strlen({value}) || ':' || {value}, '-')"


def _levels_sql(first: str, key: str, name: str, levels: int) -> str:
    """Tables name0 .. nameN (key, i, h, pre, post): nodes with their digest and the digests of their run before and after; none beyond a root."""
    around = f"OVER (PARTITION BY {key}, i // 8 ORDER BY i ROWS BETWEEN "
    tables = []
    for j in range(levels + 1):
        source = first if j == 0 else (
            f"SELECT {key}, i // 8 AS i, sha256(string_agg(h, '' ORDER BY i)) AS h FROM {name}{j - 1} "
            f"WHERE n > 1 GROUP BY {key}, i // 8"
        )
        tables.append(
            f"{name}{j} AS (SELECT *, count(*) OVER (PARTITION BY {key}) AS n, "
            f"coalesce(string_agg(h, '') {around}UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS pre, "
            f"coalesce(string_agg(h, '') {around}1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS post FROM ({source}))"
        )
    return ",\n".join(tables)


_LEVELS = 8  # 8 ** 8 leaves of a language, and as many languages
_FIELDS_SQL = " || ".join(_field_sql(f, "{text}" if f == "text" else f"CAST({f} AS VARCHAR)") for f in merkle.FIELDS)
_UP = " ".join(f"LEFT JOIN a{j} ON a{j}.k = d.k AND a{j}.i = d.i // {8**j} AND a{j}.n > 1" for j in range(_LEVELS))
_UP += " " + " ".join(f"LEFT JOIN b{j} ON b{j}.i = s.i // {8**j} AND b{j}.n > 1" for j in range(_LEVELS))
_RUNS = [f"a{j}" for j in range(_LEVELS)] + [f"b{j}" for j in range(_LEVELS)]
_FOLDS = "".join(
    f"f{j + 1} AS (SELECT * EXCLUDE (x), CASE WHEN {r}_pre IS NULL THEN x ELSE sha256({r}_pre || x || {r}_post) END AS x FROM f{j}),\n"
    for j, r in enumerate(_RUNS)
)
OP12_SQL = f"""
WITH {_CRC_TABLE},
d AS (
  SELECT doc_id, coalesce('=' || lang, '') AS k, h, CASE WHEN m THEN g END AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, h) - 1 AS i
  FROM (
    SELECT doc_id, lang, sha256({_FIELDS_SQL.replace("{text}", "text")}) AS h,
      sha256({_FIELDS_SQL.replace("{text}", "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}) AS g,
      coalesce({_crc_sql("CAST(doc_id AS VARCHAR)")} % 3 = 0, false) AS m
    FROM documents CROSS JOIN crc_table)),
{_levels_sql("SELECT k, i, h FROM d", "k", "a", _LEVELS)},
s AS (SELECT k, row_number() OVER (ORDER BY k) - 1 AS i, h FROM ({" UNION ALL ".join(f"SELECT k, h FROM a{j} WHERE n = 1" for j in range(_LEVELS + 1))})),
{_levels_sql("SELECT 0 AS z, i, h FROM s", "z", "b", _LEVELS)},
top AS ({" UNION ALL ".join(f"SELECT h AS root FROM b{j} WHERE n = 1" for j in range(_LEVELS + 1))}),
f0 AS (
  SELECT d.doc_id, d.h AS leaf, s.h AS subroot, root, coalesce(d.g, d.h) AS x, {", ".join(f"{r}.pre AS {r}_pre, {r}.post AS {r}_post" for r in _RUNS)}
  FROM d JOIN s ON s.k = d.k CROSS JOIN top {_UP}),
{_FOLDS}e AS (SELECT *, sha256(concat({", ".join(f"{r}_pre, {r}_post" for r in _RUNS)})) AS proof_sha256 FROM f{len(_RUNS)})
SELECT doc_id, leaf, subroot, root, proof_sha256, x AS folded_root, x = root AS verified FROM e
"""


def _damaged(talks: DataFrame) -> DataFrame:
    """One row in four or so is dropped, emptied, cut, repeated or given to the user, by its number."""
    space = F.lit(" ")
    named = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    rows = talks.select(
        "conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), (F.crc32(named.cast("binary")) % 20).alias("kind"),
    ).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.array_repeat(F.struct(role.alias("role"), text.alias("text")), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", copies.alias("c")).select("conv_id", "turn", "c.role", "c.text")


def op13_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    talks = documents(spark, folder, "conversations")
    fixed = repair.repair(_damaged(talks))
    key = never_null(F.col("conv_id")).alias("key")
    every = talks.select("conv_id").distinct().select(key, "conv_id")
    report = fixed.report.withColumnRenamed("conv", "conv_id").select(key, "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    told = every.join(report, "key", "left").join(repair.digests(repair.repaired_turns(fixed)), "key", "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    return told.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", nothing).alias("repaired_sha256"))


def _edits_sql() -> str:
    """(letter, p, q, cost, audit, pieces): what a row may come to between two states; {r} and {t} stand for its role and text."""
    after = {"n": "u", "s": "u", "u": "a", "a": "u"}
    names = {"u": "user", "a": "assistant"}
    found = []
    for letter in "suaoSUAOx":
        close = 3 * letter.isupper()
        for p in after:
            state, out = p, ""
            for k in range(3):
                found.append((letter, p, state, 4 + 3 * k, "I" * k + "D", out, ""))
                if letter != "x":
                    found.append((letter, p, after[state], 3 + close + 3 * k, "I" * k + "R", out, names[after[state]]))
                own = letter.lower()
                if own == after[state] or own == "s" and state == "n":
                    found.append((letter, p, own, close + 3 * k, "I" * k + "K", out, "{own}"))
                state = after[state]
                out += f"|{names[state]}:"
    return ", ".join(f"('{a}', '{p}', '{q}', {c}, '{e}', '{o}', '{r}')" for a, p, q, c, e, o, r in found)


OP13_SQL = f"""
WITH RECURSIVE {_CRC_TABLE},
edits(letter, p, q, c, e, ins, own) AS (VALUES {_edits_sql()}),
every AS (SELECT DISTINCT conv_id, coalesce('=' || conv_id, '') AS k FROM conversations),
raw AS (
  SELECT coalesce('=' || conv_id, '') AS k, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {_crc_sql("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS kind
  FROM conversations CROSS JOIN crc_table),
damaged AS (
  SELECT k, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM raw CROSS JOIN range(2) AS c(copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)),
placed AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged),
told AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY k, role, text ORDER BY i) > 1 THEN 'duplicate'
      WHEN regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN '' ELSE 'truncated' END AS fault,
    lag(left(role, 1)) OVER (PARTITION BY k ORDER BY i) || left(role, 1) AS pair
  FROM placed),
rows AS (
  SELECT *, CASE WHEN fault IN ('blank', 'duplicate') THEN 'x' WHEN fault = 'truncated' THEN upper(base) ELSE base END AS letter
  FROM (SELECT *, CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'o' END AS base FROM told)),
way(k, i, q, best) AS (
  SELECT k, 0, 'n', {{'c': 0, 'e': '', 'o': ''}} FROM every
  UNION ALL
  SELECT k, i, q, min(step) FROM (
    SELECT way.k AS k, rows.i AS i, edits.q AS q, {{'c': best.c + edits.c, 'e': best.e || edits.e, 'o': best.o || replace(ins, '|', chr(10))
      || CASE own WHEN '' THEN '' WHEN '{{own}}' THEN chr(10) || role || ':' || text ELSE chr(10) || own || ':' || text END}} AS step
    FROM way JOIN rows ON rows.k = way.k AND rows.i = way.i + 1 JOIN edits ON edits.letter = rows.letter AND edits.p = way.q) GROUP BY k, i, q),
ends AS (
  SELECT k, min({{'c': best.c + t.c, 'e': best.e || t.e, 'o': best.o || replace(t.o, '|', chr(10))}}) AS best
  FROM way JOIN (VALUES ('n', 0, '', ''), ('s', 6, 'II', '|user:|assistant:'), ('u', 3, 'I', '|assistant:'), ('a', 0, '', '')) AS t(q, c, e, o) USING (q)
  WHERE way.i = coalesce((SELECT max(i) FROM rows WHERE rows.k = way.k), 0) GROUP BY k),
n AS (
  SELECT k, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM rows GROUP BY k)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, CAST(best.c AS BIGINT) AS cost, best.e AS audit, sha256(substr(best.o, 2)) AS repaired_sha256
FROM every LEFT JOIN n USING (k) JOIN ends USING (k)
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_near_dedup": op2_near_dedup,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_language_id": op4_language_id,
    "op5_packing": op5_packing,
    "op6_decontamination": op6_decontamination,
    "op7_chat_formatting": op7_chat_formatting,
    "op8_toxicity": op8_toxicity,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_token_counts": op10_token_counts,
    "op11_quality_rules": op11_quality_rules,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_conversation_repair": op13_conversation_repair,
}
ORACLE_SQL: dict[str, str] = {
    "op2_near_dedup": OP2_SQL, "op3_exact_dedup": OP3_SQL, "op7_chat_formatting": OP7_SQL, "op11_quality_rules": OP11_SQL,
    "op12_merkle_manifest": OP12_SQL, "op13_conversation_repair": OP13_SQL,
}
