"""The registered queries of this subpackage, each over the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, collocations, decontaminate, katz, lang_id, licenses, ngram_join, pii, quality_model, quality_rules, repair, suffix_dedup
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(function: Callable[[SparkSession, str], DataFrame]):
    QUERIES[function.__name__] = function
    return function


@query
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return quality_rules.assessed(docs, keep=["doc_id"]).select("row.doc_id", "q.*").drop("divergent")


@query
def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return encoded.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query
def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["conv_id", "turn", "role", "text"]
    trap = "\\### Assistant: </turn> ok"
    planted = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(trap).alias("text"),
    )
    rows = table(spark, sf_dir, "conversations").select(*columns).unionByName(planted)
    turns = chat.canonical_turns(chat.as_records(rows, columns))
    read = chat.digests(chat.format_turns(turns))
    return read.select(
        F.col("conversation").cast("long").alias("conv_id"),
        "n_turns",
        "turns_sha256",
        "loss_chars",
        "loss_sha256",
        "formatted_chars",
    )


@query
def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_groups(table(spark, sf_dir, "documents"))


@query
def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return cut.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query
def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    network = quality_model.fit(docs, labels, ~held_out)
    scored = quality_model.score(docs, network)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    base = pii.span_list(F.col("base"))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size("base") - F.size(F.array_remove(kinds, kind))).cast("long").alias(f"n_{kind}") for kind in pii.KINDS]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(base.cast("binary"), 256).alias("base_sha256"),
        pii.span_list(F.concat("base", "extra")).alias("spans"),
    )


@query
def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 10 == 0
    scored = katz.score(table(spark, sf_dir, "documents"), ~held_out)
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = collocations.count_phrases(table(spark, sf_dir, "documents"))
    return collocations.collocations(counts, top=2000)


@query
def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(True))  # null ids are not learned from
    labelled = lang_id.label(docs, lang_id.learn(docs, ~held_out))
    return labelled.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))


@query
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    damaged = repair.damaged(rows)
    return repair.digests(damaged, repair.plan(repair.assess(damaged, ids=rows)))


# Words of a text with A-Z in lower case, as the contracts define them.
_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    "'[^\\x20\\x09-\\x0D]+')"
)

ORACLE["op9_ngram_join"] = f"""
WITH RECURSIVE texts AS (SELECT doc_id, {_WORDS} AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM texts),
shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, a.n + b.n AS both_n, count(*) AS common
  FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs WHERE 100 * common >= 80 * (both_n - common)),
reached(doc_id, other) AS (
  SELECT doc_id, doc_id FROM sets UNION SELECT r.doc_id, l.b FROM reached r JOIN links l ON l.a = r.other)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, min(r.other) AS component_id
FROM sets s JOIN reached r ON r.doc_id = s.doc_id GROUP BY s.doc_id, len(s.s)
"""

_CLASSES = quality_rules.CHARACTER_CLASSES


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _distance(p: str, q: str) -> str:
    """Jensen-Shannon distance of two lists of shares, in bits."""
    term = "CASE WHEN {0} > 0 THEN {0} * log2({0} / (({1} + {2}) / 2)) ELSE 0 END"
    each = f"({term.format('x[1]', 'x[1]', 'x[2]')} + {term.format('x[2]', 'x[1]', 'x[2]')}) / 2"
    return f"sqrt(greatest(list_sum(list_transform(list_zip({p}, {q}), lambda x: {each})), 0))"


def _quality_sql() -> str:
    """The rules for documents in one of the listed languages, which all of the given ones are."""
    cuts, left = [], "t"
    for k, (_, pattern) in enumerate(_CLASSES):
        cuts.append(f"cut{k} AS (SELECT *, regexp_replace(l{k}, {_quoted(pattern)}, '', 'g') AS l{k + 1} FROM {left})")
        left = f"cut{k}"
    counts = ", ".join([f"length(l{k}) - length(l{k + 1})" for k in range(len(_CLASSES))] + [f"length(l{len(_CLASSES)})"])
    lists = " ".join(
        f"WHEN lang = '{lang}' THEN [{', '.join(map(_quoted, words))}]" for lang, words in quality_rules.COMMON_WORDS.items()
    )
    limits = quality_rules.Limits()
    space, symbol = ([name for name, _ in _CLASSES].index(n) for n in ("space", "symbol"))
    return f"""
WITH t AS (
  SELECT doc_id, lang, coalesce(text, '') AS l0, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
    CASE {lists} END AS common FROM documents),
{", ".join(cuts)},
counted AS (
  SELECT doc_id, lang, l0, w, len(w) AS n, [{counts}] AS c,
    list_concat(list_transform(common, lambda k: len(list_filter(w, lambda x: lower(x) = k))),
      [len(list_filter(w, lambda x: NOT list_contains(common, lower(x))))]) AS f,
    list_transform(range(1, greatest(len(w) - 3, 1)), lambda i: array_to_string(w[i:i + 4], ' ')) AS grams,
    list_filter(string_split(l0, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM {left}),
shares AS (
  SELECT *, list_transform(c, lambda x: x / greatest(list_sum(c), 1)) AS cs, list_transform(f, lambda x: x / greatest(n, 1)) AS fs
  FROM counted),
c_means AS (
  SELECT lang, list(m ORDER BY k) AS c_ref FROM (
    SELECT lang, k, avg(cs[k]) AS m FROM shares, range(1, {len(_CLASSES) + 2}) r(k)
    WHERE n >= {limits.min_words_for_characters} GROUP BY lang, k) GROUP BY lang),
f_means AS (
  SELECT lang, list(m ORDER BY k) AS f_ref FROM (
    SELECT lang, k, avg(fs[k]) AS m FROM shares, range(1, 17) r(k)
    WHERE n >= {limits.min_words_for_common} GROUP BY lang, k) GROUP BY lang),
places AS (SELECT doc_id, unnest(grams) AS g, unnest(range(1, len(grams) + 1)) AS i FROM shares),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS k FROM places) WHERE k > 1),
again AS (
  SELECT doc_id, count(DISTINCT i + d) AS n_repeat FROM twice, range(0, 5) r(d) GROUP BY doc_id),
figures AS (
  SELECT s.doc_id, CAST(n AS BIGINT) AS n_words, CAST(length(l0) - c[{space + 1}] AS BIGINT) AS word_chars,
    CAST(c[{symbol + 1}] AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n_repeat, 0) AS BIGINT) AS n_repeat_words,
    coalesce(n >= {limits.min_words_for_characters} AND {_distance("cs", "c_ref")} > {limits.max_character_distance}, false)
    OR coalesce(n >= {limits.min_words_for_common} AND {_distance("fs", "f_ref")} > {limits.max_word_distance}, false) AS far
  FROM shares s LEFT JOIN again USING (doc_id) LEFT JOIN c_means USING (lang) LEFT JOIN f_means USING (lang))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR far) AS kept
FROM figures
"""


ORACLE["op10_quality_rules"] = _quality_sql()

ORACLE["op11_collocations"] = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang),
places AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
  FROM words, range(1, 6) r(k) WHERE len(w) >= k),
frequent AS (SELECT lang, k, phrase, count(*) AS f FROM places GROUP BY ALL HAVING count(*) >= 100),
cuts AS (
  SELECT lang, k, phrase, f AS a, c AS cut, array_to_string(string_split(phrase, ' ')[1:c], ' ') AS head,
    array_to_string(string_split(phrase, ' ')[c + 1:], ' ') AS tail
  FROM frequent, range(1, 5) r(c) WHERE c < k),
scored AS (
  SELECT c.lang, c.phrase, c.a, cut, x.f AS l, y.f AS r, n,
    CAST((CAST(1000 AS HUGEINT) * c.a * n) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM cuts c JOIN totals t ON t.lang = c.lang JOIN frequent x ON x.lang = c.lang AND x.phrase = c.head
  JOIN frequent y ON y.lang = c.lang AND y.phrase = c.tail),
weakest AS (
  SELECT * FROM scored s WHERE NOT EXISTS (
    SELECT 1 FROM frequent o WHERE o.lang = s.lang AND o.k > len(string_split(s.phrase, ' ')) AND 100 * o.f >= 100 * s.a
      AND contains(' ' || o.phrase || ' ', ' ' || s.phrase || ' '))
  QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM weakest)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
"""


def _repair_sql() -> str:
    """Damage, faults, and the cheapest edits from the end of each distinct signature, all as lists in recursions."""
    best = lambda *options: f"list_sort([{', '.join(options)}])[1]"
    choice = lambda cost, edit, state: f"{{'c': {cost} + g[{state + 1}].c, 'a': '{edit}' || g[{state + 1}].a}}"
    inserted = lambda n, state: f"{{'c': {3 * n} + b[{state + 1}].c, 'a': '{'I' * n}' || b[{state + 1}].a}}"
    steps, after = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}, {0: 2, 1: 2, 2: 3, 3: 2}
    more = "CASE WHEN letter = upper(letter) THEN 3 ELSE 0 END"
    rest, whole = [], []
    for state in range(4):
        delete, relabel = choice("4", "D", state), choice(f"3 + {more}", "R", after[state])
        kept = " ".join(f"WHEN lower(letter) = '{r}' THEN {best(delete, relabel, choice(more, 'K', to))}" for r, to in steps[state].items())
        rest.append(f"CASE WHEN letter = 'x' THEN {delete} {kept} ELSE {best(delete, relabel)} END")
        chain = [state, after[state], after[after[state]], after[after[after[state]]]]
        whole.append(best(*[inserted(n, to) for n, to in enumerate(chain)]))
    last = "[{'c': 0, 'a': ''}, {'c': 6, 'a': 'II'}, {'c': 3, 'a': 'I'}, {'c': 0, 'a': ''}]"
    wanted = "CASE state WHEN 2 THEN 'assistant' ELSE 'user' END"
    to = lambda role: f"CASE left({role}, 1) WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END"
    return f"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''),
      lambda c: CAST(ord(c) AS BIGINT)) AS bytes FROM conversations),
fated AS (
  SELECT *, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], bytes), lambda c, b:
    list_reduce(list_concat([xor(c, b)], [CAST(0 AS BIGINT) FOR z IN range(8)]), lambda r, z: xor(r >> 1, 3988292384 * (r & 1)))),
    4294967295) % 20 AS fate FROM keyed),
rows_ AS (
  SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
    CASE fate WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM fated, range(2) r(copy) WHERE fate <> 0 AND (copy = 0 OR fate = 3)),
counted AS (
  SELECT *, left(role, 1) AS initial, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS trimmed,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS seen FROM rows_),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, seen) AS place FROM counted),
faults AS (
  SELECT *, CASE WHEN trimmed = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate'
    WHEN right(trimmed, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY place) || initial AS pair FROM placed),
lettered AS (
  SELECT *, CASE WHEN fault IN ('blank', 'duplicate') THEN 'x' WHEN initial NOT IN ('s', 'u', 'a') AND fault = '' THEN 'o'
    WHEN initial NOT IN ('s', 'u', 'a') THEN 'O' WHEN fault = '' THEN initial ELSE upper(initial) END AS letter FROM faults),
found AS (
  SELECT conv_id, string_agg(letter, '' ORDER BY place) AS signature, list(role ORDER BY place) AS roles, list(text ORDER BY place) AS texts,
    coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM lettered GROUP BY conv_id),
convs AS (
  SELECT i.conv_id, coalesce(signature, '') AS signature, roles, texts, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank,
    coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal
  FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN found f ON f.conv_id IS NOT DISTINCT FROM i.conv_id),
costs(signature, place, g) AS (
  SELECT DISTINCT signature, length(signature), {last} FROM convs
  UNION ALL
  SELECT signature, place - 1, [{', '.join(whole)}] FROM (
    SELECT signature, place, [{', '.join(rest)}] AS b FROM (
      SELECT signature, place, g, signature[place] AS letter FROM costs WHERE place > 0))),
planned AS (SELECT c.*, g[1].c AS cost, g[1].a AS audit FROM convs c JOIN costs x ON x.signature = c.signature AND x.place = 0),
walk(conv_id, audit, roles, texts, pos, place, state, said) AS (
  SELECT conv_id, audit, roles, texts, 1, 1, 0, CAST([] AS VARCHAR[]) FROM planned
  UNION ALL
  SELECT conv_id, audit, roles, texts, pos + 1, place + CASE WHEN edit = 'I' THEN 0 ELSE 1 END,
    CASE edit WHEN 'D' THEN state WHEN 'K' THEN {to("roles[place]")} ELSE {to(wanted)} END,
    CASE edit WHEN 'D' THEN said WHEN 'K' THEN list_append(said, roles[place] || ':' || texts[place])
      WHEN 'R' THEN list_append(said, {wanted} || ':' || texts[place]) ELSE list_append(said, {wanted} || ':') END
  FROM (SELECT *, audit[pos] AS edit FROM walk WHERE pos <= length(audit)))
SELECT p.conv_id, p.gaps, p.blank, p.duplicate, p.truncated, p.illegal, CAST(p.cost AS BIGINT) AS cost, p.audit,
  CAST(len(said) AS BIGINT) AS n_turns, sha256(array_to_string(said, chr(10))) AS repaired_sha256
FROM planned p JOIN walk w ON w.conv_id IS NOT DISTINCT FROM p.conv_id AND w.pos = length(w.audit) + 1
"""


ORACLE["op13_conversation_repair"] = _repair_sql()

# All windows of 400 bytes; those that occur again, and what is left between them, put together in hexadecimal.
ORACLE["op5_suffix_dedup"] = """
WITH texts AS (SELECT doc_id, row_number() OVER () AS r, encode(coalesce(text, '')) AS b, hex(encode(coalesce(text, ''))) AS h FROM documents),
windows AS (
  SELECT r, i, md5(b[i + 1:i + 400]) AS m
  FROM (SELECT r, b, unnest(range(0, octet_length(b) - 399)) AS i FROM texts WHERE octet_length(b) >= 400)),
starts AS (SELECT r, i FROM windows WHERE m IN (SELECT m FROM windows GROUP BY m HAVING count(*) > 1)),
runs AS (
  SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS run FROM (
    SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= 400 THEN 0 ELSE 1 END AS fresh FROM starts)),
spans AS (SELECT r, min(i) AS low, max(i) + 400 AS high FROM runs GROUP BY r, run),
pieces AS (
  SELECT r, coalesce(lag(high) OVER (PARTITION BY r ORDER BY low), 0) AS low, low AS high FROM spans
  UNION ALL SELECT t.r, coalesce(max(high), 0), CAST(length(any_value(h)) / 2 AS BIGINT) FROM texts t LEFT JOIN spans s ON s.r = t.r GROUP BY t.r),
kept AS (
  SELECT t.r, string_agg(CASE WHEN high > low THEN h[2 * low + 1:2 * high] ELSE '' END, '' ORDER BY low) AS k
  FROM texts t JOIN pieces p ON p.r = t.r GROUP BY t.r)
SELECT t.doc_id, CAST(length(h) / 2 AS BIGINT) AS n_bytes, CAST((length(h) - length(k)) / 2 AS BIGINT) AS n_removed,
  (SELECT count(*) FROM spans s WHERE s.r = t.r) AS n_spans, sha256(unhex(k)) AS kept_sha256
FROM texts t JOIN kept USING (r)
"""

ORACLE["op8_chat_format"] = f"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, t, CASE t WHEN 0 THEN 'user' ELSE 'assistant' END, '\\### Assistant: </turn> ok' FROM range(2) r(t)),
turns AS (
  SELECT *, replace(replace(role, '\\', '\\\\'), '<|', '<\\|') AS r, replace(replace(text, '\\', '\\\\'), '<|', '<\\|') AS t FROM rows_),
lined AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
    CAST(sum(length(r) + length(t) + {len(chat.START) + len(chat.TEXT) + len(chat.END)}) AS BIGINT) AS formatted_chars
  FROM turns GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars
FROM lined
"""
