"""The queries of this subpackage and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    bpe_codec,
    exact_dedup,
    id_store,
    language_codes,
    line_runs,
    ngram_join,
    quality_neighbours,
    quality_rules,
    source_divergence,
    source_mix,
    spelling_variants,
    token_counts,
    toxicity,
)
from .common import SPACE, WORD, documents, labels

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def vocabulary_path(name: str) -> str:
    """Where the installed public vocabularies are; a parameter of the operators."""
    import public_tokenizers

    return public_tokenizers.path(name)


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _re(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


@query
def op1_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(documents(spark, sf_dir))


# \x0B is a vertical tab, which DuckDB's patterns also know by this escape.
ORACLES["op1_exact_dedup"] = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
"""


@query
def op2_line_runs(spark, sf_dir):
    found = line_runs.without_runs(documents(spark, sf_dir))
    return found.select("doc_id", "n_lines", "n_deleted", "deleted_words", F.sha2("clean_text", 256).alias("clean_sha256"))


# The shortest windows of MIN_WORDS words from and up to every line; one that stood earlier goes.
ORACLES["op2_line_runs"] = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM d),
c AS (
  SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY i) AS upto
  FROM (SELECT *, len(regexp_extract_all(line, {_re(WORD)})) AS w FROM l)),
wins AS (
  SELECT a.doc_id, a.i, min(b.i) AS j FROM c a JOIN c b
    ON a.doc_id = b.doc_id AND b.i >= a.i AND b.upto - a.upto + a.w >= {line_runs.MIN_WORDS} GROUP BY a.doc_id, a.i
  UNION
  SELECT b.doc_id, max(a.i), b.i FROM c a JOIN c b
    ON a.doc_id = b.doc_id AND b.i >= a.i AND b.upto - a.upto + a.w >= {line_runs.MIN_WORDS} GROUP BY b.doc_id, b.i),
named AS (SELECT doc_id, i, j, j - i AS m, md5(array_to_string(ls[i:j], chr(10))) AS h FROM wins JOIN d USING (doc_id)),
hits AS (
  SELECT doc_id, i, max(j) AS j FROM (SELECT *, min((doc_id, i)) OVER (PARTITION BY h, m) AS f FROM named)
  WHERE (doc_id, i) > f GROUP BY doc_id, i),
cut AS (
  SELECT c.*, coalesce(max(h.j) OVER (PARTITION BY c.doc_id ORDER BY c.i), 0) >= c.i AS gone
  FROM c LEFT JOIN hits h ON h.doc_id = c.doc_id AND h.i = c.i)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_deleted,
       coalesce(sum(w) FILTER (gone), 0)::BIGINT AS deleted_words,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS clean_sha256
FROM cut GROUP BY doc_id
"""


@query
def op3_quality_neighbours(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return quality_neighbours.score(docs, quality_neighbours.fit(docs, labels(spark, sf_dir)))


@query
def op4_token_counts(spark, sf_dir):
    return token_counts.count_tokens(documents(spark, sf_dir), vocabulary_path("word_bpe_49k.json"), 2048)


@query
def op5_quality_rules(spark, sf_dir):
    return quality_rules.apply_rules(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


_LINE_FAILS = f"""(
  len(regexp_extract_all(line, {_re(quality_rules.LINE_SYMBOLS)})) * 5 > len(regexp_extract_all(line, {_re(WORD)}))
  OR len(regexp_extract_all(line, {_re(quality_rules.SEPARATORS)})) >= 3
  OR regexp_matches(line, {_re(quality_rules.MENU)})
  OR (len(regexp_extract_all(line, {_re(WORD)})) <= {quality_rules.STOCK_WORDS}
      AND regexp_matches(line, {_re(quality_rules.STOCK)}))
  OR (len(regexp_extract_all(line, {_re(WORD)})) >= {quality_rules.STUTTER_WORDS}
      AND list_unique(regexp_extract_all(line, {_re(WORD)})) * {quality_rules.STUTTER}
          < len(regexp_extract_all(line, {_re(WORD)}))))"""

ORACLES["op5_quality_rules"] = f"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {_re(WORD)}) AS words FROM documents),
w AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM t),
g AS (
  SELECT doc_id, i, concat_ws(' ', word, {", ".join(f"lead(word, {k}) OVER d" for k in range(1, 8))}) AS gram,
         lead(word, 7) OVER d AS last
  FROM w WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
m AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g WHERE last IS NOT NULL),
r AS (
  SELECT doc_id, sum(least(8, nxt - i)) AS n_repeat_words FROM (
    SELECT doc_id, i, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i), i + 8) AS nxt FROM m WHERE n > 1)
  GROUP BY doc_id),
l AS (
  SELECT doc_id, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t)
  WHERE regexp_matches(line, {_re(WORD)})),
ll AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines,
         sum(CASE WHEN {_LINE_FAILS} THEN 0 ELSE len(regexp_extract_all(line, {_re(WORD)})) END) AS n_kept
  FROM l GROUP BY doc_id),
a AS (
  SELECT t.doc_id, len(words)::BIGINT AS n_words,
         length(regexp_replace(text, {_re(SPACE)}, '', 'g'))::BIGINT AS word_chars,
         len(regexp_extract_all(text, {_re(quality_rules.SYMBOLS)}))::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_kept, 0)::BIGINT AS n_kept
  FROM t LEFT JOIN r USING (doc_id) LEFT JOIN ll USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND n_kept >= {quality_rules.MIN_WORDS}
       AND NOT 100 * (n_words - n_kept) > {quality_rules.MAX_LOSS} * n_words AS kept
FROM b
"""


@query
def op6_language_codes(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return language_codes.identify(docs, language_codes.fit(docs))


@query
def op7_toxicity(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return toxicity.score(docs, toxicity.fit(docs, labels(spark, sf_dir)))


@query
def op8_ngram_join(spark, sf_dir):
    return ngram_join.ngram_join(documents(spark, sf_dir)).select("doc_id", "class_id", "n_links")


@query
def op9_bpe_round_trip(spark, sf_dir):
    return bpe_codec.round_trip(documents(spark, sf_dir), vocabulary_path("byte_bpe_50k.json"))


@query
def op10_source_mix(spark, sf_dir):
    return source_mix.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


@query
def op13_source_divergence(spark, sf_dir):
    return source_divergence.audit(documents(spark, sf_dir))


_PRICE = "1 + ({scale}::HUGEINT * ({n} + 5)) // ({all_n} + 5 * kept)"

ORACLES["op13_source_divergence"] = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(coalesce(text, ''), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS words FROM documents),
w AS (
  SELECT r, lang, source, translate(unnest(words), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
kept AS (
  SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term
  HAVING count(DISTINCT r) >= {source_divergence.MIN_DOCS}),
langs AS (SELECT lang, sum(n) AS lang_n, count(*) AS kept FROM kept GROUP BY lang),
counts AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY ALL),
grid AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.n AS total
  FROM (SELECT DISTINCT lang, source FROM d) g JOIN kept k USING (lang)
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
priced AS (
  SELECT lang, source, term, n,
         {_PRICE.format(scale=source_divergence.SCALE, n="n", all_n="(sum(n) OVER (PARTITION BY lang, source))")} AS p,
         {_PRICE.format(scale=source_divergence.SCALE, n="total", all_n="lang_n")} AS q
  FROM grid JOIN langs USING (lang)),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM priced a JOIN priced b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM (SELECT DISTINCT lang, source FROM d) a JOIN (SELECT DISTINCT lang, source FROM d) b
    ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q)::BIGINT FROM priced WHERE n > 0 AND p > q)
SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank
FROM found QUALIFY part = 'pair' OR rank <= {source_divergence.TOP}
"""


@query
def op11_id_store(spark, sf_dir):
    return id_store.store_and_read(documents(spark, sf_dir), vocabulary_path("word_bpe_49k.json"))


@query
def op12_spelling_variants(spark, sf_dir):
    return spelling_variants.spelling_variants(documents(spark, sf_dir))


# CRC-32 by its table of 256 remainders, byte by byte.
ORACLES["op12_spelling_variants"] = f"""
WITH RECURSIVE steps AS (
  SELECT b, b AS v, 0 AS k FROM (SELECT unnest(generate_series(0::BIGINT, 255)) AS b)
  UNION ALL
  SELECT b, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM steps WHERE k < 8),
tab AS (SELECT list(v ORDER BY b) AS t FROM steps WHERE k = 8),
runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[{spelling_variants.LETTERS}]+')),
                           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
counted AS (
  SELECT coalesce(doc_id::VARCHAR, '') || ':' || run AS s, run, count(*) AS n FROM runs
  WHERE length(run) >= {spelling_variants.MIN_LENGTH} GROUP BY ALL),
hashed AS (
  SELECT run, n, xor(list_reduce(
      [4294967295::BIGINT] || list_transform(regexp_extract_all(hex(s), '..'), lambda x: ('0x' || x)::BIGINT),
      lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8)), 4294967295) AS h
  FROM counted, tab),
words AS (
  SELECT word, sum(n)::BIGINT AS n FROM (
    SELECT CASE WHEN h % {spelling_variants.THINNING} = 0
                THEN substring(run, 1, (h % length(run))::BIGINT) || substring(run, (h % length(run))::BIGINT + 2)
                ELSE run END AS word, n FROM hashed)
  WHERE length(word) >= {spelling_variants.MIN_LENGTH} GROUP BY word HAVING sum(n) >= {spelling_variants.MIN_COUNT}),
less AS (
  SELECT word, n, i, substring(word, 1, i - 1) || substring(word, i + 1) AS rest
  FROM (SELECT word, n, unnest(generate_series(1, length(word))) AS i FROM words)),
near AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM less a JOIN less b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION ALL
  SELECT DISTINCT a.word, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
  UNION ALL
  SELECT DISTINCT b.word, a.word, a.n FROM less a JOIN words b ON a.rest = b.word),
best AS (
  SELECT word, count(*) AS n_near, arg_min(near, (-near_n, near)) AS near, max(near_n) AS near_n FROM near GROUP BY word),
forms AS (
  SELECT w.word, CASE WHEN near_n >= {spelling_variants.FACTOR} * n THEN near END AS form, n, coalesce(n_near, 0) AS n_near,
         CASE WHEN near_n >= {spelling_variants.FACTOR} * n THEN near_n END AS form_n
  FROM words w LEFT JOIN best USING (word)),
chain AS (
  SELECT word, coalesce(form, word) AS root, form IS NULL AS done FROM forms
  UNION ALL
  SELECT c.word, coalesce(f.form, f.word), f.form IS NULL FROM chain c JOIN forms f ON f.word = c.root WHERE NOT c.done)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM forms f JOIN chain c ON c.word = f.word AND c.done
"""
