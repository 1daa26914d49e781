"""The registry's queries as DuckDB SQL over the same tables."""

from __future__ import annotations

from ..fixed_values import (
    ASCII_PUNCTUATION,
    ATTRIBUTION,
    CHAT_MARKERS,
    FORWARD_TAG,
    RAG_PREAMBLE,
    SUMMARY_TEMPLATE,
    SYSTEM_PREAMBLE,
    THREAD_PREAMBLE,
    WS,
    WS_CHARS,
)

NL = "chr(10)"


def lit(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


TRIM = lit(WS_CHARS)
SYSTEM = lit(SYSTEM_PREAMBLE + "\n\n")
FROM_SENDERS = "(contains(from_addr, 'assistant@example.com') OR contains(from_addr, 'system@example.com'))"


def words(text: str) -> str:
    return f"regexp_extract_all({text}, '[^{WS}]+')"


def normal(text: str) -> str:
    clean = f"lower(translate({text}, {lit(ASCII_PUNCTUATION)}, ''))"
    return f"trim(regexp_replace({clean}, '[{WS}]+', ' ', 'g'), ' ')"


def rouge_words(text: str) -> str:
    return f"regexp_extract_all(lower({normal(text)}), '[a-z0-9]+')"


MAILS = f"""
linked AS (
  SELECT *, lag(text, 1) OVER w AS prev, lag(text, 2) OVER w AS prev2
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
mails AS (
  SELECT conv_id, turn, conv_id || '-' || turn AS email_id, role, text, prev, prev2,
    regexp_replace(
      (CASE WHEN role = 'system' THEN {lit(FORWARD_TAG)} || {NL} || text ELSE text END)
      || coalesce({NL} || {NL} || 'On turn ' || turn || ' they wrote:' || {NL} || '> '
                  || replace(prev, {NL}, {NL} || '> '), '')
      || coalesce({NL} || '> Am Tag ' || turn || ' schrieb sie:' || {NL} || '>> '
                  || replace(prev2, {NL}, {NL} || '>> '), ''),
      '(?m)^From ', '>From ', 'g') AS body,
    role || '@example.com' AS from_addr,
    'conv ' || conv_id AS subject,
    1704067200 + conv_id * 3600 + turn * 60 AS sent_s,
    strftime(to_timestamp(1704067200 + conv_id * 3600 + turn * 60) AT TIME ZONE 'UTC',
             '%Y-%m-%dT%H:%M:%S+00:00') AS date_iso
  FROM linked)"""

QUOTES = f"""
split_lines AS (
  SELECT conv_id, turn, unnest(string_split(body, {NL})) AS l,
         generate_subscripts(string_split(body, {NL}), 1) AS pos FROM mails),
leveled AS (
  SELECT conv_id, turn, pos, length(regexp_extract(l, '^>*')) AS level,
         regexp_replace(l, '^>*[{WS}]*', '') AS line FROM split_lines),
grouped AS (
  SELECT conv_id, turn, level, min(pos) AS seen,
         trim(string_agg(line, {NL} ORDER BY pos), {TRIM}) AS txt
  FROM leveled GROUP BY conv_id, turn, level),
entries AS (
  SELECT conv_id, turn, level, seen,
    CASE WHEN regexp_matches(txt, '(?ms){ATTRIBUTION}')
         THEN trim(regexp_replace(txt, '(?ms){ATTRIBUTION}', '', 'g'), {TRIM}) ELSE txt END AS entry
  FROM grouped),
threads AS (
  SELECT conv_id, turn, arg_min(entry, seen) AS main,
         list_reverse(list(entry ORDER BY seen)[2:]) AS thread
  FROM entries GROUP BY conv_id, turn),
split_mails AS (SELECT m.*, t.main, t.thread FROM mails m JOIN threads t USING (conv_id, turn))"""

# The first sentence: up to a mark followed by whitespace or the end.
SENTENCE = rf"(?s)\A[{WS}]*(.+?[.!?])(?:[{WS}]|\z)"

BUCKETS = """regexp_extract_all(' ' || {text} || ' ', '(?s).')"""

PROFILE = f"""
doc_chars AS (SELECT doc_id, lang, {BUCKETS.format(text='text')} AS c FROM documents),
doc_grams AS (
  SELECT doc_id, lang, unnest(list_transform(range(1, len(c) - 1),
    lambda i: (ord(c[i]) * 961 + ord(c[i + 1]) * 31 + ord(c[i + 2])) % 65536)) AS bucket
  FROM doc_chars),
profile AS (SELECT lang, bucket, count(*) AS n FROM doc_grams GROUP BY lang, bucket),
totals AS (SELECT lang, sum(n) AS total FROM profile GROUP BY lang),
floors AS (SELECT lang, CAST(round(ln(1 / (total + 65536)) * 1000000) AS BIGINT) AS lp0 FROM totals),
logs AS (SELECT lang, bucket, CAST(round(ln((n + 1) / (total + 65536)) * 1000000) AS BIGINT) AS lp
         FROM profile JOIN totals USING (lang))"""

DOC_LANG = """
doc_counts AS (SELECT doc_id, bucket, count(*) AS k FROM doc_grams GROUP BY doc_id, bucket),
doc_scores AS (
  SELECT doc_id, f.lang, sum(k * coalesce(lp, lp0)) AS score
  FROM doc_counts CROSS JOIN floors f LEFT JOIN logs l ON l.lang = f.lang AND l.bucket = doc_counts.bucket
  GROUP BY doc_id, f.lang),
doc_best AS (
  SELECT doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, lang) AS r
                            FROM doc_scores) WHERE r = 1),
detected AS (
  SELECT d.doc_id, d.source, CASE WHEN regexp_matches(d.text, '\\p{L}') THEN b.lang END AS lang
  FROM documents d LEFT JOIN doc_best b USING (doc_id))"""

MAIL_LANG = f"""
mail_chars AS (SELECT conv_id, turn, {BUCKETS.format(text='main')} AS c FROM split_mails),
mail_counts AS (
  SELECT conv_id, turn, bucket, count(*) AS k FROM (
    SELECT conv_id, turn, unnest(list_transform(range(1, len(c) - 1),
      lambda i: (ord(c[i]) * 961 + ord(c[i + 1]) * 31 + ord(c[i + 2])) % 65536)) AS bucket
    FROM mail_chars) GROUP BY conv_id, turn, bucket),
mail_scores AS (
  SELECT conv_id, turn, f.lang, sum(k * coalesce(lp, lp0)) AS score
  FROM mail_counts CROSS JOIN floors f
  LEFT JOIN logs l ON l.lang = f.lang AND l.bucket = mail_counts.bucket
  GROUP BY conv_id, turn, f.lang),
mail_lang AS (
  SELECT conv_id, turn, lang FROM (
    SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY score DESC, lang) AS r
    FROM mail_scores) WHERE r = 1)"""


def flags(language: bool) -> str:
    detect = (
        """WHEN NOT coalesce(CASE WHEN regexp_matches(main, '\\p{L}') THEN lang END = 'en', false)
                THEN 'non_english'"""
        if language
        else ""
    )
    join = "LEFT JOIN mail_lang USING (conv_id, turn)" if language else ""
    more = f",{PROFILE},{MAIL_LANG}" if language else ""
    return f"""WITH {MAILS},{QUOTES}{more},
flagged AS (
  SELECT split_mails.*,
    CASE WHEN NOT {FROM_SENDERS} THEN 'other_sender'
         WHEN contains(body, {lit(FORWARD_TAG)}) THEN 'forwarded'
         WHEN len({words('main')}) < 10 THEN 'short'
         {detect}
         ELSE 'clean' END AS reason
  FROM split_mails {join})"""


SPLIT_DOCS = """
ranked_docs AS (
  SELECT *, row_number() OVER (ORDER BY md5('41:' || doc_id)) AS place,
         count(*) OVER () AS n FROM documents),
split_docs AS (
  SELECT *, CASE WHEN place <= CAST(floor(n * (1 - 0.2::DOUBLE)) AS BIGINT)
                 THEN 'train' ELSE 'test' END AS split FROM ranked_docs)"""

KNN = """
vecs AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
dists AS (
  SELECT q.vec_id AS query_id, c.vec_id AS chunk_id,
         list_sum(list_transform(list_zip(q.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d2
  FROM vecs q CROSS JOIN vecs c),
hits AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d2, chunk_id) AS rank FROM dists)
  WHERE rank <= 5)"""
HIT_COLUMNS = "query_id, rank, chunk_id, round(1 - d2 / sqrt(2), 6) AS score"

# Neighbours among documents; vectors repeat where documents outnumber them.
RAFT = """
rows AS (SELECT doc_id, text, CAST(embedding AS DOUBLE[]) AS e
         FROM documents JOIN embeddings ON vec_id = doc_id % (SELECT count(*) FROM embeddings)),
dists AS (
  SELECT q.doc_id, c.doc_id AS chunk_id, q.text AS own, c.text AS chunk,
         list_sum(list_transform(list_zip(q.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d2
  FROM rows q CROSS JOIN rows c),
hits AS (
  SELECT *, 1 - d2 / sqrt(2) AS score
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY d2, chunk_id) AS rank FROM dists)
  WHERE rank <= 5),
found AS (SELECT * FROM hits WHERE {condition} AND NOT contains(own, chunk)),
near AS (
  SELECT rows.doc_id, any_value(rows.text) AS text, count(chunk_id) AS n_hits,
         coalesce(string_agg(chunk_id, ',' ORDER BY rank), '') AS hit_ids,
         coalesce(sum(score), 0) AS score_sum,
         coalesce(string_agg('E-MAIL CONTENT:' || chr(10) || chunk || chr(10) || chr(10) || '---'
                             || chr(10) || chr(10), '' ORDER BY rank), '') AS context
  FROM rows LEFT JOIN found USING (doc_id) GROUP BY rows.doc_id)"""

GRADED = f"""{MAILS},
samples AS (SELECT email_id AS sample_id, text AS response FROM mails
            WHERE role = 'assistant' AND prev IS NOT NULL),
goldens AS (
  SELECT email_id AS sample_id, 0 AS golden_no, prev AS golden FROM mails
  WHERE role = 'assistant' AND prev IS NOT NULL
  UNION ALL
  SELECT email_id, 1, prev2 FROM mails WHERE role = 'assistant' AND prev2 IS NOT NULL)"""


def grams(source: str, keys: str, tokens: str, max_n: int) -> str:
    return f"""
  SELECT {keys}, len(t) AS tlen, n, unnest(list_transform(range(1, len(t) - n + 2),
    lambda i: array_to_string(t[i : i + n - 1], ' '))) AS gram
  FROM (SELECT {keys}, {tokens} AS t FROM {source}), range(1, {max_n + 1}) r(n)"""


BLEU_SCORES = f"""
cand AS (SELECT sample_id, n, gram, count(*) AS c FROM ({grams('samples', 'sample_id', words(normal('response')), 4)}) GROUP BY ALL),
gold AS (SELECT sample_id, golden_no, n, gram, count(*) AS c FROM ({grams('goldens', 'sample_id, golden_no', words(normal('golden')), 4)}) GROUP BY ALL),
most AS (SELECT sample_id, n, gram, max(c) AS m FROM gold GROUP BY ALL),
clipped AS (SELECT sample_id, n, sum(least(c, m)) AS hits FROM cand JOIN most USING (sample_id, n, gram) GROUP BY ALL),
lens AS (SELECT sample_id, len({words(normal('response'))}) AS clen FROM samples),
glens AS (SELECT sample_id, golden_no, len({words(normal('golden'))}) AS glen FROM goldens),
closest AS (
  SELECT sample_id, clen, glen FROM (
    SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY abs(clen - glen), golden_no) AS r
    FROM lens JOIN glens USING (sample_id)) WHERE r = 1),
orders AS (
  SELECT sample_id, clen, glen, n, coalesce(hits, 0) / nullif(greatest(clen - n + 1, 0), 0) AS p
  FROM closest CROSS JOIN range(1, 5) r(n) LEFT JOIN clipped USING (sample_id, n)),
precisions AS (
  SELECT sample_id, clen, glen,
    max(coalesce(p, 0)) FILTER (n = 1) AS p1, max(coalesce(p, 0)) FILTER (n = 2) AS p2,
    max(coalesce(p, 0)) FILTER (n = 3) AS p3, max(coalesce(p, 0)) FILTER (n = 4) AS p4,
    CASE WHEN clen > glen THEN 1.0 ELSE exp(1 - glen / nullif(clen, 0)) END AS bp
  FROM orders GROUP BY sample_id, clen, glen),
bleus AS (
  SELECT sample_id,
    CASE WHEN p1 > 0 THEN bp * p1 ELSE 0.0 END AS b1,
    CASE WHEN least(p1, p2) > 0 THEN bp * pow(p1 * p2, 1 / 2.0::DOUBLE) ELSE 0.0 END AS b2,
    CASE WHEN least(p1, p2, p3) > 0 THEN bp * pow(p1 * p2 * p3, 1 / 3.0::DOUBLE) ELSE 0.0 END AS b3,
    CASE WHEN least(p1, p2, p3, p4) > 0 THEN bp * pow(p1 * p2 * p3 * p4, 1 / 4.0::DOUBLE) ELSE 0.0 END AS b4
  FROM precisions),
bleu_scores AS (SELECT *, (b1 + b2 + b3 + b4) / 4 AS b FROM bleus)"""

BLEU = f"{GRADED},{BLEU_SCORES}"

# Echoed prompts as replies; all messages that answer one text are its goldens.
EVALUATED = f"""{MAILS},
answers AS (SELECT *, conv_id * 1000 + turn AS seq FROM mails WHERE role = 'assistant' AND prev IS NOT NULL),
asked AS (SELECT prev, coalesce(arg_max(coalesce(prev2, ''), seq), '') AS head FROM answers GROUP BY prev),
samples AS (
  SELECT md5(prev) AS sample_id, 'Received: ' || {SYSTEM}
    || trim(replace({lit(THREAD_PREAMBLE)}, '{{threading_context}}',
            CASE WHEN head <> '' THEN head || {NL} || {NL} || '---' || {NL} || {NL} ELSE '' END), {TRIM})
    || {NL} || {NL} || 'Instruction: ' || prev AS response FROM asked),
goldens AS (SELECT md5(prev) AS sample_id, seq AS golden_no, text AS golden FROM answers)"""

ROUGE = f"""
rcand AS (SELECT sample_id, n, gram, count(*) AS c FROM ({grams('samples', 'sample_id', rouge_words('response'), 2)}) GROUP BY ALL),
rgold AS (SELECT sample_id, golden_no, n, gram, count(*) AS k FROM ({grams('goldens', 'sample_id, golden_no', rouge_words('golden'), 2)}) GROUP BY ALL),
rhits AS (SELECT sample_id, golden_no, sum(least(c, k)) FILTER (n = 1) AS h1, sum(least(c, k)) FILTER (n = 2) AS h2
          FROM rcand JOIN rgold USING (sample_id, n, gram) GROUP BY ALL),
rpairs AS (
  SELECT s.sample_id, g.golden_no, len({rouge_words('response')}) AS cl, len({rouge_words('golden')}) AS gl,
         coalesce(h1, 0) AS h1, coalesce(h2, 0) AS h2
  FROM samples s JOIN goldens g USING (sample_id) LEFT JOIN rhits USING (sample_id, golden_no)),
rbest AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY sample_id
      ORDER BY coalesce(2 * h1 / nullif(cl + gl, 0), 0) DESC, golden_no) AS r FROM rpairs) WHERE r = 1),
rscores AS (
  SELECT sample_id,
    coalesce(h1 / nullif(cl, 0), 0) AS p1, coalesce(h1 / nullif(gl, 0), 0) AS r1,
    coalesce(h2 / nullif(cl - 1, 0), 0) AS p2, coalesce(h2 / nullif(gl - 1, 0), 0) AS r2 FROM rbest),
rouge_scores AS (
  SELECT *, coalesce(2 * p1 * r1 / nullif(p1 + r1, 0), 0) AS f1,
         coalesce(2 * p2 * r2 / nullif(p2 + r2, 0), 0) AS f2 FROM rscores)"""

# The longest common subsequence as the longest increasing sequence of matching places: for
# every length the smallest place it can end at. A place is a list of one, as the result is a list.
LONGEST = f"""
lpairs AS (
  SELECT b.sample_id, cl, gl, {rouge_words('response')} AS c, {rouge_words('golden')} AS g
  FROM rbest b JOIN samples USING (sample_id) JOIN goldens o ON o.sample_id = b.sample_id AND o.golden_no = b.golden_no),
lwalk AS (
  SELECT sample_id, flatten(list_transform(g, lambda t: [[j] FOR j IN range(len(c), 0, -1) IF c[j] = t])) AS places
  FROM lpairs),
lcs AS (
  SELECT sample_id, len(list_reduce(coalesce(places, []::BIGINT[][]),
    lambda acc, x: list_filter(acc, lambda e: e < x[1]) || x || list_filter(acc, lambda e: e >= x[1])[2:], []::BIGINT[])) AS n
  FROM lwalk),
longest AS (
  SELECT b.sample_id, coalesce(n, 0) / nullif(cl, 0) AS p0, coalesce(n, 0) / nullif(gl, 0) AS r0,
         coalesce(p0, 0) AS pl, coalesce(r0, 0) AS rl, coalesce(2 * pl * rl / nullif(pl + rl, 0), 0) AS fl
  FROM rbest b LEFT JOIN lcs USING (sample_id))"""

# Every earlier turn of a conversation is a golden of a reply.
ALL_GOLDENS = f"""{MAILS},
samples AS (SELECT email_id AS sample_id, conv_id, turn, text AS response FROM mails
            WHERE role = 'assistant' AND prev IS NOT NULL),
goldens AS (SELECT s.sample_id, m.turn AS golden_no, m.text AS golden
            FROM samples s JOIN mails m ON m.conv_id = s.conv_id AND m.turn < s.turn)"""

PERPLEXITY = f"""{SPLIT_DOCS},
toks AS (SELECT doc_id, split, {words(normal('text'))} AS t FROM split_docs),
pairs AS (
  SELECT doc_id, split, unnest(list_transform(range(1, len(t)), lambda i: {{'a': t[i], 'b': t[i + 1]}})) AS p
  FROM toks),
big AS (SELECT doc_id, split, p.a AS w1, p.b AS w2 FROM pairs),
c12 AS (SELECT w1, w2, count(*) AS n12 FROM big WHERE split = 'train' GROUP BY ALL),
c1 AS (SELECT w1, sum(n12) AS n1 FROM c12 GROUP BY ALL),
vocab AS (SELECT count(*) AS v FROM (SELECT w1 FROM c12 UNION SELECT w2 FROM c12)),
lps AS (
  SELECT doc_id, ln((coalesce(n12, 0) + 1) / (coalesce(n1, 0) + v)) AS lp
  FROM big LEFT JOIN c12 USING (w1, w2) LEFT JOIN c1 USING (w1) CROSS JOIN vocab
  WHERE split = 'test')"""


def marker_case(slot: int) -> str:
    llama, mistral, phi = (lit(CHAT_MARKERS[f][slot]) for f in ("llama", "mistral", "phi"))
    return f"CASE conv_id % 3 WHEN 0 THEN {llama} WHEN 1 THEN {mistral} ELSE {phi} END"


PAIRS = f"""{MAILS},
pairs AS (
  SELECT conv_id, turn,
    {marker_case(0)} || {SYSTEM} || 'I am Pat.' || {NL} || {NL} || 'Instruction: ' || prev
      || {marker_case(1)} || {marker_case(2)} AS prompt,
    trim(text, {TRIM}) || {marker_case(3)} AS response
  FROM mails WHERE role = 'assistant' AND prev IS NOT NULL)"""

CLEAN_THREAD = f"array_to_string(list_transform(thread, lambda x: trim(x, {TRIM})), {NL} || '==' || {NL})"

PARTS = f"""{MAILS},
sent AS (
  SELECT *, strftime(to_timestamp(sent_s + 7200) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S+02:00') AS iso2
  FROM mails),
parts AS (
  SELECT email_id AS msg_id, p.part_no, 'A Person <' || from_addr || '>' AS from_addr, subject,
         iso2 AS date_iso, sent_s * 1000000 AS date_us,
         CASE p.part_no WHEN 1 THEN 'text/html' ELSE 'text/plain' END AS content_type,
         trim(CASE p.part_no WHEN 0 THEN body WHEN 1 THEN '<p>' || subject || '</p>' ELSE text END,
              {TRIM}) AS payload
  FROM sent CROSS JOIN range(0, 3) p(part_no))"""

CHUNKS_1000 = """
sizes AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE length(text) > 0),
chunks AS (
  SELECT doc_id, substring(text, CAST(i * 900 + 1 AS BIGINT), 1000) AS chunk
  FROM sizes, range(0, 100000) r(i)
  WHERE i = 0 OR i * 900 + 100 < n)"""


def weights(name: str, source: str, keys: str) -> str:
    """Unit vectors of hashed terms with idf: (keys, bucket, w) as ``name``."""
    return f"""
{name}_words AS (SELECT {keys}, unnest({words(normal('text'))}) AS word FROM {source}),
{name}_tf AS (
  SELECT {keys}, ('0x' || substring(md5(word), 1, 7))::BIGINT % 256 AS bucket, count(*) AS tf FROM {name}_words GROUP BY ALL),
{name} AS (
  SELECT {keys}, bucket, CAST(tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY {keys})) AS FLOAT)::DOUBLE AS w
  FROM {name}_tf JOIN idf USING (bucket) WHERE idf > 0)"""


IDF = f"""
seen AS (
  SELECT DISTINCT doc_id, ('0x' || substring(md5(word), 1, 7))::BIGINT % 256 AS bucket
  FROM (SELECT doc_id, unnest({words(normal('text'))}) AS word FROM documents)),
idf AS (
  SELECT b AS bucket, ln(((SELECT count(*) FROM documents) + 1) / (count(doc_id) + 1)) AS idf
  FROM range(0, 256) r(b) LEFT JOIN seen ON bucket = b GROUP BY b)"""

NUMBERED_CHUNKS = """
cut AS (
  SELECT doc_id, i AS chunk_no, substring(text, CAST(i * 900 + 1 AS BIGINT), 1000) AS text
  FROM documents, range(0, 100000) r(i)
  WHERE length(text) > 0 AND (i = 0 OR i * 900 + 100 < length(text)))"""


def recursive_chunks(size: int, overlap: int) -> str:
    """Cut at paragraphs, lines, blanks, characters; neighbours are packed up to ``size``.

    ``items`` are texts that still have to be cut and, with ``small``, pieces that are not.
    A run are small pieces between two large ones; a step has the piece a chunk begins with
    and the one behind its end, found on the running lengths ``p`` of its run.
    """
    return f"""
WITH RECURSIVE seps AS (SELECT * FROM (VALUES (1, {NL} || {NL}), (2, {NL}), (3, ' '), (4, '')) v(level, sep)),
items AS (
  SELECT doc_id, []::BIGINT[] AS path, text, 1 AS level, false AS small FROM documents WHERE text IS NOT NULL
  UNION ALL
  SELECT doc_id, list_append(path, k), piece, level + 1, length(piece) < {size} FROM (
    SELECT doc_id, path, level, k, CASE WHEN k > 1 THEN sep || pieces[k] ELSE pieces[k] END AS piece FROM (
      SELECT *, unnest(range(1, len(pieces) + 1)) AS k FROM (
        SELECT i.doc_id, i.path, s.level, s.sep, string_split(i.text, s.sep) AS pieces
        FROM items i JOIN seps s ON NOT i.small AND s.level = (
          SELECT min(t.level) FROM seps t WHERE t.level >= i.level AND (t.sep = '' OR contains(i.text, t.sep)))
        WHERE i.level <= 4))) WHERE piece <> ''),
siblings AS (
  SELECT doc_id, path[:-2] AS parent, path[-1] AS k, path, text, small,
         count(*) FILTER (NOT small) OVER (PARTITION BY doc_id, path[:-2] ORDER BY path[-1]) AS run
  FROM items WHERE len(path) > 0),
runs AS (
  SELECT doc_id, parent, run, min(path) AS place, list(text ORDER BY k) AS t,
         list_prepend(0::BIGINT, list(upto ORDER BY k)) AS p
  FROM (SELECT *, sum(length(text)) OVER (PARTITION BY doc_id, parent, run ORDER BY k)::BIGINT AS upto FROM siblings WHERE small)
  GROUP BY doc_id, parent, run),
steps AS (
  SELECT doc_id, place, t, p, 1 AS no, 1::BIGINT AS a,
         coalesce(list_filter(range(1, len(t) + 1), lambda e: p[e + 1] > {size})[1], len(t) + 1) AS b FROM runs
  UNION ALL
  SELECT doc_id, place, t, p, no + 1, s,
         coalesce(list_filter(range(b, len(t) + 1), lambda e: p[e + 1] - p[s] > {size})[1], len(t) + 1)
  FROM (SELECT *, list_filter(range(a, b + 1), lambda x: x = b
                  OR (p[b] - p[x] <= {overlap} AND p[b + 1] - p[x] <= {size}))[1] AS s FROM steps WHERE b <= len(t))),
chunks AS (
  SELECT doc_id, place, no, trim(array_to_string(t[a:b - 1], ''), {TRIM}) AS chunk FROM steps)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY place, no) - 1 AS BIGINT) AS chunk_no, chunk
FROM chunks WHERE chunk <> ''"""


def events_by_day() -> str:
    return """SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS reason, count(*) AS n
              FROM events GROUP BY ALL"""


ORACLES: dict[str, str] = {
    "clean_flags": f"{flags(True)} SELECT conv_id, turn, reason FROM flagged",
    "clean_emails": f"""{flags(False)}
        SELECT conv_id, turn, trim(main, {TRIM}) AS email, {CLEAN_THREAD} AS thread,
               len(thread) AS n_thread, subject, date_iso FROM flagged WHERE reason = 'clean'""",
    "discard_stats": f"{flags(True)} SELECT reason, count(*) AS n FROM flagged GROUP BY reason",
    "discard_report": f"""{flags(False)}
        SELECT coalesce(role, '(all)') AS mailbox, coalesce(reason, '(all)') AS reason, count(*) AS n
        FROM flagged GROUP BY ROLLUP (role, reason)""",
    "quote_levels": f"""WITH {MAILS},{QUOTES}
        SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn ORDER BY seen) - 1 AS place,
               level, txt AS text FROM grouped""",
    "strip_attribution": f"""WITH {MAILS}
        SELECT conv_id, turn, CASE WHEN regexp_matches(body, '(?ms){ATTRIBUTION}')
          THEN trim(regexp_replace(body, '(?ms){ATTRIBUTION}', '', 'g'), {TRIM}) ELSE body END AS kept
        FROM mails""",
    "drop_quoted_lines": f"""WITH {MAILS}
        SELECT conv_id, turn, array_to_string(list_filter(string_split(body, {NL}),
               lambda l: NOT starts_with(l, '>')), {NL}) AS kept FROM mails""",
    "forwarded_filter": f"WITH {MAILS} SELECT conv_id, turn FROM mails WHERE contains(body, {lit(FORWARD_TAG)})",
    "sender_filter": f"""WITH {MAILS}
        SELECT conv_id, turn, string_split(from_addr, '@')[1] AS username FROM mails WHERE {FROM_SENDERS}""",
    "thread_so_far": f"""
        SELECT conv_id, turn, count(*) OVER w AS n_before,
               coalesce(array_to_string((list(text) OVER w)[1:3], {NL} || '==' || {NL}), '') AS thread
        FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn
                                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    "thread_rows": """
        SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n_before, text
        FROM conversations""",
    "previous_messages": f"WITH {MAILS} SELECT conv_id, turn, prev, prev2 FROM mails",
    "lang_id": f"WITH {PROFILE},{DOC_LANG} SELECT doc_id, lang FROM detected",
    "lang_filter": f"WITH {PROFILE},{DOC_LANG} SELECT doc_id, source FROM detected WHERE lang = 'en'",
    "lang_profile": f"WITH {PROFILE} SELECT lang, CAST(bucket AS BIGINT) AS bucket, n FROM profile",
    "word_counts": f"SELECT doc_id, len({words('text')}) AS n_words FROM documents",
    "short_filter": f"SELECT doc_id, lang FROM documents WHERE len({words('text')}) < 10",
    "normalised_text": f"SELECT doc_id, {normal('text')} AS normalised FROM documents",
    "ngram_counts": f"""
        SELECT n, gram, count(*) AS occurrences
        FROM ({grams('conversations', 'conv_id', words(normal('text')), 3)}) GROUP BY n, gram""",
    "iso_dates": """
        SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f')
                 || CASE WHEN user_id % 2 = 0 THEN '+02:00' ELSE '' END AS date_iso,
               epoch_us(ts) - CASE WHEN user_id % 2 = 0 THEN 7200000000 ELSE 0 END AS utc_us
        FROM events""",
    "split_random": f"WITH {SPLIT_DOCS} SELECT doc_id, split FROM split_docs",
    "split_chrono": """
        WITH r AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS place,
                          count(*) OVER () AS n FROM events)
        SELECT event_id, CASE WHEN place <= CAST(floor(n * (1 - 0.2::DOUBLE)) AS BIGINT)
                              THEN 'train' ELSE 'test' END AS split FROM r""",
    "split_zero": "SELECT doc_id, s AS split FROM documents, (VALUES ('train'), ('test')) v(s)",
    "sample_exact": """
        SELECT doc_id, lang FROM documents ORDER BY md5('41:' || doc_id) LIMIT 128""",
    "train_test_leak": f"""WITH {SPLIT_DOCS}
        SELECT md5(text) AS body_md5, count(*) FILTER (split = 'train') AS n_train,
               count(*) FILTER (split = 'test') AS n_test
        FROM split_docs GROUP BY md5(text) HAVING n_train > 0 AND n_test > 0""",
    "merge_mailboxes": """
        SELECT 'documents' AS mailbox, CAST(doc_id AS VARCHAR) AS key, lang, md5(text) AS body_md5 FROM documents
        UNION ALL
        SELECT 'conversations', conv_id || '-' || turn, NULL, md5(text) FROM conversations""",
    "json_roundtrip": f"""WITH {MAILS}
        SELECT body AS email, subject,
               array_to_string(list_filter([prev2, prev], lambda x: x IS NOT NULL), {NL} || '==' || {NL}) AS thread,
               date_iso, sent_s * 1000000 AS date_us,
               CASE WHEN turn = 0 THEN text END AS summary FROM mails""",
    "serialize_email": f"""WITH {MAILS}
        SELECT conv_id, turn, md5(CAST(to_json({{'email': body, 'subject': subject,
               'thread': list_filter([prev2, prev], lambda x: x IS NOT NULL), 'date': date_iso,
               'summary': CASE WHEN turn = 0 THEN text END}}) AS VARCHAR)) AS json_md5 FROM mails""",
    "backfill_v1": """
        SELECT conv_id, turn, text AS email, '' AS subject, CAST(0 AS BIGINT) AS n_thread,
               CAST(NULL AS BIGINT) AS date_us, CAST(NULL AS VARCHAR) AS summary FROM conversations""",
    "mime_parts": f"WITH {PARTS} SELECT * FROM parts",
    "mbox_ids": f"""WITH {MAILS},
        raws AS (
          SELECT turn, md5('From: A Person <' || from_addr || '>' || {NL} || 'Subject: ' || subject || {NL} || 'Date: '
            || strftime(to_timestamp(sent_s + 7200) AT TIME ZONE 'UTC', '%a, %d %b %Y %H:%M:%S') || ' +0200' || {NL}
            || 'MIME-Version: 1.0' || {NL} || 'Content-Type: multipart/mixed; boundary="=_part"' || {NL} || {NL}
            || '--=_part' || {NL} || 'Content-Type: text/plain; charset=utf-8' || {NL}
            || 'Content-Transfer-Encoding: 8bit' || {NL} || {NL} || body
            || {NL} || '--=_part' || {NL} || 'Content-Type: text/html; charset=utf-8' || {NL} || {NL} || '<p>' || subject || '</p>'
            || {NL} || '--=_part' || {NL} || 'Content-Type: text/plain' || {NL} || 'Content-Transfer-Encoding: base64' || {NL} || {NL}
            || rtrim(regexp_replace(base64(encode(text)), '(.{{76}})', '\\1' || chr(13) || {NL}, 'g'), chr(13) || {NL})
            || {NL} || '--=_part--') AS digest FROM mails)
        SELECT digest, CASE WHEN turn % 4 = 0 THEN 2 ELSE 1 END::BIGINT AS n_rows,
               CASE WHEN turn % 4 = 0 THEN 2 ELSE 1 END::BIGINT AS n_ids,
               CASE WHEN turn % 4 = 0 THEN digest || '#1' ELSE digest END AS last_id FROM raws""",
    "mail_dates": f"""WITH {MAILS},
        zoned AS (
          SELECT *, turn % 7 AS form, conv_id % 5 AS zone,
            CASE conv_id % 5 WHEN 0 THEN 120 WHEN 1 THEN -210 WHEN 2 THEN -300 ELSE 0 END AS minutes,
            CASE conv_id % 5 WHEN 0 THEN '+02:00' WHEN 1 THEN '-03:30' WHEN 2 THEN '-05:00' WHEN 3 THEN '+00:00' ELSE '' END AS suffix
          FROM mails)
        SELECT email_id,
          CASE WHEN form NOT IN (3, 5) THEN
            strftime(to_timestamp(sent_s + minutes * 60) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S') || suffix END AS date_iso,
          CASE WHEN form NOT IN (3, 5) THEN sent_s * 1000000 END AS date_us,
          CASE turn % 3 WHEN 0 THEN 'Re: Grüße ' || conv_id WHEN 1 THEN 'Grüße ' || conv_id ELSE subject END AS subject,
          CASE form WHEN 3 THEN 'missing_date' WHEN 5 THEN 'bad_date' END AS reason
        FROM zoned""",
    "report_round_trip": f"""WITH {BLEU}
        SELECT sample_id, round(b, 6) AS bleu, round(avg(b) OVER (), 6) AS mean FROM bleu_scores""",
    "mbox_scan": f"WITH {PARTS} SELECT * EXCLUDE (msg_id) FROM parts",
    "extract_mailbox": f"""{flags(False)},
        twice AS (
          SELECT subject, strftime(to_timestamp(sent_s + 7200) AT TIME ZONE 'UTC',
                                   '%Y-%m-%dT%H:%M:%S+02:00') AS date_iso,
                 trim(main, {TRIM}) AS email, {CLEAN_THREAD} AS thread
          FROM flagged WHERE reason = 'clean'
          UNION ALL
          SELECT subject, strftime(to_timestamp(sent_s + 7200) AT TIME ZONE 'UTC',
                                   '%Y-%m-%dT%H:%M:%S+02:00'),
                 CASE WHEN regexp_matches(own, '(?ms){ATTRIBUTION}')
                      THEN trim(regexp_replace(own, '(?ms){ATTRIBUTION}', '', 'g'), {TRIM}) ELSE own END,
                 ''
          FROM (SELECT *, trim(array_to_string(list_transform(string_split(text, {NL}),
                       lambda l: regexp_replace(l, '^[{WS}]*', '')), {NL}), {TRIM}) AS own
                FROM mails WHERE {FROM_SENDERS})
          WHERE len({words('own')}) >= 10)
        SELECT * FROM twice""",
    "undecodable_parts": f"""WITH {MAILS}
        SELECT conv_id, turn, md5(from_hex('E9') || encode(body)) AS payload_md5 FROM mails WHERE turn % 3 = 0""",
    "discard_sink": f"""{flags(False)}
        SELECT 'assistant' AS user, reason, count(*) AS n, CAST(sum(length(body)) AS BIGINT) AS n_chars
        FROM flagged WHERE reason <> 'clean' GROUP BY reason""",
    "store_append": f"""WITH {CHUNKS_1000}
        SELECT doc_id, 2 * count(*) AS n_chunks, CAST(2 * sum(length(chunk)) AS BIGINT) AS n_chars,
               CAST(0 AS BIGINT) AS before FROM chunks GROUP BY doc_id""",
    "reuse_stage": "SELECT doc_id, 'first' AS version FROM documents",
    "stage_counts": """
        WITH c AS (SELECT count(*) AS n FROM documents, range(0, 100000) r(i)
                   WHERE length(text) > 0 AND (i = 0 OR i * 400 + 100 < length(text)))
        SELECT (SELECT count(*) FROM documents) AS n_documents, n AS n_chunks, n AS n_written FROM c""",
    "chunk_fixed": """
        SELECT doc_id, i AS chunk_no, substring(text, CAST(i * 400 + 1 AS BIGINT), 500) AS chunk
        FROM documents, range(0, 100000) r(i)
        WHERE length(text) > 0 AND (i = 0 OR i * 400 + 100 < length(text))""",
    "chunk_recursive": recursive_chunks(500, 100),
    "document_store": """
        SELECT doc_id, lang, source, CAST(ceil(coalesce(length(text), 0) / 700) AS BIGINT) AS n_chunks,
               CAST(coalesce(length(text), 0) AS BIGINT) AS n_chars FROM documents""",
    "embed_documents": f"""WITH {IDF},{weights('vecs', 'documents', 'doc_id')}
        SELECT doc_id, bucket, round(w, 6) AS weight FROM vecs WHERE w > 0""",
    "build_index": f"""WITH {IDF},{NUMBERED_CHUNKS},{weights('vecs', 'cut', 'doc_id, chunk_no')}
        SELECT doc_id, chunk_no, any_value(text) AS chunk, count(w) AS n_buckets, coalesce(round(sum(w), 6), 0.0) AS weight_sum
        FROM cut LEFT JOIN vecs USING (doc_id, chunk_no) GROUP BY doc_id, chunk_no""",
    "search_text": f"""WITH {IDF},{NUMBERED_CHUNKS},{weights('vecs', 'cut', 'doc_id, chunk_no')},
        {weights('asked', 'benchmark', 'item_id')},
        norms AS (SELECT doc_id, chunk_no, coalesce(sum(w * w), 0) AS c2 FROM cut LEFT JOIN vecs USING (doc_id, chunk_no)
                  GROUP BY ALL),
        own AS (SELECT item_id, coalesce(sum(w * w), 0) AS q2 FROM benchmark LEFT JOIN asked USING (item_id) GROUP BY ALL),
        dots AS (SELECT item_id, doc_id, chunk_no, sum(a.w * v.w) AS dot FROM asked a JOIN vecs v USING (bucket) GROUP BY ALL),
        dists AS (
          SELECT item_id AS query_id, doc_id || '#' || chunk_no AS chunk_id, q2 + c2 - 2 * coalesce(dot, 0) AS d2
          FROM own CROSS JOIN norms LEFT JOIN dots USING (item_id, doc_id, chunk_no))
        SELECT query_id, rank, chunk_id, round(1 - d2 / sqrt(2), 6) AS score FROM (
          SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(d2, 12), chunk_id) AS rank FROM dists)
        WHERE rank <= 5""",
    "raft_refilled": f"""WITH {RAFT.split('hits AS')[0].rstrip().rstrip(',')}
        SELECT doc_id, rank, chunk_id, round(1 - d2 / sqrt(2), 6) AS score FROM (
          SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY d2, chunk_id) AS rank FROM dists
          WHERE NOT contains(own, chunk)) WHERE rank <= 5""",
    "knn_exact": f"WITH {KNN} SELECT {HIT_COLUMNS} FROM hits",
    "knn_blocks": f"WITH {KNN} SELECT {HIT_COLUMNS} FROM hits",
    "knn_ivf": """
        WITH vecs AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
        pivots AS (
          SELECT row_number() OVER (ORDER BY md5(CAST(vec_id AS VARCHAR))) - 1 AS cell, e AS p
          FROM vecs ORDER BY md5(CAST(vec_id AS VARCHAR)) LIMIT 16),
        ranked AS (
          SELECT vec_id, e, cell, row_number() OVER (PARTITION BY vec_id ORDER BY
            list_sum(list_transform(list_zip(e, p), lambda x: (x[1] - x[2]) * (x[1] - x[2]))), cell) AS r
          FROM vecs CROSS JOIN pivots),
        dists AS (
          SELECT q.vec_id AS query_id, c.vec_id AS chunk_id,
            list_sum(list_transform(list_zip(q.e, c.e), lambda x: (x[1] - x[2]) * (x[1] - x[2]))) AS d2
          FROM ranked q JOIN ranked c ON q.cell = c.cell AND q.r <= 4 AND c.r = 1)
        SELECT query_id, rank, chunk_id, round(1 - d2 / sqrt(2), 6) AS score
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d2, chunk_id) AS rank FROM dists)
        WHERE rank <= 5""",
    "knn_recall": """
        WITH vecs AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
        pivots AS (
          SELECT row_number() OVER (ORDER BY md5(CAST(vec_id AS VARCHAR))) - 1 AS cell, e AS p
          FROM vecs ORDER BY md5(CAST(vec_id AS VARCHAR)) LIMIT 32),
        gaps AS (
          SELECT vec_id, e, cell, sqrt(d2) - min(sqrt(d2)) OVER (PARTITION BY vec_id) AS gap,
            row_number() OVER (PARTITION BY vec_id ORDER BY d2, cell) AS r
          FROM (SELECT vec_id, e, cell, list_sum(list_transform(list_zip(e, p),
                  lambda x: (x[1] - x[2]) * (x[1] - x[2]))) AS d2 FROM vecs CROSS JOIN pivots)),
        dists AS (
          SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, c.cell,
            list_sum(list_transform(list_zip(q.e, c.e), lambda x: (x[1] - x[2]) * (x[1] - x[2]))) AS d2
          FROM vecs q JOIN gaps c ON q.vec_id % 10 = 0 AND c.r = 1),
        exact AS (
          SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d2, chunk_id) AS rank FROM dists)
          WHERE rank <= 5),
        wide AS (
          SELECT e.query_id, e.chunk_id, e.query_id % 20 = 0 AS calibrated, g.gap FROM exact e
          JOIN gaps g ON g.vec_id = e.query_id AND g.cell = e.cell),
        slack AS (SELECT quantile_disc(gap, 0.95) + 1e-9 AS s FROM wide WHERE calibrated),
        counted AS (
          SELECT query_id, calibrated, count(*) AS n_exact, count(*) FILTER (gap <= s) AS n_found
          FROM wide, slack GROUP BY query_id, calibrated)
        SELECT *, round(sum(n_found) OVER (PARTITION BY calibrated) / sum(n_exact) OVER (PARTITION BY calibrated), 6)
          AS recall FROM counted""",
    "knn_threshold": f"WITH {KNN} SELECT {HIT_COLUMNS} FROM hits WHERE 1 - d2 / sqrt(2) >= 0.2",
    "knn_plain": f"WITH {KNN} SELECT query_id, chunk_id FROM hits",
    "knn_none": "SELECT vec_id AS query_id, CAST(0 AS BIGINT) AS n_hits FROM embeddings",
    "relevance_score": """
        WITH d AS (
          SELECT a.vec_id, list_sum(list_transform(list_zip(CAST(a.embedding AS DOUBLE[]),
                 CAST(b.embedding AS DOUBLE[])), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d2
          FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
        SELECT vec_id, round(d2, 6) AS distance2, round(1 - d2 / sqrt(2), 6) AS score FROM d""",
    "raft_neighbours": f"""WITH {RAFT.format(condition='true')}
        SELECT doc_id, n_hits, hit_ids, round(score_sum, 6) AS score_sum FROM near""",
    "containment_filter": f"""WITH {MAILS}
        SELECT conv_id, turn FROM mails WHERE prev IS NOT NULL AND NOT contains(body, prev)""",
    "rag_prompt": f"""WITH {RAFT.format(condition='score >= 0.2')},
        prompts AS (
          SELECT doc_id, {SYSTEM} || 'Sent from the office.' || {NL} || {NL}
            || trim(replace({lit(RAG_PREAMBLE)}, '{{rag_context}}', context), {TRIM}) || {NL} || {NL}
            || 'Instruction: ' || text AS prompt FROM near)
        SELECT doc_id, md5(prompt) AS prompt_md5, length(prompt) AS prompt_chars FROM prompts""",
    "legacy_prompt": f"""WITH {RAFT.format(condition='score >= 0.2')},
        prompts AS (
          SELECT doc_id, {SYSTEM}
            || CASE WHEN n_hits > 0 THEN trim(replace({lit(RAG_PREAMBLE)}, '{{rag_context}}', context), {TRIM})
                      || {NL} || {NL} ELSE '' END
            || 'Instruction: ' || text AS prompt FROM near)
        SELECT doc_id, md5(prompt) AS prompt_md5, length(prompt) AS prompt_chars FROM prompts""",
    "thread_prompt": f"""WITH {MAILS},{QUOTES}
        SELECT conv_id, turn, trim(replace({lit(THREAD_PREAMBLE)}, '{{threading_context}}',
                 CASE WHEN len(thread) > 0 THEN thread[1] || {NL} || {NL} || '---' || {NL} || {NL}
                      ELSE '' END), {TRIM})
               || {NL} || {NL} || 'Instruction: ' || main AS prompt FROM split_mails""",
    "summary_prompt": f"""
        SELECT doc_id, md5(p) AS prompt_md5, length(p) AS prompt_chars
        FROM (SELECT doc_id, trim(replace({lit(SUMMARY_TEMPLATE)}, '{{email}}', text), {TRIM}) AS p FROM documents)""",
    "chat_pairs": f"WITH {PAIRS} SELECT conv_id, turn, prompt, response FROM pairs",
    "pair_length_cap": f"""WITH {PAIRS}
        SELECT conv_id, turn, len({words('prompt')}) + len({words('response')}) <= 200 AS fits FROM pairs""",
    "chat_messages": f"""WITH {MAILS}
        SELECT conv_id, turn, p.place, CASE p.place WHEN 0 THEN 'user' ELSE 'assistant' END AS role,
               CASE p.place WHEN 0 THEN prev ELSE text END AS content
        FROM mails CROSS JOIN range(0, 2) p(place) WHERE mails.role = 'assistant' AND prev IS NOT NULL""",
    "template_fill": """
        SELECT conv_id, turn, '<{b} ' || text || '|' || role || '>' AS filled FROM conversations""",
    "instruction_extract": f"""
        SELECT conv_id, turn, list_last(string_split(role || {NL} || {NL} || 'Instruction: a' || {NL} || {NL}
               || 'Instruction: ' || text, {NL} || {NL} || 'Instruction: ')) AS instruction FROM conversations""",
    "instruction_valid": "SELECT conv_id, turn, text AS instruction FROM conversations WHERE turn % 3 = 1",
    "strip_boilerplate": f"""
        SELECT conv_id, turn, text || {NL} || 'It had no bye' AS reply FROM conversations""",
    "generated_extract": f"SELECT conv_id, turn, trim(text, {TRIM}) AS reply FROM conversations",
    "generate_echo": """
        SELECT conv_id, turn, s AS sample_no, 'Received: Instruction: ' || text AS response
        FROM conversations, range(0, 2) r(s)""",
    "generate_extractive": f"""
        WITH p AS (SELECT doc_id, list_last(string_split(trim(replace({lit(SUMMARY_TEMPLATE)}, '{{email}}', text),
                                            {TRIM}), {NL} || {NL})) AS last FROM documents)
        SELECT doc_id, CAST(0 AS BIGINT) AS sample_no, 'Instruction: Write an email saying: '
               || CASE WHEN regexp_matches(last, {lit(SENTENCE)})
                       THEN regexp_extract(last, {lit(SENTENCE)}, 1) ELSE last END AS response FROM p""",
    "golden_groups": f"""
        WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k FROM conversations),
        facts AS (SELECT conv_id, arg_max(role || '/' || turn, turn) AS thread, min(turn) AS first_seq,
                         count(*) AS n_goldens FROM conversations GROUP BY conv_id)
        SELECT conv_id, CAST(k // 3 AS BIGINT) AS slice_no,
               string_agg(text, {NL} || '==' || {NL} ORDER BY k) AS goldens,
               any_value(thread) AS thread, any_value(first_seq) AS first_seq, any_value(n_goldens) AS n_goldens
        FROM r JOIN facts USING (conv_id) GROUP BY conv_id, k // 3""",
    "bleu": f"""WITH {BLEU}
        SELECT sample_id, round(b1, 6) AS bleu1, round(b2, 6) AS bleu2, round(b3, 6) AS bleu3,
               round(b4, 6) AS bleu4, round(b, 6) AS bleu FROM bleu_scores""",
    "rouge_n": f"""WITH {GRADED},{ROUGE}
        SELECT sample_id, round(p1, 6) AS rouge1_precision, round(r1, 6) AS rouge1_recall,
               round(f1, 6) AS rouge1_fmeasure, round(p2, 6) AS rouge2_precision,
               round(r2, 6) AS rouge2_recall, round(f2, 6) AS rouge2_fmeasure FROM rouge_scores""",
    "rouge_l": f"""WITH {GRADED},{ROUGE},{LONGEST}
        SELECT sample_id, round(pl, 6) AS "rougeL_precision", round(rl, 6) AS "rougeL_recall", round(fl, 6) AS "rougeL_fmeasure",
               round(pl, 6) AS "rougeLsum_precision", round(rl, 6) AS "rougeLsum_recall", round(fl, 6) AS "rougeLsum_fmeasure"
        FROM longest""",
    "rouge_all_goldens": f"""WITH {ALL_GOLDENS},{BLEU_SCORES},{ROUGE},{LONGEST}
        SELECT sample_id, round(b, 6) AS bleu, round(f1, 6) AS rouge1_fmeasure, round(f2, 6) AS rouge2_fmeasure,
               round(fl, 6) AS "rougeL_fmeasure"
        FROM bleu_scores JOIN rouge_scores USING (sample_id) JOIN longest USING (sample_id)""",
    "metric_means": f"""WITH {BLEU},{ROUGE}
        SELECT round(avg(b), 6) AS bleu, round(avg(p1), 6) AS rouge1_precision,
               round(avg(r1), 6) AS rouge1_recall, round(avg(f1), 6) AS rouge1_fmeasure,
               round(avg(p2), 6) AS rouge2_precision, round(avg(r2), 6) AS rouge2_recall,
               round(avg(f2), 6) AS rouge2_fmeasure
        FROM bleu_scores JOIN rouge_scores USING (sample_id)""",
    "evaluate_scores": f"""WITH {EVALUATED},{BLEU_SCORES},{ROUGE}
        SELECT round(avg(b), 6) AS bleu, round(avg(p1), 6) AS rouge1_precision,
               round(avg(r1), 6) AS rouge1_recall, round(avg(f1), 6) AS rouge1_fmeasure,
               round(avg(p2), 6) AS rouge2_precision, round(avg(r2), 6) AS rouge2_recall,
               round(avg(f2), 6) AS rouge2_fmeasure
        FROM bleu_scores JOIN rouge_scores USING (sample_id)""",
    "mauve_cells": """
        WITH h AS (SELECT label, count(*) FILTER (vec_id % 2 = 0) AS p, count(*) FILTER (vec_id % 2 <> 0) AS q
                   FROM embeddings GROUP BY label),
        s AS (SELECT p / sum(p) OVER () AS p, q / sum(q) OVER () AS q FROM h),
        g AS (SELECT i, 1e-6::DOUBLE + (1 - 2e-6::DOUBLE) * i / 24 AS w FROM range(0, 25) r(i)),
        pts AS (
          SELECT i, exp(-5 * sum(CASE WHEN q > 0 THEN q * ln(q / (w * p + (1 - w) * q)) ELSE 0 END)) AS x,
                 exp(-5 * sum(CASE WHEN p > 0 THEN p * ln(p / (w * p + (1 - w) * q)) ELSE 0 END)) AS y
          FROM s CROSS JOIN g GROUP BY i
          UNION ALL SELECT -1, 1.0, 0.0 UNION ALL SELECT 25, 0.0, 1.0),
        steps AS (SELECT x, y, lead(x) OVER (ORDER BY i) AS x2, lead(y) OVER (ORDER BY i) AS y2 FROM pts)
        SELECT round((sum(abs(x2 - x) * (y + y2) / 2) + sum(abs(y2 - y) * (x + x2) / 2)) / 2, 6) AS mauve,
               (SELECT CAST(sum(p) AS BIGINT) FROM h) AS n_p, (SELECT CAST(sum(q) AS BIGINT) FROM h) AS n_q
        FROM steps WHERE x2 IS NOT NULL""",
    "bigram_perplexity": f"""WITH {PERPLEXITY}
        SELECT doc_id, count(*) AS n_bigrams, round(exp(-avg(lp)), 4) AS perplexity FROM lps GROUP BY doc_id""",
    "corpus_perplexity": f"""WITH {PERPLEXITY}
        SELECT count(DISTINCT doc_id) AS n_rows, count(*) AS n_bigrams, round(-avg(lp), 6) AS cross_entropy,
               round(exp(-avg(lp)), 4) AS perplexity FROM lps""",
    "stats_by_day": events_by_day(),
    "stream_stats_by_day": events_by_day(),
    "stream_ingested": f"""{flags(False)},
        bodies AS (SELECT email_id || '#0' AS doc_id, trim(main, {TRIM}) AS email FROM flagged WHERE reason = 'clean')
        SELECT doc_id, i AS chunk_no, substring(email, CAST(i * 400 + 1 AS BIGINT), 500) AS chunk
        FROM bodies, range(0, 100000) r(i)
        WHERE length(email) > 0 AND (i = 0 OR i * 400 + 100 < length(email))""",
}
