"""The registered queries of this subpackage, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from rushes.llm.common import read
from rushes.llm.context_tree import score_texts
from rushes.llm.conversation_repair import repair
from rushes.llm.decontaminate import decontaminate
from rushes.llm.hard_negatives import hard_negatives
from rushes.llm.html_wrapper import extract_pages
from rushes.llm.line_dedup import line_dedup
from rushes.llm.near_dedup import near_duplicates
from rushes.llm.quality_classifier import classify
from rushes.llm.quality_rules import BOILERPLATE, SENTENCE_END, SEPARATORS, SYMBOLS, quality_rules
from rushes.llm.sentencepiece_fst import encode
from rushes.llm.substring_dedup import repeated_passages
from rushes.llm.token_files import token_documents
from rushes.llm.topk_search import exact_top_k

QUERIES, SQL = {}, {}


def op3_decontaminate(spark, sf_dir):
    return decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"
    )


QUERIES["op3_decontaminate"] = op3_decontaminate
SQL["op3_decontaminate"] = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
    FROM documents),
  b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
    FROM benchmark),
  bw AS (SELECT DISTINCT item_id, unnest(CASE WHEN len(ws) < 10 THEN [ws] ELSE list_transform(range(1, len(ws) - 8), lambda i: ws[i:i + 9]) END) AS win
    FROM b WHERE len(ws) > 0),
  sizes AS (SELECT DISTINCT len(win) AS m FROM bw),
  dw AS (SELECT doc_id, m, i, ws[i:i + m - 1] AS win FROM (SELECT doc_id, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM w, sizes WHERE len(ws) >= m)),
  hit AS (SELECT doc_id, item_id, i, m FROM dw JOIN bw USING (win)),
  pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM (SELECT DISTINCT doc_id, i, m FROM hit)) GROUP BY doc_id),
  items AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(s, ',' ORDER BY s)) AS items_sha256
    FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hit) GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN pos USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def op8_line_dedup(spark, sf_dir):
    return line_dedup(read(spark, sf_dir, "documents").select("doc_id", "text"), whole=True)


QUERIES["op8_line_dedup"] = op8_line_dedup
SQL["op8_line_dedup"] = r"""
WITH l AS (SELECT doc_id, no, line, length(line) AS size FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS no FROM documents)
    WHERE trim(line) <> ''),
  p AS (SELECT *, sum(size) OVER (PARTITION BY doc_id ORDER BY no) - size AS start, sum(size) OVER (PARTITION BY doc_id ORDER BY no) AS stop FROM l),
  w AS (SELECT doc_id, no, max(no) OVER a AS last_no, sum(size) OVER a AS held, list(md5(line)) OVER a AS lines FROM p
    WINDOW a AS (PARTITION BY doc_id ORDER BY start RANGE BETWEEN CURRENT ROW AND 39 FOLLOWING)
    UNION SELECT doc_id, min(no) OVER b, no, sum(size) OVER b, list(md5(line)) OVER b FROM p
    WINDOW b AS (PARTITION BY doc_id ORDER BY stop RANGE BETWEEN 39 PRECEDING AND CURRENT ROW)),
  later AS (SELECT doc_id, no, last_no FROM (SELECT *, row_number() OVER (PARTITION BY lines ORDER BY doc_id, no) AS r FROM w WHERE held >= 40) WHERE r > 1),
  gone AS (SELECT DISTINCT doc_id, unnest(range(no, last_no + 1)) AS no FROM later),
  rest AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY no) AS text FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS no FROM documents)
    ANTI JOIN gone USING (doc_id, no) GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(rest.text, '') END AS text,
  CASE WHEN length(d.text) > 0 THEN len(string_split(d.text, chr(10))) ELSE 0 END::BIGINT AS n_lines, coalesce(n, 0)::BIGINT AS n_removed
FROM documents d LEFT JOIN rest USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) USING (doc_id)
"""


def op5_quality_rules(spark, sf_dir):
    return quality_rules(read(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


QUERIES["op5_quality_rules"] = op5_quality_rules
_SAID = "|".join(p.replace("(", r"\(").replace(")", r"\)") for p in BOILERPLATE)
SQL["op5_quality_rules"] = rf"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
  g AS (SELECT doc_id, i, ws[i:i + 2] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
  r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 3)) AS p FROM g
    WHERE (doc_id, g) IN (SELECT doc_id, g FROM g GROUP BY ALL HAVING count(*) > 1)) GROUP BY doc_id),
  l AS (SELECT doc_id, no, line, trim(line, chr(32)) AS plain, regexp_matches(line, '[^\x20\x09-\x0D]') AS held FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM w)),
  m AS (SELECT *, length(plain) - length(replace(plain, ' ', '')) + 1 AS n, regexp_matches(right(plain, 4), '{SENTENCE_END}') AS ends FROM l),
  f AS (SELECT *, held AND (len(regexp_extract_all(plain, '{SEPARATORS}')) * 4 >= n OR n <= 3 AND NOT ends OR n <= 40 AND regexp_matches(lower(plain), '{_SAID}')
      OR NOT ends AND NOT regexp_matches(plain, '{SENTENCE_END} ') OR len(regexp_extract_all(plain, '!!')) * 4 >= n
      OR len(regexp_extract_all(plain, '{SYMBOLS}')) * 4 >= n) AS fails FROM m),
  c AS (SELECT doc_id, count(*) FILTER (held) - count(DISTINCT line) FILTER (held) AS n_dup_lines,
      coalesce(sum(length(line)) FILTER (NOT fails) + count(*) FILTER (NOT fails) - 1, 0) AS clean FROM f GROUP BY doc_id),
  o AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
      len(regexp_extract_all(text, '{SYMBOLS}'))::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
      2 * (length(text) - clean) <= length(text) AS good
    FROM w JOIN c USING (doc_id) LEFT JOIN r USING (doc_id)),
  b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM o)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND good AS kept FROM b
"""


def op7_near_dedup(spark, sf_dir):
    return near_duplicates(read(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size", "kept")


QUERIES["op7_near_dedup"] = op7_near_dedup


def op1_quality_classifier(spark, sf_dir):
    return classify(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "vote_posterior", "score", "kept")


QUERIES["op1_quality_classifier"] = op1_quality_classifier


def op2_sentencepiece(spark, sf_dir):
    return encode(read(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES["op2_sentencepiece"] = op2_sentencepiece


def op9_token_files(spark, sf_dir):
    return token_documents(read(spark, sf_dir, "documents")).select("doc_id", "start", "n_tokens", "ids_crc32")


QUERIES["op9_token_files"] = op9_token_files


def op10_context_tree(spark, sf_dir):
    return score_texts(read(spark, sf_dir, "documents"), depth=5).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


QUERIES["op10_context_tree"] = op10_context_tree


def op6_substring_dedup(spark, sf_dir):
    return repeated_passages(read(spark, sf_dir, "documents")).select("doc_id", "of_doc_ids", "first_word", "n_words", "n_paragraphs")


QUERIES["op6_substring_dedup"] = op6_substring_dedup


def op4_html_extraction(spark, sf_dir):
    return extract_pages(read(spark, sf_dir, "pages"))


QUERIES["op4_html_extraction"] = op4_html_extraction


def op11_hard_negatives(spark, sf_dir):
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    rows = read(spark, sf_dir, "embeddings").select("vec_id", "embedding", moved.alias("label"))
    return hard_negatives(rows, F.col("vec_id") % 50 == 0).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


QUERIES["op11_hard_negatives"] = op11_hard_negatives
_WHOLE = "SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
SQL["op11_hard_negatives"] = f"""
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, v FROM ({_WHOLE}) WHERE label IS NOT NULL),
  s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
    FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
  p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER w::INTEGER AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 100 * score BETWEEN 50 * positive_score AND 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) QUALIFY row_number() OVER w <= 3
"""


def op12_topk_search(spark, sf_dir):
    return exact_top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


QUERIES["op12_topk_search"] = op12_topk_search
SQL["op12_topk_search"] = f"""
WITH e AS ({_WHOLE})
SELECT q.vec_id AS query_id, row_number() OVER w::INTEGER AS rank, c.vec_id AS vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
FROM e q JOIN e c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
WINDOW w AS (PARTITION BY q.vec_id ORDER BY list_dot_product(q.v, c.v) DESC, c.vec_id) QUALIFY row_number() OVER w <= 5
"""


def damaged(conversations):
    """The rows left after the damage that the query repairs, by a checksum of conversation and turn; nulls count as a space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")), F.lit(20))
    rows = conversations.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    twice = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), twice.alias("copy")).drop("copy")


def op13_conversation_repair(spark, sf_dir):
    conversations = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    found = repair(damaged(conversations)).withColumnRenamed("conv_id", "_c")
    every = conversations.select("conv_id").distinct()
    out = every.join(found, F.col("conv_id").eqNullSafe(F.col("_c")), "left")
    zeros = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    digest = F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")
    return out.select("conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"), digest)


QUERIES["op13_conversation_repair"] = op13_conversation_repair


def _add(state, cost, edits):
    return f"lpad((left({state}, 10)::BIGINT + {cost})::VARCHAR, 10, '0') || substr({state}, 11) || '{edits}'"


def _kept(state, role):
    """A row that is kept as, or made, a user or assistant row."""
    return f"CASE WHEN NOT gone THEN CASE WHEN c = '{role}' THEN {_add(state, 'more', 'K')} ELSE {_add(state, 'more + 1', 'R')} END END"


#: A state is its cost in ten digits, then its edits, so that the least string is the cheapest and then the ASCII-least.
SQL["op13_conversation_repair"] = rf"""
WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
    lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS tab),
  src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(4294967295, list_reduce(list_prepend(4294967295,
      list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda ch: ascii(ch)::BIGINT)),
      lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]))) % 20 AS kind FROM conversations, tab),
  dam AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
      CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
    FROM src WHERE kind <> 0),
  num AS (SELECT *, left(role, 1) AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(length(role) || ':' || role || text), copy) AS p,
      row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again,
      NOT regexp_matches(text, '[^ 	-
]') AS blank, regexp_matches(text, '[^.!? 	-
][ 	-
]*\z') AS cut FROM dam),
  flt AS (SELECT *, blank OR again AS gone, CASE WHEN cut AND NOT again THEN 5 ELSE 0 END AS more, lag(c) OVER (PARTITION BY conv_id ORDER BY p) || c AS pair FROM num),
  st AS (SELECT DISTINCT conv_id, 0::BIGINT AS p, '0000000000' AS s0, NULL::VARCHAR AS s1, NULL::VARCHAR AS s2, NULL::VARCHAR AS s3 FROM flt
    UNION ALL SELECT conv_id, p, {_add('s0', 2, 'D')},
      least({_add('s1', 2, 'D')}, CASE WHEN NOT gone AND c = 's' THEN {_add('s0', 'more', 'K')} END),
      least({_add('e2', 2, 'D')}, {_kept('s0', 'u')}, {_kept('s1', 'u')}, {_kept('e3', 'u')}), least({_add('e3', 2, 'D')}, {_kept('e2', 'a')})
    FROM (SELECT flt.conv_id, flt.p, c, gone, more, s0, s1, least(s2, {_add('s0', 5, 'I')}, {_add('s1', 5, 'I')}, {_add('s3', 5, 'I')}) AS e2,
        least(s3, {_add('s2', 5, 'I')}, {_add('s0', 10, 'II')}, {_add('s1', 10, 'II')}) AS e3
      FROM st JOIN flt ON flt.conv_id IS NOT DISTINCT FROM st.conv_id AND flt.p = st.p + 1)),
  fin AS (SELECT conv_id, least(s0, s3, {_add('s2', 5, 'I')}, {_add('s1', 10, 'II')}, {_add('s0', 10, 'II')}) AS best FROM st
    QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY p DESC) = 1),
  ch AS (SELECT conv_id, unnest(string_split(substr(best, 11), '')) AS e, generate_subscripts(string_split(substr(best, 11), ''), 1) AS i FROM fin),
  own AS (SELECT *, sum(CASE WHEN e = 'I' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY i) AS p FROM ch),
  got AS (SELECT o.conv_id, o.i, o.e, CASE WHEN o.e <> 'I' THEN f.role END AS role, CASE WHEN o.e <> 'I' THEN f.text ELSE '' END AS text, f.c,
      row_number() OVER (PARTITION BY o.conv_id ORDER BY o.i) - 1 AS k
    FROM own o LEFT JOIN flt f ON f.conv_id IS NOT DISTINCT FROM o.conv_id AND f.p = o.p WHERE o.e <> 'D'),
  lead AS (SELECT *, max(CASE WHEN k = 0 AND e = 'K' AND c = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS s FROM got),
  rep AS (SELECT conv_id, sha256(string_agg(CASE WHEN e = 'K' THEN role WHEN (k - s) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY i)) AS digest
    FROM lead GROUP BY conv_id),
  cnt AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate,
      count(*) FILTER (cut AND NOT again) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM flt GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(left(best, 10)::BIGINT, 0) AS cost, coalesce(substr(best, 11), '') AS audit, coalesce(digest, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN cnt ON cnt.conv_id IS NOT DISTINCT FROM o.conv_id
  LEFT JOIN fin ON fin.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN rep ON rep.conv_id IS NOT DISTINCT FROM o.conv_id
"""
