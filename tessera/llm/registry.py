"""Queries of this subpackage and their DuckDB SQL, for the driver contract."""

from __future__ import annotations

from tessera.llm.chat import TURN_SCHEMAS, link_calls, turn_calls
from tessera.llm.common import table
from tessera.llm.decontam import find_leaks
from tessera.llm.htmltext import extract_text
from tessera.llm.langid import identify_language
from tessera.llm.ngramjoin import similar_documents
from tessera.llm.packing import pack
from tessera.llm.phrases import mine_phrases
from tessera.llm.quality import fit_quality, score_quality
from tessera.llm.secrets import scan_secrets
from tessera.llm.suffixdedup import remove_repeats, repeat_digest
from tessera.llm.tokenalign import align_tokens
from tessera.llm.tokens import tokenizer_file
from tessera.llm.topk import top_k
from tessera.llm.urlfilter import QUERY_RULES, SPAM_WORDS, judge_urls


def op1_url_filters(spark, sf_dir):
    return judge_urls(table(spark, sf_dir, "pages"), QUERY_RULES)


def op2_ngram_jaccard_join(spark, sf_dir):
    return similar_documents(table(spark, sf_dir, "documents"))


def op3_chat_formatting(spark, sf_dir):
    calls, results = turn_calls(table(spark, sf_dir, "conversations"))
    return link_calls(calls, results, TURN_SCHEMAS)


def op4_language_id(spark, sf_dir):
    return identify_language(table(spark, sf_dir, "documents"))


def op5_decontamination(spark, sf_dir):
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))


def op7_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"))


def op8_secret_scans(spark, sf_dir):
    return scan_secrets(table(spark, sf_dir, "documents"))


def op9_exact_topk(spark, sf_dir):
    return top_k(table(spark, sf_dir, "embeddings"))


def op10_html_extraction(spark, sf_dir):
    return extract_text(table(spark, sf_dir, "pages"))


def op11_suffix_dedup(spark, sf_dir):
    return repeat_digest(remove_repeats(table(spark, sf_dir, "documents")))


def op12_token_alignment(spark, sf_dir):
    return align_tokens(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"),
                        tokenizer_file("piece_bpe_32k.model"))[0]


def op13_phrase_mining(spark, sf_dir):
    return mine_phrases(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_url_filters, op2_ngram_jaccard_join, op3_chat_formatting, op4_language_id,
    op5_decontamination, op6_quality, op7_packing, op8_secret_scans, op9_exact_topk, op10_html_extraction,
    op11_suffix_dedup, op12_token_alignment, op13_phrase_mining)}


def _op1_sql() -> str:
    def fits(rule):
        host, path = rule.text.split("/", 1)
        return (f"((host = '{host}' OR ends_with(host, '.{host}')) "
                f"AND starts_with(path, '/{path}'))")

    longest = sorted(QUERY_RULES, key=lambda r: (-len(r.text), r.text))
    rule = " ".join(f"WHEN {fits(r)} THEN '{r.text}'" for r in longest)
    verdict = " ".join(f"WHEN {fits(r)} THEN '{r.verdict}'" for r in longest)
    spam = f"regexp_matches(host, '(^|[.-])({'|'.join(SPAM_WORDS)})[.-]')"

    return f"""
WITH parts AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages)
SELECT page_id, host, path, CASE {rule} END AS rule,
       CASE {verdict} WHEN {spam} THEN 'block' ELSE 'allow' END AS verdict
FROM parts"""


_OP9_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS own, vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.own, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON c.own <> q.own AND len(c.v) = len(q.v)
  WHERE q.vec_id % 50 = 0),
r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY own ORDER BY score DESC, vec_id) AS INT) AS rank
  FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""

_OP2_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3),
                                      lambda i: array_to_string(ws[i:i + 4], ' '))) END AS g
  FROM w),
n AS (SELECT doc_id, len(g) AS n_shingles FROM s),
e AS (SELECT doc_id, unnest(g) AS t FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
      FROM e a JOIN e b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y
      WHERE 100 * c >= 75 * (a.n_shingles + b.n_shingles - c)),
k AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(doc_id, root) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT k.y, r.root FROM r JOIN k ON k.x = r.doc_id)
SELECT n.doc_id, n.n_shingles, m.component_id
FROM n JOIN (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id) m USING (doc_id)"""

_OP3_SQL = """
WITH m AS (
  SELECT *, CASE WHEN conv_id IS NOT NULL AND turn IS NOT NULL THEN conv_id || ':' || turn END AS own,
         CASE WHEN conv_id IS NOT NULL AND turn IS NOT NULL THEN conv_id || ':' || (turn - 1) END AS before,
         role IS NOT DISTINCT FROM 'assistant' AS answer
  FROM conversations),
c AS (
  SELECT conv_id, turn, own AS call_id, role AS name, text, len(string_split(trim(text), ' ')) AS words,
         min(turn) OVER (PARTITION BY conv_id) AS first,
         '{"text":' || coalesce(to_json(text), 'null') || ',"words":'
           || coalesce(CAST(len(string_split(trim(text), ' ')) AS VARCHAR), 'null') || '}' AS arguments
  FROM m WHERE NOT answer),
v AS (
  SELECT *, CASE WHEN own_name IS NULL THEN ['unknown tool'] ELSE list_sort(list_filter([
           CASE WHEN text IS NULL THEN 'text: missing' END,
           CASE WHEN text = '' THEN 'text: minLength' END,
           CASE WHEN text IS NULL THEN 'words: missing' END,
           CASE WHEN words < least THEN 'words: minimum' END], lambda x: x IS NOT NULL)) END AS problems
  FROM (SELECT *, CASE WHEN name IN ('system', 'user') THEN name END AS own_name,
               CASE name WHEN 'user' THEN 3 ELSE 1 END AS least,
               CASE WHEN call_id IS NULL THEN 0 ELSE row_number() OVER (
                 PARTITION BY conv_id, call_id ORDER BY turn, arguments, name) END AS nth
        FROM c)),
r AS (
  SELECT conv_id, turn AS result_turn, before AS call_id, text AS content,
         CASE WHEN before IS NULL THEN 0 ELSE row_number() OVER (
           PARTITION BY conv_id, before ORDER BY turn, text) END AS nth
  FROM m WHERE answer),
j AS (
  SELECT coalesce(v.conv_id, r.conv_id) AS conv_id, v.turn AS call_turn, r.result_turn,
         coalesce(v.call_id, r.call_id) AS call_id, v.nth, r.nth AS result_nth, v.first, v.name, v.arguments,
         v.problems, r.content, v.call_id AS own_id,
         CASE WHEN v.nth IS NULL THEN 'orphan' WHEN v.nth > 1 THEN 'repeated'
              WHEN len(v.problems) > 0 THEN 'invalid' WHEN r.nth IS NULL THEN 'unanswered'
              ELSE 'ok' END AS status
  FROM v FULL JOIN r ON v.conv_id = r.conv_id AND v.call_id = r.call_id AND v.nth = r.nth AND v.nth = 1)
SELECT conv_id, CASE WHEN nth IS NULL THEN result_turn ELSE call_turn END AS turn, call_id,
       CASE WHEN own_id IS NULL THEN NULL WHEN first < call_turn THEN 1 ELSE 0 END AS level,
       result_turn, status, CAST(coalesce(len(problems), 0) AS INT) AS n_problems,
       '{"call":' || CASE WHEN nth IS NULL THEN 'null' ELSE
         '{"after":' || CASE WHEN first < call_turn THEN '["' || conv_id || ':' || first || '"]' ELSE '[]' END
         || ',"arguments":' || arguments || ',"id":' || coalesce(to_json(own_id), 'null')
         || ',"name":' || coalesce(to_json(name), 'null') || ',"problems":' || to_json(problems)
         || ',"turn":' || coalesce(CAST(call_turn AS VARCHAR), 'null') || '}' END
       || ',"result":' || CASE WHEN result_nth IS NULL THEN 'null' ELSE
         '{"content":' || coalesce(to_json(content), 'null') || ',"turn":'
         || coalesce(CAST(result_turn AS VARCHAR), 'null') || '}' END
       || ',"status":"' || status || '"}' AS record
FROM j"""

_OP11_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (
  SELECT rid, p, b[p + 1:p + 200] AS s
  FROM (SELECT rid, b, unnest(range(0, octet_length(b) - 199)) AS p FROM d)),
r AS (SELECT s FROM w GROUP BY s HAVING count(*) > 1),
h AS (
  SELECT rid, p, CASE WHEN p <= lag(p) OVER (PARTITION BY rid ORDER BY p) + 200 THEN 0 ELSE 1 END AS new
  FROM w SEMI JOIN r USING (s)),
g AS (SELECT rid, p, sum(new) OVER (PARTITION BY rid ORDER BY p) AS k FROM h),
runs AS (SELECT rid, min(p) AS a, max(p) + 200 AS z FROM g GROUP BY rid, k),
gaps AS (
  SELECT rid, coalesce(lag(z) OVER (PARTITION BY rid ORDER BY a), 0) AS x, a AS y FROM runs
  UNION ALL SELECT rid, max(z), 9223372036854775000 FROM runs GROUP BY rid),
cut AS (
  SELECT rid, string_agg(hex(b[x + 1:y]), '' ORDER BY x) AS kept FROM gaps JOIN d USING (rid) GROUP BY rid),
n AS (SELECT rid, sum(z - a) AS n_removed, count(*) AS n_spans FROM runs GROUP BY rid)
SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(CASE WHEN kept IS NULL THEN b ELSE unhex(kept) END) AS kept_sha256
FROM d LEFT JOIN n USING (rid) LEFT JOIN cut USING (rid)"""

_OP13_SQL = """
WITH p AS (
  SELECT lang, unnest(regexp_extract_all(t, '[^.,;:!?\\x0A-\\x0D]+')) AS piece
  FROM (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
          'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM p),
g AS (
  SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: ws[i:i + k - 1])) AS w
  FROM w, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(ws) >= k),
f AS (SELECT lang, w, k, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, w, k, f AS a FROM f WHERE k > 1 AND f >= 30),
cuts AS (
  SELECT lang, w, a, cut, w[1:cut] AS head, w[cut + 1:k] AS tail
  FROM c, (SELECT unnest([1, 2, 3]) AS cut) WHERE cut < k),
scored AS (
  SELECT x.lang, x.w, x.a, cut, h.f AS l, t.f AS r,
         CAST((2000000 * CAST(a AS HUGEINT)) // (h.f + t.f) AS BIGINT) AS score
  FROM cuts x JOIN f h ON h.lang = x.lang AND h.w = x.head JOIN f t ON t.lang = x.lang AND t.w = x.tail),
best AS (
  SELECT *, row_number() OVER (PARTITION BY lang, w ORDER BY score, cut) AS i FROM scored),
inside AS (
  SELECT lang, w, max(a) AS longer FROM (
    SELECT lang, a, w[i:i + m - 1] AS w
    FROM c, (SELECT unnest([2, 3]) AS m) x, (SELECT unnest([1, 2, 3]) AS i) y WHERE m < k AND i + m - 1 <= k)
  GROUP BY lang, w),
kept AS (
  SELECT b.*, array_to_string(b.w, ' ') AS phrase
  FROM best b LEFT JOIN inside s ON s.lang = b.lang AND s.w = b.w
  WHERE i = 1 AND (longer IS NULL OR 100 * longer < 80 * a)),
r AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM r JOIN n USING (lang) WHERE rank <= 2000"""

ORACLE = {"op11_suffix_dedup": _OP11_SQL, "op13_phrase_mining": _OP13_SQL, "op1_url_filters": _op1_sql(), "op2_ngram_jaccard_join": _OP2_SQL,
          "op3_chat_formatting": _OP3_SQL, "op9_exact_topk": _OP9_SQL}
