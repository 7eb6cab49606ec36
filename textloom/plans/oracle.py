"""What the queries return, in DuckDB's SQL over the same tables."""

from __future__ import annotations

from textloom.functions import text as T
from textloom.operators import filters as X

_S = r"[\s\p{Z}]"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_S}+|{_S}+$', '', 'g')"


_DOCS = "SELECT doc_id AS row_id, text, source AS label, lang FROM documents"


def _first_of_each(items: str, joined: str) -> str:
    """The text of items, each kept at its first lower-cased occurrence, blanks left out."""
    return f"""WITH s AS (SELECT doc_id AS row_id, {items} AS l FROM documents), k AS (SELECT row_id, l, list_transform(l, lambda x: lower(x)) AS k FROM s)
SELECT row_id, array_to_string(list_filter(l, lambda x, i: k[i] <> '' AND list_position(k, k[i]) = i), {joined}) AS text FROM k"""


_ODD = """SELECT doc_id AS row_id, source AS label, CASE doc_id % 6
  WHEN 0 THEN text || ' дело-1, дело-2, дело-3 дело-4, дело-5, дело-66 конец'
  WHEN 1 THEN repeat(text, 3) || ' Публичная оферта ' || text
  WHEN 2 THEN replace(text, ' ', ' ' || chr(9) || ' ') || chr(10) || ' ' || chr(10) || chr(10) || text
  WHEN 3 THEN text || ' 漢字 かな'
  WHEN 4 THEN ' ' || chr(10) || chr(9) || ' '
  ELSE 'Конечно, вот письмо работа работа РАБОТА. [НАЗВАНИЕ_КО] ' || text END AS text FROM documents"""
_WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"
_ANOMALY = f"NOT (len(list_distinct({_WORDS})) < 50 AND len({_WORDS}) > 200)"
_SPLIT = """SELECT row_id, label, CASE WHEN n > 1 AND r <= greatest(1, CAST(floor(n * 0.2) AS BIGINT)) THEN 'test' ELSE 'train' END AS part
FROM (SELECT doc_id AS row_id, source AS label, count(*) OVER (PARTITION BY source) AS n, row_number() OVER (PARTITION BY source ORDER BY md5('42:' || doc_id), doc_id) AS r FROM documents)"""
_ANSWERS = "SELECT doc_id AS cand_id, source AS label, 'Оценка: ' || (doc_id % 14) || (['/10', 'балл', ' из 10', '.5'])[doc_id % 4 + 1] AS answer FROM documents"
_SCORE = r"coalesce(TRY_CAST(nullif(regexp_extract(answer, '(?:^|[^\p{L}\p{N}_])(10|[1-9])(?:$|[^\p{L}\p{N}_])', 1), '') AS DOUBLE), 5.0)"
_SCORED = f"SELECT cand_id, label, {_SCORE} AS score FROM ({_ANSWERS})"


def _top(least: float) -> str:
    return f"SELECT cand_id, label, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, cand_id) AS rank FROM ({_SCORED}) WHERE score >= {least}) WHERE rank <= 7"


def _robin(order: str) -> str:
    return f"""WITH m AS (SELECT lang, count(*) AS m FROM documents GROUP BY lang), r AS (
  SELECT d.doc_id, d.lang, m.m, k.round, row_number() OVER (PARTITION BY d.lang, k.round ORDER BY md5({order}), d.doc_id) AS k
  FROM documents d JOIN m USING (lang), LATERAL (SELECT unnest(range(0, CAST(floor((m.m * 2 + 2) / m.m) AS BIGINT) + 1)) AS round) k)
SELECT lang AS label, CAST(round * m + k - 1 AS BIGINT) AS slot, doc_id AS row_id FROM r WHERE round * m + k - 1 < m * 2 + 3"""


_NORM = f"lower({_strip('text')})"
_NEW = f"""SELECT min(doc_id) AS cand_id, source AS label FROM (SELECT doc_id, source, {_NORM} AS norm FROM documents) c
WHERE NOT EXISTS (SELECT 1 FROM documents e WHERE e.lang = 'en' AND e.source = c.source AND lower({_strip('e.text')}) = c.norm) GROUP BY source, norm"""
_HELD = "SELECT doc_id AS row_id, 'From [PERSON] at [ORGANIZATION]: ' || text || ' on [DATE_TIME] [PERSON]' AS text FROM documents"
_PRED = "SELECT lang AS label, CASE WHEN doc_id % 7 = 0 THEN 'en' WHEN doc_id % 11 = 0 THEN 'xx' ELSE lang END AS prediction FROM documents"


def _report(pred: str) -> str:
    return f"""SELECT label, CASE WHEN predicted > 0 THEN hit / predicted ELSE 0 END AS precision, CASE WHEN support > 0 THEN hit / support ELSE 0 END AS recall,
  CASE WHEN support + predicted > 0 THEN 2 * hit / (support + predicted) ELSE 0 END AS f1, support
FROM (SELECT label, CAST(sum(s) AS BIGINT) AS support, CAST(sum(p) AS BIGINT) AS predicted, CAST(sum(h) AS DOUBLE) AS hit FROM (
  SELECT label, 1 AS s, 0 AS p, CASE WHEN label = prediction THEN 1 ELSE 0 END AS h FROM ({pred}) UNION ALL SELECT prediction, 0, 1, 0 FROM ({pred})) GROUP BY label)"""


_FIXED = _PRED.replace("THEN 'xx'", "THEN lang")
_SUMMARY = "SELECT avg(CASE WHEN support > 0 THEN recall END) AS balanced_accuracy, avg(f1) AS macro_f1 FROM ({})"
_LEAK = " OR ".join(
    [f"contains(substr(lower({_strip('text')}), 1, 150), {_q(m)})" for m in X.LEAK_START]
    + [f"contains(lower({_strip('text')}), {_q(m)})" for m in X.LEAK_ANYWHERE]
    + [f"regexp_matches(text, {_q('(?m)(?:' + '|'.join(X.LEAK_PATTERNS) + ')')})"]
)
_RATIO = f"list_filter(regexp_split_to_array(lower(text), '{_S}+'), lambda x: x <> '')"
_TRIGGERS = _q("(?:" + "|".join(T.TRIGGERS) + ")")
_TOKEN = r"\[?[\p{L}\p{N}_]+\]?-\d+"

ORACLE: dict[str, str] = {
    "flagship": f"""WITH t AS ({_first_of_each(f"list_transform(string_split(text, chr(10)), lambda x: {_strip('x')})", "chr(10)")}), d AS (
  SELECT min(t.row_id) AS row_id, t.text, s.source AS label FROM t JOIN documents s ON s.doc_id = t.row_id GROUP BY t.text, s.source)
SELECT label, count(*) AS n FROM d WHERE {_ANOMALY} AND {_strip('text')} <> '' GROUP BY label""",
    "remove_duplicate_lines": _first_of_each(f"list_transform(string_split(text, chr(10)), lambda x: {_strip('x')})", "chr(10)"),
    "remove_duplicate_sentences": _first_of_each(f"list_transform(string_split(regexp_replace({_strip('text')}, '([.!?]){_S}+', '\\1' || chr(1), 'g'), chr(1)), lambda x: {_strip('x')})", "' '"),
    "cycling_numbered_lines": rf"""WITH b AS (SELECT doc_id AS row_id, text, list_transform(string_split(text, chr(10)), lambda x: regexp_replace({_strip('x')}, '^\d+\.\s*', '')) AS l FROM documents),
o AS (SELECT row_id, text, l, list_filter(l, lambda x, i: list_position(l, x) = i) AS u FROM b)
SELECT row_id, CASE WHEN len(u) * 2 < len(l) THEN array_to_string(u, chr(10)) ELSE text END AS text FROM o""",
    "incremental_list": rf"SELECT row_id, regexp_replace(text, '({_TOKEN})(?:[,\s]+{_TOKEN}){{3,}}[,\s]+({_TOKEN})', '\1 ... \2', 'g') AS text FROM ({_ODD})",
    "trim_attached": f"SELECT row_id, CASE WHEN length(text) > 4000 AND regexp_matches(text, {_TRIGGERS}) THEN {_strip(f'substr(text, 1, instr(text, regexp_extract(text, {_TRIGGERS})) - 1)')} ELSE text END AS text FROM ({_ODD})",
    "normalize_ws": rf"SELECT row_id, {_strip(f"regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), '\n{_S}*\n+', chr(10) || chr(10), 'g')")} AS text FROM ({_ODD})",
    "exact_dedup": "SELECT min(doc_id) AS row_id FROM documents GROUP BY text, source",
    "cross_label_dedup": "SELECT doc_id AS row_id FROM (SELECT *, count(*) OVER (PARTITION BY text) AS n FROM documents) WHERE NOT (n > 1 AND source = 'src0')",
    "anomalous_texts": f"SELECT doc_id AS row_id FROM documents WHERE {_ANOMALY}",
    "empty_filter": f"SELECT row_id FROM ({_ODD}) WHERE {_strip('text')} <> ''",
    "class_distribution": "SELECT lang AS label, count(*) AS n FROM documents GROUP BY lang",
    "classes_to_augment": "SELECT lang AS label, count(*) AS n FROM documents GROUP BY lang HAVING count(*) < 150",
    "need_per_class": "SELECT lang AS label, count(*) AS n, 200 - count(*) AS need, count_if(length(text) >= 1000) AS n_original FROM documents GROUP BY lang HAVING count(*) < 200",
    "stratified_split": _SPLIT,
    "train_test_counts": f"SELECT label, count_if(part = 'train') AS n_train, count_if(part = 'test') AS n_test FROM ({_SPLIT}) GROUP BY label HAVING count_if(part = 'train') > 0",
    "threshold_counts": "SELECT count(*) AS n_classes, min(n) AS min_n, max(n) AS max_n, count_if(n < 15) AS below_15, count_if(n < 35) AS below_35, count_if(n < 150) AS below_150 FROM (SELECT count(*) AS n FROM documents GROUP BY lang)",
    "report_markers": "SELECT lang AS label, count(*) AS n, CASE WHEN count(*) >= 140 THEN '✓' ELSE '✗' END AS reached FROM documents GROUP BY lang",
    "prompt_examples": "SELECT source AS label, string_agg(text, chr(10) || '---' || chr(10) ORDER BY r) AS examples FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5('42:' || doc_id), doc_id) AS r FROM documents) WHERE r <= 5 GROUP BY source",
    "dedup_vs_existing": _NEW,
    "short_filter": f"SELECT doc_id AS row_id FROM documents WHERE length({_strip('text')}) >= 500",
    "language_profiles": """WITH words AS (SELECT doc_id AS row_id, lang, unnest(regexp_extract_all(lower(text), '\\p{L}+')) AS w FROM documents),
        padded AS (SELECT row_id, lang, '_' || w || '_' AS w FROM words),
        cut AS (SELECT row_id, lang, w, unnest([1, 2, 3]) AS size FROM padded),
        each AS (SELECT row_id, lang, w, size, unnest(range(1, length(w) - size + 2)) AS start FROM cut),
        grams AS (SELECT row_id, lang, substr(w, start, size) AS gram FROM each),
        own AS (SELECT row_id, gram, count(*) AS n FROM grams WHERE gram <> '_' GROUP BY ALL),
        own_ranked AS (SELECT row_id, gram, row_number() OVER (PARTITION BY row_id ORDER BY n DESC, gram) AS place FROM own QUALIFY place <= 300),
        theirs AS (SELECT lang, gram, count(*) AS n FROM grams WHERE gram <> '_' AND lang IS NOT NULL GROUP BY ALL),
        theirs_ranked AS (SELECT lang, gram, row_number() OVER (PARTITION BY lang ORDER BY n DESC, gram) AS place FROM theirs QUALIFY place <= 300),
        sized AS (SELECT row_id, count(*) AS m FROM own_ranked GROUP BY row_id),
        near AS (SELECT o.row_id, t.lang, sum(abs(o.place - t.place)) + 300 * (max(s.m) - count(*)) AS distance
            FROM own_ranked o JOIN theirs_ranked t USING (gram) JOIN sized s ON s.row_id = o.row_id GROUP BY o.row_id, t.lang),
        best AS (SELECT row_id, lang AS detected, CAST(distance AS BIGINT) AS distance FROM near QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY distance, lang) = 1)
        SELECT DISTINCT d.doc_id AS row_id, b.detected, b.distance FROM documents d LEFT JOIN best b ON b.row_id = d.doc_id""",
    "language_filter": "SELECT doc_id AS row_id FROM documents WHERE NOT regexp_matches(lower(text), '[éèêçàùäöüßñóíá]')",
    "degenerate_ratio": f"SELECT doc_id AS row_id FROM documents WHERE len({_RATIO}) < 3 OR len(list_distinct({_RATIO})) / len({_RATIO}) >= 0.2",
    "foreign_scripts": rf"SELECT row_id FROM ({_ODD}) WHERE NOT regexp_matches(text, '{T.FOREIGN}')",
    "prompt_leak": f"SELECT row_id FROM ({_ODD}) WHERE NOT ({_LEAK})",
    "cosine_filter": """SELECT cand_id, round(s, 6) AS similarity FROM (
  SELECT a.vec_id AS cand_id, max(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))) AS s
  FROM embeddings a LEFT JOIN embeddings b ON a.label = b.label AND b.vec_id % 5 <> 0 WHERE a.vec_id % 5 = 0 GROUP BY a.vec_id) WHERE s IS NULL OR (s >= 0.2 AND s < 0.35)""",
    "similarity_schedule": "SELECT doc_id AS row_id, round(least(0.95 + greatest(0, doc_id % 8 - 1) * 0.01, 0.98), 2)::DOUBLE AS threshold FROM documents",
    "parse_score": f"SELECT cand_id AS row_id, {_SCORE} AS score FROM ({_ANSWERS})",
    "judge_topk": _top(5.0),
    "judge_topk_pairs": _top(2.5),
    "mean_scores": f"SELECT label, round(avg(score), 6) AS mean_all, round(coalesce(avg(score) FILTER (rank <= 7 AND score >= 5), 0), 6) AS mean_selected FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, cand_id) AS rank FROM ({_SCORED})) GROUP BY label",
    "round_robin_sources": _robin("'42:' || d.doc_id"),
    "round_robin_reshuffled": _robin("'42:' || k.round || ':' || d.doc_id"),
    "mask_placeholders": f"""WITH h AS ({_HELD}), m AS (SELECT row_id, regexp_extract_all(text, {_q(T.PLACEHOLDER)}) AS f, string_split(regexp_replace(text, {_q(T.PLACEHOLDER)}, chr(1), 'g'), chr(1)) AS p FROM h)
SELECT row_id, array_to_string(list_transform(p, lambda x, i: CASE WHEN i > 1 THEN '<' || (i - 2) || '>' || x ELSE x END), '') AS masked, array_to_string(f, '|') AS found FROM m""",
    "unmask_placeholders": f"""WITH h AS ({_HELD}), m AS (SELECT row_id, regexp_extract_all(text, {_q(T.PLACEHOLDER)}) AS f, string_split(regexp_replace(text, {_q(T.PLACEHOLDER)}, chr(1), 'g'), chr(1)) AS p FROM h)
SELECT row_id, array_to_string(list_transform(p, lambda x, i: CASE WHEN i = 3 THEN x WHEN i > 1 THEN f[i - 1] || x ELSE x END), '') AS text FROM m""",
    "first_paragraph": f"SELECT doc_id AS row_id, {_strip("string_split(replace(text, '.' || chr(10), '.' || chr(10) || chr(10)), chr(10) || chr(10))[1]")} AS text FROM documents",
    "fill_prompt": "SELECT doc_id AS row_id, 'Класс ' || source || ':' || chr(10) || text || chr(10) || 'Еще ' || source || '.' AS prompt FROM documents",
    "pair_semi_join": f"SELECT cand_id FROM ({_NEW})",
    "pair_restore_by_text": f"SELECT d.doc_id AS cand_id FROM documents d WHERE EXISTS (SELECT 1 FROM ({_NEW}) n JOIN documents c ON c.doc_id = n.cand_id WHERE c.text = d.text AND c.source = d.source)",
    "union_stages": "SELECT 0 AS stage, source AS label, count(*) AS n FROM documents GROUP BY source UNION ALL SELECT 1, source, count(*) FROM documents WHERE length(text) < 500 GROUP BY source",
    "confusion": f"SELECT label, prediction, count(*) AS n FROM ({_PRED}) GROUP BY label, prediction",
    "class_report": f"SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM ({_report(_PRED)})",
    "balanced_accuracy": f"SELECT round(balanced_accuracy, 6) AS balanced_accuracy FROM ({_SUMMARY.format(_report(_PRED))})",
    "macro_f1": f"SELECT round(macro_f1, 6) AS macro_f1 FROM ({_SUMMARY.format(_report(_PRED))})",
    "delta_table": f"""SELECT 'm' AS model, metric, round(a - b, 4) AS delta FROM (
  SELECT 'balanced_accuracy' AS metric, a.balanced_accuracy AS a, b.balanced_accuracy AS b FROM ({_SUMMARY.format(_report(_FIXED))}) a, ({_SUMMARY.format(_report(_PRED))}) b
  UNION ALL SELECT 'macro_f1', a.macro_f1, b.macro_f1 FROM ({_SUMMARY.format(_report(_FIXED))}) a, ({_SUMMARY.format(_report(_PRED))}) b)""",
    "label_index": "SELECT doc_id AS row_id, CAST(dense_rank() OVER (ORDER BY source) - 1 AS INTEGER) AS label_index FROM documents",
    "cv_folds": "SELECT doc_id AS row_id, CAST((row_number() OVER (PARTITION BY source ORDER BY md5('42:' || doc_id), doc_id) - 1) % 3 AS INTEGER) AS fold FROM documents",
    "repeated_words": rf"""WITH p AS (SELECT row_id, regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+') AS w, regexp_split_to_array(text, '[\p{{L}}\p{{N}}_]+') AS g FROM ({_ODD}))
SELECT row_id, array_to_string(list_transform(g, lambda x, i: CASE WHEN i > 1 AND i <= len(w) AND lower(w[i]) = lower(w[i - 1]) AND regexp_full_match(x, '{_S}+') THEN '' ELSE x || coalesce(w[i], '') END), '') AS text FROM p""",
    "classes_ascending": "SELECT lang AS label, count(*) AS n FROM documents GROUP BY lang",
    "generate_batch": "SELECT doc_id AS row_id, CASE WHEN length(text) % 7 = 0 OR length(text) % 5 = 0 OR trim(reverse(text)) = '' THEN NULL ELSE reverse(text) END AS answer FROM documents",
    "answers_once": """SELECT doc_id AS row_id, CASE WHEN length(text) % 7 = 0 OR length(text) % 5 = 0 OR trim(reverse(text)) = '' THEN NULL ELSE reverse(text) END AS answer,
CASE WHEN text IS NULL OR length(text) % 7 = 0 THEN NULL WHEN text IN (SELECT text FROM documents WHERE lang = 'en' AND text IS NOT NULL) THEN 'first' ELSE 'second' END AS made_by FROM documents""",
    "class_context": f"""WITH p AS (SELECT source AS label, source || ': ' || max(text) AS p FROM documents GROUP BY source),
a AS (SELECT label, CASE WHEN length(p) % 7 = 0 OR length(p) % 5 = 0 THEN NULL ELSE {_strip("string_split(reverse(p), chr(10) || chr(10))[1]")} END AS a FROM p)
SELECT label, coalesce(nullif(a, ''), 'none') AS context FROM a""",
    "judge_examples": "SELECT lang AS label, string_agg(text, chr(10) || '---' || chr(10) ORDER BY r) AS examples FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id), doc_id) AS r FROM documents) WHERE r <= 5 GROUP BY lang",
    "score_texts": """WITH e AS (SELECT lang, string_agg(text, chr(10) || '---' || chr(10) ORDER BY r) AS examples FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id), doc_id) AS r FROM documents) WHERE r <= 3 GROUP BY lang),
s AS (SELECT doc_id, lang, (length(lang) + length(CASE WHEN lang = 'en' THEN '' ELSE 'ctx' END) + length(examples) + length(text) + 3) % 12 AS n FROM documents JOIN e USING (lang))
SELECT doc_id AS cand_id, lang AS label, CASE WHEN n BETWEEN 1 AND 10 THEN CAST(n AS DOUBLE) ELSE 10.0 END AS score, true AS parse_ok FROM s""",
    "back_translate": f"SELECT row_id, {_strip("text || '~en~ru'")} AS back_translated FROM ({_HELD})",
    "results_pivot": "SELECT lang AS model, count(*) AS baseline, CASE WHEN lang <> 'fr' THEN count_if(length(text) > 1000) END AS augmented FROM documents GROUP BY lang",
    "raw_json": "SELECT text, source AS label FROM documents",
    "csv_round_trip": "SELECT text, source AS label FROM documents",
    "stage_fallback": f"""WITH s AS (SELECT d.source AS label, d.text, p.part FROM documents d JOIN ({_SPLIT}) p ON p.row_id = d.doc_id)
SELECT label, 'asked 3' AS asked, 1 AS stage, count(*) AS n, CAST(sum(length(text || '!')) AS BIGINT) AS chars FROM s WHERE part = 'train' GROUP BY label
UNION ALL SELECT label, 'asked 0', 0, count(*), CAST(sum(length(text)) AS BIGINT) FROM s WHERE part = 'train' GROUP BY label
UNION ALL SELECT label, 'test', 0, count(*), CAST(sum(length(text)) AS BIGINT) FROM s WHERE part = 'test' GROUP BY label""",
    "pair_cache": "SELECT lang AS label, reverse(text) AS translated, text AS original FROM documents WHERE lang IN (SELECT lang FROM documents GROUP BY lang HAVING count(*) < 150)",
    "feature_cache": "SELECT doc_id AS row_id, CAST(length(text) AS INTEGER) AS n FROM documents",
    "tfidf_weights": r"""WITH w AS (SELECT doc_id AS row_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}') AS w FROM documents),
t AS (SELECT row_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM w),
c AS (SELECT row_id, term, count(*) AS tf FROM t GROUP BY row_id, term),
v AS (SELECT term, count(*) AS df FROM c GROUP BY term HAVING count(*) >= 2 ORDER BY sum(tf) DESC, term LIMIT 50000),
r AS (SELECT row_id, c.term, (1 + ln(tf)) * (ln((1.0 + (SELECT count(*) FROM documents)) / (1 + df)) + 1) AS raw FROM c JOIN v ON c.term = v.term)
SELECT row_id, term, round(raw / sqrt(sum(raw * raw) OVER (PARTITION BY row_id)), 6) AS weight FROM r""",
}
