"""DuckDB SQL for the queries that SQL can express, each written from the rule and not from the operator's method."""

from __future__ import annotations

WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\x0b\x0c\r]+'), lambda w: w <> '')"

#: Components of links (a, b) by spreading the smallest id until nothing changes.
COMPONENTS = """
reach(node, root) AS (
  SELECT id, id FROM nodes
  UNION
  SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.node WHERE r.root < l.b
),
roots AS (SELECT node AS id, min(root) AS component_id FROM reach GROUP BY node)
"""

EMBEDDINGS = f"""
WITH RECURSIVE nodes AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
links AS (SELECT a.id AS a, b.id AS b FROM nodes a JOIN nodes b ON a.id <> b.id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.9),
{COMPONENTS}
SELECT id AS vec_id, (SELECT count(*) FROM links WHERE a = id) AS n_links, component_id, id = component_id AS kept FROM roots
"""

CHAT = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
),
sized AS (
  SELECT *, length(regexp_replace(regexp_replace(text, '<(\\*)(/?s>)', '<\\\1\2', 'g'), '\[(\\*)(/?INST\])', '[\\\1\2', 'g')) AS size FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(3 + sum(CASE WHEN role = 'assistant' THEN 11 ELSE 7 + length(role) END + size) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""

SUBSTRING = f"""
WITH split AS (SELECT doc_id, {WORDS} AS words FROM documents),
windows AS (
  SELECT doc_id, s, array_to_string(words[s : s + 19], ' ') AS run
  FROM (SELECT doc_id, words, unnest(generate_series(1, len(words) - 19)) AS s FROM split WHERE len(words) >= 20)
),
later AS (SELECT doc_id, s FROM windows QUALIFY row_number() OVER (PARTITION BY run ORDER BY doc_id, s) > 1),
gone AS (SELECT DISTINCT doc_id, s + k AS at FROM later, (SELECT unnest(generate_series(0, 19)) AS k)),
placed AS (SELECT doc_id, unnest(words) AS w, unnest(generate_series(1, len(words))) AS at FROM split),
kept AS (
  SELECT p.doc_id, count(g.at) AS n_removed, coalesce(string_agg(p.w, ' ' ORDER BY p.at) FILTER (WHERE g.at IS NULL), '') AS text
  FROM placed p LEFT JOIN gone g ON g.doc_id = p.doc_id AND g.at = p.at GROUP BY p.doc_id
)
SELECT s.doc_id, CAST(len(s.words) AS BIGINT) AS n_words, coalesce(k.n_removed, 0) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM split s LEFT JOIN kept k ON k.doc_id = s.doc_id
"""

URLS = r"""
WITH cut AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
),
rules(h, p, action) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
fit AS (
  SELECT page_id, h || p AS rule, action FROM cut JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
  QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC, length(h) DESC, action) = 1
)
SELECT c.page_id, c.host, c.path, f.rule, coalesce(f.action, 'allow') AS verdict FROM cut c LEFT JOIN fit f ON f.page_id = c.page_id
"""

NGRAMS = f"""
WITH RECURSIVE split AS (SELECT doc_id, {WORDS} AS words FROM documents),
sets AS (
  SELECT DISTINCT doc_id, array_to_string(words[s : s + 4], ' ') AS gram
  FROM (SELECT doc_id, words, unnest(generate_series(1, greatest(len(words) - 4, 1))) AS s FROM split WHERE len(words) > 0)
),
sizes AS (SELECT doc_id, count(*) AS n, string_agg(gram, chr(10) ORDER BY gram) AS whole FROM sets GROUP BY doc_id),
classes AS (SELECT doc_id, n, min(doc_id) OVER (PARTITION BY whole) AS class_id FROM sizes),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM sets x JOIN sets y ON x.gram = y.gram AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (SELECT c.a, c.b FROM common c JOIN sizes s ON s.doc_id = c.a JOIN sizes t ON t.doc_id = c.b WHERE c.n >= 0.8 * (s.n + t.n - c.n)),
nodes AS (SELECT doc_id AS id FROM documents),
{COMPONENTS}
SELECT r.id AS doc_id, coalesce(c.class_id, r.id) AS class_id, r.component_id, (SELECT count(*) FROM links WHERE a = r.id) AS n_links, r.id = r.component_id AS kept
FROM roots r LEFT JOIN classes c ON c.doc_id = r.id
"""

FILTERS = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents
),
marks AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
failed AS (
  SELECT part, good, toxic, list_filter(['A', 'B', 'C', 'D', 'E'], lambda f, i: [
    len(words) < 100,
    100 * len(list_distinct(words)) < 80 * len(words),
    100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text),
    regexp_matches(text, '[#$%&*|]'),
    coalesce(s.doc_id > min(s.doc_id) OVER (PARTITION BY text), false)][i]) AS fails
  FROM split s LEFT JOIN marks m ON m.doc_id = s.doc_id
),
counted AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM failed GROUP BY ALL
),
letters(f) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
orders(o) AS (SELECT '' UNION ALL SELECT o || f FROM orders JOIN letters ON NOT contains(o, f)),
steps AS (
  SELECT o AS filter_order, step, o[step] AS f, list_filter(string_split(o, ''), lambda c, i: i < step) AS earlier
  FROM orders, (SELECT CAST(unnest(range(1, 6)) AS INTEGER) AS step) WHERE length(o) = 5
),
measured AS (
  SELECT part, filter_order, step, f,
    coalesce(sum(n) FILTER (WHERE NOT list_contains(fails, f) AND NOT list_has_any(fails, earlier)), 0) AS kept,
    coalesce(sum(n) FILTER (WHERE list_contains(fails, f) AND NOT list_has_any(fails, earlier)), 0) AS removed,
    coalesce(sum(n) FILTER (WHERE list_contains(fails, f) AND list_has_any(fails, earlier)), 0) AS redundant,
    coalesce(sum(n) FILTER (WHERE fails = [f]), 0) AS unique_fails,
    coalesce(sum(good) FILTER (WHERE list_contains(fails, f) AND NOT list_has_any(fails, earlier)), 0) AS good_lost,
    coalesce(sum(toxic) FILTER (WHERE list_contains(fails, f) AND NOT list_has_any(fails, earlier)), 0) AS toxic_lost
  FROM counted, steps GROUP BY ALL
)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM measured
"""

COPIES = r"""
WITH plain AS (SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
placed AS (
  SELECT doc_id, norm, first_value(doc_id) OVER best AS keep_id, row_number() OVER best AS place, count(*) OVER (PARTITION BY norm) AS group_size
  FROM plain WINDOW best AS (PARTITION BY norm ORDER BY length(text) DESC, doc_id)
)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(norm) AS text_sha256 FROM placed
"""

DIVERGENCE = r"""
WITH rows AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
),
said AS (SELECT r, lang, source, unnest(terms) AS term FROM rows),
kept AS (SELECT lang, term FROM said GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
grps AS (SELECT DISTINCT lang, source FROM rows),
counts AS (SELECT lang, source, term, count(*) AS n FROM said GROUP BY ALL),
filled AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source) AS total,
    sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, k.term) AS lang_n, count(*) OVER (PARTITION BY g.lang, g.source) AS v
  FROM grps g JOIN kept k ON k.lang = g.lang LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
),
shares AS (
  SELECT *, 1 + (1000000000 * (n + 5)::HUGEINT) // (total + 5 * v) AS p,
    1 + (1000000000 * (lang_n + 5)::HUGEINT) // (sum(n) OVER (PARTITION BY lang) + 5 * v) AS q
  FROM filled
),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce((
    SELECT sum(abs(x.p - y.p)) FROM shares x JOIN shares y ON y.lang = x.lang AND y.term = x.term
    WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0) AS value
  FROM grps a JOIN grps b ON b.lang = a.lang AND b.source <> a.source
),
all_parts AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pairs
  UNION ALL SELECT lang, source, 'term', term, p - q FROM shares WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
  CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INTEGER) AS rank
FROM all_parts QUALIFY part = 'pair' OR rank <= 50
"""

ORACLES = {
    "op1_embedding_near_dedup": EMBEDDINGS,
    "op2_chat_format": CHAT,
    "op4_substring_dedup": SUBSTRING,
    "op6_url_filters": URLS,
    "op9_ngram_jaccard_join": NGRAMS,
    "op11_filter_interaction_audit": FILTERS,
    "op12_exact_dedup": COPIES,
    "op13_source_divergence": DIVERGENCE,
}
