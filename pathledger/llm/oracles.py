"""The same results in DuckDB's SQL, where SQL can express them."""

OP5 = r"""
WITH sizes AS (
  SELECT doc_id, source,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents
), totals AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    row_number() OVER (ORDER BY source COLLATE C NULLS LAST) - 1 AS rank
  FROM sizes GROUP BY source
), weighted AS (
  SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][(rank % 3 + 1)::INT] AS weight FROM totals
), levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()
      - coalesce(sum(2.0::DOUBLE * source_size) OVER (ORDER BY 2.0::DOUBLE * source_size / weight, rank
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
    / sum(weight) OVER (ORDER BY 2.0::DOUBLE * source_size / weight, rank
          ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighted
), targets AS (
  SELECT source, source_size, least(max(level) OVER () * weight, 2.0::DOUBLE * source_size) AS target FROM levels
), rates AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate FROM targets
), draws AS (
  SELECT s.doc_id, s.size, r.*, seed,
    ('0x' || substr(sha256('mix' || (seed // 8) || ':' || coalesce(s.doc_id::VARCHAR, '')), (seed % 8 * 8 + 1)::INT, 8))::BIGINT
      / 4294967296.0::DOUBLE AS draw
  FROM sizes s JOIN rates r ON s.source IS NOT DISTINCT FROM r.source, range(32) AS t(seed)
), offs AS (
  SELECT source, seed, abs(sum(CASE WHEN draw < rate - floor(rate) THEN size ELSE 0 END)
      - any_value(source_size) * (any_value(rate) - floor(any_value(rate)))) AS off
  FROM draws GROUP BY source, seed
), chosen AS (
  SELECT source, (array_agg(seed ORDER BY off, seed))[1] AS seed FROM offs GROUP BY source
), counted AS (
  SELECT d.*, (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT AS copies
  FROM draws d JOIN chosen c ON d.source IS NOT DISTINCT FROM c.source AND d.seed = c.seed
)
SELECT doc_id, size, source_size, target, size * copies AS taken, source, copies FROM counted
"""

OP1 = r"""
WITH texts AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS words FROM documents
), windows AS (
  SELECT doc_id, s AS start, list_aggregate(words[s + 1 : s + 20], 'string_agg', ' ') AS run
  FROM (SELECT doc_id, words, unnest(range(greatest(len(words) - 19, 0))) AS s FROM texts)
), repeated AS (
  SELECT doc_id, start FROM windows
  QUALIFY row_number() OVER (PARTITION BY run ORDER BY doc_id, start) > 1
), gone AS (
  SELECT DISTINCT doc_id, start + i AS at FROM repeated, range(20) AS t(i)
), placed AS (
  SELECT doc_id, words, unnest(range(len(words))) AS at FROM texts
), kept AS (
  SELECT p.doc_id, string_agg(p.words[p.at + 1], ' ' ORDER BY p.at) AS rest, count(*) AS n
  FROM placed p ANTI JOIN gone g ON p.doc_id = g.doc_id AND p.at = g.at GROUP BY p.doc_id
)
SELECT t.doc_id, len(t.words)::BIGINT AS n_words, (len(t.words) - coalesce(n, 0))::BIGINT AS n_removed,
  sha256(coalesce(rest, '')) AS kept_sha256
FROM texts t LEFT JOIN kept k ON t.doc_id = k.doc_id
"""

#: Reachability over links (a, b) in both directions, and the smallest node reached.
_REACH = """
reach AS (
  SELECT a, b FROM links
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), smallest AS (
  SELECT a, min(b) AS low FROM reach GROUP BY a
)"""

OP3 = f"""
WITH RECURSIVE usable AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0
    AND len(list_filter(embedding, lambda v: v <> 0)) > 0
), links AS (
  SELECT p.vec_id AS a, q.vec_id AS b FROM usable p JOIN usable q
  ON p.label = q.label AND p.vec_id <> q.vec_id AND len(p.x) = len(q.x) AND list_cosine_similarity(p.x, q.x) >= 0.93
), {_REACH}, counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id,
  vec_id = least(vec_id, coalesce(low, vec_id)) AS kept
FROM embeddings e LEFT JOIN counts c ON c.a = e.vec_id LEFT JOIN smallest s ON s.a = e.vec_id
"""

OP4 = r"""
WITH lines AS (
  SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)
), firsts AS (
  SELECT doc_id, pos, line, length(line) AS n FROM lines WHERE trim(line, ' ') <> ''
  QUALIFY row_number() OVER (PARTITION BY line ORDER BY doc_id, pos) = 1
), near AS (
  SELECT DISTINCT b.line FROM firsts a, range(-1, 2) AS t(d), firsts b
  WHERE b.n = a.n + d AND a.n >= 16 AND b.n >= 16 AND (a.doc_id, a.pos) < (b.doc_id, b.pos)
    -- One edit leaves one half of the line as it is, counted from its own end.
    AND (a.line[: (a.n // 2)::INT] = b.line[: (a.n // 2)::INT]
      OR a.line[-(a.n - a.n // 2)::INT :] = b.line[-(a.n - a.n // 2)::INT :])
    AND within_one(a.line, b.line)
), kept AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.pos) AS rest, count(*) AS n
  FROM lines l
  LEFT JOIN firsts f ON f.line = l.line
  LEFT JOIN near r ON r.line = l.line
  WHERE f.line IS NULL OR (r.line IS NULL AND f.doc_id = l.doc_id AND f.pos = l.pos)
  GROUP BY l.doc_id
)
SELECT d.doc_id, coalesce(len(string_split(text, chr(10))), 0)::INT AS n_lines,
  (coalesce(len(string_split(text, chr(10))), 0) - coalesce(n, 0))::INT AS n_removed,
  length(CASE WHEN text IS NOT NULL THEN coalesce(rest, '') END)::INT AS kept_chars,
  sha256(CASE WHEN text IS NOT NULL THEN coalesce(rest, '') END) AS kept_sha256
FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id
"""

#: At most one edit apart: a common beginning and a common end cover all but one character.
_WITHIN_ONE = """
(len(list_filter(range(1, least(length(x), length(y)) + 1), lambda i: x[: i::INT] = y[: i::INT]))
 + len(list_filter(range(1, least(length(x), length(y)) + 1), lambda i: x[-(i::INT) :] = y[-(i::INT) :]))
 >= greatest(length(x), length(y)) - 1)"""
OP4 = OP4.replace("within_one(a.line, b.line)", _WITHIN_ONE.replace("x", "a.line").replace("y", "b.line"))

OP7 = rf"""
WITH RECURSIVE texts AS (
  SELECT doc_id, coalesce(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS words
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, list_aggregate(words[s + 1 : s + 4], 'string_agg', ' ') AS run
  FROM (SELECT doc_id, words, unnest(range(CASE WHEN len(words) = 0 THEN 0 ELSE greatest(len(words) - 3, 1) END)) AS s FROM texts)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
  SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS n
  FROM shingles p JOIN shingles q ON p.run = q.run AND p.doc_id <> q.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM shared s JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
  WHERE 100 * s.n >= 80 * (p.n + q.n - s.n)
), {_REACH}
SELECT t.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(t.doc_id, coalesce(low, t.doc_id)) AS component_id,
  t.doc_id = least(t.doc_id, coalesce(low, t.doc_id)) AS kept
FROM texts t LEFT JOIN sizes s ON s.doc_id = t.doc_id LEFT JOIN smallest m ON m.a = t.doc_id
"""

OP11 = r"""
WITH tokens AS (
  SELECT doc, lang, source, unnest(coalesce(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+'), [])) AS term
  FROM (SELECT row_number() OVER () AS doc, text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents)
), kept AS (
  SELECT lang, term FROM tokens GROUP BY ALL HAVING count(DISTINCT doc) >= 3
), sizes AS (
  SELECT lang, count(*) AS v FROM kept GROUP BY lang
), sources AS (
  SELECT DISTINCT coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents
), counts AS (
  SELECT lang, source, term, count(*) AS n FROM tokens SEMI JOIN kept USING (lang, term) GROUP BY ALL
), totals AS (
  SELECT lang, source, sum(n) AS total FROM counts GROUP BY ALL
), shares AS (
  SELECT s.lang, s.source, term, coalesce(n, 0) AS n,
    (1 + 1000000000::HUGEINT * (coalesce(n, 0) + 1) // (coalesce(total, 0) + v))::BIGINT AS p
  FROM sources s JOIN kept k USING (lang) JOIN sizes USING (lang)
  LEFT JOIN counts USING (lang, source, term) LEFT JOIN totals USING (lang, source)
), whole AS (
  SELECT lang, term, (1 + 1000000000::HUGEINT * (sum(n) + 1) // (any_value(total) + any_value(v)))::BIGINT AS q
  FROM counts JOIN (SELECT lang, sum(total) AS total FROM totals GROUP BY lang) USING (lang) JOIN sizes USING (lang)
  GROUP BY lang, term
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM sources a JOIN sources b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM shares JOIN whole USING (lang, term) WHERE n > 0 AND p > q
)
SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item COLLATE C)::INT AS rank
FROM found QUALIFY part = 'pair' OR rank <= 200
"""

OP13 = r"""
WITH texts AS (
  SELECT doc_id, coalesce(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS words
  FROM documents
), items AS (
  SELECT item_id, coalesce(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS words
  FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, span, list_aggregate(words[s + 1 : s + span], 'string_agg', ' ') AS run
  FROM (SELECT *, unnest(range(len(words) - span + 1)) AS s
        FROM (SELECT *, least(len(words), 10) AS span FROM items WHERE len(words) > 0))
), found AS (
  SELECT doc_id, s, span, list_aggregate(words[s + 1 : s + span], 'string_agg', ' ') AS run
  FROM (SELECT *, unnest(range(greatest(len(words) - span + 1, 0))) AS s FROM texts, (SELECT DISTINCT span FROM windows))
), hits AS (
  SELECT doc_id, s, f.span, item_id FROM found f JOIN windows w ON f.run = w.run AND f.span = w.span
), covered AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit
  FROM (SELECT doc_id, unnest(range(s, s + span)) AS place FROM (SELECT DISTINCT doc_id, s, span FROM hits)) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id
)
SELECT t.doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM texts t LEFT JOIN covered c ON c.doc_id = t.doc_id LEFT JOIN named n ON n.doc_id = t.doc_id
"""

ORACLES = {
    "op1_substring": OP1, "op3_vectors": OP3, "op4_lines": OP4, "op5_mixing": OP5, "op7_setjoin": OP7,
    "op11_divergence": OP11, "op13_winnowing": OP13,
}
