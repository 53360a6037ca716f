"""DuckDB SQL for the queries that SQL can express. Reference values are written out again on purpose."""

from __future__ import annotations

QUALITY_RULES = r"""
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS t FROM documents
), split AS (
  SELECT doc_id, t,
         list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM texts
), spots AS (
  SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS win
  FROM split, unnest(range(1, len(words) - 1)) AS r(i)
), twice AS (
  SELECT doc_id, i FROM spots QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + d) AS n_repeat_words FROM twice, unnest([0, 1, 2]) AS o(d) GROUP BY doc_id
), base AS (
  SELECT s.doc_id, s.t, s.words, len(words) AS n_words,
         coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM split s LEFT JOIN covered c ON s.doc_id = c.doc_id
), classes AS (
  SELECT *, (length(t) - word_chars)::DOUBLE AS white,
         (length(t) - length(regexp_replace(t, '\p{Ll}', '', 'g')))::DOUBLE AS low,
         (length(t) - length(regexp_replace(t, '\p{Lu}', '', 'g')))::DOUBLE AS up,
         (length(t) - length(regexp_replace(t, '[0-9]', '', 'g')))::DOUBLE AS digit
  FROM base
), class_bins AS (
  SELECT doc_id, length(t) AS total, unnest([1, 2, 3, 4, 5, 6]) AS k,
         unnest([white, low, up, digit, n_symbols::DOUBLE, length(t) - white - low - up - digit - n_symbols]) AS n
  FROM classes WHERE length(t) >= 200
), class_shares(lang, qs) AS (
  VALUES ('en', [0.165, 0.785, 0.022, 0.004, 0.001, 0.023]), ('de', [0.150, 0.775, 0.045, 0.004, 0.001, 0.025]),
         ('fr', [0.165, 0.778, 0.022, 0.004, 0.001, 0.030]), ('es', [0.165, 0.782, 0.022, 0.004, 0.001, 0.026])
), class_terms AS (
  SELECT doc_id, lang, n / total AS p, qs[k]::DOUBLE AS q, (n / total + qs[k]::DOUBLE) / 2 AS m FROM class_bins, class_shares
), class_distance AS (
  SELECT doc_id, min(d) AS d FROM (
    SELECT doc_id, lang, sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * log2(p / m) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / m) ELSE 0 END) / 2)) AS d
    FROM class_terms GROUP BY doc_id, lang) GROUP BY doc_id
), word_shares(lang, ws, qs) AS (
  VALUES ('en', ['the', 'of', 'and', 'to', 'a', 'in', 'is', 'that', 'it', 'for', 'was', 'on'],
                [0.061, 0.035, 0.027, 0.023, 0.019, 0.018, 0.011, 0.010, 0.009, 0.009, 0.008, 0.007]),
         ('de', ['der', 'die', 'und', 'in', 'den', 'von', 'zu', 'das', 'mit', 'sich', 'des', 'auf'],
                [0.040, 0.038, 0.027, 0.019, 0.014, 0.012, 0.012, 0.011, 0.009, 0.008, 0.008, 0.007]),
         ('fr', ['de', 'la', 'le', 'et', 'les', 'des', 'en', 'un', 'du', 'une', 'que', 'est'],
                [0.055, 0.033, 0.025, 0.022, 0.020, 0.015, 0.013, 0.011, 0.010, 0.010, 0.009, 0.008]),
         ('es', ['de', 'la', 'que', 'el', 'en', 'y', 'los', 'se', 'del', 'un', 'las', 'por'],
                [0.062, 0.038, 0.028, 0.026, 0.024, 0.023, 0.015, 0.011, 0.011, 0.010, 0.009, 0.008])
), shares AS (
  SELECT lang, unnest(ws) AS w, unnest(qs)::DOUBLE AS q FROM word_shares
), long_docs AS (
  SELECT doc_id, n_words, words FROM base WHERE n_words >= 100
), counts AS (
  SELECT doc_id, w, count(*)::DOUBLE AS n
  FROM (SELECT doc_id, lower(trim(unnest(words), '.,;:!?"''()')) AS w FROM long_docs) GROUP BY doc_id, w
), bins AS (
  SELECT d.doc_id, d.n_words::DOUBLE AS total, s.lang, s.q, coalesce(c.n, 0) AS n
  FROM long_docs d CROSS JOIN shares s LEFT JOIN counts c ON c.doc_id = d.doc_id AND c.w = s.w
), all_bins AS (
  SELECT doc_id, lang, n / total AS p, q FROM bins
  UNION ALL
  SELECT doc_id, lang, (any_value(total) - sum(n)) / any_value(total), 1 - sum(q) FROM bins GROUP BY doc_id, lang
), word_distance AS (
  SELECT doc_id, min(d) AS d FROM (
    SELECT doc_id, lang, sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END
                                          + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2)) AS d
    FROM all_bins GROUP BY doc_id, lang) GROUP BY doc_id
)
SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND coalesce(c.d, 0) <= 0.185 AND coalesce(w.d, 0) <= 0.30 AS kept
FROM base b LEFT JOIN class_distance c ON b.doc_id = c.doc_id LEFT JOIN word_distance w ON b.doc_id = w.doc_id
"""

LINE_DEDUP = r"""
WITH lines AS (
  SELECT doc_id, i - 1 AS pos, ls[i] AS line,
         translate(trim(ls[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
       unnest(range(1, len(ls) + 1)) AS t(i)
), firsts AS (
  SELECT k, min(doc_id) AS first FROM lines WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2
), marked AS (
  SELECT l.*, f.first IS NOT NULL AND l.doc_id > f.first AS gone FROM lines l LEFT JOIN firsts f ON l.k = f.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

EMBEDDING_DEDUP = r"""
WITH RECURSIVE sound AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.9
), reach(v, r) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION
  SELECT reach.v, links.b FROM reach JOIN links ON reach.r = links.a
), least AS (
  SELECT v, min(r) AS component_id FROM reach GROUP BY v
), counts AS (
  SELECT a, count(*) AS n FROM links GROUP BY a
)
SELECT e.vec_id, coalesce(n, 0) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN least ON e.vec_id = least.v LEFT JOIN counts ON e.vec_id = counts.a
"""

DECONTAMINATION = r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark
), wins AS (
  SELECT DISTINCT item_id::VARCHAR AS item, least(10, len(ws)) AS k, array_to_string(ws[i : i + least(10, len(ws)) - 1], ' ') AS w
  FROM items, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS t(i) WHERE len(ws) > 0
), spots AS (
  SELECT doc_id, i, k, array_to_string(ws[i : i + k - 1], ' ') AS w
  FROM docs, (SELECT DISTINCT k FROM wins), unnest(range(1, len(ws) - k + 2)) AS t(i)
), hits AS (
  SELECT doc_id, i, spots.k AS k, item FROM spots JOIN wins ON spots.k = wins.k AND spots.w = wins.w
), hit_words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT DISTINCT doc_id, i, k FROM hits), unnest(range(i, i + k)) AS t(p) GROUP BY doc_id
), hit_items AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN hit_words h ON d.doc_id = h.doc_id LEFT JOIN hit_items i ON d.doc_id = i.doc_id
"""

_ROUND = """, assigned_{r} AS (
  SELECT vec_id, arg_min(c, struct_pack(d := d, c := c)) AS c, min(d) AS d FROM (
    SELECT v.vec_id, m.c, sum((v.x - m.x) * (v.x - m.x))::BIGINT AS d
    FROM cells v JOIN centroids_{r} m ON v.k = m.k GROUP BY v.vec_id, m.c) GROUP BY vec_id
), centroids_{n} AS (
  SELECT m.c, m.k, coalesce(g.x, m.x) AS x
  FROM centroids_{r} m LEFT JOIN (
    SELECT a.c, v.k, CASE WHEN sum(v.x) >= 0 THEN sum(v.x) // count(*) ELSE -((count(*) - 1 - sum(v.x)) // count(*)) END::BIGINT AS x
    FROM assigned_{r} a JOIN cells v ON a.vec_id = v.vec_id GROUP BY a.c, v.k) g ON m.c = g.c AND m.k = g.k
)"""

VANTAGE_CLUSTERS = (
    """
WITH kept AS (
  SELECT vec_id, list_transform(embedding, lambda e: floor(64 * e::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
), cells AS (
  SELECT vec_id, unnest(x) AS x, unnest(range(64)) AS k FROM kept
), starts AS (
  SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS c, vec_id FROM kept QUALIFY c < 16
), centroids_0 AS (
  SELECT c, k, x FROM starts JOIN cells ON starts.vec_id = cells.vec_id
)"""
    + "".join(_ROUND.format(r=r, n=r + 1) for r in range(4))
    + """, named AS (
  SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY k)) AS centroid_sha256 FROM centroids_3 GROUP BY c
)
SELECT vec_id, a.c::INTEGER AS cluster, d AS distance, sum(d) OVER (PARTITION BY a.c)::BIGINT AS cluster_inertia,
       sum(d) OVER ()::BIGINT AS inertia, centroid_sha256
FROM assigned_3 a JOIN named ON a.c = named.c
"""
)

ORACLE: dict[str, str] = {
    "op1_quality_rules": QUALITY_RULES,
    "op5_line_dedup": LINE_DEDUP,
    "op10_embedding_dedup": EMBEDDING_DEDUP,
    "op12_decontamination": DECONTAMINATION,
    "op13_vantage_clusters": VANTAGE_CLUSTERS,
}
