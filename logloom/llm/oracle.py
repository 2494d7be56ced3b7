"""DuckDB SQL for the registered queries that SQL can express."""

#: One round: every part's nearest entry (d * 64 + entry, the least), then the averages.
CODES = """
  a{n} AS (SELECT row, part, any_value(v) AS v, min(64 * list_sum(list_transform(list_zip(v, e),
      lambda z: (z[1] - z[2]) * (z[1] - z[2]))) + entry)::BIGINT AS best
    FROM p JOIN c{n} USING (part) GROUP BY row, part),"""
ROUND = CODES + """
  s{n} AS (SELECT part, best % 64 AS entry, i, sum(v[i])::BIGINT AS s, count(*) AS k
    FROM a{n}, range(1, 1 + (SELECT max(width) FROM r)) AS t(i) GROUP BY ALL),
  f{n} AS (SELECT part, entry, list((s - (s % k + k) % k) // k ORDER BY i) AS e
    FROM s{n} GROUP BY ALL),
  c{m} AS (SELECT part, entry, coalesce(f{n}.e, c{n}.e) AS e
    FROM c{n} LEFT JOIN f{n} USING (part, entry)),"""
PART_CODES = """
WITH r AS (SELECT row_number() OVER () AS row, vec_id, label, len(embedding) // 16 AS width,
      list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS ints
    FROM embeddings WHERE embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  p AS (SELECT row, part, ints[part * width + 1:part * width + width] AS v
    FROM r, range(0, 16) AS t(part)),
  c0 AS (SELECT part, entry, v AS e FROM p JOIN (SELECT row,
      row_number() OVER (ORDER BY vec_id NULLS LAST, ints) - 1 AS entry FROM r) USING (row)
    WHERE entry < 64),""" + ROUND.format(n=0, m=1) + ROUND.format(n=1, m=2) + CODES.format(
    n=2) + """
  b AS (SELECT row, string_agg(lower(printf('%02x', best % 64)), '' ORDER BY part) AS code,
      sum(best // 64)::BIGINT AS error FROM a2 GROUP BY row)
SELECT vec_id, label, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
    (SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY part, entry)) FROM c2)
      AS codebooks_sha256 FROM r JOIN b USING (row)
"""

ORACLE = {
    "op8_mixing": r"""
WITH d AS (SELECT doc_id, source, md5(coalesce(doc_id::VARCHAR, '')) AS k,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
  s AS (SELECT source, sum(size)::BIGINT AS source_size,
    (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS i FROM d GROUP BY source),
  w AS (SELECT *, 2.0::DOUBLE * source_size AS cap,
    CASE i WHEN 0 THEN 4.5 WHEN 1 THEN 1.0 ELSE 1.0 END::DOUBLE AS w0,
    CASE i WHEN 0 THEN -3.0 WHEN 1 THEN 0.0 ELSE 2.0 END::DOUBLE AS slope,
    CASE i WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END::DOUBLE AS weight FROM s),
  l AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER p, 0))
      / (sum(weight) OVER () - coalesce(sum(weight) OVER p, 0)) AS level FROM w
    WINDOW p AS (ORDER BY cap / weight, source NULLS LAST
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  t AS (SELECT *, coalesce(least(cap, weight * max(
      CASE WHEN level * weight < cap THEN level END) OVER ()), cap) AS target FROM l),
  o AS (SELECT d.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY k, doc_id, size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d),
  j AS (SELECT o.*, t.source_size, t.target, t.w0, t.slope, t.weight,
      CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole
    FROM o JOIN t ON o.source IS NOT DISTINCT FROM t.source),
  k AS (SELECT *, (whole * size + greatest(0, least(size,
      floor(target)::BIGINT - whole * source_size - before)))::BIGINT AS taken,
      before / target * weight AS a FROM j)
SELECT doc_id, size::BIGINT AS size, source_size, target, taken, round(CASE WHEN taken > 0
    THEN 0.0::DOUBLE + 2 * a / (w0 + sqrt(w0 * w0 + 2 * slope * a)) END, 6) AS position FROM k
""",
    "op9_exact_dedup": """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
    doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM d WINDOW g AS (PARTITION BY t)
""",
    # two rounds of assignment and averaging; the final assignment is the third
    "op11_part_codes": PART_CODES,
    "op12_decontamination": r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(
      coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
  b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
  i AS (SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS t FROM (
      SELECT *, unnest(range(1, len(w) - n + 2)) AS s FROM (
        SELECT *, least(len(w), 10) AS n FROM b WHERE len(w) > 0))),
  k AS (SELECT row, s, n, array_to_string(w[s:s + n - 1], ' ') AS t FROM (
      SELECT row, w, n, unnest(range(1, len(w) - n + 2)) AS s
      FROM d, (SELECT DISTINCT n FROM i) WHERE len(w) >= n)),
  h AS (SELECT DISTINCT k.row, k.s, k.n, i.item_id FROM k JOIN i ON k.n = i.n AND k.t = i.t),
  c AS (SELECT row, count(*) AS n_hit FROM (SELECT DISTINCT row, unnest(range(s, s + n))
      FROM h) GROUP BY row),
  g AS (SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT row, item_id::VARCHAR AS item FROM h WHERE item_id IS NOT NULL)
      GROUP BY row)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
    coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (row) LEFT JOIN g USING (row)
""",
    "op13_filter_audit": r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
      regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
  m AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good,
      coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
  r AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
      CASE WHEN len(w) < 200 THEN 'A' ELSE '' END
      || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
      || CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 2 * length(t) THEN 'C' ELSE '' END
      || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
      || CASE WHEN d.doc_id > min(d.doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS f
    FROM d LEFT JOIN m USING (doc_id)),
  u AS (SELECT part, good, toxic, f, count(*) AS n FROM r GROUP BY ALL),
  l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
  o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order
    FROM l AS a, l AS b, l AS c, l AS d, l AS e
    WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
  q AS (SELECT filter_order, step, filter_order[step:step] AS x,
      filter_order[1:step - 1] AS earlier FROM o, range(1, 6) AS s(step)),
  z AS (SELECT u.*, filter_order, step, x, contains(f, x) AS fails,
      translate(f, earlier, '') <> f AS gone FROM u, q),
  s AS (SELECT part, filter_order, step, x,
      sum(n) FILTER (WHERE NOT fails AND NOT gone) AS kept,
      sum(n) FILTER (WHERE fails AND NOT gone) AS removed,
      sum(n) FILTER (WHERE fails AND gone) AS redundant,
      sum(n) FILTER (WHERE f = x) AS unique_fails,
      sum(n) FILTER (WHERE fails AND NOT gone AND good) AS good_lost,
      sum(n) FILTER (WHERE fails AND NOT gone AND toxic) AS toxic_lost FROM z GROUP BY ALL)
SELECT part, filter_order, step::INTEGER AS step, coalesce(kept, 0)::BIGINT AS kept,
    coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
    coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost,
    coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
    coalesce(sum(removed) OVER (PARTITION BY part, x), 0)::BIGINT AS shapley FROM s
""",
}
