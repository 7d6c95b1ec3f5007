"""The queries as SQL, for those that SQL can express. The others are tested against brute force."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACES = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LINES = "string_split(coalesce(text, ''), chr(10))"
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP1 = f"""
WITH lines AS (
  SELECT doc_id, unnest({_LINES}) AS line, unnest(range(len({_LINES}))) AS pos FROM documents
), keyed AS (
  SELECT *, translate(trim(line, {_SPACES}), '{_UPPER}', '{_LOWER}') AS key FROM lines
), held AS (
  SELECT key, max(doc_id) AS holder FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT k.*, coalesce(h.holder <> k.doc_id, false) AS gone FROM keyed k LEFT JOIN held h USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

OP5 = rf"""
WITH base AS (
  SELECT doc_id, lang, coalesce(text, '') AS t, {_WORDS} AS w,
    list_filter({_LINES}, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents
), windows AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM base)
), twice AS (
  SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1
), repeats AS (
  SELECT doc_id, count(DISTINCT i + d) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS d) GROUP BY doc_id
), counted AS (
  SELECT b.doc_id, lang, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    length(regexp_replace(t, '[^A-Z!]', '', 'g')) AS n_shout, len(l) AS n_lines,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words
  FROM base b LEFT JOIN repeats r USING (doc_id)
), scored AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    [CASE WHEN n_words > 0 THEN least(1.0::DOUBLE, n_symbols / n_words) ELSE 0 END,
     CASE WHEN word_chars > 0 THEN least(1.0::DOUBLE, n_shout / word_chars) ELSE 0 END,
     CASE WHEN n_lines > 0 THEN least(1.0::DOUBLE, n_dup_lines / n_lines) ELSE 0 END,
     CASE WHEN n_words > 0 THEN least(1.0::DOUBLE, n_repeat_words / n_words) ELSE 0 END] AS ratios
  FROM counted
), counts AS (
  SELECT lang, rule, ceil(ratio * 100)::INT AS bucket, sum(good) AS good, sum(1 - good) AS bad FROM (
    SELECT lang, unnest(ratios) AS ratio, unnest([1, 2, 3, 4]) AS rule, good
    FROM scored JOIN (SELECT doc_id, max(quality) AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id) USING (doc_id)
  ) GROUP BY ALL
), tested AS (
  SELECT lang, rule, bucket,
    coalesce(sum(good) OVER (looser ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k,
    coalesce(sum(bad) OVER (looser ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b,
    sum(good) OVER (PARTITION BY lang, rule) AS n,
    (SELECT count(*) FROM (SELECT DISTINCT lang, rule FROM counts)) AS tests
  FROM counts WINDOW looser AS (PARTITION BY lang, rule ORDER BY bucket DESC)
), tails AS (
  SELECT *, CASE WHEN n > 0 AND k < n * 0.005 THEN list_sum(list_transform(range(k::BIGINT + 1),
    lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln(0.005) + (n - j) * ln(0.995)))) ELSE 1 END AS p
  FROM tested
), passed AS (
  SELECT *, max((p > 0.05 / tests)::INT) OVER (PARTITION BY lang, rule ORDER BY bucket DESC) AS failed FROM tails
), cutoffs AS (
  SELECT lang, rule, arg_max(bucket / 100.0, (b - k) * 1000 + bucket) AS cutoff
  FROM passed WHERE failed = 0 AND b > 0 GROUP BY lang, rule
), broken AS (
  SELECT DISTINCT doc_id FROM (SELECT doc_id, lang, unnest(ratios) AS ratio, unnest([1, 2, 3, 4]) AS rule FROM scored) s
  JOIN cutoffs c ON c.lang IS NOT DISTINCT FROM s.lang AND c.rule = s.rule AND ratio > cutoff::DOUBLE
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM broken) AS kept
FROM scored
"""

_BARE = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP8 = f"""
WITH items AS (
  SELECT item_id::VARCHAR AS item, {_BARE} AS w, least(10, len(w)) AS size FROM benchmark
), windows AS (
  SELECT DISTINCT item, size, array_to_string(w[i : i + size - 1], ' ') AS g
  FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS i FROM items WHERE size > 0)
), docs AS (
  SELECT doc_id, {_BARE} AS w FROM documents
), grams AS (
  SELECT doc_id, i, size, array_to_string(w[i : i + size - 1], ' ') AS g
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i
        FROM docs, (SELECT DISTINCT size FROM windows) WHERE len(w) >= size)
), hits AS (
  SELECT doc_id, i, size, item FROM grams JOIN windows USING (size, g)
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hits) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(c.n, 0) AS n_hit, coalesce(m.n, 0) AS n_items,
  sha256(coalesce(m.items, '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated
FROM docs d LEFT JOIN covered c USING (doc_id) LEFT JOIN named m USING (doc_id)
"""

OP12 = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

OP13 = r"""
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || doc_id) AS h,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u
  FROM documents
), drawn AS (
  SELECT *, len(u) AS n, ('0x' || h[1:8])::BIGINT % (len(u) + 1) AS one, ('0x' || h[9:16])::BIGINT % (len(u) + 1) AS two,
    ('0x' || h[17:24])::BIGINT % 100 AS chance, ('0x' || h[25:32])::BIGINT % 100 AS turn
  FROM units
), cut AS (
  SELECT *, coalesce(array_to_string(u[1 : least(one, two)], ''), '') AS p,
    coalesce(array_to_string(u[least(one, two) + 1 : greatest(one, two)], ''), '') AS m,
    coalesce(array_to_string(u[greatest(one, two) + 1 : n], ''), '') AS s,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR chance >= 50 THEN 'plain'
      WHEN turn < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn
)
SELECT doc_id, n, form,
  CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
    ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM cut
"""

ORACLE_SQL: dict[str, str] = {
    "op1_line_dedup": OP1,
    "op5_quality_rules": OP5,
    "op8_decontamination": OP8,
    "op12_exact_dedup": OP12,
    "op13_fill_middle": OP13,
}
