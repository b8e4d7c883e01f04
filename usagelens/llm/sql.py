"""The same results in SQL for another engine (DuckDB)."""

from usagelens.llm.licenses import BASE, COVER, GAP, NOTICES, Template

LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

WORDS = f"[x for x in regexp_split_to_array({LOWERED}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') if x <> '']"


def license_sql(templates: tuple[Template, ...]) -> str:
    rows = ", ".join(f"({i}, '{t.label}', {str(t.base).lower()}, string_split('{t.words}', ' '))" for i, t in enumerate(templates))
    return f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, {WORDS} AS w FROM documents),
t(t, label, base, w) AS (VALUES {rows}),
g AS (SELECT t, label, base, len(w) - 2 AS runs, i - 1 AS at, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT *, unnest(range(1, len(w) - 1)) AS i FROM t)),
r AS (SELECT k, i - 1 AS at, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT k, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
v AS (SELECT k, t, label, base, runs, r.at - g.at AS diagonal, list(DISTINCT g.at) AS offsets FROM r JOIN g USING (a, b, c) GROUP BY ALL),
o AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY k, t ORDER BY diagonal) <= {GAP} THEN 0 ELSE 1 END AS opens FROM v),
m AS (SELECT *, sum(opens) OVER (PARTITION BY k, t ORDER BY diagonal) AS band FROM o),
s AS (SELECT k, t, label, len(list_distinct(flatten(list(offsets)))) / any_value(runs)::DOUBLE AS coverage FROM m GROUP BY k, t, label, band),
f AS (SELECT k, label, coverage, NULL AS start FROM s WHERE coverage >= {COVER}
      UNION ALL SELECT k, label, 1.0, diagonal FROM v WHERE base AND len(offsets) = runs),
x AS (SELECT k, count(start) AS n_base, min(start) AS first_word, max(start) AS last_word,
      string_agg(DISTINCT CASE WHEN start IS NOT NULL THEN label END, ',' ORDER BY CASE WHEN start IS NOT NULL THEN label END) AS base_labels,
      string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(coverage) AS score FROM f GROUP BY k)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN x USING (k)
"""


OP3 = f"""
WITH d AS (SELECT doc_id, sha256({LOWERED}) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""

OP4 = r"""
WITH u AS (
  SELECT page_id, url, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), r(rule_host, rule_path, says) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), n AS (SELECT *, row_number() OVER () AS k FROM p)
SELECT page_id, host, path, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
       coalesce(arg_max(says, length(rule_host || rule_path)), 'allow') AS verdict
FROM n LEFT JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
GROUP BY k, page_id, host, path
"""

OP8 = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][1 + (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3] AS w
  FROM d GROUP BY source
), o AS (
  SELECT *, 2.0 * source_size AS cap, 1.5 * sum(source_size) OVER () AS total, sum(w) OVER () AS all_w,
         coalesce(sum(2.0 * source_size) OVER b, 0) AS cap_before, coalesce(sum(w) OVER b, 0) AS w_before,
         row_number() OVER (ORDER BY 2.0 * source_size / w, encode(source)) AS i
  FROM s WINDOW b AS (ORDER BY 2.0 * source_size / w, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), l AS (
  SELECT (total - cap_before) / (all_w - w_before) AS level FROM o WHERE cap >= w * (total - cap_before) / (all_w - w_before) ORDER BY i LIMIT 1
), t AS (
  SELECT source, source_size, least(cap, w * level) AS target,
         ('0x' || substr(md5('mix' || CASE WHEN source IS NULL THEN '' ELSE '=' || source END), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
  FROM o, l
), p AS (
  SELECT doc_id, size, t.*, row_number() OVER (PARTITION BY d.source ORDER BY size, doc_id) AS k,
         CASE WHEN source_size > 0 THEN least(2.0::DOUBLE, target / source_size) ELSE 0 END AS e
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target::DOUBLE AS target, ((floor(k * e + u) - floor((k - 1) * e + u)) * size)::BIGINT AS taken FROM p
"""

OP13 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), u AS (
  SELECT doc_id, t, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w, ('0x' || h[1:8])::BIGINT AS h1,
         ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d
), c AS (
  SELECT doc_id, t, len(w)::BIGINT AS n, CASE WHEN t = '' OR regexp_matches(t, '<[PSM]>') OR h3 % 100 >= 50 THEN 'plain'
         WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form, w,
         least(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS low, greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS high FROM u
), p AS (
  SELECT *, array_to_string(w[1:low], '') AS prefix, array_to_string(w[low + 1:high], '') AS middle, array_to_string(w[high + 1:], '') AS suffix FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256
FROM p
"""

ORACLES = {"op1_licenses": license_sql(BASE + NOTICES), "op3_exact_dedup": OP3, "op4_url_filter": OP4, "op8_mixing": OP8, "op13_fill_middle": OP13}
