"""SQL of what the operators' queries give, and queries that show the columns SQL can give
where a model makes the rest.  Every one runs over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import pii, quality

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = "[^\\x20\\x09-\\x0D]+"
_LOW = f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')"

NGRAM_JACCARD = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOW}, '{_WORD}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM d, unnest(range(1, greatest(len(w) - 3, 2))) t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * shared >= 80 * (p.n + q.n - shared)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, e.y FROM r JOIN e ON e.x = r.b)
SELECT r.a AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.b) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.a GROUP BY r.a
"""

DECONTAMINATION = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOW}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOW}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(len(w), 10) AS l, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS g FROM b, unnest(range(1, len(w) - least(len(w), 10) + 2)) t(i) WHERE len(w) > 0),
dw AS (SELECT r, i, l, array_to_string(w[i : i + l - 1], ' ') AS g FROM d, (SELECT DISTINCT l FROM bw) k, unnest(range(1, greatest(len(w) - l + 2, 1))) t(i)),
h AS (SELECT r, i, dw.l, item FROM dw JOIN bw ON bw.l = dw.l AND bw.g = dw.g),
p AS (SELECT r, count(DISTINCT pos) AS n_hit FROM (SELECT DISTINCT r, i, l FROM h) x, unnest(range(x.i, x.i + x.l)) t(pos) GROUP BY r),
m AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h WHERE item IS NOT NULL) x GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p ON p.r = d.r LEFT JOIN m ON m.r = d.r
"""

QUALITY = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
l AS (SELECT r, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
g AS (SELECT r, i, array_to_string(w[i : i + 2], ' ') AS g FROM d, unnest(range(1, greatest(len(w) - 1, 1))) t(i)),
a AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS k FROM g),
p AS (SELECT r, count(DISTINCT pos) AS n FROM a, unnest(range(i, i + 3)) t(pos) WHERE k > 1 GROUP BY r),
s AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(l.l) - len(list_distinct(l.l)) AS BIGINT) AS n_dup_lines, coalesce(p.n, 0) AS n_repeat_words
  FROM d JOIN l ON l.r = d.r LEFT JOIN p ON p.r = d.r)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s
"""


def quality_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3 without what its model decides."""
    return quality.op3(spark, sf_dir).select("doc_id", *quality.STATS, "base_failed")


def _matches(kind: str, pattern: str, test: str) -> str:
    """Rows (doc_id, kind, start, end) of the matches of a pattern that pass a test: a match
    starts after the gaps and matches before it."""
    return f"""SELECT doc_id, '{kind}' AS kind, s, s + length(m) AS e FROM (
  SELECT doc_id, m[i] AS m, coalesce(list_sum(list_transform(g[1 : i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1 : i - 1], lambda x: length(x))), 0) AS s
  FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS m, string_split_regex(t, '{pattern}') AS g FROM d), unnest(range(1, len(m) + 1)) u(i)) WHERE {test}"""


_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(length({_DIGITS})), lambda j: CASE WHEN j % 2 = 0 THEN CAST(substr(reverse({_DIGITS}), j + 1, 1) AS INTEGER) ELSE CAST(substr(reverse({_DIGITS}), j + 1, 1) AS INTEGER) * 2 - CASE WHEN substr(reverse({_DIGITS}), j + 1, 1) > '4' THEN 9 ELSE 0 END END)) % 10 = 0"
_PARTS = "len(list_filter(string_split(m, '.'), lambda x: length(ltrim(x, '0')) > 3 OR coalesce(TRY_CAST(x AS HUGEINT), 256) > 255)) = 0"
PII_BASE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS ({_matches("email", "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:[.][A-Za-z0-9-]+)+", "true")}
UNION ALL {_matches("ip", "[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+", _PARTS)}
UNION ALL {_matches("card", "[0-9](?:[\\x20-]?[0-9])+", f"length({_DIGITS}) BETWEEN 13 AND 19 AND {_LUHN}")}
UNION ALL {_matches("phone", "[+][0-9][\\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 9 AND 15")}),
k AS (SELECT doc_id, {', '.join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in pii.KINDS)}, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY list_position(['email', 'ip', 'card', 'phone'], kind), s) AS spans FROM f GROUP BY doc_id)
SELECT d.doc_id, {', '.join(f"coalesce(n_{k}, 0) AS n_{k}" for k in pii.KINDS)}, sha256(coalesce(spans, '')) AS base_sha256 FROM d LEFT JOIN k ON k.doc_id = d.doc_id
"""


def pii_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1 without what its tagger adds."""
    return pii.op1(spark, sf_dir).select("doc_id", *(f"n_{k}" for k in pii.KINDS), "base_sha256")
