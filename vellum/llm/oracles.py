"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from vellum.llm import collocations, mixing
from vellum.llm.secrets import RULES

EXACT_DEDUP = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""


def _hits(number: int) -> str:
    """Matches of one rule with their place, size and the gap before them."""
    rule = RULES[number]
    pattern = "'" + rule.pattern.replace("'", "''") + "'"
    return f"""SELECT r, {number} AS kind, unnest(range(len(h))) AS i, unnest(h) AS hit, unnest(p[:len(h)]) AS gap, unnest(g) AS part
  FROM (SELECT r, regexp_extract_all(t, {pattern}) AS h, string_split_regex(t, {pattern}) AS p, regexp_extract_all(t, {pattern}, {rule.measured}) AS g FROM d)"""


SECRETS = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
h AS ({" UNION ALL ".join(_hits(k) for k in range(len(RULES)))}),
e AS (SELECT r, kind, length(hit) AS size, length(part) AS part, sum(length(hit) + length(gap)) OVER (PARTITION BY r, kind ORDER BY i) AS stop FROM h),
s AS (SELECT r, kind, stop - size AS start, [{", ".join(f"'{rule.kind}'" for rule in RULES)}][kind + 1] || ':' || (stop - size) || ':' || stop AS span
      FROM e WHERE part >= [{", ".join(str(rule.least) for rule in RULES)}][kind + 1]),
a AS (SELECT r, count(*) FILTER (kind = 0) AS n0, count(*) FILTER (kind = 1) AS n1, count(*) FILTER (kind = 2) AS n2, count(*) AS n,
             string_agg(span, ',' ORDER BY start, kind) AS spans, string_agg(span, ',' ORDER BY start, kind) FILTER (kind < {sum(rule.base for rule in RULES)}) AS base FROM s GROUP BY r)
SELECT doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n, 0) AS n_spans
FROM d LEFT JOIN a USING (r)
"""

MIXING = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
p AS (SELECT *, ('0x' || left(md5('{mixing.SEED}|' || coalesce(doc_id::VARCHAR, '') || '|' || size), 15))::BIGINT AS place FROM d),
s AS (SELECT source, sum(size)::BIGINT AS n, row_number() OVER (ORDER BY source IS NULL, source ) AS k FROM p GROUP BY source),
w AS (SELECT source, n, [{", ".join(f"{x}.0::DOUBLE" for x in mixing.WEIGHTS)}][((k - 1) % {len(mixing.WEIGHTS)} + 1)::INT] AS weight, n * {mixing.MAX_EPOCHS}.0::DOUBLE AS cap FROM s),
c AS (SELECT *, cap / weight AS ratio, sum(cap) OVER o AS cap_to, sum(weight) OVER o AS weight_to, sum(n) OVER ()::DOUBLE AS total, sum(weight) OVER () AS weights FROM w
      WINDOW o AS (ORDER BY cap / weight, source ROWS UNBOUNDED PRECEDING)),
l AS (SELECT *, (total - (cap_to - cap)) / (weights - (weight_to - weight)) AS level FROM c),
g AS (SELECT arg_min(level, ratio) AS level FROM l WHERE level <= ratio),
t AS (SELECT source, n AS source_size, least(weight * g.level, cap) AS target FROM w, g),
u AS (SELECT *, floor(least(CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END, {mixing.MAX_EPOCHS}) + 1e-9) AS whole FROM t),
v AS (SELECT p.*, source_size, target, whole, greatest(target - whole * source_size, 0) AS due, size > {mixing.LARGE}::DOUBLE * source_size AS large FROM p JOIN u ON p.source IS NOT DISTINCT FROM u.source),
x AS (SELECT *, coalesce(sum(size) OVER q, 0) AS before, sum(size) OVER (PARTITION BY source, large) AS part FROM v
      WINDOW q AS (PARTITION BY source, large ORDER BY CASE WHEN large THEN 0 ELSE place % {mixing.BUCKETS} END, place, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
y AS (SELECT *, large AND due * part / source_size > 0 AND 2 * before + size <= 2 * (due * part / source_size) AS big FROM x),
z AS (SELECT *, coalesce(sum(size) FILTER (big) OVER (PARTITION BY source), 0) AS given FROM y),
m AS (SELECT *, least(whole + CASE WHEN size > 0 AND (big OR (NOT large AND due - given > 0 AND 2 * before + size <= 2 * (due - given))) THEN 1 ELSE 0 END, {mixing.MAX_EPOCHS})::INT AS repeats FROM z)
SELECT doc_id, size, source_size, target, size * repeats AS taken, repeats FROM m
"""

COLLOCATIONS = f"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM d),
s AS (SELECT lang, sum(len(words))::HUGEINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM w),
h AS (SELECT lang, words, i, unnest(range(1, least({collocations.LONGEST}, len(words) - i + 1) + 1)) AS k FROM g),
f AS (SELECT lang, words[i:i + k - 1] AS p, k, count(*)::HUGEINT AS f FROM h GROUP BY ALL),
c AS (SELECT * FROM f WHERE k > 1 AND f >= {collocations.LEAST}),
u AS (SELECT c.lang, c.p, c.f AS a, x.f AS l, y.f AS r, n, cut, 1000 * c.f * n // (x.f * y.f) AS score
      FROM (SELECT *, unnest(range(1, k)) AS cut FROM c) c JOIN s USING (lang) JOIN f x ON x.lang = c.lang AND x.p = c.p[:cut] JOIN f y ON y.lang = c.lang AND y.p = c.p[cut + 1:]),
v AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, cut) = 1),
o AS (SELECT DISTINCT lang, unnest([p[:k - 1], p[2:]]) AS p, f AS a FROM c WHERE k > 2),
t AS (SELECT lang, array_to_string(p, ' ') AS phrase, a, l, r, n, score FROM v ANTI JOIN o USING (lang, p, a))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM t QUALIFY rank <= {collocations.TOP}
"""

ORACLES = {"op11_collocations": COLLOCATIONS, "op2_mixing": MIXING, "op4_secrets": SECRETS, "secrets_in_arrivals": SECRETS, "op10_exact_dedup": EXACT_DEDUP}
