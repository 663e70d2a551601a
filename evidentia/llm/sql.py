"""DuckDB SQL of the operators that SQL can express."""

from __future__ import annotations


def _op8() -> str:
    from evidentia.llm.urlfilter import BUCKETS, RULES, weights

    bias, w = weights()
    fits = lambda h, p: f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))"
    longest = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
    rule = " ".join(f"WHEN {fits(h, p)} THEN '{h + p}'" for h, p, _ in longest)
    verdict = " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for h, p, v in longest)
    grams = lambda x, f: f"CASE WHEN length({x}) = 0 THEN [] ELSE list_transform(range(1, length({x}) + 1), lambda i: (unicode(substring('^' || {x} || '$', i, 1)) * 961 + unicode(substring('^' || {x} || '$', i + 1, 1)) * 31 + unicode(substring('^' || {x} || '$', i + 2, 1)) + {2017 * f}) % {BUCKETS}) END"
    return f"""
WITH w AS (SELECT {list(w)} AS w),
a AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substring(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
c AS (SELECT page_id, host, path, list_distinct(list_concat({grams('host', 0)}, {grams('path', 1)})) AS grams FROM b),
d AS (SELECT page_id, host, path, {bias} + coalesce(list_sum(list_transform(grams, lambda g: w.w[g + 1])), 0) AS logit FROM c, w)
SELECT page_id, host, path, CASE {rule} END AS rule, CASE {verdict} WHEN logit >= 0 THEN 'block' ELSE 'allow' END AS verdict FROM d"""


_OP10 = """
WITH v AS (SELECT row_number() OVER () AS own, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.own, a.vec_id AS query_id, b.vec_id AS vec_id, list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.own <> b.own),
r AS (SELECT query_id, row_number() OVER (PARTITION BY own ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"""


def statements() -> dict[str, str]:
    return {"op8_url_filter": _op8(), "op10_topk": _OP10}
