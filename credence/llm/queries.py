"""The queries of this subpackage and their SQL, for the driver contract."""

from __future__ import annotations

from .ann import op1_ann
from .bpe import op3_bpe
from .changepoints import op11_changepoints
from .chat import op12_chat
from .jaccard import op5_jaccard
from .langid import op8_language
from .packing import op2_pack
from .periodic import op13_periodic
from .pii import op4_pii
from .quality import op6_quality
from .secrets import op10_secrets
from .token_store import op9_token_store
from .vector_dedup import op7_vector_dedup


def queries() -> dict:
    return {
        "op1_ann": op1_ann,
        "op2_pack": op2_pack,
        "op3_bpe": op3_bpe,
        "op4_pii": op4_pii,
        "op5_jaccard": op5_jaccard,
        "op6_quality": op6_quality,
        "op7_vector_dedup": op7_vector_dedup,
        "op8_language": op8_language,
        "op9_token_store": op9_token_store,
        "op10_secrets": op10_secrets,
        "op11_changepoints": op11_changepoints,
        "op12_chat": op12_chat,
        "op13_periodic": op13_periodic,
    }


#: Every pair of vectors: right for small tables, too slow for large ones.
_VECTOR_DEDUP = """WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL),
 l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
 r AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
 c AS (SELECT x, min(y) AS m FROM r GROUP BY x), n AS (SELECT x, count(*) AS k FROM l GROUP BY x)
 SELECT v.vec_id, coalesce(n.k, 0) AS n_links, least(v.vec_id, coalesce(c.m, v.vec_id)) AS component_id, v.vec_id <= coalesce(c.m, v.vec_id) AS kept
 FROM v LEFT JOIN n ON n.x = v.vec_id LEFT JOIN c ON c.x = v.vec_id"""

#: The plain recurrence: for each end day all starts, day by day; then the cuts backwards.
_CHANGE_POINTS = """WITH RECURSIVE d AS (SELECT vendor_id, CAST(shipped_at AS DATE) AS d, CAST(sum(quantity) AS BIGINT) AS q FROM sale_lines
  WHERE flag = 'kept' AND quantity IS NOT NULL AND shipped_at IS NOT NULL GROUP BY ALL),
 g AS (SELECT vendor_id, f, unnest(range(0, date_diff('day', f, t) + 1)) AS i FROM (SELECT vendor_id, min(d) AS f, max(d) AS t FROM d GROUP BY vendor_id)),
 x AS (SELECT g.vendor_id, g.f, g.i, coalesce(d.q, 0) AS q FROM g LEFT JOIN d ON d.vendor_id IS NOT DISTINCT FROM g.vendor_id AND d.d = g.f + CAST(g.i AS INTEGER)),
 p AS (SELECT vendor_id, f, i, sum(q) OVER w AS s, sum(q * q) OVER w AS r FROM x WINDOW w AS (PARTITION BY vendor_id ORDER BY i)),
 v AS (SELECT vendor_id, f, count(*) AS n, list_prepend(0, list(CAST(s AS BIGINT) ORDER BY i)) AS s, list_prepend(0, list(CAST(r AS BIGINT) ORDER BY i)) AS r FROM p GROUP BY vendor_id, f),
 a AS (SELECT vendor_id, f, n, s, r, least(6, n) AS e, CASE WHEN n < 7 THEN 0 ELSE 6 END AS m,
   [{'c': -20000, 'k': 0, 's': 0}] || list_transform(range(1, least(7, n + 1)), lambda i: {'c': NULL, 'k': 0, 's': 0}) AS b FROM v
  UNION ALL SELECT vendor_id, f, n, s, r, e + 1, m, list_append(b, list_min(list_transform(list_filter(range(0, e + 2 - 7), lambda i: b[i + 1].c IS NOT NULL),
   lambda i: {'c': b[i + 1].c + 20000 + (e + 1 - i) * CAST(floor(1000 * ln(1 + ((e + 1 - i) * (r[e + 2] - r[i + 1]) - (s[e + 2] - s[i + 1]) * (s[e + 2] - s[i + 1])) // ((e + 1 - i) * (e + 1 - i)))) AS BIGINT), 'k': b[i + 1].k + 1, 's': i})))
  FROM a WHERE e < n),
 z AS (SELECT vendor_id, f, n, s, r, b, n AS t, CASE WHEN n < 7 THEN 0 ELSE b[n + 1].s END AS h FROM a WHERE e = n
  UNION ALL SELECT vendor_id, f, n, s, r, b, h, b[h + 1].s FROM z WHERE h > 0),
 o AS (SELECT vendor_id, f, h, t - h AS n, s[t + 1] - s[h + 1] AS total, 1 + ((t - h) * (r[t + 1] - r[h + 1]) - (s[t + 1] - s[h + 1]) * (s[t + 1] - s[h + 1])) // ((t - h) * (t - h)) AS spread FROM z),
 c AS (SELECT *, n * CAST(floor(1000 * ln(spread)) AS BIGINT) AS cost FROM o)
 SELECT vendor_id, CAST(row_number() OVER (PARTITION BY vendor_id ORDER BY h) AS INTEGER) AS segment_no, CAST(date_diff('day', DATE '1970-01-01', f) + h AS BIGINT) AS first_day,
  n AS n_days, total, spread, cost, count(*) OVER (PARTITION BY vendor_id) AS n_segments,
  CAST(sum(cost) OVER (PARTITION BY vendor_id) + 20000 * (count(*) OVER (PARTITION BY vendor_id) - 1) AS BIGINT) AS best_cost FROM c"""

_CHAT = r"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
 g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
  coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (WHERE role = 'assistant'), '') AS loss,
  CAST(sum(23 + length(replace(replace(role, '\', '\\'), '<|', '<\|')) + length(replace(replace(text, '\', '\\'), '<|', '<\|'))) AS BIGINT) AS formatted_chars FROM t GROUP BY conv_id)
 SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g"""


def oracle_sql() -> dict[str, str]:
    return {"op7_vector_dedup": _VECTOR_DEDUP, "op11_changepoints": _CHANGE_POINTS, "op12_chat": _CHAT}
