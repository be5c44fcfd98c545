from __future__ import annotations

from .catalog import register
from .flagship import target_encoding_auc
from .sqlfrag import ws_split

FLAGSHIP_SQL = r"""
WITH c AS (
  SELECT d.doc_id, d.source, l.toxic, l.quality,
         regexp_replace(lower(coalesce(d.text, 'CVxTz')), '[^\p{L}\p{N}_]+', ' ', 'g') AS t
  FROM documents d LEFT JOIN labels l USING (doc_id)
), lng AS (
  SELECT doc_id, source, t, 'toxic' AS label, toxic AS y FROM c
  UNION ALL
  SELECT doc_id, source, t, 'quality' AS label, quality AS y FROM c
), stats AS (
  SELECT label, source, avg(y) AS m, count(*) AS n, sum(y) AS s
  FROM lng WHERE y IS NOT NULL GROUP BY label, source
), pri AS (
  SELECT label, sum(s) / sum(n) AS prior FROM stats GROUP BY label
), enc AS (
  SELECT st.label, st.source,
         p.prior * (1 - 1 / (1 + exp(-(n - 100) / 10.0))) + m * (1 / (1 + exp(-(n - 100) / 10.0))) AS e
  FROM stats st JOIN pri p USING (label)
), scored AS (
  SELECT l.label, l.y, coalesce(e.e, p.prior) AS score,
         len(__WS__) AS nw
  FROM lng l LEFT JOIN enc e USING (label, source) LEFT JOIN pri p USING (label)
  WHERE l.y IS NOT NULL
), per AS (
  SELECT label, score, sum(CASE WHEN y = 1 THEN 1 ELSE 0 END) AS pos,
         sum(CASE WHEN y = 1 THEN 0 ELSE 1 END) AS neg
  FROM scored GROUP BY label, score
), cum AS (
  SELECT *, coalesce(sum(neg) OVER (PARTITION BY label ORDER BY score
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
  FROM per
), auc AS (
  SELECT label, sum(pos) AS p, sum(neg) AS q, sum(pos * (below + 0.5 * neg)) AS num FROM cum GROUP BY label
)
SELECT a.label, CAST(a.p AS BIGINT) AS n_pos, CAST(a.q AS BIGINT) AS n_neg,
       round(CASE WHEN a.p > 0 AND a.q > 0 THEN a.num / (a.p * a.q::DOUBLE) END, 6) AS auc,
       round(w.avg_nw, 6) AS avg_num_words
FROM auc a JOIN (SELECT label, avg(nw) AS avg_nw FROM scored GROUP BY label) w USING (label)
"""

FLAGSHIP_SQL = FLAGSHIP_SQL.replace("__WS__", ws_split("l.t"))

register("m10_flagship_target_encoding_auc", FLAGSHIP_SQL)(target_encoding_auc)
