"""op11: the best collocations of each language of `documents`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .phrases import collocations
from .queries import query

LEAST, LONGEST, MOST = 100, 5, 2000

SQL = rf"""
WITH texts AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), pieces AS (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM texts
), worded AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces
), sizes AS (SELECT lang, sum(len(ws)) AS n FROM worded GROUP BY lang
), placed AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM worded
), runs AS (SELECT lang, ws[i : i + m - 1] AS ws FROM placed, range(1, {LONGEST + 1}) t(m) WHERE i + m - 1 <= len(ws)
), counts AS (SELECT lang, ws, count(*) AS f FROM runs GROUP BY ALL HAVING count(*) >= {LEAST}
), longer AS (
  SELECT lang, ws, max(f) AS above FROM (
    SELECT lang, ws[i : i + m - 1] AS ws, f FROM counts, range(1, {LONGEST}) a(i), range(2, {LONGEST}) b(m) WHERE m < len(counts.ws) AND i + m - 1 <= len(counts.ws)
  ) GROUP BY ALL
), free AS (
  SELECT c.lang, c.ws, c.f AS a FROM counts c LEFT JOIN longer o ON o.lang = c.lang AND o.ws = c.ws
  WHERE len(c.ws) > 1 AND (above IS NULL OR 100 * above < 100 * c.f)
), cuts AS (
  SELECT f.lang, f.ws, a, k, x.f AS l, y.f AS r, n, (1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f) AS score
  FROM free f, range(1, {LONGEST}) t(k), counts x, counts y, sizes s
  WHERE k < len(f.ws) AND x.lang = f.lang AND x.ws = f.ws[1:k] AND y.lang = f.lang AND y.ws = f.ws[k + 1:] AND s.lang = f.lang
), best AS (
  SELECT lang, array_to_string(ws, ' ') AS phrase, a, n, l, r, score FROM cuts
  QUALIFY row_number() OVER (PARTITION BY lang, ws ORDER BY score, k) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score
FROM best QUALIFY rank <= {MOST}
"""


@query("op11_collocations", SQL)
def best_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents").select("lang", "text"), LEAST, LONGEST, MOST)
