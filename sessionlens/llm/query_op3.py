"""op3: every document placed in one of 10 shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .queries import query
from .sharding import place

N = 10
SHARDS = [f"shard-{i:02d}" for i in range(N)]
SIZE = 1021  # a prime above 100 slots a shard

SQL = f"""
WITH RECURSIVE names AS (
  SELECT i, md5('shard-' || lpad(i::VARCHAR, 2, '0')) AS h FROM range({N}) t(i)
), orders AS (
  SELECT list(('0x' || substr(h, 1, 15))::BIGINT % {SIZE} ORDER BY i) AS first,
         list(('0x' || substr(h, 16, 15))::BIGINT % {SIZE - 1} + 1 ORDER BY i) AS skip FROM names
), fill AS (
  SELECT 0 AS turn, list_transform(range({SIZE}), lambda x: -1) AS owner
  UNION ALL
  SELECT turn + 1, list_transform(owner, lambda o, k: CASE WHEN k - 1 = slot THEN turn % {N} ELSE o END)
  FROM (
    SELECT turn, owner, list_filter(
      list_transform(range({SIZE}), lambda j: (first[turn % {N} + 1] + j * skip[turn % {N} + 1]) % {SIZE}), lambda s: owner[s + 1] = -1)[1] AS slot
    FROM fill, orders WHERE turn < {SIZE}
  )
), filled AS (SELECT owner FROM fill WHERE turn = {SIZE}),
placed AS (SELECT doc_id, (('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT % {SIZE})::INTEGER AS slot FROM documents)
SELECT doc_id, slot, 'shard-' || lpad((owner[slot + 1])::VARCHAR, 2, '0') AS shard FROM placed, filled
"""


@query("op3_sharding", SQL)
def sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return place(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", SHARDS, SIZE)
