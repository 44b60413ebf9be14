"""op12: a Merkle manifest of `documents`, with every row's proof and a fold of tampered rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lowered, table
from .merkle import manifest
from .queries import query

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Levels that the twin unrolls: 16 ** 6 documents a source.
UNROLLED = 6


def _leaf(text: str) -> str:
    shown = [f"({c})::VARCHAR" for c in (*FIELDS[:-1], text)]
    return "sha256(" + " || ".join(f"coalesce(octet_length(encode({s}))::VARCHAR || ':' || {s}, '-')" for s in shown) + ")"


def _tree(name: str, leaves: str) -> str:
    """CTEs that climb from `leaves` (tree, id, pos, n, h, t): digests, the tampered digest of each leaf's own path, and siblings."""
    steps = [f"{name}0 AS ({leaves})"]
    for level in range(UNROLLED):
        # a node is (tree, pos, n, h); every leaf id follows its own node upwards with t and its proof
        steps.append(
            f"""{name}{level + 1} AS (
  WITH nodes AS (SELECT DISTINCT tree, pos, n, h FROM {name}{level}),
  runs AS (SELECT tree, pos // 16 AS run, list(h ORDER BY pos) AS hs, any_value(n) AS n FROM nodes GROUP BY ALL)
  SELECT a.tree, a.id, CASE WHEN a.n > 1 THEN a.pos // 16 ELSE a.pos END AS pos, CASE WHEN a.n > 1 THEN (a.n + 15) // 16 ELSE 1 END AS n,
    CASE WHEN a.n > 1 THEN sha256(array_to_string(r.hs, '')) ELSE a.h END AS h,
    CASE WHEN a.n > 1 THEN sha256(array_to_string(list_transform(r.hs, lambda x, i: CASE WHEN i = a.pos % 16 + 1 THEN a.t ELSE x END), '')) ELSE a.t END AS t,
    a.proof || CASE WHEN a.n > 1 THEN array_to_string(list_filter(r.hs, lambda x, i: i <> a.pos % 16 + 1), '') ELSE '' END AS proof
  FROM {name}{level} a JOIN runs r ON a.tree IS NOT DISTINCT FROM r.tree AND r.run = a.pos // 16)"""
        )
    return ",\n".join(steps)


SQL = f"""
WITH bits AS (
  SELECT doc_id, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(length(doc_id::VARCHAR)), lambda i: ascii(substr(doc_id::VARCHAR, i::INTEGER + 1, 1))::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)) AS c
  FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)
), sums AS (SELECT doc_id, xor(c, 4294967295) AS crc FROM bits),
plain AS (
  SELECT d.doc_id, source, {_leaf("text")} AS h,
    CASE WHEN crc % 5 = 0 THEN {_leaf(f"translate(text, '{UPPER}', '{LOWER}')")} ELSE {_leaf("text")} END AS t
  FROM documents d LEFT JOIN sums USING (doc_id)
), {_tree("s", "SELECT source AS tree, row_number() OVER () AS id, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, h) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n, h, t, '' AS proof, doc_id, h AS leaf FROM plain").replace("a.tree, a.id,", "a.tree, a.id, a.doc_id, a.leaf,")},
subroots AS (SELECT DISTINCT tree AS source, h FROM s{UNROLLED}),
ranked AS (SELECT source, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM subroots),
{_tree("u", f"SELECT 0 AS tree, id, r.pos, r.n, h, t, proof, doc_id, leaf, subroot FROM s{UNROLLED} s JOIN ranked r ON s.tree IS NOT DISTINCT FROM r.source").replace("a.tree, a.id,", "a.tree, a.id, a.doc_id, a.leaf, a.subroot,")}
SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, t AS folded_root, t = h AS verified FROM u{UNROLLED}
"""


@query("op12_merkle_manifest", SQL)
def merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*FIELDS)
    tampered = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    return manifest(docs, FIELDS, changes={"text": lowered("text")}, changed=tampered)
