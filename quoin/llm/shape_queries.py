"""Queries of the operators that rearrange texts and group vectors."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quoin.llm.centroids import clusters
from quoin.llm.common import table
from quoin.llm.infill import fill_in_middle, restore
from quoin.llm.registry import query

_TOKEN = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
_DRAWS = ", ".join(f"CAST('0x' || substr(digest, {8 * k + 1}, 8) AS BIGINT) AS h{k + 1}" for k in range(4))


@query(
    rf"""
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_TOKEN}') AS units,
    sha256('42:' || CAST(doc_id AS VARCHAR)) AS digest FROM documents
), drawn AS (SELECT doc_id, text, units, CAST(len(units) AS BIGINT) AS n, {_DRAWS} FROM texts
), cut AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
      WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM drawn
), parts AS (
  SELECT *, array_to_string(units[1:a], '') AS p, array_to_string(units[a + 1:b], '') AS m, array_to_string(units[b + 1:n], '') AS s FROM cut
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts
"""
)
def op12_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    """Fill-in-the-middle form of every document, and what it restores to."""
    made = fill_in_middle(table(spark, folder, "documents").select("doc_id", "text"))
    rows = made.withColumn("output_sha256", F.sha2("output", 256))
    return restore(rows).select("given.given.doc_id", "given.n", "given.form", "given.prefix_chars", "given.middle_chars", "given.output_sha256", F.sha2("restored", 256).alias("restored_sha256"))


_DISTANCE = "CAST(list_sum(list_transform(range(1, 65), lambda i: (k.v[i] - c.v[i]) * (k.v[i] - c.v[i]))) AS BIGINT)"


def _rounds(n: int) -> str:
    out = []
    for r in range(n + 1):
        out.append(f"near{r} AS (SELECT k.id, any_value(k.vec_id) AS vec_id, any_value(k.v) AS v, min({{'d': {_DISTANCE}, 'c': c.c}}) AS best FROM kept k, mid{r} c GROUP BY k.id)")
        if r < n:
            out.append(f"sums{r} AS (SELECT best.c AS c, i, sum(v[i]) AS s, count(*) AS n FROM near{r}, range(1, 65) AS t(i) GROUP BY 1, 2)")
            mean = "CAST((s - ((s % n) + n) % n) // n AS BIGINT)"
            out.append(
                f"mid{r + 1} AS (SELECT m.c, coalesce(g.v, m.v) AS v FROM mid{r} m LEFT JOIN (SELECT c, list({mean} ORDER BY i) AS v FROM sums{r} GROUP BY c) g ON g.c = m.c)"
            )
    return ", ".join(out)


@query(
    f"""
WITH finite AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64
), kept AS (SELECT row_number() OVER (ORDER BY sha256('1:' || CAST(vec_id AS VARCHAR)), v) - 1 AS id, vec_id, v FROM finite
), mid0 AS (SELECT id AS c, v FROM kept WHERE id < 16
), {_rounds(3)}, last AS (SELECT vec_id, best.c AS c, best.d AS d FROM near3)
SELECT vec_id, CAST(l.c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY l.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m.v, ',')) AS centroid_sha256
FROM last l JOIN mid3 m ON m.c = l.c
"""
)
def op13_centroids(spark: SparkSession, folder: str) -> DataFrame:
    """Cluster of every embedding after three rounds from 16 centroids."""
    rows, centroids = clusters(table(spark, folder, "embeddings"))
    found = centroids.collect()  # one row for each of 16 centroids
    total = sum(r["inertia"] for r in found)
    digest = lambda v: hashlib.sha256(",".join(map(str, v)).encode()).hexdigest()
    ends = spark.createDataFrame([(r["cluster"], r["inertia"], total, digest(r["centroid"])) for r in found], "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return rows.join(F.broadcast(ends), "cluster").select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
