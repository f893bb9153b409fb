"""Digests and stored metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import provenance
from tessella.plans.registry import query, table


@query("""WITH f AS (SELECT doc_id AS key, sha256(text) AS found FROM documents), m AS (SELECT doc_id AS key, CASE WHEN doc_id % 97 = 0 THEN sha256(lower(text)) ELSE sha256(text) END AS expected FROM documents WHERE doc_id % 101 <> 0)
SELECT key, expected, found FROM m FULL JOIN f USING (key) WHERE expected IS DISTINCT FROM found""")
def manifest_violations(spark, sf_dir):
    """A manifest with entries changed and left out, against digests of all texts."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "text")
    found = docs.select("key", F.sha2("text", 256).alias("sha256"))
    manifest = docs.where("key % 101 <> 0").select("key", F.sha2(F.when(F.col("key") % 97 == 0, F.lower("text")).otherwise(F.col("text")), 256).alias("sha256"))
    return provenance.violations(manifest, found, "key")


@query("""SELECT doc_id, n_chars, length(text)::BIGINT AS recomputed FROM documents WHERE n_chars IS DISTINCT FROM length(text)""")
def stored_metric(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return provenance.irreproducible(docs, "n_chars", F.length("text").cast("long")).select("doc_id", "n_chars", F.length("text").cast("long").alias("recomputed"))
