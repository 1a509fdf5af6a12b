"""Queries of the text and training-data problems (2, 7, 8 and 9) with their SQL.

Problems 7 to 9 need a tokenizer, an index or a trained model and have no SQL;
their tests compare with brute force, round trips and held-out labels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgraph.llm import cooccur, leakage, packing, pii
from loamgraph.sources.tables import table

ENTITY = ["tenant_id", "entity_type", "entity_id"]


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = cooccur.pair_counts(table(spark, d, "entity_tags"), "tenant_id", ENTITY, "tag_id", min_count=10, min_ratio=5)
    return pairs.select(F.col("grp").alias("tenant_id"), F.col("item_a").alias("tag_a"), F.col("item_b").alias("tag_b"))


def p2_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Every pair that stands together at all, with its scores."""
    pairs = cooccur.scored(cooccur.pair_counts(table(spark, d, "entity_tags"), "tenant_id", ENTITY, "tag_id"))
    return pairs.select(F.col("grp").alias("tenant_id"), F.col("item_a").alias("tag_a"), F.col("item_b").alias("tag_b"), "n", "n_a", "n_b", "n_ab", "lift", "conviction")


def _packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(packing.token_counts(table(spark, d, "documents"), "doc_id", "text"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that the packing had to cut."""
    return _packed(spark, d).where("n_pieces > 1").select(F.col("item").alias("doc_id")).distinct()


def p7_packing(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d).withColumnRenamed("item", "doc_id")


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(_packed(spark, d))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id").distinct()


def p8_removal(spark: SparkSession, d: str) -> DataFrame:
    return leakage.removal_spans(leakage.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items")))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.find_personal(table(spark, d, "documents"))


def p9_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.redact_documents(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p2_found, p2_pairs, p7_found, p7_packing, p7_fill, p8_found, p8_removal, p9_found, p9_redacted)}

_P2 = """WITH held AS (SELECT DISTINCT tenant_id, entity_type, entity_id, tag_id FROM entity_tags WHERE tag_id IS NOT NULL),
total AS (SELECT tenant_id, count(DISTINCT (entity_type, entity_id)) AS n FROM held GROUP BY ALL),
single AS (SELECT tenant_id, tag_id, count(*) AS n_i FROM held GROUP BY ALL),
pairs AS (SELECT a.tenant_id, a.tag_id AS tag_a, b.tag_id AS tag_b, count(*) AS n_ab FROM held a JOIN held b USING (tenant_id, entity_type, entity_id) WHERE a.tag_id < b.tag_id GROUP BY ALL),
scored AS (SELECT p.*, t.n, a.n_i AS n_a, b.n_i AS n_b FROM pairs p JOIN total t USING (tenant_id) JOIN single a ON a.tenant_id = p.tenant_id AND a.tag_id = tag_a JOIN single b ON b.tenant_id = p.tenant_id AND b.tag_id = tag_b)
"""

SQL = {
    "p2_found": _P2 + "SELECT tenant_id, tag_a, tag_b FROM scored WHERE n_ab >= 10 AND n_ab * n >= 5 * n_a * n_b",
    "p2_pairs": _P2
    + """SELECT tenant_id, tag_a, tag_b, n, n_a, n_b, n_ab, round(n_ab * CAST(n AS DOUBLE) / (n_a * n_b), 6) AS lift,
CASE WHEN n_ab < n_a THEN round((1 - n_b / CAST(n AS DOUBLE)) / (1 - n_ab / CAST(n_a AS DOUBLE)), 6) END AS conviction FROM scored""",
}
