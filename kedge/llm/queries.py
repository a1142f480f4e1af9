"""Queries of the operators for training text."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kedge.llm import leakage, lookalikes, markup, packing, quality, term_frequency
from kedge.session import table

#: The vocabulary file that the p7 queries take where KEDGE_TOKENIZER names no other.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    occs = table(spark, d, "occs").select("id", "uri", "surface_form")
    return term_frequency.marked(term_frequency.occurrence_terms(occs), occs, "id")


def p3_terms(spark: SparkSession, d: str) -> DataFrame:
    return term_frequency.occurrence_terms(table(spark, d, "occs").select("id", "uri", "surface_form"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.match_lookalikes(table(spark, d, "occs"), table(spark, d, "surface_forms"))


def p5_repaired(spark: SparkSession, d: str) -> DataFrame:
    """Every surface form in its one form, with the number of its rows."""
    forms = table(spark, d, "occs").filter(F.col("surface_form").isNotNull()).groupBy("surface_form").agg(F.count(F.lit(1)).alias("n"))
    return lookalikes.repair_forms(forms, table(spark, d, "surface_forms")).join(forms, "surface_form").select("surface_form", "repaired", "n")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return markup.markup_kinds(table(spark, d, "occs"), "occ_id", "context")


def p6_clean(spark: SparkSession, d: str) -> DataFrame:
    """Every context as clean text with its structure."""
    got = markup.clean_texts(table(spark, d, "occs"), "occ_id", "context")
    return got.select("occ_id", "clean", F.array_join("kinds", ",").alias("kinds"))


def _packed(spark: SparkSession, d: str) -> DataFrame:
    import public_tokenizers

    return packing.pack_documents(table(spark, d, "documents"), os.environ.get("KEDGE_TOKENIZER", TOKENIZER), public_tokenizers.PATTERN)


def p7_packing(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d)


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    """Per container: pieces and tokens."""
    return _packed(spark, d).groupBy("container").agg(F.count(F.lit(1)).alias("pieces"), F.sum("size").alias("tokens"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_leaks(spark, d).select("doc_id", "item_id")


def p8_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Per document and item: tiles, longest tile, covered words, and whether the item leaked for the most part."""
    got = leakage.leaks(table(spark, d, "documents"), table(spark, d, "gold_items"))
    return got.withColumn("mostly", F.col("coverage") >= leakage.COVERAGE)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_quality(spark, d).filter(F.col("kind") != "prose").select("doc_id", "kind")


def p9_quality(spark: SparkSession, d: str) -> DataFrame:
    """The statistics, the calibrated probability of prose and the kind of every document."""
    return quality.classify(table(spark, d, "documents"), table(spark, d, "doc_labels"))


_TERMS = """
WITH t AS (
  SELECT id, 'uri' AS field, uri AS term FROM occs UNION ALL
  SELECT id, 'surface_form', surface_form FROM occs UNION ALL
  SELECT id, 'word', w FROM (SELECT id, unnest(string_split(surface_form, ' ')) AS w FROM occs) WHERE w <> ''),
c AS (SELECT field, term, count(*) AS n, count(DISTINCT id) AS records FROM t WHERE term IS NOT NULL GROUP BY field, term)
"""

QUERIES = {f.__name__: f for f in (p3_found, p3_terms, p5_found, p5_repaired, p6_found, p6_clean, p7_packing, p7_containers, p8_found, p8_leaks, p9_found, p9_quality)}
_WORDS = """
WITH RECURSIVE doc AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents),
item AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM gold_items),
dg AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 11], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 11)) AS i FROM doc)),
ig AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 11], ' ') AS g FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - 11)) AS i FROM item))
"""
SQL = {
    "p8_found": _WORDS + "SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)",
    "p3_found": _TERMS + """SELECT field, term, 'rare' AS mark FROM c WHERE records = 1
      UNION ALL SELECT field, term, 'common' FROM c WHERE records >= 1 AND records >= 0.01 * (SELECT count(DISTINCT id) FROM occs)""",
    "p3_terms": _TERMS + "SELECT field, term, n, records FROM c",
}
