"""The corpus pipeline: quality rules, quality classifier, near-duplicates, best-fit packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; its result is written and read
again as the next one's docs. ORACLE_SQL is None: fingerprints, the classifier and token ids have no counterpart in
SQL; tests/llm compares each stage with a plain version instead.

Defined results: columns besides doc_id and text are carried through the first three stages whatever their names; null
text is dropped by the first stage; the near-duplicate stage keeps one row of each component, whether doc_id is null,
repeated or neither.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import packing, quality_rules, similar, weak_label
from tidemark.llm.common import cut, table


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the threshold table."""
    return quality_rules.keep(docs)


def quality_classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label classifier keeps."""
    return weak_label.keep(docs)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest doc_id, null last, of each component of texts alike by five-word shingles: SimHash through vantage-point trees, then exact."""
    low, high, one = (f"_{uuid.uuid4().hex}" for _ in range(3))
    order = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "low", "high")).alias("first")
    found = similar.components(docs).groupBy("node", "root").agg(order).groupBy("root").agg(F.min("first").alias("first"))
    first = found.select(F.col("first.doc_id").alias("_keep"), F.col("first.low").alias("_low"), F.col("first.high").alias("_high"))
    rows = docs.withColumns(dict(zip((low, high), similar.digest(), strict=True)))
    rows = rows.join(first, (F.col(low) == F.col("_low")) & (F.col(high) == F.col("_high")) & rows["doc_id"].cast("long").eqNullSafe(first["_keep"]), "left_semi")
    # rows with one doc_id and text are of one component and can't be told apart by these
    return rows.withColumn(one, F.row_number().over(Window.partitionBy("doc_id", low, high).orderBy(low))).where(F.col(one) == 1).drop(low, high, one)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents that are left and their places in sequences."""
    return packing.pack(packing.pieces(docs))


STAGES = [
    ("quality rules", quality_rules_stage),
    ("quality classifier", quality_classifier_stage),
    ("simhash near-duplicates", near_duplicates_stage),
    ("best-fit packing", packing_stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = cut(docs) if k < len(STAGES) - 1 else docs
    return docs
