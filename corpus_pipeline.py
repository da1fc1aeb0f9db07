"""From raw documents to packed sequences: the stages, each on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marktide.llm.common import saved, table
from marktide.llm.exact_dedup import exact_dedup, normalised
from marktide.llm.mixing import mix
from marktide.llm.packing import pack_documents
from marktide.llm.quality_rules import quality_filter
from marktide.llm.simhash import similar_groups


def _key(digest: Column) -> Column:
    """Tells rows apart by id and text; null ids are equal to each other."""
    return F.concat_ws(":", digest, F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("_llm_key", _key(F.sha2(normalised(F.col("text")).cast("binary"), 256)))


def _only(docs: DataFrame, keep: DataFrame) -> DataFrame:
    """The rows of docs whose id and text are in keep (_llm_keep); one of each such pair."""
    found = _keyed(docs).join(keep, F.col("_llm_key") == F.col("_llm_keep"), "left_semi")
    place = F.row_number().over(Window.partitionBy("_llm_key").orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])))
    return found.withColumn("_llm_place", place).where("_llm_place = 1").select(*[F.col(f"`{c}`") for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_filter(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts one row with the smallest id stays; a null id is larger than any other."""
    return _only(docs, exact_dedup(docs).where("kept").select(_key(F.col("text_sha256")).alias("_llm_keep")))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, similarity 0.8) one row with the smallest id stays; a null id is larger than any other.

    Texts meet only the list of rows that go, which Spark sends to all tasks while its file is small. Only if rows are
    repeated (same id and text) texts are shuffled to keep one of each.
    """
    groups = saved(similar_groups(_keyed(docs), row_col="_llm_key"), "near-groups")
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    keep = groups.groupBy("group_id").agg(F.min_by("row", first).alias("_llm_keep"))
    if not groups.groupBy("row").count().where("count > 1").isEmpty():
        return _only(docs, keep.select("_llm_keep"))
    gone = saved(groups.join(keep, F.col("row") == F.col("_llm_keep"), "left_anti").select(F.col("row").alias("_llm_gone")), "near-gone")
    return _keyed(docs).join(gone, F.col("_llm_key") == F.col("_llm_gone"), "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the target rate of its source says, in random order."""
    return mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document in the packed sequences."""
    return pack_documents(docs)


STAGES = [("quality rules", quality), ("exact dedup", exact), ("simhash near-dedup", near), ("mixing", mixed), ("packing", packed)]
#: Fingerprints, their components and tokens are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = saved(docs, f"pipeline-{name.replace(' ', '-')}")
    return docs
