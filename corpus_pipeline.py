"""A training corpus in stages: language, near duplicates, benchmark passages, personal data, packing.

Every stage works on all documents its predecessor kept. Language: documents without any letter (or text) go; `lang` of the
rest is what the mixture model predicts, or stays where no language could be learned. Near duplicates: of each linked group
one row stays, the first by doc_id (rows without an id last); rows count by their own text, also where an id is repeated.
Benchmark passages: documents that hold one go. Personal data: every span is replaced by its mark, `n_chars` follows.
Packing: the pieces and their places.

Null and empty texts have no letter and end with the first stage. Texts of any length are judged whole. An empty table goes
through all stages. Further columns of the input stay up to packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystride.llm import common, op3_url_filter, op6_language_mixture, op7_qgram_decontamination, op8_disclosure, op9_prefix_tree_join, op10_best_fit_packing


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language, `lang` being the predicted one; without labelled rows, all documents with a letter."""
    common.small_batches(spark)
    known = F.col("lang_pred") != "und"
    named = op6_language_mixture.identify(docs).where(known | F.col("text").rlike(r"\p{L}"))
    return named.withColumn("lang", F.when(known, F.col("lang_pred")).otherwise(F.col("lang"))).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each linked group: the one with the smallest doc_id (null last), then the smallest key.

    A row's key is a hash of id and text: rows that share it are copies with one id, of which one stays. Rows that are
    alone in their group need no exchange: a Bloom filter of the keys of all others tells them apart (at most 2 ** 17
    blocks; a fuller filter passes more), and only what passes it is joined by key with the rows to keep.
    """
    keyed = docs.select(F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text").alias("_row"), "doc_id", "text", F.struct("*").alias("_doc"))
    found = op9_prefix_tree_join.jaccard_components(keyed.select(F.col("_row").alias("doc_id"), "text"))
    groups = common.staged(found.select(F.col("doc_id").alias("_row"), "component_id"))
    shared = groups.groupBy("component_id").agg(F.count("*").alias("rows")).where("rows > 1")
    met = common.staged(groups.join(shared, "component_id", "left_semi").distinct())
    ids = keyed.select("_row", "doc_id").distinct()
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row"))
    keep = met.join(ids, "_row").groupBy("component_id").agg(first.alias("first")).select("first._row")
    keep = common.staged(keep.withColumn("_stays", F.lit(True)).unionByName(met.select("_row").withColumn("_stays", F.lit(False))).groupBy("_row").agg(F.max("_stays").alias("_stays")))

    keys = keep.select(F.col("_row").alias("key"))
    blocks = op3_url_filter.block_count(keys)
    marked = op3_url_filter.marked(keyed.select("_row", F.col("_row").alias("key"), "_doc"), op3_url_filter.bloom(keys, blocks), blocks, "_maybe")
    alone = marked.where("not _maybe").select("_doc")
    some = marked.where("_maybe").select("_doc", "_row").join(keep, "_row", "left").where(F.coalesce("_stays", F.lit(True)))
    return alone.union(some.dropDuplicates(["_row"]).select("_doc")).select("_doc.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    common.small_batches(spark)
    return op7_qgram_decontamination.clean(docs, common.table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data and terms that disclose it replaced by marks."""
    return op8_disclosure.sanitised(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of what is left, placed in sequences."""
    common.small_batches(spark)
    return op10_best_fit_packing.pack(docs, op10_best_fit_packing.tokenizer_path())


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("personal_data", personal_data), ("packing", packing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = common.staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
