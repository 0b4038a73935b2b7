"""The corpus pipeline: five stages over `documents`, each written as Parquet and read again by the next.

Null ids, null and empty texts, repeated rows and empty tables take the defined results of the stages' operators; the
columns of documents pass through all stages but the last.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm.decontaminate import benchmark_hits, contaminated
from waymark.llm.mixing import mixed_documents
from waymark.llm.near_dup import one_of_each
from waymark.llm.quality_rules import quality_verdicts
from waymark.scratch import new_path
from waymark.llm.token_shards import read_shards, write_shards
from waymark.session import attach


def _without(docs: DataFrame, verdicts: DataFrame, gone: str) -> DataFrame:
    """docs without the rows whose (doc_id, hash of text) have a verdict `gone`."""
    out = verdicts.where(gone).select(F.col("doc_id").alias("__wm_id"), F.col("_of").alias("__wm_gone")).distinct()
    keyed = docs.withColumn("__wm_of", F.xxhash64("text"))
    gone_rows = F.col("doc_id").eqNullSafe(F.col("__wm_id")) & (F.col("__wm_of") == F.col("__wm_gone"))
    return keyed.join(out, gone_rows, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep. Verdicts are on (doc_id, text), as an id may be repeated with other texts."""
    own = docs.select(F.struct(F.col("doc_id").alias("doc_id"), F.xxhash64("text").alias("of")).alias("_key"), "doc_id", "text", "lang")
    labels = attach(spark).read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    keyed = own.select("_key", "doc_id").distinct().join(labels, "doc_id").select("_key", "quality")
    found = quality_verdicts(own.select("_key", "text", "lang"), keyed, id_col="_key")
    return _without(docs, found.select("_key.doc_id", F.col("_key.of").alias("_of"), "kept"), "NOT kept")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity of 0.8 or more."""
    attach(spark)
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by benchmark items."""
    own = docs.select(F.struct(F.col("doc_id").alias("doc_id"), F.xxhash64("text").alias("of")).alias("_key"), "doc_id", "text", "lang")
    items = attach(spark).read.parquet(f"{sf_dir}/benchmark.parquet")
    found = benchmark_hits(own.select("_key", "text"), items, id_col="_key").withColumn("gone", contaminated())
    return _without(docs, found.select("_key.doc_id", F.col("_key.of").alias("_of"), "gone"), "gone")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The copies that the mix takes, in the order of training."""
    attach(spark)
    return mixed_documents(docs)


def _as_written(docs: DataFrame) -> DataFrame:
    """docs with the place of each row in the files that it is read from; without files there is none."""
    try:
        return docs.withColumns({"__wm_file": F.col("_metadata.file_name"), "__wm_row": F.col("_metadata.row_index")})
    except AnalysisException:
        return docs.withColumns({"__wm_file": F.lit(""), "__wm_row": F.lit(0)})


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards, written; per document what is read back from them. The shards hold the rows in the order of the files
    of docs, which is that of training, and rows that are in no file by id."""
    order = (F.col("__wm_file"), F.col("__wm_row"))
    path = write_shards(_as_written(docs), public_tokenizers.path("byte_bpe_50k.json"), new_path(attach(spark), "tokens"), order_by=order)
    return read_shards(spark, path)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_output", token_output),
]

#: The forest, the mix and the tokenizer are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each stage's rows written to the shared folder before the next."""
    docs = attach(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        path = new_path(spark, name)
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
