"""The corpus pipeline: documents in, packed training sequences out.

Five stages, each over all that the stage before kept; each is written as Parquet and read again as the next one's docs.
All but the last return the columns of documents. n_chars follows the text where a stage changes it. Further columns, whatever
their names, are carried along. An empty table gives an empty result from each stage; texts of any length are taken whole.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftwork.llm import line_dedup, minhash, mixing, packing, quality
from weftwork.llm.common import dropped, kept_from, scratch, stored


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")) if "n_chars" in docs.columns else docs


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones among them, scores 0.3 or more. Null texts count as empty; repeated rows share their fate."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(model.score(F.col("text")) >= quality.THRESHOLD)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines whose template recurs across documents. Null texts stay null; repeated rows stay alike."""
    return _counted(line_dedup.dedup(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of near copies: five-word shingles, similarity 0.8 or more.

    Documents without words are no copies and stay. Rows that share the kept doc_id stay together; a group whose ids are all null stays.
    """
    return minhash.dedup(docs, k=5)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target takes them, in the order of shards and of places in them. A null source is a source.

    Null and empty texts have no words; they come along as often as their source is taken whole.
    """
    return _counted(mixing.mix(docs, places=False, ordered=True))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 1024 tokens. A null text is empty: one piece, the end id alone. Repeated rows are packed each."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_classifier", quality_classifier), ("line_dedup", drop_lines), ("minhash_near_dedup", near_dedup), ("source_mixing", source_mix), ("best_fit_packing", pack),
]

#: Training, hashing and tokenizing have no SQL form; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's rows are stored and its own tables deleted before the next begins; the last one's tables stay, as the result reads them."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        with scratch(spark) as paths:
            docs = kept_from(paths, stored(stage(spark, docs, sf_dir)))
        if before is not None:
            dropped(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
