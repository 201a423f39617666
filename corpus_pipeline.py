"""A training-data pipeline over ``documents``, as stages that each call one of
the corpus operators: toxic documents go, documents of low quality go, one of
each group of near copies stays, long repeats are taken out, and what is left
is packed into sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from labelforge.llm import packing, quality, repeats, simhash, toxicity
from labelforge.llm.common import documents, saved
from labelforge.llm.queries import labels, tokenizer_json


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, labels(spark, sf_dir))


def remove_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, labels(spark, sf_dir).where("quality = 1"), pairs=True)


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return repeats.keep_first(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_json())


STAGES = [("toxicity", remove_toxic), ("quality_rules", remove_low_quality), ("simhash_near_dedup", remove_near_copies),
          ("suffix_array_dedup", remove_repeats), ("best_fit_packing", pack)]

#: The learned stages, and ids of a tokenizer, are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = saved(docs, name)
    return docs
