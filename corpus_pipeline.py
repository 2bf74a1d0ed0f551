"""A corpus pipeline: documents of low quality go, then toxic ones, then near copies; the rest is packed.

Each stage takes (spark, docs, sf_dir): docs are the rows that the stage before it kept, with the columns of
``documents``. The first three return rows of docs unchanged; the last one returns the packing, one row for each
piece of a document. Classifiers learn from those labelled rows of docs that their operators' splits allow.

Null and empty texts, repeated rows, further columns and empty tables are handled as the operators define it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import bagminhash, common, packing, quality, toxicity


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.of_quality(docs, quality.fit(docs, common.table(spark, sf_dir, "labels")))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, toxicity.fit(docs, common.table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bagminhash.deduplicated(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(packing.lengths(docs))


STAGES = [("quality", keep_quality), ("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("packing", pack)]

#: No stage but the last could be written in SQL; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packing of ``documents`` after all stages; each stage is written to the shared folder and read again. What a
    stage kept is removed when the next one is written; the last one's rows stay."""
    docs = common.table(spark, sf_dir, "documents")
    folder, before = common.shared_folder(spark), None
    for i, (name, stage) in enumerate(STAGES):
        out = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
        if before:
            common.remove(spark, before)
        before = out
    return docs
