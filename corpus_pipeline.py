"""From raw documents to packed training sequences, in five stages.

Each stage takes what the one before kept, written as Parquet and read again:

1. quality: the line field scores every document; what it doesn't predict good goes.
2. near duplicates: of each component of SimHash links the document with the smallest id stays.
3. secrets: every span found is replaced in the text; no document goes.
4. mixing: sources are brought to their target weights; a document has a row for each time it is
   taken (none, if its source is over its target), in curriculum order.
5. packing: a row for each piece of a document in a training sequence.

All stages but the last return the columns of documents. SQL can't express the fitted field, the
scans or the packing, so ORACLE_SQL is None; tests/llm compares the stages with brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from feedforge.llm import common, mixing, packing, quality_lines, secrets, simhash


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality_lines.fit(docs, common.labels(spark, sf_dir))
    return quality_lines.score(docs, model).where("predicted = 1").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_first(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.curriculum(docs).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality classifier", quality), ("near duplicates", near_duplicates), ("secret scans", secret_scan), ("source mixing", mix), ("packing", pack)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = common.staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
