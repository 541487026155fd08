"""A corpus pipeline of five stages over documents; each stage's output is written and read again.

quality: documents that the classifier rejects go.
near_duplicates: of each group linked by SimHash the row of the smallest doc_id stays.
decontamination: documents that contain a benchmark item go.
personal_data: spans found in the text become [KIND], overlapping ones together; n_chars follows the text.
tokens: the text is encoded; the ids, their number, and the decoded text.

All rows of a table are handled, with null ids, null texts and repeated rows
as the operators define them: a document without id is kept in its group only
if no row of the group has an id, and of equal rows one stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm import bpe, decontam, pii, quality, simhash
from maskwright.llm.common import discard, stored, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    name = "_score"
    while name in docs.columns:
        name += "_"
    return quality.with_score(docs, model, into=name).where(F.col(name) >= quality.THRESHOLD).select(docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.without_near_duplicates(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.without_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    coded = bpe.round_trip(docs, path, pattern)
    return coded.select(F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), "ids", F.decode("decoded", "UTF-8").alias("text"))


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("personal_data", personal_data_stage),
    ("tokens", token_stage),
]

#: SQL can't express the fitted classifier or the tokenizer; tests/llm holds the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        last, docs = docs, stored(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(last)
    return docs
