"""The corpus pipeline: documents in, encoded training rows out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as
the next one's docs.  All but the last return the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from turnwise.llm import stages
from turnwise.llm.common import discard, scratch, spool

STAGES = [
    ("language_id", stages.language_id),
    ("exact_dedup", stages.exact_dedup),
    ("near_dedup", stages.near_dedup),
    ("mix_sources", stages.mix_sources),
    ("bpe_encode", stages.bpe_encode),
]

#: No SQL can express the language, fingerprint and tokenizer stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES[:-1]):
        with scratch() as keep:
            done = keep(spool(stage(spark, docs, sf_dir), f"pipeline-{name}", as_is=True))
        if number:
            discard(docs)
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
