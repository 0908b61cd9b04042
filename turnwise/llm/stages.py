"""The stages of the corpus pipeline: (spark, docs, sf_dir) to docs."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from . import bpe, exact, langid, mixing, near
from .common import bounded, fresh


def language_id(spark, docs, sf_dir):
    """Documents without a language (no text or no letter) go; lang becomes the predicted one."""
    bounded(spark)
    pred, score = fresh(docs, "lang_pred", "lang_score")
    profiles = langid.learn(docs.where(~langid.held_out(F.col("doc_id"))))
    found = langid.identify(docs, profiles, lang=pred, score=score)
    return found.where(F.col(pred) != langid.UNKNOWN).withColumn("lang", F.col(pred)).select(*docs.columns)


def exact_dedup(spark, docs, sf_dir):
    bounded(spark)
    return exact.deduplicated(docs)


def near_dedup(spark, docs, sf_dir):
    """Links are at a similarity of 0.8 or more by five-word shingles."""
    bounded(spark)
    return near.near_deduplicated(docs)


def mix_sources(spark, docs, sf_dir):
    """A document that the mix takes twice comes twice; n_chars is that of the text taken."""
    bounded(spark)
    return mixing.mixed(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def bpe_encode(spark, docs, sf_dir):
    """The last stage: token ids in place of texts, and whether they decode to the text."""
    bounded(spark)
    ids, decoded = fresh(docs, "ids", "decoded")
    found = bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), ids=ids, decoded=decoded)
    exactly = F.col(decoded) == F.coalesce("text", F.lit(""))
    return found.select("doc_id", "lang", "source", F.col(ids).alias("ids"), F.size(ids).cast("long").alias("n_tokens"), exactly.alias("round_trip"))
