"""The queries of this folder by name, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers

from . import bpe, exact, html_text, langid, mixing, sharding, simhash, voronoi, warc
from .common import table

BYTE_BPE = "byte_bpe_50k.json"


def op1_language_id(spark, sf_dir):
    return langid.predictions(table(spark, sf_dir, "documents"))


def op2_voronoi_knn(spark, sf_dir):
    return voronoi.top_products(table(spark, sf_dir, "embeddings"))


def op3_bpe_encode(spark, sf_dir):
    return bpe.encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


def op4_exact_dedup(spark, sf_dir):
    return exact.classes(table(spark, sf_dir, "documents"))


def op5_mix_sources(spark, sf_dir):
    return mixing.taken_words(table(spark, sf_dir, "documents"))


def op6_warc(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op7_simhash(spark, sf_dir):
    return simhash.near_classes(table(spark, sf_dir, "documents"))


def op8_token_counts(spark, sf_dir):
    return bpe.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


def op9_html_text(spark, sf_dir):
    return html_text.extracted(table(spark, sf_dir, "pages"))


def op10_sharding(spark, sf_dir):
    return sharding.placed(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_language_id, op2_voronoi_knn, op3_bpe_encode, op4_exact_dedup, op5_mix_sources, op6_warc, op7_simhash, op8_token_counts, op9_html_text, op10_sharding)}
ORACLES = {"op2_voronoi_knn": voronoi.SQL, "op4_exact_dedup": exact.SQL, "op5_mix_sources": None, "op6_warc": warc.SQL, "op10_sharding": sharding.SQL}
ORACLES = {k: v for k, v in ORACLES.items() if v}
