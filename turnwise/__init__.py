"""Alignment of speakers in conversations, on Spark."""

from turnwise.operators.alignment import lexsyn
from turnwise.operators.embeddings import contextual_similarity, model_encoder, model_states, static_similarity
from turnwise.operators.surrogates import surrogates
from turnwise.plans.pipeline import analyze, analyze_file, baseline, prepare
from turnwise.sources.conversations import read_binary_vectors, read_parquet, read_surrogates, read_tsv, read_vectors

__all__ = ["analyze", "analyze_file", "baseline", "contextual_similarity", "lexsyn", "model_encoder", "model_states", "prepare", "read_binary_vectors", "read_parquet", "read_surrogates", "read_tsv", "read_vectors", "static_similarity", "surrogates"]
