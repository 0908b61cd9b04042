"""The queries by name: each takes (spark, sf_dir) and returns a DataFrame.  oracles.py has SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.functions import cleaning, morphology, similarity, tokens
from turnwise.operators import alignment, embeddings, spelling, statistics, surrogates, turns, vocabulary
from turnwise.plans import oracles, pipeline
from turnwise.sources import conversations
from turnwise.sources import sinks  # noqa: F401

FILLERS = ("the", "de", "und", "die", "in", "la")
QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def raw(spark, d) -> DataFrame:
    return conversations.read_parquet(spark, f"{d}/conversations.parquet")


def speakers_merged(df: DataFrame) -> DataFrame:
    """system speaks as user, so that there are runs of one speaker to merge."""
    return df.withColumn("participant", F.when(F.col("participant") == "system", "user").otherwise(F.col("participant")))


def prepared(spark, d) -> DataFrame:
    return pipeline.prepare(speakers_merged(raw(spark, d)))


def apostrophes(text):
    """Contractions and odd words put in for frequent ones, since the table has none."""
    for a, b in oracles.APOSTROPHES:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def joined(c: str):
    return F.array_join(c, " ").alias(f"{c}s")


def rounded(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, *[F.round(c, 6).alias(c) for c, k in df.dtypes if k == "double" and c not in keys])


@query
def lexsyn_master(spark, d):
    out = alignment.lexsyn(prepared(spark, d))
    return rounded(out, "source_file", "time", "utter_order", "utterance_length1", "utterance_length2")


@query
def clean_text(spark, d):
    return turns.clean(raw(spark, d), min_words=0)


@query
def clean_letters(spark, d):
    return turns.clean(raw(spark, d), "none", min_words=0)


@query
def filler_list(spark, d):
    return turns.clean(raw(spark, d), "list", FILLERS, 0)


@query
def filler_both(spark, d):
    return turns.clean(raw(spark, d), "both", FILLERS, 0)


@query
def min_words(spark, d):
    return turns.clean(raw(spark, d), min_words=12)


@query
def adjacent_merge(spark, d):
    return turns.merge_adjacent(turns.clean(speakers_merged(raw(spark, d)), min_words=12))


@query
def expand_contractions(spark, d):
    own = raw(spark, d).withColumn("content", cleaning.letters_only(apostrophes(F.lower("content"))))
    return own.select("source_file", "turn", tokens.expanded(F.col("content")).alias("content"))


@query
def word_tokenize(spark, d):
    own = raw(spark, d).withColumn("token", tokens.words(cleaning.letters_only(apostrophes(F.lower("content")))))
    return own.select("source_file", "turn", joined("token"), F.size("token").cast("long").alias("n"))


@query
def spell_train(spark, d):
    return spelling.train(spark.read.parquet(f"{d}/documents.parquet"))


@query
def spell_correct(spark, d):
    words = turns.tokenize(turns.clean(raw(spark, d))).select(F.explode("token").alias("word"))
    return spelling.corrections(words, spelling.train(spark.read.parquet(f"{d}/documents.parquet")), edits=1)


@query
def spell_correct_two_edits(spark, d):
    words = turns.tokenize(turns.clean(raw(spark, d))).select(F.explode("token").alias("word"))
    return spelling.corrections(words, spelling.train(spark.read.parquet(f"{d}/documents.parquet")))


@query
def lemmatize_rules(spark, d):
    return prepared(spark, d).select("source_file", "turn", joined("token"), joined("lemma"))


@query
def pos_rules(spark, d):
    tags = lambda c: F.array_join(F.transform(c, lambda x: F.concat(x["word"], F.lit("/"), x["tag"])), " ").alias(c)
    return prepared(spark, d).select("source_file", "turn", tags("tagged_token"), tags("tagged_lemma"))


@query
def word_classes(spark, d):
    own = prepared(spark, d).select(F.explode("tagged_token").alias("x")).select(morphology.word_class(F.col("x.tag")).alias("class"))
    return own.groupBy("class").agg(F.count("*").alias("n"))


def _lagged(spark, d, lag):
    out = turns.lag_pairs(prepared(spark, d), ["content", "token"], lag)
    return out.select("source_file", "time", "lag", "utter_order", "content1", "content2", "utterance_length1", "utterance_length2")


@query
def lag_pairs_1(spark, d):
    return _lagged(spark, d, 1)


@query
def lag_pairs_2(spark, d):
    return _lagged(spark, d, 2)


@query
def small_files(spark, d):
    return turns.enough_turns(turns.clean(raw(spark, d), min_words=12), 3).select("source_file", "turn")


@query
def ngram_counts(spark, d):
    grams = prepared(spark, d).select(F.explode(similarity.ngrams(F.col("token"), 2)).alias("gram"))
    return grams.groupBy("gram").agg(F.count("*").alias("n"))


@query
def lexical_alignment(spark, d):
    out = alignment.lexsyn(prepared(spark, d), lag=2, max_ngram=3)
    return out.select("source_file", "time", *[F.round(f"lexical_{s}{n}_cosine", 6).alias(f"lexical_{s}{n}_cosine") for n in (1, 2, 3) for s in ("tok", "lem")])


def _pos(spark, d, ignore):
    out = alignment.lexsyn(prepared(spark, d), ignore_duplicates=ignore)
    return out.select("source_file", "time", *[F.round(f"pos_{s}{n}_cosine", 6).alias(f"pos_{s}{n}_cosine") for n in (1, 2) for s in ("tok", "lem")])


@query
def pos_cosine(spark, d):
    return _pos(spark, d, True)


@query
def pos_cosine_dups(spark, d):
    return _pos(spark, d, False)


@query
def exploded_cosine(spark, d):
    pairs = turns.lag_pairs(prepared(spark, d), ["token"], drop_tail=True)
    out = alignment.exploded_cosine(pairs.select("source_file", "time", "token1", "token2"), ["source_file", "time"], "token1", "token2")
    return out.select("source_file", "time", F.round("cosine", 6).alias("cosine"))


@query
def vocab_freq(spark, d):
    return vocabulary.frequencies(prepared(spark, d))


@query
def vocab_filtered(spark, d):
    return vocabulary.filtered(vocabulary.frequencies(prepared(spark, d)))


@query
def token_filter(spark, d):
    own = prepared(spark, d)
    kept = vocabulary.keep_known(own, vocabulary.filtered(vocabulary.frequencies(own, "token"), 2, 1), "token")
    return kept.select("source_file", "turn", joined("token"))


def vectors(spark, d, own):
    return embeddings.ranked_vectors(vocabulary.frequencies(own, "token"), spark.read.parquet(f"{d}/embeddings.parquet"))


@query
def mean_pool(spark, d):
    own = prepared(spark, d)
    out = embeddings.mean_pooled(own, vectors(spark, d, own), {"v": "token"}, 64)
    return out.select("source_file", "turn", F.posexplode_outer("v").alias("place", "x")).select("source_file", "turn", F.col("place").cast("long").alias("place"), F.round("x", 6).alias("x"))


@query
def static_similarity(spark, d):
    own = prepared(spark, d)
    out = embeddings.static_similarity(own, vectors(spark, d, own))
    return rounded(out.select("source_file", "time", *[c for c in out.columns if c.endswith("_similarity")]), "source_file", "time")


@query
def contextual_similarity(spark, d):
    out = embeddings.contextual_similarity(prepared(spark, d))
    return out.select("source_file", "time", F.round("encoder_cosine_similarity", 6).alias("encoder_cosine_similarity"))


@query
def surrogate_pairs(spark, d):
    return surrogates.file_pairs(surrogates.files(raw(spark, d)))


@query
def surrogate_sample(spark, d):
    return surrogates.file_pairs(surrogates.files(raw(spark, d)), sample=True, seed=7)


def named_turns(spark, d):
    """Turns without their contents, which surrogates of turns do not show."""
    return speakers_merged(raw(spark, d)).drop("content")


def _surrogate(df):
    return df.select("source_file", "turn", "participant", "original_file", "original_turn", "condition")


@query
def surrogate_turns(spark, d):
    return _surrogate(surrogates.surrogates(named_turns(spark, d)))


@query
def surrogate_shuffled(spark, d):
    return _surrogate(surrogates.surrogates(named_turns(spark, d), all_pairs=False, keep_order=False, seed=7))


@query
def surrogate_one_per_dyad(spark, d):
    return _surrogate(surrogates.surrogates(named_turns(spark, d), one_per_dyad=True))


METRICS = ["lexical_tok1_cosine", "lexical_lem1_cosine", "lexical_master_cosine"]


def real(spark, d):
    return alignment.lexsyn(turns.enough_turns(prepared(spark, d)), max_ngram=1)


def chance(spark, d):
    return pipeline.lexical_baseline(prepared(spark, d), max_ngram=1)


@query
def baseline_lexical(spark, d):
    return chance(spark, d).select("source_file", "time", *[F.round(c, 6).alias(c) for c in METRICS])


@query
def merged_metrics(spark, d):
    own = prepared(spark, d)
    out = pipeline.masters_in_capitals(pipeline.analyze(own, analyzers="all", max_ngram=1, vectors=vectors(spark, d, own)))
    return rounded(out.select("source_file", "time", "LEXICAL_MASTER_COSINE", "static_cosine_similarity", "MASTER_STATIC_COSINE_SIMILARITY", "encoder_cosine_similarity"), "source_file", "time")


@query
def describe_metrics(spark, d):
    return rounded(statistics.describe(real(spark, d), METRICS), "metric", "n")


@query
def metric_corr(spark, d):
    return rounded(statistics.correlations(real(spark, d), METRICS), "a", "b")


@query
def real_vs_baseline(spark, d):
    return rounded(statistics.compare(real(spark, d), chance(spark, d), METRICS), "metric", "real_n", "baseline_n", "effect")


@query
def metric_histogram(spark, d):
    return statistics.histogram(real(spark, d).select(F.round("lexical_tok1_cosine", 6).alias("x")), "x")


@query
def direction_summary(spark, d):
    return rounded(statistics.by_direction(real(spark, d), "lexical_master_cosine"), "utter_order", "n")


ORACLES = oracles.ORACLES
