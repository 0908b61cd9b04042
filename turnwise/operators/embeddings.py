"""Semantic alignment: static word vectors and encoders of whole utterances."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from turnwise.functions.similarity import dense_cosine, present_mean
from turnwise.operators.turns import lag_pairs, parts


def ranked_vectors(counts: DataFrame, embeddings: DataFrame) -> DataFrame:
    """(word, vector): the word of rank r, by count and then by code point, has vector r - 1.

    Words are numbered among those of one count and the same first letters; where these groups begin
    is summed up by group, then by count.  So no task orders all words: the one window without a
    partition has a row for each count that occurs."""
    own = counts.withColumn("_head", F.substring("word", 1, 2))
    heads = own.groupBy("count", "_head").agg(F.count("*").alias("_n"))
    before = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    levels = heads.groupBy("count").agg(F.sum("_n").alias("_n")).select("count", before(Window.orderBy(F.desc("count"))).alias("_level"))
    heads = heads.select("count", "_head", before(Window.partitionBy("count").orderBy("_head")).alias("_start"))
    number = F.row_number().over(Window.partitionBy("count", "_head").orderBy("word")) - 1
    placed = own.withColumn("_number", number).join(heads, ["count", "_head"]).join(levels, "count")
    ranked = placed.select("word", (F.col("_level") + F.col("_start") + F.col("_number")).alias("vec_id"))
    return ranked.join(embeddings, "vec_id").select("word", F.col("embedding").alias("vector"))


def content_tokens(content: Column) -> Column:
    return F.filter(F.split(F.lower(content), r"\s+"), lambda w: w != "")


def mean_pooled(turns: DataFrame, vectors: DataFrame, columns: dict[str, str | Column], dims: int) -> DataFrame:
    """turns with a mean vector for each of the columns (name of the vector: token column), repeats
    counted; null if no token is known.

    Tokens are counted by turn, and conversations dealt out in blocks, the more the larger the input; each
    block gets the vectors of its words once.  So a turn is summed up in one place, with no partial sums
    for each of its words, and what a task holds does not grow with the input."""
    names = list(columns)
    turns.sparkSession.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    blocks = parts(turns)

    def marked(i: int, c: str | Column) -> Column:
        found = F.transform(c if isinstance(c, Column) else F.col(c), lambda w: F.struct(F.lit(i).alias("which"), w.alias("word")))
        return F.coalesce(found, F.array().cast("array<struct<which:int,word:string>>"))

    lists = [marked(i, c) for i, c in enumerate(columns.values())]
    items = turns.select("source_file", "turn", F.explode(F.concat(*lists)).alias("_x")).select("source_file", "turn", F.col("_x.which").alias("_which"), F.col("_x.word").alias("word"))
    counts = items.groupBy("source_file", "turn", "word").agg(*[F.count(F.when(F.col("_which") == i, True)).alias(f"_n{i}") for i in range(len(names))])
    block = F.pmod(F.hash("source_file"), F.lit(blocks))
    tokens = counts.where("word is not null").withColumn("_block", block).repartition(blocks, "_block")
    words = items.where("word is not null").select(block.alias("_block"), "word").distinct()
    near = words.join(vectors, "word").repartition(blocks, "_block")
    known = tokens.join(near.hint("merge"), ["_block", "word"])
    sums = [F.sum(F.col("vector")[i].cast("double") * F.col("_n")).alias(f"_s{i}") for i in range(dims)]
    each = F.explode(F.filter(F.array(*[F.struct(F.lit(i).alias("which"), F.col(f"_n{i}").alias("n")) for i in range(len(names))]), lambda x: x["n"] > 0)).alias("_x")
    known = known.select("_block", "source_file", "turn", "vector", each).select("_block", "source_file", "turn", F.col("_x.which").alias("_which"), F.col("_x.n").alias("_n"), "vector")
    pooled = known.groupBy("_block", "source_file", "turn", "_which").agg(F.sum("_n").alias("_all"), *sums)
    pooled = pooled.select("_block", "source_file", "turn", "_which", F.array(*[F.col(f"_s{i}") / F.col("_all") for i in range(dims)]).alias("_mean"))
    wide = pooled.groupBy("_block", "source_file", "turn").agg(*[F.max(F.when(F.col("_which") == i, F.col("_mean"))).alias(n) for i, n in enumerate(names)]).drop("_block")
    return turns.join(wide, ["source_file", "turn"], "left")


STATIC = ("content", "token", "lemma")


def with_static(turns: DataFrame, vectors: DataFrame | None, dims: int = 64, vocabulary: DataFrame | None = None) -> DataFrame:
    """turns with content_embedding, token_embedding and lemma_embedding, all null without vectors.
    A vocabulary restricts tokens."""
    if vectors is None:
        return turns.select("*", *[F.lit(None).cast("array<double>").alias(f"{c}_embedding") for c in STATIC])
    if vocabulary is not None:
        vectors = vectors.join(vocabulary.select("word"), "word", "left_semi")
    return mean_pooled(turns, vectors, {"content_embedding": content_tokens(F.col("content")), "token_embedding": "token", "lemma_embedding": "lemma"}, dims)


def static_metrics(pairs: DataFrame, model: str = "static") -> DataFrame:
    """The cosines of pairs of with_static() turns, the mean of those there are, and dimensions."""
    names = {"content": f"{model}_cosine_similarity", "token": f"token_{model}_cosine_similarity", "lemma": f"lemma_{model}_cosine_similarity"}
    for column, name in names.items():
        pairs = pairs.withColumn(f"{column}_dims", F.when(F.col(f"{column}_embedding").isNotNull(), F.size(f"{column}_embedding")))
        pairs = pairs.withColumn(name, dense_cosine(F.col(f"{column}_embedding1"), F.col(f"{column}_embedding2")))
    return pairs.withColumn(f"master_{model}_cosine_similarity", present_mean([F.col(c) for c in names.values()])).drop(*[f"{c}_embedding" for c in names])


def static_similarity(turns: DataFrame, vectors: DataFrame | None, lag: int = 1, model: str = "static", dims: int = 64, vocabulary: DataFrame | None = None) -> DataFrame:
    """Cosines of the mean vectors of content, tokens and lemmas with those `lag` turns on, and the
    mean of those there are.  Without vectors all are null.  A vocabulary restricts tokens."""
    own = with_static(turns, vectors, dims, vocabulary)
    return static_metrics(lag_pairs(own, [*STATIC, *(f"{c}_embedding" for c in STATIC)], lag), model)


def letter_counts(content: Column) -> Column:
    """A stand-in encoder without a model: the counts of the letters a to z."""
    text = F.lower(content)
    return F.when(F.trim(content) != "", F.array(*[(F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))).cast("double") for c in "abcdefghijklmnopqrstuvwxyz"]))


def model_encoder(load: Callable[[], Callable[[Sequence[str]], Sequence[Sequence[float]]]]) -> Callable[[Column], Column]:
    """An encoder column from a model: load() runs once for each Python worker, and what it returns
    encodes a batch of texts.  Blank and null texts are null."""

    @F.pandas_udf("array<float>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            some = texts[texts.notna() & (texts.str.strip() != "")]
            found = pd.Series([None] * len(texts), index=texts.index, dtype=object)
            if len(some):
                for at, vector in zip(some.index, model(some.tolist()), strict=True):
                    found[at] = [float(x) for x in vector]
            yield found

    return encode


def model_states(load: Callable[[], Callable[[Sequence[str]], Sequence[Sequence[Sequence[float]]]]], most: int = 512) -> Callable[[Column], Column]:
    """An encoder column of raw states, a vector for each of the first `most` positions of a text;
    load() and blank texts are as in model_encoder()."""

    @F.pandas_udf("array<array<float>>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            some = texts[texts.notna() & (texts.str.strip() != "")]
            found = pd.Series([None] * len(texts), index=texts.index, dtype=object)
            if len(some):
                for at, states in zip(some.index, model(some.tolist()), strict=True):
                    found[at] = [[float(x) for x in state] for state in states[:most]]
            yield found

    return encode


def mean_state(states: Column) -> Column:
    """The mean of a text's states over all positions; null if there are none."""
    wide = F.transform(states, lambda state: F.transform(state, lambda x: x.cast("double")))
    total = F.aggregate(F.slice(wide, F.lit(2), F.greatest(F.size(wide) - 1, F.lit(0))), F.get(wide, F.lit(0)), lambda a, b: F.zip_with(a, b, lambda x, y: x + y))
    return F.transform(total, lambda x: x / F.size(wide))


def cached_encoding(texts: DataFrame, encoder: Callable[[Column], Column], path: str) -> DataFrame:
    """(content, _vector) of distinct contents, kept in a Parquet table at path: contents that it
    holds are not encoded again, others are encoded and appended to it now."""
    spark = texts.sparkSession
    try:
        known = spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        known = None
    new = texts if known is None else texts.join(known, "content", "left_anti")
    new.withColumn("_vector", encoder(F.col("content"))).write.mode("append").parquet(path)
    return spark.read.parquet(path).join(texts, "content", "left_semi")


def with_encoding(turns: DataFrame, encoder: Callable[[Column], Column] = letter_counts, cache: str | None = None) -> DataFrame:
    """turns with _vector, the encoding of the content.  Each distinct content is encoded once; with
    a cache, the path of a Parquet table, once for all runs that share it.  Contents alone meet their
    encodings, which then go to their turns; what else a turn holds is not moved."""
    texts = turns.select("content").where("content is not null").distinct()
    texts = texts.withColumn("_vector", encoder(F.col("content"))) if cache is None else cached_encoding(texts, encoder, cache)
    found = turns.select("source_file", "turn", "content").join(texts, "content").select("source_file", "turn", "_vector")
    return turns.join(found, ["source_file", "turn"], "left")


def contextual_metrics(pairs: DataFrame, model: str = "encoder", keep_vectors: bool = False) -> DataFrame:
    """The cosine of pairs of with_encoding() turns."""
    pairs = pairs.withColumn(f"{model}_cosine_similarity", dense_cosine(F.col("_vector1"), F.col("_vector2"))).drop("_vector")
    for side in "12":
        name = f"content{side}_embedding_{model}"
        pairs = pairs.withColumnRenamed(f"_vector{side}", name).withColumn(f"{name}_dims", F.size(name))
        if not keep_vectors:
            pairs = pairs.drop(name)
    return pairs


def contextual_similarity(turns: DataFrame, encoder: Callable[[Column], Column] = letter_counts, lag: int = 1, model: str = "encoder", keep_vectors: bool = False) -> DataFrame:
    """Cosine of the encodings of contents `lag` turns apart; a vector is joined to its turn and
    paired, so no turn is encoded as both sides."""
    return contextual_metrics(lag_pairs(with_encoding(turns, encoder), ["content", "_vector"], lag), model, keep_vectors)


def in_static_order(pairs: DataFrame) -> DataFrame:
    """static_similarity()'s columns as results have them: without tags, the cosines last."""
    kept = [c for c in pairs.columns if not c.startswith("tagged_")]
    scores = [c for c in kept if c.endswith("_cosine_similarity")]
    return pairs.select(*[c for c in kept if c not in scores], *scores)


def in_contextual_order(pairs: DataFrame, model: str = "encoder") -> DataFrame:
    """The columns of contextual_similarity() that results have, in their order; others go."""
    sides = [f"content{s}_embedding_{model}{x}" for s in "12" for x in ("", "_dims")]
    names = ["source_file", "participant", "content", "lag", "content1", "content2", "utter_order", *sides, f"{model}_cosine_similarity"]
    return pairs.select(*[c for c in names if c in pairs.columns])
