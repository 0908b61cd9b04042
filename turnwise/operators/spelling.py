"""Spelling correction against word counts, by joins on deletions instead of lists of all edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def train(texts: DataFrame, text: str = "text") -> DataFrame:
    """(word, n) of runs of a-z in lower-cased texts; n is the count plus one."""
    found = texts.select(F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit("[a-z]+"), F.lit(0))).alias("word"))
    return found.groupBy("word").agg((F.count("*") + 1).alias("n"))


def _without_one(word: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))


def _swaps(word: Column) -> Column:
    places = F.sequence(F.lit(1), F.greatest(F.length(word) - 1, F.lit(1)))
    return F.transform(places, lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.lit(1)), F.substring(word, i, F.lit(1)), F.substring(word, i + 2, F.length(word))))


def _deletions(word: Column, most: int) -> Column:
    some = F.when(F.length(word) > 0, _without_one(word)).otherwise(F.array().cast("array<string>"))
    out = F.concat(F.array(word), some)
    if most > 1:
        out = F.concat(out, F.flatten(F.transform(F.filter(some, lambda w: F.length(w) > 0), _without_one)))
    return F.array_distinct(out)


def _one_edit(a: Column, b: Column) -> Column:
    return (F.levenshtein(a, b) <= 1) | F.array_contains(_swaps(a), b)


def _two_edits(a: Column, b: Column) -> Column:
    swapped = F.exists(_swaps(a), lambda w: F.levenshtein(w, b) <= 1) | F.exists(_swaps(b), lambda w: F.levenshtein(a, w) <= 1)
    # a swap changes no letter, so with one the sorted letters are at most one edit of the word apart
    letters = lambda w: F.array_join(F.array_sort(F.split(w, "")), "")
    alike = F.levenshtein(letters(a), letters(b), 2) >= 0
    return (F.levenshtein(a, b, 2) >= 0) | (alike & (swapped | F.arrays_overlap(_swaps(a), _swaps(b))))


def corrections(words: DataFrame, model: DataFrame, edits: int = 2) -> DataFrame:
    """(word, corrected) of the distinct words: itself if known or if it holds an apostrophe, else
    the most frequent known word one edit away (ties: the first by code point), else two edits
    away, else itself.  An edit deletes, inserts, replaces or swaps neighbours."""
    words = words.select("word").where("word is not null").distinct()
    words = words.join(model.select("word", F.lit(True).alias("known")), "word", "left")
    words = words.select("word", (F.coalesce("known", F.lit(False)) | F.col("word").contains("'")).alias("fixed"))
    lost = words.where("not fixed").select("word")
    best = _nearest(lost, model, 1)
    if edits > 1:
        # lists of two deletions are long, so only words with nothing one edit away get them
        best = best.unionByName(_nearest(lost.join(best.select("word"), "word", "left_anti"), model, 2))
    return words.join(best, "word", "left").select("word", F.coalesce("near", "word").alias("corrected"))


def _nearest(lost: DataFrame, model: DataFrame, edits: int) -> DataFrame:
    """(word, near): the most frequent known word at most `edits` away (ties: the first by code point)
    of the words that have one; for two edits, words with one a single edit away must be left out.
    What both sides can be cut down to is joined; words are few bytes and many cuts, so they are dealt
    out by number, not by size."""
    tasks = int(model.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lost, model = lost.repartition(tasks, "word"), model.repartition(tasks, "word")
    cut = lost.select("word", F.explode(_deletions(F.col("word"), edits)).alias("cut"))
    known = model.select(F.col("word").alias("known"), "n", F.explode(_deletions(F.col("word"), edits)).alias("cut"))
    met = cut.join(known, "cut").select("word", "known", "n").distinct()
    near = met.where((_one_edit if edits == 1 else _two_edits)(F.col("word"), F.col("known")))
    return near.groupBy("word").agg(F.min_by("known", F.struct((-F.col("n")).alias("m"), "known")).alias("near"))


def corrected_tokens(turns: DataFrame, model: DataFrame, edits: int = 2) -> DataFrame:
    """turns with each token corrected; distinct tokens are corrected once and joined back."""
    exploded = turns.select("source_file", "turn", F.posexplode("token").alias("_at", "word"))
    fixed = exploded.join(corrections(exploded, model, edits), "word", "left")
    again = fixed.groupBy("source_file", "turn").agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "corrected"))), lambda x: x["corrected"]).alias("_fixed"))
    out = turns.join(again, ["source_file", "turn"], "left")
    return out.withColumn("token", F.coalesce("_fixed", "token")).drop("_fixed")
