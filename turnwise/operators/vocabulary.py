"""Word frequencies of all turns and the vocabulary that is left after filtering."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def frequencies(turns: DataFrame, column: str = "lemma") -> DataFrame:
    """(word, count) over a token column, or over a text column without punctuation."""
    kind = dict(turns.dtypes)[column]
    words = F.col(column) if kind.startswith("array") else F.filter(F.split(F.regexp_replace(F.lower(F.col(column)), r"[^\w\s]+", ""), r"\s+"), lambda w: w != "")
    return turns.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("count"))


def filtered(counts: DataFrame, low: int = 1, sd: float | None = 3) -> DataFrame:
    """Words longer than a letter with a count above low and, unless sd is None, below the mean plus
    sd population deviations of the counts so far.  The moments are one row, joined by broadcast."""
    some = counts.where((F.length("word") > 1) & (F.col("count") > low))
    if sd is None:
        return some
    limit = some.agg((F.avg("count") + F.stddev_pop("count") * sd).alias("_limit"))
    return some.join(F.broadcast(limit)).where(F.col("count") < F.col("_limit")).drop("_limit")


def keep_known(turns: DataFrame, vocabulary: DataFrame, column: str = "token") -> DataFrame:
    """turns with only the tokens of the vocabulary (all, if it is empty)."""
    if vocabulary.isEmpty():
        return turns
    known = turns.select("source_file", "turn", F.posexplode(column).alias("_at", "word")).join(vocabulary.select("word"), "word", "left_semi")
    again = known.groupBy("source_file", "turn").agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "word"))), lambda x: x["word"]).alias("_kept"))
    out = turns.join(again, ["source_file", "turn"], "left")
    return out.withColumn(column, F.when(F.col(column).isNotNull(), F.coalesce("_kept", F.array().cast("array<string>")))).drop("_kept")
