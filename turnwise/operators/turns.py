"""Operators over turns: (source_file, turn, participant, content) and what is derived from them.

All windows are partitioned by source_file, so cleaning, merging and pairing share one shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnwise.functions import cleaning, morphology, tokens


def in_order():
    """The turns of a file in order."""
    return Window.partitionBy("source_file").orderBy("turn")


#: Bytes of input, as it is stored, to a partition at most, and partitions at most.
PART_BYTES, PARTS = 2**20, 2**15


def parts(turns: DataFrame) -> int:
    """Into how many partitions turns are dealt: the number set for the session, or more if the files
    they come from are large, so that what a task holds does not grow with the input."""
    leaves = turns._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]
    known = sum(n for n in sizes if n < 2**60)  # a leaf of unknown size is said to be as large as can be
    return max(int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(-(-known // PART_BYTES), PARTS))


def dealt(turns: DataFrame) -> DataFrame:
    """turns dealt out by conversation, once: all windows and aggregates that follow keep to it.  The
    number of partitions is set, since the work for a byte of text is far above what its size
    makes the engine expect.  Joins by source_file and turn keep to it, too, which is a setting of the
    session, as plans run after they are built: then only the other side is moved."""
    turns.sparkSession.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return turns.repartition(parts(turns), "source_file")


def clean(turns: DataFrame, mode: str = "regex", fillers: Sequence[str] = (), min_words: int = 2) -> DataFrame:
    """Drop null contents, clean the rest, and drop turns of fewer than min_words tokens (0: none)."""
    some, out = turns.where(F.col("content").isNotNull()), cleaning.cleaned(F.col("content"), mode, fillers)
    if not min_words:
        return some.withColumn("content", out)
    # a list of one content or none, so that a text is cleaned once and not once for each use of it
    long = F.explode(F.filter(F.array(out), lambda c: F.size(tokens.words(c)) >= min_words)).alias("content")
    return some.select(*[long if c == "content" else c for c in some.columns])


def merge_adjacent(turns: DataFrame) -> DataFrame:
    """Collapse runs of turns of one speaker: contents joined by a space, turns renumbered from 0.
    Null speakers never merge."""
    new = F.coalesce((F.col("participant") != F.lag("participant").over(in_order())), F.lit(True)).cast("int")
    island = turns.withColumn("_new", new).withColumn("_island", F.sum("_new").over(in_order().rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.array_sort(F.collect_list(F.struct("turn", "content")))
    out = island.groupBy("source_file", "_island").agg(F.first("participant").alias("participant"), F.array_join(F.transform(parts, lambda x: x["content"]), " ").alias("content"))
    number = F.row_number().over(Window.partitionBy("source_file").orderBy("_island")) - 1
    return out.withColumn("turn", number.cast("long")).select("source_file", "turn", "participant", "content")


def tokenize(turns: DataFrame) -> DataFrame:
    return turns.withColumn("token", tokens.tokens(F.col("content")))


def annotate(turns: DataFrame, tagger: morphology.Tagger = morphology.rule_tags, lemmatizer: morphology.Lemmatizer = morphology.rule_lemmas, extra: dict[str, morphology.Tagger] | None = None) -> DataFrame:
    """Lemmas, and tags of tokens and of lemmas; extra taggers by prefix give tagged_<prefix>_*."""
    out = turns.withColumn("lemma", lemmatizer(F.col("token")))

    def pairs(words: str, tags: morphology.Tagger) -> Column:
        return F.zip_with(F.col(words), tags(F.col(words)), lambda w, t: F.struct(w.alias("word"), t.alias("tag")))

    for name in ("token", "lemma"):
        out = out.withColumn(f"tagged_{name}", pairs(name, tagger))
        for prefix, more in (extra or {}).items():
            out = out.withColumn(f"tagged_{prefix}_{name}", pairs(name, more))
    return out


def in_transcript_order(turns: DataFrame) -> DataFrame:
    """The columns of a prepared transcript in their order, further ones last."""
    first = ["participant", "content", "token", "lemma", "tagged_token", "tagged_lemma", *[f"tagged_{p}_{n}" for p in ("stan", "spacy") for n in ("token", "lemma")], "source_file", "turn"]
    known = [c for c in first if c in turns.columns]
    return turns.select(*known, *[c for c in turns.columns if c not in known])


def enough_turns(turns: DataFrame, least: int = 2) -> DataFrame:
    """Only files of `least` rows or more."""
    return turns.withColumn("_n", F.count("*").over(Window.partitionBy("source_file"))).where(F.col("_n") >= least).drop("_n")


def lag_pairs(turns: DataFrame, columns: Sequence[str], lag: int = 1, drop_tail: bool = False) -> DataFrame:
    """Each turn with the one `lag` turns on: <column>1 and <column>2, utter_order, time (from 1).
    The last turns of a file stay with nulls unless drop_tail."""
    if lag < 1:
        raise ValueError("lag must be 1 or more")
    window = in_order()
    made = [F.row_number().over(window).cast("long").alias("time"), F.lit(lag).alias("lag")]
    for c in columns:
        made += [F.col(c).alias(f"{c}1"), F.lead(c, lag).over(window).alias(f"{c}2")]
    if "participant" in turns.columns:
        made.append(F.concat("participant", F.lit(" "), F.lead("participant", lag).over(window)).alias("utter_order"))
    if drop_tail:
        made.append(F.lead("turn", lag).over(window).alias("_follows"))
    out = turns.select("*", *made)
    if "token" in columns:
        lengths = [F.when(F.col(f"token{s}").isNotNull(), F.size(f"token{s}")).otherwise(0).cast("long").alias(f"utterance_length{s}") for s in "12"]
        out = out.select("*", *lengths)
    if drop_tail:
        out = out.where("_follows is not null").drop("_follows")
    return out
