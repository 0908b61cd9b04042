"""Lexical and syntactic alignment of pairs of turns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.functions import bags
from turnwise.functions import similarity as sim
from turnwise.operators.turns import lag_pairs

#: Pairs that go to Python at once.
BATCH = 2000
NAMES = (("tok", "token"), ("lem", "lemma"))


def tagged_columns(taggers: Sequence[str]) -> list[str]:
    return [f"tagged_{p}_{name}" if p else f"tagged_{name}" for _, name in NAMES for p in taggers]


def lexsyn(turns: DataFrame, lag: int = 1, max_ngram: int = 2, ignore_duplicates: bool = True, taggers: Sequence[str] = ("",)) -> DataFrame:
    """Cosines of each turn with the one `lag` on: lexical_tok1_cosine, lexical_lem1_cosine,
    pos_tok1_cosine, pos_lem1_cosine and so on for each n, and the two masters.

    A side without tokens gives null, one with fewer than n tokens 0.  With ignore_duplicates, a
    gram (word and tag) that the other side has, too, does not count for syntax; then two equal
    turns score 0.  The lexical master is null if one of its parts is; the syntactic one is the
    mean over n of 2 or more, null if there is none."""
    pairs = lag_pairs(turns, ["content", "token", "lemma", *tagged_columns(taggers)], lag)
    return lexsyn_metrics(pairs, max_ngram, ignore_duplicates, taggers)


def lexsyn_metrics(pairs: DataFrame, max_ngram: int = 2, ignore_duplicates: bool = True, taggers: Sequence[str] = ("",)) -> DataFrame:
    """lexsyn()'s columns on pairs of turns with tokens, lemmas and tags: a projection, which moves no
    row.  n-grams of many pairs are counted at once, in batches."""
    if max_ngram < 1:
        raise ValueError("max_ngram must be 1 or more")
    pairs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH))
    count = bags.pair_scores([name for _, name in NAMES], len(taggers), max_ngram, ignore_duplicates)
    kind = "struct<" + ",".join(f"{k}:double" for k in bags.fields(len(NAMES), len(taggers), max_ngram)) + ">"
    tagged = tagged_columns(taggers)
    taken = [f"{c}{s}" for i, (_, name) in enumerate(NAMES) for c in (name, *tagged[i * len(taggers) : (i + 1) * len(taggers)]) for s in "12"]
    lexical, syntactic, made = [], [], {}
    for n in range(1, max_ngram + 1):
        for i, (short, _) in enumerate(NAMES):
            lexical.append(f"lexical_{short}{n}_cosine")
            made[lexical[-1]] = F.col(f"_scores.s{i}__{n}")
            for t, prefix in enumerate(taggers):
                column = f"{prefix + '_' if prefix else ''}pos_{short}{n}_cosine"
                if n > 1:
                    syntactic.append(column)
                made[column] = F.col(f"_scores.s{i}_{t}_{n}")
    pairs = pairs.withColumn("_scores", F.arrow_udf(count, kind)(*taken)).withColumns(made).drop("_scores", *[f"{c}{s}" for c in tagged for s in "12"])
    pairs = pairs.withColumn("lexical_master_cosine", sim.strict_mean([F.col(c) for c in lexical]))
    master = sim.strict_mean([F.col(c) for c in syntactic]) if syntactic else F.lit(None).cast("double")
    return pairs.withColumn("syntactic_master_cosine", master)


def tagger_of(turns: DataFrame) -> str | None:
    """The prefix of the further tagger whose tags turns hold, if any."""
    return next((p for p in ("stan", "spacy") if f"tagged_{p}_token" in turns.columns), None)


def in_result_order(pairs: DataFrame) -> DataFrame:
    """The columns of lexsyn() in their order: turn, pair, cosines by n, masters, further ones."""
    first = ["time", "source_file", "participant", "content", "token", "lemma", "tagged_token", "tagged_lemma", *[f"tagged_{p}_{n}" for p in ("stan", "spacy") for n in ("token", "lemma")]]
    first += ["lag", "utter_order", "content1", "content2", "utterance_length1", "utterance_length2"]
    numbers = sorted({int(c.removeprefix("lexical_tok").removesuffix("_cosine")) for c in pairs.columns if c.startswith("lexical_tok") and c.endswith("_cosine")})
    first += [f"{kind}_{s}{n}_cosine" for n in numbers for kind in ("lexical", "pos", "stan_pos", "spacy_pos") for s in ("tok", "lem")]
    first += ["lexical_master_cosine", "syntactic_master_cosine"]
    known = [c for c in first if c in pairs.columns]
    return pairs.select(*known, *[c for c in pairs.columns if c not in known])


def bag_cosines(pairs: DataFrame, keys: Sequence[str], bags: dict) -> DataFrame:
    """(keys, a column for each bag): cosines of the counts of two string arrays, for several pairs
    of arrays (condition, left, right) at once; null where the condition fails, 0 if a side is
    empty.

    Items are exploded and counted by hash aggregation, so the work is linear in the items, and as
    all keys begin with the column by which pairs are partitioned, nothing is shuffled again."""
    keys, names = list(keys), list(bags)
    side = lambda items, s: F.transform(items, lambda x: F.struct(x.alias("g"), F.lit(s).alias("s")))
    marker = F.array(F.struct(F.lit(None).cast("string").alias("g"), F.lit(0).alias("s")))  # keeps a bag without items
    rows = [F.struct(F.lit(i).alias("bag"), F.when(some, F.concat(marker, side(a, 1), side(b, 2))).alias("items")) for i, (some, a, b) in enumerate(bags.values())]
    items = pairs.select(*keys, F.explode(F.array(*rows)).alias("x")).select(*keys, F.col("x.bag").alias("bag"), F.explode("x.items").alias("y"))
    counts = items.groupBy(*keys, "bag", F.col("y.g").alias("g")).agg(F.sum((F.col("y.s") == 1).cast("long")).alias("a"), F.sum((F.col("y.s") == 2).cast("long")).alias("b"))
    total = lambda x, y: F.sum(F.col(x) * F.col(y))
    sums = counts.groupBy(*keys, "bag").agg(total("a", "b").alias("ab"), total("a", "a").alias("aa"), total("b", "b").alias("bb"))
    value = F.when((F.col("aa") == 0) | (F.col("bb") == 0), 0.0).otherwise(F.col("ab") / (F.sqrt(F.col("aa").cast("double")) * F.sqrt(F.col("bb").cast("double"))))
    wide = sums.groupBy(*keys).agg(*[F.max(F.when(F.col("bag") == i, value)).alias(n) for i, n in enumerate(names)])
    return wide


def exploded_cosine(pairs: DataFrame, keys: Sequence[str], left: str, right: str, name: str = "cosine") -> DataFrame:
    """pairs with the cosine of the counts of two array columns; 0 if either is empty or null."""
    bags = {name: (F.lit(True), F.coalesce(left, F.array().cast("array<string>")), F.coalesce(right, F.array().cast("array<string>")))}
    return pairs.join(bag_cosines(pairs, keys, bags), list(keys))
