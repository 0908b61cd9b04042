"""Names and writers of results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lexsyn_name(max_ngram: int = 2, lag: int = 1, ignore_duplicates: bool = True, tagger: str | None = None) -> str:
    extra = {None: "noAdd", "stan": "withStan", "spacy": "withSpacy"}[tagger]
    return f"lexsyn_alignment_ngram{max_ngram}_lag{lag}_{'noDups' if ignore_duplicates else 'withDups'}_{extra}.csv"


def static_name(lag: int = 1, sd: float | None = 3, low: int = 1) -> str:
    return f"semantic_alignment_fasttext_lag{lag}_sd{sd}_n{low}.csv"


def contextual_name(model: str, lag: int = 1) -> str:
    return f"semantic_alignment_{model}_lag{lag}.csv"


def merged_name(lag: int = 1, max_ngram: int = 2, ignore_duplicates: bool = True, tagger: str | None = None, sd: float | None = 3, low: int = 1) -> str:
    extra = {None: "noAdd", "stan": "withStan", "spacy": "withSpacy"}[tagger]
    return f"merged-lag{lag}-ngram{max_ngram}-{extra}-{'noDups' if ignore_duplicates else 'withDups'}-sd{sd}-n{low}.csv"


def baseline_name(name: str) -> str:
    return f"baseline_{name}"


def _flat(df: DataFrame) -> DataFrame:
    """Vectors go, lists become text."""
    kinds = dict(df.dtypes)
    df = df.drop(*[c for c, k in kinds.items() if k.startswith(("array<float", "array<double"))], *[c for c in kinds if c.endswith("_dims")])
    return df.select(*[F.to_json(c).alias(c) if kinds[c].startswith(("array", "struct", "map")) else F.col(c) for c in df.columns])


def write_csv(df: DataFrame, path: str, separator: str = ",") -> None:
    _flat(df).write.mode("overwrite").option("header", True).option("sep", separator).csv(path)


def write_transcripts(turns: DataFrame, path: str) -> None:
    """One folder for each conversation, with its turns in order."""
    turns.repartition("source_file").sortWithinPartitions("source_file", "turn").write.mode("overwrite").partitionBy("source_file").parquet(path)


def write_surrogates(made: DataFrame, path: str) -> None:
    """write_transcripts() of surrogates; raises if there are none."""
    if made.isEmpty():
        raise ValueError("no surrogate was made")
    write_transcripts(made, path)


def write_vocabulary(counts: DataFrame, path: str) -> None:
    write_csv(counts.orderBy(F.desc("count"), "word"), path, "\t")
