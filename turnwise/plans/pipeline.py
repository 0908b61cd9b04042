"""Whole analyses as one lazy plan each: prepare(), analyze() and baseline()."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.functions import morphology
from turnwise.functions.cleaning import MODES
from turnwise.operators import alignment, chance, embeddings, spelling, surrogates, turns, vocabulary

ANALYZERS = ("lexsyn", "static", "contextual")


@dataclass(frozen=True)
class PrepareOptions:
    """How raw turns are prepared.  spelling_model: (word, n), or None for no correction."""

    min_words: int = 2
    filler_mode: str = "regex"
    fillers: Sequence[str] = ()
    spelling_model: DataFrame | None = None
    tagger: morphology.Tagger = morphology.rule_tags
    lemmatizer: morphology.Lemmatizer = morphology.rule_lemmas
    extra_taggers: dict[str, morphology.Tagger] = field(default_factory=dict)

    def __post_init__(self):
        if self.min_words < 0:
            raise ValueError("min_words must not be negative")
        if self.filler_mode not in MODES:
            raise ValueError(f"filler_mode must be one of {MODES}")
        if not set(self.extra_taggers) <= {"stan", "spacy"}:
            raise ValueError("extra taggers are stan and spacy")


@dataclass(frozen=True)
class AnalyzeOptions:
    """What is measured.  analyzers: some of lexsyn, static, contextual, or "all"; cache: where
    encodings are kept."""

    analyzers: str | Sequence[str] = ("lexsyn",)
    lag: int = 1
    max_ngram: int = 2
    ignore_duplicates: bool = True
    taggers: Sequence[str] = ("",)
    vectors: DataFrame | None = None
    dims: int = 64
    low: int = 1
    sd: float | None = 3
    filter_vocabulary: bool = False
    encoder: Callable = embeddings.letter_counts
    model: str = "encoder"
    cache: str | None = None

    def chosen(self) -> list[str]:
        names = [self.analyzers] if isinstance(self.analyzers, str) else list(self.analyzers)
        names = list(ANALYZERS) if names == ["all"] else names
        if not names or not set(names) <= set(ANALYZERS):
            raise ValueError(f"analyzers are {ANALYZERS}")
        return names


@dataclass(frozen=True)
class SurrogateOptions:
    all_pairs: bool = True
    keep_order: bool = True
    separator: str = "-"
    dyad_label: str = "dyad"
    condition_label: str = "cond"
    seed: int = 0
    one_per_dyad: bool = False


def prepare(raw: DataFrame, options: PrepareOptions | None = None, **changes) -> DataFrame:
    """Clean, drop short turns, merge runs of a speaker, tokenize, correct, lemmatize and tag."""
    o = replace(options or PrepareOptions(), **changes)
    out = turns.tokenize(turns.merge_adjacent(turns.clean(turns.dealt(raw), o.filler_mode, o.fillers, o.min_words)))
    if o.spelling_model is not None:
        out = spelling.corrected_tokens(out, o.spelling_model)
    return turns.annotate(out, o.tagger, o.lemmatizer, o.extra_taggers)


def analyze(prepared: DataFrame, options: AnalyzeOptions | None = None, **changes) -> DataFrame:
    """All chosen metrics of each pair of turns; files of one turn are left out.  What analyzers
    need of a turn is added to it first; then turns are paired once, for all of them."""
    o = replace(options or AnalyzeOptions(), **changes)
    chosen, own = o.chosen(), turns.enough_turns(prepared)
    paired = [c for c in ("content", "token", "lemma") if c in own.columns]
    if "static" in chosen:
        known = vocabulary.filtered(vocabulary.frequencies(own), o.low, o.sd) if o.filter_vocabulary else None
        own = embeddings.with_static(own, o.vectors, o.dims, known)
        paired += [f"{c}_embedding" for c in embeddings.STATIC]
    if "contextual" in chosen:
        own = embeddings.with_encoding(own, o.encoder, o.cache)
        paired.append("_vector")
    if "lexsyn" in chosen:
        paired += alignment.tagged_columns(o.taggers)
    out = turns.lag_pairs(own, paired, o.lag)
    if "lexsyn" in chosen:
        out = alignment.lexsyn_metrics(out, o.max_ngram, o.ignore_duplicates, o.taggers)
    if "static" in chosen:
        out = embeddings.static_metrics(out)
    return embeddings.contextual_metrics(out, o.model) if "contextual" in chosen else out


def analyze_file(prepared: DataFrame, source_file: str, options: AnalyzeOptions | None = None, **changes) -> DataFrame:
    """analyze() of one file."""
    return analyze(prepared.where(F.col("source_file") == source_file), options, **changes)


def baseline(prepared: DataFrame, options: AnalyzeOptions | None = None, made: SurrogateOptions | None = None, existing: DataFrame | None = None, **changes) -> DataFrame:
    """analyze() over surrogates, made from prepared turns (whose tokens, lemmas and tags come
    along) or given."""
    m = made or SurrogateOptions()
    if existing is None:
        labels = {"separator": m.separator, "dyad_label": m.dyad_label, "condition_label": m.condition_label}
        surrogates.check_enough(prepared, **labels)
        existing = surrogates.surrogates(prepared, m.all_pairs, m.keep_order, seed=m.seed, one_per_dyad=m.one_per_dyad, **labels)
    return analyze(existing, options, **changes)


def lexical_baseline(prepared: DataFrame, max_ngram: int = 2, lag: int = 1, made: SurrogateOptions | None = None) -> DataFrame:
    """The lexical scores of baseline() by source_file and time, without its turns.  Surrogates of all
    pairs in order and an odd lag need no turn of a surrogate; surrogates of one name are then
    measured each on its own.  Others are made."""
    m = made or SurrogateOptions()
    scores = [*[f"lexical_{b}_cosine" for b in chance.bags(max_ngram)], "lexical_master_cosine"]
    if not m.all_pairs or not m.keep_order or m.one_per_dyad or lag % 2 == 0:
        return baseline(prepared, made=m, max_ngram=max_ngram, lag=lag).select("source_file", "time", *scores)
    labels = {"separator": m.separator, "dyad_label": m.dyad_label, "condition_label": m.condition_label}
    surrogates.check_enough(prepared, **labels)
    return chance.lexical_chance(prepared, max_ngram, lag, **labels)


def masters_in_capitals(df: DataFrame) -> DataFrame:
    """The master columns under their names in merged results."""
    names = {c: c.upper() for c in df.columns if c.endswith("_master_cosine") or c.startswith("master_")}
    return df.select(*[F.col(c).alias(names.get(c, c)) for c in df.columns])
