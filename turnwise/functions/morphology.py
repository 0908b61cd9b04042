"""Tags and lemmas of tokens.  The defaults are rules, written as SQL over one word `w`, which any
SQL engine reads; models plug in as functions from a token column to a column of the same length."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Closed-class words by tag.
LEXICON = {
    "DT": "a an the this that these those each every some any no all both".split(),
    "PRP": "i you he she it we they me him her us them myself yourself himself herself itself ourselves themselves".split(),
    "PRP$": "my your his its our their".split(),
    "IN": "in on at by for with of from about into over after before under between through during without if because while than as".split(),
    "TO": ["to"],
    "CC": "and or but nor yet so".split(),
    "MD": "can could will would shall should may might must".split(),
    "VBZ": "is has does".split(),
    "VBP": "am are have do need".split(),
    "VBD": "was were had did".split(),
    "VB": ["be"],
    "VBN": "been done gone".split(),
    "VBG": "being".split(),
    "WP": "who what whom".split(),
    "WRB": "when where why how".split(),
    "WDT": ["which"],
    "EX": ["there"],
    "RB": "not n't never always very too also just here now then".split(),
    "UH": "oh yes yeah hello hi okay".split(),
}
#: Endings by tag, the first that fits; the word must be longer by two letters.
ENDINGS = (("ly", "RB"), ("ing", "VBG"), ("eed", "NN"), ("ed", "VBD"), ("est", "JJS"), ("ous", "JJ"), ("ful", "JJ"), ("ive", "JJ"), ("able", "JJ"), ("ible", "JJ"), ("al", "JJ"), ("ss", "NN"), ("s", "NNS"))
#: Lemmas of irregular forms.
IRREGULAR = {
    "be": "am are is was were been being".split(),
    "have": "has had having".split(),
    "do": "does did done doing".split(),
    "go": "went gone goes".split(),
    "say": ["said"],
    "make": "made making".split(),
    "get": "got gotten".split(),
    "take": "took taken taking".split(),
    "come": "came coming".split(),
    "give": "gave given giving".split(),
    "know": "knew known".split(),
    "think": ["thought"],
    "man": ["men"],
    "child": ["children"],
    "foot": ["feet"],
    "tooth": ["teeth"],
    "mouse": ["mice"],
}
#: Closed-class words; they are lemmas unless they are irregular forms.
CLOSED = sorted({w for own in LEXICON.values() for w in own})
#: Detachments (ending, what takes its place) by word class, the first that fits.  A word is longer
#: than the ending by three letters or more, by two where the ending is in SHORT.
_DOUBLED = tuple((2 * c + end, c) for c in "bgmnprt" for end in ("ed", "ing"))
SHORT = {"xes", "ies", "ied", "men", *(end for end, _ in _DOUBLED)}
DETACH = {
    "n": (("sses", "ss"), ("ches", "ch"), ("shes", "sh"), ("xes", "x"), ("zes", "z"), ("ies", "y"), ("ves", "f"), ("men", "man"), ("ss", "ss"), ("s", "")),
    "v": (("ies", "y"), ("sses", "ss"), ("ss", "ss"), ("s", ""), ("ied", "y"), *_DOUBLED, ("ed", ""), ("ing", "")),
    "a": (("iest", "y"), ("ier", "y"), ("est", ""), ("er", "")),
    "r": (),
}


def least_length(end: str) -> int:
    return len(end) + (2 if end in SHORT else 3)


def _listed(words: Sequence[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def tag_sql(w: str = "w") -> str:
    known = " ".join(f"when {w} in ({_listed(own)}) then '{tag}'" for tag, own in LEXICON.items())
    ends = " ".join(f"when {w} like '%{end}' and length({w}) > {len(end) + 1} then '{tag}'" for end, tag in ENDINGS)
    return f"case {known} {ends} else 'NN' end"


def class_sql(tag: str) -> str:
    """The word class of a Penn tag: nouns n, verbs v, adverbs r, adjectives a, others n."""
    return f"case when {tag} like 'VB%' then 'v' when {tag} like 'RB%' then 'r' when {tag} like 'JJ%' then 'a' else 'n' end"


def lemma_sql(w: str = "w") -> str:
    cases = [f"when {w} in ({_listed(own)}) then '{lemma}'" for lemma, own in IRREGULAR.items()] + [f"when {w} in ({_listed(CLOSED)}) then {w}"]
    for kind, rules in DETACH.items():
        if rules:
            inner = " ".join(f"when {w} like '%{end}' and length({w}) >= {least_length(end)} then concat(substr({w}, 1, length({w}) - {len(end)}), '{to}')" for end, to in rules)
            cases.append(f"when ({class_sql(tag_sql(w))}) = '{kind}' then case {inner} else {w} end")
    return f"case {' '.join(cases)} else {w} end"


class Tagger(Protocol):
    """Tags of a column of tokens, one for each."""

    def __call__(self, tokens: Column) -> Column: ...


class Lemmatizer(Protocol):
    """Lemmas of a column of tokens, one for each."""

    def __call__(self, tokens: Column) -> Column: ...


def rule_tags(tokens: Column) -> Column:
    return F.transform(tokens, _tag)


def rule_lemmas(tokens: Column) -> Column:
    tagged = F.transform(tokens, lambda w: F.struct(w.alias("w"), word_class(_tag(w)).alias("kind")))
    return F.transform(tagged, lambda x: _lemma(x["w"], x["kind"]))


def _tag(w: Column) -> Column:
    known = None
    for tag, own in LEXICON.items():
        hit = w.isin(*own)
        known = F.when(hit, tag) if known is None else known.when(hit, tag)
    # most words are of no list, which is found at once
    out = F.when(w.isin(*CLOSED), known)
    for end, tag in ENDINGS:
        out = out.when(w.endswith(end) & (F.length(w) > len(end) + 1), tag)
    return out.otherwise("NN")


def word_class(tag: Column) -> Column:
    return F.when(tag.startswith("VB"), "v").when(tag.startswith("RB"), "r").when(tag.startswith("JJ"), "a").otherwise("n")


def _lemma(w: Column, kind: Column) -> Column:
    known = None
    for lemma, own in IRREGULAR.items():
        known = F.when(w.isin(*own), lemma) if known is None else known.when(w.isin(*own), lemma)
    out = F.when(w.isin(*(x for own in IRREGULAR.values() for x in own)), known).when(w.isin(*CLOSED), w)
    for name, rules in DETACH.items():
        if not rules:
            continue
        inner = None
        for end, to in rules:
            hit = w.endswith(end) & (F.length(w) >= least_length(end))
            cut = F.concat(F.substring(w, F.lit(1), F.length(w) - len(end)), F.lit(to))
            inner = F.when(hit, cut) if inner is None else inner.when(hit, cut)
        inner = inner.otherwise(w)
        out = out.when(kind == name, inner)
    return out.otherwise(w)


def model_tagger(load: Callable[[], Callable[[Sequence[list[str]]], Sequence[Sequence[str]]]]) -> Tagger:
    """A tagger (or lemmatizer) from a model: load() runs once for each Python worker, and what it
    returns tags a batch of token lists, a tag for each token."""

    @F.pandas_udf("array<string>")
    def tag(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for tokens in batches:
            some = tokens[tokens.notna()]
            lists = [list(x) for x in some]
            found = pd.Series([None] * len(tokens), index=tokens.index, dtype=object)
            for at, words, tags in zip(some.index, lists, model(lists) if lists else (), strict=True):
                if len(words) != len(tags):
                    raise ValueError("a tagger must give one tag for each token")
                found[at] = list(tags)
            yield found

    return tag
