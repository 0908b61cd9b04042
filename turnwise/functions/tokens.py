"""Contractions and word tokens of cleaned utterances."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Contractions and what they stand for. Order matters, the first that fits is taken.
CONTRACTIONS = {
    "ain't": "is not", "aren't": "are not", "can't": "cannot", "can't've": "cannot have", "'cause": "because",
    "could've": "could have", "couldn't": "could not", "couldn't've": "could not have", "didn't": "did not",
    "doesn't": "does not", "don't": "do not", "hadn't": "had not", "hadn't've": "had not have", "hasn't": "has not",
    "haven't": "have not", "he'd": "he had", "he'd've": "he would have", "he'll": "he will", "he'll've": "he will have",
    "he's": "he is", "how'd": "how did", "how'd'y": "how do you", "how'll": "how will", "how's": "how is",
    "i'd": "i would", "i'd've": "i would have", "i'll": "i will", "i'll've": "i will have", "i'm": "i am",
    "i've": "i have", "isn't": "is not", "it'd": "it would", "it'd've": "it would have", "it'll": "it will",
    "it'll've": "it will have", "it's": "it is", "let's": "let us", "ma'am": "madam", "mayn't": "may not",
    "might've": "might have", "mightn't": "might not", "mightn't've": "might not have", "must've": "must have",
    "mustn't": "must not", "mustn't've": "must not have", "needn't": "need not", "needn't've": "need not have",
    "o'clock": "of the clock", "oughtn't": "ought not", "oughtn't've": "ought not have", "shan't": "shall not",
    "sha'n't": "shall not", "shan't've": "shall not have", "she'd": "she would", "she'd've": "she would have",
    "she'll": "she will", "she'll've": "she will have", "she's": "she is", "should've": "should have",
    "shouldn't": "should not", "shouldn't've": "should not have", "so've": "so have", "so's": "so as",
    "that'd": "that had", "that'd've": "that would have", "that's": "that is", "there'd": "there would",
    "there'd've": "there would have", "there's": "there is", "they'd": "they would", "they'd've": "they would have",
    "they'll": "they will", "they'll've": "they will have", "they're": "they are", "they've": "they have",
    "to've": "to have", "wasn't": "was not", "we'd": "we would", "we'd've": "we would have", "we'll": "we will",
    "we'll've": "we will have", "we're": "we are", "we've": "we have", "weren't": "were not", "what'll": "what will",
    "what'll've": "what will have", "what're": "what are", "what's": "what is", "what've": "what have",
    "when's": "when is", "when've": "when have", "where'd": "where did", "where's": "where is",
    "where've": "where have", "who'll": "who will", "who'll've": "who will have", "who's": "who is",
    "who've": "who have", "why's": "why is", "why've": "why have", "will've": "will have", "won't": "will not",
    "won't've": "will not have", "would've": "would have", "wouldn't": "would not", "wouldn't've": "would not have",
    "y'all": "you all", "y'all'd": "you all would", "y'all'd've": "you all would have", "y'all're": "you all are",
    "y'all've": "you all have", "you'd": "you would", "you'd've": "you would have", "you'll": "you will",
    "you'll've": "you will have", "you're": "you are", "you've": "you have",
}
CONTRACTION = "|".join(CONTRACTIONS)

#: (pattern, replacement) in turn, over text with two spaces for each and one at both ends.
TOKEN_RULES = (
    ("''", " '' "),
    (r"([^' ])('s|'m|'d|') ", r"\1 \2 "),
    (r"([^' ])('ll|'re|'ve|n't) ", r"\1 \2 "),
    *((rf" ({a})({b}) ", r" \1 \2 ") for a, b in (("can", "not"), ("d", "'ye"), ("gim", "me"), ("gon", "na"), ("got", "ta"), ("lem", "me"), ("more", "'n"), ("wan", "na"), ("'t", "is"), ("'t", "was"))),
)


def expanded(text: Column) -> Column:
    """Contractions written out, in one pass from the left, inside words as well."""
    text = F.lower(text)
    long_form = F.create_map(*[F.lit(x) for pair in CONTRACTIONS.items() for x in pair])
    found = F.regexp_extract_all(text, F.lit(f"({CONTRACTION})"), F.lit(0))
    between = F.split(text, CONTRACTION, -1)
    joined = F.zip_with(between, found, lambda a, b: F.concat(a, F.coalesce(F.try_element_at(long_form, b), F.lit(""))))
    return F.when(text.contains("'"), F.array_join(joined, "")).otherwise(text)


def words(text: Column) -> Column:
    """Treebank tokens of text that holds letters, apostrophes and spaces only."""
    quoted = F.concat(F.lit("  "), F.regexp_replace(text, " ", "  "), F.lit("  "))
    for pattern, to in TOKEN_RULES:
        quoted = F.regexp_replace(quoted, pattern, re.sub(r"\\(\d)", r"$\1", to))
    # only a word of the list can change without an apostrophe, so most texts skip the rules
    plain = ~text.rlike("'|cannot|gimme|gonna|gotta|lemme|wanna")
    return F.filter(F.split(F.when(plain, text).otherwise(quoted), "\\s+"), lambda w: w != "")


def tokens(text: Column) -> Column:
    return words(expanded(text))
