"""Cleaning of utterances: Column in, Column out, all inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_ANY = "[uhmoa]*"
#: A filler of two letters or more over u h m o a, that ends in m h u a and begins with none of
#: mom, am, ham; written without lookahead, so that any regular-expression engine takes it.
FILLER = (
    f"(?:[uo]{_ANY}[uhma]|a(?:[uha]|[uhoa]{_ANY}[uhma])|h(?:[uhma]|[uhmo]{_ANY}[uhma]|a[uha]|a[uhoa]{_ANY}[uhma])"
    f"|m(?:[uhma]|[uhma]{_ANY}[uhma]|o[uha]|o[uhoa]{_ANY}[uhma]))"
)
FILLER_STEPS = (rf"^{FILLER}\s", rf"\s{FILLER}\s", rf"\s{FILLER}$", f"^{FILLER}$")
MODES = ("regex", "list", "both", "none")


def letters_only(content: Column) -> Column:
    """Keep ASCII letters, apostrophes and spaces, in lower case; delete the rest."""
    return F.lower(F.regexp_replace(content, "[^a-zA-Z' ]", ""))


def without_filler_pattern(content: Column) -> Column:
    """Replace fillers by a space, step by step; each takes its space with it, so of neighbouring
    fillers every other one stays."""
    for step in FILLER_STEPS:
        content = F.regexp_replace(content, step, " ")
    return content


def without_listed(content: Column, fillers: Sequence[str]) -> Column:
    """Drop the words of a list, between single spaces."""
    if not fillers:
        return content
    return F.array_join(F.filter(F.split(content, " "), lambda w: ~w.isin(*fillers)), " ")


def cleaned(content: Column, mode: str = "regex", fillers: Sequence[str] = ()) -> Column:
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    out = letters_only(content)
    if mode in ("regex", "both"):
        out = without_filler_pattern(out)
    return without_listed(out, fillers) if mode in ("list", "both") else out
