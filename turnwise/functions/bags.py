"""Cosines of n-gram counts of many pairs at once: Arrow batches, counted in numpy."""

from __future__ import annotations

import sys
from collections import Counter
from collections.abc import Sequence
from math import sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not find this package

#: Joins word and tag of an n-gram that is compared as both.
MARK = "/"
#: Pairs that are counted at once.
ROWS = 1000


def grams(items: Sequence[str | None], n: int) -> list:
    """As similarity.ngrams()."""
    if n == 1:
        return list(items)
    return [" ".join(x for x in items[i : i + n] if x is not None) for i in range(len(items) - n + 1)]


def cosine(a: Sequence[str | None], b: Sequence[str | None]) -> float:
    """As similarity.bag_cosine(): each null counts for itself."""
    one, two = (Counter(x for x in side if x is not None) for side in (a, b))
    aa, bb = (sum(n * n for n in c.values()) + sum(x is None for x in side) for c, side in ((one, a), (two, b)))
    return sum(n * two[x] for x, n in one.items()) / (sqrt(aa) * sqrt(bb)) if aa and bb else 0.0


def lacking(items: list[tuple], shared: set) -> list:
    """As similarity.lacking(), of the tags of (key, tags): what is not known to be absent goes."""
    return [] if None in shared else [t for k, t in items if k is not None and k not in shared]


class Side:
    """The items of both sides of some pairs as numbers, with the row and place of each."""

    def __init__(self, both: Sequence[pa.Array], lengths: Sequence[np.ndarray]):
        found = pa.concat_arrays(both).dictionary_encode()
        self.first = len(both[0])
        self.codes, self.kinds = found.indices.to_numpy(zero_copy_only=False).astype(np.int64), max(len(found.dictionary), 1)
        n = np.concatenate(lengths)
        self.row = np.concatenate([np.repeat(np.arange(len(x)), x) for x in lengths])
        self.left = np.repeat(np.cumsum(n), n) - np.arange(len(self.codes))  # items from here to the end of the list

    def grams(self, n: int) -> np.ndarray:
        """A number for the n-gram that begins at each place; those that cross an end mean nothing."""
        made = self.codes
        for i in range(1, n):
            after = np.zeros_like(made)
            after[: len(made) - i] = self.codes[i:]
            made = np.unique(made * self.kinds + after, return_inverse=True)[1]
        return made


def counts(row: np.ndarray, gram: np.ndarray, first: int) -> tuple[np.ndarray, ...]:
    """(row, count on one side, on the other) of each gram of a row, and where each item is there."""
    found, at = np.unique(row * (int(gram.max(initial=0)) + 1) + gram, return_inverse=True)
    one, two = np.bincount(at[:first], minlength=len(found)), np.bincount(at[first:], minlength=len(found))
    own = np.zeros(len(found), np.int64)
    own[at] = row
    return own, one, two, at


def cosines(row: np.ndarray, gram: np.ndarray, first: int, rows: int) -> np.ndarray:
    own, one, two, _ = counts(row, gram, first)
    ab, aa, bb = (np.bincount(own, weights=x * y, minlength=rows) for x, y in ((one, two), (one, one), (two, two)))
    length = np.sqrt(aa) * np.sqrt(bb)
    return np.divide(ab, length, out=np.zeros(rows), where=length > 0)


def scores(some: np.ndarray, plain: Sequence[pa.Array], tagged: Sequence[Sequence[pa.Array]], most: int, ignore: bool) -> dict[tuple, np.ndarray]:
    """Cosines by ("", n) of the n-grams of plain lists (two sides), and by (i, n) of the tags of the
    i-th tagged ones; rows where some is false are nan."""
    rows = len(some)
    keep = pa.array(some)
    sides = {"": [x.filter(keep) for x in plain]} | {i: [x.filter(keep) for x in own] for i, own in enumerate(tagged)}
    lengths = {k: [pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False) for x in own] for k, own in sides.items()}
    flat = {k: [x.flatten() for x in own] for k, own in sides.items()}
    words, tags = {"": flat.pop("")}, {}
    for i, own in flat.items():
        parts = [x.flatten() for x in own]
        words[i], tags[i] = [pc.binary_join_element_wise(w, t, MARK) for w, t in parts], [t for _, t in parts]
    odd = any(x.null_count or pc.any(pc.match_substring(x, " ")).as_py() for own in (*words.values(), *tags.values()) for x in own)
    out = {}

    def put(key, values):
        out[key] = np.full(rows, np.nan)
        out[key][some] = values

    if odd or any(x.null_count for own in sides.values() for x in own):
        lists = {k: [[g.as_py() for g in x] for x in own] for k, own in sides.items()}
        for n in range(1, most + 1):
            put(("", n), [cosine(grams(a, n), grams(b, n)) for a, b in zip(*lists[""], strict=True)])
            for i in tags:
                put((i, n), [plainly(a, b, n, ignore) for a, b in zip(*lists[i], strict=True)])
        return out
    left = int(some.sum())
    for k, own in words.items():
        one = Side(own, lengths[k])
        two = Side(tags[k], lengths[k]) if k != "" else None
        for n in range(1, most + 1):
            whole = one.left >= n
            row, first, gram = one.row[whole], int(whole[: one.first].sum()), one.grams(n)[whole]
            if two is None:
                put((k, n), cosines(row, gram, first, left))
                continue
            kept = np.ones(len(row), bool)
            if ignore:
                _, here, there, at = counts(row, gram, first)
                kept = ~((here > 0) & (there > 0))[at]
            put((k, n), cosines(row[kept], two.grams(n)[whole][kept], int(kept[:first].sum()), left))
    return out


def plainly(a: list | None, b: list | None, n: int, ignore: bool) -> float:
    """The score of tags of one pair, of items that may be null or hold spaces."""
    if a is None or b is None:
        return float("nan")
    marked = lambda x: None if x is None or x["word"] is None or x["tag"] is None else x["word"] + MARK + x["tag"]
    one, two = (list(zip(grams([marked(x) for x in s], n), grams([x and x["tag"] for x in s], n), strict=True)) for s in (a, b))
    if not ignore:
        return cosine([t for _, t in one], [t for _, t in two])
    shared = {k for k, _ in one} & {k for k, _ in two}
    return cosine(lacking(one, shared), lacking(two, shared))


def pair_scores(names: Sequence[str], taggers: int, most: int, ignore: bool):
    """A function of Arrow arrays, for each name: its plain lists and those of each tagger, both sides
    each.  It gives a struct of doubles named as in fields()."""
    kinds = fields(len(names), taggers, most)

    def batch(*columns: pa.Array) -> pa.Array:
        rows, found = len(columns[0]), {k: [] for k in kinds}
        for start in range(0, rows, ROWS):
            part, i = [c.slice(start, ROWS) for c in columns], 0
            for name in range(len(names)):
                plain, i = part[i : i + 2], i + 2
                tagged = [part[i + 2 * t : i + 2 * t + 2] for t in range(taggers)]
                i += 2 * taggers
                some = np.logical_and(*(pc.greater(pc.fill_null(pc.list_value_length(x), 0), 0).to_numpy(zero_copy_only=False) for x in plain))
                for (k, n), values in scores(some, plain, tagged, most, ignore).items():
                    found[f"s{name}_{k}_{n}"].append(values)
        whole = [pa.array(np.concatenate(found[k]) if found[k] else np.zeros(0), from_pandas=True) for k in kinds]
        return pa.StructArray.from_arrays(whole, names=list(kinds))

    return batch


def fields(names: int, taggers: int, most: int) -> list[str]:
    return [f"s{name}_{k}_{n}" for name in range(names) for k in ("", *range(taggers)) for n in range(1, most + 1)]
