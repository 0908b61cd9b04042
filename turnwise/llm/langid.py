"""Language identification by rank-order profiles.

A language's profile is the list of its most frequent character n-grams (1 to 5 letters, words
padded with a mark) in order of frequency.  A document's list is compared with each profile by
out-of-place distance: for each n-gram of the document the difference of ranks, and the length of
the profile for one that the profile lacks.  The language of the smallest distance is predicted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: N-grams of a profile, longest n-gram, characters counted at once.
PROFILE, LONGEST, CHUNK = 400, 5, 1 << 19
#: Labelled documents of a language that are learned from, on average, where it has more.
SAMPLE = 2000
UNKNOWN = "und"
_PAD = ord("_")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def chunks(text: str) -> Iterator[np.ndarray]:
    """The code points of the lower-cased text in chunks that end between words, each run of
    other characters than letters replaced by one pad."""
    import re

    other, at = re.compile(r"[\W\d_]+"), 0
    while at < len(text):
        end = min(len(text), at + CHUNK)
        if end < len(text) and (gap := other.search(text, end)) is not None:
            end = min(gap.start(), at + 2 * CHUNK)
        elif end < len(text):
            end = min(len(text), at + 2 * CHUNK)
        words = other.sub("_", text[at:end].lower()).strip("_")
        if words:
            yield np.frombuffer(f"_{words}_".encode("utf-32-le", "surrogatepass"), np.uint32)
        at = end


def grams(codes: np.ndarray) -> np.ndarray:
    """A 64-bit key of each n-gram: pads stand at its ends only, and it has a letter."""
    pad = codes == _PAD
    wide = codes.astype(np.uint64) + np.uint64(1)
    inner = np.concatenate(([0], np.cumsum(pad)))
    out = []
    key = np.zeros(len(codes), np.uint64)
    for n in range(1, LONGEST + 1):
        m = len(codes) - n + 1
        if m < 1:
            break
        key = key[:m] * np.uint64(0x9E3779B97F4A7C15) + wide[n - 1 :]
        key ^= key >> np.uint64(29)
        if n == 1:
            good = ~pad
        elif n == 2:
            good = ~(pad[:-1] & pad[1:])
        else:
            good = inner[n - 1 : n - 1 + m] == inner[1 : 1 + m]
        out.append(key[good])
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of the n-grams of the whole text."""
    keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for codes in chunks(text):
        k, c = np.unique(grams(codes), return_counts=True)
        keys, counts = merged([(keys, counts), (k, c)]) if len(keys) else (k, c)
    return keys, counts


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    counts = np.zeros(len(keys), np.int64)
    np.add.at(counts, at, np.concatenate([c for _, c in parts]))
    return keys, counts


def ranked(keys: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    """The keys of the most frequent n-grams, in order; ties by key."""
    if len(keys) > most:
        least = np.partition(counts, len(counts) - most)[len(counts) - most]
        keys, counts = keys[counts >= least], counts[counts >= least]
    return keys[np.lexsort((keys, -counts))][:most]


class Profiles:
    """Profiles of some languages, by name and list of keys in order of rank."""

    def __init__(self, lists: dict[str, list[int]], most: int = PROFILE):
        self.names, self.most = sorted(lists), most
        self.tables = []
        for name in self.names:
            keys = np.array(lists[name], np.int64).view(np.uint64)
            order = np.argsort(keys)
            self.tables.append((keys[order], order))

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.names or not has_letter(text):
            return UNKNOWN, 0.0
        mine = ranked(*counted(text), self.most)
        if not len(mine):
            return UNKNOWN, 0.0
        rank, best = np.arange(len(mine)), (None, UNKNOWN)
        for name, (keys, order) in zip(self.names, self.tables, strict=True):
            at = np.minimum(np.searchsorted(keys, mine), len(keys) - 1)
            out = np.where(keys[at] == mine, np.minimum(np.abs(order[at] - rank), self.most), self.most).sum()
            if best[0] is None or out < best[0]:
                best = (int(out), name)
        return best[1], 1.0 - best[0] / (self.most * len(mine))


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang", by: str = "doc_id", sample: int = SAMPLE, most: int = PROFILE) -> Profiles:
    """Profiles of the languages of labelled rows (null texts and languages are left out).

    Of a language with more than `sample` rows, about so many are taken, by a hash of `by`: the
    bound of what is learned from.  The driver gets a count and `most` keys of each language."""
    labelled = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("t"), F.col(lang).alias("l"), F.col(by).alias("b"))
    sizes = {r[0]: r[1] for r in labelled.groupBy("l").count().collect()}
    share = {k: sample / n for k, n in sizes.items() if n > sample}
    if share:
        least = F.create_map(*[F.lit(x) for k, v in share.items() for x in (k, float(v))])
        point = F.pmod(F.xxhash64("b"), F.lit(1 << 30)) / float(1 << 30)
        labelled = labelled.where(point < F.coalesce(F.try_element_at(least, F.col("l")), F.lit(1.0)))

    def count(batches):
        held: dict[str, list] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = held.setdefault(lang, [])
                own.append(counted(text))
                if len(own) > 64:
                    held[lang] = [merged(own)]
        for lang, own in held.items():
            keys, counts = merged(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(counts)], names=["l", "k", "n"])

    found = labelled.select("t", "l").mapInArrow(count, "l string, k long, n long").groupBy("l", "k").agg(F.sum("n").alias("n"))
    # keys are unsigned: their order as ties is that of ranked()
    order = Window.partitionBy("l").orderBy(F.desc("n"), F.col("k") < 0, "k")
    top = found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= most)
    lists: dict[str, list] = {}
    for r in top.orderBy("l", "r").collect():
        lists.setdefault(r["l"], []).append(r["k"])
    return Profiles(lists, most)


def identify(docs: DataFrame, profiles: Profiles, text: str = "text", lang: str = "lang_pred", score: str = "lang_score") -> DataFrame:
    """docs with the predicted language of the whole text and a score from 0 to 1.

    A text that is null or has no letter is `und` with score 0, as is any text if no language was
    learned.  The score is 1 less the distance as a share of the largest possible one.  Equal
    distances: the first language by code point.  Rows and other columns pass unchanged."""
    base = docs.drop(lang, score)
    at, names = base.columns.index(text), base.columns

    def run(batches):
        for batch in batches:
            found = [profiles.predict(t) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=[*names, lang, score])

    from .bpe import spark_schema

    return base.mapInArrow(run, spark_schema(base, f"`{lang}` string, `{score}` double"))


def predictions(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row, learned from the rows not held out."""
    profiles = learn(docs.where(~held_out(F.col("doc_id"))))
    own = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return identify(own, profiles, score="score").drop("text")
