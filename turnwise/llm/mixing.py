"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

The words of a source, in the order of a hash of its documents, are numbered without a break and
cut into blocks.  A source's target in words becomes a quota of block draws: the blocks in the
order of a keyed permutation, again in another order for a second pass, the last draw in part.  The
quotas of all sources are divided among the output shards by a tree: each node gives its left half
a multivariate-hypergeometric draw of its block quotas.  What the tree gives a shard of a source is
a range of permuted positions, and a block is drawn if and only if its position is in the range of
some shard; so shards draw disjoint blocks without knowing of each other, and what the mix takes of
a document is the sum of what shards draw of it.  Inside a shard rows are in the order of a hash.
"""

from __future__ import annotations

import hashlib
import pickle

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import fresh, spool

#: Weights of the sources in the order of their names, repeating; share of all words that the mix
#: takes; most passes over a source; words of a block; rows of a bucket of a source.
WEIGHTS, SHARE, MOST, BLOCK, BUCKET = (5, 2, 1), 1.5, 2, 4096, 2_000

#: Words of a shard; fewest and most shards; most numbers of the plan, one for each shard and
#: source, that is broadcast.  Where the two last hold, shards grow instead.
SHARD_WORDS, SHARDS, MOST_SHARDS, PLAN = 4_000_000, 16, 65_536, 1 << 22

WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: dict[str | None, int], weights=WEIGHTS, share=SHARE, most=MOST) -> dict[str | None, float]:
    """Words to take of each source.  What exceeds `most` times a source goes to the others."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out: dict[str | None, float] = {}
    left = share * sum(sizes.values())
    while True:
        free = [s for s in order if s not in out]
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > most * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / total for s in free}
        for s in over:
            out[s] = float(most * sizes[s])
        left = share * sum(sizes.values()) - sum(out.values())


def split(quotas: np.ndarray, shards: int, seed: str) -> np.ndarray:
    """Quotas of each shard (rows) of each source (columns); the columns add up to quotas."""
    if shards == 1:
        return quotas.reshape(1, -1)
    left = shards // 2
    take = int(quotas.sum()) * left // shards
    rng = np.random.default_rng(list(hashlib.sha256(seed.encode()).digest()))
    drawn = np.zeros_like(quotas)
    rest = int(quotas.sum())
    for i, q in enumerate(quotas):  # one marginal after the other
        rest -= int(q)
        drawn[i] = int(rng.hypergeometric(int(q), rest, take)) if q and take and rest else min(int(q), take)
        take -= int(drawn[i])
    return np.concatenate((split(drawn, left, f"{seed}0"), split(quotas - drawn, shards - left, f"{seed}1")))


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A keyed permutation of range(size), element by element: Feistel rounds, walked again until
    inside the range."""
    half = np.maximum(1, np.ceil(np.log2(np.maximum(2, size)) / 2)).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = index.astype(np.uint64), np.arange(len(index))
    bound = size.astype(np.uint64)
    while len(todo):
        x, h, m, k = out[todo], half[todo], mask[todo], key[todo]
        left, right = x >> h, x & m
        for i in range(6):
            z = (right + k) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(i)
            z = (z ^ (z >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((z ^ (z >> np.uint64(29))) & m)
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= bound[todo]]
    return out.astype(np.int64)


class Plan:
    """What each source gives: quotas of block draws, divided among shards by the tree.

    until[i, j] is the number of draws that the shards up to j have of source i: the tree's result,
    and the only thing that decides whether a block is drawn, how often, and by which shards."""

    def __init__(self, sizes: dict[str | None, int], weights=WEIGHTS, share=SHARE, most=MOST, block=BLOCK, shards: int | None = None, seed="mix"):
        self.names = sorted(sizes, key=lambda s: (s is None, s or ""))
        self.number = {s: i for i, s in enumerate(self.names)}
        self.target = targets(sizes, weights, share, most) if sizes else {}
        self.goal = np.array([self.target[s] for s in self.names], np.float64)
        self.size = np.array([sizes[s] for s in self.names], np.int64)
        # numpy draws from fewer than 10^9: larger inputs have larger blocks
        self.block = max(block, -(-int(self.size.sum()) * most // 500_000_000))
        self.blocks = -(-self.size // self.block)
        words = np.array([round(self.target[s]) for s in self.names], np.int64)
        passes = np.where(self.size > 0, words // np.maximum(1, self.size), 0)
        rest = words - passes * self.size
        self.turns = int(passes.max(initial=0)) + 1
        self.key = np.array([[int.from_bytes(hashlib.sha256(f"{seed}/{k}/{s!r}".encode()).digest()[:7], "big") for k in range(most + 1)] for s in self.names], np.uint64).reshape(len(self.names), most + 1)
        last = self.size - (self.blocks - 1) * self.block
        whole, part = rest // self.block, rest % self.block
        for i in np.flatnonzero(rest):
            n = self.blocks[i]
            at = int(permuted(np.array([n - 1]), np.array([n]), self.key[i, passes[i]][None])[0])
            if at < whole[i]:  # the last block of a source may be short
                part[i] += self.block - last[i]
                if part[i] >= self.block:
                    whole[i], part[i] = whole[i] + 1, part[i] - self.block
            elif at == whole[i] and part[i] >= last[i]:
                whole[i], part[i] = whole[i] + 1, part[i] - last[i]
        self.quota = passes * self.blocks + whole + (part > 0)
        self.part = part  # words of the last draw of a source, 0 if that is whole
        fit = max(SHARDS, PLAN // max(1, len(self.names)))
        self.shards = shards or min(MOST_SHARDS, fit, max(SHARDS, -(-int(words.sum()) // SHARD_WORDS)))
        self.until = np.ascontiguousarray(np.cumsum(split(self.quota, self.shards, seed), axis=0).T) if len(self.names) else np.zeros((0, self.shards), np.int64)

    def spans(self, source: np.ndarray, offset: np.ndarray, size: np.ndarray):
        """(row, pass, shard, first word, end) of what shards draw of each row, in order; a row is
        `size` words of source number `source` from word `offset` of it."""
        first = offset // self.block
        count = np.where(size > 0, (offset + size - 1) // self.block - first + 1, 0)
        row = np.repeat(np.arange(len(size)), count)
        block = np.repeat(first - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(len(row))
        s = source[row]
        low = np.maximum(block * self.block - offset[row], 0)
        high = np.minimum((block + 1) * self.block - offset[row], size[row])
        out = []
        for k in range(self.turns):
            draw = k * self.blocks[s] + permuted(block, self.blocks[s], self.key[s, k])
            shard = np.full(len(row), self.shards)
            for i in np.unique(s):
                own = s == i
                shard[own] = np.searchsorted(self.until[i], draw[own], side="right")
            partly = (draw == self.until[s, -1] - 1) & (self.part[s] > 0)
            end = np.where(partly, np.minimum(high, block * self.block + self.part[s] - offset[row]), high)
            some = (shard < self.shards) & (end > low)
            out.append(np.stack((row[some], np.full(int(some.sum()), k), shard[some], low[some], end[some])))
        return np.concatenate(out, axis=1) if out else np.zeros((5, 0), np.int64)


def keys_of(columns: list[Column]) -> list[Column]:
    """Two hashes that tell rows apart by these columns."""
    return [F.xxhash64(F.lit(seed), *[x for c in columns for x in (c, c.isNull())]) for seed in (1, 2)]


def measured(docs: DataFrame, keys: list[Column], doc_id: str, source: str, text: str) -> DataFrame:
    """(k1, k2, doc_id, source, size, copies) of the rows, those alike in keys counted, so that
    copies of a row are one from here on."""

    def run(batches):
        for batch in batches:  # a pattern in the JVM would make an object of each word
            size = pa.compute.fill_null(pa.compute.count_substring_regex(batch.column(4), WORD).cast(pa.int64()), 0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], size], names=["k1", "k2", "doc_id", "source", "size"])

    kind = docs.schema[doc_id].dataType.simpleString()
    own = docs.select(keys[0].alias("k1"), keys[1].alias("k2"), F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), F.col(text).cast("string"))
    own = own.mapInArrow(run, f"k1 long, k2 long, doc_id {kind}, source string, size long")
    return spool(own.groupBy(*own.columns).agg(F.count("*").alias("copies")), "sizes")


def offsets(sizes: DataFrame, rows: int, copies: int) -> DataFrame:
    """(k1, k2, doc_id, source, copy, size, offset): where each row's words start in its source, in
    the order of a hash.  Rows are summed up by bucket, a range of the hash, and buckets by source,
    so that no task sees a source; how many buckets there are changes no offset."""
    parts = int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = min(1 << 24, max(8, 4 * parts, rows // BUCKET))
    sid = F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))
    own = sizes.withColumn("sid", sid).withColumn("h", F.xxhash64(F.lit(3), "k1", "k2"))
    place = F.shiftrightunsigned("h", 25)  # 39 bits, in the order of h as an unsigned number
    own = own.withColumn("bucket", F.shiftright(place * F.lit(buckets), 39)).withColumn("words", F.col("size") * F.col("copies"))
    sums = own.groupBy("sid", "bucket").agg(F.sum("words").alias("words"))
    before = Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("sid", "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("sid", "bucket").orderBy(F.shiftrightunsigned("h", 1), "h", "k1", "k2")
    within = F.coalesce(F.sum("words").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = own.withColumn("within", within).join(sums, ["sid", "bucket"])
    own = own.select("k1", "k2", "doc_id", "source", "size", "copies", (F.col("start") + F.col("within")).alias("offset"))
    copy = F.lit(0).cast("long")
    if copies > 1:  # copies of a row come one after the other; many are dealt out before they are listed
        own = own.withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(1000).cast("long")))).repartition(parts, "k1", "k2", "from")
        own = own.withColumn("copy", F.explode(F.sequence(F.col("from"), F.least(F.col("from") + 999, F.col("copies") - 1))))
        copy = F.col("copy")
    return own.select("k1", "k2", "doc_id", "source", copy.alias("copy"), "size", (F.col("offset") + copy * F.col("size")).alias("offset"))


def planned(sizes: DataFrame, **options) -> tuple[Plan, int, int]:
    """The plan, the number of rows and the most copies of one, from a row for each source (so many
    the driver gets)."""
    found = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")), F.count("*"), F.max("copies")).collect()
    return Plan({r[0]: int(r[1]) for r in found}, **options), sum(r[2] for r in found), max((r[3] for r in found), default=1)


def taken_words(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", **options) -> DataFrame:
    """(doc_id, size, source_size, target, taken, shards) of every row: the words the mix takes of
    it, summed over the shards that draw some, in all passes, never more than `most` times its size.

    A null text has no words; null sources are one source, the last.  Repeated rows are rows of
    their own.  A source's taken words are its target rounded to a word.  An empty table gives
    none.  The same rows give the same result in any order and any number of partitions."""
    sizes = measured(docs, keys_of([F.col(doc_id), F.col(source).cast("string"), F.col(text)]), doc_id, source, text)
    plan, rows, copies = planned(sizes, **options)
    sent = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(plan))

    def run(batches):
        plan = pickle.loads(sent.value)
        for batch in batches:
            s = np.array([plan.number[x] for x in batch.column(1).to_pylist()], np.int64)
            size, offset = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
            row, _, shard, low, high = plan.spans(s, offset, size)
            order = np.lexsort((shard, row))
            row, shard, words = row[order], shard[order], (high - low)[order]
            new = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (shard[1:] != shard[:-1])))) if len(row) else np.zeros(0, np.int64)
            by_shard = np.add.reduceat(words, new) if len(new) else np.zeros(0, np.int64)
            taken = np.zeros(len(size), np.int64)
            np.add.at(taken, row[new], by_shard)
            ends = np.concatenate(([0], np.cumsum(np.bincount(row[new], minlength=len(size)))))
            parts = pa.StructArray.from_arrays([pa.array(shard[new], pa.int32()), pa.array(by_shard, pa.int64())], names=["shard", "words"])
            shards = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), parts)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(plan.size[s]), pa.array(plan.goal[s]), pa.array(taken), shards], names=["doc_id", "size", "source_size", "target", "taken", "shards"])

    kind = sizes.schema["doc_id"].dataType.simpleString()
    return offsets(sizes, rows, copies).select("doc_id", "source", "size", "offset").mapInArrow(run, f"doc_id {kind}, size long, source_size long, target double, taken long, shards array<struct<shard:int,words:long>>")


def words_cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The words of the spans (first, end) with the white space between them; whole texts stay."""
    import re

    edges = [m.span() for m in re.finditer(WORD, text)]
    if spans and spans[0][0] == 0 and spans[-1][1] == len(edges) and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False)):
        return text
    return " ".join(text[edges[a][0] : edges[b - 1][1]] for a, b in spans)


def mixed(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", shards: int | None = None, **options) -> DataFrame:
    """docs as the mix takes them, with the columns shard and pass: a row for each pass that takes
    words of a document, its text cut to the words taken, in shards and in the shard's order.  A
    document that blocks of several shards reach goes whole to that of its first words.  The number of shards follows the words taken unless it is given.

    A null text, or one without words, is not taken; null sources are one source; rows alike in all
    columns are rows of their own, in blocks of their own.  An empty table gives none."""
    names = fresh(docs, "k1", "k2", "copies", "spans", "shard", "pass", "nth")
    k1, k2, many, spans, shard, turn, nth = names
    columns = docs.columns
    alike = [F.to_json(c) if "map<" in kind else F.col(f"`{c}`") for c, kind in docs.dtypes]
    keys = keys_of(alike)
    sizes = measured(docs, keys, doc_id, source, text)
    plan, rows, copies = planned(sizes, shards=shards, **options)
    sent = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(plan))

    def draw(batches):
        plan = pickle.loads(sent.value)
        for batch in batches:
            s = np.array([plan.number[x] for x in batch.column(2).to_pylist()], np.int64)
            size, offset = (batch.column(i).to_numpy(zero_copy_only=False) for i in (4, 5))
            parts: dict[tuple[int, int], list] = {}
            for r, k, to, low, high in plan.spans(s, offset, size).T.tolist():
                own = parts.setdefault((r, k), [to, []])[1]  # goes whole to the shard that draws its first words
                if own and own[-1][1] == low:
                    own[-1][1] = high
                else:
                    own.append([low, high])
            at = pa.array([r for r, _ in parts], pa.int64())
            more = [pa.array([k for _, k in parts], pa.int32()), pa.array([to for to, _ in parts.values()], pa.int32()), pa.array([x for _, x in parts.values()], pa.list_(pa.list_(pa.int64())))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(at) for i in (0, 1, 3)), *more], names=["d1", "d2", "copy", turn, shard, spans])

    drawn = offsets(sizes, rows, copies).select("k1", "k2", "source", "copy", "size", "offset").mapInArrow(draw, f"d1 long, d2 long, copy long, `{turn}` int, `{shard}` int, `{spans}` array<array<long>>")
    own = docs.select("*", keys[0].alias(k1), keys[1].alias(k2))
    if copies > 1:  # rows that are alike in all are one row to be joined
        whole = own.groupBy(k1, k2).agg(F.first(F.struct(*[F.col(f"`{c}`") for c in columns])).alias(many))
        own = whole.select(k1, k2, *[F.col(many)[c].alias(c) for c in columns])
    both = own.join(drawn, (own[k1] == drawn["d1"]) & (own[k2] == drawn["d2"]))
    both = both.select(*[own[c] for c in columns], spans, shard, turn, F.xxhash64(F.lit(17), "d1", "d2", "copy", turn).alias(nth))
    both = both.repartition(plan.shards, shard).sortWithinPartitions(shard, nth)
    at, where = columns.index(text), len(columns)

    def cut(batches):
        for batch in batches:
            texts = [words_cut(t, s) for t, s in zip(batch.column(at).to_pylist(), batch.column(where).to_pylist(), strict=True)]
            out = batch.set_column(at, text, pa.array(texts, batch.column(at).type))
            yield out.select([*columns, shard, turn])

    schema = StructType([*docs.schema.fields, *StructType.fromDDL(f"`{shard}` int, `{turn}` int").fields])
    return both.select(*columns, spans, shard, turn).mapInArrow(cut, schema)
