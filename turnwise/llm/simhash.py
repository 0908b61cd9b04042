"""Near deduplication by SimHash with multi-index hashing.

Fingerprints that differ in at most `radius` of 64 bits are linked.  Each is cut into segments; if
two differ in at most r bits, some segment differs in at most r // segments.  Each distinct
fingerprint is put into a table under the value of each segment, and looks itself up under all
values in a small Hamming ball around it.  Of two values in one ball only that looks the other up
which has 0 at the lowest bit in which they differ, so each pair is met once.  What meets in a
bucket is verified on all 64 bits; from each bucket comes a spanning forest of its links, not all
pairs.  A bucket of very many fingerprints is cut into blocks, and each two blocks meet in a tile of
their own.  Components are found by rounds of stars over the links.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, scratch, spool

#: Shingles hashed at once; rows of a block of a large bucket; nodes that a task contracts at once.
BLOCK, TILE, HELD = 1 << 16, 4096, 1 << 18


def fingerprint(text: str | None, words: int = 3) -> int:
    """64 bits, as a signed number; 0 for a text without words."""
    import xxhash

    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    digest, n = xxhash.xxh64_intdigest, max(1, len(w) - words + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        own = w[at : at + BLOCK + words - 1]
        shingles = map(b" ".join, zip(*(own[i:] for i in range(words)), strict=False)) if len(w) >= words else [b" ".join(w)]
        h = np.array([digest(s, 42) for s in shingles], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, words: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, mark, fp) of every row; mark tells rows of one doc_id apart by their text."""

    def run(batches):
        for batch in batches:
            found = [fingerprint(t, words) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.int64())], names=["doc_id", "mark", "fp"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("mark"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, mark long, fp long")


def segment_bounds(segments: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of each segment."""
    ends = [64 * i // segments for i in range(segments + 1)]
    return [(a, b - a) for a, b in zip(ends, ends[1:], strict=False)]


def probes(fps: DataFrame, radius: int, segments: int, *more: str) -> DataFrame:
    """(key, fp, probe): the table rows of each fingerprint and the values it looks up; `more`
    columns come along."""
    rows = []

    def looked_up(value, top, masks):
        mine = F.filter(F.array(*[F.lit(m).cast("long") for m in masks]), lambda m: value.bitwiseAND(m).bitwiseAND(-m) == 0)
        return F.transform(mine, lambda m: F.struct(value.bitwiseXOR(m).bitwiseOR(top).alias("key"), F.lit(True).alias("probe")))

    for number, (low, width) in enumerate(segment_bounds(segments)):
        value = F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << width) - 1))
        top = F.lit(number << 33)  # the key holds the segment's number above its value
        masks = [sum(1 << b for b in bits) for n in range(1, radius // segments + 1) for bits in combinations(range(width), n)]
        rows.append(F.array(F.struct(value.bitwiseOR(top).alias("key"), F.lit(False).alias("probe"))))
        if masks:
            rows.append(looked_up(value, top, masks))
    return fps.select("fp", *more, F.explode(F.concat(*rows)).alias("x")).select("x.key", "fp", "x.probe", *more)


def forest(table: np.ndarray, looking: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among table rows and between these and those looking."""
    both = np.concatenate((table, looking)).view(np.uint64)
    known = np.arange(len(both)) < len(table)
    left = np.ones(len(both), bool)
    out = []
    for seed in range(len(both)):
        if not left[seed]:
            continue
        left[seed] = False
        reached = [seed]
        while reached:
            i = reached.pop()
            others = np.flatnonzero(left if known[i] else left & known)
            near = others[np.bitwise_count(both[others] ^ both[i]) <= radius]
            left[near] = False
            out += [(i, j) for j in near.tolist()]
            reached += near.tolist()
    signed = both.view(np.int64).tolist()
    return [(signed[a], signed[b]) for a, b in out if signed[a] != signed[b]]


def tiled(rows: DataFrame, key: str, of: str, tile: int) -> DataFrame:
    """rows with t1, t2 and block: a key with more than `tile` rows is cut into blocks by a hash of
    `of`, and each row goes to a tile with each block; the others have one tile."""
    sizes = rows.groupBy(key).agg(F.count("*").alias("m")).where(F.col("m") > tile)
    parts = F.coalesce(F.ceil(F.col("m") / tile), F.lit(1)).cast("int")
    out = rows.join(sizes, key, "left").withColumn("block", F.pmod(F.xxhash64(of), parts).cast("int"))
    out = out.withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    return out.withColumn("t1", F.least("block", "other")).withColumn("t2", F.greatest("block", "other")).drop("m", "other")


def runs(batches, keys: int):
    """The rows of each run of rows alike in their first `keys` columns, as arrays; several runs at
    once where a batch holds them, and of rows held only the run that may go on."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if not len(columns[0]):
            continue
        changed = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns[:keys]], axis=0)) + 1
        if held and any(held[-1][i][-1] != columns[i][0] for i in range(keys)):
            yield [np.concatenate(c) for c in zip(*held, strict=True)]
            held = []
        if len(changed):
            cut = changed[-1]
            yield [np.concatenate(c) for c in zip(*held, [c[:cut] for c in columns], strict=True)]
            held, columns = [], [c[cut:] for c in columns]
        held.append(columns)
    if held:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def links(fps: DataFrame, radius: int = 3, segments: int = 2, tile: int | None = None) -> DataFrame:
    """(a, b): for distinct fingerprints fp, links that connect all that are linked within radius."""
    tile = tile or TILE

    def run(batches):
        for keys, t1, t2, fps, probe in runs(batches, 3):
            found: list[tuple[int, int]] = []
            starts = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]) | (t1[1:] != t1[:-1]) | (t2[1:] != t2[:-1]))))
            ends = np.append(starts[1:], len(keys))
            known = np.add.reduceat(~probe, starts, dtype=np.int64)
            some = (ends - starts > 1) & (known > 0)
            for a, b in zip(starts[some], ends[some], strict=True):
                own, looking = fps[a:b], probe[a:b]
                found += forest(own[~looking], own[looking], radius)
            flat = np.array(found, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], names=["a", "b"])

    rows = probes(fps, radius, segments)
    values = [F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << width) - 1)).bitwiseOR(F.lit(i << 33)) for i, (low, width) in enumerate(segment_bounds(segments))]
    most = fps.select(F.explode(F.array(*values)).alias("v")).groupBy("v").count().agg(F.max("count")).first()[0]
    if (most or 0) > tile:  # a bucket holds the fingerprints of a few such values
        rows = tiled(rows, "key", "fp", tile)
    else:
        rows = rows.withColumn("t1", F.lit(0)).withColumn("t2", F.lit(0))
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.select("key", "t1", "t2", "fp", "probe").repartition(parts, "key", "t1", "t2").sortWithinPartitions("key", "t1", "t2", "fp")
    return rows.mapInArrow(run, "a long, b long")


def contracted(edges: DataFrame) -> DataFrame:
    """Each partition's links as stars: the same components from fewer, shorter links."""

    def run(batches):
        parent: dict[int, int] = {}

        def root(x):
            while (p := parent.setdefault(x, x)) != x:
                parent[x] = x = parent[p]
            return x

        def stars():
            flat = np.array([(x, r) for x in list(parent) if (r := root(x)) != x], np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], names=["a", "b"])

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = root(a), root(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
            if len(parent) > HELD:
                yield stars()
                parent.clear()
        yield stars()

    return edges.mapInArrow(run, "a long, b long")


def checksum(edges: DataFrame) -> tuple:
    """Equal for equal sets of links, and for others only by a chance of about 2 to the -126."""
    hashes = [F.sum(F.xxhash64("a", "b", F.lit(i)).cast("decimal(38,0)")) for i in range(2)]
    return tuple(edges.agg(F.count("*"), *hashes).first())


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) of every node of the links (a, b); root is the smallest node reachable.

    Rounds of large and small stars, each written to the shared folder; a round's number of links
    never grows beyond twice the nodes and links, and a path of n nodes takes about log n."""
    now = spool(contracted(edges).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), name)
    state = checksum(now)
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.join(least, both["a"] == least["u"]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.union(least.where("m <> u").select(F.col("u").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
        small = large.join(least, large["a"] == least["u"]).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.union(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()
        then = spool(small, name, 2 * state[0])
        discard(now)
        now, before, state = then, state, checksum(then)
        if state == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def grouped(docs: DataFrame, words: int = 3, radius: int = 3, segments: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, mark, fp, root, lead): of every row the fingerprint, a number of its component, and
    its component's first (doc_id, mark) with null ids last.

    A null text counts as empty; texts without words have fingerprint 0 and are linked like any
    other.  Repeated rows are in one component.  An empty table gives none."""
    with scratch() as keep:
        own = keep(spool(fingerprints(docs, words, doc_id, text), "fingerprints", as_is=True))
        first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark"))
        kinds = spool(own.groupBy("fp").agg(first.alias("lead")), "kinds")
        nodes = components(links(kinds.select("fp"), radius, segments))
        rooted = kinds.join(nodes, kinds["fp"] == nodes["node"], "left").select("fp", "lead", F.coalesce("root", "fp").alias("root"))
        firsts = rooted.groupBy("root").agg(F.min("lead").alias("lead"))
        of = keep(spool(rooted.select("fp", "root").join(firsts, "root"), "groups", kinds.count()))
    return own.join(of, "fp")


def near_classes(docs: DataFrame, words: int = 3, radius: int = 3, segments: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row; component_id is the smallest doc_id that
    can be reached by links, itself included (null only where all in the component are null)."""
    return grouped(docs, words, radius, segments).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("lead.doc_id").alias("component_id"))


def near_deduplicated(docs: DataFrame, words: int = 3, radius: int = 3, segments: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that stay: of each component that with the smallest id, null ids last.

    Rows alike in id and text stay or go together; deduplicated() leaves no such rows."""
    found = grouped(docs, words, radius, segments, doc_id, text)
    stay = found.where(F.col("doc_id").eqNullSafe(F.col("lead.doc_id")) & (F.col("mark") == F.col("lead.mark"))).select(F.col("doc_id").alias("keep"), F.col("mark").alias("keep_mark")).distinct()
    return docs.join(stay, docs[doc_id].eqNullSafe(stay["keep"]) & (F.xxhash64(docs[text]) == stay["keep_mark"]), "left_semi")
