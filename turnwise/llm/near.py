"""Near deduplication by SimHash, verified: texts linked by five-word shingles at a similarity of 0.8.

Multi-index hashing as in simhash.py, over 64-bit fingerprints of the sets that are compared (a
shingle counts once, however often it is repeated), fetches what lies within 3 bits; whether two are
linked is decided by the Jaccard similarity of their whole sets of shingles, exactly.

Fingerprints alone would miss links near the threshold, so they only save work.  The rest is found
by prefix filtering, without loss.  The shingles are put in one order.  Two sets of n and m shingles
with a similarity of t share at least max(t n, t m), so the first they share lies within the first
n - ceil(t n) + 1 of the one and likewise of the other: their heads.  First in the order come those
of a part of the hash space (a little more than heads need), by the number of texts that hold them,
counted over all texts; then the others; last those that are common in a sample.  A text whose head
is all its own has no link and is done with: so are nearly all that have no copy, however many
passages they share with others.  Of the rest, first each text is compared with its neighbours in
size, then with others by chance, which with the fingerprints' candidates joins most of what is to
be joined, in a number of comparisons that is linear in the rows.  Then all pairs of different
components that share a shingle of their heads are compared whole, unless they cannot have the
similarity: by their sizes and the places of the shingle, or by bitmaps in which each shingle turns
a bit over (where two bitmaps differ, the sets do, so they bound what is shared from above).
Whatever the order, no link at or above t is lost.

No bucket is held whole: large ones are cut into blocks, and each two blocks meet in a tile.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, fresh, scratch, spool
from .simhash import components, links, runs, tiled

#: Words of a shingle; similarity; distance; segments.
WORDS, SIMILARITY, RADIUS, SEGMENTS = 5, 0.8, 3, 2

#: Rows of a block of a large bucket; elements of a block of comparisons; part of the hash space
#: whose shingles are counted.
TILE, BLOCK, PART = 4096, 1 << 21, 0.3
#: Bits of a bitmap of a set.
BITS = 1024

#: Texts of the sample for common shingles; counts there from which one is common; most that are kept.
SAMPLE, COMMON, MOST = 16384, 3, 1 << 16


def word_list(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted 32-bit hashes of the distinct shingles; the whole sequence if there are fewer words."""
    import xxhash

    w = word_list(text)
    if not w:
        return np.zeros(0, np.int32)
    digest = xxhash.xxh32_intdigest
    shingles = map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False)) if len(w) >= words else [b" ".join(w)]
    return np.unique(np.fromiter((digest(s) for s in shingles), np.uint32)).view(np.int32)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two shingle sets; 1 for two empty ones."""
    shared = len(np.intersect1d(a, b, assume_unique=True))
    total = len(a) + len(b) - shared
    return shared / total if total else 1.0


def set_fingerprint(shingles: np.ndarray) -> int:
    """The SimHash of a set, as a signed number: each shingle counts once; 0 for an empty set."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(shingles), 1 << 16):
        h = (shingles[at : at + (1 << 16)].view(np.uint32).astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(shingles), bitorder="little").view(np.int64)[0])


def common_shingles(docs: DataFrame, rows: int, words: int, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Shingles common in a sample of the texts, sorted as unsigned, and their counts there.  They
    only order the shingles of a head: which ones they are changes work, not results."""

    def run(batches):
        for batch in batches:
            sets = [shingle_set(t, words) for t in batch.column(0).to_pylist()]
            found, counts = np.unique(np.concatenate([np.zeros(0, np.int32), *sets]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(counts)], names=["shingle", "n"])

    share = max(1, rows // SAMPLE)
    some = docs.where(F.pmod(F.xxhash64(text), F.lit(share)) == 0).select(text).mapInArrow(run, "shingle int, n long")
    top = some.groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON).orderBy(F.desc("n"), "shingle").limit(MOST).collect()
    found, counts = np.array([r["shingle"] for r in top], np.int32).view(np.uint32), np.array([r["n"] for r in top], np.int64)
    order = np.argsort(found)
    return found[order], counts[order]


def head_size(n: int, least: float) -> int:
    return min(n, n - int(np.ceil(least * n - 1e-6)) + 1)


def ordered(shingles: np.ndarray, least: float, common: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of a set that come first in the order, those that are counted; and where these
    are too few for a head, as many as it lacks of the others, in order, common ones last."""
    own = np.sort(shingles.view(np.uint32))
    often = np.zeros(len(own), np.int64)
    if common is not None and len(common[0]) and len(own):
        at = np.minimum(np.searchsorted(common[0], own), len(common[0]) - 1)
        often = np.where(common[0][at] == own, common[1][at], 0)
    first = (often == 0) & (own < np.uint32(PART * 2**32))
    more = own[~first][np.argsort(often[~first], kind="stable")]
    counted = own[first]
    return counted.view(np.int32), more[: max(0, head_size(len(own), least) - len(counted))].view(np.int32)


def marked(docs: DataFrame, words: int, doc_id: str, text: str, least: float = SIMILARITY, common: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """(doc_id, mark, fp, node, n, counted, more) of every row; node is the same for texts of the
    same words, n is the number of distinct shingles."""

    def run(batches):
        import xxhash

        for batch in batches:
            texts = batch.column(2).to_pylist()
            node = np.array([xxhash.xxh64_intdigest(b" ".join(word_list(t)), 7) for t in texts], np.uint64).view(np.int64)
            sets = [shingle_set(t, words) for t in texts]
            fp = pa.array([set_fingerprint(s) for s in sets], pa.int64())
            lists = [pa.array(x, pa.list_(pa.int32())) for x in zip(*(ordered(s, least, common) for s in sets), strict=True)] or [pa.array([], pa.list_(pa.int32()))] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), fp, pa.array(node), pa.array([len(s) for s in sets], pa.int64()), *lists], names=["doc_id", "mark", "fp", "node", "n", "counted", "more"])

    kind = docs.schema[doc_id].dataType.simpleString()
    own = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("mark"), F.col(text).alias("text"))
    return own.mapInArrow(run, f"doc_id {kind}, mark long, fp long, node long, n long, counted array<int>, more array<int>")


def candidates(kinds: DataFrame, rows: int | None = None, radius: int = RADIUS, segments: int = SEGMENTS) -> DataFrame:
    """(a, b): nodes that connect all whose fingerprints lie within radius: those of one fingerprint
    with the first of them, and the first ones of linked fingerprints."""
    firsts = spool(kinds.groupBy("fp").agg(F.min("node").alias("first"), F.count("*").alias("m")), "fingerprints", rows)
    same = kinds.join(firsts.where("m > 1"), "fp").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    ends = links(firsts.select("fp"), radius, segments).distinct()
    for side in "ab":
        ends = ends.join(firsts.select(F.col("fp").alias(side), F.col("first").alias(f"n{side}")), side)
    return same.union(ends.select("na", "nb"))


def held_by_two(rows: DataFrame) -> DataFrame:
    """rows (key, node, info) with df, the number of rows of the key, of keys that have two or more.
    No key that is common in the sample comes here in numbers, so a key's rows fit a task."""

    def run(batches):
        for keys, nodes, infos in runs(batches, 1):
            starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            count = np.diff(np.append(starts, len(keys)))
            df = np.repeat(count, count)
            some = df > 1
            yield pa.RecordBatch.from_arrays([pa.array(x[some]) for x in (keys, nodes, infos, df.astype(np.int64))], names=["key", "node", "info", "df"])

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(run, "key int, node long, info int, df long")


def meeting(kinds: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """(key, node, info): the shingles of heads that stand in two texts or more; info holds the size
    of the set (from bit 32) and the place of the shingle in the order of that set."""
    n, size = F.col("n"), F.size("counted")
    length = F.least(n, n - F.ceil(F.lit(least) * n - F.lit(1e-6)) + 1)
    common = held_by_two(kinds.select(F.explode("counted").alias("key"), "node", F.lit(0).alias("info")))
    common = common.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "key"))).alias("own"))
    alone = size - F.size("own")  # shingles of this text only: they come first
    heads = kinds.join(common, "node").select("node", n, length.alias("length"), alone.alias("alone"), "own").where("alone < length")
    heads = heads.select("node", "n", "alone", F.posexplode(F.slice("own", 1, (F.col("length") - F.col("alone")).cast("int"))).alias("at", "x"))
    first = heads.select(F.col("x.key").alias("key"), "node", (F.shiftleft("n", 32) + F.col("alone") + F.col("at")).alias("info"))
    more = kinds.where(F.size("more") > 0).select("node", F.posexplode("more").alias("at", "key")).select("key", "node", F.col("at").alias("info"))
    # common shingles are many texts': their buckets are cut into tiles, not counted
    last = more.join(kinds.select("node", "n", size.alias("before")), "node").select("key", "node", (F.shiftleft("n", 32) + F.col("before") + F.col("info")).alias("info"))
    return first.union(last)


def fitting(a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Whether sets may have the similarity, by sizes and by the places of a shingle that they share
    (info): all that they share at or after the first such lies at or after these places."""
    n, m = a >> 32, b >> 32
    need = np.ceil((n + m) * (least / (1 + least)) - 1e-6)
    return (np.minimum(n, m) >= least * np.maximum(n, m) - 1e-6) & (np.minimum(n - (a & 0xFFFFFFFF), m - (b & 0xFFFFFFFF)) >= need)


def pairs_of(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    pairs = np.unique(np.sort(np.stack((a, b), axis=1), axis=1), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def bitmap(shingles: np.ndarray) -> bytes:
    """BITS bits, of which each shingle turns one over."""
    at = (shingles.view(np.uint32) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS.bit_length() + 1)
    return np.packbits(np.bincount(at, minlength=BITS).astype(np.uint8) & 1).tobytes()


def alike(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray, least: float) -> np.ndarray:
    """Whether sets of sizes a and b, with bitmaps x and y, may have the similarity."""
    need = np.ceil((a + b) * (least / (1 + least)) - 1e-6)
    return np.bitwise_count(x ^ y).sum(1, dtype=np.int64) <= a + b - 2 * need


def words_of(bits: np.ndarray) -> np.ndarray:
    return np.frombuffer(b"".join(bits.tolist()), np.uint64).reshape(len(bits), -1)


def neighbours(met: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """(a, b), a below b: of each bucket the nodes that are next to each other by size, and each
    with the first; only those that may have the similarity."""
    rows = met.select("key", F.col("node").alias("root"), "node", "info", F.lit(b"").alias("bits"))
    return adjacent(rows, F.shiftright("info", 32), least)


def others(apart: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """(a, b), a below b: the same of nodes in an order by chance, of different components."""
    return adjacent(apart, F.xxhash64("node", "key"), least)


def adjacent(rows: DataFrame, order, least: float) -> DataFrame:
    def run(batches):
        before = None  # the row before and the first of its bucket: key, root, node, info, bits, and again
        for batch in batches:
            keys, roots, nodes, infos, bits = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            if not len(keys):
                continue
            if before is None:
                before = (keys[0], roots[0], nodes[0], infos[0], bits[0], roots[0], nodes[0], infos[0], bits[0])
            keys, roots, nodes, infos, bits = (np.concatenate((np.array([x], y.dtype), y)) for x, y in zip(before[:5], (keys, roots, nodes, infos, bits), strict=True))
            new = np.concatenate(([False], keys[1:] != keys[:-1]))
            start = np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))
            lead = [x[start] for x in (roots, nodes, infos, bits)]
            for x, old in zip(lead, before[5:], strict=True):
                x[start == 0] = old
            at, words = np.flatnonzero(~new)[1:], words_of(bits)
            far, near = words_of(lead[3]), at[(roots[at] != roots[at - 1]) & fitting(infos[at], infos[at - 1], least)]
            near = near[alike(infos[near] >> 32, infos[near - 1] >> 32, words[near], words[near - 1], least)]
            at = at[(roots[at] != lead[0][at]) & fitting(infos[at], lead[2][at], least)]
            at = at[alike(infos[at] >> 32, lead[2][at] >> 32, words[at], far[at], least)]
            yield pairs_of(np.concatenate((nodes[near], nodes[at])), np.concatenate((nodes[near - 1], lead[1][at])))
            before = (keys[-1], roots[-1], nodes[-1], infos[-1], bits[-1], *(x[-1] for x in lead))

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = tiled(rows, "key", "node", TILE).where("block = t1 and t1 = t2")  # a block of a large bucket by itself
    rows = rows.repartition(parts, "key", "block").sortWithinPartitions("key", "block", order, "node")
    return rows.select("key", "root", "node", "info", "bits").mapInArrow(run, "a long, b long").distinct()


def apart(met: DataFrame, roots: DataFrame, bits: DataFrame) -> DataFrame:
    """(key, root, node, info, bits) of the buckets that hold nodes of different components (node,
    root; nodes that are not there are alone)."""
    rows = met.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    some = rows.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
    return rows.join(some, "key", "left_semi").join(bits.select("node", "bits"), "node").select("key", "root", "node", "info", "bits")


def across(rows: DataFrame, least: float = SIMILARITY, tile: int | None = None) -> DataFrame:
    """(a, b), a below b: all pairs of different components in a bucket of rows (key, root, node,
    info, bits) that may have the similarity: none that has it is left out."""

    def run(batches):
        for keys, t1, t2, blocks, roots, nodes, infos, bits in runs(batches, 3):
            found: list[list[np.ndarray]] = [[], []]
            words = words_of(bits)
            starts = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]) | (t1[1:] != t1[:-1]) | (t2[1:] != t2[:-1]))))
            for at, end in zip(starts, np.append(starts[1:], len(keys)), strict=True):
                a = np.flatnonzero(blocks[at:end] == t1[at]) + at
                b = np.flatnonzero(blocks[at:end] == t2[at]) + at
                step = max(1, BLOCK // max(1, 16 * len(b)))
                for i in range(0, len(a), step):
                    own = a[i : i + step]
                    x, y = np.nonzero((roots[own, None] < roots[None, b]) & fitting(infos[own, None], infos[None, b], least))
                    if t1[at] != t2[at]:
                        u, v = np.nonzero((roots[own, None] > roots[None, b]) & fitting(infos[own, None], infos[None, b], least))
                        x, y = np.concatenate((x, u)), np.concatenate((y, v))
                    x, y = own[x], b[y]
                    some = alike(infos[x] >> 32, infos[y] >> 32, words[x], words[y], least)
                    found[0].append(nodes[x[some]])
                    found[1].append(nodes[y[some]])
                    if sum(map(len, found[0])) >= BLOCK:
                        yield pairs_of(*map(np.concatenate, found))
                        found = [[], []]
            yield pairs_of(*(np.concatenate([np.zeros(0, np.int64), *x]) for x in found))

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = tiled(rows, "key", "node", tile or TILE).select("key", "t1", "t2", "block", "root", "node", "info", "bits")
    rows = rows.repartition(parts, "key", "t1", "t2").sortWithinPartitions("key", "t1", "t2")
    return rows.mapInArrow(run, "a long, b long").distinct()


def verified(edges: DataFrame, sets: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """Those of edges (a, b) whose sets (node, shingles) have the similarity."""

    def run(batches):
        for batch in batches:
            left, right = batch.column(2), batch.column(3)
            keep = [similarity(left[i].values.to_numpy(), right[i].values.to_numpy()) >= least for i in range(len(batch))]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    both = edges.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
    both = both.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def sets_of(docs: DataFrame, wanted: DataFrame, words: int, doc_id: str, text: str) -> DataFrame:
    """(node, shingles, bits) of the rows wanted (k_id, k_mark, node)."""

    def run(batches):
        for batch in batches:
            found = [shingle_set(t, words) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32())), pa.array([bitmap(x) for x in found], pa.binary())], names=["node", "shingles", "bits"])

    own = docs.select(F.col(doc_id).alias("d_id"), F.xxhash64(text).alias("d_mark"), F.col(text).alias("d_text"))
    own = own.join(wanted, own["d_id"].eqNullSafe(wanted["k_id"]) & (own["d_mark"] == wanted["k_mark"]))
    return own.select("node", "d_text").mapInArrow(run, "node long, shingles array<int>, bits binary").dropDuplicates(["node"])


def classes(docs: DataFrame, words: int = WORDS, least: float = SIMILARITY, radius: int = RADIUS, segments: int = SEGMENTS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, mark, lead) of every row; lead is the first (doc_id, mark) of its class, null ids last.

    A null text counts as empty; texts without words are one class, texts of the same words (case
    of A-Z and white space apart) too.  Repeated rows are in one class.  An empty table gives none."""
    with scratch() as keep:
        rows = docs.count()  # bounds what is spooled, in rows as wide as a few numbers
        every = spool(marked(docs, words, doc_id, text, least, common_shingles(docs, rows, words, text)), "marked", 128 * rows)
        first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark"))
        kinds = spool(every.groupBy("node").agg(F.first("fp").alias("fp"), F.first("n").alias("n"), first.alias("lead"), F.first("counted").alias("counted"), F.first("more").alias("more")), "kinds", 16 * rows)
        own = keep(spool(every.select("doc_id", "mark", "node").join(kinds.select("node", "lead"), "node"), "own", rows))
        discard(every)
        met = spool(meeting(kinds, least), "meeting", 8 * rows)
        known = spool(both_ways(candidates(kinds, rows, radius, segments)), "candidates", rows)
        wanted = met.select("node").union(known.select("a")).union(known.select("b")).distinct()
        wanted = spool(kinds.join(wanted, "node").select(F.col("lead.doc_id").alias("k_id"), F.col("lead.mark").alias("k_mark"), "node"), "wanted", rows)
        sets = spool(sets_of(docs, wanted, words, doc_id, text), "sets", 64 * rows)
        roots, seen = None, None
        for found in (lambda: known.union(neighbours(met, least)), lambda: others(apart(met, roots, sets), least), lambda: across(apart(met, roots, sets), least)):
            edges = found().distinct()
            edges = spool(edges if seen is None else edges.join(seen, ["a", "b"], "left_anti"), "edges", 4 * rows)
            linked = spool(verified(edges, sets, least), "links", 4 * rows)
            seen = edges if seen is None else seen.union(edges)
            roots = spool(components(linked if roots is None else linked.union(roots.where("node <> root"))), "roots", rows)
        linked = kinds.select("node", "lead").join(roots, "node")
        leads = keep(spool(linked.join(linked.groupBy("root").agg(F.min("lead").alias("first")), "root").select("node", "first"), "leads", rows))
    return own.join(leads, "node", "left").select("doc_id", "mark", F.coalesce("first", "lead").alias("lead"))


def both_ways(edges: DataFrame) -> DataFrame:
    """(a, b), a below b, once each."""
    return edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_deduplicated(docs: DataFrame, words: int = WORDS, least: float = SIMILARITY, radius: int = RADIUS, segments: int = SEGMENTS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that stay: of each class that with the smallest id, null ids last.

    Rows alike in id and text stay or go together; exact deduplication leaves no such rows."""
    with scratch() as keep:
        found = classes(docs, words, least, radius, segments, doc_id, text)
        same = F.col("doc_id").eqNullSafe(F.col("lead.doc_id")) & (F.col("mark") == F.col("lead.mark"))
        gone = keep(spool(found.where(~same).select("doc_id", "mark").distinct(), "gone", docs.count()))
    (mark,) = fresh(docs, "mark")
    gone = gone.toDF("gone_id", "gone_mark")
    own = docs.withColumn(mark, F.xxhash64(docs[text]))
    return own.join(gone, own[doc_id].eqNullSafe(gone["gone_id"]) & (own[mark] == gone["gone_mark"]), "left_anti").select(*docs.columns)
