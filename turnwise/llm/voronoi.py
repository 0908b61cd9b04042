"""Exact top-k inner products by a Voronoi kNN join.

Inner products become Euclidean distances when each candidate x gets one more coordinate,
sqrt(M - |x|^2), where M is the largest squared length, and each query q gets 0: then
|q - x|^2 = |q|^2 + M - 2 q.x.  Queries and candidates are grouped by their nearest pivot.  From
summaries of the groups (the radius of the queries around a pivot, the smallest distances of the
candidates around each, k and as many as an asked id has rows) comes a bound for each group of queries within which its k nearest
lie; a candidate goes to a group only if the triangle inequality does not rule it out.  Groups are
solved apart, in chunks of candidates, by exact integer products, and each query's chunks merged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import spool

#: Pivots; reducer groups they are packed into; candidates of a chunk and queries of a block.
PIVOTS, GROUPS, CHUNK, QUERIES = 64, 8, 32768, 16384

#: Rows of an asked id up to which bounds are taken; beyond, all candidates are dealt to all groups.
COPIES = 10_000


def whole_numbers(vector: Column, factor: int = 1024) -> Column:
    """floor(factor * x) of each component as long; null if the vector takes no part."""
    good = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    inside = F.transform(vector, lambda x: F.floor(F.least(F.greatest(x.cast("double") * factor, F.lit(-9.2e18)), F.lit(9.2e18))))
    return F.when(F.coalesce(good, F.lit(False)), inside)


def products(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers as int64, held at the ends of its range."""
    if not queries.shape[1]:
        return np.zeros((len(queries), len(candidates)), np.int64)
    top = max(1, queries.shape[1]) * float(np.abs(queries).max(initial=0)) * float(np.abs(candidates).max(initial=0))
    if top < 2**53:
        return np.rint(queries.astype(np.float64) @ candidates.astype(np.float64).T).astype(np.int64)
    if top < 2**62:
        return queries @ candidates.T
    exact = queries.astype(object) @ candidates.astype(object).T
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= least)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def as_matrix(column, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int64).reshape(len(column), dim)


def top_products(vectors: DataFrame, k: int = 10, every: int = 100, vec_id: str = "vec_id", vector: str = "embedding", pivots: int = PIVOTS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by `every` the k highest
    inner products with rows of other ids, ties to the smaller id.

    Vectors that are null or hold null or non-finite components take no part, nor do rows without
    an id; a query with fewer candidates returns all it has.  Vectors of different lengths are not
    compared.  Of query rows alike in id and vector one counts; candidate rows count as often as
    they are there.  An empty table gives none."""
    spark = vectors.sparkSession
    own = vectors.select(F.col(vec_id).cast("long").alias("id"), whole_numbers(F.col(vector)).alias("v")).where("id is not null and v is not null")

    def packed(batches):
        for batch in batches:
            v = [np.array(x, np.int64) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in v], pa.int32()), pa.array([x.tobytes() for x in v], pa.binary()), pa.array([float((x.astype(float) ** 2).sum()) for x in v], pa.float64())], names=["id", "dim", "v", "sq"])

    rows = spool(own.mapInArrow(packed, "id long, dim int, v binary, sq double"), "vectors")
    shapes = {r["dim"]: (r["top"], r["n"], r["q"]) for r in rows.groupBy("dim").agg(F.max("sq").alias("top"), F.count("*").alias("n"), F.sum((F.col("id") % every == 0).cast("long")).alias("q")).collect()}
    parts = []
    for dim, (top, n, q) in sorted(shapes.items()):
        if q:
            parts.append(_one_shape(spark, rows.where(F.col("dim") == dim), dim, top, n, q, k, every, pivots))
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    out = parts[0]
    for x in parts[1:]:
        out = out.union(x)
    return out


def _one_shape(spark, rows: DataFrame, dim: int, top: float, n: int, q: int, k: int, every: int, pivots: int) -> DataFrame:
    # pivots: distinct vectors by the order of a hash, a bounded number of them on the driver
    chosen = rows.select("v").distinct().orderBy(F.xxhash64("v"), "v").limit(pivots).collect()
    centres = np.array([np.frombuffer(r["v"], np.int64) for r in chosen], np.float64).reshape(len(chosen), dim)
    raised = np.hstack((centres, np.sqrt(np.maximum(0, top - (centres**2).sum(1)))[:, None]))
    slack = 1e-6 * (1 + np.sqrt(top))  # far above rounding: bounds only grow

    # a query's own rows, all of its id, are no neighbours: as many more distances are kept
    copies = rows.where(F.col("id") % every == 0).groupBy("id").count().agg(F.max("count")).first()[0]
    held = k + min(copies, COPIES)

    def to_pivots(v: np.ndarray, query: bool) -> np.ndarray:
        more = np.zeros(len(v)) if query else np.sqrt(np.maximum(0, top - (v.astype(float) ** 2).sum(1)))
        x = np.hstack((v.astype(float), more[:, None]))
        return np.sqrt(np.maximum(0, (x**2).sum(1)[:, None] + (raised**2).sum(1)[None] - 2 * x @ raised.T))

    def summary(batches):
        """Of each partition and pivot: the queries' radius, and the `held` smallest distances."""
        far, near = np.full(len(raised), -1.0), [np.zeros(0) for _ in raised]
        for batch in batches:
            v, ids = as_matrix(batch.column(1), dim), batch.column(0).to_numpy(zero_copy_only=False)
            asked = ids % every == 0
            if asked.any():
                d = to_pivots(v[asked], True)
                np.maximum.at(far, d.argmin(1), d.min(1))
            d = to_pivots(v, False)
            at, least = d.argmin(1), d.min(1)
            for p in np.unique(at):
                near[p] = np.sort(np.concatenate((near[p], least[at == p])))[:held]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(raised)), pa.int32()), pa.array(far), pa.array([x.tolist() for x in near], pa.list_(pa.float64()))], names=["p", "far", "near"])

    found = rows.select("id", "v").mapInArrow(summary, "p int, far double, near array<double>").groupBy("p")
    found = found.agg(F.max("far").alias("far"), F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, held).alias("near")).orderBy("p").collect()
    between = np.sqrt(np.maximum(0, (raised**2).sum(1)[:, None] + (raised**2).sum(1)[None] - 2 * raised @ raised.T))
    far = np.array([r["far"] for r in found])
    bound = np.full(len(raised), np.inf)
    for i in np.flatnonzero(far >= 0):
        ends = np.sort(np.concatenate([between[i, j] + far[i] + np.array(r["near"]) for j, r in enumerate(found)]))
        if copies <= COPIES and len(ends) >= held:  # so many of them may be the query's own rows
            bound[i] = ends[held - 1] + slack
    order = np.argsort(-far, kind="stable")
    group = np.empty(len(raised), np.int64)
    group[order] = np.arange(len(raised)) % GROUPS
    chunks, blocks = max(8, -(-n // CHUNK)), max(1, -(-q // (QUERIES * GROUPS)))

    def deal(batches):
        """Queries go to all chunks of their group; candidates to one chunk of each group that may
        need them."""
        rng_mix = np.uint64(0x9E3779B97F4A7C15)
        for batch in batches:
            v, ids = as_matrix(batch.column(1), dim), batch.column(0).to_numpy(zero_copy_only=False)
            raw = batch.column(1)
            mixed = ids.astype(np.uint64) * rng_mix
            mixed ^= mixed >> np.uint64(29)
            chunk, block = (mixed % np.uint64(chunks)).astype(np.int64), ((mixed >> np.uint64(32)) % np.uint64(blocks)).astype(np.int64)
            out_group, out_chunk, out_block, at, asks = [], [], [], [], []

            def put(rows_, g, c, b, query):
                at.append(rows_), out_group.append(g), out_chunk.append(c), out_block.append(b), asks.append(np.full(len(rows_), query))

            asked = np.flatnonzero(ids % every == 0)
            if len(asked):
                mine = group[to_pivots(v[asked], True).argmin(1)]
                for c in range(chunks):
                    put(asked, mine, np.full(len(asked), c), block[asked], True)
            d = to_pivots(v, False)
            own, least = d.argmin(1), d.min(1)
            wanted = np.zeros((len(v), GROUPS), bool)
            for i in np.flatnonzero(far >= 0):
                near = (d[:, i] <= far[i] + bound[i] + slack) & (least >= between[own, i] - far[i] - bound[i] - slack)
                wanted[:, group[i]] |= near
            which, g = np.nonzero(wanted)
            for b in range(blocks):
                put(which, g, chunk[which], np.full(len(which), b), False)
            at = np.concatenate(at)
            key = (np.concatenate(out_group) * chunks + np.concatenate(out_chunk)) * blocks + np.concatenate(out_block)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.concatenate(asks)), pa.array(ids[at]), raw.take(pa.array(at))], names=["key", "asks", "id", "v"])

    def solve(table: pa.Table) -> pa.Table:
        asks = table.column("asks").to_numpy()
        ids, v = table.column("id").to_numpy(), as_matrix(table.column("v"), dim)
        q_ids, q_v, c_ids, c_v = ids[asks], v[asks], ids[~asks], v[~asks]
        out: list[list] = [[], [], [], []]
        for a in range(0, len(q_ids), 256):
            scores = products(q_v[a : a + 256], c_v) if len(c_ids) else np.zeros((len(q_ids[a : a + 256]), 0), np.int64)
            for qid, qv, row in zip(q_ids[a : a + 256], q_v[a : a + 256], scores, strict=True):
                others = np.flatnonzero(c_ids != qid)
                keep = others[best(row[others], c_ids[others], k)]
                out[0] += [qid] * len(keep)
                out[1] += [qv.tobytes()] * len(keep)
                out[2] += c_ids[keep].tolist()
                out[3] += row[keep].tolist()
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int64())], names=["query_id", "qv", "vec_id", "score"])

    # query rows alike in id and vector count once; candidates as often as they are there
    dealt = rows.select("id", "v").mapInArrow(deal, "key long, asks boolean, id long, v binary")
    asked = dealt.where("asks").distinct()
    solved = dealt.where("not asks").union(asked).groupBy("key").applyInArrow(solve, "query_id long, qv binary, vec_id long, score long")
    order = Window.partitionBy("query_id", "qv").orderBy(F.desc("score"), "vec_id")
    return solved.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id as vec_id, coalesce(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])), 0)::bigint as score
  from v q join v c on q.vec_id <> c.vec_id and len(q.v) = len(c.v) where q.vec_id % 100 = 0)
select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::integer as rank, vec_id, score
from s qualify row_number() over (partition by query_id order by score desc, vec_id) <= 10
"""
