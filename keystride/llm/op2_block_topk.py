"""Exact inner-product top-k by blocks: ranges of documents with their term maxima, forward indexes and falling bounds.

Vectors (integers floor(1024 x)) are ordered by their leading component and cut into ranges and, within these, into blocks
of `BLOCK`. A block keeps its vectors (the forward index) and the largest and smallest value of each component (the
terms). The sum over components of q * max (or min where q < 0) bounds every score in a block. A query first searches
the range with the highest bound; its k-th score there decides which other ranges it visits. Within a range blocks are
scored in order of falling bound until the bound is below the k-th score. Nothing is approximated.

There are at most `MAX_RANGES` ranges, so the table of range bounds that plans the visits has a size bound; queries go to
ranges in chunks of `CHUNK`, so a task holds one range and one chunk.

Rows without an id, and vectors that are null or hold null or non-finite components, take no part. Shorter vectors count as
padded with zeros. A query is never paired with rows of its own id; of a repeated query id one vector is searched (the
smallest in array order), as candidates all its rows count. Ties go to the smaller id. Scores beyond 64 bits are cut to the
largest long. Empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import buffers, staged, table, width

BLOCK, CHUNK, MAX_RANGES, RANGE_ROWS = 32, 4096, 4096, 32768
SCALE = 1024


def integers(rows: DataFrame) -> DataFrame:
    """`vec_id, v`: the vectors that take part."""
    x = F.transform("embedding", lambda e: e.cast("double"))
    good = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < float("inf")))
    return rows.where(good).select(F.col("vec_id").cast("long"), F.transform(x, lambda e: F.floor(e * SCALE)).alias("v"))


def matrix(column, dims: int | None = None) -> np.ndarray:
    """Lists of longs as a matrix, padded with zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    dims = max([dims or 0, *size.tolist()])
    out = np.zeros((len(size), dims), np.int64)
    out[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def build_index(vectors: DataFrame) -> DataFrame:
    """`part, dims, ids, vectors, top, low`: one row per block."""
    n = vectors.count()
    ranges = int(min(MAX_RANGES, max(width(vectors.sparkSession), -(-n // RANGE_ROWS))))
    # the component of largest size leads, with its sign; equal vectors lie together and may fill many ranges
    size = F.transform("v", lambda x: F.abs(x))
    at = F.when(F.size("v") > 0, F.array_position(size, F.array_max(size))).otherwise(0)
    lead = F.when(F.size("v") > 0, F.get("v", at.cast("int") - 1)).otherwise(0)
    keyed = vectors.withColumn("lead", at * F.when(lead < 0, -1).otherwise(1)).withColumn("most", F.abs(lead))
    dealt = keyed.repartitionByRange(ranges, "lead", "most", "vec_id").sortWithinPartitions("lead", "most", "vec_id").select("vec_id", "v")

    def cut(batches):
        part = TaskContext.get().partitionId()
        for b in batches:
            v, ids = matrix(b.column("v")), b.column("vec_id").to_numpy(zero_copy_only=False)
            rows = [(part, v.shape[1], ids[i : i + BLOCK].tobytes(), v[i : i + BLOCK].tobytes(), v[i : i + BLOCK].max(0).tobytes(), v[i : i + BLOCK].min(0).tobytes()) for i in range(0, len(ids), BLOCK)]
            yield pa.record_batch([pa.array([r[i] for r in rows], pa.int32() if i < 2 else pa.binary()) for i in range(6)], names=["part", "dims", "ids", "vectors", "top", "low"])

    return staged(dealt.mapInArrow(cut, "part int, dims int, ids binary, vectors binary, top binary, low binary"))


def _padded(column, dims: list[int], width_: int) -> np.ndarray:
    raw, off = buffers(column)
    out = []
    for a, z, d in zip(off[:-1], off[1:], dims):
        m = np.frombuffer(raw[a:z].tobytes(), np.int64).reshape(-1, d) if d else np.zeros((1, 0), np.int64)
        out.append(np.pad(m, ((0, 0), (0, width_ - d))))
    return np.concatenate(out)


def bounds(q: np.ndarray, top: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Upper bounds of the scores of each query in each block; widened by what doubles may round off."""
    q, top, low = (x.astype(np.float64) for x in (q, top, low))
    b = np.maximum(q, 0) @ top.T + np.minimum(q, 0) @ low.T
    wide = np.abs(q) @ np.maximum(np.abs(top), np.abs(low)).T
    return b + np.where(wide < 2.0**52, 0, wide * 1e-12)


def scores(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    if float(np.abs(v).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(1, v.shape[1]) < 2.0**53:
        return (v.astype(np.float64) @ q.astype(np.float64)).astype(np.int64)  # exact: no sum leaves 53 bits
    return np.array([min(max(int(s), -(2**63)), 2**63 - 1) for s in v.astype(object) @ q.astype(object)], np.int64)


def search_range(index: pa.Table, queries: pa.Table, k: int):
    """`query_id, vec_id, score`: for each query its best of this range, down to its threshold `least` (null: none)."""
    dims = index.column("dims").to_pylist()
    q = matrix(queries.column("v"), max(dims))
    d = q.shape[1]
    v, top, low = (_padded(index.column(c), dims, d) for c in ("vectors", "top", "low"))
    ids = np.frombuffer(buffers(index.column("ids"))[0].tobytes(), np.int64)
    size = np.diff(buffers(index.column("ids"))[1]) // 8
    start = np.cumsum(size) - size
    bound = bounds(q, top, low)
    for r, (qid, least) in enumerate(zip(queries.column("query_id").to_pylist(), queries.column("least").to_pylist())):
        order = np.argsort(-bound[r], kind="stable")
        got_s, got_i = np.zeros(0, np.int64), np.zeros(0, np.int64)
        at, step = 0, 4
        while at < len(order):
            kth = int(got_s[k - 1]) if len(got_s) >= k else None
            floor = max(x for x in (kth, least, -(2**63)) if x is not None)
            take = order[at : at + step]
            take = take[bound[r][take] >= floor]
            if not len(take):
                break  # bounds only fall
            rows = np.concatenate([np.arange(start[b], start[b] + size[b]) for b in take])
            rows = rows[ids[rows] != qid]
            s, i = np.append(got_s, scores(v[rows], q[r])), np.append(got_i, ids[rows])
            best = np.lexsort((i, -s.astype(np.float64) if np.abs(s).max(initial=0) < 2**53 else [-int(x) for x in s]))[:k]
            got_s, got_i = s[best], i[best]
            at, step = at + step, step * 2
        yield from ((qid, int(i), int(s)) for i, s in zip(got_i, got_s) if least is None or s >= least)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """`query_id, rank, vec_id, score` for `queries` (`query_id, v`) against `vectors` (`vec_id, v`)."""
    spark = vectors.sparkSession
    index = build_index(vectors)

    def outline(t: pa.Table) -> pa.Table:
        dims = t.column("dims").to_pylist()
        top, low = (_padded(t.column(c), dims, max(dims)) for c in ("top", "low"))
        return pa.table({"part": t.column("part")[:1], "dims": pa.array([max(dims)], pa.int32()), "top": pa.array([top.max(0).tobytes()], pa.binary()), "low": pa.array([low.min(0).tobytes()], pa.binary())})

    ranges = index.groupBy("part").applyInArrow(outline, "part int, dims int, top binary, low binary").orderBy("part").toArrow()  # MAX_RANGES rows at most
    if not ranges.num_rows:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dims = ranges.column("dims").to_pylist()
    parts = np.array(ranges.column("part").to_pylist(), np.int32)
    tops, lows = (_padded(ranges.column(c), dims, max(dims)) for c in ("top", "low"))
    chunks = -(-queries.count() // CHUNK)
    queries = queries.groupBy("query_id").agg(F.min("v").alias("v")).withColumn("chunk", F.pmod(F.xxhash64("query_id"), F.lit(max(1, chunks))).cast("int"))

    def visits(first: bool):
        def plan(batches):
            for b in batches:
                q = matrix(b.column("v"), max(dims))
                wide = q.shape[1] - tops.shape[1]
                bound = bounds(q, np.pad(tops, ((0, 0), (0, wide))), np.pad(lows, ((0, 0), (0, wide))))
                best = bound.argmax(1)
                if first:
                    rows, to = np.arange(len(q)), best
                else:
                    least = np.array([-np.inf if x is None else x for x in b.column("least").to_pylist()])
                    rows, to = np.nonzero((bound >= least[:, None]) & (np.arange(len(parts)) != best[:, None]))
                yield pa.record_batch([*(c.take(pa.array(rows)) for c in b.columns), pa.array(parts[to])], names=[*b.schema.names, "part"])

        return plan

    def search(t: pa.Table, q: pa.Table) -> pa.Table:
        rows = list(search_range(t, q, k)) if t.num_rows and q.num_rows else []
        return pa.table({n: pa.array([r[i] for r in rows], pa.int64()) for i, n in enumerate(("query_id", "vec_id", "score"))})

    def run(asked: DataFrame) -> DataFrame:
        spread = index.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(max(1, chunks) - 1))))
        return spread.groupBy("part", "chunk").cogroup(asked.groupBy("part", "chunk")).applyInArrow(search, "query_id long, vec_id long, score long")

    kind = "query_id long, v array<bigint>, chunk int, least long"
    start = queries.withColumn("least", F.lit(None).cast("long")).select("query_id", "v", "chunk", "least")
    first = staged(run(start.mapInArrow(visits(True), kind + ", part int")))
    kth = first.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))
    again = queries.join(kth, "query_id", "left").select("query_id", "v", "chunk", "least")
    found = first.union(run(again.mapInArrow(visits(False), kind + ", part int")))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = integers(table(spark, sf_dir, "embeddings"))
    return top_k(v, v.where(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), "v"))


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
           WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, d.vec_id, list_inner_product(q.v, d.v)::BIGINT AS score FROM v q JOIN v d ON q.vec_id % 100 = 0 AND q.vec_id <> d.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s
QUALIFY rank <= 10"""
