"""Helpers the operators share: blocks of documents, staged tables, words of UTF-8 buffers, components."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import shared_folder

#: Bytes of text that one block aims at, and of text handled at once within a task.
BLOCK_BYTES, TILE_BYTES, SHINGLE_TILE = 8 << 20, 2 << 20, 1 << 19
#: Bytes of an Arrow batch. Spark keeps the buffers of larger ones outside its heap for the rest of an executor's life.
BATCH_BYTES, BATCH_KEY = 2 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame) -> DataFrame:
    """`df` as a Parquet table in the shared folder: lineage ends there and any executor can read it again."""
    path = f"{shared_folder(df.sparkSession)}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of this session hold about `BATCH_BYTES` from now on, unless it has a size of its own."""
    if spark.conf.get(BATCH_KEY, None) is None:
        spark.conf.set(BATCH_KEY, str(BATCH_BYTES))


def width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def blocked(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """`doc_id, text` (null: empty) with a `block` number: whole documents dealt evenly by a hash of id and text."""
    d = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    total = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(width(docs.sparkSession), -(-total // block_bytes))
    return d.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int"))


def buffers(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    big = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    kind = np.int64 if big else np.int32
    if offs is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(offs, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def tiles(off: np.ndarray, size: int = TILE_BYTES):
    """Ranges of rows with about `size` bytes each; a longer row is a tile by itself."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + size, "right")) - 1)
        yield i, j
        i = j


_ZSTD = pa.Codec("zstd", 1)


def packed(a: np.ndarray, ascending: bool = False) -> bytes:
    """Numbers by planes of bytes, compressed; integers that ascend as their differences."""
    wide = np.diff(a, prepend=a.dtype.type(0)) if ascending else a
    planes = np.ascontiguousarray(wide).view(np.uint8).reshape(-1, a.itemsize).T
    return len(a).to_bytes(8, "little") + _ZSTD.compress(planes.tobytes(), asbytes=True)


def unpacked(b: bytes, kind, ascending: bool = False) -> np.ndarray:
    """The numbers that `packed` has compressed."""
    n, size = int.from_bytes(b[:8], "little"), np.dtype(kind).itemsize
    planes = np.frombuffer(_ZSTD.decompress(b[8:], n * size, asbytes=True), np.uint8).reshape(size, n)
    a = np.ascontiguousarray(planes.T).view(kind).reshape(n)
    return np.cumsum(a, dtype=kind) if ascending else a


#: ASCII lower case, and the bytes that end a word (space and 0x09-0x0D).
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
_B = 0x9E3779B97F4A7C15 | 1
_POW = {"n": 0, "up": np.ones(0, np.uint64), "down": np.ones(0, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _POW["n"] < n:
        size = max(n, 1 << 16)
        for name, base in (("up", _B), ("down", pow(_B, -1, 1 << 64))):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            _POW[name] = np.multiply.accumulate(a)
        _POW["n"] = size
    return _POW["up"], _POW["down"]


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit values (in place)."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_spans(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in documents laid end to end, and the first word of each document (one more)."""
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    word = ~SPACE[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[off] = True
    before = np.concatenate(([False], word[:-1])) & ~edge[:-1]
    after = np.concatenate((word[1:], [False])) & ~edge[1:]
    starts, ends = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each lower-cased word."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + TILE_BYTES, "right")))
        a, b = int(starts[i]), int(ends[j - 1])
        up, down = _powers(b - a)
        run = np.zeros(b - a + 1, np.uint64)
        np.cumsum((LOWER[buf[a:b]].astype(np.uint64) + np.uint64(1)) * up[: b - a], out=run[1:])
        s = starts[i:j] - a
        out[i:j] = (run[ends[i:j] - a] - run[s]) * down[s]
        i = j
    return mix64(out)


def shingle_sets(buf: np.ndarray, off: np.ndarray, k: int = 5):
    """For each document in turn its sorted distinct hashes of `k` following words (all its words, if fewer)."""
    odd = mix64(np.arange(1, k + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)  # unrelated factors
    for i, j in tiles(off, SHINGLE_TILE):
        b, o = buf[off[i] : off[j]], off[i : j + 1] - off[i]
        starts, ends, first = word_spans(b, o)
        h = word_hashes(b, starts, ends)
        m = max(0, len(h) - k + 1)
        s = np.zeros(m, np.uint64)
        for x in range(k):
            s += h[x : x + m] * odd[x]
        mix64(s)
        for d in range(j - i):
            a, z = first[d], first[d + 1]
            if z - a >= k:
                yield np.unique(s[a : z - k + 1])
            elif z > a:
                yield mix64(np.array([sum(v * c for v, c in zip(h[a:z].tolist(), odd.tolist())) + int(z - a) & (2**64 - 1)], np.uint64))
            else:
                yield s[:0]


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that lead every node of some pairs, but the smallest of each component of theirs, to that smallest one."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        lx, ly = label[x], label[y]
        apart = lx != ly
        if not apart.any():
            break
        x, y, lx, ly = x[apart], y[apart], lx[apart], ly[apart]
        np.minimum.at(label, np.maximum(lx, ly), np.minimum(lx, ly))
        while (up := label[label]).tobytes() != label.tobytes():
            label = up
    away = label < np.arange(len(nodes))
    return nodes[away], nodes[label[away]]


def components(edges: DataFrame) -> DataFrame:
    """Connected components of `a, b` pairs: `node, label`, the label being the component's smallest node.

    Small-star and large-star rounds (Kiveris et al. 2014), each star one exchange: no neighbour list is gathered. Every three
    rounds go to the shared folder, until the last star meets only stars. Rounds grow with the logarithm of the largest component.
    """
    node = Window.partitionBy("u")
    tasks = 4 * edges.sparkSession.sparkContext.defaultParallelism  # pairs are small: more tasks than that cost more than they save

    def small(e: DataFrame) -> DataFrame:
        # every node points its smaller neighbours, and itself, to the smallest
        met = e.repartition("u").dropDuplicates(["u", "v"]).withColumn("m", F.min("v").over(node))
        return met.select(F.when(F.col("v") > F.col("m"), F.col("v")).otherwise(F.col("u")).alias("u"), F.col("m").alias("v")).coalesce(tasks)

    def large(e: DataFrame) -> DataFrame:
        # every node points its larger neighbours to its smallest one; apart: it is neither a centre nor the end of one link
        both = e.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
        met = both.repartition("u").dropDuplicates(["u", "v"]).withColumn("m", F.least("u", F.min("v").over(node)))
        met = met.withColumn("apart", (F.col("m") < F.col("u")) & (F.col("v") > F.col("m"))).where("v > u or apart")
        return met.select(F.when(F.col("v") > F.col("u"), F.col("v")).alias("u"), F.col("m").alias("v"), "apart").coalesce(tasks)

    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v")
    while True:
        for _ in range(3):
            met = large(small(e))
            e = met.where("u is not null").select("u", "v")
        met = staged(met)
        e = met.where("u is not null").select("u", "v")
        if not met.agg(F.max("apart")).first()[0]:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("label")).union(e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
