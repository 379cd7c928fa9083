"""Quality by compression: texts that a dictionary of good text packs tighter than one of bad text are good.

Two zstandard dictionaries are trained, one on pieces of text labelled good and one on pieces labelled bad. A text is cut
into pieces of `PIECE` bytes, each packed with either dictionary alone, so that a long text is judged by the dictionaries to
its end and repeats within it do not hide what it is made of. With the summed sizes g and b, the normalised difference
(b - g) / (b + g) becomes a score by logistic regression, fitted on labelled rows that no dictionary has seen.

The classifier is fitted on a bounded sample: of each label the ids whose hash lies below a cut that takes `SAMPLE` of them on
average, of each of their texts at most `PIECES` pieces for the dictionaries, evenly spread; rows with a negative hash train dictionaries, the others the curve.
The curve weighs a label by all its rows. Every row is scored, over its whole text. Only the sample passes the driver:
pieces up to `TRAIN_BYTES` per label and two numbers per sampled row.

A document's label is the majority of its non-null labels; on a tie, or with a null doc_id, it has none. Labels other than 0
and 1 do not count. Without one of the labels the score is the smoothed share of good labels (0.5 without any). Null and empty
texts have no pieces, their difference is 0. Repeated rows are scored each; ids that repeat share the label. Empty tables give
no rows. `score` keeps all columns but `text`, and replaces those that have the names it adds (`good_bytes, bad_bytes, score`).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import buffers, table
from .op1_ppm_score import remainder

PIECE, LEVEL, DICT_BYTES = 1024, 3, 110 << 10
SAMPLE, PIECES, TRAIN_BYTES = 8192, 16, 12 << 20


class Model:
    """The two dictionaries (None: not enough text of that label) and the curve from difference to score."""

    def __init__(self, good: bytes | None, bad: bytes | None, slope: float, bias: float):
        self.good, self.bad, self.slope, self.bias = good, bad, slope, bias

    def sizes(self, column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Packed bytes of each text with either dictionary, its pieces packed one by one."""
        raw, off = buffers(column)
        view, n = memoryview(raw), len(off) - 1
        if self.good is None or self.bad is None:
            return np.zeros(n, np.int64), np.zeros(n, np.int64)
        out = np.zeros((2, n), np.int64)
        for row, words in zip(out, (self.good, self.bad)):
            pack = zstandard.ZstdCompressor(
                level=LEVEL, dict_data=zstandard.ZstdCompressionDict(words), write_checksum=False, write_content_size=False, write_dict_id=False
            ).compress
            for i in range(n):
                row[i] = sum(len(pack(view[a : min(a + PIECE, off[i + 1])])) for a in range(off[i], off[i + 1], PIECE))
        return out[0], out[1]

    def scores(self, good: np.ndarray, bad: np.ndarray) -> np.ndarray:
        x = difference(good, bad)
        return 1 / (1 + np.exp(-np.clip(self.slope * x + self.bias, -500, 500)))


def difference(good: np.ndarray, bad: np.ndarray) -> np.ndarray:
    return (bad - good) / np.maximum(good + bad, 1)


def majority(labels: DataFrame, label: str = "quality") -> DataFrame:
    """`doc_id, good`: one row per labelled id."""
    votes = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg(label).alias("share"))
    return votes.where("share <> 0.5").select("doc_id", (F.col("share") > 0.5).cast("int").alias("good"))


def _pieces(batches):
    """Pieces of each text, evenly spread, at most `PIECES`."""
    for b in batches:
        raw, off = buffers(b.column("text"))
        good, key = b.column("good").to_pylist(), b.column("key").to_pylist()
        rows = [[], [], []]
        for i in range(len(good)):
            n = -(-int(off[i + 1] - off[i]) // PIECE)
            for p in dict.fromkeys(int(x) for x in np.linspace(0, n - 1, min(n, PIECES))) if n else ():
                a = int(off[i]) + p * PIECE
                rows[0].append(good[i])
                rows[1].append(key[i])
                rows[2].append(raw[a : min(a + PIECE, int(off[i + 1]))].tobytes())
        yield pa.record_batch([pa.array(rows[0], pa.int32()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.binary())], names=["good", "key", "piece"])


def _dictionary(pieces: list[bytes]) -> bytes | None:
    """A trained dictionary; of too little or too uniform text, the text itself."""
    pieces = [p for p in pieces if p]
    if not pieces:
        return None
    size = min(DICT_BYTES, max(1024, sum(map(len, pieces)) // 4))
    try:
        return zstandard.train_dictionary(size, pieces).as_bytes()
    except zstandard.ZstdError:
        return b" ".join(pieces)[:size].ljust(8, b" ")


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and intercept by Newton steps, with a slight pull of the slope to zero for labels that x parts wholly."""
    scale = max(float(np.sqrt(np.average(x * x, weights=w))), 1e-12)
    a, beta = np.stack([x / scale, np.ones_like(x)], 1), np.zeros(2)
    w, pull = w / w.mean(), np.diag([1e-2, 1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        step = np.linalg.solve((a.T * (w * p * (1 - p))) @ a + pull, a.T @ (w * (y - p)) - pull @ beta)
        size = float(np.abs(step).max())
        beta += step * min(1.0, 4.0 / max(size, 1e-12))
        if size < 1e-9:
            break
    return float(beta[0] / scale), float(beta[1])


def fit(docs: DataFrame, labels: DataFrame, training: Column | None = None, sample: int = SAMPLE) -> Model:
    """Learn from rows of `docs` (`doc_id, text`) where `training` (on doc_id) holds and that `labels` judges."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")) if training is None else docs.where(training).select(F.col("doc_id").cast("long").alias("doc_id"))
    judged = majority(labels).join(ids.distinct(), "doc_id", "left_semi").withColumn("key", F.xxhash64(F.lit(11), "doc_id"))
    totals = {r[0]: r[1] for r in judged.groupBy("good").count().collect()}
    if len(totals) < 2:
        n = sum(totals.values())
        share = (totals.get(1, 0) + 1) / (n + 2)
        return Model(None, None, 0.0, float(np.log(share / (1 - share))))
    # hashes below a cut that takes `sample` ids of each label on average, so no ranking of all ids is needed
    cut = F.when(F.col("good") == 1, sample / totals[1]).otherwise(sample / totals[0])
    taken = judged.where(F.pmod("key", F.lit(1 << 30)) < cut * (1 << 30))
    chosen = F.broadcast(taken.select(F.col("doc_id").alias("_id"), "good", "key"))  # about 2 * sample rows at any size
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), F.coalesce("text", F.lit("")).alias("text")).join(chosen, "_id")
    words = {}
    for good in (1, 0):
        own = rows.where((F.col("good") == good) & (F.col("key") < 0)).select("good", "key", "text").mapInArrow(_pieces, "good int, key long, piece binary")
        words[good] = _dictionary([r[0] for r in own.orderBy("key", "piece").limit(TRAIN_BYTES // PIECE).select("piece").collect()])
    model = Model(words[1], words[0], 0.0, 0.0)
    seen = measured(rows.where("key >= 0"), model).groupBy("key", "good").agg(F.min("good_bytes").alias("g"), F.min("bad_bytes").alias("b")).toPandas()
    if model.good is None or model.bad is None or seen["good"].nunique() < 2:
        share = totals[1] / (totals[0] + totals[1])
        return Model(None, None, 0.0, float(np.log(share / (1 - share))))
    seen = seen.sort_values("key")
    y = seen["good"].to_numpy(float)
    weight = np.where(y == 1, totals[1] / max(y.sum(), 1), totals[0] / max((1 - y).sum(), 1))
    model.slope, model.bias = _logistic(difference(seen["g"].to_numpy(float), seen["b"].to_numpy(float)), y, weight)
    return model


def measured(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` with `good_bytes` and `bad_bytes` of the whole text in place of `text`."""
    keep = docs.drop("text", "good_bytes", "bad_bytes").columns

    def pack(batches):
        for b in batches:
            g, h = model.sizes(b.column("text").cast(pa.large_string()).fill_null(""))
            yield pa.record_batch([*(b.column(c) for c in keep), pa.array(g), pa.array(h)], names=[*keep, "good_bytes", "bad_bytes"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in keep]
    return docs.select(*(F.col(f"`{c}`") for c in keep), "text").mapInArrow(pack, ", ".join([*fields, "good_bytes long, bad_bytes long"]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` without `text`, with `good_bytes, bad_bytes` and `score` (0 to 1; higher: good likelier)."""
    x = (F.col("bad_bytes") - F.col("good_bytes")) / F.greatest(F.col("good_bytes") + F.col("bad_bytes"), F.lit(1))
    z = F.greatest(F.lit(-500.0), F.least(F.lit(500.0), x * model.slope + model.bias))
    return measured(docs.drop("score"), model).withColumn("score", 1 / (1 + F.exp(-z)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"), remainder(3) != 1)
    rows = score(docs.withColumn("held_out", remainder(3) == 1), model)
    return rows.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "good_bytes", "bad_bytes")
