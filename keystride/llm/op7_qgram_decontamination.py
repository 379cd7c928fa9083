"""Benchmark passages in documents by the q-gram lemma, verified by banded alignment.

Texts are compared as normal text: letters and digits, lower-cased, one space for anything between. An item of m characters
with an edit budget of e = floor(m * `RATE`) shares at least m + 1 - q - q e q-grams with any passage within the budget, and
all these pairs lie within e diagonals (document position minus item position) of each other. Shared q-grams are
therefore counted in bands 2 (e + 1) diagonals wide that start every e + 1 diagonals, so any e + 1 following diagonals fall
into one band; a band that reaches the count is a region, and an alignment within the band decides whether the item occurs
in it within its budget. Where the count falls below one, one shared q-gram is asked for; an item of fewer than q
characters has none and is not sought.

The items' q-grams travel with the tasks in shards of at most `SHARD_BYTES` of item text; more items are more shards, each
scanned in turn. Documents are not shuffled and are read whole.

Null or empty texts hold nothing; items without a letter or digit are left out. Items with equal text are each reported.
Null ids are kept; repeated rows are judged each; an empty table on either side gives no hit. Extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

Q, RATE, SHARD_BYTES = 12, 0.05, 4 << 20
_FOLD: dict[str, np.ndarray] = {}


def _fold() -> np.ndarray:
    """Lower case of letters and digits, 32 for all else."""
    if "map" not in _FOLD:
        chars = (chr(c) if not 0xD800 <= c < 0xE000 else " " for c in range(0x110000))
        _FOLD["map"] = np.fromiter(((ord(c.lower()) if len(c.lower()) == 1 else ord(c)) if c.isalnum() else 32 for c in chars), np.uint32, 0x110000)
    return _FOLD["map"]


def normal(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Normal text as code points, and the place of each in `text`."""
    c = _fold()[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
    keep = c != 32
    if len(c) > 1:
        keep[1:] |= c[:-1] != 32
    at = np.flatnonzero(keep)
    if len(at) and c[at[-1]] == 32:
        at = at[:-1]
    return c[at], at


def grams(c: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of the q characters from each place on."""
    n = len(c) - q + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    h, wide = np.zeros(n, np.uint64), c.astype(np.uint64)
    for k in range(q):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += wide[k : k + n]
    return h ^ (h >> np.uint64(29))


class Index:
    """Q-grams of items, sorted by hash, behind a bit table."""

    BITS = 22

    def __init__(self, items: list[tuple[int, str]], q: int, rate: float):
        self.q, self.rate, self.items = q, rate, []
        for i, t in items:
            c, _ = normal(t or "")
            if len(c) and (c != 32).any():
                self.items.append((i, c))
        g = [grams(c, min(q, len(c))) if len(c) >= q else np.zeros(0, np.uint64) for _, c in self.items]
        self.h = np.concatenate(g) if g else np.zeros(0, np.uint64)
        self.item = np.repeat(np.arange(len(g)), [len(x) for x in g])
        self.pos = np.concatenate([np.arange(len(x)) for x in g]) if g else np.zeros(0, np.int64)
        o = np.argsort(self.h, kind="stable")
        self.h, self.item, self.pos = self.h[o], self.item[o], self.pos[o]
        self.bit = np.zeros(1 << self.BITS, bool)
        self.bit[self._bit(self.h)] = True
        m = np.array([len(c) for _, c in self.items], np.int64)
        self.budget = np.floor(m * rate).astype(np.int64)
        self.need = np.maximum(1, m + 1 - q - q * self.budget)

    def _bit(self, h: np.ndarray) -> np.ndarray:
        return (h * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def regions(self, c: np.ndarray):
        """`item, least and largest diagonal, least and largest matching place` that the filter retains."""
        h = grams(c, self.q)
        at = np.flatnonzero(self.bit[self._bit(h)]) if len(h) else np.zeros(0, np.int64)
        a, z = np.searchsorted(self.h, h[at], "left"), np.searchsorted(self.h, h[at], "right")
        n = z - a
        if not n.sum():
            return
        where = np.repeat(a - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        place, item = np.repeat(at, n), self.item[where]
        diag = place - self.pos[where]
        step = self.budget[item] + 1
        low = diag // step
        # band b holds the diagonals of the steps b and b + 1
        key = np.concatenate([item << 40 | (low + (1 << 38)), item << 40 | (low - 1 + (1 << 38))])
        place, diag = np.tile(place, 2), np.tile(diag, 2)
        # a q-gram that recurs in the item or the document counts once per place of the document
        o = np.lexsort((place, key))
        key, place, diag = key[o], place[o], diag[o]
        once = np.concatenate(([True], (key[1:] != key[:-1]) | (place[1:] != place[:-1])))
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        got = np.add.reduceat(once.astype(np.int64), first)
        for f, e in zip(first[got >= self.need[key[first] >> 40]], np.append(first, len(key))[1:][got >= self.need[key[first] >> 40]]):
            yield int(key[f] >> 40), int(diag[f:e].min()), int(diag[f:e].max()), int(place[f]), int(place[e - 1])

    def hits(self, text: str) -> list[tuple[int, int, int, int]]:
        """`item_id, start, end, edits` of the items found, places in code points of `text`; one best place per item and region."""
        c, at = normal(text)
        best: dict[int, list] = {}
        for i, d0, d1, _, _ in self.regions(c):
            e = int(self.budget[i])
            found = align(self.items[i][1], c, d0 - e, d1 + e, e)
            if found and not any(s <= found[1] and found[0] <= t for s, t, _ in best.get(i, ())):
                best.setdefault(i, []).append(found)
        return sorted((self.items[i][0], int(at[s]), int(at[t - 1]) + 1, n) for i, f in best.items() for s, t, n in f)


def align(item: np.ndarray, doc: np.ndarray, low: int, high: int, budget: int) -> tuple[int, int, int] | None:
    """Best place of `item` in `doc` on the diagonals low..high, if within the budget: start, end, edits."""
    width, far = high - low + 1, budget + 1
    cost = np.full(width, far, np.int64)
    start = np.arange(low, high + 1)
    cost[(start >= 0) & (start <= len(doc))] = 0
    begin = start.copy()
    steps = np.arange(width)
    for i, ch in enumerate(item):
        j = low + i + steps  # the document character that this diagonal meets
        there = (j >= 0) & (j < len(doc))
        same = np.zeros(width, bool)
        same[there] = doc[j[there]] == ch
        new = np.where(there, cost + ~same, far)
        src = begin
        drop = np.append(cost[1:], far) + 1  # the item's character is missing in the document
        take = drop < new
        new, src = np.where(take, drop, new), np.where(take, np.append(begin[1:], 0), src)
        # characters the document has on top: cheapest to the left plus the distance
        run = np.minimum.accumulate(new - steps)
        ins = run + steps
        if (ins < new).any():
            at = np.maximum.accumulate(np.where(new - steps == run, steps, 0))
            src = np.where(ins < new, src[at], src)
            new = np.minimum(ins, new)
        cost, begin = np.minimum(new, far), src
        if cost.min() > budget:
            return None
    ends = low + len(item) + steps
    cost = np.where((ends >= 0) & (ends <= len(doc)), cost, far)
    k = int(cost.argmin())
    return (int(begin[k]), int(ends[k]), int(cost[k])) if cost[k] <= budget and ends[k] > begin[k] else None


def shards(items: DataFrame, q: int, rate: float):
    """Indexes over all items, each of about `SHARD_BYTES` of text."""
    rows = items.select(F.col("item_id").cast("long"), "text").where("text is not null")
    n = max(1, -(-(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // SHARD_BYTES))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)))
    for k in range(n):
        yield Index([(r[0], r[1]) for r in dealt.where(F.col("shard") == k).collect()], q, rate)


def leaks(docs: DataFrame, items: DataFrame, q: int = Q, rate: float = RATE) -> DataFrame:
    """`doc_id, item_id, start, end, edits` for each benchmark passage found in a document (code points, end exclusive)."""

    def scan(index: Index) -> DataFrame:
        def seek(batches):
            for b in batches:
                texts, ids = [t or "" for t in b.column("text").to_pylist()], b.column("doc_id").to_pylist()
                out = [(d, *hit) for d, t in zip(ids, texts) for hit in index.hits(t)]
                yield pa.record_batch([pa.array([r[i] for r in out], pa.int32() if i == 4 else pa.int64()) for i in range(5)], names=["doc_id", "item_id", "start", "end", "edits"])

        return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(seek, "doc_id long, item_id long, start long, end long, edits int")

    return reduce(DataFrame.unionAll, map(scan, shards(items, q, rate)))


def clean(docs: DataFrame, items: DataFrame, q: int = Q, rate: float = RATE) -> DataFrame:
    """The rows of `docs` that hold no benchmark passage."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def without(index: Index):
        def keep(batches):
            for b in batches:
                yield b.filter(pa.array([not index.hits(t or "") for t in b.column("text").to_pylist()], pa.bool_()))

        return keep

    for index in shards(items, q, rate):
        docs = docs.mapInArrow(without(index), fields)
    return docs


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
