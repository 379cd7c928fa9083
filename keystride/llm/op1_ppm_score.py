"""Prediction by partial matching: code length of each document under a byte-context trie learned from the corpus.

The trie holds every context of up to `ORDER` bytes with the bytes that followed it in the training documents. A byte is
coded at the longest known context; a byte not seen there escapes (method C: one count per distinct successor) to the
context one byte shorter, whose counts exclude what the longer one would have coded, and at last to the bytes seen
nowhere. The text coded is the one the base score knows: lower-cased (A-Z) words with one space between them. Documents
begin in a row of 0xFE and end with 0xFF, bytes that UTF-8 never has, so the probabilities are of whole texts. The model
is fixed once counted: a document's code length depends on nothing but its own bytes.

As tables: one row per distinct string of ORDER + 1 bytes; each order is an aggregate of the next, and escapes and
exclusions are sums per context joined down from the shorter order. Nothing is broadcast or gathered: texts are dealt
into blocks, a block asks for the strings and words it holds, and gets their values back in the same sorted order.

Base score: add-one unigram probabilities of lower-cased words, whose counts travel the same way (known by 63-bit hashes).

Null text is empty: one end symbol, one end token. A null doc_id counts as an empty string for the split. Repeated rows
are documents of their own; an empty table gives no rows; without training documents every byte has 1/256. Extra
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER, SPACE, blocked, buffers, mix64, packed, small_batches, staged, table, tiles, unpacked, width, word_hashes, word_spans

ORDER, PAD, STOP = 5, 0xFE, 0xFF
#: Bytes of text of a block, whose distinct keys travel compressed, and of a tile: a tile takes some 60 bytes of memory per byte.
BLOCK, TILE = 8 << 20, 1 << 19
_END = np.int64(-1)  # the end token's key; hashes have 63 bits
_FRAG = "kind int, part int, block int, keys binary, n binary"


def remainder(mod: int) -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(mod))


def strings(buf: np.ndarray, off: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Packed strings of order + 1 bytes that end at each byte and at each end of text; and each document's first."""
    size = np.diff(off)
    docs = len(size)
    at = np.arange(docs) * (order + 1)
    text = np.full(len(buf) + docs * (order + 1), PAD, np.uint8)
    is_text = np.ones(len(text), bool)
    for k in range(order):
        is_text[off[:-1] + at + k] = False
    stop = off[1:] + at + order
    text[stop] = STOP
    is_text[stop] = False
    text[is_text] = buf
    is_text[stop] = True
    g = np.zeros(len(text) - order, np.int64)
    for k in range(order + 1):
        g <<= 8
        g |= text[k : k + len(g)]
    return g[is_text[order:]], off[:-1] + np.arange(docs)


def normal(buf: np.ndarray, off: np.ndarray, ends: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased words with one space between them, and the documents' new offsets."""
    last = np.zeros(len(ends), bool)
    last[first[1:][np.diff(first) > 0] - 1] = True
    keep, text = ~SPACE[buf], LOWER[buf]
    keep[ends[~last]] = True
    text[ends[~last]] = 32
    return text[keep], np.concatenate(([0], np.cumsum(keep)))[off]


def _counted(keys: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and how often each stands in training text."""
    codes, uniq = pd.factorize(keys)
    order = np.argsort(uniq)
    return uniq[order], np.bincount(codes[train], minlength=len(uniq))[order]


def _both(a: tuple, b: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Two sorted runs as one; equal keys are summed."""
    keys, n = np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])
    order = np.argsort(keys, kind="stable")  # merges the two runs
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(n, first) if len(keys) else n


def _push(runs: list, run: tuple) -> None:
    while runs and len(runs[-1][0]) < 2 * len(run[0]):
        run = _both(runs.pop(), run)
    runs.append(run)


def _merged(runs: list) -> tuple[np.ndarray, np.ndarray]:
    out = np.zeros(0, np.int64), np.zeros(0, np.int64)
    while runs:
        out = _both(runs.pop(), out)
    return out


class Block:
    """Distinct keys of one block of documents, sorted: words (kind 0) and byte strings (kind 1)."""

    def __init__(self, texts: pa.Table, order: int):
        self.order = order
        self.buf, self.off = buffers(texts.column("text"))
        self.train = texts.column("train").to_numpy()
        found: list[list] = [[], []]  # sorted runs of keys and counts, each at least twice as long as the next
        for i, j in tiles(self.off, TILE):
            words, doc, grams, first = self._tile(i, j)
            train = self.train[i:j]
            _push(found[0], _counted(np.append(words, np.full(j - i, _END)), np.append(train[doc], train)))
            _push(found[1], _counted(grams, np.repeat(train, np.diff(np.append(first, len(grams))))))
        merged = [_merged(runs) for runs in found]
        self.keys, self.n = [k for k, _ in merged], [n for _, n in merged]

    def _tile(self, i: int, j: int):
        b, o = self.buf[self.off[i] : self.off[j]], self.off[i : j + 1] - self.off[i]
        starts, ends, first = word_spans(b, o)
        words = (word_hashes(b, starts, ends) >> np.uint64(1)).astype(np.int64)
        return words, np.repeat(np.arange(j - i), np.diff(first)), *strings(*normal(b, o, ends, first), self.order)

    def parts(self, kind: int, n: int) -> list[np.ndarray]:
        """Positions of the keys of each part."""
        p = part_of(self.keys[kind], n)
        order = np.argsort(p, kind="stable")
        return np.split(order, np.searchsorted(p[order], np.arange(1, n)))

    def sums(self, values: list[np.ndarray], total: int, kinds: int):
        """Per document: tokens, known tokens, base score, score."""
        count, log = values
        for i, j in tiles(self.off, TILE):
            words, doc, grams, first = self._tile(i, j)
            codes, uniq = pd.factorize(words)
            c = count[np.searchsorted(self.keys[0], uniq)][codes]
            end = int(count[np.searchsorted(self.keys[0], _END)])
            n = np.bincount(doc, minlength=j - i)
            known = np.bincount(doc, weights=c > 0, minlength=j - i).astype(np.int64)
            base = np.bincount(doc, weights=np.log10((c + 1) / (total + kinds + 1)), minlength=j - i) + np.log10((end + 1) / (total + kinds + 1))
            codes, uniq = pd.factorize(grams)
            score = np.add.reduceat(log[np.searchsorted(self.keys[1], uniq)].astype(np.float64)[codes], first)
            yield n + 1, known + (end > 0), base, score


def part_of(keys: np.ndarray, n: int) -> np.ndarray:
    m = mix64(keys.astype(np.uint64) ^ np.uint64(0xA0761D6478BD642F))
    return ((m >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int32)


def _each(t: pa.Table, column: str, kind, ascending: bool = False):
    raw, off = buffers(t.column(column))
    return (unpacked(raw[a:z].tobytes(), kind, ascending) for a, z in zip(off[:-1], off[1:]))


def _same(t: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Keys of each fragment; all distinct keys and their training counts."""
    keys, n = list(_each(t, "keys", np.int64, True)), np.concatenate(list(_each(t, "n", np.int64)))
    u, at = np.unique(np.concatenate(keys), return_inverse=True)
    return keys, u, np.bincount(at, weights=n, minlength=len(u)).astype(np.int64)


def code_lengths(grams: DataFrame, order: int) -> DataFrame:
    """`gram, log`: log10 probability of each string's last byte after the bytes before it, from `gram, n`."""
    levels = [grams.select(F.col("gram").alias("key"), "n")]
    for k in range(order - 1, -1, -1):
        levels.append(staged(levels[-1].groupBy(F.col("key").bitwiseAND((1 << 8 * (k + 1)) - 1).alias("key")).agg(F.sum("n").alias("n"))))
    levels.reverse()
    t, q = levels[0].agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > 0)).first()  # of at most 256 bytes
    # g: probability of the byte below this context, once this context has been escaped from
    row = levels[0].select("key", "n", F.lit(t).cast("long").alias("t"), F.lit(q).cast("long").alias("q"), F.lit(1.0 / max(1, 256 - q)).alias("g"))
    for k in range(1, order + 1):
        up = row.select(F.col("key").alias("up"), F.col("n").alias("n0"), F.col("t").alias("t0"), F.col("q").alias("q0"), F.col("g").alias("g0"))
        own = levels[k].withColumns({"up": F.col("key").bitwiseAND((1 << 8 * k) - 1), "ctx": F.shiftright("key", 8)}).join(up, "up").drop("up")
        ctx, seen = Window.partitionBy("ctx"), F.col("n") > 0  # 256 rows at most: one for each byte
        own = own.withColumns({"t": F.sum("n").over(ctx), "q": F.count_if(seen).over(ctx), "m": F.sum(F.when(seen, F.col("n0")).otherwise(0)).over(ctx)})
        left, kinds = F.col("t0") - F.col("m"), F.col("q0") - F.col("q")
        g = F.when(left + kinds <= 0, F.col("g0")).when(F.col("n0") > 0, F.col("n0") / F.nullif(left + kinds, F.lit(0))).otherwise(kinds / F.nullif(left + kinds, F.lit(0)) * F.col("g0"))
        row = staged(own.select("key", "n", "t", "q", g.alias("g")))
    all_ = F.nullif(F.col("t") + F.col("q"), F.lit(0))
    p = F.when(F.col("t") + F.col("q") <= 0, F.col("g")).when(F.col("n") > 0, F.col("n") / all_).otherwise(F.col("q") / all_ * F.col("g"))
    return row.select(F.col("key").alias("gram"), F.log10(p).alias("log"))


def score(docs: DataFrame, order: int = ORDER, mod: int = 7, held: int = 2) -> DataFrame:
    """`doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score` for every document."""
    if not 1 <= order <= 6:
        raise ValueError("one to six bytes of context")
    spark = docs.sparkSession
    small_batches(spark)
    parts = width(spark)
    b = blocked(docs, BLOCK).withColumn("train", remainder(mod) != held)

    def ask(t: pa.Table) -> pa.Table:
        own, block, rows = Block(t, order), t.column("block")[0].as_py(), []
        for kind in (0, 1):
            for p, at in enumerate(own.parts(kind, parts)):
                if len(at):
                    rows.append((kind, p, block, packed(own.keys[kind][at], True), packed(own.n[kind][at])))
        types = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
        return pa.table([pa.array([r[i] for r in rows], y) for i, y in enumerate(types)], names=["kind", "part", "block", "keys", "n"])

    def word_counts(t: pa.Table) -> pa.Table:
        keys, u, n = _same(t)
        back = [packed(n[np.searchsorted(u, k)]) for k in keys]
        rows = t.num_rows
        return pa.table({
            "kind": pa.array([0] * (rows + 1), pa.int32()), "part": pa.array([t.column("part")[0].as_py()] * (rows + 1), pa.int32()),
            "block": pa.array([*t.column("block").to_pylist(), None], pa.int32()), "vals": pa.array([*back, None], pa.binary()),
            "tokens": pa.array([0] * rows + [int(n.sum())], pa.int64()), "kinds": pa.array([0] * rows + [int((n > 0).sum())], pa.int64()),
        })

    def gram_counts(t: pa.Table) -> pa.Table:
        _, u, n = _same(t)
        return pa.table({"part": pa.array(np.full(len(u), t.column("part")[0].as_py(), np.int32)), "gram": u, "n": n})

    def answer(frag: pa.Table, model: pa.Table) -> pa.Table:
        u, v = model.column("gram").to_numpy(), model.column("log").to_numpy()
        o = np.argsort(u)
        u, v = u[o], v[o].astype(np.float32)
        back = [packed(v[np.searchsorted(u, k)]) for k in _each(frag, "keys", np.int64, True)]
        return pa.table({"kind": frag.column("kind"), "part": frag.column("part"), "block": frag.column("block"), "vals": pa.array(back, pa.binary())})

    asked = staged(b.groupBy("block").applyInArrow(ask, _FRAG))
    words = staged(asked.where("kind = 0").groupBy("part").applyInArrow(word_counts, "kind int, part int, block int, vals binary, tokens long, kinds long"))
    total, kinds = words.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("kinds"), F.lit(0))).first()
    grams = staged(asked.where("kind = 1").groupBy("part").applyInArrow(gram_counts, "part int, gram long, n long"))
    logs = code_lengths(grams, order).join(grams.select("part", "gram"), "gram")
    replies = asked.where("kind = 1").groupBy("part").cogroup(logs.groupBy("part")).applyInArrow(answer, "kind int, part int, block int, vals binary")

    def add(texts: pa.Table, got: pa.Table) -> pa.Table:
        own = Block(texts, order)
        own.n.clear()  # only asked for, not answered
        values = [np.zeros(len(own.keys[0]), np.int64), np.zeros(len(own.keys[1]), np.float32)]
        where = [own.parts(0, parts), own.parts(1, parts)]
        raw, off = buffers(got.column("vals"))
        for r, (kind, p) in enumerate(zip(got.column("kind").to_pylist(), got.column("part").to_pylist())):
            values[kind][where[kind][p]] = unpacked(raw[off[r] : off[r + 1]].tobytes(), np.float32 if kind else np.int64)
        sums = [np.concatenate(x) for x in zip(*own.sums(values, total, kinds))] or [np.zeros(0)] * 4
        return pa.table({
            "doc_id": texts.column("doc_id"), "held_out": pa.array(~own.train), "n_tokens": pa.array(sums[0], pa.int64()), "n_known": pa.array(sums[1], pa.int64()),
            "train_tokens": pa.array(np.full(len(own.train), total, np.int64)), "base_score": pa.array(sums[2]), "score": pa.array(sums[3]),
        })

    values = words.where("block is not null").select("kind", "part", "block", "vals").union(replies)
    out = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return b.groupBy("block").cogroup(values.groupBy("block")).applyInArrow(add, out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
