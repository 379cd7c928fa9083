"""Two tokenizers' tokens aligned by interval coalescing, and how often the corpus links their ids.

Tokens of A and B lie as byte intervals over one blank and the text. All intervals of a tile of documents are lexsorted by
start, the running maximum of their ends is accumulated, and a group breaks where a start reaches that maximum. Within a
group, tokens whose ranges overlap are links: for each A token the run of B tokens from the one its start falls into to the one its
last byte falls into.

Counts of linked ids over the corpus need each document's ids only by block: a block (`BLOCK_BYTES` of text) knows its distinct
pairs; these are summed over all blocks, and the sums go back to the blocks that hold the pair, where documents look theirs up.
No row per link leaves a task, a frequent pair has one row per block, and a block's look-ups are bounded by its text.
The best count of each B id is a table of at most the vocabulary's size.

Tokenising: neither tokenizer joins across a blank that follows other than white space, so texts are cut there, and a worker
encodes each of its distinct short chunks once (it forgets them beyond `CACHE_BYTES`); texts are whole.

Null and empty texts, and texts whose A or B tokens do not spell one blank and the text, have no tokens: zeros and an empty digest.
Rows that repeat are documents of their own and count each. A null doc_id is kept. An empty table gives no rows. Extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
import os
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged, table, tiles

TILE, BLOCK_BYTES = 1 << 20, 16 << 20
CACHE_BYTES, CHUNK = 64 << 20, 48
#: A blank after other than white space and before more text; both tokenizers start anew there.
_CUT = re.compile(r"(?<=\S)(?= .)", re.DOTALL)


def byte_of_symbol() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others as the symbols from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteLevel:
    """Ids and byte strings of a byte-level vocabulary; `encode` takes texts that begin with their own blank."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        byte = byte_of_symbol()
        size = self.tok.get_vocab_size()
        self.words = [bytes(byte[c] for c in w) if w is not None and all(c in byte for c in w) else b"" for w in map(self.tok.id_to_token, range(size))]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]


class Pieces:
    """Ids and byte strings of a sentence-piece vocabulary, which puts the leading blank itself."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.tok = SentencePieceProcessor(model_file=path)
        names = [self.tok.id_to_piece(i) for i in range(self.tok.get_piece_size())]
        hexed = re.compile(r"<0x([0-9A-F]{2})>")
        self.words = [bytes([int(m[1], 16)]) if (m := hexed.fullmatch(p)) else p.replace("▁", " ").encode() for p in names]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.tok.encode([t[1:] for t in texts], num_threads=1)


class _Memo(dict):
    """Numbers of chunks; new ones are listed. Long chunks get a number each time and are not kept."""

    def __init__(self):
        self.new: list[str] = []
        self.n = self.held = 0

    def __missing__(self, chunk: str) -> int:
        n, self.n = self.n, self.n + 1
        if len(chunk) <= CHUNK:
            self[chunk] = n
        self.held += len(chunk)
        self.new.append(chunk)
        return n


class Encoder:
    """Ids of both tokenizers for whole texts, each distinct chunk encoded once."""

    def __init__(self, path_a: str, path_b: str):
        self.sides = [ByteLevel(path_a), Pieces(path_b)]
        self.length = [np.array([len(w) for w in s.words], np.int64) for s in self.sides]
        self.names = [[str(i) for i in range(len(s.words))] for s in self.sides]
        self.clear()

    def clear(self) -> None:
        self.memo = _Memo()
        self.flat = [np.zeros(0, np.int32) for _ in self.sides]
        self.off = [np.zeros(1, np.int64) for _ in self.sides]
        self.good = np.zeros(0, bool)

    def ids(self, texts: list[str]):
        """For each side ids end to end and where each text's begin (and the last ends); texts that do not spell out have none."""
        if self.memo.held > CACHE_BYTES:
            self.clear()
        chunks = [_CUT.split(" " + t) if t else [] for t in texts]
        size = np.array([len(c) for c in chunks], np.int64)
        code = np.fromiter((n for c in chunks for n in map(self.memo.__getitem__, c)), np.int64, int(size.sum()))
        if new := self.memo.new:
            good = np.ones(len(new), bool)
            for s, side in enumerate(self.sides):
                got = side.encode(new)
                words = side.words
                good &= np.fromiter((b"".join([words[i] for i in g]) == t.encode() for g, t in zip(got, new)), bool, len(new))
                n = np.cumsum([len(g) for g in got])
                self.flat[s] = np.concatenate([self.flat[s], np.fromiter((i for g in got for i in g), np.int32, int(n[-1]))])
                self.off[s] = np.concatenate([self.off[s], self.off[s][-1] + n])
            self.good = np.concatenate([self.good, good])
            new.clear()
        text = np.repeat(np.arange(len(texts)), size)
        bad = np.bincount(text[~self.good[code]], minlength=len(texts)) > 0
        code, text = code[~bad[text]], text[~bad[text]]
        out = []
        for flat, off in zip(self.flat, self.off):
            n = off[code + 1] - off[code]
            end = np.cumsum(n)
            at = np.repeat(off[code] - (end - n), n) + np.arange(end[-1] if len(end) else 0)
            per = np.bincount(text, n, len(texts)).astype(np.int64)
            out.append((flat[at], np.concatenate(([0], np.cumsum(per)))))
        return out


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def coalesce(len_a: np.ndarray, len_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Groups of two tilings of the same bytes, given token lengths: group of each A and each B token, and the links.

    Links are index pairs (A token, B token) whose ranges overlap, in order of A, then B.
    """
    end_a, end_b = np.cumsum(len_a), np.cumsum(len_b)
    start = np.concatenate([end_a - len_a, end_b - len_b])
    end = np.concatenate([end_a, end_b])
    by = np.lexsort((end, start))
    reach = np.maximum.accumulate(end[by])
    breaks = np.ones(len(by), bool)
    breaks[1:] = start[by][1:] >= reach[:-1]
    group = np.empty(len(by), np.int64)
    group[by] = np.cumsum(breaks) - 1
    # B tokens that an A token overlaps follow each other
    low = np.searchsorted(end_b, end_a - len_a, "right")
    high = np.searchsorted(end_b - len_b, end_a, "left")
    n = high - low
    a = np.repeat(np.arange(len(len_a)), n)
    b = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
    return group[: len(len_a)], group[len(len_a) :], a, b


def written(ids: list[np.ndarray], group: list[np.ndarray], names: list[list[str]]) -> tuple[list[str], np.ndarray]:
    """Ids group by group (A's, then B's), each after the mark that sets it off from the one before it; and their groups."""
    side = np.repeat([0, 1], [len(ids[0]), len(ids[1])])
    g = np.concatenate(group)
    by = np.lexsort((side, g))
    g, side, flat = g[by], side[by], np.concatenate(ids)[by]
    mark = np.where(np.diff(g, prepend=-1) != 0, 2, np.where(np.diff(side, prepend=0) != 0, 1, 0))
    marked = [[m + n for n in own] for m in ",|;" for own in names]  # six tables: mark by side
    text = [""] * len(flat)
    for t, own in enumerate(marked):
        at = np.flatnonzero(mark * 2 + side == t)
        for i, x in zip(at.tolist(), flat[at].tolist()):
            text[i] = own[x]
    return text, g


_ROW = "doc_id long, block long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<int>, times array<int>, block_pairs array<int>, block_times array<long>"


def aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """One row per document with its groups and distinct linked id pairs (`pairs`: a * size of B's vocabulary + b), and one
    row per block (`block_pairs` not null) with the pairs of all its documents.

    Pairs fit 31 bits, as the vocabularies' sizes multiply to less.
    """

    def run(batches):
        key = (path_a, path_b)
        enc = _ENCODERS.get(key) or _ENCODERS.setdefault(key, Encoder(path_a, path_b))
        kinds_b = len(enc.sides[1].words)
        if len(enc.sides[0].words) * kinds_b >= 2**31:
            raise ValueError("vocabularies too large for 31-bit pairs")
        block, held, sums = TaskContext.get().partitionId() << 32, 0, []

        def closing():
            pair, times = summed(sums)
            none = pa.array([None], pa.int64())
            lists = [pa.array([None], pa.list_(pa.int32()))] * 2 + [pa.array([pair], pa.list_(pa.int32())), pa.array([times], pa.list_(pa.int64()))]
            return pa.record_batch([none, pa.array([block], pa.int64()), none, none, none, none, pa.array([None], pa.string()), *lists], names=NAMES)

        for b in batches:
            texts, ids = b.column("text").to_pylist(), b.column("doc_id").to_pylist()
            off = np.concatenate(([0], np.cumsum([len(t or "") for t in texts])))
            for i, j in tiles(off, TILE):
                rows, pair, times = _tile(enc, [t or "" for t in texts[i:j]], kinds_b)
                sums.append((pair, times))
                if len(sums) >= 8:
                    sums[:] = [summed(sums)]
                n = j - i
                yield pa.record_batch([pa.array(ids[i:j], pa.int64()), pa.array(np.full(n, block)), *rows, pa.nulls(n, pa.list_(pa.int32())), pa.nulls(n, pa.list_(pa.int64()))], names=NAMES)
                held += int(off[j] - off[i])
                if held >= BLOCK_BYTES:
                    yield closing()
                    block, held, sums = block + 1, 0, []
        if sums:
            yield closing()

    NAMES = [f.split()[0] for f in _ROW.split(", ")]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _ROW)


def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs of all parts and their summed counts."""
    pair, times = (np.concatenate([p[x] for p in parts]) for x in (0, 1))
    by = np.argsort(pair, kind="stable")
    pair, times = pair[by], times[by]
    first = np.flatnonzero(np.diff(pair, prepend=-1))
    return pair[first], np.add.reduceat(times, first) if len(first) else times


def _tile(enc: Encoder, texts: list[str], kinds_b: int):
    """Columns of one tile's documents from `n_a` to `times`, and the tile's pairs with their counts."""
    (ids_a, at_a), (ids_b, at_b) = enc.ids(texts)
    n = len(texts)
    group_a, group_b, a, b = coalesce(enc.length[0][ids_a], enc.length[1][ids_b])
    doc_a = np.repeat(np.arange(n), np.diff(at_a))
    text, g = written([ids_a, ids_b], [group_a, group_b], enc.names)
    first = np.flatnonzero(np.diff(group_a, prepend=-1))
    groups = np.bincount(doc_a[first], minlength=n)
    links = np.bincount(doc_a[a], minlength=n)
    # the documents' tokens follow each other in `text` too
    ends = (at_a + at_b).tolist()
    digest = [hashlib.sha256("".join(text[x:y])[1:].encode()).hexdigest() if y > x else "" for x, y in zip(ends, ends[1:])]
    pair = ids_a[a].astype(np.int64) * kinds_b + ids_b[b]
    by = np.lexsort((pair, doc_a[a]))
    key = np.stack([doc_a[a][by], pair[by]])
    new = np.ones(len(by), bool)
    new[1:] = (key[:, 1:] != key[:, :-1]).any(0)
    first = np.flatnonzero(new)
    times = np.diff(np.append(first, len(by)))
    per = np.concatenate(([0], np.cumsum(np.bincount(key[0][first], minlength=n)))).astype(np.int32)
    lists = [pa.ListArray.from_arrays(pa.array(per), pa.array(v.astype(np.int32))) for v in (key[1][first], times)]
    counts = [pa.array(c.astype(np.int64)) for c in (np.diff(at_a), np.diff(at_b), groups, links)]
    return [*counts, pa.array(digest, pa.string()), *lists], *summed([(key[1][first], times.astype(np.int64))])


def align(docs: DataFrame, path_a: str, path_b: str) -> tuple[DataFrame, DataFrame]:
    """Documents (`doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`) and the table of links
    (`pair, n, best`: count over the corpus, and whether it is its B id's highest)."""
    kinds_b = len(Pieces(path_b).words)
    rows = staged(aligned(docs, path_a, path_b))
    pairs = rows.where("block_pairs is not null").select("block", F.explode(F.arrays_zip("block_pairs", "block_times")).alias("p")).select("block", F.col("p.block_pairs").alias("pair"), F.col("p.block_times").alias("n"))
    totals = pairs.groupBy("pair").agg(F.sum("n").alias("n"))
    top = totals.groupBy((F.col("pair") % kinds_b).alias("b")).agg(F.max("n").alias("top"))
    links = staged(totals.join(top, F.col("pair") % kinds_b == F.col("b")).select("pair", "n", (F.col("n") == F.col("top")).alias("best")))
    back = pairs.select(F.col("block").alias("of"), "pair").join(links, "pair")
    found = rows.where("block_pairs is null").groupBy("block").cogroup(back.groupBy("of")).applyInArrow(_look_up, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
    return found, links


def _look_up(docs: pa.Table, counts: pa.Table) -> pa.Table:
    """Sums over each document's links of what the corpus counts for their pairs; the group is one block."""
    docs = docs.combine_chunks()
    pair = counts.column("pair").to_numpy()
    by = np.argsort(pair, kind="stable")
    pair, n, best = pair[by], counts.column("n").to_numpy()[by], counts.column("best").to_numpy()[by]
    sums: list[list[int]] = [[], []]
    for batch in docs.to_batches(max_chunksize=256):
        lists = batch.column("pairs")
        off = lists.offsets.to_numpy().astype(np.int64)
        off -= off[0]
        own, times = lists.flatten().to_numpy(), batch.column("times").flatten().to_numpy().astype(np.int64)
        at = np.searchsorted(pair, own)
        for out, value in zip(sums, (times * best[at], times * n[at])):
            run = np.concatenate(([0], np.cumsum(value)))
            out.extend((run[off[1:]] - run[off[:-1]]).tolist())
    cols = [docs.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
    return pa.table([*cols, pa.array(sums[0], pa.int64()), pa.array(sums[1], pa.int64()), docs.column("groups_sha256")], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])


def tokenizer_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"), *tokenizer_paths())[0]
