"""Best-fit decreasing packing of tokenised documents into sequences, global and exact at any size.

Best-fit decreasing depends on nothing but how many pieces have each length, and there are at most `capacity` lengths.
The driver therefore plans on that histogram: open bins with equal room are runs of bin numbers, a segment tree over
room finds the tightest one that fits, and pieces of one length are placed run by run. The plan says for each length
which ranks go to which run of bins at which offset; it has no entry per document. Pieces are ranked within
their length by a range shuffle with carried counts and look their place up.

Bounds: each length splits at most one run and opens at most two, so there are at most 3 * capacity runs, whatever
the number of documents; a run of bins takes a new row only when all its bins take one more piece.

Tokenising: the tokenizer never joins across ASCII white space, so each worker encodes its distinct white-space separated
chunks once (it forgets them beyond `CACHE` chunks or `CACHE_BYTES`) and gathers ids from there; texts are whole. New chunks
are cut into a word and its punctuation where the tokenizer's own rules do so, and new words go to it `TOGETHER` in one text,
each followed by a mark that has an id of its own: a call per word costs more than its ids.

Nulls and empty texts have the closing id alone. A null doc_id is kept; repeated rows are documents of their own. An
empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import string
import zlib
from collections import deque
from collections.abc import Iterable
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged, table, tiles, width

CAPACITY, END, CACHE, CACHE_BYTES = 4096, 1, 1_000_000, 128 << 20
MARK, TOGETHER = "\x01", 100
JOIN = f" {MARK} ".encode()
SUFFIX, PUNCTUATION = "</w>", string.punctuation.encode()
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Encoder:
    """Ids of white-space separated chunks, each encoded once."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok = Tokenizer.from_file(path)
        mark = self.tok.encode(MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        self.parted = parts_words(json.loads(self.tok.to_str()))
        if self.parted:  # words of a to z need none of the tokenizer's rules but its merges, and the last id of each tells its end
            self.plain = Tokenizer(self.tok.model)
            self.plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
            vocab = self.tok.get_vocab()
            self.last = np.zeros(max(vocab.values()) + 1, bool)
            self.last[[i for t, i in vocab.items() if t.endswith(SUFFIX)]] = True
        self.clear()

    def clear(self) -> None:
        self.chunks, self.parts, self.held = _Table(), _Table(), 0

    def ids(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and where each text's begin (and the last ends)."""
        if len(self.chunks.codes) > CACHE or self.held > CACHE_BYTES:
            self.clear()
        split = [t.split() for t in texts]
        counts = [len(s) for s in split]
        codes = self.chunks.codes_of(chain.from_iterable(split), sum(counts))
        if new := self.chunks.codes.new:
            parts = self.parts.codes_of(chain.from_iterable(map(self.part, new)), 2 * len(new))
            if fresh := self.parts.codes.new:
                self.parts.add(*self.encode(fresh))
            flat, ends = self.parts.gather(parts)
            self.held += sum(map(len, new)) + flat.nbytes
            self.chunks.add(flat, np.diff(ends[::2]))
        flat, ends = self.chunks.gather(codes)
        return flat, ends[np.concatenate(([0], np.cumsum(counts)))]

    def part(self, chunk: bytes) -> tuple[bytes, bytes]:
        """A chunk's word and the ASCII punctuation after it, which the tokenizer never joins."""
        if not self.parted:
            return chunk, b""
        if chunk.isalpha():
            return chunk.lower(), b""
        word = chunk.rstrip(PUNCTUATION)
        if not word[-1:].isalnum() or b"<|" in chunk:  # special tokens are sought in the text as it is
            return chunk, b""
        return word.lower() if word.isascii() else word, chunk[len(word) :]

    def encode(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the parts end to end and the number of each."""
        letters = np.fromiter(map(bytes.isalpha, parts), bool, len(parts)) & self.parted
        order = np.argsort(~letters, kind="stable")
        n, ranked, done = int(letters.sum()), [parts[i] for i in order.tolist()], _Table()
        got = [self.encode_words(ranked[i : min(i + TOGETHER, n)]) for i in range(0, n, TOGETHER)]
        got += [self.encode_marked(ranked[i : i + TOGETHER]) for i in range(n, len(ranked), TOGETHER)]
        done.add(*(np.concatenate(x) for x in zip(*got)))
        flat, ends = done.gather(np.argsort(order))
        return flat, np.diff(ends)

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The same for words of the letters a to z."""
        ids = np.array(self.plain.encode_batch_fast([b" ".join(words).decode()], add_special_tokens=False)[0].ids, np.uint32)
        at = np.flatnonzero(self.last[ids])
        return (ids, np.diff(at, prepend=-1)) if len(at) == len(words) else self.encode_marked(words)

    def encode_marked(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The same from one text with the mark after every part; each alone where one holds the mark's id itself."""
        if self.mark is not None:
            text = b"".join([p + JOIN for p in parts]).decode()
            ids = np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            at = np.flatnonzero(ids == self.mark)
            if len(at) == len(parts):
                return np.delete(ids, at), np.diff(at, prepend=-1) - 1
        got = [e.ids for e in self.tok.encode_batch_fast([p.decode() for p in parts], add_special_tokens=False)]
        size = np.array([len(g) for g in got], np.int64)
        return np.fromiter(chain.from_iterable(got), np.uint32, int(size.sum())), size


def parts_words(spec: dict) -> bool:
    """Whether a tokenizer lower-cases and cuts between letters or digits and punctuation, as `word_bpe_49k.json` does."""
    norm, pre = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
    first = (pre.get("pretokenizers") or [{}])[0]
    model = spec.get("model", {})
    return (
        (model.get("type"), model.get("end_of_word_suffix"), model.get("dropout"), model.get("continuing_subword_prefix") or "") == ("BPE", SUFFIX, None, "")
        and [n["type"] for n in norm.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"] and norm["normalizers"][1]["pattern"] == {"Regex": r"\s+"}
        and (first.get("type"), first.get("behavior"), first.get("invert")) == ("Split", "Removed", True) and first["pattern"] == {"Regex": WORDS}
        and all("<|" in t["content"] for t in spec.get("added_tokens", []))
    )


class _Table:
    """Codes of byte strings, and the ids of each code."""

    def __init__(self):
        self.codes = _Codes()
        self.flat, self.off = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def codes_of(self, strings: Iterable[bytes], n: int) -> np.ndarray:
        return np.fromiter(map(self.codes.__getitem__, strings), np.int64, n)

    def add(self, flat: np.ndarray, size: np.ndarray) -> None:
        """The ids of all new strings."""
        self.flat = np.concatenate([self.flat, flat])
        self.off = np.concatenate([self.off, self.off[-1] + np.cumsum(size)])
        self.codes.new.clear()

    def gather(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the codes end to end, and where each code's begin (and the last ends)."""
        start = self.off[codes]
        size = self.off[codes + 1] - start
        ends = np.concatenate(([0], np.cumsum(size)))
        at = np.repeat(start - ends[:-1], size) + np.arange(ends[-1])
        return self.flat[at], ends


class _Codes(dict):
    def __init__(self):
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


#: One per tokenizer file and Python worker; a worker serves many tasks.
_ENCODERS: dict[str, Encoder] = {}


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """One row per piece of at most `capacity` ids: `doc_id, piece, start, length, ids_crc32`."""

    def cut(batches):
        enc = _ENCODERS.get(path) or _ENCODERS.setdefault(path, Encoder(path))
        for b in batches:
            texts = [(t or "").encode() for t in b.column("text").to_pylist()]
            docids = b.column("doc_id").to_pylist()
            off = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
            for i, j in tiles(off):
                ids, at = enc.ids(texts[i:j])
                out: list[list] = [[], [], [], [], []]
                for d in range(j - i):
                    own = np.append(ids[at[d] : at[d + 1]], end).astype("<u4")
                    for p, s in enumerate(range(0, len(own), capacity)):
                        part = own[s : s + capacity]
                        for col, v in zip(out, (docids[i + d], p, s, len(part), zlib.crc32(part.tobytes()))):
                            col.append(v)
                yield pa.record_batch([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), *(pa.array(c, pa.int64()) for c in out[2:])], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PIECES)


class RoomTree:
    """Segment tree over room left: the least room of at least `need` that some open bin has."""

    def __init__(self, capacity: int):
        self.n = 1 << capacity.bit_length()
        self.any = [False] * (2 * self.n)

    def put(self, room: int, there: bool) -> None:
        i = room + self.n
        self.any[i] = there
        while i > 1:
            i //= 2
            self.any[i] = self.any[2 * i] or self.any[2 * i + 1]

    def tightest(self, need: int) -> int | None:
        i = need + self.n
        if self.any[i]:
            return need
        while i > 1:  # climb to the first non-empty subtree on the right, then go down to its left end
            if i % 2 == 0 and self.any[i + 1]:
                i += 1
                while i < self.n:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.n
            i //= 2
        return None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Rows `length, first rank, pieces, first bin, offset`, sorted: where best-fit decreasing puts pieces of each length."""
    tree, open_, rows, bins = RoomTree(capacity), [deque() for _ in range(capacity + 1)], [], 0

    def add(room: int, first: int, n: int) -> None:
        if n and room:
            if open_[room] and sum(open_[room][-1]) == first:
                open_[room][-1] = (open_[room][-1][0], open_[room][-1][1] + n)
            else:
                open_[room].append((first, n))
            tree.put(room, True)

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                room, first, n = capacity, bins, -(-left // (capacity // length))
                bins += n
            else:
                first, n = open_[room].popleft()
                if not open_[room]:
                    tree.put(room, False)
            each = room // length  # a bin that has taken one is the tightest again while another fits
            full = min(n, left // each)
            for k in range(each if full else 0):
                rows.append((length, rank, full, first, capacity - room + k * length))
                rank += full
            left -= full * each
            add(room - each * length, first, full)
            if full < n:
                some = min(left, each)
                for k in range(some):
                    rows.append((length, rank, 1, first + full, capacity - room + k * length))
                    rank += 1
                left -= some
                add(room - some * length, first + full, 1 if some else 0)
                add(room, first + full + (1 if some else 0), n - full - (1 if some else 0))
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """The rows of `pieces` with `sequence_id` and `offset`."""
    spark = docs.sparkSession
    cut = staged(pieces(docs, path, capacity, end)).withColumn("row", F.monotonically_increasing_id())

    def number(batches):
        """Rank among the pieces of one length within this partition."""
        last, n, part = -1, 0, TaskContext.get().partitionId()
        for b in batches:
            length = b.column("length").to_numpy()
            first = np.flatnonzero(np.concatenate(([True], length[1:] != length[:-1]))) if len(length) else []
            rank = np.arange(len(length))
            for i, a in enumerate(first):
                z = first[i + 1] if i + 1 < len(first) else len(length)
                if length[a] != last:
                    last, n = int(length[a]), 0
                rank[a:z] += n - a
                n += int(z - a)
            yield pa.record_batch([*b.columns[:5], pa.array(np.full(len(length), part, np.int32)), pa.array(rank.astype(np.int64))], names=[*b.schema.names[:5], "part", "rank"])

    dealt = cut.repartitionByRange(width(spark), "length", "row").sortWithinPartitions("length", "row")
    ranked = staged(dealt.select("doc_id", "piece", "start", "length", "ids_crc32").mapInArrow(number, PIECES + ", part int, rank long"))
    # a length stands in neighbouring partitions only: at most partitions + capacity rows
    counts, base = {}, {}
    for part, length, n in ranked.groupBy("part", "length").agg(F.count("*")).orderBy("part").collect():
        base[part, length] = counts.get(length, 0)
        counts[length] = base[part, length] + n
    where = plan(counts, capacity)
    keys = where[:, 0] << 48 | where[:, 1]
    starts = np.array(sorted((p << 16 | length, n) for (p, length), n in base.items()), np.int64).reshape(-1, 2)

    def place(batches):
        for b in batches:
            length, part, rank = (b.column(c).to_numpy().astype(np.int64) for c in ("length", "part", "rank"))
            rank = rank + starts[np.searchsorted(starts[:, 0], part << 16 | length), 1]
            at = np.searchsorted(keys, length << 48 | rank, "right") - 1
            seq, off = where[at, 3] + rank - where[at, 1], where[at, 4]
            yield pa.record_batch([*b.columns[:5], pa.array(seq), pa.array(off)], names=[*b.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(place, PIECES + ", sequence_id long, offset long")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path())
