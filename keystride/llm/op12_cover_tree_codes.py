"""Product codes of vectors: Lloyd rounds in which whole subtrees of partition-local cover trees are assigned at once.

A vector of integers floor(256 x) is cut into `PARTS` equal parts, each coded by the nearest of `ENTRIES` codebook entries.
Every partition builds, per block of `BLOCK` vectors and per part, a cover tree in its simplified form (Izbicki and Shelton
2015: a node is its own first child, children lie within the node's scale of it and further than half of it from each
other); scales at which a node has itself as only child are left out. Points are kept in tree order, so a subtree is a range and
its sum a difference of cumulative sums. Trees are written once and read in each round: a node whose nearest entry is
nearer than any other by more than twice its radius hands over its whole subtree; other nodes descend, and only
points of ambiguous leaves are compared with the entries. Distances are exact integers, and ties go to the lower index.

What leaves the partitions are sums per entry; the driver holds the codebooks alone, ENTRIES * dimensions integers.

Vectors that are null, empty, or hold null or non-finite components take no part, nor do those of another length than the
vector of the smallest kept vec_id. A length that does not divide by PARTS, or components too large for exact 64-bit distances
(over about 2 ** 27 for 64 dimensions), raise an error. A null vec_id gives no first entry but is coded. Ids that repeat are rows of
their own; among the first entries they follow the order of their vectors. With fewer than `ENTRIES` rows there are fewer entries. Equal labels share
`label_error`, nulls together. Empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import buffers, staged, table

SCALE, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2
BLOCK, LEAF = 8192, 8
_NODE = ("centre", "lo", "hi", "first", "last")


def integers(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """`vec_id, label, v`: the vectors that take part."""
    fine = F.size("embedding") > 0
    fine &= F.forall("embedding", lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < float("inf")))
    kept = rows.where(F.col("embedding").isNotNull() & fine)
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.transform("embedding", lambda e: F.floor(e.cast("double") * scale)).alias("v"))


class Trees:
    """Cover trees of the parts of one block: nodes in breadth-first order, points of a subtree next to each other."""

    def __init__(self, points: np.ndarray, order: np.ndarray, nodes: dict[str, np.ndarray], radius: np.ndarray, parts: int):
        self.points, self.order, self.nodes, self.radius, self.parts = points, order, nodes, radius, parts
        self.size = len(points) // parts

    @classmethod
    def build(cls, v: np.ndarray, parts: int) -> Trees:
        """Trees over the rows of `v` (integers), level by level for all parts and nodes at once."""
        n, dims = v.shape
        x = np.ascontiguousarray(v.reshape(n, parts, dims // parts).transpose(1, 0, 2)).reshape(n * parts, dims // parts)
        xf, order = x.astype(np.float64), np.arange(n * parts)
        away = np.sqrt(((xf - np.repeat(xf[::n], n, axis=0)) ** 2).sum(1))  # distance to the centre of the point's node, by point
        level = {"centre": np.arange(parts) * n, "lo": np.arange(parts) * n, "hi": np.arange(1, parts + 1) * n}
        radius, rows, radii, total = away.reshape(parts, n).max(1), [], [], 0
        while len(radius):
            count = len(radius)
            open_ = np.flatnonzero((radius > 0) & (level["hi"] - level["lo"] > LEAF))
            size = (level["hi"] - level["lo"])[open_]
            at = np.repeat(level["lo"][open_] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            gid = np.repeat(np.arange(len(open_)), size)
            half = np.exp2(np.ceil(np.log2(radius[open_])) - 1)
            point, child, born = order[at], np.zeros(len(at), np.int64), []
            left, centre, groups = np.arange(len(at)), level["centre"][open_], np.arange(len(open_))
            while len(left):
                # the next child of each group that has points left; those within its reach join it
                number = len(born)
                own = np.full(len(open_), -1, np.int64)
                own[groups] = centre
                born.append(own)
                d = away[point[left]] if not number else np.sqrt(((xf[point[left]] - xf[own[gid[left]]]) ** 2).sum(1))
                near = d <= half[gid[left]]
                child[left[near]] = number
                away[point[left[near]]] = d[near]
                left = left[~near]
                new = np.diff(gid[left], prepend=-1) != 0
                groups, centre = gid[left[new]], point[left[new]]
            key = gid * max(1, len(born)) + child
            by = np.argsort(key, kind="stable")
            key, order[at] = key[by], point[by]
            start = np.flatnonzero(np.diff(key, prepend=-1))
            parent = key[start] // max(1, len(born))
            first = np.zeros(count, np.int64)
            last = np.zeros(count, np.int64)
            kids = np.bincount(parent, minlength=len(open_))
            last[open_] = total + count + np.cumsum(kids)
            first[open_] = last[open_] - kids
            rows.append({**level, "first": first, "last": last})
            radii.append(radius)
            total += count
            made = np.stack(born)[key[start] % max(1, len(born)), parent] if len(start) else np.zeros(0, np.int64)
            level = {"centre": made, "lo": at[start], "hi": at[start] + np.diff(np.append(start, len(at)))}
            radius = np.maximum.reduceat(away[order[at]], start) if len(start) else np.zeros(0)
        nodes = {k: np.concatenate([r[k] for r in rows]) for k in _NODE}
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        nodes["centre"] = place[nodes["centre"]]
        return cls(x[order], order % n, nodes, np.concatenate(radii), parts)

    def assign(self, books: np.ndarray):
        """Ranges of points in tree order and the entry nearest to all of a range: `lo, hi, entry`."""
        lo, hi, entry = [], [], []
        front = np.arange(self.parts)
        while len(front):
            near, ahead = nearest(self.points[self.nodes["centre"][front]], self.nodes["lo"][front] // self.size, books)
            r = self.radius[front]
            whole = (r == 0) | (ahead > 2 * r * (1 + 1e-9) + 1e-6)
            done, rest = front[whole], front[~whole]
            lo.append(self.nodes["lo"][done])
            hi.append(self.nodes["hi"][done])
            entry.append(near[whole])
            kids = (self.nodes["last"] - self.nodes["first"])[rest]
            leaf, inner, size = rest[kids == 0], rest[kids > 0], kids[kids > 0]
            span = (self.nodes["hi"] - self.nodes["lo"])[leaf]
            at = np.repeat(self.nodes["lo"][leaf] - (np.cumsum(span) - span), span) + np.arange(span.sum())
            lo.append(at)
            hi.append(at + 1)
            entry.append(nearest(self.points[at], at // self.size, books)[0])
            front = np.repeat(self.nodes["first"][inner] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return np.concatenate(lo), np.concatenate(hi), np.concatenate(entry)

    def sums(self, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and component sums handed to each entry of each part."""
        lo, hi, entry = self.assign(books)
        at = (lo // self.size) * books.shape[1] + entry
        run = np.zeros((len(self.points) + 1, self.points.shape[1]), np.int64)
        np.cumsum(self.points, axis=0, out=run[1:])
        n, total = np.zeros(self.parts * books.shape[1], np.int64), np.zeros((self.parts * books.shape[1], self.points.shape[1]), np.int64)
        np.add.at(n, at, hi - lo)
        np.add.at(total, at, run[hi] - run[lo])
        return n, total

    def codes(self, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry of each part of each row, and its squared distance."""
        lo, hi, entry = self.assign(books)
        by = np.argsort(lo, kind="stable")
        flat = np.repeat(entry[by], (hi - lo)[by])
        part = np.repeat(np.arange(self.parts), self.size)
        code, far = np.empty((self.size, self.parts), np.uint8), np.empty((self.size, self.parts), np.int64)
        code[self.order, part] = flat
        far[self.order, part] = ((self.points - books[part, flat]) ** 2).sum(1)
        return code, far

    def row(self) -> dict[str, bytes]:
        """The trees as buffers, points in the narrowest type that holds them."""
        narrow = next(t for t in ("<i2", "<i4", "<i8") if not len(self.points) or np.abs(self.points).max() <= np.iinfo(t).max)
        ints = {k: self.nodes[k].astype("<i4").tobytes() for k in _NODE}
        return {"points": narrow.encode() + self.points.astype(narrow).tobytes(), "row_of": self.order.astype("<i4").tobytes(), "radius": self.radius.tobytes(), **ints}

    @classmethod
    def read(cls, row: dict[str, bytes], parts: int, dims: int) -> Trees:
        points = np.frombuffer(row["points"][3:], row["points"][:3].decode()).astype(np.int64).reshape(-1, dims // parts)
        nodes = {k: np.frombuffer(row[k], "<i4").astype(np.int64) for k in _NODE}
        return cls(points, np.frombuffer(row["row_of"], "<i4").astype(np.int64), nodes, np.frombuffer(row["radius"], np.float64), parts)


def nearest(x: np.ndarray, part: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry (ties: lower), and by how much any other lies further away (infinite, if none)."""
    best, ahead = np.zeros(len(x), np.int64), np.full(len(x), np.inf)
    by = np.argsort(part, kind="stable")
    bound = np.searchsorted(part[by], np.arange(len(books) + 1))
    for p, book in enumerate(books):
        # entries that repeat an earlier one are never nearest
        kept = np.sort(np.unique(book, axis=0, return_index=True)[1])
        for a in range(bound[p], bound[p + 1], 1 << 16):
            at = by[a : min(a + (1 << 16), bound[p + 1])]
            d = squared(x[at], book[kept])
            i = d.argmin(1)
            best[at] = kept[i]
            if len(kept) > 1:
                low = d[np.arange(len(at)), i].astype(np.float64)
                d[np.arange(len(at)), i] = d.max()
                ahead[at] = np.sqrt(d.min(1).astype(np.float64)) - np.sqrt(low)
    return best, ahead


def squared(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Exact squared distances: by matrix product where doubles hold every term, by differences elsewhere."""
    top = float(max(np.abs(x).max(initial=0), np.abs(book).max(initial=0)))
    if 4 * top * top * x.shape[1] < 2.0**53:
        xf, bf = x.astype(np.float64), book.astype(np.float64)
        return (xf * xf).sum(1)[:, None] - 2 * (xf @ bf.T) + (bf * bf).sum(1)
    return np.stack([((x - e) ** 2).sum(1) for e in book], 1)


_TREE = ("points", "row_of", "radius", *_NODE)


def build(vectors: DataFrame, dims: int, parts: int = PARTS) -> DataFrame:
    """One row per block: ids, labels and the trees of its parts, written to the shared folder."""

    def grow(batches):
        ids, labels, rows, held = [], [], [], 0

        def block():
            v = np.concatenate(rows)
            if len(v) and 4 * float(np.abs(v).max()) ** 2 * dims >= 2.0**62:
                raise ValueError("components too large for exact 64-bit distances")
            tree = Trees.build(v, parts).row()
            return pa.record_batch(
                [pa.array([sum(ids, [])], pa.list_(pa.int64())), pa.array([sum(labels, [])], pa.list_(pa.string())), *(pa.array([tree[k]], pa.binary()) for k in _TREE)], names=["ids", "labels", *_TREE]
            )

        for b in batches:
            flat = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            i = 0
            while i < b.num_rows:
                take = min(BLOCK - held, b.num_rows - i)
                ids.append(b.column("vec_id").slice(i, take).to_pylist())
                labels.append(b.column("label").slice(i, take).to_pylist())
                rows.append(flat[i : i + take])
                held, i = held + take, i + take
                if held == BLOCK:
                    yield block()
                    ids, labels, rows, held = [], [], [], 0
        if held:
            yield block()

    return staged(vectors.select("vec_id", "label", "v").mapInArrow(grow, "ids array<long>, labels array<string>, " + ", ".join(f"{k} binary" for k in _TREE)))


def _trees(batch: pa.RecordBatch, parts: int, dims: int):
    for i in range(batch.num_rows):
        yield Trees.read({k: batch.column(k)[i].as_py() for k in _TREE}, parts, dims)


def improve(trees: DataFrame, books: np.ndarray) -> np.ndarray:
    """One Lloyd round: entries become the floored means of their parts; unused ones stay."""
    parts, entries, width = books.shape
    dims = parts * width

    def add(batches):
        n, total = np.zeros(parts * entries, np.int64), np.zeros((parts * entries, width), np.int64)
        for b in batches:
            for t in _trees(b, parts, dims):
                more, summed = t.sums(books)
                n, total = n + more, total + summed
        used = np.flatnonzero(n)
        yield pa.record_batch([pa.array(used.astype(np.int32)), pa.array(n[used]), pa.array(total[used].tolist(), pa.list_(pa.int64()))], names=["entry", "n", "total"])

    got = trees.select(*_TREE).mapInArrow(add, "entry int, n long, total array<long>")
    exact = [F.sum(F.col("total")[j].cast("decimal(38,0)")).alias(f"s{j}") for j in range(width)]
    new = books.reshape(parts * entries, width).copy()
    for r in got.groupBy("entry").agg(F.sum("n").alias("n"), *exact).collect():  # at most parts * entries rows
        new[r["entry"]] = [int(r[f"s{j}"]) // r["n"] for j in range(width)]
    return new.reshape(books.shape)


def first_books(vectors: DataFrame, dims: int, entries: int = ENTRIES, parts: int = PARTS) -> np.ndarray:
    """The parts of the vectors with the smallest ids, in their order."""
    rows = vectors.where(F.col("vec_id").isNotNull() & (F.size("v") == dims)).orderBy("vec_id", "v").limit(entries).select("v").collect()
    v = np.array([r[0] for r in rows], np.int64).reshape(-1, dims)
    return v.reshape(len(v), parts, dims // parts).transpose(1, 0, 2)


def encode(rows: DataFrame, entries: int = ENTRIES, parts: int = PARTS, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """`vec_id, label, code, error` of every vector (`vec_id, embedding, label`), and the codebooks [part, entry, component]."""
    if not 0 < entries <= 256:
        raise ValueError("an entry's index takes two hex digits: 1 to 256 entries")
    vectors = integers(rows)
    spark = rows.sparkSession
    head = vectors.where("vec_id is not null").orderBy("vec_id", "v").limit(1).collect() or vectors.limit(1).collect()
    schema = "vec_id long, label string, code string, error long"
    if not head:
        return spark.createDataFrame([], schema), np.zeros((parts, 0, 0), np.int64)
    dims = len(head[0]["v"])
    if dims % parts:
        raise ValueError(f"vectors of {dims} components cannot be cut into {parts} equal parts")
    books = first_books(vectors, dims, entries, parts)
    if not books.shape[1]:
        books = np.array(head[0]["v"], np.int64).reshape(parts, 1, dims // parts)  # no row has an id
    trees = build(vectors.where(F.size("v") == dims), dims, parts)
    for _ in range(rounds):
        books = improve(trees, books)

    def code(batches):
        for b in batches:
            for t, ids, labels in zip(_trees(b, parts, dims), b.column("ids"), b.column("labels")):
                c, far = t.codes(books)
                text = [r.tobytes().hex() for r in c]
                yield pa.record_batch([ids.values, labels.values, pa.array(text, pa.string()), pa.array(far.sum(1))], names=["vec_id", "label", "code", "error"])

    return trees.mapInArrow(code, schema), books


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components by part, entry and position."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = encode(table(spark, sf_dir, "embeddings"))
    coded = staged(coded)
    by_label = coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    rows = coded.join(by_label, F.col("label").eqNullSafe(F.col("_label")))
    return rows.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
