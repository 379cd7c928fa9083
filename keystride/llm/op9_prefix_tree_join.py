"""Exact Jaccard join of word-shingle sets by a prefix tree, returned as connected groups.

1. *Filter.* Every document sends the lower half of its sorted shingle hashes to hash ranges; what two documents
   sent comes back. Two sets of at least 75 % overlap share a quarter of either in these halves, so a document with
   fewer shared hashes links with nothing and its set goes no further. Hashes travel by their upper 40 bits, as
   compressed differences: what two hashes have in common by chance lets a document more through and loses none.
2. *Classes.* Equal sets become one representative.
3. *Global order.* Shingles are ordered rare first; the first n - ceil(t n) + 1 of two linked sets share one.
   Representatives that share such a shingle form a neighbourhood (a superset of linked groups).
4. *Tree.* Within a neighbourhood the ordered sets are stored in a compressed prefix tree. A probe walks it level by
   level, carries the overlap of the shared path and drops subtrees whose remaining length cannot reach the
   threshold. Large neighbourhoods are first linked to their most typical member; the rest is probed in chunks of
   `CHUNK` against chunks, so no task holds a whole neighbourhood.
5. *Components* of the found links.

`jaccard_components` does not search for links that would join what is joined already: its components are exact, and most
members of a large neighbourhood meet only the lead. In `jaccard_links` every representative probes all chunks of its
neighbourhood; it counts all links of each document, and its components come from the same walk. Counts are summed by
representative and its copies before they go to documents, so no pair of documents is listed.

Nulls: null text is empty; an empty set links with nothing. Every row counts by its own text, also where an id is
repeated. Rows without an id take part; a group of only such rows has a null component. Extra columns are ignored.
Shingles and sets are known by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocked, buffers, components, mix64, packed, shingle_sets, small_batches, staged, stars, table, tiles, unpacked, width

#: Members of one prefix tree.
CHUNK = 512
#: Lower bits of a hash that the filter leaves out.
CUT = np.uint64(24)


def _each(col) -> list[np.ndarray]:
    """The hashes of each row of a column that holds them packed."""
    raw, off = buffers(col)
    return [unpacked(raw[a:z].tobytes(), np.uint64, ascending=True) for a, z in zip(off[:-1], off[1:])]


def _parts(h: np.ndarray, n: int) -> np.ndarray:
    """Range of a remixed hash: the lower halves of sets are not spread evenly over the hash itself."""
    m = mix64(h ^ np.uint64(0xA0761D6478BD642F))
    return ((m >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int32)


def _split(part: np.ndarray, n: int):
    """Order that gathers equal parts, and each part's slice of it."""
    order = np.argsort(part, kind="stable")
    ends = np.searchsorted(part[order], np.arange(n + 1))
    for p in range(n):
        if ends[p] < ends[p + 1]:
            yield p, order[ends[p] : ends[p + 1]]


def linked(a: np.ndarray, b: np.ndarray) -> pa.Table:
    """`a, b`: links to the smallest node, with the components of the given pairs."""
    a, b = stars(a, b)
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def halves(t: pa.Table, k: int, parts: int) -> pa.Table:
    """`part, block, hashes`: what one block of texts sends to each hash range."""
    block = t.column("block")[0].as_py()
    sent = [s[: -(-len(s) // 2)] for s in shingle_sets(*buffers(t.column("text")), k)]
    h = np.concatenate(sent) if sent else np.zeros(0, np.uint64)
    rows = [(p, block, packed(np.sort(h[at] >> CUT), ascending=True)) for p, at in _split(_parts(h, parts), parts)]
    return pa.table({"part": pa.array([r[0] for r in rows], pa.int32()), "block": pa.array([r[1] for r in rows], pa.int32()), "hashes": pa.array([r[2] for r in rows], pa.binary())})


def survivors(docs: DataFrame, k: int = 5) -> DataFrame:
    """`doc_id, n, hashes`: the set only of documents that may link."""
    spark = docs.sparkSession
    b = blocked(docs)
    parts = width(spark)

    def send(t: pa.Table) -> pa.Table:
        return halves(t, k, parts)

    def shared(t: pa.Table) -> pa.Table:
        sent = _each(t.column("hashes"))
        h = np.concatenate(sent) if sent else np.zeros(0, np.uint64)
        order = np.argsort(h)
        s = h[order]
        same = s[1:] == s[:-1]
        twice = np.zeros(len(h), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        off = np.cumsum([0, *map(len, sent)])
        out = [np.unique(h[a:z][twice[a:z]]) for a, z in zip(off[:-1], off[1:])]
        return pa.table({"block": t.column("block"), "hashes": pa.array([packed(x, ascending=True) if len(x) else b"" for x in out], pa.binary())})

    def judge(texts: pa.Table, seen: pa.Table) -> pa.Table:
        known = np.sort(np.concatenate(_each(seen.column("hashes")))) if seen.num_rows else np.zeros(0, np.uint64)
        n, sets = [], []
        for s in shingle_sets(*buffers(texts.column("text")), k):
            half = s[: -(-len(s) // 2)] >> CUT
            n.append(len(s))
            at = np.searchsorted(known, half)
            hits = int((known[np.minimum(at, len(known) - 1)] == half).sum()) if len(known) else 0
            sets.append(s.tobytes() if len(s) and 4 * hits >= len(s) else None)
        return pa.table({"doc_id": texts.column("doc_id"), "n": pa.array(n, pa.int64()), "hashes": pa.array(sets, pa.binary())})

    # the same columns on both sides: one shuffle of the texts serves both passes
    sent = b.groupBy("block").applyInArrow(send, "part int, block int, hashes binary")
    seen = sent.groupBy("part").applyInArrow(shared, "block int, hashes binary").where(F.length("hashes") > 0)
    return b.groupBy("block").cogroup(seen.groupBy("block")).applyInArrow(judge, "doc_id long, n long, hashes binary")


def neighbours(reps: DataFrame, pct: int) -> tuple[DataFrame, DataFrame]:
    """`a, b`: links with the components of those that share a shingle of their prefixes; `rid, common`: shingles that others have too."""
    parts = width(reps.sparkSession)
    frag = "part int, rids binary, tokens binary, n binary, df binary"

    def fragments(part, rid, tok, n, df):
        rows = [(p, rid[at].tobytes(), tok[at].tobytes(), n[at].tobytes(), df[at].tobytes()) for p, at in _split(part, parts)]
        return pa.table({"part": pa.array([r[0] for r in rows], pa.int32())} | {c: pa.array([r[i] for r in rows], pa.binary()) for i, c in enumerate(("rids", "tokens", "n", "df"), 1)})

    def read(t: pa.Table):
        get = lambda c, kind: np.frombuffer(buffers(t.column(c))[0].tobytes(), kind)
        return get("rids", np.int64), get("tokens", np.uint64), get("n", np.int64), get("df", np.uint32)

    def by_token(batches):
        for b in batches:
            raw, off = buffers(b.column("hashes"))
            ids, size = (b.column(c).to_numpy(zero_copy_only=False) for c in ("rid", "n"))
            for i, j in tiles(off):
                tok = np.frombuffer(raw[off[i] : off[j]].tobytes(), np.uint64)
                count = np.diff(off[i : j + 1]) // 8
                rid, n = np.repeat(ids[i:j], count), np.repeat(size[i:j], count)
                yield from fragments(_parts(tok, parts), rid, tok, n, np.ones(len(tok), np.uint32)).to_batches()

    def count(t: pa.Table) -> pa.Table:
        rid, tok, n, _ = read(t)
        _, where, df = np.unique(tok, return_inverse=True, return_counts=True)
        df = df[where]
        keep = df > 1
        home = _parts(rid[keep].view(np.uint64), parts)
        return fragments(home, rid[keep], tok[keep], n[keep], df[keep].astype(np.uint32))

    def prefixes(t: pa.Table) -> pa.Table:
        rid, tok, n, df = read(t)
        o = np.lexsort((tok, df, n, rid))
        rid, tok, n = rid[o], tok[o], n[o]
        first = np.flatnonzero(np.concatenate(([True], (rid[1:] != rid[:-1]) | (n[1:] != n[:-1])))) if len(rid) else np.zeros(0, np.int64)
        size = np.diff(np.append(first, len(rid)))
        rank = np.arange(len(rid)) - np.repeat(first, size)
        alone = n - np.repeat(size, size)  # shingles nobody else has come first
        keep = rank < n - -(-pct * n // 100) + 1 - alone
        return fragments(_parts(tok[keep], parts), rid[keep], tok[keep], n[keep], np.repeat(size, size)[keep].astype(np.uint32))

    def meet(t: pa.Table) -> pa.Table:
        rid, tok, _, _ = read(t)
        o = np.lexsort((rid, tok))
        rid, tok = rid[o], tok[o]
        first = np.flatnonzero(np.concatenate(([True], tok[1:] != tok[:-1]))) if len(tok) else np.zeros(0, np.int64)
        low = np.repeat(rid[first], np.diff(np.append(first, len(tok))))
        return linked(low, rid)

    def commons(batches):
        for b in batches:
            t = pa.Table.from_batches([b])
            rid, _, _, size = read(t)
            u, at = np.unique(rid, return_index=True)
            yield pa.record_batch({"rid": pa.array(u, pa.int64()), "common": pa.array(size[at].astype(np.int64), pa.int64())})

    tokens = reps.select("rid", "n", "hashes").mapInArrow(by_token, frag)
    counted = tokens.groupBy("part").applyInArrow(count, frag)
    pre = staged(counted.groupBy("part").applyInArrow(prefixes, frag))
    common = pre.select("rids", "tokens", "n", "df").mapInArrow(commons, "rid long, common long").groupBy("rid").agg(F.max("common").alias("common"))
    return pre.groupBy("part").applyInArrow(meet, "a long, b long"), common


class PrefixTree:
    """Compressed prefix tree of ascending id sequences, kept as arrays level by level."""

    def __init__(self, seqs: list[np.ndarray]):
        order = sorted(range(len(seqs)), key=lambda i: seqs[i].astype(">u4").tobytes())
        self.run, self.depth, self.leaves, kids = [], [], [], []
        self.low, self.high = [], []
        root = self._node(np.zeros(0, np.int64), 0, kids)
        path = [root]
        last = None
        for i in order:
            s = seqs[i]
            if last is None:
                lcp = 0
            else:
                m = min(len(s), len(last))
                diff = np.flatnonzero(s[:m] != last[:m])
                lcp = int(diff[0]) if len(diff) else m
            while self.depth[path[-1]] > lcp:
                top = path.pop()
                above = self.depth[path[-1]]
                if above < lcp:  # split the edge where the sequences part
                    mid = self._node(self.run[top][: lcp - above], lcp, kids)
                    kids[path[-1]][-1] = mid
                    kids[mid].append(top)
                    self.run[top] = self.run[top][lcp - above :]
                    path.append(mid)
            if len(s) > self.depth[path[-1]]:
                new = self._node(s[self.depth[path[-1]] :], len(s), kids)
                kids[path[-1]].append(new)
                path.append(new)
            self.leaves[path[-1]].append(i)
            last = s
        size = [len(s) for s in seqs]
        seen, stack = [], [root]
        while stack:
            v = stack.pop()
            seen.append(v)
            stack.extend(kids[v])
        for v in reversed(seen):
            below = [size[i] for i in self.leaves[v][:1]]
            self.low[v] = min(below + [self.low[c] for c in kids[v]], default=0)
            self.high[v] = max(below + [self.high[c] for c in kids[v]], default=0)
        self.kids = [np.array(c, np.int64) for c in kids]
        self.root = root
        self.len = np.array([len(r) for r in self.run], np.int64)
        self.at = np.concatenate(([0], np.cumsum(self.len)))[:-1]
        self.flat = np.concatenate(self.run) if self.run else np.zeros(0, np.int64)
        self.end = np.array([r[-1] if len(r) else -1 for r in self.run], np.int64)
        self.depth, self.low, self.high = (np.array(x, np.int64) for x in (self.depth, self.low, self.high))

    def _node(self, run, depth, kids) -> int:
        self.run.append(run)
        self.depth.append(depth)
        self.leaves.append([])
        self.low.append(0)
        self.high.append(0)
        kids.append([])
        return len(self.run) - 1

    def linked(self, x: np.ndarray, nx: int, mask: np.ndarray, pct: int):
        """Members whose Jaccard with a set of `nx` items, of which `x` occur in the tree, is `pct` % or more."""
        mask[x] = 1
        nodes, over = self.kids[self.root], np.zeros(len(self.kids[self.root]), np.int64)
        while len(nodes):
            ln = self.len[nodes]
            ends = np.cumsum(ln)
            at = np.repeat(self.at[nodes] - np.concatenate(([0], ends[:-1])), ln) + np.arange(ends[-1])
            over = over + np.add.reduceat(mask[self.flat[at]], np.concatenate(([0], ends[:-1])))
            left = len(x) - np.searchsorted(x, self.end[nodes], "right")
            best = np.clip(self.depth[nodes] + left, self.low[nodes], self.high[nodes])
            alive = (100 + pct) * (over + np.minimum(left, best - self.depth[nodes])) >= pct * (nx + best)
            nodes, over = nodes[alive], over[alive]
            nxt, ov = [], []
            for v, o in zip(nodes.tolist(), over.tolist()):
                if self.leaves[v] and (100 + pct) * o >= pct * (nx + int(self.depth[v])):
                    yield from self.leaves[v]
                if len(self.kids[v]):
                    nxt.append(self.kids[v])
                    ov.append(np.full(len(self.kids[v]), o, np.int64))
            nodes = np.concatenate(nxt) if nxt else np.zeros(0, np.int64)
            over = np.concatenate(ov) if ov else np.zeros(0, np.int64)
        mask[x] = 0


def tree_links(members: list[tuple[int, np.ndarray]], probes: list[tuple[int, np.ndarray]], pct: int, met: dict[int, list[int]] | None = None) -> list[tuple[int, int]]:
    """Links (ids) between probes and members that join what was apart: enough for exact components.

    `met`, where given, gets all members but itself that each probe links with.
    """
    allt = np.concatenate([s for _, s in members])
    vocab, df = np.unique(allt, return_counts=True)
    rank = np.empty(len(vocab), np.int64)
    rank[np.lexsort((vocab, -df))] = np.arange(len(vocab))  # common shingles first: paths are shared
    seqs = [np.sort(rank[np.searchsorted(vocab, s)]) for _, s in members]
    tree, mask = PrefixTree(seqs), np.zeros(len(vocab), np.int64)
    up: dict[int, int] = {}

    def root(v: int) -> int:
        while (p := up.setdefault(v, v)) != v:
            up[v] = v = up[p]
        return v

    groups = len({r for r, _ in members} | {r for r, _ in probes})
    out = []
    for rid, s in probes:
        if groups == 1 and met is None:
            break
        at = np.minimum(np.searchsorted(vocab, s), len(vocab) - 1)
        x = np.sort(rank[at[vocab[at] == s]])
        found = list(tree.linked(x, len(s), mask, pct))
        if met is not None:
            met[rid] = [members[i][0] for i in found if members[i][0] != rid]
        for i in found:
            a, b = root(rid), root(members[i][0])
            if a != b:
                up[a] = b
                groups -= 1
                out.append((rid, members[i][0]))
    return out


def links(reps: DataFrame, pct: int, chunk: int) -> DataFrame:
    """`a, b`: pairs of representatives with the same components as all links."""
    near, common = neighbours(reps, pct)
    hood = components(near).select(F.col("node").alias("rid"), F.col("label").alias("hood"))
    m = staged(reps.join(hood, "rid").join(common, "rid"))
    size = m.groupBy("hood").agg(F.count("*").alias("members"), F.max_by("rid", F.struct(F.col("common") / F.col("n"), "n", "rid")).alias("lead"))
    m = m.join(size, "hood")
    big = m.where(F.col("members") > chunk)

    def against_lead(batches):
        for b in batches:
            raw, off = buffers(b.column("hashes"))
            lraw, loff = buffers(b.column("lead_hashes"))
            ok = []
            for i in range(b.num_rows):
                x, y = np.frombuffer(raw[off[i] : off[i + 1]].tobytes(), np.uint64), np.frombuffer(lraw[loff[i] : loff[i + 1]].tobytes(), np.uint64)
                o = len(np.intersect1d(x, y, assume_unique=True))
                ok.append((100 + pct) * o >= pct * (len(x) + len(y)))
            yield pa.record_batch({"rid": b.column("rid"), "lead": b.column("lead"), "hood": b.column("hood"), "linked": pa.array(ok, pa.bool_())})

    leads = big.where("rid = lead").select("hood", F.col("hashes").alias("lead_hashes"))
    star = staged(big.join(leads, "hood").select("rid", "lead", "hood", "hashes", "lead_hashes").mapInArrow(against_lead, "rid long, lead long, hood long, linked boolean"))
    # small neighbourhoods: one tree, every member probes it; large ones: what the leader left probes all chunks
    small = m.where(F.col("members") <= chunk).select("hood", F.lit(0).alias("pc"), F.lit(0).alias("mc"), F.lit(True).alias("member"), F.lit(True).alias("probe"), "rid", "hashes")
    rest = star.where("not linked").select("hood", "rid")
    left = rest.groupBy("hood").agg(F.count("*").alias("left"))
    big = big.join(left, "hood").withColumns({"mcs": F.ceil(F.col("members") / chunk).cast("int"), "pcs": F.ceil(F.col("left") / chunk).cast("int")})
    deal = lambda n, seed: F.pmod(F.xxhash64("rid", F.lit(seed)), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    stay = big.select("hood", every("pcs").alias("pc"), deal(F.col("mcs"), 1).alias("mc"), F.lit(True).alias("member"), F.lit(False).alias("probe"), "rid", "hashes")
    go = big.join(rest, ["hood", "rid"], "left_semi").select("hood", deal(F.col("pcs"), 2).alias("pc"), every("mcs").alias("mc"), F.lit(False).alias("member"), F.lit(True).alias("probe"), "rid", "hashes")

    def walk(t: pa.Table) -> pa.Table:
        raw, off = buffers(t.column("hashes"))
        sets = [np.frombuffer(raw[a:z].tobytes(), np.uint64) for a, z in zip(off[:-1], off[1:])]
        rid, isin, goes = (t.column(c).to_pylist() for c in ("rid", "member", "probe"))
        members = [(r, s) for r, s, y in zip(rid, sets, isin) if y]
        probes = [(r, s) for r, s, y in zip(rid, sets, goes) if y]
        out = np.array(tree_links(members, probes, pct) if members and probes else [], np.int64).reshape(-1, 2)
        return linked(out[:, 0], out[:, 1])

    # dealt by chunk whichever side the sizes were joined from: rows that lie by neighbourhood would satisfy the grouping too
    tree = small.union(stay).union(go).repartition("hood", "pc", "mc").groupBy("hood", "pc", "mc").applyInArrow(walk, "a long, b long")
    return star.where("linked and rid <> lead").select(F.col("rid").alias("a"), F.col("lead").alias("b")).union(tree)


def all_links(reps: DataFrame, pct: int, chunk: int) -> DataFrame:
    """`a, b, n`: links that join the components (n 0), and per probe and chunk the rows that all its links lead to (b null)."""
    near, _ = neighbours(reps, pct)
    hood = components(near).select(F.col("node").alias("rid"), F.col("label").alias("hood"))
    m = staged(reps.select("rid", "hashes", "copies").join(hood, "rid"))
    size = m.groupBy("hood").agg(F.ceil(F.count("*") / chunk).cast("int").alias("cs"))
    m = m.join(size, "hood")
    deal = lambda seed: F.pmod(F.xxhash64("rid", F.lit(seed)), F.col("cs")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("cs") - 1))
    stay = m.select("hood", every.alias("pc"), deal(1).alias("mc"), F.lit(True).alias("member"), "rid", "hashes", "copies")
    go = m.select("hood", deal(2).alias("pc"), every.alias("mc"), F.lit(False).alias("member"), "rid", "hashes", "copies")

    def walk(t: pa.Table) -> pa.Table:
        raw, off = buffers(t.column("hashes"))
        sets = [np.frombuffer(raw[a:z].tobytes(), np.uint64) for a, z in zip(off[:-1], off[1:])]
        rid, isin, copies = (t.column(c).to_pylist() for c in ("rid", "member", "copies"))
        members = [(r, s) for r, s, y in zip(rid, sets, isin) if y]
        probes = [(r, s) for r, s, y in zip(rid, sets, isin) if not y]
        weight, met = dict(zip(rid, copies)), {}
        out = [(a, b, 0) for a, b in tree_links(members, probes, pct, met)] if members and probes else []
        out += [(r, None, sum(weight[x] for x in got)) for r, got in met.items() if got]
        return pa.table({c: pa.array([x[i] for x in out], pa.int64()) for i, c in enumerate("abn")})

    return staged(stay.union(go).repartition("hood", "pc", "mc").groupBy("hood", "pc", "mc").applyInArrow(walk, "a long, b long, n long"))


def _classes(docs: DataFrame, pct: int, k: int) -> tuple[DataFrame, DataFrame]:
    """Rows with the signature of their set, and one representative of each set that may link."""
    if pct < 75:
        raise ValueError("the filter on halves needs a threshold of 75 % or more")
    small_batches(docs.sparkSession)
    rows = staged(survivors(docs, k).withColumn("sig", F.sha2("hashes", 256)))
    alive = rows.where("hashes is not null")
    reps = alive.groupBy("sig").agg(F.min("doc_id").alias("doc"), F.any_value("n").alias("n"), F.any_value("hashes").alias("hashes"), F.count("*").alias("copies"))
    return rows, staged(reps.withColumn("rid", F.xxhash64("sig")))


def _named(rows: DataFrame, reps: DataFrame, joined: DataFrame) -> DataFrame:
    """`doc_id, n, sig, rid, copies, class_id, component_id` per row."""
    label = components(joined)
    named = reps.select("sig", "rid", "doc", "copies").join(label.withColumnRenamed("node", "rid"), "rid", "left").withColumn("label", F.coalesce("label", "rid"))
    lowest = named.groupBy("label").agg(F.min("doc").alias("component_id"))
    named = staged(named.join(lowest, "label").select("sig", "rid", "copies", F.col("doc").alias("class_id"), "component_id"))
    out = rows.select("doc_id", "n", "sig").join(named, "sig", "left")
    own = lambda c: F.when(F.col("sig").isNull(), F.col("doc_id")).otherwise(F.col(c)).alias(c)
    return out.select("doc_id", "n", "sig", "rid", "copies", own("class_id"), own("component_id"))


def jaccard_components(docs: DataFrame, pct: int = 75, k: int = 5, chunk: int = CHUNK) -> DataFrame:
    """`doc_id, n_shingles, component_id` per row of `docs`; documents link at a Jaccard of `pct` % (75 or more)."""
    rows, reps = _classes(docs, pct, k)
    return _named(rows, reps, links(reps, pct, chunk)).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def jaccard_links(docs: DataFrame, pct: int = 75, k: int = 5, chunk: int = CHUNK) -> DataFrame:
    """`doc_id, n_shingles, class_id, component_id, n_links` per row of `docs`.

    A class holds the rows with equal sets and is named by its smallest id (null: none has one); `n_links` counts the other
    rows at `pct` % or more, copies included.
    """
    rows, reps = _classes(docs, pct, k)
    found = all_links(reps, pct, chunk)
    count = found.where("b is null").groupBy(F.col("a").alias("rid")).agg(F.sum("n").alias("others"))
    named = _named(rows, reps, found.where("b is not null").select("a", "b")).join(count, "rid", "left")
    links = F.coalesce(F.col("copies") - 1, F.lit(0)) + F.coalesce("others", F.lit(0))
    return named.select("doc_id", F.col("n").alias("n_shingles"), "class_id", "component_id", links.cast("long").alias("n_links"))


def links_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_links(table(spark, sf_dir, "documents"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))
