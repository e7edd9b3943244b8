"""SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints that differ in at most ``BITS`` of 64 bits are linked, and documents reach
each other over links. Equal fingerprints are first reduced to one node.

The index has two storeys. The upper nodes are masked bit patterns: of six bands, any four
differing bits leave two bands untouched, so every link shares one of the fifteen two-band
patterns; Spark deals the fingerprints to these nodes. Inside a node the fingerprints are
sorted by Gray rank, which puts similar patterns side by side, and grouped into a tree; a
tree node keeps the bits that all below it share. Two tree nodes whose shared bits already
differ in more than ``BITS`` places are pruned as a whole, and so are two whose members
are one component already. A node hands on a spanning star of what it linked, never pairs.

Defined results: a null or blank text has no words and fingerprint zero, linked like any
other; fewer than four words count as one shingle; repeated rows get equal answers; a null
id keeps its row and never names a component that has another id; an empty table gives no
rows; other columns are ignored by ``near_duplicates`` and kept by ``keep_one``, which judges
rows and not ids.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from voltpanel.llm.common import fresh, slices
from voltpanel.llm.components import connected_components
from voltpanel.session import materialised

SHINGLE, SEED, BITS = 4, 42, 4
BANDS = (11, 11, 11, 11, 10, 10)
#: Members that one upper node holds before it is split into blocks that are compared in pairs.
NODE_MEMBERS = 50_000
LEAF, FANOUT = 32, 8
#: Rows that a task gathers before it searches the nodes they complete.
GATHER = 200_000


# --- fingerprints ------------------------------------------------------------------------


def fingerprint(text: str | None) -> int:
    """Majority bits of the shingles' hashes, as an unsigned number."""
    import xxhash

    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        return xxhash.xxh64_intdigest(joined, SEED)
    starts = [0]
    for n in map(len, words):
        starts.append(starts[-1] + n + 1)
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a : b - 1], SEED) for a, b in zip(starts, starts[SHINGLE:])], dtype="<u8")
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        bits = np.unpackbits(hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *also: Column) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) and the columns ``also`` of every document."""
    asked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *also, F.col("text").alias("_text"))
    kept = asked.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in slices(batches):
            fps = np.array([fingerprint(t) for t in batch.column(len(kept)).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(fps)], [*kept, "fp"])

    return asked.mapInArrow(run, StructType([*asked.schema[: len(kept)], StructField("fp", LongType())]))


# --- the index ---------------------------------------------------------------------------


def band_masks(bands: tuple[int, ...] = BANDS, bits: int = BITS) -> list[int]:
    """Masks of the upper nodes' patterns: every choice of the bands that ``bits`` differing
    bits must leave untouched."""
    starts = [sum(bands[:i]) for i in range(len(bands))]
    band = [((1 << w) - 1) << s for s, w in zip(starts, bands)]
    return [sum(chosen) for chosen in combinations(band, len(bands) - bits)]


def gray_rank(fps: np.ndarray) -> np.ndarray:
    """Place of each bit pattern in the Gray sequence: every bit is the parity of those above."""
    rank = fps.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class Groups:
    """Members merged into components; the root of each is its least index."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def merge(self, u: np.ndarray, v: np.ndarray) -> bool:
        changed = False
        while True:
            a, b = self.root[u], self.root[v]
            apart = a != b
            if not apart.any():
                return changed
            changed = True
            np.minimum.at(self.root, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
            while True:
                up = self.root[self.root]
                if (up == self.root).all():
                    break
                self.root = up


class GrayTree:
    """Levels of nodes over Gray-sorted fingerprints; level 0 are the leaves."""

    def __init__(self, fps: np.ndarray):
        self.fps = fps
        starts = np.arange(0, len(fps), LEAF)
        ones, some = np.bitwise_and.reduceat(fps, starts), np.bitwise_or.reduceat(fps, starts)
        self.levels = [(ones, some)]
        while len(ones) > FANOUT:
            starts = np.arange(0, len(ones), FANOUT)
            ones, some = np.bitwise_and.reduceat(ones, starts), np.bitwise_or.reduceat(some, starts)
            self.levels.append((ones, some))

    def uniform(self, root: np.ndarray) -> list[np.ndarray]:
        """Per level and node the component of all members, or -1 where they differ."""
        starts = np.arange(0, len(root), LEAF)
        low, high = np.minimum.reduceat(root, starts), np.maximum.reduceat(root, starts)
        out = [np.where(low == high, low, -1)]
        for _ in self.levels[1:]:
            starts = np.arange(0, len(low), FANOUT)
            low, high = np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts)
            out.append(np.where(low == high, low, -1))
        return out

    def search(self, groups: Groups, bits: int = BITS) -> None:
        """Merge all members within ``bits`` of each other."""
        n = len(self.fps)
        for step in range(1, min(9, n)):  # Gray neighbours first: dense groups merge early
            near = np.flatnonzero(np.bitwise_count(self.fps[:-step] ^ self.fps[step:]) <= bits)
            groups.merge(near, near + step)
        uniform = self.uniform(groups.root)
        top = len(self.levels) - 1
        a, b = np.triu_indices(len(self.levels[top][0]))
        stack = [(top, a, b)]
        while stack:
            level, a, b = stack.pop()
            ones, some = self.levels[level]
            shared = (ones[a] | ~some[a]) & (ones[b] | ~some[b])
            known = np.bitwise_count((ones[a] ^ ones[b]) & shared)
            one = (uniform[level][a] == uniform[level][b]) & (uniform[level][a] >= 0)
            a, b = a[(known <= bits) & ~one], b[(known <= bits) & ~one]
            if not len(a):
                continue
            if level == 0:
                if self._leaves(a, b, groups, bits):
                    uniform = self.uniform(groups.root)
                continue
            below = len(self.levels[level - 1][0])
            i, j = (x.ravel() for x in np.meshgrid(np.arange(FANOUT), np.arange(FANOUT), indexing="ij"))
            ca, cb = (a[:, None] * FANOUT + i).ravel(), (b[:, None] * FANOUT + j).ravel()
            keep = (ca < below) & (cb < below) & (ca <= cb)
            ca, cb = ca[keep], cb[keep]
            size = 256 if level == 1 else 4096
            stack += [(level - 1, ca[x : x + size], cb[x : x + size]) for x in range(0, len(ca), size)][::-1]

    def _leaves(self, a: np.ndarray, b: np.ndarray, groups: Groups, bits: int) -> bool:
        n, within = len(self.fps), np.arange(LEAF)
        u, v = a[:, None] * LEAF + within, b[:, None] * LEAF + within
        fu, fv = self.fps[np.minimum(u, n - 1)], self.fps[np.minimum(v, n - 1)]
        near = np.bitwise_count(fu[:, :, None] ^ fv[:, None, :]) <= bits
        near &= (u < n)[:, :, None] & (v < n)[:, None, :]
        pair, i, j = np.nonzero(near)
        return groups.merge(u[pair, i], v[pair, j])


def node_links(node: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of many upper nodes at once: ``node`` numbers them, equal numbers side by side."""
    a, b = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
    size = np.bincount(node)[node]
    few = np.flatnonzero((size > 1) & (size <= 2 * LEAF))
    n, f = node[few], fps[few]
    for step in range(1, 2 * LEAF):
        here = np.flatnonzero(n[:-step] == n[step:]) if step < len(n) else few[:0]
        if not len(here):
            break
        near = here[np.bitwise_count(f[here] ^ f[here + step]) <= BITS]
        a.append(f[near]), b.append(f[near + step])
    many = np.flatnonzero(size > 2 * LEAF)
    for number in np.unique(node[many]):
        members = np.unique(fps[many[node[many] == number]])
        members = members[np.argsort(gray_rank(members))]
        groups = Groups(len(members))
        GrayTree(members).search(groups)
        led = np.flatnonzero(groups.root != np.arange(len(members)))
        a.append(members[led]), b.append(members[groups.root[led]])
    return np.concatenate(a), np.concatenate(b)


def search_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links inside each upper node; rows come sorted by node, and nodes end where keys change."""
    held: list[np.ndarray] = []

    def found(rows: np.ndarray):
        change = np.any(rows[1:, :-1] != rows[:-1, :-1], axis=1)
        node = np.concatenate([[0], np.cumsum(change)])
        a, b = node_links(node, rows[:, -1].copy().view(np.uint64))
        if len(a):
            pairs = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)], axis=1).view(np.int64), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["a", "b"])

    for batch in batches:
        held.append(np.stack([np.asarray(c.cast(pa.int64())) for c in batch.columns], axis=1))
        if sum(map(len, held)) >= GATHER:
            rows = np.concatenate(held)
            last = np.flatnonzero(np.any(rows[1:, :-1] != rows[:-1, :-1], axis=1))
            cut = last[-1] + 1 if len(last) else 0
            if cut:
                yield from found(rows[:cut])
            held = [rows[cut:]]
    rows = np.concatenate(held) if held else np.empty((0, 5), np.int64)
    if len(rows):
        yield from found(rows)


def fingerprint_links(distinct: DataFrame, members: int = NODE_MEMBERS) -> DataFrame:
    """a, b: links between distinct fingerprints that give the same components as all links.

    A node with more than ``members`` fingerprints is split into blocks, and every pair of
    blocks is searched in a task of its own: nothing is dropped, and no task grows.
    """
    patterns = F.array(
        *[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m if m < 1 << 63 else m - (1 << 64)).cast("long")).alias("key")) for t, m in enumerate(band_masks())]
    )
    dealt = distinct.select("fp", F.inline(patterns))
    crowded = dealt.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > members)
    crowded = crowded.select("t", "key", F.ceil(F.col("n") / members).cast("int").alias("blocks"))
    placed = dealt.join(crowded, ["t", "key"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.hash("fp"), F.col("blocks"))
    placed = placed.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select(
        "t", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp"
    )
    ordered = placed.repartition("t", "key", "i", "j").sortWithinPartitions("t", "key", "i", "j")
    return ordered.mapInArrow(search_nodes, "a bigint, b bigint")


# --- the operator ------------------------------------------------------------------------


def roots_of(distinct: DataFrame) -> DataFrame:
    """fp and root (its component's least fingerprint) of every distinct fingerprint."""
    roots = connected_components(fingerprint_links(distinct.select("fp")))
    return distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp, fingerprint (hex) and component_id, one row per document."""
    fps = materialised(fingerprints(docs), "fingerprints")
    linked = roots_of(materialised(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes"))
    named = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = linked.join(named, "root").select("fp", "component_id")
    out = fps.join(classes, "fp")
    return out.select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component, with its own columns: the one with the least id, null ids last.

    Rows are told apart by id, text and the other columns, so rows that share an id, or have
    none, are judged each by its own text; among rows equal in all of these any is the same row.
    """
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    rest = F.to_json(F.struct(*others)) if others else F.lit("")
    key = F.struct(
        F.col("doc_id").isNull().alias("absent"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"),
        F.coalesce(F.md5("text"), F.lit("")).alias("text"), F.md5(rest).alias("rest"),
    )
    name = fresh(docs, "row")
    fps = fingerprints(docs, key.alias("row"))
    nodes = materialised(fps.groupBy("fp").agg(F.min("row").alias("least")), "nodes")
    kept = roots_of(nodes).groupBy("root").agg(F.min("least").alias(name)).select(name)
    marked = docs.withColumn(f"{name}_own", key)
    own = [F.col(f"`{c}`") for c in docs.columns]
    chosen = marked.join(kept, F.col(f"{name}_own") == F.col(name), "left_semi")
    return chosen.dropDuplicates([f"{name}_own"]).select(*own)
