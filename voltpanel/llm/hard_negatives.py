"""Hard negatives of anchors through an STR-packed R-tree over integer vectors.

The index is a forest of packed trees. Spark sorts all rows by dimension, label and first
coordinate and cuts them into equal slices (the id splits ties, so a hot label or vector is
many slices); a task tiles its slice along label and the most spread coordinates and packs
the tiles into leaves. Every box of a tree keeps the least and greatest value per coordinate
and label, which bound the inner product with an anchor from both sides.

A search takes a tree's boxes best first, by their greatest possible product. A box is
skipped if its interval lies outside all score windows, if it can hold no row of a wanted
label, or if its bound is strictly below the kth score found so far (equal ones may still win
by id). Anchors travel in blocks to chains of trees; what is found along a chain bounds the
rest of it, and Spark merges the chains' few best.

Defined results: rows with a null label, a null vector or any null or non-finite component
take no part; rows of different dimensions never meet; a null id is no anchor and sorts last
among ties; repeated rows count each for itself, so a copy of an anchor may be its positive;
an anchor without positives, or a positive without negatives in its window, has no rows;
products beyond a long count as its greatest or least value; other columns are ignored.
"""

from __future__ import annotations

import heapq
from bisect import insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltpanel.llm.common import slices
from voltpanel.session import materialised

SCALE, ANCHOR_EVERY, RELABEL_EVERY, LABELS = 256, 100, 7, 10
POSITIVES, NEGATIVES = 5, 10
#: A negative's score lies between these hundredths of the positive's.
LEAST, MOST = 30, 90
#: Rows of a tree, rows of a leaf, boxes of an upper node.
TREE_ROWS, LEAF, FANOUT = 8_192, 128, 8
#: Anchors that travel together, trees that one task searches for them, and tasks at most.
ANCHORS, CHAIN, MAX_TASKS = 4_096, 64, 20_000
EXACT = float(1 << 53)
LONG = (1 << 63) - 1

LEAVES = "slice int, tree bigint, leaf int, dim int, ids array<bigint>, labels array<bigint>, vectors binary, small boolean"
FOUND = "anchor bigint, window int, score bigint, id bigint"


# --- the index ---------------------------------------------------------------------------


def usable(embeddings: DataFrame) -> DataFrame:
    """vec_id, label after relabelling, and the vector, of the rows that take part."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * SCALE) < float("inf")))
    label, vec_id = F.col("label").cast("long"), F.col("vec_id").cast("long")
    moved = F.when(vec_id % RELABEL_EVERY == 0, (label + 1) % LABELS).otherwise(label)
    rows = embeddings.filter(F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite)
    return rows.select(vec_id.alias("vec_id"), moved.alias("label"), F.col("embedding").cast("array<double>").alias("vector"))


def str_pages(label: np.ndarray, x: np.ndarray, leaf: int = LEAF) -> list[np.ndarray]:
    """Sort-tile-recursive pages: slabs by label, then by ever further coordinates, the most
    spread first, until a tile fits a leaf."""
    pages = max(1, -(-len(x) // leaf))
    axes = np.argsort(-x.std(axis=0), kind="stable")[: max(1, int(np.log2(pages)))] if x.shape[1] else []
    keys = [label, *(x[:, a] for a in axes)]

    def tiles(rows: np.ndarray, depth: int) -> Iterator[np.ndarray]:
        left = -(-len(rows) // leaf)
        if left <= 1:
            yield rows
            return
        if depth >= len(keys):
            slabs = left
        else:
            rows = rows[np.argsort(keys[depth][rows], kind="stable")]
            ways = len(keys) - depth
            slabs = min(left, len(np.unique(label[rows]))) if depth == 0 else int(np.ceil(left ** (1 / ways)))
        size = -(-left // max(1, slabs)) * leaf
        for at in range(0, len(rows), size):
            yield from tiles(rows[at : at + size], depth + 1)

    return list(tiles(np.arange(len(x)), 0))


def index(rows: DataFrame, tree_rows: int = TREE_ROWS) -> DataFrame:
    """The leaves of the forest, each with its rows; trees are numbered within their slice."""
    n = rows.count()
    order = [F.size("vector"), F.col("label"), F.get("vector", F.lit(0)), F.col("vec_id")]
    sliced = rows.repartitionByRange(max(1, -(-n // tree_rows)), *order).sortWithinPartitions(*order)

    def pack(batches: Iterator[pa.RecordBatch]):
        here = TaskContext.get().partitionId()
        held, dim, trees = [], -1, 0

        def tree():
            nonlocal held, trees
            label, x = np.array([r["label"] for r in held]), np.array([r["vector"] for r in held], np.float64).reshape(len(held), dim)
            x = np.floor(SCALE * x)
            out = []
            for number, page in enumerate(str_pages(label, x)):
                small = not page.size or not dim or float(np.abs(x[page]).max()) < 32_768
                out.append(
                    {
                        "slice": here, "tree": (here << 20) + trees, "leaf": number, "dim": dim,
                        "ids": [held[i]["vec_id"] for i in page], "labels": label[page].tolist(),
                        "vectors": x[page].astype("<i2" if small else "<f8").tobytes(), "small": small,
                    }
                )
            held, trees = [], trees + 1
            return pa.RecordBatch.from_pylist(out, schema=PAGES)

        for batch in slices(batches, 1024):
            for row in batch.to_pylist():
                if held and (len(row["vector"]) != dim or len(held) >= tree_rows):
                    yield tree()
                dim = len(row["vector"])
                held.append(row)
        if held:
            yield tree()

    return sliced.mapInArrow(pack, LEAVES)


PAGES = pa.schema(
    [("slice", pa.int32()), ("tree", pa.int64()), ("leaf", pa.int32()), ("dim", pa.int32()), ("ids", pa.list_(pa.int64()))]
    + [("labels", pa.list_(pa.int64())), ("vectors", pa.binary()), ("small", pa.bool_())]
)


def row_key(leaf: dict) -> int:
    """Number of a leaf's first row; no other row of the index has it."""
    return (leaf["tree"] << 19) + (leaf["leaf"] << 7)


def vectors_of(row: dict) -> np.ndarray:
    return np.frombuffer(row["vectors"], "<i2" if row["small"] else "<f8").astype(np.float64).reshape(len(row["ids"]), row["dim"])


class Tree:
    """Boxes of one packed tree: the leaves in order, then each level of upper nodes."""

    def __init__(self, leaves: list[dict]):
        self.ids, self.vectors = [r["ids"] for r in leaves], [vectors_of(r) for r in leaves]
        self.labels = [np.array(r["labels"]) for r in leaves]
        self.keys = [row_key(r) for r in leaves]
        low, high = np.stack([v.min(axis=0) for v in self.vectors]), np.stack([v.max(axis=0) for v in self.vectors])
        least, most = np.array([v.min() for v in self.labels]), np.array([v.max() for v in self.labels])
        lows, highs, leasts, mosts, self.children = [low], [high], [least], [most], [()] * len(leaves)
        first, width = 0, len(leaves)
        while width > 1:
            starts = np.arange(0, width, FANOUT)
            self.children += [range(first + s, first + min(s + FANOUT, width)) for s in starts.tolist()]
            lows.append(np.minimum.reduceat(lows[-1], starts)), highs.append(np.maximum.reduceat(highs[-1], starts))
            leasts.append(np.minimum.reduceat(leasts[-1], starts)), mosts.append(np.maximum.reduceat(mosts[-1], starts))
            first, width = first + width, len(starts)
        self.low, self.high = np.concatenate(lows), np.concatenate(highs)
        self.least, self.most = np.concatenate(leasts), np.concatenate(mosts)

    def intervals(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest product of every anchor with a row of every box."""
        up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
        return up @ self.low.T + down @ self.high.T, up @ self.high.T + down @ self.low.T

    def exact(self, anchors: np.ndarray) -> bool:
        """Whether all products are exact in a double."""
        if not anchors.size or not self.low.size:
            return True
        return anchors.shape[1] * np.abs(anchors).max() * max(np.abs(self.low).max(), np.abs(self.high).max()) < EXACT


# --- the search --------------------------------------------------------------------------


class Best:
    """The first k rows found whose scores lie in a closed interval."""

    def __init__(self, least: float, most: float, k: int):
        self.most, self.k, self.rows, self.floor = most, k, [], least

    def offer(self, score: int, order: tuple) -> None:
        insort(self.rows, (-score, order))
        if len(self.rows) >= self.k:
            del self.rows[self.k :]
            self.floor = max(self.floor, -self.rows[-1][0])


class Anchor:
    def __init__(self, row: dict, same: bool, k: int):
        self.key, self.label, self.same = row["tree"], row["labels"][0], same
        if same:
            self.windows = [Best(float("-inf"), float("inf"), k)]
        else:  # exact whole-number forms of LEAST * p <= 100 * s <= MOST * p
            self.windows = [Best(-(-LEAST * p // 100), MOST * p // 100, k) for p in row["ids"]]
        self.most = max((w.most for w in self.windows), default=float("-inf"))

    def floor(self) -> float:
        return min((w.floor for w in self.windows), default=float("inf"))


def best_first(tree: Tree, anchor: Anchor, vector: np.ndarray, low: np.ndarray, high: np.ndarray, exact: bool) -> int:
    """Search one tree for one anchor; gives the number of leaves read."""
    wanted = (tree.least <= anchor.label) & (anchor.label <= tree.most)
    if not anchor.same:
        wanted = (tree.least != anchor.label) | (tree.most != anchor.label)
    bound = np.where(wanted & (low <= anchor.most), high, -np.inf).tolist()
    queue, floor, read = [(-bound[-1], len(bound) - 1)], anchor.floor(), 0
    while queue and -queue[0][0] >= floor and queue[0][0] != np.inf:
        _, box = heapq.heappop(queue)
        for child in tree.children[box]:
            if bound[child] >= floor and bound[child] != -np.inf:
                heapq.heappush(queue, (-bound[child], child))
        if tree.children[box]:
            continue
        read += 1
        if exact:
            scores = tree.vectors[box] @ vector
        else:
            whole = [int(v) for v in vector]
            scores = [sum(int(a) * b for a, b in zip(row, whole)) for row in tree.vectors[box]]
            scores = np.array([min(max(s, -LONG), LONG) for s in scores], dtype=object)
        right = tree.labels[box] == anchor.label
        near = ((right if anchor.same else ~right) & (scores >= floor) & (scores <= anchor.most)).nonzero()[0]
        if not len(near):
            continue
        ids = tree.ids[box]
        for i in near[np.argsort(-scores[near], kind="stable")].tolist():
            if anchor.same and tree.keys[box] + i == anchor.key:
                continue
            score, order = int(scores[i]), (ids[i] is None, ids[i] or 0)
            for window in anchor.windows:
                if window.floor <= score <= window.most:
                    window.offer(score, order)
        floor = anchor.floor()
    return read


class Chain:
    """One block of anchors and the trees that come by, one at a time."""

    def __init__(self, part: tuple, same: bool, k: int):
        self.part, self.same, self.k, self.anchors, self.leaves = part, same, k, {}, []

    def take(self, row: dict) -> None:
        if row["leaf"] < 0:
            vector = np.frombuffer(row["vectors"], "<f8")
            self.anchors.setdefault(row["dim"], []).append((Anchor(row, self.same, self.k), vector))
            return
        if self.leaves and self.leaves[0]["tree"] != row["tree"]:
            self.search()
        self.leaves.append(row)

    def search(self) -> None:
        leaves, self.leaves = self.leaves, []
        mine = self.anchors.get(leaves[0]["dim"], []) if leaves else []
        tree = Tree(leaves) if mine else None
        for at in range(0, len(mine), 512):
            some = mine[at : at + 512]
            vectors = np.stack([v for _, v in some])
            low, high = tree.intervals(vectors)
            exact = tree.exact(vectors)
            if not exact:
                low, high = np.full_like(low, -np.inf), np.full_like(high, np.finfo(float).max)
            for i, (anchor, vector) in enumerate(some):
                best_first(tree, anchor, vector, low[i], high[i], exact)

    def found(self) -> Iterator[pa.RecordBatch]:
        self.search()
        for some in self.anchors.values():
            rows = [
                (anchor.key, number, -negated, None if nameless else vec_id)
                for anchor, _ in some
                for number, window in enumerate(anchor.windows)
                for negated, (nameless, vec_id) in window.rows
            ]
            for at in range(0, len(rows), 65_536):
                a, w, s, i = zip(*rows[at : at + 65_536])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a, pa.int64()), pa.array(w, pa.int32()), pa.array(s, pa.int64()), pa.array(i, pa.int64())],
                    ["anchor", "window", "score", "id"],
                )


def anchor_rows(leaves: DataFrame) -> DataFrame:
    """One row per anchor, in the leaves' columns: tree is its own number, leaf -1."""

    def pick(batches: Iterator[pa.RecordBatch]):
        for batch in slices(batches, 16):
            out = []
            for row in batch.to_pylist():
                vectors = vectors_of(row)
                for i, (vec_id, label) in enumerate(zip(row["ids"], row["labels"])):
                    if vec_id is not None and vec_id % ANCHOR_EVERY == 0:
                        out.append(row | {"tree": row_key(row) + i, "leaf": -1, "ids": [vec_id], "labels": [label], "vectors": vectors[i].tobytes()})
            yield pa.RecordBatch.from_pylist(out, schema=PAGES)

    return leaves.mapInArrow(pick, LEAVES)


def search(leaves: DataFrame, anchors: DataFrame, same: bool, k: int) -> DataFrame:
    """anchor (its number), window, score and id of the first ``k`` rows in each window.

    Every block of anchors meets every chain of trees in one task, so a table of n rows
    travels once per block of anchors and the anchors once per chain.
    """
    spark = leaves.sparkSession
    n_slices = (leaves.agg(F.max("slice")).first()[0] or 0) + 1
    chains = min(n_slices, max(-(-n_slices // CHAIN), 2 * spark.sparkContext.defaultParallelism))
    blocks = max(1, -(-anchors.count() // ANCHORS))
    all_blocks, all_chains = F.sequence(F.lit(0), F.lit(blocks - 1)), F.sequence(F.lit(0), F.lit(chains - 1))
    trees = leaves.withColumn("_chain", F.pmod("slice", F.lit(chains))).withColumn("_block", F.explode(all_blocks))
    asked = anchors.withColumn("_chain", F.explode(all_chains)).withColumn("_block", F.pmod(F.xxhash64("tree"), F.lit(blocks)).cast("int"))
    task = (F.col("_block").cast("long") * chains + F.col("_chain")) % min(MAX_TASKS, blocks * chains)
    order = ["_block", "_chain", F.col("leaf") >= 0, "tree", "leaf"]
    met = trees.unionByName(asked).repartitionById(min(MAX_TASKS, blocks * chains), task.cast("int")).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]):
        chain = None
        for batch in slices(batches, 16):
            for row in batch.to_pylist():
                part = (row["_block"], row["_chain"])
                if chain is None or chain.part != part:
                    if chain:
                        yield from chain.found()
                    chain = Chain(part, same, k)
                chain.take(row)
        if chain:
            yield from chain.found()

    found = met.mapInArrow(run, FOUND)
    order = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hard_negatives(embeddings: DataFrame) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score."""
    leaves = materialised(index(usable(embeddings)), "str-leaves")
    anchors = materialised(anchor_rows(leaves), "anchors")
    first: Column = F.sort_array(F.collect_list(F.struct("rank", "score", "id")))
    positives = search(leaves, anchors, True, POSITIVES).groupBy("anchor").agg(first.alias("positives"))
    known = anchors.withColumnRenamed("tree", "anchor").join(positives, "anchor")
    known = materialised(known.withColumn("anchor_id", F.col("ids")[0]), "positives")
    windows = known.withColumnRenamed("anchor", "tree").withColumn("ids", F.col("positives.score"))
    found = search(leaves, windows.select(*leaves.columns), False, NEGATIVES)
    named = found.join(known.select("anchor", "anchor_id", "positives"), "anchor")
    positive = F.col("positives")[F.col("window")]
    return named.select(
        "anchor_id",
        positive["id"].alias("positive_id"),
        "rank",
        F.col("id").alias("negative_id"),
        positive["score"].alias("positive_score"),
        F.col("score").alias("negative_score"),
    )
