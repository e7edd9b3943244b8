"""Merkle manifest of a table of documents, with a proof and a tamper check per document.

Every document is a leaf. The leaves of one language, in order of their ids, form a tree of
pairs; the languages' top nodes form one more tree above them. Both are built storey by
storey: a superblock is an aligned run of ``2 ** SPAN`` nodes and reduces to one node of the
storey above, so a language with a third of all rows is many superblocks, not one task.

Going down again, each superblock is cogrouped with the few outer nodes that its members
need (its path to the top). One ``applyInPandas`` call then finishes the local reduction,
joins local and outer siblings to whole proofs, and folds each leaf back to the root.

Defined results: null fields are written ``-``; a null id sorts first and is never tampered
with, nor is a null ``n_chars`` changed; repeated rows are leaves of their own, in any order
where they are equal in all five fields; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltpanel.session import materialised

#: Levels of a superblock: it holds 4,096 nodes.
SPAN = 12
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPER = 7

NODE = "tree string, at bigint, size bigint, node string"
OUTER = "tree string, at bigint, path array<string>, subroot string, root string"
FOLDED = "doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string"


def digest(joined: str) -> str:
    return hashlib.sha256(joined.encode("utf-8")).hexdigest()


def leaf_digest(fields: dict[str, Column]) -> Column:
    """H of the fields, each as byte count, colon and value."""
    written = [F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in fields.values()]
    return F.sha2(F.concat(*written), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, tree (the language, null before all others), leaf, and the leaf to fold."""
    fields = {c: F.col(c).cast("string") for c in FIELDS}
    touched = fields | {"n_chars": (F.col("n_chars").cast("decimal(20,0)") + 1).cast("string")}
    hit = (F.crc32(fields["doc_id"].cast("binary")) % TAMPER == 0) & F.col("n_chars").isNotNull()
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("")).alias("tree"),
        leaf_digest(fields).alias("leaf"),
        F.when(hit, leaf_digest(touched)).alias("tampered"),
    )


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """The rows with ``at``, their place in their tree, and ``size``, the tree's rows.

    Spark deals the rows to ordered ranges (a random number splits equal rows), the ranges'
    row counts are added up, and rows are numbered inside their range.
    """
    rows = rows.withColumn("_tie", F.rand(7))
    keys = [F.col(c).asc_nulls_first() for c in ["tree", *order, "_tie"]]
    ranges = materialised(rows.repartitionByRange(*keys).withColumn("_range", F.spark_partition_id()), "leaves")
    before = Window.partitionBy("tree").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranges.groupBy("tree", "_range").agg(F.count(F.lit(1)).alias("_n"))
    starts = counts.select(
        "tree",
        "_range",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"),
        F.sum("_n").over(Window.partitionBy("tree")).alias("size"),
    )
    inside = F.row_number().over(Window.partitionBy("tree", "_range").orderBy(*keys[1:]))
    numbered = ranges.withColumn("_inside", inside).join(starts, ["tree", "_range"])
    return numbered.withColumn("at", F.col("_start") + F.col("_inside") - 1).drop("_tie", "_range", "_start", "_inside")


# --- inside a superblock -----------------------------------------------------------------


def levels_of(size: int) -> int:
    """Levels that a superblock of a tree with ``size`` nodes reduces by."""
    return min(SPAN, (int(size) - 1).bit_length())


def reduced(nodes: list[str], levels: int) -> list[list[str]]:
    """The nodes and every level above them; a last single node is hashed alone."""
    out = [nodes]
    for _ in range(levels):
        below = out[-1]
        out.append([digest("".join(below[i : i + 2])) for i in range(0, len(below), 2)])
    return out


def siblings(levels: list[list[str]], at: int) -> list[str]:
    """Per level the other node of the pair, marked l or r for its side; empty if there is none."""
    out = []
    for row in levels[:-1]:
        other = at ^ 1
        out.append(("l" if other < at else "r") + row[other] if other < len(row) else "")
        at >>= 1
    return out


def folded(node: str, path: list[str]) -> str:
    for step in path:
        other = step[1:]
        node = digest(other + node if step[:1] == "l" else node + other)
    return node


def _top(part: pd.DataFrame) -> pd.DataFrame:
    part = part.sort_values("at")
    size, first = int(part["size"].iloc[0]), int(part["at"].iloc[0])
    top = reduced(part["node"].tolist(), levels_of(size))[-1][0]
    return pd.DataFrame({"tree": [part["tree"].iloc[0]], "at": [first >> SPAN], "size": [-(-size >> SPAN)], "node": [top]})


def _down(nodes: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
    """Paths of a superblock's nodes: their local siblings, then the superblock's own path."""
    nodes, above = nodes.sort_values("at"), outer.iloc[0]
    levels = reduced(nodes["node"].tolist(), levels_of(nodes["size"].iloc[0]))
    paths = [siblings(levels, i) + list(above["path"]) for i in range(len(nodes))]
    return pd.DataFrame({"tree": nodes["tree"], "at": nodes["at"], "path": paths, "subroot": above["subroot"], "root": above["root"]})


def _fold(nodes: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
    """Local reduction, whole proofs and folding of a superblock's leaves."""
    nodes, above = nodes.sort_values("at"), outer.iloc[0]
    levels, rest = reduced(nodes["node"].tolist(), levels_of(nodes["size"].iloc[0])), list(above["path"])
    proofs, roots = [], []
    for i, (leaf, tampered) in enumerate(zip(nodes["node"], nodes["tampered"])):
        path = siblings(levels, i) + rest
        proofs.append(digest("".join(step[1:] for step in path)))
        roots.append(folded(leaf if tampered is None else tampered, path))
    return pd.DataFrame(
        {
            "doc_id": nodes["doc_id"],
            "leaf": nodes["node"],
            "subroot": above["subroot"],
            "root": above["root"],
            "proof_sha256": proofs,
            "folded_root": roots,
        }
    )


# --- storeys -----------------------------------------------------------------------------


def _block() -> Column:
    return F.shiftright("at", SPAN)


def climb(nodes: DataFrame) -> list[DataFrame]:
    """The storeys of all trees, from the given nodes to one node per tree."""
    storeys = [nodes]
    while True:
        below = storeys[-1].select("tree", "at", "size", "node")
        above = materialised(below.groupBy("tree", _block().alias("block")).applyInPandas(_top, NODE), "storey")
        storeys.append(above)
        if (above.agg(F.max("size")).first()[0] or 1) == 1:
            return storeys


def exchange(nodes: DataFrame, outer: DataFrame, finish, schema: str) -> DataFrame:
    """Superblocks cogrouped with the outer nodes that they need."""
    return nodes.groupBy("tree", _block().alias("block")).cogroup(outer.groupBy("tree", "at")).applyInPandas(finish, schema)


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every document."""
    rows = placed(leaves(docs), ["doc_id", "leaf"])
    own = materialised(rows.withColumnRenamed("leaf", "node").withColumn("doc_id", F.col("doc_id").cast("string")), "placed")
    trees = climb(own)
    tops = trees[-1].select(F.lit("").alias("tree"), F.col("tree").alias("own"), "node")
    named = materialised(placed(tops, ["own"]), "subroots")
    crown = climb(named)

    bare = F.expr("cast(array() as array<string>)")
    outer = crown[-1].select("tree", "at", bare.alias("path"), F.lit("").alias("subroot"), F.col("node").alias("root"))
    for storey in crown[-2::-1]:
        outer = exchange(storey.select("tree", "at", "size", "node"), outer, _down, OUTER)
    outer = outer.drop("subroot").join(named.select("at", "own", F.col("node").alias("subroot")), "at")
    outer = outer.select(F.col("own").alias("tree"), F.lit(0).cast("long").alias("at"), "path", "subroot", "root")
    for storey in trees[-2:0:-1]:
        outer = exchange(storey, outer, _down, OUTER)
    done = exchange(own, outer, _fold, FOLDED)
    return done.withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("verified", F.col("folded_root") == F.col("root"))
