"""Merkle manifest of a table: a tree of hashes for each group of rows, one over the groups, and for every row a proof that folds to the root.

Rows are ordered by one range partitioning; blocks of ``SPAN`` consecutive leaves are subtrees. A first pass reduces each block to its top node,
the few nodes above are made by grouping eight at a time, and then each block's leaves meet the outer nodes that its proofs need, sorted by block:
tasks read blocks one after the other from their Arrow batches, reduce each, join the proofs and fold them. So a task holds one block and one batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fold_case, settle

#: Children of a node; levels and leaves of a block.
FAN = 8
DEPTH = 4
SPAN = FAN**DEPTH
#: Columns of a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value as text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: list[Column]) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """``df`` with ``place``, its row's number from 0 in this order (nulls first): a range partitioning and the sizes of its partitions.

    Equal rows are told apart by where they are stored, so that they need not meet in one partition.
    """
    own = df.withColumn("__tie", F.monotonically_increasing_id())
    keys = [F.col(c).asc_nulls_first() for c in (*order, "__tie")]
    rows = settle(own.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("__tie").withColumn("__at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("__at", 33)
    sizes = rows.groupBy(part.alias("__part")).agg(F.count("*").alias("__size"))
    before = F.sum("__size").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1))  # a row for each partition
    offsets = sizes.select("__part", F.coalesce(before, F.lit(0)).alias("__before"))
    return rows.withColumn("__part", part).join(F.broadcast(offsets), "__part").withColumn("place", F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).drop("__part", "__at", "__before")


def height(count: Column) -> Column:
    """Levels above the leaves of a tree with ``count`` of them."""
    powers = F.filter(F.sequence(F.lit(0), F.lit(20)), lambda k: F.pow(F.lit(float(FAN)), k) < count)
    return F.size(powers)


def parents(nodes: DataFrame) -> DataFrame:
    """(tree, place, children) of the nodes (tree, place, node) one level up: at most FAN children, in order."""
    return nodes.groupBy("tree", F.floor(F.col("place") / FAN).alias("place")).agg(F.array_sort(F.collect_list(F.struct("place", "node"))).alias("children"))


def upper(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (tree, place, node, up) with ``up`` levels above them -> (families (tree, level, place, children), tops (tree, node)).

    A round for each level; what is left of a round is at most an eighth, or trees that are done.
    """
    families, tops, level = [], [], 0
    while True:
        tops.append(nodes.where("up = 0").select("tree", "node"))
        more = nodes.where("up > 0")
        if more.isEmpty():
            break
        heights = more.groupBy("tree").agg(F.max("up").alias("up"))
        family = settle(parents(more).join(heights, "tree"), "families")
        families.append(family.select("tree", F.lit(level).alias("level"), "place", "children"))
        nodes = family.select("tree", "place", F.sha2(F.array_join(F.col("children.node"), ""), 256).alias("node"), (F.col("up") - 1).alias("up"))
        level += 1
    none = nodes.sparkSession.createDataFrame([], "tree long, level int, place long, children array<struct<place:long,node:string>>")
    for x in families:
        none = none.unionByName(x)
    top = tops[0]
    for x in tops[1:]:
        top = top.unionByName(x)
    return none, top


def siblings(paths: DataFrame, families: DataFrame) -> DataFrame:
    """For (tree, place, up) with ``place`` at the lowest level of ``families``: (tree, place, level, before, after), the hashes beside the path, joined."""
    steps = paths.select("tree", "place", F.explode(F.sequence(F.lit(0), F.col("up") - 1)).alias("level"))
    own = F.floor(F.col("place") / F.pow(F.lit(float(FAN)), F.col("level"))).cast("long")
    steps = steps.select("tree", F.col("place").alias("start"), "level", own.alias("own"), F.floor(own / FAN).cast("long").alias("place"))
    met = steps.join(families, ["tree", "level", "place"])
    beside = lambda keep: F.array_join(F.transform(F.filter("children", keep), lambda c: c["node"]), "")
    return met.select("tree", F.col("start").alias("place"), "level", beside(lambda c: c["place"] < F.col("own")).alias("before"), beside(lambda c: c["place"] > F.col("own")).alias("after"))


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _levels(leaves: list[str], most: int) -> list[list[str]]:
    """The leaves and the ``most`` levels above them."""
    out = [leaves]
    for _ in range(most):
        out.append([_hash("".join(out[-1][k : k + FAN])) for k in range(0, len(out[-1]), FAN)])
    return out


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each block in turn, of batches sorted by tree and block."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        tree, block = batch["tree"].to_numpy(), batch["block"].to_numpy()
        cuts = (np.flatnonzero((np.diff(tree) != 0) | (np.diff(block) != 0)) + 1).tolist()
        for start, end in zip([0, *cuts], [*cuts, batch.num_rows]):
            if held and last != (tree[start], block[start]):
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(start, end - start))
            last = tree[start], block[start]
    if held:
        yield pa.Table.from_batches(held)


def _reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _blocks(batches):
        top = _levels(rows["leaf"].to_pylist(), rows["local"][0].as_py())[-1][0]
        yield pa.RecordBatch.from_arrays([rows["tree"][:1].combine_chunks(), rows["block"][:1].combine_chunks(), pa.array([top])], names=["tree", "block", "node"])


def _fold(proofs: bool):
    def run(rows: pa.Table) -> pa.RecordBatch:
        part = rows["part"].to_numpy()
        outer, rows = rows.slice(0, int((part < 2).sum())), rows.slice(int((part < 2).sum())).combine_chunks()
        local = _levels(rows["leaf"].to_pylist(), rows["local"][0].as_py())
        beyond = list(zip(outer["before"].to_pylist(), outer["after"].to_pylist(), strict=True))
        own = int((part == 0).sum())
        node, ups = local[-1][0], []
        for before, after in beyond:
            ups.append(node)
            node = _hash(before + node + after)
        ups.append(node)
        above = "".join(b + a for b, a in beyond)
        hashed, folded, paths = [], [], []
        for k, claimed in enumerate(rows["claimed"].to_pylist()):
            steps, at = [], k
            for level in local[:-1]:
                first = at - at % FAN
                steps.append(("".join(level[first:at]), "".join(level[at + 1 : first + FAN])))
                at //= FAN
            for before, after in steps + beyond:
                claimed = _hash(before + claimed + after)
            folded.append(claimed)
            hashed.append(_hash("".join(b + a for b, a in steps) + above))
            if proofs:
                paths.append([{"before": b, "after": a} for b, a in steps + beyond])
        out = {"__key": rows["__key"], "leaf": rows["leaf"], "subroot": [ups[own]] * len(rows), "root": [ups[-1]] * len(rows), "proof_sha256": hashed, "folded_root": folded}
        if proofs:
            out["proof"] = pa.array(paths, pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())])))
        return pa.table(out).combine_chunks().to_batches()[0]

    return lambda batches: map(run, _blocks(batches))


def _by_block(rows: DataFrame, *order: str) -> DataFrame:
    return rows.repartition("tree", "block").sortWithinPartitions("tree", "block", *order)


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, claimed: dict[str, Column] | None = None, tree: str = "lang", key: str = "doc_id", proofs: bool = False) -> DataFrame:
    """(key, leaf, subroot, root, proof_sha256, folded_root, verified[, proof]) for every row.

    A leaf is the hash of ``fields``; the rows of each value of ``tree`` form a tree in the order of ``key``, nulls first, equal keys by their
    leaf; the trees' roots, by value, nulls first and bytewise, form the last one. ``claimed`` replaces columns in what is verified: the leaf of
    such a row, folded with the siblings as they are, must give the root. Null and repeated keys are rows like any other; null values are ``-``;
    columns that are not named do not count; an empty table gives no rows. With ``proofs`` the siblings of each level are given as well.
    """
    values = [F.col(c) for c in fields]
    changed = [(claimed or {}).get(c, F.col(c)) for c in fields]
    kind = dict(docs.dtypes)[key]
    first = docs.select(F.col(tree).alias("__tree"), F.col(key).alias("__key"), leaf(values).alias("leaf"), (leaf(changed) if claimed else F.lit(None).cast("string")).alias("claimed"))
    rows = numbered(settle(first.withColumn("claimed", F.coalesce("claimed", "leaf")), "leaves"), "__tree", "__key", "leaf", "claimed")
    trees = rows.groupBy("__tree").agg(F.min("place").alias("start"), F.count("*").alias("n"))
    trees = settle(numbered(trees, "__tree").select("__tree", F.col("place").alias("tree"), "start", height(F.col("n")).alias("height")), "trees")
    met = rows.join(trees, rows["__tree"].eqNullSafe(trees["__tree"])).withColumn("place", F.col("place") - F.col("start"))
    local = F.least("height", F.lit(DEPTH))
    leaves = settle(met.select("tree", F.floor(F.col("place") / SPAN).cast("long").alias("block"), "place", "__key", "leaf", "claimed", local.alias("local")), "blocks")

    blocks = _by_block(leaves.select("tree", "block", "place", "leaf", "local"), "place").mapInArrow(_reduce, "tree long, block long, node string")
    nodes = settle(blocks.join(trees.select("tree", (F.col("height") - F.least("height", F.lit(DEPTH))).alias("up")), "tree").select("tree", F.col("block").alias("place"), "node", "up"), "nodes")
    families, tops = upper(nodes)
    levels = trees.agg(height(F.count("*"))).first()[0]
    subroots = tops.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("place"), "node", F.lit(levels).alias("up"))
    over, _ = upper(settle(subroots, "subroots"))
    inner = siblings(nodes.where("up > 0").select("tree", "place", "up"), families).withColumn("part", F.lit(0))
    outmost = siblings(subroots.where("up > 0").select("tree", "place", "up"), over).select(F.col("place").alias("tree"), "level", "before", "after")
    outer = inner.unionByName(nodes.select("tree", "place").join(outmost, "tree").withColumn("part", F.lit(1))).withColumnRenamed("place", "block")

    schema = f"__key {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string" + (", proof array<struct<before:string,after:string>>" if proofs else "")
    # outer nodes come before the leaves of their block, from the lowest up: of the tree (part 0), then of the tree over the trees (1)
    both = leaves.withColumn("part", F.lit(2)).unionByName(outer.select("tree", "block", "part", F.col("level").cast("long").alias("place"), "before", "after"), allowMissingColumns=True)
    folded = _by_block(both, "part", "place").mapInArrow(_fold(proofs), schema)
    return folded.withColumn("verified", F.col("folded_root") == F.col("root")).withColumnRenamed("__key", key)


def tampered_text() -> Column:
    """The text, lower-cased (A-Z) where 3 divides the checksum of the id."""
    return F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, fold_case(F.col("text"))).otherwise(F.col("text"))
