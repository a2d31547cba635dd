"""Merkle manifest of a table, in blocks laid out after van Emde Boas.

Rows are leaves, in order per group; every ``fanout`` nodes become one node, until a
group has one; the groups' nodes make the root the same way. A tree is stored in
blocks, aligned subtrees of ``fanout ** levels`` leaves. Inside a block the nodes
lie in van Emde Boas order: the upper half of the levels first, then the subtrees
below it one after the other, each half split again. A node's place is plain
arithmetic on its depth and index, so building a block and finding siblings in it
touch few cache lines whatever their size. The roots of blocks are the leaves of
the next round of blocks; siblings are handed down the same rounds.

Spark does the ordering, the numbering and the shuffles; no task holds more than
some blocks and nothing but counts of rows reaches the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayfare.llm.common import in_batches, written

FANOUT = 16
#: Levels of edges in a block: 4,096 leaves, 140 KB of digests.
LEVELS = 3
DIGEST = 32
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


# One block


@cache
def tree_size(levels: int, fanout: int) -> int:
    """Nodes of a full tree with so many levels of nodes."""
    return sum(fanout**i for i in range(levels))


def addresses(levels: int, depth: int, index: np.ndarray, fanout: int) -> np.ndarray:
    """Cells of the nodes ``index`` at ``depth`` (0: the root) of a tree with so many levels of nodes."""
    if levels == 1:
        return np.zeros_like(index)
    upper = levels // 2
    if depth < upper:
        return addresses(upper, depth, index, fanout)
    lower, width = levels - upper, fanout ** (depth - upper)
    subtree = tree_size(upper, fanout) + index // width * tree_size(lower, fanout)
    return subtree + addresses(lower, depth - upper, index % width, fanout)


@cache
def _cells_by_depth(levels: int, fanout: int) -> list[np.ndarray]:
    return [addresses(levels, d, np.arange(fanout**d), fanout) for d in range(levels)]


def digest_of(children: bytes) -> bytes:
    """The node above ``children``: sha256 of their digests as hex text."""
    return hashlib.sha256(children.hex().encode()).digest()


class Block:
    """An aligned subtree over ``n`` leaves; cells behind the last node in use are not stored."""

    def __init__(self, n: int, levels: int, fanout: int, cells: bytes | None = None):
        self.fanout, self.bottom = fanout, levels - 1
        self.counts = [-(-n // fanout ** (self.bottom - d)) for d in range(levels)]
        self.at = _cells_by_depth(levels, fanout)
        used = max(int(at[k - 1]) for at, k in zip(self.at, self.counts)) + 1
        self.cells = np.zeros((used, DIGEST), np.uint8) if cells is None else np.frombuffer(cells, np.uint8).reshape(used, DIGEST)
        self._steps: dict[tuple[int, int], list[bytes]] = {}

    @classmethod
    def build(cls, leaves: Sequence[bytes], levels: int, fanout: int) -> Block:
        block = cls(len(leaves), levels, fanout)
        block.cells[block.at[block.bottom][: len(leaves)]] = np.frombuffer(b"".join(leaves), np.uint8).reshape(-1, DIGEST)
        for depth in range(block.bottom - 1, -1, -1):
            for i in range(block.counts[depth]):
                first = i * fanout
                block.cells[block.at[depth][i]] = np.frombuffer(digest_of(block.nodes(depth + 1, first, first + fanout)), np.uint8)
        return block

    def nodes(self, depth: int, first: int, end: int) -> bytes:
        return self.cells[self.at[depth][first : min(end, self.counts[depth])]].tobytes()

    def root(self) -> bytes:
        return self.nodes(0, 0, 1)

    def leaf(self, index: int) -> bytes:
        return self.nodes(self.bottom, index, index + 1)

    def steps(self, depth: int, index: int) -> list[bytes]:
        """Siblings left and right of a node, of the node above it, and so on to the block's root."""
        if depth == 0:
            return []
        found = self._steps.get((depth, index))
        if found is None:
            first = index - index % self.fanout
            run = self.nodes(depth, first, first + self.fanout)
            cut = (index - first) * DIGEST
            found = [run[:cut], run[cut + DIGEST :], *self.steps(depth - 1, index // self.fanout)]
            if depth < self.bottom:  # shared by the leaves below
                self._steps[depth, index] = found
        return found


def levels_of(n: int, levels: int, fanout: int) -> int:
    """Levels of nodes in the blocks of a tree over ``n`` nodes: a tree of one block is no higher than it must be."""
    height = 0
    while height < levels and fanout**height < n:
        height += 1
    return height + 1


def folded(node: bytes, steps: Sequence[bytes]) -> bytes:
    """The root that a leaf and the siblings on its way up give."""
    for left, right in zip(steps[::2], steps[1::2]):
        node = digest_of(left + node + right)
    return node


def block_leaves(n: int, block: int, levels: int, fanout: int) -> int:
    return min(fanout**levels, n - block * fanout**levels)


# Leaves and their order


def leaf_of(row: Sequence[Column]) -> Column:
    """The digest of a row: each field as its length in UTF-8 bytes, a colon and its text, or ``-`` for NULL."""
    texts = [c.cast("string") for c in row]
    parts = [F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def numbered(rows: DataFrame, within: Sequence[str], order: Sequence[str], groups: DataFrame | None = None) -> DataFrame:
    """``rows`` with ``place``, from 0, by ``order`` among the rows that agree on ``within`` (NULLs first).

    One sort by range; a place is the row's number in its task's share of the group
    plus the shares before it, so a group may span any number of tasks. Equal rows
    are told apart by where they were read, so that many of them are split too.
    ``groups`` has further columns for a group; they meet its shares, not its rows.
    """
    tied = rows.withColumn("_tie", F.monotonically_increasing_id())
    marks = F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_mark")
    marked = written(tied.orderBy(*within, *order, "_tie").drop("_tie").select("*", *marks))
    shares = marked.groupBy(*within, "_part").agg(F.min("_mark").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    before = F.sum("_rows").over(W.partitionBy(*within).orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    shift = F.coalesce(before, F.lit(0)) - F.col("_first")
    shares = shares.select(*(F.col(c).alias(f"_of_{c}") for c in within), F.col("_part").alias("_of_part"), shift.alias("_shift"))
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in within]
    more = []
    if groups is not None:
        more = [c for c in groups.columns if c not in within]
        named = groups.withColumnsRenamed({c: f"_group_{c}" for c in within})
        shares = shares.join(named, [F.col(f"_of_{c}").eqNullSafe(F.col(f"_group_{c}")) for c in within])
    joined = marked.join(shares, [*same, F.col("_part") == F.col("_of_part")])
    return joined.select(*rows.columns, *more, (F.col("_mark") + F.col("_shift")).alias("place"))


# Rounds of blocks


def _blocks(nodes: DataFrame, levels: int, fanout: int, carried: Sequence[str] = ()) -> DataFrame:
    """tree, n, block, root, cells and the lists ``carried`` of every block.

    ``nodes`` has tree, n (nodes of the tree), place, digest and ``carried``.
    """
    size = fanout**levels
    kinds = {f.name: f.dataType.simpleString() for f in nodes.schema}
    items = F.sort_array(F.collect_list(F.struct("place", "digest", *carried)))
    grouped = nodes.groupBy("tree", "n", F.floor(F.col("place") / size).alias("block")).agg(items.alias("items"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                items = batch.column("items").slice(i, 1).flatten()
                n = batch.column("n")[i].as_py()
                block = Block.build(items.field("digest").to_pylist(), levels_of(n, levels, fanout), fanout)
                lists = {c: pa.ListArray.from_arrays(pa.array([0, len(items)], pa.int32()), items.field(c)) for c in carried}
                yield pa.RecordBatch.from_pydict(
                    {
                        **{c: batch.column(c).slice(i, 1) for c in ("tree", "n", "block")},
                        "root": pa.array([block.root()], pa.binary()),
                        "cells": pa.array([block.cells.tobytes()], pa.binary()),
                        **lists,
                    }
                )

    schema = "tree long, n long, block long, root binary, cells binary" + "".join(f", {c} array<{kinds[c]}>" for c in carried)
    return written(in_batches(grouped, build, schema))


def _rounds(nodes: DataFrame, most: int, levels: int, fanout: int, carried: Sequence[str] = ()) -> list[DataFrame]:
    """Blocks over ``nodes``, blocks over their roots, and so on; ``most``: nodes of the largest tree."""
    size = fanout**levels
    rounds = [_blocks(nodes, levels, fanout, carried)]
    while most > size:
        most = -(-most // size)
        above = rounds[-1].filter(F.col("n") > size)
        roots = above.select("tree", F.ceil(F.col("n") / size).alias("n"), F.col("block").alias("place"), F.col("root").alias("digest"))
        rounds.append(_blocks(roots, levels, fanout))
    return rounds


def _roots(rounds: Sequence[DataFrame], levels: int, fanout: int) -> DataFrame:
    """tree, digest: the last node of every tree."""
    found = [r.filter(F.col("n") <= fanout**levels).select("tree", F.col("root").alias("digest")) for r in rounds]
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


_WAY = "steps array<binary>, subroot binary, top binary"


def _handed_down(rounds: Sequence[DataFrame], outer: DataFrame, levels: int, fanout: int) -> DataFrame:
    """The first round's blocks with the siblings above them.

    ``outer`` says for every tree which siblings lie above its root (``steps``, two
    entries a level) and which ``subroot`` and ``top`` it belongs to.
    """
    size = fanout**levels
    here = None
    for blocks in reversed(rounds):
        last = blocks.filter(F.col("n") <= size).select("tree", "block").join(outer, "tree")
        way = last if here is None else last.unionByName(here)
        joined = blocks.join(way, ["tree", "block"])
        if blocks is not rounds[0]:
            here = written(_children(joined, levels, fanout).select("tree", F.col("place").alias("block"), "steps", "subroot", "top"))
    return joined


def _children(blocks: DataFrame, levels: int, fanout: int) -> DataFrame:
    """tree, place, digest, steps, subroot and top of every leaf of ``blocks``."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(block_leaves(row["n"], row["block"], levels, fanout), levels_of(row["n"], levels, fanout), fanout, row["cells"])
                count, first = block.counts[-1], row["block"] * fanout**levels
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["tree"]] * count, pa.int64()),
                        pa.array(range(first, first + count), pa.int64()),
                        pa.array([block.leaf(i) for i in range(count)], pa.binary()),
                        pa.array([block.steps(block.bottom, i) + row["steps"] for i in range(count)], pa.list_(pa.binary())),
                        pa.array([row["subroot"]] * count, pa.binary()),
                        pa.array([row["top"]] * count, pa.binary()),
                    ],
                    names=["tree", "place", "digest", "steps", "subroot", "top"],
                )

    slim = blocks.select("tree", "n", "block", "cells", "steps", "subroot", "top")
    return in_batches(slim, spread, f"tree long, place long, digest binary, {_WAY}")


def _proofs(blocks: DataFrame, kind: str, levels: int, fanout: int) -> DataFrame:
    """The result rows of all leaves; the upper steps of a run of leaves are put together once."""

    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in ("n", "block", "cells", "steps", "subroot", "top", "told")}
                block = Block(block_leaves(row["n"], row["block"], levels, fanout), levels_of(row["n"], levels, fanout), fanout, row["cells"])
                leaves, proofs, roots = [], [], []
                upper, text = [], b""
                for k, told in enumerate(row["told"]):
                    own = block.steps(block.bottom, k)[:2]
                    if k % fanout == 0:
                        upper = block.steps(block.bottom - 1, k // fanout) + row["steps"] if block.bottom else row["steps"]
                        text = b"".join(upper).hex().encode()
                    leaf = block.leaf(k)
                    leaves.append(leaf.hex())
                    proofs.append(hashlib.sha256(b"".join(own).hex().encode() + text).hexdigest())
                    roots.append(folded(leaf if told is None else told, own + upper).hex())
                count, top = len(leaves), row["top"].hex()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(i, 1).flatten(),
                        pa.array(leaves),
                        pa.array([row["subroot"].hex()] * count),
                        pa.array([top] * count),
                        pa.array(proofs),
                        pa.array(roots),
                        pa.array([r == top for r in roots]),
                    ],
                    names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"],
                )

    schema = f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return in_batches(blocks, prove, schema)


def manifest(documents: DataFrame, told: Column | None = None, levels: int = LEVELS, fanout: int = FANOUT) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row.

    Needs the columns ``FIELDS``; other columns are ignored. ``told`` is the digest
    that a row claims to have (binary; NULL or not given: its own): ``folded_root``
    is what it gives with the row's siblings, ``verified`` whether that is the root.

    Rows lie by source, NULL first, then doc_id, NULL first, then digest. Equal
    rows are leaves of their own with one digest; which of them gets which place
    shows in no column but the proof. NULL and empty texts are different fields. A
    source of one row has its leaf as subroot; with one source the root is its
    subroot. No rows give none.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()
    claim = F.lit(None).cast("binary") if told is None else told
    leaves = written(documents.select("doc_id", "source", leaf_of([F.col(c) for c in FIELDS]).alias("digest"), claim.alias("told")))
    sources = numbered(leaves.groupBy("source").agg(F.count(F.lit(1)).alias("n")), [], ["source"])
    sources = written(sources.withColumnRenamed("place", "tree"))
    totals = sources.agg(F.count(F.lit(1)).alias("sources"), F.max("n").alias("most")).first()
    if not totals["sources"]:
        none = documents.sparkSession.createDataFrame([], f"n long, block long, cells binary, doc_id array<{kind}>, told array<binary>, {_WAY}")
        return _proofs(none, kind, levels, fanout)
    nodes = numbered(leaves, ["source"], ["doc_id", "digest"], sources)
    rounds = _rounds(nodes.select("tree", "n", "place", "digest", "doc_id", "told"), totals["most"], levels, fanout, ["doc_id", "told"])
    subroots = _roots(rounds, levels, fanout).select(
        F.lit(0).cast("long").alias("tree"), F.lit(totals["sources"]).cast("long").alias("n"), F.col("tree").alias("place"), "digest"
    )
    upper = _rounds(subroots, totals["sources"], levels, fanout)
    nothing = F.array().cast("array<binary>").alias("steps"), F.lit(None).cast("binary").alias("subroot")
    top = _roots(upper, levels, fanout).select("tree", *nothing, F.col("digest").alias("top"))
    ways = _children(_handed_down(upper, top, levels, fanout), levels, fanout)
    ways = written(ways.select(F.col("place").alias("tree"), "steps", F.col("digest").alias("subroot"), "top"))
    return _proofs(_handed_down(rounds, ways, levels, fanout), kind, levels, fanout)
