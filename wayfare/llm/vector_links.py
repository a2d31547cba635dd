"""Near-duplicate vectors by NN-descent.

Equal vectors form one node. Forests of random hyperplane codes, more of them the
longer the codes, give every node a first list of neighbours; rounds of NN-descent
then compare the neighbours of each node with one another and keep what is nearer,
until a round brings no new link. A list that is full of links is saturated: there is more than it holds. Lists
of saturated nodes are enlarged, twice the room at a time up to ``LARGEST``, and
filled by rounds over their neighbourhoods alone. Components with more links at a node than
``NEIGHBOURS`` are counted in whole, block by block, and only counts leave a block;
their full nodes also search the other components, in leaves that are not cut, until no link joins two. Links
are confirmed in double precision. An audit against brute force tells the recall;
while it is short, forests of new planes go on, and when these bring nothing more,
all nodes are compared block by block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.llm.common import in_batches, ship, written
from wayfare.llm.components import components

COSINE = 0.9
#: Half-precision similarities are off by less than this; what they let through is confirmed.
MARGIN = 0.005
NEIGHBOURS = 8
#: Entries of a list that has been enlarged as far as it may be.
LARGEST = 32
#: Trees of one forest; ``forests_for`` tells how many forests a table needs.
TREES = 12
LEAF = 48
BLOCK = 512
#: Rows of many small groups that one call of Python compares.
BUNDLE_ROWS = 6000
#: A round that adds a smaller share of links than this is the last of its forest.
SETTLED = 0.002
#: Forests in a row that have to bring no link between saturated components, at least.
QUIET = 2
#: Nodes audited of each stratum with links; of those without, four times as many.
AUDIT_ROWS = 256
AUDIT_RECALL = 0.97
_PAIR = "u long, v long, s float"


def _stacked(vectors, kind=np.float16) -> np.ndarray:
    """Rows of one width; shorter vectors are filled up with zeros (see ``_similar``)."""
    sizes = set(map(len, vectors))
    if len(sizes) == 1:
        out = np.frombuffer(b"".join(vectors), kind).reshape(len(vectors), -1)
        return out.astype(np.float32) if kind == np.float16 else out
    rows = [np.frombuffer(x, kind) for x in vectors]
    width = max(map(len, rows))
    out = np.zeros((len(rows), width), np.float32 if kind == np.float16 else kind)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _similar(left, right=None, kind=np.float16) -> np.ndarray:
    """Cosines of unit vectors; -2 between vectors of different length."""
    right = left if right is None else right
    a = _stacked(left, kind)
    b = a if right is left else _stacked(right, kind)
    width = max(a.shape[1], b.shape[1])
    if a.shape[1] == b.shape[1] and len({len(x) for y in (left, right) for x in y}) == 1:
        return a @ b.T
    out = np.pad(a, ((0, 0), (0, width - a.shape[1]))) @ np.pad(b, ((0, 0), (0, width - b.shape[1]))).T
    sizes = np.array([len(x) for x in left])[:, None] == np.array([len(x) for x in right])
    return out if sizes.all() else np.where(sizes, out, -2)


def nodes_of(embeddings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The first two results of ``named_nodes``."""
    return named_nodes(embeddings)[:2]


def named_nodes(embeddings: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Nodes (id, copies, v, exact) of distinct valid vectors, and vec_id with its node (NULL if invalid).

    A node is known by the smallest vec_id of its vector. Where several vectors bear
    one id, or ids are no integers, nodes are numbered in the order of that id, and
    the third result says which id a number stands for.
    """
    plain = F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0))  # -0.0 becomes 0.0
    good = F.coalesce(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0), F.lit(False))
    rows = embeddings.select("vec_id", F.when(good & F.col("vec_id").isNotNull(), plain).alias("vector"))
    sums = rows.filter(F.col("vector").isNotNull()).groupBy("vector").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"))

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            exact = []
            for vector in batch.column("vector").to_pylist():
                x = np.array(vector)
                x = x / np.abs(x).max()
                exact.append(x / np.sqrt((x * x).sum()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("copies"), pa.array([x.astype(np.float16).tobytes() for x in exact], pa.binary()), pa.array([x.tobytes() for x in exact], pa.binary())],
                names=["id", "copies", "v", "exact"],
            )

    distinct = written(sums)
    names = None
    whole = dict(embeddings.dtypes)["vec_id"] in ("tinyint", "smallint", "int", "bigint")
    if not whole or not distinct.groupBy("id").count().filter("count > 1").isEmpty():
        ordered = distinct.orderBy("id", "vector").withColumn("number", F.monotonically_increasing_id())
        distinct = written(ordered.select(F.col("number").alias("id"), "copies", "vector", F.col("id").alias("named")))
        names = distinct.select(F.col("id").alias("component"), "named")
    nodes = written(in_batches(distinct.select(F.col("id").cast("long"), "copies", "vector"), unit, "id long, copies long, v binary, exact binary"))
    members = rows.join(distinct.select("vector", F.col("id").alias("node")), "vector", "left").select("vec_id", "node")
    return nodes, members, names


def _bits(count: int) -> int:
    return max(1, int(np.ceil(np.log2(max(2, count / LEAF)))))


def forests_for(count: int) -> int:
    """Forests in which a pair of cosine ``COSINE`` shares a leaf with a chance of ``AUDIT_RECALL`` or more."""
    chance = (1 - np.arccos(COSINE) / np.pi) ** _bits(count)
    return int(np.ceil(np.log(1 - AUDIT_RECALL) / np.log1p(-chance) / TREES))


def _coded(nodes: DataFrame, bits: int, trees: int, seed: int) -> DataFrame:
    """tree, code and the columns of ``nodes``: one row per node and tree, the code being its sides of random hyperplanes."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _stacked(batch.column("v").to_pylist())
            if x.shape[1] not in planes:
                planes[x.shape[1]] = np.random.default_rng([97, seed % (1 << 32)]).standard_normal((x.shape[1], bits * trees)).astype(np.float32)
            sides = (x @ planes[x.shape[1]] > 0).reshape(len(x), trees, bits)
            codes = (sides * (1 << np.arange(bits, dtype=np.int64))).sum(axis=2)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(codes), pa.list_(pa.int64()))], names=[*batch.schema.names, "codes"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in nodes.schema)
    coded = written(in_batches(nodes, code, f"{schema}, codes array<long>"))
    return coded.select(*nodes.columns, F.posexplode("codes").alias("tree", "code"))


def _leaves(nodes: DataFrame, count: int, trees: int, seed: int) -> DataFrame:
    """tree, code, part and the columns of ``nodes``: one row per node and tree.

    A leaf is the nodes of one code. Larger leaves are dealt out to parts of about
    LEAF nodes, by another hash for each ``seed``.
    """
    rows = _coded(nodes, _bits(count), trees, seed)
    sizes = rows.groupBy("tree", "code").agg(F.ceil(F.count("*") / (1.5 * LEAF)).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("id", "tree", F.lit(seed)), F.col("parts")).alias("part")
    return rows.join(sizes, ["tree", "code"]).select("tree", "code", part, *nodes.columns)


def _nearest(frame: pd.DataFrame, k: int) -> pd.DataFrame:
    """For each node of each ``group`` its ``k`` nearest others there, above its ``floor`` if it has one.

    Nodes of one ``component`` are no neighbours, where the frame has that column.
    """
    frame = frame.sort_values("group", kind="stable")
    every, vectors, groups = frame["id"].to_numpy(), frame["v"].to_numpy(), frame["group"].to_numpy()
    floors = frame["floor"].to_numpy() if "floor" in frame else np.full(len(every), -1.5, np.float32)
    components_ = frame["component"].to_numpy() if "component" in frame else every
    starts = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]]))
    out_u, out_v, out_s = [], [], []
    for a, b in zip(starts, [*starts[1:], len(every)]):
        take = min(k, b - a - 1)
        if take <= 0:
            continue
        ids, own = every[a:b], components_[a:b]
        s = _similar(vectors[a:b])
        s[own[:, None] == own] = -3
        best = np.argpartition(-s, take - 1, axis=1)[:, :take]
        scores = np.take_along_axis(s, best, axis=1)
        keep = (scores > np.maximum(floors[a:b], -1.5)[:, None]).ravel()
        out_u.append(np.repeat(ids, take)[keep]), out_v.append(ids[best.ravel()][keep]), out_s.append(scores.ravel()[keep])
    if not out_u:
        return pd.DataFrame({"u": [], "v": [], "s": []})
    return pd.DataFrame({"u": np.concatenate(out_u), "v": np.concatenate(out_v), "s": np.concatenate(out_s)})


def _compared(rows: DataFrame, keys: list[str], size: int, k: int) -> DataFrame:
    """``_nearest`` of the groups named by ``keys``, with ``size`` rows or so in a call of Python."""
    bundles = max(1, size // BUNDLE_ROWS)
    group = F.xxhash64(*keys)
    placed = rows.withColumn("group", group).withColumn("bundle", F.pmod(F.xxhash64("group"), F.lit(bundles))).drop(*keys)
    return placed.groupBy("bundle").applyInPandas(lambda f: _nearest(f, k), _PAIR)


def _kept(pairs: DataFrame, k: int, room: int) -> DataFrame:
    """u, near: the ``k`` nearest distinct neighbours of each node, and links beyond them up to ``room`` entries."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # before the shuffle: what a batch has beyond that for a node can't be kept
            f = batch.to_pandas().drop_duplicates(["u", "v"]).sort_values(["u", "s", "v"], ascending=[True, False, True])
            place = f.groupby("u").cumcount()
            keep = (place < k) | ((place < room) & (f["s"] >= COSINE - MARGIN))
            yield pa.RecordBatch.from_pandas(f[keep], schema=batch.schema, preserve_index=False)

    best = F.slice(F.sort_array(F.collect_set(F.struct("s", "v")), asc=False), 1, room)
    near = F.filter(best, lambda n, place: (place < k) | (n["s"] >= COSINE - MARGIN))
    return in_batches(pairs, cut, _PAIR).groupBy("u").agg(near.alias("near"))


def _saturated(lists: DataFrame, room: int) -> DataFrame:
    """id of the nodes whose list holds ``room`` entries or more, all of them links."""
    full = (F.size("near") >= room) & (F.element_at("near", -1)["s"] >= COSINE - MARGIN)
    return lists.filter(full).select(F.col("u").alias("id"))


def with_forest(lists: DataFrame | None, nodes: DataFrame, count: int, seed: int, k: int = NEIGHBOURS, room: int = NEIGHBOURS) -> DataFrame:
    """``lists``, if any, with what the leaves of one more forest bring."""
    leaves = _leaves(nodes.select("id", "v"), count, TREES, seed)
    found = _compared(leaves, ["tree", "code", "part"], count * TREES, k)
    return _kept(found if lists is None else found.unionByName(_flat(lists)), k, room)


def _flat(lists: DataFrame) -> DataFrame:
    return lists.select("u", F.explode("near").alias("n")).select("u", "n.v", "n.s")


def descend(lists: DataFrame, nodes: DataFrame, count: int, k: int = NEIGHBOURS, room: int = NEIGHBOURS, growing: DataFrame | None = None) -> DataFrame:
    """One round: the neighbours of every node, both ways, are compared with one another.

    A node that many others name deals these out to parts of about LEAF, none is
    left out. Only pairs nearer than the farthest neighbour kept so far go on, or
    links where a list has room for them. With ``growing`` (id) only the nodes that
    have one of these for a neighbour compare theirs.
    """
    flat = lists.select("u", F.explode("near").alias("n")).select("u", "n.v")
    both = flat.unionByName(flat.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    if growing is not None:
        hubs = both.join(growing.select(F.col("id").alias("v")), "v", "left_semi").select("u").distinct()
        both = both.join(hubs, "u", "left_semi")
    degree = both.groupBy("u").agg(F.ceil(F.count("*") / (1.5 * LEAF)).cast("int").alias("parts"))
    last = F.element_at("near", -1)["s"]
    floor = F.when(F.size("near") >= room, last).when(F.size("near") >= k, F.least(last, F.lit(COSINE - MARGIN))).otherwise(F.lit(-2.0))
    known = nodes.select("id", "v").join(lists.select(F.col("u").alias("id"), floor.cast("float").alias("floor")), "id")
    around = both.join(degree, "u").select(F.col("u").alias("hub"), F.pmod(F.xxhash64("v"), F.col("parts")).alias("part"), F.col("v").alias("id")).join(known, "id")
    found = _compared(around, ["hub", "part"], 2 * k * count, room)
    return _kept(found.unionByName(_flat(lists)), k, room)


def settled(lists: DataFrame, nodes: DataFrame, count: int, k: int = NEIGHBOURS, room: int = NEIGHBOURS, growing: DataFrame | None = None) -> DataFrame:
    """``lists`` after rounds of ``descend`` until one brings hardly a link."""
    seen = -1
    while (links := _links(lists).count()) > seen * (1 + SETTLED):
        seen = links
        lists = written(descend(lists, nodes, count, k, room, growing))
    return lists


def enlarged(lists: DataFrame, nodes: DataFrame, count: int, k: int = NEIGHBOURS, largest: int = LARGEST) -> DataFrame:
    """``lists`` with twice the room for saturated nodes, and again, until none is saturated or they hold ``largest``."""
    room = k
    while room < largest:
        growing = written(_saturated(lists, room))
        if growing.isEmpty():
            break
        room = min(2 * room, largest)
        lists = settled(lists, nodes, count, k, room, growing)
    return lists


def _confirmed(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """a, b with a > b of pairs whose cosine in double precision is a link."""
    once = pairs.select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).distinct()
    exact = nodes.select("id", "exact")
    both = once.join(exact.select(F.col("id").alias("a"), F.col("exact").alias("x")), "a").join(exact.select(F.col("id").alias("b"), F.col("exact").alias("y")), "b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [len(x) == len(y) and float(np.frombuffer(x) @ np.frombuffer(y)) >= COSINE for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return in_batches(both.select("a", "b", "x", "y"), check, "a long, b long")


def _links(lists: DataFrame) -> DataFrame:
    return _flat(lists).filter(F.col("s") >= COSINE - MARGIN)


def _across(searched: DataFrame, count: int, k: int, seed: int) -> DataFrame:
    """Candidate links between nodes of different components among the ``count`` rows of ``searched`` (id, v, component).

    No leaf of the forest ``seed`` is cut: its nodes go to blocks of about BLOCK, those
    of a component of BLOCK nodes or more there to blocks of its own, and all blocks
    meet but two of one component.
    """
    rows = _coded(searched, _bits(count), TREES, seed)
    sizes = written(rows.groupBy("tree", "code", "component").agg(F.count("*").alias("n")))
    large = F.col("n") >= BLOCK
    leaf = sizes.groupBy("tree", "code").agg(F.count("*").alias("kinds"), F.sum(F.when(~large, F.col("n"))).alias("rest")).filter("kinds > 1")
    placed = sizes.join(leaf, ["tree", "code"]).select(
        "tree", "code", "component", F.when(large, F.col("component")).alias("owner"), F.ceil(F.when(large, F.col("n")).otherwise(F.col("rest")) / BLOCK).cast("int").alias("blocks")
    )
    block = F.xxhash64("owner", "part").alias("block")
    parts = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("part")
    blocks = placed.select("tree", "code", "owner", "blocks").distinct().select("tree", "code", "owner", parts).select("tree", "code", "owner", block)
    left, right = (blocks.select("tree", "code", F.col("owner").alias(f"{x}_owner"), F.col("block").alias(x)) for x in "ij")
    apart = F.coalesce(F.col("i_owner") != F.col("j_owner"), F.lit(True))  # blocks of several components also meet themselves
    pairs = written(left.join(right, ["tree", "code"]).filter((F.col("i") <= F.col("j")) & apart).select("tree", "code", "i", "j"))
    sides = pairs.select("tree", "code", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    part = F.pmod(F.xxhash64("id", F.lit(seed)), F.col("blocks")).cast("int").alias("part")
    dealt = rows.join(placed, ["tree", "code", "component"]).select("tree", "code", "id", "v", "component", "owner", part)
    spread = dealt.select("tree", "code", "id", "v", "component", block).join(sides, ["tree", "code", "block"]).drop("block")
    return _compared(spread, ["tree", "code", "i", "j"], pairs.count() * BLOCK, k).filter(F.col("s") >= COSINE - MARGIN)


def _counts_in_whole(component: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, linked: how many vectors each node of ``component`` (node, component) is linked with there.

    Blocks of about BLOCK nodes meet one another; a block pair gives one count per node.
    """
    sizes = component.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    placed = component.join(sizes, "component").join(nodes.select(F.col("id").alias("node"), "copies", "exact"), "node")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    spread = placed.withColumn("own", own).select("component", "node", "copies", "exact", "own", other)
    spread = spread.select("component", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "copies", "exact")

    def count(key, f):
        left, right = f[f["own"] == key[1]], f[f["own"] == key[2]]
        if not len(left) or not len(right):
            return pd.DataFrame({"id": [], "linked": []})
        near = _similar(list(left["exact"]), list(right["exact"]), np.float64) >= COSINE
        near &= left["node"].to_numpy()[:, None] != right["node"].to_numpy()
        out = [pd.DataFrame({"id": left["node"].to_numpy(), "linked": near @ right["copies"].to_numpy()})]
        if key[1] != key[2]:
            out.append(pd.DataFrame({"id": right["node"].to_numpy(), "linked": left["copies"].to_numpy() @ near}))
        return pd.concat(out)

    return spread.groupBy("component", "i", "j").applyInPandas(count, "id long, linked long").groupBy("id").agg(F.sum("linked").alias("linked"))


def audit(known: DataFrame, nodes: DataFrame, k: int = NEIGHBOURS, rows: int = AUDIT_ROWS) -> float:
    """Mean share of its links that a linked node has in ``known`` (node, copies, n_links), against brute force.

    Every linked node counts once, however many links it has. Nodes without a
    link, with few and with k or more are sampled apart (by hash) and weighted by
    how many there are; the smaller of the means of the nodes with few and with
    many true links is returned, and 1 if no sampled node has a link. Ids that
    several vectors bear are not sampled.
    """
    single = nodes.groupBy("id").agg(F.count("*").alias("n")).filter("n = 1").select(F.col("id").alias("node"))
    others = F.col("n_links") - F.col("copies") + 1
    strata = known.join(single, "node", "left_semi").select("node", others.alias("have"), F.when(others == 0, 0).when(others < k, 1).otherwise(2).alias("stratum"))
    sizes = {r.stratum: r.n for r in strata.groupBy("stratum").agg(F.count("*").alias("n")).collect()}
    weights, queries, have = {}, {}, {}
    for stratum, size in sizes.items():
        picked = strata.filter(F.col("stratum") == stratum).orderBy(F.xxhash64("node"), "node").limit(rows if stratum else 4 * rows)
        for r in picked.join(nodes.select(F.col("id").alias("node"), "exact"), "node").collect():
            queries[r.node], have[r.node] = bytes(r.exact), r.have
            weights[r.node] = size / min(size, rows if stratum else 4 * rows)
    if not queries:
        return 1.0
    ids = list(queries)
    sent = nodes.sparkSession.sparkContext.broadcast([queries[i] for i in ids])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, widths = np.zeros(len(ids), np.int64), np.array(list(map(len, sent.value)))
        asked = {w: np.stack([np.frombuffer(q) for q in sent.value if len(q) == w]) for w in set(widths.tolist())}
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                vectors, copies = part.column("exact").to_pylist(), np.asarray(part.column("copies"))
                lengths = np.array(list(map(len, vectors)))
                for w, q in asked.items():
                    if (mine := lengths == w).any():
                        near = q @ np.stack([np.frombuffer(x) for x in vectors if len(x) == w]).T >= COSINE + 1e-9  # what rounding decides is not missed
                        totals[widths == w] += near @ copies[mine]
        yield pa.RecordBatch.from_pydict({"at": pa.array(range(len(ids)), pa.int64()), "n": pa.array(totals, pa.int64())})

    true = in_batches(nodes.select("copies", "exact"), scan, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
    own = {r.id: r.copies for r in nodes.filter(F.col("id").isin(ids)).select("id", "copies").collect()}
    sums = {False: [0.0, 0.0], True: [0.0, 0.0]}
    for r in true:
        node, n = ids[r["at"]], r["n"] - own[ids[r["at"]]]
        if n > 0:
            total = sums[n >= k]
            total[0] += weights[node] * min(n, have[node]) / n
            total[1] += weights[node]
    sent.unpersist()
    return min((a / b for a, b in sums.values() if b), default=1.0)


def vector_links(embeddings: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``embeddings``.

    Needs vec_id and embedding; other columns are ignored. Vectors that are NULL,
    empty, zero or hold a NULL or non-finite component, and rows without vec_id,
    link with nothing; vectors of different length do not link either. Different
    vectors of one id are rows of their own, each with its links. Equal
    vectors link with one another; repeated rows count as so many vectors. The
    component is named by its smallest id; no rows give none.
    """
    ship(embeddings.sparkSession)
    nodes, members, names = named_nodes(embeddings)
    count = nodes.count()
    lists, recall, forests, known, links, room = None, 0.0, 0, None, -1, k
    while known is None or recall < AUDIT_RECALL:
        for _ in range(1 if known is not None else forests_for(count)):
            lists = written(with_forest(lists, nodes, count, forests, k, room))
            forests += 1
        lists = settled(lists, nodes, count, k, room)
        if room == k:
            lists, room = enlarged(lists, nodes, count, k), max(k, LARGEST)
        before, links = links, _links(lists).count()
        if links == before:
            known, recall = written(_by_blocks(nodes)), 1.0
            break
        known = written(_finished(lists, nodes, count, k))
        recall = audit(known, nodes, k)
    named = members.join(known.drop("copies"), "node", "left")
    if names is not None:
        named = named.join(names, "component", "left").drop("component").withColumnRenamed("named", "component")
    component = F.coalesce("component", "vec_id")
    result = named.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"))
    return result.withColumn("audit_recall", F.lit(float(recall)))


def _finished(lists: DataFrame, nodes: DataFrame, count: int, k: int) -> DataFrame:
    """node, copies, n_links, component of every node."""
    links = written(_confirmed(_links(lists), nodes))
    ends = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    full = written(_links(lists).groupBy("u").count().unionByName(ends.groupBy("u").count()).filter(F.col("count") >= k).select(F.col("u").alias("id")).distinct())
    found = written(components(links))
    # Saturated nodes may have links to other components that their lists had no room for.
    # They are searched by one new forest after the other, until as many as a link needs to be found bring none.
    room, quiet, seed = full.count(), 0, 0
    named = found.select(F.col("node").alias("id"), "component")
    while quiet < max(QUIET, forests_for(room)):
        searched = written(nodes.join(full, "id").join(named, "id", "left").select("id", "v", F.coalesce("component", "id").alias("component")))
        if searched.select("component").distinct().limit(2).count() < 2:
            break
        seed -= 1
        more = written(_confirmed(_across(searched, room, k, seed), nodes))
        quiet += 1
        if not more.isEmpty():
            quiet = 0
            links = written(links.unionByName(more).distinct())
            found = written(components(links))
            named = found.select(F.col("node").alias("id"), "component")
    ends = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    saturated = found.join(full.select(F.col("id").alias("node")), "node").select("component").distinct()
    whole = _counts_in_whole(found.join(saturated, "component"), nodes)
    weight = nodes.select(F.col("id").alias("v"), "copies")
    single = ends.join(weight, "v").groupBy(F.col("u").alias("id")).agg(F.sum("copies").alias("listed"))
    return (
        nodes.select("id", "copies")
        .join(single, "id", "left")
        .join(whole, "id", "left")
        .join(found.select(F.col("node").alias("id"), "component"), "id", "left")
        .select(F.col("id").alias("node"), "copies", (F.coalesce("linked", "listed", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component"))
    )


def _by_blocks(nodes: DataFrame) -> DataFrame:
    """The result of ``_finished`` from comparing all nodes in blocks, for tables whose links no forest finds.

    A pair of blocks gives the counts of its nodes, and one pair a node that says
    which nodes of the two hang together, so that no group of links leaves it whole.
    """
    blocks = max(1, int(np.ceil(nodes.count() / BLOCK)))
    own = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other")
    spread = nodes.select("id", "copies", "exact", own.alias("own")).select("*", other)
    spread = spread.select(F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "copies", "exact")

    def compare(key, f):
        f = f[(f["own"] == key[0]) | (f["own"] == key[1])]
        own, ids = f["own"].to_numpy(), f["id"].to_numpy()
        near = _similar(list(f["exact"]), None, np.float64) >= COSINE
        near &= ids[:, None] != ids
        if key[0] != key[1]:
            near &= own[:, None] != own
        group = ids.copy()
        while True:  # the smallest id reachable inside the block pair
            least = np.minimum(group, np.where(near, group, np.iinfo(np.int64).max).min(axis=1, initial=np.iinfo(np.int64).max))
            if (least == group).all():
                return pd.DataFrame({"id": ids, "linked": near @ f["copies"].to_numpy(), "group": group})
            group = least

    found = written(spread.groupBy("i", "j").applyInPandas(compare, "id long, linked long, group long"))
    linked = found.groupBy("id").agg(F.sum("linked").alias("linked"))
    edges = found.filter("id > `group`").select(F.col("id").alias("a"), F.col("group").alias("b")).distinct()
    named = components(written(edges)).select(F.col("node").alias("id"), "component")
    return (
        nodes.select("id", "copies")
        .join(linked, "id")
        .join(named, "id", "left")
        .select(F.col("id").alias("node"), "copies", (F.col("linked") + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component"))
    )
