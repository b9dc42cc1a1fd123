"""Near-duplicate vectors by NN-descent, with exact links inside what it connects.

Equal vectors are one class. Cells of random hyperplanes give each class its first
neighbours; then, round by round, every class is a pivot where its neighbours and those
that have it as neighbour meet, compare all their pairs and improve each other's lists
(neighbours of neighbours). Wherever vectors meet, pairs at or over the threshold also
leave a spanning forest, so that what is linked becomes connected although lists are
short. Inside a component all pairs are compared, block by block, in double precision.

A list that is full of links is saturated: it says nothing of what lies behind them. It
is enlarged to the vector's whole component, and a further list has the best neighbours
outside of it. These go through rounds of their own until none of them is linked.

An audit compares a bounded sample of vectors with all others. While the recall of its
vectors is below the target, further cells and rounds follow, and after the last attempt
all vectors are compared with all, block by block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, written
from .components import components

THRESHOLD = 0.9
NEIGHBOURS = 8
#: Fewest sets of cells for each attempt, and vectors that a cell is meant to have.
TREES, CELL = 8, 200
#: Vectors that meet at most in one cell or pivot group; more are dealt to several by hash.
MEETING = 512
#: Rounds of neighbours' neighbours after each set of cells, attempts, and wanted recall.
ROUNDS, ATTEMPTS, TARGET = 2, 4, 0.999
#: Vectors that the audit compares with all others.
AUDITED = 1000
#: Vectors of a component that meet in one task; larger components take pairs of blocks.
BLOCK = 1000
#: Bytes of the vectors that all others are compared with at once after the last attempt.
ASKED_BYTES = 4 << 20


def _matrix(raw: list[bytes]) -> np.ndarray:
    table = np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)
    return table / np.sqrt((table * table).sum(axis=1, keepdims=True))


def prepared(vectors: DataFrame) -> DataFrame:
    """vec_id, vec (binary doubles, null if it can link with nothing) and key of equal vectors."""

    def shaped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws, keys = [], []
            for vec_id, values in zip(batch.column("vec_id").to_pylist(), batch.column("embedding").to_pylist(), strict=True):
                usable = vec_id is not None and values and None not in values
                v = np.array(values, np.float64) + 0.0 if usable else np.zeros(0)
                with np.errstate(over="ignore"):
                    norm = float(v @ v)
                if usable and not 0 < norm < np.inf and np.isfinite(v).all() and v.any():
                    v = v / np.abs(v).max()  # too long or too short to square
                    norm = float(v @ v)
                raw = v.tobytes() if usable and 0 < norm < np.inf else None
                raws.append(raw)
                keys.append(hashlib.blake2b(raw, digest_size=16).digest() if raw else None)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(raws, pa.binary()), pa.array(keys, pa.binary())], ["vec_id", "vec", "key"])

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.mapInArrow(shaped, "vec_id long, vec binary, key binary")


def _forest(near: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a symmetric adjacency matrix."""
    seen, out = np.zeros(len(near), bool), []
    for k in np.flatnonzero(near.any(axis=1)).tolist():
        if seen[k]:
            continue
        front, seen[k] = [k], True
        while front:
            x = front.pop()
            new = np.flatnonzero(near[x] & ~seen)
            seen[new] = True
            out += [(int(y), x) for y in new]
            front += new.tolist()
    return out


def _meeting(k: int, threshold: float):
    """What a group of vectors tells each other: better neighbours, and a forest of links."""

    def met(group: pa.Table) -> pa.Table:
        ids = group["node"].to_numpy()
        ids, at = np.unique(ids, return_index=True)
        x = _matrix([group["vec"][int(i)].as_py() for i in at])
        worst = group["worst"].to_numpy()[at]
        cosine = x @ x.T
        np.fill_diagonal(cosine, -2)
        if "component" in group.column_names:  # only what lies outside of each one's component
            own = group["component"].to_numpy()[at]
            cosine[own[:, None] == own[None, :]] = -2
        best = np.argpartition(-cosine, min(k, len(ids)) - 1, axis=1)[:, :k]
        value = np.take_along_axis(cosine, best, axis=1)
        row, column = np.nonzero((value > worst[:, None]) & (value > -2))
        forest = _forest(cosine >= threshold)
        a = np.concatenate([ids[row], ids[[p for p, _ in forest]]]) if forest else ids[row]
        b = np.concatenate([ids[best[row, column]], ids[[q for _, q in forest]]]) if forest else ids[best[row, column]]
        c = np.concatenate([value[row, column], np.full(len(forest), 2.0)])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "cosine": pa.array(c, pa.float64())})

    return met


FOUND = "a long, b long, cosine double"


def _planes(count: int) -> int:
    return max(1, int(np.ceil(np.log2(max(2, count / CELL)))))


def trees_for(count: int, threshold: float, target: float) -> int:
    """Sets of cells in which a pair at the threshold meets with a probability of ``target``.

    Cells have more planes the more vectors there are, so that a pair shares each of them less often.
    """
    one = (1 - np.arccos(np.clip(threshold, -1, 1)) / np.pi) ** _planes(count)
    if not 0 < one < 1:
        return TREES
    return max(TREES, int(np.ceil(np.log(max(1e-9, 1 - target)) / np.log1p(-one))))


def cells(nodes: DataFrame, count: int, dimension: int, seed: int, trees: int = TREES) -> DataFrame:
    """Pairs of nodes that share a cell of random hyperplanes meet: (tree, cell, part, node)."""
    planes = _planes(count)
    normals = np.random.default_rng(seed).standard_normal((trees, dimension, planes))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("vec").to_pylist())
            power = 1 << np.arange(planes, dtype=np.int64)
            for tree in range(trees):
                code = ((x @ normals[tree]) > 0) @ power
                yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(np.full(len(x), seed * trees + tree, np.int32)), pa.array(code.astype(np.int64))], ["node", "tree", "cell"])

    found = nodes.select("node", "vec").mapInArrow(placed, "node long, tree int, cell long")
    sizes = found.groupBy("tree", "cell").agg(F.ceil(F.count("*") / F.lit(MEETING)).cast("int").alias("parts"))
    return found.join(sizes, ["tree", "cell"]).select("node", "tree", "cell", F.pmod(F.xxhash64("node", "tree"), "parts").cast("int").alias("part"))


def pivots(graph: DataFrame, seed: int) -> DataFrame:
    """Every node with its neighbours and those that have it as neighbour: (pivot, part, node)."""
    edges = graph.select("a", "b")
    around = edges.select(F.col("a").alias("pivot"), F.col("b").alias("node")).union(edges.select(F.col("b").alias("pivot"), F.col("a").alias("node"))).union(edges.select(F.col("a").alias("pivot"), F.col("a").alias("node")))
    around = around.distinct()
    sizes = around.groupBy("pivot").agg(F.ceil(F.count("*") / F.lit(MEETING)).cast("int").alias("parts"))
    return around.join(sizes, "pivot").select("pivot", F.pmod(F.xxhash64("node", F.lit(seed)), "parts").cast("int").alias("part"), "node")


def _improved(graph: DataFrame | None, found: DataFrame, k: int) -> DataFrame:
    """The k best distinct neighbours of each node."""
    rows = found.where("cosine < 1.5")
    rows = graph.unionByName(rows) if graph is not None else rows
    order = F.array_sort(F.collect_set(F.struct((-F.col("cosine")).alias("n"), "b")))
    best = rows.groupBy("a").agg(F.slice(order, 1, k).alias("best"))
    return best.select("a", F.explode("best").alias("x")).select("a", F.col("x.b").alias("b"), (-F.col("x.n")).alias("cosine"))


def _counted(nodes: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """(node, linked): vectors of other classes linked with each node of a component, from all pairs."""
    sizes = classes.groupBy("component").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks"))
    placed = classes.join(sizes, "component").select("node", "component", "blocks", F.pmod(F.xxhash64("node"), "blocks").cast("int").alias("block"))
    rows = nodes.join(placed, "node")
    dealt = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("node", "vec", "copies", "block", "component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))

    def compared(group: pa.Table) -> pa.Table:
        ids, copies, block = (group[c].to_numpy() for c in ("node", "copies", "block"))
        x = _matrix(group["vec"].to_pylist())
        near = x @ x.T >= threshold
        np.fill_diagonal(near, False)
        if group["i"][0].as_py() != group["j"][0].as_py():
            near &= block[:, None] != block[None, :]
        linked = near @ copies.astype(np.float64)
        return pa.table({"node": pa.array(ids, pa.int64()), "linked": pa.array(np.rint(linked).astype(np.int64))})

    return dealt.groupBy("component", "i", "j").applyInArrow(compared, "node long, linked long").groupBy("node").agg(F.sum("linked").alias("linked"))


def _audit(nodes: DataFrame, counted: DataFrame, threshold: float, small: int = NEIGHBOURS) -> float:
    """Mean recall of a sample's vectors that have links; the sample is compared with all nodes.

    Each vector counts once, however many links it has, and those of at most ``small``
    links are averaged apart as well: the lower mean counts.
    """
    sample = nodes.orderBy(F.xxhash64("node"), "node").limit(AUDITED).select("node", "vec").collect()  # at most AUDITED rows
    if not sample:
        return 1.0
    ids = np.array([r["node"] for r in sample], np.int64)
    asked = _matrix([bytes(r["vec"]) for r in sample])

    def true_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(ids))
        for batch in batches:
            if batch.num_rows:
                near = _matrix(batch.column("vec").to_pylist()) @ asked.T >= threshold
                near &= batch.column("node").to_numpy()[:, None] != ids[None, :]
                total += batch.column("copies").to_numpy() @ near
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.rint(total).astype(np.int64))], ["node", "linked"])

    truth = nodes.select("node", "vec", "copies").mapInArrow(true_links, "node long, linked long").groupBy("node").agg(F.sum("linked").alias("truth")).where("truth > 0")
    share = F.least(F.lit(1.0), F.coalesce("linked", F.lit(0)) / F.col("truth"))
    both = truth.join(counted, "node", "left").agg(F.avg(share).alias("all"), F.avg(F.when(F.col("truth") <= small, share)).alias("few")).first()
    return min([x for x in both if x is not None], default=1.0)


def _all_pairs(nodes: DataFrame, count: int, dimension: int, threshold: float) -> DataFrame:
    """All nodes against all, a block of them at a time: (a, b, null) of spanning forests, (a, null, linked)."""
    blocks = max(1, -(-count * dimension * 8 // ASKED_BYTES))
    found = None
    for block in range(blocks):
        some = nodes.where(F.pmod(F.xxhash64("node"), F.lit(blocks)) == block).select("node", "vec").collect()  # about ASKED_BYTES
        if not some:
            continue
        ids = np.array([r["node"] for r in some], np.int64)
        asked = _matrix([bytes(r["vec"]) for r in some])

        def compared(batches: Iterator[pa.RecordBatch], ids=ids, asked=asked) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(ids))
            for batch in batches:
                for start in range(0, batch.num_rows, BLOCK):
                    part = batch.slice(start, BLOCK)
                    own = part.column("node").to_numpy()
                    near = _matrix(part.column("vec").to_pylist()) @ asked.T >= threshold
                    near &= own[:, None] != ids[None, :]
                    total += part.column("copies").to_numpy() @ near
                    rows, columns = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
                    both = np.zeros((len(rows) + len(columns),) * 2, bool)
                    both[: len(rows), len(rows) :] = near[np.ix_(rows, columns)]
                    both[len(rows) :, : len(rows)] = both[: len(rows), len(rows) :].T
                    names = np.concatenate([own[rows], ids[columns]])
                    edges = np.array(_forest(both), np.int64).reshape(-1, 2)
                    yield pa.RecordBatch.from_arrays([pa.array(names[edges[:, 0]]), pa.array(names[edges[:, 1]]), pa.nulls(len(edges), pa.int64())], ["a", "b", "linked"])
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.nulls(len(ids), pa.int64()), pa.array(np.rint(total).astype(np.int64))], ["a", "b", "linked"])

        rows = written(nodes.select("node", "vec", "copies").mapInArrow(compared, "a long, b long, linked long"), "pairs")
        found = rows if found is None else found.unionByName(rows)
    return found


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, k: int = NEIGHBOURS, rounds: int = ROUNDS, attempts: int = ATTEMPTS, target: float = TARGET) -> DataFrame:
    """Links of vectors by cosine of at least ``threshold``.

    ``vectors`` has vec_id and embedding; other columns are ignored. Returns one row per
    row: vec_id, n_links (other vectors linked directly), component_id (smallest vec_id
    reachable, itself included), kept (vec_id = component_id) and audited_recall. Vectors
    that are null, empty, zero or hold a null or non-finite component link with nothing;
    those of different dimensions do not link, each dimension is searched by itself. A row
    without vec_id has no component and is kept. Rows that repeat a vec_id and its vector
    count once; if the vectors differ, each row has the links of its own vector, which all
    others count one by one. An empty table gives no rows.
    """
    small_batches(vectors.sparkSession)
    base = written(prepared(vectors), "vectors")
    usable = base.where("vec is not null").groupBy("key")
    distinct = usable.agg(F.min("vec_id").alias("first_id"), F.countDistinct("vec_id").alias("copies"), F.first("vec").alias("vec"))
    # Numbers of nodes are written once, so that all later jobs see the same ones.
    nodes = written(distinct.withColumn("node", F.monotonically_increasing_id()), "nodes")
    sizes = nodes.groupBy(F.octet_length("vec").alias("bytes")).count().orderBy("bytes").collect()  # one row per dimension
    found = [_linked(nodes.where(F.octet_length("vec") == r["bytes"]), r["count"], r["bytes"] // 8, threshold, k, rounds, attempts, target) for r in sizes]
    own = base.select("vec_id", "key").join(nodes.select("key", "node", "first_id", "copies"), "key", "left")
    linked, component, recall = F.lit(0), F.col("first_id"), 1.0
    if found:
        counted = reduce(DataFrame.unionByName, [f[0] for f in found])
        classes = reduce(DataFrame.unionByName, [f[1] for f in found])
        recall = min(f[2] for f in found)
        named = classes.join(nodes.select("node", "first_id"), "node").groupBy("component").agg(F.min("first_id").alias("component_id"))
        own = own.join(counted, "node", "left").join(classes.join(named, "component").select("node", "component_id"), "node", "left")
        linked, component = F.coalesce("linked", F.lit(0)), F.coalesce("component_id", "first_id")
    component = F.coalesce(component, "vec_id")
    n_links = linked + F.coalesce(F.col("copies") - 1, F.lit(0))
    return own.select("vec_id", n_links.cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"), F.lit(recall).alias("audited_recall"))


def _linked(nodes: DataFrame, count: int, dimension: int, threshold: float, k: int, rounds: int, attempts: int, target: float) -> tuple[DataFrame, DataFrame, float]:
    """Vectors linked with each node, the classes of linked nodes, and the recall of one dimension."""
    met = _meeting(k, threshold)
    graph, forest, recall = None, None, 0.0
    counted = classes = None

    def meet(members: DataFrame, keys: list[str], state: DataFrame) -> DataFrame:
        return written(members.join(state, "node").groupBy(*keys).applyInArrow(met, FOUND), "meetings")

    def enlarged(graph: DataFrame, forest: DataFrame, classes: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
        """Links and classes after rounds in which saturated lists look outside of their components."""
        full = graph.groupBy("a").agg(F.count("*").alias("n"), F.min("cosine").alias("worst")).where((F.col("n") >= k) & (F.col("worst") >= threshold))
        full = written(full.select(F.col("a").alias("node"), F.lit(True).alias("full")), "saturated")
        if full.isEmpty():
            return forest, classes
        outside, step = None, 0
        while True:
            placed = nodes.select("node", "vec").join(classes, "node", "left").withColumn("component", F.coalesce("component", "node")).join(full, "node", "left")
            if outside is None:
                worst = placed.withColumn("worst", F.lit(-2.0))
                members, keys = cells(nodes, count, dimension, seed), ["tree", "cell", "part"]
            else:
                last = outside.groupBy("a").agg(F.when(F.count("*") >= k, F.min("cosine")).otherwise(-2.0).alias("worst")).withColumnRenamed("a", "node")
                worst = placed.join(last, "node", "left").withColumn("worst", F.coalesce("worst", F.lit(-2.0)))
                members, keys = pivots(graph.unionByName(outside), seed + step), ["pivot", "part"]
            # The lists of others are not full of links: they keep what they have.
            state = worst.select("node", "vec", "component", F.when(F.col("full"), F.col("worst")).otherwise(2.0).alias("worst"))
            found = meet(members, keys, state)
            outside = _improved(outside, found, k)
            across = found.where("cosine > 1.5").select("a", "b")
            linked = not across.isEmpty()
            if linked:
                forest = forest.unionByName(across)
                classes = written(components(forest), "classes")
                # What is inside now leaves room for what is still outside.
                a, b = (classes.select(F.col("node").alias(c), F.col("component").alias(f"c{c}")) for c in "ab")
                outside = outside.join(a, "a", "left").join(b, "b", "left").where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b", "cosine")
            outside = written(outside, "outside")
            step += 1
            if step > rounds and not linked:
                return forest, classes

    trees = trees_for(count, threshold, target)
    for attempt in range(attempts):
        for step in range(rounds + 1):
            if graph is None:
                state = nodes.select("node", "vec", F.lit(-2.0).alias("worst"))
            else:
                worst = graph.groupBy("a").agg(F.when(F.count("*") >= k, F.min("cosine")).otherwise(-2.0).alias("worst")).withColumnRenamed("a", "node")
                state = nodes.select("node", "vec").join(worst, "node", "left").withColumn("worst", F.coalesce("worst", F.lit(-2.0)))
            if step == 0:
                found = meet(cells(nodes, count, dimension, attempt, trees), ["tree", "cell", "part"], state)
            else:
                found = meet(pivots(graph, attempt * 100 + step), ["pivot", "part"], state)
            graph = written(_improved(graph, found, k), "graph")
            new = found.where("cosine > 1.5").select("a", "b")
            forest = new if forest is None else forest.unionByName(new)
        links = forest.unionByName(graph.where(F.col("cosine") >= threshold).select("a", "b"))
        links, classes = enlarged(graph, links, written(components(links), "classes"), (attempt + 1) * 1000)
        forest = links
        counted = written(_counted(nodes, classes, threshold), "counts")
        recall = _audit(nodes, counted, threshold, k)
        if recall >= target or count < 2:
            break
    else:
        pairs = _all_pairs(nodes, count, dimension, threshold)
        classes = written(components(pairs.where("b is not null").select("a", "b")), "classes")
        counted = written(pairs.where("linked is not null").groupBy(F.col("a").alias("node")).agg(F.sum("linked").alias("linked")), "counts")
        recall = 1.0
    return counted, classes, recall
