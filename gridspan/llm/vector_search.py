"""Nearest neighbours by a hierarchical k-means tree with best-bin-first traversal.

The tree is grown on a bounded sample: the largest leaf is split by k-means until there are enough leaves. All vectors are
indexed: each goes down the tree to its leaf. A query takes nodes from a priority queue, best first by the inner
product with the centre plus ``ease`` times the query's length times the node's spread; leaves are visited in the order in
which they leave the queue.

How many leaves to visit is calibrated: for a bounded sample of queries the true neighbours are found by an exact pass over
all vectors, and visits are widened until the mean recall reaches the target; the ease that needs the fewest visits is taken.

Equal vectors are one in the index, with the ``k`` + 1 least ids that hold them: scores tie, so no other copy can be among
the nearest. Equal queries are searched once. Leaves are packed into bins of at most BIN_BYTES, and large ones dealt to
several; a bin meets the queries that visit it in blocks of at most QUERY_BYTES, so that no group grows with the table.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .histogram_sort import constants, written
from .vector_codes import list_rows, usable

#: Vectors that the tree is grown on, and queries that calibrate it, at most.
SAMPLE, CALIBRATION = 32_768, 256
#: Vectors of a leaf, children of a node, rounds of k-means.
LEAF_ROWS, BRANCHES, ROUNDS = 128, 8, 6
#: Vectors of a bin, and of a block of queries, as doubles; queries whose scores are held at once.
BIN_BYTES, QUERY_BYTES, SLICE = 8 << 20, 4 << 20, 256
EASES = (0.0, 0.5, 1.0)
TARGET = 0.95
SEED = 31
#: Copies of a query's neighbours in the join with the ids that asked for them.
SALTS = 8


@dataclass
class Tree:
    """Node 0 is the root; a node without children is a leaf, numbered as it comes."""

    centres: list[np.ndarray] = field(default_factory=list)
    spreads: list[float] = field(default_factory=list)
    children: list[list[int]] = field(default_factory=list)
    leaf: list[int] = field(default_factory=list)

    def add(self, points: np.ndarray) -> int:
        centre = points.mean(0)
        self.centres.append(centre)
        self.spreads.append(float(np.sqrt(((points - centre) ** 2).sum(1).mean())))
        self.children.append([])
        return len(self.centres) - 1

    def number_leaves(self) -> None:
        """Depth first, so that neighbouring leaves have neighbouring numbers."""
        self.leaf, stack, n = [-1] * len(self.centres), [0], 0
        while stack:
            node = stack.pop()
            if self.children[node]:
                stack += reversed(self.children[node])
            else:
                self.leaf[node], n = n, n + 1

    @property
    def leaves(self) -> int:
        return max(self.leaf) + 1

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf that each row comes to, by the nearest centre among a node's children, ties to the first."""
        out, stack = np.empty(len(x), np.int32), [(0, np.arange(len(x)))]
        centres = np.array(self.centres)
        while stack:
            node, rows = stack.pop()
            if not self.children[node]:
                out[rows] = self.leaf[node]
            elif len(rows):
                near = centres[self.children[node]]
                choice = np.argmin((near * near).sum(1)[None, :] - 2 * (x[rows] @ near.T), axis=1)
                stack += [(child, rows[choice == i]) for i, child in enumerate(self.children[node])]
        return out

    def orders(self, queries: np.ndarray, ease: float, visits: int, held: np.ndarray | None = None, least: int = 0) -> Iterator[list[int]]:
        """For each query the leaves it visits, best first: ``visits``, and as many more as hold ``least`` rows by the counts ``held``."""
        bounds = queries @ np.array(self.centres).T + ease * np.linalg.norm(queries, axis=1)[:, None] * np.array(self.spreads)[None, :]
        for bound in (-bounds).tolist():
            queue, out, rows = [(bound[0], 0)], [], 0
            while queue and (len(out) < visits or rows < least):
                node = heapq.heappop(queue)[1]
                if self.children[node]:
                    for child in self.children[node]:
                        heapq.heappush(queue, (bound[child], child))
                else:
                    out.append(self.leaf[node])
                    rows += int(held[out[-1]]) if held is not None else 0
            yield out


def _clusters(points: np.ndarray, k: int, rng: np.random.Generator) -> list[np.ndarray]:
    """k-means: the row numbers of each cluster that isn't empty."""
    centres = points[rng.choice(len(points), min(k, len(points)), replace=False)]
    for _ in range(ROUNDS):
        choice = np.argmin((centres * centres).sum(1)[None, :] - 2 * (points @ centres.T), axis=1)
        groups = [g for i in range(len(centres)) if len(g := np.flatnonzero(choice == i))]
        centres = np.array([points[g].mean(0) for g in groups])
    return groups


def grow(points: np.ndarray, leaves: int, *, branches: int = BRANCHES, seed: int = SEED) -> Tree:
    """A tree of about ``leaves`` leaves over a sample."""
    rng, tree = np.random.default_rng(seed), Tree()
    queue, count = [(-len(points), tree.add(points), points)], 1
    while queue and count < leaves:
        size, node, mine = heapq.heappop(queue)
        groups = _clusters(mine, branches, rng) if -size > 1 else []
        if len(groups) < 2:
            continue
        for g in groups:
            child = tree.add(mine[g])
            tree.children[node].append(child)
            heapq.heappush(queue, (-len(g), child, mine[g]))
        count += len(groups) - 1
    tree.number_leaves()
    return tree


def _matrix(column: pa.Array) -> np.ndarray:
    values, lengths = list_rows(column)
    return values.astype(np.float64).reshape(len(lengths), -1)


def scores(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products row by row, added up in the same order wherever a row stands."""
    return (queries * rows).sum(1)


def nearest(queries: np.ndarray, x: np.ndarray, k: int, allowed: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of at least the ``k`` best rows of each query; ``allowed`` (query, leaf), with the rows' leaves, leaves others out."""
    parts = [_nearest(queries[a : a + SLICE], x, k, allowed and (allowed[0][a : a + SLICE], allowed[1])) for a in range(0, len(queries), SLICE)]
    offsets = np.repeat(np.arange(len(parts)) * SLICE, [len(p[0]) for p in parts])
    q, r, score = (np.concatenate(c) for c in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    return q + offsets, r, score


def _nearest(queries: np.ndarray, x: np.ndarray, k: int, allowed: tuple[np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rough = queries @ x.T
    if allowed is not None:
        rough[~allowed[0][:, allowed[1]]] = -np.inf
    if len(x) > k:
        # Rows whose rough score is within rounding of the k-th best stay too.
        kth = np.partition(rough, len(x) - k, axis=1)[:, len(x) - k]
        slack = 1e-12 * np.linalg.norm(queries, axis=1) * np.linalg.norm(x, axis=1).max()
        chosen = (rough >= (kth - slack)[:, None]) & (rough > -np.inf)
    else:
        chosen = rough > -np.inf
    q, r = np.nonzero(chosen)
    return q, r, scores(queries[q], x[r])


def _hash(vector: str) -> Column:
    return F.xxhash64(vector)


def _by_leaf(values: list[int]) -> Callable[[Column], Column]:
    """A number for each leaf, as a constant of the plan: there are fewer leaves than sampled vectors."""
    held = constants(values)
    return lambda leaf: F.get(held, leaf).cast("int")


def _keep(df: DataFrame, by: list[str], k: int) -> DataFrame:
    """Of each group the ``k`` rows with the best score, ties to the smaller id; tasks leave out the rest before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "id"))
    return df.withColumn("rank", rank).where(F.col("rank") <= k)


class Index:
    """All usable vectors by leaf, and how to search them."""

    def __init__(self, vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, sample: int = SAMPLE, leaf_rows: int = LEAF_ROWS):
        self.k, self.spark = k, vectors.sparkSession
        rows = vectors.where(usable(F.col(vector_col)) & F.col(id_col).isNotNull() & F.exists(vector_col, lambda x: x != 0)).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"))
        common = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
        self.total = common[0]["count"] if common else 0
        self.rows = rows.where(F.size("vector") == (common[0]["n"] if common else 0))
        if not self.total:
            return
        share = min(1.0, sample / self.total)
        drawn = self.rows.where(F.pmod(F.xxhash64("id", F.lit(SEED)), F.lit(1 << 30)) < int(share * (1 << 30))).orderBy(F.xxhash64("id", F.lit(SEED)), "id", "vector").limit(sample) if share < 1 else self.rows
        points = np.unique(np.array([r["vector"] for r in drawn.select("vector").collect()], np.float64), axis=0)
        self.tree = grow(points, max(1, min(self.total // leaf_rows, len(points) // 8))) if len(points) else grow(np.zeros((1, common[0]["n"])), 1)
        shared = self.spark.sparkContext.broadcast(self.tree)

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shared.value.leaf_of(_matrix(batch.column(0))), pa.int32())], names=["vector", "ids", "leaf"])

        # Copies: the least ids of each vector, chosen before they are gathered.
        rank = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
        copies = self.rows.distinct().withColumn("rank", rank).where(F.col("rank") <= k + 1).groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids"))
        kind = vectors.select(F.col(vector_col)).schema[0].dataType.simpleString()
        self.table = written(copies.mapInArrow(place, f"vector {kind}, ids array<long>, leaf int"), "vector-index")
        self.held, self.distinct = np.zeros(self.tree.leaves, np.int64), np.zeros(self.tree.leaves, np.int64)
        for r in self.table.groupBy("leaf").agg(F.sum(F.size("ids")).alias("ids"), F.count("*").alias("n")).collect():
            self.held[r["leaf"]], self.distinct[r["leaf"]] = r["ids"], r["n"]

    def exact(self, queries: np.ndarray) -> DataFrame:
        """q, id, leaf, score, rank: the true k + 1 nearest of each of a few queries, by one pass over all vectors."""
        shared, k = self.spark.sparkContext.broadcast(queries), self.k + 1

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    q, r, score = nearest(shared.value, _matrix(batch.column(0)), k)
                    yield pa.RecordBatch.from_arrays([pa.array(q), batch.column(1).take(pa.array(r)), batch.column(2).take(pa.array(r)), pa.array(score)], names=["q", "ids", "leaf", "score"])

        found = self.table.select("vector", "ids", "leaf").mapInArrow(scan, "q long, ids array<long>, leaf int, score double")
        return _keep(found.select("q", "leaf", "score", F.explode("ids").alias("id")), ["q"], k)

    def calibrate(self, queries: list[tuple[int, list[float]]], target: float = TARGET) -> tuple[float, int, float]:
        """(ease, visits, recall): visits are widened until the mean recall of the given (id, vector) pairs reaches the target."""
        asked = np.array([v for _, v in queries], np.float64)
        true: list[list[int]] = [[] for _ in queries]
        for r in sorted(self.exact(asked).collect(), key=lambda r: r["rank"]):
            if r["id"] != queries[r["q"]][0] and len(true[r["q"]]) < self.k:
                true[r["q"]].append(r["leaf"])
        best = (0.0, self.tree.leaves, 1.0)
        for ease in EASES:
            place = []
            for order in self.tree.orders(asked, ease, self.tree.leaves):
                at = np.empty(self.tree.leaves, np.int64)
                at[order] = np.arange(len(order))
                place.append(at)
            visits = 1
            recall = lambda v: float(np.mean([np.mean(place[i][leaves] < v) for i, leaves in enumerate(true) if leaves] or [1.0]))  # noqa: E731, B023
            while recall(visits) < target:
                visits += max(1, visits // 16)
            visits = min(visits, self.tree.leaves)
            if visits < best[1]:
                best = (ease, visits, recall(visits))
        return best

    def search(self, asked: DataFrame, ease: float, visits: int) -> DataFrame:
        """hash, low (of the query vector), id, score, rank: the k + 1 nearest found for each row (hash, low, vector) of ``asked``."""
        tree, held, least, k = self.spark.sparkContext.broadcast(self.tree), self.held, self.k + 1, self.k + 1
        kind = asked.schema["vector"].dataType.simpleString()

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                leaves = list(tree.value.orders(_matrix(batch.column(2)), ease, visits, held, least))
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(leaves, pa.list_(pa.int32()))], names=["hash", "low", "vector", "leaves"])

        routed = written(asked.select("hash", "low", "vector").mapInArrow(route, f"hash long, low long, vector {kind}, leaves array<int>"), "vector-routes")
        # Bins of whole leaves in order, numbered by their first piece; a leaf larger than a bin has bins of its own.
        width = 8 * len(self.tree.centres[0])
        most, first, pieces, at, filled = max(1, BIN_BYTES // width), [], [], 0, 0
        for n in self.distinct.tolist():
            if filled and filled + n > most:
                at, filled = at + 1, 0
            first.append(at)
            pieces.append(max(1, -(-n // most)))
            filled += n
            if pieces[-1] > 1:
                at, filled = at + pieces[-1], 0
        first_of, pieces_of = _by_leaf(first), _by_leaf(pieces)
        calls = routed.select("hash", "low", "vector", "leaves", F.explode(F.array_distinct(F.transform("leaves", first_of))).alias("first"))
        counts = dict(calls.groupBy("first").count().collect())
        blocks_of = _by_leaf([max(1, -(-counts.get(b, 0) * width // QUERY_BYTES)) for b in first])
        spread = lambda c, n: F.pmod(c, n).cast("int")
        leaf = F.col("leaf")
        rows = self.table.select((first_of(leaf) + spread(_hash("vector"), pieces_of(leaf))).alias("bin"), "leaf", "vector", "ids", F.explode(F.sequence(F.lit(0), blocks_of(leaf) - 1)).alias("block"))
        calls = calls.withColumn("leaves", F.filter("leaves", lambda x: first_of(x) == F.col("first"))).withColumn("leaf", F.get("leaves", F.lit(0)))
        calls = calls.select("hash", "low", "vector", "leaves", spread(F.col("hash"), blocks_of(leaf)).alias("block"), F.explode(F.sequence("first", F.col("first") + pieces_of(leaf) - 1)).alias("bin"))
        leaves = self.tree.leaves

        def meet(left: pa.Table, right: pa.Table) -> pa.Table:
            out = {"hash": pa.array([], pa.int64()), "low": pa.array([], pa.int64()), "ids": pa.array([], pa.list_(pa.int64())), "score": pa.array([], pa.float64())}
            if left.num_rows and right.num_rows:
                left, right = left.combine_chunks(), right.combine_chunks()
                where, lengths = list_rows(right["leaves"].combine_chunks())
                open_leaves = np.zeros((right.num_rows, leaves), bool)
                open_leaves[np.repeat(np.arange(right.num_rows), lengths), where] = True
                q, r, score = nearest(_matrix(right["vector"].combine_chunks()), _matrix(left["vector"].combine_chunks()), k, (open_leaves, left["leaf"].to_numpy()))
                out = {"hash": right["hash"].take(pa.array(q)), "low": right["low"].take(pa.array(q)), "ids": left["ids"].take(pa.array(r)), "score": pa.array(score)}
            return pa.table(out)

        met = rows.groupBy("bin", "block").cogroup(calls.groupBy("bin", "block")).applyInArrow(meet, "hash long, low long, ids array<long>, score double")
        return _keep(met.select("hash", "low", "score", F.explode("ids").alias("id")), ["hash", "low"], k)


def nearest_neighbours(vectors: DataFrame, *, every: int = 20, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", target: float = TARGET, sample: int = SAMPLE, calibration: int = CALIBRATION, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row whose id ``every`` divides, the ``k`` nearest found among all other rows.

    Nearness is the inner product in double precision, ties to the smaller id. Vectors that are null, empty, all zero or hold null
    or infinite components or NaN take no part, nor do rows without an id or of another length than most (ties: the shorter). A
    repeated row counts once; rows of one id with different vectors are queries and candidates each, but never for their own id.
    With fewer than ``k`` others, all are returned. A table without usable rows gives none. Other columns are not carried along.
    """
    index = Index(vectors, id_col=id_col, vector_col=vector_col, k=k, sample=sample, leaf_rows=leaf_rows)
    schema = "query_id long, rank int, vec_id long, score double"
    if not index.total:
        return index.spark.createDataFrame([], schema)
    queries = index.rows.where(F.col("id") % every == 0).distinct().withColumn("hash", _hash("vector"))
    asked = written(queries.groupBy("vector", "hash").agg(F.min("id").alias("low")), "vector-queries")
    drawn = asked.orderBy(F.xxhash64("low", F.lit(SEED)), "low").limit(calibration).select("low", "vector").collect()
    if not drawn:
        return index.spark.createDataFrame([], schema)
    ease, visits, _ = index.calibrate([(r["low"], r["vector"]) for r in drawn], target)
    found = index.search(asked, ease, visits)
    lists = found.groupBy("hash", "low").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("order"), "id", "score"))).alias("near"))
    # A vector that many ids ask for is one list; its copies share out the ids.
    lists = lists.join(asked.select("hash", "low", "vector"), ["hash", "low"]).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = queries.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    answered = salted.join(lists.select("hash", "vector", "salt", "near"), ["hash", "vector", "salt"])
    others = F.slice(F.filter("near", lambda x: x["id"] != F.col("id")), 1, k)
    return answered.select(F.col("id").alias("query_id"), F.posexplode(others).alias("at", "x")).select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.id").alias("vec_id"), F.col("x.score").alias("score"))
