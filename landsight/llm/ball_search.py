"""Exact top-k search by inner product: ball trees and branch and bound.

Rows go to the cell of their nearest pivot (pivots: a bounded sample); large
cells are dealt into shards of about ``SHARD_ROWS`` rows by a hash, so that copies of
one vector spread.  A shard's rows become a ball tree in the task that searches
it.  For a query q a ball with centre c and radius r holds no inner product above
``<q, c> + |q| r``; nodes are opened in the order of that bound, until it falls
below the kth score found so far.

The kth score is shared: every query first searches the shard of the cell with
its largest bound; its kth score there is the floor with which it enters the other shards, and
only those whose cell's bound reaches the floor.

Defined results: rows without an id or a whole finite vector take no part, as
query or candidate; a query meets rows of another id and of its own number of
components; repeated rows are candidates each, a query repeated with its vector
is asked once; equal scores go by the smaller id; an empty table gives an empty
result; other columns are ignored.  Scores beyond 64 bits are an error.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .util import table, written
from .vectors import BLOCK_QUERIES, SHARD_ROWS, dealt, for_scores, integer_vectors, matrix, of_number

K = 10
SCALE = 1024
MAX_PIVOTS = 1024  # rows of the sample that names the cells
LEAF = 128
NO_FLOOR = -(1 << 63)
SHARD = ["dims", "cell", "part"]


def slack(bound):
    """A bound that rounding cannot have brought below a score it covers."""
    return bound + 1.0 + 1e-9 * np.abs(bound)


class BallTree:
    """Nodes as arrays; a leaf's rows are ``order[start:end]``."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(x))
        self.centres, self.radii, self.spans, self.children = [], [], [], []
        todo = [(0, len(x), None)]
        while todo:
            start, end, parent = todo.pop()
            rows = x[self.order[start:end]]
            centre = rows.mean(axis=0)
            away = np.sqrt(((rows - centre) ** 2).sum(axis=1))
            node = len(self.radii)
            self.centres.append(centre)
            self.radii.append(float(away.max()))
            self.spans.append((start, end))
            self.children.append([])
            if parent is not None:
                self.children[parent].append(node)
            if end - start <= leaf or not self.radii[node]:
                continue
            # halves along the line through two rows far from each other
            one = rows[int(away.argmax())]
            other = rows[int(((rows - one) ** 2).sum(axis=1).argmax())]
            middle = (end - start) // 2
            halves = np.argpartition(rows @ (other - one), middle)
            self.order[start:end] = self.order[start:end][halves]
            todo += [(start, start + middle, node), (start + middle, end, node)]
        self.centres, self.radii = np.array(self.centres), np.array(self.radii)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """For each query and node, what no inner product below the node exceeds."""
        length = np.sqrt((queries**2).sum(axis=1))
        return slack(queries @ self.centres.T + length[:, None] * self.radii)


def search_tree(tree: BallTree, bounds: np.ndarray, x: np.ndarray, ids: np.ndarray, query: np.ndarray, own: int, floor: int, k: int):
    """Ids and scores of the query's best ``k`` rows of at least ``floor``."""
    found, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
    nodes = [(-bounds[0], 0)]
    while nodes:
        bound, node = heapq.heappop(nodes)
        if -bound < floor:
            break
        if tree.children[node]:
            for child in tree.children[node]:
                if bounds[child] >= floor:
                    heapq.heappush(nodes, (-bounds[child], child))
            continue
        start, end = tree.spans[node]
        rows = tree.order[start:end]
        here = (x[rows] @ query).astype(np.int64)
        good = (here >= floor) & (ids[rows] != own)
        if not good.any():
            continue
        found, scores = np.concatenate([found, ids[rows[good]]]), np.concatenate([scores, here[good]])
        if len(found) >= k:
            best = np.lexsort((found, -scores))[:k]
            found, scores = found[best], scores[best]
            floor = max(floor, int(scores[-1]))
    return found, scores


def _search(k: int):
    schema = pa.schema([("query_id", pa.int64()), ("query_key", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        if not rows.num_rows or not asked.num_rows:
            return schema.empty_table()
        dims = asked.column("dims")[0].as_py()
        x, q = matrix(rows.column("v"), dims), matrix(asked.column("q"), dims)
        ids = rows.column("vec_id").to_numpy()
        tree = BallTree(x.astype(np.float64))
        x, q = for_scores(x, q)
        bounds = tree.bounds(q.astype(np.float64))
        own, keys, floors = (asked.column(c).to_numpy() for c in ("query_id", "query_key", "floor"))
        parts = [search_tree(tree, bounds[i], x, ids, q[i], own[i], int(floors[i]), k) for i in range(len(q))]
        n = [len(found) for found, _ in parts]
        return pa.table(
            [
                np.repeat(own, n),
                np.repeat(keys, n),
                np.concatenate([found for found, _ in parts]),
                np.concatenate([scores for _, scores in parts]),
            ],
            schema=schema,
        )

    return run


def _searched(rows: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """Each asked (query, shard) answered; rows go only to blocks that ask for them."""
    group = [*SHARD, "block"]
    needed = asked.select(*group).distinct().select(*(F.col(c).alias("row_" + c) for c in group))
    sent = rows.join(needed, [rows[c] == F.col("row_" + c) for c in SHARD]).select("vec_id", "v", *("row_" + c for c in group))
    return sent.groupBy(*("row_" + c for c in group)).cogroup(asked.groupBy(*group)).applyInArrow(_search(k), "query_id long, query_key long, vec_id long, score long")


def _placing(pivots: dict[int, np.ndarray]):
    """Rows -> with the cell of the nearest pivot and the distance to it."""

    def run(batches):
        for batch in batches:
            dims = batch.column("dims").to_numpy(zero_copy_only=False)
            cell, away = np.zeros(len(dims), np.int32), np.zeros(len(dims))
            for d in np.unique(dims):
                mine = np.flatnonzero(dims == d)
                x = matrix(batch.column("v").take(pa.array(mine)), int(d)).astype(np.float64)
                p = pivots.get(int(d), np.zeros((1, int(d))))
                near = ((p**2).sum(axis=1) - 2 * (x @ p.T)).argmin(axis=1)
                cell[mine], away[mine] = near, np.sqrt(((x - p[near]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(away)], names=[*batch.schema.names, "cell", "away"])

    return run


def _asking(pivots: dict[int, np.ndarray], cells: dict[int, list], first: bool):
    """Queries -> the shards they enter: in the first round one shard of the cell
    with the largest bound, in the second the others whose bound reaches the floor."""
    names = ["query_id", "query_key", "q", "floor", "block", *SHARD]
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]

    def run(batches):
        for batch in batches:
            rows, shards = [], []
            dims = batch.column("dims").to_pylist()
            keys, floors = batch.column("query_key").to_pylist(), batch.column("floor").to_pylist()
            for i, d in enumerate(dims):
                here = cells.get(d, [])  # (cell, radius, parts)
                if not here:
                    continue
                q = np.array(batch.column("q")[i].as_py(), np.float64)
                centres = pivots.get(d, np.zeros((1, d)))[[c for c, _, _ in here]]
                bounds = slack(centres @ q + np.sqrt((q**2).sum()) * np.array([r for _, r, _ in here]))
                top = int(bounds.argmax())
                home = (here[top][0], keys[i] % here[top][2])
                if first:
                    asked = [home]
                else:
                    asked = [(c, part) for (c, _, parts), b in zip(here, bounds) if b >= floors[i] for part in range(parts) if (c, part) != home]
                rows += [i] * len(asked)
                shards += asked
            picked = batch.take(pa.array(rows, pa.int64()))
            more = [pa.array([c for c, _ in shards], pa.int32()), pa.array([p for _, p in shards], pa.int32())]
            columns = [picked.column(c) for c in names[:5]] + [picked.column("dims"), *more]
            yield pa.RecordBatch.from_arrays([a.cast(k) for a, k in zip(columns, kinds)], names=names)

    return run


def top_k(rows: DataFrame, queries: DataFrame, k: int = K, max_pivots: int = MAX_PIVOTS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The ``k`` best rows of every query: ``query_id``, ``rank`` (from 1), ``vec_id``,
    ``score``.  Both tables: ``vec_id`` and ``v``, a list of integers."""
    spark = rows.sparkSession
    rows = written(rows.select("vec_id", "v", F.size("v").alias("dims")), "ball-rows")
    queries = written(
        queries.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), F.size("v").alias("dims"), F.xxhash64("vec_id", "v").alias("query_key")).distinct(),
        "ball-queries",
    )
    # the rows of least hash: a bounded sample, at most max_pivots rows
    wanted = min(max_pivots, of_number(rows.count(), shard_rows))
    pivots: dict[int, list] = {}
    for row in rows.select("dims", "v").orderBy(F.xxhash64("v", "vec_id")).limit(wanted).collect():
        pivots.setdefault(row["dims"], []).append(row["v"])
    pivots = {d: np.unique(np.array(v, np.float64).reshape(len(v), d), axis=0) for d, v in pivots.items()}

    placed = written(rows.mapInArrow(_placing(pivots), "vec_id long, v array<long>, dims int, cell int, away double"), "ball-placed")
    # one row a cell: at most max_pivots, and one for each number of components
    sizes = placed.groupBy("dims", "cell").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("radius")).collect()
    cells: dict[int, list] = {}
    for s in sizes:
        cells.setdefault(s["dims"], []).append((s["cell"], float(s["radius"]), of_number(s["n"], shard_rows)))
    parts = spark.createDataFrame([(d, c, p) for d, here in cells.items() for c, _, p in here], "dims int, cell int, parts int")
    rows = placed.join(F.broadcast(parts), ["dims", "cell"]).select(
        "vec_id", "v", "dims", "cell", F.pmod(F.xxhash64("vec_id", "away"), F.col("parts")).cast("int").alias("part")
    )

    blocks = of_number(queries.count(), BLOCK_QUERIES)
    asking = "query_id long, query_key long, q array<long>, floor long, block int, dims int, cell int, part int"
    queries = queries.withColumn("block", dealt(blocks, "query_key"))
    home = queries.withColumn("floor", F.lit(NO_FLOOR)).mapInArrow(_asking(pivots, cells, True), asking)
    found = written(_searched(rows, home, k), "ball-found")
    # a floor only where k rows reach it
    floors = found.groupBy("query_id", "query_key").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("floor"))
    others = queries.join(floors, ["query_id", "query_key"], "left").withColumn("floor", F.coalesce("floor", F.lit(NO_FLOOR)))
    more = _searched(rows, others.mapInArrow(_asking(pivots, cells, False), asking), k)
    order = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), F.asc("vec_id"))
    ranked = found.unionByName(more).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op11_exact_top_k(spark, sf_dir):
    rows = integer_vectors(table(spark, sf_dir, "embeddings"), SCALE)
    return top_k(rows, rows.where("vec_id % 100 = 0"))


OP11_SQL = """
WITH v AS (
  SELECT vec_id, [floor(1024 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
  WHERE q.vec_id % 100 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
