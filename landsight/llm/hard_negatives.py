"""Hard negatives by a secondary-sort shuffle.

Anchors meet all rows in blocks: shards of rows and blocks of anchors, dealt by
hashes.  A task sends on only what can be among the first of its anchor: its
first ``POSITIVES`` rows of the anchor's label, and, once the positives are
known, its first ``NEGATIVES`` rows of another label in each positive's window.

Those scored pairs get keys (anchor, descending score, kind, id), are dealt by
anchor and sorted within the partitions -- ``repartition`` and
``sortWithinPartitions``, the DataFrame form of ``repartitionAndSortWithinPartitions``,
whose sort spills in the JVM.  An iterator reads the sorted rows once: a positive
opens its window, a negative goes to the windows it lies in, a full window
closes.  It holds the open windows of one anchor and nothing else.  Of equal
scores the positives come first, so that a window is open before its first row.

Defined results: rows without an id, a label or a whole finite vector take no
part; an anchor meets rows of another id and of its own number of components;
repeated rows count each, an anchor repeated with label and vector is one; equal
scores go by the smaller id; a positive whose window is empty, as below zero,
gives no row; an empty table gives an empty result; other columns are ignored.
Scores beyond 64 bits are an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .util import table, written
from .vectors import BLOCK_QUERIES, SHARD_ROWS, dealt, for_scores, integer_vectors, matrix, of_number

SCALE = 256
POSITIVES = 5
NEGATIVES = 10
WINDOW = (30, 90)  # percent of the positive's score
ANCHORS_AT_ONCE = 128  # of a block, whose scores with a shard are held at once


def _meet(first):
    """A cogrouped function: rows and anchors of one group -> the pairs that
    ``first(scores, same label, other row, anchor's windows)`` picks."""
    schema = pa.schema([("anchor_id", pa.int64()), ("anchor_key", pa.int64()), ("score", pa.int64()), ("vec_id", pa.int64())])

    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        if not rows.num_rows or not anchors.num_rows:
            return schema.empty_table()
        dims = rows.column("dims")[0].as_py()
        rows = rows.sort_by("vec_id")  # a stable sort by score then leaves ties by id
        x, y = for_scores(matrix(rows.column("v"), dims), matrix(anchors.column("q"), dims))
        ids, labels = rows.column("vec_id").to_numpy(), rows.column("label").to_numpy()
        own, keys, kinds = (anchors.column(c).to_numpy() for c in ("anchor_id", "anchor_key", "anchor_label"))
        windows = anchors.column("windows").to_pylist()
        found = []
        for start in range(0, len(y), ANCHORS_AT_ONCE):
            scores = (y[start : start + ANCHORS_AT_ONCE] @ x.T).astype(np.int64)
            for i, row in enumerate(scores, start):
                picked = first(row, labels == kinds[i], ids != own[i], windows[i])
                found.append((np.full(len(picked), own[i]), np.full(len(picked), keys[i]), row[picked], ids[picked]))
        return pa.table([np.concatenate([f[c] for f in found]) for c in range(4)], schema=schema)

    return run


def _first_positives(n: int):
    def pick(scores, same, other, windows):
        rows = np.flatnonzero(same & other)
        return rows[np.argsort(-scores[rows], kind="stable")[:n]]

    return pick


def _in_window(positive: int, percent: tuple[int, int]) -> tuple[int, int]:
    """Least and largest integer score s with low * positive <= 100 * s <= high * positive."""
    return -(-percent[0] * positive // 100), percent[1] * positive // 100


def _first_negatives(n: int, percent: tuple[int, int]):
    def pick(scores, same, other, windows):
        bounds = [_in_window(w, percent) for w in windows]
        if not bounds:
            return np.zeros(0, np.int64)
        inside = (scores >= min(b[0] for b in bounds)) & (scores <= max(b[1] for b in bounds))
        rows = np.flatnonzero(~same & other & inside)
        rows = rows[np.argsort(-scores[rows], kind="stable")]
        down = -scores[rows]
        spans = [np.arange(np.searchsorted(down, -hi, "left"), np.searchsorted(down, -lo, "right"))[:n] for lo, hi in bounds]
        return rows[np.unique(np.concatenate(spans))]

    return pick


def _windows(negatives: int, percent: tuple[int, int]):
    """Sorted pairs -> the negatives of each positive, in one pass."""
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches):
        anchor, windows = None, []
        for batch in batches:
            out = []
            for a, key, score, kind, vec_id in zip(*(batch.column(c).to_pylist() for c in ("anchor_id", "anchor_key", "score", "kind", "vec_id"))):
                if (a, key) != anchor:
                    anchor, windows = (a, key), []
                if kind == 0:
                    windows.append([vec_id, score, *_in_window(score, percent), 0])
                    continue
                for w in windows:
                    if w[2] <= score <= w[3]:
                        w[4] += 1
                        out.append((a, w[0], w[4], vec_id, w[1], score))
                windows = [w for w in windows if w[4] < negatives and w[2] <= score]
            columns = zip(*out) if out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return run


def hard_negatives(
    rows: DataFrame,
    anchors: DataFrame,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    percent: tuple[int, int] = WINDOW,
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """For every anchor and each of its first ``positives`` rows of its label, the
    first ``negatives`` rows of another label whose score lies in the window
    ``percent`` of the positive's.  Both tables: ``vec_id``, ``v``, ``label``."""
    rows = written(rows.select("vec_id", "v", "label", F.size("v").alias("dims")), "mining-rows")
    anchors = written(
        anchors.select(
            F.col("vec_id").alias("anchor_id"), F.col("v").alias("q"), F.col("label").alias("anchor_label"), F.size("v").alias("dims"),
            F.xxhash64("vec_id", "v", "label").alias("anchor_key"),
        ).distinct(),
        "mining-anchors",
    )
    shards, blocks = of_number(rows.count(), shard_rows), of_number(anchors.count(), BLOCK_QUERIES)
    group = ["dims", "shard", "block"]
    rows = rows.withColumn("shard", dealt(shards, "vec_id", "v")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def met(asking: DataFrame, first) -> DataFrame:
        asked = asking.withColumn("block", dealt(blocks, "anchor_key")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
        return rows.groupBy(*group).cogroup(asked.groupBy(*group)).applyInArrow(_meet(first), "anchor_id long, anchor_key long, score long, vec_id long")

    pair = ["anchor_id", "anchor_key"]
    near = met(anchors.withColumn("windows", F.array().cast("array<long>")), _first_positives(positives))
    place = F.row_number().over(Window.partitionBy(*pair).orderBy(F.desc("score"), F.asc("vec_id")))
    near = written(near.withColumn("place", place).where(F.col("place") <= positives).drop("place"), "mining-positives")
    windows = near.groupBy(*pair).agg(F.collect_list("score").alias("windows"))  # at most ``positives``
    far = met(anchors.join(windows, pair), _first_negatives(negatives, percent))
    pairs = near.withColumn("kind", F.lit(0)).unionByName(far.withColumn("kind", F.lit(1)))
    by_key = pairs.repartition(*pair).sortWithinPartitions(*pair, F.desc("score"), F.asc("kind"), F.asc("vec_id"))
    return by_key.mapInArrow(
        _windows(negatives, percent), "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    )


def op12_hard_negatives(spark, sf_dir):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    rows = integer_vectors(table(spark, sf_dir, "embeddings").where("label IS NOT NULL"), SCALE, label.alias("label"))
    return hard_negatives(rows, rows.where("vec_id % 100 = 0"))


OP12_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_inner_product(a.e, c.e) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id <> c.vec_id AND len(a.e) = len(c.e)
  WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
w AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
         CAST(row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id) AS INTEGER) AS rank
  FROM p JOIN s n ON n.anchor_id = p.anchor_id AND NOT n.same
    AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM w WHERE rank <= 10
"""
