"""Ranked lexical search with norm buckets over impact vectors.

A document's impact vector has, for each term, an integer that grows with the
term's count and falls with the document's length; an item's vector has the
weights of its terms.  The score is their inner product.

Items are asked in blocks of at most ``MAX_TERMS`` distinct terms (an item with
more is a block of its own).  For a block, the documents' impact vectors over
its terms are ordered by length (the Euclidean norm) and read in buckets, longest first.
With the kth score found so far for an item:

* a bucket whose longest vector times the item's length stays below it is
  skipped, and so are all after it (Cauchy-Schwarz); the same holds for the
  stored table, whose norm column prunes row groups;
* inside a bucket, the item's ``FOCUS`` heaviest coordinates are multiplied out
  and the rest is bounded by the lengths left over; vectors whose bound stays
  below are dropped;
* survivors are scored exactly in 64-bit integers.

The longest ``LONGEST`` of the vectors are searched first, and each item's kth
score there is where the rest starts.

Counts run over all documents: one pass finds terms, counts and lengths.

Defined results: null and empty texts have no term, and are neither counted nor
found; items without a term or without a scored document have no row; rows
without an id are documents like any other (found with a null id, last among
equal scores); repeated rows count and are found each; of items that repeat id
and text one is asked; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .util import keyed_texts, string_bytes, table, text_slices, written

K = 10
MAX_TERMS = 4096  # distinct terms of a block of items
BUCKET_CELLS = 1 << 20  # documents times terms of a bucket
FOCUS = 8
LONGEST = 0.05
SCALE, SHORT, SLOPE = 1_000_000_000, 10, 90  # of the impact formula
NO_SCORE = 0


def _plain_bytes() -> np.ndarray:
    """For every byte what it counts as: A-Z lower-cased, other ASCII that is no
    letter or digit a space; bytes of other characters stay."""
    out = np.arange(256, dtype=np.uint8)
    for b in range(128):
        c = chr(b)
        out[b] = ord(c.lower()) if c.isalnum() else 32
    return out


def terms_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Terms of each text, flattened, and the number of the text each belongs to."""
    data, offsets = string_bytes(texts)
    plain = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(_plain_bytes()[data]))
    lists = pc.split_pattern(plain, " ")
    flat, rows = lists.flatten(), pc.list_parent_indices(lists)
    full = pc.greater(pc.binary_length(flat), 0)
    return flat.filter(full), rows.filter(full).to_numpy(zero_copy_only=False).astype(np.int64)


def _counted(vocabulary: pa.Array):
    """Documents -> number of terms, and the block's terms in it with counts."""

    def run(batches):
        for batch in text_slices(batches):
            words, rows = terms_of(batch.column("text"))
            n = np.bincount(rows, minlength=batch.num_rows)
            code = pc.fill_null(pc.index_in(words, vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            known = code >= 0
            cells, tf = np.unique(rows[known] * len(vocabulary) + code[known], return_counts=True)
            at = np.concatenate([[0], np.cumsum(np.bincount(cells // max(len(vocabulary), 1), minlength=batch.num_rows))]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(at, pa.array(v.astype(np.int32))) for v in (cells % max(len(vocabulary), 1), tf)]
            full = pa.array(n > 0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n.astype(np.int64)), *lists], names=["doc_id", "n", "terms", "tf"]).filter(full)

    return run


def _impacts(documents: int, occurrences: int):
    """Counts -> impact vectors and their lengths."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = pa.concat_arrays([batch.column("tf")])
            tf = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            rows = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            # 90 * n * N may pass 64 bits for very long texts: Python's integers then
            n = batch.column("n").to_pylist()
            m = np.array([SHORT + SLOPE * x * documents // occurrences for x in n], np.int64)
            impact = (SCALE * tf) // (1000 * tf + 8 * m[rows])
            norm = np.sqrt(np.bincount(rows, weights=impact.astype(np.float64) ** 2, minlength=batch.num_rows))
            at = pa.array(np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=batch.num_rows))]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(norm), batch.column("terms"), pa.ListArray.from_arrays(at, pa.array(impact))],
                names=["doc_id", "norm", "terms", "impacts"],
            )

    return run


class Asked:
    """An item's vector: its terms, heaviest first, and their weights."""

    def __init__(self, terms: np.ndarray, weights: np.ndarray):
        heaviest = np.argsort(-weights, kind="stable")
        self.terms, self.weights = terms[heaviest], weights[heaviest]
        squares = weights[heaviest].astype(np.float64) ** 2
        self.length = math.sqrt(squares.sum())
        self.rest = math.sqrt(squares[FOCUS:].sum())


def survivors(item: Asked, impacts: np.ndarray, norms: np.ndarray, least: int) -> np.ndarray:
    """Rows of a bucket that can reach ``least``: exact on the heaviest
    coordinates, Cauchy-Schwarz on what is left of both vectors."""
    focus = impacts[:, item.terms[:FOCUS]].astype(np.float64)
    left = np.sqrt(np.maximum(norms**2 - (focus**2).sum(axis=1), 0))
    bound = focus @ item.weights[:FOCUS].astype(np.float64) + item.rest * left
    # what rounding in the lengths may have taken away
    return np.flatnonzero(bound * (1 + 1e-9) + 1e-3 * item.rest + 1 >= least)


def _buckets(batches, width: int):
    """Rows in order of length -> buckets (ids, norms, dense impacts)."""
    size = max(1, BUCKET_CELLS // max(width, 1))
    for whole in batches:
        for start in range(0, whole.num_rows, size):
            batch = whole.slice(start, size)
            impacts = np.zeros((batch.num_rows, width), np.int64)
            lists = pa.concat_arrays([batch.column("terms")])
            rows = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
            impacts[rows, lists.flatten().to_numpy(zero_copy_only=False)] = pa.concat_arrays([batch.column("impacts")]).flatten().to_numpy(zero_copy_only=False)
            yield batch.column("doc_id"), batch.column("norm").to_numpy(zero_copy_only=False), impacts


def _searched(items: list[tuple[np.ndarray, np.ndarray]], floors: list[int], width: int, k: int):
    """Documents by descending length -> the best ``k`` of each item in this part."""

    def run(batches):
        asked = [Asked(*i) for i in items]
        least = list(floors)
        best = [(np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)) for _ in asked]  # ids, without id, scores
        for ids, norms, impacts in _buckets(batches, width):
            unnamed = ids.is_null().to_numpy(zero_copy_only=False)
            ids = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False)
            longest = float(norms.max())
            for j, item in enumerate(asked):
                floor = max(least[j], NO_SCORE + 1)
                if longest * item.length * (1 + 1e-9) + 1 < floor:
                    continue
                rows = survivors(item, impacts, norms, floor)
                scores = impacts[np.ix_(rows, item.terms)] @ item.weights
                good = scores >= floor
                if not good.any():
                    continue
                found = [np.concatenate(x) for x in zip(best[j], (ids[rows[good]], unnamed[rows[good]], scores[good]))]
                order = np.lexsort((found[0], found[1], -found[2]))[:k]
                best[j] = tuple(x[order] for x in found)
                if len(order) == k:
                    least[j] = max(least[j], int(best[j][2][-1]))
        n = [len(b[0]) for b in best]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(np.arange(len(best), dtype=np.int32), n)),
                pa.array(np.concatenate([b[0] for b in best]), mask=np.concatenate([b[1] for b in best])),
                pa.array(np.concatenate([b[2] for b in best])),
            ],
            names=["item", "doc_id", "score"],
        )

    return run


def _blocks(items: DataFrame, max_terms: int):
    """Items in blocks of at most ``max_terms`` distinct terms: (ids, term sets,
    vocabulary).  The rows stream to the driver; one block is held at a time."""
    ids, sets, vocabulary = [], [], {}
    for row in items.select("item_id", "text").distinct().toLocalIterator():
        words = set(terms_of(pa.array([row["text"] or ""]))[0].to_pylist())
        if not words:
            continue
        if ids and len(vocabulary.keys() | words) > max_terms:
            yield ids, sets, list(vocabulary)
            ids, sets, vocabulary = [], [], {}
        ids.append(row["item_id"])
        sets.append(words)
        vocabulary |= dict.fromkeys(words)
    if ids:
        yield ids, sets, list(vocabulary)


def _block_ranking(texts: DataFrame, kind, ids: list, sets: list[set], vocabulary: list[str], k: int) -> DataFrame:
    spark = texts.sparkSession
    words = pa.array(vocabulary, pa.large_string())
    counts = written(texts.mapInArrow(_counted(words), "doc_id long, n long, terms array<int>, tf array<int>"), "lexical-counts")
    documents, occurrences = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()  # one row
    # at most the block's terms
    df = dict(counts.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1))).toLocalIterator())
    weight = [math.floor(1000 * math.log((2 * documents + 2) / (2 * df.get(t, 0) + 1))) for t in range(len(vocabulary))]
    code = {w: t for t, w in enumerate(vocabulary)}
    items = []
    for s in sets:
        terms = np.array(sorted(t for t in (code[w] for w in s) if df.get(t) and weight[t]), np.int64)
        items.append((terms, np.array([weight[t] for t in terms], np.int64)))

    # equal lengths spread by id and terms
    order = [F.desc("norm"), F.asc("doc_id"), F.xxhash64("terms", "impacts").asc()]
    vectors = counts.where(F.size("terms") > 0).mapInArrow(_impacts(documents, occurrences), "doc_id long, norm double, terms array<int>, impacts array<long>")
    vectors = written(vectors.repartitionByRange(*order).sortWithinPartitions(*order), "lexical-vectors")
    cut = (vectors.approxQuantile("norm", [1 - LONGEST], 0.01) or [0.0])[0]

    def search(rows: DataFrame, floors: list[int]) -> DataFrame:
        by_length = rows.sortWithinPartitions(F.desc("norm"))  # a scan may put several files in one task
        return by_length.mapInArrow(_searched(items, floors, len(vocabulary), k), "item int, doc_id long, score long")

    first = written(search(vectors.where(F.col("norm") >= cut), [NO_SCORE] * len(items)), "lexical-first")
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    # one row an item of the block
    kth = {r["item"]: r["score"] for r in first.withColumn("place", place).where(F.col("place") == k).select("item", "score").collect()}
    floors = [kth.get(j, NO_SCORE) for j in range(len(items))]
    # a vector shorter than this reaches no item's floor
    reach = min([max(f, 1) / Asked(*i).length for f, i in zip(floors, items) if len(i[0])], default=math.inf) * (1 - 1e-9)
    rest = vectors.where((F.col("norm") < cut) & (F.col("norm") >= reach))
    found = first.unionByName(search(rest, floors)).withColumn("rank", place).where(F.col("rank") <= k)
    named = spark.createDataFrame([(j, i) for j, i in enumerate(ids)], f"item int, item_id {kind.simpleString()}")
    return found.join(F.broadcast(named), "item").select("item_id", "rank", "doc_id", "score")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = K, max_terms: int = MAX_TERMS) -> DataFrame:
    """The ``k`` best documents of every item: ``item_id``, ``rank`` (from 1),
    ``doc_id``, ``score``.  ``items``: ``item_id`` and ``text``."""
    texts = keyed_texts(docs)
    kind = items.schema["item_id"].dataType
    out = None
    for block in _blocks(items, max_terms):
        ranking = written(_block_ranking(texts, kind, *block, k), "lexical-ranking")
        out = ranking if out is None else out.unionByName(ranking)
    if out is None:
        out = docs.sparkSession.createDataFrame([], f"item_id {kind.simpleString()}, rank int, doc_id long, score long")
    return out


def op13_ranked_lexical(spark, sf_dir):
    return rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""

OP13_SQL = f"""
WITH d AS (SELECT doc_id, {_TERMS} AS ts FROM documents),
docs AS (SELECT doc_id, ts, len(ts) AS n FROM d WHERE len(ts) > 0),
total AS (SELECT count(*) AS N_docs, CAST(sum(n) AS BIGINT) AS L FROM docs),
tf AS (SELECT doc_id, n, t, count(*) AS tf FROM (SELECT doc_id, n, unnest(ts) AS t FROM docs) GROUP BY ALL),
df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
w AS (SELECT t, CAST(floor(1000 * ln((2 * N_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w FROM df, total),
i AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS t FROM benchmark),
s AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * N_docs) // L)))) AS BIGINT) AS score
  FROM i JOIN w USING (t) JOIN tf USING (t), total GROUP BY item_id, doc_id),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""
