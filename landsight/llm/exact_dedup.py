"""Exact deduplication against immutable snapshots.

The corpus arrives in batches.  Equal texts inside a batch are grouped by
digest; what is left meets every earlier snapshot: a static binary-fuse filter
(built once per shard of the snapshot, never changed) screens the digests, the
positives join the snapshot's exact buckets, and the two texts are compared
byte for byte.  A batch's new texts become the next snapshot.

Defined results: a null text counts as empty; the row with the largest id of a
group stays (of rows with the same id and text, all carry that id); rows without
an id are grouped, but ``drop_copies`` cannot name them and leaves them out; an
empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import keyed_texts, mix64, table, written

BATCHES = 3
# Digests in one filter shard: the number of shards grows with the snapshot.
SHARD_KEYS = 100_000
FILTER_SCHEMA = "shard int, seed long, segment int, span int, cells binary"


def _places(keys: np.ndarray, seed: int, segment: int, span: int):
    """The three cells of each key and its 8-bit fingerprint."""
    h = mix64(keys ^ mix64(np.array([seed], np.uint64))[0])
    mask = np.uint64(segment - 1)
    a = ((h >> np.uint64(32)) * np.uint64(span)) >> np.uint64(32)
    b = a + np.uint64(segment) ^ (h >> np.uint64(18)) & mask
    c = a + np.uint64(2 * segment) ^ h & mask
    return np.stack([a, b, c]).astype(np.int64), mix64(h).astype(np.uint8)


def build_fuse(keys: np.ndarray) -> tuple[int, int, int, np.ndarray]:
    """Seed, segment length, span of the first cell, and cells of a 3-wise
    binary fuse filter over distinct 64-bit keys."""
    keys = np.unique(keys.astype(np.uint64))
    n = len(keys)
    segment = 1 << max(2, int(math.log(max(n, 2)) / math.log(3.33) + 2.25))
    factor = max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 3)))
    segments = max(1, math.ceil(n * factor / segment) - 2)
    for seed in range(1, 1000):
        span = segments * segment
        size = span + 2 * segment
        where, prints = _places(keys, seed, segment, span)
        count = np.bincount(where.ravel(), minlength=size)
        owner = np.zeros(size, np.int64)  # xor of the keys that use a cell
        for k in range(3):
            np.bitwise_xor.at(owner, where[k], np.arange(n))
        layers, left = [], n
        alone = np.flatnonzero(count == 1)
        while len(alone):
            key, first = np.unique(owner[alone], return_index=True)
            cell = alone[first]
            layers.append((key, cell))
            left -= len(key)
            for k in range(3):
                np.subtract.at(count, where[k, key], 1)
                np.bitwise_xor.at(owner, where[k, key], key)
            touched = np.unique(where[:, key])
            alone = touched[count[touched] == 1]
        if left:
            if seed % 10 == 0:
                segments += 1
            continue
        cells = np.zeros(size, np.uint8)
        for key, cell in reversed(layers):
            w = where[:, key]
            cells[cell] = 0
            cells[cell] = prints[key] ^ cells[w[0]] ^ cells[w[1]] ^ cells[w[2]]
        return seed, segment, span, cells
    raise RuntimeError("no binary fuse filter found")


def fuse_contains(keys: np.ndarray, seed: int, segment: int, span: int, cells: np.ndarray) -> np.ndarray:
    where, prints = _places(keys.astype(np.uint64), seed, segment, span)
    return (cells[where[0]] ^ cells[where[1]] ^ cells[where[2]]) == prints


def _build_shard(pdf: pd.DataFrame) -> pd.DataFrame:
    seed, segment, span, cells = build_fuse(pdf["key64"].to_numpy().view(np.uint64))
    return pd.DataFrame(
        {"shard": [pdf["shard"].iloc[0]], "seed": [seed], "segment": [segment], "span": [span], "cells": [cells.tobytes()]}
    )


def _screen_shard(digests: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
    if digests.empty or filters.empty:
        return digests[["digest"]].iloc[:0]
    f = filters.iloc[0]
    hit = fuse_contains(
        digests["key64"].to_numpy().view(np.uint64), int(f["seed"]), int(f["segment"]), int(f["span"]), np.frombuffer(f["cells"], np.uint8)
    )
    return digests.loc[hit, ["digest"]]


def _sharded(groups: DataFrame, shards: int) -> DataFrame:
    key = F.conv(F.substring("digest", 1, 16), 16, -10).cast("long")
    return groups.select("digest", key.alias("key64"), F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int").alias("shard"))


class Snapshot:
    """Immutable: the exact buckets (digest, class) and their filters."""

    def __init__(self, classes: DataFrame):
        self.buckets = classes
        self.shards = max(1, math.ceil(classes.count() / SHARD_KEYS))
        self.filters = written(
            _sharded(classes, self.shards).groupBy("shard").applyInPandas(_build_shard, FILTER_SCHEMA), "dedup-filters"
        )

    def screen(self, groups: DataFrame) -> DataFrame:
        """Digests of ``groups`` (one row per digest) that the filters let through."""
        return (
            _sharded(groups, self.shards)
            .groupBy("shard")
            .cogroup(self.filters.groupBy("shard"))
            .applyInPandas(_screen_shard, "digest string")
        )


def digests_of(docs: DataFrame, batches: int) -> DataFrame:
    """Id, digest and batch (by a hash of the id) of every document."""
    return keyed_texts(docs).select(
        "doc_id",
        F.sha2(F.col("text"), 256).alias("digest"),
        F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int").alias("batch"),
    )


def find_groups(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """One row per document: ``doc_id``, ``digest``, ``keep_id``, ``group_size``."""
    rows = written(digests_of(docs, batches), "dedup-digests")
    snapshots: list[Snapshot] = []
    found: list[DataFrame] = []
    for b in range(batches):
        # duplicates inside the batch: one row per digest (partial aggregation)
        groups = rows.where(F.col("batch") == b).groupBy("batch", "digest").agg(
            F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"), F.count(F.lit(1)).alias("n")
        )
        groups = written(groups, "dedup-groups")
        matched = None
        for s in snapshots:
            hits = s.screen(groups).join(s.buckets, "digest").select("digest", "class_id")
            matched = hits if matched is None else matched.unionByName(hits)
        if matched is None:
            classed = groups.withColumn("class_id", F.lit(None).cast("long"))
        else:
            classed = groups.join(matched, "digest", "left")
        classed = written(classed, "dedup-classed")
        found.append(classed)
        if b + 1 < batches:
            new = classed.where(F.col("class_id").isNull()).select("digest", F.col("first_id").alias("class_id"))
            snapshots.append(Snapshot(new))
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return _members(docs, rows, every)


def _members(docs: DataFrame, rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Compare the texts of matched groups, then hand every document its class."""
    texts = keyed_texts(docs).where(F.col("doc_id").isNotNull())
    pairs = groups.where(F.col("class_id").isNotNull()).select("batch", "digest", "first_id", "class_id")
    one = texts.select(F.col("doc_id").alias("first_id"), F.col("text").alias("one"))
    two = texts.select(F.col("doc_id").alias("class_id"), F.col("text").alias("two"))
    # repeated rows of one id may carry other texts: the digest picks the right one
    equal = (
        pairs.join(one, "first_id")
        .where(F.sha2("one", 256) == F.col("digest"))
        .join(two, "class_id")
        .where(F.col("one") == F.col("two"))
        .select("batch", "digest", F.lit(True).alias("equal"))
        .distinct()
    )
    classed = groups.join(equal, ["batch", "digest"], "left").select(
        "batch", "digest", "last_id", "n", F.when(F.col("equal"), F.col("class_id")).otherwise(F.col("first_id")).alias("class_id")
    )
    classed = written(classed, "dedup-classes")
    sizes = classed.groupBy("class_id", "digest").agg(F.max("last_id").alias("keep_id"), F.sum("n").alias("group_size"))
    # Only groups of two or more need their size; AQE splits a hot digest here.
    big = (
        classed.join(sizes.where(F.col("group_size") > 1), ["class_id", "digest"])
        .select("batch", F.col("digest").alias("d"), "keep_id", "group_size")
    )
    return rows.join(big.withColumnRenamed("batch", "b"), (F.col("digest") == F.col("d")) & (F.col("batch") == F.col("b")), "left").select(
        "doc_id",
        "digest",
        F.coalesce("keep_id", "doc_id").alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
    )


def drop_copies(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """The documents that stay, with all their columns."""
    kept = find_groups(docs, batches).where(F.col("doc_id") == F.col("keep_id")).select(F.col("doc_id").alias("_kept")).distinct()
    return docs.join(kept, docs["doc_id"] == kept["_kept"], "left_semi")


def op10_exact_dedup(spark, sf_dir):
    return find_groups(table(spark, sf_dir, "documents")).select(
        "doc_id", "keep_id", "group_size", (F.col("doc_id") == F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256")
    )


OP10_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
