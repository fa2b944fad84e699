"""Packing token sequences by best-fit decreasing.

Documents longer than a window are first cut into full windows; what is left of
each document is placed, longest first, into the open window with the least
room that still holds it.  A segment tree indexed by remaining capacity finds
that window.  Pieces are dealt over shards of bounded token count, whose number
grows with the data, and every shard is packed on its own.

Defined results: a null or empty text is one piece with the closing id alone;
ties in length are placed by document id and start; repeated rows are packed
each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import TOKEN_BYTES, Source, WordMemory, library_encoder, load, text_ids
from .util import keyed_texts, process_cache, schema_with, table, text_slices, written

WINDOW = 4096
CLOSING_ID = 2
# Windows in one shard: large enough that the few windows left open cost little.
SHARD_WINDOWS = 1024

PLACE = "_place"  # of a piece in its slice of texts: deals out pieces that are equal in all else
PIECE_SCHEMA = f"doc_id long, start long, length long, ids_crc32 long, doc_tokens long, {PLACE} long"


def pieces(docs: DataFrame, path: str | None = None, window: int = WINDOW, closing: int = CLOSING_ID, keep_ids: bool = True) -> DataFrame:
    """Full windows and remainders of every document, with a checksum of their
    ids and, unless ``keep_ids`` is off, the ids themselves."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(load(path).plain())  # of fixed size

    def run(batches):
        source = Source(*shared.value)
        encode = library_encoder(source)
        memory = process_cache("word_memory_" + source.name, WordMemory)
        for batch in text_slices(batches, limit=TOKEN_BYTES):
            ids, sizes = text_ids(batch.column("text"), encode, memory)
            out = {"doc_id": [], "start": [], "length": [], "ids_crc32": [], "doc_tokens": [], PLACE: [], "ids": []}
            at = 0
            for doc, n in zip(batch.column("doc_id").to_pylist(), sizes):
                mine = np.append(ids[at : at + n], closing).astype("<u4")
                at += n
                for start in range(0, len(mine), window):
                    part = mine[start : start + window]
                    out["doc_id"].append(doc)
                    out["start"].append(start)
                    out["length"].append(len(part))
                    out["ids_crc32"].append(zlib.crc32(part.tobytes()))
                    out["doc_tokens"].append(len(mine))
                    out[PLACE].append(len(out[PLACE]))
                    out["ids"].append(part.astype(np.int32))
            cols = [pa.array(v, pa.int64()) for k, v in out.items() if k != "ids"]
            names = [k for k in out if k != "ids"]
            if keep_ids:
                cols.append(pa.array(out["ids"], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return keyed_texts(docs).mapInArrow(run, PIECE_SCHEMA + (", ids array<int>" if keep_ids else ""))


class RoomTree:
    """Open windows by remaining capacity; finds the tightest that fits."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.count = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, room: int, which: int) -> None:
        self.open[room].append(which)
        self._change(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """Room and number of the window with the least room of at least
        ``need``, no longer open; None if none has it."""
        count, i = self.count, need + self.size
        while not count[i]:
            # the next subtree to the right
            while i & 1:
                i >>= 1
            if not i:
                return None
            i += 1
        while i < self.size:
            i = 2 * i if count[2 * i] else 2 * i + 1
        room = i - self.size
        which = self.open[room].pop()
        self._change(room, -1)
        return room, which

    def _change(self, room: int, by: int) -> None:
        i = room + self.size
        while i:
            self.count[i] += by
            i >>= 1


def best_fit(lengths, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Window number and offset of each length, given longest first."""
    tree = RoomTree(window)
    where = np.zeros(len(lengths), np.int64)
    offset = np.zeros(len(lengths), np.int64)
    opened = 0
    for i, n in enumerate(lengths):
        found = tree.take(int(n))
        room, which = found if found else (window, opened)
        if not found:
            opened += 1
        where[i], offset[i] = which, window - room
        if room > n:
            tree.add(room - int(n), which)
    return where, offset


def pack(parts: DataFrame, window: int = WINDOW, shard_windows: int = SHARD_WINDOWS) -> DataFrame:
    """``parts`` with ``sequence_id`` (shard in the upper half) and ``offset``."""
    total = parts.agg(F.sum("length")).first()[0] or 0  # one number
    shards = max(1, -(-total // (window * shard_windows)))
    key = [c for c in ("doc_id", "start", "doc_tokens", "ids_crc32", PLACE) if c in parts.columns]
    dealt = parts.withColumn("shard", F.pmod(F.xxhash64(*key), F.lit(shards))).drop(PLACE)
    # a missing id would turn the other ids of its shard into floats
    dealt = dealt.withColumn("no_id", F.col("doc_id").isNull()).withColumn("doc_id", F.coalesce("doc_id", F.lit((1 << 63) - 1)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "start"], ascending=[False, True, True], kind="stable")
        where, offset = best_fit(pdf["length"].to_numpy(), window)
        return pdf.assign(sequence_id=(pdf["shard"].to_numpy() << 32) + where, offset=offset).drop(columns="shard")

    packed = dealt.groupBy("shard").applyInPandas(run, schema_with(dealt.drop("shard"), sequence_id="long", offset="long"))
    return packed.withColumn("doc_id", F.when(~F.col("no_id"), F.col("doc_id"))).drop("no_id")


def sequences(packed: DataFrame) -> DataFrame:
    """The packed id sequences: at most one window of ids each."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))


def pack_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Pieces of all documents and their places; the small piece table is
    written, so texts are encoded once."""
    return pack(written(pieces(docs, path, keep_ids=False), "packing-pieces"))


def op3_packing(spark, sf_dir):
    return pack_documents(table(spark, sf_dir, "documents"))
