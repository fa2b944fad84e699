"""Byte-pair encoding and decoding.

A pre-token's symbols form a doubly linked list; a heap of (merge rank, place)
gives the next merge, and entries whose symbols have changed since are skipped.
Decoding concatenates vocabulary strings (the file has no decoder, so the
library puts one space between them).

Defined results: a null or empty text has no ids and decodes to the empty text;
rows repeat as they come; special tokens written in a text are special tokens,
as in the library; other columns of the input are ignored.
"""

from __future__ import annotations

import json
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import Source, load, with_ids
from .util import keyed_texts, process_cache, schema_with, table

# Pre-tokens whose ids a worker remembers; the oldest half goes when it is full.
REMEMBERED = 400_000


class Bpe:
    def __init__(self, source: Source):
        self.source, self.specials = source, source.specials
        spec = json.loads(source.file)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.mark: str = model["end_of_word_suffix"]
        merges = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        # pair of symbol ids -> (rank, id of the merged symbol)
        self.merges = {(self.vocab[a], self.vocab[b]): (rank, self.vocab[a + b]) for rank, (a, b) in enumerate(merges)}
        self.known: dict[str, tuple[int, ...]] = {}

    def encode(self, pre_token: str) -> tuple[int, ...]:
        """Ids of one pre-token, given in byte symbols."""
        if pre_token in self.specials:
            return (self.specials[pre_token],)
        vocab, merges = self.vocab, self.merges
        sym = [vocab[c] for c in pre_token[:-1]]
        sym.append(vocab[pre_token[-1] + self.mark])
        n = len(sym)
        if n == 1:
            return tuple(sym)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            m = merges.get((sym[i], sym[i + 1]))
            if m:
                heap.append((m[0], i, m[1], sym[i], sym[i + 1]))
        heapify(heap)
        while heap:
            _, i, merged, left, right = heappop(heap)
            j = after[i]
            if sym[i] != left or j >= n or sym[j] != right:
                continue  # stale: one of the two symbols has changed
            sym[i], sym[j] = merged, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                m = merges.get((merged, sym[k]))
                if m:
                    heappush(heap, (m[0], i, m[1], merged, sym[k]))
            h = before[i]
            if h >= 0:
                m = merges.get((sym[h], merged))
                if m:
                    heappush(heap, (m[0], h, m[1], sym[h], merged))
        return tuple(s for s in sym if s >= 0)

    def __call__(self, flat: list[str]) -> tuple[np.ndarray, np.ndarray]:
        known, encode = self.known, self.encode
        found = []
        for t in flat:
            ids = known.get(t)
            if ids is None:
                ids = known[t] = encode(t)
            found.append(ids)
        if len(known) > REMEMBERED:
            self.known = dict(list(known.items())[len(known) // 2 :])
        counts = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((i for ids in found for i in ids), np.int64, int(counts.sum())), counts


def bpe_of(source: Source) -> Bpe:
    return process_cache("bpe_" + source.name, lambda: Bpe(source))


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id`` and ``ids`` of every document."""
    return with_ids(keyed_texts(docs), bpe_of, load(path))


def vocabulary(file: str) -> list[str]:
    spec = json.loads(file)
    strings = spec["model"]["vocab"] | {t["content"]: t["id"] for t in spec["added_tokens"]}
    out = [""] * (max(strings.values()) + 1)
    for s, i in strings.items():
        out[i] = s
    return out


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``encoded`` with the column ``decoded``; every other column stays."""
    source = load(path)
    shared, name = encoded.sparkSession.sparkContext.broadcast(vocabulary(source.file)), source.name  # one fixed vocabulary
    base = encoded.drop("decoded")

    def run(batches):
        strings = process_cache("bpe_strings_" + name, lambda: pa.array(shared.value, pa.string()))
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                lists = part.column("ids")
                tokens = strings.take(lists.flatten())
                sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
                text = pc.binary_join(pa.ListArray.from_arrays(offsets, tokens), " ")
                yield pa.RecordBatch.from_arrays([*part.columns, text], names=[*part.schema.names, "decoded"])

    return base.mapInArrow(run, schema_with(base, decoded="string"))


def op7_bpe(spark, sf_dir):
    encoded = encode(table(spark, sf_dir, "documents"))
    return decode(encoded).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
