"""Removal of repeated byte strings with a logarithmic family of suffix arrays.

Only sampled suffixes are indexed: of every 100-byte window the 24-byte string
with the least hash is chosen, so two equal windows choose the same place in
them.  An entry stands for the run of neighbouring windows that chose one place;
it holds the fingerprint of the 24 bytes that the sampled suffix begins with
(the sort key: only equality of long strings matters, never their alphabetic
order), a fingerprint of the run's bytes, and its place.

Documents arrive in batches.  A batch's entries are sorted into a suffix array
(a table bucketed and sorted by key), merge-scanned against itself and every
level of the index -- joins of sorted buckets, without a shuffle -- and added as
a new level; two levels of equal weight are merged into one of twice the weight.

A scan reports runs that equal an earlier run (key and run fingerprint, 128 bits
together): all their windows repeat.  Where different runs have one key, the
first of each is compared with the others window by window: windows that choose
equal places have one key, so the comparison stays inside the key's runs.

Defined results: a null text counts as empty; rows that repeat an id are taken
as the same document and get the same result; rows without an id stay whole;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tokens import ragged
from .util import keyed_texts, mix64, string_bytes, table, text_slices, written

MIN_BYTES = 100
SEED_BYTES = 24
ENTRY_BYTES = 2 << 20  # of text indexed at once: a position costs some 60 bytes for a while
COMPARE_BYTES = 2 << 20  # of runs that are compared at once
BATCHES = 3
PLACE_BITS = 24  # of a position in the part of a text handled at once
PART_BYTES = 8 << 20
KNOWN = -(1 << 63)  # in place of a run's fingerprint: the run repeats one of its slice


def run_bits(length: int) -> int:
    """Bits of a run's number of windows.  All of a run's windows hold its
    sampled string, so there are ``length - SEED_BYTES + 1`` at most."""
    if length < SEED_BYTES:
        raise ValueError(f"repeats of fewer than {SEED_BYTES} bytes are not found (length {length})")
    return (length - SEED_BYTES + 1).bit_length()


def _seed_keys(data: np.ndarray) -> np.ndarray:
    """Fingerprint of the SEED_BYTES bytes from each position on."""
    x = data.astype(np.uint64)
    for bits in (8, 16, 32):
        step = bits // 8
        x = x[:-step] | x[step:] << np.uint64(bits)
    n = len(data) - SEED_BYTES + 1
    key = np.zeros(n, np.uint64)
    for at in range(0, SEED_BYTES, 8):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + x[at : at + n])
    return key


def _least_of(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours."""
    size = 1
    while 2 * size <= width:
        v = np.minimum(v[:-size], v[size:])
        size *= 2
    return np.minimum(v[: len(v) - (width - size)], v[width - size :]) if width > size else v


def runs_of(data: np.ndarray, offsets: np.ndarray, length: int = MIN_BYTES) -> tuple[np.ndarray, ...]:
    """Entries of texts laid end to end: key, text number, first window, windows."""
    width = length - SEED_BYTES + 1
    if len(data) < length:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none
    keys = _seed_keys(data)
    place_mask = np.uint64((1 << PLACE_BITS) - 1)
    order = (keys & ~place_mask) | np.arange(len(keys), dtype=np.uint64)
    chosen = (_least_of(order, width) & place_mask).astype(np.int64)  # one for each window start
    # windows that lie inside one text
    sizes = np.diff(offsets)
    fits = np.repeat(np.maximum(sizes - length + 1, 0), sizes) if len(sizes) else sizes
    inside = np.arange(len(data)) - np.repeat(offsets[:-1], sizes) < fits
    starts = np.flatnonzero(inside[: len(chosen)])
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none
    p = chosen[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (p[1:] != p[:-1]) | (starts[1:] != starts[:-1] + 1)
    at = np.flatnonzero(new)
    first = starts[at]
    count = np.diff(np.append(at, len(starts)))
    owner = np.searchsorted(offsets, first, side="right") - 1
    return keys[p[at]], owner, first - offsets[owner], count


def _parts(data: np.ndarray, offsets: np.ndarray, length: int):
    """Texts in parts that fit a position; a longer text is cut into parts that
    overlap by less than a window, so every window lies in one part."""
    if len(data) <= PART_BYTES:
        yield data, offsets, 0, 0
        return
    for i in range(len(offsets) - 1):
        text = data[offsets[i] : offsets[i + 1]]
        for at in range(0, max(len(text), 1), PART_BYTES):
            part = text[at : at + PART_BYTES + length - 1]
            yield part, np.array([0, len(part)]), i, at


def _entries(length: int):
    bits = run_bits(length)

    def run(batches):
        for batch in text_slices(batches, limit=ENTRY_BYTES):
            data, offsets = string_bytes(batch.column("text"))
            ids = batch.column("doc_id")
            for part, ends, first_text, shift in _parts(data, offsets, length):
                keys, owner, start, count = runs_of(part, ends, length)
                raw = part.tobytes()
                begin = ends[owner] + start
                tags = np.fromiter(
                    (xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(begin.tolist(), (begin + count + length - 1).tolist())), np.uint64, len(keys)
                )
                tags[tags == np.uint64(1 << 63)] = 0  # the mark below
                doc = ids.take(pa.array(owner + first_text)).to_numpy(zero_copy_only=False).astype(np.int64)
                place = (start + shift) << bits | count
                order = np.lexsort((place, doc, tags, keys))
                keys, tags, doc, place = (x[order].astype(np.int64) if x.dtype != np.uint64 else x[order].view(np.int64) for x in (keys, tags, doc, place))
                same = np.zeros(len(keys), bool)
                same[1:] = (keys[1:] == keys[:-1]) & (tags[1:] == tags[:-1])
                head = np.maximum.accumulate(np.where(same, 0, np.arange(len(keys))))
                tie = same & (doc == doc[head]) & (place == place[head])  # a repeated row
                # Repeats inside the slice are known already: they leave the
                # key's group, so a passage that many documents share does not
                # gather in one task.
                tags[same] = KNOWN
                spread = mix64(doc.view(np.uint64) ^ mix64(place.view(np.uint64))).view(np.int64)
                keys = np.where(same, spread, keys)
                keys, tags, doc, place = (x[~tie] for x in (keys, tags, doc, place))
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(tags), pa.array(doc), pa.array(place)], names=["key", "tag", "doc_id", "place"])

    return run


def entries(docs: DataFrame, length: int = MIN_BYTES) -> DataFrame:
    """The sampled suffixes of ``docs`` (``doc_id``, ``text``)."""
    return docs.mapInArrow(_entries(length), "key long, tag long, doc_id long, place long")


class SuffixIndex:
    """Levels of sorted entries; equal weights merge."""

    def __init__(self, spark):
        self.spark = spark
        # one bucket count for every level, so that their scans need no shuffle
        self.buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        self.levels: list[tuple[int, str]] = []  # weight, table; oldest first
        self.tables: list[str] = []

    def _store(self, df: DataFrame) -> str:
        name = f"suffixes_{uuid.uuid4().hex}"
        self.tables.append(name)
        df.write.bucketBy(self.buckets, "key").sortBy("key").saveAsTable(name)
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name} PURGE")
        self.tables.remove(name)

    def close(self) -> None:
        for name in list(self.tables):
            self._drop(name)

    def add(self, batch: DataFrame, keep: bool = True) -> DataFrame:
        """What the batch's scan finds: ``doc_id``, ``place``, ``key``, and
        ``sure`` (the run repeats an earlier one; else its windows must be
        compared).  ``keep`` adds the batch to the index for later ones."""
        array = self._store(batch.repartition(self.buckets, "key"))
        stored = self.spark.table(array)
        known = stored.where(F.col("tag") == KNOWN).select("doc_id", "place", "key", F.lit(True).alias("sure"))
        rows = stored.where(F.col("tag") != KNOWN)
        of_key = Window.partitionBy("key")
        # equal places of repeated rows share a rank
        nth = F.rank().over(Window.partitionBy("key", "tag").orderBy("doc_id", "place"))
        scan = rows.select(
            "key", "tag", "doc_id", "place", nth.alias("nth"), F.min("tag").over(of_key).alias("lo"), F.max("tag").over(of_key).alias("hi")
        )
        heads = rows.groupBy("key").agg(F.min("tag").alias("lo"), F.max("tag").alias("hi"), F.min(F.struct("doc_id", "place")).alias("first"))
        sure = F.col("nth") > 1
        lo, hi = [F.col("lo")], [F.col("hi")]
        reports = []
        for i, (_, name) in enumerate(self.levels):
            level = self.spark.table(name)
            scan = scan.join(level.select("key", F.col("lo").alias(f"lo{i}"), F.col("hi").alias(f"hi{i}")), "key", "left")
            old_lo, old_hi = F.col(f"lo{i}"), F.col(f"hi{i}")
            lo.append(old_lo)
            hi.append(old_hi)
            sure = sure | F.coalesce((old_lo == F.col("tag")) & (old_hi == F.col("tag")), F.lit(False))
            # a level's only run so far, now that its key has another one
            again = level.alias("l").join(heads.alias("b"), "key")
            mixed = (F.col("l.lo") == F.col("l.hi")) & ((F.col("b.lo") != F.col("l.lo")) | (F.col("b.hi") != F.col("l.lo")))
            reports.append(again.where(mixed).select("l.doc_id", "l.place", "key", F.lit(False).alias("sure")))
        mixed = (F.least(*lo) != F.greatest(*hi)) if self.levels else F.col("lo") != F.col("hi")
        found = scan.where(sure | mixed).select("doc_id", "place", "key", sure.alias("sure")).unionByName(known)
        for more in reports:
            found = found.unionByName(more)
        found = written(found, "suffix-matches")
        if keep:
            self.levels.append((1, self._store(heads.select("key", "lo", "hi", "first.doc_id", "first.place"))))
        self._drop(array)
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            self._merge()
        return found

    def _merge(self) -> None:
        """The two newest levels, of equal weight, become one."""
        (weight, new), (_, old) = self.levels.pop(), self.levels.pop()
        a, b = self.spark.table(old).alias("a"), self.spark.table(new).alias("b")
        merged = a.join(b, F.col("a.key") == F.col("b.key"), "full").select(
            F.coalesce("a.key", "b.key").alias("key"),
            F.least("a.lo", "b.lo").alias("lo"),
            F.greatest("a.hi", "b.hi").alias("hi"),
            F.when(F.col("a.key").isNotNull(), F.col("a.doc_id")).otherwise(F.col("b.doc_id")).alias("doc_id"),
            F.coalesce("a.place", "b.place").alias("place"),
        )
        self.levels.append((2 * weight, self._store(merged)))
        self._drop(old)
        self._drop(new)


def _run_bytes(length: int):
    """The bytes of each text's runs that must be compared."""
    bits = run_bits(length)

    def run(batches):
        for batch in text_slices(batches):
            key, doc, begin, data, large = [], [], [], [], []
            for d, text, found in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), batch.column("runs").to_pylist()):
                raw = text.encode()
                for m in found:
                    a, n = m["place"] >> bits, m["place"] & (1 << bits) - 1
                    key.append(m["key"])
                    doc.append(d)
                    begin.append(a)
                    data.append(raw[a : a + n + length - 1])
                    large.append(m["large"])
            yield pa.RecordBatch.from_arrays(
                [pa.array(key, pa.int64()), pa.array(doc, pa.int64()), pa.array(begin, pa.int64()), pa.array(data, pa.binary()), pa.array(large, pa.bool_())],
                names=["key", "doc_id", "begin", "data", "large"],
            )

    return run


def _windows(rows: list[tuple], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Digest, document and start of every window of the runs."""
    digests = [xxhash.xxh3_128_digest(r[3][i : i + length]) for r in rows for i in range(len(r[3]) - length + 1)]
    sizes = np.array([len(r[3]) - length + 1 for r in rows], np.int64)
    doc = np.repeat(np.array([r[1] for r in rows], np.int64), sizes)
    start = np.repeat(np.array([r[2] for r in rows], np.int64), sizes) + ragged(np.zeros(len(sizes), np.int64), sizes)
    return np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2), doc, start


def _compared(rows: list[tuple], length: int) -> pa.RecordBatch:
    """Byte ranges of the windows that repeat, of keys that are all here."""
    pair, doc, start = _windows(rows, length)
    order = np.lexsort((start, doc, pair[:, 1], pair[:, 0]))
    pair, doc, start = pair[order], doc[order], start[order]
    same = np.zeros(len(doc), bool)
    same[1:] = (pair[1:] == pair[:-1]).all(1)
    head = np.maximum.accumulate(np.where(same, 0, np.arange(len(doc))))
    later = same & ((doc != doc[head]) | (start != start[head]))
    doc, start = doc[later], start[later]
    # neighbouring windows become one range
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    none = pa.nulls(len(first), pa.int64())
    return _ranges(none, none, doc[first], start[first], start[last] + length)


def _ranges(d1, d2, doc, begin, end) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([d1, d2, pa.array(doc), pa.array(begin), pa.array(end)], names=["d1", "d2", "doc_id", "begin", "end"])


def _compare(length: int):
    """Runs in order of their key.  Keys are compared whole; the runs of a key
    that is marked large, and those of a key with more bytes than fit, send
    their windows on with their digests."""

    def spread(rows):
        pair, doc, start = _windows(rows, length)
        return _ranges(pa.array(pair[:, 0].copy()), pa.array(pair[:, 1].copy()), doc, start, start + length)

    def run(batches):
        earlier, held, size, held_size, large = [], [], 0, 0, False  # whole keys; the last key, of which all is sent on if it is large
        for batch in batches:
            for row in zip(*(batch.column(n).to_pylist() for n in ("key", "doc_id", "begin", "data", "large"))):
                if held and row[0] != held[-1][0]:
                    if large:
                        yield spread(held)
                    else:
                        earlier += held
                        size += held_size
                    held, held_size, large = [], 0, False
                    if size > COMPARE_BYTES:
                        yield _compared(earlier, length)
                        earlier, size = [], 0
                elif held_size > COMPARE_BYTES:
                    yield spread(held)
                    held, held_size, large = [], 0, True
                held.append(row)
                held_size += len(row[3])
                large = large or row[4]
        if held and large:
            yield spread(held)
        elif held:
            earlier += held
        if earlier:
            yield _compared(earlier, length)

    return run


def repeated_spans(docs: DataFrame, length: int = MIN_BYTES, batches: int = BATCHES) -> DataFrame:
    """``doc_id`` and ``spans``: the byte ranges of each text that also start
    earlier, as strings of ``length`` bytes (ranges may overlap).  ``length`` is
    at least ``SEED_BYTES``; a shorter one is an error."""
    bits = run_bits(length)
    spark = docs.sparkSession
    texts = keyed_texts(docs).where(F.col("doc_id").isNotNull())
    cuts = texts.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 1000)).first()[0] or []  # a few ids
    index = SuffixIndex(spark)
    matches = None
    try:
        bounds = [None, *sorted(set(cuts)), None]
        for i, (low, high) in enumerate(zip(bounds, bounds[1:])):
            part = texts if low is None else texts.where(F.col("doc_id") > low)
            part = part if high is None else part.where(F.col("doc_id") <= high)
            found = index.add(entries(part, length), keep=i + 2 < len(bounds))
            matches = found if matches is None else matches.unionByName(found)
    finally:
        index.close()
    again = matches.where("sure").select(
        "doc_id",
        F.shiftright("place", bits).alias("begin"),
        (F.shiftright("place", bits) + F.col("place").bitwiseAND((1 << bits) - 1) + (length - 1)).alias("end"),
    )
    unsure = matches.where(~F.col("sure")).select("key", "doc_id", "place")
    run_bytes = F.col("place").bitwiseAND((1 << bits) - 1) + (length - 1)
    hot = unsure.groupBy("key").agg(F.sum(run_bytes).alias("n")).where(F.col("n") > COMPARE_BYTES).select("key", F.lit(True).alias("large"))
    # a key for each COMPARE_BYTES of runs at most; a hot key's runs stay where they are
    marked = unsure.join(F.broadcast(written(hot, "suffix-large-keys")), "key", "left").withColumn("large", F.coalesce("large", F.lit(False)))
    runs = marked.groupBy("doc_id").agg(F.collect_set(F.struct("key", "place", "large")).alias("runs"))  # one text's runs
    # a large key's runs are dealt over all tasks: their windows meet by digest
    dealt = F.when(F.col("large"), F.xxhash64("doc_id", "begin")).otherwise(F.col("key"))
    compared = (
        texts.join(runs, "doc_id")
        .select("doc_id", "text", "runs")
        .mapInArrow(_run_bytes(length), "key long, doc_id long, begin long, data binary, large boolean")
        .repartition(dealt)
        .sortWithinPartitions("key")
        .mapInArrow(_compare(length), "d1 long, d2 long, doc_id long, begin long, end long")
    )
    compared = written(compared, "suffix-windows")
    windows = compared.where("d1 IS NOT NULL")
    firsts = windows.groupBy("d1", "d2").agg(F.min(F.struct("doc_id", "begin")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    spread = windows.join(firsts, ["d1", "d2"]).where((F.col("doc_id") != F.col("first.doc_id")) | (F.col("begin") != F.col("first.begin")))
    names = ["doc_id", "begin", "end"]
    ranges = again.unionByName(compared.where("d1 IS NULL").select(*names)).unionByName(spread.select(*names))
    return ranges.groupBy("doc_id").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))  # one text's ranges


def _without(raw: bytes, spans: list[dict]) -> tuple[bytes, int]:
    """The bytes outside all spans, and the number of runs removed."""
    at, kept, runs = 0, [], 0
    for s in sorted(spans, key=lambda s: s["begin"]):
        if not runs or s["begin"] > at:
            kept.append(raw[at : s["begin"]])
            runs += 1
        at = max(at, s["end"])
    kept.append(raw[at:])
    return b"".join(kept), runs


def _cut(batches):
    for batch in text_slices(batches):
        out = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept": []}
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
            raw = text.encode()
            left, runs = _without(raw, spans or [])
            out["n_bytes"].append(len(raw))
            out["n_removed"].append(len(raw) - len(left))
            out["n_spans"].append(runs)
            out["kept"].append(left)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(out[k], pa.int64()) for k in ("n_bytes", "n_removed", "n_spans")), pa.array(out["kept"], pa.binary())],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
        )


def remove_repeats(docs: DataFrame, length: int = MIN_BYTES, batches: int = BATCHES) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans`` and the bytes that
    are left (``kept``) of every document."""
    spans = repeated_spans(docs, length, batches)
    joined = keyed_texts(docs).join(spans, "doc_id", "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def cut_documents(docs: DataFrame, length: int = MIN_BYTES, batches: int = BATCHES) -> DataFrame:
    """``docs`` with all columns, the repeats cut out of ``text``.  A character
    of which only some bytes are left goes."""
    spans = repeated_spans(docs, length, batches).select(F.col("doc_id").alias("_id"), F.col("spans").alias("_spans"))
    names = docs.columns
    joined = docs.join(spans, docs["doc_id"] == spans["_id"], "left").drop("_id")
    at = names.index("text")

    def run(batches):
        for batch in text_slices(batches):
            texts = [
                t if not s else _without((t or "").encode(), s)[0].decode(errors="ignore")
                for t, s in zip(batch.column("text").to_pylist(), batch.column("_spans").to_pylist())
            ]
            columns = [batch.column(n) for n in names]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return joined.select(*names, "_spans").mapInArrow(run, docs.schema)


def op2_suffix_dedup(spark, sf_dir):
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
