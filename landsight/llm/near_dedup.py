"""Near-duplicate detection by MinHash with tensored banding.

Two small collections of half keys are computed for every document, each half
key from a few minhashes.  A table is a pair (i, j): its key joins half key i of
the first collection with half key j of the second, so ``HALVES`` squared tables
need only twice ``HALVES`` half keys.  A half key that no other document has
cannot complete a shared table key, so only shared half keys are combined.

Documents with equal shingle sets are one class from the start.  In every
bucket the members meet the bucket's smallest member, its pivot; links are
confirmed on the full sets and joined to components.  Pivots of one component
and all their members are a group.  Members of a group that are then still in
several components are compared by what they differ in from the group's usual
shingles: two members differ from each other in what only one of them differs
in, so those that differ much from the usual can only be linked if they share
many of their differences.  Of the pairs that share one, those whose places
among the rarest differences leave too few to share are dropped, and the rest is
confirmed.  No link inside a bucket is lost to the shortcut, and copies that
differ each in its own way are not compared in pairs.

At similarity 0.8 a table-free miss has probability 2 * (1 - 0.8 ** ROWS) **
HALVES, about 2e-5; it falls steeply above.

Defined results: documents without words or text have an empty set and are
linked with nothing; fewer words than a shingle count as one shingle; repeated
rows of one id are judged each, and linked by that id; rows without an id are
linked with nothing and left out by ``drop_near_copies``; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .util import keyed_texts, mix64, table, text_slices, words_of, written

SHINGLE = 5
PERCENT = 80
ROWS = 3  # minhashes in a half key
HALVES = 16  # half keys in each of the two collections
SHARED = 2  # rare differences that two members of a group must share, if they need as many: more confirm fewer pairs, but meet more


def shingle_hashes(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit shingle hashes of all texts, ascending within a text,
    and the offsets of each text's set."""
    n = len(texts)
    words, rows = words_of(pc.ascii_lower(texts))
    coded = words.dictionary_encode()
    vocabulary = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    hashes = vocabulary[coded.indices.to_numpy(zero_copy_only=False)]
    counts = np.bincount(rows, minlength=n)
    acc = np.zeros(max(len(hashes) - width + 1, 0), np.uint64)
    for k in range(width):
        acc = mix64(acc * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + len(acc)])
    inside = rows[: len(acc)] == rows[width - 1 :] if len(acc) else np.zeros(0, bool)
    found, owner = [acc[inside]], [rows[: len(acc)][inside]]
    # shorter texts: the whole sequence is one shingle
    first = np.cumsum(counts) - counts
    for size in range(1, width):
        short = np.flatnonzero(counts == size)
        one = np.full(len(short), size, np.uint64)
        for k in range(size):
            one = mix64(one * np.uint64(0x9E3779B97F4A7C15) + hashes[first[short] + k])
        found.append(one)
        owner.append(short)
    h, o = np.concatenate(found), np.concatenate(owner)
    order = np.lexsort((h, o))
    h, o = h[order], o[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    sizes = np.bincount(o[new], minlength=n)
    return h[new], np.concatenate([[0], np.cumsum(sizes)])


def half_keys(h: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Two collections of HALVES half keys for each non-empty set."""
    rng = np.random.default_rng(20)
    full = np.flatnonzero(np.diff(offsets))
    out = np.zeros((len(full), 2 * HALVES), np.uint64)
    starts = offsets[:-1][full]
    for half in range(2 * HALVES):
        key = np.full(len(full), half, np.uint64)
        for _ in range(ROWS):
            a, b = rng.integers(1, 1 << 63, 2, dtype=np.uint64)
            least = np.minimum.reduceat((h ^ b) * (a | np.uint64(1)), starts) if len(full) else key
            key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + least)
        out[:, half] = key
    return out


def _signatures(width: int):
    def run(batches):
        for batch in text_slices(batches):
            h, offsets = shingle_hashes(batch.column("text"), width)
            sizes = np.diff(offsets)
            keys = half_keys(h, offsets).view(np.int64)
            data = h.tobytes()
            digests = [xxhash.xxh3_128_hexdigest(data[8 * a : 8 * b]) for a, b in zip(offsets[:-1], offsets[1:])]
            at = np.concatenate([[0], np.cumsum(np.where(sizes > 0, 2 * HALVES, 0))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes.astype(np.int64)), pa.array(digests), pa.ListArray.from_arrays(at, pa.array(keys.ravel()))],
                names=["doc_id", "n_shingles", "digest", "halves"],
            )

    return run


def _sets(width: int):
    def run(batches):
        for batch in text_slices(batches):
            h, offsets = shingle_hashes(batch.column("text"), width)
            data = h.tobytes()
            sets = [data[8 * a : 8 * b] for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sets, pa.binary())], names=["doc_id", "hashes"])

    return run


def _confirm(percent: int):
    def run(batches):
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("a"), batch.column("b")):
                x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return run


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose full sets are similar enough."""
    a = sets.select(F.col("doc_id").alias("u"), F.col("hashes").alias("a"))
    b = sets.select(F.col("doc_id").alias("v"), F.col("hashes").alias("b"))
    joined = pairs.select("u", "v").join(a, "u").join(b, "v").select("u", "v", "a", "b")
    return joined.mapInArrow(_confirm(percent), "u long, v long")


def near_duplicates(docs: DataFrame, width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` of every document."""
    texts = keyed_texts(docs)
    signed = written(texts.mapInArrow(_signatures(width), "doc_id long, n_shingles long, digest string, halves array<long>"), "near-signatures")
    classes = written(
        signed.where("n_shingles > 0").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")), "near-classes"
    )
    firsts = signed.join(classes.select(F.col("rep").alias("doc_id"), "digest"), ["doc_id", "digest"], "left_semi")
    tables = written(_table_keys(firsts), "near-tables")

    wanted = tables.select("doc_id").distinct()
    sets = written(
        texts.join(wanted, "doc_id", "left_semi").mapInArrow(_sets(width), "doc_id long, hashes binary"), "near-sets"
    )
    similar_size = 100 * F.least("nu", "nv") >= percent * F.greatest("nu", "nv")

    # every member meets the smallest member of its bucket
    least = tables.groupBy("key").agg(F.min(F.struct("doc_id", "n_shingles")).alias("m"), F.count(F.lit(1)).alias("n")).where("n > 1")
    groups = tables.join(least, "key").select(
        F.col("m.doc_id").alias("u"), F.col("doc_id").alias("v"), F.col("m.n_shingles").alias("nu"), F.col("n_shingles").alias("nv")
    )
    groups = written(groups.where("u <> v").distinct(), "near-groups")
    links = written(_links(groups.where(similar_size), sets, percent), "near-links")
    joined = components(links)

    more = written(_links(_apart(groups, joined, sets, percent), sets, percent), "near-links")
    if more.limit(1).count():
        joined = components(joined.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(more))

    named = classes.join(joined, classes["rep"] == joined["node"], "left").select(
        F.col("digest").alias("d"), F.coalesce("component", "rep").alias("component_id"), F.col("n").alias("size")
    )
    # only classes of several rows, or with a link, differ from the id itself
    return signed.join(named, F.col("digest") == F.col("d"), "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")
    )


def _shingles(batches):
    """Sets of members -> their shingles."""
    for batch in batches:
        data = batch.column("b")
        sizes = pc.binary_length(data).to_numpy(zero_copy_only=False) // 8
        at = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        flat = np.concatenate([*(np.frombuffer(b.as_buffer(), np.int64) for b in data), np.zeros(0, np.int64)])
        yield pa.RecordBatch.from_arrays([batch.column("pivot"), pa.ListArray.from_arrays(at, pa.array(flat))], names=["pivot", "shingles"])


def _differences(batches):
    """Usual shingles of a group and the set of a member -> the shingles that
    only one of them has."""
    for batch in batches:
        found = []
        for a, b in zip(batch.column("usual"), batch.column("b")):
            x = a.values.to_numpy() if a.is_valid else np.zeros(0, np.int64)
            found.append(np.setxor1d(x, np.frombuffer(b.as_buffer(), np.int64), assume_unique=True))
        at = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
        flat = pa.array(np.concatenate([*found, np.zeros(0, np.int64)]))
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("pivot", "doc_id", "n", "component")), pa.ListArray.from_arrays(at, flat)],
            names=["pivot", "doc_id", "n", "component", "differing"],
        )


def _apart(groups: DataFrame, joined: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) that share a pivot's bucket, are in different components and
    that nothing below shows to be no link.

    Pivots of one component are one group, so that members who share many pivots
    are compared once.  The members are compared by what they differ in from the
    group's usual shingles, those of more than half of its members: no other set
    leaves fewer differences in all.

    With similarity t, sets of n and m shingles have a link if they differ in at
    most (1 - t) / (1 + t) * (n + m) shingles.  Let D and E be what they differ
    in from the usual ones; then they differ in |D| + |E| - 2 |D and E|.  With the
    excess e = (1 + t) |D| - (1 - t) n of each (times 100 here), a link needs
    (e + f) / 2 / (1 + t) shared differences.

    Pairs that need none have excesses of zero or less together, and so has each
    of the two with the member of least excess: they meet that one.  Others share
    a difference; put in one order, rarest first, the first one they share is
    at places i and j, and no more than 1 + min(|D| - i, |E| - j) are shared."""
    members = groups.select(F.col("u").alias("first"), F.col("v").alias("doc_id")).unionByName(
        groups.select(F.col("u").alias("first"), F.col("u").alias("doc_id")).distinct()
    )
    of_first = joined.select(F.col("node").alias("first"), F.col("component").alias("of_first"))
    of_doc = joined.select(F.col("node").alias("doc_id"), "component")
    placed = members.join(of_first, "first", "left").join(of_doc, "doc_id", "left").select(
        F.coalesce("of_first", "first").alias("pivot"), "doc_id", F.coalesce("component", "doc_id").alias("component")
    )
    placed = placed.distinct()
    mixed = placed.groupBy("pivot").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("members"))
    mixed = mixed.where("lo < hi").select("pivot", "members")
    placed = written(placed.join(mixed, "pivot"), "near-members")
    b = sets.select("doc_id", F.col("hashes").alias("b"))
    held = placed.join(b, "doc_id").select("pivot", "doc_id", (F.octet_length("b") / 8).cast("long").alias("n"), "component", "b")
    counted = held.select("pivot", "b").mapInArrow(_shingles, "pivot long, shingles array<long>").select("pivot", F.explode("shingles").alias("hash"))
    counted = counted.groupBy("pivot", "hash").agg(F.count(F.lit(1)).alias("times"))
    # at most twice as many as a member has on average
    usual = counted.join(placed.select("pivot", "members").distinct(), "pivot").where(2 * F.col("times") > F.col("members"))
    usual = written(usual.groupBy("pivot").agg(F.collect_list("hash").alias("usual")), "near-usual")
    both = held.join(usual, "pivot", "left").select("pivot", "doc_id", "n", "component", "usual", "b")
    found = both.mapInArrow(_differences, "pivot long, doc_id long, n long, component long, differing array<long>")
    size = F.size("differing").cast("long")
    found = found.withColumns({"size": size, "excess": (100 + percent) * size - (100 - percent) * F.col("n")})
    found = written(found, "near-differences")

    # of each pivot: the member of least excess, and the component that holds most members
    held = found.groupBy("pivot", "component").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("excess", "doc_id")).alias("low"))
    of_pivot = held.groupBy("pivot").agg(
        F.max_by("component", F.struct("n", "component")).alias("most"), F.min(F.struct("low.excess", "low.doc_id", "component")).alias("low")
    )
    of_pivot = written(of_pivot, "near-pivots")
    to_lowest = found.join(of_pivot, "pivot").where((F.col("excess") + F.col("low.excess") <= 0) & (F.col("component") != F.col("low.component")))
    none_shared = to_lowest.select(F.least("doc_id", "low.doc_id").alias("u"), F.greatest("doc_id", "low.doc_id").alias("v"))

    def needed(excess):
        return F.greatest(F.lit(1), F.ceil(excess / F.lit(2 * (100 + percent))))

    # only members outside the component that holds most of them look for others
    looking = found.join(of_pivot.select("pivot", "most"), "pivot").withColumn("looks", F.col("component") != F.col("most"))
    rows = looking.select("pivot", "doc_id", "component", "size", "excess", "looks", F.explode("differing").alias("hash"))
    differing = found.select("pivot", "excess", F.explode("differing").alias("hash"))
    counts = differing.groupBy("pivot", "hash").agg(F.count(F.lit(1)).alias("df"), F.min("excess").alias("least"))
    place = F.row_number().over(Window.partitionBy("pivot", "doc_id").orderBy("df", "hash"))  # one set
    rows = rows.join(counts, ["pivot", "hash"]).withColumn("place", place)
    # places from which not even the member of least excess can be reached go
    reach = SHARED + F.col("size") - F.col("place") >= needed(F.col("excess") + F.col("least"))
    first = rows.where((F.col("df") > 1) & reach)
    first = written(first.select("pivot", "hash", "doc_id", "component", "size", "excess", "place", "looks"), "near-first")
    one, two = (first.select("pivot", "hash", "looks", *(F.col(c).alias(c + x) for c in ("doc_id", "component", "size", "excess", "place"))) for x in "uv")
    can_share = SHARED + F.least(F.col("sizeu") - F.col("placeu"), F.col("sizev") - F.col("placev"))
    # of two that both look, the smaller one does
    one, two = one.where("looks").drop("looks"), two.withColumnRenamed("looks", "looksv")
    meets = one.join(two, ["pivot", "hash"]).where(
        (~F.col("looksv") | (F.col("doc_idu") < F.col("doc_idv")))
        & (F.col("componentu") != F.col("componentv"))
        & (can_share >= needed(F.col("excessu") + F.col("excessv")))
    )
    met = meets.groupBy("pivot", "doc_idu", "doc_idv").agg(F.count(F.lit(1)).alias("n"), F.first(needed(F.col("excessu") + F.col("excessv"))).alias("needed"))
    pairs = met.where(F.col("n") >= F.least(F.col("needed"), F.lit(SHARED))).select(F.least("doc_idu", "doc_idv").alias("u"), F.greatest("doc_idu", "doc_idv").alias("v"))
    return pairs.unionByName(none_shared).distinct()


def _table_keys(firsts: DataFrame) -> DataFrame:
    """``key``, ``doc_id``, ``n_shingles`` of every table whose two half keys
    are both shared with another document."""
    halves = firsts.select("doc_id", "n_shingles", F.posexplode("halves").alias("half", "value"))
    shared = halves.groupBy("half", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("half", "value")
    mine = halves.join(shared, ["half", "value"], "left_semi")
    first = F.collect_list(F.when(F.col("half") < HALVES, F.xxhash64("half", "value")))  # at most HALVES entries
    second = F.collect_list(F.when(F.col("half") >= HALVES, F.xxhash64("half", "value")))
    return (
        mine.groupBy("doc_id", "n_shingles")
        .agg(first.alias("first"), second.alias("second"))
        .select("doc_id", "n_shingles", F.explode("first").alias("one"), "second")
        .select("doc_id", "n_shingles", "one", F.explode("second").alias("two"))
        .select(F.xxhash64("one", "two").alias("key"), "doc_id", "n_shingles")
    )


def drop_near_copies(docs: DataFrame, width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One document of each component stays (the smallest id), with all its columns."""
    kept = near_duplicates(docs, width, percent).where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("_kept"))
    return docs.join(kept.distinct(), docs["doc_id"] == F.col("_kept"), "left_semi")


def op6_minhash_near_dedup(spark, sf_dir):
    found = near_duplicates(table(spark, sf_dir, "documents"), width=4)
    return found.withColumn("kept", F.col("doc_id") == F.col("component_id"))


OP6_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
starts AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 2))) AS i FROM w WHERE len(ws) > 0),
sh AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS s FROM starts),
sizes AS (SELECT w.doc_id, count(sh.doc_id) AS n FROM w LEFT JOIN sh ON w.doc_id = sh.doc_id GROUP BY w.doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id AS x, doc_id AS y FROM w UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON r.y = b.x),
comp AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x)
SELECT s.doc_id, s.n AS n_shingles, component_id, s.doc_id = component_id AS kept
FROM sizes s JOIN comp ON s.doc_id = comp.x
"""
