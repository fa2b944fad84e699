"""Exact, near and passage deduplication against brute force."""

import collections
import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from landsight.llm import components, exact_dedup, near_dedup, suffix_dedup

from .conftest import SF, prose


def texts(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


# ---- exact -----------------------------------------------------------------------------


@settings(max_examples=15, deadline=None)
@given(st.integers(1, 3000), st.integers(0, 2**32))
def test_fuse_filter_holds_its_keys(n, seed):
    rng = np.random.default_rng(seed)
    keys = rng.integers(0, 2**64, n, dtype=np.uint64)
    built = exact_dedup.build_fuse(keys)
    assert exact_dedup.fuse_contains(keys, *built).all()
    others = rng.integers(0, 2**64, 20_000, dtype=np.uint64)
    assert exact_dedup.fuse_contains(others, *built).mean() < 0.02


def check_exact(docs):
    rows = texts(docs)
    by = collections.defaultdict(list)
    for i, t in rows:
        by[t].append(i)
    got = sorted((r.doc_id, r.keep_id, r.group_size, r.digest) for r in exact_dedup.find_groups(docs).collect())
    assert got == sorted((i, max(by[t]), len(by[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in rows)


def test_exact_groups(spark, odd_docs):
    check_exact(odd_docs)
    check_exact(spark.read.parquet(f"{SF}/documents.parquet"))


def test_exact_on_an_empty_table_and_what_stays(odd_docs):
    assert exact_dedup.find_groups(odd_docs.where("false")).count() == 0
    kept = exact_dedup.drop_copies(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 5, 5, 6, 7, 8, 9]


def test_a_digest_hit_with_other_bytes_is_no_copy(spark, monkeypatch):
    """Were two texts to share a digest, the byte check would keep them apart."""
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(i, f"text {i}") for i in range(30)], "doc_id long, text string")
    real = exact_dedup.digests_of
    monkeypatch.setattr(exact_dedup, "digests_of", lambda d, b: real(d, b).withColumn("digest", F.sha2(F.lit("same"), 256)))
    sizes = [r.group_size for r in exact_dedup.find_groups(docs).collect()]
    assert max(sizes) < 30  # batches are not joined on a digest alone


# ---- near ------------------------------------------------------------------------------

NOT_WORD = re.compile(r"[\x20\x09-\x0D]+")


def shingles(text, width):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = [w for w in NOT_WORD.split(low) if w]
    if len(words) < width:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def brute_components(rows, width, percent=80):
    sets = {}
    parent = {}
    for i, t in rows:
        sets[i] = shingles(t, width)
        parent[i] = i

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            x, y = sets[a], sets[b]
            if a < b and x and y and 100 * len(x & y) >= percent * len(x | y):
                ra, rb = find(a), find(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {i: (len(sets[i]), find(i)) for i in ids}


def check_near(docs, width):
    want = brute_components(texts(docs), width)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs, width).collect()}
    assert got == want


def test_near_groups(spark, odd_docs):
    check_near(odd_docs, 4)
    check_near(spark.read.parquet(f"{SF}/documents.parquet"), 5)


def test_a_group_of_edited_copies(spark):
    """Copies with few to many edits, some of them shared: the smallest id is an
    outlying copy, and chains decide the components."""
    base = prose(3, 150).split()
    rows = []
    for i in range(60):
        words = list(base)
        for e in range((i * 7) % 9):
            words[(i * 31 + e * 13) % 150] = f"edit{(i + e) % 11}"
        rows.append((i, " ".join(words)))
    check_near(spark.createDataFrame(rows, "doc_id long, text string"), 4)


def test_near_on_an_empty_table_and_what_stays(odd_docs):
    assert near_dedup.near_duplicates(odd_docs.where("false")).count() == 0
    kept = near_dedup.drop_near_copies(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 4, 6, 7, 8, 9]


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{100 + i: 100 for i in range(1, 30)}}


# ---- passages --------------------------------------------------------------------------


def brute_cut(rows, length):
    seen, out = set(), {}
    for i, t in sorted(set(rows)):
        raw = t.encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - length + 1):
            w = raw[s : s + length]
            if w in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(w)
        left = bytes(b for b, g in zip(raw, gone) if not g)
        runs = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(raw), len(raw) - len(left), runs, left)
    return out


def check_cut(docs, length=100, batches=3):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.remove_repeats(docs, length, batches).collect()}
    assert got == brute_cut(texts(docs), length)


def test_repeats_are_cut(spark, odd_docs):
    check_cut(odd_docs)
    check_cut(spark.read.parquet(f"{SF}/documents.parquet"))


def test_matches_of_just_the_length_and_one_byte_less(spark):
    a, b, c = prose(5, 80), prose(6, 80), prose(7, 80)
    rows = [(0, a), (1, b[:90] + a[100:200] + b[200:]), (2, c[:50] + a[301:400] + c[60:]), (3, "x" * 450 + "é" * 120), (4, "x" * 260), (5, a[:30] * 9)]
    check_cut(spark.createDataFrame(rows, "doc_id long, text string"), batches=5)


def test_a_key_with_more_runs_than_are_held(spark, monkeypatch):
    """A common line in many contexts: the comparison goes on with digests."""
    line = prose(8, 9)
    rows = [(i, prose(20 + i, 20) + " " + line + " " + prose(50 + i % 3, 20)) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    check_cut(docs)
    monkeypatch.setattr(suffix_dedup, "COMPARE_BYTES", 2000)
    check_cut(docs)


def test_a_hot_key_after_a_small_one(monkeypatch):
    """A key beyond the bound goes on with digests, whatever is held before it."""
    import pyarrow as pa

    monkeypatch.setattr(suffix_dedup, "COMPARE_BYTES", 2000)
    most = []
    windows = suffix_dedup._windows
    monkeypatch.setattr(suffix_dedup, "_windows", lambda rows, length: most.append(sum(len(r[3]) for r in rows)) or windows(rows, length))
    rows = [(1, 1, 0, b"a" * 120), (1, 2, 0, b"a" * 120), *((2, i, 7, b"b" * 119 + bytes([i])) for i in range(200)), (3, 4, 5, b"c" * 110), (3, 5, 5, b"c" * 110)]
    for marked in (False, True):
        most.clear()
        names = ["key", "doc_id", "begin", "data", "large"]
        columns = [pa.array(c) for c in zip(*((*r, marked and r[0] == 2) for r in rows))]
        batch = pa.RecordBatch.from_arrays(columns, names=names)
        out = [r for b in suffix_dedup._compare(100)([batch.slice(i, 50) for i in range(0, len(rows), 50)]) for r in b.to_pylist()]
        hot = [r for r in out if r["d1"] is not None]
        assert len(hot) == 200 * 21 and {r["doc_id"] for r in hot} == set(range(200))
        # one letter holds one window again and again, also in its first document
        rest = sorted((r["doc_id"], r["begin"], r["end"]) for r in out if r["d1"] is None)
        assert rest == [(1, 1, 120), (2, 0, 120), (4, 6, 115), (5, 5, 115)]
        if not marked:
            assert max(most) <= 2000 + 240


def test_a_line_before_another_text_in_most_documents(spark, monkeypatch):
    """Large keys are marked before they are dealt, and their runs are not
    dealt by the key alone."""
    monkeypatch.setattr(suffix_dedup, "COMPARE_BYTES", 4000)
    line = prose(8, 40)
    rows = [(i, prose(100 + i, 9) + " " + (line + " " if i % 3 else "") + prose(300 + i, 40)) for i in range(90)]
    check_cut(spark.createDataFrame(rows, "doc_id long, text string"))


def test_other_lengths(spark):
    """Runs of more windows than a byte counts; too short a length is an error."""
    passage, rng = prose(70, 260), np.random.default_rng(3)
    rows = [(i, prose(71 + i, 12) + " " + passage[int(a) : int(a) + 120 + 260 * (i % 6)] + " " + prose(90 + i, 12)) for i, a in enumerate(rng.integers(0, 300, 24))]
    rows += [(50, "ab" * 900), (51, "x" * 1300), (52, rows[3][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for length in (24, 64, 150, 200, 1000):
        check_cut(docs, length)
    for length in (0, 20, 23):
        with pytest.raises(ValueError, match="24 bytes"):
            suffix_dedup.remove_repeats(docs, length)


def test_cut_on_an_empty_table_and_documents(odd_docs):
    assert suffix_dedup.remove_repeats(odd_docs.where("false")).count() == 0
    cut = suffix_dedup.cut_documents(odd_docs)
    assert cut.columns == odd_docs.columns and cut.count() == odd_docs.count()
    assert {r.text for r in cut.where("doc_id = 5").collect()} == {""}


def test_levels_merge_geometrically(spark):
    index = suffix_dedup.SuffixIndex(spark)
    try:
        weights = []
        for k in range(5):
            part = spark.createDataFrame([(k, prose(k, 100))], "doc_id long, text string")
            index.add(suffix_dedup.entries(part))
            weights.append([w for w, _ in index.levels])
        assert weights == [[1], [2], [2, 1], [4], [4, 1]]
    finally:
        index.close()
    assert not index.tables


def near_group(n, edits, words=220, seed=9):
    """Copies of one text with ``edits`` words changed each, at places of its own."""
    rng = np.random.default_rng(seed)
    base = [f"w{int(x)}" for x in rng.integers(0, 5000, words)]
    out = []
    for i in range(n):
        text = list(base)
        for k in rng.choice(words, edits, replace=False):
            text[k] = f"x{i}y{int(k)}"
        out.append((i, " ".join(text)))
    return out


def test_confirmed_pairs_grow_with_the_members(spark, monkeypatch):
    """Copies that differ each in its own way, most of them too much for a link: a
    member meets a pivot in each of its tables at most, and hardly any other."""
    seen = []
    real = near_dedup._links

    def links(pairs, sets, percent):
        seen[-1].append(pairs.count())
        return real(pairs, sets, percent)

    monkeypatch.setattr(near_dedup, "_links", links)
    for n in (150, 300, 600):
        docs = spark.createDataFrame(near_group(n, 5), "doc_id long, text string")
        seen.append([])
        near_dedup.near_duplicates(docs, 5).count()
    for n, (to_pivots, others) in zip((150, 300, 600), seen):
        assert others <= 0.05 * n * (n - 1) / 2 and to_pivots <= near_dedup.HALVES**2 * n
    assert seen[2][0] < 4 * seen[1][0], seen  # not with the square


def test_members_of_many_pivots_are_compared_once(spark, monkeypatch):
    """Copies at many distances from each other share many pivots: they are set
    against the usual shingles of the pivots' component, once."""
    rows = {}
    real = near_dedup.written

    def written(df, name):
        out = real(df, name)
        if name in ("near-differences", "near-first"):
            rows[name] = out.count()
        return out

    monkeypatch.setattr(near_dedup, "written", written)
    docs = [(10 * i + e, text) for e in range(1, 9) for i, text in near_group(60, e)]
    out = near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), 5)
    assert out.count() == len(docs)
    assert rows["near-differences"] <= 10 * len(docs) and rows["near-first"] <= 100 * len(docs), rows


def test_links_between_members_that_fail_the_pivot(spark):
    """The smallest member is far from all; the others form chains by small steps,
    some of which have no difference from it in common."""
    rng = np.random.default_rng(4)
    base = near_group(1, 0)[0][1].split()
    rows = [(0, " ".join("p" + w if i % 11 == 0 else w for i, w in enumerate(base)))]
    text = list(base)
    for i in range(1, 60):
        for k in rng.choice(len(text), 2, replace=False):
            text[k] = f"c{i}z{int(k)}"
        rows.append((i, " ".join(text)))
        if i % 20 == 0:
            text = list(base)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs, 5).collect()}

    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    parent = {i: i for i, _ in rows}
    for i in sets:
        for j in sets:
            if i < j and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = parent[i], parent[j]
                parent = {k: min(a, b) if p in (a, b) else p for k, p in parent.items()}
    assert found == parent


def test_components_of_odd_edges(spark):
    schema = "u long, v long, key string"
    none = spark.createDataFrame([], schema)
    assert components.components(none).count() == 0
    edges = [(5, 3, "a"), (3, 5, "b"), (3, 3, "c"), (None, 4, "d"), (9, None, "e"), (8, 7, "f"), (7, 6, "g"), (6, 5, "h")] + [(i, i + 1, "l") for i in range(100, 160)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, schema)).collect()}
    assert got == {5: 3, 6: 3, 7: 3, 8: 3} | {i: 100 for i in range(101, 161)}
