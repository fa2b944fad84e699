"""Searches and hard negatives against brute force."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from landsight.llm import ball_search, hard_negatives, lexical_search
from landsight.llm.vectors import integer_vectors, for_scores

from .conftest import SF

VECTORS = "vec_id long, embedding array<float>, label int, v string, score long, cell int, block int, part int, q string"


def scaled(x, scale):
    return [math.floor(scale * float(np.float32(c))) for c in x]


def takes_part(row):
    return row[0] is not None and row[1] is not None and all(c is not None and math.isfinite(c) for c in row[1])


@pytest.fixture(scope="module")
def vectors(spark):
    """Clusters, a vector that a third of the rows hold, repeated rows, other
    lengths, nulls and odd components."""
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(6, 8))
    rows = [(i, [float(np.float32(c)) for c in centres[i % 6] + rng.normal(scale=0.1, size=8)], i % 4) for i in range(400)]
    rows += [(400 + i, [0.25] * 8, i % 3) for i in range(200)]
    rows += [(600 + i, [-1.0 * (i % 5), 0.5], i % 2) for i in range(130)]
    rows += [rows[0], rows[7], rows[100], (800, [], 1), (801, [], 2), (900, [], 1), (-100, [float(x) for x in range(8)], 0)]
    odd = [(None, [1.0] * 8, 1), (1000, None, 1), (1100, [None] * 8, 1), (1200, [math.nan] * 8, 1), (1300, [math.inf] * 8, 1), (1400, [2.0] * 8, None)]
    all_rows = rows + odd
    df = spark.createDataFrame([(*r, "x", 1, 1, 1, 1, "y") for r in all_rows], VECTORS)
    return all_rows, df


def brute_top(rows, queries, k):
    out = []
    for q in {(i, tuple(v)) for i, v in queries}:
        scores = sorted((-sum(a * b for a, b in zip(q[1], v)), i) for i, v in rows if i != q[0] and len(v) == len(q[1]))
        out += [(q[0], rank, i, -s) for rank, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("shard_rows, pivots", [(4096, 1024), (40, 1024), (40, 3)])
def test_top_k_equals_brute_force(vectors, shard_rows, pivots):
    rows, df = vectors
    whole = integer_vectors(df, 1024)
    found = ball_search.top_k(whole, whole.where("vec_id % 50 = 0"), max_pivots=pivots, shard_rows=shard_rows)
    valid = [(r[0], scaled(r[1], 1024)) for r in rows if takes_part(r)]
    want = brute_top(valid, [r for r in valid if r[0] % 50 == 0], 10)
    assert sorted(map(tuple, found.collect())) == want
    assert [f.dataType.simpleString() for f in found.schema] == ["bigint", "int", "bigint", "bigint"]


def test_a_ball_tree_opens_few_leaves_in_clusters():
    rng = np.random.default_rng(1)
    x = np.floor(100 * (np.repeat(rng.normal(size=(40, 8)), 50, axis=0) * 10 + rng.normal(size=(2000, 8))))
    tree = ball_search.BallTree(x, leaf=25)
    assert sorted(tree.order) == list(range(2000)) and max(b - a for n, (a, b) in enumerate(tree.spans) if not tree.children[n]) <= 25

    class Counting(np.ndarray):
        seen = 0

        def __getitem__(self, rows):
            Counting.seen += len(rows)
            return np.asarray(self)[rows]

    bounds = tree.bounds(x[:1])
    ids, scores = ball_search.search_tree(tree, bounds[0], x.view(Counting), np.arange(2000), x[0], 0, ball_search.NO_FLOOR, 10)
    best = sorted(((-int(s), i) for i, s in enumerate(x @ x[0]) if i), key=lambda p: p)[:10]
    assert [(-int(s), int(i)) for i, s in zip(ids, scores)] == best
    assert Counting.seen < 500


def test_scores_beyond_doubles_are_integers_and_beyond_64_bits_an_error():
    big = np.array([[1 << 29, (1 << 29) + 1]], np.int64)
    a, b = for_scores(big, big)
    assert int((a @ b.T)[0, 0]) == (1 << 58) + ((1 << 29) + 1) ** 2
    with pytest.raises(ValueError, match="64 bits"):
        for_scores(big << 3, big)


def brute_negatives(rows, anchors, positives=5, negatives=10):
    out = []
    for a, av, al in {(i, tuple(v), lab) for i, v, lab in anchors}:
        scores = sorted((-sum(x * y for x, y in zip(av, v)), i, lab) for i, v, lab in rows if i != a and len(v) == len(av))
        for s, p, _ in [r for r in scores if r[2] == al][:positives]:
            inside = [r for r in scores if r[2] != al and 30 * -s <= 100 * -r[0] <= 90 * -s]
            out += [(a, p, rank, i, -s, -t) for rank, (t, i, _) in enumerate(inside[:negatives], 1)]
    return sorted(out)


@pytest.mark.parametrize("shard_rows", [4096, 60])
def test_hard_negatives_equal_brute_force(vectors, shard_rows):
    rows, df = vectors
    whole = integer_vectors(df.where("label IS NOT NULL"), 256, "label")
    found = hard_negatives.hard_negatives(whole, whole.where("vec_id % 20 = 0"), shard_rows=shard_rows)
    valid = [(r[0], scaled(r[1], 256), r[2]) for r in rows if takes_part(r) and r[2] is not None]
    want = brute_negatives(valid, [r for r in valid if r[0] % 20 == 0])
    assert sorted(map(tuple, found.collect())) == want and want
    # zero scores: a window that opens and ends at zero
    assert any(r[4] == 0 for r in want)


def test_empty_tables_of_vectors(spark):
    empty = integer_vectors(spark.createDataFrame([], VECTORS), 256, "label")
    assert ball_search.top_k(empty, empty).count() == 0
    assert hard_negatives.hard_negatives(empty, empty).count() == 0


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute_ranking(docs, items, k=10):
    docs = [(i, Counter(terms(t))) for i, t in docs]
    docs = [(i, c, sum(c.values())) for i, c in docs if c]
    n_docs, total = len(docs), sum(n for _, _, n in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    out = []
    for item, text in sorted(set(items), key=str):
        scores = []
        for i, c, n in docs:
            m = 10 + 90 * n * n_docs // total
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if c[t]
            )
            if score > 0:
                scores.append((-score, i is None, i or 0))
        out += [(item, rank, None if none else i, -s) for rank, (s, none, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def test_terms_are_what_the_pattern_matches():
    texts = ["", "Zoë's ÉCOLE-42 x_y z\x7fq", "\x00a\tb\n", "中文 АБВ", "éé" * 3, " " * 5]
    flat, rows = lexical_search.terms_of(pa.array(texts))
    assert list(zip(rows.tolist(), flat.to_pylist())) == [(i, w) for i, t in enumerate(texts) for w in terms(t)]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(3)
    words = [f"w{int(x)}" for x in range(120)]
    share = 1 / np.arange(1, 121)
    texts = [" ".join(rng.choice(words, size=int(rng.integers(1, 60)), p=share / share.sum())) for _ in range(300)]
    docs = [(i, t) for i, t in enumerate(texts)] + [(300 + i, texts[5].upper() + "!") for i in range(150)]
    docs += [(7, texts[7]), (7, texts[7]), (None, texts[9]), (None, "w3 w90"), (600, None), (601, ""), (602, " .,;"), (603, "w1 " * 30_000)]
    items = [(i, texts[i * 3]) for i in range(40)] + [(40, None), (41, ""), (42, "unknown words"), (43, "w1 w1 W1"), (43, "w1 w1 W1"), (None, "w2 w110"), (44, " ".join(words))]
    return docs, items


@pytest.mark.parametrize("max_terms, cells", [(4096, 1 << 20), (50, 1 << 10)])
def test_ranking_equals_brute_force(spark, corpus, max_terms, cells, monkeypatch):
    docs, items = corpus
    monkeypatch.setattr(lexical_search, "BUCKET_CELLS", cells)
    d = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id long, text string, n long, terms string")
    i = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, score long")
    found = lexical_search.rank_documents(d, i, max_terms=max_terms)
    assert sorted(map(tuple, found.collect()), key=str) == brute_ranking(docs, items)


def test_ranking_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, item_id long")
    some = spark.createDataFrame([(1, "a b", 1)], "doc_id long, text string, item_id long")
    assert lexical_search.rank_documents(none, none).count() == 0
    assert lexical_search.rank_documents(some, none).count() == 0
    assert lexical_search.rank_documents(none, some).count() == 0
    assert lexical_search.rank_documents(some, some).collect()[0][:3] == (1, 1, 1)


def test_the_bounds_drop_vectors_but_no_result(spark):
    """Survivors of a bucket: all that reach the floor, and not all rows."""
    rng = np.random.default_rng(5)
    impacts = (rng.random((500, 60)) < 0.15) * rng.integers(1, 900_000, (500, 60))
    impacts[3, :12] = 900_000
    item = lexical_search.Asked(np.arange(12), rng.integers(1, 8000, 12))
    scores = impacts[:, item.terms] @ item.weights
    floor = int(np.sort(scores)[-10])
    norms = np.sqrt((impacts.astype(float) ** 2).sum(axis=1))
    kept = lexical_search.survivors(item, impacts, norms, floor)
    assert set(np.flatnonzero(scores >= floor)) <= set(kept) and len(kept) < 250


@pytest.mark.parametrize("name", ["op11_exact_top_k", "op12_hard_negatives", "op13_ranked_lexical"])
def test_queries_equal_their_sql(spark, duck, name):
    from landsight.llm.registry import ORACLE, QUERIES

    found = QUERIES[name](spark, SF)
    want = duck.execute(ORACLE[name])
    names = [c[0] for c in want.description]
    assert sorted(found.columns) == sorted(names)
    assert sorted(map(tuple, found.select(*names).collect())) == sorted(want.fetchall())
