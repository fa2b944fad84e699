"""Small inputs that every operator must take: nulls, empty and very long texts,
ties, repeated rows, an empty table, and extra columns with clashing names."""

import pytest

SF = "/root/testdata/sf0.001"

WORDS = "river stone field cloud amber north paper quiet ember slate willow harbor lantern meadow copper thistle".split()


def prose(seed: int, n: int) -> str:
    x, out = seed * 7919 + 17, []
    for _ in range(n):
        x = (x * 1103515245 + 12345) % 2**31
        out.append(WORDS[x >> 8 & 15] + ("s" if x >> 13 & 1 else "") + ("ed" if x >> 15 & 1 else ""))
    return " ".join(out)


@pytest.fixture(scope="session")
def shared(spark, tmp_path_factory):
    """Managed tables of the tests go to a temporary warehouse."""
    return spark


@pytest.fixture(scope="session")
def odd_docs(spark):
    long = " ".join(prose(k, 500) for k in range(40))
    rows = [
        (1, None, "en", None, 0),
        (2, "", None, "h1", 0),
        (3, " \n\t ", "en", "h1", 3),
        (4, prose(1, 120), "en", "h2", 9),
        (5, prose(1, 120), "en", "h2", 9),
        (5, prose(1, 120), "en", "h2", 9),
        (6, long, "en", "h2", 9),
        (7, "one two", "de", "h3", 7),
        (8, prose(2, 60) + " " + prose(1, 120)[:400], None, "h3", 7),
        (9, "é́ ﬁ ΣΑΣ 中文  x", "fr", "h3", 7),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    # names that the operators use inside
    clash = {c: "x" for c in ("key", "digest", "score", "lang_pred", "kept", "host", "ids", "spans", "shard", "matches", "edits", "label", "begin", "end")}
    for name, value in clash.items():
        df = df.withColumn(name, __import__("pyspark.sql.functions", fromlist=["lit"]).lit(value))
    return df
