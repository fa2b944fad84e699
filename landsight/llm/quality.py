"""Quality rules with host verdicts.

Every document is judged by text rules; failures are then counted per host,
each host's failure rate is shrunk towards the corpus by an empirical Beta
prior, and the host's verdict is joined back to its documents.

Defined results: a null or empty text has zero counts and fails the rules; rows
with the same id are judged each on their own; documents without a host form
one host of their own; an empty table gives an empty result; other columns of
the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import per_row, string_bytes, text_slices, words_of, written

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
# A host is rejected when more than this share of its documents is expected to
# fail, after shrinking.
MAX_HOST_RATE = 0.5
SYMBOLS = "#*$%&|<>"  # fixed: the symbols that the rule counts

RULE_SCHEMA = (
    "doc_id long, host string, n_words long, word_chars long, n_symbols long, "
    "n_dup_lines long, n_repeat_words long"
)


def _again(key: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Marks entries whose key occurs twice or more in their row (rows ascend)."""
    order = np.argsort(key, kind="stable")
    k, r = key[order], rows[order]
    same = (k[1:] == k[:-1]) & (r[1:] == r[:-1])
    out = np.zeros(len(key), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def _pair_codes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.unique(a.astype(np.int64) << 32 | b, return_inverse=True)[1]


def text_counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """The rule counts of each text of an array without nulls."""
    n = len(texts)
    words, rows = words_of(texts)
    data, offsets = string_bytes(texts)
    is_symbol = np.zeros(256, np.int64)
    is_symbol[[ord(c) for c in SYMBOLS]] = 1
    symbols = np.concatenate([[0], np.cumsum(is_symbol[data])])
    out = {
        "n_words": np.bincount(rows, minlength=n),
        "word_chars": per_row(pc.utf8_length(words).to_numpy(zero_copy_only=False), rows, n),
        "n_symbols": symbols[offsets[1:]] - symbols[offsets[:-1]],
    }

    lists = pc.split_pattern(texts.cast(pa.large_string()), "\n")
    line_rows = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    lines = lists.flatten()
    full = pc.match_substring_regex(lines, r"[^\x20\x09-\x0D]")
    line_rows = line_rows[full.to_numpy(zero_copy_only=False)]
    codes = lines.filter(full).dictionary_encode().indices.to_numpy(zero_copy_only=False)
    first = np.unique(line_rows << 32 | codes)
    out["n_dup_lines"] = np.bincount(line_rows, minlength=n) - np.bincount(first >> 32, minlength=n)

    repeated = np.zeros(len(rows), bool)
    if len(rows) > 2:
        codes = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        inside = rows[2:] == rows[:-2]
        at = np.flatnonzero(inside)
        pair = _pair_codes(codes[at], codes[at + 1]) if codes.max(initial=0) >= 1 << 21 else codes[at] << 21 | codes[at + 1]
        key = _pair_codes(pair, codes[at + 2]) if codes.max(initial=0) >= 1 << 21 else pair << 21 | codes[at + 2]
        starts = at[_again(key, rows[at])]
        for k in range(3):
            repeated[starts + k] = True
    out["n_repeat_words"] = per_row(repeated, rows, n)
    return out


def _count_batches(batches):
    for batch in text_slices(batches):
        found = text_counts(batch.column("text"))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("host"), *(pa.array(found[k].astype(np.int64)) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))],
            names=["doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"],
        )


def rule_counts(docs: DataFrame, host_col: str = "source") -> DataFrame:
    """Counts of the text rules and ``base_failed`` for every document."""
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    counts = texts.mapInArrow(_count_batches, RULE_SCHEMA)
    return counts.withColumn(
        "base_failed",
        (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")),
    )


def host_rates(judged: DataFrame) -> DataFrame:
    """One row per host: documents, failures, and the failure rate shrunk by a
    Beta prior fitted to all hosts (see ``beta_prior``)."""
    hosts = written(
        judged.groupBy("host").agg(
            F.count(F.lit(1)).alias("host_docs"),
            F.sum(F.col("base_failed").cast("long")).alias("host_failed"),
        ),
        "quality-hosts",
    )
    n, f = F.col("host_docs").cast("double"), F.col("host_failed").cast("double")
    sums = hosts.agg(F.count(F.lit(1)).alias("k"), F.sum(n).alias("n"), F.sum(f).alias("f"), F.sum(n * n).alias("nn"), F.sum(f * f / n).alias("ffn")).first()  # one row
    alpha, beta = beta_prior(*sums)
    return hosts.withColumn(
        "host_rate", (F.col("host_failed") + F.lit(alpha)) / (F.col("host_docs") + F.lit(alpha + beta))
    )


def beta_prior(hosts: int, docs: float | None, failed: float | None, docs2: float | None, rates2: float | None) -> tuple[float, float]:
    """Alpha and beta of the beta-binomial distribution with the hosts' moments,
    hosts weighted by their documents: ``docs2`` sums the squared documents of the hosts,
    ``rates2`` the squared failures over documents.

    The spread of the rates that single documents make by chance (the binomial
    part) is taken off, so a table of many small hosts has the prior of their
    true rates.  The strength lies between one document (rates of 0 and 1 only, or no spread
    to measure: one host, equal outcomes) and all documents (no more spread than chance makes).
    """
    if not hosts:
        return 0.5, 0.5
    mean = failed / docs
    free = docs - docs2 / docs - (hosts - 1)  # 0 where each host has one document
    strength = 1.0
    if 0 < failed < docs and free > 0:
        spread = (rates2 - failed * mean) / (mean * (1 - mean)) - (hosts - 1)
        strength = min(max(free / spread - 1, 1.0), docs) if spread > 0 else docs
    return mean * strength, (1 - mean) * strength


def judge_hosts(docs: DataFrame, host_col: str = "source", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """Rule counts of every document with its host's shrunk failure rate and
    the verdict ``kept``: the rules hold and the host is not rejected."""
    judged = written(rule_counts(docs, host_col), "quality-rules")
    # the host table is written, so Spark knows its size when it picks the join
    hosts = written(host_rates(judged).select(F.col("host").alias("rated"), "host_rate"), "quality-rates")
    joined = judged.join(hosts, judged["host"] == hosts["rated"], "left").drop("rated")
    return joined.withColumn("kept", ~F.col("base_failed") & (F.col("host_rate") <= F.lit(max_rate)))


def op1_quality_rules(spark, sf_dir):
    from .util import table

    judged = judge_hosts(table(spark, sf_dir, "documents")).drop("host")
    return judged.withColumn("host_rate", F.round("host_rate", 9))


OP1_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, host, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
lines AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
dup AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
pos AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3),
tri AS (SELECT doc_id, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM pos),
rep AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM tri),
marked AS (SELECT doc_id, count(DISTINCT j) AS n_repeat_words
  FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM rep WHERE n > 1) GROUP BY doc_id),
base AS (
  SELECT w.doc_id, host, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN dup ON w.doc_id = dup.doc_id LEFT JOIN marked ON w.doc_id = marked.doc_id),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base),
hosts AS (SELECT host, count(*) AS n, CAST(sum(CAST(base_failed AS BIGINT)) AS DOUBLE) AS f FROM judged GROUP BY host),
mom AS (SELECT CAST(count(*) AS DOUBLE) AS h, CAST(sum(n) AS DOUBLE) AS d, sum(f) AS f, CAST(sum(n * n) AS DOUBLE) AS nn, sum(f * f / n) AS ffn FROM hosts),
part AS (SELECT f / d AS m, d, f, d - nn / d - (h - 1) AS free, CASE WHEN f > 0 AND f < d THEN (ffn - f * f / d) / (f / d * (1 - f / d)) - (h - 1) END AS spread FROM mom),
str AS (SELECT m, CASE WHEN f > 0 AND f < d AND free > 0 THEN CASE WHEN spread > 0 THEN least(greatest(free / spread - 1, 1.0), d) ELSE d END ELSE 1.0 END AS k FROM part),
rates AS (SELECT host, (f + m * k) / (n + k) AS host_rate FROM hosts, str)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND host_rate <= 0.5 AS kept, round(host_rate, 9) AS host_rate
FROM judged JOIN rates USING (host)
"""
