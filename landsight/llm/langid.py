"""Language identification: multinomial naive Bayes over hashed character n-grams.

Letters are lower-cased, every run of other characters becomes one separator,
and n-grams of one to three characters are hashed into a fixed number of
buckets.  The log-probability matrix (languages x buckets) is small and of
fixed size per language, so it is broadcast; batches of texts are scored as
sparse rows in numpy.

Defined results: a null text or a text without letters gets ``und`` and score
0; rows repeat as they come; where two languages score the same, the
alphabetically first wins; without any labelled training row every text is
``und``; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import mix64, process_cache, schema_with, text_slices

ORDERS = (1, 2, 3)
BUCKETS = 1 << 15
# The model is fitted on a sample of about this many labelled documents of each
# language, taken by a hash of the id; all documents are scored.
TRAIN_DOCS = 2000
UNKNOWN = "und"
HELD_OUT = 1  # remainder of crc32(id) mod 3 that is never learned from
# Characters handled at once while scoring: bounds the worker's memory.
SCORE_BYTES = 1 << 20


def _letter_table() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def ngram_buckets(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of every n-gram of the texts, the text it is from (both ordered
    by n, then place), and whether each text has a letter."""
    is_letter = process_cache("letters", _letter_table)
    parts = [np.frombuffer(t.lower().encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    sizes = np.array([len(p) for p in parts], np.int64)
    chars = np.concatenate([np.zeros(0, np.uint32), *parts])
    rows = np.repeat(np.arange(len(texts)), sizes)
    letter = is_letter[chars]
    has = np.bincount(rows[letter], minlength=len(texts)) > 0
    chars = np.where(letter, chars, 0).astype(np.uint64)
    # one separator per run of other characters
    keep = letter.copy()
    keep[1:] |= letter[:-1] & (rows[1:] == rows[:-1])
    chars, rows = chars[keep], rows[keep]
    found, owners = [], []
    code = chars + np.uint64(1)
    for n in ORDERS:
        if n > 1:
            if len(chars) < n:
                break
            code = code[:-1] * np.uint64(0x110001) + chars[n - 1 :] + np.uint64(1)
            same = rows[: len(code)] == rows[n - 1 :]
        else:
            same = chars > 0
        found.append((mix64(code[same] + np.uint64(n << 56)) & np.uint64(BUCKETS - 1)).astype(np.int32))
        owners.append(rows[: len(code)][same])
    if not found:
        return np.zeros(0, np.int32), np.zeros(0, np.int64), has
    return np.concatenate(found), np.concatenate(owners), has


def _sum_batches(batches):
    """Per task: the bucket counts and documents of each language."""
    sums: dict[str, np.ndarray] = {}
    docs: dict[str, int] = {}
    for batch in text_slices(batches, limit=SCORE_BYTES):
        langs = np.array(batch.column("lang").to_pylist(), object)
        buckets, rows, _ = ngram_buckets(batch.column("text").to_pylist())
        for lang in set(langs):
            mine = langs == lang
            sums[lang] = sums.get(lang, 0) + np.bincount(buckets[mine[rows]], minlength=BUCKETS)
            docs[lang] = docs.get(lang, 0) + int(mine.sum())
    yield pa.RecordBatch.from_pydict(
        {"lang": pa.array(list(sums), pa.string()), "n": pa.array([docs[k] for k in sums], pa.int64()), "counts": pa.array([sums[k].astype(np.int64).tobytes() for k in sums], pa.binary())}
    )


def _total(parts: pd.DataFrame) -> pd.DataFrame:
    counts = sum(np.frombuffer(c, np.int64) for c in parts["counts"])
    return pd.DataFrame({"lang": parts["lang"].iloc[:1], "n": [parts["n"].sum()], "counts": [counts.tobytes()]})


class LanguageModel:
    def __init__(self, langs: list[str], log_probs: np.ndarray, priors: np.ndarray):
        self.langs, self.log_probs, self.priors = langs, log_probs, priors

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """The language of each text and its posterior probability."""
        return self.judge(texts)[:2]

    def judge(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """``predict``'s two, the lead of the language over chance -- the mean
        over the n-grams of how much likelier (log) it makes one than buckets
        drawn evenly -- and whether the text has a letter."""
        buckets, rows, has = ngram_buckets(texts)
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts)), has
        scores = np.stack([p + np.bincount(rows, weights=lp[buckets], minlength=len(texts)) for p, lp in zip(self.priors, self.log_probs)])
        best = scores.argmax(0)
        post = 1 / np.exp(scores - scores.max(0)).sum(0)
        grams = np.maximum(np.bincount(rows, minlength=len(texts)), 1)
        lead = (scores.max(0) - self.priors[best]) / grams + np.log(BUCKETS)
        return [self.langs[b] if h else UNKNOWN for b, h in zip(best, has)], np.where(has, post, 0.0), np.where(has, lead, 0.0), has


def crc_remainder(id_col: str, mod: int):
    return F.crc32(F.col(id_col).cast("string")) % mod


def fit(docs: DataFrame, may_learn, train_docs: int = TRAIN_DOCS) -> LanguageModel:
    """Fit on about ``train_docs`` documents of each language, labelled ones for
    which ``may_learn`` holds.  A language with fewer is learned from all of them,
    however large the table is; the priors count all labelled documents."""
    labelled = docs.where(may_learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", F.col("lang").cast("string").alias("lang"), "text")
    total = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}  # one row per language
    share = 1 << 20
    thresholds = [(k, max(1, share * train_docs // n)) for k, n in sorted(total.items()) if n > train_docs]
    part = F.pmod(F.xxhash64("doc_id"), F.lit(share))
    if thresholds:
        limit = F.create_map(*[F.lit(x) for pair in thresholds for x in pair])
        sample = labelled.where(part < F.coalesce(F.try_element_at(limit, F.col("lang")), F.lit(share))).select("lang", "text")
    else:
        sample = labelled.select("lang", "text")
    # the scan keeps its own parallelism; the sample is bounded, and one row per
    # language comes back
    parts = sample.repartition(16).mapInArrow(_sum_batches, "lang string, n long, counts binary")
    rows = sorted(parts.groupBy("lang").applyInPandas(_total, "lang string, n long, counts binary").collect(), key=lambda r: r["lang"])
    counts = np.array([np.frombuffer(r["counts"], np.int64) for r in rows], float).reshape(len(rows), BUCKETS) + 0.1
    docs_of = np.array([total[r["lang"]] for r in rows], float)
    return LanguageModel(
        [r["lang"] for r in rows], np.log(counts / counts.sum(1, keepdims=True)).astype(np.float32), np.log(docs_of / max(docs_of.sum(), 1))
    )


def predict(docs: DataFrame, model: LanguageModel, lang_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """``docs`` with the predicted language and its probability in two columns,
    in place of equally named ones."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model.langs, model.log_probs, model.priors))
    kept = docs.drop(lang_col, score_col)
    base = kept.withColumn("_text", F.coalesce(F.col("text"), F.lit("")))
    schema = schema_with(kept, **{lang_col: "string", score_col: "double"})

    def run(batches):
        model = LanguageModel(*shared.value)
        for batch in text_slices(batches, "_text", SCORE_BYTES):
            langs, scores = model.predict(batch.column("_text").to_pylist())
            at = batch.schema.get_field_index("_text")
            cols = [c for i, c in enumerate(batch.columns) if i != at]
            names = [c for i, c in enumerate(batch.schema.names) if i != at]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*names, lang_col, score_col])

    return base.mapInArrow(run, schema)


def with_known_language(docs: DataFrame, model: LanguageModel, certainty: float) -> DataFrame:
    """The rows of ``docs`` whose text has a letter and whose language is no
    guess: its probability reaches ``certainty``, and it makes the text's
    n-grams likelier than chance does, however long the text is.  A model
    without languages only rejects texts without letters."""
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.log_probs, model.priors))

    def run(batches):
        model = LanguageModel(*shared.value)
        for batch in text_slices(batches, limit=SCORE_BYTES):
            _, post, lead, has = model.judge([t or "" for t in batch.column("text").to_pylist()])
            keep = has & (post >= certainty) & (lead > 0) if model.langs else has
            yield pa.RecordBatch.from_arrays(batch.columns, names=batch.schema.names).filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op9_language_id(spark, sf_dir):
    from .util import table

    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc_remainder("doc_id", 3) == HELD_OUT, F.lit(False))
    model = fit(docs, ~held_out)
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
