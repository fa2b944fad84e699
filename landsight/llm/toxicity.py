"""Toxicity: a learned, weighted lexicon matched by Aho-Corasick.

Texts are folded first -- lower case, homoglyphs to Latin letters, digits and
signs that stand for letters inside a word to those letters -- so that
disguised spellings match.  Term weights are the log-odds of a document being
toxic when it holds the term, learned from labelled documents; two-word phrases
with a term that occur only in clean documents become exceptions and cancel the
match.  The matched weight is normalised by the text's length and calibrated to
a probability.

Defined results: null and empty texts get the score of a text without any
match; rows repeat as they come; of several label rows of one document the
highest counts; without labels of both kinds the lexicon is empty and every
score is the share of toxic labels; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
import unicodedata

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .langid import crc_remainder
from .util import keyed_texts, text_slices, written

HELD_OUT = 2  # remainder of crc32(id) mod 4 that is never learned from
# About so many labelled documents, taken by a hash of the id.  The lexicon and
# its exceptions are words of these texts, so their size is bounded too.
TRAIN_DOCS = 8000
MIN_DOCS = 3  # toxic documents that must hold a term
MIN_ODDS = 8.0  # a term is that much likelier in toxic documents
THRESHOLD = 0.3

# Signs that are written for Latin letters.
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j",
    "ԁ": "d", "һ": "h", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "ο": "o", "α": "a", "ε": "e",
    "ι": "i", "κ": "k", "ν": "v", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ɡ": "g", "ı": "i", "ⅼ": "l",
}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}
DISGUISED = re.compile(r"(?<![^\W_])[^\W\d_]*+[0134578@$!][^\W_@$!]*+(?:[@$!]++[^\W_]*+)*")  # words with such a sign
WORD = re.compile(r"[^\W\d_]+")
TO_LATIN = {ord(k): v for k, v in HOMOGLYPHS.items()}
TO_LETTER = {ord(k): v for k, v in SUBSTITUTES.items()}


def _undisguise(found: re.Match) -> str:
    word = found[0].rstrip("!")
    letters = sum(map(str.isalpha, word))
    if letters < 2 or any(not c.isalpha() and c not in SUBSTITUTES for c in word):
        return found[0]
    return word.translate(TO_LETTER) + found[0][len(word) :]


def fold(text: str) -> str:
    """Lower case, compatibility forms and homoglyphs to plain letters; digits
    and signs to the letters they stand for, in words of two letters or more
    and such signs only (exclamation marks at the end stay)."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    text = text.lower()
    if not text.isascii():
        text = text.translate(TO_LATIN)
    return DISGUISED.sub(_undisguise, text)


def _term_batches(batches):
    """Distinct words of each labelled text."""
    for batch in text_slices(batches):
        out = {"toxic": [], "term": []}
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            words = WORD.findall(fold(text))
            terms = dict.fromkeys(words)
            out["term"] += terms
            out["toxic"] += [toxic] * len(terms)
        yield pa.RecordBatch.from_pydict(out, pa.schema([("toxic", pa.int32()), ("term", pa.string())]))


class Lexicon:
    """Weighted terms, exception phrases and the calibration."""

    def __init__(self, terms: dict[str, float], exceptions: list[str], fit: tuple[float, ...] = (0.0, 0.0, 0.0)):
        self.terms, self.exceptions, self.fit = terms, exceptions, fit
        self.automaton = ahocorasick.Automaton()
        for t, w in terms.items():
            self.automaton.add_word(t, (len(t), w))
        for p in exceptions:
            self.automaton.add_word(p, (len(p), None))
        if terms:
            self.automaton.make_automaton()

    def features(self, text: str) -> tuple[float, float]:
        """Matched weight, and matched weight per square root of the words."""
        if not self.terms:
            return 0.0, 0.0
        folded = fold(text)
        hits, freed = [], set()
        for end, (size, weight) in self.automaton.iter(folded):
            start = end - size + 1
            if (start and folded[start - 1].isalpha()) or (end + 1 < len(folded) and folded[end + 1].isalpha()):
                continue  # inside a longer word
            if weight is None:
                freed.update(range(start, end + 1))
            else:
                hits.append((start, weight))
        total = sum(w for s, w in hits if s not in freed)
        return total, total / math.sqrt(1 + folded.count(" "))

    def score(self, text: str) -> float:
        a, b, c = self.fit
        total, dense = self.features(text)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * min(total, 50.0) + c * min(dense, 50.0)))))


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 60) -> np.ndarray:
    """Ridge logistic regression by Newton's method."""
    beta = np.zeros(x.shape[1])
    ridge = 1e-2 * np.eye(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def fit(docs: DataFrame, labels: DataFrame, may_learn, train_docs: int = TRAIN_DOCS) -> Lexicon:
    """Learn from about ``train_docs`` labelled documents for which
    ``may_learn`` (a condition on ``doc_id``) holds."""
    known = (
        labels.where(F.col("toxic").isNotNull() & may_learn)
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    )
    total = known.count()
    share = 1 << 20
    threshold = share if total <= train_docs else max(1, share * train_docs // total)
    chosen = F.pmod(F.xxhash64("doc_id"), F.lit(share)) < threshold
    sample = written(keyed_texts(docs).where(may_learn & chosen).join(known.where(chosen), "doc_id"), "toxicity-sample")
    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per label value
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        p = (n1 + 0.5) / (n0 + n1 + 1)
        return Lexicon({}, [], (math.log(p / (1 - p)), 0.0, 0.0))

    words = sample.mapInArrow(_term_batches, "toxic int, term string")
    odds = (F.col("d1") + 0.5) / (n1 + 1) / ((F.col("d0") + 0.5) / (n0 + 1))
    terms = (
        words.groupBy("term")
        .agg(F.sum("toxic").alias("d1"), F.sum(1 - F.col("toxic")).alias("d0"))
        .where((F.col("d1") >= MIN_DOCS) & (odds >= MIN_ODDS))
        .select("term", F.log(odds).alias("w"), "d1")
        .orderBy(F.desc(F.col("d1") * F.col("w")), "term")
        .collect()  # words that MIN_DOCS texts of the bounded sample share
    )
    lexicon = {r["term"]: r["w"] for r in terms}
    exceptions = _exceptions(sample, lexicon)
    plain = Lexicon(lexicon, exceptions)
    rows = sample.mapInArrow(_feature_batches(plain), "toxic int, total double, dense double").groupBy("toxic", "total", "dense").count().collect()  # a few numbers per sampled document
    x = np.array([[1.0, min(r["total"], 50.0), min(r["dense"], 50.0)] for r in rows for _ in range(r["count"])])
    y = np.array([r["toxic"] for r in rows for _ in range(r["count"])], float)
    return Lexicon(lexicon, exceptions, tuple(_logistic(x, y)))


def _feature_batches(lexicon: Lexicon):
    terms, exceptions, weights = lexicon.terms, lexicon.exceptions, lexicon.fit

    def run(batches):
        lex = Lexicon(terms, exceptions, weights)
        for batch in text_slices(batches):
            found = [lex.features(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("toxic"), pa.array([f[0] for f in found], pa.float64()), pa.array([f[1] for f in found], pa.float64())], names=["toxic", "total", "dense"]
            )

    return run


def _exceptions(sample: DataFrame, lexicon: dict[str, float]) -> list[str]:
    """Two-word phrases around a term that are common in clean documents and
    absent from toxic ones."""
    terms = list(lexicon)

    def run(batches):
        known = set(terms)
        for batch in text_slices(batches):
            out = {"toxic": [], "phrase": []}
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                words = re.findall(r"[^\W\d_]+|[^\w\s]", fold(text))
                pairs = {f"{a} {b}" for a, b in zip(words, words[1:]) if (a in known) != (b in known) and a[0].isalpha() and b[0].isalpha()}
                out["phrase"] += sorted(pairs)
                out["toxic"] += [toxic] * len(pairs)
            yield pa.RecordBatch.from_pydict(out, pa.schema([("toxic", pa.int32()), ("phrase", pa.string())]))

    found = (
        sample.mapInArrow(run, "toxic int, phrase string")
        .groupBy("phrase")
        .agg(F.sum("toxic").alias("d1"), F.sum(1 - F.col("toxic")).alias("d0"))
        .where((F.col("d1") == 0) & (F.col("d0") >= MIN_DOCS))
        .orderBy(F.desc("d0"), "phrase")
        .collect()  # phrases that MIN_DOCS texts of the bounded sample share
    )
    return [r["phrase"] for r in found]


def score(docs: DataFrame, lexicon: Lexicon, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id``, ``score`` (0 to 1) and ``predicted`` of every document."""
    shared = docs.sparkSession.sparkContext.broadcast((lexicon.terms, lexicon.exceptions, lexicon.fit))

    def run(batches):
        lex = Lexicon(*shared.value)
        for batch in text_slices(batches):
            scores = [lex.score(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    scored = keyed_texts(docs).mapInArrow(run, "doc_id long, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op8_toxicity(spark, sf_dir):
    from .util import table

    held_out = F.coalesce(crc_remainder("doc_id", 4) == HELD_OUT, F.lit(False))
    docs = table(spark, sf_dir, "documents")
    lexicon = fit(docs, table(spark, sf_dir, "labels"), ~held_out)
    return score(docs, lexicon).select("doc_id", held_out.alias("held_out"), "score", "predicted")
