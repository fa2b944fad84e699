"""Corpus preparation: language ID, exact copies, near copies, repeated
passages, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run``
writes each stage's result as Parquet in the shared checkpoint folder and hands
the reread table to the next stage.  All but the last keep the columns of
``documents``.

A row is a document by its id and its text: rows without an id, and rows of one
id with different texts, pass through the stages each by itself; of rows that
repeat an id and its text one stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landsight.llm import exact_dedup, langid, near_dedup, packing, suffix_dedup
from landsight.llm.util import table, written


MIN_CERTAINTY = 0.5


def language_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without letters, and texts whose language is a guess, go.  Without
    any labelled text no language is known: then only texts without letters go."""
    return langid.with_known_language(docs, langid.fit(docs, F.lit(True)), MIN_CERTAINTY)


def by_row(docs: DataFrame, stage, nulls_first: bool = False) -> DataFrame:
    """``stage(docs)``, whose rows are known by ``doc_id`` alone.  If an id is
    missing or repeated, each id and text gets a number in the order of the ids
    in its place for the time of the stage."""
    if not docs.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").limit(1).count():
        return stage(docs)
    names = docs.columns
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    row = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), digest)
    order = [F.asc_nulls_first("doc_id") if nulls_first else F.asc_nulls_last("doc_id"), F.asc("_own_row")]
    rows = docs.select("doc_id", row.alias("_own_row")).distinct()
    # the places of sorted ranges ascend from range to range
    numbers = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("_own_row", F.monotonically_increasing_id().alias("_own_number"))
    numbers = written(numbers, "pipeline-rows")
    single = docs.withColumn("_own_row", row).dropDuplicates(["_own_row"])
    numbered = single.join(numbers, "_own_row").drop("_own_row").withColumn("_own_id", F.col("doc_id")).withColumn("doc_id", F.col("_own_number")).drop("_own_number")
    out = stage(written(numbered, "pipeline-numbered"))
    kind = docs.schema["doc_id"].dataType
    return out.withColumn("doc_id", F.col("_own_id").cast(kind)).select(*names)


def exact_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest id stays (one without an id only
    if none has one)."""
    return by_row(docs, exact_dedup.drop_copies, nulls_first=True)


def near_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (the smallest id)."""
    return by_row(docs, near_dedup.drop_near_copies)


def passage_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages are cut out of the texts; the first place stays."""
    cut = by_row(docs, suffix_dedup.cut_documents)
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return cut.select(*docs.columns)


def packing_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens and their places in the sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("language ID", language_stage),
    ("exact dedup", exact_stage),
    ("MinHash near-dedup", near_stage),
    ("suffix-array dedup", passage_stage),
    ("packing", packing_stage),
]

# MinHash candidates and tokenisation have no SQL form.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-").lower())
    return docs
