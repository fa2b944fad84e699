"""The first result of every location, stored by key.

The log grows with every analysis; a lookup wants one row of a few keys.  This
table holds the first stored entry of each ``(latitude, longitude, zoom)`` in
``buckets`` folders by the hash of the key, each sorted by that hash.  A batch of
log rows is merged bucket by bucket: only the buckets it touches are read and
written again.  A lookup reads only the buckets of the keys asked for.

Layout::

    <path>/manifests/<n>.json        which folder holds each bucket, newest n counts
    <path>/data/<write>/bucket=<b>/  the rows of a bucket

A write is new folders and then a new manifest, created only if no other writer
has created that number; until then readers see the table before.  A merge that
is repeated changes nothing: the first entry of a key stays the first.
Folders that no manifest among the newest names are dropped by ``vacuum``.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.cache import KEY

PAYLOAD = ["image_description", "danger", "text_description"]
DEFAULT_BUCKETS = 64

SCHEMA = T.StructType(
    [
        T.StructField("latitude", T.DoubleType()),
        T.StructField("longitude", T.DoubleType()),
        T.StructField("zoom", T.IntegerType()),
        T.StructField("key_hash", T.LongType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("id", T.LongType()),
        *(T.StructField(c, T.StringType()) for c in PAYLOAD),
    ]
)


def _system(spark: SparkSession, path: str):
    """Spark's file system of a path, and a maker of its paths."""
    make = spark._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark._jsc.hadoopConfiguration()), make


def _manifests(spark: SparkSession, path: str) -> list[int]:
    system, make = _system(spark, path)
    folder = make(f"{path}/manifests")
    if not system.exists(folder):
        return []
    names = [s.getPath().getName() for s in system.listStatus(folder)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith((".", "_")))


def _manifest(spark: SparkSession, path: str, number: int) -> dict:
    rows = spark.read.option("wholetext", True).text(f"{path}/manifests/{number}.json").collect()  # one small file
    return json.loads(rows[0][0])


def _commit(spark: SparkSession, path: str, number: int, manifest: dict) -> None:
    system, make = _system(spark, path)
    whole = make(f"{path}/manifests/_{uuid.uuid4().hex}")
    out = system.create(whole, False)
    out.write(bytearray(json.dumps(manifest).encode()))
    out.close()
    final = make(f"{path}/manifests/{number}.json")
    # a rename does not replace a file that is there
    if system.exists(final) or not system.rename(whole, final):
        system.delete(whole, False)
        raise RuntimeError(f"another writer has changed {path}; merge the batch again")


def _newest(spark: SparkSession, path: str) -> tuple[int, dict | None]:
    numbers = _manifests(spark, path)
    return (numbers[-1], _manifest(spark, path, numbers[-1])) if numbers else (0, None)


def whole_keys(rows: DataFrame) -> DataFrame:
    """Rows whose key can be looked up: no part missing, none a NaN."""
    return rows.where("latitude IS NOT NULL AND longitude IS NOT NULL AND zoom IS NOT NULL AND NOT isnan(latitude) AND NOT isnan(longitude)")


def _hashed(rows: DataFrame, buckets: int) -> DataFrame:
    typed = rows.withColumns({f.name: F.col(f.name).cast(f.dataType) for f in SCHEMA.fields[:3]})
    hashed = typed.withColumn("key_hash", F.xxhash64(*KEY))
    return hashed.withColumn("bucket", F.pmod("key_hash", F.lit(buckets)).cast("int"))


def _read(spark: SparkSession, path: str, manifest: dict | None, buckets: Sequence[int]) -> DataFrame:
    folders = (manifest or {}).get("folders", {})
    paths = [f"{path}/data/{folders[str(b)]}/bucket={b}" for b in sorted(buckets) if str(b) in folders]
    if not paths:
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).parquet(*paths)


def _wanted_buckets(rows: DataFrame) -> list[int]:
    """At most as many numbers as the table has buckets."""
    return [r[0] for r in rows.select("bucket").distinct().collect()]


def merge_first_results(rows: DataFrame, path: str, buckets: int = DEFAULT_BUCKETS) -> list[int]:
    """Merge log rows (with ``id``) into the table at ``path``; returns the
    buckets written.  ``buckets`` counts when the table is made.  The first
    entry of a key is the earliest (no timestamp last), then the least id."""
    from .store import materialize

    spark = rows.sparkSession
    number, manifest = _newest(spark, path)
    buckets = manifest["buckets"] if manifest else buckets
    entry = F.struct(F.col("timestamp").isNull().alias("late"), "timestamp", F.col("id").cast("long").alias("id"), *PAYLOAD)

    def firsts(df: DataFrame) -> DataFrame:
        return df.groupBy("bucket", "key_hash", *KEY).agg(F.min("entry").alias("entry"))

    # a hot key is one row a task before anything is joined or written
    batch = firsts(_hashed(whole_keys(rows), buckets).select("bucket", "key_hash", *KEY, entry.alias("entry")))
    batch = materialize(batch, "first-results-batch")
    touched = _wanted_buckets(batch)
    if not touched:
        return []
    held = _read(spark, path, manifest, touched).withColumn("bucket", F.pmod("key_hash", F.lit(buckets)).cast("int"))
    both = batch.unionByName(held.select("bucket", "key_hash", *KEY, entry.alias("entry")))
    # dealt by bucket once: the merge of a bucket and its file are one task's
    merged = firsts(both.repartition("bucket")).select(
        "bucket", *KEY, "key_hash", "entry.timestamp", "entry.id", *[F.col("entry")[c].alias(c) for c in PAYLOAD]
    )
    token = uuid.uuid4().hex
    merged.sortWithinPartitions("bucket", "key_hash").write.partitionBy("bucket").parquet(f"{path}/data/{token}")
    folders = dict((manifest or {}).get("folders", {})) | {str(b): token for b in touched}
    _commit(spark, path, number + 1, {"buckets": buckets, "folders": folders})
    return sorted(touched)


def read_first_results(spark: SparkSession, path: str, keys: DataFrame | None = None) -> DataFrame:
    """First results by key; with ``keys`` (the key columns) only the buckets
    that hold them are read.  A missing table reads as no rows."""
    _, manifest = _newest(spark, path)
    if manifest is None:
        return spark.createDataFrame([], SCHEMA)
    if keys is None:
        wanted = range(manifest["buckets"])
    else:
        wanted = _wanted_buckets(_hashed(whole_keys(keys.select(*KEY)), manifest["buckets"]))
    return _read(spark, path, manifest, wanted)


def lookup_first_results(requests: DataFrame, path: str) -> DataFrame:
    """J2 on the key table: every request with ``hit`` and the first stored
    entry's payload (NULL on a miss); no log row is read."""
    first = read_first_results(requests.sparkSession, path, requests).select(*KEY, *PAYLOAD, F.lit(True).alias("hit"))
    out = requests.join(first, KEY, "left")
    return out.withColumn("hit", F.coalesce("hit", F.lit(False)))


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Drop manifests older than the newest ``keep`` and the folders that only
    they name; returns how many folders went.  Run it when no merge is under way."""
    numbers = _manifests(spark, path)
    named = {t for n in numbers[-keep:] for t in _manifest(spark, path, n)["folders"].values()}
    system, make = _system(spark, path)
    for n in numbers[:-keep]:
        system.delete(make(f"{path}/manifests/{n}.json"), False)
    data = make(f"{path}/data")
    found = [s.getPath() for s in system.listStatus(data)] if system.exists(data) else []
    gone = [p for p in found if p.getName() not in named]
    for p in gone:
        system.delete(p, True)
    return len(gone)
