"""The daily report of a growing log: replays, second queries, late files."""

import shutil

from pyspark.sql import functions as F

from landsight.operators.history import risk_kpis
from landsight.sources import log as L
from landsight.streaming import history as H


def entries(spark, start, n):
    rows = spark.range(start, start + n)
    day = F.expr("timestamp'2024-03-01 12:00:00' + make_interval(0, 0, 0, id % 5)")
    return rows.select(
        "id", day.alias("timestamp"), F.lit(1.0).alias("latitude"), F.lit(2.0).alias("longitude"), F.lit(3).alias("zoom"),
        F.when(F.col("id") % 3 == 0, "Y").when(F.col("id") % 3 == 1, "N").alias("danger"),
    )


def run(spark, root, checkpoint):
    H.start_daily_risk_kpis(spark, f"{root}/log", f"{root}/daily", f"{root}/{checkpoint}", available_now=True, max_files_per_trigger=2).awaitTermination()


def report(spark, root):
    return sorted(map(tuple, H.read_daily_risk_kpis(spark, f"{root}/daily").collect()), key=str)


def batch_report(spark, root):
    return sorted(map(tuple, H.daily_risk_kpis(L.read_log(spark, f"{root}/log")).collect()), key=str)


def test_replays_second_queries_and_late_files_count_once(spark, tmp_path):
    root = str(tmp_path)
    for start in (0, 100, 200):
        L.append_log(entries(spark, start, 100), f"{root}/log")
    run(spark, root, "one")
    want = batch_report(spark, root)
    assert report(spark, root) == want and sum(r[1] for r in want) == 300

    run(spark, root, "two")  # another query over the same log
    assert report(spark, root) == want
    shutil.copytree(f"{root}/one", f"{root}/saved")
    L.append_log(entries(spark, 300, 50), f"{root}/log")  # late rows of days that were reported
    run(spark, root, "one")
    run(spark, root, "saved")  # the same batches again, from a restored checkpoint
    want = batch_report(spark, root)
    assert report(spark, root) == want and sum(r[1] for r in want) == 350

    dropped = H.compact_daily_counts(spark, f"{root}/daily")
    assert dropped > 3 and len(H._folders(spark, f"{root}/daily")) == 1
    assert report(spark, root) == want
    run(spark, root, "three")  # after the compaction too
    L.append_log(entries(spark, 400, 10), f"{root}/log")
    run(spark, root, "one")
    assert report(spark, root) == batch_report(spark, root)
    total = risk_kpis(L.read_log(spark, f"{root}/log")).first()
    assert sum(r[1] for r in report(spark, root)) == total.total_analyses == 360


def test_a_stopped_compaction_loses_and_doubles_nothing(spark, tmp_path):
    root = str(tmp_path)
    for start in (0, 100):
        L.append_log(entries(spark, start, 100), f"{root}/log")
    run(spark, root, "one")
    want = batch_report(spark, root)

    real = H._folders(spark, f"{root}/daily")
    # the new folder is written, the old ones are still there
    parts = spark.read.schema(H.COUNT_SCHEMA).option("recursiveFileLookup", True).parquet(f"{root}/daily")
    parts.write.parquet(f"{root}/daily/compacted-x")
    assert report(spark, root) == want
    assert H.compact_daily_counts(spark, f"{root}/daily") == len(real) + 1
    assert report(spark, root) == want
    assert H.compact_daily_counts(spark, f"{root}/daily") == 0
