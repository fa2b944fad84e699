"""Places in a total order, and pages."""

from pyspark.sql import functions as F

from landsight.operators import history as H
from landsight.operators.ranking import Ranked, total_rank


def test_places_of_the_whole_log_with_ties_and_missing_times(spark):
    rows = [(i, None if i % 11 == 0 else 1_700_000_000 + (i * 37) % 50) for i in range(400)]
    log = spark.createDataFrame(rows, "id long, s long").select("id", F.timestamp_seconds("s").alias("timestamp"))
    for choice, sign in (("Newest first", -1), ("Oldest first", 1)):
        ranked = H.ranked_log(log, choice)
        want = [r[0] for r in sorted(rows, key=lambda r: (r[1] is None, sign * (r[1] or 0), r[0]))]
        got = {r.id: r.place for r in ranked.with_place().collect()}
        assert got == {i: place for place, i in enumerate(want, 1)}
        pages = [[(r.id, r.place) for r in ranked.page(n, 30).collect()] for n in range(1, 16)]
        flat = [x for p in pages for x in p]
        assert flat == [(i, place) for place, i in enumerate(want, 1)] and len(pages[13]) == 10 and pages[14] == []


def test_a_page_reads_only_its_ranges(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"))
    ranked = Ranked(df, [F.col("v").asc()], num_partitions=8)
    assert ranked.rows.select("__range").distinct().count() == 8
    page = ranked.page(3, 100)
    assert [r.v for r in page.collect()] == list(range(200, 300))
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "__position" in plan.split("PushedFilters", 1)[1]
    assert "Window" not in ranked.rows._jdf.queryExecution().executedPlan().toString()


def test_no_rows_and_whole_ties(spark):
    none = spark.createDataFrame([], "id long")
    assert total_rank(none, [F.col("id").asc()]).collect() == [] and Ranked(none, [F.col("id").asc()]).page(1, 5).collect() == []
    same = spark.range(50).select(F.lit(1).alias("v"))
    assert sorted(r.place for r in total_rank(same, [F.col("v").asc()]).collect()) == list(range(1, 51))
