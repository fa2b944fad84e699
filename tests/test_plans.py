"""Plan shapes behind the scale claims, on inputs with one hot key.

Each test builds an input where one key holds a third or more of all rows,
checks the result against a plain formulation, and asserts the physical-plan
property that keeps the hot key from landing in one task: the large side is
never shuffled by the hot key for the boundary merge, aggregations are partial
before their exchange, per-group top-k is limited before the shuffle, scans are
pruned, and no row-at-a-time Python runs.
"""

import re
from datetime import datetime, timedelta

import pandas as pd

from landsight.operators import cache, insights, merge, quantiles
from landsight.registry import queries as Q

from conftest import SF_SMALL


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _skewed_indicator(spark):
    """3,000 rows; code N01 holds 1,500 of them."""
    rows = []
    for i in range(3000):
        code = "N01" if i % 2 == 0 else f"N{2 + i % 20:02d}"
        rows.append(("d", code, 2000 + i % 3, float(i % 97)))
    return spark.createDataFrame(rows, "dataset string, code string, year int, value double")


def _rows(df):
    cols = sorted(df.columns)
    return sorted(tuple(str(r[c]) for c in cols) for r in df.select(*cols).collect())


def test_merge_never_shuffles_the_indicator(spark):
    ind = _skewed_indicator(spark)
    boundary = spark.createDataFrame(
        [(f"N{i:02d}", f"nation {i}") for i in range(25)] + [("-99", "x"), ("-99", "y")], "ISO_A3 string, ADMIN string"
    )
    out = merge.merge_boundaries(boundary, ind, code_col="code")
    plain = boundary.join(ind, boundary.ISO_A3 == ind.code, "left")
    assert _rows(out) == _rows(plain.select(*out.columns))
    out.collect()
    plan = _plan(out).split("== Initial Plan ==")[0]
    # indicator rows meet the boundaries in a broadcast join; the only exchange
    # over indicator data is the distinct-keys aggregate, after its partial step
    assert re.search(r"BroadcastHashJoin \[code#\d+\], \[ISO_A3#\d+\], Inner", plan), plan
    assert "SortMergeJoin" not in plan and "hashpartitioning(code#" not in plan, plan


def test_first_entry_per_key_is_partially_aggregated(spark):
    log = spark.createDataFrame(
        [(i, datetime(2024, 1, 1) + timedelta(seconds=i), 1.0 if i % 3 else float(i), 2.0, 5, f"d{i}", "N", "t")
         for i in range(3000)],
        "id long, timestamp timestamp, latitude double, longitude double, zoom int, "
        "image_description string, danger string, text_description string",
    )
    first = cache.first_per_key(log)
    got = {(r.latitude, r.longitude, r.zoom): r.image_description for r in first.collect()}
    assert got[(1.0, 2.0, 5)] == "d1"  # two thirds of the rows share this key
    assert len(got) == 1 + 1000
    plan = _plan(first)
    assert "partial_min" in plan


def test_per_group_top_k_is_limited_before_the_shuffle(spark):
    rows = spark.createDataFrame(
        [("d", 2000, f"c{i % 500:03d}", float(i)) for i in range(5000)],
        "dataset string, year int, ADMIN string, value double",
    )
    out = insights.preview_rows(rows, ["dataset", "year"])
    assert [r.ADMIN for r in out.orderBy("row").collect()] == [f"c{i // 10:03d}" for i in range(20)]
    out.collect()
    assert "WindowGroupLimit" in _plan(out)
    tb = insights.top_bottom(rows, ["dataset", "year"])
    got = {(r.side, r.rank): (r.ADMIN, r.value) for r in tb.collect()}
    assert got[("top", 1)] == ("c499", 4999.0) and got[("bottom", 1)] == ("c000", 0.0) and len(got) == 10
    assert _plan(tb).count("WindowGroupLimit") >= 2


def test_exact_percentiles_with_a_hot_group(spark):
    vals = [("hot", float(i % 1000)) for i in range(6000)] + [("cold", float(i)) for i in range(11)]
    df = spark.createDataFrame(vals, "g string, v double")
    out = {r.g: r for r in quantiles.exact_percentiles(df, ["g"], "v", num_partitions=6).collect()}
    pdf = pd.DataFrame(vals, columns=["g", "v"])
    for g, grp in pdf.groupby("g"):
        for q, c in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75")):
            assert out[g][c] == grp["v"].quantile(q)


def test_indicator_scan_is_pruned_and_pushes_filters(spark):
    df = Q.QUERIES["a1_latest_year"](spark, SF_SMALL)
    df.collect()
    plan = _plan(df)
    scan = [line for line in plan.splitlines() if "FileScan parquet" in line and "lineitem" in line]
    assert scan, plan
    assert "l_comment" not in scan[0] and "l_partkey" not in scan[0]


def test_no_row_at_a_time_python(spark):
    for name in ("d5_kpis", "f22_verdicts", "d1_history_table", "j2_cache_lookup", "d6_tile_preview"):
        df = Q.QUERIES[name](spark, SF_SMALL)
        df.collect()
        plan = _plan(df)
        assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan, name


def test_lookup_aggregates_a_hot_key_before_the_join(spark):
    log = spark.createDataFrame(
        [(i, datetime(2024, 1, 1) + timedelta(seconds=(i * 7) % 3000), 1.0 if i % 3 else float(i % 50), 2.0, 5,
          f"d{i}", "N", "t") for i in range(3000)],
        "id long, timestamp timestamp, latitude double, longitude double, zoom int, "
        "image_description string, danger string, text_description string",
    )
    wanted = spark.createDataFrame([(1.0, 2.0, 5), (3.0, 2.0, 5), (9.5, 2.0, 5)], "latitude double, longitude double, zoom int")
    large = cache.first_for_keys(log, wanted)
    plain = cache.first_per_key(log.join(wanted, ["latitude", "longitude", "zoom"], "left_semi"))
    assert _rows(plain) == _rows(large) and len(_rows(large)) == 2
    large.collect()
    plan = _plan(large).split("== Initial Plan ==")[0]
    # the aggregate runs before the join: its partial step reads log rows directly
    assert "partial_min" in plan and plan.index("LeftSemi") < plan.index("partial_min")


def test_log_sort_spreads_one_timestamp(spark):
    """A stored log has no id and a workflow batch shares one timestamp."""
    from landsight.operators import history

    stamp = datetime(2024, 5, 1, 12, 0)
    log = spark.createDataFrame(
        [(stamp, float(i % 170) - 85.0, float(i // 170), 1 + i % 20, "N", "m1", "m2") for i in range(4000)],
        "timestamp timestamp, latitude double, longitude double, zoom int, danger string, "
        "image_model string, text_model string",
    ).repartition(4)
    ordered = history.sort_log(log)
    rows = [(r.latitude, r.longitude, r.zoom) for r in ordered.collect()]
    assert rows == sorted(rows) and len(rows) == 4000
    # the range partitioner's bounds include the location, so one timestamp's
    # rows can fall into many ranges (AQE merges them again when small)
    plan = _plan(ordered)
    assert re.search(r"rangepartitioning\(timestamp#\d+ DESC NULLS LAST, latitude#\d+ ASC", plan), plan
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = history.sort_log(log).rdd.glom().map(len).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sum(sizes) == 4000 and max(sizes) < 4000 // 2, sizes


def test_broadcast_check_bounds_rows_and_bytes(spark):
    from landsight.operators.broadcast import fits_broadcast

    wide = spark.createDataFrame([(i, "x" * 100_000) for i in range(20)], "id int, geometry string")
    assert fits_broadcast(wide, max_rows=100, max_bytes=10_000_000)
    assert not fits_broadcast(wide, max_rows=100, max_bytes=1_000_000)  # 2 MB of geometry
    assert not fits_broadcast(wide, max_rows=10)
    nested = spark.createDataFrame([([[1.0, 2.0]] * 1000,)], "ring array<array<double>>")
    assert not fits_broadcast(nested, max_bytes=1000) and fits_broadcast(nested, max_bytes=100_000)


def test_model_calls_use_all_cores(spark):
    """Key rows are tiny, so AQE would coalesce them into one task; the model
    step keeps the session's parallelism."""
    from landsight.operators.cache import KEY
    from landsight.plans.workflow import StubModelClient, analyse_keys
    from landsight.sources import testtables as T

    keys = T.request(spark, SF_SMALL).select(*KEY).distinct()
    sizes = analyse_keys(keys, StubModelClient, "/tiles").rdd.glom().map(len).collect()
    assert len(sizes) == spark.sparkContext.defaultParallelism and min(sizes) > 0, sizes
    assert sum(sizes) == keys.count()
