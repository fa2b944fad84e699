"""Operators: merge semantics and guards, KPI formula vs brute force, years,
insights, profile, history and cache lookups."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from landsight.operators import cache, history, insights, merge, stats, years
from landsight.registry import queries as Q
from landsight.sources import indicators as I
from landsight.sources import testtables as T

from conftest import SF_SMALL


def test_merge_keeps_every_boundary_row(spark):
    """Repeated boundary codes match each, ``-99`` never does, NULL and short
    codes on either side match nothing, and several values of one code are
    several rows."""
    places = spark.createDataFrame(
        [("AAA", "main"), ("AAA", "island"), ("-99", "disputed"), ("-99", "base"), (None, "sea"), ("BBB", "empty")],
        "ISO_A3 string, place string",
    )
    rows = spark.createDataFrame(
        [("AAA", 1), ("\tAAA ", 2), (None, 3), ("", 4), ("OWID_XYZ", 5), ("aaa", 6), ("CCC", 7)], "Code string, value int"
    )
    out = merge.merge_boundaries(places, rows).collect()
    assert sorted((r.place, r.value) for r in out if r.value) == [("island", 1), ("island", 2), ("main", 1), ("main", 2)]
    assert sorted(r.place for r in out if r.value is None) == ["base", "disputed", "empty", "sea"]
    assert merge.merge_boundaries(places.where("false"), rows).count() == 0
    assert merge.merge_boundaries(places, rows.where("false")).count() == 6


def test_merge_names_the_missing_column(spark):
    ok_places, ok_rows = spark.createDataFrame([("A",)], "ISO_A3 string"), spark.createDataFrame([("A",)], "Code string")
    for places, rows, missing in (
        (ok_places.withColumnRenamed("ISO_A3", "iso"), ok_rows, "ISO_A3"),
        (ok_places, ok_rows.withColumnRenamed("Code", "code3"), "Code"),
    ):
        with pytest.raises(ValueError) as failed:
            merge.merge_boundaries(places, rows)
        assert f"'{missing}'" in str(failed.value)


def _merge_rows(df):
    cols = sorted(df.columns)
    return sorted(tuple(str(r[c]) for c in cols) for r in df.select(*cols).collect())


def test_merge_per_group_and_fallback_agree(spark):
    b = T.boundary(spark, SF_SMALL)
    ind = Q.indicator(spark, SF_SMALL, stored=False)
    latest = years.filter_latest(ind)
    fast = merge.merge_boundaries(b, latest, code_col="code", group_cols=["dataset"])
    slow = merge.merge_boundaries(b, latest, code_col="code", group_cols=["dataset"], max_broadcast_rows=1)
    assert _merge_rows(fast) == _merge_rows(slow)
    # both equal a plain per-dataset left join on the cleaned codes
    datasets = latest.select("dataset").distinct()
    valid = latest.where(F.length("code") == 3)
    plain = b.crossJoin(datasets).alias("l").join(
        valid.alias("r"),
        (F.col("l.dataset") == F.col("r.dataset")) & (F.col("l.ISO_A3") == F.col("r.code")),
        "left",
    ).select("l.dataset", "l.ISO_A3", "l.ADMIN", *[F.col(f"r.{c}") for c in latest.columns if c != "dataset"])
    assert _merge_rows(fast) == _merge_rows(plain)
    # every boundary row appears in every dataset
    per = fast.groupBy("dataset").agg(F.countDistinct("ISO_A3", "ADMIN").alias("n")).collect()
    assert {r.n for r in per} == {b.count()}


def test_kpis_match_materialised_merge(spark):
    b = T.boundary(spark, SF_SMALL)
    ind = Q.indicator(spark, SF_SMALL, stored=False)
    groups = years.available_years(ind).select("dataset", "year")
    fast = {(r.dataset, r.year): r for r in stats.merged_kpis(b, ind, groups).collect()}
    for g in groups.collect():
        rows = ind.where((F.col("dataset") == g.dataset) & (F.col("year_number") == float(g.year)))
        m = merge.merge_boundaries(b, rows, code_col="code").toPandas()
        k = fast[(g.dataset, g.year)]
        assert k.countries == len(m)
        assert k.with_data == m["value"].notna().sum()
        if k.with_data:
            assert k.mean_value == pytest.approx(m["value"].mean())
            assert k.max_value == m["value"].max() and k.min_value == m["value"].min()


def test_latest_year_single(spark):
    df = spark.createDataFrame([(2019.0,), (2020.7,), (None,)], "year_number double")
    assert years.latest_year_single(df) == 2020
    with pytest.raises(ValueError, match="No valid years found"):
        years.latest_year_single(spark.createDataFrame([(None,)], "year_number double"))


def test_top_bottom_ties_and_order(spark):
    s = spark.createDataFrame(
        [("d", c, v) for c, v in [("b", 0.0), ("a", 0.0), ("c", 0.0), ("z", 9.0), ("y", 5.0), ("x", 5.0), ("w", 1.0)]],
        "dataset string, ADMIN string, value double",
    )
    out = insights.top_bottom(s, ["dataset"], k=3).collect()
    top = [r.ADMIN for r in sorted((r for r in out if r.side == "top"), key=lambda r: r.rank)]
    bot = [r.ADMIN for r in sorted((r for r in out if r.side == "bottom"), key=lambda r: r.rank)]
    assert top == ["z", "x", "y"]
    assert bot == ["a", "b", "c"]


def test_top_bottom_of_values_that_are_no_numbers(spark):
    nan, inf = float("nan"), float("inf")
    rows = [("d", "a", nan), ("d", "b", inf), ("d", "c", -inf), ("d", "e", 1.0), ("d", "f", None), (None, "g", 2.0), ("d", None, 1.0)]
    out = insights.top_bottom(spark.createDataFrame(rows, "dataset string, ADMIN string, value double"), ["dataset"], k=2)
    assert out.columns == ["dataset", "ADMIN", "value", "side", "rank"]
    got = sorted((r.dataset or "", r.side, r["rank"], r.ADMIN) for r in out.collect())
    assert got == [("", "bottom", 1, "g"), ("", "top", 1, "g"), ("d", "bottom", 1, "c"), ("d", "bottom", 2, None), ("d", "top", 1, "a"), ("d", "top", 2, "b")]


def test_top_bottom_scans_the_observations_once(spark):
    """Both sides are ranked from one series, and a value is parsed in one place."""
    plan = Q.q_top_bottom(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert sum("FileScan" in line and "l_extendedprice" in line for line in plan.splitlines()) == 1


def test_insight_series_falls_back_to_means(spark):
    rows = spark.createDataFrame(
        [("d1", "m", "A", 2019.0, 1.0), ("d1", "m", "A", 2020.0, 4.0), ("d1", "m", "B", 2020.0, 7.0),
         ("d2", "m2", "A", 2020.0, 3.0), ("d2", "m2", "A", 2020.0, 5.0)],
        "dataset string, metric string, ADMIN string, year_number double, value double",
    )
    out = {(r.dataset, r.ADMIN): (r.value, r.label) for r in insights.insight_series(rows).collect()}
    assert out[("d1", "A")] == (3.0, "Annual Change in m (2019 → 2020)")
    assert ("d1", "B") not in out
    assert out[("d2", "A")] == (4.0, "m2")


def test_profile_matches_pandas_describe(spark):
    pdf = pd.DataFrame({"g": ["x"] * 7, "s": ["a", "b", "a", None, "c", "b", "a"],
                        "v": [1.0, 2.5, None, 4.0, 10.0, -3.0, 2.5]})
    df = spark.createDataFrame(pdf)
    out = {r.column_name: r for r in stats.profile(df, ["g"], ["s"], ["v"]).collect()}
    d = pdf[["s", "v"]].describe(include="all")
    assert out["s"]["count"] == d.loc["count", "s"] and out["s"]["unique"] == d.loc["unique", "s"]
    assert out["s"]["top"] == d.loc["top", "s"] and out["s"]["freq"] == d.loc["freq", "s"]
    for stat, col in [("mean", "mean"), ("std", "std"), ("min", "min"), ("25%", "p25"), ("50%", "p50"),
                      ("75%", "p75"), ("max", "max")]:
        assert out["v"][col] == pytest.approx(d.loc[stat, "v"])


def test_profile_empty_and_constant_columns(spark):
    """All-NULL text and numeric columns and a one-value column, as pandas describes them."""
    pdf = pd.DataFrame({"g": ["x"] * 3, "s": pd.Series([None] * 3, dtype=object),
                        "v": [None, None, None], "w": [7.0, None, None]})
    df = spark.createDataFrame(pdf, "g string, s string, v double, w double")
    out = {r.column_name: r for r in stats.profile(df, ["g"], ["s"], ["v", "w"]).collect()}
    assert (out["s"]["count"], out["s"]["unique"], out["s"]["top"], out["s"]["freq"]) == (0, 0, None, None)
    assert out["v"]["count"] == 0 and out["v"]["mean"] is None and out["v"]["p50"] is None
    assert (out["w"]["count"], out["w"]["mean"], out["w"]["std"], out["w"]["p25"]) == (1, 7.0, None, 7.0)


def test_choropleth_scale(spark):
    m = spark.createDataFrame(
        [("d", "A", 1.0), ("d", "B", 3.0), ("d", "C", None), ("e", "A", 2.0), ("f", "A", None)],
        "dataset string, ISO_A3 string, value double",
    )
    out = {(r.dataset, r.ISO_A3): r for r in stats.choropleth_scale(m, ["dataset"]).collect()}
    assert out[("d", "A")].scaled_value == 0.0 and out[("d", "B")].scaled_value == 1.0
    assert out[("d", "C")].no_data and out[("d", "C")].scaled_value is None
    assert out[("e", "A")].scaled_value is None and out[("e", "A")].has_data
    assert out[("f", "A")].has_data is False


def test_column_choice():
    assert I.country_column(["ISO_A3", "NAME", "Name"]) == "Name"
    assert I.country_column(["foo", "bar"]) == "foo"


def test_metric_choice(spark):
    raw = spark.createDataFrame(
        [("A", "X", "2020", "1.5", "true"), ("B", "Y", "2021", None, "false")],
        "Entity string, Code string, Year string, Metric string, Flag string",
    )
    def chosen(*cols):
        return I.choose_metric_columns(raw.withColumn("d", F.lit("x")), cols, "d")["x"]

    assert chosen("Entity", "Year", "Metric", "Flag") == "Flag"
    assert chosen("Entity", "Year", "Metric") == "Metric"
    assert chosen("Entity", "Year") == "Year"
    assert chosen("Entity") is None
    # booleans with a gap, or mixed with numbers, are no numbers
    mixed = spark.createDataFrame(
        [("p", "1", "true", "true"), ("p", "2", None, "3"), ("q", "x", "true", "1"), ("q", "y", "false", "2")], "d string, a string, b string, c string"
    )
    assert I.numeric_columns(mixed, ["a", "b", "c"], "d") == {"p": ["a"], "q": ["b", "c"]}


def test_datasets_without_year_or_metric_stay(spark, tmp_path):
    from landsight.plans.dashboard import Dashboard

    (tmp_path / "dated.csv").write_text("Entity,Code,Year,V\nA,AAA,2020,1\nB,BBB,2021,2\n")
    (tmp_path / "undated file.csv").write_text("Entity,Code,Share\nA,AAA,5\nB,BBB,7\n")
    (tmp_path / "words.csv").write_text("Entity,Code,Note\nA,AAA,x\nB,BBB,y\n")
    long = I.read_indicator_csvs(spark, [str(tmp_path)])
    assert {r.dataset for r in long.select("dataset").distinct().collect()} == {"dated", "undated file", "words"}
    places = spark.createDataFrame([("AAA", "Aland"), ("BBB", "Bland")], "ISO_A3 string, NAME string")
    dash = Dashboard(long, places)
    kpis = {(r.dataset, r.year): (r.countries, r.with_data, r.mean_value) for r in dash.kpis().collect()}
    assert kpis == {
        ("dated", 2020): (2, 1, 1.0), ("dated", 2021): (2, 1, 2.0), ("undated file", None): (2, 2, 6.0), ("words", None): (2, 0, None)
    }
    assert {r.dataset for r in dash.year_top_bottom().collect()} == {"dated", "undated file"}
    assert sorted((r.ADMIN, r.value) for r in dash.selection_merged("dated", 2020).where("value > 0").collect()) == [("Aland", 1.0)]
    assert dash.selection_merged("undated file", None).where("value IS NOT NULL").count() == 2
    profiled = {(r.dataset, r.column_name): r["count"] for r in dash.profile().collect()}
    assert profiled[("words", "value")] == 0 and profiled[("words", "entity")] == 2
    assert {r.dataset for r in dash.preview().collect()} == {"dated", "undated file"}
    with pytest.raises(ValueError):
        dash.latest_merged()
    with pytest.raises(ValueError, match="no column"):
        I.read_indicator_csvs(spark, [str(tmp_path)], metric="V")


def test_risk_kpis_rounding_and_empty(spark):
    log = spark.createDataFrame([(d,) for d in ["Y"] * 5 + ["N", "YES", None]], "danger string")
    k = history.risk_kpis(log).first()
    assert (k.total_analyses, k.at_risk, k.safe, k.risk_rate_pct, k.showing_safe) == (8, 5, 3, 62, 1)
    k0 = history.risk_kpis(log.where("false")).first()
    assert (k0.total_analyses, k0.risk_rate_pct) == (0, 0)


def test_first_per_key_prefers_earliest_then_id(spark):
    log = spark.createDataFrame(
        [(3, "2024-01-02 00:00:00", 1.0, 2.0, 5, "late", "N", "j3"),
         (2, "2024-01-01 00:00:00", 1.0, 2.0, 5, "tie-b", "Y", "j2"),
         (1, "2024-01-01 00:00:00", 1.0, 2.0, 5, "tie-a", "Y", "j1"),
         (4, None, 7.0, 8.0, 5, "no-ts", "N", "j4"),
         (5, "2024-03-01 00:00:00", 7.0, 8.0, 5, "has-ts", "Y", "j5")],
        "id long, timestamp string, latitude double, longitude double, zoom int, "
        "image_description string, danger string, text_description string",
    ).withColumn("timestamp", F.to_timestamp("timestamp"))
    first = {(r.latitude, r.longitude): r.image_description for r in cache.first_per_key(log).collect()}
    assert first == {(1.0, 2.0): "tie-a", (7.0, 8.0): "has-ts"}
    req = spark.createDataFrame([(1, 1.0, 2.0, 5), (2, 1.0, 2.0, 6), (3, 1.0, 2.0, 5)],
                                "request_id long, latitude double, longitude double, zoom int")
    hits, misses = cache.split_requests(req, log)
    assert sorted(r.request_id for r in hits.collect()) == [1, 3]
    assert [r.request_id for r in misses.collect()] == [2]


def test_history_sort_and_filter(spark):
    log = T.analysis_log(spark, SF_SMALL)
    rows = history.sort_log(history.filter_risk(log, "Safe"), "Oldest first").select("timestamp", "danger").collect()
    assert all(r.danger == "N" for r in rows)
    ts = [r.timestamp for r in rows]
    assert ts == sorted(ts)
    with pytest.raises(ValueError):
        history.filter_risk(log, "Maybe")


def test_exact_percentiles_match_pandas(spark):
    import random

    from landsight.operators.quantiles import exact_percentiles

    rnd = random.Random(7)
    rows = [("hot", float(rnd.choice([1, 2, 2, 3, 50]))) for _ in range(3000)]
    rows += [("wide", rnd.uniform(-100, 100)) for _ in range(2000)]
    rows += [("one", 4.5), ("nulls", None), ("nulls", 2.0), ("nulls", 8.0), ("two", 1.0), ("two", 2.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r for r in exact_percentiles(df, ["g"], "v", num_partitions=7).collect()}
    pdf = pd.DataFrame(rows, columns=["g", "v"])
    for g, part in pdf.groupby("g"):
        for q, col in [(0.25, "p25"), (0.5, "p50"), (0.75, "p75")]:
            assert got[g][col] == pytest.approx(part["v"].quantile(q)), (g, q)
    assert set(got) == {"hot", "wide", "one", "nulls", "two"}


def test_kpi_text_hides_statistics_without_data(spark):
    k = spark.createDataFrame(
        [("d", 2020, 1234, 2, 1234.565, 2000.0, 469.13), ("d", 2021, 25, 0, None, None, None)],
        "dataset string, year int, countries long, with_data long, mean_value double, max_value double, "
        "min_value double",
    )
    got = {r.year: r for r in stats.kpi_text(k).collect()}
    assert (got[2020].countries_text, got[2020].with_data_text) == ("1,234", "2")
    assert (got[2020].mean_value_text, got[2020].max_value_text) == (f"{1234.565:,.2f}", "2,000.00")
    assert (got[2021].countries_text, got[2021].with_data_text) == ("25", "0")
    assert got[2021].mean_value_text is None and got[2021].min_value_text is None
