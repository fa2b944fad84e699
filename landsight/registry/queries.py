"""Registered queries: one per operator group of the inventory.

Each takes ``(spark, sf_dir)``, reads the driver's test tables through the
adapters of ``landsight.sources.testtables``, applies library operators, and
returns a DataFrame whose column names match the oracle SQL of the same key.
Floating results of unordered sums are rounded to 4 decimals (both sides).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import merge as M
from ..operators import stats as S
from ..operators import years as Y
from ..sources import indicators as I
from ..sources import testtables as T

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}


def register(name: str):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        return fn

    return deco


def indicator(spark: SparkSession, sf_dir: str, stored: bool = True) -> DataFrame:
    """The long indicator table over the observation adapter.

    ``stored``: written once as Parquet partitioned by dataset and year (in the shared
    checkpoint folder) and read back, as a pipeline keeps its long table; the
    derived columns are then stored values that filters push down to, and plans
    with several branches scan files instead of re-deriving from the raw rows.
    """
    from ..sources.store import materialize

    long = I.to_long(T.observation(spark, sf_dir), metric="value")
    return materialize(long, "indicator", ["dataset", "year"]) if stored else long


def boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.boundary(spark, sf_dir)


# value columns of the CSV fixture: every dataset has its own header
CSV_VALUE_COLUMNS = {
    "annual_deforestation": "Deforestation (ha)",
    "share_degraded_land": "Degraded land, share",
    "share_protected_land": "Protected",
}

LONG_COLS = ["metric", "entity", "code", "year_number", "year", "value"]


def exact_mean(mean, n):
    """Canonical form of a mean for the cross-engine compare.

    The test values are prices with two decimals, so ``mean * n`` recovers the
    exact sum, and dividing that by ``n`` gives the same double in every
    engine whatever the summation order.  (Rounding the mean itself is not
    enough: exact means like ``x.xxxx5`` sit on the rounding boundary.)
    """
    mean, n = (F.col(mean) if isinstance(mean, str) else mean), (F.col(n) if isinstance(n, str) else n)
    return F.when(n > 0, F.round(mean * n, 2) / n)


def nullable_ints_as_double(df: DataFrame, *cols: str) -> DataFrame:
    """Integer columns that can be NULL leave Spark as float64 and DuckDB as a
    nullable integer; registered outputs carry them as DOUBLE on both sides."""
    return df.withColumns({c: F.col(c).cast("double") for c in cols})


@register("p2_clean_indicator")
def q_clean_indicator(spark, sf_dir):
    """Cleaned codes, coerced years and values, valid codes only."""
    ind = indicator(spark, sf_dir, stored=False)
    out = M.clean_indicator_codes(ind, "code").select("dataset", *LONG_COLS)
    return nullable_ints_as_double(out, "year")


@register("j1_merge")
def q_merge(spark, sf_dir):
    """Boundaries left-joined with every cleaned indicator row."""
    ind = indicator(spark, sf_dir)
    out = M.merge_boundaries(boundary(spark, sf_dir), ind, code_col="code")
    return nullable_ints_as_double(out, "year")


@register("a1_latest_year")
def q_latest_year(spark, sf_dir):
    """A1: latest year per dataset."""
    return Y.latest_year(indicator(spark, sf_dir, stored=False))


@register("a2_available_years")
def q_available_years(spark, sf_dir):
    """Years with data per dataset, newest first."""
    return Y.available_years(indicator(spark, sf_dir, stored=False)).withColumn("year_rank", F.col("year_rank").cast("long"))


@register("s6_latest_merged")
def q_latest_merged(spark, sf_dir):
    """Every dataset at its latest year, merged with the boundaries."""
    rows = Y.latest_rows(indicator(spark, sf_dir))
    out = M.merge_boundaries(boundary(spark, sf_dir), rows, code_col="code", group_cols=["dataset"])
    return nullable_ints_as_double(out, "year")


@register("d5_kpis")
def q_kpis(spark, sf_dir):
    """D5 (A3-A5): countries, with data, mean, max, min for every dataset and
    available year."""
    from ..plans.dashboard import Dashboard

    # ``year`` is set only for integral coerced years, so grouping by it is the
    # P7 comparison ``to_number(Year) == selected_year``.
    k = Dashboard(indicator(spark, sf_dir), boundary(spark, sf_dir)).kpis()
    return k.withColumn("mean_value", exact_mean("mean_value", "with_data"))


def matched(spark, sf_dir, stored: bool = True) -> DataFrame:
    """Indicator rows with their boundary country (the matched side of J1)."""
    from ..operators.insights import matched_rows

    return matched_rows(boundary(spark, sf_dir), indicator(spark, sf_dir, stored))


def selectable(spark, sf_dir) -> DataFrame:
    """Matched rows of a year that can be selected (an integral year); the
    per-year page forms group by it."""
    return matched(spark, sf_dir, stored=False).where(F.col("year").isNotNull())


def latest_merged(spark, sf_dir) -> DataFrame:
    """Every dataset at its latest year, merged (groups: the datasets present)."""
    return M.merge_boundaries(
        boundary(spark, sf_dir), Y.latest_rows(indicator(spark, sf_dir)), code_col="code",
        group_cols=["dataset"],
    )


def canonical_series_value(df: DataFrame):
    """Insight value in canonical form: a change of two exact means, or one mean."""
    change = exact_mean("last_mean", "last_n") - exact_mean("prev_mean", "prev_n")
    if "n_values" not in df.columns:
        return change
    return F.coalesce(change, exact_mean("value", "n_values"))


@register("a6_country_mean")
def q_country_mean(spark, sf_dir):
    """Per dataset, year and country, the mean value (the page's series for
    a selected year)."""
    out = S.country_means(selectable(spark, sf_dir), ["dataset", "year"])
    return out.select("dataset", "year", "ADMIN", exact_mean("mean_value", "n_values").alias("mean_value"))


@register("a7_year_pivot")
def q_year_pivot(spark, sf_dir):
    """Country x {previous, last year} mean pivot per dataset."""
    from ..operators.insights import year_pivot

    out = year_pivot(matched(spark, sf_dir))
    return out.withColumns({"prev_mean": exact_mean("prev_mean", "prev_n"),
                            "last_mean": exact_mean("last_mean", "last_n")})


@register("i1_yoy_change")
def q_yoy_change(spark, sf_dir):
    """Year-on-year change per country with its label."""
    from ..operators.insights import yoy_change

    out = yoy_change(matched(spark, sf_dir))
    return out.select("dataset", "metric", "ADMIN", "label", canonical_series_value(out).alias("value"))


@register("i2_insight_series")
def q_insight_series(spark, sf_dir):
    """The insight series per dataset (change if available, else mean)."""
    from ..operators.insights import insight_series

    out = insight_series(matched(spark, sf_dir))
    return out.select("dataset", "metric", "ADMIN", "label", canonical_series_value(out).alias("value"))


@register("i3_top_bottom")
def q_top_bottom(spark, sf_dir):
    """Top and bottom 5 countries per dataset and year (page form)."""
    from ..operators.insights import top_bottom

    means = S.country_means(selectable(spark, sf_dir), ["dataset", "year"])
    out = top_bottom(means, ["dataset", "year"], value_col="mean_value")
    return out.select("dataset", "year", "ADMIN", "side", F.col("rank").cast("long").alias("rank"),
                      exact_mean("mean_value", "n_values").alias("mean_value"))


@register("i3_insight_top_bottom")
def q_insight_top_bottom(spark, sf_dir):
    """I2 + I3: top and bottom 5 of each dataset's insight series."""
    from ..operators.insights import insight_series, top_bottom

    out = top_bottom(insight_series(matched(spark, sf_dir)), ["dataset", "metric", "label"])
    return out.select("dataset", "metric", "label", "ADMIN", "side", F.col("rank").cast("long").alias("rank"),
                      canonical_series_value(out).alias("value"))


@register("i4_preview")
def q_preview(spark, sf_dir):
    """First 20 non-missing (country, value) rows per dataset and year."""
    from ..operators.insights import preview_rows

    out = preview_rows(selectable(spark, sf_dir), ["dataset", "year"])
    return out.withColumn("row", F.col("row").cast("long"))


@register("d4_choropleth")
def q_choropleth(spark, sf_dir):
    """Map feed of every dataset at its latest year."""
    out = S.choropleth_scale(latest_merged(spark, sf_dir), ["dataset"])
    return out.select(
        "dataset", "ISO_A3", "ADMIN", "year_number", "value", "no_data",
        F.round("scaled_value", 6).alias("scaled_value"), "has_data",
    )


@register("a8_profile")
def q_profile(spark, sf_dir):
    """describe(include="all") of each dataset's latest merged frame."""
    out = S.profile(
        latest_merged(spark, sf_dir), ["dataset"],
        text_cols=["ISO_A3", "ADMIN", "entity", "code"], numeric_cols=["year_number", "value"],
    )
    out = out.withColumns({c: F.round(c, 4) for c in ["mean", "std", "min", "p25", "p50", "p75", "max"]})
    return nullable_ints_as_double(out, "unique", "freq")


@register("p10_metric_profile")
def q_metric_profile(spark, sf_dir):
    """P10: per raw column, non-null and numeric-parsable counts."""
    return I.metric_profile(T.observation(spark, sf_dir))


@register("f11_kpi_text")
def q_kpi_text(spark, sf_dir):
    """F11 on D5: the KPI row as display text."""
    return S.kpi_text(q_kpis(spark, sf_dir))


@register("f12_bar_labels")
def q_bar_labels(spark, sf_dir):
    """F12 on I3: the top and bottom bars per dataset and year with their labels."""
    from ..operators.insights import bar_labels

    return bar_labels(q_top_bottom(spark, sf_dir), "mean_value")


# ---- tiles, verdicts, history, cache, workflow -------------------------------------------


def _ring_columns(ring):
    cols = []
    for i in range(5):
        cols += [F.round(ring[i][0], 9).alias(f"ring{i}_lon"), F.round(ring[i][1], 9).alias(f"ring{i}_lat")]
    return cols


@register("f1_tiles")
def q_tiles(spark, sf_dir):
    """tile key, file name and URL of every request."""
    from ..functions import tiles as TL

    req = T.request(spark, sf_dir).withColumn("t", TL.tile_xyz("latitude", "longitude", "zoom"))
    return req.select(
        "request_id", "t.z", "t.x", "t.y",
        TL.tile_file_name(F.col("t")).alias("file_name"), TL.tile_url(F.col("t")).alias("url"),
    )


@register("d6_tile_preview")
def q_tile_preview(spark, sf_dir):
    """The preview of every request's tile."""
    from ..plans.preview import tile_preview

    p = tile_preview(T.request(spark, sf_dir))
    return p.select(
        "request_id", "tile.z", "tile.x", "tile.y",
        *[F.round(F.col("bounds")[c], 9).alias(c) for c in ("lon_min", "lat_min", "lon_max", "lat_max")],
        F.round("center.lat", 9).alias("center_lat"), F.round("center.lon", 9).alias("center_lon"),
        *_ring_columns(F.col("ring")),
        "zoom_label", "preview_zoom", "lat_label", "lon_label",
    )


@register("f5_coordinate_entry")
def q_coordinate_entry(spark, sf_dir):
    """form entries (magnitude and hemisphere) -> signed degrees and the
    five-decimal labels of the workflow page."""
    from ..functions import text as X
    from ..functions import tiles as TL

    e = T.coordinate_entry(spark, sf_dir)
    lat = TL.signed_degrees("lat_abs", "lat_dir")
    lon = TL.signed_degrees("lon_abs", "lon_dir")
    return e.select(
        "request_id", "lat_dir", "lon_dir", lat.alias("latitude"), lon.alias("longitude"), "zoom",
        X.coordinate_label(lat, "lat", 5).alias("lat_label"),
        X.coordinate_label(lon, "lon", 5).alias("lon_label"),
    )


@register("f22_verdicts")
def q_verdicts(spark, sf_dir):
    """Verdict of every reply (whole texts)."""
    from ..functions.verdict import parse_verdict

    r = T.reply(spark, sf_dir)
    v = parse_verdict("raw")
    return r.select("doc_id", v["danger"].alias("danger"), v["justification"].alias("justification"))


@register("a9_risk_kpis")
def q_risk_kpis(spark, sf_dir):
    """Risk KPIs of the whole log."""
    from ..operators.history import risk_kpis

    return risk_kpis(T.analysis_log(spark, sf_dir))


@register("a9_daily_risk_kpis")
def q_daily_risk_kpis(spark, sf_dir):
    """A9, A10 per analysis day over the whole log at once."""
    from ..streaming.history import daily_risk_kpis

    out = daily_risk_kpis(T.analysis_log(spark, sf_dir))
    return out.withColumn("day", F.date_format("day", "yyyy-MM-dd"))  # text: engines type dates differently


@register("a9_daily_risk_stream")
def q_daily_risk_stream(spark, sf_dir):
    """A9, A10 incremental: the log is stored, read as a stream in several
    micro-batches, and the per-day report is read back -- every day with all
    its rows."""
    from ..sources import log as L
    from ..sources.store import table_path
    from ..streaming.history import read_daily_risk_kpis, start_daily_risk_kpis

    root = table_path(spark.range(0), "daily-risk-stream")
    L.append_log(T.analysis_log(spark, sf_dir), f"{root}/log")
    start_daily_risk_kpis(spark, f"{root}/log", f"{root}/daily", f"{root}/checkpoint", available_now=True).awaitTermination()
    return read_daily_risk_kpis(spark, f"{root}/daily").withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@register("a9_replayed_risk_stream")
def q_replayed_risk_stream(spark, sf_dir):
    """A9, A10 incremental, counted more than once: the log comes in two parts, a
    second query with a checkpoint of its own counts it again, late rows follow,
    and the counts are compacted in between.  Each log file counts once."""
    from ..sources import log as L
    from ..sources.store import table_path
    from ..streaming import history as H

    root = table_path(spark.range(0), "replayed-risk-stream")
    src = T.analysis_log(spark, sf_dir)

    def run(checkpoint):
        H.start_daily_risk_kpis(spark, f"{root}/log", f"{root}/daily", f"{root}/{checkpoint}", available_now=True).awaitTermination()

    L.append_log(src.where(F.col("id") % 3 != 0), f"{root}/log")
    run("one")
    run("two")
    H.compact_daily_counts(spark, f"{root}/daily")
    L.append_log(src.where(F.col("id") % 3 == 0), f"{root}/log")
    run("one")
    return H.read_daily_risk_kpis(spark, f"{root}/daily").withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@register("d1_history_table")
def q_history_table(spark, sf_dir):
    """The History table, all records, newest first."""
    from ..operators.history import history_table

    return history_table(T.analysis_log(spark, sf_dir), "All", "Newest first")


@register("p14_history_at_risk")
def q_history_at_risk(spark, sf_dir):
    """The History table filtered to at-risk records, oldest first."""
    from ..operators.history import history_table

    return history_table(T.analysis_log(spark, sf_dir), "At Risk", "Oldest first")


@register("p14_history_safe")
def q_history_safe(spark, sf_dir):
    """The History table filtered to safe (``N``) records."""
    from ..operators.history import history_table

    return history_table(T.analysis_log(spark, sf_dir), "Safe", "Newest first")


@register("d2_risk_points")
def q_risk_points(spark, sf_dir):
    """The risk map feed (colour as four channels)."""
    from ..operators.history import risk_points

    p = risk_points(T.analysis_log(spark, sf_dir))
    return p.select("lat", "lon", "danger", *[p["color"][i].alias(f"color_{c}") for i, c in enumerate("rgba")])


def _request_tile_inventory(spark, sf_dir):
    """Tile inventory fixture: the tiles of every request were fetched."""
    from ..operators.cache import tile_keys

    return tile_keys(T.request(spark, sf_dir))


def _log_tile_inventory(spark, sf_dir):
    """Tile inventory fixture: the tiles of every logged analysis were fetched."""
    from ..operators.cache import tile_keys

    return tile_keys(T.analysis_log(spark, sf_dir))


@register("d3_detail_records")
def q_detail_records(spark, sf_dir):
    """One detail record per log row with its tile and cache flag."""
    from ..operators.history import detail_records

    out = detail_records(T.analysis_log(spark, sf_dir), _request_tile_inventory(spark, sf_dir))
    return out.drop("timestamp")


@register("j2_cache_lookup")
def q_cache_lookup(spark, sf_dir):
    """Every request with the first stored result for its key."""
    from ..operators.cache import lookup_requests

    return lookup_requests(T.request(spark, sf_dir), T.analysis_log(spark, sf_dir))


@register("j3_tile_worklist")
def q_tile_worklist(spark, sf_dir):
    """Tiles requests need that are not cached yet (inventory: the
    tiles of logged analyses)."""
    from ..operators.cache import tile_work_list

    return tile_work_list(T.request(spark, sf_dir), _log_tile_inventory(spark, sf_dir))


@register("w1_process_requests")
def q_process_requests(spark, sf_dir):
    """Every request answered from the log or by the (stub)
    models; the new log rows are not written here."""
    from ..plans.workflow import StubModelClient, process_requests

    results, _ = process_requests(
        T.request(spark, sf_dir), T.analysis_log(spark, sf_dir), StubModelClient, _tile_folder(spark), fetch=_echo_fetch
    )
    return results.drop("image_path")


@register("w1_batched_requests")
def q_batched_requests(spark, sf_dir):
    """The same answers by batch calls, several at once, to models
    that are busy for a third of each batch at first."""
    from ..operators.calls import CallPolicy
    from ..plans.workflow import BatchStubModelClient, process_requests

    results, _ = process_requests(
        T.request(spark, sf_dir), T.analysis_log(spark, sf_dir), BatchStubModelClient, _tile_folder(spark), fetch=_echo_fetch,
        policy=CallPolicy(concurrency=2, batch_size=8, pause=0.01),
    )
    return results.drop("image_path")


def _tile_folder(spark) -> str:
    from ..sources.store import table_path

    return table_path(spark.range(0), "tiles")


@register("k2_new_log_rows")
def q_new_log_rows(spark, sf_dir):
    """The log rows of a batch, with a fixed clock."""
    from ..plans.workflow import StubModelClient, process_requests

    clock = T.utc_instant(F.lit("2024-06-01 12:00:00").cast("timestamp_ntz"))
    _, rows = process_requests(
        T.request(spark, sf_dir), T.analysis_log(spark, sf_dir), StubModelClient, _tile_folder(spark), clock=clock, fetch=_echo_fetch
    )
    return _timestamp_text(rows)


@register("f18_prompts")
def q_prompts(spark, sf_dir):
    """the text model's whole input for every logged description."""
    from ..config import DEFAULT_MODEL_CONFIG
    from ..functions.text import assessment_prompt

    log = T.analysis_log(spark, sf_dir)
    return log.select("id", assessment_prompt(DEFAULT_MODEL_CONFIG.text_prompt, F.col("image_description")).alias("prompt"))


@register("o2_ranked_history")
def q_ranked_history(spark, sf_dir):
    """O2: the place of every record of the whole log in the History page's two
    orders."""
    from ..operators.history import ranked_log

    log = T.analysis_log(spark, sf_dir).select("id", "timestamp")
    newest = ranked_log(log, "Newest first").with_place("newest_place")
    return ranked_log(newest, "Oldest first").with_place("oldest_place").select("id", "newest_place", "oldest_place")


@register("p11_country_means")
def q_country_column(spark, sf_dir):
    """Boundaries whose country column is called ``NAME``."""
    from ..plans.dashboard import Dashboard

    named = boundary(spark, sf_dir).withColumnRenamed("ADMIN", "NAME")
    dash = Dashboard(indicator(spark, sf_dir, stored=False), named)
    rows = dash.matched().where(F.col("year").isNotNull())
    out = S.country_means(rows, ["dataset", "year"])
    return out.select("dataset", "year", "ADMIN", exact_mean("mean_value", "n_values").alias("mean_value"))


@register("j2_stored_lookup")
def q_stored_lookup(spark, sf_dir):
    """The lookup on the stored key table, of which only the buckets
    of the requested keys are read.  The log comes in two batches, the later ids
    first; all entries share one timestamp, so the order of storage decides."""
    from ..sources import first_results as R
    from ..sources.store import table_path

    path = table_path(spark.range(0), "first-results")
    src = T.analysis_log(spark, sf_dir).withColumn("timestamp", T.utc_instant(F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")))
    for rest in (1, 0):
        R.merge_first_results(src.where(F.col("id") % 2 == rest), path)
    return R.lookup_first_results(T.request(spark, sf_dir), path)


@register("w1_request_stream")
def q_request_stream(spark, sf_dir):
    """W1 incremental: every request lands as files in a folder; the streaming
    query, whose state holds the first result of every location, answers them in
    several micro-batches and appends the new log rows; the results are read
    back.  Same answers as the batch workflow."""
    from ..plans.workflow import StubModelClient
    from ..sources import log as L
    from ..sources.store import table_path
    from ..streaming.requests import start_request_stream

    root = table_path(spark.range(0), "request-stream")
    # a later micro-batch would call a location of an earlier one cached
    T.request(spark, sf_dir).withColumn("part", F.pmod(F.xxhash64("latitude", "longitude", "zoom"), F.lit(3))).repartition("part").write.partitionBy("part").parquet(f"{root}/requests")
    L.append_log(T.analysis_log(spark, sf_dir), f"{root}/log")
    query = start_request_stream(
        spark, f"{root}/requests/part=*", f"{root}/log", f"{root}/results", f"{root}/checkpoint",
        StubModelClient, f"{root}/tiles", available_now=True, fetch=_echo_fetch, max_files_per_trigger=1,
    )
    query.awaitTermination()
    return spark.read.parquet(f"{root}/results").drop("query", "epoch", "image_path")


@register("s1_catalogue")
def q_catalogue(spark, sf_dir):
    """The dataset catalogue with the number of observed rows."""
    from ..sources.fetch import dataset_catalogue

    counts = T.observation(spark, sf_dir).groupBy("dataset").agg(F.count(F.lit(1)).alias("observed_rows"))
    cat = dataset_catalogue(spark)
    out = cat.join(counts, "dataset", "left")
    return out.select(
        "seq", "display_name", "file_name", "dataset", "slug", "url",
        F.coalesce("observed_rows", F.lit(0)).alias("observed_rows"),
    )


@register("p7_default_selection")
def q_default_selection(spark, sf_dir):
    """Each dataset at its default (newest available) year, merged."""
    from ..plans.dashboard import Dashboard

    return nullable_ints_as_double(Dashboard(indicator(spark, sf_dir), boundary(spark, sf_dir)).default_selection(), "year")


# ---- sources and sinks, round trips through the shared folder ------------------------------


def _stored_observation(spark, sf_dir) -> DataFrame:
    """The observations, joined once for the files of every dataset."""
    from ..sources.store import materialize

    return materialize(T.observation(spark, sf_dir), "observation", ["dataset"])


@register("s4_csv_scan")
def q_csv_scan(spark, sf_dir):
    """The observations written as CSV -- one folder per dataset,
    each with its own value column and a text column that must not be taken for
    the metric -- and scanned back into the long table."""
    from ..sources.store import table_path

    path = table_path(spark.range(0), "observation-csv")
    obs = _stored_observation(spark, sf_dir)
    # "abc" would make the value column text; it goes into the note here
    number = F.when(F.col("value") != "abc", F.col("value"))
    for dataset, name in CSV_VALUE_COLUMNS.items():
        rows = obs.where(F.col("dataset") == dataset)
        rows.select("Entity", "Code", "Year", number.alias(name), F.concat(F.lit("note "), F.coalesce("value", F.lit("-"))).alias("note")).write.option(
            "header", True
        ).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(f"{path}/dataset={dataset}")
    long = I.read_indicator_csvs(spark, [path])
    return nullable_ints_as_double(long.select("dataset", *LONG_COLS), "year")


@register("s4_csv_records")
def q_csv_records(spark, sf_dir):
    """S4 where records have several lines: entities and notes with line feeds,
    quotes and separators, in files of one dataset each; scanned back without
    ``multiLine``, in as many tasks as the files have ranges."""
    from ..sources.store import table_path

    path = table_path(spark.range(0), "observation-records")
    obs = _stored_observation(spark, sf_dir).where(F.col("value").isNull() | (F.col("value") != "abc"))
    entity = F.when(F.col("Code").isNull() | (F.col("Code") == "US"), F.concat("Entity", F.lit('\n"'), "dataset", F.lit('",\n\nend'))).otherwise(F.col("Entity"))
    note = F.concat(F.lit('"'), "Entity", F.lit('"\r\n'), F.coalesce("value", F.lit("-")))
    for dataset, name in CSV_VALUE_COLUMNS.items():
        rows = obs.where(F.col("dataset") == dataset)
        rows.select(entity.alias("Entity"), "Code", "Year", F.col("value").alias(name), note.alias("note")).write.option("header", True).option(
            "escape", '"'
        ).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(f"{path}/dataset={dataset}")
    long = I.read_indicator_csvs(spark, [path])
    return nullable_ints_as_double(long.select("dataset", *LONG_COLS), "year")


@register("k1_log_append_read")
def q_log_append_read(spark, sf_dir):
    """The log appended in two batches to a date-partitioned
    Parquet table and read back with the fixed schema."""
    from ..sources import log as L
    from ..sources.store import table_path

    path = table_path(spark.range(0), "log")
    src = T.analysis_log(spark, sf_dir)
    L.append_log(src.where(F.col("id") % 2 == 0), path)
    L.append_log(src.where(F.col("id") % 2 == 1), path)
    return _timestamp_text(L.read_log(spark, path))


@register("k3_log_csv_export_read")
def q_log_csv_export_read(spark, sf_dir):
    """The log exported as CSV with a header and parsed back
    (timestamps by ``try_to_timestamp``)."""
    from ..sources import log as L
    from ..sources.store import table_path

    path = table_path(spark.range(0), "log-csv")
    L.export_log_csv(T.analysis_log(spark, sf_dir), path)
    return _timestamp_text(L.read_log_csv(spark, path))


def _timestamp_text(log: DataFrame) -> DataFrame:
    """Timestamps as ISO text with microseconds for the cross-engine compare."""
    return log.withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


def _echo_fetch(url: str) -> bytes:
    """Stand-in for the tile service: the bytes of the URL itself."""
    return url.encode("utf-8")


@register("s9_tile_fetch")
def q_tile_fetch(spark, sf_dir):
    """The tile work list fetched (stand-in service) into a
    folder of the shared checkpoint area, then listed back as the inventory."""
    from ..operators.cache import tile_work_list
    from ..sources.fetch import fetch_all, tile_fetch_plan
    from ..sources.store import table_path
    from ..sources.tiles import read_tile_inventory

    # a URI: the folder need not be a local path
    folder = table_path(spark.range(0), "tiles")
    folder = folder if ":" in folder else f"file://{folder}"
    work = tile_work_list(T.request(spark, sf_dir), _log_tile_inventory(spark, sf_dir))
    fetch_all(tile_fetch_plan(work, folder), _echo_fetch)
    return read_tile_inventory(spark, folder).select("file_name", "z", "x", "y", "length")


@register("s5_boundaries_geojson")
def q_boundaries_geojson(spark, sf_dir):
    """Site-level boundary features -- one per supplier, coded by its
    nation, with a point geometry -- written as a GeoJSON text sequence and
    read back (the feature count grows with the data)."""
    from ..sources.boundaries import read_boundaries_geojsonseq, write_boundaries_geojsonseq
    from ..sources.store import table_path

    su = T.table(spark, sf_dir, "supplier")
    geom = F.format_string('{"type":"Point","coordinates":[%d,%d]}', "s_suppkey", "s_nationkey")
    b = su.select(
        T.boundary_code(F.col("s_nationkey")).alias("ISO_A3"),
        F.col("s_name").alias("ADMIN"),
        geom.alias("geometry"),
    )
    path = table_path(spark.range(0), "boundaries-geojsonseq")
    write_boundaries_geojsonseq(b, path)
    return read_boundaries_geojsonseq(spark, path)
