"""Sources and sinks (CSV scan, GeoJSON boundaries, log round trips, tile
inventory, fetch operator) and the request workflow, batch and streaming."""

import json
import os

import pytest
from pyspark.sql import functions as F

from landsight.config import DATASETS
from landsight.plans.workflow import StubModelClient, process_requests, run_requests
from landsight.registry import queries as Q
from landsight.sources import boundaries, fetch, indicators, log as L, store, testtables as T, tiles
from landsight.streaming.requests import start_request_stream

from conftest import SF_SMALL

METRIC_NAMES = {
    "annual_deforestation": "Deforestation",
    "share_degraded_land": "Proportion of land that is degraded over total land area (%)",
    "share_protected_land": "Share of protected land",
}


def test_indicator_csv_scan_round_trip(spark, tmp_path):
    obs_df = T.observation(spark, SF_SMALL).where("value IS NULL OR value != 'abc'")
    obs = obs_df.toPandas()
    paths = []
    for ds, part in obs.groupby("dataset"):
        p = tmp_path / f"{ds}.csv"
        part[["Entity", "Code", "Year", "value"]].rename(columns={"value": METRIC_NAMES[ds]}).to_csv(p, index=False)
        paths.append(str(p))
    got = indicators.read_indicator_csvs(spark, paths)
    want = indicators.to_long(obs_df, "value")
    # pandas writes NULL codes as empty fields and the CSV reader treats the
    # NA tokens ("nan", "n/a") as missing: compare the parsed values.
    def key(df):
        return sorted(
            (r.dataset, r.entity, r.code or "", repr(r.year_number), repr(r.value))
            for r in df.select("dataset", "entity", "code", "year_number", "value").collect()
        )
    assert key(got) == key(want)
    metrics = {r.dataset: r.metric for r in got.select("dataset", "metric").distinct().collect()}
    assert metrics == METRIC_NAMES


def test_csv_layouts_read_one_header_per_dataset(spark, tmp_path):
    for name, header in (("dataset=a/xa 1.csv", "Entity,Code,Year,Forest"), ("dataset=a/xa2.csv", "Entity,Code,Year,Forest"),
                         ("dataset=001/xb.csv", 'Entity,Code,Year,"Share (%)"'), ("plain+name.csv", "Entity,Code,Year,Forest"), ("empty.csv", "")):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_text(header and header + "\n\tX ,AAA\t,2000,1\n")
    layouts = {h: sorted(f.rsplit("/", 1)[-1] for f in files) for h, files in indicators.csv_layouts(spark, [str(tmp_path / "*"), ]).items()}
    assert layouts == {("Entity", "Code", "Year", "Forest"): ["plain+name.csv", "xa 1.csv", "xa2.csv"],
                       ("Entity", "Code", "Year", "Share (%)"): ["xb.csv"]}
    got = indicators.read_indicator_csvs(spark, [str(tmp_path / "*")]).collect()
    assert sorted((r.dataset, r.metric, r.entity, r.code) for r in got) == [
        ("001", "Share (%)", "\tX ", "AAA"), ("a", "Forest", "\tX ", "AAA"), ("a", "Forest", "\tX ", "AAA"), ("plain+name", "Forest", "\tX ", "AAA")]


def test_large_csv_is_split(spark, tmp_path):
    p = tmp_path / "big.csv"
    p.write_text("Entity,Code,Year,V\n" + "Some place,AAA,2020,1.25\n" * 40_000)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
    try:
        long = indicators.read_indicator_csvs(spark, [str(p)], metric="V")
        assert long.rdd.getNumPartitions() > 3 and long.count() == 40_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_indicator_csv_metric_falls_back_like_pandas(spark, tmp_path):
    """A metric column holding text ("abc") is not numeric: the first numeric
    column (Year) is chosen, as pandas' dtype rule does."""
    p = tmp_path / "x.csv"
    p.write_text("Entity,Code,Year,Metric\nA,AAA,2020,1.5\nB,BBB,n/a,abc\n")
    got = indicators.read_indicator_csvs(spark, [str(p)])
    assert {r.metric for r in got.collect()} == {"Year"}
    forced = indicators.read_indicator_csvs(spark, [str(p)], metric="Metric")
    assert sorted((r.code, r.value) for r in forced.collect()) == [("AAA", 1.5), ("BBB", None)]


def test_boundaries_geojson(spark, tmp_path):
    doc = {
        "type": "FeatureCollection",
        "features": [
            {"type": "Feature", "properties": {"ISO_A3": "PRT", "ADMIN": "Portugal"},
             "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}},
            {"type": "Feature", "properties": {"ISO_A3": "-99", "ADMIN": "Somewhere"},
             "geometry": {"type": "Point", "coordinates": [2, 3]}},
        ],
    }
    p = tmp_path / "b.geojson"
    p.write_text(json.dumps(doc))
    b = boundaries.read_boundaries_geojson(spark, str(p)).collect()
    assert [(r.ISO_A3, r.ADMIN) for r in b] == [("PRT", "Portugal"), ("-99", "Somewhere")]
    assert json.loads(b[1].geometry) == {"type": "Point", "coordinates": [2, 3]}


def test_log_append_read_and_csv_export(spark, tmp_path):
    path = str(tmp_path / "log")
    assert L.read_log(spark, path).count() == 0
    src = T.analysis_log(spark, SF_SMALL)
    L.append_log(src, path)
    L.append_log(src.limit(3), path)
    back = L.read_log(spark, path)
    assert back.count() == src.count() + 3
    assert back.columns == L.LOG_FIELDS
    csv = str(tmp_path / "log_csv")
    L.export_log_csv(back, csv)
    again = L.read_log_csv(spark, csv)
    assert again.count() == back.count()
    assert again.where(F.col("timestamp").isNull()).count() == 0
    assert sorted(r.danger or "" for r in again.collect()) == sorted(r.danger or "" for r in back.collect())
    assert L.read_log_csv(spark, str(tmp_path / "missing")).count() == 0


def test_tile_inventory(spark, tmp_path):
    d = tmp_path / "images"
    d.mkdir()
    for name in ["esri_15_100_200.png", "esri_3_1_2.png"]:
        (d / name).write_bytes(b"\x89PNG fake")
    (d / "notes.txt").write_text("x")
    inv = tiles.read_tile_inventory(spark, str(d)).collect()
    assert sorted((r.file_name, r.z, r.x, r.y) for r in inv) == [
        ("esri_15_100_200.png", 15, 100, 200), ("esri_3_1_2.png", 3, 1, 2)]
    assert tiles.read_tile_inventory(spark, str(tmp_path / "none")).count() == 0
    images = {r.file_name: bytes(r.content) for r in tiles.read_tile_images(spark, str(d)).collect()}
    assert images == {n: b"\x89PNG fake" for n in ("esri_15_100_200.png", "esri_3_1_2.png")}


def test_download_plan_order_and_directory(spark, tmp_path):
    def fake_fetch(url):  # runs in the Python workers
        return f"payload-{url}".encode()

    target = str(tmp_path / "custom_dir")
    results = fetch.download_datasets(spark, fake_fetch, target)
    expected = [f for _, f, _ in DATASETS] + ["ne_110m_admin_0_countries.zip"]
    assert fetch.plan_targets(results) == [os.path.join(target, f) for f in expected]
    urls = [r.url for r in results]
    assert urls[:5] == [f"https://ourworldindata.org/grapher/{slug}.csv?v=1" for _, _, slug in DATASETS]
    assert urls[5].endswith("ne_110m_admin_0_countries.zip") and all(r.error is None for r in results)
    for r in results:
        with open(r.target_path, "rb") as fh:
            assert fh.read() == f"payload-{r.url}".encode()
    # already landed files are skipped
    again = fetch.run_fetch(fetch.download_plan(spark, target), fake_fetch,
                            skip_landed=fetch.landed_files(spark, target)).collect()
    assert again == []


def test_fetch_failure_is_reported(spark, tmp_path):
    def bad_fetch(url):
        if "degraded" in url:
            raise IOError("HTTP 404")
        return b"ok"

    with pytest.raises(RuntimeError, match="share-degraded-land"):
        fetch.download_datasets(spark, bad_fetch, str(tmp_path / "d"))


def test_workflow_then_cache_hits(spark, tmp_path):
    log_path = str(tmp_path / "log")
    req = T.request(spark, SF_SMALL)
    res = run_requests(req, log_path, StubModelClient, str(tmp_path / "tiles"), fetch=Q._echo_fetch).cache()
    n_keys = req.select("latitude", "longitude", "zoom").distinct().count()
    assert res.count() == req.count()
    assert res.where(F.col("source") == "model").count() == req.count()
    assert L.read_log(spark, log_path).count() == n_keys
    stored = L.read_log(spark, log_path).collect()
    assert {r.image_model for r in stored} == {"llava:7b"} and all(r.timestamp for r in stored)
    assert {r.danger for r in stored} <= {"Y", "N"}
    # second run: everything is answered from the log, nothing appended
    res2 = run_requests(req, log_path, StubModelClient, str(tmp_path / "tiles"), fetch=Q._echo_fetch)
    assert res2.where(F.col("source") == "cache").count() == req.count()
    assert L.read_log(spark, log_path).count() == n_keys
    # tiles of hits and misses are there
    assert res.where("tile_fetched").count() == req.count() and res2.where("tile_fetched").count() == req.count()
    assert os.path.exists(res.first().image_path)


def test_requests_without_a_whole_key_reach_nothing(spark, tmp_path):
    log_path = str(tmp_path / "log")
    nan = float("nan")
    req = spark.createDataFrame([(1, None, 2.0, 3), (2, 1.0, nan, 3), (3, 1.0, 2.0, None), (4, 1.0, 2.0, 3)],
                                "request_id long, latitude double, longitude double, zoom int")
    for _ in range(2):
        out = {r.request_id: r for r in run_requests(req, log_path, StubModelClient, str(tmp_path / "t"), fetch=Q._echo_fetch).collect()}
        assert [out[i].error for i in (1, 2, 3, 4)] == ["coordinates or zoom missing"] * 3 + [None]
        assert L.read_log(spark, log_path).count() == 1


def test_fetch_to_a_uri_lands_or_fails(spark, tmp_path):
    plan = spark.createDataFrame([(0, "u1", f"file://{tmp_path}/x/a.bin"), (1, "u2", f"file:{tmp_path}/x/b.bin"), (2, "u3", "nosuch://h/c.bin")],
                                 fetch.PLAN_SCHEMA)
    rows = {r.seq: r for r in fetch.run_fetch(plan, Q._echo_fetch).collect()}
    assert (rows[0].bytes, rows[1].bytes, rows[2].bytes) == (2, 2, None) and rows[2].error
    assert sorted(os.listdir(tmp_path / "x")) == ["a.bin", "b.bin"]
    assert fetch.landed_files(spark, f"file://{tmp_path}/x").count() == 2
    again = fetch.run_fetch(plan.where("seq < 2"), Q._echo_fetch, skip_landed=fetch.landed_files(spark, str(tmp_path / "x")))
    assert again.count() == 0


def test_log_csv_keeps_white_space(spark, tmp_path):
    rows = spark.createDataFrame([("  lead\n trail  ", "Y")], "image_description string, danger string")
    L.export_log_csv(rows, str(tmp_path / "csv"))
    assert L.read_log_csv(spark, str(tmp_path / "csv")).first().image_description == "  lead\n trail  "


def test_materialize_keeps_types(spark):
    df = spark.createDataFrame([("001", 1), ("2", 2)], "dataset string, v int")
    back = store.materialize(df, "types", ["dataset"])
    assert back.schema["dataset"].dataType == df.schema["dataset"].dataType and {r.dataset for r in back.collect()} == {"001", "2"}


def test_boundaries_parquet(spark, tmp_path):
    b = spark.createDataFrame([("PRT", "Portugal"), ("-99", None)], "ISO_A3 string, ADMIN string")
    b.write.parquet(str(tmp_path / "b"))
    assert sorted(r.ISO_A3 for r in boundaries.read_boundaries_parquet(spark, str(tmp_path / "b")).collect()) == ["-99", "PRT"]


def test_workflow_model_errors_are_rows(spark, tmp_path):
    class _Flaky(StubModelClient):  # local: shipped to the workers by value
        def assess(self, prompt, config):
            name = prompt.rsplit("tile ", 1)[-1].split(" of ")[0]
            if int(name.split("_")[2]) % 2 == 0:  # tiles in even columns: the model is down
                raise RuntimeError("model down")
            return "no visible change near " + name

    req = T.request(spark, SF_SMALL)
    results, new_rows = process_requests(req, L.empty_log(spark), _Flaky, str(tmp_path / "tiles"), fetch=Q._echo_fetch)
    errs = results.where(F.col("error").isNotNull())
    assert errs.count() > 0 and errs.where(F.col("source").isNotNull()).count() == 0
    assert results.where(F.col("source") == "model").count() > 0
    assert new_rows.where(F.col("danger").isNull()).count() == 0
    assert new_rows.count() == results.where(F.col("source") == "model").select("latitude", "longitude", "zoom").distinct().count()


def test_each_model_called_once_per_missing_key(spark, tmp_path):
    """Every call is recorded in a file (one line per call, from any worker)."""
    calls = str(tmp_path / "calls.txt")

    class _Counting(StubModelClient):  # local: shipped to the workers by value
        def describe(self, image_path, config):
            with open(calls, "a") as f:
                f.write("describe\n")
            if image_path.endswith("_1.png"):
                raise RuntimeError("no tile")
            return super().describe(image_path, config)

        def assess(self, prompt, config):
            with open(calls, "a") as f:
                f.write("assess\n")
            return super().assess(prompt, config)

    req = T.request(spark, SF_SMALL)
    results, new_rows = process_requests(req, L.empty_log(spark), _Counting, str(tmp_path / "tiles"), fetch=Q._echo_fetch)
    results.collect()
    new_rows.collect()
    n_keys = req.select("latitude", "longitude", "zoom").distinct().count()
    lines = open(calls).read().split()
    failed = results.where(F.col("error").isNotNull()).select("latitude", "longitude", "zoom").distinct().count()
    assert lines.count("describe") == n_keys
    assert lines.count("assess") == n_keys - failed and failed > 0


def test_streaming_requests(spark, tmp_path):
    src = tmp_path / "requests"
    req = T.request(spark, SF_SMALL)
    req.where("request_id % 2 = 0").write.parquet(str(src / "batch1"))
    req.where("request_id % 2 = 1").write.parquet(str(src / "batch2"))
    q = start_request_stream(
        spark, str(src) + "/*", str(tmp_path / "log"), str(tmp_path / "results"), str(tmp_path / "ckpt"),
        StubModelClient, str(tmp_path / "tiles"), available_now=True, fetch=Q._echo_fetch,
    )
    q.awaitTermination(300)
    results = spark.read.parquet(str(tmp_path / "results"))
    assert results.count() == req.count()
    n_keys = req.select("latitude", "longitude", "zoom").distinct().count()
    assert L.read_log(spark, str(tmp_path / "log")).count() == n_keys
    # a second query with its own checkpoint leaves the first one's results
    start_request_stream(
        spark, str(src) + "/*", str(tmp_path / "log"), str(tmp_path / "results"), str(tmp_path / "ckpt2"),
        StubModelClient, str(tmp_path / "tiles"), available_now=True, fetch=Q._echo_fetch,
    ).awaitTermination(300)
    assert spark.read.parquet(str(tmp_path / "results")).count() == 2 * req.count()


def test_materialize_round_trip(spark):
    df = Q.indicator(spark, SF_SMALL, stored=False)
    m = store.materialize(df, "t", ["dataset"])
    assert m.columns == df.columns and m.count() == df.count()


def test_csv_na_tokens_and_fractional_years(spark, tmp_path):
    p = tmp_path / "ind.csv"
    p.write_text(
        "Entity,Code,Year,Metric\n"
        "A,NA,2020,1\n"          # pandas reads NA as missing: code NULL, dropped by the merge
        "B,BBB,2020.5,2\n"       # fractional year: listed truncated, matches no selection
        "C,CCC,2020,nan\n"       # missing value
        "D,DDD,2019,4\n"
    )
    long = indicators.read_indicator_csvs(spark, [str(p)])
    rows = {r.entity: r for r in long.collect()}
    assert rows["A"].code is None
    assert (rows["B"].year_number, rows["B"].year) == (2020.5, None)
    assert rows["C"].value is None
    from landsight.operators import years

    avail = sorted((r.year, r.year_rank) for r in years.available_years(long).collect())
    assert avail == [(2019, 2), (2020, 1)]
    assert years.filter_year(long, 2020).count() == 2  # A and C, not B


def test_log_csv_timestamps_with_and_without_fraction(spark, tmp_path):
    p = tmp_path / "log.csv"
    header = ",".join(L.LOG_FIELDS)
    p.write_text(
        header + "\n"
        + '2024-05-01T10:00:00+00:00,1.5,2.5,3,"multi\nline ""desc""",ip,vm,just,tp,tm,Y\n'
        + "2024-05-01T10:00:00.123456+00:00,1.5,2.5,3,d,ip,vm,just,tp,tm,N\n"
        + "not a time,1.5,2.5,3,d,ip,vm,just,tp,tm,N\n"
    )
    got = L.read_log_csv(spark, str(p)).collect()
    assert got[0].image_description == 'multi\nline "desc"'
    assert got[0].timestamp is not None and got[1].timestamp.microsecond == 123456
    assert got[2].timestamp is None


def test_cache_key_is_exact(spark):
    from landsight.operators import cache

    log = spark.createDataFrame(
        [(1, None, 38.67989, -9.32563, 15, "d", "Y", "j")],
        "id long, timestamp timestamp, latitude double, longitude double, zoom int, "
        "image_description string, danger string, text_description string",
    )
    req = spark.createDataFrame([(1, 38.67989, -9.32563, 15), (2, 38.679890001, -9.32563, 15),
                                 (3, 38.67989, -9.32563, 16)],
                                "request_id long, latitude double, longitude double, zoom int")
    got = {r.request_id: r.hit for r in cache.lookup_requests(req, log).collect()}
    assert got == {1: True, 2: False, 3: False}


def test_indicator_table_ingest(spark, tmp_path):
    long = Q.indicator(spark, SF_SMALL, stored=False)
    path = str(tmp_path / "indicator")
    indicators.write_indicator_table(long, path)
    back = indicators.read_indicator_table(spark, path)
    assert back.columns == long.columns
    assert back.count() == long.count()
    one = back.where(F.col("dataset") == "share_degraded_land")
    assert "PartitionFilters: [isnotnull(dataset" in one._jdf.queryExecution().executedPlan().toString()


def test_streaming_history_reports(spark, tmp_path):
    from landsight.operators.history import risk_kpis
    from landsight.streaming import history as SH

    log_path = str(tmp_path / "log")
    src = T.analysis_log(spark, SF_SMALL)
    L.append_log(src.where("id % 2 = 0"), log_path)
    L.append_log(src.where("id % 2 = 1"), log_path)
    batch_log = L.read_log(spark, log_path)

    q = (SH.running_risk_kpis(SH.log_stream(spark, log_path)).writeStream.outputMode("complete")
         .format("memory").queryName("running_kpis").option("checkpointLocation", str(tmp_path / "c1"))
         .trigger(availableNow=True).start())
    q.awaitTermination(300)
    assert spark.table("running_kpis").collect()[0].asDict() == risk_kpis(batch_log).collect()[0].asDict()

    # days far apart, then a late row of the first day: every row counts
    out = str(tmp_path / "daily")
    late = src.orderBy("timestamp").limit(1)
    for more in (None, late):
        if more is not None:
            L.append_log(more, log_path)
        SH.start_daily_risk_kpis(spark, log_path, out, str(tmp_path / "c2"), available_now=True).awaitTermination(300)
        got = sorted(map(tuple, SH.read_daily_risk_kpis(spark, out).collect()))
        assert got == sorted(map(tuple, SH.daily_risk_kpis(L.read_log(spark, log_path)).collect()))


def test_csv_without_year_or_code(spark, tmp_path):
    from landsight.operators import years

    p = tmp_path / "noyear.csv"
    p.write_text("Entity,Code,Metric\nA,AAA,1.5\nB,BBB,2\n")
    long = indicators.read_indicator_csvs(spark, [str(p)])
    assert long.count() == 2 and years.available_years(long).count() == 0
    q = tmp_path / "nocode.csv"
    q.write_text("Entity,Year,Metric\nA,2020,1.5\n")
    with pytest.raises(ValueError, match=r"df doesn't have 'Code' \(ISO-3\)"):
        indicators.read_indicator_csvs(spark, [str(q)])


class _Conf:
    def __init__(self, values):
        self.values = dict(values)

    def get(self, key, default=None):
        return self.values.get(key, default)

    def set(self, key, value):
        self.values[key] = value


class _Session:
    """Stand-in for a session without a SparkContext (as under Spark Connect)."""

    def __init__(self, values):
        self.conf = _Conf(values)

    @property
    def sparkContext(self):
        raise RuntimeError("no SparkContext")


def test_checkpoint_folder_comes_from_the_session():
    from landsight.session import checkpoint_dir

    assert checkpoint_dir(_Session({"spark.checkpoint.dir": "s3://shared/ckpt", "spark.master": "yarn"})) == \
        "s3://shared/ckpt"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir is not set"):
        checkpoint_dir(_Session({"spark.master": "spark://cluster:7077"}))
    local = _Session({"spark.master": "local[2]"})
    folder = checkpoint_dir(local)
    assert local.conf.get("spark.checkpoint.dir") == folder
