"""The key table: merges, ties, pruned lookups."""

import datetime as dt
import re

import pytest

from landsight.operators.cache import KEY, lookup_requests
from landsight.sources import first_results as R

LOG = "id long, timestamp timestamp, latitude double, longitude double, zoom int, image_description string, danger string, text_description string"


def entry(i, ts, lat, lon=1.0, zoom=5):
    return (i, ts, lat, lon, zoom, f"image {i}", "Y" if i % 2 else "N", f"why {i}")


def at(day):
    return dt.datetime(2024, 1, day, tzinfo=dt.timezone.utc)


@pytest.fixture(scope="module")
def batches(spark):
    one = [entry(i, at(1 + i % 9), float(i % 20)) for i in range(60)] + [entry(100, None, 50.0), entry(101, at(3), 51.0)]
    two = [entry(200 + i, at(1), float(i % 30)) for i in range(40)] + [entry(99, at(9), 50.0), entry(90, at(3), 51.0), entry(300, at(1), None), entry(301, at(1), float("nan"))]
    return [spark.createDataFrame(rows, LOG) for rows in (one, two)]


def rows_of(df):
    return sorted(str([r[c] for c in (*KEY, "hit", *R.PAYLOAD, "request_id")]) for r in df.collect())


def test_lookups_equal_those_on_the_whole_log(spark, tmp_path, batches):
    path = str(tmp_path / "first")
    requests = spark.createDataFrame(
        [(i, float(i % 45), 1.0, 5) for i in range(90)] + [(90, 50.0, 1.0, 5), (91, 51.0, 1.0, 5), (92, None, 1.0, 5), (93, -0.0, 1.0, 5), (94, float("nan"), 1.0, 5)],
        "request_id long, latitude double, longitude double, zoom int",
    )
    assert not any(r.hit for r in R.lookup_first_results(requests, path).collect())
    R.merge_first_results(batches[0], path, buckets=8)
    R.merge_first_results(batches[1], path)
    log = batches[0].unionByName(batches[1]).where("latitude IS NOT NULL AND NOT isnan(latitude)")
    want = rows_of(lookup_requests(requests, log))
    assert rows_of(R.lookup_first_results(requests, path)) == want
    # merged again, in another order: nothing changes
    R.merge_first_results(batches[0], path)
    assert rows_of(R.lookup_first_results(requests, path)) == want
    assert R.read_first_results(spark, path).count() == log.select(*KEY).distinct().count()
    assert R.vacuum(spark, path) == 1 and rows_of(R.lookup_first_results(requests, path)) == want


def test_only_wanted_buckets_are_read_and_touched_ones_written(spark, tmp_path, batches):
    path = str(tmp_path / "first")
    assert len(R.merge_first_results(batches[0], path, buckets=64)) > 10
    _, before = R._newest(spark, path)
    one = batches[0].where("id = 7")
    (bucket,) = R.merge_first_results(one, path)
    _, after = R._newest(spark, path)
    assert {b for b in after["folders"] if after["folders"][b] != before["folders"].get(b)} == {str(bucket)}
    read = R.read_first_results(spark, path, one.select(*KEY)).inputFiles()
    assert {re.search(r"bucket=(\d+)/", f)[1] for f in read} == {str(bucket)}


def test_a_second_writer_is_told(spark, tmp_path, batches):
    path = str(tmp_path / "first")
    R.merge_first_results(batches[0], path, buckets=4)
    number, manifest = R._newest(spark, path)
    R._commit(spark, path, number + 1, manifest)
    with pytest.raises(RuntimeError, match="another writer"):
        R._commit(spark, path, number + 1, manifest)
    assert R.merge_first_results(batches[0].where("false"), path) == []
