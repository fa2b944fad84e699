"""The request stream's keyed state: micro-batches, restarts, replays."""

import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from landsight.operators.cache import KEY
from landsight.plans.workflow import StubModelClient, process_requests
from landsight.registry import queries as Q
from landsight.sources import log as L
from landsight.sources import testtables as T
from landsight.streaming.requests import start_request_stream

SF_SMALL = "/root/testdata/sf0.001"


def start(spark, root, checkpoint="ckpt", client=StubModelClient, **kw):
    return start_request_stream(
        spark, f"{root}/requests", f"{root}/log", f"{root}/results", f"{root}/{checkpoint}", client, f"{root}/tiles",
        available_now=True, fetch=Q._echo_fetch, max_files_per_trigger=1, **kw,
    ).awaitTermination(300)


def put(df, root, name):
    """A request file: whole or not there."""
    df.coalesce(1).write.parquet(f"{root}/{name}")
    (part,) = Path(f"{root}/{name}").glob("part-*.parquet")
    Path(f"{root}/requests").mkdir(exist_ok=True)
    shutil.copy(part, f"{root}/requests/{name}.parquet")


@pytest.fixture()
def client(tmp_path):
    calls = str(tmp_path / "calls")

    # local: it goes to the workers by value
    class Counting(StubModelClient):
        def describe(self, image_path, config):
            with open(calls, "a") as f:
                f.write(image_path.rsplit("/", 1)[-1] + "\n")
            return StubModelClient.describe(self, image_path, config)

    return Counting, calls


def test_micro_batches_restarts_and_replays(spark, tmp_path, client):
    root = str(tmp_path)
    factory, calls = client
    req = T.request(spark, SF_SMALL).where("request_id < 600")
    log = T.analysis_log(spark, SF_SMALL).where("id < 300")
    L.append_log(log, f"{root}/log")
    # one location in several micro-batches, before and after its first result
    for i in range(3):
        put(req.where(F.col("request_id") % 3 == i), root, f"part{i}")
    start(spark, root, client=factory)
    batches = sorted(p.name for p in Path(f"{root}/results").glob("query=*/epoch=*"))
    assert len(batches) >= 3

    def answers():
        rows = spark.read.parquet(f"{root}/results").collect()
        return sorted((r.request_id, r.image_description, r.danger, r.justification, r.error) for r in rows)

    want, _ = process_requests(req, log, StubModelClient, f"{root}/tiles2", fetch=Q._echo_fetch)
    want = sorted((r.request_id, r.image_description, r.danger, r.justification, r.error) for r in want.collect())
    assert answers() == want
    logged = L.read_log(spark, f"{root}/log").count()
    new_keys = req.select(*KEY).distinct().join(log.select(*KEY).distinct(), KEY, "left_anti").count()
    assert logged == 300 + new_keys and len(open(calls).read().split()) == new_keys

    # a restart goes on; what is logged by now is known by the state
    put(req.withColumn("request_id", F.col("request_id") + 1000), root, "later")
    start(spark, root, client=factory)
    assert len(answers()) == 2 * len(want)
    assert [a[1:] for a in answers() if a[0] >= 1000] == [w[1:] for w in want]
    assert L.read_log(spark, f"{root}/log").count() == logged and len(open(calls).read().split()) == new_keys


def test_a_micro_batch_delivered_again_adds_nothing(spark, tmp_path, client):
    root = str(tmp_path)
    factory, calls = client
    put(T.request(spark, SF_SMALL).where("request_id < 100"), root, "one")
    start(spark, root, client=factory)
    logged, called = L.read_log(spark, f"{root}/log").count(), len(open(calls).read().split())
    results = spark.read.parquet(f"{root}/results").count()
    # the driver was lost before the last micro-batch was marked as done
    commits = sorted(int(p.name) for p in Path(f"{root}/ckpt/commits").iterdir() if p.name.isdigit())
    Path(f"{root}/ckpt/commits/{commits[-1]}").unlink()
    for crc in Path(f"{root}/ckpt/commits").glob(f".{commits[-1]}.crc"):
        crc.unlink()
    start(spark, root, client=factory)
    assert L.read_log(spark, f"{root}/log").count() == logged > 0
    assert spark.read.parquet(f"{root}/results").count() == results == 100
    assert len(open(calls).read().split()) == called
