"""Bounded calls: time-outs, further attempts, batches, and what they leave alone."""

import asyncio
import threading
import time

import pytest
from pyspark.sql import functions as F

from landsight.operators.calls import CallPolicy, Calls, may_pass
from landsight.plans.workflow import BatchStubModelClient, StubModelClient, describe_images, process_requests
from landsight.registry import queries as Q
from landsight.sources import fetch as X
from landsight.sources import log as L
from landsight.sources import testtables as T

SF_SMALL = "/root/testdata/sf0.001"
QUICK = dict(pause=0.01, longest_pause=0.02)


def answers(call, values, policy, batched=False, client=lambda: None):
    out = {}

    def done(place, answer, error):
        assert place not in out  # once for each value
        out[place] = answer if error is None else f"{type(error).__name__}: {error}"

    with Calls(client, call, policy, batched) as calls:
        calls.run(values, done)
    return [out[i] for i in range(len(values))]


def test_every_value_is_called_once_and_so_many_at_once():
    now, most, seen, lock = [0], [0], [], threading.Lock()

    def call(_, v):
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
            seen.append(v)
        time.sleep(0.01)
        with lock:
            now[0] -= 1
        return v * 2

    assert answers(call, list(range(40)), CallPolicy(concurrency=4)) == [2 * v for v in range(40)]
    assert sorted(seen) == list(range(40)) and most[0] == 4
    assert answers(call, [], CallPolicy()) == []


def test_a_slow_call_leaves_the_others():
    released = threading.Event()

    def call(_, v):
        if v == 3:
            released.wait(20)
        return v

    start = time.monotonic()
    got = answers(call, list(range(8)), CallPolicy(timeout=0.15, attempts=2, **QUICK))
    assert got == [0, 1, 2, "TimeoutError: no answer in 0.15 s", 4, 5, 6, 7] and time.monotonic() - start < 5
    released.set()


def test_calls_that_never_end_are_bounded():
    released, started = threading.Event(), []

    def call(_, v):
        started.append(v)
        released.wait(20)

    got = answers(call, list(range(30)), CallPolicy(concurrency=2, timeout=0.05, attempts=1, hung_calls=3, **QUICK))
    assert len(started) <= 4 and all(g.startswith("TimeoutError") for g in got) and "not called" in got[-1]
    released.set()


def test_what_may_pass_is_tried_again():
    tries = {}

    def call(_, v):
        tries[v] = tries.get(v, 0) + 1
        if v == "lost" and tries[v] < 3:
            raise ConnectionResetError("lost")
        if v == "bad":
            raise ValueError("bad value")
        if v == "down":
            raise ConnectionError("down")
        return v

    got = answers(call, ["a", "lost", "bad", "down", "b"], CallPolicy(attempts=3, **QUICK))
    assert got == ["a", "lost", "ValueError: bad value", "ConnectionError: down", "b"]
    assert tries == {"a": 1, "lost": 3, "bad": 1, "down": 3, "b": 1}


def test_which_errors_may_pass():
    import urllib.error

    def http(code):
        return urllib.error.HTTPError("u", code, "x", None, None)

    assert [may_pass(http(c)) for c in (404, 403, 429, 503)] == [False, False, True, True]
    assert may_pass(urllib.error.URLError("refused")) and may_pass(TimeoutError()) and not may_pass(FileNotFoundError())
    error = ValueError()
    error.retryable = True
    assert may_pass(error)


def test_a_pause_does_not_hold_up_the_others():
    order, first = [], [True]

    def call(_, v):
        if v == 0 and first[0]:
            first[0] = False
            raise ConnectionError
        order.append(v)

    answers(call, list(range(5)), CallPolicy(pause=0.2, longest_pause=0.2))
    assert order == [1, 2, 3, 4, 0]


def test_batches_and_the_bad_value_in_one():
    sizes = []

    def call(_, values):
        sizes.append(len(values))
        if 13 in values:
            raise ValueError("13")
        return [v if v % 5 else KeyError(v) for v in values]

    got = answers(call, list(range(1, 41)), CallPolicy(batch_size=16), batched=True)
    assert got == [("ValueError: 13" if v == 13 else v if v % 5 else f"KeyError: {v}") for v in range(1, 41)]
    assert sizes[0] == 16 and sizes.count(16) == 2 and len(sizes) < 15
    short = answers(lambda _, values: values[1:], [1, 2, 3], CallPolicy(), batched=True)
    assert short == ["ValueError: 0 answers to 1 values"] * 3


def test_coroutines_are_cancelled():
    ended = []

    async def call(_, v):
        try:
            await asyncio.sleep(10 if v == 2 else 0.01)
        except asyncio.CancelledError:
            ended.append(v)
            raise
        return v

    got = answers(call, [1, 2, 3, 4], CallPolicy(concurrency=4, timeout=0.2, attempts=1))
    assert got == [1, "TimeoutError: no answer in 0.2 s", 3, 4] and ended == [2]


def test_policy_is_checked():
    for bad in ("concurrency", "batch_size", "attempts", "hung_calls"):
        with pytest.raises(ValueError):
            CallPolicy(**{bad: 0})


def test_models_are_called_in_batches(spark, tmp_path):
    """Each batch writes its size; a client with coroutines gives the same."""
    calls = str(tmp_path / "calls.txt")

    class Counting(BatchStubModelClient):  # local: shipped to the workers by value
        def batch_describe(self, image_paths, config):
            with open(calls, "a") as f:
                f.write(f"{len(image_paths)}\n")
            return [None if "none" in p else "image of " + p for p in image_paths]

    class Coroutines:
        async def describe(self, image_path, config):
            return None if "none" in image_path else "image of " + image_path

    paths = [(f"p{i}",) for i in range(50)] + [(None,), ("none",)]
    df = spark.createDataFrame(paths, "image_path string").coalesce(1)
    want = [(p, None if p in (None, "none") else "image of " + p, None) for (p,) in paths]
    for client in (Counting, Coroutines):
        got = describe_images(df, client, policy=CallPolicy(batch_size=10, concurrency=3)).collect()
        assert [(r.image_path, r.image_description, r.image_description_error) for r in got] == want
    assert sorted(int(x) for x in open(calls)) == [1, 10, 10, 10, 10, 10]


def test_workflow_with_a_busy_and_a_hanging_model(spark, tmp_path):
    """The answers are the plain client's; a prompt that never ends is an error on its row."""

    class Hanging(BatchStubModelClient):  # local: shipped to the workers by value
        def batch_assess(self, prompts, config):
            import time

            if any("_1.png" in p for p in prompts):
                time.sleep(60)
            return super().batch_assess(prompts, config)

    req = T.request(spark, SF_SMALL)
    policy = CallPolicy(concurrency=2, batch_size=4, timeout=0.5, attempts=4, hung_calls=64, **QUICK)
    plain, _ = process_requests(req, L.empty_log(spark), StubModelClient, str(tmp_path / "a"), fetch=Q._echo_fetch)
    busy, _ = process_requests(req, L.empty_log(spark), BatchStubModelClient, str(tmp_path / "b"), fetch=Q._echo_fetch, policy=CallPolicy(**QUICK))
    hung, _ = process_requests(req, L.empty_log(spark), Hanging, str(tmp_path / "c"), fetch=Q._echo_fetch, policy=policy)
    names = ["request_id", "source", "image_description", "danger", "justification", "error"]
    want = {r.request_id: tuple(r) for r in plain.select(names).collect()}
    assert {r.request_id: tuple(r) for r in busy.select(names).collect()} == want
    tiles = {r.request_id: r.tile_file for r in hung.collect()}
    for r in hung.select(names).collect():
        if tiles[r.request_id].endswith("_1.png"):
            assert r.source is None and r.error == "TimeoutError: no answer in 0.5 s"
        else:
            assert tuple(r) == want[r.request_id]


def test_fetch_is_tried_again_and_timed(spark, tmp_path):
    seen = str(tmp_path / "seen")

    def fetch(url):
        import os
        import time

        if url == "slow":
            time.sleep(30)
        if url == "missing":
            raise FileNotFoundError(url)
        if not os.path.exists(f"{seen}-{url}"):
            open(f"{seen}-{url}", "w").close()
            raise ConnectionError("first attempt")
        return url.encode()

    rows = [(i, u, str(tmp_path / "landed" / u)) for i, u in enumerate(["a", "slow", "missing", "b"])]
    plan = spark.createDataFrame(rows, X.PLAN_SCHEMA)
    got = {r.url: (r.bytes, r.error) for r in X.run_fetch(plan, fetch, policy=CallPolicy(timeout=0.5, attempts=2, **QUICK)).collect()}
    assert got == {
        "a": (1, None), "b": (1, None), "slow": (None, "TimeoutError: no answer in 0.5 s"), "missing": (None, "FileNotFoundError: missing"),
    }
    assert sorted(p.name for p in (tmp_path / "landed").iterdir()) == ["a", "b"]
    assert X.landed_files(spark, str(tmp_path / "landed")).where(F.col("target_path").endswith("/a")).count() == 1
