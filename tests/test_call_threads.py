"""Calls share threads, and long lists of calls are dealt over many tasks."""

import threading
import time

from landsight.operators.calls import CallPolicy, Calls
from landsight.session import CALL_TASKS_PER_SLOT, call_tasks
from landsight.sources import fetch as X
from landsight.sources import indicators


def test_one_thread_makes_many_calls():
    used, got = set(), {}

    def call(_, value):
        used.add(threading.current_thread())
        return value + 1

    with Calls(lambda: None, call, CallPolicy()) as calls:
        for start in (0, 50):
            calls.run(range(start, start + 50), lambda place, answer, error, start=start: got.update({start + place: answer}))
    assert got == {i: i + 1 for i in range(100)}
    assert len(used) == 1
    thread = used.pop()
    thread.join(5)
    assert not thread.is_alive()


def test_a_thread_that_hangs_is_left_and_ends_with_its_call():
    used, errors = [], {}

    def call(_, value):
        used.append(threading.current_thread())
        time.sleep(1 if value == 1 else 0)
        return value

    with Calls(lambda: None, call, CallPolicy(timeout=0.3, attempts=1)) as calls:
        calls.run(range(4), lambda place, _, error: errors.update({place: type(error).__name__}))
    assert errors == {0: "NoneType", 1: "TimeoutError", 2: "NoneType", 3: "NoneType"}
    assert len(set(used)) == 2
    used[1].join(5)
    assert not used[1].is_alive()


def test_a_task_of_fetches_holds_a_share_of_a_slots_list(spark, tmp_path):
    plan = spark.range(40).selectExpr("int(id) AS seq", "concat('u', id) AS url", f"concat('{tmp_path}/new/', id) AS target_path")
    results = X.run_fetch(plan, lambda url: url.encode())
    assert results.rdd.getNumPartitions() == call_tasks(spark) == 4 * CALL_TASKS_PER_SLOT > 4
    assert [(r.bytes, r.error) for r in results.orderBy("seq").collect()] == [(len(f"u{i}"), None) for i in range(40)]


def test_no_path_is_taken_apart_for_each_row(spark, tmp_path):
    for name in ("a+b", "c%41"):
        (tmp_path / f"{name}.csv").write_text(f"Entity,Code,Year,V\n{name},AAA,2000,1\n")
    long = indicators.read_indicator_csvs(spark, [str(tmp_path)])
    plan = long._jdf.queryExecution().optimizedPlan().toString()
    assert "url_decode" not in plan and "UrlCodec" not in plan and "regexp_extract" not in plan
    assert sorted((r.dataset, r.entity) for r in long.collect()) == [("a+b", "a+b"), ("c%41", "c%41")]
