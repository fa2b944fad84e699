"""Bounded calls of a slow service from inside a task.

``Calls.run(values)`` calls a service for every value, some at once, and hands
over each answer as it comes.  Values go out one by one or, to a service that
takes lists, in batches.  An attempt has a time-out; what may pass (no answer, a lost
connection, a busy server) is tried again after a growing pause, during which
other values go on.

A batch that fails as a whole is halved, down to single values, so one bad value does not
take the others with it; a batch call may also put an exception in
the place of a single answer.

A plain function runs in a thread, which makes one call after another and cannot
be stopped: after a time-out it
is left behind, with the client it uses, and does not hold up the rest.  Left threads are
bounded: when ``hung_calls`` of them still hang, further values fail at once.  A
coroutine function is cancelled instead.
"""

from __future__ import annotations

import asyncio
import inspect
import queue
import random
import threading
import time
from collections import deque
from collections.abc import Callable, Iterable
from dataclasses import dataclass

# HTTP status codes of a server that is busy or away for a while.
BUSY = (408, 425, 429, 500, 502, 503, 504)


def may_pass(error: Exception) -> bool:
    """Whether another attempt may succeed: no answer, a lost connection, a busy
    server, or an error that says so (``retryable``)."""
    said = getattr(error, "retryable", None)
    if said is not None:
        return bool(said)
    code = getattr(error, "code", None) or getattr(getattr(error, "response", None), "status_code", None)
    if isinstance(code, int):
        return code in BUSY
    return isinstance(error, (TimeoutError, ConnectionError)) or type(error).__name__ == "URLError"


@dataclass(frozen=True)
class CallPolicy:
    """How a task calls a service.

    ``concurrency`` calls run at once in a task, each with a client of its own
    (a client with coroutine methods is shared); ``batch_size`` values go into
    a batch call; ``timeout`` (seconds, None: no bound) and ``attempts`` hold for
    each value; the pause before attempt k + 1 is ``pause * 2 ** (k - 1)`` seconds,
    ``longest_pause`` at most, shortened by up to half at random.
    """

    concurrency: int = 1
    batch_size: int = 16
    timeout: float | None = 300.0
    attempts: int = 3
    pause: float = 1.0
    longest_pause: float = 60.0
    hung_calls: int = 8
    may_pass: Callable[[Exception], bool] = may_pass

    def __post_init__(self):
        if min(self.concurrency, self.batch_size, self.attempts, self.hung_calls) < 1:
            raise ValueError("concurrency, batch_size, attempts and hung_calls are at least 1")

    def wait(self, attempt: int) -> float:
        return min(self.longest_pause, self.pause * 2 ** (attempt - 1)) * random.uniform(0.5, 1.0)


class _Thread(threading.Thread):
    """Runs what it is given, one after another, until it is given None."""

    def __init__(self):
        super().__init__(daemon=True)
        self.work: queue.SimpleQueue = queue.SimpleQueue()
        self.start()

    def run(self) -> None:
        while (work := self.work.get()) is not None:
            work()


class Calls:
    """The calls of one task.  ``make_client`` gives a client, ``call(client, value)``
    the answer; with ``batched``, ``call(client, values)`` a list of answers."""

    def __init__(self, make_client: Callable[[], object], call: Callable, policy: CallPolicy, batched: bool = False):
        self.make_client, self.call, self.policy, self.batched = make_client, call, policy, batched
        self.clients: list = []  # idle ones
        self.hung: set[_Thread] = set()
        # a thread for each call would cost more than a short call, and memory
        # that libraries keep by thread
        self.idle: list[_Thread] = []
        self.loop = asyncio.new_event_loop()
        self.coroutines = inspect.iscoroutinefunction(call)
        self.shared = make_client() if self.coroutines else None

    def __enter__(self):
        return self

    def __exit__(self, *_):
        while self.idle:
            self.idle.pop().work.put(None)
        self.loop.close()

    def run(self, values: Iterable, done: Callable[[int, object, Exception | None], None]) -> None:
        """Call the service for all values; ``done(place, answer, error)`` is
        called once for each, as soon as it is known."""
        places = list(enumerate(values))
        size = self.policy.batch_size if self.batched else 1
        work = deque((0.0, 1, places[i : i + size]) for i in range(0, len(places), size))
        self.loop.run_until_complete(self._all(work, done))

    async def _all(self, work: deque, done) -> None:
        # what waits for another attempt may be picked up by any of them, so
        # one that finds no work ends only if no other is under way
        under_way = [0]
        await asyncio.gather(*(self._worker(work, under_way, done) for _ in range(self.policy.concurrency)))

    async def _worker(self, work: deque, under_way: list, done) -> None:
        while work or under_way[0]:
            now = time.monotonic()
            ready = next((i for i, item in enumerate(work) if item[0] <= now), None)
            if ready is None:
                await asyncio.sleep(min([0.05, *(max(item[0] - now, 0) for item in work)]))
                continue
            _, attempt, items = work[ready]
            del work[ready]
            under_way[0] += 1
            try:
                await self._group(items, attempt, work, done)
            finally:
                under_way[0] -= 1

    async def _group(self, items: list, attempt: int, work: deque, done) -> None:
        values = [v for _, v in items]
        try:
            found = await self._attempt(values if self.batched else values[0])
            found = list(found) if self.batched else [found]
            if len(found) != len(values):
                raise ValueError(f"{len(found)} answers to {len(values)} values")
        except Exception as e:  # noqa: BLE001 -- one bad call must not fail the job
            if len(items) > 1:
                half = len(items) // 2
                work.extendleft([(0.0, attempt, items[half:]), (0.0, attempt, items[:half])])
                return
            found = [e]
        again = []
        for (place, value), answer in zip(items, found):
            if not isinstance(answer, Exception):
                done(place, answer, None)
            elif attempt < self.policy.attempts and self.policy.may_pass(answer):
                again.append((place, value))
            else:
                done(place, None, answer)
        if again:
            work.append((time.monotonic() + self.policy.wait(attempt), attempt + 1, again))

    async def _attempt(self, arg):
        limit = self.policy.timeout
        try:
            if self.coroutines:
                return await asyncio.wait_for(self.call(self.shared, arg), limit)
            return await self._in_thread(arg, limit)
        except asyncio.TimeoutError as e:
            if str(e):
                raise
            raise TimeoutError(f"no answer in {limit:g} s") from None

    async def _in_thread(self, arg, limit: float | None):
        self.hung = {t for t in self.hung if t.is_alive()}
        if len(self.hung) >= self.policy.hung_calls:
            error = TimeoutError(f"not called: {len(self.hung)} earlier calls have not ended")
            error.retryable = False
            raise error
        loop, ended = self.loop, self.loop.create_future()

        def settle(answer) -> None:
            if not ended.done():
                ended.set_result(answer)

        def work() -> None:
            client = None
            try:
                client = self.clients.pop() if self.clients else self.make_client()
                answer = client, self.call(client, arg), None
            except Exception as e:  # noqa: BLE001 -- raised where it is awaited
                answer = client, None, e
            try:
                loop.call_soon_threadsafe(settle, answer)
            except RuntimeError:
                pass  # the task has ended

        thread = self.idle.pop() if self.idle else _Thread()
        thread.work.put(work)
        try:
            client, answer, error = await asyncio.wait_for(asyncio.shield(ended), limit)
        except asyncio.TimeoutError:
            thread.work.put(None)  # it ends with this call
            self.hung.add(thread)
            raise
        self.idle.append(thread)
        if client is not None:
            self.clients.append(client)
        if error is not None:
            raise error
        return answer
