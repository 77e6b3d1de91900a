"""Asking models: a window of calls in flight in every task, and a table of answers that outlives a run."""

from __future__ import annotations

import hashlib
import json
import threading
import time
import uuid
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import written

#: Calls in flight in one task.
IN_FLIGHT = 12
#: Calls of under QUICK_S seconds are handed to a thread in groups of up to GROUP, as handing one over takes longer than the call.
QUICK_S, GROUP = 0.001, 128
A, B = TypeVar("A"), TypeVar("B")


def in_order(call: Callable[[A], B], given: Iterable[A], in_flight: int = IN_FLIGHT) -> Iterator[B]:
    """``call`` of each, in order, with at most ``in_flight`` running or waiting to be taken. A call's own retries and pauses hold up no
    other thread. Where calls return at once, a thread takes a group of them, one after another; after a slow one, groups are of one call
    again. An error ends the window: calls that have not begun are cancelled; so does the reader when it stops early."""
    if in_flight < 1:
        raise ValueError("in_flight must be positive")
    pool = ThreadPoolExecutor(max_workers=in_flight)
    window: deque[Future[tuple[list[B], BaseException | None, float]]] = deque()
    stopped = threading.Event()

    def several(items: list[A]) -> tuple[list[B], BaseException | None, float]:
        began, out = time.perf_counter(), []
        for item in items:
            if stopped.is_set():
                break
            try:
                out.append(call(item))
            except BaseException as error:  # noqa: BLE001 - raised by the reader, after the group's earlier answers
                return out, error, 0.0
        return out, None, (time.perf_counter() - began) / len(items)

    size, group = 1, []
    try:
        for item in given:
            group.append(item)
            if len(group) < size:
                continue
            if len(window) == in_flight:
                done, error, each = window.popleft().result()
                yield from done
                if error is not None:
                    raise error
                size = min(2 * size, GROUP) if each < QUICK_S else 1
            window.append(pool.submit(several, group))
            group = []
        if group:
            window.append(pool.submit(several, group))
        while window:
            done, error, _ = window.popleft().result()
            yield from done
            if error is not None:
                raise error
    finally:
        stopped.set()
        pool.shutdown(wait=False, cancel_futures=True)


def digest(value: object) -> str:
    return hashlib.sha256(json.dumps(value, sort_keys=True, ensure_ascii=True).encode()).hexdigest()


class AnswerTable:
    """Answers kept between runs, in Parquet: one a (state, question, model), where the state is what a model is shown.

    Every append is a folder of its own in the newest generation, so a frame that was read earlier keeps its files, and two reads of
    different states of the table are never taken for the same scan. A failed call leaves no answer, so it is asked again in a later
    run. ``compact`` writes a new generation of few files with each answer once, which counts from the moment that it is whole; older
    ones are dropped by ``vacuum``. Readers may run at any time; one run at a time may append or compact.
    """

    SCHEMA = "state_sha256 string, question_sha256 string, model string, body string, input_tokens bigint, truncated boolean"
    KEY = ("state_sha256", "question_sha256", "model")

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _whole(self) -> dict[int, list[str]]:
        """The finished appends of each generation."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path
        root = hadoop(self.path)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return {}
        found: dict[int, list[str]] = {}
        for status in fs.globStatus(hadoop(root, "gen-*/add-*/_SUCCESS")) or ():
            folder = status.getPath().getParent()
            found.setdefault(int(folder.getParent().getName()[4:]), []).append(folder.toString())
        return {g: sorted(found[g]) for g in sorted(found)}

    def generations(self) -> list[int]:
        """Whole generations, oldest first."""
        return list(self._whole())

    def _new(self, generation: int) -> str:
        return f"{self.path}/gen-{generation:06d}/add-{uuid.uuid4().hex}"

    def read(self) -> DataFrame:
        """All answers; a key may occur more than once until the next compaction."""
        held = self._whole()
        if not held:
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).parquet(*held[max(held)])

    def append(self, answers: DataFrame) -> None:
        held = self.generations()
        answers.select(*[c.split()[0] for c in self.SCHEMA.split(", ")]).write.parquet(self._new(held[-1] if held else 0))

    def compact(self, files: int = 1) -> None:
        held = self.generations()
        if held:
            once = self.read().groupBy(*self.KEY).agg(F.min(F.struct("body", "input_tokens", "truncated")).alias("a")).select(*self.KEY, "a.*")
            once.repartition(files, "state_sha256").write.parquet(self._new(held[-1] + 1))

    def vacuum(self) -> None:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path
        for generation in self.generations()[:-1]:
            folder = hadoop(f"{self.path}/gen-{generation:06d}")
            folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)

    def answer(self, states: DataFrame, model: str, questions: dict, ask: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """(key, answered, body, input_tokens, truncated) for rows (key, state): known states are looked up, each other one is asked
        once by ``ask`` (key, state to the same columns), whatever number of keys share it, and its answer is kept before it is used."""
        shown = F.sha2("state", 256)
        asked = digest(questions)
        wanted = states.dropDuplicates(["key"]).select("key", "state", shown.alias("state_sha256"))
        mine = (F.col("question_sha256") == asked) & (F.col("model") == model)
        known = self.read().where(mine).select("state_sha256")
        new = wanted.select("state_sha256", "state").join(known, "state_sha256", "left_anti").dropDuplicates(["state_sha256"])
        got = written(ask(new.select(F.col("state_sha256").alias("key"), "state")), "asked")
        kept = got.where("answered").select(F.col("key").alias("state_sha256"), F.lit(asked).alias("question_sha256"), F.lit(model).alias("model"), "body", "input_tokens", "truncated")
        if not kept.isEmpty():
            self.append(kept)
        held = self.read().where(mine).groupBy("state_sha256").agg(F.min(F.struct("body", "input_tokens", "truncated")).alias("a"))
        found = wanted.select("key", "state_sha256").join(held, "state_sha256", "left")
        return found.select("key", F.col("a").isNotNull().alias("answered"), "a.body", "a.input_tokens", "a.truncated")


