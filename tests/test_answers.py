"""Calls in flight, and answers kept between runs."""

import json
import threading
import time

import pytest
from pyspark.sql import functions as F

from quire.functions import taxonomy as tx
from quire.operators import answers, model, rules


def test_order_and_bound_of_the_window():
    lock, running, most = threading.Lock(), 0, 0

    def call(i):
        nonlocal running, most
        with lock:
            running += 1
            most = max(most, running)
        time.sleep(0.01 * (i % 3))
        with lock:
            running -= 1
        return i * i

    assert list(answers.in_order(call, range(40), 5)) == [i * i for i in range(40)] and 2 <= most <= 5
    assert list(answers.in_order(call, [], 5)) == []
    with pytest.raises(ValueError):
        next(answers.in_order(call, [1], 0))


def test_window_takes_no_more_than_it_holds():
    taken = []

    def given():
        for i in range(100):
            taken.append(i)
            yield i

    window = answers.in_order(lambda i: i, given(), 4)
    assert next(window) == 0 and len(taken) == 5
    window.close()
    assert len(taken) == 5


def test_an_error_cancels_what_has_not_begun():
    began = []

    def call(i):
        began.append(i)
        time.sleep(0.05)
        if i == 0:
            raise OSError("x")
        return i

    with pytest.raises(OSError):
        list(answers.in_order(call, range(100), 2))
    time.sleep(0.2)
    assert len(began) <= 4


class Slow:
    model = "slow-1"

    def __init__(self, path, delay=0.05, fail=""):
        self.path, self.delay, self.fail = str(path), delay, fail

    def ask(self, state, questions):
        time.sleep(self.delay)
        with open(self.path, "a") as f:
            f.write(json.dumps(state, sort_keys=True) + "\n")
        if self.fail and self.fail in json.dumps(state):
            raise OSError("down")
        p = {o: 0.97 if o == "receipt" else 0.03 / 16 for o in tx.MODEL_OUTCOMES}
        return {"answers": {"document": {"choice": "receipt", "confidence": 0.97, "probabilities": p}}, "inputTokens": 3}


def calls(path):
    return path.read_text().splitlines() if path.exists() else []


def test_a_task_keeps_several_calls_going(spark, tmp_path):
    states = spark.createDataFrame([(f"k{i}", json.dumps({"i": i})) for i in range(120)], "key string, state string").coalesce(1)
    took = {}
    for n in (1, 12):
        began = time.perf_counter()
        got = model.ask_pages(states, Slow(tmp_path / f"c{n}"), in_flight=n).collect()
        took[n] = time.perf_counter() - began
        assert len(got) == 120 and all(r.answered for r in got) and len(calls(tmp_path / f"c{n}")) == len(set(calls(tmp_path / f"c{n}"))) == 120
    assert took[1] > 6 > 3 > took[12] - 1


def test_a_second_run_asks_only_for_new_states(spark, tmp_path):
    table = answers.AnswerTable(spark, f"file:{tmp_path}/answers")
    assert table.generations() == [] and table.read().count() == 0
    frame = lambda rows: spark.createDataFrame(rows, "key string, state string")
    first = frame([("a", '{"t": 1}'), ("b", '{"t": 2}'), ("c", '{"t": 2}'), ("d", '{"t": 9}'), ("d", '{"t": 9}')])
    log = tmp_path / "calls"
    got = {r.key: r for r in model.ask_pages(first, Slow(log, 0, fail='"t": 9'), table=table).collect()}
    assert len(calls(log)) == 3 and got["a"].answered and got["b"].choice == got["c"].choice == "receipt" and not got["d"].answered
    second = frame([("a", '{"t": 1}'), ("x", '{"t": 2}'), ("d", '{"t": 9}'), ("e", '{"t": 3}')])
    got = {r.key: r for r in model.ask_pages(second, Slow(log, 0), table=table).collect()}
    assert [json.loads(c)["t"] for c in sorted(calls(log)[3:])] == [3, 9] and all(r.answered and r.input_tokens == 3 for r in got.values())
    # another model and another question know nothing of it
    model.ask_pages(first, Slow(log, 0), table=table, model_name="slow-2").collect()
    assert len(calls(log)) == 8
    before = sorted(map(repr, table.read().collect()))
    table.append(table.read())
    assert table.read().count() == 2 * len(before)
    table.compact()
    assert table.generations() == [0, 1] and sorted(map(repr, table.read().collect())) == before
    table.vacuum()
    assert table.generations() == [1] and sorted(map(repr, table.read().collect())) == before
    model.ask_pages(second, Slow(log, 0), table=table).collect()
    assert len(calls(log)) == 8


def test_pages_through_the_table(spark, tmp_path):
    rows = [("d", 1, "Hello there", "native", None, None, None), ("e", 1, "Hello there", "native", None, None, None), ("e", 2, "Hello there", "native", None, None, None)]
    pages = rules.classify(spark.createDataFrame(rows, rules.PAGE_SCHEMA))
    log, table = tmp_path / "calls", answers.AnswerTable(spark, str(tmp_path / "answers"))
    for _ in range(2):
        out = model.classify_with_model(pages, Slow(log, 0), allow=True, table=table, in_flight=3)
        assert {(r.documentType, r.calls) for r in out.select("documentType", "calls").collect()} == {("receipt", 1)}
    assert len(calls(log)) == 2  # a page's number is shown beside its text
    assert table.read().select(F.count_distinct("state_sha256")).first()[0] == 2


def test_quick_calls_are_handed_over_in_groups(monkeypatch):
    handed = []

    class Pool(answers.ThreadPoolExecutor):
        def submit(self, f, *given):
            handed.append(given)
            return super().submit(f, *given)

    monkeypatch.setattr(answers, "ThreadPoolExecutor", Pool)
    assert list(answers.in_order(lambda i: -i, range(20_000), 4)) == [-i for i in range(20_000)] and len(handed) < 2000

    def call(i):
        if i == 5000:
            raise OSError("x")
        return i

    window, got = answers.in_order(call, range(20_000), 4), []
    with pytest.raises(OSError):
        for i in window:
            got.append(i)
    assert got == list(range(5000))  # what was answered before the error is given, also within its group
    handed.clear()
    assert len(list(answers.in_order(lambda i: time.sleep(0.002), range(50), 4))) == len(handed) == 50  # slow calls stay single
