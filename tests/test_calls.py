"""Judge calls side by side: overlap, order, deadlines, growing waits, failures as data."""

import asyncio
import threading
import time

from textloom.operators import judging
from textloom.operators.judging import Calls


class Slow:
    def __init__(self, seconds=0.1):
        self.seconds, self.now, self.most, self.lock = seconds, 0, 0, threading.Lock()

    def __call__(self, prompt):
        with self.lock:
            self.now += 1
            self.most = max(self.most, self.now)
        time.sleep(self.seconds)
        with self.lock:
            self.now -= 1
        return prompt.upper()


def run(model, prompts, **how):
    began = time.monotonic()
    return asyncio.run(judging.answers(model, prompts, Calls(**how))), time.monotonic() - began


def test_calls_overlap_and_keep_their_order():
    prompts = [f"p{i}" for i in range(40)]
    model = Slow()
    got, took = run(model, prompts, together=10)
    assert got == [p.upper() for p in prompts] and 1 < model.most <= 10 and took < 2.5
    alone = Slow(0.02)
    assert run(alone, prompts)[0] == got and alone.most == 1


def test_deadline_leaves_a_slow_call_behind():
    model = lambda p: time.sleep(30 if p == "slow" else 0) or p
    got, took = run(model, ["a", "slow", "b"], together=2, deadline=0.3, retries=1)
    assert got == ["a", "ERROR: no answer within 0.3 s", "b"] and took < 5


def test_waits_grow_and_failures_are_data():
    seen = []

    def model(p):
        seen.append((p, time.monotonic()))
        if p == "never" or sum(q == p for q, _ in seen) < 3:
            raise ValueError("busy")
        return "ok"

    got, _ = run(model, ["x", "never"], together=2, retries=2, wait=0.2)
    assert got == ["ok", "ERROR: busy"]
    at = [t for p, t in seen if p == "x"]
    assert at[1] - at[0] >= 0.2 and at[2] - at[1] >= 0.4 and len(at) == 3
    assert run(lambda p: 1 / 0, ["a"], retries=0)[0] == ["ERROR: division by zero"]


def test_coroutines():
    async def model(p):
        await asyncio.sleep(0.2)
        return p

    got, took = run(model, [str(i) for i in range(20)], together=20)
    assert got == [str(i) for i in range(20)] and took < 2
    assert run(model, ["a"], deadline=0.01, retries=0)[0] == ["ERROR: no answer within 0.01 s"]


def judge():
    model = Slow(0.1)
    return lambda p: f"{model(p)} {model.most}"


def test_in_tasks(spark):
    df = spark.range(60).selectExpr("id", "concat('p', id) as prompt").coalesce(1)
    rows = judging.ask(df, judge, calls=Calls(together=12)).collect()
    assert [r.id for r in rows] == list(range(60)) and all(r.raw.startswith(f"P{r.id} ") for r in rows)
    assert 1 < max(int(r.raw.split()[1]) for r in rows) <= 12
