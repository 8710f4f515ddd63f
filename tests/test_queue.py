"""The work queue: folded tables against a plain loop, streams with late rows and restarts against the fold."""

from __future__ import annotations

import datetime
import random

import pytest
from pyspark.sql import functions as F

from quillgraph.streaming import queue

SCHEMA = "task_id LONG, seq LONG, at TIMESTAMP, action STRING, priority INT, depth INT"
BASE = datetime.datetime(2024, 1, 1)


def at(seconds: float) -> datetime.datetime:
    return BASE + datetime.timedelta(seconds=seconds)


def last(spark, rows, rules=queue.Rules(), now=None):
    found = queue.states(queue.changes(spark.createDataFrame(rows, SCHEMA), rules, now))
    return {r["task_id"]: (r["status"], r["tries"], r["priority"], r["depth"]) for r in found.collect()}


def test_actions(spark):
    log = [
        (1, 0, at(0), "enqueue", 50, 1), (1, 1, at(1), "enqueue", 70, 2), (1, 2, at(2), "claim", None, None), (1, 3, at(3), "enqueue", 900, 9),
        (2, 0, at(0), "enqueue", 50, 0), *[(2, 2 * i + j + 1, at(2 * i + j + 1), a, None, None) for i in range(3) for j, a in enumerate(["claim", "fail"])], (2, 8, at(9), "claim", None, None),
        (3, 0, at(0), "claim", None, None), (3, 1, at(1), "enqueue", None, None), (3, 2, at(2), "retry", None, None), (3, 3, at(3), "priority", 1000, None), (3, 4, at(4), "retry", None, None),
        (4, 0, at(0), "fail", None, None), (None, 1, at(0), "enqueue", 1, 1), (5, None, at(0), "enqueue", 1, 1), (6, 1, None, "enqueue", 1, 1), (7, 1, at(0), None, 1, 1),
    ]
    assert last(spark, log) == {1: ("processing", 0, 70, 2), 2: ("failed", 3, 50, 0), 3: ("pending", 0, 1000, 0)}
    assert last(spark, []) == {}
    # a row that comes twice changes nothing further
    assert last(spark, [r for r in log if r[0] == 1] * 2)[1] == ("processing", 0, 70, 2)


def test_waiting_and_forgetting(spark):
    rules = queue.Rules(wait=60, keep=100)
    log = [(1, 0, at(0), "enqueue", 5, 0), (1, 1, at(1), "claim", None, None), (1, 2, at(2), "fail", None, None), (1, 3, at(61), "claim", None, None)]
    assert last(spark, log, rules)[1] == ("waiting", 1, 5, 0)
    assert last(spark, log, rules, F.lit(at(62)))[1] == ("pending", 1, 5, 0)
    assert last(spark, [*log, (1, 4, at(62), "claim", None, None)], rules)[1] == ("processing", 1, 5, 0)
    done = [*log, (1, 4, at(62), "claim", None, None), (1, 5, at(63), "done", None, None)]
    assert last(spark, [*done, (1, 6, at(162), "enqueue", 8, 0)], rules)[1] == ("done", 1, 5, 0)
    assert last(spark, [*done, (1, 6, at(163), "enqueue", 8, 0)], rules)[1] == ("pending", 0, 8, 0)
    assert last(spark, done, rules, F.lit(at(163))) == {}


def test_next(spark):
    rows = [(1, "pending", 5), (2, "pending", 9), (3, "done", 99), (4, "pending", 9)]
    got = queue.next_tasks(spark.createDataFrame(rows, "task_id LONG, status STRING, priority INT"), 2).collect()
    assert [r["task_id"] for r in got] == [2, 4]


@pytest.mark.parametrize("seed", [0, 1])
def test_stream_is_the_fold(spark, tmp_path, seed):
    """Files arrive out of order by less than the watermark; the query stops and goes on from its checkpoint half way."""
    rng = random.Random(seed)
    log = [(rng.randrange(8), i, at(i * 7 + rng.random()), rng.choice(["enqueue", "claim", "claim", "fail", "done", "retry"]), rng.randrange(100), i % 3) for i in range(400)]
    end = (99, 10_000, at(1_000_000), "enqueue", 1, 0)
    order = sorted(log, key=lambda r: r[1] + rng.random() * 40)  # 40 actions are 280 seconds
    parts = [order[:120], order[120:250], order[250:], [end]]
    rules = queue.Rules(wait=45, keep=90)
    folder, checkpoint, out = (str(tmp_path / x) for x in ("in", "checkpoint", "out"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for part in parts:
            spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
            found = queue.change_stream(spark.readStream.schema(SCHEMA).parquet(folder), rules, "300 seconds")
            q = found.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
            q.awaitTermination(120)
            assert q.exception() is None
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = sorted(tuple(r) for r in spark.read.schema(queue.CHANGE).parquet(out).collect())
    want = sorted(tuple(r) for r in queue.changes(spark.createDataFrame(log, SCHEMA), rules, F.lit(at(900_000))).collect())
    assert [g[:3] + g[4:] for g in got] == [w[:3] + w[4:] for w in want] and [g[3] for g in got] == [w[3] for w in want]
    assert len(want) > 100
