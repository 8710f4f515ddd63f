"""A work queue kept as a log of actions: the same steps fold a table of actions and run over a stream with timers.

A log holds task_id, seq, at (TIMESTAMP), action, priority and depth. Actions count as follows, all others not at all:

- ``enqueue`` makes a new task, or changes priority and depth of one that is pending or waiting;
- ``claim`` takes a pending task; ``done`` and ``fail`` tell of any known task how its processing ended;
- a failed task waits ``wait`` seconds and is pending again, until it has failed ``most_tries`` times: then it is failed;
- ``retry`` makes any known task pending with no failures, and lifts priorities below 1000 by 200;
- ``priority`` sets the priority of any known task; a task that is done is forgotten after ``keep`` seconds.

Rows without task_id, seq or at are left out; a missing priority is 100, a missing depth 0. Equal times are taken in the order
of seq, equal times and seqs in that of the action's name, priority and depth. Changes are numbered from 1 within a task, across forgetting.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ACTION = "us LONG, seq LONG, action STRING, priority INT, depth INT"
STATE = "status STRING, tries INT, priority INT, depth INT, due LONG, changes LONG"
CHANGE = "task_id LONG, n LONG, seq LONG, us LONG, status STRING, tries INT, priority INT, depth INT"


class Task(NamedTuple):
    status: str = ""
    tries: int = 0
    priority: int = 0
    depth: int = 0
    due: int | None = None
    changes: int = 0


@dataclass(frozen=True)
class Rules:
    most_tries: int = 3
    wait: float = 0.0
    keep: float | None = None

    def settled(self, t: Task, now: int) -> Task:
        """What has fallen due by ``now`` (microseconds): waiting tasks are pending again, old ones forgotten."""
        if t.due is None or t.due > now:
            return t
        return Task(changes=t.changes + 1) if t.status == "done" else t._replace(status="pending", due=None, changes=t.changes + 1)

    def stepped(self, t: Task, us: int, action: str | None, priority: int, depth: int) -> Task:
        new = t
        if action == "enqueue" and t.status in ("", "pending", "waiting"):
            new = t._replace(status=t.status or "pending", priority=priority, depth=depth)
        elif action == "claim" and t.status == "pending":
            new = t._replace(status="processing")
        elif action == "done" and t.status:
            new = t._replace(status="done", due=None if self.keep is None else us + int(self.keep * 1e6))
        elif action == "fail" and t.status:
            tries = t.tries + 1
            last, waits = tries >= self.most_tries, self.wait > 0
            new = t._replace(status="failed" if last else "waiting" if waits else "pending", tries=tries, due=us + int(self.wait * 1e6) if waits and not last else None)
        elif action == "retry" and t.status:
            new = t._replace(status="pending", tries=0, due=None, priority=t.priority + 200 if t.priority < 1000 else t.priority)
        elif action == "priority" and t.status:
            new = t._replace(priority=priority)
        return t if new == t else new._replace(changes=t.changes + 1)

    def run(self, key: int, t: Task, actions: list[tuple], now: int | None, out: list[tuple]) -> Task:
        """Take sorted actions, then what is due by ``now``; changes are appended to ``out``."""

        def note(new: Task, seq: int | None, us: int) -> Task:
            if new.changes > t.changes:
                out.append((key, new.changes, seq, us, new.status, new.tries, new.priority, new.depth))
            return new

        for us, seq, action, priority, depth in actions:
            t = note(self.settled(t, us), None, t.due)
            t = note(self.stepped(t, us, action, priority, depth), seq, us)
        return note(self.settled(t, now), None, t.due) if now is not None else t


def _actions(log: DataFrame) -> DataFrame:
    """The log's columns in their types, the time in microseconds beside it; rows that can't be placed are left out."""
    at = F.col("at").cast("timestamp")
    return log.where("task_id IS NOT NULL AND seq IS NOT NULL AND at IS NOT NULL").select(
        F.col("task_id").cast("long").alias("task_id"), at.alias("at"), F.unix_micros(at).alias("us"), F.col("seq").cast("long").alias("seq"), "action",
        F.coalesce(F.col("priority").cast("int"), F.lit(100)).alias("priority"), F.coalesce(F.col("depth").cast("int"), F.lit(0)).alias("depth"),
    )


def changes(log: DataFrame, rules: Rules = Rules(), now: Column | None = None) -> DataFrame:
    """(task_id, n, seq, us, status, tries, priority, depth): every change of every task, folded from a table of actions.

    ``now`` is a literal time up to which what is due falls due after the last action. Rows are sorted within partitions and
    read batch by batch; a task with a very long log needs no more memory than its state.
    """
    rows = _actions(log).drop("at").withColumn("now", F.lit(None).cast("long") if now is None else F.unix_micros(now))

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, task, until = None, Task(), None
        for frame in frames:
            out: list[tuple] = []
            until = None if pd.isna(frame["now"].iloc[0]) else int(frame["now"].iloc[0])
            for row in frame.drop(columns="now").itertuples(index=False, name=None):
                if row[0] != key:
                    if key is not None:
                        rules.run(key, task, [], until, out)
                    key, task = row[0], Task()
                task = rules.run(key, task, [row[1:]], None, out)
            yield _table(out)
        out = []
        if key is not None:
            rules.run(key, task, [], until, out)
        yield _table(out)

    order = rows.repartition("task_id").sortWithinPartitions("task_id", "us", "seq", "action", "priority", "depth")
    return order.select("task_id", "us", "seq", "action", "priority", "depth", "now").mapInPandas(fold, CHANGE)


def _table(out: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(out, columns=[c.split()[0] for c in CHANGE.split(", ")])
    return frame.assign(seq=frame["seq"].astype("Int64"))


class _Queue(StatefulProcessor):
    """Actions wait until the watermark has passed them, so that late ones within it are taken in their order."""

    def __init__(self, rules: Rules) -> None:
        self.rules = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.task = handle.getValueState("task", STATE)
        self.waiting = handle.getListState("waiting", ACTION)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        fresh = [(r["us"], r["seq"], r["action"], r["priority"], r["depth"]) for r in rows]
        self.waiting.appendList(fresh)
        for ms in {us // 1000 for us, *_ in fresh}:
            self.handle.registerTimer(ms)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        seen = timerValues.getCurrentWatermarkInMs() * 1000
        held = [tuple(r) for r in self.waiting.get()]
        ripe = sorted((a for a in held if a[0] < seen), key=lambda a: (a[0], a[1], a[2] or "", a[3], a[4]))
        kept = self.task.get() if self.task.exists() else None
        before, out = Task(*kept) if kept else Task(), []
        after = self.rules.run(key[0], before, ripe, seen - 1, out)
        if ripe:
            rest = [a for a in held if a[0] >= seen]
            self.waiting.put(rest) if rest else self.waiting.clear()
        if after != before:
            self.task.update(tuple(after))
        if after.due is not None and after.due != before.due:
            self.handle.registerTimer(after.due // 1000)
        return iter([Row(**dict(zip([c.split()[0] for c in CHANGE.split(", ")], o, strict=True))) for o in out])

    def close(self) -> None:
        pass


def change_stream(log: DataFrame, rules: Rules = Rules(), late: str = "10 minutes") -> DataFrame:
    """As ``changes`` over a stream: a change comes out once the watermark, ``late`` behind the latest action, has passed it.

    Retries and forgetting are timers in event time. The session needs the RocksDB state store
    (``spark.sql.streaming.stateStore.providerClass``); a query taken up from its checkpoint goes on where it stopped.
    """
    rows = _actions(log).withWatermark("at", late)
    return rows.groupBy("task_id").transformWithState(_Queue(rules), CHANGE, "Append", "EventTime")


def states(found: DataFrame) -> DataFrame:
    """(task_id, status, tries, priority, depth, changes): each task as its last change left it; forgotten ones are gone."""
    last = found.groupBy("task_id").agg(F.max_by(F.struct("status", "tries", "priority", "depth", F.col("n").alias("changes")), "n").alias("s"))
    return last.select("task_id", "s.*").where("status <> ''")


def next_tasks(tasks: DataFrame, workers: int) -> DataFrame:
    """(task_id, priority): what that many idle workers claim next: pending tasks, the highest priority first, then by id."""
    return tasks.where("status = 'pending'").select("task_id", "priority").orderBy(F.desc("priority"), "task_id").limit(workers)
