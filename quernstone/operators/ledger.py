"""The usage ledger: tasks, calls and cited items under limits. One writer on the driver; reports are DataFrames.

A task has limits on searches, reads and tokens. A call is admitted (its budget reserved), then settled once. A read's
seed must come from a successful search of the same task, and is read once; equal searches aren't run twice.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CALLS = "task_id string, call_id string, sequence int, kind string, state string, reserved long, used long, n_items int"
CITED = "task_id string, call_id string, item_id string, sequence int"


class LedgerError(ValueError):
    def __init__(self, code: str):
        super().__init__(code)
        self.code = code


@dataclass
class Call:
    call_id: str
    kind: str
    key: str
    reserved: int
    state: str = "pending"
    used: int = 0
    items: tuple[str, ...] = ()


@dataclass
class Task:
    task_id: str
    owner: str
    index_id: str
    created: str
    limits: dict[str, int]
    state: str = "open"
    calls: list[Call] = field(default_factory=list)


@dataclass
class Ledger:
    max_searches: int = 16
    max_reads: int = 32
    max_tokens: int = 64_000
    capacity: int = 10_000
    clock: Callable[[], str] = lambda: datetime.now(UTC).isoformat()
    new_id: Callable[[], str] = lambda: uuid.uuid4().hex
    tasks: dict[str, Task] = field(default_factory=dict)

    def create(self, owner: str, index_id: str) -> str:
        if len(self.tasks) >= self.capacity:
            raise LedgerError("capacity")
        task = Task("tsk_" + self.new_id(), owner, index_id, self.clock(), {"search": self.max_searches, "read": self.max_reads, "tokens": self.max_tokens})
        self.tasks[task.task_id] = task
        return task.task_id

    def _task(self, task_id: str, owner: str) -> Task:
        task = self.tasks.get(task_id)
        if task is None or task.owner != owner:
            raise LedgerError("task_not_found")
        return task

    def _admit(self, task_id: str, owner: str, index_id: str, kind: str, key: str, tokens: int) -> Call:
        task = self._task(task_id, owner)
        checks = (
            (task.state != "open", "task_closed"),
            (any(c.state == "pending" for c in task.calls), "task_busy"),
            (task.index_id != index_id, "index_mismatch"),
            (any(c.kind == kind and c.key == key and c.state == "succeeded" for c in task.calls), f"duplicate_{kind}"),
            (sum(c.kind == kind for c in task.calls) >= task.limits[kind], f"{kind}_limit"),
            (sum(c.used for c in task.calls) + tokens > task.limits["tokens"], "token_limit"),
        )
        for bad, code in checks:
            if bad:
                raise LedgerError(code)
        task.calls.append(Call("cal_" + self.new_id(), kind, key, tokens))
        return task.calls[-1]

    def admit_search(self, task_id: str, owner: str, index_id: str, keys: Sequence[str], scopes: Sequence[str], tokens: int) -> str:
        return self._admit(task_id, owner, index_id, "search", repr((sorted(keys), sorted(scopes))), tokens).call_id

    def admit_read(self, task_id: str, owner: str, index_id: str, seed: str, tokens: int) -> str:
        if not any(c.kind == "search" and c.state == "succeeded" and seed in c.items for c in self._task(task_id, owner).calls):
            raise LedgerError("seed_not_found")
        return self._admit(task_id, owner, index_id, "read", seed, tokens).call_id

    def settle(self, task_id: str, owner: str, call_id: str, state: str, used: int = 0, items: Sequence[str] = ()) -> None:
        """state: succeeded, failed, or uncertain, which keeps the whole reservation."""
        call = next((c for c in self._task(task_id, owner).calls if c.call_id == call_id), None)
        if call is None or call.state != "pending" or state not in ("succeeded", "failed", "uncertain"):
            raise LedgerError("call_not_pending")
        call.state, call.items = state, tuple(items) if state == "succeeded" else ()
        call.used = {"succeeded": min(used, call.reserved), "failed": 0, "uncertain": call.reserved}[state]

    def frames(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        """(calls, cited items) of all tasks; their number is bounded by the capacity and the limits."""
        calls, cited = [], []
        for t in self.tasks.values():
            for n, c in enumerate(t.calls, 1):
                calls.append((t.task_id, c.call_id, n, c.kind, c.state, c.reserved, c.used, len(c.items)))
                cited += [(t.task_id, c.call_id, i, n) for i in c.items]
        return spark.createDataFrame(calls, CALLS), spark.createDataFrame(cited, CITED)


def summary(calls: DataFrame) -> DataFrame:
    """Counts and used tokens of each task in one pass."""
    return calls.groupBy("task_id").agg(
        F.count_if(F.col("kind") == "search").alias("searches"),
        F.count_if(F.col("kind") == "read").alias("reads"),
        F.count_if(F.col("state") == "failed").alias("failed"),
        F.count_if(F.col("state") == "uncertain").alias("uncertain"),
        F.sum("used").alias("used"),
        F.sum(F.when(F.col("state") == "pending", F.col("reserved")).otherwise(0)).alias("reserved"),
    )


def last_seen(cited: DataFrame) -> DataFrame:
    """(task_id, item_id, last_sequence, calls)."""
    return cited.groupBy("task_id", "item_id").agg(F.max("sequence").alias("last_sequence"), F.count_distinct("call_id").alias("calls"))


def latest(rows: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """The last n rows of each group (a report's limit), with `back`, 1 for the last."""
    return rows.withColumn("back", F.row_number().over(W.partitionBy(group).orderBy(F.desc(order)))).where(F.col("back") <= n)


def citations(calls: DataFrame, cited: DataFrame) -> DataFrame:
    """(task_id, item_id, searches, reads, was_read): calls that cite an item, by kind, and whether a read that succeeded began at it.

    calls has seed, the item that a read begins at."""
    kinds = cited.join(calls.where("state = 'succeeded'").select("task_id", "call_id", "kind"), ["task_id", "call_id"])
    counts = kinds.groupBy("task_id", "item_id").agg(F.count_if(F.col("kind") == "search").alias("searches"), F.count_if(F.col("kind") == "read").alias("reads"))
    seeds = calls.where("kind = 'read' AND state = 'succeeded'").select("task_id", F.col("seed").alias("item_id"), F.lit(True).alias("was_read")).distinct()
    return counts.join(seeds, ["task_id", "item_id"], "left").withColumn("was_read", F.coalesce("was_read", F.lit(False)))


def health(tasks: DataFrame, capacity: int) -> DataFrame:
    """One row: tasks, open tasks, and whether a new one would be taken. tasks: (task_id, state)."""
    return tasks.agg(F.count(F.lit(1)).alias("tasks"), F.count_if(F.col("state") == "open").alias("open")).withColumn("accepts", F.col("tasks") < capacity)
