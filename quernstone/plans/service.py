"""The task service: searches and reads under a ledger that survives the driver.

The ledger's file is a log of its calls, one JSON line each, synced before a call returns; opening it replays them. One process at a
time holds it. A call that was admitted but never settled counts as uncertain after a restart: its whole reservation is spent.
"""

from __future__ import annotations

import fcntl
import json
import os
from collections.abc import Sequence
from pathlib import Path

from quernstone.operators.ledger import Call, Ledger, LedgerError, Task
from quernstone.plans import query as requests
from quernstone.plans.retrieval import MAX_TOKENS, PUBLIC, Retrieval, RetrievalError, counted, encoded

MAX_LOG, MAX_DETAILS, MAX_RESPONSE = 256 << 20, 4096, 65_536


class DurableLedger:
    """A Ledger whose changes are appended to a file."""

    def __init__(self, path: str | Path, ledger: Ledger | None = None, max_bytes: int = MAX_LOG):
        self.ledger, self.max_bytes = ledger or Ledger(), max_bytes
        self.file = open(path, "a+b")  # noqa: SIM115
        os.chmod(path, 0o600)
        try:
            fcntl.flock(self.file, fcntl.LOCK_EX | fcntl.LOCK_NB)
        except OSError as e:
            self.file.close()
            raise LedgerError("ledger_busy") from e
        self._replay()

    def _replay(self) -> None:
        self.file.seek(0)
        raw = self.file.read()
        whole = raw[: raw.rfind(b"\n") + 1]  # a line that a crash cut off was never promised
        self.file.truncate(len(whole))
        for line in whole.splitlines():
            kind, *x = json.loads(line)
            if kind == "task":
                self.ledger.tasks[x[0]] = Task(*x)
            elif kind == "call":
                self.ledger.tasks[x[0]].calls.append(Call(*x[1:]))
            elif kind == "settled":
                call = next(c for c in self.ledger.tasks[x[0]].calls if c.call_id == x[1])
                call.state, call.used, call.items = x[2], x[3], tuple(x[4])
            else:
                self.ledger.tasks[x[0]].state = "closed"
        for task in self.ledger.tasks.values():
            for call in task.calls:
                if call.state == "pending":
                    self.settle(task.task_id, task.owner, call.call_id, "uncertain")

    def _write(self, *event: object) -> None:
        line = json.dumps(event, ensure_ascii=False).encode() + b"\n"
        if self.file.seek(0, os.SEEK_END) + len(line) > self.max_bytes:
            raise LedgerError("capacity")
        self.file.write(line)
        self.file.flush()
        os.fsync(self.file.fileno())

    def create(self, owner: str, index_id: str) -> str:
        task_id = self.ledger.create(owner, index_id)
        t = self.ledger.tasks[task_id]
        try:
            self._write("task", t.task_id, t.owner, t.index_id, t.created, t.limits)
        except LedgerError:
            del self.ledger.tasks[task_id]
            raise
        return task_id

    def admit(self, kind: str, task_id: str, owner: str, index_id: str, *what: object) -> str:
        call_id = {"search": self.ledger.admit_search, "read": self.ledger.admit_read}[kind](task_id, owner, index_id, *what)
        call = self.ledger.tasks[task_id].calls[-1]
        try:
            self._write("call", task_id, call.call_id, call.kind, call.key, call.reserved)
        except LedgerError:
            self.ledger.tasks[task_id].calls.pop()
            raise
        return call_id

    def settle(self, task_id: str, owner: str, call_id: str, state: str, used: int = 0, items: Sequence[str] = ()) -> None:
        self.ledger.settle(task_id, owner, call_id, state, used, items)
        call = next(c for c in self.ledger.tasks[task_id].calls if c.call_id == call_id)
        self._write("settled", task_id, call_id, call.state, call.used, list(call.items))

    def close_task(self, task_id: str, owner: str) -> None:
        self.ledger._task(task_id, owner).state = "closed"
        self._write("closed", task_id)

    def health(self) -> dict:
        tasks = self.ledger.tasks.values()
        size = self.file.seek(0, os.SEEK_END)
        return {"tasks": len(tasks), "open": sum(t.state == "open" for t in tasks), "log_bytes": size, "accepts": len(tasks) < self.ledger.capacity and size < self.max_bytes}

    def close(self) -> None:
        self.file.close()


def checked(response: dict) -> dict:
    """A response of the retrieval API, if it keeps its promises: known fields, different items, ranks in order, complete bundles."""
    items = response["results"] if "results" in response else response["items"]
    found = "results" in response
    ids = [x["metadata"]["item_id"] for x in items]
    fields = {"metadata", "bundle_key", "rank", "snippet", "truncated_before", "truncated_after"} if found else {"metadata", "body", "is_truncated"}
    top = {"index_id", "results", "is_truncated", "usage"} if found else {"seed_item_id", "bundle_key", "bundle_status", "membership_complete", "missing_item_ids", "items", "usage"}
    rules = {
        "fields": set(response) == top and all(set(x) == fields and set(x["metadata"]) == set(PUBLIC) for x in items),
        "different items": len(set(ids)) == len(ids),
        "ranks": not found or [x["rank"] for x in items] == list(range(1, len(items) + 1)),
        "scopes": all(x["metadata"]["scope"] in requests.SCOPES for x in items),
        "roles": all((x["metadata"]["role"] in ("human", "assistant")) == (x["metadata"]["scope"] == "conversation") for x in items),
        "members": found or response["seed_item_id"] in ids and not set(ids) & set(response["missing_item_ids"]) and (response["bundle_status"] == "complete") == (not response["missing_item_ids"]),
    }
    broken = [name for name, holds in rules.items() if not holds]
    if broken:
        raise RetrievalError("index_damaged", f"a response breaks its rules: {', '.join(broken)}")
    return response


class TaskService:
    """Retrieval for tasks: each call is admitted, run, checked and settled."""

    def __init__(self, retrieval: Retrieval, ledger: DurableLedger):
        self.retrieval, self.ledger = retrieval, ledger

    @property
    def index_id(self) -> str:
        return self.retrieval.index.index_id

    def begin(self, owner: str) -> str:
        return self.ledger.create(owner, self.index_id)

    def _run(self, kind: str, task_id: str, owner: str, what: tuple, tokens: int, call) -> dict:
        call_id = self.ledger.admit(kind, task_id, owner, self.index_id, *what, tokens)
        try:
            out = checked(call())
        except (RetrievalError, requests.QueryError):
            self.ledger.settle(task_id, owner, call_id, "failed")
            raise
        except BaseException:
            self.ledger.settle(task_id, owner, call_id, "uncertain")
            raise
        items = [x["metadata"]["item_id"] for x in (out["results"] if kind == "search" else out["items"])]
        self.ledger.settle(task_id, owner, call_id, "succeeded", out["usage"]["estimated_evidence_tokens"], items)
        return out

    def search(self, task_id: str, owner: str, queries: Sequence[object], scopes: Sequence[str] = requests.SCOPES, limit: int = requests.DEFAULT_RESULTS, max_tokens: int = MAX_TOKENS) -> dict:
        compiled, scopes, _ = requests.request(queries, scopes, limit)
        return self._run("search", task_id, owner, ([q.key for q in compiled], scopes), max_tokens, lambda: self.retrieval.search(queries, scopes, limit, max_tokens))

    def read(self, task_id: str, owner: str, item_id: str, max_tokens: int = MAX_TOKENS) -> dict:
        return self._run("read", task_id, owner, (item_id,), max_tokens, lambda: self.retrieval.read_bundle(item_id, self.index_id, max_tokens))

    def details(self, task_id: str, owner: str) -> dict:
        """A task's calls and cited items, the latest first, as many of either in turn as fit MAX_RESPONSE bytes; both lists hold MAX_DETAILS at most."""
        task = self.ledger.ledger._task(task_id, owner)
        calls = [{"call_id": c.call_id, "sequence": n, "kind": c.kind, "state": c.state, "used": c.used} for n, c in enumerate(task.calls, 1)][::-1]
        last: dict[str, int] = {i: n for n, c in enumerate(task.calls, 1) for i in c.items}
        cited = [{"item_id": i, "last_sequence": n} for i, n in sorted(last.items(), key=lambda x: (-x[1], x[0]))]
        full = {"calls": calls[:MAX_DETAILS], "items": cited[:MAX_DETAILS]}
        used = sum(c.used if c.state != "pending" else c.reserved for c in task.calls)
        out = {"task_id": task_id, "state": task.state, "used_tokens": used, "limits": task.limits, "calls": [], "items": [], "is_truncated": False, "usage": {"estimated_evidence_tokens": 0}}
        size, order = len(encoded(out)) + 64, [(k, i) for i in range(MAX_DETAILS) for k in full if i < len(full[k])]
        for kind, i in order:
            size += len(encoded(full[kind][i])) + 1
            if size > MAX_RESPONSE:
                break
            out[kind].append(full[kind][i])
        out["is_truncated"] = len(out["calls"]) < len(calls) or len(out["items"]) < len(cited)
        return counted(out)
