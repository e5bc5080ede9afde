"""A ledger walked event by event, and histories to walk: what the set-based fold is compared with."""

from __future__ import annotations

import json
import random

from tessera.operators.ledger_fold import JOURNALED, NEEDS, SAME_ATTEMPT, SAME_REQUEST
from tessera.operators.retry import CHECKPOINTS, RUN_MOVES, TASK_MOVES


class Bad(Exception):
    pass


def need(held, code):
    if not held:
        raise Bad(f"reducer.{code}")


class Walk:
    def __init__(self):
        self.seq, self.state, self.run, self.depth, self.blocker, self.stage, self.epoch, self.resuming = 0, None, None, None, None, None, 0, False
        self.reserved, self.tasks, self.owners, self.attempts, self.operations = set(), {}, {}, {}, {}
        self.transactions, self.schedules, self.starts, self.requests, self.by_seq, self.journal = {}, {}, {}, {}, {}, {}
        self.cancels, self.revisions, self.edges, self.request_starts, self.series, self.origin = {}, {}, {}, {}, {}, None
        self.error = self.error_seq = None

    def walk(self, events):
        for seq, kind, payload in events:
            try:
                need(seq == self.seq + 1, "sequence")
                need(kind in NEEDS, "unknown-type")
                for path in NEEDS[kind]:
                    x = payload
                    for part in path.split("."):
                        x = (x or {}).get(part)
                    need(x is not None, "payload")
                if hasattr(self, f"on_{kind}"):
                    getattr(self, f"on_{kind}")(seq, payload)
                self.seq = seq
            except Bad as e:
                self.error, self.error_seq = str(e), seq
                return self
        if self.origin:
            seq, run = self.origin
            ends = {"taskRefs": {t: v["revision"] for t, v in self.tasks.items()}, "attemptRefs": {a: v["r"].get("revision") for a, v in self.attempts.items()}}
            for kind, name in (("taskRefs", "taskId"), ("attemptRefs", "attemptId")):
                if any(ends[kind].get(x[name]) != x["revision"] for x in run.get(kind) or []) and not self.error:
                    self.error, self.error_seq = f"reducer.run-{kind[:-4]}-ref", seq
        return self

    def row(self):
        pending = [s for s in self.schedules.values() if not s["by"] and s["epoch"] not in self.cancels]
        ok = [r for r in self.requests.values() if r["status"] == "success"]
        return (self.seq, self.state, self.epoch, len(self.tasks), len(self.attempts), sum(a["phase"] == "committed" for a in self.attempts.values()), sum(t["late"] for t in self.transactions.values()),
                len(pending), len(self.requests), len(ok), len(self.revisions), self.error, self.error_seq)

    def has(self, kind, name):
        return (kind, name) in self.reserved

    def attempt(self, name):
        need(name in self.attempts, "attempt-not-found")
        return self.attempts[name]

    def note(self, p):
        told = self.journal.setdefault(p["attemptId"], [])
        need(not 1 <= p["journalLocalSeq"] <= len(told), "request-journal-position")
        need(p["journalEntrySha256"] not in told, "request-journal-hash")
        need(p["journalLocalSeq"] == len(told) + 1, "request-journal-sequence")
        told.append(p["journalEntrySha256"])

    def live(self, name):
        a = self.attempt(name)
        need(a["phase"] == "started" and a["failure"] is None, "request-target-state")
        t = self.tasks.get(a["r"]["taskId"])
        need(t and t["state"] == "running" and t["attemptIds"].count(name) == 1 and self.owners.get(name) == t["taskId"], "request-target-task")
        need(a["r"]["executionEpoch"] == self.epoch and self.epoch not in self.cancels, "request-target-epoch")
        return a

    def on_identity_reserved(self, seq, p):
        need(not self.has(p["kind"], p["id"]), "duplicate-reservation")
        self.reserved.add((p["kind"], p["id"]))

    def on_run_created(self, seq, p):
        r = p["run"]
        need(self.run is None, "duplicate-run")
        need(r.get("executionEpoch") == 0, "initial-epoch")
        need(r.get("state") == "created", "initial-run-state")
        self.run, self.state, self.depth, self.blocker, self.stage, self.origin = r["runId"], "created", r.get("depth"), r.get("blocker"), r.get("checkpointStage"), (seq, r)

    def on_state_changed(self, seq, p):
        to, at, blocker = p["to"], self.state, p.get("blocker")
        need(at is not None, "run-not-found")
        need(at not in ("completed", "cancelled"), "run-terminal")
        need(p["from"] == at, "run-state-from")
        need(to != "completed", "completion-event-required")
        fine = to in RUN_MOVES.get(at, ()) and (blocker is not None if to == "failed" else blocker is None or to == "paused")
        if (at, to) == ("researching", "synthesizing"):
            fine = fine and self.depth == "quick"
        if at == "recovering" and to in CHECKPOINTS:
            fine = fine and to == self.stage
        if (at, to) == ("failed", "recovering"):
            fine = fine and bool(self.blocker) and self.blocker["code"].startswith("retryable-")
        need(fine, "run-transition")
        reason = self.cancels.get(self.epoch, (0, None))[1]
        need(reason != "user-abandon" or to == "cancelled", "abandon-transition")
        need(reason in (None, "user-abandon") or to in ("paused", "cancelled") or self.resuming, "cancel-transition")
        need(((at, to) == ("paused", "recovering")) == self.resuming, "resume-transition")
        self.resuming, self.state, self.blocker = False, to, blocker
        self.stage = to if to in CHECKPOINTS else self.stage

    def on_task_upserted(self, seq, p):
        t = p["task"]
        old, ids = self.tasks.get(t["taskId"]), t["attemptIds"]
        need(t["revision"] == (old["revision"] if old else 0) + 1, "task-revision")
        if old:
            need(old["state"] not in ("resolved", "cancelled"), "task-terminal")
            need(t["state"] in TASK_MOVES.get(old["state"], ()), "task-transition")
            need(ids[: len(old["attemptIds"])] == old["attemptIds"], "task-attempt-history")
        need(len(set(ids)) == len(ids), "task-attempt-history")
        for a in ids:
            need(self.has("attempt", a), "task-attempt-not-reserved")
            need(self.owners.setdefault(a, t["taskId"]) == t["taskId"], "task-attempt-owner")
        if t["state"] == "resolved":
            done = any(a in self.attempts and self.attempts[a]["phase"] == "committed" and self.attempts[a]["r"]["taskId"] == t["taskId"] for a in ids)
            need(done and t.get("resolution") is not None, "task-resolution")
        self.tasks[t["taskId"]] = t

    def on_dispatch_intent(self, seq, p):
        r = p["attempt"]
        name, op = r["attemptId"], r["logicalOperationId"]
        need(not self.resuming, "resume-transition-pending")
        need(self.run is not None and r.get("runId") == self.run, "run-not-found")
        t = self.tasks.get(r["taskId"])
        need(t, "task-not-found")
        need(t["state"] == "running", "dispatch-task-state")
        need(t["attemptIds"].count(name) == 1 and self.owners.get(name) == r["taskId"], "dispatch-task-owner")
        need(self.has("attempt", name), "attempt-not-reserved")
        need(name not in self.attempts, "duplicate-attempt")
        need(r.get("state") == "intent-recorded", "attempt-initial-state")
        need(r.get("executionEpoch") == self.epoch and self.epoch not in self.cancels, "attempt-epoch")
        line = self.operations.setdefault(op, [])
        s = self.starts.get(name)
        like = lambda x: all(r.get(f) == x.get(f) for f in SAME_ATTEMPT)
        if s:
            base = self.attempts[self.operations[s["op"]][0]]["r"]
            need(op == s["op"] and r["attemptOrdinal"] == s["ordinal"] and r.get("retryOfAttemptId") == s["failed"] and r.get("replayPolicy") == "safe-read" and s["epoch"] == r["executionEpoch"] and like(base), "retry-dispatch-link")
        need(r["attemptOrdinal"] == len(line) + 1, "attempt-ordinal")
        need(r.get("retryOfAttemptId") == (line[-1] if line else None), "retry-backlink")
        if line:
            need(like(self.attempts[line[0]]["r"]), "retry-immutable")
            need(s, "retry-start-missing")
        self.attempts[name] = {"r": r, "phase": "intent", "failure": None, "result": None, "again": False}
        line.append(name)
        if s:
            self.attempts[s["failed"]]["again"] = True

    def on_dispatch_started(self, seq, p):
        a = self.attempt(p["attemptId"])
        need(a["phase"] == "intent", "attempt-transition")
        a["phase"] = "started"

    def on_attempt_usage_recorded(self, seq, p):
        self.attempt(p["attemptId"])

    def on_result_recorded(self, seq, p):
        a, t = self.attempt(p["attemptId"]), p["transactionId"]
        need(self.has("transaction", t), "transaction-not-reserved")
        need(t not in self.transactions, "duplicate-transaction")
        need(a["result"] is None and a["phase"] not in ("committed", "records"), "duplicate-result")
        late = a["failure"] == "superseded" or a["again"] or a["r"]["executionEpoch"] in self.cancels
        need(late or a["phase"] == "started", "attempt-transition")
        a["result"] = (t, seq)
        self.transactions[t] = {"attempt": p["attemptId"], "seq": seq, "records": False, "late": late}
        a["phase"] = "quarantined" if late else "result"
        a["failure"] = "superseded" if late else a["failure"]

    def on_records_committed(self, seq, p):
        t = self.transactions.get(p["transactionId"])
        need(t, "transaction-not-found")
        need(not t["late"], "transaction-quarantined")
        need(t["seq"] == p["sourceResultSeq"], "source-result-link")
        need(not t["records"], "duplicate-records-commit")
        a = self.attempts[t["attempt"]]
        need(a["phase"] == "result", "attempt-transition")
        t["records"], a["phase"] = True, "records"

    def on_attempt_committed(self, seq, p):
        a, t = self.attempt(p["attemptId"]), self.transactions.get(p["transactionId"])
        need(a["result"] and t and t["records"], "records-not-committed")
        need(a["result"] == (p["transactionId"], p["sourceResultSeq"]) and t["attempt"] == p["attemptId"], "commit-link")
        need(a["r"]["taskId"] == p["taskId"], "commit-task")
        need(a["phase"] == "records", "attempt-transition")
        need(not any(self.attempts[x]["phase"] == "committed" for x in self.operations[a["r"]["logicalOperationId"]]), "duplicate-operation-commit")
        a["phase"] = "committed"

    def on_attempt_failed(self, seq, p):
        a, superseded = self.attempt(p["attemptId"]), p["state"] == "superseded"
        need(not superseded or a["again"], "superseded-without-replacement")
        need(a["phase"] not in ("committed", "records"), "attempt-transition")
        if a["failure"] is not None:
            need(a["failure"] == "retryable-failed" and superseded, "duplicate-failure")
            a["failure"], a["phase"] = "superseded", "failed"
            return
        need(a["phase"] != "result" or superseded, "attempt-transition")
        a["failure"], a["phase"] = p["state"], "quarantined" if superseded and a["result"] else "failed"

    def on_retry_scheduled(self, seq, p):
        op, name = p["logicalOperationId"], p["scheduleId"]
        need(not self.resuming, "resume-transition-pending")
        need(self.has("retry-schedule", name), "schedule-not-reserved")
        need(name not in self.schedules, "schedule-namespace")
        a = self.attempt(p["failedAttemptId"])
        need(a["failure"] == "retryable-failed" and a["r"].get("replayPolicy") == "safe-read", "retry-predecessor")
        need(a["r"]["logicalOperationId"] == op and p["nextAttemptOrdinal"] == a["r"]["attemptOrdinal"] + 1, "retry-edge")
        need(self.epoch not in self.cancels, "retry-after-cancel")
        edge = (op, p["failedAttemptId"], p["nextAttemptOrdinal"])
        need(self.edges.get(edge) is None or self.edges[edge] in self.cancels, "duplicate-retry-edge")
        need(p["nextAttemptOrdinal"] > len(self.operations[op]), "duplicate-retry-edge")
        need(not any(s["class"] == "attempt" and s["op"] == op and not s["by"] and s["epoch"] not in self.cancels for s in self.schedules.values()), "multiple-pending-schedules")
        self.edges[edge] = self.epoch
        self.schedules[name] = {"class": "attempt", "op": op, "failed": p["failedAttemptId"], "ordinal": p["nextAttemptOrdinal"], "seq": seq, "epoch": self.epoch, "by": None}

    def on_retry_started(self, seq, p):
        need(not self.resuming, "resume-transition-pending")
        s = self.schedules.get(p["scheduleId"])
        need(s and s["class"] == "attempt", "schedule-namespace")
        need(not s["by"] and p["attemptId"] not in self.starts, "duplicate-retry-start")
        need(p["scheduledFromSeq"] == s["seq"], "retry-schedule-seq")
        need(p["logicalOperationId"] == s["op"] and p["attemptOrdinal"] == s["ordinal"], "retry-start-link")
        need(self.has("attempt", p["attemptId"]) and p["attemptId"] not in self.attempts, "retry-attempt-identity")
        need(s["epoch"] not in self.cancels and s["epoch"] == self.epoch, "retry-after-cancel")
        s["by"] = p["attemptId"]
        self.starts[p["attemptId"]] = s

    def on_cancel_requested(self, seq, p):
        need(self.run is not None and p["executionEpoch"] == self.epoch, "cancel-epoch")
        need(self.epoch not in self.cancels, "duplicate-cancel")
        self.cancels[self.epoch] = (seq, p["reason"])

    def on_resume_epoch_started(self, seq, p):
        need(self.state not in ("completed", "cancelled"), "run-terminal")
        need(self.state == "paused", "resume-state")
        need(p["priorEpoch"] == self.epoch and p["executionEpoch"] == self.epoch + 1, "resume-epoch")
        at, reason = self.cancels.get(self.epoch, (None, None))
        need(at is not None and p["priorCancelSeq"] == at, "resume-cancel-link")
        need(reason != "user-abandon", "resume-terminal-cancel")
        need(p.get("checkpointStage") == self.stage, "resume-checkpoint")
        self.epoch, self.resuming = p["executionEpoch"], True

    def on_request_intent_recorded(self, seq, p):
        i = p["intent"]
        need(not self.resuming, "resume-transition-pending")
        a = self.attempt(p["attemptId"])
        self.note(p)
        need(i.get("attemptId") == p["attemptId"] and i.get("executionEpoch") == a["r"]["executionEpoch"], "request-owner")
        need(self.has("request", i["requestId"]) and i["requestId"] not in self.requests, "request-identity")
        if i["physicalAttemptOrdinal"] == 1:
            need(i["executionEpoch"] not in self.cancels, "request-cancelled")
            need(i.get("retryOfRequestId") is None and i["requestId"] not in self.request_starts, "request-backlink")
        else:
            self.live(p["attemptId"])
            s, old = self.request_starts.get(i["requestId"]), self.requests.get(i.get("retryOfRequestId"))
            need(s and old and s[1:] == (i["attemptId"], i["physicalAttemptOrdinal"]) and s[0]["failed"] == i["retryOfRequestId"] and all(old["i"].get(f) == i.get(f) for f in SAME_REQUEST), "request-start-link")
        line = (i["logicalRequestId"], i["physicalAttemptOrdinal"])
        need(line not in self.series, "request-ordinal")
        self.series[line] = i["requestId"]
        self.requests[i["requestId"]] = self.by_seq[seq] = {"i": i, "status": None, "attempt": p["attemptId"]}

    def on_request_result_recorded(self, seq, p):
        q = p["request"]
        a = self.attempt(p["attemptId"])
        self.note(p)
        r = self.by_seq.get(p["intentLedgerSeq"])
        need(r and r["status"] is None and r["i"]["requestId"] == q["requestId"], "request-intent-link")
        same = all(r["i"].get(f) == q.get(f) for f in ("requestId", "attemptId", "executionEpoch", "physicalAttemptOrdinal", *SAME_REQUEST))
        need(q.get("attemptId") == p["attemptId"] and q.get("executionEpoch") == a["r"]["executionEpoch"] and same, "request-intent-mismatch")
        need(r["attempt"] == p["attemptId"], "request-owner")
        sha, f, error = q.get("responseSha256"), q.get("responseFile"), q.get("errorClass")
        if q["status"] == "success":
            need(sha is not None and f is not None and f["sha256"] == sha and f["relativePath"] == f".state/request-payloads/{sha}" and f["decodedBytes"] == q["decodedBytes"] and error is None, "request-outcome")
        elif q["status"] == "partial":
            need(error is not None, "request-outcome")
        else:
            need(sha is None and f is None and error is not None, "request-outcome")
        need(q["executionEpoch"] not in self.cancels, "request-cancelled")
        r["status"] = q["status"]

    def on_request_retry_scheduled(self, seq, p):
        need(not self.resuming, "resume-transition-pending")
        self.attempt(p["attemptId"])
        self.note(p)
        s = self.schedules.get(p["scheduleId"])
        need(self.has("retry-schedule", p["scheduleId"]) and not (s and s["class"] == "request"), "request-schedule-identity")
        need(not s, "schedule-namespace")
        r = self.requests.get(p["failedRequestId"])
        need(r and r["status"] == "retryable-error" and r["i"].get("replayPolicy") == "safe-read" and r["i"]["logicalRequestId"] == p["logicalRequestId"] and r["i"]["physicalAttemptOrdinal"] + 1 == p["nextPhysicalAttemptOrdinal"], "request-schedule-link")
        a = self.attempts[r["i"]["attemptId"]]
        need(a["phase"] not in ("committed", "quarantined") and a["failure"] not in ("cancelled", "terminal-failed", "superseded"), "request-schedule-attempt-state")
        need(self.tasks[a["r"]["taskId"]]["state"] == "running", "request-schedule-task-state")
        need(self.state not in ("completed", "cancelled", "failed"), "request-schedule-run-state")
        epoch = r["i"]["executionEpoch"]
        need(p["attemptId"] == r["i"]["attemptId"] and self.attempts[p["attemptId"]]["r"]["executionEpoch"] == epoch == self.epoch and epoch not in self.cancels, "request-schedule-owner")
        edge = ("request", p["failedRequestId"], p["nextPhysicalAttemptOrdinal"])
        need(self.edges.get(edge) is None or self.edges[edge] in self.cancels, "request-schedule-link")
        self.edges[edge] = self.epoch
        self.schedules[p["scheduleId"]] = {"class": "request", "op": p["logicalRequestId"], "failed": p["failedRequestId"], "ordinal": p["nextPhysicalAttemptOrdinal"], "seq": seq, "epoch": self.epoch, "by": None}

    def on_request_retry_started(self, seq, p):
        need(not self.resuming, "resume-transition-pending")
        self.live(p["attemptId"])
        self.note(p)
        s = self.schedules.get(p["scheduleId"])
        need(s and s["class"] == "request", "schedule-namespace")
        name = p["requestId"]
        need(not s["by"] and s["seq"] == p["scheduledFromLedgerSeq"] and s["op"] == p["logicalRequestId"] and s["ordinal"] == p["physicalAttemptOrdinal"] and s["epoch"] not in self.cancels
             and self.has("request", name) and name not in self.requests and name not in self.request_starts, "request-retry-start-link")
        s["by"] = name
        self.request_starts[name] = (s, p["attemptId"], p["physicalAttemptOrdinal"])

    def on_revision_committed(self, seq, p):
        need(self.has("revision", p["revisionId"]), "revision-not-reserved")
        need(p["revisionId"] not in self.revisions, "duplicate-revision-commit")
        self.revisions[p["revisionId"]] = (p.get("manifestSha256"), p.get("completionCommitId"))

    def on_run_completed(self, seq, p):
        need(self.state not in ("completed", "cancelled"), "run-terminal")
        need(self.state == "synthesizing", "run-completion-state")
        need(p["revisionId"] in self.revisions, "revision-not-committed")
        need(self.revisions[p["revisionId"]] == (p.get("manifestSha256"), p.get("completionCommitId")), "run-completion-link")
        self.state, self.blocker = "completed", None


def history(tag: str = "", refs: bool = True) -> list[tuple[str, dict]]:
    """A valid log with all 26 types: retries of a request and of an attempt, a late result, a pause with a new epoch, a completion."""
    i = lambda x: f"{x}{tag}"
    out: list[tuple[str, dict]] = []
    add = lambda type_, /, **payload: out.append((type_, payload))
    seq = lambda: len(out)
    n, j = {}, lambda a: {"attemptId": a, "journalLocalSeq": n.setdefault(a, 0) + 1, "journalEntrySha256": f"h{a}{n.__setitem__(a, n[a] + 1) or n[a]}"}
    common = {"runId": i("run"), "attemptKind": "k", "providerModel": "m", "promptTemplateSha256": "p", "logicalInputSha256": "l", "toolAllowlist": ["x", "y"], "deadlineAt": "d", "replayPolicy": "safe-read"}

    def attempt(name, op, ordinal, epoch, of=None, task="k"):
        return common | {"attemptId": i(name), "revision": 1, "taskId": i(task), "executionEpoch": epoch, "logicalOperationId": i(op), "attemptOrdinal": ordinal, "retryOfAttemptId": of and i(of), "state": "intent-recorded"}

    def request(name, a, series, ordinal, epoch, of=None):
        return {"requestId": i(name), "attemptId": i(a), "executionEpoch": epoch, "logicalRequestId": i(series), "physicalAttemptOrdinal": ordinal, "retryOfRequestId": of and i(of), "replayPolicy": "safe-read",
                "provider": "web", "operation": "fetch", "normalizedInput": {"query": None, "parameters": []}, "accessPolicySha256": "s"}

    error = {"responseSha256": None, "responseFile": None, "decodedBytes": 0, "errorClass": "e"}
    fine = {"responseSha256": "ff", "responseFile": {"sha256": "ff", "relativePath": ".state/request-payloads/ff", "decodedBytes": 3}, "decodedBytes": 3, "errorClass": None}
    task = lambda revision, state, ids, k="k", **more: add("task_upserted", task={"taskId": i(k), "revision": revision, "state": state, "attemptIds": [i(a) for a in ids], "resolution": None} | more)
    add("run_created", run={"runId": i("run"), "executionEpoch": 0, "state": "created", "depth": "quick", "checkpointStage": None, "blocker": None,
                            "taskRefs": [{"taskId": i("k"), "revision": 5}] if refs else [], "attemptRefs": [{"attemptId": i("a2"), "revision": 1}] if refs else []})
    for kind, name in (*[("attempt", f"a{x}") for x in range(1, 6)], *[("transaction", f"t{x}") for x in range(1, 4)], *[("retry-schedule", f"s{x}") for x in range(1, 5)], *[("request", f"r{x}") for x in range(1, 5)], ("revision", "v1")):
        add("identity_reserved", kind=kind, id=i(name), origin="x")
    add("lock_recovered", evidence="x")
    add("state_changed", **{"from": "created", "to": "planning", "blocker": None})
    task(1, "open", [])
    task(2, "ready", ["a1"])
    task(3, "running", ["a1", "a2", "a3"])
    task(1, "ready", ["a4"], "k2")
    add("dispatch_intent", attempt=attempt("a1", "o1", 1, 0))
    add("dispatch_started", attemptId=i("a1"))
    add("attempt_usage_recorded", attemptId=i("a1"))
    add("request_intent_recorded", **j(i("a1")), intent=request("r1", "a1", "x", 1, 0))
    add("request_result_recorded", **j(i("a1")), intentLedgerSeq=seq(), request=request("r1", "a1", "x", 1, 0) | error | {"status": "retryable-error"})
    add("request_retry_scheduled", **j(i("a1")), scheduleId=i("s1"), failedRequestId=i("r1"), logicalRequestId=i("x"), nextPhysicalAttemptOrdinal=2)
    add("request_retry_started", **j(i("a1")), scheduleId=i("s1"), requestId=i("r2"), logicalRequestId=i("x"), physicalAttemptOrdinal=2, scheduledFromLedgerSeq=seq())
    add("request_intent_recorded", **j(i("a1")), intent=request("r2", "a1", "x", 2, 0, "r1"))
    add("request_result_recorded", **j(i("a1")), intentLedgerSeq=seq(), request=request("r2", "a1", "x", 2, 0, "r1") | fine | {"status": "success"})
    add("request_intent_recorded", **j(i("a1")), intent=request("r3", "a1", "y", 1, 0))
    add("request_result_recorded", **j(i("a1")), intentLedgerSeq=seq(), request=request("r3", "a1", "y", 1, 0) | error | {"status": "partial"})
    add("attempt_failed", attemptId=i("a1"), state="retryable-failed")
    add("retry_scheduled", scheduleId=i("s2"), logicalOperationId=i("o1"), failedAttemptId=i("a1"), nextAttemptOrdinal=2)
    add("retry_started", scheduleId=i("s2"), logicalOperationId=i("o1"), attemptId=i("a2"), attemptOrdinal=2, scheduledFromSeq=seq())
    add("dispatch_intent", attempt=attempt("a2", "o1", 2, 0, "a1"))
    add("attempt_failed", attemptId=i("a1"), state="superseded")
    add("dispatch_started", attemptId=i("a2"))
    add("result_recorded", attemptId=i("a2"), transactionId=i("t1"))
    add("records_committed", transactionId=i("t1"), sourceResultSeq=seq())
    add("attempt_committed", attemptId=i("a2"), transactionId=i("t1"), taskId=i("k"), sourceResultSeq=seq() - 1)
    task(2, "running", ["a4", "a5"], "k2")
    add("dispatch_intent", attempt=attempt("a4", "o2", 1, 0, task="k2"))
    add("dispatch_started", attemptId=i("a4"))
    add("attempt_failed", attemptId=i("a4"), state="retryable-failed")
    add("retry_scheduled", scheduleId=i("s3"), logicalOperationId=i("o2"), failedAttemptId=i("a4"), nextAttemptOrdinal=2)
    add("active_time_checkpoint", totalMs=1)
    add("budget_amended", reason="x")
    for a, b in (("planning", "researching"), ("researching", "paused")):
        add("state_changed", **{"from": a, "to": b, "blocker": None})
    add("cancel_requested", executionEpoch=0, reason="user-pause")
    at = seq()
    add("result_recorded", attemptId=i("a1"), transactionId=i("t2"))
    add("resume_epoch_started", priorEpoch=0, executionEpoch=1, priorCancelSeq=at, checkpointStage="researching")
    for a, b in (("paused", "recovering"), ("recovering", "researching")):
        add("state_changed", **{"from": a, "to": b, "blocker": None})
    add("retry_scheduled", scheduleId=i("s4"), logicalOperationId=i("o2"), failedAttemptId=i("a4"), nextAttemptOrdinal=2)
    task(4, "running", ["a1", "a2", "a3"])
    task(5, "resolved", ["a1", "a2", "a3"], resolution="done")
    add("state_changed", **{"from": "researching", "to": "synthesizing", "blocker": None})
    add("revision_prepared", revisionId=i("v1"))
    add("revision_failed", revisionId=i("v1"))
    add("revision_committed", revisionId=i("v1"), manifestSha256="m", completionCommitId="c")
    add("run_completed", revisionId=i("v1"), manifestSha256="m", completionCommitId="c")
    return out


VALUES = [0, 1, 2, 3, 7, "a1", "a2", "a3", "a4", "a5", "t1", "t2", "s1", "s2", "s4", "r1", "r2", "r4", "v1", "k", "k2", "o1", "o2", "x", "y", "never", "resolved", "ready", "running", "paused", "failed", "cancelled", "recovering",
          "completed", "superseded", "terminal-failed", "retryable-failed", "user-abandon", "success", "partial", "request", "attempt", "zz", None]


def broken(rng: random.Random) -> list[tuple[int, str, dict]]:
    """A history with a few events left out, moved, said twice or changed in one field."""
    out = json.loads(json.dumps(history(refs=rng.random() < 0.5)))
    for _ in range(rng.choice((1, 1, 2))):
        at = rng.randrange(1, len(out))
        how = rng.random()
        if how < 0.15:
            out.pop(at)
        elif how < 0.3:
            out.insert(rng.randrange(1, len(out)), out.pop(at))
        elif how < 0.45:
            out.insert(rng.randrange(at, len(out)), json.loads(json.dumps(out[at])))
        else:
            fields = []

            def leaves(x, path=()):
                for k, v in (x.items() if isinstance(x, dict) else enumerate(x) if isinstance(x, list) else ()):
                    if isinstance(v, dict | list) and v:
                        leaves(v, (*path, k))
                    else:
                        fields.append((*path, k))  # noqa: B023

            leaves(out[at][1])
            if fields:
                *path, last = rng.choice(fields)
                x = out[at][1]
                for k in path:
                    x = x[k]
                old = x[last]
                same = [v for v in VALUES if (v is None and isinstance(x, dict)) or (v is not None and isinstance(v, int) == isinstance(old, int))]
                x[last] = {"code": rng.choice(("retryable-x", "z")), "message": ""} if last == "blocker" else {"sha256": "ff", "relativePath": "x", "decodedBytes": 1} if last == "responseFile" else rng.choice(same) if not isinstance(old, dict | list) else old
    rows = [(n + 1, k, p) for n, (k, p) in enumerate(out)]
    if rng.random() < 0.05:
        cut = rng.randrange(1, len(rows))
        rows = rows[:cut] + [(s + 1, k, p) for s, k, p in rows[cut:]]
    return rows


assert set(JOURNALED) < set(NEEDS)
