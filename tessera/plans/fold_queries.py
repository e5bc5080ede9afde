"""The ledger fold over logs of all 26 event types, derived from the events table, and its SQL.

A user's events are a run.  Each event becomes a block of log entries by its type: a task that is
done at once, one whose attempt fails and runs again, one whose request is repeated, a pause with
a new epoch, or a revision.  Some blocks break a rule, by event number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.operators import ledger_fold as fold_rules
from tessera.plans import adapters as A
from tessera.plans.adapters import LEDGER_SQL, with_sql
from tessera.plans.queries import register

TEXTS, NUMBERS = ("a", "b", "c", "d", "e"), ("n", "m", "k", "l")
#: Expressions that Spark and DuckDB read alike; id: the event's number, base: entries before the block, epoch: the run's.
START = [
    dict(t="run_created", a="'run' || run"), dict(t="state_changed", a="'created'", b="'planning'"), dict(t="state_changed", a="'planning'", b="'researching'"), dict(t="budget_amended")]
BLOCKS = {
    "view": [
        dict(t="identity_reserved", a="'attempt'", b="'a' || id"), dict(t="identity_reserved", a="CASE WHEN id % 47 = 0 THEN 'attempt' ELSE 'transaction' END", b="CASE WHEN id % 47 = 0 THEN 'a' ELSE 't' END || id"),
        dict(t="identity_reserved", a="'request'", b="'r' || id"), dict(t="task_upserted", a="'k' || id", b="'ready'", c="''", n="1"), dict(t="task_upserted", a="'k' || id", b="'running'", c="'a' || id", n="2"),
        dict(t="dispatch_intent", a="'a' || id", b="'k' || id", d="'o' || id", n="1", m="CASE WHEN id % 43 = 0 THEN epoch + 1 ELSE epoch END"), dict(t="dispatch_started", a="'a' || id"),
        dict(t="attempt_usage_recorded", a="'a' || id"), dict(t="request_intent_recorded", a="'a' || id", b="'r' || id", d="'x' || id", n="1", m="1", k="epoch"),
        dict(t="request_result_recorded", a="'a' || id", b="'r' || id", d="'x' || id", e="'success'", n="2", m="1", k="epoch", l="base + 9"), dict(t="result_recorded", a="'a' || id", b="'t' || id"),
        dict(t="records_committed", a="'t' || id", n="base + 11"), dict(t="attempt_committed", a="'a' || id", b="'t' || id", c="CASE WHEN id % 41 = 0 THEN 'k0' ELSE 'k' || id END", n="base + 11"),
        dict(t="task_upserted", a="'k' || id", b="'resolved'", c="'a' || id", n="3")],
    "click": [
        dict(t="identity_reserved", a="'attempt'", b="'a' || id"), dict(t="identity_reserved", a="'attempt'", b="'b' || id"), dict(t="identity_reserved", a="'retry-schedule'", b="'s' || id"),
        dict(t="identity_reserved", a="'transaction'", b="'t' || id"), dict(t="task_upserted", a="'k' || id", b="'running'", c="CASE WHEN id % 43 = 0 THEN 'a' || id ELSE 'a' || id || ',b' || id END", n="1"),
        dict(t="dispatch_intent", a="'a' || id", b="'k' || id", d="'o' || id", n="1", m="epoch"), dict(t="dispatch_started", a="'a' || id"), dict(t="attempt_failed", a="'a' || id", b="'retryable-failed'"),
        dict(t="retry_scheduled", a="'s' || id", b="'o' || id", c="'a' || id", n="2"),
        dict(t="retry_started", a="'s' || id", b="'o' || id", c="'b' || id", n="2", m="CASE WHEN id % 41 = 0 THEN base + 8 ELSE base + 9 END"),
        dict(t="dispatch_intent", a="'b' || id", b="'k' || id", c="'a' || id", d="'o' || id", n="2", m="epoch"), dict(t="attempt_failed", a="'a' || id", b="'superseded'"), dict(t="result_recorded", a="'a' || id", b="'t' || id")],
    "error": [
        dict(t="identity_reserved", a="'attempt'", b="'a' || id"), dict(t="identity_reserved", a="'request'", b="'q' || id"), dict(t="identity_reserved", a="'request'", b="'r' || id"),
        dict(t="identity_reserved", a="'retry-schedule'", b="'s' || id"), dict(t="task_upserted", a="'k' || id", b="'running'", c="'a' || id", n="1"), dict(t="dispatch_intent", a="'a' || id", b="'k' || id", d="'o' || id", n="1", m="epoch"),
        dict(t="dispatch_started", a="'a' || id"), dict(t="request_intent_recorded", a="'a' || id", b="'q' || id", d="'x' || id", n="1", m="1", k="epoch"),
        dict(t="request_result_recorded", a="'a' || id", b="'q' || id", d="'x' || id", e="'retryable-error'", n="2", m="1", k="epoch", l="base + 8"),
        dict(t="request_retry_scheduled", a="'a' || id", b="'s' || id", c="'q' || id", d="'x' || id", n="CASE WHEN id % 41 = 0 THEN 9 ELSE 3 END", m="2"),
        dict(t="request_retry_started", a="'a' || id", b="'s' || id", c="'r' || id", d="'x' || id", n="4", m="2", l="base + 10"),
        dict(t="request_intent_recorded", a="'a' || id", b="'r' || id", c="CASE WHEN id % 43 <> 0 THEN 'q' || id END", d="'x' || id", n="5", m="2", k="epoch"),
        dict(t="request_result_recorded", a="'a' || id", b="'r' || id", d="'x' || id", e="'partial'", n="6", m="2", k="epoch", l="base + 12"), dict(t="attempt_failed", a="'a' || id", b="'terminal-failed'")],
    "signup": [
        dict(t="state_changed", a="'researching'", b="CASE WHEN id % 43 = 0 THEN 'verifying' ELSE 'paused' END"), dict(t="cancel_requested", a="'user-pause'", n="epoch"), dict(t="active_time_checkpoint"), dict(t="lock_recovered"),
        dict(t="resume_epoch_started", a="'researching'", n="epoch", m="epoch + 1", l="CASE WHEN id % 41 = 0 THEN base + 1 ELSE base + 2 END"), dict(t="state_changed", a="'paused'", b="'recovering'"),
        dict(t="state_changed", a="'recovering'", b="'researching'")],
    "purchase": [
        dict(t="identity_reserved", a="CASE WHEN id % 41 = 0 THEN 'x' ELSE 'revision' END", b="'v' || id"), dict(t="revision_prepared", a="'v' || id"), dict(t="revision_failed", a="'v' || id"), dict(t="revision_committed", a="'v' || id"),
        dict(t="state_changed", a="'researching'", b="'verifying'"), dict(t="state_changed", a="'verifying'", b="CASE WHEN closing THEN 'synthesizing' ELSE 'researching' END"),
        dict(t="CASE WHEN closing THEN 'run_completed' ELSE 'budget_amended' END", a="'v' || id")],
}


def _quoted(t: str) -> str:
    return t if " " in t else f"'{t}'"


def _spark_block(block: list[dict]) -> str:
    one = lambda x: ", ".join(["'t', " + _quoted(x["t"])] + [f"'{f}', cast({x.get(f, 'NULL')} as string)" for f in TEXTS] + [f"'{f}', cast({x.get(f, 'NULL')} as bigint)" for f in NUMBERS])
    return "array(" + ", ".join(f"named_struct({one(x)})" for x in block) + ")"


def _duck_block(block: list[dict]) -> str:
    one = lambda x: ", ".join(["'t': " + _quoted(x["t"])] + [f"'{f}': ({x.get(f, 'NULL')})::VARCHAR" for f in TEXTS] + [f"'{f}': ({x.get(f, 'NULL')})::BIGINT" for f in NUMBERS])
    return "[" + ", ".join(f"{{{one(x)}}}" for x in block) + "]"


def _sizes(kind: str) -> str:
    return " ".join(f"WHEN type = '{k}' THEN {len(b)}" for k, b in BLOCKS.items()).join(("CASE WHEN first THEN " + str(len(START)) + " ", f" END AS {kind}"))


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows (run_id, seq, type, payload): one log a user."""
    e, by = A.ledger(spark, sf_dir), W.partitionBy("user_id").orderBy("seq")
    e = e.select("user_id", "seq", "type", F.col("event_id").alias("id"), F.col("user_id").alias("run"), (F.col("seq") == 1).alias("first"), ((F.lead("seq").over(by).isNull()) & (F.col("type") == "purchase")).alias("closing"))
    e = e.selectExpr("*", _sizes("size"))
    before = by.rowsBetween(W.unboundedPreceding, -1)
    e = e.withColumns({
        "base": F.coalesce(F.sum("size").over(before), F.lit(0)), "epoch": F.coalesce(F.count_if((F.col("type") == "signup") & ~F.col("first")).over(before), F.lit(0))})
    blocks = " ".join(f"WHEN type = '{k}' THEN {_spark_block(b)}" for k, b in BLOCKS.items())
    x = e.selectExpr("user_id", "run", "base", f"posexplode(CASE WHEN first THEN {_spark_block(START)} {blocks} END) AS (i, x)").select("run", (F.col("base") + F.col("i") + 1).alias("seq"), "x.*")
    t, a, b, c, d, n, m, k, line = (F.col(f) for f in ("t", "a", "b", "c", "d", "n", "m", "k", "l"))
    s = lambda **f: F.struct(*[v.alias(name) for name, v in f.items()])
    run_id, sha = F.concat(F.lit("run"), F.col("run").cast("string")), F.md5(F.concat("a", n.cast("string")))
    journal = {"attemptId": a, "journalLocalSeq": n, "journalEntrySha256": sha}
    request = {"requestId": b, "attemptId": a, "executionEpoch": k, "logicalRequestId": d, "physicalAttemptOrdinal": m, "retryOfRequestId": c, "replayPolicy": F.lit("safe-read"), "provider": F.lit("web")}
    ok = F.col("e") == "success"
    file = F.when(ok, s(sha256=F.lit("ff"), relativePath=F.lit(".state/request-payloads/ff"), decodedBytes=F.lit(3)))
    result = request | {"status": F.col("e"), "responseSha256": F.when(ok, "ff"), "responseFile": file, "decodedBytes": F.lit(3), "errorClass": F.when(~ok, "e")}
    attempts = F.when(c == "", F.array().cast("array<string>")).otherwise(F.split("c", ","))
    payloads = {
        "identity_reserved": s(kind=a, id=b), "run_created": s(run=s(runId=a, executionEpoch=F.lit(0), state=F.lit("created"), depth=F.lit("deep"))), "state_changed": s(**{"from": a, "to": b}),
        "task_upserted": s(task=s(taskId=a, revision=n, state=b, attemptIds=attempts, resolution=F.when(b == "resolved", "done"))),
        "dispatch_intent": s(attempt=s(attemptId=a, runId=run_id, taskId=b, executionEpoch=m, logicalOperationId=d, attemptOrdinal=n, retryOfAttemptId=c, replayPolicy=F.lit("safe-read"), state=F.lit("intent-recorded"))),
        **{kind: s(attemptId=a) for kind in ("dispatch_started", "attempt_usage_recorded")}, "result_recorded": s(attemptId=a, transactionId=b), "records_committed": s(transactionId=a, sourceResultSeq=n),
        "attempt_committed": s(attemptId=a, transactionId=b, taskId=c, sourceResultSeq=n), "attempt_failed": s(attemptId=a, state=b), "retry_scheduled": s(scheduleId=a, logicalOperationId=b, failedAttemptId=c, nextAttemptOrdinal=n),
        "retry_started": s(scheduleId=a, logicalOperationId=b, attemptId=c, attemptOrdinal=n, scheduledFromSeq=m), "request_intent_recorded": s(**journal, intent=s(**request)),
        "request_result_recorded": s(**journal, intentLedgerSeq=line, request=s(**result)),
        "request_retry_scheduled": s(**journal, scheduleId=b, failedRequestId=c, logicalRequestId=d, nextPhysicalAttemptOrdinal=m),
        "request_retry_started": s(**journal, scheduleId=b, requestId=c, logicalRequestId=d, physicalAttemptOrdinal=m, scheduledFromLedgerSeq=line), "cancel_requested": s(executionEpoch=n, reason=a),
        "resume_epoch_started": s(priorEpoch=n, executionEpoch=m, priorCancelSeq=line, checkpointStage=a), **{kind: s(revisionId=a) for kind in ("revision_prepared", "revision_failed", "revision_committed", "run_completed")}}
    payload = F.lit("{}")
    for kind, made in payloads.items():
        payload = F.when(t == kind, F.to_json(made)).otherwise(payload)
    return x.select(run_id.alias("run_id"), "seq", t.alias("type"), payload.alias("payload"))


RUN_LOG_SQL = f"""
e0 AS (
  SELECT user_id AS run, seq, type, event_id AS id, seq = 1 AS first, type = 'purchase' AND lead(seq) OVER (PARTITION BY user_id ORDER BY seq) IS NULL AS closing FROM ledger),
e1 AS (SELECT *, {_sizes("size")} FROM e0),
e2 AS (
  SELECT *, coalesce(sum(size) OVER before, 0)::BIGINT AS base, count(*) FILTER (WHERE type = 'signup' AND NOT first) OVER before AS epoch FROM e1
  WINDOW before AS (PARTITION BY run ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
e3 AS (SELECT run, base, CASE WHEN first THEN {_duck_block(START)} {" ".join(f"WHEN type = '{k}' THEN {_duck_block(b)}" for k, b in BLOCKS.items())} END AS xs FROM e2),
log AS (SELECT run, base + i AS seq, x.t AS t, x.a AS a, x.b AS b, x.c AS c, x.d AS d, x.e AS e, x.n AS n, x.m AS m, x.k AS k, x.l AS l
  FROM (SELECT run, base, unnest(xs) AS x, generate_subscripts(xs, 1) AS i FROM e3))"""

#: Each rule looks at earlier entries only and takes them as right; the least broken one of a run counts.
RULES_SQL = """
r AS (
  SELECT *,
    last_value(CASE t WHEN 'run_created' THEN 'created' WHEN 'state_changed' THEN b WHEN 'run_completed' THEN 'completed' END IGNORE NULLS) OVER w AS state,
    last_value(CASE WHEN t = 'state_changed' AND b IN ('planning', 'researching', 'verifying', 'synthesizing') THEN b END IGNORE NULLS) OVER w AS stage,
    coalesce(last_value(CASE t WHEN 'run_created' THEN 0 WHEN 'resume_epoch_started' THEN m END IGNORE NULLS) OVER w, 0) AS epoch,
    coalesce(last_value(CASE t WHEN 'cancel_requested' THEN seq WHEN 'resume_epoch_started' THEN 0 END IGNORE NULLS) OVER w, 0) AS cancel_seq,
    coalesce(last_value(CASE t WHEN 'resume_epoch_started' THEN true WHEN 'state_changed' THEN false END IGNORE NULLS) OVER w, false) AS resuming
  FROM log WINDOW w AS (PARTITION BY run ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
reserved AS (SELECT run, a AS kind, b AS id, min(seq) AS seq FROM log WHERE t = 'identity_reserved' GROUP BY ALL),
moves(f, g) AS (VALUES ('created', 'planning'), ('planning', 'researching'), ('planning', 'paused'), ('researching', 'verifying'), ('researching', 'paused'), ('verifying', 'researching'), ('verifying', 'synthesizing'),
  ('verifying', 'paused'), ('synthesizing', 'paused'), ('recovering', 'paused'), ('paused', 'recovering')),
tasks AS (SELECT run, seq, a AS task, b AS state, c AS attempts, n, lag(n) OVER (PARTITION BY run, a ORDER BY seq) AS before, lead(seq) OVER (PARTITION BY run, a ORDER BY seq) AS until FROM log WHERE t = 'task_upserted'),
journal AS (SELECT run, seq, n, row_number() OVER (PARTITION BY run, a ORDER BY seq) AS expected FROM log WHERE t IN ('request_intent_recorded', 'request_result_recorded', 'request_retry_scheduled', 'request_retry_started')),
bad AS (
  SELECT x.run, x.seq, 1 AS o, 'duplicate-reservation' AS code FROM log x JOIN reserved y ON x.run = y.run AND x.a = y.kind AND x.b = y.id WHERE t = 'identity_reserved' AND x.seq > y.seq
  UNION ALL SELECT run, seq, 1, 'run-state-from' FROM r WHERE t = 'state_changed' AND a <> state
  UNION ALL SELECT run, seq, 2, 'run-transition' FROM r WHERE t = 'state_changed' AND (a, b) NOT IN (SELECT (f, g) FROM moves) AND NOT (a = 'recovering' AND b = stage)
  UNION ALL SELECT run, seq, 3, 'cancel-transition' FROM r WHERE t = 'state_changed' AND cancel_seq > 0 AND b NOT IN ('paused', 'cancelled') AND NOT resuming
  UNION ALL SELECT run, seq, 4, 'resume-transition' FROM r WHERE t = 'state_changed' AND (state = 'paused' AND b = 'recovering') <> resuming
  UNION ALL SELECT run, seq, 1, 'task-revision' FROM tasks WHERE n <> coalesce(before, 0) + 1
  UNION ALL SELECT run, seq, 0, 'resume-transition-pending' FROM r WHERE resuming AND t IN ('dispatch_intent', 'retry_scheduled', 'retry_started', 'request_intent_recorded', 'request_retry_scheduled', 'request_retry_started')
  UNION ALL SELECT x.run, x.seq, 1, 'dispatch-task-owner' FROM log x JOIN tasks k ON k.run = x.run AND k.task = x.b AND k.seq < x.seq AND (k.until IS NULL OR k.until > x.seq)
    WHERE t = 'dispatch_intent' AND NOT list_contains(string_split(k.attempts, ','), x.a)
  UNION ALL SELECT run, seq, 2, 'attempt-epoch' FROM r WHERE t = 'dispatch_intent' AND (m <> epoch OR cancel_seq > 0)
  UNION ALL SELECT x.run, x.seq, 1, 'commit-link' FROM log x JOIN log y ON x.run = y.run AND y.t = 'result_recorded' AND y.b = x.b WHERE x.t = 'attempt_committed' AND (y.a <> x.a OR y.seq <> x.n)
  UNION ALL SELECT x.run, x.seq, 2, 'commit-task' FROM log x JOIN log y ON x.run = y.run AND y.t = 'dispatch_intent' AND y.a = x.a WHERE x.t = 'attempt_committed' AND y.b <> x.c
  UNION ALL SELECT x.run, x.seq, 1, 'retry-schedule-seq' FROM log x JOIN log y ON x.run = y.run AND y.t = 'retry_scheduled' AND y.a = x.a WHERE x.t = 'retry_started' AND y.seq <> x.m
  UNION ALL SELECT run, seq, 1, 'request-journal-sequence' FROM journal WHERE n <> expected
  UNION ALL SELECT x.run, x.seq, 2, 'request-start-link' FROM log x LEFT JOIN log y ON x.run = y.run AND y.t = 'request_retry_scheduled' AND y.c = x.c AND y.d = x.d AND y.m = x.m
    WHERE x.t = 'request_intent_recorded' AND x.m > 1 AND y.seq IS NULL
  UNION ALL SELECT run, seq, 1, 'resume-state' FROM r WHERE t = 'resume_epoch_started' AND state <> 'paused'
  UNION ALL SELECT run, seq, 2, 'resume-cancel-link' FROM r WHERE t = 'resume_epoch_started' AND l <> cancel_seq
  UNION ALL SELECT x.run, x.seq, 1, 'revision-not-reserved' FROM log x LEFT JOIN reserved y ON x.run = y.run AND y.kind = 'revision' AND y.id = x.a AND y.seq < x.seq WHERE x.t = 'revision_committed' AND y.seq IS NULL
  UNION ALL SELECT run, seq, 1, 'run-completion-state' FROM r WHERE t = 'run_completed' AND state <> 'synthesizing'),
cuts AS (SELECT run, min(seq) AS bad_seq, arg_min(code, seq * 10 + o) AS code FROM bad GROUP BY run),
good AS (SELECT r.*, c.bad_seq, c.code FROM r LEFT JOIN cuts c ON c.run = r.run WHERE c.bad_seq IS NULL OR r.seq < c.bad_seq),
late AS (
  SELECT x.run, x.seq FROM good x WHERE x.t = 'result_recorded' AND (EXISTS (SELECT 1 FROM log y WHERE y.run = x.run AND y.seq < x.seq AND y.t = 'attempt_failed' AND y.a = x.a AND y.b = 'superseded')
    OR EXISTS (SELECT 1 FROM log y WHERE y.run = x.run AND y.seq < x.seq AND y.t = 'dispatch_intent' AND y.c = x.a))),
ends AS (SELECT run, arg_max(CASE t WHEN 'run_created' THEN 0 ELSE m END, seq) FILTER (WHERE t IN ('run_created', 'resume_epoch_started')) AS epoch, max(n) FILTER (WHERE t = 'cancel_requested') AS cancelled FROM good GROUP BY run),
waits AS (
  SELECT x.run, count(*) AS waiting FROM good x JOIN ends z ON z.run = x.run WHERE x.t IN ('retry_scheduled', 'request_retry_scheduled') AND x.epoch = z.epoch AND z.cancelled IS DISTINCT FROM z.epoch
    AND NOT EXISTS (SELECT 1 FROM good y WHERE y.run = x.run AND ((x.t = 'retry_scheduled' AND y.t = 'retry_started' AND y.a = x.a) OR (x.t = 'request_retry_scheduled' AND y.t = 'request_retry_started' AND y.b = x.b)))
  GROUP BY x.run)
SELECT 'run' || g.run AS run_id, max(g.seq) AS seq,
  arg_max(CASE t WHEN 'run_created' THEN 'created' WHEN 'state_changed' THEN b ELSE 'completed' END, g.seq) FILTER (WHERE t IN ('run_created', 'state_changed', 'run_completed')) AS state,
  any_value(z.epoch) AS epoch, count(*) FILTER (WHERE t = 'task_upserted' AND g.n = 1) AS tasks, count(*) FILTER (WHERE t = 'dispatch_intent') AS attempts,
  count(*) FILTER (WHERE t = 'attempt_committed') AS committed, count(l.seq) AS quarantined, coalesce(any_value(w.waiting), 0) AS pending_retries,
  count(*) FILTER (WHERE t = 'request_intent_recorded') AS requests, count(*) FILTER (WHERE t = 'request_result_recorded' AND e = 'success') AS cache_eligible,
  count(*) FILTER (WHERE t = 'revision_committed') AS revisions, 'reducer.' || any_value(g.code) AS error, any_value(g.bad_seq) AS error_seq
FROM good g JOIN ends z ON z.run = g.run LEFT JOIN waits w ON w.run = g.run LEFT JOIN late l ON l.run = g.run AND l.seq = g.seq GROUP BY g.run"""


@register("ledger_fold_all_types", with_sql(LEDGER_SQL, RUN_LOG_SQL, RULES_SQL))
def ledger_fold_all_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold_rules.fold(run_log(spark, sf_dir))
