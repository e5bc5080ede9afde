"""The ledger fold as joins and prefix scans: ordered events to the state of their run, and the first bad event.

A fold stops at the first event that its rules reject, so every rule may take all earlier events
as accepted: if one of them were not, it would be the first bad event itself.  So no rule needs
the folded state, only facts that earlier events state outright, and these come from three kinds
of lookup, none of which needs a run, or a hot task or attempt, in one place:

* *facts*: the first event that names a thing (a reservation, a transaction, a schedule ...), by
  one join on (run, space, key) for all rules;
* *prior values*: the value that the last earlier event of the same run, attempt, task, operation
  or retry edge has set.  This is a parallel prefix: the events of a key are cut into chunks by
  sequence number, each chunk is reduced to the values it sets last, these reductions are
  composed in order, and each chunk is then read again from the values it starts with;
* *numbers* that consecutive events count up (sequence, ordinals, journal positions), which are the
  prior values of themselves.

A payload's fields are read once, into a few plain columns: each type of event has its own use of
them, so rows stay narrow.  What is looked up comes in lists of what was found; events meet these lists,
the prior values of attempts, and those of phases, tasks and operations in one join by number.

The rules of an event stand in a fixed order and the first one broken gives its code; the least
bad sequence number of a run cuts its log.  All 26 event types are known.

Defined results: a run's events are ordered by ``seq``; of events with one number, and after a gap,
the later one is bad (``reducer.sequence``); a payload that lacks a field its rule reads, or is
null or no JSON object, is ``reducer.payload``; an unknown type is ``reducer.unknown-type``; rows
without a run_id make one run of their own; no events give no rows.
"""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.operators.retry import CHECKPOINTS, RUN_MOVES, TASK_MOVES, allowed
from tessera.plans import cut as cuts
from tessera.plans.cut import cut

EVENT = "run_id string, seq bigint, type string, payload string"
#: Sequence numbers of a chunk of the prefix scans.
CHUNK = 1 << 16
RETRYABLE = "retryable-"

stored = partial(cuts.stored, split=True)

_REQUEST = (
    "requestId string, attemptId string, executionEpoch bigint, logicalRequestId string, physicalAttemptOrdinal bigint, retryOfRequestId string, "
    "replayPolicy string, provider string, operation string, normalizedInput string, accessPolicySha256 string")
PAYLOAD = f"""kind string, id string,
  run struct<runId string, executionEpoch bigint, state string, depth string, checkpointStage string, blocker struct<code string>,
    taskRefs array<struct<taskId string, revision bigint>>, attemptRefs array<struct<attemptId string, revision bigint>>>,
  `from` string, `to` string, blocker struct<code string>,
  priorEpoch bigint, executionEpoch bigint, priorCancelSeq bigint, checkpointStage string, reason string,
  task struct<taskId string, revision bigint, state string, attemptIds array<string>, resolution string>,
  attempt struct<attemptId string, revision bigint, runId string, taskId string, executionEpoch bigint, logicalOperationId string, attemptOrdinal bigint,
    retryOfAttemptId string, attemptKind string, replayPolicy string, state string, providerModel string, promptTemplateSha256 string,
    logicalInputSha256 string, toolAllowlist array<string>, deadlineAt string>,
  attemptId string, transactionId string, taskId string, sourceResultSeq bigint, state string,
  scheduleId string, logicalOperationId string, failedAttemptId string, nextAttemptOrdinal bigint, attemptOrdinal bigint, scheduledFromSeq bigint,
  journalLocalSeq bigint, journalEntrySha256 string, intent struct<{_REQUEST}>,
  request struct<{_REQUEST}, status string, responseSha256 string, responseFile struct<sha256 string, relativePath string, decodedBytes bigint>,
    decodedBytes bigint, errorClass string>,
  intentLedgerSeq bigint, failedRequestId string, nextPhysicalAttemptOrdinal bigint, logicalRequestId string, requestId string,
  physicalAttemptOrdinal bigint, scheduledFromLedgerSeq bigint, revisionId string, manifestSha256 string, completionCommitId string"""

#: Fields without which an event cannot be judged.
NEEDS = {
    "identity_reserved": ("kind", "id"), "run_created": ("run.runId",), "state_changed": ("from", "to"), "task_upserted": ("task.taskId", "task.revision", "task.state", "task.attemptIds"),
    "dispatch_intent": ("attempt.attemptId", "attempt.taskId", "attempt.logicalOperationId", "attempt.attemptOrdinal"), "dispatch_started": ("attemptId",),
    "attempt_usage_recorded": ("attemptId",), "result_recorded": ("attemptId", "transactionId"), "records_committed": ("transactionId", "sourceResultSeq"),
    "attempt_committed": ("attemptId", "transactionId", "taskId", "sourceResultSeq"), "attempt_failed": ("attemptId", "state"),
    "retry_scheduled": ("scheduleId", "logicalOperationId", "failedAttemptId", "nextAttemptOrdinal"),
    "retry_started": ("scheduleId", "logicalOperationId", "attemptId", "attemptOrdinal", "scheduledFromSeq"), "cancel_requested": ("executionEpoch", "reason"),
    "resume_epoch_started": ("priorEpoch", "executionEpoch", "priorCancelSeq"),
    "request_intent_recorded": ("attemptId", "journalLocalSeq", "journalEntrySha256", "intent.requestId", "intent.logicalRequestId", "intent.physicalAttemptOrdinal"),
    "request_result_recorded": ("attemptId", "journalLocalSeq", "journalEntrySha256", "intentLedgerSeq", "request.requestId", "request.status"),
    "request_retry_scheduled": ("attemptId", "journalLocalSeq", "journalEntrySha256", "scheduleId", "failedRequestId", "logicalRequestId", "nextPhysicalAttemptOrdinal"),
    "request_retry_started": ("attemptId", "journalLocalSeq", "journalEntrySha256", "scheduleId", "logicalRequestId", "requestId", "physicalAttemptOrdinal", "scheduledFromLedgerSeq"),
    "revision_committed": ("revisionId",), "run_completed": ("revisionId",),
    "active_time_checkpoint": (), "budget_amended": (), "lock_recovered": (), "revision_prepared": (), "revision_failed": (),
}
JOURNALED = ("request_intent_recorded", "request_result_recorded", "request_retry_scheduled", "request_retry_started")
#: What a fact tells of its event; its sequence number comes with it.
FACT = ("a", "b", "c", "d", "e", "n", "m")


#: The fields that rules read of a payload, by event type: texts, numbers; ``same``, ``blocker`` and ``request.holds`` are made in ``parsed``.
READS = {
    "identity_reserved": (("kind", "id"), ()), "run_created": (("run.runId", "run.depth", "run.state", "run.blocker.code", "run.checkpointStage"), ("run.executionEpoch",)),
    "state_changed": (("from", "to", "blocker", "blocker.code"), ()), "task_upserted": (("task.taskId", "task.state", "task.resolution"), ("task.revision",)),
    "dispatch_intent": (
        ("attempt.attemptId", "attempt.runId", "attempt.taskId", "attempt.logicalOperationId", "attempt.retryOfAttemptId", "attempt.replayPolicy", "attempt.state", "attempt.same"),
        ("attempt.executionEpoch", "attempt.attemptOrdinal", "attempt.revision")),
    "dispatch_started": (("attemptId",), ()), "attempt_usage_recorded": (("attemptId",), ()), "result_recorded": (("attemptId", "transactionId"), ()),
    "records_committed": (("transactionId",), ("sourceResultSeq",)), "attempt_committed": (("attemptId", "transactionId", "taskId"), ("sourceResultSeq",)), "attempt_failed": (("attemptId", "state"), ()),
    "retry_scheduled": (("scheduleId", "logicalOperationId", "failedAttemptId"), ("nextAttemptOrdinal",)),
    "retry_started": (("scheduleId", "logicalOperationId", "attemptId"), ("attemptOrdinal", "scheduledFromSeq")), "cancel_requested": (("reason",), ("executionEpoch",)),
    "resume_epoch_started": (("checkpointStage",), ("priorEpoch", "executionEpoch", "priorCancelSeq")),
    "request_intent_recorded": (
        ("attemptId", "journalEntrySha256", "intent.requestId", "intent.attemptId", "intent.logicalRequestId", "intent.retryOfRequestId", "intent.replayPolicy", "intent.same"),
        ("journalLocalSeq", "intent.executionEpoch", "intent.physicalAttemptOrdinal")),
    "request_result_recorded": (
        ("attemptId", "journalEntrySha256", "request.requestId", "request.attemptId", "request.status", "request.same"),
        ("journalLocalSeq", "intentLedgerSeq", "request.executionEpoch", "request.physicalAttemptOrdinal", "request.holds")),
    "request_retry_scheduled": (("attemptId", "journalEntrySha256", "scheduleId", "failedRequestId", "logicalRequestId"), ("journalLocalSeq", "nextPhysicalAttemptOrdinal")),
    "request_retry_started": (
        ("attemptId", "journalEntrySha256", "scheduleId", "requestId", "logicalRequestId"), ("journalLocalSeq", "physicalAttemptOrdinal", "scheduledFromLedgerSeq")),
    "revision_committed": (("revisionId", "manifestSha256", "completionCommitId"), ()), "run_completed": (("revisionId", "manifestSha256", "completionCommitId"), ()),
}
LISTS = {"task.attemptIds": "ids", "run.taskRefs": "task_refs", "run.attemptRefs": "attempt_refs"}


def _places() -> dict[str, str]:
    """The column of each field: the first that no field of the same event type has; fields of many types first."""
    out: dict[str, str] = {}
    for i, letter in enumerate("tn"):
        of: dict[str, set[str]] = {}
        for kind, reads in READS.items():
            for field in reads[i]:
                of.setdefault(field, set()).add(kind)
        taken: list[set[str]] = []
        for field, kinds in sorted(of.items(), key=lambda x: -len(x[1])):
            at = next((n for n, held in enumerate(taken) if not held & kinds), len(taken))
            taken[at:] = [taken[at] | kinds, *taken[at + 1 :]] if at < len(taken) else [set(kinds)]
            out[field] = f"{letter}{at}"
    return out


PLACES = _places()


def p(field: str) -> Column:
    """A payload's field; of an event of another type, the column has another meaning."""
    return F.col(LISTS.get(field) or PLACES[field])


def _raw(field: str) -> Column:
    return F.col(f"p.{field}" if field not in ("from", "to") else f"p.`{field}`")


def yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def no(c: Column) -> Column:
    return ~yes(c)


def prior(df: DataFrame, slots: list[str], keys: tuple[str, ...] = ("run", "key"), keep: Column | None = None) -> DataFrame:
    """The rows of ``df`` that ``keep`` (of the slots as they are) lets through, with each slot replaced by the last value that an earlier row of the same keys has set (is not null).

    A key's rows of one chunk meet in one task, once; only keys of several chunks are looked up again.
    """
    part = [*keys, "chunk"]
    df = df.withColumn("chunk", F.floor(F.col("seq") / CHUNK)).repartition(*part)
    told = df.groupBy(*part).agg(*[F.max_by(s, F.when(F.col(s).isNotNull(), F.col("seq"))).alias(s) for s in slots])
    before = W.partitionBy(*keys).orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    entry = told.select(*[F.col(k).alias(f"_{k}") for k in part], *[F.last(s, ignorenulls=True).over(before).alias(f"_{s}") for s in slots])
    entry = entry.filter(reduce(lambda a, b: a | b, [F.col(f"_{s}").isNotNull() for s in slots]))
    within = W.partitionBy(*part).orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    seen = df.withColumns({f"_in_{s}": F.last(s, ignorenulls=True).over(within) for s in slots})
    if keep is not None:
        seen = seen.filter(keep)
    seen = seen.join(entry, reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_{k}") for k in part]), "left")
    return seen.select(*[c for c in df.columns if c != "chunk" and c not in slots], *[F.coalesce(f"_in_{s}", f"_{s}").alias(s) for s in slots])


def _is(*types: str) -> Column:
    return F.col("type").isin(*types)


def _cases(cases: dict[str, Column]) -> Column:
    """By event type."""
    (kind, value), *rest = cases.items()
    return reduce(lambda out, x: out.when(F.col("type") == x[0], x[1]), rest, F.when(F.col("type") == kind, value))


def parsed(events: DataFrame) -> DataFrame:
    """Rows (run, seq, type, lacks, columns of fields): ``run`` names the run, rows without a run_id too; ``lacks`` a payload without what its rules need."""
    read = events.select(
        F.coalesce(F.concat(F.lit("r"), F.col("run_id").cast("string")), F.lit("")).alias("run"), F.col("seq").cast("long").alias("seq"), "type",
        F.from_json(F.col("payload").cast("string"), PAYLOAD).alias("p"))
    status, told = _raw("request.status"), _raw("request")
    outcome = (
        F.when(status == "success", told["responseSha256"].isNotNull() & (told["responseFile"]["sha256"] == told["responseSha256"])
               & (told["responseFile"]["relativePath"] == F.concat(F.lit(".state/request-payloads/"), told["responseSha256"]))
               & (told["responseFile"]["decodedBytes"] == told["decodedBytes"]) & told["errorClass"].isNull())
        .when(status == "partial", told["errorClass"].isNotNull())
        .otherwise(told["responseSha256"].isNull() & told["responseFile"].isNull() & told["errorClass"].isNotNull()))
    made = {
        "blocker": F.when(_raw("blocker").isNotNull(), F.lit("")), "attempt.same": _digest("attempt", SAME_ATTEMPT), "intent.same": _digest("intent", SAME_REQUEST),
        "request.same": _digest("request", SAME_REQUEST), "request.holds": outcome.cast("long")}
    of: dict[str, dict[str, list[str]]] = {}
    for kind, (texts, numbers) in READS.items():
        for field in (*texts, *numbers):
            of.setdefault(PLACES[field], {}).setdefault(field, []).append(kind)
    places = [reduce(lambda out, x: out.when(_is(*x[1]), made.get(x[0], _raw(x[0]))), fields.items(), F.when(F.lit(False), None)).cast("string" if c[0] == "t" else "long").alias(c) for c, fields in sorted(of.items())]
    lists = [_raw(field).alias(c) for field, c in LISTS.items()]
    lacks = {kind: reduce(lambda x, y: x | y, [_raw(n).isNull() for n in names]) for kind, names in NEEDS.items() if names}
    return stored(read.select("run", "seq", "type", (F.col("p").isNull() | yes(_cases(lacks))).alias("lacks"), *places, *lists))


def with_run(events: DataFrame) -> DataFrame:
    """Adds ``r``, the run as it stands before each event: state, epoch, cancel and so on."""
    made, moved, resumed, cancelled, done = (_is(x) for x in ("run_created", "state_changed", "resume_epoch_started", "cancel_requested", "run_completed"))
    value = lambda c: F.struct(c.alias("v"))  # noqa: E731 - a null is a value too
    no_cancel = F.struct(F.lit(None).cast("long").alias("seq"), F.lit(None).cast("string").alias("reason"))
    slots = {
        "prev": F.col("seq"), "run": F.when(made, p("run.runId")), "depth": F.when(made, p("run.depth")),
        "state": F.when(made, p("run.state")).when(moved, p("to")).when(done, F.lit("completed")),
        "blocker": F.when(made, value(p("run.blocker.code"))).when(moved, value(p("blocker.code"))).when(done, value(F.lit(None).cast("string"))),
        "checkpoint": F.when(made, value(p("run.checkpointStage"))).when(moved & p("to").isin(*CHECKPOINTS), value(p("to"))).when(resumed & p("checkpointStage").isNotNull(), value(p("checkpointStage"))),
        "epoch": F.when(made, F.lit(0).cast("long")).when(resumed, p("executionEpoch")),
        "cancel": F.when(cancelled, F.struct(F.col("seq").alias("seq"), p("reason").alias("reason"))).when(made | resumed, no_cancel),
        "resuming": F.when(resumed, F.lit(True)).when(moved, F.lit(False)),
    }
    told = [c for c in events.columns if c not in ("run", "seq")]
    seen = prior(events.select("run", "seq", *told, *[v.alias(f"r_{k}") for k, v in slots.items()]), [f"r_{k}" for k in slots], ("run",))
    r = F.struct(
        *[F.col(f"r_{k}").alias(k) for k in ("prev", "run", "depth", "state")], F.col("r_blocker.v").alias("blocker"), F.col("r_checkpoint.v").alias("checkpoint"),
        F.coalesce("r_epoch", F.lit(0).cast("long")).alias("epoch"), F.col("r_cancel.seq").alias("cancel_seq"), F.col("r_cancel.reason").alias("reason"), yes(F.col("r_resuming")).alias("resuming"))
    return seen.select("run", "seq", *told, r.alias("r"))


def gone(epoch: Column) -> Column:
    """Whether an epoch had been cancelled: a later one follows its cancel only."""
    return yes((F.col("r.epoch") > epoch) | ((F.col("r.epoch") == epoch) & F.col("r.cancel_seq").isNotNull()))


def _digest(record: str, fields: tuple[str, ...]) -> Column:
    return F.to_json(F.struct(*[_raw(f"{record}.{f}").alias(f) for f in fields]), {"ignoreNullFields": "false"})


#: What the attempts of one operation, and the requests of one series, have in common.
SAME_ATTEMPT = ("runId", "taskId", "attemptKind", "providerModel", "promptTemplateSha256", "logicalInputSha256", "toolAllowlist", "deadlineAt", "replayPolicy")
SAME_REQUEST = ("logicalRequestId", "replayPolicy", "provider", "operation", "accessPolicySha256", "normalizedInput")


def _pair(a: Column, b: Column) -> Column:
    """A text that no other pair has; nulls are values too."""
    a, b = a.cast("string"), b.cast("string")
    return F.concat(F.coalesce(F.concat(F.length(a).cast("string"), F.lit(":"), a), F.lit("-")), F.coalesce(F.concat(F.lit(":"), b), F.lit("-")))


def _lists(rows: list[tuple[str, Column]], kind: str) -> Column:
    """The rows of an event's own type, as one list."""
    of: dict[str, list[Column]] = {}
    for name, row in rows:
        of.setdefault(name, []).append(row)
    return F.inline(_cases({name: F.array(*own) for name, own in of.items()}).cast(f"array<struct<{kind}>>"))


def _facts(events: DataFrame) -> DataFrame:
    """Rows (run, space, key, fact): what events name for the first time."""

    def fact(kind: str, space: str, key: Column, **tells: Column) -> tuple[str, Column]:
        told = F.struct(F.col("seq").alias("seq"), *[(tells[f] if f in tells else F.lit(None)).cast("long" if f in "nm" else "string").alias(f) for f in FACT])
        return kind, F.struct(F.lit(space).alias("space"), key.cast("string").alias("key"), told.alias("fact"))

    def asked(record: str) -> dict[str, Column]:
        return {
            "a": p("attemptId"), "b": p(f"{record}.logicalRequestId"), "c": p(f"{record}.replayPolicy"), "d": p(f"{record}.requestId"), "e": p(f"{record}.same"),
            "n": p(f"{record}.physicalAttemptOrdinal"), "m": p(f"{record}.executionEpoch")}

    epoch = F.col("r.epoch")
    each = [
        fact("identity_reserved", "reserved", _pair(p("kind"), p("id"))),
        fact("dispatch_intent", "attempt", p("attempt.attemptId"), a=p("attempt.taskId"), b=p("attempt.logicalOperationId"), c=p("attempt.replayPolicy"), d=p("attempt.retryOfAttemptId"),
             n=p("attempt.attemptOrdinal"), m=p("attempt.executionEpoch")),
        fact("dispatch_intent", "operation", p("attempt.logicalOperationId"), e=p("attempt.same")),
        fact("result_recorded", "transaction", p("transactionId"), a=p("attemptId")),
        fact("records_committed", "records", p("transactionId")),
        fact("attempt_committed", "committed", p("attemptId")),
        fact("retry_scheduled", "schedule", p("scheduleId"), a=F.lit("attempt"), b=p("logicalOperationId"), c=p("failedAttemptId"), n=p("nextAttemptOrdinal"), m=epoch),
        fact("request_retry_scheduled", "schedule", p("scheduleId"), a=F.lit("request"), b=p("logicalRequestId"), c=p("failedRequestId"), n=p("nextPhysicalAttemptOrdinal"), m=epoch),
        fact("retry_started", "start", p("scheduleId")),
        fact("retry_started", "started", p("attemptId"), b=p("logicalOperationId"), n=p("attemptOrdinal"), m=epoch),
        fact("request_retry_started", "start", p("scheduleId")),
        fact("request_retry_started", "started-request", p("requestId"), a=p("attemptId"), b=p("logicalRequestId"), n=p("physicalAttemptOrdinal")),
        fact("request_intent_recorded", "request", p("intent.requestId"), **asked("intent")),
        fact("request_intent_recorded", "intent", F.col("seq"), **asked("intent")),
        fact("request_intent_recorded", "series", _pair(p("intent.logicalRequestId"), p("intent.physicalAttemptOrdinal")), d=p("intent.requestId")),
        fact("request_result_recorded", "result", p("intentLedgerSeq")),
        fact("request_result_recorded", "outcome", p("request.requestId"), a=p("request.status")),
        *[fact(kind, "journal", _pair(p("attemptId"), p("journalEntrySha256"))) for kind in JOURNALED],
        fact("revision_committed", "revision", p("revisionId"), a=p("manifestSha256"), b=p("completionCommitId")),
    ]
    shape = "seq: bigint, " + ", ".join(f"{f}: {'bigint' if f in 'nm' else 'string'}" for f in FACT)
    told = events.select("run", _lists(each, f"space: string, key: string, fact: struct<{shape}>")).filter("key is not null")
    owner = F.struct(F.col("seq").alias("seq"), *[(p("task.taskId") if f == "a" else F.lit(None)).cast("long" if f in "nm" else "string").alias(f) for f in FACT])
    owners = events.filter(_is("task_upserted")).select("run", F.lit("owner").alias("space"), F.explode(p("task.attemptIds")).alias("key"), owner.alias("fact"))
    every = told.unionByName(owners)
    # stored, so that a join with many rows of one key can be split
    return stored(every.groupBy("run", "space", "key").agg(F.min_by("fact", "fact.seq").alias("fact")))


def _asks(events: DataFrame) -> DataFrame:
    """Rows (run, seq, slot, space, key, at): the facts that each event's rules look up; ``at`` numbers a task's attempts."""

    def ask(kind: str, slot: str, space: str, key: Column) -> tuple[str, Column]:
        return kind, F.struct(F.lit(slot).alias("slot"), F.lit(space).alias("space"), key.cast("string").alias("key"))

    def held(kind: str, what: str, name: Column) -> tuple[str, Column]:
        return ask(kind, "reserved", "reserved", _pair(F.lit(what), name))

    requests = [x for kind in JOURNALED for x in (ask(kind, "attempt", "attempt", p("attemptId")), ask(kind, "journal", "journal", _pair(p("attemptId"), p("journalEntrySha256"))))]
    each = [
        ask("identity_reserved", "reserved", "reserved", _pair(p("kind"), p("id"))),
        held("dispatch_intent", "attempt", p("attempt.attemptId")), ask("dispatch_intent", "own", "attempt", p("attempt.attemptId")),
        ask("dispatch_intent", "owner", "owner", p("attempt.attemptId")), ask("dispatch_intent", "started", "started", p("attempt.attemptId")),
        ask("dispatch_intent", "operation", "operation", p("attempt.logicalOperationId")),
        *[ask(kind, "attempt", "attempt", p("attemptId")) for kind in ("dispatch_started", "attempt_usage_recorded", "result_recorded", "attempt_committed", "attempt_failed")],
        held("result_recorded", "transaction", p("transactionId")), ask("result_recorded", "transaction", "transaction", p("transactionId")),
        *[ask(kind, slot, slot, p("transactionId")) for kind in ("records_committed", "attempt_committed") for slot in ("transaction", "records")],
        ask("retry_scheduled", "attempt", "attempt", p("failedAttemptId")), held("retry_scheduled", "retry-schedule", p("scheduleId")), ask("retry_scheduled", "schedule", "schedule", p("scheduleId")),
        ask("retry_started", "schedule", "schedule", p("scheduleId")), ask("retry_started", "start", "start", p("scheduleId")), ask("retry_started", "started", "started", p("attemptId")),
        held("retry_started", "attempt", p("attemptId")), ask("retry_started", "own", "attempt", p("attemptId")),
        *requests,
        held("request_intent_recorded", "request", p("intent.requestId")), ask("request_intent_recorded", "own", "request", p("intent.requestId")),
        ask("request_intent_recorded", "started", "started-request", p("intent.requestId")), ask("request_intent_recorded", "before", "request", p("intent.retryOfRequestId")),
        ask("request_intent_recorded", "series", "series", _pair(p("intent.logicalRequestId"), p("intent.physicalAttemptOrdinal"))),
        ask("request_intent_recorded", "series_before", "series", _pair(p("intent.logicalRequestId"), p("intent.physicalAttemptOrdinal") - 1)),
        *[ask(kind, "owner", "owner", p("attemptId")) for kind in ("request_intent_recorded", "request_retry_started")],
        ask("request_result_recorded", "before", "intent", p("intentLedgerSeq")), ask("request_result_recorded", "own", "result", p("intentLedgerSeq")),
        held("request_retry_scheduled", "retry-schedule", p("scheduleId")), ask("request_retry_scheduled", "schedule", "schedule", p("scheduleId")),
        ask("request_retry_scheduled", "before", "request", p("failedRequestId")), ask("request_retry_scheduled", "outcome", "outcome", p("failedRequestId")),
        ask("request_retry_started", "schedule", "schedule", p("scheduleId")), ask("request_retry_started", "start", "start", p("scheduleId")),
        held("request_retry_started", "request", p("requestId")), ask("request_retry_started", "own", "request", p("requestId")),
        ask("request_retry_started", "started", "started-request", p("requestId")),
        held("revision_committed", "revision", p("revisionId")), ask("revision_committed", "own", "revision", p("revisionId")), ask("run_completed", "own", "revision", p("revisionId")),
    ]
    one = events.select("run", "seq", _lists(each, "slot: string, space: string, key: string")).filter("key is not null").withColumn("at", F.lit(-1))
    listed = events.filter(_is("task_upserted")).select("run", "seq", F.posexplode(p("task.attemptIds")).alias("at", "id"))
    four = F.array(*[F.struct(F.lit(f"task_{s}").alias("slot"), F.lit(s).alias("space"), (_pair(F.lit("attempt"), F.col("id")) if s == "reserved" else F.col("id")).alias("key")) for s in ("reserved", "owner", "attempt", "committed")])
    return one.unionByName(listed.select("run", "seq", "at", F.inline(four)).select("run", "seq", "slot", "space", "key", "at"))


def found(slot: str) -> Column:
    """The fact that an event has looked up under ``slot``; null where none came before it."""
    return F.get("l", (F.array_position("l.slot", slot) - 1).cast("int"))


def f(name: str) -> Column:
    """A looked-up fact, ``slot``, or what it tells, ``slot.field``; ``free``, ``alien`` and ``done`` are told of all attempts of a task."""
    places = lambda slot, more=None: F.transform(F.filter("l", lambda x: (x["slot"] == f"task_{slot}") if more is None else (x["slot"] == f"task_{slot}") & more(x)), lambda x: x["at"])
    task, size = p("task.taskId"), F.size(p("task.attemptIds"))
    if name == "free":  # the first that is not reserved
        return F.when(size > 0, F.array_min(F.array_except(F.sequence(F.lit(0), size - 1), F.coalesce(places("reserved"), F.expr("cast(array() as array<int>)")))))
    if name == "alien":  # the first of another task
        return F.array_min(places("owner", lambda x: x["a"] != task))
    if name == "done":  # whether one is committed
        return F.arrays_overlap(places("attempt", lambda x: x["a"] == task), places("committed"))
    slot, _, field = name.partition(".")
    return found(slot)[field] if field else found(slot)["slot"]


def with_facts(events: DataFrame, facts: DataFrame) -> DataFrame:
    """Adds ``l``, the list of the earlier facts that each event's rules look up (slot, at, and what they tell)."""
    asks = _asks(events).alias("q")
    same = (F.col("q.run") == F.col("w.run")) & (F.col("q.space") == F.col("w.space")) & (F.col("q.key") == F.col("w.key"))
    met = asks.join(facts.alias("w"), same).filter(F.col("w.fact.seq") < F.col("q.seq"))
    met = met.select("q.run", "q.seq", F.struct("q.slot", "q.at", *[F.col(f"w.fact.{x}").alias(x) for x in ("seq", *FACT)]).alias("x"))
    # an event's rows are few and meet in one task, so nothing is gathered before
    return _meet(events, stored(met.repartition("run", "seq").groupBy("run", "seq").agg(F.collect_list("x").alias("l"))), "l")


def _once(df: DataFrame, slots: list[str], out: str) -> DataFrame:
    """One row (run, seq, out) an event from rows of its asked keys; stored, so that their shuffles go before events are met."""
    some = df.filter(reduce(lambda a, b: a | b, [F.col(s).isNotNull() for s in slots]))
    return stored(some.repartition("run", "seq").groupBy("run", "seq").agg(F.struct(*[F.any_value(s, True).alias(s) for s in slots]).alias(out)))


def _meet(events: DataFrame, told: DataFrame, out: str) -> DataFrame:
    same = (F.col("e.run") == F.col("t.run")) & (F.col("e.seq") == F.col("t.seq"))
    return events.alias("e").join(told.alias("t"), same, "left").select("e.*", f"t.{out}")


def _rows(events: DataFrame, kinds: dict[str, str], rows: list[tuple[Column, dict[str, Column]]]) -> DataFrame:
    """Rows (run, seq, key, slots), up to one an event of each of ``rows`` (key, what it sets)."""
    each = [F.struct(key.alias("key"), *[(own[n] if n in own else F.lit(None)).cast(t).alias(n) for n, t in kinds.items()]) for key, own in rows]
    return events.select("run", "seq", F.inline(F.array(*each))).filter("key is not null")


def attempts(events: DataFrame) -> DataFrame:
    """Rows (run, seq, a): of the attempt that an event is about, what failed, ran again or had a result before; of its journal and retry edge, the last number and epoch."""
    about = _cases({
        **dict.fromkeys(("dispatch_started", "attempt_usage_recorded", "result_recorded", "attempt_committed", "attempt_failed", "request_intent_recorded", "request_retry_started"), p("attemptId")),
        "dispatch_intent": p("attempt.attemptId"), "records_committed": f("transaction.a"), "retry_scheduled": p("failedAttemptId"), "request_retry_scheduled": f("before.a")})
    record = F.struct(p("attempt.taskId").alias("task"), p("attempt.logicalOperationId").alias("operation"), p("attempt.executionEpoch").alias("epoch"))
    sets = {
        "record": F.when(_is("dispatch_intent"), record), "failed": F.when(_is("attempt_failed"), p("state")),
        "result": F.when(_is("result_recorded"), F.struct(p("transactionId").alias("transaction"), F.col("seq").alias("seq")))}
    kinds = {
        "record": "struct<task:string,operation:string,epoch:bigint>", "failed": "string", "result": "struct<transaction:string,seq:bigint>", "again": "boolean", "journal_seq": "bigint", "edge": "bigint"}
    edge = _cases({
        "retry_scheduled": F.concat(F.lit("e:a"), _pair(p("logicalOperationId"), _pair(p("failedAttemptId"), p("nextAttemptOrdinal")))),
        "request_retry_scheduled": F.concat(F.lit("e:r"), _pair(p("failedRequestId"), p("nextPhysicalAttemptOrdinal")))})
    every = _rows(events, kinds, [
        (F.concat(F.lit("a:"), about), sets), (F.when(_is("dispatch_intent"), F.concat(F.lit("a:"), p("attempt.retryOfAttemptId"))), {"again": F.lit(True)}),
        (F.when(_is(*JOURNALED), F.concat(F.lit("j:"), p("attemptId"))), {"journal_seq": p("journalLocalSeq")}), (edge, {"edge": F.col("r.epoch")})])
    return _once(prior(every, list(kinds), keep=F.col("again").isNull()), list(kinds), "a")


def late() -> Column:
    """Whether a result comes after its attempt was superseded, ran again or was cancelled."""
    return _is("result_recorded") & (yes(F.col("a.failed") == "superseded") | yes(F.col("a.again")) | gone(f("attempt.m")))


def phases(events: DataFrame) -> DataFrame:
    """Rows (run, seq, s): phase and failure of the event's attempt, its task, its operation."""
    superseded = p("state") == "superseded"
    phase = _cases({
        "dispatch_intent": F.lit("intent"), "dispatch_started": F.lit("started"), "result_recorded": F.when(late(), "quarantined").otherwise("result"), "records_committed": F.lit("records"),
        "attempt_committed": F.lit("committed"),
        "attempt_failed": F.when(superseded & F.col("a.result").isNotNull() & no(F.col("a.failed") == "retryable-failed"), "quarantined").otherwise("failed")})
    failure = _cases({"result_recorded": F.when(late(), "superseded"), "attempt_failed": p("state")})
    about = _cases({
        **dict.fromkeys(("dispatch_started", "result_recorded", "attempt_committed", "attempt_failed", "request_intent_recorded", "request_retry_started"), p("attemptId")),
        "dispatch_intent": p("attempt.attemptId"), "records_committed": f("transaction.a"), "retry_scheduled": p("failedAttemptId"), "request_retry_scheduled": f("before.a")})
    task = _cases({
        "task_upserted": p("task.taskId"), "dispatch_intent": p("attempt.taskId"), "request_retry_scheduled": F.col("a.record.task"),
        **dict.fromkeys(("request_intent_recorded", "request_retry_started"), f("attempt.a"))})
    operation = _cases({
        "dispatch_intent": p("attempt.logicalOperationId"), "attempt_committed": F.col("a.record.operation"), **dict.fromkeys(("retry_scheduled", "retry_started"), p("logicalOperationId"))})
    attempt_slots = {"phase": phase, "failure": failure, "late_result": F.when(_is("result_recorded"), late())}
    task_slots = {"task": F.when(_is("task_upserted"), F.struct(p("task.revision").alias("revision"), p("task.state").alias("state"), p("task.attemptIds").alias("attempts")))}
    operation_slots = {
        "last": F.when(_is("dispatch_intent"), F.struct(p("attempt.attemptId").alias("id"), p("attempt.attemptOrdinal").alias("ordinal"))),
        "pending": F.when(_is("retry_scheduled"), F.col("r.epoch")).when(_is("retry_started"), F.lit(-1).cast("long")), "closed": F.when(_is("attempt_committed"), F.lit(True))}
    kinds = {"phase": "string", "failure": "string", "late_result": "boolean", "task": "struct<revision:bigint,state:string,attempts:array<string>>", "last": "struct<id:string,ordinal:bigint>", "pending": "bigint", "closed": "boolean"}
    every = _rows(events, kinds, [(F.concat(F.lit(f"{letter}:"), key), own) for letter, key, own in (("a", about, attempt_slots), ("t", task, task_slots), ("o", operation, operation_slots))])
    return _once(prior(every, list(kinds)), list(kinds), "s")


def _rules() -> dict[str, list[tuple[Column, str]]]:
    """By event type, in order: what breaks a rule, and its code."""
    a, s, r = (lambda x, n=n: F.col(f"{n}.{x}") for n in "asr")
    not_reserved, unknown = f("reserved").isNull(), (f("attempt").isNull(), "attempt-not-found")
    ended = r("state").isin("completed", "cancelled")
    resuming = (r("resuming"), "resume-transition-pending")
    here_cancelled = r("cancel_seq").isNotNull()
    journal = [
        (yes(p("journalLocalSeq").between(1, a("journal_seq"))), "request-journal-position"), (f("journal").isNotNull(), "request-journal-hash"),
        (no(p("journalLocalSeq") == F.coalesce(a("journal_seq"), F.lit(0)) + 1), "request-journal-sequence")]
    times = F.size(F.filter(s("task.attempts"), lambda x: x == p("attemptId")))
    live = [
        (no(s("phase") == "started") | s("failure").isNotNull(), "request-target-state"),
        (no(s("task.state") == "running") | no(times == 1) | no(f("owner.a") == f("attempt.a")), "request-target-task"),
        (no(f("attempt.m") == r("epoch")) | gone(f("attempt.m")), "request-target-epoch")]
    to, at, stage = p("to"), r("state"), r("checkpoint")
    named = F.when(to == "failed", p("blocker").isNotNull()).otherwise(p("blocker").isNull() | (to == "paused"))
    special = (
        F.when((at == "researching") & (to == "synthesizing"), r("depth") == "quick").when((at == "recovering") & to.isin(*CHECKPOINTS), to == stage)
        .when((at == "failed") & (to == "recovering"), r("blocker").startswith(RETRYABLE)).otherwise(F.lit(True)))
    back = (at == "paused") & (to == "recovering")
    ids = p("task.attemptIds")
    had = F.coalesce(s("task.attempts"), F.array().cast("array<string>"))
    ordinal = p("attempt.attemptOrdinal")
    linked = (
        (p("attempt.logicalOperationId") == f("started.b")) & (ordinal == f("started.n")) & (p("attempt.retryOfAttemptId") == s("last.id")) & (p("attempt.replayPolicy") == "safe-read")
        & (f("started.m") == p("attempt.executionEpoch")) & (f("operation.e") == p("attempt.same")))
    expected = F.coalesce(s("last.ordinal"), F.lit(0)) + 1
    again = ordinal > 1
    first = p("intent.physicalAttemptOrdinal") == 1
    request_link = (
        (f("started.a") == p("intent.attemptId")) & (f("started.n") == p("intent.physicalAttemptOrdinal")) & (f("started.b") == p("intent.logicalRequestId"))
        & (f("series_before.d") == p("intent.retryOfRequestId")) & (f("before.e") == p("intent.same")))
    same_intent = (
        (f("before.d") == p("request.requestId")) & (f("before.a") == p("request.attemptId")) & (f("before.m") == p("request.executionEpoch"))
        & (f("before.n") == p("request.physicalAttemptOrdinal")) & (f("before.e") == p("request.same")))
    return {
        "identity_reserved": [(f("reserved").isNotNull(), "duplicate-reservation")],
        "run_created": [
            (r("run").isNotNull(), "duplicate-run"), (no(p("run.executionEpoch") == 0), "initial-epoch"), (no(p("run.state") == "created"), "initial-run-state")],
        "state_changed": [
            (at.isNull(), "run-not-found"), (ended, "run-terminal"), (no(p("from") == at), "run-state-from"), (to == "completed", "completion-event-required"),
            (no(allowed(RUN_MOVES, at, to) & special & named), "run-transition"), (yes(r("reason") == "user-abandon") & (to != "cancelled"), "abandon-transition"),
            (yes(r("reason") != "user-abandon") & ~to.isin("paused", "cancelled") & ~r("resuming"), "cancel-transition"), (back != r("resuming"), "resume-transition")],
        "task_upserted": [
            (no(p("task.revision") == F.coalesce(s("task.revision"), F.lit(0)) + 1), "task-revision"), (yes(s("task.state").isin("resolved", "cancelled")), "task-terminal"),
            (s("task").isNotNull() & ~allowed(TASK_MOVES, s("task.state"), p("task.state")), "task-transition"),
            (no(F.slice(ids, 1, F.size(had)) == had) | (F.size(F.array_distinct(ids)) != F.size(ids)), "task-attempt-history"),
            (yes(f("free") <= F.coalesce(f("alien"), f("free"))), "task-attempt-not-reserved"), (f("alien").isNotNull(), "task-attempt-owner"),
            ((p("task.state") == "resolved") & (no(f("done")) | p("task.resolution").isNull()), "task-resolution")],
        "dispatch_intent": [
            resuming, (no(p("attempt.runId") == r("run")), "run-not-found"), (s("task").isNull(), "task-not-found"), (no(s("task.state") == "running"), "dispatch-task-state"),
            (no(F.size(F.filter(s("task.attempts"), lambda x: x == p("attempt.attemptId"))) == 1) | no(f("owner.a") == p("attempt.taskId")), "dispatch-task-owner"),
            (not_reserved, "attempt-not-reserved"), (f("own").isNotNull(), "duplicate-attempt"), (no(p("attempt.state") == "intent-recorded"), "attempt-initial-state"),
            (no(p("attempt.executionEpoch") == r("epoch")) | here_cancelled, "attempt-epoch"), (f("started").isNotNull() & no(linked), "retry-dispatch-link"),
            (no(ordinal == expected), "attempt-ordinal"), (no(p("attempt.retryOfAttemptId").eqNullSafe(s("last.id"))), "retry-backlink"),
            (again & no(f("operation.e") == p("attempt.same")), "retry-immutable"), (again & f("started").isNull(), "retry-start-missing")],
        "dispatch_started": [unknown, (no(s("phase") == "intent"), "attempt-transition")],
        "attempt_usage_recorded": [unknown],
        "result_recorded": [
            unknown, (not_reserved, "transaction-not-reserved"), (f("transaction").isNotNull(), "duplicate-transaction"),
            (a("result").isNotNull() | yes(s("phase").isin("committed", "records")), "duplicate-result"), (~late() & no(s("phase") == "started"), "attempt-transition")],
        "records_committed": [
            (f("transaction").isNull(), "transaction-not-found"), (yes(s("late_result")), "transaction-quarantined"), (no(f("transaction.seq") == p("sourceResultSeq")), "source-result-link"),
            (f("records").isNotNull(), "duplicate-records-commit"), (no(s("phase") == "result"), "attempt-transition")],
        "attempt_committed": [
            unknown, (a("result").isNull() | f("records").isNull(), "records-not-committed"),
            (no(a("result.transaction") == p("transactionId")) | no(a("result.seq") == p("sourceResultSeq")) | no(f("transaction.a") == p("attemptId")), "commit-link"),
            (no(f("attempt.a") == p("taskId")), "commit-task"), (no(s("phase") == "records"), "attempt-transition"), (yes(s("closed")), "duplicate-operation-commit")],
        "attempt_failed": [
            unknown, ((p("state") == "superseded") & no(a("again")), "superseded-without-replacement"), (yes(s("phase").isin("committed", "records")), "attempt-transition"),
            (s("failure").isNotNull() & no((s("failure") == "retryable-failed") & (p("state") == "superseded")), "duplicate-failure"),
            (s("failure").isNull() & yes(s("phase") == "result") & (p("state") != "superseded"), "attempt-transition")],
        "retry_scheduled": [
            resuming, (not_reserved, "schedule-not-reserved"), (f("schedule").isNotNull(), "schedule-namespace"), unknown,
            (no(s("failure") == "retryable-failed") | no(f("attempt.c") == "safe-read"), "retry-predecessor"),
            (no(f("attempt.b") == p("logicalOperationId")) | no(p("nextAttemptOrdinal") == f("attempt.n") + 1), "retry-edge"), (here_cancelled, "retry-after-cancel"),
            (a("edge").isNotNull() & ~gone(a("edge")), "duplicate-retry-edge"), (yes(p("nextAttemptOrdinal") <= s("last.ordinal")), "duplicate-retry-edge"),
            (yes(s("pending") >= 0) & ~gone(s("pending")), "multiple-pending-schedules")],
        "retry_started": [
            resuming, (no(f("schedule.a") == "attempt"), "schedule-namespace"), (f("start").isNotNull() | f("started").isNotNull(), "duplicate-retry-start"),
            (no(p("scheduledFromSeq") == f("schedule.seq")), "retry-schedule-seq"),
            (no(p("logicalOperationId") == f("schedule.b")) | no(p("attemptOrdinal") == f("schedule.n")), "retry-start-link"), (not_reserved | f("own").isNotNull(), "retry-attempt-identity"),
            (gone(f("schedule.m")) | no(f("schedule.m") == r("epoch")), "retry-after-cancel")],
        "cancel_requested": [(r("run").isNull() | no(p("executionEpoch") == r("epoch")), "cancel-epoch"), (here_cancelled, "duplicate-cancel")],
        "resume_epoch_started": [
            (yes(ended), "run-terminal"), (no(at == "paused"), "resume-state"), (no(p("priorEpoch") == r("epoch")) | no(p("executionEpoch") == r("epoch") + 1), "resume-epoch"),
            (no(p("priorCancelSeq") == r("cancel_seq")), "resume-cancel-link"), (no(r("reason") != "user-abandon"), "resume-terminal-cancel"),
            (no(p("checkpointStage").eqNullSafe(stage)), "resume-checkpoint")],
        "request_intent_recorded": [
            resuming, unknown, *journal, (no(p("intent.attemptId") == p("attemptId")) | no(p("intent.executionEpoch") == f("attempt.m")), "request-owner"),
            (not_reserved | f("own").isNotNull(), "request-identity"), (first & gone(p("intent.executionEpoch")), "request-cancelled"),
            (first & (p("intent.retryOfRequestId").isNotNull() | f("started").isNotNull()), "request-backlink"), *[(~first & broken, code) for broken, code in live],
            (~first & no(request_link), "request-start-link"), (f("series").isNotNull(), "request-ordinal")],
        "request_result_recorded": [
            unknown, *journal, (no(f("before.d") == p("request.requestId")) | f("own").isNotNull(), "request-intent-link"),
            (no(p("request.attemptId") == p("attemptId")) | no(p("request.executionEpoch") == f("attempt.m")) | no(same_intent), "request-intent-mismatch"),
            (no(f("before.a") == p("attemptId")), "request-owner"), (no(p("request.holds") == 1), "request-outcome"), (gone(p("request.executionEpoch")), "request-cancelled")],
        "request_retry_scheduled": [
            resuming, unknown, *journal, (not_reserved | yes(f("schedule.a") == "request"), "request-schedule-identity"), (f("schedule").isNotNull(), "schedule-namespace"),
            (no(f("outcome.a") == "retryable-error") | no(f("before.c") == "safe-read") | no(f("before.b") == p("logicalRequestId"))
             | no(f("before.n") + 1 == p("nextPhysicalAttemptOrdinal")), "request-schedule-link"),
            (yes(s("phase").isin("committed", "quarantined")) | yes(s("failure").isin("cancelled", "terminal-failed", "superseded")), "request-schedule-attempt-state"),
            (no(s("task.state") == "running"), "request-schedule-task-state"), (yes(at.isin("completed", "cancelled", "failed")), "request-schedule-run-state"),
            (no(f("before.a") == p("attemptId")) | no(f("before.m") == f("attempt.m")) | no(f("before.m") == r("epoch")) | here_cancelled, "request-schedule-owner"),
            (a("edge").isNotNull() & ~gone(a("edge")), "request-schedule-link")],
        "request_retry_started": [
            resuming, unknown, *live, *journal, (no(f("schedule.a") == "request"), "schedule-namespace"),
            (f("start").isNotNull() | no(f("schedule.seq") == p("scheduledFromLedgerSeq")) | no(f("schedule.b") == p("logicalRequestId")) | no(f("schedule.n") == p("physicalAttemptOrdinal"))
             | gone(f("schedule.m")) | not_reserved | f("own").isNotNull() | f("started").isNotNull(), "request-retry-start-link")],
        "revision_committed": [(not_reserved, "revision-not-reserved"), (f("own").isNotNull(), "duplicate-revision-commit")],
        "run_completed": [
            (yes(ended), "run-terminal"), (no(at == "synthesizing"), "run-completion-state"), (f("own").isNull(), "revision-not-committed"),
            (no(f("own.a").eqNullSafe(p("manifestSha256"))) | no(f("own.b").eqNullSafe(p("completionCommitId"))), "run-completion-link")],
    }


def judged(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (run, seq, type, columns of fields, late, code) of all events, and the facts; a code says what would be wrong if all before was right."""
    runs = stored(with_run(parsed(events)))
    facts = _facts(runs)
    known = stored(with_facts(runs, facts))
    tried = attempts(known)
    full = _meet(_meet(known, tried, "a"), phases(_meet(known, tried, "a")), "s")
    codes = {kind: F.coalesce(*[F.when(broken, F.lit(f"reducer.{code}")) for broken, code in rules]) for kind, rules in _rules().items()}
    code = (
        F.when(no(F.col("seq") == F.coalesce(F.col("r.prev"), F.lit(0)) + 1), "reducer.sequence").when(no(_is(*NEEDS)), "reducer.unknown-type")
        .when(F.col("lacks"), "reducer.payload").otherwise(_cases(codes)))
    return stored(full.select("run", "seq", "type", *sorted(set(PLACES.values())), *LISTS.values(), late().alias("late"), code.alias("code"))), facts


def fold(events: DataFrame) -> DataFrame:
    """One row a run: the state of its accepted events, and code and number of the first bad one."""
    told, facts = judged(events)
    bad = told.filter("code is not null").groupBy("run").agg(F.min(F.struct("seq", "code")).alias("b"))
    bad = cut(told.select("run").distinct().alias("x").join(bad.alias("y"), (F.col("x.run") == F.col("y.run")), "left").select("x.run", F.col("b.seq").alias("bad_seq"), F.col("b.code").alias("bad_code")))
    good = told.alias("g").join(bad.alias("b"), (F.col("g.run") == F.col("b.run")) & (F.col("b.bad_seq").isNull() | (F.col("g.seq") < F.col("b.bad_seq")))).select("g.*")
    n = lambda cond: F.count_if(cond)
    moved = F.when(_is("run_created"), p("run.state")).when(_is("state_changed"), p("to")).when(_is("run_completed"), F.lit("completed"))
    epoch = F.when(_is("run_created"), F.lit(0).cast("long")).when(_is("resume_epoch_started"), p("executionEpoch"))
    state = good.groupBy("run").agg(
        F.max("seq").alias("seq"), F.max_by(moved, F.when(moved.isNotNull(), F.col("seq"))).alias("state"), F.max_by(epoch, F.when(epoch.isNotNull(), F.col("seq"))).alias("epoch"),
        F.max(F.when(_is("cancel_requested"), p("executionEpoch"))).alias("cancelled_epoch"), n(_is("task_upserted") & (p("task.revision") == 1)).alias("tasks"),
        n(_is("dispatch_intent")).alias("attempts"), n(_is("attempt_committed")).alias("committed"), n(F.col("late")).alias("quarantined"), n(_is("request_intent_recorded")).alias("requests"),
        n(_is("request_result_recorded") & (p("request.status") == "success")).alias("cache_eligible"), n(_is("revision_committed")).alias("revisions"),
        F.max(F.when(_is("run_created"), F.struct("seq", p("run.taskRefs").alias("tasks"), p("run.attemptRefs").alias("attempts")))).alias("origin"))
    state = bad.alias("b").join(state.alias("s"), (F.col("b.run") == F.col("s.run")), "left").select("b.*", *[f"s.{c}" for c in state.columns if c != "run"])
    state = cut(state)

    # schedules that wait: of the epoch in force, not cancelled and not started
    kept = facts.filter(F.col("space").isin("schedule", "start")).alias("k").join(bad.alias("b"), (F.col("k.run") == F.col("b.run")) & (F.col("b.bad_seq").isNull() | (F.col("k.fact.seq") < F.col("b.bad_seq"))))
    waits = kept.groupBy("k.run", "k.key").agg(F.max(F.when(F.col("k.space") == "schedule", F.col("k.fact.m"))).alias("of"), F.count_if(F.col("k.space") == "start").alias("starts")).filter("of is not null and starts = 0")
    waits = waits.groupBy("run", "of").agg(F.count("*").alias("pending"))
    live = F.col("w.of").eqNullSafe(F.coalesce("s.epoch", F.lit(0))) & no(F.col("s.cancelled_epoch") == F.col("s.epoch"))
    state = state.alias("s").join(waits.alias("w"), (F.col("s.run") == F.col("w.run")) & live, "left").select("s.*", F.coalesce("w.pending", F.lit(0)).alias("pending_retries"))

    broken = _broken_refs(state, good)
    state = state.alias("s").join(broken.alias("x"), (F.col("s.run") == F.col("x.run")), "left").select("s.*", "x.ref_code")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    run_id = F.when(F.col("run") != "", F.substring("run", 2, 2**31 - 1)).cast(events.schema["run_id"].dataType).alias("run_id")
    return state.select(
        run_id, zero("seq"), "state", zero("epoch"), zero("tasks"), zero("attempts"), zero("committed"), zero("quarantined"), zero("pending_retries"), zero("requests"),
        zero("cache_eligible"), zero("revisions"), F.coalesce("bad_code", "ref_code").alias("error"), F.coalesce("bad_seq", F.when(F.col("ref_code").isNotNull(), F.col("origin.seq"))).alias("error_seq"))


def _broken_refs(state: DataFrame, good: DataFrame) -> DataFrame:
    """Rows (run, ref_code) of whole logs whose first event refers to a task or attempt that does not end at that revision."""
    whole = state.filter("bad_seq is null and origin is not null")
    refs = whole.select("run", F.lit("task").alias("kind"), F.explode("origin.tasks").alias("x")).select("run", "kind", F.col("x.taskId").alias("id"), "x.revision")
    refs = refs.unionByName(whole.select("run", F.lit("attempt").alias("kind"), F.explode("origin.attempts").alias("x")).select("run", "kind", F.col("x.attemptId").alias("id"), "x.revision"))
    task, attempt = _is("task_upserted"), _is("dispatch_intent")
    ends = good.filter(task | attempt).groupBy("run", F.when(task, "task").otherwise("attempt").alias("kind"), F.when(task, p("task.taskId")).otherwise(p("attempt.attemptId")).alias("id"))
    ends = ends.agg(F.max_by(F.when(task, p("task.revision")).otherwise(p("attempt.revision")), "seq").alias("ends"))
    same = (F.col("q.run") == F.col("d.run")) & (F.col("q.kind") == F.col("d.kind")) & (F.col("q.id") == F.col("d.id"))
    lost = refs.alias("q").join(ends.alias("d"), same, "left").filter(no(F.col("d.ends") == F.col("q.revision")))
    return lost.groupBy("q.run").agg(F.concat(F.lit("reducer.run-"), F.max("q.kind"), F.lit("-ref")).alias("ref_code"))
