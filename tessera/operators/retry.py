"""Retries, budgets and run status derived from ledger events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.functions.identifiers import backoff_ms
from tessera.plans.cut import cut

#: Task states, and the transitions of runs and tasks.
TASK_STATES = ("open", "ready", "running", "blocked", "resolved", "cancelled")
CHECKPOINTS = ("planning", "researching", "verifying", "synthesizing")
RUN_MOVES = {
    "created": ("planning", "cancelled", "failed"),
    "planning": ("researching", "paused", "cancelled", "failed"),
    "researching": ("verifying", "synthesizing", "paused", "cancelled", "failed"),
    "verifying": ("researching", "synthesizing", "paused", "cancelled", "failed"),
    "synthesizing": ("paused", "cancelled", "failed"),
    "recovering": ("planning", "researching", "verifying", "synthesizing", "paused", "cancelled", "failed"),
    "paused": ("recovering", "cancelled", "failed"),
    "failed": ("recovering",),
    "cancelled": (),
    "completed": (),
}
TASK_MOVES = {
    "open": ("open", "ready", "blocked", "cancelled"),
    "ready": ("ready", "running", "blocked", "cancelled"),
    "running": ("running", "ready", "blocked", "resolved", "cancelled"),
    "blocked": ("blocked", "ready", "cancelled"),
    "resolved": (),
    "cancelled": (),
}


def allowed(moves: dict[str, tuple[str, ...]], source: Column, target: Column) -> Column:
    out = F.lit(False)
    for state, to in moves.items():
        if to:
            out = out | ((source == state) & target.isin(*to))
    return F.coalesce(out, F.lit(False))


def move_violations(events: DataFrame, key: str, moves: dict[str, tuple[str, ...]]) -> DataFrame:
    """Rows (key, seq, state, next) of transitions that are not allowed; states without moves take no further revision."""
    by = W.partitionBy(key).orderBy("seq")
    seen = events.withColumn("before", F.lag("state").over(by)).filter("before is not null")
    return seen.filter(~allowed(moves, F.col("before"), F.col("state"))).select(key, "seq", F.col("before").alias("state"), F.col("state").alias("next"))


def run_move_violations(events: DataFrame, key: str) -> DataFrame:
    """Rows (key, seq, state, next) of changes (seq, from, to, blocker, depth, checkpoint) of a run that are not allowed.

    ``blocker`` is the new one; the one in force is that of the change before.  ``checkpoint`` is
    the last stage (planning to synthesizing) that the run had reached before.  A blocker goes
    with failed, which needs one, or with paused; synthesizing follows researching at once only
    in depth quick; recovering goes back to the checkpoint; only a retryable failure recovers.
    """
    by = W.partitionBy(key).orderBy("seq")
    prior = F.lag("blocker").over(by)
    stage = F.when(F.col("to").isin(*CHECKPOINTS), F.col("to"))
    last = F.last(stage, ignorenulls=True).over(by.rowsBetween(W.unboundedPreceding, -1))
    seen = events.withColumns({"prior": prior, "last": F.coalesce(last, "checkpoint")})
    source, target = F.col("from"), F.col("to")
    plain = allowed(RUN_MOVES, source, target)
    special = (
        F.when((source == "researching") & (target == "synthesizing"), F.col("depth") == "quick")
        .when((source == "recovering") & target.isin(*CHECKPOINTS), target == F.col("last"))
        .when((source == "failed") & (target == "recovering"), F.coalesce(F.col("prior").startswith("retryable-"), F.lit(False)))
        .otherwise(F.lit(True)))
    named = F.when(target == "failed", F.col("blocker").isNotNull()).otherwise(F.col("blocker").isNull() | (target == "paused"))
    return seen.filter(~(plain & F.coalesce(special, F.lit(False)) & named)).select(key, "seq", source.alias("state"), target.alias("next"))


def epochs(events: DataFrame, key: str) -> DataFrame:
    """Adds the epoch in force at each event: the last resumed one, 0 before any."""
    by = W.partitionBy(key).orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    return events.withColumn("epoch", F.coalesce(F.last(F.when(F.col("type") == "resume_epoch_started", F.col("new_epoch")), ignorenulls=True).over(by), F.lit(0)))


def quarantined(results: DataFrame, cancels: DataFrame, key: str) -> DataFrame:
    """Results recorded after their epoch was cancelled: kept, never promoted.  Lateness is by sequence."""
    first = cancels.groupBy(key, "epoch").agg(F.min("seq").alias("cancel_seq"))
    return results.join(first, [key, "epoch"], "left").withColumn("late", F.coalesce(F.col("seq") > F.col("cancel_seq"), F.lit(False)))


def schedules(failures: DataFrame) -> DataFrame:
    """Adds kind, code, delay_ms and not_before_ms to failures.

    Columns: next_ordinal, base_ms, most_ms, draw, retry_after_ms, budget_left_ms,
    deadline_left_ms, at_ms, scheduled (whether this retry has a schedule already).  Nothing is
    scheduled once the deadline or the active budget is used up; a schedule is made once.
    """
    c = F.col
    code = F.when(c("deadline_left_ms") <= 0, "retry-deadline-exhausted").when(c("budget_left_ms") <= 0, "retry-budget-exhausted")
    kind = F.when(code.isNotNull(), "blocked").when(c("scheduled"), "already-scheduled").otherwise("scheduled")
    delay = backoff_ms(c("next_ordinal"), c("base_ms"), c("most_ms"), c("draw"), c("retry_after_ms"), F.least("budget_left_ms", "deadline_left_ms"))
    out = failures.withColumn("kind", kind).withColumn("code", code).withColumn("delay_ms", F.when(F.col("kind") == "scheduled", delay))
    return out.withColumn("not_before_ms", c("at_ms") + c("delay_ms"))


def start_issues(starts: DataFrame, planned: DataFrame) -> DataFrame:
    """Starts (schedule_id, seq, at_ms, epoch, cancel_seq) that may not start: unknown, too early, of another or a cancelled epoch, or started before."""
    p = planned.select("schedule_id", F.col("not_before_ms"), F.col("epoch").alias("planned_epoch"))
    nth = F.row_number().over(W.partitionBy("schedule_id").orderBy("seq"))
    seen = starts.withColumn("nth", nth).join(p, "schedule_id", "left")
    code = (
        F.when(F.col("planned_epoch").isNull(), "schedule-not-found").when(F.col("nth") > 1, "duplicate-retry-start")
        .when((F.col("epoch") != F.col("planned_epoch")) | (F.col("seq") > F.col("cancel_seq")), "retry-after-cancel").when(F.col("at_ms") < F.col("not_before_ms"), "retry-not-due"))
    return seen.withColumn("code", code).filter("code is not null").select("schedule_id", "seq", "code")


def valid_budget(limit: Column, used: Column, reserve: Column) -> Column:
    right = F.least(F.lit(600_000.0), F.greatest(F.lit(60_000.0), limit * 0.2), limit * 0.5)
    return F.coalesce((used >= 0) & (limit >= 0) & (reserve == right) & (used <= limit), F.lit(False))


def budget(events: DataFrame, key: str) -> DataFrame:
    """Adds limit_ms, used_ms, reserve_ms in force after each event, and ``code`` where the event breaks the chain.

    Events: type run_created (limit, used, reserve), active_time_checkpoint (total, added), or
    budget_amended (old_limit, old_used, old_reserve and limit, used, reserve).  A checkpoint adds
    to the time used, and its total must be what was used plus what it adds; an amendment replaces
    the budget, must name the one in force and keep the time used.
    """
    by = W.partitionBy(key).orderBy("seq")
    past, now = by.rowsBetween(W.unboundedPreceding, -1), by.rowsBetween(W.unboundedPreceding, 0)
    sets, ticks = F.col("type").isin("run_created", "budget_amended"), F.col("type") == "active_time_checkpoint"
    states = {"limit_ms": F.when(sets, F.col("limit")), "used_ms": F.when(sets, F.col("used")).when(ticks, F.col("total")), "reserve_ms": F.when(sets, F.col("reserve"))}
    out = events.withColumns({f"_was_{k}": F.last(v, ignorenulls=True).over(past) for k, v in states.items()} | {k: F.last(v, ignorenulls=True).over(now) for k, v in states.items()})
    known = F.col("_was_limit_ms").isNotNull()
    same = F.col("old_limit").eqNullSafe(F.col("_was_limit_ms")) & F.col("old_used").eqNullSafe(F.col("_was_used_ms")) & F.col("old_reserve").eqNullSafe(F.col("_was_reserve_ms"))
    sound = (
        F.when(F.col("type") == "run_created", ~known & valid_budget(F.col("limit"), F.col("used"), F.col("reserve")))
        .when(ticks, known & (F.col("total") - F.col("_was_used_ms") == F.col("added")) & (F.col("added") >= 0))
        .when(F.col("type") == "budget_amended", known & same & (F.col("used") == F.col("_was_used_ms")) & valid_budget(F.col("limit"), F.col("used"), F.col("reserve")))
        .otherwise(F.lit(True)))
    return out.withColumn("code", F.when(~F.coalesce(sound, F.lit(False)), "retry.corruption")).drop(*[f"_was_{k}" for k in states])


def latest_failure(failures: DataFrame) -> DataFrame:
    return failures.groupBy("attempt_id").agg(F.max_by("state", "seq").alias("state"), F.max("seq").alias("seq"))


def series_issues(attempts: DataFrame, schedules: DataFrame, fixed: list[str]) -> DataFrame:
    """Issues (path, code) of retry series: attempts of each operation in consecutive ordinals, each from a schedule of the one before.

    ``attempts``: at (place in the input), operation, ordinal, attempt_id, retry_of, envelope, state, replay_policy
    and the columns ``fixed`` that a series keeps.  ``schedules``: at, schedule_id, operation, failed_id, next_ordinal.
    """
    twice = lambda *keys: F.row_number().over(W.partitionBy(*keys).orderBy("at")) > 1
    group = W.partitionBy("operation")
    order = F.struct("ordinal", "at")
    seen = attempts.withColumns({
        "twice_id": twice("attempt_id"), "twice_envelope": twice("envelope"), "twice_ordinal": twice("operation", "ordinal"), "n": F.count("*").over(group), "least": F.min("ordinal").over(group)})
    series = seen.groupBy("operation").agg(
        F.min_by(F.struct(*fixed), order).alias("base"), F.max_by(F.struct("attempt_id", "ordinal", "state"), F.struct("ordinal", -F.col("at"))).alias("last"),
        F.min_by("replay_policy", order).alias("first_policy"), F.min("ordinal").alias("first_ordinal"))
    series = cut(series)
    told = lambda name, field="": F.concat(F.lit(f"/{name}/"), F.col("at").cast("string"), F.lit(field))
    one = lambda bad, path, code: F.when(F.coalesce(bad, F.lit(False)), F.struct(path.alias("path"), F.lit(f"retry.{code}").alias("code")))
    found = lambda df, cases: df.select(F.inline(F.array_compact(F.array(*[one(*c) for c in cases]))))

    before = seen.filter("not twice_ordinal").select(F.col("operation").alias("o"), (F.col("ordinal") + 1).alias("next"), F.col("attempt_id").alias("before_id"), F.col("state").alias("before_state"))
    edges = schedules.groupBy("operation", "failed_id", "next_ordinal").agg(F.count("*").alias("edges"), F.min("at").alias("first_at"))
    linked = seen.join(series.select("operation", "base"), "operation").join(before, (F.col("operation") == F.col("o")) & (F.col("ordinal") == F.col("next")) & ~F.col("twice_ordinal") & (F.col("ordinal") != 1), "left")
    e = edges.select(F.col("operation").alias("eo"), F.col("failed_id").alias("ef"), F.col("next_ordinal").alias("en"), "edges")
    linked = linked.join(e, (F.col("operation") == F.col("eo")) & (F.col("before_id") == F.col("ef")) & (F.col("ordinal") == F.col("en")), "left")
    linked = cut(linked)
    follows = F.col("before_id").isNotNull()
    camel = lambda c: c.split("_")[0] + "".join(x.title() for x in c.split("_")[1:])
    out = found(linked, [
        (F.col("twice_id"), told("attempts", "/attemptId"), "duplicate-attempt-id"), (F.col("twice_envelope"), told("attempts", "/attemptEnvelopeSha256"), "duplicate-envelope"),
        (F.col("twice_ordinal"), told("attempts", "/attemptOrdinal"), "duplicate-ordinal"),
        (((F.col("ordinal") == F.col("least")) & (F.col("least") != 1)) | (~F.col("twice_ordinal") & (F.col("ordinal") > F.col("n"))), told("attempts", "/attemptOrdinal"), "nonconsecutive-ordinal"),
        *[(~F.col(c).eqNullSafe(F.col(f"base.{c}")), told("attempts", f"/{camel(c)}"), "immutable-change") for c in fixed],
        (follows & ~F.col("retry_of").eqNullSafe(F.col("before_id")), told("attempts", "/retryOfAttemptId"), "wrong-backlink"),
        (follows & (F.col("before_state") != "retryable-failed"), told("attempts"), "invalid-predecessor-state"), (follows & (F.coalesce("edges", F.lit(0)) != 1), told("attempts"), "schedule-edge-count")])

    used = linked.filter(follows).select(F.col("operation").alias("uo"), F.col("before_id").alias("uf"), F.col("ordinal").alias("un")).distinct()
    plans = schedules.withColumns({"twice_id": twice("schedule_id"), "twice_edge": twice("operation", "failed_id", "next_ordinal")})
    plans = plans.join(used, (F.col("operation") == F.col("uo")) & (F.col("failed_id") == F.col("uf")) & (F.col("next_ordinal") == F.col("un")), "left").withColumn("used", F.col("uo").isNotNull()).drop("uo", "uf", "un")
    plans = plans.withColumn("waiting", F.count_if(~F.col("used")).over(group)).join(series, "operation", "left")
    known = attempts.select(F.col("operation").alias("ko"), F.col("attempt_id").alias("ka")).distinct()
    plans = plans.join(known, (F.col("operation") == F.col("ko")) & (F.col("failed_id") == F.col("ka")), "left")
    waits, grouped = ~F.col("used"), F.col("last").isNotNull()
    near = (F.col("failed_id") == F.col("last.attempt_id")) & (F.col("next_ordinal") == F.col("last.ordinal") + 1) & (F.col("last.state") == "retryable-failed")
    return out.unionByName(found(plans, [
        (F.col("twice_id"), told("schedules", "/scheduleId"), "duplicate-schedule-id"), (F.col("used") & F.col("twice_edge"), told("schedules"), "duplicate-schedule-edge"),
        (grouped & (F.col("first_ordinal") == 1) & (F.col("first_policy") == "never"), told("schedules"), "never-scheduled"), (grouped & waits & (F.col("waiting") > 1), told("schedules"), "multiple-pending"),
        (grouped & waits & (F.col("waiting") == 1) & ~F.coalesce(near, F.lit(False)), told("schedules"), "non-immediate-pending"),
        (grouped & F.col("ka").isNull(), told("schedules", "/failedAttemptId"), "orphan-failed-attempt"), (~grouped, told("schedules", "/logicalOperationId"), "orphan-logical-operation")]))


def status(tasks: DataFrame, attempts: DataFrame, pending: DataFrame) -> DataFrame:
    """One row: tasks by state over their latest revision, attempts, pending schedules and the next of them."""
    top = tasks.groupBy("task_id").agg(F.max_by("state", "revision").alias("state"))
    counts = top.agg(F.count("*").alias("tasks"), *[F.count_if(F.col("state") == s).alias(s) for s in TASK_STATES])
    tries = attempts.agg(F.count_distinct("attempt_id").alias("attempts"))
    waits = pending.agg(F.count("*").alias("pending"), F.min("not_before").alias("next_at"))
    one = lambda df: df.withColumn("_one", F.lit(1))
    return one(counts).join(one(tries), "_one").join(one(waits), "_one").drop("_one")  # three single rows


def transaction_counts(results: DataFrame, committed: DataFrame, objects: DataFrame) -> DataFrame:
    """Committed, pending and unmaterialised transactions."""
    c = committed.select("transaction_id").distinct().withColumn("c", F.lit(True))
    o = objects.select("transaction_id").distinct().withColumn("o", F.lit(True))
    seen = results.select("transaction_id").distinct().join(c, "transaction_id", "left").join(o, "transaction_id", "left")
    return seen.agg(
        F.count_if("c").alias("committed"), F.count_if(F.col("c").isNull() & F.col("o").isNotNull()).alias("pending"),
        F.count_if(F.col("o").isNull()).alias("unmaterialised"))


def recovery(operations: DataFrame) -> DataFrame:
    """One of nine outcomes for each operation's facts, the first that holds."""
    c = F.col
    early = c("phase").isin("result", "records") & c("transaction_id").isNotNull() & (c("cancel_seq").isNull() | (c("result_seq") < c("cancel_seq")))
    decision = (
        F.when(c("any_committed"), "skip-committed").when(c("attempts") == 0, "not-found").when(c("started_retry"), "resume-started-retry")
        .when(c("active_schedule"), "retry-safe-read").when(c("failure_state").isin("terminal-failed", "cancelled"), "no-action")
        .when(early, "finish-transaction").when(c("cancel_seq").isNotNull() | (c("phase") == "quarantined"), "quarantined")
        .when(c("failure_state") == "superseded", "no-action").when(c("replay_policy") == "never", "block-never").otherwise("needs-retry-schedule"))
    return operations.withColumn("decision", decision)


def as_of(rows: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """Adds to each row (key, seq) the fact's value in force: the last with a smaller or equal seq.

    One union and one window, so neither side is expanded by the other.
    """
    a = rows.select("*", F.lit(1).alias("_row"), F.lit(None).cast(facts.schema["value"].dataType).alias("_value"))
    b = facts.select(*[F.col(c) if c in (key, "seq") else F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns], F.lit(0).alias("_row"), F.col("value").alias("_value"))
    by = W.partitionBy(key).orderBy("seq", "_row").rowsBetween(W.unboundedPreceding, 0)
    return a.unionByName(b).withColumn("value", F.last("_value", ignorenulls=True).over(by)).filter("_row = 1").drop("_row", "_value")


def never_blockers(operations: DataFrame) -> DataFrame:
    """One row: operations whose outcome is uncertain and that may never be replayed."""
    return recovery(operations).agg(F.count_if(F.col("decision") == "block-never").alias("never_blockers"))
