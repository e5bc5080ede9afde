"""Provider requests: outcomes, the intent / result / schedule / start journal, and what records owe to requests.

All checks are joins and windows over the journal; a rule that looks at the past of an event
reads it as a window over the run's sequence, so no run is walked row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

PAYLOADS = ".state/request-payloads/"
IDENTITY = ("logical_request_id", "replay_policy", "provider", "operation", "policy_sha256", "input")


def valid_outcome() -> Column:
    """Success has a stored response with equal digest and size and no error; partial has an error; other outcomes have an error and no response."""
    sha, file = F.col("response_sha256"), F.col("response_file")
    stored = sha.isNotNull() & (file["sha256"] == sha) & (file["relative_path"] == F.concat(F.lit(PAYLOADS), sha)) & (file["decoded_bytes"] == F.col("decoded_bytes"))
    failed = F.col("error_class").isNotNull()
    ok = F.when(F.col("status") == "success", stored & ~failed).when(F.col("status") == "partial", failed).otherwise(sha.isNull() & file.isNull() & failed)
    return F.coalesce(ok, F.lit(False))


def states(intents: DataFrame, results: DataFrame, cancels: DataFrame) -> DataFrame:
    """Intents (request_id, epoch) with status, quarantined and cache_eligible.

    ``results``: request_id, status, seq; ``cancels``: epoch, seq.  A request of a cancelled epoch is
    quarantined unless its result came before the cancel.
    """
    r = results.select("request_id", "status", F.col("seq").alias("result_seq"))
    c = cancels.groupBy("epoch").agg(F.min("seq").alias("cancel_seq"))
    out = intents.join(r, "request_id", "left").join(c, "epoch", "left")
    late = F.coalesce(F.col("cancel_seq").isNotNull() & (F.col("result_seq").isNull() | (F.col("result_seq") > F.col("cancel_seq"))), F.lit(False))
    out = out.withColumn("quarantined", late).withColumn("status", F.coalesce("status", F.lit("intent")))
    return out.withColumn("cache_eligible", (F.col("status") == "success") & ~F.col("quarantined")).drop("result_seq", "cancel_seq")


def journal_issues(intents: DataFrame, results: DataFrame, schedules: DataFrame, starts: DataFrame) -> DataFrame:
    """Rows (seq, code) of journal events that do not belong together.

    ``intents``: seq, request_id, attempt_id, epoch, ordinal, retry_of and IDENTITY.  ``results``: seq,
    intent_seq, request_id, attempt_id, epoch, ordinal, retry_of, IDENTITY, status, valid.
    ``schedules``: seq, schedule_id, attempt_id, failed_request_id, logical_request_id, next_ordinal.
    ``starts``: seq, schedule_id, scheduled_seq, request_id, attempt_id, logical_request_id, ordinal.
    """
    same = ["request_id", "attempt_id", "epoch", "ordinal", "retry_of", *IDENTITY]
    told = intents.select(F.col("seq").alias("intent_seq"), F.struct(*same).alias("told"))
    nth = F.row_number().over(W.partitionBy("intent_seq").orderBy("seq"))
    r = results.withColumn("nth", nth).join(told, "intent_seq", "left")
    equal = F.lit(True)
    for c in same:
        equal = equal & F.col(c).eqNullSafe(F.col(f"told.{c}"))
    result_code = (
        F.when(F.col("told").isNull() | (F.col("intent_seq") >= F.col("seq")) | (F.col("nth") > 1) | (F.col("told.request_id") != F.col("request_id")), "reducer.request-intent-link")
        .when(~equal, "reducer.request-intent-mismatch").when(~F.col("valid"), "reducer.request-outcome"))
    first = intents.select(F.col("request_id").alias("f"), F.col("logical_request_id").alias("fl"), F.col("ordinal").alias("fo"), F.col("replay_policy").alias("fp"), F.col("attempt_id").alias("fa"))
    failed = results.select(F.col("request_id").alias("rf"), F.col("status").alias("fs"), F.col("seq").alias("fseq"))
    s = schedules.join(first, F.col("failed_request_id") == F.col("f"), "left").join(failed, F.col("failed_request_id") == F.col("rf"), "left")
    linked = (
        (F.col("fs") == "retryable-error") & (F.col("fseq") < F.col("seq")) & (F.col("fp") == "safe-read") & (F.col("fl") == F.col("logical_request_id"))
        & (F.col("fo") + 1 == F.col("next_ordinal")))
    schedule_code = F.when(~F.coalesce(linked, F.lit(False)), "reducer.request-schedule-link").when(F.col("fa") != F.col("attempt_id"), "reducer.request-schedule-owner")
    planned = schedules.select(F.col("schedule_id").alias("p"), F.col("seq").alias("pseq"), F.col("logical_request_id").alias("pl"), F.col("next_ordinal").alias("po"))
    t = starts.withColumn("nth", F.row_number().over(W.partitionBy("schedule_id").orderBy("seq"))).join(planned, F.col("schedule_id") == F.col("p"), "left")
    started = (F.col("nth") == 1) & (F.col("pseq") == F.col("scheduled_seq")) & (F.col("pseq") < F.col("seq")) & (F.col("pl") == F.col("logical_request_id")) & (F.col("po") == F.col("ordinal"))
    start_code = F.when(F.col("p").isNull(), "reducer.schedule-namespace").when(~F.coalesce(started, F.lit(False)), "reducer.request-retry-start-link")
    begun = starts.select(F.col("request_id").alias("b"), F.col("seq").alias("bseq"), F.col("ordinal").alias("bo"))
    i = intents.join(begun, F.col("request_id") == F.col("b"), "left")
    again = F.coalesce((F.col("bseq") < F.col("seq")) & (F.col("bo") == F.col("ordinal")) & F.col("retry_of").isNotNull(), F.lit(False))
    intent_code = F.when(F.col("ordinal") == 1, F.when(F.col("retry_of").isNotNull() | F.col("b").isNotNull(), "reducer.request-backlink")).when(~again, "reducer.request-start-link")
    found = [df.select("seq", code.alias("code")) for df, code in ((r, result_code), (s, schedule_code), (t, start_code), (i, intent_code))]
    return found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3]).filter("code is not null")


def provenance_links(sources: DataFrame, requests: DataFrame, named: DataFrame | None = None) -> DataFrame:
    """Rows (source_id, request_id, linked) of sources (source_id, url, retrieval_request_ids, policy_sha256).

    A source and a request (request_id, status, result_source_ids, access_policy_sha256) are linked if
    each names the other and the request succeeded, at least in part; for an http URL both must
    have been made under one access policy.  Requests that share their results have a ``result_set``
    instead of result_source_ids, and ``named`` (result_set, source_id) tells each set once.  No
    list of results goes with a request through a join.
    """
    if named is None:
        named = requests.select(F.col("request_id").alias("result_set"), F.explode("result_source_ids").alias("source_id"))
        requests = requests.drop("result_source_ids").withColumn("result_set", F.col("request_id"))
    each = sources.select("source_id", "url", "policy_sha256", F.explode("retrieval_request_ids").alias("request_id"))
    told = named.select("result_set", "source_id").distinct().withColumn("names", F.lit(True))
    both = each.join(requests, "request_id", "left").join(told, ["result_set", "source_id"], "left")
    names = F.col("names") & F.col("status").isin("success", "partial")
    http = ~F.col("url").startswith("http:") | (F.col("access_policy_sha256") == F.col("policy_sha256"))
    return both.select("source_id", "request_id", F.coalesce(names & http, F.lit(False)).alias("linked"))


def record_mismatches(records: DataFrame, results: DataFrame) -> DataFrame:
    """Stored request records (request_id, canonical) that differ from the ledger's result, or have none."""
    told = results.select("request_id", F.col("canonical").alias("told"))
    return records.join(told, "request_id", "left").filter(~F.col("canonical").eqNullSafe(F.col("told"))).select("request_id", F.lit("transaction.invalid-reference").alias("code"))


def document_candidates(documents: DataFrame, candidates: DataFrame) -> DataFrame:
    """Each document (partition_key, draft_ordinal) with the candidate of its draft; without one it has none."""
    return documents.join(candidates.select("partition_key", "draft_ordinal", "candidate_key"), ["partition_key", "draft_ordinal"], "left")
