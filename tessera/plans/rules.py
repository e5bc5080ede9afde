"""Registered queries of the rules that work on records: gate, retries, requests, search, catalog, providers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.operators import evidence_query as Q
from tessera.operators import gate, requests, retry
from tessera.plans import adapters as A
from tessera.plans.adapters import CLAIMS_SQL, EVIDENCE_SQL, LEDGER_SQL, OWNERS_SQL, SOURCES_SQL, with_sql
from tessera.plans.cut import stored
from tessera.plans.queries import LATEST_SQL, _records, register

# --- the gate, from records

#: Line items as evidence records: what they quote, where, their values, and the calculations behind them.
ADMISSION_SQL = with_sql(EVIDENCE_SQL, SOURCES_SQL, CLAIMS_SQL) + """
, e AS (
  SELECT *, l_linenumber AS n FROM (SELECT l_orderkey * 8 + l_linenumber AS evidence_id,
      row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS revision,
      l_linenumber, l_orderkey AS claim_id, l_suppkey AS source_id, l_quantity, l_partkey, l_suppkey, l_returnflag, l_linestatus FROM lineitem)),
s AS (SELECT source_id, access_level, CASE WHEN study = 'study:5' THEN '' ELSE study END AS study, cohort FROM sources),
q AS (
  SELECT e.claim_id, e.evidence_id, e.revision, n, l_returnflag, l_linestatus, l_suppkey, s.study, s.cohort, s.access_level, 100000 + e.source_id AS relation, l_partkey % 10 AS recorder,
    l_returnflag <> 'R' AND n % 3 <> 2 AS live, n % 7 = 6 AS derived,
    CASE WHEN n % 7 = 6 THEN (l_quantity >= 10 AND (l_partkey % 3 <> 0 OR l_suppkey % 2 = 0)) ELSE (l_quantity >= 5 AND (l_suppkey % 3 <> 0 OR s.access_level = 'metadata-only')) END AS qualified
  FROM e LEFT JOIN s ON s.source_id = e.source_id),
good AS (SELECT * FROM q WHERE live AND qualified AND n > 1 AND claim_id IN (SELECT claim_id FROM claims)),
facts AS (
  SELECT claim_id, count(*) AS qualifying, count(DISTINCT cohort) FILTER (WHERE NOT derived AND study <> '') AS retrieved, count(DISTINCT CASE WHEN l_suppkey % 2 = 0 THEN 'c' || evidence_id || '-' || revision ELSE 'm' || evidence_id END) FILTER (WHERE derived) AS derived,
    coalesce(bool_or(NOT derived AND l_linestatus = 'O'), false) AS has_primary, coalesce(bool_or(NOT derived AND access_level <> 'full-text'), false) AS lacks, bool_or(NOT derived AND study = '') AS unknown,
    list(DISTINCT recorder) AS recorders FROM good GROUP BY claim_id),
contra AS (SELECT claim_id, count(*) AS contradicting, bool_and(n % 3 = 2) AS all_rejected FROM q WHERE l_returnflag = 'R' GROUP BY claim_id),
v AS (SELECT claim_id, claim_id % 10 AS attempt, CASE WHEN claim_id % 4 = 0 THEN 'accepted' ELSE 'inconclusive' END AS result, status FROM claims),
offer AS (
  SELECT DISTINCT g.claim_id FROM q g JOIN v ON v.claim_id = g.claim_id LEFT JOIN facts f ON f.claim_id = g.claim_id
  WHERE g.n = 1 AND (SELECT count(*) FROM e x WHERE x.evidence_id = g.evidence_id) = 1 AND g.live AND g.qualified AND v.result = 'accepted' AND g.recorder = v.attempt AND NOT list_contains(coalesce(f.recorders, []), v.attempt)
    AND g.study <> '' AND NOT EXISTS (SELECT 1 FROM good b WHERE b.claim_id = g.claim_id AND NOT b.derived AND b.study <> '' AND b.cohort = g.cohort)),
d AS (
  SELECT c.claim_id, c.status, coalesce(qualifying, 0) AS qualifying, coalesce(retrieved, 0) AS retrieved, coalesce(derived, 0) AS derived, coalesce(has_primary, false) AS has_primary, coalesce(lacks, false) AS lacks,
    coalesce(unknown, false) AS unknown, coalesce(contradicting, 0) AS contradicting, c.primary_required, c.full_text_required, c.independent_allowed,
    CASE WHEN c.independent_allowed AND o.claim_id IS NOT NULL THEN 1 ELSE 0 END AS credit,
    (c.status = 'supported' AND v.result = 'accepted' AND NOT list_contains(coalesce(f.recorders, []), v.attempt) AND coalesce(k.all_rejected, true)) AS settled,
    greatest(CASE WHEN c.kind = 'externally-verifiable-fact' THEN 1 ELSE 0 END, c.minimum) AS least_lineages
  FROM claims c LEFT JOIN facts f USING (claim_id) LEFT JOIN contra k USING (claim_id) LEFT JOIN offer o USING (claim_id) JOIN v ON v.claim_id = c.claim_id)
"""


def _admission(spark: SparkSession, sf: str) -> DataFrame:
    # dealt by claim, so that one shuffle numbers the lines and gathers those of a claim; numbered first and described then
    li = A.table(spark, sf, "lineitem").repartition("l_orderkey")
    li = li.withColumn("rev", F.row_number().over(W.partitionBy("l_orderkey", "l_linenumber").orderBy(*A.EVIDENCE_ORDER)).cast("long"))
    rev = F.col("rev")
    n, part, supp = F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")
    derived = n % 7 == 6
    empty = "cast(array() as array<string>)"
    name = F.concat_ws("-", (F.col("l_orderkey") * 8 + n).cast("string"), rev.cast("string"))
    value = F.struct(
        F.lit("v").alias("value"), F.when(~derived & (F.col("l_quantity") < 5), "").otherwise("context").alias("context"), F.lit("kg").alias("unit"),
        F.when(~derived, F.col("l_quantity")).alias("numeric_value"))
    e = li.select(
        (F.col("l_orderkey") * 8 + n).alias("evidence_id"), rev.alias("revision"), F.col("l_orderkey").alias("claim_id"), F.lit(1).cast("long").alias("claim_revision"),
        F.when(derived, "derived").otherwise("retrieved").alias("evidence_type"), F.when(~derived, supp).alias("source_id"), F.lit(1).cast("long").alias("source_revision"),
        F.when(derived & (supp % 2 == 0), name).alias("calculation_id"), F.when(F.col("l_returnflag") == "R", "contradicting").otherwise("supporting").alias("stance"),
        F.when(n % 3 == 2, "rejected").otherwise("verified").alias("verification_status"), F.when(F.col("l_linestatus") == "O", "primary-unreviewed").otherwise("secondary").alias("quality"),
        F.when(~derived, F.array(F.lit("said"))).otherwise(F.expr(empty)).alias("quotes"),
        F.array(F.struct(F.when(supp % 3 == 0, "unknown").otherwise("page").alias("type"), F.lit("1").alias("value"))).alias("locators"),
        F.when(derived & (F.col("l_quantity") < 10), F.array(value.withField("context", F.lit(" ")))).otherwise(F.array(value)).alias("extracted_values"),
        F.when(derived & (part % 3 != 0), "counted").alias("method"), (part % 10).alias("recorded_by"))
    s = A.sources(spark, sf)
    s = s.select(
        "source_id", F.lit(1).cast("long").alias("revision"), "access_level", F.when(F.col("study") == "study:5", "").otherwise(F.col("study")).alias("study"),
        F.array("cohort").alias("cohorts"), F.expr(empty).alias("datasets"), (100000 + F.col("source_id")).alias("relation"))
    file = lambda name: F.array(F.struct(F.lit(name).alias("relative_path"), F.lit("0" * 64).alias("sha256"), F.lit(1).cast("long").alias("decoded_bytes")))
    # calculations are those that evidence names
    c = li.filter(derived & (supp % 2 == 0)).select(name.alias("calculation_id"), (part % 10).alias("attempt_id"))
    c = c.select("calculation_id", "attempt_id", F.lit("success").alias("status"), F.lit(0).alias("exit_code"), file("in").alias("inputs"), F.expr("cast(array() as array<struct<relative_path: string, sha256: string, decoded_bytes: bigint>>)").alias("source_files"), file("out").alias("outputs"))
    found = gate.qualify(e, s, c)
    line = F.struct(F.col("evidence_id").alias("id"), "revision", (F.col("stance") == "contradicting").alias("against"), (F.col("verification_status") == "rejected").alias("rejected"))
    # stored, so that the shuffle of the lines goes and claims, verifications and contradictions are read from one table
    lines = e.groupBy("claim_id").agg(F.collect_list(line).alias("lines"))
    claims = stored(A.claims(spark, sf).withColumn("created_by", F.lit(-1).cast("long")).join(lines, "claim_id", "left"))
    ref = lambda r: F.struct(r["id"].alias("id"), r["revision"].alias("revision"))
    # A claim cites all its evidence but the first, which only its verification has found.
    one = F.lit(1).cast("long")
    claims = claims.withColumn("revision", one).withColumn("evidence_refs", F.transform(F.filter("lines", lambda r: r["id"] % 8 > 1), ref))
    all_refs = F.coalesce(F.transform("lines", ref), F.expr("cast(array() as array<struct<id: bigint, revision: bigint>>)"))
    v = claims.select(
        F.concat(F.lit("v"), F.col("claim_id").cast("string")).alias("verification_id"), F.lit(1).alias("revision"), F.array(F.struct(F.col("claim_id").alias("id"), one.alias("revision"))).alias("checked_claims"),
        all_refs.alias("checked_evidence"), F.when(F.col("claim_id") % 4 == 0, "accepted").otherwise("inconclusive").alias("result"), F.lit("mixed").alias("method"), (F.col("claim_id") % 10).alias("attempt_id"),
        F.array(F.col("claim_id") * 8 + 1).alias("independent_evidence_ids"), F.array(F.struct(F.col("claim_id"), F.lit("mended").alias("description"))).alias("corrections"))
    contra = claims.select("claim_id", F.explode(F.filter("lines", lambda r: r["against"])).alias("r")).select("claim_id", F.col("r.id").alias("evidence_id"), "r.revision", "r.rejected")
    return gate.evaluate(claims.drop("lines"), found, v, contra)


@register("gate_admission", ADMISSION_SQL + """
SELECT claim_id, qualifying, retrieved::INT AS retrieved, derived::INT AS derived, credit, least_lineages::BIGINT AS effective_minimum, contradicting::INT AS contradicting, settled AS conflict_resolved,
  array_to_string(list_filter([
    CASE WHEN status IN ('rejected', 'disputed', 'unresolved') OR qualifying = 0 THEN 'claim.unsupported' END, CASE WHEN primary_required AND NOT has_primary THEN 'claim.primary-source-required' END,
    CASE WHEN full_text_required AND lacks THEN 'claim.full-text-required' END, CASE WHEN unknown AND retrieved + derived < least_lineages THEN 'claim.unresolved-lineage' END,
    CASE WHEN contradicting > 0 AND NOT settled THEN 'claim.unresolved-conflict' END,
    CASE WHEN retrieved + derived < least_lineages AND independent_allowed AND credit = 0 THEN 'claim.independent-verification-required' END,
    CASE WHEN retrieved + derived + credit < least_lineages AND NOT (independent_allowed AND credit = 0) THEN 'claim.insufficient-lineages' END], lambda x: x IS NOT NULL), ',') AS blockers
FROM d""")
def gate_admission(spark: SparkSession, sf: str) -> DataFrame:
    out = _admission(spark, sf).withColumn("effective_minimum", F.col("effective_minimum").cast("long"))
    return out.select("claim_id", "qualifying", "retrieved", "derived", "credit", "effective_minimum", "contradicting", "conflict_resolved", F.array_join("blockers", ",").alias("blockers"))


@register("latest_verifications", """
WITH v AS (SELECT l_suppkey AS verification_id, l_linenumber AS revision, l_orderkey AS claim, l_linenumber % 2 = 0 AS also FROM lineitem),
c AS (SELECT verification_id, revision, claim FROM v UNION ALL SELECT verification_id, revision, claim + 1 FROM v WHERE also)
SELECT claim AS claim_id, verification_id, max(revision) AS revision FROM c GROUP BY ALL""")
def latest_verifications(spark: SparkSession, sf: str) -> DataFrame:
    """For each claim ref the latest revision of a verification among those that check it."""
    one = F.lit(1).alias("revision")
    own, next_ = F.struct(F.col("l_orderkey").alias("id"), one), F.struct((F.col("l_orderkey") + 1).alias("id"), one)
    v = A.table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("verification_id"), F.col("l_linenumber").alias("revision"),
        F.when(F.col("l_linenumber") % 2 == 0, F.array(own, next_)).otherwise(F.array(own)).alias("checked_claims"))
    return gate.applicable_verifications(v).select(F.col("claim.id").alias("claim_id"), "verification_id", "revision")


@register("stale_claim_refs", with_sql(EVIDENCE_SQL) + """
, top AS (SELECT evidence_id, max(revision) AS latest FROM evidence GROUP BY evidence_id),
r AS (SELECT DISTINCT claim_id, evidence_id, 1 AS revision FROM evidence),
old AS (SELECT DISTINCT claim_id, evidence_id, 1 AS revision FROM evidence WHERE evidence_id % 8 <= 2)
SELECT r.claim_id, r.evidence_id FROM r JOIN top USING (evidence_id) WHERE latest > 1 AND NOT EXISTS (SELECT 1 FROM old WHERE old.claim_id = r.claim_id AND old.evidence_id = r.evidence_id)""")
def stale_claim_refs(spark: SparkSession, sf: str) -> DataFrame:
    """Revision 2 of a claim cites revision 1 of all its evidence; revision 1 had cited the first two lines."""
    e = A.evidence(spark, sf)
    ref = F.struct(F.col("evidence_id").alias("id"), F.lit(1).cast("long").alias("revision"))
    c = e.groupBy("claim_id").agg(F.collect_set(ref).alias("all"), F.collect_set(F.when(F.col("evidence_id") % 8 <= 2, ref)).alias("old"))
    both = c.select("claim_id", F.explode(F.array(F.struct(F.lit(1).alias("revision"), F.col("old").alias("evidence_refs")), F.struct(F.lit(2).alias("revision"), F.col("all").alias("evidence_refs")))).alias("c"))
    top = e.groupBy("evidence_id").agg(F.max("revision").alias("revision"))
    return gate.stale_refs(both.select("claim_id", "c.revision", "c.evidence_refs"), top).select("claim_id", F.col("ref.id").alias("evidence_id"))


@register("attempt_filter", with_sql(EVIDENCE_SQL, CLAIMS_SQL, OWNERS_SQL, LATEST_SQL) + """
SELECT evidence_id AS id, revision FROM latest JOIN claims USING (claim_id) WHERE attempt_id BETWEEN 1 AND 40 ORDER BY evidence_id, revision LIMIT 10000""")
def attempt_filter(spark: SparkSession, sf: str) -> DataFrame:
    return Q.select_page(_records(spark, sf), Q.EvidenceQuery(attempt_ids=tuple(range(1, 41)), limit=10_000)).select("id", "revision")


@register("record_owners", with_sql(EVIDENCE_SQL, CLAIMS_SQL) + """
, s AS (SELECT l_suppkey AS id, list_sort(list(DISTINCT p_size)) AS owners FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1)
SELECT 'sources' AS kind, id, 1 AS revision, array_to_string(owners, ',') AS owners FROM s UNION ALL SELECT 'claims', claim_id, 1, attempt_id::VARCHAR FROM claims
UNION ALL SELECT 'evidence', evidence_id, revision, part_id::VARCHAR FROM evidence""")
def record_owners(spark: SparkSession, sf: str) -> DataFrame:
    """A supplier's requests are the parts that it delivers, made by attempts named after their size."""
    li = A.table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("id")).agg(F.collect_set("l_partkey").alias("retrieval_request_ids"))
    requested = A.table(spark, sf, "part").select(F.col("p_partkey").alias("request_id"), F.col("p_size").cast("long").alias("attempt_id"))
    one = F.lit(1).cast("long").alias("revision")
    claims = A.claims(spark, sf).select(F.col("claim_id").alias("id"), one, "attempt_id")
    evidence = A.evidence(spark, sf).select(F.col("evidence_id").alias("id"), "revision", "part_id")
    found = Q.owners(li.withColumn("revision", one), requested, [("claims", claims, "attempt_id"), ("evidence", evidence, "part_id")])
    return found.select("kind", "id", "revision", F.array_join(F.transform("owners", lambda o: o.cast("string")), ",").alias("owners"))


# --- retries, runs and requests


@register("retry_series", with_sql(LEDGER_SQL) + """
, a AS (
  SELECT event_id AS pos, 'op' || user_id AS op, seq + (event_id % 41 = 0)::INT AS o, 'a' || (event_id - (event_id % 43 = 0)::INT) AS id, CASE WHEN event_id % 37 <> 0 THEN 'a' || lag(event_id) OVER w END AS back,
    'e' || (event_id - (event_id % 47 = 0)::INT) AS env, CASE WHEN type = 'purchase' OR lead(seq) OVER w IS NULL THEN 'retryable-failed' WHEN event_id % 5 = 0 THEN 'committed' ELSE 'retryable-failed' END AS state,
    CASE WHEN user_id % 31 = 0 THEN 'never' ELSE 'safe-read' END AS policy, 'm' || (event_id % 53 = 0)::INT AS model FROM ledger WINDOW w AS (PARTITION BY user_id ORDER BY seq)),
s AS (
  SELECT event_id AS pos, 's' || (event_id - (event_id % 59 = 0)::INT) AS id, CASE WHEN event_id % 61 = 0 THEN 'none' ELSE 'op' || user_id END AS op, CASE WHEN event_id % 67 = 0 THEN 'zz' ELSE 'a' || event_id END AS failed,
    seq + 1 + (event_id % 71 = 0)::INT AS nxt FROM ledger WHERE event_id % 7 <> 0),
a2 AS (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos) > 1 AS ti, row_number() OVER (PARTITION BY env ORDER BY pos) > 1 AS te, row_number() OVER (PARTITION BY op, o ORDER BY pos) > 1 AS tw,
    count(*) OVER (PARTITION BY op) AS n, min(o) OVER (PARTITION BY op) AS least, first_value(model) OVER (PARTITION BY op ORDER BY o, pos) AS model1, first_value(policy) OVER (PARTITION BY op ORDER BY o, pos) AS policy1 FROM a),
links AS (SELECT x.*, y.id AS pid, y.state AS pstate FROM a2 x JOIN a2 y ON NOT x.tw AND NOT y.tw AND x.op = y.op AND y.o = x.o - 1 WHERE x.o <> 1),
edges AS (SELECT l.pos, count(s.pos) AS n FROM links l LEFT JOIN s ON s.op = l.op AND s.failed = l.pid AND s.nxt = l.o GROUP BY l.pos),
s2 AS (
  SELECT s.*, EXISTS (SELECT 1 FROM links l WHERE l.op = s.op AND l.pid = s.failed AND l.o = s.nxt) AS used, row_number() OVER (PARTITION BY id ORDER BY pos) > 1 AS ti,
    row_number() OVER (PARTITION BY op, failed, nxt ORDER BY pos) > 1 AS tw FROM s),
g AS (SELECT op, min(o) AS o1, arg_min(policy, o * 1000000000 + pos) AS policy1, max(o) AS omax, arg_max(id, o * 1000000000 - pos) AS lid, arg_max(state, o * 1000000000 - pos) AS lstate FROM a GROUP BY op),
s3 AS (SELECT s2.*, count(*) FILTER (WHERE NOT used) OVER (PARTITION BY s2.op) AS waiting, g.op AS grp, o1, policy1, omax, lid, lstate FROM s2 LEFT JOIN g ON g.op = s2.op)
SELECT '/attempts/' || pos || '/attemptId' AS path, 'retry.duplicate-attempt-id' AS code FROM a2 WHERE ti
UNION ALL SELECT '/attempts/' || pos || '/attemptEnvelopeSha256', 'retry.duplicate-envelope' FROM a2 WHERE te
UNION ALL SELECT '/attempts/' || pos || '/attemptOrdinal', 'retry.duplicate-ordinal' FROM a2 WHERE tw
UNION ALL SELECT '/attempts/' || pos || '/attemptOrdinal', 'retry.nonconsecutive-ordinal' FROM a2 WHERE (o = least AND least <> 1) OR (NOT tw AND o > n)
UNION ALL SELECT '/attempts/' || pos || '/providerModel', 'retry.immutable-change' FROM a2 WHERE model <> model1
UNION ALL SELECT '/attempts/' || pos || '/replayPolicy', 'retry.immutable-change' FROM a2 WHERE policy <> policy1
UNION ALL SELECT '/attempts/' || pos || '/retryOfAttemptId', 'retry.wrong-backlink' FROM links WHERE back IS DISTINCT FROM pid
UNION ALL SELECT '/attempts/' || pos, 'retry.invalid-predecessor-state' FROM links WHERE pstate <> 'retryable-failed'
UNION ALL SELECT '/attempts/' || pos, 'retry.schedule-edge-count' FROM edges WHERE n <> 1
UNION ALL SELECT '/schedules/' || pos || '/scheduleId', 'retry.duplicate-schedule-id' FROM s3 WHERE ti
UNION ALL SELECT '/schedules/' || pos, 'retry.duplicate-schedule-edge' FROM s3 WHERE used AND tw
UNION ALL SELECT '/schedules/' || pos, 'retry.never-scheduled' FROM s3 WHERE grp IS NOT NULL AND o1 = 1 AND policy1 = 'never'
UNION ALL SELECT '/schedules/' || pos, 'retry.multiple-pending' FROM s3 WHERE grp IS NOT NULL AND NOT used AND waiting > 1
UNION ALL SELECT '/schedules/' || pos, 'retry.non-immediate-pending' FROM s3 WHERE grp IS NOT NULL AND NOT used AND waiting = 1 AND NOT (failed = lid AND nxt = omax + 1 AND lstate = 'retryable-failed')
UNION ALL SELECT '/schedules/' || pos || '/failedAttemptId', 'retry.orphan-failed-attempt' FROM s3 WHERE grp IS NOT NULL AND NOT EXISTS (SELECT 1 FROM a WHERE a.op = s3.op AND a.id = s3.failed)
UNION ALL SELECT '/schedules/' || pos || '/logicalOperationId', 'retry.orphan-logical-operation' FROM s3 WHERE grp IS NULL""")
def retry_series(spark: SparkSession, sf: str) -> DataFrame:
    """A user's log is a series of attempts, each scheduled by the one before; event numbers plant the faults."""
    e, k, by = A.ledger(spark, sf), F.col("event_id"), W.partitionBy("user_id").orderBy("seq")
    off = lambda n: (k % n == 0).cast("int")
    name = lambda letter, value: F.concat(F.lit(letter), value.cast("string"))
    operation, before = name("op", F.col("user_id")), F.lag("event_id").over(by)
    attempts = e.select(
        k.alias("at"), operation.alias("operation"), (F.col("seq") + off(41)).alias("ordinal"), name("a", k - off(43)).alias("attempt_id"), F.when(k % 37 != 0, name("a", before)).alias("retry_of"), name("e", k - off(47)).alias("envelope"),
        F.when((F.col("type") == "purchase") | F.lead("seq").over(by).isNull(), "retryable-failed").when(k % 5 == 0, "committed").otherwise("retryable-failed").alias("state"),
        F.when(F.col("user_id") % 31 == 0, "never").otherwise("safe-read").alias("replay_policy"), name("m", off(53)).alias("provider_model"))
    schedules = e.filter(k % 7 != 0).select(
        k.alias("at"), name("s", k - off(59)).alias("schedule_id"), F.when(k % 61 == 0, "none").otherwise(operation).alias("operation"), F.when(k % 67 == 0, "zz").otherwise(name("a", k)).alias("failed_id"),
        (F.col("seq") + 1 + off(71)).alias("next_ordinal"))
    return retry.series_issues(attempts, schedules, ["provider_model", "replay_policy"])


@register("retry_starts", with_sql(LEDGER_SQL) + """
, s AS (SELECT event_id AS schedule_id, user_id, seq, at_ms + 1000 * (event_id % 5) AS due FROM ledger WHERE type = 'error'),
t AS (SELECT l.event_id, coalesce(s.schedule_id, -l.event_id) AS schedule_id, s.due, l.at_ms, l.seq FROM ledger l LEFT JOIN s ON s.user_id = l.user_id AND s.seq = l.seq - 1 WHERE l.type <> 'error')
SELECT schedule_id, seq, CASE WHEN due IS NULL THEN 'schedule-not-found' WHEN seq > 30 THEN 'retry-after-cancel' WHEN at_ms < due THEN 'retry-not-due' END AS code FROM t WHERE due IS NULL OR seq > 30 OR at_ms < due""")
def retry_starts(spark: SparkSession, sf: str) -> DataFrame:
    """An error schedules the next event of its log; others start what was never scheduled; the epoch is cancelled at 30."""
    e = A.ledger(spark, sf)
    epoch = F.lit(0).alias("epoch")
    planned = e.filter("type = 'error'").select(F.col("event_id").alias("schedule_id"), (F.col("at_ms") + 1000 * (F.col("event_id") % 5)).alias("not_before_ms"), epoch)
    by = W.partitionBy("user_id").orderBy("seq")
    known = F.when(F.lag("type").over(by) == "error", F.lag("event_id").over(by)).otherwise(-F.col("event_id"))
    starts = e.withColumn("schedule_id", known).filter("type <> 'error'").select("schedule_id", "seq", "at_ms", epoch, F.lit(30).alias("cancel_seq"))
    return retry.start_issues(starts, planned)


RUN_STATES = ("created", "planning", "researching", "verifying", "synthesizing", "paused", "recovering", "failed", "cancelled")


@register("run_move_violations", with_sql(LEDGER_SQL) + """
, m AS (SELECT user_id, seq, ['created', 'planning', 'researching', 'verifying', 'synthesizing', 'paused', 'recovering', 'failed', 'cancelled'][(event_id % 9 + 1)::INT] AS "from",
    ['planning', 'researching', 'verifying', 'synthesizing', 'paused', 'recovering', 'failed', 'cancelled', 'created'][((event_id // 9) % 9 + 1)::INT] AS "to",
    CASE event_id % 4 WHEN 0 THEN 'retryable-x' WHEN 1 THEN 'fatal' END AS blocker, CASE WHEN user_id % 2 = 0 THEN 'quick' ELSE 'deep' END AS depth FROM ledger),
p AS (SELECT *, lag(blocker) OVER w AS prior, last_value(CASE WHEN "to" IN ('planning', 'researching', 'verifying', 'synthesizing') THEN "to" END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS checkpoint FROM m WINDOW w AS (PARTITION BY user_id ORDER BY seq))
SELECT user_id, seq, "from" AS state, "to" AS next FROM p WHERE NOT coalesce(
  CASE WHEN "to" = 'failed' THEN blocker IS NOT NULL WHEN "to" = 'paused' THEN true ELSE blocker IS NULL END AND
  CASE "from" WHEN 'created' THEN "to" IN ('planning', 'cancelled', 'failed') WHEN 'planning' THEN "to" IN ('researching', 'paused', 'cancelled', 'failed')
    WHEN 'researching' THEN "to" IN ('verifying', 'paused', 'cancelled', 'failed') OR ("to" = 'synthesizing' AND depth = 'quick') WHEN 'verifying' THEN "to" IN ('researching', 'synthesizing', 'paused', 'cancelled', 'failed')
    WHEN 'synthesizing' THEN "to" IN ('paused', 'cancelled', 'failed') WHEN 'recovering' THEN "to" IN ('paused', 'cancelled', 'failed') OR "to" = checkpoint
    WHEN 'paused' THEN "to" IN ('recovering', 'cancelled', 'failed') WHEN 'failed' THEN "to" = 'recovering' AND prior LIKE 'retryable-%' ELSE false END, false)""")
def run_move_violations(spark: SparkSession, sf: str) -> DataFrame:
    e, k = A.ledger(spark, sf), F.col("event_id")
    state = lambda at, names: F.element_at(F.array(*[F.lit(n) for n in names]), (at + 1).cast("int"))
    moves = e.select(
        "user_id", "seq", state(k % 9, RUN_STATES).alias("from"), state(F.floor(k / 9) % 9, (*RUN_STATES[1:], RUN_STATES[0])).alias("to"),
        F.when(k % 4 == 0, "retryable-x").when(k % 4 == 1, "fatal").alias("blocker"), F.when(F.col("user_id") % 2 == 0, "quick").otherwise("deep").alias("depth"), F.lit(None).cast("string").alias("checkpoint"))
    return retry.run_move_violations(moves, "user_id")


@register("never_blockers", with_sql(LEDGER_SQL) + """
, f AS (SELECT user_id, max_by(type, seq) AS t FROM ledger GROUP BY user_id) SELECT count(*) FILTER (WHERE t NOT IN ('error', 'purchase') AND user_id % 2 = 0) AS never_blockers FROM f""")
def never_blockers(spark: SparkSession, sf: str) -> DataFrame:
    f = A.ledger(spark, sf).groupBy("user_id").agg(F.max_by("type", "seq").alias("t"), F.count("*").alias("attempts"))
    none = F.lit(None)
    return retry.never_blockers(f.select(
        F.lit(False).alias("any_committed"), "attempts", F.lit(False).alias("started_retry"), F.lit(False).alias("active_schedule"), F.when(F.col("t") == "error", "terminal-failed").alias("failure_state"),
        F.when(F.col("t") == "purchase", "result").otherwise("started").alias("phase"), F.lit("tx").alias("transaction_id"), F.lit(1).alias("result_seq"), none.cast("long").alias("cancel_seq"),
        F.when(F.col("user_id") % 2 == 0, "never").otherwise("safe-read").alias("replay_policy")))


@register("request_outcomes", """
SELECT event_id, CASE event_id % 4 WHEN 0 THEN user_id % 3 <> 0 AND value <= 40 WHEN 1 THEN value <= 40 WHEN 2 THEN value > 40 ELSE value > 40 AND user_id % 3 = 0 END AS valid
FROM (SELECT event_id, user_id, coalesce(value, 0) AS value FROM events)""")
def request_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """Stored successes, partial results and errors; values over 40 carry an error, users of three have a wrong or no response."""
    k, sha = F.col("event_id") % 4, F.sha2("props", 256)
    bad, error = F.col("user_id") % 3 == 0, F.coalesce(F.col("value"), F.lit(0.0)) > 40
    status = F.when(k == 0, "success").when(k <= 2, "partial").otherwise("retryable-error")
    stored = F.struct(sha.alias("sha256"), F.concat(F.lit(".state/request-payloads/"), sha).alias("relative_path"), F.when(bad, 1).otherwise(2).cast("long").alias("decoded_bytes"))
    none = F.lit(None)
    r = A.table(spark, sf, "events").select(
        "event_id", status.alias("status"), F.when((k < 2) | ((k == 3) & ~bad), sha).alias("response_sha256"), F.when(k == 0, stored).alias("response_file"), F.lit(2).cast("long").alias("decoded_bytes"),
        F.when(F.when(k == 1, ~error).otherwise(error), F.lit("x")).otherwise(none).alias("error_class"))
    return r.select("event_id", requests.valid_outcome().alias("valid"))


@register("request_states", with_sql(LEDGER_SQL) + """
, i AS (SELECT event_id AS request_id, user_id AS epoch, seq FROM ledger WHERE type IN ('view', 'click', 'signup')), r AS (SELECT request_id, seq + 1 AS rs FROM i WHERE request_id % 3 <> 0),
c AS (SELECT user_id AS epoch, min(seq) AS cs FROM ledger WHERE type = 'error' GROUP BY user_id)
SELECT request_id, CASE WHEN rs IS NULL THEN 'intent' ELSE 'success' END AS status, coalesce(cs IS NOT NULL AND (rs IS NULL OR rs > cs), false) AS quarantined,
  rs IS NOT NULL AND NOT coalesce(cs IS NOT NULL AND rs > cs, false) AS cache_eligible FROM i LEFT JOIN r USING (request_id) LEFT JOIN c USING (epoch)""")
def request_states(spark: SparkSession, sf: str) -> DataFrame:
    e = A.ledger(spark, sf)
    i = e.filter("type in ('view', 'click', 'signup')").select(F.col("event_id").alias("request_id"), F.col("user_id").alias("epoch"), "seq")
    r = i.filter("request_id % 3 <> 0").select("request_id", F.lit("success").alias("status"), (F.col("seq") + 1).alias("seq"))
    c = e.filter("type = 'error'").select(F.col("user_id").alias("epoch"), "seq")
    return requests.states(i.drop("seq"), r, c).select("request_id", "status", "quarantined", "cache_eligible")


@register("request_journal", with_sql(LEDGER_SQL) + """
, e AS (SELECT event_id * 10 AS seq, event_id AS id, user_id, value FROM ledger)
SELECT seq + 1 AS seq, CASE WHEN id % 11 = 0 THEN 'reducer.request-intent-link' WHEN id % 5 = 0 THEN 'reducer.request-intent-mismatch' ELSE 'reducer.request-outcome' END AS code FROM e WHERE id % 11 = 0 OR id % 5 = 0 OR coalesce(value, 0) > 40
UNION ALL SELECT seq + 2, 'reducer.request-schedule-link' FROM e WHERE id % 2 = 0
UNION ALL SELECT seq + 3, 'reducer.request-retry-start-link' FROM e WHERE id % 7 = 0
UNION ALL SELECT seq + 4, 'reducer.request-start-link' FROM e WHERE id % 13 = 0""")
def request_journal(spark: SparkSession, sf: str) -> DataFrame:
    """An intent, its result, a schedule, a start and the retry's intent for each event, some of them broken."""
    k = F.col("event_id")
    ident = [F.concat(F.lit("l"), k.cast("string")).alias("logical_request_id"), F.lit("safe-read").alias("replay_policy"), F.lit("p").alias("provider"), F.lit("op").alias("operation"), F.lit("s").alias("policy_sha256"), F.lit("{}").alias("input")]
    e = A.ledger(spark, sf).select("event_id", "user_id", "value", *ident)
    own = ["logical_request_id", "replay_policy", "provider", "operation", "policy_sha256", "input"]
    attempt, none = F.col("user_id").alias("attempt_id"), F.lit(None).cast("long")
    head = e.select((k * 10).alias("seq"), k.alias("request_id"), attempt, F.lit(0).alias("epoch"), F.lit(1).alias("ordinal"), none.alias("retry_of"), *own)
    tail = e.select((k * 10 + 4).alias("seq"), (-k - 1).alias("request_id"), attempt, F.lit(0).alias("epoch"), F.lit(2).alias("ordinal"), F.when(k % 13 != 0, k).alias("retry_of"), *own)
    results = e.select(
        (k * 10 + 1).alias("seq"), F.when(k % 11 == 0, -1).otherwise(k * 10).alias("intent_seq"), k.alias("request_id"), attempt, F.when(k % 5 == 0, 1).otherwise(0).alias("epoch"), F.lit(1).alias("ordinal"), none.alias("retry_of"), *own,
        F.when(k % 2 == 0, "success").otherwise("retryable-error").alias("status"), (F.coalesce(F.col("value"), F.lit(0.0)) <= 40).alias("valid"))
    planned = e.select((k * 10 + 2).alias("seq"), k.alias("schedule_id"), attempt, k.alias("failed_request_id"), "logical_request_id", F.lit(2).alias("next_ordinal"))
    starts = e.select((k * 10 + 3).alias("seq"), k.alias("schedule_id"), F.when(k % 7 == 0, 0).otherwise(k * 10 + 2).alias("scheduled_seq"), (-k - 1).alias("request_id"), attempt, "logical_request_id", F.lit(2).alias("ordinal"))
    return requests.journal_issues(head.unionByName(tail), results, planned, starts)


@register("request_provenance", """
WITH r AS (SELECT l_suppkey AS source_id, l_partkey AS request_id FROM lineitem GROUP BY ALL)
SELECT source_id, request_id, p_size % 3 <> 0 AND source_id % 10 = request_id % 10 AND (s_nationkey % 2 = 0 OR p_size % 2 = 0) AS linked
FROM r JOIN part ON p_partkey = request_id JOIN supplier ON s_suppkey = source_id""")
def request_provenance(spark: SparkSession, sf: str) -> DataFrame:
    """Parts are requests that name the suppliers of their last digit; http suppliers need the policy of even sizes."""
    li = A.table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("source_id")).agg(F.collect_set("l_partkey").alias("retrieval_request_ids"))
    s = A.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("source_id"), F.when(F.col("s_nationkey") % 2 == 0, "https://h/").otherwise("http://h/").alias("url"), F.lit("even").alias("policy_sha256"))
    named = A.table(spark, sf, "supplier").select((F.col("s_suppkey") % 10).alias("result_set"), F.col("s_suppkey").alias("source_id"))
    p = A.table(spark, sf, "part").select(
        F.col("p_partkey").alias("request_id"), (F.col("p_partkey") % 10).alias("result_set"), F.when(F.col("p_size") % 3 == 0, "terminal-error").when(F.col("p_size") % 3 == 1, "success").otherwise("partial").alias("status"),
        F.when(F.col("p_size") % 2 == 0, "even").otherwise("odd").alias("access_policy_sha256"))
    return requests.provenance_links(s.join(li, "source_id"), p, named)


@register("request_records", "SELECT event_id AS request_id, 'transaction.invalid-reference' AS code FROM events WHERE event_type = 'error' OR props IS NULL OR value > 40")
def request_records(spark: SparkSession, sf: str) -> DataFrame:
    """The ledger has no results for errors, and others than were stored for values over 40."""
    e = A.table(spark, sf, "events")
    told = e.filter("event_type <> 'error'").select(F.col("event_id").alias("request_id"), F.when(F.col("value") > 40, "{}").otherwise(F.col("props")).alias("canonical"))
    return requests.record_mismatches(e.select(F.col("event_id").alias("request_id"), F.col("props").alias("canonical")), told)


@register("document_candidates", """
SELECT d.doc_id, CASE WHEN d.doc_id % 3 <> 0 THEN 'c' || d.doc_id END AS candidate_key FROM documents d""")
def document_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Every third document's draft has no candidate."""
    d = A.table(spark, sf, "documents").select("doc_id", F.col("source").alias("partition_key"), F.col("doc_id").alias("draft_ordinal"))
    c = d.filter("doc_id % 3 <> 0").select("partition_key", "draft_ordinal", F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("candidate_key"))
    return requests.document_candidates(d, c).select("doc_id", "candidate_key")
