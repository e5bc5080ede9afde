"""Evidence records as views over the supplied tables, and the same views in SQL for the oracles.

claims: orders; evidence: line items; sources: suppliers; attempts, tasks and roles: customers,
nations and regions; ledger: events by user; candidates and texts: documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.operators.records import latest

EVIDENCE_ORDER = ("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")


EVIDENCE_ID = "l_orderkey * 8 + l_linenumber"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(evidence_id, revision, claim_id, source_id, part_id, stance, quality, confidence, verification_status)."""
    return _evidence(table(spark, sf_dir, "lineitem").withColumn("evidence_id", F.expr(EVIDENCE_ID)))


def latest_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest revisions of ``evidence``.  Lines are dealt by the id that their keys make, so one shuffle numbers and picks."""
    li = table(spark, sf_dir, "lineitem").withColumn("evidence_id", F.expr(EVIDENCE_ID)).repartition("evidence_id")
    return latest(_evidence(li, "evidence_id"), ["evidence_id"])


def _evidence(li: DataFrame, *dealt: str) -> DataFrame:
    rev = F.row_number().over(W.partitionBy(*dealt, "l_orderkey", "l_linenumber").orderBy(*EVIDENCE_ORDER))
    return li.select(
        "evidence_id", rev.cast("long").alias("revision"),
        F.col("l_orderkey").alias("claim_id"), F.col("l_suppkey").alias("source_id"), F.col("l_partkey").alias("part_id"),
        F.when(F.col("l_returnflag") == "A", "supporting").when(F.col("l_returnflag") == "R", "contradicting").otherwise("neutral").alias("stance"),
        F.when(F.col("l_linestatus") == "O", "primary-unreviewed").otherwise("secondary").alias("quality"),
        (1 - F.col("l_discount")).alias("confidence"),
        F.when(F.col("l_linenumber") % 3 == 0, "unverified").when(F.col("l_linenumber") % 3 == 1, "verified").otherwise("rejected").alias("verification_status"))


EVIDENCE_SQL = """
evidence AS (
  SELECT l_orderkey * 8 + l_linenumber AS evidence_id,
    row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice,
      l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS revision,
    l_orderkey AS claim_id, l_suppkey AS source_id, l_partkey AS part_id,
    CASE l_returnflag WHEN 'A' THEN 'supporting' WHEN 'R' THEN 'contradicting' ELSE 'neutral' END AS stance,
    CASE l_linestatus WHEN 'O' THEN 'primary-unreviewed' ELSE 'secondary' END AS quality,
    1 - l_discount AS confidence,
    CASE l_linenumber % 3 WHEN 0 THEN 'unverified' WHEN 1 THEN 'verified' ELSE 'rejected' END AS verification_status
  FROM lineitem)"""


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_id, study, cohort, access_level, name)."""
    s = table(spark, sf_dir, "supplier").alias("s")
    n = table(spark, sf_dir, "nation").alias("n")
    joined = s.join(n, F.col("s_nationkey") == F.col("n_nationkey"), "left")
    level = F.element_at(F.array(*[F.lit(x) for x in ("metadata-only", "abstract-only", "partial-text", "full-text")]), (F.col("s_suppkey") % 4 + 1).cast("int"))
    return joined.select(
        F.col("s_suppkey").alias("source_id"), F.concat(F.lit("study:"), F.col("s_nationkey").cast("string")).alias("study"),
        F.concat(F.lit("cohort:"), F.col("n_regionkey").cast("string")).alias("cohort"), level.alias("access_level"), F.col("s_name").alias("name"))


SOURCES_SQL = """
sources AS (
  SELECT s_suppkey AS source_id, 'study:' || s_nationkey AS study, 'cohort:' || n_regionkey AS cohort,
    ['metadata-only', 'abstract-only', 'partial-text', 'full-text'][(s_suppkey % 4 + 1)::INT] AS access_level, s_name AS name
  FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey)"""


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(claim_id, attempt_id, status, kind, confidence, minimum, flags)."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("claim_id"), F.col("o_custkey").alias("attempt_id"),
        F.when(F.col("o_orderstatus") == "F", "supported").when(F.col("o_orderstatus") == "O", "unresolved").otherwise("disputed").alias("status"),
        F.when(F.col("o_orderpriority").startswith("1"), "externally-verifiable-fact").otherwise("interpretation").alias("kind"),
        (F.col("o_orderkey") % 3).alias("minimum"), (F.col("o_orderkey") % 2 == 0).alias("independent_allowed"),
        (F.col("o_orderkey") % 5 == 0).alias("primary_required"), (F.col("o_orderkey") % 7 == 0).alias("full_text_required"))


CLAIMS_SQL = """
claims AS (
  SELECT o_orderkey AS claim_id, o_custkey AS attempt_id,
    CASE o_orderstatus WHEN 'F' THEN 'supported' WHEN 'O' THEN 'unresolved' ELSE 'disputed' END AS status,
    CASE WHEN o_orderpriority LIKE '1%' THEN 'externally-verifiable-fact' ELSE 'interpretation' END AS kind,
    o_orderkey % 3 AS minimum, o_orderkey % 2 = 0 AS independent_allowed,
    o_orderkey % 5 = 0 AS primary_required, o_orderkey % 7 = 0 AS full_text_required
  FROM orders)"""


def spread(df: DataFrame) -> DataFrame:
    """The rows over all cores: a small file is one task, also where each of its rows becomes a long text."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(attempt_id, task_id, role): attempt to task to role by two equi-joins."""
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    return c.join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"]).select(
        F.col("c_custkey").alias("attempt_id"), F.col("c_nationkey").alias("task_id"), F.col("r_name").alias("role"))


OWNERS_SQL = """
owners AS (
  SELECT c_custkey AS attempt_id, c_nationkey AS task_id, r_name AS role
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, seq, event_id, type, value, at_ms): one log for each user."""
    e = table(spark, sf_dir, "events")
    seq = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    return e.select("user_id", seq.cast("long").alias("seq"), "event_id", F.col("event_type").alias("type"), "value", F.expr("timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz))").alias("at_ms"), "props")


LEDGER_SQL = """
ledger AS (
  SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, event_id, event_type AS type, value,
    epoch_us(ts) // 1000 AS at_ms, props
  FROM events)"""


def with_sql(*views: str) -> str:
    return "WITH RECURSIVE " + ",".join(views)
