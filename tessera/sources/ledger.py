"""Ledger files: canonical JSON lines chained by hashes; verified scan, append, and torn tails."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tessera.functions.canonical import canonical_json
from tessera.functions.identifiers import is_timestamp
from tessera.sources.ledger_source import GENESIS, PUSHDOWN, LedgerSource, exists

EVENT = T.StructType([
    T.StructField("seq", T.LongType()), T.StructField("eventId", T.StringType()), T.StructField("occurredAt", T.StringType()),
    T.StructField("type", T.StringType()), T.StructField("payload", T.StringType()), T.StructField("prevSha256", T.StringType()), T.StructField("entrySha256", T.StringType())])


def lines(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """Rows (file, offset, bytes, seq, raw, code) of all lines, read in byte ranges; ``code`` says why a line has no text."""
    spark.dataSource.register(LedgerSource)
    push = {"pushFilters": spark.conf.get(PUSHDOWN, "false")}
    return spark.read.format(LedgerSource.name()).options(**push | options).load(path)


def scan(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """Rows of EVENT, ``raw``, and the ``code`` of a line that cannot be read; the payload stays JSON text."""
    told = lines(spark, path, **options).select("raw", "code", F.from_json("raw", EVENT).alias("e"))
    return told.select("raw", "code", "e.*")


def torn(spark: SparkSession, path: str) -> bool:
    """Whether a file's last byte is not a line feed."""
    return not lines(spark, path).filter("code = 'ledger.torn-tail'").isEmpty()


def line_issues(events: DataFrame) -> DataFrame:
    """Rows (seq, code) of lines that cannot be read, do not fit the schema, are not canonical, or whose hash is not their own."""
    body = canonical_json(F.regexp_replace("raw", r'"entrySha256":"[0-9a-f]{64}",', ""))
    code = (
        F.when(F.col("code").isNotNull(), F.col("code"))
        .when(F.col("seq").isNull() | F.col("type").isNull() | F.col("eventId").isNull() | ~F.coalesce(is_timestamp(F.col("occurredAt")), F.lit(False)), "ledger.schema-invalid")
        .when(canonical_json("raw") != F.col("raw"), "ledger.noncanonical-line").when(F.sha2(F.concat(body, F.lit("\n")), 256) != F.col("entrySha256"), "ledger.hash-mismatch"))
    return events.withColumn("code", code).filter("code is not null").select("seq", "code")


def chain_issues(events: DataFrame, within: list[str]) -> DataFrame:
    """Rows (within, seq, code) where the sequence or the chain of hashes breaks.

    Hashes are stored, so each line is compared with the one before it by a join on the
    sequence number; no task holds a whole log.
    """
    prev = events.select(*[F.col(k).alias(f"_{k}") for k in within], (F.col("seq") + 1).alias("_seq"), F.col("entrySha256").alias("_sha")).dropDuplicates([f"_{k}" for k in within] + ["_seq"])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in within], F.col("seq") == F.col("_seq"))
    twice = events.groupBy(*within, "seq").count().filter("count > 1").select(*within, "seq", F.lit("ledger.sequence-mismatch").alias("code"))
    seen = events.join(prev, same, "left")
    code = (
        F.when((F.col("seq") < 1) | ((F.col("seq") > 1) & F.col("_seq").isNull()), "ledger.sequence-mismatch")
        .when(F.col("prevSha256") != F.coalesce("_sha", F.lit(GENESIS)), "ledger.previous-hash-mismatch"))
    found = seen.withColumn("code", code).filter("code is not null").select(*within, "seq", "code")
    return found.unionByName(twice).distinct()


def identity_issues(events: DataFrame, within: list[str]) -> DataFrame:
    """Rows (within, seq, code) of event ids that came before, and of identities reserved twice."""
    by_id = W.partitionBy(*within, "eventId").orderBy("seq")
    kind, name = F.get_json_object("payload", "$.kind"), F.get_json_object("payload", "$.id")
    again = events.withColumn("_n", F.row_number().over(by_id)).filter("_n > 1").select(*within, "seq", F.lit("ledger.duplicate-event-id").alias("code"))
    kept = events.filter("type = 'identity_reserved'").withColumns({"_k": kind, "_i": name})
    twice = kept.withColumn("_n", F.row_number().over(W.partitionBy(*within, "_k", "_i").orderBy("seq"))).filter("_n > 1")
    return again.unionByName(twice.select(*within, "seq", F.lit("ledger.duplicate-reservation").alias("code")))


def verified(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The whole check of one log: rows (seq, code) of issues, and the state that its events fold to.

    Read-only: a torn tail is an issue (seq null).  A log without issues folds without an error.
    """
    from tessera.operators.ledger_fold import fold

    events = scan(spark, path)
    whole = events.filter("code is null and seq is not null")
    issues = line_issues(events).unionByName(chain_issues(whole, [])).unionByName(identity_issues(whole, []))
    state = fold(whole.filter("type is not null and payload is not null").select(F.lit("log").alias("run_id"), "seq", "type", "payload"))
    bad = state.filter("error is not null").select(F.col("error_seq").alias("seq"), F.col("error").alias("code"))
    return issues.unionByName(bad), state


def append(rows: DataFrame, path: str) -> None:
    """Appends events (type, payload, eventId, occurredAt), in the order of time and id, as one commit.

    An event id or identity that the log has, or that comes twice, is an error before anything is written.
    """
    spark = rows.sparkSession
    spark.dataSource.register(LedgerSource)
    told = rows.select("type", "payload", "eventId", "occurredAt")
    names = lambda df: df.select(F.inline(F.filter(F.array(
        F.struct(F.lit("ledger.duplicate-event-id").alias("code"), F.col("eventId").alias("name")),
        F.when(F.col("type") == "identity_reserved", F.struct(F.lit("ledger.duplicate-reservation").alias("code"), F.concat_ws(":", F.get_json_object("payload", "$.kind"), F.get_json_object("payload", "$.id")).alias("name")))), lambda x: x.isNotNull())))
    new = names(told).groupBy("code", "name").count()
    known = names(scan(spark, path).filter("code is null")).distinct().withColumn("known", F.lit(True)) if exists(path) else None
    clash = new.filter("count > 1") if known is None else new.join(known, ["code", "name"], "left").filter("count > 1 or known")
    if (found := clash.select("code").first()) is not None:
        raise ValueError(found["code"])
    told.repartition(1).sortWithinPartitions("occurredAt", "eventId").write.format(LedgerSource.name()).option("path", path).mode("append").save()


def append_stream(rows: DataFrame, path: str):
    """A writer that appends each micro-batch of such events; set its trigger and checkpoint, and start it."""
    rows.sparkSession.dataSource.register(LedgerSource)
    told = rows.select("type", "payload", "eventId", "occurredAt").repartition(1)
    return told.writeStream.format(LedgerSource.name()).option("path", path)
