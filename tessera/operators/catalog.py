"""Checks across ordered transactions, merging of sources, and plans as of a sequence number."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.operators.graph import components
from tessera.operators.lineage import STRONG
from tessera.plans.cut import cut


#: Rows of a task that sorts, on the average.
TASK_ROWS = 1 << 19


def revision_order(records: DataFrame) -> DataFrame:
    """Rows (kind, id, revision, seq, code): over transactions in order, no record comes twice and each revision is the highest so far plus one."""
    # sorting takes memory by the rows of a task, so tasks follow the rows; all that is asked of an id is asked in its task
    tasks = max(int(records.sparkSession.conf.get("spark.sql.shuffle.partitions")), records.count() // TASK_ROWS + 1)
    records = records.repartition(tasks, "id")
    by = W.partitionBy("kind", "id").orderBy("seq", "revision")
    again = F.row_number().over(W.partitionBy("kind", "id", "revision").orderBy("seq")) > 1
    seen = records.withColumn("before", F.coalesce(F.max("revision").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).withColumn("again", again)
    code = F.when(F.col("again"), "transaction.duplicate-record").when(F.col("revision") != F.col("before") + 1, "transaction.invalid-reference")
    return seen.withColumn("code", code).filter("code is not null").select("kind", "id", "revision", "seq", "code")


def forward_refs(edges: DataFrame, records: DataFrame) -> DataFrame:
    """Edges (seq, dst_kind, dst_id, dst_rev) to records that no transaction up to theirs has written.

    Stable references (null dst_rev) need any revision to exist, exact ones their own.
    """
    first = records.groupBy("kind", "id", "revision").agg(F.min("seq").alias("since"))
    exact = edges.filter("dst_rev is not null").join(first, (F.col("dst_kind") == F.col("kind")) & (F.col("dst_id") == F.col("id")) & (F.col("dst_rev") == F.col("revision")), "left").select(*edges.columns, "since")
    any_ = first.groupBy("kind", "id").agg(F.min("since").alias("since"))
    stable = edges.filter("dst_rev is null").join(any_, (F.col("dst_kind") == F.col("kind")) & (F.col("dst_id") == F.col("id")), "left").select(*edges.columns, "since")
    return exact.unionByName(stable).filter("since is null or since > seq").drop("since").withColumn("code", F.lit("transaction.invalid-reference"))


def journal_violations(entries: DataFrame) -> DataFrame:
    """Journal entries (attempt_id, seq, local_seq, sha): positions run 1, 2, ... in order, and no hash comes twice."""
    by = W.partitionBy("attempt_id").orderBy("seq")
    seen = entries.withColumn("n", F.row_number().over(by)).withColumn("twice", F.row_number().over(W.partitionBy("attempt_id", "sha").orderBy("seq")) > 1)
    code = F.when(F.col("twice"), "reducer.request-journal-hash").when(F.col("local_seq") != F.col("n"), "reducer.request-journal-sequence")
    return seen.withColumn("code", code).filter("code is not null").select("attempt_id", "seq", "code")


def merge_sources(existing: DataFrame, incoming: DataFrame, fields: list[str]) -> DataFrame:
    """Existing and incoming sources (key, doi, pmid, pmcid, url, fields...) merged by identity.

    One row a group: the retained key (the existing one, else the smallest), the first non-null
    value of each field with existing rows first, conflicts, the aliases, and ``action``.  Equal
    strong identifiers unite; an equal URL does so only if no strong identifier differs among all
    that have it, else its sources are ambiguous, as is a group of several existing ones.
    Ambiguous groups stay as they are; a group is revised only if a value changes.
    """
    both = existing.withColumn("old", F.lit(True)).unionByName(incoming.withColumn("old", F.lit(False)))
    member = _membership(both)
    order = F.struct((~F.col("old")).alias("late"), F.col("key").alias("key"))
    ids = ["doi", "pmid", "pmcid", "url", *fields]
    aggs = [F.min_by(f, F.when(F.col(f).isNotNull(), order)).alias(f) for f in ids]
    before = [F.min_by(f, F.when(F.col("old"), order)).alias(f"_{f}") for f in ids]
    out = member.groupBy("group").agg(
        *aggs, *before, F.min_by("key", order).alias("retained"), F.array_sort(F.collect_set("key")).alias("keys"), F.count_if("old").alias("olds"), F.bool_or("url_conflict").alias("url_conflict"),
        F.array_compact(F.array(*[F.when(F.count_distinct(f) > 1, F.lit(f)) for f in ids])).alias("conflicts"))
    changed = F.lit(False)
    for f in ids:
        changed = changed | ~F.col(f).eqNullSafe(F.col(f"_{f}"))
    action = F.when(F.col("url_conflict") | (F.col("olds") > 1), "ambiguous").when(F.col("olds") == 0, "added").when(changed, "revised").otherwise("unchanged")
    return out.withColumn("action", action).withColumn("aliases", F.array_except("keys", F.array("retained"))).select("retained", *ids, "conflicts", "aliases", "action")


def _membership(sources: DataFrame) -> DataFrame:
    """Adds ``group``, the smallest key of those that belong together, and ``url_conflict``."""
    clash = reduce(lambda a, b: a | b, [F.count_distinct(k) > 1 for k in STRONG])
    urls = cut(sources.filter("url is not null").groupBy(F.col("url").alias("u")).agg(clash.alias("clash")))
    told = sources.join(urls, F.col("url") == F.col("u"), "left").withColumn("url_conflict", F.coalesce("clash", F.lit(False))).drop("u", "clash")
    by_url = F.when(~F.col("url_conflict"), F.concat(F.lit("url:"), F.col("url")))
    keys = F.array_compact(F.array(*[F.concat(F.lit(k + ":"), F.col(k)) for k in STRONG], by_url))
    node = F.concat(F.lit("c:"), F.col("key").cast("string"))
    found = components(told.select(node.alias("src"), F.explode(keys).alias("dst"))).withColumnRenamed("component", "c")
    out = told.withColumn("node", node).join(found, "node", "left").withColumn("c", F.coalesce("c", "node"))
    low = cut(out.groupBy(F.col("c").alias("k")).agg(F.min("key").alias("group")))
    return out.join(low, F.col("c") == F.col("k")).drop("node", "c", "k")


def accepted_plan(attempts: DataFrame, limits: DataFrame) -> DataFrame:
    """Runs with exactly one committed planning attempt, and the source limit in force at its commit."""
    one = attempts.filter("phase = 'committed'").groupBy("run_id").agg(F.count("*").alias("n"), F.min("seq").alias("seq"), F.min("attempt_id").alias("attempt_id")).filter("n = 1")
    told = one.join(limits.select("run_id", F.col("seq").alias("at"), "max_sources"), "run_id").filter("at <= seq")
    return told.groupBy("run_id", "attempt_id", "seq").agg(F.max_by("max_sources", "at").alias("max_sources"))
