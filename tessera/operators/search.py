"""Assembly of federated search results: plan, post-filters, quota, counters, budgets, groups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.functions.identifiers import access_rank, prefixed_key
from tessera.plans.cut import cut

# What a transport code means in a trace and for a provider; other codes are security policy.
TRACE_CODES = {
    "network.dns-empty": "availability", "network.dns-temporary": "availability", "transport.connect-failed": "availability", "transport.connect-timeout": "availability",
    "network.dns-nxdomain": "terminal-provider", "transport.cancelled": "cancelled", "transport.deadline-exceeded": "deadline-exceeded",
    "transport.http-retryable": "http-retryable", "transport.http-terminal": "http-terminal", "transport.json-root-invalid": "invalid-response"}
PROVIDER_CODES = {
    "availability": "provider.availability", "http-retryable": "provider.availability", "terminal-provider": "provider.terminal", "http-terminal": "provider.terminal",
    "cancelled": "provider.cancelled", "deadline-exceeded": "provider.deadline-exceeded", "invalid-response": "provider.invalid-response", "security-policy": "provider.security-policy"}
# All codes with which a transport fails.
TRANSPORT_CODES = (
    "network.dns-empty", "network.dns-nxdomain", "network.dns-temporary", "network.dns-unsafe", "transport.cancelled", "transport.deadline-exceeded", "transport.connect-timeout", "transport.connect-failed",
    "transport.tls-failed", "transport.peer-unavailable", "transport.peer-mismatch", "transport.redirect-invalid", "transport.too-many-redirects", "transport.too-many-headers", "transport.headers-too-large",
    "transport.framing-invalid", "transport.protocol-invalid", "transport.encoded-too-large", "transport.too-many-encoding-layers", "transport.unsupported-encoding", "transport.decompression-failed",
    "transport.decompression-ratio", "transport.decoded-too-large", "transport.invalid-utf8", "transport.json-root-invalid", "transport.http-retryable", "transport.http-terminal")
MOST_PROVIDERS = 64


def plan(queries: DataFrame, providers: DataFrame) -> DataFrame:
    """Partitions of providers x queries with the effective limit; equal partitions run once, with all their queries.

    Providers are a fixed set: more than ``MOST_PROVIDERS`` are an error.  They become one array, from which
    each query takes its partitions.
    """
    if providers.count() > MOST_PROVIDERS:
        raise ValueError("search.too-many-providers")
    listed = providers.agg(F.collect_list(F.struct("provider", "configured_limit", "endpoint_cap")).alias("all")).withColumn("one", F.lit(1))
    each = queries.withColumn("one", F.lit(1)).join(F.broadcast(listed), "one").select("query_id", "text", "caller_limit", F.explode("all").alias("p"))
    each = each.select("query_id", "text", "p.provider", F.least("caller_limit", "p.configured_limit", "p.endpoint_cap").alias("limit"))
    key = prefixed_key("partition", provider=F.col("provider"), text=F.col("text"), limit=F.col("limit"))
    return each.withColumn("partition_key", key).groupBy("partition_key", "provider", "text", "limit").agg(F.array_sort(F.collect_set("query_id")).alias("queries"))


def post_filter(drafts: DataFrame, types: tuple[str, ...] | None, from_year: int | None, to_year: int | None) -> DataFrame:
    """Types and years; a row without a date goes whenever a bound is set.  Filter first, then quota."""
    if types is not None:
        drafts = drafts.filter(F.col("publication_type").isin(*types) if types else F.lit(False))
    year = F.substring("published", 1, 4).try_cast("int")
    if from_year is not None:
        drafts = drafts.filter(year >= from_year)
    if to_year is not None:
        drafts = drafts.filter(year <= to_year)
    return drafts


def quota(drafts: DataFrame, most: int) -> DataFrame:
    """First ``most`` drafts of each query in order (one query a partition)."""
    by = W.partitionBy("query_id").orderBy("ordinal", "draft_ordinal")
    return drafts.withColumn("place", F.row_number().over(by)).filter(F.col("place") <= most)


def shared_quota(drafts: DataFrame, most: int, most_rounds: int = 1000) -> DataFrame:
    """Quota where a draft may serve several queries: it goes if any of them is full.

    The rule walks the drafts (search_id, ordinal, draft_ordinal, queries) of a search in order.  Here
    each round accepts all drafts at once that find room whatever is decided about those before
    them: in each of their queries, as many places are left as undecided drafts come up to them.
    Then drafts of full queries go.  The first undecided draft of a search is always decided, and
    all others that do not depend on it with it.  A query's ranks stop at ``most``, so no task
    sorts a whole search.  Drafts without queries stay; equal places are taken in no stated order.
    """
    rows = cut(drafts.withColumn("_d", F.monotonically_increasing_id()))
    asked = F.array_distinct(F.coalesce("queries", F.expr("cast(array() as array<string>)")))
    free = rows.filter(F.size(asked) == 0).select("_d")
    undecided = cut(rows.select("_d", "search_id", "ordinal", "draft_ordinal", F.size(asked).alias("_n"), F.explode(asked).alias("_q")))
    by = W.partitionBy("search_id", "_q").orderBy("ordinal", "draft_ordinal", "_d")
    won = []
    for _ in range(most_rounds):
        if undecided.isEmpty():
            break
        used = reduce(DataFrame.unionByName, won).groupBy("search_id", "_q").agg(F.count("*").alias("_used")) if won else None
        left = undecided.join(used, ["search_id", "_q"], "left") if used is not None else undecided.withColumn("_used", F.lit(0))
        left = cut(left.withColumn("_room", most - F.coalesce("_used", F.lit(0))).drop("_used"))
        dead = left.filter("_room <= 0").select("_d").distinct()
        left = cut(left.join(dead, "_d", "left_anti"))
        near = left.withColumn("_place", F.row_number().over(by)).filter(F.col("_place") <= most).filter("_place <= _room")
        ready = near.groupBy("_d").agg(F.count("*").alias("_k"), F.first("_n").alias("_n")).filter("_k = _n").select("_d")
        won.append(cut(left.join(ready, "_d", "left_semi").drop("_room")))
        undecided = cut(left.join(ready, "_d", "left_anti").drop("_room"))
    else:
        raise RuntimeError("the quota did not settle")
    kept = reduce(DataFrame.unionByName, [free, *[w.select("_d").distinct() for w in won]])
    return rows.join(kept, "_d", "left_semi").drop("_d")


def counters(partitions: DataFrame) -> DataFrame:
    """Requested, dispatched, succeeded, failed and blocked, and whether they add up."""
    out = partitions.groupBy("provider").agg(
        F.count("*").alias("requested"), F.count_if(F.col("outcome") != "blocked").alias("dispatched"),
        F.count_if(F.col("outcome") == "success").alias("succeeded"), F.count_if(F.col("outcome") == "failure").alias("failed"),
        F.count_if(F.col("outcome") == "blocked").alias("blocked"))
    return out.withColumn("conserved", (F.col("requested") == F.col("dispatched") + F.col("blocked")) & (F.col("dispatched") == F.col("succeeded") + F.col("failed")))


def best_access(drafts: DataFrame, key: str) -> DataFrame:
    """Highest access level of each key."""
    return drafts.groupBy(key).agg(F.max_by("access_level", access_rank(F.col("access_level"))).alias("access_level"))


def within_budget(rows: DataFrame, key: str, order: list[str], size: Column, most: int) -> DataFrame:
    """Rows of each key while their running size is within the budget."""
    by = W.partitionBy(key).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("running", F.sum(size).over(by)).filter(F.col("running") <= most)


def budgeted(rows: DataFrame, key: str, order: list[str], size: Column, most: int, members: str | None = None, shown: int = 16) -> DataFrame:
    """One row a key: ``kept``, the first rows whose running size is within the budget, and how many are ``omitted``.

    The array ``members`` of a kept row is cut to its first ``shown``.
    """
    fields = [F.slice(members, 1, shown).alias(members) if c == members else F.col(c) for c in rows.columns if c != key]
    by = W.partitionBy(key).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    place = F.row_number().over(W.partitionBy(key).orderBy(*order))
    each = rows.select(key, F.struct(*fields).alias("row"), F.sum(size).over(by).alias("running"), place.alias("place"))
    fits = F.col("running") <= most
    kept = F.array_sort(F.collect_list(F.when(fits, F.struct("place", "row"))))
    return each.groupBy(key).agg(F.transform(kept, lambda k: k["row"]).alias("kept"), F.count_if(~fits).alias("omitted"))


def trace_code(code: Column) -> Column:
    """What a trace says of a settlement: success without a failure code, else the code's class."""
    out = F.lit("security-policy")
    for raw, name in TRACE_CODES.items():
        out = F.when(code == raw, name).otherwise(out)
    return F.when(code.isNull(), "success").otherwise(out)


def provider_code(code: Column) -> Column:
    """Provider outcome of a failure code."""
    trace, out = trace_code(code), F.lit(None).cast("string")
    for name, outcome in PROVIDER_CODES.items():
        out = F.when(trace == name, outcome).otherwise(out)
    return out


def follow_ups(settled: DataFrame) -> DataFrame:
    """Child partitions of settled ones: summaries after a search, links after a summary; or why they are skipped."""
    child = F.when(F.col("operation") == "esearch", "esummary").when(F.col("operation") == "esummary", "elink").when(F.col("operation") == "elink", "fulltext")
    skip = F.when(F.col("outcome") != "success", "parent-failed").when(F.size("identifiers") == 0, "no-identifiers")
    return settled.filter(child.isNotNull()).select("partition_key", child.alias("operation"), skip.alias("skipped"), F.when(skip.isNull(), F.col("identifiers")).alias("identifiers"))


def numeric_order(values: Column) -> Column:
    """Distinct decimal ids in numeric order: by length, then text."""
    return F.transform(F.array_sort(F.transform(F.array_distinct(values), lambda v: F.struct(F.length(v).alias("n"), v.alias("v")))), lambda s: s["v"])
