"""Revision chains, references and snapshots of versioned records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Kinds in order of rank, and the reference fields by kind: (from, field, to, resolution).
KINDS = ("sources", "claims", "evidence", "verifications", "requests", "calculations")
REFERENCES = (
    ("sources", "related_source_ids", "sources", "latest"),
    ("sources", "retrieval_request_ids", "requests", "exact"),
    ("claims", "evidence_refs", "evidence", "exact"),
    ("claims", "conflict_claim_ids", "claims", "latest"),
    ("evidence", "claim_ref", "claims", "exact"),
    ("evidence", "source_ref", "sources", "exact"),
    ("evidence", "calculation_id", "calculations", "exact"),
    ("evidence", "conflicts_with", "evidence", "latest"),
    ("verifications", "checked_claims", "claims", "exact"),
    ("verifications", "checked_evidence", "evidence", "exact"),
    ("verifications", "request_ids", "requests", "exact"),
    ("verifications", "calculation_ids", "calculations", "exact"),
    ("verifications", "correction_claim_ids", "claims", "latest"),
    ("verifications", "independent_evidence_ids", "evidence", "latest"),
    ("requests", "result_source_ids", "sources", "latest"),
)


def latest(records: DataFrame, keys: list[str], revision: str = "revision") -> DataFrame:
    """The row of the highest revision of each key."""
    by = W.partitionBy(*keys).orderBy(F.desc(revision))
    return records.withColumn("_n", F.row_number().over(by)).filter("_n = 1").drop("_n")


def chain_violations(records: DataFrame, keys: list[str], revision: str = "revision") -> DataFrame:
    """Keys whose revisions are not exactly 1 .. n: code duplicate-revision, or revision-gap."""
    seen = records.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_distinct(revision).alias("d"), F.min(revision).alias("low"), F.max(revision).alias("high"))
    code = F.when(F.col("n") != F.col("d"), "duplicate-revision").when((F.col("low") != 1) | (F.col("high") != F.col("n")), "revision-gap")
    return seen.select(*keys, code.alias("code"), F.col("n").alias("revisions")).filter("code is not null")


def immutable_violations(records: DataFrame, keys: list[str], fields: list[str], revision: str = "revision") -> DataFrame:
    """Rows whose ``fields`` differ from those of revision 1."""
    first = W.partitionBy(*keys).orderBy(revision).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    changed = F.array_compact(F.array(*[F.when(~F.first(f).over(first).eqNullSafe(F.col(f)), F.lit(f)) for f in fields]))
    return records.withColumn("changed", changed).filter(F.size("changed") > 0).select(*keys, revision, "changed")


def edges_of(records: DataFrame, kind: str, id_col: str, field: str, to: str, exact: bool) -> DataFrame:
    """Reference edges of an array field; repeated references stay, as they are counted."""
    ref = F.explode(field).alias("ref")
    out = records.select(F.lit(kind).alias("src_kind"), F.col(id_col).alias("src_id"), F.col("revision").alias("src_rev"), ref)
    dst = ("ref.id", "ref.revision") if exact else ("ref", None)
    rev = F.col(dst[1]) if dst[1] else F.lit(None).cast("long")
    return out.select("src_kind", "src_id", "src_rev", F.lit(to).alias("dst_kind"), F.col(dst[0]).alias("dst_id"), rev.alias("dst_rev"))


def resolve_latest(edges: DataFrame, records: DataFrame) -> DataFrame:
    """Fills ``dst_rev`` of stable references with the highest revision in ``records`` (kind, id, revision)."""
    top = records.groupBy(F.col("kind").alias("k"), F.col("id").alias("i")).agg(F.max("revision").alias("top"))
    found = edges.join(top, (F.col("dst_kind") == F.col("k")) & (F.col("dst_id") == F.col("i")), "left")
    return found.withColumn("dst_rev", F.coalesce("dst_rev", "top")).drop("k", "i", "top")


def unresolved(edges: DataFrame, records: DataFrame) -> DataFrame:
    """Edges whose target does not exist: code unresolved-ref."""
    there = records.select(F.col("kind").alias("k"), F.col("id").alias("i"), F.col("revision").alias("r"))
    same = (F.col("dst_kind") == F.col("k")) & (F.col("dst_id") == F.col("i")) & (F.col("dst_rev").isNull() | (F.col("dst_rev") == F.col("r")))
    return edges.join(there, same, "left_anti").withColumn("code", F.lit("unresolved-ref"))


def asymmetric(edges: DataFrame) -> DataFrame:
    """Edges (src, relation, dst) of symmetric relations that lack their reverse."""
    back = edges.select(F.col("dst").alias("s"), F.col("relation").alias("r"), F.col("src").alias("d"))
    return edges.join(back, (F.col("src") == F.col("s")) & (F.col("relation") == F.col("r")) & (F.col("dst") == F.col("d")), "left_anti")


def reversed_pairs(edges: DataFrame) -> DataFrame:
    """Edges of directed relations whose reverse exists too."""
    back = edges.select(F.col("dst").alias("s"), F.col("relation").alias("r"), F.col("src").alias("d"))
    return edges.join(back, (F.col("src") == F.col("s")) & (F.col("relation") == F.col("r")) & (F.col("dst") == F.col("d")), "left_semi")


def totals(records: DataFrame, caps: dict[str, int] | None = None) -> DataFrame:
    """Records, references and canonical bytes of each kind, and the caps that they exceed."""
    out = records.groupBy("kind").agg(F.count("*").alias("records"), F.sum("n_refs").alias("refs"), F.sum(F.octet_length("canonical")).alias("bytes"))
    if not caps:
        return out
    over = F.array_compact(F.array(*[F.when(F.col(c) > n, F.lit(f"{c}-too-many")) for c, n in sorted(caps.items())]))
    return out.withColumn("codes", over)


def issues(record: DataFrame, checks: list[tuple[str, str, Column]], keys: list[str]) -> DataFrame:
    """Rows (keys, path, code) for each check (path, code, condition) that holds."""
    found = F.array_compact(F.array(*[F.when(cond, F.struct(F.lit(path).alias("path"), F.lit(code).alias("code"))) for path, code, cond in checks]))
    return record.select(*keys, F.explode(found).alias("issue")).select(*keys, "issue.path", "issue.code")


def closed_keys(raw: Column, allowed: list[str]) -> Column:
    """Keys of a JSON object that its schema does not have."""
    return F.array_except(F.json_object_keys(raw), F.array(*[F.lit(k) for k in allowed]))


def blank(text: Column) -> Column:
    return F.coalesce(F.trim(text, F.lit(" \t\n\r\f\x0b")) == "", F.lit(True))


def committed_only(records: DataFrame, committed: DataFrame) -> DataFrame:
    """Records of transactions that a ledger event committed."""
    return records.join(committed.select("transaction_id").distinct(), "transaction_id", "left_semi")


def orphan_objects(objects: DataFrame, results: DataFrame) -> DataFrame:
    """Stored transactions that no ledger result names: corrupt."""
    return objects.join(results.select("transaction_id").distinct(), "transaction_id", "left_anti").withColumn("code", F.lit("corrupt"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
