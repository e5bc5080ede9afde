"""Citation numbers in order of first use, link validity, and the bibliography."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.operators.ranks import ranked

BIBLIOGRAPHY = ("source_id", "revision", "title", "authors", "container_title", "published", "identifiers", "canonical_url")


def number(bindings: DataFrame, within: list[str], source: list[str], position: str = "position") -> DataFrame:
    """Rows (within, source, first, number): sources numbered from 1 by their first position.

    Without ``within``, all rows are one report, numbered by range.
    """
    first = bindings.groupBy(*within, *source).agg(F.min(position).alias("first"))
    if not within:
        return ranked(first, [F.col("first"), *map(F.col, source)], "number").withColumn("number", (F.col("number") + 1).cast("int"))
    return first.withColumn("number", F.row_number().over(W.partitionBy(*within).orderBy("first", *source)))


def violations(bindings: DataFrame, evidence: DataFrame) -> DataFrame:
    """Bindings (position, claim_id, source_id, source_rev, evidence_id) that are not valid, with their first code.

    One evidence belongs to one source; it must be of that source, and its claim must be bound
    to that source too, in whichever binding.  A source is cited in one revision only.
    """
    by_evidence, by_source = W.partitionBy("evidence_id"), W.partitionBy("source_id")
    several = F.min("source_rev").over(by_source) != F.max("source_rev").over(by_source)
    owners = F.col("evidence_id").isNotNull() & (F.min("source_id").over(by_evidence) != F.max("source_id").over(by_evidence))
    e = evidence.select(F.col("evidence_id").alias("e"), F.col("claim_id").alias("ec"), F.col("source_id").alias("es"))
    bound = bindings.filter("claim_id is not null").select(F.col("source_id").alias("bs"), F.col("claim_id").alias("bc"), F.lit(True).alias("is_bound")).distinct()
    seen = bindings.withColumn("several", several).withColumn("owners", owners).join(e, F.col("evidence_id") == F.col("e"), "left")
    seen = seen.join(bound, (F.col("source_id") == F.col("bs")) & (F.col("ec") == F.col("bc")), "left")
    code = (
        F.when(F.col("several"), "citation.ambiguous-source-revision")
        .when(F.col("evidence_id").isNotNull() & F.col("e").isNull(), "citation.unresolved-ref")
        .when(F.col("owners"), "citation.duplicate-link")
        .when(F.col("es") != F.col("source_id"), "citation.cross-source-evidence")
        .when(F.col("e").isNotNull() & F.col("is_bound").isNull(), "citation.claim-mismatch"))
    return seen.withColumn("code", code).filter("code is not null").select("position", "claim_id", "source_id", "evidence_id", "code")


def citation_map(numbers: DataFrame, bindings: DataFrame) -> DataFrame:
    """Rows (source_id, number, claims, evidence): what each citation number stands for, its refs in order."""
    refs = bindings.groupBy("source_id").agg(F.array_sort(F.collect_set("claim_id")).alias("claims"), F.array_sort(F.collect_set("evidence_id")).alias("evidence"))
    return numbers.select("source_id", "number").join(refs, "source_id")


def bibliography(numbers: DataFrame, sources: DataFrame, source: list[str]) -> DataFrame:
    fields = [c for c in BIBLIOGRAPHY if c in sources.columns and c not in source]
    return numbers.join(sources.select(*source, *fields), source)
