"""Lineage of sources: token components, pair independence, identity audit, grouping and merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.functions.identifiers import access_rank
from tessera.operators.graph import components
from tessera.plans.cut import cut

# Relation reasons and identifier kinds in order.
RELATIONS = (("version-of", "version-relation"), ("correction-of", "correction-relation"), ("reanalysis-of", "reanalysis-relation"), ("reports", "report-relation"))
STRONG = ("doi", "pmid", "pmcid")


def tokens(study: Column, cohorts: Column, datasets: Column) -> Column:
    """study:, cohort: and dataset: tokens; empty strings are no tokens."""
    said = F.array_compact(F.concat(
        F.array(F.when(study != "", F.concat(F.lit("study:"), study))),
        F.transform(F.filter(cohorts, lambda c: c != ""), lambda c: F.concat(F.lit("cohort:"), c)),
        F.transform(F.filter(datasets, lambda d: d != ""), lambda d: F.concat(F.lit("dataset:"), d))))
    return F.array_sort(F.array_distinct(said))


def token_components(sources: DataFrame, relations: DataFrame | None = None) -> DataFrame:
    """Rows (source_id, component) over latest records (source_id, tokens) and relations (src, dst).

    Sources and tokens are two sides of one graph, so a token shared by many makes no pairs.
    """
    name = F.concat(F.lit("s:"), F.col("source_id").cast("string"))
    edges = sources.select(name.alias("src"), F.explode("tokens").alias("t")).select("src", F.concat(F.lit("t:"), F.col("t")).alias("dst"))
    if relations is not None:
        edges = edges.unionByName(relations.select(*[F.concat(F.lit("s:"), F.col(c).cast("string")).alias(c) for c in ("src", "dst")]))
    found = components(edges)
    out = sources.select("source_id", name.alias("node")).join(found, "node", "left").select("source_id", F.coalesce("component", "node").alias("c"))
    # Stored before it is joined, so that the join of a large component can be split.
    low = cut(out.groupBy(F.col("c").alias("k")).agg(F.min("source_id").alias("component")))
    return out.join(low, F.col("c") == F.col("k")).select("source_id", "component")


def independence(pairs: DataFrame) -> DataFrame:
    """Adds ``decision`` and ``reasons`` to pairs with left and right (id, study, cohorts, datasets, root) and relations."""
    a, b = F.col("left"), F.col("right")
    same = a["id"] == b["id"]
    share = lambda x, y: F.arrays_overlap(F.filter(x, lambda v: v != ""), F.filter(y, lambda v: v != ""))
    reasons = [
        ("same-source", same),
        ("same-study", (a["study"] != "") & (a["study"] == b["study"])),
        ("shared-cohort", share(a["cohorts"], b["cohorts"])),
        ("shared-dataset", share(a["datasets"], b["datasets"])),
        *[(why, F.array_contains("relations", kind)) for kind, why in RELATIONS],
    ]
    first = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(r)) for r, c in reasons]))
    told = F.arrays_overlap("shared", F.array(F.lit("same-study"), F.lit("shared-cohort"), F.lit("shared-dataset")))
    linked = ~same & (a["root"] == b["root"]) & ((F.size("relations") > 0) | ~told)
    out = pairs.withColumn("shared", first)
    out = out.withColumn("reasons", F.when(F.coalesce(linked, F.lit(False)), F.array_append("shared", F.lit("dependency-component"))).otherwise(F.col("shared"))).drop("shared")
    unknown = F.coalesce(a["study"], F.lit("")).eqNullSafe("") | F.coalesce(b["study"], F.lit("")).eqNullSafe("")
    return out.withColumn("decision", F.when(F.size("reasons") > 0, "dependent").when(unknown, "unknown").otherwise("independent")).withColumn(
        "reasons", F.when((F.size("reasons") == 0) & unknown, F.array(F.lit("unknown-lineage"))).otherwise(F.col("reasons")))


def candidate_groups(candidates: DataFrame) -> DataFrame:
    """Rows (group, members, identity_kind, identity_value, status) over candidates (key, doi, pmid, pmcid, url).

    Candidates that share an identifier or URL are one group.
    """
    kinds = [*STRONG, "url"]
    keyed = candidates.select("*", F.array_compact(F.array(*[F.concat(F.lit(k + ":"), F.col(k)) for k in kinds])).alias("keys"))
    edges = keyed.select(F.concat(F.lit("c:"), F.col("key").cast("string")).alias("src"), F.explode("keys").alias("dst"))
    found = components(edges).withColumnRenamed("component", "c")
    named = keyed.withColumn("node", F.concat(F.lit("c:"), F.col("key").cast("string"))).join(found, "node", "left")
    named = named.withColumn("c", F.coalesce("c", "node"))
    aggs = [F.min("key").alias("group"), F.count("*").alias("members")]
    for k in kinds:
        aggs += [F.count_distinct(k).alias(f"{k}_n"), F.count(k).alias(f"{k}_have"), F.min(k).alias(f"{k}_min")]
    g = named.groupBy("c").agg(*aggs)
    conflicting = (F.col("doi_n") > 1) | (F.col("pmid_n") > 1) | (F.col("pmcid_n") > 1)
    whole = lambda k: (F.col(f"{k}_n") == 1) & (F.col(f"{k}_have") == F.col("members"))
    alone = F.col("members") == 1
    kind, value = F.when(whole("url") & conflicting, "canonical-url"), F.when(whole("url") & conflicting, F.col("url_min"))
    for k in STRONG:
        kind, value = kind.when(whole(k), k), value.when(whole(k), F.col(f"{k}_min"))
    kind, value = kind.when(whole("url"), "canonical-url"), value.when(whole("url"), F.col("url_min"))
    kind, value = kind.when(alone, "provider-result"), value.when(alone, F.col("group").cast("string"))
    for k in STRONG:
        kind, value = kind.when(F.col(f"{k}_n") > 0, k), value.when(F.col(f"{k}_n") > 0, F.col(f"{k}_min"))
    certain = alone | whole("doi") | whole("pmid") | whole("pmcid") | whole("url")
    status = F.when(conflicting | ~certain, "ambiguous").otherwise("compatible")
    return g.select("group", "members", kind.alias("identity_kind"), value.alias("identity_value"), status.alias("status"))


def identity_audit(sources: DataFrame) -> DataFrame:
    """Groups of several source ids: ambiguous if strong ids conflict or no key is common, else duplicate."""
    g = candidate_groups(sources).filter("members > 1")
    return g.select("group", "members", F.when(F.col("status") == "ambiguous", "ambiguous").otherwise("duplicate").alias("finding"))


def survivors(members: DataFrame, fields: list[str], order: list[str], provenance: str | None = None) -> DataFrame:
    """Merge of each group: each field's value, the fields in conflict, and digests of the values that differ.

    The first member in ``order`` is the base: its values stay.  A field that it lacks takes the
    first value in order; with ``provenance``, an array of the fields that a member can vouch
    for, of a member that vouches for it.  Different values of a field are a conflict.
    """
    ranked = members.withColumn("_o", F.struct(*order))
    if provenance is not None:
        first = cut(ranked.groupBy(F.col("group").alias("_k")).agg(F.min("_o").alias("_first")))
        ranked = ranked.join(first, F.col("group").eqNullSafe(F.col("_k"))).withColumn("_base", F.col("_o") == F.col("_first"))

    def vouched(f: str) -> Column:
        return F.lit(True) if provenance is None else F.col("_base") | F.array_contains(provenance, f)

    when = {f: F.when(F.col(f).isNotNull() & vouched(f), F.col("_o")) for f in fields}
    merged = ranked.groupBy("group").agg(*[F.min_by(f, when[f]).alias(f) for f in fields], *[F.min(when[f]).alias(f"_o_{f}") for f in fields], F.count("*").alias("members"))
    told = merged.select(F.col("group").alias("_g"), *[F.struct(F.col(f).alias("value"), F.col(f"_o_{f}").alias("o")).alias(f"_m_{f}") for f in fields])
    both = ranked.join(told, F.col("group").eqNullSafe(F.col("_g")))
    # A value that differs is a conflict once the merge has one.
    differs = {f: (F.col("_o") > F.col(f"_m_{f}.o")) & (F.col(f) != F.col(f"_m_{f}.value")) for f in fields}
    digest = lambda c: F.sha2(F.to_json(F.array(c)), 256)
    hashes = {f: F.collect_set(F.when(differs[f], digest(F.col(f)))) for f in fields}
    own = {f: F.first(digest(F.col(f"_m_{f}.value"))) for f in fields}
    found = both.groupBy("group").agg(F.array_compact(F.array(*[
        F.when(F.size(hashes[f]) > 0, F.struct(F.lit(f).alias("field"), F.array_sort(F.array_append(hashes[f], own[f])).alias("hashes"))) for f in fields])).alias("conflict_hashes"))
    found = found.select(F.col("group").alias("_g"), "conflict_hashes", F.transform("conflict_hashes", lambda c: c["field"]).alias("conflicts"))
    return merged.join(found, F.col("group").eqNullSafe(F.col("_g"))).select("group", *fields, "conflicts", "conflict_hashes", "members")


def latest_facts(members: DataFrame) -> DataFrame:
    """Facts of a group that take no order: the latest retrievedAt, the highest access level, a known peer review status."""
    known = F.when(F.col("peer_review_status") != "unknown", F.col("peer_review_status"))
    return members.groupBy("group").agg(
        F.max("retrieved_at").alias("retrieved_at"), F.max_by("access_level", access_rank(F.col("access_level"))).alias("access_level"),
        F.coalesce(F.min_by(known, F.when(known.isNotNull(), F.col("key"))), F.lit("unknown")).alias("peer_review_status"), (F.count_distinct(known) > 1).alias("review_conflict"))


def merge_lists(members: DataFrame, field: str) -> DataFrame:
    return members.groupBy("group").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(field)))).alias(field))


def effective_identifiers(revisions: DataFrame, keys: list[str]) -> DataFrame:
    """For each source the first non-null identifier of each kind across its revisions."""
    return revisions.groupBy("source_id").agg(*[F.min_by(k, F.when(F.col(k).isNotNull(), F.col("revision"))).alias(k) for k in keys])


def provenance_witness(claims: DataFrame) -> DataFrame:
    """Best witness of a URL for each source: resolver 0, transport 1 (final, requested, redirect), metadata 2."""
    rank = F.when(F.col("kind") == "resolver", 0).when(F.col("kind") == "transport", 1).otherwise(2)
    stage = F.coalesce(F.array_position(F.array(*[F.lit(s) for s in ("final", "requested", "redirect")]), F.col("stage")), F.lit(9))
    by = W.partitionBy("source_id").orderBy(rank, "request_id", stage)
    return claims.withColumn("n", F.row_number().over(by)).filter("n = 1").drop("n")


def url_attribution(sources: DataFrame, tries: DataFrame) -> DataFrame:
    """Rows (source_id, kind, request_id, stage, failure): the best witness, or why there is none.

    ``tries``: source_id, kind, stage, request_id, request_ok (linked, successful, one policy), provider_ok
    and steps (metadata steps of that request); kind metadata counts only with one step of the
    request's own provider.  Of failures, a request that does not fit goes before metadata that do not.
    """
    fits = F.col("request_ok") & ((F.col("kind") != "metadata") | (F.col("provider_ok") & (F.col("steps") == 1)))
    best = provenance_witness(tries.filter(fits)).select("source_id", "kind", "request_id", "stage")
    why = tries.groupBy("source_id").agg(
        F.bool_or(~F.col("request_ok")).alias("request_bad"),
        F.bool_or(F.col("request_ok") & (F.col("kind") == "metadata") & ~(F.col("provider_ok") & (F.col("steps") == 1))).alias("metadata_bad"))
    out = sources.select("source_id").join(best, "source_id", "left").join(why, "source_id", "left")
    failure = F.when(F.col("request_bad"), "source.url-request-mismatch").when(F.col("metadata_bad"), "source.url-metadata-mismatch").otherwise("source.url-unattributed")
    return out.select("source_id", "kind", "request_id", "stage", F.when(F.col("kind").isNull(), failure).alias("failure"))


#: Fields that a metadata step may vouch for.
VOUCHED = (
    "identifiers.doi", "identifiers.pmid", "identifiers.pmcid", "canonicalUrl", "title", "authors", "containerTitle", "publisher", "volume",
    "issue", "pages", "published", "published.date", "publicationType", "peerReviewStatus", "accessLevel", "lineage.studyId", "lineage.cohortIds", "lineage.datasetIds")


def source_issues(sources: DataFrame) -> DataFrame:
    """Semantic issues of sources: relations and steps that do not fit or come twice, and repeated members of lists."""
    from tessera.operators.records import issues

    repeated = lambda c: F.size(F.array_distinct(c)) < F.size(c)
    unfit = F.exists("provenance", lambda p: ~F.array_contains("retrieval_request_ids", p["request_id"]) | ~p["field"].isin(*VOUCHED))
    lineage, provenance = "source.invalid-lineage", "source.invalid-provenance"
    return issues(sources, [
        ("/lineage/relationTypes", lineage, F.size("related_source_ids") != F.size("relation_types")),
        ("/retrievalRequestIds", provenance, repeated("retrieval_request_ids")),
        ("/metadataProvenance", provenance, repeated(F.transform("provenance", lambda p: F.struct(p["field"], p["provider"], p["request_id"]))) | unfit),
        ("/authors", provenance, repeated("authors")),
        ("/lineage/cohortIds", lineage, repeated("cohorts")),
        ("/lineage/datasetIds", lineage, repeated("datasets")),
        ("/lineage/relatedSourceIds", lineage, repeated(F.arrays_zip("related_source_ids", "relation_types"))),
    ], ["source_id", "revision"])
