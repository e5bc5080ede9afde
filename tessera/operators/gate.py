"""The claim gate: which evidence qualifies, how many independent components back a claim, what blocks it.

All inputs are DataFrames; the decision of every claim is one aggregation over its evidence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.operators.records import blank
from tessera.plans.cut import stored

# Fixed values.
LIVE = ("unverified", "verified")
DEAD_CLAIMS = ("rejected", "disputed", "unresolved")
PRIMARY = ("primary-peer-reviewed", "primary-unreviewed")
INDEPENDENT = ("independent-source", "mixed")


def _numbers_explained() -> Column:
    return F.forall("extracted_values", lambda v: v["numeric_value"].isNull() | (~blank(v["context"]) & ~blank(v["unit"])))


def _located() -> Column:
    return F.exists("locators", lambda p: (p["type"] != "unknown") & ~blank(p["value"]))


def _told() -> dict[str, Column]:
    """What the rules read of an evidence record's own lists, so that these need not go through joins."""
    quotes, values = F.coalesce(F.size("quotes"), F.lit(0)), F.coalesce(F.size("extracted_values"), F.lit(0))
    context = F.exists("extracted_values", lambda v: ~blank(v["value"]) & ~blank(v["context"]))
    quoted = F.exists("quotes", lambda q: ~blank(q)) & _located()
    return {
        "_stated": ((quotes > 0) | (values > 0)) & _numbers_explained(), "_placed": (quotes == 0) | _located(), "_result": (context | quoted) & _numbers_explained(),
        "_by_method": ~blank(F.col("method")) & (F.col("source_id").isNotNull() | F.exists("extracted_values", lambda v: ~blank(v["context"])))}


def qualifies_retrieved() -> Column:
    """Source known; a quote or a value; numbers with context and unit; located quotes unless only metadata was read."""
    return F.coalesce(F.col("source_known") & F.col("_stated") & (F.col("_placed") | (F.col("access_level") == "metadata-only")), F.lit(False))


def qualifies_derived() -> Column:
    """A result with context, numbers explained, and a method or a valid calculation behind it."""
    return F.coalesce(F.col("_result") & (F.col("_by_method") | F.col("calculation_valid")), F.lit(False))


def sound_calculation() -> Column:
    """Success with exit code 0, something read and written, unique paths, sizes, 64-digit hashes."""
    files = F.concat("inputs", "source_files", "outputs")
    unique = F.size(F.array_distinct(F.transform(files, lambda f: f["relative_path"]))) == F.size(files)
    sound = F.forall(files, lambda f: f["sha256"].rlike("^[0-9a-f]{64}$") & f["decoded_bytes"].between(0, 2**53 - 1))
    return F.coalesce(
        (F.col("status") == "success") & (F.col("exit_code") == 0)
        & (F.size("inputs") + F.size("source_files") > 0) & (F.size("outputs") > 0) & unique & sound, F.lit(False))


def qualify(evidence: DataFrame, sources: DataFrame, calculations: DataFrame) -> DataFrame:
    """Adds qualified, relation, tokens, unknown_lineage, access_level and derived_key to evidence records.

    ``evidence``: evidence_id, revision, claim_id, claim_revision, evidence_type, source_id,
    source_revision, calculation_id, stance, verification_status, quality, quotes, locators,
    extracted_values, method, recorded_by.  ``sources``: source_id, revision, access_level, study,
    cohorts, datasets, relation (its component's smallest source).  ``calculations``:
    calculation_id, attempt_id (the evidence's, if valid) and as ``sound_calculation`` reads them.
    """
    some = lambda kind, c: F.transform(F.filter(c, lambda x: x != ""), lambda x: F.concat(F.lit(f"{kind}:"), x))
    s = sources.select(
        F.col("source_id").alias("sid"), F.col("revision").alias("srev"), "access_level", "study", F.col("relation").cast("string").alias("relation"),
        F.concat(F.array(F.concat(F.lit("study:"), "study")), some("cohort", "cohorts"), some("dataset", "datasets")).alias("tokens"))
    c = calculations.select(F.col("calculation_id").alias("cid"), "attempt_id", sound_calculation().alias("sound"))
    told = evidence.withColumns(_told())
    # evidence without a calculation stays where it is
    out = told.filter("calculation_id is not null").join(c, F.col("calculation_id") == F.col("cid"), "left").drop("cid")
    out = out.unionByName(told.filter("calculation_id is null"), allowMissingColumns=True)
    out = out.withColumn("calculation_valid", F.coalesce((F.col("attempt_id") == F.col("recorded_by")) & F.col("sound"), F.lit(False)))
    out = out.join(s, (F.col("source_id") == F.col("sid")) & (F.col("source_revision") == F.col("srev")), "left").withColumn("source_known", F.col("sid").isNotNull())
    retrieved = F.col("evidence_type") == "retrieved"
    key = F.when(F.col("calculation_valid"), F.concat(F.lit("derived-calculation:"), "calculation_id")).otherwise(F.concat(F.lit("derived-method:"), "evidence_id"))
    return out.select(
        *evidence.columns, F.when(retrieved, qualifies_retrieved()).otherwise(qualifies_derived()).alias("qualified"), "relation", "tokens",
        (retrieved & blank(F.col("study"))).alias("unknown_lineage"), "access_level", F.when(~retrieved, key).alias("derived_key"))


def local_components(items: Column) -> Column:
    """Components (tokens, key) of a claim's selected sources, an array of (relation, tokens).

    Two sources belong together if they share the relation component of the whole snapshot or
    a metadata token of the selected revisions; tokens of sources that are not selected do not
    count.  ``key`` is the smallest relation.  A claim's sources are bounded, so the components
    are merged inside its row.
    """
    start = F.expr("cast(array() as array<struct<tokens: array<string>, key: string>>)")
    own = lambda i: F.concat(i["tokens"], F.array(F.concat(F.lit("relation:"), i["relation"])))

    def merge(found: Column, item: Column) -> Column:
        tokens = own(item)
        met = F.filter(found, lambda g: F.arrays_overlap(g["tokens"], tokens))
        rest = F.filter(found, lambda g: ~F.arrays_overlap(g["tokens"], tokens))
        keys = F.concat(F.transform(met, lambda g: g["key"]), F.array(item["relation"]))
        whole = F.array_union(F.flatten(F.transform(met, lambda g: g["tokens"])), tokens)
        return F.concat(rest, F.array(F.struct(whole.alias("tokens"), F.array_min(keys).alias("key"))))

    return F.aggregate(items, start, merge)


def applicable_verifications(verifications: DataFrame) -> DataFrame:
    """For each claim ref the latest revision of each verification that checks it."""
    each = verifications.select("*", F.explode("checked_claims").alias("claim"))
    by = W.partitionBy("claim.id", "claim.revision", "verification_id").orderBy(F.desc("revision"))
    return each.withColumn("n", F.row_number().over(by)).filter("n = 1").drop("n")


def blockers() -> Column:
    """Blockers in their fixed order, from the columns that ``decide`` makes."""
    short = F.col("resolved") < F.col("effective_minimum")
    wants = short & F.col("independent_allowed") & (F.col("credit") == 0)
    rules = (
        ("claim.unsupported", F.col("status").isin(*DEAD_CLAIMS) | (F.col("qualifying") == 0)),
        ("claim.invalid-derived-evidence", (F.col("kind") == "derived-result") & (F.col("derived") == 0)),
        ("claim.primary-source-required", F.col("primary_required") & ~F.col("has_primary")),
        ("claim.full-text-required", F.col("full_text_required") & F.col("lacks_full_text")),
        ("claim.unresolved-lineage", F.col("unknown_lineage") & short),
        ("claim.unresolved-conflict", F.col("in_conflict") & ~F.col("conflict_resolved")),
        ("claim.independent-verification-required", wants),
        ("claim.insufficient-lineages", (F.col("resolved") + F.col("credit") < F.col("effective_minimum")) & ~wants),
    )
    return F.array_compact(F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.lit(code)) for code, cond in rules]))


def decide(claims: DataFrame, evidence: DataFrame, credits: DataFrame | None = None, conflicts: DataFrame | None = None) -> DataFrame:
    """One decision a claim.

    ``claims``: claim_id, status, kind, minimum, independent_allowed, primary_required,
    full_text_required.  ``evidence``: claim_id, evidence_type, stance, verification_status,
    quality, access_level, component (null: lineage unknown), qualified.  ``credits``:
    claim_id of those with an independent verification.  ``conflicts``: claim_id, resolved.
    """
    live = (F.col("stance") == "supporting") & F.col("verification_status").isin(*LIVE) & F.col("qualified")
    retrieved = live & (F.col("evidence_type") == "retrieved")
    facts = evidence.groupBy("claim_id").agg(
        F.count_if(live).alias("qualifying"),
        F.count_distinct(F.when(retrieved, F.col("component"))).alias("retrieved"),
        F.count_distinct(F.when(live & (F.col("evidence_type") == "derived"), F.col("component"))).alias("derived"),
        F.coalesce(F.bool_or(retrieved & F.col("quality").isin(*PRIMARY)), F.lit(False)).alias("has_primary"),
        F.coalesce(F.bool_or(retrieved & (F.col("access_level") != "full-text")), F.lit(False)).alias("lacks_full_text"),
        F.coalesce(F.bool_or(retrieved & F.col("component").isNull()), F.lit(False)).alias("unknown_lineage"),
        F.count_if(F.col("stance") == "contradicting").alias("contradicting"),
    )
    out = claims.join(facts, "claim_id", "left").na.fill(0, ["qualifying", "retrieved", "derived", "contradicting"]).na.fill(False, ["has_primary", "lacks_full_text", "unknown_lineage"])
    if credits is None:
        out = out.withColumn("credit", F.lit(0))
    else:
        got = credits.select("claim_id").distinct().withColumn("credit", F.lit(1))
        out = out.join(got, "claim_id", "left").withColumn("credit", F.when(F.col("independent_allowed"), F.coalesce("credit", F.lit(0))).otherwise(0))
    out = out.withColumn("in_conflict", F.col("contradicting") > 0)
    if conflicts is None:
        out = out.withColumn("conflict_resolved", F.lit(False))
    else:
        more = conflicts.groupBy("claim_id").agg(F.bool_and("resolved").alias("conflict_resolved"))
        out = out.join(more, "claim_id", "left").withColumn("in_conflict", F.col("in_conflict") | F.col("conflict_resolved").isNotNull())
        out = out.withColumn("conflict_resolved", F.coalesce("conflict_resolved", F.lit(False)))
    out = out.withColumn("resolved", F.col("retrieved") + F.col("derived"))
    floor = F.when(F.col("kind") == "externally-verifiable-fact", 1).otherwise(0)
    out = out.withColumn("effective_minimum", F.greatest(floor, F.col("minimum"))).withColumn("blockers", blockers())
    return out.withColumn("passes", F.size("blockers") == 0)


def stale_refs(claims: DataFrame, latest_evidence: DataFrame) -> DataFrame:
    """References that the latest claim revision newly makes to evidence that is not the latest."""
    by = W.partitionBy("claim_id").orderBy("revision")
    seen = claims.withColumn("before", F.lag("evidence_refs").over(by)).withColumn("top", F.max("revision").over(W.partitionBy("claim_id")))
    fresh = seen.filter(F.col("revision") == F.col("top")).select("claim_id", "revision", F.explode(F.array_except("evidence_refs", F.coalesce("before", F.expr("filter(evidence_refs, x -> false)")))).alias("ref"))
    top = latest_evidence.select(F.col("evidence_id").alias("e"), F.col("revision").alias("latest"))
    return fresh.join(top, F.col("ref.id") == F.col("e")).filter("ref.revision < latest").select("claim_id", "revision", "ref", F.lit("evidence.stale-latest-ref").alias("code"))


def conflict_resolved(checks: DataFrame, used: DataFrame) -> DataFrame:
    """Claims resolved by one verification that checks every used record and corrects the claim.

    ``checks``: claim_id, verification_id, evidence_id of eligible verifications with a
    correction.  ``used``: claim_id, evidence_id, rejected (contradictions must be).
    """
    need = used.groupBy("claim_id").agg(F.count_distinct("evidence_id").alias("need"), F.bool_and("rejected").alias("all_rejected"))
    have = checks.join(used.select("claim_id", "evidence_id").distinct(), ["claim_id", "evidence_id"]).groupBy("claim_id", "verification_id").agg(F.count_distinct("evidence_id").alias("have"))
    best = have.groupBy("claim_id").agg(F.max("have").alias("have"))
    return need.join(best, "claim_id", "left").select("claim_id", F.coalesce((F.col("have") == F.col("need")) & F.col("all_rejected"), F.lit(False)).alias("resolved"))


def evaluate(claims: DataFrame, evidence: DataFrame, verifications: DataFrame, contradictions: DataFrame, conflict_claims: DataFrame | None = None) -> DataFrame:
    """The gate's decision of each claim revision, from records.

    ``claims``: claim_id, revision, status, kind, minimum, independent_allowed, primary_required,
    full_text_required, created_by, evidence_refs (id, revision).  ``evidence``: rows of
    ``qualify``.  ``verifications``: verification_id, revision, checked_claims (id, revision),
    checked_evidence (id, revision), result, method, attempt_id, independent_evidence_ids,
    corrections (claim_id, description).  ``contradictions``: claim_id, evidence_id, revision,
    rejected, of the claim's conflict closure; ``conflict_claims``: claim_id of claims with
    conflicting claims.  Only references of a claim to evidence of the same claim revision count.
    """
    refs = claims.select("claim_id", F.col("revision").alias("claim_revision"), F.explode(F.array_distinct("evidence_refs")).alias("ref"))
    refs = refs.select("claim_id", "claim_revision", F.col("ref.id").alias("evidence_id"), F.col("ref.revision").alias("revision"))
    # of what was not accepted only the revision tells; the rest stays out of the shuffle, and what is left is stored, as it is used twice
    accepted = F.col("result") == "accepted"
    told = verifications.withColumns({c: F.when(accepted, F.col(c)) for c in ("checked_evidence", "independent_evidence_ids", "corrections")})
    checked = applicable_verifications(told).filter(accepted).drop("revision")
    checked = checked.select("verification_id", "checked_evidence", "method", "attempt_id", "independent_evidence_ids", "corrections", F.col("claim.id").alias("claim_id"), F.col("claim.revision").alias("revision"))
    checked = stored(checked)
    offers = checked.filter(F.col("method").isin(*INDEPENDENT)).withColumn("id", F.explode("independent_evidence_ids"))
    offers = offers.withColumn("same", F.filter("checked_evidence", lambda r: r["id"] == F.col("id"))).filter("size(same) = 1")
    offers = offers.select("claim_id", F.col("revision").alias("claim_revision"), F.col("id").alias("evidence_id"), F.col("same")[0]["revision"].alias("revision"), F.col("attempt_id").alias("by"))

    # evidence is read once, with what claims cite and verifications offer of it
    keys = ["claim_id", "claim_revision", "evidence_id", "revision"]
    marks = refs.withColumn("cited", F.lit(True)).unionByName(offers.withColumn("cited", F.lit(False)), allowMissingColumns=True)
    marks = marks.groupBy(*keys).agg(F.bool_or("cited").alias("cited"), F.collect_set("by").alias("offered_by"))
    live = (F.col("stance") == "supporting") & F.col("verification_status").isin(*LIVE) & F.col("qualified")
    cited, retrieved = F.col("cited"), F.col("evidence_type") == "retrieved"
    good = evidence.filter(live).join(marks, keys).withColumn("offered", F.exists("offered_by", lambda x: x == F.col("recorded_by"))).filter(cited | F.col("offered"))
    # dealt by claim, as claims and contradictions are, so that facts need no second shuffle
    facts = good.repartition("claim_id").groupBy("claim_id", F.col("claim_revision").alias("revision")).agg(
        F.count_if(cited).alias("qualifying"), F.collect_list(F.when(cited & retrieved & ~F.col("unknown_lineage"), F.struct("relation", "tokens"))).alias("items"),
        F.collect_set(F.when(cited, F.col("derived_key"))).alias("derived_keys"), F.coalesce(F.bool_or(cited & retrieved & F.col("quality").isin(*PRIMARY)), F.lit(False)).alias("has_primary"),
        F.coalesce(F.bool_or(cited & retrieved & (F.col("access_level") != "full-text")), F.lit(False)).alias("lacks_full_text"),
        F.bool_or(cited & F.col("unknown_lineage")).alias("unknown_lineage"), F.collect_set(F.when(cited, F.col("recorded_by"))).alias("recorders"),
        F.collect_list(F.when(cited, F.struct(F.col("evidence_id").alias("id"), F.col("revision")))).alias("used"),
        F.collect_set(F.when(F.col("offered"), F.struct("recorded_by", "evidence_type", "unknown_lineage", "relation", "tokens", "derived_key"))).alias("offered"))
    against = contradictions.groupBy("claim_id").agg(
        F.collect_set(F.struct(F.col("evidence_id").alias("id"), F.col("revision"))).alias("against"), F.bool_and("rejected").alias("all_rejected"))
    none = lambda c, of: F.coalesce(c, F.expr(f"cast(array() as array<{of}>)"))
    ref_type = evidence.select(F.struct(F.col("evidence_id").alias("id"), "revision").alias("r")).schema["r"].dataType.simpleString()
    given = ["status", "kind", "minimum", "independent_allowed", "primary_required", "full_text_required"]
    out = claims.select("claim_id", "revision", "created_by", *given).withColumn("row", F.monotonically_increasing_id()).join(facts, ["claim_id", "revision"], "left").join(against, "claim_id", "left")
    out = out.na.fill(0, ["qualifying"]).na.fill(False, ["has_primary", "lacks_full_text", "unknown_lineage"]).withColumns({
        "components": local_components(none(F.col("items"), "struct<relation: string, tokens: array<string>>")), "derived_keys": none(F.col("derived_keys"), "string"),
        "recorders": none(F.col("recorders"), claims.schema["created_by"].dataType.simpleString()), "used": none(F.col("used"), ref_type), "against": none(F.col("against"), ref_type)})
    out = out.withColumns({
        "retrieved": F.size("components"), "derived": F.size("derived_keys"), "contradicting": F.size("against"),
        "seen": F.flatten(F.transform("components", lambda g: g["tokens"])), "keys": F.transform("components", lambda g: g["key"]),
        "base_attempts": F.array_union("recorders", F.array("created_by"))})

    def fresh(o: Column) -> Column:
        strange = ~o["unknown_lineage"] & ~F.arrays_overlap(F.concat(o["tokens"], F.array(F.concat(F.lit("relation:"), o["relation"]))), F.col("seen")) & ~F.array_contains("keys", o["relation"])
        own = F.when(o["evidence_type"] == "retrieved", strange).otherwise(~F.array_contains("derived_keys", o["derived_key"]))
        return ~F.array_contains("base_attempts", o["recorded_by"]) & own

    out = out.withColumn("credit", F.coalesce(F.exists("offered", fresh), F.lit(False)).cast("int"))

    # a claim's row meets its verifications and is one row again
    corrected = F.exists("corrections", lambda c: (c["claim_id"] == F.col("claim_id")) & ~blank(c["description"]))
    mends = checked.filter(corrected).select("claim_id", "revision", F.col("attempt_id").alias("by"), "checked_evidence")
    whole = F.size(F.array_except(F.array_union("used", "against"), "checked_evidence")) == 0
    settled = (F.col("status") == "supported") & ~F.array_contains("base_attempts", F.col("by")) & whole & F.coalesce("all_rejected", F.lit(True))
    plain = [*given, "qualifying", "has_primary", "lacks_full_text", "unknown_lineage", "retrieved", "derived", "contradicting", "credit"]
    out = out.join(mends, ["claim_id", "revision"], "left").select("claim_id", "revision", "row", *plain, F.coalesce(settled, F.lit(False)).alias("conflict_resolved"))
    out = out.groupBy("claim_id", "revision", "row").agg(*[F.first(c).alias(c) for c in plain], F.bool_or("conflict_resolved").alias("conflict_resolved"))
    rival = conflict_claims.select("claim_id").distinct().withColumn("rival", F.lit(True)) if conflict_claims is not None else None
    out = out.join(rival, "claim_id", "left") if rival is not None else out.withColumn("rival", F.lit(False))
    least = F.when(F.col("kind") == "externally-verifiable-fact", 1).otherwise(0)
    out = out.withColumns({
        "credit": F.when(F.col("independent_allowed"), F.col("credit")).otherwise(0), "resolved": F.col("retrieved") + F.col("derived"),
        "effective_minimum": F.greatest(least, F.col("minimum")), "in_conflict": (F.col("contradicting") > 0) | F.coalesce("rival", F.lit(False))})
    out = out.withColumn("blockers", blockers())
    return out.select("claim_id", "revision", "qualifying", "retrieved", "derived", "resolved", "credit", "effective_minimum", "contradicting", "conflict_resolved", "blockers", (F.size("blockers") == 0).alias("passes"))
