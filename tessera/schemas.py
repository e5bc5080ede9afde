"""Record schemas: types, closed keys, patterns, enums and bounds at every depth, and cross-field rules.

A schema is data (``SCHEMAS``), and all else follows from it: the Spark type of a record, the
rules of its fields, and a table with a row for each place in the schema.  ``validate`` parses
each JSON line once.  A line whose parsed record, written again, equals the line as a variant has
exactly the schema's keys and types, and only needs the rules of its fields, which are
expressions over the parsed struct.  Other lines are unfolded as variants, level by level, to rows
(pointer, place, value), which meet the table of places: there each unknown or missing key and
each wrong type is told.

Defined results, in this order for each line: too large (``schema.too-large``), no JSON or a key
twice (``schema.malformed``); then what breaks at a place, where an object with wrong keys is not
looked into; then, if nothing broke, the rules of the whole record.  A nullable place that breaks
in more than one way is just of the wrong type.  A null line is malformed; equal issues of a line
are one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.identifiers import id_pattern, is_timestamp, portable_path
from tessera.operators.records import blank
from tessera.plans.cut import cut

MOST_BYTES = 4 << 20
SHA256 = "^[a-f0-9]{64}$"
TIMESTAMP = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{3}Z$"


@dataclass(frozen=True)
class Place:
    """What a schema asks of one place in a record."""

    kind: str
    nullable: bool = False
    pattern: str | None = None
    values: tuple[str, ...] = ()
    low: float | None = None
    high: float | None = None
    const: float | None = None
    fields: dict[str, Place] = field(default_factory=dict)
    item: Place | None = None
    rule: str | None = None  # of an object whose places are all right


TEXT, FLAG = Place("string"), Place("boolean")
POSITIVE, NATURAL = Place("integer", low=1), Place("integer", low=0)


def maybe(place: Place) -> Place:
    return replace(place, nullable=True)


def named(kind: str) -> Place:
    return Place("string", pattern=id_pattern(kind))


def one_of(*values: str) -> Place:
    return Place("string", values=values)


def thing(rule: str | None = None, **fields: Place) -> Place:
    return Place("object", fields=fields, rule=rule)


def many(item: Place) -> Place:
    return Place("array", item=item)


def ref(kind: str, key: str) -> Place:
    return thing(**{key: named(kind), "revision": POSITIVE})


_VERSION, _SHARE, _AT, _SHA = Place("number", const=1), Place("number", low=0, high=1), Place("string", pattern=TIMESTAMP), Place("string", pattern=SHA256)
_MAYBE = maybe(TEXT)
_PAIR = thing(name=TEXT, value=TEXT)
_FILE = thing("portable", relativePath=TEXT, mediaType=TEXT, decodedBytes=NATURAL, sha256=_SHA)
_RESPONSE = thing(relativePath=Place("string", pattern="(?s)."), mediaType=TEXT, decodedBytes=NATURAL, sha256=_SHA)

#: The six kinds of records, with their fields and enums.
SCHEMAS: dict[str, Place] = {
    "sources": thing(
        schemaVersion=_VERSION, sourceId=named("source"), revision=POSITIVE, identifiers=thing(doi=_MAYBE, pmid=_MAYBE, pmcid=_MAYBE), canonicalUrl=TEXT, title=TEXT,
        authors=many(thing(family=_MAYBE, given=_MAYBE, literal=_MAYBE, orcid=_MAYBE)), containerTitle=_MAYBE, publisher=_MAYBE, volume=_MAYBE, issue=_MAYBE, pages=_MAYBE,
        published=thing(date=_MAYBE, precision=one_of("day", "month", "year", "unknown")),
        publicationType=one_of("journal-article", "preprint", "review", "dataset", "registry", "standard", "web", "other"), peerReviewStatus=one_of("yes", "no", "unknown", "not-applicable"),
        accessLevel=one_of("metadata-only", "abstract-only", "partial-text", "full-text"), retrievedAt=_AT, retrievalRequestIds=many(named("request")),
        metadataProvenance=many(thing(field=TEXT, provider=TEXT, requestId=named("request"))),
        lineage=thing(
            studyId=_MAYBE, cohortIds=many(TEXT), datasetIds=many(TEXT), relatedSourceIds=many(named("source")),
            relationTypes=many(one_of("version-of", "correction-of", "reanalysis-of", "reports", "shares-cohort", "shares-dataset")))),
    "claims": thing(
        schemaVersion=_VERSION, claimId=named("claim"), revision=POSITIVE, statement=TEXT, kind=one_of("externally-verifiable-fact", "derived-result", "synthesis", "non-factual-framing"),
        materiality=one_of("load-bearing", "contextual"), scopeQualifiers=thing(population=_MAYBE, intervention=_MAYBE, comparator=_MAYBE, outcome=_MAYBE, timeRange=_MAYBE),
        evidenceRule=thing(minimumLineages=NATURAL, independentVerificationAllowed=FLAG, primarySourceRequired=FLAG, fullTextRequired=FLAG),
        status=one_of("proposed", "supported", "disputed", "rejected", "unresolved"), confidence=_SHARE, evidenceRefs=many(ref("evidence", "evidenceId")),
        conflictClaimIds=many(named("claim")), createdByAttemptId=named("attempt")),
    "evidence": thing(
        schemaVersion=_VERSION, evidenceId=named("evidence"), revision=POSITIVE, claimRef=ref("claim", "claimId"), evidenceType=one_of("retrieved", "derived"),
        sourceRef=maybe(ref("source", "sourceId")), calculationId=maybe(named("calculation")), stance=one_of("supporting", "contradicting", "neutral"), quotes=many(TEXT),
        locators=many(thing(type=one_of("page", "section", "paragraph", "figure", "table", "equation", "timestamp", "record", "unknown"), value=TEXT)),
        extractedValues=many(thing(value=TEXT, numericValue=maybe(Place("number")), unit=_MAYBE, context=TEXT)), method=_MAYBE,
        quality=one_of("primary-peer-reviewed", "primary-unreviewed", "official", "secondary", "unknown"), confidence=_SHARE, recordedByAttemptId=named("attempt"),
        verificationStatus=one_of("unverified", "verified", "rejected", "disputed"), conflictsWith=many(named("evidence"))),
    "verifications": thing(
        schemaVersion=_VERSION, verificationId=named("verification"), revision=POSITIVE, attemptId=named("attempt"), method=one_of("independent-source", "recomputation", "rederivation", "mixed"),
        checkedClaims=many(ref("claim", "claimId")), checkedEvidence=many(ref("evidence", "evidenceId")), requestIds=many(named("request")), calculationIds=many(named("calculation")),
        result=one_of("accepted", "rejected", "incomplete"), corrections=many(thing(claimId=named("claim"), description=TEXT)), independentEvidenceIds=many(named("evidence")), notes=TEXT),
    "calculations": thing(
        schemaVersion=_VERSION, calculationId=named("calculation"), attemptId=named("attempt"), sandboxPolicySha256=_SHA, runtime=TEXT, command=TEXT, environment=many(_PAIR), inputs=many(_FILE),
        sourceFiles=many(_FILE), outputs=many(_FILE), networkEnabled=FLAG, startedAt=_AT, endedAt=_AT, exitCode=maybe(Place("integer")), status=one_of("success", "failed", "cancelled")),
    "requests": thing(
        schemaVersion=_VERSION, requestId=named("request"), attemptId=named("attempt"), executionEpoch=NATURAL, logicalRequestId=TEXT, physicalAttemptOrdinal=POSITIVE, retryOfRequestId=maybe(named("request")),
        replayPolicy=one_of("safe-read", "never"), provider=one_of("openalex", "crossref", "pubmed", "pmc", "semantic-scholar", "unpaywall", "web"), operation=one_of("search", "fetch", "resolve"),
        normalizedInput=thing(query=_MAYBE, identifier=_MAYBE, url=_MAYBE, parameters=many(_PAIR)), accessPolicySha256=_SHA, startedAt=_AT, endedAt=_AT,
        status=one_of("success", "partial", "retryable-error", "terminal-error", "cancelled"), httpStatus=maybe(NATURAL), requestedUrl=_MAYBE, finalUrl=_MAYBE, redirectUrls=many(TEXT), responseSha256=maybe(_SHA),
        responseFile=maybe(_RESPONSE), encodedBytes=NATURAL, decodedBytes=NATURAL, resultSourceIds=many(named("source")), errorClass=_MAYBE),
}
ISSUE = "struct<path: string, code: string>"


def ddl(place: Place, loose: bool = False) -> str:
    """Spark type of a place, keys in order; ``loose`` takes whole numbers in any writing."""
    if place.kind == "object":
        return "struct<" + ", ".join(f"`{k}`: {ddl(place.fields[k], loose)}" for k in sorted(place.fields)) + ">"
    if place.kind == "array":
        return f"array<{ddl(place.item, loose)}>"
    whole = place.kind == "integer" or place.const is not None
    return {"string": "string", "boolean": "boolean"}.get(place.kind, "bigint" if whole and not loose else "double")


def _none() -> Column:
    return F.array().cast(f"array<{ISSUE}>")


def _told(path: Column, code: str) -> Column:
    return F.struct(path.alias("path"), F.lit(code).alias("code"))


def _if(bad: Column, path: Column, code: str) -> Column:
    return F.when(F.coalesce(bad, F.lit(True)), F.array(_told(path, code))).otherwise(_none())


def _concat(parts: list[Column]) -> Column | None:
    return F.concat(*parts) if len(parts) > 1 else parts[0] if parts else None


def _rules(place: Place, c: Column, path: Column) -> Column:
    """Issues of a place whose value has the schema's keys and types, but may be null."""
    if place.kind == "object":
        parts = [_rules(x, c[k], F.concat(path, F.lit(f"/{k}"))) for k, x in place.fields.items()]
        found = _concat(parts)
        if place.rule == "portable":
            broken = _if(~portable_path(c["relativePath"]), F.concat(path, F.lit("/relativePath")), "calculation.relative-path")
            found = F.transform(F.array(found), lambda x: F.when(F.size(x) > 0, x).otherwise(broken))[0]
        if place.nullable:
            found = F.transform(F.array(found), lambda x: F.when(F.size(x) > 1, F.array(_told(path, "schema.type"))).otherwise(x))[0]
    elif place.kind == "array":
        plain = place.item.kind == "string" and not place.item.pattern and not place.item.values
        if plain:
            nulls = F.filter(F.transform(c, lambda x, i: F.when(x.isNull(), i)), lambda i: i.isNotNull())
            found = F.transform(nulls, lambda i: _told(F.concat(path, F.lit("/"), i.cast("string")), "schema.type"))
        else:
            found = F.flatten(F.transform(c, lambda x, i: _rules(place.item, x, F.concat(path, F.lit("/"), i.cast("string")))))
    else:
        parts = [
            *([_if(~c.rlike(place.pattern), path, "schema.pattern" if place.pattern != "(?s)." else "schema.minLength")] if place.pattern else []),
            *([_if(~c.isin(*place.values), path, "schema.enum")] if place.values else []), *([_if(c != place.const, path, "schema.const")] if place.const is not None else []),
            *([_if(c < place.low, path, "schema.minimum")] if place.low is not None else []), *([_if(c > place.high, path, "schema.maximum")] if place.high is not None else [])]
        found = _concat(parts) if parts else _none()
    wrong = [_told(path, "schema.type"), *([_told(path, "schema.enum")] if place.values else []), *([_told(path, "schema.const")] if place.const is not None else [])]
    return F.when(c.isNotNull(), found).otherwise(_none() if place.nullable else F.array(*wrong))


def _whole_rules(kind: str, r: Column) -> Column:
    """Issues of a record whose places are all right."""
    at = lambda p: F.lit(p)
    if kind == "sources":
        return _if(~is_timestamp(r["retrievedAt"]), at("/retrievedAt"), "source.timestamp")
    if kind == "evidence":
        shown = r["sourceRef"].isNotNull() & ((F.size(r["quotes"]) > 0) | (F.size(r["extractedValues"]) > 0))
        derived = r["calculationId"].isNotNull() | F.coalesce(r["method"] != "", F.lit(False))
        return F.when(r["evidenceType"] == "retrieved", _if(~shown, at("/sourceRef"), "evidence.retrieved-requirements")).otherwise(_if(~derived, at("/calculationId"), "evidence.derived-requirements"))
    if kind == "calculations":
        code, status = r["exitCode"], r["status"]
        right = F.when(status == "success", F.coalesce(code == 0, F.lit(False))).when(status == "failed", F.coalesce(code != 0, F.lit(False))).otherwise(code.isNull())
        return F.concat(_if(~(is_timestamp(r["startedAt"]) & is_timestamp(r["endedAt"])), at("/startedAt"), "calculation.timestamp"), _if(~right, at("/exitCode"), "calculation.status-exit"))
    return _none()


def prospective(r: Column) -> Column:
    """Issues of a valid evidence record that is to be taken in: blank quotes, locators or contexts of numbers."""
    code = "evidence.invalid-prospective-record"
    return F.concat(
        _if(F.exists(r["quotes"], blank), F.lit("/quotes"), code), _if(F.exists(r["locators"], lambda x: blank(x["value"])), F.lit("/locators"), code),
        _if(F.exists(r["extractedValues"], lambda x: x["numericValue"].isNotNull() & blank(x["context"])), F.lit("/extractedValues"), code))


# --- lines of another shape: variants against the table of places


def _places(place: Place, at: str = "", maybe_root: str | None = None) -> Iterator[tuple]:
    root = at if place.nullable and place.kind == "object" else maybe_root
    low, high, const = (None if x is None else float(x) for x in (place.low, place.high, place.const))
    yield (at, place.kind, place.nullable, place.pattern, list(place.values), low, high, const, sorted(place.fields), place.rule, root)
    for k, x in place.fields.items():
        yield from _places(x, f"{at}/{k}", root)
    if place.item is not None:
        yield from _places(place.item, f"{at}/*", root)


PLACES = "place string, kind string, nullable boolean, pattern string, enum array<string>, low double, high double, const double, keys array<string>, rule string, root string"


def _depth(place: Place) -> int:
    return 1 + max([_depth(x) for x in (*place.fields.values(), *([place.item] if place.item else []))], default=0)


def _walked(lines: DataFrame, kind: str) -> DataFrame:
    """Rows (line, path, code) of lines (line, raw) of another shape than the schema's."""
    schema = F.broadcast(lines.sparkSession.createDataFrame(list(_places(SCHEMAS[kind])), PLACES))
    nodes = lines.select("line", F.lit("").alias("path"), F.lit("").alias("place"), F.parse_json("raw").alias("v"))
    found = []
    for level in range(_depth(SCHEMAS[kind])):
        # one-element array: each is made once
        made = F.struct(F.schema_of_variant("v").alias("shape"), F.try_variant_get("v", "$", "double").alias("number"), F.try_variant_get("v", "$", "string").alias("text"))
        made = nodes.join(schema, "place").select("*", F.inline(F.array(made)))
        shape, number, text = F.coalesce("shape", F.lit("VOID")), F.col("number"), F.col("text")
        t = (
            F.when(shape == "VOID", "null").when(shape.startswith("OBJECT"), "object").when(shape.startswith("ARRAY"), "array")
            .when(shape == "STRING", "string").when(shape == "BOOLEAN", "boolean").otherwise("number"))
        told = made.withColumn("t", t)
        told = told.select("*", F.inline(F.array(F.struct(F.when(F.col("t") == "object", F.json_object_keys(F.to_json("v"))).alias("own")))))
        number = F.when(F.col("t") == "number", number)
        right = F.when(F.col("kind") == "integer", number == F.floor(number)).otherwise(F.col("t") == F.col("kind"))
        here = F.when(F.col("path") == "", "/").otherwise(F.col("path"))
        pointer = lambda k: F.concat("path", F.lit("/"), F.replace(F.replace(k, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1")))
        one = lambda bad, code: F.when(F.coalesce(bad, F.lit(False)), F.array(_told(here, code))).otherwise(_none())  # noqa: B023, E731
        wrong = F.concat(one(F.lit(True), "schema.type"), one(F.size("enum") > 0, "schema.enum"), one(F.col("const").isNotNull(), "schema.const"))
        object_issues = F.concat(
            F.transform(F.array_except("keys", "own"), lambda k: _told(pointer(k), "schema.required")),  # noqa: B023
            F.transform(F.array_except("own", "keys"), lambda k: _told(pointer(k), "schema.additionalProperties")))  # noqa: B023
        value_issues = F.concat(
            one(F.col("pattern").isNotNull() & ~F.rlike(text, F.col("pattern")), "schema.pattern"), one((F.size("enum") > 0) & ~F.array_contains("enum", text), "schema.enum"),
            one(number < F.col("low"), "schema.minimum"), one(number > F.col("high"), "schema.maximum"), one(number != F.col("const"), "schema.const"))
        issues = (
            F.when((F.col("t") == "null") & F.col("nullable"), _none()).when(~F.coalesce(right, F.lit(False)), wrong)
            .when(F.col("kind") == "object", object_issues).when(F.col("kind") == "array", _none()).otherwise(value_issues))
        judged = cut(told.withColumn("issues", issues).select("line", "path", "place", "root", "pattern", "rule", "t", "v", "issues"))
        least = F.when((F.col("i.code") == "schema.pattern") & (F.col("pattern") == "(?s)."), "schema.minLength").otherwise(F.col("i.code"))
        found.append(judged.select("line", "root", "pattern", F.explode("issues").alias("i")).select("line", "root", F.col("i.path").alias("path"), least.alias("code")))
        portable = judged.filter((F.col("rule") == "portable") & (F.col("t") == "object") & ~portable_path(F.try_variant_get("v", "$.relativePath", "string")))
        found.append(portable.select("line", "root", F.concat("path", F.lit("/relativePath")).alias("path"), F.lit("calculation.relative-path").alias("code")))
        inner = judged.filter((F.size("issues") == 0) & F.col("t").isin("object", "array"))
        children = inner.select("line", F.col("path").alias("over"), F.col("place").alias("above"), "v").lateralJoin(lines.sparkSession.tvf.variant_explode(F.col("v").outer()).toDF("at", "key", "value"))
        name = F.replace(F.replace(F.col("key"), F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))
        nodes = children.select("line", F.concat("over", F.lit("/"), F.coalesce(name, F.col("at").cast("string"))).alias("path"), F.concat("above", F.lit("/"), F.coalesce("key", F.lit("*"))).alias("place"), F.col("value").alias("v"))
    every = cut(reduce(DataFrame.unionByName, found).distinct())
    parent = F.regexp_replace("path", "/[^/]*$", "")
    others = every.filter("code <> 'calculation.relative-path'").select("line", parent.alias("of")).distinct()
    alone = every.filter("code = 'calculation.relative-path'").withColumn("of", parent).join(others, ["line", "of"], "left_anti").drop("of")
    every = every.filter("code <> 'calculation.relative-path'").unionByName(alone)
    # a nullable object that breaks in more than one way is of the wrong type
    sets = every.filter("root is not null").groupBy("line", "root").agg(F.collect_set(F.struct("path", "code")).alias("s"))
    sets = sets.select("line", F.inline(F.when(F.size("s") > 1, F.array(_told(F.col("root"), "schema.type"))).otherwise(F.col("s"))))
    return every.filter("root is null").select("line", "path", "code").unionByName(sets)


def validate(lines: DataFrame, kind: str, most_bytes: int = MOST_BYTES, taken_in: bool = False) -> DataFrame:
    """Rows (line, path, code) for JSON lines (line, raw); ``taken_in`` adds the rules of prospective evidence."""
    place = SCHEMAS[kind]
    # one-element array: the line is parsed once, whatever reads it
    parsed = F.struct(F.from_json("raw", ddl(place)).alias("r"), F.to_json(F.try_parse_json("raw")).alias("sorted"))
    seen = lines.select("line", "raw", F.octet_length("raw").alias("bytes"), F.inline(F.array(parsed)))
    shape = (
        F.when(F.col("bytes") > most_bytes, "schema.too-large").when(F.col("sorted").isNull(), "schema.malformed")
        .when(F.col("sorted") == F.to_json("r", {"ignoreNullFields": "false"}), "same").otherwise("other"))

    def rules(places: Column) -> Column:
        late = _whole_rules(kind, F.col("r"))
        if taken_in and kind == "evidence":
            late = F.transform(F.array(late), lambda x: F.when(F.size(x) > 0, x).otherwise(prospective(F.col("r"))))[0]
        return F.transform(F.array(places), lambda x: F.when(F.size(x) > 0, x).otherwise(late))[0]

    # arrays of one element again: a filter on what they give is not made a second time below it
    seen = seen.select("line", "raw", "r", F.inline(F.array(F.struct(shape.alias("shape")))))
    issues = F.when(F.col("shape") == "same", rules(_rules(place, F.col("r"), F.lit("")))).when(F.col("shape") == "other", _none()).otherwise(F.array(F.struct(F.lit("/").alias("path"), F.col("shape").alias("code"))))
    told = seen.select("line", "raw", "shape", F.inline(F.array(F.struct(issues.alias("found"))))).filter("shape = 'other' or size(found) > 0")
    told = cut(told.select("line", F.when(F.col("shape") == "other", F.col("raw")).alias("raw"), "found"))
    right_away = told.select("line", F.inline("found"))
    other = told.filter("raw is not null").select("line", "raw")
    if other.isEmpty():
        return right_away.distinct()
    walked = cut(_walked(other, kind))
    right = other.join(walked.select("line").distinct(), "line", "left_anti").select("line", F.inline(F.array(F.struct(F.from_json("raw", ddl(place, loose=True)).alias("r")))))
    return right_away.unionByName(walked).unionByName(right.select("line", F.inline(rules(_none())))).distinct()
