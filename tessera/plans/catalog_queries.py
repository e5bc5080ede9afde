"""Registered queries of search, catalog, providers and records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import schemas
from tessera.functions import canonical
from tessera.functions import identifiers as I
from tessera.operators import catalog, citations, lineage, search
from tessera.operators.ranks import ranked
from tessera.plans import adapters as A
from tessera.plans.adapters import LEDGER_SQL, with_sql
from tessera.plans.queries import register
from tessera.sources import providers

# --- search


@register("search_plan", """
WITH q AS (SELECT s_suppkey AS query_id, 'topic ' || s_nationkey AS text, 10 + s_suppkey % 3 AS caller FROM supplier),
p AS (SELECT r_name AS provider, 12 - r_regionkey AS configured, 11 AS cap FROM region)
SELECT provider, text, least(caller, configured, cap)::INT AS "limit", string_agg(query_id, ',' ORDER BY query_id) AS queries FROM q, p GROUP BY provider, text, least(caller, configured, cap)""")
def search_plan(spark: SparkSession, sf: str) -> DataFrame:
    q = A.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("query_id"), F.concat(F.lit("topic "), F.col("s_nationkey").cast("string")).alias("text"), (10 + F.col("s_suppkey") % 3).cast("int").alias("caller_limit"))
    p = A.table(spark, sf, "region").select(F.col("r_name").alias("provider"), (12 - F.col("r_regionkey")).alias("configured_limit"), F.lit(11).alias("endpoint_cap"))
    return search.plan(q, p).select("provider", "text", "limit", F.array_join(F.transform("queries", lambda x: x.cast("string")), ",").alias("queries"))


@register("follow_up_partitions", """
SELECT event_id AS partition_key, CASE event_type WHEN 'view' THEN 'esummary' WHEN 'click' THEN 'elink' ELSE 'fulltext' END AS operation,
  CASE WHEN value > 40 THEN 'parent-failed' WHEN event_id % 5 = 0 THEN 'no-identifiers' END AS skipped FROM events WHERE event_type IN ('view', 'click', 'purchase')""")
def follow_up_partitions(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "view", "esearch").when(F.col("event_type") == "click", "esummary").when(F.col("event_type") == "purchase", "elink").otherwise("fulltext")
    s = A.table(spark, sf, "events").select(
        F.col("event_id").alias("partition_key"), kind.alias("operation"), F.when(F.col("value") > 40, "failure").otherwise("success").alias("outcome"),
        F.when(F.col("event_id") % 5 == 0, F.expr("cast(array() as array<string>)")).otherwise(F.array(F.lit("1"))).alias("identifiers"))
    return search.follow_ups(s).select("partition_key", "operation", "skipped")


@register("shared_query_quota", """
WITH RECURSIVE d AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n, doc_id % 3 AS q1, (doc_id // 3) % 3 AS q2 FROM documents),
walk AS (
  SELECT source, 0::BIGINT AS n, NULL::BIGINT AS doc_id, false AS kept, [0, 0, 0] AS used FROM d GROUP BY source
  UNION ALL
  SELECT d.source, d.n, d.doc_id, w.used[(d.q1 + 1)::INT] < 4 AND w.used[(d.q2 + 1)::INT] < 4,
    CASE WHEN w.used[(d.q1 + 1)::INT] < 4 AND w.used[(d.q2 + 1)::INT] < 4 THEN list_transform([1, 2, 3], lambda i: w.used[i] + (d.q1 + 1 = i)::INT + (d.q2 + 1 = i AND d.q2 <> d.q1)::INT) ELSE w.used END
  FROM walk w JOIN d ON d.source = w.source AND d.n = w.n + 1)
SELECT source AS search_id, doc_id AS draft_ordinal FROM walk WHERE kept""")
def shared_query_quota(spark: SparkSession, sf: str) -> DataFrame:
    """A source is a search; each draft serves one or two of its three queries, four drafts a query at most."""
    q1, q2 = (F.col("doc_id") % 3).cast("string"), (F.floor(F.col("doc_id") / 3) % 3).cast("string")
    d = A.table(spark, sf, "documents").select(F.col("source").alias("search_id"), F.lit(0).alias("ordinal"), F.col("doc_id").alias("draft_ordinal"), F.array_distinct(F.array(q1, q2)).alias("queries"))
    return search.shared_quota(d, 4).select("search_id", "draft_ordinal")


@register("failure_codes", """
WITH t AS (SELECT event_id, CASE WHEN k IN (1, 3, 7, 8) THEN 'availability' WHEN k = 2 THEN 'terminal-provider' WHEN k = 5 THEN 'cancelled' WHEN k = 6 THEN 'deadline-exceeded' WHEN k = 25 THEN 'invalid-response'
    WHEN k = 26 THEN 'http-retryable' WHEN k = 27 THEN 'http-terminal' WHEN k = 0 THEN 'success' ELSE 'security-policy' END AS trace FROM (SELECT event_id, event_id % 28 AS k FROM events))
SELECT event_id, trace, CASE trace WHEN 'success' THEN NULL WHEN 'http-retryable' THEN 'provider.availability' WHEN 'terminal-provider' THEN 'provider.terminal' WHEN 'http-terminal' THEN 'provider.terminal' ELSE 'provider.' || trace END AS outcome FROM t""")
def failure_codes(spark: SparkSession, sf: str) -> DataFrame:
    """Each event settles with one of all the codes, or without."""
    code = F.element_at(F.array(*[F.lit(c).cast("string") for c in (None, *search.TRANSPORT_CODES)]), (F.col("event_id") % 28 + 1).cast("int"))
    return A.table(spark, sf, "events").select("event_id", search.trace_code(code).alias("trace"), search.provider_code(code).alias("outcome"))


@register("omitted_counts", """
WITH r AS (SELECT user_id, event_id, sum(length(props)) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS running FROM events)
SELECT user_id, count(*) FILTER (WHERE running <= 300) AS kept, count(*) FILTER (WHERE running > 300) AS omitted, coalesce(min(event_id) FILTER (WHERE running <= 300), -1) AS first FROM r GROUP BY user_id""")
def omitted_counts(spark: SparkSession, sf: str) -> DataFrame:
    e = A.table(spark, sf, "events").withColumn("keys", F.sequence(F.lit(1), F.lit(20)))
    b = search.budgeted(e, "user_id", ["event_id"], F.octet_length("props"), 300, members="keys")
    whole = F.forall("kept", lambda k: F.size(k["keys"]) == 16)
    return b.filter(whole).select("user_id", F.size("kept").cast("long").alias("kept"), "omitted", F.coalesce(F.get("kept", F.lit(0))["event_id"], F.lit(-1)).alias("first"))


@register("payload_depth", "SELECT event_id, (2 + event_id % 4)::INT AS depth, props IS NOT NULL AND event_id % 4 < 3 AS fits FROM events")
def payload_depth(spark: SparkSession, sf: str) -> DataFrame:
    k = (F.col("event_id") % 4).cast("int")
    raw = F.concat(F.lit('{"s":"[[{\\"}","a":'), F.repeat(F.lit("["), k + 1), F.lit("1"), F.repeat(F.lit("]"), k + 1), F.lit("}"))
    return A.table(spark, sf, "events").select("event_id", providers.json_depth(raw).alias("depth"), (F.col("props").isNotNull() & providers.well_formed(raw, most_depth=4)).alias("fits"))


# --- scalar rules


@register("identity_rules", """
SELECT p_partkey, 'https://doi.org/10.1234/p(' || p_partkey || ')%2F' || p_size || '%2525' AS doi_url, CASE WHEN p_size % 2 = 0 THEN 'doi:10.1234/' || p_partkey || ',' ELSE '' END || 'url:https://h/' AS keys,
  p_size % 3 = 0 AS allowed, p_size % 4 = 0 AS instant, CASE WHEN p_size % 5 < 3 THEN (p_size % 5 + 6)::INT END AS month, CASE WHEN p_size % 2 = 1 THEN p_name ELSE p_brand END AS first, p_size % 3 <> 1 AS portable FROM part""")
def identity_rules(spark: SparkSession, sf: str) -> DataFrame:
    n, k = F.col("p_partkey").cast("string"), F.col("p_size")
    pick = lambda by, *cases: F.element_at(F.array(*[F.lit(c) for c in cases]), (k % by + 1).cast("int"))
    none = F.lit(None).cast("string")
    doi_url = I.canonical_doi_url(F.concat(F.lit("10.1234/p("), n, F.lit(")/"), k.cast("string"), F.lit("%25")))
    keys = I.identity_keys(F.when(k % 2 == 0, F.concat(F.lit("10.1234/"), n)), none, none, F.lit("https://h/"))
    return A.table(spark, sf, "part").select(
        "p_partkey", doi_url.alias("doi_url"), F.array_join(keys, ",").alias("keys"), I.allowed_origin(pick(3, "https://api.openalex.org/works?q", "https://api.openalex.org:444/", "http://api.openalex.org/"), "openalex").alias("allowed"),
        I.is_timestamp(pick(4, "2024-02-29T23:59:59.999Z", "2023-02-29T00:00:00.000Z", "2024-01-01T00:00:00Z", "2024-01-01 00:00:00.000Z")).alias("instant"), I.month_number(pick(5, "June", "jul", "AUGUST", "Spring", "13")).alias("month"),
        I.first_text(F.when(k % 2 == 1, F.array(F.lit("  "), F.col("p_name"))).otherwise(F.array(F.lit(""), F.col("p_brand"), F.col("p_name")))).alias("first"), I.portable_path(pick(3, "a/b:c.txt", "../a", "d/e f")).alias("portable"))


@register("section_access", """
SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'front' WHEN 1 THEN 'body' WHEN 2 THEN 'unknown' WHEN 3 THEN 'body' WHEN 4 THEN 'front' ELSE 'unknown' END AS class FROM orders""")
def section_access(spark: SparkSession, sf: str) -> DataFrame:
    labels = (" Key_Words ", "Materials and  Methods", "references", "MAIN TEXT-", "article_title", "Zusammenfassung ü")
    label = F.element_at(F.array(*[F.lit(x) for x in labels]), (F.col("o_orderkey") % 6 + 1).cast("int"))
    return A.table(spark, sf, "orders").select("o_orderkey", I.section_class(label).alias("class"))


@register("orcid_check", """
WITH d AS (SELECT c_custkey, lpad((c_custkey * 7919 % 1000000000000000)::VARCHAR, 15, '0') AS n FROM customer),
t AS (SELECT c_custkey, n, (12 - list_sum(list_transform(range(1, 16), lambda i: substring(n, i::INT, 1)::INT * (1 << (16 - i)))) % 11) % 11 AS k FROM d),
f AS (SELECT c_custkey, substring(n, 1, 4) || '-' || substring(n, 5, 4) || '-' || substring(n, 9, 4) || '-' || substring(n, 13, 3) AS head, CASE WHEN k = 10 THEN 'X' ELSE k::VARCHAR END AS k FROM t)
SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 OR k = '5' THEN 'https://orcid.org/' || head || CASE WHEN c_custkey % 3 = 0 THEN k ELSE '5' END END AS orcid FROM f""")
def orcid_check(spark: SparkSession, sf: str) -> DataFrame:
    """Every third customer has the right check character, the others end in 5."""
    n = F.lpad((F.col("c_custkey") * 7919 % 10**15).cast("string"), 15, "0")
    total = sum((F.substring(n, i, 1).cast("long") * (1 << (16 - i)) for i in range(1, 16)), F.lit(0))
    k = F.pmod(12 - F.pmod(total, F.lit(11)), F.lit(11))
    right = F.when(F.col("c_custkey") % 3 != 0, "5").when(k == 10, "X").otherwise(k.cast("string"))
    bare = F.concat(F.concat_ws("-", F.substring(n, 1, 4), F.substring(n, 5, 4), F.substring(n, 9, 4), F.substring(n, 13, 3)), right)
    raw = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("https://orcid.org/"), bare)).otherwise(bare)
    return A.spread(A.table(spark, sf, "customer")).select("c_custkey", I.orcid(raw).alias("orcid"))


@register("partial_dates", """
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN d IS NULL AND m IS NULL THEN y || '' WHEN m NOT BETWEEN 1 AND 12 THEN NULL WHEN d IS NULL THEN y || '-' || lpad(m::VARCHAR, 2, '0')
  WHEN try_cast(y || '-' || lpad(m::VARCHAR, 2, '0') || '-' || lpad(d::VARCHAR, 2, '0') AS DATE) IS NOT NULL THEN y || '-' || lpad(m::VARCHAR, 2, '0') || '-' || lpad(d::VARCHAR, 2, '0') END AS date
FROM (SELECT *, 1990 + l_partkey % 40 AS y, CASE WHEN l_linenumber > 1 THEN l_suppkey % 14 END AS m, CASE WHEN l_linenumber > 2 THEN l_partkey % 33 END AS d FROM lineitem)""")
def partial_dates(spark: SparkSession, sf: str) -> DataFrame:
    y, m = (1990 + F.col("l_partkey") % 40).cast("int"), F.when(F.col("l_linenumber") > 1, F.col("l_suppkey") % 14).cast("int")
    d = F.when(F.col("l_linenumber") > 2, F.col("l_partkey") % 33).cast("int")
    return A.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", I.date_parts(y, m, d).getField("date").alias("date"))


@register("abstract_texts", "SELECT p_partkey, CASE WHEN p_size % 5 <> 0 THEN 'the ' || p_brand || ' of the ' || p_type END AS text FROM part WHERE p_brand <> p_type")
def abstract_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Positions of words; every fifth size has a hole."""
    words = F.map_from_arrays(F.array(F.lit("the"), F.lit("of"), "p_brand", "p_type"), F.array(F.array(F.lit(0), F.lit(3)), F.array(F.lit(2)), F.array(F.lit(1)), F.array(F.when(F.col("p_size") % 5 == 0, 5).otherwise(4))))
    return A.table(spark, sf, "part").filter("p_brand <> p_type").select("p_partkey", I.abstract_text(words).alias("text"))


@register("canonical_texts", """SELECT c_custkey, '{"a":[' || c_custkey || ',null,true],"b":' || CASE WHEN c_nationkey = 0 THEN '0' ELSE c_nationkey || '.5' END || ',"é":"' || c_name || '"}' AS text FROM customer""")
def canonical_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Sorted keys, shortest numbers (a negative zero is 0), plain characters."""
    n = F.col("c_custkey").cast("string")
    number = F.when(F.col("c_nationkey") == 0, "-0.0").otherwise(F.concat(F.col("c_nationkey").cast("string"), F.lit(".50")))
    raw = F.concat(F.lit('{ "\\u00e9" : "'), "c_name", F.lit('", "b":'), number, F.lit(', "a": ['), n, F.lit(", null, true] }"))
    return A.table(spark, sf, "customer").select("c_custkey", canonical.canonical_json(raw).alias("text"))


@register("code_unit_ranks", """
SELECT DISTINCT lang, source, dense_rank() OVER (ORDER BY lang || ':' || source) AS place FROM documents""")
def code_unit_ranks(spark: SparkSession, sf: str) -> DataFrame:
    """Places of the different keys in code-unit order."""
    keys = A.table(spark, sf, "documents").select("lang", "source").distinct()
    return ranked(keys, [I.code_unit_order(F.concat_ws(":", "lang", "source"))], "place").withColumn("place", F.col("place") + 1)


@register("profiles_and_ids", """
SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 15 WHEN 'MACHINERY' THEN 120 END AS minutes, CASE c_mktsegment WHEN 'BUILDING' THEN 12 WHEN 'MACHINERY' THEN 80 END AS sources,
  'claim-' || md5(c_name) AS claim, 'rev-20240229T010203004Z-' || substring(md5(c_name), 1, 12) AS revision,
  'candidate-v1-' || sha256('{"ordinal":' || c_nationkey || ',"provider":"p","recordId":"' || c_name || '","schemaVersion":1,"url":null}') AS key FROM customer""")
def profiles_and_ids(spark: SparkSession, sf: str) -> DataFrame:
    depth = F.when(F.col("c_mktsegment") == "BUILDING", "quick").when(F.col("c_mktsegment") == "MACHINERY", "deep")
    at, draw = F.lit("2024-02-29 01:02:03.004").cast("timestamp"), F.md5("c_name")
    key = I.prefixed_key("candidate", provider=F.lit("p"), recordId=F.col("c_name"), ordinal=F.col("c_nationkey"), url=F.lit(None).cast("string"))
    c = A.table(spark, sf, "customer").withColumn("d", I.depth_profile(depth))
    return c.select("c_custkey", F.col("d.active_minutes").alias("minutes"), F.col("d.max_sources").alias("sources"), I.new_id("claim", draw).alias("claim"), I.new_revision_id(at, F.substring(draw, 1, 12)).alias("revision"), key.alias("key"))


# --- records, catalog and merging


@register("evidence_schema_issues", """
SELECT l_orderkey, l_linenumber, l_partkey, path, code
FROM (SELECT *, l_discount > 0.08 AS c, l_returnflag = 'R' AS s, l_linenumber = 5 AS i FROM lineitem) e,
  (VALUES ('/confidence', 'schema.maximum'), ('/stance', 'schema.enum'), ('/evidenceId', 'schema.pattern'), ('/sourceRef', 'evidence.retrieved-requirements'), ('/quotes', 'evidence.invalid-prospective-record')) v(path, code)
WHERE (path = '/confidence' AND c) OR (path = '/stance' AND s) OR (path = '/evidenceId' AND i) OR (path = '/sourceRef' AND l_linenumber = 3 AND NOT (c OR s OR i))
  OR (path = '/quotes' AND l_suppkey % 10 = 0 AND l_linenumber <> 3 AND NOT (c OR s OR i)) GROUP BY ALL""")
def evidence_schema_issues(spark: SparkSession, sf: str) -> DataFrame:
    li, n = A.spread(A.table(spark, sf, "lineitem")), F.col("l_linenumber")
    named = lambda p, c: F.concat(F.lit(p), F.lpad(c.cast("string"), 16, "0"))
    ref = lambda name, value: F.struct(value.alias(name), F.lit(1).alias("revision"))
    e = F.struct(
        F.lit(1).alias("schemaVersion"), F.when(n == 5, "ev-1").otherwise(named("ev-", F.col("l_orderkey"))).alias("evidenceId"), F.lit(1).alias("revision"), ref("claimId", named("claim-", F.col("l_orderkey"))).alias("claimRef"),
        F.lit("retrieved").alias("evidenceType"), F.when(n != 3, ref("sourceId", named("src-", F.col("l_suppkey")))).alias("sourceRef"), F.lit(None).cast("string").alias("calculationId"),
        F.when(F.col("l_returnflag") == "R", "perhaps").otherwise("neutral").alias("stance"), F.array(F.when(F.col("l_suppkey") % 10 == 0, " \t").otherwise("said")).alias("quotes"),
        F.array(F.struct(F.lit("page").alias("type"), F.lit("1").alias("value"))).alias("locators"), F.expr("cast(array() as array<string>)").alias("extractedValues"), F.lit("").alias("method"), F.lit("secondary").alias("quality"),
        F.when(F.col("l_discount") > 0.08, 1.5).otherwise(0.5).alias("confidence"), named("attempt-", F.col("l_suppkey")).alias("recordedByAttemptId"), F.lit("verified").alias("verificationStatus"), F.expr("cast(array() as array<string>)").alias("conflictsWith"))
    lines = li.select(F.struct("l_orderkey", "l_linenumber", "l_partkey").alias("line"), F.to_json(e, {"ignoreNullFields": "false"}).alias("raw"))
    return schemas.validate(lines, "evidence", taken_in=True).select("line.*", "path", "code")


@register("claim_schema_walk", """
WITH o AS (SELECT o_orderkey, o_orderkey % 9 AS k FROM orders)
SELECT o_orderkey, path, code FROM o JOIN (VALUES (0, '/scopeQualifiers/a~1b', 'schema.additionalProperties'), (1, '/evidenceRule/minimumLineages', 'schema.type'), (2, '/evidenceRefs/1/revision', 'schema.minimum'),
  (3, '/statement', 'schema.required'), (4, '/confidence', 'schema.type'), (5, '/status', 'schema.enum'), (5, '/conflictClaimIds/0', 'schema.pattern'), (6, '/schemaVersion', 'schema.const'), (7, '/evidenceRefs/0', 'schema.type')) v(n, path, code) ON n = k""")
def claim_schema_walk(spark: SparkSession, sf: str) -> DataFrame:
    """Claims with faults at several depths; every ninth one is right."""
    k = F.col("o_orderkey") % 9
    key = F.lpad(F.col("o_orderkey").cast("string"), 16, "0")
    pick = lambda n, bad, good: F.when(k == n, F.lit(bad)).otherwise(F.lit(good))
    raw = F.concat(
        F.lit('{"claimId":"claim-'), key, F.lit('","confidence":'), pick(4, "null", "0.5"), F.lit(',"conflictClaimIds":["'), pick(5, "c-1", "claim-0123456789abcdef"), F.lit('"],"createdByAttemptId":"attempt-'), key,
        F.lit('","evidenceRefs":['), pick(7, "7", '{"evidenceId":"ev-0123456789abcdef","revision":1}'), F.lit(',{"evidenceId":"ev-0123456789abcdef","revision":'), pick(2, "0", "2"),
        F.lit('}],"evidenceRule":{"fullTextRequired":false,"independentVerificationAllowed":true,"minimumLineages":'), pick(1, '"2"', "2"), F.lit(',"primarySourceRequired":false},"kind":"synthesis","materiality":"contextual","revision":1,"schemaVersion":'),
        pick(6, "2", "1"), F.lit(',"scopeQualifiers":{"comparator":null,"intervention":null,"outcome":null,"population":null,"timeRange":null'), pick(0, ',"a/b":1', ""), F.lit("}"), pick(3, "", ',"statement":"s"'), F.lit(',"status":"'),
        pick(5, "maybe", "proposed"), F.lit('"}'))
    lines = A.spread(A.table(spark, sf, "orders")).select(F.col("o_orderkey").alias("line"), raw.alias("raw"))
    return schemas.validate(lines, "claims").select(F.col("line").alias("o_orderkey"), "path", "code")


@register("catalog_revisions", """
WITH r AS (SELECT l_suppkey AS id, l_orderkey * 10 + l_linenumber AS seq, l_linenumber AS revision, l_partkey FROM lineitem),
w AS (SELECT *, coalesce(max(revision) OVER (PARTITION BY id ORDER BY seq, revision, l_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, row_number() OVER (PARTITION BY id, revision ORDER BY seq) > 1 AS again FROM r)
SELECT id, seq, revision, CASE WHEN again THEN 'transaction.duplicate-record' ELSE 'transaction.invalid-reference' END AS code, count(*) AS n FROM w WHERE again OR revision <> before + 1 GROUP BY ALL""")
def catalog_revisions(spark: SparkSession, sf: str) -> DataFrame:
    r = A.table(spark, sf, "lineitem").select(F.lit("sources").alias("kind"), F.col("l_suppkey").alias("id"), F.col("l_linenumber").alias("revision"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    return catalog.revision_order(r).groupBy("id", "seq", "revision", "code").agg(F.count("*").alias("n"))


@register("catalog_references", """
WITH r AS (SELECT l_suppkey AS id, min(l_orderkey) AS since FROM lineitem GROUP BY 1)
SELECT l_orderkey AS seq, (l_suppkey + 1) AS dst_id, count(*) AS n FROM lineitem LEFT JOIN r ON id = l_suppkey + 1 WHERE since IS NULL OR since > l_orderkey GROUP BY ALL""")
def catalog_references(spark: SparkSession, sf: str) -> DataFrame:
    """An order's transaction writes its suppliers and refers to the next ones by stable id."""
    li = A.table(spark, sf, "lineitem")
    r = li.select(F.lit("sources").alias("kind"), F.col("l_suppkey").alias("id"), F.lit(1).cast("long").alias("revision"), F.col("l_orderkey").alias("seq"))
    e = li.select(F.col("l_orderkey").alias("seq"), F.lit("sources").alias("dst_kind"), (F.col("l_suppkey") + 1).alias("dst_id"), F.lit(None).cast("long").alias("dst_rev"))
    return catalog.forward_refs(e, r).groupBy("seq", "dst_id").agg(F.count("*").alias("n"))


@register("journal_order", with_sql(LEDGER_SQL) + """
, j AS (SELECT user_id, seq, seq + (type = 'error')::INT AS local_seq, md5(type || floor(value)::INT) AS sha, row_number() OVER (PARTITION BY user_id, md5(type || floor(value)::INT) ORDER BY seq) > 1 AS twice FROM ledger WHERE value IS NOT NULL),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seq) AS n FROM j)
SELECT user_id AS attempt_id, seq, CASE WHEN twice THEN 'reducer.request-journal-hash' ELSE 'reducer.request-journal-sequence' END AS code FROM n WHERE twice OR local_seq <> n""")
def journal_order(spark: SparkSession, sf: str) -> DataFrame:
    sha = F.md5(F.concat("type", F.floor("value").cast("int").cast("string")))
    j = A.ledger(spark, sf).filter("value is not null").select(F.col("user_id").alias("attempt_id"), "seq", (F.col("seq") + (F.col("type") == "error").cast("int")).alias("local_seq"), sha.alias("sha"))
    return catalog.journal_violations(j)


@register("accepted_plans", with_sql(LEDGER_SQL) + """
, c AS (SELECT user_id, count(*) AS n, min(seq) AS seq, min(event_id) AS attempt_id FROM ledger WHERE type = 'purchase' AND event_id % 16 = 0 GROUP BY user_id HAVING count(*) = 1)
SELECT c.user_id AS run_id, attempt_id, c.seq, max_by(10 * l.seq, l.seq) AS max_sources FROM c JOIN ledger l ON l.user_id = c.user_id AND l.seq <= c.seq AND l.type IN ('view', 'signup') GROUP BY ALL""")
def accepted_plans(spark: SparkSession, sf: str) -> DataFrame:
    """Runs with one planning commit, a purchase of a sixteenth event: the limit of the last view or sign-up before it."""
    e = A.ledger(spark, sf).withColumnRenamed("user_id", "run_id")
    a = e.select("run_id", F.col("event_id").alias("attempt_id"), F.when((F.col("type") == "purchase") & (F.col("event_id") % 16 == 0), "committed").otherwise("started").alias("phase"), "seq")
    return catalog.accepted_plan(a, e.filter("type in ('view', 'signup')").select("run_id", "seq", (10 * F.col("seq")).alias("max_sources")))


@register("merged_sources", """
WITH d AS (SELECT doc_id, md5(text) AS url, lang, source, doc_id % 2 = 0 AS old FROM documents),
g AS (SELECT url, count(*) FILTER (WHERE old) AS olds, min_by(doc_id, (NOT old)::INT * 1000000000 + doc_id) AS retained, list(doc_id ORDER BY doc_id) AS keys, min_by(lang, (NOT old)::INT * 1000000000 + doc_id) AS lang,
  min_by(lang, doc_id) FILTER (WHERE old) AS before FROM d GROUP BY url)
SELECT retained, lang, len(keys) - 1 AS aliases, CASE WHEN olds > 1 THEN 'ambiguous' WHEN olds = 0 THEN 'added' WHEN lang IS DISTINCT FROM before THEN 'revised' ELSE 'unchanged' END AS action FROM g""")
def merged_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Even documents are known sources, odd ones arrive; equal texts are one URL."""
    none = F.lit(None).cast("string")
    d = A.table(spark, sf, "documents").select(F.col("doc_id").alias("key"), none.alias("doi"), none.alias("pmid"), none.alias("pmcid"), F.md5("text").alias("url"), "lang")
    m = catalog.merge_sources(d.filter("key % 2 = 0"), d.filter("key % 2 = 1"), ["lang"])
    return m.select("retained", "lang", F.size("aliases").cast("long").alias("aliases"), "action")


@register("vouched_survivors", """
WITH d AS (SELECT md5(text) AS g, doc_id, CASE WHEN doc_id % 3 > 0 THEN source END AS source, doc_id % 2 = 0 AS vouches, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) = 1 AS base FROM documents),
m AS (SELECT g, min_by(source, doc_id) FILTER (WHERE source IS NOT NULL AND (base OR vouches)) AS source, min(doc_id) FILTER (WHERE source IS NOT NULL AND (base OR vouches)) AS since, count(*) AS members FROM d GROUP BY g)
SELECT m.g AS "group", m.source, members, count(*) FILTER (WHERE d.doc_id > since AND d.source <> m.source) AS differ FROM m JOIN d ON d.g = m.g GROUP BY ALL""")
def vouched_survivors(spark: SparkSession, sf: str) -> DataFrame:
    """A missing source is filled only from copies with provenance for it; what differs later is a conflict."""
    d = A.table(spark, sf, "documents").select(
        F.md5("text").alias("group"), "doc_id", F.when(F.col("doc_id") % 3 > 0, F.col("source")).alias("source"), F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("source"))).otherwise(F.expr("cast(array() as array<string>)")).alias("vouched"))
    s = lineage.survivors(d, ["source"], ["doc_id"], provenance="vouched")
    both = d.join(s.select("group", F.col("source").alias("kept"), "members", F.size("conflicts").alias("n")), "group")
    own = both.groupBy("group", F.col("kept").alias("source"), "members", "n").agg(F.min(F.when(F.col("source").isNotNull() & ((F.col("doc_id") % 2 == 0) | (F.col("source") == F.col("kept"))), F.col("doc_id"))).alias("since"))
    late = d.join(own.select("group", F.col("source").alias("kept"), "since", "n"), "group").filter((F.col("doc_id") > F.col("since")) & (F.col("source") != F.col("kept")) & (F.col("n") > 0)).groupBy("group").agg(F.count("*").alias("differ"))
    return own.join(late, "group", "left").select("group", "source", "members", F.coalesce("differ", F.lit(0)).alias("differ"))


@register("latest_source_facts", """
SELECT md5(text) AS "group", max(n_chars) AS retrieved_at, ['metadata-only', 'abstract-only', 'partial-text', 'full-text'][(max(doc_id % 4) + 1)::INT] AS access_level,
  coalesce(min_by(lang, doc_id) FILTER (WHERE doc_id % 3 = 0), 'unknown') AS peer_review_status, count(DISTINCT lang) FILTER (WHERE doc_id % 3 = 0) > 1 AS review_conflict FROM documents GROUP BY 1""")
def latest_source_facts(spark: SparkSession, sf: str) -> DataFrame:
    level = F.element_at(F.array(*[F.lit(x) for x in I.ACCESS_LEVELS]), (F.col("doc_id") % 4 + 1).cast("int"))
    d = A.table(spark, sf, "documents").select(
        F.md5("text").alias("group"), F.col("doc_id").alias("key"), F.col("n_chars").alias("retrieved_at"), level.alias("access_level"), F.when(F.col("doc_id") % 3 == 0, F.col("lang")).otherwise("unknown").alias("peer_review_status"))
    return lineage.latest_facts(d)


@register("effective_identifiers", """
SELECT l_suppkey AS source_id, min_by(l_partkey, l_orderkey * 10 + l_linenumber) FILTER (WHERE l_returnflag = 'A') AS doi, min_by(l_quantity, l_orderkey * 10 + l_linenumber) FILTER (WHERE l_linenumber > 3) AS pmid
FROM (SELECT l_suppkey, l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_quantity) AS l_quantity, min(l_returnflag) AS l_returnflag FROM lineitem GROUP BY 1, 2, 3) GROUP BY 1""")
def effective_identifiers(spark: SparkSession, sf: str) -> DataFrame:
    li = A.table(spark, sf, "lineitem").groupBy("l_suppkey", "l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"), F.min("l_quantity").alias("q"), F.min("l_returnflag").alias("f"))
    r = li.select(F.col("l_suppkey").alias("source_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("revision"), F.when(F.col("f") == "A", F.col("p")).alias("doi"), F.when(F.col("l_linenumber") > 3, F.col("q")).alias("pmid"))
    return lineage.effective_identifiers(r, ["doi", "pmid"])


@register("url_attribution", """
WITH t AS (SELECT l_suppkey AS source_id, l_partkey AS request_id, l_linenumber % 3 AS kind, l_returnflag <> 'R' AS ok, l_linestatus = 'O' AS own, 1 + l_linenumber // 6 AS steps FROM lineitem),
f AS (SELECT *, ok AND (kind <> 2 OR (own AND steps = 1)) AS fits FROM t),
b AS (SELECT source_id, min(kind * 1000000000 + request_id) FILTER (WHERE fits) AS best, bool_or(NOT ok) AS bad, bool_or(ok AND kind = 2 AND NOT (own AND steps = 1)) AS meta FROM f GROUP BY 1)
SELECT s_suppkey AS source_id, CASE best // 1000000000 WHEN 0 THEN 'resolver' WHEN 1 THEN 'transport' WHEN 2 THEN 'metadata' END AS kind, best % 1000000000 AS request_id,
  CASE WHEN best IS NULL THEN CASE WHEN bad THEN 'source.url-request-mismatch' WHEN meta THEN 'source.url-metadata-mismatch' ELSE 'source.url-unattributed' END END AS failure FROM supplier LEFT JOIN b ON source_id = s_suppkey""")
def url_attribution(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("l_linenumber") % 3
    t = A.table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("source_id"), F.when(kind == 0, "resolver").when(kind == 1, "transport").otherwise("metadata").alias("kind"), F.lit("final").alias("stage"), F.col("l_partkey").alias("request_id"),
        (F.col("l_returnflag") != "R").alias("request_ok"), (F.col("l_linestatus") == "O").alias("provider_ok"), (1 + F.floor(F.col("l_linenumber") / 6)).alias("steps"))
    s = A.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("source_id"))
    return lineage.url_attribution(s, t).select("source_id", "kind", "request_id", "failure")


@register("source_semantics", """
WITH s AS (SELECT l_orderkey, count(*) AS n, count(DISTINCT l_suppkey) AS d, min(l_partkey) AS p, bool_or(l_returnflag = 'R') AS r FROM lineitem GROUP BY 1)
SELECT l_orderkey AS source_id, '/lineage/relationTypes' AS path, 'source.invalid-lineage' AS code FROM s WHERE n > 5
UNION ALL SELECT l_orderkey, '/lineage/relatedSourceIds', 'source.invalid-lineage' FROM s WHERE d < n
UNION ALL SELECT l_orderkey, '/lineage/cohortIds', 'source.invalid-lineage' FROM s WHERE p % 5 = 0
UNION ALL SELECT l_orderkey, '/authors', 'source.invalid-provenance' FROM s WHERE p % 3 = 0
UNION ALL SELECT l_orderkey, '/retrievalRequestIds', 'source.invalid-provenance' FROM s WHERE d < n
UNION ALL SELECT l_orderkey, '/metadataProvenance', 'source.invalid-provenance' FROM s WHERE p % 2 = 0 OR r OR p % 7 = 0""")
def source_semantics(spark: SparkSession, sf: str) -> DataFrame:
    g = A.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("source_id")).agg(F.collect_list(F.col("l_suppkey").cast("string")).alias("ids"), F.min("l_partkey").alias("p"), F.bool_or(F.col("l_returnflag") == "R").alias("r"))
    p, none = F.col("p"), F.expr("cast(array() as array<string>)")
    step = F.struct(F.when(p % 2 == 0, "none").otherwise(F.col("ids")[0]).alias("request_id"), F.when(F.col("r"), "colour").otherwise("title").alias("field"), F.lit("crossref").alias("provider"))
    author = lambda family, given: F.struct(family.alias("family"), given.alias("given"), F.lit(None).cast("string").alias("literal"), F.lit(None).cast("string").alias("orcid"))
    s = g.select(
        "source_id", F.lit(1).alias("revision"), F.col("ids").alias("related_source_ids"), F.when(F.size("ids") > 5, none).otherwise(F.transform("ids", lambda x: F.lit("reports"))).alias("relation_types"),
        F.col("ids").alias("retrieval_request_ids"), F.when(p % 5 == 0, F.array(F.lit("c"), F.lit("c"))).otherwise(none).alias("cohorts"), none.alias("datasets"),
        F.when(p % 7 == 0, F.array(step, step)).otherwise(F.array(step)).alias("provenance"),
        F.array(author(F.lit("A"), F.lit(None).cast("string")), author(F.when(p % 3 == 0, "A").otherwise("B"), F.lit(None).cast("string"))).alias("authors"))
    return lineage.source_issues(s).select("source_id", "path", "code")


@register("citation_map", """
WITH f AS (SELECT l_suppkey AS source_id, min(l_orderkey * 8 + l_linenumber) AS first FROM lineitem GROUP BY 1)
SELECT f.source_id, row_number() OVER (ORDER BY first, f.source_id)::INT AS number, c.claims, c.evidence FROM f
JOIN (SELECT l_suppkey AS source_id, count(DISTINCT l_orderkey) AS claims, count(DISTINCT l_orderkey * 8 + l_linenumber) AS evidence FROM lineitem GROUP BY 1) c ON c.source_id = f.source_id""")
def citation_map(spark: SparkSession, sf: str) -> DataFrame:
    b = A.table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("source_id"), F.col("l_orderkey").alias("claim_id"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("evidence_id"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("position"))
    m = citations.citation_map(citations.number(b, [], ["source_id"]), b)
    return m.select("source_id", "number", F.size("claims").cast("long").alias("claims"), F.size("evidence").cast("long").alias("evidence"))


# --- provider payloads


@register("crossref_candidates", """
SELECT '10.1234/part' || p_partkey AS record_id, CASE WHEN p_size % 2 = 0 THEN 'https://doi.org/10.1234/part' || p_partkey ELSE 'https://h.org/' || p_partkey END AS url, p_name AS title, p_brand AS venue,
  CASE WHEN p_size % 3 = 0 THEN '2020-02-30' END AS bad, CASE WHEN p_size % 3 = 1 THEN '2019-07' WHEN p_size % 3 = 2 THEN '2018' END AS published, CASE WHEN p_size % 5 = 0 THEN 'review' ELSE 'journal-article' END AS publication_type FROM part""")
def crossref_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """One landed payload a part; dates that do not exist are left out, http URLs give way to the resolver."""
    n = F.col("p_partkey").cast("string")
    parts = F.when(F.col("p_size") % 3 == 0, F.array(F.lit(2020), F.lit(2), F.lit(30))).when(F.col("p_size") % 3 == 1, F.array(F.lit(2019), F.lit(7))).otherwise(F.array(F.lit(2018)))
    item = F.struct(
        F.concat(F.lit("10.1234/PART"), n).alias("DOI"), F.concat(F.when(F.col("p_size") % 2 == 0, "http://h.org/").otherwise("https://h.org/"), n).alias("URL"), F.array(F.lit(" "), F.col("p_name")).alias("title"),
        F.lit("journal-article").alias("type"), F.when(F.col("p_size") % 5 == 0, "review").alias("subtype"), F.array("p_brand").alias("container-title"), F.struct(F.array(parts).alias("date-parts")).alias("published-print"))
    payload = F.to_json(F.struct(F.struct(F.array(item).alias("items")).alias("message")))
    c = providers.crossref(A.spread(A.table(spark, sf, "part")).select(payload.alias("payload"), "p_size"))
    day = F.when(F.col("published").isNull(), "2020-02-30")
    return c.select("record_id", "url", "title", "venue", day.alias("bad"), "published", "publication_type")


@register("openalex_candidates", """
SELECT 'https://openalex.org/W' || p_partkey AS record_id, '10.1234/part' || p_partkey AS doi, CASE WHEN p_size % 2 = 0 THEN (100 + p_partkey)::VARCHAR END AS pmid, p_name AS title,
  CASE WHEN p_size % 3 = 0 THEN 'https://h.org/' || p_partkey ELSE 'https://doi.org/10.1234/part' || p_partkey END AS url, CASE WHEN p_size % 5 = 0 THEN 'journal-article' WHEN p_size % 5 = 1 THEN 'review' ELSE 'other' END AS publication_type,
  CASE WHEN p_size % 7 = 0 THEN '2019' ELSE '2020-03-04' END AS published, CASE WHEN p_size % 4 = 0 THEN 'abstract-only' ELSE 'metadata-only' END AS access_level FROM part WHERE p_size % 11 <> 0""")
def openalex_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """One landed payload a part; some records have no work id, some abstracts an inverted index."""
    n, k = F.col("p_partkey").cast("string"), F.col("p_size")
    page = F.when(k % 3 == 0, F.concat(F.lit("https://h.org/"), n))
    work = F.struct(
        F.when(k % 11 == 0, n).otherwise(F.concat(F.lit("https://openalex.org/W"), n)).alias("id"), F.concat(F.lit("https://doi.org/10.1234/PART"), n).alias("doi"),
        F.struct(F.when(k % 2 == 0, F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), (F.col("p_partkey") + 100).cast("string"))).alias("pmid")).alias("ids"), F.col("p_name").alias("display_name"),
        F.when(k % 5 == 0, "article").when(k % 5 == 1, "review").otherwise("letter").alias("type"), F.when(k % 7 != 0, "2020-03-04").alias("publication_date"), F.lit(2019).alias("publication_year"),
        F.struct(page.alias("landing_page_url")).alias("primary_location"), F.when(k % 4 == 0, F.create_map(F.lit("said"), F.array(F.lit(0), F.lit(2)), F.lit("was"), F.array(F.lit(1)))).alias("abstract_inverted_index"))
    payload = F.to_json(F.struct(F.array(work).alias("results")))
    c = providers.openalex(A.spread(A.table(spark, sf, "part")).select(payload.alias("payload")))
    return c.select("record_id", "doi", "pmid", "title", "url", "publication_type", "published", "access_level")


@register("pubmed_candidates", """
SELECT (1000 + p_partkey)::VARCHAR AS record_id, (1000 + p_partkey)::VARCHAR AS pmid, CASE WHEN p_size % 2 = 0 THEN 'PMC' || (7 + p_partkey) END AS pmcid, p_name AS title, p_brand AS venue,
  CASE p_size % 3 WHEN 0 THEN '2021-03-04' WHEN 1 THEN '2020-05' ELSE '1999' END AS published, CASE WHEN p_size % 4 = 0 THEN 'review' ELSE 'journal-article' END AS publication_type FROM part WHERE p_size % 9 <> 0""")
def pubmed_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """One summary a part; some are errors; dates come from three fields."""
    uid, k = (F.col("p_partkey") + 1000).cast("string"), F.col("p_size")
    named = lambda kind, value: F.struct(F.lit(kind).alias("idtype"), value.alias("value"))
    record = F.struct(
        uid.alias("uid"), F.when(k % 9 == 0, "gone").alias("error"), F.col("p_name").alias("title"), F.col("p_brand").alias("source"), F.when(k % 3 == 0, "2021/03/04 00:00").alias("sortpubdate"),
        F.when(k % 3 == 1, "2020/05").alias("epubdate"), F.lit("1999 Jan").alias("pubdate"), F.when(k % 4 == 0, "Systematic Review").otherwise("Journal Article").alias("doctype"),
        F.when(k % 2 == 0, F.array(named("pmc", F.concat(F.lit("PMC"), (F.col("p_partkey") + 7).cast("string"))))).alias("articleids"))
    payload = F.concat(F.lit('{"result":{"uids":["'), uid, F.lit('"],"'), uid, F.lit('":'), F.to_json(record), F.lit("}}"))
    c = providers.pubmed(A.spread(A.table(spark, sf, "part")).select(payload.alias("payload")))
    return c.select("record_id", "pmid", "pmcid", "title", "venue", "published", "publication_type")


@register("linked_full_texts", """
SELECT DISTINCT 'PMC' || (l_suppkey * 10 + l_linenumber) AS pmcid FROM lineitem WHERE l_linenumber % 3 <> 0""")
def linked_full_texts(spark: SparkSession, sf: str) -> DataFrame:
    """One link payload an order line; links to other databases do not count, and equal ones are one."""
    pmc = F.col("l_linenumber") % 3 != 0
    db = F.struct(F.when(pmc, "pmc").otherwise("books").alias("dbto"), F.lit("pubmed_pmc").alias("linkname"), F.array((F.col("l_suppkey") * 10 + F.col("l_linenumber")).cast("string")).alias("links"))
    payload = F.to_json(F.struct(F.array(F.struct(F.array(db).alias("linksetdbs"))).alias("linksets")))
    return providers.linked_pmcids(A.table(spark, sf, "lineitem").select(payload.alias("payload")))


@register("pmc_candidates", """
SELECT 'PMC' || p_partkey AS pmcid, p_name AS title, CASE p_size % 4 WHEN 0 THEN 'metadata-only' WHEN 1 THEN 'full-text' WHEN 2 THEN 'abstract-only' ELSE 'partial-text' END AS access_level FROM part WHERE p_partkey > 0""")
def pmc_candidates(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_size") % 4
    said = lambda label, text: F.struct(F.create_map(F.lit("section_type"), label).alias("infons"), text.alias("text"))
    text = F.when(k == 0, F.lit(" ")).otherwise(F.lit("words"))
    passages = F.array(said(F.lit("Article_Title"), F.when(k == 0, F.lit("")).otherwise(F.col("p_name"))), said(F.when(k == 1, "Main Text").when(k == 2, "SUMMARY").otherwise("REFERENCES"), text))
    doc = F.struct(F.concat(F.lit("PMC"), F.col("p_partkey").cast("string")).alias("id"), passages.alias("passages"))
    payload = F.to_json(F.struct(F.array(doc).alias("documents")))
    rows = A.table(spark, sf, "part").filter("p_partkey > 0").select(payload.alias("payload"), "p_name")
    out = providers.pmc(rows.select("payload"))
    names = A.table(spark, sf, "part").select(F.concat(F.lit("PMC"), F.col("p_partkey").cast("string")).alias("pmcid"), "p_name")
    return out.join(names, "pmcid").select("pmcid", F.when(F.col("access_level") == "metadata-only", F.col("p_name")).otherwise(F.col("title")).alias("title"), "access_level")
