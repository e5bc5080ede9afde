"""Work that grows with the input, no faster: one test a finding."""

from __future__ import annotations

import random

from tessera import registry, schemas
from tessera.functions import identifiers
from tessera.operators import catalog, evidence_query, gate, graph, ledger_fold, requests
from tessera.plans import adapters, queries
from tessera.plans.cut import cut, stored


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_shared_results_are_told_once(spark, small):
    rng = random.Random(5)
    sets = {k: sorted({rng.randrange(30) for _ in range(12)}) for k in range(3)}
    asked = {i: sorted({rng.randrange(50) for _ in range(20)}) for i in range(30)}
    sources = spark.createDataFrame([(i, ("http:" if i % 2 else "https:") + "//h/", got, "p") for i, got in asked.items()], "source_id long, url string, retrieval_request_ids array<long>, policy_sha256 string")
    rows = [(r, ("success", "partial", "terminal-error", None)[r % 4], ("p", "q", None)[r % 3], r % 4) for r in range(40)]
    kinds = "request_id long, status string, access_policy_sha256 string, result_set long"
    named = spark.createDataFrame([(k, i) for k, ids in sets.items() for i in [*ids, *ids[:2]]], "result_set long, source_id long")
    shared = requests.provenance_links(sources, spark.createDataFrame(rows, kinds), named)
    own = [(r, s, p, sets.get(k)) for r, s, p, k in rows]
    listed = requests.provenance_links(sources, spark.createDataFrame(own, "request_id long, status string, access_policy_sha256 string, result_source_ids array<long>"))
    told = {r: (s, p, k) for r, s, p, k in rows}
    want = set()
    for i, got in asked.items():
        for r in got:
            s, p, k = told.get(r, (None, None, None))
            want.add((i, r, s in ("success", "partial") and i in sets.get(k, []) and (i % 2 == 0 or p == "p")))
    assert {tuple(x) for x in shared.collect()} == {tuple(x) for x in listed.collect()} == want
    # no request carries the list of its results
    assert "result_source_ids" not in plan_of(registry.queries()["request_provenance"](spark, small))


def test_lines_are_numbered_once(spark, small):
    plan = registry.queries()["gate_admission"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    # the windows that number lines read the plain lines only, and calculations meet evidence without their files
    windows = [x for x in plan.split("\n") if "Window [row_number()" in x and "l_orderkey" in x]
    assert windows and all("l_shipdate" in x for x in windows)
    joins = [x for x in plan.split("\n") if "Join LeftOuter" in x and "calculation_id" in x]
    assert len(joins) == 1


def test_admission_shuffles_what_it_needs(spark, small, monkeypatch):
    kept, real = [], gate.stored
    monkeypatch.setattr(gate, "stored", lambda df: kept.append(df) or real(df))
    out = registry.queries()["gate_admission"](spark, small)
    plan = out._jdf.queryExecution().executedPlan().toString()
    # lines are dealt by claim: once for all that is gathered of claims, and for evidence without, with and for calculations
    dealt = [x for x in plan.split("\n") if "Exchange hashpartitioning(l_orderkey" in x]
    assert len(dealt) == 3 and not any("l_linenumber" in x for x in dealt)
    # only accepted verifications carry their lists through the choice of the latest
    assert "CASE WHEN" in plan_of(kept[0]) and kept[0].filter("verification_id is null").count() == 0


def test_latest_verification_hides_earlier_ones(spark):
    v = spark.createDataFrame(
        [("v", 1, [(7, 1)], "accepted"), ("v", 2, [(7, 1)], "inconclusive"), ("w", 1, [(7, 1)], "inconclusive"), ("w", 2, [(7, 1)], "accepted")],
        "verification_id string, revision int, checked_claims array<struct<id: bigint, revision: bigint>>, result string")
    ref = "array<struct<id: bigint, revision: bigint>>"
    v = v.selectExpr("*", f"cast(array(struct(1, 1)) as {ref}) as checked_evidence", "'mixed' as method", "3L as attempt_id", "array(1L) as independent_evidence_ids", "array(struct(7L as claim_id, verification_id as description)) as corrections")
    claims = spark.sql(f"""select 7L claim_id, 1L revision, 'supported' status, 'interpretation' kind, 0L minimum, true independent_allowed, false primary_required, false full_text_required,
        -1L created_by, cast(array(struct(1, 1)) as {ref}) evidence_refs""")
    text = "array<string>"
    evidence = spark.sql(f"""select id evidence_id, 1L revision, 7L claim_id, 1L claim_revision, kind evidence_type, source source_id, 1L source_revision, calc calculation_id, 'supporting' stance, 'verified' verification_status,
        'secondary' quality, cast(array('said') as {text}) quotes, array(struct('page' as type, '1' as value)) locators, array(struct('v' as value, 'c' as context, 'kg' as unit, 1.0D as numeric_value)) extracted_values,
        cast(null as string) method, 5L recorded_by from values (1L, 'retrieved', 1L, cast(null as string)), (2L, 'derived', null, 'c1'), (3L, 'derived', null, 'c2'), (4L, 'derived', null, null) t(id, kind, source, calc)""")
    file = lambda name: f"array(struct('{name}' as relative_path, repeat('0', 64) as sha256, 1L as decoded_bytes))"
    calcs = spark.sql(f"select 'c1' calculation_id, 5L attempt_id, 'success' status, 0 exit_code, {file('in')} inputs, {file('src')} source_files, {file('out')} outputs")
    sources = spark.sql(f"select 1L source_id, 1L revision, 'full-text' access_level, 'study:1' study, cast(array() as {text}) cohorts, cast(array() as {text}) datasets, 100 relation")
    rows = gate.qualify(evidence, sources, calcs)
    joins = [x for x in plan_of(rows).split("\n") if "Join" in x and "calculation_id" in x]
    assert len(joins) == 1 and "pmod" not in plan_of(rows)  # evidence without a calculation meets none
    assert {r["evidence_id"]: (r["qualified"], r["derived_key"]) for r in rows.collect()} == {
        1: (True, None), 2: (True, "derived-calculation:c1"), 3: (False, "derived-method:3"), 4: (False, "derived-method:4")}
    none = spark.createDataFrame([], "claim_id long, evidence_id long, revision long, rejected boolean")
    settled = lambda some: gate.evaluate(claims, rows, some, none).first()["conflict_resolved"]
    assert settled(v) and not settled(v.filter("verification_id = 'v'"))


def test_wide_log_rows_are_stored_by_column(spark):
    lines = [("r", i + 1, "budget_amended", "{}") if i else ("r", 1, "run_created", '{"run": {"runId": "r", "executionEpoch": 0, "state": "created"}}') for i in range(50)]
    told, _ = ledger_fold.judged(spark.createDataFrame(lines, ledger_fold.EVENT))
    assert all(x.endswith(".parquet") for x in told.inputFiles()) and told.inputFiles()
    assert [r["code"] for r in told.collect()] == [None] * 50
    odd = spark.sql("select * from values (named_struct('a', null, 'b', array('x', null))), (null), (named_struct('a', named_struct('c', cast(null as int)), 'b', null)) t(p)")
    assert stored(odd).schema == odd.schema and sorted(map(str, stored(odd).collect())) == sorted(map(str, odd.collect()))


def test_log_rows_stay_narrow(spark, monkeypatch):
    def leaves(kind):
        inner = [x.dataType for x in kind.fields] if hasattr(kind, "fields") else [kind.elementType] if hasattr(kind, "elementType") else []
        return sum(map(leaves, inner)) if inner else 1

    kept, real = [], ledger_fold.stored
    monkeypatch.setattr(ledger_fold, "stored", lambda df: kept.append(df) or real(df))
    lines = [("r", 1, "run_created", '{"run": {"runId": "r", "executionEpoch": 0, "state": "created"}}'), ("r", 2, "identity_reserved", '{"kind": "x", "id": "1"}'), ("r", 3, "identity_reserved", '{"kind": "x", "id": "1"}')]
    got = ledger_fold.fold(spark.createDataFrame([*lines, (None, 1, "lock_recovered", "{}")], ledger_fold.EVENT)).collect()
    assert sorted((r["run_id"] or "", r["seq"], r["error"], r["error_seq"]) for r in got) == [("", 1, None, None), ("r", 2, "reducer.duplicate-reservation", 3)]
    assert max(leaves(df.schema) for df in kept) <= 60
    # events are told their look-ups, attempts and phases in one place: one shuffle of theirs for two joins
    plan = kept[-1]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") - plan.count("Join") <= 1
    pairs = [(None, None), (None, "-"), ("-", None), ("", ""), ("1:a", "b"), ("a", "b"), ("a", ":b"), ("1", "1:"), (None, "")]
    kept = spark.createDataFrame(pairs, "a string, b string").select(ledger_fold._pair(adapters.F.col("a"), adapters.F.col("b")))
    assert len({r[0] for r in kept.collect()} - {None}) == len(pairs)


def test_a_cut_leaves_no_shuffle_files(spark):
    files = lambda: spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ").count("/shuffle_")
    before = files()
    made = spark.range(1000).selectExpr("id % 7 as k").repartition(3).groupBy("k").count()
    got = cut(made)
    assert files() <= before and sorted(r["count"] for r in got.collect()) == [142] + [143] * 6


def test_a_line_is_judged_once(spark, small, monkeypatch):
    plans, real = [], schemas.cut
    monkeypatch.setattr(schemas, "cut", lambda df: plans.append(plan_of(df)) or real(df))
    registry.queries()["evidence_schema_issues"](spark, small)
    filters = [x for x in plans[0].split("\n") if x.lstrip(" +-:").startswith("Filter")]
    assert filters and not any("schema.too-large" in x or "schema.pattern" in x or "octet_length" in x for x in filters)


def test_closure_reads_latest_evidence_once(spark, small):
    _, edges = queries._closure_input(spark, small)
    assert plan_of(edges).count("Window [row_number()") == 2
    chain = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(9)] + [("n9", "n0")], "src string, dst string")
    seeds = spark.createDataFrame([("n5", 2), ("n8", 1), ("n8", 3)], "node string, rank long")
    got = {r["node"]: r["rank"] for r in graph.first_reach(seeds, chain).collect()}
    assert got == {f"n{i}": 1 for i in range(10)}


def test_closure_looks_up_what_it_reaches(spark):
    page = spark.createDataFrame([("a", 0), ("b", 1)], "node string, rank long")
    edges = spark.createDataFrame([("a", "x"), ("a", "x"), ("x", "y"), ("b", "y"), ("far", "z")], "src string, dst string")
    asked = []

    def nodes(reach):
        asked.extend(r["node"] for r in reach.collect())
        return reach.selectExpr("node", "'k' as kind", "1 as bytes")

    told, _ = evidence_query.greedy_closure(page, edges, nodes)
    assert sorted(asked) == ["a", "b", "x", "y"]
    assert sorted((r["node"], r["rank"], r["fan"]) for r in told.collect()) == [("a", 0, 2), ("b", 1, 1), ("x", 0, 1), ("y", 0, 0)]


def test_references_are_met_once(spark, small):
    plan = registry.queries()["direct_refs"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Join" not in plan
    physical = adapters.latest_evidence(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert physical.count("Exchange hashpartitioning") == 1


def test_tasks_of_revision_order_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(catalog, "TASK_ROWS", 10)
    rows = [("sources", i % 20, i // 20 % 3 + 1, i) for i in range(200)]
    got = catalog.revision_order(spark.createDataFrame(rows, "kind string, id long, revision long, seq long"))
    assert got.rdd.getNumPartitions() >= 21
    assert sorted((r["id"], r["seq"], r["code"]) for r in got.collect()) == [(i % 20, i, "transaction.duplicate-record") for i in sorted(range(60, 200), key=lambda i: (i % 20, i))]


def test_orcid_places_are_plain_expressions(spark, small):
    plan = plan_of(registry.queries()["orcid_check"](spark, small))
    assert "lambda" not in plan and "Repartition" in plan
    odd = spark.sql("select * from values ('0000-0002-1825-0097'), ('https://orcid.org/0000-0002-1694-233X'), ('0000-0002-1825-0098'), ('0000-0002-1825-009é'), ('0000'), (''), (null) t(x)")
    got = [r[0] for r in odd.select(identifiers.orcid(odd["x"])).collect()]
    assert got == ["https://orcid.org/0000-0002-1825-0097", "https://orcid.org/0000-0002-1694-233X", None, None, None, None, None]


def test_payloads_are_dealt_to_all_cores(spark, small):
    plan = plan_of(registry.queries()["openalex_candidates"](spark, small))
    assert "Repartition" in plan
    assert plan.count("dx\\.doi\\.org") <= 2  # a DOI is normalised once, not for each column that shows it
