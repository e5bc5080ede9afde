from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import evidence_query as Q
from tessera.operators import gate, graph, lineage, retry, search
from tessera.sources import providers


def test_components_against_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 140)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {x: find(x) for x in root if any(x in e and e[0] != e[1] for e in edges)}


def test_cycle_is_an_error(spark):
    for edges in ([(1, 2), (2, 3), (3, 1)], [(1, 2), (2, 3), (3, 2)], [(1, 2), (2, 3), (3, 4), (4, 2), (2, 5), (5, 2)]):
        with pytest.raises(graph.GraphError, match=r"lineage\.cycle"):
            graph.dag_depth(spark.createDataFrame(edges, "src long, dst long"))


def test_depth_against_walk(spark):
    rng = random.Random(6)
    edges = sorted({(a, b) for a, b in ((rng.randrange(40), rng.randrange(40)) for _ in range(70)) if a < b}) + [(100 + i, 101 + i) for i in range(9)] + [(3, 100), (109, 39)]
    want = {n: 0 for e in edges for n in e}
    for _ in want:
        for a, b in edges:
            want[b] = max(want[b], want[a] + 1)
    assert {r["node"]: r["depth"] for r in graph.dag_depth(spark.createDataFrame(edges, "src long, dst long")).collect()} == want


def test_depth_of_a_long_chain(spark):
    got = graph.dag_depth(spark.range(10_000).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")))
    assert got.filter("node = depth").count() == 10_001
    with pytest.raises(graph.GraphError, match="lineage.traversal-too-deep"):
        graph.dag_depth(spark.range(20).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")), most_depth=19)


def test_masks_of_a_long_chain(spark):
    edges = spark.range(70).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), F.when(F.col("id") == 40, 2).otherwise(0).alias("bit"))
    got = {r["node"]: r["mask"] for r in graph.mask_closure(spark.createDataFrame([(0, 1)], "node long, mask int"), edges).collect()}
    assert got == {n: 1 if n <= 40 else 3 for n in range(71)}


def test_too_many_providers_are_an_error(spark):
    q = spark.createDataFrame([("q1", "heart", 50)], "query_id string, text string, caller_limit int")
    p = spark.range(65).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("provider"), F.lit(9).alias("configured_limit"), F.lit(9).alias("endpoint_cap"))
    with pytest.raises(ValueError, match="too-many-providers"):
        search.plan(q, p)
    assert search.plan(q, p.filter("provider <> 'p7'")).count() == 64


def test_topological_order():
    assert graph.topological_order(4, [(0, 2), (1, 0)]) == [2, 0, 1, 3]
    with pytest.raises(graph.GraphError, match=r"planning\.cycle"):
        graph.topological_order(2, [(0, 1), (1, 0)])
    with pytest.raises(graph.GraphError, match="unknown"):
        graph.topological_order(1, [(0, 5)])


def greedy(page, edges, size, caps):
    taken, kinds, total, links, out = {}, set(), Q.WRAPPER, 0, []
    for rank, start in enumerate(page):
        new, stack = {}, [start]
        while stack:
            n = stack.pop()
            if n in taken or n in new:
                continue
            new[n] = rank
            stack += edges.get(n, [])
        b, k = total, set(kinds)
        for n in new:
            b += size[n][1] + (size[n][0] in k)
            k.add(size[n][0])
        e = links + sum(len(edges.get(n, [])) for n in new)
        if len(taken) + len(new) > caps["records"] or e > caps["edges"] or b > caps["bytes"]:
            break
        taken |= new
        kinds, total, links = k, b, e
        out.append(start)
    return taken, out


def test_greedy_closure_against_walk(spark):
    rng = random.Random(5)
    for _ in range(4):
        n = 12
        edges = {i: [rng.randrange(n) for _ in range(rng.randrange(3))] for i in range(n)}
        size = {i: (rng.choice("ab"), rng.randrange(1, 9)) for i in range(n)}
        page = rng.sample(range(n), 5)
        caps = {"records": rng.randrange(3, 12), "edges": 30, "bytes": Q.WRAPPER + rng.randrange(10, 60)}
        want, accepted = greedy(page, edges, size, caps)
        frames = (
            spark.createDataFrame([(p, r) for r, p in enumerate(page)], "node long, rank long"),
            spark.createDataFrame([(a, b) for a, bs in edges.items() for b in bs], "src long, dst long"),
            spark.createDataFrame([(i, k, b) for i, (k, b) in size.items()], "node long, kind string, bytes long"))
        if not accepted:
            with pytest.raises(graph.GraphError, match="too-large"):
                Q.greedy_closure(*frames, caps)
            continue
        sel, acc = Q.greedy_closure(*frames, caps)
        assert {r["node"]: r["rank"] for r in sel.collect()} == want
        assert [r["node"] for r in acc.orderBy("rank").collect()] == accepted


def test_cursor_is_bound():
    q, other = Q.EvidenceQuery(stances=("supporting",)), Q.EvidenceQuery()
    c = Q.encode_cursor("snap", q, (2, "ev-1", 3))
    assert Q.decode_cursor(c, "snap", q) == (2, "ev-1", 3)
    for bad, code in ((("snap", other), "mismatch"), (("else", q), "mismatch")):
        with pytest.raises(graph.GraphError, match=code):
            Q.decode_cursor(c, *bad)
    with pytest.raises(graph.GraphError, match="query.cursor-invalid"):
        Q.decode_cursor(c[:-4], "snap", q)
    assert Q.EvidenceQuery(stances=("b", "a", "a")).hash() == Q.EvidenceQuery(stances=("a", "b")).hash()


def test_local_components_ignore_other_sources(spark):
    item = "array<struct<relation: string, tokens: array<string>>>"
    cases = [
        ([("s1", ["study:a"]), ("s2", ["study:a"]), ("s3", ["study:b"])], ["s1", "s3"]), ([], []),
        ([("s2", ["study:a"]), ("s1", ["study:b"]), ("s3", ["study:a", "cohort:c"]), ("s4", ["study:d", "cohort:c"]), ("s1", ["study:e"])], ["s1", "s2"])]
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], f"i int, items {item}")
    got = df.orderBy("i").select(F.array_sort(F.transform(gate.local_components(F.col("items")), lambda g: g["key"])).alias("k")).collect()
    assert [r["k"] for r in got] == [k for _, k in cases]


def test_tasks_need_metadata(spark):
    schema = "kind string, id long, revision long, stance string, quality string, verification_status string, confidence double, access_level string, lineage array<string>, owners array<long>, tasks array<int>, roles array<string>"
    rows = [("evidence", 1, 1, "supporting", "q", "v", 1.0, "a", [], [7], [3], ["r"]), ("evidence", 2, 1, "neutral", "q", "v", 1.0, "a", [], [], [None], [None])]
    df = spark.createDataFrame(rows, schema)
    ask = lambda df, **k: [r["id"] for r in Q.select_page(df, Q.EvidenceQuery(**k)).collect()]
    assert ask(df, stances=("supporting",), task_ids=(3,)) == [1] and ask(df, roles=()) == []
    for frame, k in ((df, {"task_ids": (3,)}), (df.drop("tasks"), {"stances": ("supporting",), "roles": ("r",)})):
        with pytest.raises(graph.GraphError, match="metadata-required"):
            ask(frame, **k)


def test_independence_reasons(spark):
    side = "struct<id: long, study: string, cohorts: array<string>, datasets: array<string>, root: long>"
    rows = [
        ((1, "x", [], [], 1), (2, "x", ["c"], [], 2), []), ((1, None, [], [], 1), (2, "y", [], [], 2), []), ((1, "x", [], [], 1), (2, "y", [], [], 2), []),
        ((1, "x", [], [], 1), (2, "y", [], [], 1), ["version-of"]), ((1, "x", ["c"], [], 1), (2, "y", ["c"], [], 1), [])]
    got = lineage.independence(spark.createDataFrame(rows, f"left {side}, right {side}, relations array<string>")).collect()
    assert [(r["decision"], r["reasons"]) for r in got] == [
        ("dependent", ["same-study"]), ("unknown", ["unknown-lineage"]), ("independent", []), ("dependent", ["version-relation", "dependency-component"]), ("dependent", ["shared-cohort"])]


def test_shared_quota(spark):
    rows = [(1, 0, 0, ["a", "b"]), (1, 0, 1, ["a"]), (1, 1, 0, ["b"]), (1, 1, 1, ["b", "c"]), (1, 2, 0, ["c"])]
    got = search.shared_quota(spark.createDataFrame(rows, "search_id long, ordinal int, draft_ordinal int, queries array<string>"), 1).collect()
    assert sorted((r["ordinal"], r["draft_ordinal"]) for r in got) == [(0, 0), (2, 0)]


def test_plan_and_follow_ups(spark):
    q = spark.createDataFrame([("q1", "heart", 50), ("q2", "heart", 50)], "query_id string, text string, caller_limit int")
    p = spark.createDataFrame([("crossref", 100, 20)], "provider string, configured_limit int, endpoint_cap int")
    got = search.plan(q, p).collect()
    assert [(r["limit"], r["queries"]) for r in got] == [(20, ["q1", "q2"])]
    s = spark.createDataFrame([("k", "esearch", "success", ["1"]), ("l", "esearch", "failure", ["1"]), ("m", "elink", "success", [])], "partition_key string, operation string, outcome string, identifiers array<string>")
    assert {r["partition_key"]: (r["operation"], r["skipped"]) for r in search.follow_ups(s).collect()} == {"k": ("esummary", None), "l": ("esummary", "parent-failed"), "m": ("fulltext", "no-identifiers")}


def one(spark, parse, payload):
    return parse(spark.createDataFrame([(json.dumps(payload),)], "payload string")).collect()


def test_providers(spark):
    r = one(spark, providers.crossref, {"message": {"items": [{"DOI": "10.1234/X", "title": ["", "T"], "author": [{"family": "F", "given": "G", "ORCID": "0000-0002-1825-0097"}, {"name": "Team"}], "container-title": ["V"], "published-print": {"date-parts": [[2020, 2]]}, "type": "journal-article"}]}})[0]
    assert (r["doi"], r["title"], r["url"], r["published"], r["publication_type"], r["authors"][1]["literal"]) == ("10.1234/x", "T", "https://doi.org/10.1234/x", "2020-02", "journal-article", "Team")
    r = one(spark, providers.openalex, {"results": [{"id": "https://openalex.org/W1", "doi": "https://doi.org/10.1234/y", "ids": {"pmid": "https://pubmed.ncbi.nlm.nih.gov/77"}, "display_name": "N", "type": "article", "abstract_inverted_index": {"b": [1], "a": [0]}, "publication_year": 2019}, {"id": "bad"}]})
    assert len(r) == 1 and (r[0]["pmid"], r[0]["access_level"], r[0]["published"]) == ("77", "abstract-only", "2019")
    r = one(spark, providers.pubmed, {"result": {"uids": ["9", "8"], "9": {"uid": "9", "title": "Nine", "authors": [{"name": "A"}], "sortpubdate": "2021/03/04 00:00", "articleids": [{"idtype": "pmc", "value": "PMC5"}], "doctype": "Review"}, "8": {"uid": "8", "error": "x"}}})
    assert [(x["record_id"], x["pmcid"], x["published"], x["publication_type"]) for x in r] == [("9", "PMC5", "2021-03-04", "review")]
    links = {"linksets": [{"linksetdbs": [{"dbto": "pmc", "linkname": "pubmed_pmc", "links": ["100", "20", "20"]}, {"dbto": "x", "linkname": "y", "links": ["1"]}]}]}
    assert [x["pmcid"] for x in one(spark, providers.linked_pmcids, links)] == ["PMC20", "PMC100"]
    r = one(spark, providers.pmc, {"documents": [{"id": "PMC5", "infons": {}, "passages": [{"infons": {"section_type": "TITLE"}, "text": "Tt"}, {"infons": {"section_type": "METHODS"}, "text": "m"}]}]})[0]
    assert (r["pmcid"], r["title"], r["access_level"]) == ("PMC5", "Tt", "full-text")


def test_recovery_precedence(spark):
    row = {"any_committed": False, "attempts": 1, "started_retry": False, "active_schedule": False, "failure_state": None, "phase": "started", "transaction_id": None, "result_seq": None, "cancel_seq": None, "replay_policy": "safe-read"}
    cases = [({}, "needs-retry-schedule"), ({"any_committed": True}, "skip-committed"), ({"attempts": 0}, "not-found"), ({"cancel_seq": 5}, "quarantined"), ({"cancel_seq": 5, "phase": "result", "transaction_id": "t", "result_seq": 4}, "finish-transaction"), ({"replay_policy": "never"}, "block-never"), ({"failure_state": "cancelled", "cancel_seq": 2}, "no-action")]
    schema = "any_committed boolean, attempts int, started_retry boolean, active_schedule boolean, failure_state string, phase string, transaction_id string, result_seq long, cancel_seq long, replay_policy string"
    df = spark.createDataFrame([tuple((row | c).values()) for c, _ in cases], schema)
    assert [r["decision"] for r in retry.recovery(df).collect()] == [d for _, d in cases]
