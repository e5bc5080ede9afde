from __future__ import annotations

import json
import random
import re

import pytest

from tessera import schemas
from tessera.operators import catalog

GOOD = {
    "schemaVersion": 1, "evidenceId": "ev-" + "1" * 16, "revision": 1, "claimRef": {"claimId": "claim-" + "1" * 16, "revision": 1}, "evidenceType": "retrieved",
    "sourceRef": {"sourceId": "src-" + "1" * 8, "revision": 1}, "calculationId": None, "stance": "supporting", "quotes": ["q"], "locators": [{"type": "page", "value": "1"}],
    "extractedValues": [], "method": "", "quality": "secondary", "confidence": 0.5, "recordedByAttemptId": "attempt-" + "1" * 16, "verificationStatus": "verified", "conflictsWith": []}


def told(spark, rows, kind, **options):
    got = {}
    for r in schemas.validate(spark.createDataFrame(rows, "line long, raw string"), kind, **options).collect():
        got.setdefault(r["line"], set()).add((r["path"], r["code"]))
    return got


def test_evidence_issues(spark):
    taken = "evidence.invalid-prospective-record"
    cases = [
        (GOOD, set()), (GOOD | {"extra": 1}, {("/extra", "schema.additionalProperties")}), ({k: v for k, v in GOOD.items() if k != "stance"}, {("/stance", "schema.required")}),
        (GOOD | {"confidence": 1.5, "stance": "maybe"}, {("/confidence", "schema.maximum"), ("/stance", "schema.enum")}),
        (GOOD | {"sourceRef": None}, {("/sourceRef", "evidence.retrieved-requirements")}), (GOOD | {"evidenceId": "x"}, {("/evidenceId", "schema.pattern")}),
        (GOOD | {"sourceRef": {"sourceId": "x", "revision": 0}}, {("/sourceRef", "schema.type")}), (GOOD | {"sourceRef": {"sourceId": "x", "revision": 1}}, {("/sourceRef/sourceId", "schema.pattern")}),
        (GOOD | {"quotes": [" "]}, {("/quotes", taken)}), (GOOD | {"quotes": []}, {("/sourceRef", "evidence.retrieved-requirements")}), (GOOD | {"evidenceType": "derived"}, {("/calculationId", "evidence.derived-requirements")}),
        (GOOD | {"locators": [{"type": "unknown", "value": "\t"}]}, {("/locators", taken)}), (GOOD | {"quotes": ["a", 3, None]}, {("/quotes/1", "schema.type"), ("/quotes/2", "schema.type")}),
        (GOOD | {"extractedValues": [{"value": "1", "numericValue": 1.0, "unit": "kg", "context": ""}]}, {("/extractedValues", taken)})]
    rows = [(i, json.dumps(r)) for i, (r, _) in enumerate(cases)] + [(99, '{"a":1,"a":2}'), (98, "[]"), (97, None), (96, "{no"), (95, json.dumps(GOOD | {"method": "x" * 900}))]
    got = told(spark, rows, "evidence", taken_in=True, most_bytes=1200)
    for i, (_, want) in enumerate(cases):
        assert got.get(i, set()) == want, i
    assert got[99] == got[97] == got[96] == {("/", "schema.malformed")} and got[98] == {("/", "schema.type")} and got[95] == {("/", "schema.too-large")}
    assert not any(code == taken for issues in told(spark, rows, "evidence").values() for _, code in issues)


def sample(place, rng):
    """A value that fits a place."""
    if place.nullable and rng.random() < 0.3:
        return None
    if place.kind == "object":
        return {k: sample(x, rng) for k, x in place.fields.items()}
    if place.kind == "array":
        return [sample(place.item, rng) for _ in range(rng.randrange(3))]
    if place.kind == "string":
        if place.values:
            return rng.choice(place.values)
        shapes = {schemas.SHA256: "a" * 64, schemas.TIMESTAMP: "2024-02-03T04:05:06.789Z", None: "text é/", "(?s).": "x"}
        return shapes[place.pattern] if place.pattern in shapes else place.pattern[1:].split("[")[0] + "0123456789abcdef"
    if place.kind == "boolean":
        return rng.random() < 0.5
    return place.const if place.const is not None else rng.choice((1, 2)) if place.kind == "integer" else rng.choice((0.25, 1, 0))


def judge(place, v, path=""):
    """Brute force: what breaks at a place and below it."""
    here = path or "/"
    if place.nullable:
        if v is None:
            return set()
        found = judge(schemas.replace(place, nullable=False), v, path)
        return {(here, "schema.type")} if len(found) > 1 else found
    number = isinstance(v, int | float) and not isinstance(v, bool)
    fits = {"object": isinstance(v, dict), "array": isinstance(v, list), "string": isinstance(v, str), "boolean": isinstance(v, bool), "number": number, "integer": number and v == int(v)}[place.kind]
    if not fits:
        return {(here, "schema.type")} | ({(here, "schema.enum")} if place.values else set()) | ({(here, "schema.const")} if place.const is not None else set())
    out = set()
    if place.kind == "object":
        told = lambda k: f"{path}/{k.replace('~', '~0').replace('/', '~1')}"
        out = {(told(k), "schema.required") for k in place.fields if k not in v} | {(told(k), "schema.additionalProperties") for k in v if k not in place.fields}
        if not out:
            for k, x in place.fields.items():
                out |= judge(x, v[k], f"{path}/{k}")
            p = v.get("relativePath")
            if not out and place.rule and (not p or p.startswith("/") or re.match("[a-z]:", p, re.I) or "\\" in p or any(x in ("", ".", "..") for x in p.split("/"))):
                out = {(f"{path}/relativePath", "calculation.relative-path")}
    elif place.kind == "array":
        for i, x in enumerate(v):
            out |= judge(place.item, x, f"{path}/{i}")
    else:
        out |= {(here, "schema.minLength" if place.pattern == "(?s)." else "schema.pattern")} if place.pattern and not re.search(place.pattern, v) else set()
        out |= {(here, "schema.enum")} if place.values and v not in place.values else set()
        out |= {(here, "schema.const")} if place.const is not None and v != place.const else set()
        out |= {(here, "schema.minimum")} if place.low is not None and v < place.low else set()
        out |= {(here, "schema.maximum")} if place.high is not None and v > place.high else set()
    return out


def whole(kind, v):
    real = lambda t: t.startswith("2024-02-03")
    if kind == "sources":
        return set() if real(v["retrievedAt"]) else {("/retrievedAt", "source.timestamp")}
    if kind == "evidence":
        if v["evidenceType"] == "retrieved":
            return set() if v["sourceRef"] and (v["quotes"] or v["extractedValues"]) else {("/sourceRef", "evidence.retrieved-requirements")}
        return set() if v["calculationId"] is not None or v["method"] else {("/calculationId", "evidence.derived-requirements")}
    if kind == "calculations":
        out = set() if real(v["startedAt"]) and real(v["endedAt"]) else {("/startedAt", "calculation.timestamp")}
        code = v["exitCode"]
        fine = {"success": code == 0, "failed": code not in (None, 0), "cancelled": code is None}[v["status"]]
        return out if fine else out | {("/exitCode", "calculation.status-exit")}
    return set()


@pytest.mark.parametrize("kind", sorted(schemas.SCHEMAS))
def test_every_schema_equals_brute_force(spark, kind):
    rng = random.Random(kind)
    rows, want = [], {}
    for n in range(150):
        v = sample(schemas.SCHEMAS[kind], rng)
        for _ in range(rng.choice((0, 0, 1, 1, 2))):
            at, x = [], v
            while isinstance(x, dict | list) and x and (not at or rng.random() < 0.7):
                k = rng.choice(list(x) if isinstance(x, dict) else range(len(x)))
                at.append((x, k))
                x = x[k]
            over, k = at[-1]
            how = rng.random()
            if how < 0.2 and isinstance(over, dict):
                over.pop(k)
            elif how < 0.4 and isinstance(over, dict):
                over[rng.choice(("extra", "a/b", "~"))] = rng.choice((1, None, {"x": []}))
            else:
                over[k] = rng.choice((None, 0, -1, 1.5, 2, 2.0, "", "x", "a/../b", "2023-02-30T00:00:00.000Z", True, [], {}, [1], {"a": 1}))
        issues = judge(schemas.SCHEMAS[kind], v)
        want[n] = issues or whole(kind, v)
        keys = list(v) if isinstance(v, dict) else []
        rows.append((n, json.dumps({k: v[k] for k in rng.sample(keys, len(keys))} if keys else v, ensure_ascii=rng.random() < 0.5)))
    got = told(spark, rows, kind)
    for n, raw in rows:
        assert got.get(n, set()) == want[n], raw
    assert sum(map(bool, want.values())) > 30


def test_catalog(spark):
    r = spark.createDataFrame([("claims", "a", 1, 1), ("claims", "a", 2, 2), ("claims", "b", 2, 3), ("claims", "a", 2, 4)], "kind string, id string, revision long, seq long")
    assert [(x["id"], x["seq"], x["code"]) for x in catalog.revision_order(r).orderBy("seq").collect()] == [("b", 3, "transaction.invalid-reference"), ("a", 4, "transaction.duplicate-record")]
    e = spark.createDataFrame([(1, "claims", "a", 1), (1, "claims", "a", 2), (2, "claims", "b", None), (3, "claims", "b", None)], "seq long, dst_kind string, dst_id string, dst_rev long")
    assert sorted((x["seq"], x["dst_id"]) for x in catalog.forward_refs(e, r).collect()) == [(1, "a"), (2, "b")]


def test_journal(spark):
    j = spark.createDataFrame([("a", 1, 1, "x"), ("a", 2, 2, "y"), ("a", 3, 4, "z"), ("b", 4, 1, "x"), ("b", 5, 2, "x")], "attempt_id string, seq long, local_seq long, sha string")
    assert [(x["seq"], x["code"][-8:]) for x in catalog.journal_violations(j).orderBy("seq").collect()] == [(3, "sequence"), (5, "nal-hash")]


def test_merge(spark):
    schema = "key string, doi string, pmid string, pmcid string, url string, title string"
    old = spark.createDataFrame([("s1", "d1", None, None, None, None), ("s2", "d2", None, None, None, "T2")], schema)
    new = spark.createDataFrame([("n1", "d1", "7", None, None, "T1"), ("n2", "d2", None, None, None, "T2"), ("n3", "d9", None, None, None, "T9")], schema)
    got = {r["retained"]: r for r in catalog.merge_sources(old, new, ["title"]).collect()}
    assert {k: r["action"] for k, r in got.items()} == {"s1": "revised", "s2": "unchanged", "n3": "added"}
    assert (got["s1"]["pmid"], got["s1"]["title"], got["s1"]["aliases"]) == ("7", "T1", ["n1"])


def test_merge_by_url(spark):
    """A URL unites sources unless strong identifiers differ among those that have it."""
    schema = "key string, doi string, pmid string, pmcid string, url string, title string"
    old = spark.createDataFrame([("s1", None, None, None, "u1", None), ("s2", "d2", None, None, "u2", "T2"), ("s4", "d4", "4", None, None, None), ("s5", None, "5", None, None, None)], schema)
    new = spark.createDataFrame([("n1", "d1", None, None, "u1", "T1"), ("n2", "d3", None, None, "u2", "T3"), ("n4", "d4", "5", None, None, None), ("n6", "d6", "6", None, None, None), ("n7", "d7", "6", None, None, None)], schema)
    got = {r["retained"]: (r["action"], r["aliases"], r["conflicts"]) for r in catalog.merge_sources(old, new, ["title"]).collect()}
    assert got == {
        "s1": ("revised", ["n1"], []), "s2": ("ambiguous", [], []), "n2": ("ambiguous", [], []), "s4": ("ambiguous", ["n4", "s5"], ["pmid"]), "n6": ("added", ["n7"], ["doi"])}


def test_accepted_plan(spark):
    a = spark.createDataFrame([("r", "p", "committed", 5), ("q", "p", "committed", 5), ("q", "p2", "committed", 6)], "run_id string, attempt_id string, phase string, seq long")
    m = spark.createDataFrame([("r", 1, 10), ("r", 4, 20), ("r", 6, 30)], "run_id string, seq long, max_sources long")
    assert [(r["run_id"], r["max_sources"]) for r in catalog.accepted_plan(a, m).collect()] == [("r", 20)]
