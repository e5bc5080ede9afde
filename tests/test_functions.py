from __future__ import annotations

import hashlib
import ipaddress
import json
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import addresses as A
from tessera.functions import canonical as C
from tessera.functions import identifiers as I


def column(spark, expression, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["out"] for r in df.select("i", expression(F.col("v")).alias("out")).orderBy("i").collect()]


def test_doi(spark):
    cases = {
        " DOI:10.1234/AbC ": "10.1234/abc", "https://doi.org/10.1234/a%2Fb+c": "10.1234/a/b+c", "https://dx.doi.org/10.1234/a%252Fb": "10.1234/a/b",
        "10.1234/a%2Fb": "10.1234/a/b", "10.1234/50%25": "10.1234/50%25", "10.1234/50%": None, "10.1234/%zz": None, "10.12/short": None,
        "10.1234/with space": None, "http://doi.org/10.1234/a": None, "https://doi.org/10.1234/a?b": None, "10.1234/a?b": None, "10.1234/a#b": None,
        "https://doi.org/10.1234/./a": None, "https://doi.org/10.1234/%2e%2E/a": None, "https://doi.org/10.1234%2Fa": None, "doi: 10.1234/a": None,
        "10.1234/a\\b": None, "10.1234/a\tb": None, "10.1234/é": None, "10.1234/" + "x" * 502: "10.1234/" + "x" * 502, "10.1234/" + "x" * 503: None, "HTTPS://DOI.ORG/10.1234/a": None}
    assert dict(zip([*cases, None], column(spark, I.normalize_doi, [*cases, None]), strict=True)) == {**cases, None: None}


def test_doi_url(spark):
    dois = ["10.1234/a(b)*c%25", "10.1234/a/b+c~d"]
    urls = column(spark, I.canonical_doi_url, dois)
    assert urls == ["https://doi.org/10.1234/a(b)*c%2525", "https://doi.org/10.1234/a%2Fb%2Bc~d"]
    assert column(spark, I.normalize_doi, urls) == dois


def test_ids(spark):
    assert column(spark, I.normalize_pmid, ["pmid:00123", "0", "12a", "1234567890123", "PMID: 12", " 7 ", "7\n"]) == ["123", None, None, None, None, "7", None]
    assert column(spark, I.normalize_pmcid, ["pmc0042", "42", "PMC0", "pmcid:PMC7", "pmcid: PMC7"]) == ["PMC42", None, None, "PMC7", None]
    got = column(spark, I.orcid, ["https://orcid.org/0000-0002-1825-0097", "0000-0002-1825-0098", "0000-0002-9079-593X", "http://orcid.org/0000-0002-1825-0097", "0000000218250097"])
    assert got == ["https://orcid.org/0000-0002-1825-0097", None, "https://orcid.org/0000-0002-9079-593X", None, None]


def test_urls(spark):
    cases = {
        "HTTPS://Ex.COM:443": "https://ex.com/", "http://a.b/": None, "https://a.b/%zz": None, "https://u:p@h/": None, "https://h/x#f": None,
        "https://h:8080?q": "https://h:8080/?q", "ftp://h/": None, "https://h/a b": None, " https://h/p ": "https://h/p", "https://a.org/x/../y/./z": "https://a.org/y/z",
        "https://a.org/x/%2e%2E/": "https://a.org/", "https://a.org/x/..": "https://a.org/", "https://a.org/a/b/.": "https://a.org/a/b/", "https://a.org/../../x": "https://a.org/x",
        "https://[2001:DB8:0:0:1:0:0:1]/": "https://[2001:db8::1:0:0:1]/", "https://[::1]:80/": "https://[::1]:80/", "https://[1::2::3]/": None, "https://h:65536/": None,
        "https://1.2.3.4/": "https://1.2.3.4/", "https://1.2.3/": None, "https://h/é\"<": "https://h/%C3%A9%22%3C", "https://h/a\x85": None, "https://h/\u061c": None, "https://h\\x": None, "https://é.org/": None, "https:///x": None,
        "https://h/?a'b": "https://h/?a%27b", "https://h:0443/": "https://h/"}
    assert dict(zip(cases, column(spark, I.normalize_url, list(cases)), strict=True)) == cases
    assert column(spark, lambda v: I.normalize_url(v, True), ["HTTP://h:80/x", "https://h"]) == ["http://h/x", "https://h/"]
    assert column(spark, I.redact_url, ["https://h/a%2fb?q=1#f", "https://h/p", "https://h/p?"]) == ["https://h/a%2Fb?redacted", "https://h/p", "https://h/p"]
    got = column(spark, I.url_trace, ["https://h/a?k=v"])[0]
    assert tuple(got) == ("https://h/a?redacted", hashlib.sha256(b'{"schemaVersion":1,"url":"https://h/a?k=v"}').hexdigest())
    origins = ["https://api.crossref.org/x", "https://api.crossref.org:443?q", "https://api.crossref.org:8443/", "https://u@api.crossref.org/", "http://api.crossref.org/", "https://api.crossref.org.evil/", None]
    assert column(spark, lambda v: I.allowed_origin(v, "crossref"), origins) == [True, True, False, False, False, False, False]


def test_timestamps(spark):
    assert column(spark, I.is_timestamp, ["2024-02-29T00:00:00.000Z", "2023-02-29T00:00:00.000Z", "2024-01-01T00:00:00Z", None]) == [True, False, False, False]


def test_dates(spark):
    df = spark.createDataFrame([(2024, 2, 29), (2023, 2, 29), (2024, 5, None), (2024, None, None), (2024, 13, None)], "y int, m int, d int")
    got = [r[0] for r in df.select(I.date_parts(F.col("y"), F.col("m"), F.col("d"))).collect()]
    assert [tuple(g) if g else None for g in got] == [("2024-02-29", "day"), None, ("2024-05", "month"), ("2024", "year"), None]


def test_abstract(spark):
    assert column(spark, I.abstract_text, [{"a": [0, 2], "b": [1]}, {"a": [0], "b": [2]}, {"a": [0, 0]}], "map<string, array<int>>") == ["a b a", None, None]


def test_addresses(spark):
    assert column(spark, A.public_ipv4, ["8.8.8.8", "10.0.0.1", "256.1.1.1", "01.2.3.4", "172.32.0.1"]) == [True, False, False, False, True]
    cases = {"2606:4700::1": True, "::": False, "::1": False, "::8.8.8.8": False, "::ffff:8.8.8.8": True, "::ffff:10.1.2.3": False, "64:ff9b::1": False, "2001:db8::5": False, "2001:200::1": True,
             "2001:1ff::": False, "3fff:fff::": False, "3fff:1000::": True, "fe80::1": False, "fe00::1": True, "ff02::1": False, "1:2:3:4:5:6:7": False, "1::2::3": False, "8.8.4.4": True, "x": False, "1:2:3:4:5:6:7:8::": False, "g::": False}
    assert dict(zip(cases, column(spark, A.public_address, list(cases)), strict=True)) == cases


def test_ipv6_against_the_standard_library(spark):
    rng = random.Random(2)
    texts = []
    for _ in range(300):
        groups = [rng.choice([0, 0, 0, rng.getrandbits(16)]) for _ in range(8)]
        full = ":".join(f"{g:x}" for g in groups)
        texts += [full, ipaddress.IPv6Address(full).compressed, ipaddress.IPv6Address(full).exploded.upper()]
    assert column(spark, A.ipv6_text, texts) == [str(ipaddress.IPv6Address(t)) for t in texts]
    broken = ["", ":", "1:", ":1", "1:2", "12345::", "1::%eth0", "::1.2.3", "::1.2.3.256", "1.2.3.4"]
    assert column(spark, A.ipv6_text, broken) == [None] * len(broken)


def test_paths_slugs_sections(spark):
    assert column(spark, I.portable_path, ["a/b.txt", "../a", "a//b", "a\\b", "/a", "c:d", "ab:c", ""]) == [True, False, False, False, False, False, True, False]
    assert column(spark, I.topic_slug, ["  Deep & Wide: 2024! ", "Café crème ﬁne", "…", "x" * 63 + " yz", None]) == ["deep-wide-2024", "cafe-creme-fine", "research", "x" * 63, None]
    labels = {"Abstract": "front", "METHODS": "body", " ": "unknown", "references": "unknown", "Key_words": "front", "materials and  methods-": "body", "résults": "unknown", "main text": "body"}
    assert dict(zip(labels, column(spark, I.section_class, list(labels)), strict=True)) == labels
    assert column(spark, I.section_class, [None]) == ["unknown"]


def test_backoff(spark):
    rows = [(2, 1000, 60000, 0.5, None, 10000), (5, 1000, 60000, 1.0, 0, 100000), (9, 1000, 60000, 1.0, 0, 100000), (2, 1000, 60000, 0.5, 7000, 10000), (2, 1000, 60000, 0.5, 70000, 100000), (3, 1000, 60000, 1.0, None, 1500), (1, 1000, 60000, 1.0, None, 9000)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a int, b long, c long, d double, r long, l long")
    got = [r[0] for r in df.orderBy("i").select(I.backoff_ms(*[F.col(x) for x in "abcdrl"])).collect()]
    assert got == [500, 8000, 60000, 7000, 60000, 1500, 1000]


def test_profiles_ids_and_keys(spark):
    got = column(spark, I.depth_profile, ["quick", "deep", "other"])
    assert [tuple(r) if r else None for r in got] == [(15, 5, 12, 1), (120, 20, 80, 4), None]
    assert column(spark, lambda v: I.new_id("source", v), ["ab" * 16, "x"]) == ["src-" + "ab" * 16, None]
    at = F.lit("2024-02-29 01:02:03.004").cast("timestamp")
    assert column(spark, lambda v: I.new_revision_id(at, v), ["0a" * 6]) == ["rev-20240229T010203004Z-" + "0a" * 6]
    got = column(spark, lambda v: I.prefixed_key("group", status=v, identityKind=F.lit(None).cast("string")), ["a/b"])
    assert got == ["candidate-group-v1-" + hashlib.sha256(b'{"identityKind":null,"schemaVersion":1,"status":"a/b"}').hexdigest()]


@pytest.mark.parametrize(("raw", "want"), [
    ('{"b":1.0,"a":[1e21,1e-7,-0.0,0.1]}', '{"a":[1e+21,1e-7,0,0.1],"b":1}'),
    ('{"a":1,"a":2}', None), ("[NaN]", None), ('"\\u00e9\\n"', '"é\\n"'), ("{", None), ("123456789012345680000", "123456789012345680000"),
])
def test_canonical(raw, want):
    assert C.canonical_text(raw) == want


def test_canonical_paths_agree(spark):
    raws = [json.dumps({"z": [True, None, "x"], "a": {"k": 1.5, "b": 2}})] * 3
    assert column(spark, C.canonical_json, raws) == column(spark, C.canonical_json_fast, raws)


def test_code_unit_order(spark):
    df = spark.createDataFrame([("￿",), ("\U00010000",), ("a",)], "v string")
    assert [r[0] for r in df.orderBy(I.code_unit_order(F.col("v"))).collect()] == ["a", "\U00010000", "￿"]
