"""Landed provider payloads (JSON text) to candidate rows with one schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import identifiers as I

CANDIDATE = ("provider", "record_id", "doi", "pmid", "pmcid", "url", "title", "authors", "venue", "publisher", "published", "publication_type", "access_level")

# Schemas are declared; nothing is inferred.
CROSSREF = """message struct<items: array<struct<
  DOI: string, URL: string, title: array<string>, publisher: string, type: string, subtype: string,
  author: array<struct<family: string, given: string, name: string, ORCID: string>>, `container-title`: array<string>,
  `published-print`: struct<`date-parts`: array<array<int>>>, `published-online`: struct<`date-parts`: array<array<int>>>,
  published: struct<`date-parts`: array<array<int>>>>>>"""
OPENALEX = """results array<struct<
  id: string, doi: string, ids: struct<doi: string, pmid: string, pmcid: string>, display_name: string, type: string,
  authorships: array<struct<author: struct<display_name: string>>>, publication_date: string, publication_year: int,
  primary_location: struct<landing_page_url: string, source: struct<display_name: string>>,
  abstract_inverted_index: map<string, array<int>>>>"""
PUBMED_RECORD = """uid string, title string, authors array<struct<name: string>>, fulljournalname string, source string,
  sortpubdate string, epubdate string, pubdate string, articleids array<struct<idtype: string, value: string>>, doctype string, error string"""
ELINK = "linksets array<struct<linksetdbs: array<struct<dbto: string, linkname: string, links: array<string>>>>>"
BIOC = """documents array<struct<id: string, infons: map<string, string>,
  passages: array<struct<infons: map<string, string>, text: string>>>>"""


def json_depth(payload: Column) -> Column:
    """Deepest nesting of objects and arrays; brackets inside strings do not count."""
    bare = F.regexp_replace(F.regexp_replace(payload, r'"(?:\\.|[^"\\])*+"', ""), r"[^\[\]{}]", "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(acc: Column, c: Column) -> Column:
        now = acc["now"] + F.when(c.isin("[", "{"), 1).otherwise(-1)
        return F.struct(now.alias("now"), F.greatest(acc["most"], now).alias("most"))

    return F.aggregate(F.filter(F.split(bare, ""), lambda c: c != ""), start, step, lambda a: a["most"])


def well_formed(payload: Column, most_bytes: int = 8 << 20, most_depth: int = 64) -> Column:
    """Strict JSON without duplicate keys, within the limits of size and depth."""
    return F.coalesce((F.octet_length(payload) <= most_bytes) & F.try_parse_json(payload).isNotNull() & (json_depth(payload) <= most_depth), F.lit(False))


def _literal(name: Column) -> Column:
    return F.struct(F.lit(None).cast("string").alias("family"), F.lit(None).cast("string").alias("given"), name.alias("literal"), F.lit(None).cast("string").alias("orcid"))


def _or_resolver(url: Column, doi: Column) -> Column:
    return F.coalesce(I.normalize_url(url), I.canonical_doi_url(doi))


def crossref(payloads: DataFrame) -> DataFrame:
    """Rows of CANDIDATE; bad identifiers and URLs are left out, not errors.  Dates: print, online, published."""
    items = payloads.select(F.posexplode(F.from_json("payload", CROSSREF)["message"]["items"]).alias("at", "r"))
    items, doi = items.withColumn("doi", I.normalize_doi(F.col("r.DOI"))), F.col("doi")
    person = lambda a: F.struct(a["family"].alias("family"), a["given"].alias("given"), F.when(a["family"].isNull(), a["name"]).alias("literal"), I.orcid(a["ORCID"]).alias("orcid"))
    date = lambda c: I.date_parts(F.get(F.col(f"r.{c}.date-parts")[0], F.lit(0)), F.get(F.col(f"r.{c}.date-parts")[0], F.lit(1)), F.get(F.col(f"r.{c}.date-parts")[0], F.lit(2)))
    kind = F.when(F.col("r.subtype") == "review", "review").when(F.col("r.type").isin("journal-article", "dataset"), F.col("r.type")).otherwise("other")
    return items.select(
        F.lit("crossref").alias("provider"), F.coalesce(doi, F.col("at").cast("string")).alias("record_id"), doi.alias("doi"), F.lit(None).cast("string").alias("pmid"), F.lit(None).cast("string").alias("pmcid"),
        _or_resolver(F.col("r.URL"), doi).alias("url"), I.first_text(F.col("r.title")).alias("title"), F.transform("r.author", person).alias("authors"),
        I.first_text(F.col("r.`container-title`")).alias("venue"), F.col("r.publisher").alias("publisher"), F.coalesce(date("`published-print`").getField("date"), date("`published-online`").getField("date"), date("published").getField("date")).alias("published"),
        kind.alias("publication_type"), F.lit("metadata-only").alias("access_level"))


def openalex(payloads: DataFrame) -> DataFrame:
    """Rows of CANDIDATE; records without a work id go; abstracts are rebuilt from the inverted index."""
    items = payloads.select(F.explode(F.from_json("payload", OPENALEX)["results"]).alias("r")).filter(F.col("r.id").rlike(r"^https://openalex\.org/W[0-9]+$"))
    items, doi = items.withColumn("doi", I.normalize_doi(F.coalesce("r.doi", "r.ids.doi"))), F.col("doi")
    kind = F.when(F.col("r.type") == "article", "journal-article").when(F.col("r.type").isin("review", "dataset"), F.col("r.type")).otherwise("other")
    abstract = I.abstract_text(F.col("r.abstract_inverted_index"))
    return items.select(
        F.lit("openalex").alias("provider"), F.col("r.id").alias("record_id"), doi.alias("doi"), I.normalize_pmid(F.regexp_extract("r.ids.pmid", "([0-9]+)/?$", 1)).alias("pmid"), I.normalize_pmcid(F.regexp_extract("r.ids.pmcid", "(?i)((?:PMC)?[0-9]+)/?$", 1)).alias("pmcid"),
        _or_resolver(F.col("r.primary_location.landing_page_url"), doi).alias("url"), F.col("r.display_name").alias("title"), F.transform("r.authorships", lambda a: _literal(a["author"]["display_name"])).alias("authors"),
        F.col("r.primary_location.source.display_name").alias("venue"), F.lit(None).cast("string").alias("publisher"), F.coalesce("r.publication_date", F.col("r.publication_year").cast("string")).alias("published"),
        kind.alias("publication_type"), F.when(abstract.isNotNull(), "abstract-only").otherwise("metadata-only").alias("access_level"))


def pubmed(payloads: DataFrame) -> DataFrame:
    """Rows of CANDIDATE from esummary payloads, in the order of their uids; error records go."""
    doc = F.from_json("payload", "result map<string, string>")["result"]
    uids = F.from_json(doc["uids"], "array<string>")
    rows = payloads.select(doc.alias("d"), F.posexplode(uids).alias("at", "uid")).select("at", "uid", F.from_json(F.col("d")[F.col("uid")], PUBMED_RECORD).alias("r")).filter("r.error is null")
    one = lambda k: F.get(F.filter("r.articleids", lambda a: a["idtype"] == k), F.lit(0))["value"]
    pmid = F.coalesce(I.normalize_pmid(one("pubmed")), F.col("uid"))
    kind = F.when(F.lower("r.doctype").contains("review"), "review").when(F.lower("r.doctype").contains("dataset"), "dataset").when(F.lower("r.doctype").contains("journal article"), "journal-article").otherwise("other")
    day = lambda c: F.regexp_replace(F.regexp_extract(c, r"^([0-9]{4}(/[0-9]{2}){0,2})", 1), "/", "-")
    return rows.select(
        F.lit("pubmed").alias("provider"), F.col("uid").alias("record_id"), I.normalize_doi(one("doi")).alias("doi"), pmid.alias("pmid"), I.normalize_pmcid(one("pmc")).alias("pmcid"),
        I.pmid_url(F.col("uid")).alias("url"), F.col("r.title").alias("title"), F.transform("r.authors", lambda a: _literal(a["name"])).alias("authors"),
        F.coalesce("r.fulljournalname", "r.source").alias("venue"), F.lit(None).cast("string").alias("publisher"),
        F.coalesce(F.nullif(day("r.sortpubdate"), F.lit("")), F.nullif(day("r.epubdate"), F.lit("")), F.nullif(day("r.pubdate"), F.lit(""))).alias("published"), kind.alias("publication_type"), F.lit("metadata-only").alias("access_level"))


def linked_pmcids(payloads: DataFrame) -> DataFrame:
    """Rows (pmcid) of the links from PubMed to PMC, distinct, in numeric order; a fetch takes the first."""
    dbs = F.flatten(F.transform(F.from_json("payload", ELINK)["linksets"], lambda s: s["linksetdbs"]))
    kept = F.filter(dbs, lambda d: (d["dbto"] == "pmc") & (d["linkname"] == "pubmed_pmc"))
    ids = payloads.select(F.explode(F.flatten(F.transform(kept, lambda d: d["links"]))).alias("id")).distinct()
    return ids.orderBy(F.length("id"), "id").select(F.concat(F.lit("PMC"), "id").alias("pmcid"))


def pmc(payloads: DataFrame) -> DataFrame:
    """Rows of CANDIDATE from full-text payloads; access follows the sections' labels."""
    doc = payloads.select(F.from_json("payload", BIOC)["documents"][0].alias("d"))
    said = F.filter("d.passages", lambda p: F.trim(F.coalesce(p["text"], F.lit(""))) != "")
    classes = F.transform(said, lambda p: I.section_class(p["infons"]["section_type"]))
    title = F.get(F.filter("d.passages", lambda p: I.section_label(p["infons"]["section_type"]).isin(*I.TITLE_LABELS)), F.lit(0))["text"]
    access = F.when(F.size(classes) == 0, "metadata-only").when(F.array_contains(classes, "body"), "full-text").when(F.forall(classes, lambda c: c == "front"), "abstract-only").otherwise("partial-text")
    infons = F.get("d.passages", F.lit(0))["infons"]
    pmcid = I.normalize_pmcid(F.concat(F.lit("PMC"), F.regexp_replace("d.id", "(?i)^PMC", "")))
    return doc.select(
        F.lit("pmc").alias("provider"), pmcid.alias("record_id"), I.normalize_doi(infons["article-id_doi"]).alias("doi"), I.normalize_pmid(infons["article-id_pmid"]).alias("pmid"), pmcid.alias("pmcid"),
        I.pmcid_url(pmcid).alias("url"), title.alias("title"), F.expr("cast(null as array<struct<family: string, given: string, literal: string, orcid: string>>)").alias("authors"),
        F.lit(None).cast("string").alias("venue"), F.lit(None).cast("string").alias("publisher"), F.lit(None).cast("string").alias("published"), F.lit("journal-article").alias("publication_type"), access.alias("access_level"))
