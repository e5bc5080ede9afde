"""Scholarly identifiers, URLs, dates and other scalar rules as column expressions.

An expression gives NULL where the input is not acceptable.
"""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tessera.functions.addresses import ipv6_text, let

# Hosts, labels and limits that results must agree with.
DOI_BYTES = 512
SCALAR_BYTES = 4096
ACCESS_LEVELS = ("metadata-only", "abstract-only", "partial-text", "full-text")
TITLE_LABELS = ("title", "article-title")
FRONT_LABELS = ("title", "article-title", "abstract", "summary", "keyword", "keywords", "key-words")
BODY_LABELS = (
    "introduction", "background", "methods", "materials-and-methods", "patients-and-methods", "results", "discussion",
    "conclusion", "conclusions", "case-report", "case-presentation", "body", "main", "main-text")
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
#: Minutes by default and at least, sources, waves.
DEPTH_PROFILES = {"quick": (15, 5, 12, 1), "standard": (45, 10, 30, 2), "deep": (120, 20, 80, 4)}
PROVIDER_HOSTS = {
    "crossref": ("api.crossref.org",), "openalex": ("api.openalex.org",),
    "ncbi": ("eutils.ncbi.nlm.nih.gov", "www.ncbi.nlm.nih.gov")}
CONTROL_OR_BIDI = r"[\x{0}-\x{1f}\x{7f}-\x{9f}\x{61c}\x{200e}\x{200f}\x{202a}-\x{202e}\x{2066}-\x{2069}]"
MALFORMED_PERCENT = r"%(?![0-9a-fA-F]{2})"
SPACE = r"[\s\x{b}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"


def canonical_bytes(text: Column) -> Column:
    """Bytes of the JSON string of a text without control characters."""
    return F.octet_length(text) + 2 + F.regexp_count(text, F.lit(r'["\\]'))


def decode_component(text: Column) -> Column:
    """Percent-decoding; bytes that are no UTF-8 become U+FFFD, NULL if an escape is malformed."""
    return let(text, lambda t: F.when(~t.rlike(MALFORMED_PERCENT), F.try_url_decode(F.replace(t, F.lit("+"), F.lit("%2B")))))


def normalize_doi(raw: Column) -> Column:
    """Lower-case DOI without resolver or scheme; ``%`` is written ``%25``.

    A resolver URL is decoded once for the URL and once more for the DOI in it.
    """
    resolver = r"^https://(?:doi\.org|dx\.doi\.org)/([^?#]*)$"

    def decoded(path: Column) -> Column:
        dotted = F.exists(F.split(path, "/"), lambda p: p.rlike(r"(?i)^(?:\.|%2e){1,2}$"))
        prefix = F.substring_index(path, "/", 1)
        return F.when(~dotted & F.contains(path, F.lit("/")) & ~prefix.rlike("(?i)%2f"), decode_component(path))

    def of(raw: Column, text: Column) -> Column:
        in_url = F.when(text.rlike(resolver), let(F.regexp_extract(text, resolver, 1), decoded))
        bare = F.when(text.rlike(r"(?i)^https?://"), in_url).otherwise(F.regexp_replace(text, r"(?i)^doi:", ""))
        sound = ~raw.rlike(CONTROL_OR_BIDI) & ~F.contains(raw, F.lit("\\")) & (canonical_bytes(raw) <= SCALAR_BYTES)
        return F.when(sound, let(let(bare, lambda b: decode_component(F.when(~b.rlike(r"[?#]"), b))), written))

    def written(plain: Column) -> Column:
        out = F.replace(F.lower(plain), F.lit("%"), F.lit("%25"))
        return F.when(plain.rlike(r"^10\.[0-9]{4,9}/[\x21-\x5B\x5D-\x7E]+$"), let(out, lambda o: F.when(canonical_bytes(o) <= DOI_BYTES, o)))

    return let(raw, lambda r: let(F.trim(r), lambda t: of(r, t)))


def encode_component(text: Column) -> Column:
    """Percent-encoding that leaves ``- _ . ! ~ * ' ( )`` and alphanumerics."""
    out = F.url_encode(text)
    for code, char in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(char))
    return out


def canonical_doi_url(doi: Column) -> Column:
    """Resolver URL of a normalised DOI; its ``%25`` is encoded again, as resolver URLs are decoded twice."""

    def url(d: Column) -> Column:
        head, rest = F.substring_index(d, "/", 1), F.substring(d, F.instr(d, "/") + 1, F.length(d))
        return F.concat(F.lit("https://doi.org/"), encode_component(head), F.lit("/"), encode_component(rest))

    return let(doi, url)


def normalize_pmid(raw: Column) -> Column:
    digits = F.ltrim(F.regexp_extract(F.trim(raw), r"(?i)^(?:pmid:)?([0-9]{1,12})$", 1), F.lit("0"))
    return F.when(~raw.rlike(CONTROL_OR_BIDI) & (digits != ""), digits)


def normalize_pmcid(raw: Column) -> Column:
    digits = F.ltrim(F.regexp_extract(F.trim(raw), r"(?i)^(?:pmcid:)?pmc([0-9]{1,12})$", 1), F.lit("0"))
    return F.when(~raw.rlike(CONTROL_OR_BIDI) & (digits != ""), F.concat(F.lit("PMC"), digits))


def pmid_url(pmid: Column) -> Column:
    return F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), pmid, F.lit("/"))


def pmcid_url(pmcid: Column) -> Column:
    return F.concat(F.lit("https://pmc.ncbi.nlm.nih.gov/articles/"), pmcid, F.lit("/"))


def remove_dot_segments(path: Column) -> Column:
    """Resolves ``.`` and ``..`` segments, also percent-encoded ones, of a path that starts with a slash."""
    dot, twice = r"(?i)^(\.|%2e)$", r"(?i)^(\.|%2e){2}$"

    def step(acc: Column, part: Column) -> Column:
        up = F.slice(acc["kept"], F.lit(1), F.greatest(F.size(acc["kept"]) - 1, F.lit(0)))
        kept = F.when(part.rlike(twice), up).when(part.rlike(dot), acc["kept"]).otherwise(F.concat(acc["kept"], F.array(part)))
        return F.struct(kept.alias("kept"), (part.rlike(dot) | part.rlike(twice)).alias("open"))

    start = F.struct(F.expr("cast(array() as array<string>)").alias("kept"), F.lit(False).alias("open"))
    parts = let(path, lambda p: F.split(F.substring(p, F.lit(2), F.length(p)), "/"))
    return F.aggregate(parts, start, step, lambda a: F.concat(F.lit("/"), F.array_join(a["kept"], "/"), F.when(a["open"] & (F.size(a["kept"]) > 0), "/").otherwise("")))


def percent_encode(text: Column, also: str) -> Column:
    """Percent-encodes the characters of the class ``also`` and all that are not ASCII; escapes stay as they are."""
    unsafe = rf"[{also}]|[^\x{{0}}-\x{{7f}}]"
    each = lambda t: F.transform(F.split(t, ""), lambda c: F.when(c.rlike(unsafe), F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))).otherwise(c))
    return let(text, lambda t: F.when(t.rlike(unsafe), F.array_join(each(t), "")).otherwise(t))


def normalize_url(raw: Column, allow_http: bool = False) -> Column:
    """https URL (http if allowed) as browsers write it: lower-case host, no default port, no dot segments.

    Rejects credentials, fragments, control and bidirectional marks, inner spaces, backslashes,
    malformed escapes and hosts that are not plain names, dotted IPv4 or bracketed IPv6 addresses.
    """
    shape = r"^(?i:(https?))://(\[[0-9A-Fa-f:.]+\]|[A-Za-z0-9!$&'()*+,;=_.~-]+)(?::([0-9]{1,7}))?(/[^?#]*)?(\?[^#]*)?$"
    # a host whose last label is a number is an IPv4 address, and must be a plain one
    byte = r"(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"

    def parts(text: Column) -> Column:
        scheme, host, port, path, query = (F.regexp_extract(text, shape, i) for i in range(1, 6))
        return F.struct(F.lower(scheme).alias("scheme"), F.lower(host).alias("host"), port.alias("port"), port.try_cast("int").alias("number"), path.alias("path"), query.alias("query"))

    def named(host: Column) -> Column:
        """The host as written out, NULL if it is not a right one."""
        inner = F.regexp_extract(host, r"^\[(.*)\]$", 1)
        numeric = host.rlike(r"(^|\.)([0-9]+|0x[0-9a-f]*)\.?$")
        return F.when(host.startswith("["), F.concat(F.lit("["), ipv6_text(inner), F.lit("]"))).when(~numeric | host.rlike(rf"^{byte}(\.{byte}){{3}}$"), host)

    def written(p: Column) -> Column:
        scheme, port, number = p["scheme"], p["port"], p["number"]
        usual = (port == "") | ((scheme == "http") & (number == 80)) | ((scheme == "https") & (number == 443))
        shown = F.when(usual, "").otherwise(F.concat(F.lit(":"), number.cast("string")))
        whole = percent_encode(remove_dot_segments(F.when(p["path"] == "", "/").otherwise(p["path"])), r"\x22<>`{}^")
        sound = ((scheme == "https") | F.lit(allow_http)) & ((port == "") | (number <= 65535))
        return F.when(sound, F.concat(scheme, F.lit("://"), named(p["host"]), shown, whole, percent_encode(p["query"], r"\x22<>'")))

    def of(raw: Column, text: Column) -> Column:
        sound = (
            text.rlike(shape) & ~raw.rlike(CONTROL_OR_BIDI) & ~text.rlike(SPACE) & ~F.contains(raw, F.lit("\\")) & ~raw.rlike(MALFORMED_PERCENT)
            & (canonical_bytes(raw) <= SCALAR_BYTES))
        return F.when(sound, let(parts(text), written))

    return let(raw, lambda r: let(F.trim(r), lambda t: of(r, t)))


def redact_url(url: Column) -> Column:
    """Origin and path with upper-case escapes; a query becomes ``?redacted``."""
    base, query = F.regexp_extract(url, r"^([^?#]*)", 1), F.regexp_extract(url, r"^[^?#]*(\?[^#]*)?", 1)
    escaped = F.transform(F.split(base, "%"), lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.upper(F.substring(p, 1, 2)), F.substring(p, F.lit(3), F.length(p)))))
    return F.concat(F.array_join(escaped, "%"), F.when(F.length(query) > 1, "?redacted").otherwise(""))


def url_trace(url: Column) -> Column:
    """What a trace keeps of a URL: (canonical_url, canonical_url_sha256), the digest of the whole URL."""
    whole = F.to_json(F.struct(F.lit(1).alias("schemaVersion"), url.alias("url")))
    return F.when(url.isNotNull(), F.struct(redact_url(url).alias("canonical_url"), F.sha2(F.replace(whole, F.lit("\\/"), F.lit("/")), 256).alias("canonical_url_sha256")))


def allowed_origin(url: Column, target: str) -> Column:
    """Whether a URL is of one of the target's fixed origins: https, default port, no credentials or fragment."""
    hosts = "|".join(h.replace(".", r"\.") for h in PROVIDER_HOSTS[target])
    return F.coalesce(url.rlike(rf"^https://(?:{hosts})(?::443)?(?:[/?]|$)") & ~url.rlike(r"[\x{0}-\x{20}\x{7f}#\\]"), F.lit(False))


def identity_keys(doi: Column, pmid: Column, pmcid: Column, url: Column) -> Column:
    """Keys by which sources are the same: doi:, pmid:, pmcid:, url:."""
    return F.array_compact(F.array(*[F.concat(F.lit(p), c) for p, c in (("doi:", doi), ("pmid:", pmid), ("pmcid:", pmcid), ("url:", url))]))


def is_timestamp(raw: Column) -> Column:
    """RFC 3339 in UTC with milliseconds, and a real instant."""
    shape = raw.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{3}Z$")
    at = F.try_to_timestamp(F.regexp_replace(raw, r"[TZ]", " "), F.lit("yyyy-MM-dd HH:mm:ss.SSS "))
    return F.coalesce(shape & (F.date_format(at, "yyyy-MM-dd HH:mm:ss.SSS ") == F.regexp_replace(raw, r"[TZ]", " ")), F.lit(False))


def orcid(raw: Column) -> Column:
    """ORCID URL with a right ISO 7064 check character, from the URL or the bare dashed number."""
    bare = F.regexp_replace(raw, r"^https://orcid\.org/", "")
    # the places of the digits are fixed, so no array of them is made; ((0 + a) * 2 + b) * 2 ... written out
    at = [p for p in range(1, 19) if p % 5]
    total = sum(((F.ascii(F.substring(bare, p, 1)) - 48).cast("long") * (1 << (15 - i)) for i, p in enumerate(at)), F.lit(0))
    check = F.substring(F.lit("10X98765432"), (F.pmod(total, F.lit(11)) + 1).cast("int"), F.lit(1))
    right = F.substring(bare, 19, 1) == check
    return F.when(bare.rlike(r"^[0-9]{4}-[0-9]{4}-[0-9]{4}-[0-9]{3}[0-9X]$") & right, F.concat(F.lit("https://orcid.org/"), bare))


def date_parts(year: Column, month: Column, day: Column) -> Column:
    """Partial date with its precision; NULL if the day or month does not exist."""
    y, m, d = F.lpad(year, 4, "0"), F.lpad(month, 2, "0"), F.lpad(day, 2, "0")
    whole = F.concat_ws("-", y, m, d)
    real = F.date_format(F.try_to_timestamp(whole, F.lit("yyyy-MM-dd")), "yyyy-MM-dd") == whole
    ok = year.between(1, 9999)
    return (
        F.when(ok & month.isNull(), F.struct(y.alias("date"), F.lit("year").alias("precision")))
        .when(ok & month.between(1, 12) & day.isNull(), F.struct(F.concat_ws("-", y, m).alias("date"), F.lit("month").alias("precision")))
        .when(ok & month.between(1, 12) & real, F.struct(whole.alias("date"), F.lit("day").alias("precision"))))


def month_number(name: Column) -> Column:
    at = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(F.substring(name, 1, 3))).cast("int")
    return F.when(at > 0, at)


def first_text(values: Column) -> Column:
    """First string of an array that is not blank."""
    return F.get(F.filter(values, lambda v: F.trim(v) != ""), F.lit(0))


def abstract_text(inverted: Column) -> Column:
    """Text from a word-to-positions map; NULL unless the positions are exactly 0 .. n - 1."""
    spread = F.array_sort(F.flatten(F.transform(F.map_entries(inverted), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("at"), e["key"].alias("word"))))))

    def text(words: Column) -> Column:
        dense = F.forall(F.transform(words, lambda s, i: s["at"] == i), lambda b: b)
        return F.when(dense & (F.size(words) > 0), F.array_join(F.transform(words, lambda s: s["word"]), " "))

    return let(spread, text)


def section_label(label: Column) -> Column:
    """Lower-case label with single dashes for runs of space, dash and underscore; NULL if not ASCII."""
    plain = F.regexp_replace(F.lower(F.trim(label)), r"[ _-]+", "-")
    return F.when(~label.rlike(r"[^\x{0}-\x{7f}]"), F.regexp_replace(plain, "-$", ""))


def section_class(label: Column) -> Column:
    name = section_label(label)
    return F.when(name.isin(*BODY_LABELS), "body").when(name.isin(*FRONT_LABELS), "front").otherwise("unknown")


def backoff_ms(next_ordinal: Column, base_ms: Column, most_ms: Column, draw: Column, retry_after_ms: Column, left_ms: Column) -> Column:
    """Full jitter: floor(draw x min(most, base x 2^(next ordinal - 2))), at least retry-after, at most ``most`` and what is left."""
    ceiling = F.least(base_ms * F.pow(F.lit(2.0), F.greatest(F.lit(0), next_ordinal - 2)), most_ms)
    wait = F.greatest(F.floor(draw * ceiling), F.coalesce(retry_after_ms, F.lit(0)))
    return F.greatest(F.lit(0), F.floor(F.least(wait, most_ms, left_ms))).cast("long")


def finalization_reserve_ms(limit_ms: Column) -> Column:
    return F.least(F.lit(600_000), F.greatest(F.lit(60_000), F.floor(limit_ms * 0.2)), F.floor(limit_ms * 0.5)).cast("long")


def _without_marks(text: pd.Series) -> pd.Series:
    """Compatibility decomposition without combining marks, which Spark has no expression for."""
    return text.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if not "\u0300" <= c <= "\u036f"))


def topic_slug(text: Column, most: int = 64) -> Column:
    slug = F.trim(F.regexp_replace(F.lower(F.pandas_udf(_without_marks, StringType())(text)), r"[^a-z0-9]+", "-"), F.lit("-"))
    short = F.rtrim(F.substring(slug, 1, most), F.lit("-"))
    return F.when(short == "", "research").otherwise(short)


def portable_path(path: Column) -> Column:
    """Relative path of plain segments: no empty, ``.`` or ``..`` segment, backslash or drive letter."""
    parts = F.forall(F.split(path, "/"), lambda p: ~p.isin("", ".", ".."))
    return F.coalesce(parts & ~F.contains(path, F.lit("\\")) & ~path.rlike("(?i)^[a-z]:"), F.lit(False))


def depth_profile(depth: Column) -> Column:
    """(active_minutes, least_active_minutes, max_sources, max_waves) of a depth; NULL for others."""
    names = ("active_minutes", "least_active_minutes", "max_sources", "max_waves")
    rows = {d: F.struct(*[F.lit(v).alias(n) for n, v in zip(names, values, strict=True)]) for d, values in DEPTH_PROFILES.items()}
    return reduce(lambda out, d: F.when(depth == d, rows[d]).otherwise(out), rows, F.lit(None))


#: Prefixes of new identifiers.
ID_PREFIXES = {
    "run": "run", "task": "task", "attempt": "attempt", "source": "src", "claim": "claim", "evidence": "ev", "verification": "verify",
    "request": "request", "calculation": "calc", "retry": "retry", "transaction": "tx"}


def new_id(kind: str, random_hex: Column) -> Column:
    """The kind's prefix and 32 hexadecimal digits; the draw is a column, so that a stored one can be replayed."""
    return F.when(random_hex.rlike("^[0-9a-f]{32}$"), F.concat(F.lit(f"{ID_PREFIXES[kind]}-"), random_hex))


def id_pattern(kind: str) -> str:
    """Pattern of an existing identifier; sources also keep names that were given to them."""
    return r"^src-[a-z0-9][a-z0-9._-]{7,127}$" if kind == "source" else rf"^{ID_PREFIXES[kind]}-[a-z0-9]{{16,64}}$"


def new_revision_id(at: Column, random_hex: Column) -> Column:
    """``rev-``, the UTC instant without separators, and 12 hexadecimal digits."""
    return F.when(random_hex.rlike("^[0-9a-f]{12}$"), F.concat(F.lit("rev-"), F.date_format(at, "yyyyMMdd'T'HHmmssSSS'Z'"), F.lit("-"), random_hex))


def access_rank(level: Column) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in ACCESS_LEVELS]), level).cast("int")


#: The prefixes of keys; each is followed by the SHA-256 of its canonical preimage.
KEY_PREFIXES = {"partition": "partition-v1-", "candidate": "candidate-v1-", "trace": "trace-v1-", "document": "document-v1-", "group": "candidate-group-v1-"}


def prefixed_key(kind: str, **fields: Column) -> Column:
    """Key of ``kind`` over its fields and ``schemaVersion`` 1, in the order of their names, nulls kept."""
    parts = {"schemaVersion": F.lit(1), **fields}
    text = F.to_json(F.struct(*[parts[k].alias(k) for k in sorted(parts)]), {"ignoreNullFields": "false"})
    return F.concat(F.lit(KEY_PREFIXES[kind]), F.sha2(text, 256))


def code_unit_order(text: Column) -> Column:
    """Sort key for UTF-16 code-unit order."""
    return F.encode(text, "UTF-16BE")
