"""The evidence query: filters, keyset pages, cursors, and the bounded reference closure."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable
from dataclasses import asdict, dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.functions.canonical import canonical
from tessera.operators.graph import GraphError, reached, small
from tessera.plans.cut import cut, stored

# Kinds in page order, default and hard page size, default closure caps.
PAGE_KINDS = ("sources", "claims", "evidence", "verifications")
PAGE, HARD_PAGE = 1000, 10_000
CAPS = {"edges": 500_000, "records": 5000, "bytes": 32 << 20}
WRAPPER = len('{"calculations":[],"claims":[],"evidence":[],"requests":[],"sources":[],"verifications":[]}')


@dataclass(frozen=True)
class EvidenceQuery:
    """Filters; None is absent and matches all, an empty tuple is supplied and matches nothing."""

    stances: tuple[str, ...] | None = None
    qualities: tuple[str, ...] | None = None
    verification_statuses: tuple[str, ...] | None = None
    minimum_confidence: float | None = None
    access_levels: tuple[str, ...] | None = None
    lineage_ids: tuple[str, ...] | None = None
    attempt_ids: tuple[object, ...] | None = None
    task_ids: tuple[object, ...] | None = None
    roles: tuple[str, ...] | None = None
    limit: int = PAGE

    def normalised(self) -> dict:
        if not 1 <= self.limit <= HARD_PAGE:
            raise GraphError("query.limit-invalid", self.limit)
        if self.minimum_confidence is not None and not 0 <= self.minimum_confidence <= 1:
            raise GraphError("query.invalid-input", self.minimum_confidence)
        return {k: sorted(set(v)) if isinstance(v, tuple) else v for k, v in asdict(self).items()}

    def hash(self) -> str:
        return hashlib.sha256(canonical(self.normalised()).encode()).hexdigest()


def _within(value: Column, allowed: tuple | None) -> Column | None:
    if allowed is None:
        return None
    return F.coalesce(value.isin(*allowed), F.lit(False)) if allowed else F.lit(False)


def _touches(values: Column, allowed: tuple | None) -> Column | None:
    if allowed is None:
        return None
    return F.coalesce(F.arrays_overlap(values, F.array(*[F.lit(a) for a in allowed])), F.lit(False)) if allowed else F.lit(False)


def condition(q: EvidenceQuery) -> Column:
    """AND of the classes, OR inside each; enum filters hold for evidence only."""
    evidence = F.col("kind") == "evidence"
    out = F.lit(True)
    for name, allowed in (("stance", q.stances), ("quality", q.qualities), ("verification_status", q.verification_statuses)):
        if (c := _within(F.col(name), allowed)) is not None:
            out = out & evidence & c
    if q.minimum_confidence is not None:
        out = out & F.col("kind").isin("claims", "evidence") & F.coalesce(F.col("confidence") >= q.minimum_confidence, F.lit(False))
    for column, allowed in (("access_level", q.access_levels),):
        if (c := _within(F.col(column), allowed)) is not None:
            out = out & c
    for column, allowed in (("lineage", q.lineage_ids), ("owners", q.attempt_ids), ("tasks", q.task_ids), ("roles", q.roles)):
        if (c := _touches(F.col(column), allowed)) is not None:
            out = out & c
    return out


def kind_rank(kind: str = "kind") -> Column:
    return F.array_position(F.array(*[F.lit(k) for k in PAGE_KINDS]), F.col(kind)) - 1


def select_page(records: DataFrame, q: EvidenceQuery, after: tuple[int, object, int] | None = None) -> DataFrame:
    """Matching records after the cursor in the order (kind rank, id, revision), at most ``q.limit``.

    Tasks and roles can only be asked for if every record that the other filters leave has a task.
    """
    q.normalised()
    if q.task_ids or q.roles:
        if not {"tasks", "roles"} <= set(records.columns):
            raise GraphError("query.metadata-required")
        others = condition(replace(q, task_ids=None, roles=None))
        if not records.filter(others & (F.coalesce(F.size(F.array_compact("tasks")), F.lit(0)) == 0)).isEmpty():
            raise GraphError("query.metadata-required")
    out = records.filter(condition(q)).withColumn("kind_rank", kind_rank())
    if after is not None:
        rank, key, revision = after
        place = F.struct("kind_rank", "id", "revision")
        out = out.filter(place > F.struct(F.lit(rank).cast("long").alias("kind_rank"), F.lit(key).alias("id"), F.lit(revision).cast("long").alias("revision")))
    return out.orderBy("kind_rank", "id", "revision").limit(q.limit)


def by_refs(records: DataFrame, refs: DataFrame) -> DataFrame:
    """Records named by exact refs (kind, id, revision), each once; GraphError if one does not exist."""
    wanted = refs.select("kind", "id", "revision").distinct()
    place = F.struct(*[F.col(f"`{c}`") for c in records.columns]).alias("_record")
    found = cut(wanted.join(records.select("kind", "id", "revision", place), ["kind", "id", "revision"], "left").select("_record"))
    if not found.filter("_record is null").isEmpty():
        raise GraphError("query.unresolved-ref")
    return found.select("_record.*")


def owners(sources: DataFrame, requests: DataFrame, others: list[tuple[str, DataFrame, str]]) -> DataFrame:
    """Rows (kind, id, revision, owners): a source's are the attempts of its retrieval requests, others name theirs.

    ``sources``: id, revision, retrieval_request_ids; ``requests``: request_id, attempt_id; ``others``:
    (kind, rows of id and revision, the column of the attempt).
    """
    each = sources.select("id", "revision", F.explode_outer("retrieval_request_ids").alias("request_id"))
    found = each.join(requests.select("request_id", "attempt_id"), "request_id", "left").groupBy("id", "revision").agg(F.array_sort(F.collect_set("attempt_id")).alias("owners"))
    out = found.select(F.lit("sources").alias("kind"), "id", "revision", "owners")
    for kind, rows, attempt in others:
        out = out.unionByName(rows.select(F.lit(kind).alias("kind"), "id", "revision", F.array_compact(F.array(attempt)).alias("owners")))
    return out


def encode_cursor(snapshot: str, q: EvidenceQuery, place: tuple) -> str:
    body = {"place": list(place), "query": q.hash(), "snapshot": snapshot}
    text = canonical(body | {"checksum": hashlib.sha256(canonical(body).encode()).hexdigest()})
    return base64.urlsafe_b64encode(text.encode()).decode().rstrip("=")


def decode_cursor(cursor: str, snapshot: str, q: EvidenceQuery) -> tuple:
    import json

    try:
        body = json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))
        check = body.pop("checksum")
        place = tuple(body["place"])
    except (ValueError, KeyError, TypeError, AttributeError) as e:
        raise GraphError("query.cursor-invalid") from e
    if check != hashlib.sha256(canonical(body).encode()).hexdigest():
        raise GraphError("query.cursor-invalid")
    if body.get("query") != q.hash() or body.get("snapshot") != snapshot:
        raise GraphError("query.cursor-mismatch")
    return place


def greedy_closure(page: DataFrame, edges: DataFrame, nodes: DataFrame | Callable[[DataFrame], DataFrame], caps: dict[str, int] | None = None) -> tuple[DataFrame, DataFrame]:
    """Takes primaries in order with all they refer to, until one does not fit; it and the rest are left.

    ``page`` has (node, rank), rank from 0; ``edges`` (src, dst), repeats counted; ``nodes``
    (node, kind, bytes), or what makes them of the nodes that are reached.  A record is charged to the first primary that reaches it, so the
    marginal sums of the ranks, added up in order, equal the greedy walk's state, and the cut
    is the first rank whose running sum passes a cap.  Returns (selected records with rank,
    accepted primaries).
    """
    caps = CAPS | (caps or {})
    edges = stored(edges.select("src", "dst"))
    reach = reached(page, edges)
    few = small(reach)
    # only what is reached has its edges counted and its facts looked up
    fan = edges.join(few.select("node"), F.col("src") == F.col("node"), "left_semi").groupBy(F.col("src").alias("node")).agg(F.count("*").alias("fan"))
    full = few.join(nodes(reach.select("node")) if callable(nodes) else nodes, "node")
    full = cut(full.join(fan, "node", "left").withColumn("fan", F.coalesce("fan", F.lit(0))))
    marginal = full.groupBy("rank").agg(F.count("*").alias("records"), F.sum("fan").alias("edges"), F.sum("bytes").alias("bytes"))
    # A comma for each record but the first of its kind.
    opens = full.groupBy("kind").agg(F.min("rank").alias("rank")).groupBy("rank").agg(F.count("*").alias("opens"))
    each = page.select("rank").join(marginal, "rank", "left").join(opens, "rank", "left").na.fill(0)
    running = W.orderBy("rank").rowsBetween(W.unboundedPreceding, 0)  # at most one page of rows
    sums = each.select(
        "rank", F.sum("records").over(running).alias("records"), F.sum("edges").over(running).alias("edges"),
        (F.sum(F.col("bytes") + F.col("records") - F.col("opens")).over(running) + WRAPPER).alias("bytes"))
    over = sums.filter((F.col("records") > caps["records"]) | (F.col("edges") > caps["edges"]) | (F.col("bytes") > caps["bytes"]))
    stop = over.agg(F.min("rank")).first()[0]
    if stop == 0:
        raise GraphError("query.closure-too-large")
    kept = F.lit(True) if stop is None else F.col("rank") < stop
    return full.filter(kept), page.filter(kept)
