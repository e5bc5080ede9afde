"""Mixing sources to target weights by Pfair scheduling (native DataFrame operators only).

A source is cut into blocks of ``block_rows`` documents in hash order.  Target weights are
integer parts; a frame has as many slots as the active parts sum to.  Block j of a source
with q of T parts is released at slot floor(jT/q) of its frame and due by slot
ceil((j+1)T/q); each slot goes to the released block with the earliest deadline (ties to
the smaller source index).  As the parts fill the frame exactly, every block meets its
window, so at each slot every source is less than one block away from its share.  All full
frames of a phase are alike, so one frame is scheduled per phase, as one SQL aggregate,
and a block's slot follows by arithmetic: no task walks the whole sequence.  When a source
runs dry, the others go on with the same parts in a new phase: every document is placed
once, none is repeated or dropped.

Bound: the plan has at most ``MAX_SOURCES`` parts, and so at most two phases a part.  Of more
sources, the smallest share one part, with the sum of their parts, in hash order.  Parts are
divided by their greatest common divisor; a frame of over ``MAX_FRAME`` slots is an error.  The
table that is broadcast has two rows a phase and part, with at most a frame of slots each.

Defined results: null sources are one source of their own; ties and repeated rows of a
doc_id are rows of their own; texts are not read; an empty table gives no rows; other
columns are carried only by ``keep``.
"""

from __future__ import annotations

import json
import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import BROADCAST_ROWS, bucket_of, durable, fresh, rank_buckets, rank_within, row_key

MAX_SOURCES = 256
MAX_FRAME = 1 << 16
REST = "rest"  # the part of the smallest of too many sources; no key of a source
CHUNK = 256  # slots that are appended at once
BLOCK_ROWS = 8
LEAST_PARTS = 100


def source_key(col: str = "source") -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(col)), F.lit("null"))


def tempered_parts(counts: Mapping[str, int], power: float = 0.5) -> dict[str, int]:
    """Integer parts proportional to count^power, one at least: the usual tempered mixture."""
    weights = {s: float(n) ** power for s, n in sorted(counts.items())}
    parts, total = max(LEAST_PARTS, 4 * len(weights)), sum(weights.values())
    return {s: max(1, round(parts * w / total)) for s, w in weights.items()}


#: One frame by earliest deadline first: array of the source index of each slot.  Slots are
#: gathered in chunks, since each step copies what it appends to.
EDF = f"""
aggregate(
  sequence(0, cast(t as int) - 1, {CHUNK}),
  named_struct('done', transform(quota, q -> 0L), 'slots', cast(array() as array<array<int>>)),
  (whole, start) -> element_at(transform(array(aggregate(
    sequence(start, cast(least(start + {CHUNK}, t) as int) - 1),
    named_struct('done', whole.done, 'slots', cast(array() as array<int>)),
    (a, slot) -> element_at(transform(array(
      array_min(transform(
        filter(transform(quota, (q, i) -> named_struct('i', i, 'q', q, 'j', element_at(a.done, i + 1))),
               x -> x.j < x.q and (x.j * t) div x.q <= slot),
        x -> named_struct('due', ((x.j + 1) * t + x.q - 1) div x.q, 'i', x.i)))),
      best -> named_struct(
        'done', transform(a.done, (n, i) -> if(i = best.i, n + 1L, n)),
        'slots', concat(a.slots, array(best.i)))), 1))),
    part -> named_struct('done', part.done, 'slots', concat(whole.slots, array(part.slots)))), 1),
  whole -> flatten(whole.slots))
"""


def frame_slots(spark: SparkSession, quota: list[int]) -> list[int]:
    """The source index of each slot of one frame; as many values as the quotas sum to."""
    row = spark.range(1).select(F.array(*[F.lit(int(q)).cast("long") for q in quota]).alias("quota"), F.lit(sum(quota)).cast("long").alias("t"))
    return row.select(F.expr(EDF)).first()[0]


def phases(spark: SparkSession, blocks: list[int], parts: list[int]) -> list[dict]:
    """Phases (slots, frames, slot, first): the schedule of a frame, how often it runs, first slot, first block by source.

    A phase of full frames lasts while every source has its parts; then the frame runs once
    more up to the slot where a source has given its last block, and the others go on alone.
    """
    left, first, slot, out = list(blocks), [0] * len(blocks), 0, []
    while any(left):
        quota = [q if n else 0 for q, n in zip(parts, left, strict=True)]
        slots = frame_slots(spark, quota)
        frames = min(n // q for q, n in zip(quota, left, strict=True) if q)
        runs = [(slots, frames)] if frames else []
        rest = [n - frames * q for q, n in zip(quota, left, strict=True)]
        if all(n for q, n in zip(quota, rest, strict=True) if q):
            head, some = [], list(rest)
            for i in slots:
                head.append(i)
                some[i] -= 1
                if not some[i]:
                    break
            runs.append((head, 1))
        for order, times in runs:
            out.append({"slots": order, "frames": times, "slot": slot, "first": list(first)})
            slot += times * len(order)
            for i in order:
                first[i] += times
                left[i] -= times
    return out


def pfair_mix(docs: DataFrame, parts: Mapping[str, int] | None = None, block_rows: int = BLOCK_ROWS, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows (doc_id, source, block, phase, slot, pos, *keep): ``pos`` is the gapless place in the mix.

    ``parts`` has the integer parts by source name (the key of ``source_key``); sources
    without an entry get one part.  None: parts from ``tempered_parts``.
    """
    if clash := set(keep) & {"doc_id", "source", "part", "bucket", "nth", "block", "inside", "runs", "run", "j", "phase", "slot", "pos"}:
        raise ValueError(f"rename these columns first: {sorted(clash)}")
    spark = docs.sparkSession
    buckets = rank_buckets(docs.count())
    rows = durable(docs.select("doc_id", "source", source_key().alias("part"), bucket_of("doc_id", buckets=buckets).alias("bucket"), *keep))
    sizes = durable(rows.groupBy("part").count())
    found = sizes.orderBy(F.desc("count"), "part").limit(MAX_SOURCES + 1).collect()
    wanted = None if parts is None else {s: max(1, int(q)) for s, q in parts.items()}
    if len(found) > MAX_SOURCES:
        own = [r["part"] for r in found[: MAX_SOURCES - 1]]
        rest = sizes.filter(~F.col("part").isin(own))
        if wanted is not None:
            asked = F.from_json(F.lit(json.dumps(wanted)), "map<string, bigint>")
            wanted[REST] = rest.agg(F.sum(F.coalesce(F.element_at(asked, F.col("part")), F.lit(1)))).first()[0]
        pooled = rest.agg(F.sum("count")).first()[0]
        found = [*[(r["part"], r["count"]) for r in found[: MAX_SOURCES - 1]], (REST, pooled)]
        rows = rows.withColumn("part", F.when(F.col("part").isin(own), F.col("part")).otherwise(REST))
    counts = {name: n for name, n in sorted(map(tuple, found))}
    names = list(counts)
    share = tempered_parts(counts) if wanted is None else {s: wanted.get(s, 1) for s in names}
    common = math.gcd(*share.values()) or 1
    share = {s: q // common for s, q in share.items()}
    if sum(share.values()) > MAX_FRAME:
        raise ValueError(f"the parts sum to more than {MAX_FRAME}: take coarser ones")
    blocks = [-(-counts[s] // block_rows) for s in names]
    plan = phases(spark, blocks, [share[s] for s in names])

    schema = "array<struct<phase: int, slots: array<int>, frames: bigint, first_slot: bigint, first: array<bigint>>>"
    lines = [{"phase": p, "slots": x["slots"], "frames": x["frames"], "first_slot": x["slot"], "first": x["first"]} for p, x in enumerate(plan)]
    framed = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(lines)), schema)))
    each = framed.select("phase", F.size("slots").cast("long").alias("t"), "first_slot", "frames", "first", F.posexplode("slots").alias("at", "i"))
    each = each.groupBy("phase", "i", "t", "first_slot", "frames", "first").agg(F.array_sort(F.collect_list("at")).alias("ats"))
    each = each.select(
        (F.element_at(F.array(*[F.lit(n) for n in names]), F.col("i") + 1) if names else F.lit("")).alias("part"),
        F.struct(F.element_at("first", F.col("i") + 1).alias("first"), F.size("ats").cast("long").alias("q"), "frames", "t", "first_slot", "phase", "ats").alias("run"))
    each = F.broadcast(each.groupBy("part").agg(F.array_sort(F.collect_list("run")).alias("runs")))

    ranked = rank_within(rows, ["part"], "bucket", [F.col("doc_id"), *[F.col(k) for k in keep]], "nth", few_keys=len(names) * buckets <= BROADCAST_ROWS)
    ranked = ranked.withColumn("block", F.floor(F.col("nth") / block_rows)).withColumn("inside", F.pmod("nth", F.lit(block_rows)))
    run = F.expr("filter(runs, r -> r.first <= block and block < r.first + r.frames * r.q)[0]")
    placed = ranked.join(each, "part").withColumn("run", run).withColumn("j", F.col("block") - F.expr("run.first"))
    slot = F.expr("run.first_slot + (j div run.q) * run.t + run.ats[cast(j % run.q as int)]")
    placed = placed.select("doc_id", "source", "part", "block", "inside", F.expr("run.phase").alias("phase"), slot.cast("long").alias("slot"), *keep)

    # A source's last block may be short: at most one a source.
    short = {s: blocks[i] * block_rows - counts[s] for i, s in enumerate(names) if counts[s] % block_rows}
    placed = durable(placed)
    ends = placed.groupBy("part").agg(F.max_by("slot", "block").alias("slot")).collect() if short else []
    gaps = sorted((r["slot"], short[r["part"]]) for r in ends if r["part"] in short)
    lost = F.lit(0)
    if gaps:
        listed = F.array(*[F.struct(F.lit(int(a)).alias("slot"), F.lit(int(n)).alias("n")) for a, n in gaps])
        lost = F.aggregate(F.filter(listed, lambda g: g["slot"] < F.col("slot")), F.lit(0), lambda a, g: a + g["n"])
    pos = F.col("slot") * block_rows + F.col("inside") - lost
    return placed.select("doc_id", "source", F.col("block").cast("long").alias("block"), "phase", "slot", pos.cast("long").alias("pos"), *keep)


def mixed(docs: DataFrame, parts: Mapping[str, int] | None = None, block_rows: int = BLOCK_ROWS, place: str | None = None) -> DataFrame:
    """All rows and columns of ``docs``, range-partitioned and sorted in the order of the mix; column ``place`` holds it and replaces one of this name."""
    docs = docs.drop(place) if place else docs
    row = fresh("row", docs.columns)
    keyed = docs.withColumn(row, row_key(docs))
    told = keyed.select("doc_id", "source", F.col(row).alias("row_hash"))
    places = durable(pfair_mix(told, parts, block_rows, keep=("row_hash",)).select("doc_id", "row_hash", "pos"))
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col(f"a.{row}") == F.col("b.row_hash"))
    if not places.groupBy("doc_id", "row_hash").count().filter("count > 1").isEmpty():
        # Equal rows are interchangeable: one of them meets all their places.
        keyed = keyed.dropDuplicates(["doc_id", row])
    at = place or fresh("pos", docs.columns)
    joined = keyed.alias("a").join(places.alias("b"), same).select(*[F.col(f"a.`{c}`") for c in docs.columns], F.col("b.pos").alias(at))
    ordered = joined.repartitionByRange(at).sortWithinPartitions(at)
    return ordered if place else ordered.drop(at)
