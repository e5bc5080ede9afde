"""Sharding by balanced label propagation (native DataFrame operators only).

Documents with equal texts are linked.  Every document starts with a label dealt in hash
order; in each round a linked document moves towards the shard where most of its
neighbours are, the largest gains first, by changing places with documents that want to go
the other way, or as far as that shard's quota allows.  Copies of one text under one label are interchangeable, so the joins of a round work on cells
(group, label, count) rather than documents: a group of any size has at most one cell per
shard.  Unlinked documents cut no edge wherever they are, so they fill each shard to its
exact size at the end.  The law is ``rows``: shard sizes differ by at most one row,
whatever the links are; a group larger than a shard is cut into as few as hold it.

Defined results: null texts have size 16, crc 0 and no links; empty texts are equal texts;
repeated rows (also of one doc_id) are rows of their own; null doc_ids are placed like
others; an empty table gives no rows; other columns are carried only by ``keep``.
"""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.llm.common import BROADCAST_ROWS, bucket_of, durable, fresh, pick, rank_all, rank_buckets, rank_within, row_key

OVERHEAD = 16  # bytes that each row counts besides its text
GAIN_CLASSES, HASH_CLASSES = 32, 16


def _wishes(cells: DataFrame, cap: int, turn: int) -> DataFrame:
    """Moves (gid, label, cnt, target, gain): every cell wants to join one of its group's homes.

    A group's homes are its largest cells, as many as shards of ``cap`` rows hold it.  Ties go
    by a hash that changes from round to round, so that between two shards about as many
    rows want to go one way as the other.
    """
    order = [F.desc("cnt"), F.xxhash64("gid", "label", F.lit(turn)), F.asc("label")]
    by = W.partitionBy("gid")
    seen = cells.withColumn("rank", F.row_number().over(by.orderBy(*order))).withColumn("total", F.sum("cnt").over(by))
    home = F.col("rank") <= F.ceil(F.col("total") / cap)
    homes = seen.filter(home).groupBy("gid").agg(F.array_sort(F.collect_list(F.struct("rank", "label", "cnt"))).alias("homes"))
    wish = seen.filter(~home).join(homes, "gid").withColumn("to", F.expr("element_at(homes, cast(pmod(rank, size(homes)) as int) + 1)"))
    return wish.select("gid", "label", "cnt", F.col("to.label").alias("target"), (F.col("to.cnt") - F.col("cnt")).alias("gain"))


def _admit(moves: DataFrame, keys: list[str], quotas: DataFrame) -> DataFrame:
    """Splits ``moves`` into ``moved`` and the rest of ``cnt``: of each of ``keys``, the largest gains first up to its ``quota``.

    Prefix sums in two levels: classes of like gain, and rows inside a class.
    """
    level = F.least(F.floor(F.log2(F.col("gain") + 1)), F.lit(GAIN_CLASSES - 1))
    moves = durable(moves.withColumn("class", ((GAIN_CLASSES - 1 - level) * HASH_CLASSES + F.pmod(F.xxhash64("gid"), F.lit(HASH_CLASSES))).cast("int")))
    sums = moves.groupBy(*keys, "class").agg(F.sum("cnt").alias("n"))
    before = W.partitionBy(*keys).orderBy("class").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(*keys, "class", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")).join(quotas, keys)
    inside = W.partitionBy(*keys, "class").orderBy(F.desc("gain"), "gid", "label").rowsBetween(W.unboundedPreceding, -1)
    ranked = moves.withColumn("inner", F.coalesce(F.sum("cnt").over(inside), F.lit(0)))
    left = F.col("quota") - F.col("before") - F.col("inner")
    return ranked.join(sums, [*keys, "class"]).withColumn("moved", F.greatest(F.lit(0), F.least(F.col("cnt"), left)).cast("long")).drop("class", "before", "inner", "quota")


def propagate(cells: DataFrame, caps: list[int], most_rounds: int = 40) -> DataFrame:
    """Balanced label propagation over cells (gid, label, cnt); no shard ever exceeds its cap.

    In each round, rows that want to go from s to t change places with as many that want to
    go from t to s, which needs no room; what is left goes where a shard has room.  It ends
    when nothing wants to move, when two rounds have moved nothing, or after ``most_rounds``,
    with a warning.
    """
    cells, still = durable(cells), 0
    for turn in range(most_rounds):
        moves = durable(_wishes(cells, max(1, max(caps)), turn))
        if moves.isEmpty():
            return cells
        flow = moves.groupBy("label", "target").agg(F.sum("cnt").alias("n"))
        back = flow.select(F.col("target").alias("label"), F.col("label").alias("target"), F.col("n").alias("m"))
        swap = flow.join(back, ["label", "target"], "left").select("label", "target", F.least("n", F.coalesce("m", F.lit(0))).alias("quota"))
        swapped = durable(_admit(moves, ["label", "target"], swap))
        now = {r["label"]: r["n"] for r in cells.groupBy("label").agg(F.sum("cnt").alias("n")).collect()}
        room = [int(c - now.get(s, 0)) for s, c in enumerate(caps)]
        rest = swapped.filter("moved < cnt").select("gid", "label", (F.col("cnt") - F.col("moved")).alias("cnt"), "target", "gain")
        roomy = cells.sparkSession.range(len(room)).select(F.col("id").cast("int").alias("target"), pick(room, F.col("id")).cast("long").alias("quota")).filter("quota > 0")
        done = swapped.select("gid", "label", "target", "moved")
        if any(n > 0 for n in room):
            done = done.unionByName(_admit(rest, ["target"], roomy).select("gid", "label", "target", "moved"))
        done = durable(done.filter("moved > 0"))
        if done.isEmpty():
            still += 1
            if still == 2:
                return cells
            continue
        still = 0
        change = done.select("gid", F.explode(F.array(
            F.struct(F.col("target").alias("label"), F.col("moved").alias("cnt")),
            F.struct(F.col("label").alias("label"), (-F.col("moved")).alias("cnt")))).alias("c")).select("gid", "c.label", "c.cnt")
        cells = durable(cells.unionByName(change).groupBy("gid", "label").agg(F.sum("cnt").alias("cnt")).filter("cnt > 0"))
    warnings.warn(f"propagation had not settled after {most_rounds} rounds", stacklevel=2)
    return cells


def assign_shards(docs: DataFrame, n_shards: int, keep: tuple[str, ...] = (), place: str | None = None) -> DataFrame:
    """Rows (doc_id, size, text_crc32, shard, slot, group_rows, *keep), one for each row of ``docs``.

    ``place``, one of ``keep``, is a column of places 0, 1, ... that takes the part of the hash
    order: slots follow it, and so do the shards of unlinked documents, one stretch each.
    """
    if clash := set(keep) & {"doc_id", "size", "text_crc32", "gid", "bucket", "group_rows", "shard", "slot", "label", "at", "places"}:
        raise ValueError(f"rename these columns first: {sorted(clash)}")
    text = F.coalesce("text", F.lit(""))
    total = docs.count()
    buckets = rank_buckets(total)
    bucket = bucket_of("doc_id", buckets=buckets)
    if place:
        places = (docs.agg(F.max(place)).first()[0] or 0) + 1
        bucket = F.floor(F.col(place) * buckets / places).cast("int")
    base = durable(docs.select(
        "doc_id", (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text).cast("long").alias("text_crc32"),
        F.unhex(F.md5("text")).alias("gid"), bucket.alias("bucket"), *keep))
    # Aggregates are stored before they are joined, so that a large group's join can be split.
    groups = durable(base.filter("gid is not null").groupBy("gid").agg(F.count("*").alias("group_rows")).filter("group_rows > 1"))
    base = durable(base.join(groups, "gid", "left"))
    linked = base.filter("group_rows is not null")
    caps = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]

    order = [F.col(place)] if place else [F.col("doc_id"), F.col("gid")]
    linked = durable(rank_all(linked, "bucket", order, "at").withColumn("label", F.pmod("at", F.lit(n_shards)).cast("int")).drop("at"))
    cells = propagate(linked.groupBy("gid", "label").agg(F.count("*").alias("cnt")), caps)
    used = {r["label"]: r["n"] for r in cells.groupBy("label").agg(F.sum("cnt").alias("n")).collect()}

    places = durable(cells.groupBy("gid").agg(F.array_sort(F.collect_list(F.struct("label", "cnt"))).alias("places")))
    placed = durable(linked.drop("label").join(places, "gid"))
    whole = placed.filter("size(places) = 1").withColumn("shard", F.expr("places[0].label"))
    cut = rank_within(placed.filter("size(places) > 1"), ["gid"], "bucket", [F.col("doc_id")], "at", few_keys=False)
    walk = "aggregate(places, named_struct('left', at, 'shard', -1), (a, p) -> named_struct('left', a.left - p.cnt, 'shard', if(a.shard < 0 and a.left < p.cnt, p.label, a.shard)), a -> a.shard)"
    cut = cut.withColumn("shard", F.expr(walk)).drop("at")

    alone = rank_all(base.filter("group_rows is null"), "bucket", order, "at")
    ends, end = [], 0
    for s, c in enumerate(caps):
        end += c - used.get(s, 0)
        ends.append(end)
    alone = alone.withColumn("shard", F.size(F.filter(F.array(*[F.lit(int(e)) for e in ends]), lambda e: e <= F.col("at")))).drop("at")

    columns = ["doc_id", "size", "text_crc32", "gid", "bucket", "group_rows", "shard", *keep]
    out = durable(whole.select(columns).unionByName(cut.select(columns)).unionByName(alone.select(columns)))
    out = rank_within(out, ["shard"], "bucket", order, "slot", few_keys=n_shards * buckets <= BROADCAST_ROWS)
    return out.select("doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), "slot", "group_rows", *keep)


def sharded(docs: DataFrame, n_shards: int, place: str | None = None) -> DataFrame:
    """All rows and columns of ``docs`` with shard and slot, which replace columns of these names."""
    row = fresh("row", docs.columns)
    docs = docs.drop("shard", "slot")
    keyed = docs.withColumn(row, row_key(docs))
    told = keyed.select("doc_id", "text", row, *([F.col(place).alias("row_place")] if place else []))
    places = assign_shards(told.withColumnRenamed(row, "row_hash"), n_shards, ("row_hash", "row_place") if place else ("row_hash",), "row_place" if place else None)
    places = durable(places.select("doc_id", "row_hash", "shard", "slot"))
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col(f"a.{row}") == F.col("b.row_hash"))
    if not places.groupBy("doc_id", "row_hash").count().filter("count > 1").isEmpty():
        keyed = keyed.dropDuplicates(["doc_id", row])  # equal rows are interchangeable: one meets all their places
    return keyed.alias("a").join(places.alias("b"), same).select(*[F.col(f"a.`{c}`") for c in docs.columns], "b.shard", "b.slot")
