"""Helpers shared by the operators: tables, durable cut points, exact distributed ranks, components."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.plans.cut import cut

#: Buckets, at least, into which an exact rank is split, so that no task holds all rows of one key.
RANK_BUCKETS = 256
#: Rows of a bucket from which there are more buckets, and buckets at most; their counts come to the driver.
BUCKET_ROWS, MOST_BUCKETS = 1 << 20, 1 << 15
BROADCAST_ROWS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A reliable checkpoint in the folder that all executors share.
durable = cut


def rank_buckets(rows: int) -> int:
    """Buckets for an exact rank over so many rows."""
    return min(MOST_BUCKETS, max(RANK_BUCKETS, rows // BUCKET_ROWS))


def bucket_of(*cols: Column, buckets: int = RANK_BUCKETS) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(buckets)).cast("int")


def fresh(name: str, taken: list[str]) -> str:
    """``name``, with underscores in front until no column (in any case) has it."""
    known = {c.lower() for c in taken}
    while name.lower() in known:
        name = f"_{name}"
    return name


def row_key(docs: DataFrame) -> Column:
    """Hash of a whole row; what Spark does not hash (maps, variants) goes in as JSON."""
    plain = [F.col(f"`{f.name}`") if "map<" not in (kind := f.dataType.simpleString()) and "variant" not in kind else F.to_json(F.struct(F.col(f"`{f.name}`"))) for f in docs.schema]
    return F.xxhash64(*plain)


def pick(cases: list, index: Column) -> Column:
    """The literal ``cases[index]``; for short driver-side lists only."""
    return F.element_at(F.array(*[F.lit(c) for c in cases]), index.cast("int") + 1)


def hash_sample(df: DataFrame, key: str, rows: int, total: int) -> DataFrame:
    """At most ``rows`` rows, those of the smallest key hashes; ``total`` is about the number of rows.

    A cut at the expected share of hashes comes first: a top-k alone would send ``rows`` rows
    of every task to the driver.
    """
    share = 1.25 * rows / max(1, total)
    h = F.xxhash64(key)
    some = df if share >= 1 else df.filter(F.shiftrightunsigned(h, 11) < F.lit(int(share * 2**53)))
    return some.orderBy(h, key).limit(rows)


def bucket_offsets(df: DataFrame, bucket: str) -> list[int]:
    """Rows before each bucket; collects at most ``MOST_BUCKETS`` rows."""
    counts = {r[0]: r[1] for r in df.groupBy(bucket).count().collect()}
    buckets = max(counts, default=0) + 1
    out, seen = [], 0
    for b in range(buckets):
        out.append(seen)
        seen += counts.get(b, 0)
    return out


def rank_all(df: DataFrame, bucket: str, order: list[Column], out: str) -> DataFrame:
    """Exact 0-based rank over all rows in (bucket, order); each bucket is numbered apart."""
    offsets = bucket_offsets(df, bucket)
    rank = F.row_number().over(W.partitionBy(bucket).orderBy(*order)) - 1
    return df.withColumn(out, (rank + pick([int(x) for x in offsets], F.col(bucket))).cast("long"))


def rank_within(df: DataFrame, keys: list[str], bucket: str, order: list[Column], out: str, few_keys: bool) -> DataFrame:
    """Exact 0-based rank within ``keys``, in (bucket, order), without one task per key.

    A hot key is numbered in its buckets side by side; bucket offsets come from a
    pre-aggregated count.  ``few_keys`` states that keys x buckets is at most
    ``BROADCAST_ROWS``, so that the offsets may be broadcast; otherwise they are joined by a
    shuffle.  ``df`` is read twice: pass a durable one.
    """
    by = W.partitionBy(*keys).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    offsets = df.groupBy(*keys, bucket).count().select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate([*keys, bucket])],
        F.coalesce(F.sum("count").over(by), F.lit(0)).alias("_before"),
    )
    if few_keys:
        offsets = F.broadcast(offsets)
    ranked = df.withColumn("_rank", F.row_number().over(W.partitionBy(*keys, bucket).orderBy(*order)) - 1)
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate([*keys, bucket])])
    return (
        ranked.join(offsets, same)
        .withColumn(out, (F.col("_rank") + F.col("_before")).cast("long"))
        .drop("_rank", "_before", *[f"_k{i}" for i in range(len(keys) + 1)])
    )


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges`` (a, b: long): rows (node, root), root the smallest node.

    The roots themselves have no row.

    Alternating large-star and small-star rounds, which keep the number of edges and end
    after a logarithmic number of rounds, also on long chains.  Each round's edges are
    durable; only one count and one sum come to the driver.
    """
    one = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    one = durable(one)
    before = None
    for _ in range(most_rounds):
        both = one.select("u", "v").unionByName(one.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")))).alias("e"))
        one = durable(small.select("e.u", "e.v").filter("u <> v").distinct())
        now = one.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return one.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
