"""Transaction directories: six canonical JSONL files and a manifest; scan, checks, and a two-phase sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.canonical import canonical_json
from tessera.operators.records import KINDS
from tessera.sources.transaction_sink import TransactionSink, deal


def scan(spark: SparkSession, root: str, kind: str) -> DataFrame:
    """Rows (transaction_id, raw) of one record kind over all committed transactions."""
    raw = spark.read.text(f"{root}/*/{kind}.jsonl", lineSep="\n")
    return raw.select(F.regexp_extract("_metadata.file_path", r"([^/]+)/[^/]+$", 1).alias("transaction_id"), F.col("value").alias("raw"))


def manifests(spark: SparkSession, root: str) -> DataFrame:
    raw = spark.read.text(f"{root}/*/manifest.json")
    files = "files array<struct<kind: string, recordCount: bigint, decodedBytes: bigint, sha256: string>>"
    got = raw.select(F.regexp_extract("_metadata.file_path", r"([^/]+)/[^/]+$", 1).alias("transaction_id"), F.from_json("value", f"transactionId string, attemptId string, sourceResultSeq bigint, {files}").alias("m"))
    return got.select("transaction_id", "m.*")


#: Caps of a line and of a transaction's file.
MOST_LINE, MOST_FILE = 4 << 20, 64 << 20


def issues(spark: SparkSession, root: str) -> DataFrame:
    """Rows (transaction_id, kind, code, detail) where a folder differs from its manifest or from the layout.

    A folder holds the six kinds' files and the manifest and no more; each file has the counts,
    bytes and digest that the manifest states, and canonical lines: else it is corrupt, and
    ``detail`` says how.  Files are bounded by contract, so a digest reads one file as one row.
    Spark does not list empty files: one that the manifest gives as empty may as well be missing.
    """
    name, folder = F.regexp_extract("path", r"([^/]+)$", 1), F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("transaction_id")
    wanted = F.array(*[F.lit(f) for f in sorted([*(f"{k}.jsonl" for k in KINDS), "manifest.json"])])
    listed = spark.read.format("binaryFile").load(f"{root}/*/*").select(folder, name.alias("name"), "length")
    layout = listed.groupBy("transaction_id").agg(F.array_sort(F.collect_set("name")).alias("names"), F.max("length").alias("most"))
    odd = (F.size(F.array_except("names", wanted)) > 0) | ~F.array_contains("names", "manifest.json")
    layout = layout.withColumn("detail", F.when(odd, "files").when(F.col("most") > MOST_FILE, "size")).filter("detail is not null")
    code = lambda: F.when(F.col("detail") == "size", "transaction.file-too-large").otherwise("transaction.corrupt").alias("code")
    found = layout.select("transaction_id", F.lit(None).cast("string").alias("kind"), code(), "detail")
    told_all = manifests(spark, root).select("transaction_id", F.explode("files").alias("f"))
    for kind in KINDS:
        rows = scan(spark, root, kind)
        facts = rows.groupBy("transaction_id").agg(
            F.count("*").alias("n"), F.sum(F.octet_length("raw") + 1).alias("b"), F.max(F.octet_length("raw")).alias("longest"),
            F.count_if(F.coalesce((canonical_json("raw") != F.col("raw")) | ~F.col("raw").startswith("{"), F.lit(True))).alias("odd"))
        files = spark.read.format("binaryFile").load(f"{root}/*/{kind}.jsonl").filter(F.col("length") <= MOST_FILE)
        digests = files.select(folder, F.sha2("content", 256).alias("digest"))
        both = told_all.filter(F.col("f.kind") == kind).join(facts, "transaction_id", "left").join(digests, "transaction_id", "left").na.fill(0, ["n", "b", "odd", "longest"])
        detail = (
            F.when(F.col("longest") + 1 > MOST_LINE, "line").when(F.col("n") != F.col("f.recordCount"), "count")
            .when(F.col("b") != F.col("f.decodedBytes"), "bytes").when(F.col("odd") > 0, "canonical")
            .when(F.coalesce("digest", F.sha2(F.lit(""), 256)) != F.col("f.sha256"), "digest"))
        part = both.withColumn("detail", detail).filter("detail is not null").select("transaction_id", F.lit(kind).alias("kind"), code(), "detail")
        found = found.unionByName(part)
    return found


def write(rows: DataFrame, root: str) -> None:
    """Commits rows (transaction_id, attempt_id, result_seq, kind, raw) as one folder a transaction, all or, on a conflict, none."""
    rows.sparkSession.dataSource.register(TransactionSink)
    deal(rows).write.format(TransactionSink.name()).option("path", root).mode("append").save()


def write_stream(rows: DataFrame, root: str):
    """A writer that commits the transactions of each micro-batch; one must not be spread over batches."""
    rows.sparkSession.dataSource.register(TransactionSink)
    return deal(rows).writeStream.format(TransactionSink.name()).option("path", root)
