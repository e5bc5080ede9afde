"""SimHash near-duplicates by multi-index hashing.

A text, A-Z lower-cased, is cut at ASCII white space into words; each run of ``shingle``
words, joined by single spaces, repeats included, is hashed with XXH64 (seed 42).  A bit of
the 64-bit fingerprint is set if it is set in over half the hashes.  Fewer words make one
shingle; no words make fingerprint zero.

Two fingerprints within ``radius`` bits agree in at least one of ``segments`` segments up to
a small Hamming ball: with radius = q * segments + r, up to q bits in one of the first r + 1
segments or up to q - 1 bits in one of the others.  Every distinct fingerprint is stored
once a segment and probes each segment's ball; full distances of what meets are verified,
and the links' connected components are the groups.  Equal fingerprints are one node, so
copies are never paired.

Defined results: null and empty texts have fingerprint zero, linked like any other; repeated
rows stay rows; a null doc_id takes part but names no component unless all its members are
null; an empty table gives no rows; other columns are carried only by ``keep``.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import ngram_join
from tessera.llm.common import components, durable, fresh

SEED = 42
CHUNK = 1 << 15  # shingles whose bits are counted at once
CROWDED = 16


def shingle_hashes(text: str | bytes | None, width: int) -> np.ndarray:
    words = (text if isinstance(text, bytes) else (text or "").encode("utf-8", "surrogatepass")).lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)
    return np.array([digest(joined[a:b], SEED) for a, b in spans], np.uint64)


def fold(hashes: np.ndarray) -> int:
    """The fingerprint of the hashes, as a signed 64-bit number."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = hashes[at : at + CHUNK]
        bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows (doc_id, fp, *keep)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fold(shingle_hashes(t.as_py(), shingle)) for t in batch.column("text")]
            rest = [batch.column(c) for c in ("doc_id", *keep)]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(fps, pa.int64())], ["doc_id", *keep, "fp"])

    need = docs.select("doc_id", *keep, "text")
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in need.schema if f.name != "text")
    return need.mapInArrow(run, f"{kept}, fp bigint")


def balls(bits: int, radius: int) -> list[int]:
    return [sum(1 << b for b in chosen) for r in range(radius + 1) for chosen in combinations(range(bits), r)]


def _segments(segments: int, radius: int) -> list[tuple[int, int, int]]:
    """(shift, bits, ball radius) of each segment; a negative radius means no probe is needed."""
    q, r = divmod(radius, segments)
    widths = [64 // segments + (i < 64 % segments) for i in range(segments)][::-1]
    return [(sum(widths[:i]), w, q if i <= r else q - 1) for i, w in enumerate(widths)]


def segments_for(fingerprints: int) -> int:
    """Three segments of at least 21 bits, or two once a value of these has over CROWDED fingerprints.

    The links are the same for either; longer segments have larger balls, shorter ones more
    fingerprints to a value.
    """
    return 3 if fingerprints <= CROWDED << 21 else 2


def links(fps: DataFrame, radius: int = 4, segments: int | None = None) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints at most ``radius`` bits apart; ``fps`` has distinct ``fp``."""
    segments = segments or segments_for(fps.count())
    stored, probes = [], []
    for i, (shift, bits, ball) in enumerate(_segments(segments, radius)):
        if ball < 0:
            continue
        part: Column = F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << bits) - 1)).bitwiseOR(F.lit(i << 56))
        stored.append(part)
        probes.append(F.array(*[part.bitwiseXOR(F.lit(m).cast("long")) for m in balls(bits, ball)]))
    left = fps.select(F.explode(F.array(*stored)).alias("key"), F.col("fp").alias("b"))
    right = fps.select(F.explode(F.concat(*probes)).alias("key"), F.col("fp").alias("a"))
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)
    return right.join(left, ["key"]).filter(near).select("a", "b").distinct()


def groups(prints: DataFrame, radius: int = 4, segments: int | None = None) -> DataFrame:
    """Adds component_id, the smallest doc_id reachable over links, to rows (doc_id, fp, ...)."""
    prints = durable(prints)
    nodes = durable(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(nodes.select("fp"), radius, segments))
    named = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    named = durable(named)
    least = durable(named.groupBy("root").agg(F.min("least").alias("component_id")))  # stored, so that a large group's join can be split
    return prints.join(named.select("fp", "root").join(least, "root").select("fp", "component_id"), "fp")


# Near copies by exact similarity: shared shingles and fingerprints propose, shingle sets decide.
LEVEL_BITS, BLOCK_BITS = 24, 14  # of a shingle's hash: how common it is; places of one block of levels
COUNTED = 1 << 15  # shingles that are counted at once
BLOCKS = 64  # blocks of counts that leave a task at once
ROWS = 1 << 10  # texts whose sets are held at once
CELLS = 1024  # parities that reject what meets


def _crowding(docs: DataFrame, shingle: int) -> np.ndarray:
    """How common a shingle is, by its first LEVEL_BITS bits: a level of the number of texts, over all texts.

    Every shingle of every text is counted, and what has the same first bits counts together, so
    none is taken for rarer than it is; whatever the levels are, they give one order for all
    texts.  A task's counts leave it in packed blocks; the driver gets one byte a value of the bits.
    """

    def packed(counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        blocks = counts.reshape(-1, 1 << BLOCK_BITS)
        for at in range(0, len(blocks), BLOCKS):
            told = [b for b in range(at, min(len(blocks), at + BLOCKS)) if blocks[b].any()]
            yield pa.RecordBatch.from_arrays([pa.array(told, pa.int64()), pa.array([zlib.compress(blocks[b].tobytes(), 1) for b in told], pa.binary())], ["block", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, most = np.zeros(1 << LEVEL_BITS, np.uint16), np.iinfo(np.uint16).max
        for batch in batches:
            held, size = [], 0
            for i, t in enumerate(batch.column("text")):
                held.append(np.unique(shingle_hashes(t.as_py(), shingle)) >> np.uint64(64 - LEVEL_BITS))
                size += len(held[-1])
                if size >= COUNTED or i == len(batch) - 1:
                    keys, n = np.unique(np.concatenate(held).astype(np.int64), return_counts=True)
                    if len(keys) and (counts[keys] + n).max() > most:
                        yield from packed(counts)
                        counts[:] = 0
                    counts[keys] += n.astype(np.uint16)
                    held, size = [], 0
        yield from packed(counts)

    def block(t: pa.Table) -> pa.Table:
        n = np.zeros(1 << BLOCK_BITS, np.int64)
        for part in t.column("counts"):
            n += np.frombuffer(zlib.decompress(part.as_py()), np.uint16)
        levels = np.minimum(255, np.ceil(8 * np.log2(np.maximum(n, 1)))).astype(np.uint8)
        return pa.table({"block": t.column("block")[:1], "levels": pa.array([levels.tobytes()], pa.binary())})

    counts = docs.select("text").mapInArrow(run, "block bigint, counts binary")
    out = np.zeros((1 << (LEVEL_BITS - BLOCK_BITS), 1 << BLOCK_BITS), np.uint8)
    for r in durable(counts.groupBy("block").applyInArrow(block, "block bigint, levels binary")).toLocalIterator():
        out[r["block"]] = np.frombuffer(r["levels"], np.uint8)
    return out.reshape(-1)


def _features(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Rows (doc_id, h, fp, digest, n, sketch, fine, prefix): text hash, fingerprint, digest and size of the shingle set, its parities, its rarest shingles."""
    levels = docs.sparkSession.sparkContext.broadcast(_crowding(docs, shingle))

    def rarest(x: np.ndarray) -> np.ndarray:
        rank = levels.value[(x >> np.uint64(64 - LEVEL_BITS)).astype(np.int64)].astype(np.uint64)
        return np.sort(rank << np.uint64(55) | x >> np.uint64(9))[: ngram_join.prefix_length(len(x), percent)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = ngram_join._lists
        for batch in (whole.slice(at, ROWS) for whole in batches for at in range(0, len(whole), ROWS)):
            fps, sets = [], []
            for t in batch.column("text"):
                hashes = shingle_hashes(t.as_py(), shingle)
                fps.append(fold(hashes))
                sets.append(np.unique(hashes))
            digests = pa.array([xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None for x in sets], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("h"), pa.array(fps, pa.int64()), digests, pa.array([len(x) for x in sets], pa.int64()), lists([ngram_join.sketch(x, CELLS) for x in sets]),
                 lists([ngram_join.sketch(x, max(256, 1 << len(x).bit_length())) for x in sets]), lists([rarest(x) for x in sets])],
                ["doc_id", "h", "fp", "digest", "n", "sketch", "fine", "prefix"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_key().alias("h"), "text").mapInArrow(run, f"doc_id {kind}, h bigint, fp bigint, digest binary, n bigint, sketch array<bigint>, fine array<bigint>, prefix array<bigint>")


def text_key() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _close_prints(nodes: DataFrame, radius: int) -> DataFrame:
    """Pairs (a, b) of nodes whose fingerprints are at most ``radius`` bits apart, one for each pair of fingerprints."""
    alike = durable(nodes.groupBy("fp").agg(F.min("node").alias("node")))
    near = links(alike.select("fp"), radius)
    near = near.join(alike.select(F.col("fp").alias("a"), F.col("node").alias("na")), "a").join(alike.select(F.col("fp").alias("b"), F.col("node").alias("nb")), "b")
    return near.select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b"))


def _open_cells(shared: DataFrame, rooted: DataFrame, percent: int) -> DataFrame:
    """Rows (token, node, at, x, y): cells in which all nodes of a shingle meet that can be similar and are not connected yet.

    Before the first shingle that two similar sets share they have at most ``most_apart`` others, so
    a node takes part only if its place and the foremost one leave room for that.  The largest
    connected part of a crowd meets the others, never itself.
    """
    room = F.col("n") * (100 - percent) - F.col("at") * (100 + percent)  # two nodes meet if theirs add up to zero or more
    member = shared.join(rooted, "node").select("token", "node", "at", "root", room.alias("room"))
    parts = member.groupBy("token", "root").agg(F.count("*").alias("size"), F.max("room").alias("most"))
    tops = parts.groupBy("token").agg(F.max(F.struct("size", "root")).alias("top"), F.sum("size").alias("crowd"), F.max("most").alias("most"))
    tops = durable(tops.filter("top.size < crowd"))
    cell = ngram_join.CELL
    member = member.join(tops, "token").filter("room + most >= 0")
    member = member.withColumns({"large": F.ceil(F.col("top.size") / cell), "small": F.ceil((F.col("crowd") - F.col("top.size")) / cell)})
    large, of = F.col("root") == F.col("top.root"), lambda n: F.pmod(F.xxhash64("node"), F.col(n))
    other, one = F.col("large") + of("small"), lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    meets = F.when(F.col("crowd") <= cell, F.array(F.struct(F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"))))
    meets = meets.when(large, F.transform(one("small"), lambda i: F.struct(of("large").alias("x"), (F.col("large") + i).alias("y"))))
    meets = meets.otherwise(F.concat(
        F.transform(one("large"), lambda i: F.struct(i.alias("x"), other.alias("y"))),
        F.transform(one("small"), lambda i: F.struct(F.least(other, F.col("large") + i).alias("x"), F.greatest(other, F.col("large") + i).alias("y")))))
    return member.select("token", "node", "at", F.inline(meets))


def similar_links(docs: DataFrame, nodes: DataFrame, shingle: int, percent: int, repeated: bool, radius: int = 4) -> DataFrame:
    """Pairs (a, b) of similar nodes that connect all whose shingle sets have a Jaccard similarity of ``percent`` / 100 or more.

    Similar texts share one of their rarest shingles (``prefix_length``).  First, texts whose
    fingerprints are within ``radius`` bits meet by multi-index hashing, and each text meets its
    nearest ones in cells of two of its rarest shingles: few pairs, which connect most of what is
    similar.  Then all texts that share one of their rarest shingles and are not connected yet
    meet in cells, so that none is missed.  A cell gives only pairs that parities do not reject.
    """
    def sets(width: int) -> Callable[[bytes], np.ndarray]:
        return lambda text: np.unique(shingle_hashes(text, width))

    def decided(pairs: DataFrame) -> DataFrame:
        return ngram_join._decided(ngram_join._texts(docs), nodes, pairs, shingle, percent, repeated, sets)

    each = nodes.select("node", F.posexplode("prefix").alias("at", "token"))
    crowds = durable(each.groupBy("token").agg(F.count("*").alias("crowd")).filter("crowd > 1"))
    shared = durable(each.join(crowds, "token"))
    homes = ngram_join._homes(shared)
    near = ngram_join._candidates(ngram_join._cells(homes, nodes.withColumn("root", F.col("node")), F.col("part"), F.col("which")), percent, True)
    first = decided(near.unionByName(_close_prints(nodes, radius)).distinct())

    rooted = durable(ngram_join._rooted(nodes.select("node", "n"), first))
    cells = _open_cells(shared, rooted, percent)
    rest = ngram_join._candidates(ngram_join._cells(cells, nodes.join(rooted.select("node", "root"), "node"), F.col("x"), F.col("y")), percent, False)
    return first.unionByName(decided(rest))


def one_of_each(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` without near copies: of each group of linked texts the smallest doc_id stays."""
    features = _features(docs, shingle, percent)
    nodes = durable(features.groupBy("h").agg(F.min("doc_id").alias("rep"), *[F.any_value(c).alias(c) for c in ("fp", "digest", "n", "sketch", "fine", "prefix")]))
    nodes = nodes.withColumns({"node": F.col("h"), "th": F.col("h")})
    repeated = not docs.groupBy("doc_id", text_key()).count().filter("count > 1").isEmpty()
    roots = components(similar_links(docs, nodes.filter("n > 0"), shingle, percent, repeated))
    owner = nodes.select("h", F.col("rep").alias("least")).join(roots, F.col("h") == F.col("node"), "left").select("h", "least", F.coalesce("root", "h").alias("root"))
    kept = durable(owner.groupBy("root").agg(F.min(F.struct(F.col("least"), F.col("h"))).alias("k")).select(F.col("k.least").alias("kept_id"), F.col("k.h").alias("kept_h")))
    h = fresh("h", docs.columns)
    out = docs.withColumn(h, text_key())
    same = (F.col(f"d.{h}") == F.col("k.kept_h")) & F.col("d.doc_id").eqNullSafe(F.col("k.kept_id"))
    out = out.alias("d").join(kept.alias("k"), same, "left_semi")
    if repeated:
        out = out.dropDuplicates(["doc_id", h])
    return out.drop(h)
