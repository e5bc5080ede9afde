"""Removal of long repeated byte strings by bucket-pointer refinement.

A position's bucket at length q is named by a hash of its next q bytes, so bucket pointers
need no global sort: the bucket at length 2q is a mix of the buckets of a position and of the
position q bytes on (25 to 50 to 100), each refinement reusing the last.  Only what can
repeat is refined.  Of the positions, every window of 100 bytes picks one anchor, the least
18-byte bucket in it (rightmost on ties), a choice by content alone: equal windows pick equal
anchors at equal offsets.  An anchor stands for the run of windows that pick it, and its
context is all their bytes.

1. Each task lists its anchors, (bucket, context hash, document, offset); of equal contexts it
   passes on only its first, and reports the others' bytes as repeated at once.
2. Anchors meet by bucket.  Of equal contexts all but the first are repeated.  A bucket with
   one context is finished; in others the first of each context stays open.
3. Open anchors go to their texts, and their windows are told apart by the refined buckets
   at length 100.  Of equal windows all but the first are repeated.
4. Repeated bytes go to their texts and are cut out.

A bucket with any number of copies costs each task one row, and no pair is ever made.

Contract: bytes are UTF-8; a byte is removed if a ``LENGTH``-byte string that covers it also
starts earlier (smaller doc_id, or same document, earlier start), judged on the input, and
overlaps count.  Hashes are 64 bits and 64 or 48 bits, from independent tables.  Defined results: null
and empty texts have no bytes; rows with one doc_id are read as different documents in the
order of their texts' hashes, and of rows equal in both the first keeps what the others repeat; a null doc_id
comes before all others; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

LENGTH = 100
GRAM = 25
ANCHOR_GRAM = 18  # bytes that pick an anchor; fewer make rarer anchors, but more of them alike
CHUNK_BYTES = 32 << 20  # texts whose rows a task combines at once
PIECE = 4 << 20  # window starts of one text that are worked on at once
NO_ID = -(1 << 63)  # stands for a null doc_id, with a negative tie; real ids have none

_RNG = np.random.default_rng(20)
_BYTES = _RNG.integers(1, 1 << 63, (2, 256), dtype=np.uint64)
_BASE = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)  # odd: invertible modulo 2^64
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64, kept for the next text."""
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        known = np.full(max(n, 1 << 17), base, np.uint64)
        known[0] = 1
        known = np.multiply.accumulate(known)
        if len(known) <= 2 * PIECE:
            _POWERS[base] = known
    return known[:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hasher:
    """Hashes of substrings of one text in constant time each: prefix sums of byte x base^i."""

    def __init__(self, data: np.ndarray, which: int) -> None:
        n = len(data)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTES[which][data] * _powers(_BASE[which], n), out=self.sums[1:])
        self.back = _powers(pow(_BASE[which], -1, 1 << 64), n + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.back[start])

    def grams(self, size: int) -> np.ndarray:
        """Buckets of all positions at length ``size``."""
        n = len(self.sums) - size
        return _mix((self.sums[size:] - self.sums[:n]) * self.back[:n])


def anchors(buckets: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor positions, and the first and last window start that picks each.

    Window s covers buckets s .. s + window - 1; its anchor is the least, rightmost on ties.
    Sliding minima by doubling.
    """
    n = len(buckets) - window + 1
    low, at, span = buckets, np.arange(len(buckets), dtype=np.int32), 1
    while span < window:
        step = min(span, window - span)
        a, b = low[: len(low) - step], low[step:]
        right = b <= a
        at = np.where(right, at[step:], at[: len(at) - step])
        low = np.minimum(a, b)
        span += step
    at = at[:n]
    change = np.flatnonzero(np.diff(at)) + 1
    first = np.concatenate(([0], change))
    last = np.concatenate((change - 1, [n - 1]))
    return at[first].astype(np.int64), first, last


def text_anchors(data: np.ndarray, length: int, gram: int) -> list[tuple[np.ndarray, ...]]:
    """(bucket, context, pos, first, last) of the anchors of a text, by pieces; none if it is short."""
    out = []
    for begin in range(0, max(0, len(data) - length + 1), PIECE):
        part = data[begin : begin + PIECE + length - 1]
        names, other = Hasher(part, 0), Hasher(part, 1)
        buckets = names.grams(gram)
        pos, first, last = anchors(buckets, length - gram + 1)
        shape = ((pos - first) * 4096 + (last - first)).astype(np.uint64)
        context = _mix(other.of(first, last + length) ^ shape)
        context[context == 0] = 1
        out.append((buckets[pos], context, pos + begin, first + begin, last + begin))
    return out


def refined(data: np.ndarray, length: int, gram: int) -> np.ndarray:
    """Buckets of all positions at ``length`` = gram * 2^k, each level from the one before."""
    level, size = Hasher(data, 1).grams(gram), gram
    while size < length:
        level = _mix(level[: len(level) - size] * np.uint64(3) + level[size:])
        size *= 2
    return level


def names_at(data: np.ndarray, start: np.ndarray, length: int, gram: int) -> np.ndarray:
    """Refined buckets of the windows that start at ``start``, by pieces of the text."""
    out = np.empty(len(start), np.uint64)
    for begin in range(0, max(0, len(data) - length + 1), PIECE):
        here = np.flatnonzero((start >= begin) & (start < begin + PIECE))
        if len(here):
            out[here] = refined(data[begin : begin + PIECE + length - 1], length, gram)[start[here] - begin]
    return out


def _bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64) if x.dtype == np.uint64 else x


def _firsts(columns: list[np.ndarray], keys: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Columns sorted, and which rows repeat the first ``keys`` columns of the row above."""
    order = np.lexsort(columns[::-1])
    columns = [c[order] for c in columns]
    again = np.zeros(len(order), bool)
    again[1:] = np.logical_and.reduce([c[1:] == c[:-1] for c in columns[:keys]])
    return columns, again


#: An anchor's place in one long: position, position minus first window, last minus first window.
NARROW = 8
ANCHOR = "bucket bigint, context bigint, doc bigint, tie bigint, place bigint"
OPEN = "bucket bigint, doc bigint, tie bigint, place bigint, named binary"
#: Bytes of a window's name; with its anchor's 64-bit bucket and its offset they tell windows apart.
NAME = 6
#: A repeated run in one long: start and size.
RUN_BITS = 24


def _pack(pos: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    return (pos << 2 * NARROW) | ((pos - first) << NARROW) | (last - first)


def _unpack(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    pos, mask = place >> 2 * NARROW, (1 << NARROW) - 1
    first = pos - ((place >> NARROW) & mask)
    return pos, first, first + (place & mask)


def _runs(start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Overlapping or touching intervals, sorted by start, as packed runs."""
    if not len(start):
        return np.empty(0, np.int64)
    reach = np.maximum.accumulate(stop)
    begin = np.flatnonzero(np.concatenate(([True], start[1:] > reach[:-1])))
    lo, hi = start[begin], np.append(reach[begin[1:] - 1], reach[-1])
    most, out = (1 << RUN_BITS) - 1, []
    for x, y in zip(lo.tolist(), hi.tolist(), strict=True):
        out += [(z << RUN_BITS) | min(most, y - z) for z in range(x, y, most)]
    return np.array(out, np.int64)


def _anchor_runs(place: np.ndarray, length: int) -> np.ndarray:
    """All windows of the anchors as runs."""
    _, first, last = _unpack(place)
    order = np.argsort(first, kind="stable")
    return _runs(first[order], last[order] + length)


def _batch(columns: list, schema: str) -> pa.RecordBatch:
    names = [f.split()[0] for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(_signed(c)) if isinstance(c, np.ndarray) else c for c in columns], names)


def list_anchors(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """Step 1, over rows (doc, tie, text); of equal contexts in a chunk only the first goes on.

    The others are known to repeat: they are merged into runs, with context 0 and the run as
    place.  Runs need no meeting, so their bucket is one that spreads evenly.
    """

    def combined(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
        columns, again = _firsts([np.concatenate(c) for c in zip(*parts, strict=True)], 2)
        yield _batch([c[~again] for c in columns], ANCHOR)
        doc, tie, place = (c[again] for c in columns[2:])
        order = np.lexsort((place, tie, doc))
        doc, tie, place = doc[order], tie[order], place[order]
        edges = np.flatnonzero((doc[1:] != doc[:-1]) | (tie[1:] != tie[:-1])) + 1
        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(doc)], strict=True):
            if a < b:
                runs = _anchor_runs(place[a:b], length)
                n = len(runs)
                yield _batch([_mix(runs.astype(np.uint64) + np.uint64(int(doc[a]) & (1 << 64) - 1)), np.zeros(n, np.uint64), np.full(n, doc[a]), np.full(n, tie[a]), runs], ANCHOR)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in batches:
            for doc, tie, text in zip(*(batch.column(c) for c in ("doc", "tie", "text")), strict=True):
                data = _bytes(text.as_py())
                for bucket, context, pos, first, last in text_anchors(data, length, gram):
                    n = len(bucket)
                    parts.append((bucket, context, np.full(n, doc.as_py(), np.int64), np.full(n, tie.as_py(), np.int64), _pack(pos, first, last)))
                size += len(data)
                if size >= CHUNK_BYTES and parts:
                    yield from combined(parts)
                    parts, size = [], 0
        if parts:
            yield from combined(parts)

    return docs.mapInArrow(run, ANCHOR)


def meet(rows: DataFrame, length: int) -> DataFrame:
    """Step 2: rows (doc, tie, bucket, place), open, or repeated: bucket null and a run as place."""
    rows = rows.repartition("bucket")
    nth = F.row_number().over(W.partitionBy("bucket", "context").orderBy("doc", "tie", "place"))
    whole = W.partitionBy("bucket")
    seen = rows.select("*", nth.alias("nth"), F.min("context").over(whole).alias("c0"), F.max("context").over(whole).alias("c1"))
    opened = (F.col("context") != 0) & (F.col("nth") == 1)
    narrow = (1 << NARROW) - 1
    run = F.expr(f"shiftleft(shiftright(place, {2 * NARROW}) - (shiftright(place, {NARROW}) & {narrow}), {RUN_BITS}) | ((place & {narrow}) + {length})")
    kept = F.when(opened | (F.col("context") == 0), F.col("place")).otherwise(run)
    return seen.filter(~opened | (F.col("c0") != F.col("c1"))).select("doc", "tie", F.when(opened, F.col("bucket")).alias("bucket"), kept.alias("place"))


def tell_apart(docs: DataFrame, met: DataFrame, length: int, gram: int) -> DataFrame:
    """Step 3: rows of OPEN, the refined buckets of the windows of an open anchor, in order.

    A window that already repeats in the chunk is all zeros.  Rows without ``named`` hold in ``place``
    a run that is known to repeat.
    """
    listed = met.groupBy("doc", "tie").agg(F.collect_list(F.struct("bucket", "place")).alias("found"))
    joined = docs.join(listed, ["doc", "tie"], "left").select("doc", "tie", "text", "found")

    def known(doc: int, tie: int, runs: np.ndarray) -> pa.RecordBatch:
        n = len(runs)
        spread = _mix(runs.astype(np.uint64) + np.uint64(doc & (1 << 64) - 1))
        return _batch([spread, np.full(n, doc, np.int64), np.full(n, tie, np.int64), runs, pa.nulls(n, pa.binary())], OPEN)

    def combined(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
        anchor, bucket, offset, name, doc, tie, start = (np.concatenate(c) for c in zip(*[p[0] for p in parts], strict=True))
        order = np.lexsort((start, tie, doc, name, offset, bucket))
        again = np.zeros(len(order), bool)
        cols = [c[order] for c in (bucket, offset, name)]
        again[1:] = np.logical_and.reduce([c[1:] == c[:-1] for c in cols])
        name = name.copy()
        name[order[again]] = 0
        base = 0
        buckets, docs_, ties, places, lists = [], [], [], [], []
        for (rows, *_), place, many, d, t, own in parts:
            n = len(rows)
            mine, begins = name[base : base + n], start[base : base + n]
            hit = np.sort(begins[mine == 0])
            if len(hit):
                yield known(d, t, _runs(hit, hit + length))
            buckets.append(own)
            docs_.append(np.full(len(own), d, np.int64))
            ties.append(np.full(len(own), t, np.int64))
            places.append(place)
            lists.append((many, mine))
            base += n
        many = np.concatenate([m for m, _ in lists])
        flat = np.ascontiguousarray(np.concatenate([x for _, x in lists]).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :NAME])
        ends = np.concatenate(([0], np.cumsum(many) * NAME)).astype(np.int32)
        named = pa.Array.from_buffers(pa.binary(), len(many), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(flat.tobytes())])
        yield _batch([np.concatenate(buckets), np.concatenate(docs_), np.concatenate(ties), np.concatenate(places), named], OPEN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in batches:
            for doc, tie, text, found in zip(*(batch.column(c) for c in ("doc", "tie", "text", "found")), strict=True):
                if not found.is_valid or not len(found.values):
                    continue
                d, t = doc.as_py(), tie.as_py()
                buckets, place = found.values.field("bucket"), found.values.field("place").to_numpy()
                done = buckets.is_null().to_numpy(zero_copy_only=False)
                if done.any():
                    start = np.sort(place[done])
                    yield known(d, t, _runs(start >> RUN_BITS, (start >> RUN_BITS) + (start & (1 << RUN_BITS) - 1)))
                if done.all():
                    continue
                own = buckets.drop_null().to_numpy().view(np.uint64)
                place = place[~done]
                pos, first, last = _unpack(place)
                many = last - first + 1
                row = np.repeat(np.arange(len(own)), many)
                start = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                name = names_at(_bytes(text.as_py()), start, length, gram)
                name &= np.uint64((1 << 8 * NAME) - 1)
                name[name == 0] = 1
                n = len(start)
                parts.append(((row, own[row], pos[row] - start, name, np.full(n, d, np.int64), np.full(n, t, np.int64), start), place, many, d, t, own))
                size += 64 * n
                if size >= CHUNK_BYTES:
                    yield from combined(parts)
                    parts, size = [], 0
        if parts:
            yield from combined(parts)

    return joined.mapInArrow(run, OPEN)


def repeats(told: DataFrame, length: int) -> DataFrame:
    """Step 4 of equal windows: rows (doc, tie, run)."""
    names = F.expr(f"if(named is null, null, transform(sequence(0, cast(octet_length(named) div {NAME} as int) - 1), i -> substring(named, i * {NAME} + 1, {NAME})))")
    each = told.repartition("bucket").select("bucket", "doc", "tie", "place", F.posexplode_outer(names).alias("i", "name"))
    first = F.shiftright("place", 2 * NARROW) - F.shiftright("place", NARROW).bitwiseAND(F.lit((1 << NARROW) - 1))
    # A window's offset from its anchor is the place's own offset less i.
    each = each.filter(F.col("name").isNull() | (F.col("name") != F.lit(bytes(NAME)))).select(
        "bucket", "doc", "tie", "place", "name", (F.shiftright("place", NARROW).bitwiseAND(F.lit((1 << NARROW) - 1)) - F.col("i")).alias("offset"), (first + F.col("i")).alias("start"))
    nth = F.row_number().over(W.partitionBy("bucket", "offset", "name").orderBy("doc", "tie", "start"))
    each = each.withColumn("nth", nth).filter(F.col("name").isNull() | (F.col("nth") > 1))
    window = F.shiftleft("start", RUN_BITS).bitwiseOR(F.lit(length))
    return each.select("doc", "tie", F.when(F.col("name").isNull(), F.col("place")).otherwise(window).alias("run"))


def removed_bytes(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, anchor: int = ANCHOR_GRAM) -> DataFrame:
    """Rows (doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans); spans as start-end pairs."""
    if length % gram or (length // gram) & (length // gram - 1) or length >= 1 << NARROW or not 0 < anchor <= length:
        raise ValueError(f"length must be gram times a power of two, at least anchor, and less than {1 << NARROW}")
    most = F.lit((1 << 63) - 1)
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc")
    if docs.groupBy(F.col("doc_id").cast("long").alias("id")).count().filter("count > 1").isEmpty():
        tie = F.lit(0).cast("long")
        rows = docs.select(doc, F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(tie).cast("long").alias("tie"), "text", F.lit(1).cast("long").alias("copies"))
    else:
        tie = F.coalesce(F.xxhash64("text"), F.lit(0)).bitwiseAND(most)
        rows = docs.select(doc, F.when(F.col("doc_id").isNull(), tie - most - 1).otherwise(tie).alias("tie"), "text")
        twins = rows.groupBy("doc", "tie").count()
        rows = rows.dropDuplicates(["doc", "tie"]).join(twins, ["doc", "tie"]).select("doc", "tie", "text", F.col("count").alias("copies"))

    met = meet(list_anchors(rows.select("doc", "tie", "text"), length, anchor), length)
    cut = repeats(tell_apart(rows, met, length, gram), length)
    cut = cut.groupBy("doc", "tie").agg(F.collect_list("run").alias("cut"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc, tie, text, copies, cuts in zip(*(batch.column(c) for c in ("doc", "tie", "text", "copies", "cut")), strict=True):
                data = _bytes(text.as_py())
                n, d = len(data), None if doc.as_py() == NO_ID and tie.as_py() < 0 else doc.as_py()
                spans: list[tuple[int, int]] = []
                if cuts.is_valid:
                    runs = np.sort(cuts.values.to_numpy())
                    start = runs >> RUN_BITS
                    merged = start + (runs & (1 << RUN_BITS) - 1)
                    reach = np.maximum.accumulate(merged)
                    begin = np.flatnonzero(np.concatenate(([True], start[1:] > reach[:-1])))
                    spans = list(zip(start[begin].tolist(), np.append(reach[begin[1:] - 1], reach[-1]).tolist(), strict=True))
                    edges = [0, *[x for s in spans for x in s], n]
                    data = np.concatenate([data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)])
                out.append((d, n, n - len(data), len(spans), hashlib.sha256(data.tobytes()).hexdigest(), spans))
                twin = (d, n, n, 1, hashlib.sha256(b"").hexdigest(), [(0, n)]) if n >= length else out[-1]
                out += [twin] * (copies.as_py() - 1)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))]
            columns = list(zip(*out, strict=True)) or [()] * 6
            columns[5] = [[{"start": a, "stop": b} for a, b in s] for s in columns[5]]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    joined = rows.join(cut, ["doc", "tie"], "left").select("doc", "tie", "text", "copies", "cut")
    return joined.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<struct<start: bigint, stop: bigint>>")
