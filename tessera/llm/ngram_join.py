"""N-gram Jaccard join by prefix trees.

A text, A-Z lower-cased, is cut at ASCII white space into words; its set holds its different
runs of ``width`` words, or the whole sequence if there are fewer.  Two texts link if their
sets have a Jaccard similarity of ``percent`` / 100 or more, and the links' connected components
are the groups.  Texts of equal sets are one node, so copies are never paired.

All sets are put in one order: rare n-grams first, as counted in a fixed share of the texts, then
by hash.  Similar sets of m and n share at least one of their first n-grams (``prefix_length``),
and in the list of the first n-gram they share, they differ in at most
(m + n)(100 - percent)/(100 + percent) others.  So the nodes of each n-gram are dealt into cells,
where the n-grams that follow in their order form a trie.  All nodes of a cell walk down the trie
together, level by level: what a path shares is compared once, and a subtree is left as soon as
the n-grams missed so far are more than the lengths below it allow.  Parities of hashed n-grams
reject what arrives at a leaf and cannot be similar; the whole sets decide the rest.

First each node is dealt to cells of two of its n-grams, at random within a crowd, and each cell
gives a spanning forest of its nearest pairs: these links connect most of what is similar.  Then the cells of all n-grams whose nodes are
not connected yet are walked in full, two crowded parts at a time, so that no link between
components is missed.

N-grams are compared by 64-bit hashes (within a trie 58 bits, where a collision costs only a
comparison): two sets of n count a wrong overlap with a chance of about n^2 / 2^64.

Defined results: null and empty texts, and texts of white space only, have an empty set and link
with nothing; repeated rows stay rows, linked by their equal sets; a null doc_id takes part but
names no component unless all its members are null; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import components, durable

SEED = 42
ONE_IN = 16  # texts, of which one is counted for the order
MOST_COMMON = 1 << 20  # n-grams, the commonest, that the order puts last; others are told apart by hash
KNOWN_WORDS = 1 << 20
PATH = 16  # n-grams of a trie path
CELL = 256  # nodes of a cell, about
PAIRS_AT_ONCE = 1 << 18  # node pairs, at most, of the cells that are walked together
PLACE_GRAMS = 1 << 20  # n-grams of the sets that are compared in one place, about
BROADCAST_PAIRS = 1_000_000
END = np.iinfo(np.int64).max


class Shingler:
    """Sets of n-gram hashes of texts; each different word is hashed once."""

    def __init__(self, width: int) -> None:
        self.width, self.known = width, {}

    def __call__(self, text: bytes) -> np.ndarray:
        words = text.lower().split()
        if len(words) < self.width:
            return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED + len(words))] if words else [], np.uint64)
        known = self.known
        if len(known) > KNOWN_WORDS:
            known.clear()
        hashes = np.array([known[w] if w in known else known.setdefault(w, xxhash.xxh64_intdigest(w, SEED)) for w in words], np.uint64)
        count = len(words) - self.width + 1
        out = hashes[:count]
        for i in range(1, self.width):
            out = _mix(out) + hashes[i : i + count]
        return np.unique(_mix(out))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_length(n: int, percent: int) -> int:
    """N-grams, first in the order, of which similar sets share at least one."""
    return n + (-percent * n) // 100 + 1 if n else 0


def most_apart(m: np.ndarray, n: np.ndarray, percent: int) -> np.ndarray:
    """N-grams, at most, that only one of two similar sets of m and n has."""
    return (m + n) * (100 - percent) // (100 + percent)


def sketch(hashes: np.ndarray, cells: int = 256) -> np.ndarray:
    """Parities of the numbers of n-grams in each of ``cells`` cells, packed into longs."""
    odd = np.bincount((hashes & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.xxhash64(text).alias("th"), text.alias("text"))


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)])
    flat = np.concatenate(arrays) if arrays else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.view(np.int64)))


def _common(texts: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The commonest n-grams by their counts in one text of ONE_IN: sorted hashes, logarithms of counts; MOST_COMMON rows at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(width)
        for batch in batches:
            for t in batch.column("text").cast(pa.binary()):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(t.as_py()).view(np.int64))], ["key"])

    some = texts.filter(F.pmod("th", F.lit(ONE_IN)) == 0).select("text").distinct()
    counts = some.mapInArrow(run, "key bigint").groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    counts = durable(counts.select("key", F.least(F.lit(31), F.ceil(F.log2(F.col("n") + 1))).cast("int").alias("level")))
    least, taken = 32, 0
    for level, n in sorted(((r["level"], r["count"]) for r in counts.groupBy("level").count().collect()), reverse=True):
        taken += n
        if taken > MOST_COMMON:
            break
        least = level
    told = counts.filter(F.col("level") >= least).toArrow()
    keys, levels = told["key"].to_numpy().view(np.uint64), told["level"].to_numpy()
    order = np.argsort(keys)
    return keys[order], levels[order].astype(np.uint64)


def _features(texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Rows (doc_id, th, digest, n, prefix, sketch, fine): digest of the set, its size, its first n-grams, its parities in few cells and in about as many as n-grams."""
    known, classes = _common(texts, width)

    def first(x: np.ndarray) -> np.ndarray:
        ranked = x >> np.uint64(6)
        if len(known):
            at = np.minimum(np.searchsorted(known, x), len(known) - 1)
            ranked = ranked | np.where(known[at] == x, classes[at], np.uint64(0)) << np.uint64(58)
        k = prefix_length(len(x), percent)
        return np.sort(np.partition(ranked, k - 1)[:k]) if k else ranked

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(width)
        for batch in batches:
            sets = [shingles(t.as_py()) for t in batch.column("text").cast(pa.binary())]
            digests = pa.array([xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None for x in sets], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("th"), digests, pa.array([len(x) for x in sets], pa.int64()), _lists([first(x) for x in sets]), _lists([sketch(x) for x in sets]),
                 _lists([sketch(x, max(256, 1 << len(x).bit_length())) for x in sets])],
                ["doc_id", "th", "digest", "n", "prefix", "sketch", "fine"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(run, f"doc_id {kind}, th bigint, digest binary, n bigint, prefix array<bigint>, sketch array<bigint>, fine array<bigint>")


# --- the trie of a cell


def _walk(cell: np.ndarray, n: np.ndarray, pos: np.ndarray, root: np.ndarray, path: np.ndarray, bits: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows (probe, found, parities apart) of one cell and different roots that can be similar.

    Rows are sorted by cell and path; ``path`` has the n-grams after the cell's own, END after the last.
    """
    rows, depth = path.shape
    size = (path != END).sum(axis=1)
    last = np.where(size > 0, path[np.arange(rows), np.maximum(size - 1, 0)], -1)
    starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])  # nodes of a level: ranges of rows
    probe = np.arange(rows)
    at = np.searchsorted(starts, probe, "right") - 1
    ptr, shared = np.zeros(rows, np.int64), np.zeros(rows, np.int64)  # of the probe's own path: n-grams passed, and how many of them are shared
    found = []
    for level in range(depth + 1):
        low_pos, low_root, high_root, high_n, low_n = (
            f.reduceat(x, starts)[at] for f, x in ((np.minimum, pos), (np.minimum, root), (np.maximum, root), (np.maximum, n), (np.minimum, n)))
        m = n[probe]
        fits = (low_n * percent <= m * 100) & (m * percent <= high_n * 100) & ((low_root != high_root) | (low_root != root[probe]))
        fits &= pos[probe] + low_pos + ptr + level - 2 * shared <= most_apart(m, np.minimum(high_n, m * 100 // percent), percent)
        probe, at, ptr, shared = (x[fits] for x in (probe, at, ptr, shared))
        if level == depth:
            found.append((probe, starts[at], np.r_[starts[1:], rows][at], ptr + level - 2 * shared))
            break
        # children: ranges within the node's rows that share the next n-gram
        opens = np.zeros(rows, bool)
        opens[starts] = True
        opens[1:] |= path[1:, level] != path[:-1, level]
        below = np.flatnonzero(opens)
        first = np.searchsorted(below, starts)
        count = np.diff(np.r_[first, len(below)])[at]
        child = np.repeat(first[at] - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum()) if len(count) else np.empty(0, np.int64)
        probe, ptr, shared = (np.repeat(x, count) for x in (probe, ptr, shared))
        gram = path[below[child], level]
        own = path[probe]
        before = (own < gram[:, None]).sum(axis=1)
        # a path that has ended tells no more of what follows its last n-gram
        ended, beyond = gram == END, gram > last[probe]
        ptr = np.where(ended, ptr, before)
        over = ended | beyond
        found.append((probe[over], below[child[over]], np.r_[below[1:], rows][child[over]], (ptr + level - 2 * shared)[over]))
        equal = own[np.arange(len(probe)), np.minimum(before, depth - 1)] == gram
        probe, at, ptr, shared = (x[~over] for x in (probe, child, ptr + equal, shared + equal))
        starts = below
    out_p, out_lo, out_hi, out_missed = zip(*found, strict=True)
    p, lo, hi, missed = (np.concatenate(x) for x in (out_p, out_lo, out_hi, out_missed))
    count = hi - lo
    p, missed = np.repeat(p, count), np.repeat(missed, count)
    r = np.repeat(lo - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum()) if len(count) else np.empty(0, np.int64)
    m, k = n[p], n[r]
    most = most_apart(m, k, percent)
    fits = (root[p] != root[r]) & (k * percent <= m * 100) & (m * percent <= k * 100) & (pos[p] + pos[r] + missed <= most)
    p, r, most = p[fits], r[fits], most[fits]
    turned = np.zeros(len(p), np.int64)
    for u in bits.T:
        turned += np.bitwise_count(u[p] ^ u[r])
    near = turned <= most
    return p[near], r[near], turned[near]


def _forest(p: np.ndarray, r: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Of the pairs (p, r) in this order, those that join what none before has joined."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    out = []
    for i, x, y in zip(order.tolist(), p[order].tolist(), r[order].tolist(), strict=True):
        if (u := top(x)) != (v := top(y)):
            up[u] = v
            out.append(i)
    return np.array(out, np.int64)


def _candidates(cells: DataFrame, percent: int, tree: bool) -> DataFrame:
    """Pairs (a, b), a < b, of nodes of one cell that can be similar, or only a cell's spanning forest of the nearest of them.

    ``cells`` has token, x, y (the cell), node, n, pos, root, path, sketch.
    """

    def pairs(t: pa.Table) -> pa.RecordBatch:
        x = {c: t[c].to_numpy() for c in ("token", "x", "y", "node", "n", "pos", "root")}
        lists = t["path"].combine_chunks()
        size = np.diff(lists.offsets.to_numpy())
        path = np.full((len(t), PATH), END)
        path[np.arange(PATH) < size[:, None]] = lists.flatten().to_numpy()
        bits = t["sketch"].combine_chunks().flatten().to_numpy().reshape(len(t), -1).view(np.uint64)
        cut = np.flatnonzero(np.r_[True, (x["token"][1:] != x["token"][:-1]) | (x["x"][1:] != x["x"][:-1]) | (x["y"][1:] != x["y"][:-1])])
        sizes = np.diff(np.r_[cut, len(t)])
        cell = np.repeat(np.arange(len(cut)), sizes)
        found, lo = [], 0
        work = np.cumsum(sizes.astype(np.int64) ** 2)
        while lo < len(cut):
            hi = max(lo + 1, int(np.searchsorted(work, (work[lo - 1] if lo else 0) + PAIRS_AT_ONCE, "right")))
            rows = slice(cut[lo], cut[hi] if hi < len(cut) else len(t))
            p, r, turned = _walk(cell[rows], x["n"][rows], x["pos"][rows], x["root"][rows], path[rows], bits[rows], percent)
            node = x["node"][rows]
            far = turned / (x["n"][rows][p] + x["n"][rows][r])
            one = np.flatnonzero(node[p] < node[r])
            if tree:
                one = _forest(p, r, one[np.lexsort((node[r[one]], node[p[one]], far[one]))])
            p, r = p[one], r[one]
            found.append((node[p], node[r]))
            lo = hi
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t])
            token, x, y = (held[c].to_numpy() for c in ("token", "x", "y"))
            whole = np.flatnonzero((token[1:] != token[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1]))
            if len(whole):  # the last cell can go on in the next batch
                yield pairs(held.slice(0, whole[-1] + 1))
                held = held.slice(whole[-1] + 1)
        if held is not None and len(held):
            yield pairs(held)

    dealt = cells.repartition("token", "x", "y").sortWithinPartitions("token", "x", "y", "path", "node")
    return dealt.mapInArrow(run, "a bigint, b bigint").distinct()


def _cells(members: DataFrame, nodes: DataFrame, x: Column, y: Column) -> DataFrame:
    """Members (token, node, at, ...) of the cells (token, x, y) with what the trie needs of their nodes."""
    path = F.slice("prefix", F.col("at") + 2, F.lit(PATH))
    return members.select("token", "node", "at", x.alias("x"), y.alias("y")).join(nodes, "node").select(
        "token", "x", "y", "node", "n", F.col("at").cast("long").alias("pos"), "root", path.alias("path"), "sketch")


def _placed(pairs: DataFrame, nodes: DataFrame, grams: int) -> DataFrame:
    """The pairs as rows (place, a, b): a grid by ``a`` and ``b``, so that also a node of many pairs is dealt out, with about ``grams`` n-grams to a place."""
    pairs = durable(pairs)
    total = pairs.select(F.explode(F.array("a", "b")).alias("node")).join(nodes.select("node", "n"), "node").agg(F.sum("n")).first()[0] or 0
    side = math.isqrt(total // grams) + 1
    place = F.pmod(F.xxhash64("a"), F.lit(side)) * side + F.pmod(F.xxhash64("b"), F.lit(side))
    return pairs.select(place.alias("place"), "a", "b")


def _wanted(placed: DataFrame) -> DataFrame:
    """Rows (place, node, second): the nodes of each place that come first and second in its pairs."""
    ends = F.array(F.struct(F.col("a").alias("node"), F.lit(False).alias("second")), F.struct(F.col("b").alias("node"), F.lit(True).alias("second")))
    return placed.select("place", F.inline(ends)).distinct()


def _compared(told: DataFrame, placed: DataFrame, alike: Callable[[np.ndarray, np.ndarray], bool]) -> DataFrame:
    """The placed pairs (a, b) whose nodes are alike; ``told`` has place, node, second and longs.

    A task holds the longs of a place's first nodes; the second ones come one at a time, each followed by its pairs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, now = None, {}, None
        for batch in batches:
            near = []
            lists = batch.column("longs")
            for i, (place, b, a) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("place", "b", "a")], strict=True)):
                if place != at:
                    at, held = place, {}
                if b is None:
                    held[a] = lists[i].values.to_numpy()
                elif a is None:
                    now = lists[i].values.to_numpy()
                elif alike(held[a], now):
                    near.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in near], pa.int64()) for i in (0, 1)], ["a", "b"])

    sides = told.select("place", F.when(F.col("second"), F.col("node")).alias("b"), F.when(~F.col("second"), F.col("node")).alias("a"), "longs")
    every = sides.unionByName(placed, allowMissingColumns=True)
    dealt = every.repartition("place").sortWithinPartitions("place", F.col("b").asc_nulls_first(), F.col("a").asc_nulls_first())
    return durable(dealt.mapInArrow(run, "a bigint, b bigint"))


def _decided(texts: DataFrame, nodes: DataFrame, pairs: DataFrame, width: int, percent: int, repeated: bool, shingler: Callable[[int], Callable[[bytes], np.ndarray]] = Shingler) -> DataFrame:
    """Those of the pairs (a, b) of nodes whose whole sets, by ``shingler``, are similar: what fine parities leave, by the sets themselves."""

    def finely(x: np.ndarray, y: np.ndarray) -> bool:
        (m, u), (n, v) = (x[0], x[1:]), (y[0], y[1:])
        size = min(len(u), len(v))
        turned = np.bitwise_xor.reduce(u.reshape(-1, size)) ^ np.bitwise_xor.reduce(v.reshape(-1, size))
        return int(np.bitwise_count(turned.view(np.uint64)).sum()) <= most_apart(m, n, percent)

    def similar(x: np.ndarray, y: np.ndarray) -> bool:
        shared = len(np.intersect1d(x, y, assume_unique=True))
        return 100 * shared >= percent * (len(x) + len(y) - shared)

    placed = _placed(pairs, nodes, PLACE_GRAMS * 4)
    told = nodes.select("node", F.concat(F.array("n"), "fine").alias("longs")).join(_wanted(placed), "node")
    placed = _placed(_compared(told, placed, finely), nodes, PLACE_GRAMS)
    wanted = durable(nodes.select("node", "th", "rep", "digest").join(_wanted(placed), "node"))
    w = F.broadcast(wanted.alias("w")) if wanted.count() <= BROADCAST_PAIRS else wanted.alias("w")  # else the texts are shuffled
    told = texts.alias("t").join(w, (F.col("t.th") == F.col("w.th")) & F.col("t.doc_id").eqNullSafe(F.col("w.rep"))).select("w.place", "w.node", "w.second", "w.digest", "t.text")
    if repeated:
        told = told.dropDuplicates(["place", "node", "second"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = shingler(width)
        for batch in batches:
            found = [shingles(t.as_py()) for t in batch.column("text").cast(pa.binary())]
            same = [xxhash.xxh3_128_digest(x.tobytes()) == d.as_py() for x, d in zip(found, batch.column("digest"), strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("place", "node", "second")], _lists(found)], ["place", "node", "second", "longs"]).filter(pa.array(same, pa.bool_()))

    return _compared(told.mapInArrow(sets, "place bigint, node bigint, second boolean, longs array<bigint>"), placed, similar)


def _homes(shared: DataFrame) -> DataFrame:
    """Two n-grams of each node, those that fewest and most others share; crowds are dealt at random, twice for the most."""
    told = F.struct("crowd", "token", "at")
    homes = shared.groupBy("node").agg(F.min(told).alias("few"), F.max(told).alias("most"))
    homes = homes.select("node", F.posexplode(F.array("few", "most", "most")).alias("which", "s")).select("node", "which", "s.*").filter((F.col("which") < 2) | (F.col("crowd") > CELL))
    return homes.withColumns({"part": F.pmod(F.xxhash64("node", "which"), F.ceil(F.col("crowd") / CELL)), "which": F.col("which").cast("long")})


def _rooted(nodes: DataFrame, links: DataFrame) -> DataFrame:
    roots = components(links).withColumnRenamed("node", "of").withColumnRenamed("root", "to")
    return nodes.drop("root").join(roots, F.col("node") == F.col("of"), "left").withColumn("root", F.coalesce("to", "node")).drop("of", "to")


def groups(docs: DataFrame, width: int = 3, percent: int = 90) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id)."""
    texts = _texts(docs)
    rows = durable(_features(texts, width, percent))
    told = rows.filter("n > 0").groupBy("digest").agg(F.min("doc_id").alias("least"), F.min(F.struct("th", "doc_id", "n", "prefix", "sketch", "fine")).alias("s"))
    nodes = told.select("digest", "least", "s.th", F.col("s.doc_id").alias("rep"), "s.n", "s.prefix", "s.sketch", "s.fine")
    nodes = durable(nodes.withColumn("node", F.monotonically_increasing_id()).withColumn("root", F.col("node")))
    trie = nodes.select("node", "n", "root", "prefix", "sketch")
    repeated = not rows.groupBy("doc_id", "th").count().filter("count > 1").isEmpty()

    each = nodes.select("node", F.posexplode("prefix").alias("at", "token"))
    crowds = each.groupBy("token").agg(F.count("*").alias("crowd")).filter("crowd > 1")
    shared = durable(each.join(crowds, "token"))

    near = _candidates(_cells(_homes(shared), trie, F.col("part"), F.col("which")), percent, True)
    first = _decided(texts, nodes, near, width, percent, repeated)

    # what is not connected yet: all parts of a crowd meet, two at a time
    trie = durable(_rooted(trie, first))
    open_crowds = shared.join(trie.select("node", "root"), "node").groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("token")
    left = shared.join(open_crowds, "token", "left_semi").withColumn("parts", F.ceil(F.col("crowd") / CELL)).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
    left = left.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    rest = _candidates(_cells(left, trie, F.least("part", "other"), F.greatest("part", "other")), percent, False)
    links = first.unionByName(_decided(texts, nodes, rest, width, percent, repeated))

    named = durable(_rooted(nodes.select("node", "digest", "least"), links))
    least = durable(named.groupBy("root").agg(F.min("least").alias("component_id")))  # stored, so that a large group's join can be split
    named = durable(named.join(least, "root").select("digest", "component_id"))
    out = rows.select("doc_id", "digest", "n").join(named, "digest", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
