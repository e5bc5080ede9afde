"""Benchmark decontamination: rare word-pair seeds, then Smith-Waterman alignment.

Texts and items are lower-cased runs of word characters.  An alignment (match +1, mismatch
-1, gap -1, in words) scores its matches less its edits, and e edits leave at most e + 1 runs
of matches; so a passage that reaches ``threshold`` of an item of m words holds at least
``threshold`` * m - 1 of the item's pairs of neighbouring words, within ``reach`` words of the
text.  Every item's pairs are counted over all documents; all but the commonest are its
seeds: so few are left out that a leak holds a seed whatever the edits are.  Where a text
holds a seed and enough of the item's pairs close together, the item is aligned with the
words around them by Smith-Waterman.  The score is the best local alignment over the item's
length; passages that reach ``threshold`` are leaks, so copies with some words edited, dropped
or added are found too, each that a plain alignment with the whole text would find.

Items are worked off in blocks of about ``BLOCK_ITEMS`` items and ``BLOCK_BYTES`` of text, the bound
of what is sent to the executors; each block scans the whole corpus.  Counts are always those of
the whole input, so the result does not depend on how items fall into blocks.

Defined results: null and empty texts and items without words match nothing; an item of
fewer than ``width`` words is sought as a whole only; items of one text are each reported;
repeated rows of a document are each reported; a null doc_id is carried; empty tables give
no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tessera.llm.common import durable

WORDS = re.compile(r"\w+")
WIDTH = 3
GRAM = 2  # words of a seed: of longer runs, a leak may hold none
THRESHOLD = 0.5
BLOCK_ITEMS, BLOCK_BYTES = 20_000, 32 << 20
GAP = 1


@dataclass
class Index:
    """Benchmark items as word numbers, and their n-grams."""

    words: dict[str, int]
    items: dict[int, np.ndarray]  # by place in the block
    ids: list  # item_id by place
    grams: np.ndarray  # sorted keys
    own: dict[int, np.ndarray]  # by item: the gram at each position
    seeds: list[list[int]]  # by gram: the items it is a seed of
    short: list[int]  # items of fewer words than ``width``, sought as whole word runs

    def keys(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of n-grams of known words, and their keys."""
        base = len(self.words) + 1
        if len(codes) < GRAM:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        n = len(codes) - GRAM + 1
        known = np.logical_and.reduce([codes[i : i + n] >= 0 for i in range(GRAM)])
        at = np.flatnonzero(known)
        key = np.zeros(len(at), np.uint64)
        for i in range(GRAM):
            key = key * np.uint64(base) + codes[at + i].astype(np.uint64)
        return at, key

    def find(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions and gram numbers of the benchmark n-grams in a text."""
        at, key = self.keys(codes)
        if not len(at) or not len(self.grams):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        g = np.minimum(np.searchsorted(self.grams, key), len(self.grams) - 1)
        hit = self.grams[g] == key
        return at[hit], g[hit]

    def codes(self, text: str | None) -> np.ndarray:
        get = self.words.get
        return np.array([get(w.lower(), -1) for w in WORDS.findall(text or "")], np.int64)


def build(rows: list[tuple[object, str | None]], width: int = WIDTH) -> Index:
    said = [(i, [w.lower() for w in WORDS.findall(t or "")]) for i, t in rows]
    said = [(i, w) for i, w in said if w]
    words: dict[str, int] = {}
    for _, ws in said:
        for w in ws:
            words.setdefault(w, len(words))
    items = {k: np.array([words[w] for w in ws], np.int64) for k, (_, ws) in enumerate(said)}
    short = [k for k, codes in items.items() if len(codes) < width]
    index = Index(words, items, [i for i, _ in said], np.empty(0, np.uint64), {}, [], short)
    keys = {k: index.keys(codes)[1] for k, codes in items.items() if len(codes) >= width}
    if keys:
        index.grams = np.unique(np.concatenate(list(keys.values())))
    index.own = {k: np.searchsorted(index.grams, key) for k, key in keys.items()}
    index.seeds = [[] for _ in index.grams]
    return index


def needed(words: int, threshold: float) -> int:
    """Grams that a passage reaching ``threshold`` shares with an item of so many words, at least."""
    return math.ceil(threshold * words - 1e-9) - 1


def reach(words: int, threshold: float) -> int:
    """Words of the text that an alignment reaching ``threshold`` spans, at most."""
    return words + max(0, math.floor((1 - threshold) * words + 1e-9))


def gram_counts(docs: DataFrame, index: Index) -> np.ndarray:
    """Documents that hold each of the index's n-grams, over all ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(index.grams), np.int64)
        for batch in batches:
            for t in batch.column("text"):
                counts[np.unique(index.find(index.codes(t.as_py()))[1])] += 1
        g = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(g, pa.int64()), pa.array(counts[g], pa.int64())], ["g", "n"])

    out = np.zeros(len(index.grams), np.int64)
    for r in docs.select("text").mapInArrow(run, "g bigint, n bigint").groupBy("g").agg(F.sum("n").alias("n")).collect():
        out[r["g"]] = r["n"]
    return out


def choose_seeds(index: Index, counts: np.ndarray, threshold: float = THRESHOLD) -> Index:
    """Makes all of an item's grams its seeds but the commonest, as many as no leak can do with alone."""
    seeds: list[list[int]] = [[] for _ in index.grams]
    for k, own in index.own.items():
        spare = needed(len(index.items[k]), threshold) - 1
        grams, times = np.unique(own, return_counts=True)
        for at in np.lexsort((grams, -counts[grams])):
            spare -= int(times[at])
            if spare < 0:
                seeds[grams[at]].append(k)
    return replace(index, seeds=seeds)


def smith_waterman(item: np.ndarray, window: np.ndarray) -> tuple[float, int]:
    """Best local score and the end of its alignment in the window; a row at a time."""
    ramp = np.arange(1, len(window) + 1) * GAP
    row, best, end = np.zeros(len(window) + 1), 0.0, 0
    for w in item:
        gain = np.where(window == w, 1.0, -1.0)
        new = np.maximum(np.maximum(row[:-1] + gain, row[1:] - GAP), 0.0)
        new = np.maximum.accumulate(new + ramp) - ramp  # gaps along the window
        row = np.concatenate(([0.0], new))
        if (m := new.max()) > best:
            best, end = float(m), int(new.argmax()) + 1
    return best, end


def leaks(index: Index, text: str | None, threshold: float) -> list[tuple[int, float, int, int]]:
    """(item, score, first word, end word) of the best passage of each leaked item."""
    codes = index.codes(text)
    at, grams = index.find(codes)
    spans: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for k in {k for g in np.unique(grams).tolist() for k in index.seeds[g]}:
        m = len(index.items[k])
        least, most = needed(m, threshold), reach(m, threshold)
        if least < 1:  # a single word may do
            spans[k].append((0, len(codes)))
            continue
        p = at[np.isin(grams, index.own[k])]
        first, last = p[: max(0, len(p) - least + 1)], p[least - 1 :]
        close = last - first <= most - GRAM
        spans[k] += zip(np.maximum(0, last[close] + GRAM - most).tolist(), np.minimum(len(codes), first[close] + most).tolist(), strict=True)
    for k in index.short:
        item = index.items[k]
        if len(codes) >= len(item):
            same = np.logical_and.reduce([codes[i : len(codes) - len(item) + 1 + i] == c for i, c in enumerate(item)])
            if same.any():
                spans[k] += [(p, p + len(item)) for p in np.flatnonzero(same).tolist()]
    out = []
    for k, windows in spans.items():
        if not windows:
            continue
        item, best = index.items[k], (0.0, 0, 0)
        windows.sort()
        merged = [windows[0]]
        for a, b in windows[1:]:
            if a <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
            else:
                merged.append((a, b))
        for a, b in merged:
            window = codes[a:b]
            score, end = smith_waterman(item, window)
            if score / len(item) > best[0]:
                best = (score / len(item), max(a, a + end - len(item)), a + end)
        if best[0] >= threshold:
            out.append((k, *best))
    return out


def blocks_of(benchmark: DataFrame) -> list[DataFrame]:
    """Rows (item_id, text) of each block, dealt by hash."""
    items = benchmark.select("item_id", "text")
    told = items.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    blocks = max(-(-told["n"] // BLOCK_ITEMS), -(-(told["bytes"] or 0) // BLOCK_BYTES))
    number = F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, blocks)))
    return [items.filter(number == block) for block in range(blocks)]


def indexed(block: DataFrame, docs: DataFrame, threshold: float, width: int = WIDTH) -> Index:
    """The index of a block, its seeds chosen by their counts in ``docs``; collects the block."""
    index = build([(r["item_id"], r["text"]) for r in block.orderBy("item_id", "text").collect()], width)
    return choose_seeds(index, gram_counts(docs, index), threshold)


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH) -> DataFrame:
    """Rows (doc_id, item_id, score, start, end): leaks with their code points in the text."""
    spark = docs.sparkSession
    items = benchmark.select("item_id", "text")
    kinds = {f.name: f.dataType for f in [*docs.schema, *items.schema]}
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id {items.schema['item_id'].dataType.simpleString()}, score double, start bigint, end bigint"
    item_kind = to_arrow_type(kinds["item_id"])
    out = None
    for block in blocks_of(benchmark):
        index = indexed(block, docs, threshold, width)

        def run(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                owners, found = [], []
                for row, t in enumerate(batch.column("text")):
                    text = t.as_py()
                    if hits := leaks(index, text, threshold):
                        where = [m.span() for m in WORDS.finditer(text)]
                        for k, score, a, b in hits:
                            owners.append(row)
                            found.append((index.ids[k], score, where[a][0], where[b - 1][1]))
                cols = list(zip(*found, strict=True)) or [()] * 4
                kind = [item_kind, pa.float64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(owners, pa.int64())), *[pa.array(c, k) for c, k in zip(cols, kind, strict=True)]],
                    ["doc_id", "item_id", "score", "start", "end"])

        part = docs.select("doc_id", "text").mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema) if out is None else out


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` without a leak, all columns kept."""
    left = docs
    for number, block in enumerate(blocks_of(benchmark)):
        index = indexed(block, docs, threshold)

        def run(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([not leaks(index, t.as_py(), threshold) for t in batch.column("text")], pa.bool_()))

        left = left.mapInArrow(run, docs.schema)
        if number % 4 == 3:
            left = durable(left)
    return left
