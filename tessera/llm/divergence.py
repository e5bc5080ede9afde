"""Source divergence audit: how far the word use of each source lies from that of the others of its language.

Each language keeps the terms that occur in at least ``least_docs`` of its documents (V of them).
A group is a (lang, source); with N the number of kept term occurrences in a group, a term that
occurs c times there has p = 1 + floor(10^9 * (c + 1) / (N + V)), and
f = floor((p - q)^2 / q) tells how far p is from another group's q.  The audit gives f summed
over all kept terms for each ordered pair of groups, and each group's terms that stand out most
against the whole language.

The sum over pairs of groups is split by how many groups a term occurs in.  *Heavy* terms, those
of many groups, are dealt into dense tiles of groups x terms, and numpy adds up f for all pairs of
a tile.  *Light* terms, those of few, are mostly absent: every pair starts from the sum as if all
light terms were absent in both groups; a histogram of each group's light p corrects that for
what one group has, and pairs of postings of one term (at most LIGHT_GROUPS postings) correct it
where both have the term.  All of it is whole-number arithmetic, so the partial sums add up to
exactly the plain sum.

Defined results: a null text, lang or source is ''; a group without terms is a group; a language
without kept terms has value 0 for all its pairs and no term rows; a lone source has no pairs;
repeated rows count again; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.llm.common import BROADCAST_ROWS, durable

SCALE = 1_000_000_000
LIGHT_GROUPS = 32  # groups at most in which a light term occurs
TILE_CELLS = 1 << 20  # groups x terms of a dense tile, about
FLUSH = 200_000  # counted terms after which a task hands its counts on
#: Letters A-Z become small, other ASCII ends a term, all else is part of one.
TERM_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
COUNTS = "lang string, source string, term string, docs bigint, count bigint"


def term_counts(docs: DataFrame) -> DataFrame:
    """Rows (lang, source, term, docs, count); a row with a null term for every group.

    Counts are added up within a task before they are shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = defaultdict(dict), 0

        def flush() -> pa.RecordBatch:
            langs, sources, terms, found, times = [], [], [], [], []
            for (lang, source), words in held.items():
                n = len(words) + 1
                langs += [lang] * n
                sources += [source] * n
                terms += [None, *words]
                found += [0, *[x[0] for x in words.values()]]
                times += [0, *[x[1] for x in words.values()]]
            held.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(langs, pa.string()), pa.array(sources, pa.string()), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(found, pa.int64()), pa.array(times, pa.int64())],
                ["lang", "source", "term", "docs", "count"])

        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), texts, strict=True):
                own = {}
                for w in text.as_py().translate(TERM_BYTES).split():
                    own[w] = own.get(w, 0) + 1
                words = held[lang, source]
                size -= len(words)
                for w, c in own.items():
                    if (x := words.get(w)) is None:
                        words[w] = [1, c]
                    else:
                        x[0] += 1
                        x[1] += c
                size += len(words)
                if size > FLUSH:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    bare = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    dealt = bare.mapInArrow(run, COUNTS).repartition("lang", "term")  # all that follows goes by term, too
    return dealt.groupBy("lang", "source", "term").agg(F.sum("docs").alias("docs"), F.sum("count").alias("count"))


def share(count: Column | str, total: Column | str, terms: Column | str) -> Column:
    """p of a term that occurs ``count`` times among ``total``, exact at any size."""
    wide = [F.col(c).cast("decimal(19,0)") if isinstance(c, str) else c.cast("decimal(19,0)") for c in (count, total, terms)]
    part = F.lit(SCALE).cast("decimal(10,0)") * (wide[0] + F.lit(1).cast("decimal(1,0)"))
    return F.lit(1).cast("long") + F.call_function("div", part, wide[1] + wide[2])


def apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _tile_sums(left: pa.Table, right: pa.Table) -> pa.Table:
    """Sums of f over a tile's terms for all ordered pairs of its language's groups."""
    if not len(left):
        return pa.table({"lang": [], "a": [], "b": [], "value": []}, PAIR_SUMS)
    base = np.zeros(len(right), np.int64)
    base[right["idx"].to_numpy()] = right["p0"].to_numpy()
    terms = left["term"].combine_chunks().dictionary_encode()
    tile = np.repeat(base[:, None], len(terms.dictionary), axis=1)
    tile[left["idx"].to_numpy(), terms.indices.to_numpy()] = left["p"].to_numpy()
    sums = [(((tile - q) ** 2) // q).sum(axis=1) for q in tile]  # row b: all a against it
    n = len(base)
    a, b = np.tile(np.arange(n), n), np.repeat(np.arange(n), n)
    lang = pa.array([left["lang"][0].as_py()] * (n * n), pa.string())
    return pa.table({"lang": lang, "a": a, "b": b, "value": np.concatenate(sums)}, PAIR_SUMS)


PAIR_SUMS = pa.schema([("lang", pa.string()), ("a", pa.int64()), ("b", pa.int64()), ("value", pa.int64())])


def _pair_sums(postings: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows (lang, a, b, value): parts of the sums of f, by the numbers of the groups.

    ``postings``: lang, term, idx, p, p0, in_groups, n_groups; ``groups``: lang, idx, p0, n_groups, terms.
    """
    heavy = F.col("in_groups") > F.least(F.lit(LIGHT_GROUPS), F.floor(F.col("n_groups") / 4))
    dense, light = postings.filter(heavy), postings.filter(~heavy)

    # heavy terms: dense tiles
    sizes = durable(dense.groupBy("lang").agg(F.count_distinct("term").alias("heavy")))
    groups = groups.join(sizes, "lang", "left").withColumn("heavy", F.coalesce("heavy", F.lit(0)))
    tiles = F.ceil(F.col("heavy") * F.col("n_groups") / TILE_CELLS)
    left = dense.join(groups.select("lang", tiles.alias("tiles")).distinct(), "lang").select("lang", F.pmod(F.xxhash64("term"), F.col("tiles")).alias("tile"), "term", "idx", "p")
    right = groups.filter("heavy > 0").select(F.col("lang").alias("lang"), F.explode(F.sequence(F.lit(0).cast("long"), tiles - 1)).alias("tile"), F.col("idx").alias("idx"), "p0")
    dense_sums = left.groupBy("lang", "tile").cogroup(right.groupBy("lang", "tile")).applyInArrow(_tile_sums, "lang string, a bigint, b bigint, value bigint")

    # light terms, as if absent everywhere
    a, b = groups.alias("a"), groups.alias("b")
    pairs = a.join(b, (F.col("a.lang") == F.col("b.lang")) & (F.col("a.idx") != F.col("b.idx")))
    told = [F.col("a.lang").alias("lang"), F.col("a.idx").alias("a"), F.col("b.idx").alias("b")]
    base = pairs.select(*told, ((F.col("a.terms") - F.col("a.heavy")) * apart(F.col("a.p0"), F.col("b.p0"))).alias("value"))
    base = base.filter(F.col("value").isNotNull())
    # ... corrected for what one of two groups has
    hist = durable(light.groupBy("lang", "idx", "p", "p0").agg(F.count("*").alias("n")))
    h, g = hist.alias("h"), groups.alias("g")
    one = h.join(g, (F.col("h.lang") == F.col("g.lang")) & (F.col("h.idx") != F.col("g.idx")))
    p, p0, q0 = F.col("h.p"), F.col("h.p0"), F.col("g.p0")
    one = one.select(F.col("h.lang").alias("lang"), F.inline(F.array(
        F.struct(F.col("h.idx").alias("a"), F.col("g.idx").alias("b"), (F.col("h.n") * (apart(p, q0) - apart(p0, q0))).alias("value")),
        F.struct(F.col("g.idx").alias("a"), F.col("h.idx").alias("b"), (F.col("h.n") * (apart(q0, p) - apart(q0, p0))).alias("value")))))
    # ... and where both have the term
    lists = light.groupBy("lang", "term").agg(F.collect_list(F.struct("idx", "p", "p0")).alias("l")).filter(F.size("l") > 1)
    both = lists.select("lang", "l", F.explode("l").alias("x")).select("lang", "x", F.explode("l").alias("y")).filter("x.idx <> y.idx")
    xp, x0, yp, y0 = F.col("x.p"), F.col("x.p0"), F.col("y.p"), F.col("y.p0")
    both = both.select("lang", F.col("x.idx").alias("a"), F.col("y.idx").alias("b"), (apart(xp, yp) - apart(xp, y0) - apart(x0, yp) + apart(x0, y0)).alias("value"))
    return dense_sums.filter("a <> b").unionByName(base).unionByName(one).unionByName(both)


def audit(docs: DataFrame, least_docs: int = 3, top: int = 200) -> DataFrame:
    """Rows (lang, source, part, item, value, rank).

    Part ``pair``: item is each other source of the language, value f summed over all kept terms.
    Part ``term``: item is a term that the group uses more than its language, to ``top`` ranks.
    """
    by = W.partitionBy("lang", "term")
    counts = term_counts(docs).withColumns({
        "in_docs": F.sum("docs").over(by), "term_total": F.sum("count").over(by), "in_groups": F.count("*").over(by),
        "leads": F.row_number().over(by.orderBy("source")) == 1})
    counts = durable(counts.filter(F.col("term").isNull() | (F.col("in_docs") >= least_docs)).drop("docs", "in_docs"))
    kept = counts.filter("term is not null")
    sums = kept.groupBy("lang", "source").agg(F.sum("count").alias("total"))
    langs = kept.groupBy("lang").agg(F.count_if("leads").alias("terms"), F.sum("count").alias("lang_total"))
    groups = counts.filter("term is null").select("lang", "source").join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select("lang", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "terms", "lang_total")])
    p0 = F.when(F.col("terms") > 0, share(F.lit(0), F.col("total"), F.col("terms")))
    by = W.partitionBy("lang")
    groups = durable(groups.withColumns({
        "p0": p0, "idx": (F.row_number().over(by.orderBy("source")) - 1).cast("long"), "n_groups": F.count("*").over(by)}))
    told = F.broadcast(groups) if groups.count() <= BROADCAST_ROWS else groups
    postings = kept.join(told, ["lang", "source"]).select(
        "lang", "source", "idx", "term", "p0", "in_groups", "n_groups",
        share("count", "total", "terms").alias("p"), share("term_total", "lang_total", "terms").alias("q"))

    pair = _pair_sums(postings, groups).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    g = groups.select("lang", "idx", "source")
    every = g.alias("x").join(g.alias("y"), (F.col("x.lang") == F.col("y.lang")) & (F.col("x.idx") != F.col("y.idx")))
    every = every.select(F.col("x.lang").alias("lang"), F.col("x.idx").alias("a"), F.col("y.idx").alias("b"), F.col("x.source").alias("source"), F.col("y.source").alias("item"))
    pair = every.join(pair, ["lang", "a", "b"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))
    term = postings.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), apart(F.col("p"), F.col("q")).alias("value"))
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pair = pair.withColumn("rank", F.row_number().over(order))
    return pair.unionByName(term.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top))
