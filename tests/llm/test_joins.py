"""N-gram join, source divergence and fill-in-middle against brute force, with the odd inputs of each."""

from __future__ import annotations

import hashlib
import os
import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.llm import divergence, fill_middle, ngram_join, queries
from tests.test_registry import rows

DOCS = "doc_id long, text string, lang string, source string"


def docs(spark, data):
    return spark.createDataFrame(data, DOCS)


@pytest.mark.parametrize("name", ["op12_divergence", "op13_fill_in_middle"])
def test_query_equals_sql(spark, small, name):
    con = duckdb.connect()
    for f in os.listdir(small):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{small}/{f}{'/*.parquet' if os.path.isdir(f'{small}/{f}') else ''}'")
    got = queries.queries()[name](spark, small)
    told = con.execute(queries.oracle_sql()[name])
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows([d[0] for d in told.description], told.fetchall())


# --- n-gram join


def gram_set(text, width=3):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def linked(data, percent, width=3):
    """Brute force: all pairs of rows."""
    sets, up = [gram_set(t, width) for _, t in data], list(range(len(data)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                up[top(i)] = top(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(data):
        least[top(i)].append(d)
    own = lambda ids: min((d for d in ids if d is not None), default=None)
    return Counter((d, len(x), own(least[top(i)]) if x else d) for i, ((d, _), x) in enumerate(zip(data, sets, strict=True)))


def near_texts(seed, bases=8):
    rng = random.Random(seed)
    vocabulary = [f"W{i}" for i in range(40)]
    out = []
    for _ in range(bases):
        base = [rng.choice(vocabulary) for _ in range(rng.choice((3, 12, 31, 60, 150)))]
        for _ in range(rng.choice((1, 4, 25))):
            text = list(base)
            for _ in range(rng.choice((0, 1, 1, 2))):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                text.append("end")
            out.append((len(out), " ".join(text).lower() if rng.random() < 0.2 else "\n ".join(text)))
    return out


@pytest.mark.parametrize(("seed", "percent", "cell", "path"), [(1, 90, 256, 16), (2, 90, 4, 2), (3, 80, 8, 5)])
def test_ngram_groups_equal_brute_force(spark, monkeypatch, seed, percent, cell, path):
    monkeypatch.setattr(ngram_join, "CELL", cell)
    monkeypatch.setattr(ngram_join, "PATH", path)
    data = near_texts(seed)
    got = ngram_join.groups(docs(spark, [(d, t, None, None) for d, t in data]), percent=percent)
    assert Counter(map(tuple, got.collect())) == linked(data, percent)


def test_ngram_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "PLACE_GRAMS", 50)  # pairs that hang together are dealt out
    long = " ".join(f"l{i}" for i in range(30_000))
    data = [(1, None), (2, ""), (3, " \t\n"), (4, "a"), (5, "A"), (6, "a b"), (7, "a  B"), (8, "b a"), (9, "é É"), (9, "é É"), (10, "é é"), (None, "a b c"), (11, "A b c"), (None, "only null"), (12, long), (13, long + " x"),
            (14, long[: len(long) // 2]), (15, "a b c"), *[(100 + i, "hot text of many rows") for i in range(60)], (20, "x\u00a0y z"), (21, "x y z")]
    df = docs(spark, [(d, t, "en", "s") for d, t in data]).withColumns({c: F.lit("own") for c in ("node", "n", "th", "digest", "component_id")})
    assert Counter(map(tuple, ngram_join.groups(df).collect())) == linked(data, 90)
    assert ngram_join.groups(docs(spark, [])).count() == 0


def test_star_of_near_copies_is_one_group(spark, monkeypatch):
    """Copies that are near to the base only, in a crowd of several cells."""
    monkeypatch.setattr(ngram_join, "CELL", 16)
    rng = random.Random(4)
    base = [f"b{i}" for i in range(80)]
    data = [(0, " ".join(base))]
    for i in range(1, 80):
        text = list(base)
        text[rng.randrange(80)] = f"own{i}"
        data.append((i, " ".join(text)))
    got = ngram_join.groups(docs(spark, [(d, t, None, None) for d, t in data])).collect()
    assert Counter(map(tuple, got)) == linked(data, 90) and {r["component_id"] for r in got} == {0}


# --- source divergence


def audited(data, least_docs, top):
    """Brute force with whole numbers."""
    counts, found = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in data:
        words = [w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        counts[lang or "", source or ""].update(words)
        found[lang or ""].update(set(words))
    out = set()
    for lang in found:
        kept = [t for t, n in found[lang].items() if n >= least_docs]
        groups = {s: c for (x, s), c in counts.items() if x == lang}
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[k] for k in kept) + len(kept)) for t in kept}  # noqa: B023, E731
        p, q = {s: share(c) for s, c in groups.items()}, share(sum(groups.values(), Counter()))
        for s in groups:
            pairs = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in groups if o != s]
            terms = [((p[s][t] - q[t]) ** 2 // q[t], t) for t in kept if groups[s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                for rank, (value, item) in enumerate(sorted(items, key=lambda x: (-x[0], x[1].encode()))[:most], 1):
                    out.add((lang, s, part, item, value, rank))
    return out


@pytest.mark.parametrize(("light", "cells"), [(32, 1 << 20), (0, 50), (1000, 7)])
def test_divergence_equals_brute_force(spark, monkeypatch, light, cells):
    monkeypatch.setattr(divergence, "LIGHT_GROUPS", light)
    monkeypatch.setattr(divergence, "TILE_CELLS", cells)
    monkeypatch.setattr(divergence, "FLUSH", 20)
    rng = random.Random(light)
    words = [f"w{chr(97 + i % 26)}{'x' * (i // 26)}" for i in range(60)] + ["É", "é", "ß", "Zeta"]
    data = [(i, " ".join(rng.choices(words, k=rng.randrange(0, 30), weights=range(1, 65))) + rng.choice(("", "!", " 3d\x00")), rng.choice(("en", "de", None)), f"s{int(rng.random() ** 2 * 12)}") for i in range(150)]
    data += [(500, None, "en", "empty"), (501, "", "fr", None), (502, "lone words here", "it", "only"), (503, "x" * 100_000, "fr", "long")] + [(600, "same SAME text", "fr", "hot")] * 40
    got = {tuple(r) for r in divergence.audit(docs(spark, data).withColumns({c: F.lit("own") for c in ("term", "count", "rank", "idx")}), top=5).select("lang", "source", "part", "item", "value", "rank").collect()}
    assert got == audited(data, 3, 5)


def test_divergence_empty(spark):
    assert divergence.audit(docs(spark, [])).count() == 0
    alone = divergence.audit(docs(spark, [(1, "a b", "en", "x"), (2, "c", "en", "y")])).collect()
    assert {tuple(r) for r in alone} == {("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)}


# --- fill-in-middle


def middled(doc_id, text, rate=100, spm=50, unit=r"[^\n]*\n|[^\n]+"):
    text = text or ""
    units = re.findall(unit, text)
    told = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(told[i * 8 : i * 8 + 8], 16) for i in range(4)]
    lo, hi = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:lo]), "".join(units[lo:hi]), "".join(units[hi:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return (doc_id, len(units), "plain", text, None, None)
    form = "spm" if h[3] % 100 < spm else "psm"
    return (doc_id, len(units), form, f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}", len(p), len(m))


ODD = [None, "", "\n", "\n\n\n", "one", "one\n", "a\nb", "a\n\nb\n", "\x01\x02\x01d\x02e\n\x02\x02d\x01\n", "x <P> y", "<M>", "<\nP>\n<S", "S>\n<P\n>", "é\n😀\n漢字", "$0 \\1\n$1", "\r\n\r\n", "tail\x02", "word " * 40_000 + "\n" + "z" * 300_000]


@pytest.mark.parametrize(("rate", "spm", "unit"), [(100, 50, "line"), (60, 100, "line"), (100, 0, "word")])
def test_fill_in_middle_equals_brute_force(spark, rate, spm, unit):
    data = [(n + 100 * k, t) for k in range(6) for n, t in enumerate(ODD)] + [(None, "a\nb\nc\n"), (7, "twice\n"), (7, "twice\n")]
    df = docs(spark, [(d, t, "en", "s") for d, t in data]).withColumns({c: F.lit("own") for c in ("output", "form", "n")})
    made = fill_middle.fill_in_middle(df, rate=rate, spm_share=spm, unit=unit, keep=("lang",)).withColumn("back", fill_middle.restored(F.col("output"), F.col("form")))
    got = made.collect()
    pattern = {"line": r"[^\n]*\n|[^\n]+", "word": r"[^ \t\n\x0b\f\r]*[ \t\n\x0b\f\r]+|[^ \t\n\x0b\f\r]+"}[unit]
    assert Counter((r["doc_id"], r["n"], r["form"], r["output"], r["prefix_chars"], r["middle_chars"]) for r in got) == Counter(middled(d, t, rate, spm, pattern) for d, t in data)
    assert Counter((r["doc_id"], r["back"]) for r in got) == Counter((d, t or "") for d, t in data)


def test_fill_in_middle_markers(spark):
    df = docs(spark, [(i, "ab\ncd\nef\n", None, None) for i in range(40)])
    made = fill_middle.fill_in_middle(df, markers=("[pre]", "[suf]", "[mid]"))
    back = {r[0] for r in made.select(fill_middle.restored(F.col("output"), F.col("form"), ("[pre]", "[suf]", "[mid]"))).collect()}
    assert back == {"ab\ncd\nef\n"} and {r["form"] for r in made.collect()} == {"psm", "spm"}
    for markers in (("", "a", "b"), ("<P>", "<P>", "<M>"), ("ab", "bc", "x"), ("<P>", "<P><S>", "<M>"), ("aba", "x", "y")):
        with pytest.raises(ValueError):
            fill_middle.fill_in_middle(df, markers=markers)
    with pytest.raises(ValueError, match="rename"):
        fill_middle.fill_in_middle(df.withColumn("n", F.lit(1)), keep=("n",))
    assert fill_middle.fill_in_middle(docs(spark, [])).count() == 0


def test_every_text_is_counted_for_the_order_of_shingles(spark):
    """One shingle that few texts share among many texts: a sample of the texts may not see it."""
    from tessera.llm import simhash

    rows = [(i, f"a{i} b{i} c{i} d{i} e{i}" + (" one two three four five" if i % 2_000 == 7 else "")) for i in range(12_000)]
    levels = simhash._crowding(spark.createDataFrame(rows, "doc_id long, text string"), 5)
    shared, own = (simhash.shingle_hashes(t, 5)[0] for t in ("one two three four five", "a1 b1 c1 d1 e1"))
    at = lambda x: int(levels[int(x) >> (64 - simhash.LEVEL_BITS)])
    assert at(shared) == 21 and at(own) == 0  # ceil(8 * log2(6)): six texts


def test_open_cells_hold_every_open_pair(spark, monkeypatch):
    """The connected part of a crowd meets the others only, and what comes too late in all sets meets nothing."""
    from tessera.llm import simhash

    monkeypatch.setattr(ngram_join, "CELL", 16)
    roots = {i: 0 if i < 90 else i for i in range(120)}
    shared = spark.createDataFrame([(t, i, at, 120) for i in roots for t, at in ((1, 5), (2, 70))], "token long, node long, at int, crowd long")
    rooted = spark.createDataFrame([(i, 390, r) for i, r in roots.items()], "node long, n long, root long")
    cells = defaultdict(set)
    got = simhash._open_cells(shared, rooted, 80).collect()
    for r in got:
        assert r["token"] == 1
        cells[r["x"], r["y"]].add(r["node"])
    met = {(a, b) for c in cells.values() for a in c for b in c if a < b}
    assert all((a, b) in met for a in roots for b in roots if a < b and roots[a] != roots[b])
    assert len(got) == 90 * 2 + 30 * (6 + 2)  # all parts with all would be 120 * 8
