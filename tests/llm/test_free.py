"""Toxicity, suffix dedup, decontamination, secrets, neighbours and SimHash against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import decontaminate, neighbours, queries, secrets, simhash, suffix_dedup, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, h string"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "clash", "clash") for i, t in texts], DOCS).repartition(3)


# --- toxicity


def test_toxicity_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    got = queries.op2_toxicity(spark, folder).collect()
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    known = [(labels[r["doc_id"]], r["predicted"]) for r in got if r["doc_id"] in labels and r["held_out"]]
    toxic, clean = [p for y, p in known if y], [p for y, p in known if not y]
    assert len(toxic) > 100 and sum(toxic) >= 0.9 * len(toxic) and sum(clean) <= 0.02 * len(clean)


def labelled(spark, texts, classes):
    """Documents outside the held-out fold, and their labels."""
    ids = [i for i in range(2 * len(texts) + 9) if zlib.crc32(str(i).encode()) % 4 != 2][: len(texts)]
    return docs(spark, list(zip(ids, texts, strict=True))), spark.createDataFrame([(i, 0, c) for i, c in zip(ids, classes, strict=True)], "doc_id long, quality int, toxic int")


def test_toxicity_learns_from_documents_alone(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(50)]
    said = lambda: " ".join(rng.choices(words, k=8))
    texts, classes = [], []
    for _ in range(400):
        bad = rng.random() < 0.3
        s = [said() for _ in range(rng.randrange(1, 8))]
        if bad:
            s[rng.randrange(len(s))] += " grublix"
        texts.append(". ".join(s))
        classes.append(int(bad))
    texts[0] = ". ".join([texts[0]] + [said() for _ in range(9000)])  # long texts train too
    m = toxicity.learn(*labelled(spark, texts[:300], classes[:300]))
    assert all((m.score(t) >= 0.3) == bool(c) for t, c in zip(texts[300:], classes[300:], strict=True))
    text = "all fine here. you GRUBLIX now. fine again"
    spans = m.offending(text)
    assert [text[a:b] for a, b, _ in spans] == [" you GRUBLIX now"]
    d = docs(spark, [(1, None), (2, ""), (3, "x " * 100_000), (None, "grublix"), (5, "a"), (5, "a")])
    got = {(r["doc_id"], r["predicted"]) for r in toxicity.score(d, m).collect()}
    assert got == {(1, 0), (2, 0), (3, 0), (None, 1), (5, 0)}
    assert toxicity.score(d, m).count() == 6 and toxicity.reject(d, m).count() == 5
    assert toxicity.score(docs(spark, []), m).count() == 0
    assert toxicity.learn(*labelled(spark, [], [])).score("x") < 0.01
    # Length alone says nothing: neither repeated nor different clean sentences add up.
    assert m.score("This is fine. " * 10_000) == pytest.approx(m.score("This is fine."))
    assert m.score(". ".join(f"fine {i}" for i in range(20_000))) < 0.1


def test_toxicity_scores_are_noisy_or(spark):
    m = toxicity.Model(-3.0, -2.0, {"bad": 1.5, "worse": 2.5, "terr*": 0.75})
    odds = lambda z: 1 / (1 + np.exp(-z))
    text = "Bad BAD day. fine! worse and bad\nterror, terrier. bad bad day"
    want = 1 - (1 - odds(-3.0)) * (1 - odds(-0.5)) ** 2 * (1 - odds(2.0)) * (1 - odds(-0.5))
    assert m.score(text) == pytest.approx(want)
    got = toxicity.score(docs(spark, [(1, text)]), m).first()
    assert got["score"] == pytest.approx(want)
    assert [text[r["start"] : r["end"]] for r in got["offending"]] == ["Bad BAD day", " worse and bad", "terror, terrier", " bad bad day"]


def test_toxicity_never_learns_the_held_out_fold(spark):
    d = docs(spark, [(i, f"t{i}") for i in range(100)] + [(0, "zz")])
    labels = spark.createDataFrame([(i, 0, i % 2) for i in range(100)] + [(None, 0, 1), (1, 0, None)], "doc_id long, quality int, toxic int")
    got = [(r["text"], r["y"]) for r in toxicity.sample(d, labels).collect()]
    assert {int(t[1:]) for t, _ in got} == {i for i in range(100) if zlib.crc32(str(i).encode()) % 4 != 2}
    assert all(c == int(t[1:]) % 2 for t, c in got)
    assert toxicity.sample(d, labels, 7).count() <= 7


# --- suffix dedup


def brute_removed(rows, length):
    seen, out = set(), []
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        b = (text or "").encode()
        mask = bytearray(len(b))
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            if w in seen:
                mask[s : s + length] = b"\1" * length
            seen.add(w)
        kept = bytes(c for c, m in zip(b, mask, strict=True) if not m)
        spans = len(re.findall(b"\1+", bytes(mask)))
        out.append((i, len(b), sum(mask), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("seed", "length", "gram", "anchor"), [(0, 40, 10, 10), (1, 40, 20, 18), (2, 100, 25, 18)])
def test_suffix_dedup_against_brute_force(spark, monkeypatch, seed, length, gram, anchor):
    """The last case has the parameters of the query; texts are worked on in several pieces."""
    monkeypatch.setattr(suffix_dedup, "PIECE", 150)
    rng = random.Random(seed)
    blocks = ["".join(rng.choice("abé ") for _ in range(rng.randrange(5, 3 * length // 2))) for _ in range(8)]
    rows = [(i, "".join(rng.choice(blocks) for _ in range(rng.randrange(1, 9)))) for i in range(40)]
    rows += [(100, None), (101, ""), (102, "a" * 500), (103, "ab" * 300), (104, "a" * (length - 1)), (105, rows[0][1]), (None, rows[1][1]), (-(1 << 63), rows[2][1])]
    got = suffix_dedup.removed_bytes(docs(spark, rows), length, gram, anchor)
    assert sorted((tuple(r)[:5] for r in got.collect()), key=str) == brute_removed(rows, length)


def test_suffix_dedup_repeated_rows_and_empty(spark):
    text = "".join(random.Random(9).choices("abcdef", k=150))
    got = suffix_dedup.removed_bytes(docs(spark, [(1, text), (1, text), (2, text), (3, "q")])).collect()
    assert sorted((r["doc_id"], r["n_removed"]) for r in got) == [(1, 0), (1, 150), (2, 150), (3, 0)]
    assert suffix_dedup.removed_bytes(docs(spark, [])).count() == 0


def test_suffix_dedup_pieces(monkeypatch, spark):
    monkeypatch.setattr(suffix_dedup, "PIECE", 64)
    rng = random.Random(3)
    data = np.frombuffer("".join(rng.choice("ab") for _ in range(1000)).encode(), np.uint8)
    whole = [x for part in suffix_dedup.text_anchors(data, 40, 10) for x in zip(part[3].tolist(), part[4].tolist(), strict=True)]
    assert [s for a, b in whole for s in range(a, b + 1)] == list(range(len(data) - 39))


# --- decontamination


def test_decontamination(spark):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(300)]
    said = lambda n: [rng.choice(words) for _ in range(n)]
    items = [(i, " ".join(said(rng.randrange(12, 30)))) for i in range(10)] + [(10, None), (11, "..."), (12, "tiny zebra")]
    bench = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, source string")
    rows, want = [], set()
    for i in range(60):
        body = said(80)
        if i % 3 == 0:
            k = rng.randrange(10)
            leak = items[k][1].split()
            if i % 2:
                leak[len(leak) // 2] = "edited"
                leak.pop(3)
            body[40:40] = [w.upper() + ("," if i % 4 else "") for w in leak]
            want.add((i, k))
        rows.append((i, " ".join(body)))
    rows += [(100, None), (101, ""), (102, "a TINY zebra!"), (None, items[0][1]), (103, "w1 " * 50_000)]
    want |= {(102, 12), (None, 0)}
    got = decontaminate.contaminated(docs(spark, rows), bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want
    texts = dict(rows)
    exact = [r for r in got if r["score"] == 1.0 and r["doc_id"] is not None]
    clean = lambda s: re.findall(r"\w+", s.lower())
    assert exact and all(clean(texts[r["doc_id"]][r["start"] : r["end"]]) == clean(dict(items)[r["item_id"]]) for r in exact)
    kept = decontaminate.clean(docs(spark, rows), bench)
    assert {r["doc_id"] for r in kept.collect()} == {i for i, _ in rows} - {i for i, _ in want}
    assert decontaminate.contaminated(docs(spark, []), bench).count() == 0
    assert decontaminate.contaminated(docs(spark, rows), bench.filter("false")).count() == 0


def test_decontamination_in_blocks(monkeypatch, spark):
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 2)
    items = [(i, " ".join(f"x{i}y{j}" for j in range(12))) for i in range(5)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    d = docs(spark, [(i, f"some {t} more") for i, t in items] + [(9, "clean text"), (10, items[0][1] + " and " + items[1][1])])
    got = decontaminate.contaminated(d, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(i, i) for i in range(5)} | {(10, 0), (10, 1)}
    assert {r["doc_id"] for r in decontaminate.clean(d, bench).collect()} == {9}


def test_decontamination_of_repeated_words_and_ties(spark):
    bench = spark.createDataFrame([(1, "the the the the the one two three four five"), (2, "the the the the the one two three four five")], "item_id long, text string")
    d = docs(spark, [(1, "the the the the the uno dos tres quattro cinque"), (2, "the the the the uno dos tres quattro cinque seis")])
    got = decontaminate.contaminated(d, bench).collect()
    assert sorted((r["doc_id"], r["item_id"], r["score"]) for r in got) == [(1, 1, 0.5), (1, 2, 0.5)]


def test_smith_waterman_against_table():
    rng = random.Random(11)
    for _ in range(50):
        a, b = [rng.randrange(4) for _ in range(7)], [rng.randrange(4) for _ in range(9)]
        h = [[0.0] * 10 for _ in range(8)]
        for i in range(1, 8):
            for j in range(1, 10):
                h[i][j] = max(0, h[i - 1][j - 1] + (1 if a[i - 1] == b[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
        assert decontaminate.smith_waterman(np.array(a), np.array(b))[0] == max(map(max, h))


def test_decontamination_finds_what_plain_alignment_finds(spark):
    rng = random.Random(17)
    items = [(i, " ".join(rng.choice([f"v{j}" for j in range(400)] + ["of", "the"] * 40) for _ in range(rng.randrange(12, 55)))) for i in range(12)]
    items += [(20, " ".join(f"q{j}" for j in range(50))), (21, " ".join(["hum"] * 30 + [f"r{j}" for j in range(20)])), (22, "one two three")]
    rows = [(500, " ".join("x" if j % 5 == 2 else f"q{j}" for j in range(50))),  # every fifth word replaced
            (501, " ".join(f"q{j}" + " x" * (j % 2) for j in range(50))),  # a word added after every second
            (502, "hum " * 30), (503, "see one two here")]
    for i in range(150):
        leak, body = items[i % 12][1].split(), rng.choices([f"v{j}" for j in range(400)], k=60)
        for _ in range(rng.randrange(len(leak) * 2 // 3)):
            at, way = rng.randrange(len(leak)), rng.randrange(3)
            leak[at : at + (way < 2)] = ["odd"] if way else []
        body[30:30] = leak
        rows.append((i, " ".join(body)))
    codes = {w: j for j, w in enumerate({w for _, t in items + rows for w in t.split()})}
    coded = lambda t: np.array([codes[w] for w in t.split()])
    score = {(i, k): decontaminate.smith_waterman(coded(t), coded(d))[0] / len(t.split()) for i, d in rows for k, t in items}
    want = {pair: s for pair, s in score.items() if s >= 0.5}
    assert {(500, 20), (501, 20), (502, 21), (503, 22)} <= set(want)
    assert sum(0.5 <= s < 0.56 for s in want.values()) > 5 and any(0.4 < s < 0.5 for s in score.values())
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contaminated(docs(spark, rows), bench).collect()
    assert {(r["doc_id"], r["item_id"]): r["score"] for r in got} == want
    assert {r["doc_id"] for r in decontaminate.clean(docs(spark, rows), bench).collect()} == {i for i, _ in rows} - {i for i, _ in want}


# --- secrets


def brute_base(text):
    word = re.compile(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    out = [(m.start(), 0, m.end()) for m in word.finditer(text) if len(m[1]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def test_secret_base_spans():
    rng = random.Random(5)
    bits = ["password", "PassWD", "token", "api_key", "APIKEY", "ſecret", "secret", '"', "'", " ", "=", ":", "abcdef1", "ab", "é", "\n", "AKIA", "ABCDEFGHIJ0123456789", "0123456789abcdef", "f" * 9, "."]
    for _ in range(2000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(1, 14)))
        assert secrets.base_spans(text) == brute_base(text), text


def test_secret_models_on_held_out_strings(spark):
    """Strings of the three-word shapes and of random alphabets, none of them trained."""
    folder = "/root/testdata/sf0.01"
    found = spark.read.parquet(f"{folder}/documents.parquet")
    m = secrets.train(found.filter("doc_id % 2 = 0"))
    ordinary = sorted({o for r in found.filter("doc_id % 2 = 1").collect() for o in secrets.labelled(r["text"] or "")[1] if len(o) >= secrets.LEAST_RUN})
    rng = random.Random(99)
    letters, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    drawn = ["".join(rng.choices(alphabet, k=rng.randrange(16, 41))) for alphabet in (digits + "abcdef", letters + letters.upper() + digits, letters.upper() + "234567", letters + digits + "-_") for _ in range(200)]
    hit = lambda s: bool([x for x in secrets.all_spans(f"see {s} here", m)[1] if x[1] in (2, 3)])
    caught, wrong = sum(map(hit, drawn)), sum(map(hit, ordinary))
    assert len(ordinary) > 1000 and caught >= 0.97 * len(drawn) and wrong <= 0.01 * len(ordinary)


def test_secret_models(spark):
    rng = random.Random(8)
    drawn = ["".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", k=32)) for _ in range(40)]
    plain = ["configuration_manager_name", "getConnectionTimeoutValue", "this-is-a-normal-identifier", "=" * 40, "12345678901234567890", "internationalization", "a" * 40]
    m = secrets.train(docs(spark, [(i, "the configuration of the connection manager has a normal value and a name for the timeout of this international identifier organization " + "get this value " * 20_000 * (i == 1)) for i in range(5)]))
    hit = lambda s: any(k == 3 for _, k, _ in secrets.all_spans(f"see {s} here", m)[1])
    assert sum(map(hit, drawn)) >= 38 and not any(map(hit, plain))
    rows = [(1, f"x {drawn[0]} y token={drawn[1]}"), (2, None), (3, ""), (None, "AKIA" + "A" * 16), (5, "z" * 300_000), (6, "a"), (6, "a")]
    got = secrets.scan(docs(spark, rows), m).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert by[1]["spans"] == f"markov:2:34,assign:37:{43 + 32}" and by[1]["base"] == "assign:37:75"
    assert by[2]["spans"] == "" and by[None]["n_access"] == 1 and by[5]["n_markov"] == 0
    assert secrets.scan(docs(spark, [])).count() == 0


def test_secret_runs_beside_base_spans():
    token = "Qz7xK2mV9bR4tY8wL3nP"
    text = f"{token}-AKIA{'A' * 16}/{token} tail"
    base = secrets.base_spans(text)
    assert [text[a:b] for a, b in secrets.free_runs(text, base)] == [f"{token}-", f"/{token}"]
    assert list(secrets.free_runs("short_run", [])) == []


# --- neighbours


def brute_nearest(rows, k):
    out = {}
    for q, v in rows:
        if q % 100 == 0:
            near = sorted((float(np.sqrt(((np.array(v) - np.array(w)) ** 2).sum())), i) for i, w in rows if i != q)[:k]
            out[q] = [(n + 1, i, d) for n, (d, i) in enumerate(near)]
    return out


def test_neighbours(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CELL_ROWS", 60)
    monkeypatch.setattr(neighbours, "LEAF", 16)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(8, 12))
    good = [(i, (centres[i % 8] + 0.1 * rng.normal(size=12)).astype(np.float32).astype(float).tolist()) for i in range(700)]
    good += [(1000 + i, good[0][1]) for i in range(150)]
    bad = [(2000, None), (2001, [0.0] * 12), (2002, [float("nan")] * 12), (2003, [1.0] * 5), (2004, [float("inf")] + [1.0] * 11), (2005, [None] * 12), (None, good[3][1])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in good + bad], "vec_id long, embedding array<float>, label int, cell string").repartition(5)
    got = defaultdict(list)
    for r in neighbours.nearest(df, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    want = brute_nearest(good, 10)
    assert set(got) == set(want)
    hits = sum(len({v for _, v, _ in got[q]} & {v for _, v, _ in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    assert [v for _, v, _ in got[0]] == [v for _, v, _ in want[0]]  # ties: the smaller ids
    assert all(abs(s - float(np.linalg.norm(np.array(dict(good)[q]) - np.array(dict(good)[v])))) < 1e-9 for q, rs in got.items() for _, v, s in rs)
    few = neighbours.nearest(df.filter("vec_id < 4 or vec_id = 100"), F.col("vec_id") % 100 == 0)
    assert Counter(r["query_id"] for r in few.collect()) == {0: 4, 100: 4}
    assert neighbours.nearest(df.filter("false"), F.lit(True)).count() == 0
    short = spark.createDataFrame([(3000 + i, [float(i), 1.0], 1, "x") for i in range(7)], df.schema)
    both = neighbours.nearest(df.unionByName(short), F.col("vec_id") % 100 == 0).filter("query_id in (0, 3000)").orderBy("query_id", "rank").collect()
    assert [r["vec_id"] for r in both if r["query_id"] == 3000] == [3001, 3002, 3003, 3004, 3005, 3006]
    assert [(r["rank"], r["vec_id"], r["score"]) for r in both if r["query_id"] == 0] == got[0]


def test_chi_square_quantile():
    assert abs(neighbours.chi_square_quantile(0.95, 8) - 15.507) < 1e-3
    assert abs(neighbours.chi_square_quantile(0.99, 2) - 9.210) < 1e-3


# --- SimHash


def brute_print(text, width):
    words = re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_against_brute_force(spark):
    rng = random.Random(6)
    base = [" ".join(rng.choices([f"Wört{i}\x1f" for i in range(60)], k=rng.randrange(0, 60))) for _ in range(25)]
    rows = []
    for i in range(120):
        words = rng.choice(base).split(" ")
        if words and rng.random() < 0.6:
            words[rng.randrange(len(words))] = "changed"
        rows.append((i, "\t".join(words)))
    rows += [(200, None), (201, ""), (202, " \n "), (203, "one two"), (203, "one two"), (None, "solo\x0bword"), (204, "x " * 30_000)]
    got = simhash.groups(simhash.fingerprints(docs(spark, rows))).collect()
    assert len(got) == len(rows)
    prints = [(i, brute_print(t, 4)) for i, t in rows]
    assert Counter((r["doc_id"], r["fp"] & (1 << 64) - 1) for r in got) == Counter(prints)
    kinds = {p for _, p in prints}
    root = {p: p for p in kinds}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in kinds:
        for b in kinds:
            if (a ^ b).bit_count() <= 4:
                root[find(a)] = find(b)
    least = {}
    for i, p in prints:
        if i is not None:
            least[find(p)] = min(i, least.get(find(p), i))
    assert Counter((r["doc_id"], r["component_id"]) for r in got) == Counter((i, least.get(find(p))) for i, p in prints)
    assert simhash.groups(simhash.fingerprints(docs(spark, []))).count() == 0


def test_links_find_every_close_pair(spark):
    rng = random.Random(12)
    prints = {rng.getrandbits(64) - (1 << 63) for _ in range(60)}
    for p in list(prints):
        for _ in range(3):
            q = p
            for b in rng.sample(range(64), rng.randrange(1, 7)):
                q ^= (1 << b) if b < 63 else -(1 << 63)
            prints.add(q)
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    for radius, segments in ((4, 3), (4, 2), (4, 4), (3, 2), (2, 5)):
        got = {(r["a"], r["b"]) for r in simhash.links(df, radius, segments).collect()}
        assert got == {(a, b) for a in prints for b in prints if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= radius}


def test_one_of_each(spark):
    rng = random.Random(13)
    words = [f"w{i}" for i in range(2000)]
    rows, groups = [], {}
    for g in range(30):
        body = rng.choices(words, k=rng.randrange(120, 300))
        for c in range(rng.randrange(1, 5)):
            copy = list(body)
            if c:
                for _ in range(len(body) // 100):
                    copy[rng.randrange(len(copy))] = "edit"
            rows.append((len(rows), " ".join(copy)))
            groups[len(rows) - 1] = g
    n = len(rows)
    rows += [(n, None), (n + 1, ""), (n + 2, "lone"), (n + 3, "twice same"), (n + 3, "twice same")]
    d = docs(spark, rows)
    kept = simhash.one_of_each(d)
    assert kept.columns == d.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert Counter(groups[i] for i in ids if i in groups) == Counter(set(groups.values()))
    assert ids.count(n + 3) == 1 and n + 2 in ids
    assert all(i == min(j for j in groups if groups[j] == groups[i]) for i in ids if i in groups)


def brute_kept(rows):
    sets = {}
    for i, t in rows:
        words = t.lower().split()
        sets[i] = {" ".join(words[j : j + 5]) for j in range(max(1, len(words) - 4))}
    least = {i: i for i in sets}

    def find(x):
        while least[x] != x:
            x = least[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                least[max(find(a), find(b))] = min(find(a), find(b))
    return {i for i in sets if find(i) == i}


def test_one_of_each_in_a_crowd(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CROWD", 50, raising=False)
    rng = random.Random(14)
    base, line = [f"b{i}" for i in range(100)], " ".join(f"hot{i}" for i in range(30))
    rows = []
    for i in range(400):
        copy = list(base)
        for at in rng.sample(range(10, 90, 10), 2):
            copy[at] = f"c{i}at{at}"
        rows.append((i, " ".join(copy)))
    rows[170] = (170, " ".join(base))  # similar to all, which are not to one another
    for i in range(400, 700, 3):
        body = " ".join(f"d{i}w{j}" for j in range(rng.randrange(5, 60)))
        rows += [(i, f"{body} {line}"), (i + 1, f"{line} {body}"), (i + 2, f"{body} {line} end")]
    want = brute_kept(rows)
    assert len([i for i in want if i < 400]) == 1
    assert {r["doc_id"] for r in simhash.one_of_each(docs(spark, rows)).collect()} == want


def test_one_of_each_of_short_texts(spark):
    rng = random.Random(15)
    rows = []
    for i in range(0, 400, 2):
        body = [f"s{i}w{j}" for j in range(8 + i // 10)]
        copy = [*body, "more"] if i % 4 else ["x" if j == len(body) // 2 else w for j, w in enumerate(body)]
        rows += [(i, " ".join(body)), (i + 1, " ".join(copy))]
    rows += [(400, "One  two"), (401, "one two"), (402, "one two three")]
    rng.shuffle(rows)
    want = brute_kept(rows)
    assert len(want) < 320
    assert {r["doc_id"] for r in simhash.one_of_each(docs(spark, rows)).collect()} == want


@pytest.mark.parametrize("kind", ["int", "smallint", "bigint", "decimal(10,0)", "string"])
def test_item_ids_keep_their_type(spark, kind):
    text = "one two three four five six seven eight nine ten"
    bench = spark.createDataFrame([(7, text), (None, text)], "item_id int, text string").withColumn("item_id", F.col("item_id").cast(kind))
    got = decontaminate.contaminated(spark.createDataFrame([(1, text), (2, "other words")], "doc_id long, text string"), bench)
    assert got.schema["item_id"].dataType.simpleString() == kind
    assert sorted((r["doc_id"], str(r["item_id"])) for r in got.collect()) == [(1, "7"), (1, "None")]
