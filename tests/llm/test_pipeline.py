from __future__ import annotations

import random
from collections import Counter

import corpus_pipeline
from tessera.llm import decontaminate, mixing, toxicity


def test_pipeline_runs_whole(spark, small):
    got = corpus_pipeline.run(spark, small)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "mixing", "sharding"]
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert got.columns == [*docs.columns, "shard", "slot"]
    rows = got.collect()
    known = {tuple(r) for r in docs.collect()}
    assert {tuple(r)[:5] for r in rows} <= known
    assert len({r["text"] for r in rows}) == len(rows) > docs.count() // 2
    labels = {r["doc_id"] for r in spark.read.parquet(f"{small}/labels.parquet").filter("toxic = 1").collect()}
    assert len(labels & {r["doc_id"] for r in rows}) <= len(labels) // 3


def near_copies_dropped(rows):
    """Of each group linked by a Jaccard similarity of 0.8 of five-word shingles, the smallest doc_id stays."""
    sets, root = {}, {}
    for r in rows:
        words = (r["text"] or "").lower().split()
        sets[r["doc_id"]], root[r["doc_id"]] = {" ".join(words[j : j + 5]) for j in range(max(1, len(words) - 4))}, r["doc_id"]

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return [r for r in rows if find(r["doc_id"]) == r["doc_id"]]


def test_pipeline_against_brute_force(spark, small):
    """Every decision again, one document at a time: plain scores, all pairs, all alignments, and the laws of mix and shards."""
    docs, bench = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/benchmark.parquet").collect()
    model = toxicity.learn(docs, spark.read.parquet(f"{small}/labels.parquet"))
    rows = [r for r in docs.collect() if model.score(r["text"] or "") < toxicity.THRESHOLD]
    rows = near_copies_dropped(rows)
    index = decontaminate.build([(b["item_id"], b["text"]) for b in bench])

    def leaked(text):
        codes = index.codes(text)
        return any(decontaminate.smith_waterman(item, codes)[0] >= decontaminate.THRESHOLD * len(item) for item in index.items.values())

    want = {r["doc_id"] for r in rows if not leaked(r["text"])}
    got = corpus_pipeline.run(spark, small).collect()
    assert {r["doc_id"] for r in got} == want and len(got) == len(want)
    sizes = Counter(r["shard"] for r in got)
    assert set(sizes) == set(range(corpus_pipeline.SHARDS)) and max(sizes.values()) - min(sizes.values()) <= 1
    assert all(sorted(r["slot"] for r in got if r["shard"] == s) == list(range(n)) for s, n in sizes.items())


def test_stages_take_an_empty_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").filter("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, small).count() == 0


def test_slots_follow_the_mix(spark, small, tmp_path):
    docs, rng = spark.read.parquet(f"{small}/documents.parquet"), random.Random(18)
    rows = [{"doc_id": i, "text": " ".join(f"w{rng.randrange(9999)}" for _ in range(20)), "lang": "en", "source": "abc"[min(2, i % 6 // 2 * (i % 5 > 0))], "n_chars": 1} for i in range(2000)]
    spark.createDataFrame([tuple(r[c] for c in docs.columns) for r in rows], docs.schema).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{small}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    got = [r["source"] for r in corpus_pipeline.run(spark, str(tmp_path)).orderBy("shard", "slot").collect()]
    counts, block = Counter(got), mixing.BLOCK_ROWS
    parts = mixing.tempered_parts({f"={s}" if s is not None else "null": n for s, n in counts.items()})
    share = {s: parts[f"={s}" if s is not None else "null"] / sum(parts.values()) for s in counts}
    assert len(counts) > 1
    seen = Counter()
    for n in range(block, len(got), block):
        seen.update(got[n - block : n])
        if any(counts[s] - seen[s] < block for s in counts):  # a source runs dry
            break
        assert all(abs(seen[s] - n * share[s]) < block for s in counts)
    assert n > len(got) // 2
