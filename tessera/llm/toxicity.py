"""Toxicity by multiple-instance learning: a document is toxic if any of its sentences is.

A sentence with telling words has a logistic score over these words and their four- and
five-letter beginnings; a document's score is the leaky noisy-or of its different sentences,
1 - (1 - leak) prod(1 - p).  Sentences without a telling word and repeated sentences add
nothing, so that length alone never makes a document toxic.  Weights are learned from
document labels alone, by gradient descent on the noisy-or likelihood over a bounded sample
of labelled rows; the sentence scores then locate the offending sentences.

Training takes the texts, whole and of any size, of at most ``SAMPLE_ROWS`` labelled documents
in hash order.  Tasks reduce them to how many documents hold each feature, and then to the
features of each sentence; no text goes to the driver.  Features are telling if toxic documents
hold them more often than chance allows: by a Chernoff bound, at most ``BY_CHANCE`` of all features
of the sample would pass without telling anything; with more, the model learns the noise of
the labels.  Scoring reads every whole text.  Only texts are
inputs of a score.

Defined results: a null or empty text has the score of the leak; labels with a null doc_id or
class are left out, of several for a document the largest holds; of several texts of a
labelled document the least in byte order trains; repeated rows stay rows; without labels of both
classes every score is 0; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import durable, hash_sample

SAMPLE_ROWS = 4000
BY_CHANCE = 200
THRESHOLD = 0.3
SENTENCE = re.compile(r"[^.!?\n]+")
WORDS = re.compile(r"\w+")
CACHE = 200_000


def held_out(doc_id: str = "doc_id") -> Column:
    """The fold whose labels are never learned: crc32(doc_id as text) mod 4 is 2."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(4)) == 2, F.lit(False))


def features(word: str) -> tuple[str, ...]:
    return (word, word[:4] + "*", word[:5] + "*") if len(word) > 5 else (word, word[:4] + "*") if len(word) > 4 else (word,)


@dataclass
class Model:
    leak: float  # log-odds of a document without telling sentences
    bias: float
    weights: dict[str, float]

    def __post_init__(self) -> None:
        self.known: dict[str, float] = {}

    def word(self, word: str) -> float:
        w = self.known.get(word)
        if w is None:
            if len(self.known) >= CACHE:
                self.known.clear()
            w = self.known[word] = sum(self.weights.get(f, 0.0) for f in features(word))
        return w

    def sentence(self, said: str) -> float:
        """Sum of the weights of its different words; 0 if none is telling."""
        return sum(map(self.word, dict.fromkeys(WORDS.findall(said))))

    def score(self, text: str) -> float:
        told = [w for said in dict.fromkeys(SENTENCE.findall(text.lower())) if (w := self.sentence(said))]
        odds = np.append(self.bias + np.array(told), self.leak)
        return float(-np.expm1(-np.logaddexp(0.0, odds).sum()))

    def offending(self, text: str, least: float = THRESHOLD) -> list[tuple[int, int, float]]:
        """(start, end, score), in code points, of the sentences that score ``least`` or more; without any, of the best."""
        told = [(m.start(), m.end(), w) for m in SENTENCE.finditer(text) if (w := self.sentence(m[0].lower()))]
        out = [(a, b, float(1.0 / (1.0 + np.exp(-np.clip(self.bias + w, -60, 60))))) for a, b, w in told]
        return [x for x in out if x[2] >= least] or sorted(out, key=lambda x: (-x[2], x[0]))[:1]


def train(owner: list[int], bags: list[list[int]], classes: list[int], k: int, rounds: int = 200, rate: float = 0.1, decay: float = 1e-3) -> np.ndarray:
    """Weights of k features, then bias and leak: noisy-or maximum likelihood with a small quadratic penalty (Adam, full batch).

    ``bags`` has the features of each sentence, ``owner`` its document, ``classes`` the documents' labels.
    """
    y, docs = np.asarray(classes, float), np.asarray(owner, np.int64)
    rows = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
    cols = np.array([f for b in bags for f in b], np.int64)
    w, step = np.zeros(k + 2), (np.zeros(k + 2), np.zeros(k + 2))
    w[k:] = -4.0
    for t in range(1, rounds + 1):
        z = w[k] + np.bincount(rows, w[cols], minlength=len(docs))
        p = np.clip(-np.expm1(-np.bincount(docs, np.logaddexp(0, z), minlength=len(y)) - np.logaddexp(0, w[k + 1])), 1e-9, 1.0)
        weight = np.where(y > 0, -(1 - p) / p, 1.0)
        pull = weight[docs] / (1 + np.exp(-z))
        lean = weight.sum() / (1 + np.exp(-w[k + 1]))
        g = np.concatenate((np.bincount(cols, pull[rows], minlength=k) + decay * len(y) / 100 * w[:k], [pull.sum(), lean])) / len(y)
        step[0][:] = 0.9 * step[0] + 0.1 * g
        step[1][:] = 0.999 * step[1] + 0.001 * g * g
        w -= rate * (step[0] / (1 - 0.9**t)) / (np.sqrt(step[1] / (1 - 0.999**t)) + 1e-9)
    return w


def sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """Rows (text, y): labelled texts outside the held-out fold, at most ``rows``."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out())
    known = known.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("y")).filter("y in (0, 1)")
    some = hash_sample(known, "doc_id", rows, known.count())
    drawn = docs.filter(F.octet_length("text") > 0).select("doc_id", "text").join(F.broadcast(some), "doc_id")  # at most ``rows`` ids
    return drawn.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y")).select("text", "y")


def learn(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """The model of a bounded sample of the labels."""
    drawn = durable(sample(docs, labels, rows))
    sizes = {r["y"]: r["n"] for r in drawn.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return Model(-60.0, -60.0, {})

    def holds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, y in zip(batch.column("text"), batch.column("y").to_pylist(), strict=True):
                found = sorted({f for w in set(WORDS.findall(text.as_py().lower())) for f in features(w)})
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array([y] * len(found), pa.int32())], ["f", "y"])

    seen = durable(drawn.mapInArrow(holds, "f string, y int").groupBy("f").agg(F.sum("y").alias("n1"), F.count("*").alias("n")).filter("n > 1"))
    evidence = float(np.log(max(1.0, seen.count() / BY_CHANCE)))
    base, share = sizes[1] / (sizes[0] + sizes[1]), F.col("n1") / F.col("n")
    apart = share * F.log(share / base) + F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - base))).otherwise(0.0)
    seen = seen.filter((share > base) & (F.col("n") * apart >= evidence))
    telling = sorted(r["f"] for r in seen.collect())  # words of the sample at most
    place = {f: i for i, f in enumerate(telling)}

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = []
            for text in batch.column("text"):
                bags = Counter()
                for said in set(SENTENCE.findall(text.as_py().lower())):
                    bag = tuple(sorted(place[f] for w in set(WORDS.findall(said)) for f in features(w) if f in place))
                    bags[bag] += bool(bag)
                lists.append([list(b) for b, n in sorted(bags.items()) for _ in range(n)])
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(lists, pa.list_(pa.list_(pa.int32())))], ["y", "bags"])

    reduced = sorted((r["y"], r["bags"]) for r in drawn.mapInArrow(told, "y int, bags array<array<int>>").collect())
    w = train([d for d, (_, bags) in enumerate(reduced) for _ in bags], [b for _, bags in reduced for b in bags], [y for y, _ in reduced], len(telling))
    return Model(float(w[-1]), float(w[-2]), {f: float(v) for f, v in zip(telling, w, strict=False) if abs(v) > 1e-4})


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """Rows (doc_id, score, predicted, offending), offending an array of (start, end, score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column("text")]
            scores = [model.score(t) for t in texts]
            where = [[{"start": a, "end": b, "score": p} for a, b, p in model.offending(t)] if s >= threshold else [] for t, s in zip(texts, scores, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32()), pa.array(where, place)],
                ["doc_id", "score", "predicted", "offending"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, predicted int, offending array<struct<start: bigint, end: bigint, score: double>>")


def reject(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, all columns kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([model.score(t.as_py() or "") < threshold for t in batch.column("text")], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
