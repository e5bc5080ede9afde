"""Secret scans: fixed patterns, and character Markov models compared by log-likelihood ratio.

The base patterns find assignments, access keys and long hexadecimal runs.  The models find
what no pattern names: two first-order character chains, one of random strings and one of
ordinary identifiers, are trained from labelled samples.  A run of 16 or more token characters,
or what base spans leave of one, is a secret if its log-likelihood ratio passes ``THRESHOLD``
and ``PER_CHAR`` for each of its characters, so that length alone does not make a secret.

Samples of a bounded number of documents, whole and of any size, train the chains: the values
of base spans are labelled random, other words and runs, and identifiers of three words as
they follow each other, ordinary.  Generated random strings and numbers, and runs of one character,
are added.  Tasks count pairs of characters; only these counts go to the driver.

Defined results: null and empty texts have no spans (the digest of the empty string);
offsets are code points, ends exclusive; repeated rows stay rows; a null doc_id is carried;
an empty table gives no rows and the models then rest on the generated samples; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "markov")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
WORD = re.compile(r"[A-Za-z0-9+/_=-]{4,}")
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-."
CODE = np.full(128, len(ALPHABET), np.int64)
CODE[[ord(c) for c in ALPHABET]] = np.arange(len(ALPHABET))
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]+$")
PLAIN = re.compile(r"[A-Za-z]{2,}")
SAMPLE_DOCS = 1000  # documents, about, that the labelled samples are drawn from
LEAST_RUN = 16
THRESHOLD, PER_CHAR = 8.0, 0.35  # nats


@dataclass(frozen=True)
class Models:
    first: np.ndarray  # log-ratio of a first character
    step: np.ndarray  # log-ratio of a character after another

    def ratio(self, text: str) -> float:
        codes = CODE[np.frombuffer(text.encode("ascii"), np.uint8)]
        return float(self.first[codes[0]] + self.step[codes[:-1], codes[1:]].sum())


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end), in order of start, then kind."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def free_runs(text: str, spans: list[tuple[int, int, int]], pattern: re.Pattern = RUN, least: int = LEAST_RUN) -> Iterator[tuple[int, int]]:
    """(start, end) of the runs of at least ``least`` characters, without what the spans cover."""
    ordered = sorted((a, b) for a, _, b in spans)
    at = 0
    for m in pattern.finditer(text):
        begin = m.start()
        while at < len(ordered) and ordered[at][1] <= begin:
            at += 1
        near = at
        while near < len(ordered) and ordered[near][0] < m.end():
            if ordered[near][0] - begin >= least:
                yield begin, ordered[near][0]
            begin = max(begin, ordered[near][1])
            near += 1
        if m.end() - begin >= least:
            yield begin, m.end()


def labelled(text: str) -> tuple[list[str], list[str]]:
    """Random and ordinary strings of a text, each once, so that a repetitive text does not decide the models."""
    spans = base_spans(text)
    drawn = [m[0] for a, _, b in spans if (m := TOKEN.search(text[a:b]))]
    ordinary = [text[a:b] for a, b in free_runs(text, spans, WORD, 4)]
    words = [w for o in ordinary for w in PLAIN.findall(o)]
    for i in range(0, len(words) - 2, 3):
        three = words[i : i + 3]
        shape = i // 3 % 6
        if shape < 3:
            ordinary.append("_-/"[shape].join(three).lower())
        elif shape == 3:
            ordinary.append("".join(w.capitalize() for w in three))
        elif shape == 4:
            ordinary.append(three[0].lower() + "".join(w.capitalize() for w in three[1:]))
        else:
            ordinary.append(f"{'_'.join(three).upper()}_{i % 1000}")
    return list(dict.fromkeys(drawn)), list(dict.fromkeys(ordinary))


def pair_counts(samples: list[str]) -> np.ndarray:
    """How often each character follows each other; a line feed stands for the ends."""
    n = len(ALPHABET) + 1
    codes = CODE[np.frombuffer(("\n" + "\n".join(samples) + "\n").encode("ascii"), np.uint8)]
    return np.bincount(codes[:-1] * n + codes[1:], minlength=n * n).reshape(n, n)


def generated(seed: int = 7) -> tuple[list[str], list[str]]:
    rng = random.Random(seed)
    alphabets = ("0123456789abcdef", ALPHABET[:62], ALPHABET[:62], ALPHABET[:64], ALPHABET[26:62], ALPHABET[:26] + "0123456789")
    drawn = ["".join(rng.choices(alphabet, k=rng.randint(16, 48))) for alphabet in alphabets for _ in range(1000)]
    return drawn, ["".join(rng.choices("0123456789", k=rng.randint(12, 24))) for _ in range(1000)]


def models(random_pairs: np.ndarray, ordinary_pairs: np.ndarray, smooth: float = 0.5, repeats: float = 0.1) -> Models:
    """Models of the counts; in ordinary strings, a share ``repeats`` of characters is taken to repeat the one before."""
    ordinary_pairs = ordinary_pairs + np.diag(repeats * ordinary_pairs.sum(axis=1) + 1)

    def chain(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first, step = pairs[-1] + smooth, pairs + smooth
        return np.log(first / first.sum()), np.log(step / step.sum(axis=1, keepdims=True))

    (f1, s1), (f0, s0) = chain(random_pairs), chain(ordinary_pairs)
    return Models(f1 - f0, s1 - s0)


def train(docs: DataFrame, rows: int = SAMPLE_DOCS) -> Models:
    """Models of about ``rows`` documents, those of the smallest hashes, and of the generated strings."""
    share = rows / max(1, docs.count())
    some = docs.filter(F.octet_length("text") > 0).select("doc_id", "text")
    if share < 1:
        some = some.filter(F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 11) < F.lit(int(share * 2**53)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column("text"):
                for label, samples in enumerate(labelled(text.as_py())):
                    counts = pair_counts(samples)
                    a, b = np.nonzero(counts)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), label, np.int32)), pa.array(a), pa.array(b), pa.array(counts[a, b])], ["label", "a", "b", "n"])

    told = [pair_counts(x) for x in generated()]
    for r in some.select("text").mapInArrow(run, "label int, a bigint, b bigint, n bigint").groupBy("label", "a", "b").agg(F.sum("n").alias("n")).collect():
        told[r["label"]][r["a"], r["b"]] += r["n"]
    return models(*told)


def all_spans(text: str, models: Models, threshold: float = THRESHOLD, per_char: float = PER_CHAR) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    base = base_spans(text)
    more = [(a, 3, b) for a, b in free_runs(text, base) if models.ratio(text[a:b]) > max(threshold, per_char * (b - a))]
    return base, sorted(base + more)


def write_spans(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame, models: Models | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Rows (doc_id, base, spans, n_assign, n_access, n_hex, n_markov); spans as kind:start:end."""
    trained = models or train(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t in batch.column("text"):
                base, spans = all_spans(t.as_py() or "", trained, threshold)
                kinds = [k for _, k, _ in spans]
                out.append((write_spans(base), write_spans(spans), *[kinds.count(k) for k in range(4)]))
            columns = list(zip(*out, strict=True)) or [()] * 6
            kinds = [pa.string(), pa.string(), *[pa.int64()] * 4]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]],
                ["doc_id", "base", "spans", "n_assign", "n_access", "n_hex", "n_markov"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, base string, spans string, n_assign bigint, n_access bigint, n_hex bigint, n_markov bigint")


def digest(base: str) -> str:
    return hashlib.sha256(base.encode()).hexdigest()
