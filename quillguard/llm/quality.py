"""Quality classifier: random-indexing word vectors pooled per document, a two-layer network, calibrated probabilities.

Random indexing: every document has a sparse random index vector, made from its text alone, and a word's vector is the
sum of the index vectors of the documents that hold it. Words fall into BUCKETS hash buckets, so the table of vectors
has one size for any corpus; it is summed over all documents, by task first and then by bucket, in whole numbers, so
the sum doesn't depend on order. A word counts by itself and by its shape ('THE!!' has the shape 'A!').

A document is pooled into the mean and the spread of its words' vectors, the lengths of both, its size, how many of its
words are distinct, and how often a word follows itself. The network
(one hidden layer) is fitted in numpy on at most SAMPLE labelled documents outside the held-out fold, those of the
smallest hashes; a fifth of them sets the temperature that divides its outputs. Scores read text and nothing else.

Null texts count as empty. Empty texts have a score like any other, very long ones are pooled whole. Repeated rows score
alike. Kept columns keep their values whatever their names (common.restored). Where labels of both kinds
are missing, every score is the share of good labels (0.5 without any). An empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillguard.llm.common import KEPT, carried, collect_blocks, fold_of, map_texts, restored, table

BUCKETS, DIMS, NONZERO, SAMPLE, HIDDEN, EPOCHS, ACCEPT, HELD_OUT = 1 << 14, 32, 6, 12_000, 24, 40, 0.3, 0
CACHE = 300_000
RUNS = (re.compile(rb"[A-Z\xc3]+"), re.compile(rb"[a-z\x80-\xff]+"), re.compile(rb"[0-9]+"), re.compile(rb"([^A-Za0-9])\1+"))


def bucket_of(unit: bytes) -> int:
    return zlib.crc32(unit) % BUCKETS


def shape_of(word: bytes) -> bytes:
    word = RUNS[2].sub(b"0", RUNS[1].sub(b"a", RUNS[0].sub(b"A", word)))
    return b"\0" + RUNS[3].sub(rb"\1", word)[:12]


class Bags:
    """Buckets of a text's words and shapes, with counts; what a word maps to is kept, at most CACHE words."""

    def __init__(self):
        self.kept: dict[bytes, tuple[int, int]] = {}

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray, float]:
        """Buckets, counts, and the share of words that fall where the word before them fell."""
        words = text.encode("utf-8", "replace").split()
        if len(self.kept) > CACHE:
            self.kept.clear()
        kept = self.kept
        for w in words:
            if w not in kept:
                kept[w] = (bucket_of(w), bucket_of(shape_of(w)))
        pairs = np.array([kept[w] for w in words], np.int32).reshape(-1, 2)
        counts = np.bincount(pairs.ravel(), minlength=0)
        found = np.flatnonzero(counts)
        return found, counts[found], float((pairs[1:, 0] == pairs[:-1, 0]).mean()) if len(pairs) > 1 else 0.0


def index_vector(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of a document's sparse random vector."""
    rng = np.random.Generator(np.random.PCG64(xxhash.xxh64_intdigest(text.encode("utf-8", "replace"))))
    return rng.permutation(DIMS)[:NONZERO], rng.integers(0, 2, NONZERO) * 2 - 1


def word_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """The table of word vectors, one row a bucket, each of length 1 (0 where no word fell)."""

    def make():
        sums, bags = np.zeros((BUCKETS, DIMS), np.int64), Bags()

        def add(texts):
            for t in texts:
                if t:
                    found, counts, _ = bags(t)
                    places, signs = index_vector(t)
                    weight = np.frexp(counts)[1]  # 1 + floor(log2(count))
                    sums[found[:, None], places] += weight[:, None] * signs

        def finish():
            used = np.flatnonzero(sums.any(1))
            for at in range(0, len(used), 4096):
                rows = used[at : at + 4096]
                yield [rows.tolist(), list(sums[rows])]

        return add, finish

    parts = collect_blocks(docs, make, "bucket int, v array<long>", text)
    total = parts.groupBy("bucket").agg(F.array(*(F.sum(F.col("v")[i]) for i in range(DIMS))).alias("v"))
    table_ = np.zeros((BUCKETS, DIMS))
    for r in total.toLocalIterator():  # BUCKETS rows
        table_[r.bucket] = r.v
    return (table_ / np.maximum(np.linalg.norm(table_, axis=1, keepdims=True), 1e-9)).astype(np.float32)


N_POOLED = 2 * DIMS + 5


def pool(vectors: np.ndarray, bag: tuple[np.ndarray, np.ndarray, float]) -> np.ndarray:
    found, counts, again = bag
    if not len(found):
        return np.zeros(N_POOLED)
    x, w = vectors[found].astype(np.float64), counts / counts.sum()
    mean = w @ x
    spread = np.sqrt(np.maximum(w @ x**2 - mean**2, 0))
    return np.concatenate([mean * 4, spread * 4, [np.linalg.norm(mean), np.linalg.norm(spread), np.log1p(counts.sum()) / 8, len(found) / np.sqrt(counts.sum()) / 4, again * 2]])


class Network:
    """tanh layer and a logistic output; temperature-calibrated."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.p = [rng.normal(0, 0.3, (N_POOLED, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.3, HIDDEN), np.zeros(1)]
        self.temperature = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -35, 35)))

    def fit(self, x: np.ndarray, y: np.ndarray, seed: int = 7) -> "Network":
        rng = np.random.default_rng(seed)
        order = rng.permutation(len(y))
        aside, used = order[: len(y) // 5], order[len(y) // 5 :]
        m, v, step = [np.zeros_like(a) for a in self.p], [np.zeros_like(a) for a in self.p], 0
        for _ in range(EPOCHS):
            rng.shuffle(used)
            for at in range(0, len(used), 64):
                i = used[at : at + 64]
                h = np.tanh(x[i] @ self.p[0] + self.p[1])
                d = (1 / (1 + np.exp(-np.clip(h @ self.p[2] + self.p[3], -35, 35))) - y[i]) / len(i)
                dh = np.outer(d, self.p[2]) * (1 - h**2)
                step += 1
                for k, g in enumerate((x[i].T @ dh + 1e-4 * self.p[0], dh.sum(0), h.T @ d, np.array([d.sum()]))):
                    m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g**2
                    self.p[k] = self.p[k] - 0.005 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        if len(set(y[aside])) == 2:
            z = self.logits(x[aside])
            loss = lambda t: np.logaddexp(0, np.where(y[aside] == 1, -z, z) / t).mean()
            self.temperature = float(min(np.geomspace(0.25, 8, 81), key=loss))
        return self


def training_labels(labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """At most `most` labelled ids outside the held-out fold; an id that is labelled both ways counts as bad."""
    known = labels.where(fold_of("doc_id") != HELD_OUT).groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality is not null")
    return known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def scored(docs: DataFrame, keep: list[str], trained_on: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """KEPT + score and predicted. trained_on: the documents that labels speak of; word vectors are summed over docs."""
    shared = docs.sparkSession.sparkContext.broadcast(word_vectors(docs, text))

    def pooled():
        bags = Bags()
        return lambda texts: [[pool(shared.value, bags(t)) for t in texts]]

    sample = trained_on.select("doc_id", "text").join(F.broadcast(training_labels(labels)), "doc_id")
    rows = map_texts(sample, pooled, "x array<double>", ["doc_id", "quality"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE).collect()
    x, y = np.array([r.x for r in rows]).reshape(-1, N_POOLED), np.array([r.quality for r in rows], np.float64)
    network = Network().fit(x, y) if len(set(y.tolist())) == 2 else None
    flat = float(y.mean()) if len(y) else 0.5

    def make():
        bags = Bags()

        def work(texts):
            if network is None:
                return [[flat] * len(texts)]
            return [network.score(np.stack([pool(shared.value, bags(t)) for t in texts]))]

        return work

    return map_texts(carried(docs, keep, text=F.col(text)), make, "score double", [KEPT]).withColumn("predicted", (F.col("score") >= ACCEPT).cast("int"))


def score_quality(docs: DataFrame, keep: list[str], trained_on: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """keep + score and predicted, learned from the labels of trained_on."""
    return restored(scored(docs, keep, trained_on, labels, text), ["score", "predicted"])


def accepted(docs: DataFrame, trained_on: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs, all columns, that aren't rejected."""
    return restored(scored(docs, docs.columns, trained_on, labels, text).where("predicted = 1"), [])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: the quality score of every document."""
    docs = table(spark, sf_dir, "documents")
    found = score_quality(docs, ["doc_id"], docs, table(spark, sf_dir, "labels"))
    return found.select("doc_id", (fold_of("doc_id") == HELD_OUT).alias("held_out"), "score", "predicted")
