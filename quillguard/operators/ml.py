"""Linear text classifiers on hashed features, trained and applied by Spark's own learners."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 18
#: Bytes of text that are counted together, and the longest term that is hashed beside others.
SLICE, LONG = 1 << 22, 512


def mixed(k):
    k = k * 0xCC9E2D51 & 0xFFFFFFFF
    return (k << 15 & 0xFFFFFFFF | k >> 17) * 0x1B873593 & 0xFFFFFFFF


def stirred(h, k):
    h = h ^ mixed(k)
    return (h << 13 & 0xFFFFFFFF | h >> 19) * 5 + 0xE6546B64 & 0xFFFFFFFF


def buckets(terms: pa.Array) -> np.ndarray:
    """Each term's bucket: the one that Spark's HashingTF gives it (32-bit Murmur3 of its bytes, seed 42)."""
    ends = np.frombuffer(terms.buffers()[1], np.int32)[terms.offset : terms.offset + len(terms) + 1].astype(np.int64)
    data = np.concatenate([np.frombuffer(terms.buffers()[2] or b"", np.uint8), np.zeros(4, np.uint8)])
    size = np.diff(ends)
    order = np.argsort(-size, kind="stable")  # so those that still have bytes come first
    start, left, h = ends[:-1][order], size[order], np.full(len(terms), 42, np.uint64)
    far = int(np.count_nonzero(left > LONG))
    for i in range(far):
        x = 42
        for k in data[start[i] : start[i] + left[i] // 4 * 4].view("<u4").tolist():
            x = stirred(x, k)
        h[i] = x
    at = lambda p, j: data[p + j].astype(np.uint64) << np.uint64(8 * j)
    for j in range(int(left[far] if far < len(left) else 0) // 4):
        some = slice(far, int(np.count_nonzero(left >= 4 * (j + 1))))
        p = start[some] + 4 * j
        h[some] = stirred(h[some], at(p, 0) | at(p, 1) | at(p, 2) | at(p, 3))
    tail, p = left % 4, start + left // 4 * 4
    h ^= mixed(sum(np.where(tail > j, at(p, j), np.uint64(0)) for j in range(3))) ^ left.astype(np.uint64)
    h = (h ^ h >> np.uint64(16)) * np.uint64(0x85EBCA6B) & np.uint64(0xFFFFFFFF)
    h = (h ^ h >> np.uint64(13)) * np.uint64(0xC2B2AE35) & np.uint64(0xFFFFFFFF)
    out = np.empty(len(terms), np.int64)
    out[order] = (h ^ h >> np.uint64(16)) & np.uint64((1 << BITS) - 1)
    return out


def runs(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start, start + 1, ... n numbers of each, one behind another."""
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())


def threes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all runs of three letters of the words (a shorter word is one), and how many each has."""
    letters = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), np.uint32)
    size = pc.utf8_length(words).to_numpy().astype(np.int64)
    n, last = np.maximum(size - 2, 1), np.cumsum(size)
    at, end, letters = runs(last - size, n), np.repeat(last, n), np.append(letters, np.zeros(2, np.uint32)).astype(np.int64)
    one = letters[at] << 42 | np.where(at + 1 < end, letters[at + 1], 0) << 21 | np.where(at + 2 < end, letters[at + 2], 0)
    some, which = np.unique(one, return_inverse=True)
    spelt = np.stack([np.full(len(some), ord("3")), np.full(len(some), ord("_")), some >> 42, some >> 21 & 0x1FFFFF, some & 0x1FFFFF], 1).astype("<u4")
    return buckets(pa.array(spelt.view("<U5").ravel(), pa.string()))[which], n


def counted(texts: pa.Array) -> pa.Array:
    """Sparse vectors of the terms of texts whose words stand between blanks."""
    lists = pc.split_pattern(texts, " ")
    words, row = pc.list_flatten(lists), pc.list_parent_indices(lists)
    held = pc.not_equal(words, "")
    words, row = words.filter(held).dictionary_encode(), row.filter(held).to_numpy().astype(np.int64)
    known, word = words.dictionary, words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    keys = np.zeros(0, np.int64)
    if len(word):
        # a text's last word makes a pair with nothing
        then = np.where(np.append(row[1:] == row[:-1], False), np.append(word[1:], 0), len(known))
        pairs, which = np.unique(word * (len(known) + 1) + then, return_inverse=True)
        second = pc.take(pa.concat_arrays([known, pa.array([None], pa.string())]), pa.array(pairs % (len(known) + 1)))
        paired = buckets(pc.binary_join_element_wise("2", pc.take(known, pa.array(pairs // (len(known) + 1))), second, "_", null_handling="skip"))[which]
        three, n = threes(known)
        inner = three[runs((np.cumsum(n) - n)[word], n[word])]
        keys = np.concatenate([row << BITS | buckets(known)[word], row << BITS | paired, np.repeat(row, n[word]) << BITS | inner])
    keys, times = np.unique(keys, return_counts=True)
    ends = pa.array(np.searchsorted(keys >> BITS, np.arange(len(texts) + 1)), pa.int32())
    place, times = pa.array(keys & (1 << BITS) - 1, pa.int32()), pa.array(times, pa.float64())
    sparse = [pa.array(np.full(len(texts), x), k) for x, k in ((0, pa.int8()), (1 << BITS, pa.int32()))]
    return pa.StructArray.from_arrays([*sparse, pa.ListArray.from_arrays(ends, place), pa.ListArray.from_arrays(ends, times)], ["type", "size", "indices", "values"])


@F.arrow_udf(VectorUDT())
def term_counts(texts: pa.Array) -> pa.Array:
    """counted, of a few MB of texts at a time."""
    texts = texts.cast(pa.string())
    part = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)) // SLICE
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]
    return pa.concat_arrays([counted(texts.slice(a, b - a)) for a, b in zip(cuts, cuts[1:])])


def terms(text: Column) -> Column:
    """A vector that counts words, pairs of words and runs of three letters, marked by kind, by the hash bucket of each. It equals
    HashingTF's of an array of these strings, which is never made: it would be many times its text."""
    flat = F.lower(F.coalesce(text, F.lit("")))
    return term_counts(F.regexp_replace(flat, r"[^\p{L}\p{N}]+", " "))


def train(rows: DataFrame, rounds: int = 25) -> PipelineModel:
    """A model of (terms, label): unit length, L2-regularised logistic regression. The learner keeps what its rounds read as blocks
    of a few MB, on disk where memory ends."""
    stages = [Normalizer(inputCol="terms", outputCol="__features"), LogisticRegression(featuresCol="__features", labelCol="label", maxIter=rounds, regParam=1e-4)]
    return Pipeline(stages=stages).fit(rows)


def probability(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Adds p, the chance of label 1."""
    return model.transform(rows).withColumn("p", vector_to_array("probability")[1]).drop("__features", "rawPrediction", "probability", "prediction")


def worst_window(model: PipelineModel, df: DataFrame, key: str, text: str, size: int = 240, step: int = 120) -> DataFrame:
    """key, p: the largest chance over a text's overlapping windows; partial maxima before the shuffle."""
    from quillguard.functions.text import windows

    pieces = df.select(key, F.explode(windows(F.col(text), size, step)).alias("w")).select(key, terms(F.col("w")).alias("terms"))
    return probability(model, pieces).groupBy(key).agg(F.max("p").alias("p"))


def confusion(scored: DataFrame, cutoffs: list[float]) -> DataFrame:
    """Per cutoff: tp, fp, fn, tn, precision, recall, f1 of (label, p), in one pass over the rows."""
    at = scored.select("label", "p", F.explode(F.array(*map(F.lit, cutoffs))).alias("cutoff"))
    yes, hit = F.col("label") == 1, F.col("p") >= F.col("cutoff")
    c = at.groupBy("cutoff").agg(F.count_if(yes & hit).alias("tp"), F.count_if(~yes & hit).alias("fp"), F.count_if(yes & ~hit).alias("fn"), F.count_if(~yes & ~hit).alias("tn"))
    return c.withColumns({"precision": F.round(F.expr("try_divide(tp, tp + fp)"), 4), "recall": F.round(F.expr("try_divide(tp, tp + fn)"), 4), "f1": F.round(F.expr("try_divide(2.0D * tp, 2 * tp + fp + fn)"), 4)})



