"""Periodic runs of words, after Ellert and Fischer: Lyndon arrays over an ordered alphabet, without suffix structures or hashes.

A run is a stretch of consecutive words with smallest period q that no neighbouring word extends keeping that period. Each run
of two periods or more begins a Lyndon root at some word: under one of the two orders of the alphabet (any order of the words
will do, here that of first appearance; and its reverse) the next smaller suffix behind a root's first word lies one period
on. So next smaller suffixes under both orders, and how far each agrees with its own suffix, give every run.

Suffixes are compared from left to right, each against the words before it that no smaller suffix has closed yet. How far two
suffixes agree is read off what earlier comparisons have matched: the stretch that reaches furthest is a copy of an earlier
one, whose comparisons are known; words are only compared beyond its end, so each word once in all.

Before that, texts are split at words that a run of so many periods can't hold: those that occur less often in their stretch.
What is left of ordinary prose is next to nothing; what is left of a periodic text is all of it.

Null and empty texts have no words, no runs and collapse to ''. Repeated rows each give a row. Very long texts are read whole,
in memory proportional to them. An empty table gives an empty result. Columns of any names are carried.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillguard.llm.common import KEPT, WORD, carried, map_texts, restored, table

PERIODS, SHORTEST, PEELS = 4, 6, 12


def next_smaller(x: list[int]) -> tuple[list[int], list[int]]:
    """For each place the next one whose suffix is smaller (len(x) where none is), and how many items both suffixes share.
    The end is smaller than any item."""
    n = len(x)
    after, shared = [n] * n, [0] * n  # the next smaller suffix of each place
    before, common = [-1] * n, [0] * n  # the previous smaller one, and what both share
    reach = began = back = 0  # x[began:reach] equals what stands `back` places earlier
    for r in range(1, n):
        at = last = r - 1
        k = 0
        while True:
            known = 0
            exact = False
            if at != last:  # at is the previous smaller suffix of last, which shares k with r
                known = common[last]
                if known != k:
                    known = known if known < k else k
                    exact = True
            if not exact and r + known < reach:
                q = r - back
                a = at - back if at >= began else at
                if 0 <= a < q:
                    y = shared[a] if after[a] == q else common[q] if before[q] == a else -1
                    if y >= 0:
                        if r + y < reach:
                            known = y
                            exact = True
                        else:
                            known = reach - r
            k = known
            if not exact:
                i, j = at + k, r + k
                while j < n and x[i] == x[j]:
                    i += 1
                    j += 1
                k = j - r
                if j > reach:
                    reach, began, back = j, r, r - at
            if r + k < n and x[at + k] < x[r + k]:
                before[r], common[r] = at, k
                break
            after[at], shared[at] = r, k
            last, at = at, before[at]
            if at < 0:
                break
    return after, shared


def runs(x: list[int], periods: int = 2, shortest: int = 2) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of so many periods and items or more, in order."""
    found, n = set(), len(x)
    for items in (x, [-v for v in x]):
        after, shared = next_smaller(items)
        for i, (r, k) in enumerate(zip(after, shared)):
            p = r - i
            need = periods * p if periods * p > shortest else shortest
            # the leftmost root of a run is less than a period from its start
            if r < n and 2 * p + k > need and not (i >= p and after[i - p] == i and shared[i - p] >= p):
                left = 0
                while left < p and i > left and x[i - 1 - left] == x[r - 1 - left]:
                    left += 1
                if left + p + k >= need:
                    found.add((i - left, left + p + k, p))
    return sorted(found)


def stretches(ids: np.ndarray, owner: np.ndarray, periods: int, shortest: int) -> list[np.ndarray]:
    """Places of ids, in stretches of one owner that may hold a run: every item occurs there often enough."""
    at = np.arange(len(ids))
    for _ in range(PEELS):
        if not len(at):
            return []
        _, inverse, n = np.unique(owner * (int(ids.max()) + 1) + ids[at], return_inverse=True, return_counts=True)
        often = n[inverse] >= periods
        at, owner = at[often], owner[often]
        cut = np.flatnonzero((np.diff(at) != 1) | (np.diff(owner) != 0)) + 1
        size = np.diff(np.concatenate([[0], cut, [len(at)]]))
        long = np.repeat(size >= shortest, size)
        owner = np.repeat(np.arange(len(size)), size)[long]
        at = at[long]
        if often.all() and long.all():
            break
    return np.split(at, np.flatnonzero(np.diff(owner)) + 1) if len(at) else []


def runs_of(texts: list[str], periods: int = PERIODS, shortest: int = SHORTEST) -> tuple[list[list[tuple[int, int, int]]], list[str]]:
    """The runs of each text, and the texts with only the first period of each run left."""
    words = [t.encode("utf-8", "replace").split() for t in texts]
    number: dict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    sizes = np.array([len(w) for w in words], np.int64)
    first = np.concatenate([[0], np.cumsum(sizes)])
    ids = np.fromiter((i for w in words for i in map(number.__getitem__, w)), np.int64, int(first[-1]))
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    dropped: dict[int, np.ndarray] = {}
    for at in stretches(ids, np.repeat(np.arange(len(texts)), sizes), periods, shortest):
        doc = int(np.searchsorted(first, at[0], "right")) - 1
        base = int(at[0] - first[doc])
        for start, length, period in runs(ids[at].tolist(), periods, shortest):
            found[doc].append((base + start, length, period))
            gone = dropped.setdefault(doc, np.zeros(sizes[doc], bool))
            gone[base + start + period : base + start + length] = True
    left = [b" ".join(w) if i not in dropped else b" ".join([x for x, gone in zip(w, dropped[i].tolist()) if not gone]) for i, w in enumerate(words)]
    return found, [x.decode("utf-8", "replace") for x in left]


def with_runs(docs: DataFrame, keep: list[str], text: str = "text", periods: int = PERIODS, shortest: int = SHORTEST) -> DataFrame:
    """keep, runs (array<struct<start,length,period>> in words, by start and period), and collapsed: the words, one blank between
    them, without those that a run repeats."""

    def make():
        def work(texts):
            found, left = runs_of(texts, periods, shortest)
            flat = [r for f in found for r in f]
            each = [pa.array([r[i] for r in flat], pa.int64()) for i in range(3)]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(f) for f in found])]), pa.int32()), pa.StructArray.from_arrays(each, ["start", "length", "period"]))
            return [lists, pa.array(left, pa.string())]

        return work

    rows = carried(docs, keep, text=F.col(f"`{text}`"))
    return restored(map_texts(rows, make, "runs array<struct<start:long,length:long,period:long>>, collapsed string", [KEPT]), ["runs", "collapsed"])


def digests(found: DataFrame) -> DataFrame:
    """n_runs, the run of the most periods (ties: the first), and the digests of runs and collapsed text."""
    r = F.col("runs")
    none = F.lit(None).cast("struct<start:long,length:long,period:long>")
    more = lambda best, x: F.when(best.isNull() | (x["length"] * best["period"] > best["length"] * x["period"]), x).otherwise(best)
    lines = F.array_join(F.transform(r, lambda x: F.concat(F.concat_ws(",", x["start"].cast("string"), x["length"].cast("string"), x["period"].cast("string")), F.lit("\n"))), "")
    out = found.withColumn("__best", F.aggregate(r, none, more))
    exponent = F.expr("(1000 * __best.length) div __best.period")
    return out.withColumns({"n_runs": F.size(r).cast("long"), **{c: F.col(f"__best.{c}") for c in ("start", "length", "period")}, "exponent_milli": exponent, "runs_sha256": F.sha2(lines.cast("binary"), 256), "collapsed_sha256": F.sha2(F.col("collapsed").cast("binary"), 256)}).drop("__best", "runs", "collapsed")


def repeated(docs: DataFrame) -> DataFrame:
    """doc_id, text: in a tenth of the texts, by their id's checksum, all words from one on repeat a period (a null id counts
    as the text '')."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), (h % 10 == 0).alias("__told"), F.floor(h / 10).alias("__g"))
    rows = rows.withColumn("__w", F.when(F.col("__told"), F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), F.lit(0)))).withColumn("__n", F.size("__w"))
    rows = rows.withColumn("__a", F.when(F.col("__n") > 0, F.col("__g") % F.col("__n"))).withColumn("__p", F.expr("1 + (__n - __a) div (3 + __g % 8)"))
    told = F.transform("__w", lambda w, i: F.when(i < F.col("__a"), w).otherwise(F.get("__w", (F.col("__a") + (i - F.col("__a")) % F.col("__p")).cast("int"))))
    return rows.select("doc_id", F.when(F.col("__n") > 0, F.array_join(told, " ")).otherwise(F.col("text")).alias("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: runs of four periods and six words or more in every document, and its text without their repeats."""
    return digests(with_runs(repeated(table(spark, sf_dir, "documents")), ["doc_id"]))
