"""Mixing sources to target weights by hash-threshold histograms.

Each source has a target of words. A document's hash decides: all documents are taken floor(target / source size) times,
and those below the source's hash threshold once more. The threshold is found without sorting: words are summed by
source and hash bucket, the bucket where the running sum passes the budget is the boundary, and only the boundary is
dealt into finer buckets, level by level, until it holds a single hash. Thresholds are nested: a larger budget keeps
every document of a smaller one.

The driver holds one row per source (the given weights are per source too) and never anything per document. Sums are
partial before they are shuffled, so a source with a third of all rows is no larger than any other.

Null texts have size 0; a null source is a source of its own, last in order. Equal rows (same id and text) have equal
hashes and are taken alike. A source without words has target 0. An empty table gives an empty result. Very long texts are
counted whole. Kept columns keep their values whatever their names (common.restored); others are ignored. Reruns agree:
hashes depend on the row alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from quillguard.llm.common import KEPT, carried, restored, table, word_count, written

WEIGHTS, SHARE, MOST = (5.0, 2.0, 1.0), 1.5, 2.0
BITS, LEVEL = 60, 10  # of the hash, and of each level's buckets
PLAN = "source string, source_size long, target double, times int, below long"


def targets(sizes: dict[str | None, int], weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> dict[str | None, float]:
    """Words to take per source: shares by weight, cut at most times the source's size, the rest dealt again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, out = share * sum(sizes.values()), list(order), {}
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if unit * weight[s] > most * sizes[s]]
        if not full:
            return out | {s: unit * weight[s] for s in open_}
        out |= {s: most * sizes[s] for s in full}
        left -= sum(out[s] for s in full)
        open_ = [s for s in open_ if s not in out]
    return out


def thresholds(sized: DataFrame, budgets: dict[str | None, float]) -> dict[str | None, int]:
    """For each source the hash below which its documents' sizes sum up to the budget, as near as one hash allows."""
    spark = sized.sparkSession
    found = {s: 0 for s in budgets}
    bounds = {s: (0, b) for s, b in budgets.items() if b > 0}  # where the boundary bucket starts, and what is left of the budget
    for shift in range(BITS - LEVEL, -1, -LEVEL):
        if not bounds:
            break
        at = F.broadcast(spark.createDataFrame([(s, lo, b) for s, (lo, b) in bounds.items()], "s string, lo long, budget double"))
        inside = sized.join(at, sized.source.eqNullSafe(at.s)).where(F.expr(f"h >= lo and h - lo < {1 << (shift + LEVEL)}L"))
        hist = inside.groupBy("source", "lo", "budget", F.expr(f"shiftright(h - lo, {shift})").alias("bucket")).agg(F.sum("size").alias("words"), F.min("h").alias("first"), F.max("h").alias("last"))
        run = Window.partitionBy("source", "lo", "budget").orderBy("bucket")
        reached = hist.withColumn("upto", F.sum("words").over(run)).where("upto >= budget and upto - words < budget")  # at most one a source
        rows, bounds_before, bounds = reached.collect(), bounds, {}
        for s in bounds_before:
            found[s] = bounds_before[s][0] + (1 << (shift + LEVEL))  # all of it, if nothing passes the budget
        for r in rows:
            over, under = r.upto - r.budget, r.budget - (r.upto - r.words)
            start = r.lo + (r.bucket << shift)
            if r.first == r.last or over == 0:
                found[r.source] = (r.last + 1) if over <= under else start
            else:
                found[r.source] = start
                bounds[r.source] = (start, under)
    return found


def hash_of(identity: list[str]) -> Column:
    """BITS bits that depend on the row's identity alone."""
    return F.shiftrightunsigned(F.xxhash64(*identity), 64 - BITS)


def planned(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """One row a source, s: its size, target, whole times, and the hash below which documents are taken once more.

    sized: source, size, h of every document, written.
    """
    sizes = {r.source: r.n for r in sized.groupBy("source").agg(F.sum("size").alias("n")).collect()}
    aim = targets(sizes, weights, share, most)
    times = {s: int(aim[s] // n) if n else 0 for s, n in sizes.items()}
    below = thresholds(sized, {s: aim[s] - times[s] * n for s, n in sizes.items()})
    return sized.sparkSession.createDataFrame([(s, n, float(aim[s]), times[s], below[s]) for s, n in sizes.items()], T._parse_datatype_string(PLAN)).withColumnRenamed("source", "s")


def copies(h: Column) -> Column:
    return (F.col("times") + F.when(h < F.col("below"), 1).otherwise(0)).cast("int")


def mix(docs: DataFrame, size: Column, keep: list[str], source: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """keep (which identify a document) + size, source_size, target, taken (words) and copies (how often it is in the mix)."""
    sized = written(carried(docs, keep, source=F.col(source), size=size, h=hash_of(keep)))
    plan = planned(sized.drop(KEPT), weights, share, most)
    joined = sized.join(F.broadcast(plan), sized.source.eqNullSafe(plan.s)).withColumn("copies", copies(F.col("h")))
    return restored(joined.withColumn("taken", (F.col("size") * F.col("copies")).cast("long")), ["size", "source_size", "target", "taken", "copies"])


def repeated(docs: DataFrame, size: Column, identity: list[str], source: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """The mix itself: each document as often as it is taken, all columns as they are. Documents aren't shuffled."""
    rows = carried(docs, docs.columns, source=F.col(source), h=hash_of(identity))
    sized = written(docs.select(F.col(source).alias("source"), size.alias("size"), hash_of(identity).alias("h")))
    plan = planned(sized, weights, share, most)
    joined = rows.join(F.broadcast(plan), rows.source.eqNullSafe(plan.s))
    return restored(joined.select(KEPT, F.explode(F.array_repeat(F.lit(0), copies(F.col("h")))).alias("copy")), [])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: the mix of all documents."""
    docs = table(spark, sf_dir, "documents").withColumn("__text_hash", F.xxhash64("text"))
    return mix(docs, word_count("text"), ["doc_id", "__text_hash"]).drop("__text_hash")
