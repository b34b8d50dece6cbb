"""Which spans of time of a source have been read, and what is left to read again.

Spans are rows (key, start, end; end exclusive). They are merged within a day before a key's days meet, so a key's rows are few
however often it was read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = 86_400


def seconds(c: Column | str) -> Column:
    return F.unix_seconds(F.date_trunc("second", F.col(c) if isinstance(c, str) else c).cast("timestamp"))


def islands(spans: DataFrame, key: list[str], *cells: str) -> DataFrame:
    """Spans (key, start, end in seconds) that overlap or touch as one, within the given cells."""
    by = Window.partitionBy(*key, *cells).orderBy("start", "end")
    reach = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    cut = spans.withColumn("__cut", F.when(F.coalesce(F.col("start") > reach, F.lit(True)), 1).otherwise(0))
    named = cut.withColumn("__island", F.sum("__cut").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return named.groupBy(*key, *cells, "__island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("__island")


def covered(spans: DataFrame, key: list[str]) -> DataFrame:
    """key, start, end: the union of spans. Empty spans and null ends don't count."""
    real = spans.where("start < end").select(*key, "start", "end")
    days = F.sequence(F.floor(F.col("start") / DAY), F.floor((F.col("end") - 1) / DAY))
    cut = real.withColumn("__day", F.explode(days)).withColumns({"start": F.greatest("start", F.col("__day") * DAY), "end": F.least("end", (F.col("__day") + 1) * DAY)})
    return islands(islands(cut, key, "__day").drop("__day"), key)


def gaps(union: DataFrame, keys: DataFrame, key: list[str], since: int, until: int, least: int = 1) -> DataFrame:
    """key, start, end: what of [since, until) is not covered, for each of keys; gaps shorter than `least` seconds don't count."""
    edges = union.where(f"end > {since} and start < {until}").unionByName(keys.select(*key).distinct().select(*key, F.lit(until).cast("long").alias("start"), F.lit(until).cast("long").alias("end")))
    before = F.lag("end", 1).over(Window.partitionBy(*key).orderBy("start", "end"))
    return edges.select(*key, F.coalesce(before, F.lit(since).cast("long")).alias("__from"), F.col("start").alias("__to")).select(*key, F.greatest(F.col("__from"), F.lit(since).cast("long")).alias("start"), F.col("__to").alias("end")).where(f"end - start >= {least}")


def backfill_plan(missing: DataFrame, key: list[str], budget: int) -> DataFrame:
    """key, start, end: of each key's gaps the newest seconds that fit the budget, newest first; a gap that fits in part is cut at
    its older end."""
    w = Window.partitionBy(*key).orderBy(F.desc("start")).rowsBetween(Window.unboundedPreceding, -1)
    spent = missing.withColumn("__spent", F.coalesce(F.sum(F.col("end") - F.col("start")).over(w), F.lit(0)))
    return spent.where(F.col("__spent") < budget).select(*key, F.greatest("start", F.col("end") - (F.lit(budget) - F.col("__spent"))).alias("start"), "end")


def reread(source: DataFrame, plan: DataFrame, key: list[str], ts: str) -> DataFrame:
    """The source's rows within the plan's spans, each once: a semi-join by key and day."""
    at = seconds(ts)
    spans = plan.withColumn("__day", F.explode(F.sequence(F.floor(F.col("start") / DAY), F.floor((F.col("end") - 1) / DAY))))
    rows = source.withColumns({"__at": at, "__day": F.floor(at / DAY)})
    on = [F.expr(f"r.`{k}` <=> p.`{k}`") for k in key] + [F.expr("r.__day = p.__day and r.__at >= p.start and r.__at < p.end")]
    return rows.alias("r").join(spans.alias("p"), on, "left_semi").drop("__at", "__day")


def silences(beats: DataFrame, key: list[str], ts: str, hours: int, now: str) -> DataFrame:
    """key, last_seen, dark_at, back_at (null: not yet) of every silence of more than so many hours (24 or more) that has begun by
    now. Beats meet by day first, so a key that beats every second is a row a day."""
    at = F.col(ts).cast("timestamp")
    days = beats.where(at <= F.lit(now).cast("timestamp")).groupBy(*key, F.to_date(at).alias("__day")).agg(F.min(at).alias("__first"), F.max(at).alias("last_seen"))
    back = F.lead("__first").over(Window.partitionBy(*key).orderBy("__day"))
    dark = F.col("last_seen") + F.make_interval(hours=F.lit(hours))
    spells = days.select(*key, "last_seen", dark.alias("dark_at"), back.alias("back_at"))
    return spells.where(F.coalesce("back_at", F.lit(now).cast("timestamp")) > F.col("dark_at"))
