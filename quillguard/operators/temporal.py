"""As-of and look-back operators per actor, as range windows: one shuffle by actor and time cell, no join.

A cell is as long as the look-back, so what a row may see lies in its own cell or the one before. Rows are copied into the
cell behind theirs, where they are only seen: no task ever orders more than two cells of an actor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MICROS = 1_000_000


def in_cells(df: DataFrame, at: Column, length: int) -> DataFrame:
    """Each row in its own cell (__own) and, to be seen, in the next."""
    cell = F.floor(at / length)
    return df.withColumn("__c", F.explode(F.array(F.struct(cell.alias("cell"), F.lit(True).alias("own")), F.struct((cell + 1).alias("cell"), F.lit(False).alias("own"))))).select("*", F.col("__c.cell").alias("__cell"), F.col("__c.own").alias("__own")).drop("__c")


def asof_taint(actions: DataFrame, taints: DataFrame, minutes: int = 30) -> DataFrame:
    """id, actor, ts of each action and the id of the actor's latest taint before it that hasn't expired, or null.

    A taint of exactly that age has expired. Taints and actions are one ordered stream per actor; the frame holds what
    lies behind an action.
    """
    t = taints.select("actor", "ts", F.lit(None).cast("long").alias("id"), F.struct("ts", "id").alias("taint"))
    a = actions.select("actor", "ts", "id", F.lit(None).cast(t.schema["taint"].dataType).alias("taint"))
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("actor", "__cell").orderBy(at).rangeBetween(-minutes * 60 * MICROS + 1, 0)
    a = a.withColumns({"__cell": F.floor(at / (minutes * 60 * MICROS)), "__own": F.lit(True)})  # nothing looks back on actions
    seen = a.unionByName(in_cells(t, at, minutes * 60 * MICROS)).withColumn("found", F.max("taint").over(w))
    return seen.where("taint is null").select("id", "actor", "ts", F.col("found.id").alias("taint"))


def chain_windows(findings: DataFrame, seconds: int = 1800, exfiltration: str = "exfiltration", execution: str = "execution", anchor: int = 60) -> DataFrame:
    """id, actor, stages, risk of each finding whose actor's last seconds hold two stages and an anchor."""
    at = F.unix_seconds(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("actor", "__cell").orderBy(at).rangeBetween(-seconds, 0)
    rows = in_cells(findings.select("id", "actor", "ts", "category", "risk"), at, seconds)
    seen = rows.select("id", "actor", "__own", F.array_sort(F.collect_set("category").over(w)).alias("s"), F.max("risk").over(w).alias("most")).where("__own")
    risk = F.when(F.array_contains("s", exfiltration), 95).when(F.array_contains("s", execution), 90).when(F.size("s") >= 3, 92).otherwise(82)
    return seen.where((F.size("s") >= 2) & (F.col("most") >= anchor)).select("id", "actor", F.array_join("s", ",").alias("stages"), risk.alias("risk"))
