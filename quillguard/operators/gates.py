"""Whether a trained classifier may help the rules: exact splits, its judgement on rows it hasn't seen, and the fallback it then is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillguard.functions import scoring as S

FROM, WEIGHT, MOST = 0.8, 0.5, 0.6


def first_share(rows: DataFrame, strata: list[str], cell: Column, order: list, share: float, least: int = 0) -> DataFrame:
    """Adds held: true for the first floor(share * n), or `least`, of each stratum's n rows in the given order, exactly.

    cell is the coarse part of the order (rows of a smaller cell come first, whatever else they hold). Cells are counted, the
    one in which the quota ends is found among the counts, and only within a cell rows are ranked: no stratum is sorted.
    """
    named = rows.withColumn("__cell", cell)
    same = lambda a, b: [F.col(f"{a}.`{c}`").eqNullSafe(F.col(f"{b}.`{c}`")) for c in (*strata, "__cell")]
    w = Window.partitionBy(*strata)
    cells = named.groupBy(*strata, "__cell").agg(F.count("*").alias("__n"))
    cells = cells.withColumns({"__before": F.sum("__n").over(w.orderBy("__cell").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n"), "__all": F.sum("__n").over(w)})
    quota = F.greatest(F.floor(F.col("__all") * share), F.lit(least))
    taken = cells.select(*strata, "__cell", F.greatest(F.lit(0), F.least(F.col("__n"), quota - F.col("__before"))).alias("__take"))
    met = named.alias("r").join(taken.alias("c"), same("r", "c"), "left").select("r.*", "c.__take")
    rank = F.row_number().over(Window.partitionBy(*strata, "__cell").orderBy(*order))
    return met.withColumn("held", rank <= F.col("__take")).drop("__cell", "__take")


def stratified(rows: DataFrame, strata: list[str], key: str, share: float = 0.2) -> DataFrame:
    """Adds held: floor(share * n) rows of each stratum, chosen by a hash of the key (ties by the key)."""
    h = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary"))
    return first_share(rows, strata, F.substring(h, 1, 3), [h, key], share)


def latest(rows: DataFrame, ts: str, key: str, share: float = 0.2) -> DataFrame:
    """Adds held: the latest floor(share * n) of the rows that have a time, one at least; rows without a time are never held."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    dated = first_share(rows.where(F.col(ts).isNotNull()), [], -F.floor(at / 3_600_000_000), [F.desc(ts), F.desc(key)], share, 1)
    return dated.unionByName(rows.where(F.col(ts).isNull()).withColumn("held", F.lit(False)))


def judged(scored: DataFrame, truth: Column, model: Column, rule: Column, synthetic: Column, most_fp: float = 0.02) -> DataFrame:
    """One row over held-out rows: f1 of model and rule, fp_rate of the model, n, synthetic rows among them, and verdict: `passes`
    if the model's f1 is the better and it calls few good rows bad, `fails`, or `not evaluable` (no rows, or synthetic ones)."""
    n = lambda c: F.count_if(c)
    t, m, r = truth, model, rule
    c = scored.agg(F.count("*").alias("n"), n(synthetic).alias("synthetic"), n(t & m).alias("tp"), n(~t & m).alias("fp"), n(t & ~m).alias("fn"), n(~t & ~m).alias("tn"), n(t & r).alias("rtp"), n(~t & r).alias("rfp"), n(t & ~r).alias("rfn"))
    f1 = lambda tp, fp, fn: F.round(F.coalesce(F.expr(f"try_divide(2.0D * {tp}, 2 * {tp} + {fp} + {fn})"), F.lit(1.0)), 4)
    rates = c.select("n", "synthetic", f1("tp", "fp", "fn").alias("f1"), f1("rtp", "rfp", "rfn").alias("rule_f1"), F.round(F.coalesce(F.expr("try_divide(fp, fp + tn)"), F.lit(0.0)), 4).alias("fp_rate"))
    passes = (F.col("f1") > F.col("rule_f1")) & (F.col("fp_rate") <= most_fp)
    return rates.withColumn("verdict", F.when((F.col("n") == 0) | (F.col("synthetic") > 0), "not evaluable").when(passes, "passes").otherwise("fails"))


def fallback(df: DataFrame, p: str = "p", at: float = FROM) -> DataFrame:
    """df with the classifier's signal added to signals, where no marker spoke and p (its chance of confidential prose) is high
    enough: half a marker's weight, and a confidence that stays below a marker's."""
    silent = ~F.exists("signals", lambda s: s["check"] == "marker")
    told = S.signals((silent & (F.col(p) >= at), S.signal("confidential_data", WEIGHT, F.least(F.lit(MOST), 0.65 * F.col(p)), "confidential_ml", detector="shadow_ai")))
    return df.withColumn("signals", F.concat("signals", told))


def admitted(verdict: str, df: DataFrame, p: str = "p") -> DataFrame:
    """The fallback, if the gate let the model pass; otherwise the signals as they are."""
    return fallback(df, p) if verdict == "passes" else df
