"""Destinations and names matched with a catalog: longest key between boundaries, as equal keys instead of a theta join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDEST = 4  # words of the longest key


def pieces(text: Column, widest: int = WIDEST) -> Column:
    """Every stretch of a text that starts and ends at a word's edge and has at most so many words."""
    tokens = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+|[^a-z0-9]+"), F.lit(0))
    at = F.sequence(F.lit(1), F.greatest(F.size(tokens), F.lit(1)))
    return F.array_distinct(F.flatten(F.transform(at, lambda i: F.transform(F.sequence(F.lit(1), F.lit(2 * widest - 1), F.lit(2)), lambda w: F.array_join(F.slice(tokens, i, w), "")))))


def longest_match(df: DataFrame, text: str, catalog: DataFrame, widest: int = WIDEST) -> DataFrame:
    """df + tool of the longest catalog key that stands in text between boundaries, null if none does.

    catalog: (key, tool). Distinct texts are matched once and joined back, so a text that a third of the rows share is
    looked up once; both sides meet by an equal key and neither is broadcast by force.
    """
    named = df.select(F.col(text).alias("__text")).where("__text is not null").distinct()
    hits = named.select("__text", F.explode(pieces(F.col("__text"), widest)).alias("key")).join(catalog.select(F.lower("key").alias("key"), "tool"), "key")
    best = hits.groupBy("__text").agg(F.max(F.struct(F.length("key").alias("n"), "key", "tool")).alias("best")).select("__text", F.col("best.tool").alias("tool"))
    return df.join(best, F.col(text) == F.col("__text"), "left").drop("__text")


def first_rule(text: Column, rules: list[tuple[str, str]], otherwise: str = "other") -> Column:
    """The label of the first rule (substring, label) that holds."""
    out, low = F, F.lower(F.coalesce(text, F.lit("")))
    for part, label in rules:
        out = out.when(F.contains(low, F.lit(part.lower())), label)
    return out.otherwise(otherwise) if rules else F.lit(otherwise)
