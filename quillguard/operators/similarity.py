"""Content origin: sampled word shingles, an inverted-index join, the best containment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SAMPLED = ("0", "4", "8", "c")  # one hash in four, by its first hex digit


def shingles(text: Column, words: int = 5) -> Column:
    """Distinct sampled hashes of runs of words; empty for shorter texts."""
    all_words = F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))
    run = lambda w, i: F.md5(F.concat_ws(" ", *(F.get(w, i + k) for k in range(words))).cast("binary"))
    sampled = lambda w: F.filter(F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(w) - words), lambda i: run(w, i))), lambda h: F.substring(h, 1, 1).isin(*SAMPLED))
    none = F.expr("cast(array() as array<string>)")
    # the words are bound by a one-element transform: named inside the inner lambda they would be extracted again for every run
    return F.element_at(F.transform(F.array(all_words), lambda w: F.when(F.size(w) >= words, sampled(w)).otherwise(none)), 1)


def best_origin(prompts: DataFrame, docs: DataFrame, prompt_id: str, doc_id: str, least: int = 4, above: float = 0.5) -> DataFrame:
    """prompt_id, doc_id, containment: the document that holds most of a prompt's shingles, if more than `above` of them.

    Hashes of documents that no prompt holds go in a semi-join, before anything meets; matches are counted per pair before they
    are ranked. A hash that many prompts and many documents hold meets as often as both have it: what is asked is a count for
    each such pair.
    """
    p = prompts.select(prompt_id, F.explode(shingles(F.col("text"))).alias("h"))
    sizes = p.groupBy(prompt_id).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    d = docs.select(doc_id, F.explode(shingles(F.col("text"))).alias("h"))
    d = d.join(p.select("h").distinct(), "h", "left_semi")
    hits = p.join(d, "h").groupBy(prompt_id, doc_id).agg(F.count("*").alias("c")).join(sizes, prompt_id).where(F.col("c") > above * F.col("n"))
    best = hits.groupBy(prompt_id).agg(F.max(F.struct(F.col("c"), (-F.col(doc_id)).alias("older"), "n")).alias("b"))
    return best.select(prompt_id, (-F.col("b.older")).alias(doc_id), F.round(F.col("b.c") / F.col("b.n"), 2).alias("containment"))
