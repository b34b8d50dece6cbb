"""URL filters: host and path rules first, gradient-boosted trees on lexical features for the rest.

Only built-in functions and Spark's own tree learner: nothing leaves the JVM. The trees are fitted on at most SAMPLE
distinct labelled URLs (those of the smallest hashes, over all rows); URLs that a rule judges are the labelled ones
unless others are given. The statistics of host suffixes cover every labelled URL and every suffix: those of the SUFFIXES
commonest are broadcast, those of the others (if there are more) joined by key, salted; a suffix that no labelled URL has
gets the overall rate.

Null URLs and those without '://' have empty host and path and fit no rule; the trees judge them by the text there is.
With no labelled URL at all the verdict is allow; where the labels name one verdict only, it is that one. Repeated rows
are judged alike, very long ones whole. Kept columns keep their values whatever their names (common.restored); others are
ignored. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillguard.llm.common import KEPT, carried, restored, table, written

#: The rules (verdict, host/path).
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
SAMPLE, SUFFIXES, SALTS, ROUNDS, DEPTH, SEED = 20_000, 1_000, 16, 12, 4, 7
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
FEATURES = ["length", "host_length", "path_length", "depth", "labels", "digit_ratio", "entropy", "params", "has_fragment", "hyphens", "suffix_rate", "suffix_log_count"]


def parsed(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds host (ASCII letters lower-cased) and path."""
    text = F.coalesce(F.col(url), F.lit(""))
    return df.withColumns({"host": F.translate(F.regexp_extract(text, PARTS, 1), UPPER, UPPER.lower()), "path": F.regexp_extract(text, PARTS, 2)})


def rule_columns(rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits host and path, null if none does."""
    rule = verdict = None
    for what, text in sorted(rules, key=lambda r: -len(r[1])):
        host, _, path = text.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(f"/{path}")
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, what) if verdict is None else verdict.when(fits, what)
    return rule, verdict


def entropy(text: Column) -> Column:
    """Shannon entropy of a text's characters in bits."""
    n = F.length(text)
    share = lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n
    return F.when(n > 0, F.aggregate(F.array_distinct(F.split(text, "")), F.lit(0.0), lambda acc, c: F.when(c == "", acc).otherwise(acc - share(c) * F.log2(share(c))))).otherwise(0.0)


def lexical(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds the lexical features and the host's suffix (its last label)."""
    text = F.coalesce(F.col(url), F.lit(""))
    query = F.regexp_extract(text, r"(?s)\?([^#]*)", 1)
    count = lambda c, x: F.length(c) - F.length(F.replace(c, F.lit(x), F.lit("")))
    return df.withColumns({
        "length": F.length(text).cast("double"), "host_length": F.length("host").cast("double"), "path_length": F.length("path").cast("double"),
        "depth": count(F.col("path"), "/").cast("double"), "labels": (count(F.col("host"), ".") + 1).cast("double"),
        "digit_ratio": F.length(F.regexp_replace(text, "[^0-9]", "")) / F.greatest(F.length(text), F.lit(1)),
        "entropy": entropy(text), "params": F.when(query == "", 0.0).otherwise((count(query, "&") + 1).cast("double")),
        "has_fragment": F.contains(text, F.lit("#")).cast("double"), "hyphens": count(F.col("host"), "-").cast("double"),
        "suffix": F.substring_index("host", ".", -1),
    })


def suffix_statistics(labelled: DataFrame) -> tuple[DataFrame, float]:
    """(suffix, suffix_rate, suffix_log_count) of every labelled suffix, and the overall rate of blocked URLs."""
    sums = labelled.groupBy("suffix").agg(F.count("*").alias("n"), F.sum("label").alias("bad"))
    total = sums.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    overall = (total.bad or 0.0) / total.n if total.n else 0.0
    return sums.select("suffix", ((F.col("bad") + 10 * overall) / (F.col("n") + 10)).alias("suffix_rate"), F.log1p("n").alias("suffix_log_count")), overall


def with_suffixes(df: DataFrame, stats: DataFrame, overall: float, common: int = SUFFIXES) -> DataFrame:
    """Adds each row's suffix_rate and suffix_log_count. The `common` commonest suffixes are broadcast; rows of others meet
    the rest by suffix and salt, rows that are done (or whose suffix has no statistics) spread over the tasks."""
    none = {"suffix_rate": overall, "suffix_log_count": 0.0}
    first = stats.orderBy(F.desc("suffix_log_count"), "suffix").limit(common)
    if stats.count() <= common:
        return df.join(F.broadcast(first), "suffix", "left").fillna(none)
    first = written(first)
    rest = stats.join(F.broadcast(first.select("suffix")), "suffix", "left_anti").select(F.col("suffix").alias("__suffix"), F.col("suffix_rate").alias("__rate"), F.col("suffix_log_count").alias("__log"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("__salt"))
    done, row = F.col("suffix_rate").isNotNull(), F.monotonically_increasing_id()
    met = df.join(F.broadcast(first), "suffix", "left").withColumns({"__key": F.when(~done, F.col("suffix")), "__at": F.when(done, row).otherwise(F.pmod(row, F.lit(SALTS)))})
    met = met.join(rest, (F.col("__key") == F.col("__suffix")) & (F.col("__at") == F.col("__salt")), "left")
    return met.withColumns({"suffix_rate": F.coalesce("suffix_rate", "__rate"), "suffix_log_count": F.coalesce("suffix_log_count", "__log")}).drop("__suffix", "__rate", "__log", "__salt", "__key", "__at").fillna(none)


def judge(urls: DataFrame, keep: list[str], url: str = "url", rules=RULES, labelled: DataFrame | None = None) -> DataFrame:
    """keep + host, path, rule, verdict and block_score (null where a rule decides or no trees could be fitted).

    labelled: optional (url, verdict) rows to learn from, in place of the URLs that rules judge.
    """
    rule, by_rule = rule_columns(rules)
    ruled = lexical(parsed(carried(urls, keep, url=F.col(url)))).withColumns({"rule": rule, "by_rule": by_rule})
    known = ruled.where("by_rule is not null").select("url", "by_rule", "suffix", *FEATURES[:-2]) if labelled is None else lexical(parsed(labelled.select("url", F.col("verdict").alias("by_rule"))))
    known = known.withColumn("label", F.when(F.col("by_rule") == "block", 1.0).otherwise(0.0))
    stats, overall = suffix_statistics(known)
    stats = written(stats)
    sample = known.dropDuplicates(["url"]).orderBy(F.xxhash64("url"), "url").limit(SAMPLE)
    sample = written(with_suffixes(sample, stats, overall).select("label", *FEATURES)).coalesce(1)
    classes = sorted(r.label for r in sample.select("label").distinct().collect())
    filled = with_suffixes(ruled, stats, overall)
    if len(classes) < 2:
        score = F.lit(None).cast("double")
        scored, other = filled, F.lit("block" if classes == [1.0] else "allow")
    else:
        assemble = VectorAssembler(inputCols=FEATURES, outputCol="__features")
        train = assemble.transform(sample).sortWithinPartitions(*FEATURES, "label").cache()
        model = GBTClassifier(featuresCol="__features", labelCol="label", maxIter=ROUNDS, maxDepth=DEPTH, seed=SEED, predictionCol="__p").fit(train).setRawPredictionCol("__raw").setProbabilityCol("__prob")
        train.unpersist()
        scored = model.transform(assemble.transform(filled)).withColumn("__chance", vector_to_array("__prob")[1])
        score = F.when(F.col("by_rule").isNull(), F.col("__chance"))
        other = F.when(F.col("__chance") >= 0.5, "block").otherwise("allow")
    found = scored.select(KEPT, "host", "path", "rule", F.coalesce("by_rule", other).alias("verdict"), score.alias("block_score"))
    return restored(found, ["host", "path", "rule", "verdict", "block_score"])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: the verdict on every page's URL."""
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), ["page_id"])
