"""How queries are declared, and the views they share with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillguard.functions.columns import severity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Findings as the events table stands for them: k, from props, decides tool, category and review.
CATEGORIES = ("secret_leak", "pii_leak", "prompt_injection", "source_code_leak", "unsanctioned_ai")
NOW = "2024-01-31 00:00:00"
FINDINGS_SQL = """
WITH raw AS (SELECT event_id AS id, 'u' || user_id AS actor, ts, event_type AS surface, CAST(json_extract(props, '$.k') AS INTEGER) AS k,
    CAST(LEAST(100, floor(value * 2)) AS INTEGER) AS risk FROM events),
f AS (SELECT *, 'tool' || (k % 12) AS tool,
    CASE k % 5 WHEN 0 THEN 'secret_leak' WHEN 1 THEN 'pii_leak' WHEN 2 THEN 'prompt_injection' WHEN 3 THEN 'source_code_leak' ELSE 'unsanctioned_ai' END AS category,
    CASE WHEN k % 4 = 0 THEN 'triaged' WHEN k % 4 = 1 THEN 'open' ELSE 'dismissed' END AS status,
    CASE WHEN k % 4 < 2 THEN '' WHEN k % 3 = 0 THEN 'false_positive' WHEN k % 3 = 1 THEN 'expected' ELSE 'duplicate' END AS reason,
    CASE WHEN risk >= 80 THEN 'critical' WHEN risk >= 60 THEN 'high' WHEN risk >= 35 THEN 'suspicious' WHEN risk >= 15 THEN 'low' ELSE 'benign' END AS severity
    FROM raw)
"""


def query(name: str, sql: str | None = None, findings: bool = False) -> Callable:
    """Registers a query; findings: the SQL reads the view f."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"two queries are called {name}")
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = (FINDINGS_SQL if findings else "") + sql
        return fn

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame, *key: str) -> DataFrame:
    """df in even parts, their number growing with its files, before work that costs far more than a shuffle of its rows. How many
    tasks read a table says little: a file is one task's work if it is one row group, however many splits it is cut into. A
    table of many files stays as it lies. key: columns whose values are mostly rows of their own; rows are then dealt by them, which
    spares the sort by which dealing in turn gives the same parts again."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if len(df.inputFiles()) >= 4 * cores else df.repartition(max(4 * cores, 8 * df.rdd.getNumPartitions()), *key)


def findings(spark: SparkSession, sf_dir: str, even: bool = False) -> DataFrame:
    """The findings view: id, actor, ts, surface, k, risk, tool, category, status, reason, severity. even: spread before anything
    is read from its properties."""
    e = read(spark, sf_dir, "events")
    e = spread(e, "event_id") if even else e
    k = F.get_json_object("props", "$.k").cast("int")
    raw = e.select(F.col("event_id").alias("id"), F.concat(F.lit("u"), F.col("user_id")).alias("actor"), "ts", F.col("event_type").alias("surface"), k.alias("k"), F.least(F.lit(100), F.floor(F.col("value") * 2)).cast("int").alias("risk"))
    category = F.element_at(F.array(*map(F.lit, CATEGORIES)), F.col("k") % 5 + 1)
    status = F.when(F.col("k") % 4 == 0, "triaged").when(F.col("k") % 4 == 1, "open").otherwise("dismissed")
    reason = F.when(F.col("k") % 4 < 2, "").when(F.col("k") % 3 == 0, "false_positive").when(F.col("k") % 3 == 1, "expected").otherwise("duplicate")
    return raw.withColumns({"tool": F.concat(F.lit("tool"), F.col("k") % 12), "category": category, "status": status, "reason": reason, "severity": severity(F.col("risk"))})
