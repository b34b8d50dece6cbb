"""Sinks: CEF lines, JSON lines with a watermark, envelopes, date-partitioned files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillguard.functions.columns import cef_header, cef_value

#: Severity on CEF's scale.
CEF_SEVERITY = {"critical": 9, "high": 7, "suspicious": 5, "low": 3, "benign": 0}


def cef_line(signature: Column, name: Column, severity: Column, extension: dict[str, Column], vendor: str = "quillguard", product: str = "engine", version: str = "1") -> Column:
    level = F.coalesce(F.create_map(*(F.lit(x) for kv in CEF_SEVERITY.items() for x in kv))[severity], F.lit(0))
    head = F.concat_ws("|", F.lit(f"CEF:0|{vendor}|{product}|{version}"), cef_header(signature), cef_header(name), level.cast("string"))
    return F.concat(head, F.lit("|"), F.concat_ws(" ", *(F.concat(F.lit(f"{k}="), cef_value(F.coalesce(v, F.lit("")))) for k, v in extension.items())))


def json_lines(df: DataFrame, watermark: str) -> DataFrame:
    """One JSON object a row, beside the watermark that an incremental export carries on from (inclusive)."""
    return df.select(watermark, F.to_json(F.struct(*df.columns)).alias("line"))


def hec_envelope(df: DataFrame, ts: str, sourcetype: str = "quillguard:finding") -> DataFrame:
    return df.select(F.to_json(F.struct(F.unix_seconds(F.col(ts).cast("timestamp")).alias("time"), F.lit(sourcetype).alias("sourcetype"), F.struct(*df.columns).alias("event"))).alias("line"))


def write_by_day(df: DataFrame, ts: str, path: str) -> None:
    """findings/y=/m=/d= objects; rows of a day stay together without gathering a day in one task."""
    df.withColumns({"y": F.date_format(ts, "yyyy"), "m": F.date_format(ts, "MM"), "d": F.date_format(ts, "dd")}).write.partitionBy("y", "m", "d").mode("append").json(path)


def labelled_examples(reviews: DataFrame) -> DataFrame:
    """Triage as an evaluation corpus: triaged is malicious, dismissed benign; open, bulk, expected and duplicate rows don't count."""
    usable = reviews.where("status <> 'open' and coalesce(via, '') <> 'bulk' and (status = 'triaged' or coalesce(reason, '') not in ('expected', 'accepted_risk', 'duplicate'))")
    return usable.withColumn("label", F.when(F.col("status") == "triaged", "malicious").otherwise("benign"))


def evidence_pack(reports: dict[str, DataFrame], path: str) -> DataFrame:
    """Writes each report as JSON lines below a path and gives the manifest (report, rows, digest). The digest is a sum over the
    rows' hashes, so it doesn't depend on their order and no task sees a whole report."""
    manifest = None
    for name, report in sorted(reports.items()):
        report.write.mode("overwrite").json(f"{path.rstrip('/')}/{name}")
        row = report.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.xxhash64(F.to_json(F.struct(*report.columns))).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("digest")).select(F.lit(name).alias("report"), "rows", "digest")
        manifest = row if manifest is None else manifest.unionByName(row)
    return manifest
