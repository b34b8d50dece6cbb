"""What leaves the engine whole: the trail of events, everything that is held of a tenant, and corpora that come in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillguard.sources.exports import cef_line

#: Kill-chain stage of a category, in the chain's order.
STAGES = {"prompt_injection": "injection", "jailbreak": "injection", "tool_poisoning": "injection", "sensitive_access": "access", "secret_leak": "collection", "pii_leak": "collection", "source_code_leak": "collection", "dangerous_action": "execution", "data_exfiltration": "exfiltration"}


def normalised(findings: DataFrame, vendor: Column, org: str) -> DataFrame:
    """The trail's events: id, ts, line, cef. findings: id, last_seen, actor, surface, subject, channel, categories, severity,
    risk_score, seen_count; rows without an actor aren't events. Times are written in UTC with what fraction they have."""
    text = lambda c: F.coalesce(c, F.lit(""))
    stage = F.create_map(*(F.lit(x) for kv in STAGES.items() for x in kv))
    stages = F.array_sort(F.array_distinct(F.filter(F.transform("categories", lambda c: F.try_element_at(stage, c)), lambda s: s.isNotNull())))
    action = F.coalesce(F.nullif("subject", F.lit("")), F.nullif("channel", F.lit("")), F.col("surface"))
    rows = findings.where("actor <> ''").select(F.col("id"), F.col("last_seen").cast("timestamp").alias("ts"), "actor", vendor.alias("vendor"), "surface", action.alias("action"), "categories", stages.alias("stages"), "severity", F.coalesce("risk_score", F.lit(0)).alias("risk_score"), (F.col("surface") == "session").alias("is_chain"), F.coalesce("seen_count", F.lit(1)).alias("seen_count"))
    event = F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("ts"), "actor", "vendor", "surface", "action", "categories", "stages", "severity", "risk_score", "is_chain", F.col("id").alias("finding_id"), "seen_count", F.lit(org).alias("org"))
    signature = F.array_join(F.when(F.size("categories") > 0, F.col("categories")).otherwise(F.array("surface")), ",")
    cef = cef_line(signature, F.concat(F.lit("["), "vendor", F.lit("] "), "action"), F.col("severity"), {"suser": text(F.col("actor")), "cs1": F.col("id").cast("string"), "cs2": F.array_join("stages", ", "), "cn1": F.col("risk_score").cast("string")})
    return rows.select("id", "ts", F.to_json(event).alias("line"), cef.alias("cef"))


def since(events: DataFrame, mark: str) -> DataFrame:
    """Events from a watermark on, with it: a tie is sent again rather than lost."""
    return events.where(F.col("ts") >= F.lit(mark).cast("timestamp"))


def write_trail(events: DataFrame, path: str, form: str = "line", parts: int = 32) -> str | None:
    """Writes the events' lines (or cef) oldest first: files in the order of their names hold ranges of time, each in order. Gives
    the next watermark, null for no events. No task sorts the whole trail."""
    ranged = events.repartitionByRange(parts, "ts", "id").sortWithinPartitions("ts", "id")
    ranged.select(form).write.mode("overwrite").text(path)
    last = events.agg(F.max("ts").cast("string")).first()[0]
    return last


def tenant_documents(sections: dict[str, tuple[DataFrame, str, list[str]]], content: dict[str, list[str]] | None = None, include_content: bool = False) -> DataFrame:
    """tenant, section, doc of everything held of each tenant: a row of every table as JSON. sections: name -> (table, tenant's
    column, columns that are secret and never leave); content: columns that hold what people wrote, which leave only if asked."""
    out = None
    for name, (table, tenant, secret) in sorted(sections.items()):
        away = {*secret, tenant, *([] if include_content else (content or {}).get(name, []))}
        rows = table.where(F.col(tenant).isNotNull()).select(F.col(tenant).cast("string").alias("tenant"), F.lit(name).alias("section"), F.to_json(F.struct(*(c for c in table.columns if c not in away))).alias("doc"))
        out = rows if out is None else out.unionByName(rows)
    return out


def tenant_manifest(documents: DataFrame) -> DataFrame:
    """tenant, counts (section -> rows), bytes: what an export must hold to be whole."""
    by = documents.groupBy("tenant", "section").agg(F.count("*").alias("n"), F.sum(F.octet_length("doc") + 1).alias("b"))
    return by.groupBy("tenant").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("section", "n")))).alias("counts"), F.sum("b").alias("bytes"))


def write_tenants(documents: DataFrame, path: str) -> DataFrame:
    """Writes each tenant's sections as JSON lines below tenant=/section=, and gives the manifest of what was written, read back."""
    documents.write.mode("overwrite").partitionBy("tenant", "section").text(path)
    back = documents.sparkSession.read.text(path)
    return tenant_manifest(back.select(F.col("tenant").cast("string").alias("tenant"), "section", F.col("value").alias("doc")))


#: Names that public corpora give to their columns and labels.
TEXT_FIELDS = ("text", "content", "prompt", "input", "message")
LABEL_FIELDS = ("label", "is_injection", "injection", "category", "class")
MALICIOUS = ("1", "true", "yes", "injection", "prompt_injection", "jailbreak", "malicious", "unsafe", "attack")
BENIGN = ("0", "false", "no", "benign", "legitimate", "safe", "clean")


def sniffed(spark: SparkSession, path: str) -> str:
    """json or csv, by a file's first line that isn't blank."""
    first = spark.read.text(path).where("trim(value) <> ''").limit(1).collect()
    return "json" if first and first[0][0].lstrip().startswith("{") else "csv"


def public_corpus(spark: SparkSession, path: str, text_field: str = "", label_field: str = "", ts_field: str = "", malicious: tuple[str, ...] = MALICIOUS, source: str = "") -> DataFrame:
    """content, label, source, ts, kept of a public corpus, CSV with a header or JSON lines. A row whose label is neither known,
    or that has no text, is skipped and never guessed: kept is false. Unknown fields are an error that names those there are."""
    kind = sniffed(spark, path)
    rows = spark.read.json(path) if kind == "json" else spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)

    def picked(explicit: str, candidates: tuple[str, ...], what: str) -> str:
        found = [c for c in ([explicit] if explicit else candidates) if c in rows.columns]
        if not found:
            raise ValueError(f"no {what} field: looked for {explicit or ', '.join(candidates)}; there are {', '.join(sorted(rows.columns))}")
        return found[0]

    text = F.trim(F.coalesce(F.col(f"`{picked(text_field, TEXT_FIELDS, 'text')}`").cast("string"), F.lit("")))
    value = F.lower(F.trim(F.col(f"`{picked(label_field, LABEL_FIELDS, 'label')}`").cast("string")))
    benign = [v for v in BENIGN if v not in malicious]
    label = F.when(value.isin(*malicious), "malicious").when(value.isin(*benign), "benign")
    at = F.nullif(F.col(f"`{ts_field}`").cast("string"), F.lit("")) if ts_field in rows.columns else F.lit(None).cast("string")
    return rows.select(text.alias("content"), label.alias("label"), (F.lit(source) if source else F.element_at(F.split(F.input_file_name(), "/"), -1)).alias("source"), at.alias("ts"), ((text != "") & label.isNotNull()).alias("kept"))
