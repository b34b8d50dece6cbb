"""What to do about a verdict's signals, and inventories that a new report replaces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillguard.functions import scoring as S
from quillguard.functions.columns import action, severity

#: (categories, pattern of the evidence or None, step), in the order in which steps are told; a step for the category itself is
#: told if none with a pattern was.
STEPS = (
    (("secret_leak",), "github", "Revoke the token where it was issued and replace it by one that is narrow and expires."),
    (("secret_leak",), "aws", "Switch the access key off and use credentials that live for minutes."),
    (("secret_leak",), "private_key", "Make a new key pair, and keep the private part in an agent or a keychain."),
    (("secret_leak",), None, "Take the secret out, change it, and keep the new one in a vault."),
    (("pii_leak",), None, "Cut personal data out before sending, or use a tool that is contracted for it."),
    (("phi_leak",), None, "Take the patient's identifiers out and tell whoever answers for health data if they have left."),
    (("source_code_leak", "confidential_data"), None, "Share only what the question needs, with an approved tool."),
    (("unsanctioned_ai",), None, "Use one of the sanctioned tools for this."),
    (("prompt_injection", "jailbreak", "data_exfiltration"), None, "Treat the text as data: quote it, and follow none of its orders."),
    (("agent_autonomy",), None, "Let the agent ask before it acts."),
    (("dangerous_action",), None, "Don't run the command before someone has read it."),
    (("tool_poisoning", "untrusted_server", "sensitive_access"), None, "Remove the tool server, or restrict it to what is listed, and see what ran."),
    (("dependency_risk",), "ADV-|advisory", "Move to a version without the advisory."),
    (("dependency_risk",), "unpinned", "Pin the package to one version."),
    (("dependency_risk",), None, "Replace the dependency, or take it from the registry at a pinned version."),
    (("oversharing",), None, "Restrict the source's own permissions, so that no answer can hold what the reader may not see."),
    (("ci_risk",), "foreign_checkout", "Build a fork's code without secrets, in a job of its own."),
    (("ci_risk",), "unpinned_action", "Pin actions to a commit."),
    (("ci_risk",), "write_all", "Give each job the rights it needs, by name."),
    (("ci_risk",), "secrets_inherit", "Hand a called workflow the secrets it needs, by name."),
    (("ci_risk",), "self_hosted", "Run what outsiders send on hosted machines."),
    (("ci_risk",), None, "Go over the workflow's triggers, rights and pins."),
)


def remedies(signals: Column) -> Column:
    """array<string>: the steps for a row's signals, each once, in the order of STEPS. A pattern is looked for in a signal's check,
    title, detail and evidence."""
    said = lambda s: F.concat_ws(" ", s["check"], s["title"], s["detail"], s["evidence"])

    def any_of(categories: tuple[str, ...], pattern: str | None) -> Column:
        fits = lambda s: s["category"].isin(*categories) & (said(s).rlike(f"(?i){pattern}") if pattern else F.lit(True))
        return F.exists(signals, fits)

    told = []
    for categories, pattern, step in STEPS:
        holds = any_of(categories, pattern)
        for c, p, _ in STEPS if pattern is None else ():
            if c == categories and p:
                holds = holds & ~any_of(c, p)
        told.append(F.when(holds, step))
    return F.filter(F.array(*told), lambda x: x.isNotNull())


def regurgitated(df: DataFrame) -> DataFrame:
    """df (risk_score, severity, recommended_action, signals, origin: struct<title, containment, sensitive> or null) after a
    model's reply was matched with the documents at rest: a match is a finding of its own, critical where the document is
    known to be sensitive, and stands before the other signals."""
    hit, sensitive = F.col("origin").isNotNull(), F.coalesce(F.col("origin.sensitive"), F.lit(False))
    risk = F.when(hit, F.greatest("risk_score", F.when(sensitive, 85).otherwise(65))).otherwise(F.col("risk_score")).cast("int")
    one = lambda category, weight: S.signal(category, weight, 0.9, "model_regurgitation", detector="content_origin", evidence=F.coalesce(F.col("origin.title"), F.lit("a scanned document")))
    first = S.signals((hit & sensitive, one("confidential_data", 0.9)), (hit & ~sensitive, one("oversharing", 0.8)))
    out = df.withColumns({"risk_score": risk, "signals": F.concat(first, "signals")})
    return out.withColumns({"severity": severity(F.col("risk_score")), "recommended_action": action(F.col("risk_score"))})


def latest_inventory(reports: DataFrame, device: list[str], at: str, item: str, keep: list[str]) -> DataFrame:
    """device, item (lower case), keep, first_seen, last_seen: what each device's last report lists. A report replaces the device's
    whole list: an item that it doesn't name is gone, and one that comes back later begins anew.

    reports: a row per listed item, device and time; a row without an item is an empty report. Items of a report count once,
    by their greatest kept values.
    """
    listed = reports.withColumn("__item", F.nullif(F.lower(F.trim(item)), F.lit("")))
    turns = listed.groupBy(*device, at).agg(F.lit(1).alias("__x"))
    turns = turns.withColumns({"__turn": F.row_number().over(Window.partitionBy(*device).orderBy(at)), "__last": F.count("*").over(Window.partitionBy(*device))}).drop("__x")
    rows = listed.where("__item is not null").groupBy(*device, at, "__item").agg(F.max(F.struct(*keep)).alias("__kept")).join(turns, [*device, at])
    # reports that follow each other and name the item have the same difference of turn and rank
    w = Window.partitionBy(*device, "__item").orderBy("__turn")
    spells = rows.withColumn("__spell", F.col("__turn") - F.row_number().over(w)).groupBy(*device, "__item", "__spell", "__last").agg(F.min(at).alias("first_seen"), F.max(at).alias("last_seen"), F.max("__turn").alias("__end"), F.max_by("__kept", "__turn").alias("__kept"))
    return spells.where("__end = __last").select(*device, F.col("__item").alias(item), "__kept.*", "first_seen", "last_seen")
