"""Scans that put detectors, scoring and redaction together: code, diffs, agents' messages, server configurations, plans of
redaction that are checked before they are offered, self-tests of a policy, domain identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillguard.functions import scoring as S
from quillguard.functions import spans as P
from quillguard.operators import detectors as D
from quillguard.operators import redact as R

#: What a repository must not hold; code itself belongs there.
KEPT = ("secret_leak", "pii_leak", "phi_leak")


def answer(severity: Column) -> Column:
    return F.when(severity.isin("high", "critical"), "block").when(severity == "suspicious", "warn").otherwise("allow")


def code_scan(files: DataFrame, content: str, kept: tuple[str, ...] = KEPT) -> DataFrame:
    """Adds the verdict of each file by its data-loss signals alone, and answer."""
    found = D.detect(files, content).withColumn("signals", F.filter("signals", lambda s: s["category"].isin(*kept)))
    return S.verdict(found).withColumn("answer", answer(F.col("severity")))


def overall(scanned: DataFrame, *by: str) -> DataFrame:
    """The worst answer and how many files were read and flagged, per group or over all."""
    worst = F.max(F.when(F.col("answer") == "block", 2).when(F.col("answer") == "warn", 1).otherwise(0))
    rolled = scanned.groupBy(*by).agg(worst.alias("__w"), F.count("*").alias("scanned"), F.count_if(F.col("answer") != "allow").alias("flagged"))
    return rolled.withColumn("answer", F.element_at(F.array(F.lit("allow"), F.lit("warn"), F.lit("block")), F.coalesce("__w", F.lit(0)) + 1)).drop("__w")


def agent_messages(df: DataFrame, sender: str, receiver: str) -> DataFrame:
    """Adds sender_agent, actor (the receiver, whose chain the message joins) and subject of messages between agents."""
    name = lambda c: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit("unknown-agent"))
    named = df.withColumns({"sender_agent": name(F.col(sender)), "actor": name(F.col(receiver))})
    return named.withColumn("subject", F.concat(F.lit("A2A: "), "sender_agent", F.lit(" → "), "actor"))


def hop(subject: Column, actor: Column) -> Column:
    """struct<sender, receiver> of such a subject; without its form, an unknown sender and the actor."""
    left, right = F.trim(F.substring_index(F.substr(subject, F.lit(5)), "→", 1)), F.trim(F.substring_index(subject, "→", -1))
    fits = subject.startswith("A2A:") & F.contains(subject, F.lit("→"))
    unknown, own = F.lit("unknown-agent"), F.coalesce(F.nullif(F.trim(actor), F.lit("")), F.lit("unknown-agent"))
    return F.struct(F.coalesce(F.when(fits, F.nullif(left, F.lit(""))), unknown).alias("sender"), F.coalesce(F.when(fits, F.nullif(right, F.lit(""))), own).alias("receiver"))


def without_spans(text: Column, spans: Column) -> Column:
    """A text with every span (in order, none overlapping) replaced by its kind in brackets."""
    return P.replaced(text, spans, lambda s: F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))


def redaction_plans(scored: DataFrame, text: str) -> DataFrame:
    """Adds plan to rows with a verdict (signals, severity): the spans whose removal lets a blocked text pass, empty where
    redaction can't cure it. A plan is proven: the redacted copy is detected and scored anew, decoded views included, and must
    neither block nor hold a confirmed leak. What only a decoded view shows has no place in the text, so its plan is empty.

    Verdict and proof are two runs of the detectors: give rows that were written or shuffled in between.
    """
    from quillguard.operators.pipelines import detect_decoded

    rows = scored.withColumn("__curable", R.locatable(F.col("signals")) & (answer(F.col("severity")) == "block")).drop("signals", "severity")
    spotted = R.with_spans(rows.withColumn("__cut", F.when(F.col("__curable"), F.col(text))), "__cut").withColumn("__clean", F.when(F.col("__curable"), without_spans(F.col(text), F.col("spans"))).otherwise(""))
    again = S.verdict(detect_decoded(spotted.select(*scored.drop("signals", "severity").columns, "__curable", "__clean", "spans"), "__clean"))
    proven = F.col("__curable") & (answer(F.col("severity")) != "block") & ~S.confirmed_leak(F.col("signals"))
    return again.withColumn("plan", F.when(proven, F.col("spans")).otherwise(F.slice("spans", 1, 0))).select(*scored.drop("signals", "severity").columns, "plan")


def self_test(attacks: DataFrame, text: str, disabled: list[str]) -> DataFrame:
    """Adds caught: whether an attack still warns or blocks under a policy that switches some checks off."""
    found = D.detect(attacks, text).withColumn("signals", S.without_checks(F.col("signals"), disabled))
    return S.verdict(found).withColumn("caught", answer(F.col("severity")) != "allow")


def pins(args: Column) -> Column:
    """array<struct<package, version>> of the pinned packages among a command's arguments."""
    pattern = r"^(@?[^@\s]+)@([0-9][^\s]*)$"
    return F.transform(F.filter(F.coalesce(args, F.expr("cast(array() as array<string>)")), lambda a: a.rlike(pattern)), lambda a: F.struct(F.lower(F.regexp_extract(a, pattern, 1)).alias("package"), F.regexp_extract(a, pattern, 2).alias("version")))


def vulnerable_pins(servers: DataFrame, key: list[str], advisories: DataFrame) -> DataFrame:
    """key, server, signals of servers whose pinned package has an advisory (package, version, advisory): an equal-key join."""
    pinned = servers.select(*key, "server", F.explode(pins(F.col("args"))).alias("p")).select(*key, "server", "p.package", "p.version")
    known = advisories.select(F.lower("package").alias("package"), "version", "advisory")
    hit = pinned.join(known, ["package", "version"]).withColumn("s", S.signal("dependency_risk", 0.9, 0.95, "vulnerable_server", detector="mcp_guard", evidence=F.col("advisory")))
    return hit.groupBy(*key, "server").agg(F.array_sort(F.collect_set("s")).alias("signals"))


def segments(identifier: Column) -> Column:
    """Lower-case words of an identifier in snake or camel case."""
    return F.transform(F.regexp_extract_all(identifier, F.lit("[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+"), F.lit(0)), lambda w: F.lower(w))


def domain_identifiers(text: Column, common: list[str]) -> Column:
    """Identifiers of a text that speak of a business: two words or more, and beyond the common ones three words in all, two
    content words, or content of seven letters."""
    names = F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\b[A-Za-z][A-Za-z0-9]*(?:_[A-Za-z0-9]+)+\b|\b[a-z]+(?:[A-Z][a-z0-9]+)+\b"), F.lit(0)))
    usual = F.array(*map(F.lit, common)) if common else F.expr("cast(array() as array<string>)")
    content = lambda w: F.filter(w, lambda s: (F.length(s) >= 3) & ~s.rlike("^[0-9]+$") & ~F.array_contains(usual, s))
    letters = lambda c: F.length(F.array_join(c, ""))
    rich = lambda n: (F.size(segments(n)) >= 2) & (F.size(content(segments(n))) >= 1) & ((F.size(segments(n)) >= 3) | (F.size(content(segments(n))) >= 2) | (letters(content(segments(n))) >= 7))
    return F.filter(names, rich)


def gate(scores: DataFrame, truth: str, model: str, rule: str, most_fp: float = 0.02) -> DataFrame:
    """One row: recall of a model and of the rule it is to replace, the model's false positive rate, and whether it may."""
    t, m, r = F.col(truth), F.col(model), F.col(rule)
    c = scores.agg(F.count_if(t).alias("__p"), F.count_if(~t).alias("__n"), F.count_if(t & m).alias("__tp"), F.count_if(t & r).alias("__rp"), F.count_if(~t & m).alias("__fp"))
    rates = c.select(F.round(F.try_divide("__tp", "__p"), 4).alias("recall"), F.round(F.try_divide("__rp", "__p"), 4).alias("rule_recall"), F.round(F.try_divide("__fp", "__n"), 4).alias("fp_rate"))
    return rates.withColumn("passes", F.coalesce((F.col("recall") > F.col("rule_recall")) & (F.coalesce("fp_rate", F.lit(0.0)) <= most_fp), F.lit(False)))
