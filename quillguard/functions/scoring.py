"""Signals of a row, folded into a verdict by higher-order functions; no shuffle, no Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillguard.functions.columns import action, severity

SIGNAL = "struct<category:string,title:string,detail:string,weight:double,confidence:double,detector:string,evidence:string,check:string,fold:string>"
#: Category sets and limits of the score.
RISK = ("secret_leak", "pii_leak", "phi_leak", "confidential_data", "source_code_leak", "prompt_injection", "jailbreak", "data_exfiltration", "unsanctioned_ai", "untrusted_server", "tool_poisoning", "dangerous_action", "sensitive_access", "dependency_risk", "agent_autonomy", "oversharing", "ci_risk", "posture_gap")
ADVERSARIAL = ("prompt_injection", "jailbreak", "data_exfiltration", "tool_poisoning", "dangerous_action", "untrusted_server")
AI = ("ai_generated",)
HINTS = ("prompt_injection_ml", "source_code_ml")
CONTEXT = ("unsanctioned_ai",)
HINT_CAP, SYNERGY, AI_FROM, ATTACK_FROM = 34, 0.35, 0.5, 0.45


def signal(category: str, weight: float | Column, confidence: float | Column, check: str, title: str = "", detector: str = "", evidence: Column | None = None) -> Column:
    """One signal as a struct of the contract's type."""
    c = lambda x: x if isinstance(x, Column) else F.lit(float(x))
    return F.struct(
        F.lit(category).alias("category"), F.lit(title or check).alias("title"), F.lit("").alias("detail"), c(weight).cast("double").alias("weight"), c(confidence).cast("double").alias("confidence"),
        F.lit(detector or category).alias("detector"), (evidence if evidence is not None else F.lit("")).cast("string").alias("evidence"), F.lit(check).alias("check"), F.lit("").alias("fold"),
    )


def signals(*found: tuple[Column, Column]) -> Column:
    """array<SIGNAL> of those (condition, signal) whose condition holds, in the order given."""
    return F.filter(F.array(*(F.when(F.coalesce(when, F.lit(False)), what) for when, what in found)), lambda s: s.isNotNull())


def contribution(s: Column) -> Column:
    clamp = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(x, F.lit(0.0))))
    return clamp(s["weight"]) * clamp(s["confidence"])


def saturating(found: Column, categories: tuple[str, ...] | None = None) -> Column:
    """1 - product(1 - contribution) over the signals of some categories, in array order."""
    chosen = found if categories is None else F.filter(found, lambda s: s["category"].isin(*categories))
    return 1 - F.aggregate(chosen, F.lit(1.0), lambda acc, s: acc * (1 - contribution(s)))


def corroborated(found: Column) -> Column:
    """Without the code classifier's hint, unless another check speaks of source code or confidential data."""
    other = F.exists(found, lambda s: (s["check"] != "source_code_ml") & s["category"].isin("source_code_leak", "confidential_data"))
    return F.when(other, found).otherwise(F.filter(found, lambda s: ~s["check"].eqNullSafe("source_code_ml")))


def verdict(df: DataFrame, column: str = "signals") -> DataFrame:
    """Adds risk_score, severity, recommended_action, ai_generated, attack_intent; orders the signals, strongest first."""
    kept = df.withColumn(column, corroborated(F.coalesce(F.col(column), F.expr(f"cast(array() as array<{SIGNAL}>)"))))
    real = F.filter(column, lambda s: contribution(s) > 0)
    ai, risk = saturating(real, AI), saturating(real, RISK)
    raw = F.bround(F.least(F.lit(1.0), risk + SYNERGY * ai * risk) * 100, 0).cast("int")
    hinted = F.exists(real, lambda s: s["check"].isin(*HINTS))
    backed = F.exists(real, lambda s: ~s["check"].isin(*HINTS) & s["category"].isin(*RISK) & ~s["category"].isin(*CONTEXT))
    scored = kept.withColumns({
        "risk_score": F.when(hinted & ~backed, F.least(raw, F.lit(HINT_CAP))).otherwise(raw),
        "ai_generated": ai >= AI_FROM, "attack_intent": saturating(real, ADVERSARIAL) >= ATTACK_FROM,
    })
    return scored.withColumns({"severity": severity(F.col("risk_score")), "recommended_action": action(F.col("risk_score")), column: by_strength(F.col(column))})


def by_strength(found: Column) -> Column:
    """Strongest first; ties keep their order; markers without weight come last."""
    keyed = F.transform(found, lambda s, i: F.struct((-contribution(s)).alias("key"), i.alias("at"), s.alias("s")))
    return F.transform(F.array_sort(keyed), lambda k: k["s"])


def top(found: Column, n: int = 3) -> Column:
    """The n strongest signals."""
    return F.slice(by_strength(found), 1, n)


def primary(found: Column) -> Column:
    """The check of the strongest signal, 'unknown' without any; a null confidence counts as 1, a null weight as 0."""
    keyed = F.transform(found, lambda s, i: F.struct((F.coalesce(s["weight"], F.lit(0.0)) * F.coalesce(s["confidence"], F.lit(1.0))).alias("score"), (-i).alias("at"), F.coalesce(s["check"], s["category"]).alias("check")))
    return F.coalesce(F.array_max(F.filter(keyed, lambda k: k["check"].isNotNull()))["check"], F.lit("unknown"))


def without_checks(found: Column, disabled: list[str]) -> Column:
    """Policy: drop signals of disabled checks, or of a disabled category where the signal names no check; markers stay."""
    off = F.lit(disabled) if disabled else F.expr("cast(array() as array<string>)")
    return F.filter(found, lambda s: (s["check"] == "detector_error") | ~F.array_contains(off, F.coalesce(s["check"], s["category"], F.lit(""))))


def confirmed_leak(found: Column, heuristic: tuple[str, ...] = ("high_entropy", "bulk_email", "custom_pattern")) -> Column:
    return F.exists(found, lambda s: s["category"].isin("secret_leak", "pii_leak", "phi_leak") & ~s["check"].isin(*heuristic))


def boosted(risk: Column, sensitive: Column, matched: Column) -> Column:
    """A match with a known document adds 15 points, 25 and at least 60 where that document is sensitive."""
    return F.when(matched & sensitive, F.least(F.lit(100), F.greatest(F.lit(60), risk + 25))).when(matched, F.least(F.lit(100), risk + 15)).otherwise(risk)
