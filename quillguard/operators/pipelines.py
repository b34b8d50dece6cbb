"""Detectors over build pipelines, tool servers and decoded text; expressions and equal-key joins only, but for decoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillguard.functions import scoring as S
from quillguard.functions.text import decoded_views, keep_lines, reshaped_views
from quillguard.operators import detectors as D

#: Names that the CI vendor's documentation gives to what a fork's author controls.
HEAD = r"\bgithub\.(?:head_ref|event\.(?:pull_request\.head\.(?:ref|sha|label|repo\.(?:full_name|clone_url))|workflow_run\.head_(?:branch|sha|commit\.id)))\b"
UNPINNED = r"uses:\s*[\w.-]+/[\w./-]+@(?![0-9a-f]{40}\b)\S+"
MOVING = r"uses:\s*[\w.-]+/[\w./-]+@(?:main|master|latest|HEAD)\b"
AI_STEPS = ("openai", "gemini", "copilot", "aider")
FRESH_HOURS = 72


def ci_signals(df: DataFrame, yaml: str, ai_steps: tuple[str, ...] = AI_STEPS) -> DataFrame:
    """Adds signals of a pipeline file: foreign code with secrets, moving actions, broad rights, AI steps. Comments don't count."""
    t = F.regexp_replace(F.coalesce(F.col(yaml), F.lit("")), r"(?m)(?:^|\s)#.*$", "")
    foreign = t.rlike(r"\bpull_request_target\b") & t.rlike(HEAD)
    ai = t.rlike(r"(?i)(?:uses|run|image):[^\n]*\b(?:" + "|".join(ai_steps) + r")\b")
    moving = F.when(t.rlike(MOVING), 0.75).otherwise(0.5)
    one = lambda w, c, check: S.signal("ci_risk", w, c, check, detector="ci_guard")
    return df.withColumn("signals", S.signals(
        (foreign, one(0.9, 0.9, "foreign_checkout")), (t.rlike(r"\bpull_request_target\b|\bworkflow_run\b") & ~foreign, one(0.45, 0.8, "privileged_trigger")),
        (t.rlike(UNPINNED), one(moving, 0.85, "unpinned_action")), (t.rlike(r"permissions:\s*write-all\b"), one(0.55, 0.9, "write_all")),
        (t.rlike(r"secrets:\s*inherit\b"), one(0.6, 0.9, "secrets_inherit")), (t.rlike(r"runs-on:[^\n]*\bself-hosted\b") & t.rlike(r"\bpull_request"), one(0.65, 0.85, "self_hosted")),
        (ai, one(0.35, 0.9, "ai_step")), (ai & t.rlike(r"\$\{\{\s*secrets\.(?!GITHUB_TOKEN\b)"), one(0.8, 0.85, "secrets_to_ai")), (t.rlike(D.AUTONOMY), one(0.7, 0.9, "autonomy")),
    ))


def digest(text: Column) -> Column:
    """What repeats of a text share: lower case, single blanks."""
    return F.sha2(F.regexp_replace(F.trim(F.lower(text)), r"\s+", " ").cast("binary"), 256)


def poisoned_tools(df: DataFrame, key: str, descriptions: str, shared: DataFrame) -> DataFrame:
    """key, signals of tool descriptions (an array): hidden orders, and digests that others reported. shared: (digest)."""
    order = r"(?i)<(?:important|system|secret)>|\b(?:do not|never)\s+(?:tell|mention)\b[^\n]{0,60}\buser\b|\bignore (?:all )?previous\b|before using this tool[^\n]{0,80}\b(?:read|send)\b"
    each = df.select(key, F.explode(descriptions).alias("t")).withColumn("digest", digest(F.col("t")))
    known = each.join(shared.select("digest").distinct().withColumn("reported", F.lit(True)), "digest", "left")
    found = S.signals((F.col("t").rlike(order), S.signal("tool_poisoning", 0.9, 0.85, "tool_poisoning", detector="mcp_guard")), (F.coalesce("reported", F.lit(False)), S.signal("tool_poisoning", 0.95, 0.95, "shared_signature", detector="mcp_guard")))
    return known.select(key, F.explode(found).alias("s")).groupBy(key).agg(F.collect_list("s").alias("signals"))


def reputation_signals(servers: DataFrame, name: str, feed: DataFrame, denied: list[str], now: Column) -> DataFrame:
    """Adds signals of tool servers by a feed (name, tier, in_registry, published_at): joined by key, worst reason first."""
    f = feed.select(F.lower("name").alias("__name"), "tier", "in_registry", "published_at")
    j = servers.join(f, F.lower(F.trim(name)) == F.col("__name"), "left")
    one = lambda w, c, check: S.signal("untrusted_server", w, c, check, detector="mcp_reputation")
    age = F.unix_timestamp(now) - F.unix_timestamp("published_at")
    found = S.signals(
        (F.lower(F.trim(name)).isin(*[d.lower() for d in denied] or [""]), one(0.95, 0.98, "denied_server")), (F.col("tier") == "malicious", one(0.95, 0.95, "malicious_server")),
        (F.col("tier") == "caution", one(0.55, 0.7, "caution_server")), (~F.col("in_registry"), one(0.6, 0.8, "outside_registry")), (age < FRESH_HOURS * 3600, one(0.5, 0.65, "new_server")),
    )
    return j.withColumn("signals", found).drop("__name", "tier", "in_registry", "published_at")


@D.made_once
def _labels(views: str, held: str) -> Column:
    """Labels of vendors' formats in a text's other readings, by the readings' gates."""
    return D.real_secret_labels(F.col(views), D.SECRETS[1:] + D.MORE_SECRETS, F.col(held))


def detect_decoded(df: DataFrame, text: str) -> DataFrame:
    """The text detectors over a text, folded (which leaves ASCII as it stands), and what encoded runs of it hold; secrets of a
    vendor's format also over its other readings (split strings, JSON values, apart characters, broken lines, backwards,
    upper case). Each check counts once, as it was found first; hidden characters are looked for before the folding.

    Only texts with an encoded run, an escape or a percent sign go through the decoder, and only those that aren't ASCII
    through folding. Where the decoder's budget ended before the text did, a marker of no weight (decoding_unfinished) says so.
    """
    raw = F.col(text)
    staged = df.withColumn("__fold", keep_lines(raw))
    coded = F.col("__fold").rlike(r"[A-Za-z0-9+/_-]{16,}|(?:[0-9a-fA-F]{2}){8,}|\\[ux]|&#|%[0-9a-fA-F]{2}")
    staged = staged.withColumn("__read", F.when(coded, decoded_views(F.when(coded, F.col("__fold")))))
    staged = staged.withColumns({"__decoded": F.nullif(F.col("__read.text"), F.lit("")), "__unread": F.coalesce(F.col("__read.exhausted"), F.lit(False))})
    # the views are a column of their own: inside the patterns' expressions they would be made anew for each
    views = F.array_join(F.concat(reshaped_views(F.col("__fold")), F.array(F.upper("__fold"))), "\n")
    staged = staged.withColumn("__views", views).withColumn("__held", D.gates(F.col("__views")))
    found = D.detect(staged.withColumn("__all", F.concat_ws("\n", "__fold", "__decoded")), "__all", "__decoded", "__fold")
    hidden = S.signals((raw.rlike(D.INVISIBLE), S.signal("prompt_injection", 0.6, 0.7, "invisible_characters", detector="prompt_threats")))
    known = F.exists("signals", lambda s: s["check"] == "secret")
    found = found.withColumn("__labels", F.when(~known, _labels("__views", "__held")))
    shaped = S.signals((F.size("__labels") > 0, S.signal("secret_leak", 0.9, 0.85, "secret", detector="shadow_ai", evidence=F.array_join(F.slice("__labels", 1, 4), ", "))))
    kept = F.when(F.size("__labels") > 0, F.filter("signals", lambda s: s["check"] != "high_entropy")).otherwise(F.col("signals"))
    other = F.filter(hidden, lambda s: ~F.exists("signals", lambda p: p["check"] == s["check"]))
    unread = S.signals((F.col("__unread"), S.signal("detector_error", 0.0, 0.0, "decoding_unfinished", detector="decode")))
    return found.withColumn("signals", F.concat(kept, other, F.coalesce(shaped, F.expr(f"cast(array() as array<{S.SIGNAL}>)")), unread)).drop("__all", "__fold", "__read", "__decoded", "__unread", "__views", "__held", "__labels")


def secret_reach(label: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct<kind, severity> of a secret's label by the first prefix (prefix, kind, severity) that fits; unknown is high."""
    out = F.struct(F.lit("unknown").alias("kind"), F.lit("high").alias("severity"))
    for prefix, kind, severity in reversed(rules):
        out = F.when(label.startswith(prefix), F.struct(F.lit(kind).alias("kind"), F.lit(severity).alias("severity"))).otherwise(out)
    return out
