"""Detectors over manifests, configurations, device reports and agent files: parsed rows joined with small tables.

Lists of names (denied packages, known registries) are DataFrames or parameters. A table that only grows with the
outside world, such as a registry, is joined by key and never broadcast by force.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillguard.functions import scoring as S
from quillguard.functions.text import ZERO_WIDTH, for_match

ELSEWHERE = r"(?i)^(?:git[+:@]|https?:|file:|link:|github:|bitbucket:|gitlab:|\.{0,2}/)"
RUN_ON_INSTALL = r"(?i)(?:curl|wget)\s[^\n|;&]*\|\s*(?:ba)?sh|base64\s+-d[^\n|]*\|\s*(?:ba)?sh|/dev/tcp/|node\s+-e\s|python3?\s+-c\s"
INSTALL_STEPS = ("preinstall", "install", "postinstall", "prepare")
PACKAGE_LINE = r"(?im)^\s*\$?\s*(?:sudo\s+)?(pip3?|uv pip|npm|pnpm|yarn|cargo|gem|go)\s+(?:install|add|i|get)\s+([^\n;&|#]+)"
ECOSYSTEM = {"pip": "pypi", "pip3": "pypi", "uv pip": "pypi", "npm": "npm", "pnpm": "npm", "yarn": "npm", "cargo": "crates", "gem": "gem", "go": "go"}


def manifest_signals(df: DataFrame, key: str, manifest: str, denied: DataFrame) -> DataFrame:
    """key, signals of package manifests: denied names, shell payloads run on install, sources outside a registry.

    denied: (name). Each name and each source counts once however often it is listed.
    """
    x = F.from_json(manifest, "struct<dependencies:map<string,string>,devDependencies:map<string,string>,scripts:map<string,string>>")
    parsed = df.select(key, x.alias("x"))
    entries = lambda c: F.coalesce(F.map_entries(c), F.expr("cast(array() as array<struct<key:string,value:string>>)"))
    listed = parsed.select(key, F.explode(F.concat(entries(F.col("x.dependencies")), entries(F.col("x.devDependencies")))).alias("e")).select(key, F.lower(F.trim("e.key")).alias("name"), F.trim("e.value").alias("spec")).distinct()
    bad = listed.join(denied.select(F.lower("name").alias("name")).distinct(), "name", "left_semi").select(key, "name").distinct().groupBy(key).agg(F.array_sort(F.collect_set("name")).alias("bad"))
    outside = listed.where(F.col("spec").rlike(ELSEWHERE)).groupBy(key).agg(F.array_sort(F.collect_set(F.concat_ws("=", "name", "spec"))).alias("outside"))
    steps = F.filter(entries(F.col("x.scripts")), lambda e: e["key"].isin(*INSTALL_STEPS) & e["value"].rlike(RUN_ON_INSTALL))
    each = lambda names, w, c, check: F.transform(F.coalesce(names, F.expr("cast(array() as array<string>)")), lambda n: S.signal("dependency_risk", w, c, check, detector="dep_guard", evidence=n))
    all_ = parsed.select(key, F.transform(steps, lambda e: e["key"]).alias("steps")).join(bad, key, "left").join(outside, key, "left")
    return all_.select(key, F.concat(each(F.col("bad"), 0.95, 0.9, "denied_dependency"), each(F.col("steps"), 0.95, 0.9, "install_script"), each(F.col("outside"), 0.55, 0.8, "outside_registry")).alias("signals"))


def installs(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, ecosystem, package, line: packages that a text tells to install, each once."""
    lines = df.select(key, F.explode(F.regexp_extract_all(text, F.lit(PACKAGE_LINE), F.lit(0))).alias("line"))
    tool = F.lower(F.regexp_replace(F.regexp_extract("line", PACKAGE_LINE, 1), r"\s+", " "))
    names = F.filter(F.split(F.trim(F.regexp_extract("line", PACKAGE_LINE, 2)), r"\s+"), lambda n: ~n.rlike("^[-.]|/.*/|://") & (n != ""))
    bare = lambda n: F.regexp_replace(F.lower(n), r"(?<=.)(?:@|[<>=!~\[]).*$", "")
    eco = F.create_map(*(F.lit(x) for kv in ECOSYSTEM.items() for x in kv))[tool]
    return lines.select(key, eco.alias("ecosystem"), F.explode(F.transform(names, bare)).alias("package"), F.substring(F.trim("line"), 1, 160).alias("line")).dropDuplicates([key, "ecosystem", "package"])


def phantom_packages(df: DataFrame, key: str, text: str, registry: DataFrame, now: Column, fresh_days: int = 14) -> DataFrame:
    """key, package, check, line: packages that no registry has, or only since a few days. registry: (ecosystem, package, first_seen)."""
    found = installs(df, key, text).join(registry, ["ecosystem", "package"], "left")
    age = F.date_diff(now.cast("date"), F.col("first_seen").cast("date"))
    check = F.when(F.col("first_seen").isNull(), "missing_package").when(age <= fresh_days, "fresh_package")
    return found.withColumn("check", check).where("check is not null").select(key, "ecosystem", "package", "check", "line")


def extension_signals(df: DataFrame, key: str, ext: str, denied: list[str], allowed: list[str], agentic: list[str]) -> DataFrame:
    """IDE extensions, one signal each: denied, else not on the list there is, else agentic."""
    e = F.lower(F.trim(ext))
    one = (
        F.when(e.isin(*denied or [""]), S.signal("dependency_risk", 0.95, 0.9, "denied_extension", detector="ext_guard", evidence=e))
        .when(F.lit(bool(allowed)) & ~e.isin(*allowed or [""]), S.signal("dependency_risk", 0.6, 0.85, "unapproved_extension", detector="ext_guard", evidence=e))
        .when(e.isin(*agentic or [""]) & ~e.isin(*allowed or [""]), S.signal("unsanctioned_ai", 0.5, 0.9, "agentic_extension", detector="ext_guard", evidence=e))
    )
    return df.select(key, one.alias("s")).groupBy(key).agg(F.collect_list("s").alias("signals"))


POSTURE = "struct<proxy:struct<env_points_local:boolean,listening:boolean,listener:string,port:int>,breaker:struct<deauth_active:boolean,cooldown_active:boolean>,gaps:struct<wsl:boolean,docker_present:boolean,in_container:boolean>,local_llms:array<struct<name:string,listening:boolean>>>"


def posture_signals(df: DataFrame, report: str, own: str = "quillguard") -> DataFrame:
    """Adds signals of device reports: local models, dead or displaced proxies, suspended scans, traffic that isn't seen."""
    p = F.from_json(report, POSTURE)
    yes = lambda c: F.coalesce(c, F.lit(False))
    llms = F.transform(F.coalesce(p["local_llms"], F.expr("cast(array() as array<struct<name:string,listening:boolean>>)")), lambda m: S.signal("unsanctioned_ai", F.when(yes(m["listening"]), 0.55).otherwise(0.4), 0.9, "local_llm", detector="device_posture", evidence=m["name"]))
    rest = S.signals(
        (yes(p["proxy"]["env_points_local"]) & ~yes(p["proxy"]["listening"]), S.signal("posture_gap", 0.8, 0.95, "proxy_dead", detector="device_posture")),
        (yes(p["proxy"]["listening"]) & (F.coalesce(p["proxy"]["listener"], F.lit("")) != "") & ~F.contains(F.lower(p["proxy"]["listener"]), F.lit(own)), S.signal("posture_gap", 0.6, 0.8, "proxy_port_conflict", detector="device_posture", evidence=p["proxy"]["listener"])),
        (yes(p["breaker"]["deauth_active"]), S.signal("posture_gap", 0.8, 0.9, "capture_key_revoked", detector="device_posture")),
        (~yes(p["breaker"]["deauth_active"]) & yes(p["breaker"]["cooldown_active"]), S.signal("posture_gap", 0.5, 0.9, "scan_fail_open", detector="device_posture")),
        ((yes(p["gaps"]["wsl"]) | yes(p["gaps"]["docker_present"])) & ~yes(p["gaps"]["in_container"]), S.signal("posture_gap", 0.15, 0.6, "coverage_gap", detector="device_posture")),
    )
    return df.withColumn("signals", F.concat(llms, rest))


HIDDEN = ZERO_WIDTH[:-1] + r"\x{202a}-\x{202e}\x{2066}-\x{2069}\x{e0000}-\x{e007f}]"
ORDER = r"(?i)\b(?:you must|always|never|ignore|do not|run|execute|send)\b"
SEND = r"(?i)(?:(?:send|post|upload|forward|copy)\b[^\n]{0,120}(?:\.env\b|credential|secret|api[ _-]?key|token|id_rsa)|(?:\.env\b|credential|secret|api[ _-]?key|id_rsa)[^\n]{0,120}\b(?:send|post|upload|forward)\b)[^\n]{0,160}(?:https?://|@|webhook)"
SECRECY = r"(?i)(?:do not|don't|never)\s+(?:tell|inform|mention|show|reveal)[^\n]{0,60}\b(?:user|human|developer|reviewer)|\bsilently\s+(?:run|execute|install|send|add)"
PREAMBLE = r"(?i)before (?:using|calling|running) any (?:other )?tools?\b[^\n]{0,80}\b(?:first|must)|always (?:run|call|execute)[^\n]{0,80}\bfirst\b"
REMOTE = r"(?i)\b(?:curl|wget)\b[^|\n]{1,300}\|\s*(?:ba|z)?sh\b|iex\s*\(\s*(?:irm|iwr)"


def rules_file_signals(df: DataFrame, text: str) -> DataFrame:
    """Adds signals of agent rules files: hidden characters, orders in comments, sending secrets, secrecy, preambles, remote scripts."""
    raw = F.coalesce(F.col(text), F.lit(""))
    t = F.concat_ws("\n", raw, for_match(raw))
    closed = F.substring(raw, F.lit(1), F.length(raw) - F.length(F.substring_index(raw, "-->", -1)))  # up to the last end of a comment
    comments = F.array_join(F.regexp_extract_all(closed, F.lit(r"(?s)<!--(.*?)-->"), F.lit(1)), "\n")
    return df.withColumn("signals", S.signals(
        (raw.rlike(HIDDEN), S.signal("prompt_injection", 0.85, 0.9, "rules_concealment", detector="agent_rules")),
        (comments.rlike(ORDER), S.signal("prompt_injection", 0.75, 0.8, "rules_comment", detector="agent_rules")),
        (t.rlike(SEND), S.signal("data_exfiltration", 0.9, 0.85, "rules_exfil", detector="agent_rules")),
        (t.rlike(SECRECY), S.signal("prompt_injection", 0.8, 0.85, "rules_secrecy", detector="agent_rules")),
        (t.rlike(PREAMBLE), S.signal("tool_poisoning", 0.7, 0.75, "rules_tool_poison", detector="agent_rules")),
        (t.rlike(REMOTE), S.signal("tool_poisoning", 0.5, 0.6, "rules_remote_exec", detector="agent_rules")),
    ))


def canary_signals(df: DataFrame, text: str, inbound: Column, marker: str = r"canary-instruction:([0-9a-f]{8,64})") -> DataFrame:
    """Adds signals of planted instructions: read where they come in, obeyed where an agent's tool call holds them."""
    found = F.regexp_extract(F.coalesce(F.col(text), F.lit("")), marker, 1)
    return df.withColumn("signals", S.signals(
        ((found != "") & inbound, S.signal("prompt_injection", 0.55, 0.95, "canary_read", detector="canary", evidence=F.substring(found, 1, 8))),
        ((found != "") & ~inbound, S.signal("dangerous_action", 0.9, 0.95, "canary_obeyed", detector="canary", evidence=F.substring(found, 1, 8))),
    ))


#: Famous stems of so many letters may be two edits away.
LONG = 12


def stem(name: Column) -> Column:
    """What tells a package name apart, without the words that many share."""
    return F.array_join(F.filter(F.split(F.lower(name), r"[@/_.\-]+"), lambda t: ~t.isin("", "mcp", "server", "srv")), "")


def deletions(s: Column, twice: Column | None = None) -> Column:
    """A string and all that one deletion leaves of it (two, where twice says so): strings as many edits or swaps apart share one of them."""
    once = lambda c: F.transform(F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1))), lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, F.length(c))))
    first = F.concat(F.array(s), once(s))
    more = F.flatten(F.transform(F.array_distinct(once(s)), once))
    return F.array_distinct(first if twice is None else F.when(twice, F.concat(first, more)).otherwise(first))


@F.pandas_udf(T.IntegerType())
def alignment_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """Optimal-string-alignment distance: edits and swaps of neighbours, no part edited twice. No built-in function has it."""

    def distance(x: str, y: str) -> int:
        before, last = [], list(range(len(y) + 1))
        for i in range(1, len(x) + 1):
            row = [i] + [0] * len(y)
            for j in range(1, len(y) + 1):
                row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x[i - 1] != y[j - 1]))
                if i > 1 and j > 1 and x[i - 1] == y[j - 2] and x[i - 2] == y[j - 1]:
                    row[j] = min(row[j], before[j - 2] + 1)
            before, last = last, row
        return last[-1]

    return pd.Series([distance(x, y) for x, y in zip(a, b)], dtype="int32")


def typosquats(names: DataFrame, famous: DataFrame) -> DataFrame:
    """name, near: names whose stem is one edit (or one swap of neighbours) from a famous one's of six letters or more, or
    two from one's of LONG letters or more.

    Deletion neighbourhoods make the comparison an equal key: no name meets all famous names.
    """
    n = names.select(F.lower("name").alias("name")).distinct().withColumn("s", stem(F.col("name")))
    f = famous.select(F.lower("name").alias("near")).distinct().withColumn("r", stem(F.col("near"))).where(F.length("r") >= 6)
    scope = lambda c: F.regexp_extract(c, r"^(@[^/]+)/", 1)
    keys = lambda c, least: F.explode(deletions(F.col(c), F.length(c) >= least)).alias("k")
    pairs = n.select("*", keys("s", LONG - 2)).join(f.select("*", keys("r", LONG)), "k").drop("k").distinct()
    pairs = pairs.where("name <> near and not startswith(s, r) and not startswith(r, s)")
    near = pairs.where(alignment_distance("s", "r") <= F.when(F.length("r") >= LONG, 2).otherwise(1))
    near = near.where((scope(F.col("name")) == "") | (scope(F.col("name")) != scope(F.col("near"))))
    return near.groupBy("name").agg(F.min("near").alias("near"))


def feed_tiers(rows: DataFrame) -> DataFrame:
    """name, tier, score, reason of (name, evidence, risks, gaps, bonus, penalty, reason): the worst row wins a name."""
    tier = F.when(F.col("evidence"), "malicious").when((F.col("risks") == 0) & (F.col("gaps") == 0), "trusted").when(F.col("risks") > 0, "caution").otherwise("unverified")
    score = F.when(tier == "malicious", 0).when(tier == "trusted", F.least(F.lit(95), 80 + 5 * F.col("bonus"))).otherwise(F.greatest(F.lit(10), F.least(F.lit(65), 70 - F.col("penalty"))))
    worst = F.array_position(F.array(*map(F.lit, ("trusted", "unverified", "caution", "malicious"))), tier)
    return rows.groupBy(F.lower("name").alias("name")).agg(F.max(F.struct(worst.alias("w"), (-score).alias("s"), tier.alias("tier"), score.alias("score"), "reason")).alias("b")).select("name", "b.tier", "b.score", "b.reason")
