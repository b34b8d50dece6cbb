"""Who may do what: containment, allow entries, roles, need-to-know, lanes. Policies are small tables that are broadcast
only as such (a row a rule); globs become anchored patterns once."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillguard.functions import scoring as S
from quillguard.functions.columns import glob_match, glob_regex

SCOPES = ("org", "agent", "device", "user")
RESTRICTED = ("secret_leak", "pii_leak", "phi_leak", "source_code_leak", "confidential_data")


def contained(callers: DataFrame, rules: DataFrame, now: Column) -> DataFrame:
    """Adds contained_by (scope, or null): the widest active rule over a caller's org, agent, device or user.

    rules: (scope, target, expires_at, released_at). Each scope is an equal key, so a long rule table still joins.
    """
    active = rules.where(F.col("released_at").isNull() & (F.col("expires_at") > now)).select("scope", F.lower("target").alias("target")).distinct()
    out = callers.withColumn("contained_by", F.lit(None).cast("string"))
    for scope in SCOPES:
        hits = active.where(F.col("scope") == scope)
        if scope == "org":
            out = out.crossJoin(hits.agg((F.count("*") > 0).alias("__hit")))  # one row
        else:
            out = out.join(hits.select(F.col("target").alias("__t"), F.lit(True).alias("__hit")), F.lower(F.trim(F.col(scope).cast("string"))) == F.col("__t"), "left").drop("__t")
        out = out.withColumn("contained_by", F.coalesce("contained_by", F.when(F.col("__hit"), scope))).drop("__hit")
    return out


def allowed_entries(actions: DataFrame, entries: DataFrame, now: Column) -> DataFrame:
    """Actions, each row as often as it stands, with entry_id of the first allow entry that covers them: (entry_id, actor or
    null, tool, expires_at, revoked). Entries are a row per tool, and per tool and actor, before they are joined by these."""
    live = entries.where(~F.coalesce("revoked", F.lit(False)) & (F.col("expires_at").isNull() | (F.col("expires_at") > now)))
    anyone = live.where("actor is null").groupBy("tool").agg(F.min("entry_id").alias("__any"))
    own = live.where("actor is not null").groupBy("tool", "actor").agg(F.min("entry_id").alias("__own"))
    hit = actions.join(anyone, "tool", "left").join(own, ["tool", "actor"], "left")
    return hit.select(*actions.columns, F.least("__any", "__own").alias("entry_id"))


def command_parts(command: Column) -> Column:
    """Every command a shell line runs: statements and the stages of their pipes, quoted separators aside."""
    quoted = F.regexp_replace(command, r"""'[^']*'|"[^"]*\"""", "_")
    parts = F.transform(F.split(quoted, r"&&|\|\||[;\n|&]"), lambda p: F.trim(p))
    return F.filter(parts, lambda p: p != "")


def any_glob(value: Column, globs: list[str]) -> Column:
    return value.rlike("|".join(f"(?:{glob_regex(g.lower())})" for g in globs)) if globs else F.lit(False)


def authorised(actions: DataFrame, role: dict) -> DataFrame:
    """Adds denied and reason for (server, tool, command) under a role: deny globs first, then commands, tools and servers.

    role: lists deny, allow_commands, allow_tools, allow_servers, and default_allow. A shell command is judged part by
    part; substitution can't be checked and is refused where commands are limited.
    """
    server, tool, command = (F.lower(F.coalesce(F.col(c), F.lit(""))) for c in ("server", "tool", "command"))
    parts = command_parts(command)
    deny, commands, tools, servers = (role.get(k) or [] for k in ("deny", "allow_commands", "allow_tools", "allow_servers"))
    denied = F.exists(F.concat(parts, F.array(tool, server, command)), lambda v: (v != "") & any_glob(v, deny))
    shell = command != ""
    bad_command = F.lit(bool(commands)) & shell & (F.exists(parts, lambda p: ~any_glob(p, commands)) | command.rlike(r"\$\(|`|<\(") | (F.size(parts) == 0))
    listed = F.lit(bool(tools or servers))
    outside = ~shell & listed & ~((any_glob(tool, tools) if tools else F.lit(True)) & (any_glob(server, servers) if servers else F.lit(True)))
    default = ~shell & ~listed & F.lit(not role.get("default_allow", False))
    reason = F.when(denied, "denied").when(bad_command, "command").when(outside, "not_listed").when(default, "default_deny")
    return actions.withColumn("reason", reason).withColumn("denied", F.col("reason").isNotNull())


def need_to_know(df: DataFrame, rules: list[tuple[str, list[str]]], actor: str = "actor", text: str = "text") -> DataFrame:
    """Adds an oversharing signal for each rule whose category (or kw:word) is there and whose globs the actor matches none of."""
    who = F.lower(F.coalesce(F.trim(actor), F.lit("")))
    found = []
    for key, globs in rules:
        there = F.contains(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(key[3:].lower())) if key.startswith("kw:") else F.exists("signals", lambda s: s["category"] == key)
        found.append((there & ~((who != "") & any_glob(who, globs)), S.signal("oversharing", 0.8, 0.85, "data_oversharing", evidence=F.lit(key))))
    return df.withColumn("signals", F.concat("signals", S.signals(*found))) if found else df


def lane(signals: Column, classes: list[str]) -> Column:
    """Whether a private lane's classes are among the categories."""
    return F.arrays_overlap(F.transform(signals, lambda s: s["category"]), F.lit(classes))


def left_the_boundary(model: Column, action: Column) -> Column:
    """Whether data got out: observed traffic always did; enforced traffic only where it was allowed."""
    return (model == "observe") | ((model == "enforce") & action.isin("allow", "warn", "monitor"))


def sanctioned(tool: Column, host: Column, tools: list[str], domains: list[str]) -> Column:
    under = None
    for d in domains:
        hit = (host == d) | host.endswith(f".{d}")
        under = hit if under is None else under | hit
    named = F.lower(tool).isin(*[t.lower() for t in tools]) if tools else F.lit(False)
    return named if under is None else named | F.coalesce(under, F.lit(False))


def browser_extension_signals(df: DataFrame, name: str, enabled: Column, known: list[str], approved: list[str]) -> DataFrame:
    """Adds a signal where an enabled browser extension is a known AI one that isn't approved."""
    n = F.lower(F.trim(name))
    found = (enabled & n.isin(*[k.lower() for k in known] or [""]) & ~n.isin(*[a.lower() for a in approved] or [""]), S.signal("unsanctioned_ai", 0.5, 0.9, "browser_ai_extension", detector="ext_guard", evidence=n))
    return df.withColumn("signals", S.signals(found))


def server_signals(df: DataFrame, call: str, allowed: list[str]) -> DataFrame:
    """Adds signals of tool calls (JSON with server, transport, pin_status): servers outside the allow list, where there is one
    (less sure of local ones), and binaries that differ from their pin."""
    c = F.from_json(call, "struct<server:string,transport:string,pin_status:string>")
    server = F.lower(F.trim(F.coalesce(c["server"], F.lit(""))))
    return df.withColumn("signals", S.signals(
        (F.lit(bool(allowed)) & (server != "") & ~any_glob(server, allowed), S.signal("untrusted_server", 0.85, F.when(c["transport"].eqNullSafe("local"), 0.7).otherwise(0.9), "untrusted_server", detector="mcp_guard", evidence=server)),
        (c["pin_status"] == "mismatch", S.signal("untrusted_server", 0.9, 0.9, "pin_mismatch", detector="mcp_guard", evidence=server)),
    ))


def suppressed(tool: Column, category: Column, rules: str) -> Column:
    """Whether rules of the form 'tool:category,category; tool:category' take a category out for a tool."""
    out = F.lit(False)
    for rule in filter(None, map(str.strip, rules.split(";"))):
        name, _, categories = rule.partition(":")
        out = out | ((F.lower(tool) == name.strip().lower()) & category.isin(*(c.strip() for c in categories.split(","))))
    return out


def low_signal_path(path: Column) -> Column:
    """Whether a path is of tests, examples, documents or vendored code, where keys are mostly samples."""
    return path.rlike(r"(?i)(?:^|/)(?:tests?|testdata|fixtures?|examples?|samples?|mocks?|docs?|vendor|node_modules|third_party)/|(?:^|/)(?:test_[^/]+|[^/]+[_.](?:test|spec))\.[a-z]+$|\.(?:md|rst|adoc)$")


def clean_path(path: Column) -> Column:
    """A path without repeated slashes, dots and the parts that .. takes back; words only, nothing is looked up."""
    parts = F.filter(F.split(F.regexp_replace(path, r"\\", "/"), "/+"), lambda p: ~p.isin("", "."))
    step = lambda acc, p: F.when((p == "..") & (F.size(acc) > 0), F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).when(p == "..", acc).otherwise(F.concat(acc, F.array(p)))
    return F.array_join(F.aggregate(parts, F.expr("cast(array() as array<string>)"), step), "/")


def path_match(path: Column, glob: str) -> Column:
    """A path glob: ** for any folders, * and ? inside one name."""
    body = re.escape(glob).replace(r"\*\*/", "(?:[^/]+/)*").replace(r"\*\*", ".*").replace(r"\*", "[^/]*").replace(r"\?", "[^/]")
    return clean_path(path).rlike(f"^{body}$")


__all__ = ["allowed_entries", "any_glob", "authorised", "command_parts", "contained", "glob_match", "lane", "left_the_boundary", "need_to_know", "sanctioned"]
