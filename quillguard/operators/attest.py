"""Signed notes of commits that an agent worked on: the signature, and the findings of the time in which it worked."""

from __future__ import annotations

import hashlib
import hmac

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillguard.functions.keyed import hmac_sha256

PURPOSE, DIGITS, SLACK, CELL = b"commit-attestation", 24, 60, 3600


def signature(tenant: Column, sha: Column, secret: bytes) -> Column:
    """The first digits of the keyed digest of tenant:sha, by a key of its own made of the secret; the sha counts trimmed and in
    lower case. Null without a sha."""
    key = hmac.new(secret, PURPOSE, hashlib.sha256).digest()
    message = F.concat(tenant.cast("string"), F.lit(":"), F.lower(F.trim(sha)))
    return F.substring(hmac_sha256(message, key), 1, DIGITS)


def attested(commits: DataFrame, findings: DataFrame, secret: bytes, surfaces: list[str]) -> DataFrame:
    """commits with token, finding_ids (sorted) and findings (how many): those of the commit's actor, whatever the case of
    the name, on some surfaces, from a minute before window_start to a minute after window_end.

    commits: tenant, sha (each pair once), actor, window_start, window_end; findings: id, tenant, actor, surface, last_seen. An
    interval join by tenant, actor and hour, so no actor's whole history meets in one task. A commit without actor or window
    has no findings.
    """
    at = lambda c: F.unix_timestamp(c)
    span = commits.where("actor <> '' and window_start <= window_end").select("tenant", "sha", F.lower("actor").alias("__a"), (at("window_start") - SLACK).alias("__from"), (at("window_end") + SLACK).alias("__to"), F.explode(F.sequence(F.floor((at("window_start") - SLACK) / CELL), F.floor((at("window_end") + SLACK) / CELL))).alias("__cell"))
    seen = findings.where(F.col("surface").isin(*surfaces)).select("id", "tenant", F.lower("actor").alias("__a"), F.unix_micros(F.col("last_seen").cast("timestamp")).alias("__at")).withColumn("__cell", F.floor(F.col("__at") / (1_000_000 * CELL)))
    met = span.join(seen, ["tenant", "__a", "__cell"]).where("__at between __from * 1000000 and __to * 1000000")
    found = met.groupBy("tenant", "sha").agg(F.array_sort(F.collect_set("id")).alias("finding_ids"))
    out = commits.join(found, ["tenant", "sha"], "left").withColumn("finding_ids", F.coalesce("finding_ids", F.expr("cast(array() as array<bigint>)")))
    return out.withColumns({"findings": F.size("finding_ids"), "token": signature(F.col("tenant"), F.col("sha"), secret)})


def verified(notes: DataFrame, secret: bytes) -> DataFrame:
    """notes (tenant, sha, token) with valid: whether the token is the one that the secret gives."""
    return notes.withColumn("valid", F.coalesce(F.col("token") == signature(F.col("tenant"), F.col("sha"), secret), F.lit(False)))
