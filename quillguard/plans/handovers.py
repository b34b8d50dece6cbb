"""Exports, remedies and inventories over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillguard.operators import detectors as D
from quillguard.operators import remedies as R
from quillguard.plans import planted
from quillguard.plans.base import findings, query, read, spread
from quillguard.sources import handover as H

STAGE_SQL = "CASE category WHEN 'prompt_injection' THEN ['injection'] WHEN 'secret_leak' THEN ['collection'] WHEN 'pii_leak' THEN ['collection'] WHEN 'source_code_leak' THEN ['collection'] ELSE [] END"
LEVEL_SQL = "CASE severity WHEN 'critical' THEN 9 WHEN 'high' THEN 7 WHEN 'suspicious' THEN 5 WHEN 'low' THEN 3 ELSE 0 END"


@query("session_events", f""", e AS (SELECT id, ts, actor, 'vendor' || (k % 12) AS vendor, CASE WHEN k % 6 = 0 THEN 'session' ELSE surface END AS surface, CASE WHEN k % 4 = 0 THEN 'subject ' || k ELSE tool END AS action, category, severity, risk, {STAGE_SQL} AS stages FROM f WHERE ts >= TIMESTAMP '2024-01-20')
SELECT id, '{{"ts":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '","actor":"' || actor || '","vendor":"' || vendor || '","surface":"' || surface || '","action":"' || action || '","categories":["' || category || '"],"stages":[' || CASE WHEN len(stages) > 0 THEN '"' || stages[1] || '"' ELSE '' END || '],"severity":"' || severity || '","risk_score":' || risk || ',"is_chain":' || (surface = 'session') || ',"finding_id":' || id || ',"seen_count":1,"org":"acme"}}' AS line,
'CEF:0|quillguard|engine|1|' || category || '|[' || vendor || '] ' || action || '|' || {LEVEL_SQL} || '|suser=' || actor || ' cs1=' || id || ' cs2=' || coalesce(stages[1], '') || ' cn1=' || risk AS cef FROM e""", True)
def session_events(spark, sf) -> DataFrame:
    """The trail of events from a watermark on, as JSON lines and as CEF; handover.write_trail writes them in order."""
    f = findings(spark, sf)
    k = F.col("k")
    rows = f.select("id", F.col("ts").alias("last_seen"), "actor", "k", F.when(k % 6 == 0, "session").otherwise(F.col("surface")).alias("surface"), F.when(k % 4 == 0, F.concat(F.lit("subject "), k)).otherwise("").alias("subject"), F.col("tool").alias("channel"), F.array("category").alias("categories"), "severity", F.col("risk").alias("risk_score"), F.lit(None).cast("int").alias("seen_count"))
    return H.since(H.normalised(rows, F.concat(F.lit("vendor"), k % 12), "acme"), "2024-01-20").select("id", "line", "cef")


@query("tenant_documents", """WITH d AS (SELECT c_nationkey AS t, 'customers' AS section, '{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '","c_mktsegment":"' || c_mktsegment || '"}' AS doc FROM customer UNION ALL SELECT s_nationkey, 'suppliers', '{"s_suppkey":' || s_suppkey || ',"s_name":"' || s_name || '"}' FROM supplier
UNION ALL SELECT c_nationkey, 'orders', '{"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}' FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT CAST(t AS VARCHAR) AS tenant, section, count(*) AS rows, CAST(sum(length(doc) + 1) AS BIGINT) AS bytes, min(doc) AS first, max(doc) AS last FROM d GROUP BY ALL""")
def tenant_documents(spark, sf) -> DataFrame:
    """Everything held of each nation, section by section, without the balances, which are secret, and without prices."""
    c, s, o = (read(spark, sf, t) for t in ("customer", "supplier", "orders"))
    owned = o.join(c.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).select("c_nationkey", "o_orderkey", "o_orderstatus")
    docs = H.tenant_documents({"customers": (c.select("c_custkey", "c_name", "c_mktsegment", "c_acctbal", "c_nationkey"), "c_nationkey", ["c_acctbal"]), "suppliers": (s.select("s_suppkey", "s_name", "s_nationkey"), "s_nationkey", []), "orders": (owned, "c_nationkey", [])})
    return docs.groupBy("tenant", "section").agg(F.count("*").alias("rows"), F.sum(F.octet_length("doc") + 1).alias("bytes"), F.min("doc").alias("first"), F.max("doc").alias("last"))


CHECKED = {"secret": "secret_leak", "iban": "pii_leak", "nino": "pii_leak", "identity_number": "pii_leak", "keyed_number": "pii_leak", "phones": "pii_leak", "bulk_email": "pii_leak", "health_identifier": "phi_leak", "marker": "confidential_data", "source_code": "source_code_leak", "instruction_override": "prompt_injection", "jailbreak": "jailbreak", "data_exfiltration": "data_exfiltration", "invisible_characters": "prompt_injection", "dangerous_command": "dangerous_action", "sensitive_path": "sensitive_access", "autonomy_flag": "agent_autonomy"}
SOURCE_SQL = f"SELECT 'r' || doc_id AS name, {planted.planted_sql(planted.quoted('r') + ' || doc_id')} || chr(10) || text AS t FROM documents"


def steps_sql() -> str:
    has = lambda categories: "len(list_intersect(string_split(checks, ','), [" + ", ".join(planted.quoted(c) for c, k in CHECKED.items() if k in categories) + "])) > 0"
    some = lambda name: "(" + " OR ".join(f"len(list_filter(regexp_extract_all(t, {planted.quoted(p)}), lambda m: NOT regexp_matches(m, {planted.quoted(D.PLACEHOLDER)}))) > 0" for n, p in D.SECRETS + D.MORE_SECRETS if name in n) + ")"
    vendors = [(p, s) for c, p, s in R.STEPS if c == ("secret_leak",) and p]
    rows = [f"CASE WHEN {some(p)} THEN {planted.quoted(s)} END" for p, s in vendors]
    for c, p, s in R.STEPS:
        if p is None and any(k in c for k in CHECKED.values()):
            rows.append(f"CASE WHEN {has(c)}" + (f" AND NOT ({' OR '.join(some(p) for p, _ in vendors)})" if c == ("secret_leak",) else "") + f" THEN {planted.quoted(s)} END")
    return f"WITH c AS ({planted.checks_sql(SOURCE_SQL)}), s AS ({SOURCE_SQL}) SELECT name, unnest(list_filter([{', '.join(rows)}], lambda x: x IS NOT NULL)) AS step FROM c JOIN s USING (name)"


@query("remediation_steps", steps_sql())
def remediation_steps(spark, sf) -> DataFrame:
    """What to do about what is found in each document; steps of vendors where the label names one."""
    name = F.concat(F.lit("r"), F.col("doc_id").cast("string"))
    rows = read(spark, sf, "documents").select(name.alias("name"), F.concat(planted.planted(name), F.lit("\n"), "text").alias("t"))
    found = D.detect(spread(rows), "t").withColumn("signals", F.filter("signals", lambda s: s["check"].isin(*planted.LISTED)))
    return found.select("name", F.explode(R.remedies(F.col("signals"))).alias("step"))


@query("extension_reports", """, r AS (SELECT actor AS device, date_trunc('day', ts) AS d0, CASE WHEN k % 3 <> 0 THEN lower(tool) END AS item, max(risk) AS version FROM f GROUP BY ALL), t AS (SELECT device, d0, row_number() OVER (PARTITION BY device ORDER BY d0) AS turn, count(*) OVER (PARTITION BY device) AS last FROM (SELECT DISTINCT device, d0 FROM r)),
s AS (SELECT r.*, turn, last, turn - row_number() OVER (PARTITION BY device, item ORDER BY turn) AS spell FROM r JOIN t USING (device, d0) WHERE item IS NOT NULL)
SELECT device, item, arg_max(version, turn) AS version, min(d0) AS first_seen, max(d0) AS last_seen FROM s GROUP BY device, item, spell, last HAVING max(turn) = last""", True)
def extensions(spark, sf) -> DataFrame:
    """What each device's last report lists; a day's events stand for its report, tools for what is installed."""
    r = findings(spark, sf).select(F.col("actor").alias("device"), F.date_trunc("day", "ts").alias("at"), F.when(F.col("k") % 3 != 0, F.upper("tool")).alias("item"), F.col("risk").alias("version"))
    out = R.latest_inventory(r, ["device"], "at", "item", ["version"])
    return out.select("device", "item", "version", *(F.col(c).cast("timestamp_ntz").alias(c) for c in ("first_seen", "last_seen")))


HOST_SQL = "lower(regexp_extract(url, '://([^/?#:]*)', 1))"


@query("destination_findings", f"""WITH h AS (SELECT page_id, {HOST_SQL} AS host FROM pages), k AS (SELECT DISTINCT regexp_extract(host, '[^.]+[.][^.]+$') AS domain FROM h WHERE page_id % 5 = 0 AND host <> ''),
m AS (SELECT page_id, host, max(length(domain)) AS n, arg_max(domain, length(domain)) AS domain FROM h LEFT JOIN k ON host = domain OR ends_with(host, '.' || domain) GROUP BY ALL), m2 AS (SELECT page_id, host, arg_max(domain, coalesce(n, 0)) AS domain FROM m GROUP BY ALL)
SELECT host, CASE WHEN host = '' OR host = 'example.com' OR ends_with(host, '.example.com') THEN 'none' WHEN domain IS NOT NULL THEN 'unsanctioned_tool Tool of ' || domain || ' 0.35 0.65' ELSE 'unknown_destination 0.28 0.45' END AS verdict, count(*) AS pages FROM m2 GROUP BY ALL""")
def destinations(spark, sf) -> DataFrame:
    """Hosts of pages as destinations: those of a catalogue, by the longest domain, unknown ones, and those that are sanctioned.
    The catalogue is made of every fifth page's own domain."""
    from quillguard.functions.columns import host_of
    from quillguard.operators import commands as M

    pages = read(spark, sf, "pages").select("page_id", "url")
    domain = F.regexp_extract(host_of(F.col("url")), "[^.]+[.][^.]+$", 0)
    known = pages.where("page_id % 5 = 0").select(domain.alias("domain")).where("domain <> ''").distinct().select("domain", F.concat(F.lit("Tool of "), "domain").alias("tool"))
    found = M.destination_signals(pages, "url", known, ["example.com"]).withColumn("host", host_of(F.col("url")))
    said = F.transform("signals", lambda s: F.concat_ws(" ", s["check"], F.when(s["check"] == "unsanctioned_tool", s["evidence"]), s["weight"].cast("string"), s["confidence"].cast("string")))
    return found.groupBy("host", F.coalesce(F.get(said, F.lit(0)), F.lit("none")).alias("verdict")).agg(F.count("*").alias("pages"))
