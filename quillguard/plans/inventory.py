"""Inventories: documents, tools, devices, deliveries, secrets; latest rows, paging, sets. Partial sums before shuffles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillguard.functions.columns import host_of, rank, slot_of
from quillguard.operators.catalog import longest_match
from quillguard.plans.base import NOW, findings, query, read

RANK_SQL = "CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'suspicious' THEN 2 WHEN 'low' THEN 1 ELSE 0 END"
n = lambda name="n": F.count("*").alias(name)
joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")


@query("exposure_by_document", f"SELECT k % 30 AS ref, count(*) AS leaks, count(DISTINCT actor) AS users, max({RANK_SQL}) AS worst, string_agg(DISTINCT tool, ',' ORDER BY tool) AS tools FROM f WHERE category IN ('secret_leak', 'source_code_leak') GROUP BY 1", True)
def exposure_by_document(spark, sf) -> DataFrame:
    f = findings(spark, sf).where("category in ('secret_leak', 'source_code_leak')")
    return f.groupBy((F.col("k") % 30).alias("ref")).agg(n("leaks"), F.count_distinct("actor").alias("users"), F.max(rank(F.col("severity"))).alias("worst"), joined("tool").alias("tools"))


@query("discovery_upsert", """SELECT actor, tool, count(*) AS events, count(*) FILTER (category IN ('secret_leak', 'pii_leak')) AS sensitive, max(risk) AS max_risk, min(ts) AS first_seen, max(ts) AS last_seen,
CASE WHEN bool_or(surface = 'error') THEN 'capture' ELSE 'log' END AS source, arg_max(k % 5, (ts, id)) AS team FROM f GROUP BY actor, tool""", True)
def discovery(spark, sf) -> DataFrame:
    """One row per person and tool; a captured sighting beats a logged one, the newest team wins."""
    return findings(spark, sf).groupBy("actor", "tool").agg(
        n("events"), F.count_if(F.col("category").isin("secret_leak", "pii_leak")).alias("sensitive"), F.max("risk").alias("max_risk"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"),
        F.when(F.bool_or(F.col("surface") == "error"), "capture").otherwise("log").alias("source"), F.max_by(F.col("k") % 5, F.struct("ts", "id")).alias("team"))


#: Invented catalog rows.
CATALOG = (("example.net", "net assistant"), ("example.com", "com assistant"), ("example", "assistant"), ("blog", "writer"))
TOOL_SQL = "CASE WHEN regexp_matches(host, '(^|[^a-z0-9])example[.]net($|[^a-z0-9])') THEN 'net assistant' WHEN regexp_matches(host, '(^|[^a-z0-9])example[.]com($|[^a-z0-9])') THEN 'com assistant' WHEN regexp_matches(host, '(^|[^a-z0-9])example($|[^a-z0-9])') THEN 'assistant' WHEN regexp_matches(host, '(^|[^a-z0-9])blog($|[^a-z0-9])') THEN 'writer' END"
HOSTS_SQL = "WITH h AS (SELECT lower(regexp_extract(url, '://([^/?#]*)', 1)) AS host, count(*) AS n FROM pages GROUP BY 1)"


def destinations(spark, sf) -> DataFrame:
    hosts = read(spark, sf, "pages").groupBy(host_of(F.col("url")).alias("host")).agg(n())
    return longest_match(hosts, "host", spark.createDataFrame(list(CATALOG), "key string, tool string"))


@query("destination_tools", f"{HOSTS_SQL} SELECT host, n, {TOOL_SQL} AS tool FROM h")
def destination_tools(spark, sf) -> DataFrame:
    """The longest catalog key between boundaries of each host."""
    return destinations(spark, sf)


@query("log_ingest_summary", f"{HOSTS_SQL} SELECT CAST(sum(n) AS BIGINT) AS rows, CAST(sum(n) FILTER (t IS NOT NULL) AS BIGINT) AS matched, count(*) FILTER (t IS NULL) AS unrecognised, count(DISTINCT t) AS tools FROM (SELECT n, {TOOL_SQL} AS t FROM h)")
def log_ingest(spark, sf) -> DataFrame:
    known = F.col("tool").isNotNull()
    return destinations(spark, sf).agg(F.sum("n").alias("rows"), F.sum(F.when(known, F.col("n"))).alias("matched"), F.count_if(~known).alias("unrecognised"), F.count_distinct("tool").alias("tools"))


@query("extension_inventory", "SELECT tool AS extension, count(DISTINCT surface) AS browsers, count(DISTINCT actor) AS people, string_agg(DISTINCT CAST(k % 3 AS VARCHAR), ',' ORDER BY CAST(k % 3 AS VARCHAR)) AS versions FROM f GROUP BY 1", True)
def extensions(spark, sf) -> DataFrame:
    """People are counted over the few rows left after grouping by person."""
    per = findings(spark, sf).groupBy("tool", "actor").agg(F.collect_set("surface").alias("s"), F.collect_set((F.col("k") % 3).cast("string")).alias("v"))
    flat = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c))))
    return per.groupBy(F.col("tool").alias("extension")).agg(F.size(flat("s")).cast("long").alias("browsers"), n("people"), F.array_join(flat("v"), ",").alias("versions"))


@query("assets_by_name", "SELECT surface AS kind, tool AS name, count(DISTINCT actor) AS devices, string_agg(DISTINCT category, ',' ORDER BY category) AS sources, max(ts) AS last_seen FROM f GROUP BY 1, 2", True)
def assets(spark, sf) -> DataFrame:
    return findings(spark, sf).groupBy(F.col("surface").alias("kind"), F.col("tool").alias("name")).agg(F.count_distinct("actor").alias("devices"), joined("category").alias("sources"), F.max("ts").alias("last_seen"))


@query("fleet_people", f"""SELECT actor, count(*) AS sensors, min(last) AS oldest FROM (SELECT actor, surface, max(ts) AS last FROM f GROUP BY ALL) GROUP BY actor
HAVING min(last) < TIMESTAMP '{NOW}' - INTERVAL 72 HOUR ORDER BY oldest, actor LIMIT 25 OFFSET 5""", True)
def fleet_people(spark, sf) -> DataFrame:
    """A page of the people whose oldest sensor is dark."""
    per = findings(spark, sf).groupBy("actor", "surface").agg(F.max("ts").alias("last")).groupBy("actor").agg(n("sensors"), F.min("last").alias("oldest"))
    return per.where(F.col("oldest") < F.lit(NOW).cast("timestamp") - F.expr("INTERVAL 72 HOURS")).orderBy("oldest", "actor").offset(5).limit(25)


@query("failed_open_devices", """, r AS (SELECT actor, k % 4 AS reason, count(*) AS n, min(ts) AS a, max(ts) AS b FROM f WHERE surface = 'error' GROUP BY ALL)
SELECT actor, CAST(sum(n) AS BIGINT) AS fails, string_agg(reason || ':' || n, ',' ORDER BY reason) AS reasons, min(a) AS first_fail, max(b) AS last_fail FROM r GROUP BY actor""", True)
def failed_open(spark, sf) -> DataFrame:
    """Counts by reason, merged into one text per device."""
    r = findings(spark, sf).where("surface = 'error'").groupBy("actor", (F.col("k") % 4).alias("reason")).agg(n(), F.min("ts").alias("a"), F.max("ts").alias("b"))
    shown = F.transform(F.array_sort(F.collect_list(F.struct("reason", "n"))), lambda x: F.concat_ws(":", x["reason"], x["n"]))
    return r.groupBy("actor").agg(F.sum("n").alias("fails"), F.array_join(shown, ",").alias("reasons"), F.min("a").alias("first_fail"), F.max("b").alias("last_fail"))


@query("outbox_snapshot", "SELECT surface AS sink, status, count(*) AS n, min(ts) AS oldest FROM f GROUP BY 1, 2", True)
def outbox(spark, sf) -> DataFrame:
    return findings(spark, sf).groupBy(F.col("surface").alias("sink"), "status").agg(n(), F.min("ts").alias("oldest"))


@query("daily_quota", "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, CAST(sum(risk) AS BIGINT) AS used, sum(risk) > 2500 AS over FROM f GROUP BY 1", True)
def quota(spark, sf) -> DataFrame:
    return findings(spark, sf).groupBy(F.to_date("ts").cast("string").alias("day")).agg(F.sum("risk").alias("used"), (F.sum("risk") > 2500).alias("over"))


@query("category_coverage", ", a AS (SELECT actor, list(DISTINCT category) AS c FROM f WHERE risk >= 60 GROUP BY 1) SELECT count(*) AS actors, count(*) FILTER (list_has_any(c, ['secret_leak', 'prompt_injection'])) AS hit FROM a", True)
def category_coverage(spark, sf) -> DataFrame:
    """How many actors have any of the categories that were expected."""
    a = findings(spark, sf).where("risk >= 60").groupBy("actor").agg(F.collect_set("category").alias("c"))
    return a.agg(n("actors"), F.count_if(F.arrays_overlap("c", F.array(F.lit("secret_leak"), F.lit("prompt_injection")))).alias("hit"))


ASSIGNED = r"""(?i)(password|passwd|secret|token|api_?key)["']?[ ]*[:=][ ]*["']?([A-Za-z0-9+/_.=-]{8,})"""


@query("secret_sightings", "SELECT md5(v) AS fingerprint, count(*) AS sightings, count(DISTINCT doc_id) AS docs, count(DISTINCT source) AS sources FROM (SELECT doc_id, source, unnest(regexp_extract_all(text, '" + ASSIGNED.replace("'", "''") + "', 2)) AS v FROM documents) GROUP BY 1")
def sightings(spark, sf) -> DataFrame:
    """Where else a secret was seen, by its fingerprint; values never leave the scan."""
    values = read(spark, sf, "documents").select("doc_id", "source", F.explode(F.regexp_extract_all("text", F.lit(ASSIGNED), F.lit(2))).alias("v"))
    return values.groupBy(F.md5(F.col("v").cast("binary")).alias("fingerprint")).agg(n("sightings"), F.count_distinct("doc_id").alias("docs"), F.count_distinct("source").alias("sources"))


@query("latest_per_key", "SELECT actor, tool, arg_max(id, (ts, id)) AS id, arg_max(severity, (ts, id)) AS severity FROM f GROUP BY actor, tool", True)
def latest(spark, sf) -> DataFrame:
    """The newest row of a key as an aggregate, so it is partial before the shuffle; no window sorts the group."""
    at = F.struct("ts", "id")
    return findings(spark, sf).groupBy("actor", "tool").agg(F.max_by("id", at).alias("id"), F.max_by("severity", at).alias("severity"))


@query("quiet_containment", """SELECT * FROM (SELECT actor, max(ts) FILTER (surface = 'error') AS started, max(ts) = max(ts) FILTER (surface = 'error') AND bool_or(CAST((isodow(ts) - 1) * 24 + hour(ts) AS INTEGER) IN (47, 48, 49)) AS quiet FROM f GROUP BY actor) WHERE started IS NOT NULL""", True)
def quiet(spark, sf) -> DataFrame:
    """Contained actors that did nothing since, at an hour of the week (that of NOW, or one beside it) when they usually do."""
    started = F.max(F.when(F.col("surface") == "error", F.col("ts")))
    by = findings(spark, sf).groupBy("actor").agg(started.alias("started"), F.max("ts").alias("last"), F.bool_or(slot_of(F.col("ts")).isin(47, 48, 49)).alias("usual"))
    return by.where("started is not null").select("actor", "started", F.expr("last = started and usual").alias("quiet"))


@query("unregistered_actors", """SELECT DISTINCT actor FROM f WHERE actor NOT IN (SELECT 'u' || c_custkey FROM customer WHERE c_custkey % 7 = 0) AND substr(actor, 2) NOT IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer WHERE c_custkey % 11 = 0)""", True)
def unregistered(spark, sf) -> DataFrame:
    """Actors that no register names, in either spelling."""
    keys = read(spark, sf, "customer").select("c_custkey")
    long = keys.where("c_custkey % 7 = 0").select(F.concat(F.lit("u"), "c_custkey").alias("actor"))
    short = keys.where("c_custkey % 11 = 0").select(F.concat(F.lit("u"), "c_custkey").alias("actor"))
    return findings(spark, sf).select("actor").distinct().join(long, "actor", "left_anti").join(short, "actor", "left_anti")


@query("peer_findings", "SELECT id, least(3, row_number() OVER w - 1) AS peers, lag(id) OVER w AS latest_peer FROM f WINDOW w AS (PARTITION BY actor ORDER BY ts, id)", True)
def peers(spark, sf) -> DataFrame:
    """Up to three findings of the same actor before each, and the last of them. A day of an actor is ordered by itself; of the days
    before only their number of findings and the last one's id are needed."""
    f = findings(spark, sf).withColumn("day", F.to_date("ts"))
    w = Window.partitionBy("actor").orderBy("day")
    days = f.groupBy("actor", "day").agg(F.count("*").alias("n"), F.max_by("id", F.struct("ts", "id")).alias("last"))
    days = days.select("actor", "day", F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.lag("last").over(w).alias("last"))
    own = Window.partitionBy("actor", "day").orderBy("ts", "id")
    told = f.select("id", "actor", "day", F.row_number().over(own).alias("nth"), F.lag("id").over(own).alias("prev")).join(days, ["actor", "day"])
    return told.select("id", F.least(F.lit(3), F.col("before") + F.col("nth") - 1).alias("peers"), F.coalesce("prev", "last").alias("latest_peer"))


@query("top_findings_nulls_last", "SELECT id, CASE WHEN k % 3 = 0 THEN NULL ELSE risk END AS r FROM f ORDER BY r DESC NULLS LAST, id LIMIT 40", True)
def nulls_last(spark, sf) -> DataFrame:
    return findings(spark, sf).select("id", F.when(F.col("k") % 3 != 0, F.col("risk")).alias("r")).orderBy(F.desc_nulls_last("r"), "id").limit(40)


@query("actor_sets", """, a AS (SELECT DISTINCT actor FROM f WHERE surface = 'error'), b AS (SELECT DISTINCT actor FROM f WHERE surface = 'purchase')
SELECT (SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)) AS both_n, (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) AS only_error, (SELECT count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)) AS any_n""", True)
def actor_sets(spark, sf) -> DataFrame:
    """Intersection, difference and union of two sets of actors in one grouping."""
    by = findings(spark, sf).groupBy("actor").agg(F.bool_or(F.col("surface") == "error").alias("a"), F.bool_or(F.col("surface") == "purchase").alias("b"))
    return by.agg(F.count_if(F.expr("a and b")).alias("both_n"), F.count_if(F.expr("a and not b")).alias("only_error"), F.count_if(F.expr("a or b")).alias("any_n"))


@query("precision_table", """, o AS (SELECT 'overall' AS chk, * EXCLUDE (category) FROM f UNION ALL SELECT category, * EXCLUDE (category) FROM f)
SELECT chk, count(*) FILTER (status <> 'open') AS judged, count(*) FILTER (status = 'triaged') AS actionable FROM o GROUP BY 1""", True)
def precision_table(spark, sf) -> DataFrame:
    """The overall row comes from the few sums of the checks, not from a second scan."""
    by = findings(spark, sf).groupBy(F.col("category").alias("chk")).agg(F.count_if(F.col("status") != "open").alias("judged"), F.count_if(F.col("status") == "triaged").alias("actionable"))
    both = by.select(F.explode(F.array(F.col("chk"), F.lit("overall"))).alias("chk"), "judged", "actionable")
    return both.groupBy("chk").agg(F.sum("judged").alias("judged"), F.sum("actionable").alias("actionable"))
