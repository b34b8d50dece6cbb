"""Joins of findings with policies, taints, commits, documents and catalogs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillguard.functions.columns import glob_match, host_of, suffixes
from quillguard.operators.temporal import asof_taint, chain_windows
from quillguard.plans.base import findings, query, read

CUT = "TIMESTAMP '2024-01-24 00:00:00'"


@query("exposure_register", "SELECT o_orderkey AS exposure, o_orderstatus AS state, c_mktsegment AS owner, c_acctbal < 0 AS flagged FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def exposures(spark, sf) -> DataFrame:
    """Left join; which side is sent around is left to its measured size."""
    c = read(spark, sf, "customer").select("c_custkey", "c_mktsegment", (F.col("c_acctbal") < 0).alias("flagged"))
    return read(spark, sf, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"), "left").select(F.col("o_orderkey").alias("exposure"), F.col("o_orderstatus").alias("state"), F.col("c_mktsegment").alias("owner"), "flagged")


@query("agents_now_and_before", f"""SELECT coalesce(a.tool, b.tool) AS tool, coalesce(a.n, 0) AS now_n, coalesce(b.n, 0) AS before_n FROM (SELECT tool, count(*) AS n FROM f WHERE ts >= {CUT} AND severity = 'critical' GROUP BY 1) a
FULL JOIN (SELECT tool, count(*) AS n FROM f WHERE ts < {CUT} AND severity = 'critical' GROUP BY 1) b ON a.tool = b.tool""", True)
def now_and_before(spark, sf) -> DataFrame:
    f, cut = findings(spark, sf).where("severity = 'critical'"), F.lit("2024-01-24").cast("timestamp")
    a = f.where(F.col("ts") >= cut).groupBy("tool").agg(F.count("*").alias("now_n"))
    b = f.where(F.col("ts") < cut).groupBy("tool").agg(F.count("*").alias("before_n"))
    return a.join(b, "tool", "full_outer").select("tool", F.coalesce("now_n", F.lit(0)).alias("now_n"), F.coalesce("before_n", F.lit(0)).alias("before_n"))


@query("tenants_with_findings", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def with_findings(spark, sf) -> DataFrame:
    return read(spark, sf, "customer").select("c_custkey").join(read(spark, sf, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_semi")


@query("coverage_anti_join", "SELECT c_custkey, c_nationkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_orderstatus = 'P')")
def uncovered(spark, sf) -> DataFrame:
    return read(spark, sf, "customer").select("c_custkey", "c_nationkey").join(read(spark, sf, "orders").where("o_orderstatus = 'P'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti")


@query("group_members", "SELECT n_name AS grp, r_name AS org, count(*) AS members FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def groups(spark, sf) -> DataFrame:
    """Members are counted by key before their groups' names are joined to the few counts."""
    counts = read(spark, sf, "customer").groupBy("c_nationkey").agg(F.count("*").alias("members"))
    n = read(spark, sf, "nation").join(read(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return counts.join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("grp"), F.col("r_name").alias("org")).agg(F.sum("members").alias("members"))


@query("timeline_union", """SELECT actor, ts, 'finding' AS kind, CAST(id AS VARCHAR) AS ref FROM f WHERE severity = 'critical'
UNION ALL SELECT actor, ts + INTERVAL 30 MINUTE, 'taint_end', CAST(id AS VARCHAR) FROM f WHERE surface = 'error' AND severity IN ('high', 'critical')
UNION ALL SELECT actor, max(ts), 'last_seen', 'x' FROM f GROUP BY actor""", True)
def timeline(spark, sf) -> DataFrame:
    f = findings(spark, sf)
    part = lambda df, ts, kind, ref: df.select("actor", ts.alias("ts"), F.lit(kind).alias("kind"), ref.cast("string").alias("ref"))
    a = part(f.where("severity = 'critical'"), F.col("ts"), "finding", F.col("id"))
    b = part(f.where("surface = 'error' and severity in ('high', 'critical')"), F.col("ts") + F.expr("INTERVAL 30 MINUTES"), "taint_end", F.col("id"))
    return a.unionByName(b).unionByName(part(f.groupBy("actor").agg(F.max("ts").alias("t")), F.col("t"), "last_seen", F.lit("x")))


@query("taint_asof", """SELECT id, actor, ts, (SELECT max((t.ts, t.id))[2] FROM f t WHERE t.surface = 'error' AND t.actor = a.actor AND t.ts <= a.ts AND t.ts + INTERVAL 30 MINUTE > a.ts) AS taint FROM f a WHERE surface = 'purchase'""", True)
def taint(spark, sf) -> DataFrame:
    """Each action with the actor's latest taint that hasn't run out."""
    f = findings(spark, sf)
    return asof_taint(f.where("surface = 'purchase'").select("id", "actor", "ts"), f.where("surface = 'error'").select("id", "actor", "ts"))


@query("interval_attest", """SELECT a.id AS commit_id, count(b.id) AS findings, count(*) FILTER (b.severity = 'critical') AS blocked FROM f a LEFT JOIN f b ON a.actor = b.actor AND b.surface = 'error' AND b.ts BETWEEN a.ts - INTERVAL 60 MINUTE AND a.ts + INTERVAL 60 MINUTE WHERE a.surface = 'signup' GROUP BY 1""", True)
def attest(spark, sf) -> DataFrame:
    """Commits with what their agent's findings say of the hour around them.

    Cells of two hours make the interval an equal key; a commit meets at most two cells, so an actor's history isn't
    multiplied out.
    """
    f = findings(spark, sf)
    cell = lambda t: F.floor(F.unix_timestamp(t) / 7200)
    a = f.where("surface = 'signup'").select(F.col("id").alias("commit_id"), "actor", F.col("ts").alias("at"))
    lo, hi = F.col("at") - F.expr("INTERVAL 60 MINUTES"), F.col("at") + F.expr("INTERVAL 60 MINUTES")
    a = a.withColumn("cell", F.explode(F.sequence(cell(lo), cell(hi))))
    b = f.where("surface = 'error'").select("actor", "ts", "severity", cell(F.col("ts")).alias("cell"))
    j = a.join(b, ["actor", "cell"], "left").withColumn("hit", F.col("ts").between(lo, hi))
    return j.groupBy("commit_id").agg(F.count_if("hit").alias("findings"), F.count_if(F.col("hit") & (F.col("severity") == "critical")).alias("blocked"))


@query("chain_window_30m", """, w AS (SELECT a.id, a.actor, list_sort(list_distinct(list(b.category))) AS stages, bool_or(b.risk >= 60) AS anchored FROM f a JOIN f b ON a.actor = b.actor AND epoch_us(b.ts) // 1000000 BETWEEN epoch_us(a.ts) // 1000000 - 1800 AND epoch_us(a.ts) // 1000000 WHERE b.risk >= 15 AND a.risk >= 15 GROUP BY ALL)
SELECT id, actor, array_to_string(stages, ',') AS stages, CASE WHEN list_contains(stages, 'secret_leak') THEN 95 WHEN list_contains(stages, 'source_code_leak') THEN 90 WHEN len(stages) >= 3 THEN 92 ELSE 82 END AS risk FROM w WHERE len(stages) >= 2 AND anchored""", True)
def chains(spark, sf) -> DataFrame:
    return chain_windows(findings(spark, sf).where("risk >= 15"), exfiltration="secret_leak", execution="source_code_leak")


@query("origin_containment", """WITH w AS (SELECT 'd' AS kind, item_id AS id, regexp_extract_all(lower(text), '[^\\x20\\x09-\\x0D]+') AS w FROM benchmark UNION ALL SELECT 'p', doc_id, regexp_extract_all(lower(text), '[^\\x20\\x09-\\x0D]+') FROM documents),
s AS (SELECT DISTINCT kind, id, unnest(list_transform(range(1, len(w) - 3), lambda i: md5(array_to_string(w[i:i + 4], ' ')))) AS h FROM w WHERE len(w) >= 5),
k AS (SELECT * FROM s WHERE substr(h, 1, 1) IN ('0', '4', '8', 'c')), n AS (SELECT kind, id, count(*) AS n FROM k GROUP BY ALL),
m AS (SELECT d.id AS doc, p.id AS item, count(*) AS c FROM k d JOIN k p ON d.h = p.h AND d.kind = 'd' AND p.kind = 'p' GROUP BY ALL),
r AS (SELECT doc AS item_id, item AS doc_id, round(c / n.n, 2) AS containment, row_number() OVER (PARTITION BY doc ORDER BY c DESC, item) AS r FROM m JOIN n ON n.kind = 'd' AND n.id = m.doc WHERE n.n >= 4 AND c > 0.5 * n.n)
SELECT item_id, doc_id, containment FROM r WHERE r = 1""")
def origin(spark, sf) -> DataFrame:
    """Passages (the prompts) with the document, of any length, that holds most of their sampled shingles, more than half."""
    from quillguard.operators.similarity import best_origin

    docs = read(spark, sf, "documents").select("doc_id", "text")
    return best_origin(read(spark, sf, "benchmark").select("item_id", "text"), docs, "item_id", "doc_id")


SANCTIONED = ("example.com", "blog.tionble.example.org", "example.net")


@query("host_suffix_sanction", """WITH h AS (SELECT page_id, lower(regexp_extract(url, '://([^/?#]*)', 1)) AS host FROM pages)
SELECT host, count(*) AS n, max(CASE WHEN host = 'blog.tionble.example.org' OR host LIKE '%.blog.tionble.example.org' THEN 'blog.tionble.example.org' WHEN host = 'example.com' OR host LIKE '%.example.com' THEN 'example.com' WHEN host = 'example.net' OR host LIKE '%.example.net' THEN 'example.net' END) AS domain FROM h GROUP BY host""")
def sanction(spark, sf) -> DataFrame:
    """Longest sanctioned domain of each host: hosts become all their suffixes, so an equal key decides."""
    hosts = read(spark, sf, "pages").groupBy(host_of(F.col("url")).alias("host")).agg(F.count("*").alias("n"))
    rules = spark.createDataFrame([(d,) for d in SANCTIONED], "domain string")
    hit = hosts.select("host", F.explode(suffixes(F.col("host"))).alias("domain")).join(F.broadcast(rules), "domain").groupBy("host").agg(F.max_by("domain", F.length("domain")).alias("domain"))
    return hosts.join(hit, "host", "left")


@query("link_host_harvest", """WITH l AS (SELECT page_id, lower(regexp_extract(url, '://([^/?#]*)', 1)) AS own, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS link FROM pages),
h AS (SELECT page_id, CASE WHEN regexp_matches(link, '^https?://') THEN lower(regexp_extract(link, '://([^/?#]*)', 1)) ELSE own END AS host FROM l) SELECT host, count(*) AS links, count(DISTINCT page_id) AS pages FROM h WHERE host NOT LIKE '%.example.com' GROUP BY host""")
def harvest(spark, sf) -> DataFrame:
    """Hosts that pages link to, their own where a link names none. Counts are by page first, so one host's pages spread."""
    links = read(spark, sf, "pages").select("page_id", host_of(F.col("url")).alias("own"), F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("link"))
    hosts = links.select("page_id", F.when(F.col("link").rlike("^https?://"), host_of(F.col("link"))).otherwise(F.col("own")).alias("host")).where("host not like '%.example.com'")
    return hosts.groupBy("host", "page_id").agg(F.count("*").alias("n")).groupBy("host").agg(F.sum("n").alias("links"), F.count("*").alias("pages"))


@query("role_turn_pairs", """SELECT a.conv_id, a.turn, length(a.text) AS asked, length(b.text) AS answered FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 AND b.role = 'assistant' WHERE a.role = 'user'""")
def turns(spark, sf) -> DataFrame:
    """Prompt and reply side by side from one window over the conversation, not a self-join."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = read(spark, sf, "conversations").select("conv_id", "turn", "role", F.length("text").alias("asked"))
    nxt = c.withColumns({"answered": F.lead("asked").over(w), "r2": F.lead("role").over(w), "t2": F.lead("turn").over(w)})
    return nxt.where("role = 'user' and r2 = 'assistant' and t2 = turn + 1").select("conv_id", "turn", "asked", "answered")


#: scope, pattern, check, verdict: invented policy rows.
OVERRIDES = (("user", "u8", "pii_leak", "off"), ("user", "u1*", "pii_leak", "on"), ("group", "u*", "pii_leak", "off"), ("user", "u[2-4]?", "secret_leak", "off"))


@query("policy_override_resolution", """WITH a AS (SELECT DISTINCT 'u' || user_id AS actor FROM events) SELECT actor, CASE WHEN actor = 'u8' THEN 'off' WHEN actor LIKE 'u1%' THEN 'on' ELSE 'off' END AS pii, CASE WHEN regexp_full_match(actor, 'u[2-4].') THEN 'off' ELSE 'on' END AS secrets FROM a""")
def overrides(spark, sf) -> DataFrame:
    """User rules beat group rules, then fewer wildcards, then the longer pattern; rules are ordered once, on the driver."""
    actors = findings(spark, sf).select("actor").distinct()
    rank = lambda r: (r[0] != "user", r[1].count("*"), -len(r[1]))

    def resolve(check: str):
        out = None
        for _, pattern, _, verdict in sorted((r for r in OVERRIDES if r[2] == check), key=rank):
            out = F.when(glob_match(F.col("actor"), pattern), verdict) if out is None else out.when(glob_match(F.col("actor"), pattern), verdict)
        return out.otherwise("on")

    return actors.select("actor", resolve("pii_leak").alias("pii"), resolve("secret_leak").alias("secrets"))


CONTROLS = (("c1", "secret_leak"), ("c1", "pii_leak"), ("c2", "pii_leak"), ("c3", None), ("c4", "prompt_injection"))


@query("compliance_coverage", """, o AS (SELECT surface, category, 2 * count(*) FILTER (status <> 'dismissed') >= count(*) AS is_on FROM f GROUP BY ALL), c(control, chk) AS (VALUES ('c1', 'secret_leak'), ('c1', 'pii_leak'), ('c2', 'pii_leak'), ('c3', NULL), ('c4', 'prompt_injection'))
SELECT s.surface, control, CASE WHEN count(chk) = 0 THEN 'not_mapped' WHEN bool_or(coalesce(is_on, false)) THEN 'covered' ELSE 'gap' END AS state FROM (SELECT DISTINCT surface FROM f) s CROSS JOIN c LEFT JOIN o ON o.surface = s.surface AND category = chk GROUP BY ALL""", True)
def compliance(spark, sf) -> DataFrame:
    """Controls by surface: covered if a mapped check works there, gap if none does, not_mapped without a check. A check works
    where half of what it finds isn't dismissed."""
    works = findings(spark, sf).groupBy("surface", F.col("category").alias("chk")).agg((2 * F.count_if(F.col("status") != "dismissed") >= F.count("*")).alias("is_on"))
    each = F.array(*(F.struct(F.lit(c).alias("control"), F.lit(k).cast("string").alias("chk")) for c, k in CONTROLS))
    rows = works.select("surface").distinct().select("surface", F.explode(each).alias("c")).select("surface", "c.control", "c.chk")
    by = rows.join(works, ["surface", "chk"], "left").groupBy("surface", "control").agg(F.count("chk").alias("mapped"), F.bool_or(F.coalesce("is_on", F.lit(False))).alias("is_on"))
    return by.select("surface", "control", F.when(F.col("mapped") == 0, "not_mapped").when(F.col("is_on"), "covered").otherwise("gap").alias("state"))

@query("snapshot_replace", """WITH s AS (SELECT user_id AS device, props AS name, value, row_number() OVER (PARTITION BY user_id, props ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE event_type IN ('view', 'click')),
last AS (SELECT user_id AS device, max(ts) AS t FROM events WHERE event_type = 'click' GROUP BY 1)
SELECT s.device, count(*) AS items, round(sum(value), 2) AS total FROM s JOIN last USING (device) WHERE r = 1 GROUP BY 1""")
def snapshot(spark, sf) -> DataFrame:
    """The last item of each name on devices that sent a snapshot."""
    e = read(spark, sf, "events")
    items = e.where("event_type in ('view', 'click')").groupBy(F.col("user_id").alias("device"), "props").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))
    listed = e.where("event_type = 'click'").select(F.col("user_id").alias("device"))
    return items.join(listed, "device", "left_semi").groupBy("device").agg(F.count("*").alias("items"), F.round(F.sum("value"), 2).alias("total"))


@query("heartbeat_upsert", """SELECT user_id AS actor, event_type AS plane, count(*) AS n, min(ts) AS first_seen, max(ts) AS last_seen, count(*) FILTER (value > 50) AS fails FROM events GROUP BY ALL""")
def heartbeat(spark, sf) -> DataFrame:
    """Two landed batches folded into one state per key, as an upsert would."""
    e = read(spark, sf, "events")
    cut = F.lit("2024-01-15").cast("timestamp")
    fold = lambda df: df.groupBy(F.col("user_id").alias("actor"), F.col("event_type").alias("plane")).agg(F.count("*").alias("n"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count_if(F.col("value") > 50).alias("fails"))
    both = fold(e.where(F.col("ts") < cut)).unionByName(fold(e.where(F.col("ts") >= cut)))
    return both.groupBy("actor", "plane").agg(F.sum("n").alias("n"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("fails").alias("fails"))


@query("retention_plan", f"SELECT surface, count(*) FILTER (ts < {CUT} - INTERVAL 14 DAY) AS purge, count(*) FILTER (ts >= {CUT} - INTERVAL 14 DAY) AS keep FROM f GROUP BY 1", True)
def retention(spark, sf) -> DataFrame:
    cut = F.lit("2024-01-10").cast("timestamp")
    return findings(spark, sf).groupBy("surface").agg(F.count_if(F.col("ts") < cut).alias("purge"), F.count_if(F.col("ts") >= cut).alias("keep"))


@query("review_update", "SELECT id, CASE WHEN k % 12 = 5 THEN 'dismissed' ELSE status END AS status, CASE WHEN k % 12 = 5 THEN 'bulk' END AS via, CASE WHEN k % 12 = 5 THEN 'duplicate' ELSE reason END AS reason FROM f", True)
def review(spark, sf) -> DataFrame:
    """A bulk review of open rows, as a projection over its keys."""
    hit = F.col("k") % 12 == 5
    return findings(spark, sf).select("id", F.when(hit, "dismissed").otherwise(F.col("status")).alias("status"), F.when(hit, "bulk").alias("via"), F.when(hit, "duplicate").otherwise(F.col("reason")).alias("reason"))
