"""Rollups over findings: stats, activity, inventory, precision, fleet, funnel, digests. Partial sums before every shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillguard.functions.columns import rank, slot_of, wilson
from quillguard.plans.base import NOW, findings, query, read

CUT = "TIMESTAMP '2024-01-24 00:00:00'"
RANK_SQL = "CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'suspicious' THEN 2 WHEN 'low' THEN 1 ELSE 0 END"
n = lambda name="n": F.count("*").alias(name)
n_if = lambda cond, name: F.count_if(cond).alias(name)


@query("severity_by_surface", "SELECT surface, severity, count(*) AS n, max(risk) AS max_risk FROM f GROUP BY ALL", True)
def severity_by_surface(spark, sf) -> DataFrame:
    return findings(spark, sf).groupBy("surface", "severity").agg(n(), F.max("risk").alias("max_risk"))


@query("stats_flow_and_stock", f"""SELECT count(*) FILTER (ts >= {CUT}) AS total, count(*) FILTER (ts >= {CUT} - INTERVAL 7 DAY AND ts < {CUT}) AS previous,
count(*) FILTER (status = 'open') AS open_all, count(*) FILTER (status = 'open' AND {RANK_SQL} >= 2) AS needs_review, count(*) FILTER ({RANK_SQL} >= 3) AS high_risk,
count(*) FILTER (ts >= {CUT} AND category = 'prompt_injection') AS attacks FROM f""", True)
def stats(spark, sf) -> DataFrame:
    cut = F.lit("2024-01-24").cast("timestamp")
    ts, r = F.col("ts"), rank(F.col("severity"))
    return findings(spark, sf).agg(
        n_if(ts >= cut, "total"), n_if((ts >= cut - F.expr("INTERVAL 7 DAYS")) & (ts < cut), "previous"), n_if(F.col("status") == "open", "open_all"),
        n_if((F.col("status") == "open") & (r >= 2), "needs_review"), n_if(r >= 3, "high_risk"), n_if((ts >= cut) & (F.col("category") == "prompt_injection"), "attacks"))


@query("user_activity_topcats", """, c AS (SELECT actor, category, count(*) AS n, row_number() OVER (PARTITION BY actor ORDER BY count(*) DESC, category) AS r FROM f GROUP BY actor, category),
t AS (SELECT actor, string_agg(category || ':' || n, ',' ORDER BY r) AS top_categories FROM c WHERE r <= 4 GROUP BY actor)
SELECT actor, count(*) AS findings, count(*) FILTER (severity IN ('high', 'critical')) AS high, max(risk) AS max_risk, count(DISTINCT surface) AS surfaces, max(ts) AS last_seen, any_value(top_categories) AS top_categories
FROM f JOIN t USING (actor) GROUP BY actor""", True)
def user_activity(spark, sf) -> DataFrame:
    """Per actor, in one pass over (actor, category) sums: the category tops come from an array of them."""
    by = findings(spark, sf).groupBy("actor", "category").agg(n(), n_if(F.col("severity").isin("high", "critical"), "high"), F.max("risk").alias("max_risk"), F.collect_set("surface").alias("s"), F.max("ts").alias("last"))
    tops = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "category", "n"))), 1, 4)
    return by.groupBy("actor").agg(
        F.sum("n").alias("findings"), F.sum("high").alias("high"), F.max("max_risk").alias("max_risk"), F.size(F.array_distinct(F.flatten(F.collect_list("s")))).cast("long").alias("surfaces"), F.max("last").alias("last_seen"),
        F.array_join(F.transform(tops, lambda x: F.concat_ws(":", x["category"], x["n"])), ",").alias("top_categories"))


@query("policy_check_analytics", "SELECT category AS check_name, count(*) AS findings, count(*) FILTER (status = 'dismissed') AS dismissed, round(count(*) FILTER (status = 'dismissed') / count(*), 3) AS dismiss_rate FROM f GROUP BY 1", True)
def policy_checks(spark, sf) -> DataFrame:
    by = findings(spark, sf).groupBy(F.col("category").alias("check_name")).agg(n("findings"), n_if(F.col("status") == "dismissed", "dismissed"))
    return by.withColumn("dismiss_rate", F.round(F.col("dismissed") / F.col("findings"), 3))


@query("inventory_by_tool", """, u AS (SELECT tool, actor, count(*) AS e, count(*) FILTER (category IN ('secret_leak', 'pii_leak')) AS s, max(risk) AS m FROM f GROUP BY ALL)
SELECT tool, count(*) AS users, CAST(sum(e) AS BIGINT) AS events, CAST(sum(s) AS BIGINT) AS sensitive, count(*) FILTER (CAST(substr(actor, 2) AS INTEGER) % 3 = 0) AS personal_users,
CAST(least(100, max(m) + CASE WHEN CAST(substr(tool, 5) AS INTEGER) >= 6 THEN 25 ELSE 0 END + CASE WHEN sum(s) > 0 THEN 20 ELSE 0 END) AS INTEGER) AS risk FROM u GROUP BY tool""", True)
def inventory(spark, sf) -> DataFrame:
    """Users are distinct by the first grouping; the second only counts its rows."""
    per = findings(spark, sf).groupBy("tool", "actor").agg(n("e"), n_if(F.col("category").isin("secret_leak", "pii_leak"), "s"), F.max("risk").alias("m"))
    by = per.groupBy("tool").agg(n("users"), F.sum("e").alias("events"), F.sum("s").alias("sensitive"), n_if(F.substring("actor", 2, 9).cast("int") % 3 == 0, "personal_users"), F.max("m").alias("m"))
    risk = F.least(F.lit(100), F.col("m") + F.when(F.substring("tool", 5, 3).cast("int") >= 6, 25).otherwise(0) + F.when(F.col("sensitive") > 0, 20).otherwise(0)).cast("int")
    return by.withColumn("risk", risk).drop("m")


@query("coverage_report", """, a AS (SELECT actor, max(ts) FILTER (surface = 'signup') AS seen, count(*) FILTER (severity IN ('high', 'critical')) AS covered FROM f GROUP BY actor)
SELECT count(*) AS total, count(*) FILTER (covered > 0) AS covered, round(count(*) FILTER (covered > 0) / count(*), 4) AS rate FROM a WHERE seen IS NOT NULL""", True)
def coverage(spark, sf) -> DataFrame:
    per = findings(spark, sf).groupBy("actor").agg(F.max(F.when(F.col("surface") == "signup", F.col("ts"))).alias("seen"), n_if(F.col("severity").isin("high", "critical"), "c"))
    return per.where("seen is not null").agg(n("total"), n_if(F.col("c") > 0, "covered")).withColumn("rate", F.round(F.col("covered") / F.col("total"), 4))


@query("precision_readout", """, b AS (SELECT category, count(*) FILTER (status = 'triaged') AS actionable, count(*) FILTER (reason = 'expected') AS expected, count(*) FILTER (reason = 'false_positive') AS false_positive, count(*) FILTER (reason = 'duplicate') AS duplicate FROM f WHERE status <> 'open' GROUP BY 1),
r AS (SELECT *, actionable + expected + false_positive AS judged, CAST(actionable + expected AS DOUBLE) AS k FROM b),
w AS (SELECT *, k / judged AS p, 1 + 1.96 * 1.96 / judged AS d, (k / judged + 1.96 * 1.96 / (2.0 * judged)) / (1 + 1.96 * 1.96 / judged) AS c FROM r)
SELECT category, actionable, expected, false_positive, duplicate, judged, round(p, 3) AS precision,
round(greatest(0, c - 1.96 * sqrt(p * (1 - p) / judged + 1.96 * 1.96 / (4.0 * judged * judged)) / d), 3) AS low, round(least(1, c + 1.96 * sqrt(p * (1 - p) / judged + 1.96 * 1.96 / (4.0 * judged * judged)) / d), 3) AS high FROM w""", True)
def precision(spark, sf) -> DataFrame:
    by = findings(spark, sf).where("status <> 'open'").groupBy("category").agg(n_if(F.col("status") == "triaged", "actionable"), *(n_if(F.col("reason") == r, r) for r in ("expected", "false_positive", "duplicate")))
    by = by.withColumn("judged", F.expr("actionable + expected + false_positive"))
    low, high = wilson(F.expr("actionable + expected"), F.col("judged"))
    return by.withColumns({"precision": F.round(F.expr("cast(actionable + expected as double) / judged"), 3), "low": low, "high": high})


@query("weekly_precision_spine", """, s AS (SELECT CAST(unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-29', INTERVAL 7 DAY)) AS DATE) AS week),
w AS (SELECT CAST(date_trunc('week', ts) AS DATE) AS week, count(*) AS reviews, count(*) FILTER (status = 'triaged') AS actionable FROM f WHERE status <> 'open' GROUP BY 1)
SELECT CAST(s.week AS VARCHAR) AS week, coalesce(reviews, 0) AS reviews, coalesce(actionable, 0) AS actionable FROM s LEFT JOIN w ON s.week = w.week""", True)
def weekly(spark, sf) -> DataFrame:
    """Every Monday of the window, also those without a review."""
    spine = spark.range(1).select(F.explode(F.sequence(F.lit("2024-01-01").cast("date"), F.lit("2024-01-29").cast("date"), F.expr("INTERVAL 7 DAYS"))).alias("week"))
    by = findings(spark, sf).where("status <> 'open'").groupBy(F.date_trunc("week", "ts").cast("date").alias("week")).agg(n("reviews"), n_if(F.col("status") == "triaged", "actionable"))
    return spine.join(by, "week", "left").select(F.col("week").cast("string").alias("week"), F.coalesce("reviews", F.lit(0)).alias("reviews"), F.coalesce("actionable", F.lit(0)).alias("actionable"))


@query("false_positive_signatures", """SELECT tool, category, count(*) AS dismissed, count(DISTINCT actor) AS actors FROM f WHERE reason = 'false_positive' GROUP BY ALL HAVING count(*) >= 3 ORDER BY dismissed DESC, tool, category LIMIT 20""", True)
def fp_signatures(spark, sf) -> DataFrame:
    by = findings(spark, sf).where("reason = 'false_positive'").groupBy("tool", "category").agg(n("dismissed"), F.count_distinct("actor").alias("actors"))
    return by.where("dismissed >= 3").orderBy(F.desc("dismissed"), "tool", "category").limit(20)


@query("session_rollup", """, p AS (SELECT actor, count(DISTINCT tool) AS vendors, count(DISTINCT category) AS stages, max(CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'suspicious' THEN 2 WHEN 'low' THEN 1 ELSE 0 END) AS peak, min(ts) AS first_seen, max(ts) AS last_seen FROM f GROUP BY actor)
SELECT *, stages >= 3 AND peak >= 3 AS chain FROM p""", True)
def sessions(spark, sf) -> DataFrame:
    by = findings(spark, sf).groupBy("actor").agg(F.count_distinct("tool").alias("vendors"), F.count_distinct("category").alias("stages"), F.max(rank(F.col("severity"))).alias("peak"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    return by.withColumn("chain", F.expr("stages >= 3 and peak >= 3"))


@query("agent_graph_edges", """SELECT 'a' || CAST(substr(actor, 2) AS INTEGER) % 20 AS source, tool AS target, count(*) AS n, max(risk) AS worst, string_agg(DISTINCT category, ',' ORDER BY category) AS categories FROM f GROUP BY 1, 2""", True)
def graph_edges(spark, sf) -> DataFrame:
    by = findings(spark, sf).groupBy(F.concat(F.lit("a"), F.substring("actor", 2, 9).cast("int") % 20).alias("source"), F.col("tool").alias("target"))
    return by.agg(n(), F.max("risk").alias("worst"), F.array_join(F.array_sort(F.collect_set("category")), ",").alias("categories"))


@query("fleet_health_buckets", f"""SELECT surface AS plane, count(*) AS sensors, count(*) FILTER (age <= 24) AS fresh, count(*) FILTER (age > 24 AND age <= 72) AS stale, count(*) FILTER (age > 72) AS dark FROM
(SELECT surface, actor, date_diff('second', max(ts), TIMESTAMP '{NOW}') / 3600.0 AS age FROM f GROUP BY ALL) GROUP BY 1""", True)
def fleet(spark, sf) -> DataFrame:
    last = findings(spark, sf).groupBy(F.col("surface").alias("plane"), "actor").agg(F.max("ts").alias("last"))
    age = (F.unix_timestamp(F.lit(NOW).cast("timestamp")) - F.unix_timestamp("last")) / 3600
    return last.groupBy("plane").agg(n("sensors"), n_if(age <= 24, "fresh"), n_if((age > 24) & (age <= 72), "stale"), n_if(age > 72, "dark"))


@query("agent_scores", """, d AS (SELECT tool, count(*) FILTER (severity = 'critical') AS crit, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (status = 'open') AS open_n FROM f GROUP BY tool)
SELECT tool, CAST(100 - least(50, crit * 10) - least(30, high * 5) - least(20, open_n) AS BIGINT) AS score FROM d""", True)
def agent_scores(spark, sf) -> DataFrame:
    """100 less capped deductions."""
    by = findings(spark, sf).groupBy("tool").agg(n_if(F.col("severity") == "critical", "c"), n_if(F.col("severity") == "high", "h"), n_if(F.col("status") == "open", "o"))
    return by.select("tool", F.expr("cast(100 - least(50, c * 10) - least(30, h * 5) - least(20, o) as bigint)").alias("score"))


@query("unattended_actors", """SELECT actor, count(DISTINCT hour(ts)) AS hours, count(DISTINCT CAST(ts AS DATE)) AS days FROM f GROUP BY actor HAVING count(DISTINCT hour(ts)) >= 20 AND count(DISTINCT CAST(ts AS DATE)) >= 5""", True)
def unattended(spark, sf) -> DataFrame:
    by = findings(spark, sf).groupBy("actor").agg(F.count_distinct(F.hour("ts")).alias("hours"), F.count_distinct(F.to_date("ts")).alias("days"))
    return by.where("hours >= 20 and days >= 5")


@query("hour_slot_cadence", "SELECT CAST((isodow(ts) - 1) * 24 + hour(ts) AS INTEGER) AS slot, count(*) AS n, count(DISTINCT actor) AS actors FROM f GROUP BY 1", True)
def slots(spark, sf) -> DataFrame:
    return findings(spark, sf).groupBy(slot_of(F.col("ts")).alias("slot")).agg(n(), F.count_distinct("actor").alias("actors"))


@query("expected_hours", f"""SELECT a.actor, a.slot, EXISTS (SELECT 1 FROM s b WHERE b.actor = a.actor AND (b.slot = a.slot OR b.slot = (a.slot + 1) % 168 OR b.slot = (a.slot + 167) % 168)) AS expected FROM
(SELECT actor, CAST((isodow(ts) - 1) * 24 + hour(ts) AS INTEGER) AS slot FROM f WHERE ts >= {CUT} GROUP BY ALL) a""".replace("SELECT a.actor", ", s AS (SELECT actor, CAST((isodow(ts) - 1) * 24 + hour(ts) AS INTEGER) AS slot FROM f WHERE ts < " + CUT + " GROUP BY ALL) SELECT a.actor", 1), True)
def expected_hours(spark, sf) -> DataFrame:
    """Whether an actor's hour of the week, or one beside it, was seen in the weeks before."""
    f = findings(spark, sf).withColumn("slot", slot_of(F.col("ts")))
    cut = F.lit("2024-01-24").cast("timestamp")
    before = f.where(F.col("ts") < cut).select("actor", F.explode(F.array(F.col("slot"), (F.col("slot") + 1) % 168, (F.col("slot") + 167) % 168)).alias("slot")).distinct().withColumn("expected", F.lit(True))
    return f.where(F.col("ts") >= cut).select("actor", "slot").distinct().join(before, ["actor", "slot"], "left").withColumn("expected", F.coalesce("expected", F.lit(False)))


@query("per_minute_metering", "SELECT date_trunc('minute', ts) AS minute, surface AS kind, count(*) AS n FROM f GROUP BY ALL", True)
def metering(spark, sf) -> DataFrame:
    return findings(spark, sf).groupBy(F.date_trunc("minute", "ts").alias("minute"), F.col("surface").alias("kind")).agg(n())


@query("usage_by_day", "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, surface AS kind, count(*) AS n FROM f GROUP BY ALL", True)
def usage_by_day(spark, sf) -> DataFrame:
    return findings(spark, sf).groupBy(F.to_date("ts").cast("string").alias("day"), F.col("surface").alias("kind")).agg(n())


@query("rate_limit_overage", """, m AS (SELECT id, actor, row_number() OVER (PARTITION BY actor, date_trunc('hour', ts) ORDER BY ts, id) AS r FROM f)
SELECT actor, count(*) AS over_limit FROM m WHERE r > 2 GROUP BY actor""", True)
def rate_limit(spark, sf) -> DataFrame:
    """Rows beyond the limit of their window, by counts alone: no ordering is needed to know how many they are."""
    by = findings(spark, sf).groupBy("actor", F.date_trunc("hour", "ts").alias("h")).agg(n())
    return by.where("n > 2").groupBy("actor").agg(F.sum(F.col("n") - 2).alias("over_limit"))


@query("developer_meter", """, p AS (SELECT strftime(ts, '%Y-%m') AS month, actor, bool_or(surface IN ('view', 'click')) AS browser, bool_or(surface = 'error') AS agent FROM f GROUP BY ALL)
SELECT month, count(*) AS developers, count(*) FILTER (browser AND NOT agent) AS browser_only FROM p GROUP BY month""", True)
def developers(spark, sf) -> DataFrame:
    per = findings(spark, sf).groupBy(F.date_format("ts", "yyyy-MM").alias("month"), "actor").agg(F.bool_or(F.col("surface").isin("view", "click")).alias("b"), F.bool_or(F.col("surface") == "error").alias("a"))
    return per.groupBy("month").agg(n("developers"), n_if(F.expr("b and not a"), "browser_only"))


@query("funnel_conversion", f"""SELECT count(*) AS signed_up, count(*) FILTER (o.o_custkey IS NOT NULL) AS activated, round(100.0 * count(*) FILTER (o.o_custkey IS NOT NULL) / count(*), 1) AS activated_pct,
count(*) FILTER (last >= TIMESTAMP '2000-01-01') AS retained FROM customer c LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS last FROM orders GROUP BY 1) o ON c.c_custkey = o.o_custkey""")
def funnel(spark, sf) -> DataFrame:
    """Stages are independent sets of customers; one grouped table is joined once."""
    o = read(spark, sf, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("last"))
    j = read(spark, sf, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    by = j.agg(n("signed_up"), n_if(F.col("o_custkey").isNotNull(), "activated"), n_if(F.col("last") >= F.lit("2000-01-01").cast("timestamp"), "retained"))
    return by.withColumn("activated_pct", F.round(F.lit(100.0) * F.col("activated") / F.col("signed_up"), 1))


@query("days_to_first_finding", """, d AS (SELECT actor, date_diff('second', TIMESTAMP '2024-01-01', min(ts)) AS s FROM f GROUP BY actor), r AS (SELECT s, row_number() OVER (ORDER BY s) AS r, count(*) OVER () AS c FROM d)
SELECT round(s / 86400.0, 1) AS median_days FROM r WHERE r = c // 2 + 1""", True)
def median_days(spark, sf) -> DataFrame:
    """The upper middle element, exact: actors are counted by second, and running counts find the middle."""
    s = findings(spark, sf).groupBy("actor").agg((F.unix_timestamp(F.min("ts")) - F.unix_timestamp(F.lit("2024-01-01").cast("timestamp"))).alias("s"))
    hist = s.groupBy("s").agg(n())
    middle = hist.agg(F.expr("cast(sum(n) div 2 + 1 as bigint)").alias("at"))
    run = hist.withColumn("upto", F.sum("n").over(Window.orderBy("s")))  # one row a distinct second
    return run.join(F.broadcast(middle), (F.col("upto") >= F.col("at")) & (F.col("upto") - F.col("n") < F.col("at"))).select(F.round(F.col("s") / 86400.0, 1).alias("median_days"))


@query("executive_top_tools", """SELECT tool, count(*) AS n, count(*) FILTER (severity IN ('high', 'critical')) AS prevented FROM f GROUP BY tool ORDER BY n DESC, tool LIMIT 15""", True)
def top_tools(spark, sf) -> DataFrame:
    return findings(spark, sf).groupBy("tool").agg(n(), n_if(F.col("severity").isin("high", "critical"), "prevented")).orderBy(F.desc("n"), "tool").limit(15)


@query("closeout_by_plane", """SELECT surface AS plane, count(*) AS n, count(*) FILTER (status = 'triaged') AS confirmed, CASE WHEN count(*) FILTER (reason = 'false_positive') * 10 <= count(*) FILTER (status = 'triaged') THEN 'enforce' ELSE 'monitor' END AS advice FROM f GROUP BY 1""", True)
def closeout(spark, sf) -> DataFrame:
    by = findings(spark, sf).groupBy(F.col("surface").alias("plane")).agg(n(), n_if(F.col("status") == "triaged", "confirmed"), n_if(F.col("reason") == "false_positive", "fp"))
    return by.withColumn("advice", F.when(F.expr("fp * 10 <= confirmed"), "enforce").otherwise("monitor")).drop("fp")


@query("my_record", "SELECT actor, status, severity, category, count(*) AS n FROM f WHERE actor = 'u8' GROUP BY ALL", True)
def my_record(spark, sf) -> DataFrame:
    return findings(spark, sf).where("actor = 'u8'").groupBy("actor", "status", "severity", "category").agg(n())


@query("digest_top_actors", f"SELECT actor, count(*) AS n, max(risk) AS worst FROM f WHERE ts >= {CUT} AND severity IN ('high', 'critical') GROUP BY actor ORDER BY n DESC, worst DESC, actor LIMIT 5", True)
def digest(spark, sf) -> DataFrame:
    f = findings(spark, sf).where((F.col("ts") >= F.lit("2024-01-24").cast("timestamp")) & F.col("severity").isin("high", "critical"))
    return f.groupBy("actor").agg(n(), F.max("risk").alias("worst")).orderBy(F.desc("n"), F.desc("worst"), "actor").limit(5)


@query("new_tools", f"SELECT tool, surface, min(ts) AS first_seen FROM f GROUP BY ALL HAVING min(ts) >= TIMESTAMP '2024-01-02'", True)
def new_tools(spark, sf) -> DataFrame:
    return findings(spark, sf).groupBy("tool", "surface").agg(F.min("ts").alias("first_seen")).where(F.col("first_seen") >= F.lit("2024-01-02").cast("timestamp"))


@query("corpus_stats", "SELECT count(*) AS total, count(l.doc_id) AS labelled, count(*) FILTER (quality = 1) AS good, count(*) FILTER (quality = 1 AND toxic = 1) AS disagree FROM documents d LEFT JOIN labels l USING (doc_id)")
def corpus_stats(spark, sf) -> DataFrame:
    l = read(spark, sf, "labels").withColumn("hit", F.lit(True))
    return read(spark, sf, "documents").select("doc_id").join(l, "doc_id", "left").agg(n("total"), n_if(F.col("hit"), "labelled"), n_if(F.col("quality") == 1, "good"), n_if(F.expr("quality = 1 and toxic = 1"), "disagree"))


@query("confusion_sweep", """, c AS (SELECT unnest([15, 35, 60, 80]) AS cutoff), t AS (SELECT cutoff, count(*) FILTER (risk >= cutoff AND status = 'triaged') AS tp, count(*) FILTER (risk >= cutoff AND status <> 'triaged') AS fp, count(*) FILTER (risk < cutoff AND status = 'triaged') AS fn, count(*) FILTER (risk < cutoff AND status <> 'triaged') AS tn FROM f, c GROUP BY cutoff)
SELECT *, round(tp / (tp + fp), 4) AS precision, round(tp / (tp + fn), 4) AS recall, round(2.0 * tp / (2 * tp + fp + fn), 4) AS f1 FROM t""", True)
def confusion(spark, sf) -> DataFrame:
    """All cutoffs in one pass: risks are summed to at most 101 rows before they meet the cutoffs."""
    by = findings(spark, sf).groupBy("risk").agg(n_if(F.col("status") == "triaged", "bad"), n_if(F.col("status") != "triaged", "good"))
    t = by.select("*", F.explode(F.array(*map(F.lit, (15, 35, 60, 80)))).alias("cutoff")).groupBy("cutoff").agg(*(F.sum(F.when(F.expr(c), F.col(x)).otherwise(0)).alias(a) for a, c, x in (("tp", "risk >= cutoff", "bad"), ("fp", "risk >= cutoff", "good"), ("fn", "risk < cutoff", "bad"), ("tn", "risk < cutoff", "good"))))
    return t.withColumns({"precision": F.round(F.expr("tp / (tp + fp)"), 4), "recall": F.round(F.expr("tp / (tp + fn)"), 4), "f1": F.round(F.expr("2.0D * tp / (2 * tp + fp + fn)"), 4)})


@query("recurrence_fold", "SELECT md5(actor || '|' || tool || '|' || category) AS fingerprint, count(*) AS seen_count, min(ts) AS created_at, max(ts) AS last_seen, arg_min(id, (ts, id)) AS first_id, max(risk) AS risk FROM f GROUP BY 1", True)
def fold(spark, sf) -> DataFrame:
    fp = F.md5(F.concat_ws("|", "actor", "tool", "category").cast("binary"))
    return findings(spark, sf).groupBy(fp.alias("fingerprint")).agg(n("seen_count"), F.min("ts").alias("created_at"), F.max("ts").alias("last_seen"), F.min_by("id", F.struct("ts", "id")).alias("first_id"), F.max("risk").alias("risk"))


@query("outbox_backoff", "SELECT k % 9 AS attempts, CASE WHEN k % 9 >= 8 THEN 'dead' ELSE 'pending' END AS state, CAST(least(3600, 5 * pow(3, greatest(k % 9, 1) - 1)) AS BIGINT) AS delay, count(*) AS n FROM f GROUP BY ALL", True)
def backoff(spark, sf) -> DataFrame:
    a = F.col("k") % 9
    return findings(spark, sf).groupBy(a.alias("attempts"), F.when(a >= 8, "dead").otherwise("pending").alias("state"), F.least(F.lit(3600), F.lit(5) * F.pow(F.lit(3), F.greatest(a, F.lit(1)) - 1)).cast("long").alias("delay")).agg(n())


@query("daily_byte_budget", """, d AS (SELECT id, CAST(ts AS DATE) AS day, sum(risk) OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS used FROM f)
SELECT CAST(day AS VARCHAR) AS day, count(*) FILTER (used <= 2000) AS kept, count(*) FILTER (used > 2000) AS dropped FROM d GROUP BY 1""", True)
def budget(spark, sf) -> DataFrame:
    """A running sum per day decides what still fits the day's budget."""
    w = Window.partitionBy("day").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0)
    d = findings(spark, sf).withColumn("day", F.to_date("ts")).withColumn("used", F.sum("risk").over(w))
    return d.groupBy(F.col("day").cast("string").alias("day")).agg(n_if(F.col("used") <= 2000, "kept"), n_if(F.col("used") > 2000, "dropped"))
