"""Verdict folding, policy decisions, incremental folds and small exports over the findings view."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillguard.functions import columns as C
from quillguard.functions import scoring as S
from quillguard.operators import governance as G
from quillguard.operators import supply_chain as SC
from quillguard.plans.base import findings, query, read

#: category -> what to do about it.
ADVICE = {"secret_leak": "rotate the credential", "pii_leak": "remove personal data", "prompt_injection": "quarantine the source", "source_code_leak": "move to an approved tool"}


def now():
    return F.lit("2024-01-31").cast("timestamp")


@query("signal_folding", """, c AS (SELECT id, k, category, (k % 10) / 10.0::DOUBLE * 0.9::DOUBLE AS c1, CASE WHEN k % 2 = 0 THEN 0.4::DOUBLE * 0.8::DOUBLE ELSE 0 END AS c2, CASE WHEN k % 7 = 0 AND category = 'source_code_leak' THEN 0.35::DOUBLE * 0.9::DOUBLE ELSE 0 END AS c3 FROM f),
r AS (SELECT *, CAST(round_even(CAST((1 - (1 - c1) * (1 - c2) * (1 - c3)) * 100 AS DOUBLE), 0) AS INTEGER) AS raw, (1 - (1 - CASE WHEN category = 'prompt_injection' THEN c1 ELSE 0 END) * (1 - c2)) >= 0.45 AS attack FROM c),
v AS (SELECT *, CASE WHEN (c2 > 0 OR c3 > 0) AND NOT (c1 > 0 AND category <> 'unsanctioned_ai') THEN LEAST(raw, 34) ELSE raw END AS risk_score FROM r)
SELECT id, risk_score, attack AS attack_intent, CASE WHEN c1 >= c2 AND c1 >= c3 THEN category WHEN c2 >= c3 THEN 'prompt_injection_ml' ELSE 'source_code_ml' END AS first FROM v""", True)
def folding(spark, sf) -> DataFrame:
    """Signals of a finding as a verdict: hints uncorroborated or capped, flags, order, what stands first."""
    k = F.col("k")
    row = S.signals(
        (F.lit(True), S.signal("x", (k % 10) / 10.0, 0.9, "x").withField("category", F.col("category")).withField("check", F.col("category"))),
        (k % 2 == 0, S.signal("prompt_injection", 0.4, 0.8, "prompt_injection_ml")), (k % 7 == 0, S.signal("source_code_leak", 0.35, 0.9, "source_code_ml")), (k % 11 == 0, S.signal("detector_error", 0.0, 0.0, "detector_error")),
    )
    v = S.verdict(findings(spark, sf).select("id", row.alias("signals")))
    return v.select("id", "risk_score", "attack_intent", S.top(F.col("signals"), 1)[0]["check"].alias("first"))


@query("policy_filtered_signals", "SELECT id, category <> 'pii_leak' AS kept, k % 11 = 0 AS marked, category IN ('secret_leak', 'pii_leak') AS leak FROM f", True)
def filtered(spark, sf) -> DataFrame:
    """Signals of a switched-off check go, markers stay; whether a confirmed leak was among them is kept."""
    found = S.signals((F.lit(True), S.signal("x", 0.5, 0.5, "x").withField("category", F.col("category")).withField("check", F.col("category"))), (F.col("k") % 11 == 0, S.signal("detector_error", 0.0, 0.0, "detector_error")))
    f = findings(spark, sf).withColumn("signals", found).withColumn("left", S.without_checks(F.col("signals"), ["pii_leak"]))
    return f.select("id", F.exists("left", lambda s: s["check"] != "detector_error").alias("kept"), F.exists("left", lambda s: s["check"] == "detector_error").alias("marked"), S.confirmed_leak(F.col("signals")).alias("leak"))


@query("origin_boost", "SELECT id, CASE WHEN k % 3 = 0 AND k % 2 = 0 THEN LEAST(100, GREATEST(60, risk + 25)) WHEN k % 3 = 0 THEN LEAST(100, risk + 15) ELSE risk END AS risk FROM f", True)
def boosts(spark, sf) -> DataFrame:
    k = F.col("k")
    return findings(spark, sf).select("id", S.boosted(F.col("risk"), k % 2 == 0, k % 3 == 0).alias("risk"))


@query("enforcement_outcome", """SELECT category, CASE WHEN k % 3 = 0 THEN 'observe' ELSE 'enforce' END AS model, count(*) FILTER (k % 3 <> 0 AND risk >= 35) AS stopped, count(*) FILTER (k % 3 = 0 AND risk >= 35) AS would_stop, count(*) FILTER (k % 3 = 0 OR risk < 35) AS left_out,
CASE category WHEN 'secret_leak' THEN 'rotate the credential' WHEN 'pii_leak' THEN 'remove personal data' WHEN 'prompt_injection' THEN 'quarantine the source' WHEN 'source_code_leak' THEN 'move to an approved tool' ELSE 'review' END AS advice FROM f GROUP BY ALL""", True)
def outcome(spark, sf) -> DataFrame:
    """What enforcement stops or, where it only observes, would stop; what left the boundary; and the advice for a category."""
    model = F.when(F.col("k") % 3 == 0, "observe").otherwise("enforce")
    f = findings(spark, sf).withColumns({"model": model, "act": C.action(F.col("risk"))})
    stop = F.col("act").isin("block", "quarantine")
    advice = F.coalesce(F.create_map(*(F.lit(x) for kv in ADVICE.items() for x in kv))[F.col("category")], F.lit("review"))
    by = f.groupBy("category", "model").agg(F.count_if(stop & (F.col("model") == "enforce")).alias("stopped"), F.count_if(stop & (F.col("model") == "observe")).alias("would_stop"), F.count_if(G.left_the_boundary(F.col("model"), F.col("act"))).alias("left_out"))
    return by.withColumn("advice", advice)


@query("client_actions", "SELECT severity, CASE WHEN severity IN ('high', 'critical') THEN 'block' WHEN severity = 'suspicious' THEN 'warn' ELSE 'allow' END AS act, count(*) AS n FROM f WHERE severity IN ('suspicious', 'high', 'critical', 'low') GROUP BY ALL", True)
def clients(spark, sf) -> DataFrame:
    f = findings(spark, sf).where(C.rank(F.col("severity")) >= C.RANKS["low"])
    return f.groupBy("severity", C.client_action(F.col("severity")).alias("act")).agg(F.count("*").alias("n"))


@query("containment_precedence", "SELECT DISTINCT actor, tool, surface, CASE WHEN tool = 'tool3' THEN 'agent' WHEN surface = 'click' THEN 'device' WHEN actor IN ('u1', 'u8') THEN 'user' END AS contained_by FROM f", True)
def containment(spark, sf) -> DataFrame:
    """The widest active rule; released and expired ones don't count."""
    rules = [("agent", "TOOL3", "2025-01-01", None), ("device", "click", "2025-01-01", None), ("user", "u1", "2025-01-01", None), ("user", "u8", "2025-01-01", None), ("user", "u2", "2023-01-01", None), ("device", "view", "2025-01-01", "2024-01-02")]
    r = spark.createDataFrame(rules, "scope string, target string, expires_at string, released_at string").withColumn("expires_at", F.col("expires_at").cast("timestamp"))
    callers = findings(spark, sf).select("actor", "tool", "surface").distinct().select("*", F.lit("o").alias("org"), F.col("tool").alias("agent"), F.col("surface").alias("device"), F.col("actor").alias("user"))
    return G.contained(callers, r, now()).select("actor", "tool", "surface", "contained_by")


@query("allow_entries", "SELECT DISTINCT actor, tool, CASE WHEN tool = 'tool1' THEN 1 WHEN tool = 'tool2' AND actor = 'u8' THEN 3 END AS entry_id FROM f", True)
def allows(spark, sf) -> DataFrame:
    rows = [(1, None, "tool1", None, False), (2, "u8", "tool1", None, False), (3, "u8", "tool2", "2025-01-01", False), (4, None, "tool4", None, True), (5, None, "tool5", "2023-01-01", False)]
    e = spark.createDataFrame(rows, "entry_id int, actor string, tool string, expires_at string, revoked boolean").withColumn("expires_at", F.col("expires_at").cast("timestamp"))
    return G.allowed_entries(findings(spark, sf).select("actor", "tool").distinct(), e, now())


@query("unsanctioned_destinations", """WITH h AS (SELECT page_id, lower(regexp_extract(url, '://([^/?#]*)', 1)) AS host FROM pages), d AS (SELECT *, host = 'example.org' OR host LIKE '%.example.org' AS known, host = 'example.com' OR host LIKE '%.example.com' AS ok FROM h)
SELECT host, CASE WHEN ok THEN 'sanctioned' WHEN known THEN 'known 0.35 0.65' ELSE 'unknown 0.28 0.45' END AS verdict, count(*) AS n FROM d GROUP BY ALL""")
def destinations(spark, sf) -> DataFrame:
    """Destinations that aren't sanctioned: a known tool weighs more than an unknown host."""
    h = read(spark, sf, "pages").select(C.host_of(F.col("url")).alias("host"))
    known = C.on_host(F.col("host"), F.lit("example.org"))
    ok = G.sanctioned(F.lit(""), F.col("host"), [], ["example.com"])
    return h.groupBy("host", F.when(ok, "sanctioned").when(known, "known 0.35 0.65").otherwise("unknown 0.28 0.45").alias("verdict")).agg(F.count("*").alias("n"))


@query("suppressed_signals", "SELECT tool, count(*) FILTER (NOT ((tool = 'tool1' AND category IN ('pii_leak', 'secret_leak')) OR (tool = 'tool2' AND category = 'prompt_injection'))) AS kept, count(*) AS n FROM f GROUP BY 1", True)
def suppressed(spark, sf) -> DataFrame:
    """Rules of the form tool:category,category;... take those categories out for that tool."""
    return findings(spark, sf).groupBy("tool").agg(F.count_if(~G.suppressed(F.col("tool"), F.col("category"), "tool1:pii_leak,secret_leak; tool2:prompt_injection")).alias("kept"), F.count("*").alias("n"))


@query("need_to_know", "SELECT id, category = 'secret_leak' AND NOT (actor LIKE 'u1%') AS overshared FROM f", True)
def oversharing(spark, sf) -> DataFrame:
    f = findings(spark, sf).withColumn("signals", F.array(S.signal("x", 0.5, 0.5, "x").withField("category", F.col("category")))).withColumn("text", F.lit(""))
    return G.need_to_know(f, [("secret_leak", ["u1*"])]).select("id", F.exists("signals", lambda s: s["category"] == "oversharing").alias("overshared"))


@query("private_lane", "SELECT tool, count(*) FILTER (category IN ('secret_leak', 'source_code_leak')) AS in_lane FROM f GROUP BY 1", True)
def lanes(spark, sf) -> DataFrame:
    one = F.array(S.signal("x", 0.5, 0.5, "x").withField("category", F.col("category")))
    return findings(spark, sf).groupBy("tool").agg(F.count_if(G.lane(one, ["secret_leak", "source_code_leak"])).alias("in_lane"))


@query("feed_tiers", """, r AS (SELECT 'srv' || (k % 12) AS name, k % 40 = 0 AS evidence, k % 3 AS risks, k % 2 AS gaps, k % 4 AS bonus, k % 70 AS penalty FROM f), t AS (SELECT name, CASE WHEN evidence THEN 4 WHEN risks = 0 AND gaps = 0 THEN 1 WHEN risks > 0 THEN 3 ELSE 2 END AS w,
CASE WHEN evidence THEN 0 WHEN risks = 0 AND gaps = 0 THEN LEAST(95, 80 + 5 * bonus) ELSE GREATEST(10, LEAST(65, 70 - penalty)) END AS score FROM r) SELECT name, ['trusted', 'unverified', 'caution', 'malicious'][w] AS tier, min(score) AS score FROM t WHERE w = (SELECT max(w) FROM t u WHERE u.name = t.name) GROUP BY ALL""", True)
def tiers(spark, sf) -> DataFrame:
    """Evidence, risks and gaps as a tier and a score; the worst row wins a name."""
    k = F.col("k")
    rows = findings(spark, sf).select(F.concat(F.lit("srv"), k % 12).alias("name"), (k % 40 == 0).alias("evidence"), (k % 3).alias("risks"), (k % 2).alias("gaps"), (k % 4).alias("bonus"), (k % 70).alias("penalty"), F.lit("r").alias("reason"))
    return SC.feed_tiers(rows).select("name", "tier", "score")


@query("activity_since", "SELECT id, ts > TIMESTAMP '2024-01-24' AS by_week, ts > TIMESTAMP '2024-01-30' AS by_day FROM f WHERE ts > TIMESTAMP '2024-01-17'", True)
def since(spark, sf) -> DataFrame:
    """Look-backs as people write them: 2w, 7d, 24h before a given now."""
    at = lambda t: C.age_since(F.lit(t), now())
    return findings(spark, sf).where(F.col("ts") > at("2w")).select("id", (F.col("ts") > at("7d")).alias("by_week"), (F.col("ts") > at("24h")).alias("by_day"))


@query("command_fold_keys", "SELECT substr(sha256('deploy ' || surface || ' --build # --ref #'), 1, 12) AS key, count(*) AS n FROM f GROUP BY 1", True)
def fold_keys(spark, sf) -> DataFrame:
    """Repeats of a command share a key: case, blanks, numbers and long hex don't count."""
    command = F.concat(F.lit("Deploy  "), F.upper("surface"), F.lit(" --build "), F.col("id").cast("string"), F.lit(" --ref "), F.md5(F.col("id").cast("string").cast("binary")))
    return findings(spark, sf).groupBy(C.command_key(command).alias("key")).agg(F.count("*").alias("n"))


@query("masked_actors", "SELECT CASE WHEN length(n) <= 8 THEN repeat('•', length(n)) ELSE substr(n, 1, 4) || '••••' || substr(n, -4) END AS masked, count(*) AS n FROM (SELECT n_name AS n FROM nation JOIN customer ON n_nationkey = c_nationkey) GROUP BY 1")
def masks(spark, sf) -> DataFrame:
    by = read(spark, sf, "customer").groupBy("c_nationkey").agg(F.count("*").alias("m")).join(read(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return by.groupBy(C.mask(F.col("n_name")).alias("masked")).agg(F.sum("m").alias("n"))


@query("payload_entropy", """WITH c AS (SELECT event_id, props, unnest(list_distinct(regexp_extract_all(props, '(?s).'))) AS ch FROM events), p AS (SELECT event_id, (length(props) - length(replace(props, ch, ''))) / length(props) AS q FROM c) SELECT event_id, round(-sum(q * log2(q)), 6) AS bits FROM p GROUP BY 1""")
def entropies(spark, sf) -> DataFrame:
    return read(spark, sf, "events").select("event_id", F.round(C.entropy(F.col("props")), 6).alias("bits"))


@query("recurrence_reopened", """, o AS (SELECT *, row_number() OVER (PARTITION BY actor, tool, category ORDER BY ts, id) AS r FROM f) SELECT actor, tool, category, count(*) AS seen_count, min(ts) AS created_at, max(ts) AS last_seen, bool_or(r > 1 AND severity IN ('high', 'critical') AND surface <> 'view') AND bool_or(r = 1 AND status = 'dismissed') AS reopened FROM o GROUP BY ALL""", True)
def reopened(spark, sf) -> DataFrame:
    """A finding per fingerprint; one that was dismissed opens again when it recurs in live traffic with high severity. Partial
    folds only: the first row by a minimum, later serious ones counted against it."""
    first = F.min(F.struct("ts", "id", "status", F.struct("severity", "surface").alias("s")))
    live = F.col("severity").isin("high", "critical") & (F.col("surface") != "view")
    by = findings(spark, sf).groupBy("actor", "tool", "category").agg(F.count("*").alias("seen_count"), F.max("ts").alias("last_seen"), first.alias("f"), F.count_if(live).alias("serious"))
    own = (F.col("f.s.severity").isin("high", "critical") & (F.col("f.s.surface") != "view")).cast("int")
    return by.select("actor", "tool", "category", "seen_count", F.col("f.ts").alias("created_at"), "last_seen", ((F.col("serious") - own > 0) & (F.col("f.status") == "dismissed")).alias("reopened"))


@query("chain_fold_by_signature", """, w AS (SELECT a.id, a.actor, a.ts, array_to_string(list_sort(list_distinct(list(b.category))), ',') AS stages, max(b.risk) AS most FROM f a JOIN f b ON a.actor = b.actor AND epoch_us(b.ts) // 1000000 BETWEEN epoch_us(a.ts) // 1000000 - 1800 AND epoch_us(a.ts) // 1000000 WHERE a.risk >= 15 AND b.risk >= 15 GROUP BY ALL)
SELECT actor, stages, count(*) AS seen, min(ts) AS first_at, max(ts) AS last_at FROM w WHERE contains(stages, ',') AND most >= 60 GROUP BY ALL""", True)
def chain_fold(spark, sf) -> DataFrame:
    """Chains of one actor with the same stages are one finding that was seen again."""
    from quillguard.operators.temporal import chain_windows

    f = findings(spark, sf).where("risk >= 15")
    c = chain_windows(f, exfiltration="secret_leak", execution="source_code_leak").join(f.select("id", "ts"), "id")
    return c.groupBy("actor", "stages").agg(F.count("*").alias("seen"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"))


@query("digest_windows", "SELECT date_trunc('day', ts) AS day, CAST(count(*) AS BIGINT) AS rows, count(*) FILTER (severity = 'critical') AS critical, md5(strftime(date_trunc('day', ts), '%Y-%m-%d') || '|daily') AS claim FROM f GROUP BY 1", True)
def digests(spark, sf) -> DataFrame:
    """One digest a day; its claim is a key of the window alone, so a repeated run claims the same."""
    by = findings(spark, sf).groupBy(F.date_trunc("day", "ts").alias("day")).agg(F.count("*").alias("rows"), F.count_if(F.col("severity") == "critical").alias("critical"))
    return by.withColumn("claim", F.md5(F.concat_ws("|", F.date_format("day", "yyyy-MM-dd"), F.lit("daily")).cast("binary")))


@query("archive_batches", """, s AS (SELECT surface, date_trunc('hour', ts) AS hour, id, sum(length(actor) + length(tool) + 40) OVER (PARTITION BY surface, date_trunc('hour', ts) ORDER BY ts, id) AS upto FROM f) SELECT surface, hour, CAST((upto - 1) // 500 AS BIGINT) AS part, count(*) AS rows FROM s GROUP BY ALL""", True)
def archive(spark, sf) -> DataFrame:
    """Micro-batches by hour and size: a running size within the hour decides the part a row goes to."""
    size = F.length("actor") + F.length("tool") + 40
    f = findings(spark, sf).withColumns({"hour": F.date_trunc("hour", "ts"), "second": F.date_trunc("second", "ts"), "size": size})
    # a second is ordered by itself, the seconds of an hour by their sums
    sums = f.groupBy("surface", "hour", "second").agg(F.sum("size").alias("n"))
    before = F.sum("n").over(Window.partitionBy("surface", "hour").orderBy("second").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    w = Window.partitionBy("surface", "hour", "second").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0)
    s = f.withColumn("own", F.sum("size").over(w)).join(sums.select("surface", "hour", "second", before.alias("before")), ["surface", "hour", "second"]).withColumn("upto", F.col("before") + F.col("own"))
    return s.groupBy("surface", "hour", F.floor((F.col("upto") - 1) / 500).alias("part")).agg(F.count("*").alias("rows"))


@query("late_gaps", """, o AS (SELECT actor, ts, lag(ts) OVER (PARTITION BY actor ORDER BY ts, id) AS prev FROM f) SELECT actor, count(*) AS gaps, max(date_diff('second', prev, ts)) AS longest FROM o WHERE date_diff('second', prev, ts) > 86400 GROUP BY 1""", True)
def gaps(spark, sf) -> DataFrame:
    """Gaps of more than a day in what was landed for an actor, to be backfilled. They lie between days, so a day's first and last
    moments are all that is ordered of an actor."""
    at = F.unix_seconds(F.date_trunc("second", F.col("ts").cast("timestamp")))
    days = findings(spark, sf).groupBy("actor", F.to_date("ts").alias("day")).agg(F.min(at).alias("first"), F.max(at).alias("last"))
    o = days.select("actor", (F.col("first") - F.lag("last").over(Window.partitionBy("actor").orderBy("day"))).alias("gap"))
    return o.where("gap > 86400").groupBy("actor").agg(F.count("*").alias("gaps"), F.max("gap").alias("longest"))


@query("grants_by_breadth", "SELECT p_brand AS app, count(*) AS grants, count(*) FILTER (regexp_matches(lower(p_name || ' ' || p_type), 'steel|brass')) AS broad FROM part GROUP BY 1")
def grants(spark, sf) -> DataFrame:
    """Grants per app, and those whose scopes hold a marker of broad access."""
    scopes = F.lower(F.concat_ws(" ", "p_name", "p_type"))
    return read(spark, sf, "part").groupBy(F.col("p_brand").alias("app")).agg(F.count("*").alias("grants"), F.count_if(scopes.rlike("steel|brass")).alias("broad"))


@query("requests_newest_first", "SELECT o_orderkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey ORDER BY o_orderdate DESC, o_orderkey LIMIT 100")
def requests(spark, sf) -> DataFrame:
    """Requests with their tenant, the newest hundred: a top-k, each task keeps a hundred."""
    newest = read(spark, sf, "orders").join(read(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return newest.orderBy(F.desc("o_orderdate"), "o_orderkey").limit(100).select("o_orderkey", "c_mktsegment")


@query("mine_by_two_keys", "SELECT actor, count(*) AS n FROM f WHERE actor = 'u8' OR tool = 'tool8' GROUP BY 1", True)
def mine(spark, sf) -> DataFrame:
    return findings(spark, sf).where("actor = 'u8' or tool = 'tool8'").groupBy("actor").agg(F.count("*").alias("n"))


@query("capped_listing", "SELECT surface, LEAST(count(*), 200) AS listed, count(*) > 200 AS truncated FROM f GROUP BY 1", True)
def capped(spark, sf) -> DataFrame:
    """What a listing with a cap shows, and whether it is cut."""
    by = findings(spark, sf).groupBy("surface").agg(F.count("*").alias("n"))
    return by.select("surface", F.least("n", F.lit(200)).alias("listed"), (F.col("n") > 200).alias("truncated"))


@query("ordered_distinct", "SELECT conv_id, string_agg(role, ',' ORDER BY turn) AS roles FROM (SELECT conv_id, role, min(turn) AS turn FROM conversations WHERE role IS NOT NULL GROUP BY ALL) GROUP BY 1")
def ordered(spark, sf) -> DataFrame:
    """Each value once, in the order it came."""
    by = read(spark, sf, "conversations").where("role is not null").groupBy("conv_id", "role").agg(F.min("turn").alias("turn"))
    return by.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("x")).select("conv_id", F.array_join(F.transform("x", lambda x: x["role"]), ",").alias("roles"))


@query("insert_if_absent", "SELECT user_id, event_type, min(ts) AS first_at FROM events WHERE ts >= TIMESTAMP '2024-01-05' GROUP BY ALL")
def inserted(spark, sf) -> DataFrame:
    """The first row of a key stays, later ones do nothing; keys of before the sweep's time are gone."""
    e = read(spark, sf, "events").where(F.col("ts") >= F.lit("2024-01-05").cast("timestamp"))
    return e.groupBy("user_id", "event_type").agg(F.min("ts").alias("first_at"))


@query("dismissal_cascade", """, l AS (SELECT actor, date_trunc('day', ts) AS day, id, status FROM f WHERE severity = 'critical') SELECT actor, day, count(*) AS links, count(*) FILTER (status <> 'dismissed') = 0 AS dismissed FROM l GROUP BY ALL""", True)
def cascade(spark, sf) -> DataFrame:
    """A chain whose links are all dismissed is dismissed with them."""
    links = findings(spark, sf).where("severity = 'critical'")
    return links.groupBy("actor", F.date_trunc("day", "ts").alias("day")).agg(F.count("*").alias("links"), F.every(F.col("status") == "dismissed").alias("dismissed"))


@query("commit_attestations", "SELECT id, md5('k' || CAST(id AS VARCHAR)) = CASE WHEN k % 5 = 0 THEN 'forged' ELSE md5('k' || CAST(id AS VARCHAR)) END AS valid FROM f", True)
def attestations(spark, sf) -> DataFrame:
    """Signed notes of commits: whether the signature is the content's."""
    right = F.md5(F.concat(F.lit("k"), F.col("id").cast("string")).cast("binary"))
    return findings(spark, sf).select("id", (right == F.when(F.col("k") % 5 == 0, "forged").otherwise(right)).alias("valid"))


@query("training_split", "WITH l AS (SELECT doc_id, quality, crc32_mod AS r FROM (SELECT doc_id, quality, doc_id % 5 AS crc32_mod FROM labels)) SELECT quality, count(*) FILTER (r <> 0) AS train, count(*) FILTER (r = 0) AS held_out FROM l GROUP BY 1")
def split(spark, sf) -> DataFrame:
    """A split that keeps each label's share, by key, so that it is the same in every run."""
    part = F.pmod("doc_id", F.lit(5))
    return read(spark, sf, "labels").groupBy("quality").agg(F.count_if(part != 0).alias("train"), F.count_if(part == 0).alias("held_out"))


@query("capture_daily_cap", ", r AS (SELECT date_trunc('day', ts) AS day, category, row_number() OVER (PARTITION BY date_trunc('day', ts), category ORDER BY md5(CAST(id AS VARCHAR)), id) AS r FROM f WHERE risk >= 35) SELECT day, category, count(*) FILTER (r <= 5) AS captured, count(*) AS offered FROM r GROUP BY ALL", True)
def capture(spark, sf) -> DataFrame:
    """A fixed number of examples a day and category, chosen by hash: the cap is the feature."""
    by = findings(spark, sf).where("risk >= 35").groupBy(F.date_trunc("day", "ts").alias("day"), "category").agg(F.count("*").alias("offered"))
    return by.select("day", "category", F.least("offered", F.lit(5)).alias("captured"), "offered")


@query("template_expansion", "SELECT r_name || ': ' || verb || ' the ' || n_name || ' report' AS text FROM region JOIN nation ON r_regionkey = n_regionkey CROSS JOIN (VALUES ('send'), ('hide'), ('read')) v(verb)")
def expansion(spark, sf) -> DataFrame:
    """Templates with slots filled from small lists, exploded rather than cross joined."""
    named = read(spark, sf, "nation").join(read(spark, sf, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    return named.select(F.explode(F.array(*map(F.lit, ("send", "hide", "read")))).alias("verb"), "r_name", "n_name").select(F.concat("r_name", F.lit(": "), "verb", F.lit(" the "), "n_name", F.lit(" report")).alias("text"))


@query("session_export", """SELECT actor || ',' || CAST(count(*) AS VARCHAR) || ',' || CAST(count(*) FILTER (severity = 'critical') AS VARCHAR) || ',"' || string_agg(DISTINCT surface, ';' ORDER BY surface) || '"' AS line FROM f GROUP BY actor""", True)
def sessions(spark, sf) -> DataFrame:
    """Sessions as CSV lines."""
    by = findings(spark, sf).groupBy("actor").agg(F.count("*").alias("n"), F.count_if(F.col("severity") == "critical").alias("c"), F.array_sort(F.collect_set("surface")).alias("s"))
    return by.select(F.concat_ws(",", "actor", "n", "c", F.concat(F.lit('"'), F.array_join("s", ";"), F.lit('"'))).alias("line"))


@query("envelope_lines", "SELECT json_object('time', epoch(date_trunc('second', ts))::BIGINT, 'sourcetype', 'quillguard:finding', 'event', json_object('id', id, 'ts', NULL)) IS NOT NULL AS ok, epoch_us(ts) // 1000000 AS time, id FROM f", True)
def envelopes(spark, sf) -> DataFrame:
    from quillguard.sources.exports import hec_envelope

    lines = hec_envelope(findings(spark, sf).select("id", "ts"), "ts")
    at = lambda p: F.get_json_object("line", p)
    return lines.select((at("$.sourcetype") == "quillguard:finding").alias("ok"), at("$.time").cast("long").alias("time"), at("$.event.id").cast("long").alias("id"))


@query("tenant_export", "SELECT n_name AS tenant, count(*) AS members, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def tenants(spark, sf) -> DataFrame:
    """One document a tenant, written as JSON and read back."""
    by = read(spark, sf, "customer").groupBy("c_nationkey").agg(F.count("*").alias("members"), F.round(F.sum("c_acctbal"), 2).alias("balance"))
    doc = by.join(read(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.to_json(F.struct(F.col("n_name").alias("tenant"), "members", "balance")).alias("doc"))
    return doc.select(F.from_json("doc", "tenant string, members long, balance double").alias("d")).select("d.*")


@query("two_way_calls", ", e AS (SELECT tool AS a, 'tool' || ((k * 5 + 1) % 12) AS b FROM f) SELECT least(a, b) AS x, greatest(a, b) AS y, count(*) AS calls, count(*) FILTER (a < b) AS forward FROM e WHERE a <> b GROUP BY ALL", True)
def calls(spark, sf) -> DataFrame:
    """Calls between agents, both directions as one edge."""
    e = findings(spark, sf).select(F.col("tool").alias("a"), F.concat(F.lit("tool"), (F.col("k") * 5 + 1) % 12).alias("b")).where("a <> b")
    return e.groupBy(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).agg(F.count("*").alias("calls"), F.count_if(F.col("a") < F.col("b")).alias("forward"))
