"""Batch forms of the streams' state machines: silences, reopened findings, digests due, spans to read again."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillguard.operators import coverage as V
from quillguard.plans.base import NOW, findings, query, read
from quillguard.streaming import writers


@query("dark_sensors", f""", o AS (SELECT actor, tool, ts AS last_seen, lead(ts) OVER (PARTITION BY actor, tool ORDER BY ts, id) AS back_at FROM f WHERE ts <= TIMESTAMP '{NOW}')
SELECT actor, tool, last_seen, last_seen + INTERVAL 72 HOUR AS dark_at, back_at FROM o WHERE coalesce(back_at, TIMESTAMP '{NOW}') > last_seen + INTERVAL 72 HOUR""", True)
def dark_sensors(spark, sf) -> DataFrame:
    """Sensors silent for more than 72 hours: when they went dark, and when they came back."""
    out = V.silences(findings(spark, sf), ["actor", "tool"], "ts", 72, NOW)
    return out.select("actor", "tool", *(F.col(c).cast("timestamp_ntz").alias(c) for c in ("last_seen", "dark_at", "back_at")))


def lived(f: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Findings with a fingerprint, and reviews: what the tables call dismissed or triaged was so an hour after it was seen."""
    named = f.withColumn("fingerprint", F.concat_ws("|", F.pmod("k", F.lit(7)), "tool", "category"))
    reviews = named.where("status <> 'open'").select("fingerprint", "id", (F.col("ts").cast("timestamp") + F.expr("interval 1 hour")).alias("ts"), "status")
    return named.select("fingerprint", "id", F.col("ts").cast("timestamp").alias("ts"), "severity", "surface"), reviews


LIVE = ["click", "purchase", "error", "login"]


@query("finding_reopenings", """, g AS (SELECT (k % 7) || '|' || tool || '|' || category AS fingerprint, * FROM f),
r AS (SELECT fingerprint, id, ts, NULL AS review, severity IN ('high', 'critical') AND surface IN ('click', 'purchase', 'error', 'login') AS serious FROM g UNION ALL SELECT fingerprint, id, ts + INTERVAL 1 HOUR, status, false FROM g WHERE status <> 'open'),
n AS (SELECT *, count(review) OVER w AS turn, last_value(review IGNORE NULLS) OVER w AS last, count(*) FILTER (review IS NULL) OVER w AS seen FROM r WINDOW w AS (PARTITION BY fingerprint ORDER BY ts, review IS NOT NULL, id ROWS UNBOUNDED PRECEDING)),
s AS (SELECT *, row_number() OVER (PARTITION BY fingerprint, turn, serious ORDER BY ts, id) AS nth FROM n WHERE review IS NULL)
SELECT fingerprint, id, CASE WHEN seen = 1 THEN 'new' ELSE 'reopened' END AS event, seen AS seen_count FROM s WHERE seen = 1 OR (serious AND last = 'dismissed' AND nth = 1)""", True)
def reopenings(spark, sf) -> DataFrame:
    """Findings when they are new, and when a serious repeat in live traffic opens them after they were dismissed: the first such
    repeat after each dismissal."""
    f, reviews = lived(findings(spark, sf))
    serious = F.col("severity").isin("high", "critical") & F.col("surface").isin(*LIVE)
    rows = f.select("fingerprint", "id", "ts", F.lit(None).cast("string").alias("review"), serious.alias("serious")).unionByName(reviews.select("fingerprint", "id", "ts", F.col("status").alias("review"), F.lit(False).alias("serious")))
    w = Window.partitionBy("fingerprint").orderBy("ts", F.col("review").isNotNull(), "id").rowsBetween(Window.unboundedPreceding, 0)
    told = rows.withColumns({"turn": F.count("review").over(w), "last": F.last("review", True).over(w), "seen_count": F.sum(F.when(F.col("review").isNull(), 1).otherwise(0)).over(w)}).where("review is null")
    nth = F.row_number().over(Window.partitionBy("fingerprint", "turn", "serious").orderBy("ts", "id"))
    some = told.withColumn("nth", nth).where("seen_count = 1 or (serious and last = 'dismissed' and nth = 1)")
    return some.select("fingerprint", "id", F.when(F.col("seen_count") == 1, "new").otherwise("reopened").alias("event"), "seen_count")


@query("digests_due", """SELECT date_trunc('week', ts) AS "window", count(*) AS rows, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity IN ('high', 'critical')) AS serious FROM f WHERE date_trunc('week', ts) < date_trunc('week', TIMESTAMP '2024-01-31') GROUP BY 1""", True)
def due(spark, sf) -> DataFrame:
    """What the weekly digests that are due say; streaming.writers.send_digests claims and sends each once."""
    return writers.digests_due(findings(spark, sf), "weekly", NOW).withColumn("window", F.col("window").cast("timestamp_ntz"))


SINCE, UNTIL, BUDGET, SLOT = 1_704_067_200, 1_706_659_200, 86_400, 6 * 3600


@query("backfill_spans", f""", s AS (SELECT tool AS k, epoch_us(ts) // 1000000 AS s, epoch_us(ts) // 1000000 + {SLOT} AS e FROM f WHERE surface = 'purchase' AND risk >= 60),
b AS (SELECT *, max(e) OVER (PARTITION BY k ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM s), i AS (SELECT *, count(*) FILTER (before IS NULL OR s > before) OVER (PARTITION BY k ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS i FROM b),
u AS (SELECT k, min(s) AS s, max(e) AS e FROM i GROUP BY k, i), x AS (SELECT k, s, e FROM u WHERE e > {SINCE} AND s < {UNTIL} UNION ALL SELECT DISTINCT tool, {UNTIL}, {UNTIL} FROM f),
g AS (SELECT k, greatest(coalesce(lag(e) OVER (PARTITION BY k ORDER BY s, e), {SINCE}), {SINCE}) AS s, s AS e FROM x), m AS (SELECT * FROM g WHERE e - s >= 1),
p AS (SELECT *, coalesce(sum(e - s) OVER (PARTITION BY k ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM m), q AS (SELECT k, greatest(s, e - ({BUDGET} - spent)) AS s, e FROM p WHERE spent < {BUDGET})
SELECT q.k AS tool, CAST(q.s AS BIGINT) AS "start", CAST(q.e AS BIGINT) AS "end", (SELECT count(*) FROM f WHERE tool = q.k AND epoch_us(ts) // 1000000 >= q.s AND epoch_us(ts) // 1000000 < q.e) AS rows FROM q""", True)
def backfill_spans(spark, sf) -> DataFrame:
    """Spans of time of each tool that nothing covers, the newest that fit a day's budget, and how many rows reading just those
    brings. A serious purchase stands for a read of the six hours after it."""
    f = findings(spark, sf)
    key = ["tool"]
    spans = f.where("surface = 'purchase' and risk >= 60").select("tool", V.seconds("ts").alias("start"), (V.seconds("ts") + SLOT).alias("end"))
    plan = V.backfill_plan(V.gaps(V.covered(spans, key), f, key, SINCE, UNTIL), key, BUDGET)
    rows = V.reread(f.select("tool", "id", "ts"), plan, key, "ts").withColumn("at", V.seconds("ts"))
    # each row lies in one span: the latest that begins before it
    counted = rows.join(plan.select("tool", F.col("start").alias("s"), F.col("end").alias("e")), "tool").where("at >= s and at < e").groupBy("tool", F.col("s").alias("start")).agg(F.count("*").alias("rows"))
    return plan.join(counted, ["tool", "start"], "left").select("tool", "start", "end", F.coalesce("rows", F.lit(0)).alias("rows"))


LABELLED_SQL = "l AS (SELECT doc_id, quality, toxic, source, CASE WHEN doc_id % 10 <> 0 THEN TIMESTAMP '2024-01-01' + to_minutes(CAST((doc_id * 7919) % 40000 AS BIGINT)) END AS ts FROM labels JOIN documents USING (doc_id))"


@query("exact_splits", f"""WITH {LABELLED_SQL}, s AS (SELECT *, row_number() OVER (PARTITION BY quality, source ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) <= floor(count(*) OVER (PARTITION BY quality, source) * 0.2) AS stratified FROM l),
t AS (SELECT doc_id, row_number() OVER (ORDER BY ts DESC, doc_id DESC) <= greatest(1, floor(count(*) OVER () * 0.2)) AS latest FROM l WHERE ts IS NOT NULL)
SELECT doc_id, stratified, coalesce(latest, false) AS latest FROM s LEFT JOIN t USING (doc_id)""")
def splits(spark, sf) -> DataFrame:
    """Labelled documents held out: a fifth of each label and source, exactly, by hash; and the latest fifth of those that have
    a time."""
    from quillguard.operators import gates

    minutes = F.make_interval(mins=((F.col("doc_id") * 7919) % 40000).cast("int"))
    rows = read(spark, sf, "labels").join(read(spark, sf, "documents").select("doc_id", "source"), "doc_id").select("doc_id", "quality", "source", F.when(F.col("doc_id") % 10 != 0, F.lit("2024-01-01").cast("timestamp") + minutes).alias("ts"))
    both = gates.stratified(rows, ["quality", "source"], "doc_id").withColumnRenamed("held", "stratified")
    return gates.latest(both, "ts", "doc_id").select("doc_id", "stratified", F.col("held").alias("latest"))


@query("confidential_fallback")
def confidential_fallback(spark, sf) -> DataFrame:
    """Documents by checks of confidential prose: markers, and where none spoke a classifier, if it passed its gate on the latest
    fifth of the labelled documents. The label is that of toxic documents; the rule it competes with are the markers."""
    from quillguard.functions import scoring as S
    from quillguard.operators import detectors as D
    from quillguard.operators import gates, ml
    from quillguard.plans.base import spread

    docs = read(spark, sf, "documents").select("doc_id", "text")
    marked = S.signals((D.marked(F.col("text")), S.signal("confidential_data", 0.6, 0.65, "marker", detector="shadow_ai")))
    minutes = F.make_interval(mins=((F.col("doc_id") * 7919) % 40000).cast("int"))
    labels = read(spark, sf, "labels").select("doc_id", F.col("toxic").cast("double").alias("label"), (F.lit("2024-01-01").cast("timestamp") + minutes).alias("ts"))
    held = gates.latest(labels, "ts", "doc_id").select("doc_id", "label", "held")
    # the learner asks for its rows several times: labelled texts meet their labels once and lie on disk until the gate has judged
    labelled = docs.join(held.hint("merge"), "doc_id").select("label", "held", "text").persist(StorageLevel.DISK_ONLY)
    rows = labelled.select("label", "held", D.marked(F.col("text")).alias("rule"), ml.terms(F.col("text")).alias("terms"))
    model = ml.train(rows.where("not held").select("label", "terms"))
    seen = ml.probability(model, rows.where("held"))
    gate = gates.judged(seen, F.col("label") == 1, F.col("p") >= gates.FROM, F.col("rule"), F.lit(False)).first()
    labelled.unpersist()
    found = spread(docs).select("doc_id", marked.alias("signals"), ml.terms(F.col("text")).alias("terms"))
    told = gates.admitted(gate["verdict"], ml.probability(model, found))
    checks = F.filter(F.transform("signals", lambda s: s["check"]), lambda c: c.isin("marker", "confidential_ml"))
    return told.select(F.lit(gate["verdict"]).alias("gate"), F.explode_outer(checks).alias("check")).groupBy("gate", "check").agg(F.count("*").alias("documents"))
