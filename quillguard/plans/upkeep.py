"""Upserts, retention, delivery, grants and scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillguard.functions import columns as C
from quillguard.plans.base import findings, query, read


@query("content_ttl_scrub", "SELECT event_id, CASE WHEN ts < TIMESTAMP '2024-01-15' THEN '' ELSE props END AS content, ts < TIMESTAMP '2024-01-15' AS scrubbed FROM events")
def scrub(spark, sf) -> DataFrame:
    """Old content is blanked, its row stays."""
    old = F.col("ts") < F.lit("2024-01-15").cast("timestamp")
    return read(spark, sf, "events").select("event_id", F.when(old, "").otherwise(F.col("props")).alias("content"), old.alias("scrubbed"))


@query("seen_content", "SELECT source, count(*) AS n, count(*) FILTER (doc_id = f) AS unseen FROM (SELECT source, doc_id, min(doc_id) OVER (PARTITION BY source, md5(text)) AS f FROM documents) GROUP BY 1")
def seen(spark, sf) -> DataFrame:
    """Repeats of a text within a source: only hashes are grouped, partially before the shuffle."""
    by = read(spark, sf, "documents").groupBy("source", F.md5(F.col("text").cast("binary")).alias("h")).agg(F.count("*").alias("n"))
    return by.groupBy("source").agg(F.sum("n").alias("n"), F.count("*").alias("unseen"))


@query("delivery_health", "SELECT surface AS sink, count(*) FILTER (severity <> 'benign') AS ok, count(*) FILTER (severity = 'benign') AS failed, max(ts) FILTER (severity <> 'benign') AS last_ok FROM f GROUP BY 1", True)
def delivery(spark, sf) -> DataFrame:
    good = F.col("severity") != "benign"
    return findings(spark, sf).groupBy(F.col("surface").alias("sink")).agg(F.count_if(good).alias("ok"), F.count_if(~good).alias("failed"), F.max(F.when(good, F.col("ts"))).alias("last_ok"))


@query("group_grants", "SELECT c_custkey AS user_key, max((n_regionkey, n_nationkey))[1] AS role, max((n_regionkey, n_nationkey))[2] AS team FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def grants(spark, sf) -> DataFrame:
    """The highest role over a user's groups, with its team."""
    j = read(spark, sf, "customer").join(read(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    best = F.max(F.struct("n_regionkey", "n_nationkey")).alias("b")
    return j.groupBy(F.col("c_custkey").alias("user_key")).agg(best).select("user_key", F.col("b.n_regionkey").alias("role"), F.col("b.n_nationkey").alias("team"))


@query("canary_status", "SELECT tool, count(*) FILTER (surface = 'view') AS reads, count(*) FILTER (surface = 'error') AS obeyed, date_diff('minute', date_trunc('minute', min(ts) FILTER (surface = 'view')), date_trunc('minute', min(ts) FILTER (surface = 'error'))) AS minutes FROM f GROUP BY 1", True)
def canaries(spark, sf) -> DataFrame:
    first = lambda s: F.unix_timestamp(F.date_trunc("minute", F.min(F.when(F.col("surface") == s, F.col("ts")))))
    return findings(spark, sf).groupBy("tool").agg(F.count_if(F.col("surface") == "view").alias("reads"), F.count_if(F.col("surface") == "error").alias("obeyed"), ((first("error") - first("view")) / 60).cast("long").alias("minutes"))


@query("account_types", "SELECT CASE WHEN c_nationkey % 3 = 0 THEN 'personal' WHEN c_nationkey % 3 = 1 THEN 'corporate' ELSE 'unknown' END AS kind, count(*) AS n FROM customer GROUP BY 1")
def accounts(spark, sf) -> DataFrame:
    """Free-mail is personal, a verified domain corporate; addresses are made from the customers."""
    domain = F.element_at(F.array(F.lit("gmail.com"), F.lit("corp.example"), F.lit("other.example")), F.col("c_nationkey") % 3 + 1)
    mail = F.lower(F.concat(F.col("c_name"), F.lit("@"), domain))
    at = F.substring_index(mail, "@", -1)
    kind = F.when(at.isin("gmail.com", "outlook.com"), "personal").when(at.isin("corp.example"), "corporate").otherwise("unknown")
    return read(spark, sf, "customer").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@query("shared_signatures", "SELECT md5(category || tool) AS digest, count(DISTINCT actor) AS reporters, count(DISTINCT actor) >= 2 AS active FROM f WHERE status = 'triaged' GROUP BY 1", True)
def signatures(spark, sf) -> DataFrame:
    by = findings(spark, sf).where("status = 'triaged'").groupBy(F.md5(F.concat("category", "tool").cast("binary")).alias("digest")).agg(F.count_distinct("actor").alias("reporters"))
    return by.withColumn("active", F.col("reporters") >= 2)


@query("catalog_proposals", """WITH h AS (SELECT DISTINCT lower(regexp_extract(url, '://([^/?#]*)', 1)) AS host FROM pages)
SELECT host, CASE WHEN NOT regexp_full_match(host, '([a-z0-9]([a-z0-9-]*[a-z0-9])?[.])+[a-z]{2,}') THEN 'invalid' WHEN host LIKE '%.example.com' THEN 'known' ELSE 'new' END AS state FROM h""")
def proposals(spark, sf) -> DataFrame:
    host = C.host_of(F.col("url"))
    state = F.when(~F.col("host").rlike(r"^([a-z0-9]([a-z0-9-]*[a-z0-9])?[.])+[a-z]{2,}$"), "invalid").when(F.col("host").endswith(".example.com"), "known").otherwise("new")
    return read(spark, sf, "pages").select(host.alias("host")).distinct().withColumn("state", state)


@query("leet_folded_turns", "SELECT conv_id, turn, md5(translate(lower(text), '013457@$', 'oieastas')) AS digest FROM conversations")
def leet(spark, sf) -> DataFrame:
    return read(spark, sf, "conversations").select("conv_id", "turn", F.md5(C.leet_fold(F.lower("text")).cast("binary")).alias("digest"))


@query("text_windows", "SELECT doc_id, CAST(1 + greatest(0, ceil((length(text) - 240) / 120.0)) AS INTEGER) AS windows FROM documents")
def windows(spark, sf) -> DataFrame:
    from quillguard.functions.text import windows as pieces

    return read(spark, sf, "documents").select("doc_id", F.size(pieces(F.col("text"))).alias("windows"))


@query("normalised_documents")
def normalised(spark, sf) -> DataFrame:
    """Folded texts, and whether folding changed them."""
    from quillguard.functions.text import for_match

    folded = read(spark, sf, "documents").select("doc_id", "text", for_match(F.col("text")).alias("folded"))
    return folded.select("doc_id", F.length("folded").alias("n"), (F.col("folded") != F.col("text")).alias("changed"))


@query("corpus_from_triage", "SELECT CASE WHEN status = 'triaged' THEN 'malicious' ELSE 'benign' END AS label, count(*) AS n FROM f WHERE status = 'triaged' OR (status = 'dismissed' AND reason = 'false_positive') GROUP BY 1", True)
def triage(spark, sf) -> DataFrame:
    from quillguard.sources.exports import labelled_examples

    return labelled_examples(findings(spark, sf).withColumn("via", F.lit(None).cast("string"))).groupBy("label").agg(F.count("*").alias("n"))


@query("column_scan", "SELECT 'lang' AS col, count(*) AS sampled, count(*) FILTER (regexp_matches(lang, '[0-9]')) AS matched FROM documents UNION ALL SELECT 'source', count(*), count(*) FILTER (regexp_matches(source, '[0-9]')) FROM documents")
def column_scan(spark, sf) -> DataFrame:
    """Text columns unpivoted, matches counted per column."""
    from quillguard.sources.readers import column_samples

    rows = column_samples(read(spark, sf, "documents").select("doc_id", "lang", "source"))
    return rows.groupBy(F.col("column").alias("col")).agg(F.count("*").alias("sampled"), F.count_if(F.col("value").rlike("[0-9]")).alias("matched"))
