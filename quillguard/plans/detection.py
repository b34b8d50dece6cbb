"""Detectors over documents, conversations and pages, as signals folded into verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillguard.functions import columns as C
from quillguard.functions import scoring as S
from quillguard.operators import detectors as D
from quillguard.operators.pipelines import detect_decoded
from quillguard.plans.base import query, read, spread

LUHN_SQL = "list_sum(list_transform(range(1, length(d) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(reverse(d)[i] AS INT) WHEN CAST(reverse(d)[i] AS INT) > 4 THEN CAST(reverse(d)[i] AS INT) * 2 - 9 ELSE CAST(reverse(d)[i] AS INT) * 2 END)) % 10 = 0"
SHAPE_SQL = """CASE WHEN d[1] = '4' THEN length(d) IN (13, 16, 19) WHEN CAST(d[1:2] AS INT) BETWEEN 51 AND 55 OR CAST(d[1:4] AS INT) BETWEEN 2221 AND 2720 THEN length(d) = 16 WHEN d[1:2] IN ('34', '37') THEN length(d) = 15
WHEN d[1:4] = '6011' OR d[1:2] IN ('65', '62') OR CAST(d[1:3] AS INT) BETWEEN 644 AND 649 OR CAST(d[1:4] AS INT) BETWEEN 3528 AND 3589 THEN length(d) BETWEEN 16 AND 19
WHEN d[1:2] IN ('36', '38', '39') OR CAST(d[1:3] AS INT) BETWEEN 300 AND 305 THEN length(d) BETWEEN 14 AND 19 WHEN CAST(d[1:4] AS INT) IN (5018, 5020, 5038, 5893, 6304, 6759) OR CAST(d[1:4] AS INT) BETWEEN 6761 AND 6763 THEN length(d) BETWEEN 12 AND 19 ELSE false END"""
GROUP_SQL = f"(NOT regexp_matches(raw, '[ -]') OR (NOT (contains(raw, ' ') AND contains(raw, '-')) AND array_to_string(list_transform(regexp_split_to_array(raw, '[ -]'), lambda g: length(g)), ',') IN {C.CARD_GROUPS}))"
CARDS_SQL = f"""WITH x AS (SELECT doc_id, source, unnest(regexp_extract_all(text, '[0-9](?:[ -]?[0-9]){{12,18}}')) AS raw FROM documents), y AS (SELECT *, regexp_replace(raw, '[^0-9]', '', 'g') AS d FROM x),
c AS (SELECT doc_id, count(*) AS cards FROM y WHERE {SHAPE_SQL} AND {LUHN_SQL} AND {GROUP_SQL} GROUP BY 1),
m AS (SELECT doc_id, source, len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{{2,}}')) AS mails FROM documents),
s AS (SELECT source, CASE WHEN cards > 0 THEN 0.8 * 0.75 ELSE 0 END AS a, CASE WHEN mails >= 1 THEN 0.55 * 0.6 ELSE 0 END AS b FROM m LEFT JOIN c USING (doc_id)),
r AS (SELECT source, CAST(round_even(CAST((1 - (1 - a) * (1 - b)) * 100 AS DOUBLE), 0) AS INTEGER) AS risk FROM s)"""


def card_signals(docs: DataFrame) -> DataFrame:
    """Documents with signals of valid card numbers and of e-mail addresses."""
    cards = F.filter(F.regexp_extract_all("text", F.lit("[0-9](?:[ -]?[0-9]){12,18}"), F.lit(0)), C.card_ok)
    mails = F.size(F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}"), F.lit(0)))
    found = docs.withColumns({"cards": F.size(cards), "mails": mails})
    return found.withColumn("signals", S.signals((F.col("cards") > 0, S.signal("pii_leak", 0.8, 0.75, "card")), (F.col("mails") >= 1, S.signal("pii_leak", 0.55, 0.6, "email"))))


@query("card_findings_by_source", CARDS_SQL + " SELECT source, CASE WHEN risk >= 80 THEN 'critical' WHEN risk >= 60 THEN 'high' WHEN risk >= 35 THEN 'suspicious' WHEN risk >= 15 THEN 'low' ELSE 'benign' END AS severity, count(*) AS n FROM r GROUP BY ALL")
def card_findings(spark, sf) -> DataFrame:
    """Validated cards and addresses, saturating OR, severity bands, counts. One narrow scan and one small shuffle."""
    return S.verdict(card_signals(read(spark, sf, "documents").select("source", "text"))).groupBy("source", "severity").agg(F.count("*").alias("n"))


@query("secret_labels", """SELECT label, count(*) AS docs FROM (SELECT doc_id, unnest([CASE WHEN regexp_matches(text, '(?i)(password|passwd|secret|token|api_?key)["'']?[ ]*[:=][ ]*["'']?[A-Za-z0-9+/_.=-]{8,}') THEN 'assignment' END,
CASE WHEN regexp_matches(text, 'AKIA[0-9A-Z]{16}') THEN 'aws_access_key' END, CASE WHEN regexp_matches(text, 'gh[pousr]_[A-Za-z0-9]{36}') THEN 'github_token' END, CASE WHEN regexp_matches(text, '-----BEGIN [A-Z ]*PRIVATE KEY-----') THEN 'private_key' END]) AS label FROM documents) WHERE label IS NOT NULL GROUP BY 1""")
def secret_labels(spark, sf) -> DataFrame:
    """Which known secret formats documents hold."""
    labels = D.secret_labels(F.col("text"))
    return read(spark, sf, "documents").select("doc_id", F.explode(labels).alias("label")).groupBy("label").agg(F.count("*").alias("docs"))


@query("prompt_threat_terms", """WITH t AS (SELECT conv_id, turn, lower(regexp_replace(text, '\\s+', ' ', 'g')) AS x FROM conversations) SELECT conv_id, count(*) FILTER (contains(x, 'ignore previous instructions') OR contains(x, 'disregard the above') OR contains(x, 'of the')) AS hits, count(*) AS turns FROM t GROUP BY 1""")
def threat_terms(spark, sf) -> DataFrame:
    """Turns of a conversation with any of some phrases; phrases are a parameter, here with one that the data holds."""
    x = D.has_term(F.col("text"), ("ignore previous instructions", "disregard the above", "of the"))
    return read(spark, sf, "conversations").groupBy("conv_id").agg(F.count_if(x).alias("hits"), F.count("*").alias("turns"))


@query("detector_verdicts")
def detector_verdicts(spark, sf) -> DataFrame:
    """The engine's text detectors (README) over whole documents, as they stand, folded, decoded and reshaped, scored."""
    found = detect_decoded(spread(read(spark, sf, "documents").select("doc_id", "source", "text")), "text")
    return S.verdict(found).select("doc_id", "risk_score", "severity", "recommended_action", "attack_intent", F.size("signals").alias("n_signals"), S.primary(F.col("signals")).alias("check"))


@query("conversation_verdicts")
def conversation_verdicts(spark, sf) -> DataFrame:
    """Gateway traffic: each turn scored, system prompts too, then a verdict per conversation side; no role is a side of its own."""
    found = S.verdict(detect_decoded(spread(read(spark, sf, "conversations").select("conv_id", "role", "text")), "text"))
    return found.groupBy("conv_id", "role").agg(F.max("risk_score").alias("risk"), F.count_if(F.col("risk_score") >= 35).alias("alerts"))


@query("policy_replay", CARDS_SQL + """, p AS (SELECT source, risk, CAST(round_even(CAST((1 - (1 - a)) * 100 AS DOUBLE), 0) AS INTEGER) AS r2 FROM (SELECT source, a, b, CAST(round_even(CAST((1 - (1 - a) * (1 - b)) * 100 AS DOUBLE), 0) AS INTEGER) AS risk FROM s))
SELECT source, count(*) FILTER (risk >= 35 AND r2 < 35) AS relaxed, count(*) FILTER (risk >= 15 AND r2 < 15) AS silenced, count(*) AS n FROM p GROUP BY 1""")
def replay(spark, sf) -> DataFrame:
    """What if the e-mail check were off: both verdicts from the same signals."""
    was = S.verdict(card_signals(read(spark, sf, "documents").select("source", "text"))).withColumnRenamed("risk_score", "was")
    now = S.verdict(was.select("source", "was", S.without_checks(F.col("signals"), ["email"]).alias("signals")))
    return now.groupBy("source").agg(F.count_if(F.expr("was >= 35 and risk_score < 35")).alias("relaxed"), F.count_if(F.expr("was >= 15 and risk_score < 15")).alias("silenced"), F.count("*").alias("n"))


@query("cef_export", """WITH f AS (SELECT event_id, user_id, event_type, CAST(LEAST(100, floor(value * 2)) AS INTEGER) AS risk FROM events)
SELECT 'CEF:0|quillguard|engine|1|' || event_type || '|' || event_type || '|' || CASE WHEN risk >= 80 THEN 9 WHEN risk >= 60 THEN 7 WHEN risk >= 35 THEN 5 WHEN risk >= 15 THEN 3 ELSE 0 END || '|suser=u' || user_id || ' cs1=' || event_id AS line FROM f WHERE risk >= 35""")
def cef(spark, sf) -> DataFrame:
    """Findings as CEF lines, escaped."""
    from quillguard.plans.base import findings
    from quillguard.sources.exports import cef_line

    return findings(spark, sf).where("risk >= 35").select(cef_line(F.col("surface"), F.col("surface"), F.col("severity"), {"suser": F.col("actor"), "cs1": F.col("id").cast("string")}).alias("line"))


@query("jsonl_export", """WITH f AS (SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-20') SELECT CAST(count(*) AS BIGINT) AS rows, max(ts) AS next_since FROM f""")
def jsonl(spark, sf) -> DataFrame:
    """An incremental export's size and next watermark; the lines themselves come from sources.exports."""
    from quillguard.plans.base import findings
    from quillguard.sources.exports import json_lines

    since = F.lit("2024-01-20").cast("timestamp")
    lines = json_lines(findings(spark, sf).where(F.col("ts") >= since), "ts")
    return lines.agg(F.count("line").alias("rows"), F.max("ts").alias("next_since"))


@query("redacted_documents", """SELECT doc_id, md5(regexp_replace(regexp_replace(text, '(?i)((?:password|passwd|secret|token|api_?key)["'']?[ ]*[:=][ ]*["'']?)[A-Za-z0-9+/_.=-]{8,}', '\\1[SECRET]', 'g'), '[0-9]{3}-[0-9]{2}-[0-9]{4}', '[SSN]', 'g')) AS digest FROM documents""")
def redacted(spark, sf) -> DataFrame:
    """Secrets and numbers masked by ordered replacements."""
    from quillguard.operators.redact import redact_patterns

    return read(spark, sf, "documents").select("doc_id", F.md5(redact_patterns(F.col("text")).cast("binary")).alias("digest"))


@query("page_verdicts")
def page_verdicts(spark, sf) -> DataFrame:
    """Visible text of web pages through the detectors."""
    from quillguard.sources.warehouse import page_text

    pages = spread(read(spark, sf, "pages").select("page_id", "html")).select("page_id", page_text(F.col("html")).alias("text"))
    return S.verdict(detect_decoded(pages, "text")).select("page_id", F.length("text").alias("n_chars"), "risk_score", "severity")


@query("linear_classifier_sweep")
def linear_classifier(spark, sf) -> DataFrame:
    """A hashed linear classifier of the toxic label, trained on four fifths of the labelled documents, judged on the rest."""
    from quillguard.operators import ml

    labels = read(spark, sf, "labels").select("doc_id", F.col("toxic").cast("double").alias("label"))
    labelled = spread(read(spark, sf, "documents").select("doc_id", "text")).join(labels, "doc_id")
    rows = labelled.select("doc_id", "label", ml.terms(F.col("text")).alias("terms"))
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(5))
    found = ml.probability(ml.train(rows.where(fold != 0)), rows.where(fold == 0))
    return ml.confusion(found, [0.1, 0.25, 0.5, 0.75])
