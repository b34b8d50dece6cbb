"""Sensitive values by place, tokens in request payloads and signed commits, over the given tables."""

from __future__ import annotations

import hashlib
import hmac

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillguard.functions import spans as P
from quillguard.operators import attest
from quillguard.operators import detectors as D
from quillguard.operators import redact as R
from quillguard.plans.base import findings, query, read, spread
from quillguard.plans.detection import GROUP_SQL, LUHN_SQL, SHAPE_SQL

KEY = b"key of the registered queries"


def hmac_sql(message: str, key: bytes) -> str:
    """RFC 2104 in DuckDB."""
    block = key.ljust(64, b"\0")
    pad = lambda x: bytes(b ^ x for b in block).hex()
    return f"sha256(unhex('{pad(0x5C)}') || unhex(sha256(unhex('{pad(0x36)}') || encode({message}))))"


ASSIGNED = r"""(?i)(password|passwd|secret|token|api_?key)["'']?[ ]*[:=][ ]*["'']?[A-Za-z0-9+/_.=-]{8,}"""
STAND_IN = r"(?i)example|placeholder|your[_-]|changeme|change_me|redacted|dummy|x{5,}|\*{3,}|\.\.\.|0{8,}|1{8,}|<[a-z_ -]+>|\$\{"
SPANS_SQL = "".join(
    [f"WITH m AS ("]
    + [" UNION ALL ".join(f"SELECT doc_id, {k} AS kind, regexp_extract_all(text, '(?:{p}){R.CLINGING}') AS hits, string_split_regex(text, '(?:{p}){R.CLINGING}') AS gaps, text FROM documents" for k, p in ((1, ASSIGNED), (3, "[0-9](?:[ -]?[0-9]){12,18}"), (5, R.EMAIL)))]
    + [f"""), i AS (SELECT doc_id, kind, hits, gaps, unnest(range(1, len(hits) + 1)) AS i FROM m),
p AS (SELECT doc_id, kind, hits[i] AS raw, sum(length(gaps[i]) + length(hits[i])) OVER (PARTITION BY doc_id, kind ORDER BY i) AS e FROM i),
n AS (SELECT *, regexp_replace(raw, '[^0-9]', '', 'g') AS d FROM p),
s AS (SELECT doc_id, kind, e - length(raw) AS s, e FROM n WHERE CASE kind WHEN 1 THEN NOT regexp_matches(raw, '{STAND_IN}') WHEN 3 THEN ({SHAPE_SQL}) AND {LUHN_SQL} AND {GROUP_SQL} ELSE true END),
b AS (SELECT *, max(e) OVER (PARTITION BY doc_id ORDER BY s, e, kind ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM s),
g AS (SELECT *, count(*) FILTER (before IS NULL OR s >= before) OVER (PARTITION BY doc_id ORDER BY s, e, kind ROWS UNBOUNDED PRECEDING) AS g FROM b),
u AS (SELECT doc_id, min(s) AS s, max(e) AS e, min(kind) AS kind FROM g GROUP BY doc_id, g)"""]
)


@query("document_spans", SPANS_SQL + """, w AS (SELECT u.*, s + len(regexp_extract_all(left(text, CAST(s AS BIGINT)), '[\\x{10000}-\\x{10ffff}]')) AS s16 FROM u JOIN documents USING (doc_id))
SELECT doc_id, CASE kind WHEN 1 THEN 'secret' WHEN 3 THEN 'card' ELSE 'email' END AS kind, CAST(s AS INTEGER) AS "start", CAST(e AS INTEGER) AS "end", CAST(s16 AS INTEGER) AS start16 FROM w""")
def document_spans(spark, sf) -> DataFrame:
    """Where secrets, valid card numbers and addresses stand in documents, overlapping ones merged, in code points and UTF-16.
    The twin knows the formats that the tables hold; tests hold the others."""
    docs = spread(read(spark, sf, "documents").select("doc_id", "text"))
    found = docs.withColumn("bits", D.gates(F.col("text"))).withColumn("spans", P.with_utf16(F.col("text"), R.spans_of(F.col("text"), ("secret", "card", "email"), bits=F.col("bits")), "kind"))
    return found.select("doc_id", F.explode("spans").alias("s")).select("doc_id", R.kind_of(F.col("s.kind")).alias("kind"), "s.start", "s.end", "s.start16")


@query("redacted_values", SPANS_SQL + """, o AS (SELECT *, lag(e, 1, 0) OVER (PARTITION BY doc_id ORDER BY s) AS from_ FROM u),
t AS (SELECT doc_id, string_agg(text[CAST(from_ + 1 AS BIGINT):CAST(s AS BIGINT)] || CASE kind WHEN 1 THEN regexp_extract(text[CAST(s + 1 AS BIGINT):CAST(e AS BIGINT)], '(?i)^((?:password|passwd|secret|token|api_?key)["'']?[ ]*[:=][ ]*["'']?)', 1) || '[SECRET]' WHEN 3 THEN '[CARD]' ELSE '[EMAIL]' END, '' ORDER BY s) || any_value(text[CAST(e_ + 1 AS BIGINT):]) AS r
    FROM (SELECT *, max(e) OVER (PARTITION BY doc_id) AS e_ FROM o) JOIN documents USING (doc_id) GROUP BY 1)
SELECT doc_id, md5(coalesce(r, text)) AS digest FROM documents LEFT JOIN t USING (doc_id)""")
def redacted_values(spark, sf) -> DataFrame:
    """Documents with the values of document_spans cut out: the same finder, so nothing is cut that isn't marked."""
    docs = spread(read(spark, sf, "documents").select("doc_id", "text"))
    gated = docs.withColumn("bits", D.gates(F.col("text")))
    return gated.select("doc_id", F.md5(R.redact_text(F.col("text"), ("secret", "card", "email"), F.col("bits")).cast("binary")).alias("digest"))


ADDRESS_SQL = "'c' || conv_id || '.' || role || '@mail' || (turn % 3) || '.example.com'"


@query("payload_tokens", f"""WITH c AS (SELECT conv_id, turn, text, {ADDRESS_SQL} AS address FROM conversations), t AS (SELECT *, 'QG_EMAIL_' || left({hmac_sql('address', KEY)}, 16) AS token FROM c)
SELECT conv_id, turn, 'm ' || address AS model, md5('Dear ' || token || chr(10) || text) AS content, json_extract_string(to_json({{'to': token, 'cc': [token, 'none']}}), '$') AS arguments, address AS call_id, CAST(1 AS INTEGER) AS n_tokens, true AS reversed FROM t""")
def payload_tokens(spark, sf) -> DataFrame:
    """Each turn as a request with tool calls: addresses that a person or a tool wrote become tokens, in a list of blocks and in
    the JSON of a call's arguments; model names and ids stay; and all of it turns back."""
    address = F.concat(F.lit("c"), F.col("conv_id"), F.lit("."), F.col("role"), F.lit("@mail"), F.col("turn") % 3, F.lit(".example.com"))
    c = spread(read(spark, sf, "conversations").select("conv_id", "turn", "text", address.alias("a")))
    block = F.array(F.struct(F.lit("text").alias("type"), F.concat(F.lit("Dear "), "a", F.lit("\n"), "text").alias("text")))
    arguments = F.to_json(F.struct(F.col("a").alias("to"), F.array("a", F.lit("none")).alias("cc")))
    call = F.array(F.struct(F.col("a").alias("id"), F.struct(F.lit("send").alias("name"), arguments.alias("arguments")).alias("function")))
    none = F.lit(None)
    turns = F.array(F.struct(F.lit("user").alias("role"), block.alias("content"), none.cast(c.select(call).dtypes[0][1]).alias("tool_calls")), F.struct(F.lit("assistant").alias("role"), none.cast(c.select(block).dtypes[0][1]).alias("content"), call.alias("tool_calls")))
    made = c.select("conv_id", "turn", F.to_json(F.struct(F.concat(F.lit("m "), "a").alias("model"), turns.alias("messages"))).alias("payload"))
    done = R.tokenize_payload(made, "payload", KEY)
    of = lambda path: F.get_json_object("tokenized", path)
    return done.select("conv_id", "turn", of("$.model").alias("model"), F.md5(of("$.messages[0].content[0].text").cast("binary")).alias("content"), of("$.messages[1].tool_calls[0].function.arguments").alias("arguments"), of("$.messages[1].tool_calls[0].id").alias("call_id"), F.size("tokens").alias("n_tokens"), (R.detokenize_payload(F.col("tokenized"), F.col("tokens")) == F.col("payload")).alias("reversed"))


SURFACES = ["click", "view"]
DERIVED = hmac.new(KEY, attest.PURPOSE, hashlib.sha256).digest()


@query("commit_signatures", f""", c AS (SELECT id, actor, k, ts, 7 AS tenant, sha1('commit ' || id) AS sha, sha1('commit ' || (id + 1)) AS other FROM f WHERE surface = 'purchase'),
n AS (SELECT c.id, list_sort(list(g.id)) AS ids FROM c JOIN f g ON lower(g.actor) = c.actor AND g.surface IN ('click', 'view') AND g.ts >= date_trunc('second', c.ts) - INTERVAL 21 MINUTE AND g.ts <= date_trunc('second', c.ts) + INTERVAL 1 MINUTE GROUP BY 1)
SELECT sha, left({hmac_sql("'7:' || CASE WHEN k % 6 = 1 THEN other ELSE sha END", DERIVED)}, 24) AS token, k % 6 <> 1 AS valid, CAST(coalesce(len(ids), 0) AS INTEGER) AS findings, coalesce(array_to_string(ids, ','), '') AS finding_ids FROM c LEFT JOIN n USING (id)""", True)
def commit_signatures(spark, sf) -> DataFrame:
    """Purchases as commits of twenty minutes' work: their signatures, some of them another commit's, checked; and the findings
    of the actor in that time, a minute more on either side."""
    f = findings(spark, sf).withColumn("tenant", F.lit(7))
    seen = f.withColumnRenamed("ts", "last_seen")
    sha = lambda n: F.sha1(F.concat(F.lit("commit "), n.cast("string")).cast("binary"))
    commits = f.where("surface = 'purchase'").select("tenant", sha(F.col("id")).alias("sha"), sha(F.col("id") + 1).alias("other"), "k", F.upper("actor").alias("actor"), (F.col("ts").cast("timestamp") - F.expr("interval 20 minutes")).alias("window_start"), F.col("ts").cast("timestamp").alias("window_end"))
    notes = attest.attested(commits, seen, KEY, SURFACES)
    told = notes.withColumn("token", F.when(F.col("k") % 6 == 1, attest.signature(F.col("tenant"), F.col("other"), KEY)).otherwise(F.col("token")))
    return attest.verified(told, KEY).select("sha", "token", "valid", "findings", F.array_join("finding_ids", ",").alias("finding_ids"))
