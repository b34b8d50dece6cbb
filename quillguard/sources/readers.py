"""Landed files and payloads as rows: corpora, scanner output, telemetry, streamed replies, warehouse history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EXAMPLE = "id string, surface string, label string, content string, subject string, sender string, destination string, expect_categories array<string>, note string"
LABELS = ("benign", "malicious")


def corpus(spark: SparkSession, path: str) -> DataFrame:
    """A labelled corpus: one JSON object a line; blank lines and those that start with # don't count."""
    lines = spark.read.text(path).where("trim(value) <> '' and not startswith(ltrim(value), '#')")
    return lines.select(F.from_json("value", EXAMPLE).alias("x")).select("x.*")


def corpus_errors(rows: DataFrame) -> DataFrame:
    """Ids that occur twice, and labels that aren't known."""
    twice = rows.groupBy("id").count().where("count > 1").select("id", F.lit("duplicate id").alias("problem"))
    return twice.unionByName(rows.where(~F.coalesce(F.col("label").isin(*LABELS), F.lit(False))).select("id", F.lit("bad label").alias("problem")))


def first_column(df: DataFrame, candidates: list[str]) -> Column:
    """The first of some columns that a table has and that isn't null."""
    return F.coalesce(*(F.col(c) for c in candidates if c in df.columns), F.lit(None).cast("string"))


def json_or_lines(df: DataFrame, column: str, item: str) -> DataFrame:
    """Items of payloads that are a JSON array, an object, or JSON lines."""
    text = F.trim(column)
    array = F.from_json(text, f"array<{item}>")
    lines = F.transform(F.filter(F.split(text, "\n"), lambda l: F.trim(l) != ""), lambda l: F.from_json(l, item))
    items = F.when(text.startswith("["), array).otherwise(lines)
    return df.select(*[c for c in df.columns if c != column], F.explode(items).alias("item"))


#: Scanner -> schema of an item, and how it maps on path, secret_types, masked, line, verified.
SCANNERS = {
    "gitleaks": ("struct<File:string,RuleID:string,Secret:string,StartLine:int>", {"path": "item.File", "type": "item.RuleID", "secret": "item.Secret", "line": "item.StartLine", "verified": "false"}),
    "trufflehog": ("struct<DetectorName:string,Raw:string,Verified:boolean,SourceMetadata:struct<Data:struct<Filesystem:struct<file:string,line:int>>>>", {"path": "item.SourceMetadata.Data.Filesystem.file", "type": "item.DetectorName", "secret": "item.Raw", "line": "item.SourceMetadata.Data.Filesystem.line", "verified": "coalesce(item.Verified, false)"}),
}


def scanner(df: DataFrame, column: str, tool: str) -> DataFrame:
    """Third-party scanner output in one shape; secrets are masked on the way in."""
    from quillguard.functions.columns import mask

    item, at = SCANNERS[tool]
    rows = json_or_lines(df.select(column), column, item)
    return rows.select(F.expr(at["path"]).alias("path"), F.array(F.lower(F.expr(at["type"]))).alias("secret_types"), mask(F.expr(at["secret"])).alias("masked"), F.expr(at["line"]).alias("line"), F.expr(at["verified"]).alias("verified"), F.lit(tool).alias("source"))


OTLP = "struct<resourceLogs:array<struct<resource:struct<attributes:array<struct<key:string,value:struct<stringValue:string,intValue:string>>>>,scopeLogs:array<struct<scope:struct<name:string>,logRecords:array<struct<timeUnixNano:string,body:struct<stringValue:string>,attributes:array<struct<key:string,value:struct<stringValue:string,intValue:string>>>>>>>>>>"


def otlp_logs(df: DataFrame, column: str, scope: str | None = None) -> DataFrame:
    """OTLP log exports: resource, scope and record levels exploded, attributes as maps."""
    attributes = lambda a: F.map_from_entries(F.transform(a, lambda x: F.struct(x["key"], F.coalesce(x["value"]["stringValue"], x["value"]["intValue"]))))
    r = df.select(F.explode(F.from_json(column, OTLP)["resourceLogs"]).alias("r")).select(attributes(F.col("r.resource.attributes")).alias("resource"), F.explode("r.scopeLogs").alias("s"))
    logs = r.select("resource", F.col("s.scope.name").alias("scope"), F.explode("s.logRecords").alias("l"))
    logs = logs if scope is None else logs.where(F.col("scope") == scope)
    return logs.select("resource", "scope", F.timestamp_micros((F.col("l.timeUnixNano").cast("decimal(20,0)") / 1000).cast("long")).alias("ts"), F.col("l.body.stringValue").alias("body"), attributes(F.col("l.attributes")).alias("attributes"))


def sse_text(body: Column) -> Column:
    """The reply that server-sent events spell out, piece by piece, whichever of the two public shapes they have."""
    data = F.filter(F.transform(F.split(body, r"\r?\n"), lambda l: F.when(l.startswith("data:"), F.trim(F.substring(l, 6, 1_000_000)))), lambda d: d.isNotNull() & (d != "[DONE]"))
    piece = lambda d: F.coalesce(F.get_json_object(d, "$.choices[0].delta.content"), F.get_json_object(d, "$.delta.text"), F.lit(""))
    return F.array_join(F.transform(data, piece), "")


def last_user_prompt(request: Column) -> Column:
    """The prompt of an inference request: the last user turn, else its prompt field."""
    turns = F.from_json(request, "struct<messages:array<struct<role:string,content:string>>,prompt:string>")
    user = F.filter(turns["messages"], lambda m: m["role"] == "user")
    return F.coalesce(F.try_element_at(user, F.lit(-1))["content"], turns["prompt"])


def inference_prompt(request: Column, most: int = 60) -> Column:
    """The prompt of an inference request of any shape: chat, completion, else its inputs' strings, else all of its strings (so
    many at most, the limit being the feature); a request that isn't JSON is its own prompt."""
    from quillguard.functions.text import json_strings

    chat = F.from_json(request, "struct<messages:array<struct<role:string,content:string>>,prompt:string,inputs:string,dataframe_records:string,instances:string,input:string>")
    users = F.filter(chat["messages"], lambda m: (m["role"] == "user") & (F.trim(m["content"]) != ""))
    text_of = lambda c: F.when(c.rlike(r"^\s*\["), json_strings(F.regexp_replace(c, r'"type"\s*:\s*"[a-z_]+"', '"type":""'))).otherwise(c)
    harvest = lambda c: F.nullif(F.array_join(F.slice(F.filter(F.split(json_strings(c), "\n"), lambda s: F.trim(s) != ""), 1, most), "\n"), F.lit(""))
    part = F.coalesce(*(F.when(chat[k].rlike(r"^\s*[\[{]"), harvest(chat[k])).otherwise(F.nullif(chat[k], F.lit(""))) for k in ("inputs", "dataframe_records", "instances", "input")))
    found = F.coalesce(text_of(F.try_element_at(users, F.lit(-1))["content"]), F.when(F.trim(chat["prompt"]) != "", text_of(chat["prompt"])), part, harvest(request))
    return F.when(F.trim(request).startswith("{"), F.coalesce(found, F.lit(""))).otherwise(F.trim(request))


def since(df: DataFrame, ts: str, watermark, patterns: list[str] = [], text: str = "query_text") -> DataFrame:  # noqa: B006
    """An incremental poll: rows after the watermark whose text is like any of some patterns; both reach the scan."""
    rows = df.where(F.col(ts) > F.lit(watermark))
    for_any = None
    for p in patterns:
        for_any = F.col(text).ilike(p) if for_any is None else for_any | F.col(text).ilike(p)
    return rows if for_any is None else rows.where(for_any)


def column_samples(df: DataFrame, share: float = 1.0, seed: int = 7) -> DataFrame:
    """(column, value) of a table's text columns, of a sample of rows, to look for stored credentials."""
    texts = [f.name for f in df.schema if f.dataType.simpleString() == "string"]
    rows = df.select(*texts) if share >= 1 else df.select(*texts).sample(share, seed)
    return rows.unpivot([], texts, "column", "value").where("value is not null")


def mcp_servers(df: DataFrame, column: str, key: list[str] = []) -> DataFrame:  # noqa: B006
    """Servers of agent configurations, with the key of the configuration's row."""
    servers = F.from_json(column, "struct<mcpServers:map<string,struct<command:string,args:array<string>,url:string>>>")["mcpServers"]
    return df.select(*key, F.explode(servers).alias("server", "x")).select(*key, "server", "x.command", "x.args", "x.url", F.when(F.col("x.url").isNotNull(), "remote").otherwise("local").alias("transport"))


def dependencies(df: DataFrame, column: str) -> DataFrame:
    """Dependencies of package manifests, with install scripts flagged."""
    x = F.from_json(column, "struct<dependencies:map<string,string>,devDependencies:map<string,string>,scripts:map<string,string>>")
    none = F.expr("cast(map() as map<string,string>)")
    deps, dev = F.coalesce(x["dependencies"], none), F.coalesce(x["devDependencies"], none)
    both = F.map_concat(F.map_filter(dev, lambda k, v: ~F.map_contains_key(deps, k)), deps)
    script = F.exists(F.coalesce(F.map_keys(x["scripts"]), F.expr("cast(array() as array<string>)")), lambda k: k.isin("preinstall", "install", "postinstall"))
    return df.select(script.alias("install_script"), F.explode(both).alias("name", "version"))
