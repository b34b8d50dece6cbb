"""Exports read back whole and in order, remedies, replies that repeat documents, inventories, corpora that come in."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quillguard.functions import scoring as S
from quillguard.operators import remedies as R
from quillguard.sources import handover as H

T0 = datetime(2024, 1, 1)


def test_the_trail_is_written_in_order(spark, tmp_path):
    rows = [(i, T0 + timedelta(minutes=(i * 7919) % 500), "ann" if i % 9 else "", "chat", "s|x" if i % 2 else "", "ch", ["secret_leak", "jailbreak"], "high", None if i % 3 else 5, None) for i in range(300)]
    f = spark.createDataFrame(rows, "id long, last_seen timestamp, actor string, surface string, subject string, channel string, categories array<string>, severity string, risk_score int, seen_count int").repartition(6)
    events = H.normalised(f, F.lit("v"), "o")
    mark = H.write_trail(events, str(tmp_path / "trail"), parts=5)
    lines = [json.loads(x) for p in sorted((tmp_path / "trail").glob("part-*")) for x in p.read_text().splitlines()]
    assert len(lines) == sum(bool(r[2]) for r in rows) and [(x["ts"], x["finding_id"]) for x in lines] == sorted((x["ts"], x["finding_id"]) for x in lines)
    assert lines[0]["stages"] == ["collection", "injection"] and {x["action"] for x in lines} == {"s|x", "ch"} and {x["risk_score"] for x in lines} == {0, 5}
    again = H.since(events, mark)
    assert again.count() >= 1 and again.agg(F.min("ts").cast("string")).first()[0] == mark
    assert "s\\|x" in events.where("line like '%s|x%'").first().cef
    assert H.write_trail(events.limit(0), str(tmp_path / "none")) is None


def test_tenants_are_exported_whole(spark, tmp_path):
    users = spark.createDataFrame([(i % 3, f"u{i}", "hash", f"wrote {i}") for i in range(20)] + [(None, "nobody", "h", "x")], "t long, name string, password string, note string")
    docs = H.tenant_documents({"users": (users, "t", ["password"]), "rules": (spark.range(5).selectExpr("id % 2 as t", "id as rule"), "t", [])}, {"users": ["note"]})
    assert not docs.where("doc like '%hash%' or doc like '%wrote%' or doc like '%nobody%'").count()
    manifest = {r.tenant: (r.counts, r.bytes) for r in H.tenant_manifest(docs).collect()}
    assert manifest["0"][0] == {"users": 7, "rules": 3} and manifest["2"][0] == {"users": 6}
    assert {r.tenant: (r.counts, r.bytes) for r in H.write_tenants(docs, str(tmp_path / "all")).collect()} == manifest
    assert H.tenant_documents({"users": (users, "t", ["password"])}, {"users": ["note"]}, True).where("doc like '%wrote%'").count() == 20


def test_remedies(spark):
    one = lambda category, check="x", evidence="": S.signal(category, 0.5, 0.5, check, evidence=F.lit(evidence))
    cases = [([], []), ([one("secret_leak", evidence="github_token, aws_access_key")], [0, 1]), ([one("secret_leak", evidence="jwt")], [3]), ([one("ci_risk", "write_all"), one("ci_risk", "foreign_checkout")], [16, 18]), ([one("ci_risk", "ai_step")], [21]), ([one("pii_leak"), one("pii_leak"), one("jailbreak")], [4, 8])]
    for found, want in cases:
        signals = F.array(*found) if found else F.expr(f"cast(array() as array<{S.SIGNAL}>)")
        assert spark.range(1).select(R.remedies(signals).alias("r")).first().r == [R.STEPS[i][2] for i in want]


def test_replies_that_repeat_documents(spark):
    rows = [(1, 10, None), (2, 10, ("Plan", 0.7, False)), (3, 10, ("Plan", 0.7, True)), (4, 97, (None, 0.9, False))]
    df = spark.createDataFrame(rows, "i int, risk_score int, origin struct<title:string,containment:double,sensitive:boolean>").withColumns({"severity": F.lit("benign"), "recommended_action": F.lit("allow"), "signals": F.array(S.signal("jailbreak", 0.1, 0.1, "jailbreak"))})
    got = [(r.risk_score, r.severity, r.recommended_action, [(s.category, s.check, s.evidence) for s in r.signals][0]) for r in R.regurgitated(df).orderBy("i").collect()]
    assert got == [(10, "benign", "allow", ("jailbreak", "jailbreak", "")), (65, "high", "quarantine", ("oversharing", "model_regurgitation", "Plan")), (85, "critical", "block", ("confidential_data", "model_regurgitation", "Plan")), (97, "critical", "block", ("oversharing", "model_regurgitation", "a scanned document"))]


def test_a_report_replaces_the_list(spark):
    day = lambda n: T0 + timedelta(days=n)
    rows = [("d", day(0), "A", 1), ("d", day(0), "b", 1), ("d", day(1), "a ", 2), ("d", day(2), "a", 3), ("d", day(2), "B", 9), ("d", day(2), "b", 8), ("gone", day(0), "x", 1), ("gone", day(1), None, None), ("new", day(3), "x", 1)]
    df = spark.createDataFrame(rows, "device string, at timestamp, ext string, version int")
    got = sorted(tuple(r) for r in R.latest_inventory(df, ["device"], "at", "ext", ["version"]).collect())
    assert got == [("d", "a", 3, day(0), day(2)), ("d", "b", 9, day(2), day(2)), ("new", "x", 1, day(3), day(3))]


def test_public_corpora(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('\n{"prompt": "one", "label": 1, "when": "2024"}\n{"prompt": " ", "label": "no"}\n{"prompt": "two", "label": "maybe"}\n{"prompt": "three", "label": "Benign"}\n')
    (tmp_path / "b.csv").write_text('text,is_injection\n"a ""q"", b\nsecond line",TRUE\nplain,0\n,1\n')
    rows = lambda df: [(r.content, r.label, r.ts, r.kept) for r in df.collect()]
    assert rows(H.public_corpus(spark, str(tmp_path / "a.jsonl"), ts_field="when")) == [("one", "malicious", "2024", True), ("", "benign", None, False), ("two", None, None, False), ("three", "benign", None, True)]
    got = H.public_corpus(spark, str(tmp_path / "b.csv"))
    assert rows(got) == [('a "q", b\nsecond line', "malicious", None, True), ("plain", "benign", None, True), ("", "malicious", None, False)]
    assert got.first().source == "b.csv" and H.public_corpus(spark, str(tmp_path / "b.csv"), source="s").first().source == "s"
    with pytest.raises(ValueError, match="is_injection, text"):
        H.public_corpus(spark, str(tmp_path / "b.csv"), label_field="none")
