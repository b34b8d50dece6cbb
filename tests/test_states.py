"""Timers, transitions, archives and claims of streams, and spans of time to read again, against their batch forms."""

import json
import random
import threading
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quillguard.operators import coverage as V
from quillguard.plans import lifecycles
from quillguard.plans.base import findings
from quillguard.plans.registry import QUERIES
from quillguard.streaming import states, writers

T0 = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def store(spark):
    before = spark.conf.get(states.ROCKS[0])
    states.with_store(spark)
    yield spark
    spark.conf.set(states.ROCKS[0], before)


class Stream:
    """Rows that arrive in batches, and what a job gives after each."""

    def __init__(self, spark, tmp_path, schema):
        self.spark, self.path, self.schema, self.n = spark, tmp_path, schema, 0
        (tmp_path / "in").mkdir(parents=True)
        self.rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    def land(self, rows):
        self.n += 1
        staged = self.path / f"staged{self.n}"
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.parquet(str(staged))
        next(staged.glob("part-*.parquet")).rename(self.path / "in" / f"{self.n:04d}.parquet")

    def drained(self, df):
        out = []
        q = df.writeStream.foreachBatch(lambda b, _: out.extend(b.collect())).outputMode("append").option("checkpointLocation", str(self.path / "check")).trigger(availableNow=True).start()
        q.awaitTermination()
        return out


def at(hours):
    return T0 + timedelta(hours=hours)


def test_a_silent_actor_goes_dark_once(store, tmp_path):
    s = Stream(store, tmp_path, "actor string, ts timestamp")
    job = lambda: states.silences(s.rows, ["actor"])
    s.land([("a", at(0)), ("b", at(0)), ("b", at(30))])
    assert s.drained(job()) == []
    s.land([("b", at(60))])
    assert s.drained(job()) == []
    seen = []
    for h in (90, 120, 150, 180):  # only b has input; a's timer fires by the watermark alone, once
        s.land([("b", at(h))])
        seen += s.drained(job())
    assert [tuple(r) for r in seen] == [("a", "dark", at(72), at(0))]
    s.land([("a", at(185)), ("b", at(186))])
    assert [tuple(r) for r in s.drained(job())] == [("a", "back", at(185), at(0))]
    s.land([("b", at(h)) for h in (200, 230, 260, 290)])
    s.land([("b", at(300))])
    assert [tuple(r) for r in s.drained(job())] == [("a", "dark", at(257), at(185))]


def test_silences_of_a_stream_are_the_batch_ones(store, sf_dir, tmp_path):
    f = findings(store, sf_dir).select("actor", "tool", F.col("ts").cast("timestamp").alias("ts"))
    last = f.agg(F.max("ts")).first()[0]
    s = Stream(store, tmp_path, "actor string, tool string, ts timestamp")
    half = T0 + timedelta(days=15)
    s.land([tuple(r) for r in f.where(F.col("ts") < F.lit(half)).collect()])
    s.land([tuple(r) for r in f.where(F.col("ts") >= F.lit(half)).collect()])
    s.land([("z", "z", last + timedelta(hours=3))])
    got = s.drained(states.silences(s.rows, ["actor", "tool"]))
    want = V.silences(f, ["actor", "tool"], "ts", 72, str(last)).collect()
    mark = last - timedelta(hours=1)  # what the watermark hasn't reached is not told yet
    told = {(r.actor, r.tool, r.at, r.last_seen) for r in got if r.event == "dark" and r.at < mark}
    assert len(told) > 20 and told == {(r.actor, r.tool, r.dark_at, r.last_seen) for r in want if r.dark_at < mark}
    assert {(r.actor, r.tool, r.at) for r in got if r.event == "back"} == {(r.actor, r.tool, r.back_at) for r in want if r.back_at}


def test_a_dismissed_finding_reopens_once(store, tmp_path):
    schema = "fingerprint string, id long, ts timestamp, severity string, surface string, status string"
    s = Stream(store, tmp_path, schema)
    job = lambda: states.transitions(s.rows.where("status is null"), s.rows.where("status is not null"), ["chat"])
    see = lambda n, h, severity="high", surface="chat", fp="x": (fp, n, at(h), severity, surface, None)
    review = lambda n, h, status, fp="x": (fp, n, at(h), None, None, status)
    told = lambda: [(r.fingerprint, r.id, r.event, r.seen_count) for r in s.drained(job())]
    s.land([see(1, 0), see(2, 1), review(90, 0, "dismissed", "never seen")])
    assert told() == [("x", 1, "new", 1)]
    s.land([review(91, 2, "dismissed")])
    assert told() == [("x", 91, "dismissed", 2)]
    s.land([see(3, 3, "low"), see(4, 4, "critical", "at_rest")])  # not serious, not live
    assert told() == []
    s.land([see(5, 5, "critical"), see(6, 6, "critical"), see(7, 6)])
    assert told() == [("x", 5, "reopened", 5)]
    s.land([see(8, 7)])
    assert told() == []
    s.land([review(92, 8, "dismissed"), see(9, 9), see(10, 10), see(11, 9, fp="y")])  # a second dismissal, a second edge
    assert sorted(told()) == [("x", 9, "reopened", 9), ("x", 92, "dismissed", 8), ("y", 11, "new", 1)]


def test_reopenings_of_a_stream_are_the_batch_ones(store, sf_dir, tmp_path):
    f, r = lifecycles.lived(findings(store, sf_dir))
    rows = f.withColumn("status", F.lit(None).cast("string")).unionByName(r.withColumns({"severity": F.lit(None).cast("string"), "surface": F.lit(None).cast("string")}))
    s = Stream(store, tmp_path, rows.schema)
    ordered = [tuple(x) for x in rows.orderBy("ts").collect()]
    for part in (ordered[: len(ordered) // 3], ordered[len(ordered) // 3 :]):
        s.land(part)
    got = s.drained(states.transitions(s.rows.where("status is null"), s.rows.where("status is not null"), lifecycles.LIVE))
    want = QUERIES["finding_reopenings"](store, sf_dir).collect()
    assert {(x.fingerprint, x.id, x.event, x.seen_count) for x in got if x.event in ("new", "reopened")} == {tuple(x) for x in want} and any(x.event == "reopened" for x in want)


def test_archive_by_size_and_age(store, tmp_path):
    s = Stream(store, tmp_path, "tenant string, ts timestamp, line string")
    target = f"file://{tmp_path}/archive"
    line = lambda i: json.dumps({"i": i, "x": "é" * (i % 30)}, ensure_ascii=False)
    sent = [("t", T0 + timedelta(milliseconds=300 * i), line(i)) for i in range(400)] + [("u", T0 + timedelta(seconds=i), line(1000 + i)) for i in range(30)] + [("u", T0, "z" * 3000)]
    for part in (sent[:150], sent[150:]):
        s.land(sorted(part, key=lambda r: r[1]))
    s.land([("v", at(30), "late")])  # moves the watermark: what is held gets old
    sink = writers.archive_sink(target)
    written = []

    def twice(parts, batch):  # a batch that is run again writes nothing anew
        parts.persist()
        sink(parts, batch)
        sink(parts, batch)
        written.append(parts.collect())
        parts.unpersist()

    q = states.archive_parts(s.rows, 1, 1000, 5, 1 << 20, "1 second").writeStream.foreachBatch(twice).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = writers.archived(store, target).collect()
    lines = sorted((r.tenant, x) for r in got for x in r.body.splitlines())
    assert lines == sorted((t, x) for t, _, x in sent)
    assert len({(r.tenant, r.part) for r in got}) == len(got) == sum(map(len, written))
    times = {x: t for _, t, x in sent}
    for r in got:
        own = [x for x in r.body.splitlines()]
        assert r.n_lines == len(own) and r.n_bytes == len(r.body.encode()) and (r.n_bytes <= 1000 or r.n_lines == 1)
        assert r.hour == T0 and (max(times[x] for x in own) - min(times[x] for x in own)).total_seconds() < 5


def test_a_day_s_budget_is_carried_over_batches(store, tmp_path):
    s = Stream(store, tmp_path, "tenant string, ts timestamp, line string")
    for day in (0, 1):
        for batch in range(3):
            s.land([("t", at(24 * day + batch) + timedelta(seconds=i), "x" * 99) for i in range(10)])
    s.land([("t", at(72), "x")])
    got = s.drained(states.archive_parts(s.rows, 1, 250, 5, 1500, "1 second"))
    assert sum(r.n_lines for r in got if r.hour < at(60)) == 2 * 15
    assert sum(r.n_dropped for r in got) >= 15  # the second day's, told with the first part of the third


def test_one_of_many_writers_claims_a_digest(spark, sf_dir, tmp_path):
    folder = f"file://{tmp_path}/claims"
    wins, sent = [], []
    start = threading.Barrier(8)

    def ask(owner):
        start.wait()
        for window in range(20):
            if writers.claim(spark, folder, "hourly", f"2024-01-01 {window:02d}:00:00", owner):
                wins.append((window, owner))

    threads = [threading.Thread(target=ask, args=(f"w{i}",)) for i in range(8)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(w for w, _ in wins) == list(range(20))
    due = writers.digests_due(findings(spark, sf_dir), "daily", "2024-01-10 05:00:00")
    assert due.count() == 9
    counts = [writers.send_digests(due, folder, "daily", owner, lambda row: sent.append(row["window"])) for owner in ("a", "b")]
    assert counts == [9, 0] and len(set(sent)) == 9


def test_spans_to_read_again(spark):
    rng = random.Random(9)
    spans = [(rng.choice("ab"), (s := rng.randrange(0, 400_000)), s + rng.choice((-5, 0, 1, 300, 9_000, 200_000))) for _ in range(60)] + [("c", 10, None)]
    keys = spark.createDataFrame([("a",), ("b",), ("c",), ("a",)], "k string")
    since, until, budget = 5_000, 390_000, 30_000
    have = {k: set() for k in "abc"}
    for k, s, e in spans:
        have[k].update(range(s, e or 0))
    df = spark.createDataFrame(spans, "k string, start long, end long")
    union = V.covered(df, ["k"])
    rows = union.collect()
    for k in "abc":
        mine = sorted((r.start, r.end) for r in rows if r.k == k)
        assert {x for s, e in mine for x in range(s, e)} == have[k] and all(a[1] < b[0] for a, b in zip(mine, mine[1:]))
    missing = V.gaps(union, keys, ["k"], since, until)
    plan = V.backfill_plan(missing, ["k"], budget)
    left, planned = missing.collect(), plan.collect()
    for k in "abc":
        free = sorted(set(range(since, until)) - have[k])
        assert sorted(x for r in left if r.k == k for x in range(r.start, r.end)) == free
        assert sorted(x for r in planned if r.k == k for x in range(r.start, r.end)) == free[-budget:]
    source = spark.createDataFrame([(rng.choice("abc"), i, datetime(1970, 1, 1) + timedelta(seconds=rng.randrange(400_000))) for i in range(500)], "k string, i int, ts timestamp")
    want = {r.i for r in source.collect() if int((r.ts - datetime(1970, 1, 1)).total_seconds()) in {x for p in planned if p.k == r.k for x in range(p.start, p.end)}}
    got = V.reread(source, plan, ["k"], "ts")
    assert got.columns == source.columns and sorted(r.i for r in got.collect()) == sorted(want)
    after = V.covered(df.unionByName(plan), ["k"])
    assert V.gaps(after, keys, ["k"], since, until).agg(F.sum(F.col("end") - F.col("start"))).first()[0] == sum(max(0, len(set(range(since, until)) - have[k]) - budget) for k in "abc")
