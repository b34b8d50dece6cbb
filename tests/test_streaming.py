"""Streams drained over landed files give what the batch twins give."""

from pyspark.sql import functions as F

from quillguard.plans.base import findings
from quillguard.plans.registry import QUERIES
from quillguard.streaming import jobs


def landed(spark, sf_dir, tmp_path):
    path = str(tmp_path / "in")
    findings(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp")).coalesce(2).write.parquet(path)
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)


def drained(df, name, mode, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def test_per_minute(spark, sf_dir, tmp_path):
    got = drained(jobs.per_minute(landed(spark, sf_dir, tmp_path)), "minutes", "complete", tmp_path)
    want = QUERIES["per_minute_metering"](spark, sf_dir)
    assert got.count() == want.count() and got.agg(F.sum("n")).first()[0] == want.agg(F.sum("n")).first()[0]


def test_recurrences(spark, sf_dir, tmp_path):
    got = drained(jobs.recurrences(landed(spark, sf_dir, tmp_path)), "folded", "update", tmp_path)
    last = got.groupBy("fingerprint").agg(F.max("seen_count").alias("n"))
    want = QUERIES["recurrence_fold"](spark, sf_dir).select("fingerprint", "seen_count")
    assert last.join(want, "fingerprint").where("n = seen_count").count() == want.count()


def test_taints(spark, sf_dir, tmp_path):
    s = landed(spark, sf_dir, tmp_path)
    got = drained(jobs.tainted_actions(s.where("surface = 'purchase'"), s.where("surface = 'error'")), "taints", "append", tmp_path)
    want = QUERIES["taint_asof"](spark, sf_dir).where("taint is not null")
    assert got.select("action").distinct().count() == want.count()


def test_batches_are_merged_on_reading(spark, tmp_path):
    from quillguard.streaming import jobs

    write = jobs.batch_sink(["k"], str(tmp_path))
    for batch, rows in ((0, [(1, "a"), (1, "a"), (2, "b")]), (1, [(1, "c")]), (1, [(1, "c")])):
        write(spark.createDataFrame(rows, "k int, v string"), batch)
    assert {(r.k, r.v) for r in jobs.latest(spark.read.parquet(str(tmp_path)), ["k"]).collect()} == {(1, "c"), (2, "b")}


def test_chains(spark, sf_dir, tmp_path):
    risky = landed(spark, sf_dir, tmp_path).where("risk >= 15")
    got = drained(jobs.chains(risky), "chains", "append", tmp_path).groupBy("actor", "stages").agg(F.count("*").alias("seen"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"))
    want = QUERIES["chain_fold_by_signature"](spark, sf_dir).select("actor", "stages", "seen", F.col("first_at").cast("timestamp"), F.col("last_at").cast("timestamp"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_replies_in_chunks_of_any_size(spark, tmp_path):
    reply, tokens = "QG_Q QG_EMAIL_0a1b2c3d, QGQG_SSN_00000000 and QG_EMAIL_0a1b2c3", {"QG_EMAIL_0a1b2c3d": "a@x.test", "QG_SSN_00000000": "219-09-9998"}
    rows = []
    for size in (1, 2, 3, 7, 100):
        parts = [reply[i : i + size] for i in range(0, len(reply), size)]
        rows += [(f"r{size}", i, c, i == len(parts) - 1, tokens if i == 0 else None) for i, c in enumerate(parts)]
    schema = "reply string, seq int, chunk string, last boolean, tokens map<string,string>"
    for batch in (0, 1):  # a reply's chunks come in two batches; what is held stays in the state
        spark.createDataFrame([r for r in rows if (r[1] >= 9) == bool(batch)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "chunks"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "chunks"))
    got = drained(jobs.detokenized(stream), "whole", "append", tmp_path).collect()
    want = "QG_Q a@x.test, QG219-09-9998 and QG_EMAIL_0a1b2c3"
    for size in (1, 2, 3, 7, 100):
        assert "".join(r.text for r in sorted((r for r in got if r.reply == f"r{size}"), key=lambda r: r.seq)) == want, size
