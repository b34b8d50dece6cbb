"""Prompts in SQL, text of pages, and the linear classifier."""

from pyspark.sql import functions as F

from quillguard.operators import ml
from quillguard.sources import warehouse as W


def test_prompts(spark):
    sql = "select AI_COMPLETE('m', 'it''s a (long) prompt', 3), x from t; select SUMMARIZE(body) from t"
    got = spark.createDataFrame([(sql,), ("select 1",), (None,)], "q string").select(W.sql_prompts(F.col("q")).alias("p")).collect()
    assert [(c.prompt, c.column_bound) for c in got[0].p] == [("it's a (long) prompt", False), (None, True)]
    assert got[1].p == [] and got[2].p is None


def test_page_text(spark):
    html = "<html><head><style>p{}</style><script>x('</p>')</script></head><body><!-- no --><p>Hello &amp; <b>you</b></p><div>two</div></body></html>"
    assert spark.createDataFrame([(html,)], "h string").select(W.page_text(F.col("h")).alias("t")).first().t == "Hello & you\ntwo"


def test_linear_classifier(spark):
    rows = spark.range(400).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("double").alias("label"), F.when(F.col("id") % 2 == 1, F.concat(F.lit("bad stuff "), F.col("id"))).otherwise(F.concat(F.lit("good thing "), F.col("id"))).alias("text"))
    terms = rows.withColumn("terms", ml.terms(F.col("text")))
    model = ml.train(terms.where("doc_id < 300"))
    best = ml.confusion(ml.probability(model, terms.where("doc_id >= 300")), [0.5]).first()
    assert (best.tp, best.fp, best.fn, best.tn) == (50, 0, 0, 50)
    far = spark.createDataFrame([(1, "good thing " * 60 + "bad stuff " * 30), (2, "good thing " * 60)], "k int, t string")
    p = {r.k: r.p for r in ml.worst_window(model, far, "k", "t").collect()}
    assert p[1] > 0.8 > 0.5 > p[2]


def test_objects(spark, tmp_path):
    from quillguard.plans.scans import packed
    from quillguard.sources import files

    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.docx").write_bytes(packed({"word/document.xml": "<d><p><t>one</t></p><p><t>two</t></p></d>"}))
    (tmp_path / "b.txt").write_bytes(b"plain")
    (tmp_path / "big.txt").write_bytes(b"x" * 200_000)
    (tmp_path / "none.txt").write_bytes(b"")
    got = {r.path.rpartition("/")[2]: (r.text, r.how, r.partial) for r in files.objects(spark, str(tmp_path), most_bytes=100_000).collect()}
    assert got == {"a.docx": ("one\ntwo", "document", False), "b.txt": ("plain", "text", False), "big.txt": ("", "", True)}  # Spark reads no splits of empty files


def test_long_texts_are_read_whole(spark):
    from quillguard.sources import files

    assert files.text_of("a.txt", b"word " * 400_000)[0] == "word " * 400_000
    assert files.text_of("a.rtf", b"{\\rtf1 " + b"word " * 200_000 + b"}")[0].count("word") == 200_000
    assert files.text_of("a.docx", None) == ("", "", False)


def test_evidence_pack(spark, tmp_path):
    from quillguard.sources.exports import evidence_pack

    rows = spark.range(10).withColumn("v", F.col("id") % 3)
    one = {r.report: (r.rows, r.digest) for r in evidence_pack({"a": rows, "none": rows.limit(0)}, str(tmp_path / "x")).collect()}
    two = {r.report: (r.rows, r.digest) for r in evidence_pack({"a": rows.orderBy(F.desc("id")), "none": rows.limit(0)}, str(tmp_path / "y")).collect()}
    assert one == two and one["a"][0] == 10 and one["none"] == (0, "0")
    assert spark.read.json(str(tmp_path / "x" / "a")).count() == 10
