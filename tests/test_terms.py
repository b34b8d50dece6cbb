"""Hashed terms against Spark's HashingTF of the terms as they are spelt."""

from pyspark.ml.feature import HashingTF
from pyspark.sql import functions as F

from quillguard.operators import ml


def spelt(words):
    return [*words, *(f"2_{a}_{b}" for a, b in zip(words, words[1:])), *(f"2_{w}" for w in words[-1:]), *(f"3_{w[i : i + 3]}" for w in words for i in range(max(1, len(w) - 2)))]


TEXTS = {
    "The cat, the CAT and the the cat": "the cat the cat and the the cat", "": "", " .,; ": "", "a": "a", "ab ab": "ab ab", "Ünïcode žluťoučký 漢字仮名交じり文 𝒳𝒴𝒵𝒳 ٣٤٥": "ünïcode žluťoučký 漢字仮名交じり文 𝒳𝒴𝒵𝒳 ٣٤٥",
    "x" * 3001 + " é" + "y1z2" * 700: "x" * 3001 + " é" + "y1z2" * 700, "one two\nthree_four": "one two three four",
}


def test_terms_equal_hashing_tf(spark):
    rows = [(i, t, spelt(w.split())) for i, (t, w) in enumerate(TEXTS.items())] + [(99, None, [])]
    df = spark.createDataFrame(rows, "k int, t string, s array<string>").coalesce(1)
    got = HashingTF(inputCol="s", outputCol="want", numFeatures=1 << ml.BITS).transform(df).select("k", "want", ml.terms(F.col("t")).alias("terms")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.terms == r.want, r.k


def test_terms_are_counted_in_slices(monkeypatch):
    import pyarrow as pa

    texts = pa.array(["a b c", "", "dd ee" * 40, "é", "last one"])
    whole = ml.counted(texts)
    monkeypatch.setattr(ml, "SLICE", 7)
    assert ml.term_counts.func(texts).to_pylist() == whole.to_pylist()


def test_terms_are_never_arrays_of_strings(spark):
    plan = spark.createDataFrame([("a b",)], "t string").select(ml.terms(F.col("t")).alias("terms"))
    assert plan.schema["terms"].dataType.typeName() == "vectorudt"
    assert "zip_with" not in plan._jdf.queryExecution().optimizedPlan().toString()


def test_markers_stand_behind_their_stems(spark):
    from quillguard.operators import detectors as D

    texts = ["Strictly confidential", "internal use only", "do NOT distribute", "Not for distribution", "attorney client privileged", "PROPRIETARY", "labelled as restricted", "trade secret: x", "TLP RED", "Sensitivity = internal", "[secret]", "MIP label", "Purview Label", "ATTORNEY-CLIENT", "tlp", "a secret", "", None, "nothing"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", D.marked(F.col("t")).alias("a"), F.col("t").rlike(D.MARKERS).alias("b"))
    got = df.collect()
    assert [r.a for r in got] == [r.b for r in got] and sum(bool(r.a) for r in got) == 14


def test_fallback_joins_its_labels_once(spark, tmp_path, monkeypatch):
    """Texts meet their labels in one join, whose rows are gone when the result is there."""
    from pyspark.sql.classic.dataframe import DataFrame

    from quillguard.plans import registry

    spark.createDataFrame([(i, ("bad words here " if i % 3 else "plain good prose ") * 3 + str(i) if i % 7 else None) for i in range(120)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(100)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = []
    monkeypatch.setattr(DataFrame, "persist", lambda self, *a, _old=DataFrame.persist: kept.append(_old(self, *a)) or kept[-1])
    got = registry.QUERIES["confidential_fallback"](spark, str(tmp_path)).collect()
    assert sum(r.documents for r in got) == 120
    assert [k.columns for k in kept] == [["label", "held", "text"]] and not kept[0].is_cached
