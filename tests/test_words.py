"""Words learned from documents, and what they tell apart from keys."""

import base64
import random
import re

import pytest
from pyspark.sql import functions as F

from quillguard.functions import words as W
from quillguard.operators import detectors as D


@pytest.fixture(scope="module")
def learned(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = {}
    for r in docs.select("text").collect():
        for w in set(re.findall(r"[^\W\d_]{3,}", (r.text or "").lower())):
            seen[w] = seen.get(w, 0) + 1
    return {w for w, n in seen.items() if n >= 3}, {w for w, n in seen.items() if n < 3}, W.learned(docs, "text")


def test_a_sketch_forgets_no_word(spark, learned):
    common, rare, sketch = learned
    assert len(sketch) == 1 << W.BITS - 3 and len(common) > 200
    got = {r.w: r.k for r in spark.createDataFrame([(w,) for w in common | rare], "w string").select("w", W.known(F.col("w"), sketch).alias("k")).collect()}
    assert all(got[w] for w in common) and sum(got[w] for w in rare) <= 0.005 * len(rare) + 1


def greedy(token, words):
    body = re.sub("[^a-z]", "", token.lower())
    covered = i = 0
    while i < len(body):
        n = next((n for n in range(18, 2, -1) if i + n <= len(body) and body[i : i + n] in words), 0)
        covered, i = covered + n, i + (n or 1)
    return bool(body) and sum(c.isalpha() for c in token) >= 0.75 * len(token) and covered >= 0.8 * len(body)


def test_language_and_keys(spark, learned):
    common, _, sketch = learned
    rng = random.Random(3)
    plain = sorted(w for w in common if w.isascii() and 4 <= len(w) <= 9)
    some = lambda n: [rng.choice(plain) for _ in range(n)]
    key = lambda n: "".join(rng.choice("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghjkmnpqrstuvwxyz23456789") for _ in range(n))
    rows = [(kind, t) for _ in range(60) for kind, t in (
        ("camel", "".join(w.title() for w in some(5)) + "2"), ("run", "7" + "".join(some(6))), ("prose", base64.b64encode(" ".join(some(7)).encode()).decode().rstrip("=")), ("key", key(36)), ("odd", "".join(some(2)) + key(30)))]
    df = spark.createDataFrame([(i, k, t) for i, (k, t) in enumerate(rows)], "i int, kind string, t string").repartition(4)
    t = F.col("t")
    got = df.select("i", W.dictionary_identifier(t, sketch).alias("d"), W.word_run(t, sketch).alias("r"), W.encoded_prose(t, sketch).alias("e"), W.speaks(t, sketch).alias("s")).collect()
    for r in got:
        kind, token = rows[r.i]
        assert r.r == greedy(token, common), token
        assert not (kind in ("key", "odd") and r.s) or greedy(token, common), token
        assert kind != "camel" or r.d
        assert kind != "prose" or r.e
    names = {"Northwind_Cloudflare_Audit_20260930": True, "cf_audit_20261001_summary": True, "Acme_Q3_Forecast_Final_v2_20261001": True, "xkcd_brtz_2FA_qq": False, "aZ3kQ9xW7vB2nM5tR8yL1pD4": False, "a_b_c_1_2_3": False}
    named = spark.createDataFrame([(n,) for n in names], "t string").select("t", W.name_like(F.col("t")).alias("n")).collect()
    assert {r.t: r.n for r in named} == names


def test_keys_of_a_text(spark, learned):
    common, _, sketch = learned
    long = sorted((w for w in common if w.isascii()), key=len)[-6:]
    ident = "".join(w.title() for w in long)[:70] + "42"
    df = spark.createDataFrame([(f"call {ident} with aZ3kQ9xW7vB2nM5tR8yL1pD4",)], "t string")
    assert df.select(D.random_keys(F.col("t"), sketch)).first()[0] == ["aZ3kQ9xW7vB2nM5tR8yL1pD4"]


def test_code_that_speaks_of_a_business(spark):
    rows = [("import os\ndef customer_retention_score(enterpriseDiscountTable):\n",), ("import os\ndef get_item():\n",), ("customer_retention_score and enterpriseDiscountTable",)]
    df = spark.createDataFrame(rows, "t string")
    found = lambda **more: [[s.check for s in r.signals] for r in D.detect(df, "t", **more).collect()]
    assert found() == [[], [], []] and found(business=["get", "item", "os"]) == [["source_code"], [], []]
