"""Exact splits, the gate of a classifier and its fallback; patterns inferred from examples of several shapes."""

import random
import re
from collections import Counter, defaultdict
from datetime import datetime, timedelta
from hashlib import md5

from pyspark.sql import functions as F

from quillguard.functions import scoring as S
from quillguard.functions.text import inferred_pattern
from quillguard.operators import gates


def test_exact_quotas_of_strata(spark):
    rng = random.Random(1)
    rows = [(i // 3, rng.choice("ab"), rng.choice(("x", None, "y")) if i % 50 else "rare", i) for i in range(900)] + [(None, "a", "x", 900)]
    df = spark.createDataFrame(rows, "key long, label string, source string, n long").withColumn("held_", F.lit(1)).repartition(5)
    got = gates.stratified(df, ["label", "source"], "key", 0.3).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r.label, r.source].append(((md5(("" if r.key is None else str(r.key)).encode()).hexdigest(), r.key is not None, r.key or 0), r.held))
    for stratum in by.values():
        quota = len(stratum) * 3 // 10
        assert sum(h for _, h in stratum) == quota
        assert Counter(k for k, h in stratum if h) == Counter(k for k, _ in sorted(stratum)[:quota])  # rows of one key are alike


def test_the_latest_share_of_dated_rows(spark):
    rng = random.Random(2)
    t0 = datetime(2024, 1, 1)
    rows = [(i, t0 + timedelta(minutes=rng.randrange(5000)) if i % 7 else None) for i in range(500)]
    df = spark.createDataFrame(rows, "key long, ts timestamp").repartition(3)
    got = gates.latest(df, "ts", "key", 0.25).collect()
    dated = sorted(((t, k) for k, t in rows if t), reverse=True)
    assert len(got) == 500 and {r.key for r in got if r.held} == {k for _, k in dated[: len(dated) // 4]}
    assert gates.latest(df.limit(0), "ts", "key").count() == 0
    assert gates.latest(df.where("key = 1"), "ts", "key").first().held


def test_the_gate(spark):
    row = lambda t, m, r, s=False: (t, m, r, s)
    good = [row(True, True, True)] * 5 + [row(True, True, False)] * 5 + [row(False, False, False)] * 99 + [row(False, True, False)]
    cases = {"passes": good, "fails": good + [row(False, True, False)] * 9, "not evaluable": good + [row(True, True, True, True)]}
    for want, rows in [*cases.items(), ("not evaluable", []), ("fails", [row(True, True, True)] * 3)]:
        df = spark.createDataFrame(rows, "t boolean, m boolean, r boolean, s boolean")
        got = gates.judged(df, F.col("t"), F.col("m"), F.col("r"), F.col("s")).first()
        assert got.verdict == want and got.n == len(rows)
        if rows is good:
            assert (got.f1, got.rule_f1, got.fp_rate) == (0.9524, 0.6667, 0.01)


def test_the_fallback_speaks_where_markers_are_silent(spark):
    marker = S.signals((F.col("m"), S.signal("confidential_data", 0.6, 0.65, "marker")))
    df = spark.createDataFrame([(1, True, 0.99), (2, False, 0.99), (3, False, 0.8), (4, False, 0.79), (5, False, None)], "i int, m boolean, p double").withColumn("signals", marker)
    found = {r.i: [(s.check, round(s.confidence, 4)) for s in r.signals] for r in gates.admitted("passes", df).collect()}
    assert found == {1: [("marker", 0.65)], 2: [("confidential_ml", 0.6)], 3: [("confidential_ml", 0.52)], 4: [], 5: []}
    assert [len(r.signals) for r in gates.admitted("fails", df).orderBy("i").collect()] == [1, 0, 0, 0, 0]
    assert S.verdict(gates.fallback(df)).where("i = 2").first().risk_score == 30


def test_patterns_of_several_shapes():
    cases = [
        (["AB-123", "AB-123-X", "AB-77"], [], r"^AB\-[0-9]{2,3}(?:\-)?(?:[A-Z]{1})?$"), (["K12", "K1234"], ["K123"], r"^K(?:[0-9]{2}|[0-9]{4})$"), (["ID:12-a", "ID:ab-a"], [], r"^ID:(?:[0-9]{2}|[a-z]{2})\-a$"),
        (["2024-01-02", "2025-11-30"], ["2024/01/02"], r"^[0-9]{4}\-[0-9]{2}\-[0-9]{2}$"), (["a-1", "b.2"], [], None), (["x"], [], "^[a-z]{1}$"), (["K12", "K34"], ["K56"], None),
    ]
    for examples, against, want in cases:
        got = inferred_pattern(examples, against)
        if want is None:
            assert got is None, (examples, got)
            continue
        assert all(re.match(got, e) for e in examples) and not any(re.match(got, x) for x in against)
        assert not re.match(got, "something else entirely")
        assert got == want, (got, want)
