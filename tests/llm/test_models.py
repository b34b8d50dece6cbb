"""Trained and similarity operators: held-out accuracy, exact counts, brute-force classes, the pipeline."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillguard.llm import lm_scoring, near_dedup, quality

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_quality(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    edge = spark.createDataFrame([(-1, None), (-2, ""), (-3, "x " * 50_000)], "doc_id long, text string")
    got = quality.score_quality(docs.select("doc_id", "text").union(edge).union(edge), ["doc_id"], docs, labels).toPandas()
    assert got.score.between(0, 1).all() and len(got) == docs.count() + 6 and (got.predicted == (got.score >= 0.3)).all()
    assert (got[got.doc_id < 0].groupby("doc_id").score.nunique() == 1).all()
    j = got.merge(labels.toPandas(), on="doc_id")
    held = j[[zlib.crc32(str(i).encode()) % 5 == 0 for i in j.doc_id]]
    assert (held.predicted == held.quality).mean() > 0.9 and held[held.quality == 1].predicted.mean() > 0.95


def test_quality_without_labels(spark):
    df = spark.createDataFrame([(1, "a b"), (None, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in quality.score_quality(df, ["doc_id"], df, none).collect()] == [0.5, 0.5]
    assert quality.score_quality(df.limit(0), ["doc_id"], df, none).count() == 0


def tokens(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low) + ["\n"]


def test_language_model(spark, docs):
    """Every order's counts, the cells of the deleted fold (whose tokens leave every denominator too), and the mixtures."""
    edge = spark.createDataFrame([(-1, None), (-2, ""), (-3, "The THE the"), (-3, "The THE the"), (None, "x y"), (-4, "w " * 30_000)], "doc_id long, text string")
    df = docs.select("doc_id", "text").where("doc_id < 250").union(edge).repartition(3)
    rows = df.collect()
    got = sorted(lm_scoring.score_texts(df.withColumns({"chunk": F.lit(1), "n_tokens": F.lit(-5)}), ["doc_id"]).collect(), key=lambda r: (str(r.doc_id), r.score))
    fold = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5
    grams = lambda x: list(zip(["<s>", "<s>", *x], ["<s>", *x], x))
    c, dc = Counter(), Counter()  # n-grams of every order as tuples
    for r in rows:
        counts = Counter(g[k:] for g in grams(tokens(r.text)) for k in range(3))
        counts[("<s>",)] = counts[("<s>", "<s>")] = 1
        if fold(r.doc_id) != 1:
            c.update(counts)
        if fold(r.doc_id) == 2:
            dc.update(counts)
    words = [g for g in c if len(g) == 1 and g != ("<s>",)]
    n, v = sum(c[g] for g in words), len(words)
    held_n = n - sum(dc[g] for g in words)
    level = lambda p: 0 if p <= 0 else int(min(79, max(1, 79 + round(2 * math.log2(p)))))
    cells = Counter()
    for r in rows:
        if fold(r.doc_id) == 2:
            for g in grams(tokens(r.text)):
                left = lambda x: c[x] - dc[x]
                share = lambda k: left(g[k:]) / max(1, left(g[k:-1]))
                cells[left(g[:-1]).bit_length(), left(g[1:-1]).bit_length(), level(share(0)), level(share(1)), level(left(g[2:]) / held_n)] += 1
    frame = spark.createDataFrame([(*k, m) for k, m in cells.items()], "b3 int, b2 int, l3 int, l2 int, l1 int, n long")
    lower, upper = lm_scoring.fitted(frame, 1 / (v + 1))
    want = []
    for r in rows:
        x = tokens(r.text)
        base = sum(math.log10((c[(t,)] + 0.5) / (n + 0.5 * (v + 1))) for t in x)
        score = 0.0
        for g in grams(x):
            p = lower[c[g[1:-1]].bit_length()] @ [c[g[1:]] / max(1, c[g[1:-1]]), c[g[2:]] / n, 1 / (v + 1)]
            score += math.log10(upper[c[g[:-1]].bit_length()] @ [c[g] / max(1, c[g[:-1]]), p])
        want.append((r.doc_id, fold(r.doc_id) == 1, len(x), sum(c[(t,)] > 0 for t in x), n, base, score))
    for g, e in zip(got, sorted(want, key=lambda r: (str(r[0]), r[-1]))):
        assert tuple(g)[:5] == e[:5] and g.base_score == pytest.approx(e[5], rel=1e-9) and g.score == pytest.approx(e[6], rel=1e-6)
    held = [g for g in got if g.held_out]
    assert sum(g.score for g in held) > sum(g.base_score for g in held)
    assert lm_scoring.score_texts(df.limit(0), ["doc_id"]).count() == 0


def test_learning_finds_the_mixture():
    rng = np.random.default_rng(0)
    two, one = rng.dirichlet(np.full(400, 0.2)), rng.dirichlet(np.full(400, 1.0))
    counts = 1_000_000 * (0.7 * two + 0.3 * one)  # what a context with these two estimates would really see
    rows = [(3, int(a), int(b), int(n)) for a, b, n in zip(lm_scoring.level(two), lm_scoring.level(one), counts)]
    w = lm_scoring.learn(rows, 1e-6)[3]
    assert w.sum() == pytest.approx(1) and abs(w[0] - 0.7) < 0.05 and abs(w[1] - 0.3) < 0.05 and w[2] < 0.02


def brute_classes(rows):
    sets = [frozenset(tuple(w[i : i + min(5, len(w))]) for i in range(len(w) - min(5, len(w)) + 1)) if (w := (t or "").encode().split()) else frozenset() for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    first, index = {}, defaultdict(set)
    for i, (_, t) in enumerate(rows):
        if (t or "") in first:
            parent[find(i)] = find(first[t or ""])
            continue
        first[t or ""] = i
        shared = Counter(j for s in sets[i] for j in index[s])
        for s in sets[i]:
            index[s].add(i)
        for j, n in shared.items():
            if n >= 0.8 * (len(sets[i]) + len(sets[j]) - n):
                parent[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        least.setdefault(find(i), []).append(k)
    return [min((k for k in least[find(i)] if k is not None), default=None) for i in range(len(rows))]


def test_classes(spark, docs):
    """Documents, edge rows, and a group of copies with independent and with shared edits."""
    rng = np.random.default_rng(4)
    vocabulary = [f"w{i}" for i in range(4000)]
    base = rng.choice(vocabulary, 160).tolist()
    rows = [(r.doc_id, r.text) for r in docs.where("doc_id < 150").collect()]
    edits = [(int(p), str(rng.choice(vocabulary))) for p in rng.integers(0, 160, 12)]
    for i in range(260):
        copy = list(base)
        for p in rng.integers(0, 160, rng.integers(0, 9)):
            copy[p] = str(rng.choice(vocabulary))
        for p, x in edits[: rng.integers(0, 12)] if i % 3 == 0 else []:
            copy[p] = x
        if i % 5 == 0:
            del copy[: rng.integers(0, 30)]
        rows.append((1000 + i, " ".join(copy)))
    rows += [(2000, None), (2001, ""), (2002, " "), (2003, "one two"), (2004, "one two"), (2004, "one two"), (2005, "one  two"), (2006, "z " * 40_000), (2007, "z " * 39_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"a": F.lit(1), "b": F.lit(1), "bands": F.lit(1)})
    got = sorted(((r.doc_id, r.class_id) for r in near_dedup.classes_of(df).collect()), key=str)
    assert got == sorted(((k, c) for (k, _), c in zip(rows, brute_classes(rows))), key=str)
    kept = near_dedup.kept(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in got})
    assert near_dedup.classes_of(df.limit(0)).count() == 0


def test_repeated_passages_hide_no_class(spark):
    """Copies in which one passage repeats far more often than the rest are as similar as their shingle sets."""
    rng = np.random.default_rng(8)
    vocabulary = [f"w{i}" for i in range(50_000)]
    rows = []
    for i in range(40):
        base = rng.choice(vocabulary, 1000).tolist()
        copy = list(base)
        for p in range(20):
            copy[50 * p + 20] = f"new{i}_{p}"
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(copy + copy[300:450] * 100))]
    want = brute_classes(rows)
    assert want == [k - k % 2 for k, _ in rows]
    got = near_dedup.classes_of(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in got} == {k: c for (k, _), c in zip(rows, want)}


def test_signatures_estimate_probability_jaccard():
    rng = np.random.default_rng(3)
    x, y = (dict(zip(range(a, a + 60), rng.integers(1, 9, 60))) for a in (0, 20))
    as_set = lambda d: (np.array([near_dedup.xxhash.xxh64_intdigest(str(k)) for k in d], np.uint64), np.array(list(d.values())))
    s = near_dedup.signatures([as_set(x), as_set(y)], 8192)
    wx, wy = ({k: 1 + math.log(v) for k, v in d.items()} for d in (x, y))
    px, py = ({k: v / sum(w.values()) for k, v in w.items()} for w in (wx, wy))
    want = sum(1 / sum(max(px.get(j, 0) / px[i], py.get(j, 0) / py[i]) for j in {*px, *py}) for i in {*px} & {*py})
    assert abs((s[0] == s[1]).mean() - want) < 0.03


def test_pipeline(spark, docs):
    frames, names = [docs], [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    for _, stage in corpus_pipeline.STAGES:
        frames.append(stage(spark, frames[-1], SF).cache())
    raw, good, single, clean, mix, packed = frames
    assert all(set(f.columns) == set(docs.columns) for f in frames[:-1])
    assert 0 < good.count() <= raw.count() and single.count() <= good.count() and clean.count() == single.count()
    changed = clean.alias("c").join(single.alias("s"), "doc_id").where("c.text <> s.text")
    assert changed.where("c.text not like '%[SECRET]%' or c.n_chars <> length(c.text)").count() == 0
    assert mix.join(clean, "doc_id", "left_anti").count() == 0 and mix.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2
    assert packed.select("doc_id").distinct().count() == mix.select("doc_id").distinct().count()
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0] <= 2048
