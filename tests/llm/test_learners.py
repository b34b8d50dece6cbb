"""Pooling, the network, the line field and URL features against plain Python and enumeration."""

import itertools
import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from quillguard.llm import quality, quality_rules, url_filters


def test_pooled_vectors():
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(50, quality.DIMS)).astype(np.float32)
    found, counts, again = np.array([3, 9, 41]), np.array([1, 5, 2]), 0.25
    got = quality.pool(vectors, (found, counts, again))
    words = [v for v, n in zip(found, counts) for _ in range(n)]  # each word as often as it stands
    mean = [sum(float(vectors[w][d]) for w in words) / len(words) for d in range(quality.DIMS)]
    spread = [math.sqrt(max(0, sum((float(vectors[w][d]) - mean[d]) ** 2 for w in words) / len(words))) for d in range(quality.DIMS)]
    length = lambda v: math.sqrt(sum(x * x for x in v))
    want = [4 * x for x in mean] + [4 * x for x in spread] + [length(mean), length(spread), math.log1p(8) / 8, 3 / math.sqrt(8) / 4, 0.5]
    assert np.allclose(got, want, atol=1e-5)
    assert not quality.pool(vectors, (np.zeros(0, int), np.zeros(0, int), 0.0)).any()


def test_network_learns_and_is_calibrated():
    """Points on two sides of a plane, a tenth of the labels turned: held-out accuracy near its limit, and a temperature that no
    other betters by much on rows it has not seen."""
    rng = np.random.default_rng(2)
    def rows(n):  # noqa: E306
        x = rng.normal(size=(n, quality.N_POOLED)) * 0.5
        y = (x[:, 0] + x[:, 1] > x[:, 2]).astype(float)
        return x, np.where(rng.random(n) < 0.1, 1 - y, y)
    x, y = rows(4000)
    network = quality.Network().fit(x, y)
    xs, ys = rows(3000)
    p = network.score(xs)
    assert ((p >= 0.5) == (ys == 1)).mean() > 0.72
    loss = lambda t: np.logaddexp(0, np.where(ys == 1, -network.logits(xs), network.logits(xs)) / t).mean()
    assert loss(network.temperature) <= min(map(loss, np.geomspace(0.25, 8, 41))) + 0.02
    for low in (0.1, 0.4, 0.7):  # of those scored so, about so many are of label 1
        some = (p >= low) & (p < low + 0.2)
        assert some.sum() < 100 or abs(ys[some].mean() - p[some].mean()) < 0.15


def test_field_climbs_to_the_likeliest_labels():
    """The likelihood by enumeration of all labellings: training climbs it until its slope is nearly level."""
    rng = np.random.default_rng(3)
    features = [rng.normal(size=(n, quality_rules.N_FEATURES)) for n in (1, 3, 5, 4, 2, 5)]
    for f in features:
        f[:, quality_rules.DUPLICATE] = rng.random(len(f)) < 0.4
    labels = [1, 0, 1, 0, 0, 1]
    kinds = Counter(labels)

    def objective(w, moves):
        total = 0.0
        for f, bad in zip(features, labels):
            score = lambda y, f=f: sum(y[t] * (f[t] @ w) for t in range(len(f))) + sum(moves[a, b] for a, b in itertools.pairwise(y))
            truth = [1] * len(f) if bad else [int(x) for x in f[:, quality_rules.DUPLICATE] > 0]
            z = np.logaddexp.reduce([score(y) for y in itertools.product((0, 1), repeat=len(f))])
            total += 0.5 / kinds[bad] / len(f) * (score(truth) - z)
        return total

    def slope(w, moves, decay=0.0, h=1e-5):
        out = []
        for i in range(len(w) + 4):
            d, e = np.zeros(len(w)), np.zeros((2, 2))
            (d if i < len(w) else e.ravel())[i if i < len(w) else i - len(w)] = h
            out.append((objective(w + d, moves + e) - objective(w - d, moves - e)) / (2 * h))
        return np.array(out) - decay * np.concatenate([w, moves.ravel()])

    start = np.zeros(quality_rules.N_FEATURES), np.zeros((2, 2))
    first = quality_rules.train(features, labels, rounds=1, rate=1e-3)
    got = np.concatenate([first[0], first[1].ravel()]) / 1e-3  # one small step goes along the slope
    assert np.allclose(got, slope(*start), atol=1e-4)
    w, moves = quality_rules.train(features, labels, rounds=4000)
    assert objective(w, moves) > objective(*start) and np.abs(slope(w, moves, quality_rules.train.__kwdefaults__["decay"] if quality_rules.train.__kwdefaults__ else quality_rules.train.__defaults__[-1])).max() < 0.02


def test_lexical_features(spark):
    rng = random.Random(4)
    urls = ["http://" + ".".join("".join(rng.choice("ab-9é") for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(1, 4))) + "".join(f"/{rng.choice(['x', 'p-1', '22'])}" for _ in range(rng.randint(0, 4))) + rng.choice(["", "?a=1", "?a=1&b=&c", "#f", "?q#f"]) for _ in range(200)] + ["", "no url", None, "ftp://H.Com"]
    got = url_filters.lexical(url_filters.parsed(spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, url string"))).collect()
    for r in got:
        u = urls[r.i] or ""
        rest = u.split("://", 1)[1] if "://" in u else ""
        cut = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:].split("#")[0].split("?")[0]
        query = u.split("?", 1)[1].split("#")[0] if "?" in u else ""
        counts = Counter(u)
        bits = -sum(n / len(u) * math.log2(n / len(u)) for n in counts.values()) if u else 0.0
        want = [len(u), len(host), len(path), path.count("/"), host.count(".") + 1, sum(c in "0123456789" for c in u) / max(1, len(u)), bits, query.count("&") + 1 if query else 0, "#" in u, host.count("-")]
        assert (r.host, r.path, r.suffix) == (host, path, host.rsplit(".", 1)[-1])
        assert np.allclose([r[c] for c in url_filters.FEATURES[:10]], np.array(want, float)), u


def test_trees_learn_what_urls_look_like(spark):
    """URLs that no rule judges, labelled by how many digits they have: held-out verdicts agree."""
    rng = random.Random(5)
    def url():  # noqa: E306
        digits = rng.random() < 0.5
        return f"http://site{rng.randrange(50)}.test/" + "".join(rng.choice("0123456789" if digits and rng.random() < 0.8 else "abcdefghij") for _ in range(rng.randint(10, 30))), "block" if digits else "allow"
    known, asked = [url() for _ in range(1500)], [url() for _ in range(400)]
    got = url_filters.judge(spark.createDataFrame(asked, "url string, truth string"), ["truth"], labelled=spark.createDataFrame(known, "url string, verdict string"))
    assert got.where(F.col("truth") == F.col("verdict")).count() >= 0.95 * len(asked)
