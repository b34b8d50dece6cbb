"""Windows, runs and phrases against brute force, and their edges."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillguard.llm import collocations, decontamination, near_dedup, periodic_runs
from quillguard.llm.registry import ORACLES, QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


# ---- windows of a test set


@pytest.mark.parametrize("most", [1, 2, 30, 3_000_000])
def test_index_finds_every_place(most):
    rng = random.Random(most)
    for n in (0, 1, 5, 60, 400):
        s = [rng.randrange(most + 1) for _ in range(n)]
        s = np.array((s[: n // 7 + 1] * 8)[:n] if n % 2 else s, np.int64)
        order = decontamination.suffix_array(np.append(s, 0))

        def key(i):
            out = []
            while i < n and s[i]:
                out.append((1, s[i]))
                i += 1
            return [*out, (0, i)]

        assert order.tolist() == sorted(range(n + 1), key=key)
        if most > 100:
            continue
        index = decontamination.FMIndex(s, most)
        for size in (1, 2, 4):
            patterns = np.array([[rng.randint(1, most) for _ in range(size)] for _ in range(15)])
            which, lo, hi = index.ranges(patterns)
            got = {int(w): sorted(index.located(np.arange(a, b)).tolist()) for w, a, b in zip(which, lo, hi)}
            for w, p in enumerate(patterns):
                assert got.get(w, []) == [i for i in range(n - size + 1) if (s[i : i + size] == p).all()]


def brute_hits(text, items, window=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words, hit, names = word.findall(low(text)), set(), set()
    for name, t in items:
        w = word.findall(low(t))
        size = min(window, len(w))
        for i in range(len(w) - size + 1 if size else 0):
            for j in range(len(words) - size + 1):
                if words[j : j + size] == w[i : i + size]:
                    hit.update(range(j, j + size))
                    names.add(name or "")
    return len(words), sorted(hit), sorted(names)


@pytest.fixture(scope="module")
def passages():
    rng = random.Random(5)
    some = lambda n, m=12: " ".join(rng.choice(["Alpha", "béta", "x1", "Ñandú", "d-e", "f", "g,", "h!", "42", "ß", "j", "k"][:m]) for _ in range(n))
    items = [(f"i{k}", some(rng.randint(0, 30))) for k in range(12)] + [("i3", some(14)), ("i9", "Omega Psi"), ("one", "solo"), (None, some(11)), ("empty", None), ("none", "--- ...")]
    docs = [(k, some(rng.randint(0, 50)) + " " + (items[k % 12][1] or "") + " " + some(5)) for k in range(40)]
    docs += [(100, None), (101, ""), (102, "omega psi!"), (102, "omega psi!"), (None, "SOLO"), (103, "omega"), (104, "it " * 3000 + items[2][1] + " it" * 3000), (105, " ".join(items[1][1].upper().split()))]
    return docs, items


@pytest.mark.parametrize("block_words,shard_words", [(1 << 18, 1 << 20), (40, 64)])
def test_contamination(spark, passages, monkeypatch, block_words, shard_words):
    """Also with many blocks of the test set and many parts of a shard."""
    docs, items = passages
    monkeypatch.setattr(decontamination, "BLOCK_WORDS", block_words)
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"n_words": F.lit("mine"), "spans": F.lit(1), "items": F.lit(2), "__n": F.lit(3)}).repartition(3)
    if shard_words < 1 << 20:  # the bound is read where the shard is searched
        windows = decontamination.Windows([(i or "", t) for i, t in items], 10)
        monkeypatch.setattr(decontamination, "SHARD_WORDS", shard_words)
        n, owner, start, end, names = windows.hits([t or "" for _, t in docs])
        for k, (_, t) in enumerate(docs):
            words, hit, found = brute_hits(t, items)
            assert (n[k], sorted(x for o, a, b in zip(owner, start, end) if o == k for x in range(a, b)), names[k]) == (words, hit, found)
    got = decontamination.contamination(d, spark.createDataFrame(items, "item_id string, text string"), ["doc_id", "text", "n_words", "spans", "items"])
    assert got.columns == ["doc_id", "text", "n_words", "spans", "items", "n_words_", "spans_", "items_"]
    rows = got.collect()
    assert len(rows) == len(docs) and {r.n_words for r in rows} == {"mine"}
    for r in rows:
        words, hit, found = brute_hits(r.text, items)
        assert (r.n_words_, sorted(x for s in r.spans_ for x in range(s.start, s.end)), r.items_) == (words, hit, found)
        assert all(a.end < b.start for a, b in zip(r.spans_, r.spans_[1:]))


def test_spans_are_cut_out(spark):
    df = spark.createDataFrame([("One, two  three. Four!", [(1, 3)]), ("a b c", [(0, 1), (2, 3)]), ("a b", [(0, 2)]), ("a b", []), (None, []), ("..a", [(0, 1)])], "text string, spans array<struct<start:long,end:long>>")
    assert [r.text for r in decontamination.without_spans(df).collect()] == ["One, Four!", "b ", "", "a b", None, ".."]


def test_nothing_to_find(spark):
    docs, none = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    row = decontamination.contamination(docs, none, ["doc_id"]).first()
    assert (row.n_words, row.spans, row.items) == (2, [], [])
    assert decontamination.contamination(docs.limit(0), none, ["doc_id"]).count() == 0


# ---- periodic runs


def brute_runs(x, periods=2, shortest=2):
    out, n = [], len(x)
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and x[j] == x[j + p]:
                j += 1
            w = x[i : j + p]
            if j > i and len(w) >= max(shortest, periods * p) and not any(w[q:] == w[:-q] for q in range(1, p)):
                out.append((i, len(w), p))
            i = j + 1
    return sorted(out)


def test_runs_of_every_short_text():
    for n in range(11):
        for bits in range(1 << n):
            x = [bits >> i & 1 for i in range(n)]
            assert periodic_runs.runs(x) == brute_runs(x)


def test_runs_of_random_and_periodic_texts():
    rng = random.Random(7)
    for k in range(600):
        x = [rng.randrange(rng.choice((2, 3, 9))) for _ in range(rng.randint(1, 70))]
        if k % 2:
            a, p = rng.randrange(len(x)), rng.randint(1, 9)
            x = x[:a] + [x[min(a + (i - a) % p, len(x) - 1)] for i in range(a, len(x))]
        assert periodic_runs.runs(x) == brute_runs(x) and periodic_runs.runs(x, 4, 6) == brute_runs(x, 4, 6)


class Counted(int):
    n = 0

    def __eq__(self, other):
        Counted.n += 1
        return int(self) == int(other)

    __hash__ = int.__hash__


def test_comparisons_grow_with_the_length():
    """Words are compared a few times each, however often a text repeats itself."""
    fibonacci = [[0], [0, 1]]
    while len(fibonacci[-1]) < 6000:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    shapes = [[0] * 6000, [0] * 2000 + [1] + [0] * 2000 + [2] + [0] * 2000, ([0] * 70 + [1]) * 80, fibonacci[-1], [i % 50 for i in range(6000)], sum(([0] * k + [1] for k in range(1, 110)), []), ((([0, 1] * 20 + [2]) * 9 + [3]) * 6 + [4]) * 3]
    for x in shapes:
        for y in (x, [-v for v in x]):
            Counted.n = 0
            periodic_runs.next_smaller([Counted(v) for v in y])
            assert Counted.n <= 4 * len(y)


def told(doc_id, text):
    w = WORD.findall(text or "")
    h = zlib.crc32(str("" if doc_id is None else doc_id).encode())
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def test_runs_of_documents(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect() if len(r.text or "") < 6000]
    docs += [(1000 + k, t) for k, t in enumerate((None, "", " \t", "a " * 6, "a " * 5, "no no no no no no yes", "a b " * 4, "x y z " * 3 + "x y", "é ß " * 9))] + [(None, "w v " * 30), (7, "z" * 70_000 + " q" * 20_000)]
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    got = {}
    for r in periodic_runs.digests(periodic_runs.with_runs(periodic_runs.repeated(rows), ["doc_id"])).collect():
        got.setdefault(r.doc_id, []).append(r)
    some = 0
    for doc_id, text in docs:
        w = told(doc_id, text)
        found = brute_runs(w, 4, 6) if len(w) < 3000 else [(1, 20_000, 1)]
        some += bool(found)
        gone = {i for s, n, p in found for i in range(s + p, s + n)}
        best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
        row = (len(found), *best, best[0] is not None and 1000 * best[1] // best[2] or None, hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in found).encode()).hexdigest(), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest())
        assert row in [tuple(r)[1:] for r in got[doc_id]], doc_id
    assert some > 8
    assert periodic_runs.with_runs(rows.limit(0), ["doc_id"]).count() == 0


def test_runs_keep_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "a " * 9, "mine")], "doc_id long, text string, runs string").withColumns({"collapsed": F.lit(1), "__kept": F.lit(2)})
    row = periodic_runs.with_runs(df, df.columns).first()
    assert (row.runs, row.collapsed, row.collapsed_, [tuple(r) for r in row.runs_]) == ("mine", 1, "a", [(0, 9, 1)])


# ---- phrases


def brute_phrases(rows, words, least, top, share=100):
    n, f = Counter(), defaultdict(Counter)
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, words + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        candidates = {p: a for p, a in c.items() if a >= least and len(p) > 1}
        scored = []
        for p, a in candidates.items():
            if any(len(q) > len(p) and 100 * b >= share * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in candidates.items()):
                continue
            s, k = min((1000 * a * n[lang] // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-s, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(scored)[:top])]
    return sorted(out)


@pytest.mark.parametrize("shard", [1 << 22, 50])
def test_phrases(spark, shard, monkeypatch):
    rng = random.Random(11)
    vocabulary = ["the", "Of", "und", "ñu", "a", "b", "zig zag", "new york city", "x-1", "quick\tfox", "."]
    rows = [(rng.choice(("en", "de", None, "und")), " ".join(rng.choice(vocabulary) + rng.choice(("", "", "", ",", "\n", "!", "\x0b")) for _ in range(rng.randint(0, 60)))) for _ in range(150)]
    rows += [("en", None), (None, ""), ("fr", "only once"), ("en", rows[0][1]), ("long", "p q r s t u " * 9000)]
    df = spark.createDataFrame(rows, "lang string, text string").withColumns({"phrase": F.lit(1), "h": F.lit(2), "n": F.lit(3), "f": F.lit(4)}).repartition(4)
    if shard < 1 << 22:
        monkeypatch.setattr(collocations.over_shards, "__defaults__", (shard,))
    got = sorted(map(tuple, collocations.collocations(df, least=9, top=60).collect()))
    assert got == brute_phrases(rows, 5, 9, 60)
    assert collocations.collocations(df.limit(0)).count() == 0


def test_intervals_of_parts():
    rng = np.random.default_rng(3)
    symbols = rng.integers(0, 4, 500)
    want = Counter(tuple(symbols[i : i + k].tolist()) for k in range(2, 6) for i in range(len(symbols) - k + 1) if (symbols[i : i + k] != 0).all())
    for most in (10_000, 37):
        got = Counter()
        for k, at, n in collocations.intervals(symbols, 2, 5, most):
            for a, m in zip(at, n):
                got[tuple(symbols[a : a + k].tolist())] += int(m)
        assert got == want


def test_products_beyond_64_bits(spark):
    big = 4_000_000_000_000
    found = spark.createDataFrame([("en", "a", 1, big), ("en", "b", 1, big - 7), ("en", "a b", 2, big - 9)], "lang string, phrase string, k int, f long")
    row = collocations.scored(found, spark.createDataFrame([("en", 17 * big)], "lang string, n long")).first()
    assert row.score == 1000 * (big - 9) * 17 * big // (big * (big - 7))


def test_shards_that_mark_too_much_count_the_same(spark, monkeypatch):
    """With a bitmap of a few bits nearly all words and pairs seem frequent; counts stay exact."""
    rows = [("en", " ".join(f"w{i * j % 23}" for j in range(40))) for i in range(60)]
    df = spark.createDataFrame(rows, "lang string, text string")
    marked = collocations.marked
    monkeypatch.setattr(collocations, "marked", lambda bits, h: marked(b"\xff" * len(bits), h))
    assert sorted(map(tuple, collocations.collocations(df, least=12, top=50).collect())) == brute_phrases(rows, 5, 12, 50)


# ---- their twins, and near-duplicates


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_twins(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    want = duck.execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(str, map(tuple, df.select(*columns).collect()))) == sorted(map(str, want.fetchall()))


def test_excerpts_of_one_text_are_not_all_compared(spark, monkeypatch):
    """Many excerpts of one text, each unlike the whole and mostly unlike each other: comparisons grow with their number, and
    classes are those of all pairs."""
    compared = Counter()
    overlaps = near_dedup.overlaps

    def counted(pairs, sets):
        compared[m] += pairs.count()
        return overlaps(pairs, sets)

    monkeypatch.setattr(near_dedup, "overlaps", counted)
    rng = np.random.default_rng(6)
    whole = rng.choice([f"w{i}" for i in range(50_000)], 1000).tolist()
    for m in (120, 240, 480):
        rows = [(0, " ".join(whole))]
        for i in range(m):
            kept = np.ones(1000, bool)
            for a in rng.integers(0, 968, 8):
                kept[a : a + 32] = False
            rows.append((i + 1, " ".join(w for w, k in zip(whole, kept) if k)))
        cls = {r.doc_id: r.class_id for r in near_dedup.classes_of(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        sets = [frozenset(zip(*(t.split()[k:] for k in range(5)))) for _, t in rows]
        links = [(i, j) for i in range(m + 1) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
        assert sum(cls[i] == cls[j] for i, j in links) >= 0.95 * len(links)
        assert all(cls[i] <= i for i in cls)
    assert all(n <= (near_dedup.BANDS + near_dedup.ROUNDS * near_dedup.FINE_BANDS) * m for m, n in compared.items())
    assert compared[480] <= 30 * 480 and compared[480] <= 3 * compared[240]
