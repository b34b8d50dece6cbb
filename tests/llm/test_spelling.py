"""Collocations: frequent phrases are spelt once, whatever the number of shards that hold them."""

import pytest
from pyspark.sql import functions as F

from quillguard.llm import collocations


@pytest.fixture
def docs(spark):
    rows = [(i, "en" if i % 2 else None, "one two three four five six, seven eight nine ten " * 4) for i in range(64)]
    return spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(8, "doc_id").cache()


def counts(docs):
    return sorted(map(tuple, collocations.phrase_counts(docs, least=9)[0].select("lang", "phrase", "k", "f").collect()), key=str)


def expected(docs):
    from collections import Counter

    n = Counter()
    for r in docs.collect():
        for piece in r.text.split(","):
            w = piece.split()
            n.update((r.lang or "und", " ".join(w[i : i + k]), k) for k in range(1, 6) for i in range(len(w) - k + 1))
    return sorted(((*key, f) for key, f in n.items() if f >= 9), key=str)


def test_a_phrase_is_spelt_by_one_partition(docs, monkeypatch):
    made, old = [], collocations.over_shards
    monkeypatch.setattr(collocations, "over_shards", lambda d, a, b, emit, schema, *more: made.append((schema, old(d, a, b, emit, schema, *more))) or made[-1][1])
    got = counts(docs)
    assert got == expected(docs)
    (spelt,) = [df for schema, df in made if schema.startswith("lang string, phrase string, k int")]
    assert spelt.count() == sum(k > 1 for _, _, k, _ in got)


def test_texts_dealt_otherwise_lose_no_phrase(docs, monkeypatch):
    old = collocations.placed
    monkeypatch.setattr(collocations, "placed", lambda h, at: old(h, at + F.lit(999) if str(at) == "Column<'o'>" else at))
    assert counts(docs) == expected(docs)


def test_stretches_that_share_a_hash_are_told_apart(docs, monkeypatch):
    """With every owner taken for shared, all partitions spell and count."""
    old = collocations.F.min
    monkeypatch.setattr(collocations.F, "min", lambda c: old(F.lit(collocations.EACH)) if isinstance(c, str) and c == "o" else old(c))
    assert counts(docs) == expected(docs)
