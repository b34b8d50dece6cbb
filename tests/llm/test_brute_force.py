"""Parts of operators against plain re-computation: encoders over whole texts, word vectors, near-duplicate recall."""

from collections import Counter, defaultdict

import numpy as np

from quillguard.llm import near_dedup, packing, quality, token_counts

SF = "/root/testdata/sf0.01"


def test_ids_over_whole_texts(spark):
    """Both libraries give the same ids for every text of the table and for long runs without blanks."""
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(token_counts.vocabulary(packing.MODEL))
    e = packing.IdEncoder(token_counts.vocabulary(packing.MODEL), token_counts.vocabulary(packing.RANKS))
    texts = [r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    texts += ["abcdefgh" * 12_500, "é" * 20_000, "0123456789" * 2_000, "!?" * 10_000, "a\n\n\n" * 5_000]
    for t, ids in zip(texts, e.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == tk.encode(t, add_special_tokens=False).ids


def test_word_vectors(spark):
    texts = ["the cat sat", "the dog sat sat sat sat", None, "", "THE!! cat"]
    want = np.zeros((quality.BUCKETS, quality.DIMS))
    for t in texts:
        if t:
            counts = Counter(b for w in t.encode().split() for b in (quality.bucket_of(w), quality.bucket_of(quality.shape_of(w))))
            places, signs = quality.index_vector(t)
            for b, n in counts.items():
                want[b, places] += n.bit_length() * signs
    got = quality.word_vectors(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3))
    length = np.maximum(np.linalg.norm(want, axis=1, keepdims=True), 1e-9)
    assert np.allclose(got, want / length, atol=1e-6)


def test_recall_of_near_duplicates(spark):
    """Every document whose id is divisible by 20 against all rows: links found as one class, at least 0.9 of them."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    cls = {r.doc_id: r.class_id for r in near_dedup.classes_of(docs).collect()}
    sets = {}
    for r in docs.collect():
        w = (r.text or "").encode().split()
        k = min(5, len(w))
        sets[r.doc_id] = frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset()
    index = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            index[x].append(i)
    links = found = 0
    for i in (i for i in sets if i % 20 == 0):
        for j, n in Counter(j for x in sets[i] for j in index[x]).items():
            if j != i and n >= 0.8 * (len(sets[i]) + len(sets[j]) - n):
                links, found = links + 1, found + (cls[i] == cls[j])
    assert links > 5 and found >= 0.9 * links


def test_crowds_of_leftovers(spark):
    """Many members that share shingles outside their leader meet a leader of their own, and no class is lost."""
    rng = np.random.default_rng(12)
    vocabulary = [f"w{i}" for i in range(5000)]
    core = rng.choice(vocabulary, 150).tolist()
    extra = [rng.choice(vocabulary, 60).tolist() for _ in range(4)]
    rows = []
    for i in range(320):
        tail = list(extra[i % 4])
        tail[rng.integers(0, 60)] = f"x{i}"
        rows.append((i, " ".join(core + tail)))
    got = {r.doc_id: r.class_id for r in near_dedup.classes_of(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    groups = defaultdict(set)
    for i, c in got.items():
        groups[c].add(i % 4)
    assert len({frozenset(g) for g in groups.values()}) <= 4 and len(groups) <= 4
