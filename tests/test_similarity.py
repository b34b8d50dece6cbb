"""Content origin against brute force, long documents included."""

import hashlib
import random

from quillguard.plans import registry


def test_origin_of_long_documents(spark, tmp_path):
    rng = random.Random(3)
    words = lambda n: " ".join(f"Word{rng.randrange(5000)}" for _ in range(n))
    passages = [(i, words(60)) for i in range(6)] + [(6, "too short"), (7, None)]
    docs = [(10 + i, f"{words(900)}\n{t}\t{words(900)}") for i, t in passages[:4]] + [(20, words(300)), (21, None), (22, "")]
    docs += [(30, passages[4][1]), (31, passages[4][1] + " " + words(2000)), (40, " ".join(passages[5][1].split()[:40])), (41, words(1500) + " " + passages[5][1])]
    spark.createDataFrame(passages, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")

    def sampled(t):
        w = (t or "").lower().split()
        return {h for i in range(len(w) - 4) if (h := hashlib.md5(" ".join(w[i : i + 5]).encode()).hexdigest())[0] in "048c"}

    sets, want = {i: sampled(t) for i, t in docs}, {}
    for i, t in passages:
        p = sampled(t)
        best = max(((len(p & s), -d) for d, s in sets.items()), default=(0, 0))
        if len(p) >= 4 and best[0] > 0.5 * len(p):
            want[i] = (-best[1], round(best[0] / len(p), 2))
    got = registry.QUERIES["origin_containment"](spark, str(tmp_path)).collect()
    assert {r.item_id: (r.doc_id, r.containment) for r in got} == want
    assert [want[i][0] for i in range(6)] == [10, 11, 12, 13, 30, 41]
