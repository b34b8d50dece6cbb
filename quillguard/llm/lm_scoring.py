"""Language-model scoring by deleted interpolation.

The model is over words, of ORDER words at a time: a token's probability is a mixture of its maximum-likelihood estimate
behind the two words before it and of the probability that the next lower order gives, which is a mixture in its turn of
the estimate behind one word, its share of all tokens, and a uniform share. The weights depend on how often the context
occurs (buckets of powers of two). They are learned by expectation-maximisation on held-out counts: one fold of the
training documents is deleted from the counts, and its tokens are explained by the rest.

How it runs. Each task cuts its documents into chunks of about CHUNK_BYTES of text and writes them as numbers of words, one
row a chunk; the deleted fold has chunks of its own. A chunk lists its distinct n-grams of each order with its own training
counts, packed by hash part, so a frequent n-gram is one entry a chunk, however often it occurs there. Parts sum these over
all chunks and answer each chunk with the corpus's counts in the order asked. One exchange thus counts and looks up: no
model is broadcast or collected, and what is gathered grows with the corpus. Tasks are as many as chunks, so that none
grows with the corpus; a part holds PART_TOKENS tokens, and of an n-gram that every chunk holds one entry a chunk. The
weights are fitted on histograms of (context bucket, two estimates in half powers of two), of bounded size for any corpus.

Unigrams are told apart by 64 bits of hash, longer n-grams by 32 bits inside their part (parts grow with the corpus, so of
a million n-grams of a part about a hundred meet another's hash).

Null text counts as empty: its only token is the end. Repeated rows count and score each for itself. Very long texts are a
chunk of their own. Without training documents all counts are 0 and the uniform share is all there is. An empty table gives
an empty result. Kept columns keep their values whatever their names (common.restored); other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillguard.llm.common import KEPT, carried, fold_of, pieces_of, released, restored, table, written

TEST_FOLD, DELETED_FOLD, FOLDS, ORDER = 1, 2, 5, 3
CHUNK_BYTES, MIN_PARTS, PART_TOKENS = 4 << 20, 256, 1_000_000
ROUNDS, LEVELS, BUCKETS = 40, 80, 64  # of the learning; of an estimate's half powers of two, level 0: the estimate is 0; of contexts
END, START = (np.uint64(xxhash.xxh64_intdigest(b)) for b in (b"\n", b"\n\n"))  # no word holds a line feed


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of a pair."""
    with np.errstate(over="ignore"):
        x = a * np.uint64(0x9E3779B97F4A7C15) ^ (b + np.uint64(0x632BE59BD9B4E019)) * np.uint64(0xC2B2AE3D27D4EB4F)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


def packed(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x, "<u4").tobytes())


def unpacked(b: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), "<u4").astype(np.int64)


def numbered(texts: list[str | None]) -> tuple[bytes, bytes, list[int]]:
    """A chunk's tokens as numbers of its distinct words (0: the end), those words' hashes, and each text's tokens."""
    seen: dict[bytes, int] = {b"\n": 0}
    rows, sizes = [], []
    for t in texts:
        words = (t or "").encode("utf-8", "replace").lower().split()  # bytes: letters A-Z and ASCII blanks only
        rows.append(np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.uint32, len(words)))
        rows.append(np.zeros(1, np.uint32))
        sizes.append(len(words) + 1)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, seen), np.uint64, len(seen))
    return packed(np.concatenate(rows)), hashes.tobytes(), sizes


CHUNK = "chunk long, deleted boolean, tokens binary, hashes binary, rows array<struct<n:long,fold:int>>"


def chunked(docs: DataFrame) -> DataFrame:
    """docs (KEPT, fold, text) as chunks, one row each, their rows' KEPT beside the number of tokens; written."""
    kept = docs.schema[KEPT].dataType
    schema = T.StructType([*T._parse_datatype_string(CHUNK).fields, T.StructField(KEPT, T.ArrayType(kept))])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 24
        held: dict[bool, list] = {False: [], True: []}
        sizes = {False: 0, True: 0}

        def chunk(deleted: bool) -> pa.RecordBatch:
            nonlocal at
            parts = held[deleted]
            tokens, hashes, n = numbered([t for p in parts for t in p.column(2).to_pylist()])
            folds = [f for p in parts for f in p.column(1).to_pylist()]
            rows = pa.concat_arrays([p.column(0) for p in parts])
            at, held[deleted], sizes[deleted] = at + 1, [], 0
            columns = [[at], [deleted], [tokens], [hashes], [[{"n": a, "fold": b} for a, b in zip(n, folds)]]]
            lists = pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows)
            return pa.RecordBatch.from_arrays([*(pa.array(c, arrow.field(i).type) for i, c in enumerate(columns)), lists.cast(arrow.field(5).type)], schema=arrow)

        for batch in batches:
            for part in pieces_of(batch, 2, 4096):
                for deleted in (False, True):
                    mine = part.filter(pa.compute.equal(pa.compute.equal(part.column(1), DELETED_FOLD), deleted))
                    if mine.num_rows:
                        held[deleted].append(mine)
                        sizes[deleted] += mine.column(2).nbytes
                        if sizes[deleted] >= CHUNK_BYTES:
                            yield chunk(deleted)
        for deleted in (False, True):
            if held[deleted]:
                yield chunk(deleted)

    return written(docs.select(KEPT, "fold", "text").mapInArrow(run, schema))


class Chunk:
    """A chunk's tokens as places in its lists of distinct n-grams, by order."""

    def __init__(self, tokens: bytes, hashes: bytes, sizes: list[int], parts: int):
        token = np.frombuffer(hashes, np.uint64)[unpacked(tokens)]
        self.sizes = np.array(sizes, np.int64)
        self.doc = np.repeat(np.arange(len(sizes)), self.sizes)
        self.first = np.concatenate(([0], np.cumsum(self.sizes)[:-1])).astype(np.int64)
        bits = parts.bit_length() - 1
        self.lists, gram = [], token  # per order: the keys inside their part, their parts, each token's place
        for n in range(ORDER):
            if n:
                before = np.concatenate(([START], gram[:-1]))
                before[self.first] = START
                gram = mixed(before, token)
            keys, place = np.unique(gram if not n else gram >> np.uint64(32 - bits), return_inverse=True)
            of = keys >> np.uint64(64 - bits if not n else 32)  # parts are powers of two, so the order of keys is that of parts
            self.lists.append((keys if not n else (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32), of.astype(np.int64), place))

    def spots(self, n: int) -> Iterator[tuple[int, int, int]]:
        """(part, where its keys begin, where they end) of an order's list."""
        of = self.lists[n][1]
        cuts = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
        return ((int(of[a]), a, b) for a, b in zip(cuts, cuts[1:]) if b > a)

    def shifted(self, counts: np.ndarray, at_first: np.ndarray) -> np.ndarray:
        """Each token's predecessor's value; that of an end at the start of a text: starts are as many as ends."""
        out = np.concatenate((counts[:1], counts[:-1]))
        out[self.first] = at_first
        return out


ASKED = "n int, part long, chunk long, deleted boolean, keys binary, used binary"
ANSWERED = "chunk long, deleted boolean, n int, part long, used binary, less binary, total long, less_total long, distinct long"
SCORES = "n_tokens long, n_known long, base_score double, score double"


def asked_of(chunks: DataFrame, parts: int) -> DataFrame:
    """Each chunk's distinct n-grams by part, with the chunk's own counts in training."""

    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                number, deleted, tokens, hashes, docs = (c[at].as_py() for c in batch.columns)
                chunk = Chunk(tokens, hashes, [d["n"] for d in docs], parts)
                trained = (np.array([d["fold"] for d in docs]) != TEST_FOLD)[chunk.doc]
                rows = []
                for n, (keys, _, place) in enumerate(chunk.lists):
                    used = np.bincount(place[trained], minlength=len(keys))
                    rows += [(n + 1, part, number, deleted, keys[a:b].tobytes() if n == 0 else packed(np.diff(keys[a:b], prepend=np.uint32(0))), packed(used[a:b])) for part, a, b in chunk.spots(n)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.binary()))], names=[c.split()[0] for c in ASKED.split(", ")])

    return chunks.select("chunk", "deleted", "tokens", "hashes", "rows").mapInArrow(run, ASKED)


def answer(key: tuple, asked: pd.DataFrame) -> pd.DataFrame:
    """A part's counts over the corpus, to each chunk in its own order; to the deleted fold's chunks also that fold's."""
    asked = asked.sort_values(["deleted", "chunk"], ascending=[False, True])
    lists = [np.frombuffer(k, np.uint64) if key[0] == 1 else np.cumsum(unpacked(k)) for k in asked["keys"]]  # longer n-grams come as steps
    _, place = np.unique(np.concatenate(lists), return_inverse=True)
    ends = np.cumsum([len(x) for x in lists])
    used = np.concatenate([unpacked(b) for b in asked["used"]])
    cut = int(sum(len(x) for x, d in zip(lists, asked["deleted"]) if d))
    sums = np.bincount(place, used).astype(np.int64)
    less = np.bincount(place[:cut], used[:cut], minlength=len(sums)).astype(np.int64)
    rows = []
    for i, (chunk, deleted, x, b) in enumerate(zip(asked["chunk"], asked["deleted"], lists, ends)):
        mine = place[b - len(x) : b]
        totals = (0, 0, 0) if i else (int(sums.sum()), int(less.sum()), int((sums > 0).sum()))
        rows.append((chunk, deleted, key[0], key[1], packed(sums[mine]), packed(less[mine]) if deleted else b"", *totals))
    return pd.DataFrame(rows, columns=[c.split()[0] for c in ANSWERED.split(", ")])


def looked_up(row: dict, answers: pd.DataFrame, parts: int, less: bool) -> tuple[Chunk, list[np.ndarray], list[np.ndarray]]:
    """A chunk, and per order the count of each token's n-gram and of its context; less the deleted fold's, if so asked."""
    chunk = Chunk(row["tokens"], row["hashes"], [d["n"] for d in row["rows"]], parts)
    grams, contexts = [], []
    for n, (keys, _, place) in enumerate(chunk.lists):
        mine = answers[answers["n"] == n + 1]
        got, at = np.zeros(len(keys), np.int64), {part: (a, b) for part, a, b in chunk.spots(n)}
        for part, used, taken in zip(mine["part"], mine["used"], mine["less"] if less else mine["used"]):
            a, b = at[part]
            got[a:b] = unpacked(used) - (unpacked(taken) if less else 0)
        grams.append(got[place])
        if n == 0:
            ends = grams[0][chunk.first + chunk.sizes - 1]
    for n in range(1, ORDER):
        contexts.append(chunk.shifted(grams[n - 1], ends))
    return chunk, grams, contexts


def buckets(context: np.ndarray) -> np.ndarray:
    """0 for a context never seen, else 1 + floor(log2(count))."""
    return np.frexp(context.astype(np.float64))[1].astype(np.int64)


def level(p: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.where(p > 0, np.clip(LEVELS - 1 + np.round(2 * np.log2(np.maximum(p, 1e-300))), 1, LEVELS - 1), 0).astype(np.int64)


def power(q: np.ndarray) -> np.ndarray:
    """The estimate that a level stands for."""
    return np.where(q > 0, 2.0 ** ((q - LEVELS + 1) / 2), 0.0)


def learn(histogram: list[tuple[int, ...]], uniform: float | None, rounds: int = ROUNDS) -> np.ndarray:
    """Mixture weights by context bucket, by expectation-maximisation. histogram: rows of the bucket, the levels of the
    estimates, and how many tokens; uniform: a last component, the same for all (None: there is none).

    Contexts never seen give their own estimate no weight. Buckets that no token was in take the weights of the one below.
    """
    kinds = len(histogram[0]) - 2 + (uniform is not None) if histogram else (3 if uniform is not None else 2)
    weights = np.tile(np.array([0.4, 0.5, 0.1] if kinds == 3 else [0.5, 0.5]), (BUCKETS, 1))
    weights[0, 0] = 0
    weights[0] /= weights[0].sum()
    if not histogram:
        return weights
    b, *levels, n = np.array(histogram, np.int64).T
    p = np.stack([*map(power, levels), *([np.full(len(b), uniform)] if uniform is not None else [])], 1)
    seen = np.bincount(b, n, BUCKETS)
    for _ in range(rounds):
        share = weights[b] * p
        share *= (n / np.maximum(share.sum(1), 1e-300))[:, None]
        new = np.stack([np.bincount(b, share[:, k], BUCKETS) for k in range(kinds)], 1)
        new = np.maximum(new, [0.0] + [1e-6] * (kinds - 1))
        weights = np.where((seen > 0)[:, None], new / new.sum(1, keepdims=True), weights)
    for k in range(2, BUCKETS):
        if not seen[k]:
            weights[k] = weights[k - 1]
    return weights


def fitted(cells: DataFrame, uniform: float) -> tuple[np.ndarray, np.ndarray]:
    """The weights of (pair, token, uniform) by the context of one word, and of (triple, that mixture) by that of two.

    cells: b3, b2, l3, l2, l1 and how many tokens n. Both histograms have at most BUCKETS * LEVELS * LEVELS rows.
    """
    rows = lambda df: [tuple(r) for r in df.collect()]
    lower = learn(rows(cells.groupBy("b2", "l2", "l1").agg(F.sum("n").alias("n"))), uniform)
    known = cells.sparkSession.createDataFrame([(k, *map(float, w)) for k, w in enumerate(lower)], "b2 int, w2 double, w1 double, w0 double")
    estimate = lambda q: F.when(F.col(q) > 0, F.pow(F.lit(2.0), (F.col(q) - (LEVELS - 1)) / 2)).otherwise(0.0)
    p = F.col("w2") * estimate("l2") + F.col("w1") * estimate("l1") + F.col("w0") * uniform
    of_p = F.greatest(F.lit(1), F.least(F.lit(LEVELS - 1), F.bround(2 * F.log2(p)) + LEVELS - 1)).cast("int")
    upper = cells.join(F.broadcast(known), "b2").groupBy("b3", "l3", of_p.alias("lp")).agg(F.sum("n").alias("n"))
    return lower, learn(rows(upper), None)


def score_texts(docs: DataFrame, keep: list[str], text: str = "text", key: str = "doc_id") -> DataFrame:
    """keep + held_out, n_tokens, n_known, train_tokens, base_score, score."""
    rows = carried(docs, keep, fold=fold_of(key, FOLDS).cast("int"), text=F.col(text).cast("string"))
    chunks = chunked(rows)
    sizes = chunks.select(F.col("chunk"), F.aggregate("rows", F.lit(0).cast("long"), lambda acc, r: acc + r["n"]).alias("n")).agg(F.count("*").alias("chunks"), F.sum("n").alias("n")).first()
    tasks, tokens = max(1, sizes.chunks), sizes.n or 0
    parts = max(MIN_PARTS, 1 << int(np.ceil(np.log2(max(1, tokens / PART_TOKENS)))))
    answers = written(asked_of(chunks, parts).repartition(tasks, "n", "part").groupBy("n", "part").applyInPandas(answer, ANSWERED))
    totals = answers.where("n = 1").agg(F.sum("total").alias("n"), F.sum("less_total").alias("less"), F.sum("distinct").alias("v")).first()
    total, kept_total, distinct = totals.n or 0, (totals.n or 0) - (totals.less or 0), totals.v or 0
    uniform = 1 / (distinct + 1)
    chunk_of = ["chunk", "tokens", "hashes", "rows"]
    dealt = lambda df, of: df.repartition(of, "chunk").groupBy("chunk")
    ratio = lambda a, b: a / np.maximum(b, 1)

    def weigh(_, chunk: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        if not len(chunk):
            return pd.DataFrame({c: pd.Series([], dtype="int64") for c in ("b3", "b2", "l3", "l2", "l1", "n")})
        _, (one, two, three), (of_two, of_three) = looked_up(chunk.iloc[0].to_dict(), replies, parts, True)
        code = buckets(of_three) * BUCKETS + buckets(of_two)
        for q in (level(ratio(three, of_three)), level(ratio(two, of_two)), level(one / max(1, kept_total))):
            code = code * LEVELS + q
        code, n = np.unique(code, return_counts=True)
        context, q = code // LEVELS**3, code % LEVELS**3
        return pd.DataFrame({"b3": context // BUCKETS, "b2": context % BUCKETS, "l3": q // LEVELS**2, "l2": q // LEVELS % LEVELS, "l1": q % LEVELS, "n": n})

    held, asked_back = chunks.where("deleted").select(*chunk_of), answers.where("deleted").select("chunk", "n", "part", "used", "less")
    cells = dealt(held, tasks).cogroup(dealt(asked_back, tasks)).applyInPandas(weigh, "b3 int, b2 int, l3 int, l2 int, l1 int, n long")
    cells = written(cells.groupBy("b3", "b2", "l3", "l2", "l1").agg(F.sum("n").alias("n")))
    lower, upper = fitted(cells, uniform)
    released(cells)
    schema = T.StructType([T.StructField(KEPT, chunks.schema[KEPT].dataType.elementType), *T._parse_datatype_string(f"fold int, {SCORES}").fields])

    def run(_, chunk: pa.Table, replies: pa.Table) -> pa.Table:
        row = {c: chunk[c][0].as_py() for c in chunk_of[1:]}
        found, (one, two, three), (of_two, of_three) = looked_up(row, replies.to_pandas(), parts, False)
        w, u = lower[buckets(of_two)], upper[buckets(of_three)]
        p = u[:, 0] * ratio(three, of_three) + u[:, 1] * (w[:, 0] * ratio(two, of_two) + w[:, 1] * (one / max(1, total)) + w[:, 2] * uniform)
        base = np.log10((one + 0.5) / (total + 0.5 * (distinct + 1)))
        add = lambda x: np.bincount(found.doc, x, len(found.sizes))
        back = chunk[KEPT].combine_chunks()
        columns = [back.flatten(), pa.array([r["fold"] for r in row["rows"]], pa.int32()), pa.array(found.sizes), pa.array(add(one > 0).astype(np.int64)), pa.array(add(base)), pa.array(add(np.log10(p)))]
        return pa.Table.from_arrays(columns, names=schema.names)

    replies = answers.select("chunk", "n", "part", "used")
    scored = dealt(chunks.select(*chunk_of, KEPT), tasks).cogroup(dealt(replies, tasks)).applyInArrow(run, schema)
    out = scored.select(KEPT, (F.col("fold") == TEST_FOLD).alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
    return restored(out, out.columns[1:])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: the score of every document."""
    return score_texts(table(spark, sf_dir, "documents"), ["doc_id"])
