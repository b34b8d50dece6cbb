"""Phrase collocations by language: word-id suffix arrays per shard, whose LCP intervals are n-gram counts, merged by phrase.

A shard is some millions of words of one language within a task. Prefix doubling sorts its places by the words that follow;
neighbours in that order that share k words or more form the interval of a k-gram, and its length is the k-gram's count there.
Counts are summed over shards by phrase.

A phrase of LEAST occurrences has only words and pairs of as many. So four passes over the texts count words, then pairs of
frequent words, then stretches of three to WORDS words inside frequent pairs (both by 64 bits of hash), and last the frequent
phrases are spelt, each by one of the partitions that hold it. Sixteen more bits tell stretches apart that share a hash; these
are spelt by all partitions and counted as they are spelt. Should the last pass find its texts dealt otherwise than the ones
before, all partitions spell all frequent phrases. What is frequent goes back to the shards as a bitmap of one size for any corpus (2 ** BITS
bits); where two share a bit, or where so many are frequent that the bitmap fills up, more is counted than needed, and the
counts stay exact.

Words are counted within pieces of a text, between punctuation marks and line ends. Null texts have no words, a null language
is `und`; repeated rows count as often as they stand. Very long texts are read whole and sorted in overlapping parts. An empty
table gives no phrases. Further columns aren't read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillguard.llm.common import pieces_of, released, table, written

WORDS, LEAST, TOP, SHARE, BITS, SHARD_WORDS = 5, 100, 2000, 100, 26, 1 << 22
UNKNOWN, EACH, PLACED = "und", -1, 64 - BITS
#: What ends a piece becomes a byte that no UTF-8 text has; letters A-Z become small ones.
BREAK = b"\xff"
FOLD = bytes(0xFF if c in b".,;:!?\n\x0b\x0c\r" else c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
MULT = np.uint64(0x9E3779B97F4A7C15)


class Shard:
    """Word ids of one language's texts, one behind another; 0 stands between pieces."""

    def __init__(self, lang: str):
        self.lang, self.parts, self.size = lang, [np.zeros(1, np.int32)], 1
        self.number: dict[bytes, int] = defaultdict(None, {BREAK: 0})
        self.number.default_factory = self.number.__len__

    def add(self, texts: list[str]) -> int:
        whole = "\n".join(texts).encode("utf-8", "replace").translate(FOLD).replace(BREAK, b" \xff ").split()
        self.parts += [np.fromiter(map(self.number.__getitem__, whole), np.int32, len(whole)), np.zeros(1, np.int32)]
        self.size += len(whole) + 1
        return len(whole) + 1

    def symbols(self) -> np.ndarray:
        return np.concatenate(self.parts)

    def words(self) -> list[str]:
        return ["" if w == BREAK else w.decode("utf-8", "replace") for w in self.number]

    def hashes(self) -> np.ndarray:
        """64 bits for each word id, the language's own."""
        seed = xxhash.xxh64_intdigest(self.lang.encode("utf-8", "replace"))
        return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in self.number), np.uint64, len(self.number))


def over_shards(docs: DataFrame, lang: str, text: str, emit: Callable[[Shard], Iterator[list]], schema: str, words: int = SHARD_WORDS) -> DataFrame:
    """What emit makes of each shard: lists of columns. A task holds the texts of at most so many words, and one more slice."""
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_type

    out = T._parse_datatype_string(schema)
    kinds = [(f.name, to_arrow_type(f.dataType)) for f in out.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flushed():
            for shard in held.values():
                for columns in emit(shard):
                    for i in range(0, len(columns[-1]), 1 << 16):
                        arrays = [pa.repeat(pa.scalar(c, k), min(1 << 16, len(columns[-1]) - i)) if isinstance(c, str) else pa.array(c[i : i + (1 << 16)], k) for c, (_, k) in zip(columns, kinds)]
                        yield pa.RecordBatch.from_arrays(arrays, names=[n for n, _ in kinds])

        held: dict[str, Shard] = {}
        size = 0
        for batch in batches:
            for part in pieces_of(batch, 1, 1 << 14):
                by: dict[str, list[str]] = {}
                for name, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    by.setdefault(name, []).append(t or "")
                for name, texts in by.items():
                    if name not in held:
                        held[name] = Shard(name)
                    size += held[name].add(texts)
                if size >= words:
                    yield from flushed()
                    held, size = {}, 0
        yield from flushed()

    rows = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(f"`{text}`").cast("string").alias("text"))
    return rows.mapInArrow(run, out)


def suffix_array(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Places in the order of the `depth` symbols from there, by prefix doubling."""
    rank, sorted_by = symbols.astype(np.int64), 1
    order = np.argsort(rank, kind="stable") if depth == 1 else rank
    while sorted_by < depth:
        step = min(sorted_by, depth - sorted_by)
        key = rank * (int(rank.max(initial=0)) + 1)
        key[: max(0, len(rank) - step)] += rank[step:]
        order = np.argsort(key, kind="stable")
        new = np.ones(len(order), np.int64)
        new[1:] = key[order][1:] != key[order][:-1]
        rank[order] = np.cumsum(new)
        sorted_by += step
    return order


def intervals(symbols: np.ndarray, shortest: int, longest: int, most: int = 2 * SHARD_WORDS) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(k, place, count) of each distinct stretch of k symbols without a 0, for each k: from the LCP intervals of the suffix
    array. Longer sequences are taken in parts, each with the symbols that its last stretches need."""
    for at in range(0, len(symbols), most):
        part = symbols[at : at + most + longest - 1]
        ends = np.append(np.flatnonzero(part == 0), len(part))
        left = ends[np.searchsorted(ends, np.arange(len(part)))] - np.arange(len(part))  # symbols up to the next 0
        order = suffix_array(part, longest)
        order = order[(left[order] >= shortest) & (order < most)]
        if not len(order):
            continue
        same, lcp, left = np.ones(len(order) - 1, bool), np.zeros(len(order), np.int64), left[order]
        padded = np.concatenate([part, np.zeros(longest, part.dtype)])
        for k in range(longest):
            here = padded[order + k]
            same &= (here[1:] == here[:-1]) & (here[1:] != 0)
            lcp[1:] += same
        for k in range(shortest, longest + 1):
            first = np.flatnonzero((lcp < k) & (left >= k))
            # an interval ends where the next begins, or before a row too short for it
            size = np.diff(np.append(np.searchsorted(np.flatnonzero(left >= k), first), np.count_nonzero(left >= k)))
            yield k, order[first] + at, size


def bitmap(hashes: DataFrame, h: str) -> bytes:
    """2 ** BITS bits, set at the first BITS bits of each hash; made in the tasks, in chunks."""
    at = hashes.select(F.shiftrightunsigned(h, 64 - BITS).alias("p"))
    chunks = at.groupBy(F.expr("cast(p div 32768 as int)").alias("c")).agg(F.bitmap_construct_agg(F.col("p") % 32768).alias("b"))
    out = bytearray(1 << BITS - 3)
    for r in chunks.collect():
        out[4096 * r.c : 4096 * (r.c + 1)] = r.b
    return bytes(out)


def marked(bits: bytes, hashes: np.ndarray) -> np.ndarray:
    at = (hashes >> np.uint64(64 - BITS)).astype(np.int64)
    return (np.frombuffer(bits, np.uint8)[at >> 3] >> (at & 7).astype(np.uint8)) & 1 != 0


def paired(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = first * MULT + second
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(29))


def chained(symbols: np.ndarray, good: np.ndarray, k: int) -> np.ndarray:
    """The stretches in which each k symbols are good, a 0 behind each; good: the places where such k begin."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], good.astype(np.int8), [0]])))
    size = edge[1::2] - edge[::2] + k
    at = np.repeat(edge[::2] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
    out = symbols[np.minimum(at, max(0, len(symbols) - 1))]
    out[np.cumsum(size) - 1] = 0
    return out


def frequent_words(shard: Shard, frequent: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The shard's symbols in stretches of frequent words, and the hashes of word ids."""
    h = shard.hashes()
    known = marked(frequent, h)
    known[0] = False
    symbols = shard.symbols()
    return chained(symbols, known[symbols], 1), h


def frequent_pairs(symbols: np.ndarray, h: np.ndarray, frequent: bytes) -> np.ndarray:
    """The stretches of the symbols whose pairs are frequent."""
    whole = (symbols[:-1] != 0) & (symbols[1:] != 0)
    at = np.flatnonzero(whole)
    whole[at] = marked(frequent, spelt_hash(symbols, h, at, 2))
    return chained(symbols, whole, 2)


def spelt_hash(symbols: np.ndarray, h: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    out = h[symbols[at]]
    for j in range(1, k):
        out = paired(out, h[symbols[at + j]])
    return out


def checked(symbols: np.ndarray, h: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Sixteen more bits of each stretch, to tell apart those that share a hash."""
    with np.errstate(over="ignore"):
        return (sum(h[symbols[at + j]] * np.uint64(2 * j + 3) ** np.uint64(5) for j in range(k)) >> np.uint64(48)).astype(np.uint16).view(np.int16)


def placed(h: Column, at: Column) -> Column:
    """A stretch's hash with the number of the partition that spells it in the bits that a bitmap reads."""
    return h.bitwiseXOR(F.shiftleft(at.cast("long"), PLACED))


def phrase_counts(docs: DataFrame, lang: str = "lang", text: str = "text", words: int = WORDS, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, k, f) of all phrases of at most `words` words that occur `least` times or more, and (lang, n): words of
    each language."""

    def of_words(shard):
        n = np.bincount(shard.symbols(), minlength=len(shard.number))[1:]
        yield [shard.lang, shard.words()[1:], shard.hashes()[1:].view(np.int64), n]

    every = written(over_shards(docs, lang, text, of_words, "lang string, phrase string, h long, n long").groupBy("lang", "phrase", "h").agg(F.sum("n").alias("f")))
    context = docs.sparkSession.sparkContext
    frequent = context.broadcast(bitmap(every.where(F.col("f") >= least), "h"))

    def of(symbols, h, shortest, longest):
        here = TaskContext.get().partitionId()
        for k, at, n in intervals(symbols, shortest, longest):
            x = spelt_hash(symbols, h, at, k)
            yield [x.view(np.int64), checked(symbols, h, at, k), np.full(len(at), here, np.int32), n]

    def often(of):
        """Frequent stretches by hash, written, and their bitmap: each with the one partition that is to spell it, or EACH where
        stretches that differ share the hash."""
        counts = over_shards(docs, lang, text, of, "h long, g smallint, o int, n long").groupBy("h")
        counts = counts.agg(F.sum("n").alias("f"), F.min("o").alias("o"), (F.min("g") == F.max("g")).alias("one")).where(F.col("f") >= least)
        counts = written(counts.select("h", "f", F.when(F.col("one"), F.col("o")).otherwise(F.lit(EACH)).alias("o")))
        return counts, context.broadcast(bitmap(counts, "h"))

    pairs, pair_bits = often(lambda shard: of(*frequent_words(shard, frequent.value), 2, 2))

    def inner(shard):
        symbols, h = frequent_words(shard, frequent.value)
        return frequent_pairs(symbols, h, pair_bits.value), h

    longer, _ = often(lambda shard: of(*inner(shard), 3, words))
    counts = pairs.withColumn("two", F.lit(True)).unionByName(longer.withColumn("two", F.lit(False)))

    def spelt(by_all: bool) -> DataFrame:
        """The frequent stretches as phrases: spelt by the partition that is to, or by all that hold them."""
        bits = context.broadcast(bitmap(counts.select(placed(F.col("h"), F.lit(0) if by_all else F.col("o")).alias("h")), "h"))

        def of_phrases(shard):
            symbols, h = inner(shard)
            names, here = shard.words(), 0 if by_all else TaskContext.get().partitionId()
            for k, at, n in intervals(symbols, 2, words):
                x = spelt_hash(symbols, h, at, k).view(np.int64)
                good = marked(bits.value, (x ^ here << PLACED).view(np.uint64))
                some = np.flatnonzero(good if by_all else good | marked(bits.value, (x ^ EACH << PLACED).view(np.uint64)))
                rows = np.stack([symbols[at[some] + j] for j in range(k)], 1).tolist()
                yield [shard.lang, [" ".join([names[w] for w in r]) for r in rows], np.full(len(rows), k), x[some], np.full(len(rows), here), n[some]]

        rows = over_shards(docs, lang, text, of_phrases, "lang string, phrase string, k int, h long, at int, n long").withColumn("two", F.col("k") == 2)
        if by_all:
            return rows.groupBy("lang", "phrase", "k", "h").agg(F.sum("n").alias("f"))
        met = rows.join(counts, ["h", "two"]).where((F.col("o") == F.col("at")) | (F.col("o") == EACH))
        # several shards of a partition may spell the same
        return met.groupBy("lang", "phrase", "k", "h").agg(F.when(F.max("o") == EACH, F.sum("n")).otherwise(F.max("f")).alias("f"))

    phrases = written(spelt(False))
    if phrases.select("h", F.col("k") == 2).distinct().count() < counts.count():  # the texts were dealt otherwise this time
        released(phrases)
        phrases = written(spelt(True))
    single = every.select("lang", "phrase", F.lit(1).alias("k"), "f")
    found = written(single.unionByName(phrases.drop("h")).where(F.col("f") >= least))
    totals = written(every.groupBy("lang").agg(F.sum("f").alias("n")))
    released(every, pairs, longer, phrases)
    return found, totals


def joined(words: Column, start: Column, size: Column) -> Column:
    return F.array_join(F.slice(words, start, size), " ")


def scored(found: DataFrame, totals: DataFrame, share: int = SHARE) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of phrases of two words or more, none inside a longer one that occurs nearly as often."""
    parts = found.select("lang", "phrase", "f")
    cuts = found.where("k > 1").select("lang", "phrase", "k", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    cut = cuts.withColumn("c", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    cut = cut.select("lang", "phrase", "a", "c", joined(F.col("w"), F.lit(1), F.col("c")).alias("first"), joined(F.col("w"), F.col("c") + 1, F.col("k") - F.col("c")).alias("rest"))
    cut = cut.join(parts.withColumnsRenamed({"phrase": "first", "f": "l"}), ["lang", "first"]).join(parts.withColumnsRenamed({"phrase": "rest", "f": "r"}), ["lang", "rest"]).join(totals, "lang")
    # 38 digits hold any of these products
    score = F.expr("(cast(1000 * a as decimal(19, 0)) * cast(n as decimal(18, 0))) div (cast(l as decimal(18, 0)) * cast(r as decimal(18, 0)))")
    lowest = cut.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(score.alias("score"), "c", "l", "r")).alias("s")).select("lang", "phrase", "a", "n", "s.score", "s.l", "s.r")
    size = cuts.where("k > 2").withColumn("m", F.explode(F.sequence(F.lit(2), F.col("k") - 1)))
    inner = size.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("m") + 1))).select("lang", joined(F.col("w"), F.col("i"), F.col("m")).alias("phrase"), "a")
    within = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    return lowest.join(within, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("longer") < share * F.col("a"), F.lit(True))).select("lang", "phrase", "a", "l", "r", "n", "score")


def collocations(docs: DataFrame, lang: str = "lang", text: str = "text", words: int = WORDS, least: int = LEAST, top: int = TOP, share: int = SHARE) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first phrases by score, count and spelling. A task keeps only as
    many rows of a language as are asked for before they meet."""
    found, totals = phrase_counts(docs, lang, text, words, least)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored(found, totals, share).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: each language's collocations over all documents."""
    return collocations(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS s FROM documents),
w AS (SELECT lang, regexp_extract_all(s, '[^\x20\x09]+') AS w FROM t),
n AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY 1),
g AS (SELECT lang, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM w, range(1, 6) x(k) WHERE len(w) >= k),
f AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS c FROM f WHERE k > 1),
s AS (SELECT c.lang, c.phrase, a, c, x.f AS l, y.f AS r, n, (CAST(1000 AS HUGEINT) * a * n) // (CAST(x.f AS HUGEINT) * y.f) AS score FROM c
    JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(w[:c], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(w[c + 1:], ' ') JOIN n ON n.lang = c.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
m AS (SELECT lang, k, f AS a, string_split(phrase, ' ') AS w, unnest(range(2, k)) AS m FROM f WHERE k > 2),
i AS (SELECT lang, a, m, w, unnest(range(1, k - m + 2)) AS i FROM m),
h AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS longer FROM i GROUP BY 1, 2),
r AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank FROM b LEFT JOIN h ON h.lang = b.lang AND h.phrase = b.phrase WHERE NOT coalesce(100 * longer >= 100 * a, false))
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM r WHERE rank <= 2000"""
