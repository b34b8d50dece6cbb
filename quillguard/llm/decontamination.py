"""Passages of a test set inside training documents, by an FM-index of each training shard.

A shard is a few MB of documents within a task. Its words become the symbols of a suffix array; the Burrows-Wheeler transform
of that, in a wavelet tree of bit rows, answers how often a symbol stands before a row. All windows of the test set are
searched backwards at once, a symbol a step, and drop out as soon as their range of rows is empty. What is left is located by
walking back to a sampled suffix position, and occurrences are merged into spans to remove.

A window is WINDOW consecutive words of an item; an item of fewer, but not none, is one window. Words that no item has can't be
part of an occurrence, nor can stretches of known words shorter than the shortest window: they are breaks in the shard's
sequence, which keeps the index small where there is little to find. Nothing else is left out.

The test set is read in blocks of BLOCK_WORDS words, whose windows are broadcast; each further block is one more pass over the
documents. Documents, however many, are never shuffled.

Null texts have no words. Items without words are no windows. Rows of one item id are one item; a null id counts as the text
''. Repeated documents each give a row. Very long texts are read whole; their sequence is indexed in overlapping parts. Empty
tables give no rows, or no hits. Columns of any names are carried.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillguard.llm.common import KEPT, carried, map_texts, released, restored, table, written

WINDOW, SHARD_WORDS, BLOCK_WORDS, SAMPLE = 10, 1 << 20, 1 << 18, 16
#: Words are runs of digits, letters and anything beyond ASCII, in lower case; all other ASCII bytes stand between them.
FOLD = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c > 0x7F else c + 32 if 0x41 <= c <= 0x5A else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(FOLD).split()


class Bits:
    """A row of bits that tells how many are set before a place."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.zeros(len(self.words), np.int32)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) != 0

    def ones(self, at: np.ndarray) -> np.ndarray:
        low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[at >> 6] + np.bitwise_count(self.words[at >> 6] & low).astype(np.int64)


class WaveletTree:
    """A sequence of symbols below 2 ** levels, one row of bits a level, the highest bit first: below each level stand the
    symbols with a 0 there, then those with a 1, each in their order."""

    def __init__(self, symbols: np.ndarray, levels: int):
        self.rows: list[tuple[Bits, int, int]] = []
        for level in range(levels - 1, -1, -1):
            bit = (symbols >> level) & 1 != 0
            zeros = symbols[~bit]
            self.rows.append((Bits(bit), len(zeros), level))
            symbols = np.concatenate([zeros, symbols[bit]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its place."""
        start = np.zeros(len(at), np.int64)
        for bits, zeros, level in self.rows:
            right = (symbol >> level) & 1 != 0
            a, s = bits.ones(at), bits.ones(start)
            at, start = np.where(right, zeros + a, at - a), np.where(right, zeros + s, start - s)
        return at - start

    def symbol_and_rank(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place, and how often it stands before."""
        symbol, start = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        for bits, zeros, level in self.rows:
            right = bits[at]
            symbol |= right.astype(np.int64) << level
            a, s = bits.ones(at), bits.ones(start)
            at, start = np.where(right, zeros + a, at - a), np.where(right, zeros + s, start - s)
        return symbol, at - start


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Places in the order of their suffixes. Each break (0) is a symbol of its own, in order of place, before all others, and
    the sequence ends with one; so no order depends on what stands behind a break."""
    n = len(symbols)
    breaks = symbols == 0
    width = int(symbols.max(initial=0)).bit_length()
    key, ended, depth = symbols.astype(np.int64), symbols == 0, 1
    if 3 * width <= 62:  # three symbols in one key; behind a break nothing counts
        for _ in range(2):
            behind = np.concatenate([symbols[depth:], np.zeros(min(depth, n), symbols.dtype)])
            ended |= behind == 0
            key, depth = (key << width) | np.where(ended, 0, behind), depth + 1
        key[breaks] = 0
    order = np.argsort(key, kind="stable")
    # what reaches a break within its key is in order already: breaks are told apart by their places
    new = np.ones(n, bool)
    new[1:] = key[order][1:] != key[order][:-1]
    new[ended[order]] = True
    rank = np.empty(n, np.int64)
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]
    while True:
        # a group: the rows of one rank. Only those of more than one row are sorted on, by the rank `depth` places further
        start = np.flatnonzero(new)
        size = np.diff(np.concatenate([start, [n]]))
        open_ = np.repeat(size > 1, size)
        if not open_.any():
            return order
        rows = np.flatnonzero(open_)
        at = order[rows]
        key = rank[at] * n + rank[at + depth]
        sorted_ = np.argsort(key, kind="stable")
        order[rows], key = at[sorted_], key[sorted_]
        changed = np.ones(len(rows), bool)
        changed[1:] = key[1:] != key[:-1]
        new[rows] = changed
        rank[order[rows]] = rows[np.flatnonzero(changed)[np.cumsum(changed) - 1]]
        depth *= 2


class FMIndex:
    """Backward search over a sequence of symbols, in which 0 is a break."""

    def __init__(self, symbols: np.ndarray, most: int):
        symbols = np.concatenate([symbols, [0]]) if not len(symbols) or symbols[-1] else symbols
        order = suffix_array(symbols)
        before = np.concatenate([[0], symbols[:-1]])  # the symbol before each place
        self.below = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=most + 1))])
        self.tree = WaveletTree(before[order], max(1, int(most).bit_length()))
        sampled = (order % SAMPLE == 0) | (before[order] == 0)  # every walk ends at a break
        self.sampled, self.places = Bits(sampled), order[sampled]

    def ranges(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(which, low, high): the patterns (a row each) that occur, and their rows of the suffix array."""
        which, last = np.arange(len(patterns)), patterns[:, -1].astype(np.int64)
        low, high = self.below[last], self.below[last + 1]
        for step in range(patterns.shape[1] - 2, -1, -1):
            some = high > low
            which, low, high = which[some], low[some], high[some]
            c = patterns[which, step].astype(np.int64)
            low, high = self.below[c] + self.tree.rank(c, low), self.below[c] + self.tree.rank(c, high)
        some = high > low
        return which[some], low[some], high[some]

    def located(self, rows: np.ndarray) -> np.ndarray:
        """The places of rows of the suffix array."""
        out, steps, left = np.zeros(len(rows), np.int64), 0, np.arange(len(rows))
        while len(left):
            found = self.sampled[rows]
            out[left[found]] = self.places[self.sampled.ones(rows[found])] + steps
            left, rows = left[~found], rows[~found]
            symbol, rank = self.tree.symbol_and_rank(rows)
            rows, steps = self.below[symbol] + rank, steps + 1
        return out


class Windows:
    """The distinct windows of a block of items, by length, and which items have each."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        vocabulary: dict[bytes, int] = defaultdict()
        vocabulary.default_factory = lambda: len(vocabulary) + 1
        number: dict[bytes, dict[int, int]] = {}
        of: list[list[int]] = []
        self.names = [i for i, _ in items]
        for name, (_, text) in enumerate(items):
            ids = np.fromiter(map(vocabulary.__getitem__, words_of(text)), np.int32)
            size = min(window, len(ids))
            for i in range(len(ids) - size + 1 if size else 0):
                w = number.setdefault(ids[i : i + size].tobytes(), len(of))
                if w == len(of):
                    of.append([])
                if not of[w] or of[w][-1] != name:
                    of[w].append(name)
        self.vocabulary = dict(vocabulary)
        by_size: dict[int, tuple[list[bytes], list[int]]] = {}
        for key, w in number.items():
            patterns, at = by_size.setdefault(len(key) // 4, ([], []))
            patterns.append(key)
            at.append(w)
        self.by_size = [(n, np.frombuffer(b"".join(p), np.int32).reshape(-1, n), np.array(at)) for n, (p, at) in sorted(by_size.items())]
        self.first = np.concatenate([[0], np.cumsum([len(x) for x in of])]).astype(np.int64)
        self.items = np.array([x for xs in of for x in xs], np.int64)
        self.shortest = min(by_size, default=0)

    def occurrences(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, length, window) of every occurrence in a sequence with breaks."""
        found = [np.zeros((3, 0), np.int64)]
        index = FMIndex(symbols, len(self.vocabulary))
        for size, patterns, number in self.by_size:
            which, low, high = index.ranges(patterns)
            n = high - low
            rows = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            found.append(np.stack([index.located(rows), np.full(len(rows), size), np.repeat(number[which], n)]))
        return tuple(np.concatenate(found, 1))

    def hits(self, texts: list[str]) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray, list[list[str]]]:
        """For each text: number of words; the merged spans of all occurrences (owner, start, end: in words); items found."""
        get = self.vocabulary.get
        n_words, parts = [], []
        for t in texts:
            words = words_of(t)
            n_words.append(len(words))
            parts.append(np.fromiter(map(get, words, repeat(0)), np.int32, len(words)))
            parts.append(np.zeros(1, np.int32))
        symbols = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        first = np.concatenate([[0], np.cumsum(np.array(n_words, np.int64) + 1)])  # each text ends with a break
        edge = np.flatnonzero(np.diff(np.concatenate([[0], (symbols != 0).astype(np.int8), [0]])))
        begin, end = edge[::2], edge[1::2]
        long = end - begin >= max(1, self.shortest) if self.by_size else np.zeros(len(begin), bool)
        begin, end = begin[long], end[long]
        # the long stretches one behind another, each with a break behind it; `at`: where their words stood
        size = end - begin + 1
        at = np.repeat(begin - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        dense = symbols[at].astype(np.int64)
        dense[np.cumsum(size) - 1] = 0
        covered, pairs = np.zeros(len(symbols) + 1, np.int64), [np.zeros((2, 0), np.int64)]
        longest = max((n for n, _, _ in self.by_size), default=1)
        for i in range(0, len(dense), SHARD_WORDS):
            place, n, window = self.occurrences(dense[i : i + SHARD_WORDS + longest - 1])
            place = at[place + i]
            np.add.at(covered, place, 1)
            np.add.at(covered, place + n, -1)
            pairs.append(np.unique(np.stack([np.searchsorted(first, place, "right") - 1, window]), axis=1))
        edge = np.flatnonzero(np.diff(np.concatenate([[0], (np.cumsum(covered[:-1]) > 0).astype(np.int8), [0]])))
        owner = np.searchsorted(first, edge[::2], "right") - 1
        doc, window = np.concatenate(pairs, 1)
        n = self.first[window + 1] - self.first[window]
        item = self.items[np.repeat(self.first[window] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]
        names: list[set[str]] = [set() for _ in texts]
        for d, i in np.unique(np.stack([np.repeat(doc, n), item]), axis=1).T.tolist():
            names[d].add(self.names[i])
        return n_words, owner, edge[::2] - first[owner], edge[1::2] - first[owner], [sorted(x) for x in names]


def blocks_of(items: DataFrame, item: str, text: str, window: int) -> list:
    """The test set's windows, broadcast in blocks of at most BLOCK_WORDS words (one longer item is a block)."""
    block, held, out = [], 0, []
    context = items.sparkSession.sparkContext
    rows = items.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("i"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t")).orderBy("i", "t")
    for r in rows.toLocalIterator():
        n = len(words_of(r.t))
        if block and held + n > BLOCK_WORDS:
            out.append(context.broadcast(Windows(block, window)))
            block, held = [], 0
        block.append((r.i, r.t))
        held += n
    return [*out, context.broadcast(Windows(block, window))]


def union_of(spans: Column) -> Column:
    """Spans merged where they overlap or touch: a merged one begins where as many ended before as began, and ends before the
    next."""
    starts, ends = F.array_sort(F.transform(spans, lambda s: s["start"])), F.array_sort(F.transform(spans, lambda s: s["end"]))
    cuts = F.filter(F.sequence(F.lit(0), F.size(spans)), lambda i: (i == 0) | (i == F.size(spans)) | (F.get(ends, i - 1) < F.get(starts, i)))
    whole = F.transform(F.slice(cuts, 1, F.size(cuts) - 1), lambda c, k: F.struct(F.get(starts, c).alias("start"), F.get(ends, F.get(cuts, k + 1) - 1).alias("end")))
    return F.when(F.size(spans) > 0, whole).otherwise(spans)


def contamination(docs: DataFrame, items: DataFrame, keep: list[str], text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """keep, n_words, spans (array<struct<start,end>> of hit words, end exclusive, merged) and items (ids with occurring
    windows, sorted)."""
    rows = carried(docs, keep, text=F.col(f"`{text}`").cast("string"))
    rows = rows.withColumns({"n_words": F.lit(None).cast("long"), "spans": F.expr("cast(array() as array<struct<start:long,end:long>>)"), "items": F.expr("cast(array() as array<string>)")})
    blocks = blocks_of(items, item, item_text, window)
    before = None
    for k, block in enumerate(blocks):

        def make(block=block):
            def work(texts):
                n, owner, start, end, names = block.value.hits(texts)
                first = pa.array(np.searchsorted(owner, np.arange(len(texts) + 1)), pa.int32())
                spans = pa.ListArray.from_arrays(first, pa.StructArray.from_arrays([pa.array(start, pa.int64()), pa.array(end, pa.int64())], ["start", "end"]))
                return [pa.array(n, pa.int64()), spans, names]

            return work

        last = k == len(blocks) - 1
        state = [KEPT, "spans", "items"] + ([] if last else ["text"])
        found = map_texts(rows, make, "__n long, __spans array<struct<start:long,end:long>>, __items array<string>", state, "text", 1 << 14)
        rows = found.select(KEPT, *([] if last else ["text"]), F.col("__n").alias("n_words"), F.concat("spans", "__spans").alias("spans"), F.concat("items", "__items").alias("items"))
        if not last:  # the next block's pass reads what this one wrote
            rows = written(rows)
            if before is not None:
                released(before)
            before = rows
    merged = rows.withColumns({"spans": union_of(F.col("spans")), "items": F.array_sort(F.array_distinct("items"))})
    return restored(merged, ["n_words", "spans", "items"])


def without_spans(df: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """df with the spans of words cut out of its texts; what stands between words stays as it is."""
    word = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    t = F.coalesce(F.col(text), F.lit(""))
    gaps = F.split(t, word, -1)
    words = F.regexp_extract_all(t, F.lit(word), F.lit(0))
    at = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(F.col(spans), i - 1)["end"]).cast("int")
    until = lambda i: F.when(i == F.size(spans), F.size(words)).otherwise(F.get(F.col(spans), i)["start"]).cast("int")
    stretch = lambda i: F.array_join(F.zip_with(F.slice(words, at(i) + 1, until(i) - at(i)), F.slice(gaps, at(i) + 2, until(i) - at(i)), lambda w, g: F.concat(w, g)), "")
    left = F.concat(F.get(gaps, F.lit(0)), F.array_join(F.transform(F.sequence(F.lit(0), F.size(spans)), stretch), ""))
    return df.withColumn(text, F.when(F.size(spans) > 0, left).otherwise(F.col(text)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: words of every document inside windows of benchmark items, and which items."""
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


#: The same by windows as strings, one join for each length of window.
ORACLE = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (SELECT item, least(len(w), 10) AS m, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0),
x AS (SELECT DISTINCT item, m, array_to_string(w[i:i + m - 1], ' ') AS g FROM p),
s AS (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM x) WHERE len(w) >= m),
h AS (SELECT s.r, s.i, s.m, x.item FROM (SELECT r, i, m, array_to_string(w[i:i + m - 1], ' ') AS g FROM s) s JOIN x USING (m, g)),
c AS (SELECT r, count(*) AS n FROM (SELECT DISTINCT r, unnest(range(i, i + m)) AS k FROM h) GROUP BY 1),
t AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS l FROM (SELECT DISTINCT r, item FROM h) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(c.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(t.n, 0) AS BIGINT) AS n_items, sha256(coalesce(t.l, '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN t USING (r)"""
