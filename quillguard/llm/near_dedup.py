"""Near-duplicate classes by ProbMinHash, banding and exact verification.

A text's shingles (five words, or all words of a shorter text) weigh by how often they occur: 1 for one occurrence, growing with
the logarithm up to 1.5. ProbMinHash draws, for each shingle, the arrivals of a Poisson process whose rate is the weight; each
arrival falls on one of COMPONENTS components, which keeps the shingle that arrived first. Two texts agree in a component with
the probability Jaccard similarity of their weighted shingles as chance. A process ends as soon as its next arrival is later
than every kept one.

Components are banded; texts that share a band are candidates, and a candidate pair is a link if the exact Jaccard
similarity of the shingle sets is SIMILARITY or more. Weights of 1.5 at most keep the probability Jaccard similarity of such a
pair near its plain one: at 0.74 or more where one text repeats what the other doesn't, at 0.68 where each repeats half of what
they share, so a pair of 0.8 shares a band with a chance of 0.9997 or 0.994. Equal texts are one class without any comparison.

No group is expanded into all pairs. Each band compares its members with one leader, the member that meets the most others
over its bands; a join spreads a large band. Members that aren't similar to their leader may still be similar to each other,
or to members that are, unless these lie too close to the leader: where those in question are of several classes, they are
banded again, by FINE_ROWS components of the plain shingle sets in
FINE_BANDS bands, which a pair of 0.8 shares with a chance of 0.93 and one of 0.5 with 0.001. Each of those bands again has a
leader, drawn anew for each band, and there are ROUNDS such rounds. So a member is compared at most BANDS + ROUNDS * FINE_BANDS
times, however large its group and whatever its shape.

Texts are told apart by 64 bits of hash, a text's shingles by 32 bits.

Null texts count as empty. Texts without words are classes by equality. Repeated rows (equal id and text) give one row
each. A null id is an id of its own, first in order. Very long texts are shingled whole. An empty table gives an empty
result. Further columns are ignored by classes_of and kept as they are by kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillguard.llm.common import KEPT, carried, map_texts, pieces_of, released, restored, table, written

WORDS, SIMILARITY, BANDS, ROWS, CACHE = 5, 0.8, 32, 5, 300_000
FINE_BANDS, FINE_ROWS, ROUNDS = 96, 16, 2
COMPONENTS = BANDS * ROWS
MULT = np.uint64(0x9E3779B97F4A7C15)


def scrambled(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Shingler:
    """Distinct shingle hashes of a text, with occurrences; word hashes are kept, at most CACHE of them."""

    def __init__(self, words: int = WORDS):
        self.words, self.kept = words, {}

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        words = text.encode("utf-8", "replace").split()
        if len(self.kept) > CACHE:
            self.kept.clear()
        kept = self.kept
        for w in words:
            if w not in kept:
                kept[w] = xxhash.xxh64_intdigest(w)
        h = np.array([kept[w] for w in words], np.uint64)
        if not len(h):
            return h, np.zeros(0, np.int64)
        k = min(self.words, len(h))
        out = np.zeros(len(h) - k + 1, np.uint64)
        with np.errstate(over="ignore"):
            for i in range(k):
                out = scrambled(out * MULT + h[i : len(h) - k + 1 + i])
        return np.unique(out, return_counts=True)


def by_logarithm(occurrences: np.ndarray) -> np.ndarray:
    return 1 + np.log(occurrences)


def bounded(occurrences: np.ndarray) -> np.ndarray:
    """1 for one occurrence, 1.5 for 55 or more."""
    return 1 + np.minimum(np.log(occurrences), 4) / 8


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], components: int = COMPONENTS, weight: Callable = by_logarithm) -> np.ndarray:
    """ProbMinHash signatures of many sets (shingles, occurrences), weighted by their occurrences: the kept shingle of each
    component (0 for empty sets)."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s, _ in sets])
    kept = np.zeros((n, components), np.uint64)
    first = np.full((n, components), np.inf)
    if not len(owner):
        return kept
    item = np.concatenate([s for s, _ in sets])
    rate = weight(np.concatenate([c for _, c in sets]))
    state, time, flat_first, flat_kept = item.copy(), np.zeros(len(item)), first.ravel(), kept.ravel()
    with np.errstate(over="ignore"):
        while len(item):
            state = state + MULT
            draw = scrambled(state)
            time = time - np.log1p(-((draw >> np.uint64(11)).astype(np.float64) * 2.0**-53)) / rate
            live = time < first.max(1)[owner]  # the process ends once it is later than every kept arrival
            item, rate, state, time, owner, draw = item[live], rate[live], state[live], time[live], owner[live], draw[live]
            cell = owner * components + (scrambled(draw ^ MULT) % np.uint64(components)).astype(np.int64)
            order = np.lexsort((item, time))[::-1]  # the earliest arrival is written last
            cell_, time_, item_ = cell[order], time[order], item[order]
            better = time_ < flat_first[cell_]
            flat_first[cell_[better]] = time_[better]
            flat_kept[cell_[better]] = item_[better]
    return kept


def bands_of(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One hash a band, with the band's number in it."""
    rows = signature.reshape(len(signature), bands, -1)
    out = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), rows.shape[:2]).copy()
    with np.errstate(over="ignore"):
        for r in range(rows.shape[2]):
            out = scrambled(out * MULT + rows[:, :, r])
    return out.view(np.int64)


def sketched(docs: DataFrame, keep: list[str], text: str = "text", words: int = WORDS) -> DataFrame:
    """keep + shingles (how many) and bands (none without words)."""

    def make():
        shingler = Shingler(words)

        def work(texts):
            sets = [shingler(t) for t in texts]
            bands = bands_of(signatures(sets, weight=bounded))
            return [[len(s) for s, _ in sets], [b if len(s) else [] for b, (s, _) in zip(bands, sets)]]

        return work

    return map_texts(docs, make, "shingles int, bands array<long>", keep, text)


def overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, n_a, n_b and common: how many shingles each has, and both."""
    one = pairs.select("a", "b").join(sets.withColumnsRenamed({"rep": "b", "set": "set_b"}), "b")
    both = one.join(sets.withColumnsRenamed({"rep": "a", "set": "set_a"}), "a").select("a", "b", "set_a", "set_b")
    schema = T.StructType([*both.schema.fields[:2], *T._parse_datatype_string("n_a int, n_b int, common int").fields])

    def run(batches):
        for batch in batches:
            for part in pieces_of(batch, 2, 512):
                found = []
                for x, y in zip(part.column(2).to_pylist(), part.column(3).to_pylist()):
                    x, y = np.frombuffer(x, np.int32), np.frombuffer(y, np.int32)
                    found.append((len(x), len(y), len(np.intersect1d(x, y, assume_unique=True))))
                yield pa.RecordBatch.from_arrays([*part.columns[:2], *(pa.array(c, pa.int32()) for c in zip(*found))], names=schema.names)

    return both.mapInArrow(run, schema)


def similar(similarity: float) -> str:
    """Whether an overlap is a link, in whole numbers where the similarity is a hundredth."""
    return f"common * {100 + round(100 * similarity)} >= {round(100 * similarity)} * (n_a + n_b)"


def merged(classes: DataFrame, links: DataFrame) -> DataFrame:
    """(rep, cls): classes after their members' links, each class named by its least member.

    Classes are contracted first, then labels spread to the least neighbour and jump to that one's own label, so the
    number of rounds grows with the logarithm of a chain's length.
    """
    named = links.join(classes.withColumnsRenamed({"rep": "a", "cls": "x"}), "a").join(classes.withColumnsRenamed({"rep": "b", "cls": "y"}), "b").where("x != y").select("x", "y").distinct()
    edges = written(named.union(named.select("y", "x")))
    if edges.isEmpty():
        return classes
    before = labels = written(edges.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("l")))
    while True:
        near = edges.join(labels.withColumnRenamed("x", "y"), "y").groupBy("x").agg(F.min("l").alias("m"))
        spread = labels.join(near, "x").select("x", F.least("l", "m").alias("l"))
        jumped = spread.join(labels.select(F.col("x").alias("l"), F.col("l").alias("ll")), "l", "left").select("x", F.least("l", F.coalesce("ll", "l")).alias("n"))
        new = written(jumped.join(labels, "x").select("x", F.col("n").alias("l"), (F.col("n") != F.col("l")).alias("changed")))
        released(before)
        before, labels = new, new.select("x", "l")
        if new.where("changed").isEmpty():
            break
    out = written(classes.join(labels.withColumnRenamed("x", "cls"), "cls", "left").select("rep", F.coalesce("l", "cls").alias("cls")))
    released(before, edges)
    return out


def led(members: DataFrame, *order: Column) -> DataFrame:
    """members (band, rep) with b, the band's leader: the last one in order."""
    leader = members.groupBy("band").agg(F.max(F.struct(*order, "rep")).alias("lead")).select("band", F.col("lead.rep").alias("b"))
    return members.join(leader, "band").select("band", "rep", "b")


def links_of(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    return written(overlaps(pairs, sets).where(similar(similarity)).select("a", "b"))


def unresolved(compared: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """(rep, cls) of members (a, b, and their overlap with the leader b) that may have links among themselves: those of a leader
    with a member that isn't similar to it (far), where they are of several classes.

    By the triangle inequality of the Jaccard distance a member that is closer to the leader than all far ones, by more than
    a link allows, has no link with any of them.
    """
    named = compared.withColumn("j", F.expr("common / (n_a + n_b - common)")).join(classes.withColumnRenamed("rep", "a"), "a").select("a", "b", "j", "cls", F.expr(similar(similarity)).alias("near"))
    far = named.where("not near").groupBy("b").agg(F.max("j").alias("far"))
    kept = named.join(far, "b").where(f"j <= far + {1 - similarity + 1e-9}").select("b", F.col("a").alias("rep"), "cls")
    mixed = kept.groupBy("b").agg(F.min("cls").alias("x"), F.max("cls").alias("y")).where("x <> y").select("b")
    return kept.join(mixed, "b", "left_semi").select("rep", "cls").distinct()


def fine_members(sets: DataFrame, turn: int) -> DataFrame:
    """(band, rep, cls) of texts (rep, set, cls) in finer bands than the first, other ones each turn."""
    seed = np.uint64(turn * 0x51ED2701 + 1)

    def run(batches):
        for batch in batches:
            for part in pieces_of(batch, 2, 128):
                found = [scrambled(np.frombuffer(x, np.int32).view(np.uint32).astype(np.uint64) * MULT + seed) for x in part.column(2).to_pylist()]
                bands = bands_of(signatures([(x, np.ones(len(x))) for x in found], FINE_BANDS * FINE_ROWS), FINE_BANDS)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(list(bands), pa.list_(pa.int64()))], names=["rep", "cls", "bands"])

    fine = sets.select("rep", "cls", "set").mapInArrow(run, "rep long, cls long, bands array<long>")
    return fine.select(F.explode("bands").alias("band"), "rep", "cls")


def found_again(compared: DataFrame, sets: DataFrame, classes: DataFrame, similarity: float, turn: int) -> DataFrame:
    """Links (a, b) between members that their leaders left in several classes."""
    left = written(unresolved(compared, classes, similarity))
    fine = written(fine_members(sets.join(left, "rep"), turn))
    mixed = fine.groupBy("band").agg(F.min("cls").alias("x"), F.max("cls").alias("y")).where("x <> y").select("band")
    met = fine.join(mixed, "band", "left_semi")
    named = left.withColumnsRenamed({"rep": "b", "cls": "cls_b"})
    pairs = led(met.select("band", "rep"), F.xxhash64("band", "rep")).select(F.col("rep").alias("a"), "b").distinct()
    apart = pairs.join(left.withColumnRenamed("rep", "a"), "a").join(named, "b").where("cls <> cls_b")
    links = links_of(apart, sets, similarity)
    released(fine, left)
    return links


def classes_of(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """(key, text64, class_id, cls, copies, links): a row per row of docs.

    class_id: the least key of the class; cls: the class's own hash, for keys that aren't unique; copies: rows with an
    equal text; links: verified links found for the text; text64: xxhash64 of the text, to find the row again.
    """
    hashed = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text")).withColumn("rep", F.xxhash64(F.coalesce("text", F.lit(""))))
    rows = written(sketched(hashed, ["id", "rep"], "text", words))
    reps = written(rows.groupBy("rep").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("bands").alias("bands")))
    members = reps.select("rep", F.explode("bands").alias("band"))
    shared = members.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    members = members.join(shared, "band")
    meets = members.groupBy("rep").agg(F.sum("n").alias("met"))
    members = written(led(members.join(meets, "rep"), F.col("met")))
    classes = written(members.select("rep").distinct().withColumn("cls", F.col("rep")))
    wanted = reps.join(classes, "rep", "left_semi").select("rep", "id")  # one row a text

    def make():
        shingler = Shingler(words)
        return lambda texts: [[np.unique(shingler(t)[0].astype(np.uint32)).view(np.int32).tobytes() for t in texts]]

    chosen = hashed.alias("d").join(wanted.alias("w"), F.expr("d.rep = w.rep and d.id <=> w.id"), "left_semi")
    sets = map_texts(chosen, make, "`set` binary", ["rep"])
    if not rows.groupBy("rep", "id").count().where("count > 1").isEmpty():  # equal rows
        sets = sets.dropDuplicates(["rep"])
    sets = written(sets)
    pairs = members.where("rep <> b").select(F.col("rep").alias("a"), "b").distinct()
    compared = written(overlaps(pairs, sets))
    found = [compared.where(similar(similarity)).select("a", "b")]
    classes = merged(classes, found[0])
    for turn in range(ROUNDS):
        found.append(found_again(compared, sets, classes, similarity, turn))
        classes = merged(classes, found[-1])
    links = reduce(DataFrame.union, found).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    degree = links.select("a").union(links.select("b")).groupBy("a").agg(F.count("*").alias("links")).withColumnRenamed("a", "rep")
    of_rep = reps.select("rep", "id", "copies").join(classes, "rep", "left").join(degree, "rep", "left")
    of_rep = written(of_rep.withColumn("cls", F.coalesce("cls", "rep")))
    released(sets, members)
    least = of_rep.groupBy("cls").agg(F.min("id").alias("class_id"))
    named = of_rep.join(least, "cls").select("rep", "class_id", "cls", "copies", F.coalesce("links", F.lit(0)).cast("long").alias("links"))
    return rows.select("id", "rep").join(named, "rep").select(F.col("id").alias(key), F.col("rep").alias("text64"), "class_id", "cls", "copies", "links")


def kept(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, all columns, with one row of each class: that of the least key, then of the least text hash."""
    classes = written(classes_of(docs, key, text).select(F.col(key).alias("id"), "text64", "cls"))
    first = F.struct(F.col("id").isNotNull(), "id", "text64")
    chosen = written(classes.groupBy("cls").agg(F.min(first).alias("row")).select("row.id", "row.text64"))
    rows = carried(docs, docs.columns, id=F.col(key), text64=F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit(""))))
    found = rows.alias("r").join(chosen.alias("c"), F.expr("r.id <=> c.id and r.text64 = c.text64"), "left_semi")
    if not classes.groupBy("id", "text64").count().where("count > 1").isEmpty():  # equal rows: one stays
        found = found.dropDuplicates(["id", "text64"])
    return restored(found, [])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: the near-duplicate class of every document."""
    return classes_of(table(spark, sf_dir, "documents")).select("doc_id", "class_id", (F.col("doc_id") == F.col("class_id")).alias("is_kept"), "copies", "links")
