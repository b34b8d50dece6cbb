"""Best-fit packing by exact-complement hashing.

What is packed is a histogram of piece lengths, at most `room` numbers however large the corpus: the plan, a list of
(lengths, how many sequences), is made of them on the driver. For each length, longest first, the gap that it leaves is
looked up among the single lengths, the sums of two and the sums of three that are still available; combinations that
fill it exactly are consumed as often as the counts allow. What has no exact complement is packed best-fit decreasing,
also by counts. The plan and the slots it gives each length (a few times `room` intervals) are broadcast.

Pieces find their slot by their rank within their length. Ranks come without any task seeing a whole length: pieces are
dealt into even buckets by the hash of a number written with each, numbered inside their bucket and length, and moved up by
the counts of earlier buckets.

Null text counts as empty: one token, the end id. Repeated rows are repeated pieces. Documents longer than `room` are
cut into full pieces; only the first may be shorter. An empty table gives an empty result. Kept
columns keep their values whatever their names (common.restored); other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql import types as T

from quillguard.llm.common import KEPT, carried, map_texts, restored, table, written
from quillguard.llm.token_counts import vocabulary

ROOM, END_ID, MODEL, RANKS, CACHE, BUCKET_ROWS = 2048, 0, "byte_bpe_50k.json", "byte_bpe_50k.tiktoken", 400_000, 20_000
BETWEEN = re.compile(r"(?<=\S) (?=\S)")
UNUSUAL = re.compile(r"<\||[^\t\n\r -~\u00a1-\u024f]")
BLANK_RUN = re.compile(r"\s\s|\A\s|\s\Z")


class IdEncoder:
    """Token ids as little-endian 32-bit bytes.

    Latin texts without the special token go to tiktoken, which has the same vocabulary as ranks and the same split
    (tests hold both against each other), and is faster. Other texts are cut at single spaces between two non-blanks,
    which the pre-tokenizer puts at the start of what follows, and each part is encoded once and kept, at most CACHE.
    """

    def __init__(self, path: str, ranks: str | None = None):
        from tokenizers import Tokenizer

        self.tokenizer, self.kept, self.ranked = Tokenizer.from_file(path), {}, None
        if ranks:
            import base64
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as lines:
                merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.ranked = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})

    @staticmethod
    def parts(text: str) -> list[str]:
        first, *rest = BETWEEN.split(text) if BLANK_RUN.search(text) else text.split(" ")
        return [first, *(" " + x for x in rest)]

    def encode(self, texts: list[str]) -> list[bytes]:
        plain = [self.ranked is not None and not UNUSUAL.search(t) for t in texts]
        rest = iter(self.encode_parts([t for t, p in zip(texts, plain) if not p]))
        return [array("I", self.ranked.encode_ordinary(t)).tobytes() if p else next(rest) for t, p in zip(texts, plain)]

    def encode_parts(self, texts: list[str]) -> list[bytes]:
        split = [self.parts(t) if t else [] for t in texts]
        missing = list({p for x in split for p in x if p not in self.kept})
        if len(self.kept) + len(missing) > CACHE:
            self.kept = {}
            missing = list({p for x in split for p in x})
        for p, e in zip(missing, self.tokenizer.encode_batch_fast(missing, add_special_tokens=False)):
            self.kept[p] = np.asarray(e.ids, "<u4").tobytes()
        return [b"".join(map(self.kept.__getitem__, x)) for x in split]


def pieces(docs: DataFrame, keep: list[str], text: str = "text", room: int = ROOM, end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """KEPT + piece, start, length, ids_crc32 of every piece of every document."""
    ranks = None if path else vocabulary(RANKS)
    path = path or vocabulary(MODEL)

    def make():
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder, end = IdEncoder(path, ranks), np.asarray([end_id], "<u4").tobytes()

        def work(texts):
            out = []
            for ids in encoder.encode(texts):
                ids += end
                n = len(ids) // 4
                cuts = [0, *range(n % room or room, n + 1, room)] if n > room else [0, n]
                out.append([{"piece": i, "start": a, "length": b - a, "ids_crc32": zlib.crc32(ids[4 * a : 4 * b])} for i, (a, b) in enumerate(zip(cuts, cuts[1:]))])
            return [out]

        return work

    made = map_texts(carried(docs, keep, text=F.col(text)), make, "pieces array<struct<piece:int,start:long,length:long,ids_crc32:long>>", [KEPT])
    return made.select(KEPT, F.inline("pieces"))


def plan(counts: dict[int, int], room: int = ROOM) -> list[tuple[tuple[int, ...], int]]:
    """(lengths that share a sequence, number of such sequences)."""
    left = [0] * (room + 1)
    for n, c in counts.items():
        left[n] = c
    out, rest = [], {}
    bits, sums = sum(1 << n for n in range(1, room + 1) if left[n]), None  # lengths available; sums of two of them

    def take(lengths: tuple[int, ...]) -> bool:
        nonlocal bits, sums
        need = Counter(lengths)
        m = min(left[n] // k for n, k in need.items())
        if m <= 0:
            return False
        for n, k in need.items():
            left[n] -= m * k
            if not left[n]:
                bits, sums = bits & ~(1 << n), None
        out.append((lengths, m))
        return True

    def lengths_in(mask: int) -> list[int]:
        return [m.start() for m in re.finditer("1", bin(mask)[:1:-1])][::-1]

    def reversed_at(gap: int, mask: int) -> int:
        """Bit n is set if mask has gap - n."""
        s = bin(mask & ((1 << gap + 1) - 1))[2:].zfill(gap + 1)
        return int(s[::-1], 2)

    def pair(gap: int, of: int) -> tuple[int, int] | None:
        both = bits & reversed_at(gap, bits) & ((1 << gap) - 2)
        for a in lengths_in(both):
            b = gap - a
            if a < b:
                break
            need = Counter((a, b, *([of] if of else [])))
            if all(left[n] >= k for n, k in need.items()):
                return a, b
        return None

    for n in range(room, 0, -1):
        while left[n]:
            gap = room - n
            if gap == 0:
                take((n,))
                continue
            if left[gap] and take((n, gap)):
                continue
            if gap > 1 and (found := pair(gap, n)) and take((n, *found)):
                continue
            if gap > 2:
                if sums is None:
                    sums = 0
                    for a in lengths_in(bits):
                        sums |= bits << a
                    sums &= (1 << room + 1) - 1
                done = False
                for a in lengths_in(bits & reversed_at(gap, sums) & ((1 << gap) - 2)):
                    if 3 * a < gap:
                        break
                    left[n] -= 1  # this one is spoken for while the others are looked up
                    found = pair(gap - a, a) if gap - a > 1 else None
                    left[n] += 1
                    if found and take((n, a, *found)):
                        done = True
                        break
                if done:
                    continue
            rest[n], left[n] = left[n], 0
            bits, sums = bits & ~(1 << n), None
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}  # by gap
    for n, c in sorted(rest.items(), reverse=True):
        while c:
            gap = next((g for g in range(n, room) if open_.get(g)), room)
            have, m = open_[gap].pop() if gap < room else ((), c)
            fit = min(gap // n, c)
            k = min(m, c // fit)
            if gap < room and m > k:
                open_[gap].append((have, m - k))
            open_.setdefault(gap - fit * n, []).append((have + (n,) * fit, k))
            c -= k * fit
    return out + [x for group in open_.values() for x in group]


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """Intervals of ranks within a length -> sequence and offset; sorted by (length, rank)."""
    used: Counter = Counter()
    rows, sequence = [], 0
    for lengths, m in patterns:
        offset = 0
        for n in lengths:
            rows.append((n, used[n], sequence, offset))
            used[n] += m
            offset += n
        sequence += m
    x = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return {"key": (x[:, 0] << 48) + x[:, 1], "first": x[:, 1], "sequence": x[:, 2], "offset": x[:, 3]}


def ranked(df: DataFrame, by: str, rows: int) -> DataFrame:
    """Adds rank, 0 upward within each value of by, however many rows a value has.

    df is a written table with its rows' own numbers in `row`; their hash deals even buckets whatever the rows hold, so equal
    rows and null ids spread like any others.
    """
    buckets = max(256, -(-rows // BUCKET_ROWS))
    dealt = df.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(buckets)).cast("int"))
    counts = dealt.groupBy("bucket", by).agg(F.count("*").alias("n"))
    before = counts.select("bucket", by, (F.sum("n").over(Window.partitionBy(by).orderBy("bucket")) - F.col("n")).alias("before"))
    inside = dealt.withColumn("inside", F.row_number().over(Window.partitionBy("bucket", by).orderBy("row")))
    return inside.join(before, ["bucket", by]).withColumn("rank", F.col("before") + F.col("inside") - 1).drop("bucket", "inside", "before", "row")


def pack(docs: DataFrame, keep: list[str], text: str = "text", room: int = ROOM, path: str | None = None) -> DataFrame:
    """keep + piece, start, length, ids_crc32, sequence_id, offset."""
    made = written(pieces(docs, keep, text, room, path=path).withColumn("row", F.monotonically_increasing_id()))
    counts = {r.length: r.n for r in made.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most room rows
    known = made.sparkSession.sparkContext.broadcast(slots(plan(counts, room)))
    placed = ranked(made, "length", sum(counts.values()))
    schema = T.StructType([*made.drop("row").schema.fields, *T._parse_datatype_string("sequence_id long, offset long").fields])
    names = schema.names
    length = names.index("length")

    def run(batches):
        at = known.value
        for b in batches:
            rank = b.column(b.num_columns - 1).to_numpy()
            i = np.searchsorted(at["key"], (b.column(length).to_numpy() << 48) + rank, "right") - 1
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(at["sequence"][i] + rank - at["first"][i]), pa.array(at["offset"][i])], names=names)

    return restored(placed.select(*names[:-2], "rank").mapInArrow(run, schema), names[1:])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: all documents packed into sequences of 2048 tokens."""
    return pack(table(spark, sf_dir, "documents"), ["doc_id"])
