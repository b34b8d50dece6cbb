"""Token counts by a two-tier map-side lookup of pre-token lengths.

A text becomes units no merge can cross: a run of word-boundary marks with the word after it, or a line feed with the
word after it. No piece of the vocabulary holds a mark behind another character, or a line feed, so the units' token
counts add up to the text's (checked when a worker starts; a vocabulary that breaks this is encoded whole).

Tier one is broadcast: the lengths of the corpus's most frequent units, at most FREQUENT of them. Tier two is each
worker's own cache of what it had to encode, emptied beyond CACHE entries. No unit is ever shuffled on its own: a task
sends at most TASK_TOP counts of its commonest units, which only decide what tier one holds, never a result.

Null text counts as empty: 0 bytes, 0 tokens. Repeated rows give repeated rows. Very long texts are counted whole. An
empty table gives an empty result. Kept columns keep their values whatever their names (common.restored); others are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillguard.llm.common import KEPT, carried, collect_blocks, map_texts, restored, table

FREQUENT, TASK_TOP, CACHE, LIMIT = 65_536, 4_096, 400_000, 4_096
MODEL = "piece_bpe_32k.model"
UNIT = re.compile("▁+[^▁\n]*|\n[^▁\n]*")


def vocabulary(name: str) -> str:
    """Where a public vocabulary file lies; it is never copied."""
    import public_tokenizers

    return public_tokenizers.path(name)


def units(text: str) -> list[str]:
    """Keys of a text's units: the unit without its first mark, marks as spaces; one that starts at a line feed keeps it."""
    if not text:
        return []
    if "▁" not in text:
        keys = text.replace("\n", " \n").split(" ")
        if "" not in keys:
            return keys
    return [u if u[0] == "\n" else u[1:].replace("▁", " ") for u in UNIT.findall("▁" + text.replace(" ", "▁"))]


class Encoder:
    """Lengths of units by the sentencepiece library."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.sp = SentencePieceProcessor(model_file=path)
        self.splits = not any(re.search("[^▁]▁|\n", self.sp.id_to_piece(i)) for i in range(self.sp.get_piece_size()))

    def whole(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.sp.encode(texts, num_threads=1)]

    def lengths(self, keys: list[str]) -> list[int]:
        """The lone mark is one token though its key is empty; a key with a line feed was encoded behind an added mark."""
        return [1 if not k else n - (k[0] == "\n") for k, n in zip(keys, self.whole(keys))]


def frequent_units(docs: DataFrame, text: str = "text", top: int = FREQUENT, task_top: int = TASK_TOP) -> DataFrame:
    """(unit, n) of the top units by the tasks' bounded summaries."""

    def make():
        seen: Counter = Counter()

        def add(texts):
            for t in texts:
                seen.update(units(t or ""))
            if len(seen) > 64 * task_top:
                kept = seen.most_common(16 * task_top)
                seen.clear()
                seen.update(dict(kept))

        def finish():
            found = seen.most_common(task_top)
            yield [[k for k, _ in found], [n for _, n in found]]

        return add, finish

    sums = collect_blocks(docs, make, "unit string, n long", text).groupBy("unit").agg(F.sum("n").alias("n"))
    return sums.orderBy(F.desc("n"), "unit").limit(top)


def count_tokens(docs: DataFrame, keep: list[str], text: str = "text", model: str | None = None, limit: int = LIMIT) -> DataFrame:
    """keep + n_bytes, n_tokens, over_limit of each whole text."""
    path = model or vocabulary(MODEL)
    keys = [r.unit for r in frequent_units(docs, text).collect()]  # at most FREQUENT
    known = docs.sparkSession.sparkContext.broadcast(pa.table({"unit": keys, "length": pa.array(Encoder(path).lengths(keys), pa.int32())}) if keys else None)

    def make():
        encoder = Encoder(path)
        first = dict(zip(*(c.to_pylist() for c in known.value.columns))) if known.value else {}
        lengths = dict(first)

        def work(texts):
            nonlocal lengths
            if not encoder.splits:
                return [encoder.whole(texts)]
            found = [units(t) for t in texts]
            missing = list({k for x in found for k in x if k not in lengths})
            if len(lengths) + len(missing) > CACHE:
                lengths = dict(first)
                missing = list({k for x in found for k in x if k not in lengths})
            lengths.update(zip(missing, encoder.lengths(missing)) if missing else ())
            return [[sum(map(lengths.__getitem__, x)) for x in found]]

        return work

    sized = carried(docs, keep, text=F.col(text).cast("string")).withColumn("n_bytes", F.octet_length(F.coalesce("text", F.lit(""))).cast("long"))
    counted = map_texts(sized, make, "n_tokens long", [KEPT, "n_bytes"]).withColumn("over_limit", F.col("n_tokens") > limit)
    return restored(counted, ["n_bytes", "n_tokens", "over_limit"])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: token counts of every document."""
    return count_tokens(table(spark, sf_dir, "documents"), ["doc_id"])
