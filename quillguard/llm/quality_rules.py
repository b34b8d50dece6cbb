"""Quality rules: base counts, then a linear-chain conditional random field over a document's lines.

Each line with a word gets a few numbers (shape, repetition, place). The field's two labels are content and boilerplate;
Viterbi decoding labels the lines of a document together, and the share of its words in content lines decides whether it
is kept. The field is trained here, by gradient ascent on the conditional likelihood over at most TRAIN_DOCS labelled
documents (those of the smallest hashes, whole, as many as have TRAIN_LINES lines together): every line of a bad document counts as
boilerplate, of a good one those that repeat an earlier line. Scoring reads every whole text, in one narrow map; a very long line or document only costs its own length.

Null and empty texts have no words: every count is 0, base_failed is true, kept is false. Repeated rows are judged
alike. An empty table gives an empty result. Kept columns keep their values whatever their names (common.restored). Without labels of both kinds nothing is called boilerplate and the base rule alone decides.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillguard.llm.common import KEPT, carried, map_texts, restored, table

TRAIN_DOCS, TRAIN_LINES, CHAIN, ROUNDS, MIN_CONTENT = 2_500, 60_000, 40, 150, 0.5
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
N_FEATURES, DUPLICATE = 13, 10


def _class_table() -> np.ndarray:
    """Byte -> class: 0 other, 1 blank, 2 upper, 3 digit, 4 symbol, 5 sentence mark."""
    t = np.zeros(256, np.uint8)
    t[[9, 10, 11, 12, 13, 32]] = 1
    t[65:91] = 2
    t[48:58] = 3
    t[[ord(c) for c in SYMBOLS + "!@^_=~\\{}[]+/"]] = 4
    t[[ord(c) for c in ".,;:?'\"()-"]] = 5
    return t


CLASSES = _class_table()


def repeated_words(words: list[bytes]) -> np.ndarray:
    """Which words lie in a three-word window that the text holds twice or more."""
    n = len(words)
    hit = np.zeros(n, bool)
    if n < 4:
        return hit
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    size = len(number)
    pairs = ids[:-1] * size + ids[1:]
    if size > 2_000_000:  # keep the product of three within 64 bits
        pairs = np.unique(pairs, return_inverse=True)[1].astype(np.int64)
    triples = pairs[:-1] * size + ids[2:]
    _, where, counts = np.unique(triples, return_inverse=True, return_counts=True)
    twice = counts[where] > 1
    for k in range(3):
        hit[k : n - 2 + k] |= twice
    return hit


class TextLines:
    """Base counts of a text, and the features of its lines that have words."""

    def __init__(self, text: str):
        raw = text.encode("utf-8", "replace")
        b = np.frombuffer(raw, np.uint8)
        kind = CLASSES[b]
        word = kind != 1
        starts = word & np.concatenate(([True], ~word[:-1])) if len(b) else word
        words = raw.split()
        repeat = repeated_words(words)
        cuts = np.flatnonzero(b == 10)
        edges = np.concatenate(([0], cuts + 1, [len(b)]))  # line i is edges[i] to edges[i + 1], with its feed
        upto = lambda mask: np.concatenate(([0], np.cumsum(mask)))[edges]
        per = lambda mask: np.diff(upto(mask)).astype(np.float64)
        n_words = per(starts).astype(np.int64)
        firsts = np.concatenate(([0], np.cumsum(n_words)))
        seen: set[bytes] = set()
        dup = np.zeros(len(n_words))
        lines = raw.split(b"\n")
        for i in np.flatnonzero(n_words):
            if lines[i] in seen:
                dup[i] = 1
            else:
                seen.add(lines[i])
        self.counts = (len(words), int(len(text) - (kind == 1).sum()), sum(text.count(c) for c in SYMBOLS), int(dup.sum()), int(repeat.sum()))
        live = n_words > 0
        self.words = n_words[live].astype(np.float64)
        chars = np.maximum(per(word)[live], 1)
        share = lambda k: per(kind == k)[live] / chars
        again = np.diff(np.concatenate(([0], np.cumsum(repeat)))[firsts])[live] / self.words
        n = len(self.words)
        place = np.arange(n)
        self.features = np.column_stack([
            np.ones(n), np.minimum(np.log1p(self.words) / 5, 2), self.words < 6, share(2) * 2, share(2) > 0.5, share(3) * 4,
            np.minimum(share(4) * 4, 2), share(4) > 0.08, share(5) * 4, again * (self.words >= 12), dup[live], (place == n - 1) & (n > 1), again * (self.words < 12),
        ]).astype(np.float64) if n else np.zeros((0, N_FEATURES))


def viterbi(scores: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """The best labels (1: boilerplate), given each line's score of being boilerplate and the scores of moves."""
    (cc, cb), (bc, bb) = moves.tolist()
    c, b, back = 0.0, 0.0, []
    for i, s in enumerate(scores.tolist()):
        if i:
            from_c, from_b = (c + cc, b + bc), (c + cb, b + bb)
            back.append((from_c[1] > from_c[0], from_b[1] > from_b[0]))
            c, b = max(from_c), max(from_b)
        b += s
    label, out = int(b > c), []
    for step in [None, *back[::-1]]:
        if step is not None:
            label = int(step[label])
        out.append(label)
    return np.array(out[::-1][: len(scores)], np.int64)


def train(features: list[np.ndarray], labels: list[int], rounds: int = ROUNDS, rate: float = 1.0, decay: float = 0.01) -> tuple[np.ndarray, np.ndarray]:
    """Weights and moves of the field that make the documents' line labels likeliest (gradient ascent with momentum).

    Documents are padded to the longest and stepped through together, forward and backward.
    """
    n, longest = len(features), max(map(len, features))
    x = np.zeros((longest, n, N_FEATURES))
    live = np.zeros((longest, n), bool)
    for i, f in enumerate(features):
        x[: len(f), i], live[: len(f), i] = f, True
    bad = np.array(labels)
    y = np.where(bad == 1, True, x[:, :, DUPLICATE] > 0) & live
    weight = np.where(bad == 1, 0.5 / max(1, (bad == 1).sum()), 0.5 / max(1, (bad == 0).sum()))  # both kinds count alike
    weight = weight / np.maximum(1, live.sum(0))
    w, moves = np.zeros(N_FEATURES), np.zeros((2, 2))
    speed_w, speed_m = np.zeros_like(w), np.zeros_like(moves)
    for _ in range(rounds):
        e = np.stack([np.zeros((longest, n)), x @ w], 2)
        forward = np.zeros((longest, n, 2))
        forward[0] = e[0]
        for t in range(1, longest):
            step = np.logaddexp.reduce(forward[t - 1][:, :, None] + moves, axis=1) + e[t]
            forward[t] = np.where(live[t][:, None], step, forward[t - 1])
        z = np.logaddexp(forward[-1][:, 0], forward[-1][:, 1])
        backward = np.zeros((longest, n, 2))
        grad_m = np.zeros((2, 2))
        for t in range(longest - 2, -1, -1):
            step = np.logaddexp.reduce(moves + (e[t + 1] + backward[t + 1])[:, None, :], axis=2)
            backward[t] = np.where(live[t + 1][:, None], step, 0)
            both = np.exp(np.minimum(0, forward[t][:, :, None] + moves + (e[t + 1] + backward[t + 1])[:, None, :] - z[:, None, None]))
            both = both * (live[t + 1] * weight)[:, None, None]
            np.add.at(grad_m, (y[t].astype(int), y[t + 1].astype(int)), weight * live[t + 1])
            grad_m -= both.sum(0)
        p = np.exp(np.minimum(0, forward[:, :, 1] + backward[:, :, 1] - z))
        grad_w = np.einsum("tn,tnf->f", (y - p) * live * weight, x)
        speed_w = 0.9 * speed_w + grad_w - decay * w
        speed_m = 0.9 * speed_m + grad_m - decay * moves
        w, moves = w + rate * speed_w, moves + rate * speed_m
    return w, moves


def labelled_lines(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS, lines: int = TRAIN_LINES) -> tuple[list[np.ndarray], list[int]]:
    """Line features and label (1: boilerplate) of whole training documents: at most `most`, as many as have `lines` lines
    together (one at least). A long document is several chains of CHAIN lines, so that none pads the others."""
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = labels.groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality is not null").orderBy(*order).limit(most)
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).where("text is not null")
    sizes = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality", "h").agg(F.max(F.size(F.split("text", "\n"))).alias("n")).orderBy(*order, "h").limit(most)
    upto = F.sum("n").over(Window.orderBy(*order, "h").rowsBetween(Window.unboundedPreceding, -1))  # over at most `most` rows of numbers
    kept = sizes.withColumn("before", F.coalesce(upto, F.lit(0))).where(f"before < {lines}").select("doc_id", "h", "quality")
    texts = texts.join(F.broadcast(kept), ["doc_id", "h"]).dropDuplicates(["doc_id", "h"])  # equal rows teach once

    def make():
        return lambda texts: [[TextLines(t).features.ravel() for t in texts]]

    rows = map_texts(texts, make, "x array<double>", ["doc_id", "quality"]).collect()
    rows = [r for r in sorted(rows, key=lambda r: (str(r.doc_id), r.x)) if r.x]
    chains = [(np.array(r.x).reshape(-1, N_FEATURES)[at : at + CHAIN], 1 - r.quality) for r in rows for at in range(0, len(r.x) // N_FEATURES, CHAIN)]
    return [x for x, _ in chains], [y for _, y in chains]


def judge(docs: DataFrame, keep: list[str], labels: DataFrame | None = None, text: str = "text", field: tuple[np.ndarray, np.ndarray] | None = None, min_content: float = MIN_CONTENT) -> DataFrame:
    """keep + the base counts, base_failed, content_share and kept. field: weights and moves; else trained on labels."""
    if field is None and labels is not None:
        x, y = labelled_lines(docs, labels)
        field = train(x, y) if len(set(y)) == 2 else None

    def make():
        def work(texts):
            out = []
            for t in texts:
                lines = TextLines(t)
                total = lines.words.sum()
                share = 0.0
                if total:
                    label = viterbi(lines.features @ field[0], field[1]) if field else np.zeros(len(lines.words))
                    share = float(lines.words[label == 0].sum() / total)
                out.append((*lines.counts, share))
            return list(zip(*out))

        return work

    scored = map_texts(carried(docs, keep, text=F.col(text)), make, f"{COUNTS}, content_share double", [KEPT])
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    judged = scored.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("content_share") >= min_content))
    return restored(judged, [c for c in judged.columns if c != KEPT])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: the verdict on every document."""
    return judge(table(spark, sf_dir, "documents"), ["doc_id"], table(spark, sf_dir, "labels"))
