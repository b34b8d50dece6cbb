"""Streaming twins of the stateful rollups. Inputs have actor, ts and what each job names; state is bounded by watermarks."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LATE = "1 hour"


def per_minute(events: DataFrame, kind: str = "surface", late: str = LATE) -> DataFrame:
    """Counters per minute and kind; a minute is final once the watermark passed it."""
    by = events.withWatermark("ts", late).groupBy(F.window("ts", "1 minute").alias("w"), F.col(kind).alias("kind")).agg(F.count("*").alias("n"))
    return by.select(F.col("w.start").alias("minute"), "kind", "n")


def first_of_hour(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """One row per actor and hour slot, whichever arrived first."""
    slotted = events.withColumns({"slot": F.weekday("ts") * 24 + F.hour("ts"), "hour": F.date_trunc("hour", "ts")})
    return slotted.withWatermark("ts", late).dropDuplicatesWithinWatermark(["actor", "hour"])


def tainted_actions(actions: DataFrame, taints: DataFrame, minutes: int = 30, late: str = LATE) -> DataFrame:
    """Actions within the life of a taint of the same actor, as an interval join of two streams."""
    a = actions.withWatermark("ts", late).select(F.col("actor").alias("a_actor"), F.col("ts").alias("a_ts"), F.col("id").alias("action"))
    t = taints.withWatermark("ts", late).select(F.col("actor").alias("t_actor"), F.col("ts").alias("t_ts"), F.col("id").alias("taint"))
    on = F.expr(f"a_actor = t_actor and a_ts >= t_ts and a_ts < t_ts + INTERVAL {minutes} MINUTES")
    return a.join(t, on).select("action", "taint", F.col("a_actor").alias("actor"), F.col("a_ts").alias("ts"))


def recurrences(events: DataFrame, idle_days: int = 30) -> DataFrame:
    """A finding per fingerprint: how often it was seen, first and last; updated whenever it recurs."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, first, last = state.get if state.exists else (0, None, None)
        for b in batches:
            lo, hi = b["ts"].min(), b["ts"].max()
            n, first, last = n + len(b), lo if first is None else min(first, lo), hi if last is None else max(last, hi)
        state.update((n, pd.Timestamp(first).to_pydatetime(), pd.Timestamp(last).to_pydatetime()))
        state.setTimeoutTimestamp(max(int(last.timestamp() * 1000), state.getCurrentWatermarkMs()) + idle_days * 86_400_000)
        yield pd.DataFrame({"fingerprint": [key[0]], "seen_count": [n], "created_at": [first], "last_seen": [last]})

    keyed = events.withWatermark("ts", LATE).withColumn("fingerprint", F.md5(F.concat_ws("|", "actor", "tool", "category").cast("binary")))
    return keyed.select("fingerprint", "ts").groupBy("fingerprint").applyInPandasWithState(fold, "fingerprint string, seen_count long, created_at timestamp, last_seen timestamp", "n long, first timestamp, last timestamp", "update", GroupStateTimeout.EventTimeTimeout)


def chains(findings: DataFrame, seconds: int = 1800, anchor: int = 60, most: int = 300, late: str = LATE) -> DataFrame:
    """actor, stages, ts of every finding whose actor's last seconds hold two stages and an anchor, as it arrives. Input: actor,
    ts, category, risk. A chain that comes back is folded on reading: groupBy(actor, stages).

    State holds an actor's last seconds, the newest rows of them at most, and goes when they have passed. Rows of a batch are
    taken in order of time, those of one second together; a row that arrives after newer ones sees what is still held.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = json.loads(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values("ts", kind="stable")
        found = []
        for at, same in rows.groupby(rows["ts"].dt.floor("s"), sort=True):
            now = int(at.timestamp())
            held = [h for h in held if h[0] >= now - seconds] + [[now, c, int(r)] for c, r in zip(same["category"], same["risk"])]
            held = sorted(held, key=lambda h: h[0])[-most:]
            seen = [h for h in held if h[0] <= now]
            stages = sorted({c for _, c, _ in seen})
            if len(stages) >= 2 and max(r for _, _, r in seen) >= anchor:
                found += [(key[0], ",".join(stages), ts) for ts in same["ts"]]
        state.update((json.dumps(held),))
        state.setTimeoutTimestamp(max(held[-1][0] * 1000, state.getCurrentWatermarkMs()) + seconds * 1000 + 1)
        yield pd.DataFrame(found, columns=["actor", "stages", "ts"])

    rows = findings.withWatermark("ts", late).select("actor", "ts", "category", "risk")
    return rows.groupBy("actor").applyInPandasWithState(step, "actor string, stages string, ts timestamp", "held string", "append", GroupStateTimeout.EventTimeTimeout)


#: What a chunk's end may hold of a token that the next chunk finishes; a whole token has sixteen digits after its kind, or eight.
BEGUN = re.compile(r"Q(?:G(?:_(?:[A-Z]{1,12}(?:_[0-9a-f]{0,15})?)?)?)?$")


def detokenized(chunks: DataFrame, idle_minutes: int = 30, late: str = LATE) -> DataFrame:
    """reply, seq, text: replies that arrive in chunks, tokens turned back into values. Input: reply, seq, chunk, last and
    tokens (a map, with each chunk or null). Only what may be a token's beginning is held back, until the next chunk or the last.

    With a column ts, a reply that has got no chunk for idle_minutes when the watermark passes ends with what is held, under its
    last number, and leaves the state; without one, a reply whose last chunk never comes stays.
    """
    from quillguard.functions.keyed import TOKEN

    timed = "ts" in chunks.columns

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        carry, known, at = json.loads(state.get[0]) if state.exists else ["", {}, 0]
        if state.hasTimedOut:
            state.remove()
            if carry:
                yield pd.DataFrame([(key[0], at, known.get(carry, carry))], columns=["reply", "seq", "text"])
            return
        rows, out = pd.concat(list(batches)).sort_values("seq"), []
        for seq, chunk, last, tokens in zip(rows["seq"], rows["chunk"], rows["last"], rows["tokens"]):
            known.update(dict(tokens) if tokens is not None else {})
            text = carry + (chunk or "")
            begun = None if last else BEGUN.search(text)
            carry = text[begun.start():] if begun else ""
            text = text[: begun.start()] if begun else text
            out.append((key[0], seq, re.sub(TOKEN, lambda m: known.get(m[0], m[0]), text)))
        if rows["last"].any():
            state.remove()
        else:
            state.update((json.dumps([carry, known, int(rows["seq"].iloc[-1])]),))
            if timed:
                state.setTimeoutTimestamp(max(int(rows["ts"].max().timestamp() * 1000), state.getCurrentWatermarkMs()) + idle_minutes * 60_000 + 1)
        yield pd.DataFrame(out, columns=["reply", "seq", "text"])

    rows = chunks.withWatermark("ts", late) if timed else chunks
    return rows.groupBy("reply").applyInPandasWithState(step, "reply string, seq int, text string", "held string", "append", GroupStateTimeout.EventTimeTimeout if timed else GroupStateTimeout.NoTimeout)


def batch_sink(key: list[str], target: str):
    """A foreachBatch writer that a repeated batch doesn't change: each batch overwrites its own folder, with one row a key.
    A key that comes back in a later batch stands there too; latest() merges them on reading."""

    def write(df: DataFrame, batch: int) -> None:
        df.dropDuplicates(key).write.mode("overwrite").parquet(f"{target}/batch={batch}")

    return write


def latest(landed: DataFrame, key: list[str]) -> DataFrame:
    """One row a key of what batch_sink wrote: that of its last batch."""
    rest = [c for c in landed.columns if c not in (*key, "batch")]
    return landed.groupBy(*key).agg(F.max_by(F.struct(*rest), "batch").alias("row")).select(*key, "row.*")
