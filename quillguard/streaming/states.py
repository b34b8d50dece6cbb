"""Keyed state machines of streams with timers: silence, findings and their reviews, archives by size or age.

They need the state store that keeps several values a key (ROCKS). A key's state is bounded: one row, or one unflushed part.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKS = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
LATE = "1 hour"


def with_store(spark: SparkSession) -> SparkSession:
    """The session, set to the state store that these jobs need."""
    spark.conf.set(*ROCKS)
    return spark


def millis(at: pd.Timestamp) -> int:
    return int(at.value // 1_000_000)


def micros(at: pd.Timestamp) -> int:
    return int(at.value // 1000)


def moment(us: int) -> pd.Timestamp:
    return pd.Timestamp(us, unit="us")


class Silence(StatefulProcessor):
    """One row when a key has been silent for too long, one when it comes back. A timer waits at last_seen + hours; it fires
    once the watermark has passed it, whether or not the key has any input then."""

    def __init__(self, names: list[str], hours: int):
        self.columns, self.wait = [*names, "event", "at", "last_seen"], hours * 3_600_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "last long, dark boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, dark = self.seen.get() if self.seen.exists() else (None, False)
        out = []
        for at in sorted(t for b in rows for t in b["ts"].map(micros)):
            if last is not None and at <= last:
                continue
            if dark or (last is not None and at > last + self.wait):
                if not dark:  # both in one batch: the silence has ended before its timer could fire
                    out.append((*key, "dark", moment(last + self.wait), moment(last)))
                out.append((*key, "back", moment(at), moment(last)))
                dark = False
            last = at
        if last is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.seen.update((last, dark))
            if not dark:
                self.handle.registerTimer((last + self.wait) // 1000 + 1)
        yield pd.DataFrame(out, columns=self.columns)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, dark = self.seen.get()
        if dark or expiredTimerInfo.getExpiryTimeInMs() * 1000 < last + self.wait:
            return
        self.seen.update((last, True))
        yield pd.DataFrame([(*key, "dark", moment(last + self.wait), moment(last))], columns=self.columns)

    def close(self) -> None:
        pass


def silences(beats: DataFrame, key: list[str], hours: int = 72, late: str = LATE) -> DataFrame:
    """key, event (dark or back), at, last_seen: a row on each edge. Input: key (strings) and ts. The state of a key is one row;
    it stays while the key may come back."""
    out = ", ".join(f"{k} string" for k in key) + ", event string, at timestamp, last_seen timestamp"
    rows = beats.withWatermark("ts", late).select(*key, "ts").groupBy(*key)
    return rows.transformWithStateInPandas(Silence(key, hours), out, "append", "EventTime")


#: What a finding's state keeps, and the severities and kinds of traffic whose repeats open it again.
SERIOUS = ("high", "critical")


class Lifecycle(StatefulProcessor):
    """A finding by fingerprint: new, seen again, reviewed, reopened. Findings and reviews come in one stream, in order of time
    within a batch; of one moment findings come first."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.finding = handle.getValueState("finding", "status string, seen long, first long, last long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        status, seen, first, last = self.finding.get() if self.finding.exists() else (None, 0, None, None)
        out = []
        batch = pd.concat(list(rows)).sort_values(["ts", "review", "id"], kind="stable", na_position="first")
        for at, review, serious, n in zip(batch["ts"], batch["review"], batch["serious"], batch["id"]):
            if isinstance(review, str):
                if status is not None and review != status:
                    status = review
                    out.append((key[0], int(n), at, review, seen))
                continue
            seen += 1
            first, last = micros(at) if first is None else min(first, micros(at)), micros(at) if last is None else max(last, micros(at))
            if status is None:
                status = "open"
                out.append((key[0], int(n), at, "new", seen))
            elif status == "dismissed" and serious:
                status = "open"
                out.append((key[0], int(n), at, "reopened", seen))
        if status is not None:
            self.finding.update((status, seen, first, last))
        yield pd.DataFrame(out, columns=["fingerprint", "id", "at", "event", "seen_count"])

    def close(self) -> None:
        pass


def transitions(findings: DataFrame, reviews: DataFrame, live: list[str]) -> DataFrame:
    """fingerprint, id, at, event, seen_count: a row whenever a finding is new, reviewed with another status, or opened again by
    a serious repeat in live traffic after it was dismissed; further repeats then add to seen_count only.

    findings: fingerprint, id, ts, severity, surface; reviews: fingerprint, id, ts, status (of findings that exist).
    """
    serious = F.col("severity").isin(*SERIOUS) & F.col("surface").isin(*live)
    f = findings.select("fingerprint", "id", "ts", F.lit(None).cast("string").alias("review"), serious.alias("serious"))
    r = reviews.select("fingerprint", "id", "ts", F.col("status").alias("review"), F.lit(False).alias("serious"))
    return f.unionByName(r).groupBy("fingerprint").transformWithStateInPandas(Lifecycle(), "fingerprint string, id long, at timestamp, event string, seen_count long", "append", "None")


class Archive(StatefulProcessor):
    """Lines of a key held until they are many bytes or old; then a numbered part of them goes out. A budget of bytes a day is
    carried from batch to batch: a line that doesn't fit is counted and dropped, which is what the budget is for."""

    def __init__(self, most: int, age: int, budget: int):
        self.most, self.age, self.budget = most, age, budget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lines = handle.getListState("lines", "ts long, line string")
        self.held = handle.getValueState("held", "part long, bytes long, first long, day string, spent long, dropped long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        part, held, first, day, spent, dropped = self.held.get() if self.held.exists() else (0, 0, None, "", 0, 0)
        lines = list(self.lines.get()) if held else []
        batch = pd.concat(list(rows)).sort_values(["ts", "line"], kind="stable")
        out = []
        for at, line in zip(batch["ts"], batch["line"]):
            ms, size, today = millis(at), len(line.encode()) + 1, at.strftime("%Y-%m-%d")
            if lines and (ms - first >= self.age or held + size > self.most):
                out += self.part(key, part, lines, dropped)
                part, held, first, lines, dropped = part + 1, 0, None, [], 0
            if today > day:
                day, spent = today, 0
            if spent + size > self.budget:
                dropped += 1
                continue
            spent, held, first = spent + size, held + size, ms if first is None else first
            lines.append((ms, line))
        self.lines.clear()
        if lines:
            self.lines.put(lines)
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(first + self.age)
        self.held.update((part, held, first, day, spent, dropped))
        yield pd.DataFrame(out, columns=COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        part, held, first, day, spent, dropped = self.held.get()
        lines = list(self.lines.get()) if held else []
        if not lines or expiredTimerInfo.getExpiryTimeInMs() < first + self.age:
            return
        self.lines.clear()
        self.held.update((part + 1, 0, None, day, spent, 0))
        yield pd.DataFrame(self.part(key, part, lines, dropped), columns=COLUMNS)

    def part(self, key, part: int, lines: list, dropped: int) -> list[tuple]:
        whole = [line for _, line in lines]
        return [(key[0], int(key[1]), moment(1000 * lines[0][0]).floor("h"), part, "\n".join(whole) + "\n", len(whole), sum(len(x.encode()) + 1 for x in whole), dropped)]

    def close(self) -> None:
        pass


COLUMNS = ["tenant", "shard", "hour", "part", "body", "n_lines", "n_bytes", "n_dropped"]


def archive_parts(events: DataFrame, shards: int = 1, most: int = 64 * 1024, age_seconds: int = 5, daily: int = 1 << 30, late: str = LATE) -> DataFrame:
    """tenant, shard, hour, part, body, n_lines, n_bytes, n_dropped: parts of newline-separated JSON of at most `most` bytes (or
    one longer line), at most age_seconds old. Input: tenant, ts, line. A tenant's lines are dealt over shards, each with its
    share of the daily bytes, so a large tenant isn't one task's; n_dropped: lines over the day's budget since the last part.
    """
    shard = F.pmod(F.xxhash64("line"), F.lit(shards)).cast("int")
    rows = events.withWatermark("ts", late).select("tenant", shard.alias("shard"), "ts", "line").groupBy("tenant", "shard")
    return rows.transformWithStateInPandas(Archive(most, age_seconds * 1000, daily // shards), "tenant string, shard int, hour timestamp, part long, body string, n_lines long, n_bytes long, n_dropped long", "append", "EventTime")
