"""Stretches of a text as arrays of spans, in built-in expressions: where a pattern matches, spans merged by a sweep, texts put
together anew around them. Places are code points, ends exclusive. Work grows with the text and its matches, not their product.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

FOUND = "array<struct<start:int,end:int,text:string>>"
SPANS = "array<struct<start:int,end:int,kind:int>>"
BLOCK, FOLD = 4096, 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def sums(sizes: Column) -> Column:
    """For each place of an array of numbers, the sum up to and with it: sums of blocks, then sums within each."""
    total = lambda part: F.aggregate(part, F.lit(0), lambda n, x: n + x)
    blocks = lambda s: F.transform(F.sequence(F.lit(0), F.shiftright(F.size(s) - 1, 8)), lambda b: total(F.slice(s, b * FOLD + 1, F.lit(FOLD))))
    before = lambda s: let(blocks(s), lambda t: F.transform(t, lambda _, b: total(F.slice(t, F.lit(1), b))))
    within = lambda s, i: total(F.slice(s, F.shiftright(i, 8) * FOLD + 1, i.bitwiseAND(F.lit(FOLD - 1)) + 1))
    return let(sizes, lambda s: F.when(F.size(s) > 0, let(before(s), lambda t: F.transform(s, lambda _, i: F.get(t, F.shiftright(i, 8)) + within(s, i)))).otherwise(s))


def matches(text: Column, pattern: str | Column, valid: Callable[[Column], Column] | None = None) -> Column:
    """array<struct<start,end,text>> of a pattern's matches (never empty ones), leftmost first, none overlapping; valid: which
    of them count. A null text has none."""
    ends = lambda t, hits: sums(F.zip_with(F.split(t, pattern, -1), hits, lambda g, h: F.length(g) + F.coalesce(F.length(h), F.lit(0))))
    spans = lambda hits, e: F.transform(hits, lambda h, i: F.struct((F.get(e, i) - F.length(h)).alias("start"), F.get(e, i).alias("end"), h.alias("text")))
    found = let(F.coalesce(text, F.lit("")), lambda t: let(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), lambda hits: F.when(F.size(hits) > 0, let(ends(t, hits), lambda e: spans(hits, e))).otherwise(F.expr(f"cast(array() as {FOUND})"))))
    return F.filter(found, lambda m: F.coalesce(valid(m["text"]), F.lit(False))) if valid else found


def merged(spans: Column) -> Column:
    """Spans (start, end, kind: a number) as a sorted union: those that overlap become one, of the least kind.

    A sweep over the sorted starts and the sorted ends: a merged span begins at the i-th start if i spans have ended by then.
    """
    cuts = lambda s, ends: F.filter(F.sequence(F.lit(0), F.size(s)), lambda i: (i == 0) | (i == F.size(s)) | (F.get(ends, i - 1) <= F.get(s, i)["start"]))
    kind = lambda s, a, b: F.array_min(F.transform(F.slice(s, a + 1, b - a), lambda x: x["kind"]))
    whole = lambda s, ends, c: F.transform(F.slice(c, F.lit(1), F.size(c) - 1), lambda a, k: let(F.get(c, k + 1), lambda b: F.struct(F.get(s, a)["start"].alias("start"), F.get(ends, b - 1).alias("end"), kind(s, a, b).alias("kind"))))
    return let(F.array_sort(spans), lambda s: F.when(F.size(s) > 0, let(F.array_sort(F.transform(s, lambda x: x["end"])), lambda ends: let(cuts(s, ends), lambda c: whole(s, ends, c)))).otherwise(s))


def blocks(text: Column) -> Column:
    """A text in pieces of BLOCK code points."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def between(pieces: Column, start: Column, end: Column) -> Column:
    """The text from start to end, of a text in pieces."""
    part = lambda j: let(F.greatest(start - j * BLOCK, F.lit(0)), lambda a: F.substring(F.get(pieces, j), a + 1, F.least(end - j * BLOCK, F.lit(BLOCK)) - a))
    return F.when(start < end, F.array_join(F.transform(F.sequence(F.shiftright(start, 12), F.shiftright(end - 1, 12)), part), "")).otherwise("")


def with_text(text: Column, spans: Column, *more: str) -> Column:
    """array<struct<start,end,more...,text>>: spans with what stands there."""
    return let(blocks(F.coalesce(text, F.lit(""))), lambda p: F.transform(spans, lambda s: F.struct(*(s[c].alias(c) for c in ("start", "end", *more)), between(p, s["start"], s["end"]).alias("text"))))


def replaced(text: Column, spans: Column, new: Callable[[Column], Column]) -> Column:
    """The text with each span s (in order, none overlapping) replaced by new(s)."""
    until = lambda s, i: F.when(i == 0, F.lit(0)).otherwise(F.get(s, F.greatest(i - 1, F.lit(0)))["end"])
    whole = lambda t, p, s: F.concat(F.array_join(F.transform(s, lambda x, i: F.concat(between(p, until(s, i), x["start"]), new(x))), ""), between(p, F.element_at(s, -1)["end"], F.length(t)))
    return let(text, lambda t: let(spans, lambda s: F.when(F.size(s) > 0, let(blocks(t), lambda p: whole(t, p, s))).otherwise(t)))


def with_utf16(text: Column, spans: Column, *more: str) -> Column:
    """Spans with start16 and end16, their places in UTF-16 units: one more for each character beyond 16 bits before them."""
    wide = F.transform(matches(text, r"[\x{10000}-\x{10ffff}]"), lambda m: m["start"])
    at = lambda w, place: place + F.size(F.filter(w, lambda x: x < place))
    return let(wide, lambda w: F.transform(spans, lambda s: F.struct(*(s[c].alias(c) for c in ("start", "end", *more)), at(w, s["start"]).alias("start16"), at(w, s["end"]).alias("end16"))))
