"""Secret scans with multipart credential linking, in built-in functions only.

Base spans are what three patterns match. Beyond them a text holds weak parts: names of accounts, endpoints, and long
mixed tokens, each too common to report alone. A weak part is reported only where a complementary part stands within
SCOPE code points of it, from the end of the one to the start of the other: an identifier with a secret, an endpoint with
a secret. A weak secret and an endpoint, the commonest of all, link (both ways) only if one of them is more telling: an
endpoint that isn't http, or that names a user before its host; a token of STRONG code points or more with capitals and
small letters. Parts are joined by interval: a part's start and end each lie in a cell of SCOPE code points, an end meets
the starts in its own cell and the next, whatever the length of the parts; a semi-join emits no pairs, so each weak part
is counted a few times at most however many parts stand together.

Positions count code points, ends are exclusive. Null texts count as empty and have no spans. Repeated rows are scanned
alike, each giving its row; a row is told by a number written with it, so ids may be null or repeated. A very long text
only costs its length: places are running sums, and parts meet within cells. An empty table gives an empty result. Kept
columns keep their values whatever their names (common.restored); other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillguard.llm.common import KEPT, carried, restored, table, written

#: The base patterns, by kind, in order, and the least length that counts (of group 2, or of the match).
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = {"assign": (ASSIGN, 2, 6), "access": (r"AKIA[A-Z0-9]+", 0, 20), "hex": (r"[0-9a-f]+", 0, 24)}
#: Weak parts: what they can be a part of, and their pattern.
WEAK = {
    "weak_id": r"""(?i)(?:client_?id|account_?id|access_?key_?id|user_?name|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}""",
    "weak_endpoint": r"""(?i)(?:https?|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqps?)://[^\s"'<>]+""",
    "weak_secret": r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{20,}",
}
HINT = r"(?i)(?:client_?id|account_?id|access_?key|user_?name|login)|AKIA|://"
SCOPE = 400
STRONG = 32
TELLING = {"weak_endpoint": r"(?i)^(?!https?://)|^https?://[^/?#@]+@", "weak_secret": rf"^(?=.*[a-z])(?=.*[A-Z]).{{{STRONG},}}"}
KINDS = [*BASE, *WEAK]
SPAN = "struct<start:int,`order`:int,end:int,kind:string>"
PART = "struct<start:int,`order`:int,end:int,kind:string,telling:boolean>"


def bound(value: Column, use) -> Column:
    """use(value) with value evaluated once: named inside an inner lambda it would be evaluated again for every element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(values: Column, combine, zero: int = 0, block: int = 256) -> Column:
    """For each of an array of ints the combination (an associative one) of those before it.

    An array that grows inside aggregate is copied at every step, so runs of `block` values are folded on their own and then
    moved up by what the runs before them come to: block copies a value instead of as many as there are values.
    """
    none = F.expr("cast(array() as array<int>)")
    blocks = lambda v: F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.size(v) - 1, F.lit(0)) / block).cast("int")), lambda i: F.slice(v, i * block + 1, F.lit(block)))
    step = lambda acc, x: F.struct(combine(acc["at"], x).cast("int").alias("at"), F.concat(acc["before"], F.array(acc["at"])).alias("before"))
    start = F.struct(F.lit(zero).cast("int").alias("at"), none.alias("before"))
    inner = lambda v: F.transform(blocks(v), lambda c: F.aggregate(c, start, step))
    moved = lambda folded: F.flatten(F.zip_with(folded, F.aggregate(F.transform(folded, lambda f: f["at"]), start, step)["before"], lambda f, o: F.transform(f["before"], lambda x: combine(o, x).cast("int"))))
    return bound(values, lambda v: F.when(F.size(v) > 0, bound(inner(v), moved)).otherwise(none))


def matches(text: Column, kind: str, pattern: str, group: int = 0, least: int = 1) -> Column:
    """array<PART> of a pattern's leftmost, non-overlapping matches, without those whose group is too short.

    What lies between the matches gives their places: split and regexp_extract_all walk the text alike, and the place of a
    match is a running sum of lengths. A text costs its length, and its matches little more than their number.
    """
    size = lambda h: F.length(F.regexp_extract(h, pattern, group) if group else h)
    telling = (lambda h: h.rlike(TELLING[kind])) if kind in TELLING else (lambda h: F.lit(True))
    step = lambda gap, hit: F.struct(F.length(gap).alias("gap"), F.length(hit).alias("hit"), (size(hit) >= least).alias("counts"), telling(hit).alias("telling"))
    part = lambda s, at: F.struct((at + s["gap"]).cast("int").alias("start"), F.lit(KINDS.index(kind)).alias("order"), (at + s["gap"] + s["hit"]).cast("int").alias("end"), F.lit(kind).alias("kind"), s["counts"].alias("counts"), s["telling"].alias("telling"))
    placed = lambda steps: F.zip_with(steps, running(F.transform(steps, lambda s: s["gap"] + s["hit"]), lambda a, b: a + b), part)
    counted = lambda parts: F.transform(F.filter(parts, lambda p: p["counts"]), lambda p: F.struct(p["start"].alias("start"), p["order"].alias("order"), p["end"].alias("end"), p["kind"].alias("kind"), p["telling"].alias("telling")))
    none = F.expr(f"cast(array() as array<{PART}>)")
    found = lambda hits: F.when(F.size(hits) > 0, counted(bound(F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits)), hits, step), placed))).otherwise(none)
    return bound(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), found)


def base_parts(text: Column) -> Column:
    """array<PART> of all base kinds. Runs too short for hex are skipped by the pattern itself, which is the same for a run."""
    return F.concat(*(matches(text, kind, r"[0-9a-f]{24,}" if kind == "hex" else pattern, group, least) for kind, (pattern, group, least) in BASE.items()))


def weak_parts(text: Column) -> Column:
    """array<PART> of the weak kinds, of texts that have any beside secrets; weak secrets alone link with nothing."""
    found = F.concat(*(matches(text, kind, pattern) for kind, pattern in WEAK.items()))
    return F.when(text.rlike(HINT), found).otherwise(F.expr(f"cast(array() as array<{PART}>)"))


def as_spans(parts: Column) -> Column:
    return F.transform(parts, lambda p: F.struct(p["start"].alias("start"), p["order"].alias("order"), p["end"].alias("end"), p["kind"].alias("kind")))


def shown(spans: Column) -> Column:
    """kind:start:end of sorted spans, comma-joined."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def linked_spans(parts: DataFrame) -> DataFrame:
    """(row, linked): the weak parts that a complementary part stands near. parts: row, base and weak of each text, written."""
    p = parts.where(F.size("weak") > 0).select("row", F.explode(F.concat("base", "weak")).alias("s"))
    p = p.select("row", "s", "s.telling", F.expr("s.kind in ('access', 'weak_id')").alias("is_id"), F.expr("s.kind in ('assign', 'hex', 'weak_secret')").alias("is_secret"), F.expr("s.kind like 'weak%'").alias("weak"))
    # parts that are apart: the end of one meets the start of the other, in the same cell of SCOPE or the next
    cell = lambda c: F.expr(f"cast({c} div {SCOPE} as int)")
    side = lambda after, c: F.struct(F.lit(after).alias("after"), c.alias("cell"))
    weak = p.where("weak").withColumn("at", F.explode(F.array(side(True, cell("s.end")), side(True, cell("s.end") + 1), side(False, cell("s.start")), side(False, cell("s.start") - 1))))
    near = p.select(F.col("row").alias("row2"), F.col("s").alias("t"), F.col("telling").alias("telling2"), F.col("is_id").alias("is_id2"), F.col("is_secret").alias("is_secret2"), F.col("weak").alias("weak2"), F.explode(F.array(side(True, cell("s.start")), side(False, cell("s.end")))).alias("at2"))
    weak, near = (df.select("*", f"{at}.after", f"{at}.cell").withColumnsRenamed({"after": f"after{n}", "cell": f"cell{n}"}).drop(at) for df, at, n in ((weak, "at", 1), (near, "at2", 2)))
    complementary = F.expr("""(is_id and is_secret2) or (is_secret and is_id2)
        or (not is_id and not is_secret and is_secret2 and (not weak2 or telling or telling2))
        or (is_secret and not is_id2 and not is_secret2 and (telling or telling2))""")
    gap = F.when(F.col("after1"), F.col("t.start") - F.col("s.end")).otherwise(F.col("s.start") - F.col("t.end"))
    found = weak.join(near, (weak.row == near.row2) & (F.col("after1") == F.col("after2")) & (F.col("cell1") == F.col("cell2")) & complementary & gap.between(0, SCOPE), "left_semi").select("row", "s").distinct()
    return found.groupBy("row").agg(as_spans(F.collect_list("s")).alias("linked"))


def scanned(docs: DataFrame, keep: list[str], text: str) -> DataFrame:
    """KEPT + found (all spans, sorted), base (the base spans, sorted): texts are matched once, and what is kept is written with
    the parts found; a row's own number, written too, brings its linked parts back."""
    whole = carried(docs, keep, whole=F.coalesce(F.col(text).cast("string"), F.lit("")))
    parts = written(whole.select(KEPT, F.monotonically_increasing_id().alias("row"), base_parts(F.col("whole")).alias("base"), weak_parts(F.col("whole")).alias("weak")))
    linked = written(linked_spans(parts.select("row", "base", "weak")))
    joined = parts.drop("weak").join(linked, "row", "left").withColumn("base", F.array_sort(as_spans(F.col("base"))))
    return joined.select(KEPT, F.array_sort(F.concat("base", F.coalesce("linked", F.expr(f"cast(array() as array<{SPAN}>)")))).alias("found"), "base")


def scan(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """keep + found (all spans, sorted), base (the base spans, sorted)."""
    return restored(scanned(docs, keep, text), ["found", "base"])


def masked(text: Column, found: Column, mask: str = "[SECRET]") -> Column:
    """The text with every span (those that overlap as one) replaced. Pieces are slices of the text's code points, so that
    a piece costs its own length."""
    until = lambda spans: running(F.transform(spans, lambda s: s["end"]), F.greatest)
    part = lambda chars: lambda s, at: F.when(s["start"] >= at, F.concat(F.array_join(F.slice(chars, at + 1, s["start"] - at), ""), F.lit(mask))).otherwise("")
    rest = lambda chars, last: F.array_join(F.slice(chars, last + 1, F.greatest(F.size(chars) - last, F.lit(0))), "")
    whole = lambda spans: bound(F.split(text, ""), lambda chars: F.concat(F.array_join(F.zip_with(spans, until(spans), part(chars)), ""), rest(chars, F.array_max(F.transform(spans, lambda s: s["end"])))))
    return F.when(F.size(found) > 0, bound(found, whole)).otherwise(text)


def without_secrets(docs: DataFrame, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """docs, all columns, with secrets masked in the text; the column of its length (if there is one) follows."""
    row, hit = F.col(KEPT), F.size("found") > 0
    found = scanned(docs, docs.columns, text).withColumn("masked", masked(F.col(KEPT).getField(text).cast("string"), F.col("found")))
    change = {text: F.col("masked"), length: F.when(hit, F.length("masked").cast(docs.schema[length].dataType)).otherwise(row.getField(length)) if length in docs.columns else None}
    return found.select(*((change[c] if c in change else row.getField(c)).alias(c) for c in docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: the secrets of every document."""
    found = scan(table(spark, sf_dir, "documents"), ["doc_id"])
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *(count(k) for k in BASE), F.sha2(shown(F.col("base")).cast("binary"), 256).alias("base_sha256"), shown(F.col("found")).alias("spans"))
