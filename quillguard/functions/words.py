"""Words of a corpus as a sketch of fixed size, and the filters of random keys that ask it: identifiers, run-together words, names,
encoded prose. Learned by Spark's own aggregates, asked by built-in expressions.

A sketch has 2 ** BITS bits (256 KB), whatever the corpus; each word sets HASHES of them. A word that was learned is always
known; one that wasn't seems known with a chance that grows with the number of words (1 in 10,000 at 30,000 words).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillguard.functions.spans import let

BITS, HASHES, SHORTEST, LONGEST = 21, 4, 3, 18
CHUNK = 32_768  # bits of one of Spark's bitmaps
SEGMENT = r"[A-Z]+(?=[A-Z][a-z])|[A-Z][a-z]+|[a-z]+|[A-Z]+|[0-9]+"


def places(word: Column) -> Column:
    return F.array(*(F.pmod(F.xxhash64(word, F.lit(seed)), F.lit(1 << BITS)) for seed in range(HASHES)))


def learned(docs: DataFrame, text: str, least: int = 3) -> bytes:
    """The sketch of all words (runs of letters, lower-cased, of SHORTEST or more) that so many texts hold. Words are counted once
    a text, in parts before they meet; only the sketch comes to the driver."""
    words = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(rf"\p{{L}}{{{SHORTEST},}}"), F.lit(0)))).alias("w"))
    often = words.groupBy("w").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    at = often.select(F.explode(places(F.col("w"))).alias("p"))
    chunks = at.groupBy(F.expr(f"cast(p div {CHUNK} as int)").alias("c")).agg(F.bitmap_construct_agg(F.col("p") % CHUNK).alias("b"))
    out = bytearray(1 << BITS - 3)
    for r in chunks.collect():
        out[CHUNK // 8 * r.c : CHUNK // 8 * (r.c + 1)] = r.b
    return bytes(out)


def known(word: Column, sketch: bytes) -> Column:
    """Whether a word (in lower case) is one of the sketch's."""
    bits = F.lit(bytearray(sketch))
    byte = lambda p: F.conv(F.hex(F.substring(bits, (F.shiftright(p, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.forall(places(word), lambda p: F.getbit(byte(p), (p % 8).cast("int")) == 1)


def letters(token: Column) -> Column:
    return F.length(F.regexp_replace(token, "[^A-Za-z]", ""))


def dictionary_identifier(token: Column, sketch: bytes) -> Column:
    """Mostly letters, and two thirds of it known words once it is split at humps, underscores and digits."""
    covered = F.aggregate(F.filter(F.regexp_extract_all(token, F.lit(SEGMENT), F.lit(0)), lambda s: (F.length(s) >= SHORTEST) & known(F.lower(s), sketch)), F.lit(0), lambda n, s: n + F.length(s))
    return (letters(token) >= 0.75 * F.length(token)) & (covered >= 0.66 * F.length(token))


def word_run(token: Column, sketch: bytes) -> Column:
    """Mostly letters, and four fifths of these are known words that follow each other, the longest at each place first."""
    sizes = F.array(*(F.lit(n) for n in range(LONGEST, SHORTEST - 1, -1)))
    longest = lambda t, i: F.coalesce(F.get(F.filter(sizes, lambda n: (i + n - 1 <= F.length(t)) & known(F.substring(t, i, n), sketch)), F.lit(0)), F.lit(0))
    step = lambda t, s, i: F.when(i < s["next"], s).otherwise(let(longest(t, i), lambda n: F.struct((i + F.greatest(n, F.lit(1))).alias("next"), (s["covered"] + n).alias("covered"))))
    start = F.struct(F.lit(1).alias("next"), F.lit(0).alias("covered"))
    covered = lambda t: F.aggregate(F.sequence(F.lit(1), F.length(t)), start, lambda s, i: step(t, s, i), lambda s: s["covered"])
    run = let(F.regexp_replace(F.lower(token), "[^a-z]", ""), lambda t: F.when(F.length(t) > 0, covered(t) >= 0.8 * F.length(t)).otherwise(False))
    return F.when(letters(token) >= 0.75 * F.length(token), run).otherwise(False)


def name_like(token: Column) -> Column:
    """Pieces that can be spoken, numbers and short labels, joined by underscores or humps, with two words of four letters or
    more among them: a name, of which no corpus may know the words."""
    chunks = F.filter(F.split(token, "_"), lambda c: (c != "") & ~c.rlike("^[0-9]+$"))
    own = lambda c: F.regexp_extract(c, "^([A-Za-z]+)[0-9]{0,8}$", 1)
    humps = lambda c: F.regexp_extract_all(own(c), F.lit(SEGMENT), F.lit(0))
    spoken = lambda p: (F.length(p) >= 2) & ((F.length(p) < 3) | p.rlike("(?i)[aeiouy]"))
    fits = lambda c: F.when(own(c) == "", c.rlike("^[0-9]{1,4}[A-Za-z]{1,3}$")).otherwise((F.length(own(c)) <= 3) | F.forall(humps(c), spoken))
    words = F.aggregate(F.filter(chunks, lambda c: F.length(own(c)) > 3), F.lit(0), lambda n, c: n + F.size(F.filter(humps(c), lambda p: F.length(p) >= 4)))
    return F.forall(chunks, fits) & (words >= 2)


def encoded_prose(token: Column, sketch: bytes) -> Column:
    """Base64 of a text of three words or more, three fifths of which are known."""
    text = F.try_to_binary(F.concat(F.translate(token, "-_", "+/"), F.repeat(F.lit("="), F.pmod(-F.length(token), F.lit(4)))), F.lit("base64"))
    words = lambda t: F.regexp_extract_all(F.lower(t), F.lit("[a-z]{2,}"), F.lit(0))
    share = let(words(text.cast("string")), lambda w: (F.size(w) >= 3) & (F.size(F.filter(w, lambda x: (F.length(x) < SHORTEST) | known(x, sketch))) >= 0.6 * F.size(w)))
    return F.coalesce(F.when(text.isNotNull() & F.is_valid_utf8(text.cast("string")), share), F.lit(False))


def speaks(token: Column, sketch: bytes) -> Column:
    """Whether a token is language rather than a key."""
    return dictionary_identifier(token, sketch) | word_run(token, sketch) | name_like(token) | encoded_prose(token, sketch)
