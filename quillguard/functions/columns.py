"""Scalar functions as column expressions; all run inside the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Score bands, rank scales, client actions.
BANDS = ((80, "critical", "block"), (60, "high", "quarantine"), (35, "suspicious", "quarantine"), (15, "low", "monitor"), (0, "benign", "allow"))
RANKS = {"benign": 0, "low": 1, "suspicious": 2, "high": 3, "critical": 4}
LEET = ("013457@$", "oieastas")
#: Digit groups in which card numbers are written.
CARD_GROUPS = ("4,4,4,4", "4,6,5", "4,6,4", "4,4,4,3", "4,4,4,2", "4,4,4,1", "4,3,3,3")


def severity(risk: Column) -> Column:
    return _band(risk, 1)


def action(risk: Column) -> Column:
    return _band(risk, 2)


def _band(risk: Column, at: int) -> Column:
    out = None
    for band in BANDS[:-1]:
        out = F.when(risk >= band[0], band[at]) if out is None else out.when(risk >= band[0], band[at])
    return out.otherwise(BANDS[-1][at])


def rank(severity_: Column) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for kv in RANKS.items() for x in kv))[severity_], F.lit(0))


def client_action(severity_: Column, block_at: str = "high") -> Column:
    """block from the threshold up, warn from suspicious up, else allow."""
    return F.when(rank(severity_) >= RANKS[block_at], "block").when(rank(severity_) >= 2, "warn").otherwise("allow")


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn_sum(number: Column) -> Column:
    """Luhn's sum of a string of digits, from the right, every second digit doubled."""
    back = F.reverse(number)
    at = lambda i: F.substring(back, i, F.lit(1)).cast("int")
    value = lambda i: F.when(i % 2 == 1, at(i)).when(at(i) > 4, at(i) * 2 - 9).otherwise(at(i) * 2)
    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(number), F.lit(1))), F.lit(0), lambda acc, i: acc + F.coalesce(value(i), F.lit(0)))


def luhn_ok(number: Column) -> Column:
    return luhn_sum(number) % 10 == 0


def card_shape_ok(number: Column) -> Column:
    """Issuer prefix with its length (public number ranges)."""
    n, p = F.length(number), lambda k: F.substring(number, 1, k).cast("int")
    long_ = n.between(16, 19)
    return (
        F.when(p(1) == 4, n.isin(13, 16, 19))
        .when(p(2).between(51, 55) | p(4).between(2221, 2720), n == 16)
        .when(p(2).isin(34, 37), n == 15)
        .when((p(4) == 6011) | (p(2) == 65) | p(3).between(644, 649) | p(4).between(3528, 3589) | (p(2) == 62), long_)
        .when(p(2).isin(36, 38, 39) | p(3).between(300, 305), n.between(14, 19))
        .when(p(4).isin(5018, 5020, 5038, 5893, 6304, 6759) | p(4).between(6761, 6763), n.between(12, 19))
        .otherwise(False)
    )


def card_grouping_ok(raw: Column) -> Column:
    """No separator, or one kind of it in one of the written groupings."""
    text = F.trim(F.regexp_replace(raw, "^[ -]+|[ -]+$", ""))
    sizes = F.array_join(F.transform(F.split(text, "[ -]"), lambda g: F.length(g).cast("string")), ",")
    mixed = F.contains(text, F.lit(" ")) & F.contains(text, F.lit("-"))
    return ~text.rlike("[ -]") | (~mixed & sizes.isin(*CARD_GROUPS))


def card_ok(raw: Column) -> Column:
    d = digits(raw)
    return card_shape_ok(d) & luhn_ok(d) & card_grouping_ok(raw)


def ssn_ok(nine: Column) -> Column:
    """Structure of a US social security number: no area 000, 666 or 9xx, no group 00, no serial 0000, no printed sample."""
    area = F.substring(nine, 1, 3)
    return nine.rlike("^[0-9]{9}$") & ~area.isin("000", "666") & ~area.startswith("9") & (F.substring(nine, 4, 2) != "00") & (F.substring(nine, 6, 4) != "0000") & ~nine.isin("078051120", "219099999", "123456789")


def weighted_sum(number: Column, weights: list[int]) -> Column:
    return sum((F.substring(number, i + 1, 1).cast("int") * w for i, w in enumerate(weights)), F.lit(0))


def npi_ok(ten: Column) -> Column:
    return ten.rlike("^[12][0-9]{9}$") & luhn_ok(F.concat(F.lit("80840"), ten))


def dea_ok(code: Column) -> Column:
    """Two letters (the second may be 9), seven digits, the last a checksum of the others."""
    d = F.substring(code, 3, 7)
    return code.rlike("^[A-Za-z][A-Za-z9][0-9]{7}$") & (weighted_sum(d, [1, 2, 1, 2, 1, 2]) % 10 == F.substring(d, 7, 1).cast("int"))


def bsn_ok(nine: Column) -> Column:
    """Dutch citizen number: eleven-test with a negative last weight."""
    s = weighted_sum(nine, [9, 8, 7, 6, 5, 4, 3, 2, -1])
    return nine.rlike("^[0-9]{9}$") & (nine != "000000000") & (s % 11 == 0)


def cpf_ok(eleven: Column) -> Column:
    """Brazilian taxpayer number: two check digits, not all digits alike."""
    check = lambda n: F.when(weighted_sum(eleven, list(range(n + 1, 1, -1))) * 10 % 11 == 10, 0).otherwise(weighted_sum(eleven, list(range(n + 1, 1, -1))) * 10 % 11)
    return eleven.rlike(r"^[0-9]{11}$") & ~eleven.rlike(r"^([0-9])\1{10}$") & (check(9) == F.substring(eleven, 10, 1).cast("int")) & (check(10) == F.substring(eleven, 11, 1).cast("int"))


def dni_ok(code: Column) -> Column:
    """Spanish identity number: letter by the number modulo 23."""
    n = F.substring(code, 1, 8).cast("int")
    return code.rlike("^[0-9]{8}[A-Za-z]$") & (F.substring(F.lit("TRWAGMYFPDXBNJZSQVHLCKE"), n % 23 + 1, F.lit(1)) == F.upper(F.substring(code, 9, 1)))


def sin_ok(nine: Column) -> Column:
    """Canadian insurance number: Luhn's sum of nine digits."""
    return nine.rlike("^[0-9]{9}$") & luhn_ok(nine)


#: Check letters of Singapore's numbers by series, and what a series adds to the sum.
NRIC_LETTERS = {"S": ("JZIHGFEDCBA", 0), "T": ("JZIHGFEDCBA", 4), "F": ("XWUTRQPNMLK", 0), "G": ("XWUTRQPNMLK", 4), "M": ("XWUTRQPNJLK", 3)}


def nric_ok(code: Column) -> Column:
    """Singapore's identity number: a check letter by the weighted sum of seven digits."""
    c = F.upper(code)
    total = weighted_sum(F.substring(c, 2, 7), [2, 7, 6, 5, 4, 3, 2])
    letter = None
    for series, (letters, plus) in NRIC_LETTERS.items():
        at = F.substring(F.lit(letters), (total + plus) % 11 + 1, F.lit(1))
        letter = F.when(c.startswith(series), at) if letter is None else letter.when(c.startswith(series), at)
    return c.rlike("^[STFGM][0-9]{7}[A-Z]$") & (F.substring(c, 9, 1) == letter)


def mask(text: Column) -> Column:
    """Dots for short values, else the first and last four characters around dots."""
    dots = F.lit("•" * 4)
    return F.when(F.length(text) <= 8, F.repeat(F.lit("•"), F.length(text))).otherwise(F.concat(F.substring(text, 1, 4), dots, F.right(text, F.lit(4))))


def leet_fold(text: Column, one: str = "i") -> Column:
    return F.translate(text, LEET[0], LEET[1].replace("i", one))


def one_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def host_of(url: Column) -> Column:
    """Host of a URL, host:port or bare name, lower-cased, without user, port or trailing dot."""
    rest = F.regexp_replace(F.lower(F.trim(url)), r"^[a-z][a-z0-9+.-]*://", "")
    bare = F.regexp_replace(F.regexp_extract(rest, r"^([^/?#]*)", 1), r"^.*@", "")
    return F.regexp_replace(F.regexp_replace(bare, r":[0-9]*$", ""), r"\.$", "")


def on_host(host: Column, domain: Column) -> Column:
    """Equal, or a subdomain by whole labels."""
    return (host == domain) | host.endswith(F.concat(F.lit("."), domain))


def suffixes(host: Column) -> Column:
    """A host and all its parent domains, so that suffix matches become equal keys."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def glob_regex(glob: str) -> str:
    """An anchored regular expression for *, ? and [...]."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        end = glob.find("]", i + 2) if c == "[" else -1
        if end > 0:
            body = glob[i + 1 : end].replace("\\", "\\\\")
            out, i = out + "[" + ("^" + body[1:] if body[0] == "!" else body) + "]", end
        else:
            out += ".*" if c == "*" else "." if c == "?" else "\\" + c if c in "\\.^$+{}()|[]" else c
        i += 1
    return f"(?s)^{out}$"


def glob_match(text: Column, glob: str) -> Column:
    return text.rlike(glob_regex(glob))


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Both ends of the 95 % interval of k in n, three decimals; null without trials."""
    k, n = k.cast("double"), n.cast("double")
    p, d = k / n, 1 + z * z / n
    centre = (p + z * z / (2 * n)) / d
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    return F.when(n > 0, F.round(F.greatest(F.lit(0.0), centre - half), 3)), F.when(n > 0, F.round(F.least(F.lit(1.0), centre + half), 3))


def slot_of(ts: Column) -> Column:
    """Hour of the week, Monday 0 o'clock is 0."""
    return F.weekday(ts) * 24 + F.hour(ts)


def age_since(text: Column, now: Column) -> Column:
    """'24h', '7d', '2w' or an ISO time, as a time."""
    n = F.regexp_extract(text, r"^([0-9]+)[hdw]$", 1).cast("int")
    hours = n * F.when(text.endswith("h"), 1).when(text.endswith("d"), 24).otherwise(168)
    return F.when(n.isNotNull(), now - F.make_dt_interval(hours=hours)).otherwise(F.try_to_timestamp(text))


def cef_header(text: Column) -> Column:
    return F.replace(F.replace(F.regexp_replace(text, r"[\r\n]+", " "), F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))


def cef_value(text: Column) -> Column:
    return F.regexp_replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("="), F.lit("\\=")), r"\r\n|\r|\n", r"\\n")


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters, in bits."""
    n = F.length(text)
    share = lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n
    shares = F.transform(F.filter(F.array_distinct(F.split(text, "")), lambda c: c != ""), share)
    return F.when(n > 0, F.aggregate(shares, F.lit(0.0), lambda acc, p: acc - p * F.log2(p))).otherwise(0.0)


def entropic(text: Column, least: float, most: int = 80) -> Column:
    """entropy(text) >= least, for a least above 0. Up to `most` characters, the number of different ones mostly settles it: the
    entropy is greatest if all are equally frequent and smallest if all but one stand once. What lies between is counted."""
    smallest = lambda n, d: math.log2(n) - (n - d + 1) * math.log2(n - d + 1) / n
    enough = [2] + [next((d for d in range(1, n + 1) if smallest(n, d) >= least + 1e-9), n + 1) for n in range(1, most + 1)]
    different = F.size(F.array_distinct(F.split(text, "")))
    return F.when(different >= F.get(F.lit(enough), F.length(text)), True).when(different <= int(2 ** (least - 1e-9)), False).otherwise(entropy(text) >= least)


def command_key(command: Column) -> Column:
    """Twelve hex digits that repeats of a command share: case, blanks, numbers and long hex don't count."""
    folded = F.regexp_replace(F.regexp_replace(one_line(F.lower(command)), "[0-9a-f]{8,}", "#"), "[0-9]+", "#")
    return F.substring(F.sha2(folded.cast("binary"), 256), 1, 12)
