"""Where a text's sensitive values stand, redaction by these spans, and reversible tokens of texts and request payloads.

One finder serves them all, made of built-in expressions: patterns with the tests their values must pass, so a number without
valid check digits is neither marked nor cut out.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillguard.functions import columns as C
from quillguard.functions import spans as P
from quillguard.functions.keyed import TOKEN, labelled

#: Ordered (pattern, replacement); a group that is kept comes first.
PATTERNS = (
    (r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----", "[PRIVATE KEY]"),
    (r"""(?i)((?:password|passwd|secret|token|api_?key)["']?[ ]*[:=][ ]*["']?)[A-Za-z0-9+/_.=-]{8,}""", "$1[SECRET]"),
    (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "[SSN]"),
)
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}"
#: Kinds of values, the one that names a merged span first, and what stands in for them.
SPAN_KINDS = ("block", "secret", "ssn", "card", "health", "email")
NAMES = {"block": "secret"}
MARKERS = {"block": "[PRIVATE KEY]", "secret": "[SECRET]", "ssn": "[SSN]", "card": "[CARD]", "health": "[PHI]", "email": "[EMAIL]"}
PERSONAL = ("ssn", "card", "health", "email")
#: Marks, joiners and modifiers that belong to the character before them; a span takes them along.
CLINGING = r"[\p{M}\x{200d}\x{fe0e}\x{fe0f}\x{1f3fb}-\x{1f3ff}]*"


def redact_patterns(text: Column, patterns=PATTERNS) -> Column:
    for pattern, instead in patterns:
        text = F.regexp_replace(text, pattern, instead)
    return text


def each_match(text: Column, pattern: str, new) -> Column:
    """The text with every match m of a pattern replaced by new(m): matches are found, then what stands between them is joined."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    return F.when(F.size(hits) > 0, F.array_join(F.zip_with(gaps, hits, lambda g, h: F.concat(g, F.coalesce(new(h), F.lit("")))), "")).otherwise(text)


def finders(kinds: tuple[str, ...]) -> list[tuple[str, str, object, tuple[str, ...], str]]:
    """(kind, pattern, which matches count, plain strings of which a text with a match holds one, gate) of some kinds."""
    from quillguard.operators import detectors as D

    real = lambda m: ~m.rlike(D.PLACEHOLDER)
    formats = [("secret", p, real, D.sure(name, p), "assigned" if name == "assignment" else "format") for name, p in D.SECRETS + D.MORE_SECRETS]
    every = [
        ("block", PATTERNS[0][0], None, ("PRIVATE KEY",), "format"), *formats, ("secret", r"[A-Za-z0-9_]{24,80}", lambda m: F.size(D.random_keys(m)) > 0, (), "random"),
        ("ssn", PATTERNS[2][0], lambda m: C.ssn_ok(C.digits(m)), (), "ssn"), ("card", "[0-9](?:[ -]?[0-9]){12,18}", C.card_ok, (), "card"),
        ("health", r"(?<![0-9])[12][0-9]{9}(?![0-9])", C.npi_ok, (), "npi"), ("email", EMAIL, None, ("@",), "mail"),
    ]
    return [f for f in every if f[0] in kinds]


def spans_of(text: Column, kinds: tuple[str, ...] = SPAN_KINDS, patterns: dict[str, str] | None = None, bits: Column | None = None) -> Column:
    """array<struct<start,end,kind>> of sensitive values, kind a number: that of SPAN_KINDS, or of patterns if these are given.
    bits: the text's gates (detectors.gates); the formats behind a gate that it doesn't pass aren't looked for."""
    from quillguard.operators import detectors as D

    chosen = [(k, p, None, (), None) for k, p in patterns.items()] if patterns else finders(kinds)
    order = list(patterns) if patterns else list(SPAN_KINDS)
    none = F.expr(f"cast(array() as {P.SPANS})")

    def found(t, kind, pattern, valid, sure):
        bare = (lambda m: valid(F.regexp_replace(m, f"{CLINGING}$", ""))) if valid else None
        each = F.transform(P.matches(t, f"(?:{pattern}){CLINGING}", bare), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lit(order.index(kind)).alias("kind")))
        return F.when(D.holds_any(t, sure), each).otherwise(none) if sure else each

    def formats(t, fs):
        """As the concatenation of found over the formats, in one expression: they differ in nothing but pattern and plain strings."""
        kind, valid = fs[0][0], fs[0][2]
        table = F.array(*(F.struct(F.lit(f"(?:{p}){CLINGING}").alias("pattern"), F.array(*map(F.lit, sure)).alias("sure")) for _, p, _, sure, _ in fs if sure))
        held = F.filter(table, lambda f: F.exists(f["sure"], lambda x: F.contains(t, x)))
        each = lambda f: P.matches(t, f["pattern"], lambda m: valid(F.regexp_replace(m, f"{CLINGING}$", "")))
        spans = F.transform(F.flatten(F.transform(held, each)), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lit(order.index(kind)).alias("kind")))
        return F.concat(spans, *(found(t, *f[:4]) for f in fs if not f[3]))

    def behind(t, gate):
        fs = [f for f in chosen if f[4] == gate]
        alike = [f for f in fs if gate == "format" and f[0] == "secret"]
        each = F.concat(*(found(t, *f[:4]) for f in fs if f not in alike), *([formats(t, alike)] if alike else []))
        return each if bits is None or gate is None else F.when(D.passes(bits, gate), each).otherwise(none)

    return P.let(F.coalesce(text, F.lit("")), lambda t: P.merged(F.concat(*(behind(t, gate) for gate in dict.fromkeys(f[4] for f in chosen)))))


def kind_of(number: Column, kinds=SPAN_KINDS) -> Column:
    return F.get(F.array(*(F.lit(NAMES.get(k, k)) for k in kinds)), number)


def with_spans(df: DataFrame, text: str, kinds: tuple[str, ...] = SPAN_KINDS) -> DataFrame:
    """Adds spans: array<struct<start,end,kind>> of sensitive values in code points, end exclusive; overlapping ones merged."""
    from quillguard.operators import detectors as D

    gated = df.withColumn("__bits", D.held_gates(F.col(text)))
    return gated.withColumn("spans", F.transform(spans_of(F.col(text), kinds, bits=F.col("__bits")), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), kind_of(s["kind"]).alias("kind")))).drop("__bits")


def redact_text(text: Column, kinds: tuple[str, ...] = SPAN_KINDS[:-1], bits: Column | None = None) -> Column:
    """The text with its sensitive values' markers in their place: key blocks, assigned secrets (the name stays), vendors'
    formats, random keys, social security numbers, cards and health ids that are valid."""
    head = PATTERNS[1][0].removesuffix("[A-Za-z0-9+/_.=-]{8,}")
    marker = lambda s: F.concat(F.regexp_extract(s["text"], f"^{head}", 1), F.get(F.array(*(F.lit(MARKERS[k]) for k in SPAN_KINDS)), s["kind"]))
    return P.let(text, lambda t: P.replaced(t, P.with_text(t, spans_of(t, kinds, bits=bits), "kind"), marker))


def utf16(text: Column, at: Column) -> Column:
    """A place in code points as one in UTF-16 units."""
    return at + F.size(F.filter(P.matches(text, r"[\x{10000}-\x{10ffff}]"), lambda m: m["start"] < at))


def masked_signals(signals: Column) -> Column:
    """Signals without clear values: evidence redacted and shortened; what can't be redacted is emptied."""
    from quillguard.functions.columns import mask

    return F.transform(signals, lambda s: s.withField("evidence", F.coalesce(F.when(s["category"].isin("secret_leak", "pii_leak", "phi_leak"), mask(s["evidence"])).otherwise(redact_patterns(s["evidence"])), F.lit(""))).withField("detail", F.coalesce(redact_patterns(s["detail"]), F.lit(""))))


#: What removing values from a text doesn't change: acts of agents, servers, posture.
NEVER = ("dangerous_action", "agent_autonomy", "tool_poisoning", "untrusted_server", "sensitive_access", "posture_gap", "oversharing", "dependency_risk", "ci_risk")


def locatable(signals: Column, never: tuple[str, ...] = NEVER, by: tuple[str, ...] = ("shadow_ai",)) -> Column:
    """Whether redaction may cure a row: it has signals of values, all from detectors whose matches have a place in the text,
    and none that no redaction changes. Whether it does, a second verdict over the redacted text decides."""
    values = F.filter(signals, lambda s: s["category"].isin("secret_leak", "pii_leak", "phi_leak"))
    return (F.size(values) > 0) & F.forall(values, lambda s: s["detector"].isin(*by)) & ~F.exists(signals, lambda s: s["category"].isin(*never))


def tokenized(text: Column, key: bytes, kinds: tuple[str, ...] = PERSONAL, patterns: dict[str, str] | None = None, bits: Column | None = None) -> Column:
    """struct<tokenized, tokens>: the text with tokens for its values, and what each token stands for. A null text stays null.
    bits: see spans_of."""
    names = [n.upper() for n in patterns or SPAN_KINDS]
    named = lambda s: F.transform(s, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["text"].alias("text"), labelled(F.get(F.array(*map(F.lit, names)), x["kind"]), x["text"], key).alias("token")))
    pairs = lambda s: F.map_from_entries(F.array_distinct(F.transform(s, lambda x: F.struct(x["token"].alias("key"), x["text"].alias("value")))))
    return P.let(text, lambda t: P.let(named(P.with_text(t, spans_of(t, kinds, patterns, bits), "kind")), lambda s: F.struct(P.replaced(t, s, lambda x: x["token"]).alias("tokenized"), pairs(s).alias("tokens"))))


def tokenize(df: DataFrame, text: str, key: bytes, patterns: dict[str, str] | None = None) -> DataFrame:
    """Adds tokenized and tokens (map token -> value), so that detokenize gives the text back."""
    return df.withColumn("__t", tokenized(F.col(text), key, patterns=patterns)).select(*df.columns, "__t.tokenized", "__t.tokens")


def detokenize(text: Column, tokens: Column) -> Column:
    """The text with known tokens turned back, each once; what a value holds isn't read again. Unknown tokens stay."""
    return P.let(F.struct(text.alias("t"), tokens.alias("tokens")), lambda x: each_match(x["t"], TOKEN, lambda m: F.coalesce(F.try_element_at(x["tokens"], m), m)))


LITERAL = r'"(?:[^"\\]++|\\.)*+"'
STRING, MARKS, COLON = re.compile(LITERAL), re.compile(r"[\[\]{},]"), re.compile(r"[ \t-\r]*:")
#: Where public request formats keep what a person or a tool wrote; what names, types and ids are called there.
PROMPT = r"^\$\.(?:messages|system|input|inputs|instructions|prompt|contents|systemInstruction|system_instruction|query|question)\b"
NEVER_PATH = r"^\$\.(?:model|tools|tool_choice|functions|metadata)\b"
NAME_KEY = r"\.(?:model|role|type|id|name|tool_call_id|tool_use_id|call_id|mime_type|mimeType|media_type|format|object|status)$"
TOOL_VALUES = r"\.(?:arguments|args|response)\b|\]\.input\b"


TOKENIZED = "struct<tokenized:string,tokens:map<string,string>>"
PLACES = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("text", pa.string()), ("value", pa.string()), ("path", pa.string())]))


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField(f.name, T.IntegerType() if f.type == pa.int32() else T.StringType()) for f in PLACES.value_type])))
def literals(payloads: pa.Array) -> pa.Array:
    """array<struct<start,end,text,value,path>> of a JSON text's strings: value decoded; path where it stands ($.a.b[] for an
    element of a list), null for a key. A null text gives null.

    One walk over the strings and the marks between them, with the containers that are open and the last key.
    """
    starts, ends, texts, values, paths, sizes = [], [], [], [], [], [0]
    for payload in payloads.to_pylist():
        held, key, at = ["$"], "", 0
        for m in STRING.finditer(payload or ""):
            for mark in MARKS.findall(payload, at, m.start()):
                if mark in "{[":
                    held.append(key + "[]" * (mark == "["))
                elif mark in "}]":
                    del held[max(1, len(held) - 1) :]
                key = ""
            at, value = m.end(), json.loads(m[0], strict=False).encode("utf-8", "replace").decode()
            if named := COLON.match(payload, at):
                key = value
            starts.append(m.start())
            ends.append(at)
            texts.append(m[0])
            values.append(value)
            paths.append(None if named else ".".join(p for p in (*held, key) if p).replace(".[]", "[]"))
        sizes.append(len(starts))
    rows = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip((starts, ends, texts, values, paths), PLACES.value_type)], fields=list(PLACES.value_type))
    return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), rows, mask=payloads.is_null())


def encoded(text: Column) -> Column:
    """A text as a JSON string, quotes included."""
    return F.when(text.isNotNull(), P.let(F.to_json(F.array(text)), lambda j: F.substring(j, F.lit(2), F.length(j) - 2)))


def is_json(text: Column) -> Column:
    return F.coalesce(text.rlike(r"^\s*[\[{]"), F.lit(False)) & F.try_parse_json(text).isNotNull()


def written_by_someone(paths: Column) -> Column:
    """For each path whether its string is what a person or a tool wrote, not a name, type or id. In a payload of no known
    format every string is."""
    p = lambda x, pattern: F.coalesce(x.rlike(pattern), F.lit(False))
    known = lambda all_: F.exists(all_, lambda x: p(x, PROMPT))
    return P.let(paths, lambda a: P.let(known(a), lambda k: F.transform(a, lambda x: x.isNotNull() & ~p(x, NEVER_PATH) & (~k | p(x, PROMPT)) & (p(x, TOOL_VALUES) | ~p(x, NAME_KEY)))))


def tokenized_payload(payload: Column, found: Column, bits: Column, key: bytes, kinds: tuple[str, ...] = PERSONAL, patterns: dict[str, str] | None = None) -> Column:
    """As tokenized, over a request payload: strings that a person or a tool wrote are decoded, tokenized and encoded again; keys,
    names, ids, numbers and everything between strings stay byte for byte. A text that isn't a JSON object or list (found: its
    literals, null then) is tokenized as a text. bits: the gates that its values may pass."""
    each = lambda found, ok, b: F.transform(found, lambda m, i: F.when(F.get(ok, i), tokenized(m["value"], key, kinds, patterns, b)).otherwise(F.lit(None).cast(TOKENIZED)))
    new = lambda found, done: F.filter(F.transform(found, lambda m, i: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.get(done, i)["tokenized"].alias("text"), F.coalesce(F.size(F.get(done, i)["tokens"]), F.lit(0)).alias("n"))), lambda m: m["n"] > 0)
    tokens = lambda done: F.map_from_entries(F.array_distinct(F.flatten(F.transform(F.filter(done, lambda d: d.isNotNull()), lambda d: F.map_entries(d["tokens"])))))
    walk = lambda t, found, b: P.let(each(found, written_by_someone(F.transform(found, lambda m: m["path"])), b), lambda done: F.struct(P.replaced(t, new(found, done), lambda m: encoded(m["text"])).alias("tokenized"), tokens(done).alias("tokens")))
    # what Python gives is bound outside of the lambdas that name it; both ways stand under when, for the optimizer takes what is
    # picked out of an array as cheap and makes it anew for each column that names it
    bound = F.struct(payload.alias("t"), found.alias("found"), bits.alias("bits"))
    return F.when(found.isNotNull(), P.let(bound, lambda x: walk(x["t"], x["found"], x["bits"]))).otherwise(P.let(bound, lambda x: tokenized(x["t"], key, kinds, patterns, x["bits"])))


def tokenize_payload(df: DataFrame, payload: str, key: bytes, patterns: dict[str, str] | None = None) -> DataFrame:
    """Adds tokenized and tokens of request payloads; detokenize_payload gives the payload back."""
    from quillguard.operators import detectors as D

    p = F.col(payload)
    # a value's letters stand in the payload as they are, but for escapes by number
    bits = F.when(F.contains(p, F.lit("\\u")), F.lit(-1).cast("long")).otherwise(D.gates(p))
    staged = df.withColumns({"__found": literals(F.when(is_json(p), p)), "__bits": bits})
    made = staged.withColumn("__t", tokenized_payload(p, F.col("__found"), F.col("__bits"), key, patterns=patterns))
    return made.select(*df.columns, "__t.tokenized", "__t.tokens")


def detokenize_payload(payload: Column, tokens: Column) -> Column:
    """A payload with known tokens turned back inside its strings, values encoded as they must be there; a string that is JSON
    itself, as a tool call's arguments are, stays JSON."""
    escaped = lambda v: P.let(encoded(v), lambda e: F.substring(e, F.lit(2), F.length(e) - 2))
    back = lambda v, known: F.when(is_json(v), each_match(v, TOKEN, lambda m: F.coalesce(escaped(F.try_element_at(known, m)), m))).otherwise(detokenize(v, known))
    # a match that goes on to a colon is a key
    value = lambda m: F.get(F.from_json(F.concat(F.lit("["), m["text"], F.lit("]")), "array<string>"), F.lit(0))
    touched = lambda t: F.filter(P.matches(t, rf"(?:{LITERAL})(?:\s*:)?+"), lambda m: m["text"].rlike(TOKEN) & ~m["text"].endswith(":"))
    whole = lambda t, known: P.replaced(t, touched(t), lambda m: encoded(back(value(m), known)))
    bound = F.struct(payload.alias("t"), tokens.alias("tokens"))
    return P.let(bound, lambda x: F.when(is_json(x["t"]), whole(x["t"], x["tokens"])).otherwise(detokenize(x["t"], x["tokens"])))
