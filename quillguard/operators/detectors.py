"""Text detectors as column expressions: row -> array of signals.

Phrases are patterns built of a few word lists; vendors' key formats are those their public documents give.
"""

from __future__ import annotations

import re
from functools import reduce, wraps

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillguard.functions import columns as C
from quillguard.functions import scoring as S
from quillguard.functions.text import MEDIA, entropy_tokens, synthetic, without_media, wordlike

#: Public vendor formats; bounded repeats keep them linear.
SECRETS = (
    ("assignment", r"""(?i)(password|passwd|secret|token|api_?key)["']?[ ]*[:=][ ]*["']?[A-Za-z0-9+/_.=-]{8,}"""),
    ("aws_access_key", r"AKIA[0-9A-Z]{16}"),
    ("github_token", r"gh[pousr]_[A-Za-z0-9]{36}"),
    ("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
MORE_SECRETS = (
    ("slack_token", r"xox[abeprs]-[A-Za-z0-9-]{10,200}"), ("slack_webhook", r"https://hooks\.slack\.com/(?:services|workflows)/[A-Za-z0-9/_+-]{20,120}"), ("stripe_key", r"(?:sk|rk)_(?:live|test)_[A-Za-z0-9]{16,100}"),
    ("stripe_webhook", r"whsec_[A-Za-z0-9+/]{32,100}"), ("google_key", r"AIza[0-9A-Za-z_-]{35}"), ("google_oauth_secret", r"GOCSPX-[A-Za-z0-9_-]{28}"), ("google_oauth_token", r"ya29\.[A-Za-z0-9_-]{30,300}"),
    ("gitlab_token", r"gl(?:pat|ptt|dt|rt|soat|ft)-[0-9A-Za-z_-]{20,64}"), ("github_pat", r"github_pat_[A-Za-z0-9_]{60,100}"), ("npm_token", r"npm_[A-Za-z0-9]{36}"), ("pypi_token", r"pypi-AgEIcHlwaS5vcmc[A-Za-z0-9_-]{50,500}"),
    ("rubygems_key", r"rubygems_[0-9a-f]{48}"), ("docker_token", r"dckr_pat_[A-Za-z0-9_-]{27}"), ("jwt", r"eyJ[A-Za-z0-9_-]{10,1000}\.eyJ[A-Za-z0-9_-]{10,1000}\.[A-Za-z0-9_-]{10,1000}"),
    ("connection_string", r"(?i)(?:postgres(?:ql)?|mysql|mariadb|mongodb(?:\+srv)?|rediss?|amqps?|mssql|clickhouse)://[^\s:@/]{1,100}:[^\s@/]{3,200}@"), ("basic_auth_url", r"https?://[^\s:@/]{1,100}:[^\s@/]{6,200}@[A-Za-z0-9.-]+"),
    ("sendgrid_key", r"SG\.[A-Za-z0-9_-]{22}\.[A-Za-z0-9_-]{43}"), ("mailgun_key", r"\bkey-[0-9a-f]{32}\b"), ("mailchimp_key", r"\b[0-9a-f]{32}-us[0-9]{1,2}\b"), ("twilio_key", r"\bSK[0-9a-f]{32}\b"),
    ("aws_temporary_key", r"\bASIA[0-9A-Z]{16}\b"), ("aws_secret", r"""(?i)aws_?(?:secret)?_?(?:access)?_?key["']?\s*[:=]\s*["']?[A-Za-z0-9/+]{40}\b"""), ("azure_storage", r"AccountKey=[A-Za-z0-9+/]{86}=="),
    ("azure_sas", r"(?i)[?&]sig=[A-Za-z0-9%+/]{40,120}"), ("gcp_service_account", r'"private_key_id"\s*:\s*"[0-9a-f]{40}"'), ("digitalocean_token", r"do[opr]_v1_[0-9a-f]{64}"), ("heroku_key", r"HRKU-[0-9A-Za-z_-]{30,70}"),
    ("cloudflare_origin", r"v1\.0-[0-9a-f]{24}-[0-9a-f]{146}"), ("vault_token", r"\bhv[sbr]\.[A-Za-z0-9_-]{24,200}"), ("terraform_token", r"[A-Za-z0-9]{14}\.atlasv1\.[A-Za-z0-9_-]{60,70}"), ("databricks_token", r"\bdapi[0-9a-f]{32}\b"),
    ("huggingface_token", r"\bhf_[A-Za-z0-9]{34}\b"), ("replicate_token", r"\br8_[A-Za-z0-9]{37}\b"), ("shopify_token", r"\bshp(?:at|ca|pa|ss)_[0-9a-fA-F]{32}\b"), ("square_token", r"\b(?:EAAA|sq0csp-|sq0atp-)[A-Za-z0-9_-]{22,60}\b"),
    ("paypal_token", r"access_token\$production\$[0-9a-z]{16}\$[0-9a-f]{32}"), ("telegram_token", r"\b[0-9]{8,10}:AA[A-Za-z0-9_-]{33}\b"), ("discord_webhook", r"https://discord(?:app)?\.com/api/webhooks/[0-9]{17,20}/[A-Za-z0-9_-]{60,80}"),
    ("linear_key", r"\blin_api_[A-Za-z0-9]{40}\b"), ("notion_token", r"\b(?:secret_[A-Za-z0-9]{43}|ntn_[A-Za-z0-9]{40,50})\b"), ("figma_token", r"\bfigd_[A-Za-z0-9_-]{40}\b"), ("postman_key", r"PMAK-[0-9a-f]{24}-[0-9a-f]{34}"),
    ("grafana_token", r"\bglsa_[A-Za-z0-9]{32}_[0-9a-f]{8}\b"), ("newrelic_key", r"\bNRAK-[A-Z0-9]{27}\b"), ("sentry_token", r"\bsntry[su]_[A-Za-z0-9+/=_-]{40,200}"), ("pulumi_token", r"\bpul-[0-9a-f]{40}\b"), ("age_key", r"AGE-SECRET-KEY-1[0-9A-Z]{58}"),
    ("bearer_header", r"(?i)authorization\s*:\s*bearer\s+[A-Za-z0-9._~+/-]{20,500}"),
)
#: What a match holds if it only stands for a secret.
PLACEHOLDER = r"(?i)example|placeholder|your[_-]|changeme|change_me|redacted|dummy|x{5,}|\*{3,}|\.\.\.|0{8,}|1{8,}|<[a-z_ -]+>|\$\{"
VERB, QUANTITY = r"(?:ignore|disregard|forget|override|bypass|discard|overlook|neglect)", r"(?: (?:all|any|every|each|of|the|your|my|these|those|its|our|other|and|everything))*"
WHICH, WHAT = r"(?:previous|prior|preceding|earlier|above|foregoing|existing|original|initial|current|system|past|former|safety|default)", r"(?:instructions?|directions?|rules?|prompts?|guidelines?|messages?|commands?|orders?|constraints?|polic(?:y|ies)|context|programming|training|directives?)"
#: Patterns over a text in lower case with single blanks; each that occurs counts once.
OVERRIDE = (
    rf"{VERB}{QUANTITY}(?: {WHICH})+ {WHAT}", rf"{VERB}(?: (?:all|any|of|the|your|my))* {WHAT}", rf"{VERB} (?:all |everything |the )*(?:above|previous|prior)", rf"{VERB} (?:everything|anything|all|what) (?:before|you (?:were|have been|are) told|you know|i said|that came before)",
    rf"(?:new|updated|revised|real|actual|true) (?:system )?{WHAT} ?:", rf"do not (?:follow|obey|listen to|comply with){QUANTITY}(?: {WHICH})+", r"you (?:must|will|shall|are to) now (?:obey|follow|act|respond|answer|comply|ignore)", r"from now on,? (?:you|ignore|respond|answer|act as)",
    r"(?:reveal|print|show|repeat|output|display|tell me|leak|expose)(?: (?:me|all|the|your|of|full|entire|exact|complete|hidden|secret|original|verbatim))* (?:system|initial|hidden|secret) (?:prompt|instructions?|message|rules)",
    rf"(?:your|the) {WHAT} (?:is|are|have been|has been) (?:now )?(?:void|null|cancel(?:l)?ed|replaced|overridden|suspended|lifted|obsolete)", r"(?:enter|enable|activate|switch to|begin) (?:the )?(?:admin|root|debug|maintenance|override|sudo|god) mode",
    r"<\|?im_start\|?>|\[/?inst\]|<<sys>>|### ?(?:system|instruction) ?:", r"(?:this|that) (?:overrides|supersedes|replaces) (?:all|any|your|the) (?:previous|prior|other|earlier|existing)", r"stop (?:being|acting as) (?:an? )?(?:assistant|ai\b|chatbot)",
    r"(?:as|i am) (?:your|the) (?:developer|administrator|creator|owner),? (?:and )?i (?:order|command|authorize|instruct|permit)",
)
JAILBREAK = (
    r"(?:developer|dan|god|jailbreak|unrestricted|unfiltered|evil|chaos|opposite) mode(?: is)?(?: now)?(?: enabled| activated| on\b| engaged)", r"jailbreak mode", r"do anything now", r"you (?:are|will be|have become)(?: now)? (?:dan\b|stan\b|jailbroken|unrestricted|unfiltered|no longer bound|free from (?:all|any))",
    r"(?:without|no|free (?:of|from)|ignoring)(?: (?:any|all|your|its))* (?:restrictions|limitations|filters|censorship|ethical (?:guidelines|constraints|limits)|moral (?:constraints|guidelines)|safety (?:guidelines|filters|rules|protocols)|content polic(?:y|ies)|guardrails)",
    r"(?:pretend|imagine|act as if|roleplay|role-play|behave as if|simulate)(?: (?:that|you|to|be|being|an?|are|have|having|as))* (?:no rules|no restrictions|no limits|unrestricted|unfiltered|amoral|uncensored|evil)", r"you (?:can|may|must|will) (?:never|not) (?:refuse|decline|say no|reject)", r"never (?:refuse|decline) (?:a|any|my)\b",
    r"(?:stay|remain) in character (?:no matter|at all times|always|regardless)", r"hypothetically,? (?:if )?you (?:had|have) no (?:rules|restrictions|limits|filters)", r"(?:disable|turn off|deactivate|remove|switch off)(?: (?:all|your|the|any))* (?:safety|content filters?|moderation|guardrails|ethics)", r"uncensored (?:ai|model|assistant|version)|anti-?gpt",
)
CARGO = r"(?:data|contents?|files?|records?|messages?|emails?|conversations?|chat (?:history|logs?)|credentials?|secrets?|passwords?|api keys?|tokens?|database|documents?|environment variables|source code|history)"
EXFILTRATION = (
    rf"(?:send|upload|post|forward|transmit|copy|leak|email|export|submit|dump)(?: (?:me|all|the|these|those|this|your|our|any|every|of|entire|full|complete|user|customer|private|internal|confidential|sensitive))* {CARGO}(?: [a-z]+)? (?:to|at|via|through)\b", r"upload this to", r"exfiltrat(?:e|ed|es|ing|ion)",
    r"!\[[^\]]{0,200}\]\(https?://[^)\s]{1,300}[?&][^)\s]{0,100}=(?:\{|\$|%7b|<)", r"(?:encode|base64|hex)[^.\n]{0,60}(?:and|then) (?:send|append|include|post|put)[^.\n]{0,60}(?:url|query|request|link|image)",
    r"(?:append|include|embed|put|insert|add)(?: [a-z]+){0,6} (?:in|to|into|as)(?: (?:the|a|an))? (?:url|query string|query parameter|image link|markdown image|dns (?:query|lookup))", r"(?:curl|wget)\b[^\n|]{0,120} (?:-d|--data|--post-file|-t|--upload-file|-f)\b[^\n]{0,80}(?:\.env|id_rsa|credentials|/etc/passwd|shadow)",
)
#: What any of the phrases needs; texts without it skip them.
PHRASE_STEMS = ("ignor", "disregard", "forget", "overrid", "bypass", "discard", "overlook", "neglect", "instruct", "system", "prompt", "now obey", "from now on", "must now", "mode", "sudo", "im_start", "supersede", "assistant", "developer", "anything now", "jailb", "restrict", "limit", "filter", "censor", "ethic", "moral", "safety", "guardrail", "refus", "declin", "pretend", "character", "send", "upload", "post", "forward", "transmit", "leak", "exfil", "email", "export", "submit", "dump", "copy", "encod", "base64", "append", "embed", "include", "insert", "curl", "wget", "![")
#: A phrase in quotes behind a word that only mentions it.
MENTION = r"""(?:phrases?|words?|strings?|terms?|says?|said|called|such as|like|e\.g\.|examples?|titled|keywords?|patterns?|quotes?)(?: [a-z]+)? ?[:,]? ?["'`“‘«][^"'`”’»]{1,200}["'`”’»]"""
#: A classification that is applied to a text, as orders on it, a banner in capitals, a header, a label or "marked as"; prose that
#: speaks of confidentiality is none.
MARKERS = (
    r"(?i:\b(?:strictly confidential|company confidential|internal (?:use )?only|do not distribute|not for distribution|attorney[- ]client privileged)\b)|\b(?:CONFIDENTIAL|PROPRIETARY|RESTRICTED|TRADE SECRET|ATTORNEY-CLIENT)\b"
    r"|(?i:\b(?:marked|classified|labell?ed|tagged|stamped)(?: as)? (?:strictly |highly )?(?:confidential|proprietary|restricted|secret|internal)\b)|(?im:^\s*(?:confidential|proprietary|restricted|trade secret)\s*:)|\bTLP[: -]?(?:RED|AMBER|GREEN|CLEAR|WHITE)\b"
    r"|(?i:\b(?:data )?(?:classification|sensitivity)\s*[:=]\s*(?:highly )?(?:confidential|restricted|secret|internal)\b|\[(?:internal|restricted|secret|(?:highly )?confidential)\]|\b(?:MIP|Purview) label\b)"
)
#: What any marker holds in lower case; texts without it skip the pattern.
MARKER_STEMS = ("confidential", "internal", "not distribute", "for distribution", "attorney", "proprietary", "restricted", "secret", "tlp", "mip label", "purview label")
AUTONOMY = r"(?i)--(?:dangerously-skip-permissions|yolo|auto-approve|no-confirm)\b"
DANGEROUS = r"(?i)\brm\s+-[a-z]*r[a-z]*f?[a-z]*\s+(?:/|~)|\b(?:curl|wget)\b[^|\n]{1,300}\|\s*(?:ba|z|da)?sh\b|\bmkfs\.|\bdd\s+if=[^\n]{1,100}\s+of=/dev/|:\(\)\s*\{\s*:\|:&\s*\};:"
SENSITIVE_PATH = r"(?i)(?:/|\\|~/)(?:\.ssh/(?:id_[a-z0-9]+|authorized_keys)|\.aws/credentials|\.kube/config|\.netrc|etc/shadow)\b(?!\.pub)"
INVISIBLE = r"[\x{200b}\x{200c}\x{200d}\x{2060}\x{feff}]|[\x{e0000}-\x{e007f}]"
CODE = r"(?m)^\s*(?:def |class |import |from \w+ import|public (?:class|static)|function \w+\(|#include|SELECT .{1,200} FROM )"
EMAIL = r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9.-]{1,253}[.][A-Za-z]{2,}"
PERSONAL = ("gmail.com", "outlook.com", "hotmail.com", "yahoo.com", "icloud.com", "proton.me", "gmx.de", "web.de")
ROLE_PARTS = r"^(?:info|support|sales|admin|contact|help|hello|office|team|billing|noreply|no-reply|donotreply|postmaster|webmaster|abuse|security|privacy|press|jobs|hr|marketing|service|newsletter)(?:[+._-].*)?@"
RESERVED = r"(?i)@(?:[A-Za-z0-9-]+\.)*(?:example\.(?:com|net|org)|example|test|invalid|localhost)$"
IBAN = r"\b[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){3,7}(?:[ ]?[A-Z0-9]{1,3})?\b"
NINO = r"\b[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z] ?[0-9]{2} ?[0-9]{2} ?[0-9]{2} ?[A-D]\b"
#: Numbers that count near a word only: (check, word, pattern, which numbers are valid).
KEYED = (
    ("canadian_sin", r"\bSIN\b|social insurance", r"\b[0-9]{3}[ -]?[0-9]{3}[ -]?[0-9]{3}\b", lambda m: C.sin_ok(C.digits(m))), ("dutch_bsn", r"\bBSN\b|burgerservicenummer", r"\b[0-9]{9}\b", C.bsn_ok),
    ("brazilian_cpf", r"\bCPF\b", r"\b[0-9]{3}\.?[0-9]{3}\.?[0-9]{3}-?[0-9]{2}\b", lambda m: C.cpf_ok(C.digits(m))), ("singapore_nric", r"\bNRIC\b|\bFIN\b", r"\b[STFGM][0-9]{7}[A-Z]\b", C.nric_ok), ("spanish_dni", r"\bDNI\b|\bNIE\b", r"\b[0-9]{8}[A-Za-z]\b", C.dni_ok),
    ("passport", r"(?i)passport", r"\b[A-Z]{1,2}[0-9]{6,8}\b", lambda m: F.lit(True)), ("drivers_license", r"(?i)driver'?s? licen[cs]e", r"\b[A-Z][0-9]{6,12}\b", lambda m: F.lit(True)), ("plain_ssn", r"(?i)\bssn\b|social security", r"\b[0-9]{9}\b", C.ssn_ok),
    ("birth_date", r"(?i)date of birth|\bdob\b", r"\b(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}\b|\b[0-9]{1,2}/[0-9]{1,2}/(?:19|20)[0-9]{2}\b", lambda m: F.lit(True)),
)
KEYED_STEMS = ("sin", "insurance", "bsn", "burgerservice", "cpf", "nric", "fin", "dni", "nie", "passport", "licen", "ssn", "security", "birth", "dob")
MBI = r"\b[1-9][AC-HJKMNP-RT-Y][AC-HJKMNP-RT-Y0-9][0-9]-?[AC-HJKMNP-RT-Y][AC-HJKMNP-RT-Y0-9][0-9]-?[AC-HJKMNP-RT-Y]{2}[0-9]{2}\b"
RECORD_NUMBER = r"(?i)\b(?:mrn|medical record (?:number|no)|patient id|member id|policy number)\b[ #:.]{0,4}[A-Z0-9-]{6,15}\b"
DIAGNOSIS = r"\b[A-TV-Z][0-9][0-9AB](?:\.[0-9A-Z]{1,4})\b"
HEALTH_WORDS = r"(?i)\b(?:patient|diagnosis|medical record|mrn|prescri(?:bed|ption)|health plan)\b"
SCHEMA = r"(?i)\b(?:insert into|update|delete from|alter table|create table|join|from) [a-z_]+\.[a-z_]+\b"
INTERNAL = r"(?i)\b[a-z][a-z0-9_]*\.(?:internal|corp|local|intra|lan)\b|\bfrom (?:internal|private|corp)\.[a-z_.]+ import\b"


def has_term(text: Column, terms: tuple[str, ...]) -> Column:
    """Whether the text, lower-cased with single spaces, holds any of the terms."""
    flat = F.regexp_replace(F.lower(text), r"\s+", " ")
    return F.exists(F.lit(list(terms)), lambda t: F.contains(flat, t))


PHRASES = OVERRIDE + JAILBREAK + EXFILTRATION


def made_once(make):
    """make, whose columns are kept with its arguments as long as the JVM that has them: they name columns, so they serve any table,
    and it takes thousands of calls to that JVM to make them."""
    kept: dict = {}

    @wraps(make)
    def made(*args):
        if kept.get("in") is not SparkContext._gateway:
            kept.clear()
            kept["in"] = SparkContext._gateway
        if args not in kept:
            kept[args] = make(*args)
        return kept[args]

    return made


#: PHRASES without word edges, and those of them that count many repeats, which RE2 tries by themselves.
EDGELESS = tuple(p.replace(r"\b", "") for p in PHRASES)
COUNTED = tuple(p for p in EDGELESS if re.search(r"\{[0-9]*,[0-9]{2,}\}", p))


def _zeros(n: int) -> pa.Array:
    return pa.repeat(pa.scalar(0, pa.int64()), n)


def _bits(texts: pa.Array, tries) -> pa.Array:
    """One bit for each (number, what says whether texts pass) of tries."""
    bits = _zeros(len(texts))
    for i, found in tries:
        bits = pc.bit_wise_or(bits, pc.multiply(found(texts).cast(pa.int64()), 1 << i))
    return bits


def _where(some: pa.Array, texts: pa.Array, tries) -> pa.Array:
    """_bits of those texts where some is true, 0 elsewhere; without such a text no pattern is made."""
    kept = texts.filter(some)
    return pc.replace_with_mask(_zeros(len(texts)), some, _bits(kept, tries)) if len(kept) else _zeros(len(texts))


@F.arrow_udf(T.LongType())
def phrase_gates(flat: pa.Array, leet: pa.Array) -> pa.Array:
    """Which of PHRASES a text may hold, a bit each: found by RE2 without word edges, which thus are the one thing left to try.
    Both readings go through together, and one pass tells the texts that any of the phrases may stand in."""
    both = pa.concat_arrays([flat, leet])
    some = pc.fill_null(pc.not_equal(both, ""), False)
    texts = both.filter(some)
    if not len(texts):
        return _zeros(len(flat))
    one = lambda p: lambda t: pc.match_substring_regex(t, p)
    tries = [(i, one(p), p in COUNTED) for i, p in enumerate(EDGELESS)]
    maybe = pc.match_substring_regex(texts, "|".join(p for p in EDGELESS if p not in COUNTED))
    held = pc.bit_wise_or(_where(maybe, texts, [(i, f) for i, f, counted in tries if not counted]), _bits(texts, [(i, f) for i, f, counted in tries if counted]))
    bits = pc.replace_with_mask(_zeros(len(both)), some, held)
    return pc.bit_wise_or(bits.slice(0, len(flat)), bits.slice(len(flat)))


def n_patterns(flat: Column, leet: Column, patterns: tuple[str, ...], bits: Column) -> Column:
    """How many of the patterns a text holds, as it is or with digits read as letters (null where there are none). bits: its
    phrase_gates; a pattern is tried where it passes."""
    one = lambda p: bits.bitwiseAND(F.lit(1 << PHRASES.index(p))) != 0
    return sum((F.when(one(p) & (flat.rlike(p) | F.coalesce(leet.rlike(p), F.lit(False))), 1).otherwise(0) for p in patterns), F.lit(0))


def holds_any(text: Column, stems) -> Column:
    """Whether a text holds any of some plain strings: a search for bytes, much cheaper than a pattern that lists them."""
    out = F.lit(False)
    for x in stems:
        out = out | F.contains(text, F.lit(x))
    return out


def marked(text: Column) -> Column:
    """Whether a text bears a marker; null for null."""
    return F.when(text.isNotNull(), F.when(holds_any(F.lower(text), MARKER_STEMS), text.rlike(MARKERS)).otherwise(False))


#: What a match of these formats holds for sure, where their pattern doesn't begin with it.
SURE = {
    "assignment": (), "private_key": ("PRIVATE KEY",), "stripe_key": ("k_live_", "k_test_"), "jwt": ("eyJ",), "connection_string": ("://",), "basic_auth_url": ("://",), "sendgrid_key": ("SG.",), "mailchimp_key": ("-us",), "slack_webhook": ("hooks.slack.com",),
    "gitlab_token": ("glp", "gldt-", "glrt-", "glsoat-", "glft-"), "terraform_token": (".atlasv1.",), "discord_webhook": ("/api/webhooks/",), "telegram_token": (":AA",), "aws_secret": ("ws", "WS"), "azure_sas": ("sig=", "SIG="), "bearer_header": ("earer", "EARER"),
    "digitalocean_token": ("_v1_",), "vault_token": ("hvs.", "hvb.", "hvr."), "shopify_token": ("shp",), "square_token": ("EAAA", "sq0"), "notion_token": ("secret_", "ntn_"), "sentry_token": ("sntry",), "github_token": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), "cloudflare_origin": ("v1.0-",),
}


def sure(name: str, pattern: str) -> tuple[str, ...]:
    """Plain strings of which a format's matches hold one: those above, or what the pattern begins with."""
    head = re.match(r"(?:\\b)?((?:[A-Za-z0-9_=\"-]|\\\.(?![*+?{]))+)", pattern)
    return SURE.get(name) or ((head[1][:6].replace("\\", ""),) if name not in SURE and head and len(head[1]) > 2 else ())


#: Vendors' formats, each a bit of format_gates.
FORMATS = SECRETS[1:] + MORE_SECRETS


@F.arrow_udf(T.LongType())
def format_gates(texts: pa.Array) -> pa.Array:
    """Which of FORMATS a text may hold, a bit each: by the plain strings that their matches hold for sure, and where there are
    none, by RE2 without word edges. A null text holds none."""

    def one(name: str, pattern: str):
        heads = sure(name, pattern)
        found = [lambda t, x=x: pc.match_substring(t, x) for x in heads] or [lambda t: pc.match_substring_regex(t, pattern.replace(r"\b", ""))]
        return lambda t: reduce(pc.or_, (f(t) for f in found))

    return _where(pc.is_valid(texts), texts, [(i, one(*row)) for i, row in enumerate(FORMATS)])


#: By group of patterns, what a text with a match of one of them holds for sure. A gate may be wider than its patterns, never
#: narrower; it has no look-around and no blanks by class, so RE2 finds it in one pass. Case counts unless (?i) says otherwise.
GATES = {
    "phrase": "(?i)" + "|".join(re.escape(x) for x in PHRASE_STEMS) + "|[a-z\u0130][013457@$][a-z\u0130]",
    "assigned": "(?i)(?:password|passwd|secret|token|api_?key)[\"']?[ ]*[:=]",
    "format": "(?i:aws_?(?:secret)?_?(?:access)?_?key|[?&]sig=|authorization)|SK[0-9a-f]{32}|" + "|".join(re.escape(x) for n, p in SECRETS[1:] + MORE_SECRETS if n not in ("aws_secret", "azure_sas", "bearer_header") for x in sure(n, p)),
    "card": "[0-9](?:[ -]?[0-9]){12}", "ssn": "[0-9]{3}-[0-9]{2}-[0-9]{4}", "phone": r"[2-9][0-9]{2}\)?[ .-][0-9]{3}[ .-][0-9]{4}", "mail": "@", "npi": "[12][0-9]{9}", "dea": "[A-Za-z][A-Za-z9][0-9]{7}",
    "patient": "(?i)patient|diagnosis|medical record|mrn|prescri|health plan", "code": r"def |class |import |from [A-Za-z0-9_]+ import|public (?:class|static)|function [A-Za-z0-9_]+\(|#include|SELECT ", "schema": r"(?i)(?:into|update|from|table|join) [a-z_]+\.[a-z_]",
    "internal": r"(?i)\.(?:internal|corp|local|intra|lan)|from (?:internal|private|corp)\.", "random": "[A-Za-z0-9_]{24}", "keyed": r"SIN|social insurance|BSN|burgerservicenummer|CPF|NRIC|FIN|DNI|NIE|(?i:passport|licen[cs]e|ssn|social security|date of birth|\bdob\b)",
    "iban": "[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){3}", "nino": "[A-Z]{2} ?[0-9]{2} ?[0-9]{2} ?[0-9]{2} ?[A-D]", "blob": "[A-Za-z0-9+/]{60}", "invisible": INVISIBLE,
    "marker": "(?i)confidential|internal|not distribute|for distribution|attorney|proprietary|restricted|secret|tlp[: -]?(?:red|amber|green|clear|white)|(?:mip|purview) label",
    "danger": r"(?i)\brm[\t-\r ]+-|curl|wget|mkfs\.|\bdd[\t-\r ]+if=|:\(\)", "path": r"(?i)\.ssh|\.aws|\.kube|\.netrc|etc/shadow", "autonomy": "(?i)--(?:dangerously|yolo|auto-approve|no-confirm)",
}


@F.arrow_udf(T.LongType())
def gates(texts: pa.Array) -> pa.Array:
    """The GATES that texts pass, a bit each by their order. A null text passes none."""
    bits = pa.array([0] * len(texts), pa.int64())
    for i, pattern in enumerate(GATES.values()):
        found = pc.fill_null(pc.match_substring_regex(texts, pattern), False)
        bits = pc.bit_wise_or(bits, pc.multiply(found.cast(pa.int64()), 1 << i))
    return bits


#: As gates, for bits that stand below a text made anew, on which gates are asked again: the optimizer puts a function of Python into
#: all that names it, and that into the next one's text, over and over; one said to be non-deterministic stays a column.
held_gates = F.arrow_udf(gates.func, T.LongType()).asNondeterministic()


def passes(bits: Column, gate: str) -> Column:
    return bits.bitwiseAND(F.lit(1 << list(GATES).index(gate))) != 0


def flattened(df: DataFrame, text: Column, bits: Column | None = None) -> DataFrame:
    """Adds __flat (lower case, single blanks, without quoted mentions), __leet (the same with digits read as letters,
    where that changes a word) and __phrases (phrase_gates of both) of texts that may hold a phrase; '' and null of all others, which thus cost one scan.
    bits: the text's gates."""
    low = F.lower(text)
    maybe = passes(bits, "phrase") if bits is not None else holds_any(low, PHRASE_STEMS) | low.rlike("[a-z][013457@$][a-z]")
    staged = df.withColumn("__flat", F.when(maybe, F.regexp_replace(low, r"\s+", " ")).otherwise(""))
    staged = staged.withColumn("__flat", F.when(F.col("__flat").rlike("[\"'`“‘«]"), F.regexp_replace("__flat", MENTION, " ")).otherwise(F.col("__flat")))
    staged = staged.withColumn("__leet", F.when(F.col("__flat").rlike("[a-z][013457@$][a-z]"), C.leet_fold(F.col("__flat"))))
    return staged.withColumn("__phrases", phrase_gates("__flat", "__leet"))


def secret_labels(text: Column, table=SECRETS) -> Column:
    """array<string> of the formats found, one label a pattern, in the table's order."""
    return F.filter(F.array(*(F.when(text.rlike(p), name) for name, p in table)), lambda x: x.isNotNull())


def real_secret_labels(text: Column, table=SECRETS + MORE_SECRETS, bits: Column | None = None, held: Column | None = None) -> Column:
    """As secret_labels, without formats whose every match only stands for a secret. bits: the text's gates; held: its
    format_gates, by which a format is tried only where it may stand."""
    none = F.expr("cast(array() as array<string>)")
    if bits is not None:
        assigned, formats = ([row for row in table if (row[0] == "assignment") == first] for first in (True, False))
        of = lambda rows, gate: F.when(passes(bits, gate), real_secret_labels(text, rows, held=held if gate == "format" else None)).otherwise(none) if rows else none
        return F.concat(of(assigned, "assigned"), of(formats, "format"))
    places = {name: i for i, (name, _) in enumerate(FORMATS)}
    if held is not None:
        maybe = lambda name, p: (held.bitwiseAND(F.lit(1 << places[name])) != 0) & text.rlike(p)
    else:
        maybe = lambda name, p: holds_any(text, sure(name, p)) & text.rlike(p) if sure(name, p) else text.rlike(p)
    held_by = F.array(*(F.when(maybe(name, p), F.struct(F.lit(name).alias("name"), found_all(text, p).alias("hits"))) for name, p in table))
    real = F.filter(held_by, lambda f: F.exists(f["hits"], lambda m: ~m.rlike(PLACEHOLDER)))
    return F.transform(real, lambda f: f["name"])


def found_all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def random_keys(text: Column, words: bytes | None = None) -> Column:
    """Long random tokens of no known format: no plain hex, no base64 of a text (which is read decoded instead), no media,
    no made-up filler, no runs of words, no ids of eight-four-four form. words: a sketch of the corpus's words (functions.words),
    by which identifiers, run-together words, names and encoded prose go too."""
    from quillguard.functions.words import speaks

    decoded = lambda t: F.try_to_binary(F.concat(t, F.repeat(F.lit("="), F.pmod(-F.length(t), F.lit(4)))), F.lit("base64")).cast("string")
    known = lambda t: t.rlike("^[0-9a-fA-F]+$") | wordlike(t)
    odd = lambda t: ~synthetic(t) & ~F.coalesce(decoded(t).rlike(r"^[\x20-\x7E\s]+$"), F.lit(False))
    found = F.filter(entropy_tokens(without_media(text), unless=known), odd)
    return F.filter(found, lambda t: ~speaks(t, words)) if words else found


def near(text: Column, word: str, pattern: str, within: int) -> Column:
    """A pattern within so many characters of a word, on either side."""
    return text.rlike(f"(?is)(?:{word}).{{0,{within}}}?(?:{pattern})|(?:{pattern}).{{0,{within}}}?(?:{word})")


def keyed_numbers(text: Column, within: int = 120) -> Column:
    """array<string> of the KEYED checks that a valid number near its word fulfils."""
    one = lambda word, pattern, ok: F.exists(found_all(text, rf"(?s)(?:{word}).{{0,{within}}}?(?:{pattern})|(?:{pattern}).{{0,{within}}}?(?:{word})"), lambda m: F.exists(found_all(m, pattern), ok))
    some = F.when(holds_any(F.lower(text), KEYED_STEMS), F.array(*(F.when(text.rlike(word), F.when(one(word, pattern, ok), check)) for check, word, pattern, ok in KEYED)))
    return F.coalesce(F.filter(some, lambda c: c.isNotNull()), F.expr("cast(array() as array<string>)"))


def detect(df: DataFrame, text: str, more: str | None = None, own: str | None = None, words: bytes | None = None, business: list[str] | None = None) -> DataFrame:
    """Adds signals: instruction override, jailbreak, exfiltration, secrets, personal and health data, markers, code, commands.

    Null text has none. All expressions are built in, so a scan, its detectors and the scoring are one stage. The text is
    read as it stands; pipelines.detect_decoded also reads what is folded, encoded or split. more: the column of what a text
    holds besides own (the text as it stands), null where there is nothing; numbers, addresses and lines of own count as often as
    they stand there, and those of its other views once each. words: see random_keys. business: the common words
    of code (scans.domain_identifiers); where they are given, two lines of code whose identifiers speak of a business are
    source code too.
    """
    t, bits = F.coalesce(F.col(text), F.lit("")), F.col("__gates")
    looked_for, found = _detected(text, more, own, words, None if business is None else tuple(business))
    staged = flattened(df.withColumn("__gates", gates(t)), t, bits).withColumn("__formats", format_gates(F.when(passes(bits, "format"), t)))
    for columns in looked_for:
        staged = staged.withColumns(columns)
    return staged.withColumn("signals", found).drop(*(c for c in staged.columns if c not in df.columns))


@made_once
def _detected(text: str, more: str | None, own: str | None, words: bytes | None, business: tuple[str, ...] | None) -> tuple[list[dict[str, Column]], Column]:
    """The columns of detect, step by step, and its signals."""
    from quillguard.operators.scans import domain_identifiers

    t, bits = F.coalesce(F.col(text), F.lit("")), F.col("__gates")
    if_ = lambda gate, value, other=0: F.when(passes(bits, gate), value).otherwise(F.lit(other))
    has = lambda gate, pattern: if_(gate, t.rlike(pattern), False)
    none = F.expr("cast(array() as array<string>)")
    new = lambda pattern: F.concat(found_all(F.col(own), pattern), F.array_except(found_all(t, pattern), found_all(F.col(own), pattern)))
    matches = lambda c, pattern: found_all(c, pattern) if own is None else F.when(F.col(more).isNotNull(), new(pattern)).otherwise(found_all(c, pattern))
    flat, leet, held = F.col("__flat"), F.col("__leet"), F.col("__phrases")
    looked_for = [{
        "__o": n_patterns(flat, leet, OVERRIDE, held), "__j": n_patterns(flat, leet, JAILBREAK, held), "__x": n_patterns(flat, leet, EXFILTRATION, held), "__s": real_secret_labels(t, bits=bits, held=F.col("__formats")),
        "__cards": if_("card", F.size(F.filter(matches(t, "[0-9](?:[ -]?[0-9]){12,18}"), C.card_ok))),
        "__ssn": if_("ssn", F.exists(matches(t, r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"), lambda m: C.ssn_ok(C.digits(m))), False),
        "__phones": if_("phone", F.size(F.filter(matches(t, r"(?<![0-9])(?:\+1[ .-]?)?\(?[2-9][0-9]{2}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])"), lambda m: ~F.substring(C.digits(m), -7, 3).eqNullSafe("555")))),
        "__mails": if_("mail", F.size(F.filter(matches(t, EMAIL), lambda m: F.lower(F.substring_index(m, "@", -1)).isin(*PERSONAL) & ~m.rlike(ROLE_PARTS) & ~m.rlike(RESERVED)))),
        "__health": if_("npi", F.size(F.filter(matches(t, r"(?<![0-9])[12][0-9]{9}(?![0-9])"), C.npi_ok))) + if_("dea", F.size(F.filter(matches(t, r"\b[A-Za-z][A-Za-z9][0-9]{7}\b"), C.dea_ok))),
        "__patient": F.when(has("patient", HEALTH_WORDS), F.when(t.rlike(MBI), 1).otherwise(0) + F.when(t.rlike(RECORD_NUMBER), 1).otherwise(0) + F.when(t.rlike(DIAGNOSIS), 1).otherwise(0)).otherwise(0),
        "__code": if_("code", F.size(matches(t, CODE))), "__schema": F.when(has("schema", SCHEMA), 2).otherwise(0) + F.when(has("internal", INTERNAL), 2).otherwise(0),
        "__keys": F.when(passes(bits, "random"), random_keys(t, words)).otherwise(none), "__keyed": F.when(passes(bits, "keyed"), keyed_numbers(t)).otherwise(none),
    }]
    if business is not None:
        looked_for.append({"__schema": F.col("__schema") + F.when((F.col("__code") >= 2) & (F.size(domain_identifiers(t, list(business))) >= 2), 2).otherwise(0)})
    up = lambda base, n: F.least(F.lit(1.0), F.lit(base) + 0.15 * F.col(n))
    asked = (F.col("__o") > 0) | (F.col("__j") > 0) | (F.col("__x") > 0)
    blob = asked & has("blob", r"[A-Za-z0-9+/]{60,}={0,2}") & ~t.rlike(MEDIA) & ~t.rlike(r"[0-9a-fA-F]{60,}")
    found = S.signals(
        (F.col("__o") > 0, S.signal("prompt_injection", 0.8, up(0.62, "__o"), "instruction_override", detector="prompt_threats")),
        (F.col("__j") > 0, S.signal("jailbreak", 0.75, up(0.5, "__j"), "jailbreak", detector="prompt_threats")),
        (F.col("__x") > 0, S.signal("data_exfiltration", 0.8, up(0.6, "__x"), "data_exfiltration", detector="prompt_threats")),
        (blob, S.signal("prompt_injection", 0.45, 0.5, "encoded_payload", detector="prompt_threats")),
        (has("invisible", INVISIBLE), S.signal("prompt_injection", 0.6, 0.7, "invisible_characters", detector="prompt_threats")),
        (F.size("__s") > 0, S.signal("secret_leak", 0.9, 0.85, "secret", detector="shadow_ai", evidence=F.array_join(F.slice("__s", 1, 4), ", "))),
        ((F.size("__s") == 0) & (F.size("__keys") > 0), S.signal("secret_leak", 0.7, 0.7, "high_entropy", detector="shadow_ai", evidence=F.array_join(F.transform(F.slice("__keys", 1, 4), lambda k: F.concat(F.substring(k, 1, 10), F.lit("…"))), ", "))),
        (has("iban", IBAN), S.signal("pii_leak", 0.6, 0.75, "iban", detector="shadow_ai")),
        (has("nino", NINO), S.signal("pii_leak", 0.6, 0.75, "nino", detector="shadow_ai")),
        ((F.col("__cards") > 0) | F.col("__ssn"), S.signal("pii_leak", 0.8, 0.75, "identity_number", detector="shadow_ai")),
        (F.size("__keyed") > 0, S.signal("pii_leak", 0.55, 0.75, "keyed_number", detector="shadow_ai", evidence=F.array_join("__keyed", ", "))),
        (F.col("__phones") >= 3, S.signal("pii_leak", 0.5, 0.75, "phones", detector="shadow_ai")),
        (F.col("__mails") >= 3, S.signal("pii_leak", 0.55, 0.6, "bulk_email", detector="shadow_ai")),
        (((F.col("__health") > 0) & has("patient", HEALTH_WORDS)) | (F.col("__patient") >= 2), S.signal("phi_leak", 0.8, 0.75, "health_identifier", detector="shadow_ai")),
        (has("marker", MARKERS), S.signal("confidential_data", 0.6, 0.65, "marker", detector="shadow_ai")),
        ((F.col("__code") >= 3) | (F.col("__schema") >= 2), S.signal("source_code_leak", 0.55, F.least(F.lit(1.0), F.lit(0.55) + 0.1 * (F.col("__code") + F.col("__schema"))), "source_code", detector="shadow_ai")),
        (has("danger", DANGEROUS), S.signal("dangerous_action", 0.95, 0.9, "dangerous_command", detector="mcp_guard")),
        (has("path", SENSITIVE_PATH), S.signal("sensitive_access", 0.9, 0.9, "sensitive_path", detector="mcp_guard")),
        (has("autonomy", AUTONOMY), S.signal("agent_autonomy", 0.7, 0.8, "autonomy_flag", detector="agent_safety")),
    )
    return looked_for, found


def custom_patterns(df: DataFrame, text: str, patterns: list[str]) -> DataFrame:
    """Adds signals of an organisation's own patterns (Java's syntax, by which they are also tried); one that doesn't compile
    leaves a marker of no weight and the others still run."""
    from py4j.protocol import Py4JJavaError
    from pyspark.errors import IllegalArgumentException

    java = df.sparkSession.sparkContext._jvm.java.util.regex.Pattern
    found = []
    for p in patterns:
        try:
            java.compile(p)
            found.append((F.coalesce(F.col(text).rlike(p), F.lit(False)), S.signal("pii_leak", 0.7, 0.75, "custom_pattern", detector="shadow_ai", evidence=F.lit(p))))
        except (Py4JJavaError, IllegalArgumentException):
            found.append((F.lit(True), S.signal("detector_error", 0.0, 0.0, "detector_error", detector="shadow_ai", evidence=F.lit(p))))
    return df.withColumn("signals", S.signals(*found))


def tool_output_signals(df: DataFrame, text: str) -> DataFrame:
    """Adds signals of orders inside a tool's output: one phrase is a hint, two or more are an injection."""
    staged = flattened(df, F.coalesce(F.col(text), F.lit(""))).withColumn("__o", n_patterns(F.col("__flat"), F.col("__leet"), OVERRIDE + EXFILTRATION, F.col("__phrases")))
    sure = F.least(F.lit(1.0), 0.55 + 0.15 * F.col("__o"))
    found = S.signals((F.col("__o") > 0, S.signal("prompt_injection", F.when(F.col("__o") == 1, 0.55).otherwise(0.8), sure, "tool_output_instruction", detector="prompt_threats")))
    return staged.withColumn("signals", found).drop("__flat", "__leet", "__phrases", "__o")
