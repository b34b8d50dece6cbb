"""SQL twins of verdict queries that are declared elsewhere: the checks worked out over the texts as they stand, and their scores.

They know no decoded or reshaped views and no random keys, of which the tables hold none; tests hold these.
"""

from __future__ import annotations

from quillguard.plans import detection, upkeep  # noqa: F401  they declare the queries
from quillguard.plans.base import ORACLES
from quillguard.plans.planted import verdicts_sql

ORACLES["detector_verdicts"] = verdicts_sql("SELECT doc_id, coalesce(text, '') AS t FROM documents") + " SELECT doc_id, risk_score, severity, recommended_action, attack_intent, n_signals, first AS \"check\" FROM v"
ORACLES["conversation_verdicts"] = verdicts_sql("SELECT conv_id, role, coalesce(text, '') AS t FROM conversations") + " SELECT conv_id, role, max(risk_score) AS risk, count(*) FILTER (risk_score >= 35) AS alerts FROM v GROUP BY ALL"

BARE = r"regexp_replace(html, '(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->', ' ', 'g')"
TAGS = rf"regexp_replace(regexp_replace({BARE}, '(?i)</?(?:p|br|div|li|h[1-6]|tr|article|section)\b[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g')"
for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
    TAGS = f"replace({TAGS}, '{entity}', '{char}')"
TEXT = rf"regexp_replace(regexp_replace(regexp_replace({TAGS}, '[ \t]+', ' ', 'g'), '\s*\n\s*', chr(10), 'g'), '^\s+|\s+$', '', 'g')"
ORACLES["page_verdicts"] = verdicts_sql(f"SELECT page_id, {TEXT} AS t FROM pages") + " SELECT page_id, CAST(length(t) AS INTEGER) AS n_chars, risk_score, severity FROM v"
ORACLES["normalised_documents"] = r"SELECT doc_id, CAST(length(n) AS INTEGER) AS n, n <> text AS changed FROM (SELECT doc_id, text, trim(regexp_replace(strip_accents(text), '\s+', ' ', 'g')) AS n FROM documents)"
