"""Prompts inside warehouse SQL, and text inside web pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CALL = r"(?is)\b(?:AI_[A-Z_]+|COMPLETE|SUMMARIZE|CLASSIFY_TEXT)\s*\(((?:[^()']|'(?:[^']|'')*'|\([^()]*\))*)\)"
LITERAL = r"'((?:[^']|'')*)'"


def sql_prompts(sql: Column) -> Column:
    """array<struct<args, prompt, column_bound>> of the AI calls in a statement: the longest literal, quotes undoubled.

    column_bound: an argument is neither a literal nor a number, so the text came from a column.
    """
    calls = F.regexp_extract_all(sql, F.lit(CALL), F.lit(1))

    def one(args: Column) -> Column:
        literals = F.transform(F.regexp_extract_all(args, F.lit(LITERAL), F.lit(1)), lambda s: F.replace(s, F.lit("''"), F.lit("'")))
        longest = F.array_max(F.transform(literals, lambda s: F.struct(F.length(s).alias("n"), s.alias("s"))))["s"]
        rest = F.regexp_replace(args, r"(?s)'(?:[^']|'')*'", "")
        return F.struct(args.alias("args"), longest.alias("prompt"), rest.rlike(r"[A-Za-z_]").alias("column_bound"))

    return F.transform(calls, one)


def page_text(html: Column) -> Column:
    """Visible text of a page: without scripts, styles, comments and tags; common entities resolved."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", " ")
    text = F.regexp_replace(F.regexp_replace(bare, r"(?i)</?(?:p|br|div|li|h[1-6]|tr|article|section)\b[^>]*>", "\n"), r"<[^>]*>", "")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r"\s*\n\s*", "\n"), r"^\s+|\s+$", "")
