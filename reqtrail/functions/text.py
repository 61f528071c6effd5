"""Text rules as column expressions: all of them stay in the JVM."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a token is, and how models fence JSON.
TOKEN = "[A-Za-z_][A-Za-z0-9_]+"
FENCE = "```(?:json)?\\s*([\\s\\S]*?)\\s*```"
STRICT_FENCE = "```json\\s*([\\s\\S]*?)\\s*```"
#: What Python's str.strip() takes off, as a character class; Spark's trim() takes blanks alone.
STRIPPED = "\\t\\n\\x0B\\f\\r\\x1c-\\x20\\x85\\xA0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{STRIPPED}]+|[{STRIPPED}]+$", "")


def tokenize(c: Column) -> Column:
    """Identifier-like tokens of two characters or more, in upper case, with repetitions."""
    return F.transform(F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0)), F.upper)


def token_set(c: Column) -> Column:
    return F.array_distinct(F.coalesce(tokenize(c), F.array().cast("array<string>")))


def overlap(requirement_tokens: Column, function_tokens: Column) -> Column:
    """Share of the requirement's distinct tokens that the function has; 0 without tokens."""
    shared = F.size(F.array_intersect(requirement_tokens, function_tokens))
    return F.coalesce(F.try_divide(shared.cast("double"), F.size(F.array_distinct(requirement_tokens)).cast("double")), F.lit(0.0))


def clean_keyword(c: Column) -> Column:
    """Stripped, then without brackets and double quotes; blanks inside the quotes stay."""
    return F.regexp_replace(strip(c), '[\\[\\]"]', "")


def split_cell(c: Column) -> Column:
    """Keywords of a cell that holds a list as text: split at commas, cleaned, empty ones dropped; null gives []."""
    parts = F.filter(F.transform(F.split(c, ","), clean_keyword), lambda x: x != "")
    return F.coalesce(parts, F.array().cast("array<string>"))


def typed_cell(c: Column) -> Column:
    """Keywords of a cell that holds a JSON list, without loss; text that is no list gives []."""
    return F.filter(F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))


def list_to_cell(c: Column) -> Column:
    return F.array_join(c, ",")


def cell_to_list(c: Column) -> Column:
    """Comma-joined text to a list; empty or null gives []."""
    return F.when((c == "") | c.isNull(), F.array().cast("array<string>")).otherwise(F.split(c, ","))


def list_to_json(c: Column) -> Column:
    return F.to_json(c)


def fenced_json(c: Column) -> Column:
    """What the first ```json block holds, stripped; text without a block as it is."""
    return F.when(c.rlike(STRICT_FENCE), strip(F.regexp_extract(c, STRICT_FENCE, 1))).otherwise(c)


def recovered_json(c: Column, schema: str) -> Column:
    """A struct from a model's answer: the fenced or whole text if it parses, else what lies from the first { to the last }.

    Null where neither is JSON. Text that is a JSON list or number is no object and gives null too.
    """
    bound = lambda x, f: F.transform(F.array(x), f)[0]  # noqa: E731  each step is used more than once, and made once
    fenced = lambda t: bound(F.regexp_extract(t, FENCE, 0), lambda m: F.when(m != "", strip(F.regexp_extract(m, FENCE, 1))).otherwise(t))
    is_object = lambda x: x.startswith("{") & F.from_json(x, "map<string,string>").isNotNull()
    part = lambda t: F.when(is_object(t), t).otherwise(bound(F.regexp_extract(t, "(\\{[\\s\\S]*\\})", 1), lambda b: F.when(is_object(b), b)))
    return F.from_json(bound(bound(strip(c), fenced), part), schema)


def json_list(c: Column, key: str) -> Column:
    """The list under a key of JSON text; [] where it is missing."""
    return F.coalesce(F.from_json(c, f"struct<`{key}`:array<string>>")[key], F.array().cast("array<string>"))


# Phrases that are taken out of a search query, in this order.
QUERY_PHRASES = ("how to ", "how do i ", "how can i ", "?")


def normalize_query(c: Column) -> Column:
    out = F.lower(c)
    for phrase in QUERY_PHRASES:
        out = F.replace(out, F.lit(phrase), F.lit(""))
    return strip(out)


def context(previous: Column, current: Column, following: Column) -> Column:
    """The prompt's context; empty neighbours are left out."""
    before = F.when(F.coalesce(previous, F.lit("")) != "", F.concat(F.lit("Previous paragraph:\n"), previous, F.lit("\n\n"))).otherwise("")
    after = F.when(F.coalesce(following, F.lit("")) != "", F.concat(F.lit("\nNext paragraph:\n"), following)).otherwise("")
    return F.concat(before, F.lit("Current paragraph:\n"), F.coalesce(current, F.lit("")), F.lit("\n"), after)


def _found(conditions: Sequence[tuple[str, Column]]) -> Column:
    """The names whose condition holds, in order."""
    if not conditions:
        return F.array().cast("array<string>")
    return F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in conditions]))


def keywords_ci(c: Column, keywords: Sequence[str]) -> Column:
    """Keywords that occur in any case anywhere; empty keywords never."""
    low = F.lower(c)
    return _found([(k, F.contains(low, F.lit(k.lower()))) for k in keywords if k])


def _quoted(keyword: str) -> str:
    return "".join(ch if ch.isalnum() or ch == "_" else f"\\x{{{ord(ch):x}}}" for ch in keyword)


def keywords_word(c: Column, keywords: Sequence[str]) -> Column:
    """Keywords between word boundaries, case-sensitive. A contains() test spares most rows the pattern."""
    return _found([(k, F.contains(c, F.lit(k)) & c.rlike(f"(?U)\\b{_quoted(k)}\\b")) for k in keywords])


def keywords_plain(c: Column, keywords: Sequence[str]) -> Column:
    return _found([(k, F.contains(c, F.lit(k))) for k in keywords])


def status_codes(c: Column, codes: Mapping[str, str]) -> Column:
    """Codes that occur, or whose description does, anywhere. The code 100 comes first and must stand alone, or 'Continue' must."""
    alone = lambda word: c.rlike(f"(?:^|(?U:\\s)|\\(){word}(?:(?U:\\s)|\\)|$)")
    first = [("100", alone("100") | alone("Continue"))] if "100" in codes else []
    return _found(first + [(k, F.contains(c, F.lit(k)) | F.contains(c, F.lit(d))) for k, d in codes.items() if k != "100"])


def keyword_columns(c: Column, keywords: Mapping) -> dict[str, Column]:
    """The five keyword columns of a requirement, comma-joined; a null requirement matches nothing."""
    rules = {
        "status_code": status_codes(c, keywords.get("status_code", {})),
        "field_name": keywords_word(c, keywords.get("field_name", [])),
        "content_coding": keywords_plain(c, keywords.get("content_coding", [])),
        "method": keywords_word(c, keywords.get("method", [])),
        "syntax": keywords_word(c, keywords.get("syntax", [])),
    }
    return {k: F.coalesce(F.array_join(v, ","), F.lit("")) for k, v in rules.items()}


def ordered_keywords(keywords: Sequence[str]) -> list[str]:
    """Distinct keywords by length, then text."""
    return sorted(set(keywords), key=lambda k: (len(k), k))


def elapsed(seconds: Column) -> Column:
    """Minutes and seconds as m:s, both cut to whole numbers and not padded."""
    minutes = F.floor(seconds / 60)
    return F.format_string("%d:%d", minutes.cast("long"), F.floor(seconds - minutes * 60).cast("long"))


def remaining(seconds: Column, share: Column) -> Column:
    """Elapsed and remaining time when a share of the work is done."""
    return F.concat(elapsed(seconds), F.lit("<"), elapsed(F.try_divide(seconds, share) - seconds))


def call_options(model: str | None, max_tokens: int, temperature: float = 0) -> dict:
    """Options of a model call: families whose name begins with o take another limit's name and no temperature."""
    if re.match("o", (model or "").strip(), re.IGNORECASE):
        return {"max_completion_tokens": int(max_tokens)}
    return {"max_tokens": int(max_tokens), "temperature": temperature}


def endpoint(model: str, endpoints: Mapping[str, str]) -> str:
    """The endpoint of a model's short name."""
    if model not in endpoints:
        raise ValueError(f"unknown model {model!r}; known: {sorted(endpoints)}")
    return endpoints[model]
