"""Text normalisation and query preparation, as column expressions."""

from __future__ import annotations

import re
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexicon import USAN_OF_INN, USAN_OF_INN_OPTIONAL

#: White space in the Unicode sense, with the four separators that Java leaves out.
SPACE = r"(?U)[\s\x1c-\x1f]+"
BRACKETED = r"\[[^\[\]]+\]"


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, SPACE, " "))


def normalized(text: Column) -> Column:
    """Lower case, runs of white space as one space, trimmed. Null stays null."""
    return squeezed(F.lower(text.cast("string")))


def normalized_or_empty(text: Column) -> Column:
    return F.coalesce(normalized(text), F.lit(""))


def query_text(name: Column, code: Column | None = None) -> Column:
    """`name`, or `name (code)` where there is a code; a blank name gives an empty query."""
    n = F.trim(F.coalesce(name.cast("string"), F.lit("")))
    if code is None:
        return n
    c = F.trim(F.coalesce(code.cast("string"), F.lit("")))
    return F.when((n == "") | (c == ""), n).otherwise(F.concat(n, F.lit(" ("), c, F.lit(")")))


def sanitized(text: Column, ascii_only: bool = False, drop_chars: str = "") -> Column:
    t = F.coalesce(text, F.lit(""))
    if drop_chars:
        t = F.translate(t, drop_chars, "")
    if ascii_only:
        t = F.regexp_replace(t, r"[^\x00-\x7F]+", " ")
    return squeezed(t)


def spaced_strengths(text: Column) -> Column:
    """A space between a number and its unit: 500mg -> 500 mg."""
    return F.regexp_replace(text, r"(?i)(?<=\d)(?=(?:mg|mcg|g|ml|l|iu|meq|unit|units|unt)\b)", " ")


def usan_names(text: Column, names: Mapping[str, str] | None = None) -> Column:
    """Whole words that are International or British drug names, replaced by those used in the United States.

    Names whose replacement holds no other name are replaced one after the other inside the JVM, and only in texts that
    hold any; a mapping that chains needs one pass over the text and goes through an Arrow function.
    """
    names = USAN_OF_INN if names is None else {k.lower(): v for k, v in names.items()}
    if not names:
        return text
    any_name = r"\b(?:" + "|".join(map(re.escape, names)) + r")\b"
    chains = any(re.search(any_name, v, re.IGNORECASE) for v in names.values())
    if chains:
        pattern = re.compile(any_name, re.IGNORECASE)

        @F.pandas_udf("string")
        def replaced(texts: pd.Series) -> pd.Series:
            return texts.map(lambda t: t if t is None else pattern.sub(lambda m: names.get(m[0].lower(), m[0]), t))

        return replaced(text)
    out = text
    for name, usan in names.items():
        out = F.regexp_replace(out, rf"(?iU)\b\Q{name}\E\b", usan.replace("\\", r"\\").replace("$", r"\$"))
    return F.when(text.rlike(f"(?iU){any_name}"), out).otherwise(text)


def prepared_query(text: Column, ascii_only: bool = False, drop_chars: str = "", usan: bool = True, optional_usan: bool = False) -> Column:
    """A query as it is searched: sanitised if asked, drug names converted, strengths spaced, normalised."""
    t = sanitized(text, ascii_only, drop_chars) if ascii_only or drop_chars else F.coalesce(text, F.lit(""))
    if usan:
        t = usan_names(t, USAN_OF_INN | USAN_OF_INN_OPTIONAL if optional_usan else None)
    return normalized(spaced_strengths(t))


def unbracketed(text: Column) -> Column:
    return F.regexp_replace(text, BRACKETED, " ")


def unpunctuated(text: Column) -> Column:
    """Lower case, brackets and separators as spaces."""
    t = F.regexp_replace(F.lower(F.trim(F.coalesce(text, F.lit("")))), r"[()\[\]{},;:/\\]+", " ")
    return F.regexp_replace(t, SPACE, " ")


def code_list(cell: Column) -> Column:
    """Codes in a cell, separated by commas, semicolons, bars or spaces, in capitals."""
    parts = F.split(F.coalesce(cell.cast("string"), F.lit("")), r"[,\s;|]+")
    return F.filter(F.transform(parts, lambda p: F.upper(F.trim(p))), lambda p: p != "")


def id_list(cell: Column) -> Column:
    """Ids in a cell; what is not all digits is dropped."""
    return F.transform(F.filter(code_list(cell), lambda p: p.rlike("^[0-9]+$")), lambda p: p.cast("long"))


def as_id(value: Column) -> Column:
    """An integer, or null for anything that is none; floating-point numbers lose their fraction."""
    return value.try_cast("long")


def profile_text(name: Column, synonyms: Column, code: Column, max_synonyms: int, with_code: bool) -> Column:
    """`name | synonym; synonym | code`, without what is empty. All parts are normalised beforehand."""
    some = F.slice(synonyms, 1, max(0, max_synonyms)) if max_synonyms > 0 else F.array().cast("array<string>")
    parts = [F.nullif(name, F.lit("")), F.nullif(F.array_join(some, "; "), F.lit(""))]
    if with_code:
        parts.append(F.nullif(code, F.lit("")))
    return F.concat_ws(" | ", *parts)


def synonym_list(raw: Column, name: Column) -> Column:
    """Normalised synonyms, each once, without empty ones and without the name itself."""
    clean = F.filter(F.transform(F.coalesce(raw, F.array().cast("array<string>")), normalized_or_empty), lambda s: s != "")
    return F.array_distinct(F.filter(clean, lambda s: s != name))


def candidate_text(name: Column, profile: Column) -> Column:
    """Name and profile as one text. A missing value is spelled out as `None`, as text conversion does upstream."""
    n, p = (F.trim(F.coalesce(c, F.lit("None"))) for c in (name, profile))
    return F.trim(F.concat(n, F.lit(" "), p))


def brands(text: Column) -> Column:
    """What stands in square brackets, except blanks."""
    return F.filter(F.regexp_extract_all(text, F.lit(r"\[([^\[\]]+)\]"), 1), lambda b: F.trim(b) != "")


def brand_patterns(text: Column) -> Column:
    """For each brand a pattern that finds it as whole words, with any spaces or hyphens between its parts."""
    parts = lambda b: F.filter(F.split(F.trim(b), r"[\s-]+"), lambda p: p != "")
    quoted = lambda b: F.array_join(F.transform(parts(b), lambda p: F.concat(F.lit(r"\Q"), p, F.lit(r"\E"))), r"(?:\s+|-)+")
    whole = lambda b: F.concat(F.lit("(?i)(?<![A-Za-z0-9])"), quoted(b), F.lit("(?![A-Za-z0-9])"))
    return F.transform(F.filter(brands(text), lambda b: F.size(parts(b)) > 0), whole)


def brand_score(query: Column, candidate_brands: Column, candidate_patterns: Column) -> Column:
    """1 if the query has a brand of the candidate, -1 if it has none of them, 0 if the candidate has no brand."""
    return F.when(F.size(candidate_brands) == 0, 0.0).when(F.exists(candidate_patterns, lambda p: F.rlike(query, p)), 1.0).otherwise(-1.0)
