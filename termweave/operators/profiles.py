"""Concept profiles: filtered scans, and profiles composed from names, synonyms and codes."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalized_or_empty, profile_text, synonym_list

#: Fixed values. Classes that composed profiles leave out.
VARIANT_CLASSES = ("Gene DNA Variant", "Gene Protein Variant", "Gene RNA Variant", "Variant")
CONCEPT_COLUMNS = ("concept_id", "concept_name", "concept_code", "domain_id", "concept_class_id", "vocabulary_id")


def values(given: Iterable[str | None] | str | None) -> list[str]:
    """Values of flags that may be repeated or hold commas: trimmed, without empty ones."""
    if given is None:
        return []
    given = [given] if isinstance(given, str) else given
    return [part.strip() for value in given if value is not None for part in str(value).split(",") if part.strip()]


def is_valid(domains: Sequence[str] = (), classes: Sequence[str] = (), without_classes: Sequence[str] = ()) -> Column:
    """Standard, valid concepts of the domains and classes asked for. Without-lists drop rows whose class is null."""
    test = (F.col("standard_concept") == "S") & F.col("invalid_reason").isNull()
    if domains:
        test &= F.col("domain_id").isin(*domains)
    if classes:
        test &= F.col("concept_class_id").isin(*classes)
    if without_classes:
        test &= ~F.col("concept_class_id").isin(*without_classes)
    return test


def scan_profiles(profiles: DataFrame, concepts: DataFrame, domains: Sequence[str] = (), classes: Sequence[str] = (), without_classes: Sequence[str] = (), extra: Sequence[str] = ()) -> DataFrame:
    """(concept_id, profile_text, extra): profiles of the valid concepts."""
    need = ["concept_id", "profile_text", *extra]
    if missing := [c for c in need if c not in profiles.columns]:
        raise ValueError(f"profiles have no column {', '.join(missing)}")
    rows = profiles.select(F.col("concept_id").cast("long").alias("concept_id"), F.col("profile_text").cast("string").alias("profile_text"), *extra)
    keys = concepts.filter(is_valid(domains, classes, without_classes)).select(F.col("concept_id").cast("long").alias("concept_id"))
    return rows.join(keys, "concept_id")


def synonyms_of(table: DataFrame) -> DataFrame:
    """(concept_id, synonyms): each distinct name, sorted."""
    named = table.filter(F.col("concept_synonym_name").isNotNull())
    return named.groupBy("concept_id").agg(F.array_sort(F.collect_set("concept_synonym_name")).alias("synonyms"))


def compose_profiles(concepts: DataFrame, synonyms: DataFrame | None = None, domains: Sequence[str] = (), classes: Sequence[str] = (), without_classes: Sequence[str] = (), max_synonyms: int = 3, with_code: bool = False) -> DataFrame:
    """Concepts with a profile_text of name, synonyms and code; empty profiles are dropped."""
    base = concepts.filter(is_valid(domains, classes, [*VARIANT_CLASSES, *without_classes])).select(*CONCEPT_COLUMNS)
    base = base.withColumn("concept_id", F.col("concept_id").cast("long"))
    if synonyms is None:
        base = base.withColumn("synonyms", F.array().cast("array<string>"))
    else:
        base = base.join(synonyms_of(synonyms).withColumn("concept_id", F.col("concept_id").cast("long")), "concept_id", "left")
    base = base.withColumns({c: normalized_or_empty(F.col(c)) for c in ("concept_name", "concept_code")})
    text = profile_text(F.col("concept_name"), synonym_list(F.col("synonyms"), F.col("concept_name")), F.col("concept_code"), max_synonyms, with_code)
    return base.withColumn("profile_text", text).drop("synonyms").filter(F.length("profile_text") > 0)
