"""Index build: profiles from relational tables, encoded, written with a manifest."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalized
from ..operators.profiles import compose_profiles, scan_profiles, values
from ..sources.encoders import encoded, encoder
from ..sources.files import table_or_none, write_index


def profiles_of(spark: SparkSession, folder: str, profiles_table: str = "concept_profiles", concepts_table: str = "concept", domains: Sequence[str] = (), classes: Sequence[str] = (), without_classes: Sequence[str] = (), extra: Sequence[str] = (), max_synonyms: int = 3, with_code: bool = False) -> DataFrame:
    """Profiles from their table; composed from the concepts where there is none, or none that fits."""
    concepts = table_or_none(spark, folder, concepts_table)
    if concepts is None:
        raise FileNotFoundError(f"no table {concepts_table} in {folder}")
    profiles = table_or_none(spark, folder, profiles_table)
    if profiles is not None:
        try:
            return scan_profiles(profiles, concepts, domains, classes, without_classes, extra)
        except ValueError:
            pass
    return compose_profiles(concepts, table_or_none(spark, folder, "concept_synonym"), domains, classes, without_classes, max_synonyms, with_code)


def build_index(spark: SparkSession, folder: str, out: str, table: str, encode: Callable | None = None, profiles_table: str = "concept_profiles", concepts_table: str = "concept", domains=(), classes=(), without_classes=(), extra=(), max_synonyms: int = 3, with_code: bool = False, model_id: str | None = None, pooling: str = "cls", max_length: int = 128, trust_remote_code: bool = False, batch_size: int = 256, device: str | None = "cpu") -> dict:
    domains, classes, without_classes, extra = (values(v) for v in (domains, classes, without_classes, extra))
    df = profiles_of(spark, folder, profiles_table, concepts_table, domains, classes, without_classes, extra, max_synonyms, with_code)
    df = df.withColumn("profile_text", normalized(F.col("profile_text")))
    if df.isEmpty():
        raise ValueError("no concept passes the filters; nothing to index")
    encode = encode or encoder(model_id, pooling, max_length, trust_remote_code, device)
    manifest = {
        "source": folder, "profiles_table": profiles_table, "concepts_table": concepts_table, "domain_id": domains, "concept_class_id": classes,
        "exclude_concept_class_id": without_classes, "extra_columns": extra, "max_synonyms": max_synonyms, "include_codes_in_text": with_code,
        "model_id": getattr(encode, "model_id", "custom"), "pooling": getattr(encode, "pooling", pooling), "max_length": getattr(encode, "max_length", max_length), "trust_remote_code": trust_remote_code,
    }
    write_index(encoded(df, "profile_text", encode, batch_size=batch_size), out, table, manifest, extra)
    return manifest
