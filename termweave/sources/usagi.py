"""Review sheets in the Usagi layout."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values. Columns, types and defaults of a review row.
COLUMNS = {
    "sourceCode": ("string", None),
    "sourceName": ("string", None),
    "sourceFrequency": ("double", None),
    "sourceAutoAssignedConceptIds": ("string", ""),
    "matchScore": ("double", 0.0),
    "mappingStatus": ("string", "UNCHECKED"),
    "equivalence": ("string", "EQUIVALENT"),
    "statusSetBy": ("string", None),
    "statusSetOn": ("double", None),
    "conceptId": ("long", None),
    "conceptName": ("string", None),
    "domainId": ("string", None),
    "mappingType": ("string", "MAPS_TO"),
    "comment": ("string", None),
    "createdBy": ("string", None),
    "createdOn": ("double", None),
    "assignedReviewer": ("string", None),
}
REQUIRED = ("sourceCode", "sourceName", "mappingStatus", "matchScore")


def is_review_sheet(columns: Sequence[str]) -> bool:
    return set(REQUIRED) <= set(columns)


def _text(c: Column) -> Column:
    """Trimmed text; null if there is none."""
    return F.nullif(F.trim(c.cast("string")), F.lit(""))


def invalid_rows(df: DataFrame) -> DataFrame:
    """Rows that are no review rows, with the reason."""
    score = F.col("matchScore").cast("string")
    reason = (
        F.when(_text(F.col("sourceCode")).isNull(), "sourceCode is empty")
        .when(_text(F.col("sourceName")).isNull(), "sourceName is empty")
        .when(_text(score).isNotNull() & F.trim(score).try_cast("double").isNull(), "matchScore is no number")
    )
    return df.withColumn("reason", reason).filter("reason IS NOT NULL")


def review_rows(df: DataFrame, query_id: str = "query_id", name_col: str = "sourceName", code_col: str | None = "sourceCode") -> DataFrame:
    """(query_id, review columns, other columns): whatever is missing is filled in, code and name from the row's number."""
    has = lambda c: _text(F.col(c)) if c and c in df.columns else F.lit(None).cast("string")
    n = F.col(query_id) + 1
    out = {}
    for c, (kind, default) in COLUMNS.items():
        if c in df.columns:
            # a column that is there stays as it is; only text for names and scores is required
            out[c] = F.col(c).cast("string").try_cast(kind) if kind != "string" else F.col(c).cast("string")
        else:
            out[c] = F.lit(default).cast(kind)
    out["sourceName"] = F.coalesce(has(name_col), has("sourceName"), F.concat(F.lit("Query "), n.cast("string")))
    out["sourceCode"] = F.coalesce(has(code_col), has("sourceCode"), F.concat(F.lit("ROW_"), F.when(n < 100_000, F.lpad(n.cast("string"), 5, "0")).otherwise(n.cast("string"))))
    out["mappingStatus"] = F.coalesce(_text(out["mappingStatus"]), F.lit("UNCHECKED"))
    out["matchScore"] = F.coalesce(out["matchScore"], F.lit(0.0))
    rest = [c for c in df.columns if c not in COLUMNS and c != query_id]
    return df.select(query_id, *[e.alias(c) for c, e in out.items()], *rest)


def with_best(rows: DataFrame, best: DataFrame, query_id: str = "query_id", by: str = "termweave") -> DataFrame:
    """rows with the best candidate of each query (query_id, concept_id, concept_name, domain_id, final_score), unchecked again."""
    b = best.select(F.col(query_id).alias("_q"), F.col("concept_id").cast("long").alias("_id"), F.col("concept_name").alias("_name"), F.col("domain_id").alias("_domain"), F.col("final_score").cast("double").alias("_score"))
    df = rows.join(b, rows[query_id] == F.col("_q"), "left")
    found = F.col("_id").isNotNull()
    pick = lambda new, old: F.when(found, F.col(new)).otherwise(F.col(old))
    df = df.withColumns({"conceptId": pick("_id", "conceptId"), "conceptName": pick("_name", "conceptName"), "matchScore": pick("_score", "matchScore"), "domainId": F.when(found, F.coalesce("_domain", "domainId")).otherwise(F.col("domainId"))})
    df = df.withColumns({"mappingStatus": F.lit("UNCHECKED"), "statusSetBy": F.lit(by), "mappingType": F.coalesce(_text(F.col("mappingType")), F.lit("MAPS_TO"))})
    return df.drop("_q", "_id", "_name", "_domain", "_score")
