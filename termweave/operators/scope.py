"""Scopes: candidates limited or moved up by class and by place in a hierarchy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import as_id, code_list, id_list
from .profiles import is_valid

#: Rows or concepts of a block; a task holds what two blocks list, some square of it, at a time.
BLOCK = 256


def with_class(candidates: DataFrame, concepts: DataFrame) -> DataFrame:
    """candidates with concept_class_id, null where a concept is not known."""
    known = concepts.select(as_id(F.col("concept_id")).alias("_id"), "concept_class_id").dropDuplicates(["_id"])
    return candidates.drop("concept_class_id").join(known, as_id(candidates["concept_id"]) == F.col("_id"), "left").drop("_id")


def drop_classes(candidates: DataFrame, classes: Sequence[str], concepts: DataFrame | None = None) -> DataFrame:
    """candidates of other classes; a null class stays."""
    if not classes:
        return candidates
    if "concept_class_id" not in candidates.columns:
        if concepts is None:
            return candidates
        candidates = with_class(candidates, concepts)
    return candidates.filter(F.coalesce(~F.trim("concept_class_id").isin(*classes), F.lit(True)))


def scope_ids(rows: DataFrame, concepts: DataFrame, query_id: str = "query_id", id_col: str = "atc_ids", code_col: str = "atc_codes", vocabulary: str = "ATC") -> DataFrame:
    """(query_id, ancestor): hierarchy nodes that rows name by id or by code."""
    out = None
    if id_col in rows.columns:
        out = rows.select(query_id, F.explode(id_list(F.col(id_col))).alias("ancestor"))
    if code_col in rows.columns:
        codes = rows.select(query_id, F.explode(code_list(F.col(code_col))).alias("code"))
        valid = concepts.filter((F.col("vocabulary_id") == vocabulary) & F.col("invalid_reason").isNull())
        # a code that several concepts hold means the last of them
        known = valid.groupBy(F.upper(F.trim("concept_code")).alias("code")).agg(F.max(F.col("concept_id").cast("long")).alias("ancestor"))
        coded = codes.join(known, "code").select(query_id, "ancestor")
        out = coded if out is None else out.unionByName(coded)
    if out is None:
        raise ValueError(f"rows have neither {id_col} nor {code_col}")
    return out.distinct()


def allowlist(scopes: DataFrame, ancestors: DataFrame, concepts: DataFrame, query_id: str = "query_id", most: int = 1000, domain: str = "Drug") -> DataFrame:
    """(query_id, concept_id): valid descendants of a row's scopes; rows with more than `most` (if above 0) have none."""
    valid = concepts.filter(is_valid([domain])).select(F.col("concept_id").cast("long").alias("concept_id"))
    asked = scopes.select("ancestor").distinct()
    edges = ancestors.select(F.col("ancestor_concept_id").cast("long").alias("ancestor"), F.col("descendant_concept_id").cast("long").alias("concept_id"))
    edges = edges.join(asked, "ancestor", "left_semi").join(valid, "concept_id", "left_semi")
    if most > 0:
        # a scope that alone has more leaves its rows without a list: they go before anything is listed
        wide = edges.distinct().groupBy("ancestor").agg(F.count("*").alias("n")).filter(F.col("n") > most).select("ancestor")
        beyond = scopes.join(wide, "ancestor", "left_semi").select(query_id).distinct()
        scopes, edges = scopes.join(beyond, query_id, "left_anti"), edges.join(wide, "ancestor", "left_anti")
    found = _listed(scopes, edges, query_id)
    if most <= 0:
        return found
    fits = found.groupBy(query_id).agg(F.count("*").alias("n")).filter(F.col("n") <= most).select(query_id)
    return found.join(fits, query_id, "left_semi")


def _blocks(pairs: DataFrame, member: str, name: str) -> DataFrame:
    """(name_set, name): members that have the same set of ancestors, in blocks of about BLOCK."""
    sets = pairs.filter("ancestor IS NOT NULL").groupBy(member).agg(F.array_sort(F.collect_set("ancestor")).alias(f"{name}_set"))
    n = sets.groupBy(f"{name}_set").agg(F.ceil(F.count("*") / BLOCK).alias("_n"))
    part = F.pmod(F.xxhash64(member), F.col("_n"))
    # by way of a struct, as lists drop nulls
    return sets.join(n, f"{name}_set").groupBy(f"{name}_set", part.alias("_part")).agg(F.collect_list(F.struct(member))[member].alias(name)).drop("_part")


def _listed(scopes: DataFrame, edges: DataFrame, query_id: str) -> DataFrame:
    """Distinct (query_id, concept_id) that share an ancestor: blocks meet once, by the least they share, and are listed where they are dealt to."""
    asked, below = _blocks(scopes, query_id, "_asked"), _blocks(edges, "concept_id", "_below")
    asked, below = asked.withColumn("ancestor", F.explode("_asked_set")), below.withColumn("ancestor", F.explode("_below_set"))
    once = F.array_min(F.array_intersect("_asked_set", "_below_set")) == F.col("ancestor")
    met = asked.join(below.hint("merge"), "ancestor").filter(once).select("_asked", "_below")
    met = met.repartition(int(met.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("_asked", "_below"))
    return met.select(F.explode("_asked").alias(query_id), "_below").select(query_id, F.explode("_below").alias("concept_id"))


def scoped_first(candidates: DataFrame, allowed: DataFrame, query_id: str = "query_id", rank: str = "rank", edges: DataFrame | None = None) -> DataFrame:
    """candidates with atc_match; those allowed come first, each part in its order. Rows without an allowlist are unmoved.

    allowed is (query_id, concept_id). With edges (ancestor, concept_id) it is (query_id, ancestor), and allowed is what
    those reach: a candidate's ancestors meet its query's, and the concepts of a query are never listed.
    """
    if edges is None:
        flags = allowed.select(F.col(query_id).alias("_q"), F.col("concept_id").alias("_id"), F.lit(True).alias("_in"))
        df = candidates.join(flags, (candidates[query_id] == F.col("_q")) & (as_id(candidates["concept_id"]) == F.col("_id")), "left")
        df = df.withColumn("atc_match", F.coalesce("_in", F.lit(False))).drop("_q", "_id", "_in")
    else:
        above = edges.groupBy(F.col("concept_id").alias("_id")).agg(F.collect_set("ancestor").alias("_above"))
        asked = allowed.groupBy(F.col(query_id).alias("_q")).agg(F.collect_set("ancestor").alias("_asked"))
        df = candidates.join(above, as_id(candidates["concept_id"]) == F.col("_id"), "left")
        df = df.join(asked, df[query_id] == F.col("_q"), "left")
        df = df.withColumn("atc_match", F.coalesce(F.arrays_overlap("_above", "_asked"), F.lit(False))).drop("_q", "_id", "_above", "_asked")
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(query_id).orderBy(F.desc("atc_match"), rank)))
