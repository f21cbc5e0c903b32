"""Features of candidates, and the orders built on them. One row per (query, candidate); all of it is windows per query.

NaN and null relevance sort last in every direction.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import forms, strength
from ..functions.text import brand_patterns, brand_score, brands, candidate_text, normalized

#: Keys that decide within near-ties, all descending.
TIE_KEYS = ("brand_strength_exact", "top20_strength_form_exact", "brand_score", "rerank_top20", "strength_exact", "strength_sim", "form_route_score", "release_score")
BASES = ("_relevance_score", "score", "final_score")


def number(c: Column) -> Column:
    return F.nanvl(c.try_cast("double"), F.lit(None).cast("double"))


def base_column(df: DataFrame) -> str | None:
    return next((c for c in BASES if c in df.columns), None)


# ---- features ------------------------------------------------------------------------------------------------------


def side(df: DataFrame, text: str, out: str, ignore_bracketed: bool) -> DataFrame:
    """df with what pairs need of a text column, as struct `out`: read once for each row of this side."""
    df = df.withColumn(f"{out}_f", strength.features(F.col(text), ignore_bracketed))
    own = [F.col(f"{out}_f.{c}") for c in ("strength", "words", "pairs", "release", "form")]
    df = df.withColumn(out, F.struct(F.col(text).alias("text"), *own, brands(F.col(text)).alias("brands"), brand_patterns(F.col(text)).alias("patterns")))
    return df.drop(f"{out}_f")


def _overlap(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def jaccard(q: Column, c: Column) -> Column:
    return 0.7 * _overlap(q["words"], c["words"]) + 0.3 * _overlap(q["pairs"], c["pairs"])


def pair_features(df: DataFrame, q: str = "q", c: str = "c") -> DataFrame:
    """df with the features of the structs q and c that `side` made."""
    a, b = F.col(q), F.col(c)
    df = df.withColumn("_dose", strength.strength_stats(a["strength"], b["strength"]))
    return df.withColumns(
        {
            "strength_sim": F.col("_dose.strength_sim"),
            "jaccard_text": jaccard(a, b),
            "brand_score": brand_score(a["text"], b["brands"], b["patterns"]),
            "release_score": forms.release_score(a["release"], b["release"]),
            "form_release_score": forms.release_form_score(a["release"], b["release"], a["form"], b["form"]),
            "form_route_score": forms.form_route_score(a["form"], b["form"]),
        }
    )


def minmax(c: Column, over: Window, least: float = 1e-12) -> Column:
    lo, hi = F.min(c).over(over), F.max(c).over(over)
    return F.when(hi - lo < least, 0.0).otherwise((c - lo) / (hi - lo))


def weighted_mean(strength_: Column, text: Column, w_strength: float, w_text: float) -> Column:
    """Weighted geometric mean with a floor."""
    floor = F.lit(1e-12)
    product = F.pow(F.greatest(strength_, floor), F.lit(w_strength)) * F.pow(F.greatest(text, floor), F.lit(w_text))
    return F.pow(product, F.lit(1.0 / max(w_strength + w_text, 1e-9)))


def _penalties(w_brand: float, w_form: float) -> Column:
    return F.exp(w_brand * F.col("brand_score")) * F.exp(w_form * F.col("form_release_score")) * F.exp(w_form * F.col("release_score"))


def gated_score(df: DataFrame, w_strength: float = 0.6, w_text: float = 0.4, w_brand: float = 0.5, w_form: float = 0.1) -> DataFrame:
    """post_score of single pairs: 0 unless doses agree."""
    mean = weighted_mean(F.col("_dose.s_dose") * F.col("_dose.p_extra"), F.col("jaccard_text"), w_strength, w_text)
    score = F.when(F.col("_dose.s_dose") <= 0, 0.0).otherwise(mean * _penalties(w_brand, w_form))
    return df.withColumn("post_score", score).withColumn("simple_score", F.col("post_score"))


def batch_score(df: DataFrame, query_id: str = "query_id", w_strength: float = 0.6, w_text: float = 0.4, w_brand: float = 0.5, w_form: float = 0.1, minmax_within_query: bool = False) -> DataFrame:
    """post_score of candidates of a query, not gated; features min-maxed within the query if asked."""
    w = Window.partitionBy(query_id)
    s, j = (minmax(F.col(c), w) if minmax_within_query else F.col(c) for c in ("strength_sim", "jaccard_text"))
    score = weighted_mean(s, j, w_strength, w_text) * _penalties(w_brand, w_form)
    return df.withColumn("post_score", score).withColumn("simple_score", F.col("post_score"))


# ---- orders ---------------------------------------------------------------------------------------------------------


def ordered(df: DataFrame, keys: Sequence[Column], query_id: str, prior: str, out: str = "rank") -> DataFrame:
    """df with its rank by keys, stable by the prior rank."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(query_id).orderBy(*keys, F.col(prior))))


def down(name: str) -> Column:
    return number(F.col(name)).desc_nulls_last()


def by_relevance(df: DataFrame, query_id: str = "query_id", prior: str = "retrieval_rank", base: str = "_relevance_score") -> DataFrame:
    return ordered(df, [down(base)], query_id, prior)


def tie_groups(df: DataFrame, query_id: str = "query_id", base: str = "_relevance_score", prior: str = "retrieval_rank", eps: float = 0.01, topn: int = 50) -> DataFrame:
    """df with _n (rank by base) and _group: runs of scores of which each is within eps of the one before it.

    Only the first topn form groups; each row after them stands alone.
    """
    w = Window.partitionBy(query_id).orderBy(down(base), F.col(prior))
    df = df.withColumn("_n", F.row_number().over(w))
    gap = F.lag(number(F.col(base))).over(w) - number(F.col(base))
    starts = F.sum(F.when(gap > eps, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return df.withColumn("_group", F.when(F.col("_n") <= topn, starts).otherwise(F.lit(topn) + F.col("_n")))


def by_near_ties(df: DataFrame, query_id: str = "query_id", base: str = "_relevance_score", prior: str = "retrieval_rank", keys: Sequence[str] = TIE_KEYS, eps: float = 0.01, topn: int = 50) -> DataFrame:
    """Features decide only among near-ties of the base score."""
    keys = [k for k in keys if k in df.columns]
    if topn <= 0 or not keys:
        return ordered(df, [down(base)], query_id, prior)
    df = tie_groups(df, query_id, base, prior, eps, topn)
    inside = F.col("_n") <= topn
    keyed = [F.when(inside, number(F.col(k))).desc_nulls_last() for k in [*keys, base]]
    return ordered(df, [F.col("_group"), *keyed], query_id, "_n").drop("_n", "_group")


def by_keys(df: DataFrame, query_id: str = "query_id", base: str = "_relevance_score", prior: str = "retrieval_rank", keys: Sequence[str] = TIE_KEYS) -> DataFrame:
    """Lexicographic: the base score, then the features."""
    return ordered(df, [down(base), *(down(k) for k in keys if k in df.columns)], query_id, prior)


def by_rules(df: DataFrame, query_id: str = "query_id", prior: str = "retrieval_rank", prefer_brand: bool = True, extra: Sequence[Column] = ()) -> DataFrame:
    """Brand first, then final_score (or post_score), strength, text."""
    brand = next((c for c in ("brand_score", "_brand_score") if c in df.columns), None)
    score = next((c for c in ("final_score", "post_score") if c in df.columns), None)
    names = [brand if prefer_brand else None, score, *(c for c in ("strength_sim", "jaccard_text") if c in df.columns)]
    return ordered(df, [*(down(n) for n in names if n), *extra], query_id, prior)


def applies(mode: str, weight: float) -> bool:
    return mode != "blend" or float(weight) > 0.0


def enriched(candidates: DataFrame, queries: DataFrame, query_id: str = "query_id", prior: str = "retrieval_rank", mode: str = "tiebreak", weight: float = 0.05, w_strength: float = 0.6, w_text: float = 0.4, w_brand: float = 0.3, minmax_within_query: bool = True, eps: float = 0.01, topn: int = 50, brand_strict: bool = False, prefer_brand: bool = True) -> DataFrame:
    """Candidates with features, final_score and rank. queries: (query_id, query_norm).

    Texts are parsed once for each query and each distinct candidate text, then joined to the pairs.
    """
    name = F.col("concept_name") if "concept_name" in candidates.columns else F.lit("")
    profile = F.col("profile_text") if "profile_text" in candidates.columns else F.lit("")
    df = candidates.withColumn("_text", normalized(candidate_text(name, profile)))
    c_side = side(df.select("_text").distinct(), "_text", "c", True)
    q_side = side(queries.select(query_id, "query_norm"), "query_norm", "q", False).select(query_id, "q")
    df = df.join(c_side, "_text").join(q_side, query_id)
    df = batch_score(pair_features(df), query_id, w_strength, w_text, w_brand, 0.1, minmax_within_query)
    exact = (F.col("strength_sim") >= 0.99) & (F.col("q.strength.n") > 0)
    df = df.withColumn("strength_exact", exact.cast("int"))
    df = df.withColumn("form_route_score", F.when(exact & (F.col("form_route_score") < 0), F.col("form_route_score") + 0.5).otherwise(F.col("form_route_score")))
    asked = F.col("q.text").rlike(r"\[[^\[\]]+\]")
    done = lambda x: x.drop("_text", "q", "c", "_dose", "_asked")
    base = base_column(df)
    if base is None:
        return done(df.withColumn("rank", F.col(prior)))
    w = Window.partitionBy(query_id)
    place = F.row_number().over(w.orderBy(down(base), F.col(prior)))
    df = df.withColumn("rerank_top20", (place <= 20).cast("int"))
    df = df.withColumn("brand_strength_exact", ((F.col("brand_score") > 0) & (F.col("strength_exact") == 1)).cast("int"))
    df = df.withColumn("top20_strength_form_exact", ((F.col("rerank_top20") == 1) & (F.col("strength_exact") == 1) & (F.col("form_route_score") >= 0.5)).cast("int"))
    if brand_strict:
        # mismatches go, unless nothing else is left
        df = df.withColumn("_any", F.max((F.col("brand_score") >= 0).cast("int")).over(w))
        df = df.filter(~asked | (F.col("_any") == 0) | (F.col("brand_score") >= 0)).drop("_any")
    if mode == "blend":
        df = df.withColumn("final_score", (1.0 - weight) * F.coalesce(number(F.col(base)), F.lit(0.0)) + weight * F.col("post_score"))
        return done(by_rules(df, query_id, prior, prefer_brand))
    df = df.withColumn("final_score", F.col(base).cast("double"))
    if mode == "lex":
        return done(by_keys(df, query_id, base, prior))
    if mode == "tiebreak":
        return done(by_near_ties(df, query_id, base, prior, eps=eps, topn=topn))
    return done(df.withColumn("rank", F.col(prior)))


def plain(candidates: DataFrame, query_id: str = "query_id", prior: str = "retrieval_rank") -> DataFrame:
    """The order without features: by relevance, where there is one."""
    base = next((c for c in ("_relevance_score", "score") if c in candidates.columns), None)
    if base is None:
        return candidates.withColumn("final_score", F.lit(0.0)).withColumn("rank", F.col(prior))
    return by_relevance(candidates, query_id, prior, base).withColumn("final_score", F.coalesce(number(F.col(base)), F.lit(0.0)))
