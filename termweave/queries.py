"""The engine's operators applied to the driver's tables, each with the SQL that checks it.

The tables hold no vocabulary, so concepts, synonyms, hierarchies and sheets are derived from them by expressions that
Spark and the checking engine read alike.
"""

from __future__ import annotations

from collections.abc import Callable
from string import ascii_lowercase

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import forms, strength, text
from .functions.lexicon import DOSAGE_FORMS, RELEASES, USAN_OF_INN
from .operators import metrics, model_rank, profiles, ranking, scope, search
from .plans import mapping
from .sources import exports, usagi
from .sources.encoders import encoded

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derived(spark: SparkSession, sf_dir: str, name: str, exprs: dict[str, str]) -> DataFrame:
    return read(spark, sf_dir, name).selectExpr(*[f"{e} AS {c}" for c, e in exprs.items()])


def sql(name: str, exprs: dict[str, str]) -> str:
    return f"SELECT {', '.join(f'{e} AS {c}' for c, e in exprs.items())} FROM {name}"


CONCEPT = {
    "concept_id": "p_partkey",
    "concept_name": "concat(p_name, ' ', CAST(p_size * 10 AS STRING), 'mg', CASE p_partkey % 6 WHEN 0 THEN ' Tablet' WHEN 1 THEN ' oral  solution' WHEN 2 THEN ' ER Capsule' WHEN 3 THEN concat(' [', p_brand, ']') WHEN 4 THEN ' enteric-coated tab' ELSE ' eye drops' END)",
    "concept_code": "p_brand",
    "domain_id": "CASE WHEN p_partkey % 5 = 0 THEN 'Device' ELSE 'Drug' END",
    "concept_class_id": "CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE p_type END",
    "vocabulary_id": "CASE WHEN p_partkey % 3 = 0 THEN 'ATC' ELSE 'RxNorm' END",
    "standard_concept": "CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE 'S' END",
    "invalid_reason": "CASE WHEN p_partkey % 11 = 0 THEN 'D' END",
}
SYNONYM = {"concept_id": "l_partkey", "concept_synonym_name": "CASE WHEN l_linenumber = 7 THEN NULL ELSE concat('Alt  ', l_returnflag, l_linestatus, CAST(l_linenumber AS STRING)) END"}
#: Candidates: a query an order, a candidate a line; retrieval_rank numbers them.
CANDIDATE = {"query_id": "l_orderkey", "concept_id": "l_partkey", "_relevance_score": "l_quantity", "brand_score": "l_tax", "strength_sim": "l_discount", "jaccard_text": "l_extendedprice / 100000", "final_score": "l_quantity / 50", "post_score": "l_discount * 10", "release_score": "CAST(l_suppkey % 3 AS DOUBLE)", "line": "l_linenumber", "supplier": "l_suppkey"}
_ORDER = "query_id ORDER BY line, concept_id, supplier, _relevance_score, jaccard_text"
CANDIDATES = f"SELECT *, CAST(row_number() OVER (PARTITION BY {_ORDER}) AS INTEGER) AS retrieval_rank FROM ({sql('lineitem', CANDIDATE)}) x"
CONCEPTS = sql("part", CONCEPT)
VALID = "standard_concept = 'S' AND invalid_reason IS NULL"
NORM = r"trim(regexp_replace(lower({}), '[\s\x1c-\x1f\x85\p{{Z}}]+', ' ', 'g'))"


def concepts_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, "part", CONCEPT)


def candidates_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.expr(f"CAST(row_number() OVER (PARTITION BY {_ORDER}) AS INT)")
    return derived(spark, sf_dir, "lineitem", CANDIDATE).withColumn("retrieval_rank", rank)


# ---- profiles ------------------------------------------------------------------------------------------------------


@query(f"SELECT concept_id, lower(concept_name) AS profile_text, vocabulary_id FROM ({CONCEPTS}) c WHERE {VALID} AND domain_id IN ('Drug') AND concept_class_id NOT IN ('PROMO')")
def profile_scan(spark, sf_dir):
    c = concepts_of(spark, sf_dir)
    own = c.select("concept_id", F.lower("concept_name").alias("profile_text"), "vocabulary_id")
    return profiles.scan_profiles(own, c, ["Drug"], (), ["PROMO"], ["vocabulary_id"])


@query(rf"""
WITH c AS ({CONCEPTS}), s AS (
  SELECT concept_id, list_sort(list(DISTINCT concept_synonym_name)) AS syn FROM ({sql("lineitem", SYNONYM)}) x
  WHERE concept_synonym_name IS NOT NULL GROUP BY 1
), n AS (
  SELECT concept_id, {NORM.format("concept_name")} AS concept_name, {NORM.format("concept_code")} AS concept_code, domain_id, concept_class_id, vocabulary_id,
    list_transform(coalesce(syn, []), lambda x: {NORM.format("x")})[1:3] AS syn
  FROM c LEFT JOIN s USING (concept_id)
  WHERE {VALID} AND domain_id IN ('Drug') AND concept_class_id NOT IN ('Gene DNA Variant', 'Gene Protein Variant', 'Gene RNA Variant', 'Variant')
)
SELECT concept_id, concept_name, concept_code, domain_id, concept_class_id, vocabulary_id,
  concat_ws(' | ', concept_name, nullif(array_to_string(syn, '; '), ''), concept_code) AS profile_text
FROM n
""")
def profile_compose(spark, sf_dir):
    synonyms = derived(spark, sf_dir, "lineitem", SYNONYM)
    return profiles.compose_profiles(concepts_of(spark, sf_dir), synonyms, ["Drug"], max_synonyms=3, with_code=True)


# ---- text ----------------------------------------------------------------------------------------------------------


@query(rf"""SELECT doc_id, length({NORM.format("text")}) AS n, sha256({NORM.format("text")}) AS digest FROM documents""")
def normalized_texts(spark, sf_dir):
    t = text.normalized(F.col("text"))
    return read(spark, sf_dir, "documents").select("doc_id", F.length(t).cast("long").alias("n"), F.sha2(t, 256).alias("digest"))


_DOSED = "concat(p_name, ' ', CAST(p_size AS STRING), CASE p_partkey % 4 WHEN 0 THEN 'MG' WHEN 1 THEN 'ml (x)' WHEN 2 THEN ' iu' ELSE 'units é' END)"


@query(rf"""
WITH q AS (SELECT p_partkey AS id, {_DOSED} AS name, CASE WHEN p_partkey % 3 = 0 THEN NULL WHEN p_partkey % 3 = 1 THEN ' ' ELSE p_brand END AS code FROM part),
t AS (SELECT id, CASE WHEN trim(coalesce(code, '')) = '' THEN name ELSE name || ' (' || trim(code) || ')' END AS query_text FROM q),
s AS (SELECT id, query_text, trim(regexp_replace(regexp_replace(replace(replace(query_text, '(', ''), ')', ''), '[^\x00-\x7F]+', ' ', 'g'), '\s+', ' ', 'g')) AS clean FROM t)
SELECT id, query_text, lower(regexp_replace(clean, '(?i)([0-9])(mg|mcg|g|ml|l|iu|meq|unit|units|unt)\b', '\1 \2', 'g')) AS query_norm FROM s
""")
def prepared_queries(spark, sf_dir):
    d = derived(spark, sf_dir, "part", {"id": "p_partkey", "name": _DOSED, "code": "CASE WHEN p_partkey % 3 = 0 THEN NULL WHEN p_partkey % 3 = 1 THEN ' ' ELSE p_brand END"})
    q = text.query_text(F.col("name"), F.col("code"))
    return d.select("id", q.alias("query_text"), text.prepared_query(q, ascii_only=True, drop_chars="()", usan=False).alias("query_norm"))


_NAMES = list(USAN_OF_INN)


def _inn_text(pick: str) -> str:
    return "concat('Oral ', CASE p_partkey % 60 " + " ".join(f"WHEN {i} THEN '{n.title()}'" for i, n in enumerate(_NAMES)) + f" END, ' {pick}')"


def _usan_sql() -> str:
    out = "t"
    for name, usan in USAN_OF_INN.items():
        out = rf"regexp_replace({out}, '(?i)\b{name}\b', '{usan}', 'g')"
    return out


@query(f"SELECT id, {_usan_sql()} AS name FROM (SELECT p_partkey AS id, {_inn_text('5 mg')} AS t FROM part) x")
def usan_names(spark, sf_dir):
    return derived(spark, sf_dir, "part", {"id": "p_partkey", "t": _inn_text("5 mg")}).select("id", text.usan_names(F.col("t")).alias("name"))


@query(r"""
SELECT s_suppkey AS id, list_transform(list_filter(regexp_split_to_array(t, '[,\s;|]+'), lambda p: p <> ''), lambda p: upper(p))::VARCHAR AS codes,
  list_transform(list_filter(regexp_split_to_array(t, '[,\s;|]+'), lambda p: regexp_full_match(p, '[0-9]+')), lambda p: CAST(p AS BIGINT))::VARCHAR AS ids,
  TRY_CAST(CASE WHEN s_suppkey % 2 = 0 THEN CAST(s_nationkey AS VARCHAR) ELSE 'n/a' END AS BIGINT) AS safe
FROM (SELECT *, concat(s_nationkey, ';a', s_suppkey % 7, ' , ', s_suppkey % 11, '|1.5') AS t FROM supplier) x
""")
def cell_lists(spark, sf_dir):
    s = read(spark, sf_dir, "supplier")
    t = F.expr("concat(s_nationkey, ';a', s_suppkey % 7, ' , ', s_suppkey % 11, '|1.5')")
    shown = lambda a: F.concat(F.lit("["), F.array_join(F.transform(a, lambda x: x.cast("string")), ", "), F.lit("]"))
    safe = text.as_id(F.expr("CASE WHEN s_suppkey % 2 = 0 THEN CAST(s_nationkey AS STRING) ELSE 'n/a' END"))
    return s.select(F.col("s_suppkey").alias("id"), shown(text.code_list(t)).alias("codes"), shown(text.id_list(t)).alias("ids"), safe.alias("safe"))


# ---- forms and brands ----------------------------------------------------------------------------------------------

_CLEAN = r"regexp_replace(regexp_replace(lower(trim(t)), '[()\[\]{},;:/\\]+', ' ', 'g'), '\s+', ' ', 'g')"


def _release_sql() -> str:
    abbreviated = lambda r: rf"regexp_matches(t, '(?i)\b({'|'.join(RELEASES[r][0])})\b')"
    cases = [f"WHEN {abbreviated('gastro_resistant')} THEN 'gastro_resistant'"]
    cases += [f"WHEN contains(clean, '{a}') THEN '{r}'" for r, (_, names, _, _) in RELEASES.items() for a in names]
    cases += [f"WHEN {abbreviated(r)} THEN '{r}'" for r in forms.PRECEDENCE]
    return f"CASE {' '.join(cases)} END"


def _form_sql() -> str:
    named = {forms._clean(a): f for f, (_, _, names, _) in DOSAGE_FORMS.items() for a in names}
    cases = []
    for alias, form in sorted(named.items(), key=lambda x: -len(x[0])):
        words = ", ".join(f"'{w}'" for w in alias.split(" "))
        cases.append(f"WHEN contains(clean, '{alias}') OR list_has_all(string_split(clean, ' '), [{words}]) THEN '{form}'")
    return f"CASE {' '.join(cases)} END"


_BARE = r"regexp_replace(concept_name, '\[[^\[\]]+\]', ' ', 'g')"


@query(f"WITH c AS (SELECT concept_id, {_BARE} AS t FROM ({CONCEPTS}) x), d AS (SELECT *, {_CLEAN} AS clean FROM c) SELECT concept_id, {_release_sql()} AS release, {_form_sql()} AS form FROM d")
def release_and_form(spark, sf_dir):
    return concepts_of(spark, sf_dir).select("concept_id", forms.told(F.col("concept_name"), True).alias("t")).select("concept_id", "t.release", "t.form")


@query(rf"""
WITH c AS (SELECT concept_id, concept_name, concept_code FROM ({CONCEPTS}) x),
b AS (SELECT concept_id, regexp_extract(concept_name, '\[([^\[\]]+)\]', 1) AS brand, CASE WHEN concept_id % 2 = 0 THEN 'Brand#1 x' ELSE concat('a ', lower(concept_code), '.') END AS q FROM c)
SELECT concept_id, CASE WHEN brand = '' THEN 0.0 WHEN regexp_matches(q, concat('(?i)(^|[^A-Za-z0-9])', brand, '([^A-Za-z0-9]|$)')) THEN 1.0 ELSE -1.0 END AS brand_score FROM b
""")
def brand_scores(spark, sf_dir):
    t, q = F.col("concept_name"), F.expr("CASE WHEN concept_id % 2 = 0 THEN 'Brand#1 x' ELSE concat('a ', lower(concept_code), '.') END")
    return concepts_of(spark, sf_dir).select("concept_id", text.brand_score(q, text.brands(t), text.brand_patterns(t)).alias("brand_score"))


def _term(key: str, name: str, size: str, brand: str) -> dict[str, str]:
    """A term whose strengths, words, release and form are known from the columns that it is made of, by `k`."""
    k = f"({key} % 7 + {size}) % 12"
    return {
        "concept_id": key,
        "name": f"lower({name})",
        "brand": f"lower({brand})",
        "n": f"CAST({size} AS DOUBLE)",
        "k": k,
        "term": f"concat({name}, ' ', CASE {k} "
        f"WHEN 0 THEN concat(({size}) * 10, ' mg oral tablet') WHEN 1 THEN concat({size}, ' mg/5 ml oral solution') WHEN 2 THEN concat({size}, '% cream') "
        f"WHEN 3 THEN concat({size}, '-', {size} + 5, ' mg ER capsule') WHEN 4 THEN concat({size}, ' mg + ', 2 * ({size}), ' mg enteric coated tablet') "
        f"WHEN 5 THEN concat({size}, ' mcg per actuation nasal spray ', {brand}) WHEN 6 THEN concat({size}, ' iu [', {brand}, ']') WHEN 7 THEN concat({size}, '/', ({size}) * 20, ' plain gel') "
        f"WHEN 8 THEN concat({size}, ' mg/g ointment') WHEN 9 THEN concat({size}, ' tablets') WHEN 10 THEN concat({size}, ' g per 2 l delayed release eye drops') ELSE 'lotion' END)",
    }


TERM = _term("p_partkey", "p_name", "p_size", "p_brand")
#: By k: kind, value, unit, base and its unit of each strength; then the words after the name, those of release and form, the release and the form.
_TERM_STRENGTHS = (
    (0, "single", "n * 10", "mg", None, None), (1, "ratio", "n", "mg", 5, "ml"), (1, "percent", "n / 5000 * 100", None, None, None),
    (2, "percent", "n", None, None, None), (2, "ratio", "n * 1000", "mg", 100, "ml"), (3, "single", "n", "mg", None, None), (3, "single", "n + 5", "mg", None, None),
    (4, "single", "n", "mg", None, None), (4, "single", "2 * n", "mg", None, None), (5, "ratio", "n / 1000", "mg", 1, "actuation"), (6, "single", "n", "iu", None, None),
    (7, "single", "n", None, None, None), (7, "single", "n * 20", None, None, None), (8, "ratio", "n", "mg", 1000, "mg"), (8, "percent", "n / 1000 * 100", None, None, None),
    (9, "single", "n", "tablet", None, None), (10, "ratio", "n * 1000", "mg", 2000, "ml"), (10, "percent", "n * 1000 / 2000000 * 100", None, None, None),
)
_TERM_WORDS = (
    (0, "oral tablet", "tablet", None, "oral_tablet"), (1, "oral solution", "oral solution", None, "oral_solution"), (2, "cream", "", None, None),
    (3, "er capsule", "er extended release capsule", "ER", "oral_capsule"), (4, "enteric coated tablet", "dr delayed release enteric coated tablet", "DR enteric", "oral_tablet"),
    (5, "nasal spray brand", "nasal spray", None, "nasal_spray"), (6, "", "", None, None), (7, "plain gel", "", None, None), (8, "ointment", "", None, None), (9, "", "", None, "oral_tablet"),
    (10, "delayed release eye solution", "dr delayed release ophthalmic solution", "DR", "ophthalmic_solution"), (11, "lotion", "", None, None),
)


def _literal(v) -> str:
    return "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)


_STRENGTHS_SQL = " UNION ALL ".join(f"SELECT concept_id, '{kind}' AS kind, CAST({value} AS DOUBLE) AS value, CAST({_literal(unit)} AS VARCHAR) AS unit, CAST({_literal(per)} AS DOUBLE) AS per, CAST({_literal(per_unit)} AS VARCHAR) AS per_unit FROM t WHERE k = {k}" for k, kind, value, unit, per, per_unit in _TERM_STRENGTHS)
_MATCHED = "CASE WHEN len(x) = 1 THEN [list_min(list_transform(y, lambda v: abs(ln(v) - ln(x[1]))))] ELSE [abs(ln(x[1]) - ln(y[1])), abs(ln(x[2]) - ln(y[2]))] END"


def _features_sql(twice: bool) -> str:
    """CTEs from t (terms) and pairs (q, d: their ids) to f: the features of pairs. twice: whether d's text is its term, said twice."""
    return rf"""
s AS ({_STRENGTHS_SQL}),
w AS (SELECT concept_id, brand, k, release, form, split_part(form, '_', 1) AS route, list_filter(string_split(concat(name, ' ', tail, ' ', label), ' '), lambda x: x <> '') AS once, list_filter(string_split(concat(name, ' ', tail, ' ', {"name, ' ', tail, ' '," if twice else ""} label), ' '), lambda x: x <> '') AS often
  FROM t JOIN (VALUES {", ".join(f"({', '.join(map(_literal, r))})" for r in _TERM_WORDS)}) v(k, tail, label, release, form) USING (k)),
l AS (SELECT *, {", ".join(f"list_distinct({x}) AS {x}_own, list_distinct(list_transform(range(1, len({x})), lambda i: concat({x}[i], ' ', {x}[i + 1]))) AS {x}_two" for x in ("once", "often"))} FROM w),
has AS (SELECT t.concept_id, count(s.kind) AS n, coalesce(bool_or(kind = 'ratio' AND per_unit = 'ml'), false) AS per_volume, coalesce(bool_or(kind = 'ratio' AND unit = 'mg' AND per_unit = 'mg'), false) AS mass_ratio,
  coalesce(bool_or(kind = 'single' AND unit = 'mg'), false) AS mass FROM t LEFT JOIN s USING (concept_id) GROUP BY 1),
e AS (
  SELECT concept_id, variant, CASE WHEN kind = 'ratio' AND unit = 'mg' AND per_unit IN ('mg', 'ml') THEN 'mass per' WHEN kind = 'ratio' THEN concat(unit, ' per ', per_unit) ELSE coalesce(nullif(unit, 'mg'), 'mass') END AS key,
    CASE WHEN kind = 'ratio' THEN 1.0 WHEN unit IS NULL OR unit = 'mg' THEN 0.8 WHEN unit = 'tablet' THEN 0.3 ELSE 0.6 END::DOUBLE AS weight,
    CASE WHEN kind = 'ratio' AND unit = 'mg' AND per_unit = 'mg' THEN value / per * 1000 WHEN kind = 'ratio' THEN value / per ELSE value END AS value
  FROM s, (VALUES ('plain'), ('volume'), ('amount')) v(variant) WHERE kind <> 'percent'
  UNION ALL SELECT concept_id, 'amount', 'mass', 0.8, value FROM s WHERE kind = 'ratio' AND unit = 'mg' AND per_unit = 'mg'
), b AS (SELECT concept_id, variant, key, any_value(weight) AS weight, list_sort(list(value)) AS amounts FROM e GROUP BY ALL),
p AS (
  SELECT pairs.q AS iq, pairs.d AS id, q.n > 0 AND d.n > 0 AS filled, sided, CASE WHEN sided = 'gate' THEN 'plain' WHEN q.per_volume OR d.per_volume THEN 'volume' WHEN q.mass_ratio AND d.mass AND NOT d.mass_ratio THEN 'amount' ELSE 'plain' END AS qv,
    CASE WHEN sided = 'gate' THEN 'plain' WHEN q.per_volume OR d.per_volume THEN 'volume' WHEN d.mass_ratio AND q.mass AND NOT q.mass_ratio THEN 'amount' ELSE 'plain' END AS dv
  FROM pairs JOIN has q ON q.concept_id = pairs.q JOIN has d ON d.concept_id = pairs.d, (VALUES ('gate'), ('sim')) x(sided)
), j AS (
  SELECT iq, id, sided, key, coalesce(q.weight, d.weight) AS weight, q.amounts AS q, d.amounts AS d
  FROM (SELECT iq, id, sided, key, weight, amounts FROM p JOIN b ON b.concept_id = iq AND variant = qv) q
  FULL JOIN (SELECT iq, id, sided, key, weight, amounts FROM p JOIN b ON b.concept_id = id AND variant = dv) d USING (iq, id, sided, key)
), m AS (
  SELECT *, CASE WHEN q IS NULL OR d IS NULL THEN [] ELSE {_MATCHED} END AS costs
  FROM (SELECT *, CASE WHEN len(q) <= len(d) THEN q ELSE d END AS x, CASE WHEN len(q) <= len(d) THEN d ELSE q END AS y FROM j) z
), n AS (SELECT *, len(list_filter(costs, lambda c: c < 8 - 1e-9)) AS hits, list_sum(list_transform(costs, lambda c: CASE WHEN c < 8 - 1e-9 THEN c ELSE c - 8 END)) AS cost FROM m),
g AS (
  SELECT iq, id, sided, sum(weight * coalesce(len(q), 0)) AS total_q, sum(CASE WHEN q IS NULL THEN weight * len(d) ELSE 0 END) AS lone, sum(CASE WHEN hits > 0 THEN weight * greatest(cost, 0) ELSE 0 END) AS cost,
    sum(weight * hits) AS hits, sum(CASE WHEN hits > 0 THEN weight * greatest(len(d) - hits, 0) ELSE 0 END) AS extra
  FROM n GROUP BY ALL
), h AS (SELECT p.iq, p.id, p.sided, filled, coalesce(hits, 0) AS hits, exp(-cost / nullif(hits, 0)) AS s, exp(-0.7 * (extra + CASE WHEN total_q > 0 THEN lone ELSE 0 END)) AS extra, hits / greatest(total_q, 1e-9) AS coverage FROM p LEFT JOIN g USING (iq, id, sided)),
f AS (
  SELECT pairs.q, pairs.d, q.k AS q_k, sim.filled, CASE WHEN NOT sim.filled THEN 0.0 WHEN sim.hits <= 0 THEN -1.0 WHEN sim.coverage < 0.3 THEN 0.0 WHEN sim.s < 0.2 THEN -1.0 ELSE sim.s * sim.extra * sim.coverage END AS strength_sim,
    CASE WHEN gate.filled AND gate.hits > 0 AND gate.s >= 0.6 THEN gate.s * gate.extra ELSE 0.0 END AS dose,
    0.7 * len(list_intersect(q.once_own, d.often_own)) / len(list_distinct(q.once_own || d.often_own)) + 0.3 * coalesce(len(list_intersect(q.once_two, d.often_two)) / nullif(len(list_distinct(q.once_two || d.often_two)), 0), 0) AS jaccard_text,
    CAST(CASE WHEN d.k <> 6 THEN 0.0 WHEN q.k IN (5, 6) AND q.brand = d.brand THEN 1.0 ELSE -1.0 END AS DOUBLE) AS brand_score,
    CAST(CASE WHEN q.release IS NULL AND d.release IS NULL THEN 0.0 WHEN q.release IS NULL THEN -0.2 WHEN d.release IS NULL THEN -0.4 WHEN q.release[1:2] = d.release[1:2] THEN 0.4 ELSE -0.4 END AS DOUBLE) AS release_score,
    CAST(CASE WHEN q.release <> d.release OR q.form <> d.form THEN -1.0 ELSE 0.0 END AS DOUBLE) AS form_release_score,
    CAST(CASE WHEN q.form IS NULL AND d.form IS NOT NULL THEN -0.5 WHEN q.form IS NULL OR d.form IS NULL THEN 0.0 WHEN q.form = d.form THEN 1.0 WHEN q.route = d.route THEN 0.5 ELSE -1.0 END AS DOUBLE) AS form_route_score
  FROM pairs JOIN l q ON q.concept_id = pairs.q JOIN l d ON d.concept_id = pairs.d JOIN h sim ON sim.iq = pairs.q AND sim.id = pairs.d AND sim.sided = 'sim' JOIN h gate ON gate.iq = pairs.q AND gate.id = pairs.d AND gate.sided = 'gate'
)"""


@query(f"""
WITH t AS ({sql("part", TERM)}), pairs AS (SELECT a.concept_id AS q, b.concept_id AS d FROM t a JOIN t b ON b.concept_id = a.concept_id + 1), {_features_sql(False)}
SELECT q AS concept_id, round(strength_sim, 9) AS strength_sim, round(jaccard_text, 9) AS jaccard_text, brand_score, release_score, form_release_score, form_route_score,
  round(CASE WHEN dose <= 0 THEN 0 ELSE pow(greatest(dose, 1e-12), 0.6) * pow(greatest(jaccard_text, 1e-12), 0.4) * exp(0.5 * brand_score) * exp(0.1 * form_release_score) * exp(0.1 * release_score) END, 9) AS post_score
FROM f
""")
def pair_features(spark, sf_dir):
    """Each term as a query for the next one: all features and the gated score. The SQL knows strengths and words from the terms' columns."""
    d = derived(spark, sf_dir, "part", TERM).select("concept_id", text.normalized(F.col("term")).alias("t"))
    # reading a text costs more than moving it, and the join is by the same key
    dealt = lambda x: x.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "concept_id")
    q = ranking.side(dealt(d), "t", "q", False).select("concept_id", "q")
    c = ranking.side(dealt(d.withColumn("concept_id", F.col("concept_id") - 1)), "t", "c", True).select("concept_id", "c")
    # a table that is small as a file is not small as rows that were read: neither side is ever broadcast
    df = ranking.gated_score(ranking.pair_features(q.join(c.hint("merge"), "concept_id")))
    near = lambda c: F.round(c, 9).alias(c)
    return df.select("concept_id", near("strength_sim"), near("jaccard_text"), "brand_score", "release_score", "form_release_score", "form_route_score", near("post_score"))


@query(f"WITH t AS ({sql('part', TERM)}), s AS ({_STRENGTHS_SQL}) SELECT concept_id, kind, round(value, 9) AS value, unit, per, per_unit FROM s")
def strength_components(spark, sf_dir):
    found = derived(spark, sf_dir, "part", TERM).select("concept_id", F.explode(strength.components(F.col("term"))).alias("s")).select("concept_id", "s.*")
    return found.withColumn("value", F.round("value", 9))


# ---- search --------------------------------------------------------------------------------------------------------


def _near_sql(where: str) -> str:
    return f"""
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS concept_id, round(list_cosine_similarity(q.e, c.e), 12) AS sim FROM v q JOIN v c ON q.vec_id % 20 = 0 AND {where}),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, concept_id) AS INTEGER) AS retrieval_rank FROM s)
SELECT query_id, concept_id, round(1 - sim, 6) AS distance, retrieval_rank FROM r WHERE retrieval_rank <= 10
"""


def _near(spark, sf_dir, where):
    v = read(spark, sf_dir, "embeddings")
    q = v.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    found = search.nearest(q, v.withColumnRenamed("vec_id", "concept_id"), 10, where=where)
    return found.withColumn("distance", F.round("distance", 6))


@query(_near_sql("true"))
def nearest_vectors(spark, sf_dir):
    return _near(spark, sf_dir, None)


@query(_near_sql("c.label < 5"))
def nearest_vectors_where(spark, sf_dir):
    return _near(spark, sf_dir, "label < 5")


def _tokens(c: str = "embedding"):
    return F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice(F.col(c), i * 8 + 1, 8))


@query("""
WITH t AS (SELECT vec_id, i, list_transform(embedding[8 * i + 1 : 8 * i + 8], lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings, range(8) r(i)),
p AS (SELECT q.vec_id, q.i AS qi, d.i AS di, list_cosine_similarity(q.e, d.e) AS sim FROM t q JOIN t d ON d.vec_id = q.vec_id + 1),
a AS (SELECT vec_id, avg(m) AS x FROM (SELECT vec_id, qi, max(sim) AS m FROM p GROUP BY ALL) GROUP BY 1),
b AS (SELECT vec_id, avg(m) AS x FROM (SELECT vec_id, di, max(sim) AS m FROM p GROUP BY ALL) GROUP BY 1)
SELECT vec_id, round(0.5 * (a.x + b.x), 6) AS score FROM a JOIN b USING (vec_id)
""")
def late_interaction(spark, sf_dir):
    t = read(spark, sf_dir, "embeddings").select("vec_id", _tokens().alias("q"))
    d = t.select((F.col("vec_id") - 1).alias("vec_id"), F.col("q").alias("d"))
    return t.join(d, "vec_id").select("vec_id", F.round(search.max_similarity_column(F.col("q"), F.col("d")), 6).alias("score"))


@query("""
WITH t AS (SELECT vec_id, i, j, CAST(embedding[8 * i + j + 1] AS DOUBLE) AS x FROM embeddings, range(8) r(i), range(8) s(j) WHERE (vec_id + i) % 3 <> 0)
SELECT vec_id, j, round(avg(x), 6) AS mean FROM t GROUP BY ALL
""")
def mean_pooling(spark, sf_dir):
    mask = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: (F.col("vec_id") + i) % 3 != 0)
    pooled = search.mean_pooled(_tokens(), mask)
    return read(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(pooled).alias("j", "mean")).select("vec_id", F.col("j").cast("long").alias("j"), F.round("mean", 6).alias("mean"))


# ---- orders --------------------------------------------------------------------------------------------------------


def _ranked(df: DataFrame) -> DataFrame:
    return df.select("query_id", "concept_id", "retrieval_rank", "rank")


def _order_sql(keys: str, more: str = "") -> str:
    return f"WITH c AS ({CANDIDATES}){more} SELECT query_id, concept_id, retrieval_rank, CAST(row_number() OVER (PARTITION BY query_id ORDER BY {keys}, retrieval_rank) AS INTEGER) AS rank FROM c"


@query(_order_sql("_relevance_score DESC"))
def order_by_relevance(spark, sf_dir):
    return _ranked(ranking.by_relevance(candidates_of(spark, sf_dir)))


@query(f"""
WITH c AS ({CANDIDATES}), n AS (
  SELECT *, row_number() OVER w AS n, lag(_relevance_score) OVER w - _relevance_score AS gap FROM c WINDOW w AS (PARTITION BY query_id ORDER BY _relevance_score DESC, retrieval_rank)
), g AS (SELECT *, CASE WHEN n <= 4 THEN sum(CASE WHEN gap > 3 THEN 1 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY n) ELSE 4 + n END AS grp FROM n)
SELECT query_id, concept_id, retrieval_rank, CAST(row_number() OVER (PARTITION BY query_id ORDER BY grp, CASE WHEN n <= 4 THEN brand_score END DESC NULLS LAST, CASE WHEN n <= 4 THEN strength_sim END DESC NULLS LAST, CASE WHEN n <= 4 THEN release_score END DESC NULLS LAST, n) AS INTEGER) AS rank FROM g
""")
def order_by_near_ties(spark, sf_dir):
    return _ranked(ranking.by_near_ties(candidates_of(spark, sf_dir), eps=3.0, topn=4))


@query(_order_sql("_relevance_score DESC, brand_score DESC, strength_sim DESC, release_score DESC"))
def order_by_keys(spark, sf_dir):
    return _ranked(ranking.by_keys(candidates_of(spark, sf_dir)))


@query(_order_sql("brand_score DESC, final_score DESC, strength_sim DESC, jaccard_text DESC"))
def order_by_rules(spark, sf_dir):
    return _ranked(ranking.by_rules(candidates_of(spark, sf_dir)))


@query(f"""
WITH c AS ({CANDIDATES}), m AS (SELECT *, min(jaccard_text) OVER w AS lo, max(jaccard_text) OVER w AS hi FROM c WINDOW w AS (PARTITION BY query_id))
SELECT query_id, retrieval_rank, round(CASE WHEN hi - lo < 1e-12 THEN 0 ELSE (jaccard_text - lo) / (hi - lo) END, 9) AS scaled,
  round(pow(pow(greatest(strength_sim, 1e-12), 0.6) * pow(greatest(jaccard_text, 1e-12), 0.4), 1 / 1.0), 9) AS mean
FROM m
""")
def scaled_within_query(spark, sf_dir):
    from pyspark.sql import Window

    df = candidates_of(spark, sf_dir)
    scaled = ranking.minmax(F.col("jaccard_text"), Window.partitionBy("query_id"))
    mean = ranking.weighted_mean(F.col("strength_sim"), F.col("jaccard_text"), 0.6, 0.4)
    return df.select("query_id", "retrieval_rank", F.round(scaled, 9).alias("scaled"), F.round(mean, 9).alias("mean"))


# ---- scopes --------------------------------------------------------------------------------------------------------

SHEET = {"query_id": "s_suppkey", "atc_ids": "concat(CAST(s_nationkey AS STRING), ';', CAST(s_suppkey % 50 AS STRING), ';1.0')", "atc_codes": "concat('brand#', CAST(s_suppkey % 25 AS STRING))"}
ANCESTOR = {"ancestor_concept_id": "p_size", "descendant_concept_id": "p_partkey"}
_SCOPES = f"""
q AS ({sql("supplier", SHEET)}), c AS ({CONCEPTS}), e AS ({sql("part", ANCESTOR)}),
scopes AS (
  SELECT DISTINCT query_id, CAST(p AS BIGINT) AS ancestor FROM (SELECT query_id, unnest(string_split(atc_ids, ';')) AS p FROM q) WHERE regexp_full_match(p, '[0-9]+')
  UNION
  SELECT query_id, a FROM q JOIN (SELECT upper(trim(concept_code)) AS code, max(concept_id) AS a FROM c WHERE vocabulary_id = 'ATC' AND invalid_reason IS NULL GROUP BY 1) k ON k.code = upper(q.atc_codes)
), allowed AS (
  SELECT DISTINCT query_id, concept_id FROM scopes s JOIN e ON e.ancestor_concept_id = s.ancestor JOIN c ON c.concept_id = e.descendant_concept_id WHERE {VALID} AND domain_id = 'Drug'
)
"""


def _scopes(spark, sf_dir) -> DataFrame:
    return scope.scope_ids(derived(spark, sf_dir, "supplier", SHEET), concepts_of(spark, sf_dir))


@query(f"WITH {_SCOPES} SELECT query_id, ancestor FROM scopes")
def scope_nodes(spark, sf_dir):
    return _scopes(spark, sf_dir)


@query(f"WITH {_SCOPES} SELECT query_id, concept_id FROM allowed")
def scope_allowlist(spark, sf_dir):
    return scope.allowlist(_scopes(spark, sf_dir), derived(spark, sf_dir, "part", ANCESTOR), concepts_of(spark, sf_dir), most=0)


@query(f"""
WITH x AS ({CANDIDATES}), c AS (SELECT *, retrieval_rank AS rank FROM x), a AS (SELECT DISTINCT o_orderkey AS query_id, p_partkey AS concept_id FROM orders JOIN part ON p_size = o_orderkey % 50)
SELECT query_id, concept_id, retrieval_rank, concept_id IN (SELECT concept_id FROM a WHERE a.query_id = c.query_id) AS atc_match,
  CAST(row_number() OVER (PARTITION BY query_id ORDER BY concept_id IN (SELECT concept_id FROM a WHERE a.query_id = c.query_id) DESC, rank) AS INTEGER) AS rank FROM c
""")
def scoped_first(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("query_id"), (F.col("o_orderkey") % 50).alias("ancestor"))
    edges = read(spark, sf_dir, "part").select(F.col("p_size").cast("long").alias("ancestor"), F.col("p_partkey").alias("concept_id"))
    df = scope.scoped_first(candidates_of(spark, sf_dir).withColumn("rank", F.col("retrieval_rank")), o, edges=edges)
    return df.select("query_id", "concept_id", "retrieval_rank", "atc_match", "rank")


@query(f"WITH x AS ({CANDIDATES}), c AS ({CONCEPTS}) SELECT query_id, x.concept_id, retrieval_rank, concept_class_id FROM x LEFT JOIN c USING (concept_id) WHERE coalesce(trim(concept_class_id) NOT IN ('PROMO', 'LARGE'), true)")
def class_exclusion(spark, sf_dir):
    df = candidates_of(spark, sf_dir).select("query_id", "concept_id", "retrieval_rank")
    return scope.drop_classes(df, ["PROMO", "LARGE"], concepts_of(spark, sf_dir)).select("query_id", "concept_id", "retrieval_rank", "concept_class_id")


# ---- measures and model order ----------------------------------------------------------------------------------------

#: A sheet: answers are missing, no number, or a part of one of the order's lines.
GOLD = "CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 5 = 1 THEN 'x' ELSE CAST(gold AS {kind}) END"
_SHEET_SQL = f"SELECT o_orderkey AS query_id, concat('term ', o_orderkey) AS source_name, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE concat('C', o_orderkey % 1000) END AS source_code, {GOLD.format(kind='VARCHAR')} AS gold_concept_id FROM orders LEFT JOIN (SELECT query_id, max(concept_id) AS gold FROM c WHERE retrieval_rank <= 3 GROUP BY 1) g ON g.query_id = o_orderkey"


def _sheet(spark, sf_dir) -> DataFrame:
    g = candidates_of(spark, sf_dir).filter("retrieval_rank <= 3").groupBy("query_id").agg(F.max("concept_id").alias("gold"))
    o = read(spark, sf_dir, "orders").join(g, F.col("o_orderkey") == F.col("query_id"), "left")
    return o.select(F.col("o_orderkey").alias("query_id"), F.expr("concat('term ', o_orderkey)").alias("source_name"), F.expr("CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE concat('C', o_orderkey % 1000) END").alias("source_code"), F.expr(GOLD.format(kind="STRING")).alias("gold_concept_id"))


@query(
    f"WITH c AS ({CANDIDATES}), s AS ({_SHEET_SQL}), r AS (SELECT s.query_id, any_value(s.gold_concept_id) AS gold, min(CASE WHEN c.concept_id = TRY_CAST(s.gold_concept_id AS BIGINT) AND retrieval_rank <= 100 THEN retrieval_rank END) AS k, count(c.query_id) AS n FROM s LEFT JOIN c ON c.query_id = s.query_id GROUP BY 1), "
    "l AS (SELECT * FROM r WHERE gold IS NOT NULL) SELECT CAST((SELECT count(*) FROM r) AS DOUBLE) AS n_rows, (SELECT avg(CASE WHEN n > 0 THEN 1.0 ELSE 0 END) FROM r) AS coverage, CAST(count(*) AS DOUBLE) AS n_labeled, "
    + ", ".join(f'avg(CASE WHEN k <= {k} THEN 1.0 ELSE 0.0 END) AS "hit@{k}"' for k in metrics.CUTS)
    + ', sum(coalesce(1.0 / k, 0)) / count(*) AS "mrr@100" FROM l'
)
def evaluation(spark, sf_dir):
    return metrics.evaluate(_sheet(spark, sf_dir), candidates_of(spark, sf_dir).withColumn("rank", F.col("retrieval_rank")))


@query(f"""
WITH x AS ({CANDIDATES}), c AS (SELECT *, retrieval_rank AS rank FROM x),
a AS (SELECT query_id, concept_id, row_number() OVER (PARTITION BY query_id ORDER BY concept_id) - 1 AS pos FROM (SELECT DISTINCT query_id, concept_id FROM c WHERE concept_id % 2 = 0)),
f AS (SELECT c.*, a.pos, count(a.pos) OVER (PARTITION BY c.query_id) AS named, count(*) OVER (PARTITION BY c.query_id) AS n FROM c LEFT JOIN a USING (query_id, concept_id) WHERE rank <= 4),
m AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pos NULLS LAST, rank) AS rag_rank FROM f WHERE named > 0)
SELECT c.query_id, c.concept_id, c.retrieval_rank, CAST(m.rag_rank AS INTEGER) AS rag_rank, (m.n - m.rag_rank + 1) / m.n AS rag_score,
  CAST(row_number() OVER (PARTITION BY c.query_id ORDER BY coalesce(m.rag_rank, c.rank + 4), c.rank) AS INTEGER) AS rank
FROM c LEFT JOIN m USING (query_id, retrieval_rank)
""")
def model_order(spark, sf_dir):
    """Answers name the even ids of a query, in order, among its first four candidates."""
    c = candidates_of(spark, sf_dir).withColumn("rank", F.col("retrieval_rank"))
    answers = c.filter("concept_id % 2 = 0").groupBy("query_id").agg(F.array_sort(F.collect_set("concept_id")).alias("ids"))
    return model_rank.merge(c, answers, 4).select("query_id", "concept_id", "retrieval_rank", "rag_rank", "rag_score", "rank")


# ---- exports -------------------------------------------------------------------------------------------------------


@query(
    f"WITH c AS ({CANDIDATES}) SELECT o_orderkey AS query_id, o_orderpriority, "
    + ", ".join(f"max(CASE WHEN retrieval_rank = {i} THEN {c} END) AS top{i}_{n}" for i in (1, 2, 3) for n, c in (("concept_id", "concept_id"), ("score", "final_score")))
    + " FROM orders LEFT JOIN c ON c.query_id = o_orderkey GROUP BY ALL"
)
def candidates_beside_input(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("query_id"), "o_orderpriority")
    return exports.beside_input(rows, candidates_of(spark, sf_dir).withColumn("rank", F.col("retrieval_rank")), 3)


@query(f"""
WITH x AS ({CANDIDATES}), c AS (SELECT * FROM x WHERE retrieval_rank <= 3), s AS ({_SHEET_SQL}),
n AS (SELECT concept_id, arg_min(name, (query_id, retrieval_rank)) AS concept_name FROM (SELECT x.*, concat('n', x.supplier) AS name FROM x) GROUP BY 1),
g AS (SELECT query_id, source_name, CASE WHEN source_code = '' THEN concat('row', query_id) ELSE source_code END AS source_code, TRY_CAST(gold_concept_id AS BIGINT) AS gold FROM s),
k AS (SELECT g.query_id, min(CASE WHEN c.concept_id = gold THEN retrieval_rank END) AS gold_rank FROM g LEFT JOIN c USING (query_id) GROUP BY 1),
b AS (SELECT g.*, gold_rank, row_number() OVER (ORDER BY gold_rank NULLS LAST, source_code, query_id) AS block FROM g JOIN k USING (query_id)),
cells AS (SELECT b.*, CAST(r AS INTEGER) AS rank FROM b, range(1, 4) t(r))
SELECT block, rank, CAST(gold_rank AS INTEGER) AS gold_rank, source_name, source_code, CASE WHEN c.concept_id = gold THEN 'X' ELSE '' END AS flag, coalesce(n.concept_name, '') AS concept_name, c.concept_id
FROM cells LEFT JOIN c ON c.query_id = cells.query_id AND c.retrieval_rank = cells.rank LEFT JOIN n ON n.concept_id = c.concept_id
""")
def result_blocks(spark, sf_dir):
    c = candidates_of(spark, sf_dir).withColumn("rank", F.col("retrieval_rank")).withColumn("concept_name", F.concat(F.lit("n"), F.col("supplier").cast("string")))
    return exports.block_cells(_sheet(spark, sf_dir), c, 3)


@query(f"WITH c AS ({CANDIDATES}) SELECT concept_id, arg_min(concat('n', supplier), (query_id, retrieval_rank)) AS concept_name FROM c GROUP BY 1")
def first_names(spark, sf_dir):
    c = candidates_of(spark, sf_dir).withColumn("concept_name", F.concat(F.lit("n"), F.col("supplier").cast("string")))
    return exports.first_names(c.withColumn("rank", F.col("retrieval_rank")))


@query(f"""
WITH x AS ({CANDIDATES}), b AS (SELECT * FROM x WHERE retrieval_rank = 1)
SELECT o_orderkey AS query_id, CASE WHEN o_orderkey % 3 = 0 THEN concat('ROW_', CASE WHEN o_orderkey + 1 < 100000 THEN lpad(CAST(o_orderkey + 1 AS VARCHAR), 5, '0') ELSE CAST(o_orderkey + 1 AS VARCHAR) END) ELSE o_orderpriority END AS code,
  CASE WHEN o_orderkey % 4 = 0 THEN concat('Query ', o_orderkey + 1) ELSE concat('t', o_custkey) END AS name,
  concept_id, coalesce(final_score, 0) AS score, 'UNCHECKED' AS status, 'MAPS_TO' AS mapping FROM orders LEFT JOIN b ON b.query_id = o_orderkey
""")
def review_rows(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("query_id"), F.expr("CASE WHEN o_orderkey % 3 = 0 THEN ' ' ELSE o_orderpriority END").alias("sourceCode"), F.expr("CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE concat('t', o_custkey) END").alias("sourceName"))
    best = candidates_of(spark, sf_dir).filter("retrieval_rank = 1").withColumns({"concept_name": F.lit("n"), "domain_id": F.lit(None).cast("string")})
    got = usagi.with_best(usagi.review_rows(o), best)
    return got.select("query_id", F.col("sourceCode").alias("code"), F.col("sourceName").alias("name"), F.col("conceptId").alias("concept_id"), F.col("matchScore").alias("score"), F.col("mappingStatus").alias("status"), F.col("mappingType").alias("mapping"))


# ---- end to end -----------------------------------------------------------------------------------------------------


class Letters:
    """An encoder that SQL can express: how often each letter occurs."""

    def __call__(self, texts: list[str]) -> np.ndarray:
        return np.array([[t.count(c) for c in ascii_lowercase] for t in texts], np.float32).reshape(len(texts), 26)


class LetterTokens:
    """As Letters, for each word."""

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        return [Letters()(t.split()) for t in texts]


ASKED = _term("s_suppkey", "concat('red ', CASE WHEN s_suppkey % 3 = 0 THEN 'Widget' ELSE 'gear' END)", "(s_suppkey % 50 + 1)", "concat('Brand#', CAST(s_suppkey % 25 + 1 AS STRING))")
_COUNTED = "list_transform(range(97, 123), lambda c: CAST(len({0}) - len(replace({0}, chr(CAST(c AS INTEGER)), '')) AS DOUBLE))"


@query(f"""
WITH a AS ({sql("supplier", ASKED)}), c AS ({sql("part", TERM)}),
t AS (SELECT -concept_id - 1 AS concept_id, name, brand, n, k, lower(term) AS term FROM a UNION ALL SELECT concept_id, name, brand, n, k, lower(term) FROM c),
v AS (SELECT concept_id, term, {_COUNTED.format("term")} AS e FROM t),
near AS (
  SELECT q, d, row_number() OVER (PARTITION BY q ORDER BY sim DESC, d) AS place
  FROM (SELECT q.concept_id AS q, d.concept_id AS d, round(list_cosine_similarity(q.e, d.e), 12) AS sim FROM v q JOIN v d ON q.concept_id < 0 AND d.concept_id >= 0) x QUALIFY place <= 20
), words AS (SELECT concept_id, unnest(string_split(term, ' ')) AS word, generate_subscripts(string_split(term, ' '), 1) AS i FROM t),
counted AS (SELECT word, {_COUNTED.format("word")} AS e FROM (SELECT DISTINCT word FROM words) x),
alike AS (SELECT a.word AS a, b.word AS b, CASE WHEN list_sum(a.e) = 0 OR list_sum(b.e) = 0 THEN 0 ELSE list_cosine_similarity(a.e, b.e) END AS sim FROM counted a, counted b),
late AS (
  SELECT q, d, place, qi, di, sim FROM (SELECT near.q, near.d, place, x.word AS a, x.i AS qi, y.word AS b, y.i AS di FROM near JOIN words x ON x.concept_id = near.q JOIN words y ON y.concept_id = near.d) z JOIN alike USING (a, b)
), scored AS (
  SELECT q, d, place, CAST(0.5 * (x + y) AS FLOAT) AS relevance FROM (SELECT q, d, place, avg(m) AS x FROM (SELECT q, d, place, qi, max(sim) AS m FROM late GROUP BY ALL) o GROUP BY ALL) o
  JOIN (SELECT q, d, avg(m) AS y FROM (SELECT q, d, di, max(sim) AS m FROM late GROUP BY ALL) o GROUP BY ALL) r USING (q, d)
), best AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY relevance DESC, place) AS retrieval FROM scored QUALIFY retrieval <= 10),
pairs AS (SELECT q, d FROM best), {_features_sql(True)},
r AS (
  SELECT f.*, CAST(relevance AS DOUBLE) AS relevance, retrieval, CASE WHEN strength_sim >= 0.99 AND filled THEN 1 ELSE 0 END AS exact FROM f JOIN best USING (q, d)
), o AS (
  SELECT *, CASE WHEN exact = 1 AND form_route_score < 0 THEN form_route_score + 0.5 ELSE form_route_score END AS route FROM r
), kept AS (
  SELECT * FROM o WHERE q_k <> 6 OR brand_score >= 0 OR NOT EXISTS (SELECT 1 FROM o x WHERE x.q = o.q AND x.brand_score >= 0)
), numbered AS (
  SELECT *, row_number() OVER w AS n, lag(relevance) OVER w - relevance AS gap, CASE WHEN brand_score > 0 AND exact = 1 THEN 1 ELSE 0 END AS brand_exact, CASE WHEN exact = 1 AND route >= 0.5 THEN 1 ELSE 0 END AS form_exact
  FROM kept WINDOW w AS (PARTITION BY q ORDER BY relevance DESC, retrieval)
), grouped AS (SELECT *, sum(CASE WHEN gap > 0.01 THEN 1 ELSE 0 END) OVER (PARTITION BY q ORDER BY n) AS grp FROM numbered)
SELECT -q - 1 AS query_id, d AS concept_id, CAST(row_number() OVER (PARTITION BY q ORDER BY grp, brand_exact DESC, form_exact DESC, brand_score DESC, exact DESC, strength_sim DESC, route DESC, release_score DESC, relevance DESC, n) AS INTEGER) AS rank,
  round(relevance, 5) AS final_score, round(strength_sim, 9) AS strength_sim, round(jaccard_text, 6) AS jaccard_text, brand_score, route AS form_route_score
FROM grouped
""")
def mapped_terms(spark, sf_dir):
    """Source terms against concepts: encoding, search, late interaction, features, brands that have to agree, near-tie order."""
    c = derived(spark, sf_dir, "part", TERM).selectExpr("concept_id", "lower(term) AS concept_name", "lower(term) AS profile_text")
    sheet = derived(spark, sf_dir, "supplier", ASKED).selectExpr("term AS sourceName", "concept_id AS key").orderBy("key").coalesce(1)
    o = mapping.Options(candidate_topk=10, retrieval_topk=20, brand_strict=True, code_column=None)
    got = mapping.map_terms(spark, sheet, encoded(c, "profile_text", Letters()), "vector", o, Letters(), LetterTokens())
    return got.candidates.select("query_id", "concept_id", "rank", F.round("final_score", 5).alias("final_score"), F.round("strength_sim", 9).alias("strength_sim"), F.round("jaccard_text", 6).alias("jaccard_text"), "brand_score", "form_route_score")
