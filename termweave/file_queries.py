"""Queries that go through files, sheets, prompts and command defaults, each with the SQL that checks it."""

from __future__ import annotations

import json
import re
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import forms, prompts, text
from .functions.lexicon import USAN_OF_INN, USAN_OF_INN_OPTIONAL
from .operators import metrics, model_rank, profiles, ranking
from .plans import build, mapping
from .queries import ASKED, CANDIDATE, CONCEPT, NORM, TERM, VALID, Letters, LetterTokens, candidates_of, concepts_of, derived, query, read, sql
from .sources import exports, files, usagi
from .sources.encoders import encoded

CONCEPTS = sql("part", CONCEPT)


# ---- index ---------------------------------------------------------------------------------------------------------


@query(f"""
WITH c AS (SELECT concept_id, {NORM.format("concept_name")} AS name, {NORM.format("concept_code")} AS code, vocabulary_id FROM ({CONCEPTS}) c WHERE {VALID} AND domain_id IN ('Drug') AND concept_class_id NOT IN ('Gene DNA Variant', 'Gene Protein Variant', 'Gene RNA Variant', 'Variant'))
SELECT concept_id, concat_ws(' | ', name, code) AS profile_text, vocabulary_id, 26 AS dim, (SELECT count(*) FROM c) AS manifest_count, 'Drug' AS manifest_domains, 'vector' AS vector_column, 'mean' AS pooling, 64 AS max_length FROM c
""")
def index_round_trip(spark, sf_dir):
    """An index built without a table of profiles, read back with its manifest and the settings that come from it."""
    source, out = files.shared_folder(spark, "vocabulary"), files.shared_folder(spark, "index")
    concepts_of(spark, sf_dir).write.parquet(f"{source}/concept.parquet")
    build.build_index(spark, source, out, "drugs", encode=Letters(), domains="Drug, ,", extra=["vocabulary_id"], with_code=True, pooling="mean", max_length=64)
    df, vector = files.read_index(spark, out, "drugs")
    manifest = files.read_manifest(spark, out, "drugs")
    settings = files.encoder_settings(manifest, max_length=64)
    told = {"manifest_count": manifest["count"], "manifest_domains": ",".join(manifest["domain_id"]), "vector_column": vector, "pooling": settings["pooling"], "max_length": settings["max_length"]}
    return df.select("concept_id", "profile_text", "vocabulary_id", F.size(vector).alias("dim"), *[F.lit(v).cast("long" if k == "manifest_count" else "int" if k == "max_length" else "string").alias(k) for k, v in told.items()])


_NAMED = CONCEPT | {"concept_name": "CASE WHEN p_partkey % 9 = 0 THEN '  ' ELSE p_name END", "concept_code": "CASE WHEN p_partkey % 2 = 0 THEN NULL ELSE p_brand END", "concept_class_id": "CASE WHEN p_partkey % 4 = 0 THEN 'O''Class' WHEN p_partkey % 4 = 1 THEN 'Variant' ELSE p_type END"}


@query(f"""
WITH c AS (SELECT *, concat_ws(' | ', nullif({NORM.format("concept_name")}, ''), nullif({NORM.format("coalesce(concept_code, '')")}, '')) AS profile_text FROM ({sql("part", _NAMED)}) c WHERE {VALID} AND concept_class_id IN ('O''Class', 'Variant', 'PROMO') AND concept_class_id NOT IN ('Variant'))
SELECT concept_id, concept_class_id, profile_text FROM c WHERE profile_text <> ''
""")
def profile_classes(spark, sf_dir):
    """Profiles of some classes, one with a quote in its name; those without any text go."""
    got = profiles.compose_profiles(derived(spark, sf_dir, "part", _NAMED), None, (), profiles.values(["O'Class, Variant", "PROMO"]), max_synonyms=0, with_code=True)
    return got.select("concept_id", "concept_class_id", "profile_text")


# ---- sheets --------------------------------------------------------------------------------------------------------

SHEET = {"sourceName": "CASE WHEN p_partkey % 5 = 0 THEN concat(p_name, ', \"', p_brand, '\"') ELSE p_name END", "sourceCode": "concat('C', CAST(p_partkey % 17 AS STRING))", "n": "p_size"}
_FORMATS = ("csv", "tsv", "parquet", "txt", "tab")


@query(" UNION ALL ".join(f"SELECT '{f}' AS format, CAST(row_number() OVER (ORDER BY p_partkey) - 1 AS BIGINT) AS query_id, name, code, n FROM (SELECT p_partkey, {SHEET['sourceName']} AS name, {SHEET['sourceCode']} AS code, {SHEET['n']} AS n FROM part) x{' QUALIFY query_id < 70' if f == 'tab' else ''}" for f in _FORMATS))
def sheet_formats(spark, sf_dir):
    """A sheet in each format, read by its suffix and numbered in file order; of one format, the first rows only."""
    folder = files.shared_folder(spark, "sheets")
    sheet = derived(spark, sf_dir, "part", SHEET | {"at": "p_partkey"}).orderBy("at").coalesce(1).drop("at")
    out = None
    for f in _FORMATS:
        path = f"{folder}/sheet.{f}"
        if f == "parquet":
            sheet.write.parquet(path)
        else:
            sheet.write.csv(path, header=True, sep="\t" if f in ("tsv", "tab") else ",", escape='"')
        df = files.numbered(files.read_sheet(spark, path), "query_id", 70 if f == "tab" else 0)
        df = df.select(F.lit(f).alias("format"), "query_id", F.col("sourceName").alias("name"), F.col("sourceCode").alias("code"), F.col("n").cast("int").alias("n"))
        out = df if out is None else out.unionByName(df)
    return out


_REVIEW = {"query_id": "o_orderkey", "sourceCode": "CASE o_orderkey % 6 WHEN 0 THEN ' ' WHEN 1 THEN NULL ELSE o_orderpriority END", "sourceName": "CASE o_orderkey % 5 WHEN 0 THEN '' ELSE concat('t', CAST(o_custkey AS STRING)) END", "matchScore": "CASE o_orderkey % 4 WHEN 0 THEN 'x1' WHEN 1 THEN '' WHEN 2 THEN ' 0.5 ' ELSE NULL END", "mappingStatus": "'UNCHECKED'"}


@query(f"""
SELECT * FROM (SELECT query_id, CASE WHEN trim(coalesce(sourceCode, '')) = '' THEN 'sourceCode is empty' WHEN trim(coalesce(sourceName, '')) = '' THEN 'sourceName is empty' WHEN trim(matchScore) <> '' AND TRY_CAST(trim(matchScore) AS DOUBLE) IS NULL THEN 'matchScore is no number' END AS reason, true AS is_review, false AS others_are
FROM ({sql("orders", _REVIEW)}) x) y WHERE reason IS NOT NULL
""")
def review_checks(spark, sf_dir):
    """Which rows of a review sheet are invalid, and why; what counts as a review sheet."""
    df = derived(spark, sf_dir, "orders", _REVIEW)
    told = [F.lit(usagi.is_review_sheet(c)).alias(n) for n, c in (("is_review", df.columns), ("others_are", df.columns[:-1]))]
    return usagi.invalid_rows(df).select("query_id", "reason", *told)


_TERMS = {"sourceName": "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE concat(' Term ', CAST(o_custkey AS STRING), '5mg ') END", "sourceCode": "CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE concat('C', CAST(o_orderkey % 9 AS STRING)) END", "label": "CASE o_orderkey % 4 WHEN 0 THEN ' ' WHEN 1 THEN NULL WHEN 2 THEN ' 12 ' ELSE 'x' END", "mappingStatus": "CASE o_orderkey % 3 WHEN 0 THEN 'approved ' WHEN 1 THEN 'APPROVED' ELSE 'UNCHECKED' END", "conceptId": "o_custkey", "place": "o_orderkey"}


@query(f"""
WITH x AS (SELECT *, CAST(row_number() OVER (ORDER BY place) - 1 AS BIGINT) AS query_id FROM ({sql("orders", _TERMS)}) o),
t AS (SELECT *, trim(coalesce(sourceName, '')) AS name, trim(coalesce(sourceCode, '')) AS code FROM x),
q AS (SELECT *, CASE WHEN name = '' OR code = '' THEN name ELSE concat(name, ' (', code, ')') END AS query_text FROM t)
SELECT query_id, query_text, lower(regexp_replace(query_text, '([0-9])(mg)\\b', '\\1 \\2', 'g')) AS query_norm, nullif(code, '') AS source_code,
  CASE WHEN trim(coalesce(label, '')) <> '' THEN trim(label) WHEN upper(trim(mappingStatus)) = 'APPROVED' THEN CAST(conceptId AS VARCHAR) END AS gold_concept_id FROM q
""".replace("\\\\", "\\"))
def gold_choice(spark, sf_dir):
    """The queries of a sheet: text with code, as searched, and the answer from its label or an approved mapping."""
    sheet = derived(spark, sf_dir, "orders", _TERMS).orderBy("place").coalesce(1)
    got = mapping.queries_of(sheet, mapping.Options(label_column="label"))
    return got.select("query_id", "query_text", "query_norm", "source_code", "gold_concept_id")


@query(f"""
WITH x AS (SELECT *, CAST(row_number() OVER (ORDER BY s_suppkey) - 1 AS BIGINT) AS query_id FROM supplier)
SELECT query_id, CASE WHEN s_suppkey % 4 = 0 THEN 0 ELSE 7 END AS candidates, CASE WHEN s_suppkey % 4 = 0 THEN 'a text query is required' END AS message, CASE WHEN s_suppkey % 4 = 0 THEN 'search' END AS type,
  CASE WHEN s_suppkey % 4 <> 0 THEN 'concept_id,concept_name,profile_text' END AS kept FROM x
""")
def empty_terms(spark, sf_dir):
    """Empty terms have no candidates and an error; others have as many as asked for, with the columns that go on to ranking."""
    index = encoded(derived(spark, sf_dir, "part", TERM).selectExpr("concept_id", "lower(term) AS concept_name", "lower(term) AS profile_text", "n AS beside"), "profile_text", Letters())
    sheet = derived(spark, sf_dir, "supplier", {"sourceName": f"CASE WHEN s_suppkey % 4 = 0 THEN ' ' ELSE {ASKED['term']} END", "at": "s_suppkey"}).orderBy("at").coalesce(1)
    got = mapping.map_terms(spark, sheet, index, "vector", mapping.Options(candidate_topk=7, retrieval_topk=9, code_column=None, post_mode="blend", post_weight=0.0), Letters(), LetterTokens())
    kept = ",".join(c for c in got.candidates.columns if c in {*mapping.KEPT, "beside"} - {"_relevance_score"})
    n = got.candidates.groupBy("query_id").agg(F.count("*").cast("int").alias("n"), F.lit(kept).alias("kept"))
    df = got.queries.select("query_id").join(n, "query_id", "left").join(got.errors.select(F.col("index").alias("query_id"), "message", "type"), "query_id", "left")
    return df.select("query_id", F.coalesce("n", F.lit(0)).alias("candidates"), "message", "type", "kept")


# ---- orders and styles ---------------------------------------------------------------------------------------------

_SCORED = CANDIDATE | {"score": "CASE WHEN l_linenumber = 2 THEN NULL WHEN l_linenumber = 3 THEN CAST('NaN' AS DOUBLE) ELSE l_quantity END"}


@query(f"""
WITH c AS (SELECT query_id, concept_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY line, concept_id, supplier, jaccard_text) AS INTEGER) AS retrieval_rank FROM ({sql("lineitem", _SCORED)}) x),
n AS (SELECT *, CASE WHEN isnan(score) THEN NULL ELSE score END AS s FROM c)
SELECT query_id, concept_id, retrieval_rank, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s DESC NULLS LAST, retrieval_rank) AS INTEGER) AS rank, coalesce(s, 0) AS final_score FROM n
""")
def plain_order(spark, sf_dir):
    """The order without features: by score, where there is no relevance; no number counts last and as 0. Blending of weight 0 means this."""
    df = derived(spark, sf_dir, "lineitem", _SCORED).drop("_relevance_score", "final_score")
    df = df.withColumn("retrieval_rank", F.expr("CAST(row_number() OVER (PARTITION BY query_id ORDER BY line, concept_id, supplier, jaccard_text) AS INT)"))
    if ranking.applies("blend", 0.0) or not ranking.applies("tiebreak", 0.0):
        raise ValueError("blending without a weight asks for features")
    return ranking.plain(df).select("query_id", "concept_id", "retrieval_rank", "rank", "final_score")


#: By k: form, release, its abbreviation, the label of both, whether it is enteric, whether the release is modified.
_STYLES = (
    (0, "oral_tablet", None, None, "tablet", False, False), (1, "oral_solution", None, None, "oral solution", False, False), (3, "oral_capsule", "extended_release", "ER", "extended-release capsule", False, True),
    (4, "oral_tablet", "gastro_resistant", "DR", "delayed-release (enteric-coated) tablet", True, True), (5, "nasal_spray", None, None, "nasal spray", False, False), (9, "oral_tablet", None, None, "tablet", False, False),
    (10, "ophthalmic_solution", "delayed_release", "DR", "delayed-release ophthalmic solution", False, True),
)


@query(f"""
WITH t AS ({sql("part", TERM)}), v(k, form, release, abbr, label, enteric, modified) AS (VALUES {", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in _STYLES)})
SELECT concept_id, regexp_replace(term, '\\[[^\\[\\]]+\\]', ' ', 'g') AS input, form AS canonical_dosage_form, release AS canonical_release, abbr AS us_release_abbr, label AS us_combined_label, coalesce(enteric, false) AS enteric_or_gastro_resistant, coalesce(modified, false) AS modified_release
FROM t LEFT JOIN v USING (k)
""".replace("\\\\", "\\"))
def us_styles(spark, sf_dir):
    return derived(spark, sf_dir, "part", TERM).select("concept_id", forms.us_style(F.col("term"), True).alias("s")).select("concept_id", "s.*")


_EVERY_NAME = USAN_OF_INN | USAN_OF_INN_OPTIONAL


def _any_name(pick: str) -> str:
    return "concat('Oral ', CASE p_partkey % 80 " + " ".join(f"WHEN {i} THEN '{n.upper()}'" for i, n in enumerate([*USAN_OF_INN_OPTIONAL, *list(USAN_OF_INN)[:60]])) + f" ELSE 'none' END, ' {pick}')"


def _replaced(names: dict[str, str]) -> str:
    out = "t"
    for name, usan in names.items():
        out = rf"regexp_replace({out}, '(?i)\b{re.escape(name)}\b', '{usan}', 'g')"
    return out


@query(rf"SELECT id, lower(regexp_replace({_replaced(_EVERY_NAME)}, '([0-9])(ml)\b', '\1 \2', 'g')) AS query_norm FROM (SELECT p_partkey AS id, {_any_name('5ml')} AS t FROM part) x")
def all_names(spark, sf_dir):
    """Queries prepared with both lists of drug names."""
    return derived(spark, sf_dir, "part", {"id": "p_partkey", "t": _any_name("5ml")}).select("id", text.prepared_query(F.col("t"), optional_usan=True).alias("query_norm"))


# ---- exports -------------------------------------------------------------------------------------------------------

#: A sheet of suppliers, whose candidates are their lines.
_SUPPLIER = {"query_id": "s_suppkey", "source_name": "concat('term ', CAST(s_suppkey AS STRING))", "source_code": "CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE concat('C', CAST(s_suppkey % 7 AS STRING)) END", "gold_concept_id": "CASE s_suppkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 'x' ELSE CAST(s_suppkey AS STRING) END", "concept_name": "CAST(NULL AS STRING)"}
_LINES = {"query_id": "l_suppkey", "concept_id": "l_partkey", "concept_name": "concat('n', CAST(l_partkey AS STRING))", "domain_id": "'Drug'", "final_score": "l_quantity / 50", "a": "l_orderkey", "b": "l_linenumber", "c": "l_extendedprice"}
_RANK = "CAST(row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, a, b, c, concept_id) AS {})"


def _suppliers(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    c = derived(spark, sf_dir, "lineitem", _LINES).withColumn("rank", F.expr(_RANK.format("INT"))).filter("rank <= 3").drop("a", "b", "c")
    best = c.filter("rank = 2").select("query_id", F.col("concept_id").cast("string").alias("second"))
    rows = derived(spark, sf_dir, "supplier", _SUPPLIER).drop("concept_name").join(best, "query_id", "left")
    return rows.withColumn("gold_concept_id", F.when(F.col("query_id") % 3 == 2, F.col("second")).otherwise(F.col("gold_concept_id"))).drop("second"), c


_SUPPLIERS_SQL = f"""
c AS (SELECT * FROM (SELECT *, {_RANK.format("INTEGER")} AS rank FROM ({sql("lineitem", _LINES)}) x) y WHERE rank <= 3),
s AS (SELECT q.* EXCLUDE (concept_name, second) REPLACE (CASE WHEN query_id % 3 = 2 THEN second ELSE gold_concept_id END AS gold_concept_id) FROM (SELECT x.*, CAST(c.concept_id AS VARCHAR) AS second FROM ({sql("supplier", _SUPPLIER)}) x LEFT JOIN c ON c.query_id = x.query_id AND c.rank = 2) q)
"""


@query(f"""
WITH {_SUPPLIERS_SQL}, g AS (SELECT s.*, CASE WHEN source_code = '' THEN concat('row', query_id) ELSE source_code END AS code, TRY_CAST(gold_concept_id AS BIGINT) AS gold FROM s),
k AS (SELECT g.query_id, min(CASE WHEN c.concept_id = gold THEN rank END) AS gold_rank FROM g LEFT JOIN c USING (query_id) GROUP BY 1),
b AS (SELECT g.*, gold_rank, row_number() OVER (ORDER BY gold_rank NULLS LAST, code, query_id) AS block FROM g JOIN k USING (query_id)),
cells AS (SELECT b.*, r, c.concept_id, c.concept_name FROM b JOIN range(1, 4) t(r) ON true LEFT JOIN c ON c.query_id = b.query_id AND c.rank = r)
SELECT 0 AS line, concat('rank,', string_agg(concat(coalesce(CAST(gold_rank AS VARCHAR), 'unmatched'), ',', source_name, ',', code), ',' ORDER BY block)) AS text FROM b
UNION ALL SELECT r, concat(r, ',', string_agg(concat(CASE WHEN concept_id = gold THEN 'X' ELSE '' END, ',', coalesce(concept_name, ''), ',', coalesce(CAST(concept_id AS VARCHAR), '')), ',' ORDER BY block)) FROM cells GROUP BY r
""")
def blocks_file(spark, sf_dir):
    """The sheet of blocks side by side, as its lines."""
    rows, c = _suppliers(spark, sf_dir)
    path = f"{files.shared_folder(spark, 'blocks')}/results.csv"
    exports.write_blocks(files.written(exports.block_cells(rows, c, 3), "cells"), path)
    return files.numbered(spark.read.text(path), "line").select("line", F.col("value").alias("text"))


class Answers:
    """A model that answers by a rule: the candidates' ids from the last to the first, or what cannot be read."""

    def __call__(self, prompt: str) -> str:
        ids = re.findall(r"\((\d+)\)", prompt)
        if len(ids) < 3:
            return "no answer"
        return "```json\n{\"concept_ids\": [" + ", ".join(reversed(ids)) + "]}\n```"


def _file_lines(spark, path: str, kind: str) -> DataFrame:
    return files.numbered(spark.read.text(path), "line").select(F.lit(kind).alias("kind"), "line", F.col("value").alias("text"))


_FIRST = ", ".join(f"max(CASE WHEN rank = {i} THEN {c} END) AS {n}{i}" for i in (1, 2) for n, c in (("i", "concept_id"), ("n", "concept_name"), ("s", "final_score"), ("d", "domain_id")))
_SHOWN = "coalesce(CAST({} AS VARCHAR), '')"


@query(f"""
WITH {_SUPPLIERS_SQL}, w AS (SELECT query_id, {_FIRST}, count(*) AS n FROM c GROUP BY 1), j AS (SELECT s.*, w.* EXCLUDE (query_id), row_number() OVER (ORDER BY s.query_id) AS line FROM s LEFT JOIN w ON w.query_id = s.query_id),
m AS (SELECT min(CASE WHEN c.concept_id = TRY_CAST(gold_concept_id AS BIGINT) THEN rank END) AS k, any_value(gold_concept_id) AS gold FROM s LEFT JOIN c ON c.query_id = s.query_id GROUP BY s.query_id)
SELECT 'with_input' AS kind, 0 AS line, 'source_name,top1_concept_id,top1_concept_name,top1_score,top1_domain_id,top2_concept_id,top2_concept_name,top2_score,top2_domain_id' AS text
UNION ALL SELECT 'with_input', line, concat(source_name, ',', {", ',', ".join(_SHOWN.format(f"{c}{i}") for i in (1, 2) for c in "insd")}) FROM j
UNION ALL SELECT 'usagi', 0, '{",".join(usagi.COLUMNS)}'
UNION ALL SELECT 'usagi', line, concat(CASE WHEN source_code = '' THEN concat('ROW_', CASE WHEN query_id + 1 < 100000 THEN lpad(CAST(query_id + 1 AS VARCHAR), 5, '0') ELSE CAST(query_id + 1 AS VARCHAR) END) ELSE source_code END, ',', source_name, ',,,', coalesce(CAST(s1 AS VARCHAR), '0.0'), ',UNCHECKED,EQUIVALENT,termweave,,', {_SHOWN.format("i1")}, ',', {_SHOWN.format("n1")}, ',', {_SHOWN.format("d1")}, ',MAPS_TO,,,,') FROM j
UNION ALL SELECT 'errors', 0, 'index,type,source_name,source_code,message'
UNION ALL SELECT 'errors', row_number() OVER (ORDER BY query_id), concat(query_id, ',rag,', source_name, ',', source_code, ',no JSON in the answer: ''no answer''') FROM j WHERE n < 3
UNION ALL SELECT 'prompts', row_number() OVER (ORDER BY query_id), concat('## Row ', query_id) FROM j WHERE n > 0
UNION ALL SELECT 'metrics', 0, concat('hit@2=', round(avg(CASE WHEN k <= 2 THEN 1.0 ELSE 0.0 END), 9), ' n_labeled=', count(*)) FROM m WHERE gold IS NOT NULL
""")
def export_files(spark, sf_dir):
    """All files of a run, read back: candidates beside the input, review sheet, measures, log of prompts, errors."""
    rows, c = _suppliers(spark, sf_dir)
    rows = rows.withColumn("query_norm", F.col("source_name"))
    answers = files.written(model_rank.ask(c, rows, Answers(), 3), "answers")
    errors = answers.filter("error IS NOT NULL").join(rows, "query_id").select(F.col("query_id").alias("index"), F.lit("rag").alias("type"), "source_name", "source_code", F.col("error").alias("message"))
    review = usagi.review_rows(rows.select("query_id", "source_name", "source_code"), name_col="source_name", code_col="source_code").drop("source_name", "source_code")
    folder = files.shared_folder(spark, "exports")
    out = exports.write_all(folder, rows, c, review, metrics.evaluate(rows, c, 3), answers, errors, 2, input_columns=["source_name"])
    measured = json.loads(files.file_text(spark, out["metrics"]))
    got = [_file_lines(spark, out[k], k) for k in ("with_input", "usagi", "errors")]
    log = files.numbered(spark.read.text(out["prompts"]).filter("value LIKE '## Row %'"), "line").select(F.lit("prompts").alias("kind"), (F.col("line") + 1).alias("line"), F.col("value").alias("text"))
    told = spark.createDataFrame([("metrics", 0, f"hit@2={round(measured['hit@2'], 9)} n_labeled={int(measured['n_labeled'])}")], "kind string, line long, text string")
    df = told.unionByName(log)
    for x in got:
        df = df.unionByName(x)
    return df


# ---- prompts -------------------------------------------------------------------------------------------------------

_FILE_TEMPLATE = "Q: {source}\nC: {candidates}\nX: {extra_context}\n{format_instructions}"


def _quoted(t: str) -> str:
    return "'" + t.replace("'", "''") + "'"


_LIST = "string_agg(concat(concept_name, ' (', concept_id, ') | final_score=', printf('%.4f', final_score)), chr(10) ORDER BY rank)"
_CUT = "string_agg(concat(CASE WHEN length(concept_name) > 4 THEN concat(concept_name[1:4], ' …') ELSE concept_name END, ' (', concept_id, ')'), chr(10) ORDER BY rank)"


@query(f"""
WITH {_SUPPLIERS_SQL}, a AS (SELECT s.query_id, source_name, s.source_code AS context, {_LIST} AS list, {_CUT} AS cut, list(c.concept_id ORDER BY rank DESC) AS ids, count(*) AS n FROM s JOIN c USING (query_id) GROUP BY ALL),
p AS (
  SELECT *, replace(replace(replace({_quoted(prompts.TEMPLATE.strip())}, '{{source}}', source_name), '{{candidates}}', CASE WHEN context = '' THEN list ELSE concat('Additional context: ', context, chr(10), chr(10), list) END), '{{format_instructions}}', {_quoted(prompts.FORMAT)}) AS own,
    replace(replace(replace(replace({_quoted(_FILE_TEMPLATE)}, '{{source}}', source_name), '{{candidates}}', cut), '{{format_instructions}}', 'JSON'), '{{extra_context}}', context) AS filed FROM a
)
SELECT query_id, kind, prompt, CASE WHEN n < 3 THEN NULL ELSE array_to_string(ids, ',') END AS ids, CASE WHEN n < 3 THEN 'no JSON in the answer: ''no answer''' END AS error
FROM (SELECT query_id, 'own' AS kind, own AS prompt, ids, n FROM p UNION ALL SELECT query_id, 'file', filed, ids, n FROM p) x
""")
def model_prompts(spark, sf_dir):
    """Prompts for the candidates of each query, by the template of this package and by one of a file; answers, and those that cannot be read."""
    rows, c = _suppliers(spark, sf_dir)
    rows = rows.withColumn("query_norm", F.col("source_name"))
    builds = {"own": partial(prompts.prompt, scores=("final_score",)), "file": partial(prompts.template_prompt, _FILE_TEMPLATE, field="concept_name", limit=4, instructions="JSON")}
    out = None
    for kind, made in builds.items():
        df = model_rank.ask(c, rows, Answers(), 3, context="source_code", build=made)
        df = df.select("query_id", F.lit(kind).alias("kind"), "prompt", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"), "error")
        out = df if out is None else out.unionByName(df)
    return out
