"""Secret scan with corpus-wide ownership frequency.

Base kinds are patterns, each matched leftmost and non-overlapping: `assign` (a credential keyword, a separator, a value of
12 characters or more), `access` (AKIA and 14 capitals or digits at least), `hex` (16 lower-case hex digits or more). Base
spans always stay. Besides, any run of 20 characters or more of [A-Za-z0-9+/_-] that mixes letters of both cases and digits
and has a high entropy is a candidate of kind `live`, unless it overlaps a base span.

Every value is hashed, and the hashes of all documents are aggregated: in how many distinct owners and repositories does a
value occur? A value that `widely` owners share, or that lies in `widely_repos` repositories, is an example that was copied
around; one that stays with few owners and repositories looks like a credential of theirs. Candidates of kind `live` become spans only in the second case; base spans are only marked.

The frequency is two map-side aggregates on the hash (first distinct owner and repository, then counts), so a value that
occurs everywhere costs one row for each owner. Values themselves are never shuffled, only hashes.

Null and empty texts have no spans. Repeated rows are scanned each on its own and own their values together. A null owner
or repository counts as one more. Spans are code points, end exclusive. An empty table gives an empty one; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, join_groups, table, written

KINDS = ("assign", "access", "hex", "live")
_ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_LIVE = re.compile(r"[A-Za-z0-9+/_-]{20,}")
#: Without one of these there is no assign match.
_HINT = re.compile(r"(?ai:passw|secret|token|api_?key)")
ENTROPY = 3.5
#: Owners, and repositories, from which on a value counts as copied around.
WIDELY, WIDELY_REPOS = 3, 10


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def base_spans(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, value), by start, then kind as listed."""
    out = []
    if _HINT.search(text):
        out += [(m.start(), m.end(), "assign", m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access", m[0]) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), m.end(), "hex", m[0]) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def live_candidates(text: str, taken: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str, str]]:
    out = []
    for m in _LIVE.finditer(text):
        v = m[0]
        if not (re.search("[a-z]", v) and re.search("[A-Z]", v) and re.search("[0-9]", v)) or entropy(v) < ENTROPY:
            continue
        if not any(a < m.end() and m.start() < b for a, b, _, _ in taken):
            out.append((m.start(), m.end(), "live", v))
    return out


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]))))


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id") -> DataFrame:
    """(id, owner, repo, found): one row per row; found: array of (start, end, kind, hash, entropy)."""
    bounded_batches(docs.sparkSession)
    src = docs.select(F.col(id_col).alias("id"), F.col(owner_col).cast("string").alias("owner"), F.col(repo_col).cast("string").alias("repo"), F.col(text_col).alias("text"))
    item = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("hash", pa.int64()), ("entropy", pa.float64())])

    def scan(text: str | None) -> list[dict]:
        if not text:
            return []
        base = base_spans(text)
        every = base + live_candidates(text, base)
        return [{"start": a, "end": b, "kind": k, "hash": int.from_bytes(hashlib.blake2b(v.encode(), digest_size=8).digest(), "little", signed=True), "entropy": entropy(v)} for a, b, k, v in every]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([scan(t.as_py()) for t in batch.column("text")], pa.list_(item))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("owner"), batch.column("repo"), found], names=["id", "owner", "repo", "found"])

    kind = docs.schema[id_col].dataType.simpleString()
    return src.mapInArrow(run, f"id {kind}, owner string, repo string, found array<struct<start: long, end: long, kind: string, hash: long, entropy: double>>")


def ownership(found: DataFrame) -> DataFrame:
    """found (owner, repo, hash) to (hash, n_owners, n_repos, n_found)."""
    pairs = found.groupBy("hash", "owner", "repo").agg(F.count("*").alias("n"))
    owners = pairs.groupBy("hash", "owner").agg(F.count("*").alias("repos"), F.sum("n").alias("n"))
    return owners.groupBy("hash").agg(F.count("*").alias("n_owners"), F.sum("repos").alias("n_repos"), F.sum("n").alias("n_found"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id", widely: int = WIDELY, widely_repos: int = WIDELY_REPOS) -> DataFrame:
    """(id_col, secrets), one row per row; secrets: array of (start, end, kind, n_owners, n_repos, verdict), by start.

    verdict: `example` (at least `widely` owners or `widely_repos` repositories), else `live` (high entropy) or `plain`.
    Candidates of kind live are there only with the verdict live.
    """
    rows = written(candidates(docs, id_col, text_col, owner_col, repo_col).withColumn("row", F.monotonically_increasing_id()), "secret-candidates")
    each = rows.filter(F.size("found") > 0).select("row", "owner", "repo", F.explode("found").alias("s")).select("row", "owner", "repo", "s.*")
    seen = ownership(each)
    verdict = F.when((F.col("n_owners") >= widely) | (F.col("n_repos") >= widely_repos), "example").when(F.col("entropy") >= ENTROPY, "live").otherwise("plain")
    told = join_groups(each, seen, "hash", "n_found", each.count(), "inner").withColumn("verdict", verdict).filter("kind <> 'live' or verdict = 'live'")
    nth = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    by_row = told.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", nth.alias("nth"), "end", "kind", "n_owners", "n_repos", "verdict"))).alias("secrets"))
    # rows with nothing found stay out of the join
    some = rows.filter(F.size("found") > 0).select("row", "id").join(by_row, "row", "left").select("id", "secrets")
    none = rows.filter(F.size("found") == 0).select("id", F.lit(None).cast(by_row.schema["secrets"].dataType).alias("secrets"))
    return some.unionByName(none).select(F.col("id").alias(id_col), F.coalesce("secrets", F.array().cast(by_row.schema["secrets"].dataType)).alias("secrets"))


# ---- query -------------------------------------------------------------------------------------------------------


def op2_secret_scan(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    s = F.col("secrets")
    word = lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])
    base = F.filter(s, lambda x: x["kind"] != "live")
    count = lambda test: F.size(F.filter(s, test)).cast("long")
    is_kind = lambda k: lambda x: x["kind"] == k
    return scan(docs).select(
        "doc_id",
        *[count(is_kind(k)).alias(f"n_{k}") for k in KINDS],
        F.sha2(F.array_join(F.transform(base, word), ","), 256).alias("base_sha256"),
        F.array_join(F.transform(s, word), ",").alias("spans"),
        count(lambda x: x["verdict"] == "live").alias("n_owner_specific"),
        count(lambda x: x["verdict"] == "example").alias("n_widely_copied"),
    )


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


#: Keyword letters stand in either case; the case-insensitive mode would fold letters beyond ASCII as well.
_KEYWORDS = "|".join(map(_either_case, ("password", "passwd", "secret", "token", "api_?key")))

_ASSIGN_SQL = rf"({_KEYWORDS})[\x22\x27]?\x20*[:=]\x20*[\x22\x27]?([A-Za-z0-9+/_.=-]+)"


def _found_sql(kind: str, pattern: str, value: int, least: int) -> str:
    """Matches with their places: what stands between them and they themselves alternate."""
    length = "list_sum(list_transform({}, lambda p: length(p)))"
    return f"""
  SELECT row, owner, repo, '{kind}' AS kind, v[i] AS value, coalesce({length.format("parts[1:i]")}, 0) + coalesce({length.format("m[1:i - 1]")}, 0) AS a, length(m[i]) AS n
  FROM (SELECT row, owner, repo, m, v, parts, unnest(range(1, len(m) + 1)) AS i FROM (
    SELECT row, owner, repo, regexp_extract_all(t, '{pattern}') AS m, regexp_extract_all(t, '{pattern}', {value}) AS v, string_split_regex(t, '{pattern}') AS parts FROM d WHERE regexp_matches(t, '{pattern}')
  ) x) y WHERE length(v[i]) >= {least}"""


ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(source, '') AS owner, source IS NULL AS unowned, doc_id AS repo, coalesce(text, '') AS t FROM documents),
base AS ({" UNION ALL ".join((_found_sql("assign", _ASSIGN_SQL, 2, 12), _found_sql("access", "AKIA[A-Z0-9]+", 0, 18), _found_sql("hex", "[0-9a-f]+", 0, 16)))}
), run AS ({_found_sql("live", "[A-Za-z0-9+/_-]{20,}", 0, 20)}
), mixed AS (
  SELECT * FROM run r WHERE regexp_matches(value, '[a-z]') AND regexp_matches(value, '[A-Z]') AND regexp_matches(value, '[0-9]')
    AND NOT EXISTS (SELECT 1 FROM base b WHERE b.row = r.row AND b.a < r.a + r.n AND r.a < b.a + b.n)
), entropies AS (
  SELECT value, -sum(k / n * log2(k / n)) AS entropy
  FROM (SELECT value, length(value) AS n, count(*) AS k FROM (SELECT value, unnest(string_split(value, '')) AS c FROM (SELECT DISTINCT value FROM (SELECT value FROM base UNION ALL SELECT value FROM mixed) u) w) x GROUP BY value, c) y GROUP BY value
), every AS (SELECT * FROM base UNION ALL SELECT m.* FROM mixed m JOIN entropies USING (value) WHERE entropy >= {ENTROPY}),
seen AS (SELECT value, count(DISTINCT (e.owner, unowned)) AS owners, count(DISTINCT (e.owner, unowned, e.repo)) AS repos FROM every e JOIN d USING (row) GROUP BY value),
told AS (
  SELECT e.*, list_position({list(KINDS)}, kind) AS nth, CASE WHEN owners >= {WIDELY} OR repos >= {WIDELY_REPOS} THEN 'example' WHEN entropy >= {ENTROPY} THEN 'live' ELSE 'plain' END AS verdict, concat(kind, ':', a, ':', a + n) AS span
  FROM every e JOIN seen USING (value) JOIN entropies USING (value)
)
SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in KINDS)},
  sha256(coalesce(string_agg(span, ',' ORDER BY a, nth, n) FILTER (kind <> 'live'), '')) AS base_sha256, coalesce(string_agg(span, ',' ORDER BY a, nth, n), '') AS spans,
  count(*) FILTER (verdict = 'live') AS n_owner_specific, count(*) FILTER (verdict = 'example') AS n_widely_copied
FROM d LEFT JOIN (SELECT * FROM told WHERE kind <> 'live' OR verdict = 'live') s USING (row) GROUP BY row, doc_id
"""
