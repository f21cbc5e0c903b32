"""Mixing sources to target weights: Efraimidis-Spirakis sampling to word budgets.

Each source has a target number of words: a share of the total by weight, at most `max_epochs` times the source's own
size, the excess dealt anew by weight until no source is above. A source's complete epochs take every document; what is
left of the target is filled in order of the key -ln(u) / quality weight (the smallest keys are the weighted sample
without replacement), prefix-summed to the budget. The gap before the first document that no longer fits is closed by that
one of the rest whose size comes nearest to it, if any brings the sum nearer.

No source is sorted whole. Keys fall into buckets (1,024 to an octave); bucket sums give the bucket that holds a source's
edge, and only that bucket's rows are sorted. The result is one row per source (epochs, edge bucket, edge key), by which
every document is then decided where it is: texts are not shuffled.

u comes from a hash of id and text (MD5, which SQL engines share), so that reruns agree. Quality weight: `weight` as given,
else 1 less twice the share of characters that are neither letters nor white space, and 0.1 at least. Null text has no words;
null and blank texts are worth nothing and take nothing. A null source is a source, last in order. Repeated rows share a
key; where the edge falls among them, as many as fit are taken, and numbered without gathering them. An empty table gives an
empty one; extra columns pass. Sources are few next to documents: their own order and running sums are one task's work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, free_name, shielded, table, written

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MAX_EPOCHS = 2
BUCKETS_PER_OCTAVE = 1024
SEED = 17


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: str) -> Column:
    t = F.coalesce(F.col(text), F.lit(""))
    odd = F.length(F.regexp_replace(t, r"[\p{L}\x20\x09-\x0D]+", "")) / F.greatest(F.length(t), F.lit(1))
    return F.greatest(F.lit(0.1), F.lit(1.0) - 2 * odd)


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", weight: Column | None = None, seed: int = SEED) -> DataFrame:
    """docs with __size, __key, __tie, __bucket."""
    df = docs.withColumn("__size", word_count(text_col))
    df = df.withColumn("__md5", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.coalesce(text_col, F.lit(""))).cast("binary")))
    part = lambda at: F.conv(F.substring("__md5", at, 13), 16, 10).cast("long")
    u = (part(1).cast("double") + 0.5) * (2.0**-52)
    given = quality_weight(text_col) if weight is None else F.greatest(F.coalesce(weight, F.lit(0.0)), F.lit(1e-9))
    df = df.withColumn("__key", -F.log(u) / given).withColumn("__tie", part(14)).drop("__md5")
    return df.withColumn("__bucket", F.floor(F.log2("__key") * BUCKETS_PER_OCTAVE).cast("long"))


def targets(sizes: DataFrame, source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """sizes (source_col, source_size), one row per source, with target double.

    The excess over a source's cap, dealt anew by weight until none is above, ends where every source has
    min(cap, level * weight); sorted by cap / weight the capped sources are a prefix, so running sums give the level.
    """
    order = Window.orderBy(F.col(source_col).asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights)
    df = sizes.withColumn("__w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")))
    df = df.withColumn("__cap", F.col("source_size").cast("double") * max_epochs)
    whole = Window.partitionBy()
    by_ratio = Window.orderBy(F.col("__cap") / F.col("__w"), F.col(source_col).asc_nulls_last())
    before, rest = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    df = df.withColumn("__budget", F.sum("source_size").over(whole) * share)
    df = df.withColumn("__used", F.coalesce(F.sum("__cap").over(before), F.lit(0.0))).withColumn("__rest", F.sum("__w").over(rest))
    df = df.withColumn("__level", (F.col("__budget") - F.col("__used")) / F.col("__rest"))
    df = df.withColumn("__capped", F.col("__cap") <= F.col("__level") * F.col("__w"))
    # the level is the one at the first source that is not capped
    df = df.withColumn("__final", F.first(F.when(~F.col("__capped"), F.col("__level")), ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return df.select(source_col, "source_size", F.when(F.col("__capped") | F.col("__final").isNull(), F.col("__cap")).otherwise(F.col("__final") * F.col("__w")).alias("target"))


def plan(rows: DataFrame, source_col: str = "source", **how) -> DataFrame:
    """rows (source_col, __size, __key, __tie, __bucket) to one row per source: source_size, target, epochs, and the edge."""
    sizes = rows.groupBy(source_col).agg(F.sum("__size").alias("source_size"))
    goal = targets(sizes, source_col, **how)
    goal = goal.withColumn("__epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    goal = goal.withColumn("__left", F.col("target") - F.col("__epochs") * F.col("source_size"))
    goal = written(goal.withColumnRenamed(source_col, "__source"), "mix-goals")
    buckets = rows.groupBy(source_col, "__bucket").agg(F.sum("__size").alias("__n"))
    upto = Window.partitionBy(source_col).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    buckets = buckets.withColumn("__before", F.sum("__n").over(upto) - F.col("__n"))
    edge = buckets.join(goal, buckets[source_col].eqNullSafe(goal["__source"])).filter("__before <= __left and __left < __before + __n").select("__source", "__before", F.col("__bucket").alias("__edge"), "__left")
    edge = written(edge, "mix-edges")
    near = rows.join(edge, rows[source_col].eqNullSafe(edge["__source"]) & (rows["__bucket"] == edge["__edge"]))
    # equal rows are one entry, however many they are
    near = near.groupBy("__source", "__before", "__left", "__key", "__tie", "__size").agg(F.count("*").alias("__m"))
    at = Window.partitionBy("__source").orderBy("__key", "__tie", "__size")
    near = near.withColumn("__sum", F.col("__before") + F.coalesce(F.sum(F.col("__size") * F.col("__m")).over(at.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    fits = F.when(F.col("__size") > 0, F.least("__m", F.floor((F.col("__left") - F.col("__sum")) / F.col("__size")).cast("long"))).otherwise(F.col("__m"))
    near = near.withColumn("__fits", fits).filter("__fits > 0")
    whole = near.filter("__fits = __m").groupBy("__source").agg(F.max(F.struct("__key", "__tie")).alias("__last"))
    some = near.groupBy("__source").agg(F.max(F.col("__sum") + F.col("__size") * F.col("__fits")).alias("__got"), F.max(F.when(F.col("__fits") < F.col("__m"), F.struct("__key", "__tie", "__fits"))).alias("__part"))
    out = goal
    for k, df in enumerate((edge.select("__source", "__edge", "__before"), whole, some)):
        df = df.withColumnRenamed("__source", f"__s{k}")
        out = out.join(df, out["__source"].eqNullSafe(df[f"__s{k}"]), "left").drop(f"__s{k}")
    gap = F.col("__left") - F.coalesce("__got", "__before")
    out = written(out.select("__source", "source_size", "target", "__epochs", "__edge", "__last", "__part", gap.alias("__gap")), "mix-cut")
    rest = rows.join(out.filter("__gap > 0").select("__source", "__edge", "__last", "__part", "__gap"), rows[source_col].eqNullSafe(F.col("__source"))).filter(~_inside())
    off = F.abs(F.col("__size") - F.col("__gap"))
    fill = rest.filter(off < F.col("__gap")).groupBy("__source").agg(F.min(F.struct(off.alias("off"), "__key", "__tie")).alias("__fill")).withColumnRenamed("__source", "__s3")
    # written, so that its size is known to the next join
    out = written(out.join(fill, out["__source"].eqNullSafe(fill["__s3"]), "left").select("__source", "source_size", "target", "__epochs", "__edge", "__last", "__part", "__fill"), "mix-fills")
    # rows that the edge or the fill has in common: only some of them are taken
    same = rows.join(out.filter("__part is not null or __fill is not null").select("__source", "__part", "__fill"), rows[source_col].eqNullSafe(F.col("__source")))
    same = same.filter(_is("__part") | _is("__fill")).groupBy("__source").agg(F.count_if(_is("__fill")).alias("__fills")).withColumnRenamed("__source", "__s4")
    return out.join(same, out["__source"].eqNullSafe(same["__s4"]), "left").drop("__s4")


def _is(entry: str) -> Column:
    return F.coalesce((F.col("__key") == F.col(f"{entry}.__key")) & (F.col("__tie") == F.col(f"{entry}.__tie")), F.lit(False))


def _inside() -> Column:
    """Whether a keyed row, joined with its source's plan, is in the prefix. Without an edge complete epochs meet the target."""
    on_edge = (F.col("__bucket") == F.col("__edge")) & F.coalesce(F.struct("__key", "__tie") <= F.col("__last"), F.lit(False))
    return F.coalesce((F.col("__bucket") < F.col("__edge")) | on_edge, F.lit(False))


def decided(rows: DataFrame, goals: DataFrame, source_col: str = "source") -> DataFrame:
    """rows (keyed) with source_size, target, __times: how often each row is taken."""
    df = rows.join(goals, rows[source_col].eqNullSafe(goals["__source"]))
    times = F.col("__epochs") + (_inside() | _is("__fill")).cast("long")
    shared = goals.filter("__part is not null or __fills > 1")
    if shared.isEmpty():
        return df.withColumn("__times", times)
    # of rows with one key some are taken: those are numbered, by task and within it
    some = _is("__part") | (_is("__fill") & (F.col("__fills") > 1))
    tied = written(df.filter(some).withColumn("__row", F.monotonically_increasing_id()), "mix-tied")
    task = F.shiftright("__row", 33)
    entry = [F.col("__source"), F.col("__key"), F.col("__tie")]
    counts = tied.groupBy(*entry, task.alias("__task")).agg(F.count("*").alias("__n"))
    counts = counts.withColumn("__first", F.sum("__n").over(Window.partitionBy(*entry).orderBy("__task")) - F.col("__n"))
    first = counts.select(F.col("__source").alias("__s"), F.col("__key").alias("__k"), F.col("__tie").alias("__t"), "__task", "__first")
    tied = tied.withColumn("__nth", F.row_number().over(Window.partitionBy(*entry, task).orderBy("__row")))
    # a row for each task and shared key
    tied = tied.join(F.broadcast(first), F.col("__source").eqNullSafe(F.col("__s")) & (F.col("__key") == F.col("__k")) & (F.col("__tie") == F.col("__t")) & (task == F.col("__task")))
    most = F.when(_is("__part"), F.col("__part.__fits")).otherwise(0) + F.when(_is("__fill"), 1).otherwise(0)
    tied = tied.withColumn("__times", F.col("__epochs") + (F.col("__first") + F.col("__nth") <= most).cast("long"))
    return df.filter(~some).withColumn("__times", times).unionByName(tied.select(*df.columns, "__times"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight: Column | None = None, seed: int = SEED, **how) -> DataFrame:
    """docs, each row as often as the mix takes it."""
    name = free_name(docs, "__given")
    cols, docs = docs.columns, docs if weight is None else docs.withColumn(name, weight)
    docs, (id_col, text_col, source_col, given), back = shielded(docs, id_col, text_col, source_col, source_col if weight is None else name)
    rows = keyed(docs, id_col, text_col, None if weight is None else F.col(given), seed)
    skinny = written(rows.select(source_col, "__size", "__key", "__tie", "__bucket"), "mix-keys")
    goals = written(plan(skinny, source_col, **how), "mix-plan")
    out = decided(rows, goals, source_col).filter("__times > 0")
    out = back(out.withColumn("__turn", F.explode(F.sequence(F.lit(1), F.col("__times")))))
    return out if weight is None else out.select(*out.columns[: len(cols)])


# ---- query -------------------------------------------------------------------------------------------------------


def op5_source_mixing(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    rows = written(keyed(docs).select("doc_id", "source", "__size", "__key", "__tie", "__bucket"), "mix-keys")
    goals = written(plan(rows), "mix-plan")
    out = decided(rows, goals)
    return out.select("doc_id", F.col("__size").alias("size"), "source_size", "target", (F.col("__times") * F.col("__size")).alias("taken"))


ORACLE = rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5(concat('{SEED}:', coalesce(CAST(doc_id AS VARCHAR), ''), ':', coalesce(text, ''))) AS h,
    greatest(0.1, 1.0 - 2 * CAST(length(regexp_replace(coalesce(text, ''), '[\p{{L}}\x20\x09-\x0D]+', '', 'g')) AS DOUBLE) / greatest(length(coalesce(text, '')), 1)) AS weight
  FROM documents
), k AS (
  SELECT *, -ln((CAST(CAST('0x' || substr(h, 1, 13) AS BIGINT) AS DOUBLE) + 0.5) * pow(2.0, -52)) / weight AS key, CAST('0x' || substr(h, 14, 13) AS BIGINT) AS tie FROM d
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w FROM d GROUP BY source
), c AS (
  SELECT *, {MAX_EPOCHS} * CAST(source_size AS DOUBLE) AS cap, {SHARE}::DOUBLE * sum(source_size) OVER () AS budget FROM s
), r AS (
  SELECT *, (budget - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM c WINDOW o AS (ORDER BY cap / w, source NULLS LAST)
), g AS (
  SELECT source, source_size, CASE WHEN cap <= level * w OR final IS NULL THEN cap ELSE final * w END AS target
  FROM (SELECT *, (SELECT level FROM r WHERE cap > level * w ORDER BY cap / w, source NULLS LAST LIMIT 1) AS final FROM r) x
), e AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM g
), t AS (
  SELECT k.*, source_size, target, epochs, target - epochs * source_size AS rest, sum(size) OVER (PARTITION BY k.source ORDER BY key, tie ROWS UNBOUNDED PRECEDING) <= target - epochs * source_size AS inside
  FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source
), f AS (
  SELECT *, rest - coalesce(sum(CASE WHEN inside THEN size END) OVER (PARTITION BY source), 0) AS gap FROM t
), n AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY inside OR gap <= 0 OR abs(size - gap) >= gap, abs(size - gap), key, tie) AS place FROM f
)
SELECT doc_id, size, source_size, target, CAST((epochs + CASE WHEN inside OR (place = 1 AND gap > 0 AND abs(size - gap) < gap) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM n
"""
