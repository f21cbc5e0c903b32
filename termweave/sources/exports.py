"""Results in the layouts that reviewers read: candidates beside the input, blocks side by side, review sheets, logs.

Files are written through the file system that their path names, a row at a time.
"""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import usagi
from .files import TextFile, written


def beside_input(rows: DataFrame, candidates: DataFrame, topk: int, query_id: str = "query_id", rank: str = "rank") -> DataFrame:
    """rows with top1..topK columns: concept_id, concept_name (if there), score, domain_id (if there); null beyond the last."""
    parts = [("concept_id", "concept_id")] + [("concept_name", "concept_name")] * ("concept_name" in candidates.columns) + [("score", "final_score")] + [("domain_id", "domain_id")] * ("domain_id" in candidates.columns)
    at = lambda i, c: F.max(F.when(F.col(rank) == i, F.col(c)))
    wide = candidates.filter(F.col(rank) <= topk).groupBy(F.col(query_id).alias("_q")).agg(*[at(i, c).alias(f"top{i}_{name}") for i in range(1, topk + 1) for name, c in parts])
    return rows.join(wide, rows[query_id] == F.col("_q"), "left").drop("_q")


def first_names(candidates: DataFrame, query_id: str = "query_id", rank: str = "rank") -> DataFrame:
    """(concept_id, concept_name): of each concept the name with which it is seen first."""
    name = F.col("concept_name") if "concept_name" in candidates.columns else F.lit(None).cast("string")
    return candidates.groupBy("concept_id").agg(F.coalesce(F.min_by(name, F.struct(query_id, rank)), F.lit("")).alias("concept_name"))


def block_cells(rows: DataFrame, candidates: DataFrame, topk: int, query_id: str = "query_id", name: str = "source_name", code: str = "source_code", gold: str = "gold_concept_id", rank: str = "rank", keep_order: bool = False) -> DataFrame:
    """(block, rank, gold_rank, source_name, source_code, flag, concept_name, concept_id): a block a query, a row a place.

    Blocks stand matched first, by the place of the answer, then by code; or in input order. flag is X at the answer.
    """
    longest = candidates.filter(F.col(rank) <= topk).agg(F.max(rank)).first()[0] if topk > 0 else candidates.agg(F.max(rank)).first()[0]
    if not longest:
        return candidates.sparkSession.createDataFrame([], "block long, rank int, gold_rank int, source_name string, source_code string, flag string, concept_name string, concept_id long")
    key = F.coalesce(F.nullif(F.col(code).cast("string"), F.lit("")), F.concat(F.lit("row"), F.col(query_id).cast("string")))
    known = F.col(gold).cast("string").try_cast("long") if gold in rows.columns else F.lit(None).cast("long")
    q = rows.select(F.col(query_id).alias("_q"), F.coalesce(F.col(name).cast("string"), F.lit("")).alias("source_name"), key.alias("source_code"), F.when(known >= 0, known).alias("_gold"))
    c = candidates.filter(F.col(rank) <= longest).select(F.col(query_id).alias("_q"), F.col(rank).cast("int").alias("rank"), F.col("concept_id").cast("long").alias("concept_id"))
    c = c.join(first_names(candidates, query_id, rank).withColumn("concept_id", F.col("concept_id").cast("long")), "concept_id", "left")
    cells = q.withColumn("rank", F.explode(F.sequence(F.lit(1), F.lit(int(longest))))).join(c, ["_q", "rank"], "left")
    own = Window.partitionBy("_q")
    cells = cells.withColumn("gold_rank", F.min(F.when(F.col("concept_id") == F.col("_gold"), F.col("rank"))).over(own))
    flag = F.when(F.col("concept_id") == F.col("_gold"), "X").otherwise("")
    order = q.select("_q", "source_code").join(cells.select("_q", "gold_rank").distinct(), "_q")
    keys = [F.col("_q")] if keep_order else [F.col("gold_rank").asc_nulls_last(), F.col("source_code"), F.col("_q")]
    return cells.join(_placed(order, keys), "_q").select("block", "rank", "gold_rank", "source_name", "source_code", F.coalesce(flag, F.lit("")).alias("flag"), F.coalesce("concept_name", F.lit("")).alias("concept_name"), "concept_id")


def _placed(rows: DataFrame, keys: Sequence) -> DataFrame:
    """(_q, block): the place of each row, from 1. Rows are dealt by range and sorted; each range starts where those before it end."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).select("_q", F.monotonically_increasing_id().alias("_row"))
    dealt = written(dealt, "places")
    part = F.shiftright("_row", 33)
    sizes = dealt.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    starts = sizes.withColumn("_start", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).drop("_n")  # a row a range
    return dealt.withColumn("_part", part).join(F.broadcast(starts), "_part").select("_q", (F.col("_start") + F.col("_row").bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias("block"))


def write_blocks(cells: DataFrame, path: str) -> None:
    """The blocks side by side, three columns each, under [place of the answer or `unmatched`, name, code]. A sheet for people.

    A line of the sheet is one place of all blocks: lines are streamed one after the other, so that the driver holds some
    cells. cells should be written: they are read once for each line.
    """
    heads = cells.filter("rank = 1").orderBy("block")
    longest = cells.agg(F.max("rank")).first()[0] or 0
    with TextFile(cells.sparkSession, path) as f:
        if not longest:
            f.write("\n")
            return
        line(f, ["rank"], ((str(r["gold_rank"]) if r["gold_rank"] is not None else "unmatched", r["source_name"], r["source_code"]) for r in heads.toLocalIterator()))
        for k in range(1, longest + 1):
            own = cells.filter(F.col("rank") == k).orderBy("block")
            line(f, [str(k)], ((r["flag"], r["concept_name"], "" if r["concept_id"] is None else str(r["concept_id"])) for r in own.toLocalIterator()))


def line(f: TextFile, first: list[str], rest) -> None:
    """One line of a sheet, some cells at once."""
    cell = io.StringIO()
    out = csv.writer(cell, lineterminator="")
    out.writerow(first)
    f.write(cell.getvalue())
    for some in rest:
        cell.seek(0)
        cell.truncate()
        out.writerow(some)
        f.write("," + cell.getvalue())
    f.write("\n")


def write_csv(df: DataFrame, path: str) -> None:
    """One CSV file with a header, in the order of df, row by row through the driver."""
    with TextFile(df.sparkSession, path) as f:
        out = csv.writer(f, lineterminator="\n")
        out.writerow(df.columns)
        for r in df.toLocalIterator(prefetchPartitions=True):
            out.writerow(["" if v is None else v for v in r])


def write_metrics(metrics: DataFrame, path: str) -> dict:
    got = {k: v for k, v in metrics.first().asDict().items() if v is not None}
    with TextFile(metrics.sparkSession, path) as f:
        json.dump(got, f, indent=2, sort_keys=True)
    return got


def append_prompts(answers: DataFrame, path: str, query_id: str = "query_id") -> None:
    """An audit log of prompts and answers; grows with each run."""
    with TextFile(answers.sparkSession, path, append=True) as f:
        for r in answers.filter("response IS NOT NULL").orderBy(query_id).toLocalIterator():
            f.write(f"## Row {r[query_id]}\n\n### Prompt\n\n{r['prompt']}\n\n### Response\n\n{r['response']}\n\n")


def write_errors(errors: DataFrame, path: str) -> None:
    """index, type, source_name, source_code, message."""
    write_csv(errors.select("index", "type", "source_name", "source_code", "message").orderBy("index"), path)


def write_all(folder: str, rows: DataFrame, candidates: DataFrame, review: DataFrame | None = None, metrics: DataFrame | None = None, answers: DataFrame | None = None, errors: DataFrame | None = None, topk: int = 20, query_id: str = "query_id", input_columns: Sequence[str] = (), keep_order: bool = False) -> dict[str, str]:
    """All layouts in a folder: results.csv, results_with_input.csv, results_usagi.csv, metrics.json, logs."""
    at = lambda name: f"{folder.rstrip('/')}/{name}"
    out = {"results": at("results.csv"), "with_input": at("results_with_input.csv")}
    write_blocks(written(block_cells(rows, candidates, topk, query_id, keep_order=keep_order), "cells"), out["results"])
    wide = beside_input(rows.select(query_id, *input_columns), candidates, topk, query_id)
    write_csv(wide.orderBy(query_id).drop(query_id), out["with_input"])
    if review is not None:
        best = candidates.filter("rank = 1")
        for c in ("concept_name", "domain_id"):
            if c not in best.columns:
                best = best.withColumn(c, F.lit(None).cast("string"))
        out["usagi"] = at("results_usagi.csv")
        write_csv(usagi.with_best(review, best, query_id).orderBy(query_id).drop(query_id), out["usagi"])
    if metrics is not None:
        out["metrics"] = at("metrics.json")
        write_metrics(metrics, out["metrics"])
    if answers is not None:
        out["prompts"] = at("rag_prompts.md")
        append_prompts(answers, out["prompts"], query_id)
    if errors is not None:
        out["errors"] = at("errors.log")
        write_errors(errors, out["errors"])
    return out
