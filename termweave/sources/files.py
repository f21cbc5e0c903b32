"""Input sheets, vector indexes with their manifests, and settings that come from both."""

from __future__ import annotations

import io
import json
import os
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_MODEL = "hashed-ngrams"


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    """A table by its suffix: csv and txt (commas), tsv and tab (tabs), parquet, xls and xlsx."""
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if suffix == "parquet":
        return spark.read.parquet(path)
    if suffix in ("csv", "txt", "tsv", "tab"):
        return spark.read.csv(path, header=True, inferSchema=True, multiLine=True, escape='"', sep="\t" if suffix in ("tsv", "tab") else ",")
    if suffix in ("xls", "xlsx"):
        import pandas as pd

        try:
            return spark.createDataFrame(pd.read_excel(path))
        except ImportError as e:
            raise ImportError("spreadsheets need openpyxl") from e
    raise ValueError(f"no reader for .{suffix}")


def numbered(df: DataFrame, out: str = "query_id", first_rows: int = 0) -> DataFrame:
    """df with the number of each row in file order, from 0; only the first rows, if first_rows is above 0.

    Rows are counted by partition, and numbered where they are: no shuffle.
    """
    part = F.spark_partition_id()
    sizes = sorted(tuple(r) for r in df.groupBy(part.alias("p")).count().collect())
    starts, at = [], 0
    for p, n in sizes:
        starts += [F.lit(p), F.lit(at)]
        at += n
    first = F.element_at(F.create_map(*starts), part) if starts else F.lit(0)
    df = df.withColumn(out, (first + F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))).cast("long"))
    return df.filter(F.col(out) < first_rows) if first_rows and first_rows > 0 else df


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that the driver and all executors see, below spark.checkpoint.dir; it goes when the driver ends."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        top = f"file://{tempfile.gettempdir()}"
    path = f"{top.rstrip('/')}/termweave-files/{name}-{uuid.uuid4().hex}"
    fs, p = _file_system(spark, path)
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df, computed once into a Parquet table in the shared folder."""
    path = f"{shared_folder(df.sparkSession, name)}/table"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _file_system(spark: SparkSession, path: str):
    """The file system that a path names, and the path in it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def file_text(spark: SparkSession, path: str) -> str:
    """A small file, through the file system that the path names."""
    fs, p = _file_system(spark, path)
    source = fs.open(p)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(source)).decode("utf-8")
    finally:
        source.close()


class TextFile(io.TextIOBase):
    """A text file that is written through the file system that its path names, some MB at once."""

    def __init__(self, spark: SparkSession, path: str, append: bool = False):
        fs, p = _file_system(spark, path)
        # not every file system appends: what is there is written again
        before = file_text(spark, path) if append and fs.exists(p) else ""
        self.out, self.held, self.size = fs.create(p, True), [], 0
        self.write(before)

    def write(self, text: str) -> int:
        self.held.append(text)
        self.size += len(text)
        if self.size > 1 << 20:
            self._put()
        return len(text)

    def _put(self) -> None:
        if self.held:
            self.out.write(bytearray("".join(self.held).encode("utf-8")))
        self.held, self.size = [], 0

    def close(self) -> None:
        if not self.closed:
            self._put()
            self.out.close()
        super().close()


def duckdb_tables(spark: SparkSession, path: str, names: Sequence[str]) -> str:
    """A folder with the named tables of a DuckDB file as Parquet, those that are there; DuckDB writes them, no row passes Python."""
    if not os.path.exists(path):
        raise FileNotFoundError(path)
    try:
        import duckdb
    except ImportError as e:
        raise ImportError("DuckDB files need the duckdb package") from e
    folder = shared_folder(spark, "duckdb")
    scheme, _, rest = folder.partition("://")
    if rest and scheme != "file":
        raise ValueError("tables of a DuckDB file are exported to spark.checkpoint.dir, which has to be a mounted folder")
    local = rest or folder.removeprefix("file:")
    with duckdb.connect(path, read_only=True) as con:
        there = {r[0] for r in con.execute("SELECT table_name FROM information_schema.tables").fetchall()}
        for name in names:
            if name in there:
                con.execute(f"""COPY "{name}" TO '{local}/{name}.parquet' (FORMAT parquet)""")
    return folder


def write_index(df: DataFrame, folder: str, table: str, manifest: dict, extra: Sequence[str] = ()) -> None:
    """The index as Parquet, replaced whole, and its manifest beside it."""
    cols = ["concept_id", "profile_text", "vector", *(c for c in extra if c in df.columns)]
    df.select(F.col("concept_id").cast("long").alias("concept_id"), *cols[1:]).write.mode("overwrite").parquet(f"{folder}/{table}")
    written = df.sparkSession.read.parquet(f"{folder}/{table}").agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("dim")).first()
    with TextFile(df.sparkSession, f"{folder}/{table}_manifest.json") as f:
        f.write(json.dumps(manifest | {"count": written["n"], "vector_dim": written["dim"]}, indent=2, sort_keys=True))


def read_manifest(spark: SparkSession, folder: str, table: str) -> dict | None:
    """None if there is none, or none that can be read."""
    try:
        return json.loads(file_text(spark, f"{folder}/{table}_manifest.json"))
    except Exception:  # noqa: BLE001  whatever is wrong with it, an index works without
        return None


def read_index(spark: SparkSession, folder: str, table: str) -> tuple[DataFrame, str]:
    """The index and its vector column."""
    from ..operators.search import vector_column

    df = spark.read.parquet(f"{folder}/{table}")
    return df, vector_column(df)


def encoder_settings(manifest: dict | None, model_id: str | None = None, pooling: str | None = None, max_length: int | None = None, trust_remote_code: bool | None = None) -> dict:
    """Flags first, then the manifest, then defaults."""
    m = manifest or {}
    return {
        "model_id": str(model_id or m.get("model_id") or DEFAULT_MODEL),
        "pooling": str(pooling or m.get("pooling") or "cls"),
        "max_length": int(max_length if max_length is not None else m.get("max_length") or 128),
        "trust_remote_code": bool(m.get("trust_remote_code", False) if trust_remote_code is None else trust_remote_code),
    }


def table_or_none(spark: SparkSession, folder: str, name: str) -> DataFrame | None:
    """A Parquet table of a folder, or a catalogue table; None if there is none."""
    if spark.catalog.tableExists(name):
        return spark.table(name)
    path = f"{folder}/{name}.parquet"
    fs, p = _file_system(spark, path)
    return spark.read.parquet(path) if fs.exists(p) else None
