"""What the operators of this subpackage share: scratch tables, row splitting, small expressions."""

from __future__ import annotations

import atexit
import ctypes
import gc
import math
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as the contracts name it: space and U+0009 to U+000D.
BLANK = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir.

    Only where that setting is absent and all runs on one machine (tests), a temporary folder takes its place; a cluster
    without it raises.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = held.get() if held.isDefined() else None
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='termweave-')}"
        atexit.register(shutil.rmtree, found.removeprefix("file://"), ignore_errors=True)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def _own_scratch(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/termweave/{spark.sparkContext.applicationId}"


#: Applications whose scratch folder the driver's JVM removes when it ends.
_GOING: set[str] = set()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in this application's scratch folder, which goes when the driver ends: lazy results read from it until then."""
    own = _own_scratch(spark)
    if own not in _GOING:
        p = spark._jvm.org.apache.hadoop.fs.Path(own)
        system = p.getFileSystem(spark._jsc.hadoopConfiguration())
        system.mkdirs(p)
        system.deleteOnExit(p)
        _GOING.add(own)
    return f"{own}/{name}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Removes this application's scratch tables; results that are still lazy need theirs until they are written."""
    p = spark._jvm.org.apache.hadoop.fs.Path(_own_scratch(spark))
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """df, computed once into a Parquet table in the shared folder: cuts the lineage and outlives executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def released(spark: SparkSession, *tables: DataFrame) -> None:
    """Removes the scratch tables that `tables` read and nothing else does any more, and lets Spark remove the shuffles and broadcasts of plans that are gone."""
    for folder in {f.rpartition("/")[0] for t in tables for f in t.inputFiles()}:
        p = spark._jvm.org.apache.hadoop.fs.Path(folder)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    gc.collect()
    spark._jvm.System.gc()


def spread(df: DataFrame) -> DataFrame:
    """df, a table as it is read, over all cores: if fewer splits than cores hold rows (one large row group), it is dealt anew.

    A table of many files is left as it is without a look at its splits.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if len(df.inputFiles()) >= 4 * cores or df.select(F.spark_partition_id().alias("p")).distinct().count() >= cores:
        return df
    return df.repartition(2 * cores)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def id_hash(col: str) -> Column:
    """crc32 of an id as text, by which the contracts hold rows out; null ids count as empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary"))


def as_long(h: Column) -> Column:
    return h.cast("long")


#: Rows and bytes that go to Python at once, where rows are whole texts; Spark's own default would hold ten times as many.
TEXT_ROWS, TEXT_BYTES = 1000, 4 << 20


def bounded_batches(spark: SparkSession, rows: int = TEXT_ROWS, size: int = TEXT_BYTES) -> None:
    """Lowers the session's Arrow batch, if it is larger: it bounds the memory of Python workers that read texts."""
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = str(spark.conf.get(name)).removesuffix("b").removesuffix("B")
        if not now.lstrip("-").isdigit() or int(now) <= 0 or int(now) > most:
            spark.conf.set(name, str(most))


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, after which the worker gives freed memory back: workers outlive their tasks, and the next stage needs it."""

    def tidied(batches: Iterator) -> Iterator:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    return tidied


def map_batches(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """f over each Arrow batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := f(batch)) is not None:
                yield out

    return df.mapInArrow(tidy(run), schema)


#: log2 of a key bitmap's bits, at least and at most: 2^24 bits are 262,144 rows of 64, 2 MB, whatever the input's size.
FILTER_BITS, MOST_FILTER_BITS = 20, 24


def filter_bits(keys: int) -> int:
    """log2 of the bits that let about one in sixteen of other keys pass, as long as that is within the bound."""
    return min(MOST_FILTER_BITS, max(FILTER_BITS, math.ceil(math.log2(16 * max(1, keys)))))


def key_bitmap(keys: DataFrame, hashed: Column, bits: int = FILTER_BITS) -> DataFrame:
    """A bitmap of a hash (long) over keys: (__word, __bits), 2^bits / 64 rows at most."""
    slot = F.shiftrightunsigned(hashed, 64 - bits)
    held = keys.select(F.shiftright(slot, 6).alias("__word"), (slot % 64).cast("int").alias("__bit"))
    return held.groupBy("__word").agg(F.bit_or(F.expr("shiftleft(1L, __bit)")).alias("__bits"))


def with_hit(df: DataFrame, hashed: Column, bitmap: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """df with __hit: whether the bitmap has the hash (some false, never missing). The bitmap's bound is proven: broadcast."""
    slot = F.shiftrightunsigned(hashed, 64 - bits)
    df = df.withColumn("__word", F.shiftright(slot, 6)).withColumn("__bit", (slot % 64).cast("int"))
    df = df.join(F.broadcast(bitmap), "__word", "left")
    return df.withColumn("__hit", F.coalesce(F.expr("shiftrightunsigned(__bits, __bit) & 1L"), F.lit(0)) == 1).drop("__word", "__bit", "__bits")


#: A group is hot if it has more than this share of the rows: there are fewer than 1 / HOT_SHARE of them.
HOT_SHARE = 1 / 1000


def split_hot(groups: DataFrame, size: str, rows: int) -> tuple[DataFrame, DataFrame]:
    """groups whose size is above HOT_SHARE of rows, marked for broadcast (their number is bounded), and the others."""
    least = max(1.0, rows * HOT_SHARE)
    return F.broadcast(groups.filter(F.col(size) > least)), groups.filter(F.col(size) <= least)


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, how: str = "left") -> DataFrame:
    """rows joined with groups (one row a key, with the group's size in rows), the hot groups apart and without a shuffle."""
    hot, cold = split_hot(groups, size, total)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rows.join(hot, key).unionByName(rest.join(cold, key, how))


def shielded(df: DataFrame, *names: str) -> tuple[DataFrame, list[str], Callable[[DataFrame], DataFrame]]:
    """df under column names c0, c1, ..., those of `names`, and the way back.

    Helper columns (all start with two underscores) then cannot clash with the input's, whatever those are called.
    """
    cols = df.columns
    plain = [f"c{i}" for i in range(len(cols))]
    lower = [c.lower() for c in cols]
    found = [plain[cols.index(n) if n in cols else lower.index(n.lower())] for n in names]
    return df.toDF(*plain), found, lambda out: out.select(*plain).toDF(*cols)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df does not have yet, compared without case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
