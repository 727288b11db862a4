"""Helpers shared by the training-data operators: words, shared storage, prefix sums."""

from __future__ import annotations

import ctypes
import gc
import re
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

#: A word is a maximal run of characters outside this set of seven white-space code points.
WORD = r"[^\x20\x09-\x0D]+"
WORD_RX = re.compile(WORD)
_SEPARATORS = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """The words of ``text`` in order; null text has none."""
    parts = F.split(F.coalesce(text, F.lit("")), _SEPARATORS)
    return F.filter(parts, lambda w: w != F.lit(""))


def n_words(text: Column) -> Column:
    """How many words ``text`` has; counts starts of words, so no array is built."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def shared_root(spark: SparkSession) -> str:
    """The folder every executor sees: ``spark.checkpoint.dir``; a temporary one only where driver and executors are one process."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        root = sc._jsc.sc().getCheckpointDir().getOrElse(None) if sc._jsc.sc().getCheckpointDir().isDefined() else None
    if root is None:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tracehull-")
        sc.setCheckpointDir(root)
    return root if "://" in root or root.startswith("file:") else "file://" + root


def fresh_dir(spark: SparkSession, kind: str) -> str:
    """A new folder name under the shared root."""
    return f"{shared_root(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


#: What empties each cache that tasks of one worker share; only steps that name a cache keep it.
WORKER_CACHES: dict[str, Callable[[], None]] = {}


def map_arrow(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType, keeps: str = "") -> DataFrame:
    """``df.mapInArrow``, which ``materialize`` can run in the same Python worker as its writer; the cache ``keeps`` outlives a task."""
    out = df.mapInArrow(_lean(function, keeps), schema)
    out.mapped_from = (df, function, keeps)
    return out


def _lean(function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keeps: str = "") -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``function`` that gives memory back when its task ends: workers live on, and would hold it beside the next step's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tracehull.llm.common import WORKER_CACHES  # the worker's own

        for name, empty in WORKER_CACHES.items():
            if name != keeps:
                empty()
        yield from function(batches)
        release_memory()

    return run


def release_memory() -> None:
    """Return what this process has freed to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def materialize(df: DataFrame, kind: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back, so later steps do not recompute it.

    Where the folder is a mounted file system the files are written from Python: there
    Spark's own writer starts a process for each file, which for a moment doubles what an
    executor seems to hold. Only files that a finished task names stay. Anywhere else
    Spark's writer and its commit protocol are used. ``discard`` deletes the table.
    """
    spark, path = df.sparkSession, fresh_dir(df.sparkSession, kind)
    if path.startswith("file:"):
        rows = _write_files(df, path)
    else:
        df.write.option("compression", "zstd").parquet(path)
        rows = 1
    out = spark.read.schema(df.schema).parquet(path) if rows else spark.createDataFrame([], df.schema)
    out.written_at = path if rows else None
    free_shuffles(spark)
    return out


def _write_files(df: DataFrame, path: str) -> int:
    """Write ``df`` as Parquet files of Python tasks under the file URI ``path``; how many files were written."""
    source, function, keeps = getattr(df, "mapped_from", (df, None, ""))
    schema = to_arrow_schema(df.schema)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_fs(path)
        name, writer, held, size, rows = f"part-{attempt_tag()}.parquet", None, [], 0, 0
        for batch in function(batches) if function else batches:
            if not batch.num_rows:
                continue
            batch = batch.select(schema.names).cast(schema)
            if writer is None:
                fs.create_dir(base, recursive=True)
                out = fs.open_output_stream(f"{base}/{name}", compression=None)
                writer = pq.ParquetWriter(out, schema, compression="zstd")
            held.append(batch)
            size, rows = size + batch.nbytes, rows + batch.num_rows
            if size > 8_000_000:
                writer.write_table(pa.Table.from_batches(held))
                held, size = [], 0
        if writer is not None:
            if held:
                writer.write_table(pa.Table.from_batches(held))
            writer.close()
            out.close()
            held.clear()
            yield pa.RecordBatch.from_pydict({"file": [name], "rows": [rows]})

    short_batches(df.sparkSession)
    kept = {r["file"] for r in source.mapInArrow(_lean(write, keeps), "file string, rows long").collect()}  # one name a task
    if kept:
        fs, base = open_fs(path)
        for info in fs.get_file_info(pafs.FileSelector(base)):
            if info.base_name not in kept:
                fs.delete_file(info.path)
    return len(kept)


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``materialize`` that no later step reads: call it once all that follows from them is written."""
    for table in tables:
        if path := getattr(table, "written_at", None):
            where = table.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(table.sparkSession._jsc.sc().hadoopConfiguration()).delete(where, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let the driver drop plans it no longer needs and give their memory back; executors delete a shuffle's files only after that."""
    release_memory()
    spark._jvm.System.gc()


def open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path inside it for a URI (file, hdfs, s3, gs); usable on executors."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if "://" not in path:
        return pafs.LocalFileSystem(), path
    return pafs.FileSystem.from_uri(path)


def short_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Whole texts go to Python in batches of at most ``rows`` rows, so that long ones do not fill a worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows or int(spark.conf.get(key, "10000")) <= 0:
        spark.conf.set(key, str(rows))


def attempt_tag() -> str:
    """A name part that no other attempt of any task shares."""
    from pyspark import TaskContext

    context = TaskContext.get()
    return f"{context.partitionId():06d}-{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}"


def require(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    short_batches(df.sparkSession)


def temp_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have."""
    taken, name = {c.lower() for c in df.columns}, f"_{stem}"
    while name.lower() in taken:
        name = "_" + name
    return name


def bucketed_positions(
    rows: DataFrame, groups: list[str], order: list[Column], salt: Column, value: Column, buckets: int, rank: str, before: str | None = None
) -> DataFrame:
    """Row rank, and running sum of ``value`` before each row, within ``groups``, without one task per group.

    Each group is cut into ``buckets`` ranges by ``salt`` (0 .. buckets-1, monotone in
    the order); ranges are ordered in their own tasks and then shifted by the totals
    of the ranges before them, of which there are at most ``buckets`` a group.
    """
    by = [F.col(g) for g in groups]
    dealt = rows.withColumn("_bucket", salt.cast("int")).withColumn("_value", value)
    totals = dealt.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_n"), F.sum("_value").alias("_s"))
    earlier = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    shifts = totals.select(
        *[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)],
        F.col("_bucket").alias("_b"),
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n0"),
        F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_s0"),
    )
    inside = Window.partitionBy(*by, "_bucket").orderBy(*order)
    ranked = dealt.withColumn("_rn", F.row_number().over(inside) - 1)
    if before:
        ranked = ranked.withColumn("_run", F.coalesce(F.sum("_value").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    on = [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(groups)] + [F.col("_bucket") == F.col("_b")]
    joined = ranked.join(shifts, on, "left")
    out = joined.withColumn(rank, (F.col("_rn") + F.col("_n0")).cast("long"))
    if before:
        out = out.withColumn(before, (F.col("_run") + F.col("_s0")).cast("long"))
    return out.drop("_bucket", "_value", "_rn", "_run", "_b", "_n0", "_s0", *[f"_g{i}" for i in range(len(groups))])
