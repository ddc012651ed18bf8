"""Helpers shared by the operators of this subpackage: shared-folder tables and text expressions."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rule `[^\x20\x09-\x0D]+`.
SPACES = " \t\n\x0b\x0c\r"
SPACE_PATTERN = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: spark.checkpoint.dir; where it is unset, a temporary one, in local mode (tests) only."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="bytelake-")
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet below the shared folder and read it back: lineage ends there, and losing an executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/bytelake-{uuid.uuid4().hex}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete materialized tables that nothing will read again."""
    delete_folder(tables[0].sparkSession, *{f.rsplit("/", 2)[0] for t in tables for f in t.inputFiles()})


def delete_folder(spark: SparkSession, *folders: str) -> None:
    """Delete folders with all that is in them, on whatever file system they are."""
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    for folder in folders:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def make_folder(spark: SparkSession, *folders: str) -> None:
    """Make folders that aren't there yet, on whatever file system they are."""
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    for folder in folders:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).mkdirs(path)


def released(kernel: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The kernel; at its end the worker, which Spark keeps for further tasks, gives free memory back to the system."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from kernel(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
            trim(0)

    return run


def strings(spark: SparkSession, column: str, values: list[str]) -> DataFrame:
    """A table of one column from the driver's values. Arrow makes it a local relation, which starts no Python workers of its own."""
    return spark.createDataFrame(pa.table({column: pa.array(values, type=pa.string())}))


def named(column: str, prefix: str = "") -> Column:
    """A column by its name, whatever characters are in it."""
    quoted = column.replace("`", "``")
    return F.col(f"{prefix}`{quoted}`")


def text_or_empty(text: str | Column) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def fold_ascii(text: Column) -> Column:
    """Lower-case A-Z only. A text of ASCII alone takes lower(), which has a faster path and the same result there."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    """Array of the words of a text (no nulls); an empty array where there are none."""
    bare = F.btrim(text, F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE_PATTERN))
