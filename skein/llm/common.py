"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Separator of the two keys of a prefix rank: rows are dealt over this many salts for every 100 MB of shuffle partitions.
SALTS_PER_PARTITION = 4

#: Where the shared folder is a local one, Hadoop starts a ``chmod`` for each file, checksum file and folder that it makes, unless it
#: has its native library. The plain file system makes no checksum files and leaves files' permissions to the umask.
PLAIN = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}

_kept: dict[Any, Any] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or one set here where it is unset (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="skein-checkpoint-")  # one machine, as in tests
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(at)
    return at


def stored(df: DataFrame, name: str, narrow: bool = False) -> DataFrame:
    """Writes a large table once, as zstd Parquet in the shared folder, and reads it back.

    What follows does not run the writer's Python again, also not after an executor is lost. Shuffle partitions are meant for
    texts: a table of a few numbers a row, a ``narrow`` one, is written by an eighth as many tasks, to as many files.
    """
    spark = df.sparkSession
    if narrow:
        df = df.coalesce(max(8, partitions(spark) // 8))
    path = f"{shared_dir(spark).rstrip('/')}/skein-{name}-{uuid.uuid4().hex}"
    df.write.options(compression="zstd", **PLAIN).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def files(spark: SparkSession) -> int:
    """A quarter as many as shuffle partitions, 48 at least where there are so many: each file costs a task and, at most, three processes."""
    return min(partitions(spark), max(48, partitions(spark) // 4))


def fewer(df: DataFrame) -> DataFrame:
    """The rows in so many tasks at most, each reading whole shuffle partitions one after another."""
    return df.coalesce(files(df.sparkSession))


def of_worker(key: Any = None, make: Callable[[], Any] | None = None) -> Any:
    """What a Python worker keeps from task to task, made once. Workers go from one operator to the next: another key, or none, lets it go."""
    if key not in _kept:
        if _kept:
            _kept.clear()
            pa.default_memory_pool().release_unused()
        if make:
            _kept[key] = make()
    return _kept.get(key)


def with_text(docs: DataFrame, keep: list[str]) -> tuple[DataFrame, int]:
    """``keep`` columns with the text as a string, and its place: a kept one itself, so that no text is sent to Python twice."""
    if "text" in keep and docs.schema["text"].dataType == StringType():
        return docs.select(*keep), keep.index("text")
    return docs.select(*keep, F.col("text").cast("string").alias("__text")), len(keep)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def salt(spark: SparkSession, *cols: Column) -> Column:
    """A salt from the row's own values, so that a task that runs again deals rows as before."""
    return F.pmod(F.xxhash64(*cols), F.lit(SALTS_PER_PARTITION * partitions(spark))).cast("int")
