"""Where intermediate results live so that every executor can read them again."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession

T = TypeVar("T")
_KEPT: dict[str, SparkSession] = {}  # folders that this process wrote and nothing has dropped yet


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines share: ``spark.checkpoint.dir``. A local master may go without it (tests): a temporary folder then."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"{master} needs spark.checkpoint.dir, a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="loomgrain-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    """A path of its own under the shared folder; it lasts until it is dropped or the driver ends."""
    path = f"{shared_dir(spark)}/loomgrain/{label}-{uuid.uuid4().hex}"
    _KEPT[path] = spark
    return path


def drop_folder(path: str) -> None:
    spark = _KEPT.pop(path, None)
    if spark is not None:
        jvm = spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def clean() -> None:
    """Drop every intermediate result of this process: DataFrames that read them can't be read any more. Runs when the driver ends."""
    for path in list(_KEPT):
        with contextlib.suppress(Exception):  # Spark may have ended already
            drop_folder(path)


atexit.register(clean)


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and read it back: columnar, prunable, computed once, survives executors."""
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._folder = path
    return out


def settled(df: DataFrame) -> DataFrame:
    """``written`` for a step whose name says nothing; the lineage ends here (a checkpoint would compute its last stage twice)."""
    return written(df, "step")


def side_by_side(*calls: Callable[[], T], at_once: int = 8) -> list[T]:
    """What calls that run Spark jobs of their own return, run at once: the scheduler deals the cores among their stages."""
    with ThreadPoolExecutor(max(1, min(at_once, len(calls)))) as pool:
        return list(pool.map(lambda call: call(), calls))


def dropped(df: DataFrame) -> None:
    """Delete the files of a ``written`` relation that nothing reads any more."""
    drop_folder(df._folder)
