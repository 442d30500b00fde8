"""Tables written between steps, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new path under the shared folder.

    The cluster names it in ``spark.checkpoint.dir``.  Where that is unset a
    folder of our own is chosen if everything runs in this process (tests, a
    laptop); on a cluster it is an error, for no other machine would see it.
    """
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir")
    if not base:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = getattr(context, "_stratalake_scratch", None)
        if not base:
            base = context._stratalake_scratch = "file://" + tempfile.mkdtemp(prefix="stratalake-")
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts lineage in a form that survives the loss of executors.
    """
    spark, path = df.sparkSession, shared_dir(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    for made in _open:
        made.append(out)
    return out


_open: list[list[DataFrame]] = []


@contextmanager
def scope() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Delete at its end what ``written`` made inside, but for tables given to what this yields.

    For runs whose results are read from tables that were kept, or written elsewhere.
    """
    made: list[DataFrame] = []
    kept: set[str] = set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df._scratch_path)
        return df

    _open.append(made)
    try:
        yield keep
    finally:
        _open.remove(made)
        discard(*(df for df in made if df._scratch_path not in kept))


def discard(*tables: DataFrame) -> None:
    """Delete tables made by ``written`` that nothing will read again."""
    for df in tables:
        spark, path = df.sparkSession, df._scratch_path
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)
