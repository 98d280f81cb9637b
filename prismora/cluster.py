"""The folder that all executors share."""

from __future__ import annotations

import atexit
import hashlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a local session without it gets its own, a cluster must name one."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    own = tempfile.mkdtemp(prefix="prismora-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{own}")
    return f"file://{own}"


def new_folder(spark: SparkSession, what: str) -> str:
    """URI of a fresh folder in the shared one."""
    return _noted(f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}")


def kept_folder(spark: SparkSession, what: str, of: str) -> str:
    """URI of the one folder in the shared one for what is kept of a source; later sessions find it again."""
    return _noted(f"{shared_dir(spark)}/{what}-{hashlib.md5(of.encode()).hexdigest()}")


def _noted(to: str) -> str:
    for made in _made:
        made.append(to)
    return to


_made: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is written into the shared folder inside goes at the end.

    DataFrames read from it are of no use after that: write or collect the
    result inside.  Without it intermediate tables stay, as a lazy result may
    be read at any time.
    """
    made: list[str] = []
    _made.append(made)
    try:
        yield
    finally:
        _made.remove(made)
        path, conf = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, spark.sparkContext._jsc.hadoopConfiguration()
        for to in made:
            path(to).getFileSystem(conf).delete(path(to), True)


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a Parquet table in the shared folder, where its lineage ends."""
    to = new_folder(df.sparkSession, what)
    df.write.parquet(to)
    return df.sparkSession.read.schema(df.schema).parquet(to)
