"""Where operators keep intermediate tables.

Everything goes below ``spark.checkpoint.dir``, the folder that the driver and
all executors share; a written Parquet table there survives the loss of any
executor and cuts the lineage. Only where the session has no such setting and
runs on one machine (unit tests, a laptop) is a folder of our own set; on a
cluster without a shared folder nothing is written at all.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"

#: Folders that this process made and has not deleted.
_made: set[str] = set()


def fresh_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names for helper columns that no column of ``df`` has, in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; on one machine only, a folder of our own if the session names none."""
    base = spark.conf.get(CHECKPOINT_DIR, None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder that the driver and all executors share")
        base = f"file://{os.path.join(tempfile.gettempdir(), 'checkpoints')}"
        spark.conf.set(CHECKPOINT_DIR, base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    folder = f"{shared_dir(spark)}/pit-{uuid.uuid4().hex}"
    _made.add(folder)
    return f"{folder}/{name}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder once and return the reread table."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def discard(*tables: DataFrame) -> None:
    """Delete the files of materialized tables that no later step reads."""
    for df in tables:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            folder = path.rsplit("/", 1)[0]
            _delete(df.sparkSession, folder)
            _made.difference_update({x for x in _made if x.rsplit("/", 1)[1] == folder.rsplit("/", 1)[1]})


def sweep(spark: SparkSession) -> None:
    """Delete every intermediate table of this process; results not yet written elsewhere are lost with them."""
    while _made:
        _delete(spark, _made.pop())
