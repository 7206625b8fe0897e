"""Lineage cuts for iterative jobs.

Each round of an iterative operator is written as a parquet table below the
folder the cluster names in ``spark.checkpoint.dir`` and read back.  A lost
executor then costs one round at most, and the reader keeps column pruning,
filter pushdown and true table sizes, which a row-based checkpoint does not.
"""

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

_SETTING = "spark.checkpoint.dir"
_local_folder: dict[str, str] = {}


def work_dir(spark: SparkSession) -> str:
    """Shared folder for cut tables; a private one only for local sessions that set none."""
    app = spark.sparkContext.applicationId
    folder = spark.conf.get(_SETTING, None)
    if not folder:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise RuntimeError(f"set {_SETTING} to a folder every executor can reach")
        if app not in _local_folder:
            _local_folder[app] = tempfile.mkdtemp(prefix="run-", dir="/tmp")
        folder = _local_folder[app]
    return f"{folder.rstrip('/')}/{app}"


def cut(df: DataFrame, label: str = "cut") -> DataFrame:
    """Write ``df`` once and return a reader of the written table."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.cut_path = path
    return table


def cut_counted(df: DataFrame, label: str, **counts: Column) -> tuple[DataFrame, dict[str, int]]:
    """``cut`` that also returns aggregates observed while writing, so loops need no extra counting job."""
    seen = Observation()
    table = cut(df.observe(seen, *[c.alias(n) for n, c in counts.items()]), label)
    return table, seen.get


def discard(*tables: DataFrame) -> None:
    """Delete cut tables once what was made of them is written; tables that are no cuts are left alone."""
    for table in tables:
        path = getattr(table, "cut_path", None)
        if path:
            jvm = table.sparkSession.sparkContext._jvm
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(place, True)
