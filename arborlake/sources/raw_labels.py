"""Flat unsigned label volumes: fixed-length records through Hadoop's file systems, split like any other input."""

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed names of Spark's input format for records of one length; its key is the number of a record.
_FORMAT = "org.apache.spark.input.FixedLengthBinaryInputFormat"


def _size(spark: SparkSession, path: str) -> int:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getFileStatus(place).getLen()


def read_raw_labels(spark: SparkSession, path: str, dims=(1600, 1400, 500), width: int = 1, reverse=()) -> DataFrame:
    """(i, j, k, label), indices from 1, of a volume of ``width`` bytes a voxel (1 or 2, low byte first), first axis fastest.

    A record is a run of voxels along the first axis.  Axes in ``reverse`` (2 or 1, 2, ...) count from their end.
    """
    nx, ny, nz = dims
    size = _size(spark, path)
    if size != nx * ny * nz * width:
        raise ValueError(f"{path} has {size} bytes, {nx * ny * nz * width} expected for {tuple(dims)}")
    rows = spark.sparkContext.newAPIHadoopFile(
        path, _FORMAT, "org.apache.hadoop.io.LongWritable", "org.apache.hadoop.io.BytesWritable", conf={f"{_FORMAT}.recordLength": str(nx * width)})
    kind, back = np.dtype("<u1" if width == 1 else "<u2"), set(reverse)

    def run(batches):
        for batch in batches:
            at = np.repeat(batch.column("at").to_numpy(), nx)
            label = np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in batch.column("data")] or [np.zeros(0, kind)])
            place = np.tile(np.arange(nx), batch.num_rows), at % ny, at // ny
            cols = [(n - v if axis + 1 in back else v + 1).astype(np.int32) for axis, (v, n) in enumerate(zip(place, dims))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*cols, label.astype(np.int32))], names=["i", "j", "k", "label"])

    return spark.createDataFrame(rows, "at long, data binary").mapInArrow(run, "i int, j int, k int, label int")


def write_raw_labels(volume: DataFrame, path: str, dims: tuple[int, int, int], fill: int, edge: int = 10) -> None:
    """(i, j, k, label) of labels below 128 as one file of one byte a voxel, as Spark's text writer makes it.

    The records end with a border voxel of label ``edge``, so the volume is one voxel longer along the first axis.
    Voxels without a row have label ``fill``; no label may be ``edge``.  One file is one task's work: it is written run by run.
    """
    nx, ny, nz = dims
    runs = volume.groupBy("j", "k").agg(F.map_from_entries(F.collect_list(F.struct("i", "label"))).alias("m"))
    all_runs = volume.sparkSession.range(ny * nz).select((F.col("id") % ny + 1).cast("int").alias("j"), (F.floor(F.col("id") / ny) + 1).cast("int").alias("k"))
    text = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(nx)), lambda i: F.char(F.coalesce(F.try_element_at("m", i), F.lit(fill)))), "")
    lines = all_runs.join(runs, ["j", "k"], "left").select("j", "k", text.alias("value"))
    lines.coalesce(1).sortWithinPartitions("k", "j").select("value").write.option("lineSep", chr(edge)).text(path)
