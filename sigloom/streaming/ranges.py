"""A table as a stream in order of event time: files of time ranges, the earliest first."""

from __future__ import annotations

from pyspark.sql import DataFrame

from sigloom.sources.folders import new_folder


def in_time_ranges(rows: DataFrame, at: str, parts: int, name: str = "ranges") -> DataFrame:
    """``rows`` as a stream whose micro-batches are ``parts`` ranges of ``at`` (never null), each sorted by it.

    Rows are dealt by range, so no task sorts all of them.  A stream of files takes the one that was changed first, so
    the files' times are set in the order of their ranges."""
    spark = rows.sparkSession
    folder = new_folder(spark, name)
    rows.repartitionByRange(parts, at).sortWithinPartitions(at).write.parquet(folder)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files = sorted((f.getPath() for f in fs.listStatus(path) if f.getPath().getName().startswith("part-")), key=lambda p: p.getName())
    for k, file in enumerate(files):
        fs.setTimes(file, 1_000_000_000_000 + 1_000 * k, -1)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)
