"""Benchmark logs as they arrive: running counts and means by phase and worker count."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import logs


def sample_stream(spark: SparkSession, path: str, pattern: str = "*.out") -> DataFrame:
    """A stream of files, one row each: (file, workers, sample), a row for each timed line.

    Files must be complete when they appear (written elsewhere, then moved).  Markers
    hold inside a file only, so no state is kept between files.
    """
    files = spark.readStream.option("pathGlobFilter", pattern).text(path, wholetext=True)
    split = files.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"), F.split("value", "\r?\n").alias("all"))
    workers = F.try_element_at(F.filter("all", lambda v: v.rlike(logs.WORKERS)), F.lit(-1))
    filled = F.aggregate(
        "all",
        F.struct(F.lit(logs.UNKNOWN).alias("matrix"), F.array().cast("array<struct<matrix:string,line:string>>").alias("out")),
        lambda s, v: F.when(v.rlike(logs.MATRIX), F.struct(F.regexp_extract(v, logs.MATRIX, 1).alias("matrix"), s["out"].alias("out")))
        .when(v.rlike(logs.PERF), F.struct(s["matrix"].alias("matrix"), F.concat(s["out"], F.array(F.struct(s["matrix"].alias("matrix"), v.alias("line")))).alias("out")))
        .otherwise(s),
    )
    each = split.select("file", F.regexp_extract(workers, logs.WORKERS, 1).cast("int").alias("workers"), F.explode(filled["out"]).alias("s"))
    time = F.regexp_extract("s.line", r"(?:^|,)time=([0-9.eE+-]+)", 1).try_cast("double")
    return each.select("file", "workers", "s.matrix", F.regexp_extract("s.line", logs.PERF, 1).alias("phase"), time.alias("time_s")).where("time_s is not null")


def running_means(stream: DataFrame) -> DataFrame:
    """Count and mean by matrix, phase and workers, for output mode update or complete."""
    return stream.groupBy("matrix", "phase", "workers").agg(F.count("*").alias("n"), F.avg("time_s").alias("mean_time_s"))
