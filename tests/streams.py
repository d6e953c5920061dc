"""Streams over files: a micro-batch a folder entry."""

from functools import reduce


def fed(spark, path, groups, schema):
    """A stream whose micro-batches are the groups of frames, in order."""
    source = str(path / "in")
    for i, group in enumerate(groups):
        reduce(lambda a, b: a.unionAll(b), group).coalesce(1).write.mode("append").parquet(source)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(source)


def drained(stream, path, name):
    """Rows of a stream that has read all that is there."""
    spark = stream.sparkSession
    query = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(path / "ck")).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return spark.table(name).collect()


def resumed(stream, path):
    """Rows that a stream adds to those of its earlier runs: a query that is started again from its checkpoint."""
    spark, out = stream.sparkSession, str(path / "out")
    before = spark.read.parquet(out).collect() if (path / "out").exists() else []
    query = stream.writeStream.format("parquet").option("path", out).outputMode("append").option("checkpointLocation", str(path / "ck")).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    rows = [tuple(r) for r in spark.read.schema(stream.schema).parquet(out).collect()]
    for r in before:
        rows.remove(tuple(r))
    return rows
