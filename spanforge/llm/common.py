"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from spanforge.shipping import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in spark.checkpoint.dir.

    Only a local master without the setting (tests) gets a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    current = spark.sparkContext.getCheckpointDir()
    if named:
        if current is None:
            spark.sparkContext.setCheckpointDir(named)
        return named
    if current is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spanforge-"))
        current = spark.sparkContext.getCheckpointDir()
    return current


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that is no longer needed, on whatever file system it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with reliable files in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows of a batch that are Python objects at a time.
ROWS_AT_ONCE = 512
#: Rows of an Arrow batch, in place of Spark's own default: long texts make full batches large in both processes.
_BATCH_SETTING, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "1000"


def _prepared(spark: SparkSession) -> None:
    """Ship the package and, where the session has chosen no size of Arrow batches (10,000 rows included), set it.

    The setting is the session's and stays; set it to keep another one.
    """
    ship(spark)
    if _BATCH_SETTING not in spark.conf.getAll:
        spark.conf.set(_BATCH_SETTING, BATCH_ROWS)


def map_rows(df: DataFrame, make: Callable[[], Callable[[list], Iterator[dict] | dict]], schema: str | StructType) -> DataFrame:
    """Run ``make()(rows)`` over Arrow batches.

    ``make`` is called once a task and gives a function from a batch's columns
    (``{name: list}``) to output columns (``{name: list}``).
    """
    _prepared(df.sparkSession)
    kind = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    arrow = to_arrow_schema(kind)

    def run(batches):
        work = make()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                out = work({n: part.column(i).to_pylist() for i, n in enumerate(part.schema.names)})
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, kind)


def column_of(spark: SparkSession, make: Callable[[], Callable[[list], list]], kind: str, source: Column) -> Column:
    """A column of ``make()(values)``; ``make`` is called once a task. Rows stay where they are."""
    _prepared(spark)
    arrow = to_arrow_schema(StructType.fromDDL(f"x {kind}")).field(0).type

    @F.arrow_udf(kind)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        work = make()
        for values in batches:
            parts = [pa.array(work(values.slice(at, ROWS_AT_ONCE).to_pylist()), arrow) for at in range(0, len(values), ROWS_AT_ONCE)]
            yield pa.concat_arrays(parts) if parts else pa.array([], arrow)

    return run(source)


def text_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, so that further columns can't clash with outputs."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
