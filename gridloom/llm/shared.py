"""What the operators of this subpackage share: workspace tables, row ids, prefix sums, Arrow batches."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows that are Python objects at a time; Spark bounds the bytes of its own batches.
BATCH_ROWS = 512
#: Buckets that one task of a prefix sum adds up.
FAN = 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _workspace(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir. Only a local session may do without: it gets a folder of its own machine."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    at = sc._jsc.sc().getCheckpointDir()
    if at.isDefined():
        return named or at.get()
    if named is None and not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="gridloom-"))
    return named or sc._jsc.sc().getCheckpointDir().get()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in spark.checkpoint.dir."""
    _workspace(df.sparkSession)
    return df.checkpoint()


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of BATCH_ROWS for the jobs that are run inside; the session's setting is as before afterwards."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, BATCH_ROWS)
    try:
        yield
    finally:
        spark.conf.set(key, before)


#: Folders that save() has made since scratch() was entered, innermost last.
_MADE: list[list[str]] = []


def save(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write df as Parquet into the shared checkpoint folder and read it back: pruned reads, stable row ids."""
    folder = f"{_workspace(df.sparkSession).rstrip('/')}/gridloom-{uuid.uuid4().hex}"
    if _MADE:
        _MADE[-1].append(folder)
    with _small_batches(df.sparkSession):
        df.write.option("compression", compression).parquet(f"{folder}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")


@contextmanager
def scratch() -> Iterator[list[str]]:
    """The folders that save() makes inside, for discard() once what reads them has been written."""
    _MADE.append([])
    try:
        yield _MADE[-1]
    finally:
        _MADE.pop()


def discard(spark: SparkSession, folders: list[str]) -> None:
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def with_row_id(df: DataFrame, name: str) -> DataFrame:
    """A row id; call save() or checkpoint() on what holds it before it is used twice."""
    return df.withColumn(name, F.monotonically_increasing_id())


def unused(df: DataFrame, name: str) -> str:
    """name, with underscores in front until no column of df has it, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def column(name: str) -> Column:
    """A column by its name as it is, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def slices(batches: Iterator[pa.RecordBatch], rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """Batches of a few rows: whole texts become Python objects a slice at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict[str, list] | None]], schema: str) -> DataFrame:
    """mapInArrow in slices of BATCH_ROWS. make() runs once a task and returns the function of a slice, which returns columns, or an iterator of them."""
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in slices(batches):
            got = f(batch)
            for one in () if got is None else (got,) if isinstance(got, dict) else got:
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) and x.type == field.type else x.cast(field.type) if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x, field.type) for field in out for x in (one[field.name],)], schema=out)

    return df.mapInArrow(run, schema)


def prefix_sum(df: DataFrame, group: Sequence[str], bucket: str, order: Sequence[Column], value: str, into: str) -> DataFrame:
    """Add into: the sum of value over the rows of the same group that come before, by bucket (a long), then by order.

    Only a bucket's rows meet in one task. The buckets' totals are added up FAN at a time, and the totals of those, one row
    for FAN buckets, in order; so a group that holds most rows is no task's work alone. Buckets must be of bounded size.
    """
    keys = [*group, bucket]
    totals = df.groupBy(*keys).agg(F.sum(value).alias("_total")).withColumn("_super", F.floor(F.col(bucket) / FAN).cast("long"))
    supers = totals.groupBy(*group, "_super").agg(F.sum("_total").alias("_super_total"))
    before = Window.partitionBy(*group).orderBy("_super").rowsBetween(Window.unboundedPreceding, -1)
    supers = supers.select(*group, "_super", F.coalesce(F.sum("_super_total").over(before), F.lit(0)).alias("_super_before"))
    inside = Window.partitionBy(*group, "_super").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.join(supers, [*group, "_super"]).select(*keys, (F.col("_super_before") + F.coalesce(F.sum("_total").over(inside), F.lit(0))).alias("_bucket_before"))
    rows = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.join(totals, keys).withColumn(into, (F.col("_bucket_before") + F.coalesce(F.sum(value).over(rows), F.lit(0))).cast("long")).drop("_bucket_before")
