"""Tables kept between runs, in the shared folder of the cluster."""

from __future__ import annotations

import hashlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Raise when an operator changes what it computes.
STORE_VERSION = 2


def shared_dir(spark: SparkSession, name: str = "needledrop") -> str:
    """A folder under the cluster's checkpoint folder.

    Where none is set, a session of one process (``local``, as in tests) uses one temporary folder
    of its application; a cluster is refused.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors reach")
        base = getattr(context, "_needledrop_folder", None) or tempfile.mkdtemp(prefix="needledrop-")
        context._needledrop_folder = base
    return f"{base.rstrip('/')}/{name}"


def settled(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table of this application and read back.

    Used where several passes follow: they then read few columns of a table, the plan starts
    afresh, and a lost executor costs only its own tasks.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def removed(spark: SparkSession, path: str) -> None:
    """Delete a table that nothing reads any more; one that is not there is no error."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def content_sums(columns: list[str]) -> list[Column]:
    """Aggregates that depend on the values of the columns and not on the order of the rows."""
    # Each value as text with its length in front, null apart, so that values cannot run together.
    part = [F.col(f"`{c}`").cast("string") for c in columns]
    framed = [F.coalesce(F.concat(F.length(p).cast("string"), F.lit(":"), p), F.lit("-")) for p in part]
    h = F.md5(F.concat(*framed) if framed else F.lit(""))

    def total(start: int) -> Column:
        number = F.conv(F.substring(h, start, 8), 16, 10).cast("bigint")
        return F.coalesce(F.sum(number.cast("decimal(20,0)")), F.lit(0)).cast("decimal(38,0)")

    return [F.count(F.lit(1)).alias("n_rows"), *[total(s).alias(f"sum_{s}") for s in (1, 9, 17, 25)]]


def fingerprint(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row that depends on the values of the columns and not on the order of the rows."""
    return df.agg(*content_sums(columns or df.columns))


def content_key(df: DataFrame) -> str:
    """A text that changes with any value and with the columns of a table; one pass over it."""
    return str(tuple(fingerprint(df).first())) + df.schema.simpleString()


def stored(df: DataFrame, name: str, inputs: list[DataFrame | str], folder: str | None = None) -> DataFrame:
    """``df`` as a table, written once per content of ``inputs`` (all their columns, or their content keys).

    The key covers every input value, the columns of the result and ``STORE_VERSION``.
    """
    spark = df.sparkSession
    parts = [name, str(STORE_VERSION), df.schema.simpleString()]
    parts += [i if isinstance(i, str) else content_key(i) for i in inputs]
    key = hashlib.sha256("\n".join(parts).encode()).hexdigest()[:32]
    path = f"{folder or shared_dir(spark)}/{name}-{key}"
    if not path_exists(spark, f"{path}/_SUCCESS"):
        df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
