"""Helpers of the operators in this package."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Give the Python workers this package, as ``--py-files`` would; once per application."""
    context = spark.sparkContext
    if getattr(context, "_needledrop_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="needledrop-")) / "needledrop_src.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for source in sorted(root.rglob("*.py")):
            z.write(source, source.relative_to(root.parent))
    context.addPyFile(str(archive))
    context._needledrop_shipped = True


def row_key(*columns: str) -> Column:
    """A 64-bit name of a row's content; rows with equal values share it and are treated alike."""
    return F.xxhash64(*[F.col(c) for c in columns])


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file lies on this machine; asked on each executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


def partitions(df: DataFrame) -> int:
    """The shuffle width of the session, for explicit exchanges."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def grid(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    left_id: str,
    right_id: str,
    left_rows: int,
    right_rows: int,
    cell: Callable[[pa.Table, pa.Table], pa.Table],
    schema: str,
) -> DataFrame:
    """Apply ``cell`` to all left rows with all right rows of a key, in blocks.

    A key with many rows is a grid of cells of about ``left_rows`` by ``right_rows`` rows, so the
    size of a task does not depend on how large a key is. Every pair of rows meets in one cell.
    """
    # New column ids, so that both sides may come from one table.
    right = right.select(*[F.col(c).alias(c) for c in right.columns])
    sizes = (
        left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_nl"))
        .join(right.groupBy(*keys).agg(F.count(F.lit(1)).alias("_nr")), keys)
        .select(
            *keys,
            F.ceil(F.col("_nl") / left_rows).cast("int").alias("_nl"),
            F.ceil(F.col("_nr") / right_rows).cast("int").alias("_nr"),
        )
    )
    place = [*keys, "_i", "_j"]
    rows = left.join(sizes, keys).withColumn("_i", F.pmod(F.xxhash64(left_id), F.col("_nl")).cast("int"))
    rows = rows.withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_nr") - 1))).drop("_nl", "_nr")
    columns = right.join(sizes, keys).withColumn("_j", F.pmod(F.xxhash64(right_id), F.col("_nr")).cast("int"))
    columns = columns.withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_nl") - 1))).drop("_nl", "_nr")
    return rows.groupBy(*place).cogroup(columns.groupBy(*place)).applyInArrow(cell, schema)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables that end where a group ends, from batches sorted by ``keys``."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if not held:
            held = [batch]
        else:
            before, first = held[-1].slice(held[-1].num_rows - 1), batch.slice(0, 1)
            last = batch.slice(batch.num_rows - 1)
            same = all(first.column(k)[0] == before.column(k)[0] for k in keys)
            if not same:
                yield pa.Table.from_batches(held)
                held = [batch]
            else:
                held.append(batch)
                if all(first.column(k)[0] == last.column(k)[0] for k in keys):
                    continue
        # Cut before the last group of what is held.
        whole = pa.Table.from_batches(held).combine_chunks()
        cut = _last_group(whole, keys)
        if cut:
            yield whole.slice(0, cut)
        held = whole.slice(cut).to_batches()
    if held:
        yield pa.Table.from_batches(held)


def _last_group(rows: pa.Table, keys: list[str]) -> int:
    low, high = 0, rows.num_rows - 1
    want = [rows.column(k)[high] for k in keys]
    while low < high:
        middle = (low + high) // 2
        if all(rows.column(k)[middle] == w for k, w in zip(keys, want)):
            high = middle
        else:
            low = middle + 1
    return low
