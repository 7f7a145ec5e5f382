"""Records of delimited text files whose quoted fields hold line breaks, cut in parallel.

A line alone does not tell whether it starts inside a quoted field. So every line is read as a function from
"starts outside quotes" and "starts inside" to how it ends; there are four such functions. They are composed
along each split of a file, then along its splits (one row per split), which tells the state in which every
line starts. A line that starts outside begins a record, and lines that start inside go to the record before.

Lines are sent once, by split, so a file is read by as many tasks as it has splits. Only records of several
lines are put together after that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from needledrop.sources.store import settled

_PLACE = ["file", "block"]


def ends_inside(line: Column, sep: str) -> Column:
    """Whether a line that starts at the start of a field ends inside a quoted field.

    A quote opens at the start of a field only; inside quotes two quotes stand for one; after the closing quote
    the field goes on without quotes to the next separator. The quotes of a line are taken one by one, and a
    line without any is not looked at.
    """
    parts = F.split(line, '"', -1)
    outside, inside, closed = F.lit(0), F.lit(1), F.lit(2)

    def quote(state: Column, at: Column) -> Column:
        # The quote after part ``at``; the state is the one in which that part was read.
        part = F.element_at(parts, at)
        opens = F.when(part.endswith(sep) | ((at == 1) & (part == "")), inside).otherwise(outside)
        return F.when(state == inside, closed).when((state == closed) & (part == ""), inside).otherwise(opens)

    state = F.aggregate(F.sequence(F.lit(1), F.size(parts) - 1), outside, quote)
    return F.when(F.contains(line, F.lit('"')), state == inside).otherwise(False)


def _lines(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """Lines with their place and how they end, by how they start: ``out0`` and ``out1``."""
    lines = spark.read.option("lineSep", "\n").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")
    )
    lines = lines.withColumn("no", F.monotonically_increasing_id())
    return lines.withColumn("out0", ends_inside(F.col("value"), sep)).withColumn("out1", ends_inside(F.concat(F.lit('"'), "value"), sep))


def _after(window) -> tuple[Column, Column]:
    """How the lines of a window end together, by how the first starts."""
    swap = (F.col("out0") & ~F.col("out1")).cast("int")
    swaps = F.sum(swap).over(window)
    # A line that ends in one way however it starts makes the lines before it forgotten.
    fixed = F.last(F.when(F.col("out0") == F.col("out1"), F.struct(F.col("out0").cast("int").alias("to"), F.col("_swaps").alias("swaps"))), ignorenulls=True).over(window)
    since = F.pmod(swaps - F.coalesce(fixed.swaps, F.lit(0)), F.lit(2))
    return F.pmod(F.coalesce(fixed.to, F.lit(0)) + since, F.lit(2)) == 1, F.pmod(F.coalesce(fixed.to, F.lit(1)) + since, F.lit(2)) == 1


def read_records(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """(file, block, no, record): the records of all files of a path; (block, no) ascends within a file.

    Line breaks inside a record stay as they are; a carriage return at its end goes. Empty records are left out.
    A quoted field that never closes takes all lines to the end of its file.
    """
    in_block = W.partitionBy(*_PLACE).orderBy("no")
    upto, before = (in_block.rowsBetween(W.unboundedPreceding, end) for end in (W.currentRow, -1))
    lines = _lines(spark, path, sep)
    swap = (F.col("out0") & ~F.col("out1")).cast("int")

    # What each split does to the state, from narrow rows: they are read without their text.
    narrow = settled(lines.drop("value"), "line-ends").withColumn("_swaps", F.sum(swap).over(upto))
    ends0, ends1 = _after(upto)
    blocks = narrow.select(*_PLACE, "no", ends0.alias("end0"), ends1.alias("end1")).groupBy(*_PLACE)
    blocks = blocks.agg(F.max_by(F.struct("end0", "end1"), "no").alias("_end"), F.count(F.lit(1)).alias("_lines"))
    blocks = settled(blocks.select(*_PLACE, "_end.*"), "split-ends")
    # One row per split, in the order of the file: the same rule once more.
    along = W.partitionBy("file").orderBy("block")
    renamed = blocks.withColumnsRenamed({"end0": "out0", "end1": "out1"})
    renamed = renamed.withColumn("_swaps", F.sum(swap).over(along.rowsBetween(W.unboundedPreceding, W.currentRow)))
    entered = F.coalesce(_after(along.rowsBetween(W.unboundedPreceding, -1))[0], F.lit(False))
    starts = renamed.select(*_PLACE, entered.alias("_entered"))

    # Splits are as many as tasks read the files, so their states fit every task.
    rows = lines.join(F.broadcast(starts), _PLACE).withColumn("_swaps", F.sum(swap).over(upto))
    start0, start1 = _after(before)
    inside = F.when(F.col("_entered"), F.coalesce(start1, F.lit(True))).otherwise(F.coalesce(start0, F.lit(False)))
    rows = rows.select(*_PLACE, "no", "value", inside.alias("_inside"))
    own = F.last(F.when(~F.col("_inside"), F.col("no")), ignorenulls=True).over(upto)
    more = F.lead("_inside").over(in_block)
    rows = rows.select(*_PLACE, "no", "value", own.alias("_own"), "_inside", more.alias("_more"))

    # A record of one line is done; the last one of a split may go on in the next.
    whole = rows.where(~F.col("_inside") & ~F.coalesce("_more", F.lit(True))).select(*_PLACE, "no", F.col("value").alias("record"))
    parts = settled(rows.where(F.col("_inside") | F.coalesce("_more", F.lit(True))).drop("_more"), "record-parts")
    # Lines at the head of a split belong to the last record that began in an earlier one.
    last = parts.groupBy(*_PLACE).agg(F.max("_own").alias("_last"))
    carried = F.last("_last", ignorenulls=True).over(along.rowsBetween(W.unboundedPreceding, -1))
    block_of = F.last(F.when(F.col("_last").isNotNull(), F.col("block")), ignorenulls=True).over(along.rowsBetween(W.unboundedPreceding, -1))
    heads = blocks.select(*_PLACE).join(last, _PLACE, "left").select(*_PLACE, carried.alias("_carried"), block_of.alias("_from"))
    parts = parts.join(F.broadcast(heads), _PLACE).select(
        "file", F.when(F.col("_own").isNull(), F.col("_from")).otherwise(F.col("block")).alias("_block"),
        F.coalesce("_own", "_carried").alias("_no"), F.struct("block", "no", "value").alias("_line"),
    )
    text = F.array_join(F.transform(F.array_sort(F.collect_list("_line")), lambda x: x["value"]), "\n")
    joined = parts.groupBy("file", "_block", "_no").agg(text.alias("record"))
    joined = joined.select("file", F.col("_block").alias("block"), F.col("_no").alias("no"), "record")
    both = whole.unionByName(joined).withColumn("record", F.regexp_replace("record", r"\r$", ""))
    return both.where(F.col("record") != "")


def read_quoted(spark: SparkSession, path: str, sep: str, schema, names: list[str], options: dict) -> DataFrame:
    """Rows of delimited files with a header line each, parsed from their records."""
    records = read_records(spark, path, sep)
    # The header is the first record of each file.
    first = records.groupBy("file").agg(F.min(F.struct("block", "no")).alias("_head"))
    records = records.join(F.broadcast(first), "file").where(F.struct("block", "no") != F.col("_head"))
    parsed = F.from_csv(F.col("record"), _ddl(schema), {**options, "sep": sep})
    return records.select(parsed.alias("_row")).select(*[F.col(f"_row.`{n}`").alias(n) for n in names])


def _ddl(schema) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
